"""Tables written between the steps of an operator, in the folder all executors share."""

from __future__ import annotations

import gc
import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def shared_folder(spark: SparkSession) -> str:
    """The session's ``spark.checkpoint.dir``; on a local master without one, a private folder."""
    base = spark.conf.get("spark.checkpoint.dir", None)
    if base:
        return base.rstrip("/")
    if not spark.sparkContext.master.startswith("local"):
        raise ValueError("set spark.checkpoint.dir to a folder that all executors share")
    if spark.sparkContext.master.startswith("local-cluster"):
        raise ValueError("set spark.checkpoint.dir to a folder that all executors share")
    folder = "file://" + tempfile.mkdtemp(prefix="trialweave-llm-")
    spark.conf.set("spark.checkpoint.dir", folder)
    return folder


def new_folder(spark: SparkSession, name: str) -> str:
    return f"{shared_folder(spark)}/llm-{name}-{uuid.uuid4().hex}"


class Steps:
    """Writes the tables between steps, and deletes those that are no longer needed.

    A table that is read again after an executor is lost comes from the shared folder, so no
    earlier step is repeated. ``keep`` names the tables that the returned plan still reads.
    """

    def __init__(self, spark: SparkSession, name: str):
        self.spark, self.base, self.n, self.written = spark, new_folder(spark, name), 0, {}

    def write(self, df: DataFrame) -> DataFrame:
        self.n += 1
        path = f"{self.base}/{self.n}"
        df.write.parquet(path)
        out = self.spark.read.schema(df.schema).parquet(path)
        out._llm_path = path
        self.written[path] = out
        return out

    def keep(self, *tables: DataFrame) -> None:
        """Delete every written table but these, which are all that later plans read."""
        stay = {t._llm_path for t in tables}
        self.drop(*[t for path, t in self.written.items() if path not in stay])

    def drop(self, *tables: DataFrame) -> None:
        """Delete written tables, and let Spark release the shuffle files of finished steps."""
        jvm, conf = self.spark._jvm, self.spark._jsc.hadoopConfiguration()
        for t in tables:
            path = jvm.org.apache.hadoop.fs.Path(t._llm_path)
            path.getFileSystem(conf).delete(path, True)
            self.written.pop(t._llm_path, None)
        self.release()

    def release(self) -> None:
        """Shuffle files go once neither Python nor the JVM refers to the plan that made them."""
        gc.collect()
        self.spark._jvm.System.gc()


def held_out(key: str = "doc_id"):
    """Rows kept from every training: crc32 of the id as text, modulo 4, is 2."""
    return F.coalesce(F.crc32(F.col(key).cast("string").cast("binary")) % 4 == 2, F.lit(False))


#: Words are runs of bytes other than space, tab, line feed, vertical tab, form feed and carriage return.
WORD = r"[^\x20\x09-\x0D]+"


def join_unique(rows: DataFrame, table: DataFrame, key: str, share: int = 1000) -> DataFrame:
    """Left join of ``rows`` with a table of one row a key, whatever the share of one key in ``rows``.

    Keys that hold over one ``share``-th of all rows are fewer than ``share``; their rows stay where they are and
    meet a broadcast of so many rows at most. All other keys are shuffled. Both should be written tables.
    """
    least = rows.count() // share
    hot = rows.filter(F.col(key).isNotNull()).groupBy(key).agg(F.count(F.lit(1)).alias("__n")).filter(F.col("__n") > F.lit(max(least, share)))
    hot = [r[0] for r in hot.select(key).collect()]
    if not hot:
        return rows.join(table, key, "left")
    hot = F.broadcast(rows.sparkSession.createDataFrame([(k,) for k in hot], rows.select(key).schema))
    few = F.broadcast(table.join(hot, key, "left_semi"))
    return rows.join(hot, key, "left_semi").join(few, key, "left").unionByName(rows.join(hot, key, "left_anti").join(table, key, "left"))
