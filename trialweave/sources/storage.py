"""Readers and writers of study data, and where lineage is cut."""

from __future__ import annotations

import json
import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from trialweave.operators.prep import strict_columns
from trialweave.study import DRUGS, MEASURE_FILES, TEXT_MEASURES


def read_table(spark: SparkSession, path: str, schema: str | None = None) -> DataFrame:
    reader = spark.read.schema(schema) if schema else spark.read
    return reader.parquet(path)


def tagged_measure(df: DataFrame, name: str, column: str, text: bool) -> DataFrame:
    """One measure's rows in the long layout; text and numbers keep separate value columns."""
    ident = F.col("event_id") if "event_id" in df.columns else F.lit(None)
    value = F.col(column)
    return df.select(
        "patid",
        "eventdate",
        ident.cast("long").alias("event_id"),
        F.lit(name).alias("measure_name"),
        (F.lit(None) if text else value).cast("double").alias("value_num"),
        (value if text else F.lit(None)).cast("string").alias("value_str"),
    )


def tagged_drug(df: DataFrame, name: str) -> DataFrame:
    return df.select("patid", "eventdate", F.lit(name).alias("med_name"))


def union_all(frames: list[DataFrame]) -> DataFrame:
    out = frames[0]
    for f in frames[1:]:
        out = out.unionByName(f)
    return out


def read_measurements(spark: SparkSession, folder: str) -> DataFrame:
    """All measure files of a folder as one long table."""
    return union_all(
        [
            tagged_measure(read_table(spark, f"{folder}/{file}.parquet"), name, column, name in TEXT_MEASURES)
            for name, (file, column) in MEASURE_FILES.items()
        ]
    )


def read_prescriptions(spark: SparkSession, folder: str, drugs: tuple[str, ...] = DRUGS) -> DataFrame:
    return union_all([tagged_drug(read_table(spark, f"{folder}/{d}.parquet"), d) for d in drugs])


def write_by_patient(df: DataFrame, table: str, path: str, buckets: int = 64) -> DataFrame:
    """``df`` as a table of the session's catalog, its files dealt and sorted by patient; returns the table.

    Tables with equally many buckets meet by patient without an exchange, so the cohort plan on them moves no patient,
    prescription or measurement; a patient's rows were moved once, here.
    """
    rows = df.repartition(buckets, "patid")
    rows.write.mode("overwrite").option("path", path).bucketBy(buckets, "patid").sortBy("patid").saveAsTable(table, format="parquet")
    return df.sparkSession.table(table)


def write_cohort(cohort: DataFrame, path: str) -> None:
    """One dataset for all trials, one partition folder per trial start.

    Rebalancing gathers a trial's rows into few files and lets adaptive execution split a
    trial that is too large for one task.
    """
    cohort.hint("rebalance", "trial_start").write.mode("overwrite").partitionBy("trial_start").parquet(path)


def refresh_trials(trials: DataFrame, path: str) -> None:
    """Write the trial starts in ``trials`` again, in a dataset of :func:`write_cohort`; all others' files stay as they are."""
    rows = trials.hint("rebalance", "trial_start").write.mode("overwrite").option("partitionOverwriteMode", "dynamic")
    rows.partitionBy("trial_start").parquet(path)


def read_cohort(spark: SparkSession, path: str, columns: list[str] | None = None) -> DataFrame:
    df = spark.read.parquet(path)
    return strict_columns(df, columns) if columns else df


def read_glob(spark: SparkSession, pattern: str) -> DataFrame:
    """Many files written with differing columns, read as one table."""
    return spark.read.option("mergeSchema", "true").parquet(pattern)


def write_completed(completed: DataFrame, path: str) -> None:
    """All completed data sets, one partition folder per imputation."""
    completed.hint("rebalance", "imputation").write.mode("overwrite").partitionBy("imputation").parquet(path)


def refresh_completed(completed: DataFrame, path: str) -> None:
    """Write some completed data sets again; the other imputations' files stay as they are."""
    rows = completed.hint("rebalance", "imputation").write.mode("overwrite").option("partitionOverwriteMode", "dynamic")
    rows.partitionBy("imputation").parquet(path)


def read_completed(spark: SparkSession, path: str, columns: list[str] | None = None) -> DataFrame:
    """Completed data sets; an empty source is an error."""
    df = spark.read.parquet(path)
    df = strict_columns(df, ["imputation", *columns]) if columns else df
    if df.isEmpty():
        raise FileNotFoundError(f"no completed data sets in {path}")
    return df


def step_folder(spark: SparkSession, name: str) -> str:
    """A new folder that all executors share: below ``spark.checkpoint.dir``, a private one only on a local master."""
    base = spark.conf.get("spark.checkpoint.dir", None)
    if base is None:
        master = spark.sparkContext.master
        if not master.startswith("local") or master.startswith("local-cluster"):
            raise ValueError("set spark.checkpoint.dir to a folder that all executors share")
        return tempfile.mkdtemp(prefix=f"trialweave-{name}-")
    return f"{base.rstrip('/')}/trialweave-{name}-{uuid.uuid4().hex}"


def remove_folder(spark: SparkSession, folder: str) -> None:
    path = spark._jvm.org.apache.hadoop.fs.Path(folder)
    path.getFileSystem(spark._jsc.hadoopConfiguration()).delete(path, True)


class StepLog:
    """Small JSON files in ``folder/log``: one that heads a run, and one a step. Each is replaced as a whole."""

    def __init__(self, spark: SparkSession, folder: str):
        self.spark, self.folder = spark, f"{folder}/log"
        self.path = spark._jvm.org.apache.hadoop.fs.Path
        self.files = self.path(self.folder).getFileSystem(spark._jsc.hadoopConfiguration())

    def _put(self, name: str, entry: dict) -> None:
        new, place = self.path(f"{self.folder}/.{name}.new"), self.path(f"{self.folder}/{name}")
        out = self.files.create(new, True)
        out.write(bytearray(json.dumps(entry).encode()))
        out.close()
        self.files.delete(place, False)
        self.files.rename(new, place)

    def _all(self) -> dict[str, dict]:
        if not self.files.exists(self.path(self.folder)):
            return {}
        rows = self.spark.read.option("wholetext", True).text(self.folder).select("value", F.col("_metadata.file_name").alias("name")).collect()
        return {r.name: json.loads(r.value) for r in rows}

    def begin(self, entry: dict) -> None:
        self._put("head", entry)

    def write(self, step: int, entry: dict) -> None:
        self._put(f"step-{step:06d}", entry)

    def head(self) -> dict | None:
        return self._all().get("head")

    def entries(self) -> list[dict]:
        """The steps in order."""
        found = self._all()
        return [found[k] for k in sorted(found) if k.startswith("step-")]


def cut_lineage(df: DataFrame, folder: str, name: str) -> DataFrame:
    """``df`` as a written table, so what is built on it repeats no earlier step; a half-written one is replaced."""
    df.write.mode("overwrite").parquet(f"{folder}/{name}")
    return df.sparkSession.read.schema(df.schema).parquet(f"{folder}/{name}")
