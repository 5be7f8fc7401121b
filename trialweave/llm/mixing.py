"""Mix sources to target weights by pivotal dependent rounding of copy counts.

Every row of a source gets the source's copy rate, which splits into whole copies and a fraction. The
pivotal method settles fractions in pairs: words move at random from one row to the other until one of the
two fractions is 0 or 1, so a pair's expected words never change and its total words stay as they are. Each
bucket of rows leaves at most one open row; the open rows of neighbouring buckets are paired in the next
level of a reduction tree, until one per source is left. Buckets and all draws come from hashes of the row,
so neither partitioning nor retries change the result.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from trialweave.llm.shared import WORD, Steps

#: Weights of the sources in the order of their names, share of all words, largest copy rate.
WEIGHTS = (5, 2, 1)
SHARE = 1.5
MOST = 2.0
ROWS_PER_BUCKET = 4096
FANOUT = 64
_EPS = 1e-9


def words(text: str | Column = "text") -> Column:
    """Number of words; null has none."""
    return F.coalesce(F.regexp_count(F.col(text) if isinstance(text, str) else text, F.lit(WORD)), F.lit(0)).cast("long")


def targets(sizes: list[tuple[str | None, int]], weights=WEIGHTS, share: float = SHARE, most: float = MOST) -> dict:
    """Target words of each source (by code point, null last): weighted shares, capped, the excess shared again."""
    order = sorted(sizes, key=lambda r: (r[0] is None, (r[0] or "").encode()))
    size = {s: n for s, n in order}
    weight = {s: weights[i % len(weights)] for i, (s, _) in enumerate(order)}
    left, out, open_ = share * sum(size.values()), {}, [s for s, _ in order]
    while open_:
        total = sum(weight[s] for s in open_)
        over = [s for s in open_ if left * weight[s] / total > most * size[s]]
        if not over:
            out |= {s: left * weight[s] / total for s in open_}
            break
        for s in over:
            out[s] = most * size[s]
        left -= sum(out[s] for s in over)
        open_ = [s for s in open_ if s not in out]
    return out


def _pivot(size: np.ndarray, part: np.ndarray, draw: np.ndarray) -> tuple[np.ndarray, int]:
    """Settle fractions in order; returns 0/1 or the open fraction, and the open row (-1: none)."""
    out, held = part.copy(), -1
    for k in range(len(size)):
        if not _EPS < out[k] < 1 - _EPS:
            out[k] = round(out[k])
            continue
        if held < 0:
            held = k
            continue
        a, b = size[held] * 1.0, size[k] * 1.0
        # Words that may move from the held row to row k, and the other way round.
        there = min(out[held] * a, (1 - out[k]) * b)
        back = min((1 - out[held]) * a, out[k] * b)
        move = there if draw[k] * (there + back) < back else -back
        out[held] -= move / a
        out[k] += move / b
        settled = [not _EPS < out[x] < 1 - _EPS for x in (held, k)]
        for x, done in zip((held, k), settled, strict=True):
            if done:
                out[x] = round(out[x])
        held = -1 if all(settled) else k if settled[0] else held
    return out, held


def _settle(groups: list[str]) -> callable:
    """Over rows sorted by group and place: each group's fractions settled, all rows returned."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        rest = None
        for batch in batches:
            rest = batch if rest is None else pd.concat([rest, batch], ignore_index=True)
            if not len(rest):
                continue
            change = (rest[groups].ne(rest[groups].shift())).any(axis=1).to_numpy()
            cut = int(np.flatnonzero(change)[-1])  # the last group may go on in the next batch
            if cut:
                yield solve(rest.iloc[:cut], change[:cut])
                rest = rest.iloc[cut:].reset_index(drop=True)
        if rest is not None and len(rest):
            yield solve(rest, (rest[groups].ne(rest[groups].shift())).any(axis=1).to_numpy())

    def solve(rows: pd.DataFrame, change: np.ndarray) -> pd.DataFrame:
        size, part, draw = (rows[c].to_numpy(float) for c in ("size", "part", "draw"))
        part, at = part.copy(), [*np.flatnonzero(change), len(rows)]
        for i, j in zip(at, at[1:], strict=False):
            part[i:j], _ = _pivot(size[i:j], part[i:j], draw[i:j])
        return rows.assign(part=part)

    return run


def _unit(*values: Column | str) -> Column:
    """A number in [0, 1) from a hash."""
    return F.shiftrightunsigned(F.xxhash64(*values), 11).cast("double") / F.lit(float(1 << 53))


def plan_mix(
    docs: DataFrame, key: str = "doc_id", text: str = "text", source: str = "source", weights=WEIGHTS,
    share: float = SHARE, most: float = MOST, seed: int = 7, rows_per_bucket: int = ROWS_PER_BUCKET,
) -> DataFrame:
    """How often the mix takes each row: ``key, th, source, size, same, source_size, target, copies``.

    ``th`` is the hash of the text and ``same`` the number of equal rows, which are settled together. The total
    of ``size * copies`` over a source misses its target by less than one of its units. Null and empty texts have
    size 0 and no copies; a null source is a source of its own, last in order; a null key is a key like any
    other. An empty table gives no rows. A task holds one batch and one bucket of rows, whatever the source's
    share of the table; the driver sees one row per source, as the definition of the targets needs.
    """
    spark = docs.sparkSession
    steps = Steps(spark, "mix")
    sized = docs.select(F.col(key).alias(key), F.xxhash64(text).alias("th"), F.col(source).alias("source"), words(text).alias("size"))
    sized = steps.write(sized.groupBy(key, "th", "source", "size").agg(F.count(F.lit(1)).alias("same")))
    totals = sized.groupBy("source").agg(F.sum(F.col("size") * F.col("same")).alias("size"), F.count(F.lit(1)).alias("n")).collect()
    goal = targets([(r.source, r["size"]) for r in totals], weights, share, most)
    table = spark.createDataFrame(
        [(r.source, r["size"], float(goal[r.source]), -(-r.n // rows_per_bucket)) for r in totals],
        "s string, source_size long, target double, buckets long",
    )
    rate = F.when((F.col("size") > 0) & (F.col("source_size") > 0), F.col("target") / F.col("source_size")).otherwise(0.0)
    units = (
        sized.join(table, F.col("source").eqNullSafe(F.col("s")))
        .withColumns({"rate": rate, "place": F.xxhash64(F.lit(seed), key, "th", "source")})
        .select(
            key, "th", "source", F.col("size").alias("words"), "same", "source_size", "target", "place",
            (F.col("size") * F.col("same")).alias("size"), F.floor("rate").cast("int").alias("whole"),
            (F.col("rate") - F.floor("rate")).alias("part"),
            (F.shiftrightunsigned(F.xxhash64(F.lit(seed + 1), "place"), 11).cast("double") / F.lit(float(1 << 53))).alias("draw"),
            F.pmod(F.xxhash64(F.lit(seed + 2), "place"), F.col("buckets")).alias("bucket"),
        )
    )
    parts = max(int(spark.conf.get("spark.sql.shuffle.partitions")), spark.sparkContext.defaultParallelism)

    def level(rows: DataFrame) -> DataFrame:
        ordered = rows.repartition(parts, "source", "bucket").sortWithinPartitions("source", "bucket", "place", key, "th")
        return steps.write(ordered.mapInPandas(_settle(["source", "bucket"]), rows.schema))

    settled = level(units)
    is_open = (F.col("part") > 0) & (F.col("part") < 1)
    out, left = settled.filter(~is_open), settled.filter(is_open)
    top = max([-(-r.n // rows_per_bucket) for r in totals], default=1)
    while top > 1:
        top = -(-top // FANOUT)
        done = level(left.withColumn("bucket", F.floor(F.col("bucket") / FANOUT)))
        out, left = out.unionByName(done.filter(~is_open)), done.filter(is_open)
    # At most one open unit per source is left: its fraction is drawn.
    out = out.unionByName(left.withColumn("part", F.when(F.col("draw") < F.col("part"), 1.0).otherwise(0.0)))
    return out.select(
        key, "th", "source", F.col("words").alias("size"), "same", "source_size", "target",
        (F.col("whole") + F.col("part").cast("int")).alias("copies"),
    )


def mix(docs: DataFrame, key: str = "doc_id", text: str = "text", source: str = "source", **options) -> DataFrame:
    """The rows of the mix: each row of ``docs`` as often as the plan says, with all its columns and no others."""
    plan = plan_mix(docs, key, text, source, **options).filter("copies > 0")
    plan = plan.select(F.col(key).alias("__k"), F.col("th").alias("__th"), F.col("source").alias("__s"), F.col("copies").alias("__copies"))
    same = F.col(key).eqNullSafe(F.col("__k")) & F.col(source).eqNullSafe(F.col("__s")) & (F.xxhash64(text) == F.col("__th"))
    return docs.join(plan, same).withColumn("__nth", F.explode(F.sequence(F.lit(1), F.col("__copies")))).select(*[docs[c] for c in docs.columns])
