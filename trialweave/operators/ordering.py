"""Work that needs a total order of scores, without sorting a group in one task.

Scores are cut into buckets at their approximate quantiles, so no bucket holds much more
than its share. A value so frequent that it fills whole quantiles gets a bucket of its own,
which is then spread over many sub-buckets by a tie-break number. Each bucket is sorted on
its own and what crosses bucket borders travels in a small border table whose size depends
on the number of buckets, never on the data.
"""

from __future__ import annotations

import math
from collections import Counter

from pyspark.ml.feature import Bucketizer
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import Window

ROWS_PER_BUCKET = 20_000
#: Up to so many buckets are cut at one level.
FEW_BUCKETS = 64


def with_buckets(df: DataFrame, score: str, tiebreak: str | None = None, rows_per_bucket: int = ROWS_PER_BUCKET, rows: int | None = None) -> DataFrame:
    """Add ``__bucket`` and ``__sub``; (bucket, sub) order agrees with (score, tiebreak) order.

    The number of buckets follows from the number of rows, counted unless the caller knows it. A value that fills several quantiles has as many
    sub-buckets, so there are at most twice as many places as buckets.

    Cuts come in two levels. The coarse ones, as many as the square root of the buckets, are quantiles of a sketch of that
    size and the only ones in the plan; each coarse range then has its own sketch, made in parallel, whose cuts are a
    table of one row per range. So no sketch and no literal grows faster than the square root of the rows.
    """
    buckets = max(1, -(-(df.count() if rows is None else rows) // rows_per_bucket))
    coarse = buckets if buckets <= FEW_BUCKETS else math.isqrt(buckets - 1) + 1
    fine = -(-buckets // coarse)
    probs = [i / coarse for i in range(1, coarse)]
    cuts = (df.agg(F.percentile_approx(score, probs, 10 * coarse)).first()[0] or []) if probs else []
    hot = {v: n + 1 for v, n in Counter(cuts).items() if n > 1}
    inner = sorted({*cuts, *(math.nextafter(v, math.inf) for v in hot)})
    if not inner:
        return df.withColumns({"__bucket": F.lit(0).cast("long"), "__sub": F.lit(0)})
    splits = [-math.inf, *inner, math.inf]
    out = Bucketizer(splits=splits, inputCol=score, outputCol="__bucket").transform(df)
    out = out.withColumn("__bucket", F.col("__bucket").cast("long"))
    # How many places a single frequent value is worth; other ranges count 1.
    parts = F.get(F.lit([hot.get(v, 1) * (fine if v in hot else 1) for v in splits]), F.col("__bucket").cast("int"))
    if fine > 1:
        probs = [i / fine for i in range(1, fine)]
        ranges = out.groupBy("__bucket").agg(F.percentile_approx(score, probs, 10 * fine).alias("__cuts"))
        out = out.join(ranges, "__bucket")
        out = out.withColumn("__below", _cuts_before(score, "<", fine))
        # Few rows are equal to a cut, and only they need the second search.
        tied = F.get("__cuts", F.col("__below")) == F.col(score)
        out = out.withColumn("__upto", F.when(tied, _cuts_before(score, "<=", fine)).otherwise(F.col("__below")))
        # Rows equal to a cut lie between those below and those above it.
        equal = F.col("__upto") > F.col("__below")
        place = F.col("__bucket") * F.lit(1 << 32) + F.col("__upto") * 2 + F.when(equal, 0).otherwise(1)
        parts = F.greatest(parts, F.when(equal, F.col("__upto") - F.col("__below") + 1).otherwise(1))
        out = out.withColumns({"__parts": parts, "__bucket": place}).drop("__cuts", "__below", "__upto")
        parts = F.col("__parts")
    elif not hot:
        return out.withColumn("__sub", F.lit(0))
    sub = F.lit(0) if tiebreak is None else F.floor(F.col(tiebreak) * parts).cast("int")
    return out.withColumn("__sub", sub).drop("__parts")


def _cuts_before(score: str, sign: str, fine: int) -> Column:
    """How many of the sorted ``__cuts``, fewer than ``fine``, lie before the score, by halving."""
    steps = ", ".join(map(str, range(fine.bit_length())))
    return F.expr(
        f"aggregate(array({steps}), struct(0 as lo, size(__cuts) as hi), (a, i) -> if(a.lo >= a.hi, a, "
        f"if(__cuts[(a.lo + a.hi) div 2] {sign} `{score}`, struct(cast((a.lo + a.hi) div 2 + 1 as int) as lo, a.hi as hi), "
        f"struct(a.lo as lo, cast((a.lo + a.hi) div 2 as int) as hi))), a -> a.lo)"
    )


def sorted_neighbours(
    df: DataFrame, groups: list[str], score: str, donor: str, tiebreak: str, k: int, rows_per_bucket: int = ROWS_PER_BUCKET,
    rows: int | None = None,
) -> DataFrame:
    """For every non-donor row, its k nearest donors below and above in score order.

    ``donor`` names a struct column that is NULL on the rows asking. Adds arrays ``below``
    (scores up to and including the row's own, nearest first, unless the tie-break puts the
    donor later) and ``above``; each element is ``struct(score, donor)``.
    """
    place = [*groups, "__bucket", "__sub"]
    df = df.withColumn("__d", F.when(F.col(donor).isNotNull(), F.struct(F.col(score).alias("score"), F.col(donor).alias("donor"))))
    df = with_buckets(df, score, tiebreak, rows_per_bucket, rows)

    def shifted(fn: str, by: str, order: str) -> Column:
        over = f"over (partition by {by} order by {order})"
        return F.filter(
            F.array(*[F.expr(f"{fn}(__d, {i}) ignore nulls {over}") for i in range(1, k + 1)]),
            lambda x: x.isNotNull(),
        )

    by = ", ".join(f"`{c}`" for c in place)
    order = f"`{score}`, `{tiebreak}`"
    rows = df.select(
        "*",
        shifted("lag", by, order).alias("below"),
        shifted("lead", by, order).alias("above"),
        F.row_number().over(Window.partitionBy(*place).orderBy(score, tiebreak)).alias("__nth"),
    )

    edge = F.col("__d").isNotNull() & ((F.size("below") < k) | (F.size("above") < k))
    marks = F.array(
        *[
            F.struct(F.lit(pos).alias("pos"), (d if d is not None else F.lit(None)).alias("d"), keep.alias("keep"))
            for pos, d, keep in (
                (0, F.when(F.lit(False), F.col("__d")), F.col("__nth") == 1),
                (1, F.col("__d"), edge),
                (2, F.when(F.lit(False), F.col("__d")), F.col("__nth") == 1),
            )
        ]
    )
    border = (
        rows.filter((F.col("__nth") == 1) | edge)
        .select(*place, F.col(score).alias("__s"), F.col(tiebreak).alias("__t"), F.inline(marks))
        .filter("keep")
        .withColumnRenamed("d", "__d")
    )
    group_by = ", ".join(f"`{c}`" for c in groups) or "1"
    border_order = "__bucket, __sub, pos, __s, __t"
    halo = (
        border.select(
            *place,
            "pos",
            shifted("lag", group_by, border_order).alias("lag"),
            shifted("lead", group_by, border_order).alias("lead"),
        )
        .filter(F.col("pos") != 1)
        .groupBy(*place)
        .agg(
            F.first(F.when(F.col("pos") == 0, F.col("lag")), ignorenulls=True).alias("__before"),
            F.first(F.when(F.col("pos") == 2, F.col("lead")), ignorenulls=True).alias("__after"),
        )
    )
    # One row per group and place; whether that is few enough to be broadcast is decided by its size when it runs.
    return (
        rows.filter(F.col("__d").isNull())
        .join(halo, place, "left")
        .withColumns(
            {
                "below": F.slice(F.concat("below", F.coalesce("__before", F.array())), 1, k),
                "above": F.slice(F.concat("above", F.coalesce("__after", F.array())), 1, k),
            }
        )
        .drop("__d", "__bucket", "__sub", "__nth", "__before", "__after", donor)
    )


def exact_quantiles(
    df: DataFrame, groups: list[str], score: str, probs: list[float], rows_per_bucket: int = ROWS_PER_BUCKET
) -> DataFrame:
    """Exact quantiles with linear interpolation per group: ``groups, prob, value``.

    Bucket counts tell which buckets hold the wanted ranks; only those buckets are then
    reduced to distinct values and ordered.
    """
    rows = with_buckets(df.select(*groups, score).filter(F.col(score).isNotNull()), score, None, rows_per_bucket).drop("__sub")
    running = Window.partitionBy(*groups).orderBy("__bucket").rowsBetween(Window.unboundedPreceding, 0)
    counts = rows.groupBy(*groups, "__bucket").agg(F.count(F.lit(1)).alias("__n"))
    counts = counts.select(
        *groups,
        "__bucket",
        "__n",
        (F.sum("__n").over(running) - F.col("__n")).alias("__start"),
        F.sum("__n").over(Window.partitionBy(*groups)).alias("__total"),
    )
    rank = F.col("prob") * (F.col("__total") - 1)
    ends = F.array(
        F.struct(F.lit("lo").alias("end"), F.floor("__h").alias("rank")),
        F.struct(F.lit("hi").alias("end"), F.ceil("__h").alias("rank")),
    )
    wanted = (
        counts.select("*", F.explode(F.array(*[F.lit(float(p)) for p in probs])).alias("prob"))
        .withColumn("__h", rank)
        .select("*", F.inline(ends))
        .filter((F.col("rank") >= F.col("__start")) & (F.col("rank") < F.col("__start") + F.col("__n")))
        .select(*groups, "__bucket", "prob", "__h", "end", "rank", "__start")
    )
    place = [*groups, "__bucket"]
    # At most two rows per group and probability: safe to broadcast.
    values = (
        rows.join(F.broadcast(wanted.select(*place).distinct()), place, "left_semi")
        .groupBy(*place, score)
        .agg(F.count(F.lit(1)).alias("__c"))
    )
    upto = F.sum("__c").over(Window.partitionBy(*place).orderBy(score).rowsBetween(Window.unboundedPreceding, 0))
    picked = (
        values.withColumn("__upto", upto)
        .join(F.broadcast(wanted), place)
        .filter(
            (F.col("rank") - F.col("__start") < F.col("__upto"))
            & (F.col("rank") - F.col("__start") >= F.col("__upto") - F.col("__c"))
        )
    )
    lo = F.max(F.when(F.col("end") == "lo", F.col(score)))
    hi = F.max(F.when(F.col("end") == "hi", F.col(score)))
    frac = F.max(F.col("__h") - F.floor("__h"))
    return picked.groupBy(*groups, "prob").agg((lo + (hi - lo) * frac).alias("value"))


def numbered(
    df: DataFrame, groups: list[str], hashed: Column, name: str, rows_per_bucket: int = ROWS_PER_BUCKET, rows: int | None = None
) -> DataFrame:
    """Number the rows of each group 1, 2, ... in hash order, exactly and in parallel.

    Hash ranges are even by construction and as many as the rows need; their start numbers come from a table of one row
    per group and range. The rows are counted unless the caller knows their number.
    """
    bits = min(62, max(1, math.ceil(math.log2(max(1, (df.count() if rows is None else rows) / rows_per_bucket))) + 1))
    df = df.withColumn("__hash", hashed).withColumn("__range", F.shiftrightunsigned("__hash", 64 - bits))
    place = [*groups, "__range"]
    starts = df.groupBy(*place).agg(F.count(F.lit(1)).alias("__n"))
    before = Window.partitionBy(*groups).orderBy("__range").rowsBetween(Window.unboundedPreceding, -1)
    starts = starts.select(*place, F.coalesce(F.sum("__n").over(before), F.lit(0)).alias("__start"))
    nth = F.row_number().over(Window.partitionBy(*place).orderBy("__hash"))
    # An explicit partition count serves the window and keeps later per-row work spread out,
    # where adaptive coalescing would pack small rows into few tasks.
    parts = int(df.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    return (
        df.join(starts, place)
        .repartition(parts, *place)
        .withColumn(name, nth + F.col("__start"))
        .drop("__hash", "__range", "__start")
    )
