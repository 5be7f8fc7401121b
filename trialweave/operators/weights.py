"""Stabilised weights and asymmetric trimming."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from trialweave.operators.ordering import exact_quantiles


def stabilised_weights(df: DataFrame, groups: list[str], score: str = "ps", treatment: str = "treatment") -> DataFrame:
    """Weight ``p/ps`` for treated and ``(1-p)/(1-ps)`` for controls, p the group's prevalence."""
    share = df.groupBy(*groups).agg(F.avg(treatment).alias("__p"))
    w = F.when(F.col(treatment) == 1, F.col("__p") / F.col(score)).otherwise(
        (F.lit(1.0) - F.col("__p")) / (F.lit(1.0) - F.col(score))
    )
    return df.join(F.broadcast(share), groups).withColumn("w", w).drop("__p")


def trim_bounds(
    df: DataFrame, groups: list[str], trims: tuple[float, ...], score: str = "ps", treatment: str = "treatment"
) -> DataFrame:
    """Per group and trim level: lowest kept treated score, highest kept control score."""
    probs = sorted({p for t in trims for p in (t, 1.0 - t)})
    q = exact_quantiles(df, [*groups, treatment], score, probs)
    pairs = F.array(*[F.struct(F.lit(float(t)).alias("trim"), F.lit(1.0 - t).alias("__q")) for t in trims])
    treated, value = F.col(treatment) == 1, F.col("value")
    return (
        q.select("*", F.inline(pairs))
        .filter(F.col("prob") == F.when(treated, F.col("trim")).otherwise(F.col("__q")))
        .groupBy(*groups, "trim")
        .agg(F.max(F.when(treated, value)).alias("lower"), F.max(F.when(~treated, value)).alias("upper"))
    )


def trim_depth(
    df: DataFrame,
    bounds: DataFrame,
    groups: list[str],
    score: str = "ps",
    treatment: str = "treatment",
) -> DataFrame:
    """Add ``depth``: at how many trim levels (mildest first) the row is kept.

    Trimming is nested, so one number says which levels keep a row; rows need not be copied
    once per level. Rows kept nowhere are dropped.
    """
    per_group = bounds.groupBy(*groups).agg(
        F.sort_array(F.collect_list(F.struct("trim", "lower", "upper"))).alias("__b")  # one entry per level
    )
    kept = F.size(
        F.filter(
            "__b",
            lambda b: F.when(F.col(treatment) == 1, F.col(score) >= b["lower"]).otherwise(
                F.col(score) <= b["upper"]
            ),
        )
    )
    return df.join(F.broadcast(per_group), groups).withColumn("depth", kept).drop("__b").filter(F.col("depth") > 0)


def by_trim(reduced: DataFrame, groups: list[str], keys: list[str], sums: list[str], trims: tuple[float, ...]) -> DataFrame:
    """Turn sums per depth into sums per trim level: level j holds every depth above j."""
    levels = F.array(
        *[F.struct(F.lit(j).alias("__j"), F.lit(float(t)).alias("trim")) for j, t in enumerate(sorted(trims))]
    )
    return (
        reduced.select("*", F.inline(levels))
        .filter(F.col("depth") > F.col("__j"))
        .groupBy(*groups, "trim", *keys)
        .agg(*[F.sum(s).alias(s) for s in sums])
    )


def trimmed_rows(df: DataFrame, bounds: DataFrame, groups: list[str], trims: tuple[float, ...], score: str = "ps") -> DataFrame:
    """Rows kept at each trim level, one copy per level (for reports; estimators use depth)."""
    levels = F.array(*[F.lit(float(t)) for t in sorted(trims)])
    deep = trim_depth(df, bounds, groups, score)
    return deep.select("*", F.explode(F.slice(levels, F.lit(1), F.col("depth"))).alias("trim")).drop("depth")
