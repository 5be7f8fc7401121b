"""Scores and person-period rows for checking estimators against a known hazard."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from trialweave.functions.scalars import clip, one_of
from trialweave.operators.prep import quoted, with_defaults
from trialweave.operators.trials import row_sum
from trialweave.study import SCORE_CONDITIONS

# Default hazard parameters and clips.
BASE_HAZARD = 0.0001
DECAY = 0.25
EFFECT = -0.5
TIME_FACTOR = 1.01
PERIODS = 24
HAZARD_MIN, HAZARD_MAX = 1e-8, 1.0
SCORE_THRESHOLD = 2


def comorbidity_score(df: DataFrame, conditions: tuple[str, ...] = SCORE_CONDITIONS) -> DataFrame:
    """Add ``Zstar``: 1 when more than two of the flags are set; an absent flag counts 0."""
    df = with_defaults(df, {c: 0 for c in conditions})
    return df.withColumn("Zstar", (row_sum([quoted(c) for c in conditions]) > SCORE_THRESHOLD).cast("int"))


def min_max(df: DataFrame, column: str, out: str, default: float = 0.5) -> DataFrame:
    """Scale a column to [0, 1] over the whole table; NULL when it does not vary."""
    if column not in df.columns:
        return df.withColumn(out, F.lit(default))
    ends = df.agg(F.struct(F.min(column).cast("double").alias("lo"), F.max(column).cast("double").alias("hi")).alias("e"))
    e = ends.scalar()
    return df.withColumn(out, F.try_divide(F.col(column) - e["lo"], e["hi"] - e["lo"]))


def gender_flag(df: DataFrame) -> DataFrame:
    """Text is compared with the male labels; numbers are kept as they are."""
    text = df.schema["gender"].dataType.simpleString() == "string"
    return df.withColumn("gender_numeric", one_of(F.col("gender"), "male", "1") if text else F.col("gender").cast("int"))


def person_periods(df: DataFrame, beta: dict[str, float], treatment: str, periods: int = PERIODS) -> DataFrame:
    """One row per person-trial and period ``t`` with its hazard under the given coefficients."""
    t = F.col("t").cast("double")
    linear: Column = F.lit(0.0)
    for name, b in beta.items():
        linear = linear + F.lit(float(b)) * quoted(name)
    hazard = (
        F.lit(BASE_HAZARD)
        * F.exp(-F.lit(DECAY) * t)
        * F.exp(F.lit(EFFECT) * F.col(treatment))
        * F.exp(linear)
        * F.exp(F.log(F.lit(TIME_FACTOR)) * t * F.col("Zstar"))
    )
    return df.withColumn("t", F.explode(F.sequence(F.lit(1), F.lit(periods)))).withColumn(
        "hazard", clip(hazard, HAZARD_MIN, HAZARD_MAX)
    )


def first_event(periods: DataFrame, keys: list[str], event: Column, censored: Column, last: int = PERIODS) -> DataFrame:
    """First period with an event or censoring; censoring is tested first within a period.

    Period and kind are packed into one integer, so this is a plain hash aggregate.
    """
    code = F.when(censored, F.col("t") * 2).when(event, F.col("t") * 2 + 1)
    return (
        periods.groupBy(*keys)
        .agg(F.min(code).alias("__code"))
        .select(
            *keys,
            F.coalesce(F.floor(F.col("__code") / 2), F.lit(last)).cast("int").alias("time"),
            F.coalesce(F.col("__code") % 2, F.lit(0)).cast("int").alias("label"),
        )
    )
