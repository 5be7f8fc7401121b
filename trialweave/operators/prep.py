"""From a completed cohort to an analysis matrix."""

from __future__ import annotations

from pyspark import StorageLevel
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from trialweave.functions.scalars import as_date, as_level, as_number
from trialweave.study import AnalysisSpec


def _sql_name(name: str) -> str:
    return "`" + name.replace("`", "``") + "`"


def quoted(name: str) -> Column:
    return F.col(_sql_name(name))


def strict_columns(df: DataFrame, columns: list[str]) -> DataFrame:
    """Exactly these columns, each once; an unknown name is an analysis error."""
    return df.select(*[quoted(c) for c in dict.fromkeys(columns)])


def with_defaults(df: DataFrame, defaults: dict[str, object]) -> DataFrame:
    """Add absent columns with a constant."""
    return df.withColumns({c: F.lit(v) for c, v in defaults.items() if c not in df.columns})


def with_followup(df: DataFrame, spec: AnalysisSpec = AnalysisSpec(), event_rule: str = "flag") -> DataFrame:
    """Days from trial start to the earliest end date; rows without follow-up are dropped.

    ``event_rule="observed"`` counts the event only when death ends the follow-up.
    """
    df = df.withColumns({d: as_date(F.col(d)) for d in (*spec.dates, "trial_start")})
    end = F.least("end_followup_date_2y", "enddate", "dod")
    df = df.withColumn(spec.time, F.datediff(end, F.col("trial_start"))).filter(F.col(spec.time) > 0)
    df = df.withColumns(
        {
            spec.treatment: as_number(F.col(spec.treatment)).cast("int"),
            spec.outcome: F.coalesce(as_number(F.col(spec.outcome)).cast("int"), F.lit(0)),
        }
    )
    if event_rule == "observed":
        seen = (F.col(spec.outcome) == 1) & (F.col("dod") <= F.least("end_followup_date_2y", "enddate"))
        df = df.withColumn(spec.outcome, F.coalesce(seen, F.lit(False)).cast("int"))
    elif event_rule != "flag":
        raise ValueError(f"unknown event rule {event_rule!r}")
    return df


def levels(df: DataFrame, columns: list[str]) -> dict[str, list[str]]:
    """Sorted levels of each category. One job; its result is as long as the list of dummy columns."""
    if not columns:
        return {}
    pairs = F.array(*[F.struct(F.lit(c).alias("name"), as_level(F.col(c)).alias("level")) for c in columns])
    rows = df.select(F.inline(pairs)).distinct().collect()
    return {c: sorted(r.level for r in rows if r.name == c) for c in columns}


def one_hot(df: DataFrame, levels_by_column: dict[str, list[str]]) -> DataFrame:
    """0/1 columns ``<column>_<level>`` for all levels but the alphabetically first."""
    out = {}
    for c, ls in levels_by_column.items():
        for level in ls[1:]:
            out[f"{c}_{level}"] = (as_level(F.col(c)) == level).cast("int")
    return df.select("*", *[e.alias(n) for n, e in out.items()]).drop(*levels_by_column)


def complete_cases(df: DataFrame, ignore: list[str]) -> DataFrame:
    """Rows without a missing value outside the ignored columns."""
    return df.filter(" and ".join(f"{_sql_name(c)} is not null" for c in df.columns if c not in ignore))


def features(df: DataFrame, spec: AnalysisSpec = AnalysisSpec(), group: str = "imputation") -> list[str]:
    """Model inputs: all columns that are not keys, arm, outcome or time."""
    out = {spec.treatment, spec.outcome, spec.time, group, *spec.core}
    return [c for c in df.columns if c not in out]


def analysis_frame(completed: DataFrame, spec: AnalysisSpec = AnalysisSpec(), event_rule: str = "flag") -> DataFrame:
    """Follow-up, one-hot categories and complete cases.

    Dates are dropped before the complete-case filter, so survivors (no death date) stay;
    ``trial_start`` is kept as part of the row key. The rows are kept as they are before anything is derived from them:
    levels, moments and each pass of a fit read these narrow columns instead of the input's plan.
    """
    keys = [c for c in ("imputation",) if c in completed.columns]
    df = with_followup(strict_columns(completed, [*keys, *spec.columns]), spec, event_rule).drop(*spec.dates)
    df = df.persist(StorageLevel.MEMORY_AND_DISK)
    df = one_hot(df, levels(df, list(spec.categorical)))
    return complete_cases(df, ["trial_start"])


def moments(df: DataFrame, columns: list[str], groups: list[str]) -> DataFrame:
    """Mean and population SD (0 becomes 1) of each column per group, as two arrays."""
    names = [_sql_name(c) for c in columns]
    sd = ", ".join(f"if(stddev_pop({c}) > 0, stddev_pop({c}), 1D)" for c in names)
    return df.groupBy(*groups).agg(
        F.expr(f"array({', '.join(f'avg({c})' for c in names)}) as mean"), F.expr(f"array({sd}) as sd")
    )


def known_moments(df: DataFrame, columns: list[str], groups: list[str]) -> DataFrame:
    """:func:`moments`, computed once: one row per group (imputation)."""
    m = moments(df, columns, groups)
    return df.sparkSession.createDataFrame(m.collect(), m.schema)


def standardised(df: DataFrame, columns: list[str], groups: list[str], out: str = "x", scale: DataFrame | None = None) -> DataFrame:
    """Add an array of the columns scaled by group mean and population SD.

    Means travel as a broadcast table with one row per group (imputation); ``scale`` are those of :func:`known_moments`.
    """
    m = scale if scale is not None else known_moments(df, columns, groups)
    m = m.withColumnsRenamed({"mean": "__mean", "sd": "__sd"})
    # Loops over arrays: a term for each feature would be more code than the JVM compiles.
    plain = f"array({', '.join(f'cast({_sql_name(c)} as double)' for c in columns)})"
    scaled = f"zip_with(zip_with({plain}, __mean, (a, b) -> a - b), __sd, (a, b) -> a / b)"
    return df.join(F.broadcast(m), groups).withColumn(out, F.expr(scaled)).drop("__mean", "__sd")
