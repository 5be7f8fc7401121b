"""Person-trial rows: expansion, eligibility, arms, histories and outcomes."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from trialweave.operators.calendar import TrialCalendar, add_months
from trialweave.operators.exposure import STUDY_DRUG, exposed
from trialweave.study import CohortSpec, slug


def candidates(patients: DataFrame, cal: TrialCalendar) -> DataFrame:
    """Patients who can be eligible in some trial.

    Implied by the per-trial rule, but stated on plain columns so that it reaches the
    Parquet scan and cuts the rows that are shuffled and expanded.
    """
    s, first, last = cal.spec, cal.starts[0], cal.starts[-1]
    year = lambda y: F.to_date(F.lit(f"{y:04d}-01-01"))
    keep = (
        (F.col("enddate") > F.lit(first))
        & (F.col("HF_date") < F.lit(add_months(last, 1)))
        & (F.col("dob") >= year(first.year - s.age_max))
        & (F.col("dob") < year(last.year - s.age_min + 1))
        & (F.col("startdate") < year(last.year - s.min_years_registered + 1))
    )
    if s.subtype != "all":
        keep = keep & (F.col("hf_type") == s.subtype)
    return patients.filter(keep)


def expand(patients: DataFrame, cal: TrialCalendar) -> DataFrame:
    """One row per patient and trial.

    When a measure timeline is attached (``first_trial``, ``trial_count``), each of its rows
    yields the run of trials it serves; patients without one yield all trials.
    """
    trials = cal.trials()
    if "first_trial" in patients.columns:
        trials = F.slice(
            trials, F.coalesce("first_trial", F.lit(0)) + 1, F.coalesce("trial_count", F.lit(len(cal.starts)))
        )
    rest = [c for c in patients.columns if c not in ("first_trial", "trial_count")]
    return patients.select(*rest, F.inline(trials))


def with_ages(trials: DataFrame) -> DataFrame:
    """Calendar-year differences and months since diagnosis at trial start."""
    return trials.withColumns(
        {
            "age_at_trial": F.year("trial_start") - F.year("dob"),
            "years_since_reg": F.year("trial_start") - F.year("startdate"),
            "months_since_hf": F.months_between("trial_start", "HF_date"),
        }
    )


def eligible(trials: DataFrame, spec: CohortSpec) -> DataFrame:
    """Rows meeting every criterion at trial start; a missing date fails its criterion."""
    keep = (
        F.col("age_at_trial").between(spec.age_min, spec.age_max)
        & (F.col("years_since_reg") >= spec.min_years_registered)
        & (F.col("months_since_hf") >= 0)
        & (F.col("enddate") > F.col("trial_start"))
    )
    if spec.subtype != "all":
        keep = keep & (F.col("hf_type") == spec.subtype)
    return trials.filter(keep)


def new_users(trials: DataFrame, cal: TrialCalendar) -> DataFrame:
    """Drop rows with the study drug in the washout window."""
    return trials.filter(~exposed(STUDY_DRUG, "washout", cal))


def history_flags(df: DataFrame, conditions: tuple[str, ...], baseline: str) -> dict[str, Column]:
    """Flag columns for the conditions whose date column is present."""
    present = [slug(c) for c in conditions if f"{slug(c)}_date" in df.columns]
    return {
        f"{c}_history": F.when(F.col(f"{c}_date") <= F.col(baseline), 1).otherwise(0) for c in present
    }


def drug_flags(cal: TrialCalendar) -> dict[str, Column]:
    """0/1 per drug of the vocabulary; a drug nobody used is a column of zeros."""
    return {d: exposed(d, "drugs", cal).cast("int") for d in cal.spec.drugs}


def arm(cal: TrialCalendar) -> Column:
    """1 when the study drug was prescribed during the enrolment month."""
    return exposed(STUDY_DRUG, "arm", cal).cast("int")


def death_by(limit: str) -> Column:
    return F.when(F.col("dod") <= F.col(limit), 1).otherwise(0)


def row_sum(cols: list[Column]) -> Column:
    return reduce(Column.__add__, cols, F.lit(0))
