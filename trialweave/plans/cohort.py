"""The cohort plan: raw tables to one row per patient and trial.

One plan covers all trials. Exchanges: prescriptions once (after map-side reduction to one
row per patient), measurements twice (the second time already one row per patient and
slot), patients once. Nothing is exchanged after the expansion to trials.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from trialweave.operators import trials as ops
from trialweave.operators.calendar import TrialCalendar
from trialweave.operators.exposure import STUDY_DRUG, bits_name, exposure_bits
from trialweave.operators.measures import latest_in_window, measure_slots, measure_timeline
from trialweave.study import CohortSpec, slug


def person_trials(
    patients: DataFrame,
    prescriptions: DataFrame,
    spec: CohortSpec,
    *,
    treatment: DataFrame | None = None,
    measurements: DataFrame | None = None,
    drug_columns: bool = True,
    washout: bool = True,
) -> DataFrame:
    """Eligible person-trials with window helpers still attached."""
    cal = TrialCalendar(spec)
    drugs = list(spec.drugs) if drug_columns else []
    if treatment is None:
        wanted = list(dict.fromkeys([*drugs, spec.drug]))
        bits = exposure_bits(prescriptions, cal, wanted).withColumns(
            {bits_name(STUDY_DRUG, w): F.col(bits_name(spec.drug, w)) for w in range(cal.words)}
        )
    else:
        events = treatment.select("patid", "eventdate", F.lit(STUDY_DRUG).alias("med_name"))
        if drugs:
            events = events.unionByName(prescriptions.select("patid", "eventdate", "med_name"))
        bits = exposure_bits(events, cal, [*drugs, STUDY_DRUG])
    people = ops.candidates(patients, cal).join(bits, "patid", "left")
    if measurements is not None:
        people = people.join(measure_timeline(measure_slots(measurements, cal), cal), "patid", "left")
    rows = ops.eligible(ops.with_ages(ops.expand(people, cal)), spec)
    return ops.new_users(rows, cal) if washout else rows


def build_trials(
    patients: DataFrame,
    measurements: DataFrame | None,
    prescriptions: DataFrame,
    spec: CohortSpec = CohortSpec(),
    treatment: DataFrame | None = None,
) -> DataFrame:
    """The whole cohort with covariates, arm and outcomes.

    ``treatment`` defaults to the prescriptions of ``spec.drug``.
    """
    cal = TrialCalendar(spec)
    rows = person_trials(patients, prescriptions, spec, treatment=treatment, measurements=measurements)
    flags = ops.history_flags(rows, spec.conditions, spec.baseline)
    measures = [*spec.numeric_measures, *spec.text_measures] if measurements is not None else []
    condition_dates = {f"{slug(c)}_date" for c in spec.conditions}
    keep = [c for c in patients.columns if c not in condition_dates]
    return rows.select(
        *keep,
        "trial_start",
        "enrollment_end",
        "age_at_trial",
        "years_since_reg",
        "months_since_hf",
        "end_followup_date_2y",
        "end_followup_date_5y",
        *[c.alias(n) for n, c in flags.items()],
        *[latest_in_window(m).alias(m) for m in measures],
        *[c.alias(n) for n, c in ops.drug_flags(cal).items()],
        ops.arm(cal).alias("treatment"),
        ops.death_by("end_followup_date_2y").alias("all_cause_mortality_2y"),
        ops.death_by("end_followup_date_5y").alias("all_cause_mortality_5y"),
    )
