"""Names, vocabularies and default parameters shared by every stage."""

from __future__ import annotations

from dataclasses import dataclass, field
from datetime import date

# Vocabularies and defaults that decide column names and results.
CONDITIONS = (
    "hypertension",
    "diabetes",
    "ischaemic heart disease",
    "atrial fibrillation",
    "stroke",
    "dyslipidaemia",
    "asthma",
    "peripheral arterial disease",
    "valve disorders",
    "infective endocarditis",
    "thyroid disorders",
    "chronic kidney disease",
    "pulmonary embolism",
    "malignant cancer",
    "chronic obstructive pulmonary disease",
)
NUMERIC_MEASURES = ("bmi", "sbp", "dbp", "creatinine", "tchdl_rat")
TEXT_MEASURES = ("smoke",)
MEASURE_FILES = {
    "bmi": ("bmi", "bmi"),
    "sbp": ("systolic", "sbp"),
    "dbp": ("diastolic", "dbp"),
    "creatinine": ("creatinine", "creatinine"),
    "tchdl_rat": ("tchdl_rat", "tchdl_rat"),
    "smoke": ("smoke", "smoking_status"),
}
DRUGS = ("BB", "ACE", "ARB", "Diuretics", "CCB", "statin", "digoxin", "anticoagulant", "antiplatelet")
CORE = ("patid", "trial_start")
DATES = ("dod", "enddate", "end_followup_date_2y")
CATEGORICAL = ("gender", "gen_ethnicity_mapped", "region", "imd2015_5", "smoke")
HISTORY_COVARIATES = (
    "hypertension_history",
    "diabetes_history",
    "ischaemic_heart_disease_history",
    "atrial_fibrillation_history",
    "stroke_history",
    "dyslipidaemia_history",
    "asthma_history",
    "peripheral_arterial_disease_history",
    "valve_disorders_history",
    "chronic_kidney_disease_history",
    "pulmonary_embolism_history",
    "malignant_cancer_history",
)
DRUG_COVARIATES = ("ACE", "ARB", "Diuretics", "CCB", "statin", "digoxin", "anticoagulant", "antiplatelet")
SCORE_CONDITIONS = (
    "hypertension_history",
    "diabetes_history",
    "ischaemic_heart_disease_history",
    "thyroid_disorders_history",
    "chronic_obstructive_pulmonary_disease_history",
)
TRIMS = (0.01, 0.02, 0.03, 0.04, 0.05, 0.06, 0.07, 0.08, 0.09, 0.10)
TREATMENT = "treatment"
OUTCOME = "all_cause_mortality_2y"
TIME = "time_to_event"
KEY = ("patid", "trial_start")


def slug(condition: str) -> str:
    return condition.lower().replace(" ", "_")


@dataclass(frozen=True)
class CohortSpec:
    """Design of one sequence of trials.

    ``baseline`` is the date covariates are frozen at: the end of the enrolment
    month (default) or the trial start.
    """

    start: date = date(2010, 1, 1)
    months: int = 60
    drug: str = "BB"
    subtype: str = "HFrEF"
    drug_lookback: int = 12
    measure_lookback: int = 24
    washout: int = 12
    age_min: int = 35
    age_max: int = 85
    min_years_registered: int = 2
    baseline: str = "enrollment_end"
    conditions: tuple[str, ...] = CONDITIONS
    numeric_measures: tuple[str, ...] = NUMERIC_MEASURES
    text_measures: tuple[str, ...] = TEXT_MEASURES
    drugs: tuple[str, ...] = DRUGS
    starts: tuple[date, ...] | None = None  # explicit trial starts override start/months


@dataclass(frozen=True)
class AnalysisSpec:
    """Columns and tuning of the estimation stage."""

    treatment: str = TREATMENT
    outcome: str = OUTCOME
    time: str = TIME
    core: tuple[str, ...] = CORE
    dates: tuple[str, ...] = DATES
    categorical: tuple[str, ...] = CATEGORICAL
    numeric: tuple[str, ...] = NUMERIC_MEASURES
    flags: tuple[str, ...] = field(default=HISTORY_COVARIATES + DRUG_COVARIATES)
    caliper: float = 0.01
    trims: tuple[float, ...] = TRIMS
    folds: int = 5
    replicates: int = 200
    seed: int = 1234
    event_rule: str = "flag"

    @property
    def columns(self) -> list[str]:
        """Every column the analysis reads, each once."""
        return list(
            dict.fromkeys(
                (*self.core, *self.dates, *self.categorical, *self.numeric, *self.flags, self.treatment, self.outcome)
            )
        )
