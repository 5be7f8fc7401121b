"""Prescriptions reduced to one row of slot bits per patient.

A patient's whole record of one drug is a bit set over the calendar's slots. ``bit_or`` is
a hash aggregate with a map-side part, so a patient holding most of all prescriptions sends
one row per map task; washout, arm and drug look-back are then bit tests on the patient's
own row, with no join at trial level.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from trialweave.operators.calendar import BITS_PER_WORD, TrialCalendar

STUDY_DRUG = "__study_drug"


def bits_name(drug: str, word: int) -> str:
    return f"__bits_{drug}_{word}"


def exposure_bits(prescriptions: DataFrame, cal: TrialCalendar, drugs: list[str]) -> DataFrame:
    """One row per patient: for each drug, the slots with at least one prescription."""
    slot = cal.slot(F.col("eventdate"))
    events = prescriptions.filter(cal.covers(F.col("eventdate")) & F.col("med_name").isin(*drugs)).select(
        "patid",
        "med_name",
        F.floor(slot / BITS_PER_WORD).cast("int").alias("word"),
        F.pmod(slot, F.lit(BITS_PER_WORD)).cast("int").alias("pos"),
    )
    return events.groupBy("patid").agg(
        *[
            F.expr(f"bit_or(case when med_name = '{d}' and word = {w} then shiftleft(1L, pos) end) as `{bits_name(d, w)}`")
            for d in drugs
            for w in range(cal.words)
        ]
    )


def exposed(drug: str, window: str, cal: TrialCalendar) -> Column:
    """Whether the drug was prescribed in a window of the current trial."""
    tests = [f"coalesce(`{bits_name(drug, w)}`, 0L) & {window}_mask_{w} != 0" for w in range(cal.words)]
    return F.expr(" or ".join(f"({t})" for t in tests))
