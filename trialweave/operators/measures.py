"""Latest measurement before baseline, without a range join.

Measurements are first reduced to the last one per patient, slot and measure. The as-of
lookup is then a running ``last`` over a patient's slots (at most one row per slot), and
each slot row answers for the trials whose baseline falls before the patient's next slot.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from trialweave.operators.calendar import TrialCalendar


def _value(measure: str, cal: TrialCalendar) -> str:
    return "value_str" if measure in cal.spec.text_measures else "value_num"


def measure_slots(measurements: DataFrame, cal: TrialCalendar) -> DataFrame:
    """Last measurement per patient and slot, one struct column per measure.

    Ties on the day are broken by event id, then by value. The value sits inside a struct,
    so a latest value that is NULL stays NULL instead of giving way to an older one.
    """
    measures = [*cal.spec.numeric_measures, *cal.spec.text_measures]
    if "event_id" not in measurements.columns:
        measurements = measurements.withColumn("event_id", F.lit(None).cast("long"))
    return (
        measurements.filter(cal.covers(F.col("eventdate")) & F.col("measure_name").isin(*measures))
        .groupBy("patid", cal.slot(F.col("eventdate")).alias("slot"))
        .agg(
            *[
                F.expr(
                    f"max(case when measure_name = '{m}' then "
                    f"struct(eventdate, event_id, {_value(m, cal)} as value) end) as `{m}`"
                )
                for m in measures
            ]
        )
    )


def measure_timeline(slots: DataFrame, cal: TrialCalendar) -> DataFrame:
    """Per patient and slot: latest value so far of each measure, and the trials it serves.

    ``first_trial`` (0-based) and ``trial_count`` give the run of trials whose measure
    window ends after this slot and not after the patient's next slot.
    """
    measures = [*cal.spec.numeric_measures, *cal.spec.text_measures]
    by_slot = Window.partitionBy("patid").orderBy("slot")
    so_far = by_slot.rowsBetween(Window.unboundedPreceding, Window.currentRow)
    stop = F.lit(len(cal.cuts) - 1)
    latest = [
        F.last(F.expr(f"case when `{m}` is not null then struct(slot, `{m}`.value) end"), ignorenulls=True)
        .over(so_far)
        .alias(m)
        for m in measures
    ]
    runs = slots.select(
        "patid",
        "slot",
        F.row_number().over(by_slot).alias("nth"),
        F.lead("slot").over(by_slot).alias("next_slot"),
        *latest,
    )
    first = F.when(F.col("nth") == 1, F.lit(0)).otherwise(cal.trials_before(F.col("slot")))
    return runs.select(
        "patid",
        first.alias("first_trial"),
        (cal.trials_before(F.coalesce("next_slot", stop)) - first).alias("trial_count"),
        *measures,
    ).filter(F.col("trial_count") > 0)


def latest_in_window(measure: str) -> Column:
    """The value of a running-latest struct if it lies inside the current trial's window."""
    return F.expr(
        f"case when `{measure}`.slot >= measures_lo and `{measure}`.slot < measures_hi then `{measure}`.value end"
    )


def measures_in_window(measurements: DataFrame, person_trials: DataFrame, cal: TrialCalendar) -> DataFrame:
    """How many measurements each person-trial has inside the look-back, by measure.

    Counts are reduced to one row per patient and measure, with a list as long as there are slots, and dealt by patient;
    a person-trial (with its window helpers) adds up the slots of its window, so nothing fans out or is
    sorted by trial.
    """
    spark = measurements.sparkSession
    parts = max(int(spark.conf.get("spark.sql.shuffle.partitions")), spark.sparkContext.defaultParallelism)
    counts = (
        measurements.filter(cal.covers(F.col("eventdate")))
        .groupBy("patid", "measure_name", cal.slot(F.col("eventdate")).alias("slot"))
        .agg(F.count(F.lit(1)).alias("n"))
        .repartition(parts, "patid")
        .groupBy("patid", "measure_name")
        .agg(F.collect_list(F.struct("slot", "n")).alias("counts"))
    )
    inside = "aggregate(counts, 0L, (a, c) -> if(c.slot >= measures_lo and c.slot < measures_hi, a + c.n, a))"
    rows = person_trials.select("patid", "trial_start", "measures_lo", "measures_hi").join(counts.hint("merge"), "patid")
    return rows.select("patid", "trial_start", "measure_name", F.expr(inside).alias("n")).filter("n > 0")
