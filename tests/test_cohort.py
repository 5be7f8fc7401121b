"""Cohort semantics on small hand-made records and against date arithmetic."""

from datetime import date, timedelta

import pytest
from pyspark.sql import functions as F

from trialweave.catalog.base import raw
from trialweave.catalog.cohort_queries import by_patient
from trialweave.operators.calendar import TrialCalendar, add_months
from trialweave.plans.cohort import build_trials
from trialweave.sources import testtables as tt
from trialweave.study import CohortSpec

SF_DIR = "/root/testdata/sf0.001"

PATIENT = "patid long, dob date, startdate date, enddate date, HF_date date, hf_type string, dod date, stroke_date date"
MEASURE = "patid long, eventdate date, measure_name string, value_num double, value_str string"


def one_patient(spark, dod=None, stroke=None, hf=date(2000, 1, 1)):
    row = (1, date(1950, 5, 1), date(1990, 1, 1), date(2020, 1, 1), hf, "HFrEF", dod, stroke)
    return spark.createDataFrame([row], PATIENT)


def build(spark, patients, measures=(), rx=(), **spec):
    spec = CohortSpec(**{"start": date(2010, 1, 1), "months": 6, **spec})
    rx = spark.createDataFrame(list(rx), "patid long, eventdate date, med_name string")
    m = spark.createDataFrame(list(measures), MEASURE)
    return build_trials(patients, m, rx, spec).orderBy("trial_start").collect()


def test_washout_arm_and_fixed_schema(spark):
    rows = build(spark, one_patient(spark), rx=[(1, date(2010, 3, 31), "BB")])
    assert [(r.trial_start.month, r.treatment, r.BB) for r in rows] == [(1, 0, 0), (2, 0, 0), (3, 1, 1)]
    assert {r.CCB for r in rows} == {0} and {r.bmi for r in rows} == {None}


def test_latest_measure_ties_nulls_and_window(spark):
    rows = build(
        spark, one_patient(spark),
        [
            (1, date(2009, 1, 5), "bmi", 20.0, None), (1, date(2010, 1, 31), "bmi", 21.0, None),
            (1, date(2010, 1, 31), "bmi", 22.0, None), (1, date(2010, 4, 2), "bmi", None, None),
            (1, date(2008, 4, 10), "sbp", 100.0, None), (1, date(2010, 2, 1), "smoke", None, "Ex-smoker"),
        ],
    )
    assert [r.bmi for r in rows] == [22.0, 22.0, 22.0, None, None, None]
    assert [r.sbp for r in rows] == [100.0, 100.0, 100.0, None, None, None]
    assert [r.smoke for r in rows] == [None] + ["Ex-smoker"] * 5


def test_outcomes_and_history(spark):
    rows = build(spark, one_patient(spark, dod=date(2012, 3, 1), stroke=date(2010, 3, 1)))
    assert [r.all_cause_mortality_2y for r in rows] == [0, 0, 1, 1, 1, 1]
    assert [r.stroke_history for r in rows] == [0, 1, 1, 1, 1, 1]
    assert build(spark, one_patient(spark, hf=None)) == []


def test_separate_treatment_table_equals_default(spark):
    rx = spark.createDataFrame(
        [(1, date(2010, 2, 3), "BB"), (1, date(2010, 2, 4), "ACE")], "patid long, eventdate date, med_name string"
    )
    spec = CohortSpec(months=4)
    a = build_trials(one_patient(spark), None, rx, spec)
    b = build_trials(one_patient(spark), None, rx, spec, treatment=rx.filter("med_name = 'BB'"))
    assert sorted(map(str, a.collect())) == sorted(map(str, b.collect()))


@pytest.mark.parametrize("baseline", ["enrollment_end", "trial_start"])
def test_irregular_starts_equal_date_windows(spark, baseline):
    starts = (date(2010, 1, 31), date(2010, 2, 14), date(2010, 6, 3), date(2011, 3, 31))
    spec = CohortSpec(starts=starts, baseline=baseline)
    cal = TrialCalendar(spec)
    assert not cal.monthly
    days = [date(2007, 12, 1) + timedelta(days=i) for i in range(0, 1300, 3)]
    df = spark.createDataFrame([(d,) for d in days], "eventdate date").filter(cal.covers(F.col("eventdate")))
    slot = {r.eventdate: r.slot for r in df.withColumn("slot", cal.slot(F.col("eventdate"))).collect()}
    for s, w in zip(cal.starts, cal.windows):
        for name, (a, b) in cal.bounds(s).items():
            for d in days:
                assert (d in slot and w[name].lo <= slot[d] < w[name].hi) == (a <= d < b)


def test_many_months_need_several_words(spark):
    rows = build(spark, one_patient(spark), rx=[(1, date(2016, 5, 9), "BB")], months=84)
    assert TrialCalendar(CohortSpec(months=84)).words == 2
    treated = [r.trial_start for r in rows if r.treatment]
    assert treated == [date(2016, 5, 1)] and rows[-1].trial_start == date(2016, 5, 1)


def test_add_months_clips():
    assert add_months(date(2011, 1, 31), 1) == date(2011, 2, 28)
    assert add_months(date(2012, 3, 31), -1) == date(2012, 2, 29)


def test_tables_dealt_by_patient_are_not_exchanged(spark):
    """No exchange by patient in the whole cohort plan, also where no side is small enough to be broadcast."""
    old = spark.conf.get("spark.sql.autoBroadcastJoinThreshold")
    try:
        tables = by_patient(spark, SF_DIR)
        spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
        dealt = build_trials(*tables, tt.SPEC)
        plan = dealt._jdf.queryExecution().executedPlan().toString()
        assert "Exchange" not in plan and "SortMergeJoin" in plan
        plain = build_trials(*raw(spark, SF_DIR), tt.SPEC)
        assert "hashpartitioning(patid" in plain._jdf.queryExecution().executedPlan().toString()
        assert dealt.exceptAll(plain).isEmpty() and dealt.count() == plain.count()
    finally:
        spark.conf.set("spark.sql.autoBroadcastJoinThreshold", old)
