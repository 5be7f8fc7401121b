"""Sources, projections, joins, aggregations, windows, unions and scalar functions."""

from __future__ import annotations

import uuid
from dataclasses import replace

from pyspark.sql import Window
from pyspark.sql import functions as F

from trialweave.catalog.base import (
    MEASURES, cohort, eligible_trials, followed, gappy, query, raw, scores, scratch, small_cohort,
)
from trialweave.functions.scalars import as_date, as_level, as_number, clip, expit, logit, one_of
from trialweave.operators import impute, prep
from trialweave.operators import trials as ops
from trialweave.operators.calendar import TrialCalendar
from trialweave.operators.exposure import exposure_bits
from trialweave.operators.measures import latest_in_window, measure_slots, measures_in_window
from trialweave.operators.ordering import exact_quantiles
from trialweave.operators.panel import gender_flag
from trialweave.plans.cohort import build_trials
from trialweave.sources import storage
from trialweave.sources import testtables as tt
from trialweave.study import AnalysisSpec, DRUGS, MEASURE_FILES, TEXT_MEASURES, TRIMS

CAL = TrialCalendar(tt.SPEC)
KEYS = ["patid", "trial_start"]

# ---- sources and sinks ------------------------------------------------------------------


@query("s1_patient_scan", "select * from patients")
def _(spark, d):
    path, df = f"{scratch(spark)}/patients.parquet", tt.patients(spark, d)
    df.write.parquet(path)
    return storage.read_table(spark, path, df.schema)


@query(
    "s2_measure_union",
    "select patid, eventdate, event_id, measure_name, value_num, value_str from meas",
    doubles="value_num",
)
def _(spark, d):
    """One file per measure, each with its own value column, read as one long table."""
    folder, m = scratch(spark), tt.measurements(spark, d).persist()
    for name, (file, column) in MEASURE_FILES.items():
        value = F.col("value_str" if name in TEXT_MEASURES else "value_num").alias(column)
        m.filter(F.col("measure_name") == name).select("patid", "eventdate", "event_id", value).write.parquet(f"{folder}/{file}.parquet")
    m.unpersist()
    return storage.read_measurements(spark, folder)


@query("s3_drug_union", "select patid, eventdate, med_name from rx")
def _(spark, d):
    folder, r = scratch(spark), tt.prescriptions(spark, d).persist()
    for x in DRUGS:
        r.filter(F.col("med_name") == x).select("patid", "eventdate").write.parquet(f"{folder}/{x}.parquet")
    r.unpersist()
    return storage.read_prescriptions(spark, folder)


@query(
    "s4_glob_scan",
    """select trial_start, count(*) as n, count(case when month(trial_start) <> 1 then hypertension_history end) as with_history
    from arms group by trial_start""",
)
def _(spark, d):
    path, df = scratch(spark), small_cohort(spark, d).persist()
    january = F.month("trial_start") == 1
    df.filter(january).drop("hypertension_history").write.mode("overwrite").parquet(f"{path}/month_a.parquet")
    df.filter(~january).write.mode("overwrite").parquet(f"{path}/month_b.parquet")
    return (
        storage.read_glob(spark, f"{path}/month_*.parquet")
        .groupBy("trial_start")
        .agg(F.count(F.lit(1)).alias("n"), F.count("hypertension_history").alias("with_history"))
    )


@query(
    "s5_strict_columns",
    "select patid, trial_start, treatment, all_cause_mortality_2y from arms",
    ints="treatment all_cause_mortality_2y",
)
def _(spark, d):
    return prep.strict_columns(
        small_cohort(spark, d), [*KEYS, "treatment", "all_cause_mortality_2y", "patid", "treatment"]
    )


@query(
    "s6_completed_sets",
    "select imputation, count(*) as n, cast(sum(treatment) as bigint) as treated from scores group by imputation",
    ints="imputation",
)
def _(spark, d):
    path = scratch(spark)
    storage.write_completed(scores(spark, d), path)
    return (
        storage.read_completed(spark, path, ["patid", "trial_start", "treatment"])
        .groupBy("imputation")
        .agg(F.count(F.lit(1)).alias("n"), F.sum("treatment").alias("treated"))
    )


@query(
    "s7_partitioned_sink",
    "select trial_start, count(*) as n, count(distinct patid) as patients from arms group by trial_start",
)
def _(spark, d):
    """One month is first written with half of its patients, then again as a whole; the others are written once."""
    path, month = scratch(spark), F.col("trial_start") == F.lit("1996-07-01").cast("date")
    trials = small_cohort(spark, d).persist()
    storage.write_cohort(trials.filter(~month | (F.col("patid") % 2 == 0)), path)
    storage.refresh_trials(trials.filter(month), path)
    trials.unpersist()
    return (
        storage.read_cohort(spark, path)
        .groupBy("trial_start")
        .agg(F.count(F.lit(1)).alias("n"), F.countDistinct("patid").alias("patients"))
    )


@query(
    "s8_one_trial_of_the_cohort",
    "select patid, trial_start, treatment from arms where trial_start = date '1996-07-01'",
    ints="treatment",
)
def _(spark, d):
    path = scratch(spark)
    storage.write_cohort(small_cohort(spark, d), path)
    return storage.read_cohort(spark, path, [*KEYS, "treatment"]).filter(F.col("trial_start") == F.lit("1996-07-01").cast("date"))


@query("s9_completed_sink", "select imputation, patid, trial_start from scores", ints="imputation")
def _(spark, d):
    path = scratch(spark)
    storage.write_completed(scores(spark, d), path)
    return storage.read_completed(spark, path, KEYS)


# ---- projections, filters, predicates ---------------------------------------------------


@query(
    "p1_trial_dates",
    """select patid, trial_start, enrollment_end, end_followup_date_2y, end_followup_date_5y,
      cast(trial_start - interval 12 month as date) as washout_start, cast(enrollment_end - interval 24 month as date) as lookback_start
    from pt""",
)
def _(spark, d):
    return eligible_trials(spark, d).select(
        *KEYS, "enrollment_end", "end_followup_date_2y", "end_followup_date_5y",
        F.add_months("trial_start", -12).alias("washout_start"), F.add_months("enrollment_end", -24).alias("lookback_start"),
    )


@query("p2_year_differences", "select patid, trial_start, age_at_trial, years_since_reg from pt", ints="age_at_trial years_since_reg")
def _(spark, d):
    return eligible_trials(spark, d).select(*KEYS, "age_at_trial", "years_since_reg")


@query(
    "p3_months_since_diagnosis",
    """select patid, trial_start, (year(trial_start) - year(HF_date)) * 12 + month(trial_start) - month(HF_date)
      + (day(trial_start) - day(HF_date)) / 31.0::double as months_since_hf from pt""",
    doubles="months_since_hf",
)
def _(spark, d):
    return eligible_trials(spark, d).select(*KEYS, "months_since_hf")


@query(
    "p4_subtype_filter",
    f"""select wanted, hf_type, patid, trial_start from (
      select wanted, p.*, cal.* from patients p, cal, (values ('HFrEF'), ('all')) v(wanted)
      where (wanted = 'all' or hf_type = wanted) and year(trial_start) - year(dob) between 35 and 85
        and year(trial_start) - year(startdate) >= 2 and HF_date <= trial_start and enddate > trial_start)""",
)
def _(spark, d):
    people = ops.with_ages(ops.expand(tt.patients(spark, d), CAL))
    kept = [ops.eligible(people, replace(tt.SPEC, subtype=x)).withColumn("wanted", F.lit(x)) for x in ("HFrEF", "all")]
    return storage.union_all(kept).select("wanted", "hf_type", *KEYS)


@query("p5_eligibility", "select patid, trial_start from pt")
def _(spark, d):
    return eligible_trials(spark, d).select(*KEYS)


@query(
    "p6_lookback_predicate",
    """select eventdate, count(*) as n from rx where eventdate >= date '1996-01-01' and eventdate < date '1997-01-01'
    group by eventdate""",
)
def _(spark, d):
    from datetime import date

    from trialweave.study import CohortSpec

    one = TrialCalendar(CohortSpec(start=date(1997, 1, 1), months=1, baseline="trial_start", measure_lookback=12))
    lo, hi = one.windows[0]["drugs"].lo, one.windows[0]["drugs"].hi
    slot = one.slot(F.col("eventdate"))
    rows = tt.prescriptions(spark, d).filter(one.covers(F.col("eventdate"))).filter((slot >= lo) & (slot < hi))
    return rows.groupBy("eventdate").agg(F.count(F.lit(1)).alias("n"))


@query(
    "p7_history_flags",
    "select patid, trial_start, hypertension_history, diabetes_history from arms",
    ints="hypertension_history diabetes_history",
)
def _(spark, d):
    df = small_cohort(spark, d)
    return df.select(*KEYS, *[c for c in df.columns if c.endswith("_history")])


@query(
    "p8_outcome_flags",
    "select patid, trial_start, all_cause_mortality_2y, all_cause_mortality_5y from arms",
    ints="all_cause_mortality_2y all_cause_mortality_5y",
)
def _(spark, d):
    return small_cohort(spark, d).select(*KEYS, "all_cause_mortality_2y", "all_cause_mortality_5y")


@query("p9_arm_labels", "select treatment, count(*) as n from arms group by treatment", ints="treatment")
def _(spark, d):
    return small_cohort(spark, d).groupBy("treatment").agg(F.count(F.lit(1)).alias("n"))


@query(
    "p10_fill_flags",
    "select patid, trial_start, BB, ACE, CCB, digoxin from drugs",
    ints="BB ACE CCB digoxin",
)
def _(spark, d):
    return small_cohort(spark, d).select(*KEYS, "BB", "ACE", "CCB", "digoxin")


@query("p11_drop_helpers", "select patid, trial_start, enddate, dod from nu")
def _(spark, d):
    df = eligible_trials(spark, d, washout=True)
    return df.drop(*[c for c in df.columns if c not in (*KEYS, "enddate", "dod")], "not_there")


@query(
    "p12_coerce",
    """select o_orderkey, try_cast(o_orderstatus as double) as status_number,
      try_cast(left(o_orderpriority, 1) as double) as priority_number, try_cast(o_orderpriority as date) as priority_date,
      case when o_orderkey % 3 <> 0 then cast(o_orderdate as date) end as order_date
    from orders""",
    doubles="status_number priority_number",
)
def _(spark, d):
    o = spark.read.parquet(f"{d}/orders.parquet")
    return o.select(
        "o_orderkey", as_number(F.col("o_orderstatus")).alias("status_number"),
        as_number(F.substring("o_orderpriority", 1, 1)).alias("priority_number"),
        as_date(F.col("o_orderpriority")).alias("priority_date"),
        as_date(F.when(F.col("o_orderkey") % 3 != 0, F.col("o_orderdate").cast("date").cast("string")).otherwise("unknown")).alias("order_date"),
    )


@query("p13_missing_as_level", "select coalesce(smoke, 'nan') as smoke, count(*) as n from cohort group by 1")
def _(spark, d):
    return cohort(spark, d).groupBy(as_level(F.col("smoke")).alias("smoke")).agg(F.count(F.lit(1)).alias("n"))


@query(
    "p14_factor_levels",
    """select 'region' as name, region as level, count(*) as n from gappy group by region
    union all select 'gender', gender, count(*) from gappy group by gender
    union all select 'treatment', cast(treatment as varchar), count(*) from gappy group by treatment""",
)
def _(spark, d):
    return impute.level_counts(gappy(spark, d), ["region", "gender", "treatment"])


@query("p15_positive_followup", "select patid, trial_start, time_to_event from followed", ints="time_to_event")
def _(spark, d):
    return followed(spark, d).select(*KEYS, "time_to_event")


@query(
    "p16_complete_cases",
    "select patid, trial_start, bmi, sbp, smoke from cohort where bmi is not null and sbp is not null and smoke is not null",
    doubles="bmi sbp",
)
def _(spark, d):
    df = cohort(spark, d).select(*KEYS, "dod", "bmi", "sbp", "smoke").drop("dod")
    return prep.complete_cases(df, ["trial_start"])


@query(
    "p17_feature_list",
    f"""select feature, count(*) as n from (select unnest(['bmi', 'sbp', 'dbp', 'creatinine', 'tchdl_rat',
      {', '.join(repr(c) for c in AnalysisSpec().flags)}]) as feature from filled
      where date_diff('day', trial_start, least(end_followup_date_2y, enddate, dod)) > 0) group by feature""",
)
def _(spark, d):
    from trialweave.catalog.base import filled

    spec = AnalysisSpec(categorical=())
    df = prep.with_followup(prep.strict_columns(filled(spark, d), ["imputation", *spec.columns]), spec).drop(*spec.dates)
    names = prep.features(df, spec)
    counts = df.agg(*[F.count(c).alias(c) for c in names])
    return counts.unpivot([], names, "feature", "n")


@query("p18_default_columns", "select patid, trial_start, hypertension_history + 0 as flag, 0.5::double as age_minmax from arms", doubles="age_minmax", ints="flag")
def _(spark, d):
    df = prep.with_defaults(small_cohort(spark, d), {"thyroid_disorders_history": 0, "age_minmax": 0.5})
    return df.select(*KEYS, (F.col("hypertension_history") + F.col("thyroid_disorders_history")).alias("flag"), "age_minmax")


@query("p19_arm_split", "select patid, trial_start from arms where treatment = 1")
def _(spark, d):
    return small_cohort(spark, d).filter(F.col("treatment") == 1).select(*KEYS)


# ---- trials -------------------------------------------------------------------------------


@query(
    "t1_calendar",
    "select trial_start, enrollment_end, count(*) as registered from cal join patients on startdate <= trial_start group by all",
)
def _(spark, d):
    rows = ops.expand(tt.patients(spark, d).select("startdate"), CAL)
    return rows.filter(F.col("startdate") <= F.col("trial_start")).groupBy("trial_start", "enrollment_end").agg(F.count(F.lit(1)).alias("registered"))


@query("t2_expand", "select patid, trial_start, end_followup_date_5y from patients, cal")
def _(spark, d):
    return ops.expand(tt.patients(spark, d), CAL).select(*KEYS, "end_followup_date_5y")


_COHORT = """select patid, gender, gen_ethnicity_mapped, region, imd2015_5, dob, startdate, enddate, HF_date, hf_type, dod, trial_start,
      enrollment_end, age_at_trial, years_since_reg, end_followup_date_2y, end_followup_date_5y, hypertension_history,
      diabetes_history, bmi, sbp, dbp, creatinine, tchdl_rat, smoke, BB, ACE, ARB, Diuretics, CCB, statin, digoxin,
      anticoagulant, antiplatelet, treatment, all_cause_mortality_2y, all_cause_mortality_5y from cohort"""
_COHORT_TYPES = {
    "doubles": "bmi sbp dbp creatinine tchdl_rat",
    "ints": "age_at_trial years_since_reg hypertension_history diabetes_history BB ACE ARB Diuretics CCB statin digoxin "
    "anticoagulant antiplatelet treatment all_cause_mortality_2y all_cause_mortality_5y",
}


@query("t3_whole_cohort", _COHORT, **_COHORT_TYPES)
def _(spark, d):
    return cohort(spark, d).drop("months_since_hf")


def by_patient(spark, d, buckets=16):
    """Patients, measurements and prescriptions as tables dealt by patient."""
    folder = scratch(spark)
    name = f"raw_{uuid.uuid4().hex}"
    return [storage.write_by_patient(df, f"{name}_{i}", f"{folder}/{i}", buckets) for i, df in enumerate(raw(spark, d))]


@query("t4_cohort_of_bucketed_tables", _COHORT, **_COHORT_TYPES)
def _(spark, d):
    """The same cohort from tables dealt by patient: nothing is exchanged by patient."""
    return build_trials(*by_patient(spark, d), tt.SPEC).drop("months_since_hf")


# ---- joins ----------------------------------------------------------------------------------


@query(
    "j1_measures_in_window",
    """select nu.patid, trial_start, measure_name, count(*) as n from nu join meas on nu.patid = meas.patid
      and eventdate >= enrollment_end - interval 24 month and eventdate < enrollment_end group by all""",
    ints="n",
)
def _(spark, d):
    return measures_in_window(tt.measurements(spark, d), eligible_trials(spark, d, washout=True), CAL)


@query(
    "j2_drugs_in_window",
    """select distinct nu.patid, trial_start, med_name from nu join rx on nu.patid = rx.patid
      and eventdate >= enrollment_end - interval 12 month and eventdate < enrollment_end""",
)
def _(spark, d):
    df = small_cohort(spark, d)
    used = F.filter(F.array(*[F.when(F.col(x) == 1, F.lit(x)) for x in DRUGS]), lambda x: x.isNotNull())
    return df.select(*KEYS, F.explode(used).alias("med_name"))


@query("j3_washout_anti", "select patid, trial_start from nu")
def _(spark, d):
    return eligible_trials(spark, d, washout=True).select(*KEYS)


@query("j4_arm_semi", "select patid, trial_start from arms where treatment = 1")
def _(spark, d):
    df = eligible_trials(spark, d, washout=True)
    return df.filter(ops.arm(CAL) == 1).select(*KEYS)


@query("j5_control_anti", "select patid, trial_start from arms where treatment = 0")
def _(spark, d):
    df = eligible_trials(spark, d, washout=True)
    return df.filter(ops.arm(CAL) == 0).select(*KEYS)


@query("j6_attach_covariates", "select patid, trial_start, bmi, smoke, ACE, statin from cohort", doubles="bmi", ints="ACE statin")
def _(spark, d):
    return cohort(spark, d).select(*KEYS, "bmi", "smoke", "ACE", "statin")


@query(
    "j7_latest_measure",
    "select patid, trial_start, measure_name, value_num, value_str from latest",
    doubles="value_num",
)
def _(spark, d):
    rows = eligible_trials(spark, d, washout=True, measurements=tt.measurements(spark, d))
    cells = F.array(
        *[
            F.when(
                F.col(f"{m}.slot").between(F.col("measures_lo"), F.col("measures_hi") - 1),
                F.struct(
                    F.lit(m).alias("measure_name"),
                    (latest_in_window(m) if m not in TEXT_MEASURES else F.lit(None)).cast("double").alias("value_num"),
                    (latest_in_window(m) if m in TEXT_MEASURES else F.lit(None)).cast("string").alias("value_str"),
                ),
            )
            for m in MEASURES
        ]
    )
    return rows.select(*KEYS, F.inline(F.filter(cells, lambda c: c.isNotNull())))


# ---- aggregations -----------------------------------------------------------------------------


@query("a1_distinct_use", "select distinct patid, med_name from rx where eventdate >= date '1995-02-01' and eventdate < date '1998-01-01'")
def _(spark, d):
    cal = TrialCalendar(tt.SPEC)
    first, last = cal.windows[0]["drugs"].lo, cal.windows[-1]["drugs"].hi
    bits = exposure_bits(tt.prescriptions(spark, d), cal, list(DRUGS))
    mask = sum(1 << i for i in range(first, last))
    used = F.filter(
        F.array(*[F.expr(f"case when `__bits_{x}_0` & {mask}L != 0 then '{x}' end") for x in DRUGS]), lambda x: x.isNotNull()
    )
    return bits.select("patid", F.explode(used).alias("med_name"))


@query("a2_drug_pivot", f"select patid, trial_start, {', '.join(DRUGS)} from drugs", ints=" ".join(DRUGS))
def _(spark, d):
    return small_cohort(spark, d).select(*KEYS, *DRUGS)


@query(
    "a3_measure_pivot",
    "select patid, trial_start, bmi, sbp, dbp, creatinine, tchdl_rat, smoke from cohort",
    doubles="bmi sbp dbp creatinine tchdl_rat",
)
def _(spark, d):
    return cohort(spark, d).select(*KEYS, *MEASURES)


@query("a4_drug_vocabulary", "select distinct med_name from rx")
def _(spark, d):
    return tt.prescriptions(spark, d).select("med_name").distinct()


@query(
    "a5_prevalence",
    "select imputation, avg(treatment) as treated, avg(outcome) as events, avg(time) as mean_time from scores group by imputation",
    doubles="treated events mean_time", ints="imputation",
)
def _(spark, d):
    return scores(spark, d).groupBy("imputation").agg(
        F.avg("treatment").alias("treated"), F.avg("outcome").alias("events"), F.avg("time").alias("mean_time")
    )


@query(
    "a6_quantiles",
    f"""select imputation, treatment, unnest({list(TRIMS)!r})::double as prob, unnest(quantile_cont(ps, {list(TRIMS)!r})) as value
    from scores group by imputation, treatment""",
    doubles="prob value", ints="imputation treatment",
)
def _(spark, d):
    return exact_quantiles(scores(spark, d), ["imputation", "treatment"], "ps", list(TRIMS))


@query(
    "a7_missing_counts",
    "select * from (" + " union all ".join(
        f"select '{c}' as column_name, count(*) - count({c}) as n_missing from gappy" for c in ("gender", "region", "dod", *MEASURES)
    ) + ") where n_missing > 0",
    ints="n_missing",
)
def _(spark, d):
    return impute.missing_profile(gappy(spark, d), ["gender", "region", "dod", *MEASURES])


@query(
    "a8_guards",
    """select trial_start, case when sum(treatment) = 0 then 'empty arm' when sum(1 - treatment) = 0 then 'empty arm'
      when count(*) < 10 then 'too few rows' else 'ok' end as status from followed group by trial_start""",
)
def _(spark, d):
    t = F.sum("treatment")
    n = F.count(F.lit(1))
    status = F.when((t == 0) | (t == n), "empty arm").when(n < 10, "too few rows").otherwise("ok")
    return followed(spark, d).groupBy("trial_start").agg(status.alias("status"))


@query(
    "a9_moments",
    "select imputation, avg(ps) as mean, var_samp(ps) as variance, stddev_samp(ps) as sd from scores group by imputation",
    doubles="mean variance sd", ints="imputation",
)
def _(spark, d):
    return scores(spark, d).groupBy("imputation").agg(
        F.avg("ps").alias("mean"), F.var_samp("ps").alias("variance"), F.stddev_samp("ps").alias("sd")
    )


@query("a10_min_max", "select min(age_at_trial) as lo, max(age_at_trial) as hi from pt", ints="lo hi")
def _(spark, d):
    return eligible_trials(spark, d).agg(F.min("age_at_trial").alias("lo"), F.max("age_at_trial").alias("hi"))


@query(
    "a11_flag_sum",
    "select patid, trial_start, hypertension_history + diabetes_history + ACE + ARB + statin as flags from cohort",
    ints="flags",
)
def _(spark, d):
    cols = ["hypertension_history", "diabetes_history", "ACE", "ARB", "statin"]
    return small_cohort(spark, d).select(*KEYS, ops.row_sum([F.col(c) for c in cols]).alias("flags"))


# ---- window, top-1, unions ---------------------------------------------------------------------


@query(
    "w1_last_per_month",
    """select patid, measure_name, slot, eventdate, event_id, value_num, value_str from (
      select *, (year(eventdate) - 1994) * 12 + month(eventdate) - 2 as slot, row_number() over (
        partition by patid, measure_name, year(eventdate), month(eventdate)
        order by eventdate desc, event_id desc, value_num desc nulls last, value_str desc nulls last) as rn
      from meas where eventdate >= date '1994-02-01' and eventdate < date '1998-01-01')
    where rn = 1""",
    doubles="value_num", ints="slot",
)
def _(spark, d):
    slots = measure_slots(tt.measurements(spark, d), CAL)
    value = lambda m, text: (F.col(f"{m}.value") if text == (m in TEXT_MEASURES) else F.lit(None)).cast("string" if text else "double")
    cells = F.array(
        *[
            F.when(F.col(m).isNotNull(), F.struct(
                F.lit(m).alias("measure_name"), f"{m}.eventdate", f"{m}.event_id", value(m, False).alias("value_num"), value(m, True).alias("value_str"),
            ))
            for m in MEASURES
        ]
    )
    return slots.select("patid", "slot", F.inline(F.filter(cells, lambda c: c.isNotNull())))


@query(
    "l1_top_one",
    """select patid, med_name, eventdate, event_id from (select *, row_number() over (
      partition by patid, med_name order by eventdate desc, event_id desc) as rn from rx) where rn = 1""",
)
def _(spark, d):
    # max over a struct reduces map-side, unlike a row number over the whole group
    best = F.max(F.struct("eventdate", "event_id")).alias("best")
    return tt.prescriptions(spark, d).groupBy("patid", "med_name").agg(best).select("patid", "med_name", "best.*")


@query(
    "u1_union_by_name",
    """select patid, eventdate, med_name as label from rx union all select patid, eventdate, measure_name from meas""",
)
def _(spark, d):
    _, m, r = raw(spark, d)
    return r.select("patid", "eventdate", F.col("med_name").alias("label")).unionByName(
        m.select(F.col("measure_name").alias("label"), "eventdate", "patid")
    )


@query("u2_arms_union", "select patid, trial_start, treatment from arms", ints="treatment")
def _(spark, d):
    rows = small_cohort(spark, d).select(*KEYS, "treatment")
    treated, controls = rows.filter("treatment = 1"), rows.filter("treatment = 0")
    return treated.unionByName(controls.select("treatment", *KEYS))


@query(
    "u4_stacked_trials",
    "select trial_start, count(*) as n, cast(sum(treatment) as bigint) as treated from arms group by trial_start",
)
def _(spark, d):
    return small_cohort(spark, d).groupBy("trial_start").agg(F.count(F.lit(1)).alias("n"), F.sum("treatment").alias("treated"))


# ---- scalar functions -----------------------------------------------------------------------------


@query(
    "f1_date_functions",
    """select o_orderkey, cast(o_orderdate as date) as day, cast(cast(o_orderdate as date) + interval 1 month as date) as next_month,
      year(o_orderdate) as year from orders""",
    ints="year",
)
def _(spark, d):
    day = F.to_date("o_orderdate")
    return spark.read.parquet(f"{d}/orders.parquet").select(
        "o_orderkey", day.alias("day"), F.add_months(day, 1).alias("next_month"), F.year(day).alias("year")
    )


@query(
    "f2_conditionals",
    """select patid, trial_start, case when age_at_trial between 50 and 70 and dod is null then 'middle' when age_at_trial < 50
      then 'young' else 'other' end as band from pt""",
)
def _(spark, d):
    middle = F.col("age_at_trial").between(50, 70) & F.col("dod").isNull()
    band = F.when(middle, F.lit("middle")).when(F.col("age_at_trial") < 50, "young").otherwise("other")
    return eligible_trials(spark, d).select(*KEYS, band.alias("band"))


@query("f3_least_date", "select patid, trial_start, least(end_followup_date_2y, enddate, dod) as end_date from arms")
def _(spark, d):
    return small_cohort(spark, d).select(*KEYS, F.least("end_followup_date_2y", "enddate", "dod").alias("end_date"))


@query("f4_day_difference", "select patid, trial_start, date_diff('day', trial_start, enddate) as days from arms", ints="days")
def _(spark, d):
    return small_cohort(spark, d).select(*KEYS, F.datediff("enddate", "trial_start").alias("days"))


@query("f5_exp_log", "select l_orderkey, l_linenumber, exp(l_discount) as e, ln(l_extendedprice) as l from lineitem", doubles="e l", ints="l_linenumber")
def _(spark, d):
    return spark.read.parquet(f"{d}/lineitem.parquet").select(
        "l_orderkey", "l_linenumber", F.exp("l_discount").alias("e"), F.log("l_extendedprice").alias("l")
    )


@query(
    "f6_logit_expit",
    "select patid, trial_start, ln(ps / (1 - ps)) as a, 1 / (1 + exp(-q0)) as b from scores",
    doubles="a b",
)
def _(spark, d):
    return scores(spark, d).select(*KEYS, logit(F.col("ps")).alias("a"), expit(F.col("q0")).alias("b"))


@query("f7_clip", "select patid, trial_start, greatest(0.1, least(0.4, ps)) as ps from scores", doubles="ps")
def _(spark, d):
    return scores(spark, d).select(*KEYS, clip(F.col("ps"), 0.1, 0.4).alias("ps"))


@query("f8_two_way_choice", "select patid, trial_start, case when treatment = 1 then 1 / ps else 1 / (1 - ps) end as w from scores", doubles="w")
def _(spark, d):
    w = F.when(F.col("treatment") == 1, F.lit(1.0) / F.col("ps")).otherwise(F.lit(1.0) / (F.lit(1.0) - F.col("ps")))
    return scores(spark, d).select(*KEYS, w.alias("w"))


@query("f9_label_flag", "select patid, cast(lower(gender) in ('male', '1') as bigint) as male from patients", ints="male")
def _(spark, d):
    return tt.patients(spark, d).select("patid", one_of(F.col("gender"), "male", "1").alias("male"))


@query("f10_distance", "select patid, trial_start, cast(abs(q0 - ps) <= 0.05 as bigint) as near from scores", ints="near")
def _(spark, d):
    return scores(spark, d).select(*KEYS, (F.abs(F.col("q0") - F.col("ps")) <= 0.05).cast("int").alias("near"))
