"""Registry of checkable queries and the SQL they are checked against."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from trialweave.operators.prep import with_defaults, with_followup
from trialweave.plans.cohort import build_trials, person_trials
from trialweave.sources import testtables as tt
from trialweave.sources.storage import step_folder
from trialweave.study import HISTORY_COVARIATES, NUMERIC_MEASURES, TEXT_MEASURES

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLE: dict[str, str] = {}
IMPUTATIONS = 3


def query(name: str, sql: str | None = None, doubles: str = "", ints: str = ""):
    """Register a query; ``doubles`` are rounded and ``ints`` made 64-bit on both sides."""
    dbl, whole = doubles.split(), ints.split()

    def wrap(fn):
        def run(spark: SparkSession, sf_dir: str) -> DataFrame:
            df = fn(spark, sf_dir)
            return df.withColumns(
                {c: F.round(F.col(c).cast("double"), 6) + F.lit(0.0) for c in dbl}
                | {c: F.col(c).cast("long") for c in whole}
            )

        QUERIES[name] = run
        if sql is not None:
            parts = [f"round(cast({c} as double), 6) + 0.0 as {c}" for c in dbl]
            parts += [f"cast({c} as bigint) as {c}" for c in whole]
            replace = f" replace ({', '.join(parts)})" if parts else ""
            ORACLE[name] = f"with recursive {BASE}\nselect *{replace} from (\n{sql}\n)"
        return fn

    return wrap


def scratch(spark: SparkSession) -> str:
    """A new folder for a round trip, shared by all executors."""
    return step_folder(spark, "scratch")


# ---- Spark inputs -------------------------------------------------------------------


def raw(spark, d):
    return tt.patients(spark, d), tt.measurements(spark, d), tt.prescriptions(spark, d)


def eligible_trials(spark, d, washout=False, drug_columns=False, measurements=None):
    return person_trials(
        tt.patients(spark, d), tt.prescriptions(spark, d), tt.SPEC,
        drug_columns=drug_columns, washout=washout, measurements=measurements,
    )


def cohort(spark, d):
    p, m, r = raw(spark, d)
    return build_trials(p, m, r, tt.SPEC)


def small_cohort(spark, d):
    """The cohort without measurements."""
    return build_trials(tt.patients(spark, d), None, tt.prescriptions(spark, d), tt.SPEC)


def followed(spark, d):
    return with_followup(small_cohort(spark, d))


def scores(spark, d):
    """Analysis rows with fixed score columns standing in for fitted models."""
    df = followed(spark, d)
    k = F.expr("cast(year(trial_start) * 12 + month(trial_start) as bigint)")
    u = F.pmod(F.col("patid") * 7919 + k * 104729, F.lit(100003)).cast("double") / F.lit(100003.0)
    v = F.pmod(F.col("patid") * 31, F.lit(101)).cast("double") / F.lit(101.0)
    q0 = F.lit(0.05) + F.lit(0.3) * v
    return df.select(
        "patid", "trial_start", "treatment", F.col("all_cause_mortality_2y").alias("outcome"),
        F.col("time_to_event").alias("time"), (F.col("patid") % IMPUTATIONS + 1).cast("int").alias("imputation"),
        (F.lit(0.02) + F.lit(0.5) * u).alias("ps"), (F.lit(0.02) + F.lit(0.5) * u).alias("g"),
        q0.alias("q0"), (F.lit(0.9) * q0).alias("q1"),
    )


def gappy(spark, d):
    """The cohort in the layout of the imputation stage, with missing genders added."""
    df = with_defaults(cohort(spark, d), {h: 0 for h in HISTORY_COVARIATES})
    return df.withColumn("gender", F.when(F.col("patid") % 13 != 0, F.col("gender")))


def filled(spark, d):
    """A completed data set: measurements filled with constants."""
    return with_defaults(cohort(spark, d), {h: 0 for h in HISTORY_COVARIATES}).fillna(
        {"bmi": 28.0, "sbp": 130.0, "dbp": 80.0, "creatinine": 90.0, "tchdl_rat": 4.0, "smoke": "Non-smoker"}
    ).withColumn("imputation", (F.col("patid") % IMPUTATIONS + 1).cast("int"))


# ---- The same inputs in SQL -----------------------------------------------------------

_TABLES = {t: t for t in ("customer", "nation", "region", "orders", "lineitem")}
_DRUG_FLAGS = ",\n  ".join(
    f"cast(exists(select 1 from rx where rx.patid = nu.patid and med_name = '{x}' and eventdate >= enrollment_end - "
    f"interval 12 month and eventdate < enrollment_end) as bigint) as {x}"
    for x in tt.SPEC.drugs
)
_PIVOT = ",\n  ".join(
    [f"max(value_num) filter (where measure_name = '{m}') as {m}" for m in NUMERIC_MEASURES]
    + [f"max(value_str) filter (where measure_name = '{m}') as {m}" for m in TEXT_MEASURES]
)
_ABSENT = ", ".join(
    f"cast(0 as bigint) as {h}" for h in HISTORY_COVARIATES if h not in ("hypertension_history", "diabetes_history")
)
MEASURES = [*NUMERIC_MEASURES, *TEXT_MEASURES]
BASE = f"""
patients as ({tt.PATIENTS.format(**_TABLES)}),
rx as ({tt.PRESCRIPTIONS.format(**_TABLES)}),
meas as ({tt.MEASUREMENTS.format(**_TABLES)}),
cal as (
  select cast(s as date) as trial_start, cast(s + interval 1 month as date) as enrollment_end,
    cast(s + interval 24 month as date) as end_followup_date_2y, cast(s + interval 60 month as date) as end_followup_date_5y
  from generate_series(timestamp '1996-01-01', timestamp '1997-12-01', interval 1 month) t(s)),
pt as (
  select p.*, cal.*, year(trial_start) - year(dob) as age_at_trial, year(trial_start) - year(startdate) as years_since_reg
  from patients p, cal
  where hf_type = 'HFrEF' and year(trial_start) - year(dob) between 35 and 85
    and year(trial_start) - year(startdate) >= 2 and HF_date <= trial_start and enddate > trial_start),
nu as (
  select * from pt where not exists (
    select 1 from rx where rx.patid = pt.patid and med_name = 'BB'
      and eventdate >= trial_start - interval 12 month and eventdate < trial_start)),
arms as (
  select nu.*, cast(exists(
    select 1 from rx where rx.patid = nu.patid and med_name = 'BB' and eventdate >= trial_start and eventdate < enrollment_end
    ) as bigint) as treatment,
    cast(coalesce(dod <= end_followup_date_2y, false) as bigint) as all_cause_mortality_2y,
    cast(coalesce(dod <= end_followup_date_5y, false) as bigint) as all_cause_mortality_5y,
    cast(coalesce(hypertension_date <= enrollment_end, false) as bigint) as hypertension_history,
    cast(coalesce(diabetes_date <= enrollment_end, false) as bigint) as diabetes_history
  from nu),
latest as (
  select patid, trial_start, measure_name, value_num, value_str from (
    select nu.patid, trial_start, measure_name, value_num, value_str, row_number() over (
      partition by nu.patid, trial_start, measure_name
      order by eventdate desc, event_id desc, value_num desc nulls last, value_str desc nulls last) as rn
    from nu join meas on nu.patid = meas.patid and eventdate >= enrollment_end - interval 24 month and eventdate < enrollment_end)
  where rn = 1),
wide as (select patid, trial_start, {_PIVOT} from latest group by patid, trial_start),
drugs as (select patid, trial_start, {_DRUG_FLAGS} from nu),
cohort as (select arms.*, wide.* exclude (patid, trial_start), drugs.* exclude (patid, trial_start)
  from arms left join wide using (patid, trial_start) left join drugs using (patid, trial_start)),
gappy as (select * replace (case when patid % 13 <> 0 then gender end as gender), {_ABSENT} from cohort),
filled as (select * replace (coalesce(bmi, 28.0) as bmi, coalesce(sbp, 130.0) as sbp, coalesce(dbp, 80.0) as dbp,
    coalesce(creatinine, 90.0) as creatinine, coalesce(tchdl_rat, 4.0) as tchdl_rat, coalesce(smoke, 'Non-smoker') as smoke),
    {_ABSENT}, patid % {IMPUTATIONS} + 1 as imputation from cohort),
followed as (
  select * from (select *, date_diff('day', trial_start, least(end_followup_date_2y, enddate, dod)) as time_to_event from arms)
  where time_to_event > 0),
scores as (
  select patid, trial_start, treatment, all_cause_mortality_2y as outcome, time_to_event as time,
    patid % {IMPUTATIONS} + 1 as imputation, 0.02::double + 0.5::double * u as ps, 0.02::double + 0.5::double * u as g,
    0.05::double + 0.3::double * v as q0, 0.9::double * (0.05::double + 0.3::double * v) as q1
  from (select *, cast((patid * 7919 + cast(year(trial_start) * 12 + month(trial_start) as bigint) * 104729) % 100003 as double)
      / cast(100003 as double) as u, cast((patid * 31) % 101 as double) / cast(101 as double) as v from followed))
"""
TRIM_LIST = "[0.01, 0.02, 0.03, 0.04, 0.05, 0.06, 0.07, 0.08, 0.09, 0.1]"
TRIM_BOUNDS = f"""
bounds as (
  select imputation, unnest({TRIM_LIST})::double as trim,
    unnest(quantile_cont(ps, {TRIM_LIST}) filter (where treatment = 1)) as lower,
    unnest(quantile_cont(ps, [{', '.join(repr(1 - t / 100) for t in range(1, 11))}]) filter (where treatment = 0)) as upper
  from scores group by imputation),
trimmed as (
  select s.*, b.trim from scores s join bounds b using (imputation)
  where case when treatment = 1 then ps >= lower else ps <= upper end),
weighted as (
  select t.*, case when treatment = 1 then p / ps else (1 - p) / (1 - ps) end as w
  from trimmed t join (select imputation, avg(treatment) as p from scores group by imputation) using (imputation))"""
PAIRS = """
pairs as (
  select * from (
    select t.imputation, t.patid, t.trial_start, t.time, t.outcome, t.ps, c.patid as c_patid, c.trial_start as c_trial_start,
      c.time as c_time, c.outcome as c_outcome, c.ps as c_ps, abs(t.ps - c.ps) as distance,
      row_number() over (partition by t.imputation, t.patid, t.trial_start
        order by abs(t.ps - c.ps), c.ps, c.patid, c.trial_start) as rn
    from scores t join scores c on t.imputation = c.imputation and t.treatment = 1 and c.treatment = 0)
  where rn = 1 and distance <= 0.01)"""


def cox_sql(rows: str, keys: str) -> str:
    """CTEs ``fit``(keys, est, se) from a table with keys, time, outcome, treatment, w."""
    on = " and ".join(f"{{a}}.{k} = {{b}}.{k}" for k in keys.split(", "))
    j = lambda a, b: on.format(a=a, b=b)
    pk = lambda a: ", ".join(f"{a}.{k}" for k in keys.split(", "))
    q = "(w1 - l / d * d1) * exp(n.b) / (w0 - l / d * d0 + (w1 - l / d * d1) * exp(n.b))"
    return f"""
day_sums as (
  select {keys}, time, sum(w) filter (where treatment = 1) as a1, sum(w) filter (where treatment = 0) as a0,
    coalesce(sum(w) filter (where treatment = 1 and outcome = 1), 0) as d1,
    coalesce(sum(w) filter (where treatment = 0 and outcome = 1), 0) as d0, cast(sum(outcome) as bigint) as d
  from {rows} group by {keys}, time),
risk as (
  select {keys}, time, d1, d0, d, sum(coalesce(a1, 0)) over later as w1, sum(coalesce(a0, 0)) over later as w0
  from day_sums window later as (partition by {keys} order by time desc)),
slices as (select *, unnest(range(d))::double as l from risk where d > 0),
newton as (
  select 0 as i, {keys}, 0.0::double as b from (select distinct {keys} from slices)
  union all
  select n.i + 1, {pk('n')}, n.b + sum(d1 / d - (d1 + d0) / d * {q}) / sum((d1 + d0) / d * {q} * (1 - {q}))
  from newton n join slices s on {j('n', 's')} where n.i < 12 group by n.i, {pk('n')}, n.b),
est as (select {keys}, b from newton where i = 12),
information as (
  select {pk('n')}, sum((d1 + d0) / d * {q} * (1 - {q})) as info
  from est n join slices s on {j('n', 's')} group by {pk('n')}),
rates as (
  select {pk('r')}, time, b, w1 * exp(b) / (w0 + w1 * exp(b)) as share, (d1 + d0) / (w0 + w1 * exp(b)) as rate
  from risk r join est on {j('r', 'est')}),
gone as (
  select *, sum(rate * (0 - share)) over upto as h0, sum(rate * (1 - share)) over upto as h1
  from rates window upto as (partition by {keys} order by time)),
meat as (
  select {pk('x')}, sum(pow(w * (outcome * (treatment - share)
    - exp(b * treatment) * case when treatment = 1 then h1 else h0 end), 2)) as m
  from {rows} x join gone g on {j('x', 'g')} and x.time = g.time group by {pk('x')}),
fit as (
  select {pk('est')}, est.b as est, sqrt(m) / info as se
  from est join information i on {j('est', 'i')} join meat on {j('est', 'meat')})"""
