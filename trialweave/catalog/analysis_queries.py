"""Preparation, weighting, matching, hazards, targeting, pooling and panel queries."""

from __future__ import annotations

from dataclasses import replace

from pyspark.ml.functions import array_to_vector, vector_to_array
from pyspark.ml.stat import Summarizer
from pyspark.sql import functions as F

from trialweave.catalog.base import PAIRS, TRIM_BOUNDS, TRIM_LIST, cox_sql, filled, followed, query, scores, small_cohort
from trialweave.functions.scalars import hash_long
from trialweave.operators import logistic, panel, prep
from trialweave.operators.cox import cox, risk_table
from trialweave.operators.matching import matched_sample, nearest_controls
from trialweave.operators.pool import pooled, report
from trialweave.operators.tmle import clever_covariate, fluctuation, perturbed, risk_ratio, stratified_folds
from trialweave.operators.weights import stabilised_weights, trim_bounds, trim_depth, trimmed_rows
from trialweave.plans import estimation
from trialweave.study import TRIMS, AnalysisSpec

KEYS = ["patid", "trial_start"]
GROUP = ["imputation"]
SPEC = AnalysisSpec()


def pairs(spark, d):
    return nearest_controls(scores(spark, d).persist(), GROUP, KEYS, 0.01, ["time", "outcome"])


# ---- matching ------------------------------------------------------------------------------


@query(
    "j8_nearest_match",
    f"""select imputation, patid, trial_start, ps, c_patid, c_trial_start, c_ps, distance from (
      with recursive {PAIRS.strip()} select * from pairs)""",
    doubles="ps c_ps distance", ints="imputation",
)
def _(spark, d):
    return pairs(spark, d).select(*GROUP, *KEYS, "ps", "c_patid", "c_trial_start", "c_ps", "distance")


@query(
    "u3_matched_sample",
    f"""select * from (with recursive {PAIRS.strip()}
      select imputation, patid, trial_start, 1 as treatment from pairs
      union all select imputation, c_patid, c_trial_start, 0 from pairs)""",
    ints="imputation treatment",
)
def _(spark, d):
    return matched_sample(pairs(spark, d), GROUP, KEYS)


# ---- preparation ----------------------------------------------------------------------------


@query("e1_time_to_event", "select patid, trial_start, time_to_event, all_cause_mortality_2y as event from followed", ints="time_to_event event")
def _(spark, d):
    return followed(spark, d).select(*KEYS, "time_to_event", F.col("all_cause_mortality_2y").alias("event"))


@query(
    "e2_one_hot",
    """select patid, trial_start, cast(gender = 'Male' as bigint) as gender_Male, cast(imd2015_5 = '2' as bigint) as imd2015_5_2,
      cast(imd2015_5 = '3' as bigint) as imd2015_5_3, cast(imd2015_5 = '4' as bigint) as imd2015_5_4,
      cast(imd2015_5 = '5' as bigint) as imd2015_5_5 from arms""",
    ints="gender_Male imd2015_5_2 imd2015_5_3 imd2015_5_4 imd2015_5_5",
)
def _(spark, d):
    df = small_cohort(spark, d).select(*KEYS, "gender", "imd2015_5")
    return prep.one_hot(df, prep.levels(df, ["gender", "imd2015_5"]))


@query(
    "e3_standardise",
    """select patid, trial_start, (ps - avg(ps) over g) / stddev_pop(ps) over g as z1, (time - avg(time) over g) / stddev_pop(time) over g as z2
    from scores window g as (partition by imputation)""",
    doubles="z1 z2",
)
def _(spark, d):
    df = prep.standardised(scores(spark, d), ["ps", "time"], GROUP)
    return df.select(*KEYS, F.get("x", F.lit(0)).alias("z1"), F.get("x", F.lit(1)).alias("z2"))


@query(
    "e4_propensity_one_feature",
    """with recursive z as (select imputation, treatment, (time - avg(time) over g) / stddev_pop(time) over g as x
      from scores window g as (partition by imputation)),
    newton as (
      select 0 as i, imputation, 0.0::double as a, 0.0::double as b from (select distinct imputation from z)
      union all
      select i + 1, imputation, a + (hbb * ga - hab * gb) / (haa * hbb - hab * hab), b + (haa * gb - hab * ga) / (haa * hbb - hab * hab)
      from (
        select i, n.imputation, a, b, sum(treatment - p) as ga, sum((treatment - p) * x) - b as gb, sum(p * (1 - p)) as haa,
          sum(p * (1 - p) * x) as hab, sum(p * (1 - p) * x * x) + 1 as hbb
        from (select n.*, z.x, z.treatment, 1 / (1 + exp(-(n.a + n.b * z.x))) as p from newton n join z on n.imputation = z.imputation
          where n.i < 15) n
        group by i, n.imputation, a, b))
    select imputation, a as intercept, b as slope from newton where i = 15""",
    doubles="intercept slope", ints="imputation",
)
def _(spark, d):
    df = prep.standardised(scores(spark, d), ["time"], GROUP)
    tasks = estimation.propensity_tasks()
    groups = sorted(r.imputation for r in df.select("imputation").distinct().collect())
    fit = logistic.fit(logistic.model_rows(df, "x", tasks, "imputation").persist(), tasks, 1, 1.0, groups)
    rows = [(g, float(fit.coef[(g, "ps")][0][1]), float(fit.coef[(g, "ps")][0][0])) for g in groups]
    return spark.createDataFrame(rows, "imputation int, intercept double, slope double")


_COMPLETE = """complete as (
      select * from (select *, date_diff('day', trial_start, least(end_followup_date_2y, enddate, dod)) as days from filled) where days > 0)"""


def _features_sql() -> str:
    """``f(imputation, treatment, feature, value)``: design columns of the complete rows, levels but the first of each category."""
    out = [f"select imputation, treatment, '{c}' as feature, cast({c} as double) as value from complete" for c in (*SPEC.numeric, *SPEC.flags)]
    for c in SPEC.categorical:
        text = f"coalesce(cast({c} as varchar), 'nan')"
        out.append(
            f"select imputation, treatment, '{c}_' || level, cast({text} = level as int) from complete, "
            f"(select distinct {text} as level from complete where {text} <> (select min({text}) from complete))"
        )
    return "f as (" + " union all ".join(out) + ")"


@query(
    "e4_propensity_full",
    f"""with {_COMPLETE}, {_features_sql()}
    select imputation, feature, round(sum(treatment * value), 4) as moment from f group by imputation, feature
    union all select imputation, 'intercept', sum(treatment) from complete group by imputation""",
    doubles="moment", ints="imputation",
)
def _(spark, d):
    """Score equations: a feature's sum over treated rows is its sum over fitted probabilities plus sd x coefficient."""
    frame = prep.analysis_frame(filled(spark, d), SPEC, SPEC.event_rule)
    feats = prep.features(frame, SPEC)
    scale = prep.known_moments(frame, feats, GROUP)
    rows = prep.standardised(frame, feats, GROUP, scale=scale)
    task = [logistic.Task("ps", F.col(SPEC.treatment), F.lit(True))]
    groups = sorted(r.imputation for r in frame.select("imputation").distinct().collect())
    passed = logistic.model_rows(rows, "x", task, "imputation").persist()
    fit = logistic.fit(passed, task, len(feats), 1.0, groups, tol=1e-9)
    passed.unpersist()
    coef = spark.createDataFrame([(g, fit.coef[(g, "ps")][0].tolist()) for g in groups], "imputation int, b array<double>")
    ps = F.lit(1.0) / (F.lit(1.0) + F.exp(-logistic.dot("x", "b", len(feats))))
    rows = rows.join(F.broadcast(coef), "imputation").withColumn("ps", ps)
    # A population SD of zero counts as 1, as in the scaling.
    parts = F.expr(f"transform(array({', '.join(f'cast(`{c}` as double)' for c in feats)}), v -> v * ps)")
    sums = rows.groupBy("imputation").agg(Summarizer.sum(array_to_vector(parts)).alias("sums"), F.sum("ps").alias("intercept"))
    sums = sums.withColumn("sums", vector_to_array("sums")).join(scale, "imputation").join(coef, "imputation")
    wide = sums.select("imputation", *[F.expr(f"sums[{i}] + sd[{i}] * b[{i}]").alias(c) for i, c in enumerate(feats)], "intercept")
    long = wide.unpivot(["imputation"], [f"`{c}`" for c in [*feats, "intercept"]], "feature", "moment")
    return long.select("imputation", "feature", F.round("moment", 4).alias("moment"))


# ---- weights and trimming ----------------------------------------------------------------------


@query(
    "e5_stabilised_weights",
    """select patid, trial_start, case when treatment = 1 then p / ps else (1 - p) / (1 - ps) end as w
    from scores join (select imputation, avg(treatment) as p from scores group by imputation) using (imputation)""",
    doubles="w",
)
def _(spark, d):
    return stabilised_weights(scores(spark, d), GROUP).select(*KEYS, "w")


@query(
    "e6_trimmed_rows",
    f"select * from (with recursive {TRIM_BOUNDS.strip()} select patid, trial_start, trim from trimmed)",
    doubles="trim",
)
def _(spark, d):
    s = scores(spark, d).persist()
    return trimmed_rows(s, trim_bounds(s, GROUP, TRIMS), GROUP, TRIMS).select(*KEYS, "trim")


@query(
    "e6_trim_bounds",
    f"select * from (with recursive {TRIM_BOUNDS.strip()} select imputation, trim, lower, upper from bounds)",
    doubles="trim lower upper", ints="imputation",
)
def _(spark, d):
    return trim_bounds(scores(spark, d).persist(), GROUP, TRIMS)


# ---- hazards --------------------------------------------------------------------------------------


@query(
    "e7_cox_weighted",
    f"""with recursive x as (select 1 as k, time, outcome, treatment, 0.5::double + (patid % 7) / 4.0::double as w from scores),
    {cox_sql('x', 'k').strip()} select est, se from fit""",
    doubles="est se",
)
def _(spark, d):
    w = F.lit(0.5) + F.pmod(F.col("patid"), F.lit(7)) / F.lit(4.0)
    df = scores(spark, d).withColumn("k", F.lit(1))
    return cox(risk_table(df, ["k"], "time", "outcome", "treatment", w), ["k"]).select("est", "se")


def _said(results):
    """Each row has an estimate and its error; a failed fit is not fine."""
    whole = F.col("est").isNotNull() & (F.col("se") > 0) & (F.col("status") == "ok")
    return results.select("imputation", "method", "trim", F.coalesce(whole, F.lit(False)).alias("fine"))


#: Estimators from start to end on one covariate, which SQL can fit as well.
ONE = replace(SPEC, numeric=("creatinine",), categorical=(), flags=())
#: The propensity model of that covariate by Newton steps; ``scores`` then holds the fitted scores.
_FITTED = f"""{_COMPLETE},
    zs as (select *, (creatinine - avg(creatinine) over g) / stddev_pop(creatinine) over g as x from complete window g as (partition by imputation)),
    psfit as (
      select 0 as i, imputation, 0.0::double as a, 0.0::double as b from (select distinct imputation from zs)
      union all
      select i + 1, imputation, a + (hbb * ga - hab * gb) / (haa * hbb - hab * hab), b + (haa * gb - hab * ga) / (haa * hbb - hab * hab)
      from (
        select i, imputation, a, b, sum(treatment - p) as ga, sum((treatment - p) * x) - b as gb, sum(p * (1 - p)) as haa,
          sum(p * (1 - p) * x) as hab, sum(p * (1 - p) * x * x) + 1 as hbb
        from (select n.*, zs.x, zs.treatment, 1 / (1 + exp(-(n.a + n.b * zs.x))) as p from psfit n join zs on n.imputation = zs.imputation where n.i < 15)
        group by i, imputation, a, b)),
    fitted as (
      select patid, trial_start, treatment, all_cause_mortality_2y as outcome, days as time, zs.imputation, 1 / (1 + exp(-(a + b * x))) as ps
      from zs join psfit n on zs.imputation = n.imputation and n.i = 15)"""


def _of_fitted(sql: str) -> str:
    return sql.replace("from scores", "from fitted").replace("join scores", "join fitted")


@query(
    "e8_psm_fitted",
    f"""with recursive {_FITTED}, {_of_fitted(PAIRS).strip()}, x as (
      select imputation, time, outcome, 1 as treatment, 1.0::double as w from pairs
      union all select imputation, c_time, c_outcome, 0, 1.0 from pairs),
    {cox_sql('x', 'imputation').strip()} select imputation, est, se, 'ok' as status from fit""",
    doubles="est se", ints="imputation",
)
def _(spark, d):
    return estimation.estimate(filled(spark, d), ONE, ("PSM",)).select("imputation", "est", "se", "status")


@query(
    "e9_iptw_fitted",
    f"""with recursive {_FITTED}, {_of_fitted(TRIM_BOUNDS).strip()}, x as (select imputation, trim, time, outcome, treatment, w from weighted),
    {cox_sql('x', 'imputation, trim').strip()} select imputation, trim, est, se, 'ok' as status from fit""",
    doubles="trim est se", ints="imputation",
)
def _(spark, d):
    return estimation.estimate(filled(spark, d), ONE, ("IPTW",)).select("imputation", "trim", "est", "se", "status")


@query(
    "e8_psm_given_scores",
    f"""with recursive {PAIRS.strip()}, x as (
      select imputation, time, outcome, 1 as treatment, 1.0::double as w from pairs
      union all select imputation, c_time, c_outcome, 0, 1.0 from pairs),
    {cox_sql('x', 'imputation').strip()} select imputation, est, se from fit""",
    doubles="est se", ints="imputation",
)
def _(spark, d):
    return estimation.psm(scores(spark, d).persist(), 0.01).select("imputation", "est", "se")


@query(
    "e8_psm",
    f"with {_COMPLETE} select distinct imputation, 'PSM' as method, cast(null as double) as trim, true as fine from complete",
    doubles="trim", ints="imputation",
)
def _(spark, d):
    return _said(estimation.estimate(filled(spark, d), AnalysisSpec(), ("PSM",)))


@query(
    "e8_psm_without_pairs",
    "select distinct imputation, 'PSM' as method, cast(null as double) as est, 'no matched pair' as status from scores",
    doubles="est", ints="imputation",
)
def _(spark, d):
    """An arm that is empty, or no pair within the caliper, is a row that says so."""
    alone = scores(spark, d).filter("treatment = 1").unionByName(scores(spark, d).filter("treatment = 0").withColumn("ps", F.col("ps") + 5.0))
    return estimation.psm(alone.persist(), 0.01).select("imputation", "method", "est", "status")


@query(
    "e9_iptw_given_scores",
    f"""with recursive {TRIM_BOUNDS.strip()}, x as (select imputation, trim, time, outcome, treatment, w from weighted),
    {cox_sql('x', 'imputation, trim').strip()} select imputation, trim, est, se from fit""",
    doubles="trim est se", ints="imputation",
)
def _(spark, d):
    return estimation.iptw(scores(spark, d).persist(), TRIMS).select("imputation", "trim", "est", "se")


@query(
    "e9_iptw",
    f"with {_COMPLETE} select distinct imputation, 'IPTW' as method, trim, true as fine from complete, unnest({TRIM_LIST}) t(trim)",
    doubles="trim", ints="imputation",
)
def _(spark, d):
    return _said(estimation.estimate(filled(spark, d), AnalysisSpec(), ("IPTW",)))


# ---- targeting -------------------------------------------------------------------------------------


@query(
    "e10_fold_sizes",
    """select imputation, treatment, fold, (n - fold + 4) // 5 as rows from (
      select imputation, treatment, count(*) as n from scores group by imputation, treatment), range(5) f(fold)
    where n > fold""",
    ints="imputation treatment fold rows",
)
def _(spark, d):
    folds = stratified_folds(scores(spark, d), GROUP, KEYS, "treatment", 5, 1234)
    return folds.groupBy("imputation", "treatment", "fold").agg(F.count(F.lit(1)).alias("rows"))


@query(
    "e11_cross_fitted",
    f"""with {_COMPLETE}, arms_of as (select imputation, treatment, count(*) as n from complete group by all)
    select imputation, treatment, fold, (n - fold + 4) // 5 as rows, (n - fold + 4) // 5 as inside from arms_of, range(5) f(fold) where n > fold""",
    ints="imputation treatment fold rows inside",
)
def _(spark, d):
    """Every row is scored by models of the other folds, each with a score inside 0 and 1."""
    frame, feats = estimation.model_frame(filled(spark, d))
    out, _ = estimation.scored(frame, len(feats), AnalysisSpec(), ("CV-TMLE",))
    fine = [(F.col(c) >= 0) & (F.col(c) <= 1) for c in ("g", "q0", "q1")]
    return out.groupBy("imputation", "treatment", "fold").agg(F.count(F.lit(1)).alias("rows"), F.count_if(F.coalesce(fine[0] & fine[1] & fine[2], F.lit(False))).alias("inside"))


@query(
    "e11_score_equations",
    f"""with {_COMPLETE} select distinct imputation, fold, model, true as settled
    from complete, range(5) f(fold), (values ('g'), ('q0'), ('q1')) m(model)""",
    ints="imputation fold",
)
def _(spark, d):
    """For every fold and model, the penalised gradient over its training rows is zero in each feature."""
    frame, feats = estimation.model_frame(filled(spark, d))
    p = len(feats)
    frame = stratified_folds(frame, GROUP, KEYS, "treatment", 5, SPEC.seed).persist()
    groups = sorted(r.imputation for r in frame.select("imputation").distinct().collect())
    tasks, variances = estimation.nuisance_tasks(5), estimation.off_fold_variances(frame, p, 5)
    penalty = {(g, t.name): variances[(g, int(t.name[-1]))] for g in groups for t in tasks}
    fit = logistic.fit(logistic.model_rows(frame, "x", tasks, "imputation"), tasks, p, penalty, groups)
    rows = [(g, int(t.name[-1]), t.name[:-1], fit.coef[(g, t.name)][0].tolist(), [*penalty[(g, t.name)].tolist(), 0.0]) for g in groups for t in tasks]
    models = spark.createDataFrame(rows, "imputation int, off int, model string, b array<double>, penalty array<double>")  # folds x models rows
    train = frame.join(F.broadcast(models), "imputation").filter("fold <> off")
    train = train.filter("model = 'g' or (model = 'q0' and treatment = 0) or (model = 'q1' and treatment = 1)")
    target = F.when(F.col("model") == "g", F.col("treatment")).otherwise(F.col("outcome"))
    train = train.withColumn("miss", target - F.lit(1.0) / (F.lit(1.0) + F.exp(-logistic.dot("x", "b", p))))
    sums = [f"sum(miss * get(x, {i})) - get(first(b), {i}) * get(first(penalty), {i})" for i in range(p)] + ["sum(miss)"]
    out = train.groupBy("imputation", F.col("off").alias("fold"), "model").agg(F.expr(f"array({', '.join(sums)})").alias("score"))
    return out.select("imputation", "fold", "model", F.coalesce(F.forall("score", lambda x: F.abs(x) < 1e-3), F.lit(False)).alias("settled"))


@query(
    "e12_perturbed",
    """select patid, trial_start, h, 1 / (1 + exp(-(ln(q / (1 - q)) + 0.01 * h))) as p from (
      select patid, trial_start, treatment / g - (1 - treatment) / (1 - g) as h, case when treatment = 1 then q1 else q0 end as q from scores)""",
    doubles="h p",
)
def _(spark, d):
    t, g = F.col("treatment").cast("double"), F.col("g")
    p = perturbed(F.col("q0"), F.col("q1"), g, t, F.lit(0.01))
    return scores(spark, d).select(*KEYS, clever_covariate(t, g).alias("h"), p.alias("p"))


_EPS = f"""{TRIM_BOUNDS.strip()},
    r as (select imputation, trim, outcome as y, g, q0, q1, treatment / g - (1 - treatment) / (1 - g) as h,
      case when treatment = 1 then ln(q1 / (1 - q1)) else ln(q0 / (1 - q0)) end as o from trimmed),
    newton as (
      select 0 as i, imputation, trim, 0.0::double as eps from bounds
      union all
      select i + 1, imputation, trim, eps + sum(h * (y - p)) / sum(h * h * p * (1 - p)) from (
        select n.i, n.imputation, n.trim, n.eps, h, y, 1 / (1 + exp(-(o + n.eps * h))) as p
        from newton n join r on n.imputation = r.imputation and n.trim = r.trim where n.i < 12)
      group by i, imputation, trim, eps)"""


def _steps(spark, d, replicates=0):
    s = scores(spark, d).persist()
    deep = trim_depth(s, trim_bounds(s, GROUP, TRIMS, "g"), GROUP, "g")
    rows = deep.select(
        F.col("imputation").alias("group"), "depth", hash_long(1, *[F.col(k) for k in KEYS]).alias("row"),
        F.col("treatment").cast("double").alias("t"), F.col("outcome").cast("double").alias("y"), "g", "q0", "q1",
    ).persist()
    groups = sorted(r.group for r in rows.select("group").distinct().collect())
    out = fluctuation(rows, groups, TRIMS, replicates)
    rows.unpersist()
    return spark.createDataFrame(out, "imputation int, trim double, eps double, log_rr double, se double, status string")


@query(
    "e13_fluctuation",
    f"with recursive {_EPS} select imputation, trim, eps from newton where i = 12",
    doubles="trim eps", ints="imputation",
)
def _(spark, d):
    return _steps(spark, d).select("imputation", "trim", "eps")


@query(
    "e14_risk_ratio",
    """select imputation, avg(1 / (1 + exp(-(ln(q1 / (1 - q1)) + 0.01 / g)))) / avg(1 / (1 + exp(-(ln(q0 / (1 - q0)) - 0.01 / (1 - g))))) as rr
    from scores group by imputation""",
    doubles="rr", ints="imputation",
)
def _(spark, d):
    return risk_ratio(scores(spark, d), GROUP, F.lit(0.01))


@query(
    "e14_log_risk_ratio_by_trim",
    f"""with recursive {_EPS} select r.imputation, r.trim, ln(avg(1 / (1 + exp(-(ln(q1 / (1 - q1)) + eps / g))))
      / avg(1 / (1 + exp(-(ln(q0 / (1 - q0)) - eps / (1 - g)))))) as log_rr
    from r join newton n on r.imputation = n.imputation and r.trim = n.trim and n.i = 12 group by r.imputation, r.trim""",
    doubles="trim log_rr", ints="imputation",
)
def _(spark, d):
    return _steps(spark, d).select("imputation", "trim", "log_rr")


@query(
    "e15_bootstrap",
    f"""with recursive {_EPS} select n.imputation, n.trim, any_value(n.eps) as eps, ln(avg(1 / (1 + exp(-(ln(q1 / (1 - q1)) + eps / g))))
      / avg(1 / (1 + exp(-(ln(q0 / (1 - q0)) - eps / (1 - g)))))) as log_rr, true as near
    from r join newton n on r.imputation = n.imputation and r.trim = n.trim and n.i = 12 group by n.imputation, n.trim""",
    doubles="trim eps log_rr", ints="imputation",
)
def _(spark, d):
    """The standard error of 200 replicates is within Monte-Carlo error of the one that influence functions give."""
    found = _steps(spark, d, 200)
    s = scores(spark, d)
    deep = trim_depth(s, trim_bounds(s, GROUP, TRIMS, "g"), GROUP, "g")
    rows = deep.join(F.broadcast(found), "imputation").filter(F.col("depth") > F.round(F.col("trim") * 100) - 1)
    t, y = F.col("treatment").cast("double"), F.col("outcome").cast("double")
    p = perturbed(F.col("q0"), F.col("q1"), F.col("g"), t, F.col("eps"))
    p1, p0 = (perturbed(F.col("q0"), F.col("q1"), F.col("g"), F.lit(a), F.col("eps")) for a in (1.0, 0.0))
    h = clever_covariate(t, F.col("g"))
    rows = rows.select("imputation", "trim", p1.alias("p1"), p0.alias("p0"), (h * (y - p)).alias("s"), (h * h * p * (1 - p)).alias("i"), (p1 * (1 - p1) / F.col("g")).alias("d1"), (p0 * (1 - p0) / (1 - F.col("g"))).alias("d0"))
    means = rows.groupBy("imputation", "trim").agg(*[F.avg(c).alias(f"m_{c}") for c in ("p1", "p0", "i", "d1", "d0")])
    both = rows.join(F.broadcast(means), ["imputation", "trim"])
    step = F.col("s") / F.col("m_i")
    part = (F.col("p1") - F.col("m_p1") + F.col("m_d1") * step) / F.col("m_p1") - (F.col("p0") - F.col("m_p0") - F.col("m_d0") * step) / F.col("m_p0")
    closed = both.groupBy("imputation", "trim").agg((F.stddev_pop(part) / F.sqrt(F.count(F.lit(1)))).alias("closed"))
    near = (F.col("status") == "ok") & F.col("se").between(0.75 * F.col("closed"), 1.33 * F.col("closed"))
    return found.join(closed, ["imputation", "trim"]).select("imputation", "trim", "eps", "log_rr", F.coalesce(near, F.lit(False)).alias("near"))


@query(
    "e16_cv_tmle",
    f"with {_COMPLETE} select distinct imputation, 'CV-TMLE' as method, trim, true as fine from complete, unnest({TRIM_LIST}) t(trim)",
    doubles="trim", ints="imputation",
)
def _(spark, d):
    return _said(estimation.estimate(filled(spark, d), AnalysisSpec(), ("CV-TMLE",)))


# ---- pooling -------------------------------------------------------------------------------------------

_ESTIMATES = """estimates as (
      select patid % 5 + 1 as imputation, case treatment when 1 then 'A' else 'B' end as method, (time % 4 + 1) / 100.0::double as trim,
        avg(ps) as est, stddev_samp(ps) / sqrt(count(*)) as se, count(*) as n
      from scores group by 1, 2, 3)"""
_POOLED = """pooled as (
      select method, trim, count(est) as m, avg(est) as e,
        case when count(se) = count(*) then sqrt(avg(se * se) + (1 + 1.0::double / count(*)) * coalesce(var_samp(est), 0)) end as s
      from estimates group by method, trim)"""


def _estimates(spark, d):
    method = F.when(F.col("treatment") == 1, "A").otherwise("B")
    n = F.count(F.lit(1))
    return (
        scores(spark, d)
        .groupBy((F.col("patid") % 5 + 1).alias("imputation"), method.alias("method"), ((F.col("time") % 4 + 1) / 100.0).alias("trim"))
        .agg(F.avg("ps").alias("est"), (F.stddev_samp("ps") / F.sqrt(n)).alias("se"), n.alias("n"))
        .withColumn("status", F.when(F.col("se").isNull(), "one row").otherwise("ok"))
    )


@query(
    "e17_pooling",
    f"with {_ESTIMATES}, {_POOLED} select method, trim, exp(e) as est, exp(e - 1.96 * s) as lo, exp(e + 1.96 * s) as hi, m from pooled",
    doubles="trim est lo hi", ints="m",
)
def _(spark, d):
    return pooled(_estimates(spark, d), ["method", "trim"])


@query(
    "s10_report",
    f"""with {_ESTIMATES}, {_POOLED},
    said as (select method, trim, string_agg(status, '; ' order by status) as status from (
      select distinct method, trim, case when se is null then 'one row' else 'ok' end as status from estimates) group by method, trim)
    select method, trim, exp(e) as est, exp(e - 1.96 * s) as lo, exp(e + 1.96 * s) as hi, m, status from pooled join said using (method, trim)""",
    doubles="trim est lo hi", ints="m",
)
def _(spark, d):
    return report(_estimates(spark, d))


# ---- panel -----------------------------------------------------------------------------------------------

_PANEL = """panel as (
      select patid, trial_start, treatment, hypertension_history, diabetes_history, cast(lower(gender) = 'male' as int) as gender_numeric,
        (age_at_trial - min(age_at_trial) over ()) / cast(max(age_at_trial) over () - min(age_at_trial) over () as double) as age_minmax,
        cast(hypertension_history + diabetes_history + ACE + ARB > 2 as bigint) as Zstar
      from cohort),
    periods as (
      select *, t, greatest(0.00000001, least(1.0, 0.0001 * exp(-0.25 * t) * exp(-0.5 * treatment)
        * exp(0.4 * age_minmax + 0.2 * gender_numeric + 0.3 * hypertension_history + 0.1 * diabetes_history) * exp(ln(1.01) * t * Zstar))) as hazard
      from panel, range(1, 25) p(t))"""
_BETA = {"age_minmax": 0.4, "gender_numeric": 0.2, "hypertension_history": 0.3, "diabetes_history": 0.1}


def _panel(spark, d):
    df = panel.comorbidity_score(small_cohort(spark, d), ("hypertension_history", "diabetes_history", "ACE", "ARB"))
    return panel.gender_flag(panel.min_max(df, "age_at_trial", "age_minmax"))


def _first(spark, d):
    rows = panel.person_periods(_panel(spark, d), _BETA, "treatment")
    event = F.pmod(F.col("patid") * 31 + F.col("t") * 17, F.lit(97)) == 0
    gone = F.pmod(F.col("patid") * 13 + F.col("t") * 7, F.lit(89)) == 0
    return panel.first_event(rows, KEYS, event, gone)


_FIRST = """firsts as (
      select patid, trial_start, coalesce(min(t) filter (where hit or gone), 24) as time,
        cast(coalesce(arg_min(not gone, t) filter (where hit or gone), false) as bigint) as label
      from (select patid, trial_start, t, (patid * 31 + t * 17) % 97 = 0 as hit, (patid * 13 + t * 7) % 89 = 0 as gone from periods)
      group by patid, trial_start)"""


@query("r1_comorbidity_score", f"with {_PANEL} select patid, trial_start, Zstar from panel", ints="Zstar")
def _(spark, d):
    return _panel(spark, d).select(*KEYS, "Zstar")


@query("r2_min_max_age", f"with {_PANEL} select patid, trial_start, age_minmax from panel", doubles="age_minmax")
def _(spark, d):
    return _panel(spark, d).select(*KEYS, "age_minmax")


@query("r3_gender_flag", f"with {_PANEL} select patid, trial_start, gender_numeric from panel", ints="gender_numeric")
def _(spark, d):
    return _panel(spark, d).select(*KEYS, "gender_numeric")


@query(
    "r4_person_periods",
    f"with {_PANEL} select patid, trial_start, t, hazard * 1e6 as hazard from periods",
    doubles="hazard", ints="t",
)
def _(spark, d):
    rows = panel.person_periods(_panel(spark, d), _BETA, "treatment")
    return rows.select(*KEYS, "t", (F.col("hazard") * 1e6).alias("hazard"))


@query("r5_first_event", f"with {_PANEL}, {_FIRST} select patid, trial_start, time, label from firsts", ints="time label")
def _(spark, d):
    return _first(spark, d)


@query(
    "r6_event_summary",
    f"with {_PANEL}, {_FIRST} select avg(label) as event_rate, avg(time) as mean_time, count(*) as n from firsts",
    doubles="event_rate mean_time",
)
def _(spark, d):
    return _first(spark, d).agg(F.avg("label").alias("event_rate"), F.avg("time").alias("mean_time"), F.count(F.lit(1)).alias("n"))
