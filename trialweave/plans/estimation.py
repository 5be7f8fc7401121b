"""Treatment effects from completed data sets: matching, weighting, cross-fitted targeting.

All imputations are analysed together: one frame with an ``imputation`` column, one set of
passes for all logistic models, one table of estimates.
"""

from __future__ import annotations

import numpy as np
from pyspark import StorageLevel
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from trialweave.functions.scalars import hash_long
from trialweave.operators import logistic, prep
from trialweave.operators.cox import SUMS, cox, risk_table
from trialweave.operators.matching import matched_sample, nearest_controls
from trialweave.operators.pool import report
from trialweave.operators.tmle import fluctuation, stratified_folds
from trialweave.operators.weights import by_trim, stabilised_weights, trim_bounds, trim_depth
from trialweave.study import KEY, AnalysisSpec

GROUP = ["imputation"]
RESULT = "imputation int, method string, trim double, est double, se double, status string"
METHODS = ("PSM", "IPTW", "CV-TMLE")


def model_frame(completed: DataFrame, spec: AnalysisSpec = AnalysisSpec()) -> tuple[DataFrame, list[str]]:
    """Keys, arm ``t``, outcome ``y``, time and the scaled feature array ``x``; feature names."""
    if "imputation" not in completed.columns:
        completed = completed.withColumn("imputation", F.lit(1))
    frame = prep.analysis_frame(completed, spec, spec.event_rule)
    feats = prep.features(frame, spec)
    frame = prep.standardised(frame, feats, GROUP).select(
        F.col("imputation").cast("int").alias("imputation"),
        *spec.core,
        F.col(spec.treatment).alias("treatment"),
        F.col(spec.outcome).alias("outcome"),
        F.col(spec.time).alias("time"),
        "x",
    )
    return frame, feats


def propensity_tasks() -> list[logistic.Task]:
    return [logistic.Task("ps", F.col("treatment"), F.lit(True))]


def nuisance_tasks(folds: int) -> list[logistic.Task]:
    """Per fold: treatment on all other folds, outcome on the other folds of each arm."""
    out = []
    for f in range(folds):
        train = F.col("fold") != f
        out.append(logistic.Task(f"g{f}", F.col("treatment"), train))
        out.append(logistic.Task(f"q0{f}", F.col("outcome"), train & (F.col("treatment") == 0)))
        out.append(logistic.Task(f"q1{f}", F.col("outcome"), train & (F.col("treatment") == 1)))
    return out


def off_fold_variances(frame: DataFrame, p: int, folds: int) -> dict[tuple[int, int], np.ndarray]:
    """Variance of each feature over the rows outside a fold (0 becomes 1), per imputation.

    Scaling features by off-fold SDs before a ridge fit equals weighting the penalty by these
    variances, so the feature array itself need not be rebuilt per fold.
    """
    rows = (
        frame.groupBy("imputation", "fold")
        .agg(
            F.count(F.lit(1)).alias("n"),
            F.expr(f"array({', '.join(f'sum(get(x, {i}))' for i in range(p))}) as s"),
            F.expr(f"array({', '.join(f'sum(get(x, {i}) * get(x, {i}))' for i in range(p))}) as ss"),
        )
        .collect()
    )
    out = {}
    for imp in {r.imputation for r in rows}:
        for f in range(folds):
            rest = [r for r in rows if r.imputation == imp and r.fold != f]
            n = sum(r.n for r in rest)
            if n:
                mean = np.sum([r.s for r in rest], axis=0) / n
                var = np.sum([r.ss for r in rest], axis=0) / n - mean**2
                out[(imp, f)] = np.where(var > 1e-12, var, 1.0)
    return out


def scored(frame: DataFrame, p: int, spec: AnalysisSpec, methods: tuple[str, ...] = METHODS) -> tuple[DataFrame, dict]:
    """Add ``ps`` and, for the targeted estimator, cross-fitted ``g``, ``q0``, ``q1``."""
    cross = "CV-TMLE" in methods
    tasks = propensity_tasks() if {"PSM", "IPTW"} & set(methods) else []
    if cross:
        frame = stratified_folds(frame, GROUP, list(KEY), "treatment", spec.folds, spec.seed)
        tasks += nuisance_tasks(spec.folds)
    else:
        frame = frame.withColumn("fold", F.lit(0))
    frame = frame.persist(StorageLevel.MEMORY_AND_DISK)
    groups = sorted(r.imputation for r in frame.select("imputation").distinct().collect())
    penalty = {(g, "ps"): np.ones(p) for g in groups}
    if cross:
        for (g, f), var in off_fold_variances(frame, p, spec.folds).items():
            penalty.update({(g, f"{m}{f}"): var for m in ("g", "q0", "q1")})
    penalty.update({(g, t.name): np.ones(p) for g in groups for t in tasks if (g, t.name) not in penalty})
    fit = logistic.fit(logistic.model_rows(frame, "x", tasks, "imputation"), tasks, p, penalty, groups)

    def coef(g: int, name: str):
        b = fit.coef.get((g, name))
        return b[0].tolist() if b is not None and np.isfinite(b).all() else None

    # One row per imputation and fold: bounded, so broadcast.
    names = [n for n, on in (("ps", any(t.name == "ps" for t in tasks)), ("g", cross), ("q0", cross), ("q1", cross)) if on]
    rows = [
        (g, f, *[coef(g, n if n == "ps" else f"{n}{f}") for n in names])
        for g in groups
        for f in range(spec.folds if cross else 1)
    ]
    schema = "imputation int, fold int, " + ", ".join(f"b_{n} array<double>" for n in names)
    table = frame.sparkSession.createDataFrame(rows, schema)
    out = frame.join(F.broadcast(table), ["imputation", "fold"]).withColumns(
        {n: F.lit(1.0) / (F.lit(1.0) + F.exp(-logistic.dot("x", f"b_{n}", p))) for n in names}
    )
    return out.select("imputation", *KEY, "treatment", "outcome", "time", "fold", *names), fit.status


def psm(scores: DataFrame, caliper: float) -> DataFrame:
    """One row per imputation; without any pair within the caliper it has no estimate."""
    pairs = nearest_controls(scores, GROUP, list(KEY), caliper, ["time", "outcome"])
    sample = matched_sample(pairs, GROUP, ["time", "outcome"])
    found = _as_result(cox(risk_table(sample, GROUP, "time", "outcome", "treatment"), GROUP), "PSM")
    return _every(found, scores, "PSM", [None], "no matched pair")


def iptw(scores: DataFrame, trims: tuple[float, ...]) -> DataFrame:
    """One row per imputation and trim level; one without rows left has no estimate."""
    bounds = trim_bounds(scores, GROUP, trims)
    deep = trim_depth(stabilised_weights(scores, GROUP), bounds, GROUP)
    table = risk_table(deep, [*GROUP, "depth"], "time", "outcome", "treatment", F.col("w"))
    table = by_trim(table, GROUP, ["time", "event", "arm"], SUMS, trims)
    return _every(_as_result(cox(table, [*GROUP, "trim"]), "IPTW"), scores, "IPTW", sorted(trims), "no rows")


def cv_tmle(scores: DataFrame, spec: AnalysisSpec) -> DataFrame:
    spark = scores.sparkSession
    missing = scores.filter(F.col("g").isNull() | F.col("q0").isNull() | F.col("q1").isNull())
    failed = {r.imputation for r in missing.select("imputation").distinct().collect()}
    good = scores.filter(~F.col("imputation").isin(*failed)) if failed else scores
    bounds = trim_bounds(good, GROUP, spec.trims, score="g")
    deep = trim_depth(good, bounds, GROUP, score="g")
    rows = deep.select(
        F.col("imputation").alias("group"),
        "depth",
        hash_long(spec.seed, *[F.col(k) for k in KEY]).alias("row"),
        *[F.col(a).cast("double").alias(b) for a, b in (("treatment", "t"), ("outcome", "y"))],
        "g",
        "q0",
        "q1",
    ).persist(StorageLevel.MEMORY_AND_DISK)
    groups = sorted(r.group for r in rows.select("group").distinct().collect())
    out = [
        (g, "CV-TMLE", trim, est, se, status)
        for g, trim, _, est, se, status in fluctuation(rows, groups, spec.trims, spec.replicates, seed=spec.seed)
    ]
    out += [(g, "CV-TMLE", float(t), None, None, "outcome model failed") for g in sorted(failed) for t in spec.trims]
    rows.unpersist()
    return spark.createDataFrame(out, RESULT)


def _as_result(fits: DataFrame, method: str) -> DataFrame:
    trim = F.col("trim") if "trim" in fits.columns else F.lit(None).cast("double")
    return fits.select("imputation", F.lit(method).alias("method"), trim.alias("trim"), "est", "se", "status")


def _every(found: DataFrame, scores: DataFrame, method: str, trims: list[float | None], status: str) -> DataFrame:
    """Results for all imputations and trim levels; those that are missing get the status."""
    levels = scores.sparkSession.createDataFrame([(t,) for t in trims], "trim double")
    asked = scores.select(F.col("imputation").cast("int").alias("imputation")).distinct().crossJoin(levels).alias("asked")
    found = found.alias("found")
    same = (F.col("asked.imputation") == F.col("found.imputation")) & F.col("asked.trim").eqNullSafe(F.col("found.trim"))
    return asked.join(found, same, "left").select(
        "asked.imputation", F.lit(method).alias("method"), "asked.trim", "found.est", "found.se", F.coalesce("found.status", F.lit(status)).alias("status")
    )


def _with_model_status(results: DataFrame, status: dict[tuple[int, str], str]) -> DataFrame:
    """Say in each result which of the models behind it failed; a result of a failed model has no estimate."""
    rows = {}
    for (g, task), said in status.items():
        if said != "ok":
            for method in ("PSM", "IPTW") if task == "ps" else ("CV-TMLE",):
                rows.setdefault((g, method), set()).add(f"{'propensity' if task == 'ps' else 'nuisance'} model: {said}")
    if not rows:
        return results
    table = results.sparkSession.createDataFrame([(*k, "; ".join(sorted(v))) for k, v in rows.items()], "imputation int, method string, failed string")
    kept = {c: F.when(F.col("failed").isNull(), F.col(c)) for c in ("est", "se")}
    out = results.join(table, ["imputation", "method"], "left").withColumns(kept)
    return out.withColumn("status", F.coalesce("failed", "status")).select("imputation", "method", "trim", "est", "se", "status")


def estimate(
    completed: DataFrame, spec: AnalysisSpec = AnalysisSpec(), methods: tuple[str, ...] = METHODS
) -> DataFrame:
    """Estimates of every method, imputation and trim level, on the log scale; failed ones are NULL with a status."""
    frame, feats = model_frame(completed, spec)
    scores, status = scored(frame, len(feats), spec, methods)
    scores = scores.persist(StorageLevel.MEMORY_AND_DISK)
    parts = []
    if "PSM" in methods:
        parts.append(psm(scores, spec.caliper))
    if "IPTW" in methods:
        parts.append(iptw(scores, spec.trims))
    if "CV-TMLE" in methods:
        parts.append(cv_tmle(scores, spec))
    out = parts[0]
    for part in parts[1:]:
        out = out.unionByName(part)
    return _with_model_status(out, status)


def effects(completed: DataFrame, spec: AnalysisSpec = AnalysisSpec()) -> DataFrame:
    """Pooled ratios with intervals, one row per method and trim level."""
    # The estimates are a few rows per imputation, read twice by the report.
    return report(estimate(completed, spec).persist())
