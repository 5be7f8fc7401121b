"""Custom operators against brute force, other solvers and known limits."""

import numpy as np
import pandas as pd
import pytest
from pyspark.ml.classification import LogisticRegression
from pyspark.ml.functions import array_to_vector
from pyspark.sql import functions as F

from trialweave.functions.scalars import hash_uniform
from trialweave.operators import logistic, prep
from trialweave.operators.cox import _efron, cox, risk_table
from trialweave.operators.impute import donor_draw
from trialweave.operators.matching import nearest_controls
from trialweave.operators import ordering
from trialweave.operators.ordering import exact_quantiles, numbered, sorted_neighbours, with_buckets
from trialweave.operators.pool import pooled, report
from trialweave.operators.tmle import _leaves, fluctuation, leaf_counts, with_draws
from trialweave.operators.weights import trim_bounds, trim_depth, trimmed_rows


@pytest.fixture(scope="module")
def skewed():
    """A third of all rows on one score, others clustered or repeated."""
    rng = np.random.default_rng(0)
    s = rng.random(3000)
    s[:1000], s[1000:1300] = 0.3, 0.5 + rng.random(300) * 1e-4
    s = np.where(rng.random(3000) < 0.3, np.round(s, 2), s)
    return pd.DataFrame({"id": np.arange(3000), "g": rng.integers(0, 2, 3000), "s": s, "don": rng.random(3000) < 0.3})


@pytest.mark.parametrize("k,rows", [(1, 50), (5, 50), (5, 10_000)])
def test_neighbours_equal_brute_force(spark, skewed, k, rows):
    df = spark.createDataFrame(skewed).withColumns(
        {"u": hash_uniform(1, F.col("id")), "donor": F.when(F.col("don"), F.struct("id"))}
    )
    out = sorted_neighbours(df, ["g"], "s", "donor", "u", k, rows).toPandas()
    assert len(out) == (~skewed.don).sum()
    for r in out.itertuples():
        want = np.sort(np.abs(skewed[(skewed.g == r.g) & skewed.don].s - r.s))[:k]
        near = [*r.below, *r.above]
        assert np.array_equal(want, np.sort([abs(x["score"] - r.s) for x in near])[:k])
        assert len({x["donor"]["id"] for x in near}) == len(near)


def test_places_are_bounded_by_buckets(spark):
    """Few distinct scores: sub-buckets follow a score's share."""
    df = spark.range(20_000).select((F.col("id") % 200 / 200.0).alias("s"), hash_uniform(1, F.col("id")).alias("u"))
    places = with_buckets(df, "s", "u", 100).select("__bucket", "__sub").distinct().count()
    assert 100 <= places <= 2 * 200


@pytest.mark.parametrize("few", [2, 64])
def test_two_levels_of_cuts_keep_the_order(spark, skewed, monkeypatch, few):
    """Places follow (score, tie-break) order, whatever share one score has, and none holds much more than its rows."""
    monkeypatch.setattr(ordering, "FEW_BUCKETS", few)
    df = spark.createDataFrame(skewed).withColumn("u", hash_uniform(1, F.col("id")))
    out = with_buckets(df, "s", "u", 20).toPandas().sort_values(["s", "u"])
    place = out["__bucket"].to_numpy(float) * 1e6 + out["__sub"].to_numpy()
    assert (np.diff(place) >= 0).all()
    sizes = out.groupby(["__bucket", "__sub"]).size()
    assert sizes.max() <= 80 and len(sizes) >= 100


def test_tied_deaths_equal_their_slices():
    rng = np.random.default_rng(0)
    for n in (1, 2, 17, 400):
        d, w1, w0, d1 = np.full(5, float(n)), rng.random(5) * 3 * n + n, rng.random(5) * 9 * n + n, rng.random(5) * n
        for b in (-1.0, 0.0, 2.0):
            x1 = [(w1 - k / n * d1) * np.exp(b) for k in range(n)]
            q = [x / (x + w0 - k / n * (d - d1)) for k, x in enumerate(x1)]
            want = [sum(v.sum() for v in q), sum((v * (1 - v)).sum() for v in q)]
            assert np.allclose(_efron(d, d, w1, w0, d1, d - d1, b), want, rtol=1e-12)


def test_an_estimate_that_has_not_settled_is_null(spark):
    rng = np.random.default_rng(1)
    pdf = pd.DataFrame({"group": 1, "depth": 1, "row": np.arange(500), "t": rng.integers(0, 2, 500) * 1.0, "y": rng.integers(0, 2, 500) * 1.0, "g": 0.5, "q0": 0.05, "q1": 0.04})
    df = spark.createDataFrame(pdf).withColumns({c: F.col(c).cast("int") for c in ("group", "depth")})
    (one,) = fluctuation(df, [1], (0.01,), 0, max_passes=1)
    assert one[2:] == (None, None, None, "not converged")


def test_quantiles_and_numbering(spark, skewed):
    df = spark.createDataFrame(skewed)
    for r in exact_quantiles(df, ["g"], "s", [0.0, 0.05, 0.5, 0.99, 1.0]).collect():
        assert r["value"] == pytest.approx(np.quantile(skewed[skewed.g == r.g].s, r.prob), abs=1e-14)
    for r in numbered(df, ["g"], F.xxhash64("id"), "nth").groupBy("g").agg(
        F.count("*").alias("n"), F.countDistinct("nth").alias("d"), F.max("nth").alias("top")
    ).collect():
        assert r.n == r.d == r.top


def test_matching_rules(spark):
    rows = [(1, "t", 0.5, 1), (2, "t", 0.9, 1), (10, "c", 0.495, 0), (11, "c", 0.505, 0), (9, "c", 0.495, 0)]
    df = spark.createDataFrame(rows, "patid long, arm string, ps double, treatment int").withColumn("g", F.lit(1))
    out = nearest_controls(df, ["g"], ["patid"], 0.01, ["arm"]).collect()
    assert [(r.patid, r.c_patid, r.c_arm) for r in out] == [(1, 9, "c")]


def test_trimming_depth_agrees_with_copies(spark, skewed):
    df = spark.createDataFrame(skewed.rename(columns={"s": "ps"})).withColumn("treatment", F.col("don").cast("int"))
    trims = (0.01, 0.05, 0.1)
    b = trim_bounds(df, ["g"], trims)
    deep = {(r.g, r.depth): r["count"] for r in trim_depth(df, b, ["g"]).groupBy("g", "depth").count().collect()}
    flat = {(r.g, r.trim): r["count"] for r in trimmed_rows(df, b, ["g"], trims).groupBy("g", "trim").count().collect()}
    for (g, t), n in flat.items():
        assert n == sum(v for (h, d), v in deep.items() if h == g and d > trims.index(t))


def test_logistic_equals_ml_and_off_fold_scaling(spark):
    rng = np.random.default_rng(3)
    x = rng.normal(size=(600, 3)) * [1, 2, 0.5]
    y = (rng.random(600) < 1 / (1 + np.exp(-x @ [0.5, -0.3, 0.8] + 0.4))).astype(int)
    df = spark.createDataFrame([(1, [float(v) for v in a], int(b)) for a, b in zip(x, y)], "imputation int, x array<double>, y int")
    task = [logistic.Task("m", F.col("y"), F.lit(True))]
    fit = logistic.fit(logistic.model_rows(df, "x", task, "imputation"), task, 3, 1.0, [1])
    ml = LogisticRegression(featuresCol="v", labelCol="y", regParam=1 / 600, standardization=False, tol=1e-12, maxIter=200).fit(
        df.withColumn("v", array_to_vector("x"))
    )
    assert fit.coef[(1, "m")][0] == pytest.approx([*ml.coefficients, ml.intercept], abs=1e-5)
    sd = x.std(axis=0)
    scaled = spark.createDataFrame(
        [(1, [float(v) for v in a], int(b)) for a, b in zip((x - x.mean(axis=0)) / sd, y)], "imputation int, x array<double>, y int"
    )
    a = logistic.fit(logistic.model_rows(scaled, "x", task, "imputation"), task, 3, 1.0, [1]).coef[(1, "m")][0]
    b = logistic.fit(logistic.model_rows(df, "x", task, "imputation"), task, 3, {(1, "m"): sd**2}, [1]).coef[(1, "m")][0]
    assert a[:3] / sd == pytest.approx(b[:3], abs=1e-7)


def test_single_class_is_reported(spark):
    df = spark.createDataFrame([(1, [0.1], 0), (1, [0.2], 0)], "imputation int, x array<double>, y int")
    task = [logistic.Task("m", F.col("y"), F.lit(True))]
    assert logistic.fit(logistic.model_rows(df, "x", task, "imputation"), task, 1, 1.0, [1]).status == {(1, "m"): "single class"}


def test_cox_maximises_the_row_likelihood(spark):
    rng = np.random.default_rng(1)
    n = 300
    arm, time = rng.integers(0, 2, n), rng.integers(1, 30, n)
    event, w = (rng.random(n) < 0.6).astype(int), rng.random(n) + 0.5
    df = spark.createDataFrame(pd.DataFrame({"k": 1, "a": arm, "t": time, "e": event, "w": w}))
    r = cox(risk_table(df, ["k"], "t", "e", "a", F.col("w")), ["k"]).first()

    def loglik(b):
        total = 0.0
        for t in np.unique(time[event == 1]):
            dead, risk = (time == t) & (event == 1), time >= t
            phi = w * np.exp(b * arm)
            d = dead.sum()
            total += b * (w * arm)[dead].sum() - w[dead].sum() / d * sum(
                np.log(phi[risk].sum() - l / d * phi[dead].sum()) for l in range(d)
            )
        return total

    assert r.status == "ok" and r.se > 0
    assert loglik(r.est) > max(loglik(r.est - 1e-3), loglik(r.est + 1e-3))


def test_cox_guards(spark):
    rows = [(1, 1, 5, 1, 1.0), (1, 1, 6, 0, 1.0), (2, 0, 5, 1, 1.0), (2, 1, 6, 0, 1.0), (3, 0, 5, 0, 1.0), (3, 1, 6, 0, 1.0)]
    df = spark.createDataFrame(rows, "k int, a int, t int, e int, w double")
    got = {r.k: (r.status, r.est) for r in cox(risk_table(df, ["k"], "t", "e", "a"), ["k"]).collect()}
    assert got == {1: ("empty arm", None), 2: ("no events in one arm", None), 3: ("no events", None)}


def test_bootstrap_agrees_with_exact_resampling(spark):
    rng = np.random.default_rng(7)
    n = 1500
    t, g = rng.integers(0, 2, n).astype(float), rng.uniform(0.2, 0.8, n)
    q0 = rng.uniform(0.1, 0.4, n)
    q1, y = q0 * 0.9, (rng.random(n) < q0).astype(float)
    pdf = pd.DataFrame({"group": 1, "depth": 1, "row": rng.integers(-(2**62), 2**62, n), "t": t, "y": y, "g": g, "q0": q0, "q1": q1})
    _, _, _, log_rr, se, status = fluctuation(spark.createDataFrame(pdf), [1], (0.01,), 1000)[0]
    ex, lo = (lambda v: 1 / (1 + np.exp(-v))), (lambda q: np.log(q / (1 - q)))

    def solve(i):
        h, o, eps = t[i] / g[i] - (1 - t[i]) / (1 - g[i]), np.where(t[i] == 1, lo(q1[i]), lo(q0[i])), 0.0
        for _ in range(20):
            p = ex(o + eps * h)
            eps += (h * (y[i] - p)).sum() / (h * h * p * (1 - p)).sum()
        return np.log(ex(lo(q1[i]) + eps / g[i]).mean() / ex(lo(q0[i]) - eps / (1 - g[i])).mean())

    assert status == "ok" and log_rr == pytest.approx(solve(np.arange(n)), abs=1e-8)
    exact = np.std([solve(rng.integers(0, n, n)) for _ in range(1500)], ddof=1)
    assert se == pytest.approx(exact, rel=0.1)


def test_replicates_draw_as_many_rows_as_there_are(spark):
    """Exactly n draws per level and replicate, the same for every row however rows are dealt."""
    rng = np.random.default_rng(4)
    n, levels, replicates = 5000, 3, 30
    pdf = pd.DataFrame({"group": rng.integers(1, 3, n), "depth": rng.integers(0, levels + 1, n), "row": rng.integers(-(2**62), 2**62, n)})
    pdf = pdf.assign(t=1.0, y=0.0, g=0.5, q0=0.1, q1=0.1)
    seen = []
    for df in (spark.createDataFrame(pdf), spark.createDataFrame(pdf[::-1]).repartition(3)):
        found = {}
        for g, leaf, nodes, part in _leaves(with_draws(df, levels, per_leaf=64).toArrow().to_batches(), levels):
            depth, row = part.column("depth").to_numpy(), part.column("row").to_numpy()
            for j in range(levels):
                for r, c in zip(row[depth > j], leaf_counts(nodes, g, leaf, j, replicates).T, strict=True):
                    found[(g, j, int(r))] = c
        for g in (1, 2):
            for j in range(levels):
                total = sum(c for k, c in found.items() if k[:2] == (g, j))
                assert (total == ((pdf.group == g) & (pdf.depth > j)).sum()).all()
        seen.append(found)
    assert seen[0].keys() == seen[1].keys() and all((seen[0][k] == seen[1][k]).all() for k in seen[0])
    flat = np.concatenate([c for k, c in seen[0].items() if k[1] == 0])
    assert abs(flat.var() - 1) < 0.05 and abs((flat == 0).mean() - np.exp(-1)) < 0.02



def test_donor_draw_uses_near_observed_values(spark):
    donors = spark.createDataFrame([(1, i, i / 100, float(i)) for i in range(100)], "g int, patid int, score double, y double")
    asking = spark.createDataFrame([(1, i, 0.5) for i in range(1000, 1400)], "g int, patid int, score double").select(
        "g", "score", F.struct("patid").alias("me")
    )
    out = donor_draw(donors, asking, ["g"], ["patid"], 1)
    values = [r.y for r in out.collect()]
    assert len(values) == 400 and set(values) == {48.0, 49.0, 50.0, 51.0, 52.0}


def test_pooling_rules(spark):
    rows = [(1, "A", 0.1, 0.2, "ok"), (2, "A", 0.3, 0.4, "ok"), (1, "B", 0.5, 0.1, "ok"), (1, "C", 0.5, None, "few"), (2, "C", 0.1, 0.2, "ok"), (1, "D", None, None, "failed")]
    df = spark.createDataFrame(rows, "imputation int, method string, est double, se double, status string").withColumn("trim", F.lit(0.01))
    got = {r["method"]: r for r in report(df).collect()}
    se = np.sqrt((0.04 + 0.16) / 2 + 1.5 * 0.02)
    assert got["A"].est == pytest.approx(np.exp(0.2)) and got["A"].hi == pytest.approx(np.exp(0.2 + 1.96 * se))
    assert got["B"].lo == pytest.approx(np.exp(0.5 - 0.196))
    assert got["C"].est is not None and got["C"].lo is None and got["C"].status == "few; ok"
    assert got["D"].est is None and got["D"].m == 0
    assert pooled(df, ["method"]).count() == 3


def test_missing_level_and_unknown_column(spark):
    df = spark.createDataFrame([("a",), (None,), ("b",)], "c string")
    lv = prep.levels(df, ["c"])
    assert lv == {"c": ["a", "b", "nan"]} and prep.one_hot(df, lv).columns == ["c_b", "c_nan"]
    with pytest.raises(Exception):
        prep.strict_columns(df, ["c", "absent"])
