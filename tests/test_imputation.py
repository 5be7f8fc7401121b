"""Invariants of chained imputation on the test tables."""

from collections import Counter

import numpy as np
import pytest
from pyspark.sql import functions as F

from trialweave.catalog import QUERIES
from trialweave.catalog.base import gappy
from trialweave.functions.scalars import hash_uniform
from trialweave.operators import donors as near
from trialweave.operators import logistic
from trialweave.operators.chains import EVERY_ROW, CrossProducts, independent, products, pseudo_rows
from trialweave.operators.impute import donor_draw
from trialweave.plans import estimation, imputation
from trialweave.plans.imputation import impute
from trialweave.study import AnalysisSpec

SF_DIR = "/root/testdata/sf0.001"
SPEC = AnalysisSpec(numeric=("bmi",), categorical=("gender", "smoke"))


def test_observed_cells_stay_and_runs_repeat(spark):
    before = gappy(spark, SF_DIR).persist()
    cols = ["gender", "smoke", "bmi"]
    a = impute(before, m=2, sweeps=1, spec=SPEC).select("imputation", "patid", "trial_start", *cols).persist()
    b = impute(before, m=2, sweeps=1, spec=SPEC).select("imputation", "patid", "trial_start", *cols)
    assert a.count() == 2 * before.count()
    assert a.exceptAll(b).isEmpty() and a.dropna().count() == a.count()
    old = before.select("patid", "trial_start", *[F.col(c).alias(f"o_{c}") for c in cols])
    for c in cols:
        assert a.join(old, ["patid", "trial_start"]).filter(F.col(c) != F.col(f"o_{c}")).isEmpty()
    seen = {r[0] for r in before.select("bmi").distinct().collect()}
    assert {r[0] for r in a.select("bmi").distinct().collect()} <= seen
    one, two = (a.filter(F.col("imputation") == i).drop("imputation") for i in (1, 2))
    assert not one.exceptAll(two).isEmpty()


@pytest.mark.parametrize("key", ["m8_chained", "m9_completed_invariants", "e18_effects"])
def test_queries_draw_every_target_in_five_sweeps(spark, monkeypatch, key):
    drawn = Counter()

    def draw(run, target, seed):
        drawn[run.layout.variables[run.layout.targets[target]].name] += 1
        return run.opened, []

    monkeypatch.setattr(imputation.Run, "_match", draw)
    monkeypatch.setattr(imputation.Run, "_classify", draw)
    columns = "'' as method, 0D as trim, 0D as est, 0D as lo, 0D as hi, '' as status"
    monkeypatch.setattr(estimation, "effects", lambda completed, spec: completed.selectExpr(*columns.split(", ")))
    QUERIES[key](spark, SF_DIR)
    assert len(drawn) == 7 and set(drawn.values()) == {5}


def test_sums_follow_the_draws(spark, tmp_path):
    """After every step the matrix of cross-products is that of a fresh pass over all rows."""
    run = imputation.Run(gappy(spark, SF_DIR), 2, 1, 5, SPEC, f"file://{tmp_path}/a")
    for n in range(len(run.layout.targets)):
        run.step(n, n)
    run.sums.follow(run.opened, None)
    fresh = CrossProducts(run.layout, [1, 2])
    fresh.start(run.closed, run.opened)
    for g in (1, 2):
        assert np.allclose(run.sums.every(g), fresh.every(g), rtol=1e-10, atol=1e-8)
    both = products(run.opened, run.layout, [0, EVERY_ROW])
    assert both[(1, 0)][0, 0] == run.layout.variables[run.layout.targets[0]].n_missing


def test_a_stopped_run_goes_on(spark, tmp_path, monkeypatch):
    """Stopped after the write of a step but before its log entry, then started again: the rows of a run in one go."""
    before = gappy(spark, SF_DIR).persist()
    cols = ["imputation", "patid", "trial_start", "gender", "smoke", "bmi"]
    whole = imputation.impute(before, m=2, sweeps=2, spec=SPEC, folder=f"file://{tmp_path}/whole")
    write, written = imputation.StepLog.write, []

    def stop(log, step, entry):
        if step == 3 and not entry["trace"]:
            raise KeyboardInterrupt
        written.append(step)
        write(log, step, entry)

    monkeypatch.setattr(imputation.StepLog, "write", stop)
    with pytest.raises(KeyboardInterrupt):
        imputation.impute(before, m=2, sweeps=2, spec=SPEC, folder=f"file://{tmp_path}/parts")
    monkeypatch.setattr(imputation.StepLog, "write", write)
    assert len(imputation.StepLog(spark, f"file://{tmp_path}/parts").entries()) == 3
    parts = imputation.impute(before, m=2, sweeps=2, spec=SPEC, folder=f"file://{tmp_path}/parts")
    assert whole.select(cols).exceptAll(parts.select(cols)).isEmpty() and parts.count() == whole.count()
    traced = [imputation.trace(spark, f"file://{tmp_path}/{f}").orderBy("sweep", "target", "imputation").collect() for f in ("whole", "parts")]
    assert len(traced[0]) == 2 * 3 * 2 and [(r.sweep, r.target, r.cells) for r in traced[0]] == [(r.sweep, r.target, r.cells) for r in traced[1]]
    assert imputation.convergence(imputation.trace(spark, f"file://{tmp_path}/whole")).filter("ratio >= 0").count() == 6
    with pytest.raises(ValueError):
        imputation.impute(before, m=2, sweeps=3, spec=SPEC, folder=f"file://{tmp_path}/parts")


def test_the_trace_is_that_of_the_drawn_cells(spark, tmp_path):
    before = gappy(spark, SF_DIR).persist()
    out = imputation.impute(before, m=2, sweeps=1, spec=SPEC, folder=f"file://{tmp_path}/t")
    holes = before.filter("bmi is null").select("patid", "trial_start")
    want = {r.imputation: r for r in out.join(holes, ["patid", "trial_start"]).groupBy("imputation").agg(F.count("bmi").alias("n"), F.avg("bmi").alias("m"), F.var_samp("bmi").alias("v")).collect()}
    for r in imputation.trace(spark, f"file://{tmp_path}/t").filter("target = 'bmi'").collect():
        assert (r.cells, r.mean, r.variance) == (want[r.imputation].n, pytest.approx(want[r.imputation].m), pytest.approx(want[r.imputation].v))


@pytest.mark.parametrize("most, bins, chunk", [(1 << 17, 0, 1 << 18), (1 << 17, 64, 40), (10, 0, 40), (10, 64, 1 << 18)])
def test_pruned_donors_equal_all_donors(spark, monkeypatch, most, bins, chunk):
    """Points or ranges, with a histogram or not, small chunks: the value drawn is that of a search among all donors."""
    rng = np.random.default_rng(2)
    n = 3000
    s = rng.random(n)
    s[:1000], s[1000:1100] = 0.3, np.round(s[1000:1100], 1)  # a third on one score
    rows = [(int(k % 2 + 1), k, float(s[k]), float(np.float32(rng.random())), bool(rng.random() < (0.02 if k > 1500 else 0.1))) for k in range(n)]
    df = spark.createDataFrame(rows, "imputation int, id long, score double, y double, asks boolean").repartition(5).persist()
    donors, asking = df.filter("not asks"), df.filter("asks")
    want = donor_draw(donors.select("imputation", "id", "score", "y"), asking.select("imputation", "score", F.struct("id").alias("me")), ["imputation"], ["id"], 9)
    want = {(r.imputation, r.me.id): r.y for r in want.collect()}
    monkeypatch.setattr(near, "CHUNK", chunk)
    monkeypatch.setattr(near, "PER_BUCKET", 8)
    tie, mine = hash_uniform(9, F.col("id")), hash_uniform(10, F.col("id"))
    donors, asking = donors.withColumn("tie", tie), asking.withColumns({"tie": mine, "pick": hash_uniform(11, F.col("imputation"), F.col("id"))})

    def of_donors(b):
        g = b.column("imputation").to_numpy()
        for i in np.unique(g):
            yield (i, *[b.column(c).to_numpy()[g == i] for c in ("score", "tie", "y")])

    at = near.positions(asking, lambda b: [b.column(c).to_numpy() for c in ("imputation", "score", "tie")], asking.count(), most, 16)
    if bins:
        near.bound_reach(donors, of_donors, at, 5, bins)
    given = near.useful_donors(donors, of_donors, at, 5).persist()
    if most > 10:
        assert given.dropDuplicates(["imputation", "score", "tie"]).count() < donors.count()
    local = [(r.imputation, int(at[r.imputation].bucket_of(np.array([r.score]), np.array([r.tie]))[0]), 1, r.score, r.tie, r.pick, r.id) for r in asking.collect()]
    mine = spark.createDataFrame(local, "imputation int, bucket long, asks int, score double, tie double, pick double, me long")
    none = lambda t: F.lit(None).cast(t)
    rows = mine.withColumn("y", none("double")).unionByName(given.withColumns({"asks": F.lit(0), "pick": none("double"), "me": none("long")}))
    import pyarrow as pa

    def write(t, values):
        return pa.RecordBatch.from_arrays([t.column("imputation").combine_chunks(), t.column("me").combine_chunks(), pa.array(values)], names=["imputation", "me", "y"])

    got = near.settle(rows, write, "imputation int, me long, y double", chunk=chunk).collect()
    assert {(r.imputation, r.me): r.y for r in got} == want and len(want) > 100


def test_a_separating_predictor_leaves_draws_of_both_levels(spark):
    """With pseudo-rows the fit is finite and equals a weighted fit by brute force; without them it runs away."""
    x = np.repeat([0.0, 1.0], 50)[:, None]
    y = x[:, 0].astype(int)
    z = np.column_stack([np.ones(100), x])
    px, py, pw = pseudo_rows(z.T @ z, [1], np.zeros(1), np.ones(1), 2)
    assert len(pw) == 4 and pw.sum() == 2 and set(py) == {0, 1} and (0 <= px).all() and (px <= 1).all()
    df = spark.createDataFrame([(1, [float(a)], [int(b)]) for a, b in zip(x[:, 0], y, strict=True)], "group int, x array<double>, y array<int>")
    fit = logistic.fit(df, [logistic.Task("a", F.lit(0), F.lit(True))], 1, 0.0, [1], 40, 1e-9, pseudo={(1, "a"): (px, py, pw)})
    all_x, all_y, w = np.concatenate([x, px])[:, 0], np.concatenate([y, py]), np.concatenate([np.ones(100), pw])
    b = np.zeros(2)
    for _ in range(60):
        d = np.column_stack([all_x, np.ones(len(all_x))])
        p = 1 / (1 + np.exp(-d @ b))
        b = b + np.linalg.solve((d * (w * p * (1 - p))[:, None]).T @ d, d.T @ (w * (all_y - p)))
    assert np.allclose(fit.coef[(1, "a")][0], b, atol=1e-6) and np.isfinite(fit.cov[(1, "a")]).all()


def test_dependent_terms_are_left_out_once():
    rng = np.random.default_rng(0)
    a, b, c = rng.standard_normal((3, 200))
    u = np.column_stack([np.ones(200), a, b, a, a - 2 * b, np.full(200, 3.0), c])
    kept, constant, dependent = independent(u.T @ u, [1, 2, 3, 4, 5, 6])
    assert constant == [5] and len(kept) == 3 and len(dependent) == 2 and 6 in kept
    assert independent(u.T @ u, [1, 3, 6]) == ([1, 6], [], [3])


def test_a_copied_column_changes_no_draw(spark, tmp_path):
    from dataclasses import replace

    before = gappy(spark, SF_DIR).withColumn("same", F.col("ACE")).persist()
    cols = ["imputation", "patid", "trial_start", "bmi"]
    spec = replace(SPEC, numeric=("bmi",), categorical=(), flags=("ACE", "ARB"))
    plain = imputation.impute(before, m=2, sweeps=1, spec=spec).select(cols)
    more = imputation.impute(before, m=2, sweeps=1, spec=replace(spec, flags=("ACE", "ARB", "same")), folder=f"file://{tmp_path}/more").select(cols)
    assert plain.exceptAll(more).isEmpty()
    assert {(r.target, r.term, r.reason) for r in imputation.dropped(spark, f"file://{tmp_path}/more").collect()} == {("bmi", "same=1", "collinear")}
