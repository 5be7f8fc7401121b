"""What keeps the work spread out and off the driver on large tables, on rows of their own."""

import re
from bisect import bisect_left, bisect_right
from collections import Counter
from datetime import date

import numpy as np
import pandas as pd
import pytest
from pyspark.sql import functions as F

from trialweave.operators import impute as ops
from trialweave.operators import ordering, tmle
from trialweave.operators.calendar import TrialCalendar
from trialweave.operators.measures import measures_in_window
from trialweave.plans import imputation
from trialweave.sources import testtables as tt
from trialweave.study import AnalysisSpec

KEYS = ["patid", "trial_start"]


def gaps(spark, path, rows=400):
    """A small table as files, which Spark takes for small enough to be broadcast."""
    df = spark.range(rows).select(
        F.col("id").alias("patid"), F.current_date().alias("trial_start"),
        F.when(F.col("id") % 3 != 0, F.col("id") * 1.5).alias("a"), F.when(F.col("id") % 4 != 0, F.col("id") + 0.25).alias("b"),
        F.when(F.col("id") % 5 != 0, (F.col("id") % 2).cast("int")).alias("c"),
    )
    df = df.unionByName(df.filter("patid = 12")).unionByName(df.filter("patid = 24").withColumn("patid", F.lit(None).cast("long")))
    df.withColumns({ops.mask(c): F.col(c).isNull() for c in "abc"}).write.parquet(path)
    return spark.read.parquet(path)


def test_first_fill_is_spread_out_and_never_broadcast(spark, tmp_path):
    df = gaps(spark, f"{tmp_path}/gaps")
    n = df.count()
    count = lambda c: df.filter(F.col(c).isNotNull()).count()
    targets = [ops.Variable(c, True, n - count(c), count(c)) for c in "ab"]
    targets.append(ops.Variable("c", False, n - count("c"), count("c"), ("x", "y"), tuple(df.filter(f"c = {k}").count() for k in (0, 1))))
    out = ops.first_fill(df, df, targets, KEYS, 7, 3)
    plan = out._jdf.queryExecution().executedPlan().toString()
    assert not re.search(r"BroadcastHashJoin \[(target#\d+, nth|patid)", plan)  # one row a hash range may be
    assert out.rdd.getNumPartitions() >= int(spark.conf.get("spark.sql.shuffle.partitions"))
    rows = out.collect()
    assert len(rows) == 3 * n and {r.imputation for r in rows} == {1, 2, 3}
    seen = {c: {r[c] for r in df.collect()} - {None} for c in "abc"}
    named = [r for r in rows if r.patid is not None]
    assert all(r[c] in seen[c] for r in named for c in "abc")
    observed = {(r.patid, c): r[c] for r in df.collect() for c in "abc" if r[c] is not None}
    assert all(r[c] == observed[r.patid, c] for r in named for c in "abc" if (r.patid, c) in observed)
    drawn = [{r.patid: r.a for r in named if r.imputation == i and r.patid % 3 == 0} for i in (1, 2, 3)]
    assert drawn[0] != drawn[1] != drawn[2] and len(set(drawn[0].values())) > 80


def test_open_rows_stay_in_as_many_parts_as_the_session_has(spark, tmp_path):
    """A run's tables are small by their bytes, however long their steps take."""
    numbers = ("a", "b")
    spec = AnalysisSpec(numeric=numbers, categorical=(), flags=())
    columns = {c: F.lit(None).cast("date") for c in spec.dates} | {spec.treatment: (F.col("patid") % 2).cast("int"), spec.outcome: (F.col("patid") % 3 == 0).cast("int")}
    df = gaps(spark, f"{tmp_path}/gaps").filter("patid is not null").select(*KEYS, *numbers).withColumns(columns)
    df = df.withColumns({c: F.lit(0) for c in spec.columns if c not in df.columns})
    run = imputation.Run(df, 2, 1, 3, spec, f"file://{tmp_path}/run")
    parts = int(spark.conf.get("spark.sql.shuffle.partitions"))
    assert len(run.opened.inputFiles()) >= parts
    run.step(0, 0)
    assert len(run.opened.inputFiles()) >= parts
    assert run.finish().count() == 2 * df.count()


def test_cuts_are_found_in_as_many_steps_as_they_need(spark):
    rng = np.random.default_rng(3)
    rows = [(float(x), sorted(rng.integers(0, 9, rng.integers(0, 12)).astype(float).tolist())) for x in rng.integers(0, 9, 300)]
    df = spark.createDataFrame(rows, "s double, __cuts array<double>")
    found = df.select(ordering._cuts_before("s", "<", 12).alias("below"), ordering._cuts_before("s", "<=", 12).alias("upto")).collect()
    assert [tuple(r) for r in found] == [(bisect_left(c, x), bisect_right(c, x)) for x, c in rows]
    assert "32" not in str(ordering._cuts_before("s", "<", 12))


def arms(spark, n, seed=1):
    rng = np.random.default_rng(seed)
    t, g, q0 = rng.integers(0, 2, n).astype(float), rng.uniform(0.2, 0.8, n), rng.uniform(0.1, 0.4, n)
    pdf = pd.DataFrame({"group": rng.integers(1, 3, n), "depth": rng.integers(1, 3, n), "row": rng.integers(-(2**62), 2**62, n), "t": t})
    pdf = pdf.assign(y=(rng.random(n) < q0).astype(float), g=g, q0=q0, q1=q0 * 0.9)
    return spark.createDataFrame(pdf).withColumns({c: F.col(c).cast("int") for c in ("group", "depth")})


def test_an_estimate_alone_deals_no_draws(spark, monkeypatch):
    df = arms(spark, 4000)
    want = [r[:4] for r in tmle.fluctuation(df, [1, 2], (0.01, 0.02), 20)]

    def dealt(*_):
        raise AssertionError

    monkeypatch.setattr(tmle, "with_draws", dealt)
    assert [r[:4] for r in tmle.fluctuation(df, [1, 2], (0.01, 0.02), 0)] == want and all(r[2] is not None for r in want)


def test_replicates_take_one_pass_where_that_is_exact_enough(spark, monkeypatch):
    df = arms(spark, 30_000).persist()
    passes = []
    plain = tmle._sums
    monkeypatch.setattr(tmle, "_sums", lambda rows, eps, replicates, *more: passes.append(replicates) or plain(rows, eps, replicates, *more))
    quick = tmle.fluctuation(df, [1, 2], (0.01, 0.02), 60)
    assert set(passes) == {0}
    monkeypatch.setattr(tmle, "_replicates", lambda *_: {})
    slow = tmle.fluctuation(df, [1, 2], (0.01, 0.02), 60)
    assert 60 in passes and len(quick) == 4
    for a, b in zip(quick, slow, strict=True):
        assert a[:4] == b[:4] and a[5] == b[5] == "ok" and a[4] == pytest.approx(b[4], rel=2e-3)


def test_counts_in_windows_do_not_fan_out(spark):
    """Each person-trial adds up its patient's slots, also where keys repeat or are null and measures have no name."""
    cal = TrialCalendar(tt.SPEC)
    days = [date(1994, 1, 5), date(1995, 6, 5), date(1995, 6, 20), date(1996, 2, 3), date(1997, 12, 30)]
    rows = [(k, day, m, k * 10) for k in (1, 2, 3) for day in days for m in ("bmi", "sbp", None) if (k, m) != (2, "sbp")] + [(None, days[1], "bmi", 9), (1, None, "bmi", 8)]
    measured = spark.createDataFrame(rows, "patid long, eventdate date, measure_name string, event_id long")
    people = spark.createDataFrame([(1,), (2,), (2,), (4,), (None,)], "patid long").select("patid", F.inline(cal.trials()))
    out = measures_in_window(measured, people, cal)
    want = Counter()
    for p in (1, 2, 2):
        mine = Counter()
        for start in cal.starts:
            lo, hi = cal.bounds(start)["measures"]
            mine.update((p, start, m) for k, day, m, _ in rows if k == p and day is not None and lo <= day < hi)
        want.update((*k, n) for k, n in mine.items())
    assert Counter(map(tuple, out.collect())) == want
    plan = out._jdf.queryExecution().executedPlan().toString()
    assert "hashpartitioning(patid" in plan and not re.search(r"hashpartitioning\([^)]*trial_start", plan)


def test_patients_are_dealt_to_all_tasks(spark):
    assert tt.patients(spark, "/root/testdata/sf0.001").rdd.getNumPartitions() >= int(spark.conf.get("spark.sql.shuffle.partitions"))
