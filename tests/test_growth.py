"""Steps whose work has to grow with their rows only."""

import re

import numpy as np
from pyspark.sql import functions as F

from trialweave.catalog import QUERIES
from trialweave.operators import logistic, prep
from trialweave.study import AnalysisSpec


def test_first_fill_counts_values_before_it_looks_them_up(spark):
    plan = QUERIES["m4_first_fill"](spark, "/root/testdata/sf0.001")._jdf.queryExecution().optimizedPlan().toString()
    assert len(re.findall(r"Aggregate \[name#\d+, value#\d+\]", plan)) == 2


def test_scaled_features_and_predictors_are_those_of_single_terms(spark):
    rng = np.random.default_rng(3)
    rows = [(k % 2 + 1, k % 5, float(rng.normal()), 7) for k in range(50)]
    df = spark.createDataFrame(rows, "imputation int, a int, b double, c int")
    scale = prep.known_moments(df, ["a", "b", "c"], ["imputation"])
    assert "Aggregate" not in scale._jdf.queryExecution().optimizedPlan().toString()
    out = prep.standardised(df, ["a", "b", "c"], ["imputation"], scale=scale).withColumn("w", F.array(F.lit(0.5), F.lit(-2.0), F.lit(3.0), F.lit(0.25)))
    for r in out.withColumn("z", logistic.dot("x", "w", 3)).collect():
        own = np.array([x[1:] for x in rows if x[0] == r.imputation], float)
        sd = own.std(axis=0)
        want = (np.array([r.a, r.b, r.c]) - own.mean(axis=0)) / np.where(sd > 0, sd, 1.0)
        assert np.allclose(r.x, want) and np.isclose(r.z, 0.25 + want @ [0.5, -2.0, 3.0])


def test_analysis_rows_are_kept_before_levels_are_read(spark):
    spec = AnalysisSpec()
    row = {c: 1 for c in spec.columns} | {c: "2000-01-01" for c in (*spec.dates, "trial_start")} | {"enddate": "2001-01-01", "end_followup_date_2y": "2002-01-01"}
    row |= {c: "x" for c in spec.categorical}
    df = spark.createDataFrame([tuple(row[c] for c in spec.columns)], list(spec.columns))
    frame = prep.analysis_frame(df.withColumn("dod", F.lit(None).cast("string")), spec)
    assert "InMemoryRelation" in frame._jdf.queryExecution().withCachedData().toString() and frame.count() == 1
    frame.unpersist()
