"""Sinks: a single trial or data set written again leaves the others' files as they were."""

import os

import pytest
from pyspark.sql import functions as F

from trialweave.sources import storage


def files(path):
    return {f"{d}/{f}": os.stat(f"{d}/{f}").st_mtime_ns for d, _, names in os.walk(path) for f in names if f.endswith(".parquet")}


@pytest.mark.parametrize("column, write, refresh", [
    ("trial_start", storage.write_cohort, storage.refresh_trials), ("imputation", storage.write_completed, storage.refresh_completed),
])
def test_one_part_is_refreshed(spark, tmp_path, column, write, refresh):
    path = f"{tmp_path}/set"
    rows = spark.range(60).select("id", (F.col("id") % 3).cast("int").alias(column))
    write(rows, path)
    before = files(path)
    refresh(rows.filter(F.col(column) == 1).limit(5), path)
    after = files(path)
    kept = {f for f in before if f"{column}=1/" not in f}
    assert kept and all(after.get(f) == before[f] for f in kept) and not {f for f in after if f"{column}=1/" in f} & set(before)
    assert {r[column]: r["count"] for r in spark.read.parquet(path).groupBy(column).count().collect()} == {0: 20, 1: 5, 2: 20}
    refresh(rows.limit(0), path)
    assert spark.read.parquet(path).count() == 45
