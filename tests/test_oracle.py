"""Registered queries against the same query in another SQL engine, on whole tables."""

import duckdb
import pytest

from trialweave.catalog import ORACLE, QUERIES

SF_DIR = "/root/testdata/sf0.001"
# One per kind of operator; the driver checks all of them.
KEYS = [
    "s2_measure_union", "s4_glob_scan", "s6_completed_sets", "s10_report", "p3_months_since_diagnosis", "p14_factor_levels",
    "t3_whole_cohort", "j1_measures_in_window", "j2_drugs_in_window", "j7_latest_measure", "j8_nearest_match",
    "a1_distinct_use", "a6_quantiles", "w1_last_per_month", "e4_propensity_one_feature", "e6_trimmed_rows",
    "e7_cox_weighted", "e10_fold_sizes", "e13_fluctuation", "e17_pooling", "m3_method_map", "m4_first_fill",
    "m5_nearest_donors", "m5_matched_draw", "p4_subtype_filter", "p12_coerce", "e8_psm_without_pairs", "r4_person_periods", "r5_first_event",
]


@pytest.fixture(scope="module")
def con():
    c = duckdb.connect()
    for t in ("customer", "nation", "region", "orders", "lineitem"):
        c.execute(f"create view {t} as select * from '{SF_DIR}/{t}.parquet'")
    return c


def plain(rows, columns):
    order = sorted(range(len(columns)), key=lambda i: columns[i])
    return sorted(tuple(str(r[i]) for i in order) for r in rows)


@pytest.mark.parametrize("key", KEYS)
def test_matches_sql(spark, con, key):
    df = QUERIES[key](spark, SF_DIR)
    got = con.execute(ORACLE[key])
    names = [c[0] for c in got.description]
    assert sorted(df.columns) == sorted(names)
    assert plain(df.collect(), df.columns) == plain(got.fetchall(), names)


def test_every_oracle_has_a_query():
    assert set(ORACLE) <= set(QUERIES)
