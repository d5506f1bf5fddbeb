"""Registered queries against their SQL on the smallest tables (tools/check.py runs all of them)."""

import os
import re

import duckdb
import pytest

import __spark_entry__ as entry
from fathomset.plans import catalogue

from .compare import TABLES, differences

FOLDER = "/root/testdata/sf0.001"
SAMPLE = ["grouped_kfold", "ovr_scores", "lac_quantile", "log_cpm", "stack_counts", "estimable_pairs", "r2_categorical", "infer_types",
          "bootstrap_weights", "bh_adjust", "map_claims", "per_sample_files", "metric_ledger", "coverage_monitor", "pair_features"]
needs_data = pytest.mark.skipif(not os.path.isdir(FOLDER), reason="the given tables are absent")


@pytest.fixture(scope="module")
def duck():
    con = duckdb.connect()
    for t in TABLES:
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM '{FOLDER}/{t}.parquet'")
    return con


@needs_data
@pytest.mark.parametrize("name", SAMPLE)
def test_matches_sql(spark, duck, name):
    e = catalogue()[name]
    assert not differences(e.run(spark, FOLDER).toPandas(), duck.execute(e.sql).fetch_df())


@needs_data
def test_flagship(spark):
    t = entry.entry(spark).toPandas()
    assert len(t) and t["coverage"].dropna().between(0, 1).all()
    overall = t[t["class"].isna()].sort_values("alpha")
    assert overall["mean_size"].is_monotonic_decreasing  # a larger alpha never gives larger sets


def test_every_entry_names_survey_ids():
    assert all(re.fullmatch(r"([A-Z]{1,2}\d+ ?)+", e.covers) for e in catalogue().values())
    assert set(entry.oracle_sql()) <= set(entry.queries())
