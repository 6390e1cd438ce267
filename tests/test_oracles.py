"""Registered queries against their SQL on the smallest tables, and what their plans may not hold."""

import os

import duckdb
import pytest

import __spark_entry__ as entry
import check
from workload.bindings import REGISTRY

SF = "/root/testdata/sf0.001"
pytestmark = pytest.mark.skipif(not os.path.isdir(SF), reason="test tables are not here")


@pytest.fixture(scope="module")
def con():
    c = duckdb.connect()
    for name in check.TABLES:
        c.sql(f"CREATE VIEW {name} AS SELECT * FROM '{SF}/{name}.parquet'")
    return c


# One or two per area; ``python check.py`` runs all of them.
SAMPLE = [
    "evaluate_items", "threshold_sweep", "best_threshold", "bootstrap_ci", "distance_transform",
    "skeleton", "patch_batches", "make_folds", "worst_images", "reportability", "data_hash",
]


@pytest.mark.parametrize("name", SAMPLE)
def test_query_equals_its_sql(spark, con, name):
    assert check.compare(spark, con, SF, name).startswith("ok")


def test_every_query_has_its_sql():
    assert set(REGISTRY) <= set(entry.oracle_sql())


def test_entry(spark):
    assert entry.entry(spark).count() > 0


@pytest.mark.parametrize(
    "name", ["evaluate_items", "threshold_sweep", "distance_transform", "patch_crop", "tile_windows", "reportability"]
)
def test_plans_pair_no_rows_without_a_key(spark, name):
    plan = entry.queries()[name](spark, SF)._jdf.queryExecution().executedPlan().toString()
    assert "CartesianProduct" not in plan and "BroadcastNestedLoopJoin" not in plan
