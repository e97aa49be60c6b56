"""Every registered plan against its SQL, and the physical shape of the plans."""

import sys
from pathlib import Path

import pytest

sys.path.insert(0, str(Path(__file__).resolve().parent.parent))

import __spark_entry__ as spark_entry
from tritempo.plans.registry import ORACLES, QUERIES
from tools.check_oracles import compare, connect

NAMES = sorted(QUERIES)


@pytest.fixture(scope="module")
def duck(sf):
    return connect(sf)


def test_every_plan_has_sql():
    assert set(ORACLES) == set(NAMES)
    assert set(NAMES) <= set(spark_entry.queries())


@pytest.mark.parametrize("name", NAMES)
def test_plan_agrees_with_sql(spark, duck, sf, name):
    assert compare(spark, duck, name, sf) == ""


def test_entry_runs(spark):
    result = spark_entry.entry(spark)
    rows = [(row.ReferenceTime, row.DeliveryBucket) for row in result.collect()]
    assert rows and rows == sorted(rows)


@pytest.mark.parametrize("name", [name for name in NAMES if name.startswith("sort_")])
def test_sorted_plans_are_sorted(spark, sf, name):
    leading = {"sort_output": ["ReferenceTime", "DeliveryStart"], "sort_aggregated": ["ReferenceTime", "DeliveryBucket"],
               "sort_versioned": ["Identifier", "ReferenceTime"],
               "sort_mapped": ["Identifier", "ReferenceTime", "DeliveryStart", "DeliveryEnd"]}[name]
    keys = [tuple(row[key] for key in leading) for row in spark_entry.queries()[name](spark, sf).collect()]
    assert keys == sorted(keys)


@pytest.mark.parametrize("name", NAMES)
def test_plan_shape(spark, sf, physical_plan, name):
    text = physical_plan(spark_entry.queries()[name](spark, sf))
    for unwanted in ("PythonUDF", "ArrowEvalPython", "BatchEvalPython", "CartesianProduct", "BroadcastNestedLoopJoin"):
        assert unwanted not in text
    assert "SinglePartition" not in text


@pytest.mark.parametrize("name", ["rank_first", "rank_open", "hybrid_union", "catalog_scan", "archive_rows", "latest_global_recent"])
def test_jobs_of_planning_gather_no_rows(spark, sf, name, monkeypatch):
    """While a plan is being built only counts and sums, never rows, meet in one task."""
    frame, seen = type(spark.range(1)), []

    def watched(method):
        def call(self, *args, **kwargs):
            seen.append((method.__name__, self._jdf.queryExecution().executedPlan().toString()))
            return method(self, *args, **kwargs)

        return call

    for method in ("count", "collect", "checkpoint", "isEmpty", "head"):
        monkeypatch.setattr(frame, method, watched(getattr(frame, method)))
    QUERIES[name](spark, sf)
    assert sum(kind == "checkpoint" for kind, _ in seen) == (0 if name.startswith("rank") else 1)
    for _, text in seen:
        assert "LocalLimit" not in text
        assert "SinglePartition" not in text or "partial_" in text


@pytest.mark.parametrize("name, pushed", [
    ("filter_interval", "GreaterThanOrEqual(l_shipdate,1997-12-31T23:00)"),
    ("filter_numeric", "GreaterThanOrEqual(l_extendedprice,50000.5)"),
    ("filter_text", "EqualTo(l_returnflag,R)"),
    ("filter_lite_range", "GreaterThanOrEqual(ts,2024-01-05T12:00)"),
    ("prune_quote_index", "GreaterThanOrEqual(l_shipdate,1998-06-01T00:00)"),
])
def test_filters_reach_the_scan(spark, sf, name, pushed):
    plan = spark_entry.queries()[name](spark, sf)._jdf.queryExecution().executedPlan().toString()
    formatted = spark_entry.queries()[name](spark, sf)._jdf.queryExecution().explainString(
        spark._jvm.org.apache.spark.sql.execution.ExplainMode.fromString("formatted"))
    assert pushed in formatted or pushed in plan


def test_scans_read_only_needed_columns(spark, sf):
    formatted = spark_entry.queries()["filter_limits"](spark, sf)._jdf.queryExecution().explainString(
        spark._jvm.org.apache.spark.sql.execution.ExplainMode.fromString("formatted"))
    assert "ReadSchema: struct<l_orderkey:bigint,l_suppkey:bigint,l_shipdate:timestamp_ntz>" in formatted
