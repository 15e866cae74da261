"""Every registered query against its oracle SQL on the smallest data, and its plan."""

from __future__ import annotations

import os

import duckdb
import pytest

import __spark_entry__ as entry
from check_oracle import TABLES, rows_of
from tests.conftest import plan

SF = "/root/testdata/sf0.001"
QUERIES, ORACLE = entry.queries(), entry.oracle_sql()
# These run jobs of their own while the plan is built.
EAGER = ("anomaly_validation", "event_clusters", "cluster_members", "cluster_quality")

pytestmark = pytest.mark.skipif(not os.path.isdir(SF), reason="test tables are not here")


@pytest.fixture(scope="module")
def duck():
    session = duckdb.connect()
    for table in TABLES:
        session.execute(f"CREATE VIEW {table} AS SELECT * FROM '{SF}/{table}.parquet'")
    return session


@pytest.mark.parametrize("name", sorted(ORACLE))
def test_equals_oracle(spark, duck, name):
    frame = QUERIES[name](spark, SF)
    got = rows_of(frame.columns, [tuple(row) for row in frame.collect()])
    result = duck.execute(ORACLE[name])
    columns = [column[0] for column in result.description]
    assert sorted(frame.columns) == sorted(columns)
    assert got == rows_of(columns, result.fetchall())


@pytest.mark.parametrize("name", sorted(set(QUERIES) - set(ORACLE) - {"cluster_quality"}))
def test_runs_without_oracle(spark, name):
    rows = QUERIES[name](spark, SF).count()
    # The smallest data has too few days per country for these two.
    assert rows > 0 or name in ("trend_changes", "forecast_backtest")


@pytest.mark.parametrize("name", sorted(n for n in QUERIES if n not in EAGER and not n.startswith("stream")))
def test_plan_holds_at_scale(spark, name):
    """With broadcasting off no join compares all pairs, and only counted or cut rows meet in one task."""
    settings = {"spark.sql.autoBroadcastJoinThreshold": "-1", "spark.sql.adaptive.enabled": "false"}
    for key, value in settings.items():
        spark.conf.set(key, value)
    try:
        text = plan(QUERIES[name](spark, SF))
    finally:
        for key in settings:
            spark.conf.unset(key)
    for hazard in ("CartesianProduct", "BroadcastNestedLoopJoin", "BroadcastHashJoin"):
        assert hazard not in text
    lines = text.splitlines()
    for at, line in enumerate(lines[:-1]):
        if "Exchange SinglePartition" in line:
            assert "partial_" in lines[at + 1] or "LocalLimit" in lines[at + 1]


def test_entry(spark):
    rows = entry.entry(spark).collect()
    assert 0 < len(rows) <= 5
    assert [r.score for r in rows] == sorted((r.score for r in rows), reverse=True)


def test_names():
    assert set(ORACLE) <= set(QUERIES)
