"""Registered queries against their checking SQL on the smallest tables; queries without SQL must run.

The headline queries run by default; ``ORACLE_ALL=1`` runs every registered one (about six minutes).
"""

from __future__ import annotations

import os

import pytest

import __spark_entry__ as entry
import bench
from oracle import compare, connect

FOLDER = "/root/testdata/sf0.001"
QUERIES, ORACLES = entry.queries(), entry.oracle_sql()


@pytest.fixture(scope="module")
def con():
    return connect(FOLDER)


NAMES = sorted(QUERIES) if os.environ.get("ORACLE_ALL") else [n for n in bench.HEADLINE if n in QUERIES]


def test_registry_is_consistent():
    assert set(ORACLES) <= set(QUERIES) and set(bench.HEADLINE) <= set(QUERIES)


@pytest.mark.parametrize("name", NAMES)
def test_query(spark, con, name):
    ok, note, _ = compare(spark, con, name, QUERIES[name], ORACLES.get(name), FOLDER)
    assert ok, note


def test_entry_runs(spark):
    report = entry.entry(spark)
    assert report.count() > 0 and report.columns[0] == "rank"
