"""Registered queries against the second engine on the smallest data.

``EQUISCAN_ALL=1`` runs all of them; by default those that only read run, and a few that write.
"""

import os

import pytest

from conftest import SMALL
from equiscan.checks import job_queries
from equiscan.checks.catalog import REGISTRY
from equiscan.checks.compare import compare, connect

WRITING = {k for k, r in REGISTRY.items() if r.run.__module__ == job_queries.__name__}
SOME = {"upsert", "src_json", "src_ledger", "job_daily_margin", "export_table", "job_weekly",
        "src_csv_gz", "job_run_log", "first_record_wins", "job_daily_bars_bulk"}
KEYS = list(REGISTRY) if os.environ.get("EQUISCAN_ALL") else [k for k in REGISTRY if k not in WRITING or k in SOME]


@pytest.fixture(scope="module")
def con():
    return connect(SMALL)


@pytest.mark.parametrize("key", KEYS)
def test_same_result(spark, desk, con, key):
    state, note = compare(spark, con, SMALL, key)
    assert state == "ok", note


def test_every_query_has_sql():
    assert [k for k, r in REGISTRY.items() if r.sql is None] == []
