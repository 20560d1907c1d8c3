"""Registered queries against their SQL. By default a cross-section on the smallest
folder; FIELDLEDGER_ALL=1 runs every query."""
import os

import pytest

import __spark_entry__ as entry
from oracle_check import compare, duck

SF = os.environ.get("FIELDLEDGER_SF", "/root/testdata/sf0.001")
SAMPLE = ["label_lift", "stratified_effect", "label_evidence", "tag_effects", "expected_rate", "rolling_origin_backtest", "rate_summary",
          "conditions_rows", "interval_expand_daily", "coverage_stats", "catch_rows", "label_parse_field", "parse_report_page", "build_units",
          "build_trips", "geo_pick_candidate", "geo_rank_candidates", "waypoint_match", "upsert_latest", "distinctive_phrases", "planner_payload"]
NAMES = sorted(entry.oracle_sql()) if os.environ.get("FIELDLEDGER_ALL") else SAMPLE


@pytest.fixture(scope="module")
def con():
    if not os.path.isdir(SF):
        pytest.skip("no test tables here")
    return duck(SF)


@pytest.mark.parametrize("name", NAMES)
def test_query_equals_sql(spark, con, name):
    _, _, verdict = compare(spark, con, name, entry.queries()[name], entry.oracle_sql()[name], SF)
    assert verdict.startswith("ok"), verdict


def test_registry_is_consistent():
    assert set(entry.oracle_sql()) <= set(entry.queries())


def test_entry(spark):
    if not os.path.isdir("/root/testdata/sf0.001"):
        pytest.skip("no test tables here")
    df = entry.entry(spark)
    assert "lift_lb" in df.columns and df.count() > 0


def test_an_absent_dependency_takes_only_the_optional_part():
    """The entry is imported anew in a process that cannot import one of the optional part's libraries."""
    import subprocess
    import sys
    code = ("import sys; sys.modules['xxhash'] = None; sys.modules['sentencepiece'] = None\n"
            "import __spark_entry__ as e; names = e.queries()\n"
            "assert 'label_lift' in names and not any(n.startswith('op1_') for n in names) and set(e.oracle_sql()) <= set(names)")
    assert subprocess.run([sys.executable, "-c", code], cwd=os.path.dirname(entry.__file__)).returncode == 0
