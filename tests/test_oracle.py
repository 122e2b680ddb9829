"""Registered queries must match their oracle SQL.

The default run takes some queries of every group; EVIDENTRY_ALL_QUERIES=1 takes all of them
(several minutes). `tests/compare.py` does the same outside pytest, for any data set.
"""

from __future__ import annotations

import os

import pytest

from compare import compare, duck
from evidentry.plans import catalog, oracle

QUERIES, SQL = catalog.QUERIES, {name: oracle.sql(text) for name, text in oracle.QUERIES.items()}
GROUPS = ("a7_scan_budget", "a8_validate_decision_request", "b2_pseudonymise", "c2_session_features", "c5_verified_event_count",
          "c6_redeem_decoys", "c8_burst_signals", "c8_decoy_signals", "c8_user_detector", "c14_verified_crawler",
          "c16_assemble_decisions", "c24_audit_single_use", "c26_issuer_trust", "c27_challenge_lifecycle",
          "d3_response_cost", "e10_sequence_report", "e11_peak_active", "f6_rule_confusion", "g10_evaluation_slices",
          "h5_accept_coverage", "h6_coverage_state", "h10_nearest_rank", "j3_stream_single_use", "j4_stream_windows",
          "j10_route_late")
ALL = bool(os.environ.get("EVIDENTRY_ALL_QUERIES"))
NAMES = sorted(QUERIES) if ALL else GROUPS


@pytest.fixture(scope="module")
def con(sf):
    return duck(sf)


@pytest.mark.parametrize("name", NAMES)
def test_query(spark, con, sf, name):
    problem = compare(spark, con, name, QUERIES[name], SQL.get(name), sf)
    assert problem is None, problem


def test_every_query_has_an_oracle():
    assert set(SQL) == set(QUERIES)


def test_entry(spark):
    import __spark_entry__ as entry

    df = entry.entry(spark)
    assert df.columns == ["endpoint_class", "computed_action", "decisions", "max_requests"] and df.count() > 0
