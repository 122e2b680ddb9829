"""Every corruption of a published report is named by a check."""

from __future__ import annotations

import pytest
from pyspark.sql import functions as F

from evidentry.functions.timeline import stored
from evidentry.operators import analysis as G, linkage as L
from evidentry.plans import catalog, derived as T


@pytest.fixture(scope="module")
def report(spark, sf):
    d, o = catalog._log(spark, sf)
    links = catalog._stored_links(d, o)
    timed = links.crossJoin(F.broadcast(G.last_time(d, o)))
    middle = d.agg(T.div(F.min(F.unix_micros("recorded_at")) + F.max(F.unix_micros("recorded_at")), 2).alias("cutoff_us"))
    holdout = L.decision_holdout(timed.crossJoin(F.broadcast(middle)), F.col("cutoff_us"), F.col("last_us"))
    metrics = catalog._metrics(d, o, links)
    tables = {"summary": G.decision_summary(d), "linkage": L.linkage_summary(links, o), "slices": L.evaluation_slices(timed, F.col("last_us")),
              "ready": G.readiness(metrics), "recommended": G.recommendations(metrics), "holdout": holdout,
              "holdout_ready": G.decision_holdout_readiness(holdout, 10, 10)}
    small = {}
    for name, df in tables.items():
        small[name] = stored(df.coalesce(1), name)
    return small


def failed(df):
    return {r.check_name for r in df.collect() if not r.ok}


def readiness(t):
    return failed(G.check_readiness(t["summary"], t["linkage"], t["slices"], t["ready"], t["recommended"]))


def holdout(t):
    return failed(G.check_decision_holdout(t["holdout"], t["linkage"], t["holdout_ready"], 10, 10))


def test_sound(report):
    assert readiness(report) == set() == holdout(report)


READY = [
    ("ready", lambda t: t.withColumn("state", F.lit("operator_review_candidate")), "state_recomputed"),
    ("ready", lambda t: t.withColumn("operator_action", F.lit("review_reversible_canary")), "action_recomputed"),
    ("ready", lambda t: t.withColumn("reasons", F.array(F.lit("other"))), "reasons_recomputed"),
    ("ready", lambda t: t.withColumn("automatic_enforcement", F.lit(True)), "never_automatic"),
    ("ready", lambda t: t.union(t), "readiness_is_one_row"),
    ("recommended", lambda t: t.withColumn("observed", F.col("observed") + 1), "recommendations_recomputed"),
    ("recommended", lambda t: t.filter("position <> 8"), "recommendations_recomputed"),
    ("summary", lambda t: t.withColumn("shadow_risky_enforcements", F.lit(5).cast("long")), "state_recomputed"),
    ("slices", lambda t: t.withColumn("false_positive", F.col("false_positive") + 10_000), "recommendations_recomputed")]


@pytest.mark.parametrize("at", range(len(READY)))
def test_readiness_corruptions(report, at):
    table, change, name = READY[at]
    assert name in readiness({**report, table: change(report[table])})


WHOLE = "endpoint_class = 'all' AND partition = 'baseline'"
bump = lambda column, where="true": lambda t: t.withColumn(column, F.col(column) + F.expr(where).cast("int"))
HOLDOUT = [
    ("holdout", lambda t: t.filter(f"NOT ({WHOLE})"), "two_partitions"),
    ("holdout", lambda t: t.withColumn("partition", F.when(F.expr(WHOLE), "other").otherwise(F.col("partition"))), "two_partitions"),
    ("holdout", lambda t: t.withColumn("fallback_used", -1 - F.col("fallback_used")), "counts_not_negative"),
    ("holdout", bump("decisions", WHOLE), "decisions_are_eligible"), ("linkage", bump("unique_decision_ids"), "decisions_are_eligible"),
    ("linkage", bump("confirmed_labels"), "labels_are_linked"), ("linkage", bump("ambiguous_ground_truth"), "ambiguous_are_linked"),
    ("holdout", bump("true_positive", WHOLE), "confusion_sums"), ("holdout", bump("confirmed_human"), "confirmed_sums"),
    ("holdout", bump("unlabeled_decisions", WHOLE), "unlabeled_rest"), ("holdout", bump("mature_challenges", "endpoint_class <> 'all'"), "challenge_sums"),
    ("holdout", bump("challenge_passed", WHOLE), "slices_roll_up"), ("holdout", lambda t: t.union(t.filter("endpoint_class <> 'all'")), "slices_distinct"),
    ("holdout", lambda t: t.withColumn("endpoint_class", F.regexp_replace("endpoint_class", "^other$", "basement")), "slices_named"),
    ("holdout_ready", lambda t: t.withColumn("state", F.concat("state", F.lit("x"))), "state_recomputed"),
    ("holdout_ready", lambda t: t.withColumn("reasons", F.array(F.lit("x"))), "reasons_recomputed"),
    ("holdout_ready", lambda t: t.withColumn("automatic_enforcement", F.lit(True)), "never_automatic")]


@pytest.mark.parametrize("at", range(len(HOLDOUT)))
def test_holdout_corruptions(report, at):
    table, change, name = HOLDOUT[at]
    assert name in holdout({**report, table: change(report[table])})
