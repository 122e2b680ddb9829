"""Linking delayed outcomes to decisions and evaluating the linked decisions."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .. import vocab as V
from ..functions.expr import bit, count_if, micros, optional_class, rates

MATURITY_US = 15 * V.MINUTE_US  # fixed value: a challenge is mature after this time
OUTCOME_BITS = {o: 1 << i for i, o in enumerate(V.OUTCOMES)}
HUMAN, ABUSE = OUTCOME_BITS["human_confirmed"], OUTCOME_BITS["operator_confirmed_abuse"]
TERMINAL = sum(OUTCOME_BITS[o] for o in V.TERMINAL_OUTCOMES)

RATES = ("false_positive", "abuse_recall", "abuse_precision", "challenge_pass",
         "challenge_failure", "challenge_abandonment", "fallback")
COUNTS = ("decisions", "confirmed_labels", "true_positive", "false_positive", "true_negative",
          "false_negative", "ambiguous_ground_truth", "mature_challenges", "challenge_passed",
          "challenge_failed", "challenge_abandoned", "fallback_used",
          "unresolved_mature_challenges", "ambiguous_challenge_outcomes")


def link_outcomes(decisions: DataFrame, outcomes: DataFrame) -> DataFrame:
    """One row per decision id that a decision or an outcome names.

    Both sides are aggregated to one small row per id before they meet, with map-side
    combination. So an id that a third of all rows share costs no more than any other,
    and the full outer join is one to one. The result does not depend on row order:
    the first decision is the one with the lowest `ingest_order`.
    """
    attributes = F.struct(
        "endpoint_class", optional_class("evaluation_cohort").alias("evaluation_cohort"),
        micros("recorded_at").alias("recorded_us"),
        F.col("computed_action").isin(*V.RISKY_ACTIONS).alias("predicted_risky"),
        (F.col("action") == "challenge").alias("challenged"), "mode", "rollout_id",
        F.coalesce(F.col("assurance_level").cast("string"), F.lit("unknown")).alias("assurance_level"),
        F.coalesce("assurance_withheld", F.lit(False)).alias("assurance_withheld"))
    d = decisions.groupBy("decision_id").agg(
        F.count(F.lit(1)).alias("decision_records"),
        F.min_by(attributes, "ingest_order").alias("d"))
    o = (outcomes.filter(F.coalesce("decision_id", F.lit("")) != "").groupBy("decision_id").agg(
        F.count(F.lit(1)).alias("outcome_events"),
        F.bit_or(bit("outcome", V.OUTCOMES)).alias("outcome_mask"),
        F.min("endpoint_class").alias("_ep_min"), F.max("endpoint_class").alias("_ep_max")))
    j = d.join(o, "decision_id", "full_outer")
    seen = F.col("d").isNotNull()
    n = F.coalesce("outcome_events", F.lit(0)).cast("long")
    matched = F.coalesce(seen & (F.col("_ep_min") == F.col("_ep_max"))
                         & (F.col("_ep_min") == F.col("d.endpoint_class")), F.lit(False))
    mask = F.coalesce("outcome_mask", F.lit(0))
    return j.select(
        "decision_id", seen.alias("decision_seen"),
        F.coalesce("decision_records", F.lit(0)).cast("long").alias("decision_records"),
        n.alias("outcome_events"), mask.alias("outcome_mask"), matched.alias("matched"),
        (n - F.bit_count(mask)).cast("long").alias("duplicate_outcomes"),
        (seen & (F.col("decision_records") == 1)).alias("eligible"),
        *[F.col(f"d.{c}").alias(c) for c in (
            "endpoint_class", "evaluation_cohort", "recorded_us", "predicted_risky", "challenged",
            "mode", "rollout_id", "assurance_level", "assurance_withheld")])


def linkage_summary(links: DataFrame, outcomes: DataFrame) -> DataFrame:
    """One row: unique/duplicate ids and records, matched/unknown/mismatched outcomes, labels."""
    seen, n = F.col("decision_seen"), F.col("outcome_events")
    total = lambda cond: F.coalesce(F.sum(F.when(cond, n)), F.lit(0)).cast("long")
    truth = F.col("outcome_mask").bitwiseAND(F.lit(HUMAN | ABUSE))
    labelled = F.col("eligible") & F.col("matched")
    one = links.agg(
        count_if(seen).alias("unique_decision_ids"),
        count_if(seen & (F.col("decision_records") > 1)).alias("duplicate_decision_ids"),
        F.coalesce(F.sum(F.when(seen, F.col("decision_records") - 1)), F.lit(0)).cast("long")
        .alias("duplicate_decision_records"),
        total(F.lit(True)).alias("outcomes_with_id"),
        total(seen & F.col("matched")).alias("matched_outcomes"),
        total(~seen).alias("unknown_decision_outcomes"),
        total(seen & ~F.col("matched")).alias("endpoint_mismatch_outcomes"),
        F.coalesce(F.sum("duplicate_outcomes"), F.lit(0)).cast("long").alias("duplicate_outcomes"),
        count_if(labelled & truth.isin(HUMAN, ABUSE)).alias("confirmed_labels"),
        count_if(labelled & (truth == (HUMAN | ABUSE))).alias("ambiguous_ground_truth"))
    legacy = outcomes.agg(count_if(F.coalesce("decision_id", F.lit("")) == "").alias("outcomes_without_id"))
    one = one.crossJoin(F.broadcast(legacy))
    decisions = F.col("unique_decision_ids") + F.col("duplicate_decision_records")
    return one.select("*", *rates({"label_coverage": ("confirmed_labels", decisions)}))


def evaluation_flags(links: DataFrame, last_us: Column | int) -> DataFrame:
    """Eligible links reduced to the flags the evaluation counts."""
    last = F.lit(last_us) if isinstance(last_us, int) else last_us
    mask = F.col("outcome_mask")
    truth = F.when(F.col("matched"), mask.bitwiseAND(F.lit(HUMAN | ABUSE))).otherwise(0)
    terminal = F.when(F.col("matched"), mask.bitwiseAND(F.lit(TERMINAL))).otherwise(0)
    mature = F.col("challenged") & (F.col("recorded_us") <= last - MATURITY_US)
    return links.filter("eligible").withColumns(
        {"_truth": truth, "_terminal": terminal, "_mature": mature})


def _evaluation_counts() -> list[Column]:
    risky, truth, t = F.col("predicted_risky"), F.col("_truth"), F.col("_terminal")
    human, abuse, mature = truth == HUMAN, truth == ABUSE, F.col("_mature")
    one = lambda name: mature & (t == OUTCOME_BITS[name])
    values = (
        F.lit(True), human | abuse, abuse & risky, human & risky, human & ~risky, abuse & ~risky,
        truth == (HUMAN | ABUSE), mature, one("challenge_passed"), one("challenge_failed"),
        one("challenge_abandoned"), one("fallback_used"), mature & (t == 0),
        mature & (F.bit_count(t) > 1))
    return [count_if(v).alias(n) for n, v in zip(COUNTS, values)]


def evaluation_rates(df: DataFrame) -> DataFrame:
    """Add the seven rates with their intervals to evaluation counts."""
    c = F.col
    tp, fp, tn, fn = (c(n) for n in ("true_positive", "false_positive", "true_negative", "false_negative"))
    mature = c("mature_challenges")
    pairs = ((fp, fp + tn), (tp, tp + fn), (tp, tp + fp), (c("challenge_passed"), mature),
             (c("challenge_failed"), mature), (c("challenge_abandoned"), mature), (c("fallback_used"), mature))
    return df.select("*", *rates(dict(zip(RATES, pairs))))


def linked_evaluation(links: DataFrame, keys: Sequence[str], last_us: Column | int) -> DataFrame:
    """Confusion matrix, mature challenge results and rates by any keys (none: overall)."""
    flags = evaluation_flags(links, last_us)
    return evaluation_rates(flags.groupBy(*keys).agg(*_evaluation_counts()))


def evaluation_slices(links: DataFrame, last_us: Column | int) -> DataFrame:
    """Evaluation by (endpoint, cohort) and by endpoint (`evaluation_cohort` is `all`)."""
    flags = evaluation_flags(links, last_us)
    ep, cohort = "endpoint_class", "evaluation_cohort"
    g = flags.groupingSets([[ep, cohort], [ep]], ep, cohort).agg(
        F.grouping(cohort).alias("_all"), *_evaluation_counts())
    g = g.withColumn(cohort, F.when(F.col("_all") == 1, F.lit("all")).otherwise(F.col(cohort)))
    return evaluation_rates(g.drop("_all"))


def assurance_slices(links: DataFrame, last_us: Column | int) -> DataFrame:
    """Evaluation by (endpoint, assurance level or `unknown`, withheld)."""
    return linked_evaluation(links, ("endpoint_class", "assurance_level", "assurance_withheld"), last_us)


def canary_challenge_budget(decisions: DataFrame, links: DataFrame, last_us: Column | int) -> DataFrame:
    """Challenge results per (rollout, endpoint) of every canary decision, zero rows kept."""
    keys = ["rollout_id", "endpoint_class"]
    wanted = decisions.filter("mode = 'canary'").select(*keys).distinct()
    canary = links.filter("mode = 'canary' AND rollout_id IS NOT NULL")
    counts = [c for c in COUNTS if "challenge" in c or c == "fallback_used"]
    e = evaluation_flags(canary, last_us).groupBy(*keys).agg(*_evaluation_counts()).select(*keys, *counts)
    df = wanted.join(e, keys, "left").fillna(0, counts)
    terminal = (F.col("challenge_passed") + F.col("challenge_failed") + F.col("challenge_abandoned")
                + F.col("fallback_used"))
    return df.withColumn("terminal_outcomes", terminal).select("*", *rates({
        "terminal_coverage": ("terminal_outcomes", "mature_challenges"),
        "challenge_abandonment": ("challenge_abandoned", "mature_challenges"),
        "fallback": ("fallback_used", "mature_challenges")}))


def decision_holdout(links: DataFrame, cutoff_us: Column | int, last_us: Column | int) -> DataFrame:
    """Evaluation split by decision time: rows per partition and (partition, endpoint, cohort).

    Overall rows carry `all` as endpoint and cohort. Delayed outcome times never move
    a decision to another partition.
    """
    cutoff = F.lit(cutoff_us) if isinstance(cutoff_us, int) else cutoff_us
    part = F.when(F.col("recorded_us") < cutoff, F.lit("baseline")).otherwise(F.lit("holdout"))
    flags = evaluation_flags(links, last_us).withColumn("partition", part)
    ep, cohort = "endpoint_class", "evaluation_cohort"
    g = flags.groupingSets([["partition", ep, cohort], ["partition"]], "partition", ep, cohort).agg(
        F.grouping(ep).alias("_all"), *_evaluation_counts())
    every = F.col("_all") == 1
    g = g.withColumns({ep: F.when(every, F.lit("all")).otherwise(F.col(ep)),
                       cohort: F.when(every, F.lit("all")).otherwise(F.col(cohort))}).drop("_all")
    # Both overall rows exist even when a partition is empty.
    both = links.sparkSession.createDataFrame(
        [("baseline", "all", "all"), ("holdout", "all", "all")], f"partition string, {ep} string, {cohort} string")
    g = both.join(g, ["partition", ep, cohort], "full_outer").fillna(0, list(COUNTS))
    g = g.withColumns({
        "confirmed_human": F.col("false_positive") + F.col("true_negative"),
        "confirmed_abuse": F.col("true_positive") + F.col("false_negative"),
        "unlabeled_decisions": F.col("decisions") - F.col("confirmed_labels")
        - F.col("ambiguous_ground_truth")})
    return evaluation_rates(g)
