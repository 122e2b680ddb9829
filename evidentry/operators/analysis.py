"""Decision and outcome reports, canary comparison, readiness and rollout review."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .. import vocab as V
from ..functions.expr import (count_if, items, micros, optional_class, present, proportion,
                              proportion_difference, rates, same_rates, wilson)
from .linkage import COUNTS

SCORES = ("automation_risk", "abuse_intent_risk", "account_continuity")


@dataclass(frozen=True)
class AnalysisConfig:
    """Readiness thresholds (defaults are fixed values)."""

    min_decisions: int = 1000
    min_label_coverage: float = 0.10
    min_confirmed_humans: int = 100
    min_confirmed_abuse: int = 100
    max_challenge_rate: float = 0.05
    max_challenge_friction: float = 0.10
    min_challenge_results: int = 100
    max_distinct: int = 256
    top_reasons: int = 32

    def __post_init__(self) -> None:
        ok = (0 < self.min_label_coverage <= 1 and 0 < self.max_challenge_rate <= 1
              and 0 < self.max_challenge_friction <= 1 and 16 <= self.max_distinct <= 4096
              and 1 <= self.top_reasons <= self.max_distinct)
        if not ok:
            raise ValueError("analysis thresholds are outside the supported bounds")


def risky(c: str) -> Column:
    return F.col(c).isin(*V.RISKY_ACTIONS)


def decision_summary(d: DataFrame) -> DataFrame:
    """One row: totals by enforced action, computed action and mode."""
    out = [F.count(F.lit(1)).cast("long").alias("decisions")]
    for prefix, column in (("enforced", "action"), ("computed", "computed_action")):
        out += [count_if(F.col(column) == a).alias(f"{prefix}_{a}") for a in V.ACTIONS]
    out += [count_if(F.col("mode") == m).alias(f"mode_{m}") for m in V.MODES]
    out.append(count_if((F.col("mode") == "shadow") & risky("action")).alias("shadow_risky_enforcements"))
    return d.agg(*out).withColumn(
        "computed_challenge_rate", proportion("computed_challenge", "decisions"))


def _kinds(column: str = "outcome") -> list[Column]:
    return [count_if(F.col(column) == o).alias(o) for o in V.OUTCOMES]


def outcome_summary(o: DataFrame, decisions: DataFrame) -> DataFrame:
    """One row: the nine outcome kinds, coverage and challenge failure rate."""
    one = o.agg(F.count(F.lit(1)).cast("long").alias("outcomes"), *_kinds())
    total = decisions.agg(F.count(F.lit(1)).cast("long").alias("decisions"))
    results = F.col("challenge_passed") + F.col("challenge_failed") + F.col("challenge_abandoned")
    failed = F.col("challenge_failed") + F.col("challenge_abandoned")
    n = F.col("decisions")
    share = F.col("outcomes").cast("double") / F.when(n > 0, n).otherwise(1)
    return one.crossJoin(F.broadcast(total)).withColumns({
        "coverage": F.when(n > 0, F.least(F.lit(1.0), share)).otherwise(0.0),
        "challenge_results": results, "challenge_failure_rate": proportion(failed, results)})


def score_summary(d: DataFrame) -> DataFrame:
    """(score, minimum, maximum, mean) of the three scores."""
    aggs = [f(F.col(f"scores.{s}")).alias(f"{s}_{n}") for s in SCORES
            for n, f in (("min", F.min), ("max", F.max), ("avg", F.avg))]
    c = lambda s, n: F.coalesce(F.col(f"{s}_{n}"), F.lit(0.0))
    rows = F.array(*[F.struct(
        F.lit(s).alias("score"), c(s, "min").alias("minimum"), c(s, "max").alias("maximum"),
        F.least(F.greatest(c(s, "avg"), c(s, "min")), c(s, "max")).alias("mean")) for s in SCORES])
    return d.agg(*aggs).select(F.inline(rows))


def endpoint_summary(d: DataFrame, o: DataFrame) -> DataFrame:
    """Per endpoint: decisions, outcomes, risky actions, outcome kinds and seven shares."""
    by = "endpoint_class"
    left = d.groupBy(by).agg(F.count(F.lit(1)).cast("long").alias("decisions"),
                             count_if(risky("computed_action")).alias("computed_risky"))
    right = o.groupBy(by).agg(F.count(F.lit(1)).cast("long").alias("outcomes"), *_kinds())
    df = left.join(right, by, "full_outer").fillna(0)
    c = F.col
    failed = c("challenge_failed") + c("challenge_abandoned")
    results = c("challenge_passed") + failed
    labels = c("human_confirmed") + c("operator_confirmed_abuse")
    return df.select("*", labels.alias("confirmed_labels"), *rates({
        "computed_risky": ("computed_risky", "decisions"),
        "challenge_failure": (failed, results),
        "challenge_abandonment": ("challenge_abandoned", results),
        "fallback_share": ("fallback_used", "outcomes"),
        "appeal_share": ("appeal_requested", "outcomes"),
        "unknown_share": ("unknown", "outcomes"),
        "abuse_label": ("operator_confirmed_abuse", labels)}))


def value_counts(d: DataFrame, column: str) -> DataFrame:
    """(value, n) of a scalar or array column; array items count every time."""
    is_array = d.schema[column].dataType.typeName() == "array"
    values = items(d, F.col(column), "value") if is_array else d.select(F.col(column).alias("value"))
    return (values.groupBy("value").agg(F.count(F.lit(1)).cast("long").alias("n"))
            .filter(F.col("value").isNotNull()))


def enforce_distinct_budget(budget: DataFrame) -> DataFrame:
    """Fail the job when a column has more distinct values than allowed."""
    return budget.withColumn("ok", F.coalesce(F.when(F.col("ok"), F.lit(True)), F.raise_error(
        F.concat(F.lit("too many distinct values: "), F.col("metadata"))).cast("boolean")))


def top_counts(d: DataFrame, column: str, k: int = 32) -> DataFrame:
    """The k most frequent values, ties by value."""
    return value_counts(d, column).orderBy(F.desc("n"), F.asc("value")).limit(k)


def distinct_budget(d: DataFrame, columns: dict[str, str] | tuple[str, ...], limit: int = 256) -> DataFrame:
    """(metadata, distinct_values, allowed, ok) per column."""
    parts = None
    for c in columns:
        one = value_counts(d, c).agg(F.count(F.lit(1)).cast("long").alias("distinct_values"))
        one = one.select(F.lit(c).alias("metadata"), "distinct_values",
                         F.lit(limit).cast("long").alias("allowed"),
                         (F.col("distinct_values") <= limit).alias("ok"))
        parts = one if parts is None else parts.unionByName(one)
    return parts


def canary_comparison(d: DataFrame) -> DataFrame:
    """Per (rollout, endpoint): canary risk against shadow risk on the same endpoint."""
    aggs = [F.count(F.lit(1)).cast("long").alias("n"), count_if(risky("computed_action")).alias("computed"),
            count_if(risky("action")).alias("enforced")]
    by_mode = d.filter(F.col("mode").isin("canary", "shadow")).groupBy(
        "mode", F.when(F.col("mode") == "canary", F.col("rollout_id")).alias("rollout_id"),
        "endpoint_class").agg(*aggs)
    canary = by_mode.filter("mode = 'canary'").drop("mode")
    shadow = by_mode.filter("mode = 'shadow'").select(
        "endpoint_class", F.col("n").alias("_sn"), F.col("computed").alias("_sr"))
    df = canary.join(shadow, "endpoint_class", "left").fillna(0, ["_sn", "_sr"])
    df = df.withColumns({"_s": wilson("_sr", "_sn"), "_c": wilson("computed", "n"),
                         "_e": wilson("enforced", "n")})
    comparable = (F.col("_sn") > 0) & (F.col("n") > 0)
    df = df.withColumn("_d", proportion_difference(F.col("_c"), F.col("_s")))
    diff = lambda f: F.when(comparable, F.col(f"_d.{f}")).otherwise(0.0)
    return df.select(
        "rollout_id", "endpoint_class", comparable.alias("comparable"),
        F.col("_sn").alias("shadow_decisions"), F.col("n").alias("canary_decisions"),
        F.col("_sr").alias("shadow_risky"), F.col("computed").alias("canary_risky"),
        F.col("enforced").alias("canary_enforced"),
        *[F.col(f"{a}.{f}").alias(f"{b}_{f}") for a, b in (
            ("_s", "shadow_risky"), ("_c", "canary_risky"), ("_e", "canary_enforced"))
          for f in ("rate", "lower95", "upper95")],
        diff("estimate").alias("difference_estimate"), diff("lower95").alias("difference_lower95"),
        diff("upper95").alias("difference_upper95"))


# --- readiness -------------------------------------------------------------------------

def report_metrics(summary: DataFrame, linkage: DataFrame, overall: DataFrame) -> DataFrame:
    """One row with everything the readiness rules look at."""
    s = summary.select("decisions", "shadow_risky_enforcements", "computed_challenge_rate")
    coverage = linkage.select("label_coverage_rate")
    c = F.col
    friction = (c("challenge_failed") + c("challenge_abandoned") + c("unresolved_mature_challenges")
                + c("ambiguous_challenge_outcomes"))
    e = overall.select(
        (c("false_positive") + c("true_negative")).alias("linked_humans"),
        (c("true_positive") + c("false_negative")).alias("linked_abuse"),
        "mature_challenges", proportion(friction, c("mature_challenges")).alias("challenge_friction"))
    return s.crossJoin(F.broadcast(coverage)).crossJoin(F.broadcast(e))


def _rules(cfg: AnalysisConfig):
    """(condition, code, priority, metric, observed, threshold, unit) in fixed order."""
    c = F.col
    few = c("mature_challenges") >= cfg.min_challenge_results
    return [
        (c("shadow_risky_enforcements") > 0, "FIX_SHADOW_ENFORCEMENT", "critical",
         "shadow_risky_enforcements", c("shadow_risky_enforcements"), 0, "count"),
        (c("decisions") < cfg.min_decisions, "COLLECT_MORE_DECISIONS", "high", "decisions",
         c("decisions"), cfg.min_decisions, "count"),
        (c("label_coverage_rate") < cfg.min_label_coverage, "IMPROVE_OUTCOME_COVERAGE", "high",
         "linked_label_coverage", c("label_coverage_rate"), cfg.min_label_coverage, "ratio"),
        (c("linked_humans") < cfg.min_confirmed_humans, "EXPAND_CONFIRMED_HUMANS", "high",
         "linked_human_confirmed", c("linked_humans"), cfg.min_confirmed_humans, "count"),
        (c("linked_abuse") < cfg.min_confirmed_abuse, "EXPAND_CONFIRMED_ABUSE", "medium",
         "linked_operator_confirmed_abuse", c("linked_abuse"), cfg.min_confirmed_abuse, "count"),
        (c("computed_challenge_rate") > cfg.max_challenge_rate, "REVIEW_COMPUTED_CHALLENGE_RATE",
         "medium", "computed_challenge_rate", c("computed_challenge_rate"), cfg.max_challenge_rate, "ratio"),
        (few & (c("challenge_friction") > cfg.max_challenge_friction), "REDUCE_CHALLENGE_FRICTION",
         "high", "linked_challenge_friction_rate", c("challenge_friction"), cfg.max_challenge_friction,
         "ratio"),
    ]


STATES = ("invalid_shadow_behavior", "collecting", "needs_labels", "needs_tuning",
          "operator_review_candidate")


def _state(cfg: AnalysisConfig) -> Column:
    fix, more, coverage, humans, abuse, rate, friction = [r[0] for r in _rules(cfg)]
    return (F.when(fix, F.lit(STATES[0])).when(more, F.lit(STATES[1]))
            .when(coverage | humans | abuse, F.lit(STATES[2]))
            .when(rate | friction, F.lit(STATES[3])).otherwise(F.lit(STATES[4])))


def readiness(metrics: DataFrame, cfg: AnalysisConfig = AnalysisConfig()) -> DataFrame:
    """One row: state, operator_action, reasons; enforcement is never automatic."""
    state = _state(cfg)
    return metrics.select(
        state.alias("state"),
        F.when(state == STATES[4], F.lit("review_reversible_canary")).otherwise(F.lit("remain_shadow"))
        .alias("operator_action"),
        present(*[F.when(cond, F.lit(text)) for cond, text, *_ in _rules(cfg)]).alias("reasons"),
        F.lit(False).alias("automatic_enforcement"))


def recommendations(metrics: DataFrame, cfg: AnalysisConfig = AnalysisConfig()) -> DataFrame:
    """Ordered recommendation rows, the final one included."""
    def row(i, text, priority, disposition, metric, observed, threshold, unit) -> Column:
        observed = observed if isinstance(observed, Column) else F.lit(observed)
        return F.struct(
            F.lit(i).alias("position"), F.lit(text).alias("code"), F.lit(priority).alias("priority"),
            F.lit(disposition).alias("disposition"), F.lit(metric).alias("metric"),
            observed.cast("double").alias("observed"), F.lit(float(threshold)).alias("threshold"),
            F.lit(unit).alias("unit"))

    rows = [F.when(cond, row(i, text, priority, "required", metric, observed, threshold, unit))
            for i, (cond, text, priority, metric, observed, threshold, unit) in enumerate(_rules(cfg), 1)]
    ready = _state(cfg) == STATES[4]
    final = ("automatic_enforcement", 0, 0, "boolean")
    rows.append(F.when(ready, row(8, "PREPARE_OPERATOR_REVIEW", "low", "review_candidate", *final))
                .otherwise(row(8, "KEEP_SHADOW_MODE", "high", "hold", *final)))
    return metrics.select(F.inline(present(*rows)))


def decision_holdout_readiness(holdout: DataFrame, min_human: int = 100, min_abuse: int = 100) -> DataFrame:
    """(state, reasons) from the two overall rows of `decision_holdout`."""
    overall = holdout.filter("endpoint_class = 'all'")

    def of(part: str, column: str) -> Column:
        return F.coalesce(F.max(F.when(F.col("partition") == part, F.col(column))), F.lit(0))

    wide = overall.agg(*[of(p, c).alias(f"{p}_{c}") for p in ("baseline", "holdout")
                         for c in ("decisions", "confirmed_human", "confirmed_abuse")])
    tests = [(F.col(f"{p}_decisions") == 0, f"{p}_decisions_missing") for p in ("baseline", "holdout")]
    for p in ("baseline", "holdout"):
        tests.append((F.col(f"{p}_confirmed_human") < min_human, f"{p}_confirmed_human_below_minimum"))
        tests.append((F.col(f"{p}_confirmed_abuse") < min_abuse, f"{p}_confirmed_abuse_below_minimum"))
    reasons = present(*[F.when(cond, F.lit(text)) for cond, text in tests])
    return wide.select(
        F.when(F.size(reasons) == 0, F.lit("chronological_ready"))
        .otherwise(F.lit("insufficient_confirmed_labels")).alias("state"),
        reasons.alias("reasons"), F.lit(False).alias("automatic_enforcement"))


# --- identities --------------------------------------------------------------------------

def check_analysis_report(summary: DataFrame, outcome: DataFrame, endpoints: DataFrame,
                          linkage: DataFrame, slices: DataFrame, canary: DataFrame,
                          budgets: DataFrame, source: DataFrame | None = None,
                          min_window_us: int | None = None) -> DataFrame:
    """(check_name, ok) over the small report tables."""
    def prefixed(df: DataFrame, p: str) -> DataFrame:
        return df.select(*[F.col(c).alias(f"{p}_{c}") for c in df.columns])

    def total(df: DataFrame, columns, p: str) -> DataFrame:
        return df.agg(*[F.coalesce(F.sum(c), F.lit(0)).cast("long").alias(f"{p}_{c}") for c in columns])

    c = F.col
    add = lambda *names: sum((c(n) for n in names), F.lit(0))
    per_endpoint = slices.filter("evaluation_cohort <> 'all'").groupBy("endpoint_class").agg(
        *[F.sum(x).alias(f"s_{x}") for x in COUNTS])
    rolled = (slices.filter("evaluation_cohort = 'all'").join(per_endpoint, "endpoint_class", "full_outer")
              .agg(F.coalesce(F.bool_and(sum(
                  (F.when(c(x).eqNullSafe(c(f"s_{x}")), 0).otherwise(1) for x in COUNTS), F.lit(0)) == 0),
                  F.lit(True)).alias("r_slices")))
    inner = slices.agg(F.coalesce(F.bool_and(
        (add("true_positive", "false_positive", "true_negative", "false_negative") == c("confirmed_labels"))
        & (add("challenge_passed", "challenge_failed", "challenge_abandoned", "fallback_used",
               "unresolved_mature_challenges", "ambiguous_challenge_outcomes") == c("mature_challenges"))
        & (add("confirmed_labels", "ambiguous_ground_truth") <= c("decisions"))), F.lit(True)).alias("r_inner"))
    intervals = endpoints.agg(F.coalesce(F.bool_and(
        (c("computed_risky_lower95") <= c("computed_risky_rate") + 1e-9)
        & (c("computed_risky_rate") <= c("computed_risky_upper95") + 1e-9)
        & (c("computed_risky") <= c("decisions"))), F.lit(True)).alias("r_intervals"),
        F.coalesce(F.bool_and(same_rates({"computed_risky": ("computed_risky", "decisions")})), F.lit(True)).alias("r_rates"))
    one = (prefixed(summary, "d").crossJoin(prefixed(outcome, "o")).crossJoin(prefixed(linkage, "l"))
           .crossJoin(total(endpoints, ("decisions", "outcomes", "computed_risky", *V.OUTCOMES), "e"))
           .crossJoin(total(slices.filter("evaluation_cohort = 'all'"),
                            ("decisions", "confirmed_labels", "ambiguous_ground_truth"), "v"))
           .crossJoin(total(canary, ("canary_decisions",), "c"))
           .crossJoin(canary.agg(F.count(F.lit(1)).alias("c_rows")))
           .crossJoin(budgets.agg(F.count(F.lit(1)).alias("b_rows")))
           .crossJoin(rolled).crossJoin(inner).crossJoin(intervals))
    kinds = [f"o_{x}" for x in V.OUTCOMES]
    checks = {
        "enforced_sum": add(*[f"d_enforced_{a}" for a in V.ACTIONS]) == c("d_decisions"),
        "computed_sum": add(*[f"d_computed_{a}" for a in V.ACTIONS]) == c("d_decisions"),
        "modes_sum": add(*[f"d_mode_{m}" for m in V.MODES]) == c("d_decisions"),
        "shadow_risky_within_shadow": c("d_shadow_risky_enforcements") <= c("d_mode_shadow"),
        "outcome_kinds_sum": add(*kinds) == c("o_outcomes"),
        "endpoint_decisions_sum": c("e_decisions") == c("d_decisions"),
        "endpoint_outcomes_sum": c("e_outcomes") == c("o_outcomes"),
        "endpoint_risky_sum": c("e_computed_risky") == add(*[f"d_computed_{a}" for a in V.RISKY_ACTIONS]),
        "endpoint_kinds_sum": sum((F.when(c(f"e_{x}") == c(f"o_{x}"), 0).otherwise(1)
                                   for x in V.OUTCOMES), F.lit(0)) == 0,
        "decision_records": add("l_unique_decision_ids", "l_duplicate_decision_records") == c("d_decisions"),
        "outcome_records": add("l_outcomes_with_id", "l_outcomes_without_id") == c("o_outcomes"),
        "linked_outcomes": add("l_matched_outcomes", "l_unknown_decision_outcomes",
                               "l_endpoint_mismatch_outcomes") == c("l_outcomes_with_id"),
        "duplicates_within_ids": c("l_duplicate_decision_ids") <= c("l_unique_decision_ids"),
        "evaluated_decisions": c("v_decisions") == c("l_unique_decision_ids") - c("l_duplicate_decision_ids"),
        "evaluated_labels": c("v_confirmed_labels") == c("l_confirmed_labels"),
        "evaluated_ambiguous": c("v_ambiguous_ground_truth") == c("l_ambiguous_ground_truth"),
        "slices_roll_up": c("r_slices"), "evaluation_parts_sum": c("r_inner"),
        "intervals_contain_rates": c("r_intervals"), "rates_recomputed": c("r_rates"),
        "canary_sum": c("c_canary_decisions") == c("d_mode_canary"),
        "budget_per_comparison": c("c_rows") == c("b_rows"),
    }
    if source is not None:
        one = one.crossJoin(prefixed(source, "s"))
        checks["source_counts"] = ((c("s_decisions") == c("d_decisions"))
                                   & (c("s_outcomes") == c("o_outcomes")))
        if min_window_us is not None:
            checks["observation_window"] = c("s_last_us") - c("s_first_us") >= min_window_us
    return one.select(F.inline(F.array(*[
        F.struct(F.lit(n).alias("check_name"), ok.alias("ok")) for n, ok in checks.items()])))


def _checks(one: DataFrame, checks: dict[str, Column]) -> DataFrame:
    """(check_name, ok) from one row; a check that cannot be decided has failed."""
    return one.select(F.inline(F.array(*[
        F.struct(F.lit(n).alias("check_name"), F.coalesce(ok, F.lit(False)).alias("ok")) for n, ok in checks.items()])))


def _every(ok: Column) -> Column:
    return F.coalesce(F.bool_and(F.coalesce(ok, F.lit(False))), F.lit(True))


def check_readiness(summary: DataFrame, linkage: DataFrame, slices: DataFrame, ready: DataFrame, recommended: DataFrame,
                    cfg: AnalysisConfig = AnalysisConfig()) -> DataFrame:
    """(check_name, ok): state, action, reasons and recommendations again from the other published tables.

    A report's own words are never trusted: what `readiness` and `recommendations` would say about the
    published counts must be what the report says, row by row.
    """
    overall = slices.filter("evaluation_cohort = 'all'").agg(*[F.coalesce(F.sum(x), F.lit(0)).cast("long").alias(x) for x in COUNTS])
    metrics = report_metrics(summary, linkage, overall)
    fields = ("position", "code", "priority", "disposition", "metric", "observed", "threshold", "unit")

    def packed(df: DataFrame, name: str) -> DataFrame:
        # eight rows at most
        rounded = [F.round(c, 9).alias(c) if c in ("observed", "threshold") else F.col(c).cast("string").alias(c) for c in fields]
        return df.agg(F.sort_array(F.collect_list(F.struct(*rounded))).alias(name))

    def state(df: DataFrame, p: str) -> DataFrame:
        one = df.select(*[F.struct("state", "operator_action", F.concat_ws(",", "reasons").alias("reasons"), "automatic_enforcement").alias("r")])
        return one.agg(F.count(F.lit(1)).alias(f"{p}_rows"), F.max("r").alias(f"{p}_state"))
    one = (state(ready, "said").crossJoin(state(readiness(metrics, cfg), "found"))
           .crossJoin(packed(recommended, "said_rows_of")).crossJoin(packed(recommendations(metrics, cfg), "found_rows_of")))
    said, found = F.col("said_state"), F.col("found_state")
    return _checks(one, {
        "readiness_is_one_row": F.col("said_rows") == 1, "state_recomputed": said.state.eqNullSafe(found.state),
        "action_recomputed": said.operator_action.eqNullSafe(found.operator_action),
        "reasons_recomputed": said.reasons.eqNullSafe(found.reasons), "never_automatic": ~said.automatic_enforcement,
        "recommendations_recomputed": F.col("said_rows_of").eqNullSafe(F.col("found_rows_of"))})


def check_decision_holdout(holdout: DataFrame, linkage: DataFrame, ready: DataFrame, min_human: int = 100, min_abuse: int = 100) -> DataFrame:
    """(check_name, ok) over the published tables of a decision holdout.

    Partitions must add up to the linkage, parts to their partition, slices to the overall row, and the
    readiness must follow from the overall rows.
    """
    c = F.col
    add = lambda *names: sum((c(n) for n in names), F.lit(0))
    whole, parts = holdout.filter("endpoint_class = 'all'"), holdout.filter("endpoint_class <> 'all'")
    sums = whole.agg(F.count(F.lit(1)).alias("n_whole"), F.count_distinct("partition").alias("n_partitions"), *[F.sum(x).alias(f"w_{x}") for x in COUNTS],
                     _every(c("partition").isin("baseline", "holdout")).alias("known"))
    rows = holdout.agg(
        _every(add("true_positive", "false_positive", "true_negative", "false_negative") == c("confirmed_labels")).alias("confusion"),
        _every((c("confirmed_human") == add("false_positive", "true_negative")) & (c("confirmed_abuse") == add("true_positive", "false_negative"))).alias("confirmed"),
        _every((c("unlabeled_decisions") == c("decisions") - c("confirmed_labels") - c("ambiguous_ground_truth")) & (c("unlabeled_decisions") >= 0)).alias("unlabeled"),
        _every(add("challenge_passed", "challenge_failed", "challenge_abandoned", "fallback_used", "unresolved_mature_challenges",
                   "ambiguous_challenge_outcomes") == c("mature_challenges")).alias("challenges"),
        _every(F.least(*COUNTS) >= 0).alias("counts"))
    rolled = parts.groupBy("partition").agg(*[F.sum(x).alias(f"s_{x}") for x in COUNTS])
    rolled = whole.join(rolled, "partition", "left").agg(_every(sum(
        (F.when(c(x) == F.coalesce(c(f"s_{x}"), F.lit(0)), 0).otherwise(1) for x in COUNTS), F.lit(0)) == 0).alias("rolled"))
    keys = parts.groupBy("partition", "endpoint_class", "evaluation_cohort").agg(F.count(F.lit(1)).alias("n")).agg(_every(c("n") == 1).alias("distinct"))
    named = parts.agg(_every(c("endpoint_class").isin(*V.ENDPOINT_CLASSES) & (optional_class("evaluation_cohort") == c("evaluation_cohort"))).alias("named"))
    found = decision_holdout_readiness(holdout, min_human, min_abuse)
    say = lambda df, name: df.agg(F.max(F.struct("state", F.concat_ws(",", "reasons").alias("reasons"), "automatic_enforcement")).alias(name))
    one = (sums.crossJoin(rows).crossJoin(rolled).crossJoin(keys).crossJoin(named).crossJoin(linkage.select([c(x).alias(f"l_{x}") for x in linkage.columns]))
           .crossJoin(say(ready, "said")).crossJoin(say(found, "found")))
    return _checks(one, {
        "two_partitions": (c("n_whole") == 2) & (c("n_partitions") == 2) & c("known"), "counts_not_negative": c("counts"),
        "decisions_are_eligible": c("w_decisions") == c("l_unique_decision_ids") - c("l_duplicate_decision_ids"),
        "labels_are_linked": c("w_confirmed_labels") == c("l_confirmed_labels"),
        "ambiguous_are_linked": c("w_ambiguous_ground_truth") == c("l_ambiguous_ground_truth"),
        "confusion_sums": c("confusion"), "confirmed_sums": c("confirmed"), "unlabeled_rest": c("unlabeled"), "challenge_sums": c("challenges"),
        "slices_roll_up": c("rolled"), "slices_distinct": c("distinct"), "slices_named": c("named"),
        "state_recomputed": c("said.state").eqNullSafe(c("found.state")), "reasons_recomputed": c("said.reasons").eqNullSafe(c("found.reasons")),
        "never_automatic": ~c("said.automatic_enforcement")})


# --- rollout review ------------------------------------------------------------------------

# --- fixed values: review limits -----------------------------------------------------------
MIN_WINDOW_SECONDS = 86_400
MIN_LABELS = 100
MIN_CANARY_DECISIONS = 1000
MIN_MATURE = 100
MIN_COVERAGE, MAX_ABANDONMENT, MAX_FALLBACK = 0.90, 0.10, 0.10


def dominant_version(d: DataFrame, column: str) -> DataFrame:
    """One row (version, n, decisions, ok): the top version if it covers 90 % of decisions."""
    counts = value_counts(d, column)
    best = counts.agg(F.max_by(F.struct("value", "n"), F.struct("n", _descending("value"))).alias("b"),
                      F.coalesce(F.sum("n"), F.lit(0)).cast("long").alias("decisions"))
    total = F.col("decisions")
    enough = F.col("b.n") >= total - F.floor(total / 10.0)
    ok = F.coalesce((total > 0) & enough & F.col("b.value").rlike(V.ROLLOUT_ID), F.lit(False))
    return best.select(F.when(ok, F.col("b.value")).otherwise(F.lit("none")).alias("version"),
                       F.when(ok, F.col("b.n")).otherwise(0).cast("long").alias("n"),
                       "decisions", ok.alias("ok"))


def _descending(column: str) -> Column:
    """A key that orders text descending: complemented bytes with an end mark."""
    hexed = F.concat(F.hex(F.col(column).cast("binary")), F.lit("/"))
    return F.translate(hexed, "/0123456789ABCDEF", "~FEDCBA9876543210")


def recommend_endpoint(endpoints: DataFrame, slices: DataFrame,
                       min_labels: int = MIN_LABELS) -> DataFrame:
    """At most one row: the eligible endpoint with the lowest risky ratio.

    Ratios are compared exactly, as cross products of counts over the nine endpoints.
    """
    labels = slices.filter("evaluation_cohort = 'all'").select(
        "endpoint_class", (F.col("false_positive") + F.col("true_negative")).alias("linked_human"),
        (F.col("true_positive") + F.col("false_negative")).alias("linked_abuse"))
    e = endpoints.join(labels, "endpoint_class").filter(
        F.col("endpoint_class").isin(*V.ROLLOUT_ENDPOINTS) & (F.col("decisions") > 0)
        & (F.col("computed_risky") > 0) & (F.col("linked_human") >= min_labels)
        & (F.col("linked_abuse") >= min_labels)).select(
        "endpoint_class", "decisions", "computed_risky", "linked_human", "linked_abuse")
    wide = lambda c: F.col(c).cast("decimal(19,0)")
    a, b = e.alias("a"), e.alias("b")
    left, right = wide("b.computed_risky") * wide("a.decisions"), wide("a.computed_risky") * wide("b.decisions")
    better = (left < right) | ((left == right) & (
        (F.col("b.decisions") > F.col("a.decisions")) | (
            (F.col("b.decisions") == F.col("a.decisions"))
            & (F.col("b.endpoint_class") < F.col("a.endpoint_class")))))
    return a.join(F.broadcast(b), better, "left_anti")  # at most four rows on each side


def review_gates(ready: DataFrame, source: DataFrame, policy: DataFrame, model: DataFrame,
                 endpoint: DataFrame, stage: str = "canary", canary: DataFrame | None = None,
                 budgets: DataFrame | None = None, predecessor: str = "") -> DataFrame:
    """(position, gate, status, observed, required) of a canary or enforce review."""
    if stage not in ("canary", "enforce") or (stage == "canary") != (predecessor == ""):
        raise ValueError("a canary review has no predecessor, an enforce review needs one")
    text = F.concat
    s = lambda c: F.col(c).cast("string")
    best = endpoint.agg(*[F.first(c).alias(f"e_{c}") for c in endpoint.columns])
    one = (ready.select("state", "operator_action").crossJoin(source.select(
        F.floor((F.col("last_us") - F.col("first_us")) / float(V.MICROS)).alias("window")))
        .crossJoin(policy.select(*[F.col(c).alias(f"p_{c}") for c in policy.columns]))
        .crossJoin(model.select(*[F.col(c).alias(f"m_{c}") for c in model.columns])).crossJoin(best))
    found = F.col("e_endpoint_class").isNotNull()

    def version(p: str) -> tuple[Column, Column]:
        return F.col(f"{p}_ok"), text(s(f"{p}_version"), F.lit(":"), s(f"{p}_n"), F.lit("/"), s(f"{p}_decisions"))

    scope = F.coalesce(text(
        F.col("e_endpoint_class"), F.lit(":risky="), s("e_computed_risky"), F.lit("/"), s("e_decisions"),
        F.lit(",linked_human="), s("e_linked_human"), F.lit(",linked_abuse="), s("e_linked_abuse")), F.lit("none"))
    gates = [
        ("REPORT_READINESS", (F.col("state") == STATES[4])
         & (F.col("operator_action") == "review_reversible_canary"), F.col("state"), STATES[4]),
        ("OBSERVATION_WINDOW", F.col("window") >= MIN_WINDOW_SECONDS, s("window"), str(MIN_WINDOW_SECONDS)),
        ("POLICY_VERSION_DOMINANCE", *version("p"), "single_valid_version>=90%"),
        ("MODEL_VERSION_DOMINANCE", *version("m"), "single_valid_version>=90%"),
        ("ELIGIBLE_ENDPOINT_SCOPE", found, scope,
         "one_public_endpoint_with_risky_shadow_actions,human>=100,abuse>=100"),
    ]
    if stage == "enforce":
        same = F.col("rollout_id") == predecessor
        c = canary.filter(same).select(F.col("endpoint_class").alias("e_endpoint_class"), "canary_decisions")
        b = budgets.filter(same).withColumnRenamed("endpoint_class", "e_endpoint_class").drop("rollout_id")
        one = one.join(c, "e_endpoint_class", "left").join(b, "e_endpoint_class", "left")
        name = F.coalesce("e_endpoint_class", F.lit(""))
        n = F.coalesce("canary_decisions", F.lit(0))
        mature = F.coalesce("mature_challenges", F.lit(0))
        sample = mature >= MIN_MATURE
        zero = lambda c: F.coalesce(F.col(c), F.lit(0.0))
        shown = lambda label, bound, k: F.format_string(
            f"{label}=%.6f,count=%d/%d", zero(bound), F.coalesce(F.col(k), F.lit(0)), mature)
        gates += [
            ("PREDECESSOR_ENDPOINT_CANARY", n >= MIN_CANARY_DECISIONS, text(name, F.lit(":"), n.cast("string")),
             f"same_endpoint_decisions>={MIN_CANARY_DECISIONS}"),
            ("PREDECESSOR_CHALLENGE_SAMPLE", sample, text(name, F.lit(":"), mature.cast("string")),
             f"same_rollout_endpoint_mature_challenges>={MIN_MATURE}"),
            ("CHALLENGE_OUTCOME_COVERAGE_BUDGET", sample & (zero("terminal_coverage_lower95") >= MIN_COVERAGE),
             shown("lower95", "terminal_coverage_lower95", "terminal_outcomes"), f"lower95>={MIN_COVERAGE:.2f}"),
            ("CHALLENGE_ABANDONMENT_BUDGET", sample & (zero("challenge_abandonment_upper95") <= MAX_ABANDONMENT),
             shown("upper95", "challenge_abandonment_upper95", "challenge_abandoned"),
             f"upper95<={MAX_ABANDONMENT:.2f}"),
            ("CHALLENGE_FALLBACK_BUDGET", sample & (zero("fallback_upper95") <= MAX_FALLBACK),
             shown("upper95", "fallback_upper95", "fallback_used"), f"upper95<={MAX_FALLBACK:.2f}"),
        ]
    rows = F.array(*[F.struct(
        F.lit(i).alias("position"), F.lit(g).alias("gate"),
        F.when(F.coalesce(ok, F.lit(False)), F.lit("pass")).otherwise(F.lit("hold")).alias("status"),
        seen.alias("observed"), F.lit(required).alias("required"))
        for i, (g, ok, seen, required) in enumerate(gates, 1)])
    return one.select(F.inline(rows))


def review_proposal(gates: DataFrame, endpoint: DataFrame, stage: str = "canary") -> DataFrame:
    """One row: state and, when no gate holds, the recommended scope."""
    ok = gates.agg(F.bool_and(F.col("status") == "pass").alias("_ok"))
    best = endpoint.agg(F.first("endpoint_class").alias("_e"))
    give = lambda v: F.when(F.col("_ok"), F.lit(v))
    return ok.crossJoin(best).select(
        F.when(F.col("_ok"), F.lit("review_candidate")).otherwise(F.lit("hold")).alias("state"),
        F.when(F.col("_ok"), F.col("_e")).alias("endpoint_class"), give("challenge").alias("max_action"),
        give(100 if stage == "canary" else 10_000).alias("basis_points"),
        give(86_400 if stage == "canary" else 43_200).alias("duration_seconds"),
        F.lit(False).alias("automatic_activation"))


def last_time(*frames: DataFrame, time: str = "recorded_at") -> DataFrame:
    """One row `last_us`: the latest time over all frames."""
    parts = [f.agg(F.max(micros(time)).alias("t")) for f in frames]
    both = parts[0]
    for p in parts[1:]:
        both = both.unionByName(p)
    return both.agg(F.max("t").alias("last_us"))
