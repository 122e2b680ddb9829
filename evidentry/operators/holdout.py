"""Chronological and unseen-family holdout evaluation of activity windows."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .. import vocab as V
from ..functions.expr import concat_bytes, count_if, first_reason, present, rates, same_rates, utf8
from .contracts import valid_reference
from .windows import ENDPOINT_SEEN, KEY, LABELS

PARTITIONS = ("baseline", "holdout", "unseen_family_holdout")
# --- fixed values: diagnostic rules ------------------------------------------------------
RULES = ("burst_behavior", "automation_high", "abuse_intent_high", "active_decoy",
         "combined_candidate")
FAMILY_VERSION = "evidentry.family-annotation.v1"
SEQUENCE_LABEL, FAMILY_LABEL = b"evidentry-sequence-key-v1\0", b"evidentry-family-v1\0"


def _digest(label: bytes, text: Column) -> Column:
    return F.sha2(concat_bytes(F.lit(bytearray(label)), utf8(text)), 256)


def sequence_digest(key: Column, label: bytes = SEQUENCE_LABEL) -> Column:
    return _digest(label, key)


def family_reason(version: str = FAMILY_VERSION) -> Column:
    """Why an annotation breaks its contract, else NULL. An id is 32 bytes in base64url."""
    ref = F.col("family_ref")
    return first_reason(
        (F.col("schema_version") == version, "schema_version"),
        (F.col("sequence_kind").isin("subject", "session"), "sequence_kind"),
        (F.col("sequence_id").rlike(r"^[A-Za-z0-9_-]{43}$"), "sequence_id"),
        (F.octet_length(ref).between(1, 256) & valid_reference(ref), "family_ref"))


def load_families(df: DataFrame, reason: Column | None = None, sequence_label: bytes = SEQUENCE_LABEL,
                  family_label: bytes = FAMILY_LABEL) -> tuple[DataFrame, DataFrame]:
    """(families: sequence_digest -> family_digest, quarantine).

    An annotation that breaks the contract and every sequence assigned more than once
    go to quarantine; the caller decides whether that is an error.
    """
    reason = family_reason() if reason is None else reason
    digest = sequence_digest(F.concat_ws(":", "sequence_kind", "sequence_id"), sequence_label)
    marked = df.withColumns({"reason": reason, "sequence_digest": digest,
                             "family_digest": _digest(family_label, F.col("family_ref"))})
    good = marked.filter("reason IS NULL")
    one = good.groupBy("sequence_digest").agg(
        F.count(F.lit(1)).alias("_n"), F.min("family_digest").alias("family_digest"))
    families = one.filter("_n = 1").drop("_n")
    twice = (one.filter("_n > 1").select("sequence_digest", F.col("_n").alias("records"),
                                         F.lit("duplicate_sequence").alias("reason")))
    broken = marked.filter("reason IS NOT NULL").groupBy("sequence_digest", "reason").agg(
        F.count(F.lit(1)).alias("records"))
    return families, twice.unionByName(broken)


def split_windows(windows: DataFrame, cutoff_us: Column | int) -> DataFrame:
    """Add `part`: baseline, holdout or boundary (crosses the cutoff)."""
    cutoff = F.lit(cutoff_us) if isinstance(cutoff_us, int) else cutoff_us
    return windows.withColumn(
        "part", F.when(F.col("last_us") < cutoff, F.lit("baseline"))
        .when(F.col("first_us") >= cutoff, F.lit("holdout")).otherwise(F.lit("boundary")))


def attach_families(windows: DataFrame, families: DataFrame) -> DataFrame:
    """Add `family` (NULL when the sequence is not annotated)."""
    w = windows.withColumn("sequence_digest", sequence_digest(F.col(KEY)))
    return w.join(families.withColumnRenamed("family_digest", "family"), "sequence_digest", "left")


def unseen_families(windows: DataFrame) -> DataFrame:
    """Holdout families that no baseline window has (one row each)."""
    by_part = windows.filter(F.col("family").isNotNull()).groupBy("family").agg(
        F.max(F.when(F.col("part") == "baseline", 1).otherwise(0)).alias("_b"),
        F.max(F.when(F.col("part") == "holdout", 1).otherwise(0)).alias("_h"))
    return by_part.filter("_h = 1 AND _b = 0").select("family")


def mark_unseen(windows: DataFrame) -> DataFrame:
    """Add `unseen`: a holdout window of an unseen family."""
    marks = unseen_families(windows).withColumn("_unseen", F.lit(True))
    unseen = (F.col("part") == "holdout") & F.coalesce(F.col("_unseen"), F.lit(False))
    return windows.join(marks, "family", "left").withColumn("unseen", unseen).drop("_unseen")


def rule_columns() -> dict[str, Column]:
    burst = F.col("burst_shape").isin("clustered", "high_rate")
    automation, intent = F.col("automation") == 3, F.col("abuse_intent") == 3
    decoy = F.col("decoy") >= 2
    return dict(zip(RULES, (burst, automation, intent, decoy, burst | automation | intent | decoy)))


def rule_matches(windows: DataFrame) -> DataFrame:
    """One row per (window, rule) with `flagged`."""
    rows = F.array(*[F.struct(F.lit(r).alias("rule"), c.alias("flagged"))
                     for r, c in rule_columns().items()])
    return windows.select("*", F.inline(rows))


def rule_confusion(windows: DataFrame) -> DataFrame:
    """Flagged/unflagged counts per (partition, endpoint or `all`, rule), with rates.

    Windows collapse to at most a few thousand feature combinations before they are
    repeated per endpoint and rule, so the repetition does not multiply the data.
    """
    rules = rule_columns()
    feature = windows.select("part", "unseen", "label", *ENDPOINT_SEEN,
                             *[c.alias(r) for r, c in rules.items()])
    combos = feature.filter("part <> 'boundary'").groupBy(
        "part", "unseen", "label", *ENDPOINT_SEEN, *RULES).agg(F.count(F.lit(1)).alias("_n"))
    parts = F.when(F.col("unseen"), F.array(F.col("part"), F.lit(PARTITIONS[2]))).otherwise(
        F.array("part"))
    scopes = F.concat(F.array(F.lit("all")), present(*[
        F.when(F.col(s), F.lit(e)) for s, e in zip(ENDPOINT_SEEN, V.LOCAL_ENDPOINTS)]))
    rows = F.array(*[F.struct(F.lit(r).alias("rule"), F.col(r).alias("flagged")) for r in RULES])
    long = (combos.withColumn("partition", F.explode(parts)).withColumn("endpoint_class", F.explode(scopes))
            .select("partition", "endpoint_class", "label", "_n", F.inline(rows)))
    sums = [F.coalesce(F.sum(F.when(
        (F.col("flagged") if f == "flagged" else ~F.col("flagged")) & (F.col("label") == label),
        F.col("_n"))), F.lit(0)).cast("long").alias(f"{f}_{label}")
        for f in ("flagged", "unflagged") for label in LABELS]
    counted = long.groupBy("partition", "endpoint_class", "rule").agg(*sums)
    full = scaffold(windows).join(counted, ["partition", "endpoint_class", "rule"], "left").fillna(0)
    return full.select("*", *rates(_rule_rates()))


def _rule_rates() -> dict:
    total = lambda label: F.col(f"flagged_{label}") + F.col(f"unflagged_{label}")
    return {"human_flag": ("flagged_human_confirmed", total("human_confirmed")),
            "abuse_capture": ("flagged_operator_confirmed_abuse", total("operator_confirmed_abuse")),
            "unknown_flag": ("flagged_unknown", total("unknown"))}


def scaffold(df: DataFrame) -> DataFrame:
    """Every (partition, endpoint or `all`, rule): 3 x 8 x 5 constant rows."""
    rows = [(p, e, r) for p in PARTITIONS for e in ("all", *V.LOCAL_ENDPOINTS) for r in RULES]
    return df.sparkSession.createDataFrame(rows, "partition string, endpoint_class string, rule string")


def holdout_report(windows: DataFrame) -> DataFrame:
    """One row: partition sizes, labels, collection and family counts."""
    part, label = F.col("part"), F.col("label")
    annotated = F.col("family").isNotNull()
    used = part != "boundary"
    abuse = label == "operator_confirmed_abuse"
    scopes = {"baseline": part == "baseline", "holdout": part == "holdout",
              "unseen": F.col("unseen"), "boundary": part == "boundary"}
    columns = [count_if(F.lit(True)).alias("windows"),
               F.coalesce(F.sum("events"), F.lit(0)).cast("long").alias("events"),
               count_if(annotated).alias("annotated_windows"),
               count_if(~annotated).alias("unannotated_windows"),
               count_if(annotated & abuse & used).alias("annotated_abuse_windows"),
               count_if(~annotated & abuse & used).alias("unannotated_abuse_windows"),
               F.count_distinct(F.when(part == "baseline", F.col("family"))).alias("baseline_families"),
               F.count_distinct(F.when(part == "holdout", F.col("family"))).alias("holdout_families"),
               F.count_distinct(F.when(F.col("unseen"), F.col("family"))).alias("unseen_families")]
    for name, cond in scopes.items():
        columns.append(count_if(cond).alias(f"{name}_windows"))
        columns.append(F.coalesce(F.sum(F.when(cond, F.col("events"))), F.lit(0)).cast("long")
                       .alias(f"{name}_events"))
        columns.append(count_if(cond & F.col("collection_issue")).alias(f"{name}_with_artifact"))
        columns += [count_if(cond & (label == v)).alias(f"{name}_{v}") for v in LABELS]
    return windows.agg(*columns)


def holdout_readiness(report: DataFrame, minimum: int = 100, unseen_minimum: int = 100,
                      annotations_supplied: bool = True) -> DataFrame:
    """(state, reasons) of a one-row `holdout_report`."""
    c = F.col
    low = lambda name: c(name) < minimum
    empty = [(c("baseline_windows") == 0, "baseline_empty"), (c("holdout_windows") == 0, "holdout_empty")]
    labels = [(low(f"{p}_{label}"), f"{p}_confirmed_{short}_below_minimum")
              for p in ("baseline", "holdout")
              for label, short in (("human_confirmed", "human"), ("operator_confirmed_abuse", "abuse"))]
    basic = present(*[F.when(cond, F.lit(text)) for cond, text in empty + labels])
    incomplete = c("unannotated_abuse_windows") != 0
    few = c("unseen_operator_confirmed_abuse") < unseen_minimum
    if annotations_supplied:
        family = (F.when(incomplete, F.lit("family_confirmed_abuse_annotations_incomplete"))
                  .when(few, F.lit("unseen_family_confirmed_abuse_below_minimum")))
    else:
        family = F.lit("family_annotations_not_supplied")
    state = (F.when(empty[0][0] | empty[1][0], F.lit("insufficient_chronological_partitions"))
             .when(F.size(basic) > 0, F.lit("insufficient_confirmed_labels"))
             .when(family.isNull(), F.lit("chronological_and_unseen_family_ready"))
             .otherwise(F.lit("chronological_holdout_ready")))
    return report.select(state.alias("state"), F.concat(basic, present(family)).alias("reasons"),
                         F.lit(False).alias("automatic_enforcement"))


def check_holdout_report(report: DataFrame, confusion: DataFrame) -> DataFrame:
    """(check_name, ok): sums to the source, subset rules and recomputed label totals."""
    c = F.col
    plus = lambda suffix, parts: sum((c(f"{p}_{suffix}") for p in parts), F.lit(0))
    three = ("baseline", "holdout", "boundary")
    checks = {
        "windows_sum_to_source": plus("windows", three) == c("windows"),
        "events_sum_to_source": plus("events", three) == c("events"),
        "annotated_plus_unannotated": c("annotated_windows") + c("unannotated_windows") == c("windows"),
        "abuse_split_by_annotation": c("annotated_abuse_windows") + c("unannotated_abuse_windows")
        == c("baseline_operator_confirmed_abuse") + c("holdout_operator_confirmed_abuse"),
        "unseen_families_within_holdout": c("unseen_families") <= c("holdout_families"),
        "unseen_within_holdout": (c("unseen_windows") <= c("holdout_windows"))
        & (c("unseen_events") <= c("holdout_events")),
    }
    for p in ("baseline", "holdout", "unseen", "boundary"):
        checks[f"{p}_labels_sum"] = sum(
            (c(f"{p}_{v}") for v in LABELS), F.lit(0)) == c(f"{p}_windows")
    for v in LABELS:
        checks[f"unseen_{v}_within_holdout"] = c(f"unseen_{v}") <= c(f"holdout_{v}")
    one = report.select(F.inline(F.array(*[
        F.struct(F.lit(n).alias("check_name"), ok.alias("ok")) for n, ok in checks.items()])))
    # Per rule, flagged + unflagged must be the labels of the partition.
    both = {v: F.col(f"flagged_{v}") + F.col(f"unflagged_{v}") for v in LABELS}
    same = confusion.groupBy("partition", "endpoint_class").agg(
        *[(F.min(b) == F.max(b)).alias(v) for v, b in both.items()])
    rules = same.agg(F.bool_and(F.expr(" AND ".join(LABELS))).alias("ok")).select(
        F.lit("rules_share_labels").alias("check_name"), "ok")
    in_bounds = confusion.agg(F.bool_and(
        (F.col("human_flag_lower95") <= F.col("human_flag_rate") + 1e-9)
        & (F.col("human_flag_rate") <= F.col("human_flag_upper95") + 1e-9)).alias("ok")).select(
        F.lit("rates_within_intervals").alias("check_name"), "ok")
    # Over all endpoints a partition's labels are the report's, and no endpoint has more than all of them.
    parts = report.select(F.inline(F.array(*[F.struct(
        F.lit(p).alias("partition"), *[c(f"{short}_{v}").alias(f"r_{v}") for v in LABELS])
        for p, short in zip(PARTITIONS, ("baseline", "holdout", "unseen"))])))
    whole = confusion.filter("endpoint_class = 'all'").join(parts, "partition", "full_outer")
    totals = whole.agg(F.coalesce(F.bool_and(sum(
        (F.when(both[v].eqNullSafe(c(f"r_{v}")), 0).otherwise(1) for v in LABELS), F.lit(0)) == 0), F.lit(False)).alias("ok")).select(
        F.lit("labels_are_the_reports").alias("check_name"), "ok")
    cells = [f"{f}_{v}" for f in ("flagged", "unflagged") for v in LABELS]
    most = confusion.filter("endpoint_class = 'all'").select("partition", "rule", *[c(x).alias(f"a_{x}") for x in cells])
    within = confusion.join(most, ["partition", "rule"], "left").agg(F.bool_and(sum(
        (F.when((c(x) >= 0) & (c(x) <= c(f"a_{x}")), 0).otherwise(1) for x in cells), F.lit(0)) == 0).alias("ok")).select(
        F.lit("endpoints_within_all").alias("check_name"), "ok")
    again = confusion.agg(F.bool_and(same_rates(_rule_rates())).alias("ok")).select(
        F.lit("rates_recomputed").alias("check_name"), "ok")
    return one.unionByName(rules).unionByName(in_bounds).unionByName(totals).unionByName(within).unionByName(again)
