"""Activity windows of local evidence: capped sessions, features and reports."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .. import vocab as V
from ..functions.expr import bit, code, count_if, micros
from ..functions.greedy import FEW, greedy_chain
from ..functions.timeline import ROWS_PER_CHUNK, Timeline, before, durable, find_sizes, running, with_heat


@dataclass(frozen=True)
class WindowConfig:
    """Thresholds of windows and burst shapes (fixed values)."""

    inactivity_us: int = 5 * V.MINUTE_US
    max_age_us: int = 15 * V.MINUTE_US
    high_rate_peak: int = 60
    clustered_events: int = 20
    clustered_us: int = V.MINUTE_US
    sustained_events: int = 20
    sustained_us: int = 5 * V.MINUTE_US
    slice_us: int = 60 * V.MINUTE_US
    rows_per_chunk: int = ROWS_PER_CHUNK


KEY = "sequence_key"


def sequence_key(df: DataFrame) -> DataFrame:
    """Add the key: session pseudonym, else subject pseudonym, with its kind."""
    session = F.nullif("session_id", F.lit(""))
    return df.withColumn(KEY, F.coalesce(F.concat(F.lit("session:"), session),
                                         F.concat(F.lit("subject:"), F.col("subject_id"))))


def sequence_windows(df: DataFrame, config: WindowConfig = WindowConfig()) -> DataFrame:
    """Events with `window_us`, the start of their window, and `_prev_endpoint`.

    A window ends at a gap of `inactivity_us` or more, and at the first event
    `max_age_us` or more after its own first event. The second rule is greedy, so it
    is only evaluated for the few stretches that are long enough to need it.
    """
    def stretches(d: DataFrame, line: Timeline) -> DataFrame:
        d = line.run(d, {"_prev_us": before("last", F.col("_us")),
                         "_prev_endpoint": before("last", F.col("endpoint_class"))})
        gap = F.col("_prev_us").isNull() | (F.col("_us") - F.col("_prev_us") >= config.inactivity_us)
        d = d.withColumn("_new", F.when(gap, F.col("_us")))
        # The latest gap is the start of the stretch; it also numbers the stretch.
        return line.run(d, {"stretch_us": running("last", F.col("_new"))}).drop("_new")

    df = df.withColumn("_us", micros("observed_at"))
    big, heat = find_sizes(df, [KEY], min(FEW, config.rows_per_chunk), config.rows_per_chunk)
    df = with_heat(df, [KEY], ["_us", "line_no"], stretches, heat)
    starts = _capped_starts(df, config, big)
    bucket = F.floor((F.col("_us") - F.col("stretch_us")) / float(config.slice_us))
    # A window is shorter than `max_age_us`, so it touches at most two buckets. Each
    # (stretch, bucket) has a handful of starts, whatever the number of events.
    lookup = (starts.withColumn("_b", F.explode(F.sequence(
        F.floor((F.col("_start") - F.col("stretch_us")) / float(config.slice_us)),
        F.floor((F.col("_start") + config.max_age_us - F.col("stretch_us")) / float(config.slice_us)))))
        .groupBy(KEY, "stretch_us", "_b").agg(F.collect_list("_start").alias("_starts")))
    out = df.withColumn("_b", bucket).join(lookup, [KEY, "stretch_us", "_b"], "left")
    upto = F.array_max(F.filter("_starts", lambda s: s <= F.col("_us")))
    same = F.col("_prev_us") >= F.col("window_us")
    return (out.withColumn("window_us", F.coalesce(upto, F.col("stretch_us")))
            .withColumn("_prev_endpoint", F.when(same, F.col("_prev_endpoint")))
            .drop("_b", "_starts", "_prev_us", "stretch_us"))


def _capped_starts(df: DataFrame, config: WindowConfig, large: bool) -> DataFrame:
    """(key, stretch_us, _start): the window starts that the age rule adds.

    The first such start of a stretch is its first event of at least `max_age_us`, so
    younger events, which are nearly all, are not even looked at. Of the others only the
    distinct times matter. Each start is followed by the first time `max_age_us` or more after it.
    """
    old = F.col("_us") - F.col("stretch_us") >= config.max_age_us
    times = df.filter(old).select(KEY, "stretch_us", "_us").distinct()
    chain = times.withColumns({"_until": F.col("_us") + config.max_age_us, "_line": F.lit(0).cast("long")})
    few = min(FEW, config.rows_per_chunk)
    taken = greedy_chain(chain, [KEY, "stretch_us"], "_us", "_until", "_line", few, config.rows_per_chunk, None if large else False)
    return taken.select(KEY, "stretch_us", F.col("_us").alias("_start"))


# --- features ------------------------------------------------------------------------

MINUTE = "_minute"
ENDPOINT_EVENTS = tuple(f"events_{e}" for e in V.LOCAL_ENDPOINTS)
ENDPOINT_SEEN = tuple(f"seen_{e}" for e in V.LOCAL_ENDPOINTS)
COLLECTION_EVENTS = tuple(f"events_{c}" for c in V.COLLECTION_STATES)


def window_features(events: DataFrame, config: WindowConfig = WindowConfig()) -> DataFrame:
    """One row per window, from the output of `sequence_windows`.

    Two aggregations: per minute of a window (which gives the peak minute), then per
    window. Both combine map-side, so a window of any size stays a small state.
    """
    came, here = F.col("_prev_endpoint"), F.col("endpoint_class")
    sensitive = lambda c: c.isin(*V.SENSITIVE_ENDPOINTS)
    label = F.col("label.class")
    sums = {
        "events": F.count(F.lit(1)).cast("long"),
        "transitions": count_if(came.isNotNull()),
        "same_class": count_if(came == here),
        "sensitive_escalations": count_if(~sensitive(came) & sensitive(here)),
        "decoy_entries": count_if((came != "decoy") & (here == "decoy")),
        **{n: count_if(here == e) for n, e in zip(ENDPOINT_EVENTS, V.LOCAL_ENDPOINTS)},
        **{n: count_if(F.col("evidence.collection_status") == c)
           for n, c in zip(COLLECTION_EVENTS, V.COLLECTION_STATES)},
        "human_labels": count_if(label == "human_confirmed"),
        "abuse_labels": count_if(label == "operator_confirmed_abuse"),
    }
    maxima = {
        "last_us": F.max("_us"),
        "automation": F.max(code("evidence.automation_evidence", V.LEVELS)),
        "abuse_intent": F.max(code("evidence.abuse_intent_evidence", V.LEVELS)),
        "continuity": F.max(code("evidence.continuity_evidence", V.LEVELS)),
        "decoy": F.max(code("evidence.decoy_interaction", V.DECOY_LEVELS)),
    }
    flags = F.bit_or(bit("evidence.challenge_lifecycle", V.CHALLENGE_STATES[1:]))
    minute = F.floor(F.col("_us") / float(V.MINUTE_US)).cast("long")
    per_minute = events.groupBy(KEY, "window_us", minute.alias(MINUTE)).agg(
        *[c.alias(n) for n, c in {**sums, **maxima}.items()], flags.alias("challenge_flags"))
    w = per_minute.groupBy(KEY, F.col("window_us").alias("first_us")).agg(
        F.max("events").alias("peak_minute"),
        *[F.sum(n).alias(n) for n in sums], *[F.max(n).alias(n) for n in maxima],
        F.bit_or("challenge_flags").alias("challenge_flags"))
    return _derived_features(w, config)


def _derived_features(w: DataFrame, config: WindowConfig) -> DataFrame:
    duration = F.col("last_us") - F.col("first_us")
    human, abuse = F.col("human_labels") > 0, F.col("abuse_labels") > 0
    issue = (F.col("events_partial") + F.col("events_missing")) > 0
    return w.withColumns({
        "burst_shape": burst_shape(F.col("events"), F.col("peak_minute"), duration, config),
        "peak_bucket": peak_bucket(F.col("peak_minute")),
        "challenge_state": challenge_state(F.col("challenge_flags")),
        "label": window_label(human, abuse),
        "collection_issue": issue,
        **{s: F.col(e) > 0 for s, e in zip(ENDPOINT_SEEN, ENDPOINT_EVENTS)},
    })


def burst_shape(events: Column, peak: Column, duration: Column, c: WindowConfig) -> Column:
    return (F.when(events == 1, F.lit("single"))
            .when(peak >= c.high_rate_peak, F.lit("high_rate"))
            .when((events >= c.clustered_events) & (duration <= c.clustered_us), F.lit("clustered"))
            .when((events >= c.sustained_events) & (duration >= c.sustained_us), F.lit("sustained"))
            .otherwise(F.lit("sparse")))


PEAKS = ("one", "two_to_five", "six_to_twenty", "twenty_one_to_fifty_nine", "sixty_plus")
SHAPES = ("single", "sparse", "clustered", "sustained", "high_rate")
CLOSURES = ("inactivity", "maximum_duration", "end_of_input")
CHALLENGE_BUCKETS = ("none", "issued_unresolved", "passed", "failed", "abandoned", "fallback",
                     "conflicting")
LABELS = ("unknown", "human_confirmed", "operator_confirmed_abuse", "ambiguous")


def peak_bucket(peak: Column) -> Column:
    return (F.when(peak == 1, F.lit(PEAKS[0])).when(peak <= 5, F.lit(PEAKS[1]))
            .when(peak <= 20, F.lit(PEAKS[2])).when(peak <= 59, F.lit(PEAKS[3]))
            .otherwise(F.lit(PEAKS[4])))


def challenge_state(flags: Column) -> Column:
    """State of the flag set: bit 0 issued, bits 1-4 the terminal states."""
    terminal = flags.bitwiseAND(F.lit(30))
    return (F.when(F.bit_count(terminal) > 1, F.lit("conflicting"))
            .when(terminal == 2, F.lit("passed")).when(terminal == 4, F.lit("failed"))
            .when(terminal == 8, F.lit("abandoned")).when(terminal == 16, F.lit("fallback"))
            .when(flags.bitwiseAND(F.lit(1)) == 1, F.lit("issued_unresolved"))
            .otherwise(F.lit("none")))


def window_label(human: Column, abuse: Column) -> Column:
    return (F.when(human & abuse, F.lit("ambiguous")).when(human, F.lit("human_confirmed"))
            .when(abuse, F.lit("operator_confirmed_abuse")).otherwise(F.lit("unknown")))


def closure_reason(windows: DataFrame, config: WindowConfig = WindowConfig()) -> DataFrame:
    """Add `closure` and `closed_us`, the time the window stops being open.

    Windows of a key start at least `inactivity_us` or `max_age_us` apart, so even a hot
    key has only about a hundred thousand windows per year to order.
    """
    after = F.lead("first_us").over(Window.partitionBy(KEY).orderBy("first_us"))
    end = windows.agg(F.max("last_us").alias("_end"))
    df = windows.withColumn("_next", after).crossJoin(F.broadcast(end))
    expires = F.col("last_us") + config.inactivity_us
    capped = F.coalesce(F.col("_next") < expires, F.lit(False))
    return df.withColumns({
        "closure": F.when(capped, F.lit("maximum_duration"))
        .when(expires <= F.col("_end"), F.lit("inactivity")).otherwise(F.lit("end_of_input")),
        "closed_us": F.when(capped, F.col("_next")).otherwise(expires),
    }).drop("_next", "_end")


def windows_of(events: DataFrame, config: WindowConfig = WindowConfig()) -> DataFrame:
    """Normalised local events -> windows with features and closure."""
    return closure_reason(
        window_features(sequence_windows(sequence_key(events), config), config), config)


def peak_active(windows: DataFrame) -> DataFrame:
    """`peak_active`: the highest number of windows open at once.

    Openings and closings are summed per instant. Instants are dealt to tasks by range, so
    each task sums up its own and starts from the total of the tasks before it (one row per
    task); neither an hour nor the whole time line has to fit one task.
    """
    change = windows.select(F.inline(F.array(
        F.struct(F.col("first_us").alias("us"), F.lit(1).alias("d")),
        F.struct(F.col("closed_us").alias("us"), F.lit(-1).alias("d")))))
    instants = change.groupBy("us").agg(F.sum("d").alias("d"))
    tasks = int(windows.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    placed = durable(instants.repartitionByRange(tasks, "us").withColumn("task", F.spark_partition_id()))
    ahead = Window.orderBy("task").rowsBetween(Window.unboundedPreceding, -1)  # one row per task
    base = placed.groupBy("task").agg(F.sum("d").alias("t")).select(
        "task", F.coalesce(F.sum("t").over(ahead), F.lit(0)).alias("base"))
    level = F.sum("d").over(Window.partitionBy("task").orderBy("us")) + F.col("base")
    return (placed.join(F.broadcast(base), "task").select(level.alias("open"))
            .agg(F.coalesce(F.max("open"), F.lit(0)).cast("long").alias("peak_active")))


# --- report --------------------------------------------------------------------------

def _report_columns() -> dict[tuple[str, str], Column]:
    """(section, bucket) -> aggregate over windows, in report order."""
    n = F.count(F.lit(1)).cast("long")
    total = lambda c: F.coalesce(F.sum(c), F.lit(0)).cast("long")
    out: dict[tuple[str, str], Column] = {("source", "events"): total("events"),
                                          ("windows", "total"): n}

    def split(section: str, column: str, values) -> None:
        for v in values:
            out[(section, v)] = count_if(F.col(column) == v)

    split("windows", "closure", CLOSURES)
    split("burst_shapes", "burst_shape", SHAPES)
    split("peak_minute_events", "peak_bucket", PEAKS)
    out[("transitions", "total")] = total("transitions")
    out[("transitions", "same_class")] = total("same_class")
    out[("transitions", "cross_class")] = total(F.col("transitions") - F.col("same_class"))
    out[("transitions", "sensitive_escalation")] = total("sensitive_escalations")
    out[("transitions", "decoy_entry")] = total("decoy_entries")
    for e, name, seen in zip(V.LOCAL_ENDPOINTS, ENDPOINT_EVENTS, ENDPOINT_SEEN):
        out[("endpoint_events", e)] = total(name)
        out[("endpoint_windows", e)] = count_if(F.col(seen))
    for c, name in zip(V.COLLECTION_STATES, COLLECTION_EVENTS):
        out[("collection_events", c)] = total(name)
    out[("collection_windows", "clean")] = count_if(~F.col("collection_issue"))
    out[("collection_windows", "with_artifact")] = count_if(F.col("collection_issue"))
    for lane in ("automation", "abuse_intent", "continuity"):
        for i, level in enumerate(V.LEVELS):
            out[(lane, level)] = count_if(F.col(lane) == i)
    for i, level in enumerate(V.DECOY_LEVELS):
        out[("decoys", level)] = count_if(F.col("decoy") == i)
    split("challenges", "challenge_state", CHALLENGE_BUCKETS)
    split("labels", "label", LABELS)
    return out


def sequence_report(windows: DataFrame) -> DataFrame:
    """(section, bucket, n): every report count, zero rows included, in one pass."""
    columns = _report_columns()
    wide = windows.agg(*[c.alias(f"{s}__{b}") for (s, b), c in columns.items()])
    rows = F.array(*[F.struct(F.lit(s).alias("section"), F.lit(b).alias("bucket"),
                              F.col(f"{s}__{b}").alias("n")) for s, b in columns])
    return wide.select(F.inline(rows))


def check_sequence_report(report: DataFrame) -> DataFrame:
    """(check_name, ok): identities every report must satisfy."""
    def section(name: str, *buckets: str) -> Column:
        cond = F.col("section") == name
        if buckets:
            cond = cond & F.col("bucket").isin(*buckets)
        return F.coalesce(F.sum(F.when(cond, F.col("n"))), F.lit(0))

    windows, events = section("windows", "total"), section("source", "events")
    transitions = section("transitions", "total")
    cross = section("transitions", "cross_class")
    checks = {f"{name}_sum_to_windows": section(name) == windows for name in (
        "burst_shapes", "peak_minute_events", "collection_windows", "automation",
        "abuse_intent", "continuity", "decoys", "challenges", "labels")}
    checks |= {
        "closures_sum_to_windows": section("windows", *CLOSURES) == windows,
        "endpoint_events_sum_to_events": section("endpoint_events") == events,
        "collection_events_sum_to_events": section("collection_events") == events,
        "transitions_plus_windows_is_events": transitions + windows == events,
        "same_plus_cross_is_transitions":
            section("transitions", "same_class", "cross_class") == transitions,
        "escalations_within_cross": section("transitions", "sensitive_escalation") <= cross,
        "decoy_entries_within_cross": section("transitions", "decoy_entry") <= cross,
        "endpoint_windows_within_windows": F.coalesce(F.max(F.when(
            F.col("section") == "endpoint_windows", F.col("n"))), F.lit(0)) <= windows,
        "empty_together": (events == 0) == (windows == 0),
    }
    wide = report.agg(*[c.alias(n) for n, c in checks.items()])
    return wide.select(F.inline(F.array(*[
        F.struct(F.lit(n).alias("check_name"), F.col(n).alias("ok")) for n in checks])))
