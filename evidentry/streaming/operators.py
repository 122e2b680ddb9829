"""Online forms of the stateful operators."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .. import vocab as V
from ..functions.expr import bit, code, micros
from ..operators.session import SessionConfig, valid_batch
from ..operators.windows import WindowConfig, sequence_key
from .ordered import OrderedProcessor, run_ordered


class SessionFeatures(OrderedProcessor):
    """State: last_us, first_us, count, last_seq, max_gap, mask, transitions, last endpoint."""

    key = "session_id"
    fields = ("us", "line_no", "sequence", "endpoint_class", "endpoint_bit")
    fields_schema = "us long, line_no long, sequence long, endpoint_class string, endpoint_bit int"
    state_schema = ("last_us long, first_us long, n long, last_seq long, gap long, mask int, moves long, "
                    "endpoint string")
    outputs = ("session_id", "line_no", "request_count", "first_seen_us", "max_sequence_gap",
               "distinct_endpoint_classes", "endpoint_transitions")
    output = ("session_id string, line_no long, request_count long, first_seen_us long, "
              "max_sequence_gap long, distinct_endpoint_classes int, endpoint_transitions long")

    def __init__(self, config: SessionConfig) -> None:
        self.ttl = config.ttl_us

    def deadline_us(self, state):
        return None if state is None else state[0] + self.ttl + 1

    def step(self, state, row):
        us, line, seq, endpoint, mask_bit = row
        _, first, n, last_seq, gap, mask, moves, came = state or (us, us, 0, None, 0, 0, 0, None)
        n += 1
        advances = last_seq is None or seq > last_seq
        if last_seq is not None and seq > last_seq:
            gap = max(gap, seq - last_seq - 1)
        if advances:
            if mask_bit:
                mask |= mask_bit
                moves += came is not None and came != endpoint
                came = endpoint
            last_seq = seq
        state = (us, first, n, last_seq, gap, mask, int(moves), came)
        return state, [(line, n, first, gap, bin(mask).count("1"), int(moves))]


def stream_session_features(requests: DataFrame, delay: str = "10 minutes",
                            config: SessionConfig = SessionConfig()) -> DataFrame:
    """Session features of a request stream, in event-time order per session."""
    df = requests.withColumns({
        "us": micros("observed_at"), "event_time": F.col("observed_at"),
        "endpoint_bit": bit("endpoint_class", V.ENDPOINT_CLASSES)})
    return run_ordered(df, SessionFeatures(config), delay=delay)


class BatchReceipts(OrderedProcessor):
    """State: last_us, last accepted sequence, accepted events, batches."""

    key = "session_id"
    fields = ("us", "line_no", "sequences")
    fields_schema = "us long, line_no long, sequences string"
    state_schema = "last_us long, last_seq long, total long, batches long"
    outputs = ("session_id", "line_no", "accepted_events", "total_accepted_events", "batch_sequence")
    output = ("session_id string, line_no long, accepted_events long, total_accepted_events long, "
              "batch_sequence long")

    def __init__(self, config: SessionConfig) -> None:
        self.ttl = config.ttl_us

    def deadline_us(self, state):
        return None if state is None else state[0] + self.ttl + 1

    def step(self, state, row):
        us, line, text = row
        _, last, total, batches = state or (us, 0, 0, 0)
        fresh = [s for s in map(int, text.split(",")) if s > last]
        last, total, batches = max([last, *fresh]), total + len(fresh), batches + 1
        return (us, last, total, batches), [(line, len(fresh), total, batches)]


def stream_event_batches(batches: DataFrame, delay: str = "10 minutes",
                         config: SessionConfig = SessionConfig()) -> DataFrame:
    """Receipts of valid browser batches."""
    sequences = F.concat_ws(",", F.transform("events", lambda e: e.sequence.cast("string")))
    df = batches.filter(valid_batch()).withColumns({
        "us": micros("received_at"), "event_time": F.col("received_at"), "sequences": sequences})
    return run_ordered(df, BatchReceipts(config), delay=delay)


class SingleUse(OrderedProcessor):
    """State: until when the nonce is taken."""

    key = "nonce"
    fields = ("us", "line_no", "expires_us")
    fields_schema = "us long, line_no long, expires_us long"
    state_schema = "until_us long"
    outputs = ("nonce", "line_no", "use")
    output = "nonce string, line_no long, use string"

    def deadline_us(self, state):
        return None if state is None else state[0]

    def step(self, state, row):
        us, line, expires = row
        if state is not None and state[0] > us:
            return state, [(line, "replayed")]
        return (expires,), [(line, "accepted")]


def stream_single_use(uses: DataFrame, fault: Column, delay: str = "10 minutes") -> DataFrame:
    """(nonce, line_no, use) of every use of an action proof, as `audit_single_use` gives them.

    uses: nonce, line_no, used_us, expires_us and the columns of `fault` (`identity.proof_fault`).
    Faulty uses come out at once; the others in order, the first of a nonce accepted and the
    rest replayed until it expires.
    """
    df = uses.withColumn("_fault", fault).withColumns({
        "us": F.col("used_us"), "event_time": F.timestamp_micros("used_us"), "nonce": F.col("nonce").cast("string")})
    faulty = df.filter("_fault IS NOT NULL").select("nonce", "line_no", F.col("_fault").alias("use"))
    return run_ordered(df.filter("_fault IS NULL"), SingleUse(), delay=delay).unionByName(faulty, allowMissingColumns=True)


class ActivityWindows(OrderedProcessor):
    """State of the open window; closes by age, or by inactivity at the watermark."""

    key = "sequence_key"
    fields = ("us", "line_no", "endpoint", "automation", "abuse_intent", "decoy", "challenge", "label")
    fields_schema = ("us long, line_no long, endpoint string, automation int, abuse_intent int, decoy int, "
                     "challenge int, label int")
    state_schema = ("first_us long, last_us long, n long, minute long, in_minute long, peak long, "
                    "endpoint string, moves long, automation int, abuse_intent int, decoy int, "
                    "challenge int, label int")
    outputs = ("sequence_key", "first_us", "last_us", "events", "peak_minute", "transitions", "automation",
               "abuse_intent", "decoy", "challenge_flags", "label_flags", "closure")
    output = ("sequence_key string, first_us long, last_us long, events long, peak_minute long, "
              "transitions long, automation int, abuse_intent int, decoy int, challenge_flags int, "
              "label_flags int, closure string")

    def __init__(self, config: WindowConfig) -> None:
        self.inactivity, self.max_age = config.inactivity_us, config.max_age_us

    def deadline_us(self, state):
        return None if state is None else state[1] + self.inactivity

    def expire(self, state):
        return None, [self._closed(state, "inactivity")]

    @staticmethod
    def _closed(s, why):
        first, last, n, _, _, peak, _, moves, auto, intent, decoy, challenge, label = s
        return (first, last, n, peak, moves, auto, intent, decoy, challenge, label, why)

    def step(self, state, row):
        us, _, endpoint, auto, intent, decoy, challenge, label = row
        out = []
        if state is not None and us - state[0] >= self.max_age:
            out.append(self._closed(state, "maximum_duration"))
            state = None
        minute = us // V.MINUTE_US
        if state is None:
            return (us, us, 1, minute, 1, 1, endpoint, 0, auto, intent, decoy, challenge, label), out
        first, _, n, at, in_minute, peak, _, moves, a, i, d, c, lab = state
        in_minute = in_minute + 1 if minute == at else 1
        return (first, us, n + 1, minute, in_minute, max(peak, in_minute), endpoint, moves + 1, max(a, auto),
                max(i, intent), max(d, decoy), c | challenge, lab | label), out


def stream_windows(events: DataFrame, delay: str = "10 minutes",
                   config: WindowConfig = WindowConfig()) -> DataFrame:
    """Closed activity windows of a local event stream, append-only."""
    label = F.col("label.class")
    df = sequence_key(events).withColumns({
        "us": micros("observed_at"), "event_time": F.col("observed_at"), "endpoint": F.col("endpoint_class"),
        "automation": code("evidence.automation_evidence", V.LEVELS),
        "abuse_intent": code("evidence.abuse_intent_evidence", V.LEVELS),
        "decoy": code("evidence.decoy_interaction", V.DECOY_LEVELS),
        "challenge": bit("evidence.challenge_lifecycle", V.CHALLENGE_STATES[1:]),
        "label": F.when(label == "human_confirmed", 1).when(label == "operator_confirmed_abuse", 2)
        .otherwise(0)})
    return run_ordered(df, ActivityWindows(config), delay=delay)


class Challenges(OrderedProcessor):
    """State: phase, wrong answers, ready, expiry, redemption expiry."""

    key = "challenge_id"
    fields = ("us", "line_no", "kind", "ok", "ready_us", "expires_us")
    fields_schema = "us long, line_no long, kind string, ok boolean, ready_us long, expires_us long"
    state_schema = "phase string, tries int, ready_us long, expires_us long, redeem_us long"
    outputs = ("challenge_id", "outcome", "at_us")
    output = "challenge_id string, outcome string, at_us long"

    def __init__(self, max_attempts: int, redemption_us: int) -> None:
        self.max_attempts, self.redemption_us = max_attempts, redemption_us

    def deadline_us(self, state):
        return None if state is None else state[3]

    def expire(self, state):
        open_phase = state[0] in ("issued", "verified")
        return None, [("challenge_abandoned", state[3])] if open_phase else []

    def step(self, state, row):
        us, _, kind, ok, ready, expires = row
        if kind == "issue":
            return ("issued", 0, ready, expires, 0), []
        if state is None or state[0] == "done":
            return state, []
        phase, tries, ready, expires, redeem = state
        end = None
        if kind == "fallback":
            end = "fallback_used"
        elif kind == "verify" and phase == "issued" and us >= ready:
            if ok:
                phase, redeem = "verified", min(us + self.redemption_us, expires)
            else:
                tries += 1
                end = "challenge_failed" if tries >= self.max_attempts else None
        elif kind == "redeem" and phase == "verified":
            end = "challenge_abandoned" if us >= redeem else "challenge_passed" if ok else None
        state = ("done" if end else phase, tries, ready, expires, redeem)
        return state, [(end, us)] if end else []


def stream_challenges(events: DataFrame, delay: str = "10 minutes", max_attempts: int = 5,
                      redemption_us: int = 60 * V.MICROS) -> DataFrame:
    """Terminal outcomes; an open challenge is abandoned when the watermark passes its expiry.

    Events: challenge_id, us, line_no, event_time, kind (issue first), ok, ready_us, expires_us.
    """
    return run_ordered(events, Challenges(max_attempts, redemption_us), delay=delay)


class Coverage(OrderedProcessor):
    """State: the last accepted report."""

    key = "source_id"
    fields = ("us", "line_no", "valid", "sequence", "done_us", "started_us", "counters")
    fields_schema = ("us long, line_no long, valid boolean, sequence long, done_us long, started_us long, "
                     "counters string")
    order = ("us", "line_no", "sequence")  # files come in no order, so reports of equal time and line go by their number
    state_schema = "sequence long, done_us long, started_us long, counters string"
    outputs = ("source_id", "line_no", "verdict")
    output = "source_id string, line_no long, verdict string"

    def step(self, state, row):
        _, line, valid, *cur = row
        cur = tuple(cur)
        if not valid:
            return state, [(line, "invalid")]
        if state is None:
            return cur, [(line, "accepted")]
        if cur == state:
            return state, [(line, "unchanged")]
        grows = all(int(a) <= int(b) for a, b in zip(state[3].split(","), cur[3].split(",")))
        ok = cur[2] == state[2] and cur[0] > state[0] and cur[1] >= state[1] and grows
        return (cur, [(line, "accepted")]) if ok else (state, [(line, "conflict")])


def stream_coverage(reports: DataFrame, delay: str = "10 minutes") -> DataFrame:
    """Verdict of every cumulative coverage report, in arrival order per source."""
    from ..operators.telemetry import COUNTERS, valid_coverage_report

    # `protected` is the sum of the others in a valid report, and nothing is asked of the counters of others
    counters = F.flatten(F.transform("endpoints", lambda x: F.array(*[x[c] for c in COUNTERS[1:]])))
    df = reports.withColumn("valid", valid_coverage_report()).withColumns({
        "us": micros("received_at"), "event_time": F.col("received_at"),
        "done_us": micros("completed_at"), "started_us": micros("source_started_at"),
        "counters": F.when(F.col("valid"), F.concat_ws(",", F.transform(counters, lambda c: c.cast("string"))))})
    return run_ordered(df, Coverage(), delay=delay)


def stream_link_outcomes(decisions: DataFrame, outcomes: DataFrame, maturity: str = "15 minutes",
                         decision_delay: str = "1 minute", outcome_delay: str = "1 minute") -> DataFrame:
    """Left outer stream-stream join: a decision without outcome appears once it is mature."""
    d = decisions.withWatermark("recorded_at", decision_delay)
    o = outcomes.select(
        F.col("decision_id").alias("_id"), F.col("recorded_at").alias("outcome_at"),
        F.col("endpoint_class").alias("outcome_endpoint"), "outcome").withWatermark("outcome_at", outcome_delay)
    within = (F.col("outcome_at") >= F.col("recorded_at")) & (
        F.col("outcome_at") <= F.col("recorded_at") + F.expr(f"INTERVAL {maturity}"))
    return d.join(o, (F.col("decision_id") == F.col("_id")) & within, "left_outer").drop("_id")


def stream_counters(decisions: DataFrame, every: str = "1 minute", delay: str = "10 minutes",
                    time: str = "recorded_at") -> DataFrame:
    """Traffic counters per tumbling window (use update or append mode)."""
    from ..operators.telemetry import traffic_counters

    return traffic_counters(decisions.withWatermark(time, delay), F.window(time, every).alias("window"))
