"""Terminal outcomes of challenges and liveness attempts."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .. import vocab as V
from ..functions.timeline import ROWS_PER_CHUNK, Timeline, before, over_timeline, running


def challenge_lifecycle(issued: DataFrame, events: DataFrame, max_attempts: int = 5,
                        redemption_us: int = 60 * V.MICROS, now_us: Column | int | None = None,
                        rows_per_chunk: int = ROWS_PER_CHUNK) -> DataFrame:
    """One terminal `outcome` (or NULL while open) per issued challenge.

    issued: challenge_id, ready_us, expires_us. events: challenge_id, us, line_no,
    kind (verify / redeem / fallback), ok (right answer or valid redemption).

    A challenge ends by its fifth wrong answer, by a redemption, by the fallback or
    by expiry. Events that arrive in a state that does not allow them are ignored.
    """
    e = events.join(issued.select("challenge_id", "ready_us", "expires_us"), "challenge_id")
    alive = F.col("us") < F.col("expires_us")
    answer = (F.col("kind") == "verify") & alive & (F.col("us") >= F.col("ready_us"))
    pos = F.struct("us", "line_no")
    e = e.withColumns({
        "_wrong": (answer & ~F.col("ok")).cast("int"),
        "_right": F.when(answer & F.col("ok"), pos),
        "_fallback": F.when((F.col("kind") == "fallback") & alive, pos),
    })

    def apply(d: DataFrame, line: Timeline) -> DataFrame:
        return line.run(d, {"_wrongs": running("sum", F.col("_wrong")),
                            "_verified": before("min", F.col("_right"))})

    e = over_timeline(e, ["challenge_id"], ["us", "line_no"], apply, rows_per_chunk)
    limit = F.least(F.col("_verified.us") + redemption_us, F.col("expires_us"))
    redeem = (F.col("kind") == "redeem") & F.col("_verified").isNotNull()
    late = F.col("us") >= limit
    s = e.groupBy("challenge_id").agg(
        F.min(F.when((F.col("_wrong") == 1) & (F.col("_wrongs") == max_attempts), pos)).alias("failed"),
        F.min("_right").alias("verified"), F.min("_fallback").alias("fallback"),
        F.min(F.when(redeem & alive & (late | F.col("ok")),
                     F.struct(F.col("us"), F.col("line_no"), late.alias("late")))).alias("redeem"),
        F.max("us").alias("last_us"))
    s = issued.join(s, "challenge_id", "left")
    r = F.when(F.col("redeem").isNotNull(), F.struct(F.col("redeem.us").alias("us"),
                                                     F.col("redeem.line_no").alias("line_no")))
    never = F.struct(F.lit(2**62).alias("us"), F.lit(0).cast("long").alias("line_no"))
    at = lambda c: F.coalesce(c, never)
    failed, verified, fallback, redeemed = (
        at(F.col("failed")), at(F.col("verified")), at(F.col("fallback")), at(r))
    first = F.least(failed, verified, fallback)
    nothing = first.us == 2**62
    now = F.lit(2**61) if now_us is None else (F.lit(now_us) if isinstance(now_us, int) else now_us)
    expired = now >= F.col("expires_us")
    abandoned = F.when(expired, F.lit("challenge_abandoned"))
    after_verify = (
        F.when((redeemed.us < 2**62) & (redeemed < fallback),
               F.when(F.col("redeem.late"), F.lit("challenge_abandoned"))
               .otherwise(F.lit("challenge_passed")))
        .when(fallback.us < 2**62, F.lit("fallback_used"))
        .otherwise(abandoned))
    outcome = (F.when(nothing, abandoned).when(failed == first, F.lit("challenge_failed"))
               .when(fallback == first, F.lit("fallback_used")).otherwise(after_verify))
    return s.withColumn("outcome", outcome).drop("failed", "verified", "fallback", "redeem", "last_us")


def liveness_attempts(issued: DataFrame, answers: DataFrame, minimum_us: int = 120_000,
                      rows_per_chunk: int = ROWS_PER_CHUNK) -> DataFrame:
    """`state` (open / failed / completed) and `failure` per liveness attempt.

    issued: attempt_id, rounds, expires_us. answers: attempt_id, us, line_no, round
    (from 0), reveal_us, deadline_us, correct. The answer at position p must be for
    round p, neither too fast nor late, and right; the first bad one ends it.
    """
    a = answers.join(issued.select("attempt_id", "rounds", "expires_us"), "attempt_id")

    def apply(d: DataFrame, line: Timeline) -> DataFrame:
        return line.run(d, {"_n": running("sum", F.lit(1))})

    a = over_timeline(a, ["attempt_id"], ["us", "line_no"], apply, rows_per_chunk)
    position = F.col("_n") - 1
    failure = (F.when(F.col("us") >= F.col("expires_us"), F.lit("expired"))
               .when(F.col("round") != position, F.lit("out_of_order"))
               .when(F.col("us") < F.col("reveal_us") + minimum_us, F.lit("too_fast"))
               .when(F.col("us") >= F.col("deadline_us"), F.lit("expired"))
               .when(~F.col("correct"), F.lit("wrong_answer")))
    a = a.filter(position < F.col("rounds")).withColumn("_failure", failure)
    s = a.groupBy("attempt_id").agg(
        F.count(F.lit(1)).alias("_answers"),
        F.min(F.when(F.col("_failure").isNotNull(), F.struct("_n", "_failure"))).alias("_bad"))
    s = issued.join(s, "attempt_id", "left")
    return s.withColumns({
        "state": F.when(F.col("_bad").isNotNull(), F.lit("failed"))
        .when(F.col("_answers") >= F.col("rounds"), F.lit("completed")).otherwise(F.lit("open")),
        "failure": F.col("_bad._failure"),
    }).drop("_answers", "_bad")
