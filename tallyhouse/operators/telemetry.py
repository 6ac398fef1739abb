"""Operational snapshots of the event pipeline: one pass of conditional aggregates each."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tallyhouse.functions import ranking


def seconds_between(later: Column, earlier: Column) -> Column:
    """Microsecond difference in seconds."""
    return (F.unix_micros(later.cast("timestamp")) - F.unix_micros(earlier.cast("timestamp"))) / F.lit(1e6)


def age(as_of: Column, at: Column) -> Column:
    """Seconds since ``at``, at least zero; null without one."""
    return F.when(at.isNotNull(), F.greatest(seconds_between(as_of, at), F.lit(0.0)))


def delivery_state(quarantined: Column, as_of: Column) -> Column:
    """Quarantined comes before leased, delayed and ready."""
    return F.when(quarantined, "quarantined").when(F.col("claimed_until") > as_of, "leased").when(F.col("available_at") > as_of, "delayed").otherwise("ready")


def _counts(state: str) -> list[Column]:
    n = F.col("attempt_count")
    states = [F.count_if(F.col(state) == s).alias(f"{s}_count") for s in ("ready", "delayed", "leased", "quarantined")]
    buckets = {"attempts_0_count": n == 0, "attempts_1_count": n == 1, "attempts_2_to_4_count": n.between(2, 4), "attempts_5_plus_count": n >= 5}
    return [F.count("*").alias("backlog_count"), *states, *[F.count_if(c).alias(k) for k, c in buckets.items()], F.max(n).alias("max_attempt_count")]


def _ages(as_of: Column, since: str, state: str) -> tuple[list[Column], list[Column]]:
    least = [F.min(since).alias("b"), F.min(F.when(F.col(state) == "ready", F.col(since))).alias("r"), F.min(F.when(F.col(state) == "quarantined", F.col("quarantined_at"))).alias("q")]
    told = [age(as_of, F.col(c)).alias(f"oldest_{n}_age_seconds") for c, n in (("b", "backlog"), ("r", "ready"), ("q", "quarantined"))]
    return least, told


def outbox(events: DataFrame, as_of: Column) -> DataFrame:
    """Backlog of unpublished events by delivery state and attempts, and the oldest ages."""
    waiting = events.where("published_at is null").withColumn("state", delivery_state(F.col("quarantined_at").isNotNull(), as_of))
    least, told = _ages(as_of, "recorded_at", "state")
    counts = waiting.agg(*_counts("state"), *least)
    return counts.select(*[c for c in counts.columns if len(c) > 1], *told)


def failures(rows: DataFrame, as_of: Column, by: Sequence[str] = ()) -> DataFrame:
    """As ``outbox`` for failed deliveries; quarantined ones are terminal or have spent their attempts."""
    waiting = rows.where("status in ('deferred', 'quarantined')").withColumn("state", delivery_state(F.col("status") == "quarantined", as_of))
    least, told = _ages(as_of, "first_failed_at", "state")
    held = F.col("state") == "quarantined"
    counts = waiting.groupBy(*by).agg(*_counts("state"), F.count_if(held & ~F.col("retryable")).alias("terminal_quarantined_count"), F.count_if(held & F.col("retryable")).alias("exhausted_quarantined_count"), *least)
    return counts.select(*[c for c in counts.columns if len(c) > 1], *told)


def snapshot_errors(snapshots: DataFrame, *keys: str) -> DataFrame:
    """keys and rule of snapshots whose parts don't add up: states and attempt buckets make up the backlog, and an age is there exactly
    where there is something that has one."""
    c = F.col
    states = c("ready_count") + c("delayed_count") + c("leased_count") + c("quarantined_count")
    attempts = c("attempts_0_count") + c("attempts_1_count") + c("attempts_2_to_4_count") + c("attempts_5_plus_count")
    rules = {"states_differ_from_backlog": states != c("backlog_count"), "attempts_differ_from_backlog": attempts != c("backlog_count")}
    rules |= {f"{x}_age_differs_from_count": (c(f"{x}_count") > 0) != c(f"oldest_{x}_age_seconds").isNotNull() for x in ("backlog", "ready", "quarantined")}
    return snapshots.select(*keys, F.explode(F.array_compact(F.array(*[F.when(bad, name) for name, bad in rules.items()]))).alias("rule"))


#: Failure code -> its column; fixed values.
POISON_CODES = {"invalid_message_encoding": "invalid_encoding_count", "invalid_message_json": "invalid_json_count", "invalid_event_envelope": "invalid_envelope_count", "invalid_transport_headers": "invalid_headers_count"}


def poison(rows: DataFrame, as_of: Column, lookback_seconds: int, by: Sequence[str] = ()) -> DataFrame:
    """Retained undecodable deliveries; the look-back includes both ends."""

    def recent(c: str) -> Column:
        return seconds_between(as_of, F.col(c)).between(0, lookback_seconds)

    counts = rows.groupBy(*by).agg(
        F.count("*").alias("retained_count"), F.count_if(recent("first_seen_at")).alias("recent_count"), F.count_if((F.col("observation_count") > 1) & recent("last_seen_at")).alias("recent_reobserved_count"),
        F.coalesce(F.sum("observation_count"), F.lit(0)).alias("total_observation_count"), *[F.count_if(F.col("failure_code") == k).alias(v) for k, v in POISON_CODES.items()],
        F.count_if(~F.col("failure_code").isin(*POISON_CODES)).alias("other_failure_count"), F.max("observation_count").alias("max_observation_count"),
        F.min("first_seen_at").alias("o"), F.max("first_seen_at").alias("n"), F.max("last_seen_at").alias("l"),
    )
    ages = [age(as_of, F.col(c)).alias(k) for c, k in (("o", "oldest_first_seen_age_seconds"), ("n", "newest_first_seen_age_seconds"), ("l", "latest_observation_age_seconds"))]
    return counts.select(*[c for c in counts.columns if len(c) > 1], *ages)


def effective(outcomes: DataFrame, as_of: Column) -> DataFrame:
    """A pending probe past its deadline counts as failed at the deadline; its code is never stored."""
    late = (F.col("outcome") == "pending") & (F.col("deadline_at") <= as_of)
    return (
        outcomes.withColumn("effective_outcome", F.when(late, "failed").otherwise(F.col("outcome")))
        .withColumn("effective_at", F.when(late, F.col("deadline_at")).otherwise(F.col("finalized_at")))
        .withColumn("effective_code", F.when(late, "canary_probe_abandoned").otherwise(F.col("terminal_code")))
    )


STAGES = {
    "publish": ("publish_seconds", None),
    "delivery": ("delivery_seconds", "delivery_seconds >= 0 and not clock_skew_detected"),
    "projection": ("projection_seconds", None),
    "end_to_end": ("end_to_end_seconds", None),
}


def service_levels(outcomes: DataFrame, as_of: Column, windows: Sequence[int], availability_target: float, latency_ratio: float, latency_seconds: float) -> DataFrame:
    """One row for each look-back of ``windows`` seconds: ratios, burn rates, quantiles and the failure streak.

    Availability burns failed / total, latency burns slow / successful.  The streak, last run and
    last success look at all of history; the streak needs no global sort: it counts the failures
    after the last success.  Outcomes are exploded to the windows they lie in, in one pass, and
    quantiles are picked by rank, so a window is never held or sorted whole by one task.
    """
    spark = outcomes.sparkSession
    known = effective(outcomes, as_of)
    ended = known.where("effective_outcome <> 'pending'")
    place = F.struct("effective_at", "canary_id")
    won = F.col("effective_outcome") == "succeeded"
    history = known.agg(F.max("started_at").alias("last_run_at"), F.max(F.when(won, F.col("effective_at"))).alias("last_success_at"))
    last = ended.agg(F.max(F.when(won, place)).alias("last_won"))
    streak = ended.where(~won).crossJoin(F.broadcast(last)).where(F.col("last_won").isNull() | (place > F.col("last_won"))).agg(F.count("*").alias("consecutive_failures"))
    back = seconds_between(as_of, F.col("effective_at"))
    inside = ended.where(back >= 0).withColumn("window_seconds", F.explode(F.filter(F.array(*[F.lit(w) for w in windows]), lambda w: back <= w)))
    shares = {"p50": 0.5, "p95": 0.95, "p99": 0.99}
    stages = F.explode(F.array(*[F.struct(F.lit(name).alias("stage"), F.when(F.expr(rule or "true"), F.col(c)).alias("value")) for name, (c, rule) in STAGES.items()]))
    picked = ranking.quantiles(inside.where(won).select("window_seconds", stages.alias("s")).select("window_seconds", "s.*"), ("window_seconds", "stage"), "value", shares)
    levels = picked.groupBy("window_seconds").agg(*[F.max(F.when(F.col("stage") == s, F.col(p))).alias(f"{s}_{p}") for s in STAGES for p in shares])
    counts = inside.groupBy("window_seconds").agg(
        F.count("*").alias("total_runs"), F.count_if(won).alias("successful_runs"), F.count_if(~won).alias("failed_runs"), F.count_if(won & (F.col("end_to_end_seconds") <= latency_seconds)).alias("latency_good_runs"),
    )
    codes = inside.where(~won).groupBy("window_seconds", "effective_code").agg(F.count("*").alias("n"))
    codes = codes.groupBy("window_seconds").agg(F.array_sort(F.collect_list(F.struct("effective_code", "n"))).alias("codes"))
    told = F.concat(F.lit("{"), F.array_join(F.transform("codes", lambda x: F.concat(F.lit('"'), x["effective_code"], F.lit('":'), x["n"].cast("string"))), ","), F.lit("}"))
    frame = spark.createDataFrame([(w,) for w in windows], "window_seconds int")
    joined = frame.join(counts, "window_seconds", "left").join(codes, "window_seconds", "left").join(levels, "window_seconds", "left").crossJoin(F.broadcast(history)).crossJoin(F.broadcast(streak))
    total, good = F.coalesce("total_runs", F.lit(0)), F.coalesce("successful_runs", F.lit(0))
    fast, failed = F.coalesce("latency_good_runs", F.lit(0)), F.coalesce("failed_runs", F.lit(0))
    return joined.select(
        "window_seconds", total.alias("total_runs"), good.alias("successful_runs"), failed.alias("failed_runs"), F.when(total > 0, good / total).alias("success_ratio"), F.when(total > 0, failed / total / (1.0 - availability_target)).alias("availability_burn_rate"),
        fast.alias("latency_good_runs"), F.when(good > 0, fast / good).alias("latency_good_ratio"), F.when(good > 0, (good - fast) / good / (1.0 - latency_ratio)).alias("latency_burn_rate"), "last_run_at", "last_success_at", "consecutive_failures",
        F.coalesce(told, F.lit("{}")).alias("failure_codes"), *[f"{s}_{p}" for s in STAGES for p in shares],
    )


def latency_summary(samples: DataFrame, value: str, *keys: str) -> DataFrame:
    """keys, nearest-rank p50, p95 and p99 (no interpolation), slowest, mean and samples."""
    picked = ranking.quantiles(samples, keys, value, {"p50": 0.5, "p95": 0.95, "p99": 0.99}, nearest=True)
    return picked.join(samples.groupBy(*keys).agg(F.max(value).alias("slowest"), F.avg(value).alias("mean"), F.count(value).alias("samples")), list(keys))
