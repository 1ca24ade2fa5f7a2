"""Usage cost, daily spend, rate limits and response caching in batch."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F

from plumbline import refdata as R
from plumbline.functions import pricing as P, text as T
from plumbline.operators.ordered import assign_windows, running_total

c = F.col
SECOND = 1_000_000
DAY = 86_400 * SECOND


def with_cost(usage: DataFrame) -> DataFrame:
    """Estimated cost per call; the stored input count includes cache tokens."""
    return (usage.withColumn("estimated_cost", P.token_cost(
        c("model"), c("input_tokens"), c("output_tokens"), c("cache_read"), c("cache_write")))
        .withColumn("input_tokens", P.stored_input_tokens(c("input_tokens"), c("cache_read"), c("cache_write"))))


def endpoint_usage(costed: DataFrame) -> DataFrame:
    """Cost, tokens and calls per day and endpoint."""
    return costed.groupBy(F.to_date("created_at").cast("string").alias("day"), "endpoint").agg(
        F.sum("estimated_cost").alias("cost"), F.sum("input_tokens").alias("input_tokens"),
        F.sum("output_tokens").alias("output_tokens"), F.count(F.lit(1)).alias("calls"))


def daily_spend(costed: DataFrame, ceiling: float = R.DAILY_CEILING, warn: float = R.WARN_SHARE) -> DataFrame:
    """Spend per day against the ceiling."""
    share = c("spend") / F.lit(ceiling)
    return (costed.groupBy(F.to_date("created_at").cast("string").alias("day"))
            .agg(F.sum("estimated_cost").alias("spend"))
            .withColumn("share", share).withColumn("exceeded", c("spend") >= ceiling)
            .withColumn("warning", c("share") >= warn))


def budget_events(costed: DataFrame, ceiling: float = R.DAILY_CEILING, warn: float = R.WARN_SHARE) -> DataFrame:
    """The call that takes a day's running spend over the warning and the stop line."""
    at = F.unix_micros(c("created_at").cast("timestamp"))
    calls = costed.select("event_id", at.alias("at"), "estimated_cost").withColumn(
        "day", F.floor(c("at") / DAY).cast("bigint"))
    run = running_total(calls, ["day"], "at", "event_id", c("estimated_cost"), 60 * SECOND, "spend")
    order = F.struct("at", "event_id")
    crossed = lambda limit: F.min(F.when(c("spend") >= limit, order))
    return (run.groupBy("day").agg(crossed(ceiling * warn).alias("w"), crossed(ceiling).alias("s"))
            .select("day", F.inline(F.filter(F.array(
                F.when(c("w").isNotNull(), F.struct(F.lit("warn").alias("level"), c("w.event_id").alias("event_id"))),
                F.when(c("s").isNotNull(), F.struct(F.lit("stop").alias("level"), c("s.event_id").alias("event_id")))),
                lambda e: e.isNotNull()))))


# --- limiter -----------------------------------------------------------------------------------
def rate_limit(requests: DataFrame, limit: int, window_seconds: int) -> DataFrame:
    """Replay of the fixed-window limiter over ``requests`` = key, event_id, at_us.

    The first request opens a window; a request at or after its end opens the next one; inside a
    window the first ``limit`` requests pass.  Denied requests never move a window, so the windows
    are a property of the request times alone and the replay needs no per-key sequential state.
    """
    placed = assign_windows(requests.withColumnRenamed("at_us", "at"), window_seconds * SECOND)
    return placed.withColumn("allowed", c("position") <= limit).withColumnRenamed("at", "at_us")


def denial_reason(key: Column, limit: int) -> Column:
    return F.concat(F.lit('You\'ve reached the limit for "'), T.limiter_name(key),
                    F.lit(f'" ({limit} per window). Please wait and try again.'))


# --- cache ---------------------------------------------------------------------------------------
def cache_key(endpoint: Column, model: Column, prompt: Column, input_hash: Column | None = None) -> Column:
    parts = [endpoint, model, prompt]
    return T.sha_key(*parts) if input_hash is None else T.sha_key(*parts, F.when(input_hash != "", input_hash))


def cache_lookup(requests: DataFrame, entries: DataFrame) -> DataFrame:
    """Each request with the newest entry of its key, if that has not expired (I4).

    ``requests``: cache_key, at; ``entries``: cache_key, response, created_at, expires_at.
    """
    newest = entries.groupBy("cache_key").agg(
        F.max_by(F.struct("response", "expires_at"), "created_at").alias("e"))
    alive = c("e.expires_at") > c("at")
    return (requests.join(newest, "cache_key", "left")
            .withColumn("response", F.when(alive, c("e.response")))
            .withColumn("hit", F.coalesce(alive, F.lit(False))).drop("e"))


def cache_accounting(requests: DataFrame, ttl_seconds: int = R.CACHE_TTL_HOURS * 3600) -> DataFrame:
    """Which requests are billed when every miss fills the cache for the time to live.

    A miss opens a window of that length and every other request inside it is a hit, so this is the
    limiter's window chain with one billed request per window.
    """
    return assign_windows(requests.withColumnRenamed("at_us", "at"), ttl_seconds * SECOND).withColumn(
        "billed", c("position") == 1).withColumnRenamed("at", "at_us")
