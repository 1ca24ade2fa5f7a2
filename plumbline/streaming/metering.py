"""Streaming twins of the metering jobs."""

from __future__ import annotations

from collections.abc import Iterator
from uuid import uuid4

import pandas as pd
from pyspark.sql import DataFrame, SparkSession, functions as F
from pyspark.sql.streaming.stateful_processor import StatefulProcessor, StatefulProcessorHandle

from plumbline import refdata as R
from plumbline.functions import pricing as P
from plumbline.session import ensure_checkpoint_dir

c = F.col
ROCKSDB = "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"
REQUEST_SCHEMA = "key string, event_id bigint, at timestamp"
LIMITER_SCHEMA = "key string, event_id bigint, allowed boolean"
CACHE_EVENT_SCHEMA = "key string, event_id bigint, at timestamp, is_request boolean, response string, ttl_seconds bigint"
CACHE_SCHEMA = "key string, event_id bigint, response string, hit boolean"


def usage_stream(spark: SparkSession, path: str, files_per_batch: int = 8) -> DataFrame:
    """The event table as a stream of calls with a real TIMESTAMP, as watermarks require."""
    schema = spark.read.parquet(path).schema
    raw = spark.readStream.schema(schema).option("maxFilesPerTrigger", files_per_batch).parquet(path)
    return raw.withColumn("created_at", c("ts").cast("timestamp"))


def daily_usage_stream(costed: DataFrame, late: str = "1 hour") -> DataFrame:
    """Cost and calls per day and endpoint; rows later than the watermark are dropped."""
    return (costed.withWatermark("created_at", late)
            .groupBy(F.window("created_at", "1 day").alias("w"), "endpoint")
            .agg(F.sum("estimated_cost").alias("cost"), F.count(F.lit(1)).alias("calls"))
            .select(F.to_date("w.start").cast("string").alias("day"), "endpoint", "cost", "calls"))


def first_seen_stream(requests: DataFrame, ttl: str = "24 hours") -> DataFrame:
    """Billed calls only: a repeated cache key within the watermark is dropped."""
    return requests.withWatermark("at", ttl).dropDuplicatesWithinWatermark(["cache_key"])


def budget_alerts(batch: DataFrame, ceiling: float = R.DAILY_CEILING, warn: float = R.WARN_SHARE) -> DataFrame:
    """For ``foreachBatch`` on the daily aggregate: days over the warning or the stop line."""
    spend = batch.groupBy("day").agg(F.sum("cost").alias("spend"))
    level = F.when(c("spend") >= ceiling, "stop").when(c("spend") >= ceiling * warn, "warn")
    return spend.withColumn("level", level).where(c("level").isNotNull())


class _Expiring(StatefulProcessor):
    """One value per key that is removed once the watermark passes its end.

    ``names`` of the state end with ``end_us``.  Each key keeps one timer; when it fires and the end has moved on since,
    it is set again.
    """

    names = ""

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.state = handle.getValueState("entry", self.names)

    def keep(self, value: tuple) -> None:
        """Remember ``value``; a timer is set with the first one."""
        fresh = not self.state.exists()
        self.state.update(value)
        if fresh:
            self.handle.registerTimer(-(-value[-1] // 1000))

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo) -> Iterator[pd.DataFrame]:
        if self.state.exists():
            end = -(-self.state.get()[-1] // 1000)
            if end <= expiredTimerInfo.getExpiryTimeInMs():
                self.state.clear()
            else:
                self.handle.registerTimer(end)
        return iter([])

    def close(self) -> None:
        pass


def _in_order(rows: Iterator[pd.DataFrame], by: list[str]) -> tuple[pd.DataFrame, pd.Series]:
    """A key's rows of one micro-batch in order, and their times in microseconds."""
    batch = pd.concat(list(rows), ignore_index=True).sort_values(by, ignore_index=True)
    return batch, batch["at"].astype("datetime64[us]").astype("int64")


class FixedWindowLimiter(_Expiring):
    """(count, reset time) per key; one decision per request; nothing is left after an idle window."""

    names = "count bigint, end_us bigint"

    def __init__(self, limit: int, window_seconds: int):
        self.limit, self.window_us = limit, window_seconds * 1_000_000

    def handleInputRows(self, key, rows: Iterator[pd.DataFrame], timerValues) -> Iterator[pd.DataFrame]:
        count, reset = self.state.get() if self.state.exists() else (0, None)
        batch, times = _in_order(rows, ["at", "event_id"])
        verdicts = []
        for at in times:
            if reset is None or reset <= at:
                count, reset = 1, at + self.window_us
                verdicts.append(True)
            else:
                verdicts.append(count < self.limit)
                count += verdicts[-1]
        self.keep((int(count), int(reset)))
        yield pd.DataFrame({"key": key[0], "event_id": batch["event_id"], "allowed": verdicts})


def limiter_stream(requests: DataFrame, limit: int, window_seconds: int, late: str = "1 hour") -> DataFrame:
    """Verdict per request, from keyed state in the RocksDB store (switched on here).

    A key's requests of one micro-batch are decided in time order, so callers bound the batch with the source's rate
    options.  Requests later than ``late`` behind the newest are dropped; a key's state goes when its window has ended.
    """
    requests.sparkSession.conf.set("spark.sql.streaming.stateStore.providerClass", ROCKSDB)
    return requests.withWatermark("at", late).groupBy("key").transformWithStateInPandas(
        statefulProcessor=FixedWindowLimiter(limit, window_seconds), outputStructType=LIMITER_SCHEMA,
        outputMode="Append", timeMode="EventTime")


class ExpiringCache(_Expiring):
    """The newest response per key until it expires; one answer per request (I4)."""

    names = "response string, created_us bigint, end_us bigint"

    def handleInputRows(self, key, rows: Iterator[pd.DataFrame], timerValues) -> Iterator[pd.DataFrame]:
        entry = self.state.get() if self.state.exists() else None
        batch, times = _in_order(rows, ["at", "is_request", "event_id"])
        answers = []
        for at, asked, response, ttl in zip(times, batch["is_request"], batch["response"], batch["ttl_seconds"]):
            if asked:
                answers.append(entry[0] if entry is not None and entry[2] > at else None)
            elif entry is None or entry[1] <= at:
                entry = (response, int(at), int(at + ttl * 1_000_000))
        if entry is not None:
            self.keep(tuple(entry))
        yield pd.DataFrame({"key": key[0], "event_id": batch["event_id"][batch["is_request"]].astype("int64"),
                            "response": pd.Series(answers, dtype=object).to_numpy(), "hit": [x is not None for x in answers]})


def cache_lookup_stream(events: DataFrame, late: str = "1 hour") -> DataFrame:
    """Each request with the newest response put for its key, if that has not expired (I4).

    ``events``: key, event_id, at, is_request, response, ttl_seconds - requests and new responses in one stream; at equal
    times responses come first.  State of a key goes when its response has expired.
    """
    events.sparkSession.conf.set("spark.sql.streaming.stateStore.providerClass", ROCKSDB)
    return events.withWatermark("at", late).groupBy("key").transformWithStateInPandas(
        statefulProcessor=ExpiringCache(), outputStructType=CACHE_SCHEMA, outputMode="Append", timeMode="EventTime")


def run_to_files(stream: DataFrame, mode: str = "append") -> DataFrame:
    """Drain the available input into Parquet below the shared checkpoint folder and read it back."""
    spark = stream.sparkSession
    base = f"{ensure_checkpoint_dir(spark)}/stream-{uuid4().hex}"
    if mode == "append":
        (stream.writeStream.outputMode("append").format("parquet").option("path", f"{base}/data")
         .option("checkpointLocation", f"{base}/log").trigger(availableNow=True).start().awaitTermination())
    else:
        def keep(batch: DataFrame, batch_id: int) -> None:
            batch.write.mode("overwrite").parquet(f"{base}/data")
        (stream.writeStream.outputMode(mode).foreachBatch(keep)
         .option("checkpointLocation", f"{base}/log").trigger(availableNow=True).start().awaitTermination())
    return spark.read.schema(stream.schema).parquet(f"{base}/data")


def with_stream_cost(usage: DataFrame) -> DataFrame:
    return usage.withColumn("estimated_cost", P.token_cost(c("model"), c("input_tokens"), c("output_tokens")))
