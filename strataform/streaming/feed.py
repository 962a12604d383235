"""Structured Streaming: change feeds, continuous rollups, deduplication and rate limits."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout

from ..operators.timeseries import rollup


def follow(spark: SparkSession, path: str, schema, files_per_batch: int = 8) -> DataFrame:
    """A ledger folder as a stream; the query's checkpoint holds the reader's place."""
    return spark.readStream.schema(schema).option("maxFilesPerTrigger", files_per_batch).parquet(path)


def continuous_rollup(points: DataFrame, seconds: int = 60, late: str | None = None) -> DataFrame:
    """Tumbling windows per series over (ts, series, value).

    Without ``late`` no point is ever dropped and state grows with the windows; with it, windows close.
    """
    held = points.withWatermark("ts", late) if late else points
    per = held.groupBy("series", F.window("ts", f"{seconds} seconds").alias("w")).agg(F.count(F.lit(1)).alias("n"), F.min("value").alias("lo"), F.max("value").alias("hi"), F.sum("value").alias("total"))
    return per.select("series", F.unix_millis(F.col("w.start")).alias("bucket"), "n", "lo", "hi", "total")


def sessions(points: DataFrame, gap: str, late: str) -> DataFrame:
    """Session windows per series: a superset of the tumbling ones."""
    per = points.withWatermark("ts", late).groupBy("series", F.session_window("ts", gap).alias("w")).agg(F.count(F.lit(1)).alias("n"))
    return per.select("series", F.unix_millis(F.col("w.start")).alias("started"), "n")


def first_messages(messages: DataFrame, late: str = "10 minutes") -> DataFrame:
    """Each message id once within the watermark; messages with an empty or null id are never repeats."""
    named = F.coalesce(F.col("message_id"), F.lit("")) != ""
    held = messages.withWatermark("ts", late)
    return held.where(named).dropDuplicatesWithinWatermark(["message_id"]).unionByName(held.where(~named))


def rate_limited(requests: DataFrame, rate: float, burst: float) -> DataFrame:
    """(client, at_ms, allowed): a token bucket per client, over the requests of each batch in order of time.

    The bucket is a fold over a client's requests; the state is two numbers a client. A batch's requests of one
    client are sorted together, so its trigger's size (``follow``) bounds what a task holds.
    """

    def allow(key, frames: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        tokens, last = state.get if state.exists else (burst, None)
        at = np.sort(np.concatenate([np.zeros(0, np.int64), *(pdf["at_ms"].to_numpy(np.int64) for pdf in frames)]))
        allowed = np.zeros(len(at), bool)
        for i, now in enumerate(at.tolist()):
            if last is not None:
                tokens = min(burst, tokens + max(0, now - last) / 1000 * rate)
            last = now if last is None else max(last, now)
            allowed[i] = tokens >= 1
            tokens -= bool(allowed[i])
        state.update((float(tokens), last))
        yield pd.DataFrame({"client": key[0], "at_ms": at, "allowed": allowed})

    return requests.where("at_ms is not null").groupBy("client").applyInPandasWithState(allow, "client string, at_ms long, allowed boolean", "tokens double, last long", "append", GroupStateTimeout.NoTimeout)


def upsert_batches(stream: DataFrame, path: str, checkpoint: str):
    """Write each micro-batch's minute rollup to its own folder; a batch run again replaces its own rows."""

    def write(batch: DataFrame, number: int) -> None:
        rollup(batch).write.mode("overwrite").parquet(f"{path}/batch={number}")

    return stream.writeStream.foreachBatch(write).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()
