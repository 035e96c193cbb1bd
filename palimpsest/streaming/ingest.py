"""Streams of messages: replays dropped, and windows for extraction that close after a pause or when full."""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout

from ..schema import Config

MESSAGE = "conversation_id string, request_id string, sequence_number bigint, author_key string, content string, created_at timestamp"


def read(spark: SparkSession, path: str, late: str = "10 minutes") -> DataFrame:
    """Messages from JSON files as they arrive, each request once."""
    rows = spark.readStream.schema(MESSAGE).json(path).withWatermark("created_at", late)
    return rows.dropDuplicatesWithinWatermark(["conversation_id", "request_id"])


def debounced(messages: DataFrame, config: Config = Config()) -> DataFrame:
    """(conversation_id, first_sequence, last_sequence, n, cause): windows of pending messages.

    A window closes `full` as soon as extraction_batch messages are pending, or `idle` once the watermark passes
    extraction_idle_s after the last of them. The state of a conversation is its pending sequence numbers (fewer than a
    batch) and the last one handled, which only grows, so replays and late messages before it open nothing.
    """
    size, idle = config.extraction_batch, config.extraction_idle_s * 1000

    def step(key: tuple, frames: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        pending, done, last = state.get if state.exists else ([], -1, 0)
        out: list[tuple] = []

        def close(n: int, cause: str) -> None:
            nonlocal pending, done
            now, pending = pending[:n], pending[n:]
            done = max(done, now[-1])
            out.append((key[0], now[0], now[-1], len(now), cause))

        if state.hasTimedOut:
            if pending:
                close(len(pending), "idle")
        else:
            for frame in frames:
                fresh = {int(s) for s in frame["sequence_number"] if s > done}
                pending = sorted(fresh | set(pending))
                last = max(last, int(frame["created_at"].max().timestamp() * 1000))
                while len(pending) >= size:
                    close(size, "full")
        state.update((list(pending), done, last))
        if pending:
            state.setTimeoutTimestamp(max(last + idle, state.getCurrentWatermarkMs() + 1))
        yield pd.DataFrame(out, columns=["conversation_id", "first_sequence", "last_sequence", "n", "cause"])

    return messages.groupBy("conversation_id").applyInPandasWithState(
        step,
        "conversation_id string, first_sequence bigint, last_sequence bigint, n int, cause string",
        "pending array<bigint>, done bigint, last bigint",
        "append",
        GroupStateTimeout.EventTimeTimeout,
    )


def per_minute(messages: DataFrame) -> DataFrame:
    """Messages by conversation and minute, late ones within the watermark included."""
    return messages.groupBy(F.window("created_at", "1 minute").alias("minute"), "conversation_id").count()
