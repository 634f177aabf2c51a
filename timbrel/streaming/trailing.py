"""Trailing frames of a stream with keyed state, event-time timers and eviction.

Frames come in any order within the lateness of the watermark.  Those that the watermark has not passed
yet are pending in the key's state; a timer at the earliest of them fires when it has, and then they
leave in order, each with the mean of itself and the frames before it.  So what comes out is what
``operators.series.trailing`` gives for the whole series, in pieces, and a stream that is stopped goes on
from its checkpoint.  State is what is pending and the last few values of a key.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle, StreamingQuery

PROVIDER = "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"
PENDING = "at long, place long, value double"


def _mean(values: list[float | None]) -> float | None:
    known = [v for v in values if v is not None]
    return sum(known) / len(known) if known else None


class Trailing(StatefulProcessor):
    """``n`` frames before each; a key without frames for over ``idle`` microseconds starts anew, and its state goes."""

    def __init__(self, n: int, idle: int | None):
        self.n, self.idle = n, idle

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.pending = handle.getListState("pending", PENDING)
        self.last = handle.getListState("last", "at long, value double")

    def _wake(self, at: int) -> None:
        # a timer fires once the watermark (in milliseconds) has passed it
        self.handle.registerTimer(-(-at // 1000))

    def handleInputRows(self, key, rows: Iterator[pd.DataFrame], timerValues) -> Iterator[pd.DataFrame]:
        fresh = [(int(a), int(p), None if pd.isna(v) else float(v)) for pdf in rows for a, p, v in zip(pdf["at"], pdf["place"], pdf["value"], strict=True)]
        if fresh:
            self.pending.appendList(fresh)
            self._wake(min(fresh)[0])
        return iter(())  # a table of no rows for each key takes longer than its state

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo) -> Iterator[pd.DataFrame]:
        passed = timerValues.getCurrentWatermarkInMs() * 1000
        # each call of the state is a round trip
        waiting = [tuple(r) for r in self.pending.get()]
        ready = sorted((r for r in waiting if r[0] <= passed), key=lambda r: r[:2])
        if waiting and not ready:
            return  # an earlier timer told all that was due, and set one for the rest
        before = [tuple(r) for r in self.last.get()]
        out = []
        for at, place, value in ready:
            if before and self.idle is not None and at - before[-1][0] > self.idle:
                before = []
            out.append((at, place, value, _mean([v for _, v in before] + [value])))
            before = (before + [(at, value)])[-self.n :] if self.n else []
        rest = [r for r in waiting if r[0] > passed]
        if ready:
            self.pending.put(rest) if rest else self.pending.clear()
            self.last.put(before) if before else self.last.clear()
        if rest:
            self._wake(min(rest)[0])
        elif before and self.idle is not None:
            if before[-1][0] + self.idle < passed:
                self.last.clear()  # the next frame would start anew anyhow
            else:
                self._wake(before[-1][0] + self.idle + 1000)
        if out:
            yield self._frame(key, out)

    def _frame(self, key, rows: list[tuple]) -> pd.DataFrame:
        at, place, value, trailing = zip(*rows, strict=True)
        numbers = {n: np.array([np.nan if v is None else v for v in x]) for n, x in (("value", value), ("trailing", trailing))}
        return pd.DataFrame({"key": np.full(len(rows), key[0], object), "at": np.array(at, np.int64), "place": np.array(place, np.int64), **numbers})

    def close(self) -> None:
        pass


def trailing_frames(frames: DataFrame, by: str, ts: str, place: str, value: str, n: int, late: str, idle: int | None = None) -> DataFrame:
    """(key, ts, place, value, trailing) of a stream: the mean of each frame and the ``n`` before it in order of (ts, place).

    ``place`` is a whole number that orders frames of one time.  A frame comes out once the
    watermark, ``late`` behind the latest time seen, has passed it; frames later than that are dropped.
    Null values count for nothing, frames without a key, time or place are left out.  With ``idle`` (seconds) a
    key that was silent for longer starts anew.
    """
    spark = frames.sparkSession
    spark.conf.set("spark.sql.streaming.stateStore.providerClass", PROVIDER)
    kind = frames.schema[by].dataType
    told = frames.select(F.col(by).alias("key"), F.col(ts).cast("timestamp").alias("ts"), F.col(place).cast("long").alias("place"), F.col(value).cast("double").alias("value")).where("key is not null and ts is not null and place is not null")
    timed = told.withWatermark("ts", late).withColumn("at", F.unix_micros("ts"))
    out = T.StructType([T.StructField("key", kind), T.StructField("at", T.LongType()), T.StructField("place", T.LongType()), T.StructField("value", T.DoubleType()), T.StructField("trailing", T.DoubleType())])
    processor = Trailing(n, None if idle is None else idle * 1_000_000)
    rows = timed.groupBy("key").transformWithStateInPandas(processor, out, "Append", "EventTime")
    return rows.select("key", F.timestamp_micros("at").alias("ts"), "place", "value", "trailing")


def drained(stream: DataFrame, path: str, checkpoint: str) -> StreamingQuery:
    """Everything there is now appended to Parquet at ``path``, once each; a later call with the same checkpoint goes on from there."""
    query = stream.writeStream.format("parquet").option("path", path).option("checkpointLocation", checkpoint).outputMode("append").trigger(availableNow=True).start()
    query.awaitTermination()
    if query.exception() is not None:
        raise query.exception()
    return query


def replayed(spark: SparkSession, arrivals: list[DataFrame], folder: str, by: str, ts: str, place: str, value: str, n: int, late: str, idle: int | None = None) -> DataFrame:
    """What ``trailing_frames`` tells of ``arrivals`` that come one after the other, the stream being stopped and started in between."""
    schema = arrivals[0].schema
    for rows in arrivals:
        rows.write.mode("append").parquet(f"{folder}/in")
        frames = spark.readStream.schema(schema).parquet(f"{folder}/in")
        drained(trailing_frames(frames, by, ts, place, value, n, late, idle), f"{folder}/out", f"{folder}/checkpoint")
    return spark.read.parquet(f"{folder}/out")
