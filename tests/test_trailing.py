"""Trailing frames of a stream against the batch result and a plain loop."""

import datetime as dt
import random

import pandas as pd
import pytest
from pyspark.sql import functions as F

from timbrel.operators import series
from timbrel.streaming import trailing

SCHEMA = "k string, ts timestamp, place long, value double"
BASE = dt.datetime(2024, 5, 1)


def at(seconds):
    return BASE + dt.timedelta(seconds=seconds)


def told(df):
    return sorted((r["key"], r["ts"], r["place"], r["value"], None if r["trailing"] is None else round(r["trailing"], 9)) for r in df.collect())


def tick(spark, seconds):
    """A frame of another key, far enough on that the watermark passes all others."""
    return spark.createDataFrame([("~", at(seconds), 0, 0.0)], SCHEMA)


def test_out_of_order_frames_give_the_batch_result(spark, tmp_path):
    rng = random.Random(4)
    rows = [(rng.choice("abc"), at(i * 3 + rng.random()), i, rng.choice([None, rng.random()])) for i in range(240)]
    rows += [("a", at(300), 1000 + i, float(i)) for i in range(5)]  # ties in time
    # each comes up to 60 seconds late
    arrival = sorted(rows, key=lambda r: r[1] + dt.timedelta(seconds=rng.random() * 60))
    waves = [arrival[i : i + 80] for i in range(0, len(arrival), 80)]
    whole = spark.createDataFrame(rows, SCHEMA)
    got = trailing.replayed(spark, [spark.createDataFrame(w, SCHEMA) for w in waves] + [tick(spark, 9000)], str(tmp_path), "k", "ts", "place", "value", 5, "70 seconds")
    want = series.trailing(whole, "k", ["ts", "place"], "value", 5).withColumnRenamed("k", "key")
    assert told(got) == told(want)


def test_frames_wait_for_the_watermark_and_late_ones_go(spark, tmp_path):
    folder = str(tmp_path)
    waves = [[("a", at(0), 0, 1.0), ("a", at(10), 1, 3.0), ("b", at(2), 0, 5.0)], [("a", at(5), 2, 2.0), ("a", at(25), 3, 4.0)], [("a", at(3), 9, 99.0), ("a", at(40), 4, 6.0)], [("a", at(100), 5, 8.0)]]
    seen = []
    for wave in waves:
        out = trailing.replayed(spark, [spark.createDataFrame(wave, SCHEMA)], folder, "k", "ts", "place", "value", 1, "10 seconds")
        seen.append(sorted((r[0], r[2], r[4]) for r in told(out)))
    assert seen[0] == [("a", 0, 1.0)]  # the watermark stands at second 0
    assert seen[1] == [("a", 0, 1.0), ("a", 1, 2.5), ("a", 2, 1.5), ("b", 0, 5.0)]
    assert seen[2] == sorted([*seen[1], ("a", 3, 3.5)])  # what comes for second 3 is late
    assert seen[3] == sorted([*seen[2], ("a", 4, 5.0)])


def test_silent_keys_start_anew(spark, tmp_path):
    folder = str(tmp_path)
    waves = [[("a", at(0), 0, 1.0), ("a", at(4), 1, 3.0)], [("a", at(60), 2, 5.0), ("a", at(62), 3, 7.0)], [("~", at(500), 0, 0.0)], [("~", at(900), 1, 0.0)], [("a", at(901), 4, 9.0)], [("~", at(2000), 2, 0.0)]]
    got = trailing.replayed(spark, [spark.createDataFrame(w, SCHEMA) for w in waves], folder, "k", "ts", "place", "value", 5, "10 seconds", idle=30)
    assert [(r[2], r[4]) for r in told(got) if r[0] == "a"] == [(0, 1.0), (1, 2.0), (2, 5.0), (3, 6.0), (4, 9.0)]
    # nothing of a silent key is held
    held = spark.read.format("statestore").option("stateVarName", "last").load(f"{folder}/checkpoint")
    assert held.where(F.col("key.key") == "a").count() == 0


def test_rows_without_a_key_time_or_place(spark, tmp_path):
    rows = [(None, at(1), 0, 1.0), ("a", None, 0, 1.0), ("a", at(1), None, 1.0), ("a", at(2), 1, None), ("a", at(3), 2, 4.0)]
    got = trailing.replayed(spark, [spark.createDataFrame(rows, SCHEMA), tick(spark, 900)], str(tmp_path), "k", "ts", "place", "value", 0, "1 second")
    assert [r[2:] for r in told(got) if r[0] == "a"] == [(1, None, None), (2, 4.0, 4.0)]


@pytest.mark.parametrize("late", ["0 seconds"])
def test_no_frames(spark, tmp_path, late):
    got = trailing.replayed(spark, [spark.createDataFrame([], SCHEMA)], str(tmp_path), "k", "ts", "place", "value", 2, late)
    assert got.count() == 0


class Handle:
    """State of one key in memory, that counts its calls."""

    def __init__(self):
        self.calls, self.timers = 0, []

    def getListState(self, name, schema):
        handle = self

        class State:
            rows: list = []

            def get(self):
                handle.calls += 1
                return iter(self.rows)

            def exists(self):
                handle.calls += 1
                return bool(self.rows)

            def put(self, rows):
                handle.calls += 1
                self.rows = list(rows)

            def appendList(self, rows):
                handle.calls += 1
                self.rows = self.rows + list(rows)

            def clear(self):
                handle.calls += 1
                self.rows = []

        return State()

    def registerTimer(self, at):
        self.calls += 1
        self.timers.append(at)


class Watermark:
    def getCurrentWatermarkInMs(self):
        return 10


def test_keys_make_few_calls_and_no_empty_tables():
    processor, handle = trailing.Trailing(2, None), Handle()
    processor.init(handle)
    rows = pd.DataFrame({"at": [3000, 1000, 20000], "place": [1, 0, 2], "value": [4.0, 2.0, 6.0]})
    assert list(processor.handleInputRows(("a",), iter([rows]), None)) == []
    assert (handle.calls, handle.timers) == (2, [1])
    (out,) = processor.handleExpiredTimer(("a",), Watermark(), None)
    assert out["trailing"].tolist() == [2.0, 3.0] and out["key"].tolist() == ["a", "a"]
    assert (handle.calls, handle.timers) == (7, [1, 20])  # 8 with a question for each state before
    assert list(processor.handleExpiredTimer(("a",), Watermark(), None)) == []
    assert (handle.calls, handle.timers) == (8, [1, 20])  # 13 before
