"""Live diarization under Structured Streaming."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from timbrel.operators.series import LATE, confidence, delay


def live_diarization(frames: DataFrame) -> DataFrame:
    """(frame, name, sim, status) of a stream (frame, sims map<string,double>): stateless, row by row.

    A frame's best name is the first by name among those of the largest similarity.
    """
    entries = F.map_entries("sims")
    best = F.array_max(F.transform(entries, lambda e: e["value"]))
    names = F.array_sort(F.transform(F.filter(entries, lambda e: e["value"] == best), lambda e: e["key"]))
    return frames.select("frame", F.element_at(names, 1).alias("name"), best.alias("sim"), confidence(best).alias("status"))


def paced(frames: DataFrame, started, due: str = "due", tolerance: float = LATE) -> DataFrame:
    """A stream of frames with wait and late, by the clock of the micro-batch: ``started`` is when the audio began, ``due`` a frame's seconds after."""
    elapsed = F.current_timestamp().cast("double") - F.lit(started).cast("timestamp").cast("double")
    return frames.withColumn("pace", delay(elapsed, F.col(due), tolerance)).select("*", "pace.wait", "pace.late").drop("pace")


def speaking_time(frames: DataFrame, window: str = "10 seconds", late: str = "30 seconds") -> DataFrame:
    """(window, name, n) of a stream (ts, frame, sims): confident frames per speaker and time window, late ones within ``late``."""
    told = frames.withWatermark("ts", late)
    entries = F.map_entries("sims")
    top = F.array_max(F.transform(entries, lambda e: F.struct(e["value"].alias("sim"), e["key"].alias("name"))))
    return told.select("ts", top.alias("top")).where(confidence(F.col("top.sim")) == "confident").groupBy(F.window("ts", window), F.col("top.name").alias("name")).agg(F.count("*").alias("n"))
