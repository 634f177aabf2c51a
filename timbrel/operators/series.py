"""Diarization series, histograms, vocabularies and what a viewer shows."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

CONFIDENT, UNCERTAIN = 0.75, 0.65

#: The fourteen colours of plots, red, green and blue from 0 to 255.
PALETTE = (
    (0, 127, 70),
    (255, 0, 0),
    (255, 217, 38),
    (0, 135, 255),
    (165, 0, 165),
    (255, 167, 255),
    (97, 142, 151),
    (0, 255, 255),
    (255, 96, 38),
    (142, 76, 0),
    (33, 0, 127),
    (0, 0, 0),
    (183, 183, 183),
    (76, 255, 0),
)
#: Where the public "gist_rainbow" colour map bends, with red, green and blue there; between, colours are linear.
RAINBOW = (
    (0.000, (1.00, 0.00, 0.16)),
    (0.030, (1.00, 0.00, 0.00)),
    (0.215, (1.00, 1.00, 0.00)),
    (0.400, (0.00, 1.00, 0.00)),
    (0.586, (0.00, 1.00, 1.00)),
    (0.770, (0.00, 0.00, 1.00)),
    (0.954, (1.00, 0.00, 1.00)),
    (1.000, (1.00, 0.00, 0.75)),
)
#: Seconds that a frame may be shown after its time.
LATE = 0.2


def confidence(sim):
    """Three levels by strict thresholds."""
    return F.when(sim > CONFIDENT, "confident").when(sim > UNCERTAIN, "uncertain").otherwise("unknown")


def diarize(similarities: DataFrame) -> DataFrame:
    """(frame, name, sim, status) of (name, frame, sim): each frame's best name, first by name on ties.

    The maximum is found by partial aggregation; where it is not even uncertain the status is unknown.
    """
    best = similarities.groupBy("frame").agg(F.max("sim").alias("sim"))
    named = similarities.join(best, ["frame", "sim"]).groupBy("frame", "sim").agg(F.min("name").alias("name"))
    return named.select("frame", "name", "sim", confidence(F.col("sim")).alias("status"))


def trailing(series: DataFrame, by: str, order: list[str], value: str, frames: int) -> DataFrame:
    """``series`` with the mean of each row and the ``frames`` rows before it."""
    window = W.partitionBy(by).orderBy(*order).rowsBetween(-frames, 0)
    return series.withColumn("trailing", F.avg(value).over(window))


def crop_frames(x_crop: float, rate: float) -> int:
    """Frames of the crop to either side, of one ``x_crop`` seconds wide at ``rate`` frames a second; halves go to the even frame."""
    return round(x_crop * rate) // 2


def cropped(series: DataFrame, by: str, order: list[str], half: int) -> DataFrame:
    """``series`` with frame (from 0), axis_from and axis_to (the crop centred on it), and data_from (the first frame shown; the last is the frame itself)."""
    numbered = series.withColumn("frame", F.row_number().over(W.partitionBy(by).orderBy(*order)) - 1)
    return numbered.withColumn("axis_from", F.col("frame") - half).withColumn("axis_to", F.col("frame") + half).withColumn("data_from", F.greatest(F.col("frame") - half, F.lit(0)))


def delay(elapsed: Column, due: Column, tolerance: float = LATE) -> Column:
    """(wait, late): seconds to wait before a frame is shown, and whether it comes more than ``tolerance`` seconds late."""
    return F.struct(F.greatest(due - elapsed, F.lit(0.0)).alias("wait"), (elapsed - tolerance > due).alias("late"))


def mid_time(start, stop, rate: int = 16_000):
    """Middle of a slice in seconds."""
    return (start + stop) / F.lit(2.0) / F.lit(float(rate))


def histogram(df: DataFrame, group: str, value: str, bins: int = 10) -> DataFrame:
    """(group, bin, lo, density): equal-width bins from minimum to maximum, the last closed; empty bins are listed."""
    span = df.groupBy(group).agg(F.min(value).alias("low"), F.max(value).alias("high"), F.count(value).alias("n"))
    span = span.withColumn("low", F.when(F.col("low") == F.col("high"), F.col("low") - 0.5).otherwise(F.col("low"))).withColumn("high", F.when(F.col("low") + 0.5 == F.col("high"), F.col("high") + 0.5).otherwise(F.col("high")))
    width = (F.col("high") - F.col("low")) / bins
    placed = df.where(F.col(value).isNotNull()).join(span, group)
    binned = placed.withColumn("bin", F.least(F.floor((F.col(value) - F.col("low")) / width), F.lit(bins - 1)).cast("int"))
    counts = binned.groupBy(group, "bin").agg(F.count("*").alias("k"))
    every = span.withColumn("bin", F.explode(F.sequence(F.lit(0), F.lit(bins - 1))))
    return every.join(counts, [group, "bin"], "left").select(group, "bin", (F.col("low") + F.col("bin") * width).alias("lo"), (F.coalesce("k", F.lit(0)) / (F.col("n") * width)).alias("density"))


def medians(df: DataFrame, group: str, value: str) -> DataFrame:
    return df.groupBy(group).agg(F.percentile(value, 0.5).alias("median"))


def invert_vocabulary(entries: DataFrame) -> DataFrame:
    """(pos, keys): keys of each value in file order, comma-joined, values in first-seen order; row 0 is </PAD>.

    A vocabulary has one row a token; ranking its values is one small task.
    """
    joined = entries.groupBy("value").agg(F.min("pos").alias("first"), F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("pos", "key"))), lambda s: s["key"]), ",").alias("keys"))
    ranked = joined.select(F.row_number().over(W.orderBy("first")).alias("pos"), "keys")
    return ranked.unionByName(entries.sparkSession.createDataFrame([(0, "</PAD>")], "pos int, keys string"))


def tokens(matrix: DataFrame, names: DataFrame | None = None) -> DataFrame:
    """(token, clust): row numbers, or the vocabulary's names by row, all of cluster 1; lengths must agree."""
    if names is None:
        return matrix.select(F.col("id").cast("string").alias("token"), F.lit(1).alias("clust"))
    if matrix.count() != names.count():
        raise ValueError("the vocabulary and the matrix differ in length")
    return matrix.join(names, F.col("id") == F.col("pos")).select(F.col("keys").alias("token"), F.lit(1).alias("clust"))


def hues(labels: DataFrame) -> DataFrame:
    """(clust, hue): 360 / (largest label + 1) degrees a label; null where that divides by zero."""
    top = labels.agg(F.max("clust").alias("top"))
    return labels.select("clust").distinct().crossJoin(F.broadcast(top)).select("clust", F.try_divide(F.lit(360.0), F.col("top") + 1).alias("step")).select("clust", (F.col("step") * F.col("clust")).alias("hue"))  # one row is broadcast


def palette(number: Column) -> Column:
    """The palette's colour of a number from 0, as an array of three shares; numbers beyond start again."""
    rows = F.array(*[F.array(*[F.lit(x / 255) for x in rgb]) for rgb in PALETTE])
    return F.element_at(rows, (F.pmod(number, F.lit(len(PALETTE))) + 1).cast("int"))


def rainbow(share: Column) -> Column:
    """The colour map's colour at a share of its length, 0 to 1, as an array of three shares, by its table of 256 steps."""
    at = F.least(F.floor(share * 256), F.lit(255)) / F.lit(255.0)

    def channel(c: int) -> Column:
        value = F.lit(RAINBOW[-1][1][c])
        for (x, low), (y, high) in reversed(list(zip(RAINBOW, RAINBOW[1:], strict=False))):
            value = F.when(at <= y, F.lit(low[c]) + (at - x) / (y - x) * (high[c] - low[c])).otherwise(value)
        return value

    return F.array(*[channel(c) for c in range(3)])


def line_colors(names: DataFrame, name: str = "name") -> DataFrame:
    """(name, number, color): each name's place in order of names, and its share of the way along the rainbow.

    Names are a plot's lines: ranking them is one small task.
    """
    listed = names.select(F.col(name).alias("name")).distinct()
    numbered = listed.select("name", (F.row_number().over(W.orderBy("name")) - 1).alias("number"), F.count("*").over(W.partitionBy()).alias("n"))
    return numbered.select("name", "number", rainbow(F.col("number") / F.col("n")).alias("color"))


def shown(assigned: DataFrame, clust: int | None = None, selected: str | None = None) -> DataFrame:
    """Viewer rows: one cluster's, or the selected file's, or all."""
    out = assigned if clust is None else assigned.where(F.col("clust") == clust)
    return out if selected is None else out.where(F.col("filename") == selected)


def accepted(name: Column) -> Column:
    """Whether the viewer takes a file dropped on it: only names that end in .csv, as spelled."""
    return name.endswith(".csv")


def with_audio(assigned: DataFrame, base: str = "http://localhost:8080/") -> DataFrame:
    """Viewer rows with the address each file is played from."""
    return assigned.withColumn("url", F.concat(F.lit(base), F.col("filename")))


def frame_rate(first, second):
    """Frames a second from the mid-times of two slices; null where they are equal."""
    return F.try_divide(F.lit(1.0), second - first)


def heat_map(pairs: DataFrame, low: float = 0.4, high: float = 1.0) -> DataFrame:
    """(i, j, c, shade): similarity triples with the value clipped to the colour limits, 0 to 1."""
    return pairs.select("i", "j", "c", F.greatest(F.lit(0.0), F.least(F.lit(1.0), (F.col("c") - low) / (high - low))).alias("shade"))
