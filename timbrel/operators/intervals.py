"""Points within spans, as an equi-join.

A span of length up to 2**k lies in at most two buckets of that width, so it is sent to one or two
buckets of its own level k; a point is sent to its bucket of each level that occurs (64 at most, in
practice a few).  The join is on keys, level and bucket, the bounds are tested exactly after it.
Long spans among short ones cost nothing extra, and no width has to be chosen.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def _level(length: Column) -> Column:
    """The least k with 2**k >= length."""
    return F.when(length <= 1, 0).otherwise(F.length(F.bin(length - 1)))


def within(points: DataFrame, spans: DataFrame, at: str, start: str, stop: str, by: Sequence[str] = ()) -> DataFrame:
    """The rows of ``points`` with those of ``spans`` that have ``start <= at < stop`` and equal ``by`` columns.

    ``at``, ``start`` and ``stop`` are whole numbers or timestamps (to the microsecond).  Points and spans with a null
    among them or in ``by``, and empty spans, meet nothing.  Columns of one name besides ``by`` are refused.
    """
    clash = {c.lower() for c in points.columns} & {c.lower() for c in spans.columns} - {c.lower() for c in by}
    if clash:
        raise ValueError(f"both tables have {sorted(clash)}")

    def whole(df: DataFrame, name: str) -> Column:
        return F.unix_micros(F.col(name).cast("timestamp")) if dict(df.dtypes)[name].startswith("timestamp") else F.col(name).cast("long")

    low, high = whole(spans, start), whole(spans, stop)
    some = spans.where(low < high).withColumns({"__low": low, "__high": high}).withColumn("__level", _level(F.col("__high") - F.col("__low")))
    # one small number for each length that occurs, by power of two
    used = sorted(r[0] for r in some.select("__level").distinct().collect())
    ends = F.array_distinct(F.array(F.expr("shiftright(__low, __level)"), F.expr("shiftright(__high - 1, __level)")))
    dealt = some.withColumn("__bucket", F.explode(ends))
    every = F.explode(F.array(*[F.lit(k) for k in used]).cast("array<int>")).alias("__own")
    placed = points.withColumn("__at", whole(points, at)).select("*", every).withColumn("__place", F.expr("shiftright(__at, __own)"))
    same = [placed[c] == dealt[c] for c in by]
    met = placed.join(dealt, [*same, F.col("__own") == F.col("__level"), F.col("__place") == F.col("__bucket")])
    kept = met.where((F.col("__at") >= F.col("__low")) & (F.col("__at") < F.col("__high")))
    return kept.select(*[placed[c] for c in points.columns], *[dealt[c] for c in spans.columns if c not in by])
