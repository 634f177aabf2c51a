"""Chat formatting with cumulative-snapshot collapse, in DataFrame operations alone.

A conversation logged again after each turn leaves snapshots that prefix one another.  Each turn
gets a rolling hash of all turns up to it (two 64-bit exclusive-or sums of hashes of position,
role and text).  A conversation whose last rolling hash is an inner rolling hash of any other is
a snapshot: an anti-join drops it.  Of equal conversations the one of the smallest id stays.
The rest is rendered.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from timbrel.llm.rows import quoted
from timbrel.sources.tables import settle

#: Turns of a conversation that one window handles: longer conversations are split.
STRETCH = 1024
SEED = 0x5EED


def rolled(turns: DataFrame, conv_id: str = "conv_id", turn: str = "turn", role: str = "role", text: str = "text", stretch: int = STRETCH) -> DataFrame:
    """conv_id, place (from 1), role, text, h1, h2: the turns in order with the hash of the prefix each ends.

    Turns are ordered by turn (nulls first), role and text; numbers may have gaps or repeat.
    Conversations are cut into stretches of turn numbers, each summed apart and then offset by the
    stretches before it, so a conversation that holds a large share of all rows is no single task.
    """
    base = turns.where(quoted(conv_id).isNotNull()).select(quoted(conv_id).alias("conv_id"), quoted(turn).cast("long").alias("turn"), F.coalesce(quoted(role), F.lit("unknown")).alias("role"), F.coalesce(quoted(text), F.lit("")).alias("text"))
    base = base.withColumn("part", F.coalesce(F.floor(F.col("turn") / stretch), F.lit(-(1 << 62))))
    local = base.withColumn("local", F.row_number().over(W.partitionBy("conv_id", "part").orderBy(F.col("turn").asc_nulls_first(), "role", "text")))
    sizes = base.groupBy("conv_id", "part").agg(F.count("*").alias("size"))
    earlier = W.partitionBy("conv_id").orderBy("part").rowsBetween(W.unboundedPreceding, -1)
    starts = sizes.select("conv_id", "part", F.coalesce(F.sum("size").over(earlier), F.lit(0)).alias("start"))
    placed = local.join(starts, ["conv_id", "part"]).withColumn("place", F.col("start") + F.col("local"))
    placed = placed.withColumn("a", F.xxhash64("place", "role", "text")).withColumn("b", F.xxhash64(F.lit(SEED), "text", "role", "place"))
    within = W.partitionBy("conv_id", "part").orderBy("place").rowsBetween(W.unboundedPreceding, W.currentRow)
    summed = placed.withColumn("a", F.bit_xor("a").over(within)).withColumn("b", F.bit_xor("b").over(within))
    # exclusive-or of all earlier stretches of the conversation
    totals = placed.groupBy("conv_id", "part").agg(F.bit_xor("a").alias("pa"), F.bit_xor("b").alias("pb"))
    totals = totals.select("conv_id", "part", F.coalesce(F.bit_xor("pa").over(earlier), F.lit(0)).alias("pa"), F.coalesce(F.bit_xor("pb").over(earlier), F.lit(0)).alias("pb"))
    return summed.join(totals, ["conv_id", "part"]).select("conv_id", "place", "role", "text", F.col("a").bitwiseXOR(F.col("pa")).alias("h1"), F.col("b").bitwiseXOR(F.col("pb")).alias("h2"))


def escaped(value: Column) -> Column:
    """The text with one more backslash in each ``<|``, ``<\\|``, ..., which undone gives the text again."""
    return F.regexp_replace(value, r"<(\\*)\|", r"<\\$1|")


def format_conversations(turns: DataFrame, conv_id: str = "conv_id", turn: str = "turn", role: str = "role", text: str = "text", stretch: int = STRETCH) -> DataFrame:
    """conv_id, n_turns, n_copies and rendered for each maximal conversation.

    Rows without a conversation id are left out; null roles read "unknown", null texts are empty;
    repeated turns are turns; extra columns are ignored, whatever their names; an empty table
    gives no conversations.  n_copies counts equal conversations, the one kept included.  Common
    first turns meet in pre-aggregated prefixes, not in pairs of conversations.  Marks cannot be
    forged: one more backslash goes between the < and | of each ``<|``, ``<\\|`` and so on in a
    role or text, and back-slashes and line feeds of a role are written as two characters, so
    different conversations render differently.  The turns with their hashes are written once.
    """
    steps = settle(rolled(turns, conv_id, turn, role, text, stretch))
    ends = steps.groupBy("conv_id").agg(F.max(F.struct("place", "h1", "h2")).alias("end")).select("conv_id", "end.*")
    inner = steps.select("conv_id", "place", "h1", "h2").join(ends.select("conv_id", F.col("place").alias("n")), "conv_id").where(F.col("place") < F.col("n")).select("place", "h1", "h2").distinct()
    # equal conversations are one before they are looked up
    different = ends.groupBy("place", "h1", "h2").agg(F.min("conv_id").alias("conv_id"), F.count("*").alias("n_copies"))
    kept = different.join(inner, ["place", "h1", "h2"], "left_anti").select("conv_id", "n_copies")
    line = F.replace(F.replace(F.col("role"), F.lit("\\"), F.lit("\\\\")), F.lit("\n"), F.lit("\\n"))
    mark = F.concat(F.lit("<|im_start|>"), escaped(line), F.lit("\n"), escaped(F.col("text")), F.lit("<|im_end|>\n"))
    lines = steps.join(kept, "conv_id").select("conv_id", "n_copies", F.struct("place", mark.alias("line")).alias("at"))
    whole = lines.groupBy("conv_id").agg(F.count("*").alias("n_turns"), F.first("n_copies").alias("n_copies"), F.array_sort(F.collect_list("at")).alias("all"))
    return whole.select("conv_id", "n_turns", "n_copies", F.array_join(F.transform("all", lambda x: x["line"]), "").alias("rendered"))


def query(spark, sf_dir: str) -> DataFrame:
    return format_conversations(spark.read.parquet(f"{sf_dir}/conversations.parquet"))


SQL = r"""
WITH t AS (
  SELECT conv_id, coalesce(role, 'unknown') AS role, coalesce(text, '') AS text,
         row_number() OVER (PARTITION BY conv_id ORDER BY turn NULLS FIRST, coalesce(role, 'unknown'), coalesce(text, '')) AS place
  FROM conversations WHERE conv_id IS NOT NULL),
c AS (
  SELECT conv_id, count(*) AS n_turns, list({'r': role, 't': text} ORDER BY place) AS turns,
         string_agg('<|im_start|>' || regexp_replace(replace(replace(role, chr(92), chr(92) || chr(92)), chr(10), chr(92) || 'n'), '<(\\*)\|', '<\\\1|', 'g') || chr(10)
           || regexp_replace(text, '<(\\*)\|', '<\\\1|', 'g') || '<|im_end|>' || chr(10), '' ORDER BY place) AS rendered
  FROM t GROUP BY conv_id),
d AS (SELECT min(conv_id) AS conv_id, count(*) AS n_copies, turns, any_value(n_turns) AS n_turns, any_value(rendered) AS rendered FROM c GROUP BY turns),
p AS (SELECT DISTINCT turns[1:k] AS turns FROM (SELECT turns, unnest(generate_series(1, n_turns - 1)) AS k FROM d WHERE n_turns > 1))
SELECT conv_id, n_turns, n_copies, rendered FROM d ANTI JOIN p USING (turns)
"""
