"""Secret scans in DataFrame expressions alone.

Base spans come from three patterns.  The method adds spans of kind ``entropy``: over candidate
strings of each character class a window slides one character at a time, the Shannon entropy of
its character counts kept up to date by the counts that enter and leave; a candidate with a window
at or above the class's threshold is a secret unless a base span covers it.  What the allow-list
knows is taken out of a candidate first, so it hides no secret beside it.
"""

from __future__ import annotations

import math
from collections.abc import Callable
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from timbrel.llm.rows import quoted

#: Fixed patterns of the base kinds, letters of the names in either case; the last group is what must be long enough.
ASSIGN = r"""([pP][aA][sS][sS][wW][oO][rR][dD]|[pP][aA][sS][sS][wW][dD]|[sS][eE][cC][rR][eE][tT]|[tT][oO][kK][eE][nN]|[aA][pP][iI]_?[kK][eE][yY])["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)"""
ACCESS = r"AKIA[A-Z0-9]+"
#: Runs of [0-9a-f]+; a match of fewer than 32 fails, so only the longer are looked for.
HEX = r"[0-9a-f]{32,}"
KINDS = ("assign", "access", "hex", "entropy")

#: What is no secret, however random: placeholders, identifiers in the 8-4-4-4-12 form, runs of the alphabet or of one character.
_KNOWN = r"(?i)example|placeholder|changeme|x{6,}|^[0-9a-f]{8}-([0-9a-f]{4}-){3}[0-9a-f]{12}$|abcdefghij|0123456789|"
ALLOW = _KNOWN + r"([a-z0-9])\2{7,}"
#: The same for engines without back references.
ALLOW_SPELLED = _KNOWN + "|".join(c + "{8,}" for c in "abcdefghijklmnopqrstuvwxyz0123456789")


@dataclass(frozen=True)
class CharacterClass:
    """Candidates of a class, the window's width, and the entropy in bits from which it is a secret's."""

    name: str
    candidates: str
    width: int
    bits: float


#: Any string as random as 99.5 % of those drawn evenly from its class at the window's width (simulated) is a secret's.
CLASSES = (
    CharacterClass("hex", r"[0-9A-Fa-f]{16,}", 16, 2.6),
    CharacterClass("one case", r"[0-9a-z]{16,}|[0-9A-Z]{16,}", 16, 3.05),
    CharacterClass("base62", r"[A-Za-z0-9]{16,}", 16, 3.3),
    CharacterClass("base64", r"[A-Za-z0-9+/_=-]{24,}", 24, 3.85),
)
#: Letters and digits, or a case that changes as names of several words do not.  ``mixed`` tests the same in time linear in the string.
MIXED = r"[0-9].*[A-Za-z]|[A-Za-z].*[0-9]|([a-z][^a-z]*[A-Z][^A-Z]*){4}"
#: What a text must hold for MIXED to match in a run of candidates' characters, allowed parts taken out or not: a letter and a digit, or a capital after a small letter, with no other kind of character between.
CHANGE = r"[A-Za-z][+/_=-]*[0-9]|[0-9][+/_=-]*[A-Za-z]|[a-z][0-9+/_=-]*[A-Z]"

_SPAN = "array<struct<start:long,end:long,kind:int>>"
_FOUND = "array<struct<start:long,end:long,kind:int,word:string>>"


#: Code points of a block that pieces of a text are cut from.
BLOCK = 512
#: Elements that one step of ``running`` sums up by growing an array.
STRIDE = 128


def once(value: Column, use: Callable[[Column], Column]) -> Column:
    """``use(value)`` with the value computed once, however often it is used."""
    return F.element_at(F.transform(F.array(value), use), 1)


def running(values: Column, join: Callable[[Column, Column], Column], start: int = 0) -> Column:
    """Running values of an associative ``join`` over an array of longs, ``start`` first: one element more than ``values``.

    Arrays cannot be appended to, only copied; stretches of STRIDE elements are summed apart and
    then offset by the stretches before, so the work grows with the length, not its square.
    """

    def scan(x: Column, begin: Column) -> Column:
        return F.aggregate(x, F.array(begin), lambda done, v: F.concat(done, F.array(join(F.element_at(done, -1), v))))

    def whole(x: Column) -> Column:
        stretches = F.transform(F.sequence(F.lit(0), F.floor((F.size(x) - 1) / STRIDE).cast("int")), lambda i: F.slice(x, i * STRIDE + 1, F.lit(STRIDE)))
        return once(stretches, lambda parts: F.concat(F.array(zero), F.flatten(F.zip_with(parts, begins(parts), lambda part, begin: F.slice(scan(part, begin), 2, F.size(part))))))

    def begins(parts: Column) -> Column:
        totals = F.transform(parts, lambda part: F.aggregate(part, zero, join))
        return F.slice(scan(totals, zero), 1, F.size(parts))

    zero = F.lit(start).cast("long")
    return once(values, lambda x: F.when(F.size(x) > STRIDE, whole(x)).otherwise(scan(x, zero)))


def located(text: Column, pattern: str, least: int, kind: int, group: int = 0) -> Column:
    """Spans, with the strings found, of the pattern's leftmost non-overlapping matches whose ``group`` has at least ``least`` characters.

    Splitting at the matches gives the text between them; running lengths give code-point offsets.
    """
    long_enough = lambda m: F.length(F.regexp_extract(m, pattern, group) if group else m) >= least

    def spans(x: Column) -> Column:
        found, gaps = x["found"], x["between"]
        steps = F.zip_with(F.slice(gaps, 1, F.size(found)), found, lambda g, m: (F.length(g) + F.length(m)).cast("long"))
        ends = F.slice(running(steps, lambda a, v: a + v), 2, F.size(found))
        every = F.zip_with(found, ends, lambda m, e: F.struct((e - F.length(m)).alias("start"), e.alias("end"), F.lit(kind).alias("kind"), m.alias("word")))
        return F.filter(every, lambda s: long_enough(s["word"]))

    both = F.struct(F.split(text, pattern, -1).alias("between"), F.regexp_extract_all(text, F.lit(pattern), F.lit(0)).alias("found"))
    return F.when(text.rlike(pattern), once(both, spans)).otherwise(F.array().cast(_FOUND))


def uncovered(found: Column, spans: Column) -> Column:
    """Those of ``found`` that lie in none of ``spans``, both in order: a span covers what starts no earlier and ends by the furthest end so far."""
    marks = lambda xs, own: F.transform(xs, lambda s: F.struct(s["start"].alias("start"), F.lit(own).alias("own"), s["end"].alias("end"), (s["word"] if own else F.lit("")).alias("word")))

    def judge(all_: Column) -> Column:
        reach = F.slice(running(F.transform(all_, lambda s: F.when(s["own"] == 0, s["end"]).otherwise(F.lit(-1).cast("long"))), lambda a, v: F.greatest(a, v), -1), 2, F.size(all_))
        told = F.zip_with(all_, reach, lambda s, r: F.struct(s["start"].alias("start"), s["end"].alias("end"), F.lit(3).alias("kind"), s["word"].alias("word"), ((s["own"] == 1) & (r < s["end"])).alias("free")))
        return F.transform(F.filter(told, lambda s: s["free"]), lambda s: F.struct(*[s[c].alias(c) for c in ("start", "end", "kind", "word")]))

    # at one start the spans come first
    return F.when((F.size(found) > 0) & (F.size(spans) > 0), once(F.array_sort(F.concat(marks(spans, 0), marks(found, 1))), judge)).otherwise(found)


def mixed(word: Column) -> Column:
    """Whether MIXED matches a string of candidates' characters: both kinds there, or four runs of capitals that follow small letters."""
    both = word.rlike("[0-9]") & word.rlike("[A-Za-z]")
    return both | (F.size(F.regexp_extract_all(word, F.lit("[a-z][^a-z]*[A-Z]"), F.lit(0))) >= 4)


def _term(n: Column) -> Column:
    return F.when(n > 0, n.cast("double") * F.log2(F.greatest(n, F.lit(1)).cast("double"))).otherwise(F.lit(0.0))


def is_hot(candidate: Column, width: int, bits: float) -> Column:
    """Whether some window of ``width`` characters has an entropy of at least ``bits``.

    One pass: ``total`` is the sum of n log2 n over the counts n of the window's characters; each
    step changes it by the terms of the character that enters and the one that leaves.
    Entropy = log2(width) - total / width.  A string of fewer than 2 ** bits different characters has no such window.
    """
    slots = F.transform(F.split(candidate, ""), lambda c: F.ascii(c) - 42)  # '+' (43) is slot 1, 'z' (122) slot 80
    return once(F.filter(slots, lambda c: c > 0), lambda chars: (F.size(F.array_distinct(chars)) >= 2 ** (bits - 1e-9)) & _has_hot(chars, width, bits))


def _has_hot(chars: Column, width: int, bits: float) -> Column:
    zero = F.struct(F.array_repeat(F.lit(0), 80).alias("counts"), F.lit(0.0).alias("total"), F.lit(False).alias("hot"))

    def step(s: Column, x: Column) -> Column:
        enters, leaves, at = x["enters"], x["leaves"], x["at"]
        same = enters == leaves
        n_in = F.element_at(s["counts"], enters)
        n_out = F.when(leaves > 0, F.element_at(s["counts"], F.greatest(leaves, F.lit(1)))).otherwise(F.lit(0))
        gain = F.when(same, 0.0).otherwise(_term(n_in + 1) - _term(n_in) + F.when(leaves > 0, _term(n_out - 1) - _term(n_out)).otherwise(0.0))
        total = s["total"] + gain
        counts = F.when(same, s["counts"]).otherwise(F.transform(s["counts"], lambda v, i: v + (i + 1 == enters).cast("int") - (i + 1 == leaves).cast("int")))
        hot = (at >= width) & (F.lit(math.log2(width)) - total / width >= bits - 1e-9)
        # once hot, nothing is counted any more
        return F.struct(F.when(s["hot"], s["counts"]).otherwise(counts).alias("counts"), F.when(s["hot"], s["total"]).otherwise(total).alias("total"), (s["hot"] | hot).alias("hot"))

    moves = F.transform(chars, lambda c, i: F.struct(c.alias("enters"), (i + 1).alias("at")))
    late = F.concat(F.array_repeat(F.lit(0), width), chars)
    moves = F.zip_with(moves, F.slice(late, 1, F.size(chars)), lambda m, o: F.struct(m["enters"].alias("enters"), m["at"].alias("at"), o.alias("leaves")))
    return F.aggregate(moves, zero, step, lambda s: s["hot"])


def entropy_spans(text: Column, spans: Column, kind: CharacterClass, allow: str) -> Column:
    """Candidates of the class with a window as random as a secret, as far as no base span covers them.

    What is allowed is taken out of a candidate before the rest of it is judged; a hit marks the
    whole candidate.
    """

    def hit(c: Column) -> Column:
        hot = lambda rest: F.coalesce(F.when(mixed(rest), is_hot(rest, kind.width, kind.bits)), F.lit(False))
        # what is left of a string that is not mixed is not mixed either
        return F.when(mixed(c["word"]), once(F.regexp_replace(c["word"], allow, ""), hot)).otherwise(F.lit(False))

    return F.when(text.rlike(kind.candidates), bare(F.filter(uncovered(located(text, kind.candidates, 1, 3), spans), hit))).otherwise(F.array().cast(_SPAN))


def bare(spans: Column) -> Column:
    """Spans without the strings found."""
    return F.transform(spans, lambda s: F.struct(s["start"].alias("start"), s["end"].alias("end"), s["kind"].alias("kind")))


def scan(docs: DataFrame, text: str = "text", classes: tuple[CharacterClass, ...] = CLASSES, allow: str = ALLOW) -> DataFrame:
    """``docs`` with base_spans and secret_spans: arrays of (start, end, kind), in code points, end exclusive, by start, then kind.

    kind numbers KINDS.  secret_spans holds the base spans and the whole candidates in which the
    entropy windows found something.
    Null texts are empty; repeated rows are scanned alike; an empty table stays empty; input
    columns of the results' names are replaced.  One pass of expressions, no shuffle.
    """
    keyed = lambda spans: F.array_sort(F.transform(spans, lambda s: F.struct(s["start"].alias("start"), s["kind"].alias("kind"), s["end"].alias("end"))))
    # in order, spans found by two classes lie side by side
    fresh = lambda xs: F.filter(xs, lambda s, i: (i == 0) | (s != F.element_at(xs, F.greatest(i, F.lit(1)))))
    order = lambda spans: F.transform(once(keyed(spans), fresh), lambda s: F.struct(s["start"].alias("start"), s["end"].alias("end"), s["kind"].alias("kind")))
    value = F.coalesce(quoted(text), F.lit(""))
    base = F.concat(bare(located(value, ASSIGN, 8, 0, 2)), bare(located(value, ACCESS, 16, 1)), bare(located(value, HEX, 32, 2)))
    docs = docs.drop("base_spans", "secret_spans").withColumn("base_spans", order(base))
    added = [entropy_spans(value, F.col("base_spans"), c, allow) for c in classes]
    added = F.when(value.rlike(CHANGE), F.concat(*added)).otherwise(F.array().cast(_SPAN))
    return docs.withColumn("secret_spans", order(F.concat("base_spans", added)))


def spelled(spans: str) -> Column:
    """kind:start:end of each span, comma-joined."""
    names = F.array(*map(F.lit, KINDS))
    return F.array_join(F.transform(spans, lambda s: F.concat_ws(":", F.element_at(names, s["kind"] + 1), s["start"].cast("string"), s["end"].cast("string"))), ",")


def redact(docs: DataFrame, text: str = "text", mark: str = "[SECRET]") -> DataFrame:
    """``docs`` with ``mark`` in place of each secret; overlapping secrets get one mark.  All other columns stay as they are."""
    aside = {c: f"__own_{c}" for c in docs.columns if c in ("base_spans", "secret_spans")}
    scanned = scan(docs.withColumnsRenamed(aside), text)
    value = F.coalesce(quoted(text), F.lit(""))
    cut = lambda at, by: F.struct(at.cast("long").alias("at"), F.lit(by).cast("long").alias("by"))

    def rebuild(x: Column) -> Column:
        """Pieces between the spans' edges and those of the blocks: a piece lies in one block; ``depth`` counts the spans it is in."""
        blocks = x["blocks"]
        edges = F.flatten(F.transform("secret_spans", lambda s: F.array(cut(s["start"], 1), cut(s["end"], -1))))
        ends = F.transform(F.sequence(F.lit(0), F.size(blocks) - 1), lambda i: cut(i * BLOCK, 0))
        return once(F.array_sort(F.concat(edges, ends)), lambda cuts: join(blocks, cuts))

    def join(blocks: Column, cuts: Column) -> Column:
        depth = F.slice(running(F.transform(cuts, lambda c: c["by"]), lambda a, v: a + v), 1, F.size(cuts))
        after = F.concat(F.slice(F.transform(cuts, lambda c: c["at"]), 2, F.size(cuts) - 1), F.array(F.size(blocks).cast("long") * BLOCK))
        parts = F.zip_with(F.zip_with(cuts, depth, lambda c, d: F.struct(c["at"].alias("at"), c["by"].alias("by"), d.alias("before"))), after, piece(blocks))
        return F.array_join(F.filter(parts, lambda p: p.isNotNull()), "")

    def piece(blocks: Column):
        def of(c: Column, end: Column) -> Column:
            block = F.element_at(blocks, F.least(F.floor(c["at"] / BLOCK) + 1, F.size(blocks)).cast("int"))
            inside = c["before"] + c["by"] > 0
            own = F.substring(block, (c["at"] % BLOCK + 1).cast("int"), (end - c["at"]).cast("int"))
            return F.when(inside, F.when((c["before"] == 0) & (c["by"] > 0), F.lit(mark)).otherwise(F.lit(""))).when(end > c["at"], own).otherwise(F.lit(""))

        return of

    rebuilt = once(F.struct(F.regexp_extract_all(value, F.lit("(?s).{1,%d}" % BLOCK), F.lit(0)).alias("blocks")), rebuild)
    cleaned = F.when(F.size("secret_spans") > 0, rebuilt).otherwise(quoted(text))
    return scanned.withColumn(text, cleaned).select(*[quoted(aside.get(c, c)).alias(c) for c in docs.columns])


def query(spark, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text")
    found = scan(docs)
    count = lambda kind: F.size(F.filter("base_spans", lambda s: s["kind"] == kind)).cast("long")
    return found.select("doc_id", *[count(i).alias(f"n_{KINDS[i]}") for i in range(3)], F.sha2(spelled("base_spans"), 256).alias("base_sha256"), spelled("secret_spans").alias("spans"))


def _sql_spans(name: str, kind: int, pattern: str, test: str) -> str:
    quoted_pattern = pattern.replace("'", "''")
    return f"""{name} AS (
  SELECT doc_id, {kind} AS kind, e - length(m) AS s, e, m FROM (
    SELECT doc_id, m, sum(length(gap) + coalesce(length(m), 0)) OVER (PARTITION BY doc_id ORDER BY i) AS e FROM (
      SELECT doc_id, unnest(string_split_regex(text, '{quoted_pattern}')) AS gap, unnest(regexp_extract_all(text, '{quoted_pattern}')) AS m,
             unnest(generate_series(1, len(regexp_extract_all(text, '{quoted_pattern}')) + 1)) AS i FROM d))
  WHERE m IS NOT NULL AND {test})"""


def _sql() -> str:
    long_enough = f"length(regexp_extract(m, '{ASSIGN.replace(chr(39), chr(39) * 2)}', 2)) >= 8"
    parts = [_sql_spans("k0", 0, ASSIGN, long_enough), _sql_spans("k1", 1, ACCESS, "length(m) >= 16"), _sql_spans("k2", 2, HEX, "length(m) >= 32"), "base AS (SELECT doc_id, kind, s, e FROM k0 UNION ALL SELECT doc_id, kind, s, e FROM k1 UNION ALL SELECT doc_id, kind, s, e FROM k2)"]
    for i, c in enumerate(CLASSES):
        parts.append(_sql_spans(f"c{i}", 3, c.candidates, "true"))
        parts.append(f"""r{i} AS (
  SELECT doc_id, s, e, regexp_replace(m, '{ALLOW_SPELLED}', '', 'g') AS rest FROM c{i}
  WHERE NOT EXISTS (SELECT 1 FROM base b WHERE b.doc_id = c{i}.doc_id AND b.s <= c{i}.s AND b.e >= c{i}.e))""")
        parts.append(f"""s{i} AS (
  SELECT DISTINCT doc_id, 3 AS kind, s, e FROM (
    SELECT doc_id, s, e, w, log2({c.width}) - sum(n * log2(n)) / {c.width} AS bits FROM (
      SELECT doc_id, s, e, w, ch, count(*) AS n FROM (
        SELECT doc_id, s, e, w, unnest(string_split(substr(rest, w + 1, {c.width}), '')) AS ch FROM (
          SELECT doc_id, s, e, rest, unnest(generate_series(0, length(rest) - {c.width})) AS w FROM r{i} WHERE regexp_matches(rest, '{MIXED}')))
      GROUP BY ALL) GROUP BY doc_id, s, e, w)
  WHERE bits >= {c.bits} - 1e-9)""")
    named = "['assign', 'access', 'hex', 'entropy'][kind + 1] || ':' || CAST(s AS BIGINT) || ':' || CAST(e AS BIGINT)"
    every = " UNION ALL ".join(["SELECT doc_id, kind, s, e FROM base", *(f"SELECT doc_id, kind, s, e FROM s{i}" for i in range(len(CLASSES)))])
    return f"""WITH d AS (SELECT doc_id, coalesce(text, '') AS text FROM documents), {", ".join(parts)},
b AS (SELECT doc_id, count(*) FILTER (WHERE kind = 0) AS n_assign, count(*) FILTER (WHERE kind = 1) AS n_access, count(*) FILTER (WHERE kind = 2) AS n_hex, string_agg({named}, ',' ORDER BY s, kind) AS spelled FROM base GROUP BY doc_id),
a AS (SELECT doc_id, string_agg({named}, ',' ORDER BY s, kind, e) AS spelled FROM (SELECT DISTINCT * FROM ({every})) GROUP BY doc_id)
SELECT d.doc_id, coalesce(n_assign, 0) AS n_assign, coalesce(n_access, 0) AS n_access, coalesce(n_hex, 0) AS n_hex, sha256(coalesce(b.spelled, '')) AS base_sha256, coalesce(a.spelled, '') AS spans
FROM d LEFT JOIN b USING (doc_id) LEFT JOIN a USING (doc_id)"""


SQL = _sql()
