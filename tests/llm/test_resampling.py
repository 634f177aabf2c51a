"""Importance resampling against a plain draw, and its parts."""

import collections
import hashlib
import math
import re
import zlib

import numpy as np
import pyarrow as pa
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from tests.llm.test_llm import ODD, rows_of, table
from timbrel.llm import resampling
from timbrel.llm import textkit as tk

WORD = re.compile(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+")


def words(text):
    return WORD.findall("".join(c.lower() if "A" <= c <= "Z" else c for c in text or ""))


def features(text, size=1):
    w = words(text)
    return [" ".join(w[i : i + size]) for i in range(len(w) - size + 1)]


def bucket(feature):
    return zlib.crc32(feature.encode()) % 10_000


def brute(docs, target, size=1, percent=10, least=20):
    s, t = (collections.Counter(bucket(f) for _, x in rows for f in features(x, size)) for rows in (docs, target))
    gain = lambda b: math.floor(1000 * math.log((t[b] + 1) * (s.total() + 10_000) / ((s[b] + 1) * (t.total() + 10_000))))
    out = []
    for doc_id, text in docs:
        own = [gain(bucket(f)) for f in features(text, size)]
        weight = sum(own) // len(own) if own else 0
        h = int(hashlib.sha256(f"2024:{'' if doc_id is None else doc_id}".encode()).hexdigest()[:8], 16)
        out.append([doc_id, len(own), weight, weight + math.floor(-1000 * math.log(-math.log((h + 0.5) / 4294967296))), len(words(text))])
    able = sorted((r for r in out if r[4] >= least), key=lambda r: (-r[3], r[0] is None, r[0] or 0, -r[1], -r[2]))
    place = {id(r): i + 1 for i, r in enumerate(able[: len(able) * percent // 100])}
    return sorted(((*r[:4], place.get(id(r))) for r in out), key=str)


@given(st.lists(st.text(alphabet="aBZ0é日 -\x00", max_size=90), max_size=6), st.integers(1, 3))
@settings(max_examples=80, deadline=None)
def test_buckets(texts, size):
    data, at = tk.string_parts(pa.array(texts, pa.string()))
    n_words, row, found = resampling.buckets(data[at[0] : at[-1]], at - at[0], size)
    assert list(n_words) == [len(words(t)) for t in texts]
    assert list(zip(row.tolist(), found.tolist(), strict=True)) == [(i, bucket(f)) for i, t in enumerate(texts) for f in features(t, size)]


def test_crc32_of_long_words():
    data = np.frombuffer(b"q" * 5000 + b"xyz" * 70, np.uint8)
    start, end = np.array([0, 5, 0, 4999, 7]), np.array([5000, 70, 64, 5210, 7])
    assert resampling.span_crc32(data, start, end).tolist() == [zlib.crc32(data[a:b]) for a, b in zip(start, end, strict=True)]


def many(n):
    rng = np.random.default_rng(3)
    vocabulary = [f"w{i}" for i in range(60)]
    return [(i, " ".join(rng.choice(vocabulary, rng.integers(1, 60)))) for i in range(n)]


@pytest.mark.parametrize("size,percent", [(1, 10), (2, 35), (1, 100), (1, 0)])
def test_draw(spark, size, percent):
    # ties: one id many times over, with one text and with several; null ids
    docs = [*many(300), *ODD, *[(77, "a " * 30)] * 40, *[(78, "b c " * (20 + i)) for i in range(9)], *[(None, "c d e " * 9)] * 3]
    target = [(i, f"w{i} w{i + 1} w3 A b") for i in range(20)]
    got = resampling.resample(table(spark, docs).withColumns({c: F.lit("own") for c in ("score", "rank", "weight", "n_words", "above", "survivor")}), table(spark, target).withColumnRenamed("doc_id", "item_id"), percent, size)
    assert rows_of(got) == brute(docs, target, size, percent)


def test_draw_of_nothing(spark):
    none, some = table(spark, []), table(spark, many(40))
    assert rows_of(resampling.resample(none, none)) == []
    assert rows_of(resampling.resample(none, some)) == []
    assert rows_of(resampling.resample(some, none)) == brute(many(40), [])
    short = [(1, "too short"), (2, None)]
    assert rows_of(resampling.resample(table(spark, short), none)) == brute(short, [])


def test_target_texts_rise(spark):
    docs = many(1000) + [(1000 + i, "alpha beta gamma delta " * 10) for i in range(50)]
    drawn = [r["doc_id"] for r in resampling.resample(table(spark, docs), table(spark, [(1, "alpha beta gamma delta " * 50)])).where("rank is not null").collect()]
    share = sum(d >= 1000 for d in drawn) / 50
    assert share > 0.5 > 5 * sum(d < 1000 for d in drawn) / 1000
