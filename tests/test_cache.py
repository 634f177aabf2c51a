"""The versioned feature cache: concurrent writers, crashes, and plans without a shuffle of the cache."""

import datetime as dt
import threading

import pytest
from pyspark.sql import functions as F

from timbrel.sources.cache import KEYS, FeatureCache

SCHEMA = "filename string, length long, modified timestamp, v array<double>"
WHEN = dt.datetime(2024, 3, 1)


def rows(spark, names, value=1.0):
    return spark.createDataFrame([(n, len(n), WHEN, [value, 2.0]) for n in names], SCHEMA)


def told(df):
    return sorted((r["filename"], r["v"][0]) for r in df.collect())


@pytest.fixture
def cache(spark, tmp_path):
    return FeatureCache(spark, f"file://{tmp_path}/cache", 4)


def test_misses_and_versions(spark, cache):
    names = [f"u{i:02d}.wav" for i in range(20)]
    files = rows(spark, names).drop("v")
    assert cache.misses(files, "s", "timbre").count() == 20 and cache.read("s", "timbre").count() == 0
    cache.write(rows(spark, names[:15]), "s", "timbre", "1")
    assert sorted(r["filename"] for r in cache.misses(files, "s", "timbre").collect()) == names[15:]
    assert cache.misses(files, "s", "emotion").count() == cache.misses(files, "", "timbre").count() == 20
    cache.write(rows(spark, names[10:], 5.0), "s", "timbre", "2")
    cache.write(rows(spark, ["e.wav"], 7.0), "", "timbre")
    assert told(cache.read("s", "timbre")) == [(n, 1.0) for n in names[:10]] + [(n, 5.0) for n in names[10:]]
    assert told(cache.read("", "timbre")) == [("e.wav", 7.0)]
    # a changed file is a miss
    assert cache.misses(files.withColumn("length", F.col("length") + 1), "s", "timbre").count() == 20
    # another session's view of the path has the same layout
    again = FeatureCache(spark, cache.path, 99)
    assert again.buckets == 4 and again.read("s", "timbre").count() == 20


def test_two_writers_at_once(spark, cache):
    names = [f"n{i}" for i in range(40)]
    failed = []

    def write(value):
        try:
            cache.write(rows(spark, names, value), "s", "mix")
        except Exception as e:  # noqa: BLE001
            failed.append(e)

    threads = [threading.Thread(target=write, args=(float(k),)) for k in range(3)]
    for t in threads:
        t.start()
    for t in threads:
        t.join()
    assert not failed and len(cache.versions("s", "mix")) == 3
    got = told(cache.read("s", "mix"))
    assert [n for n, _ in got] == sorted(names) and len({v for _, v in got}) == 1
    assert cache.misses(rows(spark, names).drop("v"), "s", "mix").count() == 0


def test_unfinished_versions_are_not_seen(spark, cache, monkeypatch):
    def stopped(*_):
        raise OSError("stopped")

    with monkeypatch.context() as m:
        m.setattr(cache, "_note", stopped)
        with pytest.raises(OSError):
            cache.write(rows(spark, ["a", "b"]), "s", "timbre", "7")
    assert cache.read("s", "timbre").count() == 0 and cache.misses(rows(spark, ["a"]).drop("v"), "s", "timbre").count() == 1
    cache.write(rows(spark, ["a"], 3.0), "s", "timbre", "7")  # run again: the version is overwritten
    assert told(cache.read("s", "timbre")) == [("a", 3.0)]


def test_the_cache_is_not_shuffled(spark, cache):
    cache.write(rows(spark, [f"n{i}" for i in range(50)]), "s", "timbre")
    files = rows(spark, ["n1", "zz"]).drop("v").repartition(4, *KEYS)
    read = cache.read("s", "timbre")._jdf.queryExecution().executedPlan().toString()
    assert "Exchange" not in read
    missed = cache.misses(files, "s", "timbre")
    plan = missed._jdf.queryExecution().executedPlan().toString()
    # files dealt by the key as the cache is meet it as they are
    assert plan.count("Exchange") == 1 and "Exchange hashpartitioning(filename" in plan.split("Scan parquet")[0]
    assert [r["filename"] for r in missed.collect()] == ["zz"]
