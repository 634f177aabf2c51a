"""Chunked recordings against whole ones, and spans against pairs."""

import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from tests.test_sources import write
from timbrel.operators import chunks, intervals, slices
from timbrel.sources import arrays, readers

SIZES = {"a": 16_000 * 7 + 333, "b": 16_000 * 4, "c": 160, "d": 1, "e": 16_000 * 2 - 1, "f": 0}


@pytest.fixture(scope="module")
def folder(tmp_path_factory):
    at = tmp_path_factory.mktemp("long")
    rng = np.random.default_rng(8)
    for name, n in SIZES.items():
        write(at / f"{name}.wav", np.clip(rng.normal(size=n) * 0.05 * (1 + np.sin(np.arange(n) / 3000)), -1, 1), 16_000)
    write(at / "g.wav", rng.uniform(-0.3, 0.3, 44_100 * 5 + 17), 44_100)
    return str(at)


def name(row):
    return row["path"].rsplit("/", 1)[1]


@pytest.mark.parametrize("seconds", [1, 2])
def test_spectrogram_of_chunks(spark, folder, seconds):
    got = {}
    for r in chunks.mel_frames(arrays.wave_chunks(spark, folder, seconds, chunks.FRAME_HALO, partition_bytes=30_000)).collect():
        got.setdefault(name(r), {}).setdefault(r["frame"], []).append(r["mel"])
    for file, frames in got.items():
        whole = slices.mel_spectrogram(readers.decode(open(f"{folder}/{file}", "rb").read()))
        assert sorted(frames) == list(range(len(whole))) and all(len(v) == 1 for v in frames.values())
        np.testing.assert_allclose(np.array([frames[i][0] for i in range(len(whole))]), whole, rtol=1e-4, atol=1e-6)
    assert len(got) == 7


@pytest.mark.parametrize("encoder", ["timbre", "emotion"])
def test_vectors_of_chunks(spark, folder, encoder):
    cut = arrays.wave_chunks(spark, folder, 1, chunks.SLICE_HALO, partition_bytes=30_000)
    whole = slices.embed(readers.waveforms(readers.utterances(spark, folder)), encoder)
    want = {r["filename"].rsplit("/", 1)[1]: r["v"] for r in whole.collect()}
    got = {name(r): r["v"] for r in chunks.embed(cut, encoder).collect()}
    assert got.keys() == want.keys() and len(got) == 7
    for file in want:
        np.testing.assert_allclose(got[file], want[file], rtol=1e-4, atol=1e-6)


def test_short_halo_and_other_rates_are_refused(spark, folder):
    for halo, rate, says in ((10, 16_000, "halo"), (chunks.FRAME_HALO, 8_000, "16000")):
        with pytest.raises(Exception, match=says):
            chunks.mel_frames(arrays.wave_chunks(spark, folder, 1, halo, rate)).collect()


def test_volume_of_chunks(spark, folder):
    cut = arrays.wave_chunks(spark, folder, 1, 77)
    level = {name(r): r["power"] for r in chunks.loudness(cut).collect()}
    for file, power in level.items():
        x = readers.decode(open(f"{folder}/{file}", "rb").read()).astype(float)
        assert power is None if not len(x) else power == pytest.approx((x**2).mean(), rel=1e-6)
    loud = chunks.loudness(chunks.at_volume(cut, -6.0)).where("power is not null and power > 0").collect()
    assert all(10 * np.log10(r["power"]) == pytest.approx(-6, abs=1e-3) for r in loud) and len(loud) >= 5
    assert chunks.at_volume(cut).columns == cut.columns


@pytest.mark.parametrize("n", [0, 1, 159, 160, 25_599, 25_600, 32_000, 48_000, 160_000, 1_234_567])
def test_slice_starts(spark, n):
    rows = slices.partial_slices(spark.createDataFrame([(1, n)], "id long, n long"), "n").orderBy("part").collect()
    assert slices.slice_starts(n).tolist() == [r["mel_start"] for r in rows]


@pytest.mark.parametrize("timed", [False, True])
def test_points_within_spans(spark, timed):
    rng = random.Random(3)
    points = [(rng.choice(["a", "b", None]), i, rng.randrange(-500, 5000)) for i in range(400)] + [("a", 400, None)]
    spans = []
    for i in range(120):
        low = rng.randrange(-600, 5000)
        spans.append((rng.choice(["a", "b", None]), i, low, low + rng.choice([0, 1, 2, 3, 8, 17, 1000, 6000, -4])))
    spans += [("a", 900, None, 5), ("a", 901, 5, None)]
    p, s = spark.createDataFrame(points, "k string, p long, at long"), spark.createDataFrame(spans, "k string, s long, low long, high long")
    if timed:
        p, s = p.withColumn("at", F.timestamp_micros("at")), s.withColumns({c: F.timestamp_micros(c) for c in ("low", "high")})
    for by in ([], ["k"]):
        got = intervals.within(p if by else p.withColumnRenamed("k", "own"), s, "at", "low", "high", by)
        plan = got._jdf.queryExecution().executedPlan().toString()
        assert "NestedLoop" not in plan and "Cartesian" not in plan
        want = [(a, b) for k, a, x in points for m, b, low, high in spans if None not in (x, low, high) and low <= x < high and (not by or k is not None and k == m)]
        assert sorted((r["p"], r["s"]) for r in got.collect()) == sorted(want)
    with pytest.raises(ValueError, match="both tables"):
        intervals.within(p, s.withColumnRenamed("s", "P"), "at", "low", "high", ["k"])
    assert intervals.within(p, s.where("s < 0"), "at", "low", "high", ["k"]).count() == 0
