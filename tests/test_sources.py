"""Data sources of matrices and recordings, and the sound kernels, against numpy on whole files."""

import os
import wave

import numpy as np
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from timbrel.sources import arrays, readers, sound, writers


def matrix_of(df):
    rows = df.orderBy("id").collect()
    return [r["id"] for r in rows], np.array([r["v"] for r in rows])


@pytest.mark.parametrize("dtype,order", [("<f4", "C"), ("<f8", "F"), (">f4", "C"), ("<i2", "F"), ("|u1", "C")])
def test_matrix_in_shares(spark, tmp_path, dtype, order):
    m = np.asarray(np.random.default_rng(1).normal(size=(997, 6)) * 50, np.dtype(dtype) if dtype != "|u1" else np.int64).astype(dtype)
    np.save(tmp_path / "m.npy", np.asarray(m, order=order))
    df = arrays.matrices(spark, str(tmp_path / "m.npy"), partition_bytes=1500)
    assert df.rdd.getNumPartitions() == -(-os.path.getsize(tmp_path / "m.npy") // 1500) > 3
    ids, got = matrix_of(df)
    assert ids == list(range(997)) and (got == m.astype(float)).all()


def test_filters_go_down_to_the_file(spark, tmp_path, monkeypatch):
    m = np.arange(60_000.0).reshape(10_000, 6)
    np.save(tmp_path / "m.npy", m)
    path = f"file://{tmp_path}/m.npy"
    df = arrays.matrices(spark, path, partition_bytes=50_000).where("id >= 4321 and id < 4330")
    plan = df._jdf.queryExecution().toString()
    assert " Filter " not in plan.split("== Physical Plan ==")[1]
    assert [r["id"] for r in df.orderBy("id").collect()] == list(range(4321, 4330))
    for where, want in (("id in (3, 9999, 77)", [3, 77, 9999]), ("id = 5 and id > 7", []), ("id > 9997", [9998, 9999]), ("id <= 1", [0, 1]), ("id is null", [])):
        assert sorted(r["id"] for r in arrays.matrices(spark, path).where(where).collect()) == want

    # one share holds the rows: the others read their header and no number
    asked = []
    monkeypatch.setattr(arrays, "matrix_rows", lambda f, head, low, high, whole=arrays.matrix_rows: asked.append((low, high)) or whole(f, head, low, high))
    reader = arrays.MatrixReader({"path": path, "partition_bytes": "50000"})
    rest = list(reader.pushFilters([arrays.GreaterThanOrEqual(("id",), 4321), arrays.LessThan(("id",), 4330)]))
    parts = reader.partitions()
    assert rest == [] and len(parts) == 10 and sum(b.num_rows for p in parts for b in reader.read(p)) == 9 and asked == [(4321, 4330)]
    reader = arrays.MatrixReader({"path": str(tmp_path)})
    list(reader.pushFilters([arrays.EqualTo(("path",), "/none.npy")]))
    assert [p.files for p in reader.partitions()] == [[]]


def test_folder_of_matrices(spark, tmp_path):
    parts = [np.random.default_rng(k).normal(size=(n, 3)) for k, n in enumerate((5, 0, 1, 40))]
    for k, m in enumerate(parts):
        np.save(tmp_path / f"part-{k}.npy", m)
    (tmp_path / "notes.txt").write_text("none")
    (tmp_path / ".hidden.npy").write_text("none")
    ids, got = matrix_of(readers.npy_matrix(spark, str(tmp_path)))
    assert ids == list(range(46)) and (got == np.concatenate(parts)).all()
    assert {tuple(r)[1:] for r in arrays.headers(spark, str(tmp_path)).collect()} == {(5, 3), (0, 3), (1, 3), (40, 3)}
    np.save(tmp_path / "part-9.npy", np.zeros((2, 4)))
    with pytest.raises(ValueError, match="one width"):
        readers.npy_matrix(spark, str(tmp_path))


@pytest.mark.parametrize("bad", [np.zeros((2, 2, 2)), np.zeros(3), np.array([[1, "a"]], object), np.array([[1j]]), np.array([["a"]])])
def test_other_files_are_refused(spark, tmp_path, bad):
    np.save(tmp_path / "m.npy", bad, allow_pickle=True)
    with pytest.raises(Exception, match="2 dimensions|real numbers|allow_pickle|Object arrays"):
        arrays.matrices(spark, str(tmp_path)).collect()
    with pytest.raises(Exception, match="nowhere"):
        arrays.matrices(spark, str(tmp_path / "nowhere")).collect()


def test_written_matrices(spark, tmp_path):
    out = f"file://{tmp_path}/out"
    m = np.random.default_rng(5).normal(size=(500, 4)).astype(np.float32)
    df = spark.createDataFrame([(i, v.tolist()) for i, v in enumerate(m)], "id long, v array<double>").repartitionByRange(4, "id").sortWithinPartitions("id")
    arrays.write_matrices(df, out, dtype="float32", partition_bytes=600)
    assert len(os.listdir(tmp_path / "out")) > 8
    ids, got = matrix_of(readers.npy_matrix(spark, out))
    assert ids == list(range(500)) and (got == m).all()
    arrays.write_matrices(df.limit(10), out, "overwrite")
    assert readers.npy_matrix(spark, out).count() == 10
    # a failing task leaves the folder as it was
    before = sorted(os.listdir(tmp_path / "out"))
    for wrong in ("id = 77", "id > 70"):
        bad = df.withColumn("v", F.when(F.expr(wrong), F.array(F.lit(1.0))).otherwise(F.col("v")))
        with pytest.raises(Exception, match="one length"):
            arrays.write_matrices(bad.coalesce(1), out)
    assert sorted(os.listdir(tmp_path / "out")) == before
    arrays.write_matrices(df.where("id < 0"), out)
    assert readers.npy_matrix(spark, out).count() == 10


def write(path, x, rate, width=2, channels=1):
    with wave.open(str(path), "wb") as f:
        f.setnchannels(channels)
        f.setsampwidth(width)
        f.setframerate(rate)
        if width == 1:
            raw = (x * 127 + 128).astype(np.uint8).tobytes()
        else:
            whole = np.round(np.asarray(x) * ((1 << (8 * width - 1)) - 1)).astype("<i8")
            raw = whole.view(np.uint8).reshape(-1, 8)[:, :width].tobytes()
        f.writeframes(raw)


@pytest.mark.parametrize("own,rate,width,channels", [(100, 0, 2, 1), (100, 100, 3, 2), (441, 160, 2, 1), (80, 160, 1, 1), (160, 75, 4, 2)])
def test_chunks_are_the_whole_recording(spark, tmp_path, own, rate, width, channels):
    rng = np.random.default_rng(own)
    sizes = {"a": 9 * own + 7, "b": 2 * own, "c": 1, "d": 0}
    for name, n in sizes.items():
        write(tmp_path / f"{name}.wav", rng.uniform(-0.9, 0.9, n * channels), own, width, channels)
    halo, out = 30, rate or own
    rows = arrays.wave_chunks(spark, str(tmp_path), seconds=2, halo=halo, rate=rate, partition_bytes=700).collect()
    for name in sizes:
        whole = readers.decode((tmp_path / f"{name}.wav").read_bytes(), out)
        own_rows = sorted((r for r in rows if r["path"].endswith(f"/{name}.wav")), key=lambda r: r["chunk"])
        assert [r["chunk"] for r in own_rows] == list(range(max(1, -(-len(whole) // (2 * out)))))
        for r in own_rows:
            a, b = r["start"] - r["lead"], min(len(whole), r["start"] + r["n"] + halo)
            assert r["rate"] == out and r["n_samples"] == len(whole) and r["lead"] == min(halo, r["start"])
            np.testing.assert_allclose(r["samples"], whole[a:b], atol=1e-6)
        assert sum(r["n"] for r in own_rows) == len(whole)
    some = arrays.wave_chunks(spark, str(tmp_path), seconds=2, rate=rate).where("chunk = 1").collect()
    assert len(some) == sum(r["chunk"] == 1 for r in rows)


def test_files_written(spark, tmp_path):
    waves = spark.createDataFrame([("x/a.wav", [0.5, -0.5]), ("b.wav", [])], "filename string, samples array<double>")
    got = writers.write_files(writers.wav_files(waves, pad=0.0), str(tmp_path / "w")).collect()
    assert sorted(os.listdir(tmp_path / "w")) == ["a.wav", "b.wav"] == sorted(os.path.basename(r["path"]) for r in got)
    assert len(readers.decode((tmp_path / "w" / "a.wav").read_bytes())) == 2


def tone(hz, rate, seconds=1.0):
    return np.sin(2 * np.pi * hz * np.arange(int(rate * seconds)) / rate)


def inner(x):
    return x[len(x) // 8 : -len(x) // 8]


@pytest.mark.parametrize("own", [22_050, 32_000, 44_100, 48_000])
def test_tones_beyond_the_limit_go(own):
    rms = lambda x: np.sqrt((x**2).mean())
    for hz in (8_700, 9_500, 10_900):
        assert 20 * np.log10(rms(inner(sound.resample(tone(hz, own), own))) / rms(tone(hz, own))) < -60
    for hz in (50, 1000, 6_900):
        got = sound.resample(tone(hz, own), own)
        assert len(got) == 16_000 and np.abs(inner(got) - inner(tone(hz, 16_000))).max() < 1e-3
    up = sound.resample(tone(3_000, 8_000), 8_000)
    assert np.abs(inner(up) - inner(tone(3_000, 16_000))).max() < 1e-3


@given(st.integers(1, 400), st.sampled_from([(3, 2), (2, 3), (441, 160), (7, 7), (1, 5)]))
@settings(max_examples=60, deadline=None)
def test_resampling_by_definition(n, rates):
    own, rate = rates
    x = np.random.default_rng(n).normal(size=n)
    got = sound.resample(x, own, rate)
    assert len(got) == sound.resampled_size(n, own, rate) == -(-n * rate // own)
    if own == rate:
        return
    cutoff = min(1, rate / own) * sound.ROLLOFF
    half = int(np.ceil(sound.ZEROS * max(1, own / rate))) + 1
    for i in {0, len(got) // 2, len(got) - 1}:
        at = i * own / rate
        k = np.arange(int(np.floor(at + 1e-9)) - half + 1, int(np.floor(at + 1e-9)) + half + 1)
        w = cutoff * np.sinc(cutoff * (k - at)) * np.i0(sound.BETA * np.sqrt(np.maximum(0, 1 - ((k - at) / half) ** 2))) / np.i0(sound.BETA)
        assert abs(got[i] - (x[np.clip(k, 0, n - 1)] * w).sum() / w.sum()) < 1e-5


def test_voice_activity():
    rng = np.random.default_rng(2)
    noise = lambda s, db: rng.normal(size=int(16_000 * s)) * 10 ** (db / 20)
    speech = [noise(0.9, -20), noise(1.2, -25)]
    x = np.concatenate([noise(3, -55), speech[0], noise(2.1, -55), speech[1], noise(3, -55)])
    on = sound.voiced(sound.levels(x))
    seconds = np.arange(len(on)) * sound.WINDOW
    inside = ((seconds >= 3) & (seconds < 3.87)) | ((seconds >= 6) & (seconds < 7.17))
    assert on[inside].all()
    # beyond speech only what hangs over
    assert on.sum() <= inside.sum() + 2 * (sound.HANG + 2)
    assert 2.1 <= len(readers.preprocess(x.astype(np.float32))) / 16_000 <= 2.1 + 2 * 0.03 * (sound.HANG + 2)


def test_voice_activity_at_the_edges():
    assert not sound.voiced(np.zeros(0)).any()
    assert not sound.voiced(np.full(100, -120.0)).any()
    assert sound.voiced(np.full(100, -30.0)).all()  # no pause to tell the noise by
    # hysteresis: a dip to between both bars goes on, one under the lower bar ends after hanging over
    level = np.concatenate([np.full(100, -60.0), np.full(20, -35.0), np.full(40, -53.0), np.full(100, -60.0), [-10.0]])
    on = sound.voiced(level)
    assert not on[:100].any() and on[100:160].all() and on[160 : 160 + sound.HANG].all() and not on[160 + sound.HANG : -1].any()
    assert not sound.voiced(np.concatenate([np.full(100, -60.0), np.full(40, -53.0), [-10.0]]))[:-1].any()
    quiet = np.full(16_000, 0.1, np.float32)
    assert len(readers.preprocess(np.concatenate([np.zeros(48_000, np.float32), quiet]))) < 20_000
    assert len(readers.preprocess(np.zeros(0, np.float32))) == 0 and len(readers.preprocess(np.ones(3, np.float32))) == 3
