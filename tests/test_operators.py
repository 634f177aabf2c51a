"""Operators against dense restatements, planted data and properties."""

import json
import math
import os
import wave

import numpy as np
import pyarrow as pa
import pytest
from hypothesis import given
from hypothesis import strategies as st
from pyspark.sql import functions as F

from timbrel.functions import vectors as V
from timbrel.operators import density, encoders, postprocess, project, series, similarity, slices, spectral
from timbrel.plans import clustering
from timbrel.sources import readers, writers


def frame(spark, x, labels=None):
    rows = [(i, [float(a) for a in v]) + ((int(labels[i]),) if labels is not None else ()) for i, v in enumerate(x)]
    return spark.createDataFrame(rows, "id long, v array<double>" + (", clust int" if labels is not None else ""))


def planted(k, each=30, dims=16, seed=3, spread=0.05):
    rng = np.random.default_rng(seed)
    centres = np.abs(rng.normal(size=(k, dims))) * np.eye(k, dims)[:, ::-1] + np.eye(k, dims) * 5
    return np.concatenate([c + spread * rng.normal(size=(each, dims)) for c in centres]), np.repeat(np.arange(k), each)


def same_partition(a, b):
    return len(set(zip(a, b, strict=True))) == len(set(a)) == len(set(b))


def labels_of(df):
    return [r["clust"] for r in df.orderBy("id").collect()]


@given(st.integers(0, 3000))
def test_keep_count(n):
    keep = similarity.keep_count(n)
    assert keep == (n if n < 6 else n - min(int(0.98 * n), n - 6))


def test_blocks_agree(spark):
    x = np.random.default_rng(1).normal(size=(70, 5))
    x[3] = 0
    df = frame(spark, x)
    one = {(r["i"], r["j"]): round(r["c"], 9) for r in similarity.knn_prune(df, keep=7).collect()}
    many = {(r["i"], r["j"]): round(r["c"], 9) for r in similarity.knn_prune(df, keep=7, block=9).collect()}
    assert one == many and len(one) == 70 * 7
    assert similarity.cosine_pairs(df, block=9).count() == 70 * 69 // 2


def test_all_pairs_shuffle_no_copies_and_come_in_order(spark):
    x = np.random.default_rng(2).normal(size=(90, 5))
    df = frame(spark, x).unionByName(frame(spark, x[:1]).withColumn("id", F.lit(None).cast("long")))
    unit = x / np.linalg.norm(x, axis=1, keepdims=True)
    for blocks in (1, 2, 5, 6):
        pairs = similarity.cosine_pairs(df, block=math.ceil(91 / blocks))
        # vectors were sent once for each block before
        assert "Exchange" not in pairs._jdf.queryExecution().executedPlan().toString()
        got = pairs.collect()
        assert {(r["i"], r["j"]): round(r["c"], 9) for r in got} == {(a, b): round(float(unit[a] @ unit[b]), 9) for a in range(90) for b in range(a + 1, 90)}
        assert len(got) == 90 * 89 // 2
    cut = {(r["i"], r["j"]) for r in similarity.cosine_pairs(df, block=20, least=0.3).collect()}
    assert cut == {(a, b) for a in range(90) for b in range(a + 1, 90) if unit[a] @ unit[b] >= 0.3}


def test_small_numbers_round_as_decimals_do(spark):
    values = [0.0, -0.0, 0.1234564, -0.1234566, 1 / 128, -1 / 128, -1e-9, 1.0, -1.0, float("nan"), None]
    df = spark.createDataFrame([(v,) for v in values], "x double")
    got = df.select(V.tidy(F.col("x")).alias("a"), V.tidy_small(F.col("x")).alias("b")).collect()
    assert [repr(r["a"]) for r in got] == [repr(r["b"]) for r in got]


def test_laplacian_rows_sum_to_zero(spark):
    x, _ = planted(2)
    lap = similarity.laplacian(similarity.affinity(frame(spark, x)))
    assert lap.groupBy("i").agg(F.abs(F.sum("l")).alias("s")).agg(F.max("s")).first()[0] < 1e-9


@pytest.mark.parametrize("k", [2, 3, 5])
def test_planted_spectral(spark, k):
    x, truth = planted(k, each=30)
    got = clustering.cluster(frame(spark, x), "spectral", nmin=2)
    assert same_partition(labels_of(got), list(truth))


def test_dense_restatement(spark):
    x, _ = planted(3, each=20, spread=0.6)
    solved = spectral.spectrum(similarity.affinity(frame(spark, x)), frame(spark, x).select("id")).first()["values"]
    u = x / np.linalg.norm(x, axis=1, keepdims=True)
    c = u @ u.T
    keep = similarity.keep_count(len(x))
    for i in range(len(x)):
        c[i, np.argsort(c[i])[: len(x) - keep]] = 0
    c = 0.5 * (c + c.T)
    np.fill_diagonal(c, 0)
    want = np.linalg.eigvalsh(np.diag(np.abs(c).sum(axis=1)) - c)
    assert np.allclose(solved, want[: len(solved)], atol=1e-9)


def test_lanczos_agrees(spark):
    x = np.abs(np.random.default_rng(8).normal(size=(11, 4)))
    edges = similarity.affinity(frame(spark, x)).cache()
    ids = frame(spark, x).select("id").cache()
    dense = spectral.dense_spectrum(edges, ids, 3).first()["values"]
    sparse = spectral.lanczos_spectrum(edges, ids, 3, steps=11).first()["values"]
    assert np.allclose(dense, sparse, atol=1e-6)


def test_lanczos_of_components(spark):
    x, truth = planted(5, each=60)
    edges, ids = similarity.affinity(frame(spark, x)).cache(), frame(spark, x).select("id").cache()
    dense = spectral.dense_spectrum(edges, ids, 15).first()["values"]
    solved = spectral.lanczos_spectrum(edges, ids, 15).cache()
    assert sum(abs(v) < 1e-9 for v in dense) >= 5 and np.allclose(dense, solved.first()["values"], atol=1e-6)
    u = np.array([r["u"] for r in solved.orderBy("id").collect()])
    assert np.allclose(u.T @ u, np.eye(15), atol=1e-6)


def test_choose_k():
    assert spectral.choose_k([0, 1, 1.1, 3], 1, 14) == 3
    assert spectral.choose_k([0, 1, 2, 3], 1, 14) == 1
    assert spectral.choose_k([0, 1], k=5) == 5
    for bad in (0, 15):
        with pytest.raises(ValueError):
            spectral.choose_k(list(range(20)), bad, 14)


def test_few_points(spark):
    x = np.eye(10)
    assert labels_of(clustering.cluster(frame(spark, x[:9]))) == [1] * 9
    assert postprocess.small_n_fallback(frame(spark, x)) is None
    assert clustering.cluster(frame(spark, x[:0])).count() == 0


def test_absorption(spark):
    x = np.array([[1, 0]] * 5 + [[0, 1]] * 4 + [[0.1, 1]] * 3)
    assert labels_of(postprocess.absorb_minor(frame(spark, x, [0] * 5 + [1] * 4 + [2] * 3))) == [0] * 5 + [1] * 7
    noise = labels_of(postprocess.absorb_minor(frame(spark, x, [0] * 5 + [-1] * 4 + [2] * 3)))
    assert noise == [0] * 5 + [-1] * 7
    small = [0, 0, 0, 1, 1, 1, 2, 2, 2, 3, 3, 3]
    assert labels_of(postprocess.absorb_minor(frame(spark, x, small))) == small


def test_merge(spark):
    x = np.array([[1, 0], [1, 0.0], [1, 0.1], [1, 0.12], [0, 1], [-1, 0]])
    assert labels_of(postprocess.merge_by_cosine(frame(spark, x, [3, 3, 1, 1, 0, 2]), 0.9)) == [1, 1, 1, 1, 0, 2]
    exact = np.array([[1.0, 0.0], [0.6, 0.8]])
    assert labels_of(postprocess.merge_by_cosine(frame(spark, exact, [0, 1]), 0.6)) == [0, 0]
    apart = np.array([[1.0, 0.0], [-1.0, 0.0]])
    assert labels_of(postprocess.merge_by_cosine(frame(spark, apart, [0, 1]), 0.1)) == [0, 1]
    with pytest.raises(ValueError):
        postprocess.merge_by_cosine(frame(spark, exact, [0, 1]), 0)


def plain_merge(names, sums, counts, threshold):
    """The published loop: all cosines again after each merge."""
    sums, counts = dict(zip(names, sums, strict=True)), dict(zip(names, counts, strict=True))
    to = {c: c for c in names}
    while len(sums) > 1:
        order = sorted(sums)
        m = np.stack([sums[c] / counts[c] for c in order])
        unit = m / np.maximum(np.linalg.norm(m, axis=1, keepdims=True), 1e-300)
        aff = np.triu(unit @ unit.T, 1)
        i, j = np.unravel_index(int(aff.argmax()), aff.shape)
        if i >= j or aff[i, j] < threshold:
            break
        keep, gone = order[i], order[j]
        sums[keep] = sums[keep] + sums.pop(gone)
        counts[keep] += counts.pop(gone)
        to = {c: keep if t == gone else t for c, t in to.items()}
    return to


def directions(kind, seed):
    rng = np.random.default_rng(seed)
    if kind == "chain":  # each near the next: merging drifts along
        return np.stack([np.cos(np.arange(30) / 5), np.sin(np.arange(30) / 5)], axis=1) + rng.normal(size=(30, 2)) * 0.01
    if kind == "noise":
        return rng.normal(size=(60, 4))
    centres = rng.normal(size=(12, 24))
    return centres[rng.integers(0, 12, 90)] + 0.3 * rng.normal(size=(90, 24))


@pytest.mark.parametrize("kind,threshold", [("chain", 0.97), ("noise", 0.8), ("noise", 0.3), ("groups", 0.9), ("groups", 0.5)])
def test_merging_of_many_labels(spark, kind, threshold):
    """Groups that cannot touch give what the plain loop gives, wherever the bound of one task lies."""
    m = directions(kind, 5)
    names = np.random.default_rng(1).permutation(len(m)) * 3
    n = np.random.default_rng(2).integers(1, 9, len(m))
    order = np.argsort(names)
    want = plain_merge(names[order].tolist(), (m * n[:, None])[order], n[order].tolist(), threshold)
    assert postprocess.merge_loop(names[order], (m * n[:, None])[order], n[order], threshold) == want
    table = spark.createDataFrame([(int(c), v.tolist(), int(k)) for c, v, k in zip(names, m, n, strict=True)], "clust int, cv array<double>, n long")
    for limit in (10_000, 5):
        got = {r["clust"]: r["merged"] for r in postprocess.merged_labels(table, threshold, limit, block=16).collect()}
        assert {c: got.get(c, c) for c in want} == want
    roots = {r["clust"]: r["root"] for r in postprocess.merge_groups(table, threshold, 16).collect()}
    assert all(roots[a] == roots[b] for a, b in want.items())
    if kind == "groups" and threshold == 0.9:
        assert len(set(roots.values())) > 5


def test_more_labels_than_one_place_holds(spark, monkeypatch):
    monkeypatch.setattr(postprocess, "MAX_LABELS", 4)
    x = directions("groups", 3)
    labels = np.arange(len(x)) // 3
    df = frame(spark, x, labels)
    pairs = {(r["c1"], r["c2"]): r["aff"] for r in postprocess.centroid_affinity(df).collect()}
    c = np.stack([x[labels == k].mean(axis=0) for k in range(30)])
    unit = c / np.linalg.norm(c, axis=1, keepdims=True)
    assert len(pairs) == 435 and all(abs(v - (unit @ unit.T)[k]) < 1e-9 for k, v in pairs.items())
    top = postprocess.best_merge_pair(df).first()
    assert (top["c1"], top["c2"]) == max(pairs, key=pairs.get)
    want = plain_merge(list(range(30)), [x[labels == k].sum(axis=0) for k in range(30)], [3] * 30, 0.4)
    assert labels_of(postprocess.merge_by_cosine(df, 0.4, 4)) == [want[k] for k in labels]


def test_density():
    rng = np.random.default_rng(2)
    x = np.concatenate([rng.normal(size=(40, 2)) * 0.1, rng.normal(size=(40, 2)) * 0.1 + 5, [[30, -30], [-40, 70]]])
    got = density.hdbscan(x, 5, 5)
    assert same_partition(list(got[:80]), [0] * 40 + [1] * 40) and list(got[80:]) == [-1, -1]
    order = rng.permutation(len(x))
    assert same_partition(list(density.hdbscan(x[order], 5, 5)), list(got[order]))


def test_density_by_blocks(spark):
    """Blocks and one task give the same clusters, copies and noise included."""
    x, _ = planted(3, each=40, spread=0.3)
    rng = np.random.default_rng(2)
    x = np.concatenate([x, rng.normal(size=(20, x.shape[1])) * 6, x[:5]])
    df = frame(spark, x)
    one, many = (labels_of(density.density_clusters(df, min_samples=5, limit=limit, block=32)) for limit in (20_000, 10))
    assert same_partition(one, many) and [c == -1 for c in one] == [c == -1 for c in many] and len(set(one)) >= 4


def test_landmarks(spark):
    """Beyond the bound landmarks are embedded and the others lie among those near them: clusters stay apart and whole."""
    x, y = planted(3, each=40, spread=0.05)
    df = frame(spark, x)
    whole = density.embedded(df, lambda x: x[:, :3], limit=60).orderBy("id").collect()
    assert len(whole) == 120 and max(np.abs(np.array(r["y"]) - x[r["id"], :3]).max() for r in whole) < 0.3
    marks = {r["id"] for r in df.orderBy(F.xxhash64("id"), "id").limit(60).collect()}
    assert all(np.allclose(r["y"], x[r["id"], :3]) for r in whole if r["id"] in marks)
    assert same_partition(labels_of(density.umap_hdbscan(df, min_samples=5, min_cluster_size=8, limit=90)), y)
    for reducer in ("tsne", "umap"):
        places = {r["id"]: np.array([r["x"], r["y"]]) for r in project.project(df, reducer, limit=60).collect()}
        centre = [np.mean([places[i] for i in np.flatnonzero(y == k)], axis=0) for k in range(3)]
        assert np.mean([np.argmin([np.linalg.norm(places[i] - c) for c in centre]) == y[i] for i in range(120)]) > 0.95


def test_umap_hdbscan(spark):
    x, truth = planted(3, each=40, spread=0.1)
    got = labels_of(clustering.cluster(frame(spark, x), "umap_hdbscan"))
    assert same_partition(got, list(truth))


@pytest.mark.parametrize("reducer", project.REDUCERS)
def test_projection_keeps_neighbours(spark, reducer):
    x, truth = planted(3, each=20)
    rows = project.project(frame(spark, x), reducer).orderBy("id").collect()
    y = np.array([[r["x"], r["y"]] for r in rows])
    near, _ = density.nearest(y, 5)
    assert (truth[near] == truth[:, None]).mean() > 0.95
    with pytest.raises(ValueError):
        project.project(frame(spark, x), "none")


@given(st.integers(1, 400_000))
def test_slice_rule(n):
    step = slices.frame_step(1.3)
    assert step == 77
    frames = -(-(n + 1) // 160)
    count = len(range(0, max(1, frames - 160 + step + 1), step))
    assert count >= 1


def test_slices(spark):
    df = spark.createDataFrame([(n, n) for n in (1, 16000, 25600, 32000, 48000, 160000)], "id long, n long")
    got = {r["id"]: r["c"] for r in slices.partial_slices(df, "n").groupBy("id").agg(F.count("*").alias("c")).collect()}
    assert got == {1: 1, 16000: 1, 25600: 1, 32000: 2, 48000: 3, 160000: 12}
    for bad in (dict(min_coverage=0), dict(rate=0.5)):
        with pytest.raises(ValueError):
            slices.partial_slices(df, "n", **bad)


def write_wav(path, samples, rate=16000, channels=1):
    with wave.open(path, "wb") as f:
        f.setnchannels(channels)
        f.setsampwidth(2)
        f.setframerate(rate)
        f.writeframes((np.asarray(samples) * 32767).astype("<i2").tobytes())


@pytest.fixture
def wavs(tmp_path):
    folder = tmp_path / "raw" / "wavs"
    folder.mkdir(parents=True)
    t = np.arange(32000) / 16000
    for i in range(12):
        write_wav(str(folder / f"u{i:02d}.wav"), 0.4 * np.sin(2 * np.pi * (200 if i < 6 else 1900) * t * (1 + i / 400)))
    (folder / "notes.txt").write_text("no recording")
    return str(folder)


def test_decode():
    import io

    buffer = io.BytesIO()
    with wave.open(buffer, "wb") as f:
        f.setnchannels(2)
        f.setsampwidth(2)
        f.setframerate(8000)
        f.writeframes(np.tile(np.array([16384, 0], "<i2"), 80).tobytes())
    x = readers.decode(buffer.getvalue())
    assert len(x) == 160 and np.allclose(x, 0.25, atol=1e-4)


def test_folder_flow(spark, wavs, tmp_path):
    cache = str(tmp_path / "cache")
    points = clustering.embed_folder(spark, wavs, "timbre", "s", cache)
    assert points.count() == 12
    assert points.select(V.norm(F.col("v")).alias("n")).agg(F.min("n"), F.max("n")).first() == pytest.approx((1.0, 1.0))
    write_wav(os.path.join(wavs, "u99.wav"), np.zeros(100) + 0.1)
    again = clustering.embed_folder(spark, wavs, "timbre", "s", cache)
    assert again.count() == 13 and spark.read.parquet(cache).count() == 13
    mix = clustering.embed_folder(spark, wavs, "mix").select(F.size("v").alias("n")).distinct().collect()
    assert [r["n"] for r in mix] == [256 + 1024]
    out = str(tmp_path / "assigned")
    clustering.split(spark, wavs, out, reducer="pca", nmin=2)
    table = readers.assignments(spark, out)
    assert table.columns == ["filename", "clust", "x", "y"] and table.count() == 13
    with pytest.raises(ValueError):
        clustering.embed_folder(spark, wavs, "other")


def test_routing(spark, wavs, tmp_path):
    files = readers.listing(spark, wavs).select(F.col("path").alias("filename"), F.when(F.col("path").contains("u0"), 0).otherwise(1).alias("clust"))
    files = spark.createDataFrame(files.collect(), files.schema)  # moved files leave a live listing
    plan = writers.route_plan(files, str(tmp_path / "out"))
    assert not any(r["done"] for r in writers.execute(plan).collect()) and not (tmp_path / "out").exists()
    writers.execute(plan, dry_run=False).collect()
    assert len(list((tmp_path / "out" / "0").iterdir())) == 10 and len(list((tmp_path / "out" / "1").iterdir())) == 2
    kick = writers.kick_plan(files, 1, str(tmp_path / "in"))
    for _ in range(2):
        assert all(r["done"] for r in writers.execute(kick, move=True, dry_run=False).collect())
    assert len(list((tmp_path / "in_1").iterdir())) == 2
    twice = spark.createDataFrame([("/a/x.wav", 1), ("/b/x.wav", 1)], "filename string, clust int")
    assert all(r["collides"] for r in writers.route_plan(twice, "o").collect())


def test_transcripts(spark, wavs, tmp_path):
    path = str(tmp_path / "t.csv")
    (tmp_path / "t.csv").mkdir()
    (tmp_path / "t.csv" / "part.csv").write_text('stem,text\nu01,"a, ""b"""\nu01,again\ngone,x\nU02,case\n')
    kept = clustering.clean_csv(spark, path, wavs).collect()
    assert sorted((r["stem"], r["text"]) for r in kept) == [("u01", 'a, "b"'), ("u01", "again")]


def test_assignment_csv(spark, tmp_path):
    rows = [('a,"b" c.wav', 1, 0.5, -1.0)]
    writers.assignment_csv(spark.createDataFrame(rows, readers.ASSIGNMENT), str(tmp_path / "a"))
    assert [tuple(r) for r in readers.assignments(spark, str(tmp_path / "a")).collect()] == rows


def test_vocabulary_and_matrix(spark, tmp_path):
    (tmp_path / "v.json").write_text(json.dumps({"AP": 1, "SP": 2, "en/aa": 2, "zh/a": 3, "ja/a": 3}))
    got = series.invert_vocabulary(readers.vocabulary(spark, str(tmp_path / "v.json"))).orderBy("pos").collect()
    assert [r["keys"] for r in got] == ["</PAD>", "AP", "SP,en/aa", "zh/a,ja/a"]
    np.save(tmp_path / "m.npy", np.arange(8.0).reshape(4, 2))
    table = clustering.load_matrix(spark, str(tmp_path / "m.npy"), str(tmp_path / "v.json"), "pca", str(tmp_path / "tokens"))
    assert sorted(r["token"] for r in table.collect()) == ["</PAD>", "AP", "SP,en/aa", "zh/a,ja/a"]
    np.save(tmp_path / "m.npy", np.zeros((3, 2)))
    with pytest.raises(ValueError):
        clustering.load_matrix(spark, str(tmp_path / "m.npy"), str(tmp_path / "v.json"), "pca")


def test_diarization(spark):
    rows = [("a", 0, 0.75), ("b", 0, 0.1), ("a", 1, 0.7500001), ("a", 2, 0.65), ("b", 2, 0.65), ("b", 3, 0.6500001)]
    got = series.diarize(spark.createDataFrame(rows, "name string, frame int, sim double")).orderBy("frame").collect()
    assert [(r["name"], r["status"]) for r in got] == [("a", "uncertain"), ("a", "confident"), ("a", "unknown"), ("b", "uncertain")]


def test_streams(spark, tmp_path):
    from timbrel.streaming.live import live_diarization, speaking_time

    data = str(tmp_path / "frames")
    spark.sql("select timestamp'2024-01-01 00:00:01' ts, 1L frame, map('a', 0.9D, 'b', 0.9D) sims union all select timestamp'2024-01-01 00:00:02', 2L, map('b', 0.7D)").write.parquet(data)
    stream = spark.readStream.schema(spark.read.parquet(data).schema).parquet(data)
    for name, df, mode in (("live", live_diarization(stream.select("frame", "sims")), "append"), ("spoken", speaking_time(stream), "complete")):
        q = df.writeStream.format("memory").queryName(name).outputMode(mode).start()
        q.processAllAvailable()
        q.stop()
    assert sorted((r["frame"], r["name"], r["status"]) for r in spark.table("live").collect()) == [(1, "a", "confident"), (2, "b", "uncertain")]
    assert [r["n"] for r in spark.table("spoken").collect()] == [1]


def test_vectors(spark):
    df = spark.createDataFrame([([3.0, 4.0], [0.0, 0.0])], "a array<double>, b array<double>")
    r = df.select(V.cosine(F.col("a"), F.col("b")).alias("c"), V.normalize(F.col("b")).alias("n"), V.padded(F.col("a"), 4).alias("p")).first()
    assert (r["c"], r["n"], r["p"]) == (0.0, [0.0, 0.0], [3.0, 4.0, 0.0, 0.0])


def naive_lstm(w, x):
    """One slice, gate by gate."""
    sig = lambda v: 1 / (1 + np.exp(-v))
    for k in range(2):
        n = w[f"lstm.weight_hh_l{k}"].shape[1]
        h, c, out = [0.0] * n, [0.0] * n, []
        for step in x:
            gate = [sum(w[f"lstm.weight_ih_l{k}"][g, i] * step[i] for i in range(len(step))) + sum(w[f"lstm.weight_hh_l{k}"][g, i] * h[i] for i in range(n)) + w[f"lstm.bias_ih_l{k}"][g] + w[f"lstm.bias_hh_l{k}"][g] for g in range(4 * n)]
            c = [sig(gate[n + i]) * c[i] + sig(gate[i]) * np.tanh(gate[2 * n + i]) for i in range(n)]
            h = [sig(gate[3 * n + i]) * np.tanh(c[i]) for i in range(n)]
            out.append(h)
        x = out
    y = np.maximum(w["linear.weight"] @ np.array(x[-1]) + w["linear.bias"], 0)
    return y / np.linalg.norm(y)


def lstm_weights(bands, n=5, out=7):
    rng = np.random.default_rng(3)
    w = {"linear.weight": rng.normal(size=(out, n)), "linear.bias": rng.normal(size=out), "unused": np.zeros(2)}
    for k, width in ((0, bands), (1, n)):
        w |= {f"lstm.weight_ih_l{k}": rng.normal(size=(4 * n, width)), f"lstm.weight_hh_l{k}": rng.normal(size=(4 * n, n)), f"lstm.bias_ih_l{k}": rng.normal(size=4 * n), f"lstm.bias_hh_l{k}": rng.normal(size=4 * n)}
    return w


def test_lstm_weights(spark, wavs, tmp_path):
    w = lstm_weights(4)
    x = np.random.default_rng(4).normal(size=(3, 6, 4))
    got = encoders.LstmEncoder(w)(x)
    assert np.allclose(got, [naive_lstm(w, s.tolist()) for s in x], atol=1e-5)
    np.savez(tmp_path / "w.npz", **lstm_weights(slices.BANDS))
    old = slices._encoders["timbre"]
    try:
        encoders.use_timbre_weights(spark, str(tmp_path / "w.npz"))
        rows = slices.embed(readers.waveforms(readers.utterances(spark, wavs))).collect()
        assert len(rows) == 12 and all(len(r["v"]) == 7 and (np.isclose(np.linalg.norm(r["v"]), 1) or not any(r["v"])) for r in rows)
    finally:
        slices.register_encoder("timbre", old)
    with pytest.raises(ValueError):
        encoders.load_weights(spark, str(tmp_path / "w.npz"), most=10)


def checkpoint_bytes(arrays, packed, more=None):
    """A checkpoint as the public library writes it, made with stand-ins for its classes."""
    import io
    import pickle
    import sys
    import types
    import zipfile
    from collections import OrderedDict

    torch, utils = types.ModuleType("torch"), types.ModuleType("torch._utils")
    kinds = {"<f4": "FloatStorage", "<f8": "DoubleStorage", "<i8": "LongStorage"}
    for name in kinds.values():
        setattr(torch, name, type(name, (), {"__module__": "torch"}))

    def _rebuild_tensor_v2(*_):
        pass

    _rebuild_tensor_v2.__module__, _rebuild_tensor_v2.__qualname__ = "torch._utils", "_rebuild_tensor_v2"
    utils._rebuild_tensor_v2 = _rebuild_tensor_v2
    stored = {}

    class Storage:
        def __init__(self, key, x):
            self.key, self.x = key, x

    class Tensor:
        def __init__(self, x, key):
            self.x, self.storage = x, Storage(key, x)
            stored[key] = x

        def __reduce__(self):
            flat = self.x.base if self.x.base is not None and self.x.base.ndim == 1 else self.x.ravel()
            stored[self.storage.key] = flat
            self.storage.x = flat
            return utils._rebuild_tensor_v2, (self.storage, 0, self.x.shape, tuple(s // self.x.itemsize for s in self.x.strides), False, OrderedDict())

    class Writer(pickle.Pickler):
        def persistent_id(self, x):
            if isinstance(x, Storage):
                name = kinds[x.x.dtype.str]
                return ("storage", getattr(torch, name), x.key, "cpu", x.x.size) + (() if packed else (None,))

    sys.modules |= {"torch": torch, "torch._utils": utils}
    try:
        state = {"model_state": OrderedDict((k, Tensor(v, str(i))) for i, (k, v) in enumerate(arrays.items())), "step": 7, **(more or {})}
        body = io.BytesIO()
        Writer(body, protocol=2).dump(state)
    finally:
        del sys.modules["torch"], sys.modules["torch._utils"]
    if packed:
        out = io.BytesIO()
        with zipfile.ZipFile(out, "w") as z:
            z.writestr("archive/data.pkl", body.getvalue())
            for key, x in stored.items():
                z.writestr(f"archive/data/{key}", x.tobytes())
        return out.getvalue()
    head = b"".join(pickle.dumps(x, 2) for x in (encoders.MAGIC, encoders.VERSION, {"little_endian": True}))
    tail = b"".join(x.size.to_bytes(8, "little") + x.tobytes() for x in stored.values())
    return head + body.getvalue() + pickle.dumps(list(stored), 2) + tail


@pytest.mark.parametrize("packed", [True, False])
def test_checkpoints(spark, tmp_path, packed):
    flat = np.arange(12, dtype="<f4")
    arrays = {"a": flat.reshape(3, 4), "turned": np.arange(6, dtype="<f8").reshape(2, 3).T, "n": np.array([3], "<i8"), "similarity": np.array(2.5, "<f4")}
    (tmp_path / "w.pt").write_bytes(checkpoint_bytes(arrays, packed))
    got = encoders.load_weights(spark, str(tmp_path / "w.pt"))
    assert set(got) == set(arrays) and all((got[k] == v).all() and got[k].dtype == v.dtype for k, v in arrays.items())
    w = lstm_weights(4)
    (tmp_path / "l.pt").write_bytes(checkpoint_bytes(w, packed))
    x = np.random.default_rng(4).normal(size=(2, 5, 4))
    assert np.allclose(encoders.LstmEncoder(encoders.load_weights(spark, str(tmp_path / "l.pt")))(x), encoders.LstmEncoder(w)(x))
    for bad in (os.system, tmp_path):
        with pytest.raises(ValueError):
            encoders.checkpoint(checkpoint_bytes(arrays, packed, {"more": bad}))


def emotion_weights(channels=6, size=8, depth=2):
    rng = np.random.default_rng(6)
    fill = lambda *shape: rng.normal(size=shape) * 0.5
    w = {}
    for i, width in enumerate((10, 3, 2)):
        w |= {f"wav2vec2.feature_extractor.conv_layers.{i}.conv.weight": fill(channels, 1 if i == 0 else channels, width), f"wav2vec2.feature_extractor.conv_layers.{i}.conv.bias": fill(channels), f"wav2vec2.feature_extractor.conv_layers.{i}.layer_norm.weight": fill(channels), f"wav2vec2.feature_extractor.conv_layers.{i}.layer_norm.bias": fill(channels)}
    w |= {"wav2vec2.feature_projection.layer_norm.weight": fill(channels), "wav2vec2.feature_projection.layer_norm.bias": fill(channels), "wav2vec2.feature_projection.projection.weight": fill(size, channels), "wav2vec2.feature_projection.projection.bias": fill(size)}
    w |= {"wav2vec2.encoder.pos_conv_embed.conv.weight_g": fill(1, 1, 4), "wav2vec2.encoder.pos_conv_embed.conv.weight_v": fill(size, size // 2, 4), "wav2vec2.encoder.pos_conv_embed.conv.bias": fill(size), "wav2vec2.encoder.layer_norm.weight": fill(size), "wav2vec2.encoder.layer_norm.bias": fill(size)}
    for i in range(depth):
        for name, shape in (("layer_norm", (size,)), ("final_layer_norm", (size,)), *((f"attention.{k}_proj", (size, size)) for k in ("q", "k", "v", "out")), ("feed_forward.intermediate_dense", (12, size)), ("feed_forward.output_dense", (size, 12))):
            w |= {f"wav2vec2.encoder.layers.{i}.{name}.weight": fill(*shape), f"wav2vec2.encoder.layers.{i}.{name}.bias": fill(shape[0])}
    return w | {"classifier.dense.weight": fill(size, size), "classifier.dense.bias": fill(size), "classifier.out_proj.weight": fill(3, size), "classifier.out_proj.bias": fill(3)}


def naive_emotion(w, samples, strides, heads, groups):
    """The published layers, place by place."""
    import math

    w = {k.removeprefix("wav2vec2."): v for k, v in w.items()}
    act = lambda v: v * 0.5 * (1 + math.erf(v / math.sqrt(2)))
    lin = lambda n, v: [sum(a * b for a, b in zip(row, v, strict=True)) + c for row, c in zip(w[n + ".weight"], w[n + ".bias"], strict=True)]

    def norm(n, v):
        m = sum(v) / len(v)
        s = math.sqrt(sum((a - m) ** 2 for a in v) / len(v) + 1e-5)
        return [(a - m) / s * g + b for a, g, b in zip(v, w[n + ".weight"], w[n + ".bias"], strict=True)]

    def conv(x, kernel, bias, stride, groups=1):
        out, inner, width = kernel.shape
        per = out // groups
        return [[sum(kernel[o, i, k] * x[t * stride + k][o // per * inner + i] for i in range(inner) for k in range(width)) + bias[o] for o in range(out)] for t in range((len(x) - width) // stride + 1)]

    mean = sum(samples) / len(samples)
    dev = math.sqrt(sum((s - mean) ** 2 for s in samples) / len(samples) + 1e-7)
    x = [[(s - mean) / dev] for s in samples]
    for i, stride in enumerate(strides):
        n = f"feature_extractor.conv_layers.{i}"
        x = [[act(v) for v in norm(n + ".layer_norm", row)] for row in conv(x, w[n + ".conv.weight"], w[n + ".conv.bias"], stride)]
    x = [lin("feature_projection.projection", norm("feature_projection.layer_norm", row)) for row in x]
    n = "encoder.pos_conv_embed.conv."
    v = w[n + "weight_v"]
    kernel = np.stack([w[n + "weight_g"][0, 0, k] * v[:, :, k] / math.sqrt((v[:, :, k] ** 2).sum()) for k in range(v.shape[2])], axis=2)
    pad = [[0.0] * len(x[0])] * (v.shape[2] // 2)
    place = conv([*pad, *x, *pad], kernel, w[n + "bias"], 1, groups)
    x = [[a + act(b) for a, b in zip(r, p, strict=True)] for r, p in zip(x, place, strict=False)]
    depth = sum(".final_layer_norm.weight" in k for k in w)
    for i in range(depth):
        n = f"encoder.layers.{i}"
        seen = [norm(n + ".layer_norm", r) for r in x]
        q, k, v = ([lin(f"{n}.attention.{c}_proj", r) for r in seen] for c in "qkv")
        width = len(q[0]) // heads
        mixed = [[] for _ in x]
        for h in range(heads):
            cut = slice(h * width, (h + 1) * width)
            for t in range(len(x)):
                score = [math.exp(sum(a * b for a, b in zip(q[t][cut], k[u][cut], strict=True)) / math.sqrt(width)) for u in range(len(x))]
                mixed[t] += [sum(s * v[u][cut][d] for u, s in enumerate(score)) / sum(score) for d in range(width)]
        x = [[a + b for a, b in zip(r, lin(f"{n}.attention.out_proj", m), strict=True)] for r, m in zip(x, mixed, strict=True)]
        x = [[a + b for a, b in zip(r, lin(f"{n}.feed_forward.output_dense", [act(z) for z in lin(f"{n}.feed_forward.intermediate_dense", norm(n + ".final_layer_norm", r))]), strict=True)] for r in x]
    pooled = np.mean([norm("encoder.layer_norm", r) for r in x], axis=0)
    return pooled, lin("classifier.out_proj", [math.tanh(z) for z in lin("classifier.dense", pooled)])


def test_short_recordings_are_encoded():
    w, options = emotion_weights(), {"strides": (5, 2, 2), "heads": 2, "groups": 2}
    model = encoders.EmotionEncoder(w, **options)
    for n in (0, 1, model.least - 1, model.least):
        h = model.hidden(np.sin(np.arange(n)))
        assert len(h) == 1 and np.isfinite(h).all()
    assert len(model.hidden(np.sin(np.arange(model.least + 20)))) == 2


def test_emotion_weights(spark, wavs, tmp_path):
    w, options = emotion_weights(), {"strides": (5, 2, 2), "heads": 2, "groups": 2}
    x = np.random.default_rng(8).normal(size=150) + 0.3
    model = encoders.EmotionEncoder(w, **options)
    pooled, logits = naive_emotion(w, x.tolist(), (5, 2, 2), 2, 2)
    assert np.allclose(model(x), pooled, atol=1e-4) and np.allclose(model.logits(x), logits, atol=1e-4)
    np.savez(tmp_path / "e.npz", **w)
    waves = readers.waveforms(readers.utterances(spark, wavs)).where("id < 3")
    try:
        encoders.use_emotion_weights(spark, str(tmp_path / "e.npz"), **options)
        assert {len(r["v"]) for r in slices.embed(waves, "emotion").collect()} == {8}
        rated = encoders.emotion_logits(waves).collect()
        assert rated and all(np.isfinite([r[k] for k in encoders.LOGITS]).all() for r in rated)
    finally:
        slices._whole.clear()
    with pytest.raises(ValueError):
        encoders.emotion_logits(waves)


def test_plot_and_playback(spark, wavs, tmp_path):
    import struct
    import zlib

    points = spark.createDataFrame([("a", 0, 0.0, 0.0), ("b", 1, 1.0, 1.0), ("c", 1, 1.0, 1.0), ("d", 0, 1.0, 1.0), ("e", 2, None, 1.0)], readers.ASSIGNMENT)
    grid = project.scatter_grid(points, 20, 10)
    assert sorted((r["px"], r["py"], r["clust"]) for r in grid.collect()) == [(0, 9, 0), (19, 0, 1)]
    writers.scatter_png(grid, str(tmp_path / "p.png"), series.PALETTE, 20, 10, mark=1)
    raw = (tmp_path / "p.png").read_bytes()
    body, at, seen = b"", 8, []
    while at < len(raw):
        n, kind = struct.unpack(">I4s", raw[at : at + 8])
        assert zlib.crc32(raw[at + 4 : at + 8 + n]) == struct.unpack(">I", raw[at + 8 + n : at + 12 + n])[0]
        seen.append(kind)
        body += raw[at + 8 : at + 8 + n] if kind == b"IDAT" else b""
        at += 12 + n
    image = np.frombuffer(zlib.decompress(body), np.uint8).reshape(10, 61)[:, 1:].reshape(10, 20, 3)
    assert seen == [b"IHDR", b"IDAT", b"IEND"] and tuple(image[8, 1]) == series.PALETTE[0] and tuple(image[1, 18]) == series.PALETTE[1]
    assert (image == 255).all(axis=2).sum() == 200 - 8
    one = project.scatter_grid(points.limit(1)).collect()
    assert [(r["px"], r["py"]) for r in one] == [(0, 899)]
    waves = readers.waveforms(readers.utterances(spark, wavs)).where("id = 0")
    x = readers.decode(writers.wav_files(waves).first()["content"])
    assert len(x) == 40000 and not x[32000:].any() and np.allclose(x[:32000], waves.first()["samples"], atol=1e-4)


def test_crop_and_pace(spark):
    assert series.crop_frames(5, 1.3) == 3 and series.crop_frames(1, 1.3) == 0
    rows = spark.createDataFrame([(1, 2.0, 1.0), (2, 2.0, 2.2), (3, 2.0, 2.25)], "frame int, due double, elapsed double")
    got = rows.withColumn("p", series.delay(F.col("elapsed"), F.col("due"))).orderBy("frame").collect()
    assert [(r["p"]["wait"], r["p"]["late"]) for r in got] == [(1.0, False), (0.0, False), (0.0, True)]
    assert [r["a"] for r in spark.createDataFrame([("a.csv",), ("a.CSV",), ("csv",)], "n string").select(series.accepted(F.col("n")).alias("a")).collect()] == [True, False, False]


def test_pruning_streams_blocks(spark):
    rng = np.random.default_rng(1)
    x = rng.normal(size=(90, 5))
    x[10:20] = x[:10]
    df = frame(spark, x)
    unit = x / np.linalg.norm(x, axis=1, keepdims=True)
    c = np.round(unit @ unit.T, 12)
    want = sorted((i, j) for i in range(90) for j in sorted(range(90), key=lambda j: (-c[i, j], j))[:7])
    assert sorted((r["i"], r["j"]) for r in similarity.knn_prune(df, keep=7, block=16).collect()) == want


def test_bad_options(spark):
    with pytest.raises(ValueError):
        clustering.cluster(frame(spark, np.eye(12)), "other")
    uneven = spark.createDataFrame([(0, [1.0]), (1, [1.0, 2.0])], "id long, v array<double>")
    with pytest.raises(ValueError):
        clustering.cluster(uneven)


def test_asking_for_another_nmin(spark, wavs, tmp_path):
    from timbrel.cli import answered, parser

    said = iter(["n", "0", "some", "15", " 3 ", "Y"])
    assert answered(lambda _: next(said)) == 3 and answered(lambda _: next(said)) is None
    assert parser().parse_args(["split", "--spk", "a", "--ask"]).ask
    table = clustering.sweep(spark, wavs, cache=str(tmp_path / "c")).orderBy("nmin").collect()
    assert [r["nmin"] for r in table] == list(range(1, 12)) and all(r["nmin"] <= r["k"] <= 11 for r in table)


def test_plane_of_the_largest_variance(spark):
    """The first two principal axes as numpy finds them, each with its largest loading positive."""
    x = np.random.default_rng(4).normal(size=(60, 5)) @ np.diag([5.0, 1.0, 3.0, 0.5, 0.1])
    axes = np.linalg.eigh(np.cov(x.T))[1][:, ::-1][:, :2]
    axes = axes * np.sign(axes[np.abs(axes).argmax(axis=0), [0, 1]])
    rows = project.project(frame(spark, x), "pca").orderBy("id").collect()
    assert np.allclose([[r["x"], r["y"]] for r in rows], x @ axes, atol=1e-6)


def test_command_line():
    from timbrel.cli import parser

    assert parser().parse_args(["split", "--spk", "a", "--nmin", "3"]).nmin == 3
    assert not parser().parse_args(["kick", "--csv", "x", "--out", "y", "--clust", "2"]).do


def test_graph_without_a_shuffle_of_neighbours(spark):
    rng = np.random.default_rng(2)
    x = rng.normal(size=(150, 5))
    x[10:60], x[7] = x[3], 0  # more copies than a row keeps
    df = frame(spark, x)
    unit = np.divide(x, np.linalg.norm(x, axis=1, keepdims=True), out=np.zeros_like(x), where=x.any(axis=1, keepdims=True))
    c = np.round(unit @ unit.T, 12)
    kept = {(i, j) for i in range(150) for j in sorted(range(150), key=lambda j: (-c[i, j], j))[: similarity.keep_count(150)]}
    want = {p: c[p] * ((p in kept) + (p[::-1] in kept)) / 2 for i, j in kept if i != j for p in ((i, j), (j, i))}
    edges = similarity.affinity(df, block=16)
    got = {(r["i"], r["j"]): r["w"] for r in edges.collect()}
    assert got.keys() == want.keys() and all(abs(got[p] - want[p]) < 1e-9 for p in want)
    degrees = {r["i"]: r["d"] for r in similarity.affinity_degree(df, block=16).collect()}
    assert all(abs(degrees[i] - sum(abs(w) for (a, _), w in want.items() if a == i)) < 1e-9 for i in range(150) if any(a == i for a, _ in want))
    lap = {(r["i"], r["j"]): r["l"] for r in similarity.affinity_laplacian(df, block=16).collect()}
    assert all(abs(lap[p] + want[p]) < 1e-9 for p in want) and all(abs(lap[i, i] - d) < 1e-9 for i, d in degrees.items()) and len(lap) == len(want) + len(degrees)
    assert "Exchange" not in edges._jdf.queryExecution().toString()


def test_pruning_where_the_first_block_misleads(spark):
    """Near vectors fill the first block only: what it says cannot be kept must be kept after all."""
    x = np.random.default_rng(4).normal(size=(60, 6))
    table = lambda a, b: similarity._Block(pa.table({"id": np.arange(a, b), "v": pa.array(x[a:b].tolist())}))
    x[:30] = x[0] + 0.001 * x[:30]
    x[30:] = -x[0] + 0.5 * x[30:]
    blocks = [table(0, 30), table(30, 60)]
    best = similarity._Best(blocks[0], 10, 600)  # a guess for many more columns than there are
    best.all = 60
    best.guess, best.least = True, np.full(30, 0.9999999)
    for other in blocks:
        best.found or best.found.append((np.zeros(0, np.int32), np.zeros(0, np.int64), np.zeros(0)))
        best.see(other)
    rows = pa.Table.from_batches(best.end(lambda: iter(blocks)))
    assert rows.num_rows == 300 and not best.guess


def test_spectrum_from_blocks_agrees(spark):
    x, _ = planted(3, each=40, spread=0.6)
    df = frame(spark, x)
    dense = spectral.dense_spectrum(similarity.affinity(df), df.select("id"), 5).first()["values"]
    solved = spectral.graph_spectrum(similarity.graph(df, block=32), 5).cache()
    assert np.allclose(dense, solved.first()["values"], atol=1e-6) and solved.count() == 120
    # one row a block leaves the product, however many edges there are
    tiles = similarity.tiles(similarity.graph(df, block=32))
    assert tiles.count() <= 4 * 4 + 4 and "Exchange" not in tiles._jdf.queryExecution().toString()


def test_spectrum_of_noise_needs_few_rounds(spark):
    """The first eigenvectors of near noise lie close together: coordinates and degrees find them in a few products."""
    x = np.random.default_rng(5).normal(size=(2000, 64))
    graph = similarity.graph(frame(spark, x), block=512)
    found = spectral.graph_spectrum(graph, 15, rounds=28).first()["values"]
    u = x / np.linalg.norm(x, axis=1, keepdims=True)
    c = u @ u.T
    c = np.where(c >= -np.partition(-c, similarity.keep_count(2000) - 1, axis=1)[:, [similarity.keep_count(2000) - 1]], c, 0)
    c = (c + c.T) / 2
    np.fill_diagonal(c, 0)
    assert np.allclose(found, np.linalg.eigvalsh(np.diag(np.abs(c).sum(axis=1)) - c)[:15], atol=1e-6)


def test_embedding_takes_all_points_at_every_size(spark, monkeypatch):
    """No landmarks stand for the others: all points are embedded by blocks, whatever their number."""
    x, truth = planted(3, each=40, spread=0.3)
    monkeypatch.setattr(density, "embedded", None)
    monkeypatch.setattr(density, "PLACES", 32)
    got = labels_of(density.umap_hdbscan(frame(spark, x), min_samples=5, min_cluster_size=8, limit=20_000))
    assert same_partition(got, list(truth))
