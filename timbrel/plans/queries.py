"""Registered queries over the driver's tables, each beside its SQL where SQL can express it."""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from timbrel.functions import vectors as V
from timbrel.operators import chunks, density, intervals, neighbours, postprocess, project, series, similarity, simjoin, slices, spectral
from timbrel.plans import clustering
from timbrel.sources import arrays, readers, writers
from timbrel.sources.cache import FeatureCache
from timbrel.sources.tables import scratch
from timbrel.streaming import trailing

#: Spectral options on the driver's vectors: with nmin 1 a connected graph is nearly always one cluster.
NMIN = 2
MERGE_AT = 0.30
ABSORB_UNDER = 48
SIMILAR = 0.5


def _table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def _points(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _table(spark, sf_dir, "embeddings").select(F.col("vec_id").alias("id"), V.doubles("embedding").alias("v"), F.col("label").alias("clust"))


def _assigned(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Driver vectors as an assignment table: their labels, and the first two coordinates as places."""
    p = _points(spark, sf_dir)
    name = F.concat(F.lit("/data/raw/wavs/"), F.col("id").cast("string"), F.lit(".wav"))
    return p.select(name.alias("filename"), "clust", F.col("v")[0].alias("x"), F.col("v")[1].alias("y"))


def cosine_pairs(spark, sf_dir):
    return similarity.cosine_pairs(_points(spark, sf_dir)).select("i", "j", V.tidy_small(F.col("c")).alias("c"))


def knn_prune(spark, sf_dir):
    return similarity.knn_prune(_points(spark, sf_dir)).select("i", "j", V.tidy_small(F.col("c")).alias("c"))


def sym_affinity(spark, sf_dir):
    return similarity.affinity(_points(spark, sf_dir)).select("i", "j", V.tidy_small(F.col("w")).alias("w"))


def degree(spark, sf_dir):
    return similarity.affinity_degree(_points(spark, sf_dir)).select("i", V.tidy(F.col("d")).alias("d"))


def laplacian_triples(spark, sf_dir):
    return similarity.affinity_laplacian(_points(spark, sf_dir)).select("i", "j", V.tidy_small(F.col("l")).alias("l"))


def heat_map(spark, sf_dir):
    return series.heat_map(similarity.cosine_pairs(_points(spark, sf_dir))).select("i", "j", V.tidy_small(F.col("shade")).alias("shade"))


def l2_normalize(spark, sf_dir):
    unit = _points(spark, sf_dir).select("id", F.posexplode(V.normalize(F.col("v"))).alias("pos", "x"))
    return unit.select(F.col("id").alias("vec_id"), "pos", V.tidy(F.col("x")).alias("x"))


def speaker_embedding(spark, sf_dir):
    means = postprocess.mean_vectors(_points(spark, sf_dir), "clust")
    return means.select(F.col("clust").alias("label"), F.posexplode("v").alias("pos", "x")).select("label", "pos", V.tidy(F.col("x")).alias("x"))


def cluster_sizes(spark, sf_dir):
    return postprocess.cluster_sizes(_points(spark, sf_dir))


def minor_major(spark, sf_dir):
    return postprocess.minor_major(_points(spark, sf_dir), ABSORB_UNDER)


def centroids(spark, sf_dir):
    flat = postprocess.centroids(_points(spark, sf_dir)).select("clust", F.posexplode("cv").alias("pos", "m"))
    return flat.select("clust", "pos", V.tidy(F.col("m")).alias("m"))


def absorb_minor(spark, sf_dir):
    return postprocess.absorb_minor(_points(spark, sf_dir), ABSORB_UNDER).select(F.col("id").alias("vec_id"), "clust")


def centroid_affinity(spark, sf_dir):
    return postprocess.centroid_affinity(_points(spark, sf_dir)).select("c1", "c2", V.tidy(F.col("aff")).alias("aff"))


def best_merge_pair(spark, sf_dir):
    return postprocess.best_merge_pair(_points(spark, sf_dir)).select("c1", "c2", V.tidy(F.col("aff")).alias("aff"))


def merge_by_cosine(spark, sf_dir):
    return postprocess.merge_by_cosine(_points(spark, sf_dir), MERGE_AT).select(F.col("id").alias("vec_id"), "clust")


def small_n_fallback(spark, sf_dir):
    """The feature is what happens below ten points: the nine of the smallest ids."""
    nine = _points(spark, sf_dir).where("id < 9")
    return postprocess.small_n_fallback(nine).select(F.col("id").alias("vec_id"), "clust")


def eigen_gaps(spark, sf_dir):
    """Gaps of an ordered series of numbers: here the mean squares of the vectors' coordinates."""
    flat = _points(spark, sf_dir).select(F.posexplode("v").alias("pos", "x"))
    values = flat.groupBy("pos").agg(F.avg(F.col("x") * F.col("x")).alias("lambda"))
    return spectral.eigen_gaps(values, "pos", "lambda").select("ord", V.tidy(F.col("gap"), 9).alias("gap"))


def partial_slices(spark, sf_dir):
    docs = _table(spark, sf_dir, "documents")
    return slices.partial_slices(docs, F.col("n_chars") * 16, "doc_id").withColumnRenamed("id", "doc_id")


def slice_mid_times(spark, sf_dir):
    return partial_slices(spark, sf_dir).select("doc_id", "part", V.tidy(series.mid_time(F.col("wav_start"), F.col("wav_stop"))).alias("seconds"))


def mix_concat(spark, sf_dir):
    p = _points(spark, sf_dir)
    both = p.select("id", F.col("v").alias("a")).join(p.select("id", F.reverse("v").alias("b")), "id")
    flat = both.select("id", F.posexplode(V.concatenated(F.col("a"), F.col("b"))).alias("pos", "x"))
    return flat.select(F.col("id").alias("vec_id"), "pos", V.tidy(F.col("x")).alias("x"))


def transcript_semi_join(spark, sf_dir):
    rows = _table(spark, sf_dir, "documents").select(F.col("doc_id").cast("string").alias("name"), "lang", "source")
    files = _table(spark, sf_dir, "labels").select(F.concat(F.lit("/wavs/"), F.col("doc_id").cast("string"), F.lit(".wav")).alias("path"))
    return clustering.clean_transcripts(rows, files)


def cache_misses(spark, sf_dir):
    return clustering.cache_misses(_table(spark, sf_dir, "documents").select("doc_id"), _table(spark, sf_dir, "labels"), ["doc_id"])


def route_plan(spark, sf_dir):
    return writers.route_plan(_assigned(spark, sf_dir), "output/spk")


def kick_filter(spark, sf_dir):
    return writers.kick_plan(_assigned(spark, sf_dir), 3, "input/spk")


def url_basename(spark, sf_dir):
    return _table(spark, sf_dir, "pages").select("page_id", readers.basename("url").alias("base"))


def vocab_invert(spark, sf_dir):
    parts = _table(spark, sf_dir, "part").select((F.col("p_partkey") - 1).cast("int").alias("pos"), F.concat(F.col("p_type"), F.lit("#"), F.col("p_partkey").cast("string")).alias("key"), F.col("p_brand").alias("value"))
    return series.invert_vocabulary(parts)


def diarize_frames(spark, sf_dir):
    p = _points(spark, sf_dir)
    scored = postprocess.scored_against(p.select("id", "v"), postprocess.centroids(p).select(F.col("clust").alias("major"), "cv"))
    sims = scored.select(F.concat(F.lit("s"), F.col("major").cast("string")).alias("name"), F.col("id").alias("frame"), F.round("c", 9).alias("sim"))
    return series.diarize(sims).select("frame", "name", V.tidy(F.col("sim")).alias("sim"), "status")


def trailing_frame(spark, sf_dir):
    out = series.trailing(_table(spark, sf_dir, "events"), "user_id", ["ts", "event_id"], "value", 5)
    return out.select("event_id", V.tidy(F.col("trailing")).alias("trailing"))


def density_histogram(spark, sf_dir):
    return series.histogram(_table(spark, sf_dir, "events"), "event_type", "value").select("event_type", "bin", V.tidy(F.col("lo")).alias("lo"), V.tidy(F.col("density"), 9).alias("density"))


def group_median(spark, sf_dir):
    return series.medians(_table(spark, sf_dir, "events"), "event_type", "value").select("event_type", V.tidy(F.col("median")).alias("median"))


def viewer_palette(spark, sf_dir):
    return series.hues(_points(spark, sf_dir)).select("clust", V.tidy(F.col("hue")).alias("hue"))


def viewer_rows(spark, sf_dir):
    return series.shown(_assigned(spark, sf_dir), clust=4).select("filename", "clust", V.tidy(F.col("x")).alias("x"), V.tidy(F.col("y")).alias("y"))


def viewer_audio(spark, sf_dir):
    return series.with_audio(_assigned(spark, sf_dir)).select("filename", "url")


def viewer_selected(spark, sf_dir):
    return series.shown(_assigned(spark, sf_dir), selected="/data/raw/wavs/7.wav").select("filename", "clust")


def viewer_accepts(spark, sf_dir):
    return _table(spark, sf_dir, "part").select("p_partkey", series.accepted(F.concat("p_type", F.when(F.col("p_size") % 2 == 0, ".csv").otherwise(".CSV"))).alias("accepted"))


def palette_colors(spark, sf_dir):
    rgb = _points(spark, sf_dir).select("clust").distinct().select("clust", series.palette(F.col("clust") * 3).alias("c"))
    return rgb.select("clust", *[V.tidy(F.col("c")[i]).alias(n) for i, n in enumerate(("r", "g", "b"))])


def line_colors(spark, sf_dir):
    rgb = series.line_colors(_table(spark, sf_dir, "part"), "p_type")
    return rgb.select("name", "number", *[V.tidy(F.col("color")[i]).alias(n) for i, n in enumerate(("r", "g", "b"))])


def cropped_frames(spark, sf_dir):
    half = series.crop_frames(5, 1.3)
    return series.cropped(_table(spark, sf_dir, "events"), "user_id", ["ts", "event_id"], half).select("event_id", "frame", "axis_from", "axis_to", "data_from")


def frame_delays(spark, sf_dir):
    """Frames due at their mid-times, shown when the events' values say."""
    pace = series.delay(F.abs("value") / 10, F.lit(2.0))
    return _table(spark, sf_dir, "events").select("event_id", pace.alias("p")).select("event_id", V.tidy(F.col("p.wait")).alias("wait"), "p.late")


def frame_rates(spark, sf_dir):
    mid = slice_mid_times(spark, sf_dir)
    first, second = (mid.where(F.col("part") == k).select("doc_id", F.col("seconds").alias(f"t{k}")) for k in (0, 1))
    return first.join(second, "doc_id").select("doc_id", V.tidy(series.frame_rate(F.col("t0"), F.col("t1"))).alias("rate"))


def nmin_of_spectrum(spark, sf_dir):
    """The sweep over a given spectrum: the coordinates' mean squares in order of size."""
    flat = _points(spark, sf_dir).select(F.posexplode("v").alias("pos", "x"))
    values = flat.groupBy("pos").agg(F.round(F.avg(F.col("x") * F.col("x")), 9).alias("lambda"))
    ranked = values.select((F.row_number().over(W.orderBy("lambda", "pos")) - 1).alias("ord"), "lambda")
    return spectral.sweep(ranked)


def assignment_frame(spark, sf_dir):
    """Labels, places and names met by id."""
    p = _points(spark, sf_dir)
    places = p.select("id", F.col("v")[0].alias("x"), F.col("v")[1].alias("y"))
    named = p.select("id", F.concat(F.lit("u"), F.col("id").cast("string"), F.lit(".wav")).alias("filename"))
    out = clustering.assign(p, p.select("id", "clust"), places, named)
    return out.select("filename", "clust", V.tidy(F.col("x")).alias("x"), V.tidy(F.col("y")).alias("y"))


def matrix_tokens(spark, sf_dir):
    """Rows of a matrix named by a vocabulary's values in first-seen order."""
    parts = _table(spark, sf_dir, "part").select((F.col("p_partkey") - 1).cast("int").alias("pos"), "p_brand", F.col("p_brand").alias("key"), F.col("p_brand").alias("value"))
    names = series.invert_vocabulary(parts).select("pos", F.element_at(F.split("keys", ","), 1).alias("keys"))
    return series.tokens(names.select(F.col("pos").alias("id")), names)


def scatter_grid(spark, sf_dir):
    """Pixels of a plot of the vectors' first two coordinates, coarse enough that points share them."""
    return project.scatter_grid(_assigned(spark, sf_dir), 24, 18)


def path_numbers(spark, sf_dir):
    """Ids by path order, as a folder's recordings get them."""
    return readers.numbered(_table(spark, sf_dir, "pages").select("url").distinct(), "url")


def similar_pairs(spark, sf_dir):
    """Pairs of a least cosine, by cells instead of all pairs."""
    return simjoin.similar_pairs(_points(spark, sf_dir), SIMILAR).select("i", "j", V.tidy_small(F.col("c")).alias("c"))


def neighbour_graph(spark, sf_dir):
    return neighbours.neighbour_graph(_points(spark, sf_dir)).select("i", "j", V.tidy_small(F.col("c")).alias("c"))


def matrix_shares(spark, sf_dir):
    """Vectors written as .npy matrices in order of id, and their rows read again by shares of the files."""
    folder = f"{scratch(spark)}/matrix-{uuid.uuid4().hex}"
    arrays.write_matrices(_points(spark, sf_dir).select("id", "v").repartitionByRange("id").sortWithinPartitions("id"), folder, partition_bytes=1 << 16)
    flat = readers.npy_matrix(spark, folder).select("id", F.posexplode("v").alias("pos", "x"))
    return flat.select("id", "pos", V.tidy(F.col("x")).alias("x"))


def recording_power(spark, sf_dir):
    """Mean square of recordings read in chunks: each thousand event numbers' values as a wave file of eight samples a second."""
    folder = f"{scratch(spark)}/waves-{uuid.uuid4().hex}"
    events = _table(spark, sf_dir, "events").select(F.concat(F.floor(F.col("event_id") / 1000).cast("string"), F.lit(".wav")).alias("filename"), "event_id", (F.col("value") / 1000).alias("x"))
    waves = events.groupBy("filename").agg(F.transform(F.array_sort(F.collect_list(F.struct("event_id", "x"))), lambda s: s["x"]).alias("samples"))
    writers.write_files(writers.wav_files(waves, rate=8, pad=0.0), folder).write.format("noop").mode("overwrite").save()
    power = chunks.loudness(arrays.wave_chunks(spark, folder, seconds=10, halo=3, rate=0))
    return power.select(readers.basename("path").alias("recording"), "n_samples", V.tidy(F.col("power"), 9).alias("power"))


def feature_cache(spark, sf_dir):
    """Vectors kept in two versions of a cache, one over the other, and those it still misses."""
    store = FeatureCache(spark, f"{scratch(spark)}/cache-{uuid.uuid4().hex}", 8)
    p = _points(spark, sf_dir).select(F.concat(F.col("id").cast("string"), F.lit(".wav")).alias("filename"), "id", F.col("clust").cast("long").alias("length"), F.lit("2024-01-01").cast("timestamp").alias("modified"), "v", "clust")
    store.write(p.where("clust < 6"), "spk", "timbre", "1")
    store.write(p.where("clust between 4 and 7").withColumn("v", F.transform("v", lambda x: x * 2)), "spk", "timbre", "2")
    held = store.read("spk", "timbre").join(p.select("filename", "id"), "filename").select("id", V.tidy(F.col("v")[0]).alias("x"))
    return held.unionByName(store.misses(p, "spk", "timbre").select("id", F.lit(None).cast("double").alias("x"))).select(F.col("id").alias("vec_id"), "x")


def slice_frames(spark, sf_dir):
    """Frames within slices: each user's events in the twelve hours from each of its errors on."""
    events = _table(spark, sf_dir, "events")
    spans = events.where("event_type = 'error'").select("user_id", F.col("event_id").alias("slice"), F.col("ts").alias("from"), (F.col("ts") + F.expr("interval 12 hours")).alias("to"))
    return intervals.within(events.select("user_id", "event_id", "ts"), spans, "ts", "from", "to", ["user_id"]).select("slice", "event_id")


def trailing_stream(spark, sf_dir):
    """Trailing frames as a stream tells them: events come in three waves, up to a day out of order, then one frame that ends it."""
    events = _table(spark, sf_dir, "events").select(F.col("user_id").cast("string").alias("user"), "ts", "event_id", "value")
    low, high = events.agg(F.min("ts"), F.max("ts")).first()
    began, whole = (F.unix_micros(F.lit(x).cast("timestamp")) for x in (low, high))
    shift = F.pmod(F.xxhash64("event_id"), F.lit(86_400_000_000))
    wave = F.least(F.lit(2), F.floor((F.unix_micros(F.col("ts").cast("timestamp")) + shift - began) * 3 / (whole - began + 1)))
    last = events.agg((F.max("ts") + F.expr("interval 30 days")).alias("ts")).select(F.lit("~").alias("user"), "ts", F.lit(0).cast(events.schema["event_id"].dataType).alias("event_id"), F.lit(0.0).alias("value"))
    arrivals = [events.where(wave == k) for k in range(3)] + [last]
    told = trailing.replayed(spark, arrivals, f"{scratch(spark)}/stream-{uuid.uuid4().hex}", "user", "ts", "event_id", "value", 5, "25 hours")
    return told.where("key <> '~'").select(F.col("place").alias("event_id"), V.tidy(F.col("trailing")).alias("trailing"))


def cluster_centers_2d(spark, sf_dir):
    return project.centers(_assigned(spark, sf_dir)).select("clust", V.tidy(F.col("x")).alias("x"), V.tidy(F.col("y")).alias("y"))


def embedding_heat_map(spark, sf_dir):
    grid = _points(spark, sf_dir).select("id", F.posexplode(V.reshaped(F.col("v"))).alias("row", "cells"))
    return grid.select(F.col("id").alias("vec_id"), "row", F.posexplode("cells").alias("col", "x")).select("vec_id", "row", "col", V.tidy(F.col("x")).alias("x"))


def nmin_sweep(spark, sf_dir):
    return spectral.nmin_sweep(spectral.affinity_spectrum(_points(spark, sf_dir)))


def spectral_cluster(spark, sf_dir):
    return clustering.cluster(_points(spark, sf_dir), "spectral", nmin=NMIN).select(F.col("id").alias("vec_id"), "clust")


def hdbscan(spark, sf_dir):
    return density.density_clusters(_points(spark, sf_dir)).select(F.col("id").alias("vec_id"), "clust")


def umap_hdbscan(spark, sf_dir):
    return clustering.cluster(_points(spark, sf_dir), "umap_hdbscan").select(F.col("id").alias("vec_id"), "clust")


def project_2d(spark, sf_dir):
    return project.project(_points(spark, sf_dir)).select(F.col("id").alias("vec_id"), "x", "y")


def project_tsne(spark, sf_dir):
    return project.project(_points(spark, sf_dir), "tsne").select(F.col("id").alias("vec_id"), "x", "y")


def flagship(spark, sf_dir):
    """(vec_id, clust, x, y): spectral clusters with their places in the plane."""
    p = _points(spark, sf_dir).select("id", "v")
    labels = clustering.cluster(p, "spectral", nmin=NMIN)
    return labels.join(project.project(p), "id").select(F.col("id").alias("vec_id"), "clust", "x", "y")


QUERIES = {
    f.__name__: f
    for f in (
        cosine_pairs, knn_prune, sym_affinity, degree, laplacian_triples, heat_map, l2_normalize, speaker_embedding, cluster_sizes, minor_major, centroids, absorb_minor,
        centroid_affinity, best_merge_pair, merge_by_cosine, small_n_fallback, eigen_gaps, partial_slices, slice_mid_times, mix_concat, transcript_semi_join, cache_misses,
        route_plan, kick_filter, url_basename, vocab_invert, diarize_frames, trailing_frame, density_histogram, group_median, viewer_palette, viewer_rows, viewer_audio, cluster_centers_2d,
        similar_pairs, neighbour_graph, matrix_shares, recording_power, feature_cache, slice_frames, trailing_stream,
        viewer_selected, viewer_accepts, palette_colors, line_colors, cropped_frames, frame_delays, frame_rates, nmin_of_spectrum, assignment_frame, matrix_tokens, path_numbers, scatter_grid,
        embedding_heat_map, nmin_sweep, spectral_cluster, hdbscan, umap_hdbscan, project_2d, project_tsne, flagship,
    )
}

_E = "e AS (SELECT vec_id AS id, CAST(embedding AS DOUBLE[]) AS v, label AS clust FROM embeddings)"
_C = "f AS (SELECT clust, id, unnest(v) AS x, unnest(generate_series(0, len(v) - 1)) AS pos FROM e), m AS (SELECT clust, pos, avg(x) AS m FROM f GROUP BY ALL), c AS (SELECT clust, list(m ORDER BY pos) AS cv FROM m GROUP BY clust)"
_KEEP = "n AS (SELECT count(*) AS n, count(*) - greatest(0, least(CAST(trunc(0.98 * count(*)) AS BIGINT), count(*) - 6)) AS keep FROM e)"
_P = "p AS (SELECT a.id AS i, b.id AS j, list_cosine_similarity(a.v, b.v) AS c FROM e a, e b QUALIFY row_number() OVER (PARTITION BY a.id ORDER BY c DESC, b.id) <= (SELECT keep FROM n))"
_W = "w AS (SELECT i, j, 0.5 * sum(c) AS w FROM (SELECT i, j, c FROM p WHERE i <> j UNION ALL SELECT j, i, c FROM p WHERE i <> j) GROUP BY i, j)"
_GRAPH = f"WITH {_E}, {_KEEP}, {_P}, {_W}"
_A = "a AS (SELECT '/data/raw/wavs/' || vec_id || '.wav' AS filename, label AS clust, CAST(embedding[1] AS DOUBLE) AS x, CAST(embedding[2] AS DOUBLE) AS y FROM embeddings)"
_S = "s AS (SELECT doc_id, n_chars * 16 AS n, greatest(1, CAST(ceil((n_chars * 16 + 1) / 160) AS BIGINT) - 160 + 77 + 1) AS steps FROM documents), q AS (SELECT doc_id, n, (steps - 1) // 77 AS last, unnest(generate_series(0, (steps - 1) // 77)) AS part FROM s), r AS (SELECT doc_id, part, part * 77 AS f FROM q WHERE NOT (part = last AND last > 0 AND (n - part * 77 * 160) / 25600 < 0.75))"

_PALETTE = "[" + ", ".join(f"[{r}, {g}, {b}]" for r, g, b in series.PALETTE) + "]"


def _channel(c: int) -> str:
    """One channel of the rainbow at a table's ``place``."""
    cases = " ".join(f"WHEN place <= {y} THEN {low[c]}::DOUBLE + (place - {x}::DOUBLE) / {y - x!r}::DOUBLE * {high[c] - low[c]!r}::DOUBLE" for (x, low), (y, high) in zip(series.RAINBOW, series.RAINBOW[1:], strict=False))
    return f"round(CASE {cases} END, 6) + 0.0"


ORACLES = {
    "cosine_pairs": f"WITH {_E} SELECT a.id AS i, b.id AS j, round(list_cosine_similarity(a.v, b.v), 6) + 0.0 AS c FROM e a JOIN e b ON a.id < b.id",
    "knn_prune": f"WITH {_E}, {_KEEP}, {_P} SELECT i, j, round(c, 6) + 0.0 AS c FROM p",
    "sym_affinity": f"{_GRAPH} SELECT i, j, round(w, 6) + 0.0 AS w FROM w",
    "degree": f"{_GRAPH} SELECT i, round(sum(abs(w)), 6) + 0.0 AS d FROM w GROUP BY i",
    "laplacian_triples": f"{_GRAPH} SELECT i, j, round(-w, 6) + 0.0 AS l FROM w UNION ALL SELECT i, i, round(sum(abs(w)), 6) + 0.0 FROM w GROUP BY i",
    "heat_map": f"WITH {_E} SELECT a.id AS i, b.id AS j, round(greatest(0.0, least(1.0, (list_cosine_similarity(a.v, b.v) - 0.4) / 0.6)), 6) + 0.0 AS shade FROM e a JOIN e b ON a.id < b.id",
    "l2_normalize": f"WITH {_E}, f AS (SELECT id, unnest(v) AS x, unnest(generate_series(0, len(v) - 1)) AS pos, sqrt(list_inner_product(v, v)) AS l FROM e) SELECT id AS vec_id, CAST(pos AS INTEGER) AS pos, round(CASE WHEN l = 0 THEN 0 ELSE x / l END, 6) + 0.0 AS x FROM f",
    "speaker_embedding": f"WITH {_E}, {_C} SELECT clust AS label, CAST(pos AS INTEGER) AS pos, round(m / sqrt(sum(m * m) OVER (PARTITION BY clust)), 6) + 0.0 AS x FROM m",
    "cluster_sizes": "SELECT label AS clust, count(*) AS n FROM embeddings GROUP BY 1",
    "minor_major": f"SELECT label AS clust, count(*) AS n, count(*) < {ABSORB_UNDER} AS is_minor FROM embeddings GROUP BY 1",
    "centroids": f"WITH {_E}, {_C} SELECT clust, CAST(pos AS INTEGER) AS pos, round(m, 6) + 0.0 AS m FROM m",
    "absorb_minor": f"WITH {_E}, {_C}, z AS (SELECT clust, count(*) < {ABSORB_UNDER} AS minor FROM e GROUP BY 1), best AS (SELECT e.id, c.clust AS major FROM e JOIN z USING (clust) CROSS JOIN c JOIN z zc ON zc.clust = c.clust WHERE z.minor AND NOT zc.minor QUALIFY row_number() OVER (PARTITION BY e.id ORDER BY list_cosine_similarity(e.v, c.cv) DESC, c.clust) = 1) SELECT e.id AS vec_id, coalesce(best.major, e.clust) AS clust FROM e LEFT JOIN best USING (id)",
    "centroid_affinity": f"WITH {_E}, {_C} SELECT a.clust AS c1, b.clust AS c2, round(list_cosine_similarity(a.cv, b.cv), 6) + 0.0 AS aff FROM c a JOIN c b ON a.clust < b.clust",
    "best_merge_pair": f"WITH {_E}, {_C} SELECT a.clust AS c1, b.clust AS c2, round(list_cosine_similarity(a.cv, b.cv), 6) + 0.0 AS aff FROM c a JOIN c b ON a.clust < b.clust ORDER BY list_cosine_similarity(a.cv, b.cv) DESC, 1, 2 LIMIT 1",
    "small_n_fallback": "SELECT vec_id, 1 AS clust FROM embeddings WHERE vec_id < 9",
    "eigen_gaps": f"WITH {_E}, f AS (SELECT unnest(v) AS x, unnest(generate_series(0, len(v) - 1)) AS pos FROM e), l AS (SELECT pos, avg(x * x) AS l FROM f GROUP BY pos) SELECT CAST(pos AS INTEGER) AS ord, round(g, 9) + 0.0 AS gap FROM (SELECT pos, lead(l) OVER (ORDER BY pos) - l AS g FROM l) WHERE g IS NOT NULL",
    "partial_slices": f"WITH {_S} SELECT doc_id, CAST(part AS INTEGER) AS part, f AS mel_start, f + 160 AS mel_stop, f * 160 AS wav_start, f * 160 + 25600 AS wav_stop FROM r",
    "slice_mid_times": f"WITH {_S} SELECT doc_id, CAST(part AS INTEGER) AS part, round((f * 160 + f * 160 + 25600) / 2.0 / 16000, 6) + 0.0 AS seconds FROM r",
    "mix_concat": f"WITH {_E}, f AS (SELECT id, unnest(list_concat(v, list_reverse(v))) AS x, unnest(generate_series(0, 2 * len(v) - 1)) AS pos FROM e) SELECT id AS vec_id, CAST(pos AS INTEGER) AS pos, round(x, 6) + 0.0 AS x FROM f",
    "transcript_semi_join": "SELECT CAST(doc_id AS VARCHAR) AS name, lang, source FROM documents WHERE doc_id IN (SELECT doc_id FROM labels)",
    "cache_misses": "SELECT doc_id FROM documents WHERE doc_id NOT IN (SELECT doc_id FROM labels)",
    "route_plan": f"WITH {_A}, r AS (SELECT filename AS src, 'output/spk/' || clust || '/' || regexp_extract(filename, '[^/]*$') AS dst FROM a) SELECT src, dst, count(*) OVER (PARTITION BY dst) > 1 AS collides FROM r",
    "kick_filter": f"WITH {_A}, r AS (SELECT filename AS src, 'input/spk_3/' || regexp_extract(filename, '[^/]*$') AS dst FROM a WHERE clust = 3) SELECT src, dst, count(*) OVER (PARTITION BY dst) > 1 AS collides FROM r",
    "url_basename": r"SELECT page_id, regexp_extract(url, '[^/\\]*$') AS base FROM pages",
    "vocab_invert": "WITH g AS (SELECT p_brand, min(p_partkey) AS first, string_agg(p_type || '#' || p_partkey, ',' ORDER BY p_partkey) AS keys FROM part GROUP BY 1) SELECT CAST(row_number() OVER (ORDER BY first) AS INTEGER) AS pos, keys FROM g UNION ALL SELECT 0, '</PAD>'",
    "diarize_frames": f"WITH {_E}, {_C}, s AS (SELECT e.id AS frame, 's' || c.clust AS name, round(list_cosine_similarity(e.v, c.cv), 9) AS sim FROM e CROSS JOIN c) SELECT frame, name, round(sim, 6) + 0.0 AS sim, CASE WHEN sim > 0.75 THEN 'confident' WHEN sim > 0.65 THEN 'uncertain' ELSE 'unknown' END AS status FROM s QUALIFY row_number() OVER (PARTITION BY frame ORDER BY sim DESC, name) = 1",
    "trailing_frame": "SELECT event_id, round(avg(value) OVER (PARTITION BY user_id ORDER BY ts, event_id ROWS BETWEEN 5 PRECEDING AND CURRENT ROW), 6) + 0.0 AS trailing FROM events",
    "density_histogram": "WITH s AS (SELECT event_type, min(value) AS low, max(value) AS high, count(value) AS n FROM events GROUP BY 1), b AS (SELECT event_type, least(CAST(floor((value - low) / ((high - low) / 10)) AS INTEGER), 9) AS bin, count(*) AS k FROM events JOIN s USING (event_type) WHERE value IS NOT NULL GROUP BY ALL), g AS (SELECT *, CAST(unnest(range(10)) AS INTEGER) AS bin FROM s) SELECT event_type, bin, round(low + bin * ((high - low) / 10), 6) + 0.0 AS lo, round(coalesce(k, 0) / (n * ((high - low) / 10)), 9) + 0.0 AS density FROM g LEFT JOIN b USING (event_type, bin)",
    "group_median": "SELECT event_type, round(quantile_cont(value, 0.5), 6) + 0.0 AS median FROM events GROUP BY 1",
    "viewer_palette": "SELECT DISTINCT label AS clust, round(360.0::DOUBLE / ((SELECT max(label) FROM embeddings) + 1) * label, 6) + 0.0 AS hue FROM embeddings",
    "viewer_rows": f"WITH {_A} SELECT filename, clust, round(x, 6) + 0.0 AS x, round(y, 6) + 0.0 AS y FROM a WHERE clust = 4",
    "viewer_audio": f"WITH {_A} SELECT filename, 'http://localhost:8080/' || filename AS url FROM a",
    "viewer_selected": f"WITH {_A} SELECT filename, clust FROM a WHERE filename = '/data/raw/wavs/7.wav'",
    "viewer_accepts": "SELECT p_partkey, p_size % 2 = 0 AS accepted FROM part",
    "palette_colors": f"WITH p AS (SELECT {_PALETTE} AS rgb), l AS (SELECT DISTINCT label AS clust FROM embeddings) SELECT clust, round(rgb[(clust * 3) % 14 + 1][1] / 255.0::DOUBLE, 6) + 0.0 AS r, round(rgb[(clust * 3) % 14 + 1][2] / 255.0::DOUBLE, 6) + 0.0 AS g, round(rgb[(clust * 3) % 14 + 1][3] / 255.0::DOUBLE, 6) + 0.0 AS b FROM l CROSS JOIN p",
    "line_colors": f"WITH t AS (SELECT DISTINCT p_type AS name FROM part), n AS (SELECT name, row_number() OVER (ORDER BY name) - 1 AS number, count(*) OVER () AS n FROM t), s AS (SELECT name, CAST(number AS INTEGER) AS number, least(floor(number / n::DOUBLE * 256), 255) / 255.0::DOUBLE AS place FROM n) SELECT name, number, {_channel(0)} AS r, {_channel(1)} AS g, {_channel(2)} AS b FROM s",
    "cropped_frames": "SELECT event_id, CAST(f AS INTEGER) AS frame, CAST(f - 3 AS INTEGER) AS axis_from, CAST(f + 3 AS INTEGER) AS axis_to, CAST(greatest(f - 3, 0) AS INTEGER) AS data_from FROM (SELECT event_id, row_number() OVER (PARTITION BY user_id ORDER BY ts, event_id) - 1 AS f FROM events)",
    "frame_delays": "SELECT event_id, round(greatest(2.0::DOUBLE - abs(value) / 10, 0.0), 6) + 0.0 AS wait, abs(value) / 10 - 0.2::DOUBLE > 2.0::DOUBLE AS late FROM events",
    "frame_rates": f"WITH {_S}, m AS (SELECT doc_id, part, round((f * 160 + f * 160 + 25600) / 2.0 / 16000, 6) AS t FROM r) SELECT doc_id, round(1.0::DOUBLE / (b.t - a.t), 6) + 0.0 AS rate FROM m a JOIN m b USING (doc_id) WHERE a.part = 0 AND b.part = 1",
    "nmin_of_spectrum": f"WITH {_E}, f AS (SELECT unnest(v) AS x, unnest(generate_series(0, len(v) - 1)) AS pos FROM e), l AS (SELECT pos, round(avg(x * x), 9) AS l FROM f GROUP BY pos), o AS (SELECT row_number() OVER (ORDER BY l, pos) - 1 AS ord, l FROM l), g AS (SELECT ord, lead(l) OVER (ORDER BY ord) - l AS gap FROM o QUALIFY gap IS NOT NULL AND ord < 14) SELECT CAST(a.ord + 1 AS INTEGER) AS nmin, CAST(b.ord + 1 AS INTEGER) AS k FROM g a JOIN g b ON b.ord >= a.ord QUALIFY row_number() OVER (PARTITION BY a.ord ORDER BY b.gap DESC, b.ord) = 1",
    "assignment_frame": f"WITH {_E} SELECT 'u' || id || '.wav' AS filename, clust, round(v[1], 6) + 0.0 AS x, round(v[2], 6) + 0.0 AS y FROM e",
    "scatter_grid": f"WITH {_A}, s AS (SELECT min(x) AS lx, max(x) AS hx, min(y) AS ly, max(y) AS hy FROM a), p AS (SELECT CAST(floor((x - lx) / (hx - lx) * 23 + 0.5) AS INTEGER) AS px, 17 - CAST(floor((y - ly) / (hy - ly) * 17 + 0.5) AS INTEGER) AS py, clust FROM a CROSS JOIN s), n AS (SELECT px, py, clust, count(*) AS n FROM p GROUP BY ALL) SELECT px, py, clust FROM n QUALIFY row_number() OVER (PARTITION BY px, py ORDER BY n DESC, clust) = 1",
    "path_numbers": "SELECT url, row_number() OVER (ORDER BY url) - 1 AS id FROM (SELECT DISTINCT url FROM pages)",
    "matrix_tokens": "SELECT '</PAD>' AS token, 1 AS clust UNION ALL SELECT DISTINCT p_brand, 1 FROM part",
    "similar_pairs": f"WITH {_E} SELECT a.id AS i, b.id AS j, round(list_cosine_similarity(a.v, b.v), 6) + 0.0 AS c FROM e a JOIN e b ON a.id < b.id AND list_cosine_similarity(a.v, b.v) >= {SIMILAR}",
    "matrix_shares": f"WITH {_E}, n AS (SELECT row_number() OVER (ORDER BY id) - 1 AS id, v FROM e), f AS (SELECT id, unnest(v) AS x, unnest(generate_series(0, len(v) - 1)) AS pos FROM n) SELECT id, CAST(pos AS INTEGER) AS pos, round(x, 6) + 0.0 AS x FROM f",
    "recording_power": "WITH s AS (SELECT event_id // 1000 AS r, CAST(trunc(greatest(-1.0, least(1.0, value / 1000)) * 32767) AS INTEGER) / 32768.0::DOUBLE AS x FROM events) SELECT r || '.wav' AS recording, count(*) AS n_samples, round(sum(x * x) / count(*), 9) + 0.0 AS power FROM s GROUP BY r",
    "feature_cache": f"WITH {_E} SELECT id AS vec_id, CASE WHEN clust < 4 THEN round(v[1], 6) + 0.0 WHEN clust < 8 THEN round(v[1] * 2, 6) + 0.0 END AS x FROM e",
    "slice_frames": "SELECT s.event_id AS slice, e.event_id FROM events s JOIN events e ON e.user_id = s.user_id AND e.ts >= s.ts AND e.ts < s.ts + INTERVAL 12 HOUR WHERE s.event_type = 'error'",
    "trailing_stream": "SELECT event_id, round(avg(value) OVER (PARTITION BY user_id ORDER BY ts, event_id ROWS BETWEEN 5 PRECEDING AND CURRENT ROW), 6) + 0.0 AS trailing FROM events",
    "cluster_centers_2d": f"WITH {_A} SELECT clust, round(avg(x), 6) + 0.0 AS x, round(avg(y), 6) + 0.0 AS y FROM a GROUP BY clust",
    "embedding_heat_map": f"WITH {_E}, f AS (SELECT id, unnest(v) AS x, unnest(generate_series(0, len(v) - 1)) AS pos, CAST(floor(sqrt(len(v))) AS BIGINT) AS h, len(v) AS n FROM e) SELECT id AS vec_id, CAST(pos // (n // h) AS INTEGER) AS \"row\", CAST(pos % (n // h) AS INTEGER) AS col, round(x, 6) + 0.0 AS x FROM f",
    # one merge at this threshold and scale (labels 2 and 5), unrolled: a second is tested for and would join too
    "merge_by_cosine": f"WITH {_E}, {_C}, b AS (SELECT x.clust AS c1, y.clust AS c2, list_cosine_similarity(x.cv, y.cv) AS s FROM c x JOIN c y ON x.clust < y.clust ORDER BY s DESC, 1, 2 LIMIT 1) SELECT id AS vec_id, CASE WHEN clust = c2 AND s >= {MERGE_AT} THEN c1 ELSE clust END AS clust FROM e CROSS JOIN b",
}
