"""The Merkle manifest against a plain tree built row by row, and DuckDB."""

import hashlib
import zlib

import pytest
from pyspark.sql import functions as F

from timbrel.llm import entry, manifest
from tests.llm.test_llm import rows_of, sql_rows

SF = "/root/testdata/sf0.001"
COLUMNS = "doc_id long, source string, lang string, n_chars long, text string"


def h(*parts):
    return hashlib.sha256("".join(parts).encode()).hexdigest()


def spelled(value):
    return "-" if value is None else f"{len(str(value).encode())}:{value}"


def leaf(row):
    return h(*[spelled(row[k]) for k in ("doc_id", "source", "lang", "n_chars", "text")])


def climb(nodes):
    """The root, and for each node its siblings (left, right) level by level."""
    paths, own = [[] for _ in nodes], list(range(len(nodes)))
    while len(nodes) > 1:
        for i, at in enumerate(own):
            run = nodes[at // 16 * 16 : at // 16 * 16 + 16]
            paths[i].append((run[: at % 16], run[at % 16 + 1 :]))
        nodes = [h(*nodes[i : i + 16]) for i in range(0, len(nodes), 16)]
        own = [at // 16 for at in own]
    return nodes[0], paths


def brute(rows):
    groups = {}
    for r in rows:
        groups.setdefault(r["source"], []).append(r)
    order = sorted(groups, key=lambda s: (s is not None, (s or "").encode()))
    trees = {}
    for s in order:
        own = sorted(groups[s], key=lambda r: (r["doc_id"] is not None, r["doc_id"] or 0, leaf(r)))
        trees[s] = (own, *climb([leaf(r) for r in own]))
    root, tops = climb([trees[s][1] for s in order])
    out = []
    for s, top in zip(order, tops, strict=True):
        own, subroot, paths = trees[s]
        for r, path in zip(own, paths, strict=True):
            shown = dict(r)
            if r["doc_id"] is not None and zlib.crc32(str(r["doc_id"]).encode()) % 5 == 0 and r["text"] is not None:
                shown["text"] = "".join(c.lower() if "A" <= c <= "Z" else c for c in r["text"])
            node = leaf(shown)
            for left, right in path + top:
                node = h(*left, node, *right)
            out.append((r["doc_id"], leaf(r), subroot, root, h(*[x for left, right in path + top for x in left + right]), node, node == root))
    return sorted(out, key=str)


def saved(spark, tmp_path, rows, schema=COLUMNS):
    spark.createDataFrame(rows, schema).write.parquet(f"{tmp_path}/documents.parquet")
    return str(tmp_path)


ODD = [(None, None, None, None, None), (None, "", "en", 1, "A"), (0, "", None, None, ""), (7, "only", "en", 3, "Ünd É A"), (5, "rep", "x", 1, "Same"), (5, "rep", "x", 1, "Same"), (5, "rep", "x", 1, "Other"), (-3, "rep", "x", 0, "B" * 300_000)]


@pytest.mark.parametrize("sizes", [{}, {"a": 1}, {"a": 16, "b": 17}, {"hot": 700, **{f"s{i:03d}": 1 + i % 3 for i in range(300)}}])
def test_manifest(spark, tmp_path, sizes):
    rows = [(i, s, "en", i, f"Text {i} of {s}") for s, n in sizes.items() for i in range(n)]
    rows += ODD if len(sizes) != 1 else []
    got = rows_of(manifest.query(spark, saved(spark, tmp_path, rows)))
    names = [c.split()[0] for c in COLUMNS.split(", ")]
    assert got == (brute([dict(zip(names, r, strict=True)) for r in rows]) if rows else [])


def test_manifest_of_nothing(spark, tmp_path):
    assert manifest.query(spark, saved(spark, tmp_path, [])).count() == 0
    assert manifest.manifest(spark.createDataFrame([], COLUMNS)).root is None


def test_nodes_and_clashing_columns(spark):
    docs = spark.createDataFrame([(i, f"s{i % 20}", "en", i, f"t{i}") for i in range(400)], COLUMNS)
    clash = docs.withColumns({c: F.lit("own") for c in ("group", "key", "leaf", "place", "n", "digest", "run", "path", "root", "at", "parent", "all")})
    plain, odd = manifest.manifest(docs), manifest.manifest(clash)
    assert plain.root == odd.root
    by_level = {(r["tree"], r["level"]): r["count"] for r in odd.nodes().groupBy("tree", "level").count().collect()}
    # 20 groups of 20 leaves: two parents each, then one; 20 subroots, two parents, one root
    assert by_level == {("rows", 0): 400, ("rows", 1): 40, ("rows", 2): 20, ("groups", 0): 20, ("groups", 1): 2, ("groups", 2): 1}
    some = odd.prove().withColumn("folded", manifest.fold(F.col("leaf"), F.col("path")))
    assert some.where("folded <> root").count() == 0 and some.count() == 400
    assert some.withColumn("folded", manifest.fold(F.lit("0" * 64), F.col("path"))).where("folded = root").count() == 0


def test_places_do_not_depend_on_partitions(spark):
    rows = spark.createDataFrame([(i, "hot", "en", i, "t") for i in range(500)] * 2, COLUMNS)
    assert manifest.manifest(rows.repartition(7)).root == manifest.manifest(rows.coalesce(1)).root


def test_manifest_sql_beyond_one_level(spark):
    assert sorted(map(str, rows_of(manifest.query(spark, "/root/testdata/sf0.01").select("doc_id", "folded_root", "leaf", "proof_sha256", "root", "subroot", "verified")))) == sql_rows(entry.ORACLES["op12_merkle_manifest"], "/root/testdata/sf0.01")
