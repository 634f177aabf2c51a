"""Every query with SQL gives DuckDB's rows; all queries run."""

import duckdb
import pytest

from timbrel.plans import queries as plans

SF = "/root/testdata/sf0.01"
TABLES = "documents benchmark labels conversations embeddings events part pages".split()


@pytest.fixture(scope="module")
def duck():
    c = duckdb.connect()
    for name in TABLES:
        c.sql(f"CREATE VIEW {name} AS SELECT * FROM '{SF}/{name}.parquet'")
    return c


def rows(frame):
    frame = frame[sorted(frame.columns)]
    return list(frame.columns), sorted(map(str, frame.itertuples(index=False, name=None)))


@pytest.mark.parametrize("name", sorted(plans.ORACLES))
def test_sql(spark, duck, name):
    assert rows(plans.QUERIES[name](spark, SF).toPandas()) == rows(duck.sql(plans.ORACLES[name]).df())


@pytest.mark.parametrize("name", ["nmin_sweep", "spectral_cluster", "hdbscan", "project_2d", "flagship"])
def test_runs(spark, name):
    assert plans.QUERIES[name](spark, "/root/testdata/sf0.001").count() > 0


def test_sweep_of_the_probe(spark):
    got = {r["nmin"]: r["k"] for r in plans.QUERIES["nmin_sweep"](spark, SF).collect()}
    assert got[1] == 1 and got[2] == 6 and got[14] == 14


def test_entry(spark):
    import __spark_entry__ as entry

    assert entry.entry(spark).columns == ["vec_id", "clust", "x", "y"]
    assert set(entry.oracle_sql()) <= set(entry.queries())


def test_entry_without_training_operators(monkeypatch):
    import importlib.util
    import sys

    import __spark_entry__ as whole

    for name in ("timbrel.llm", "timbrel.llm.entry"):
        monkeypatch.setitem(sys.modules, name, None)
    spec = importlib.util.spec_from_file_location("entry_alone", whole.__file__)
    alone = importlib.util.module_from_spec(spec)
    spec.loader.exec_module(alone)
    assert set(alone.queries()) == set(plans.QUERIES) and set(alone.oracle_sql()) == set(plans.ORACLES)


def test_core_does_not_need_training_operators():
    from pathlib import Path

    package = Path(plans.__file__).parents[1]
    files = [f for f in package.rglob("*.py") if "llm" not in f.relative_to(package).parts]
    assert len(files) > 15 and not any("timbrel.llm" in f.read_text() for f in files)
