"""Adding columns to a table with a vectorised Python kernel."""

from __future__ import annotations

import ctypes
from collections.abc import Callable, Iterator, Sequence

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T


#: Bits of a fingerprint that the filter of documents' fingerprints looks at: 2 MB for any benchmark.
FILTER_BITS = 24


def quoted(name: str):
    return F.col("`" + name.replace("`", "``") + "`")


def give_back() -> None:
    """Return freed memory to the machine: workers are reused, and what one operator frees must not add to the next one's."""
    pa.default_memory_pool().release_unused()
    trim = getattr(ctypes.CDLL(None), "malloc_trim", None)  # glibc only
    if trim is not None:
        trim(0)


def append(docs: DataFrame, make: Callable[[], Callable[..., list]], fields: T.StructType, inputs: Sequence[str] = ("text",), keep: Sequence[str] | None = None) -> DataFrame:
    """``docs`` with ``fields`` appended, computed batch by batch from the ``inputs`` columns.

    ``make()`` runs once a task and gives the kernel: Arrow columns in, one Arrow array (or list)
    for each new field out.  ``keep`` names the input columns to carry along (default: all); those
    that clash with a new field are replaced.  No shuffle; a lost task is simply run again.
    """
    from pyspark.sql.pandas.types import to_arrow_schema

    new = set(fields.names)
    kept = [c for c in (docs.columns if keep is None else keep) if c not in new]
    more = [c for c in inputs if c not in kept]
    schema = T.StructType([f for f in docs.schema if f.name in kept] + list(fields))
    kept = [f.name for f in docs.schema if f.name in kept]
    types = list(to_arrow_schema(fields).types)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        kernel = make()
        for batch in batches:
            columns = dict(zip([*kept, *more], batch.columns, strict=True))
            made = kernel(*[columns[c] for c in inputs])
            arrays = [x if isinstance(x, (pa.Array, pa.ChunkedArray)) else pa.array(x, t) for x, t in zip(made, types, strict=True)]
            yield pa.RecordBatch.from_arrays([columns[c] for c in kept] + arrays, names=schema.names)
            del columns, made, arrays
        del kernel
        give_back()

    return docs.select(*[quoted(c) for c in [*kept, *more]]).mapInArrow(run, schema)


def filter_bits(prints: DataFrame) -> np.ndarray:
    """A bit for each value of the first FILTER_BITS bits of the prints: a filter of one size for any benchmark."""
    step = 1 << 16
    slot = F.shiftrightunsigned("print", 64 - FILTER_BITS)
    parts = prints.select(F.floor(slot / step).cast("int").alias("part"), (slot % step).cast("int").alias("bit")).distinct()

    def run(key: tuple, rows: pa.Table) -> pa.Table:
        bits = np.zeros(step, np.uint8)
        bits[rows.column("bit").to_numpy()] = 1
        return pa.table({"part": pa.array([key[0].as_py()], pa.int32()), "bits": pa.array([np.packbits(bits, bitorder="little").tobytes()], pa.binary())})

    out = np.zeros(1 << (FILTER_BITS - 3), np.uint8)
    for r in parts.groupBy("part").applyInArrow(run, "part int, bits binary").collect():  # a 2 MB filter at most, in all
        out[r["part"] * step // 8 : (r["part"] + 1) * step // 8] = np.frombuffer(r["bits"], np.uint8)
    return out


def may_be(rows: DataFrame, column: str, known: DataFrame, key: str) -> DataFrame:
    """``rows`` with __maybe: false only where ``known`` surely has no row whose ``key`` is the row's ``column``.

    A filter of one size, whatever the size of ``known``, is broadcast; no row moves.  So a join need only move
    the rows that may match.
    """
    slots = rows.sparkSession.sparkContext.broadcast(filter_bits(known.select(F.xxhash64(quoted(key)).alias("print"))))

    def make():
        def run(slot) -> list:
            at = slot.to_numpy()
            return [pa.array((slots.value[at >> 3] >> (at & 7)) & 1).cast(pa.bool_())]

        return run

    slot = F.shiftrightunsigned(F.xxhash64(quoted(column)), 64 - FILTER_BITS).alias("__slot")
    return append(rows.select("*", slot), make, T.StructType([T.StructField("__maybe", T.BooleanType())]), ("__slot",), rows.columns)
