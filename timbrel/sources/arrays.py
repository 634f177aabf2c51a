"""Matrices and recordings as Spark data sources, so that one large file is read and written by many tasks.

``npy`` has the rows of .npy matrices, ``npy_headers`` one row a file, ``wave`` chunks of PCM wave
files with a halo to either side.  A file beyond ``partition_bytes`` is cut into equal shares of its
rows, small files share a task; nothing but the listing is read on the driver, and a task reads the
headers of its own files and the bytes of its own rows.  Filters on ``id`` (or ``chunk``) and ``path``
go down to the reader: a share outside them reads no more than headers.
"""

from __future__ import annotations

import math
import uuid
import wave
from collections.abc import Iterable, Iterator
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql.datasource import DataSource, DataSourceArrowWriter, DataSourceReader, EqualTo, Filter, GreaterThan, GreaterThanOrEqual, In, InputPartition, IsNotNull, LessThan, LessThanOrEqual, WriterCommitMessage

from timbrel.sources.sound import RATE, inputs, pcm, resample, resampled_size
from timbrel.sources.stores import listed, reached

#: Bytes of a share of a file, and of a batch, about.
PARTITION_BYTES, BATCH_BYTES = 64 << 20, 4 << 20
#: Seconds of a chunk, and samples of its halo to either side.
SECONDS, HALO = 60, 0


@dataclass
class Shares(InputPartition):
    """(path, share, shares) of each file a task reads."""

    files: list[tuple[str, int, int]]

    def __init__(self, files):
        self.files = files


def shares(files: list[tuple[str, int]], most: int) -> list[Shares]:
    """Large files cut, small ones together, in the order of the listing."""
    out, held, used = [], [], 0
    for path, size in files:
        parts = max(1, math.ceil(size / most))
        if parts > 1:
            out += [Shares([(path, k, parts)]) for k in range(parts)]
            continue
        if held and used + size > most:
            out.append(Shares(held))
            held, used = [], 0
        held.append((path, 0, 1))
        used += size
    return out + ([Shares(held)] if held else [])


class _Reader(DataSourceReader):
    """Listing, shares and filters; ``number`` names the column that numbers a file's rows."""

    number, suffix = "id", ".npy"

    def __init__(self, options: dict):
        self.path = options["path"]
        self.most = int(options.get("partition_bytes", PARTITION_BYTES))
        self.low, self.high, self.paths = 0, None, None

    def pushFilters(self, filters: list[Filter]) -> Iterable[Filter]:
        for f in filters:
            if not self._taken(f):
                yield f

    def _taken(self, f: Filter) -> bool:
        column, value = getattr(f, "attribute", None), getattr(f, "value", None)
        if isinstance(f, IsNotNull):
            return column in ((self.number,), ("path",))
        if column == (self.number,) and value is not None:
            if isinstance(f, EqualTo):
                self._between(value, value + 1)
            elif isinstance(f, (GreaterThan, GreaterThanOrEqual)):
                self._between(value + isinstance(f, GreaterThan), None)
            elif isinstance(f, (LessThan, LessThanOrEqual)):
                self._between(None, value + isinstance(f, LessThanOrEqual))
            elif isinstance(f, In):
                known = [v for v in value if v is not None]
                self._between(min(known, default=0), max(known, default=-1) + 1)
                return False  # Spark still looks at those between
            else:
                return False
            return True
        if column == ("path",) and isinstance(f, (EqualTo, In)) and value is not None:
            own = {value} if isinstance(f, EqualTo) else set(value)
            self.paths = own if self.paths is None else self.paths & own
            return True
        return False

    def _between(self, low: int | None, high: int | None) -> None:
        self.low = max(self.low, low if low is not None else 0)
        if high is not None:
            self.high = high if self.high is None else min(self.high, high)

    def partitions(self) -> list[Shares]:
        files = [f for f in listed(self.path, self.suffix) if self.paths is None or f[0] in self.paths]
        return shares(files, self.most) or [Shares([])]

    def rows(self, n: int, share: int, of: int) -> tuple[int, int]:
        """The rows of a file's share that the filters leave."""
        low, high = n * share // of, n * (share + 1) // of
        return max(low, self.low), high if self.high is None else min(high, self.high)


@dataclass
class Header:
    """Rows, columns, number type, order and place of the numbers of a .npy file."""

    rows: int
    columns: int
    dtype: np.dtype
    by_column: bool
    at: int


def header(f) -> Header:
    """Of an open .npy file; other than matrices of numbers are refused."""
    version = np.lib.format.read_magic(f)
    if version not in ((1, 0), (2, 0)):
        raise ValueError(f".npy version {version} is not known")
    shape, by_column, dtype = (np.lib.format.read_array_header_1_0 if version == (1, 0) else np.lib.format.read_array_header_2_0)(f)
    if len(shape) != 2:
        raise ValueError(f"a matrix has 2 dimensions, not {len(shape)}")
    if dtype.kind not in "fiub":
        raise ValueError(f"a matrix holds real numbers, not {dtype}")
    return Header(*shape, dtype, by_column and shape[0] > 1, f.tell())


def matrix_rows(f, head: Header, low: int, high: int) -> np.ndarray:
    """Rows ``low`` to ``high`` of an open .npy file as doubles; only their bytes are read."""
    size, width = head.dtype.itemsize, head.columns
    if not head.by_column:
        f.seek(head.at + low * width * size)
        return np.frombuffer(f.read((high - low) * width * size), head.dtype).reshape(-1, width).astype(np.float64)
    out = np.empty((high - low, width))
    for c in range(width):
        f.seek(head.at + (c * head.rows + low) * size)
        out[:, c] = np.frombuffer(f.read((high - low) * size), head.dtype)
    return out


def lists(m: np.ndarray, kind: pa.DataType) -> pa.ListArray:
    return pa.ListArray.from_arrays(pa.array(np.arange(len(m) + 1, dtype=np.int64) * m.shape[1], pa.int32()), pa.array(m.ravel(), kind))


class MatrixReader(_Reader):
    def read(self, partition: Shares) -> Iterator[pa.RecordBatch]:
        for path, share, of in partition.files:
            store, at = reached(path)
            with store.open_input_file(at) as f:
                head = header(f)
                low, high = self.rows(head.rows, share, of)
                step = max(1, BATCH_BYTES // max(8, 8 * head.columns))
                for a in range(low, high, step):
                    m = matrix_rows(f, head, a, min(a + step, high))
                    yield pa.RecordBatch.from_arrays([pa.array([path] * len(m)), pa.array(np.arange(a, a + len(m))), lists(m, pa.float64())], names=["path", "id", "v"])


class HeaderReader(_Reader):
    number = "rows"

    def pushFilters(self, filters: list[Filter]) -> Iterable[Filter]:
        return filters

    def partitions(self) -> list[Shares]:
        files = listed(self.path, self.suffix)
        return [Shares([(path, 0, 1) for path, _ in files[a : a + 256]]) for a in range(0, len(files), 256)] or [Shares([])]

    def read(self, partition: Shares) -> Iterator[tuple]:
        for path, _, _ in partition.files:
            store, at = reached(path)
            with store.open_input_file(at) as f:
                head = header(f)
            yield path, head.rows, head.columns


@dataclass
class Written(WriterCommitMessage):
    files: list[str] = field(default_factory=list)


class MatrixWriter(DataSourceArrowWriter):
    """Matrices of about ``partition_bytes`` each; they take their names when all tasks are done."""

    def __init__(self, options: dict, overwrite: bool):
        self.path, self.overwrite = options["path"].rstrip("/"), overwrite
        self.most, self.dtype = int(options.get("partition_bytes", PARTITION_BYTES)), np.dtype(options.get("dtype", "float64"))
        self.aside = f"{self.path}/_temporary-{uuid.uuid4().hex}"

    def write(self, iterator: Iterator[pa.RecordBatch]) -> Written:
        task, out, held, used = TaskContext.get(), [], [], 0
        store, at = reached(self.aside)
        store.create_dir(at, recursive=True)

        def close() -> None:
            nonlocal held, used
            name = f"part-{task.partitionId():05d}-{len(out):05d}-{task.taskAttemptId()}.npy"
            with store.open_output_stream(f"{at}/{name}") as f:
                np.save(f, np.concatenate(held))
            out.append(name)
            held, used = [], 0

        for batch in iterator:
            column = batch.column(batch.schema.get_field_index("v"))
            if column.null_count or column.flatten().null_count:
                raise ValueError("a matrix holds no nulls")
            widths = np.unique(column.value_lengths().to_numpy())
            if len(widths) > 1 or held and len(widths) and held[0].shape[1] != widths[0]:
                raise ValueError("a matrix's rows have one length")
            m = np.asarray(column.flatten()).reshape(len(column), -1).astype(self.dtype) if len(widths) else np.zeros((0, 1))
            while len(m):
                room = max(1, (self.most - used) // max(1, m[0].nbytes))
                held.append(m[:room])
                used += held[-1].nbytes
                m = m[room:]
                if len(m):
                    close()
        if held:
            close()
        return Written(out)

    def commit(self, messages: list[Written | None]) -> None:
        store, to = reached(self.path)
        _, at = reached(self.aside)
        old = [name for name, _ in listed(self.path, ".npy")] if self.overwrite else []
        for message in messages:
            for name in message.files if message else []:
                store.move(f"{at}/{name}", f"{to}/{name}")
        for name in old:
            store.delete_file(reached(name)[1])
        self.abort(messages)

    def abort(self, messages: list[Written | None]) -> None:
        store, at = reached(self.aside)
        if store.get_file_info(at).type.name != "NotFound":
            store.delete_dir(at)


class Matrices(DataSource):
    """.npy matrices: (path, id, v), id a row's number in its file; writing takes the column v."""

    @classmethod
    def name(cls) -> str:
        return "npy"

    def schema(self) -> str:
        return "path string, id long, v array<double>"

    def reader(self, schema) -> MatrixReader:
        return MatrixReader(self.options)

    def writer(self, schema, overwrite: bool) -> MatrixWriter:
        return MatrixWriter(self.options, overwrite)


class MatrixHeaders(DataSource):
    """(path, rows, columns) of .npy matrices, without their numbers."""

    @classmethod
    def name(cls) -> str:
        return "npy_headers"

    def schema(self) -> str:
        return "path string, rows long, columns long"

    def reader(self, schema) -> HeaderReader:
        return HeaderReader(self.options)


class WaveReader(_Reader):
    number, suffix = "chunk", ".wav"

    def __init__(self, options: dict):
        super().__init__(options)
        self.seconds, self.halo, self.rate = (int(options.get(k, v)) for k, v in (("seconds", SECONDS), ("halo", HALO), ("rate", RATE)))
        if self.seconds < 1 or self.halo < 0 or self.rate < 0:
            raise ValueError("a chunk has at least one second, and halo and rate are not negative")

    def read(self, partition: Shares) -> Iterator[pa.RecordBatch]:
        for path, share, of in partition.files:
            store, at = reached(path)
            with store.open_input_file(at) as raw, wave.open(raw) as f:
                n_own, own = f.getnframes(), f.getframerate()
                rate = self.rate or own
                n, size = resampled_size(n_own, own, rate), self.seconds * rate
                low, high = self.rows(max(1, math.ceil(n / size)), share, of)
                for chunk in range(low, high):
                    start, end = chunk * size, min(n, (chunk + 1) * size)
                    a, b = max(0, start - self.halo), min(n, end + self.halo)
                    first, last, skip = inputs(a, b, n_own, own, rate)
                    f.setpos(first)
                    x = resample(pcm(f.readframes(last - first), f.getsampwidth(), f.getnchannels()), own, rate)[skip : skip + b - a]
                    arrays = [pa.array([c]) for c in (path, chunk, start, start - a, end - start, n, rate)] + [lists(x[None], pa.float32())]
                    yield pa.RecordBatch.from_arrays(arrays, names=["path", "chunk", "start", "lead", "n", "n_samples", "rate", "samples"])


class Waves(DataSource):
    """Chunks of PCM wave files, mono at ``rate`` (0: their own): ``n`` samples from ``start`` on, after ``lead`` samples of halo and before as many as there are.

    Chunks put together are the recording resampled as a whole.  A recording without samples is one empty chunk.
    """

    @classmethod
    def name(cls) -> str:
        return "wave"

    def schema(self) -> str:
        return "path string, chunk long, start long, lead long, n long, n_samples long, rate long, samples array<float>"

    def reader(self, schema) -> WaveReader:
        return WaveReader(self.options)


def known(spark: SparkSession) -> SparkSession:
    """The session with these sources registered and filters going down to them."""
    spark.conf.set("spark.sql.python.filterPushdown.enabled", "true")
    for source in (Matrices, MatrixHeaders, Waves):
        spark.dataSource.register(source)
    return spark


def matrices(spark: SparkSession, path: str, partition_bytes: int = PARTITION_BYTES) -> DataFrame:
    """(path, id, v): rows of a .npy matrix or of a folder of them, numbered file by file."""
    return known(spark).read.format("npy").option("partition_bytes", partition_bytes).load(path)


def headers(spark: SparkSession, path: str) -> DataFrame:
    """(path, rows, columns) of each .npy matrix."""
    return known(spark).read.format("npy_headers").load(path)


def write_matrices(df: DataFrame, path: str, mode: str = "append", dtype: str = "float64", partition_bytes: int = PARTITION_BYTES) -> None:
    """The column v as .npy matrices of about ``partition_bytes``, in order of partition and row; a task that fails leaves nothing."""
    known(df.sparkSession)
    df.select("v").write.format("npy").mode(mode).option("dtype", dtype).option("partition_bytes", partition_bytes).save(path)


def wave_chunks(spark: SparkSession, path: str, seconds: int = SECONDS, halo: int = HALO, rate: int = RATE, partition_bytes: int = PARTITION_BYTES) -> DataFrame:
    """(path, chunk, start, lead, n, n_samples, rate, samples): recordings in chunks of whole seconds, ``halo`` samples more to either side."""
    return known(spark).read.format("wave").option("seconds", seconds).option("halo", halo).option("rate", rate).option("partition_bytes", partition_bytes).load(path)
