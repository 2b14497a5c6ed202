"""Helpers of the training-data operators: shared storage, Arrow batches, grouped maps."""

from __future__ import annotations

import tempfile
import uuid
from collections.abc import Iterable, Iterator
from contextlib import contextmanager

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: ASCII white space: the class [\x20\x09-\x0D].
SPACE = " \t\n\x0b\x0c\r"
UPPER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ"


def documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/documents.parquet")


def shared_dir(spark: SparkSession) -> str:
    """The folder that driver and executors share; a folder of our own only where none is set."""
    sc = spark.sparkContext
    place = sc.getConf().get("spark.checkpoint.dir") or spark.conf.get("spark.checkpoint.dir", None) or sc.getCheckpointDir()
    if not place:
        if not sc.master.startswith("local"):
            raise ValueError("spark.checkpoint.dir must name a folder that all executors share")
        place = "file://" + tempfile.mkdtemp(prefix="spindrift-")
        sc.setCheckpointDir(place)
    return place


@contextmanager
def setting(spark: SparkSession, key: str, value: str) -> Iterator[None]:
    """A setting of the session, for a while."""
    before = spark.conf.get(key, None)
    spark.conf.set(key, value)
    try:
        yield
    finally:
        spark.conf.set(key, before) if before is not None else spark.conf.unset(key)


#: Spark's setting that removes a query's shuffle files when the query has ended.
CLEANUP = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"
#: Spark's setting that makes small partitions for all cores rather than partitions of the advisory size.
SPREAD = "spark.sql.adaptive.coalescePartitions.parallelismFirst"
#: Parquet's setting that compares pages with their checksums on reading.
CHECKED = "parquet.page.verify-checksum.enabled"


def plain(spark: SparkSession) -> dict[str, str]:
    """Options of a write below file: without Hadoop's second file of checksums beside each; Parquet's pages have their own.

    Hadoop starts a process, chmod, for each file and folder that it makes there.  A file system of the session's own stays.
    """
    if spark.sparkContext._jsc.hadoopConfiguration().get("fs.file.impl"):
        return {}
    return {"fs.file.impl": "org.apache.hadoop.fs.RawLocalFileSystem", "fs.file.impl.disable.cache": "true"}


class Scratch:
    """Written tables in the shared folder.  They cut lineage, survive lost executors and are removed by name."""

    def __init__(self, spark: SparkSession, name: str):
        self.spark = spark
        self.root = f"{shared_dir(spark).rstrip('/')}/spindrift/{name}-{uuid.uuid4().hex}"
        self.count = 0

    def path(self, name: str) -> str:
        self.count += 1
        return f"{self.root}/{self.count:03d}-{name}"

    def write(self, df: DataFrame, name: str, light: bool = False) -> DataFrame:
        """The table as written and read again, of the same schema.  Shuffle files of the write go as it ends.

        `light`: rows are small and little work, so a few of them are one file rather than one for each core.
        """
        place = self.path(name)
        spread = "false" if light else self.spark.conf.get(SPREAD)
        with setting(self.spark, CLEANUP, "true"), setting(self.spark, SPREAD, spread):
            df.write.options(compression="zstd", **plain(self.spark)).parquet(place)
        out = self.spark.read.option(CHECKED, "true").schema(df.schema).parquet(place)
        out._scratch_place = place
        return out

    def drop(self, *tables: DataFrame) -> None:
        """Remove tables that no later plan reads."""
        jvm = self.spark.sparkContext._jvm
        for t in tables:
            place = jvm.org.apache.hadoop.fs.Path(t._scratch_place)
            place.getFileSystem(self.spark.sparkContext._jsc.hadoopConfiguration()).delete(place, True)


#: Rows of an Arrow batch.  Texts are long: the default of 10,000 rows would hold tens of MB for each task, outside the heap.
BATCH_ROWS = 1000


def need(df: DataFrame, *names: str) -> DataFrame:
    """Only the named columns, so that others, whatever their names, don't clash with ours.

    Sets the session's Arrow batches to BATCH_ROWS rows at most.
    """
    key = "spark.sql.execution.arrow.maxRecordsPerBatch"
    if not 0 < int(df.sparkSession.conf.get(key)) <= BATCH_ROWS:
        df.sparkSession.conf.set(key, str(BATCH_ROWS))
    missing = [n for n in names if n not in df.columns]
    if missing:
        raise ValueError(f"columns missing: {missing}")
    return df.select(*[F.col(f"`{n}`") for n in names])


def free_name(df: DataFrame, base: str) -> str:
    """A column name for our own use that the table doesn't have, whatever the case."""
    taken = {c.lower() for c in df.columns}
    name = f"_{base}"
    while name in taken:
        name = f"_{name}"
    return name


def carried(names: tuple[str, ...]) -> Column:
    """The named columns as one, `_carried`, so that their names clash with none of ours on the way."""
    return (F.struct(*[F.col(f"`{n}`").alias(f"c{i}") for i, n in enumerate(names)]) if names else F.lit(None).cast("boolean")).alias("_carried")


def given_back(names: tuple[str, ...], ours: tuple[str, ...]) -> list[Column]:
    """Carried columns again; one with the name of a result column is called carried_<name>."""
    return [F.col("_carried")[f"c{i}"].alias(f"carried_{n}" if n.lower() in ours else n) for i, n in enumerate(names)]


def lower_ascii(c: Column) -> Column:
    return F.translate(c, UPPER, UPPER.lower())


def salts(rows: int, each: int) -> int:
    """Into how many parts a key is dealt so that each part has about `each` rows, even if one key has all rows."""
    return max(1, -(-rows // each))


def blobs(column: pa.ChunkedArray | pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """Bytes and offsets (n + 1) of a binary column without nulls, without a copy."""
    a = column.combine_chunks() if isinstance(column, pa.ChunkedArray) else column
    if a.type not in (pa.binary(), pa.large_binary(), pa.string(), pa.large_string()):
        raise TypeError(str(a.type))
    wide = a.type in (pa.large_binary(), pa.large_string())
    _, offsets, data = a.buffers()
    at = np.frombuffer(offsets, np.int64 if wide else np.int32)[a.offset : a.offset + len(a) + 1].astype(np.int64) if offsets is not None and len(a) else np.zeros(len(a) + 1, np.int64)
    raw = np.frombuffer(data, np.uint8) if data is not None and data.size else np.zeros(0, np.uint8)
    return raw[at[0] : at[-1]], at - at[0]


def bounded(batches: Iterable[pa.RecordBatch], column: str, most: int = 4 << 20) -> Iterator[pa.RecordBatch]:
    """The same rows in batches of at most about `most` bytes of the column (one row at least)."""
    for b in batches:
        if not b.num_rows:
            continue
        c = b.column(b.schema.get_field_index(column))
        _, at = blobs(c)
        first = 0
        while first < b.num_rows:
            last = max(first + 1, int(np.searchsorted(at, at[first] + most, side="right")) - 1)
            yield b.slice(first, last - first)
            first = last


def groups(batches: Iterable[pa.RecordBatch], key: str) -> Iterator[pa.Table]:
    """Tables of equal key from batches sorted by key (not null); only one group is held at a time."""
    held: list[pa.RecordBatch] = []
    last = None
    for b in batches:
        if not b.num_rows:
            continue
        k = b.column(b.schema.get_field_index(key)).to_numpy(zero_copy_only=False)
        cuts = np.flatnonzero(k[1:] != k[:-1]) + 1
        for lo, hi in zip([0, *cuts], [*cuts, len(k)]):
            if held and k[lo] != last:
                yield pa.Table.from_batches(held)
                held = []
            last = k[lo]
            held.append(b.slice(lo, hi - lo))
    if held:
        yield pa.Table.from_batches(held)


def mix64(x: np.ndarray) -> np.ndarray:
    """The splitmix64 finaliser: a bijection of 64-bit numbers."""
    x = x.astype(np.uint64, copy=True)
    x += np.uint64(0x9E3779B97F4A7C15)
    x ^= x >> np.uint64(30)
    x *= np.uint64(0xBF58476D1CE4E5B9)
    x ^= x >> np.uint64(27)
    x *= np.uint64(0x94D049BB133111EB)
    x ^= x >> np.uint64(31)
    return x


_BASE = np.uint64(0x9E3779B97F4A7C15 | 1)
_LUT = mix64(np.arange(256, dtype=np.uint64) * np.uint64(0xD1342543DE82EF95))
_INVERSE = np.uint64(pow(int(_BASE), -1, 1 << 64))


def _powers(base: np.uint64, n: int, cache: dict = {}) -> np.ndarray:
    have = cache.get(int(base))
    if have is None or len(have) < n:
        size = max(n, 1 << 20)
        have = np.full(size, base, np.uint64)
        have[0] = 1
        have = np.multiply.accumulate(have)
        if size <= 1 << 21:  # tables for longer texts are made as they are needed
            cache[int(base)] = have
    return have[:n]


def span_hashes(raw: np.ndarray, start: np.ndarray, end: np.ndarray) -> np.ndarray:
    """A 64-bit hash of raw[start:end] for each span, by prefix sums of a polynomial over random byte values."""
    sums = np.zeros(len(raw) + 1, np.uint64)
    np.cumsum(_LUT[raw] * _powers(_BASE, len(raw)), dtype=np.uint64, out=sums[1:])
    h = (sums[end] - sums[start]) * _powers(_INVERSE, len(raw) + 1)[start]
    return mix64(h ^ ((end - start).astype(np.uint64) << np.uint64(40)))


_IS_SPACE = np.zeros(256, bool)
_IS_SPACE[[9, 10, 11, 12, 13, 32]] = True
_LOWER = np.arange(256, dtype=np.uint8)
_LOWER[65:91] += 32


def words(raw: np.ndarray, at: np.ndarray, lower: bool) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Word hashes of all texts in raw, and each word's start and text.  Words don't cross text borders."""
    if lower:
        raw = _LOWER[raw]
    ink = ~_IS_SPACE[raw]
    first = ink.copy()
    first[1:] &= ~ink[:-1]
    edge = at[1:-1][(at[1:-1] > 0) & (at[1:-1] < len(raw))]
    first[edge] = ink[edge]
    start = np.flatnonzero(first)
    last = ink.copy()
    last[:-1] &= ~ink[1:]
    last[edge - 1] = ink[edge - 1]
    end = np.flatnonzero(last) + 1
    return span_hashes(raw, start, end), start, np.searchsorted(at, start, side="right") - 1

