"""Token ids in length-delimited binary records.

A record is: payload length (unsigned 64-bit), masked checksum of those 8 bytes (unsigned 32-bit),
payload, masked checksum of the payload.  All numbers are little-endian.  The checksum is CRC-32 as
zlib has it, masked by rotating right by 15 bits and adding a constant, so that checksums of data that
hold checksums stay useful.  The payload is the document's id (signed 64-bit, and a flag byte that is 1
for a null id) and its token ids, 2 bytes each where the vocabulary has at most 65536 ids, else 4.

Each data file `part-N.rec` has an index file `part-N.idx`: for each record its offset and the number
of ids, 8 bytes each, so that any record can be read alone, in any order.
"""

from __future__ import annotations

import struct
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.fs as pafs
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from spindrift.llm._shared import bounded, need
from spindrift.llm.tokens import encoder

MASK = 0xA282EAD8
_HEAD = "<QI"
_HEAD_SIZE = struct.calcsize(_HEAD)
_ID = "<qB"
_ID_SIZE = struct.calcsize(_ID)
#: Bytes of text in a shard, at most about.
SHARD_BYTES = 256 << 20
_INDEX = np.dtype([("offset", "<u8"), ("ids", "<u8")])


def masked(data: bytes) -> int:
    c = zlib.crc32(data)
    return ((c >> 15 | c << 17) + MASK) & 0xFFFFFFFF


def frame(payload: bytes) -> bytes:
    size = struct.pack("<Q", len(payload))
    return b"".join((size, struct.pack("<I", masked(size)), payload, struct.pack("<I", masked(payload))))


def read_record(f) -> bytes | None:
    """The next payload, or None at the end; a damaged record raises."""
    head = f.read(_HEAD_SIZE)
    if not head:
        return None
    if len(head) < _HEAD_SIZE:
        raise ValueError("the file ends within a record's head")
    size, check = struct.unpack(_HEAD, head)
    if masked(head[:8]) != check:
        raise ValueError("a record's length is damaged")
    payload, tail = f.read(size), f.read(4)
    if len(payload) < size or len(tail) < 4:
        raise ValueError("the file ends within a record")
    if masked(payload) != struct.unpack("<I", tail)[0]:
        raise ValueError("a record's payload is damaged")
    return payload


def _fs(uri: str) -> tuple[pafs.FileSystem, str]:
    """The file system of a path, as Hadoop writes it: file:/x, hdfs://host/x, or a plain path."""
    if uri.startswith("file:"):
        return pafs.LocalFileSystem(), "/" + uri[5:].lstrip("/")
    return pafs.FileSystem.from_uri(uri)


def _vocabulary_width(path: str) -> int:
    return 2 if encoder(path).library.get_vocab_size(with_added_tokens=True) <= 1 << 16 else 4


def write_records(docs: DataFrame, place: str, vocabulary: str, end_id: int, partitions: int | None = None, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Encode every whole text, append end_id, write records in ascending id order; return the manifest.

    The manifest has a row per file: shard, path, n_records, n_ids.  Shards follow each other in id order,
    null ids first; equal ids are ordered by text.  A shard has about SHARD_BYTES of text at most, unless `partitions` says how many there are.  Null text counts as empty: its record holds end_id
    only.  An empty table gives no file.  A task that runs again writes the same bytes, under a name of
    its own that is moved into place when whole, so lost executors and speculation do no harm.
    """
    if docs.schema[id_col].dataType.simpleString() not in ("bigint", "int", "smallint", "tinyint"):
        raise ValueError("integer ids are needed")
    rows = need(docs, id_col, text_col).select(F.col(f"`{id_col}`").cast("bigint").alias("doc_id"), F.coalesce(F.col(f"`{text_col}`").cast("binary"), F.lit(b"")).alias("raw"))
    n = partitions or max(int(docs.sparkSession.conf.get("spark.sql.shuffle.partitions")), -(-(rows.agg(F.sum(F.octet_length("raw"))).first()[0] or 0) // SHARD_BYTES))
    rows = rows.repartitionByRange(n, F.col("doc_id").asc_nulls_first(), F.xxhash64("raw")).sortWithinPartitions(F.col("doc_id").asc_nulls_first(), "raw")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        tokens, width, fs = None, 0, None
        context = TaskContext.get()
        shard, attempt = context.partitionId(), context.taskAttemptId()
        offset = total = records = 0
        for b in bounded(batches, "raw"):
            if fs is None:
                tokens, width = encoder(vocabulary), _vocabulary_width(vocabulary)
                fs, folder = _fs(place)
                fs.create_dir(folder, recursive=True)
                part = f"{folder}/.{shard:06d}-{attempt}"
                out, places = fs.open_output_stream(f"{part}.rec"), fs.open_output_stream(f"{part}.idx")
            end = np.array([end_id], f"<u{width}").tobytes()
            index: list[tuple[int, int]] = []  # of one batch
            for doc, raw in zip(b.column(0).to_pylist(), b.column(1).to_pylist()):
                ids = tokens.ids(raw)
                if width == 2:
                    ids = np.frombuffer(ids, "<u4").astype("<u2").tobytes()
                record = frame(struct.pack(_ID, doc or 0, doc is None) + ids + end)
                out.write(record)
                index.append((offset, len(ids) // width + 1))
                offset += len(record)
                total += index[-1][1]
            places.write(np.array(index, _INDEX).tobytes())
            records += len(index)
        if fs is not None:
            out.close()
            places.close()
            for kind in ("idx", "rec"):
                fs.move(f"{part}.{kind}", f"{folder}/part-{shard:06d}.{kind}")
            yield pa.RecordBatch.from_pydict({"shard": pa.array([shard], pa.int32()), "path": [f"{place}/part-{shard:06d}"], "n_records": [records], "n_ids": [total], "width": pa.array([width], pa.int32())})

    return rows.mapInArrow(run, "shard int, path string, n_records bigint, n_ids bigint, width int")


def read_one(path: str, width: int, k: int) -> tuple[int | None, np.ndarray]:
    """Record k of a file, by its index: a shuffled read."""
    fs, at = _fs(path)
    with fs.open_input_file(f"{at}.idx") as f:
        f.seek(k * _INDEX.itemsize)
        offset = int(np.frombuffer(f.read(_INDEX.itemsize), _INDEX)["offset"][0])
    with fs.open_input_file(f"{at}.rec") as f:
        f.seek(offset)
        payload = read_record(f)
    doc, null = struct.unpack_from(_ID, payload)
    return None if null else doc, np.frombuffer(payload, f"<u{width}", offset=_ID_SIZE)


def read_records(spark: SparkSession, manifest: DataFrame, with_ids: bool = True) -> DataFrame:
    """Rows of the files: doc_id, start (ids in all records before), n_tokens, ids_crc32 and, if asked for, ids.

    Every length and checksum is verified.  The manifest, a row per file, is all that the driver sees.
    """
    files = [r.asDict() for r in manifest.orderBy("shard").collect()]
    before = 0
    for f in files:
        f["before"] = before
        before += f["n_ids"]
    schema = "shard int, path string, n_records bigint, n_ids bigint, width int, before bigint"
    table = spark.createDataFrame([tuple(f[c.split()[0]] for c in schema.split(", ")) for f in files], schema)
    table = table.repartition(max(1, len(files)), "shard") if files else table

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for f in b.to_pylist():
                fs, at = _fs(f["path"])
                with fs.open_input_file(f"{at}.idx") as s:
                    index = np.frombuffer(s.read(), _INDEX)
                start, kept, n = f["before"], [], 0
                with fs.open_input_stream(f"{at}.rec", buffer_size=1 << 20) as s:
                    while (payload := read_record(s)) is not None:
                        doc, null = struct.unpack_from(_ID, payload)
                        ids = np.frombuffer(payload, f"<u{f['width']}", offset=_ID_SIZE).astype("<u4")
                        if len(ids) != index["ids"][n]:
                            raise ValueError("index and records differ")
                        kept.append((None if null else doc, start, len(ids), zlib.crc32(ids.tobytes()), ids if with_ids else None))
                        start += len(ids)
                        n += 1
                        if len(kept) >= 4096 or with_ids and start - kept[0][1] > 1 << 22:
                            yield _rows(kept, with_ids)
                            kept = []
                if n != f["n_records"] or start - f["before"] != f["n_ids"]:
                    raise ValueError("records are missing")
                if kept:
                    yield _rows(kept, with_ids)

    return table.mapInArrow(run, "doc_id bigint, start bigint, n_tokens bigint, ids_crc32 bigint" + ", ids array<bigint>" * with_ids)


def _rows(kept: list[tuple], with_ids: bool) -> pa.RecordBatch:
    columns = {k: pa.array([r[i] for r in kept], pa.int64()) for i, k in enumerate(("doc_id", "start", "n_tokens", "ids_crc32"))}
    if with_ids:
        columns["ids"] = pa.array([r[4].astype(np.int64) for r in kept], pa.list_(pa.int64()))
    return pa.RecordBatch.from_pydict(columns)
