"""Token ids in length-delimited binary records.

A record file is a run of frames: the payload's length (unsigned 64 bits), the masked crc32 of those eight
bytes, the payload, and its masked crc32, all little-endian. A payload is a flag for the id being null, doc_id
(signed 64 bits), the width of an id in bytes, and the ids. Beside each file lies an offset index: for each
record its place in the file, its payload's length and the ids before it in the file (unsigned 64 bits each),
so that records can be read in any order. A file is written under a name of its own attempt and renamed when
whole; a task that is run again writes the same bytes.
"""

from __future__ import annotations

import struct
import uuid
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.fs as pafs
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from gleanguard.llm.common import batch_of, bounded_batches, documents, opened, ranged, rows_of, scratch, slices
from gleanguard.llm.tokens import LibraryIds, once

VOCABULARY = "byte_bpe_50k.json"
END_ID = 2
_HEAD = struct.Struct("<?qB")
_INDEX = np.dtype([("at", "<u8"), ("length", "<u8"), ("before", "<u8")])
_MASK = 0xA282EAD8
#: Bytes that a reader asks for at once.
READ_BYTES = 8 << 20
_FILE = pa.schema([("part", pa.int64()), ("path", pa.string()), ("records", pa.int64()), ("ids", pa.int64())])
_OUT = pa.schema([("doc_id", pa.int64()), ("start", pa.int64()), ("n_tokens", pa.int64()), ("ids_crc32", pa.int64())])


def masked(data: bytes) -> int:
    """crc32 turned and shifted, so that a checksum of data with checksums inside stays a good one."""
    c = zlib.crc32(data)
    return (((c >> 15) | (c << 17)) + _MASK) & 0xFFFFFFFF


def frame(payload: bytes) -> bytes:
    length = struct.pack("<Q", len(payload))
    return b"".join((length, struct.pack("<I", masked(length)), payload, struct.pack("<I", masked(payload))))


def unframe(data: bytes, at: int, length: int) -> bytes:
    """The payload of the frame at a place; raises where a length or checksum doesn't hold."""
    head, payload = data[at : at + 8], data[at + 12 : at + 12 + length]
    sums = struct.unpack_from("<I", data, at + 8) + struct.unpack_from("<I", data, at + 12 + length)
    if struct.unpack("<Q", head)[0] != length or sums != (masked(head), masked(payload)):
        raise ValueError(f"broken record at {at}")
    return payload


def payload_of(doc_id: int | None, ids: np.ndarray, width: int) -> bytes:
    return _HEAD.pack(doc_id is None, doc_id or 0, width) + ids.astype(f"<u{width}").tobytes()


def parse(payload: bytes) -> tuple[int | None, np.ndarray]:
    null, doc_id, width = _HEAD.unpack_from(payload)
    return None if null else doc_id, np.frombuffer(payload, f"<u{width}", offset=_HEAD.size)


def write_records(df: DataFrame, path: str, vocabulary: str = VOCABULARY, end_id: int = END_ID, is_scan: bool = False) -> DataFrame:
    """Writes the ids of (doc_id, text), end_id after each document, below a path that all executors share.

    Files part-N.rec hold ascending ranges of doc_id in ascending N. Returns one row per file (part, path,
    records, ids, start: ids in all files before it); their number is the number of shuffle partitions. Null or
    empty texts have end_id alone; null doc_ids come first; repeated rows are written as often as they occur, rows
    with equal ids in the order that common.ranged gives (is_scan: df reads Parquet files as they are). A long text is one record. An empty table gives no files. Other columns are not read.
    """
    spark = df.sparkSession
    bounded_batches(spark)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        part = TaskContext.get().partitionId()
        encoder = once(LibraryIds, vocabulary)
        width = 2 if max(encoder.tokenizer.get_vocab_size(), end_id + 1) <= 1 << 16 else 4
        fs, base = opened(path)
        fs.create_dir(base, recursive=True)
        name, attempt = f"{base}/part-{part:06d}", uuid.uuid4().hex
        end = np.array([end_id], "<u4").tobytes()
        index, at, before = [], 0, 0
        with fs.open_output_stream(f"{name}.{attempt}.tmp") as out:
            for block in slices(batches, "text"):
                frames = []
                for doc_id, raw in zip(block.column("doc_id").to_pylist(), encoder.ids(block.column("text")), strict=True):
                    ids = np.frombuffer(raw + end, "<u4")
                    payload = payload_of(doc_id, ids, width)
                    frames.append(frame(payload))
                    index.append((at, len(payload), before))
                    at += len(frames[-1])
                    before += len(ids)
                out.write(b"".join(frames))
        with fs.open_output_stream(f"{name}.{attempt}.idx.tmp") as out:
            out.write(np.array(index, _INDEX).tobytes())
        if not index:
            fs.delete_file(f"{name}.{attempt}.tmp")
            fs.delete_file(f"{name}.{attempt}.idx.tmp")
            return
        fs.move(f"{name}.{attempt}.idx.tmp", f"{name}.idx")
        fs.move(f"{name}.{attempt}.tmp", f"{name}.rec")
        yield batch_of(_FILE, [[part], [f"{path}/part-{part:06d}"], [len(index)], [before]])

    written = sorted(ranged(df, is_scan).mapInArrow(run, "part long, path string, records long, ids long").collect())
    starts = np.cumsum([0, *(w["ids"] for w in written)]).tolist()
    rows = [(*w, s) for w, s in zip(written, starts, strict=False)]
    return spark.createDataFrame(rows, "part long, path string, records long, ids long, start long")


def read_index(fs: pafs.FileSystem, name: str) -> np.ndarray:
    with fs.open_input_stream(f"{name}.idx") as f:
        return np.frombuffer(f.read(), _INDEX)


def read_at(fs: pafs.FileSystem, name: str, entries: np.ndarray) -> Iterator[tuple[int | None, np.ndarray, int]]:
    """(doc_id, ids, ids before it in the file) of the index entries, in the order given; neighbours in one read."""
    places = entries.tolist()
    with fs.open_input_file(f"{name}.rec") as f:
        k = 0
        while k < len(places):
            first = end = places[k][0]
            n = k
            while n < len(places) and places[n][0] == end and end - first < READ_BYTES:
                end += places[n][1] + 16
                n += 1
            data = f.read_at(end - first, first)
            for at, length, before in places[k:n]:
                yield *parse(unframe(data, at - first, length)), before
            k = n


def read_records(files: DataFrame) -> DataFrame:
    """(doc_id, start, n_tokens, ids_crc32) of every record of the files that write_records gives, checksums verified."""
    spark = files.sparkSession

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for path, start in rows_of(batches, "path", "start"):
            fs, name = opened(path)
            rows = [(i, start + b, len(ids), zlib.crc32(ids.astype("<u4").tobytes())) for i, ids, b in read_at(fs, name, read_index(fs, name))]
            yield batch_of(_OUT, list(zip(*rows, strict=True)))

    n = max(1, files.count())
    spread = spark.createDataFrame(files.collect(), files.schema).repartitionById(n, F.col("part").cast("int") % n)
    return spread.mapInArrow(run, "doc_id long, start long, n_tokens long, ids_crc32 long")


def op6_records(spark: SparkSession, sf_dir: str) -> DataFrame:
    return read_records(write_records(documents(spark, sf_dir), scratch(spark, "records"), is_scan=True))
