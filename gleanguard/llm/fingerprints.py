"""Document fingerprints from closed syncmers.

A k-mer of code points is an anchor when its smallest inner s-mer (by hash) is its first or its last. That
depends on the k-mer alone, so equal passages have equal anchors wherever they stand.

A fingerprint holds the SKETCH smallest different hashes of the anchors and the place where each is met first. In
hexadecimal: two digits for the unit of places (2 to this power code points, so that a place takes a byte), eight for
each hash, ascending, two for each place in the same order. The likeness of two fingerprints is the share, among the
SKETCH smallest hashes of both, of those that are common and match by position: another common one must lie as much
further on in the other text, give or take TOLERANCE units (of a text's 128 to 256). So passages count and a lone
k-mer does not, but where a text has no second anchor. It estimates the Jaccard likeness of the anchor sets. A text
too short to have an anchor, as some of up to 22 code points are, is one by itself; an empty text has the empty fingerprint, which is like itself (1) and unlike all
others (0).
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator
from typing import NamedTuple

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from gleanguard.llm.common import batch_of, bounded_batches, documents, ranged, rows_of, settled

K, S = 16, 8
SKETCH = 64
#: Units of the longer text by which the diagonals of a matching passage may differ.
TOLERANCE = 4
_B = np.uint64(0x9E3779B97F4A7C15)
_RESULT = "doc_id long, n_chars long, edited_sha256 binary, fingerprint binary, edited_fingerprint binary, near_edited double, near_next double"
_OUT = pa.schema([("doc_id", pa.int64()), ("n_chars", pa.int64()), ("edited_sha256", pa.binary()), ("fingerprint", pa.binary()), ("edited_fingerprint", pa.binary()), ("near_edited", pa.float64()), ("near_next", pa.float64()), ("kind", pa.string()), ("part", pa.int64()), ("text", pa.string())])


def _mixed(h: np.ndarray) -> np.ndarray:
    h = (h ^ (h >> np.uint64(33))) * np.uint64(0xFF51AFD7ED558CCD)
    h = (h ^ (h >> np.uint64(33))) * np.uint64(0xC4CEB9FE1A85EC53)
    return h ^ (h >> np.uint64(33))


def _rolled(codes: np.ndarray, n: int) -> np.ndarray:
    """A polynomial value of each n code points in a row; n is a power of two."""
    out, base, width = codes, _B, 1
    while width < n:
        out = out[:-width] * base + out[width:]
        base, width = base * base, width * 2
    return out


def sliding_min(values: np.ndarray, n: int) -> np.ndarray:
    out, width = values, 1
    while width * 2 <= n:
        out = np.minimum(out[:-width], out[width:])
        width *= 2
    return out if width == n else np.minimum(out[: len(values) - n + 1], out[n - width : n - width + len(values) - n + 1])


def anchors(text: str, k: int = K, s: int = S) -> tuple[np.ndarray, np.ndarray]:
    """Places (in code points) and 64-bit hashes of the text's closed syncmers; s and k = 2 s are powers of two."""
    codes = np.frombuffer(text.encode("utf-32-le", "surrogatepass"), "<u4").astype(np.uint64)
    if not len(codes):
        return np.zeros(0, np.int64), np.zeros(0, np.uint64)
    with np.errstate(over="ignore"):
        if len(codes) >= k:
            inner = _rolled(codes + np.uint64(1), s)
            ranks = _mixed(inner)
            least = sliding_min(ranks, k - s + 1)
            last = ranks[k - s :]
            at = np.nonzero((least == ranks[: len(least)]) | (least == last))[0]
            if len(at):
                return at, _mixed(inner[at] * np.uint64(0xD6E8FEB86659FD93) + inner[at + s])
        return np.zeros(1, np.int64), _mixed(np.array([int.from_bytes(hashlib.blake2b(text.encode("utf-8", "surrogatepass"), digest_size=8).digest(), "little")], np.uint64))


class Sketch(NamedTuple):
    """The smallest different 32-bit hashes of a text's anchors, ascending, and each one's first place in units of
    2 ** unit code points."""

    hashes: np.ndarray
    places: np.ndarray
    unit: int


def sketch(text: str, size: int = SKETCH) -> Sketch:
    at, hashes = anchors(text)
    hashes, unit = (hashes >> np.uint64(32)).astype(np.uint32), max(0, len(text).bit_length() - 8)
    if len(hashes) > 16 * size:
        low = np.sort(np.argpartition(hashes, 4 * size)[: 4 * size])
        found, first = np.unique(hashes[low], return_index=True)
        if len(found) > size:  # all below the last of them are whole
            return Sketch(found[:size], (at[low[first[:size]]] >> unit).astype(np.uint8), unit)
    found, first = np.unique(hashes, return_index=True)
    return Sketch(found[:size], (at[first[:size]] >> unit).astype(np.uint8), unit)


def packed(found: Sketch) -> bytes:
    """A sketch as bytes; printed in hexadecimal it is the fingerprint."""
    return bytes([found.unit]) + found.hashes.astype(">u4").tobytes() + found.places.tobytes() if len(found.hashes) else b""


def likeness(a: Sketch, b: Sketch, size: int = SKETCH) -> float:
    """Common hashes that match by position among the smallest `size` of both sketches' union; two empty ones are alike."""
    if not len(a.hashes) or not len(b.hashes):
        return float(len(a.hashes) == len(b.hashes))
    both = np.concatenate((a.hashes, b.hashes))
    order = np.argsort(both, kind="stable")
    both = both[order]
    twice = both[1:] == both[:-1]
    rank = np.cumsum(np.append(True, ~twice))
    n = min(size, int(rank[-1]))
    common = np.nonzero(twice & (rank[1:] <= n))[0]
    if len(common) < 2:
        return len(common) / n if min(len(a.hashes), len(b.hashes)) == 1 else 0.0
    here, there = a.places[order[common]].astype(np.int64) << a.unit, b.places[order[common + 1] - len(a.hashes)].astype(np.int64) << b.unit
    close = np.diff(np.sort(there - here)) <= TOLERANCE << max(a.unit, b.unit)
    return int(np.count_nonzero(np.append(close, False) | np.append(False, close))) / n


def edited_text(text: str, following: str) -> str:
    half = len(text) // 2
    return text[: len(text) - half] + following[:half]


def _row(doc_id, text: str, own: Sketch, following: str, next_sketch: Sketch) -> tuple:
    edited = edited_text(text, following)
    other = sketch(edited)
    return doc_id, len(text), hashlib.sha256(edited.encode()).digest(), packed(own), packed(other), likeness(own, other), likeness(own, next_sketch)


def fingerprint_documents(df: DataFrame, is_scan: bool = False) -> DataFrame:
    """For every row of (doc_id, text) its fingerprint, that of its edited text, and likenesses (see op2_fingerprints).

    The next document is the one with the next smaller doc_id, after the last the first; null ids come last, rows
    with equal ids follow in the order that common.ranged gives (is_scan: df reads Parquet files as they are), and a
    table of one row has that row as its next; an empty table gives no rows. A null text counts as empty; a long text is
    looked through whole. Other columns are not read.

    Each task holds one range of ids in descending order and one document at a time. The last document of a
    range meets the first of the following one in a second step over two rows for each range.
    """
    spark = df.sparkSession
    bounded_batches(spark)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        part = TaskContext.get().partitionId()
        before = None
        for batch in batches:
            out = []
            for doc_id, text in rows_of([batch], "doc_id", "text"):
                text = text or ""
                own = sketch(text)
                if before is None:
                    out.append((doc_id, *[None] * 6, "first", part, text))
                else:
                    out.append((*_row(*before, text, own), "done", part, None))
                before = doc_id, text, own
            if out:
                yield batch_of(_OUT, list(zip(*out, strict=True)))
        if before:
            yield batch_of(_OUT, [[x] for x in (before[0], *[None] * 6, "last", part, before[1])])

    def meet(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows = [_row(i, t, sketch(t), f, sketch(f)) for i, t, f in rows_of([batch], "doc_id", "text", "following")]
            if rows:
                yield batch_of(pa.schema(list(_OUT)[:7]), list(zip(*rows, strict=True)))

    made = settled(ranged(df, is_scan, descending=True).mapInArrow(run, f"{_RESULT}, kind string, part long, text string"), "fingerprints")
    parts = sorted(r[0] for r in made.where("kind = 'first'").select("part").collect())
    follows = spark.createDataFrame([(p, parts[(k + 1) % len(parts)]) for k, p in enumerate(parts)], "part long, after long")
    first = made.where("kind = 'first'").select(F.col("part").alias("after"), F.col("text").alias("following"))
    pairs = made.where("kind = 'last'").select("doc_id", "text", "part").join(follows, "part").join(first, "after")
    ends = pairs.select("doc_id", "text", "following").mapInArrow(meet, _RESULT)
    both = made.where("kind = 'done'").drop("kind", "part", "text").unionByName(ends)
    return both.withColumns({c: F.lower(F.hex(c)) for c in ("edited_sha256", "fingerprint", "edited_fingerprint")})


def op2_fingerprints(spark: SparkSession, sf_dir: str) -> DataFrame:
    return fingerprint_documents(documents(spark, sf_dir), is_scan=True)
