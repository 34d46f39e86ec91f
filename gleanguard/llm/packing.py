"""Order-preserving packing by dynamic programming.

Documents in ascending doc_id order form one stream of ids. Windows of at most `window` ids are cut from it at
document ends or sentence ends. The cost of a cut plan is its padding plus a penalty for each cut inside a
document; f(j) = window - p(j) + penalty(j) + min(f(i) + p(i)) over boundaries i at most a window before j, and
a monotone queue holds the candidates of that sliding minimum, so a boundary costs constant time. Sentences
longer than a part of the window get further boundaries, at a higher penalty.

A task packs one range of doc_id, in blocks of bounded size: of a block's plan all windows but the last are
final, the last one's ids go on to the next block. Only the last window of a range may be much padded.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession

from gleanguard.llm.common import batch_of, bounded_batches, documents, ranged, slices
from gleanguard.llm.tokens import LibraryIds, once

VOCABULARY = "word_bpe_49k.json"
END_ID = 2
WINDOW = 4096
#: In tokens of padding: a cut at a sentence end inside a document, and one inside a sentence.
SENTENCE_PENALTY, INNER_PENALTY = 16, 64
#: Ids that a task plans together.
BLOCK_TOKENS = 1 << 20
SCHEMA = "doc_id long, start long, length long, ids_crc32 long, doc_tokens long, sequence_id long, offset long, padded_length long"
_OUT = pa.schema([(c.split()[0], pa.int64()) for c in SCHEMA.split(", ")])


def sentence_ends(tokenizer) -> np.ndarray:
    """For each id, whether its token ends a sentence."""
    vocab = tokenizer.get_vocab()
    out = np.zeros(max(vocab.values()) + 1, bool)
    out[[i for t, i in vocab.items() if t.removesuffix("</w>").endswith((".", "!", "?"))]] = True
    return out


def boundaries(ids: np.ndarray, doc_ends: np.ndarray, is_end: np.ndarray, window: int) -> tuple[np.ndarray, np.ndarray]:
    """Positions at which a window may end, 0 first, and the penalty of each."""
    inside = ids < len(is_end)
    allowed = np.zeros(len(ids) + 1, bool)
    allowed[1:] = is_end[np.where(inside, ids, 0)] & inside
    allowed[0] = allowed[doc_ends] = True
    places = np.nonzero(allowed)[0]
    gaps, step = np.diff(places), max(1, window // 16)
    wide = np.nonzero(gaps > max(1, window // 8))[0]
    inner = np.concatenate([np.arange(places[k] + step, places[k + 1], step) for k in wide]) if len(wide) else np.zeros(0, np.int64)
    if len(inner):
        allowed[inner] = True
        places = np.nonzero(allowed)[0]
    penalty = np.full(len(places), SENTENCE_PENALTY, np.int64)
    penalty[np.searchsorted(places, inner)] = INNER_PENALTY
    penalty[np.searchsorted(places, doc_ends)] = 0
    return places, penalty


def best_cuts(places: list[int], penalty: list[int], window: int) -> list[int]:
    """Indexes of the boundaries that cheapest windows end at; neighbouring boundaries lie within a window.

    g(j) = f(j) + p(j) = g(i) + window + penalty(j) for the least g(i) among i with p(i) >= p(j) - window.
    """
    n = len(places)
    g, parent, queue, head = [0] * n, [0] * n, [0] * n, 0
    tail = 1
    for j in range(1, n):
        low = places[j] - window
        while places[queue[head]] < low:
            head += 1
        i = queue[head]
        parent[j] = i
        cost = g[j] = g[i] + window + penalty[j]
        while tail > head and g[queue[tail - 1]] > cost:
            tail -= 1
        queue[tail] = j
        tail += 1
    cuts, j = [], n - 1
    while j > 0:
        cuts.append(j)
        j = parent[j]
    return cuts[::-1]


class Packer:
    """Takes documents' ids in order and gives pieces: (doc_id, start, length, crc32, doc_tokens, sequence, offset, padded)."""

    def __init__(self, is_end: np.ndarray, window: int, first_sequence: int, block_tokens: int = BLOCK_TOKENS):
        self.is_end, self.window, self.sequence, self.block = is_end, window, first_sequence, block_tokens
        self.parts: list[bytes] = []
        self.docs: list[tuple] = []  # doc_id, ids before what is held, held, all
        self.held = 0

    def add(self, doc_id, ids: bytes) -> list[tuple]:
        n = len(ids) // 4
        self.parts.append(ids)
        self.docs.append((doc_id, 0, n, n))
        self.held += n
        return self.plan(False) if self.held >= self.block else []

    def plan(self, last: bool) -> list[tuple]:
        if not self.held:
            return []
        raw = b"".join(self.parts)
        ids = np.frombuffer(raw, "<u4")
        ends = np.cumsum([d[2] for d in self.docs])
        places, penalty = boundaries(ids, ends, self.is_end, self.window)
        cuts = places[best_cuts(places.tolist(), penalty.tolist(), self.window)]
        kept = len(cuts) if last else len(cuts) - 1
        if not kept:
            return []
        stop = int(cuts[kept - 1])
        bounds = np.union1d(cuts[:kept], ends[ends <= stop])
        starts = np.concatenate(([0], bounds[:-1])).astype(np.int64)
        doc = np.searchsorted(ends, starts, "right")
        window = np.searchsorted(cuts, starts, "right")
        opened = np.concatenate(([0], cuts))
        size = np.diff(opened)
        out = []
        begun = np.concatenate(([0], ends))
        for s, e, d, w in zip(starts.tolist(), bounds.tolist(), doc.tolist(), window.tolist(), strict=True):
            doc_id, before, _, whole = self.docs[d]
            n = int(size[w])
            padded = n if n & (n - 1) == 0 else self.window
            out.append((doc_id, before + s - int(begun[d]), e - s, zlib.crc32(raw[s * 4 : e * 4]), whole, self.sequence + w, s - int(opened[w]), padded))
        self.sequence += kept
        first = int(np.searchsorted(ends, stop, "right"))
        self.docs = [(i, b + max(0, stop - int(begun[first + k])), h - max(0, stop - int(begun[first + k])), a) for k, (i, b, h, a) in enumerate(self.docs[first:])]
        self.parts = [raw[stop * 4 :]]
        self.held = len(ids) - stop
        return out


def pack(df: DataFrame, vocabulary: str = VOCABULARY, window: int = WINDOW, end_id: int = END_ID, remembered: int = 500_000, is_scan: bool = False) -> DataFrame:
    """Pieces of all documents of (doc_id, text), in sequences of at most `window` ids.

    Each document is its text's ids and end_id, so an empty or null text is end_id alone and no document lacks a
    piece; an empty table gives none. Repeated rows are packed as often as they occur; rows with equal or null ids are
    ordered as common.ranged says (is_scan: df reads Parquet files as they are). A long text is cut over as many
    sequences as it needs. Other columns are not read. sequence_id grows in the documents' order and is not gapless from
    one range to the next; offset is gapless from 0 in each sequence. padded_length is the window, or the sequence's own
    length where that is a power of two. remembered bounds a worker's table of known pieces, at some 400 bytes each.
    """
    spark = df.sparkSession
    bounded_batches(spark)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encoder = once(LibraryIds, vocabulary, remembered)
        packer = Packer(sentence_ends(encoder.tokenizer), window, TaskContext.get().partitionId() << 40)
        end = np.array([end_id], "<u4").tobytes()
        for block in slices(batches, "text"):
            rows = []
            for doc_id, ids in zip(block.column("doc_id").to_pylist(), encoder.ids(block.column("text")), strict=True):
                rows += packer.add(doc_id, ids + end)
            if rows:
                yield batch_of(_OUT, list(zip(*rows, strict=True)))
        if rows := packer.plan(True):
            yield batch_of(_OUT, list(zip(*rows, strict=True)))

    return ranged(df, is_scan).mapInArrow(run, SCHEMA)


def op1_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pack(documents(spark, sf_dir), is_scan=True)
