"""Removal of repeated passages by ranks of doubled length.

A string of LENGTH bytes that starts at two places or more, in one text or several, is repeated; each byte that a
repeated string covers goes. Ranks stand for strings of equal length: equal strings have equal ranks. The rank of
2 h bytes comes from the pair of ranks of h bytes at a place and h further on, up to STEP bytes within the task that
holds the text; that of any length between STEP and 2 STEP is the pair of ranks at both ends. Spark then groups
places by ranks of growing length and drops them once their rank is unique:

1. Each window of LENGTH bytes has an anchor, the leftmost of the least ranks of GRAM bytes in it. Equal windows have
   equal anchors at equal offsets, so only windows whose anchor's rank occurs twice go on. Neighbouring windows with
   one anchor form a run, one row.
2. Runs are ranked by the whole string under them. Runs of equal rank are repeated altogether; one of them goes on
   for all. An anchor's runs that are all equal are done.
3. A run's windows are dealt by their offset from the anchor to blocks of BLOCK. The string that all windows of a
   block share (LENGTH - BLOCK + 1 bytes) is ranked: where it is unique, no window of the block is repeated. Where
   the string under the whole block is repeated, all are.
4. The windows of blocks that are left are ranked by themselves.

Places are known by the file that holds a row and the row's number in it, which stay the same however a scan is cut
into tasks. Marks come back to the scan's tasks as small files, one for each chunk of a file's rows, and no text is
ever shuffled. A run that is equal in a third of all texts is one row after step 2's map-side sums.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.fs as pafs
import pyarrow.parquet as pq
from pyspark import Broadcast
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from gleanguard.llm.common import batch_of, bounded_batches, documents, fresh, opened, placed, rows_of, scratch, settled, slices
from gleanguard.llm.tokens import forget

LENGTH, GRAM, STEP, BLOCK = 200, 32, 128, 16
#: Rows of a file, as a power of two, whose marks lie together.
CHUNK = 11
#: Bytes of one text that are ranked together.
SLICE = 4 << 20
#: Lengths at which ranks are folded before they are doubled again.
MIXED_AT = (8, 32)
_BASE = np.uint64(0x9E3779B97F4A7C15)
_U = np.uint64
_RUNS = pa.schema([("anchor", pa.int64()), ("whole", pa.int64()), ("place", pa.int64()), ("start", pa.int64()), ("span", pa.int64())])
_RUNS_DDL = "anchor long, whole long, place long, start long, span long"
_BYTES = pa.schema([("anchor", pa.int64()), ("whole", pa.int64()), ("span", pa.int64()), ("raw", pa.binary())])


def _mixed(h: np.ndarray) -> np.ndarray:
    h = (h ^ (h >> _U(33))) * _U(0xFF51AFD7ED558CCD)
    h = (h ^ (h >> _U(33))) * _U(0xC4CEB9FE1A85EC53)
    return h ^ (h >> _U(33))


def doubled(raw: np.ndarray, *lengths: int) -> list[np.ndarray]:
    """Ranks of all strings of each length (a power of two), doubling from single bytes on."""
    ranks, base, h, out = raw.astype(np.uint64) + _U(1), _BASE, 1, {}
    while True:
        if h in lengths:
            out[h] = ranks
        if h >= max(lengths):
            return [out[n] for n in lengths]
        if h in MIXED_AT:  # else sums of periodic strings would agree in their low bits
            ranks = ranks ^ (ranks >> _U(32))
        ranks = ranks[:-h] * base + ranks[h:] if len(ranks) > h else ranks[:0]
        with np.errstate(over="ignore"):
            base = base * base
        h *= 2


def sliding_min(values: np.ndarray, n: int) -> np.ndarray:
    out, width = values, 1
    while width * 2 <= n:
        out = np.minimum(out[:-width], out[width:])
        width *= 2
    return out if width == n else np.minimum(out[: len(values) - n + 1], out[n - width : len(values) - width + 1])


def _signed(x: np.ndarray) -> np.ndarray:
    return x.view(np.int64)


def runs(raw: bytes) -> tuple[np.ndarray, ...]:
    """Of a text: each run's anchor rank, rank of the whole string under it, first window, and span.

    span holds the number of windows and how far before the anchor the first window starts: windows << 16 | offset.
    """
    parts = []
    for begun in range(0, max(1, len(raw) - LENGTH + 1), SLICE):
        data = np.frombuffer(raw[begun : begun + SLICE + LENGTH - 1], np.uint8)
        if len(data) < LENGTH:
            break
        gram, step = doubled(data, GRAM, STEP)
        key = _mixed(gram)
        places = np.arange(len(key), dtype=np.uint64)
        least = sliding_min((key & ~_U(0xFFFFFF)) | places, LENGTH - GRAM + 1)
        at = (least & _U(0xFFFFFF)).astype(np.int64)
        first = np.nonzero(np.append(True, at[1:] != at[:-1]))[0]
        count = np.diff(np.append(first, len(at)))
        anchor = at[first]
        length = count + LENGTH - 1
        span = count << 16 | (anchor - first)
        whole = _mixed(_mixed(_mixed(step[first]) + step[np.minimum(first + STEP, first + length - STEP)]) + step[first + length - STEP] + _U(7) * span.astype(np.uint64))
        parts.append((_signed(key[anchor]), _signed(whole), first + begun, span))
    if not parts:
        return tuple(np.zeros(0, np.int64) for _ in range(4))
    return tuple(np.concatenate(x) for x in zip(*parts, strict=True))


def block_ranks(raw: bytes, span: int) -> Iterator[tuple[int, int, int | None]]:
    """(block, rank of what its windows share, rank of the string under it or None where the run lacks some of it)."""
    count, before = span >> 16, span & 0xFFFF
    step = doubled(np.frombuffer(raw, np.uint8), STEP)[0]
    low = before - count + 1  # offsets of windows before the anchor run from low to before
    shared, under = LENGTH - BLOCK + 1, LENGTH + BLOCK - 1
    blocks = np.arange(low // BLOCK, before // BLOCK + 1)
    inner = before - blocks * BLOCK  # where in raw the window of a block's least offset starts
    core = _signed(_mixed(_mixed(step[inner]) + step[inner + shared - STEP]))
    outer = inner - BLOCK + 1
    full = (outer >= 0) & (blocks * BLOCK >= low)
    hull = _signed(_mixed(_mixed(step[np.maximum(outer, 0)]) + step[np.where(full, outer + under - STEP, 0)]))
    yield from zip(blocks.tolist(), core.tolist(), [h if f else None for h, f in zip(hull.tolist(), full.tolist(), strict=True)], strict=True)


def window_ranks(raw: bytes, span: int, block: int) -> list[tuple[int, int]]:
    """(offset before the anchor, rank) of the block's windows in the run."""
    count, before = span >> 16, span & 0xFFFF
    step = doubled(np.frombuffer(raw, np.uint8), STEP)[0]
    offsets = np.arange(max(before - count + 1, block * BLOCK), min(before, block * BLOCK + BLOCK - 1) + 1)
    at = before - offsets
    return list(zip(offsets.tolist(), _signed(_mixed(_mixed(step[at]) + step[at + LENGTH - STEP])).tolist(), strict=True))


def _placed(df: DataFrame, is_scan: bool) -> tuple[DataFrame, Broadcast, tuple[str, str]]:
    """df and where each of its rows lies (file, row), the files' numbers, and the two columns' names.

    A pass that meets another file than the first one did, or one that has changed, stops. The driver holds one number
    for each file, less than its own listing of them.
    """
    names = tuple(fresh(df, "_file", "_row"))
    df, file, row = placed(df, is_scan)
    files = sorted(r[0] for r in df.select(file.alias("file")).distinct().collect())
    return df.select("*", file.alias(names[0]), row.alias(names[1])), df.sparkSession.sparkContext.broadcast({f: k << 32 for k, f in enumerate(files)}), names


def _numbered(batches: Iterator[pa.RecordBatch], numbers: Broadcast, names: tuple[str, str]) -> Iterator[tuple[pa.RecordBatch, np.ndarray]]:
    """Parts of each batch without the two columns, and their rows' places: number of the file << 32 | row in the file."""
    of = numbers.value
    for batch in slices(batches, "text", nulls=True):
        try:
            places = np.array([of[f] for f in batch.column(names[0]).to_pylist()], np.int64) + batch.column(names[1]).to_numpy()
        except KeyError:
            raise ValueError("a file has changed since it was first read") from None
        yield batch.select([n for n in batch.schema.names if n not in names]), places


class _Side:
    """The rows of a side table, ordered by place, for one chunk of places after another."""

    def __init__(self, path: str, names: list[str]):
        self.path, self.names, self.chunk, self.rows = path, names, None, {}

    def of(self, place: int) -> tuple[dict[str, np.ndarray], int, int]:
        """Columns, and from where to where in them the place's rows are."""
        if place >> CHUNK != self.chunk:
            self.chunk = place >> CHUNK
            rows = self._read()
            order = np.argsort(rows["place"], kind="stable")
            self.rows = {k: v[order] for k, v in rows.items()}
        first, last = np.searchsorted(self.rows["place"], [place, place + 1])
        return self.rows, int(first), int(last)

    def _read(self) -> dict[str, np.ndarray]:
        fs, base = opened(f"{self.path}/chunk={self.chunk}")
        if fs.get_file_info(base).type == pafs.FileType.NotFound:
            return {n: np.zeros(0, np.int64) for n in self.names}
        files = [f.path for f in fs.get_file_info(pafs.FileSelector(base)) if f.path.endswith(".parquet")]
        tables = []
        for f in sorted(files):
            with fs.open_input_file(f) as source:
                tables.append(pq.ParquetFile(source).read(columns=self.names))
        table = pa.concat_tables(tables)
        return {n: table.column(n).to_numpy() for n in self.names}


def _write_side(df: DataFrame, name: str) -> str:
    """Rows with a place, written in a folder for each chunk of places."""
    path = scratch(df.sparkSession, name)
    df.withColumn("chunk", F.shiftright("place", CHUNK)).repartition("chunk").write.partitionBy("chunk").parquet(path)
    return path


def _marks(texts: DataFrame, numbers: Broadcast, names: tuple[str, str]) -> DataFrame:
    """(place, start, windows): runs of repeated windows of the scan's rows."""

    def find_runs(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        forget()
        for batch, places in _numbered(batches, numbers, names):
            found = [(p, runs(t.encode())) for p, t in zip(places.tolist(), batch.column("text").to_pylist(), strict=True) if t]
            found = [(p, r) for p, r in found if len(r[0])]
            if found:
                cols = [np.concatenate([r[c] for _, r in found]) for c in range(4)]
                places = np.concatenate([np.full(len(r[0]), p) for p, r in found])
                out = batch_of(_RUNS, [cols[0], cols[1], places, cols[2], cols[3]])
                for k in range(0, out.num_rows, 50_000):
                    yield out.slice(k, 50_000)

    found = texts.mapInArrow(find_runs, _RUNS_DDL)
    twice = settled(found.groupBy("anchor").agg(F.count("*").alias("n")).where("n > 1").select("anchor"), "anchors")
    met = settled(found.join(twice, "anchor"), "runs")
    one = F.min(F.struct("place", "start", "span")).alias("one")
    classes = settled(met.groupBy("anchor", "whole").agg(F.count("*").alias("n"), one), "classes")
    whole = met.join(classes.where("n > 1").select("anchor", "whole"), ["anchor", "whole"]).select("place", "start", F.shiftright("span", 16).alias("windows"))
    mixed = classes.groupBy("anchor").agg(F.count("*").alias("kinds")).where("kinds > 1").select("anchor")
    reps = classes.join(settled(mixed, "mixed"), "anchor").select("anchor", "whole", "one.place", "one.start", "one.span")
    wanted = _write_side(reps, "wanted")

    def take_bytes(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        side = _Side(wanted, ["place", "anchor", "whole", "start", "span"])
        for batch, places in _numbered(batches, numbers, names):
            out, texts_ = [], batch.column("text")
            for row, place in enumerate(places.tolist()):
                own, first, last = side.of(place)
                raw = texts_[row].as_py().encode() if last > first else b""
                for k in range(first, last):
                    start, span = int(own["start"][k]), int(own["span"][k])
                    out.append((int(own["anchor"][k]), int(own["whole"][k]), span, raw[start : start + (span >> 16) + LENGTH - 1]))
            for k in range(0, len(out), 10_000):
                yield batch_of(_BYTES, list(zip(*out[k : k + 10_000], strict=True)))

    strings = settled(texts.mapInArrow(take_bytes, "anchor long, whole long, span long, raw binary"), "strings")

    def to_blocks(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows = [(a, w, b, c, h) for a, w, s, raw in rows_of([batch], "anchor", "whole", "span", "raw") for b, c, h in block_ranks(raw, s)]
            if rows:
                yield pa.RecordBatch.from_arrays([pa.array(c, pa.int64()) for c in zip(*rows, strict=True)], names=["anchor", "whole", "block", "core", "hull"])

    blocks = settled(strings.mapInArrow(to_blocks, "anchor long, whole long, block long, core long, hull long"), "blocks")
    core = ["anchor", "block", "core"]
    # blocks of which the run lacks some count as different from all others
    kinds = settled(blocks.groupBy(*core, F.coalesce("hull", "whole").alias("kind"), F.col("hull").isNull().alias("part")).agg(F.count("*").alias("n"), F.min("whole").alias("whole")), "kinds")
    shared = settled(kinds.groupBy(*core).agg(F.count("*").alias("kinds")).where("kinds > 1").select(*core), "shared")
    single = classes.where("n = 1").select("anchor", "whole", "one")
    again = kinds.where("n > 1").select("anchor", "block", F.col("kind").alias("hull"))
    done = blocks.join(settled(again, "again"), ["anchor", "block", "hull"]).join(single, ["anchor", "whole"])
    offset = F.col("one.span").bitwiseAND(0xFFFF)
    block_start = (F.col("one.start") + offset - F.col("block") * BLOCK - (BLOCK - 1)).alias("start")
    done = done.select("one.place", block_start, F.lit(BLOCK).cast("long").alias("windows"))
    left = kinds.join(shared, core).select("anchor", "whole", "block", (F.col("n") == 1).alias("open"))

    def to_windows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows = [(a, w, t, r, o) for a, w, s, raw, b, o in rows_of([batch], "anchor", "whole", "span", "raw", "block", "open") for t, r in window_ranks(raw, s, b)]
            if rows:
                *numbers, flags = zip(*rows, strict=True)
                yield pa.RecordBatch.from_arrays([*(pa.array(c, pa.int64()) for c in numbers), pa.array(flags, pa.bool_())], names=["anchor", "whole", "offset", "rank", "open"])

    windows = settled(strings.join(left, ["anchor", "whole"]).mapInArrow(to_windows, "anchor long, whole long, offset long, rank long, open boolean"), "windows")
    key = ["anchor", "offset", "rank"]
    repeated = settled(windows.groupBy(*key).agg(F.count("*").alias("n")).where("n > 1").select(*key), "repeated")
    last = windows.where("open").join(repeated, key).join(single, ["anchor", "whole"])
    last = last.select("one.place", (F.col("one.start") + offset - F.col("offset")).alias("start"), F.lit(1).cast("long").alias("windows"))
    return whole.unionByName(done).unionByName(last)


def covered(size: int, starts: np.ndarray, windows: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Starts and ends of the maximal runs of bytes that the windows cover."""
    order = np.argsort(starts, kind="stable")
    starts, ends = starts[order], np.maximum.accumulate((starts + windows + LENGTH - 1)[order])
    if len(ends) and (ends[-1] > size or starts[0] < 0):
        raise ValueError("the scan's rows are not those that were marked")
    fresh = np.append(True, starts[1:] > ends[:-1])
    return starts[fresh], ends[np.append(np.nonzero(fresh)[0][1:] - 1, len(ends) - 1)]


def _with_spans(df: DataFrame, is_scan: bool, work, schema: str) -> DataFrame:
    """work(rows, spans of each row) over the scan, the marks beside it."""
    texts, numbers, names = _placed(df, is_scan)
    marks = _write_side(_marks(texts.select("text", *names), numbers, names), "marks")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        side = _Side(marks, ["place", "start", "windows"])
        for batch, places in _numbered(batches, numbers, names):
            rows, spans = list(rows_of([batch], "doc_id", "text")), []
            for row, place in zip(rows, places.tolist(), strict=True):
                own, a, b = side.of(place)
                raw = (row[1] or "").encode()
                spans.append((raw, *(covered(len(raw), own["start"][a:b], own["windows"][a:b]) if b > a else (None, None))))
            yield work(batch, rows, spans)

    return texts.mapInArrow(run, schema)


def _kept(raw: bytes, starts, ends) -> bytes:
    if starts is None:
        return raw
    parts, at = [], 0
    for s, e in zip(starts.tolist(), ends.tolist(), strict=True):
        parts.append(raw[at:s])
        at = e
    return b"".join([*parts, raw[at:]])


def repeated_passages(df: DataFrame, is_scan: bool = False) -> DataFrame:
    """(doc_id, n_bytes, n_removed, n_spans, kept_sha256) for every row of (doc_id, text).

    A null text counts as empty. Rows that repeat, and copies of a text, lose all that is LENGTH bytes or longer;
    a shorter text loses nothing. Matches never cross texts; a long text is ranked in slices that overlap by a window,
    so none is missed. An empty table gives no rows. Ids play no part, so null and repeated ones are rows like others.
    is_scan says that df reads Parquet files as they are, whose rows have places of their own; any other df is written
    as a table first. Other columns are not read.
    """
    bounded_batches(df.sparkSession)
    out = pa.schema([("doc_id", pa.int64()), ("n_bytes", pa.int64()), ("n_removed", pa.int64()), ("n_spans", pa.int64()), ("kept_sha256", pa.string())])

    def work(batch, rows, spans):
        kept = [_kept(*s) for s in spans]
        return batch_of(out, [[r[0] for r in rows], [len(s[0]) for s in spans], [len(s[0]) - len(k) for s, k in zip(spans, kept, strict=True)], [0 if s[1] is None else len(s[1]) for s in spans], [hashlib.sha256(k).hexdigest() for k in kept]])

    return _with_spans(df.select("doc_id", "text"), is_scan, work, "doc_id long, n_bytes long, n_removed long, n_spans long, kept_sha256 string")


def drop_repeated_passages(df: DataFrame, is_scan: bool = False) -> DataFrame:
    """The rows of df, all columns, their texts without repeated passages; n_chars, where there is one, counts anew.

    A character of which only some bytes are covered stays. A text that nothing is removed from stays as it is,
    null included; one that is covered altogether becomes empty and its row stays. Columns may have any names beside
    doc_id and text. See repeated_passages.
    """
    bounded_batches(df.sparkSession)
    rest = [c for c in df.columns if c not in ("doc_id", "text")]
    texts = df.select("doc_id", "text", *rest)

    def work(batch, rows, spans):
        new = []
        for row, (raw, starts, ends) in zip(rows, spans, strict=True):
            if starts is None:
                new.append(row[1])
                continue
            whole = lambda k: k < len(raw) and (raw[k] & 0xC0) == 0x80
            trimmed = []
            for s, e in zip(starts.tolist(), ends.tolist(), strict=True):
                while whole(s):
                    s += 1
                while whole(e):
                    e -= 1
                trimmed.append((s, e))
            s, e = (np.array(x) for x in zip(*trimmed, strict=True))
            new.append(_kept(raw, s, e).decode())
        columns = {n: batch.column(n) for n in batch.schema.names}
        columns["text"] = pa.array(new, batch.schema.field("text").type)
        if "n_chars" in columns:
            columns["n_chars"] = pa.array([old if s[1] is None else len(t) for t, old, s in zip(new, columns["n_chars"].to_pylist(), spans, strict=True)], batch.schema.field("n_chars").type)
        return pa.RecordBatch.from_arrays(list(columns.values()), names=list(columns))

    return _with_spans(texts, is_scan, work, texts.schema).select(df.columns)


def op10_suffix_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return repeated_passages(documents(spark, sf_dir), is_scan=True)
