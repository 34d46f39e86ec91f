"""N-gram Jaccard join by MinHash banding.

A text's n-grams are its runs of N white-space-parted words (a shorter text that has words is one n-gram). Two
texts are linked when the Jaccard likeness of their sets of n-grams is THRESHOLD or more.

1. Texts with the same set of n-grams form a class of copies at once, by a digest of the set; one row stands
   for all its copies, however many.
2. Each such row has BANDS hashes, each of ROWS minima of the set under random hash functions; `banding` chooses
   the numbers for the target recall at the threshold. Rows that share a band's hash, a bucket, are candidates.
3. Buckets of two rows or more are kept; of those with the very same rows, as near copies have in many bands, the
   one of the first band is. Only rows of kept buckets go on, with their full sets of n-grams.
4. A bucket is dealt in blocks of bounded rows and bytes, and each pair of blocks is one group of work, so a large
   bucket spreads over many tasks. A group counts exact common n-grams by inverted lists; a pair counts in the first
   band that it shares and in no other. It gives for each row its links (weighted by copies) and a spanning forest
   of the linked rows: fewer rows than it read, never all pairs. No partner is left out.
5. `components` over the forests gives the classes of linked texts.

Sets are told apart by 128 bits of their digest and n-grams by 64 bits of theirs.
"""

from __future__ import annotations

import hashlib
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from gleanguard.llm.common import blocks, bounded_batches, documents, fresh, rows_of, settled
from gleanguard.llm.components import components
from gleanguard.llm.tokens import Pieces, forget, once, tidy

N, THRESHOLD, RECALL = 5, 0.8, 0.999
#: Hash functions at most.
MINIMA = 160
#: Bytes of a group of work from which on its memory is given back at once, as workers idle through the stages that follow.
LARGE = 8 << 20
#: Rows and n-grams (of eight bytes) of a block, about.
BLOCK, BLOCK_GRAMS = 256, 1 << 20
SEED = 5


def banding(threshold: float = THRESHOLD, recall: float = RECALL, minima: int = MINIMA) -> tuple[int, int]:
    """(bands, rows): the most rows in a band, so the fewest false candidates, that reach the recall at the threshold."""
    best = (minima, 1)
    for rows in range(1, minima + 1):
        bands = minima // rows
        if 1 - (1 - threshold**rows) ** bands >= recall:
            best = bands, rows
    return best


class WordHashes(Pieces):
    """Each word's 64-bit hash, words parted as str.split does."""

    def __init__(self):
        super().__init__(spaced=False)

    def worth(self, pieces: list[str]) -> list[bytes]:
        # two different checksums make 64 bits
        out = []
        for p in pieces:
            words = [w.encode("utf-8", "surrogatepass") for w in p.split()]
            out.append(np.array([zlib.crc32(w) | zlib.crc32(w[::-1] + b"\1", 0x5A5A) << 32 for w in words], "<u8").tobytes())
        return out

    def ngrams(self, texts: list[str], n: int = N) -> list[np.ndarray]:
        """The sorted different 64-bit hashes of each text's n-grams."""
        out = []
        for v in self.joined(texts, 8):
            h = np.frombuffer(v, "<u8")
            if not len(h):
                out.append(h)
                continue
            k = min(n, len(h))
            with np.errstate(over="ignore"):
                g = h[: len(h) - k + 1].copy()
                for i in range(1, k):
                    g = (g ^ (g >> np.uint64(32))) * np.uint64(0x9E3779B97F4A7C15) + h[i : len(h) - k + 1 + i]
                g = (g ^ (g >> np.uint64(33))) * np.uint64(0xFF51AFD7ED558CCD)
                g ^= g >> np.uint64(33)
            out.append(np.unique(g))
        return out


def digest(grams: np.ndarray) -> bytes:
    return hashlib.blake2b(grams.tobytes(), digest_size=16).digest()


def minima(grams: np.ndarray, a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """The least of each hash function x -> a x + b (32 bits) over the set."""
    x = (grams >> np.uint64(32)).astype(np.uint32)
    out = np.full(len(a), np.iinfo(np.uint32).max, np.uint32)
    for k in range(0, len(x), 1024):
        h = a[:, None] * x[None, k : k + 1024]
        h += b[:, None]
        np.minimum(out, h.min(1), out=out)
    return out


def _functions(n: int) -> tuple[np.ndarray, np.ndarray]:
    rng = np.random.default_rng(SEED)
    draw = lambda: rng.integers(0, 1 << 32, n, dtype=np.uint32)
    return draw() | np.uint32(1), draw()


_SIGNED = pa.schema([("doc_id", pa.int64()), ("mark", pa.int64()), ("set_id", pa.binary()), ("grams", pa.int64()), ("bands", pa.list_(pa.int64()))])


def _mark() -> F.Column:
    """What tells rows of one doc_id apart: equal texts have equal marks."""
    return F.xxhash64(F.coalesce("text", F.lit("")))


def signatures(df: DataFrame, n: int = N, threshold: float = THRESHOLD, recall: float = RECALL) -> DataFrame:
    """(doc_id, mark: hash of the text, set_id: digest of the set of n-grams, grams: its size, bands: array of band hashes)."""
    bounded_batches(df.sparkSession)
    bands, rows = banding(threshold, recall)
    a, b = _functions(bands * rows)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        words = once(WordHashes)
        for block in blocks(rows_of(batches, "doc_id", "mark", "text"), 2):
            sets = words.ngrams([t or "" for _, _, t in block], n)
            ids, known, hashes = [], {}, []
            for g in sets:
                name = digest(g)
                ids.append(name)
                if name not in known:
                    m = minima(g, a, b)
                    known[name] = [int.from_bytes(hashlib.blake2b(m[k * rows : (k + 1) * rows].tobytes(), digest_size=8).digest(), "little", signed=True) for k in range(bands)] if len(g) else []
                hashes.append(known[name])
            yield pa.RecordBatch.from_arrays([pa.array([r[0] for r in block], pa.int64()), pa.array([r[1] for r in block], pa.int64()), pa.array(ids, pa.binary()), pa.array([len(g) for g in sets], pa.int64()), pa.array(hashes, pa.list_(pa.int64()))], schema=_SIGNED)

    return df.select("doc_id", _mark().alias("mark"), "text").mapInArrow(run, "doc_id long, mark long, set_id binary, grams long, bands array<long>")


def linked(sets: list[np.ndarray], left: np.ndarray, right: np.ndarray, threshold: float = THRESHOLD) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """(row, all rows linked to it) for rows of `left` against rows of `right`, by common n-grams counted exactly.

    left and right are indexes into sets. N-grams that one row alone has are set aside; the others' rows lie in
    inverted lists, and a left row's counts are sums over its lists.
    """
    sizes = np.array([len(s) for s in sets], np.int64)
    every, inverse = np.unique(np.concatenate(sets), return_inverse=True)
    owner = np.repeat(np.arange(len(sets)), sizes)
    place = np.full(len(sets), -1, np.int64)
    place[right] = np.arange(len(right))
    mine = place[owner] >= 0
    order = np.argsort(inverse[mine], kind="stable")
    lists = place[owner[mine]][order]
    starts = np.searchsorted(inverse[mine][order], np.arange(len(every) + 1))
    begun = np.concatenate(([0], np.cumsum(sizes)))
    lengths = np.diff(starts)
    for row in left.tolist():
        own = inverse[begun[row] : begun[row + 1]]
        own = own[lengths[own] > 0]
        n = lengths[own]
        total = int(n.sum())
        if not total:
            continue
        spots = np.repeat(starts[own] - np.concatenate(([0], np.cumsum(n)[:-1])), n) + np.arange(total)
        common = np.bincount(lists[spots], minlength=len(right))
        yield row, right[(common > 0) & (common >= threshold * (sizes[row] + sizes[right] - common) - 1e-9)]


def forest(edges: list[tuple[int, np.ndarray]], n: int) -> list[tuple[int, int]]:
    """A spanning forest of the graph: at most n - 1 of its edges join as many rows as all do."""
    parent = list(range(n))

    def root(x: int) -> int:
        while parent[x] != x:
            parent[x] = parent[parent[x]]
            x = parent[x]
        return x

    out = []
    for row, others in edges:
        a = root(row)
        for o in others.tolist():
            b = root(o)
            if a != b:
                out.append((row, o))
                parent[b] = a
    return out


def _pairs_of(key, table: pa.Table, threshold: float) -> pa.Table:
    """Of one pair of a bucket's blocks: rows (set_id, None, links) and edges (set_id, other, 0) of a spanning forest."""
    forget()  # the words' table, which the stages from here on don't need
    names, blocks_of = table.column("set_id").to_pylist(), table.column("block").to_pylist()
    order = [k for _, k in sorted({(blocks_of[k], names[k]): k for k in range(len(names))}.items())]  # whatever order they came in
    table = table.take(pa.array(order, pa.int64()))
    ids, weight, side = table.column("set_id").to_pylist(), table.column("copies").to_numpy(), table.column("block").to_numpy()
    sets = [np.frombuffer(g, "<u8") for g in table.column("ngrams").to_pylist()]
    band, one, two = key[0].as_py(), key[2].as_py(), key[3].as_py()
    earlier = np.stack([np.frombuffer(x, "<i8")[:band] for x in table.column("bands").to_pylist()])
    left, right = np.nonzero(side == one)[0], np.nonzero(side == two)[0]
    links, edges = np.zeros(len(ids), np.int64), []
    for row, others in linked(sets, left, right, threshold):
        others = others[others != row]
        others = others[~(earlier[others] == earlier[row]).any(1)]  # else an earlier band has counted the pair
        links[row] += weight[others].sum()
        if one != two:
            links[others] += weight[row]
        edges.append((row, others))
    tree = forest(edges, len(ids))
    a = [ids[x] for x, _ in tree] + [i for i, n in zip(ids, links, strict=True) if n]
    b = [ids[y] for _, y in tree] + [None] * (len(a) - len(tree))
    n = [0] * len(tree) + [int(x) for x in links if x]
    return pa.Table.from_arrays([pa.array(a, pa.binary()), pa.array(b, pa.binary()), pa.array(n, pa.int64())], names=["set_id", "other", "links"])


def _buckets(reps: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(set_id, band, hash) of all rows' buckets, and the kept buckets (band, hash, blocks)."""
    banded = reps.where("size(bands) > 0").select("set_id", "grams", F.posexplode("bands").alias("band", "hash"))
    who = lambda seed: F.bit_xor(F.xxhash64("set_id", F.lit(seed)))
    counted = banded.groupBy("band", "hash").agg(F.count("*").alias("n"), F.sum("grams").alias("grams"), who(1).alias("one"), who(2).alias("two")).where("n > 1")
    first = counted.groupBy("n", "one", "two").agg(F.min(F.struct("band", "hash")).alias("at"), F.max("grams").alias("grams"))
    blocks_of = F.greatest(F.ceil(F.col("n") / BLOCK), F.ceil(F.col("grams") / BLOCK_GRAMS))
    return banded.select("set_id", "band", "hash"), settled(first.select("at.band", "at.hash", blocks_of.alias("blocks")), "buckets")


def _known(df: DataFrame, n: int, threshold: float, recall: float) -> tuple[DataFrame, DataFrame]:
    """(doc_id, mark, set_id, grams, bands) of every row, and of every set (set_id, class_id, n_links, rep, rep_mark, kept):
    rep is its smallest doc_id, kept whether the class keeps this set's rep, which one set of each class is."""
    bounded_batches(df.sparkSession)
    signed = settled(signatures(df, n, threshold, recall), "signatures")
    first = F.min(F.struct(F.col("doc_id").isNull().alias("late"), "doc_id", "mark")).alias("first")
    reps = signed.groupBy("set_id").agg(first, F.count("*").alias("copies"), F.max("grams").alias("grams"), F.max("bands").alias("bands"))
    reps = settled(reps.select("set_id", F.col("first.doc_id").alias("rep"), F.col("first.mark").alias("rep_mark"), "copies", "grams", "bands"), "sets")
    banded, buckets = _buckets(reps)
    # a row is in as many buckets as there are bands at most
    places = banded.join(buckets, ["band", "hash"]).groupBy("set_id").agg(F.collect_list(F.struct("band", "hash", "blocks")).alias("places"))
    chosen = settled(reps.join(places, "set_id").drop("grams"), "chosen")

    def sets_of(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        words = once(WordHashes)
        for batch in batches:
            k, column = 0, pa.Table.from_batches([batch])
            for block in blocks(rows_of([batch], "text"), 0):
                grams = [g.tobytes() for g in words.ngrams([t or "" for (t,) in block], n)]
                part = column.slice(k, len(block))
                k += len(block)
                bands_ = [np.array(x, "<i8").tobytes() for x in part.column("bands").to_pylist()]
                part = part.drop_columns(["text", "bands"]).append_column("bands", pa.array(bands_, pa.binary())).append_column("ngrams", pa.array(grams, pa.binary()))
                yield from part.to_batches()

    def pairs(key: tuple, table: pa.Table) -> pa.Table:
        out = _pairs_of(key, table, threshold)
        if table.nbytes > LARGE:
            tidy()
        return out

    same = F.col("doc_id").eqNullSafe(F.col("rep")) & (F.col("mark") == F.col("rep_mark"))
    met = df.select("doc_id", _mark().alias("mark"), "text").join(chosen, same).dropDuplicates(["set_id"]).select("set_id", "copies", "places", "bands", "text")
    sets = met.mapInArrow(sets_of, "set_id binary, copies long, places array<struct<band:int,hash:long,blocks:long>>, bands binary, ngrams binary")
    dealt = sets.select("*", F.explode("places").alias("at")).withColumn("block", F.pmod(F.xxhash64("set_id", F.lit(SEED)), F.col("at.blocks")))
    dealt = dealt.select("set_id", "copies", "bands", "ngrams", "block", "at.band", "at.hash", F.explode(F.sequence(F.lit(0).cast("long"), F.col("at.blocks") - 1)).alias("other"))
    groups = dealt.withColumns({"one": F.least("block", "other"), "two": F.greatest("block", "other")}).drop("other").groupBy("band", "hash", "one", "two")
    found = settled(groups.applyInArrow(pairs, "set_id binary, other binary, links long"), "links")
    classes = components(settled(found.where("other IS NOT NULL").select(F.col("set_id").alias("a"), F.col("other").alias("b")).distinct(), "edges"))
    links = found.where("links > 0").groupBy(F.col("set_id").alias("_set")).agg(F.sum("links").alias("links"))
    order = F.struct(F.col("rep").isNull().alias("late"), "rep", "node")
    least = classes.join(reps.select(F.col("set_id").alias("node"), "rep"), "node").groupBy("root").agg(F.min(order).alias("first"))
    by_set = classes.join(settled(least, "least"), "root").select(F.col("node").alias("_node"), "first")
    known = reps.select("set_id", "rep", "rep_mark", "copies").join(by_set, F.col("set_id") == F.col("_node"), "left").join(links, F.col("set_id") == F.col("_set"), "left")
    kept = F.coalesce(F.col("first.node") == F.col("set_id"), F.lit(True)).alias("kept")
    known = known.select("set_id", F.coalesce("first.rep", "rep").alias("class_id"), (F.coalesce("links", F.lit(0)) + F.col("copies") - 1).alias("n_links"), "rep", "rep_mark", kept)
    return signed, settled(known, "known")


def near_duplicates(df: DataFrame, n: int = N, threshold: float = THRESHOLD, recall: float = RECALL) -> DataFrame:
    """(doc_id, class_id, n_links) for every row of (doc_id, text); an empty table gives none.

    class_id is the smallest doc_id of the documents that links join, directly or by way of others; n_links is
    the number of other rows whose likeness is the threshold or more, copies included. Texts without words (null,
    empty) are copies of each other. class_id is null only where all ids of a class are. Rows that repeat an id
    count as rows, each by its own text. A long text takes part with all its n-grams. Other columns are not read.
    """
    signed, known = _known(df, n, threshold, recall)
    return signed.select("doc_id", "set_id").join(known, "set_id").select("doc_id", "class_id", "n_links")


def drop_near_duplicates(df: DataFrame, n: int = N, threshold: float = THRESHOLD) -> DataFrame:
    """The rows of df, all columns, but all save one of each class (see near_duplicates).

    The row with the smallest doc_id stays, null ids last; of rows that share this id, one stays, and where they share
    the text too, any one of them. Texts without words are one class. An empty table stays empty. Columns may have any
    names beside doc_id and text.
    """
    signed, known = _known(df, n, threshold, RECALL)
    stays = F.col("kept") & F.col("doc_id").eqNullSafe(F.col("rep")) & (F.col("mark") == F.col("rep_mark"))
    rows = signed.select("doc_id", "mark", "set_id").join(known, "set_id").groupBy("doc_id", "mark").agg(F.count("*").alias("rows"), F.bool_or(stays).alias("stay"))
    mark, gone_id, gone_mark = fresh(df, "_mark", "_gone_id", "_gone_mark")
    gone = settled(rows.where("NOT stay OR rows > 1").select(F.col("doc_id").alias(gone_id), F.col("mark").alias(gone_mark), "stay"), "gone")
    marked, same = df.withColumn(mark, _mark()), F.col("doc_id").eqNullSafe(F.col(gone_id)) & (F.col(mark) == F.col(gone_mark))
    whole = marked.join(gone.select(gone_id, gone_mark), same, "left_anti").select(df.columns)
    twice = gone.where("stay").select(gone_id, gone_mark)
    if twice.isEmpty():
        return whole
    return whole.unionByName(marked.join(twice, same, "left_semi").dropDuplicates(["doc_id", mark]).select(df.columns))


def op5_ngram_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    return near_duplicates(documents(spark, sf_dir))
