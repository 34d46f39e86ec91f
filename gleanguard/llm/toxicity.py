"""Toxicity by a factorization machine over hashed terms.

Terms are a text's different lower-case words and their beginnings of four to six characters, hashed into
BUCKETS places. The score is the logistic of
  b + sum_i w_i + 1/2 sum_f ((sum_i v_if)^2 - sum_i v_if^2)
over the places i that occur, so besides each term's weight w the factors v learn what pairs of terms add, such
as an insult beside the mention of a group. Training is AdaGrad on the logistic loss with a soft threshold (L1)
on w and a group threshold on each row of v, so that terms which tell nothing weigh nothing, however many of
them a long text holds.

The model is fitted in one task on at most TRAIN_ROWS labelled rows, those with the smallest seeded hash of
doc_id among the rows that are not held out, and at most TRAIN_PLACES places of theirs; only the model comes to
the driver. A task that is run again meets the same rows in the same order and gives the same model. Scoring needs
no shuffle.
"""

from __future__ import annotations

import re
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from gleanguard.llm.common import batch_of, blocks, bounded_batches, documents, rows_of, slices
from gleanguard.llm.tokens import Pieces, forget, once, tidy

#: The bounds of the labelled sample: rows, and places of their terms (four bytes each).
TRAIN_ROWS, TRAIN_PLACES = 12_000, 1 << 25
BUCKETS = 1 << 20
FACTORS = 4
#: Beginnings of a word that are terms of their own.
BEGINNINGS = (4, 5, 6)
#: Sample rows that a term must occur in.
LEAST_ROWS = 4
#: GROUP_L1 is bounded from above: a row of v starts small, and one that the threshold makes zero stays zero, so a larger
#: one leaves no pairs.
EPOCHS, BATCH, RATE, L1, GROUP_L1 = 12, 256, 0.1, 1e-3, 3e-3
#: A small sample is gone over more often, until so many batches were learned from.
LEAST_BATCHES = 600
#: Places that are scored together.
TOGETHER = 1 << 17
SEED = 3
_WORD = re.compile(r"[^\W_]+")
_OUT = pa.schema([("doc_id", pa.int64()), ("held_out", pa.bool_()), ("score", pa.float64()), ("predicted", pa.int32())])


class Terms(Pieces):
    """Places of the hashed terms of texts."""

    def __init__(self, remembered: int = 150_000):
        super().__init__(spaced=False, remembered=remembered)

    def worth(self, pieces: list[str]) -> list[bytes]:
        out = []
        for piece in pieces:
            terms = []
            for word in _WORD.findall(piece.lower()):
                terms.append(word)
                terms += [f"{word[:n]}*" for n in BEGINNINGS if n < len(word)]
            out.append(np.array([zlib.crc32(t.encode("utf-8", "surrogatepass")) % BUCKETS for t in terms], "<u4").tobytes())
        return out

    def places(self, texts: list[str]) -> list[np.ndarray]:
        return [np.unique(np.frombuffer(v, "<u4")) for v in self.joined(texts)]


def best_threshold(logits: np.ndarray, labels: np.ndarray) -> float:
    """The middle of the gap between logits that parts the labels with the fewest errors; the L1 threshold shrinks
    weights, so without it rows with one telling term would fall short."""
    order = np.argsort(logits, kind="stable")
    z, y = logits[order], labels[order]
    errors = np.concatenate(([0], np.cumsum(y))) + np.concatenate((np.cumsum((1 - y)[::-1])[::-1], [0]))
    edges = np.concatenate(([z[0] - 2], z, [z[-1] + 2]))
    gaps = np.diff(edges)
    errors = np.where(gaps > 0, errors, np.inf)
    best = np.nonzero(errors == errors.min())[0]
    k = best[np.argmax(gaps[best])]
    return float((edges[k] + edges[k + 1]) / 2)


class FactorizationMachine:
    """The weights of the places that any training row kept; all others weigh nothing."""

    def __init__(self, factors: int = FACTORS):
        self.bias, self.at = -20.0, np.zeros(0, np.int64)
        self.w, self.v = np.zeros(0, np.float32), np.zeros((0, factors), np.float32)
        self._wide: tuple | None = None

    def fit(self, rows: list[np.ndarray], labels: np.ndarray, epochs: int = EPOCHS, seed: int = SEED, group_l1: float = GROUP_L1) -> FactorizationMachine:
        """Learns from rows of places and their labels; the list `rows` is used up."""
        if not len(rows):
            return self
        rng, factors = np.random.default_rng(seed), self.v.shape[1]
        seen = np.zeros(BUCKETS, np.int64)
        for r in rows:
            seen[r] += 1  # a row's places differ
        self.at = np.nonzero(seen >= LEAST_ROWS)[0]
        own = np.full(BUCKETS, -1, np.int32)
        own[self.at] = np.arange(len(self.at))
        for k, r in enumerate(rows):  # in place, so that a large sample is held once
            rows[k] = (p := own[r])[p >= 0]
        n = len(self.at)
        w, v = np.zeros(n), rng.normal(0, 0.01, (n, factors))
        gw, gv, gb = np.full(n, 1e-6), np.full(n, 1e-6), 1e-6
        share = float(np.clip(labels.mean(), 1e-3, 1 - 1e-3))
        bias = np.log(share / (1 - share))
        sizes = np.array([len(r) for r in rows])
        for _ in range(max(epochs, -(-LEAST_BATCHES // -(-len(rows) // BATCH)))):
            order = rng.permutation(len(rows))
            for k in range(0, len(order), BATCH):
                batch = order[k : k + BATCH]
                of = np.repeat(np.arange(len(batch)), sizes[batch])
                places = np.concatenate([rows[b] for b in batch])
                used, inverse = np.unique(places, return_inverse=True)
                vp = v[places]
                sums = np.stack([np.bincount(of, vp[:, f], len(batch)) for f in range(factors)], 1)
                squares = np.bincount(of, (vp * vp).sum(1), len(batch))
                z = bias + np.bincount(of, w[places], len(batch)) + 0.5 * ((sums * sums).sum(1) - squares)
                error = (1 / (1 + np.exp(-np.clip(z, -30, 30))) - labels[batch]) / len(batch)
                gb += error.sum() ** 2
                bias -= RATE * error.sum() / np.sqrt(gb)
                ep = error[of]
                grad = np.bincount(inverse, ep, len(used))
                gw[used] += grad * grad
                rate = RATE / np.sqrt(gw[used])
                moved = w[used] - rate * grad
                w[used] = np.sign(moved) * np.maximum(np.abs(moved) - rate * L1, 0)
                gradv = np.stack([np.bincount(inverse, ep * (sums[of, f] - vp[:, f]), len(used)) for f in range(factors)], 1)
                gv[used] += (gradv * gradv).sum(1)
                rate = RATE / np.sqrt(gv[used])
                moved = v[used] - rate[:, None] * gradv
                norm = np.sqrt((moved * moved).sum(1)) + 1e-12
                v[used] = moved * np.maximum(1 - rate * group_l1 / norm, 0)[:, None]
        kept = (w != 0) | (v != 0).any(1)
        spare = self.__class__(factors)
        spare.bias, spare.at, spare.w, spare.v = 0.0, self.at[kept], w[kept], v[kept]
        z = np.concatenate([spare.logits([self.at[r] for r in rows[k : k + BATCH]]) for k in range(0, len(rows), BATCH)])
        bias = -best_threshold(z, labels)
        self.bias, self.at, self.w, self.v = float(bias), self.at[kept], w[kept].astype(np.float32), v[kept].astype(np.float32)
        return self

    def _spread(self) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Row of each place (the last row, of zeros, for places that weigh nothing), w and v with that row; made once
        for the same weights."""
        if self._wide is None or self._wide[0] is not self.w or self._wide[1] is not self.v:
            own = np.full(BUCKETS, len(self.at), np.int32)
            own[self.at] = np.arange(len(self.at))
            self._wide = self.w, self.v, (own, np.append(self.w, 0).astype(np.float64), np.vstack([self.v, np.zeros((1, self.v.shape[1]))]).astype(np.float64))
        return self._wide[2]

    def logits(self, rows: list[np.ndarray]) -> np.ndarray:
        """Of each row of places; TOGETHER places, or one row, at a time."""
        own, w, v = self._spread()
        sizes = np.array([len(r) for r in rows], np.int64)
        part = np.cumsum(sizes) // TOGETHER
        edges = [0, *(np.nonzero(part[1:] != part[:-1])[0] + 1).tolist(), len(rows)]
        out = np.full(len(rows), self.bias)
        for a, b in zip(edges, edges[1:], strict=False):
            if not sizes[a:b].sum():
                continue
            of, k = np.repeat(np.arange(b - a), sizes[a:b]), own[np.concatenate(rows[a:b])]
            known = k < len(self.at)
            of, k = of[known], k[known]
            vk, sum_of = v[k], lambda x, of=of, n=b - a: np.bincount(of, x, n)
            out[a:b] += sum_of(w[k]) + 0.5 * (sum(sum_of(vk[:, f]) ** 2 for f in range(v.shape[1])) - sum_of((vk * vk).sum(1)))
        return out

    def packed(self) -> list[bytes]:
        return [np.array([self.bias], "<f8").tobytes(), self.at.astype("<i8").tobytes(), self.w.astype("<f4").tobytes(), self.v.astype("<f4").tobytes()]

    @classmethod
    def unpacked(cls, parts: list[bytes], factors: int = FACTORS) -> FactorizationMachine:
        self = cls(factors)
        self.bias, self.at = float(np.frombuffer(parts[0], "<f8")[0]), np.frombuffer(parts[1], "<i8")
        self.w, self.v = np.frombuffer(parts[2], "<f4"), np.frombuffer(parts[3], "<f4").reshape(-1, factors)
        return self

    def scores(self, rows: list[np.ndarray]) -> list[float]:
        return (1 / (1 + np.exp(-np.clip(self.logits(rows), -500, 500)))).tolist()


def held_out() -> Column:
    """Whether crc32 of doc_id as text is divisible by 5; of a null id, not."""
    return F.coalesce(F.crc32(F.col("doc_id").cast("string")) % 5 == 0, F.lit(False))


def train(df: DataFrame, labels: DataFrame, rows: int = TRAIN_ROWS, seed: int = SEED, most: int = TRAIN_PLACES) -> FactorizationMachine:
    """The machine for labels (doc_id, toxic) over the texts of df (doc_id, text), without the rows held out.

    Null labels and ids are left out; of labels that repeat an id the largest counts, and of rows that repeat an id
    one, the one with the least hash of its terms. Without labelled rows (or in an empty table) every text scores
    almost 0. Null and empty texts are rows without terms. A long text has BUCKETS places at most, and the sample
    ends before the row that would bring it over `most`. Ties in the sample's order go by doc_id. Other columns are not read.
    """
    bounded_batches(df.sparkSession)
    known = labels.select("doc_id", F.col("toxic").cast("int").alias("toxic")).where("doc_id IS NOT NULL AND toxic IS NOT NULL").where(~held_out())
    turn = F.xxhash64("doc_id", F.lit(seed))
    picked = known.groupBy("doc_id").agg(F.max("toxic").alias("toxic")).orderBy(turn, "doc_id").limit(rows)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        terms = once(Terms)
        for block in blocks(rows_of(batches, "doc_id", "toxic", "text"), 2):
            found = terms.places([t or "" for _, _, t in block])
            yield pa.RecordBatch.from_arrays([pa.array([i for i, _, _ in block], pa.int64()), pa.array([y for _, y, _ in block], pa.int32()), pa.array([p.astype("<u4").tobytes() for p in found], pa.binary())], names=["doc_id", "toxic", "places"])

    def fit(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        forget()
        texts, toxic, size = [], [], 0
        for _, y, places in rows_of(batches, "doc_id", "toxic", "places"):
            size += len(places) // 4
            if size > most:
                break
            texts.append(np.frombuffer(places, "<u4"))
            toxic.append(y)
        for _ in batches:  # what is left is read and not kept
            pass
        if texts:
            yield pa.RecordBatch.from_arrays([pa.array([x], pa.binary()) for x in FactorizationMachine().fit(texts, np.array(toxic, float)).packed()], names=["bias", "at", "w", "v"])
        del texts
        tidy()

    # at most `rows` ids of 16 bytes each are broadcast
    found = df.select("doc_id", "text").join(F.broadcast(picked), "doc_id").select("doc_id", "toxic", "text").mapInArrow(run, "doc_id long, toxic int, places binary")
    one = found.groupBy("doc_id").agg(F.min(F.struct(F.xxhash64("places").alias("hash"), "toxic", "places")).alias("one")).select("doc_id", "one.toxic", "one.places")
    sample = one.repartition(1).sortWithinPartitions(turn, "doc_id")
    made = sample.mapInArrow(fit, "bias binary, at binary, w binary, v binary").collect()
    return FactorizationMachine.unpacked([bytes(x) for x in made[0]]) if made else FactorizationMachine()


def score(df: DataFrame, model: FactorizationMachine) -> DataFrame:
    """(doc_id, held_out, score, predicted) of every row of (doc_id, text), rows independent of each other.

    A null text scores as an empty one: no terms, the bias alone. Long texts are scored whole. Rows that repeat, and
    rows without id (never held out), are scored row by row; an empty table gives none. Other columns are not read.
    """
    bounded_batches(df.sparkSession)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        terms = once(Terms)
        for part in slices(batches, "text"):
            s = model.scores(terms.places(part.column("text").to_pylist()))
            yield batch_of(_OUT, [part.column("doc_id").to_pylist(), part.column("held_out").to_pylist(), s, [int(x >= 0.5) for x in s]])

    return df.select("doc_id", held_out().alias("held_out"), "text").mapInArrow(run, "doc_id long, held_out boolean, score double, predicted int")


def drop_toxic(df: DataFrame, model: FactorizationMachine) -> DataFrame:
    """The rows of df, all columns as they are, whose text the model predicts 0 for; scores as in `score`.

    Equal texts stay or go together; ids play no part, so null and repeated ones are rows like others. df may have
    columns of any names beside text.
    """
    bounded_batches(df.sparkSession)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        terms = once(Terms)
        for part in slices(batches, "text", nulls=True):
            clean = [x < 0.5 for x in model.scores(terms.places([t or "" for t in part.column("text").to_pylist()]))]
            yield part.filter(pa.array(clean, pa.bool_()))

    return df.mapInArrow(run, df.schema)


def op3_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = documents(spark, sf_dir)
    return score(docs, train(docs, spark.read.parquet(f"{sf_dir}/labels.parquet")))
