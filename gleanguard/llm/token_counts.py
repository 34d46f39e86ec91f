"""Token counts by rank-synchronous array merging.

Different pre-tokens of a batch lie one after another in one array of symbols with an array of their starts.
Each round finds every pre-token's lowest merge rank among its neighbouring pairs and joins all those pairs at
once; pre-tokens without a mergeable pair leave. What survives is counted. A text's count is the sum over its
pieces; a worker remembers pieces it has counted.
"""

from __future__ import annotations

import json
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession

from gleanguard.llm.common import batch_of, blocks, bounded_batches, documents, rows_of, spread
from gleanguard.llm.bpe_codec import byte_characters
from gleanguard.llm.merging import MergeTable
from gleanguard.llm.tokens import Pieces, once, plain_letters, vocabulary_path

VOCABULARY = "word_bpe_49k.json"
LIMIT = 2048
_OUT = pa.schema([("doc_id", pa.int64()), ("n_bytes", pa.int64()), ("n_tokens", pa.int64()), ("over_limit", pa.bool_())])


class RankMerger:
    """Counts the symbols that are left of pre-tokens (strings of characters that stand for bytes) after all merges."""

    def __init__(self, vocabulary: str):
        from tokenizers import Tokenizer

        path = vocabulary_path(vocabulary)
        with open(path, encoding="utf-8") as f:
            spec = json.load(f)
        self.tokenizer = Tokenizer.from_file(path)
        self.specials = [a["content"] for a in spec["added_tokens"]]
        model = spec["model"]
        ids: dict[str, int] = model["vocab"]
        suffix = model.get("end_of_word_suffix") or ""
        pairs = [m if isinstance(m, list) else m.split(" ") for m in model["merges"]]
        self.table = MergeTable(*(np.array([ids[p] for p in side], np.int64) for side in zip(*((a, b, a + b) for a, b in pairs), strict=True)))
        # ids of single characters, inside a word and at its end; a character that the vocabulary lacks yields no token
        self.inner, self.last = (np.array([ids.get(chr(c) + end, -1) for c in range(512)], np.int64) for end in ("", suffix))

    def counts(self, words: list[str]) -> np.ndarray:
        sizes = np.array(list(map(len, words)), np.int64)
        codes = np.frombuffer("".join(words).encode("utf-32-le"), "<u4")
        symbols = self.inner[codes]
        ends = np.cumsum(sizes) - 1
        symbols[ends] = self.last[codes[ends]]
        known = symbols >= 0
        if not known.all():
            sizes = np.bincount(np.repeat(np.arange(len(sizes)), sizes)[known], minlength=len(sizes))
            symbols = symbols[known]
        return self.table.merged(symbols, sizes)[1]


class PieceCounts(Pieces):
    def __init__(self, vocabulary: str):
        self.merger = RankMerger(vocabulary)
        t = self.merger.tokenizer
        super().__init__(spaced=t.normalizer is None)
        self.normal = t.normalizer.normalize_str if t.normalizer else str
        self.cut = t.pre_tokenizer.pre_tokenize_str
        self.stops = (",", ".")
        self.shown = {b: c for c, b in byte_characters().items()}
        same = lambda text, *words: [w for w, _ in self.cut(self.normal(text))] == list(words)
        self.plain = not self.spaced and same("Word.", "word", ".") and same("a,", "a", ",")

    def _parts(self, piece: str) -> tuple[list[str], int]:
        """The piece without special tokens' strings, and how many there were."""
        parts, n = [piece], 0
        for s in self.merger.specials:
            if any(s in p for p in parts):
                split = [p.split(s) for p in parts]
                n += sum(len(x) - 1 for x in split)
                parts = [p for x in split for p in x]
        return parts, n

    def worth(self, pieces: list[str]) -> list[int]:
        words: dict[str, int] = {}
        needs, extra = [], []
        for piece in pieces:
            word, stop = (piece[:-1], piece[-1]) if piece[-1:] in self.stops else (piece, "")
            # letters, or letters and a stop, need no more than lower case; of these two letters it depends on the place
            if self.plain and word.isalpha() and plain_letters(word):
                word = word.lower()
                word = word if word.isascii() else word.encode().decode("latin-1").translate(self.shown)
                needs.append([words.setdefault(w, len(words)) for w in (word, stop) if w])
                extra.append(0)
                continue
            parts, n = self._parts(piece)
            own = [words.setdefault(w, len(words)) for p in parts if p for w, _ in self.cut(self.normal(p))]
            needs.append(own)
            extra.append(n)
        counts = self.merger.counts(list(words)).tolist()
        return [sum(counts[k] for k in own) + n for own, n in zip(needs, extra, strict=True)]


def count_tokens(df: DataFrame, vocabulary: str = VOCABULARY, limit: int = LIMIT) -> DataFrame:
    """(doc_id, n_bytes, n_tokens, over_limit) of every row of (doc_id, text); no shuffle.

    A null text counts as empty: 0 bytes, 0 tokens. Repeated rows and null ids are counted row by row; other
    columns are not read. Long texts are counted whole.
    """
    bounded_batches(df.sparkSession)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        counter = once(PieceCounts, vocabulary)
        for block in blocks(rows_of(batches, "doc_id", "text"), 1):
            texts = [t or "" for _, t in block]
            n = counter.sums(texts)
            yield batch_of(_OUT, [[i for i, _ in block], [len(t.encode()) for t in texts], n, [k > limit for k in n]])

    return df.select("doc_id", "text").mapInArrow(run, "doc_id long, n_bytes long, n_tokens long, over_limit boolean")


def op4_token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return count_tokens(spread(documents(spark, sf_dir)))
