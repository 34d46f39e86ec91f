"""Byte-pair encoding and decoding with forced boundaries.

A pair of bytes that lies inside no token of the vocabulary marks a certain cut: no token reaches across it, so
the fragments on both sides are encoded on their own and their ids are put together. Cuts are taken only after
a character other than white space and not before an apostrophe, as the pre-tokens' pattern looks no further
than that; any fragment then has the same pre-tokens as the whole text has there.
"""

from __future__ import annotations

import hashlib
import json
import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import DataFrame, SparkSession

from gleanguard.llm.common import batch_of, blocks, bounded_batches, documents, rows_of, spread
from gleanguard.llm.merging import MergeTable
from gleanguard.llm.tokens import Pieces, once, vocabulary_path

VOCABULARY = "byte_bpe_50k.json"
_OUT = pa.schema([("doc_id", pa.int64()), ("n_tokens", pa.int64()), ("ids_sha256", pa.string()), ("decoded_sha256", pa.string())])
#: Fixed: the pattern that cuts pre-tokens of this kind of vocabulary.
_PRETOKENS = regex.compile(r"'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+")


def byte_characters() -> dict[str, int]:
    """The character that stands for each byte: itself where it prints, else the next free one from 256 on."""
    printing = [*range(33, 127), *range(161, 173), *range(174, 256)]
    others = [b for b in range(256) if b not in printing]
    return {chr(b): b for b in printing} | {chr(256 + k): b for k, b in enumerate(others)}


class ForcedBoundaryCodec(Pieces):
    """Encodes texts to ids and decodes ids to texts for a byte-level vocabulary without normaliser."""

    def __init__(self, vocabulary: str):
        with open(vocabulary_path(vocabulary), encoding="utf-8") as f:
            spec = json.load(f)
        if spec["normalizer"] is not None or spec["pre_tokenizer"]["type"] != "ByteLevel":
            raise ValueError("forced boundaries need a byte-level vocabulary without a normaliser")
        to_byte, model = byte_characters(), spec["model"]
        token_bytes = {bytes(to_byte[c] for c in t): i for t, i in model["vocab"].items()}
        self.specials = {a["content"]: a["id"] for a in spec["added_tokens"]}
        self.special = regex.compile("(" + "|".join(map(regex.escape, self.specials)) + ")") if self.specials else None
        pairs = [[bytes(to_byte[c] for c in x) for x in (m if isinstance(m, list) else m.split(" "))] for m in model["merges"]]
        self.table = MergeTable(*(np.array([token_bytes[p] for p in side], np.int64) for side in zip(*((a, b, a + b) for a, b in pairs), strict=True)))
        self.bytes = np.array([token_bytes[bytes([b])] for b in range(256)], np.int64)
        inside = np.zeros((256, 256), bool)
        for t in token_bytes:
            raw = np.frombuffer(t, np.uint8)
            inside[raw[:-1], raw[1:]] = True
        self.inside = inside
        self.stops = [c for c in ",." if not inside[list(b"abcdefghijklmnopqrstuvwxyzABCDEFGHIJKLMNOPQRSTUVWXYZ"), ord(c)].any()]
        self.tokens = [b""] * (max([*token_bytes.values(), *self.specials.values()]) + 1)
        for t, i in [*token_bytes.items(), *((s.encode(), i) for s, i in self.specials.items())]:
            self.tokens[i] = t
        self.words: dict[bytes, bytes] = {}
        if any(re.search(rb"[^\s\x80-\xff] ", t) or re.search(r"\S ", t.decode("utf-8", "ignore")) for t in token_bytes):
            raise ValueError("this vocabulary has tokens that reach across a space")
        super().__init__(spaced=True)

    def cuts(self, texts: list[bytes]) -> np.ndarray:
        """Of each text, whether a pair of its bytes lies inside no token."""
        raw = np.frombuffer(b"".join(texts), np.uint8)
        ends = np.cumsum([len(t) for t in texts])
        free = ~self.inside[raw[:-1], raw[1:]]
        free[ends[(ends > 0) & (ends < len(raw))] - 1] = False
        at = np.nonzero(free)[0]
        out = np.zeros(len(texts), bool)
        out[np.searchsorted(ends, at, "right")] = True
        return out

    def fragments(self, text: str) -> list[str]:
        """The text cut at all forced boundaries."""
        pairs = np.frombuffer(text.encode(), np.uint8)
        cuts = set((np.nonzero(~self.inside[pairs[:-1], pairs[1:]])[0] + 1).tolist())
        at, out, begun = 0, [], 0
        for k, c in enumerate(text):
            if at in cuts and c != "'" and not text[k - 1].isspace():
                out.append(text[begun:k])
                begun = k
            at += len(c.encode())
        return [*out, text[begun:]]

    def _pretokens(self, fragment: str) -> list[bytes]:
        if fragment[1:].isalpha() and (fragment[0] == " " or fragment[0].isalpha()):
            return [fragment.encode()]
        return [m.encode() for m in _PRETOKENS.findall(fragment)]

    def _learn(self, words: list[bytes]) -> None:
        """Ids of pre-tokens that are not known yet, all of them merged together."""
        raw = np.frombuffer(b"".join(words), np.uint8)
        symbols, sizes = self.table.merged(self.bytes[raw], np.array(list(map(len, words)), np.int64))
        ends = (np.cumsum(sizes) * 4).tolist()
        data = symbols.astype("<u4").tobytes()
        self.words.update(zip(words, (data[a:b] for a, b in zip([0, *ends], ends, strict=False)), strict=True))

    def worth(self, pieces: list[str]) -> list[bytes]:
        if len(self.words) > self.remembered:
            self.words.clear()
        needs: list[list] = []  # of each piece, pre-tokens (bytes) and special tokens (numbers)
        for piece, cut in zip(pieces, self.cuts([p.encode() for p in pieces]).tolist(), strict=True):
            if any(x in piece for x in self.specials):
                own: list = []
                for k, part in enumerate(self.special.split(piece)):
                    own += [self.specials[part]] if k % 2 else [w for f in self.fragments(part) for w in self._pretokens(f)]
                needs.append(own)
            elif not cut:
                needs.append(self._pretokens(piece))
            elif piece[-1:] in self.stops and piece[:-1].isascii() and piece[1:-1].isalpha():
                # letters and a stop, which no token joins: the boundary before the stop is forced
                needs.append([w for f in self.fragments(piece[:-1]) for w in self._pretokens(f)] + [piece[-1].encode()])
            else:
                needs.append([w for f in self.fragments(piece) for w in self._pretokens(f)])
        known = self.words
        new = dict.fromkeys(w for own in needs for w in own if isinstance(w, bytes) and w not in known)
        if new:
            self._learn(list(new))
        return [b"".join([known[w] if isinstance(w, bytes) else np.array([w], "<u4").tobytes() for w in own]) for own in needs]

    def encode(self, texts: list[str]) -> list[bytes]:
        """Ids of each text as little-endian unsigned 32-bit bytes."""
        return self.joined(texts)

    def decode(self, ids: bytes) -> str:
        return b"".join(map(self.tokens.__getitem__, np.frombuffer(ids, "<u4").tolist())).decode("utf-8", "replace")


def encode_decode(df: DataFrame, vocabulary: str = VOCABULARY) -> DataFrame:
    """(doc_id, ids array<int>, decoded) of every row of (doc_id, text). A null text counts as empty: no ids and an
    empty text. Rows are independent of each other, so null and repeated ids are rows like others; long texts are encoded
    whole; an empty table gives no rows. Other columns are not read."""
    bounded_batches(df.sparkSession)
    out = pa.schema([("doc_id", pa.int64()), ("ids", pa.list_(pa.int32())), ("decoded", pa.string())])

    def run(batches):
        codec = once(ForcedBoundaryCodec, vocabulary)
        for block in blocks(rows_of(batches, "doc_id", "text"), 1):
            ids = codec.encode([t or "" for _, t in block])
            flat = np.frombuffer(b"".join(ids), "<u4").astype(np.int32)
            ends = np.cumsum([0, *(len(i) // 4 for i in ids)]).astype(np.int32)
            lists = pa.ListArray.from_arrays(pa.array(ends), pa.array(flat))
            yield pa.RecordBatch.from_arrays([pa.array([i for i, _ in block], pa.int64()), lists, pa.array([codec.decode(i) for i in ids])], schema=out)

    return df.select("doc_id", "text").mapInArrow(run, "doc_id long, ids array<int>, decoded string")


def encoding_digests(df: DataFrame, vocabulary: str = VOCABULARY) -> DataFrame:
    """(doc_id, n_tokens, ids_sha256, decoded_sha256): what encode_decode gives, as digests made in the same task."""
    bounded_batches(df.sparkSession)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        codec = once(ForcedBoundaryCodec, vocabulary)
        sha = lambda b: hashlib.sha256(b).hexdigest()
        for block in blocks(rows_of(batches, "doc_id", "text"), 1):
            ids = codec.encode([t or "" for _, t in block])
            yield batch_of(_OUT, [[i for i, _ in block], [len(i) // 4 for i in ids], [sha(i) for i in ids], [sha(codec.decode(i).encode()) for i in ids]])

    return df.select("doc_id", "text").mapInArrow(run, "doc_id long, n_tokens long, ids_sha256 string, decoded_sha256 string")


def op8_bpe_codec(spark: SparkSession, sf_dir: str) -> DataFrame:
    return encoding_digests(spread(documents(spark, sf_dir)))
