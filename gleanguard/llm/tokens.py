"""Encoding with public vocabularies, by pieces that a worker remembers.

A text falls into pieces at places where no token and no pre-token can reach across: for the vocabulary
with word ends at each space and line feed (white space is dropped there), for the byte-level one before
each space that follows other than white space, and around a line feed between such. A worker encodes each different piece once while it
remembers it. The table of pieces has a fixed bound: when it is half full, a new one begins with those pieces
that the last one took over from its predecessor, and takes over what it meets of the last one.
"""

from __future__ import annotations

import contextlib
import ctypes
import gc
import json
import os
import re
import string
import unicodedata

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc

#: Half of the pieces that a worker remembers at most.
REMEMBERED = 300_000
_CUT = re.compile(r"(?<=\S)(?= )")
_UNSURE = re.compile(r"\s\s|\0")
#: More texts than _UNSURE finds, in RE2's syntax: two white spaces together, or any of the unusual ones.
_UNSURE_RE2 = r"[\t-\r ][\t-\r ]|[\x00\x1c-\x1f\x{85}\x{a0}\x{1680}\x{2000}-\x{200a}\x{2028}\x{2029}\x{202f}\x{205f}\x{3000}]"
#: Marks that no contraction begins with.
_MARKS = string.punctuation.replace("'", "")
#: What a piece begins with that is a text's beginning as it stands.
AS_IS = "\0"


def vocabulary_path(name: str) -> str:
    """A file's path as it is; a bare name is looked up among the installed public tokenizers."""
    if os.sep in name:
        return name
    import public_tokenizers

    return public_tokenizers.path(name)


def byte_pieces(text: str) -> list[str]:
    """Pieces of the text without the space that each begins with; others begin with AS_IS or a line feed."""
    if _UNSURE.search(text):
        head, *rest = _CUT.split(text)
        pieces = [p[1:] if p[1:2] not in ("\n", AS_IS) else AS_IS + p for p in rest]
    else:
        head, *pieces = text.replace("\n", " \n").split(" ")
    return [AS_IS + head, *pieces]


def as_text(piece: str) -> str:
    """The part of the text that a piece of byte_pieces stands for."""
    first = piece[:1]
    return piece[1:] if first == AS_IS else piece if first == "\n" else " " + piece


def plain_letters(word: str) -> bool:
    """Whether normalising a word of letters is no more than lower case, letter by letter."""
    return word.isascii() or unicodedata.is_normalized("NFC", word) and "Σ" not in word and "İ" not in word


class Pieces:
    """Values of texts put together from values of pieces; subclasses say what a piece is worth."""

    def __init__(self, spaced: bool, remembered: int = REMEMBERED):
        self.spaced, self.remembered = spaced, remembered
        self.known: dict[str, object] = {}
        self.old: dict[str, object] = {}
        self.met: dict[str, object] = {}

    def worth(self, pieces: list[str]) -> list:
        raise NotImplementedError

    def made(self, pieces: list[str]) -> list:
        """Values of pieces as byte_pieces gives them."""
        return self.worth(list(map(as_text, pieces)) if self.spaced else pieces)

    def _lookup(self, pieces: list[str]) -> list:
        """Values of different pieces."""
        if len(self.known) > self.remembered:
            self.old, self.known, self.met = self.known, self.met, {}
        found = list(map(self.known.get, pieces))
        late = [k for k, v in enumerate(found) if v is None]
        if late and self.old:
            old, unknown = self.old.get, []
            for at in late:
                if (v := old(pieces[at])) is None:
                    unknown.append(at)
                else:
                    found[at] = self.known[pieces[at]] = self.met[pieces[at]] = v
            late = unknown
        if late:
            new = [pieces[at] for at in late]
            made = self.made(new)
            self.known.update(zip(new, made, strict=True))
            for at, v in zip(late, made, strict=True):
                found[at] = v
        return found

    def _cut(self, texts: list[str] | pa.Array) -> tuple[np.ndarray, np.ndarray, list[str]]:
        """(number of each piece, where each text's pieces begin and the last one's end, different pieces)."""
        column = texts.cast(pa.large_string()) if isinstance(texts, pa.Array) else pa.array(texts, pa.large_string())
        if self.spaced:
            unsure = np.nonzero(pc.match_substring_regex(column, _UNSURE_RE2).to_numpy(zero_copy_only=False))[0]
            plain = pc.binary_join_element_wise(pa.scalar(AS_IS, pa.large_string()), pc.replace_substring(column, "\n", " \n"), pa.scalar("", pa.large_string()))
            if len(unsure):
                mask = np.zeros(len(texts), bool)
                mask[unsure] = True
                plain = pc.if_else(pa.array(mask), pa.scalar("", pa.large_string()), plain)
            lists = pc.split_pattern(plain, " ")
        else:
            unsure = ()
            lists = pc.split_pattern(pc.replace_substring(column, "\n", " "), " ")
        coded = lists.values.dictionary_encode()
        numbers, offsets = coded.indices.to_numpy().astype(np.int64), lists.offsets.to_numpy().astype(np.int64)
        pieces = coded.dictionary.to_numpy(zero_copy_only=False).tolist()  # several times faster than to_pylist
        if len(unsure):
            place = {p: k for k, p in enumerate(pieces)}
            parts = np.split(numbers, offsets[1:-1])
            for k in unsure.tolist():
                parts[k] = np.array([place.setdefault(p, len(place)) for p in byte_pieces(column[k].as_py())], np.int64)
            numbers, offsets, pieces = np.concatenate(parts), np.cumsum([0, *map(len, parts)]), list(place)
        return numbers, offsets, pieces

    def joined(self, texts: list[str] | pa.Array, width: int = 4) -> list[bytes]:
        """Of each text, its pieces' values (bytes, items of a width) one after another."""
        if not len(texts):
            return []
        numbers, offsets, pieces = self._cut(texts)
        values = self._lookup(pieces)
        items = np.frombuffer(b"".join(values), f"<u{width}")
        sizes = np.array(list(map(len, values)), np.int64) // width
        begins = np.cumsum(sizes) - sizes
        own = sizes[numbers]
        ends = np.cumsum(own)
        flat = items[np.repeat(begins[numbers] - (ends - own), own) + np.arange(len(items) and int(ends[-1]) if len(ends) else 0)].tobytes()
        cuts = (np.concatenate(([0], ends))[offsets] * width).tolist()
        return [flat[a:b] for a, b in zip(cuts, cuts[1:], strict=False)]

    def sums(self, texts: list[str]) -> list[int]:
        """Of each text, the sum of its pieces' values."""
        if not texts:
            return []
        numbers, offsets, pieces = self._cut(texts)
        total = np.concatenate(([0], np.cumsum(np.array(self._lookup(pieces), np.int64)[numbers])))
        return (total[offsets[1:]] - total[offsets[:-1]]).tolist()


class LibraryIds(Pieces):
    """Ids by the tokenizers library, as little-endian unsigned 32-bit bytes.

    Pieces of letters alone are one pre-token each; they go to the library many in one text, and the ids are
    dealt back at tokens that end (or start) a word. Marks after letters are a pre-token of their own, where the
    vocabulary's pre-tokenizer says so. All other pieces go to the library one by one.
    """

    #: Words that go to the library as one text.
    TOGETHER = 2000
    #: Different runs of marks that are remembered.
    TAILS = 10_000

    def __init__(self, vocabulary: str, remembered: int = 500_000):
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_file(vocabulary_path(vocabulary))
        self.tokenizer.no_truncation()
        self.tokenizer.no_padding()
        model = json.loads(self.tokenizer.to_str())
        self.lowers = model["normalizer"] is not None and "Lowercase" in json.dumps(model["normalizer"])
        spaced = model["normalizer"] is None and model["pre_tokenizer"].get("add_prefix_space") is False
        self.suffix = model["model"].get("end_of_word_suffix")
        vocab = self.tokenizer.get_vocab()
        self.edge = np.zeros(max(vocab.values()) + 1, bool)
        self.edge[[i for t, i in vocab.items() if (t[0] == "\u0120" if spaced else t.endswith(self.suffix or "\0"))]] = True
        self.whole = spaced or bool(self.suffix)
        self.line_feed = vocab.get("\u010a", -1)
        self.tails: dict[str, bytes] = {}
        super().__init__(spaced, remembered)

    def _one_by_one(self, pieces: list[str]) -> list[bytes]:
        return [np.array(e.ids, "<u4").tobytes() for e in self.tokenizer.encode_batch_fast(pieces, add_special_tokens=False)]

    def _tail(self, marks: str) -> bytes:
        """Ids of marks that follow letters; none where they are not a pre-token of their own there."""
        text = "a" + marks
        if self.tokenizer.normalizer:
            text = self.tokenizer.normalizer.normalize_str(text)
        alone = [w for w, _ in self.tokenizer.pre_tokenizer.pre_tokenize_str(text)] == ["a", marks]
        if len(self.tails) >= self.TAILS:
            self.tails.clear()
        self.tails[marks] = self._one_by_one([marks])[0] if alone else b""
        return self.tails[marks]

    def _words(self, words: list[str], before: str = " ") -> list[bytes]:
        """Ids of words of letters, in the byte-level case with what stands before each."""
        texts = [before + before.join(words[k : k + self.TOGETHER]) for k in range(0, len(words), self.TOGETHER)]
        out: list[bytes] = []
        for k, e in enumerate(self.tokenizer.encode_batch_fast(texts, add_special_tokens=False)):
            ids = np.array(e.ids, "<u4")
            edges = np.nonzero(self.edge[ids] if before == " " else ids == self.line_feed)[0]
            own = words[k * self.TOGETHER : (k + 1) * self.TOGETHER]
            if len(edges) != len(own):
                out += self._one_by_one([before + w if self.spaced else w for w in own])
                continue
            ends = ((np.append(edges[1:], len(ids)) if self.spaced else edges + 1) * 4).tolist()
            raw = ids.tobytes()
            out += [raw[a:b] for a, b in zip([0, *ends], ends, strict=False)]
        return out

    def made(self, pieces: list[str]) -> list[bytes]:
        known, tails, lowers, any_letters = self.known.get, self.tails.get, self.lowers, self.spaced
        out: list = [None] * len(pieces)
        # of pieces of letters, by what stands before: different words; then places in out, their words, and ids of marks
        words: dict[str, dict[str, int]] = {" ": {}, "\n": {}}
        dealt: dict[str, tuple[list[int], list[int]]] = {" ": ([], []), "\n": ([], [])}
        tailed, others = [], []
        for k, piece in enumerate(pieces):
            word, before, tail = piece, " ", b""
            if not word.isalpha():
                word = piece.rstrip(_MARKS)
                if marks := piece[len(word) :]:
                    if (tail := tails(marks)) is None:
                        tail = self._tail(marks)
                    if not tail:
                        others.append(k)
                        continue
                    # the same letters without marks may be known already
                    if (v := known(word)) is not None and word.lstrip("\n").isalpha() and (any_letters or plain_letters(word)):
                        out[k] = v + tail
                        continue
                if any_letters and word[:1] == "\n":
                    word, before = word[1:], "\n"
                if not word.isalpha():
                    others.append(k)
                    continue
            if not self.whole or not (any_letters or plain_letters(word)):
                others.append(k)
                continue
            if lowers:
                word = word.lower()
            own = words[before]
            at, which = dealt[before]
            at.append(k)
            which.append(own.setdefault(word, len(own)))
            if tail:
                tailed.append((k, tail))
        for k, v in zip(others, self._one_by_one([as_text(pieces[k]) if self.spaced else pieces[k] for k in others]), strict=True):
            out[k] = v
        for before, (at, which) in dealt.items():
            found = self._words(list(words[before]), before)
            for k, w in zip(at, which, strict=True):
                out[k] = found[w]
        for k, tail in tailed:
            out[k] += tail
        return out

    def ids(self, texts: list[str] | pa.Array) -> list[bytes]:
        return self.joined(texts)


_made: dict[tuple, object] = {}


def once(kind, *args):
    """An object of a kind, kept for a worker's later tasks until another kind is asked for: one table at a time."""
    if (kind, args) not in _made:
        _made.clear()
        tidy()
        _made[kind, args] = kind(*args)
    return _made[kind, args]


def forget() -> None:
    """For tasks that need no such object, but may run in a worker that has one."""
    if _made:
        _made.clear()
        tidy()


def tidy() -> None:
    """Gives memory that is no longer used back to the machine, as a worker lives through many stages."""
    gc.collect()
    pa.default_memory_pool().release_unused()
    with contextlib.suppress(OSError, AttributeError):
        ctypes.CDLL(None).malloc_trim(0)
