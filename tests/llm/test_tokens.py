"""Encoding, counting, records, the codec and packing against the tokenizers library, piece by piece."""

import random
import zlib

import numpy as np
import public_tokenizers
import pytest
from tokenizers import Tokenizer

from gleanguard.llm.bpe_codec import ForcedBoundaryCodec, encode_decode, encoding_digests
from gleanguard.llm.common import scratch
from gleanguard.llm.packing import Packer, best_cuts, pack
from gleanguard.llm.records import frame, masked, read_at, read_index, read_records, unframe, write_records
from gleanguard.llm.token_counts import PieceCounts, count_tokens
from gleanguard.llm.tokens import LibraryIds

BYTES, WORDS = "byte_bpe_50k.json", "word_bpe_49k.json"
ODD = ["", " ", "  ", "a  b", " a   b ", "x\n y", "\n \n z", "a\n\nb", "'s it's !'s", "<|endoftext|> a<|endoftext|>b  <|endoftext|>", "a\x1cb \x1c c", "\0a \0b", "Σίσυφος ΣΑΣ", "é é İ",
       "　 x\xa0y", "日本語テスト ", "aaaa" * 50, "1234 5 67", "a\r\n b\t c", "don't DON'T 'tis ''s", "<|startoftext|>hi", "!!! ... ???", "ok​ z", "ჯ ჯჯ  ჯ", "x  ", "x \n", "Word. word, WORD."]


def texts():
    rng = random.Random(7)
    return ODD + ["".join(rng.choice(" \n\t'sta1.!éß<|>ჯ\xa0éT") for _ in range(rng.randint(0, 40))) for _ in range(2000)]


def library(name):
    t = Tokenizer.from_file(public_tokenizers.path(name))
    return t, lambda x: t.encode(x, add_special_tokens=False).ids


def ids_of(raw):
    return np.frombuffer(raw, "<u4").tolist()


@pytest.mark.parametrize("name", [BYTES, WORDS])
def test_pieces_give_the_librarys_ids(name):
    _, reference = library(name)
    encoder = LibraryIds(name)
    for _ in range(2):  # also with all pieces known
        assert [ids_of(b) for b in encoder.ids(texts())] == [reference(t) for t in texts()]


@pytest.mark.parametrize("name", [BYTES, WORDS])
def test_known_words_before_stops(name):
    _, reference = library(name)
    encoder = LibraryIds(name)
    for block in (["x Word word\nWord", "Word word\nword"], ["Word. Word, word.\nWord.\nword, ", "word.", "Word,"]):
        assert [ids_of(b) for b in encoder.ids(block)] == [reference(t) for t in block]


@pytest.mark.parametrize("name", [BYTES, WORDS])
def test_marks_behind_letters(name):
    _, reference = library(name)
    encoder = LibraryIds(name)
    encoder.TAILS = 20
    rng = random.Random(9)
    words = ["Word", "word", "É", "İ", "Σς", "a\u0301", "don", "<|endoftext", "x9", ""]
    some = ["".join(rng.choice(" \n") + rng.choice(words) + "".join(rng.choice("!\"#$%&'()*+,-./:;<=>?@[\\]^_`{|}~") for _ in range(rng.randint(0, 3))) for _ in range(6)) for _ in range(3000)]
    for block in (words, some[:10], some):
        assert [ids_of(b) for b in encoder.ids(block)] == [reference(t) for t in block]


def test_pieces_survive_a_full_table():
    _, reference = library(WORDS)
    encoder = LibraryIds(WORDS)
    encoder.remembered = 50
    for k in range(0, len(texts()), 100):
        block = texts()[k : k + 100]
        assert [ids_of(b) for b in encoder.ids(block)] == [reference(t) for t in block]


def test_codec_round_trip_is_the_librarys():
    t, reference = library(BYTES)
    codec = ForcedBoundaryCodec(BYTES)
    encoded = codec.encode(texts())
    assert [ids_of(b) for b in encoded] == [reference(x) for x in texts()]
    assert [codec.decode(b) for b in encoded] == [t.decode(ids_of(b), skip_special_tokens=False) for b in encoded]


def test_codec_decodes_broken_bytes_as_the_library_does():
    t, _ = library(BYTES)
    codec = ForcedBoundaryCodec(BYTES)
    broken = np.array([reference for reference in (0, 222, 50256, 160, 1234)], "<u4").tobytes()
    assert codec.decode(broken) == t.decode(ids_of(broken), skip_special_tokens=False)


@pytest.mark.parametrize("name", [WORDS, BYTES])
def test_rank_merging_counts(name):
    _, reference = library(name)
    counter = PieceCounts(name)
    assert counter.sums(texts()) == [len(reference(t)) for t in texts()]


def frame_of(spark, rows, schema="doc_id long, text string"):
    return spark.createDataFrame(rows, schema)


def test_counts_of_nulls_and_repeated_rows(spark):
    rows = [(1, None), (1, None), (None, "a b"), (2, ""), (3, "word " * 3000)]
    out = sorted(map(tuple, count_tokens(frame_of(spark, rows)).collect()), key=str)
    assert out == sorted([(1, 0, 0, False), (1, 0, 0, False), (None, 3, 2, False), (2, 0, 0, False), (3, 15000, 3000, True)], key=str)
    assert count_tokens(frame_of(spark, [])).count() == 0


def test_digests_match_real_outputs(spark):
    import hashlib

    rows = [(k, t) for k, t in enumerate([None, *ODD])]
    df = spark.createDataFrame([(*r, "x") for r in rows], "doc_id long, text string, ids string")
    real = {r["doc_id"]: r for r in encode_decode(df).collect()}
    for r in encoding_digests(df).collect():
        own = real[r["doc_id"]]
        assert r["n_tokens"] == len(own["ids"])
        assert r["ids_sha256"] == hashlib.sha256(np.array(own["ids"], "<u4").tobytes()).hexdigest()
        assert own["decoded"] == (rows[r["doc_id"]][1] or "")


def test_records_round_trip_and_index(spark):
    rows = [(k, t) for k, t in enumerate([None, *texts()[:300]])] + [(None, "no id"), (3, "twice"), (3, "twice")]
    df = frame_of(spark, rows)
    _, reference = library(BYTES)
    files = write_records(df, scratch(spark, "test"))
    out = read_records(files).collect()
    assert len(out) == len(rows)
    expect, at = [], 0
    for i, t in sorted(rows, key=lambda r: (r[0] is not None, r[0] or 0, r[1] or "")):
        ids = reference(t or "") + [2]
        expect.append((i, at, len(ids), zlib.crc32(np.array(ids, "<u4").tobytes())))
        at += len(ids)
    assert sorted(map(tuple, out), key=lambda r: r[1]) == expect
    import pyarrow.fs as pafs

    first = files.orderBy("part").first()
    fs, name = pafs.FileSystem.from_uri(first["path"])
    index = read_index(fs, name)
    order = np.random.default_rng(1).permutation(len(index))
    shuffled = list(read_at(fs, name, index[order]))
    assert [b for _, _, b in shuffled] == index[order]["before"].tolist()
    assert read_records(write_records(frame_of(spark, []), scratch(spark, "test"))).count() == 0


def test_records_find_damage():
    data = bytearray(frame(b"payload"))
    assert unframe(bytes(data), 0, 7) == b"payload"
    assert masked(b"a") != zlib.crc32(b"a")
    data[14] ^= 1
    with pytest.raises(ValueError):
        unframe(bytes(data), 0, 7)


def brute_cost(places, penalty, window):
    best = [0] + [1 << 60] * (len(places) - 1)
    for j in range(1, len(places)):
        for i in range(j):
            if places[j] - places[i] <= window:
                best[j] = min(best[j], best[i] + window - (places[j] - places[i]) + penalty[j])
    return best[-1]


def test_best_cuts_are_optimal():
    rng = random.Random(3)
    for _ in range(300):
        places = [0]
        for _ in range(rng.randint(1, 30)):
            places.append(places[-1] + rng.randint(1, 10))
        penalty = [0] + [rng.choice([0, 1, 3]) for _ in places[1:]]
        window = rng.randint(10, 25)
        cuts = best_cuts(places, penalty, window)
        cost, last = 0, 0
        for j in cuts:
            assert places[j] - places[last] <= window
            cost += window - (places[j] - places[last]) + penalty[j]
            last = j
        assert last == len(places) - 1 and cost == brute_cost(places, penalty, window)


def test_packer_in_small_blocks():
    rng = random.Random(5)
    is_end = np.zeros(20, bool)
    is_end[5] = True
    docs = [(k, [rng.randrange(10) for _ in range(rng.choice([0, 1, 7, 60, 400]))] + [2]) for k in range(200)]
    for block in (50, 1000, 10**9):
        packer = Packer(is_end, 64, 0, block)
        rows = []
        for k, ids in docs:
            rows += packer.add(k, np.array(ids, "<u4").tobytes())
        rows += packer.plan(True)
        check_pieces(rows, dict(docs), 64)


def check_pieces(rows, docs, window):
    at, sequences = {}, {}
    for d, start, length, crc, whole, sequence, offset, padded in rows:
        ids = docs[d]
        assert start == at.get(d, 0) and whole == len(ids) and length > 0
        assert crc == zlib.crc32(np.array(ids[start : start + length], "<u4").tobytes())
        at[d] = start + length
        sequences.setdefault(sequence, []).append((offset, length, padded))
    assert at == {d: len(ids) for d, ids in docs.items()}
    for parts in sequences.values():
        end = 0
        for offset, length, _ in sorted(parts):
            assert offset == end
            end += length
        assert end <= window and parts[0][2] in (window, end)


def test_packing_of_a_table(spark):
    rows = [(k, t) for k, t in enumerate([None, *ODD, "Some words. " * 3000, "x" * 20000])]
    _, reference = library(WORDS)
    out = pack(frame_of(spark, rows), window=256).collect()
    check_pieces(sorted(map(tuple, out)), {i: reference(t or "") + [2] for i, t in rows}, 256)
    assert pack(frame_of(spark, [])).count() == 0
    twice = pack(frame_of(spark, [(1, "a b"), (1, "a b"), (None, "c")])).collect()
    assert len(twice) == 3 and sum(r["length"] for r in twice) == 8
