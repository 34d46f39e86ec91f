"""Operators and the pipeline against plain versions, and on tables with nulls, repeated rows, long and empty texts."""

import hashlib
import random
import re
import zlib
from collections import defaultdict

import numpy as np
import pytest
from test_dedup import brute_near, brute_passages
from test_names import NAMES

from gleanguard.llm import fingerprints as fp
from gleanguard.llm.bpe_codec import encode_decode, encoding_digests
from gleanguard.llm.common import scratch
from gleanguard.llm.exact_dedup import drop_duplicates, duplicate_groups
from gleanguard.llm.ngram_join import drop_near_duplicates, near_duplicates
from gleanguard.llm.packing import pack
from gleanguard.llm.records import read_records, write_records
from gleanguard.llm.sharding import write_shards
from gleanguard.llm.suffix_dedup import drop_repeated_passages, repeated_passages
from gleanguard.llm.token_counts import count_tokens
from gleanguard.llm.toxicity import FactorizationMachine, Terms, drop_toxic, score, train

M = (1 << 64) - 1


def plain_mixed(h):
    h = ((h ^ (h >> 33)) * 0xFF51AFD7ED558CCD) & M
    h = ((h ^ (h >> 33)) * 0xC4CEB9FE1A85EC53) & M
    return h ^ (h >> 33)


def plain_syncmers(text, k=16, s=8):
    """Places and hashes by the definition: each k-mer's s-mers one by one."""
    codes = [ord(c) + 1 for c in text]
    value = lambda at: sum(c * pow(0x9E3779B97F4A7C15, s - 1 - j, 1 << 64) for j, c in enumerate(codes[at : at + s])) & M
    out = []
    for at in range(len(codes) - k + 1):
        ranks = [plain_mixed(value(at + j)) for j in range(k - s + 1)]
        if min(ranks) in (ranks[0], ranks[-1]):
            out.append((at, plain_mixed((value(at) * 0xD6E8FEB86659FD93 + value(at + s)) & M)))
    return out


def plain_sketch(text, size=fp.SKETCH):
    """{hash: first place} of the smallest hashes, places in units, and the unit."""
    first, unit = {}, 0
    for at, h in plain_syncmers(text):
        first.setdefault(h >> 32, at)
    while len(text) >> unit > 255:
        unit += 1
    return {h: first[h] >> unit for h in sorted(first)[:size]}, unit


def plain_likeness(a, b, size=fp.SKETCH):
    (a, one), (b, two) = plain_sketch(a), plain_sketch(b)
    union = sorted({*a, *b})[:size]
    shift = {h: (b[h] << two) - (a[h] << one) for h in union if h in a and h in b}
    if len(a) == 1 or len(b) == 1:
        return len(shift) / len(union)
    near = lambda h: any(g != h and abs(shift[g] - shift[h]) <= fp.TOLERANCE << max(one, two) for g in shift)
    return sum(near(h) for h in shift) / len(union)


def test_fingerprints_by_their_definition(spark):
    rng = random.Random(11)
    words = ["".join(rng.choice("abcdé") for _ in range(rng.randint(1, 7))) for _ in range(60)]
    texts = [" ".join(rng.choice(words) for _ in range(n)) for n in (8, 30, 60, 120)] + ["a" * 40, "ab" * 30]
    for t in texts:
        at, hashes = fp.anchors(t)
        assert list(zip(at.tolist(), hashes.tolist(), strict=True)) == plain_syncmers(t)
    rows = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    for r in fp.fingerprint_documents(rows).collect():
        t, n = texts[r["doc_id"]], texts[(r["doc_id"] - 1) % len(texts)]
        low, unit = plain_sketch(t)
        assert r["fingerprint"] == f"{unit:02x}" + "".join(f"{h:08x}" for h in low) + "".join(f"{p:02x}" for p in low.values())
        half = len(t) // 2
        assert abs(r["near_edited"] - plain_likeness(t, t[: len(t) - half] + n[:half])) < 1e-9
        assert abs(r["near_next"] - plain_likeness(t, n)) < 1e-9


def test_likeness_goes_by_position():
    rng = random.Random(13)
    drawn = lambda n: "".join(rng.choices("abcdefghijkl ", k=n))
    passage = drawn(800)
    one, two = passage + drawn(300), drawn(500) + passage
    assert abs(fp.likeness(fp.sketch(one), fp.sketch(two)) - plain_likeness(one, two)) < 1e-9
    assert fp.likeness(fp.sketch(one), fp.sketch(two)) > 0.3  # moved as a whole
    shared = [passage[k : k + 40] for k in range(0, 800, 40)]
    rng.shuffle(shared)
    torn = "".join(x + drawn(rng.randint(0, 150)) for x in shared)
    assert fp.likeness(fp.sketch(passage), fp.sketch(torn)) < len(set(fp.sketch(passage).hashes) & set(fp.sketch(torn).hashes)) / fp.SKETCH
    for n in (1, 15, 16, 20, 22, 255, 256, 5000, 70_000):
        t, other = fp.sketch(drawn(n)), fp.sketch(drawn(n))
        assert len(t.hashes) and fp.likeness(t, t) == 1 and fp.likeness(t, other) < 0.1
    bare = [t for t in (drawn(16) for _ in range(60)) if not plain_syncmers(t)]
    assert len({fp.packed(fp.sketch(t)) for t in bare}) == len(bare) > 1  # without a syncmer, and told apart


def test_fingerprints_of_a_long_text(spark):
    rng = random.Random(12)
    long = "".join(rng.choices("abcdefgh ijkl", k=400_000))
    docs = spark.createDataFrame([(2, long), (1, long[:-1]), (0, "other")], "doc_id long, text string")
    got = {r["doc_id"]: r for r in fp.fingerprint_documents(docs).collect()}
    assert got[2]["n_chars"] == 400_000 and got[2]["near_next"] > 0.9 and got[1]["near_next"] == 0


def test_logits_are_the_sum_over_pairs():
    rng = np.random.default_rng(5)
    m = FactorizationMachine()
    m.bias, m.at = -1.25, np.sort(rng.choice(5000, 300, replace=False))
    m.w, m.v = rng.normal(0, 1, 300).astype(np.float32), rng.normal(0, 0.5, (300, 4)).astype(np.float32)
    rows = [np.sort(rng.choice(5000, n, replace=False)).astype(np.uint32) for n in (0, 1, 40, 400)]
    place = {int(p): k for k, p in enumerate(m.at)}
    for row, got in zip(rows, m.logits(rows), strict=True):
        own = [place[int(p)] for p in row if int(p) in place]
        pairs = sum(float(m.v[i].astype(float) @ m.v[j].astype(float)) for x, i in enumerate(own) for j in own[x + 1 :])
        assert abs(got - (m.bias + float(m.w[own].astype(float).sum()) + pairs)) < 1e-6
    again = FactorizationMachine.unpacked(m.packed())
    assert np.array_equal(again.logits(rows), m.logits(rows))


def test_training_sample_is_bounded_and_has_one_row_of_an_id(spark):
    """An id in a third of the rows weighs as one row; the same rows in any order give the same model."""
    rng = random.Random(6)
    rows = [(k, " ".join(f"w{rng.randrange(60)}" for _ in range(12)) + (" vile" if k % 4 == 0 else "")) for k in range(600)]
    labels = spark.createDataFrame([(k, int(k % 4 == 0)) for k in range(600)] + [(None, 1), (7, None)], "doc_id long, toxic int")
    schema = "doc_id long, text string"
    one = train(spark.createDataFrame(rows, schema), labels)
    many = train(spark.createDataFrame([*([rows[1]] * 300), *rows[::-1], (None, "vile")], schema).repartition(5), labels)
    assert one.packed() == many.packed() and (one.w != 0).any()
    terms = Terms()
    assert train(spark.createDataFrame(rows, schema), labels, most=0).packed() == FactorizationMachine().packed()
    few = train(spark.createDataFrame(rows, schema), labels, rows=100, most=5000)
    assert few.packed() == train(spark.createDataFrame(rows[::-1], schema), labels, rows=100, most=5000).packed() and len(terms.places(["a"])) == 1


OPERATORS = {
    "pack": lambda df: pack(df).select("doc_id", "start").where("start = 0"),
    "fingerprint_documents": fp.fingerprint_documents,
    "score": lambda df: score(df, FactorizationMachine()),
    "count_tokens": count_tokens,
    "near_duplicates": near_duplicates,
    "records": lambda df: read_records(write_records(df, scratch(df.sparkSession, "test"))),
    "duplicate_groups": duplicate_groups,
    "encode_decode": encode_decode,
    "encoding_digests": encoding_digests,
    "write_shards": lambda df: write_shards(df, scratch(df.sparkSession, "test")),
    "repeated_passages": repeated_passages,
}
DROPS = {"drop_toxic": lambda df: drop_toxic(df, FactorizationMachine()), "drop_duplicates": drop_duplicates, "drop_near_duplicates": drop_near_duplicates, "drop_repeated_passages": drop_repeated_passages}
LONG = "A long text, of very many words. " * 20_000


@pytest.fixture(scope="module")
def odd(spark):
    rows = [(None, None), (None, None), (None, "x"), (3, ""), (3, ""), (3, "again"), (3, "again"), (4, LONG), (5, LONG), (6, "\0   ä😀"), (-1, " \n\t ")]
    return spark.createDataFrame([(i, t, *(n for n in NAMES)) for i, t in rows], "doc_id long, text string, " + ", ".join(f"`{n}` string" for n in NAMES))


@pytest.mark.parametrize("name", OPERATORS)
def test_every_row_has_its_result(odd, name):
    out = OPERATORS[name](odd)
    got = sorted((r["doc_id"] is None, r["doc_id"] or 0) for r in out.collect())
    assert got == sorted((r["doc_id"] is None, r["doc_id"] or 0) for r in odd.select("doc_id").collect())
    assert OPERATORS[name](odd.limit(0)).count() == 0


@pytest.mark.parametrize("name", DROPS)
def test_odd_rows_stay_or_go(odd, name):
    texts = sorted(str(r["text"])[:9] for r in DROPS[name](odd).select("text").collect())
    every = [str(r["text"])[:9] for r in odd.select("text").collect()]
    want = {
        "drop_toxic": every, "drop_repeated_passages": ["" if t.startswith("A long") else t for t in every],
        # null and empty texts are copies of each other, the smallest id stays; white space is one space, and no words for the join
        "drop_duplicates": ["", "x", "again", "A long te", "\0   ä😀", " \n\t "], "drop_near_duplicates": [" \n\t ", "x", "again", "A long te", "\0   ä😀"],
    }[name]
    assert texts == sorted(want)
    assert DROPS[name](odd.limit(0)).count() == 0


def test_pipeline_against_plain_stages(spark, tmp_path):
    import corpus_pipeline
    from tokenizers import Tokenizer

    from gleanguard.llm.tokens import vocabulary_path

    rng = random.Random(21)
    words = lambda n: " ".join("".join(rng.choice("abcdefgh") for _ in range(5)) for _ in range(n))
    passage, texts = words(60), [words(rng.choice([3, 30, 80])) for _ in range(160)]
    for k in range(0, 160, 8):
        texts[k] += " vile scum"
    for k in range(20):
        copy = texts[k].split()
        copy[rng.randrange(len(copy))] = "other"
        texts += [texts[k].replace(" ", "\t ", 1), " ".join(copy)]
    texts += [f"{words(20)} {passage} {words(9)}" for _ in range(4)] + ["", None, None, "   "]
    ids = [*range(len(texts) - 2), None, None]
    schema = "doc_id long, text string, lang string, source string, n_chars long"
    folder = str(tmp_path)
    spark.createDataFrame([(i, t, "en", "s", len(t or "")) for i, t in zip(ids, texts, strict=True)], schema).write.parquet(f"{folder}/documents.parquet")
    spark.createDataFrame([(k, int(k % 8 == 0), 1) for k in range(160)], "doc_id long, toxic int, quality int").write.parquet(f"{folder}/labels.parquet")
    given, tables = spark.read.parquet(f"{folder}/documents.parquet"), []
    for k, (_, stage) in enumerate(corpus_pipeline.STAGES):
        stage(spark, given, folder).write.parquet(f"{folder}/{k}")
        given = spark.read.parquet(f"{folder}/{k}")
        tables.append(given.collect())
    order = lambda r: (r["doc_id"] is None, r["doc_id"] or 0)
    before = sorted(spark.read.parquet(f"{folder}/documents.parquet").collect(), key=order)
    model = train(spark.read.parquet(f"{folder}/documents.parquet"), spark.read.parquet(f"{folder}/labels.parquet"))
    z = model.scores(Terms().places([r["text"] or "" for r in before]))
    pairs = lambda rows: sorted(((r["doc_id"], r["text"]) for r in rows), key=str)
    before = [r for r, s in zip(before, z, strict=True) if s < 0.5]
    assert pairs(tables[0]) == pairs(before) and len(before) < len(texts) - 15
    first = {}
    for r in before:
        first.setdefault(re.sub(r"[\x20\x09-\x0D]+", " ", r["text"] or ""), r)
    before = sorted(first.values(), key=order)
    assert pairs(tables[1]) == pairs(before)
    classes = brute_near([r["text"] for r in before])
    before = [r for k, r in enumerate(before) if classes[k][0] == k]
    assert pairs(tables[2]) == pairs(before)
    kept = brute_passages([r["text"] for r in before])
    want = {r["doc_id"]: kept[k][3] for k, r in enumerate(before)}
    assert {r["doc_id"]: hashlib.sha256((r["text"] or "").encode()).hexdigest() for r in tables[3]} == want
    library = Tokenizer.from_file(vocabulary_path("word_bpe_49k.json"))
    pieces = defaultdict(list)
    for r in tables[4]:
        pieces[r["doc_id"]].append(r)
    assert set(pieces) == {r["doc_id"] for r in tables[3]}
    for r in tables[3]:
        own = np.array([*library.encode(r["text"] or "", add_special_tokens=False).ids, 2], "<u4")
        at = 0
        for p in sorted(pieces[r["doc_id"]], key=lambda p: p["start"]):
            assert p["start"] == at and p["doc_tokens"] == len(own) and p["ids_crc32"] == zlib.crc32(own[at : at + p["length"]].tobytes())
            at += p["length"]
        assert at == len(own)


def test_pipeline_of_an_empty_table(spark, tmp_path):
    import corpus_pipeline

    spark.createDataFrame([], "doc_id long, text string, lang string, source string, n_chars long").write.parquet(str(tmp_path / "documents.parquet"))
    spark.createDataFrame([], "doc_id long, toxic int, quality int").write.parquet(str(tmp_path / "labels.parquet"))
    assert corpus_pipeline.run(spark, str(tmp_path)).count() == 0
