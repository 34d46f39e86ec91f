"""Exact and near duplicates, repeated passages, components and sharding against plain versions."""

import hashlib
import random
import zlib
from collections import Counter, defaultdict

import numpy as np
import pytest

from gleanguard.llm import suffix_dedup
from gleanguard.llm.common import scratch
from gleanguard.llm.components import components
from gleanguard.llm.exact_dedup import drop_duplicates, duplicate_groups
from gleanguard.llm.ngram_join import banding, drop_near_duplicates, near_duplicates
from gleanguard.llm.sharding import write_shards
from gleanguard.llm.suffix_dedup import drop_repeated_passages, repeated_passages

SCHEMA = "doc_id long, text string, lang string, source string, n_chars long, block string"


def docs_of(spark, texts):
    return spark.createDataFrame([(k, t, None, "hot", None, "x") for k, t in enumerate(texts)], SCHEMA)


def test_exact_groups(spark):
    texts = ["a b", "a\t\n b", None, "", " ", "b", "b", "c"] + ["hot"] * 50
    want = defaultdict(list)
    import re

    for k, t in enumerate(texts):
        want[re.sub(r"[\x20\x09-\x0D]+", " ", t or "")].append(k)
    rows = {r["doc_id"]: r for r in duplicate_groups(docs_of(spark, texts)).collect()}
    for norm, ids in want.items():
        for i in ids:
            assert (rows[i]["keep_id"], rows[i]["group_size"], rows[i]["kept"]) == (ids[0], len(ids), i == ids[0])
            assert rows[i]["text_sha256"] == hashlib.sha256(norm.encode()).hexdigest()
    kept = drop_duplicates(docs_of(spark, texts))
    assert kept.columns == [c.split()[0] for c in SCHEMA.split(", ")]
    assert sorted(r["doc_id"] for r in kept.collect()) == sorted(ids[0] for ids in want.values())


def test_exact_nulls_and_repeated_rows(spark):
    df = spark.createDataFrame([(None, "a"), (5, "a"), (5, "a"), (None, "z"), (None, "z")], "doc_id long, text string")
    rows = duplicate_groups(df).collect()
    assert Counter((r["text_sha256"], r["kept"]) for r in rows if r["kept"]).most_common(1)[0][1] == 1
    assert {r["keep_id"] for r in rows if r["group_size"] == 3} == {5}
    assert sorted(r["text"] for r in drop_duplicates(df).collect()) == ["a", "z"]
    assert duplicate_groups(df.limit(0)).count() == 0 and drop_duplicates(df.limit(0)).count() == 0


def test_exact_in_slices_moves_less_than_a_group_by(spark, monkeypatch):
    """With a filter of many slices, several scans: same rows, no row dealt to meet the filter."""
    from gleanguard.llm import exact_dedup

    texts = [f"text {k % 9000}" for k in range(10_000)]
    df = docs_of(spark, texts).repartition(4)
    want = sorted(map(tuple, duplicate_groups(df).collect()))
    monkeypatch.setattr(exact_dedup, "SLICE_BYTES", 4096)
    monkeypatch.setattr(exact_dedup, "SLICES_A_SCAN", 4)
    assert exact_dedup.slices_for(exact_dedup.blocks_for(len(texts))) > 8
    got = duplicate_groups(df)
    plan = got._jdf.queryExecution().executedPlan().toString()
    assert "Python" not in plan and "Arrow" not in plan
    assert sorted(map(tuple, got.collect())) == want
    kept = [k for k in range(10_000) if k < 9000]
    assert sorted(r["doc_id"] for r in drop_duplicates(df).collect()) == kept
    keys = spark.createDataFrame([(f"k{k}",) for k in range(20_000)], "k string").repartition(4)
    blocks = exact_dedup.blocks_for(20_000)
    marked = exact_dedup.with_alarm(keys, "k", exact_dedup.filter_of(keys, "k", blocks, 2), blocks, "alarm")
    assert "hashpartitioning" not in marked._jdf.queryExecution().executedPlan().toString()
    assert 0 < marked.where("alarm").count() < 20_000 * 0.06  # all different: false alarms alone


def test_components(spark):
    rng = random.Random(2)
    edges = {(a, b) for a, b in ((rng.randrange(300), rng.randrange(300)) for _ in range(220)) if a != b} | {(k, k + 1) for k in range(400, 460)}
    parent = {}

    def root(x):
        while parent.setdefault(x, x) != x:
            x = parent[x]
        return x

    for a, b in edges:
        a, b = root(a), root(b)
        parent[max(a, b)] = min(a, b)
    df = spark.createDataFrame(sorted(edges), "a long, b long")
    assert {r["node"]: r["root"] for r in components(df).collect()} == {x: root(x) for e in edges for x in e}
    assert components(df.limit(0)).count() == 0


def near_texts():
    rng = random.Random(4)
    word = lambda: "".join(rng.choice("abcdefgh") for _ in range(5))
    texts = [" ".join(word() for _ in range(rng.choice([3, 5, 40, 120]))) for _ in range(60)]
    for base in range(6):
        for _ in range(12):
            words = texts[base * 3].split()
            for _ in range(rng.choice([0, 1, 2, 4])):
                words[rng.randrange(len(words))] = word()
            texts.append(" ".join(words))
    hot = [word() for _ in range(150)]
    for _ in range(300):  # a group larger than a block
        words = list(hot)
        words[rng.randrange(150)] = word()
        texts.append(" ".join(words))
    return [*texts, None, "", "  \n", "one", "one", "one two"]


def brute_near(texts):
    sets = []
    for t in texts:
        w = (t or "").split()
        n = min(5, len(w))
        sets.append(frozenset(tuple(w[k : k + n]) for k in range(len(w) - n + 1)) if w else frozenset())
    root = list(range(len(texts)))

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    links = [0] * len(texts)
    for a in range(len(texts)):
        for b in range(a + 1, len(texts)):
            union = len(sets[a] | sets[b])
            if union == 0 or len(sets[a] & sets[b]) >= 0.8 * union - 1e-9:
                links[a] += 1
                links[b] += 1
                x, y = find(a), find(b)
                root[max(x, y)] = min(x, y)
    return {k: (find(k), links[k]) for k in range(len(texts))}


def test_near_duplicates_against_all_pairs(spark):
    texts = near_texts()
    want = brute_near(texts)
    got = {r["doc_id"]: (r["class_id"], r["n_links"]) for r in near_duplicates(docs_of(spark, texts)).collect()}
    assert len(got) == len(texts)
    wrong = [k for k in want if got[k] != want[k]]
    assert len(wrong) <= 0.01 * len(texts)  # the target recall
    kept = sorted(r["doc_id"] for r in drop_near_duplicates(docs_of(spark, texts)).collect())
    assert kept == sorted({c for c, _ in got.values()})


def test_near_duplicates_edges(spark):
    df = spark.createDataFrame([(None, "a b c d e f"), (7, "a b c d e f"), (7, "other words stand here for once"), (8, "other words stand here for once")], "doc_id long, text string")
    rows = near_duplicates(df).collect()
    assert len(rows) == 4 and {r["class_id"] for r in rows} == {7} and all(r["n_links"] == 1 for r in rows)
    assert near_duplicates(df.limit(0)).count() == 0
    bands, rows_ = banding(0.8, 0.999, 160)
    assert 1 - (1 - 0.8**rows_) ** bands >= 0.999 and bands * rows_ <= 160


def passage_texts():
    rng = random.Random(6)
    rand = lambda n: "".join(rng.choice("abcdefghij klmnopä") for _ in range(n))
    shared = [rand(n) for n in (150, 199, 200, 201, 260, 500, 1000)]
    texts = [rand(rng.choice([0, 50, 300, 900])) + rng.choice(shared) + rand(rng.choice([0, 1, 120])) + rng.choice(shared) for _ in range(60)]
    base = rand(1500)
    for _ in range(15):
        k = rng.randrange(len(base))
        texts.append(base[:k] + "X" + base[k + 1 :])
    return [*texts, None, "", "short", "a" * 450, "ab" * 300, "a" * 199, "€" * 90, texts[0], texts[0]]


def brute_passages(texts, length=200):
    raws = [(t or "").encode() for t in texts]
    seen = Counter(r[k : k + length] for r in raws for k in range(len(r) - length + 1))
    out = {}
    for i, r in enumerate(raws):
        gone = np.zeros(len(r), bool)
        for k in range(len(r) - length + 1):
            if seen[r[k : k + length]] > 1:
                gone[k : k + length] = True
        kept = bytes(b for b, g in zip(r, gone.tolist()) if not g)
        spans = int(np.count_nonzero(gone[1:] & ~gone[:-1]) + (gone[0] if len(gone) else 0))
        out[i] = (len(r), int(gone.sum()), spans, hashlib.sha256(kept).hexdigest())
    return out


def test_repeated_passages_against_all_windows(spark):
    texts = passage_texts()
    got = {r["doc_id"]: tuple(r)[1:] for r in repeated_passages(docs_of(spark, texts)).collect()}
    assert got == brute_passages(texts)


def test_repeated_passages_in_slices(spark, monkeypatch):
    monkeypatch.setattr(suffix_dedup, "SLICE", 1 << 10)
    raw = ("x" * 3000 + "abc" * 900).encode()
    ends = [int(s[-1] + (n[-1] >> 16)) for s, n in [suffix_dedup.runs(raw)[2:]]]
    assert ends == [len(raw) - 199]


def test_dropping_passages_keeps_characters_whole(spark):
    texts = passage_texts()
    rows = {r["doc_id"]: r for r in drop_repeated_passages(docs_of(spark, texts)).collect()}
    assert len(rows) == len(texts)
    for i, (n, gone, _, sha) in brute_passages(texts).items():
        t = rows[i]["text"]
        if not gone:
            assert t == texts[i]
        else:
            assert n - gone <= len(t.encode()) <= n - gone + 6
            assert rows[i]["n_chars"] == len(t)
    assert repeated_passages(docs_of(spark, ["a"]).limit(0)).count() == 0


def test_shards(spark, tmp_path):
    """Against a plain dealing of each bucket; null, repeated and tied rows, and one text in a third of all rows."""
    from gleanguard.llm.sharding import op9_sharding

    texts = [None, "", "ä"] + [f"text {k}" * (k % 7) for k in range(500)] + ["hot"] * 250
    ids = [None if k >= 503 else k // 2 for k in range(len(texts))]
    spark.createDataFrame(list(zip(ids, texts, strict=True)), "doc_id long, text string").repartition(3).write.parquet(str(tmp_path / "documents.parquet"))
    docs = spark.read.parquet(str(tmp_path / "documents.parquet"))
    rows = write_shards(docs, scratch(spark, "test"), bucket_bytes=1000, is_scan=True).collect()
    pairs = lambda rows_: Counter((r["doc_id"], r["text"]) for r in rows_)
    assert pairs(rows) == Counter(zip(ids, texts, strict=True))
    by = defaultdict(list)
    for r in rows:
        by[r["shard"]].append(r["slot"])
    assert set(by) == set(range(8))
    assert all(sorted(s) == list(range(len(s))) for s in by.values())
    assert max(map(len, by.values())) - min(map(len, by.values())) <= 1
    again = write_shards(docs, scratch(spark, "test"), bucket_bytes=1000, is_scan=True).collect()
    assert sorted(map(tuple, again), key=str) == sorted(map(tuple, rows), key=str)
    other = write_shards(docs, scratch(spark, "test"), seed=7, bucket_bytes=1000, is_scan=True).collect()
    assert sorted(map(tuple, other), key=str) != sorted(map(tuple, rows), key=str)
    order = [r["doc_id"] for r in sorted(rows, key=lambda r: (r["slot"], r["shard"])) if r["doc_id"] is not None]
    assert abs(np.corrcoef(order, range(len(order)))[0, 1]) < 0.2
    hot = np.bincount([r["shard"] for r in rows if r["text"] == "hot"], minlength=8)
    assert hot.max() - hot.min() < 30
    out = op9_sharding(spark, str(tmp_path)).collect()
    want = Counter((i, len((t or "").encode()) + 1, zlib.crc32((t or "").encode()), "rows", None) for i, t in zip(ids, texts, strict=True))
    assert Counter((r["doc_id"], r["size"], r["text_crc32"], r["law"], r["grown_shard"]) for r in out) == want
    assert sorted((r["slot"], r["shard"]) for r in out) == [(k // 8, k % 8) for k in range(len(texts))]
    assert write_shards(docs.limit(0), scratch(spark, "test")).count() == 0
    long = spark.createDataFrame([(1, "x" * 3_000_000), (1, "x" * 3_000_000), (2, None)], "doc_id long, text string")
    assert [len(r["text"] or "") for r in write_shards(long, scratch(spark, "test"), bucket_bytes=1000).orderBy("doc_id").collect()] == [3_000_000, 3_000_000, 0]


def test_buckets_are_dealt_by_fisher_yates(spark, tmp_path):
    """One bucket: the sorted records in numpy's order, dealt round the shards."""
    from gleanguard.llm.sharding import SEED

    texts = [f"t{k}" for k in range(90)]
    docs_of(spark, texts).select("doc_id", "text").coalesce(1).write.parquet(str(tmp_path / "d"))
    scan = spark.read.parquet(str(tmp_path / "d"))
    from pyspark.sql import functions as F

    from gleanguard.llm.common import placed

    _, file, row = placed(scan, True)
    given = [r["doc_id"] for r in scan.select("doc_id", F.xxhash64(file, row, F.lit(SEED)).alias("k")).orderBy("k").collect()]
    want = [given[k] for k in np.random.default_rng((SEED, 0)).permutation(90)]
    got = {(r["slot"], r["shard"]): r["doc_id"] for r in write_shards(scan, scratch(spark, "test"), is_scan=True).collect()}
    assert [got[k // 8, k % 8] for k in range(90)] == want


def test_a_cluster_without_shared_folder_is_refused(spark, monkeypatch):
    from types import SimpleNamespace

    from gleanguard.llm import common

    none = SimpleNamespace(isDefined=lambda: False)
    fake = SimpleNamespace(conf=SimpleNamespace(get=lambda *a: None), sparkContext=SimpleNamespace(getConf=lambda: {}, master="spark://host:7077", _jsc=SimpleNamespace(sc=lambda: SimpleNamespace(getCheckpointDir=lambda: none))))
    with pytest.raises(RuntimeError, match="spark.checkpoint.dir"):
        common.shared_dir(fake)


def test_crc_of_spark_is_pythons(spark):
    from pyspark.sql import functions as F

    assert spark.sql("select 'äx' t").select(F.crc32("t")).first()[0] == zlib.crc32("äx".encode())


@pytest.mark.parametrize("n", [3, 9, 169])
def test_sliding_min(n):
    v = np.random.default_rng(n).integers(0, 99, 700, dtype=np.uint64)
    assert suffix_dedup.sliding_min(v, n).tolist() == [int(v[k : k + n].min()) for k in range(len(v) - n + 1)]
