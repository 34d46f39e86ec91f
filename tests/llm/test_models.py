"""Toxicity, fingerprints and the whole pipeline."""

import hashlib
import random
import zlib

import numpy as np

from gleanguard.llm.fingerprints import anchors, edited_text, fingerprint_documents, likeness, packed, sketch
from gleanguard.llm.toxicity import FactorizationMachine, Terms, drop_toxic, score, train


def test_machine_learns_pairs():
    """Neither an insult nor a group's mention alone, but both together."""
    rng = random.Random(1)
    terms = Terms()
    texts, labels = [], []
    for _ in range(4000):
        insult, group = rng.random() < 0.5, rng.random() < 0.5
        words = [f"w{rng.randrange(50)}" for _ in range(6)] + ["insult"] * insult + ["people"] * group
        rng.shuffle(words)
        texts.append(" ".join(words))
        labels.append(float(insult == group))
    rows, y = terms.places(texts), np.array(labels)
    right = lambda m: np.mean((np.array(m.scores(rows[3000:])) >= 0.5) == (y[3000:] > 0))
    model = FactorizationMachine().fit(rows[:3000], y[:3000])
    alone = FactorizationMachine()
    alone.bias, alone.at, alone.w, alone.v = model.bias, model.at, model.w, np.zeros_like(model.v)
    assert right(model) > 0.95 and right(alone) < 0.8


def toxic_docs():
    rng = random.Random(2)
    rows = []
    for k in range(1500):
        words = [f"word{rng.randrange(400)}" for _ in range(rng.randint(5, 60))]
        bad = rng.random() < 0.2
        if bad:
            words.insert(rng.randrange(len(words)), rng.choice(["Scum,", "moron", "TRASH."]))
        rows.append((k, " ".join(words), int(bad)))
    return rows


def test_toxicity_held_out(spark):
    rows = toxic_docs()
    docs = spark.createDataFrame([r[:2] for r in rows] + [(5000, None), (5001, "")], "doc_id long, text string")
    labels = spark.createDataFrame([(r[0], r[2]) for r in rows] + [(None, 1), (3, None)], "doc_id long, toxic int")
    model = train(docs, labels)
    out = {r["doc_id"]: r for r in score(docs, model).collect()}
    assert len(out) == len(rows) + 2 and all(0 <= r["score"] <= 1 for r in out.values())
    assert all(r["held_out"] == (zlib.crc32(str(i).encode()) % 5 == 0) and r["predicted"] == int(r["score"] >= 0.5) for i, r in out.items())
    held = [(out[i]["predicted"], y) for i, _, y in rows if out[i]["held_out"]]
    assert np.mean([a == b for a, b in held]) > 0.97
    kept = {r["doc_id"] for r in drop_toxic(docs, model).collect()}
    assert kept == {i for i, r in out.items() if not r["predicted"]}


def test_toxicity_without_labels(spark):
    docs = spark.createDataFrame([(1, "a"), (None, None)], "doc_id long, text string")
    model = train(docs, spark.createDataFrame([], "doc_id long, toxic int"))
    assert all(r["score"] < 0.5 for r in score(docs, model).collect())


def test_anchors_are_closed_syncmers():
    text = "".join(random.Random(3).choices("abcdef ä", k=600))
    at, hashes = anchors(text)
    assert 0 < len(at) < 600 and len(at) == len(hashes)
    moved = "zz" + text
    again = dict(zip(*map(np.ndarray.tolist, anchors(moved)), strict=True))
    assert all(again[int(a) + 2] == int(h) for a, h in zip(at, hashes, strict=True))  # free of context


def test_likeness():
    a, b = ("".join(random.Random(k).choices("abcdef ", k=3000)) for k in (1, 2))
    assert likeness(sketch(a), sketch(a)) == 1 and likeness(sketch(a), sketch(b)) < 0.05
    assert 0.15 < likeness(sketch(a), sketch(edited_text(a, b))) < 0.55
    assert likeness(sketch(""), sketch("")) == 1 and likeness(sketch(""), sketch(a)) == 0
    assert likeness(sketch("short"), sketch("short")) == 1 and likeness(sketch("short"), sketch("other")) == 0


def test_fingerprints_follow_the_next_document(spark):
    rng = random.Random(5)
    rows = [(rng.randrange(10**6), "".join(rng.choice("abcdé ") for _ in range(rng.choice([0, 5, 17, 300])))) for _ in range(80)]
    rows = list(dict(rows).items()) + [(10**7, None)]
    got = {r["doc_id"]: r for r in fingerprint_documents(spark.createDataFrame(rows, "doc_id long, text string")).collect()}
    ordered = sorted(rows, reverse=True)
    assert len(got) == len(rows)
    for k, (i, t) in enumerate(ordered):
        t, n = t or "", ordered[(k + 1) % len(ordered)][1] or ""
        edited = edited_text(t, n)
        r = got[i]
        assert r["n_chars"] == len(t) and r["edited_sha256"] == hashlib.sha256(edited.encode()).hexdigest()
        assert r["fingerprint"] == packed(sketch(t)).hex() and r["edited_fingerprint"] == packed(sketch(edited)).hex()
        assert r["near_edited"] == likeness(sketch(t), sketch(edited)) and r["near_next"] == likeness(sketch(t), sketch(n))


def test_fingerprints_of_few_rows(spark):
    df = spark.createDataFrame([(1, "only this one text is here")], "doc_id long, text string")
    assert [r["near_next"] for r in fingerprint_documents(df).collect()] == [1.0]
    assert fingerprint_documents(df.limit(0)).count() == 0
    twice = spark.createDataFrame([(1, "a"), (1, "a"), (None, "b")], "doc_id long, text string")
    assert fingerprint_documents(twice).count() == 3


def test_pipeline(spark, tmp_path):
    import corpus_pipeline

    rng = random.Random(8)
    words = lambda n: " ".join("".join(rng.choice("abcdefgh") for _ in range(5)) for _ in range(n))
    passage = words(60)
    texts = {k: words(80) for k in range(300)}
    toxic = {k for k in range(300) if k % 10 == 0}
    for k in toxic:
        texts[k] += " vile scum"
    texts[301], texts[302] = texts[1], texts[2].replace(" ", " \n", 1)  # copies
    near = texts[3].split()
    near[40] = "changed"
    texts[303] = " ".join(near)
    texts[304], texts[305] = words(40) + " " + passage + " " + words(40), words(30) + " " + passage
    rows = [(k, t, "en", "s", len(t)) for k, t in texts.items()]
    schema = "doc_id long, text string, lang string, source string, n_chars long"
    spark.createDataFrame(rows, schema).write.parquet(str(tmp_path / "documents.parquet"))
    spark.createDataFrame([(k, int(k in toxic), 1) for k in range(300)], "doc_id long, toxic int, quality int").write.parquet(str(tmp_path / "labels.parquet"))
    docs, kept = spark.read.parquet(str(tmp_path / "documents.parquet")), []
    for k, (name, stage) in enumerate(corpus_pipeline.STAGES):
        stage(spark, docs, str(tmp_path)).write.parquet(str(tmp_path / f"out{k}"))
        docs = spark.read.parquet(str(tmp_path / f"out{k}"))
        if k < 4:
            assert docs.columns == [c.split()[0] for c in schema.split(", ")]
            kept.append({r["doc_id"]: r["text"] for r in docs.collect()})
    assert set(kept[0]) == set(texts) - toxic
    clean = set(kept[0])
    assert set(kept[1]) == clean - {301 if 1 in clean else None, 302}
    assert set(kept[2]) == set(kept[1]) - {303}
    assert passage not in kept[3][304] and passage not in kept[3][305]
    assert all(kept[3][k] == texts[k] for k in kept[3] if k < 300)
    assert {r["doc_id"] for r in docs.collect()} == set(kept[3])
    whole = {r["doc_id"] for r in corpus_pipeline.run(spark, str(tmp_path)).collect()}
    assert whole == set(kept[3])
