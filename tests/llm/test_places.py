"""Rows of a scan keep their marks however the scan is cut into tasks."""

import pyarrow as pa
import pyarrow.parquet as pq
from test_dedup import brute_passages, passage_texts

from gleanguard.llm import suffix_dedup
from gleanguard.llm.suffix_dedup import drop_repeated_passages, repeated_passages

SPLIT = "spark.sql.files.maxPartitionBytes"


def test_passages_when_each_pass_is_cut_otherwise(spark, tmp_path, monkeypatch):
    texts = passage_texts()
    for k in range(9):
        part = range(k, len(texts), 9)
        pq.write_table(pa.table({"doc_id": pa.array(part, pa.int64()), "text": [texts[i] for i in part]}), tmp_path / f"part {k}.parquet", row_group_size=3)
    write, sizes = suffix_dedup._write_side, ["1m", "8k"]

    def cut(df, name):
        out = write(df, name)
        spark.conf.set(SPLIT, sizes[name == "wanted"])
        return out

    monkeypatch.setattr(suffix_dedup, "_write_side", cut)
    before = spark.conf.get(SPLIT)
    want = brute_passages(texts)
    try:
        spark.conf.set(SPLIT, "20k")
        got = repeated_passages(spark.read.parquet(str(tmp_path)), is_scan=True)
        assert {r["doc_id"]: tuple(r)[1:] for r in got.collect()} == want
        spark.conf.set(SPLIT, "20k")
        kept = {r["doc_id"]: r["text"] for r in drop_repeated_passages(spark.read.parquet(str(tmp_path)), is_scan=True).collect()}
    finally:
        spark.conf.set(SPLIT, before)
    assert all((kept[i] == texts[i]) == (not gone) for i, (_, gone, _, _) in want.items())
