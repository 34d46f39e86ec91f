"""Sharding by a two-pass external shuffle.

Pass 1 scatters the records uniformly into memory-sized buckets by a seeded hash of where a record lies (its file and
row), so that neither an id nor a text that many records share fills a bucket. Pass 2 takes one bucket at a time, puts
it into Fisher-Yates order and deals it to the shards: the record at place p of all buckets' records, one bucket after
another, goes to shard p mod n, slot p div n. Counts of shards are then at most one apart (the law `rows`), and a
bucket's records spread over all shards. A shard's files are its buckets' parts, whose slots ascend from file to file.

Before it is shuffled a bucket is sorted by the hash, so a task that is run again writes the same records.
"""

from __future__ import annotations

import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from gleanguard.llm.common import bounded_batches, documents, placed, scratch

SHARDS = 8
SEED = 20
#: A bucket is this part of an executor's memory, within bounds: a task holds it twice.
MEMORY_SHARE, LEAST_BYTES, MOST_BYTES = 32, 16 << 20, 1 << 30


def record_size() -> F.Column:
    return (F.coalesce(F.octet_length("text"), F.lit(0)) + 1).cast("long")


def bucket_size(spark: SparkSession) -> int:
    """Bytes of a bucket that suits the executors' memory."""
    given = re.fullmatch(r"(\d+)([kmgt]?)b?", spark.sparkContext.getConf().get("spark.executor.memory", "1g").lower())
    memory = int(given[1]) << {"": 20, "k": 10, "m": 20, "g": 30, "t": 40}[given[2]] if given else 1 << 30
    return min(max(memory // MEMORY_SHARE, LEAST_BYTES), MOST_BYTES)


def fisher_yates(n: int, seed: int, bucket: int) -> np.ndarray:
    """A uniform order of n records; numpy's permutation is a Fisher-Yates shuffle."""
    return np.random.default_rng((seed, bucket)).permutation(n)


def write_shards(df: DataFrame, path: str, shards: int = SHARDS, seed: int = SEED, bucket_bytes: int | None = None, is_scan: bool = False) -> DataFrame:
    """Writes the rows of (doc_id, text) as Parquet below path, a folder for each shard, and returns them read back.

    Result: doc_id, text, slot, shard. A null text stays null and counts as one byte; an empty one too, and stays empty.
    Ids play no part: null, repeated and tied rows are dealt like any others. A long text is one record, and a bucket
    that it makes larger. An empty table gives no rows. Other columns are not kept. is_scan says that df reads Parquet
    files as they are; the same files give the same shards. Any other df is written as a table first.
    """
    spark = df.sparkSession
    bounded_batches(spark)
    rows, file, row = placed(df.select("doc_id", "text"), is_scan)
    total = rows.agg(F.sum(record_size())).first()[0] or 0
    buckets = max(1, -(-total // (bucket_bytes or bucket_size(spark))))
    key = F.xxhash64(file, row, F.lit(seed))
    bucket = F.pmod(key, F.lit(buckets)).cast("int")
    # one number for each bucket; the texts are not read for it
    counts = np.zeros(buckets, np.int64)
    for b, n in rows.groupBy(bucket.alias("bucket")).count().collect():
        counts[b] = n
    before = spark.sparkContext.broadcast(np.concatenate(([0], np.cumsum(counts))))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held = [b.drop_columns(["_key"]) for b in batches]
        if not sum(b.num_rows for b in held):
            return
        k = TaskContext.get().partitionId()
        table = pa.Table.from_batches(held)
        table = table.take(pa.array(fisher_yates(table.num_rows, seed, k)))
        first = int(before.value[k])
        if table.num_rows != int(before.value[k + 1]) - first:
            raise ValueError("the scan's rows are not those that were counted")
        place = np.arange(first, first + table.num_rows)
        table = table.append_column("slot", pa.array(place // shards, pa.int64())).append_column("shard", pa.array(place % shards, pa.int32()))
        yield from table.to_batches(max_chunksize=1000)

    schema = T.StructType([T.StructField("doc_id", rows.schema["doc_id"].dataType), T.StructField("text", T.StringType()), T.StructField("slot", T.LongType()), T.StructField("shard", T.IntegerType())])
    scattered = rows.select("doc_id", "text", key.alias("_key")).repartitionById(buckets, F.pmod("_key", F.lit(buckets)).cast("int")).sortWithinPartitions("_key", "doc_id", "text")
    shuffled = scattered.mapInArrow(run, schema).sortWithinPartitions("shard", "slot")
    shuffled.write.partitionBy("shard").parquet(path)
    return spark.read.schema(schema).parquet(path)


def op9_sharding(spark: SparkSession, sf_dir: str) -> DataFrame:
    files = write_shards(documents(spark, sf_dir), scratch(spark, "shards"), is_scan=True)
    return files.select(
        "doc_id", record_size().alias("size"), F.crc32(F.coalesce("text", F.lit(""))).alias("text_crc32"), F.lit("rows").alias("law"),
        "shard", "slot", F.lit(None).cast("int").alias("grown_shard"),
    )
