"""What the training-data operators share: scratch places, Arrow batches, bounded blocks."""

from __future__ import annotations

import re
import tempfile
import uuid
from collections.abc import Iterable, Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import pyarrow.fs as pafs
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: UTF-8 bytes of text that a Python task looks at together.
BLOCK_BYTES = 2 << 20


def documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/documents.parquet")


def bounded_batches(spark: SparkSession, rows: int = 1000, size: str = "8m") -> None:
    """Arrow batches of few rows and bytes, so that a batch of long texts still fits a Python worker.

    These two settings stay with the session: a DataFrame reads them when it runs, long after this call.
    """
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", str(rows))
    spark.conf.set("spark.sql.execution.arrow.maxBytesPerBatch", size)


def shared_dir(spark: SparkSession) -> str:
    """The cluster's shared folder (spark.checkpoint.dir). Where it is unset, a session on this machine alone, as in
    tests, gets one of our own; on a cluster that is an error, as executors don't share a machine's folders."""
    base = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getConf().get("spark.checkpoint.dir")
    if not base:
        known = spark.sparkContext._jsc.sc().getCheckpointDir()
        if known.isDefined():
            return known.get()
        if not re.match(r"local(\[|$)", spark.sparkContext.master):
            raise RuntimeError("set spark.checkpoint.dir to a folder that the driver and all executors share")
        base = "file://" + tempfile.mkdtemp(prefix="gleanguard-")
    if not spark.sparkContext._jsc.sc().getCheckpointDir().isDefined():
        spark.sparkContext.setCheckpointDir(base)
    return base


#: Schemes of Hadoop's file systems that pyarrow knows by another name.
_SCHEMES = {"s3a": "s3", "s3n": "s3", "wasbs": "abfs", "wasb": "abfs", "abfss": "abfs"}


def opened(path: str) -> tuple[pafs.FileSystem, str]:
    """The file system of a folder that Spark names by URI, for Python tasks, and the path there."""
    scheme, sign, rest = path.partition("://")
    return pafs.FileSystem.from_uri(f"{_SCHEMES.get(scheme, scheme)}{sign}{rest}")


def scratch(spark: SparkSession, name: str) -> str:
    """A new folder name below the shared folder."""
    return f"{shared_dir(spark).rstrip('/')}/{name}-{uuid.uuid4().hex}"


def settled(df: DataFrame, name: str) -> DataFrame:
    """The rows as a Parquet table in the shared folder: a cut in the lineage that survives lost executors."""
    path = scratch(df.sparkSession, name)
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def spread(df: DataFrame) -> DataFrame:
    """A table with fewer splits than there are cores dealt to all of them; any larger one as it is, so nothing moves."""
    cores = df.sparkSession.sparkContext.defaultParallelism
    return df.repartition(cores) if df.rdd.getNumPartitions() < cores else df


def placed(df: DataFrame, is_scan: bool) -> tuple[DataFrame, Column, Column]:
    """df, and columns with a hash of each row's file and the row's number in it, which stay the same however a scan is
    cut into tasks. is_scan says that df reads Parquet files as they are; any other is written as a table first.

    A file is known by its path, size and time of change.
    """
    df = df if is_scan else settled(df, "texts")
    meta = df.metadataColumn("_metadata")
    what = F.concat_ws("|", meta["file_path"], meta["file_size"].cast("string"), F.unix_micros(meta["file_modification_time"]).cast("string"))
    return df, F.xxhash64(what), meta["row_index"]


def ranged(df: DataFrame, is_scan: bool, descending: bool = False) -> DataFrame:
    """(doc_id, text) in ranges of doc_id, ascending with null ids first, or descending with null ids last, in each task.

    Rows of one id, or of none, are ordered by file and row where df is a scan of Parquet files, so that any number of
    them is dealt over ranges; else by text, and they stay in one range.
    """
    by = F.col("doc_id").desc_nulls_last() if descending else F.col("doc_id").asc_nulls_first()
    if not is_scan:
        return df.select("doc_id", "text").repartitionByRange(by).sortWithinPartitions(by, F.col("text").asc_nulls_first())
    rows, file, row = placed(df.select("doc_id", "text"), True)
    return rows.select("doc_id", "text", file.alias("file"), row.alias("row")).repartitionByRange(by, "file", "row").sortWithinPartitions(by, "file", "row").select("doc_id", "text")


def fresh(df: DataFrame, *names: str) -> list[str]:
    """Names like these that no column of df has, whatever the case of its letters."""
    taken, out = {c.lower() for c in df.columns}, []
    for name in names:
        while name.lower() in taken:
            name += "_"
        taken.add(name.lower())
        out.append(name)
    return out


def blocks(rows: Iterable[tuple], text_at: int, limit: int = BLOCK_BYTES) -> Iterator[list[tuple]]:
    """Consecutive rows together until their texts reach the limit."""
    held, size = [], 0
    for row in rows:
        held.append(row)
        size += len(row[text_at]) if row[text_at] else 0
        if size >= limit:
            yield held
            held, size = [], 0
    if held:
        yield held


def slices(batches: Iterable[pa.RecordBatch], text: str, limit: int = BLOCK_BYTES, nulls: bool = False) -> Iterator[pa.RecordBatch]:
    """Batches in parts whose texts are about the limit together; null texts are empty, or with nulls stay."""
    for batch in batches:
        if not batch.num_rows:
            continue
        column = batch.column(text).fill_null("")
        if not nulls:
            batch = batch.set_column(batch.schema.get_field_index(text), text, column)
        part = np.cumsum(pc.binary_length(column).to_numpy(zero_copy_only=False).astype(np.int64)) // limit
        edges = [0, *(np.nonzero(part[1:] != part[:-1])[0] + 1).tolist(), batch.num_rows]
        for a, b in zip(edges, edges[1:], strict=False):
            yield batch.slice(a, b - a)


def rows_of(batches: Iterable[pa.RecordBatch], *names: str) -> Iterator[tuple]:
    """Python tuples of the named columns, batch by batch."""
    for batch in batches:
        yield from zip(*(batch.column(n).to_pylist() for n in names), strict=True)


def batch_of(schema: pa.Schema, columns: list) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array(c, type=f.type) for c, f in zip(columns, schema, strict=True)], schema=schema)
