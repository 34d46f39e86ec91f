"""New and changed documents as a stream: the same detectors, one report for each batch.

A folder is a streaming source of its own: Spark's file source sees neither names that begin with a dot nor edits. Its
offset is a time; a batch holds the files whose contents or names changed after the last offset and up to the new one.
The offset lies in the query's checkpoint, so a query that starts again goes on where it was.
"""

from __future__ import annotations

import fnmatch
import json
import os
import time
from collections.abc import Callable, Iterator, Sequence

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.datasource import DataSource, DataSourceStreamReader, InputPartition
from pyspark.sql.streaming import StreamingQuery

from gleanguard.plans.scan import ScanConfig, scan
from gleanguard.sources import files

#: The shortest pause between looks at a folder, and the most new files of a table that one look takes.
LEAST_SECONDS, MOST_FILES = 0.1, 10_000
#: Files that one task reads.
TOGETHER = 200


class _Some(InputPartition):
    def __init__(self, paths: list[str]):
        self.paths = paths


class _Reader(DataSourceStreamReader):
    def __init__(self, root: str, walk: files.Walk, exclude: list[str], since: int):
        self.root, self.lister, self.exclude, self.since = root, files._LocalLister(root, walk, False), exclude, since

    def _changed(self, after: int, until: int | None = None) -> Iterator[tuple[int, str]]:
        """(time, path) of what changed later than a time, and no later than another."""
        for path, _, changed in self.lister.files("", True):
            if changed > after and (until is None or changed <= until) and not any(fnmatch.fnmatchcase(os.path.basename(path), g) for g in self.exclude):
                yield changed, path

    def initialOffset(self) -> dict:
        return {"time": self.since}

    def latestOffset(self) -> dict:
        return {"time": max((at for at, _ in self._changed(self.since)), default=self.since)}

    def partitions(self, start: dict, end: dict) -> Sequence[InputPartition]:
        paths = [p for _, p in sorted(self._changed(start["time"], end["time"]))]
        return [_Some(paths[k : k + TOGETHER]) for k in range(0, len(paths), TOGETHER)] or [_Some([])]

    def read(self, partition: _Some) -> Iterator[tuple]:
        for path in partition.paths:
            try:
                with open(os.path.join(self.root, path), "rb") as f:
                    yield path, f.read()
            except OSError:
                continue

    def commit(self, end: dict) -> None:
        pass


class FolderSource(DataSource):
    """A folder's new and changed files. Options: path, walk (JSON of a Walk), exclude (JSON list of patterns for names),
    known ("true": what is there now counts as known)."""

    @classmethod
    def name(cls) -> str:
        return "gleanguard_folder"

    def schema(self) -> str:
        return "path string, content binary"

    def streamReader(self, schema) -> DataSourceStreamReader:
        o = self.options
        since = time.time_ns() // 1000 if o.get("known") == "true" else 0
        return _Reader(os.path.abspath(o["path"]), files.Walk(**json.loads(o.get("walk", "{}"))), json.loads(o.get("exclude", "[]")), since)


def watch_folder(spark: SparkSession, path: str, walk: files.Walk | None = None, exclude: Sequence[str] = (), known: bool = False) -> DataFrame:
    """A stream of a folder's files, new and changed, as documents; the folder's ignore file and the walk's rules hold.

    exclude are patterns for names. With known, files that are there at the start come only when they change. A look takes
    all that changed, TOGETHER files in a task, so it needs no bound. All machines must see the folder.
    """
    walk = walk or files.Walk()
    walk = files.Walk(**{**walk.__dict__, "ignore": (*walk.ignore, *files.read_ignore_file(os.path.join(path, files.IGNORE_FILE)))})
    spark.dataSource.register(FolderSource)
    options = {"path": path, "walk": json.dumps({k: list(v) if isinstance(v, tuple) else v for k, v in walk.__dict__.items()}), "exclude": json.dumps(list(exclude)), "known": str(known).lower()}
    stream = spark.readStream.format(FolderSource.name()).options(**options).load()
    kept = files.walked(stream.withColumn("length", F.length("content").cast("long")), files.Walk(**{**walk.__dict__, "max_files": 0}))
    return files.from_bytes(kept.select("path", "content"))


def watch_table(spark: SparkSession, path: str, schema, text: str, key: str) -> DataFrame:
    """A stream of the rows of new Parquet files as documents."""
    rows = spark.readStream.schema(schema).option("maxFilesPerTrigger", MOST_FILES).parquet(path)
    return rows.select(F.col(key).cast("string").alias("path"), F.col(text).alias("content"))


def scan_stream(docs: DataFrame, checkpoint: str, on_findings: Callable[[DataFrame, int], None], config: ScanConfig | None = None, seconds: float | None = 1.0) -> StreamingQuery:
    """Scans each batch of new documents; without seconds, what is there now and no more."""
    config = config or ScanConfig()

    def batch(df: DataFrame, number: int) -> None:
        on_findings(scan(df, config), number)

    writer = docs.writeStream.option("checkpointLocation", checkpoint).foreachBatch(batch)
    writer = writer.trigger(availableNow=True) if seconds is None else writer.trigger(processingTime=f"{max(seconds, LEAST_SECONDS)} seconds")
    return writer.start()


def changed(listing: DataFrame, known: DataFrame) -> DataFrame:
    """Files of a listing (path, modified), such as list_directory's, that a table of known ones lacks or has as older."""
    old = known.select(F.col("path").alias("_path"), F.col("modified").alias("_modified"))
    return listing.join(old, F.col("path") == F.col("_path"), "left").where(F.col("_modified").isNull() | (F.col("modified") > F.col("_modified"))).select(listing.columns)
