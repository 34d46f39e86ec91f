"""Files as documents: a folder's listing with its filters, single files, and lists of paths."""

from __future__ import annotations

import os
import stat
import urllib.parse
from collections.abc import Callable, Iterator, Sequence
from dataclasses import dataclass

import pandas as pd
import pyarrow.fs as pafs
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from gleanguard.functions import classify
from gleanguard.sources.globs import ignore_rules, ignored, ignorer

#: What a listing leaves out, and the largest file that it takes.
SKIP_EXTENSIONS = (
    ".png .jpg .jpeg .gif .ico .svg .webp .mp4 .avi .mov .mkv .exe .dll .so .dylib .bin .o .a .lib .class .pyc .DS_Store .DS_Store? "
    ".zip .tar .gz .bz2 .rar .7z .woff .woff2 .ttf .eot .min.js .min.css .lock .sum"
).split()
SKIP_DIRS = (
    ".git .svn .hg node_modules vendor dist build target out .venv venv __pycache__ .mypy_cache .pytest_cache .idea .vscode .eclipse "
    ".project coverage .nyc_output tmp temp .tmp .gradle .m2 Pods .cocoapods .terraform .terraform.lock.hcl elm-stuff .dart_tool"
).split()
MAX_FILE_SIZE = 50 * 1024 * 1024
#: What is put behind a link's target that cannot be used.
MARKS = (" (broken)", " (unsafe: outside scan root)", " (unreadable)")
IGNORE_FILE = ".gleanguardignore"
#: Folders that the driver goes through before executors go on below them, and bytes of contents that a task holds.
FOLDERS, READ_BYTES = 512, 32 << 20
LISTED = "path string, length long, modified long"
METADATA = ", mode int, is_symlink boolean, symlink_target string, readable boolean"
TEST_STEM = r"(?:_test|\.test|\.spec)\z"


@dataclass(frozen=True)
class Walk:
    """What a listing takes. skip_extensions, where given, stand in place of the fixed ones."""

    ignore: Sequence[str] = ()
    skip_extensions: Sequence[str] = tuple(SKIP_EXTENSIONS)
    skip_dirs: Sequence[str] = tuple(SKIP_DIRS)
    max_file_size: int = MAX_FILE_SIZE
    max_files: int = 0
    include_tests: bool = True


def read_ignore_file(path: str) -> list[str]:
    try:
        with open(path, encoding="utf-8") as f:
            return f.read().splitlines()
    except FileNotFoundError:
        return []


def base_name(path: Column) -> Column:
    return F.substring_index(path, "/", -1)


def extension(path: Column) -> Column:
    return F.regexp_extract(base_name(path), r"(\.[^.]*)\z", 1)


def is_test_file(path: Column) -> Column:
    """Whether the name without its extension ends as tests' names do."""
    return F.regexp_replace(base_name(path), r"\.[^.]*\z", "").rlike(TEST_STEM)


def in_skipped_dir(path: Column, dirs: Sequence[str] = SKIP_DIRS) -> Column:
    parts = F.split(path, "/")
    return F.arrays_overlap(F.slice(parts, 1, F.greatest(F.size(parts) - 1, F.lit(0))), F.array(*map(F.lit, dirs))) if dirs else F.lit(False)


def skipped_extension(path: Column, extensions: Sequence[str] = SKIP_EXTENSIONS) -> Column:
    name = base_name(path)
    out = F.lit(False)
    for e in extensions:
        out = out | name.endswith(e)
    return out


def walked(listing: DataFrame, walk: Walk) -> DataFrame:
    """A listing (path: relative, length) with a walk's filters; the size filter reaches the scan of the files.

    max_files takes the first in the order of a depth-first walk, which compares paths segment by segment.
    """
    path = F.col("path")
    kept = listing.where(F.col("length") <= walk.max_file_size).where(~in_skipped_dir(path, walk.skip_dirs) & ~skipped_extension(path, walk.skip_extensions))
    if walk.ignore:
        kept = kept.where(~ignored(path, ignore_rules(walk.ignore)))
    if not walk.include_tests:
        kept = kept.where(~is_test_file(path))
    return kept.orderBy(F.split(path, "/")).limit(walk.max_files) if walk.max_files else kept


def from_bytes(df: DataFrame) -> DataFrame:
    """Documents of (path, content: bytes, ...): text decoded, classified and hashed."""
    rest = [c for c in df.columns if c not in ("path", "content")]
    return df.select("path", F.make_valid_utf8(F.col("content").cast("string")).alias("content"), classify.is_binary(F.col("content")).alias("is_binary"), F.length("content").alias("size"), F.sha2("content", 256).alias("hash"), *rest)


def read_directory(spark: SparkSession, root: str, walk: Walk | None = None, with_metadata: bool = False) -> DataFrame:
    """Documents of a folder, paths relative to it. A root whose own name is skipped has none.

    The driver lists folders from the top until there are FOLDERS of them; executors list what is in them and below,
    filter it and read what is left. Spark's own file listing is not used, as it passes over names that begin with a dot,
    such as .env. with_metadata takes a folder that all machines see, with mode and symbolic links.
    """
    return _read_listed(list_directory(spark, root, walk, with_metadata), _uri(root))


def list_directory(spark: SparkSession, root: str, walk: Walk | None = None, with_metadata: bool = False) -> DataFrame:
    """The files that read_directory reads: path, length, modified (microseconds), and with metadata mode, is_symlink,
    symlink_target and readable."""
    walk = walk or Walk()
    walk = Walk(**{**walk.__dict__, "ignore": (*walk.ignore, *(read_ignore_file(os.path.join(root, IGNORE_FILE)) if "://" not in root else ()))})
    base = root.rstrip("/") or "/"
    schema = LISTED + METADATA if with_metadata else LISTED
    if os.path.basename(base) in walk.skip_dirs:
        return spark.createDataFrame([], schema)
    local = base.removeprefix("file://") if base.startswith("file://") or "://" not in base else None
    lister = _LocalLister(os.path.abspath(local), walk, with_metadata) if local is not None else _UriLister(base, walk)
    done, pending = [], [""]
    while pending and len(done) + len(pending) < FOLDERS:
        folder = pending.pop(0)
        done.append((folder, False))
        pending += lister.folders(folder)
    tasks = spark.createDataFrame([*done, *((f, True) for f in pending)], "folder string, below boolean").repartition(min(len(done) + len(pending), 4 * spark.sparkContext.defaultParallelism))

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        names = [c.split()[0] for c in schema.split(", ")]
        for pdf in batches:
            rows: list[tuple] = []
            for folder, below in zip(pdf["folder"], pdf["below"], strict=True):
                for row in lister.files(folder, below):
                    rows.append(row)
                    if len(rows) >= 10_000:
                        yield pd.DataFrame(rows, columns=names)
                        rows = []
            if rows:
                yield pd.DataFrame(rows, columns=names)

    # verdicts of the ignore rules on whole folders need the walk; a lister that has none leaves them to the filters
    return walked(tasks.mapInPandas(run, schema), walk)


def is_safe(root: str, target: str) -> bool:
    """Whether a link's target lies below root; any relative path that begins with two dots does not."""
    return not os.path.relpath(target, root).startswith("..")


def metadata(path: str, root: str) -> tuple[int, int, bool, str]:
    """(size, mode, is_symlink, target) of a path; a link's target is resolved and marked when it cannot be used."""
    info = os.lstat(path)
    if not stat.S_ISLNK(info.st_mode):
        return info.st_size, stat.S_IMODE(info.st_mode), False, ""
    target = os.readlink(path)
    full = os.path.normpath(target if os.path.isabs(target) else os.path.join(os.path.dirname(path), target))
    broken, unsafe, unreadable = MARKS
    if not os.path.exists(full):
        full += broken
    elif not is_safe(root, full):
        full += unsafe
    elif not os.access(full, os.R_OK):
        full += unreadable
    return info.st_size, stat.S_IMODE(info.st_mode), True, full


class _LocalLister:
    """Folders of a machine's own file system; skipped and ignored folders are not entered, links not followed."""

    def __init__(self, root: str, walk: Walk, with_metadata: bool, on_error: Callable[[OSError], None] | None = None):
        self.root, self.walk, self.with_metadata, self.on_error = root, walk, with_metadata, on_error

    def _entries(self, folder: str) -> tuple[list[str], list[str]]:
        verdict, files, folders = ignorer(ignore_rules(self.walk.ignore)), [], []
        try:
            entries = sorted(os.scandir(os.path.join(self.root, folder)), key=lambda e: e.name)
        except OSError as e:
            if self.on_error:
                self.on_error(e)
            return [], []
        for e in entries:
            rel = f"{folder}/{e.name}" if folder else e.name
            if e.is_dir(follow_symlinks=False):
                if e.name not in self.walk.skip_dirs and not verdict(rel):
                    folders.append(rel)
            elif (self.with_metadata or e.is_file()) and not verdict(rel):
                files.append(rel)
        return files, folders

    def folders(self, folder: str) -> list[str]:
        return self._entries(folder)[1]

    def files(self, folder: str, below: bool) -> Iterator[tuple]:
        left = [folder]
        while left:
            files, folders = self._entries(left.pop())
            left += folders if below else []
            for rel in files:
                path = os.path.join(self.root, rel)
                try:
                    info = os.lstat(path)
                    changed = max(info.st_mtime_ns, info.st_ctime_ns) // 1000
                    yield (rel, *_about(path, self.root, changed)) if self.with_metadata else (rel, os.stat(path).st_size, changed)
                except OSError as e:
                    if self.on_error:
                        self.on_error(e)


class _UriLister:
    """Folders of a store that pyarrow opens by URI."""

    def __init__(self, uri: str, walk: Walk):
        self.uri, self.walk = uri, walk

    def _found(self, folder: str, below: bool) -> tuple[list, str]:
        fs, root = pafs.FileSystem.from_uri(self.uri)
        return fs.get_file_info(pafs.FileSelector(f"{root}/{folder}" if folder else root, recursive=below)), root

    def folders(self, folder: str) -> list[str]:
        found, root = self._found(folder, False)
        return [f.path[len(root) :].lstrip("/") for f in found if f.type == pafs.FileType.Directory and f.base_name not in self.walk.skip_dirs]

    def files(self, folder: str, below: bool) -> Iterator[tuple]:
        found, root = self._found(folder, below)
        for f in found:
            if f.is_file:
                yield f.path[len(root) :].lstrip("/"), f.size, (f.mtime_ns or 0) // 1000


def _about(path: str, root: str, changed: int) -> tuple:
    size, mode, is_link, target = metadata(path, root)
    return size, changed, mode, is_link, target, not (is_link and target.endswith(MARKS) and not os.path.exists(target))


def _uri(root: str) -> str:
    return root.rstrip("/") if "://" in root else "file://" + urllib.parse.quote(os.path.abspath(root))


def _read_listed(listing: DataFrame, uri: str) -> DataFrame:
    """Documents of a listing below a URI; what cannot be read, or is listed as not readable, is empty.

    The rows are spread over all tasks, as reading files costs far more than moving their names. A task holds
    READ_BYTES of contents, or one file, at a time.
    """
    dealt = listing.drop("modified").repartition(max(1, listing.sparkSession.sparkContext.defaultParallelism))
    schema = T.StructType([*dealt.schema.fields, T.StructField("content", T.BinaryType())])

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        fs, folder = pafs.FileSystem.from_uri(uri)
        for pdf in batches:
            data: list[bytes] = []
            size = first = 0
            readable = pdf["readable"] if "readable" in pdf else [True] * len(pdf)
            for k, (path, ok) in enumerate(zip(pdf["path"], readable, strict=True)):
                try:
                    if not ok:
                        raise OSError(path)
                    with fs.open_input_stream(f"{folder.rstrip('/')}/{path}") as f:
                        data.append(f.read())
                except OSError:
                    data.append(b"")
                size += len(data[-1])
                if size >= READ_BYTES:
                    yield pdf.iloc[first : k + 1].assign(content=data)
                    data, size, first = [], 0, k + 1
            if data:
                yield pdf.iloc[first:].assign(content=data)

    read = from_bytes(dealt.mapInPandas(run, schema))
    return read.drop("length", "readable")


def read_file(spark: SparkSession, path: str) -> DataFrame:
    """One file of any name, without any of a walk's filters; its path as given. A folder has no documents of its own."""
    folder, _, name = path.rpartition("/")
    uri = folder if "://" in path else _uri(folder or ("/" if path.startswith("/") else "."))
    return _read_listed(spark.createDataFrame([(name,)], "path string"), uri).withColumn("path", F.lit(path))


def read_paths(spark: SparkSession, root: str, paths: Sequence[str]) -> DataFrame:
    """Listed files below root without a walk's filters; those that cannot be read are left out."""
    kept = [p for p in paths if os.path.isfile(os.path.join(root, p)) and os.access(os.path.join(root, p), os.R_OK)]
    rows = [(p, *_about(os.path.join(root, p), os.path.abspath(root), 0)) for p in kept]
    return _read_listed(spark.createDataFrame(rows, LISTED + METADATA), _uri(root))
