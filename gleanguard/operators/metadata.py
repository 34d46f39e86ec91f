"""Findings about files themselves: binary, executable, symbolic link."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from gleanguard.functions.classify import is_executable
from gleanguard.operators.schema import exploded, finding


def _about(condition: Column, detector: int, rule: int, name: str, reason: str, rule_id: str, tags: tuple[str, ...], value: Column | None = None) -> Column:
    return F.when(condition, F.struct(*finding(
        type=F.lit(name), severity=F.lit(1), confidence=F.lit(1.0), file=F.col("path"), line=F.lit(1), column=F.lit(1), value=F.lit(None) if value is None else value,
        reason=F.lit(reason), rule_id=F.lit(rule_id), tags=F.array(*map(F.lit, tags)), detector_ord=F.lit(detector), rule_ord=F.lit(rule), pattern_ord=F.lit(0), match_ord=F.lit(0),
    )))


def file_type_findings() -> Column:
    """A document's findings for being binary or executable."""
    binary = _about(F.col("is_binary"), 1, 0, "Binary File", "Binary file detected", "binary-file-detected", ("filetype", "binary"))
    runs = _about(is_executable(F.col("mode")), 1, 1, "Executable File", "Executable file detected", "executable-file-detected", ("filetype", "executable"))
    return F.array_compact(F.array(binary, runs))


def symlink_findings() -> Column:
    return F.array_compact(F.array(_about(F.coalesce("is_symlink", F.lit(False)), 2, 0, "Symlink", "Symbolic link detected", "symlink-detected", ("symlink", "filesystem"), F.col("symlink_target"))))


def file_types(docs: DataFrame) -> DataFrame:
    return exploded(docs.select(file_type_findings().alias("found")))


def symlinks(docs: DataFrame) -> DataFrame:
    return exploded(docs.select(symlink_findings().alias("found")))
