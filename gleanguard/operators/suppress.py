"""What takes findings out again: directives in the text, lists, and baselines of known findings."""

from __future__ import annotations

from collections.abc import Sequence
from dataclasses import dataclass
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from gleanguard.functions import re2, text
from gleanguard.operators.encoded import SUFFIX

#: The second kind of directive, and the lines after a directive that it covers besides its own.
AT_LINE_END = r"(?i)(?:nosec|noscan|noqa)\s*(?:\([^)]*\))?\s*$"
REACH = 3
KEYWORD = "gleanguard"


def directive(keyword: str = KEYWORD) -> str:
    return rf"(?i)(?:{keyword}|secret(?:s)?)\s*:\s*ignore(?:\s*\(([^)]+)\))?"


def _marks(lines: Column, keyword: str) -> Column:
    """(at: line, rules: ids or null for all) of the lines with a directive, the first of each line."""
    own, end = re2.to_java(directive(keyword)), re2.to_java(AT_LINE_END)

    def rules(line: Column) -> Column:
        listed = F.filter(F.transform(F.split(F.regexp_extract(line, own, 1), ","), text.trimmed), lambda x: x != "")
        return F.when(line.rlike(own), text.let(listed, lambda x: F.when(F.size(x) > 0, x)))

    marked = F.filter(F.transform(lines, lambda x, k: F.struct((k + 1).alias("at"), x.alias("line"))), lambda x: x["line"].rlike(own) | x["line"].rlike(end))
    return F.transform(marked, lambda x: F.struct(x["at"].alias("at"), rules(x["line"]).alias("rules")))


def may_have_directives(content: Column, keyword: str = KEYWORD) -> Column:
    return F.lower(content).rlike(rf"{keyword.lower()}|secret|nosec|noscan|noqa|ſ")


def directives(docs: DataFrame, keyword: str = KEYWORD) -> DataFrame:
    """(path, at, rules, last: the document's lines), a row for each line with a directive."""
    some = text.computed(docs.where(may_have_directives(F.col("content"), keyword)).select("path", "content"), lines=text.lines(F.col("content")))
    return some.select("path", F.size("lines").alias("last"), F.explode(_marks(F.col("lines"), keyword)).alias("d")).select("path", "d.at", "d.rules", "last")


def uncovered(found: Column, content: Column, keyword: str = KEYWORD) -> Column:
    """A document's findings without those whose line, or one of the three lines before it, has a directive for their rule."""

    def kept(lines: Column, marks: Column) -> Column:
        covers = lambda f, d: (f["line"] >= d["at"]) & (f["line"] <= d["at"] + REACH) & (f["line"] <= F.size(lines)) & (d["rules"].isNull() | F.array_contains(d["rules"], f["rule_id"]))
        return F.filter(found, lambda f: ~F.exists(marks, lambda d: covers(f, d)))

    checked = text.let(text.lines(content), lambda lines: text.let(_marks(lines, keyword), lambda marks: F.when(F.size(marks) > 0, kept(lines, marks)).otherwise(found)))
    return F.when(may_have_directives(content, keyword), checked).otherwise(found)


def without_inline(findings: DataFrame, docs: DataFrame, keyword: str = KEYWORD) -> DataFrame:
    """`uncovered` for findings apart from their documents, such as those of a detector of one's own.

    Directives are few: the join is an anti-join on the path with the lines as its condition.
    """
    d = directives(docs, keyword)
    outer = F.when(F.col("detector_ord") == 4, F.regexp_replace("file", rf"\Q{SUFFIX}\E\z", "")).otherwise(F.col("file"))
    covers = (
        (F.col("_outer") == d["path"]) & (F.col("line") >= d["at"]) & (F.col("line") <= d["at"] + REACH) & (F.col("line") <= d["last"])
        & (d["rules"].isNull() | F.array_contains(d["rules"], F.col("rule_id")))
    )
    return findings.withColumn("_outer", outer).join(d, covers, "left_anti").drop("_outer")


@dataclass(frozen=True)
class Suppression:
    id: str = ""
    rule_id: str = ""
    file: str = ""
    pattern: str = ""
    reason: str = ""


def suppressed(entries: Sequence[Suppression]) -> Column:
    """Whether any entry's id or file is the finding's file, its rule the finding's, or its pattern in value or file."""
    tests: list[Column] = []
    files = [x for s in entries for x in (s.id, s.file) if x]
    rules = [s.rule_id for s in entries if s.rule_id]
    if files:
        tests.append(F.col("file").isin(files))
    if rules:
        tests.append(F.col("rule_id").isin(rules))
    for s in entries:
        if s.pattern:
            try:
                rx = re2.to_java(s.pattern)
            except re2.Unsupported:
                continue
            tests += [F.coalesce("value", F.lit("")).rlike(rx), F.col("file").rlike(rx)]
    return F.coalesce(reduce(lambda a, b: a | b, tests), F.lit(False)) if tests else F.lit(False)


def without_suppressed(findings: DataFrame, entries: Sequence[Suppression]) -> DataFrame:
    return findings.where(~suppressed(entries)) if entries else findings


def _json_text(value: Column) -> Column:
    """A JSON string whose angle brackets, ampersands and line separators are escaped too."""
    out = value
    for raw, escaped in (("\\", "\\\\"), ('"', '\\"'), ("\n", "\\n"), ("\r", "\\r"), ("\t", "\\t"), ("\b", "\\b"), ("\f", "\\f"), ("<", "\\u003c"), (">", "\\u003e"), ("&", "\\u0026"), ("\u2028", "\\u2028"), ("\u2029", "\\u2029")):
        out = F.replace(out, F.lit(raw), F.lit(escaped))
    for code in [*range(8), 11, *range(14, 32)]:
        out = F.replace(out, F.lit(chr(code)), F.lit(f"\\u{code:04x}"))
    return F.concat(F.lit('"'), out, F.lit('"'))


def finding_json() -> Column:
    value = F.coalesce("value", F.lit(""))
    return F.concat(
        F.lit('{"file":'), _json_text(F.col("file")), F.lit(',"line":'), F.col("line").cast("string"), F.lit(',"rule_id":'), _json_text(F.col("rule_id")),
        F.when(value != "", F.concat(F.lit(',"value":'), _json_text(value))).otherwise(F.lit("")), F.lit("}"),
    )


def finding_hash() -> Column:
    return F.sha2(finding_json(), 256)


def new_findings(findings: DataFrame, baseline: DataFrame) -> DataFrame:
    """Findings whose hash a baseline (hash, location) lacks."""
    known = baseline.select(F.col("hash").alias("_hash")).distinct()
    return findings.join(known, finding_hash() == F.col("_hash"), "left_anti")


def updated_baseline(baseline: DataFrame, findings: DataFrame) -> DataFrame:
    """(hash, location "file:line") of both; a finding's location goes before a known one, later findings before earlier."""
    old = baseline.select("hash", "location", F.lit(None).cast("struct<file:string,detector_ord:int,rule_ord:int,pattern_ord:int,match_ord:int>").alias("ord"))
    new = findings.select(finding_hash().alias("hash"), F.concat_ws(":", "file", F.col("line").cast("string")).alias("location"), F.struct("file", "detector_ord", "rule_ord", "pattern_ord", "match_ord").alias("ord"))
    return old.unionByName(new).groupBy("hash").agg(F.max_by("location", F.struct(F.col("ord").isNotNull(), "ord")).alias("location"))


def baseline_files(baseline: DataFrame) -> DataFrame:
    """(file, findings): the files of a baseline, a location's text before its first colon."""
    return baseline.groupBy(F.substring_index("location", ":", 1).alias("file")).agg(F.count("*").alias("findings"))


def baseline_stats(baseline: DataFrame) -> DataFrame:
    """One row: total and the sorted different files, all names in one array; baseline_files has a row for each."""
    files = baseline_files(baseline)
    return files.agg(F.coalesce(F.sum("findings"), F.lit(0)).alias("total"), F.array_sort(F.collect_list("file")).alias("files"))
