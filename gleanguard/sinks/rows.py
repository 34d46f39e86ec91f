"""Findings as rows of the output formats."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from gleanguard.plans.levels import severity_of

#: Levels of the static-analysis format and of annotations.
LEVELS = {5: "error", 4: "error", 3: "warning"}


def sarif_level(severity: Column) -> Column:
    return F.coalesce(*(F.when(severity == s, F.lit(level)) for s, level in LEVELS.items()), F.lit("note"))


def percent(confidence: Column) -> Column:
    """Whole per cent, halves to even as the doubles are."""
    return F.bround(confidence * 100, 0).cast("int").cast("string")


def sarif_rules(findings: DataFrame) -> DataFrame:
    """(rule_id, name, description, level, rule_index) by first appearance in the findings' order."""
    first = F.struct("file", "detector_ord", "rule_ord", "pattern_ord", "match_ord")
    rules = findings.groupBy("rule_id").agg(F.min(first).alias("first"), F.min_by("type", first).alias("name"), F.min_by("reason", first).alias("description"), F.min_by("severity", first).alias("severity"))
    # as many rows as there are rules
    from pyspark.sql import Window

    return rules.select("rule_id", "name", "description", sarif_level(F.col("severity")).alias("level"), (F.row_number().over(Window.orderBy("first")) - 1).alias("rule_index"))


def sarif_results(findings: DataFrame) -> DataFrame:
    """(rule_id, level, message, uri, start_line, start_column, rule_index and the ordering columns).

    A rule's index needs all findings, so they are persisted (on disk where memory does not do) and not made twice;
    findings.unpersist() gives them back.
    """
    findings = findings.persist()
    index = F.broadcast(sarif_rules(findings).select("rule_id", "rule_index"))
    message = F.concat("type", F.lit(": "), "reason", F.lit(" (confidence: "), percent(F.col("confidence")), F.lit("%)"))
    return findings.join(index, "rule_id").select(
        "rule_id", sarif_level(F.col("severity")).alias("level"), message.alias("message"), F.col("file").alias("uri"), F.col("line").alias("start_line"),
        F.col("column").alias("start_column"), "rule_index", "detector_ord", "rule_ord", "pattern_ord", "match_ord",
    )


def annotations(findings: DataFrame, least: str = "info") -> DataFrame:
    """(path, line, level, message and the ordering columns) of findings that reach a severity."""
    message = F.concat(F.lit("["), "rule_id", F.lit("] "), "reason", F.lit(" (confidence: "), percent(F.col("confidence")), F.lit("%)"))
    level = F.when(F.col("severity") >= 4, "error").otherwise("warning")
    return findings.where(F.col("severity") >= severity_of(least)).select(
        F.col("file").alias("path"), "line", level.alias("level"), message.alias("message"), "detector_ord", "rule_ord", "pattern_ord", "match_ord")


def annotation_lines(found: DataFrame) -> DataFrame:
    """(value): one workflow command for each annotation, line breaks taken out."""
    path, message = F.regexp_replace("path", "[\n\r]", "_"), F.regexp_replace("message", "[\n\r]", " ")
    return found.select(F.concat(F.lit("::"), "level", F.lit(" file="), path, F.lit(",line="), F.col("line").cast("string"), F.lit("::"), message).alias("value"))


def annotation_summary(found: DataFrame) -> DataFrame:
    return found.agg(F.count("*").alias("total"), F.coalesce(F.sum(F.when(F.col("level") == "error", 1)), F.lit(0)).alias("errors"), F.coalesce(F.sum(F.when(F.col("level") == "warning", 1)), F.lit(0)).alias("warnings"))


def json_findings(findings: DataFrame) -> DataFrame:
    """Findings as a JSON document each, empty optional fields left out."""
    empty = lambda c: F.when(F.col(c) != "", F.col(c)).alias(c)
    return findings.select("type", "severity", "confidence", "file", "line", "column", empty("value"), "reason", "rule_id", "tags", "action", empty("context"), empty("source_line"))
