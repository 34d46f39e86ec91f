"""Aggregates over findings: risk, rule statistics, histogram."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from gleanguard.plans.levels import score_label

#: Boundaries and the highest score that is safe for each.
BOUNDARIES = (("public_github", 25), ("ai_context", 25), ("ci_pipeline", 25), ("email", 50))
NOTHING = "No secrets or sensitive data detected."
#: What the summary ends with, by least score.
ADVICE = (
    (100, "Safe to share publicly? No.\nSafe to send to AI? No.\nThis file contains credentials that must be rotated and removed."),
    (75, "Safe to share publicly? No.\nSafe to send to AI? No.\nReview findings before sharing this file."),
    (50, "Safe to share publicly? Exercise caution.\nReview and redact sensitive values if needed."),
    (25, "Low risk. Verify findings before sharing."),
    (0, "No issues detected."),
)


def _counted(n, noun: str):
    return F.concat(n.cast("string"), F.lit(f" {noun}"), F.when(n == 1, F.lit("")).otherwise(F.lit("s")))


def risk(findings: DataFrame) -> DataFrame:
    """One row: risk_score, label, findings, types, reasons, critical_types, safe_to_share, summary. One aggregate."""
    one = findings.agg(
        F.count("*").alias("findings"), F.coalesce(F.max("severity"), F.lit(1)).alias("worst"), F.count_distinct("type").alias("types"),
        F.coalesce(F.bool_or(F.array_contains("tags", "private-key")), F.lit(False)).alias("key"),
        F.array_sort(F.collect_set(F.when(F.col("severity") == 5, F.col("type")))).alias("critical_types"),
        F.array_sort(F.collect_set(F.when(F.col("reason") != "", F.col("reason")))).alias("reasons"),
    )
    worst = F.col("worst")
    score = F.when((worst == 5) & F.col("key"), 100).when(worst >= 4, 75).when(worst == 3, 50).when(worst == 2, 25).otherwise(0)
    scored = one.withColumn("risk_score", F.when(F.col("findings") == 0, 0).otherwise(score)).withColumn("label", score_label(F.col("risk_score")))
    safe = F.create_map(*(x for name, most in BOUNDARIES for x in (F.lit(name), F.col("risk_score") <= most)))
    items = F.concat(F.lit("Critical items detected:\n"), F.array_join(F.transform("critical_types", lambda t: F.concat(F.lit("  \u2022 "), t, F.lit("\n"))), ""), F.lit("\n"))
    advice = F.coalesce(*(F.when(F.col("risk_score") >= at, F.lit(said)) for at, said in ADVICE))
    summary = F.concat(
        F.lit("Risk Score: "), "label", F.lit(" ("), F.col("risk_score").cast("string"), F.lit(")\n\nFound "), _counted(F.col("findings"), "finding"), F.lit(" across "),
        _counted(F.col("types"), "type"), F.lit(".\n\n"), F.when(F.size("critical_types") > 0, items).otherwise(F.lit("")), advice,
    )
    none = F.col("findings") == 0
    return scored.withColumns({
        "safe_to_share": F.when(none, F.create_map().cast("map<string,boolean>")).otherwise(safe),
        "summary": F.when(none, F.lit(NOTHING)).otherwise(summary),
    }).drop("worst", "key")


def rule_stats(findings: DataFrame) -> DataFrame:
    """(rule_id, rule_name, severity, hits, avg_confidence, files) with name and severity of a rule's first finding."""
    first = F.struct("file", "detector_ord", "rule_ord", "pattern_ord", "match_ord")
    return findings.groupBy("rule_id").agg(
        F.min_by("type", first).alias("rule_name"), F.min_by("severity", first).alias("severity"), F.count("*").alias("hits"),
        F.avg("confidence").alias("avg_confidence"), F.count_distinct("file").alias("files"),
    )


def affected_files(findings: DataFrame) -> DataFrame:
    """(file, findings, least, worst, rules): each file with findings, their severities and how many rules they are of."""
    return findings.groupBy("file").agg(F.count("*").alias("findings"), F.min("severity").alias("least"), F.max("severity").alias("worst"), F.count_distinct("rule_id").alias("rules"))


def rule_files(findings: DataFrame, n: int = 5) -> DataFrame:
    """rule_stats and the first n files by name of each rule (some_files); rules with most hits first."""
    from pyspark.sql import Window

    files = findings.select("rule_id", "file").distinct()
    first = files.withColumn("k", F.row_number().over(Window.partitionBy("rule_id").orderBy("file"))).where(F.col("k") <= n)
    some = first.groupBy("rule_id").agg(F.array_sort(F.collect_list("file")).alias("some_files"))
    return rule_stats(findings).join(some, "rule_id").orderBy(F.desc("hits"), "rule_id")


def top_rules(findings: DataFrame, n: int = 20) -> DataFrame:
    """The rules with most hits; equal ones by id."""
    return rule_stats(findings).orderBy(F.desc("hits"), "rule_id").limit(n)


def severity_histogram(findings: DataFrame) -> DataFrame:
    return findings.groupBy("severity").agg(F.count("*").alias("findings"))
