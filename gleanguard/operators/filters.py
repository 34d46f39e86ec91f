"""Filters on findings."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from gleanguard.plans.levels import severity_of


def by_confidence(findings: DataFrame, least: float) -> DataFrame:
    return findings.where(F.col("confidence") >= least) if least > 0 else findings


def by_severity(findings: DataFrame, least: str) -> DataFrame:
    return findings.where(F.col("severity") >= severity_of(least)) if least else findings


def by_tags(findings: DataFrame, tags: Sequence[str]) -> DataFrame:
    return findings.where(F.arrays_overlap("tags", F.array(*map(F.lit, tags)))) if tags else findings


def fails(least: str) -> Column:
    """An aggregate: whether any finding that is not allowed reaches the severity."""
    return F.coalesce(F.bool_or((F.col("severity") >= severity_of(least)) & (F.col("action") != "allow")), F.lit(False))
