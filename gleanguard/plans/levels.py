"""Severities, actions and risk scores. Names, their order, scores and labels."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

SEVERITIES = ("info", "low", "medium", "high", "critical")  # 1 to 5
ACTIONS = ("allow", "redact", "warn", "block")
DEFAULT_ACTIONS = {"critical": "block", "high": "redact", "medium": "warn"}
SCORES = ((100, "critical"), (75, "high"), (50, "medium"), (25, "low"))
REDACTED = "<REDACTED>"


def severity_of(name: str | None) -> int:
    """The number of a severity; anything unknown is info."""
    return SEVERITIES.index(name) + 1 if name in SEVERITIES else 1


def severity_name(level: Column) -> Column:
    return F.coalesce(F.try_element_at(F.array(*map(F.lit, SEVERITIES)), F.when(level > 0, level)), F.lit("unknown"))


def score_label(score: Column) -> Column:
    return F.coalesce(*(F.when(score >= at, F.lit(name)) for at, name in SCORES), F.lit("none"))


def default_action(severity: Column) -> Column:
    return F.coalesce(*(F.when(severity == severity_of(s), F.lit(a)) for s, a in DEFAULT_ACTIONS.items()), F.lit("allow"))
