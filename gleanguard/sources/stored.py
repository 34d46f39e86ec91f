"""Baselines, suppression lists and settings kept in files."""

from __future__ import annotations

import json
import os

from pyspark.sql import DataFrame, SparkSession

from gleanguard.operators.suppress import Suppression

CONFIG_NAMES = (".gleanguard.yml", ".gleanguard.yaml", "gleanguard.yml", "gleanguard.yaml")


def read_baseline(spark: SparkSession, path: str) -> DataFrame:
    """(hash, location) of a baseline file; empty where there is none."""
    known: dict[str, str] = {}
    if path and os.path.exists(path):
        with open(path, encoding="utf-8") as f:
            known = json.load(f).get("findings") or {}
    return spark.createDataFrame(sorted(known.items()), "hash string, location string")


def write_baseline(baseline: DataFrame, path: str, version: str = "1") -> None:
    with open(path, "w", encoding="utf-8") as f:
        json.dump({"version": version, "findings": {r["hash"]: r["location"] for r in baseline.orderBy("hash").collect()}}, f, indent=2)


def read_suppressions(path: str) -> list[Suppression]:
    if not path or not os.path.exists(path):
        return []
    with open(path, encoding="utf-8") as f:
        found = json.load(f).get("suppressions") or []
    return [Suppression(**{k: s.get(k) or "" for k in ("id", "rule_id", "file", "pattern", "reason")}) for s in found]


def write_suppressions(entries: list[Suppression], path: str, version: str = "1") -> None:
    with open(path, "w", encoding="utf-8") as f:
        json.dump({"version": version, "suppressions": [{k: v for k, v in s.__dict__.items() if v} for s in entries]}, f, indent=2)


def find_config(start: str) -> str | None:
    """The nearest settings file in a folder or those above it."""
    folder = os.path.abspath(start)
    while True:
        for name in CONFIG_NAMES:
            if os.path.isfile(path := os.path.join(folder, name)):
                return path
        if folder == (folder := os.path.dirname(folder)):
            return None


def read_config(path: str) -> dict:
    import yaml

    with open(path, encoding="utf-8") as f:
        return yaml.safe_load(f) or {}
