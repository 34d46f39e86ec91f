"""A whole scan: detectors, filters, directives, policy, baseline, suppressions."""

from __future__ import annotations

import os
from collections.abc import Sequence
from dataclasses import dataclass, fields, replace

from pyspark.sql import DataFrame, SparkSession

from gleanguard.operators import detectors, filters, report, schema, suppress
from gleanguard.plans import policy
from gleanguard.plans import rules as R
from gleanguard.sources import files, git, stored


@dataclass(frozen=True)
class ScanConfig:
    """Settings of a scan; a file's settings fill those that are still at their defaults."""

    detectors: Sequence[str] = detectors.ALL
    rules_dir: str = ""
    user_rules_dir: str = ""
    profile: str = ""
    policy_file: str = ""
    profiles_dir: str = ""
    policy_dir: str = ""
    min_confidence: float = 0.0
    min_severity: str = ""
    tags: Sequence[str] = ()
    fail_on: str = "high"
    inline: bool = True
    keyword: str = suppress.KEYWORD
    baseline: str = ""
    suppressions: str = ""
    ignore: Sequence[str] = ()
    skip_extensions: Sequence[str] = ()
    include_tests: bool = True
    max_files: int = 0
    max_file_size_mb: int = 0
    boundaries: Sequence[str] = ()
    diff_base: str = "main"
    verbose: bool = False

    def with_file(self, settings: dict) -> ScanConfig:
        known = {f.name: f.default for f in fields(self)}
        return replace(self, **{k: tuple(v) if isinstance(v, list) else v for k, v in settings.items() if k in known and getattr(self, k) == known[k]})

    def limits(self) -> R.Limits:
        return R.Limits(self.min_confidence, self.min_severity, tuple(self.tags))

    def walk(self) -> files.Walk:
        return files.Walk(self.ignore, tuple(self.skip_extensions) or tuple(files.SKIP_EXTENSIONS), max_files=self.max_files, include_tests=self.include_tests, max_file_size=self.max_file_size_mb * 1024 * 1024 or files.MAX_FILE_SIZE)


def raw_findings(docs: DataFrame, config: ScanConfig) -> DataFrame:
    """Detectors, the directives in the text and the three filters, over one reading of the documents and no shuffle.

    The filters and directives look at one finding each, so their order does not matter.
    """
    docs = schema.documents(docs)
    rules = R.load(config.rules_dir or None, config.user_rules_dir or None)
    found = detectors.run(docs, rules, config.detectors, config.limits(), config.keyword if config.inline else None)
    return filters.by_tags(filters.by_severity(filters.by_confidence(found, config.min_confidence), config.min_severity), config.tags)


def scan(docs: DataFrame, config: ScanConfig | None = None) -> DataFrame:
    """Findings of documents (path, content, ...) with their actions; baseline before suppressions."""
    config = config or ScanConfig()
    rules = policy.select_rules(config.profile, config.policy_file, config.profiles_dir or None, config.policy_dir or None)
    found = policy.apply(raw_findings(docs, config), rules)
    if config.baseline:
        found = suppress.new_findings(found, stored.read_baseline(docs.sparkSession, config.baseline))
    return suppress.without_suppressed(found, stored.read_suppressions(config.suppressions))


def update_baseline(docs: DataFrame, config: ScanConfig) -> None:
    """Writes what is new, before suppressions, into the baseline file."""
    found = scan(docs, replace(config, suppressions=""))
    stored.write_baseline(suppress.updated_baseline(stored.read_baseline(docs.sparkSession, config.baseline), found), config.baseline)


def read_source(spark: SparkSession, path: str, config: ScanConfig, diff: str | None = None, staged: bool = False) -> DataFrame:
    """Documents of a folder, of one file, or of a repository's changed or staged files (staged goes before)."""
    if staged or diff is not None:
        return files.read_paths(spark, path, git.staged_files(path) if staged else git.changed_files(path, diff or ""))
    if os.path.isdir(path) or "://" in path:
        return files.read_directory(spark, path, config.walk(), with_metadata="://" not in path)
    return files.read_file(spark, path)


def configured(path: str, config: ScanConfig, file: str = "") -> ScanConfig:
    """The settings with those of a file, or else of the nearest one above the path, in place of defaults."""
    if not file and "://" not in path:
        file = stored.find_config(path if os.path.isdir(path) else os.path.dirname(path) or ".") or ""
    return config.with_file(stored.read_config(file)) if file else config


def scan_path(spark: SparkSession, path: str, config: ScanConfig | None = None, diff: str | None = None, staged: bool = False) -> DataFrame:
    config = configured(path, config or ScanConfig())
    return scan(read_source(spark, path, config, diff, staged), config)


def exit_code(findings: DataFrame, config: ScanConfig) -> int:
    return int(findings.agg(filters.fails(config.fail_on)).first()[0])


def risk_report(findings: DataFrame) -> DataFrame:
    return report.risk(findings)
