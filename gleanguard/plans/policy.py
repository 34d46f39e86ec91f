"""Policies: the first rule that fits a finding says what to do with it."""

from __future__ import annotations

import os
import warnings
from collections.abc import Sequence
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from gleanguard.plans.levels import REDACTED, default_action, severity_of


@dataclass(frozen=True)
class PolicyRule:
    tags: tuple[str, ...]
    action: str
    min_severity: str = ""
    reason: str = ""


@dataclass(frozen=True)
class Profile:
    name: str
    description: str
    rules: tuple[PolicyRule, ...]
    extends: str = ""


def _rules(text: str) -> tuple[PolicyRule, ...]:
    out = []
    for line in text.strip().splitlines():
        tag, action, least = (line.split() + [""])[:3]
        out.append(PolicyRule((tag,), action, least))
    return tuple(out)


#: Fixed values: "tag action least-severity" of each shipped profile, in order.
PROFILES = {
    "default": Profile("Default", "Base policy profile with sensible defaults", _rules("""
        private-key block
        credentials block critical
        credentials redact high
        credentials warn medium
        jwt block
        env warn
        cloud redact high
        api-key redact
    """)),
    "developer": Profile("Developer", "For local development: what is high or above becomes a warning", _rules("""
        * warn high
        env allow
    """), "default"),
    "enterprise": Profile("Enterprise", "Strictest profile", _rules("""
        * block medium
        cloud block
        api-key block
        env block
        vcs block
        credentials block
        private-key block
        jwt block
        certificate redact
    """), "default"),
    "public-github": Profile("Public GitHub", "For pushing to public repositories", _rules("""
        private-key block
        jwt block
        credentials block critical
        credentials redact high
        credentials redact medium
        cloud redact
        env redact
        api-key redact
        vcs redact
    """), "default"),
}


def _parsed(items: Sequence[dict]) -> tuple[PolicyRule, ...]:
    return tuple(PolicyRule(tuple(i.get("tags") or ()), i.get("action") or "", i.get("min_severity") or "", i.get("reason") or "") for i in items or ())


def policy_from_file(path: str) -> tuple[PolicyRule, ...]:
    import yaml

    with open(path, encoding="utf-8") as f:
        return _parsed((yaml.safe_load(f) or {}).get("policies"))


def profile_named(name: str, directory: str | None = None) -> Profile:
    """A profile from name.yml or name.yaml of a folder; without a folder, a shipped one."""
    if directory is None:
        if name not in PROFILES:
            raise FileNotFoundError(f"no profile {name}")
        return PROFILES[name]
    import yaml

    for end in (".yml", ".yaml"):
        path = os.path.join(directory, name + end)
        if os.path.exists(path):
            with open(path, encoding="utf-8") as f:
                spec = yaml.safe_load(f) or {}
            return Profile(spec.get("name") or "", spec.get("description") or "", _parsed(spec.get("actions")), spec.get("extends") or "")
    raise FileNotFoundError(f"no profile {name} in {directory}")


def resolved(name: str, directory: str | None = None) -> tuple[PolicyRule, ...]:
    """A profile's rules and after them those of the profiles that it extends."""
    out: tuple[PolicyRule, ...] = ()
    seen: list[str] = []
    while name:
        if name in seen:
            raise ValueError(f"profiles extend each other: {' -> '.join([*seen, name])}")
        seen.append(name)
        profile = profile_named(name, directory)
        out, name = out + profile.rules, profile.extends
    return out


def select_rules(profile: str = "", policy_file: str = "", profiles_dir: str | None = None, policy_dir: str | None = None) -> tuple[PolicyRule, ...]:
    """A profile before a policy file before default.yml of a folder before the shipped default."""
    if profile:
        if policy_file:
            warnings.warn(f"both a profile and a policy file are given; the profile {profile!r} goes before", stacklevel=2)
        return resolved(profile, profiles_dir)
    if policy_file:
        return policy_from_file(policy_file)
    return policy_from_file(os.path.join(policy_dir, "default.yml")) if policy_dir else PROFILES["default"].rules


def action(rules: Sequence[PolicyRule], tags: Column, severity: Column) -> Column:
    """The action of the first rule with a common tag (or *) and low enough a severity; else by severity."""
    tests = []
    for r in rules:
        if not r.tags:
            continue
        fits = F.lit(True) if "*" in r.tags else F.coalesce(F.arrays_overlap(tags, F.array(*map(F.lit, r.tags))), F.lit(False))
        if r.min_severity:
            fits = fits & (severity >= severity_of(r.min_severity))
        tests.append(F.when(fits, F.lit(r.action)))
    return F.coalesce(*tests, default_action(severity))


def apply(findings: DataFrame, rules: Sequence[PolicyRule]) -> DataFrame:
    """Sets the action, puts it before the reason, and redacts values to be redacted."""
    decided = findings.withColumn("action", action(rules, F.col("tags"), F.col("severity")))
    return decided.withColumns({
        "reason": F.concat("action", F.lit(": "), F.coalesce("reason", F.lit(""))),
        "value": F.when(F.col("action") == "redact", F.lit(REDACTED)).otherwise(F.col("value")),
    })
