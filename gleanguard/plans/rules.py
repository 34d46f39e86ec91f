"""Rules and their patterns: the shipped ones, YAML files, and users' own on top."""

from __future__ import annotations

import os
from dataclasses import dataclass, field
from pathlib import Path

from gleanguard.functions import re2
from gleanguard.plans.levels import severity_of

_DATA = Path(__file__).parent / "rules_data"


@dataclass(frozen=True)
class Pattern:
    regex: str
    confidence: float
    group: int = 0

    def problem(self) -> str | None:
        """Why the pattern is left out, if it is."""
        if self.group < 0:
            return "negative capture group"
        if re2.is_dangerous(self.regex):
            return "dangerous"
        try:
            re2.to_java(self.regex)
        except re2.Unsupported as e:
            return str(e)
        return None


@dataclass(frozen=True)
class Rule:
    id: str
    name: str
    severity: str
    tags: tuple[str, ...] = ()
    description: str = ""
    patterns: tuple[Pattern, ...] = ()
    include: tuple[str, ...] = ()
    exclude: tuple[str, ...] = ()
    detector: str = "regex"

    @property
    def level(self) -> int:
        return severity_of(self.severity)


@dataclass(frozen=True)
class Limits:
    """Which rules can give findings that later filters keep; known before any text is read."""

    min_confidence: float = 0.0
    min_severity: str = ""
    tags: tuple[str, ...] = field(default=())

    def keep(self, rule: Rule, pattern: Pattern) -> bool:
        return not (
            self.min_confidence > 0 and pattern.confidence < self.min_confidence
            or self.min_severity and rule.level < severity_of(self.min_severity)
            or self.tags and not set(self.tags) & set(rule.tags)
        )


def _listed(name: str, detector: str) -> tuple[Rule, ...]:
    out: list[Rule] = []
    for line in (_DATA / f"{name}.rules").read_text(encoding="utf-8").splitlines():
        if line.startswith("rule "):
            parts = [x.strip() for x in line[5:].split("|", 5)]
            words = lambda x: tuple(w for w in x.split(",") if w)
            out.append(Rule(parts[0], parts[1], parts[2], words(parts[3]), parts[5], (), (), words(parts[4]), detector))
        elif line.startswith("  "):
            confidence, group, regex = line[2:].split(" ", 2)
            last = out[-1]
            out[-1] = Rule(**{**last.__dict__, "patterns": (*last.patterns, Pattern(regex, float(confidence), int(group)))})
    return tuple(out)


def shipped() -> tuple[Rule, ...]:
    return _listed("pattern", "regex")


def database() -> tuple[Rule, ...]:
    return _listed("database", "database")


def oauth() -> tuple[Rule, ...]:
    return _listed("oauth", "oauth")


def from_mapping(spec: dict) -> list[Rule]:
    """Rules of a parsed file {"rules": [...]}; those of another type are left out."""
    out = []
    for r in (spec or {}).get("rules") or []:
        if r.get("type") != "regex":
            continue
        files = r.get("file_filter") or {}
        patterns = tuple(Pattern(str(p["regex"]), float(p.get("confidence") or 0), int(p.get("capture_group") or 0)) for p in r.get("patterns") or [])
        out.append(Rule(r["id"], r.get("name") or "", r.get("severity") or "", tuple(r.get("tags") or ()), r.get("description") or "", patterns, tuple(files.get("include") or ()), tuple(files.get("exclude") or ())))
    return out


def from_directory(path: str) -> list[Rule]:
    """Rules of the .yml and .yaml files of a folder, in the names' order, subfolders left out."""
    import yaml

    out: list[Rule] = []
    for name in sorted(os.listdir(path)):
        if name.endswith((".yml", ".yaml")) and os.path.isfile(os.path.join(path, name)):
            with open(os.path.join(path, name), encoding="utf-8") as f:
                out += from_mapping(yaml.safe_load(f))
    return out


def user_rules_dir() -> str:
    base = os.environ.get("XDG_CONFIG_HOME") or os.path.join(os.path.expanduser("~"), ".config")
    return os.path.join(base, "gleanguard", "rules")


def overlaid(rules: list[Rule] | tuple[Rule, ...], own: list[Rule]) -> list[Rule]:
    """A user's rule of the same id replaces a given one; users' rules come last."""
    ids = {r.id for r in own}
    return [*(r for r in rules if r.id not in ids), *own]


def load(directory: str | None = None, user_directory: str | None = None) -> list[Rule]:
    """The shipped rules or a folder's, and on top the users' own, whose errors of any kind are passed over."""
    import yaml

    rules = from_directory(directory) if directory else list(shipped())
    try:
        own = from_directory(user_directory or user_rules_dir())
    except (OSError, ValueError, KeyError, TypeError, AttributeError, yaml.YAMLError):
        own = []
    return overlaid(rules, own)
