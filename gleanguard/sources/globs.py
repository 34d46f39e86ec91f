"""Shell globs and ignore rules as anchored patterns for rlike, and the same in Python for file listings."""

from __future__ import annotations

import re
from collections.abc import Callable, Sequence

from pyspark.sql import Column
from pyspark.sql import functions as F


def glob_regex(glob: str) -> str | None:
    """One segment's glob (* ? [a-z] [^a] \\x) as a pattern; None where it is malformed, which matches nothing."""
    out, k = [], 0
    while k < len(glob):
        c = glob[k]
        if c == "*":
            out.append("[^/]*")
        elif c == "?":
            out.append("[^/]")
        elif c == "\\":
            k += 1
            if k == len(glob):
                return None
            out.append(re.escape(glob[k]))
        elif c == "[":
            m = re.match(r"\[(\^?)((?:\\.|[^\]\\])+)\]", glob[k:])
            if not m or m[2].startswith("-") or m[2].endswith("-"):
                return None
            out.append(f"[{m[1]}{m[2].replace('[', chr(92) + '[').replace('&', chr(92) + '&')}]")
            k += len(m[0]) - 1
        else:
            out.append(re.escape(c))
        k += 1
    return "".join(out)


def path_regex(glob: str) -> str | None:
    """A glob over segments; ** stands for any number of segments before another one, and for nothing at the end."""
    parts = []
    segments = glob.split("/")
    for k, s in enumerate(segments):
        last = k == len(segments) - 1
        if s == "**":
            if last:
                return None
            parts.append("(?:[^/]*/)*")
            continue
        r = glob_regex(s)
        if r is None:
            return None
        parts.append(r + ("" if last else "/"))
    return "".join(parts)


def ignore_rules(lines: Sequence[str]) -> list[tuple[str, bool, bool]]:
    """(pattern, negated, for directories) of an ignore file's lines; comments and empty lines go."""
    out = []
    for line in lines:
        line = line.strip()
        if not line or line.startswith("#"):
            continue
        negate = line.startswith("!")
        line = line[1:] if negate else line
        folder = line.endswith("/")
        out.append((line.removesuffix("/"), negate, folder))
    return out


def _rule_regexes(pattern: str, folder: bool) -> list[str]:
    """Patterns over the whole relative path, any of which is a match."""
    own = []
    if folder:
        p = re.escape(pattern)
        own += [rf"{p}/.*", rf".*/{p}/.*", rf"(?:.*/)?{p}"]
    if "/" in pattern or "**" in pattern:
        own.append(path_regex(pattern))
    one = glob_regex(pattern)
    if one is not None:
        own += [rf"(?:.*/)?{one}" if "/" not in pattern else one, one]
    return [rf"\A(?s:{r})\z" for r in own if r is not None]


def ignored(path: Column, rules: Sequence[tuple[str, bool, bool]]) -> Column:
    """Whether the last rule that matches a relative path ignores it."""
    verdict = [
        F.when(F.lit(False) if not (rx := _rule_regexes(p, folder)) else path.rlike("|".join(rx)), F.lit(not negate))
        for p, negate, folder in reversed(rules) if p
    ]
    return F.coalesce(*verdict, F.lit(False))


def ignorer(rules: Sequence[tuple[str, bool, bool]]) -> Callable[[str], bool]:
    compiled = [(re.compile("|".join(r.replace(r"\z", r"\Z") for r in rx)), negate) for p, negate, folder in rules if p and (rx := _rule_regexes(p, folder))]

    def verdict(path: str) -> bool:
        return next((not negate for rx, negate in reversed(compiled) if rx.match(path)), False)

    return verdict


def name_matches(path: Column, globs: Sequence[str]) -> Column:
    """Whether the path's last segment matches any of the globs."""
    rx = [r for g in globs if (r := glob_regex(g)) is not None]
    return F.substring_index(path, "/", -1).rlike(rf"\A(?s:{'|'.join(rx)})\z") if rx else F.lit(False)
