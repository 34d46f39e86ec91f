"""Pattern detectors: rule files, connection strings and tokens share one generator of findings.

Everything is an expression over one document's row, so a scan reads its documents once and moves nothing. First the
document gets the numbers of the patterns that match it: every pattern is a predicate of its own behind the literals that
its matches must hold, so most patterns cost a substring search. Only these patterns go over the text again and give an
array of findings. Lines and columns come from running sums over the matches and the gaps between them, so the work is in
proportion to the text and the matches.
"""

from __future__ import annotations

import json
from collections import Counter
from collections.abc import Sequence
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from gleanguard.functions import re2, text
from gleanguard.operators.schema import FINDINGS, exploded, finding
from gleanguard.plans.rules import Limits, Pattern, Rule
from gleanguard.sources.globs import name_matches

#: Bytes of a document that rule files see, and matches of one pattern in a document.
WINDOW, MOST_MATCHES = 10 * 1024 * 1024, 10_000
_TABLE = dict(c.rsplit(" ", 1) for c in "rule_ord int, pattern_ord int, detector_ord int, regex string, shift int, grp int, confidence double, severity int, rule_id string, type string, reason string, tags array<string>, line_start boolean, capped boolean".split(", "))
#: Matches whose places are summed in one go; sums of sums join them.
STRIDE = 512
#: Characters of a run that documents are looked through for once, for all patterns that need one as long.
LONG_RUN = 32
DETECTOR_ORDER = {"regex": 0, "database": 5, "oauth": 6}


def usable(rules: Sequence[Rule], limits: Limits | None = None) -> list[tuple[int, Rule, int, Pattern]]:
    """(rule's place in its detector, rule, pattern's place, pattern) of all that can match and be kept."""
    out, places = [], Counter()
    for rule in rules:
        r = places[rule.detector]
        places[rule.detector] += 1
        out += [(r, rule, p, pattern) for p, pattern in enumerate(rule.patterns) if not pattern.problem() and (limits or Limits()).keep(rule, pattern)]
    return out


def seen(content: Column) -> Column:
    """What rule files see of a document."""
    cut = F.make_valid_utf8(F.substring(F.encode(content, "UTF-8"), 1, WINDOW).cast("string"))
    return F.when(F.octet_length(content) > WINDOW, cut).otherwise(content)


def _guard(regex: str, content: Column, low: Column, long_run: Column) -> Column | None:
    found = re2.required(regex)
    if re2.longest_run(regex) >= LONG_RUN:
        return long_run
    if not found:
        return None
    literals, folded = found
    return text.contains_any(low if folded else content, literals)


def _allowed(rule: Rule, path: Column) -> Column | None:
    """The rule's file filter: exclusion first, then inclusion."""
    out = []
    if rule.exclude:
        out.append(~name_matches(path, rule.exclude))
    if rule.include:
        out.append(name_matches(path, rule.include))
    return reduce(lambda a, b: a & b, out) if out else None


def folded(content: Column) -> Column:
    """Lower case for literals that are looked for whatever their case."""
    return F.replace(F.lower(content), F.lit("ſ"), F.lit("s"))


def has_long_run(content: Column) -> Column:
    return content.rlike(f"[A-Za-z0-9_-]{{{LONG_RUN}}}")


def matching(patterns: list[tuple[int, Rule, int, Pattern]], path: Column, content: Column, low: Column, long_run: Column) -> Column:
    """The numbers of the patterns (by place in the list) that match a document; low and long_run are made once for all."""
    tests = []
    for n, (_, rule, _, pattern) in enumerate(patterns):
        test = (seen(content) if rule.detector == "regex" else content).rlike(re2.to_java(pattern.regex))
        for condition in (_guard(pattern.regex, content, low, long_run), _allowed(rule, path)):
            if condition is not None:
                test = F.when(condition, test)  # an AND has no fixed order
        tests.append(F.when(test, F.lit(n)))
    return F.array_compact(F.array(*tests)) if tests else F.array().cast("array<int>")


def pattern_table(patterns: list[tuple[int, Rule, int, Pattern]]) -> Column:
    """A constant array with what each pattern needs; one entry for each pattern of the rules."""
    rows = []
    for r, rule, p, pattern in patterns:
        regex, shift, group = pattern.regex, 0, pattern.group if pattern.group <= re2.groups(pattern.regex) else 0
        if group and (wrapped := re2.with_prefix_group(regex, group)):
            regex, shift, group = wrapped, 1, group + 1
        values = (r, p, DETECTOR_ORDER.get(rule.detector, 0), re2.to_java(regex), shift, group, pattern.confidence, rule.level, rule.id, rule.name, rule.description, list(rule.tags), rule.detector != "regex", rule.detector == "regex")
        rows.append(dict(zip(_TABLE, values, strict=True)))
    kind = ", ".join(f"{name}: {kind}" for name, kind in _TABLE.items())
    return F.from_json(F.lit(json.dumps(rows)), f"array<struct<{kind}>>")


def _size(part: Column, name: str) -> list[Column]:
    """Line feeds, bytes, and bytes after the last line feed of a part of the text."""
    feeds = F.length(part) - F.length(F.replace(part, F.lit("\n"), F.lit("")))
    return [feeds.alias(f"{name}_feeds"), F.octet_length(part).alias(f"{name}_bytes"), F.octet_length(F.substring_index(part, "\n", -1)).alias(f"{name}_tail")]


def _places(parts: Column) -> Column:
    """Of each match (before: the gap and what stands before the value; whole: the gap and the match): the value's line,
    and the bytes before it in the text and in its line."""
    state = "struct<feeds:int,bytes:int,tail:int,out:array<struct<line:int,bytes:int,tail:int>>>"

    def after(acc: Column, x: Column, name: str) -> list[Column]:
        tail = F.when(x[f"{name}_feeds"] > 0, x[f"{name}_tail"]).otherwise(acc["tail"] + x[f"{name}_bytes"])
        return [acc["feeds"] + x[f"{name}_feeds"], acc["bytes"] + x[f"{name}_bytes"], tail]

    def step(acc: Column, x: Column) -> Column:
        feeds, size, tail = after(acc, x, "before")
        here = F.struct((feeds + 1).alias("line"), size.alias("bytes"), tail.alias("tail"))
        return F.struct(*(c.alias(n) for c, n in zip(after(acc, x, "whole"), ("feeds", "bytes", "tail"), strict=True)), F.concat(acc["out"], F.array(here)).alias("out"))

    def stride(acc: Column, k: Column) -> Column:
        none = F.array().cast("array<struct<line:int,bytes:int,tail:int>>")
        start = F.struct(acc["feeds"].alias("feeds"), acc["bytes"].alias("bytes"), acc["tail"].alias("tail"), none.alias("out"))
        return text.let(F.aggregate(F.slice(parts, k * STRIDE + 1, STRIDE), start, step), lambda r: F.struct(
            r["feeds"].alias("feeds"), r["bytes"].alias("bytes"), r["tail"].alias("tail"), F.concat(acc["out"], F.array(r["out"])).alias("out")))

    zero = F.lit(0)
    begin = F.struct(zero.alias("feeds"), zero.alias("bytes"), zero.alias("tail"), F.array().cast("array<array<struct<line:int,bytes:int,tail:int>>>").alias("out"))
    return F.flatten(F.aggregate(F.sequence(zero, F.floor(F.greatest(F.size(parts) - 1, zero) / STRIDE).cast("int")), begin, stride)["out"])


def _matches(p: Column, path: Column, content: Column, lines: Column) -> Column:
    """Findings of one pattern (an entry of the table) in a text.

    Gaps between matches come from splitting at the pattern; the value's place in its match is the length of what the
    pattern has before the group, or the group's first place there where that is not known.
    """
    all_of = lambda group: F.regexp_extract_all(content, p["regex"], group)
    whole = F.slice(all_of(F.lit(0)), 1, F.when(p["capped"], F.lit(MOST_MATCHES)).otherwise(F.lit(2**31 - 1)))
    raw = F.arrays_zip(whole.alias("whole"), all_of(p["grp"]).alias("value"), F.split(content, p["regex"], -1).alias("gap"), F.when(p["shift"] == 1, all_of(F.lit(1))).otherwise(F.array().cast("array<string>")).alias("lead"))

    def part(x: Column) -> Column:
        within = F.when(p["grp"] == 0, F.lit(0)).when(p["shift"] == 1, F.length(x["lead"])).otherwise(F.greatest(F.instr(x["whole"], x["value"]) - 1, F.lit(0)))
        before = F.concat(x["gap"], F.substring(x["whole"], F.lit(1), within))
        return F.struct(x["value"].alias("value"), *_size(before, "before"), *_size(F.concat(x["gap"], x["whole"]), "whole"))

    def one(x: Column, at: Column, k: Column) -> Column:
        column = F.when(p["line_start"], at["bytes"] - at["tail"]).otherwise(at["tail"]) + 1
        return F.struct(*finding(
            type=p["type"], severity=p["severity"], confidence=p["confidence"], file=path, line=at["line"], column=column, value=x["value"], reason=p["reason"],
            rule_id=p["rule_id"], tags=p["tags"], context=text.context(lines, at["line"]), source_line=text.source_line(lines, at["line"]),
            detector_ord=p["detector_ord"], rule_ord=p["rule_ord"], pattern_ord=p["pattern_ord"], match_ord=k,
        ))

    def found(parts: Column) -> Column:
        placed = F.transform(F.arrays_zip(parts.alias("x"), _places(parts).alias("at")), lambda z, k: one(z["x"], z["at"], k))
        return F.filter(placed, lambda f: (p["grp"] == 0) | (f["value"] != ""))

    # the split has one part more than there are matches
    return text.let(F.transform(F.filter(raw, lambda x: x["whole"].isNotNull()), part), found)


def findings_of(patterns: list[tuple[int, Rule, int, Pattern]], hits: Column, path: Column, content: Column, lines: Column) -> Column:
    """Findings of the patterns with the numbers `hits` in a text and its lines."""
    if not patterns:
        return F.array().cast(FINDINGS)
    long = F.octet_length(content) > WINDOW

    def of_one(p: Column) -> Column:
        # beyond the window rule files see another text than the rest
        cut = p["capped"] & long
        return text.let(F.when(cut, seen(content)).otherwise(content), lambda c: text.let(F.when(cut, text.lines(c)).otherwise(lines), lambda own: _matches(p, path, c, own)))

    table = pattern_table(patterns)
    return F.flatten(F.transform(F.transform(hits, lambda n: F.get(table, n)), of_one))


def detect(docs: DataFrame, rules: Sequence[Rule], limits: Limits | None = None) -> DataFrame:
    """Findings of the rules' patterns in (path, content, is_binary); binary documents give none.

    Rules of all three detectors may come together. A column is counted in bytes from the line's start for rule files; for
    the other two detectors it is one and the byte at which the line starts.
    """
    patterns = usable(rules, limits)
    path, content = F.col("path"), F.col("content")
    plain = docs.where(~F.col("is_binary") & content.isNotNull()).select("path", "content")
    # once for all patterns; predicates on hits must not be pushed below, where they would repeat all of this
    once = text.computed(plain, low=folded(content), long_run=has_long_run(content))
    hit = text.computed(once, hits=matching(patterns, path, content, F.col("low"), F.col("long_run"))).select("path", "content", "hits")
    lined = text.computed(hit.where(F.size("hits") > 0), lines=text.lines(content))
    return exploded(lined.select(findings_of(patterns, F.col("hits"), path, content, F.col("lines")).alias("found")))
