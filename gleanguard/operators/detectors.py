"""The detectors by name; others can be registered.

Those of this package are expressions over one document's row: a scan with any of them reads its documents once, makes one
array of findings for each and moves nothing. A registered detector takes and gives DataFrames and reads by itself.
"""

from __future__ import annotations

from collections.abc import Callable, Sequence
from functools import reduce

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from gleanguard.functions import re2, text
from gleanguard.operators import encoded, entropy, metadata, patterns, suppress
from gleanguard.operators.schema import FINDINGS, exploded
from gleanguard.plans import rules as R

Detector = Callable[[DataFrame, Sequence[R.Rule], R.Limits], DataFrame]

_KNOWN: dict[str, Detector] = {
    "regex": lambda docs, rules, limits: patterns.detect(docs, rules, limits),
    "filetype": lambda docs, rules, limits: metadata.file_types(docs),
    "symlink": lambda docs, rules, limits: metadata.symlinks(docs),
    "entropy": lambda docs, rules, limits: entropy.detect(docs),
    "base64": lambda docs, rules, limits: encoded.detect(docs, rules, limits),
    "database": lambda docs, rules, limits: patterns.detect(docs, R.database(), limits),
    "oauth": lambda docs, rules, limits: patterns.detect(docs, R.oauth(), limits),
}
_OWN = dict(_KNOWN)
ALL = tuple(_KNOWN)


def register_detector(name: str, detector: Detector) -> None:
    """Adds a detector (documents, rules, limits) -> findings, or puts it in another's place."""
    _KNOWN[name] = detector


def detector(name: str) -> Detector | None:
    return _KNOWN.get(name)


def preset(findings: Sequence[dict]) -> Detector:
    """A detector for tests: it gives these findings (columns by name; file is the document's) for every document."""
    from gleanguard.operators.schema import finding

    def detect(docs: DataFrame, rules: Sequence[R.Rule], limits: R.Limits) -> DataFrame:
        given = {"detector_ord": 7, "rule_ord": 0, "pattern_ord": 0, "line": 1, "column": 1}
        lit = lambda v: F.array(*map(F.lit, v)) if isinstance(v, (list, tuple)) else F.lit(v)
        every = [F.struct(*finding(file=F.col("path"), match_ord=F.lit(k), **{n: lit(v) for n, v in {**given, **f}.items()})) for k, f in enumerate(findings)]
        return exploded(docs.select((F.array(*every) if every else F.array().cast(FINDINGS)).alias("found")))

    return detect


def _together(docs: DataFrame, rules: Sequence[R.Rule], names: Sequence[str], limits: R.Limits, keyword: str | None) -> DataFrame:
    """Findings of this package's own detectors, in one pass; with a keyword, without those under a directive."""
    path, content = F.col("path"), F.col("content")
    ruled = [r for r in rules if r.detector == "regex"]
    every = patterns.usable([r for n, own in (("regex", rules), ("database", R.database()), ("oauth", R.oauth())) if n in names for r in own], limits)
    inner = patterns.usable(ruled, limits) if "base64" in names else []
    text_of = docs.withColumn("content", F.when(~F.col("is_binary"), content))
    once = text.computed(text_of, low=patterns.folded(content), long_run=patterns.has_long_run(content)) if every else text_of
    tests = {
        "hits": patterns.matching(every, path, content, F.col("low"), F.col("long_run")) if every else F.array().cast("array<int>"),
        "words": content.rlike(entropy.WORD) if "entropy" in names else F.lit(False), "runs": content.rlike(re2.to_java(encoded.RUN)) if inner else F.lit(False),
    }
    hit = text.computed(once, **tests)
    lined = text.computed(hit, lines=F.when((F.size("hits") > 0) | F.col("words"), text.lines(content)))
    none, parts = F.array().cast(FINDINGS), []
    if "filetype" in names:
        parts.append(metadata.file_type_findings())
    if "symlink" in names:
        parts.append(metadata.symlink_findings())
    if every:
        parts.append(F.when(F.size("hits") > 0, patterns.findings_of(every, F.col("hits"), path, content, F.col("lines"))).otherwise(none))
    if "entropy" in names:
        parts.append(F.when(F.col("words"), entropy.findings_of(path, F.col("lines"))).otherwise(none))
    if inner:
        parts.append(F.when(F.col("runs"), encoded.findings_of(inner, path, content)).otherwise(none))
    found = text.computed(lined, found=F.concat(*parts) if parts else none).where(F.size("found") > 0)
    return exploded(found.select(suppress.uncovered(F.col("found"), content, keyword).alias("found") if keyword else F.col("found")))


def run(docs: DataFrame, rules: Sequence[R.Rule], names: Sequence[str] = ALL, limits: R.Limits | None = None, keyword: str | None = None) -> DataFrame:
    """All findings of the named detectors, with a keyword without those under a directive in the text; unknown names are
    passed over."""
    limits = limits or R.Limits()
    own = [n for n in names if n in _OWN and _KNOWN[n] is _OWN[n]]
    found = [_together(docs, rules, own, limits, keyword)]
    for n in names:
        if n not in own and (d := detector(n)):
            others = d(docs, rules, limits)
            found.append(suppress.without_inline(others, docs, keyword) if keyword else others)
    return reduce(lambda a, b: a.unionByName(b), found)
