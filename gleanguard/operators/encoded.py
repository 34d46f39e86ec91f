"""Secrets in base64 text: runs are decoded and go through the rule files' patterns."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from gleanguard.functions import classify, re2, text
from gleanguard.operators import patterns as m
from gleanguard.operators.schema import FINDINGS, exploded, finding
from gleanguard.plans.rules import Limits, Rule

#: The runs, the least bytes and entropy of what is decoded, and what findings say.
RUN = r"\b([A-Za-z0-9+/]{4}){3,}([A-Za-z0-9+/]{2}==|[A-Za-z0-9+/]{3}=|[A-Za-z0-9+/]{4})\b"
SHORTEST_RUN, SHORTEST, LEAST_ENTROPY = 16, 8, 3.5
SUFFIX, TYPE, REASON = " (base64 decoded)", "base64_", "Base64 encoded secret detected: "
CONTEXT = "\n[Base64 encoded content detected and decoded]"


def byte_entropy(content: Column) -> Column:
    return text.entropy(F.decode(content, "ISO-8859-1"))


def candidates(docs: DataFrame) -> DataFrame:
    """(path, run_ord, run, raw: the decoded bytes) of runs that decode to enough bytes of enough entropy."""
    run = re2.to_java(RUN)
    plain = docs.where(~F.col("is_binary") & F.col("content").rlike(run))
    found = plain.select("path", F.posexplode(F.regexp_extract_all("content", F.lit(run), 0)).alias("run_ord", "run")).where(F.length("run") >= SHORTEST_RUN)
    raw = found.withColumn("raw", F.try_to_binary("run", F.lit("base64"))).where(F.col("raw").isNotNull() & (F.length("raw") >= SHORTEST))
    return raw.where(byte_entropy(F.col("raw")) >= LEAST_ENTROPY)


def findings_of(patterns: list, path: Column, content: Column) -> Column:
    """A document's findings in its decoded runs, lines and columns counted there; one level deep, with the patterns given."""
    outer = F.concat(path, F.lit(SUFFIX))

    def decoded(run: Column, k: Column) -> Column:
        return F.struct(run.alias("run"), k.alias("k"), F.try_to_binary(run, F.lit("base64")).alias("raw"))

    runs = F.filter(F.transform(F.regexp_extract_all(content, F.lit(re2.to_java(RUN)), F.lit(0)), decoded), lambda x: (F.length(x["run"]) >= SHORTEST_RUN) & (F.length(x["raw"]) >= SHORTEST))
    texts = F.filter(runs, lambda x: (byte_entropy(x["raw"]) >= LEAST_ENTROPY) & ~classify.has_nul(x["raw"]))

    def renamed(f: Column, k: Column) -> Column:
        changed = {
            "type": F.concat(F.lit(TYPE), f["type"]), "reason": F.concat(F.lit(REASON), f["reason"]), "context": F.concat(f["context"], F.lit(CONTEXT)),
            "detector_ord": F.lit(4), "rule_ord": k * 100_000 + f["rule_ord"],
        }
        return F.struct(*finding(**{n: changed.get(n, f[n]) for n in FINDINGS.elementType.names}))

    def found(x: Column) -> Column:
        inner = F.make_valid_utf8(x["raw"].cast("string"))
        hits = lambda t: m.matching(patterns, outer, t, m.folded(t), m.has_long_run(t))
        every = text.let(inner, lambda t: text.let(hits(t), lambda h: F.when(F.size(h) > 0, m.findings_of(patterns, h, outer, t, text.lines(t))).otherwise(F.array().cast(FINDINGS))))
        return F.transform(every, lambda f: renamed(f, x["k"]))

    return F.flatten(F.transform(texts, found)) if patterns else F.array().cast(FINDINGS)


def detect(docs: DataFrame, rules: Sequence[Rule], limits: Limits | None = None) -> DataFrame:
    """Findings in decoded text of text documents; rule files' patterns only."""
    patterns = m.usable([r for r in rules if r.detector == "regex"], limits)
    some = docs.where(~F.col("is_binary") & F.col("content").rlike(re2.to_java(RUN))).select("path", "content")
    return exploded(some.select(findings_of(patterns, F.col("path"), F.col("content")).alias("found")))
