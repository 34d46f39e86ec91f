"""Words of high entropy, by line."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from gleanguard.functions import re2, text
from gleanguard.operators.schema import exploded, finding

#: The words, the words beside them that make them suspicious, thresholds and scores.
WORD = r"[A-Za-z0-9\-_+=/]{20,}"
KEYWORDS = r"(?i)(key|token|secret|password|passwd|credential|auth|api[_-]?key|access[_-]?token|private[_-]?key|secret[_-]?key)"
LEAST_ENTROPY, LEAST_CONFIDENCE, MOST_CONFIDENCE = 4.0, 0.15, 0.9
BY_ENTROPY = ((5.0, 0.4), (4.5, 0.3), (4.0, 0.2))
BY_LENGTH = ((40, 0.2), (32, 0.15), (24, 0.1))
BY_KEYWORD = 0.3


def confidence(entropy: Column, length: Column, keyword: Column) -> Column:
    def score(value: Column, table) -> Column:
        return F.coalesce(*(F.when(value >= at, F.lit(s)) for at, s in table), F.lit(0.0))

    total = score(entropy, BY_ENTROPY) + score(length, BY_LENGTH) + F.when(keyword, F.lit(BY_KEYWORD)).otherwise(F.lit(0.0))
    return F.least(total, F.lit(MOST_CONFIDENCE))


def words(docs: DataFrame) -> DataFrame:
    """(path, line, trimmed, keyword, match_ord, word, entropy) for all words of text documents."""
    plain = docs.where(~F.col("is_binary") & F.col("content").rlike(WORD))
    by_line = plain.select("path", F.posexplode(text.lines(F.col("content"))).alias("at", "raw")).where(F.col("raw").rlike(WORD))
    trimmed = by_line.select("path", (F.col("at") + 1).alias("line"), text.trimmed(F.col("raw")).alias("trimmed"))
    found = trimmed.select("*", F.posexplode(F.regexp_extract_all("trimmed", F.lit(WORD), 0)).alias("match_ord", "word"))
    return found.withColumns({"keyword": F.col("trimmed").rlike(re2.to_java(KEYWORDS)), "entropy": text.entropy(F.col("word"))})


def findings_of(path: Column, lines: Column) -> Column:
    """A document's findings: words whose entropy and confidence are high enough; a column is one and the bytes before
    the word's first place in the trimmed line."""

    def one(row: Column, w: Column) -> Column:
        trimmed = row["trimmed"]
        before = F.substring(trimmed, F.lit(1), F.instr(trimmed, w["word"]) - 1)
        return F.struct(*finding(
            type=F.lit("High Entropy String"), severity=F.lit(2), confidence=w["confidence"], file=path, line=row["line"],
            column=F.octet_length(before) + 1, value=w["word"], reason=F.lit("High-entropy string detected (potential secret)"),
            rule_id=F.lit("entropy-high"), tags=F.array(F.lit("entropy"), F.lit("potential-secret")), source_line=trimmed,
            detector_ord=F.lit(3), rule_ord=row["line"], pattern_ord=F.lit(0), match_ord=w["match_ord"],
        ))

    def scored(row: Column, word: Column, k: Column) -> Column:
        return text.let(text.entropy(word), lambda e: F.struct(word.alias("word"), k.alias("match_ord"), e.alias("entropy"), confidence(e, F.length(word), row["keyword"]).alias("confidence")))

    def in_line(row: Column) -> Column:
        every = F.transform(F.regexp_extract_all(row["trimmed"], F.lit(WORD), F.lit(0)), lambda w, k: scored(row, w, k))
        return F.transform(F.filter(every, lambda w: (w["entropy"] >= LEAST_ENTROPY) & (w["confidence"] >= LEAST_CONFIDENCE)), lambda w: one(row, w))

    numbered = F.filter(F.transform(lines, lambda x, k: F.struct((k + 1).alias("line"), x.alias("raw"))), lambda x: x["raw"].rlike(WORD))
    trimmed = F.transform(numbered, lambda x: text.let(text.trimmed(x["raw"]), lambda t: F.struct(x["line"].alias("line"), t.alias("trimmed"), t.rlike(re2.to_java(KEYWORDS)).alias("keyword"))))
    return F.flatten(F.transform(trimmed, in_line))


def detect(docs: DataFrame) -> DataFrame:
    """Findings of text documents (path, content, is_binary)."""
    some = docs.where(~F.col("is_binary") & F.col("content").rlike(WORD)).select("path", "content")
    return exploded(some.select(findings_of(F.col("path"), text.lines(F.col("content"))).alias("found")))
