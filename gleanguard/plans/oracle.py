"""DuckDB SQL for the same findings, written from the rules' own patterns: RE2 there as it is."""

from __future__ import annotations

from collections.abc import Sequence

from gleanguard.functions import re2
from gleanguard.operators import encoded, entropy, suppress
from gleanguard.operators.patterns import DETECTOR_ORDER, usable
from gleanguard.plans import policy
from gleanguard.plans.levels import REDACTED, SEVERITIES, severity_of
from gleanguard.plans.rules import Rule


def quoted(text: str) -> str:
    return "'" + text.replace("'", "''") + "'"


def listed(items: Sequence[str]) -> str:
    return "[" + ", ".join(map(quoted, items)) + "]" + ("::VARCHAR[]" if not items else "")


def patterns_cte(rules: Sequence[Rule]) -> str:
    """rules(n, ...): one row for each pattern."""
    rows = []
    for n, (r, rule, p, pattern) in enumerate(usable(rules)):
        rows.append(f"({n}, {r}, {p}, {DETECTOR_ORDER[rule.detector]}, {pattern.confidence}::DOUBLE, {rule.level}, {quoted(rule.id)}, {quoted(rule.name)}, {quoted(rule.description)}, {listed(rule.tags)})")
    return "patterns(n, rule_ord, pattern_ord, detector_ord, confidence, severity, rule_id, type, reason, tags) AS (VALUES " + ", ".join(rows) + ")"


def findings_ctes(docs: str, rules: Sequence[Rule], name: str = "findings", table: str = "docs") -> str:
    """CTEs up to `findings` over docs(path, content); each pattern's matches, gaps and what stands before its group."""
    hits = []
    for n, (_, rule, _, pattern) in enumerate(usable(rules)):
        group = pattern.group if pattern.group <= re2.groups(pattern.regex) else 0
        wrapped = re2.with_prefix_group(pattern.regex, group) if group else None
        rx = quoted(pattern.regex)
        before = f"regexp_extract_all(content, {quoted(wrapped)}, 1)" if wrapped else "NULL::VARCHAR[]"
        allowed = "".join(f" AND NOT ends_with(path, {quoted(g.removeprefix('*'))})" for g in rule.exclude)
        hits.append(
            f"SELECT {n} AS n, path, content, regexp_extract_all(content, {rx}, 0) AS whole, regexp_extract_all(content, {rx}, {group}) AS vals, "
            f"{before} AS pre, string_split_regex(content, {rx}) AS gap FROM {table} WHERE regexp_matches(content, {rx}){allowed}"
        )
    start = (
        "list_sum(list_transform(whole[1:k], lambda x: length(x))) - length(whole[k]) + list_sum(list_transform(gap[1:k], lambda x: length(x))) + coalesce(length(pre[k]), 0)"
    )
    placed = f"SELECT *, substr(content, 1, CAST({start} AS BIGINT)) AS prefix FROM (SELECT *, unnest(range(1, len(whole) + 1)) AS k FROM {name}_hits)"
    last = "strlen(string_split(prefix, chr(10))[-1])"
    return (
        f"{docs}{name}_hits AS ({' UNION ALL '.join(hits)}), {name}_placed AS ({placed}), {patterns_cte(rules).replace('patterns(', name + '_patterns(', 1)}, {name} AS ("
        f"SELECT f.path AS file, p.rule_id, p.type, p.reason, p.tags, p.severity, p.confidence, p.detector_ord, p.rule_ord, p.pattern_ord, f.k - 1 AS match_ord, f.vals[f.k] AS value, "
        f"1 + length(prefix) - length(replace(prefix, chr(10), '')) AS line, "
        f"CASE WHEN p.detector_ord = 0 THEN {last} + 1 ELSE strlen(prefix) - {last} + 1 END AS \"column\" "
        f"FROM {name}_placed f JOIN {name}_patterns p USING (n) WHERE f.vals[f.k] <> '')"
    )


def action_sql(rules: Sequence[policy.PolicyRule]) -> str:
    whens = []
    for r in rules:
        fits = "TRUE" if "*" in r.tags else f"list_has_any(tags, {listed(r.tags)})"
        whens.append(f"WHEN {fits} AND severity >= {severity_of(r.min_severity)} THEN {quoted(r.action)}")
    return f"CASE {' '.join(whens)} WHEN severity = 5 THEN 'block' WHEN severity = 4 THEN 'redact' WHEN severity = 3 THEN 'warn' ELSE 'allow' END"


def decided_cte(rules: Sequence[policy.PolicyRule], source: str = "findings") -> str:
    return (
        f"decided AS (SELECT * EXCLUDE (value, reason), action || ': ' || reason AS reason, CASE WHEN action = 'redact' THEN {quoted(REDACTED)} ELSE value END AS value "
        f"FROM (SELECT *, {action_sql(rules)} AS action FROM {source}))"
    )


def json_sql() -> str:
    text = lambda c: f"'\"' || replace(replace(replace(replace(replace(replace({c}, '\\', '\\\\'), '\"', '\\\"'), chr(10), '\\n'), '<', '\\u003c'), '>', '\\u003e'), '&', '\\u0026') || '\"'"
    return f"'{{\"file\":' || {text('file')} || ',\"line\":' || line || ',\"rule_id\":' || {text('rule_id')} || CASE WHEN value <> '' THEN ',\"value\":' || {text('value')} ELSE '' END || '}}'"


def entropy_sql() -> str:
    word = quoted(entropy.WORD)
    blank = "chr(9) || chr(10) || chr(11) || chr(12) || chr(13) || ' '"
    return f"""
words AS (
  SELECT path, line, trimmed, regexp_matches(trimmed, {quoted(entropy.KEYWORDS)}) AS keyword, unnest(regexp_extract_all(trimmed, {word})) AS word
  FROM (SELECT path, k AS line, trim(ls[k], {blank}) AS trimmed FROM (SELECT path, ls, unnest(range(1, len(ls) + 1)) AS k FROM (SELECT path, string_split(content, chr(10)) AS ls FROM docs)))
), scored AS (SELECT *, round(list_aggregate(string_split(word, ''), 'entropy'), 6) AS entropy FROM words)"""


def confidence_sql() -> str:
    def case(value: str, table) -> str:
        return "CASE " + " ".join(f"WHEN {value} >= {at} THEN {s}::DOUBLE" for at, s in table) + " ELSE 0::DOUBLE END"

    total = f"{case('entropy', entropy.BY_ENTROPY)} + {case('length(word)', entropy.BY_LENGTH)} + CASE WHEN keyword THEN {entropy.BY_KEYWORD}::DOUBLE ELSE 0 END"
    return f"least({total}, {entropy.MOST_CONFIDENCE}::DOUBLE)"


def base64_sql() -> str:
    run = quoted(encoded.RUN)
    return f"runs AS (SELECT path, unnest(regexp_extract_all(content, {run}, 0)) AS run FROM docs), decoded AS (SELECT path, run, from_base64(run) AS raw FROM runs WHERE length(run) % 4 = 0)"


def directives_sql(keyword: str = suppress.KEYWORD) -> str:
    own, end = quoted(suppress.directive(keyword)), quoted(suppress.AT_LINE_END)
    return f"""
by_line AS (SELECT path, len(ls) AS last, k AS at_line, ls[k] AS line FROM (SELECT path, ls, unnest(range(1, len(ls) + 1)) AS k FROM (SELECT path, string_split(content, chr(10)) AS ls FROM docs))),
directives AS (
  SELECT path, at_line, last, CASE WHEN regexp_matches(line, {own}) AND len(own) > 0 THEN own END AS rules
  FROM (SELECT *, list_filter(list_transform(string_split(regexp_extract(line, {own}, 1), ','), lambda x: trim(x)), lambda x: x <> '') AS own FROM by_line)
  WHERE regexp_matches(line, {own}) OR regexp_matches(line, {end})
)"""


SEVERITY_NAMES = listed(SEVERITIES)
