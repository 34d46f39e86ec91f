"""Queries for whole scans, contexts, listings' findings, reports and stored settings, with DuckDB SQL for the same rows."""

from __future__ import annotations

import os
import tempfile

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from gleanguard.functions import classify, re2, text
from gleanguard.operators import detectors, encoded, report, suppress
from gleanguard.operators.schema import documents
from gleanguard.plans import oracle as O
from gleanguard.plans import policy
from gleanguard.plans import queries as Q
from gleanguard.plans import rules as R
from gleanguard.plans.generated import generated, generated_sql, spread
from gleanguard.plans.scan import ScanConfig, scan
from gleanguard.sinks import rows
from gleanguard.sources import files, stored
from gleanguard.streaming.watch import changed

_SCAN_COLUMNS = ("type", "severity", "confidence", "file", "line", "column", "value", "reason", "rule_id", "action")
_ENTROPY_FOUND = (
    f"entropy_findings AS (SELECT path AS file, 'entropy-high' AS rule_id, 'High Entropy String' AS type, 'High-entropy string detected (potential secret)' AS reason, "
    f"['entropy', 'potential-secret'] AS tags, 2 AS severity, {O.confidence_sql()} AS confidence, line, strlen(substr(trimmed, 1, strpos(trimmed, word) - 1)) + 1 AS \"column\", word AS value "
    f"FROM scored WHERE entropy >= 4 AND {O.confidence_sql()} >= 0.15)"
)
_SAME = 'file, rule_id, type, reason, tags, severity, confidence, line, "column", value'
_UNDER = (
    "NOT EXISTS (SELECT 1 FROM directives d WHERE d.path = f.file AND f.line BETWEEN d.at_line AND d.at_line + 3 AND f.line <= d.last "
    "AND (d.rules IS NULL OR list_contains(d.rules, f.rule_id)))"
)


# detectors, filters, directives, policy and suppressions of a whole scan, one pass over the documents
@Q.query(
    f"WITH {O.findings_ctes(f'docs AS ({generated_sql()}), ', Q.EVERY)}, {O.entropy_sql().strip()}, {_ENTROPY_FOUND}, {O.directives_sql().strip()}, "
    f"every AS (SELECT {_SAME} FROM findings UNION ALL SELECT {_SAME} FROM entropy_findings), "
    f"open AS (SELECT * FROM every f WHERE confidence >= 0.3 AND {_UNDER}), {O.decided_cte(policy.resolved('enterprise'), 'open')} "
    "SELECT type, severity, round(confidence, 6) AS confidence, file, line, \"column\", value, reason, rule_id, action FROM decided WHERE rule_id <> 'env-token'"
)
def scan_full(spark: SparkSession, sf_dir: str) -> DataFrame:
    with tempfile.TemporaryDirectory() as folder:  # read while the scan is planned
        path = os.path.join(folder, "suppressions.json")
        stored.write_suppressions([suppress.Suppression(rule_id="env-token")], path)
        config = ScanConfig(detectors=("regex", "filetype", "symlink", "entropy", "database", "oauth"), profile="enterprise", min_confidence=0.3, suppressions=path)
        found = scan(generated(spark, sf_dir), config)
    return Q._numbers(found.select(*_SCAN_COLUMNS).withColumn("confidence", F.round("confidence", 6)))


_AROUND = "list_transform(range(greatest(line - 2, 1), least(line + 2, len(ls)) + 1), lambda i: (CASE WHEN i = line THEN '> ' ELSE '  ' END) || trim(ls[i], chr(9) || chr(10) || chr(11) || chr(12) || chr(13) || ' ') || chr(10))"


@Q.query(
    f"WITH {O.findings_ctes(Q._GENERATED_SQL, R.shipped())} SELECT file, rule_id, pattern_ord, match_ord, array_to_string({_AROUND}, '') AS context, "
    "trim(ls[line], chr(9) || chr(10) || chr(11) || chr(12) || chr(13) || ' ') AS source_line FROM findings JOIN (SELECT path, string_split(content, chr(10)) AS ls FROM docs) ON path = file"
)
def finding_context(spark: SparkSession, sf_dir: str) -> DataFrame:
    return Q._numbers(Q._found(spark, sf_dir).select("file", "rule_id", "pattern_ord", "match_ord", "context", "source_line"))


@Q.query(f"SELECT path, k AS line, trim(ls[k], chr(9) || chr(10) || ' ') AS trimmed FROM (SELECT path, ls, unnest(range(1, len(ls) + 1)) AS k FROM (SELECT path, string_split(content, chr(10)) AS ls FROM ({generated_sql()})))")
def trimmed_lines(spark: SparkSession, sf_dir: str) -> DataFrame:
    by_line = generated(spark, sf_dir).select("path", F.posexplode(text.lines(F.col("content"))).alias("k", "raw"))
    return by_line.select("path", (F.col("k") + 1).cast("long").alias("line"), text.trimmed(F.col("raw")).alias("trimmed"))


_RUNS = f"{generated_sql()}), {O.base64_sql()}"
_DECODED = (
    f"generated AS ({_RUNS.replace(' FROM docs)', ' FROM generated)')}, docs AS (SELECT path || ' (base64 decoded)' AS path, try(decode(raw)) AS content FROM decoded WHERE octet_length(raw) >= 8 AND length(run) >= 16 "
    "AND list_aggregate(list_transform(range(0, octet_length(raw)), lambda i: hex(raw)[2 * i + 1:2 * i + 2]), 'entropy') >= 3.5 AND try(decode(raw)) IS NOT NULL), "
)


@Q.query(f"WITH {O.findings_ctes(_DECODED, R.shipped())} SELECT file, 'base64_' || type AS type, rule_id, line, \"column\", value, '{encoded.REASON}' || reason AS reason FROM findings")
def base64_findings(spark: SparkSession, sf_dir: str) -> DataFrame:
    return Q._numbers(encoded.detect(documents(generated(spark, sf_dir)), R.shipped()).select("file", "type", "rule_id", "line", "column", "value", "reason"))


_PART_DOCS = "SELECT 'part/' || p_partkey AS path, p_partkey % 7 = 0 AS is_binary, CAST(p_partkey * 13 % 512 AS INTEGER) AS mode, p_partkey % 11 = 0 AS is_symlink, '/t/' || p_partkey AS symlink_target FROM part"


def _part_docs(spark: SparkSession, sf_dir: str) -> DataFrame:
    key = F.col("p_partkey")
    return spark.read.parquet(f"{sf_dir}/part.parquet").select(
        F.concat(F.lit("part/"), key).alias("path"), F.lit("x").alias("content"), (key % 7 == 0).alias("is_binary"), (key * 13 % 512).cast("int").alias("mode"),
        (key % 11 == 0).alias("is_symlink"), F.concat(F.lit("/t/"), key).alias("symlink_target"),
    )


@Q.query(
    f"WITH d AS ({_PART_DOCS}) SELECT path AS file, 'binary-file-detected' AS rule_id, 'filetype,binary' AS tags, NULL AS value FROM d WHERE is_binary "
    "UNION ALL SELECT path, 'executable-file-detected', 'filetype,executable', NULL FROM d WHERE mode & 73 <> 0 UNION ALL SELECT path, 'symlink-detected', 'symlink,filesystem', symlink_target FROM d WHERE is_symlink"
)
def file_findings(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = detectors.run(documents(_part_docs(spark, sf_dir)), [], ("filetype", "symlink"))
    return found.select("file", "rule_id", F.array_join("tags", ",").alias("tags"), "value")


@Q.query(f"WITH d AS ({_PART_DOCS}) SELECT path, mode & 73 <> 0 AS executable FROM d")
def executable_files(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _part_docs(spark, sf_dir).select("path", classify.is_executable(F.col("mode")).alias("executable"))


_ENDS = (".py", ".GO", "Makefile", ".png", ".sqlite3", ".zzz", "", ".lock", ".md", ".tar", ".sum", "py", "exe")


def _among_sql(known: list[str]) -> str:
    return f"list_contains({O.listed(known)}, e) OR list_contains({O.listed(known)}, regexp_replace(e, '^\\.', ''))"


@Q.query(f"SELECT e, ({_among_sql(classify.TEXT_EXTENSIONS)}) AS is_text, ({_among_sql(classify.BINARY_EXTENSIONS)}) AS is_binary FROM (VALUES {', '.join(f'({O.quoted(e)})' for e in _ENDS)}) t(e)")
def extension_kinds(spark: SparkSession, sf_dir: str) -> DataFrame:
    e = F.col("e")
    return spark.createDataFrame([(x,) for x in _ENDS], "e string").select("e", classify.is_text_extension(e).alias("is_text"), classify.is_binary_extension(e).alias("is_binary"))


@Q.query("SELECT doc_id, strpos(hex(encode(text)), '00') > 0 AND regexp_matches(hex(encode(text)), '^(..)*00') AS has_nul FROM documents")
def nul_bytes(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", classify.has_nul(F.encode("text", "UTF-8")).alias("has_nul"))


_LABEL = "CASE WHEN score >= 100 THEN 'critical' WHEN score >= 75 THEN 'high' WHEN score >= 50 THEN 'medium' WHEN score >= 25 THEN 'low' ELSE 'none' END"
_ADVICE_SQL = "CASE " + " ".join(f"WHEN score >= {at} THEN {O.quoted(said)}" for at, said in report.ADVICE) + " END"


# of each file by itself, so that many scores and numbers occur
@Q.query(Q._decided_sql(
    f"SELECT n, label_of, summary FROM (SELECT n, {_LABEL} AS label_of, 'Risk Score: ' || {_LABEL} || ' (' || score || ')' || chr(10) || chr(10) || 'Found ' || n || ' finding' || CASE WHEN n = 1 THEN '' ELSE 's' END || ' across ' || types || ' type' || CASE WHEN types = 1 THEN '' ELSE 's' END || '.' || chr(10) || chr(10) "
    f"|| CASE WHEN len(critical) > 0 THEN 'Critical items detected:' || chr(10) || array_to_string(list_transform(critical, lambda c: '  • ' || c || chr(10)), '') || chr(10) ELSE '' END || {_ADVICE_SQL} AS summary "
    f"FROM (SELECT count(*) AS n, count(DISTINCT type) AS types, {Q._SCORE} AS score, list_sort(coalesce(list(DISTINCT type) FILTER (severity = 5), [])) AS critical FROM decided WHERE file = 'src/1.py' "
    f"UNION ALL SELECT count(*), count(DISTINCT type), {Q._SCORE}, list_sort(coalesce(list(DISTINCT type) FILTER (severity = 5), [])) FROM decided))"
))
def risk_summary(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = Q._decided(spark, sf_dir)
    both = report.risk(found.where("file = 'src/1.py'")).unionByName(report.risk(found))
    return both.select(F.col("findings").alias("n"), F.col("label").alias("label_of"), "summary")


@Q.query(Q._decided_sql("SELECT file, count(*) AS findings, min(severity) AS least, max(severity) AS worst, count(DISTINCT rule_id) AS rules FROM decided GROUP BY file"))
def files_affected(spark: SparkSession, sf_dir: str) -> DataFrame:
    return Q._numbers(report.affected_files(Q._decided(spark, sf_dir)))


_JSON_FIELDS = "type, severity, confidence, file, line, \"column\", nullif(value, '') AS value, reason, rule_id, array_to_string(tags, ',') AS tags, action"


@Q.query(Q._decided_sql(f"SELECT {_JSON_FIELDS}, array_to_string({_AROUND}, '') AS context, nullif(trim(ls[line], chr(9) || chr(10) || ' '), '') AS source_line FROM decided JOIN (SELECT path, string_split(content, chr(10)) AS ls FROM docs) ON path = file"))
def json_findings(spark: SparkSession, sf_dir: str) -> DataFrame:
    return Q._numbers(rows.json_findings(Q._decided(spark, sf_dir)).withColumn("tags", F.array_join("tags", ",")))


_FIVE = "SELECT rule_id, file, row_number() OVER (PARTITION BY rule_id ORDER BY file) AS k FROM (SELECT DISTINCT rule_id, file FROM decided)"


@Q.query(Q._decided_sql(f"SELECT s.rule_id, s.hits, s.files, string_agg(f.file, ',' ORDER BY f.file) AS some_files FROM ({Q._STATS_SQL}) s JOIN ({_FIVE}) f ON f.rule_id = s.rule_id AND f.k <= 5 GROUP BY ALL"))
def rule_files(spark: SparkSession, sf_dir: str) -> DataFrame:
    return report.rule_files(Q._decided(spark, sf_dir)).select("rule_id", "hits", "files", F.array_join("some_files", ",").alias("some_files"))


@Q.query("""WITH known AS (SELECT 'o/' || o_orderkey AS path, epoch(o_orderdate) AS modified FROM orders WHERE o_orderkey % 3 <> 0),
listing AS (SELECT 'o/' || o_orderkey AS path, epoch(o_orderdate) + CASE WHEN o_orderkey % 5 = 0 THEN 60 ELSE 0 END AS modified FROM orders)
SELECT l.path FROM listing l LEFT JOIN known k USING (path) WHERE k.modified IS NULL OR l.modified > k.modified""")
def changed_files(spark: SparkSession, sf_dir: str) -> DataFrame:
    key, at = F.col("o_orderkey"), F.unix_timestamp(F.col("o_orderdate").cast("timestamp"))
    orders = spark.read.parquet(f"{sf_dir}/orders.parquet").select(key, F.concat(F.lit("o/"), key).alias("path"), at.alias("modified"))
    listing = orders.withColumn("modified", F.col("modified") + F.when(key % 5 == 0, 60).otherwise(0)).select("path", "modified")
    return changed(listing, orders.where(key % 3 != 0).select("path", "modified")).select("path")


def _yaml_rules(folder: str) -> list[R.Rule]:
    """The shipped rules, written as a rule file and read again."""
    import yaml

    spec = [{"id": r.id, "type": "regex", "name": r.name, "severity": r.severity, "tags": list(r.tags), "description": r.description, "file_filter": {"include": list(r.include), "exclude": list(r.exclude)},
             "patterns": [{"regex": p.regex, "confidence": p.confidence, "capture_group": p.group} for p in r.patterns]} for r in R.shipped()]
    with open(os.path.join(folder, "rules.yml"), "w", encoding="utf-8") as f:
        yaml.safe_dump({"rules": [*spec, {"id": "other", "type": "other"}]}, f)
    return R.from_directory(folder)


# a rule file's rules, a user's own in place of one of them, and a policy file
@Q.query(
    f"WITH {O.findings_ctes(Q._GENERATED_SQL, [r for r in R.shipped() if r.id != 'env-token'])}, {O.decided_cte(policy.PROFILES['default'].rules)} "
    'SELECT file, rule_id, line, "column", action, reason, value FROM decided UNION ALL SELECT path, \'env-token\', 1, 1, \'allow\', \'allow: own\', \'nothing\' FROM docs WHERE starts_with(content, \'nothing\')'
)
def scan_with_files(spark: SparkSession, sf_dir: str) -> DataFrame:
    import yaml

    with tempfile.TemporaryDirectory() as folder, tempfile.TemporaryDirectory() as own:  # read while the scan is planned
        _yaml_rules(folder)
        with open(os.path.join(own, "own.yaml"), "w", encoding="utf-8") as f:
            yaml.safe_dump({"rules": [{"id": "env-token", "type": "regex", "name": "Own", "severity": "info", "tags": ["own"], "description": "own", "patterns": [{"regex": "^nothing", "confidence": 1.0}]}]}, f)
        path = os.path.join(own, "policy")
        with open(path, "w", encoding="utf-8") as f:
            yaml.safe_dump({"policies": [{"tags": list(r.tags), "action": r.action, "min_severity": r.min_severity} for r in policy.PROFILES["default"].rules]}, f)
        found = scan(generated(spark, sf_dir), ScanConfig(detectors=("regex",), rules_dir=folder, user_rules_dir=own, policy_file=path, inline=False))
    return Q._numbers(found.select("file", "rule_id", "line", "column", "action", "reason", "value"))


_CASES = ("(a+)+$", "(a*)*a", "a++", "[a-z]+", "(a|b)*c", "x{2,5}", "(?:a+){2,}", "AKIA[0-9A-Z]{16}", "a**", "(ab)+")
#: Fixed: which of the cases are refused.
_REFUSED = ("(a+)+$", "(a*)*a", "a++", "(?:a+){2,}", "a**")


@Q.query(f"SELECT p, list_contains({O.listed(_REFUSED)}, p) AS dangerous FROM (VALUES {', '.join(f'({O.quoted(p)})' for p in _CASES)}) t(p)")
def dangerous_patterns(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spark.createDataFrame([(p, re2.is_dangerous(p)) for p in _CASES], "p string, dangerous boolean")


@Q.query("SELECT c_custkey, round(list_aggregate(string_split(c_name, ''), 'entropy'), 6) AS bits FROM customer")
def entropy_bits(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spread(spark.read.parquet(f"{sf_dir}/customer.parquet")).select("c_custkey", F.round(text.entropy(F.col("c_name")), 6).alias("bits"))


_NAMES = ("README.md", ".env", "a/b.min.js", "a.tar.gz", "x/.git", "noend", "a.", "dir.d/file")


@Q.query("SELECT p, regexp_extract(split_part(p, '/', -1), '(\\.[^.]*)$', 1) AS e, split_part(p, '/', -1) AS n FROM (VALUES " + ", ".join(f"({O.quoted(p)})" for p in _NAMES) + ") t(p)")
def path_parts(spark: SparkSession, sf_dir: str) -> DataFrame:
    p = F.col("p")
    return spark.createDataFrame([(x,) for x in _NAMES], "p string").select("p", files.extension(p).alias("e"), files.base_name(p).alias("n"))
