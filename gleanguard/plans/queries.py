"""One query for each operator of the scanner, and DuckDB SQL for the same rows."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from gleanguard.functions import classify
from gleanguard.operators import encoded, entropy, filters, patterns, report, suppress
from gleanguard.operators.schema import documents
from gleanguard.plans import oracle as O
from gleanguard.plans import policy
from gleanguard.plans import rules as R
from gleanguard.plans.generated import generated, generated_sql, spread
from gleanguard.sinks import rows
from gleanguard.sources import files
from gleanguard.sources.globs import ignore_rules, ignored
from gleanguard.sources.tables import from_table

Query = Callable[[SparkSession, str], DataFrame]
QUERIES: dict[str, Query] = {}
SQL: dict[str, str] = {}
_PLACED = ("file", "rule_id", "pattern_ord", "match_ord", "severity", "confidence", "line", "column", "value")
_PLACED_SQL = 'file, rule_id, pattern_ord, match_ord, severity, confidence, line, "column", value'
EVERY = (*R.shipped(), *R.database(), *R.oauth())


def query(sql: str | None = None) -> Callable[[Query], Query]:
    def add(f: Query) -> Query:
        QUERIES[f.__name__] = f
        if sql:
            SQL[f.__name__] = sql
        return f

    return add


def _all_patterns(docs: DataFrame) -> DataFrame:
    return patterns.detect(documents(docs), EVERY)


def _numbers(df: DataFrame) -> DataFrame:
    return df.select(*(F.col(c).cast("long").alias(c) if t == "int" else F.col(c) for c, t in df.dtypes))


def _docs(spark: SparkSession, sf_dir: str) -> DataFrame:
    return from_table(spread(spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text")), "text", "doc_id", prefix="documents")


_DOCS_SQL = "docs AS (SELECT 'documents/' || doc_id AS path, text AS content FROM documents), "
_GENERATED_SQL = f"docs AS ({generated_sql()}), "


def _findings_sql(docs: str, select: str, rules=EVERY) -> str:
    return f"WITH {O.findings_ctes(docs, rules)} {select}"


@query(_findings_sql(_DOCS_SQL, f"SELECT {_PLACED_SQL} FROM findings"))
def scan_documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _numbers(_all_patterns(_docs(spark, sf_dir)).select(*_PLACED))


@query(_findings_sql("docs AS (SELECT 'pages/' || page_id AS path, html AS content FROM pages), ", f"SELECT {_PLACED_SQL} FROM findings"))
def scan_pages(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _numbers(_all_patterns(from_table(spread(spark.read.parquet(f"{sf_dir}/pages.parquet")), "html", "page_id", prefix="pages")).select(*_PLACED))


# turns hold no secrets, so every seventh gets one
@query(_findings_sql("docs AS (SELECT 'conversations/' || conv_id || '/' || turn AS path, text || CASE WHEN (conv_id + turn) % 7 = 0 THEN chr(10) || 'api_key = ' || chr(39) || md5(text) || chr(39) || chr(10) || 'AKIA' || substr(upper(md5(text)), 1, 16) ELSE '' END AS content FROM conversations), ", f"SELECT {_PLACED_SQL} FROM findings"))
def scan_conversations(spark: SparkSession, sf_dir: str) -> DataFrame:
    turns, md5 = spread(spark.read.parquet(f"{sf_dir}/conversations.parquet")), F.md5("text")
    secret = F.concat(F.lit("\napi_key = '"), md5, F.lit("'\nAKIA"), F.substring(F.upper(md5), 1, 16))
    told = turns.withColumn("text", F.concat("text", F.when((F.col("conv_id") + F.col("turn")) % 7 == 0, secret).otherwise(F.lit(""))))
    return _numbers(_all_patterns(from_table(told, "text", "conv_id", "turn", prefix="conversations")).select(*_PLACED))


def _group(name: str, rules: tuple[R.Rule, ...]) -> None:
    def f(spark: SparkSession, sf_dir: str) -> DataFrame:
        return _numbers(patterns.detect(documents(generated(spark, sf_dir)), rules).select(*_PLACED))

    f.__name__ = name
    query(_findings_sql(_GENERATED_SQL, f"SELECT {_PLACED_SQL} FROM findings", rules))(f)


def _by_tag(*tags: str) -> tuple[R.Rule, ...]:
    return tuple(r for r in R.shipped() if r.tags[0] in tags)


_group("scan_rules_cloud", _by_tag("aws", "azure", "gcp", "google", "cloud"))
_group("scan_rules_database", _by_tag("database"))
_group("scan_rules_env", _by_tag("env"))
_group("scan_rules_generic", _by_tag("credentials"))
_group("scan_rules_other", tuple(r for r in R.shipped() if r.tags[0] not in ("aws", "azure", "gcp", "google", "cloud", "database", "env", "credentials")))
_group("scan_connection_strings", R.database())
_group("scan_tokens", R.oauth())


def _found(spark: SparkSession, sf_dir: str) -> DataFrame:
    return patterns.detect(documents(generated(spark, sf_dir)), R.shipped())


def _decided(spark: SparkSession, sf_dir: str, profile: str = "default") -> DataFrame:
    return policy.apply(_found(spark, sf_dir), policy.resolved(profile))


def _decided_sql(select: str, profile: str = "default", also: str = "") -> str:
    return f"WITH {O.findings_ctes(_GENERATED_SQL, R.shipped())}, {O.decided_cte(policy.resolved(profile))}{', ' + also if also else ''} {select}"


@query(_findings_sql(_GENERATED_SQL, "SELECT file, rule_id, line, value FROM findings WHERE confidence >= 0.8 AND severity >= 4 AND list_has_any(tags, ['cloud', 'jwt'])", R.shipped()))
def filter_findings(spark: SparkSession, sf_dir: str) -> DataFrame:
    limits = R.Limits(0.8, "high", ("cloud", "jwt"))
    found = patterns.detect(documents(generated(spark, sf_dir)), R.shipped(), limits)
    return _numbers(filters.by_tags(filters.by_severity(filters.by_confidence(found, 0.8), "high"), ("cloud", "jwt")).select("file", "rule_id", "line", "value"))


for _name in policy.PROFILES:

    def _policy(spark: SparkSession, sf_dir: str, _profile: str = _name) -> DataFrame:
        return _numbers(_decided(spark, sf_dir, _profile).select("file", "rule_id", "line", "column", "action", "reason", "value"))

    _policy.__name__ = f"policy_{_name.replace('-', '_')}"
    query(_decided_sql('SELECT file, rule_id, line, "column", action, reason, value FROM decided', _name))(_policy)


@query(f"WITH {_GENERATED_SQL[:-2]}, {O.entropy_sql()} SELECT path, line, word, keyword, entropy FROM scored")
def entropy_words(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _numbers(entropy.words(documents(generated(spark, sf_dir))).select("path", "line", "word", "keyword", F.round("entropy", 6).alias("entropy")))


@query(
    f"WITH {_GENERATED_SQL[:-2]}, {O.entropy_sql()} SELECT path AS file, line, strlen(substr(trimmed, 1, strpos(trimmed, word) - 1)) + 1 AS \"column\", word AS value, "
    f"round({O.confidence_sql()}, 6) AS confidence FROM scored WHERE entropy >= 4 AND {O.confidence_sql()} >= 0.15"
)
def entropy_findings(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = entropy.detect(documents(generated(spark, sf_dir)))
    return _numbers(found.select("file", "line", "column", "value", F.round("confidence", 6).alias("confidence")))


_BASE64_SQL = f"{_GENERATED_SQL[:-2]}, {O.base64_sql()}"


@query(f"WITH {_BASE64_SQL} SELECT path, run, decode(raw) AS decoded FROM decoded WHERE octet_length(raw) >= 8 AND try(decode(raw)) IS NOT NULL AND list_aggregate(list_transform(range(0, octet_length(raw)), lambda i: hex(raw)[2 * i + 1:2 * i + 2]), 'entropy') >= 3.5")
def base64_candidates(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = encoded.candidates(documents(generated(spark, sf_dir)))
    return found.where(F.is_valid_utf8(F.col("raw").cast("string"))).select("path", "run", F.col("raw").cast("string").alias("decoded"))


@query(
    f"WITH {O.findings_ctes(_GENERATED_SQL, R.shipped())}, {O.directives_sql()} SELECT {_PLACED_SQL} FROM findings f WHERE NOT EXISTS (SELECT 1 FROM directives d WHERE d.path = f.file "
    "AND f.line BETWEEN d.at_line AND d.at_line + 3 AND f.line <= d.last AND (d.rules IS NULL OR list_contains(d.rules, f.rule_id)))"
)
def inline_directives(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _numbers(suppress.without_inline(_found(spark, sf_dir), documents(generated(spark, sf_dir))).select(*_PLACED))


def _baseline(found: DataFrame) -> DataFrame:
    """Findings on first lines are known."""
    return suppress.updated_baseline(found.sparkSession.createDataFrame([("0" * 64, "old.env:7")], "hash string, location string"), found.where("line = 1"))


_BASE_SQL = f"hashed AS (SELECT *, sha256({O.json_sql()}) AS hash, file || ':' || line AS location FROM decided), base AS (SELECT hash, min(location) AS location FROM hashed WHERE line = 1 GROUP BY hash UNION ALL SELECT repeat('0', 64), 'old.env:7')"


@query(_decided_sql(f"SELECT file, rule_id, line, value, hash FROM hashed WHERE hash NOT IN (SELECT hash FROM base)", also=_BASE_SQL))
def baseline_new(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = _decided(spark, sf_dir)
    return _numbers(suppress.new_findings(found, _baseline(found)).select("file", "rule_id", "line", "value", suppress.finding_hash().alias("hash")))


@query(_decided_sql(f"SELECT hash, location FROM base", also=_BASE_SQL))
def baseline_update(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _baseline(_decided(spark, sf_dir))


@query(_decided_sql(f"SELECT count(*) AS total, string_agg(DISTINCT split_part(location, ':', 1), ',' ORDER BY split_part(location, ':', 1)) AS files FROM base", also=_BASE_SQL))
def baseline_stats(spark: SparkSession, sf_dir: str) -> DataFrame:
    return suppress.baseline_stats(_baseline(_decided(spark, sf_dir))).select("total", F.array_join("files", ",").alias("files"))


_ENTRIES = (suppress.Suppression(id="src/12.lock"), suppress.Suppression(rule_id="env-token"), suppress.Suppression(file="src/5.lock"), suppress.Suppression(pattern=r"^sk_live_[0-4]"), suppress.Suppression(pattern=r"/7\d*\.py$"), suppress.Suppression(pattern="(("))


@query(_decided_sql("SELECT file, rule_id, line, value FROM decided WHERE NOT (file IN ('src/12.lock', 'src/5.lock') OR rule_id = 'env-token' OR regexp_matches(value, '^sk_live_[0-4]') OR regexp_matches(file, '^sk_live_[0-4]') OR regexp_matches(value, '/7\\d*\\.py$') OR regexp_matches(file, '/7\\d*\\.py$'))"))
def suppression_list(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _numbers(suppress.without_suppressed(_decided(spark, sf_dir), _ENTRIES).select("file", "rule_id", "line", "value"))


@query(_decided_sql("""SELECT count(*) AS findings, count(DISTINCT type) AS types, CASE WHEN max(severity) = 5 AND bool_or(list_contains(tags, 'private-key')) THEN 100 WHEN max(severity) >= 4 THEN 75
WHEN max(severity) = 3 THEN 50 WHEN max(severity) = 2 THEN 25 ELSE 0 END AS risk_score, string_agg(DISTINCT reason, '|' ORDER BY reason) AS reasons,
string_agg(DISTINCT CASE WHEN severity = 5 THEN type END, '|' ORDER BY CASE WHEN severity = 5 THEN type END) AS critical_types FROM decided"""))
def risk_report(spark: SparkSession, sf_dir: str) -> DataFrame:
    one = report.risk(_decided(spark, sf_dir))
    return _numbers(one.select("findings", "types", "risk_score", F.array_join("reasons", "|").alias("reasons"), F.array_join("critical_types", "|").alias("critical_types")))


_SCORE = "CASE WHEN max(severity) = 5 AND bool_or(list_contains(tags, 'private-key')) THEN 100 WHEN max(severity) >= 4 THEN 75 WHEN max(severity) = 3 THEN 50 WHEN max(severity) = 2 THEN 25 ELSE 0 END"


@query(_decided_sql(f"SELECT b.boundary, s.score <= b.most AS safe FROM (SELECT {_SCORE} AS score FROM decided) s, (VALUES ('public_github', 25), ('ai_context', 25), ('ci_pipeline', 25), ('email', 50)) b(boundary, most)"))
def safe_to_share(spark: SparkSession, sf_dir: str) -> DataFrame:
    return report.risk(_decided(spark, sf_dir)).select(F.explode("safe_to_share").alias("boundary", "safe"))


_FIRST = "ORDER BY file, detector_ord, rule_ord, pattern_ord, match_ord"
_STATS_SQL = f"SELECT rule_id, first(type {_FIRST}) AS rule_name, first(severity {_FIRST}) AS severity, count(*) AS hits, round(avg(confidence), 6) AS avg_confidence, count(DISTINCT file) AS files FROM decided GROUP BY rule_id"


@query(_decided_sql(_STATS_SQL))
def rule_stats(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _numbers(report.rule_stats(_decided(spark, sf_dir)).withColumn("avg_confidence", F.round("avg_confidence", 6)))


@query(_decided_sql(f"SELECT * FROM ({_STATS_SQL}) ORDER BY hits DESC, rule_id LIMIT 20"))
def top_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _numbers(report.top_rules(_decided(spark, sf_dir)).withColumn("avg_confidence", F.round("avg_confidence", 6)))


@query(_decided_sql(f"SELECT {O.SEVERITY_NAMES}[severity] AS severity, count(*) AS findings FROM decided GROUP BY severity"))
def severity_histogram(spark: SparkSession, sf_dir: str) -> DataFrame:
    from gleanguard.plans.levels import severity_name

    return report.severity_histogram(_decided(spark, sf_dir)).select(severity_name(F.col("severity")).alias("severity"), "findings")


_LEVEL = "CASE WHEN severity >= 4 THEN 'error' WHEN severity = 3 THEN 'warning' ELSE 'note' END"
_RULES_SQL = f"catalogue AS (SELECT rule_id, name, description, level, row_number() OVER (ORDER BY f) - 1 AS rule_index FROM (SELECT rule_id, first(type {_FIRST}) AS name, first(reason {_FIRST}) AS description, first({_LEVEL} {_FIRST}) AS level, min((file, detector_ord, rule_ord, pattern_ord, match_ord)) AS f FROM decided GROUP BY rule_id))"


@query(_decided_sql(f"SELECT * FROM catalogue", also=_RULES_SQL))
def sarif_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _numbers(rows.sarif_rules(_decided(spark, sf_dir)))


_PERCENT = "CAST(round_even(confidence * 100, 0) AS INTEGER)"


@query(_decided_sql(f"SELECT d.rule_id, {_LEVEL} AS level, type || ': ' || reason || ' (confidence: ' || {_PERCENT} || '%)' AS message, file AS uri, line AS start_line, \"column\" AS start_column, rule_index FROM decided d JOIN catalogue c USING (rule_id)", also=_RULES_SQL))
def sarif_results(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _numbers(rows.sarif_results(_decided(spark, sf_dir)).drop("detector_ord", "rule_ord", "pattern_ord", "match_ord"))


_ANNOTATION = f"'::' || CASE WHEN severity >= 4 THEN 'error' ELSE 'warning' END || ' file=' || file || ',line=' || line || '::[' || rule_id || '] ' || reason || ' (confidence: ' || {_PERCENT} || '%)'"


@query(_decided_sql(f"SELECT {_ANNOTATION} AS value FROM decided WHERE severity >= 3"))
def annotations(spark: SparkSession, sf_dir: str) -> DataFrame:
    return rows.annotation_lines(rows.annotations(_decided(spark, sf_dir), "medium"))


@query(_decided_sql("SELECT count(*) AS total, CAST(sum(CASE WHEN severity >= 4 THEN 1 ELSE 0 END) AS BIGINT) AS errors, CAST(sum(CASE WHEN severity < 4 THEN 1 ELSE 0 END) AS BIGINT) AS warnings FROM decided WHERE severity >= 3"))
def annotation_summary(spark: SparkSession, sf_dir: str) -> DataFrame:
    return rows.annotation_summary(rows.annotations(_decided(spark, sf_dir), "medium"))


@query(_decided_sql("SELECT bool_or(severity >= 4 AND action <> 'allow') AS fails FROM decided"))
def fail_on(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _decided(spark, sf_dir).agg(filters.fails("high").alias("fails"))


_PATHS = ("src/main.go", "src/build/file.o", "vendor/pkg", "vendor/pkg/file.go", "a/b/c.log", "important.log", "x/important.log", "docs/a/b/readme.md", "docs/readme.md", "node_modules/x/y.js", "lib/app.min.js", "a_test.go", "web/ui.spec.ts", "web/ui.test.js", "web/ui.ts", "yarn.lock", "go.sum", "tmp/x.txt", "img/logo.png", "deep/build/out.txt", "src", "file")
_IGNORE = ("# comment", "*.log", "!important.log", "build/", "vendor/*", "docs/**/*.md", "src/**")
_IGNORE_SQL = r"""CASE WHEN regexp_matches(path, '^docs/(.*/)?[^/]*\.md$') OR regexp_matches(path, '^vendor/[^/]*$') OR regexp_matches(path, '(^|/)build(/|$)') OR regexp_matches(path, '^src/[^/]*$') THEN TRUE
WHEN regexp_matches(path, '(^|/)important\.log$') THEN FALSE WHEN regexp_matches(path, '\.log$') THEN TRUE ELSE FALSE END"""


def _listing(spark: SparkSession) -> DataFrame:
    return spark.createDataFrame([(p, 10 * k) for k, p in enumerate(_PATHS)], "path string, length long")


_LISTING_SQL = "(VALUES " + ", ".join(f"('{p}', {10 * k}::BIGINT)" for k, p in enumerate(_PATHS)) + ") t(path, length)"


@query(f"SELECT path, {_IGNORE_SQL} AS ignored FROM {_LISTING_SQL}")
def ignore_globs(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _listing(spark).select("path", ignored(F.col("path"), ignore_rules(_IGNORE)).alias("ignored"))


_SKIPPED_EXT = " OR ".join(f"ends_with(path, '{e}')" for e in files.SKIP_EXTENSIONS)
_SKIPPED_DIR = f"list_has_any(string_split(path, '/')[1:-2], {O.listed(files.SKIP_DIRS)})"


@query(f"SELECT path, ({_SKIPPED_EXT}) AS skipped_extension, {_SKIPPED_DIR} AS skipped_dir, regexp_matches(regexp_replace(split_part(path, '/', -1), '\\.[^.]*$', ''), '(_test|\\.test|\\.spec)$') AS test FROM {_LISTING_SQL}")
def walk_filters(spark: SparkSession, sf_dir: str) -> DataFrame:
    path = F.col("path")
    return _listing(spark).select("path", files.skipped_extension(path).alias("skipped_extension"), files.in_skipped_dir(path).alias("skipped_dir"), files.is_test_file(path).alias("test"))


@query(f"SELECT path, length FROM {_LISTING_SQL} WHERE length <= 150 AND NOT ({_SKIPPED_EXT}) AND NOT {_SKIPPED_DIR} ORDER BY string_split(path, '/') LIMIT 6")
def walk_max_files(spark: SparkSession, sf_dir: str) -> DataFrame:
    return files.walked(_listing(spark), files.Walk(max_file_size=150, max_files=6))


_BYTES = ("", "48656C6C6F", "7F454C46", "4D5A90", "255044462D", "89504E470D", "504B030414", "1F8B08", "425A68", "FD377A585A00", "FEEDFACE", "CFFAEDFE01", "EFBBBF41", "FFFE4100", "FEFF0041", "00", "01" * 100 + "41" * 900, "01" * 101 + "41" * 899, "C3A4", "C328", "E282AC", "E28228", "F09F9880", "FF", "0A0D0920")
_MAGIC_SQL = " OR ".join(f"starts_with(h, '{m}')" for m in classify.MAGICS)
_CONTROLS = "len(list_filter(range(1, length(h), 2), lambda i: substr(h, i, 2) < '20' AND substr(h, i, 2) NOT IN ('09', '0A', '0D')))"


@query(
    f"SELECT h, h <> '' AND ({_MAGIC_SQL} OR len(list_filter(range(1, length(h), 2), lambda i: substr(h, i, 2) = '00')) > 0 OR {_CONTROLS} * 2.0 / length(h) > 0.1) AS is_binary, "
    "CASE WHEN starts_with(h, 'EFBBBF') THEN 'utf-8' WHEN starts_with(h, 'FFFE') THEN 'utf-16-le' WHEN starts_with(h, 'FEFF') THEN 'utf-16-be' ELSE '' END AS bom, "
    "regexp_matches(h, '^([0-7].|[CD].[89AB].|E.([89AB].){2}|F[0-7]([89AB].){3})*$') AS utf8 FROM (VALUES " + ", ".join(f"('{h}')" for h in _BYTES) + ") t(h)"
)
def binary_classify(spark: SparkSession, sf_dir: str) -> DataFrame:
    raw = spark.createDataFrame([(h,) for h in _BYTES], "h string").withColumn("raw", F.unhex("h"))
    c = F.col("raw")
    return raw.select("h", classify.is_binary(c).alias("is_binary"), classify.byte_order_mark(c).alias("bom"), classify.looks_utf8(c).alias("utf8"))
