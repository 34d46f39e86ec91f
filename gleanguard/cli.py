"""The command line: scans a path, prints a report, and ends with 1 where findings reach a severity."""

from __future__ import annotations

import argparse
import os
import sys
import tempfile
from dataclasses import fields

from pyspark.sql import DataFrame, SparkSession

from gleanguard.plans import scan as S
from gleanguard.sinks import hooks, reports, rows
from gleanguard.streaming import watch


def parser() -> argparse.ArgumentParser:
    p = argparse.ArgumentParser("gleanguard", description="Scans files for credentials and sensitive data, applies a policy and reports risk.")
    p.add_argument("path", help="a folder, a file or a URI; or install-hooks, uninstall-hooks")
    p.add_argument("-r", "--rules", dest="rules_dir", default="", help="folder of rule files in place of the shipped rules")
    p.add_argument("--policy", dest="policy_file", default="")
    p.add_argument("--policy-dir", default="", help="folder whose default.yml is the policy where none is given")
    p.add_argument("-p", "--profile", default="")
    p.add_argument("--profiles", dest="profiles_dir", default="")
    for kind in ("json", "sarif", "dashboard", "annotations"):
        p.add_argument(f"--{kind}", action="store_const", const=kind, dest="output")
    p.add_argument("-v", "--verbose", action="store_true")
    p.add_argument("--fail-on", default="low")
    p.add_argument("--min-confidence", type=float, default=0.0)
    p.add_argument("--min-severity", default="")
    p.add_argument("-t", "--tag", dest="tags", action="append", default=[])
    p.add_argument("-d", "--diff", action="store_true", help="only files that differ from --diff-base")
    p.add_argument("--diff-base", default="main")
    p.add_argument("-s", "--staged", action="store_true", help="only files staged for a commit")
    p.add_argument("-b", "--baseline", default="")
    p.add_argument("--update-baseline", action="store_true")
    p.add_argument("--config", default="", help="settings file; else the nearest one above the path")
    p.add_argument("--suppress", dest="suppressions", default="")
    p.add_argument("--include-tests", action="store_true", help="test files too, which are left out by default")
    p.add_argument("--watch", action="store_true", help="scan again when files change")
    p.add_argument("--watch-interval", type=float, default=2.0, help="seconds")
    p.add_argument("-w", "--workers", type=int, default=0, help="cores of a local session")
    p.add_argument("--max-files", type=int, default=0)
    p.add_argument("--max-file-size-mb", type=int, default=0)
    return p


def settings(args: argparse.Namespace) -> S.ScanConfig:
    """The scan's settings: what is given, then a settings file, then defaults."""
    known = {f.name for f in fields(S.ScanConfig)}
    given = {k: tuple(v) if isinstance(v, list) else v for k, v in vars(args).items() if k in known}
    # the command line's own default, which a settings file may replace
    config = S.configured(args.path, S.ScanConfig(**{**given, "fail_on": S.ScanConfig.fail_on if args.fail_on == "low" else args.fail_on}), args.config)
    return config if args.fail_on != "low" or config.fail_on != S.ScanConfig.fail_on else S.replace(config, fail_on="low")


def report(findings: DataFrame, config: S.ScanConfig, output: str | None) -> str:
    if output == "json":
        return reports.as_json(findings, config.boundaries)
    if output == "sarif":
        return reports.sarif(findings)
    if output == "dashboard":
        return reports.dashboard(findings, verbose=config.verbose)
    if output == "annotations":
        lines = rows.annotation_lines(rows.annotations(findings, config.min_severity or "info"))
        return "".join(f"{r[0]}\n" for r in lines.toLocalIterator())
    return reports.text(findings, config.verbose)


def _session(workers: int) -> SparkSession:
    builder = SparkSession.builder.appName("gleanguard")
    if SparkSession.getActiveSession() is None and "SPARK_MASTER" not in os.environ and "MASTER" not in os.environ:
        builder = builder.config("spark.ui.enabled", "false").config("spark.ui.showConsoleProgress", "false")
        builder = builder.master(f"local[{workers or '*'}]")
    return builder.getOrCreate()


def scan_and_report(spark: SparkSession, args: argparse.Namespace, config: S.ScanConfig) -> int:
    docs = S.read_source(spark, args.path, config, config.diff_base if args.diff else None, args.staged)
    if args.update_baseline and config.baseline:
        S.update_baseline(docs, config)
    findings = S.scan(docs, config).persist()  # the report and the exit code read them
    try:
        print(report(findings, config, args.output), end="")
        return S.exit_code(findings, config)
    finally:
        findings.unpersist()


def main(argv: list[str] | None = None) -> int:
    args = parser().parse_args(argv)
    if args.path in ("install-hooks", "uninstall-hooks"):
        print((hooks.install if args.path == "install-hooks" else hooks.uninstall)(os.getcwd()))
        return 0
    if "://" not in args.path:
        args.path = os.path.abspath(args.path)
        if not os.path.exists(args.path):
            print(f"no such path: {args.path}", file=sys.stderr)
            return 1
    config, spark = settings(args), _session(args.workers)
    if not args.watch:
        return scan_and_report(spark, args, config)
    stream = watch.watch_folder(spark, args.path, config.walk(), known=True)
    show = lambda found, _: print(report(found, config, args.output), end="") if not found.isEmpty() else None
    with tempfile.TemporaryDirectory() as checkpoint:
        watch.scan_stream(stream, f"file://{checkpoint}", show, config, args.watch_interval).awaitTermination()
    return 0
