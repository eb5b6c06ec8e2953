"""The command line: ``python -m weftgraph scan|explain|diff``.

    scan FOLDER... [--glob=G] [--min-strength=N] [--type=T,T] [--min-degree=N] [--file=PART] [--top=N]
         [--format=summary|findings|architecture|json|html|sarif|agent] [--out=FILE] [--config=FILE]
         [--co-change=N|off] [--history=N] [--min-severity=low|medium|high]
    explain FOLDER... -- FILE:LINE
    diff [--repo=FOLDER] [--base=REF] [--head=REF] [--format=summary|json|sarif|agent] ...

Filters leave scores and gates alone. Exit code 0: nothing against it; 1: a bound of the configuration is exceeded,
or a difference adds a sure edge or a cycle; 2: wrong use.
"""

from __future__ import annotations

import argparse
import shutil
import sys
from pathlib import Path

from pyspark.sql import DataFrame, SparkSession

from weftgraph.functions import constants as K
from weftgraph.operators import cochange, findings, scoring
from weftgraph.plans.scan import Scan, compare, scan
from weftgraph.sources import config as C
from weftgraph.sources import history, sinks
from weftgraph.sources.ingest import PythonAdapter, read_files

FORMS = ("summary", "findings", "architecture", "json", "html", "sarif", "agent")


class _Parser(argparse.ArgumentParser):
    def error(self, message: str):
        raise ValueError(message)


def _whole(text: str) -> int:
    if not text.isdigit():
        raise argparse.ArgumentTypeError(f"expected a whole number, got {text!r}")
    return int(text)


def _types(text: str) -> list[str]:
    names = [t.strip() for t in text.split(",") if t.strip()]
    if bad := [t for t in names if t not in K.STRENGTH]:
        raise argparse.ArgumentTypeError(f"no such type: {', '.join(bad)} (one of {', '.join(K.STRENGTH)})")
    return names


def _parser() -> argparse.ArgumentParser:
    p = _Parser(prog="weftgraph", add_help=True)
    sub = p.add_subparsers(dest="command", required=True, parser_class=_Parser)
    for name in ("scan", "explain", "diff"):
        s = sub.add_parser(name)
        if name == "diff":
            s.add_argument("--repo", default=".")
            s.add_argument("--base")
            s.add_argument("--head", default="working")
        else:
            s.add_argument("folders", nargs="+")
        s.add_argument("--glob", action="append", default=[])
        s.add_argument("--min-strength", type=_whole, default=0)
        s.add_argument("--min-degree", type=_whole, default=0)
        s.add_argument("--type", type=_types, default=[])
        s.add_argument("--file")
        s.add_argument("--top", type=_whole, default=20)
        s.add_argument("--format", choices=FORMS if name == "scan" else ("summary", "json", "sarif", "agent"), default="summary")
        s.add_argument("--min-severity", choices=tuple(K.SEVERITY_RANK), default="medium")
        s.add_argument("--out")
        s.add_argument("--config")
        s.add_argument("--co-change", dest="co_change")
        s.add_argument("--history", type=_whole)
    return p


def scan_folders(spark: SparkSession, folders: list[str], globs: list[str], config: dict) -> Scan:
    root = folders[0] if len(folders) == 1 and Path(folders[0]).is_dir() else ""
    ir = PythonAdapter().to_ir(spark, read_files(spark, folders, globs or ["**/*.py"], root=str(Path(root).resolve()) if root else ""))
    return scan(ir.nodes, ir.refs, config)


def _filtered(edges: DataFrame, o) -> DataFrame:
    return scoring.filter_edges(edges, o.min_strength, o.type, o.min_degree, o.file)


def _pairs(spark: SparkSession, folder: str, o, config: dict) -> DataFrame | None:
    given = {"min_support": 0 if o.co_change == "off" else int(o.co_change) if o.co_change else None, "max_commits": o.history}
    options = C.cochange_options(config, given)
    if options is None:
        return None
    commits = history.read_commits(spark, folder, options["max_commits"])
    return cochange.cochange(commits, **options, globs=o.glob or ["**/*.py"], ignores=config.get("ignore", []))


def report(spark: SparkSession, s: Scan, o, pairs: DataFrame | None) -> str:
    edges = _filtered(s.edges, o)
    if o.format == "json":
        lines = sinks.scan_json(edges, s.summary(), s.pressure(), s.score(), s.cycles, None, pairs)
        return "\n".join(r["line"] for r in lines.toLocalIterator())
    if o.format == "sarif":
        return sinks.sarif(edges, cycles=s.cycles, cochange=pairs)
    if o.format == "html":
        return sinks.html_page("Coupling", edges, scoring.file_hotspots(edges), s.quality, o.top or 1 << 30)
    if o.format == "architecture":
        return "\n".join(sinks.architecture_lines(s.architecture(), o.top or 1 << 30))
    if o.format == "summary":
        lines = [sinks.summary_text(scoring.summary(edges)), *sinks.quality_lines(s.score(), s.quality), *sinks.pressure_lines(s.pressure()), *sinks.edge_lines(edges, o.top)]
    else:
        rows = findings.with_advice(findings.cluster_findings(edges, s.cycles))
        lines = sinks.finding_lines(rows, o.top, o.min_severity)
        lines = [f"- {x}" for x in lines] if o.format == "agent" else lines
    return "\n".join([*lines, *(sinks.cochange_lines(pairs, o.top) if pairs is not None else [])])


def run(argv: list[str], spark: SparkSession | None = None, out=sys.stdout, err=sys.stderr) -> int:
    at = None
    if argv[:1] == ["explain"] and "--" in argv:
        k = argv.index("--")
        argv, at = argv[:k], argv[k + 1] if k + 1 < len(argv) else None
    try:
        o = _parser().parse_args(argv)
        if o.command == "explain" and not at:
            raise ValueError("explain needs -- FILE:LINE")
        if o.co_change not in (None, "off") and not o.co_change.isdigit():
            raise ValueError("--co-change: a whole number or off")
        config = C.load(o.config)
    except (ValueError, C.ConfigError) as e:
        print(f"error: {e}", file=err)
        return 2
    spark = spark or SparkSession.builder.appName("weftgraph").config("spark.ui.showConsoleProgress", "false").getOrCreate()
    if o.command == "diff":
        return _diff(spark, o, config, out, err)
    s = scan_folders(spark, o.folders, o.glob, config)
    if o.command == "explain":
        try:
            rows = scoring.explain_at(s.edges, at)
        except ValueError as e:
            print(f"error: {e}", file=err)
            return 2
        print("\n".join(sinks.edge_lines(rows, o.top)) or "nothing is coupled there", file=out)
        return 0
    _give(report(spark, s, o, _pairs(spark, o.folders[0], o, config)), o.out, out)
    bad = [r["message"] for r in s.violations().collect()]
    for message in bad:
        print(f"violation: {message}", file=err)
    return int(bool(bad))


def _diff(spark: SparkSession, o, config: dict, out, err) -> int:
    base = history.base_ref(o.repo, o.base)
    if base is None:
        print("error: no base: give --base=REF", file=err)
        return 2
    made = []
    try:
        scans = []
        for ref in (base, o.head):
            folder = history.materialize(o.repo, ref)
            made += [folder] if ref != "working" else []
            scans.append(scan_folders(spark, [folder], o.glob, config))
        changes = compare(*scans)
        text, code = sinks.diff_report(_filtered(changes["added"], o), changes["added_cycles"], o.format, o.top)
        _give(text, o.out, out)
        return code
    except ValueError as e:
        print(f"error: {e}", file=err)
        return 2
    finally:
        for folder in made:
            shutil.rmtree(folder, ignore_errors=True)


def _give(text: str, path: str | None, out) -> None:
    if path:
        Path(path).write_text(text)
    else:
        print(text, file=out)


def main() -> None:
    sys.exit(run(sys.argv[1:]))
