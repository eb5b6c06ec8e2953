"""Reports. Counts and orders are made by Spark; only what is shown comes to the driver."""

from __future__ import annotations

import html
import json

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from weftgraph.functions import constants as K
from weftgraph.functions import exprs as E
from weftgraph.operators.scoring import edge_order


def _rows(df: DataFrame, *order, top: int = 0) -> list[dict]:
    """The first rows; top 0 is all of them (the caller bounds the table)."""
    df = df.orderBy(*order) if order else df
    return [r.asDict(recursive=True) for r in (df.limit(top) if top else df).collect()]


def scan_json(edges: DataFrame, summary: DataFrame, pressure: DataFrame | None = None, quality: DataFrame | None = None, cycles: DataFrame | None = None, levelization: DataFrame | None = None, cochange: DataFrame | None = None) -> DataFrame:
    """(line): the edges as JSON lines after one of the whole; sections that weren't made are null or empty. Written
    with ``write.text``; no edge comes to the driver."""
    one = lambda df: _rows(df)[0] if df is not None else None
    head = {
        "summary": {r["ctype"]: r["edges"] for r in _rows(summary, "ctype")}, "pressure": one(pressure), "quality": one(quality),
        "cycles": _rows(cycles, "component") if cycles is not None else [], "levelization": one(levelization), "coChange": _rows(cochange, "a", "b") if cochange is not None else [],
    }
    first = edges.sparkSession.createDataFrame([(json.dumps(head, default=str),)], "line string")
    return first.unionByName(edges.select(F.to_json(F.struct(*edges.columns)).alias("line")))


def read_scan(spark, path: str) -> DataFrame:
    """The scored edges of a scan that ``scan_json`` wrote; lines that aren't edges are left out."""
    from weftgraph.functions.schema import SCORED

    rows = spark.read.text(path).select(F.from_json("value", SCORED).alias("e")).select("e.*")
    return rows.where(F.col("ctype").isNotNull() & F.col("a_id").isNotNull() & F.col("b_id").isNotNull())


def sarif(edges: DataFrame, root: str = "", cycles: DataFrame | None = None, cochange: DataFrame | None = None, top: int = 0, version: str = "0.1.0") -> str:
    """SARIF 2.1.0: a rule for each type, cycles and co-change; all edges as results, foremost first, or with top so
    many of each kind, and how many there are. One document is made by the driver: ``scan_json`` writes any number."""
    rules = [{"id": t, "shortDescription": {"text": f"coupling by {t}"}, "properties": {"heuristic": t in K.HEURISTIC, "strength": s}} for t, s in K.STRENGTH.items()]
    rules += [{"id": i, "shortDescription": {"text": i}, "properties": {"heuristic": h, "strength": 0}} for i, h in (("cycle", False), ("co-change", True))]

    def uri(path: str) -> str:
        path, r = path.replace("\\", "/"), root.replace("\\", "/").rstrip("/")
        return path[len(r) + 1 :] if r and path.startswith(r + "/") else path

    def at(path: str, line: int) -> dict:
        return {"physicalLocation": {"artifactLocation": {"uri": uri(path)}, "region": {"startLine": max(1, line)}}}

    results = []
    totals = {"edges": edges.count()} if top else {}
    for e in _rows(edges.withColumn("level", E.sarif_level("strength")), *edge_order(), top=top):
        results.append({"ruleId": e["ctype"], "level": e["level"], "message": {"text": f"{e['evidence']} (strength {e['strength']}, locality {e['locality']}, degree {e['degree']})"}, "locations": [at(e["a_file"], e["a_line"]), at(e["b_file"], e["b_line"])], "partialFingerprints": {"b": f"{uri(e['b_file'])}#{e['b_name']}"}})
    for c in _rows(cycles, "component", top=top) if cycles is not None else []:
        files = [uri(f) for f in c["files"]]
        results.append({"ruleId": "cycle", "level": "error", "message": {"text": f"{len(files)} files depend on each other: {', '.join(files)}"}, "locations": [at(m["file"], m["line"]) for m in c["members"]], "partialFingerprints": {"cycle": "|".join(files)}})
    for p in _rows(cochange, F.desc("ratio"), F.desc("support"), "a", "b", top=top) if cochange is not None else []:
        results.append({"ruleId": "co-change", "level": "note", "message": {"text": f"changed together {p['support']} times, {p['ratio']:.2f} of the rarer one's"}, "locations": [at(p["a"], 1), at(p["b"], 1)], "partialFingerprints": {"pair": f"{uri(p['a'])}|{uri(p['b'])}"}})
    return json.dumps({"$schema": "https://json.schemastore.org/sarif-2.1.0.json", "version": "2.1.0", "runs": [{"tool": {"driver": {"name": "weftgraph", "version": version, "rules": rules}}, "results": results, **({"properties": {"shown": top, **totals}} if top else {})}]}, indent=1)


def html_page(title: str, edges: DataFrame, hotspots: DataFrame, axes: DataFrame | None = None, top: int = 25) -> str:
    """A page of the axes, the hottest files and the most pressing edges."""
    esc = lambda x: html.escape(str(x))
    out = [f"<!DOCTYPE html><meta charset=utf-8><title>{esc(title)}</title><h1>{esc(title)}</h1>"]
    if axes is not None:
        out.append("<table>" + "".join(f"<tr><td>{esc(a['key'])}<td><meter value={a['value']:.4f}></meter><td>{a['value']:.2f}" for a in _rows(axes, "n")) + "</table>")
    spots = _rows(hotspots, F.desc("pressure"), F.desc("edges"), "file", top=top)
    out.append("<table>" + "".join(f"<tr><td>{esc(h['file'])}<td>{h['edges']}<td>{h['pressure']:.2f}" for h in spots) + "</table>")
    out.append("<ol>" + "".join(f"<li>{esc(e['ctype'])}: {esc(e['a_name'])} ({esc(e['a_file'])}:{e['a_line']}), {esc(e['b_name'])} ({esc(e['b_file'])}:{e['b_line']})" for e in _rows(edges, *edge_order(), top=top)) + "</ol>")
    return "".join(out)


def listing(lines: list[str], shown: int, total: int, what: str = "more") -> list[str]:
    return [*lines, f"and {total - shown} {what}"] if total > shown else lines


def summary_text(summary: DataFrame) -> str:
    rows = _rows(summary, F.desc("edges"), "ctype")
    return ", ".join(f"{r['ctype']} {r['edges']}" for r in rows) or "none"


def edge_lines(edges: DataFrame, top: int = 20) -> list[str]:
    total = edges.count()
    rows = _rows(edges, *edge_order(), top=top)
    lines = [f"{e['ctype']}: {e['a_file']}:{e['a_line']} {e['a_name']}, {e['b_file']}:{e['b_line']} {e['b_name']} (strength {e['strength']}, locality {e['locality']}, degree {e['degree']})" for e in rows]
    return listing(lines, len(rows), total)


def finding_lines(findings: DataFrame, top: int = 20, least: str = "medium") -> list[str]:
    from weftgraph.operators.findings import finding_order, severe

    shown = severe(findings, least)
    total, hidden = shown.count(), findings.count()
    rows = _rows(shown, *finding_order(), top=top)
    lines = [f"[{r['severity']}] {r['kind']}: {r['key']} ({r['edges']} edges, {len(r['members'])} places)" for r in rows]
    lines = listing(lines, len(rows), total)
    return [*lines, f"{hidden - total} below {least} aren't shown"] if hidden > total else lines


def architecture_lines(parts: dict[str, DataFrame], top: int = 5) -> list[str]:
    out = [f"{len(m['files'])} files: {m['name']}" for m in _rows(parts["modules"], F.desc(F.size("files")), "name", top=top)]
    out += [f"{d['src']} needs {d['dst']}: {d['edges']} edges, weight {d['weight']}" for d in _rows(parts["dependencies"].where("weight >= 6"), F.desc("weight"), F.desc("edges"), "src", "dst", top=top)]
    out += [f"tangle: {t['src']} and {t['dst']} ({t['edges']} and {t['back_edges']} edges)" for t in _rows(parts["tangles"], F.desc("weight"), "src", "dst", top=top)]
    out += [f"cycle: {', '.join(c['path'])}" for c in _rows(parts["cycles"], "component", top=top)]
    layers = _rows(parts["layers"], "level")
    return out + [f"layer {x['level']}: {', '.join(x['modules'])}" for x in layers]


def cochange_lines(pairs: DataFrame, top: int = 20) -> list[str]:
    total = pairs.count()
    rows = _rows(pairs, F.desc("ratio"), F.desc("support"), "a", "b", top=top)
    return listing([f"{p['a']} and {p['b']}: {p['support']} commits, {p['ratio']:.2f}" for p in rows], len(rows), total)


def quality_lines(score: DataFrame, axes: DataFrame) -> list[str]:
    one = _rows(score)[0]
    return [f"quality {one['score']:.0f} of 10000: " + ", ".join(f"{a['key']} {a['value']:.2f}" for a in _rows(axes.withColumn("_n", F.array_position(F.array(*map(F.lit, K.AXES)), F.col("key"))), "_n"))]


def pressure_lines(pressure: DataFrame) -> list[str]:
    p = _rows(pressure)[0]
    return [f"pressure {p['total']:.2f} over {p['edges']} edges, mean {p['mean']:.3f}, most {p['most']:.2f}"]


def cohesion_lines(dirs: DataFrame, splits: DataFrame, top: int = 20) -> list[str]:
    """Directories and files that hold several concerns, with what to do."""
    from weftgraph.operators.cohesion import cohesion_advice, cohesion_order, split_order

    out = []
    for r in _rows(dirs, *cohesion_order(), top=top):
        out += [f"{r['dir']}: {x}" for x in cohesion_advice(r["external_fan_in"], r["clusters"])]
    for r in _rows(splits, *split_order(), top=top):
        out.append(f"{r['file']}: {len(r['groups'])} groups that share nothing: " + "; ".join(", ".join(m["name"] for m in g) for g in r["groups"]))
    return out


def level_lines(solved: DataFrame, top: int = 20) -> list[str]:
    total = solved.count()
    rows = _rows(solved.select("node", "level"), F.desc("level"), "node", top=top)
    return listing([f"{r['level']}: {r['node']}" for r in rows], len(rows), total)


def diff_report(added: DataFrame, added_cycles: DataFrame, form: str = "summary", top: int = 20) -> tuple[str, int]:
    """(text, exit code): 1 if a sure edge or a cycle was added. Forms: summary, json, sarif, agent."""
    sure, cycles = added.where(E.gateable("ctype")), added_cycles.count()
    n = sure.count()
    if form == "sarif":
        text = sarif(added, cycles=added_cycles)
    elif form == "json":
        text = json.dumps({"confirmed": n, "cycles": cycles, "added": _rows(added, *edge_order(), top=top)}, default=str)
    else:
        lines = edge_lines(sure, top)
        text = "\n".join([f"{n} sure edges and {cycles} cycles were added", *(f"- {x}" if form == "agent" else x for x in lines)])
    return text, int(n + cycles > 0)


def truncated(text: str, budget: int) -> str:
    """At most budget characters, cut at the end of a line."""
    if len(text) <= budget:
        return text
    cut = text.rfind("\n", 0, budget)
    return text[: cut if cut > 0 else budget]


def session_message(added: DataFrame, before: int, after: int, top: int = 5, budget: int = 1500) -> str:
    """What a session is told about its new edges."""
    total = added.count()
    order = (F.desc("strength"), F.desc("locality"), F.desc("degree"), "a_file", "a_line", "b_file", "b_line")
    rows = _rows(added, *order, top=max(1, top))
    lines = [f"{total} new couplings in this session, {before} edges before and {after} now"]
    lines += [f"{e['ctype']}: {e['a_file']}:{e['a_line']} {e['a_name']}, {e['b_file']}:{e['b_line']} {e['b_name']}" for e in rows]
    return truncated("\n".join(listing(lines, len(rows), total)), budget)


def health_message(edges: DataFrame, summary: DataFrame, counts: DataFrame, before: int | None = None, top: int = 5, budget: int = 1500) -> str:
    total = edges.count()
    lines = [f"{total} edges ({summary_text(summary)})"]
    if before is not None:
        lines.append(f"{total - before:+d} since the session began")
    spots = _rows(counts, F.desc("edges"), "file", top=max(1, top))
    if spots:
        lines.append("most coupled: " + ", ".join(f"{s['file']} ({s['edges']})" for s in spots))
    return truncated("\n".join(lines), budget)
