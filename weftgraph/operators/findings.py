"""Findings: edges of one cause gathered to one row each."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from weftgraph.functions import constants as K
from weftgraph.functions import exprs as E
from weftgraph.operators.scoring import rank_struct

FINDING = ["kind", "key", "edges", "members", "worst", "severity", "pressure", "strength", "heuristic"]


def _place(p: str) -> Column:
    return F.struct(F.col(f"{p}_file").alias("file"), F.col(f"{p}_line").alias("line"), F.col(f"{p}_name").alias("name"))


def _worst() -> Column:
    return F.struct("a_file", "a_line", "a_name", "b_file", "b_line", "b_name", "ctype", "strength", "locality", "pressure", "evidence")


def in_tests(path: Column | str) -> Column:
    return E.to_posix(path).rlike(K.TEST_PATH)


def grouped(edges: DataFrame, kind: str, key: Column, places: Column, ends: str = "ab") -> DataFrame:
    """One finding for each key. Members are pre-aggregated by place, so a hot key moves each place once; the
    worst edge is the foremost in edge order. A finding all of whose ends (a, b or both) are in tests is low."""
    rows = edges.withColumns({"key": key, "rank": rank_struct()})
    site = rows.select("key", "rank", F.explode(places).alias("p")).groupBy("key", F.col("p.file").alias("file"), F.col("p.line").alias("line")).agg(F.min_by("p.name", "rank").alias("name"))
    members = site.groupBy("key").agg(F.array_sort(F.collect_list(F.struct("file", "line", "name"))).alias("members"))
    tested = reduce(lambda x, y: x & y, (in_tests(f"{e}_file") for e in ends))
    worst = rows.groupBy("key").agg(F.count("*").alias("edges"), F.min_by(_worst(), "rank").alias("worst"), F.bool_and(tested).alias("tested"))
    return _finished(worst.join(members, "key").withColumn("kind", F.lit(kind)))


def _finished(df: DataFrame) -> DataFrame:
    w = F.col("worst")
    severity = E.severity_of(w["ctype"], w["strength"], w["locality"], w["pressure"])
    df = df.withColumns({"severity": F.when(F.col("tested") & (F.col("kind") != "meaning"), "low").otherwise(severity), "pressure": w["pressure"], "strength": w["strength"], "heuristic": E.is_heuristic(w["ctype"])})
    return df.select(*FINDING)


def position_islands(edges: DataFrame) -> DataFrame:
    """Position edges with their island: groups of one call site and callee file, merged where parameter lines are
    at most two apart. The window runs over (callee file), on lines already reduced to one row a group."""
    site = F.concat_ws(":", "a_file", "a_line")
    rows = edges.where("ctype = 'position'").withColumn("site", site)
    groups = rows.groupBy("b_file", "site").agg(F.min("b_line").alias("low"), F.max("b_line").alias("high"))
    lines = groups.groupBy("b_file", "low").agg(F.max("high").alias("high"))
    w = Window.partitionBy("b_file").orderBy("low")
    lines = lines.withColumn("before", F.max("high").over(w.rowsBetween(Window.unboundedPreceding, -1)))
    lines = lines.withColumn("island", F.sum(F.coalesce((F.col("low") - F.col("before") > K.MERGE_GAP).cast("int"), F.lit(0))).over(w.rowsBetween(Window.unboundedPreceding, 0)))
    return rows.join(groups.select("b_file", "site", "low"), ["b_file", "site"]).join(lines.select("b_file", "low", "island"), ["b_file", "low"])


def position_findings(edges: DataFrame) -> DataFrame:
    rows = position_islands(edges)
    key = F.concat_ws("#", "b_file", F.col("island").cast("string"))
    params = rows.groupBy(key.alias("key")).agg(F.count_distinct("b_file", "b_line").alias("params")).where(F.col("params") >= 2)
    return grouped(rows, "position", key, F.array(_place("a"), _place("b")), "a").join(params.select("key"), "key", "left_semi").select(*FINDING)


def name_findings(edges: DataFrame) -> DataFrame:
    """One for each pair of places, always low."""
    key = F.format_string("%s:%d->%s:%d", "a_file", "a_line", "b_file", "b_line")
    out = grouped(edges.where("ctype = 'name'"), "name", key, F.array(_place("a"), _place("b")))
    return out.withColumns({"severity": F.lit("low"), "edges": F.lit(1).cast("long")})


def cycle_findings(cycles: DataFrame) -> DataFrame:
    """From file cycles: high, unless tests alone are in them."""
    tests = F.forall("files", in_tests)
    members = F.transform("members", lambda m: F.struct(m["file"].alias("file"), m["line"].alias("line"), m["name"].alias("name")))
    w = F.col("worst")
    worst = F.struct(*(w[c].alias(c) for c in ("a_file", "a_line", "a_name", "b_file", "b_line", "b_name")), F.lit("name").alias("ctype"), w["strength"].alias("strength"), F.lit(0).alias("locality"), w["pressure"].alias("pressure"), F.lit("cycle").alias("evidence"))
    return cycles.select(
        F.lit("cycle").alias("kind"), E.cycle_key("files").alias("key"), "edges", members.alias("members"), worst.alias("worst"),
        F.when(tests, "low").otherwise("high").alias("severity"), w["pressure"].alias("pressure"), w["strength"].alias("strength"), F.lit(False).alias("heuristic"),
    )


def cluster_findings(edges: DataFrame, cycles: DataFrame | None = None) -> DataFrame:
    """All findings. Value, type, execution and timing edges have no grouping and give none."""
    of = lambda t: edges.where(F.col("ctype") == t)
    parts = [
        grouped(of("identity"), "identity", F.format_string("%s:%d", "b_file", "b_line"), F.array(_place("b"), _place("a"))),
        grouped(of("meaning"), "meaning", F.regexp_extract("evidence", r"(?s)^literal (.*) at \d+ sites", 1), F.array(_place("b"))),
        grouped(of("algorithm"), "algorithm", F.array_join(F.array_sort(F.array("a_name", "b_name")), "::"), F.array(_place("a"), _place("b"))),
        position_findings(edges),
        name_findings(edges),
    ]
    if cycles is not None:
        parts.append(cycle_findings(cycles))
    out = parts[0]
    for p in parts[1:]:
        out = out.unionByName(p)
    return out


def finding_order() -> tuple:
    return F.desc(F.col("kind") == "cycle"), F.asc("heuristic"), F.desc("pressure"), F.desc("strength"), F.desc(F.size("members")), F.desc("edges"), F.asc("kind"), F.asc("key")


def severe(findings: DataFrame, least: str = "medium") -> DataFrame:
    return findings.where(E.severity_rank("severity") >= K.SEVERITY_RANK[least])


ADVICE = {
    "name": "rename both sides together",
    "type": "share one declared type",
    "meaning": "give the literal a name in one place",
    "position": "pass named options instead of places in a list",
    "algorithm": "keep one body and call it",
    "execution": "make the order explicit in one function",
    "timing": "replace the delay by a signal",
    "value": "derive the constants from one definition",
    "identity": "let one owner hold the state and pass it on",
    "cycle": "move what both sides need below them",
}


def with_advice(findings: DataFrame) -> DataFrame:
    """findings with fix: by kind; ten rows are broadcast."""
    rows = findings.sparkSession.createDataFrame(list(ADVICE.items()), "kind string, fix string")
    return findings.join(F.broadcast(rows), "kind", "left").withColumn("fix", F.coalesce("fix", F.lit("look at both places")))
