"""Modules found in the file graph, and how they depend on each other.

Local moving depends on the order of nodes and of edges, so a clustering runs in one task on the aggregated
graph of files (a row for each pair of files), never on edges.
"""

from __future__ import annotations

import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from weftgraph.functions import constants as K
from weftgraph.functions import exprs as E
from weftgraph.operators.graph import components_and_levels, tangles
from weftgraph.operators.scoring import rank_struct


def dependencies(edges: DataFrame) -> DataFrame:
    return edges.where(F.col("ctype").isin(*K.DEPENDENCY))


def dependency_weight(edges: DataFrame) -> DataFrame:
    """(a, b, w, seq), a < b: the strengths of dependencies between two files; seq is where the pair first occurs."""
    dep = dependencies(edges).where(F.col("a_file") != F.col("b_file"))
    return dep.groupBy(F.least("a_file", "b_file").alias("a"), F.greatest("a_file", "b_file").alias("b")).agg(F.sum("strength").cast("double").alias("w"), F.min(rank_struct()).alias("seq"))


def local_moving(pairs: list[tuple[str, str, float]]) -> dict[str, int]:
    """Communities of an undirected weighted graph, pairs in edge order. A node moves to a neighbouring community
    whose gain exceeds its own's less epsilon; its own degree counts in its own community."""
    nodes = sorted({x for p in pairs for x in p[:2]})
    community = {n: i for i, n in enumerate(nodes)}
    total = sum(w for _, _, w in pairs)
    if not total:
        return community
    degree = dict.fromkeys(nodes, 0.0)
    around: dict[str, dict[str, float]] = {n: {} for n in nodes}
    for a, b, w in pairs:
        for x, y in ((a, b), (b, a)):
            degree[x] += w
            around[x][y] = around[x].get(y, 0.0) + w
    held = {community[n]: degree[n] for n in nodes}
    for _ in range(K.LOUVAIN_SWEEPS):
        moved = False
        for n in nodes:
            into: dict[int, float] = {}
            for other, w in around[n].items():
                into[community[other]] = into.get(community[other], 0.0) + w
            gain = lambda c, n=n, into=into: into.get(c, 0.0) - K.LOUVAIN_RESOLUTION * degree[n] * held[c] / (2 * total)
            old = community[n]
            best, most = old, gain(old) - K.LOUVAIN_EPSILON
            for c in into:
                if c != old and (g := gain(c)) > most:
                    best, most = c, g
            if best != old:
                held[old] -= degree[n]
                held[best] += degree[n]
                community[n], moved = best, True
        if not moved:
            break
    return community


def cluster_name(members: list[str], prefixes: list[str]) -> str:
    """The members' common prefix; one that only part of the path shares ends in a plus sign."""
    if len(set(prefixes)) == 1:
        return prefixes[0]
    common = []
    for parts in zip(*(p.split("/") for p in prefixes)):
        if len(set(parts)) > 1:
            break
        common.append(parts[0])
    return "/".join(common) + "+…" if common else members[0]


def _dir(path: str) -> str:
    p = path.replace("\\", "/")
    return p.rpartition("/")[0] if "/" in p else "."


def _round(pairs: list[tuple[str, str, float]], files_of: dict[str, list[str]] | None) -> list[tuple[str, list[str], list[str]]]:
    community = local_moving(pairs)
    groups: dict[int, list[str]] = {}
    for n in sorted(community):
        groups.setdefault(community[n], []).append(n)
    out = []
    for members in groups.values():
        files = list(dict.fromkeys(f for m in members for f in files_of.get(m, []))) if files_of is not None else members
        out.append([cluster_name(members, members if files_of is not None else [_dir(m) for m in members]), files, members])
    out.sort(key=lambda c: (-len(c[1]), c[0]))
    used: dict[str, int] = {}
    for c in out:
        used[c[0]] = used.get(c[0], 0) + 1
        if used[c[0]] > 1:
            c[0] += f"#{used[c[0]]}"
    return [tuple(c) for c in out]


def _hierarchy(pdf: pd.DataFrame) -> pd.DataFrame:
    pairs = [(a, b, w) for a, b, w in pdf[["a", "b", "w"]].itertuples(index=False)] if len(pdf) else []
    rows, files_of = [], None
    for level in range(K.MODULE_LEVELS):
        clusters = _round(pairs, files_of) if pairs else []
        if not clusters:
            break
        before = len({x for p in pairs for x in p[:2]})
        rows += [(level, name, files, sorted({_dir(f) for f in files})) for name, files, _ in clusters]
        if len(clusters) <= 1 or len(clusters) >= before:
            break
        home = {m: name for name, _, members in clusters for m in members}
        files_of = {name: files for name, files, _ in clusters}
        weight: dict[tuple[str, str], float] = {}
        for a, b, w in pairs:
            if home[a] != home[b]:
                k = tuple(sorted((home[a], home[b])))
                weight[k] = weight.get(k, 0.0) + w
        pairs = [(*k, w) for k, w in weight.items()]
    return pd.DataFrame(rows, columns=["level", "name", "files", "dirs"])


def module_levels(weight: DataFrame) -> DataFrame:
    """(level, name, files, dirs) of every clustering, finest first, from (a, b, w, seq) rows."""

    def solve(pdf: pd.DataFrame) -> pd.DataFrame:
        return _hierarchy(pdf.sort_values("seq", kind="stable", key=None))

    ordered = weight.withColumn("seq", F.row_number().over(Window.orderBy("seq", "a", "b")))
    return ordered.withColumn("_g", F.lit(0)).groupBy("_g").applyInPandas(solve, "level int, name string, files array<string>, dirs array<string>")


def file_modules(edges: DataFrame) -> DataFrame:
    """The finest clustering: (name, files, dirs)."""
    return module_levels(dependency_weight(edges)).where("level = 0").drop("level")


def membership(modules: DataFrame) -> DataFrame:
    return modules.select(F.col("name").alias("module"), F.explode("files").alias("file"))


def couplings(edges: DataFrame, member: DataFrame) -> DataFrame:
    """(src, dst, edges, weight, worst): dependencies between modules (module, file)."""
    a, b = member.select(F.col("module").alias("src"), F.col("file").alias("a_file")), member.select(F.col("module").alias("dst"), F.col("file").alias("b_file"))
    cross = dependencies(edges).join(a, "a_file").join(b, "b_file").where("src <> dst")
    return cross.groupBy("src", "dst").agg(F.count("*").alias("edges"), F.sum("strength").alias("weight"), F.max("strength").alias("worst"))


def coupling_order() -> tuple:
    return F.desc("weight"), F.desc("edges"), F.asc("src"), F.asc("dst")


def mismatches(modules: DataFrame) -> DataFrame:
    return modules.where(F.size("dirs") >= K.MISMATCH_DIRS)


def module_cycles(coupled: DataFrame) -> DataFrame:
    """Strong components of more than two modules, as closed paths."""
    solved = components_and_levels(coupled.select("src", "dst"))
    rings = solved.groupBy("component").agg(F.array_sort(F.collect_list("node")).alias("m")).where(F.size("m") > 2)
    return rings.select("component", F.concat("m", F.slice("m", 1, 1)).alias("path"))


def layering(coupled: DataFrame, modules: DataFrame | None = None) -> DataFrame:
    """(level, modules) bottom-up; no rows if there is any tangle or cycle. Of modules (name), those without
    couplings are on the lowest level."""
    solved = components_and_levels(coupled.select("src", "dst"))
    if modules is not None:
        alone = modules.select(F.col("name").cast("string").alias("node")).distinct().join(solved, "node", "left_anti")
        solved = solved.unionByName(alone.select("node", F.col("node").alias("component"), F.lit(1).alias("level")))
    cyclic = solved.groupBy("component").agg(F.count("*").alias("n")).where("n > 1").limit(1)
    layers = solved.groupBy("level").agg(F.array_sort(F.collect_list("node")).alias("modules"))
    return layers.join(cyclic, F.lit(True), "left_anti")


def architecture(edges: DataFrame, modules: DataFrame) -> dict[str, DataFrame]:
    coupled = couplings(edges, membership(modules))
    return {"modules": modules, "dependencies": coupled, "tangles": tangles(coupled), "cycles": module_cycles(coupled), "mismatches": mismatches(modules), "layers": layering(coupled, modules)}


def contracted_weight(weight: DataFrame, member: DataFrame) -> DataFrame:
    """File weights summed for pairs of modules."""
    a, b = member.select(F.col("module").alias("x"), F.col("file").alias("a")), member.select(F.col("module").alias("y"), F.col("file").alias("b"))
    cross = weight.join(a, "a").join(b, "b").where("x <> y")
    return cross.groupBy(F.least("x", "y").alias("a"), F.greatest("x", "y").alias("b")).agg(F.sum("w").alias("w"))


def module_depth(edges: DataFrame, member: DataFrame) -> DataFrame:
    """(module, private, width, value): targets used only inside against the strengths asked from outside; d / (1 + d)
    with d = private / (1 + width)."""
    a, b = member.select(F.col("module").alias("ma"), F.col("file").alias("a_file")), member.select(F.col("module").alias("mb"), F.col("file").alias("b_file"))
    # A row for each file and target that it uses, before modules are joined.
    dep = dependencies(edges).groupBy("b_id", "b_file", "a_file").agg(F.max("strength").alias("strength")).join(b, "b_file").join(a, "a_file", "left")
    outside, inside = F.col("ma").isNull() | (F.col("ma") != F.col("mb")), (F.col("ma") == F.col("mb")) & (F.col("a_file") != F.col("b_file"))
    used = dep.groupBy(F.col("mb").alias("module"), "b_id").agg(F.max(F.when(outside, F.col("strength"))).alias("s"), F.bool_or(outside).alias("public"), F.coalesce(F.bool_or(inside), F.lit(False)).alias("inner"))
    sums = used.groupBy("module").agg(F.count_if(F.col("inner") & ~F.col("public")).alias("private"), F.sum("s").alias("width"))
    out = member.select("module").distinct().join(sums, "module", "left").na.fill(0, ["private", "width"])
    d = F.col("private") / (F.lit(1.0) + F.col("width"))
    return out.withColumn("value", d / (F.lit(1.0) + d))


def modularity(weight: DataFrame, member: DataFrame) -> DataFrame:
    """One row: q, the share of weight within modules less what their degrees lead one to expect."""
    a, b = member.select(F.col("module").alias("x"), F.col("file").alias("a")), member.select(F.col("module").alias("y"), F.col("file").alias("b"))
    rows = weight.join(a, "a").join(b, "b")
    ends = rows.select(F.explode(F.array(F.struct(F.col("x").alias("m"), F.when(F.col("x") == F.col("y"), F.col("w")).otherwise(0.0).alias("i"), "w"), F.struct(F.col("y").alias("m"), F.lit(0.0).alias("i"), "w"))).alias("e"))
    sums = ends.groupBy("e.m").agg(F.sum("e.i").alias("i"), F.sum("e.w").alias("d"))
    total = weight.agg(F.sum("w").alias("t"))
    return sums.join(F.broadcast(total)).agg(F.coalesce(F.sum(F.col("i") / F.col("t") - F.pow(F.col("d") / (2 * F.col("t")), 2)), F.lit(0.0)).alias("q"))
