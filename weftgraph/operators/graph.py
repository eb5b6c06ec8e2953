"""Directed graphs: strong components, cycles and levels.

Graphs of files are usually small; up to ``small`` edges one task solves them. Larger ones are solved by
bounded loops of joins, each round of which is written to storage.
"""

from __future__ import annotations

import atexit
import shutil
import tempfile
import uuid
from collections.abc import Callable

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

SMALL = 200_000
Store = Callable[[DataFrame, str], DataFrame]
_folders: dict[str, str] = {}


def fresh_path(spark: SparkSession, name: str) -> str:
    """A path in ``spark.checkpoint.dir`` that nothing used before; only a local session may lack that setting."""
    base = spark.conf.get("spark.checkpoint.dir", None)
    if not base:
        if not spark.sparkContext.master.startswith("local"):
            raise ValueError("set spark.checkpoint.dir to a folder that all executors share")
        app = spark.sparkContext.applicationId
        if app not in _folders:
            _folders[app] = f"file://{tempfile.mkdtemp(prefix='weftgraph-')}"
            atexit.register(shutil.rmtree, _folders[app].removeprefix("file://"), ignore_errors=True)
        base = _folders[app]
    return f"{base.rstrip('/')}/{name}-{uuid.uuid4().hex}"


def store(df: DataFrame, name: str) -> DataFrame:
    """df written to a fresh path and read again."""
    spark, path = df.sparkSession, fresh_path(df.sparkSession, name)
    df.write.parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def file_graph(edges: DataFrame) -> DataFrame:
    """(src, dst) files that resolved name edges join; loops are left out."""
    sure = edges.where((F.col("ctype") == "name") & F.col("resolved") & (F.col("a_file") != F.col("b_file")))
    return sure.select(F.col("a_file").alias("src"), F.col("b_file").alias("dst")).distinct()


def strong_components_local(pairs: list[tuple[str, str]]) -> dict[str, str]:
    """Node to the smallest node of its strong component; iterative."""
    out: dict[str, list[str]] = {}
    for a, b in sorted(set(pairs)):
        out.setdefault(a, []).append(b)
        out.setdefault(b, [])
    index: dict[str, int] = {}
    low: dict[str, int] = {}
    on, stack, result = set(), [], {}
    for root in sorted(out):
        if root in index:
            continue
        index[root] = low[root] = len(index)
        stack.append(root)
        on.add(root)
        work = [(root, iter(out[root]))]
        while work:
            node, rest = work[-1]
            for n in rest:
                if n not in index:
                    index[n] = low[n] = len(index)
                    stack.append(n)
                    on.add(n)
                    work.append((n, iter(out[n])))
                    break
                if n in on:
                    low[node] = min(low[node], index[n])
            else:
                work.pop()
                if work:
                    low[work[-1][0]] = min(low[work[-1][0]], low[node])
                if low[node] == index[node]:
                    members = []
                    while not members or members[-1] != node:
                        members.append(stack.pop())
                        on.discard(members[-1])
                    for m in members:
                        result[m] = min(members)
    return result


def _levels_local(component: dict[str, str], pairs: list[tuple[str, str]]) -> dict[str, int]:
    needs: dict[str, set[str]] = {c: set() for c in component.values()}
    users: dict[str, set[str]] = {c: set() for c in needs}
    for a, b in pairs:
        x, y = component[a], component[b]
        if x != y:
            needs[x].add(y)
            users[y].add(x)
    level = {c: 1 for c, n in needs.items() if not n}
    waiting, ready = {c: len(n) for c, n in needs.items()}, list(level)
    while ready:
        c = ready.pop()
        for u in users[c]:
            level[u] = max(level.get(u, 1), level[c] + 1)
            waiting[u] -= 1
            if not waiting[u]:
                ready.append(u)
    return level


def _solve(pdf: pd.DataFrame) -> pd.DataFrame:
    pairs = list(zip(pdf["src"], pdf["dst"]))
    component = strong_components_local(pairs)
    level = _levels_local(component, pairs)
    return pd.DataFrame([(n, c, level[c]) for n, c in component.items()], columns=["node", "component", "level"])


def _distributed_components(edges: DataFrame, keep: Store, most_rounds: int) -> DataFrame:
    """Colours: the largest node that reaches each node; a colour's own node's component is what reaches it back
    within the colour. Each round settles at least a component for each colour that is left."""
    done, left = None, keep(edges, "graph")
    nodes = lambda e: e.select(F.col("src").alias("node")).union(e.select(F.col("dst").alias("node"))).distinct()
    open_nodes = keep(nodes(left), "nodes")
    for _ in range(most_rounds):
        if open_nodes.isEmpty():
            break
        color = keep(open_nodes.withColumn("color", F.col("node")), "colors")
        while True:
            via = left.join(color.withColumnRenamed("node", "src"), "src").groupBy(F.col("dst").alias("node")).agg(F.max("color").alias("seen"))
            new = keep(color.join(via, "node", "left").select("node", F.greatest("color", F.coalesce("seen", "color")).alias("color")), "colors")
            changed = not new.join(color.withColumnRenamed("color", "old"), "node").where("color <> old").isEmpty()
            color = new
            if not changed:
                break
        inside = left.join(color.select(F.col("node").alias("src"), F.col("color").alias("ca")), "src").join(color.select(F.col("node").alias("dst"), F.col("color").alias("cb")), "dst").where("ca = cb")
        inside = keep(inside.select("src", "dst"), "colored")
        reached = keep(color.where("node = color"), "reached")
        while True:
            more = inside.join(reached.select(F.col("node").alias("dst"), "color"), "dst").select(F.col("src").alias("node"), "color").distinct()
            more = keep(more.join(reached, "node", "left_anti"), "reached")
            if more.isEmpty():
                break
            reached = keep(reached.unionByName(more), "reached")
        done = reached if done is None else done.unionByName(reached)
        open_nodes = keep(open_nodes.join(reached, "node", "left_anti"), "nodes")
        left = keep(left.join(open_nodes.withColumnRenamed("node", "src"), "src", "left_semi").join(open_nodes.withColumnRenamed("node", "dst"), "dst", "left_semi"), "graph")
    else:
        if not open_nodes.isEmpty():
            raise RuntimeError(f"no strong components in {most_rounds} rounds")
    least = done.groupBy("color").agg(F.min("node").alias("component"))
    return keep(done.join(least, "color").select("node", "component"), "components")


def _distributed_levels(edges: DataFrame, component: DataFrame, keep: Store, most_rounds: int) -> DataFrame:
    a, b = component.select(F.col("node").alias("src"), F.col("component").alias("x")), component.select(F.col("node").alias("dst"), F.col("component").alias("y"))
    dag = keep(edges.join(a, "src").join(b, "dst").where("x <> y").select("x", "y").distinct(), "condensed")
    level = keep(component.select("component").distinct().withColumn("level", F.lit(1)), "levels")
    for _ in range(most_rounds):
        via = dag.join(level.withColumnRenamed("component", "y"), "y").groupBy(F.col("x").alias("component")).agg((F.max("level") + 1).alias("up"))
        new = keep(level.join(via, "component", "left").select("component", F.greatest("level", F.coalesce("up", "level")).alias("level")), "levels")
        if new.join(level.withColumnRenamed("level", "old"), "component").where("level <> old").isEmpty():
            break
        level = new
    else:
        raise RuntimeError(f"no levels in {most_rounds} rounds")
    return component.join(level, "component")


def components_and_levels(edges: DataFrame, small: int = SMALL, keep: Store = store, most_rounds: int = 1000) -> DataFrame:
    """(node, component, level) of a graph (src, dst), where src depends on dst: the strong component's smallest
    node, and 1 more than the highest level of the components that it depends on. An empty graph gives no rows."""
    edges = edges.select(F.col("src").cast("string"), F.col("dst").cast("string")).where("src IS NOT NULL AND dst IS NOT NULL").distinct()
    edges = keep(edges, "graph")  # it is counted, then solved
    if edges.limit(small + 1).count() <= small:
        return edges.withColumn("_g", F.lit(0)).groupBy("_g").applyInPandas(_solve, "node string, component string, level int")
    component = _distributed_components(edges, keep, most_rounds)
    return _distributed_levels(edges, component, keep, most_rounds).select("node", "component", "level")


def levelization(solved: DataFrame) -> DataFrame:
    """One row: depth, components, and whether some component is a cycle."""
    sizes = solved.groupBy("component").agg(F.count("*").alias("n"), F.max("level").alias("level"))
    return sizes.agg(F.coalesce(F.max("level"), F.lit(0)).alias("depth"), F.count("*").alias("components"), F.coalesce(F.bool_or(F.col("n") > 1), F.lit(False)).alias("cyclic"))


def level_entries(solved: DataFrame) -> DataFrame:
    return solved.select(F.col("node").alias("name"), "level")


def file_cycles(edges: DataFrame, solved: DataFrame | None = None, least: int = 2) -> DataFrame:
    """(component, files, edges, members, worst) of strong components of at least so many files: the number of
    edges inside, a representative place in each file, and the foremost edge."""
    solved = components_and_levels(file_graph(edges)) if solved is None else solved
    large = solved.groupBy("component").agg(F.count("*").alias("n")).where(F.col("n") >= least)
    member = solved.join(large.select("component"), "component", "left_semi").select("node", "component")
    sure = edges.where((F.col("ctype") == "name") & F.col("resolved") & (F.col("a_file") != F.col("b_file")))
    inside = sure.join(member.select(F.col("node").alias("a_file"), F.col("component").alias("component")), "a_file").join(member.select(F.col("node").alias("b_file"), F.col("component").alias("_b")), "b_file").where("component = _b")
    # The first edge in order that touches a file names its place there.
    place = lambda p: F.struct(F.col(f"{p}_name").alias("name"), F.col(f"{p}_file").alias("file"), F.col(f"{p}_line").alias("line"))
    rank = F.struct(-F.coalesce("pressure", F.lit(0.0)), -F.col("strength"), -F.col("locality"), -F.col("degree"), "a_file", "a_line", "b_file", "b_line", "seq")
    touch = inside.select("component", F.explode(F.array(place("a"), place("b"))).alias("place"), rank.alias("rank"))
    first = touch.groupBy("component", F.col("place.file").alias("file")).agg(F.min_by("place", "rank").alias("place"))
    members = first.groupBy("component").agg(F.transform(F.array_sort(F.collect_list(F.struct("file", "place"))), lambda x: x["place"]).alias("members"))
    worst = inside.groupBy("component").agg(F.count("*").alias("edges"), F.min_by(F.struct("a_file", "a_line", "a_name", "b_file", "b_line", "b_name", "strength", "pressure"), rank).alias("worst"))
    files = member.groupBy("component").agg(F.array_sort(F.collect_list("node")).alias("files"))
    return files.join(worst, "component").join(members, "component")


def reachable(edges: DataFrame, keep: Store = store, most_rounds: int = 1000) -> DataFrame:
    """(src, dst) pairs joined by a path of one edge or more. Paths double each round."""
    now = keep(edges.select("src", "dst").distinct(), "reach")
    n = now.count()
    for _ in range(most_rounds):
        step = now.join(now.select(F.col("src").alias("dst"), F.col("dst").alias("end")), "dst").select("src", F.col("end").alias("dst"))
        now = keep(now.union(step).distinct(), "reach")
        if (m := now.count()) == n:
            return now
        n = m
    raise RuntimeError(f"no closure in {most_rounds} rounds")


def tangles(couplings: DataFrame) -> DataFrame:
    """Pairs of a coupling table (src, dst, edges, weight) that depend on each other; forward is the stronger side,
    by name if they are equal."""
    back = couplings.select(F.col("src").alias("dst"), F.col("dst").alias("src"), F.col("edges").alias("back_edges"), F.col("weight").alias("back_weight"))
    both = couplings.where("src <> dst").join(back, ["src", "dst"])
    lead = F.struct(-F.col("weight"), -F.col("edges"), F.col("src")) < F.struct(-F.col("back_weight"), -F.col("back_edges"), F.col("dst"))
    return both.where(lead).select("src", "dst", "edges", "weight", "back_edges", "back_weight")


def one_way(couplings: DataFrame) -> DataFrame:
    back = couplings.select(F.col("src").alias("dst"), F.col("dst").alias("src"))
    return couplings.where("src <> dst").join(back, ["src", "dst"], "left_anti")
