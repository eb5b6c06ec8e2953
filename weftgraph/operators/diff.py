"""Differences of snapshots, and gates over them."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from weftgraph.functions import exprs as E


def keyed(edges: DataFrame, root: str = "") -> DataFrame:
    """Scored edges with edge_key; paths are taken relative to root."""
    path = lambda p: E.relative_path(f"{p}_file", root) if root else E.to_posix(f"{p}_file")
    key = E.edge_key(F.col("ctype"), F.col("a_kind"), F.col("a_identity"), path("a"), F.col("a_name"), F.col("b_kind"), F.col("b_identity"), path("b"), F.col("b_name"))
    return edges.withColumn("edge_key", key)


def added(base: DataFrame, head: DataFrame, key: str = "edge_key") -> DataFrame:
    """Rows of head whose key base lacks; rows that share a new key are all kept."""
    return head.join(base.select(key).distinct(), key, "left_anti")


def removed(base: DataFrame, head: DataFrame, key: str = "edge_key") -> DataFrame:
    return added(head, base, key)


def cycle_changes(base: DataFrame, head: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(added, removed) cycles, by their members."""
    b, h = (x.withColumn("cycle_key", E.cycle_key("files")) for x in (base, head))
    return added(b, h, "cycle_key"), removed(b, h, "cycle_key")


def diff(base: DataFrame, head: DataFrame, base_cycles: DataFrame | None = None, head_cycles: DataFrame | None = None, base_root: str = "", head_root: str = "") -> dict[str, DataFrame]:
    b, h = keyed(base, base_root), keyed(head, head_root)
    out = {"added": added(b, h), "removed": removed(b, h)}
    if base_cycles is not None and head_cycles is not None:
        out["added_cycles"], out["removed_cycles"] = cycle_changes(base_cycles, head_cycles)
    return out


def diff_gate(added_edges: DataFrame, added_cycles: DataFrame) -> int:
    """1 if a sure edge or a cycle was added; filters on edges don't touch cycles."""
    return int(not added_edges.where(E.gateable("ctype")).isEmpty() or not added_cycles.isEmpty())


def violations(edges: DataFrame, thresholds: dict[str, int] | None = None, gate: tuple[int, int] | None = None) -> DataFrame:
    """(kind, message, n): types over their thresholds, and edges at least as strong and far as the gate."""
    spark = edges.sparkSession
    out = spark.createDataFrame([], "kind string, message string, n long")
    if thresholds:
        most = spark.createDataFrame(list(thresholds.items()), "ctype string, most int")
        over = edges.groupBy("ctype").agg(F.count("*").alias("n")).join(most, "ctype").where(F.col("n") > F.col("most"))
        out = out.unionByName(over.select(F.lit("threshold").alias("kind"), F.format_string("%s: %d edges exceed the threshold of %d", "ctype", "n", "most").alias("message"), "n"))
    if gate:
        hit = edges.where((F.col("strength") >= gate[0]) & (F.col("locality") >= gate[1])).agg(F.count("*").alias("n")).where("n > 0")
        out = out.unionByName(hit.select(F.lit("gate").alias("kind"), F.format_string(f"%d edges of strength {gate[0]} or more at locality {gate[1]} or more", "n").alias("message"), "n"))
    return out
