"""Detectors: (nodes, refs) to raw edges (node_a, node_b, ctype, evidence, resolved, seq).

``seq`` orders edges as a sequential scan would emit them: detectors in their order, then node order.
Node tables are never broadcast by hint; adaptive execution picks join strategies by size.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from weftgraph.functions import constants as K
from weftgraph.functions import exprs as E
from weftgraph.functions.schema import RAW_EDGES, conform

_STEP = 1 << 56  # room for a detector's edges in seq


def _raw(df: DataFrame, ctype: str, resolved: bool | None = None) -> DataFrame:
    df = df.withColumn("ctype", F.lit(ctype)).withColumn("resolved", F.lit(resolved).cast("boolean"))
    df = df.withColumn("seq", F.lit(K.DETECTOR_ORDER.index(ctype) * _STEP) + F.col("seq"))
    return conform(df, RAW_EDGES)


def _as(df: DataFrame, prefix: str, *names: str) -> DataFrame:
    return df.select(*(F.col(n).alias(f"{prefix}_{n}") for n in names))


def name_edges(nodes: DataFrame, refs: DataFrame, skip_same_scope: bool = True, qualified_scopes: bool = False) -> DataFrame:
    """Reference to definition, unless both are in functions of one name (with ``qualified_scopes``: of one
    file too)."""
    scope = E.owner_name("scope_path")
    if qualified_scopes:
        scope = F.when(scope.isNotNull(), F.concat_ws("#", F.col("file_path"), scope))
    ends = nodes.withColumn("owner", scope)
    a, b = _as(ends, "a", "id", "seq", "name", "owner"), _as(ends, "b", "id", "name", "owner")
    out = refs.join(a, refs["ref_id"] == F.col("a_id")).join(b, refs["def_id"] == F.col("b_id"))
    if skip_same_scope:
        out = out.where(F.coalesce(F.col("a_owner") != F.col("b_owner"), F.lit(True)))
    evidence = F.format_string("reference '%s' resolves to '%s'", "a_name", "b_name")
    return _raw(out.select(F.col("a_id").alias("node_a"), F.col("b_id").alias("node_b"), evidence.alias("evidence"), F.col("a_seq").alias("seq")), "name", True)


def parameter_slots(nodes: DataFrame) -> DataFrame:
    """(owner, slot, param_id, param_name, n_params): a function's parameters in order of their place."""
    w = Window.partitionBy("parent_id")
    p = nodes.where(F.col("kind") == "parameter")
    return p.select(
        F.col("parent_id").alias("owner"),
        (F.row_number().over(w.orderBy("start_line", "start_col", "seq")) - 1).alias("slot"),
        F.col("id").alias("param_id"),
        F.col("name").alias("param_name"),
        F.count("*").over(w).alias("n_params"),
    )


def position_edges(nodes: DataFrame, names: DataFrame, min_parameters: int = K.MIN_PARAMETERS) -> DataFrame:
    """Argument to parameter of the same slot, for callees with so many parameters at least."""
    args = nodes.where(F.col("kind") == "argument").select("id", "seq", F.col("parent_id").alias("call"), F.col("name").try_cast("int").alias("slot"))
    calls = nodes.where(F.col("kind") == "call").select(F.col("id").alias("call"), F.col("parent_id").alias("ref"))
    # The first name edge of a reference is its callee.
    callee = names.groupBy(F.col("node_a").alias("ref")).agg(F.min_by("node_b", F.struct("seq", "node_b")).alias("owner"))
    slots = parameter_slots(nodes).where(F.col("n_params") >= min_parameters)
    hit = args.where("slot IS NOT NULL").join(calls, "call").join(callee, "ref").join(slots, ["owner", "slot"])
    evidence = F.format_string("argument %d binds to parameter '%s' by position", "slot", "param_name")
    return _raw(hit.select(F.col("id").alias("node_a"), F.col("param_id").alias("node_b"), evidence.alias("evidence"), "seq"), "position")


def algorithm_edges(nodes: DataFrame, min_lines: int = K.CLONE_LINES) -> DataFrame:
    """All pairs of nodes with one structure, in node order. AQE splits hot hashes; the pairs are the result."""
    has = nodes.where(F.col("structure_hash").isNotNull() & (F.col("end_line") - F.col("start_line") + 1 >= min_lines))
    a, b = _as(has, "a", "id", "seq", "name", "structure_hash"), _as(has, "b", "id", "seq", "name", "structure_hash")
    pairs = a.join(b, (F.col("a_structure_hash") == F.col("b_structure_hash")) & (F.col("a_seq") < F.col("b_seq")))
    evidence = F.format_string("'%s' and '%s' share one structure", "a_name", "b_name")
    return _raw(pairs.select(F.col("a_id").alias("node_a"), F.col("b_id").alias("node_b"), evidence.alias("evidence"), F.col("a_seq").alias("seq")), "algorithm")


def _star(sites: DataFrame, key: str, min_sites: int, min_files: int, evidence: Column) -> DataFrame:
    """First site of a key to each other. Counts are aggregated before the join, so a hot key's sites are never
    in one window."""
    groups = sites.groupBy(key).agg(F.count("*").alias("sites"), F.count_distinct("file_path").alias("files"), F.min_by("id", F.struct("seq", "id")).alias("first"))
    groups = groups.where((F.col("sites") >= min_sites) & (F.col("files") >= min_files))
    hit = sites.join(groups, key).where(F.col("id") != F.col("first"))
    return hit.select(F.col("first").alias("node_a"), F.col("id").alias("node_b"), evidence.alias("evidence"), "seq", F.col(key).alias("literal"), "sites", "files")


def meaning_star(nodes: DataFrame, min_sites: int = K.MEANING_SITES, min_files: int = K.MEANING_FILES, skip_trivial: bool = True, union_literal: Column | None = None) -> DataFrame:
    """Repeated literals; those for which ``union_literal`` holds are members of a declared union."""
    sites = nodes.where(F.col("kind") == "literal").withColumn("literal", F.col("name"))
    if skip_trivial:
        sites = sites.where(~E.trivial_literal("literal"))
    sites = sites.where(~F.coalesce(union_literal if union_literal is not None else F.col("is_union_literal"), F.lit(False)))
    return _star(sites, "literal", min_sites, min_files, F.format_string("literal %s at %d sites in %d files", "literal", "sites", "files"))


def meaning_edges(nodes: DataFrame, **options) -> DataFrame:
    return _raw(meaning_star(nodes, **options), "meaning")


def value_edges(nodes: DataFrame, min_files: int = K.VALUE_FILES) -> DataFrame:
    """Constants that hold one value in several files."""
    sites = nodes.where((F.col("kind") == "variable") & E.constant_name("name") & ~F.coalesce("mutable", F.lit(True)) & F.col("initial_value").isNotNull())
    return _raw(_star(sites, "initial_value", 2, min_files, F.format_string("constants hold %s in %d files", "initial_value", "files")), "value")


def identity_edges(nodes: DataFrame, names: DataFrame) -> DataFrame:
    """Name edges to mutable variables outside any function or class."""
    shared = nodes.where((F.col("kind") == "variable") & F.col("mutable") & E.module_level("scope_path")).select(F.col("id").alias("node_b"), F.col("name").alias("b_name"))
    hit = names.select("node_a", "node_b", (F.col("seq") % _STEP).alias("seq")).join(shared, "node_b")
    return _raw(hit.withColumn("evidence", F.format_string("shared mutable '%s' accessed from another place", "b_name")), "identity")


def type_edges(nodes: DataFrame, names: DataFrame) -> DataFrame:
    """Name edges across files whose ends have one type that isn't primitive."""
    ends = nodes.select("id", "file_path", E.normalize_type("type_name").alias("t"))
    a, b = _as(ends, "a", "id", "file_path", "t"), _as(ends, "b", "id", "file_path", "t")
    hit = names.select("node_a", "node_b", (F.col("seq") % _STEP).alias("seq")).join(a, F.col("node_a") == F.col("a_id")).join(b, F.col("node_b") == F.col("b_id"))
    hit = hit.where((F.col("a_t") == F.col("b_t")) & (F.col("a_file_path") != F.col("b_file_path")) & ~E.primitive_or_function_type("a_t"))
    return _raw(hit.withColumn("evidence", F.format_string("both ends have type %s", "a_t")), "type")


def detect(nodes: DataFrame, refs: DataFrame, with_types: bool = False) -> DataFrame:
    """All raw edges of a scan."""
    names = name_edges(nodes, refs)
    parts = [names, position_edges(nodes, names), algorithm_edges(nodes), meaning_edges(nodes), identity_edges(nodes, names), value_edges(nodes)]
    if with_types:
        parts.append(type_edges(nodes, names))
    out = parts[0]
    for p in parts[1:]:
        out = out.unionByName(p)
    return out
