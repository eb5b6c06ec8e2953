"""Schemas of the base tables, as DDL."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

NODES = (
    "id string, seq bigint, kind string, name string, scope_path array<struct<kind:string,name:string>>, "
    "file_path string, start_line int, start_col int, end_line int, end_col int, parent_id string, "
    "structure_hash string, identity_hash string, owner_def_id string, mutable boolean, initial_value string, "
    "is_union_literal boolean, type_name string"
)
REFS = "ref_id string, def_id string"
RAW_EDGES = "node_a string, node_b string, ctype string, evidence string, resolved boolean, seq bigint"
_END = "{0}_id string, {0}_kind string, {0}_name string, {0}_file string, {0}_line int, {0}_owner string, {0}_identity string"
SCORED = f"{_END.format('a')}, {_END.format('b')}, ctype string, strength int, locality int, degree bigint, pressure double, evidence string, heuristic boolean, resolved boolean, seq bigint"
COMMITS = "sha string, seq bigint, files array<string>"


def columns(ddl: str) -> list[tuple[str, str]]:
    """(name, type) of flat DDL; types may hold commas in angle brackets."""
    out, depth, start = [], 0, 0
    for i, c in enumerate(ddl + ","):
        depth += (c == "<") - (c == ">")
        if c == "," and not depth:
            name, kind = ddl[start:i].strip().split(" ", 1)
            out.append((name, kind))
            start = i + 1
    return out


def conform(df: DataFrame, ddl: str) -> DataFrame:
    """df with exactly the columns of ddl: missing ones are null, further ones are left out."""
    return df.select(*(F.col(n).cast(t).alias(n) if n in df.columns else F.lit(None).cast(t).alias(n) for n, t in columns(ddl)))


def require(df: DataFrame, *names: str) -> DataFrame:
    missing = [n for n in names if n not in df.columns]
    if missing:
        raise ValueError(f"missing columns: {', '.join(missing)}")
    return df
