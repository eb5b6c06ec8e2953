"""Source code to node and reference tables.

An adapter gives ``IrTables`` from files. The one here reads Python by its own parser, a file to a row of
``mapInPandas``; anything else may give the tables itself. Names are resolved within a file and by import.
"""

from __future__ import annotations

import ast
import hashlib
from collections.abc import Iterator
from dataclasses import dataclass
from typing import Protocol

import pandas as pd
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from weftgraph.functions import exprs as E
from weftgraph.functions.schema import NODES, columns


@dataclass(frozen=True)
class IrTables:
    nodes: DataFrame
    refs: DataFrame


class SourceAdapter(Protocol):
    def to_ir(self, spark: SparkSession, files: DataFrame) -> IrTables:
        """Tables of files (file_path, text)."""


def read_files(spark: SparkSession, paths: str | list[str], globs: list[str] | None = None, ignores: list[str] | None = None, root: str = "") -> DataFrame:
    """(file_path, text) of whole files under paths."""
    text = spark.read.option("recursiveFileLookup", "true").text(paths, wholetext=True)
    path = F.regexp_replace(F.col("_metadata.file_path"), "^file:/+", "/")
    path = E.relative_path(path, root) if root else path
    return text.select(path.alias("file_path"), F.col("value").alias("text")).where(E.in_scope("file_path", globs or [], ignores or []))


class _Walk(ast.NodeVisitor):
    def __init__(self, path: str, text: str):
        self.path, self.rows, self.scopes, self.owners = path, [], [], []
        self.package = _dir_of(path)
        self.visit(ast.parse(text))

    def add(self, node: ast.AST, kind: str, name: str, parent: str | None = None, **facts) -> str:
        line, col = getattr(node, "lineno", 1), getattr(node, "col_offset", 0) + 1
        key = f"{self.path}|{kind}|{line}|{col}|{name}"
        id_ = hashlib.sha1(key.encode()).hexdigest()[:16]
        scope = [*reversed(self.scopes), {"kind": "module", "name": self.path}, {"kind": "package", "name": self.package}]
        self.rows.append(
            {"id": id_, "seq": len(self.rows), "kind": kind, "name": name, "scope_path": scope, "file_path": self.path, "start_line": line, "start_col": col, "end_line": getattr(node, "end_lineno", line), "end_col": getattr(node, "end_col_offset", 0) + 1, "parent_id": parent, "owner_def_id": self.owners[-1] if self.owners else None} | facts
        )
        return id_

    def _function(self, node) -> None:
        kinds = "/".join(type(x).__name__ for x in ast.walk(ast.Module(node.body, [])))
        inside = self.scopes and self.scopes[-1]["kind"] == "class"
        id_ = self.add(node, "method" if inside else "function", node.name, structure_hash=hashlib.sha1(kinds.encode()).hexdigest())
        for d in node.decorator_list:
            self.visit(d)
        self.scopes.append({"kind": "function", "name": node.name})
        self.owners.append(id_)
        every = [*node.args.posonlyargs, *node.args.args]
        for a in every[1:] if inside and every and every[0].arg in ("self", "cls") else every:
            self.add(a, "parameter", a.arg, id_, type_name=ast.unparse(a.annotation) if a.annotation else None)
        for x in node.body:
            self.visit(x)
        self.scopes.pop()
        self.owners.pop()

    visit_FunctionDef = visit_AsyncFunctionDef = _function

    def visit_ClassDef(self, node) -> None:
        id_ = self.add(node, "class", node.name)
        for x in (*node.bases, *node.decorator_list):
            self.visit(x)
        self.scopes.append({"kind": "class", "name": node.name})
        self.owners.append(id_)
        for x in node.body:
            self.visit(x)
        self.scopes.pop()
        self.owners.pop()

    def _assign(self, targets, value, annotation=None) -> None:
        for t in targets:
            if isinstance(t, ast.Name):
                literal = ast.unparse(value) if isinstance(value, ast.Constant) else None
                self.add(t, "variable", t.id, mutable=not t.id.isupper(), initial_value=literal, type_name=ast.unparse(annotation) if annotation else None)
            else:
                self.visit(t)
        if value is not None:
            self.visit(value)

    def visit_Assign(self, node) -> None:
        self._assign(node.targets, node.value)

    def visit_AnnAssign(self, node) -> None:
        self._assign([node.target], node.value, node.annotation)

    def visit_Call(self, node) -> None:
        ref = self.add(node.func, "reference", node.func.id) if isinstance(node.func, ast.Name) else None
        if ref is None:
            self.visit(node.func)
        call = self.add(node, "call", ast.unparse(node.func)[:80], ref)
        for i, a in enumerate(node.args):
            self.add(a, "argument", str(i), call)
        for x in (*node.args, *(k.value for k in node.keywords)):
            if isinstance(x, ast.Constant) and isinstance(x.value, str | int | float) and not isinstance(x.value, bool):
                self.add(x, "literal", ast.unparse(x), call, is_union_literal=False)
            else:
                self.visit(x)

    def visit_Import(self, node) -> None:
        for a in node.names:
            self.add(node, "import", a.asname or a.name.split(".")[0], initial_value=a.name)

    def visit_ImportFrom(self, node) -> None:
        for a in node.names:
            self.add(node, "import", a.asname or a.name, initial_value=f"{node.module or ''}:{a.name}")

    def visit_Name(self, node) -> None:
        if isinstance(node.ctx, ast.Load):
            self.add(node, "reference", node.id)


def _dir_of(path: str) -> str:
    return path.rpartition("/")[0] or "."


_FIELDS = [n for n, _ in columns(NODES)]


def _parse(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    for pdf in batches:
        rows: list[dict] = []
        for path, text in zip(pdf["file_path"], pdf["text"]):
            try:
                rows += _Walk(path, text or "").rows
            except (SyntaxError, ValueError, RecursionError):
                continue  # a file that doesn't parse has no nodes
        yield pd.DataFrame([{f: r.get(f) for f in _FIELDS} for r in rows], columns=_FIELDS).astype({"mutable": object, "is_union_literal": object})


class PythonAdapter:
    """Definitions, calls and references of Python files."""

    def to_ir(self, spark: SparkSession, files: DataFrame) -> IrTables:
        parsed = files.select("file_path", "text").mapInPandas(_parse, NODES)
        # Emission order over all files, without a global sort: the file's hash leads.
        nodes = parsed.withColumn("seq", F.shiftrightunsigned(F.xxhash64("file_path"), 24) * (1 << 16) + F.col("seq"))
        return IrTables(with_identities(nodes, resolve(nodes)), resolve(nodes))


def resolve(nodes: DataFrame) -> DataFrame:
    """(ref_id, def_id): a name's definition in its file, else what an import of that name brings from the file of
    that module. The last of several definitions in a file counts."""
    defined = nodes.where(F.col("kind").isin("function", "class", "variable")).groupBy("file_path", "name").agg(F.max_by("id", F.struct("seq", "id")).alias("def_id"))
    refs = nodes.where("kind = 'reference'").select(F.col("id").alias("ref_id"), "file_path", "name")
    local = refs.join(defined, ["file_path", "name"], "left")
    imports = nodes.where("kind = 'import' AND initial_value LIKE '%:%'").select("file_path", "name", F.split("initial_value", ":")[0].alias("module"), F.split("initial_value", ":")[1].alias("target")).dropDuplicates(["file_path", "name"])
    # A module's file may lie under any folder: its last two parts are compared.
    tail = lambda c: F.array_join(F.slice(F.reverse(F.split(c, "[./]")), 1, 1), "/")
    stem = F.regexp_replace("file_path", r"(/__init__)?\.py$", "")
    target = defined.select(tail(stem).alias("tail"), F.regexp_replace(stem, "/", ".").alias("dotted"), F.col("name").alias("target"), F.col("def_id").alias("far_id"))
    far = imports.withColumn("tail", tail(F.col("module"))).join(target, ["tail", "target"]).where(F.concat(F.lit("."), "dotted").endswith(F.concat(F.lit("."), F.ltrim(F.col("module"), F.lit(".")))))
    far = far.groupBy("file_path", "name").agg(F.min("far_id").alias("far_id"))
    out = local.join(far, ["file_path", "name"], "left").select("ref_id", F.coalesce("def_id", "far_id").alias("def_id"))
    return out.where(F.col("def_id").isNotNull())


def with_identities(nodes: DataFrame, refs: DataFrame) -> DataFrame:
    """Identities that outlive renames of files and moves: definitions by structure, nulled where several share one;
    then parameters, arguments, references and literals by their owner's."""
    defs = nodes.where(F.col("structure_hash").isNotNull())
    # Counted by an aggregate, so that a hot structure is combined before it is shuffled.
    once = defs.groupBy("structure_hash").agg(F.count("*").alias("n")).where("n = 1").select("structure_hash", F.col("structure_hash").alias("own"))
    base = nodes.drop("identity_hash").join(once, "structure_hash", "left")
    owner = base.where(F.col("own").isNotNull()).select(F.col("id").alias("o_id"), F.col("own").alias("o_hash"))
    # Only parameters and arguments are numbered, so the window's groups are a function's or a call's few.
    slot = F.row_number().over(Window.partitionBy("parent_id", "kind").orderBy("start_line", "start_col", "seq")) - 1
    placed = nodes.where(F.col("kind").isin("parameter", "argument")).select(F.col("id").alias("s_id"), slot.alias("_slot"))
    rows = base.join(placed, base["id"] == placed["s_id"], "left").drop("s_id")
    calls = nodes.where("kind = 'call'").select(F.col("id").alias("c_id"), F.col("parent_id").alias("ref_id")).join(refs, "ref_id").join(owner.select(F.col("o_id").alias("def_id"), F.col("o_hash").alias("callee")), "def_id").select("c_id", "callee")
    rows = rows.join(owner, F.when(F.col("kind") == "parameter", F.col("parent_id")).otherwise(F.col("owner_def_id")) == F.col("o_id"), "left").join(calls, F.col("parent_id") == F.col("c_id"), "left")
    text = F.col("_slot").cast("string")
    identity = (
        F.when(F.col("own").isNotNull(), F.col("own"))
        .when(F.col("kind") == "parameter", F.concat("o_hash", F.lit("#p"), text))
        .when(F.col("kind") == "argument", F.concat("callee", F.lit("#a"), text))
        .when(F.col("kind") == "reference", F.concat(F.lit("ref@"), "o_hash"))
        .when(F.col("kind") == "literal", F.concat(F.coalesce("o_hash", "file_path"), F.lit("#lit:"), "name"))
    )
    return rows.withColumn("identity_hash", identity).select(*_FIELDS)
