"""Scored edges and what is counted over them."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from weftgraph.functions import constants as K
from weftgraph.functions import exprs as E
from weftgraph.functions.schema import SCORED, conform



def edge_order() -> tuple:
    """Most pressing first; emission order decides ties."""
    return F.desc("pressure"), F.desc("strength"), F.desc("locality"), F.desc("degree"), F.asc("seq"), F.asc("a_id"), F.asc("b_id")


def rank_struct():
    """Smaller is earlier in edge_order, for min_by."""
    return F.struct(-F.coalesce("pressure", F.lit(0.0)), -F.col("strength"), -F.col("locality"), -F.col("degree"), F.col("seq"), F.col("a_id"), F.col("b_id"))


def degrees(edges: DataFrame, a: str = "node_a", b: str = "node_b") -> DataFrame:
    """(ctype, node, degree): how often a node ends an edge of a type; a loop counts twice."""
    return edges.select("ctype", F.explode(F.array(a, b)).alias("node")).groupBy("ctype", "node").agg(F.count("*").alias("degree"))


def _ends(nodes: DataFrame, degree: DataFrame | None) -> DataFrame:
    """A row for each node that ends an edge (without degree: for each node): what edges need of it, its scopes as
    keys and ranks, and its degree by type."""
    scope = F.col("scope_path")
    ends = nodes.select(F.col("id").alias("known"), "kind", "name", F.col("file_path").alias("file"), F.col("start_line").alias("line"), F.col("identity_hash").alias("identity"), E.scope_keys(scope).alias("keys"), E.scope_ranks(scope).alias("ranks"), E.owner_name(scope).alias("owner"))
    if degree is None:
        return ends.withColumns({"node": F.col("known"), "by": F.lit(None).cast("map<string,bigint>")})
    # A node has as many entries as there are types.
    by = degree.where("node IS NOT NULL AND ctype IS NOT NULL").groupBy("node").agg(F.map_from_entries(F.collect_list(F.struct("ctype", "degree"))).alias("by"))
    return by.join(ends, F.col("node") == F.col("known"), "left")


def score_edges(nodes: DataFrame, raw: DataFrame, degree: bool = True) -> DataFrame:
    """Raw edges with both ends, strength, locality, the lesser degree and pressure. Edges are joined once for each
    end, to its attributes and degrees together; edges that are partitioned by node_a stay there for the first.
    Without ``degree``, that and pressure are null, which saves counting over all edges."""
    ends = _ends(nodes, degrees(raw) if degree else None)
    out = raw
    for p in "ab":
        e = ends.select(*(F.col(c).alias(f"_{p}_{c}") for c in ends.columns))
        out = out.join(e, F.col(f"node_{p}") == F.col(f"_{p}_node"), "left")
        kept = [c for c in out.columns if not c.startswith(f"_{p}_")]
        of = lambda c, p=p: F.col(f"_{p}_{c}")
        out = out.select(
            *kept, F.col(f"node_{p}").alias(f"{p}_id"), F.coalesce(of("name"), f"node_{p}").alias(f"{p}_name"), F.coalesce(of("kind"), F.lit("unknown")).alias(f"{p}_kind"), F.coalesce(of("file"), F.lit("?")).alias(f"{p}_file"),
            F.coalesce(of("line"), F.lit(0)).alias(f"{p}_line"), of("owner").alias(f"{p}_owner"), of("identity").alias(f"{p}_identity"), of("known").isNotNull().alias(f"{p}_known"), of("keys").alias(f"{p}_keys"),
            *([of("ranks").alias("b_ranks")] if p == "b" else []), F.coalesce(F.element_at(of("by"), F.col("ctype")), F.lit(0).cast("long")).alias(f"{p}_degree"),
        )
    out = out.withColumns(
        {
            "strength": E.strength_of("ctype"),
            "locality": F.when(~F.col("a_known") | ~F.col("b_known"), F.lit(K.MISSING_ENDPOINT)).otherwise(E.locality_of_keys("a_keys", "b_keys", "b_ranks")),
            "degree": F.least("a_degree", "b_degree") if degree else F.lit(None).cast("long"),
            "heuristic": E.is_heuristic("ctype"),
        }
    )
    pressure = E.pressure_of("strength", "locality", "degree") if degree else F.lit(None).cast("double")
    return conform(out.withColumn("pressure", pressure), SCORED)


def summary(edges: DataFrame) -> DataFrame:
    return edges.groupBy("ctype").agg(F.count("*").alias("edges"))


def pressure_summary(edges: DataFrame) -> DataFrame:
    """One row: n, total, mean and most; the mean divides the rounded total."""
    out = edges.agg(F.count("*").alias("edges"), E.round4(F.coalesce(F.sum("pressure"), F.lit(0.0))).alias("total"), F.coalesce(F.max("pressure"), F.lit(0.0)).alias("most"))
    return out.withColumn("mean", F.when(F.col("edges") == 0, F.lit(0.0)).otherwise(E.round4(F.col("total") / F.greatest(F.col("edges"), F.lit(1)))))


def pressure_by_type(edges: DataFrame) -> DataFrame:
    return edges.groupBy("ctype").agg(E.round4(F.sum("pressure")).alias("pressure"))


def definitions_by_file(nodes: DataFrame) -> DataFrame:
    """(file_path, definitions) of every file, those without definitions too."""
    defined = F.col("kind").isin("function", "method", "class", "variable")
    return nodes.groupBy("file_path").agg(F.count_if(defined).alias("definitions"))


def project_stats(nodes: DataFrame) -> DataFrame:
    """One row: files, definitions, hashable nodes, and how many of these repeat a structure."""
    shapes = nodes.where(F.col("structure_hash").isNotNull()).groupBy("structure_hash").agg(F.count("*").alias("n"))
    shapes = shapes.agg(F.coalesce(F.sum("n"), F.lit(0)).alias("hashable"), F.coalesce(F.sum(F.when(F.col("n") > 1, F.col("n") - 1)), F.lit(0)).alias("duplicates"))
    files = definitions_by_file(nodes).agg(F.count("*").alias("files"), F.coalesce(F.sum("definitions"), F.lit(0)).alias("definitions"))
    return files.crossJoin(shapes)  # one row each


def file_hotspots(edges: DataFrame) -> DataFrame:
    """(file, edges, max_degree, worst_strength, pressure); an edge within a file counts twice there."""
    ends = edges.select(F.explode(F.array("a_file", "b_file")).alias("file"), "degree", "strength", "pressure")
    return ends.groupBy("file").agg(F.count("*").alias("edges"), F.max("degree").alias("max_degree"), F.max("strength").alias("worst_strength"), E.round4(F.coalesce(F.sum("pressure"), F.lit(0.0))).alias("pressure"))


def hotspot_order() -> tuple:
    return F.desc("pressure"), F.desc("edges"), F.desc("worst_strength"), F.asc("file")


def edge_counts(edges: DataFrame) -> DataFrame:
    """(file, edges) for short reports."""
    return edges.select(F.explode(F.array("a_file", "b_file")).alias("file")).groupBy("file").agg(F.count("*").alias("edges"))


def filter_edges(edges: DataFrame, min_strength: int = 0, types: list[str] | None = None, min_degree: int = 0, path: str | None = None) -> DataFrame:
    """The filters of reports: none of them recomputes anything."""
    out = edges.where((F.col("strength") >= min_strength) & (F.col("degree") >= min_degree))
    if types:
        out = out.where(F.col("ctype").isin(*types))
    if path:
        out = out.where(F.lower("a_file").contains(path.lower()) | F.lower("b_file").contains(path.lower()))
    return out


def explain_at(edges: DataFrame, at: str) -> DataFrame:
    """Edges with an end at ``path:line``; paths match by suffix, either way, case aside."""
    path, line = E.file_line(at)
    p = F.lit(path.replace("\\", "/").lower())
    hit = lambda e: (F.lower(E.to_posix(f"{e}_file")).endswith(p) | p.endswith(F.lower(E.to_posix(f"{e}_file")))) & (F.col(f"{e}_line") == line)
    return edges.where(hit("a") | hit("b"))
