"""The star-schema and text tables seen as nodes, edges and histories."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def brand_baskets(spark: SparkSession, d: str) -> DataFrame:
    """Orders as commits, the brands of their parts as files; the newest order has seq 0 in effect (-orderkey)."""
    parts = table(spark, d, "part").select(F.col("p_partkey").alias("l_partkey"), F.col("p_brand").alias("file"))
    lines = table(spark, d, "lineitem").select("l_orderkey", "l_partkey")
    return lines.join(parts, "l_partkey").select(F.col("l_orderkey").alias("sha"), (-F.col("l_orderkey")).alias("seq"), "file")


def text_lines(spark: SparkSession, d: str) -> DataFrame:
    """(doc_id, n, line) of documents."""
    docs = table(spark, d, "documents").select("doc_id", F.coalesce("text", F.lit("")).alias("text"))
    return docs.select("doc_id", F.posexplode(F.split("text", "\n")).alias("n", "line"))


def line_baskets(spark: SparkSession, d: str) -> DataFrame:
    return text_lines(spark, d).where(F.length("line") >= 2).select(F.col("doc_id").alias("sha"), F.col("doc_id").alias("seq"), F.col("line").alias("file"))


def document_nodes(spark: SparkSession, d: str, shape: bool = False) -> DataFrame:
    """Documents as definitions with a structure; with shape, runs of letters and digits count alike."""
    text = F.coalesce("text", F.lit(""))
    body = F.regexp_replace(F.regexp_replace(text, r"\p{L}+", "w"), "[0-9]+", "0") if shape else text
    docs = table(spark, d, "documents")
    return docs.select(
        F.col("doc_id").cast("string").alias("id"), F.col("doc_id").alias("seq"), F.lit("function").alias("kind"), F.concat(F.lit("d"), F.col("doc_id").cast("string")).alias("name"),
        F.col("source").alias("file_path"), F.lit(1).alias("start_line"), F.size(F.split(text, "\n")).alias("end_line"), F.sha1(body.cast("binary")).alias("structure_hash"),
    )


def line_nodes(spark: SparkSession, d: str) -> DataFrame:
    """Lines as literals, their documents as files."""
    rows = text_lines(spark, d)
    key = F.col("doc_id") * 1_000_000 + F.col("n")
    return rows.select(key.cast("string").alias("id"), key.alias("seq"), F.lit("literal").alias("kind"), F.col("line").alias("name"), F.col("doc_id").cast("string").alias("file_path"), F.lit(False).alias("is_union_literal"))


def price_nodes(spark: SparkSession, d: str) -> DataFrame:
    """Parts as constants that hold their price, their brands as files."""
    p = table(spark, d, "part")
    return p.select(
        F.col("p_partkey").cast("string").alias("id"), F.col("p_partkey").alias("seq"), F.lit("variable").alias("kind"), F.concat(F.lit("P"), F.col("p_partkey").cast("string")).alias("name"),
        F.col("p_brand").alias("file_path"), F.lit(False).alias("mutable"), F.format_string("%.2f", "p_retailprice").alias("initial_value"),
    )


def _scope(nation: str, region: str):
    return F.array(F.struct(F.lit("module").alias("kind"), F.col(nation).alias("name")), F.struct(F.lit("package").alias("kind"), F.col(region).alias("name")))


def party_nodes(spark: SparkSession, d: str) -> DataFrame:
    """Customers and suppliers, in scopes nation (module) and region (package)."""
    n = table(spark, d, "nation").select("n_nationkey", "n_name", "n_regionkey").join(table(spark, d, "region").select(F.col("r_regionkey").alias("n_regionkey"), "r_name"), "n_regionkey")
    c = table(spark, d, "customer").select(F.concat(F.lit("c"), F.col("c_custkey").cast("string")).alias("id"), F.col("c_custkey").alias("seq"), F.col("c_name").alias("name"), F.col("c_nationkey").alias("n_nationkey"), (F.col("c_acctbal") < 0).alias("mutable"))
    s = table(spark, d, "supplier").select(F.concat(F.lit("s"), F.col("s_suppkey").cast("string")).alias("id"), F.col("s_suppkey").alias("seq"), F.col("s_name").alias("name"), F.col("s_nationkey").alias("n_nationkey"), F.lit(False).alias("mutable"))
    both = c.unionByName(s).join(n, "n_nationkey")
    return both.select("id", "seq", F.lit("variable").alias("kind"), "name", _scope("n_name", "r_name").alias("scope_path"), F.col("n_name").alias("file_path"), F.lit(1).alias("start_line"), F.lit(None).cast("string").alias("identity_hash"), "mutable")


def supply_edges(spark: SparkSession, d: str) -> DataFrame:
    """Raw edges: each customer and each supplier of its orders, once. Lines are parted by customer alone, so its edges
    lie together when they are counted and joined."""
    o = table(spark, d, "orders").select(F.col("o_orderkey").alias("l_orderkey"), "o_custkey", "o_orderdate")
    pairs = table(spark, d, "lineitem").select("l_orderkey", "l_suppkey").join(o, "l_orderkey")
    pairs = pairs.select(F.concat(F.lit("c"), F.col("o_custkey").cast("string")).alias("node_a"), "l_suppkey", "o_orderdate").repartition("node_a")
    keys = pairs.groupBy("node_a", "l_suppkey").agg(F.min("o_orderdate").alias("first"), F.max("o_orderdate").alias("last"))
    return keys.select(
        "node_a", F.concat(F.lit("s"), F.col("l_suppkey").cast("string")).alias("node_b"), F.lit("name").alias("ctype"),
        F.lit("").alias("evidence"), F.lit(True).alias("resolved"), (F.substring("node_a", 2, 20).cast("long") * 1_000_000 + F.col("l_suppkey")).alias("seq"), "first", "last",
    )


def nation_couplings(spark: SparkSession, d: str) -> DataFrame:
    """(src, dst, edges, weight): customer nation to supplier nation, by lines and quantity."""
    c = table(spark, d, "customer").select(F.col("c_custkey").alias("o_custkey"), F.col("c_nationkey").alias("src"))
    s = table(spark, d, "supplier").select(F.col("s_suppkey").alias("l_suppkey"), F.col("s_nationkey").alias("dst"))
    # Orders take their nation before they meet the lines, which are more.
    o = table(spark, d, "orders").select(F.col("o_orderkey").alias("l_orderkey"), "o_custkey").join(c, "o_custkey").select("l_orderkey", "src")
    lines = table(spark, d, "lineitem").select("l_orderkey", "l_suppkey", "l_quantity").join(o, "l_orderkey").join(s, "l_suppkey")
    return lines.groupBy("src", "dst").agg(F.count("*").alias("edges"), F.sum(F.col("l_quantity").cast("long")).alias("weight"))


def nation_graph(spark: SparkSession, d: str) -> DataFrame:
    """(src, dst): each customer nation and the other supplier nation that it has most lines with. The window is
    over pairs of nations."""
    w = Window.partitionBy("src").orderBy(F.desc("edges"), F.asc("dst"))
    return nation_couplings(spark, d).where("src <> dst").withColumn("r", F.row_number().over(w)).where("r = 1").select(F.lpad(F.col("src").cast("string"), 2, "0").alias("src"), F.lpad(F.col("dst").cast("string"), 2, "0").alias("dst"))


def scored_supply(spark: SparkSession, d: str, degree: bool = True) -> DataFrame:
    from weftgraph.operators.scoring import score_edges

    return score_edges(party_nodes(spark, d), supply_edges(spark, d), degree)
