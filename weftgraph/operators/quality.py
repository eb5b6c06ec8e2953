"""The seven quality axes and their score."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from weftgraph.functions import constants as K
from weftgraph.functions import exprs as E
from weftgraph.operators import modules as M
from weftgraph.operators.graph import Store, levelization, store


def gini(values: DataFrame, value: str = "value") -> DataFrame:
    """One row: gini, n, mean. Equal values share their ranks' sum, so only a row for each distinct value is
    ordered; that table is small where values are counts."""
    v = values.select(F.col(value).cast("double").alias("x")).where("x IS NOT NULL AND x >= 0 AND x < double('Infinity')")
    counts = v.groupBy("x").agg(F.count("*").alias("c"))
    w = Window.orderBy("x").rowsBetween(Window.unboundedPreceding, 0)
    ranked = counts.withColumn("upto", F.sum("c").over(w))
    # The ranks of c equal values that end at upto sum to c * (2 * upto - c + 1) / 2.
    s = ranked.agg(F.coalesce(F.sum("c"), F.lit(0)).alias("n"), F.coalesce(F.sum(F.col("x") * F.col("c")), F.lit(0.0)).alias("total"), F.coalesce(F.sum(F.col("x") * F.col("c") * (2 * F.col("upto") - F.col("c") + 1)), F.lit(0.0)).alias("r"))
    g = F.when((F.col("n") <= 1) | (F.col("total") == 0), F.lit(0.0)).otherwise(E.clamp01((F.col("r") - (F.col("n") + 1) * F.col("total")) / F.nullif(F.col("n") * F.col("total"), F.lit(0.0))))
    return s.select(g.alias("gini"), "n", F.when(F.col("n") == 0, F.lit(0.0)).otherwise(F.col("total") / F.greatest("n", F.lit(1))).alias("mean"))


def equality_axis(definitions: DataFrame, value: str = "definitions") -> DataFrame:
    return gini(definitions, value).select(E.round4((1 - F.col("gini")) * (1 / (1 + F.col("mean") / 10))).alias("value"))


def worst_decile(edges: DataFrame) -> DataFrame:
    """One row: value, 1 less the mean of the highest tenth of pressures (one at least). Pressures have four
    decimals, so at most ten thousand distinct ones are ordered."""
    counts = edges.groupBy("pressure").agg(F.count("*").alias("c"))
    total = counts.agg(F.sum("c").alias("n"))
    w = Window.orderBy(F.desc("pressure")).rowsBetween(Window.unboundedPreceding, -1)
    k = F.greatest(F.lit(1), F.ceil(F.col("n") * 0.1))
    rows = counts.withColumn("before", F.coalesce(F.sum("c").over(w), F.lit(0))).join(F.broadcast(total)).withColumn("k", k)
    taken = F.greatest(F.lit(0), F.least(F.col("c"), F.col("k") - F.col("before")))
    return rows.agg(F.when(F.count("*") == 0, F.lit(1.0)).otherwise(E.round4(1 - F.sum(F.col("pressure") * taken) / F.max("k"))).alias("value"))


def levelization_axis(summary: DataFrame) -> DataFrame:
    one = F.col("components") <= 1
    return summary.select(F.when(one, F.lit(1.0)).otherwise(E.round4(E.clamp01(1 - (F.col("depth") - 1) / F.greatest(F.col("components") - 1, F.lit(1))))).alias("value"))


def redundancy_axis(stats: DataFrame) -> DataFrame:
    return stats.select(F.when(F.col("hashable") == 0, F.lit(1.0)).otherwise(E.round4(1 - F.col("duplicates") / F.greatest("hashable", F.lit(1)))).alias("value"))


def acyclicity_axis(solved: DataFrame) -> DataFrame:
    return levelization(solved).select(F.when(F.col("cyclic"), F.lit(0.0)).otherwise(F.lit(1.0)).alias("value"))


def cohesion_axis(weight: DataFrame, member: DataFrame) -> DataFrame:
    a, b = member.select(F.col("module").alias("x"), F.col("file").alias("a")), member.select(F.col("module").alias("y"), F.col("file").alias("b"))
    rows = weight.join(a, "a", "left").join(b, "b", "left")
    total = F.sum("w")
    return rows.agg(F.when(F.coalesce(total, F.lit(0.0)) == 0, F.lit(1.0)).otherwise(E.round4(F.coalesce(F.sum(F.when(F.col("x") == F.col("y"), F.col("w"))), F.lit(0.0)) / F.nullif(total, F.lit(0.0)))).alias("value"))


def encapsulation_axis(depths: DataFrame) -> DataFrame:
    return depths.agg(F.coalesce(E.round4(F.avg("value")), F.lit(1.0)).alias("value"))


def quality_axes(edges: DataFrame, solved: DataFrame, definitions: DataFrame, stats: DataFrame, modules: DataFrame | None = None, keep: Store = store) -> DataFrame:
    """(key, value) of the seven axes, in order of n. Filters of reports don't touch the edges here. Weights and
    members are stored: they are read more than once, and where they are few, edges needn't be shuffled to meet them."""
    weight = keep(M.dependency_weight(edges), "weights")
    modules = M.module_levels(weight).where("level = 0").drop("level") if modules is None else modules
    member = keep(M.membership(modules), "members")
    axes = {
        "acyclicity": acyclicity_axis(solved),
        "levelization": levelization_axis(levelization(solved)),
        "encapsulation": encapsulation_axis(M.module_depth(edges, member)),
        "equality": equality_axis(definitions),
        "redundancy": redundancy_axis(stats),
        "cohesion": cohesion_axis(weight, member),
        "coupling": worst_decile(edges),
    }
    out = None
    for n, key in enumerate(K.AXES):
        row = axes[key].select(F.lit(n).alias("n"), F.lit(key).alias("key"), "value")
        out = row if out is None else out.unionByName(row)
    return out


def quality_score(axes: DataFrame, config_hash: str = "") -> DataFrame:
    """One row: score to 10000 by the geometric mean; an axis at 0 makes it 0."""
    product = F.aggregate(F.collect_list(F.greatest(F.lit(0.0), F.col("value"))), F.lit(1.0), lambda a, x: a * x)
    return axes.agg(F.floor(10000 * F.pow(product, 1.0 / len(K.AXES)) + 0.5).alias("score")).select("score", F.lit(K.SCORE_VERSION).alias("score_version"), F.lit(config_hash).alias("config_hash"))
