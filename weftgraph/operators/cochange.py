"""Frequent co-change: pairs of files that change together, from history."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from weftgraph.functions import constants as K
from weftgraph.functions import exprs as E


def scope_commits(commits: DataFrame, globs: list[str] | None = None, ignores: list[str] | None = None, existing: DataFrame | None = None) -> DataFrame:
    """(sha, seq, file), a row for each file of each commit that is in scope and still exists."""
    rows = commits.select("sha", "seq", F.explode(F.array_distinct("files")).alias("file"))
    rows = rows.where(E.in_scope("file", globs or [], ignores or []))
    if existing is not None:
        rows = rows.join(existing.select(F.col("file_path").alias("file")).distinct(), "file", "left_semi")
    return rows


def cochange_pairs(items: DataFrame, min_support: int, min_ratio: float, max_items: int) -> DataFrame:
    """(a, b, support, ratio, last) over (sha, seq, file) rows: files seen together in min_support commits, and
    in min_ratio of those of the rarer one. Commits of more than max_items files don't count at all; that bounds
    a commit's pairs. seq 0 is the newest."""
    # Parted by commit once: what follows is within commits, until files are counted.
    rows = items.select("sha", "seq", "file").repartition("sha").distinct()
    sizes = rows.groupBy("sha").agg(F.count("*").alias("n")).where(F.col("n") <= max_items)
    rows = rows.join(sizes.select("sha"), "sha", "left_semi")
    # A pair isn't seen more often than its rarer file, so rare files leave before pairs are made.
    frequency = rows.groupBy("file").agg(F.count("*").alias("f")).where(F.col("f") >= min_support)
    rows = rows.join(frequency.select("file"), "file", "left_semi")
    # A commit's files are few now, so its pairs are made in its row.
    sets = rows.groupBy("sha").agg(F.min("seq").alias("seq"), F.array_sort(F.collect_list("file")).alias("files")).where(F.size("files") > 1)
    later = lambda a, i: F.transform(F.slice("files", i + 2, F.size("files")), lambda b: F.struct(a.alias("a"), b.alias("b")))
    pairs = sets.select("sha", "seq", F.explode(F.flatten(F.transform("files", later))).alias("p")).select("sha", "seq", "p.a", "p.b")
    pairs = pairs.groupBy("a", "b").agg(F.count("*").alias("support"), F.min_by("sha", F.struct("seq", "sha")).alias("last")).where(F.col("support") >= min_support)
    fa, fb = frequency.select(F.col("file").alias("a"), F.col("f").alias("fa")), frequency.select(F.col("file").alias("b"), F.col("f").alias("fb"))
    out = pairs.join(fa, "a").join(fb, "b").withColumn("ratio", F.col("support") / F.least("fa", "fb").cast("double"))
    return out.where(F.col("ratio") >= min_ratio).select("a", "b", "support", "ratio", "last")


def cochange_order() -> tuple:
    return F.desc("ratio"), F.desc("support"), F.asc("a"), F.asc("b")


def cochange(commits: DataFrame, min_support: int = K.COCHANGE["min_support"], min_ratio: float = K.COCHANGE["min_ratio"], max_files: int = K.COCHANGE["max_files"], max_commits: int = K.COCHANGE["max_commits"], **scope) -> DataFrame:
    """Of a commit table (sha, seq, files); support 0 turns it off."""
    if min_support == 0:
        return cochange_pairs(scope_commits(commits.limit(0)), 1, 0.0, 1)
    return cochange_pairs(scope_commits(commits.where(F.col("seq") < max_commits), **scope), min_support, min_ratio, max_files)


def segment_log(lines: DataFrame, marker: str) -> DataFrame:
    """(record, sha, files) of text lines (log, n, line): a line that begins with marker starts a record. The
    window runs within a log; keep logs to bounded histories."""
    w = Window.partitionBy("log").orderBy("n")
    rows = lines.withColumn("is_marker", F.col("line").startswith(marker)).withColumn("record", F.sum(F.col("is_marker").cast("long")).over(w) - 1)
    rows = rows.where((F.col("record") >= 0) & (F.trim("line") != ""))
    files = F.array_compact(F.transform(F.array_sort(F.collect_list(F.struct("n", F.when(~F.col("is_marker"), F.trim("line")).alias("file")))), lambda x: x["file"]))
    sha = F.max(F.when(F.col("is_marker"), F.trim(F.substring("line", len(marker) + 1, 1 << 20))))
    return rows.groupBy("log", "record").agg(sha.alias("sha"), files.alias("files"))
