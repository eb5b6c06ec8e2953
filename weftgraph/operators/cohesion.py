"""Cohesion of directories, and files that hold several concerns."""

from __future__ import annotations

import math

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from weftgraph.functions import constants as K
from weftgraph.functions import exprs as E
from weftgraph.operators.components import connected_components
from weftgraph.operators.graph import Store, store
from weftgraph.operators.modules import dependencies


#: Sets that hold a neighbour are paired in blocks of about the square of so many pairs.
PAIR_BLOCK = 1000
#: Members of a set stand together in chunks of about so many, so that no unit of work is a whole large set.
CHUNK = 256
#: Pairs make tasks of about so many rows. Their number follows from the rows, as their bytes say little: a set of
#: members is a few bytes a member, and its pairs are the square.
TASK_ROWS = 2_000_000


def _tasks(rows: int | None) -> int:
    return max(1, -(-int(rows or 0) // TASK_ROWS))


def _shared_links(links: DataFrame, least: int) -> DataFrame:
    """Distinct links without those that no pair can share: of neighbours with one member, and of members with
    fewer neighbours than least after that. Neighbours become their SHA-1, as they may be long."""
    # Without nulls, which pair with nothing: else the joins' own filters make two plans of links, and both read all.
    links = links.where("grp IS NOT NULL AND member IS NOT NULL AND neighbour IS NOT NULL")
    links = links.select("grp", "member", F.unhex(F.sha1(F.col("neighbour").cast("string"))).alias("neighbour")).distinct()
    common = links.groupBy("grp", "neighbour").agg(F.count("*").alias("n")).where("n > 1")
    links = links.join(common.select("grp", "neighbour"), ["grp", "neighbour"], "left_semi")
    wide = links.groupBy("grp", "member").agg(F.count("*").alias("n")).where(F.col("n") >= least)
    return links.join(wide.select("grp", "member"), ["grp", "member"], "left_semi")


def _set_pairs(reps: DataFrame, least: int, keep: Store) -> DataFrame:
    """(a, b, m_a, m_b, shared) of two sets of reps (id, m, grp, hood) that share so many neighbours; m_a <= m_b. Sets
    that share a neighbour are counted, but where it is the commonest of both: two sets that share two share
    another one, and that one is added at the end. So a neighbour that most sets hold makes few rows."""
    ends = reps.select("id", "m", "grp", F.explode("hood").alias("neighbour"))
    common = ends.groupBy("grp", "neighbour").agg(F.count("*").alias("n")).where("n > 1").withColumn("line", F.monotonically_increasing_id())
    hoods = ends.join(keep(common, "neighbours"), ["grp", "neighbour"]).groupBy("id", "m").agg(F.array_sort(F.collect_list(F.struct("n", "line"))).alias("hood")).where(F.size("hood") >= least)
    last = F.element_at("hood", -1)["line"] if least > 1 else F.lit(None).cast("long")
    ends = hoods.select("id", "m", last.alias("last"), F.explode("hood").alias("x")).select("id", "m", "last", F.col("x.line").alias("line"))
    ends = keep(ends.withColumn("is_last", F.coalesce(F.col("line") == F.col("last"), F.lit(False))), "ends")
    blocks = ends.groupBy("line").agg(F.count("*").alias("n"), F.count_if(~F.col("is_last")).alias("k")).where("n > 1 AND k > 0")
    blocks = keep(blocks.withColumn("blocks", F.least("k", F.ceil(F.col("k") * F.col("n") / (PAIR_BLOCK * PAIR_BLOCK)))), "blocks")
    tasks = _tasks(blocks.agg(F.sum(F.expr("k * (n - k) + k * (k - 1) / 2 + k + n * blocks"))).first()[0])
    blocks = blocks.select("line", "blocks")
    left = ends.where(~F.col("is_last")).join(blocks, "line").select("line", F.pmod(F.xxhash64("id"), "blocks").alias("block"), F.col("id").alias("x"), F.col("m").alias("m_x"), F.col("last").alias("last_x"))
    right = ends.join(blocks, "line").select("line", F.explode(F.sequence(F.lit(0).cast("long"), F.col("blocks") - 1)).alias("block"), F.col("id").alias("y"), F.col("m").alias("m_y"), F.col("last").alias("last_y"), "is_last")
    made = left.repartition(tasks, "line", "block").join(right.repartition(tasks, "line", "block"), ["line", "block"]).where("is_last OR x < y")
    first = F.expr("m_x < m_y OR (m_x = m_y AND x < y)")
    ordered = [F.when(first, p).otherwise(q).alias(name) for name, p, q in (("a", F.col("x"), F.col("y")), ("b", F.col("y"), F.col("x")), ("m_a", F.col("m_x"), F.col("m_y")), ("m_b", F.col("m_y"), F.col("m_x")))]
    made = made.select(*ordered, F.coalesce(F.col("last_x") == F.col("last_y"), F.lit(False)).alias("same")).repartition(tasks, "a", "b")
    shared = made.groupBy("a", "b", "m_a", "m_b").agg((F.count("*") + F.max("same").cast("long")).alias("shared"))
    return keep(shared.where(F.col("shared") >= least), "pairs")


def shared_pairs(links: DataFrame, least: int = K.SHARED_NEIGHBOURS, keep: Store = store) -> DataFrame:
    """(grp, a, b, shared) members of a group that share so many neighbours (grp, member, neighbour). Members with
    equal neighbours stand as one set, so neighbours are compared once for each two sets, and pairs of sets are
    spread to their members at the end: chunks of members meet, and what meets one chunk is parted among tasks by
    the other, so tasks grow in number with the rows, and not in size."""
    sets = _shared_links(links, least).groupBy("grp", "member").agg(F.array_sort(F.collect_list("neighbour")).alias("hood"))
    sets = keep(sets, "neighbourhoods")
    reps = keep(sets.groupBy("grp", "hood").agg(F.count("*").alias("m")).withColumn("id", F.monotonically_increasing_id()), "sets")
    count = lambda m: F.ceil(F.col(m) / CHUNK)
    chunks = sets.join(reps, ["grp", "hood"]).select("grp", "id", "m", F.pmod(F.xxhash64("member"), count("m")).alias("chunk"), "member")
    chunks = keep(chunks.groupBy("grp", "id", "m", "chunk").agg(F.collect_list("member").alias("members")), "members")

    pairs = _set_pairs(reps, least, keep)
    alone = reps.where("m > 1").select(F.col("id").alias("a"), F.col("id").alias("b"), F.col("m").alias("m_a"), F.col("m").alias("m_b"), F.size("hood").cast("long").alias("shared"))
    pairs = pairs.unionByName(alone)
    tasks = _tasks(pairs.agg(F.sum(F.expr("m_a * m_b"))).first()[0])
    wide = math.isqrt(tasks - 1) + 1
    parts = lambda m: F.ceil(F.least(F.col(m), F.lit(CHUNK)) * wide / CHUNK)
    upto = lambda n: F.explode(F.sequence(F.lit(0).cast("long"), n - 1))
    units = pairs.withColumn("chunk_a", upto(count("m_a"))).withColumn("chunk_b", upto(count("m_b"))).where("a <> b OR chunk_a <= chunk_b")
    units = units.select("a", "b", "chunk_a", "chunk_b", "shared", F.pmod(F.xxhash64("b", "chunk_b"), parts("m_a")).alias("part_a"), F.pmod(F.xxhash64("a", "chunk_a"), parts("m_b")).alias("part_b"))
    side = chunks.withColumn("part", upto(parts("m")))
    small = side.select("grp", F.col("id").alias("a"), F.col("chunk").alias("chunk_a"), F.col("part").alias("part_a"), F.col("members").alias("ms"))
    large = side.select(F.col("id").alias("b"), F.col("chunk").alias("chunk_b"), F.col("part").alias("part_b"), F.col("members").alias("ns"))
    on_a, on_b = ["a", "chunk_a", "part_a"], ["b", "chunk_b", "part_b"]
    # Numbers of partitions that are asked for stay; adaptive execution would merge them by their bytes.
    out = units.repartition(tasks, *on_a).join(small.repartition(tasks, *on_a), on_a)
    out = out.repartition(tasks, *on_b).join(large.repartition(tasks, *on_b), on_b)
    out = out.select("grp", "shared", F.expr("a = b AND chunk_a = chunk_b").alias("within"), "ns", F.explode("ms").alias("m")).select("grp", "shared", "within", "m", F.explode("ns").alias("n"))
    return out.where("NOT within OR m < n").select("grp", F.least("m", "n").alias("a"), F.greatest("m", "n").alias("b"), "shared")


def shared_components(links: DataFrame, keep: Store = store) -> DataFrame:
    """(grp, a, b) edges that connect the same members as shared_pairs with two neighbours: each two neighbours of a
    member lead to the smallest member that has both. Rows grow with the neighbours of a member, not with its peers."""
    hoods = _shared_links(links, 2).groupBy("grp", "member").agg(F.array_sort(F.collect_list("neighbour")).alias("hood"))
    hoods = keep(hoods, "neighbourhoods")
    # Members with equal neighbours lead to one of them, which stands for all.
    reps = keep(hoods.groupBy("grp", "hood").agg(F.min("member").alias("rep")), "sets")
    equal = hoods.join(reps, ["grp", "hood"]).select("grp", F.col("rep").alias("a"), F.col("member").alias("b"))
    firsts = reps.select("grp", "rep", "hood", F.posexplode("hood").alias("at", "x"))
    twos = firsts.select("grp", "rep", "x", F.explode(F.slice("hood", F.col("at") + 2, F.size("hood"))).alias("y"))
    least = twos.groupBy("grp", "x", "y").agg(F.min("rep").alias("a"), F.count("*").alias("n")).where("n > 1").drop("n")
    star = twos.join(least, ["grp", "x", "y"]).select("grp", "a", F.col("rep").alias("b"))
    return equal.unionByName(star).where("a <> b").distinct()


def _file_groups(dep: DataFrame, files: DataFrame, dirs: DataFrame, keep: Store) -> DataFrame:
    """(dir, clusters): the groups of files of each of dirs (dir), largest first."""
    inner = dep.where("a_dir = b_dir").join(dirs.select(F.col("dir").alias("a_dir")), "a_dir", "left_semi")
    across = dep.where("a_dir <> b_dir")
    # Counted apart: neighbours used, and neighbours that use.
    links = across.select(F.col("a_dir").alias("grp"), F.col("a_file").alias("member"), F.concat(F.lit(">"), "b_file").alias("neighbour")).union(across.select(F.col("b_dir"), F.col("b_file"), F.concat(F.lit("<"), "a_file")))
    links = links.join(dirs.select(F.col("dir").alias("grp")), "grp", "left_semi")
    joined = inner.select(F.col("a_file").alias("a"), F.col("b_file").alias("b")).union(shared_pairs(links, keep=keep).select("a", "b"))
    group = connected_components(joined, keep).select(F.col("node").alias("file"), "component")
    grouped = files.join(dirs.select("dir"), "dir", "left_semi").join(group, "file", "left").withColumn("component", F.coalesce("component", "file"))
    parts = grouped.groupBy("dir", "component").agg(F.array_sort(F.collect_list("file")).alias("files"))
    return parts.groupBy("dir").agg(F.transform(F.array_sort(F.collect_list(F.struct((-F.size("files")).alias("n"), "files"))), lambda x: x["files"]).alias("clusters"))


def dir_cohesion(edges: DataFrame, keep: Store = store, clusters: bool = True) -> DataFrame:
    """(dir, files, internal_edges, external_edges, external_fan_in, clusters): directories of three files or more
    that three others reach into or that hold two real groups. Files are grouped by direct edges and by two
    common neighbours outside, out or in. Without ``clusters`` the rows are the same, but that column is null where
    enough others reach in: the groups are found only where they decide whether a directory is returned."""
    dep = dependencies(edges).select("a_file", "b_file", E.dir_of("a_file").alias("a_dir"), E.dir_of("b_file").alias("b_dir"))
    dep = keep(dep, "dependencies")
    files = dep.select(F.explode(F.array(F.struct(F.col("a_dir").alias("dir"), F.col("a_file").alias("file")), F.struct(F.col("b_dir").alias("dir"), F.col("b_file").alias("file")))).alias("x")).select("x.*").distinct()
    sizes = files.groupBy("dir").agg(F.count("*").alias("files")).where(F.col("files") >= K.DIR_FILES)
    flows = dep.groupBy("a_dir", "b_dir").agg(F.count("*").alias("n"))
    outside = flows.where("a_dir <> b_dir").groupBy(F.col("b_dir").alias("dir")).agg(F.sum("n").alias("external_edges"), F.count("*").alias("external_fan_in"))
    within = flows.where("a_dir = b_dir").select(F.col("a_dir").alias("dir"), F.col("n").alias("internal_edges"))
    counts = sizes.join(within, "dir", "left").join(outside, "dir", "left").na.fill(0, ["internal_edges", "external_edges", "external_fan_in"])
    counts = keep(counts, "directories")
    reached = F.col("external_fan_in") >= K.DIR_FAN_IN
    dirs = (counts if clusters else counts.where(~reached)).select("dir")
    if dirs.isEmpty():
        return counts.where(reached).withColumn("clusters", F.lit(None).cast("array<array<string>>"))
    out = counts.join(_file_groups(dep, files, dirs, keep), "dir", "left")
    real = F.size(F.filter("clusters", lambda c: F.size(c) >= 2))
    return out.where(reached | (real >= K.DIR_CLUSTERS)).select("dir", "files", "internal_edges", "external_edges", "external_fan_in", "clusters")


def file_splits(edges: DataFrame, keep: Store = store) -> DataFrame:
    """(file, groups of (start_line, name)): files of six functions or more whose calls part into two groups or
    more of two members. A caller is the last definition of its name in its file."""
    dep = keep(dependencies(edges), "dependencies")
    defs = dep.where(F.col("b_kind").isin("function", "method", "variable")).select(F.col("b_id").alias("id"), F.col("b_name").alias("name"), F.col("b_line").alias("line"), F.col("b_file").alias("file"), "seq")
    defs = defs.groupBy("id").agg(F.max_by(F.struct("name", "line", "file"), "seq").alias("x"), F.min("seq").alias("seq")).select("id", "x.*", "seq")
    large = defs.groupBy("file").agg(F.count("*").alias("n")).where(F.col("n") >= K.SPLIT_FUNCTIONS)
    caller = defs.groupBy("file", "name").agg(F.max_by("id", F.struct("seq", "id")).alias("caller"))
    calls = dep.where(F.col("a_owner").isNotNull()).select(F.col("a_file").alias("file"), F.col("a_owner").alias("name"), F.col("b_id").alias("callee")).join(caller, ["file", "name"])
    calls = calls.join(defs.select(F.col("id").alias("callee"), F.col("file").alias("callee_file")), "callee").where("caller <> callee")
    calls = calls.join(large.select("file"), "file", "left_semi").select("file", "caller", "callee", "callee_file").distinct()
    direct = calls.where("file = callee_file").select(F.col("caller").alias("a"), F.col("callee").alias("b"))
    near = shared_pairs(calls.select(F.col("file").alias("grp"), F.col("caller").alias("member"), F.col("callee").alias("neighbour")), keep=keep).select("a", "b")
    group = connected_components(direct.union(near), keep).select(F.col("node").alias("id"), "component")
    rows = defs.join(group, "id").join(large.select("file"), "file", "left_semi")
    groups = rows.groupBy("file", "component").agg(F.array_sort(F.collect_list(F.struct(F.col("line").alias("start_line"), "name"))).alias("g")).where(F.size("g") >= K.SPLIT_MEMBERS)
    out = groups.groupBy("file").agg(F.transform(F.array_sort(F.collect_list(F.struct((-F.size("g")).alias("n"), "g"))), lambda x: x["g"]).alias("groups"))
    return out.where(F.size("groups") >= K.SPLIT_GROUPS)


def cohesion_order() -> tuple:
    return F.desc("external_fan_in"), F.desc(F.size("clusters")), F.desc("external_edges"), F.asc("dir")


def split_order() -> tuple:
    return F.desc(F.size("groups")), F.asc("file")


def cohesion_advice(fan_in: int, clusters: list[list[str]]) -> list[str]:
    """What to do about a directory."""
    out = []
    if fan_in >= K.DIR_FAN_IN:
        out.append(f"{fan_in} directories reach in: put one narrow entry in front of it")
    real = [c for c in clusters if len(c) >= 2]
    if len(real) >= K.DIR_CLUSTERS:
        out.append(f"{len(real)} groups of files share nothing: give each a directory of its own")
    return out
