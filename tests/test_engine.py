"""Edge tables and small projects with known outcomes."""

import random

import pytest
from pyspark.sql import functions as F

from weftgraph.functions import exprs as E
from weftgraph.functions.schema import NODES, RAW_EDGES, SCORED, columns, conform
from weftgraph.operators import cochange as CO
from weftgraph.operators import cohesion as CH
from weftgraph.operators import detectors as D
from weftgraph.operators import diff as DF
from weftgraph.operators import findings as FI
from weftgraph.operators import graph as G
from weftgraph.operators import modules as M
from weftgraph.operators import quality as Q
from weftgraph.operators import scoring as S
from weftgraph.operators.components import connected_components


def edges(spark, rows, **defaults):
    """Scored edges from (a_file, b_file) or (a_file, b_file, facts)."""
    base = dict(a_kind="reference", b_kind="function", a_name="r", b_name="f", a_line=1, b_line=1, ctype="name", strength=1, locality=5, degree=1, pressure=0.1, evidence="", heuristic=False, resolved=True) | defaults
    names = [n for n, _ in columns(SCORED)]
    out = []
    for i, (a, b, *facts) in enumerate(rows):
        r = base | dict(a_file=a, b_file=b, seq=i, a_id=f"a{i}", b_id=f"b{i}") | (facts[0] if facts else {})
        out.append(tuple(r.get(n) for n in names))
    return spark.createDataFrame(out, SCORED)


def nodes(spark, rows):
    names = [n for n, _ in columns(NODES)]
    out = []
    for i, r in enumerate(rows):
        r = dict(seq=i, kind="variable", name=r["id"], scope_path=[], file_path="x.ts", start_line=1, start_col=1, end_line=1, end_col=1) | r
        out.append(tuple(r.get(n) for n in names))
    return spark.createDataFrame(out, NODES)


def cycles(spark, pairs, **facts):
    return sorted(tuple(r.files) for r in G.file_cycles(edges(spark, pairs, **facts)).collect())


def test_cycles(spark):
    assert cycles(spark, [("a", "b"), ("b", "a")]) == [("a", "b")]
    assert cycles(spark, [("a", "b"), ("b", "c"), ("c", "a")]) == [("a", "b", "c")]
    assert cycles(spark, [(x, y) for x in "abc" for y in "abc" if x != y]) == [("a", "b", "c")]
    assert cycles(spark, [("a", "b"), ("b", "a")], resolved=None) == []
    assert cycles(spark, [("a", "b"), ("b", "a")], ctype="position") == []
    assert cycles(spark, [("a", "a")]) == []
    assert cycles(spark, [("a", "b"), ("b", "a"), ("x", "y"), ("y", "z"), ("z", "x")]) == [("a", "b"), ("x", "y", "z")]


def levels(spark, pairs, small=G.SMALL):
    solved = G.components_and_levels(spark.createDataFrame(pairs, "src string, dst string"), small)
    return {r.node: r.level for r in solved.collect()}, G.levelization(solved).first()


def test_levels(spark):
    assert levels(spark, [("app", "core"), ("core", "shared")])[0] == {"app": 3, "core": 2, "shared": 1}
    assert levels(spark, [("app", "api"), ("app", "store"), ("api", "model"), ("store", "model")])[1].depth == 3
    level, summary = levels(spark, [("a", "b"), ("b", "a"), ("b", "c")])
    assert level == {"a": 2, "b": 2, "c": 1} and summary.cyclic and summary.components == 2
    assert levels(spark, [])[1].asDict() == {"depth": 0, "components": 0, "cyclic": False}


def test_distributed_components_match_local(spark):
    r = random.Random(3)
    pairs = [(f"n{r.randrange(14):02}", f"n{r.randrange(14):02}") for _ in range(22)]
    solve = lambda small: {(x.node, x.component, x.level) for x in G.components_and_levels(spark.createDataFrame(pairs, "src string, dst string"), small).collect()}
    assert solve(0) == solve(1000)


def test_connected_components(spark):
    r = random.Random(5)
    pairs = [(r.randrange(60), r.randrange(60)) for _ in range(40)] + [(100 + i, 101 + i) for i in range(20)]
    parent = {x: x for p in pairs for x in p}

    def find(x):
        while parent[x] != x:
            x = parent[x]
        return x

    for a, b in pairs:
        a, b = find(a), find(b)
        parent[max(a, b)] = min(a, b)
    got = {x.node: x.component for x in connected_components(spark.createDataFrame(pairs, "a long, b long"), G.store).collect()}
    linked = {x for a, b in pairs if a != b for x in (a, b)}
    assert got == {x: find(x) for x in linked}


def modules_of(spark, rows, **facts):
    return {r["name"]: sorted(r.files) for r in M.module_levels(M.dependency_weight(edges(spark, rows, **facts))).where("level = 0").collect()}


def test_communities(spark):
    got = modules_of(spark, [("src/a/1", "src/a/3"), ("src/a/3", "src/a/2"), ("src/a/2", "src/a/1"), ("src/a/1", "src/a/3"), ("src/b/1", "src/b/2"), ("src/b/2", "src/b/1")])
    assert {k: len(v) for k, v in got.items()} == {"src/a": 3, "src/b": 2}
    got = modules_of(spark, [("src/h/c", "src/core/o"), ("src/core/o", "src/h/c"), ("src/h/c", "src/core/p"), ("src/core/p", "src/h/c")], strength=3)
    assert list(got) == ["src+…"] and len(got["src+…"]) == 3


def test_tangles_and_layers(spark):
    c = spark.createDataFrame([("a", "b", 2, 10), ("b", "a", 1, 5), ("a", "c", 1, 1)], "src string, dst string, edges long, weight long")
    assert [(r.src, r.dst, r.edges, r.back_edges) for r in G.tangles(c).collect()] == [("a", "b", 2, 1)]
    assert [(r.src, r.dst) for r in G.one_way(c).collect()] == [("a", "c")]
    chain = spark.createDataFrame([("cli", "app", 1, 1), ("app", "core", 1, 1), ("core", "shared", 1, 1), ("app", "shared", 1, 1)], c.schema)
    assert [r.modules for r in M.layering(chain).orderBy("level").collect()] == [["shared"], ["core"], ["app"], ["cli"]]
    assert M.layering(chain.union(spark.createDataFrame([("shared", "cli", 1, 1)], c.schema))).count() == 0
    ring = spark.createDataFrame([("a", "b", 1, 1), ("b", "c", 1, 1), ("c", "a", 1, 1)], c.schema)
    assert [r.path for r in M.module_cycles(ring).collect()] == [["a", "b", "c", "a"]]


def test_directory_cohesion(spark):
    rows = [(f"o{i}/x", "shared/a") for i in range(4)] + [("shared/a", "shared/b"), ("shared/b", "shared/c")]
    r = CH.dir_cohesion(edges(spark, rows)).first()
    assert (r.dir, r.external_fan_in, r.external_edges, r.internal_edges) == ("shared", 4, 4, 2)
    rows = [("mod/a", "mod/b"), ("mod/c", "mod/d"), ("x/1", "mod/a"), ("y/1", "mod/b"), ("z/1", "mod/c")]
    r = CH.dir_cohesion(edges(spark, rows)).first()
    assert r.clusters == [["mod/a", "mod/b"], ["mod/c", "mod/d"]] and len(CH.cohesion_advice(r.external_fan_in, r.clusters)) == 2


def test_file_splits(spark):
    rows = []
    for x, y in (("a", "b"), ("c", "d"), ("e", "f")):
        rows += [("f.ts", "f.ts", dict(a_owner=x, b_name=y, b_id=y, b_line=ord(y))), ("f.ts", "f.ts", dict(a_owner=y, b_name=x, b_id=x, b_line=ord(x)))]
    got = CH.file_splits(edges(spark, rows)).collect()
    assert len(got) == 1 and [[g["name"] for g in x] for x in got[0].groups] == [["a", "b"], ["c", "d"], ["e", "f"]]


def test_findings(spark):
    meaning = edges(spark, [("a", f"m{i}", dict(a_line=1, b_line=i)) for i in range(3)], ctype="meaning", evidence="literal 'x y' at 4 sites in 4 files", strength=3, heuristic=True)
    got = FI.cluster_findings(meaning).collect()
    assert [(r.kind, r.key, r.edges) for r in got] == [("meaning", "'x y'", 3)]
    two = [("call", "callee", dict(a_line=s, b_line=p)) for s in (1, 9) for p in (1, 2)]
    got = FI.cluster_findings(edges(spark, two, ctype="position", strength=4)).collect()
    assert [(r.kind, r.edges, len(r.members)) for r in got] == [("position", 4, 4)]
    assert FI.cluster_findings(edges(spark, [("call", "callee", dict(a_line=s)) for s in (1, 2)], ctype="position")).count() == 0
    clone = edges(spark, [("tests/a.test.ts", "tests/a.test.ts", dict(a_line=1, b_line=9))], ctype="algorithm", strength=5, pressure=0.9)
    assert FI.cluster_findings(clone).first().severity == "low"
    gaps = edges(spark, [("c", "callee", dict(b_line=n)) for n in (1, 2, 9, 10)], ctype="position")
    assert FI.position_islands(gaps).select("island").distinct().count() == 1  # one call site, so one group of lines 1 to 10
    apart = edges(spark, [("c", "callee", dict(a_line=n, b_line=n)) for n in (1, 3, 9)], ctype="position")
    assert sorted(r.island for r in FI.position_islands(apart).collect()) == [0, 0, 1]


def test_hotspots(spark):
    e = edges(spark, [("a", "b", dict(strength=1, degree=2)), ("a", "c", dict(strength=5, degree=7))])
    r = S.file_hotspots(e).where("file = 'a'").first()
    assert (r.edges, r.max_degree, r.worst_strength) == (2, 7, 5)
    assert S.file_hotspots(edges(spark, [("a", "a")])).first().edges == 2


def test_scalars(spark):
    one = spark.range(1)
    f = [{"kind": "function", "name": "f"}]
    m, p = {"kind": "module", "name": "m"}, {"kind": "package", "name": "p"}
    scope = "array<struct<kind:string,name:string>>"
    cases = [(f + [m, p], f + [m, p], 1), ([m, p], [m, p], 3), ([m, p], [{"kind": "module", "name": "n"}, p], 4), ([m], [p], 5), (None, [p], 99)]
    df = spark.createDataFrame([(a and [(x["kind"], x["name"]) for x in a], [(x["kind"], x["name"]) for x in b], n) for a, b, n in cases], f"a {scope}, b {scope}, n int")
    assert df.where(E.locality_of("a", "b") != F.col("n")).count() == 0
    assert one.select(E.pressure_of(F.lit(9), F.lit(5), F.lit(100))).first()[0] == 1.0
    assert one.select(E.pressure_of(F.lit(4), F.lit(4), F.lit(1))).first()[0] == 0.4741
    sev = [("name", 1, 5, 0.27, "low"), ("algorithm", 5, 3, 0.1, "high"), ("identity", 9, 4, 0.7, "high"), ("position", 4, 3, 0.4, "medium")]
    df = spark.createDataFrame(sev, "t string, s int, l int, p double, want string")
    assert df.where(E.severity_of("t", "s", "l", "p") != F.col("want")).count() == 0
    globs = [("src/a.test.ts", "**/*.test.ts", True), ("src/x.ts", "src/*.ts", True), ("src/a/x.ts", "src/*.ts", False), ("src/a/b/x.ts", "src/**/*.ts", True), ("src\\x.ts", "src/*.ts", True)]
    for path, glob, want in globs:
        assert one.select(E.matches_any(F.lit(path), [glob])).first()[0] is want, (path, glob)
    assert one.select(E.dir_of(F.lit("a.ts")), E.dir_of(F.lit("x/y/a.ts")), E.short_path(F.lit("x/y/a.ts")), E.short_path(F.lit("a"))).first()[:] == (".", "x/y", "y/a.ts", "a")
    assert E.file_line("a:b.ts:12") == ("a:b.ts", 12)
    with pytest.raises(ValueError):
        E.file_line("a.ts")


def test_gini_and_axes(spark):
    gini = lambda v: Q.gini(spark.createDataFrame([(float(x),) for x in v], "value double")).first().gini
    assert gini([2, 2, 2, 2]) == 0 and gini([0, 0, 0, 10]) > 0.5 and gini([]) == 0
    ten = spark.createDataFrame([(10,)] * 4, "definitions int")
    assert Q.equality_axis(ten).first().value == 0.5
    assert Q.levelization_axis(spark.createDataFrame([(3, 5)], "depth int, components int")).first().value == 0.5
    assert Q.redundancy_axis(spark.createDataFrame([(10, 2)], "hashable int, duplicates int")).first().value == 0.8
    axes = spark.createDataFrame([(1.0,)] * 6 + [(0.0,)], "value double")
    assert Q.quality_score(axes).first().score == 0
    empty, none = edges(spark, []), nodes(spark, [])
    solved = G.components_and_levels(G.file_graph(empty))
    all_axes = Q.quality_axes(empty, solved, S.definitions_by_file(none), S.project_stats(none))
    assert Q.quality_score(all_axes).first().score == 10000
    assert [r.key for r in all_axes.orderBy("n").collect()] == list(__import__("weftgraph.functions.constants", fromlist=["x"]).AXES)


def test_degrees(spark):
    raw = spark.createDataFrame([("a", "b", "identity"), ("a", "c", "name"), ("b", "c", "name"), ("d", "d", "name")], "node_a string, node_b string, ctype string")
    got = {(r.ctype, r.node): r.degree for r in S.degrees(raw).collect()}
    assert got["identity", "a"] == 1 and got["name", "a"] == 1 and got["name", "c"] == 2 and got["name", "d"] == 2


def test_position_detector(spark):
    rows = [dict(id="fn", kind="function"), *(dict(id=f"p{i}", kind="parameter", parent_id="fn", start_col=i) for i in range(5)), dict(id="ref", kind="reference"), dict(id="call", kind="call", parent_id="ref")]
    rows += [dict(id=f"arg{i}", kind="argument", name=str(i), parent_id="call") for i in range(6)]
    rows += [dict(id="two", kind="function"), *(dict(id=f"q{i}", kind="parameter", parent_id="two") for i in range(2)), dict(id="ref2", kind="reference"), dict(id="call2", kind="call", parent_id="ref2"), dict(id="z", kind="argument", name="0", parent_id="call2")]
    n = nodes(spark, rows)
    names = D.name_edges(n, spark.createDataFrame([("ref", "fn"), ("ref2", "two")], "ref_id string, def_id string"))
    assert sorted((r.node_a, r.node_b) for r in D.position_edges(n, names).collect()) == [(f"arg{i}", f"p{i}") for i in range(5)]


def test_literals_and_constants(spark):
    home = [dict(id=f"h{i}", kind="literal", name="'home'", file_path="usage.ts" if i < 5 else "tabs.ts") for i in range(6)]
    slash = [dict(id=f"s{i}", kind="literal", name="'/'", file_path=f"{i}.ts") for i in range(6)]
    read = [dict(id=f"r{i}", kind="literal", name="'read'", file_path=f"{i}.ts", is_union_literal=True) for i in range(6)]
    n = nodes(spark, home + slash + read)
    assert {(r.node_a, r.literal) for r in D.meaning_star(n).collect()} == {("h0", "'home'")}
    assert D.meaning_star(n).count() == 5 and D.meaning_star(n, min_sites=99).count() == 0 and D.meaning_star(n, min_files=5).count() == 0
    assert D.meaning_star(n, skip_trivial=False).where("literal = \"'/'\"").count() == 5
    v = nodes(spark, [dict(id="A_B", file_path=f, mutable=False, initial_value="3") | dict(id=f"{f}x", name="A_B") for f in ("a", "b")])
    assert D.value_edges(v).count() == 1 and D.value_edges(v, min_files=3).count() == 0


def test_clones_and_identity(spark):
    body = [dict(id=x, kind="function", structure_hash=h, end_line=5) for x, h in (("s", "1"), ("t", "1"), ("u", "2"))]
    assert D.algorithm_edges(nodes(spark, body)).count() == 1 and D.algorithm_edges(nodes(spark, body), min_lines=50).count() == 0
    n = nodes(spark, [dict(id="counter", mutable=True), dict(id="FIXED", mutable=False), dict(id="r1"), dict(id="r2")])
    names = D.name_edges(n, spark.createDataFrame([("r1", "counter"), ("r2", "FIXED")], "ref_id string, def_id string"))
    assert [(r.node_a, r.node_b) for r in D.identity_edges(n, names).collect()] == [("r1", "counter")]


def test_cochange(spark):
    commits = lambda rows: spark.createDataFrame([(f"sha{i}", i, list(f)) for i, f in enumerate(rows)], "sha string, seq long, files array<string>")
    r = CO.cochange(commits(["ab", "ab", "ab", "a", "b"]), min_support=2).collect()
    assert [(x.support, x.ratio, x.last) for x in r] == [(3, 0.75, "sha0")]
    many = commits(["ab"] * 3 + ["a"] * 5 + ["b"] * 5)
    assert CO.cochange(many).count() == 0 and CO.cochange(many, min_ratio=0.3).count() == 1
    wide = spark.createDataFrame([(f"s{i}", i, [f"f{j}" for j in range(30)]) for i in range(4)], "sha string, seq long, files array<string>")
    assert CO.cochange(wide).count() == 0 and CO.cochange(wide, min_support=0).count() == 0
    got = CO.cochange(commits(["bc", "ab"]), min_support=1).orderBy(*CO.cochange_order()).collect()
    assert [(x.a, x.b) for x in got] == [("a", "b"), ("b", "c")]
    log = spark.createDataFrame([("l", i, x) for i, x in enumerate(["c abc", "a", "b", "", "c def", "a"])], "log string, n int, line string")
    assert sorted((r.sha, r.files) for r in CO.segment_log(log, "c ").collect()) == [("abc", ["a", "b"]), ("def", ["a"])]


def test_diff(spark):
    base = edges(spark, [("a", "b", dict(b_identity="h", a_identity="g"))])
    moved = edges(spark, [("z", "y", dict(b_identity="h", a_identity="g", b_name="other"))])
    d = DF.diff(base, moved, G.file_cycles(base), G.file_cycles(edges(spark, [("a", "b"), ("b", "a")])))
    assert d["added"].count() == 0 and d["removed"].count() == 0 and d["added_cycles"].count() == 1 and d["removed_cycles"].count() == 0
    new = edges(spark, [("a", "b"), ("a", "b")], ctype="position")
    added = DF.diff(base, new)["added"]
    none = G.file_cycles(base)
    assert added.count() == 2 and DF.diff_gate(added, none) == 1
    assert DF.diff_gate(edges(spark, [("a", "b")]), none) == 0 and DF.diff_gate(edges(spark, [("a", "b")], ctype="value"), none) == 0
    v = DF.violations(edges(spark, [("a", "b")] * 6, ctype="algorithm", strength=5, locality=5), {"algorithm": 5}, (5, 5))
    assert sorted(r.kind for r in v.collect()) == ["gate", "threshold"]
    assert DF.violations(edges(spark, [("a", "b")], strength=5, locality=5), None, (7, 4)).count() == 0


def test_order_and_partitions_do_not_matter(spark):
    rows = [(f"m{i % 5}/f{i % 7}", f"m{(i * 3) % 5}/f{(i * 2) % 7}", dict(pressure=(i % 9) / 10)) for i in range(60)]
    e = edges(spark, rows)
    want = [tuple(r) for r in S.file_hotspots(e).orderBy(*S.hotspot_order()).collect()]
    got = [tuple(r) for r in S.file_hotspots(e.orderBy(F.rand(1)).repartition(7)).orderBy(*S.hotspot_order()).collect()]
    assert want == got
    finding = lambda x: sorted((r.kind, r.key, r.edges, str(r.members)) for r in FI.cluster_findings(x).collect())
    assert finding(e) == finding(e.repartition(5))


def line_documents(spark, folder):
    """Documents with lines that more than 50 of them hold, as a table, and their lines."""
    r = random.Random(8)
    texts = ["hot one\nhot two"] * 60 + ["hot one\nhot two\nrare " + str(i % 3) for i in range(9)] + ["hot one\nalone " + str(i) for i in range(5)]
    texts += ["\n".join(f"line {r.randrange(12)}" for _ in range(r.randint(0, 4))) for _ in range(80)]
    spark.createDataFrame([(i, t) for i, t in enumerate(texts)], "doc_id long, text string").write.parquet(f"{folder}/documents.parquet")
    return {str(i): {x for x in t.split("\n") if len(x) >= 2} for i, t in enumerate(texts)}


def test_documents_share_lines_of_any_number(spark, tmp_path, monkeypatch):
    from weftgraph.plans import registry

    lines = line_documents(spark, tmp_path)
    want = {(a, b): n for a in lines for b in lines if a < b and (n := len(lines[a] & lines[b])) >= 2}
    assert len(want) > 60 * 59 // 2
    for block in (CH.PAIR_BLOCK, 2):
        monkeypatch.setattr(CH, "PAIR_BLOCK", block)
        got = registry.affinity_documents(spark, str(tmp_path)).collect()
        assert {(x.a, x.b): x.shared for x in got} == want and len(got) == len(want)


def test_pairs_of_a_large_set_are_spread(spark, tmp_path, monkeypatch):
    """No task makes a large part of the pairs, though most documents have the same lines; chunks and parts lose none."""
    from weftgraph.plans import registry

    texts = ["x one\nx two"] * 400 + [f"x one\nx two\nrare {i % 40}" for i in range(120)] + [f"x one\nrare {i % 40}\nonly {i}" for i in range(40)] + [f"x two\nrare {i % 5}" for i in range(30)]
    spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string").write.parquet(f"{tmp_path}/documents.parquet")
    lines = {str(i): set(t.split("\n")) for i, t in enumerate(texts)}
    want = {(a, b): n for a in lines for b in lines if a < b and (n := len(lines[a] & lines[b])) >= 2}
    for name, value in (("CHUNK", 32), ("TASK_ROWS", 5000)):
        monkeypatch.setattr(CH, name, value, raising=False)
    got = registry.affinity_documents(spark, str(tmp_path)).withColumn("task", F.spark_partition_id()).collect()
    assert {(x.a, x.b): x.shared for x in got} == want and len(got) == len(want)
    tasks = [x.task for x in got]
    assert max(tasks.count(t) for t in set(tasks)) < len(got) / 5


def test_a_line_of_all_sets_makes_no_rows(spark):
    """Sets that share their commonest neighbour alone are never paired for it."""
    links = spark.createDataFrame([(0, f"m{i:03}", x) for i in range(300) for x in ("hot", f"own {i // 2}", f"{i % 2} own {i}", f"{i % 2} own {i - 2}")], "grp int, member string, neighbour string")
    made = []
    keep = lambda df, name: (made.append((name, G.store(df, name))), made[-1][1])[1]
    got = {(r["a"], r["b"]): r["shared"] for r in CH.shared_pairs(links, keep=keep).collect()}
    hood = {f"m{i:03}": {"hot", f"own {i // 2}", f"{i % 2} own {i}", f"{i % 2} own {i - 2}"} for i in range(300)}
    assert got == {(a, b): n for a in hood for b in hood if a < b and (n := len(hood[a] & hood[b])) >= 2} and len(got) > 400
    rows = dict(made)["blocks"].selectExpr("sum(k * n)").first()[0]
    assert rows < 300 * 299 / 20


def test_documents_are_read_once_for_their_lines(spark, tmp_path):
    """Where links are too many to be broadcast."""
    from weftgraph.plans import registry

    line_documents(spark, tmp_path)
    before = spark.conf.get("spark.sql.autoBroadcastJoinThreshold")
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    try:
        links = CH._shared_links(registry._document_lines(spark, str(tmp_path)), 2)
        links.collect()
        plan = links._jdf.queryExecution().executedPlan().toString().split("== Initial Plan ==")[0]
    finally:
        spark.conf.set("spark.sql.autoBroadcastJoinThreshold", before)
    assert plan.count("FileScan") == 1


def test_components_over_lines_of_any_number(spark, tmp_path):
    from weftgraph.plans import registry

    lines = line_documents(spark, tmp_path)
    parent = {x: x for x in lines}
    for a in lines:
        for b in lines:
            if a != b and len(lines[a] & lines[b]) >= 2 and parent[a] != parent[b]:
                old, new = sorted((parent[a], parent[b]), key=int, reverse=True)
                parent = {x: new if p == old else p for x, p in parent.items()}
    sizes = [list(parent.values()).count(p) for p in parent.values()]
    got = registry.cc_documents(spark, str(tmp_path)).collect()
    assert {x.node: x.component for x in got} == {x: p for (x, p), n in zip(parent.items(), sizes) if n > 1}
    assert len(got) > 60


def test_edges_are_joined_once_for_each_end(spark):
    """To attributes and degrees together; without degrees nothing is counted."""
    nodes = conform(spark.createDataFrame([("a", "f"), ("b", "f"), ("c", "g")], "id string, file_path string").withColumn("scope_path", F.expr("array(named_struct('kind', 'module', 'name', file_path))")), NODES)
    raw = conform(spark.createDataFrame([("a", "b", "name", 1), ("a", "c", "name", 2), ("a", "x", "type", 3)], "node_a string, node_b string, ctype string, seq long"), RAW_EDGES)
    for degree in (True, False):
        edges = S.score_edges(nodes, raw, degree)
        plan = edges._jdf.queryExecution().optimizedPlan().toString()
        # Two for the edges, and with degrees one of nodes with their counts for each end.
        assert plan.count("Join ") == (4 if degree else 2) and plan.count("Generate ") == (2 if degree else 0)
        got = {r["seq"]: (r["locality"], r["degree"], r["b_file"], r["b_name"]) for r in edges.collect()}
        assert got == {1: (3, 1 if degree else None, "f", "b"), 2: (5, 1 if degree else None, "g", "c"), 3: (99, 1 if degree else None, "?", "x")}


def test_groups_that_decide_nothing_are_not_found(spark):
    """Without clusters the rows are the same, and members are paired only in directories that few others reach into."""
    pairs = [(f"d{k}/a{i}", f"hub/h{i % 3}") for k in range(4) for i in range(3)] + [("two/a", "two/b"), ("two/c", "two/d"), ("d0/a0", "two/a"), ("one/a", "one/b"), ("one/b", "one/c")]
    pairs += [("far/x", "ext/p"), ("far/x", "ext/q"), ("far/y", "ext/p"), ("far/y", "ext/q"), ("far/z", "far/w")]
    edges = conform(spark.createDataFrame([(a, b, "name") for a, b in pairs], "a_file string, b_file string, ctype string"), SCORED)
    kept = []
    keep = lambda df, name: (kept.append(name), G.store(df, name))[1]
    whole, rows = CH.dir_cohesion(edges, keep), CH.dir_cohesion(edges, keep, clusters=False)
    plain = lambda df: sorted(map(tuple, df.drop("clusters").collect()))
    assert plain(whole) == plain(rows) and {r["dir"] for r in rows.collect()} == {"hub", "two", "far"}
    assert {r["dir"]: r["clusters"] for r in rows.collect() if r["clusters"]} == {r["dir"]: r["clusters"] for r in whole.collect() if r["dir"] != "hub"}
    kept.clear()
    hub = edges.limit(0).unionByName(conform(spark.createDataFrame([(f"s{k}/only", f"hub/h{i}", "name") for k in range(4) for i in range(3)], "a_file string, b_file string, ctype string"), SCORED))
    assert plain(CH.dir_cohesion(hub, keep, clusters=False)) == [("hub", 3, 0, 12, 4)] and "neighbourhoods" not in kept


def test_rare_files_leave_before_pairs(spark):
    """Files of fewer commits than a pair needs are in no pair that is made."""
    items = spark.createDataFrame([(c, -c, f) for c in range(4) for f in ["x", "y", *(f"only{c}{i}" for i in range(9))]], "sha long, seq long, file string")
    pairs = CO.cochange_pairs(items, 3, 0.5, 25)
    assert [tuple(r) for r in pairs.collect()] == [("x", "y", 4, 1.0, 3)]
    assert "left_semi" in pairs._jdf.queryExecution().analyzed().toString().lower().replace("leftsemi", "left_semi") and pairs._jdf.queryExecution().optimizedPlan().toString().count("LeftSemi") >= 2
