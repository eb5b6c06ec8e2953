import json
import subprocess

import pytest
from pyspark.sql import functions as F

from weftgraph.plans.scan import compare, scan
from weftgraph.sources import config as C
from weftgraph.sources import history, sinks
from weftgraph.operators.scoring import explain_at
from weftgraph.sources.ingest import PythonAdapter, read_files
from weftgraph.streaming import session as T


@pytest.mark.parametrize(
    "bad, where",
    [
        ([], "config"), ({"nope": 1}, "config.nope"), ({"thresholds": {"size": 1}}, "thresholds.size"), ({"thresholds": {"name": -1}}, "thresholds.name"), ({"ignore": "x"}, "ignore"), ({"ignore": [""]}, "ignore[0]"),
        ({"gate": {"minStrength": 3}}, "minLocality"), ({"gate": {"minStrength": 10, "minLocality": 1}}, "minStrength"), ({"gate": {"minStrength": "7", "minLocality": 1}}, "minStrength"), ({"gate": {"minStrength": 1, "minLocality": 6}}, "minLocality"),
        ({"heuristicFindings": "maybe"}, "heuristicFindings"), ({"architecture": {"maxCycles": -1}}, "maxCycles"), ({"coChange": {"minRatio": 2}}, "minRatio"), ({"coChange": {"enabled": 1}}, "enabled"), ({"coChange": {"minSupport": 0}}, "minSupport"),
    ],
)
def test_bad_config(bad, where):
    with pytest.raises(C.ConfigError, match=where.replace("[", r"\[")):
        C.validate(bad)


def test_config(tmp_path):
    assert C.validate(None) == {} and C.load(None, str(tmp_path / "none.yml")) == {}
    with pytest.raises(C.ConfigError):
        C.load(str(tmp_path / "none.yml"))
    assert C.config_hash({}).startswith("44136fa") and C.config_hash({"a": 1, "b": {"c": 2}}) == C.config_hash({"b": {"c": 2}, "a": 1})
    assert C.cochange_options({"coChange": {"minSupport": 4}}, {"min_ratio": 0.2}) == {"min_support": 4, "min_ratio": 0.2, "max_commits": 500, "max_files": 25}
    assert C.cochange_options({}, {"min_support": 0}) is None and C.cochange_options({"coChange": {"enabled": False}}) is None
    assert C.architecture_violations({"tangles": 2, "cycles": 0}, {"architecture": {"maxTangles": 1, "maxCycles": 0}})[0][1].startswith("2 tangles")
    assert C.Options.parse({"top": -1, "budget_chars": 99, "globs": ["", 3], "inject": "no"}) == C.Options(budget_chars=99)


BASE = {"a.py": "LIMIT = 1\ncounter = 0\ndef wide(a, b, c, d):\n    x = a\n    y = b\n    return x\n", "b.py": "from a import wide, counter\ndef use():\n    wide(1, 2, 3, 4)\n    return counter\n"}


@pytest.fixture(scope="module")
def project(tmp_path_factory):
    top = tmp_path_factory.mktemp("project")
    run = lambda *a: subprocess.run(["git", "-C", str(top), "-c", "user.name=t", "-c", "user.email=t@t", *a], check=True, capture_output=True)
    run("init", "-q", "-b", "main")
    for name, text in BASE.items():
        (top / name).write_text(text)
    run("add", "-A"), run("commit", "-qm", "one")
    (top / "a.py").write_text("import b\nfrom b import use\ndef back():\n    return use()\n" + BASE["a.py"])
    (top / "b.py").write_text(BASE["b.py"] + "def other(p, q, r, s):\n    t = p\n    return t\ndef again():\n    other(5, 6, 7, 8)\n    wide(5, 6, 7, 8)\n")
    run("add", "-A"), run("commit", "-qm", "two")
    return top


def test_scan_of_python(spark, project, tmp_path):
    base = history.materialize(str(project), "HEAD~1")
    scans = {}
    for name, folder in (("base", base), ("head", str(project))):
        ir = PythonAdapter().to_ir(spark, read_files(spark, folder, ["**/*.py"], root=folder))
        scans[name] = scan(ir.nodes, ir.refs)
    counts = {r.ctype: r.edges for r in scans["base"].summary().collect()}
    assert counts["position"] == 4 and counts["identity"] == 1 and counts["name"] == 2
    assert scans["base"].cycles.count() == 0 and [r.files for r in scans["head"].cycles.collect()] == [["a.py", "b.py"]]
    d = compare(scans["base"], scans["head"])
    assert d["added"].where("ctype = 'position'").count() == 4 and d["added_cycles"].count() == 1
    assert sinks.diff_report(d["added"], d["added_cycles"])[1] == 1
    assert compare(scans["base"], scans["base"])["added"].count() == 0
    head = scans["head"]
    assert len(head.quality.collect()) == 7 and head.score().first().score == 0
    out = json.loads(sinks.sarif(head.edges, cycles=head.cycles))
    assert out["version"] == "2.1.0" and len(out["runs"][0]["tool"]["driver"]["rules"]) == 11 and any(r["ruleId"] == "cycle" for r in out["runs"][0]["results"])
    assert any(x.startswith("[high] cycle") for x in sinks.finding_lines(head.findings()))
    assert explain_at(head.edges, "B.py:3").count() > 0 and explain_at(head.edges, "b.py:99").count() == 0
    page = sinks.html_page("<x>", head.edges, head.hotspots(), head.quality)
    assert "&lt;x&gt;" in page and "<meter" in page
    lines = [r.line for r in sinks.scan_json(head.edges, head.summary(), head.pressure()).collect()]
    assert sum('"summary"' in x for x in lines) == 1 and len(lines) == head.edges.count() + 1
    sinks.scan_json(head.edges, head.summary()).write.text(str(tmp_path / "scan"))
    assert sinks.read_scan(spark, str(tmp_path / "scan")).exceptAll(head.edges).count() == 0 and sinks.read_scan(spark, str(tmp_path / "scan")).count() == head.edges.count()
    assert sinks.architecture_lines(head.architecture()) and sinks.edge_lines(head.edges, 1)[-1].endswith("more")
    assert "since the session began" in sinks.health_message(head.edges, head.summary(), head.hotspots(), 1)
    assert len(sinks.session_message(head.edges, 0, 9, budget=80)) <= 80


def test_history(spark, project):
    c = history.read_commits(spark, str(project)).orderBy("seq").collect()
    assert [sorted(r.files) for r in c] == [["a.py", "b.py"]] * 2 and [r.seq for r in c] == [0, 1]
    assert history.read_commits(spark, "/nowhere").count() == 0 and history.base_ref(str(project)) and history.base_ref(str(project), "x") == "x"
    assert history.rebase_globs(["src/*.ts", "p/x.ts"], "/r/p", "/r") == ["p/src/*.ts", "p/x.ts"]
    with pytest.raises(ValueError):
        history.materialize(str(project), "nothing")


def test_command_line(spark, project, tmp_path, monkeypatch):
    import io

    from weftgraph.cli import run

    def call(*argv):
        out, err = io.StringIO(), io.StringIO()
        return run(list(argv), spark, out, err), out.getvalue(), err.getvalue()

    monkeypatch.chdir(tmp_path)
    assert call("scan")[0] == 2 and call("scan", "x", "--type=size")[0] == 2 and call("explain", "x")[0] == 2 and call("scan", "x", "--top=-1")[0] == 2 and call("scan", "x", "--config=none.yml")[0] == 2
    (tmp_path / "c.yml").write_text("thresholds: {position: 1}\n")
    code, text, err = call("scan", str(project), "--config=c.yml", "--type=position", "--top=2", "--co-change=off")
    assert code == 1 and "position 12" in text and "and 10 more" in text and "quality" in text and err.startswith("violation: position: 12 edges")
    code, text, err = call("diff", f"--repo={project}", "--base=HEAD~1", "--format=json")
    assert code == 1 and json.loads(text)["cycles"] == 1
    assert call("diff", f"--repo={project}", "--base=nothing")[0] == 2


EVENTS = [
    ("session.created", "/w", "s", None, None, ["k1"]), ("session.step.ended", "/w/", "s", "tool-calls", None, ["k1", "k2"]), ("session.step.ended", "/W", "s", "stop", None, ["k1", "k2"]), ("session.idle", None, "s", None, None, ["k1", "k2", "k3"]),
    ("session.status", "/w", "s", None, "busy", ["k1"]), ("session.status", "/w", "s", None, "idle", ["k1", "k2", "k3"]), ("session.idle", "/other", "s", None, None, ["k9"]), ("file.edited", "/w", "s", None, None, []), ("session.idle", "/w", None, None, None, []),
    ("session.deleted", "/w", "s", None, None, []),
]


def _events(spark):
    rows = [(t, d, s, f, st, i, k, "1/x") for i, (t, d, s, f, st, k) in enumerate(EVENTS)]
    return spark.createDataFrame(rows, T.EVENTS + ", edge_keys array<string>, stamp string")


def test_sessions(spark, tmp_path):
    ours = T.classify(_events(spark), "/w")
    assert [(r.seq, r.intent, r.state) for r in ours.orderBy("seq").select("seq", "intent", "state").collect()] == [(0, "created", None), (1, "activity", "active"), (2, "activity", "idle"), (3, "activity", "idle"), (4, "activity", "active"), (5, "activity", "idle"), (9, "deleted", None)]
    assert sorted(r.seq for r in T.skipped(_events(spark), "/w").collect()) == [6, 8]
    want = [("baseline", None), ("fresh", "k2"), ("fresh", "k3"), ("ended", None)]
    assert [(r.kind, r.edge_key) for r in T.report_batch(ours).collect()] == want
    src, out = str(tmp_path / "in"), str(tmp_path / "out")
    _events(spark).coalesce(1).write.parquet(src)
    spark.conf.set("spark.sql.streaming.stateStore.providerClass", "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider")
    stream = spark.readStream.schema(_events(spark).schema).parquet(src)
    q = T.report_stream(T.classify(stream, "/w")).writeStream.format("parquet").option("checkpointLocation", str(tmp_path / "c")).option("path", out).trigger(availableNow=True).start()
    q.awaitTermination(120)
    assert sorted((r.kind, r.edge_key or "") for r in spark.read.parquet(out).collect()) == sorted((k, e or "") for k, e in want)


def test_scan_loop(spark, tmp_path):
    """One scan for a batch, whoever ends a turn; a new loop goes on from what was stored."""
    rows = lambda *r: spark.createDataFrame(list(r), "session_id string, intent string, state string")
    scans, told = [], []

    def loop(*keys):
        def scan_keys():
            scans.append(keys)
            return spark.createDataFrame([(k,) for k in keys], "edge_key string")

        return T.scan_loop(rows(("", "", "")), scan_keys, str(tmp_path / "b"), str(tmp_path / "log"), lambda s, new: told.append((s, sorted(r.edge_key for r in new.collect()))))

    loop("k1")(rows(("s", "created", None), ("t", "activity", "active")), 0)
    loop("k1", "k2")(rows(("s", "activity", "idle"), ("s", "activity", "idle"), ("t", "activity", "idle")), 1)
    loop("k1", "k2", "k3")(rows(("s", "activity", "idle"), ("t", "activity", "idle")), 2)
    loop("k1", "k2", "k3")(rows(("s", "activity", "idle"), ("t", "activity", "active")), 3)
    assert len(scans) == 4 and told == [("s", ["k2"]), ("s", ["k3"]), ("t", ["k3"])]
    loop("k9")(rows(("s", "deleted", None)), 4)
    assert len(scans) == 4 and [r.session_id for r in T.read_baselines(spark, str(tmp_path / "b")).collect()] == ["t"]
    assert sorted((r.session_id, r.baselines, r.fresh, r.ended) for r in T.session_report(spark.read.json(str(tmp_path / "log"))).collect()) == [("s", 1, 2, True), ("t", 1, 1, False)]


def test_stale_baseline_and_store(spark, tmp_path):
    s = T.Session()
    assert list(s.step("created", None, ["a"], "1/x")) == [("baseline", None)] and list(s.step("created", None, ["z"], "1/x")) == []
    assert list(s.step("activity", "idle", ["a", "b"], "1/y")) == [("rebaseline", None)]
    list(s.step("activity", "active", [], "1/y"))
    assert list(s.step("activity", "idle", ["a", "b", "c"], "")) == [("fresh", "c")]
    rows = spark.createDataFrame([("s1", "t", ["a", "b"], 1, "h")], "session_id string, at string, keys array<string>, score_version int, config_hash string")
    T.write_baselines(rows, str(tmp_path / "b"))
    assert T.read_baselines(spark, str(tmp_path / "b")).first()["count"] == 2
    rows.withColumns({"key_version": F.lit(1), "count": F.lit(2).cast("long")}).write.mode("append").partitionBy("key_version", "session_id").parquet(str(tmp_path / "b"))
    assert T.read_baselines(spark, str(tmp_path / "b")).count() == 1

    def broken(batch, n):
        raise RuntimeError("no")

    T.isolated(broken, str(tmp_path / "log"))(rows, 3)
    assert spark.read.json(str(tmp_path / "log")).first()["kind"] == "scan_error"
