import random
import re

import numpy as np
import pytest
from pyspark.sql import functions as F

from tests.llm.helpers import docs, words
from weftgraph.llm import op5_near_dedup as N

LOWER = str.maketrans({chr(c): chr(c + 32) for c in range(65, 91)})


def brute(texts, k, percent):
    """(size, smallest id reachable) by comparing every pair."""
    sets = []
    for t in texts:
        w = re.findall(r"[^\x20\x09-\x0D]+", (t or "").translate(LOWER))
        sets.append({tuple(w[i : i + k]) for i in range(len(w) - k + 1)} or ({tuple(w)} if w else set()))
    parent = list(range(len(texts)))

    def find(x):
        while parent[x] != x:
            x = parent[x]
        return x

    for i in range(len(sets)):
        for j in range(i):
            both = len(sets[i] & sets[j])
            if sets[i] and sets[j] and 100 * both >= percent * (len(sets[i]) + len(sets[j]) - both):
                a, b = find(i), find(j)
                parent[max(a, b)] = min(a, b)
    return [(len(s), find(i)) for i, s in enumerate(sets)]


def corpus(seed=1):
    r = random.Random(seed)
    shared = words(r, 60)
    texts = [None, "", " \t\n", "One", "one", "one two", "ONE  two", "a b c", "A\nb c", "é É", words(r, 8000)]
    for _ in range(12):
        base = words(r, r.randint(20, 200)).split()
        texts.append(" ".join(base))
        for _ in range(r.randint(0, 8)):
            new = list(base)
            for _ in range(r.randint(0, max(1, len(new) // 25))):
                new[r.randrange(len(new))] = "changed" + str(r.randrange(99))
            texts.append(" ".join(new))
    texts += [shared + " " + words(r, 50) for _ in range(20)] + [texts[12]] * 5
    return texts


@pytest.mark.parametrize("join", [N.Join(), N.Join(words=5, percent=80), N.Join(leaf=3, depth=4, block=4, block_shingles=500), N.Join(leaf=8, block=4, block_shingles=500, spread=1)])
def test_near_duplicates(spark, join):
    texts = corpus()
    got = {r.doc_id: r for r in N.near_duplicates(docs(spark, texts), join).collect()}
    want = brute(texts, join.words, join.percent)
    assert len(got) == len(texts)
    assert [(got[i].n_shingles, got[i].component_id, got[i].kept) for i in range(len(texts))] == [(n, c, c == i) for i, (n, c) in enumerate(want)]


def test_sets_that_share_a_hash_stay_apart(spark, monkeypatch):
    """All first hashes are one: sets are told apart by the second."""
    sets = N._setting

    def alike(join):
        import pyarrow as pa

        make = sets(join)

        def run(batches):
            for b in make(batches):
                n = b.column("n_shingles").to_numpy()
                yield b.set_column(b.schema.get_field_index("set_a"), "set_a", pa.array(np.where(n > 0, 5, 0)))

        return run

    monkeypatch.setattr(N, "_setting", alike)
    monkeypatch.setattr(N, "_confirming", lambda join, keys, old=N._confirming: lambda batches: old(join, keys)(b.set_column(b.schema.get_field_index("set_a"), "set_a", __import__("pyarrow").array([_first(t.as_py(), join) for t in b.column("text")])) for b in batches))

    def _first(text, join):
        return N._named(N.shingles([(text or "").encode()], join.words)[0])[0]

    r = random.Random(8)
    base = [words(r, 60) for _ in range(6)]
    texts = [x for b in base for x in (b, b + " end", b)]
    got = {x.doc_id: x.component_id for x in N.near_duplicates(docs(spark, texts)).collect()}
    assert got == {i: c for i, (_, c) in enumerate(brute(texts, 3, 85))} and len(set(got.values())) == 6


def test_repeated_and_null_ids(spark):
    t = words(random.Random(2), 40)
    got = N.near_duplicates(docs(spark, [t, t, t + " x", t, "other words are here"], [7, 7, 3, None, 7])).collect()
    assert sorted((str(r.doc_id), r.component_id, r.kept) for r in got) == [("3", 3, True), ("7", 3, False), ("7", 3, False), ("7", 7, True), ("None", 3, False)]
    assert N.near_duplicates(docs(spark, [], [])).collect() == []


def test_without_copies(spark):
    texts = corpus(3)
    df = docs(spark, texts)
    kept = N.without_copies(df, N.Join(words=5, percent=80))
    want = {i for i, (n, c) in enumerate(brute(texts, 5, 80)) if c == i}
    assert kept.columns == df.columns and {r.doc_id for r in kept.collect()} == want


def test_one_copy_stays_for_any_ids(spark):
    t, u, v = (words(random.Random(i), 40) for i in (2, 3, 4))
    rows = [(7, t), (7, t), (3, t + " x"), (None, t), (7, "other words are here"), (5, u), (5, u), (None, v), (None, v), (9, u), (9, "a word apart")]
    got = N.without_copies(docs(spark, [x for _, x in rows], [i for i, _ in rows])).collect()
    assert sorted((str(r.doc_id), r.text) for r in got) == sorted([("3", t + " x"), ("7", "other words are here"), ("5", u), ("None", v), ("9", "a word apart")])


def test_tokens_estimate_similarity():
    r = np.random.default_rng(1)
    pool = r.integers(0, 1 << 64, 120_000, np.uint64)
    big, near, small = np.sort(pool), np.sort(pool[12_000:]), np.sort(pool[:3])
    t = N.tokens([big, near, small, big])
    assert abs((t[0] == t[1]).mean() - 0.9) < 0.12 and (t[0] == t[3]).all() and (t[0] == t[2]).mean() < 0.1


def test_pipeline(spark, tmp_path):
    import corpus_pipeline as P

    r = random.Random(9)
    good = [words(r, r.randint(30, 150)) for _ in range(80)]
    bad = [" $$$ ".join(words(r, 3) for _ in range(30)) for _ in range(40)]
    item = words(r, 25)
    texts = [*good, *bad, good[0], good[1] + " tail", f"{good[2]} {item} {words(r, 50)}", words(r, 60) + " token=abcdefgh12", ""]
    df = docs(spark, texts).select("doc_id", "text", "lang", "source", "n_chars")
    df.write.parquet(f"{tmp_path}/documents.parquet")
    labels = [(i, int(i < 80), 0) for i in range(120)]
    spark.createDataFrame(labels, "doc_id long, quality int, toxic int").write.parquet(f"{tmp_path}/labels.parquet")
    spark.createDataFrame([(1, item)], "item_id long, text string").write.parquet(f"{tmp_path}/benchmark.parquet")
    assert [n for n, _ in P.STAGES] == ["quality", "near_dedup", "decontaminate", "secrets", "packing"]
    now, seen = df, {}
    for k, (name, stage) in enumerate(P.STAGES[:-1]):
        now = stage(spark, now, str(tmp_path))
        assert now.columns == df.columns
        now.write.parquet(f"{tmp_path}/{k}")
        now = spark.read.parquet(f"{tmp_path}/{k}")
        seen[name] = {x.doc_id: x.text for x in now.collect()}
    assert sum(i in seen["quality"] for i in range(80)) >= 78 and sum(i in seen["quality"] for i in range(80, 120)) <= 4
    in_order = sorted(seen["quality"])
    kept = brute([seen["quality"][i] for i in in_order], 5, 80)
    assert set(seen["near_dedup"]) == {in_order[j] for j, (_, c) in enumerate(kept) if c == j}
    assert set(seen["near_dedup"]) - set(seen["decontaminate"]) == {122} & set(seen["near_dedup"])
    assert set(seen["secrets"]) == set(seen["decontaminate"])
    if 123 in seen["secrets"]:
        assert seen["secrets"][123].endswith("[secret]") and "abcdefgh12" not in seen["secrets"][123]
    packed = P.run(spark, str(tmp_path))
    assert {x.doc_id for x in packed.select("doc_id").distinct().collect()} == set(seen["secrets"])
    empty = P.pack(spark, now.limit(0), str(tmp_path))
    assert empty.count() == 0 and P.drop_copies(spark, now.limit(0), str(tmp_path)).count() == 0 and P.mask_secrets(spark, now.limit(0), str(tmp_path)).count() == 0
    assert P.filter_quality(spark, now.where(F.lit(False)), str(tmp_path)).count() == 0


def test_stages_with_odd_rows(spark, tmp_path):
    """Null texts and ids, ids that repeat, and columns that have the names that operators use inside."""
    import corpus_pipeline as P

    r = random.Random(11)
    names = ["_score", "__score", "copy_id", "copy_hash", "_copy_id", "cut_id", "cuts", "masked", "__cuts", "__masked", "__id", "_h", "_id", "_row", "node", "part", "quality", "component", "x", "a`b.c"]
    t = words(r, 50)
    texts = [None, "", t, t, words(r, 60) + " token=abcdefgh12", words(r, 40), words(r, 40), None]
    df = docs(spark, texts, [1, 2, 3, 3, None, 5, 5, None]).select("doc_id", "text", "lang", "source", "n_chars")
    df = df.select("*", *(F.lit(1).alias(n) for n in names))
    spark.createDataFrame([(1, words(r, 30)), (2, None)], "item_id long, text string").write.parquet(f"{tmp_path}/benchmark.parquet")
    spark.createDataFrame([], "doc_id long, quality int, toxic int").write.parquet(f"{tmp_path}/labels.parquet")
    want = sorted(texts, key=str)
    want.remove(t)
    now = df
    for k, (name, stage) in enumerate(P.STAGES[:-1]):
        now = stage(spark, now, str(tmp_path))
        assert now.columns == df.columns, name
        now.write.parquet(f"{tmp_path}/{k}")
        now = spark.read.parquet(f"{tmp_path}/{k}")
        left = sorted((x.text for x in now.collect()), key=str)
        assert [str(x).replace("[secret]", "token=abcdefgh12") for x in left] == [str(x) for x in (want if k else sorted(texts, key=str))], name
    packed = P.pack(spark, now, str(tmp_path)).collect()
    assert sorted(str(x.doc_id) for x in packed) == ["1", "2", "3", "5", "5", "None", "None"]
