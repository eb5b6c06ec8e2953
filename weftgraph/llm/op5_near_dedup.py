"""Near-duplicates by chosen-path set similarity join.

Documents become sets of word shingles. Equal sets are one node with one representative. Each node keeps
128 minwise tokens. A tree's root and every inner node choose tokens (one, and with probability
1 / threshold - 1 another, so that a pair at the threshold keeps one common branch on average); documents
branch by the tokens' values, until a node is small; its members are compared exhaustively by their tokens.
Independent trees repeat this: a pair at the threshold is together in a leaf of depth d of one tree with
probability of about threshold ** d, so that sixteen trees miss it with 1e-13 at depth 1 and 1e-4 at 5.

Pairs whose tokens agree in at least the threshold less five standard deviations connect candidates, of which
only a spanning forest leaves each leaf. The forest's components are then checked on full sets: each
document of one goes to the component's task once, where all pairs of components of confirmed links are
compared exactly. Nothing emits all pairs of a group.

Leaves, and components with many members or shingles, are bounded: what is larger is cut into blocks, and
every pair of blocks is compared in a task of its own. A component of more than ``spread`` blocks (candidates chain
where many texts share a template) isn't compared as a whole: its texts go to their leaves, so that a text is copied
for each leaf and not for each block, and links are confirmed among a leaf's members.

Sets are told apart by two hashes of 64 bits each. The first also names a set's node; of sets that share it, all
but one are named by both.

Defined results: null texts, empty ones and those without words have the empty set, their own id as
component and no links; equal rows are linked as copies; ids that repeat with other texts are kept apart; null
ids are compared like others but don't name a component; an empty table gives no rows; further columns are
ignored by ``near_duplicates`` and kept by ``without_copies``.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator
from dataclasses import dataclass

import numpy as np
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from weftgraph.llm.common import only, small_batches, stored, table, unused
from weftgraph.operators.components import connected_components

TOKENS = 128
#: Bytes of texts that are worked on at a time (a longer text is one such part).
SLICE = 1 << 19
#: Documents whose ids are broadcast at most, to fetch their texts; beyond it, texts are shuffled.
BROADCAST_MEMBERS = 1_000_000


@dataclass(frozen=True)
class Join:
    words: int = 3
    #: Linked from this similarity on, in percent.
    percent: int = 85
    trees: int = 16
    leaf: int = 256
    depth: int = 7
    #: Members and shingles in a task at most; larger groups are cut into blocks.
    block: int = 1500
    block_shingles: int = 3_000_000
    #: Blocks from which a component's texts go to their leaves.
    spread: int = 16

    @property
    def least_tokens(self) -> int:
        s = self.percent / 100
        return int(TOKENS * (s - 5 * (s * (1 - s) / TOKENS) ** 0.5))

    @property
    def second_branch(self) -> int:
        return int((100 / self.percent - 1) * 65536)


_U = np.uint64
_lower = bytes(c + 32 if 65 <= c <= 90 else c for c in range(256))
_blank = np.zeros(256, bool)
_blank[[32, *range(9, 14)]] = True
_random = np.random.default_rng(987_654_321)
_letter = _random.integers(0, 1 << 64, 256, _U, endpoint=False)
_place = _random.integers(0, 1 << 64, 8, _U, endpoint=False) | _U(1)
_times = (_random.integers(0, 1 << 32, TOKENS, np.uint32) | np.uint32(1)).astype(np.uint32)
_xor = _random.integers(0, 1 << 32, TOKENS, np.uint32)
_BASE = 0x9E3779B97F4A7C15
_INVERSE = pow(_BASE, -1, 1 << 64)


def mix(x: np.ndarray) -> np.ndarray:
    x = x ^ (x >> _U(33))
    x = x * _U(0xFF51AFD7ED558CCD)
    x ^= x >> _U(33)
    x = x * _U(0xC4CEB9FE1A85EC53)
    return x ^ (x >> _U(33))


def _power(n: int) -> list[np.ndarray]:
    kept = only("near").setdefault("powers", [])
    if not kept or len(kept[0]) < n:
        n = max(n, SLICE + (SLICE >> 2))
        kept[:] = (np.multiply.accumulate(np.concatenate((np.ones(1, _U), np.full(n - 1, b, _U)))) for b in (_BASE, _INVERSE))
    return kept


def shingles(texts: list[bytes], words: int) -> list[np.ndarray]:
    """The sorted distinct hashes of each text's shingles."""
    data = np.frombuffer(b" ".join(t.translate(_lower) for t in texts) + b" ", np.uint8)
    starts = np.cumsum([0, *(len(t) + 1 for t in texts)])
    blank = _blank[data]
    edge = np.flatnonzero(np.diff(blank, prepend=True))
    first, last = edge[::2], edge[1::2]
    power, inverse = _power(len(data) + 1)
    sums = np.concatenate((np.zeros(1, _U), np.cumsum(_letter[data] * power[: len(data)])))
    word = mix((sums[last] - sums[first]) * inverse[first] + (last - first).astype(_U))
    at = np.searchsorted(first, starts)
    n = len(word) - words + 1
    whole = np.zeros(max(n, 0), _U)
    for k in range(words):
        whole += word[k : k + max(n, 0)] * _place[k]
    whole = mix(whole)
    out = []
    for a, b in zip(at[:-1].tolist(), at[1:].tolist()):
        if b - a >= words:
            s = np.sort(whole[a : b - words + 1])
            out.append(s[np.concatenate((np.ones(1, bool), s[1:] != s[:-1]))])
        elif b > a:
            out.append(mix((word[a:b] * _place[: b - a]).sum(keepdims=True) + np.array([b - a], _U) * _place[7]))
        else:
            out.append(word[:0])
    return out


def tokens(sets: list[np.ndarray]) -> np.ndarray:
    """The minwise tokens of sets that aren't empty."""
    h = (np.concatenate(sets) >> _U(32)).astype(np.uint32)
    starts = np.cumsum([0, *(len(s) for s in sets[:-1])])
    out = np.empty((len(sets), TOKENS), np.uint32)
    # Parts that stay in the processor's cache; a set that a cut divides is joined by the minimum.
    for a in range(0, len(h), 1 << 16):
        part = h[a : a + (1 << 16)]
        lo = int(np.searchsorted(starts, a, side="right")) - 1
        hi = int(np.searchsorted(starts, a + len(part), side="left"))
        cuts = np.maximum(starts[lo:hi] - a, 0)
        for j in range(TOKENS):
            m = np.minimum.reduceat((part ^ _xor[j]) * _times[j], cuts)
            if starts[lo] < a:
                m[0] = min(m[0], out[lo, j])
            out[lo:hi, j] = m
    return out


def _parts(texts: list[bytes]) -> Iterator[tuple[int, list[bytes]]]:
    a = 0
    while a < len(texts):
        b, size = a, 0
        while b < len(texts) and (b == a or size + len(texts[b]) <= SLICE):
            size += len(texts[b]) + 1
            b += 1
        yield a, texts[a:b]
        a = b


SETS = "doc_id long, text_hash long, n_shingles long, set_a long, set_b long, tokens binary"


def _names(schema: str) -> list[str]:
    return [x.split()[0] for x in schema.split(", ")]


def _long(x):
    import pyarrow as pa

    return pa.array(np.ascontiguousarray(x).view(np.int64))


def _setting(join: Join) -> Callable:
    def run(batches):
        import pyarrow as pa

        for batch in batches:
            for at in range(0, batch.num_rows, 1000):
                texts = [(t.as_py() or "").encode("utf-8", "surrogatepass") for t in batch.column("text").slice(at, 1000)]
                for a, part in _parts(texts):
                    sets = shingles(part, join.words)
                    n = np.array([len(s) for s in sets])
                    full = [s for s in sets if len(s)]
                    set_a, set_b = np.zeros(len(sets), _U), np.zeros(len(sets), _U)
                    minwise = np.zeros((len(sets), TOKENS), np.uint32)
                    if full:
                        every, cuts = np.concatenate(full), np.cumsum([0, *(len(s) for s in full[:-1])])
                        set_a[n > 0] = mix(np.add.reduceat(every, cuts))
                        set_b[n > 0] = np.add.reduceat(mix(every ^ _place[0]), cuts)
                        minwise[n > 0] = tokens(full)
                    raw = pa.Array.from_buffers(pa.binary(TOKENS * 4), len(sets), [None, pa.py_buffer(minwise.tobytes())]).cast(pa.binary())
                    yield pa.RecordBatch.from_arrays([batch.column("doc_id").slice(at + a, len(part)), batch.column("text_hash").slice(at + a, len(part)), pa.array(n), _long(set_a), _long(set_b), raw], _names(SETS))

    return run


def children(path: np.ndarray, minwise: np.ndarray, join: Join) -> tuple[np.ndarray, np.ndarray]:
    """(row, child's path) of each chosen token: one for each row, another for some paths."""
    rows = np.arange(len(path))
    one = (path % _U(TOKENS)).astype(np.int64)
    more = np.flatnonzero(((path >> _U(32)) & _U(0xFFFF)) < _U(join.second_branch))
    two = ((path[more] >> _U(16)) % _U(TOKENS)).astype(np.int64)
    row, choice = np.concatenate((rows, more)), np.concatenate((one, two))
    return row, mix(path[row] + choice.astype(_U) * _place[1] + mix(minwise[row, choice].astype(_U) + _place[2]))


def _matrix(column) -> np.ndarray:
    raw = b"".join(x.as_py() for x in column)
    return np.frombuffer(raw, np.uint32).reshape(-1, TOKENS)


def _branching(join: Join, first: bool) -> Callable:
    roots = mix(np.arange(1, join.trees + 1, dtype=_U) * _place[3])

    def run(batches):
        import pyarrow as pa

        for batch in batches:
            if not batch.num_rows:
                continue
            minwise, node = _matrix(batch.column("tokens")), batch.column("node").to_numpy(zero_copy_only=False)
            for path in [np.full(len(node), r, _U) for r in roots] if first else [batch.column("path").to_numpy(zero_copy_only=False).view(_U)]:
                row, child = children(path, minwise, join)
                yield pa.RecordBatch.from_arrays([_long(child), pa.array(node[row])], ["path", "node"])

    return run


def _in_groups(batches, keys: tuple[str, ...]) -> Iterator[dict[str, object]]:
    """Whole groups of rows that are sorted by their keys, many groups to a table; a group isn't cut."""
    import pyarrow as pa

    rest = None
    for batch in batches:
        now = pa.Table.from_batches([batch])
        rest = now if rest is None else pa.concat_tables([rest, now])
        if rest.num_rows < 2000:
            continue
        change = np.zeros(rest.num_rows, bool)
        for k in keys:
            x = rest.column(k).to_numpy()
            change[1:] |= x[1:] != x[:-1]
        cuts = np.flatnonzero(change)
        if len(cuts):
            yield rest.slice(0, int(cuts[-1]))
            rest = rest.slice(int(cuts[-1]))
    if rest is not None and rest.num_rows:
        yield rest


def _groups(table_, keys: tuple[str, ...]) -> np.ndarray:
    change = np.zeros(table_.num_rows, bool)
    change[0] = True
    for k in keys:
        x = table_.column(k).to_numpy()
        change[1:] |= x[1:] != x[:-1]
    return np.append(np.flatnonzero(change), table_.num_rows)


def forest(n: int, similar: Callable[[int, np.ndarray], np.ndarray]) -> list[tuple[int, int]]:
    """Edges that connect what similar(i, others) pairs connect; pairs already connected aren't compared."""
    label, out = np.arange(n), []
    for i in range(n - 1):
        others = np.flatnonzero(label[i + 1 :] != label[i]) + i + 1
        if not len(others):
            continue
        for j in others[similar(i, others)].tolist():
            if label[j] != label[i]:
                label[label == label[j]] = label[i]
                out.append((i, j))
    return out


def _sized(n: np.ndarray, i: int, others: np.ndarray, percent: int) -> np.ndarray:
    return 100 * np.minimum(n[i], n[others]) >= percent * np.maximum(n[i], n[others])


LEAF_KEYS = ("path", "part_a", "part_b")


def _leaves(join: Join) -> Callable:
    def run(batches):
        import pyarrow as pa

        for t in _in_groups(batches, LEAF_KEYS):
            node, n = t.column("node").to_numpy(), t.column("n_shingles").to_numpy()
            sketch = np.frombuffer(b"".join(x.as_py() for x in t.column("sketch")), np.uint8).reshape(-1, TOKENS)
            cuts, pairs = _groups(t, LEAF_KEYS), []
            sizes = np.diff(cuts)
            small = np.repeat(np.where(sizes <= 12, np.arange(len(sizes)), -1), sizes)
            parent = list(range(len(node)))

            def root(x):
                while parent[x] != x:
                    parent[x] = parent[parent[x]]
                    x = parent[x]
                return x

            for k in range(1, 12):
                rows = np.flatnonzero((small[:-k] == small[k:]) & (small[k:] >= 0)) if len(small) > k else []
                if not len(rows):
                    break
                rows = rows[100 * np.minimum(n[rows], n[rows + k]) >= join.percent * np.maximum(n[rows], n[rows + k])]
                for r in rows[(sketch[rows] == sketch[rows + k]).sum(1) >= join.least_tokens].tolist():
                    a, b = root(r), root(r + k)
                    if a != b:
                        parent[b] = a
                        pairs.append((r, r + k))
            for a, b in zip(cuts[:-1][sizes > 12].tolist(), cuts[1:][sizes > 12].tolist()):
                s, m = sketch[a:b], n[a:b]
                near = lambda i, o, s=s, m=m: _sized(m, i, o, join.percent) & ((s[o] == s[i]).sum(1) >= join.least_tokens)
                pairs += [(a + i, a + j) for i, j in forest(b - a, near)]
            if pairs:
                p = np.array(pairs)
                yield pa.RecordBatch.from_arrays([pa.array(node[p[:, 0]]), pa.array(node[p[:, 1]])], ["a", "b"])

    return run


CLUSTER_KEYS = ("cluster", "part_a", "part_b")


def links(sets: list[np.ndarray], percent: int) -> list[tuple[int, int]]:
    """A spanning forest of the links between sets, each confirmed on whole sets."""
    n = np.array([len(s) for s in sets])
    every, ids = np.unique(np.concatenate(sets), return_inverse=True)
    starts = np.cumsum(n) - n
    held = np.zeros(len(every), np.int32)

    def linked(i: int, others: np.ndarray) -> np.ndarray:
        out = _sized(n, i, others, percent)
        some = others[out]
        if len(some):
            mine = ids[starts[i] : starts[i] + n[i]]
            held[mine] = 1
            if len(some) * 4 > len(sets):
                both = np.add.reduceat(held[ids], starts)[some]
            else:
                both = np.array([held[ids[starts[j] : starts[j] + n[j]]].sum() for j in some.tolist()])
            held[mine] = 0
            out[out] = 100 * both >= percent * (n[i] + n[some] - both)
        return out

    return forest(len(sets), linked)


def _confirming(join: Join, keys: tuple[str, ...]) -> Callable:
    def run(batches):
        import pyarrow as pa

        for t in _in_groups(batches, keys):
            node, set_a, set_b = (t.column(c).to_numpy() for c in ("node", "set_a", "set_b"))
            cuts, found = _groups(t, keys), []
            texts = t.column("text")
            # Several groups to a part, by their bytes.
            a = 0
            while a < len(cuts) - 1:
                b, size, part = a, 0, []
                while b < len(cuts) - 1 and (b == a or size < SLICE):
                    new = [(x.as_py() or "").encode("utf-8", "surrogatepass") for x in texts.slice(int(cuts[b]), int(cuts[b + 1] - cuts[b]))]
                    part += new
                    size += sum(map(len, new))
                    b += 1
                sets = [s for _, p in _parts(part) for s in shingles(p, join.words)]
                same = np.array([len(s) > 0 and _named(s) == (set_a[cuts[a] + i], set_b[cuts[a] + i]) for i, s in enumerate(sets)])
                for g in range(a, b):
                    rows = np.arange(cuts[g], cuts[g + 1])
                    rows = rows[same[rows - cuts[a]]]
                    _, once = np.unique(node[rows], return_index=True)
                    rows = rows[once]
                    if len(rows) > 1:
                        found += [(rows[i], rows[j]) for i, j in links([sets[r - cuts[a]] for r in rows], join.percent)]
                a = b
            if found:
                p = np.array(found)
                yield pa.RecordBatch.from_arrays([pa.array(node[p[:, 0]]), pa.array(node[p[:, 1]])], ["a", "b"])

    return run


def _named(s: np.ndarray) -> tuple[int, int]:
    """set_a and set_b of a set, as ``_setting`` makes them."""
    return int(mix(s.sum(keepdims=True)).view(np.int64)[0]), int(mix(s ^ _place[0]).sum(keepdims=True).view(np.int64)[0])


def _blocked(rows: DataFrame, key: str, blocks) -> DataFrame:
    """Rows with part_a and part_b: a row of block x goes to every pair of blocks that has x."""
    rows = rows.withColumn("_n", blocks).withColumn("_x", F.pmod(F.xxhash64("node"), F.col("_n")))
    rows = rows.withColumn("_y", F.explode(F.sequence(F.lit(0).cast("long"), F.col("_n") - 1)))
    return rows.withColumn("part_a", F.least("_x", "_y")).withColumn("part_b", F.greatest("_x", "_y")).drop("_n", "_x", "_y")


def _tree_edges(nodes: DataFrame, join: Join) -> tuple[DataFrame, DataFrame]:
    """Candidate edges (a, b) of nodes (node, n_shingles, tokens), from the leaves of all trees; and the leaves'
    members (node and LEAF_KEYS)."""
    rows = stored(nodes.select("node", "tokens").mapInArrow(_branching(join, True), "path long, node long"), "paths")
    leaves = []
    for depth in range(1, join.depth + 1):
        sizes = rows.groupBy("path").agg(F.count("*").alias("n"), F.sum(F.shiftrightunsigned(F.xxhash64("node"), 32)).alias("s"), F.bit_xor("node").alias("x")).where("n > 1")
        sizes = stored(sizes, "path-sizes")
        ends = sizes if depth == join.depth else sizes.where(F.col("n") <= join.leaf)
        # Trees often end in leaves of the same members; one of each is enough.
        ends = ends.groupBy("n", "s", "x").agg(F.min("path").alias("path")).select("path", "n")
        leaves.append(rows.join(ends, "path"))
        if depth == join.depth:
            break
        large = sizes.where(F.col("n") > join.leaf).select("path")
        if large.isEmpty():
            break
        rows = rows.join(large, "path", "left_semi").join(nodes.select("node", "tokens"), "node")
        rows = stored(rows.mapInArrow(_branching(join, False), "path long, node long"), "paths")
    members = leaves[0]
    for x in leaves[1:]:
        members = members.unionByName(x)
    members = _blocked(members, "path", F.ceil(F.col("n") / join.block)).select("node", *LEAF_KEYS)
    sketches = nodes.select("node", "n_shingles", "tokens").mapInArrow(_sketching, "node long, n_shingles long, sketch binary")
    rows = members.join(sketches, "node").repartition(*LEAF_KEYS).sortWithinPartitions(*LEAF_KEYS)
    return rows.mapInArrow(_leaves(join), "a long, b long"), members


def _sketching(batches):
    """The low byte of each token."""
    import pyarrow as pa

    for batch in batches:
        low = np.ascontiguousarray(_matrix(batch.column("tokens")).view(np.uint8)[:, ::4]) if batch.num_rows else np.zeros((0, TOKENS), np.uint8)
        raw = pa.Array.from_buffers(pa.binary(TOKENS), len(low), [None, pa.py_buffer(low.tobytes())]).cast(pa.binary())
        yield pa.RecordBatch.from_arrays([batch.column("node"), batch.column("n_shingles"), raw], ["node", "n_shingles", "sketch"])


def _text_hash(docs: DataFrame) -> Column:
    return F.xxhash64(docs["text"].cast("string"))


def _grouped(docs: DataFrame, join: Join | None = None) -> DataFrame:
    """(doc_id, text_hash, n_shingles, component, component_id, set_a, set_b) of each row; rows without shingles have
    no component. Ids may repeat, so a row is found by its id and its text's hash."""
    join = join or Join()
    docs = small_batches(docs)
    docs = docs.select(F.col("doc_id").cast("long"), F.col("text").cast("string"), _text_hash(docs).alias("text_hash"))
    sets = stored(docs.mapInArrow(_setting(join), SETS), "sets")
    full = sets.where("n_shingles > 0")
    nodes = full.groupBy("set_a", "set_b").agg(F.min(F.struct(F.col("doc_id").isNull().alias("no"), "doc_id", "text_hash", "n_shingles", "tokens")).alias("x"))
    nodes = stored(nodes.select(F.col("set_a").alias("node"), "set_a", "set_b", "x.doc_id", "x.text_hash", "x.n_shingles", "x.tokens"), "nodes")
    # Mostly no sets share their first hash, and then the nodes needn't move again.
    shared = nodes.groupBy(F.col("set_a").alias("shared")).agg(F.count("*").alias("n"), F.min("set_b").alias("least")).where("n > 1").select("shared", "least")
    shared = stored(shared, "shared-hashes")
    if not shared.isEmpty():
        name = F.when(F.col("set_b") > F.col("least"), F.xxhash64("set_a", "set_b")).otherwise(F.col("set_a"))
        nodes = stored(nodes.join(shared, F.col("set_a") == F.col("shared"), "left").withColumn("node", name).drop("shared", "least"), "nodes")
    edges, leaves = _tree_edges(nodes, join)
    candidates = connected_components(edges, stored)
    # Those with a candidate, and how many blocks their group needs.
    members = candidates.select("node", F.col("component").alias("cluster")).join(nodes.select("node", "set_a", "set_b", "doc_id", "text_hash", "n_shingles"), "node")
    members = stored(members, "members")
    sizes = members.groupBy("cluster").agg(F.ceil(F.greatest(F.count("*") / join.block, F.sum("n_shingles") / join.block_shingles)).alias("blocks"))
    members = members.join(sizes, "cluster").select("node", "set_a", "set_b", "cluster", "doc_id", "text_hash", "blocks")
    few = members.count() <= BROADCAST_MEMBERS
    members = F.broadcast(members) if few else members
    texts = docs.join(members, docs["doc_id"].eqNullSafe(members["doc_id"]) & (docs["text_hash"] == members["text_hash"])).select("node", "set_a", "set_b", "cluster", "blocks", "text")
    own = ("node", "set_a", "set_b", "text")
    small = _blocked(texts.where(F.col("blocks") <= join.spread), "cluster", F.col("blocks")).select(*own, *CLUSTER_KEYS)
    confirmed = small.repartition(*CLUSTER_KEYS).sortWithinPartitions(*CLUSTER_KEYS).mapInArrow(_confirming(join, CLUSTER_KEYS), "a long, b long")
    if not sizes.where(F.col("blocks") > join.spread).isEmpty():
        large = texts.where(F.col("blocks") > join.spread).join(leaves, "node").select(*own, *LEAF_KEYS)
        confirmed = confirmed.unionByName(large.repartition(*LEAF_KEYS).sortWithinPartitions(*LEAF_KEYS).mapInArrow(_confirming(join, LEAF_KEYS), "a long, b long"))
    linked = connected_components(confirmed, stored)
    named = nodes.select("node", "set_a", "set_b", "doc_id").join(linked, "node", "left").withColumn("component", F.coalesce("component", "node"))
    least = named.groupBy("component").agg(F.min("doc_id").alias("component_id"))
    names = named.join(least, "component").select("set_a", "set_b", "component", "component_id")
    empty = sets.where("n_shingles = 0").drop("tokens").withColumns({"component": F.lit(None).cast("long"), "component_id": F.col("doc_id")})
    return full.drop("tokens").join(names, ["set_a", "set_b"]).unionByName(empty)


def near_duplicates(docs: DataFrame, join: Join | None = None) -> DataFrame:
    """(doc_id, n_shingles, component_id, kept, set_a, set_b) of each row."""
    rows = _grouped(docs, join)
    return rows.select("doc_id", "n_shingles", "component_id", F.col("doc_id").eqNullSafe(F.col("component_id")).alias("kept"), "set_a", "set_b")


def without_copies(docs: DataFrame, join: Join | None = None) -> DataFrame:
    """One row of each component, of its smallest id, with its columns; null ids come last, and of several texts with
    that id one stays. Rows with empty sets all stay."""
    keys = _grouped(docs, join).where("n_shingles > 0").groupBy("component", "doc_id", "text_hash").agg(F.count("*").alias("n"))
    keys = keys.select("component", "n", F.struct(F.col("doc_id").isNull().alias("no"), "doc_id", "text_hash").alias("key"))
    groups = keys.groupBy("component").agg(F.min("key").alias("first"), F.sum("n").alias("rows")).where(F.col("rows") > 1)
    keys = keys.join(groups, "component").withColumn("goes", F.col("key") != F.col("first")).where(F.col("goes") | (F.col("n") > 1))
    key, mark = unused(docs, "copy_id", "copy_hash")
    keys = stored(keys.select(F.col("key.doc_id").alias(key), F.col("key.text_hash").alias(mark), "goes"), "copies")

    def among(rows: DataFrame, how: str) -> DataFrame:
        rows = rows.select(key, mark)
        wide = F.broadcast(rows) if few else rows
        return docs.join(wide, docs["doc_id"].cast("long").eqNullSafe(wide[key]) & (_text_hash(docs) == wide[mark]), how)

    few = keys.count() <= BROADCAST_MEMBERS
    kept, again = among(keys, "left_anti"), keys.where("NOT goes")
    return kept if again.isEmpty() else kept.unionByName(among(again, "left_semi").dropDuplicates(["doc_id", "text"]))


def op5_near_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return near_duplicates(table(spark, sf_dir, "documents")).select("doc_id", "n_shingles", "component_id", "kept")


QUERIES = {"op5_near_dedup": op5_near_dedup}
ORACLES = {
    "op5_near_dedup": r"""
WITH RECURSIVE w AS (
  SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x20\x09-\x0D]+') AS w FROM documents
), s AS (
  SELECT doc_id, list_distinct(CASE WHEN len(w) >= 3 THEN list_transform(range(1, len(w) - 1), lambda i: w[i] || ' ' || w[i + 1] || ' ' || w[i + 2])
    WHEN len(w) > 0 THEN [array_to_string(w, ' ')] ELSE [] END) AS s FROM w
), e AS (SELECT doc_id, len(s) AS n, unnest(s) AS x FROM s),
pairs AS (SELECT a.doc_id AS a, b.doc_id AS b, any_value(a.n) AS na, any_value(b.n) AS nb, count(*) AS c FROM e a JOIN e b ON a.x = b.x AND a.doc_id <> b.doc_id GROUP BY 1, 2),
l AS (SELECT a, b FROM pairs WHERE 100 * c >= 85 * (na + nb - c)),
walk AS (SELECT doc_id AS node, doc_id AS other FROM documents UNION SELECT node, b FROM walk JOIN l ON a = other),
least AS (SELECT node, min(other) AS component_id FROM walk GROUP BY node)
SELECT doc_id, CAST(len(s) AS BIGINT) AS n_shingles, component_id, doc_id = component_id AS kept FROM s JOIN least ON node = doc_id"""
}
