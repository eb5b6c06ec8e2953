"""Approximate nearest neighbours by multi-index hashing.

Vectors become binary codes: centred, rotated by learned orthogonal matrices (iterative quantization on
principal axes, one for each 64-bit word of the code) and cut at zero. Codes are split into substrings,
and each substring of the rows at hand is indexed by its value. Two codes within Hamming radius r agree
in some substring within r // (number of substrings), so probing all values that near in every substring's table
finds every code within r; the codes' distance confirms them, and the vectors rerank them.

Rotations, radius and the substrings' length are fitted on at most ``SAMPLE`` vectors (by a hash of the id); the
radius is the least that keeps ``TARGET`` of the sample queries' true neighbours, the length the one of ``LENGTHS``
that leaves least to compare: short ones where neighbours' codes are near, long ones where they are far, as then
most rows agree in some short one. Every row is indexed. Rows don't move: each
task indexes its own in parts of bounded size and streams the query vectors from the shared folder in
blocks, keeping the best k of each query; only those are shuffled. Queries that find fewer than k in the
radius search all rows in a second pass.

Defined results: vectors that are null, zero, hold null or non-finite numbers or have another length than
most of the sample take no part; equal distances go to the smaller id; rows that repeat an id are candidates
each, but a query's own id is none; an empty table gives no rows; further columns are ignored.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from weftgraph.llm.common import fresh_path, one_thread, open_uri, table

SAMPLE, SAMPLE_QUERIES, TARGET = 8192, 256, 0.97
WORDS, SEED = 4, 5
#: Bits of a substring that are tried.
LENGTHS = (16, 32, 64, 128)
#: Rows that are indexed, and queries that are searched, at a time.
ROWS, QUERY_BLOCK, PROBED = 1 << 15, 1024, 64
EVERY, K = 100, 10


def fit_rotations(sample: np.ndarray, words: int = WORDS, rounds: int = 20) -> tuple[np.ndarray, np.ndarray]:
    """The mean, and a matrix to words * 64 bits. Vectors of fewer axes get more rotations of them."""
    mean = sample.mean(0)
    x = sample - mean
    values, axes = np.linalg.eigh(x.T @ x)
    r = np.random.default_rng(SEED)
    dims, out, width = x.shape[1], [], 0
    while width < words * 64:
        d = min(dims, words * 64 - width, 64)
        basis = axes[:, np.argsort(values)[::-1][:d]]
        v = x @ basis
        rotation = np.linalg.qr(r.normal(size=(d, d)))[0]
        for _ in range(rounds):
            u, _s, w = np.linalg.svd(np.where(v @ rotation >= 0, 1.0, -1.0).T @ v)
            rotation = (u @ w).T
        out.append(basis @ rotation)
        width += d
    return mean, np.concatenate(out, 1)


def encode(vectors: np.ndarray, mean: np.ndarray, matrix: np.ndarray) -> np.ndarray:
    """Codes as rows of 64-bit words."""
    return np.packbits((vectors - mean) @ matrix >= 0, axis=1, bitorder="little").view(np.uint64)


def hamming(code: np.ndarray, codes: np.ndarray) -> np.ndarray:
    return np.bitwise_count(codes ^ code).sum(1, dtype=np.int64)


def distances(query: np.ndarray, vectors: np.ndarray) -> np.ndarray:
    return np.sqrt(((vectors - query) ** 2).sum(1))


def fit(sample: np.ndarray, k: int = K) -> tuple[np.ndarray, np.ndarray, int, int]:
    """Mean, matrix, radius and the bits of a substring."""
    mean, matrix = fit_rotations(sample)
    codes = encode(sample, mean, matrix)
    far: list[int] = []
    for i in range(0, len(sample), max(1, len(sample) // SAMPLE_QUERIES)):
        d = distances(sample[i], sample)
        d[i] = np.inf
        near = np.argsort(d, kind="stable")[: min(k, len(d) - 1)]
        far += hamming(codes[i], codes[near]).tolist()
    far.sort()
    radius = far[min(len(far) - 1, int(np.ceil(TARGET * len(far))) - 1)] if far else codes.shape[1] * 64
    probes = codes[:: max(1, len(sample) // PROBED)]

    def work(bits: int) -> float:
        """About the operations for each row: words of the tables' values, and its code and place if it passes."""
        index = Index(codes, bits)
        return sum(t[0].size for t in index.tables) / len(codes) + 40 * float(index.probe(probes, radius).mean())

    return mean, matrix, radius, min(LENGTHS, key=work)


class Index:
    """One table for each substring: its values among the rows, and the rows of each value."""

    def __init__(self, codes: np.ndarray, bits: int = LENGTHS[0]):
        self.codes = codes
        unit = min(bits, 64)
        #: Of each substring: the values, as words; the rows in order of their value; the value of each of those.
        self.tables = []
        for part in np.split(codes.view(f"<u{unit // 8}"), codes.shape[1] * 64 // bits, axis=1):
            order = np.lexsort(part.T)
            part = part[order]
            new = np.ones(len(part), bool)
            new[1:] = (part[1:] != part[:-1]).any(1)
            self.tables.append((np.ascontiguousarray(part[new].T), order, np.cumsum(new) - 1))

    def probe(self, codes: np.ndarray, radius: int) -> np.ndarray:
        """For each code the rows, as flags, that agree with it in some substring within the radius's share."""
        seen = np.zeros((len(codes), len(self.codes)), bool)
        least = radius // len(self.tables)
        for (values, order, value), part in zip(self.tables, np.split(codes.view(self.tables[0][0].dtype), len(self.tables), axis=1)):
            far = np.bitwise_count(part[:, :1] ^ values[0]).astype(np.uint8)
            for k in range(1, len(values)):
                far += np.bitwise_count(part[:, k : k + 1] ^ values[k])
            seen[:, order] |= (far <= least)[:, value]
        return seen

    def search(self, codes: np.ndarray, radius: int) -> Iterator[np.ndarray]:
        """For each code all rows whose codes are within the radius."""
        for a in range(0, len(codes), PROBED):
            for code, seen in zip(codes[a : a + PROBED], self.probe(codes[a : a + PROBED], radius)):
                rows = np.flatnonzero(seen)
                yield rows[hamming(code, self.codes[rows]) <= radius]

    def within(self, code: np.ndarray, radius: int) -> np.ndarray:
        return next(self.search(code[None], radius))


def best(ids: np.ndarray, d: np.ndarray, k: int) -> np.ndarray:
    """Places of the k smallest by (distance, id)."""
    if len(d) > 4 * k:
        some = np.flatnonzero(d <= np.partition(d, k - 1)[k - 1])
        return some[np.lexsort((ids[some], d[some]))[:k]]
    return np.lexsort((ids, d))[:k]


def _blocks(folder: str, at: int = QUERY_BLOCK) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """(ids, vectors) of the stored queries, so many at a time."""
    import pyarrow.dataset as ds

    files, path = open_uri(folder)
    for batch in ds.dataset(path, filesystem=files, format="parquet").to_batches(columns=["vec_id", "v"], batch_size=at):
        if batch.num_rows:
            yield batch.column("vec_id").to_numpy(), _matrix(batch.column("v"))


def _matrix(column) -> np.ndarray:
    values = column.flatten().to_numpy(zero_copy_only=False).astype(np.float64)
    return values.reshape(len(column), -1)


FOUND = "query_id long, vec_id long, score double"


def _searching(folder: str, model, k: int) -> Callable:
    """model: mean, matrix, radius and substrings' bits, or None to search all rows."""

    def run(batches):
        import pyarrow as pa

        def search(ids: np.ndarray, vectors: np.ndarray):
            index = Index(encode(vectors, *model[:2]), model[3]) if model else None
            for query_ids, queries in _blocks(folder):
                out: list[tuple[np.ndarray, ...]] = []
                found = index.search(encode(queries, *model[:2]), model[2]) if model else (np.arange(len(ids)) for _ in queries)
                for q, rows in enumerate(found):
                    rows = rows[ids[rows] != query_ids[q]]
                    if len(rows):
                        d = distances(queries[q], vectors[rows])
                        top = best(ids[rows], d, k)
                        out.append((np.full(len(top), query_ids[q]), ids[rows[top]], d[top]))
                if out:
                    yield pa.RecordBatch.from_arrays([pa.array(np.concatenate(c)) for c in zip(*out)], ["query_id", "vec_id", "score"])

        ids, vectors, n = [], [], 0
        for batch in batches:
            if batch.num_rows:
                ids.append(batch.column("vec_id").to_numpy())
                vectors.append(_matrix(batch.column("v")))
                n += batch.num_rows
            if n >= ROWS:
                yield from search(np.concatenate(ids), np.concatenate(vectors))
                ids, vectors, n = [], [], 0
        if n:
            yield from search(np.concatenate(ids), np.concatenate(vectors))

    return run


def nearest(vectors: DataFrame, queries: DataFrame, k: int = K) -> DataFrame:
    """(query_id, rank, vec_id, score): for each query (vec_id, embedding) its k nearest vectors."""
    spark = vectors.sparkSession

    def usable(df: DataFrame) -> DataFrame:
        v = F.transform(F.col("embedding"), lambda x: x.cast("double"))
        df = df.select(F.col("vec_id").cast("long"), v.alias("v")).where(F.col("vec_id").isNotNull() & F.col("v").isNotNull() & (F.size("v") > 0))
        finite = F.forall("v", lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) != float("inf")))
        return df.where(finite & F.exists("v", lambda x: x != 0))

    rows, empty = usable(vectors), spark.createDataFrame([], "query_id long, rank int, vec_id long, score double")
    sample = rows.withColumn("_o", F.xxhash64("vec_id")).orderBy("_o", "vec_id").limit(SAMPLE).select("v").collect()
    sizes = [len(r["v"]) for r in sample]
    if not sizes:
        return empty
    dims = max(sorted(set(sizes)), key=sizes.count)
    rows = rows.where(F.size("v") == dims)
    with one_thread():
        model = fit(np.array([r["v"] for r in sample if len(r["v"]) == dims]), k)
    folder = fresh_path(spark, "queries")
    usable(queries).where(F.size("v") == dims).write.parquet(folder)
    asked = spark.read.schema("vec_id long, v array<double>").parquet(folder)

    def merged(found: DataFrame) -> DataFrame:
        by = Window.partitionBy("query_id").orderBy("score", "vec_id")
        return found.withColumn("rank", F.row_number().over(by)).where(F.col("rank") <= k)

    found = merged(rows.mapInArrow(_searching(folder, model, k), FOUND))
    path = fresh_path(spark, "neighbours")
    found.write.parquet(path)
    found = spark.read.schema(found.schema).parquet(path)
    full = found.groupBy("query_id").agg(F.count("*").alias("n")).where(F.col("n") >= k)
    few = asked.join(full, asked["vec_id"] == full["query_id"], "left_anti")
    if not few.isEmpty():
        rest = fresh_path(spark, "queries")
        few.write.parquet(rest)
        found = found.join(full.select("query_id"), "query_id", "left_semi").unionByName(merged(rows.mapInArrow(_searching(rest, None, k), FOUND)))
    return found.select("query_id", "rank", "vec_id", "score")


def op6_neighbours(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = table(spark, sf_dir, "embeddings")
    return nearest(rows, rows.where(F.col("vec_id") % EVERY == 0))


QUERIES = {"op6_neighbours": op6_neighbours}
ORACLES: dict[str, str] = {}
