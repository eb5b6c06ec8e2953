"""Packing documents into sequences of a fixed length: shortest-pack-first over the length histogram.

Documents are tokenized and cut at every ``limit`` ids; whole cuts fill a sequence each. For the rest only
the histogram of lengths (at most ``limit`` numbers, whatever the input) comes to the driver. Lengths are
placed longest first: all pieces of a length go to the packs with most room left, whose patterns and counts
are updated. Each pattern then takes pieces by their rank within their length.

Ranks are found without collecting a length in one task: pieces are range-partitioned by (length, doc_id,
start), numbered in their partition, and moved by the pieces of that length in earlier partitions.

Defined results: null and empty texts hold the end id alone; equal rows are packed each; null ids are kept;
an empty table gives no rows; further columns are ignored (``pack`` keeps none but its own).
"""

from __future__ import annotations

import zlib
from collections.abc import Callable

import numpy as np
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from weftgraph.llm.common import small_batches, stored, table
from weftgraph.llm.tokens import END_BYTES, default_vocabulary, encoder

LIMIT = 2048
PIECES = "doc_id long, start long, length int, ids_crc32 long, doc_tokens long"


def _cutting(vocabulary: str, limit: int) -> Callable:
    def cut(batches):
        import pyarrow as pa

        names = [x.split()[0] for x in PIECES.split(", ")]
        for batch in batches:
            rows: list[tuple] = []
            ids_of = batch.column("doc_id").to_pylist()
            for a in range(0, batch.num_rows, 500):
                for doc, raw in zip(ids_of[a : a + 500], encoder(vocabulary).encode(batch.column("text").slice(a, 500).to_pylist())):
                    raw += END_BYTES
                    n = len(raw) // 4
                    for s in range(0, n, limit):
                        piece = raw[s * 4 : (s + limit) * 4]
                        rows.append((doc, s, len(piece) // 4, zlib.crc32(piece), n))
            kinds = (pa.int64(), pa.int64(), pa.int32(), pa.int64(), pa.int64())
            yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(zip(*rows) if rows else [()] * 5, kinds)], names)

    return cut


def shortest_pack_first(histogram: np.ndarray, limit: int) -> list[tuple[int, tuple[int, ...]]]:
    """Patterns (count, lengths) that hold histogram[n] pieces of each length n, 1 to limit."""
    room: dict[int, list[list]] = {}  # by room left: [count, lengths]
    for n in range(limit, 0, -1):
        left = int(histogram[n]) if n < len(histogram) else 0
        while left:
            free = max((r for r in room if r >= n), default=0)
            if not free:
                room.setdefault(limit - n, []).append([left, (n,)])
                break
            packs = room[free]
            take = min(left, packs[-1][0])
            lengths = (*packs[-1][1], n)
            packs[-1][0] -= take
            if not packs[-1][0]:
                packs.pop()
                if not packs:
                    del room[free]
            room.setdefault(free - n, []).append([take, lengths])
            left -= take
    return [(c, lengths) for r in sorted(room) for c, lengths in room[r]]


def slots(patterns: list[tuple[int, tuple[int, ...]]]) -> dict[int, tuple[np.ndarray, ...]]:
    """For each length: the first rank of each run of places, and the run's first sequence and offset."""
    runs: dict[int, list[tuple[int, int, int]]] = {}
    used: dict[int, int] = {}
    sequence = 0
    for count, lengths in patterns:
        offset = 0
        for n in lengths:
            runs.setdefault(n, []).append((used.get(n, 0), sequence, offset))
            used[n] = used.get(n, 0) + count
            offset += n
        sequence += count
    return {n: tuple(np.array(x, np.int64) for x in zip(*r)) for n, r in runs.items()}


def _placing(runs: dict[int, tuple[np.ndarray, ...]]) -> Callable:
    def place(batches):
        import pyarrow as pa

        for batch in batches:
            length, rank = batch.column("length").to_numpy(zero_copy_only=False), batch.column("rank").to_numpy(zero_copy_only=False)
            sequence, offset = np.zeros(len(rank), np.int64), np.zeros(len(rank), np.int64)
            for n in np.unique(length):
                first, s, o = runs[int(n)]
                at = length == n
                k = np.searchsorted(first, rank[at], side="right") - 1
                sequence[at], offset[at] = s[k] + rank[at] - first[k], o[k]
            kept = [batch.column(x.split()[0]) for x in PIECES.split(", ")]
            yield pa.RecordBatch.from_arrays([*kept, pa.array(sequence), pa.array(offset)], [*(x.split()[0] for x in PIECES.split(", ")), "sequence_id", "offset"])

    return place


def pack(docs: DataFrame, vocabulary: str, limit: int = LIMIT) -> DataFrame:
    """A row for each piece of each document, with its sequence and its offset there."""
    docs = small_batches(docs).select(F.col("doc_id").cast("long"), F.col("text").cast("string"))
    pieces = stored(docs.mapInArrow(_cutting(vocabulary, limit), PIECES), "pieces")
    order = (F.col("length"), F.col("doc_id"), F.col("start"))
    # The id holds the partition and the row's number there; it is stored, so that it's the same later.
    numbered = stored(
        pieces.repartitionByRange(*order).sortWithinPartitions(*order).withColumn("_id", F.monotonically_increasing_id()).withColumn("_part", F.shiftright("_id", 33)),
        "pieces-by-length",
    )
    # Ranges of lengths: at most as many rows as lengths and partitions together.
    ranges = numbered.groupBy("length", "_part").agg(F.count("*").alias("n"), F.min("_id").alias("first")).collect()
    histogram = np.zeros(limit + 1, np.int64)
    base = []
    for r in sorted(ranges, key=lambda r: (r["length"], r["_part"])):
        base.append((r["length"], r["_part"], r["first"], int(histogram[r["length"]])))
        histogram[r["length"]] += r["n"]
    runs = slots(shortest_pack_first(histogram, limit))
    spark = docs.sparkSession
    before = spark.createDataFrame(base, "length int, _part long, _first long, _before long")
    ranked = numbered.join(F.broadcast(before), ["length", "_part"]).withColumn("rank", F.col("_id") - F.col("_first") + F.col("_before"))
    return ranked.select(*(x.split()[0] for x in PIECES.split(", ")), "rank").mapInArrow(_placing(runs), PIECES + ", sequence_id long, offset long").withColumn("length", F.col("length").cast("long"))


def op10_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pack(table(spark, sf_dir, "documents"), default_vocabulary())


QUERIES = {"op10_packing": op10_packing}
ORACLES: dict[str, str] = {}
