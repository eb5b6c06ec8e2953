"""Quality classifier: a convolutional network over bytes, in numpy.

Bytes are embedded; filters of 8 bytes move over the text by 4; a chunk is 256 bytes, by 128 (overlapping,
so that chunks cover the whole document); in each chunk the filters' means and maxima feed a hidden layer,
whose units are max-pooled over all chunks of the document and combined into one probability.

Training takes at most ``SAMPLE`` labelled rows of each class, the first by a hash of the id, and their whole
texts. The sample is joined by broadcast (its size is that bound), so other texts don't move. Texts of any
length are gone through in windows that meet chunk by chunk, so the chunks are those of the whole text; as each
unit's maximum lies in one chunk, long texts send errors back through those chunks alone.

Defined results: null and empty texts count as one chunk of padding; without labels of both classes the
score is the share of label 1 (0.5 without labels); repeated rows get equal scores; an empty table gives no
rows; further columns are kept by ``score``, whatever their names; null labels and labels other than 0 and 1
aren't learned from; of rows that share a labelled id, the first by their texts' hashes are, within the bound.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from weftgraph.llm.common import bucket, by_place, one_thread, only, quoted, table, unused

#: Labelled rows of each class that are learned from at most.
SAMPLE = 700
EPOCHS, BATCH, RATE, SEED = 14, 24, 0.004, 7
#: Small samples are gone through more often, for about as many steps; so often at most.
STEPS, MOST_EPOCHS = 800, 60
EMBED, FILTERS, HIDDEN, STRIDE = 8, 32, 24, 4
BLOCK = 128  # bytes; a chunk is two blocks
ROWS = BLOCK // STRIDE
THRESHOLD = 0.3
#: Bytes of texts that are worked on at a time, and from which a text's errors go through its maxima's chunks alone.
SLICE, LONG = 1 << 18, 1 << 13


def layout(texts: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
    """The texts' bytes after one another, each padded to whole blocks (two at least), and its blocks."""
    blocks = np.array([max(2, -(-(len(t) + STRIDE) // BLOCK)) for t in texts])
    out = np.zeros(int(blocks.sum()) * BLOCK, np.uint8)
    at = 0
    for t, n in zip(texts, blocks.tolist()):
        out[at : at + len(t)] = np.frombuffer(t, np.uint8)
        at += n * BLOCK
    return out, blocks


class Network:
    def __init__(self, seed: int = SEED):
        r = np.random.default_rng(seed)
        normal = lambda *s: r.normal(0, 1, s).astype(np.float32)
        self.p = {
            "embed": normal(256, EMBED) * 0.5,
            "filters": normal(STRIDE * EMBED, 2 * FILTERS) / np.float32(np.sqrt(2 * STRIDE * EMBED * 0.25)),
            "filters_b": np.zeros(FILTERS, np.float32),
            "hidden": normal(2 * FILTERS, HIDDEN) / np.float32(np.sqrt(2 * FILTERS)),
            "hidden_b": np.zeros(HIDDEN, np.float32),
            "out": normal(HIDDEN) * np.float32(0.3),
            "out_b": np.zeros(1, np.float32),
        }

    def chunks(self, data: np.ndarray, blocks: np.ndarray, keep: bool = False):
        """Hidden units of each chunk. Texts don't touch: a text's last filter place sees its own half only."""
        p = self.p
        a = p["embed"][data].reshape(-1, STRIDE * EMBED)
        y = a @ p["filters"]
        z = y[:, :FILTERS].copy()
        last = np.cumsum(blocks) * ROWS - 1
        z[:-1] += y[1:, FILTERS:]
        z[last[:-1]] -= y[last[:-1] + 1, FILTERS:]
        z += p["filters_b"]
        np.maximum(z, 0, out=z)
        by_block = z.reshape(-1, ROWS, FILTERS)
        total, most = by_block.sum(1), by_block.max(1)
        first = np.ones(len(total), bool)
        first[np.cumsum(blocks) - 1] = False
        k = np.flatnonzero(first)  # a chunk is its first block and the next, of the same text
        features = np.concatenate(((total[k] + total[k + 1]) / np.float32(2 * ROWS), np.maximum(most[k], most[k + 1])), 1)
        h = np.maximum(features @ p["hidden"] + p["hidden_b"], 0)
        return (h, k, (a, z, last, by_block, most, features)) if keep else h

    def pooled(self, texts: list[bytes]) -> np.ndarray:
        """Each text's hidden units, max-pooled over its chunks."""
        data, blocks = layout(texts)
        return np.maximum.reduceat(self.chunks(data, blocks), np.cumsum(blocks - 1) - (blocks - 1))

    def windows(self, text: bytes, size: int = SLICE) -> Iterator[tuple[int, np.ndarray]]:
        """(number of the first chunk, hidden units) of all chunks of the text, about so many bytes at a time."""
        every = max(2, -(-(len(text) + STRIDE) // BLOCK)) - 1
        n = max(1, size // BLOCK - 2)
        for c in range(0, every, n):
            # The chunks' blocks, and the next filter's half behind them; what padding follows is another window's.
            data, blocks = layout([text[c * BLOCK : (c + n + 1) * BLOCK + STRIDE]])
            yield c, self.chunks(data, blocks)[: min(n, every - c)]

    def maxima(self, text: bytes) -> list[bytes]:
        """The parts of a text that hold the first chunk of each unit's maximum."""
        most = np.zeros(HIDDEN, np.float32)
        at = np.zeros(HIDDEN, np.int64)
        for c, h in self.windows(text):
            best, value = h.argmax(0), h.max(0)
            at, most = np.where(value > most, c + best, at), np.maximum(value, most)
        return [text[c * BLOCK : (c + 2) * BLOCK + STRIDE] for c in sorted(set(at.tolist()))]

    def logit(self, pooled: np.ndarray) -> np.ndarray:
        return pooled @ self.p["out"] + self.p["out_b"][0]

    def gradients(self, texts: list[bytes], labels: np.ndarray) -> tuple[dict[str, np.ndarray], float]:
        p = self.p
        parts = [self.maxima(t) if len(t) > LONG else [t] for t in texts]
        data, blocks = layout([x for part in parts for x in part])
        h, k, (a, z, last, by_block, most, features) = self.chunks(data, blocks, keep=True)
        owner = np.repeat(np.arange(len(texts)), [len(part) for part in parts])
        # Of a long text's parts, only the first chunk is one of the text.
        first = np.cumsum(blocks - 1) - (blocks - 1)
        long = np.array([len(t) > LONG for t in texts])[owner]
        own = np.repeat(~long, blocks - 1)
        own[first] = True
        h = h * own[:, None]
        starts = first[np.searchsorted(owner, np.arange(len(texts)))]
        pooled = np.maximum.reduceat(h, starts)
        prob = 1 / (1 + np.exp(-np.clip(self.logit(pooled), -30, 30)))
        d = ((prob - labels) / len(labels)).astype(np.float32)
        g = {"out": pooled.T @ d, "out_b": d.sum(keepdims=True)}
        # Through the maximum: the first chunk that has it.
        text_of = np.repeat(owner, blocks - 1)
        is_most = (h == pooled[text_of]) & (h > 0)
        seen = np.cumsum(is_most, 0)
        before = np.where(starts[:, None] > 0, seen[starts - 1], 0)
        is_most &= seen - before[text_of] == 1
        dh = is_most * (d[:, None] * p["out"])[text_of]
        g["hidden"], g["hidden_b"] = features.T @ dh, dh.sum(0)
        df = dh @ p["hidden"].T
        d_total, d_most = np.zeros_like(most), np.zeros_like(most)
        np.add.at(d_total, k, df[:, :FILTERS] / np.float32(2 * ROWS))
        np.add.at(d_total, k + 1, df[:, :FILTERS] / np.float32(2 * ROWS))
        left = most[k] >= most[k + 1]
        np.add.at(d_most, k, df[:, FILTERS:] * left)
        np.add.at(d_most, k + 1, df[:, FILTERS:] * ~left)
        dz = np.repeat(d_total[:, None, :], ROWS, 1)
        at = by_block.argmax(1)
        np.put_along_axis(dz, at[:, None, :], np.take_along_axis(dz, at[:, None, :], 1) + d_most[:, None, :], 1)
        dz = dz.reshape(-1, FILTERS) * (z > 0)
        g["filters_b"] = dz.sum(0)
        dy = np.zeros((len(dz), 2 * FILTERS), np.float32)
        dy[:, :FILTERS] = dz
        dy[1:, FILTERS:] = dz[:-1]
        dy[last[:-1] + 1, FILTERS:] = 0
        g["filters"] = a.T @ dy
        da = (dy @ p["filters"].T).reshape(-1, EMBED)
        g["embed"] = np.stack([np.bincount(data, da[:, e], 256) for e in range(EMBED)], 1).astype(np.float32)
        loss = -np.mean(np.log(np.clip(np.where(labels == 1, prob, 1 - prob), 1e-7, 1)))
        return g, float(loss)

    def fit(self, texts: list[bytes], labels: np.ndarray, epochs: int = EPOCHS, batch: int = BATCH, rate: float = RATE) -> None:
        """Adam over shuffled batches, the rate falling to nothing."""
        r = np.random.default_rng(SEED + 1)
        m = {k: np.zeros_like(v) for k, v in self.p.items()}
        v2 = {k: np.zeros_like(v) for k, v in self.p.items()}
        steps, t = epochs * -(-len(texts) // batch), 0
        for _ in range(epochs):
            order = r.permutation(len(texts))
            for a in range(0, len(order), batch):
                some = order[a : a + batch]
                g, _loss = self.gradients([texts[i] for i in some], labels[some])
                t += 1
                now = rate * (1 - (t - 1) / steps)
                for k, x in g.items():
                    m[k] = 0.9 * m[k] + 0.1 * x
                    v2[k] = 0.99 * v2[k] + 0.01 * x * x
                    self.p[k] = (self.p[k] - now * (m[k] / (1 - 0.9**t)) / (np.sqrt(v2[k] / (1 - 0.99**t)) + 1e-7)).astype(np.float32)

    def score(self, texts: list[bytes], shift: float = 0.0) -> np.ndarray:
        """Probabilities of label 1."""
        out = np.empty((len(texts), HIDDEN), np.float32)
        a = 0
        while a < len(texts):
            if len(texts[a]) > SLICE:
                out[a] = np.max([h.max(0) for _, h in self.windows(texts[a])], axis=0)
                a += 1
                continue
            b, size = a, 0
            while b < len(texts) and len(texts[b]) <= SLICE and (b == a or size + len(texts[b]) <= SLICE):
                size += len(texts[b]) + BLOCK
                b += 1
            out[a:b] = self.pooled(texts[a:b])
            a = b
        # Products in single precision depend on a text's neighbours in the last digits; six decimals don't.
        return np.round(1 / (1 + np.exp(-np.clip(self.logit(out).astype(np.float64) + shift, -30, 30))), 6)


def train(docs: DataFrame, labels: DataFrame, sample: int = SAMPLE) -> tuple[Network | None, float]:
    """The network, and the logit of label 1's share less that in the sample."""
    known = labels.select(F.col("doc_id").cast("long"), F.col("quality").cast("int")).where(F.col("quality").isin(0, 1) & F.col("doc_id").isNotNull()).distinct()
    shares = {r["quality"]: r["n"] for r in known.groupBy("quality").agg(F.count("*").alias("n")).collect()}
    rate = (shares.get(1, 0) + 1) / (sum(shares.values()) + 2)
    prior = float(np.log(rate / (1 - rate)))
    picked = [known.where(F.col("quality") == q).withColumn("_order", F.xxhash64("doc_id")).orderBy("_order", "doc_id").limit(sample) for q in (0, 1)]
    rows = docs.select(F.col("doc_id").cast("long"), F.col("text").cast("string")).join(F.broadcast(picked[0].unionByName(picked[1])), "doc_id")
    rows = rows.select(F.coalesce("text", F.lit("")).alias("text"), "quality", "_order").orderBy("_order", F.xxhash64("text"), "text").limit(2 * sample)
    got = [(r["text"].encode(), r["quality"]) for r in rows.collect()]
    y = np.array([q for _, q in got])
    if len(set(y.tolist())) < 2:
        return None, prior
    net = Network()
    with one_thread():
        net.fit([t for t, _ in got], y, min(MOST_EPOCHS, max(EPOCHS, -(-STEPS * BATCH // len(got)))))
    share = float(np.mean(y))
    return net, prior - float(np.log(share / (1 - share)))


def _scoring(net: Network | None, shift: float, place: int) -> Callable:
    """place: the text's column among those of the batches."""

    def run(batches):
        import pyarrow as pa

        only("quality")
        for batch in batches:
            scores, column = np.empty(batch.num_rows), batch.column(place)
            for a in range(0, batch.num_rows, 64):
                texts = [(t.as_py() or "").encode() for t in column.slice(a, 64)]
                scores[a : a + 64] = net.score(texts, shift) if net else 1 / (1 + np.exp(-shift))
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(scores)], [*batch.schema.names, f"c{batch.num_columns}"])

    return run


def score(docs: DataFrame, net: Network | None, shift: float) -> DataFrame:
    """docs with the score as last column: ``_score``, or the next free name with more "_" before it."""
    (name,) = unused(docs, "_score")
    return by_place(docs, lambda place: _scoring(net, shift, place), T.StructField(name, T.DoubleType()))


def accepted(docs: DataFrame, net: Network | None, shift: float, threshold: float = THRESHOLD) -> DataFrame:
    """The rows of docs whose score is threshold or more."""
    rows = score(docs, net, shift)
    return rows.where(quoted(rows.columns[-1]) >= threshold).select(*map(quoted, docs.columns))


def op3_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select(F.col("doc_id").cast("long"), "text")
    labels = table(spark, sf_dir, "labels").where(bucket("doc_id", 5) != 0)
    rows = score(docs.withColumn("held_out", bucket("doc_id", 5) == 0), *train(docs, labels))
    return rows.select("doc_id", "held_out", F.col("_score").alias("score"), F.when(F.col("_score") >= THRESHOLD, 1).otherwise(0).alias("predicted"))


QUERIES = {"op3_quality": op3_quality}
ORACLES: dict[str, str] = {}
