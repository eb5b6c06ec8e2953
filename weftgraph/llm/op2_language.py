"""Language ID by hyperdimensional profiles.

Every letter has a random vector of +1 and -1. An n-gram's vector binds (multiplies) its letters' vectors,
each permuted (rotated) by its place; a text's vector bundles (adds) those of its n-grams; so does a
language's prototype, over the training texts. A text gets the language whose prototype has the largest
cosine with it.

Training counts n-grams for each language in each partition and bundles them there; only a vector of fixed
size for each partition and language is shuffled, and one for each language comes to the driver. Texts never
move. Prediction reads the text alone.

Defined results: null texts and texts without letters get ``und`` and score 0, as does every text if nothing
was learned; ties go to the first language in order; repeated rows get equal results; an empty table gives
no rows; further columns are ignored. Texts of any length are taken whole, in slices.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from weftgraph.llm.common import bucket, only, small_batches, table

DIMENSIONS, NGRAM, SYMBOLS, SEED = 1024, 3, 64, 20_011
UNKNOWN = "und"
#: Characters of texts that are worked on at a time.
SLICE = 2_000_000


class Letters:
    """Symbols and their vectors: 0 for anything but letters, a to z, and the other letters hashed."""

    def __init__(self):
        random = np.random.default_rng(SEED)
        base = random.choice(np.array([-1, 1], np.int8), (SYMBOLS, DIMENSIONS))
        #: rolled[k]: the vectors of letters that k letters follow in the n-gram.
        self.rolled = [np.roll(base, k, axis=1) for k in range(NGRAM)]
        table_ = np.zeros(0x110000, np.uint8)
        for c in range(0x110000):
            if chr(c).isalpha():
                table_[c] = c - 96 if 97 <= c <= 122 else 27 + (c * 2_654_435_761 >> 7) % (SYMBOLS - 27)
        self.table = table_

    def symbols(self, text: str) -> np.ndarray:
        return self.table[np.frombuffer(text.lower().encode("utf-32-le", "surrogatepass"), np.uint32)]

    def codes(self, text: str) -> np.ndarray:
        """The codes of a text's n-grams; of those without a letter, none."""
        s = self.symbols(text)
        if not s.any():
            return np.zeros(0, np.int32)
        s = np.concatenate((np.zeros(1, np.int32), s.astype(np.int32), np.zeros(NGRAM - 2, np.int32)))
        if len(s) < NGRAM:
            s = np.concatenate((s, np.zeros(NGRAM - len(s), np.int32)))
        out = s[: len(s) - NGRAM + 1]
        for k in range(1, NGRAM):
            out = out * SYMBOLS + s[k : len(s) - NGRAM + 1 + k]
        return out[out > 0]

    def vectors(self, codes: np.ndarray) -> np.ndarray:
        out = None
        for k in range(NGRAM):
            bound = self.rolled[k][codes // SYMBOLS**k % SYMBOLS]
            out = bound if out is None else out * bound
        return out

    def bundle(self, counts: np.ndarray) -> np.ndarray:
        """The sum of the vectors of all n-grams, each as often as it occurs."""
        codes = np.flatnonzero(counts)
        out = np.zeros(DIMENSIONS)
        for a in range(0, len(codes), 4096):
            part = codes[a : a + 4096]
            out += counts[part].astype(np.float64) @ self.vectors(part).astype(np.float64)
        return out


def letters() -> Letters:
    kept = only("language")
    if not kept:
        kept["letters"] = Letters()
    return kept["letters"]


def _training(batches) -> Iterator:
    import pyarrow as pa

    counts: dict[str, np.ndarray] = {}
    for batch in batches:
        for text, lang in zip(batch.column("text"), batch.column("lang").to_pylist()):
            codes = letters().codes(text.as_py())
            if len(codes):
                mine = counts.setdefault(lang, np.zeros(SYMBOLS**NGRAM, np.int64))
                if len(codes) > 20_000:
                    mine += np.bincount(codes, minlength=len(mine))
                else:
                    np.add.at(mine, codes, 1)
    for lang, n in counts.items():
        yield pa.RecordBatch.from_arrays([pa.array([lang]), pa.array([letters().bundle(n)], pa.list_(pa.float64()))], ["lang", "vector"])


def learn(docs: DataFrame) -> dict[str, np.ndarray]:
    """The prototype of each language of docs (text, lang), over all its rows."""
    rows = small_batches(docs).select(F.col("text").cast("string"), F.col("lang").cast("string")).where(F.col("text").isNotNull() & F.col("lang").isNotNull())
    parts = rows.mapInArrow(_training, "lang string, vector array<double>").select("lang", F.posexplode("vector").alias("i", "x"))
    out: dict[str, np.ndarray] = {}
    for r in parts.groupBy("lang", "i").agg(F.sum("x").alias("x")).groupBy("lang").agg(F.sort_array(F.collect_list(F.struct("i", "x"))).alias("v")).collect():
        v = np.array([x["x"] for x in r["v"]])
        out[r["lang"]] = v / max(np.linalg.norm(v), 1e-12)
    return dict(sorted(out.items()))


def _predicting(prototypes: dict[str, np.ndarray]) -> Callable:
    names = list(prototypes)
    matrix = np.array([prototypes[n] for n in names]).reshape(-1, DIMENSIONS).T

    def run(batches):
        import pyarrow as pa

        for batch in batches:
            best: list[str] = []
            scores: list[float] = []
            texts = batch.column("text").to_pylist()
            a = 0
            while a < len(texts):
                b, size = a, 0
                while b < len(texts) and (b == a or (size < SLICE and b - a < 256)):
                    size += len(texts[b] or "")
                    b += 1
                for x in _cosines(texts[a:b], matrix):
                    if x is None or not names:
                        best.append(UNKNOWN)
                        scores.append(0.0)
                    else:
                        k = int(np.argmax(x))
                        best.append(names[k])
                        scores.append(float(min(1.0, max(0.0, x[k]))))
                a = b
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), batch.column("held_out"), pa.array(best, pa.string()), pa.array(scores, pa.float64())], ["doc_id", "held_out", "lang_pred", "score"])

    return run


def _cosines(texts: list[str | None], matrix: np.ndarray) -> list[np.ndarray | None]:
    """Of each text with each prototype; None without letters."""
    own = letters()
    found = []
    for t in texts:
        codes = own.codes(t) if t else np.zeros(0, np.int32)
        found.append(np.unique(codes, return_counts=True) if len(codes) else None)
    some = [f[0] for f in found if f is not None]
    if not some:
        return [None] * len(texts)
    every = np.unique(np.concatenate(some))
    vectors = np.empty((len(every), DIMENSIONS), np.float32)
    for a in range(0, len(every), 4096):
        vectors[a : a + 4096] = own.vectors(every[a : a + 4096])
    out: list[np.ndarray | None] = []
    for f in found:
        if f is None:
            out.append(None)
            continue
        v = (f[1].astype(np.float32) @ vectors[np.searchsorted(every, f[0])]).astype(np.float64)
        out.append(v @ matrix / max(np.linalg.norm(v), 1e-12))
    return out


def predict(docs: DataFrame, prototypes: dict[str, np.ndarray]) -> DataFrame:
    """(doc_id, held_out, lang_pred, score); docs needs doc_id, text and held_out."""
    rows = small_batches(docs).select(F.col("doc_id").cast("long"), F.col("text").cast("string"), "held_out")
    return rows.mapInArrow(_predicting(prototypes), "doc_id long, held_out boolean, lang_pred string, score double")


def op2_language(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").withColumn("held_out", bucket("doc_id", 4) == 2)
    return predict(docs, learn(docs.where(~F.col("held_out"))))


QUERIES = {"op2_language": op2_language}
ORACLES: dict[str, str] = {}
