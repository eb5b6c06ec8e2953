"""Small tables: texts that are null, empty, long, repeated, and columns whose names clash."""

from __future__ import annotations

import random

SCHEMA = "doc_id long, text string, lang string, source string, n_chars long, node string, path long, _h string, quality string, _score string, spans string, length string"


def docs(spark, texts, ids=None, langs=None):
    ids = ids if ids is not None else list(range(len(texts)))
    rows = [(i, t, langs[k] if langs else "en", "s", len(t or ""), "x", 1, "h", "q", "c", "p", "l") for k, (i, t) in enumerate(zip(ids, texts))]
    return spark.createDataFrame(rows, SCHEMA).repartition(3)


def words(r: random.Random, n: int) -> str:
    return " ".join("".join(r.choice(("ka", "lo", "mi", "ter", "on", "be", "su", "ra")) for _ in range(r.randint(1, 4))) for _ in range(n))
