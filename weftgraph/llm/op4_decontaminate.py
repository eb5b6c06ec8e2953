"""Benchmark decontamination by the q-gram lemma over diagonal bands.

Texts and items are lower-cased, ASCII signs and white space become single blanks. An item of m characters is
found where a region of the text is within k edits of it, k being a tenth of m. Such a region shares at least
m - q + 1 - k q of the item's q-grams, and they lie on diagonals (text place less item place) at most k apart;
so shared q-grams are counted in overlapping bands of 2k diagonals, regions that meet the bound are kept, and
a banded alignment verifies them. Items of under ``LEAST`` characters, for which the lemma says little, are found
where they stand as whole words, without edits, by an automaton over all of them.

The texts don't move: each is scanned whole where it was read, in windows that overlap by the longest region, and
shared q-grams are expanded in parts of at most ``POSTINGS``, cut by windows and then by items. The benchmark
is broadcast if it is small enough (``BENCHMARK_BYTES``), otherwise block after block of it, each under that bound.

Defined results: null and empty texts and items match nothing; repeated rows get equal results; null ids are kept;
an empty table on either side gives no findings; further columns are ignored or, by ``without_leaks``, kept,
whatever their names.
"""

from __future__ import annotations

import uuid
from collections.abc import Callable, Iterator

import numpy as np
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from weftgraph.llm.common import by_place, only, small_batches, table

Q, RATE, LEAST = 8, 0.1, 24
BENCHMARK_BYTES = 32 << 20
#: Characters of texts that are worked on at a time (a longer text is one such part), and of a window.
SLICE, WINDOW = 1 << 20, 1 << 13
#: Shared q-grams that are expanded, and regions that are aligned, at a time.
POSTINGS, REGIONS = 1 << 20, 1 << 11
_U = np.uint64
_BASE = 0x9E3779B97F4A7C15

_blank = np.array([not chr(c).isalnum() for c in range(128)])


def normal(text: str | None) -> np.ndarray:
    """The characters' code points."""
    raw = np.frombuffer((text or "").lower().encode("utf-32-le", "surrogatepass"), np.uint32)
    if not len(raw):
        return raw
    blank = _blank[np.minimum(raw, 127)] & (raw < 128)
    keep = ~blank
    keep[1:] |= ~blank[:-1]
    out = np.where(blank, np.uint32(32), raw)[keep]
    return out[int(len(out) > 0 and out[0] == 32) : len(out) - int(len(out) > 1 and out[-1] == 32)]


def qgrams(data: np.ndarray) -> np.ndarray:
    """A hash of the Q characters from each place on."""
    out = data.astype(_U) + _U(1)
    n = 1
    while n < Q:
        out = out[:-n] * _U(pow(_BASE, n, 1 << 64)) + out[n:] if len(out) > n else out[:0]
        n *= 2
    return out ^ (out >> _U(29))


class Items:
    """The benchmark's q-gram index. items: (id, normal text) of one character at least."""

    def __init__(self, items: list[tuple[int, np.ndarray]]):
        self.ids = [i for i, _ in items]
        self.texts = [t for _, t in items]
        m = np.array([len(t) for t in self.texts], np.int64)
        self.long = m >= LEAST
        self.m = m
        self.k = np.where(self.long, np.minimum((m * RATE).astype(np.int64), (m - Q) // Q), 0)
        self.step = np.maximum(self.k, 8)
        self.needed = m - Q + 1 - self.k * Q
        self.most = int(m.max(initial=1))
        #: Added to diagonals, so that bands count from 1.
        self.shift = int((m + 2 * self.step).max(initial=0))
        #: Characters that a region and its band may span, by which windows overlap.
        self.span = int((m + 3 * self.step + self.k).max(initial=0)) + Q
        some = np.flatnonzero(self.long)
        grams = [qgrams(self.texts[i]) for i in some]
        every = np.concatenate([np.zeros(0, _U), *grams])
        order = np.argsort(every, kind="stable")
        sizes = [len(g) for g in grams]
        self.item = np.repeat(some, sizes)[order]
        self.offset = np.concatenate([np.zeros(0, np.int64), *(np.arange(n) for n in sizes)])[order]
        self.keys, first = np.unique(every[order], return_index=True)
        #: Postings in order of (key, item).
        self.place = np.repeat(np.arange(len(self.keys)), np.diff(np.append(first, len(order)))) * len(items) + self.item
        self.bits = _U(64 - min(26, max(16, int(np.ceil(np.log2(len(self.keys) * 64 + 1))))))
        self.maybe = np.zeros(1 << (64 - int(self.bits)), bool)
        self.maybe[self._hash(self.keys)] = True
        self.words = self._automaton()

    def _automaton(self):
        """Finds the short items, between blanks."""
        short = np.flatnonzero(~self.long)
        if not len(short):
            return None
        import ahocorasick

        out, same = ahocorasick.Automaton(), {}
        for i in short.tolist():
            same.setdefault(" " + _text(self.texts[i]) + " ", []).append(i)
        for text, those in same.items():
            out.add_word(text, those)
        out.make_automaton()
        return out

    def _hash(self, g: np.ndarray) -> np.ndarray:
        return (g * _U(_BASE)) >> self.bits

    def find(self, texts: list[np.ndarray]) -> dict[tuple[int, int], int]:
        """The least edits of each (text, item) that is found."""
        out: dict[tuple[int, int], int] = {}
        if self.words:
            for t, text in enumerate(texts):
                out |= {(t, i): 0 for _, those in self.words.iter(" " + _text(text) + " ") for i in those}
        size = max(WINDOW, 4 * self.span)
        for t, at, i, low in self._regions([(t, a, text[a : a + size]) for t, text in enumerate(texts) for a in range(0, max(1, len(text) - self.span), size - self.span)]):
            todo = np.array([out.get(x, 1) > 0 for x in zip(t.tolist(), i.tolist())], bool)
            t, i, low = t[todo], i[todo], (at + low - self.k[i])[todo]
            for a in range(0, len(t), REGIONS):
                part = slice(a, a + REGIONS)
                for x, y, edits in zip(t[part].tolist(), i[part].tolist(), self._align(texts, t[part], i[part], low[part]).tolist()):
                    if edits <= self.k[y]:
                        out[x, y] = min(edits, out.get((x, y), edits))
        return out

    def _regions(self, windows: list[tuple[int, int, np.ndarray]]) -> Iterator[tuple[np.ndarray, ...]]:
        """(text, window's place, item, band's first diagonal in the window) where enough q-grams are shared."""
        if not windows or not len(self.keys):
            return
        data = np.concatenate([x for _, _, w in windows for x in (w, np.zeros(1, np.uint32))])
        starts = np.cumsum([0, *(len(w) + 1 for _, _, w in windows)])[:-1]
        g = qgrams(data)
        place = np.flatnonzero(self.maybe[self._hash(g)])
        k = np.searchsorted(self.keys, g[place])
        k[k == len(self.keys)] = 0
        same = self.keys[k] == g[place]
        place, k = place[same], k[same]
        window = np.searchsorted(starts, place, side="right") - 1
        text, at = np.array([t for t, _, _ in windows]), np.array([a for _, a, _ in windows])
        yield from ((text[w], at[w], i, d) for w, i, d in self._counted(window, place - starts[window], k, 0, len(self.ids)))

    def _counted(self, window: np.ndarray, place: np.ndarray, k: np.ndarray, lo: int, hi: int) -> Iterator[tuple[np.ndarray, ...]]:
        """(window, item, diagonal) of bands with enough q-grams of the items from lo to hi, in bounded parts."""
        first = np.searchsorted(self.place, k * len(self.ids) + lo)
        n = np.searchsorted(self.place, k * len(self.ids) + hi) - first
        total = np.cumsum(n)
        if not len(n) or not total[-1]:
            return
        if total[-1] > POSTINGS:
            if window[0] != window[-1]:  # whole windows, about half of the postings each
                cut = int(np.searchsorted(total, total[-1] // 2))
                cut = int(np.searchsorted(window, window[cut], side="left")) or int(np.searchsorted(window, window[0], side="right"))
                yield from self._counted(window[:cut], place[:cut], k[:cut], lo, hi)
                yield from self._counted(window[cut:], place[cut:], k[cut:], lo, hi)
                return
            if hi - lo > 1:
                for a, b in ((lo, (lo + hi) // 2), ((lo + hi) // 2, hi)):
                    yield from self._counted(window, place, k, a, b)
                return
        which = np.repeat(first - (total - n), n) + np.arange(int(total[-1]))
        item, offset = self.item[which], self.offset[which]
        window, place = np.repeat(window, n), np.repeat(place, n)
        # Diagonals from -m on; each lies in two bands. Of each band's places in the item every one counts once.
        band = (place - offset + self.shift) // self.step[item]
        most = int(band.max()) + 2
        key = ((window - window[0]) * (hi - lo) + item - lo) * most + band
        halves = _distinct(key)
        key = _distinct(np.concatenate((key, key - 1)) * self.most + np.tile(offset, 2)) // self.most
        cut = np.flatnonzero(np.diff(key, prepend=-1))
        counts = np.diff(np.append(cut, len(key)))
        key = key[cut]
        item = key // most % (hi - lo) + lo
        enough = counts >= self.needed[item]
        # A band whose places are all in its first half is seen with the band before it: k edits lead no further.
        after = np.searchsorted(halves, key + 1)
        enough &= halves[np.minimum(after, len(halves) - 1)] == key + 1
        key, item = key[enough], item[enough]
        yield key // most // (hi - lo) + window[0], item, key % most * self.step[item] - self.shift

    def _align(self, texts: list[np.ndarray], t: np.ndarray, i: np.ndarray, low: np.ndarray) -> np.ndarray:
        """Least edits between each item and a part of its text within the band of its diagonals from low on; some
        number beyond k where it is beyond k."""
        m, k = self.m[i], self.k[i]
        width = int((2 * self.step[i] + 2 * k + 1).max(initial=1))
        item = np.zeros((len(t), int(m.max(initial=1))), np.uint32)
        region = np.zeros((len(t), item.shape[1] + width + 1), np.uint32)
        for r, (x, y, d) in enumerate(zip(t.tolist(), i.tolist(), low.tolist())):
            item[r, : m[r]] = self.texts[y]
            part = texts[x][max(0, d) : d + 2 * int(self.step[y]) + int(m[r] + k[r]) + 1][: region.shape[1] - max(0, -d)]
            region[r, max(0, -d) : max(0, -d) + len(part)] = part
        kind = np.int16 if item.shape[1] + width < 1 << 14 else np.int32
        ramp = np.arange(width, dtype=kind)
        cost = np.zeros((len(t), width), kind)  # of diagonal w after n characters of the item
        best, rows = np.full(len(t), 1 << 20), np.arange(len(t))
        for n in range(item.shape[1]):
            new = cost + (region[:, n : n + width] != item[:, n, None])
            new[:, :-1] = np.minimum(new[:, :-1], cost[:, 1:] + kind(1))
            cost = np.minimum.accumulate(new - ramp, axis=1) + ramp
            ended = m == n + 1
            if ended.any():
                best[rows[ended]] = cost[ended].min(1)
            if n % 8 == 7 or ended.any():  # costs never fall
                on = ~ended & (m > n + 1) & (cost.min(1) <= k)
                if not on.any():
                    break
                if 2 * on.sum() < len(on):
                    cost, item, region, m, k, rows = (x[on] for x in (cost, item, region, m, k, rows))
        return best


def _distinct(x: np.ndarray) -> np.ndarray:
    """Sorted; by sorting, as numpy's own way hashes such keys to few places."""
    x = np.sort(x)
    return x[np.diff(x, prepend=x[:1] - 1) != 0]


def _text(points: np.ndarray) -> str:
    return points.tobytes().decode("utf-32-le", "surrogatepass")


def _items(shared) -> Items:
    """The index of a broadcast (name, items); a worker keeps the last one."""
    name, items = shared.value
    kept = only("decontaminate")
    if name not in kept:
        kept.clear()
        kept[name] = Items([(i, np.frombuffer(t.encode("utf-32-le", "surrogatepass"), np.uint32)) for i, t in items])
    return kept[name]


def _slices(texts: list[np.ndarray]):
    a = 0
    while a < len(texts):
        b, size = a, 0
        while b < len(texts) and (b == a or size + len(texts[b]) <= SLICE) and b - a < 4096:
            size += len(texts[b])
            b += 1
        yield a, texts[a:b]
        a = b


def _finding(shared) -> Callable:
    def run(batches):
        import pyarrow as pa

        items = _items(shared)
        for batch in batches:
            ids, rows = batch.column("doc_id").to_pylist(), []
            for at in range(0, batch.num_rows, 1000):
                for a, part in _slices([normal(t.as_py()) for t in batch.column("text").slice(at, 1000)]):
                    rows += [(ids[at + a + t], items.ids[i], edits) for (t, i), edits in items.find(part).items()]
            yield pa.RecordBatch.from_arrays([pa.array(c, pa.int64()) for c in (zip(*rows) if rows else [()] * 3)], ["doc_id", "item_id", "edits"])

    return run


def _flagging(shared, place: int) -> Callable:
    def run(batches):
        import pyarrow as pa

        items = _items(shared)
        for batch in batches:
            leaks = np.zeros(batch.num_rows, bool)
            for at in range(0, batch.num_rows, 1000):
                for a, part in _slices([normal(t.as_py()) for t in batch.column(place).slice(at, 1000)]):
                    leaks[[at + a + t for t, _ in items.find(part)]] = True
            yield batch.filter(pa.array(~leaks))

    return run


def _blocks(benchmark: DataFrame, most: int):
    """The benchmark as broadcast variables of bounded size: its items' normal texts."""
    items = benchmark.select(F.col("item_id").cast("long"), F.col("text").cast("string")).where(F.length("text") >= 1)
    total = items.agg(F.coalesce(F.sum(F.octet_length("text")), F.lit(0)).alias("n")).first()["n"]
    n = max(1, -(-2 * total // most)) if total > most else 1
    for b in range(n):
        part = items.where(F.pmod(F.xxhash64("item_id", "text"), F.lit(n)) == b) if n > 1 else items
        known = sorted({(r["item_id"], _text(t)) for r in part.toLocalIterator() if len(t := normal(r["text"]))}, key=lambda x: (x[0] is None, x[0] or 0, x[1]))
        if known:
            yield benchmark.sparkSession.sparkContext.broadcast((uuid.uuid4().hex, known))


def find_leaks(docs: DataFrame, benchmark: DataFrame, most: int = BENCHMARK_BYTES) -> DataFrame:
    """(doc_id, item_id, edits) of each item found in each document."""
    docs = small_batches(docs).select(F.col("doc_id").cast("long"), F.col("text").cast("string"))
    out = None
    for shared in _blocks(benchmark, most):
        found = docs.mapInArrow(_finding(shared), "doc_id long, item_id long, edits long")
        out = found if out is None else out.unionByName(found)
    if out is None:
        return docs.sparkSession.createDataFrame([], "doc_id long, item_id long, edits long")
    return out.groupBy("doc_id", "item_id").agg(F.min("edits").alias("edits"))


def without_leaks(docs: DataFrame, benchmark: DataFrame, most: int = BENCHMARK_BYTES) -> DataFrame:
    """The documents in which no item is found, with their columns."""
    for shared in _blocks(benchmark, most):
        docs = by_place(docs, lambda place, shared=shared: _flagging(shared, place))
    return docs


def op4_decontaminate(spark: SparkSession, sf_dir: str) -> DataFrame:
    return find_leaks(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))


QUERIES = {"op4_decontaminate": op4_decontaminate}
ORACLES: dict[str, str] = {}
