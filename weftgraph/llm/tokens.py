"""Tokenizing whole texts with a vocabulary file of the tokenizers library.

The queries' file lower-cases, drops white space and cuts texts into runs of letters, single digits and runs of
other signs, each of which byte pairs then join alone. Such files (their parts are checked when they are loaded)
are worked through in numpy, a slice of the text at a time: runs are cut and hashed all at once, those that the
worker met before are looked up, and the rest go through the merges together, the lowest of each run in every
round. Whatever that way doesn't cover goes to the library as it is: white-space separated words that hold signs
beyond Greek and Cyrillic, combining or control characters, contractions or what may be a special string, and very
long runs. Files of any other make are left to the library, text by text.

What a worker remembers is bounded in bytes; beyond the bound, the half that was used longest ago is dropped.
"""

from __future__ import annotations

import json
import re
import unicodedata
from collections.abc import Iterator

import numpy as np

from weftgraph.llm.common import only

#: Bytes that a worker remembers at most, and the characters that are worked on at a time.
CACHE_BYTES, SLICE = 48 << 20, 1 << 18
#: Longer runs go to the library, as a round of merges passes over all of a run.
LONG = 64
#: The id that ends each document.
END = 1
END_BYTES = END.to_bytes(4, "little")

SPACE, LETTER, NUMBER, SIGN, ODD = range(5)
#: Characters from here on are odd.
BOUND = 0x530
_U = np.uint64
_GAP = re.compile(r"[ \t-\r]")
_SPLIT = r"'s|'t|'re|'ve|'m|'ll|'d|[\p{L}]+|[\p{N}]|[^\s\p{L}\p{N}]+"
_NORMALIZERS = [{"type": "NFC"}, {"type": "Replace", "pattern": {"Regex": r"\s+"}, "content": " "}, {"type": "Lowercase"}]
_random = np.random.default_rng(20_260_101)
_letters = _random.integers(0, 1 << 64, (2, BOUND + 1), _U, endpoint=False)
_BASE = 0x9E3779B97F4A7C15
_powers: list[np.ndarray] = []


def _class(c: int) -> tuple[int, int]:
    """A character's class and its lower case."""
    x = chr(c)
    if x in " \t\n\v\f\r":
        return SPACE, c
    kind, low = unicodedata.category(x), x.lower()
    plain = len(low) == 1 and ord(low) < BOUND and unicodedata.is_normalized("NFC", x) and unicodedata.is_normalized("NFC", low)
    if kind[0] in "CMZ" or not plain or c == 0x3A3:  # the capital sigma's lower case depends on its place
        return ODD, c
    return {"L": LETTER, "N": NUMBER}.get(kind[0], SIGN), ord(low)


_classes, _lower = (np.array(x) for x in zip(*map(_class, range(BOUND)), (ODD, BOUND)))
_classes, _lower = _classes.astype(np.uint8), _lower.astype(np.uint32)
#: Two independent values of each character's lower case.
_values = _letters[:, _lower]
_contracted = np.zeros(BOUND + 1, bool)
_contracted[[ord(c) for c in "sStTrRvVmMlLdDſ"]] = True


def _mix(x: np.ndarray) -> np.ndarray:
    x = (x ^ (x >> _U(33))) * _U(0xFF51AFD7ED558CCD)
    x = (x ^ (x >> _U(33))) * _U(0xC4CEB9FE1A85EC53)
    return x ^ (x >> _U(33))


def _power(n: int) -> list[np.ndarray]:
    if not _powers or len(_powers[0]) < n:
        n = max(n, SLICE + (SLICE >> 3))
        _powers[:] = [np.multiply.accumulate(np.concatenate((np.ones(1, _U), np.full(n - 1, b, _U)))) for b in (_BASE, pow(_BASE, -1, 1 << 64))]
    return _powers


def _spread(start: np.ndarray, n: np.ndarray) -> np.ndarray:
    """start, start + 1, ... n places of each."""
    ends = np.cumsum(n)
    return np.repeat(start - (ends - n), n) + np.arange(int(ends[-1]) if len(ends) else 0)


class Merges:
    """The byte pair merges of a vocabulary, over many runs at once."""

    def __init__(self, vocabulary: dict[str, int], merges: list, end: str):
        printed = [*range(33, 127), *range(161, 173), *range(174, 256)]
        rest = [b for b in range(256) if b not in printed]
        name = {b: chr(b) for b in printed} | {b: chr(256 + i) for i, b in enumerate(rest)}
        self.inner = np.array([vocabulary[name[b]] for b in range(256)])
        self.last = np.array([vocabulary[name[b] + end] for b in range(256)])
        pairs = [m.split(" ") if isinstance(m, str) else m for m in merges]
        self.width = max(vocabulary.values()) + 1
        keys = np.array([vocabulary[a] * self.width + vocabulary[b] for a, b in pairs], np.int64)
        self.order = np.argsort(keys)
        self.keys = keys[self.order]
        self.made = np.array([vocabulary[a + b] for a, b in pairs])
        self.none = len(pairs)
        #: A pair is looked up only if this may hold it.
        self.maybe = np.zeros(1 << 20, bool)
        self.maybe[self._hash(self.keys)] = True

    @staticmethod
    def _hash(keys: np.ndarray) -> np.ndarray:
        return ((keys.astype(_U) * _U(_BASE)) >> _U(44)).astype(np.int64)

    def rank(self, a: np.ndarray, b: np.ndarray) -> np.ndarray:
        keys = a * self.width + b
        out = np.full(len(keys), self.none)
        some = np.flatnonzero(self.maybe[self._hash(keys)])
        k = np.searchsorted(self.keys, keys[some])
        k[k == len(self.keys)] = 0
        same = self.keys[k] == keys[some]
        out[some[same]] = self.order[k[same]]
        return out

    def __call__(self, data: np.ndarray, n: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(ids, how many of each run) of runs of n bytes, one at least."""
        ends = np.cumsum(n)
        symbol, run = self.inner[data], np.repeat(np.arange(len(n)), n)
        symbol[ends - 1] = self.last[data[ends - 1]]
        rank = np.full(len(symbol), self.none)
        rank[:-1] = np.where(run[1:] == run[:-1], self.rank(symbol[:-1], symbol[1:]), self.none)
        done_symbols, done_runs = [], []
        while len(symbol):
            first = np.flatnonzero(np.diff(run, prepend=-1))
            least = np.minimum.reduceat((rank << 32) + np.arange(len(rank)), first)
            on = (least >> 32) < self.none
            sizes = np.diff(np.append(first, len(symbol)))
            going = np.repeat(on, sizes)
            if not on.all():
                done_symbols.append(symbol[~going])
                done_runs.append(run[~going])
            at = least[on] & 0xFFFFFFFF
            symbol[at] = self.made[least[on] >> 32]
            going[at + 1] = False
            place = np.cumsum(going) - 1
            symbol, run, rank = symbol[going], run[going], rank[going]
            at = place[at]
            after = np.minimum(at + 1, max(0, len(symbol) - 1))
            rank[at] = np.where((after > at) & (run[after] == run[at]), self.rank(symbol[at], symbol[after]), self.none) if len(at) else 0
            at = at[at > 0]
            at = at[run[at - 1] == run[at]]
            rank[at - 1] = self.rank(symbol[at - 1], symbol[at])
        symbols, runs = np.concatenate(done_symbols), np.concatenate(done_runs)
        order = np.argsort(runs, kind="stable")
        return symbols[order], np.bincount(runs, minlength=len(n))


class Known:
    """The ids of runs by two hashes of 64 bits, sorted by the first."""

    def __init__(self, width: type):
        self.key, self.check = np.zeros(0, _U), np.zeros(0, _U)
        self.at, self.n, self.used = np.zeros(0, np.int64), np.zeros(0, np.int32), np.zeros(0, np.int32)
        self.ids = np.zeros(0, width)

    @property
    def nbytes(self) -> int:
        return sum(x.nbytes for x in (self.key, self.check, self.at, self.n, self.used, self.ids))

    def find(self, key: np.ndarray, check: np.ndarray) -> np.ndarray:
        """The place of each, or -1."""
        if not len(self.key):
            return np.full(len(key), -1)
        k = np.searchsorted(self.key, key)
        k[k == len(self.key)] = 0
        return np.where((self.key[k] == key) & (self.check[k] == check), k, -1)

    def add(self, key: np.ndarray, check: np.ndarray, ids: np.ndarray, n: np.ndarray, now: int) -> None:
        """Sorted keys that find() didn't find. One that collides with a known one takes its place."""
        if len(self.key):
            k = np.searchsorted(self.key, key)
            k[k == len(self.key)] = 0
            if (lost := k[self.key[k] == key]).size:
                self._keep(np.delete(np.arange(len(self.key)), lost))
        k = np.searchsorted(self.key, key)
        at = len(self.ids) + np.cumsum(n) - n
        self.key, self.check = np.insert(self.key, k, key), np.insert(self.check, k, check)
        self.at, self.n = np.insert(self.at, k, at), np.insert(self.n, k, n)
        self.used = np.insert(self.used, k, now)
        self.ids = np.concatenate((self.ids, ids.astype(self.ids.dtype)))

    def _keep(self, rows: np.ndarray) -> None:
        self.ids = self.ids[_spread(self.at[rows], self.n[rows])]
        self.key, self.check, self.n, self.used = self.key[rows], self.check[rows], self.n[rows], self.used[rows]
        self.at = np.cumsum(self.n, dtype=np.int64) - self.n

    def bound(self, most: int) -> None:
        if self.nbytes > most:
            size = np.cumsum((2 * self.n.astype(np.int64) + 32)[order := np.argsort(-self.used, kind="stable")])
            self._keep(np.sort(order[size <= most // 2]))


class WordEncoder:
    """Texts to ids, as little-endian unsigned 32-bit integers."""

    def __init__(self, path: str, cache_bytes: int = CACHE_BYTES):
        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_file(path)
        self.cache_bytes, self.now = cache_bytes, 0
        self.merges = self._merges(json.loads(self.tokenizer.to_str()))
        self.known = Known(np.uint16 if self.tokenizer.get_vocab_size() <= 1 << 16 else np.uint32)

    @staticmethod
    def _merges(form: dict) -> Merges | None:
        """The merges, if the file's parts are those that this module knows."""
        model, cut, normal = form["model"], form["pre_tokenizer"] or {}, form["normalizer"] or {}
        cuts = cut.get("pretokenizers", [{}])
        known = (
            normal.get("normalizers") == _NORMALIZERS
            and len(cuts) == 2
            and {k: cuts[0].get(k) for k in ("type", "pattern", "behavior", "invert")} == {"type": "Split", "pattern": {"Regex": _SPLIT}, "behavior": "Removed", "invert": True}
            and {k: cuts[1].get(k) for k in ("type", "add_prefix_space", "use_regex")} == {"type": "ByteLevel", "add_prefix_space": False, "use_regex": False}
            and model["type"] == "BPE"
            and not any(model.get(k) for k in ("dropout", "unk_token", "continuing_subword_prefix", "ignore_merges", "byte_fallback"))
            and model.get("end_of_word_suffix")
            and not (form.get("truncation") or form.get("padding"))
            and all(t["content"].startswith("<|") and not (t["single_word"] or t["lstrip"] or t["rstrip"] or t["normalized"]) for t in form["added_tokens"])
        )
        return Merges(model["vocab"], model["merges"], model["end_of_word_suffix"]) if known else None

    def _library(self, texts: list[str]) -> list[np.ndarray]:
        return [np.array(e.ids, np.uint32) for e in self.tokenizer.encode_batch_fast(texts, add_special_tokens=False)]

    def encode(self, texts: list[str | None]) -> list[bytes]:
        """The ids of each text; null counts as empty."""
        if self.merges is None:
            return [ids.astype("<u4").tobytes() for t in texts for ids in self._library([t or ""])]
        out: list[list[bytes]] = [[] for _ in texts]
        for part in self._slices(texts):
            for (k, _), ids in zip(part, self._encode([t for _, t in part])):
                out[k].append(ids.tobytes())
        return [b"".join(x) for x in out]

    @staticmethod
    def _slices(texts: list[str | None]) -> Iterator[list[tuple[int, str]]]:
        """(number, text) of so many characters together; longer texts are cut at white space."""
        part: list[tuple[int, str]] = []
        size = 0
        for k, t in enumerate(texts):
            t, a = t or "", 0
            while a < len(t):
                b = len(t)
                if b - a > SLICE:
                    b = max(t.rfind(c, a, a + SLICE) for c in " \t\n\v\f\r") + 1
                    if b <= a:
                        gap = _GAP.search(t, a + SLICE)
                        b = gap.end() if gap else len(t)
                if part and size + b - a > SLICE:
                    yield part
                    part, size = [], 0
                part.append((k, t[a:b]))
                size += b - a + 1
                a = b
        if part:
            yield part

    def _encode(self, texts: list[str]) -> list[np.ndarray]:
        joined = "\n".join(texts) + "\n"
        char = np.frombuffer(joined.encode("utf-32-le", "surrogatepass"), np.uint32)
        small = np.minimum(char, BOUND)
        kind = _classes[small]
        odd = kind == ODD
        odd[:-1] |= ((char[:-1] == 39) & _contracted[small[1:]]) | ((char[:-1] == 60) & (char[1:] == 124))
        odd = np.flatnonzero(odd)
        if len(odd):  # the whole word, to the next white space on each side
            gaps = np.flatnonzero(kind == SPACE)
            w = np.unique(np.searchsorted(gaps, odd))
            odd = _spread(start := np.where(w > 0, gaps[w - 1] + 1, 0), gaps[w] - start)
            kind[odd] = ODD
        begins = kind != SPACE
        begins[1:] &= (kind[1:] != kind[:-1]) | (kind[1:] == NUMBER)
        first = np.flatnonzero(begins)
        ends = kind != SPACE
        ends[:-1] &= begins[1:] | (kind[1:] == SPACE)
        n = np.flatnonzero(ends) + 1 - first
        key, check = self._hashes(char, small, odd, first, n)
        keys, some, run = np.unique(key, return_index=True, return_inverse=True)
        checks = check[some]
        if (checks[run] != check).any():  # two runs of this slice have one key
            return self._library(texts)
        place = self.known.find(keys, checks)
        self.now += 1
        if len(new := np.flatnonzero(place < 0)):
            ids, sizes = self._learn(joined, small, kind, first[some[new]], n[some[new]])
            self.known.add(keys[new], checks[new], ids, sizes, self.now)
            place = self.known.find(keys, checks)
        known = self.known
        known.used[place] = self.now
        size = known.n[place][run].astype(np.int64)
        ids = known.ids[_spread(known.at[place][run], size)].astype("<u4")
        # A text's ids are those of the runs that begin in it.
        to = np.cumsum([len(t) + 1 for t in texts])
        cuts = np.concatenate((np.zeros(1, np.int64), np.cumsum(size)))[np.searchsorted(first, to)]
        known.bound(self.cache_bytes)
        return np.split(ids, cuts[:-1])

    @staticmethod
    def _hashes(char: np.ndarray, small: np.ndarray, odd: np.ndarray, first: np.ndarray, n: np.ndarray) -> list[np.ndarray]:
        power, inverse = _power(len(char) + 1)
        out = []
        for k in range(2):
            value = _values[k][small]
            value[odd] = _mix(char[odd].astype(_U) + _U(0x100000000 * (k + 1)))
            value *= power[: len(char)]
            total = np.concatenate((np.zeros(1, _U), np.cumsum(value)))
            out.append(_mix((total[first + n] - total[first]) * inverse[first] + n.astype(_U)))
        return out

    def _learn(self, joined: str, small: np.ndarray, kind: np.ndarray, first: np.ndarray, n: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(ids, how many of each) of runs."""
        hard = (kind[first] == ODD) | (n > LONG)
        easy = np.flatnonzero(~hard)
        sizes, parts, owner = np.zeros(len(first), np.int64), [], []
        if len(easy):
            low = _lower[small[_spread(first[easy], n[easy])]]
            wide = low > 127
            width = np.add.reduceat(1 + wide.astype(np.int64), np.cumsum(n[easy]) - n[easy])
            data = np.zeros(int(width.sum()), np.uint8)
            at = np.cumsum(1 + wide) - (1 + wide)
            data[at] = np.where(wide, 0xC0 | (low >> 6), low)
            data[at[wide] + 1] = 0x80 | (low[wide] & 63)
            ids, sizes[easy] = self.merges(data, width)
            parts.append(ids)
            owner.append(np.repeat(easy, sizes[easy]))
        hard = np.flatnonzero(hard)
        for a in range(0, len(hard), 20_000):
            some = hard[a : a + 20_000]
            ids = self._library([joined[first[r] : first[r] + n[r]] for r in some.tolist()])
            sizes[some] = [len(x) for x in ids]
            parts += ids
            owner.append(np.repeat(some, sizes[some]))
        order = np.argsort(np.concatenate(owner), kind="stable")
        return np.concatenate(parts)[order], sizes


def encoder(path: str) -> WordEncoder:
    """This worker's encoder for a vocabulary file."""
    import os

    os.environ.setdefault("TOKENIZERS_PARALLELISM", "false")
    kept = only("tokens")
    if path not in kept:
        kept.clear()
        kept[path] = WordEncoder(path)
    return kept[path]


def default_vocabulary() -> str:
    """The file that the queries use; public_tokenizers is installed beside the tokenizers library."""
    import public_tokenizers

    return public_tokenizers.path("word_bpe_49k.json")
