"""Problem 9: evaluation passages in the corpus, by suffix arrays of corpus shards."""

from __future__ import annotations

import re
from collections import defaultdict
from collections.abc import Iterator
from typing import NamedTuple

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from pagewright.llm.scan_repair import _JOIN, look
from pagewright.session import with_package

#: Words of a shard; test words of a block; locations held at once (all bound memory, not results).
SHARD_WORDS, BLOCK_WORDS, LOCATIONS = 1_000_000, 1_000_000, 2_000_000
#: Words that must agree in a row for a location; words between two stretches of one passage stretch; least words of a stretch.
SEED, GAP, LEAST_STRETCH = 4, 5, 6
SHARE = 0.5
#: Bits of a word's number; three words make the first key of a suffix.
_BITS, _FIRST = 21, 3
_WORD = re.compile(r"[^\W_]+")


class Tests(NamedTuple):
    """A block of test passages: ``ids`` (word look -> number from 1), ``words`` (all passages in a row), ``starts``, ``items`` (ids of each passage)."""

    ids: dict[str, int]
    words: np.ndarray
    starts: np.ndarray
    items: list[list[int]]


def words_of(text: str) -> list[str]:
    """Lower-case words, words broken over lines put together."""
    return _WORD.findall(_JOIN.sub("", text).lower())


def test_blocks(items: DataFrame, key: str, passage: str) -> Iterator[Tests]:
    """The test passages in blocks of BLOCK_WORDS words; equal passages are one.

    Held-out test sets are a stated query set; they pass through the driver a block at
    a time, so a set of any size takes bounded memory. Null and empty passages are left out.
    """
    groups = items.where(F.col(passage).isNotNull()).groupBy(passage).agg(F.collect_set(key).alias("items")).orderBy(passage)
    ids: dict[str, int] = {}
    words, starts, owners = [], [0], []
    for row in groups.toLocalIterator():
        w = [ids.setdefault(look(x), len(ids) + 1) for x in words_of(row[0])]
        if len(w) < LEAST_STRETCH:
            continue
        words += w
        starts.append(len(words))
        owners.append(sorted(row[1]))
        if len(words) >= BLOCK_WORDS:
            yield Tests(ids, np.array(words, dtype=np.int64), np.array(starts), owners)
            ids, words, starts, owners = {}, [], [0], []
    if owners:
        yield Tests(ids, np.array(words, dtype=np.int64), np.array(starts), owners)


class SuffixArray:
    """The suffixes of a shard in order, by prefix doubling.

    ``w`` holds the words of all texts with a 0 after each; 0 is also any word that no
    test has. A suffix ends at its first 0; those that begin with 0 can't match and are
    left out. Suffixes are ordered by their first ``depth`` words, the length of the
    longest passage, beyond which no order matters; each round doubles the words that
    are in order and sorts only suffixes that aren't told apart yet.
    """

    def __init__(self, w: np.ndarray, depth: int):
        self.w = w if len(w) and not w[-1] else np.append(w, 0)
        w = self.w
        at = np.flatnonzero(w)
        ends = np.flatnonzero(w == 0)
        room = ends[np.searchsorted(ends, at)] - at
        second = w[at + 1]
        third = np.where(second > 0, w[np.minimum(at + 2, len(w) - 1)], 0)
        key = (w[at] << _BITS | second) << _BITS | third
        order = np.argsort(key, kind="stable")
        at, room, key = at[order], room[order], key[order]
        rank = np.zeros(len(w), dtype=np.int64)
        new = np.r_[True, key[1:] != key[:-1]] if len(key) else np.zeros(0, dtype=bool)
        group = np.flatnonzero(new)[np.cumsum(new) - 1] + 1 if len(key) else key
        rank[at] = group
        h = _FIRST
        while h < depth and len(at):
            alone = new & np.r_[new[1:], True]
            open_ = np.flatnonzero(~alone & (room >= h))
            if not len(open_):
                break
            sub = at[open_]
            k1, k2 = rank[sub], rank[sub + h]
            o = np.lexsort((k2, k1))
            sub, k1, k2 = sub[o], k1[o], k2[o]
            at[open_], room[open_] = sub, room[open_][o]
            first = np.r_[True, (k1[1:] != k1[:-1]) | (k2[1:] != k2[:-1])]
            new[open_] = first
            rank[sub] = open_[np.flatnonzero(first)][np.cumsum(first) - 1] + 1
            h *= 2
        self.at = at

    def _search(self, tw: np.ndarray, t: np.ndarray, size: np.ndarray, right: bool = False) -> np.ndarray:
        """Binary search of test suffixes, all at once: how many suffixes of the shard are smaller by the first ``size`` words (``right``: or begin with them)."""
        lo, hi = np.zeros(len(t), dtype=np.int64), np.full(len(t), len(self.at), dtype=np.int64)
        while True:
            live = np.flatnonzero(lo < hi)
            if not len(live):
                return lo
            mid = (lo[live] + hi[live]) >> 1
            p, q, n = self.at[mid], t[live], size[live]
            k = np.zeros(len(live), dtype=np.int64)
            same = np.flatnonzero(n > 0)
            while len(same):
                same = same[self.w[p[same] + k[same]] == tw[q[same] + k[same]]]
                k[same] += 1
                same = same[k[same] < n[same]]
            told = k < n
            below = np.full(len(live), right)
            below[told] = self.w[p[told] + k[told]] < tw[q[told] + k[told]]
            lo[live[below]], hi[live[~below]] = mid[below] + 1, mid[~below]

    def _common(self, tw: np.ndarray, p: np.ndarray, t: np.ndarray, size: np.ndarray) -> np.ndarray:
        """Words that shard positions ``p`` and test positions ``t`` have in common, at most ``size``."""
        k = np.zeros(len(p), dtype=np.int64)
        same = np.flatnonzero(size > 0)
        while len(same):
            same = same[self.w[p[same] + k[same]] == tw[t[same] + k[same]]]
            k[same] += 1
            same = same[k[same] < size[same]]
        return k

    def longest(self, tests: Tests) -> np.ndarray:
        """Of every test suffix the words of its longest verbatim match in the shard, which lies beside its place in the order."""
        tw, t = tests.words, np.arange(len(tests.words))
        size = tests.starts[np.searchsorted(tests.starts, t, "right")] - t
        if not len(self.at):
            return np.zeros(len(t), dtype=np.int64)
        place = self._search(tw, t, size)
        beside = [self._common(tw, self.at[np.clip(place + d, 0, len(self.at) - 1)], t, size) for d in (-1, 0)]
        return np.maximum(*beside)

    def worth(self, tests: Tests, share: float) -> np.ndarray:
        """Of every test suffix whether its passage is, by the longest matches, in the shard to at least ``share``."""
        size = self.longest(tests)
        good = np.flatnonzero(size >= SEED)
        edge = np.zeros(len(tests.words) + 1, dtype=np.int64)
        np.add.at(edge, good, 1)
        np.add.at(edge, good + size[good], -1)
        covered = np.r_[0, np.cumsum(np.cumsum(edge[:-1]) > 0)]
        held = covered[tests.starts[1:]] - covered[tests.starts[:-1]]
        return np.repeat(held + 2 >= share * np.diff(tests.starts), np.diff(tests.starts))

    def places(self, tests: Tests, wanted: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Of the wanted test suffixes with SEED words left in their passage: the suffix and its range in the order by these words."""
        inner = wanted.copy()
        for k in range(1, SEED):
            inner[tests.starts[1:] - k] = False
        t = np.flatnonzero(inner)
        size = np.full(len(t), SEED, dtype=np.int64)
        return t, self._search(tests.words, t, size), self._search(tests.words, t, size, True)

    def matches(self, tests: Tests, wanted: np.ndarray | None = None) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Maximal verbatim matches of at least SEED words: position in the shard, in the tests, length."""
        t, lo, hi = self.places(tests, np.ones(len(tests.words), dtype=bool) if wanted is None else wanted)
        return self.spread(tests, t, lo, hi)

    def spread(self, tests: Tests, t: np.ndarray, lo: np.ndarray, hi: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """The locations of ``places``, those alone that no match one word earlier holds, with their whole lengths."""
        n = hi - lo
        p = self.at[np.repeat(lo - np.r_[0, np.cumsum(n)[:-1]], n) + np.arange(n.sum())] if len(t) else np.zeros(0, dtype=np.int64)
        t = np.repeat(t, n)
        passage = np.searchsorted(tests.starts, t, "right")
        ends, begins = tests.starts[passage], tests.starts[passage - 1]
        before = self.w[p - 1]
        later = (t > begins) & (p > 0) & (before > 0) & (before == tests.words[np.maximum(t, 1) - 1])
        p, t, ends = p[~later], t[~later], ends[~later]
        return p, t, self._common(tests.words, p, t, ends - t)


def stretches(found: list[tuple[int, int, int]], doc: np.ndarray, passage: np.ndarray) -> list[tuple[int, int, int]]:
    """Chains of matches ``(doc, passage, length)`` into stretches ``(passage from, passage to, words agreeing)``.

    Matches follow one another in both texts with at most GAP words between; a match
    may overlap the one before by its first words.
    """
    found = sorted(set(found))
    best: list[list] = []
    for d, p, n in found:
        top = None
        for c in reversed(best):
            if d - c[1] > GAP and d - c[0] > 4 * len(passage):
                break
            over = max(0, c[1] - d, c[3] - p)
            if over < n and -GAP <= d - c[1] <= GAP and -GAP <= p - c[3] <= GAP and c[0] < d and c[2] <= p and (top is None or c[4] > top[4]):
                top = c
        if top is None:
            best.append([d, d + n, p, p + n, n, d])
        else:
            over = max(0, top[1] - d, top[3] - p)
            best.append([top[0], d + n, top[2], p + n, top[4] + n - over, d])
    return [(c[2], c[3], c[4], c[0], c[1]) for c in best if c[4] >= LEAST_STRETCH]


def held_words(parts: list[tuple[int, int, int, int, int]]) -> int:
    """Most passage words in one stretch or two that follow one another in both texts."""
    most = 0
    for i, a in enumerate(parts):
        most = max(most, a[2] if a[2] * 10 >= (a[4] - a[3]) * 7 else 0)
        for b in parts[i + 1 :]:
            x, y = (a, b) if a[3] <= b[3] else (b, a)
            if x[1] <= y[0] + 2 and x[4] <= y[3] + 2 and x[2] * 10 >= (x[4] - x[3]) * 7 and y[2] * 10 >= (y[4] - y[3]) * 7:
                most = max(most, x[2] + y[2])
    return most


def _shard(docs: list[int], texts: list[np.ndarray], tests: Tests, share: float = SHARE) -> Iterator[tuple[int, int, int, int, int]]:
    """(doc, passage number, words held, longest verbatim match, its position in the text) for each text with a location.

    Passages that the shard can't hold by their longest matches are passed over, however
    frequent their phrases are. Where the rest has more than LOCATIONS locations, the
    shard is halved, then the passages are taken a few at a time.
    """
    zero = np.zeros(1, dtype=np.int64)
    w = np.concatenate([x for t in texts for x in (t, zero)]) if texts else zero
    starts = np.cumsum([0, *[len(t) + 1 for t in texts]])
    array = SuffixArray(w, int(np.diff(tests.starts).max(initial=0)))
    worth = array.worth(tests, share)
    if not worth.any():
        return
    t, lo, hi = array.places(tests, worth)
    if (hi - lo).sum() > LOCATIONS and len(docs) > 1:
        half = len(docs) // 2
        yield from _shard(docs[:half], texts[:half], tests, share)
        yield from _shard(docs[half:], texts[half:], tests, share)
        return
    item = np.searchsorted(tests.starts, t, "right") - 1
    firsts = np.flatnonzero(np.r_[True, item[1:] != item[:-1]]) if len(t) else np.zeros(0, dtype=np.int64)
    lasts = np.r_[firsts[1:], len(t)]
    i = 0
    while i < len(firsts):  # whole passages, as many as may be held at once, one at least
        total = np.cumsum((hi - lo)[firsts[i] :])
        j = i + 1
        while j < len(firsts) and total[lasts[j] - firsts[i] - 1] <= LOCATIONS:
            j += 1
        part = slice(firsts[i], lasts[j - 1])
        i = j
        p, q, n = array.spread(tests, t[part], lo[part], hi[part])
        d = np.searchsorted(starts, p, "right") - 1
        of = np.searchsorted(tests.starts, q, "right") - 1
        groups: dict[tuple[int, int], list] = defaultdict(list)
        for a, b, c, e, f in zip(d.tolist(), of.tolist(), (p - starts[d]).tolist(), (q - tests.starts[of]).tolist(), n.tolist()):
            groups[a, b].append((c, e, f))
        for (a, b), found in groups.items():
            size = int(tests.starts[b + 1] - tests.starts[b])
            if sum(f for _, _, f in found) * 2 < size * share:
                continue
            passage = tests.words[tests.starts[b] : tests.starts[b + 1]]
            parts = stretches(found, texts[a], passage)
            top = max(found, key=lambda x: x[2])
            yield docs[a], b, held_words(parts) if parts else 0, top[2], top[0]


def leaked_passages(documents: DataFrame, items: DataFrame, doc: str = "doc_id", text: str = "text", item: str = "item_id", passage: str = "passage", share: float = SHARE) -> DataFrame:
    """Every document and test item it leaks: doc, item, ``held`` (share of the passage's words),
    ``longest`` (words of the longest verbatim match) and ``position`` (word at which it begins).

    Texts are gathered into shards of SHARD_WORDS words within their partition; each
    shard gets a suffix array, and every test suffix is searched in it for its longest
    verbatim match, then the suffixes of promising passages for all their locations. The
    corpus is read once for every BLOCK_WORDS words of different test passages. A document
    leaks an item if it holds at least ``share`` of the passage's words, in order, in
    one or two stretches with at most GAP words between matches. Words are compared by
    what a scanner makes of them, without case and punctuation. All items that share a
    passage count. Null and empty texts and passages, and passages under LEAST_STRETCH
    words, give nothing; repeated rows give repeated results; a very long text is a
    shard of its own; other columns are not read.
    """
    spark = with_package(documents.sparkSession)
    of, kind = dict(documents.dtypes)[doc], dict(items.dtypes)[item]
    src = documents.select(F.col(doc).alias("d"), F.col(text).alias("t")).where(F.col(text).isNotNull())
    parts = []
    for tests in test_blocks(items, item, passage):
        shared = spark.sparkContext.broadcast(tests)

        def search(batches: Iterator[pa.RecordBatch], shared=shared) -> Iterator[pa.RecordBatch]:
            tests = shared.value

            class Numbers(dict):
                def __missing__(self, word: str) -> int:
                    if len(self) > 2_000_000:
                        self.clear()
                    n = self[word] = tests.ids.get(look(word), 0)
                    return n

            number = Numbers()
            docs: list = []
            texts: list[np.ndarray] = []
            held = 0

            def done() -> pa.RecordBatch:
                rows = [(d, i, min(1.0, h / int(tests.starts[b + 1] - tests.starts[b])), n, p) for d, b, h, n, p in _shard(docs, texts, tests, share) for i in tests.items[b]]
                cols = list(zip(*rows)) if rows else [[]] * 5
                types = (dtype, pa.from_numpy_dtype(np.int64) if kind == "bigint" else pa.int32() if kind == "int" else pa.string(), pa.float64(), pa.int32(), pa.int32())
                return pa.RecordBatch.from_arrays([pa.array(list(c), type=ty) for c, ty in zip(cols, types)], names=["d", "i", "held", "longest", "position"])

            dtype = pa.int64() if of == "bigint" else pa.int32() if of == "int" else pa.string()
            for b in batches:
                for d, t in zip(b.column(0).to_pylist(), b.column(1).to_pylist()):
                    w = words_of(t)
                    x = np.fromiter(map(number.__getitem__, w), dtype=np.int64, count=len(w))
                    if np.count_nonzero(x) < LEAST_STRETCH:
                        continue
                    docs.append(d)
                    texts.append(x)
                    held += len(x) + 1
                    if held >= SHARD_WORDS:
                        yield done()
                        docs, texts, held = [], [], 0
            if docs:
                yield done()

        parts.append(src.mapInArrow(search, f"d {of}, i {kind}, held double, longest int, position int"))
    if not parts:
        parts = [spark.createDataFrame([], f"d {of}, i {kind}, held double, longest int, position int")]
    out = parts[0]
    for p in parts[1:]:
        out = out.unionByName(p)
    return out.where(F.col("held") >= share).withColumnsRenamed({"d": doc, "i": item})
