"""Problem 5: near-duplicate texts by an LSH forest."""

from __future__ import annotations

import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from pagewright.llm.arrow import map_batches
from pagewright.llm.components import connected_components
from pagewright.session import broadcaster, materialize, release, with_package

#: Three-word sequences and one half, as the project states its problem (TESTDATA).
WORDS, SIMILARITY, LEAST_WORDS = 3, 0.5, 20
#: Signature orders, and the hashes each order has. A pair must share the first two of an order; all of them enter the sketch.
TREES, DEPTH = 16, 4
#: Rows with a common prefix up to which a region is compared in one place; a larger one is parted into blocks of about so many, and each pair of blocks is compared by itself.
BLOCK = 1024
#: Four bits of each of the 64 hashes travel with a text. At a similarity of one half 34 of them agree on average (deviation 4), at 0.2 16; pairs with fewer agreeing than this (one in 1,000 at one half) aren't looked at closer.
AGREEING = 22

_WORD = re.compile(r"[^\W_]+")
_SEED = np.random.default_rng(20240117)
_MUL = _SEED.integers(1, 2**63, (TREES * DEPTH, 1), dtype=np.uint64) * np.uint64(2) + np.uint64(1)


_LOWEST = np.uint64(0x1111111111111111)


class _Words(dict):
    """Hashes of words, kept per task."""

    def __missing__(self, word: str) -> int:
        if len(self) > 2_000_000:
            self.clear()
        h = self[word] = xxhash.xxh64_intdigest(word)
        return h


def shingles(text: str, words: _Words) -> np.ndarray:
    """Distinct hashes of the three-word sequences of ``text``, sorted; empty for fewer than LEAST_WORDS words."""
    w = _WORD.findall(text.lower())
    if len(w) < LEAST_WORDS:
        return np.empty(0, dtype=np.uint64)
    h = np.fromiter(map(words.__getitem__, w), dtype=np.uint64, count=len(w))
    s = (h[:-2] * np.uint64(0x9E3779B97F4A7C15) + h[1:-1]) * np.uint64(0xC2B2AE3D27D4EB4F) + h[2:]
    s ^= s >> np.uint64(32)
    return np.unique(s * np.uint64(0xD6E8FEB86659FD93))


def signature(s: np.ndarray) -> np.ndarray:
    """TREES x DEPTH minimum hashes of 32 bits."""
    return ((s * _MUL) >> np.uint64(32)).min(axis=1).astype(np.uint32)


def text_signatures(df: DataFrame, key: str, text: str, group: str, every: bool = False) -> DataFrame:
    """key, ``stem`` (the group as a hash, never 0), ``same`` (equal for equal word-sequence sets) and ``sig`` of each text of at least LEAST_WORDS words.

    With ``every`` the other texts have a row too, without ``sig``; ``same`` is equal for
    equal words in their order, and for a text without words it is its own.
    """
    src = df if every else df.where(F.length(text) >= 2 * LEAST_WORDS - 1)
    src = src.select(F.col(key).alias("id"), F.coalesce(F.nullif(F.xxhash64(F.coalesce(F.col(group).cast("string"), F.lit(""))), F.lit(0)), F.lit(1)).alias("stem"), F.col(text).alias("t"))

    def batch(words: _Words, ids: list, stems: list, texts: list) -> dict[str, list]:
        out: dict[str, list] = {"id": [], "stem": [], "same": [], "sig": []}
        for i, g, t in zip(ids, stems, texts):
            s = shingles(t or "", words)
            if len(s):
                out["id"].append(i)
                out["stem"].append(g)
                out["same"].append(xxhash.xxh3_128_digest(s.tobytes()))
                out["sig"].append(signature(s).tobytes())
            elif every:
                w = _WORD.findall((t or "").lower())
                out["id"].append(i)
                out["stem"].append(g)
                out["same"].append(xxhash.xxh3_128_digest(" ".join(w) if w else f"\n{i}"))
                out["sig"].append(None)
        return out

    return map_batches(src, batch, "id long, stem long, same binary, sig binary", _Words)


#: The columns of a sketch.
_SKETCH = ("b0", "b1", "b2", "b3")


def _neighbours(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Candidate pairs from rows sorted by (cell, side), one cell after another: all pairs of a cell with one side only, else those across the sides 1 and 2."""
    schema = pa.schema([("a", pa.int64()), ("b", pa.int64())])
    held: list[tuple[np.ndarray, ...]] = []

    def found(i: np.ndarray, j: np.ndarray, ids: np.ndarray, stems: np.ndarray, bits: np.ndarray) -> Iterator[pa.RecordBatch]:
        """The candidates among the pairs of rows ``i`` and ``j``."""
        keep = (stems[i] != stems[j]) | (stems[j] == 0)
        i, j = i[keep], j[keep]
        if len(i):
            other = bits[i] ^ bits[j]
            other |= other >> np.uint64(2)
            agree = TREES * DEPTH - np.bitwise_count((other | other >> np.uint64(1)) & _LOWEST).sum(axis=1, dtype=np.int64)
            a, b = ids[i[agree >= AGREEING]], ids[j[agree >= AGREEING]]
            if len(a):
                yield pa.RecordBatch.from_arrays([pa.array(np.minimum(a, b)), pa.array(np.maximum(a, b))], schema=schema)

    def cells(cell: np.ndarray, ids: np.ndarray, stems: np.ndarray, sides: np.ndarray, *words: np.ndarray) -> Iterator[pa.RecordBatch]:
        bits = np.stack(words, axis=1).view(np.uint64)
        # Cells with one side: all pairs at distance k of the order, those of all cells at once.
        i, k = np.flatnonzero(sides == 0), 1
        while len(i := i[i + k < len(cell)]) and len(i := i[cell[i] == cell[i + k]]):
            yield from found(i, i + k, ids, stems, bits)
            k += 1
        if sides[-1] or sides.any():
            starts = np.flatnonzero(np.r_[True, cell[1:] != cell[:-1]])
            for s, e in zip(starts, np.r_[starts[1:], len(cell)]):
                cut = s + int(np.searchsorted(sides[s:e], 2))
                if sides[s] and s < cut < e:
                    right = np.arange(cut, e)
                    for one in range(s, cut):
                        yield from found(np.full(len(right), one), right, ids, stems, bits)

    def joined() -> tuple[np.ndarray, ...]:
        return tuple(np.concatenate(c) for c in zip(*held))

    for b in batches:
        if not b.num_rows:
            continue
        held.append(tuple(b.column(c).to_numpy() for c in ("cell", "id", "stem", "side", *_SKETCH)))
        cell = held[-1][0]
        if cell[0] == cell[-1]:  # the cell may go on
            continue
        whole = joined()
        cut = int(np.searchsorted(whole[0], whole[0][-1]))
        held = [tuple(c[cut:] for c in whole)]
        yield from cells(*[c[:cut] for c in whole])
    if held:
        yield from cells(*joined())


def forest_candidates(reps: DataFrame, within: bool = False) -> DataFrame:
    """Distinct pairs ``a < b`` of representatives that are neighbours in some order of the forest.

    Each of the TREES orders groups the texts by its own first two minimum hashes, and
    all texts of such a region are compared whatever their number, so what is found
    doesn't depend on the size of the table or of a region. A region of more than BLOCK
    texts is parted by a salt; every pair of its blocks is a cell of its own, so the
    quadratic work of a hot region is spread over all tasks.
    Texts of one and the same stem aren't paired unless ``within``; stem 0 means several. Four bits of
    every hash travel along, so pairs that merely share frequent phrases end here.
    """
    def orders(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        salt = np.arange(1, TREES + 1, dtype=np.uint64) * np.uint64(0x9E3779B97F4A7C15)
        for b in batches:
            if not b.num_rows:
                continue
            m = np.frombuffer(b"".join(b.column("sig").to_pylist()), dtype=np.uint32).reshape(-1, TREES, DEPTH).astype(np.uint64)
            prefix = (m[:, :, 0] << np.uint64(32) | m[:, :, 1]) * np.uint64(0xD6E8FEB86659FD93) + salt
            prefix = (prefix ^ prefix >> np.uint64(31)) * np.uint64(0xBF58476D1CE4E5B9)
            four = (m.reshape(-1, TREES * DEPTH) & np.uint64(15)).reshape(-1, len(_SKETCH), 16)
            bits = (four << (np.arange(16, dtype=np.uint64) * np.uint64(4))).sum(axis=2, dtype=np.uint64).view(np.int64)
            ids, stems = (np.repeat(b.column(c).to_numpy(), TREES) for c in ("id", "stem"))
            yield pa.RecordBatch.from_arrays([pa.array(prefix.ravel().view(np.int64)), pa.array(ids), pa.array(stems), *[pa.array(np.repeat(bits[:, i], TREES)) for i in range(len(_SKETCH))]], names=["prefix", "id", "stem", *_SKETCH])

    with_package(reps.sparkSession)
    rows = reps.select("id", "stem", "sig").mapInArrow(orders, "prefix long, id long, stem long, " + ", ".join(f"{b} long" for b in _SKETCH))
    # At most TREES / BLOCK of the texts' number of regions are large, 12 bytes each; they are broadcast up to a million.
    large = materialize(rows.groupBy("prefix").agg(F.count(F.lit(1)).alias("n")).where(F.col("n") > BLOCK).select("prefix", F.ceil(F.col("n") / BLOCK).cast("int").alias("blocks")), "regions")
    sized = rows.join(broadcaster(large, 1_000_000)(large), "prefix", "left").withColumn("own", F.coalesce(F.pmod(F.xxhash64("id"), F.col("blocks")).cast("int"), F.lit(0)))
    spread = sized.withColumn("other", F.explode(F.sequence(F.lit(0), F.coalesce(F.col("blocks"), F.lit(1)) - 1)))
    x, y = F.least("own", "other"), F.greatest("own", "other")
    placed = spread.select(
        F.when(F.col("blocks").isNull(), F.col("prefix")).otherwise(F.xxhash64("prefix", x, y)).alias("cell"),
        F.when(x == y, 0).when(F.col("own") == x, 1).otherwise(2).alias("side"), "id", (F.lit(0).cast("long") if within else F.col("stem")).alias("stem"), *_SKETCH,
    )
    return placed.repartition("cell").sortWithinPartitions("cell", "side").mapInArrow(_neighbours, "a long, b long").distinct()


def _packed(s: np.ndarray) -> bytes:
    """Hashes as 48 bits each; two of the few hundred of a pair are alike by chance in one of 10^9 pairs."""
    return np.unique(s >> np.uint64(16)).view(np.uint8).reshape(-1, 8)[:, :6].tobytes()


def _unpacked(b: bytes) -> np.ndarray:
    out = np.zeros((len(b) // 6, 8), dtype=np.uint8)
    out[:, :6] = np.frombuffer(b, dtype=np.uint8).reshape(-1, 6)
    return out.view(np.uint64).ravel()


def verified(pairs: DataFrame, df: DataFrame, key: str, text: str, similarity: float = SIMILARITY) -> DataFrame:
    """The candidates whose exact share of common word sequences is at least ``similarity``, with ``similarity``."""
    wanted = pairs.select(F.explode(F.array("a", "b")).alias("id")).distinct()
    texts = df.select(F.col(key).alias("id"), F.col(text).alias("t")).join(wanted, "id", "left_semi").dropDuplicates(["id"])

    def compact(words: _Words, ids: list, ts: list) -> dict[str, list]:
        return {"id": ids, "s": [_packed(shingles(t, words)) for t in ts]}

    sets = materialize(map_batches(texts, compact, "id long, s binary", _Words), "shingles")
    both = pairs.join(sets.select(F.col("id").alias("a"), F.col("s").alias("sa")), "a").join(sets.select(F.col("id").alias("b"), F.col("s").alias("sb")), "b").select("a", "b", "sa", "sb")

    def compare(a: list, b: list, sa: list, sb: list) -> dict[str, list]:
        out: dict[str, list] = {"a": [], "b": [], "similarity": []}
        for i, j, x, y in zip(a, b, sa, sb):
            p, q = _unpacked(x), _unpacked(y)
            common = len(np.intersect1d(p, q, assume_unique=True))
            if common >= similarity * (len(p) + len(q) - common):
                out["a"].append(i)
                out["b"].append(j)
                out["similarity"].append(common / (len(p) + len(q) - common))
        return out

    return map_batches(both, compare, "a long, b long, similarity double")


class Forest:
    """The near-duplicates of a table: ``members`` and the similar pairs of different texts.

    Pairs are between groups only, and texts under LEAST_WORDS words take no part. With
    ``within`` texts of one group are paired as well and every row is a member: short
    texts with their exact copies, null texts and those without words alone.

    ``members``: id, stem, ``rep`` (smallest id among the texts with the same word
    sequences). ``pairs``: ``a < b`` (both representatives), ``similarity``.
    Ids must be unique; a null group counts as an empty one; other columns are ignored.
    """

    def __init__(self, df: DataFrame, key: str = "id", text: str = "text", group: str = "pdf_stem", similarity: float = SIMILARITY, within: bool = False):
        signed = materialize(text_signatures(df, key, text, group, within), "signatures")
        # Copies are gathered by a partial aggregate over the digest; however many there are, one row goes on.
        classes = materialize(signed.groupBy("same").agg(F.min(F.struct("id", "sig")).alias("first"), F.min("stem").alias("lo"), F.max("stem").alias("hi")).select("same", F.col("first.id").alias("rep"), "lo", "hi", F.col("first.sig").alias("sig")), "classes")
        self.members = materialize(signed.select("id", "stem", "same", F.col("sig").isNotNull().alias("long")).join(classes.select("same", "rep", "lo", "hi"), "same").select("id", "stem", "rep", "lo", "hi", "long"), "members")
        release(signed)
        reps = classes.where(F.col("sig").isNotNull()).select(F.col("rep").alias("id"), F.when(F.col("lo") == F.col("hi"), F.col("lo")).otherwise(F.lit(0).cast("long")).alias("stem"), "sig")
        candidates = materialize(forest_candidates(reps, within), "candidates")
        release(classes)
        self.pairs = materialize(verified(candidates, df, key, text, similarity), "similar")
        release(candidates)

    def between_groups(self) -> DataFrame:
        """All pairs ``id_a < id_b`` of readings of different groups, copies written out."""
        m = self.members
        left, right = m.select(F.col("rep").alias("a"), F.col("id").alias("i"), F.col("stem").alias("si")), m.select(F.col("rep").alias("b"), F.col("id").alias("j"), F.col("stem").alias("sj"))
        different = self.pairs.join(left, "a").join(right, "b").where(F.col("si") != F.col("sj")).select("i", "j")
        spread = m.where((F.col("lo") != F.col("hi")) & F.col("long"))
        copies = spread.select("rep", F.col("id").alias("i"), F.col("stem").alias("si")).join(spread.select("rep", F.col("id").alias("j"), F.col("stem").alias("sj")), "rep").where((F.col("i") < F.col("j")) & (F.col("si") != F.col("sj"))).select("i", "j")
        return different.unionByName(copies).select(F.least("i", "j").alias("id_a"), F.greatest("i", "j").alias("id_b"))

    def groups(self) -> DataFrame:
        """One row per reading: id, ``class_id`` (smallest id of its group) and ``links`` (similar different texts of its text)."""
        comp = connected_components(self.pairs)
        degree = self.pairs.select(F.explode(F.array("a", "b")).alias("node")).groupBy("node").agg(F.count(F.lit(1)).alias("links"))
        m = self.members.join(comp.withColumnRenamed("node", "rep"), "rep", "left").join(degree.withColumnRenamed("node", "rep"), "rep", "left")
        return m.select("id", F.coalesce("component", "rep").alias("class_id"), F.coalesce("links", F.lit(0)).alias("links"))
