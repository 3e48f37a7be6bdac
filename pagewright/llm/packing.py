"""Problem 8: filling containers of a fixed number of tokens with whole documents."""

from __future__ import annotations

from bisect import bisect_left, bisect_right, insort
from collections import defaultdict

import sentencepiece
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from pagewright.llm.arrow import map_batches
from pagewright.llm.ranks import exact_ranks
from pagewright.session import materialize

CAPACITY = 2048


def token_counts(df: DataFrame, model: str, key: str = "doc_id", text: str = "text") -> DataFrame:
    """key, ``tokens`` (64-bit) of every text by the sentencepiece ``model`` file, which every machine has at that path; null and empty texts have 0."""
    of = dict(df.dtypes)[key]

    def start():
        return sentencepiece.SentencePieceProcessor(model_file=model)

    def batch(model, keys: list, texts: list) -> dict[str, list]:
        out: list[int] = []
        for i in range(0, len(texts), 256):  # whole texts, a few at a time, so the ids of one lot alone are held
            out += map(len, model.encode([t or "" for t in texts[i : i + 256]], num_threads=1))
        return {"_key": keys, "tokens": out}

    return map_batches(df.select(F.col(key).alias("_key"), F.col(text).alias("_t")), batch, f"_key {of}, tokens long", start).withColumnRenamed("_key", key)


class Run:
    """``count`` containers from number ``first`` on, all with the same sizes in them."""

    __slots__ = ("first", "count", "sizes")

    def __init__(self, first: int, count: int, sizes: tuple[int, ...]):
        self.first, self.count, self.sizes = first, count, sizes


def pack_histogram(histogram: dict[int, int], capacity: int) -> list[Run]:
    """Containers for so many items of each size, as runs of containers with equal contents.

    Items above a third of the capacity come first: at most two of them fit into one
    container, so each is matched, largest first, with the largest other one that fits.
    Smaller items, largest first, then go to the containers with the least sufficient
    gap; new ones are opened only when no gap suffices. Works on counts alone, so its
    cost depends on the number of sizes (at most ``capacity``), not of items.
    """
    left = {s: n for s, n in histogram.items() if n > 0 and 0 < s <= capacity}
    by_gap: dict[int, list[Run]] = defaultdict(list)
    gaps: list[int] = []
    opened = 0

    def put(run: Run) -> None:
        gap = capacity - sum(run.sizes)
        if not by_gap[gap]:
            insort(gaps, gap)
        by_gap[gap].append(run)

    def take(gap: int, n: int) -> list[Run]:
        out, runs = [], by_gap[gap]
        while n and runs:
            r = runs.pop()
            if r.count > n:
                runs.append(Run(r.first + n, r.count - n, r.sizes))
                r = Run(r.first, n, r.sizes)
            n -= r.count
            out.append(r)
        if not runs:
            gaps.pop(bisect_left(gaps, gap))
        return out

    large = sorted(s for s in left if 3 * s > capacity)
    while large:
        a = large[-1]
        i = bisect_right(large, capacity - a) - 1
        if i < 0:
            put(Run(opened, left[a], (a,)))
            opened += left[a]
            left[a] = 0
        else:
            b = large[i]
            if a != b:
                n = min(left[a], left[b])
                sizes = (a, b)
                left[b] -= n
                left[a] -= n
            else:
                n = left[a] // 2
                sizes = (a, a)
                left[a] -= 2 * n
                if not n:  # one is left that only fits with its like
                    n, sizes = 1, (a,)
                    left[a] = 0
            put(Run(opened, n, sizes))
            opened += n
            if not left[b]:
                large.remove(b)
        if not left[a] and a in large:
            large.remove(a)
    for s in sorted((s for s in left if 3 * s <= capacity), reverse=True):
        while left[s]:
            i = bisect_left(gaps, s)
            if i < len(gaps):
                for r in take(gaps[i], left[s]):
                    left[s] -= r.count
                    put(Run(r.first, r.count, (*r.sizes, s)))
            else:
                each = min(capacity // s, left[s])
                n = left[s] // each
                put(Run(opened, n, (s,) * each))
                opened += n
                left[s] -= n * each
    return [r for runs in by_gap.values() for r in runs]


def fill_containers(sizes: DataFrame, key: str = "doc_id", size: str = "tokens", capacity: int = CAPACITY) -> DataFrame:
    """key, ``piece``, ``tokens``, ``container`` for every item of at least one token.

    An item longer than ``capacity`` is cut into pieces of that length and a rest; all
    others stay whole. Null and zero sizes take no place and have no row; of repeated
    keys the largest size counts once; other columns are ignored.

    Only the histogram of sizes (at most ``capacity`` rows) comes to the driver. Items
    of one size are interchangeable, so each gets its rank among them from a
    range-partitioned sort, which spreads a frequent size over many partitions, and
    the rank tells its container by a small table of runs.
    """
    items = sizes.groupBy(key).agg(F.max(F.col(size).cast("long")).alias("_n")).where(F.col("_n") > 0)
    pieces = items.select(key, F.explode(F.sequence(F.lit(0).cast("long"), F.floor((F.col("_n") - 1) / capacity))).alias("piece"), "_n")
    pieces = pieces.select(key, "piece", F.least(F.lit(capacity).cast("long"), F.col("_n") - F.col("piece") * capacity).alias("tokens"), F.struct(key, "piece").alias("_v"))
    ranked = materialize(exact_ranks(pieces.select("tokens", "_v"), ["tokens"], "_v").select(F.col("_v")[key].alias(key), F.col("_v")["piece"].alias("piece"), "tokens", F.col("below").alias("rank")), "packranks")
    histogram = {r["tokens"]: r["n"] for r in ranked.groupBy("tokens").agg(F.count(F.lit(1)).alias("n")).collect()}
    segments, used = [], defaultdict(int)
    for run in pack_histogram(histogram, capacity):
        for s in set(run.sizes):
            each = run.sizes.count(s)
            segments.append((s, used[s], used[s] + each * run.count, run.first, each))
            used[s] += each * run.count
    table = sizes.sparkSession.createDataFrame(segments, "s long, lo long, hi long, first long, each long")
    # Runs number at most a few per size whatever the number of items.
    got = ranked.join(F.broadcast(table), (F.col("tokens") == F.col("s")) & (F.col("rank") >= F.col("lo")) & (F.col("rank") < F.col("hi")))
    return got.select(key, "piece", "tokens", (F.col("first") + F.floor((F.col("rank") - F.col("lo")) / F.col("each"))).alias("container"))
