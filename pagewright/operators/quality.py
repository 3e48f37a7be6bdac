"""Page and document quality."""

from __future__ import annotations

import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from pagewright.functions import text as T
from pagewright.session import with_package

IMAGE_PAGE_ALNUM = 30


def scored(df: DataFrame, text: str = "text") -> DataFrame:
    """``df`` with the counts of ``text`` and ``quality``; null texts count as empty."""
    t = F.coalesce(F.col(text), F.lit(""))
    counted = df.select("*", *[c.alias(n) for n, c in T.text_counts(t).items()])
    return counted.withColumn("quality", T.score_from({n: F.col(n) for n in T.text_counts(t)}))


def page_scored(df: DataFrame, text: str = "text") -> DataFrame:
    """``scored`` with ``image_page``: pages with hardly any letters are pictures and score 100."""
    d = scored(df, text).withColumn("image_page", T.alnum_count(F.coalesce(F.col(text), F.lit(""))) < IMAGE_PAGE_ALNUM)
    return d.withColumn("quality", F.when(F.col("image_page"), 100.0).otherwise(F.col("quality")))


def bucket(score: Column) -> Column:
    """Tenths of the scale, 0..9."""
    return F.least(F.greatest(F.floor(score / 10), F.lit(0)), F.lit(9))


def histogram(df: DataFrame, score: str) -> DataFrame:
    """``bucket``, ``n`` of the scored rows."""
    return df.where(F.col(score).isNotNull()).groupBy(bucket(F.col(score)).alias("bucket")).agg(F.count(F.lit(1)).alias("n"))


def cumulative(df: DataFrame, score: str) -> DataFrame:
    """The histogram with running numbers and shares (ten rows at most, so one window is harmless)."""
    w = Window.orderBy("bucket").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    every = Window.partitionBy()
    return histogram(df, score).select("bucket", "n", F.sum("n").over(w).alias("running"), F.round(100 * F.sum("n").over(w) / F.sum("n").over(every), 1).alias("running_pct"))


def grouped(df: DataFrame, key: str, score: str) -> DataFrame:
    """Per group: number, median, mean, and how many lie below 10, 30, 50, 70 and 90."""
    return df.where(F.col(score).isNotNull()).groupBy(key).agg(
        F.count(F.lit(1)).alias("n"), F.round(F.median(score), 2).alias("median"), F.round(F.avg(score), 2).alias("mean"), *[F.count_if(F.col(score) < x).alias(f"below_{x}") for x in (10, 30, 50, 70, 90)]
    )


def worst(df: DataFrame, score: str, keys: list[str], n: int) -> DataFrame:
    """The ``n`` rows with the lowest scores; ties by the keys."""
    return df.where(F.col(score).isNotNull()).orderBy(F.col(score), *keys).limit(n)


def decide(a: Column, b: Column, margin: float = 5) -> Column:
    """Which of two copies is better by more than the margin: 'a', 'b' or 'tie'."""
    return F.when(a - b > margin, "a").when(b - a > margin, "b").otherwise("tie")


def merge_plan(pairs: DataFrame, margin: float = 5) -> DataFrame:
    """What becomes of every document of one collection that may replace documents of another: ``a``, ``b``, ``category``.

    ``pairs``: ``group`` (documents under one archive number), ``a``, ``a_score``, ``b``,
    ``b_score`` (null ``b``: nothing to compare with, 'new'). Documents are taken in order,
    each against its candidates in order: one that is worse by more than the margin is
    'lost' and goes no further; a candidate that is worse is 'better' and gone for those
    after; else both are 'kept'. Only one number's few documents are looked at together.
    """
    with_package(pairs.sparkSession)

    def plan(pdf: pd.DataFrame) -> pd.DataFrame:
        won: set[str] = set()
        out: dict[str, tuple] = {}
        for a, rows in pdf.sort_values(["a", "b"], na_position="last").groupby("a", sort=True):
            best, told = ("new", None), set()
            for r in rows.itertuples():
                if r.b is None or r.b != r.b or r.b in won or r.b in told:
                    continue
                told.add(r.b)
                if r.b_score - r.a_score > margin:
                    best = best if best[0] == "better" or best[0] == "kept" else ("lost", r.b)
                    break
                if r.a_score - r.b_score > margin:
                    won.add(r.b)
                    best = ("better", r.b) if best[0] != "better" else best
                elif best[0] == "new":
                    best = ("kept", r.b)
            out[a] = best
        return pd.DataFrame({"a": list(out), "b": [x[1] for x in out.values()], "category": [x[0] for x in out.values()]})

    return pairs.groupBy("group").applyInPandas(plan, "a string, b string, category string")


def dictionary_share(texts: DataFrame, key: str, text: str, dictionary: DataFrame, word: str = "word", most: int = 50_000) -> DataFrame:
    """``key``, ``share`` of a text's words that a dictionary has; null for texts without words or with more than ``most`` (the score does without it there)."""
    words = texts.select(key, F.explode(F.regexp_extract_all(F.lower(text), F.lit(r"([a-zåäö\-]+)"), 1)).alias("w")).groupBy(key, "w").agg(F.count(F.lit(1)).alias("n"))
    known = dictionary.select(F.lower(word).alias("w")).distinct().withColumn("_in", F.lit(1))
    got = words.join(known, "w", "left").groupBy(key).agg(F.sum("n").alias("n"), F.sum(F.when(F.col("_in") == 1, F.col("n")).otherwise(0)).alias("k"))
    return texts.select(key).distinct().join(got, key, "left").select(key, F.when(F.col("n") <= most, F.round(F.col("k") / F.col("n"), 3)).alias("share"))


def comparison_score(text: Column) -> Column:
    """The score by which readings are compared: of the cleaned text, without a dictionary."""
    return T.score_from(T.text_counts(T.normalize_text(F.coalesce(text, F.lit("")))))
