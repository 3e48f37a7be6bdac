"""Pages of documents: overlays, readings, layout."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from pagewright.functions import text as T


def exploded(df: DataFrame, key: str, text: str) -> DataFrame:
    """``key``, ``page_num`` from 1, ``page``: a document's pages."""
    return df.select(key, F.posexplode(T.split_pages(F.col(text))).alias("_i", "page")).select(key, (F.col("_i") + 1).alias("page_num"), "page")


def overlaid(pages: DataFrame, updates: DataFrame, key: str) -> DataFrame:
    """Documents with updated pages put over the old ones: ``key``, ``text``.

    Missing pages are empty, pages below 1 are ignored, a page given twice is an
    error; of what has no key only the number of pages is known. Every page brings
    the gap before it along, so the work grows with the pages of a document.
    """
    old, new = (df.where(F.col("page_num") >= 1).select(key, "page_num", F.col("text").alias(t)) for df, t in ((pages, "old"), (updates, "new")))
    j = old.join(new, [key, "page_num"], "full_outer").select(key, "page_num", F.coalesce("new", "old", F.lit("")).alias("t"))
    got = j.groupBy(key).agg(F.sort_array(F.collect_list(F.struct("page_num", "t"))).alias("p"))
    before = F.concat(F.array(F.lit(0)), F.col("p.page_num"))  # one longer: the last meets no page and gives null, which isn't joined
    gap = lambda n: F.repeat(F.lit("\f"), (n - 1).cast("int"))
    twice = F.raise_error(F.lit("a page is given twice"))
    filled = F.zip_with("p", before, lambda x, last: F.when(x["page_num"] <= last, twice).otherwise(F.concat(gap(x["page_num"] - last), x["t"])))
    return got.select(key, F.when(F.col(key).isNull(), gap(F.array_max("p.page_num"))).otherwise(F.array_join(filled, "\f")).alias("text"))


def capped_candidates(df: DataFrame, score: str, keys: list[str], cap: int, group: str) -> DataFrame:
    """The ``cap`` worst rows over all (the feature's limit), gathered by document."""
    return df.orderBy(score, *keys).limit(cap).groupBy(group).agg(F.array_sort(F.collect_list("page_num")).alias("pages"))


def dark_blocks(rows: DataFrame, key: str, y: str, gap: int = 3, height: int = 8) -> DataFrame:
    """Gaps and islands: dark pixel rows within ``gap`` of each other are a block of at least ``height`` rows."""
    w = Window.partitionBy(key).orderBy(y)
    marked = rows.withColumn("_new", (F.coalesce(F.col(y) - F.lag(y).over(w), F.lit(gap + 2)) > gap + 1).cast("int"))
    numbered = marked.withColumn("_block", F.sum("_new").over(w.rowsBetween(Window.unboundedPreceding, 0)))
    return numbered.groupBy(key, "_block").agg(F.min(y).alias("top"), F.max(y).alias("bottom")).where(F.col("bottom") - F.col("top") + 1 >= height).drop("_block")
