"""The chunk table of the search index, and runs that keep it up to date."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from pagewright.functions import text as T
from pagewright.operators import chunk as C
from pagewright.operators import state

SCHEMA = "source string, page int, chunk_idx int, text string, mtime double"


def empty(spark: SparkSession) -> DataFrame:
    """A chunk table without rows."""
    return spark.createDataFrame([], SCHEMA)


def opened(chunks: DataFrame | None, spark: SparkSession, rebuild: bool = False) -> DataFrame:
    """The chunk table as a run finds it: empty if there is none or it is to be made anew; an older one gets the time 0 for all its chunks."""
    if chunks is None or rebuild:
        return empty(spark)
    return chunks if "mtime" in chunks.columns else chunks.withColumn("mtime", F.lit(0.0))


def without(chunks: DataFrame, sources: DataFrame) -> DataFrame:
    """The table without the chunks of the sources."""
    return state.delete(chunks, sources.select("source"), ["source"])


def stored(chunks: DataFrame, index: DataFrame, new: DataFrame, at: Column) -> tuple[DataFrame, DataFrame]:
    """Chunk table and index state after the documents of ``new`` are stored: their old chunks go, and each has its time and number of chunks."""
    counts = new.groupBy(F.regexp_replace("source", r"\.txt$", "").alias("pdf_stem")).agg(F.max("mtime").alias("text_mtime"), F.count(F.lit(1)).alias("chunks")).withColumn("indexed_at", at)
    return without(chunks, new.select("source").distinct()).unionByName(new.select(*chunks.columns)), state.upsert(index, counts, ["pdf_stem"], [F.col("text_mtime")])


def run(pages: DataFrame, disk: DataFrame, chunks: DataFrame, index: DataFrame, since: Column, at: Column) -> tuple[DataFrame, DataFrame, DataFrame]:
    """A whole run: chunk table and state afterwards, and what was done with every document.

    ``pages`` (pdf_stem, page_num, text, markdown), ``disk`` (pdf_stem, mtime). New and
    changed documents are cut (Markdown where a page has it), useless chunks left out;
    documents that are gone lose their chunks.
    """
    known = index.select("pdf_stem", F.col("text_mtime").alias("stored"))
    plan = disk.join(known, "pdf_stem", "left").withColumn("action", state.index_action(F.col("stored").isNotNull(), F.col("stored"), F.col("mtime"), since, F.lit(False)))
    wanted = pages.join(plan.where("action <> 'skip'").select("pdf_stem", "mtime"), "pdf_stem")
    md = C.markdown_chunks(wanted.where("markdown is not null"), ["pdf_stem", "page_num", "mtime"], "markdown").where(C.is_useful(F.col("chunk"), markdown=True))
    plain = C.chunks(wanted.where("markdown is null"), ["pdf_stem", "page_num", "mtime"], "text").where(C.is_useful(F.col("chunk"))).select(*md.columns)
    new = md.unionByName(plain).select(F.concat("pdf_stem", F.lit(".txt")).alias("source"), F.col("page_num").cast("int").alias("page"), F.col("chunk_idx").cast("int").alias("chunk_idx"), F.col("chunk").alias("text"), "mtime")
    gone = chunks.select("source").distinct().join(disk.select(F.concat("pdf_stem", F.lit(".txt")).alias("source")), "source", "left_anti")
    after, state_after = stored(without(chunks, gone), index, new, at)
    return after, state_after, plan.select("pdf_stem", "action")


def since(value: Column) -> Column:
    """A point in time given as seconds or as a date and time (without a zone: of the session's), in seconds; null if neither."""
    return F.coalesce(value.try_cast("double"), F.unix_micros(F.try_to_timestamp(value)) / 1e6)


def normalized(texts: DataFrame, key: str = "pdf_stem", text: str = "text") -> DataFrame:
    """A cleaning run: key, ``text`` and whether it changed."""
    clean = T.normalize_text(F.col(text))
    return texts.select(key, clean.alias("text"), (~clean.eqNullSafe(F.col(text))).alias("changed"))
