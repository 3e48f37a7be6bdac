"""Problem 6: one surviving record per group of duplicates, built from consistent bundles of fields."""

from __future__ import annotations

from collections.abc import Callable, Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from pagewright.llm.arrow import map_batches

#: What Python's str.strip takes for blank, as a Java pattern of anything else.
SOLID = r"[^\s\x1c-\x1f\x85\xa0  -     　]"
#: Bundles by importance. ``layout`` describes a markdown, so its engine follows from that of the markdown.
BUNDLES = ("reading", "markdown", "layout")


def instant(text: Column) -> Column:
    """An ISO-like time as a timestamp; without a zone it means UTC; null if it can't be read."""
    t = F.trim(text)
    return F.when(t.rlike(r"(?:[zZ]|[+-]\d\d:?\d\d)$"), t).otherwise(F.concat(t, F.lit("Z"))).try_cast("timestamp")


def best_bundles(candidates: Sequence[Sequence[tuple]], consistent: Callable[[int, tuple, list], bool]) -> list:
    """Choose one candidate or None for each bundle by branch and bound.

    ``candidates[b]`` are (trust, ...) tuples of bundle ``b``; a larger trust is better,
    and an earlier bundle outweighs all later ones. ``consistent(b, candidate, chosen)``
    says whether a candidate satisfies the functional dependencies given the choices for
    bundles 0..b-1. A branch is left as soon as its trusts so far, with the best of
    every open bundle, can't exceed the best whole choice known.
    """
    ordered = [sorted(c, key=lambda x: x[0], reverse=True) for c in candidates]
    none = ()
    top = [c[0][0] if c else none for c in ordered]
    best: list = [[none] * len(ordered), [None] * len(ordered)]

    def branch(b: int, trusts: list, chosen: list) -> None:
        if [*trusts, *top[b:]] <= best[0]:
            return
        if b == len(ordered):
            best[0], best[1] = trusts, chosen
            return
        for c in ordered[b]:
            if [*trusts, c[0], *top[b + 1 :]] <= best[0]:
                break
            if consistent(b, c, chosen):
                branch(b + 1, [*trusts, c[0]], [*chosen, c])
        branch(b + 1, [*trusts, none], [*chosen, None])

    branch(0, [], [])
    return best[1]


def _same_engine(b: int, candidate: tuple, chosen: list) -> bool:
    """The dependency of the archive: markdown -> engine of the layout."""
    return BUNDLES[b] != "layout" or chosen[1] is not None and candidate[2] == chosen[1][2]


def choose_bundles(readings: DataFrame, engines: DataFrame) -> DataFrame:
    """One row per page: ``pdf_stem``, ``page_num``, ``readings`` (rows of the page), ``id``,
    ``markdown_id`` and ``layout_id`` (0 where no reading has the bundle).

    Readings are trusted in this order: not rejected and with text; higher score (null,
    NaN or outside 0..100 comes last); higher trust of the engine (trimmed, lower-cased,
    _ read as -; unknown engines last); later ``recorded_at`` as an instant (unreadable
    ones last); larger id. The reading bundle (text, score, engine, time) is taken whole;
    so is the markdown, and the layout from a reading by the engine of the markdown.
    Null stems or page numbers form groups of their own kind; ties and repeated rows
    leave the larger id; other columns are ignored.

    Rows are aggregated per page and engine first (map-side, keeping the best candidate
    of each bundle), which loses nothing because the dependencies look at the engine
    alone; a page that holds a third of all rows is thus reduced before it meets in one
    place, and branch and bound sees as many candidates as there are engines.
    """
    engine = F.regexp_replace(F.lower(F.trim(F.regexp_replace("engine", r"^\s+|\s+$", ""))), "_", "-")
    trust = engines.select(F.col("engine").alias("_e"), F.col("trust").alias("_t")).groupBy("_e").agg(F.max("_t").alias("_t"))
    rank = F.struct(
        F.coalesce((F.coalesce(F.col("reason"), F.lit("")) != "rejected") & F.col("text").rlike(SOLID), F.lit(False)).cast("int").alias("ok"),
        F.when(F.col("score").between(0, 100) & ~F.isnan("score"), F.col("score")).otherwise(-1.0).alias("score"),
        F.coalesce("_t", F.lit(-1)).alias("trust"),
        F.coalesce(F.unix_micros(instant(F.col("recorded_at"))), F.lit(-(2**62))).alias("at"),
        F.col("id").alias("id"),
    )
    rows = readings.select("pdf_stem", "page_num", "id", "reason", "score", "recorded_at", engine.alias("_engine"), "text", F.col("markdown").rlike(SOLID).alias("_md"), F.col("layout_json").rlike(SOLID).alias("_ly"))
    # Engines are a list of fixed length in every archive; the planner broadcasts them only below its size limit.
    rows = rows.join(trust, F.col("_engine") == F.col("_e"), "left").select("pdf_stem", "page_num", "_engine", "_md", "_ly", rank.alias("rank"))
    per_engine = rows.groupBy("pdf_stem", "page_num", "_engine").agg(
        F.count(F.lit(1)).alias("n"), F.max("rank").alias("reading"), F.max(F.when(F.col("_md"), F.col("rank"))).alias("markdown"), F.max(F.when(F.col("_ly"), F.col("rank"))).alias("layout")
    )
    pages = per_engine.groupBy("pdf_stem", "page_num").agg(F.sum("n").alias("readings"), F.collect_list(F.struct(F.coalesce("_engine", F.lit("")).alias("engine"), *BUNDLES)).alias("c"))

    def batch(stems: list, nums: list, counts: list, groups: list) -> dict[str, list]:
        out: dict[str, list] = {"pdf_stem": stems, "page_num": nums, "readings": counts, "id": [], "markdown_id": [], "layout_id": []}
        for g in groups:
            found = [[(tuple(x[b].values()), x[b]["id"], x["engine"]) for x in g if x[b] is not None] for b in BUNDLES]
            for name, c in zip(("id", "markdown_id", "layout_id"), best_bundles(found, _same_engine)):
                out[name].append(0 if c is None else c[1])
        return out

    kinds = dict(readings.dtypes)
    return map_batches(pages, batch, f"pdf_stem {kinds['pdf_stem']}, page_num {kinds['page_num']}, readings long, id long, markdown_id long, layout_id long")


def merged_records(readings: DataFrame, engines: DataFrame) -> DataFrame:
    """One whole record per page: the reading bundle of ``id`` with the markdown and layout of the chosen readings."""
    choice = choose_bundles(readings, engines)
    roles = choice.select("id", "markdown_id", "layout_id", "readings", F.explode(F.array_distinct(F.array("id", "markdown_id", "layout_id"))).alias("_source")).where(F.col("_source") != 0)
    whole = readings.select(F.col("id").alias("_source"), "pdf_stem", "page_num", "engine", "engine_identity", "text", "score", "recorded_at", "reason", "markdown", "layout_json").dropDuplicates(["_source"])
    got = roles.join(whole, "_source")

    def pick(name: str, of: str) -> Column:
        return F.max(F.when(F.col("_source") == F.col(of), F.col(name))).alias(name)

    return got.groupBy("id", "markdown_id", "layout_id").agg(
        *[pick(c, "id") for c in ("pdf_stem", "page_num", "engine", "engine_identity", "text", "score", "recorded_at", "reason")], pick("markdown", "markdown_id"), pick("layout_json", "layout_id"), F.max("readings").alias("readings")
    )
