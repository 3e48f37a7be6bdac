"""Replies of language models, and logs, as rows; the models themselves stay outside."""

from __future__ import annotations

import json

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

OBSERVATIONS = "struct<observationer:array<struct<person:string,plats:string,tid:string,citat:string,notering:string,confidence:string>>>"


def first_object(raw: Column) -> Column:
    """The text from the first opening to the last closing brace."""
    return F.regexp_extract(raw, r"(?s)(\{.*\})", 1)


def observations(df: DataFrame, keys: list[str], raw: str) -> DataFrame:
    """Validated observations in replies: person, place and quote must be given, unknown confidences are medium."""
    o = df.select(*keys, F.posexplode(F.from_json(first_object(F.col(raw)), OBSERVATIONS)["observationer"]).alias("idx", "o"))
    clean = lambda c: F.trim(F.coalesce(F.col(f"o.{c}"), F.lit("")))
    o = o.select(*keys, "idx", *[clean(c).alias(c) for c in ("person", "plats", "tid", "citat", "notering")], F.when(F.lower(clean("confidence")).isin("low", "medium", "high"), F.lower(clean("confidence"))).otherwise("medium").alias("confidence"))
    return o.where((F.col("person") != "") & (F.col("plats") != "") & (F.col("citat") != ""))


def name_list(raw: str | None, most: int = 8, longest: int = 20_000) -> list[str]:
    """The first JSON list in a reply: its distinct names, whatever their case, at most ``most`` of them (the feature's limit)."""
    text = (raw or "")[:longest]
    decoder, at = json.JSONDecoder(), text.find("[")
    while at >= 0:
        try:
            found, _ = decoder.raw_decode(text, at)
        except ValueError:
            at = text.find("[", at + 1)
            continue
        names = {}
        for x in found:
            if isinstance(x, str) and x.strip():
                names.setdefault(x.strip().lower(), x.strip())
        return list(names.values())[:most]
    return []


def error_reasons(lines: DataFrame, job: str, order: str, line: str, n: int = 3) -> DataFrame:
    """Per job the last ``n`` different error messages, oldest first; a message that comes again moves to the end."""
    m = lines.select(job, order, F.regexp_extract(line, r"\[error\]\s*(.*)$", 1).alias("msg")).where((F.col("msg") != "") & (F.col("msg") != "Traceback:"))
    last = m.groupBy(job, "msg").agg(F.max(order).alias("at"))
    got = last.groupBy(job).agg(F.sort_array(F.collect_list(F.struct("at", "msg"))).alias("r"))
    return got.select(job, F.array_join(F.transform(F.slice("r", -F.least(F.size("r"), F.lit(n)), n), lambda x: x["msg"]), " | ").alias("reasons"))


def web_hits(df: DataFrame, keys: list[str], annotations: str, excluded: Column) -> DataFrame:
    """Links of an answer's annotations (JSON) without those of excluded hosts; ``excluded`` may refer to ``url``."""
    a = df.select(*keys, F.explode(F.from_json(annotations, "array<struct<url:string,title:string,content:string>>")).alias("a")).select(*keys, "a.url", F.coalesce("a.title", F.lit("")).alias("title"), F.substring(F.coalesce("a.content", F.lit("")), 1, 700).alias("excerpt"))
    return a.where(F.col("url").isNotNull() & ~excluded)


def recent_lines(lines: DataFrame, job: str, order: str, line: str, n: int = 5) -> DataFrame:
    """Per job the last ``n`` lines that aren't for debugging, as clock and message."""
    from pyspark.sql import Window

    part = lambda i: F.regexp_extract(line, r"^\S*?T?(\d\d:\d\d:\d\d)\S*\s+\[(\w+)\]\s*(.*)$", i)
    told = lines.select(job, order, part(1).alias("clock"), F.lower(part(2)).alias("level"), part(3).alias("msg")).where("level <> '' and level <> 'debug'")
    w = Window.partitionBy(job).orderBy(F.desc(order))
    return told.withColumn("back", F.row_number().over(w)).where(F.col("back") <= n).select(job, "back", F.trim(F.concat_ws(" ", "clock", "msg")).alias("line"))


def suggestions(df: DataFrame, keys: list[str], raw: str, source: str) -> DataFrame:
    """Suggestions in replies that are whole and whose evidence stands in the page, the first for each item."""
    from pagewright.operators.review import suggestion_ok

    shape = "struct<suggestions:array<struct<item_key:string,action:string,note:string,evidence:string>>>"
    s = df.select(*keys, F.col(source).alias("_source"), F.posexplode(F.from_json(first_object(F.col(raw)), shape)["suggestions"]).alias("_i", "s")).select(*keys, "_source", "_i", "s.*")
    whole = F.col("action").isin("keep", "exclude", "replace") & (F.trim(F.coalesce("note", F.lit(""))) != "") & (F.trim(F.coalesce("item_key", F.lit(""))) != "")
    ok = s.where(whole & suggestion_ok(F.col("evidence"), F.col("_source")))
    return ok.groupBy(*keys, "item_key").agg(F.min_by(F.struct("action", F.trim("note").alias("note"), F.trim("evidence").alias("evidence")), "_i").alias("x")).select(*keys, "item_key", "x.*")


def pages_to_ask(items: DataFrame, order: list[str], most: int) -> DataFrame:
    """Items with issues and no decision by page, the first ``most`` pages (a run's limit): pdf_stem, page_num, ``items``."""
    open_ = items.where((F.size("issues") > 0) & F.col("decision").isNull())
    pages = open_.groupBy("pdf_stem", "page_num").agg(F.sort_array(F.collect_list("item_key")).alias("items"))
    return pages.orderBy(*order).limit(most)
