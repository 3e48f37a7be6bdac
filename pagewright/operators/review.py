"""Reviewed graphs: items, decisions, name rules and what they change."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from pagewright.functions import text as T
from pagewright.operators import graph


def item_key(stem: Column, page: Column, kind: str, index: Column) -> Column:
    """The digest that names one occurrence."""
    return F.sha2(F.concat(F.lit("["), F.to_json(F.struct(stem.alias("s"))).substr(F.lit(6), F.length(F.to_json(F.struct(stem.alias("s")))) - 6), F.lit(","), page.cast("string"), F.lit(f',"{kind}",'), index.cast("string"), F.lit("]")), 256)


def items(entities: DataFrame) -> DataFrame:
    """Entity occurrences with ``item_key`` and the digest of their page's payload (``source_hash``)."""
    stamp = F.struct(F.coalesce("extracted_at", F.lit("")), F.coalesce("payload", F.lit("")))
    latest = entities.groupBy("pdf_stem", "page_num").agg(F.max_by("payload", stamp).alias("payload"))
    p = latest.withColumn("p", F.from_json("payload", graph.PAYLOAD)).where(F.col("p.entiteter").isNotNull())
    e = p.select("pdf_stem", "page_num", F.sha2("payload", 256).alias("source_hash"), F.posexplode("p.entiteter").alias("idx", "e"))
    return e.select("pdf_stem", "page_num", "idx", "source_hash", F.lower(F.trim("e.typ")).alias("typ"), F.trim("e.namn").alias("namn"), item_key(F.col("pdf_stem"), F.col("page_num"), "entity", F.col("idx")).alias("item_key"))


def reviewed(occurrences: DataFrame, decisions: DataFrame, rules: DataFrame) -> DataFrame:
    """Mentions after review: ``pdf_stem``, ``page_num``, ``label``, ``norm``, ``namn``.

    A decision counts while its ``source_hash`` is that of the page. Excluded
    occurrences go; replaced ones take the reviewer's name and kind; name rules
    (``typ``, ``source_norm``, ``target``) apply to all others; persons known by a
    family name alone take the full name if the document has one only, unless a
    reviewer has judged them.
    """
    d = decisions.select("item_key", F.col("source_hash").alias("_hash"), F.col("action").alias("_action"), F.from_json("target_json", "struct<typ:string,namn:string>").alias("_t"))
    j = occurrences.join(d, "item_key", "left").withColumn("_live", F.coalesce(F.col("_hash") == F.col("source_hash"), F.lit(False)))
    replaced = F.col("_live") & (F.col("_action") == "replace")
    j = j.where(~(F.col("_live") & (F.col("_action") == "exclude"))).select(
        "pdf_stem", "page_num", "_live", replaced.alias("_rep"), F.when(replaced, F.lower(F.trim("_t.typ"))).otherwise(F.col("typ")).alias("typ"), F.when(replaced, F.trim("_t.namn")).otherwise(F.col("namn")).alias("namn")
    )
    r = rules.select(F.col("typ").alias("_typ"), F.col("source_norm").alias("_src"), F.col("target").alias("_target"))
    j = j.join(r, (F.col("typ") == F.col("_typ")) & (T.normalize_name(F.col("namn")) == F.col("_src")) & ~F.col("_rep"), "left").withColumn("namn", F.coalesce("_target", "namn")).drop("_typ", "_src", "_target")
    j = j.where(F.col("namn") != "").withColumn("norm", T.normalize_name(F.col("namn")))
    full = graph.surname_map(j).select(F.col("pdf_stem").alias("_stem"), F.col("surname").alias("_s"), F.col("full").alias("_full"))
    j = j.join(full, (F.col("pdf_stem") == F.col("_stem")) & (F.col("norm") == F.col("_s")) & (F.col("typ") == "person") & ~F.col("_live"), "left")
    return j.where(F.col("typ").isin(*graph.LABELS)).select("pdf_stem", "page_num", F.col("typ").alias("label"), F.coalesce("_full", "norm").alias("norm"), T.display_name(F.col("namn")).alias("namn"))


def rule_preview(occurrences: DataFrame, decisions: DataFrame, rules: DataFrame, candidate: DataFrame) -> DataFrame:
    """How many mentions and pages a candidate rule would change."""
    others = rules.join(candidate, ["typ", "source_norm"], "left_anti").unionByName(candidate.select(*rules.columns))
    before, after = (reviewed(occurrences, decisions, r).groupBy("pdf_stem", "page_num", "label", "norm", "namn").agg(F.count(F.lit(1)).alias("n")) for r in (rules, others))
    keys = ["pdf_stem", "page_num", "label", "norm", "namn"]
    new = after.join(before.withColumnRenamed("n", "m"), keys, "left").withColumn("more", F.col("n") - F.coalesce("m", F.lit(0))).where("more > 0")
    return new.agg(F.coalesce(F.sum("more"), F.lit(0)).alias("entities"), F.count_distinct("pdf_stem", "page_num").alias("n_pages"))


def suggestion_ok(evidence: Column, source: Column) -> Column:
    """Whether a model's evidence stands in the page, but for case and white space."""
    flat = lambda c: F.lower(T.squeeze(c))
    return F.coalesce((flat(evidence) != "") & flat(source).contains(flat(evidence)), F.lit(False))
