"""The archive's state tables: each change and look-up with its own key, guard and defaults.

Every function takes and returns DataFrames; ``at`` is the time of the change. Rows to
change come as a DataFrame of keys, so one call changes any number of rows in one join.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from pagewright.functions import text as T
from pagewright.operators import state

PAGE = ["pdf_stem", "page_num"]


class Unknown(KeyError):
    """A row to change isn't there."""


def require(keys: DataFrame, table: DataFrame, on: list[str]) -> None:
    """Raise Unknown if a key has no row (an action: one row comes to the driver)."""
    missing = keys.join(table, on, "left_anti").select(*on).limit(1).collect()
    if missing:
        raise Unknown(tuple(missing[0]))


def exists(keys: DataFrame, table: DataFrame, on: list[str], name: str = "found") -> DataFrame:
    """``keys`` with whether the table has a row for each."""
    have = table.select(*on).distinct().withColumn(name, F.lit(True))
    return keys.join(have, on, "left").withColumn(name, F.coalesce(name, F.lit(False)))


def _stamp(table: DataFrame, keys: DataFrame, on: list[str], values: dict[str, Column]) -> DataFrame:
    """Columns set in the rows of the given keys; a value may use columns of ``keys`` as ``new_<column>``."""
    extra = [c for c in keys.columns if c not in on]
    marked = keys.dropDuplicates(on).select(*on, *[F.col(c).alias(f"new_{c}") for c in extra], F.lit(True).alias("_hit"))
    j = table.join(marked, on, "left")
    return j.select(*[F.when(F.col("_hit"), values[c]).otherwise(F.col(c)).alias(c) if c in values else F.col(c) for c in table.columns])


def count_set(table: DataFrame, *columns: str) -> DataFrame:
    """How many rows have any of the columns set: what a reset would change."""
    return table.agg(F.count_if(F.greatest(*[F.col(c).isNotNull().cast("int") for c in columns], F.lit(0)) > 0).alias("changed"))


# ---- downloads -------------------------------------------------------------------


def download_key() -> Column:
    return F.coalesce("drive_id", "url")


def record_downloads(downloads: DataFrame, new: DataFrame, order: Column) -> DataFrame:
    """Downloads after new ones: one row per source and link (its id, else its address), the last by ``order``."""
    key = new.withColumn("_key", download_key())
    rows = state.latest(key, ["source", "_key"], [order])
    old = downloads.withColumn("_key", download_key()).join(rows, ["source", "_key"], "left_anti")
    return old.select(*downloads.columns).unionByName(rows.select(*downloads.columns))


def downloaded(wanted: DataFrame, downloads: DataFrame, key: str) -> DataFrame:
    """``wanted`` (source, drive_id, url) with ``known``: whether the same source has the id or the address."""
    by = [wanted.where(F.col(c).isNotNull()).join(downloads.select("source", c), ["source", c], "left_semi").select(key) for c in ("drive_id", "url")]
    return exists(wanted, by[0].unionByName(by[1]), [key], "known")


def first_by_digest(downloads: DataFrame, order: str) -> DataFrame:
    """The first download of each content."""
    return downloads.where(F.col("sha1").isNotNull()).groupBy("sha1").agg(F.min_by("filename", order).alias("filename"), F.min(order).alias(order))


def downloads_of(downloads: DataFrame, source: str) -> DataFrame:
    return downloads.where(F.col("source") == source).select("drive_id", "url", "filename", "sha1")


# ---- files -----------------------------------------------------------------------


def mark_merged(files: DataFrame, stems: DataFrame, at: Column) -> DataFrame:
    """Files merged now; ``stems`` brings the text's time. An unknown stem is an error."""
    require(stems, files, ["pdf_stem"])
    return _stamp(files, stems, ["pdf_stem"], {"merged_at": at, "text_mtime": F.col("new_text_mtime")})


def mark_normalized(files: DataFrame, stems: DataFrame, at: Column) -> DataFrame:
    require(stems, files, ["pdf_stem"])
    return _stamp(files, stems, ["pdf_stem"], {"normalized_at": at, "text_mtime": F.col("new_text_mtime")})


def touch_text(files: DataFrame, stems: DataFrame) -> DataFrame:
    require(stems, files, ["pdf_stem"])
    return _stamp(files, stems, ["pdf_stem"], {"text_mtime": F.col("new_text_mtime")})


def mark_redaction_checked(files: DataFrame, stems: DataFrame, at: Column) -> DataFrame:
    """Files looked through for blacked-out words; ``stems`` brings ``has_redactions``."""
    require(stems, files, ["pdf_stem"])
    return _stamp(files, stems, ["pdf_stem"], {"redaction_checked_at": at, "has_redactions": F.col("new_has_redactions").cast("int")})


def mark_ocr_done(files: DataFrame, new: DataFrame, at: Column) -> DataFrame:
    """Files read; those not known yet are added, known ones lose every mark of failure but keep source and path."""
    done = _stamp(files, new.select("pdf_stem"), ["pdf_stem"], {"tesseract_done_at": at, "tesseract_failed": F.lit(0), "tesseract_blacklisted_at": F.lit(None), "surya_failed_at": F.lit(None)})
    return _added(files, done, new, {"tesseract_done_at": at, "tesseract_failed": F.lit(0)})


def mark_ocr_failed(files: DataFrame, new: DataFrame) -> DataFrame:
    failed = _stamp(files, new.select("pdf_stem"), ["pdf_stem"], {"tesseract_failed": F.lit(1), "tesseract_done_at": F.lit(None)})
    return _added(files, failed, new, {"tesseract_failed": F.lit(1)})


def _added(files: DataFrame, changed: DataFrame, new: DataFrame, values: dict[str, Column]) -> DataFrame:
    rows = new.dropDuplicates(["pdf_stem"]).join(files, "pdf_stem", "left_anti")
    kinds = dict(files.dtypes)
    return changed.unionByName(rows.select(*[(values[c] if c in values else F.col(c) if c in new.columns else F.lit(None)).cast(kinds[c]).alias(c) for c in files.columns]))


def mark_blacklisted(files: DataFrame, stems: DataFrame, at: Column) -> DataFrame:
    require(stems, files, ["pdf_stem"])
    return _stamp(files, stems, ["pdf_stem"], {"tesseract_blacklisted_at": at})


def mark_fallback_failed(files: DataFrame, stems: DataFrame, at: Column) -> DataFrame:
    require(stems, files, ["pdf_stem"])
    return _stamp(files, stems, ["pdf_stem"], {"surya_failed_at": at})


def clear_failed(files: DataFrame) -> DataFrame:
    """The failure flag reset where it is set."""
    return state.update_where(files, F.col("tesseract_failed") == 1, {"tesseract_failed": F.lit(0)})


def clear_blacklist(files: DataFrame) -> DataFrame:
    """Blacklisted files free again, and their fallback."""
    return state.update_where(files, F.col("tesseract_blacklisted_at").isNotNull(), {"tesseract_blacklisted_at": F.lit(None), "surya_failed_at": F.lit(None)})


def retry_blacklisted(files: DataFrame) -> DataFrame:
    """Blacklisted files to be read again from the start."""
    return state.update_where(files, F.col("tesseract_blacklisted_at").isNotNull(), {"tesseract_blacklisted_at": F.lit(None), "tesseract_failed": F.lit(0), "surya_failed_at": F.lit(None)})


def reset_redactions(files: DataFrame) -> DataFrame:
    return files.withColumns({"redaction_checked_at": F.lit(None).cast("string"), "has_redactions": F.lit(None).cast("int")})


def reset_pipeline(pages: DataFrame, files: DataFrame, stems: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Pages without those of the stems, and the stems' files as if never read."""
    nothing = {"tesseract_done_at": F.lit(None), "tesseract_failed": F.lit(0), "tesseract_blacklisted_at": F.lit(None), "surya_failed_at": F.lit(None)}
    return state.delete(pages, stems, ["pdf_stem"]), _stamp(files, stems.select("pdf_stem"), ["pdf_stem"], nothing)


def ocr_flags(files: DataFrame) -> DataFrame:
    """What is known of each file: read, failed, blacklisted, checked for blacked-out words."""
    return files.select(
        "pdf_stem", F.col("tesseract_done_at").isNotNull().alias("done"), F.coalesce(F.col("tesseract_failed") == 1, F.lit(False)).alias("failed"),
        F.col("tesseract_blacklisted_at").isNotNull().alias("blacklisted"), (F.coalesce("redaction_checked_at", F.lit("")) != "").alias("checked"),
    )


def stems_where(files: DataFrame, flag: str) -> DataFrame:
    """Stems that are 'done', 'failed', 'blacklisted' or 'checked'."""
    return ocr_flags(files).where(flag).select("pdf_stem")


# ---- pages, quality, index -------------------------------------------------------


def record_pages(pages: DataFrame, new: DataFrame, order: Column) -> DataFrame:
    """Pages after new readings; a reading replaces its page whole, so what it lacks is cleared."""
    return state.upsert(pages, new, PAGE, [order])


def record_quality(quality: DataFrame, new: DataFrame, order: Column) -> DataFrame:
    return state.upsert(quality, new, ["pdf_stem"], [order])


def record_quality_pages(quality: DataFrame, new: DataFrame, extras: list[str], order: Column) -> DataFrame:
    """Page scores after new ones; the ``extras`` of a score are kept as one JSON payload."""
    rows = new.withColumn("payload", F.to_json(F.struct(*extras)))
    return state.upsert(quality, rows, PAGE, [order])


def record_ingest(index: DataFrame, new: DataFrame, order: Column) -> DataFrame:
    return state.upsert(index, new, ["pdf_stem"], [order])


def mark_done(marks: DataFrame, keys: DataFrame, on: list[str], stamp: str, at: Column) -> DataFrame:
    """A table of marks (corrected pages, decided documents, extracted pages): the given keys marked now."""
    return state.upsert(marks, keys.select(*on).distinct().withColumn(stamp, at), on, [F.col(stamp)])


def archive_reading(history: DataFrame, current: DataFrame, keys: DataFrame, reason: str, first_id: int) -> DataFrame:
    """The history with the current pages of the keys added (reason 'rescan', 'restore' or 'rejected'), with new numbers from ``first_id`` on."""
    if reason not in ("rescan", "restore", "rejected"):
        raise ValueError(f"unknown reason {reason!r}")
    rows = current.join(keys, PAGE, "left_semi").withColumn("reason", F.lit(reason))
    ranked = rows.withColumn("_h", F.concat_ws("\x00", "pdf_stem", F.lpad(F.col("page_num").cast("string"), 10, "0")))
    # Numbers only have to be new and in order: a count of what comes before within ranges of keys.
    before = ranked.select("_h").withColumn("_part", F.substring(F.md5("_h"), 1, 2))
    totals = before.groupBy("_part").count()
    offset = totals.alias("x").join(totals.alias("y"), F.col("y._part") < F.col("x._part"), "left").groupBy("x._part").agg(F.coalesce(F.sum("y.count"), F.lit(0)).alias("_offset"))
    from pyspark.sql import Window

    numbered = ranked.withColumn("_part", F.substring(F.md5("_h"), 1, 2)).join(F.broadcast(offset), "_part").withColumn("id", first_id + F.col("_offset") + F.row_number().over(Window.partitionBy("_part").orderBy("_h")) - 1)
    return history.unionByName(numbered.select(*history.columns))


def pages_with_text(pages: DataFrame) -> DataFrame:
    """Pages whose text is known, and which reading it is from."""
    return pages.where(F.col("text").isNotNull())


def reply_for(requests: DataFrame, pages: DataFrame) -> DataFrame:
    """For each request (source, page) ``status`` ('ok', 'empty', 'out of range', 'unknown source', 'refused') and the page's text; a source that climbs out of its folder is refused."""
    r = requests.withColumn("_bad", F.col("source").rlike(r"(^|[\\/])\.\.([\\/]|$)|^[\\/]|[\x00-\x1f]"))
    known = pages.groupBy("pdf_stem").agg(F.max("page_num").alias("_last"))
    j = r.join(known, r["source"] == known["pdf_stem"], "left").drop("pdf_stem").join(pages.select(F.col("pdf_stem").alias("source"), F.col("page_num").alias("page"), "text"), ["source", "page"], "left")
    blank = F.trim(F.coalesce("text", F.lit(""))) == ""
    status = F.when(F.col("_bad"), "refused").when(F.col("_last").isNull(), "unknown source").when((F.col("page") < 1) | (F.col("page") > F.col("_last")), "out of range").when(blank, "empty").otherwise("ok")
    return j.select("source", "page", status.alias("status"), F.when(status == "ok", F.col("text")).alias("text"))


def forget_attempt(history: DataFrame, attempts: DataFrame, current: DataFrame) -> DataFrame:
    """The history without the rows of attempts (id, pdf_stem, page_num, text before) whose page hasn't changed since."""
    same = attempts.join(current.select(*PAGE, F.col("text").alias("_now")), PAGE, "left").where(F.col("text").eqNullSafe(F.col("_now"))).select("id")
    return history.join(same, "id", "left_anti")


def restore(current: DataFrame, history: DataFrame, ids: DataFrame) -> DataFrame:
    """Pages with the readings of the given history rows current again."""
    back = history.join(ids, "id", "left_semi")
    return record_pages(current, back.select(*current.columns, F.col("id").alias("_id")), F.col("_id"))


# ---- review ----------------------------------------------------------------------


def rule_key(value: Column) -> Column:
    """The key of a name rule: blanks squeezed, lower case (compose accents beforehand with text.nfc where they may come apart)."""
    return F.lower(T.squeeze(value))


def save_name_rules(rules: DataFrame, new: DataFrame, at: Column) -> DataFrame:
    """Name rules after new ones, one per kind and variant; rules of an unknown kind, with a blank side or from a name to itself are left out; the first time of a rule stays."""
    kinds = F.lower(F.trim("typ"))
    n = new.select(kinds.alias("typ"), T.squeeze(F.col("source")).alias("source"), rule_key(F.col("source")).alias("source_norm"), T.squeeze(F.col("target")).alias("target"))
    n = n.where(F.col("typ").isin("person", "plats", "organisation") & (F.col("source") != "") & (F.col("target") != "") & (F.col("source_norm") != rule_key(F.col("target"))))
    n = n.groupBy("typ", "source_norm").agg(F.max(F.struct("source", "target")).alias("x")).select("typ", "source_norm", "x.*")
    old = rules.select("typ", "source_norm", "created_at")
    n = n.join(old, ["typ", "source_norm"], "left").withColumns({"created_at": F.coalesce("created_at", at), "updated_at": at})
    return rules.join(n, ["typ", "source_norm"], "left_anti").unionByName(n.select(*rules.columns))


def delete_name_rules(rules: DataFrame, gone: DataFrame) -> DataFrame:
    return rules.join(gone.select(F.lower(F.trim("typ")).alias("typ"), rule_key(F.col("source")).alias("source_norm")), ["typ", "source_norm"], "left_anti")


def save_decisions(decisions: DataFrame, history: DataFrame, new: DataFrame, order: Column, at: Column) -> tuple[DataFrame, DataFrame]:
    """Active decisions and the history after new ones: 'reset' takes an active decision away, every valid one is remembered; ones without key, hash or note or with an unknown action are left out."""
    filled = [F.trim(F.coalesce(c, F.lit(""))) != "" for c in ("item_key", "source_hash", "note")]
    n = new.where(F.col("action").isin("keep", "exclude", "replace", "reset") & filled[0] & filled[1] & filled[2]).withColumns({"note": F.trim("note"), "created_at": at})
    last = state.latest(n, ["item_key"], [order])
    active = decisions.join(last, "item_key", "left_anti").unionByName(last.where("action <> 'reset'").select(*decisions.columns))
    return active, history.unionByName(n.select(*history.columns))


def decision_history(history: DataFrame, order: str) -> DataFrame:
    """Decisions of every item with their place, the oldest first."""
    from pyspark.sql import Window

    return history.withColumn("place", F.row_number().over(Window.partitionBy("item_key").orderBy(order)))


def save_suggestions(suggestions: DataFrame, new: DataFrame, order: Column, at: Column) -> DataFrame:
    """Suggestions after new ones, one per item and page state, which wait again; incomplete ones are left out."""
    filled = [F.trim(F.coalesce(c, F.lit(""))) != "" for c in ("item_key", "source_hash", "note", "evidence")]
    n = new.where(F.col("action").isin("keep", "exclude", "replace") & filled[0] & filled[1] & filled[2] & filled[3]).withColumns({"note": F.trim("note"), "evidence": F.trim("evidence"), "status": F.lit("pending"), "created_at": at})
    return state.upsert(suggestions, n, ["item_key", "source_hash"], [order])


def set_suggestion_status(suggestions: DataFrame, keys: DataFrame, status: str) -> DataFrame:
    if status not in ("pending", "accepted", "rejected"):
        raise ValueError(f"unknown status {status!r}")
    require(keys, suggestions, ["item_key", "source_hash"])
    return _stamp(suggestions, keys.select("item_key", "source_hash"), ["item_key", "source_hash"], {"status": F.lit(status)})


def reset_orphan_decisions(decisions: DataFrame, history: DataFrame, valid: DataFrame, note: str, at: Column) -> tuple[DataFrame, DataFrame]:
    """Decisions whose item is gone taken away, each with a 'reset' in the history."""
    gone = decisions.join(valid, "item_key", "left_anti").withColumns({"action": F.lit("reset"), "target_json": F.lit("{}"), "note": F.lit(note), "created_at": at})
    return decisions.join(valid, "item_key", "left_semi"), history.unionByName(gone.select(*history.columns))


# ---- casebook, places, observations ----------------------------------------------


def record_entries(entries: DataFrame, new: DataFrame, at: Column) -> DataFrame:
    """Questions with answers added; blank ones are left out, a blank note is none, a blank mode unknown."""
    n = new.where((F.trim("question") != "") & (F.trim("answer") != ""))
    n = n.withColumns({"question": F.trim("question"), "mode": F.coalesce(F.nullif(F.trim("mode"), F.lit("")), F.lit("okänt")), "note": F.nullif(F.trim("note"), F.lit("")), "created_at": at})
    return entries.unionByName(n.select(*entries.columns))


def record_bookmarks(bookmarks: DataFrame, new: DataFrame, order: Column, at: Column) -> DataFrame:
    """Bookmarks after new ones, one per source and page; no page is kept as 0, so that it has one row too."""
    n = state.latest(new.withColumn("page", F.coalesce("page", F.lit(0))), ["source", "page"], [order])
    old = bookmarks.select("source", "page", F.col("created_at").alias("_first"))
    n = n.join(old, ["source", "page"], "left").withColumns({"created_at": F.coalesce("_first", at), "updated_at": at})
    return bookmarks.join(n, ["source", "page"], "left_anti").unionByName(n.select(*bookmarks.columns))


def newest(table: DataFrame, limit: int, *order: Column) -> DataFrame:
    """The first rows in a stated order (a listing's limit)."""
    return table.orderBy(*order).limit(max(0, limit))


def bookmarks_listed(bookmarks: DataFrame, limit: int) -> DataFrame:
    return newest(bookmarks, limit, F.desc("updated_at"), F.desc("id")).withColumn("page", F.when(F.col("page") > 0, F.col("page")))


def annotations_listed(annotations: DataFrame, limit: int, source: str | None = None) -> DataFrame:
    return newest(annotations if source is None else annotations.where(F.col("source") == source), limit, F.desc("updated_at"), F.desc("id"))


def observations_listed(observations: DataFrame, person: str | None = None) -> DataFrame:
    """Observations with their ``place`` in the listing: latest time first, those without one at the very top, then by person."""
    from pyspark.sql import Window

    rows = observations if person is None else observations.where(F.col("person") == person)
    order = [F.coalesce("time", F.lit("99:99")).desc(), F.lower("person"), F.desc("id")]
    return rows.withColumn("place", F.row_number().over(Window.orderBy(*order))) if person is not None else rows.withColumn("place", F.row_number().over(Window.partitionBy("person").orderBy(*order)))


def places_listed(places: DataFrame) -> DataFrame:
    """Places in the order of their names, whatever the case; a sorted table, as there may be many."""
    return places.orderBy(F.lower("name"), "id")


def seed(places: DataFrame, observations: DataFrame, first_places: DataFrame, first_observations: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Both tables with their first rows where both are empty, else as they are."""
    empty = places.limit(1).count() == 0 and observations.limit(1).count() == 0
    return (places.unionByName(first_places), observations.unionByName(first_observations)) if empty else (places, observations)


def update_given(table: DataFrame, changes: DataFrame, on: list[str], allowed: Column) -> DataFrame:
    """Rows with the given (not null) values of ``changes``, where the row may be changed."""
    values = {c: F.when(allowed, F.coalesce(F.col(f"new_{c}"), F.col(c))).otherwise(F.col(c)) for c in changes.columns if c not in on}
    return _stamp(table, changes, on, values)


def decide_candidates(candidates: DataFrame, ids: DataFrame, status: str, at: Column) -> DataFrame:
    """Waiting candidates made 'approved' or 'rejected'; decided ones stay."""
    waiting = F.col("status") == "pending"
    return _stamp(candidates, ids.select("id"), ["id"], {"status": F.when(waiting, F.lit(status)).otherwise(F.col("status")), "updated_at": F.when(waiting, at).otherwise(F.col("updated_at"))})


def add_usage(totals: DataFrame, new: DataFrame) -> DataFrame:
    """Usage counters with new calls added up, and partial for good once a cost was missing."""
    n = new.groupBy("profile").agg(F.count(F.lit(1)).alias("calls"), F.sum("tokens").alias("tokens"), F.sum(F.coalesce("cost", F.lit(0.0))).alias("cost"), F.max(F.col("cost").isNull().cast("int")).alias("cost_partial"))
    every = totals.unionByName(n)
    return every.groupBy("profile").agg(F.sum("calls").alias("calls"), F.sum("tokens").alias("tokens"), F.round(F.sum("cost"), 4).alias("cost"), F.max("cost_partial").alias("cost_partial"))


def rename_usage(totals: DataFrame, old: str, new: str) -> DataFrame:
    """A counter under its new name, added to one that is there already."""
    t = totals.withColumn("profile", F.when(F.col("profile") == old, new).otherwise(F.col("profile")))
    return t.groupBy("profile").agg(F.sum("calls").alias("calls"), F.sum("tokens").alias("tokens"), F.round(F.sum("cost"), 4).alias("cost"), F.max("cost_partial").alias("cost_partial"))
