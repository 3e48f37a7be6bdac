"""Archive queries over the state tables: every change and look-up applied to whole tables.

Tables that the data doesn't have (downloads, bookmarks, candidates, usage and the like)
are derived from those it has, the same way in the query and in its SQL.
"""

from __future__ import annotations

from pyspark.sql import functions as F

from pagewright.operators import archive_state as A
from pagewright.operators import state
from pagewright.plans.catalog import _PAGES, current_pages, query
from pagewright.sources.tables import table

AT = "2024-05-01T12:00:00+00:00"
_at = F.lit
_L = "length(pdf_stem)"

_DOWN = "down AS (SELECT source, CASE WHEN doc_id % 3 <> 0 THEN dossier END AS drive_id, 'https://x.example/' || doc_id % 500 AS url, 'f' || doc_id AS filename, sha1(text) AS sha1, doc_id FROM documents WHERE source IS NOT NULL)"


def _downloads(spark, d):
    t = table(spark, d, "documents", "doc_id", "source", "dossier", "text").where("source is not null")
    url = F.concat(F.lit("https://x.example/"), (F.col("doc_id") % 500).cast("string"))
    return t.select("source", F.when(F.col("doc_id") % 3 != 0, F.col("dossier")).alias("drive_id"), url.alias("url"), F.concat(F.lit("f"), F.col("doc_id").cast("string")).alias("filename"), F.sha1("text").alias("sha1"), "doc_id")


@query(f"WITH {_DOWN} SELECT source, drive_id, url, filename FROM down QUALIFY row_number() OVER (PARTITION BY source, coalesce(drive_id, url) ORDER BY doc_id % 4 <> 0 DESC, doc_id DESC) = 1")
def src18_record_downloads(spark, d):
    """SRC18: new downloads over old ones, by source and link."""
    down = _downloads(spark, d)
    key = down.withColumn("_k", A.download_key())
    old = state.latest(key.where("doc_id % 4 = 0"), ["source", "_k"], [F.col("doc_id")])
    return A.record_downloads(old.select("source", "drive_id", "url", "filename"), down.where("doc_id % 4 <> 0"), F.col("doc_id"))


@query(
    f"WITH {_DOWN}, have AS (SELECT * FROM down WHERE doc_id % 5 = 0) SELECT doc_id, EXISTS (SELECT 1 FROM have h WHERE h.source = w.source AND h.drive_id = w.drive_id) OR EXISTS (SELECT 1 FROM have h WHERE h.source = w.source AND h.url = w.url) AS known FROM down w WHERE doc_id % 5 <> 0"
)
def src19_downloaded(spark, d):
    """SRC19: whether a link has been downloaded, by its id or address."""
    down = _downloads(spark, d)
    return A.downloaded(down.where("doc_id % 5 <> 0"), down.where("doc_id % 5 = 0"), "doc_id").select("doc_id", "known")


@query(f"WITH {_DOWN} SELECT sha1, arg_min(filename, doc_id) AS filename, min(doc_id) AS doc_id FROM down WHERE sha1 IS NOT NULL GROUP BY sha1")
def src20_first_by_digest(spark, d):
    """SRC20: the first download of each content."""
    return A.first_by_digest(_downloads(spark, d), "doc_id")


@query(f"WITH {_DOWN} SELECT drive_id, url, filename, sha1 FROM down WHERE source = (SELECT min(source) FROM down)")
def src21_downloads_of(spark, d):
    """SRC21: downloads of a source."""
    down = _downloads(spark, d)
    return A.downloads_of(down, down.agg(F.min("source")).first()[0])


@query(
    f"""SELECT pdf_stem, CASE WHEN {_L} % 3 = 0 THEN '{AT}' ELSE merged_at END AS merged_at, CASE WHEN {_L} % 3 = 1 THEN '{AT}' ELSE normalized_at END AS normalized_at, coalesce(text_mtime, 0) + 1 + {_L} % 3 AS text_mtime,
CASE WHEN {_L} % 2 = 0 THEN '{AT}' ELSE redaction_checked_at END AS redaction_checked_at, CASE WHEN {_L} % 2 = 0 THEN CAST({_L} % 4 = 0 AS INT) ELSE has_redactions END AS has_redactions FROM pdf_files"""
)
def mut06_file_stamps(spark, d):
    """MUT6, MUT7, MUT8, LKP4: files merged, normalised, touched and looked through."""
    f = table(spark, d, "pdf_files")
    n = F.length("pdf_stem")
    times = f.select("pdf_stem", (F.coalesce("text_mtime", F.lit(0.0)) + 1 + n % 3).alias("text_mtime"))
    out = A.mark_merged(f, times.where(n % 3 == 0), F.lit(AT))
    out = A.mark_normalized(out, times.where(n % 3 == 1), F.lit(AT))
    out = A.touch_text(out, times.where(n % 3 == 2))
    out = A.mark_redaction_checked(out, f.where(n % 2 == 0).select("pdf_stem", (n % 4 == 0).alias("has_redactions")), F.lit(AT))
    return out.select("pdf_stem", "merged_at", "normalized_at", "text_mtime", "redaction_checked_at", "has_redactions")


_NEW_FILES = f"new_done AS (SELECT pdf_stem FROM pdf_files WHERE {_L} % 3 = 0 UNION SELECT 'NY-' || pdf_stem FROM pdf_files WHERE {_L} % 5 = 0), new_failed AS (SELECT pdf_stem FROM pdf_files WHERE {_L} % 3 = 1 UNION SELECT 'FEL-' || pdf_stem FROM pdf_files WHERE {_L} % 5 = 1)"


@query(
    f"""WITH {_NEW_FILES}, a AS (SELECT pdf_stem, tesseract_done_at AS done, tesseract_failed AS failed, tesseract_blacklisted_at AS black, surya_failed_at AS surya FROM pdf_files UNION ALL SELECT pdf_stem, NULL, NULL, NULL, NULL FROM (SELECT * FROM new_done UNION SELECT * FROM new_failed) WHERE pdf_stem NOT IN (SELECT pdf_stem FROM pdf_files)),
b AS (SELECT pdf_stem, CASE WHEN pdf_stem IN (FROM new_done) THEN '{AT}' WHEN pdf_stem IN (FROM new_failed) THEN NULL ELSE done END AS done, CASE WHEN pdf_stem IN (FROM new_done) THEN 0 WHEN pdf_stem IN (FROM new_failed) THEN 1 ELSE failed END AS failed,
  CASE WHEN pdf_stem IN (FROM new_done) THEN NULL ELSE black END AS black, CASE WHEN pdf_stem IN (FROM new_done) THEN NULL ELSE surya END AS surya FROM a)
SELECT pdf_stem, done, failed, CASE WHEN {_L} % 7 = 0 THEN '{AT}' ELSE black END AS black, CASE WHEN {_L} % 11 = 0 THEN '{AT}' ELSE surya END AS surya FROM b"""
)
def mut09_ocr_marks(spark, d):
    """MUT9, MUT10, LKP7, LKP16: files read, failed, blacklisted, given up."""
    f = table(spark, d, "pdf_files")
    n = F.length("pdf_stem")

    def new(rest: int, prefix: str):
        known = f.where(n % 3 == rest).select("pdf_stem")
        return known.unionByName(f.where(n % 5 == rest).select(F.concat(F.lit(prefix), F.col("pdf_stem")).alias("pdf_stem"))).select("pdf_stem", F.lit("files").alias("source"), F.lit("/x.pdf").alias("pdf_path"))

    out = A.mark_ocr_failed(A.mark_ocr_done(f, new(0, "NY-"), F.lit(AT)), new(1, "FEL-"))
    out = A.mark_blacklisted(out, out.where(n % 7 == 0).select("pdf_stem"), F.lit(AT))
    out = A.mark_fallback_failed(out, out.where(n % 11 == 0).select("pdf_stem"), F.lit(AT))
    return out.select("pdf_stem", F.col("tesseract_done_at").alias("done"), F.col("tesseract_failed").alias("failed"), F.col("tesseract_blacklisted_at").alias("black"), F.col("surya_failed_at").alias("surya"))


@query(
    """SELECT 'clear_failed' AS op, pdf_stem, CASE WHEN tesseract_failed = 1 THEN 0 ELSE tesseract_failed END AS failed, tesseract_blacklisted_at AS black, surya_failed_at AS surya FROM pdf_files
UNION ALL SELECT 'clear_blacklist', pdf_stem, tesseract_failed, NULL, CASE WHEN tesseract_blacklisted_at IS NULL THEN surya_failed_at END FROM pdf_files
UNION ALL SELECT 'retry_blacklisted', pdf_stem, CASE WHEN tesseract_blacklisted_at IS NOT NULL THEN 0 ELSE tesseract_failed END, NULL, CASE WHEN tesseract_blacklisted_at IS NULL THEN surya_failed_at END FROM pdf_files"""
)
def lkp06_resets(spark, d):
    """LKP6, LKP8, LKP9: marks of failure taken back."""
    f = table(spark, d, "pdf_files")
    outs = {"clear_failed": A.clear_failed(f), "clear_blacklist": A.clear_blacklist(f), "retry_blacklisted": A.retry_blacklisted(f)}
    rows = [o.select(F.lit(k).alias("op"), "pdf_stem", F.col("tesseract_failed").alias("failed"), F.col("tesseract_blacklisted_at").alias("black"), F.col("surya_failed_at").alias("surya")) for k, o in outs.items()]
    return rows[0].unionByName(rows[1]).unionByName(rows[2])


@query(
    """SELECT 'done' AS flag, pdf_stem FROM pdf_files WHERE tesseract_done_at IS NOT NULL UNION ALL SELECT 'failed', pdf_stem FROM pdf_files WHERE tesseract_failed = 1
UNION ALL SELECT 'blacklisted', pdf_stem FROM pdf_files WHERE tesseract_blacklisted_at IS NOT NULL UNION ALL SELECT 'checked', pdf_stem FROM pdf_files WHERE coalesce(redaction_checked_at, '') <> ''"""
)
def lkp10_stems_by_flag(spark, d):
    """LKP5, LKP10 to LKP15: stems that are read, failed, blacklisted, checked."""
    f = table(spark, d, "pdf_files")
    out = None
    for flag in ("done", "failed", "blacklisted", "checked"):
        one = A.stems_where(f, flag).select(F.lit(flag).alias("flag"), "pdf_stem")
        out = one if out is None else out.unionByName(one)
    return out


@query(
    """WITH k AS (SELECT DISTINCT pdf_stem, page_num FROM pdf_page_readings UNION SELECT pdf_stem, 9999 FROM pdf_files)
SELECT pdf_stem, page_num, EXISTS (SELECT 1 FROM pdf_page_readings r WHERE r.pdf_stem = k.pdf_stem AND r.page_num = k.page_num) AS page, EXISTS (SELECT 1 FROM quality_pages q WHERE q.pdf_stem = k.pdf_stem AND q.page_num = k.page_num) AS scored,
EXISTS (SELECT 1 FROM doc_entities e WHERE e.pdf_stem = k.pdf_stem AND e.page_num = k.page_num) AS extracted, EXISTS (SELECT 1 FROM pdf_files f WHERE f.pdf_stem = k.pdf_stem AND merged_at IS NOT NULL) AS decided FROM k"""
)
def lkp17_existence(spark, d):
    """LKP17, LKP23, LKP24, LKP30, MAP18, MAP19: whether a page, its score, its extraction, its document's decision is there."""
    r = table(spark, d, "pdf_page_readings", *A.PAGE)
    keys = r.unionByName(table(spark, d, "pdf_files", "pdf_stem").withColumn("page_num", F.lit(9999))).distinct()
    out = A.exists(keys, r, A.PAGE, "page")
    out = A.exists(out, table(spark, d, "quality_pages", *A.PAGE), A.PAGE, "scored")
    out = A.exists(out, table(spark, d, "doc_entities", *A.PAGE), A.PAGE, "extracted")
    return A.exists(out, table(spark, d, "pdf_files", "pdf_stem", "merged_at").where("merged_at is not null"), ["pdf_stem"], "decided")


@query(
    f"""WITH {_PAGES} SELECT 'file' AS op, pdf_stem, NULL AS page_num, pdf_path AS value FROM pdf_files UNION ALL SELECT 'page', pdf_stem, page_num, CAST(id AS VARCHAR) FROM pages
UNION ALL SELECT 'score', pdf_stem, page_num, CAST(CAST(max(image_page) AS INT) AS VARCHAR) FROM quality_pages GROUP BY pdf_stem, page_num UNION ALL SELECT 'mtime', pdf_stem, NULL, CAST(CAST(floor(text_mtime) AS BIGINT) AS VARCHAR) FROM pdf_files UNION ALL SELECT 'text', pdf_stem, page_num, md5(coalesce(text, '')) FROM pages"""
)
def lkp18_rows(spark, d):
    """LKP3, LKP18 to LKP21, LKP29, LKP35, FLT11: rows by key, as one look-up each."""
    f = table(spark, d, "pdf_files", "pdf_stem", "pdf_path", "text_mtime")
    p = current_pages(spark, d, "text")
    q = table(spark, d, "quality_pages", *A.PAGE, "image_page").groupBy(*A.PAGE).agg(F.max("image_page").cast("string").alias("value"))
    none = F.lit(None).cast("int").alias("page_num")
    parts = [
        f.select(F.lit("file").alias("op"), "pdf_stem", none, F.col("pdf_path").alias("value")), p.select(F.lit("page").alias("op"), *A.PAGE, F.col("id").cast("string").alias("value")), q.select(F.lit("score").alias("op"), *A.PAGE, "value"),
        f.select(F.lit("mtime").alias("op"), "pdf_stem", none, F.floor("text_mtime").cast("string").alias("value")), p.select(F.lit("text").alias("op"), *A.PAGE, F.md5(F.coalesce("text", F.lit(""))).alias("value")),
    ]
    out = parts[0]
    for x in parts[1:]:
        out = out.unionByName(x)
    return out


@query(f"WITH {_PAGES} SELECT pdf_stem, page_num, length(text) AS n FROM pages WHERE text IS NOT NULL")
def flt10_pages_with_text(spark, d):
    """FLT10, TXT20: the pages of every document whose text is known."""
    return A.pages_with_text(current_pages(spark, d, "text")).select(*A.PAGE, F.length("text").alias("n"))


@query(
    f"""WITH {_PAGES}, left_ AS (SELECT pdf_stem, count(*) AS pages FROM pages WHERE {_L} % 2 = 0 GROUP BY 1)
SELECT f.pdf_stem, coalesce(pages, 0) AS pages, CASE WHEN length(f.pdf_stem) % 2 = 1 THEN NULL ELSE tesseract_done_at END AS done, CASE WHEN length(f.pdf_stem) % 2 = 1 THEN 0 ELSE tesseract_failed END AS failed, CASE WHEN length(f.pdf_stem) % 2 = 1 THEN NULL ELSE surya_failed_at END AS surya FROM pdf_files f LEFT JOIN left_ USING (pdf_stem)"""
)
def mut17_reset_pipeline(spark, d):
    """MUT17, LKP27: documents to be read anew lose their pages and marks."""
    f, p = table(spark, d, "pdf_files"), current_pages(spark, d)
    pages, files = A.reset_pipeline(p, f, f.where(F.length("pdf_stem") % 2 == 1).select("pdf_stem"))
    n = pages.groupBy("pdf_stem").agg(F.count(F.lit(1)).alias("pages"))
    return files.join(n, "pdf_stem", "left").select("pdf_stem", F.coalesce("pages", F.lit(0)).alias("pages"), F.col("tesseract_done_at").alias("done"), F.col("tesseract_failed").alias("failed"), F.col("surya_failed_at").alias("surya"))


@query("SELECT count(*) FILTER (WHERE redaction_checked_at IS NOT NULL OR has_redactions IS NOT NULL) AS changed, 0 AS left_set FROM pdf_files")
def mut18_reset_redactions(spark, d):
    """MUT18: all marks of blacked-out words taken back, with how many there were."""
    f = table(spark, d, "pdf_files")
    before = A.count_set(f, "redaction_checked_at", "has_redactions")
    return before.crossJoin(A.count_set(A.reset_redactions(f), "redaction_checked_at", "has_redactions").select(F.col("changed").alias("left_set")))  # one row each


@query("WITH b AS (SELECT *, coalesce(reason, '') = 'restore' AS new FROM pdf_page_readings) SELECT pdf_stem, page_num, id, engine, length(markdown) AS n_markdown FROM b QUALIFY row_number() OVER (PARTITION BY pdf_stem, page_num ORDER BY new DESC, id DESC) = 1")
def mut02_record_pages(spark, d):
    """MUT2: a new reading replaces its page whole, also what it lacks."""
    r = table(spark, d, "pdf_page_readings", "id", *A.PAGE, "engine", "markdown", "reason")
    new = F.coalesce("reason", F.lit("")) == "restore"
    pages = state.latest(r.where(~new).drop("reason"), A.PAGE, [F.col("id")])
    return A.record_pages(pages, r.where(new), F.col("id")).select(*A.PAGE, "id", "engine", F.length("markdown").alias("n_markdown"))


@query(
    """WITH q AS (SELECT pdf_stem, page_num, max(score) AS score, max(coalesce(chars, 0)) AS chars, max(coalesce(image_page, 0)) AS image_page FROM quality_pages GROUP BY ALL)
SELECT pdf_stem, page_num, CASE WHEN page_num % 2 = 0 THEN 50.0 ELSE score END AS score, CASE WHEN page_num % 2 = 0 THEN '{"chars":' || chars || ',"image_page":' || image_page || '}' END AS payload FROM q"""
)
def mut04_quality_pages(spark, d):
    """MUT3, MUT4: page scores with their payload as JSON."""
    q = table(spark, d, "quality_pages").groupBy(*A.PAGE).agg(F.max("score").alias("score"), F.max(F.coalesce("chars", F.lit(0))).alias("chars"), F.max(F.coalesce("image_page", F.lit(0))).alias("image_page"))
    old = q.select(*A.PAGE, "score", F.lit(None).cast("string").alias("payload"))
    return A.record_quality_pages(old, q.where("page_num % 2 = 0").withColumn("score", F.lit(50.0)), ["chars", "image_page"], F.col("chars"))


@query(f"WITH s AS (SELECT pdf_stem, count(*) AS chunks FROM pdf_page_readings GROUP BY 1) SELECT pdf_stem, CASE WHEN {_L} % 2 = 0 THEN chunks + 100 ELSE chunks END AS chunks, CASE WHEN {_L} % 2 = 0 THEN '{AT}' ELSE 'old' END AS indexed_at FROM s WHERE {_L} % 5 <> 0")
def mut05_record_ingest(spark, d):
    """MUT5, LKP22: what is indexed of each document, some indexed anew, some dropped."""
    s = table(spark, d, "pdf_page_readings", "pdf_stem").groupBy("pdf_stem").agg(F.count(F.lit(1)).alias("chunks"))
    n = F.length("pdf_stem")
    new = s.where(n % 2 == 0).select("pdf_stem", (F.col("chunks") + 100).alias("chunks"), F.lit(AT).alias("indexed_at"))
    return state.delete(A.record_ingest(s.withColumn("indexed_at", F.lit("old")), new, F.col("chunks")), s.where(n % 5 == 0).select("pdf_stem"), ["pdf_stem"])


@query(f"SELECT pdf_stem, page_num, max(CASE WHEN page_num % 3 = 0 THEN '{AT}' ELSE scored_at END) AS at FROM quality_pages WHERE scored_at IS NOT NULL OR page_num % 3 = 0 GROUP BY ALL")
def mut12_marks(spark, d):
    """MUT12, MUT13, MAP17: pages marked as done, again or for the first time."""
    q = table(spark, d, "quality_pages", *A.PAGE, "scored_at")
    old = q.where("scored_at is not null").groupBy(*A.PAGE).agg(F.max("scored_at").alias("at"))
    return A.mark_done(old, q.where("page_num % 3 = 0"), A.PAGE, "at", F.lit(AT))


@query(f"WITH {_PAGES}, k AS (SELECT * FROM pages WHERE page_num % 2 = 1) SELECT pdf_stem, page_num, 'rescan' AS reason, true AS is_new FROM k")
def mut15_archive(spark, d):
    """MUT15, WIN11: current pages written to the history before they are read anew, under new numbers."""
    r = table(spark, d, "pdf_page_readings", "id", *A.PAGE, "engine", "text", "reason")
    last = r.agg(F.max("id")).first()[0] or 0
    cur = current_pages(spark, d, "engine", "text")
    out = A.archive_reading(r.limit(0), cur, cur.where("page_num % 2 = 1").select(*A.PAGE), "rescan", last + 1)
    ids = out.groupBy("id").agg(F.count(F.lit(1)).alias("n"))
    return out.join(ids, "id").select(*A.PAGE, "reason", ((F.col("n") == 1) & (F.col("id") > last)).alias("is_new"))


@query(
    f"""WITH {_PAGES}, last AS (SELECT pdf_stem, max(page_num) AS n FROM pages GROUP BY 1), req AS (SELECT pdf_stem AS source, page_num AS page FROM pages UNION SELECT pdf_stem, 0 FROM last UNION SELECT pdf_stem, n + 1 FROM last UNION SELECT '../' || pdf_stem, 1 FROM last UNION SELECT 'x' || pdf_stem, 1 FROM last)
SELECT source, page, CASE WHEN starts_with(source, '../') THEN 'refused' WHEN n IS NULL THEN 'unknown source' WHEN page < 1 OR page > n THEN 'out of range' WHEN trim(coalesce(text, '')) = '' THEN 'empty' ELSE 'ok' END AS status,
CASE WHEN trim(coalesce(text, '')) <> '' THEN length(text) END AS n_text FROM req LEFT JOIN last l ON l.pdf_stem = source LEFT JOIN pages p ON p.pdf_stem = source AND p.page_num = page"""
)
def src26_page_replies(spark, d):
    """SRC26: pages by source and number, with a reason where there is none."""
    p = current_pages(spark, d, "text")
    last = p.groupBy("pdf_stem").agg(F.max("page_num").alias("n"))
    s = F.col("pdf_stem")
    req = p.select(s.alias("source"), F.col("page_num").alias("page"))
    for src, page in ((s, F.lit(0)), (s, F.col("n") + 1), (F.concat(F.lit("../"), s), F.lit(1)), (F.concat(F.lit("x"), s), F.lit(1))):
        req = req.unionByName(last.select(src.alias("source"), page.cast("int").alias("page")))
    return A.reply_for(req.distinct(), p).select("source", "page", "status", F.length("text").alias("n_text"))


@query(
    f"""WITH {_PAGES} SELECT r.id FROM pdf_page_readings r LEFT JOIN pages p ON p.pdf_stem = r.pdf_stem AND p.page_num = r.page_num WHERE NOT (coalesce(r.reason, '') = 'rejected' AND r.text IS NOT DISTINCT FROM p.text)"""
)
def etc12_forget_attempts(spark, d):
    """ETC12, LKP26: attempts that changed nothing leave the history."""
    r = table(spark, d, "pdf_page_readings", "id", *A.PAGE, "text", "reason")
    return A.forget_attempt(r, r.where("reason = 'rejected'"), current_pages(spark, d, "text")).select("id")


@query("WITH b AS (SELECT *, coalesce(reason, '') = 'rejected' AS back FROM pdf_page_readings), c AS (SELECT *, max(id) OVER (PARTITION BY pdf_stem, page_num) = id AS cur FROM b) SELECT pdf_stem, page_num, md5(coalesce(text, '')) AS h FROM c WHERE back OR cur QUALIFY row_number() OVER (PARTITION BY pdf_stem, page_num ORDER BY back DESC, id DESC) = 1")
def etc13_restore(spark, d):
    """ETC13: readings of the history made current again."""
    r = table(spark, d, "pdf_page_readings", "id", *A.PAGE, "text", "reason")
    out = A.restore(current_pages(spark, d, "text").select(*A.PAGE, "text"), r, r.where("reason = 'rejected'").select("id"))
    return out.select(*A.PAGE, F.md5(F.coalesce("text", F.lit(""))).alias("h"))


# ---- review ----------------------------------------------------------------------

_TARGETS = "targets AS (SELECT item_key, trim(target_json::JSON->>'$.typ') AS typ, trim(target_json::JSON->>'$.namn') AS namn, created_at FROM graph_review_decisions WHERE json_valid(target_json) AND target_json::JSON->>'$.namn' IS NOT NULL)"
_SQZ = "trim(regexp_replace({0}, '\\s+', ' ', 'g'))"


def _rule_rows(spark, d):
    t = table(spark, d, "graph_review_decisions", "item_key", "target_json").select("item_key", F.from_json("target_json", "struct<typ:string,namn:string>").alias("t"))
    return t.where("t.namn is not null").select("item_key", F.col("t.typ").alias("typ"), F.col("t.namn").alias("source"), F.concat(F.col("t.namn"), F.lit(" d.y.")).alias("target"))


@query(
    f"""WITH {_TARGETS}, n AS (SELECT lower(typ) AS typ, {_SQZ.format('namn')} AS source FROM targets WHERE lower(typ) IN ('person', 'plats', 'organisation')), k AS (SELECT typ, lower(source) AS source_norm, max((source, source || ' d.y.')) AS x FROM n WHERE source <> '' GROUP BY ALL)
SELECT typ, source_norm, x[1] AS source, x[2] AS target, '{AT}' AS created_at FROM k WHERE typ <> 'organisation'"""
)
def gr15_name_rules(spark, d):
    """GR15, LKP31, LKP32: name rules saved by kind and variant, those of one kind deleted."""
    new = _rule_rows(spark, d)
    none = spark.createDataFrame([], "typ string, source_norm string, source string, target string, created_at string, updated_at string")
    rules = A.save_name_rules(none, new, F.lit(AT))
    return A.delete_name_rules(rules, new.where("lower(trim(typ)) = 'organisation'")).select("typ", "source_norm", "source", "target", "created_at")


_NEW_DEC = "nd AS (SELECT item_key, source_hash, CASE length(item_key || note) % 3 WHEN 0 THEN 'reset' WHEN 1 THEN 'exclude' ELSE 'okänd' END AS action, target_json, note, created_at FROM graph_review_decisions WHERE note IS NOT NULL AND trim(note) <> '' AND trim(coalesce(source_hash, '')) <> '')"


def _new_decisions(spark, d):
    g = table(spark, d, "graph_review_decisions").where("note is not null")
    n = F.length(F.concat("item_key", "note")) % 3
    return g.withColumn("action", F.when(n == 0, "reset").when(n == 1, "exclude").otherwise("okänd"))


@query(
    f"""WITH {_NEW_DEC} SELECT 'active' AS part, g.item_key, CASE WHEN n.item_key IS NULL THEN g.action ELSE n.action END AS action FROM graph_review_decisions g LEFT JOIN (SELECT * FROM nd WHERE action <> 'okänd') n USING (item_key) WHERE coalesce(n.action, '') <> 'reset'
UNION ALL SELECT 'history', item_key, action FROM nd WHERE action <> 'okänd'"""
)
def gr16_decisions(spark, d):
    """GR16, LKP33: decisions saved, reset and remembered."""
    g = table(spark, d, "graph_review_decisions")
    active, history = A.save_decisions(g, g.limit(0), _new_decisions(spark, d), F.col("note"), F.lit(AT))
    return active.select(F.lit("active").alias("part"), "item_key", "action").unionByName(history.select(F.lit("history").alias("part"), "item_key", "action"))


@query("SELECT item_key, action, row_number() OVER (PARTITION BY item_key ORDER BY seq) AS place FROM (SELECT item_key, action, '1' AS seq FROM graph_review_decisions UNION ALL SELECT item_key, 'reset', '2' FROM graph_review_decisions WHERE action = 'exclude')")
def win10_decision_history(spark, d):
    """WIN10: the decisions of every item, the oldest first, resets too."""
    g = table(spark, d, "graph_review_decisions", "item_key", "action")
    h = g.withColumn("seq", F.lit("1")).unionByName(g.where("action = 'exclude'").select("item_key", F.lit("reset").alias("action"), F.lit("2").alias("seq")))
    return A.decision_history(h, "seq").select("item_key", "action", "place")


@query(
    """WITH s AS (SELECT item_key, source_hash, action, trim(note) AS note FROM graph_review_decisions WHERE action IN ('keep', 'exclude', 'replace') AND trim(coalesce(note, '')) <> '' AND trim(coalesce(source_hash, '')) <> '')
SELECT item_key, source_hash, action, note, CASE WHEN action = 'exclude' THEN 'accepted' ELSE 'pending' END AS status FROM s"""
)
def gr17_suggestions(spark, d):
    """GR17, LKP36, LKP37: suggestions saved as waiting, some accepted."""
    g = table(spark, d, "graph_review_decisions").withColumn("evidence", F.lit("belägg"))
    none = spark.createDataFrame([], "item_key string, source_hash string, action string, note string, evidence string, status string, created_at string")
    s = A.save_suggestions(none, g, F.col("created_at"), F.lit(AT))
    return A.set_suggestion_status(s, s.where("action = 'exclude'"), "accepted").select("item_key", "source_hash", "action", "note", "status")


@query("WITH v AS (SELECT item_key FROM graph_review_decisions WHERE action = 'keep') SELECT 'active' AS part, item_key, action FROM graph_review_decisions WHERE action = 'keep' UNION ALL SELECT 'history', item_key, 'reset' FROM graph_review_decisions WHERE action <> 'keep'")
def set09_orphans(spark, d):
    """SET9, ETC21: decisions on items that are gone are reset and remembered."""
    g = table(spark, d, "graph_review_decisions")
    active, history = A.reset_orphan_decisions(g, g.limit(0), g.where("action = 'keep'").select("item_key"), "objektet saknas", F.lit(AT))
    return active.select(F.lit("active").alias("part"), "item_key", "action").unionByName(history.select(F.lit("history").alias("part"), "item_key", "action"))


# ---- casebook, places, observations, usage ---------------------------------------


@query(f"SELECT item_id, trim(question) AS question, CASE WHEN item_id % 2 = 0 THEN 'okänt' ELSE suite END AS mode, CASE WHEN item_id % 3 <> 0 THEN suite END AS note, '{AT}' AS created_at FROM eval_items WHERE trim(question) <> '' AND item_id % 5 <> 0")
def mut37_casebook(spark, d):
    """MUT37, LKP38: questions with answers added; blank ones left out, blank notes none; some deleted."""
    e = table(spark, d, "eval_items", "item_id", "question", "passage", "suite").withColumn("answer", F.col("passage"))
    new = e.select("item_id", F.concat(F.lit(" "), F.col("question")).alias("question"), "answer", F.when(F.col("item_id") % 2 == 0, " ").otherwise(F.col("suite")).alias("mode"), F.when(F.col("item_id") % 3 == 0, " ").otherwise(F.col("suite")).alias("note"))
    none = spark.createDataFrame([], "item_id long, question string, answer string, mode string, note string, created_at string")
    out = A.record_entries(none, new, F.lit(AT))
    return state.delete(out, e.where("item_id % 5 = 0").select("item_id"), ["item_id"]).select("item_id", "question", "mode", "note", "created_at")


@query(
    """WITH b AS (SELECT dossier AS source, CASE WHEN doc_id % 4 = 0 THEN 0 ELSE doc_id % 7 END AS page, max(doc_id) AS id FROM documents WHERE dossier IS NOT NULL GROUP BY ALL)
SELECT source, CASE WHEN page > 0 THEN page END AS page, id FROM b ORDER BY id DESC LIMIT 40"""
)
def top10_bookmarks(spark, d):
    """TOP10, MUT38, LKP39: bookmarks by source and page (no page is one too), the newest 40 (the listing's limit)."""
    t = table(spark, d, "documents", "doc_id", "dossier").where("dossier is not null")
    new = t.select(F.col("dossier").alias("source"), F.when(F.col("doc_id") % 4 != 0, F.col("doc_id") % 7).alias("page"), F.col("doc_id").alias("id"))
    none = spark.createDataFrame([], "source string, page long, id long, created_at string, updated_at string")
    marks = A.record_bookmarks(none, new, F.col("id"), F.lpad(F.col("id").cast("string"), 12, "0"))
    return A.bookmarks_listed(marks, 40).select("source", "page", "id")


@query("SELECT doc_id AS id, source FROM documents WHERE source = (SELECT min(source) FROM documents) ORDER BY added_at DESC NULLS LAST, doc_id DESC LIMIT 30")
def top11_annotations(spark, d):
    """TOP11, MUT39, MUT40, LKP40: the newest 30 annotations of a source (the listing's limit)."""
    t = table(spark, d, "documents", "doc_id", "source", "added_at")
    return A.annotations_listed(t.select(F.col("doc_id").alias("id"), "source", F.col("added_at").alias("updated_at")), 30, t.agg(F.min("source")).first()[0]).select("id", "source")


@query("SELECT event_id AS id, event_type AS status FROM events WHERE event_type = 'error' ORDER BY ts DESC, event_id DESC LIMIT 25")
def top06_candidates(spark, d):
    """TOP6, TOP12, TOP13: the newest 25 of a status (the listing's limit)."""
    e = table(spark, d, "events", "event_id", "event_type", "ts").where("event_type = 'error'")
    return A.newest(e, 25, F.desc("ts"), F.desc("event_id")).select(F.col("event_id").alias("id"), F.col("event_type").alias("status"))


_OBS = "obs AS (SELECT event_id AS id, 'P' || user_id AS person, CASE WHEN event_id % 6 <> 0 THEN strftime(ts, '%H:%M') END AS time FROM events)"


def _observations(spark, d):
    e = table(spark, d, "events", "event_id", "user_id", "ts")
    return e.select(F.col("event_id").alias("id"), F.concat(F.lit("P"), F.col("user_id").cast("string")).alias("person"), F.when(F.col("event_id") % 6 != 0, F.date_format("ts", "HH:mm")).alias("time"))


@query(f"WITH {_OBS} SELECT id, row_number() OVER (PARTITION BY person ORDER BY coalesce(time, '99:99') DESC, lower(person), id DESC) AS place FROM obs")
def top07_observations(spark, d):
    """TOP7: the observations of every person in the order of the listing."""
    return A.observations_listed(_observations(spark, d)).select("id", "place")


@query("SELECT n_nationkey AS id, n_name AS name FROM nation WHERE n_nationkey % 3 <> 0 UNION ALL SELECT r_regionkey + 100, r_name FROM region")
def top08_places(spark, d):
    """TOP8, MAP20, MAP21, MAP22: places first sown, then added and deleted, in the order of their names."""
    n = table(spark, d, "nation", "n_nationkey", "n_name").select(F.col("n_nationkey").cast("long").alias("id"), F.col("n_name").alias("name"))
    r = table(spark, d, "region", "r_regionkey", "r_name").select((F.col("r_regionkey") + 100).cast("long").alias("id"), F.col("r_name").alias("name"))
    places, _ = A.seed(n.limit(0), _observations(spark, d).limit(0), n, _observations(spark, d))
    same, _ = A.seed(places, _observations(spark, d).limit(0), r, _observations(spark, d))
    return A.places_listed(state.delete(same.unionByName(r), n.where("id % 3 = 0"), ["id"]))


@query("SELECT pdf_stem, lower(trim(source)) AS source, redaction_checked_at IS NOT NULL AS checked FROM pdf_files")
def top14_documents_for_review(spark, d):
    """TOP14: what a reviewer sees of every document, in the order of the stems."""
    return table(spark, d, "pdf_files").orderBy("pdf_stem").select("pdf_stem", F.lower(F.trim("source")).alias("source"), F.col("redaction_checked_at").isNotNull().alias("checked"))


@query(
    f"""SELECT event_id AS id, CASE WHEN event_type = 'view' THEN CASE event_id % 3 WHEN 0 THEN 'approved' WHEN 1 THEN 'rejected' ELSE 'pending' END ELSE event_type END AS status,
CASE WHEN event_type = 'view' AND event_id % 3 = 2 AND event_id % 2 = 0 THEN 'ny' ELSE 'gammal' END AS note FROM events WHERE event_id % 10 <> 0"""
)
def map15_candidates(spark, d):
    """MAP15, MAP16, MAP24, MAP25: waiting candidates rejected and approved, those that wait changed, some deleted."""
    e = table(spark, d, "events", "event_id", "event_type")
    c = e.select(F.col("event_id").alias("id"), F.when(F.col("event_type") == "view", "pending").otherwise(F.col("event_type")).alias("status"), F.lit("gammal").alias("note"), F.lit("x").alias("updated_at"))
    c = A.decide_candidates(c, c.where("id % 3 = 0"), "approved", F.lit(AT))
    c = A.decide_candidates(c, c.where("id % 3 = 1"), "rejected", F.lit(AT))
    c = A.update_given(c, c.where("id % 2 = 0").select("id", F.lit("ny").alias("note")), ["id"], F.col("status") == "pending")
    return state.delete(c, c.where("id % 10 = 0").select("id"), ["id"]).select("id", "status", "note")


@query(
    """WITH e AS (SELECT 'p' || user_id % 5 AS profile, event_id AS tokens, CASE WHEN event_id % 50 <> 0 THEN round(value, 2) END AS cost, event_id % 2 AS new FROM events), r AS (SELECT CASE WHEN profile = 'p0' THEN 'p1' ELSE profile END AS profile, tokens, cost FROM e)
SELECT profile, count(*) AS calls, sum(tokens) AS tokens, round(sum(coalesce(cost, 0)), 2) AS cost, max(CAST(cost IS NULL AS INT)) AS cost_partial FROM r WHERE profile <> 'p4' GROUP BY profile"""
)
def agg18_usage(spark, d):
    """AGG18, MUT36, LKP44: counters added to, one renamed into another, one deleted."""
    e = table(spark, d, "events", "event_id", "user_id", "value").select(F.concat(F.lit("p"), (F.col("user_id") % 5).cast("string")).alias("profile"), F.col("event_id").alias("tokens"), F.when(F.col("event_id") % 50 != 0, F.round("value", 2)).alias("cost"), (F.col("event_id") % 2).alias("new"))
    none = spark.createDataFrame([], "profile string, calls long, tokens long, cost double, cost_partial int")
    totals = A.add_usage(A.add_usage(none, e.where("new = 0").drop("new")), e.where("new = 1").drop("new"))
    out = A.rename_usage(totals, "p0", "p1")
    return state.delete(out, out.where("profile = 'p4'").select("profile"), ["profile"]).withColumn("cost", F.round("cost", 2))
