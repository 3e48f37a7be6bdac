"""Queries of the archive operators over a data folder, each with the SQL that gives the same rows."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from pagewright.functions import text as T
from pagewright.operators import chunk as C
from pagewright.operators import display, geo, graph, pages, quality, retrieval, state
from pagewright.session import materialize
from pagewright.sources.tables import table

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLE: dict[str, str] = {}


def query(sql: str | None = None):
    def add(fn):
        QUERIES[fn.__name__] = fn
        if sql:
            ORACLE[fn.__name__] = sql
        return fn

    return add


# ---- shared inputs ---------------------------------------------------------------

_PAGES = "pages AS (SELECT * FROM pdf_page_readings QUALIFY row_number() OVER (PARTITION BY pdf_stem, page_num ORDER BY id DESC) = 1)"
_SCORED = "scored AS (SELECT pdf_stem, page_num, max(score) AS score, max(image_page) AS image_page, max(chars) AS chars FROM quality_pages GROUP BY ALL)"
_FILES = "files AS (SELECT *, lower(trim(source)) AS src FROM pdf_files)"


def current_pages(spark: SparkSession, d: str, *columns: str) -> DataFrame:
    """The last recorded reading of every page."""
    need = list(dict.fromkeys(["pdf_stem", "page_num", "id", *columns]))
    return state.latest(table(spark, d, "pdf_page_readings", *need), ["pdf_stem", "page_num"], [F.col("id")])


def page_scores(spark: SparkSession, d: str) -> DataFrame:
    """One stored score per page: the largest of its rows."""
    return table(spark, d, "quality_pages").groupBy("pdf_stem", "page_num").agg(F.max("score").alias("score"), F.max("image_page").alias("image_page"), F.max("chars").alias("chars"))


def files(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "pdf_files").withColumn("src", F.lower(F.trim("source")))


def _counts_sql(t: str) -> str:
    tok, wrd = rf"regexp_extract_all({t}, '\S+')", rf"regexp_extract_all({t}, '[A-Za-zÅÄÖåäö\-]+')"
    return rf"""length({t}) AS chars, len(regexp_extract_all({t}, '[^\p{{L}}\p{{N}}\s.,;:!?"''()\-–—…/\\\[\]{{}}<>]')) AS junk, len({tok}) AS tokens, len({wrd}) AS words,
  len(list_filter({wrd}, lambda w: length(w) <= 2)) AS short, len(list_filter({wrd}, lambda w: length(w) >= 18)) AS long,
  len(list_filter({tok}, lambda w: regexp_matches(w, '\d') AND regexp_matches(w, '[A-Za-zÅÄÖåäö]'))) AS mixed,
  len(regexp_extract_all({t}, '\p{{L}}')) AS letters, len(regexp_extract_all({t}, '[aeiouyåäöAEIOUYÅÄÖ]')) AS vowels"""


_SCORE_SQL = """CASE WHEN tokens > 0 THEN round(greatest(0.0, least(100.0, 100 - round(junk / greatest(chars, 1), 3) * 200 - round(short / greatest(words, 1), 3) * 80
  - round(long / greatest(words, 1), 3) * 100 - round(mixed / greatest(tokens, 1), 3) * 150 - abs(round(vowels / greatest(letters, 1), 3) - 0.4) * 100)), 1) ELSE 0.0 END"""
_COUNTED_TEXT = _counts_sql("t")
_DOC_SCORES = f"counted AS (SELECT doc_id, lang, source, {_counts_sql('coalesce(text, chr(32)[1:0])')} FROM documents), docs AS (SELECT *, {_SCORE_SQL} AS quality FROM counted)"


def doc_scores(spark: SparkSession, d: str) -> DataFrame:
    return quality.scored(table(spark, d, "documents", "doc_id", "lang", "source", "text")).drop("text")


# ---- scans and sources -----------------------------------------------------------


@query(r"SELECT doc_id, unnest(generate_series(1, len(string_split(text, chr(10))))) AS page_num, unnest(string_split(text, chr(10))) AS page FROM documents WHERE text IS NOT NULL")
def src01_pages(spark, d):
    """Documents into pages; here line feeds part them, as the tables hold no form feeds."""
    docs = table(spark, d, "documents", "doc_id", "text").where("text is not null").withColumn("text", F.translate("text", "\f\n", " \f"))
    return pages.exploded(docs, "doc_id", "text")


@query(
    r"""WITH s AS (SELECT doc_id, coalesce(dossier, '') || ' — ' || coalesce(source, '') || ' — ' || coalesce(lang, '') AS stem FROM documents),
p AS (SELECT doc_id, stem, list_transform(string_split(stem, ' — '), lambda x: trim(x)) AS p FROM s)
SELECT doc_id, CASE WHEN p[1] <> '' THEN p[1] ELSE substring(stem, 1, 40) END AS nr, coalesce(p[2], '') AS titel, coalesce(p[3], '') AS datum, coalesce(p[4], '') AS avsandare FROM p"""
)
def src02_filename_fields(spark, d):
    """Fields of a document's name."""
    e = F.lit("")
    stem = F.concat(F.coalesce("dossier", e), F.lit(" — "), F.coalesce("source", e), F.lit(" — "), F.coalesce("lang", e))
    return table(spark, d, "documents", "doc_id", "dossier", "source", "lang").select("doc_id", T.filename_fields(stem).alias("f")).select("doc_id", "f.nr", "f.titel", "f.datum", "f.avsandare")


@query("SELECT DISTINCT source FROM documents")
def src04_sources(spark, d):
    return table(spark, d, "documents", "source").distinct()


@query(
    r"""SELECT pdf_stem, nullif(regexp_extract(pdf_path, '([^/]+)\.pdf$', 1), '') AS file_name, coalesce(nullif(regexp_extract('https://drive.example/d/' || pdf_stem || '/view', '/d/([A-Za-z0-9_-]+)', 1), ''), '') AS drive_id,
trim(regexp_replace(regexp_replace(regexp_replace(pdf_stem || ' : ' || coalesce(source, ''), '\s+', ' ', 'g'), '^ | $', '', 'g'), '[\\/:*?"<>|\r\n\t]+', '-', 'g'), '. ') AS built FROM pdf_files"""
)
def src09_names_and_ids(spark, d):
    """Link ids and file names."""
    f = table(spark, d, "pdf_files", "pdf_stem", "pdf_path", "source")
    url = F.concat(F.lit("https://drive.example/d/"), F.col("pdf_stem"), F.lit("/view"))
    return f.select(
        "pdf_stem", F.nullif(F.regexp_extract("pdf_path", r"([^/]+)\.pdf$", 1), F.lit("")).alias("file_name"), F.coalesce(T.drive_id(url), F.lit("")).alias("drive_id"), T.build_filename([F.concat(F.col("pdf_stem"), F.lit(" : "), F.coalesce("source", F.lit("")))]).alias("built")
    )


@query("SELECT doc_id, row_number() OVER (PARTITION BY sha1(text) ORDER BY doc_id) > 1 AS duplicate, min(doc_id) OVER (PARTITION BY sha1(text)) AS first_id FROM documents WHERE text IS NOT NULL")
def src14_content_duplicates(spark, d):
    """Copies by content hash: the first keeps, the others point to it."""
    t = table(spark, d, "documents", "doc_id", "text").where("text is not null").select("doc_id", F.sha1("text").alias("h"))
    return t.join(t.groupBy("h").agg(F.min("doc_id").alias("first_id")), "h").select("doc_id", (F.col("doc_id") > F.col("first_id")).alias("duplicate"), "first_id")


@query(
    """WITH n AS (SELECT pdf_stem, CASE WHEN surya_failed_at IS NOT NULL THEN 'failed:404' WHEN tesseract_failed = 1 THEN 'failed:403' WHEN tesseract_done_at IS NULL THEN 'dup-of:' || pdf_stem ELSE '' END AS note FROM pdf_files)
SELECT pdf_stem, note NOT IN ('failed:html-response', 'failed:403') AS known, note LIKE 'failed:%' AND note NOT IN ('failed:html-response', 'failed:403') AS permanent, note LIKE 'dup-of:%' AS duplicate FROM n"""
)
def src13_download_state(spark, d):
    """What a download log knows: retryable failures don't count as known."""
    note = F.when(F.col("surya_failed_at").isNotNull(), "failed:404").when(F.col("tesseract_failed") == 1, "failed:403").when(F.col("tesseract_done_at").isNull(), F.concat(F.lit("dup-of:"), F.col("pdf_stem"))).otherwise("")
    retry = F.col("note").isin("failed:html-response", "failed:403")
    return table(spark, d, "pdf_files").select("pdf_stem", note.alias("note")).select("pdf_stem", (~retry).alias("known"), (F.col("note").startswith("failed:") & ~retry).alias("permanent"), F.col("note").startswith("dup-of:").alias("duplicate"))


# ---- filters ---------------------------------------------------------------------


@query(f"WITH {_PAGES} SELECT id FROM pages WHERE length(text) >= 80 AND len(regexp_extract_all(text, '[\\p{{L}}\\p{{N}}]')) >= 0.55 * length(text)")
def flt01_useful(spark, d):
    return current_pages(spark, d, "text").where(C.is_useful(F.col("text"))).select("id")


@query(
    r"""WITH c AS (SELECT id, text, regexp_extract_all(text, '\S+') AS t FROM pdf_page_readings)
SELECT id, coalesce(len(t) > 0 AND len(regexp_extract_all(text, '[\p{L}\p{N}]')) >= 0.55 * length(text) AND len(list_filter(t, lambda w: length(w) <= 2)) <= 0.30 * len(t)
AND len(list_filter(t, lambda w: regexp_matches(w, '\d') AND regexp_matches(w, '\p{L}'))) <= 0.10 * len(t), false) AS usable FROM c"""
)
def flt02_layer_usable(spark, d):
    return table(spark, d, "pdf_page_readings", "id", "text").select("id", T.layer_usable(F.col("text")).alias("usable"))


@query(f"WITH {_PAGES} SELECT pdf_stem, page_num FROM pages p WHERE len(regexp_extract_all(text, '[\\p{{L}}\\p{{N}}]')) >= 100 AND NOT EXISTS (SELECT 1 FROM doc_entities e WHERE e.pdf_stem = p.pdf_stem AND e.page_num = p.page_num)")
def flt04_pages_to_extract(spark, d):
    """Pages with enough text and no entities yet."""
    p = current_pages(spark, d, "text").where(T.alnum_count(F.col("text")) >= 100)
    return p.join(table(spark, d, "doc_entities", "pdf_stem", "page_num"), ["pdf_stem", "page_num"], "left_anti").select("pdf_stem", "page_num")


@query(f"WITH {_SCORED} SELECT pdf_stem, page_num, score FROM scored WHERE score < 60 AND coalesce(image_page, 0) = 0")
def flt06_bad_pages(spark, d):
    return page_scores(spark, d).where("score < 60 and coalesce(image_page, 0) = 0").select("pdf_stem", "page_num", "score")


@query(f"WITH {_SCORED} SELECT pdf_stem, min(score) AS score FROM scored GROUP BY 1 HAVING min(score) < 40")
def flt08_low_quality_stems(spark, d):
    return page_scores(spark, d).groupBy("pdf_stem").agg(F.min("score").alias("score")).where("score < 40")


@query(f"WITH {_PAGES} SELECT pdf_stem, page_num FROM pages WHERE contains(text, 'utsträckning') OR contains(text, 'uppslag')")
def flt09_pages_with_text(spark, d):
    return current_pages(spark, d, "text").where(F.col("text").contains("utsträckning") | F.col("text").contains("uppslag")).select("pdf_stem", "page_num")


@query(f"WITH {_PAGES} SELECT pdf_stem, page_num, coalesce(length(text), 0) AS n_text, length(markdown) AS n_markdown FROM pages WHERE markdown IS NOT NULL")
def flt12_markdown_pages(spark, d):
    p = current_pages(spark, d, "text", "markdown").where("markdown is not null")
    return p.select("pdf_stem", "page_num", F.coalesce(F.length("text"), F.lit(0)).alias("n_text"), F.length("markdown").alias("n_markdown"))


@query("SELECT pdf_stem FROM pdf_files WHERE redaction_checked_at IS NULL AND pdf_stem IN (SELECT pdf_stem FROM pdf_page_readings WHERE text IS NOT NULL)")
def flt13_pending_redaction(spark, d):
    have = table(spark, d, "pdf_page_readings", "pdf_stem", "text").where("text is not null").select("pdf_stem").distinct()
    return table(spark, d, "pdf_files", "pdf_stem", "redaction_checked_at").where("redaction_checked_at is null").join(have, "pdf_stem", "left_semi").select("pdf_stem")


@query(
    """SELECT pdf_stem, coalesce(tesseract_done_at IS NOT NULL OR tesseract_failed = 1 OR tesseract_blacklisted_at IS NOT NULL, false) AS skip,
coalesce((tesseract_failed = 1 OR tesseract_blacklisted_at IS NOT NULL) AND surya_failed_at IS NULL, false) AS fallback, tesseract_blacklisted_at IS NOT NULL AND surya_failed_at IS NOT NULL AS lost FROM pdf_files"""
)
def flt14_ocr_state(spark, d):
    """Skip, fallback and given-up flags of the text recognition."""
    f = table(spark, d, "pdf_files")
    black, failed, surya = F.col("tesseract_blacklisted_at").isNotNull(), F.col("tesseract_failed") == 1, F.col("surya_failed_at").isNotNull()
    return f.select("pdf_stem", F.coalesce(F.col("tesseract_done_at").isNotNull() | failed | black, F.lit(False)).alias("skip"), F.coalesce((failed | black) & ~surya, F.lit(False)).alias("fallback"), (black & surya).alias("lost"))


@query("SELECT DISTINCT pdf_stem, page_num FROM pdf_page_readings WHERE replace(lower(trim(engine)), '_', '-') = 'llm-vision'")
def flt17_read_with(spark, d):
    """Pages an engine has read, now or before."""
    r = table(spark, d, "pdf_page_readings", "pdf_stem", "page_num", "engine")
    return r.where(F.replace(F.lower(F.trim("engine")), F.lit("_"), F.lit("-")) == "llm-vision").select("pdf_stem", "page_num").distinct()


@query("SELECT pdf_stem FROM pdf_files WHERE contains(lower(pdf_stem), 'ead') ")
def flt18_find_documents(spark, d):
    return table(spark, d, "pdf_files", "pdf_stem").where(F.lower("pdf_stem").contains("ead"))


@query("SELECT event_id, user_id % 180 - 90 AS lat FROM events WHERE abs((user_id % 180 - 90) - 10) <= 3 AND abs(value - 50) <= 25")
def flt20_near_coordinate(spark, d):
    e = table(spark, d, "events", "event_id", "user_id", "value").withColumn("lat", F.col("user_id") % 180 - 90)
    return e.where((F.abs(F.col("lat") - 10) <= 3) & (F.abs(F.col("value") - 50) <= 25)).select("event_id", "lat")


@query(
    r"""WITH u AS (SELECT doc_id, 'https://' || CASE WHEN doc_id % 3 = 0 THEN 'www.' ELSE '' END || lower(source) || '.example/x' AS url FROM documents WHERE source IS NOT NULL),
h AS (SELECT doc_id, regexp_extract(url, '^[a-z]+://([^/:?#]+)', 1) AS host FROM u) SELECT doc_id, host = 'forum-kaj.example' OR host LIKE '%.forum-kaj.example' AS excluded FROM h"""
)
def flt24_excluded_domain(spark, d):
    t = table(spark, d, "documents", "doc_id", "source").where("source is not null")
    url = F.concat(F.lit("https://"), F.when(F.col("doc_id") % 3 == 0, "www.").otherwise(""), F.lower("source"), F.lit(".example/x"))
    return t.select("doc_id", T.excluded_host(url, ["forum-kaj.example"]).alias("excluded"))


@query(
    """WITH l AS (SELECT event_id, user_id, CASE event_type WHEN 'error' THEN 'ERROR' WHEN 'purchase' THEN 'INFO' END AS own FROM events)
SELECT event_id, last_value(own IGNORE NULLS) OVER (PARTITION BY user_id ORDER BY event_id ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW) AS level FROM l"""
)
def flt25_log_levels(spark, d):
    """Log lines inherit the level of the last line that had one."""
    e = table(spark, d, "events", "event_id", "user_id", "event_type")
    line = F.concat_ws(" ", F.when(F.col("event_type") == "error", "ERROR").when(F.col("event_type") == "purchase", "INFO"), F.lit("text"))
    return state.inherited_level(e.withColumn("line", line), "user_id", "event_id", "line").select("event_id", "level")


# ---- joins -----------------------------------------------------------------------


@query(
    f"""WITH {_PAGES}, {_SCORED}, {_FILES} SELECT s.pdf_stem, s.page_num, s.score, coalesce(replace(lower(trim(p.engine)), '_', '-'), CASE WHEN f.tesseract_done_at IS NOT NULL THEN 'tesseract' ELSE 'textlager' END) AS engine
FROM scored s LEFT JOIN pages p USING (pdf_stem, page_num) LEFT JOIN files f USING (pdf_stem)"""
)
def jn01_scores_by_engine(spark, d):
    """Stored scores with the engine of the page, and a guess where there is none."""
    p = current_pages(spark, d, "engine").select("pdf_stem", "page_num", F.replace(F.lower(F.trim("engine")), F.lit("_"), F.lit("-")).alias("e"))
    f = table(spark, d, "pdf_files", "pdf_stem", "tesseract_done_at")
    j = page_scores(spark, d).join(p, ["pdf_stem", "page_num"], "left").join(f, "pdf_stem", "left")
    return j.select("pdf_stem", "page_num", "score", F.coalesce("e", F.when(F.col("tesseract_done_at").isNotNull(), "tesseract").otherwise("textlager")).alias("engine"))


@query(
    """WITH q AS (SELECT pdf_stem, count(*) * 1e7 + 1.6e9 AS done FROM quality_pages GROUP BY 1) SELECT pdf_stem, text_mtime FROM pdf_files f LEFT JOIN q USING (pdf_stem) WHERE done IS NULL OR text_mtime > done"""
)
def jn02_files_needing_quality(spark, d):
    done = table(spark, d, "quality_pages", "pdf_stem").groupBy("pdf_stem").agg((F.count(F.lit(1)) * 1e7 + 1.6e9).alias("done"))
    return state.needing(table(spark, d, "pdf_files", "pdf_stem", "text_mtime"), done, "pdf_stem", "text_mtime", "done")


@query(f"WITH {_SCORED}, {_FILES} SELECT s.pdf_stem, s.page_num, s.score FROM scored s JOIN files f USING (pdf_stem) WHERE f.src = 'wpu' AND s.score < 70 AND coalesce(s.image_page, 0) = 0")
def jn05_rescan_candidates(spark, d):
    f = files(spark, d).where("src = 'wpu'").select("pdf_stem")
    return page_scores(spark, d).where("score < 70 and coalesce(image_page, 0) = 0").join(f, "pdf_stem").select("pdf_stem", "page_num", "score")


_KEYS_SQL = r"""keys AS (SELECT pdf_stem, regexp_extract(m, '^([A-Z]+)', 1) AS prefix, CAST(regexp_extract(m, '^[A-Z]+(\d+)', 1) AS INTEGER) AS base, CAST(regexp_extract(m, '-(\d+)', 1) AS INTEGER) AS version,
  unnest(CASE WHEN regexp_extract(m, '-([A-Z]+)$', 1) = '' THEN [''] ELSE string_split(regexp_extract(m, '-([A-Z]+)$', 1), '') END) AS suffix
  FROM (SELECT pdf_stem, unnest(regexp_extract_all(pdf_stem, '\b([A-Z]{1,4}\d{3,7}-\d{1,3}(?:-[A-Z]{1,4})?)\b', 1)) AS m FROM (SELECT replace(pdf_stem, '_', ' ') AS k, pdf_stem FROM pdf_files)))"""


@query(
    r"""SELECT pdf_stem, regexp_extract(m, '^([A-Z]+)', 1) AS prefix, CAST(regexp_extract(m, '^[A-Z]+(\d+)', 1) AS INTEGER) AS base, CAST(regexp_extract(m, '-(\d+)', 1) AS INTEGER) AS version,
  unnest(CASE WHEN regexp_extract(m, '-([A-Z]+)$', 1) = '' THEN [''] ELSE string_split(regexp_extract(m, '-([A-Z]+)$', 1), '') END) AS suffix
  FROM (SELECT pdf_stem, unnest(regexp_extract_all(pdf_stem, '[A-Z]{1,4}\d{3,7}-\d{1,3}(?:-[A-Z]{1,4})?')) AS m FROM pdf_files)"""
)
def jn06_id_keys(spark, d):
    """Archive numbers in document names, one row for each letter of a suffix."""
    return table(spark, d, "pdf_files", "pdf_stem").select("pdf_stem", F.explode(T.archive_keys(F.col("pdf_stem"))).alias("k")).select("pdf_stem", "k.prefix", "k.base", "k.version", "k.suffix")


@query(
    f"""WITH {_SCORED}, {_FILES}, b AS (SELECT pdf_stem, regexp_extract(pdf_stem, '^([A-Z]+\\d+)', 1) AS k, src FROM files), m AS (SELECT pdf_stem, round(avg(score), 2) AS s FROM scored GROUP BY 1)
SELECT a.pdf_stem AS a, c.pdf_stem AS b, CASE WHEN x.s - y.s > 5 THEN 'a' WHEN y.s - x.s > 5 THEN 'b' ELSE 'tie' END AS better
FROM b a JOIN b c ON a.k = c.k AND a.src = 'wpu' AND c.src = 'files' JOIN m x ON x.pdf_stem = a.pdf_stem JOIN m y ON y.pdf_stem = c.pdf_stem"""
)
def jn07_collection_pairs(spark, d):
    """Documents of two collections under one archive number, and which copy is better by more than the margin."""
    means = page_scores(spark, d).groupBy("pdf_stem").agg(F.round(F.avg("score"), 2).alias("s"))
    f = files(spark, d).select("pdf_stem", "src", F.regexp_extract("pdf_stem", r"^([A-Z]+\d+)", 1).alias("k")).join(means, "pdf_stem")
    a, b = f.where("src = 'wpu'").alias("x"), f.where("src = 'files'").alias("y")
    return a.join(b, F.col("x.k") == F.col("y.k")).select(F.col("x.pdf_stem").alias("a"), F.col("y.pdf_stem").alias("b"), quality.decide(F.col("x.s"), F.col("y.s")).alias("better"))


@query("SELECT DISTINCT pdf_stem FROM doc_entities WHERE pdf_stem NOT IN (SELECT pdf_stem FROM quality_pages)")
def jn09_orphans(spark, d):
    return table(spark, d, "doc_entities", "pdf_stem").distinct().join(table(spark, d, "quality_pages", "pdf_stem"), "pdf_stem", "left_anti")


@query(
    f"""WITH {_SCORED}, r AS (SELECT DISTINCT pdf_stem, page_num FROM pdf_page_readings WHERE replace(lower(trim(engine)), '_', '-') = 'llm-vision'), w AS (SELECT * FROM scored s WHERE score IS NOT NULL
AND coalesce(image_page, 0) = 0 AND NOT EXISTS (SELECT 1 FROM r WHERE r.pdf_stem = s.pdf_stem AND r.page_num = s.page_num) ORDER BY score, pdf_stem, page_num LIMIT 50) SELECT pdf_stem, string_agg(page_num, ',' ORDER BY page_num) AS page_list FROM w GROUP BY 1"""
)
def jn10_rescan_plan(spark, d):
    """The worst 50 pages an engine hasn't read, by document (the cap is the feature)."""
    s = page_scores(spark, d).where("score is not null and coalesce(image_page, 0) = 0").join(flt17_read_with(spark, d), ["pdf_stem", "page_num"], "left_anti")
    return pages.capped_candidates(s, "score", ["pdf_stem", "page_num"], 50, "pdf_stem").select("pdf_stem", F.array_join(F.transform("pages", lambda p: p.cast("string")), ",").alias("page_list"))


_PLACES_SQL = "places AS (SELECT n_name AS place FROM nation UNION SELECT r_name FROM region)"


@query(
    f"""WITH {_PLACES_SQL}, raw AS (SELECT DISTINCT lower(c_mktsegment) AS t FROM customer UNION SELECT lower(n_name) || 's' FROM nation), j AS (SELECT t, place, CASE WHEN t = lower(place) THEN 1.0
WHEN contains(t, lower(place)) OR contains(lower(place), t) THEN 0.86 ELSE round(1 - levenshtein(t, lower(place)) / greatest(length(t), length(place), 1), 6) END AS score FROM raw, places)
SELECT t, arg_min(place, (-score, place)) AS place, max(score) AS score FROM j WHERE score >= 0.72 GROUP BY t"""
)
def jn12_match_places(spark, d):
    """Raw place names against a catalogue: equal, containing or similar."""
    places = table(spark, d, "nation", "n_name").select(F.col("n_name").alias("place")).union(table(spark, d, "region", "r_name")).distinct()
    raw = table(spark, d, "customer", "c_mktsegment").select(F.lower("c_mktsegment").alias("t")).union(table(spark, d, "nation", "n_name").select(F.concat(F.lower("n_name"), F.lit("s")))).distinct()
    return geo.match_places(raw, "t", places, "place", exact_ratio=False).select("t", "place", "score")


@query(
    """WITH q AS (SELECT DISTINCT regexp_extract(pdf_stem, '^([A-Z]+\\d+-\\d+)', 1) AS nr FROM doc_entities) SELECT nr, pdf_stem FROM q JOIN pdf_files ON pdf_stem = nr OR (starts_with(pdf_stem, nr) AND regexp_matches(substring(pdf_stem, length(nr) + 1, 1), '[^A-Za-z0-9]'))"""
)
def jn13_prefix_resolution(spark, d):
    """Numbers to documents: the exact name, or names that go on after a boundary. An equi join on the number's shape keeps it from comparing all with all."""
    q = table(spark, d, "doc_entities", "pdf_stem").select(F.regexp_extract("pdf_stem", r"^([A-Z]+\d+-\d+)", 1).alias("nr")).distinct()
    f = table(spark, d, "pdf_files", "pdf_stem").withColumn("k", F.regexp_extract("pdf_stem", r"^([A-Z]+\d+-\d+)", 1))
    j = q.join(f, F.col("nr") == F.col("k"))
    return j.where((F.col("pdf_stem") == F.col("nr")) | F.expr("substring(pdf_stem, length(nr) + 1, 1)").rlike("[^A-Za-z0-9]")).select("nr", "pdf_stem")


# ---- aggregations ----------------------------------------------------------------


@query(f"WITH {_DOC_SCORES} SELECT least(greatest(floor(quality / 10), 0), 9) AS bucket, count(*) AS n FROM docs GROUP BY 1")
def agg01_quality_histogram(spark, d):
    return quality.histogram(doc_scores(spark, d), "quality")


@query(
    f"""WITH {_PAGES}, {_SCORED} SELECT coalesce(replace(lower(trim(p.engine)), '_', '-'), '?') AS engine, count(*) AS n, round(median(s.score), 2) AS median, round(avg(s.score), 2) AS mean, count(*) FILTER (s.score < 10) AS below_10,
count(*) FILTER (s.score < 30) AS below_30, count(*) FILTER (s.score < 50) AS below_50, count(*) FILTER (s.score < 70) AS below_70, count(*) FILTER (s.score < 90) AS below_90
FROM scored s LEFT JOIN pages p USING (pdf_stem, page_num) WHERE s.score IS NOT NULL GROUP BY 1"""
)
def agg03_quality_by_engine(spark, d):
    """Number, median, mean and counts below thresholds by engine."""
    p = current_pages(spark, d, "engine").select("pdf_stem", "page_num", F.replace(F.lower(F.trim("engine")), F.lit("_"), F.lit("-")).alias("e"))
    return quality.grouped(page_scores(spark, d).join(p, ["pdf_stem", "page_num"], "left").withColumn("engine", F.coalesce("e", F.lit("?"))), "engine", "score")


@query(
    f"""WITH {_SCORED}, h AS (SELECT least(greatest(floor(score / 10), 0), 9) AS bucket, count(*) AS n FROM scored WHERE score IS NOT NULL GROUP BY 1)
SELECT bucket, n, sum(n) OVER (ORDER BY bucket) AS running, round(100 * sum(n) OVER (ORDER BY bucket) / sum(n) OVER (), 1) AS running_pct FROM h"""
)
def agg04_cumulative_histogram(spark, d):
    return quality.cumulative(page_scores(spark, d), "score")


@query("SELECT pdf_stem, count(DISTINCT page_num) AS n_pages, count(*) AS n_readings FROM pdf_page_readings GROUP BY 1")
def agg06_pages_per_document(spark, d):
    return table(spark, d, "pdf_page_readings", "pdf_stem", "page_num").groupBy("pdf_stem", "page_num").agg(F.count(F.lit(1)).alias("r")).groupBy("pdf_stem").agg(F.count(F.lit(1)).alias("n_pages"), F.sum("r").alias("n_readings"))


@query(
    f"""WITH {_PAGES}, m AS (SELECT pdf_stem, page_num, len(string_split(text, 'uppslag')) - 1 AS c FROM pages WHERE text IS NOT NULL) SELECT pdf_stem, sum(c) AS redactions, count(*) FILTER (c > 0) AS n_pages FROM m GROUP BY 1 HAVING sum(c) > 0"""
)
def agg10_documents_by_marker(spark, d):
    """Marker counts by document (the marker is a parameter; the tables hold none of the archive's own)."""
    m = current_pages(spark, d, "text").where("text is not null").select("pdf_stem", T.marker_count(F.col("text"), "uppslag").alias("c"))
    return m.groupBy("pdf_stem").agg(F.sum("c").alias("redactions"), F.count_if(F.col("c") > 0).alias("n_pages")).where("redactions > 0")


@query(
    r"""WITH w AS (SELECT unnest(regexp_extract_all(lower(text), '[a-zåäö]{4,}')) AS word FROM documents WHERE text IS NOT NULL) SELECT word, count(*) AS n FROM w GROUP BY 1 HAVING count(*) >= 10"""
)
def agg12_user_words(spark, d):
    """Frequent words of at least four letters."""
    t = table(spark, d, "documents", "text").where("text is not null")
    return t.select(F.explode(T.vocabulary_words(F.col("text"))).alias("word")).groupBy("word").agg(F.count(F.lit(1)).alias("n")).where("n >= 10")


@query("SELECT event_type AS profile, count(*) AS calls, sum(user_id) AS tokens, round(sum(coalesce(CASE WHEN value < 95 THEN value END, 0)), 4) AS cost, max((NOT coalesce(value < 95, false))::INT) AS cost_partial FROM events GROUP BY 1")
def agg17_usage_totals(spark, d):
    """Totals per profile; one missing cost makes the sum partial."""
    e = table(spark, d, "events").select(F.col("event_type").alias("profile"), F.col("user_id").alias("tokens"), F.when(F.col("value") < 95, F.col("value")).alias("cost"))
    return state.usage_totals(e, "profile", "cost", ["tokens"])


@query("SELECT user_id, CASE WHEN count(v) = count(*) THEN round(sum(v), 2) END AS total FROM (SELECT user_id, CASE WHEN event_type <> 'error' THEN value END AS v FROM events) GROUP BY 1")
def agg19_sum_or_null(spark, d):
    e = table(spark, d, "events").select("user_id", F.when(F.col("event_type") != "error", F.col("value")).alias("v"))
    return e.groupBy("user_id").agg(F.round(state.sum_or_null(F.col("v")), 2).alias("total"))


@query("SELECT replace(lower(trim(engine)), '_', '-') AS engine, count(*) AS n FROM pdf_page_readings WHERE reason = 'rescan' GROUP BY 1")
def agg20_engines(spark, d):
    return table(spark, d, "pdf_page_readings", "engine", "reason").where("reason = 'rescan'").groupBy(F.replace(F.lower(F.trim("engine")), F.lit("_"), F.lit("-")).alias("engine")).agg(F.count(F.lit(1)).alias("n"))


# ---- graph -----------------------------------------------------------------------

_ENT = r"""latest AS (SELECT pdf_stem, page_num, max((coalesce(extracted_at, ''), coalesce(payload, '')))[2] AS payload FROM doc_entities GROUP BY ALL),
ok AS (SELECT pdf_stem, page_num, payload::JSON AS j FROM latest WHERE json_valid(payload) AND json_type(payload, '$.entiteter') = 'ARRAY'),
raw AS (SELECT pdf_stem, page_num, i AS idx, lower(trim(j->>('$.entiteter[' || i || '].typ'))) AS typ, trim(j->>('$.entiteter[' || i || '].namn')) AS namn FROM ok, unnest(generate_series(0, json_array_length(j, '$.entiteter')::INT - 1)) AS u(i)),
ents AS (SELECT *, lower(trim(regexp_replace(CASE WHEN len(string_split(namn, ',')) = 2 AND trim(string_split(namn, ',')[1]) <> '' AND trim(string_split(namn, ',')[2]) <> '' AND NOT regexp_matches(namn, '\d')
  THEN trim(string_split(namn, ',')[2]) || ' ' || trim(string_split(namn, ',')[1]) ELSE namn END, '\s+', ' ', 'g'))) AS norm FROM raw WHERE namn <> '')"""
_RES = r"""named AS (SELECT pdf_stem, regexp_extract(norm, '([^ ]+)$', 1) AS surname, norm FROM ents WHERE typ = 'person' AND contains(norm, ' ')),
smap AS (SELECT pdf_stem, surname, min(norm) AS full_name FROM named GROUP BY 1, 2 HAVING min(norm) = max(norm)),
res AS (SELECT e.* EXCLUDE (norm), e.norm AS own, coalesce(s.full_name, e.norm) AS norm FROM ents e LEFT JOIN smap s ON s.pdf_stem = e.pdf_stem AND s.surname = e.norm AND e.typ = 'person')"""


def _entities(spark, d):
    return graph.entities(graph.parsed(table(spark, d, "doc_entities")))


@query(f"WITH {_ENT} SELECT pdf_stem, page_num, idx, typ, namn, norm FROM ents")
def gr01_entities(spark, d):
    """Entities of the latest readable payload of each page."""
    return _entities(spark, d)


@query(f"WITH {_ENT}, {_RES} SELECT pdf_stem, surname, full_name AS \"full\" FROM smap")
def agg22_surname_map(spark, d):
    return graph.surname_map(_entities(spark, d))


@query(f"WITH {_ENT}, {_RES} SELECT DISTINCT pdf_stem, page_num, typ AS label, norm FROM res WHERE typ IN ('person', 'plats', 'organisation')")
def gr06_mentions(spark, d):
    return graph.mentions(_entities(spark, d))


_REL = r"""rels AS (SELECT pdf_stem, page_num, trim(j->>('$.relationer[' || i || '].fran')) AS fran, trim(j->>('$.relationer[' || i || '].typ')) AS rel, trim(j->>('$.relationer[' || i || '].till')) AS till
  FROM ok, unnest(generate_series(0, coalesce(json_array_length(j, '$.relationer'), 0)::INT - 1)) AS u(i))"""
_NORM = r"""lower(trim(regexp_replace(CASE WHEN len(string_split({0}, ',')) = 2 AND trim(string_split({0}, ',')[1]) <> '' AND trim(string_split({0}, ',')[2]) <> '' AND NOT regexp_matches({0}, '\d')
  THEN trim(string_split({0}, ',')[2]) || ' ' || trim(string_split({0}, ',')[1]) ELSE {0} END, '\s+', ' ', 'g')))"""
_EDGES = f"""edges AS (SELECT DISTINCT r.pdf_stem, r.page_num, r.rel, a.typ AS src_label, a.norm AS src, b.typ AS dst_label, b.norm AS dst FROM rels r
  JOIN res a ON a.pdf_stem = r.pdf_stem AND a.page_num = r.page_num AND a.own = {_NORM.format('r.fran')} AND a.typ IN ('person', 'plats', 'organisation')
  JOIN res b ON b.pdf_stem = r.pdf_stem AND b.page_num = r.page_num AND b.own = {_NORM.format('r.till')} AND b.typ IN ('person', 'plats', 'organisation') WHERE r.rel <> '')"""


def _edges(spark, d):
    p = graph.parsed(table(spark, d, "doc_entities"))
    return graph.relation_edges(graph.entities(p), graph.relations(p))


@query(f"WITH {_ENT}, {_RES}, {_REL}, {_EDGES} SELECT * FROM edges")
def gr06_relations(spark, d):
    """Relations whose ends are both entities of the page."""
    return _edges(spark, d)


_OCC = f"""occ AS (SELECT pdf_stem, page_num, 'entity' AS kind, i AS idx, coalesce(j->>('$.entiteter[' || i || '].typ'), '') AS typ, coalesce(j->>('$.entiteter[' || i || '].namn'), '') AS namn, '' AS fran, '' AS till FROM ok, unnest(generate_series(0, json_array_length(j, '$.entiteter')::INT - 1)) AS u(i)
UNION ALL SELECT pdf_stem, page_num, 'relation', i, coalesce(j->>('$.relationer[' || i || '].typ'), ''), '', coalesce(j->>('$.relationer[' || i || '].fran'), ''), coalesce(j->>('$.relationer[' || i || '].till'), '') FROM ok, unnest(generate_series(0, coalesce(json_array_length(j, '$.relationer'), 0)::INT - 1)) AS u(i)),
lab AS (SELECT pdf_stem, page_num, {_NORM.format('namn')} AS norm, count(DISTINCT typ) AS kinds FROM occ WHERE kind = 'entity' GROUP BY ALL), nn AS (SELECT *, {_NORM.format('fran')} AS nf, {_NORM.format('till')} AS nt, row_number() OVER (PARTITION BY pdf_stem, page_num, kind, typ, namn, fran, till ORDER BY idx) > 1 AS again FROM occ)"""


@query(
    f"""WITH {_ENT}, {_OCC} SELECT n.pdf_stem, n.page_num, kind, idx, concat_ws(';', CASE WHEN again THEN 'Dubblett på sidan' END, CASE WHEN kind = 'entity' AND trim(namn) = '' THEN 'Tomt namn' END, CASE WHEN kind = 'entity' AND typ NOT IN ('person', 'plats', 'organisation') THEN 'Okänd entitetstyp' END,
CASE WHEN kind = 'entity' AND typ = 'person' AND (length(trim(namn)) <= 4 OR NOT regexp_matches(trim(namn), '\\S\\s+\\S')) THEN 'Kort eller ensamt personnamn; kontrollera initialer' END, CASE WHEN kind = 'entity' AND regexp_matches(trim(namn), '(?i)MASK|\\x{{fffd}}|[\\[\\]{{}}|_]|\\d') THEN 'Möjlig maskering eller OCR-skräp' END,
CASE WHEN kind = 'relation' THEN CASE WHEN nf = '' OR f.kinds IS NULL THEN 'Saknad ändpunkt: fran' WHEN f.kinds > 1 THEN 'Tvetydig ändpunkt: fran' END END, CASE WHEN kind = 'relation' THEN CASE WHEN nt = '' OR t.kinds IS NULL THEN 'Saknad ändpunkt: till' WHEN t.kinds > 1 THEN 'Tvetydig ändpunkt: till' END END,
CASE WHEN kind = 'relation' AND trim(typ) = '' THEN 'Tom relationstyp' END, CASE WHEN kind = 'relation' AND nf = nt THEN 'Självkant' END) AS issues
FROM nn n LEFT JOIN lab f ON f.pdf_stem = n.pdf_stem AND f.page_num = n.page_num AND f.norm = nf LEFT JOIN lab t ON t.pdf_stem = n.pdf_stem AND t.page_num = n.page_num AND t.norm = nt"""
)
def gr08_audit(spark, d):
    """What a reviewer would ask about entities and relations."""
    rows = graph.occurrences(graph.parsed(table(spark, d, "doc_entities")))
    return graph.audited(rows).select("pdf_stem", "page_num", "kind", "idx", F.array_join("issues", ";").alias("issues"))


@query(
    f"""WITH {_ENT}, k AS (SELECT typ, lower(namn) AS key, namn, count(*) AS c FROM ents WHERE typ IN ('person', 'plats', 'organisation') GROUP BY ALL)
SELECT typ, key, (SELECT count(DISTINCT pdf_stem) FROM ents e WHERE e.typ = k.typ AND lower(e.namn) = k.key) AS documents, arg_min(namn, (-c, namn)) AS spelling FROM k GROUP BY ALL"""
)
def agg07_entity_facets(spark, d):
    return graph.facets(_entities(spark, d))


@query(f"WITH {_ENT} SELECT DISTINCT pdf_stem FROM ents WHERE lower(namn) = (SELECT min(lower(namn)) FROM ents WHERE typ = 'person')")
def agg09_stems_with_entity(spark, d):
    """Documents that mention a name, whatever its case."""
    e = _entities(spark, d).select("pdf_stem", "typ", F.lower("namn").alias("key"))
    wanted = e.where("typ = 'person'").agg(F.min("key").alias("key"))
    return e.join(F.broadcast(wanted), "key").select("pdf_stem").distinct()


@query(
    f"""WITH {_ENT}, {_RES}, {_REL}, {_EDGES}, c AS (SELECT DISTINCT src AS n FROM edges), b AS (SELECT n AS centre, rel, dst AS other, 'out' AS way FROM edges JOIN c ON src = n UNION ALL SELECT n, rel, src, 'in' FROM edges JOIN c ON dst = n)
SELECT centre, rel, other, way, count(*) AS n FROM b GROUP BY ALL"""
)
def jn16_ego(spark, d):
    """The neighbours of every node that a relation goes out from, in both directions."""
    edges = materialize(_edges(spark, d), "edges")
    return graph.ego(edges, edges.select(F.col("src").alias("norm")))


@query(f"WITH {_ENT} SELECT DISTINCT typ, norm, min(namn) OVER (PARTITION BY typ, norm) AS namn FROM ents WHERE contains(norm, 'berg')")
def jn17_search_entities(spark, d):
    return _entities(spark, d).where(F.col("norm").contains("berg")).groupBy("typ", "norm").agg(F.min("namn").alias("namn"))


@query(
    f"""WITH {_ENT}, {_RES}, w AS (SELECT DISTINCT pdf_stem, page_num, typ AS label, norm FROM res WHERE typ IN ('person', 'plats', 'organisation')), l AS (SELECT DISTINCT pdf_stem, page_num, typ AS label, own AS norm FROM res WHERE typ IN ('person', 'organisation'))
SELECT *, 'missing' AS side FROM (SELECT * FROM w EXCEPT SELECT * FROM l) UNION ALL SELECT *, 'surplus' FROM (SELECT * FROM l EXCEPT SELECT * FROM w)"""
)
def set01_graph_diff(spark, d):
    """Wanted against live mentions (live: unresolved, without places)."""
    e = _entities(spark, d)
    live = e.where("typ in ('person', 'organisation')").select("pdf_stem", "page_num", F.col("typ").alias("label"), "norm").distinct()
    return graph.difference(graph.mentions(e), live)


@query(
    f"""WITH {_ENT} SELECT count(DISTINCT (pdf_stem, page_num)) AS n_pages, count(*) AS items, count(DISTINCT (typ, norm)) AS nodes, count(DISTINCT (pdf_stem, page_num, typ, norm)) AS mentions FROM ents"""
)
def agg15_projection_report(spark, d):
    """Sizes of a projection in one row."""
    e = _entities(spark, d)
    return e.agg(F.count_distinct("pdf_stem", "page_num").alias("n_pages"), F.count(F.lit(1)).alias("items"), F.count_distinct("typ", "norm").alias("nodes"), F.count_distinct("pdf_stem", "page_num", "typ", "norm").alias("mentions"))


@query(
    """SELECT item_key, action, json_extract_string(target_json, '$.namn') AS namn, CASE WHEN trim(coalesce(note, '')) = '' THEN 'note' WHEN action NOT IN ('keep', 'exclude', 'replace', 'reset') THEN 'action'
WHEN action = 'replace' AND coalesce(json_extract_string(target_json, '$.namn'), json_extract_string(target_json, '$.fran')) IS NULL THEN 'target' END AS problem FROM graph_review_decisions"""
)
def flt22_decision_rules(spark, d):
    """Decisions read and checked."""
    g = table(spark, d, "graph_review_decisions").withColumn("t", F.from_json("target_json", "struct<namn:string,fran:string>"))
    problem = F.when(F.trim(F.coalesce("note", F.lit(""))) == "", "note").when(~F.col("action").isin("keep", "exclude", "replace", "reset"), "action").when((F.col("action") == "replace") & F.coalesce("t.namn", "t.fran").isNull(), "target")
    return g.select("item_key", "action", "t.namn", problem.alias("problem"))


@query("SELECT item_key FROM graph_review_decisions WHERE source_hash NOT IN (SELECT sha256(coalesce(payload, '')) FROM doc_entities)")
def set08_stale_decisions(spark, d):
    """Decisions whose page payload is no longer there."""
    return table(spark, d, "graph_review_decisions", "item_key", "source_hash").join(table(spark, d, "doc_entities", "payload").select(F.sha2(F.coalesce("payload", F.lit("")), 256).alias("source_hash")), "source_hash", "left_anti").select("item_key")


@query(
    """WITH h AS (SELECT sha256(coalesce(source_hash, '') || chr(31) || coalesce(action, '') || chr(31) || coalesce(target_json, '')) AS h FROM graph_review_decisions)
SELECT sha256(count(*) || '|' || concat_ws('|', sum(('0x' || h[1:15])::HUGEINT), sum(('0x' || h[16:30])::HUGEINT), sum(('0x' || h[31:45])::HUGEINT), sum(('0x' || h[46:60])::HUGEINT))) AS fingerprint FROM h"""
)
def set06_fingerprint(spark, d):
    """A digest of all decisions, whatever their order; nothing is gathered."""
    return graph.fingerprint(table(spark, d, "graph_review_decisions"), "source_hash", "action", "target_json")


# ---- text ------------------------------------------------------------------------


@query(f"WITH {_DOC_SCORES} SELECT doc_id, chars, junk, tokens, words, short, long, mixed, letters, vowels, quality FROM docs")
def txt05_score_text(spark, d):
    """The score of every document and the counts behind it."""
    return doc_scores(spark, d).drop("lang", "source")


@query(
    r"""WITH l AS (SELECT id, string_split(regexp_replace(replace(replace(replace(replace(replace(replace(replace(text, 'ﬁ', 'fi'), 'ﬂ', 'fl'), 'ﬀ', 'ff'), chr(173), ''), chr(65279), ''), chr(13) || chr(10), chr(10)), chr(13), chr(10)), '[\x00-\x08\x0b\x0e-\x1f\x7f]', '', 'g'), chr(10)) AS ls FROM pdf_page_readings WHERE text IS NOT NULL),
c AS (SELECT id, list_transform(ls, lambda s: regexp_replace(regexp_replace(regexp_replace(s, '^\s+|\s+$', '', 'g'), '<[^>]{1,100}>', '', 'g'), '^\s+|\s+$', '', 'g')) AS ls FROM l)
SELECT id, md5(regexp_replace(array_to_string(list_filter(ls, lambda s: NOT (s <> '' AND NOT regexp_matches(s, '[\p{L}\p{N}]') AND (length(s) <= 2 OR regexp_matches(s, '^[\s|]+$') OR regexp_matches(s, '^[-~=_·•.]{3,}$') OR regexp_matches(s, '^[\s·•.]+$')))), chr(10)), '\n{3,}', chr(10) || chr(10), 'g')) AS h FROM c"""
)
def txt01_normalize(spark, d):
    """The cleaned texts."""
    return table(spark, d, "pdf_page_readings", "id", "text").where("text is not null").select("id", F.md5(T.normalize_text(F.col("text"))).alias("h"))


@query("SELECT id, len(string_split(text, 'uppslag')) - 1 AS n FROM pdf_page_readings WHERE text IS NOT NULL")
def txt08_marker_counts(spark, d):
    return table(spark, d, "pdf_page_readings", "id", "text").where("text is not null").select("id", T.marker_count(F.col("text"), "uppslag").alias("n"))


@query(
    r"""WITH p AS (SELECT id, text, string_split(text, 'uppslag') AS parts FROM pdf_page_readings WHERE contains(text, 'uppslag')),
s AS (SELECT id, text, i, length(array_to_string(parts[1:i], 'uppslag')) AS s FROM p, unnest(generate_series(1, len(parts) - 1)) AS u(i))
SELECT id, i AS nr, CASE WHEN s > 80 THEN '…' ELSE '' END || trim(regexp_replace(substring(text, greatest(s - 80, 0) + 1, least(s + 87, length(text)) - greatest(s - 80, 0)), '\s+', ' ', 'g')) || CASE WHEN s + 87 < length(text) THEN '…' ELSE '' END AS snippet FROM s"""
)
def txt09_snippets(spark, d):
    t = table(spark, d, "pdf_page_readings", "id", "text").where(F.col("text").contains("uppslag"))
    return t.select("id", F.posexplode(T.marker_snippets(F.col("text"), "uppslag")).alias("i", "snippet")).select("id", (F.col("i") + 1).alias("nr"), "snippet")


@query(r"SELECT doc_id, token, count(*) AS n FROM (SELECT doc_id, unnest(regexp_extract_all(lower(text), '[0-9a-zåäöéèü]+')) AS token FROM documents WHERE text IS NOT NULL) GROUP BY ALL")
def txt10_tokens(spark, d):
    """Postings: tokens of each document."""
    return retrieval.bm25_index(table(spark, d, "documents", "doc_id", "text").where("text is not null"), "doc_id", "text").select("doc_id", F.col("term").alias("token"), F.col("tf").alias("n"))


@query(
    r"""WITH l AS (SELECT id, unnest(generate_series(1, len(string_split(markdown, chr(10))))) AS i, unnest(string_split(markdown, chr(10))) AS s FROM pdf_page_readings WHERE markdown IS NOT NULL),
k AS (SELECT id, i, CASE WHEN regexp_matches(s, '^\s*\|.*\|\s*$') THEN array_to_string(list_transform(string_split(regexp_replace(regexp_replace(s, '^\s+|\s+$', '', 'g'), '^\|+|\|+$', '', 'g'), '|'), lambda c: regexp_replace(c, '^\s+|\s+$', '', 'g')), chr(9))
 ELSE regexp_replace(regexp_replace(s, '^\s{0,3}>\s?', ''), '^\s{0,3}#{1,6}\s+', '') END AS s FROM l WHERE NOT (regexp_matches(s, '^\s*\|?\s*:?-{2,}:?\s*(\|\s*:?-{2,}:?\s*)*\|?\s*$') AND contains(s, '|')))
SELECT id, string_agg(regexp_replace(replace(replace(s, '**', ''), '__', ''), '\s+$', ''), chr(10) ORDER BY i) AS plain FROM k GROUP BY id"""
)
def txt16_markdown_to_text(spark, d):
    return table(spark, d, "pdf_page_readings", "id", "markdown").where("markdown is not null").select("id", T.markdown_to_text(F.col("markdown")).alias("plain")).where("plain is not null")


@query(
    f"""WITH {_PAGES}, u AS (SELECT pdf_stem, page_num, coalesce(text, '') AS t FROM pages), g AS (SELECT pdf_stem, max(page_num) AS n FROM u WHERE page_num >= 1 GROUP BY 1),
s AS (SELECT g.pdf_stem, i, coalesce(u.t, '') AS t FROM g, unnest(generate_series(1, n)) AS x(i) LEFT JOIN u ON u.pdf_stem = g.pdf_stem AND u.page_num = i) SELECT pdf_stem, md5(string_agg(t, chr(12) ORDER BY i)) AS digest FROM s GROUP BY 1"""
)
def txt18_merge_pages(spark, d):
    """Documents put together from their pages, gaps as empty pages."""
    p = current_pages(spark, d, "text").select("pdf_stem", "page_num", "text")
    first = p.where("page_num % 2 = 1")
    return pages.overlaid(first, p, "pdf_stem").select("pdf_stem", F.md5("text").alias("digest"))


@query(
    """WITH n AS (SELECT event_id, user_id * user_id * user_id * 7 AS v FROM events) SELECT event_id, CASE WHEN abs(v) < 1000 THEN v::VARCHAR WHEN abs(floor(v / 1000 + 0.5)) < 1000 THEN floor(v / 1000 + 0.5)::BIGINT || 'k'
WHEN abs(v / 1000000) < 10 THEN printf('%.1f', v / 1000000) || 'm' ELSE floor(v / 1000000 + 0.5)::BIGINT || 'm' END AS shown FROM n"""
)
def txt31_compact_counts(spark, d):
    return table(spark, d, "events", "event_id", "user_id").select("event_id", T.compact_count(F.col("user_id") * F.col("user_id") * F.col("user_id") * 7).alias("shown"))


@query(
    """WITH s AS (SELECT event_id, CAST(floor(value * 97) AS BIGINT) AS s FROM events) SELECT event_id, CASE WHEN s >= 3600 THEN s // 3600 || ' h ' || s % 3600 // 60 || ' min' WHEN s >= 60 THEN s // 60 || ' min ' || s % 60 || ' s' ELSE s || ' s' END AS shown FROM s"""
)
def txt33_durations(spark, d):
    return table(spark, d, "events", "event_id", "value").select("event_id", T.duration_text(F.floor(F.col("value") * 97)).alias("shown"))


@query("SELECT pdf_stem, CASE WHEN list_contains(string_split(pdf_path, '/'), 'wpu_files') THEN 'wpu' ELSE 'files' END AS kind FROM pdf_files WHERE pdf_path IS NOT NULL")
def txt35_source_of_path(spark, d):
    return table(spark, d, "pdf_files", "pdf_stem", "pdf_path").where("pdf_path is not null").select("pdf_stem", F.when(F.array_contains(F.split("pdf_path", "/"), "wpu_files"), "wpu").otherwise("files").alias("kind"))


@query(
    r"""WITH a AS (SELECT id, regexp_replace(text, '([\p{L}\p{N}_])-\n((och|eller|som|till|samt)([^\p{L}\p{N}_]|$))', '\1-' || chr(1) || '\2', 'g') AS t FROM pdf_page_readings WHERE text IS NOT NULL),
b AS (SELECT id, regexp_replace(regexp_replace(t, '([\p{L}\p{N}_])-\n([a-zåäöéü])', '\1\2', 'g'), '([\p{L}\p{N}_])-\n([a-zåäöéü])', '\1\2', 'g') AS t FROM a) SELECT id, md5(replace(t, chr(1), chr(10))) AS h FROM b"""
)
def txt36_dehyphenate(spark, d):
    """Texts with broken words put together."""
    return table(spark, d, "pdf_page_readings", "id", "text").where("text is not null").select("id", F.md5(T.dehyphenate(F.col("text"))).alias("h"))


@query(
    r"""WITH l AS (SELECT id, unnest(generate_series(1, len(string_split(text, chr(10))))) AS i, unnest(string_split(text, chr(10))) AS s FROM pdf_page_readings WHERE text IS NOT NULL),
m AS (SELECT id, i, nullif(regexp_extract(trim(s), '^(Fråga|Svar|[A-ZÅÄÖ](?:[A-ZÅÄÖ .\-]{0,28}[A-ZÅÄÖ])?):\s*', 1), '') AS who FROM l) SELECT id, i AS line, who FROM m WHERE who IS NOT NULL"""
)
def txt37_turns(spark, d):
    """Where a speaker's turn begins."""
    l = table(spark, d, "pdf_page_readings", "id", "text").where("text is not null").select("id", F.posexplode(F.split("text", "\n")).alias("i", "s"))
    who = F.nullif(F.regexp_extract(F.trim("s"), r"^(Fråga|Svar|[A-ZÅÄÖ](?:[A-ZÅÄÖ .\-]{0,28}[A-ZÅÄÖ])?):\s*", 1), F.lit(""))
    return l.select("id", (F.col("i") + 1).alias("line"), who.alias("who")).where("who is not null")


# ---- chunks and layout -----------------------------------------------------------


@query()
def chk01_chunks(spark, d):
    """Search chunks of every page."""
    return C.chunks(current_pages(spark, d, "text"), ["pdf_stem", "page_num"], "text")


@query()
def chk02_markdown_chunks(spark, d):
    return C.markdown_chunks(current_pages(spark, d, "markdown").where("markdown is not null"), ["pdf_stem", "page_num"], "markdown")


_CLEAN = "trim(regexp_replace(replace(text, chr(12), ' '), '[ \\t\\r\\f\\v]+', ' ', 'g'), ' ' || chr(10))"


@query(f"WITH {_PAGES} SELECT pdf_stem, page_num, length({_CLEAN}) AS chars, true AS within, true AS whole FROM pages WHERE {_CLEAN} <> ''")
def chk01_covered(spark, d):
    """Chunks of every page put beside its text: none too long, none missing between them."""
    c = chk01_chunks(spark, d)
    w = F_Window("page", "chunk_idx")
    c = c.withColumn("page", F.struct("pdf_stem", "page_num")).withColumn("gap", F.col("start") - F.coalesce(F.lag("end").over(w), F.lit(0)))
    return c.groupBy("pdf_stem", "page_num").agg(F.max("end").alias("chars"), (F.max(F.length("chunk")) <= C.SIZE).alias("within"), (F.max("gap") <= 0).alias("whole"))


@query(f"WITH {_PAGES} SELECT pdf_stem, page_num, true AS within, 0 AS lost FROM pages WHERE length(trim(markdown)) >= 160")
def chk02_conserved(spark, d):
    """Markdown chunks beside their page: none too long, and every word of the page in one that is kept."""
    p = current_pages(spark, d, "markdown").where("length(trim(markdown)) >= 160")
    c = C.markdown_chunks(p, ["pdf_stem", "page_num"], "markdown")
    words = lambda t: F.regexp_extract_all(t, F.lit(r"([\p{L}\p{N}]+)"), 1)
    kept = F.when(F.length("chunk") >= C.LEAST, words(F.col("chunk")))
    got = c.groupBy("pdf_stem", "page_num").agg((F.max(F.length("chunk")) <= C.SIZE).alias("within"), F.array_distinct(F.flatten(F.collect_list(kept))).alias("have"))
    return p.join(got, ["pdf_stem", "page_num"]).select("pdf_stem", "page_num", "within", F.size(F.array_except(words(F.col("markdown")), F.col("have"))).alias("lost"))


@query()
def chk16_useful_chunks(spark, d):
    """Chunks worth indexing, Markdown where a page has it, numbered through each document."""
    p = current_pages(spark, d, "text", "markdown")
    md = C.markdown_chunks(p.where("markdown is not null"), ["pdf_stem", "page_num"], "markdown").where(C.is_useful(F.col("chunk"), markdown=True))
    tx = C.chunks(p.where("markdown is null"), ["pdf_stem", "page_num"], "text").where(C.is_useful(F.col("chunk")))
    every = md.select("pdf_stem", "page_num", "chunk_idx", "chunk").unionByName(tx.select("pdf_stem", "page_num", "chunk_idx", "chunk"))
    return every.withColumn("chunk_idx", F.row_number().over(F_Window("pdf_stem", "page_num", "chunk_idx")) - 1)


def F_Window(part: str, *order: str):
    from pyspark.sql import Window

    return Window.partitionBy(part).orderBy(*order)


@query(
    """WITH r AS (SELECT l_orderkey AS page, l_partkey % 400 AS y FROM lineitem GROUP BY ALL), m AS (SELECT page, y, CASE WHEN y - lag(y) OVER w > 60 OR lag(y) OVER w IS NULL THEN 1 ELSE 0 END AS n FROM r WINDOW w AS (PARTITION BY page ORDER BY y)),
b AS (SELECT page, y, sum(n) OVER (PARTITION BY page ORDER BY y) AS b FROM m) SELECT page, min(y) AS top, max(y) AS bottom FROM b GROUP BY page, b HAVING max(y) - min(y) + 1 >= 8"""
)
def lay26_dark_blocks(spark, d):
    """Gaps and islands of rows."""
    r = table(spark, d, "lineitem", "l_orderkey", "l_partkey").select(F.col("l_orderkey").alias("page"), (F.col("l_partkey") % 400).alias("y")).distinct()
    return pages.dark_blocks(r, "page", "y", gap=59, height=8)


# ---- search ----------------------------------------------------------------------


def _query_vector(spark, d) -> list[float]:
    """The stated query: one row's vector."""
    return table(spark, d, "embeddings").where("vec_id = 0").select("embedding").first()[0]


_DIST = "round(list_sum(list_transform(generate_series(1, 64), lambda i: (e.embedding[i]::DOUBLE - q.embedding[i]::DOUBLE) * (e.embedding[i]::DOUBLE - q.embedding[i]::DOUBLE))), 6)"


@query(f"SELECT e.vec_id, {_DIST} AS distance FROM embeddings e, (SELECT embedding FROM embeddings WHERE vec_id = 0) q ORDER BY distance, vec_id LIMIT 20")
def top01_knn(spark, d):
    """The 20 nearest vectors, exactly."""
    return retrieval.knn(table(spark, d, "embeddings"), "embedding", _query_vector(spark, d), 20, "vec_id").select("vec_id", "distance")


@query(f"SELECT e.vec_id, {_DIST} AS distance FROM embeddings e, (SELECT embedding FROM embeddings WHERE vec_id = 0) q WHERE e.label = 3 ORDER BY distance, vec_id LIMIT 20")
def flt26_knn_prefiltered(spark, d):
    """The filter comes before the nearest, so no hit is lost."""
    return retrieval.knn(table(spark, d, "embeddings"), "embedding", _query_vector(spark, d), 20, "vec_id", F.col("label") == 3).select("vec_id", "distance")


_BM25 = r"""toks AS (SELECT doc_id, regexp_extract_all(lower(text), '[0-9a-zåäöéèü]+') AS t FROM documents WHERE text IS NOT NULL), s AS (SELECT count(*) AS n, avg(len(t)) AS a FROM toks),
tf AS (SELECT doc_id, len(t) AS l, w, len(list_filter(t, lambda x: x = w)) AS tf FROM toks, (SELECT unnest(['bageriet', 'cykel', 'handskriven']) AS w)),
df AS (SELECT w, count(*) FILTER (tf > 0) AS df FROM tf GROUP BY w),
bm AS (SELECT doc_id, round(sum(ln(1 + (n - df + 0.5) / (df + 0.5)) * tf * 2.2 / (tf + 1.2 * (0.25 + 0.75 * l / a))), 6) AS score FROM tf JOIN df USING (w), s GROUP BY doc_id)"""


@query(f"WITH {_BM25} SELECT doc_id, score FROM bm WHERE score > 0 ORDER BY score DESC, doc_id LIMIT 20")
def win01_bm25(spark, d):
    """Full-text search."""
    return retrieval.bm25(table(spark, d, "documents", "doc_id", "text"), "doc_id", "text", "handskriven cykel bageriet", 20)


_TWO = f"""{_BM25}, a AS (SELECT vec_id AS doc_id, row_number() OVER (ORDER BY distance, vec_id) - 1 AS rank FROM (SELECT e.vec_id, {_DIST} AS distance FROM embeddings e, (SELECT embedding FROM embeddings WHERE vec_id = 0) q) ORDER BY rank LIMIT 20),
b AS (SELECT doc_id, row_number() OVER (ORDER BY score DESC, doc_id) - 1 AS rank FROM bm WHERE score > 0 ORDER BY rank LIMIT 20)"""
QUERY_TEXT = "handskriven cykel bageriet"


def _texts(spark, d):
    return table(spark, d, "documents", "doc_id", "text", "source", "dossier")


def _vectors(spark, d):
    return table(spark, d, "embeddings").withColumnRenamed("vec_id", "doc_id")


def _two_lists(spark, d):
    """The vector's and the words' hits, 20 each, over the whole tables."""
    near = retrieval.knn(_vectors(spark, d), "embedding", _query_vector(spark, d), 20, "doc_id")
    words = retrieval.bm25(_texts(spark, d), "doc_id", "text", QUERY_TEXT, 20)
    return [retrieval.ranked(near, "distance", "doc_id").select("doc_id", "rank"), retrieval.ranked(words, F.desc("score"), "doc_id").select("doc_id", "rank")]


@query(
    f"""WITH {_TWO}, u AS (SELECT doc_id, rank, 0 AS l FROM a UNION ALL SELECT doc_id, rank, 1 FROM b) SELECT doc_id, round(sum(1 / (61 + rank)), 8) AS score FROM u GROUP BY 1 ORDER BY score DESC, min((l, rank)) LIMIT 20"""
)
def win01_rrf(spark, d):
    """Reciprocal rank fusion of two lists."""
    return retrieval.rrf(_two_lists(spark, d), "doc_id", 20)


@query(f"""WITH {_TWO}, u AS (SELECT doc_id, rank, 0 AS l FROM a UNION ALL SELECT doc_id, rank, 1 FROM b), m AS (SELECT doc_id, min((rank, l)) AS o FROM u GROUP BY 1 ORDER BY o LIMIT 20) SELECT doc_id, row_number() OVER (ORDER BY o) - 1 AS place FROM m""")
def win03_interleave(spark, d):
    a, b = _two_lists(spark, d)
    return retrieval.interleave(a, b, "doc_id", 20)


@query(
    r"""WITH p AS (SELECT DISTINCT doc_id, unnest(regexp_extract_all(lower(text), '[0-9a-zåäöéèü]+')) AS token FROM documents WHERE text IS NOT NULL),
s AS (SELECT DISTINCT token, round(1 - levenshtein('bagariet', token) / greatest(8, length(token), 1), 6) AS s FROM p) SELECT doc_id, round(max(s), 3) AS score FROM p JOIN s USING (token) WHERE s >= 0.75 GROUP BY 1 ORDER BY score DESC, doc_id LIMIT 25"""
)
def top04_fuzzy_levenshtein(spark, d):
    return retrieval.fuzzy(table(spark, d, "documents", "doc_id", "text").where("text is not null"), "doc_id", "text", "bagariet", 25, 0.75, exact_ratio=False)


@query()
def top04_fuzzy_ratio(spark, d):
    """Typo-tolerant search by Ratcliff/Obershelp."""
    return retrieval.fuzzy(table(spark, d, "documents", "doc_id", "text").where("text is not null"), "doc_id", "text", "handskrifven cykell", 25, 0.8)


@query(f"WITH {_DOC_SCORES} SELECT doc_id, quality FROM docs ORDER BY quality, doc_id LIMIT 20")
def top05_worst(spark, d):
    return quality.worst(doc_scores(spark, d), "quality", ["doc_id"], 20).select("doc_id", "quality")


@query(
    f"""WITH {_TWO} SELECT md5(string_agg('[Nr ' || doc_id || ', sida 1, "' || substring(coalesce(dossier, ''), 1, 60) || '"]' || chr(10) || 'source: "' || source || '"' || chr(10) || text, chr(10) || chr(10) || '---' || chr(10) || chr(10) ORDER BY rank)) AS context FROM b JOIN documents USING (doc_id)"""
)
def txt22_context(spark, d):
    """Ranked hits as one block of text with their citations and files."""
    _, b = _two_lists(spark, d)
    hits = _texts(spark, d).join(F.broadcast(b), "doc_id")
    return display.joined_hits(hits, "rank", display.hit_block(F.col("doc_id"), F.lit(1), F.col("dossier"), F.col("text"), F.col("source"))).select(F.md5("context").alias("context"))


# ---- history, deltas, jobs -------------------------------------------------------


@query("SELECT pdf_stem, page_num, arg_max(id, id) AS id, arg_max(reason, id) AS reason, count(*) AS readings FROM pdf_page_readings GROUP BY ALL")
def win09_latest_reading(spark, d):
    return table(spark, d, "pdf_page_readings", "pdf_stem", "page_num", "id", "reason").groupBy("pdf_stem", "page_num").agg(F.max("id").alias("id"), F.max_by("reason", "id").alias("reason"), F.count(F.lit(1)).alias("readings"))


@query(
    """WITH o AS (SELECT *, row_number() OVER (PARTITION BY pdf_stem, page_num ORDER BY id) AS n, lag(score) OVER (PARTITION BY pdf_stem, page_num ORDER BY id) AS before, lag(text) OVER (PARTITION BY pdf_stem, page_num ORDER BY id) AS old FROM pdf_page_readings)
SELECT id, CASE WHEN text IS NULL OR text = old THEN 'failed' WHEN n = 1 OR before IS NULL THEN 'improved' WHEN score > before THEN 'improved' ELSE 'kept' END AS outcome FROM o"""
)
def win12_reread_outcome(spark, d):
    """What becomes of each new reading: strictly better ones replace the old."""
    from pyspark.sql import Window

    w = Window.partitionBy("pdf_stem", "page_num").orderBy("id")
    r = table(spark, d, "pdf_page_readings", "id", "pdf_stem", "page_num", "score", "text")
    before, old = F.lag("score").over(w), F.lag("text").over(w)
    return r.select("id", F.when(F.col("text").isNull() | (F.col("text") == old), "failed").when((F.row_number().over(w) == 1) | before.isNull(), "improved").when(F.col("score") > before, "improved").otherwise("kept").alias("outcome"))


@query(
    """WITH i AS (SELECT l_orderkey AS k, max(l_quantity) AS stored FROM lineitem WHERE l_orderkey % 3 > 0 GROUP BY 1), j AS (SELECT o_orderkey, o_totalprice / 5000 AS disk, CASE WHEN stored = 50 THEN 0 ELSE stored END AS stored, o_orderpriority = '1-URGENT' AS inside, o_orderstatus = 'F' AS bad FROM orders LEFT JOIN i ON k = o_orderkey)
SELECT o_orderkey, CASE WHEN NOT inside THEN CASE WHEN bad AND stored IS NOT NULL AND NOT (CASE WHEN stored = 0 THEN coalesce(disk > 30, false) ELSE disk > stored END) THEN 'skip' ELSE 'new' END
WHEN stored IS NULL OR (CASE WHEN stored = 0 THEN coalesce(disk > 30, false) ELSE disk > stored END) THEN 'reingest' ELSE 'skip' END AS action FROM j"""
)
def win14_delta_classes(spark, d):
    """New, changed and known files."""
    i = table(spark, d, "lineitem", "l_orderkey", "l_quantity").where("l_orderkey % 3 > 0").groupBy(F.col("l_orderkey").alias("o_orderkey")).agg(F.max("l_quantity").alias("stored"))
    j = table(spark, d, "orders", "o_orderkey", "o_totalprice", "o_orderpriority", "o_orderstatus").join(i, "o_orderkey", "left")
    stored = F.when(F.col("stored") == 50, 0.0).otherwise(F.col("stored"))
    action = state.index_action(F.col("o_orderpriority") == "1-URGENT", stored, F.col("o_totalprice") / 5000, F.lit(30.0), F.col("o_orderstatus") == "F")
    return j.select("o_orderkey", action.alias("action"))


@query("SELECT user_id, arg_max(event_id, (ts, event_id)) AS event_id, arg_max(event_type, (ts, event_id)) AS event_type FROM events GROUP BY 1")
def mut01_upsert(spark, d):
    """The last update of each key replaces what was there."""
    e = table(spark, d, "events", "event_id", "ts", "user_id", "event_type")
    old = e.where("event_type = 'view'").groupBy("user_id").agg(F.min("event_id").alias("event_id")).withColumn("event_type", F.lit("old"))
    return state.upsert(old, e, ["user_id"], [F.col("ts"), F.col("event_id")])


@query("SELECT pdf_stem, CASE WHEN tesseract_failed = 1 THEN NULL ELSE tesseract_done_at END AS tesseract_done_at, CASE WHEN tesseract_failed = 1 THEN 0 ELSE tesseract_failed END AS tesseract_failed FROM pdf_files")
def mut11_clear_failures(spark, d):
    """A conditional update."""
    f = table(spark, d, "pdf_files", "pdf_stem", "tesseract_done_at", "tesseract_failed")
    return state.update_where(f, F.col("tesseract_failed") == 1, {"tesseract_done_at": F.lit(None).cast("string"), "tesseract_failed": F.lit(0)})


@query("SELECT pdf_stem FROM pdf_files WHERE normalized_at IS NULL OR floor(text_mtime) > epoch(try_cast(CASE WHEN regexp_matches(normalized_at, '(Z|[+-]\\d\\d:?\\d\\d)$') THEN normalized_at ELSE normalized_at || 'Z' END AS TIMESTAMPTZ))")
def mut14_needing_normalize(spark, d):
    """Files changed since they were cleaned, by whole seconds."""
    n = F.col("normalized_at")
    at = F.when(n.rlike(r"(Z|[+-]\d\d:?\d\d)$"), n).otherwise(F.concat(n, F.lit("Z"))).try_cast("timestamp")
    return table(spark, d, "pdf_files", "pdf_stem", "text_mtime", "normalized_at").where(n.isNull() | (F.floor("text_mtime") > F.unix_micros(at) / 1_000_000)).select("pdf_stem")


@query("SELECT user_id, event_type FROM (SELECT DISTINCT user_id, event_type FROM events) WHERE user_id NOT IN (SELECT user_id FROM events WHERE event_type = 'error')")
def mut16_bulk_delete(spark, d):
    e = table(spark, d, "events", "user_id", "event_type")
    return state.delete(e.distinct(), e.where("event_type = 'error'").select("user_id"), ["user_id"])


_STATE = "CASE event_type WHEN 'view' THEN 'queued' WHEN 'signup' THEN 'running' WHEN 'click' THEN 'cancel_requested' WHEN 'error' THEN 'failed' ELSE 'succeeded' END"


@query(
    f"""WITH s AS (SELECT event_id, {_STATE} AS s, lead({_STATE}) OVER (PARTITION BY user_id ORDER BY event_id) AS t FROM events) SELECT event_id, (t = 'running' AND s = 'queued') OR (t = 'cancel_requested' AND s IN ('queued', 'running')) OR (t = 'succeeded' AND s = 'running')
OR (t = 'failed' AND s IN ('queued', 'running')) AS legal FROM s WHERE t IS NOT NULL"""
)
def mut31_job_transitions(spark, d):
    """Which state changes of jobs are legal."""
    s = F.when(F.col("event_type") == "view", "queued").when(F.col("event_type") == "signup", "running").when(F.col("event_type") == "click", "cancel_requested").when(F.col("event_type") == "error", "failed").otherwise("succeeded")
    e = table(spark, d, "events", "event_id", "user_id", "event_type").withColumn("s", s)
    return e.withColumn("t", F.lead("s").over(F_Window("user_id", "event_id"))).where("t is not null").select("event_id", state.may_become(F.col("s"), F.col("t")).alias("legal"))


@query("WITH j AS (SELECT user_id, max(ts) AS seen, user_id % 2 = 0 AS queued FROM events GROUP BY 1), n AS (SELECT max(ts) AS now FROM events) SELECT user_id FROM j, n WHERE epoch(now) - epoch(seen) > CASE WHEN queued THEN 60 ELSE 15 END")
def mut33_stale_jobs(spark, d):
    """Jobs without a sign of life."""
    e = table(spark, d, "events", "user_id", "ts").withColumn("ts", F.date_trunc("second", F.col("ts").cast("timestamp")))
    j = e.groupBy("user_id").agg(F.max("ts").alias("last_seen")).withColumn("status", F.when(F.col("user_id") % 2 == 0, "queued").otherwise("running"))
    now = e.agg(F.max("ts").alias("now"))
    return state.stale_jobs(j.join(F.broadcast(now), F.lit(True)), F.col("now")).select("user_id")


@query("SELECT event_id, round(((user_id * 100 - least(user_id * 30, user_id * 100)) * 2.0 + least(user_id * 30, user_id * 100) * 0.5 + user_id * 10 * 8.0) / 1000000, 8) AS cost FROM events")
def mut41_cost(spark, d):
    e = table(spark, d, "events", "event_id", "user_id")
    return e.select("event_id", F.round(state.cost_usd(F.col("user_id") * 100, F.col("user_id") * 30, F.col("user_id") * 10, 2.0, 8.0, 0.5), 8).alias("cost"))


# ---- maps and timelines ----------------------------------------------------------


@query(
    """WITH o AS (SELECT event_id, user_id, CASE WHEN event_id % 7 > 0 THEN strftime(ts, '%H:%M') END AS t FROM events), m AS (SELECT *, CASE WHEN t IS NULL THEN NULL ELSE (CAST(t[1:2] AS INT) + CASE WHEN CAST(t[1:2] AS INT) < 12 THEN 24 ELSE 0 END) * 60 + CAST(t[4:5] AS INT) END AS m FROM o)
SELECT user_id, md5(string_agg(event_id, ',' ORDER BY m IS NULL, m, event_id)) AS track FROM m GROUP BY 1"""
)
def win04_tracks(spark, d):
    """Each person's observations in the order of the night."""
    e = table(spark, d, "events", "event_id", "user_id", "ts").withColumn("t", F.when(F.col("event_id") % 7 > 0, F.date_format("ts", "HH:mm")))
    return geo.ordered_tracks(e, "user_id", "t", "event_id").select("user_id", F.md5(F.array_join(F.transform("track", lambda x: x.cast("string")), ",")).alias("track"))


@query(
    """WITH o AS (SELECT event_id, CASE WHEN event_id % 9 = 0 THEN ' ' ELSE 'p' END AS person, value * 1.2 - 5 AS lat, value * 3 - 40 AS lon, CASE WHEN event_id % 5 = 0 THEN '25:99' WHEN event_id % 5 < 3 THEN '21:30' END AS t, CASE WHEN event_id % 11 > 0 THEN 'src' END AS s FROM events)
SELECT event_id, array_to_string(list_filter([CASE WHEN trim(person) = '' THEN 'person' END, CASE WHEN NOT lat BETWEEN -90 AND 90 THEN 'lat' END, CASE WHEN NOT lon BETWEEN -180 AND 180 THEN 'lon' END, CASE WHEN t IS NOT NULL AND NOT regexp_matches(t, '^([01]\\d|2[0-3]):[0-5]\\d$') THEN 'time' END,
CASE WHEN s IS NULL THEN 'source' END], lambda x: x IS NOT NULL), ',') AS problems FROM o"""
)
def flt21_observation_rules(spark, d):
    """What is wrong with observations."""
    k = F.col("event_id")
    e = table(spark, d, "events", "event_id", "value")
    v = geo.violations(F.when(k % 9 == 0, " ").otherwise("p"), F.col("value") * 1.2 - 5, F.col("value") * 3 - 40, F.when(k % 5 == 0, "25:99").when(k % 5 < 3, "21:30"), F.when(k % 11 > 0, "src"))
    return e.select("event_id", F.array_join(v, ",").alias("problems"))


@query(
    r"""WITH t AS (SELECT id, regexp_extract(text, '(?:^|[^0-9])(([01]?[0-9]|2[0-3])[ .:]([0-5][0-9]))(?:[^0-9]|$)', 2) AS h, regexp_extract(text, '(?:^|[^0-9])(([01]?[0-9]|2[0-3])[ .:]([0-5][0-9]))(?:[^0-9]|$)', 3) AS m FROM pdf_page_readings WHERE contains(text, 'klockan'))
SELECT id, CASE WHEN h <> '' THEN lpad(h, 2, '0') || ':' || m END AS hhmm FROM t"""
)
def map02_times(spark, d):
    """The first time of day in a text."""
    return table(spark, d, "pdf_page_readings", "id", "text").where(F.col("text").contains("klockan")).select("id", T.time_of(F.col("text")).alias("hhmm"))


@query("SELECT c_custkey, ('0x' || sha1(lower(c_name))[1:8])::BIGINT % 10 AS colour FROM customer")
def map05_colours(spark, d):
    return table(spark, d, "customer", "c_custkey", "c_name").select("c_custkey", geo.color_index(F.col("c_name")).alias("colour"))


@query(
    """WITH p AS (SELECT user_id, (CASE WHEN hour(ts) < 12 THEN 24 + hour(ts) ELSE hour(ts) END) * 60 + minute(ts) AS m, event_id % 300 / 100 + 11 AS x, event_id % 700 / 100 + 55 AS y FROM events)
SELECT user_id, count(*) AS points, '{"type":"LineString","coordinates":[' || string_agg('[' || x || ',' || y || ']', ',' ORDER BY m, x, y) || ']}' AS geometry FROM p GROUP BY user_id HAVING count(*) > 1"""
)
def map07_geojson(spark, d):
    """Lines of the night per person."""
    e = table(spark, d, "events", "event_id", "user_id", "ts").withColumn("m", T.clock_minutes(F.date_format("ts", "HH:mm")))
    n = F.col("event_id")
    return geo.geojson(e.withColumn("lat", n % 700 / 100 + 55).withColumn("lon", n % 300 / 100 + 11), "user_id", "lat", "lon", "m")


# ---- windows over events (extension) ---------------------------------------------


@query("SELECT date_trunc('day', ts) AS start, event_type, count(*) AS n, round(sum(value), 4) AS total FROM events GROUP BY ALL")
def ext_window_counts(spark, d):
    """Daily counts, the batch form of the streaming aggregate."""
    e = table(spark, d, "events", "ts", "event_type", "value")
    return e.groupBy(F.window("ts", "1 day").alias("w"), "event_type").agg(F.count(F.lit(1)).alias("n"), F.round(F.sum("value"), 4).alias("total")).select(F.col("w.start").alias("start"), "event_type", "n", "total")


@query(
    """WITH g AS (SELECT user_id, ts, CASE WHEN ts - lag(ts) OVER (PARTITION BY user_id ORDER BY ts) < INTERVAL 6 HOUR THEN 0 ELSE 1 END AS n FROM events), s AS (SELECT user_id, ts, sum(n) OVER (PARTITION BY user_id ORDER BY ts ROWS UNBOUNDED PRECEDING) AS s FROM g)
SELECT user_id, min(ts) AS start, count(*) AS n FROM s GROUP BY user_id, s"""
)
def ext_sessions(spark, d):
    e = table(spark, d, "events", "ts", "user_id")
    return e.groupBy(F.session_window("ts", "6 hours").alias("w"), "user_id").agg(F.count(F.lit(1)).alias("n")).select("user_id", F.col("w.start").alias("start"), "n")


from pagewright.plans import catalog_review  # noqa: E402,F401  (adds its queries)
from pagewright.plans import catalog_state  # noqa: E402,F401
from pagewright.plans import catalog_more  # noqa: E402,F401
from pagewright.plans import catalog_rest  # noqa: E402,F401
