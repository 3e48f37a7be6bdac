"""Archive queries over the index, runs, graph sinks, dictionaries, marks and replies."""

from __future__ import annotations

from pyspark.sql import functions as F

from pagewright.functions import text as T
from pagewright.operators import archive_state as A
from pagewright.operators import forms, graph, index, layout, pages, quality, replies, retrieval, state, temporal
from pagewright.plans.catalog import _COUNTED_TEXT, _ENT, _FILES, _PAGES, _RES, _SCORE_SQL, _SCORED, _entities, current_pages, files, page_scores, query
from pagewright.session import materialize
from pagewright.sources.tables import table

AT = "2024-05-01T12:00:00+00:00"

# ---- index -----------------------------------------------------------------------

_CHUNKS = f"{_PAGES}, old AS (SELECT pdf_stem || '.txt' AS source, page_num AS page, 0 AS chunk_idx, 'gammal' AS text, 0.0 AS mtime FROM pages WHERE page_num <= 2), new AS (SELECT pdf_stem || '.txt' AS source, page_num AS page, 0 AS chunk_idx, 'ny' AS text, 5.0 AS mtime FROM pages WHERE length(pdf_stem) % 2 = 0)"


def _chunks(spark, d):
    p = current_pages(spark, d)
    make = lambda df, text: df.select(F.concat("pdf_stem", F.lit(".txt")).alias("source"), F.col("page_num").alias("page"), F.lit(0).alias("chunk_idx"), F.lit(text).alias("text"))
    return make(p.where("page_num <= 2"), "gammal"), make(p.where(F.length("pdf_stem") % 2 == 0), "ny").withColumn("mtime", F.lit(5.0))


@query(f"WITH {_CHUNKS} SELECT source, page, text, mtime FROM old WHERE source NOT IN (SELECT source FROM new) UNION ALL SELECT source, page, text, mtime FROM new")
def src07_stored_chunks(spark, d):
    """SRC5 to SRC7, ETC50: an older chunk table opened, the chunks of some documents replaced."""
    old, new = _chunks(spark, d)
    none = spark.createDataFrame([], "pdf_stem string, text_mtime double, chunks long, indexed_at string")
    return index.stored(index.opened(old, spark), none, new, F.lit(AT))[0].select("source", "page", "text", "mtime")


@query(f"WITH {_CHUNKS} SELECT regexp_replace(source, '\\.txt$', '') AS pdf_stem, max(mtime) AS text_mtime, count(*) AS chunks FROM new GROUP BY 1")
def src07_index_state(spark, d):
    """SRC7: time and number of chunks of each document stored."""
    old, new = _chunks(spark, d)
    none = spark.createDataFrame([], "pdf_stem string, text_mtime double, chunks long, indexed_at string")
    return index.stored(index.opened(None, spark), none, new, F.lit(AT))[1].select("pdf_stem", "text_mtime", "chunks")


@query(f"WITH {_PAGES}, n AS (SELECT DISTINCT pdf_stem FROM pages) SELECT pdf_stem, CASE WHEN length(pdf_stem) % 3 = 0 THEN 'skip' WHEN length(pdf_stem) % 3 = 1 THEN 'reingest' ELSE 'new' END AS action FROM n")
def mut22_run(spark, d):
    """MUT22, MUT25: a whole index run over every document, by what is indexed of it."""
    p = materialize(current_pages(spark, d, "text", "markdown"), "pages")
    n = F.length("pdf_stem") % 3
    disk = p.select("pdf_stem").distinct().withColumn("mtime", F.lit(10.0))
    known = disk.where(n < 2).select("pdf_stem", F.when(n == 0, 10.0).otherwise(5.0).alias("text_mtime"), F.lit(1).cast("long").alias("chunks"), F.lit("x").alias("indexed_at"))
    chunks, after, done = index.run(p, disk, index.empty(spark), known, F.lit(None).cast("double"), F.lit(AT))
    # Only documents that were cut have chunks, and the state counts them.
    bad = chunks.groupBy(F.regexp_replace("source", r"\.txt$", "").alias("pdf_stem")).agg(F.count(F.lit(1)).alias("k")).join(after.where("indexed_at <> 'x'"), "pdf_stem", "full").where("not (k <=> chunks)").select("pdf_stem")
    return done.join(bad, "pdf_stem", "left_anti")


@query("SELECT event_id, CASE event_id % 3 WHEN 0 THEN event_id + 0.5 WHEN 1 THEN epoch(TIMESTAMP '2024-05-01 10:00:00') END AS since FROM events")
def mut21_since(spark, d):
    """MUT21: points in time given as seconds or as dates."""
    e = table(spark, d, "events", "event_id")
    given = F.when(F.col("event_id") % 3 == 0, F.concat(F.col("event_id").cast("string"), F.lit(".5"))).when(F.col("event_id") % 3 == 1, "2024-05-01T12:00:00+02:00").otherwise("i går")
    return e.select("event_id", index.since(given).alias("since"))


@query("SELECT event_id, CASE WHEN user_id % 5 IN (0, 1) THEN 'failed:40' || 3 + user_id % 5 END AS note FROM events")
def src16_failure_notes(spark, d):
    """SRC16: lasting failures of downloads noted, passing ones not."""
    code = F.when(F.col("user_id") % 5 == 0, 403).when(F.col("user_id") % 5 == 1, 404).when(F.col("user_id") % 5 == 2, 429).when(F.col("user_id") % 5 == 3, 500)
    return table(spark, d, "events", "event_id", "user_id").select("event_id", state.failure_note(code).alias("note"))


@query("SELECT pdf_stem FROM pdf_files WHERE lower(pdf_path) LIKE '%.pdf' AND length(pdf_stem) % 2 = 1 ORDER BY pdf_stem LIMIT 100")
def etc23_to_download(spark, d):
    """ETC23, SRC3: files of a list that aren't there yet, whatever the case of their names, 100 at most (the run's limit)."""
    f = table(spark, d, "pdf_files", "pdf_stem", "pdf_path").where(F.lower("pdf_path").endswith(".pdf")).withColumn("k", F.lower("pdf_stem"))
    have = f.where(F.length("pdf_stem") % 2 == 0).select(F.lower(F.upper("pdf_stem")).alias("k"))
    return f.join(have, "k", "left_anti").orderBy("pdf_stem").limit(100).select("pdf_stem")


# ---- quality ---------------------------------------------------------------------


@query(
    f"""WITH {_PAGES}, q AS (SELECT id, {_COUNTED_TEXT} FROM (SELECT id, regexp_replace(array_to_string(list_filter(list_transform(string_split(regexp_replace(replace(replace(replace(replace(replace(replace(replace(coalesce(text, ''), 'ﬁ', 'fi'), 'ﬂ', 'fl'), 'ﬀ', 'ff'), chr(173), ''), chr(65279), ''), chr(13) || chr(10), chr(10)), chr(13), chr(10)), '[\\x00-\\x08\\x0b\\x0e-\\x1f\\x7f]', '', 'g'), chr(10)), lambda s: regexp_replace(regexp_replace(regexp_replace(s, '^\\s+|\\s+$', '', 'g'), '<[^>]{{1,100}}>', '', 'g'), '^\\s+|\\s+$', '', 'g')),
lambda s: NOT (s <> '' AND NOT regexp_matches(s, '[\\p{{L}}\\p{{N}}]') AND (length(s) <= 2 OR regexp_matches(s, '^[\\s|]+$') OR regexp_matches(s, '^[-~=_·•.]{{3,}}$') OR regexp_matches(s, '^[\\s·•.]+$')))), chr(10)), '\\n{{3,}}', chr(10) || chr(10), 'g') AS t FROM pages)) SELECT id, {_SCORE_SQL} AS score FROM q"""
)
def txt07_comparison_score(spark, d):
    """TXT7: the score readings are compared by."""
    return current_pages(spark, d, "text").select("id", quality.comparison_score(F.col("text")).alias("score"))


@query(
    r"""WITH dict AS (SELECT DISTINCT lower(n_name) AS w FROM nation UNION SELECT unnest(['och', 'att', 'det', 'som', 'en', 'på'])), w AS (SELECT doc_id, unnest(regexp_extract_all(lower(text), '[a-zåäö\-]+')) AS w FROM documents)
SELECT d.doc_id, (SELECT CASE WHEN count(*) BETWEEN 1 AND 500 THEN round(count(*) FILTER (w IN (FROM dict)) / count(*), 3) END FROM w WHERE w.doc_id = d.doc_id) AS share FROM documents d"""
)
def txt06_dictionary_share(spark, d):
    """TXT6, ETC60: the share of words a dictionary has; none for very long texts (here over 500 words)."""
    dictionary = table(spark, d, "nation", "n_name").select(F.col("n_name").alias("word")).unionByName(spark.createDataFrame([(w,) for w in ("och", "att", "det", "som", "en", "på")], "word string"))
    return quality.dictionary_share(table(spark, d, "documents", "doc_id", "text"), "doc_id", "text", dictionary, most=500)


@query("SELECT doc_id, CASE WHEN trim(coalesce(text, '')) = '' THEN 'swe+eng' WHEN lang = 'en' THEN 'eng' ELSE 'swe' END AS languages FROM documents")
def flt03_languages(spark, d):
    """FLT3: the languages a page is read in (the share of English comes from the detector, here the table's own column)."""
    t = table(spark, d, "documents", "doc_id", "text", "lang")
    return t.select("doc_id", T.recognition_languages(F.col("text"), F.when(F.col("lang") == "en", 0.9).otherwise(0.1)).alias("languages"))


@query(
    f"""WITH {_SCORED}, {_FILES}, m AS (SELECT pdf_stem, round(avg(score), 2) AS s FROM scored GROUP BY 1), f AS (SELECT pdf_stem, src, regexp_extract(pdf_stem, '^([A-Z]+\\d+)', 1) AS k, s FROM files JOIN m USING (pdf_stem)),
one AS (SELECT k FROM f GROUP BY k HAVING count(*) FILTER (src = 'wpu') = 1 AND count(*) FILTER (src = 'files') <= 1) SELECT a.pdf_stem AS a, b.pdf_stem AS b, CASE WHEN b.s IS NULL THEN 'new' WHEN b.s - a.s > 5 THEN 'lost' WHEN a.s - b.s > 5 THEN 'better' ELSE 'kept' END AS category
FROM f a LEFT JOIN f b ON a.k = b.k AND b.src = 'files' WHERE a.src = 'wpu' AND a.k IN (FROM one)"""
)
def jn07_merge_plan(spark, d):
    """JN7, WIN13, ETC55: what becomes of documents that may replace others (compared where each number has one of each)."""
    means = page_scores(spark, d).groupBy("pdf_stem").agg(F.round(F.avg("score"), 2).alias("s"))
    f = files(spark, d).select("pdf_stem", "src", F.regexp_extract("pdf_stem", r"^([A-Z]+\d+)", 1).alias("group")).join(means, "pdf_stem")
    a = f.where("src = 'wpu'").select("group", F.col("pdf_stem").alias("a"), F.col("s").alias("a_score"))
    b = f.where("src = 'files'").select("group", F.col("pdf_stem").alias("b"), F.col("s").alias("b_score"))
    plan = quality.merge_plan(a.join(b, "group", "left"))
    one = f.groupBy("group").agg(F.count_if(F.col("src") == "wpu").alias("x"), F.count_if(F.col("src") == "files").alias("y")).where("x = 1 and y <= 1").select("group")
    return plan.join(a.join(one, "group").select("a"), "a", "left_semi").select("a", "b", "category")


# ---- graph sinks, previews -------------------------------------------------------


@query(f"WITH {_ENT}, {_RES}, o AS (SELECT DISTINCT typ AS label, norm FROM res WHERE typ IN ('person', 'plats', 'organisation')) SELECT label, norm, CASE WHEN length(norm) % 2 = 0 THEN 'förr' ELSE 'ny ' || norm END AS namn FROM o")
def src22_merged_nodes(spark, d):
    """SRC22: entities merged into the nodes there are; the first name written stays."""
    m = materialize(graph.mentions(_entities(spark, d)).select("label", "norm").distinct(), "mentions")
    old = m.where(F.length("norm") % 2 == 0).withColumn("namn", F.lit("förr"))
    new = m.select("label", "norm", F.concat(F.lit("ny "), "norm").alias("namn"), F.lit(1).alias("o"))
    return graph.merged(old, new, ["label", "norm"], "o")


@query("WITH h AS (SELECT event_id AS id, event_type AS fingerprint FROM events) SELECT max(id) AS id, fingerprint FROM h WHERE fingerprint = (SELECT min(fingerprint) FROM h) GROUP BY fingerprint")
def gr11_preview(spark, d):
    """GR11, LKP34, ETC57 to ETC59: the newest preview of the same state."""
    runs = table(spark, d, "events", "event_id", "event_type").select(F.col("event_id").alias("id"), F.col("event_type").alias("fingerprint"))
    return graph.preview_of(runs, runs.agg(F.min("fingerprint")).first()[0])


@query("SELECT n_nationkey AS id, n_name AS namn, 'plats' AS label FROM nation WHERE n_nationkey % 4 <> 0")
def etc62_centres(spark, d):
    """ETC62: centres shared in a link, whole ones only; a broken link gives none."""
    n = table(spark, d, "nation", "n_nationkey", "n_name")
    one = F.struct(F.concat(F.lit(" "), "n_name").alias("namn"), F.lit("plats").alias("label"), F.lower("n_name").alias("norm"))
    part = F.struct(F.col("n_name").alias("namn"), F.lit(" ").alias("label"), F.lit("x").alias("norm"))
    token = F.regexp_replace(F.translate(F.base64(F.encode(F.to_json(F.array(one, part)), "UTF-8")), "+/", "-_"), r"[=\r\n]", "")
    e = n.select(F.col("n_nationkey").alias("id"), F.explode(graph.decoded_centres(F.when(F.col("n_nationkey") % 4 == 0, "!trasig").otherwise(token))).alias("e"))
    return e.select("id", "e.namn", "e.label")


@query(f"WITH {_ENT}, f AS (SELECT pdf_stem, page_num, idx FROM raw WHERE typ = 'person' AND (length(namn) <= 4 OR NOT regexp_matches(namn, '\\S\\s+\\S')) AND namn <> '') SELECT count(DISTINCT (pdf_stem, page_num)) AS n_pages, count(*) AS items FROM f")
def etc20_pages_to_ask(spark, d):
    """ETC20: open questions by page, as many pages as a run may take (here all)."""
    rows = graph.audited(graph.occurrences(graph.parsed(table(spark, d, "doc_entities"))))
    short = F.filter("issues", lambda i: i == graph.ISSUES["short"])
    named = rows.where("kind = 'entity'").where(F.trim("namn") != "").select("pdf_stem", "page_num", F.concat_ws("/", "pdf_stem", "page_num", "idx").alias("item_key"), short.alias("issues"), F.lit(None).cast("string").alias("decision"))
    asked = replies.pages_to_ask(named, ["pdf_stem", "page_num"], 10**6)
    return asked.agg(F.count(F.lit(1)).alias("n_pages"), F.coalesce(F.sum(F.size("items")), F.lit(0)).alias("items"))


# ---- marks, replies, logs, limits ------------------------------------------------


@query("SELECT doc_id, CASE doc_id % 4 WHEN 0 THEN 'a [MASKAD] b' WHEN 1 THEN 'a [MASKAD] b' WHEN 2 THEN 'a [MASKAD] b' ELSE 'a [annat] b' END AS t FROM documents")
def txt13_marks(spark, d):
    """TXT13: the ways words are shown to be blacked out, made one."""
    t = table(spark, d, "documents", "doc_id")
    raw = F.when(F.col("doc_id") % 4 == 0, "a [svärtad text] b").when(F.col("doc_id") % 4 == 1, "a ████ b").when(F.col("doc_id") % 4 == 2, "a [ Maskerat namn ] b").otherwise("a [annat] b")
    return t.select("doc_id", T.normalize_mask_markers(raw).alias("t"))


@query("SELECT event_id, CASE WHEN user_id % 3 = 0 THEN '[MASKAD]' || chr(10) || 'a' || chr(10) || 'b' WHEN user_id % 3 = 1 THEN 'a' || chr(10) || '[MASKAD]' || chr(10) || 'b' ELSE 'a' || chr(10) || 'b' || chr(10) || '[MASKAD]' END AS t FROM events")
def txt14_inserted_marks(spark, d):
    """TXT14, TXT15, TXT17: marks put among lines by their height."""
    e = table(spark, d, "events", "event_id", "user_id")
    return e.select("event_id", forms.insert_masks(F.array(F.lit("a"), F.lit("b")), F.array((F.col("user_id") % 3 * 50.0)), F.lit(100)).alias("t"))


@query("SELECT event_id, CASE WHEN user_id % 7 = 0 THEN '0 anrop' ELSE user_id % 7 || ' anrop · ↑' || user_id % 900 || ' ↓12' || CASE WHEN event_id % 3 = 0 AND event_id % 2 = 1 THEN ' · kostnad okänd' WHEN event_id % 3 = 0 THEN '' ELSE ' · ≈ $1.50' || CASE WHEN event_id % 2 = 1 THEN ' (ofullständig — anrop utan pris)' ELSE '' END END END AS line FROM events")
def etc30_summaries(spark, d):
    """ETC30, TXT32: usage on one line."""
    e = table(spark, d, "events", "event_id", "user_id")
    cost = F.when(F.col("event_id") % 3 != 0, 1.5)
    return e.select("event_id", T.usage_summary(F.col("user_id") % 7, F.col("user_id") % 900, F.lit(12), cost, F.col("event_id") % 2 == 1).alias("line"))


@query("SELECT user_id, 'Förhörsledare' AS label, 'N' || user_id || ' forts' AS value FROM (SELECT DISTINCT user_id FROM events) UNION ALL SELECT user_id, 'Tolk', 'T' FROM (SELECT DISTINCT user_id FROM events)")
def txt38_header_fields(spark, d):
    """TXT38, LAY24: the metadata lines of an interrogation, lines without a label going on."""
    u = table(spark, d, "events", "user_id").distinct()
    text = F.concat(F.lit("Förhörsledare: N"), F.col("user_id").cast("string"), F.lit("\nforts\nTolk T\n\nTolk annat"))
    return u.select("user_id", F.explode(forms.header_fields(text, ("Förhörsledare", "Tolk"))).alias("f")).select("user_id", "f.label", "f.value")


@query("SELECT n_nationkey AS id, 'x [MASKAD] y' AS text, '[MASKAD]' AS cell FROM nation")
def lay21_replaced_marks(spark, d):
    """LAY21: the other spelling of the mark replaced in texts and cells."""
    n = table(spark, d, "nation", "n_nationkey")
    raw = F.lit('[{"kind": "TABLE", "text": "x [Redacted] y", "rows": [[{"text": "[ redacted ]", "header": false, "row_span": 1, "col_span": 1}]]}]')
    b = n.select(F.col("n_nationkey").alias("id"), layout.replace_redacted(layout.from_stored(raw)["blocks"]).alias("b"))
    return b.select("id", F.col("b")[0]["text"].alias("text"), F.col("b")[0]["rows"][0][0]["text"].alias("cell"))


@query("SELECT doc_id, 'https://x.example/' || doc_id AS url, substring(text, 1, 700) AS excerpt FROM documents WHERE doc_id % 3 <> 0 AND text IS NOT NULL AND NOT regexp_matches(text, '[\"\\\\\\x00-\\x1f]')")
def txt24_web_hits(spark, d):
    """TXT24, ETC26: links of an answer without excluded hosts, their excerpts at most 700 characters."""
    t = table(spark, d, "documents", "doc_id", "text").where(F.col("text").isNotNull() & ~F.col("text").rlike(r'["\\\x00-\x1f]'))
    host = F.when(F.col("doc_id") % 3 == 0, "www.spam.example").otherwise("x.example")
    a = F.to_json(F.array(F.struct(F.concat(F.lit("https://"), host, F.lit("/"), F.col("doc_id").cast("string")).alias("url"), F.lit("t").alias("title"), F.col("text").alias("content"))))
    got = replies.web_hits(t.select("doc_id", a.alias("a")), ["doc_id"], "a", T.excluded_host(F.col("url"), ["spam.example"]))
    return got.select("doc_id", "url", "excerpt")


@query("SELECT event_id FROM events WHERE event_type = 'error'")
def flt25_filtered_lines(spark, d):
    """FLT25: log lines of a level that hold a text."""
    e = table(spark, d, "events", "event_id", "event_type")
    lines = e.withColumn("line", F.concat_ws(" ", F.when(F.col("event_type") == "error", "ERROR").otherwise("INFO"), F.lit("Raden"), "event_id"))
    return state.log_lines(lines, "event_id", "event_id", "line", ["ERROR"], "raden").select("event_id")


@query("WITH r AS (SELECT user_id, event_id, row_number() OVER (PARTITION BY user_id ORDER BY event_id DESC) AS back FROM events WHERE event_type <> 'click') SELECT user_id, back, '12:00:00 rad ' || event_id AS line FROM r WHERE back <= 5")
def etc39_recent_lines(spark, d):
    """ETC39: the last five lines of every log that aren't for debugging."""
    e = table(spark, d, "events", "event_id", "user_id", "event_type")
    line = F.concat(F.lit("2024-05-01T12:00:00+00:00 ["), F.when(F.col("event_type") == "click", "debug").otherwise("info"), F.lit("] rad "), F.col("event_id").cast("string"))
    return replies.recent_lines(e.withColumn("line", line), "user_id", "event_id", "line")


@query("SELECT * FROM (VALUES ('k', 50), ('n', 6), ('low', 5), ('high', 15), ('web', 10), ('budget', 3)) t(what, value)")
def top15_limits(spark, d):
    """TOP15, ETC24, ETC25: arguments within their limits."""
    k, n = retrieval.limits(None, "x")
    low, high = retrieval.limits(1, 99)
    rows = [("k", k), ("n", n), ("low", low), ("high", high), ("web", state.clamp("40", 3, 10, 5)), ("budget", state.clamp("?", 1, 20, 3))]
    return spark.createDataFrame(rows, "what string, value int")


@query("SELECT event_id, user_id * 3 AS input, event_id % 5 AS output, CASE WHEN event_id % 2 = 0 THEN 7 ELSE user_id END AS cached FROM events")
def mut42_usage(spark, d):
    """MUT42, MUT43: token counts of both shapes of usage reports."""
    e = table(spark, d, "events", "event_id", "user_id")
    s = lambda c: c.cast("string")
    one = F.concat(F.lit('{"prompt_tokens": '), s(F.col("user_id") * 3), F.lit(', "completion_tokens": '), s(F.col("event_id") % 5), F.lit(', "prompt_tokens_details": {"cached_tokens": 7}}'))
    two = F.concat(F.lit('{"input_tokens": '), s(F.col("user_id")), F.lit(', "cache_creation_input_tokens": '), s(F.col("user_id")), F.lit(', "cache_read_input_tokens": '), s(F.col("user_id")), F.lit(', "output_tokens": '), s(F.col("event_id") % 5), F.lit("}"))
    return e.select("event_id", forms.usage_fields(F.when(F.col("event_id") % 2 == 0, one).otherwise(two)).alias("u")).select("event_id", "u.input", "u.output", "u.cached")


@query(f"WITH {_PAGES}, {_SCORED} SELECT pdf_stem, count(*) AS corrected FROM pages p JOIN scored s USING (pdf_stem, page_num) WHERE s.score < 60 AND coalesce(s.image_page, 0) = 0 AND page_num % 2 = 1 GROUP BY 1")
def etc16_corrected(spark, d):
    """ETC16: bad pages that aren't corrected yet, put over their documents."""
    p = current_pages(spark, d, "text").select("pdf_stem", "page_num", F.coalesce("text", F.lit("")).alias("text"))
    bad = page_scores(spark, d).where("score < 60 and coalesce(image_page, 0) = 0").select(*A.PAGE)
    done = p.where("page_num % 2 = 0").select(*A.PAGE)
    new = p.join(bad, A.PAGE, "left_semi").join(done, A.PAGE, "left_anti").withColumn("text", F.lit("RÄTTAD"))
    out = pages.overlaid(p, new, "pdf_stem")
    n = F.size(F.filter(F.split("text", "\f"), lambda x: x == "RÄTTAD"))
    return out.select("pdf_stem", n.alias("corrected")).where("corrected > 0")


@query(f"WITH {_SCORED} SELECT pdf_stem, page_num, score FROM scored WHERE score IS NOT NULL ORDER BY score, pdf_stem, page_num LIMIT 10")
def etc35_worst(spark, d):
    """ETC35: a report of the ten worst pages (its limit)."""
    return quality.worst(page_scores(spark, d), "score", A.PAGE, 10).select(*A.PAGE, "score")


@query("WITH a AS (SELECT doc_id, item_key, action FROM (SELECT row_number() OVER (ORDER BY item_key) AS doc_id, item_key, action, note FROM graph_review_decisions WHERE note IS NOT NULL) WHERE action IN ('keep', 'exclude', 'replace') AND trim(note) <> '' AND doc_id % 2 = 0) SELECT item_key, action FROM a")
def gr10_suggestions(spark, d):
    """GR10: suggestions in replies whose evidence stands in the page."""
    from pyspark.sql import Window

    g = table(spark, d, "graph_review_decisions", "item_key", "action", "note").where("note is not null")
    g = g.withColumn("n", F.row_number().over(Window.orderBy("item_key")))  # the reviewers' table, a stated small one
    s = F.struct("item_key", "action", "note", F.when(F.col("n") % 2 == 0, "Vittnet  SÅG").otherwise("annat").alias("evidence"))
    raw = F.concat(F.lit("Svar: "), F.to_json(F.struct(F.array(s, s).alias("suggestions"))), F.lit(" slut"))
    got = replies.suggestions(g.select("n", raw.alias("raw"), F.lit("I går vittnet såg en bil").alias("page")), ["n"], "raw", "page")
    return got.select("item_key", "action")


# ---- extensions ------------------------------------------------------------------


@query("SELECT event_type, user_id % 3 AS part, count(*) AS n, round(sum(value), 4) AS total FROM events GROUP BY ROLLUP (event_type, user_id % 3)")
def ext_rollup(spark, d):
    """Counts by kind and part, by kind, and of all."""
    e = table(spark, d, "events", "event_type", "user_id", "value").withColumn("part", F.col("user_id") % 3)
    return e.rollup("event_type", "part").agg(F.count(F.lit(1)).alias("n"), F.round(F.sum("value"), 4).alias("total"))


@query("SELECT event_type, user_id % 3 AS part, count(*) AS n FROM events GROUP BY CUBE (event_type, user_id % 3)")
def ext_cube(spark, d):
    e = table(spark, d, "events", "event_type", "user_id").withColumn("part", F.col("user_id") % 3)
    return e.cube("event_type", "part").agg(F.count(F.lit(1)).alias("n"))


@query(
    """WITH b AS (SELECT user_id, ts, event_id FROM events WHERE event_type = 'click') SELECT a.event_id AS id, max(b.event_id) AS last_click FROM (SELECT * FROM events WHERE event_type = 'purchase') a
LEFT JOIN (SELECT a.event_id AS id, max(b.ts) AS t FROM events a JOIN b ON a.user_id = b.user_id AND b.ts <= a.ts GROUP BY 1) m ON m.id = a.event_id LEFT JOIN b ON b.user_id = a.user_id AND b.ts = m.t GROUP BY 1"""
)
def ext_asof(spark, d):
    """For each purchase the user's last click at or before it."""
    e = table(spark, d, "events", "event_id", "user_id", "ts", "event_type")
    clicks = e.where("event_type = 'click'").groupBy("user_id", "ts").agg(F.max("event_id").alias("last_click"))
    bought = e.where("event_type = 'purchase'").select(F.col("event_id").alias("id"), "user_id", "ts")
    return temporal.asof(bought, clicks, "user_id", "ts", "last_click").select("id", "last_click")


@query("SELECT l_orderkey AS k, l_linenumber AS line, event_id AS id FROM lineitem JOIN events ON event_id % 1000 BETWEEN l_partkey AND l_partkey + l_linenumber WHERE l_orderkey < 200")
def ext_ranges(spark, d):
    """Points in ranges, without meeting every range."""
    r = table(spark, d, "lineitem", "l_orderkey", "l_linenumber", "l_partkey").where("l_orderkey < 200").select(F.col("l_orderkey").alias("k"), F.col("l_linenumber").alias("line"), F.col("l_partkey").cast("long").alias("low"), (F.col("l_partkey") + F.col("l_linenumber")).cast("long").alias("high"))
    p = table(spark, d, "events", "event_id").select(F.col("event_id").alias("id"), (F.col("event_id") % 1000).alias("x"))
    return temporal.in_ranges(p, r, "x", "low", "high", 8).select("k", "line", "id")


@query("SELECT event_type, count(*) AS n FROM events GROUP BY 1")
def ext_sketch_error(spark, d):
    """Approximate numbers of different ids by kind, kept where they are within a tenth of the exact ones."""
    e = table(spark, d, "events", "event_id", "event_type")
    a = e.groupBy("event_type").agg(F.approx_count_distinct("event_id", 0.02).alias("about"), F.count(F.lit(1)).alias("n"))
    return a.where(F.abs(F.col("about") - F.col("n")) <= 0.1 * F.col("n")).select("event_type", "n")
