"""More archive queries: review, replies, candidates, bookmarks, point lookups."""

from __future__ import annotations

from pyspark.sql import functions as F

from pagewright.functions import text as T
from pagewright.operators import geo, replies, review, state
from pagewright.plans.catalog import _ENT, _PAGES, current_pages, files, page_scores, query
from pagewright.sources.files import extension_of
from pagewright.sources.tables import table

_ITEMS = r"""latest AS (SELECT pdf_stem, page_num, max((coalesce(extracted_at, ''), coalesce(payload, '')))[2] AS payload FROM doc_entities GROUP BY ALL),
ok AS (SELECT pdf_stem, page_num, payload, payload::JSON AS j FROM latest WHERE json_valid(payload) AND json_type(payload, '$.entiteter') = 'ARRAY'),
items AS (SELECT pdf_stem, page_num, i AS idx, sha256(payload) AS source_hash, lower(trim(j->>('$.entiteter[' || i || '].typ'))) AS typ, trim(j->>('$.entiteter[' || i || '].namn')) AS namn,
  sha256('["' || pdf_stem || '",' || page_num || ',"entity",' || i || ']') AS item_key FROM ok, unnest(generate_series(0, json_array_length(j, '$.entiteter')::INT - 1)) AS u(i))"""


def _items(spark, d):
    return review.items(table(spark, d, "doc_entities"))


@query(f"WITH {_ITEMS} SELECT pdf_stem, page_num, idx, source_hash, item_key FROM items")
def gr08_item_keys(spark, d):
    """Digests that name every occurrence and its page."""
    return _items(spark, d).select("pdf_stem", "page_num", "idx", "source_hash", "item_key")


_NORM = r"""lower(trim(regexp_replace(CASE WHEN len(string_split({0}, ',')) = 2 AND trim(string_split({0}, ',')[1]) <> '' AND trim(string_split({0}, ',')[2]) <> '' AND NOT regexp_matches({0}, '\d')
  THEN trim(string_split({0}, ',')[2]) || ' ' || trim(string_split({0}, ',')[1]) ELSE {0} END, '\s+', ' ', 'g')))"""
_DECIDED = """dec AS (SELECT item_key, source_hash, CASE idx % 3 WHEN 0 THEN 'keep' WHEN 1 THEN 'exclude' ELSE 'replace' END AS action, typ AS t_typ, namn || ' x' AS t_namn FROM items WHERE page_num % 2 = 0),
rules AS (SELECT typ, min(n) AS source_norm, 'Ny Person' AS target FROM (SELECT typ, {n} AS n FROM items WHERE typ = 'person' AND namn <> '') GROUP BY typ),
eff AS (SELECT i.pdf_stem, i.page_num, d.item_key IS NOT NULL AS live, CASE WHEN d.action = 'replace' THEN d.t_typ ELSE i.typ END AS typ, coalesce(CASE WHEN d.action = 'replace' THEN d.t_namn END, r.target, i.namn) AS namn
  FROM items i LEFT JOIN dec d ON d.item_key = i.item_key AND d.source_hash = i.source_hash LEFT JOIN rules r ON r.typ = i.typ AND r.source_norm = {n2} AND coalesce(d.action, '') <> 'replace' WHERE coalesce(d.action, '') <> 'exclude'),
en AS (SELECT *, {n} AS norm FROM eff WHERE namn <> ''), sm AS (SELECT pdf_stem, regexp_extract(norm, '([^ ]+)$', 1) AS s, min(norm) AS full_name FROM en WHERE typ = 'person' AND contains(norm, ' ') GROUP BY 1, 2 HAVING min(norm) = max(norm))""".format(n=_NORM.format("namn"), n2=_NORM.format("i.namn"))


def _decided(spark, d):
    i = _items(spark, d)
    dec = i.where("page_num % 2 = 0").select("item_key", "source_hash", F.when(F.col("idx") % 3 == 0, "keep").when(F.col("idx") % 3 == 1, "exclude").otherwise("replace").alias("action"), F.to_json(F.struct("typ", F.concat("namn", F.lit(" x")).alias("namn"))).alias("target_json"))
    rules = i.where("typ = 'person' and namn <> ''").groupBy("typ").agg(F.min(T.normalize_name(F.col("namn"))).alias("source_norm")).withColumn("target", F.lit("Ny Person"))
    return i, dec, rules


@query(f"WITH {_ITEMS}, {_DECIDED} SELECT e.pdf_stem, page_num, typ AS label, coalesce(full_name, norm) AS norm FROM en e LEFT JOIN sm ON sm.pdf_stem = e.pdf_stem AND s = norm AND typ = 'person' AND NOT live WHERE typ IN ('person', 'plats', 'organisation')")
def gr09_reviewed_rows(spark, d):
    """Mentions after decisions, name rules and family names."""
    i, dec, rules = _decided(spark, d)
    return review.reviewed(i, dec, rules).select("pdf_stem", "page_num", "label", "norm")


@query()
def agg16_rule_preview(spark, d):
    """What one more name rule would change."""
    i, dec, rules = _decided(spark, d)
    cand = rules.select("typ", "source_norm", F.lit("Annan Person").alias("target"))
    return review.rule_preview(i, dec, rules, cand)


@query(f"WITH {_PAGES} SELECT pdf_stem, page_num, coalesce(contains(lower(trim(regexp_replace(text, '\\s+', ' ', 'g'))), 'uppslag'), false) AS ok FROM pages")
def flt23_evidence(spark, d):
    """Whether evidence stands in the page."""
    p = current_pages(spark, d, "text")
    return p.select("pdf_stem", "page_num", review.suggestion_ok(F.lit("UPPSLAG"), F.col("text")).alias("ok"))


_RAW = "'svar: {\"observationer\": [{\"person\": \"P' || user_id || '\", \"plats\": \"' || CASE WHEN event_id % 4 = 0 THEN ' ' ELSE event_type END || '\", \"tid\": \"kl 9.0' || event_id % 10 || '\", \"citat\": \"c\", \"confidence\": \"' || CASE WHEN event_id % 3 = 0 THEN 'high' ELSE 'x' END || '\"}]} slut'"


@query("SELECT event_id, 'P' || user_id AS person, event_type AS plats, CASE WHEN event_id % 3 = 0 THEN 'high' ELSE 'medium' END AS confidence, '09:0' || event_id % 10 AS hhmm FROM events WHERE event_id % 4 <> 0")
def map01_observations(spark, d):
    """Observations out of a model's reply."""
    e = table(spark, d, "events", "event_id", "user_id", "event_type").select("event_id", F.expr(_RAW).alias("raw"))
    return replies.observations(e, ["event_id"], "raw").select("event_id", "person", "plats", "confidence", T.time_of(F.col("tid")).alias("hhmm"))


@query(
    """WITH c AS (SELECT event_id, CASE event_type WHEN 'view' THEN 'pending' WHEN 'click' THEN 'approved' ELSE 'rejected' END AS status, value < 90 AS placed, user_id % 3 > 0 AS timed FROM events)
SELECT event_id, CASE WHEN status = 'pending' AND placed AND timed THEN 'approved' ELSE status END AS status, status = 'pending' AND placed AND timed AS inserted FROM c"""
)
def map14_approve(spark, d):
    """Pending candidates with place and time are approved and become observations."""
    s = F.when(F.col("event_type") == "view", "pending").when(F.col("event_type") == "click", "approved").otherwise("rejected")
    go = (F.col("status") == "pending") & (F.col("value") < 90) & (F.col("user_id") % 3 > 0)
    c = table(spark, d, "events", "event_id", "event_type", "value", "user_id").withColumn("status", s).withColumn("inserted", go)
    return state.update_where(c, F.col("inserted"), {"status": F.lit("approved")}).select("event_id", "status", "inserted")


@query(
    """SELECT user_id, lower(event_type) AS place, arg_max(event_id, event_id) AS event_id FROM events GROUP BY user_id, lower(event_type)"""
)
def map13_candidate_upsert(spark, d):
    """Candidates are one per person and place, whatever the case; the last stands."""
    e = table(spark, d, "events", "event_id", "user_id", "event_type").select("user_id", F.lower("event_type").alias("place"), "event_id")
    return state.latest(e, ["user_id", "place"], [F.col("event_id")])


@query(
    """WITH b AS (SELECT user_id AS source, coalesce(CASE WHEN event_id % 5 > 0 THEN event_id % 7 END, 0) AS page, event_id, ts FROM events) SELECT source, nullif(page, 0) AS page, max(event_id) AS event_id FROM b GROUP BY source, page"""
)
def mut38_bookmarks(spark, d):
    """Bookmarks are one per source and page; an unknown page is kept as 0 and shown as null."""
    e = table(spark, d, "events", "event_id", "user_id").select(F.col("user_id").alias("source"), F.coalesce(F.when(F.col("event_id") % 5 > 0, F.col("event_id") % 7), F.lit(0)).alias("page"), "event_id")
    return state.latest(e, ["source", "page"], [F.col("event_id")]).withColumn("page", F.nullif("page", F.lit(0)))


@query("SELECT event_id, event_type, props, (props->>'$.k')::BIGINT AS k FROM events ORDER BY ts DESC, event_id DESC LIMIT 30")
def top09_newest_entries(spark, d):
    """The newest entries with their JSON read (the limit is the feature)."""
    e = table(spark, d, "events", "event_id", "event_type", "props", "ts")
    return e.orderBy(F.desc("ts"), F.desc("event_id")).limit(30).select("event_id", "event_type", "props", F.get_json_object("props", "$.k").cast("long").alias("k"))


@query(
    """WITH l AS (SELECT user_id, event_id, CASE event_type WHEN 'error' THEN 'fel ' || (event_id % 5) END AS msg FROM events), m AS (SELECT user_id, msg, max(event_id) AS last_at FROM l WHERE msg IS NOT NULL GROUP BY ALL),
r AS (SELECT *, row_number() OVER (PARTITION BY user_id ORDER BY last_at DESC) AS n FROM m) SELECT user_id, string_agg(msg, ' | ' ORDER BY last_at) AS reasons FROM r WHERE n <= 3 GROUP BY user_id"""
)
def agg21_failure_reasons(spark, d):
    """The last three different errors of each job."""
    l = table(spark, d, "events", "event_id", "user_id", "event_type").withColumn("line", F.when(F.col("event_type") == "error", F.concat(F.lit("10:00 [error] fel "), (F.col("event_id") % 5).cast("string"))).otherwise("10:00 [info] ok"))
    return replies.error_reasons(l, "user_id", "event_id", "line")


@query("SELECT hex, CASE WHEN hex LIKE '25504446%' THEN '.pdf' WHEN hex LIKE 'FFD8FF%' THEN '.jpg' WHEN hex LIKE '504B0304%' THEN '.zip' ELSE '' END AS extension FROM (SELECT DISTINCT ['255044462D312E37', 'FFD8FFE000104A46', '504B030414000000', '68656A']['0123'[r_regionkey % 4 + 1]::INT + 1] AS hex FROM region)")
def src12_extensions(spark, d):
    """Kinds of files by their first bytes."""
    h = F.element_at(F.array(*[F.lit(x) for x in ("255044462D312E37", "FFD8FFE000104A46", "504B030414000000", "68656A")]), (F.col("r_regionkey") % 4 + 1).cast("int"))
    return table(spark, d, "region", "r_regionkey").select(h.alias("hex")).distinct().select("hex", extension_of(F.unhex("hex")).alias("extension"))


@query("WITH k AS (SELECT pdf_stem, page_num, count(*) AS readings, bool_or(text IS NOT NULL) AS has_text FROM pdf_page_readings GROUP BY ALL), q AS (SELECT pdf_stem, page_num, max(score) AS score FROM quality_pages GROUP BY ALL) SELECT k.pdf_stem, k.page_num, readings, has_text, score, f.normalized_at IS NOT NULL AS normalized FROM k LEFT JOIN q USING (pdf_stem, page_num) LEFT JOIN pdf_files f USING (pdf_stem)")
def etc05_page_view(spark, d):
    """A page with its readings, its score and the state of its file."""
    k = table(spark, d, "pdf_page_readings", "pdf_stem", "page_num", "text").groupBy("pdf_stem", "page_num").agg(F.count(F.lit(1)).alias("readings"), F.bool_or(F.col("text").isNotNull()).alias("has_text"))
    f = table(spark, d, "pdf_files", "pdf_stem", "normalized_at").select("pdf_stem", F.col("normalized_at").isNotNull().alias("normalized"))
    return k.join(page_scores(spark, d).select("pdf_stem", "page_num", "score"), ["pdf_stem", "page_num"], "left").join(f, "pdf_stem", "left")


@query("SELECT pdf_stem FROM pdf_files WHERE NOT (tesseract_done_at IS NOT NULL AND pdf_stem NOT IN (SELECT pdf_stem FROM pdf_page_readings WHERE text IS NOT NULL))")
def etc04_reviewable(spark, d):
    """Documents that weren't removed as duplicates (recognised, but without text)."""
    have = table(spark, d, "pdf_page_readings", "pdf_stem", "text").where("text is not null").select("pdf_stem").distinct().withColumn("has", F.lit(True))
    return table(spark, d, "pdf_files", "pdf_stem", "tesseract_done_at").join(have, "pdf_stem", "left").where(~(F.col("tesseract_done_at").isNotNull() & F.col("has").isNull())).select("pdf_stem")


@query("WITH t AS (SELECT pdf_stem, count(DISTINCT page_num) AS stored, max(page_num) AS total, bool_or(text IS NOT NULL) AS has_text FROM pdf_page_readings GROUP BY 1) SELECT pdf_stem, CASE WHEN NOT has_text THEN 'no text' WHEN stored < total THEN 'pages missing' END AS reason FROM t")
def etc09_fallback_reason(spark, d):
    """Why a document needs recognition again."""
    t = table(spark, d, "pdf_page_readings", "pdf_stem", "page_num", "text").groupBy("pdf_stem").agg(F.count_distinct("page_num").alias("stored"), F.max("page_num").alias("total"), F.bool_or(F.col("text").isNotNull()).alias("has_text"))
    return t.select("pdf_stem", F.when(~F.col("has_text"), "no text").when(F.col("stored") < F.col("total"), "pages missing").alias("reason"))


@query("SELECT max(pdf_stem) FILTER (src = 'wpu') AS last_wpu, count(*) FILTER (src = 'wpu') AS wpu, count(*) FILTER (src = 'files') AS files, count(*) AS n FROM (SELECT *, lower(trim(source)) AS src FROM pdf_files)")
def lkp_file_counts(spark, d):
    """Clean sources counted."""
    f = files(spark, d)
    return f.agg(F.max(F.when(F.col("src") == "wpu", F.col("pdf_stem"))).alias("last_wpu"), F.count_if(F.col("src") == "wpu").alias("wpu"), F.count_if(F.col("src") == "files").alias("files"), F.count(F.lit(1)).alias("n"))


@query("SELECT * FROM pdf_page_readings WHERE id = (SELECT min(id) FROM pdf_page_readings WHERE markdown IS NOT NULL)")
def lkp28_reading(spark, d):
    """One row by key: the filter reaches the scan."""
    r = table(spark, d, "pdf_page_readings")
    first = r.where("markdown is not null").agg(F.min("id").alias("id"))
    return r.join(F.broadcast(first), "id", "left_semi")


@query(f"WITH {_ENT} SELECT typ, count(*) AS n, count(DISTINCT norm) AS names, count(DISTINCT pdf_stem) AS documents FROM ents GROUP BY 1")
def etc48_entity_counts(spark, d):
    from pagewright.operators import graph

    return graph.entities(graph.parsed(table(spark, d, "doc_entities"))).groupBy("typ").agg(F.count(F.lit(1)).alias("n"), F.count_distinct("norm").alias("names"), F.count_distinct("pdf_stem").alias("documents"))


@query("SELECT event_type AS person, count(*) FILTER (event_id % 7 > 0) AS timed, count(*) FILTER (event_id % 7 = 0) AS untimed FROM events GROUP BY 1")
def win07_timeline_classes(spark, d):
    """Observations with and without a readable time."""
    m = T.clock_minutes(F.when(F.col("event_id") % 7 > 0, F.date_format("ts", "HH:mm")))
    return table(spark, d, "events", "event_id", "event_type", "ts").groupBy(F.col("event_type").alias("person")).agg(F.count_if(m.isNotNull()).alias("timed"), F.count_if(m.isNull()).alias("untimed"))


@query("WITH p AS (SELECT DISTINCT n_name AS place FROM nation), a AS (SELECT place, unnest(list_distinct(list_concat([place], list_filter(list_transform(regexp_split_to_array(place, '[/(),]'), lambda x: trim(x)), lambda x: length(x) >= 4)))) AS alias FROM p) SELECT place, alias FROM a")
def map03_aliases(spark, d):
    """Names a place goes by."""
    return geo.aliases(table(spark, d, "nation", "n_name").select(F.col("n_name").alias("place")).distinct(), "place").select("place", "alias")
