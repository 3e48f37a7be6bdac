"""Archive queries over citations, layout, search, graph pictures, map cards and what is shown."""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from pagewright.functions import text as T
from pagewright.operators import archive_state as A
from pagewright.operators import chunk as C
from pagewright.operators import citations, display, forms, geo, graph, layout, retrieval, state
from pagewright.plans.catalog import _EDGES, _ENT, _FILES, _PAGES, _REL, _RES, _SCORED, _TWO, QUERY_TEXT, _edges, _entities, _query_vector, _texts, _vectors, current_pages, files, page_scores, query
from pagewright.session import materialize
from pagewright.sources.tables import table

# ---- citations -------------------------------------------------------------------

_ANSWERS = r"""nrs AS (SELECT pdf_stem AS id, regexp_extract(pdf_stem, '^([A-Z]+\d+-\d+)', 1) AS nr FROM pdf_files), ans AS (SELECT id, nr, 'Se [Nr ' || nr || ', sida 3, 12] och ' || nr || ', sida 7. [samma sida] [Nr ' || substring(nr, 1, length(nr) - 1) || '…] <b>' AS answer FROM nrs WHERE nr <> '')"""


def _answers(spark, d):
    """An answer for each document that cites its number with pages, again, back, and cut."""
    n = table(spark, d, "pdf_files", "pdf_stem").select(F.col("pdf_stem").alias("id"), F.regexp_extract("pdf_stem", r"^([A-Z]+\d+-\d+)", 1).alias("nr")).where("nr <> ''")
    return n.withColumn("answer", F.concat(F.lit("Se [Nr "), "nr", F.lit(", sida 3, 12] och "), "nr", F.lit(", sida 7. [samma sida] [Nr "), F.expr("substring(nr, 1, length(nr) - 1)"), F.lit("…] <b>")))


@query(
    f"""WITH {_ANSWERS} SELECT id, 0 AS place, nr, false AS cut, '3,12' AS pages, '' AS back FROM ans UNION ALL SELECT id, 1, nr, false, '7', '' FROM ans UNION ALL SELECT id, 2, '', false, '', 'sida' FROM ans UNION ALL SELECT id, 3, substring(nr, 1, length(nr) - 1), true, '', '' FROM ans"""
)
def txt26_citations(spark, d):
    """TXT26: the citations of answers: numbers, pages, cut numbers, references back."""
    c = citations.cited(_answers(spark, d), ["id"], "answer")
    return c.select("id", "place", "nr", "cut", F.array_join(F.transform("pages", lambda p: p.cast("string")), ",").alias("pages"), "back")


_MEANT = r"""whole AS (SELECT id, nr, pdf_stem FROM ans JOIN pdf_files ON pdf_stem = nr OR (starts_with(pdf_stem, nr) AND regexp_matches(substring(pdf_stem, length(nr) + 1, 1), '[^\p{L}\p{N}]') AND NOT EXISTS (SELECT 1 FROM pdf_files p WHERE p.pdf_stem = nr)))"""
_CUT = r"""cuts AS (SELECT id, substring(nr, 1, length(nr) - 1) AS nr, min(pdf_stem) AS pdf_stem FROM ans JOIN pdf_files ON starts_with(pdf_stem, substring(nr, 1, length(nr) - 1)) GROUP BY ALL HAVING count(DISTINCT pdf_stem) = 1)"""


@query(
    f"""WITH {_ANSWERS}, {_MEANT}, {_CUT}, u AS (SELECT id, pdf_stem, 3 AS page, nr, 0 AS place FROM whole UNION ALL SELECT id, pdf_stem, NULL, nr, 3 FROM cuts)
SELECT id, pdf_stem || '.txt' AS source, arg_min(coalesce(page, -1), place) AS page, arg_min(nr, place) AS nr, pdf_stem AS titel FROM u GROUP BY id, pdf_stem"""
)
def txt26_sources(spark, d):
    """TXT26, JN13, JN14: the documents each answer cites, by their first citation."""
    got = citations.cited_sources(citations.cited(_answers(spark, d), ["id"], "answer"), table(spark, d, "pdf_files", "pdf_stem").withColumnRenamed("pdf_stem", "stem"), ["id"])
    return got.select("id", "source", F.coalesce("page", F.lit(-1)).alias("page"), "nr", "titel")


@query(f"WITH {_ANSWERS}, {_CUT} SELECT id, nr, pdf_stem AS stem FROM cuts")
def jn14_cut_numbers(spark, d):
    """JN14: cut numbers that only one document begins with."""
    cut = citations.cited(_answers(spark, d), ["id"], "answer").where("cut").select("id", "nr")
    return citations.resolved_cut(cut, table(spark, d, "pdf_files", "pdf_stem").withColumnRenamed("pdf_stem", "stem"))


@query(
    f"""WITH {_ANSWERS}, {_MEANT}, n AS (SELECT id, count(*) AS n FROM whole GROUP BY 1) SELECT a.id, CASE WHEN n > 1 THEN 2 * n ELSE 3 END + CASE WHEN (SELECT count(*) FROM pdf_files WHERE starts_with(pdf_stem, substring(nr, 1, length(nr) - 1))) = 1 THEN 1 ELSE 0 END AS links FROM ans a JOIN n USING (id)"""
)
def txt27_links(spark, d):
    """TXT27, ETC36: how many links an answer's citations become (a reference back takes the last that meant one document)."""
    docs = table(spark, d, "pdf_files", "pdf_stem", "pdf_path").select(F.col("pdf_stem").alias("stem"), F.col("pdf_path").alias("path"))
    return citations.linked(_answers(spark, d), ["id"], "answer", docs).select("id", F.regexp_count("linked", F.lit("<a href=")).alias("links"))


@query(
    """WITH p AS (SELECT pdf_stem, unnest(['downloaded/files/', 'generated/ocr/', 'elsewhere/']) || pdf_stem || CASE WHEN length(pdf_stem) % 2 = 0 THEN '_-_total' ELSE '' END || '.pdf' AS path FROM pdf_files),
k AS (SELECT DISTINCT regexp_replace(path, '^.*/|\\.pdf$', '', 'g') AS nr, regexp_replace(path, '^.*/', 'generated/ocr/') AS path FROM p)
SELECT nr, path FROM k UNION ALL SELECT string_split(nr, '_-_')[1], min(path) FROM k WHERE contains(nr, '_-_') AND string_split(nr, '_-_')[1] NOT IN (SELECT nr FROM k) GROUP BY 1"""
)
def txt29_number_map(spark, d):
    """TXT29: which file each number means: the better folder's, and long names by their beginning."""
    f = table(spark, d, "pdf_files", "pdf_stem")
    tail = F.when(F.length("pdf_stem") % 2 == 0, "_-_total").otherwise("")
    folders = F.explode(F.array(*[F.lit(x) for x in ("downloaded/files/", "generated/ocr/", "elsewhere/")]))
    return citations.number_map(f.select("pdf_stem", folders.alias("d")).select(F.concat("d", "pdf_stem", tail, F.lit(".pdf")).alias("path")))


@query("""SELECT doc_id, list_sort(list_distinct(list_filter(['f' || doc_id || '.txt', source], lambda s: s IS NOT NULL AND s <> ''))) AS s FROM documents""")
def txt28_tool_sources(spark, d):
    """TXT28: the sources a search tool's output names."""
    t = table(spark, d, "documents", "doc_id", "source")
    out = F.concat(F.lit('träff\nsource: "f'), F.col("doc_id").cast("string"), F.lit('.txt"\ntext source: "x"\n'), F.when(F.col("source").isNotNull(), F.concat(F.lit('source: "'), F.col("source"), F.lit('"\nsource: "'), F.col("source"), F.lit('"'))).otherwise(F.lit("source: ")))
    return t.select("doc_id", citations.tool_sources(out).alias("s"))


# ---- layout ----------------------------------------------------------------------

_BLOCKS = f"""{_PAGES}, ln AS (SELECT pdf_stem, page_num, unnest(string_split(text, chr(10))) AS line, generate_subscripts(string_split(text, chr(10)), 1) - 1 AS i FROM pages WHERE text IS NOT NULL),
bl AS (SELECT pdf_stem, page_num, i, trim(regexp_replace(translate(line, '<>&', '   '), '[ \\t\\n\\r\\f\\v]+', ' ', 'g')) AS t, CASE WHEN i = 0 THEN 'PAGE_HEADER' WHEN i % 7 = 3 THEN 'HEADING' WHEN i % 7 = 5 THEN 'LIST_ITEM' WHEN i % 11 = 6 THEN 'PAGE_FOOTER' WHEN i % 13 = 8 THEN 'FOOTNOTE' ELSE 'CODE' END AS kind FROM ln), kept AS (SELECT * FROM bl WHERE t <> '')"""


def _raw_blocks(spark, d):
    """Pages as raw layout: every line a block of HTML, in a mixed-up order with its reading order beside it."""
    t = current_pages(spark, d, "text").where("text is not null")
    line = lambda s: F.trim(F.regexp_replace(F.translate(s, "<>&", "   "), r"[ \t\n\r\f\v]+", " "))
    kind = lambda i: F.when(i == 0, "PageHeader").when(i % 7 == 3, "SectionHeader").when(i % 7 == 5, "ListGroup").when(i % 11 == 6, "PageFooter").when(i % 13 == 8, "Footnote").otherwise("Code")
    tag = lambda s, i: F.when((i % 7 == 3) & (i > 0), F.concat(F.lit("<h3>"), s, F.lit("</h3>"))).otherwise(F.concat(F.lit("<div>"), s, F.lit("</div>")))
    blocks = F.transform(F.split("text", "\n"), lambda s, i: F.struct(kind(i).alias("label"), tag(line(s), i).alias("html"), F.array(F.lit(0), i * 10, F.lit(100), i * 10 + 9).alias("bbox"), i.alias("reading_order")))
    return t.select(*A.PAGE, F.to_json(F.reverse(blocks)).alias("raw"))


@query(f"WITH {_BLOCKS} SELECT pdf_stem, page_num, count(*) AS blocks, string_agg(kind, ',' ORDER BY i) AS kinds, md5(string_agg(t, chr(10) ORDER BY i)) AS text FROM kept GROUP BY ALL")
def lay01_blocks(spark, d):
    """LAY1, LAY2, LAY4, LAY5: raw blocks in reading order, their kinds and the page's text."""
    p = layout.parsed(_raw_blocks(spark, d), A.PAGE, "raw").where(F.size("blocks") > 0)
    return p.select(*A.PAGE, F.size("blocks").alias("blocks"), F.array_join("blocks.kind", ",").alias("kinds"), F.md5(layout.page_text(F.col("blocks"))).alias("text"))


_ESC = r"CASE WHEN regexp_matches(t, '^(#|>|[-*+] |\d+\. |=+\s*$|-+\s*$|([-*_]\s*){3,}$)') THEN '\' || t ELSE t END"


@query(
    f"""WITH {_BLOCKS}, md AS (SELECT *, CASE kind WHEN 'HEADING' THEN '### ' || t WHEN 'LIST_ITEM' THEN '- ' || {_ESC} WHEN 'FOOTNOTE' THEN '*Fotnot:* ' || {_ESC} ELSE rpad('', greatest(3, coalesce(list_max(list_transform(regexp_extract_all(t, '`+'), lambda x: length(x))), 0) + 1)::INT, '`') || chr(10) || t || chr(10) || rpad('', greatest(3, coalesce(list_max(list_transform(regexp_extract_all(t, '`+'), lambda x: length(x))), 0) + 1)::INT, '`') END AS m FROM kept),
h AS (SELECT pdf_stem, page_num, '> Sidhuvud: ' || substring(string_agg(t, ' · ' ORDER BY i), 1, 200) AS head FROM kept WHERE kind = 'PAGE_HEADER' GROUP BY ALL), b AS (SELECT pdf_stem, page_num, string_agg(m, chr(10) || chr(10) ORDER BY i) AS body FROM md WHERE kind NOT IN ('PAGE_HEADER', 'PAGE_FOOTER') GROUP BY ALL)
SELECT pdf_stem, page_num, md5(concat_ws(chr(10) || chr(10), head, body)) AS md FROM h FULL JOIN b USING (pdf_stem, page_num) UNION ALL SELECT DISTINCT pdf_stem, page_num, md5('') FROM kept k WHERE NOT EXISTS (SELECT 1 FROM kept q WHERE q.pdf_stem = k.pdf_stem AND q.page_num = k.page_num AND kind <> 'PAGE_FOOTER')"""
)
def lay06_page_markdown(spark, d):
    """LAY6: a page's blocks as Markdown, headers first, footers left out."""
    p = layout.parsed(_raw_blocks(spark, d), A.PAGE, "raw").where(F.size("blocks") > 0)
    return p.select(*A.PAGE, F.md5(layout.page_markdown(F.col("blocks"))).alias("md"))


@query(
    """SELECT n_nationkey AS id, '| Land | Region |  |' || chr(10) || '| --- | --- | --- |' || chr(10) || '| ' || n_name || ' |  | ' || n_regionkey || ' |' || chr(10) || '|  | a\\|b | ' || n_nationkey || ' |' AS md, 'Land' || chr(9) || 'Region' || chr(10) || n_name || chr(9) || n_regionkey || chr(10) || 'a|b' || chr(9) || n_nationkey AS text FROM nation"""
)
def lay07_table_markdown(spark, d):
    """LAY3, LAY7: HTML tables with spans over rows and columns as text and Markdown."""
    n = table(spark, d, "nation", "n_nationkey", "n_name", "n_regionkey")
    cell = lambda c, more="": F.concat(F.lit(f"<td{more}>"), c.cast("string"), F.lit("</td>"))
    html = F.concat(
        F.lit("<table><tr><th>Land</th><th colspan=2>Region</th></tr><tr>"), F.regexp_replace(cell(F.col("n_name"), " rowspan=2"), "rowspan=2>", 'rowspan="2">'), F.lit(""), F.lit(""),
        F.lit(""), cell(F.col("n_regionkey"), ""), F.lit("</tr><tr><td>a|b</td>"), cell(F.col("n_nationkey")), F.lit("</tr></table>"),
    )
    # The region stands in the third column: its row begins with the country and an empty cell.
    html = F.replace(html, F.concat(F.lit("</td><td>"), F.col("n_regionkey").cast("string"), F.lit("</td></tr><tr>")), F.concat(F.lit("</td><td></td><td>"), F.col("n_regionkey").cast("string"), F.lit("</td></tr><tr>")))
    raw = F.to_json(F.array(F.struct(F.lit("Table").alias("label"), html.alias("html"), F.lit(0).alias("reading_order"))))
    b = layout.parsed(n.select(F.col("n_nationkey").alias("id"), raw.alias("raw")), ["id"], "raw").select("id", F.col("blocks")[0].alias("b"))
    return b.select("id", layout.block_markdown(F.col("b")).alias("md"), F.regexp_replace(F.col("b.text"), "\t\t", "\t").alias("text"))


@query(
    """SELECT n_nationkey AS id, CASE WHEN n_nationkey % 2 = 0 THEN '- **1 Land:** ' || n_name || chr(10) ELSE '' END || '- **Val:**' || chr(10) || '  - [x] ja' || chr(10) || '  - [ ] nej' AS md,
'1 Land: ' || CASE WHEN n_nationkey % 2 = 0 THEN n_name ELSE '' END || chr(10) || 'Val: ' || chr(10) || '☒ ja' || chr(10) || '☐ nej' || chr(10) || 'Tomt: ' AS text FROM nation"""
)
def lay08_form_markdown(spark, d):
    """LAY8, ETC68: fields with a value or a ticked option."""
    n = table(spark, d, "nation", "n_nationkey", "n_name")
    s = lambda v: F.lit(v).cast("string")
    field = lambda number, label, value, ticked: F.struct(s(number).alias("number"), s(label).alias("label"), value.alias("value"), F.lit(ticked).cast("boolean").alias("checked"), F.lit("").alias("source"))
    value = F.when(F.col("n_nationkey") % 2 == 0, F.col("n_name")).otherwise("")
    fields = F.array(field("1", "Land", value, None), field(None, "Val", F.lit(""), None), field(None, "ja", F.lit(""), True), field(None, "nej", F.lit(""), False), field(None, "Tomt", F.lit(""), None))
    return n.select(F.col("n_nationkey").alias("id"), layout.form_markdown(fields).alias("md"), layout.fields_text(fields).alias("text"))


@query(
    """SELECT id, CASE WHEN layout_json LIKE '[%' THEN 300 ELSE CAST(json_extract(layout_json, '$.dpi') AS INT) END AS dpi, CASE WHEN layout_json LIKE '[%' THEN json_array_length(layout_json) ELSE json_array_length(layout_json, '$.blocks') END AS blocks FROM pdf_page_readings WHERE json_valid(layout_json)"""
)
def lay10_stored_layouts(spark, d):
    """LAY9, LAY10: stored layouts read in both forms, and the same when written and read again."""
    r = table(spark, d, "pdf_page_readings", "id", "layout_json").where("layout_json is not null").select("id", layout.from_stored(F.col("layout_json")).alias("l")).where("l is not null")
    again = r.select("id", layout.from_stored(layout.to_stored(F.col("l.blocks"), F.col("l.dpi"))).alias("l"))
    return again.select("id", "l.dpi", F.size("l.blocks").alias("blocks"))


@query(
    f"""WITH {_BLOCKS}, n AS (SELECT pdf_stem, page_num, count(*) AS n, bool_or(contains(t, '[MASKAD]') OR regexp_matches(t, '(?i)\\[\\s*redacted\\s*\\]')) FILTER (i <= 2) AS early FROM kept GROUP BY ALL)
SELECT pdf_stem, page_num, n + CASE WHEN early THEN 0 ELSE 1 END + 1 AS blocks, coalesce(early, false) AS masked_before FROM n"""
)
def lay11_with_redactions(spark, d):
    """LAY11, LAY12: stripes put among blocks, but where a mark stands on that height already (stripes at 20 to 25, whose neighbours reach from 0, and far below)."""
    p = layout.parsed(_raw_blocks(spark, d), A.PAGE, "raw").where(F.size("blocks") > 0)
    stripes = F.array(F.array(F.lit(0), F.lit(25)), F.array(F.lit(10**8), F.lit(10**8 + 5)))
    early = F.exists("blocks", lambda b: layout.has_mask(b["text"]) & (b["bbox"][1] <= 25))
    return p.select(*A.PAGE, F.size(layout.with_redactions(F.col("blocks"), stripes)).alias("blocks"), early.alias("masked_before"))


_FORM = {"name": "kund", "match": ["KUNDBLAD"], "labels": {"01": "Namn", "02": "Telefon", "03": "Segment", "04": "Land"}}


@query(
    """WITH c AS (SELECT c_custkey AS id, c_name, c_mktsegment, c_nationkey FROM customer) SELECT id, '01' AS number, 'Namn' AS label, c_name AS value FROM c UNION ALL SELECT id, '02', 'Telefon', CASE WHEN id % 3 <> 0 THEN '08-' || (100000 + id) ELSE '' END FROM c UNION ALL SELECT id, '03', 'Segment', c_mktsegment FROM c UNION ALL SELECT id, '04', 'Land', '' || c_nationkey FROM c"""
)
def lay13_form_fields(spark, d):
    """LAY13 to LAY19: forms read by place: a value below its label, one below two labels of a row, one on the label's line, one beside it."""
    c = table(spark, d, "customer", "c_custkey", "c_name", "c_mktsegment", "c_nationkey")
    at = lambda text, x0, y0, x1: F.struct(text.alias("text"), F.array(*[F.lit(v) for v in (x0, y0, x1, y0 + 10)]).alias("bbox"))
    phone = F.when(F.col("c_custkey") % 3 != 0, F.concat(F.lit("08-"), (F.col("c_custkey") + 100000).cast("string"))).otherwise("")
    blocks = F.array(
        at(F.lit("KUNDBLAD"), 0, 0, 100), at(F.lit("01 Namn"), 0, 20, 100), at(F.col("c_name"), 0, 31, 100), at(F.lit("02 Telefon"), 200, 20, 300), at(phone, 200, 31, 300),
        at(F.concat(F.lit("03 Segment "), "c_mktsegment"), 0, 100, 190), at(F.lit("04 Land"), 200, 100, 240), at(F.col("c_nationkey").cast("string"), 250, 100, 280), at(F.lit("Fri text utan värde längst ned på sidan."), 0, 300, 300),
    )
    got = forms.form_fields(c.select(F.col("c_custkey").alias("id"), blocks.alias("b")), ["id"], "b", [forms.template(_FORM)])
    return got.select("id", "number", "label", "value")


# ---- search ----------------------------------------------------------------------

_RRF = "u AS (SELECT doc_id, rank, 0 AS l FROM a UNION ALL SELECT doc_id, rank, 1 FROM b), rr AS (SELECT doc_id, round(sum(1 / (61 + rank)), 8) AS score, min((l, rank)) AS o FROM u GROUP BY 1), hy AS (SELECT doc_id, score, row_number() OVER (ORDER BY score DESC, o) - 1 AS rank FROM rr ORDER BY rank LIMIT 20)"


@query(f"WITH {_TWO}, {_RRF} SELECT doc_id, score, rank FROM hy")
def win01_hybrid(spark, d):
    """WIN1: vector and full-text search over the whole tables, fused."""
    return retrieval.hybrid(_texts(spark, d).where("text is not null"), _vectors(spark, d), "doc_id", "text", "embedding", QUERY_TEXT, _query_vector(spark, d), 20)


@query(
    f"""WITH {_TWO}, {_RRF}, tk AS (SELECT h.doc_id, h.rank, text, source, dossier, regexp_extract_all(lower(text), '[0-9a-zåäöéèü]+') AS t FROM hy h JOIN documents USING (doc_id)), sc AS (SELECT *, len(list_filter(['handskriven', 'cykel', 'bageriet'], lambda w: list_contains(t, w))) AS s FROM tk),
top AS (SELECT *, row_number() OVER (ORDER BY s DESC, rank) - 1 AS r FROM sc ORDER BY r LIMIT 6) SELECT doc_id, s AS rescore, r AS rank FROM top"""
)
def top16_search(spark, d):
    """TOP2, TOP3, TOP15 to TOP17: a whole search: limits, both lists, rerank, the best six."""
    mode, _, n = retrieval.policy("x", None, True)
    hits = retrieval.search(_texts(spark, d).where("text is not null"), _vectors(spark, d), "doc_id", "text", "embedding", QUERY_TEXT, _query_vector(spark, d), (mode, 20, n))
    return hits.select("doc_id", F.col("rescore").cast("int").alias("rescore"), "rank")


@query("SELECT doc_id, coalesce(source, '') AS source, doc_id % 7 AS page, CASE WHEN doc_id % 3 = 0 THEN -1 ELSE doc_id % 3 END AS chunk FROM documents")
def win02_hit_keys(spark, d):
    """WIN2: what tells a hit; the first chunk and none are one."""
    t = table(spark, d, "documents", "doc_id", "source")
    key = retrieval.hit_key(F.col("source"), F.col("doc_id") % 7, F.col("doc_id") % 3)
    return t.select("doc_id", key.alias("k")).select("doc_id", "k.source", "k.page", "k.chunk")


@query(f"SELECT doc_id FROM documents WHERE dossier IN (SELECT min(dossier) FROM documents UNION SELECT max(dossier) FROM documents) AND source = (SELECT max(source) FROM documents)")
def flt27_hits_of_stems(spark, d):
    """FLT27, FLT28, ETC49: hits of some documents, and of one source."""
    t = table(spark, d, "documents", "doc_id", "dossier", "source")
    ends = t.agg(F.min("dossier").alias("a"), F.max("dossier").alias("b"), F.max("source").alias("s")).first()
    stems = spark.createDataFrame([(ends["a"],), (ends["b"],)], "pdf_stem string")
    hits = t.where("dossier is not null").withColumn("file", F.concat("dossier", F.lit(".txt")))
    return retrieval.of_stems(hits, stems, "file").where(retrieval.source_is(F.col("source"), ends["s"])).select("doc_id")


@query("SELECT pdf_stem, lower(trim(source)) AS label FROM pdf_files WHERE contains(lower(pdf_stem), 'ua0') OR contains(lower(source), 'wp') ORDER BY pdf_stem LIMIT 50")
def flt19_search_sources(spark, d):
    """FLT19: sources by part of their number or label, 50 at most (the feature's limit)."""
    f = table(spark, d, "pdf_files", "pdf_stem", "source")
    return f.where(F.lower("pdf_stem").contains("ua0") | F.lower("source").contains("wp")).orderBy("pdf_stem").limit(50).select("pdf_stem", F.lower(F.trim("source")).alias("label"))


# ---- graph -----------------------------------------------------------------------

_CENTRES = f"""{_ENT}, nm AS (SELECT DISTINCT lower(n_name) AS name FROM nation UNION SELECT 'berg' UNION SELECT min(namn) FROM ents), kn AS (SELECT typ AS label, norm, min(namn) AS namn FROM ents WHERE typ IN ('person', 'plats', 'organisation') GROUP BY ALL)"""


@query(f"WITH {_CENTRES} SELECT name, arg_min((label, norm, namn), (lower(namn) <> lower(name), length(namn), namn, label, norm))[2] AS norm FROM nm JOIN kn ON contains(lower(namn), lower(name)) GROUP BY name")
def jn15_centres(spark, d):
    """JN15: names in answers to entities: the same name, else the shortest that holds it."""
    e = _entities(spark, d)
    first = e.agg(F.min("namn").alias("name"))
    names = table(spark, d, "nation", "n_name").select(F.lower("n_name").alias("name")).unionByName(spark.createDataFrame([("berg",)], "name string")).unionByName(first)
    return graph.centres_of(names, e).select("name", "norm")


_PICTURE = f"""{_ENT}, {_RES}, {_REL}, {_EDGES}, cc AS (SELECT min(src) AS norm FROM edges), rl AS (SELECT src AS s, src_label AS sl, dst AS e, dst_label AS el, rel FROM edges, cc WHERE src = norm OR dst = norm), dc AS (SELECT DISTINCT pdf_stem AS stem FROM ents e, cc WHERE e.norm = cc.norm)"""


def _picture(spark, d):
    edges = materialize(_edges(spark, d), "edges")
    c = edges.agg(F.min("src").alias("norm"))
    rels = edges.join(F.broadcast(c), (F.col("src") == F.col("norm")) | (F.col("dst") == F.col("norm")))
    rels = rels.select(F.col("src").alias("s_norm"), F.col("src").alias("s_namn"), F.col("src_label").alias("s_label"), F.col("dst").alias("e_norm"), F.col("dst").alias("e_namn"), F.col("dst_label").alias("e_label"), F.col("rel").alias("typ"))
    docs = _entities(spark, d).join(F.broadcast(c), "norm").select(F.col("pdf_stem").alias("stem"), F.lit(None).cast("string").alias("nr"), F.lit(None).cast("string").alias("titel"), F.col("norm").alias("centre")).distinct()
    return graph.elements(c.select("norm", F.col("norm").alias("namn"), F.lit("person").alias("label")), rels, docs)


@query(
    f"""WITH {_PICTURE}, nd AS (SELECT norm AS id, norm AS shown, 0 AS o FROM cc UNION ALL SELECT s, s, 1 FROM rl UNION ALL SELECT e, e, 1 FROM rl UNION ALL SELECT 'doc:' || stem, stem, 2 FROM dc)
SELECT id, CASE WHEN min(o) = 0 THEN '★ ' ELSE '' END || CASE WHEN length(any_value(shown)) > 45 THEN substring(any_value(shown), 1, 44) || '…' ELSE any_value(shown) END AS name FROM nd WHERE id IS NOT NULL GROUP BY id"""
)
def gr12_nodes(spark, d):
    """GR12, AGG14, ETC22: the nodes around one entity as they are drawn."""
    return _picture(spark, d)[0].where("id is not null").select("id", "name")


@query(f"""WITH {_PICTURE}, ed AS (SELECT s AS source, e AS target, rel FROM rl UNION ALL SELECT 'doc:' || stem, norm, 'nämner' FROM dc, cc) SELECT source, target, CASE WHEN count(*) > 1 THEN rel || ' (×' || count(*) || ')' ELSE rel END AS name FROM ed GROUP BY source, target, rel""")
def gr12_edges(spark, d):
    """GR12, SET10: the edges around one entity, with how many there are."""
    return _picture(spark, d)[1]


@query(f"WITH {_ENT} SELECT DISTINCT lower(namn) AS key, pdf_stem FROM ents")
def agg08_entity_stems(spark, d):
    """AGG8: which documents hold each name."""
    return graph.stems_by_entity(_entities(spark, d))


_LIVE = f"""{_ENT}, {_RES}, {_REL}, {_EDGES}, live AS (SELECT *, CASE WHEN page_num % 3 = 0 THEN NULL ELSE 'sync' END AS owner FROM edges WHERE page_num % 2 = 1 UNION ALL SELECT *, 'sync' FROM edges WHERE page_num % 5 = 1)"""


def _live(edges):
    one = edges.where("page_num % 2 = 1").withColumn("owner", F.when(F.col("page_num") % 3 != 0, "sync"))
    return one.unionByName(edges.where("page_num % 5 = 1").withColumn("owner", F.lit("sync")))


_KEY = ["pdf_stem", "page_num", "rel", "src_label", "src", "dst_label", "dst"]


@query(
    f"""WITH {_LIVE}, v AS (SELECT * EXCLUDE (owner) FROM live WHERE owner IS NOT NULL) SELECT (SELECT count(*) FROM (SELECT * FROM edges EXCEPT SELECT * FROM v)) AS missing, (SELECT count(*) FROM (SELECT * FROM v EXCEPT SELECT * FROM edges)) AS surplus,
(SELECT count(*) FROM v) - (SELECT count(*) FROM (SELECT DISTINCT * FROM v)) AS duplicates, (SELECT count(*) FROM live WHERE owner IS NULL) AS legacy"""
)
def set01_comparison(spark, d):
    """SET1 to SET4: wanted against live relations, with duplicates and edges of no owner."""
    e = materialize(_edges(spark, d), "edges")
    return graph.comparison(e, _live(e), _KEY)


@query(f"WITH {_LIVE} SELECT pdf_stem, page_num, rel, src, dst, owner FROM live WHERE coalesce(owner, '') <> 'sync' AND owner IS NOT NULL UNION SELECT pdf_stem, page_num, rel, src, dst, 'sync' FROM edges")
def set05_replaced(spark, d):
    """SET5: the live edges of one owner replaced by the wanted ones."""
    e = materialize(_edges(spark, d), "edges")
    return graph.replaced(_live(e).select(*_KEY, "owner"), e.select(*_KEY), "sync").select("pdf_stem", "page_num", "rel", "src", "dst", "owner").distinct()


@query(f"WITH {_ENT}, {_RES}, {_REL}, {_EDGES} SELECT DISTINCT norm FROM res WHERE typ IN ('person', 'plats', 'organisation') AND norm NOT IN (SELECT src FROM edges UNION SELECT dst FROM edges)")
def set05_orphans(spark, d):
    """SET5: nodes that no relation touches."""
    p = graph.parsed(table(spark, d, "doc_entities"))
    e = graph.entities(p)
    return graph.orphan_nodes(graph.mentions(e).select("norm").distinct(), graph.relation_edges(e, graph.relations(p)))


@query("SELECT pdf_stem, pdf_stem AS nr, '' AS titel FROM pdf_files WHERE length(pdf_stem) <= 40")
def gr07_document_fields(spark, d):
    """GR7: number and title in a document's name."""
    f = table(spark, d, "pdf_files", "pdf_stem").where(F.length("pdf_stem") <= 40)
    return f.select("pdf_stem", graph.document_fields(F.col("pdf_stem")).alias("f")).select("pdf_stem", "f.nr", "f.titel")


# ---- pages and documents ---------------------------------------------------------


@query(f"WITH {_PAGES} SELECT p.pdf_stem, p.page_num FROM pages p WHERE len(regexp_extract_all(text, '[\\p{{L}}\\p{{N}}]')) >= 100 AND NOT EXISTS (SELECT 1 FROM doc_entities e WHERE e.pdf_stem = p.pdf_stem AND e.page_num = p.page_num) AND NOT EXISTS (SELECT 1 FROM quality_pages q WHERE q.pdf_stem = p.pdf_stem AND q.page_num = p.page_num AND q.score < 40)")
def flt05_pages_for_places(spark, d):
    """FLT5: pages with enough text, neither extracted nor with a candidate yet."""
    p = current_pages(spark, d, "text").where(T.alnum_count(F.col("text")) >= 100).select(*A.PAGE)
    return p.join(table(spark, d, "doc_entities", *A.PAGE), A.PAGE, "left_anti").join(table(spark, d, "quality_pages", *A.PAGE, "score").where("score < 40"), A.PAGE, "left_anti")


@query(f"WITH {_SCORED} SELECT pdf_stem, page_num, row_number() OVER (PARTITION BY pdf_stem ORDER BY page_num) AS place FROM scored WHERE score < 60 AND coalesce(image_page, 0) = 0")
def flt07_redo_pages(spark, d):
    """FLT7, ETC10: pages to be read anew, in order within their documents."""
    bad = page_scores(spark, d).where("score < 60 and coalesce(image_page, 0) = 0")
    return bad.select(*A.PAGE, F.row_number().over(Window.partitionBy("pdf_stem").orderBy("page_num")).alias("place"))


@query(f"WITH {_FILES} SELECT w.pdf_stem, w.merged_at AS decided_at, f.pdf_stem IS NOT NULL AS known, f.tesseract_done_at FROM (SELECT pdf_stem, merged_at FROM files WHERE merged_at IS NOT NULL UNION ALL SELECT 'borta-' || pdf_stem, merged_at FROM files WHERE src = 'wpu' AND merged_at IS NOT NULL) w LEFT JOIN files f USING (pdf_stem)")
def jn04_decisions_with_files(spark, d):
    """JN4: decided documents with what is known of their files, unknown ones too."""
    f = files(spark, d)
    w = f.where("merged_at is not null").select("pdf_stem", "merged_at", "src")
    w = w.select("pdf_stem", "merged_at").unionByName(w.where("src = 'wpu'").select(F.concat(F.lit("borta-"), "pdf_stem").alias("pdf_stem"), "merged_at"))
    j = w.withColumnRenamed("merged_at", "decided_at").join(f.select("pdf_stem", F.lit(True).alias("known"), "tesseract_done_at"), "pdf_stem", "left")
    return j.select("pdf_stem", "decided_at", F.coalesce("known", F.lit(False)).alias("known"), "tesseract_done_at")


@query(
    f"""WITH n AS (SELECT pdf_stem, max(page_num) AS n FROM pdf_page_readings GROUP BY 1), a AS (SELECT pdf_stem, unnest(generate_series(1, n)) AS page_num FROM n), r AS (SELECT DISTINCT pdf_stem, page_num FROM pdf_page_readings WHERE replace(lower(trim(engine)), '_', '-') = 'llm-vision')
SELECT pdf_stem, page_num FROM a WHERE NOT EXISTS (SELECT 1 FROM r WHERE r.pdf_stem = a.pdf_stem AND r.page_num = a.page_num)"""
)
def jn11_document_pages(spark, d):
    """JN11: of every document the pages an engine hasn't read."""
    r = table(spark, d, "pdf_page_readings", *A.PAGE, "engine")
    every = r.groupBy("pdf_stem").agg(F.max("page_num").alias("n")).select("pdf_stem", F.explode(F.sequence(F.lit(1), F.col("n"))).alias("page_num"))
    done = r.where(F.replace(F.lower(F.trim("engine")), F.lit("_"), F.lit("-")) == "llm-vision").select(*A.PAGE)
    return every.join(done, A.PAGE, "left_anti")


@query(f"WITH {_SCORED}, {_FILES} SELECT s.pdf_stem, s.page_num, score, CASE WHEN src IN ('files', 'wpu') THEN src ELSE '?' END AS source FROM scored s LEFT JOIN files f USING (pdf_stem)")
def agg02_scores_by_source(spark, d):
    """AGG2: page scores with their source, '?' where it isn't known."""
    f = files(spark, d).select("pdf_stem", "src")
    return page_scores(spark, d).join(f, "pdf_stem", "left").select(*A.PAGE, "score", F.when(F.col("src").isin("files", "wpu"), F.col("src")).otherwise("?").alias("source"))


@query("SELECT source, min(doc_id) AS first, count(*) AS n, min(doc_id) AS head FROM documents WHERE lang = 'sv' AND source IS NOT NULL GROUP BY source")
def agg13_grouped_hits(spark, d):
    """AGG13: hits by source, in the order in which sources come first."""
    t = table(spark, d, "documents", "doc_id", "source", "lang").where("lang = 'sv' and source is not null")
    return citations.merged_hits(t, "source", "doc_id").select("source", "first", F.size("hits").alias("n"), F.col("hits")[0].alias("head"))


@query(
    f"""WITH {_PAGES} SELECT id, md5(regexp_replace(regexp_replace(replace(replace(replace(replace(replace(replace(replace(markdown, 'ﬁ', 'fi'), 'ﬂ', 'fl'), 'ﬀ', 'ff'), chr(173), ''), chr(65279), ''), chr(13) || chr(10), chr(10)), chr(13), chr(10)), '[\\x00-\\x08\\x0b\\x0e-\\x1f\\x7f]', '', 'g'), '\\n{{3,}}', chr(10) || chr(10), 'g')) AS h FROM pages WHERE markdown IS NOT NULL"""
)
def txt03_normalize_markdown(spark, d):
    """TXT3: Markdown cleaned by characters alone."""
    return current_pages(spark, d, "markdown").where("markdown is not null").select("id", F.md5(T.normalize_markdown(F.col("markdown"))).alias("h"))


@query(f"WITH {_PAGES} SELECT id, text IS NOT NULL AND id % 2 = 0 AS fresh FROM pages")
def txt04_markdown_fresh(spark, d):
    """TXT4: whether Markdown still belongs to its page (here the pages of odd readings were changed)."""
    p = current_pages(spark, d, "text")
    now = F.when(F.col("id") % 2 == 0, T.normalize_text(F.col("text"))).otherwise(F.concat(T.normalize_text(F.coalesce("text", F.lit(""))), F.lit(" ändrad")))
    return p.select("id", T.markdown_is_fresh(F.col("text"), now).alias("fresh"))


@query(
    r"""WITH h AS (SELECT doc_id, text, instr(lower(text), 'vittnet') AS a, instr(lower(text), 'och') AS b FROM documents), p AS (SELECT doc_id, text, CASE WHEN a > 0 THEN a - 1 WHEN b > 0 THEN b - 1 ELSE 0 END AS at_, CASE WHEN a > 0 THEN 7 WHEN b > 0 THEN 3 ELSE 0 END AS n FROM h),
c AS (SELECT doc_id, text, greatest(0, at_ - 180) AS s, least(length(text), at_ + n + 180) AS e FROM p) SELECT doc_id, CASE WHEN coalesce(text, '') = '' THEN 'Källtext saknas.' ELSE CASE WHEN s > 0 THEN '…' ELSE '' END || regexp_replace(substring(text, s::INT + 1, (e - s)::INT), '^\s+|\s+$', '', 'g') || CASE WHEN e < length(text) THEN '…' ELSE '' END END AS x FROM c"""
)
def txt21_excerpts(spark, d):
    """TXT21: what stands around a piece of evidence, else around a name."""
    return table(spark, d, "documents", "doc_id", "text").select("doc_id", display.excerpt(F.col("text"), [F.lit(" Vittnet "), F.lit("och")]).alias("x"))


@query(
    f"""WITH {_TWO} SELECT md5('Ämne att jämföra källorna kring: cykeln' || chr(10) || chr(10) || 'Utdrag ur arkivet:' || chr(10) || chr(10) || string_agg('[Nr ' || doc_id || ', sida 1, "' || substring(coalesce(dossier, ''), 1, 60) || '"]' || chr(10) || text, chr(10) || chr(10) || '---' || chr(10) || chr(10) ORDER BY rank)) AS prompt FROM b JOIN documents USING (doc_id)"""
)
def txt23_compare_prompt(spark, d):
    """TXT23, TXT25: hits as the text a comparison is asked of."""
    hits = _texts(spark, d).join(F.broadcast(retrieval.ranked(retrieval.bm25(_texts(spark, d), "doc_id", "text", QUERY_TEXT, 20), F.desc("score"), "doc_id").select("doc_id", "rank")), "doc_id")
    ctx = display.joined_hits(hits, "rank", display.hit_block(F.col("doc_id"), F.lit(1), F.col("dossier"), F.col("text")))
    return ctx.select(F.md5(display.compare_prompt("cykeln", F.col("context"))).alias("prompt"))


@query(
    r"""WITH t AS (SELECT doc_id, trim(regexp_replace(text, '[ \t\n\r\f\v]+', ' ', 'g')) AS t FROM documents WHERE text IS NOT NULL), h AS (SELECT doc_id, CASE WHEN t = '' THEN 'Sparat svar' ELSE t END AS t FROM t WHERE t <> ''), c AS (SELECT doc_id, t, substring(t, 1, 69) AS s FROM h),
k AS (SELECT doc_id, t, s, regexp_replace(CASE WHEN contains(s, ' ') THEN regexp_replace(s, ' [^ ]*$', '') ELSE s END, '[.,;: ]+$', '') AS k FROM c) SELECT doc_id, CASE WHEN length(t) <= 72 THEN t ELSE coalesce(nullif(k, ''), s) || '...' END AS title FROM k"""
)
def txt30_entry_titles(spark, d):
    """TXT30: titles of saved answers, cut at a word."""
    t = table(spark, d, "documents", "doc_id", "text").where("text is not null").where(F.trim(F.regexp_replace("text", r"[ \t\n\r\f\v]+", " ")) != "")
    return t.select("doc_id", display.entry_title(F.lit(" ").substr(1, 0), F.regexp_replace("text", r"[ \t\n\r\f\v]+", " ")).alias("title"))


@query("SELECT doc_id, len(string_split(text, chr(10))) AS pages, coalesce(list_extract(string_split(text, chr(10)), 2), '-') AS second FROM documents WHERE text IS NOT NULL")
def etc01_file_pages(spark, d):
    """ETC1, ETC2: the number of a document's pages and one of them (line feeds part pages here)."""
    t = table(spark, d, "documents", "doc_id", "text").where("text is not null").withColumn("text", F.translate("text", "\f\n", " \f"))
    return t.select("doc_id", display.page_count(F.col("text")).alias("pages"), F.coalesce(display.page_at(F.col("text"), F.lit(2)), F.lit("-")).alias("second"))


@query("SELECT pdf_stem, pdf_stem || ' — ' || coalesce(has_redactions, 0) || ' maskeringar på ' || coalesce(has_redactions, 0) || CASE WHEN has_redactions = 1 THEN ' sida' ELSE ' sidor' END AS label FROM pdf_files")
def etc08_labels(spark, d):
    """ETC7, ETC8: documents with how much is blacked out."""
    n = F.col("has_redactions")
    return table(spark, d, "pdf_files", "pdf_stem", "has_redactions").select("pdf_stem", display.masks_label(F.col("pdf_stem"), n, n).alias("label"))


@query("SELECT doc_id, coalesce(dossier, source, 'Källa') || CASE WHEN doc_id % 5 <> 0 THEN ', sida ' || doc_id % 5 ELSE '' END AS title, CASE WHEN doc_id % 5 <> 0 THEN doc_id % 5 END AS page, coalesce(dossier, source, '') AS marked FROM documents")
def etc37_titles(spark, d):
    """ETC37, ETC38: a source's title and its bookmark."""
    t = table(spark, d, "documents", "doc_id", "dossier", "source")
    page = F.col("doc_id") % 5
    b = display.bookmark(F.col("source"), page, F.lit(None).cast("string"), F.col("dossier"))
    return t.select("doc_id", display.source_title(F.col("dossier"), F.col("source"), page).alias("title"), b["page"].alias("page"), b["title"].alias("marked"))


@query("SELECT id, coalesce(len(regexp_extract_all(text, '[^ \\t\\n\\r\\f\\v]')) > 200, false) AS had FROM pdf_page_readings")
def etc34_had_text(spark, d):
    """ETC34: whether a text layer holds enough."""
    return table(spark, d, "pdf_page_readings", "id", "text").select("id", display.had_text(F.col("text")).alias("had"))


@query("SELECT event_id, CASE WHEN user_id % 5 > 0 THEN least(1.0, event_id % 8 / (user_id % 5)) END AS done FROM events")
def txt34_fractions(spark, d):
    """TXT34: how much of a job is done, null where its size isn't known."""
    e = table(spark, d, "events", "event_id", "user_id")
    return e.select("event_id", display.fraction(F.col("event_id") % 8, F.col("user_id") % 5).alias("done"))


# ---- maps ------------------------------------------------------------------------

_OBS = "ob AS (SELECT event_id AS id, 'P<' || user_id || '>' AS person, CASE WHEN event_id % 4 <> 0 THEN strftime(ts, '%H:%M') END AS time, CASE WHEN event_id % 3 <> 0 THEN 'E' || user_id END AS nr, CASE WHEN event_id % 5 <> 0 THEN event_id % 9 + 1 END AS sida, CASE WHEN event_id % 6 = 0 THEN 'sen & trött' END AS note, event_id % 700 / 100 + 55 AS lat, event_id % 300 / 100 + 11 AS lon FROM events)"


def _obs(spark, d):
    e = table(spark, d, "events", "event_id", "user_id", "ts", "value")
    u = F.col("user_id").cast("string")
    return e.select(
        F.col("event_id").alias("id"), F.concat(F.lit("P<"), u, F.lit(">")).alias("person"), F.when(F.col("event_id") % 4 != 0, F.date_format("ts", "HH:mm")).alias("time"), F.when(F.col("event_id") % 3 != 0, F.concat(F.lit("E"), u)).alias("nr"),
        F.when(F.col("event_id") % 5 != 0, F.col("event_id") % 9 + 1).alias("sida"), F.when(F.col("event_id") % 6 == 0, "sen & trött").alias("note"), (F.col("event_id") % 700 / 100 + 55).alias("lat"), (F.col("event_id") % 300 / 100 + 11).alias("lon"),
    )


@query(
    f"""WITH {_OBS} SELECT id, '<strong>' || replace(replace(person, '<', '&lt;'), '>', '&gt;') || '</strong><br>Okänd plats<br>kl ' || coalesce(time, 'okänd tid') || '<br>' || CASE WHEN nr IS NOT NULL AND sida IS NOT NULL THEN '[Nr ' || nr || ', sida ' || sida || ']' ELSE '[källa saknas]' END || CASE WHEN note IS NOT NULL THEN '<br><em>sen &amp; trött</em>' ELSE '' END AS popup,
strftime(TIMESTAMP '1986-02-28 00:00:00' + to_minutes((CASE WHEN CAST(time[1:2] AS INT) < 12 THEN 24 + CAST(time[1:2] AS INT) ELSE CAST(time[1:2] AS INT) END * 60 + CAST(time[4:5] AS INT))::BIGINT), '%Y-%m-%dT%H:%M:%S') AS at_time FROM ob"""
)
def map06_popups(spark, d):
    """MAP6, MAP10: what an observation shows, and its instant on the timeline."""
    none = F.lit(None).cast("string")
    o = _obs(spark, d)
    return o.select("id", geo.popup(F.col("person"), none, F.col("time"), none, F.col("nr"), F.col("sida"), F.col("note")).alias("popup"), geo.iso_time(F.col("time")).alias("at_time"))


@query(f"WITH {_OBS} SELECT id, lon, lat, 'Point' AS kind FROM ob WHERE time IS NOT NULL")
def map08_points(spark, d):
    """MAP8: observations with a time as GeoJSON points."""
    o = _obs(spark, d).where("time is not null")
    j = o.select("id", geo.point(F.col("lat"), F.col("lon"), F.col("time"), F.col("person"), F.lit("#123456")).alias("j"))
    g = F.from_json("j", "struct<geometry:struct<type:string,coordinates:array<double>>>")["geometry"]
    return j.select("id", g["coordinates"][0].alias("lon"), g["coordinates"][1].alias("lat"), g["type"].alias("kind"))


@query(f"WITH {_OBS} SELECT id, nr || '.txt' AS source, sida AS page, nr, person AS title FROM ob WHERE nr IS NOT NULL AND sida IS NOT NULL")
def map12_source_cards(spark, d):
    """MAP12, SET11, ETC32: cards of observations' sources, each text once."""
    o = _obs(spark, d).withColumn("card", geo.source_card(F.col("nr"), F.col("sida"), F.col("nr"), F.lit(None).cast("string"), F.col("person")))
    return geo.source_cards(o.unionByName(o), ["id"], "card")


@query(
    """WITH o AS (SELECT c_custkey AS id, lower(c_mktsegment) AS plats FROM customer WHERE c_custkey % 7 <> 0 UNION ALL SELECT n_nationkey + 1000000, lower(n_name) FROM nation)
SELECT id, CASE id % 3 WHEN 0 THEN '21:05' WHEN 1 THEN '09:30' END AS time, CASE id % 3 WHEN 0 THEN 'ungefär' WHEN 2 THEN 'sent' END AS uncertainty, n.n_name AS place_name, CASE WHEN n.n_name IS NULL THEN 'none' ELSE 'exact' END AS place_match, CASE WHEN id % 2 = 0 THEN 'high' ELSE 'medium' END AS confidence FROM o LEFT JOIN nation n ON lower(n.n_name) = plats"""
)
def map04_candidates(spark, d):
    """MAP4: observations as candidates: time, doubt, place."""
    c = table(spark, d, "customer", "c_custkey", "c_mktsegment").select(F.col("c_custkey").cast("long").alias("id"), F.when(F.col("c_custkey") % 7 != 0, F.lower("c_mktsegment")).alias("plats"))
    n = table(spark, d, "nation", "n_nationkey", "n_name")
    o = c.unionByName(n.select((F.col("n_nationkey") + 1000000).cast("long").alias("id"), F.lower("n_name").alias("plats")))
    tid = F.when(F.col("id") % 3 == 0, "ungefär kl. 21.05").when(F.col("id") % 3 == 1, "09:30").otherwise("sent")
    o = o.select("id", "plats", F.lit("P").alias("person"), F.lit("citat").alias("citat"), tid.alias("tid"), F.when(F.col("id") % 2 == 0, "high").otherwise("säker").alias("confidence"))
    places = n.select(F.col("n_name").alias("name"), F.lit(1.0).alias("lat"), F.lit(2.0).alias("lon"))
    return geo.candidates(o, places, exact_ratio=False).select("id", "time", "uncertainty", "place_name", "place_match", "confidence")


@query("SELECT event_id AS id, CASE WHEN event_id % 2 = 0 THEN NULL ELSE 59.0 END AS lat, CASE WHEN event_id % 3 = 0 THEN NULL ELSE 'x' END AS time, CASE WHEN event_id % 5 = 0 THEN 3.0 WHEN event_id % 7 = 0 THEN 2.0 ELSE 1.0 END AS form_lat FROM events")
def map11_review_payloads(spark, d):
    """MAP11, ETC31, ETC33: default coordinates are no finding, a blank time is none, and where a form begins."""
    e = table(spark, d, "events", "event_id")
    n = F.col("event_id")
    lat, lon = F.lit(59.0), F.lit(18.0)
    kept = geo.without_default(lat, lon, F.lit(None).cast("double"), F.lit(None).cast("double"), F.when(n % 2 == 0, "none").otherwise("exact"), (59.0, 18.0))
    at = lambda v: F.struct(F.lit(v).alias("lat"), F.lit(v).alias("lon"))
    form = geo.form_defaults(at(1.0), F.when(n % 7 == 0, at(2.0)), at(3.0), n % 5 == 0)
    return e.select(n.alias("id"), kept["lat"].alias("lat"), geo.time_or_null(F.when(n % 3 == 0, " ").otherwise("x")).alias("time"), form["lat"].alias("form_lat"))


# ---- runs ------------------------------------------------------------------------


@query(
    f"""WITH {_PAGES}, ix AS (SELECT pdf_stem, min(id) AS mtime FROM pages WHERE {'length(pdf_stem)'} % 3 <> 0 GROUP BY 1), ds AS (SELECT pdf_stem, max(id) AS mtime FROM pages GROUP BY 1) SELECT ds.pdf_stem, CASE WHEN ix.mtime IS NULL THEN 'new' WHEN ds.mtime > ix.mtime THEN 'reingest' ELSE 'skip' END AS action FROM ds LEFT JOIN ix USING (pdf_stem)"""
)
def mut22_ingest_plan(spark, d):
    """MUT22, MUT25, SRC3, ETC51: what an ingest run does with every document, by what is indexed of it."""
    p = current_pages(spark, d)
    index = p.where(F.length("pdf_stem") % 3 != 0).groupBy("pdf_stem").agg(F.min("id").cast("double").alias("mtime"))
    disk = p.groupBy("pdf_stem").agg(F.max("id").cast("double").alias("mtime"))
    j = disk.withColumnRenamed("mtime", "disk").join(index.withColumnRenamed("mtime", "stored"), "pdf_stem", "left")
    return j.select("pdf_stem", state.index_action(F.col("stored").isNotNull(), F.col("stored"), F.col("disk"), F.lit(None).cast("double"), F.lit(False)).alias("action"))


@query("WITH n AS (SELECT pdf_stem, text_mtime, row_number() OVER (ORDER BY pdf_stem) % 3 AS k FROM pdf_files) SELECT pdf_stem FROM pdf_files WHERE normalized_at IS NULL OR text_mtime IS NULL OR text_mtime + length(pdf_stem) % 3 > text_mtime + 1")
def mut23_normalize_plan(spark, d):
    """MUT23: documents whose text is to be cleaned: never, without a time, or changed by more than a second since."""
    f = table(spark, d, "pdf_files", "pdf_stem", "normalized_at", "text_mtime").withColumn("disk", F.col("text_mtime") + F.length("pdf_stem") % 3)
    return f.where(F.col("normalized_at").isNull() | F.col("text_mtime").isNull() | (F.col("disk") > F.col("text_mtime") + 1)).select("pdf_stem")


@query("SELECT pdf_stem, max(m) AS mtime FROM (SELECT pdf_stem, text_mtime AS m FROM pdf_files WHERE text_mtime IS NOT NULL UNION ALL SELECT pdf_stem, text_mtime + 5 FROM pdf_files WHERE text_mtime IS NOT NULL AND length(pdf_stem) % 2 = 0) GROUP BY 1")
def etc52_unusable(spark, d):
    """ETC52, ETC53: times of documents that gave no chunk, the newer kept."""
    f = table(spark, d, "pdf_files", "pdf_stem", "text_mtime").where("text_mtime is not null").withColumnRenamed("text_mtime", "mtime")
    new = f.where(F.length("pdf_stem") % 2 == 0).withColumn("mtime", F.col("mtime") + 5)
    return f.unionByName(new).groupBy("pdf_stem").agg(F.max("mtime").alias("mtime"))


@query(f"WITH {_SCORED} SELECT pdf_stem, round(sum(score), 1) AS score, count(*) AS n_pages, count(*) FILTER (coalesce(image_page, 0) = 1) AS images FROM scored WHERE length(pdf_stem) % 2 = 0 GROUP BY 1")
def jn18_quality_run(spark, d):
    """JN18, ETC14: scores of a part of the documents from their pages."""
    s = page_scores(spark, d).where(F.length("pdf_stem") % 2 == 0)
    return s.groupBy("pdf_stem").agg(F.round(F.sum("score"), 1).alias("score"), F.count(F.lit(1)).alias("n_pages"), F.count_if(F.coalesce("image_page", F.lit(0)) == 1).alias("images"))


@query("SELECT vec_id, vec_id % 10 <> 3 AS usable FROM embeddings")
def chk17_vectors(spark, d):
    """CHK17: vectors that may be indexed: no value missing or infinite, not all zero (every tenth is spoilt here)."""
    v = table(spark, d, "embeddings", "vec_id", "embedding")
    n = F.floor(F.col("vec_id") / 10) % 3
    spoilt = F.when(n == 0, F.transform("embedding", lambda x: F.lit(0.0).cast("float"))).when(n == 1, F.transform("embedding", lambda x, i: F.when(i == 5, F.lit(float("nan"))).otherwise(x).cast("float"))).otherwise(F.transform("embedding", lambda x, i: F.when(i == 5, F.lit(float("inf"))).otherwise(x).cast("float")))
    return v.select("vec_id", C.vector_ok(F.when(F.col("vec_id") % 10 == 3, spoilt).otherwise(F.col("embedding"))).alias("usable"))


@query(f"WITH {_PAGES} SELECT p.id, q.score IS NOT NULL AS scored FROM pages p LEFT JOIN (SELECT pdf_stem, page_num, max(score) AS score FROM quality_pages GROUP BY ALL) q USING (pdf_stem, page_num)")
def etc17_before_after(spark, d):
    """ETC17: scores before and after, side by side."""
    p = current_pages(spark, d)
    return p.join(page_scores(spark, d), A.PAGE, "left").select("id", F.col("score").isNotNull().alias("scored"))
