"""Queries of the text operators over the archive's tables, and their SQL."""

from __future__ import annotations

import os
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from pagewright.llm.leakage import leaked_passages
from pagewright.llm.names import link_names
from pagewright.llm.near_dup import Forest
from pagewright.llm.packing import CAPACITY, fill_containers, token_counts
from pagewright.llm.pii import personal_information, redacted
from pagewright.llm.representative import choose_bundles, merged_records
from pagewright.llm.scan_repair import learn, scan_repair
from pagewright.llm.spam import spam_pages
from pagewright.llm.split import split_items
from pagewright.llm.text_stats import page_statistics, quality_statistics
from pagewright.session import materialize
from pagewright.sources.tables import table

#: A public tokenizer's vocabulary file, the same path on every machine.
TOKENIZER = os.environ.get("PAGEWRIGHT_TOKENIZER", "/opt/tokenizers/piece_bpe_32k.model")

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLE: dict[str, str] = {}


def query(fn: Callable[[SparkSession, str], DataFrame]) -> Callable[[SparkSession, str], DataFrame]:
    QUERIES[fn.__name__] = fn
    return fn


# ---- 1: text quality -------------------------------------------------------------


@query
def p1_found(spark: SparkSession, folder: str) -> DataFrame:
    """Readings that aren't mainly running prose or dialogue."""
    return quality_statistics(table(spark, folder, "pdf_page_readings", "id", "text")).where(~F.col("is_prose")).select("id").distinct()


@query
def p1_statistics(spark: SparkSession, folder: str) -> DataFrame:
    """Statistics of every reading beside the latest stored page score and character count."""
    readings = table(spark, folder, "pdf_page_readings", "id", "pdf_stem", "page_num", "text")
    stored = (
        table(spark, folder, "quality_pages", "pdf_stem", "page_num", "score", "chars", "scored_at")
        .groupBy("pdf_stem", "page_num")
        .agg(F.max_by(F.struct(F.col("score").alias("stored_score"), F.col("chars").alias("stored_chars")), F.struct(F.coalesce(F.try_to_timestamp("scored_at"), F.lit(0).cast("timestamp")), F.coalesce("score", F.lit(-1.0)), F.coalesce("chars", F.lit(-1)))).alias("s"))
        .select("pdf_stem", "page_num", "s.*")
    )
    stats = quality_statistics(readings)
    return readings.select("id", "pdf_stem", "page_num").join(stats, "id").join(stored, ["pdf_stem", "page_num"], "left")


@query
def p1_counts(spark: SparkSession, folder: str) -> DataFrame:
    """Characters and words of every reading with something in it."""
    return page_statistics(table(spark, folder, "pdf_page_readings", "id", "text")).select("id", "chars", "words")


ORACLE["p1_counts"] = r"""
SELECT id, length(text) AS chars, len(regexp_extract_all(text, '[^\s\x0b\x1c-\x1f\x{85}\x{a0}\x{1680}\x{2000}-\x{200a}\x{2028}\x{2029}\x{202f}\x{205f}\x{3000}]+')) AS words FROM pdf_page_readings WHERE words > 0
"""


# ---- 4: splitting ----------------------------------------------------------------


@query
def p4_found(spark: SparkSession, folder: str) -> DataFrame:
    """At which level each over-long reading can be cut."""
    return split_items(table(spark, folder, "pdf_page_readings", "id", "text")).select("id", "cut").distinct()


ORACLE["p4_found"] = r"""
WITH t AS (SELECT DISTINCT id, text FROM pdf_page_readings WHERE length(text) > 800),
paragraphs AS (SELECT id, max(length(trim(u, chr(10)))) AS m FROM (SELECT id, unnest(string_split(regexp_replace(chr(10) || text || chr(10), '\n[ \t]*\n(?:[ \t]*\n)*', chr(1), 'g'), chr(1))) AS u FROM t) GROUP BY id),
lines AS (SELECT id, unnest(string_split(text, chr(10))) AS u FROM t),
line_max AS (SELECT id, max(length(u)) AS m FROM lines GROUP BY id),
sentence_max AS (SELECT id, max(length(s)) AS m FROM (SELECT id, unnest(string_split(regexp_replace(u, '([.!?])[ \t]+', '\1' || chr(1), 'g'), chr(1))) AS s FROM lines) GROUP BY id),
word_max AS (SELECT id, max(length(w)) AS m FROM (SELECT id, unnest(regexp_split_to_array(text, '[ \t\n]+')) AS w FROM t) GROUP BY id)
SELECT t.id, CASE WHEN p.m <= 800 THEN 'paragraph' WHEN l.m <= 800 THEN 'line' WHEN s.m <= 800 THEN 'sentence' WHEN w.m <= 800 THEN 'word' ELSE 'none' END AS cut
FROM t JOIN paragraphs p USING (id) JOIN line_max l USING (id) JOIN sentence_max s USING (id) JOIN word_max w USING (id)
"""


@query
def p4_pieces(spark: SparkSession, folder: str) -> DataFrame:
    """The pieces of every over-long reading, with their text."""
    cut = split_items(table(spark, folder, "pdf_page_readings", "id", "text"), with_text=True).select("id", F.posexplode("pieces").alias("piece", "p"))
    return cut.select("id", "piece", F.col("p.start").alias("start"), F.col("p.end").alias("end"), F.col("p.boundary").alias("boundary"), F.col("p.text").alias("text"))


@query
def p4_rebuilt(spark: SparkSession, folder: str) -> DataFrame:
    """Every over-long reading put together again from its pieces, and whether these keep their limits."""
    w = Window.partitionBy("id").orderBy("piece")
    p = p4_pieces(spark, folder).withColumn("shared", F.coalesce(F.lag("end").over(w) - F.col("start"), F.lit(0)))
    new = F.struct("piece", F.expr("substring(text, shared + 1)").alias("t"))
    texts = p.groupBy("id").agg((F.max(F.length("text")) <= 800).alias("within"), (F.max("shared") <= 150).alias("shared_little"), (F.min("shared") >= 0).alias("no_gap"), F.array_join(F.transform(F.array_sort(F.collect_list(new)), lambda x: x["t"]), "").alias("t"))
    return texts.select("id", "within", "shared_little", "no_gap", F.md5("t").alias("text"))


ORACLE["p4_rebuilt"] = "SELECT DISTINCT id, true AS within, true AS shared_little, true AS no_gap, md5(text) AS text FROM pdf_page_readings WHERE length(text) > 800"


# ---- 6: best representative ------------------------------------------------------


@query
def p6_found(spark: SparkSession, folder: str) -> DataFrame:
    """Of every page with several readings the chosen one, and the one that gives the markdown."""
    chosen = choose_bundles(table(spark, folder, "pdf_page_readings"), table(spark, folder, "ocr_engines"))
    return chosen.where(F.col("readings") > 1).select("pdf_stem", "page_num", "id", "markdown_id")


_P6_RANKED = r"""
WITH r AS (
  SELECT p.*, e.trust, coalesce(reason, '') <> 'rejected' AND coalesce(regexp_matches(text, '[^\s\x{a0}]'), false) AS ok,
    CASE WHEN score BETWEEN 0 AND 100 THEN score END AS s,
    CASE WHEN regexp_matches(recorded_at, '(Z|[+-]\d\d:?\d\d)$') THEN try_cast(recorded_at AS TIMESTAMPTZ) ELSE try_cast(recorded_at || 'Z' AS TIMESTAMPTZ) END AS seen
  FROM pdf_page_readings p LEFT JOIN ocr_engines e ON replace(lower(trim(p.engine)), '_', '-') = e.engine),
k AS (SELECT *, row_number() OVER w AS n, count(*) OVER (PARTITION BY pdf_stem, page_num) AS c FROM r
  WINDOW w AS (PARTITION BY pdf_stem, page_num ORDER BY ok DESC, s DESC NULLS LAST, trust DESC NULLS LAST, seen DESC NULLS LAST, id DESC))
"""
ORACLE["p6_found"] = _P6_RANKED + r"""
SELECT pdf_stem, page_num, max(CASE WHEN n = 1 THEN id END) AS id, coalesce(arg_min(id, n) FILTER (WHERE regexp_matches(markdown, '[^\s\x{a0}]')), 0) AS markdown_id
FROM k WHERE c > 1 GROUP BY pdf_stem, page_num
"""


@query
def p6_records(spark: SparkSession, folder: str) -> DataFrame:
    """The surviving record of every page."""
    return merged_records(table(spark, folder, "pdf_page_readings"), table(spark, folder, "ocr_engines"))


ORACLE["p6_records"] = _P6_RANKED + r"""
, l AS (SELECT *, regexp_matches(markdown, '[^\s\x{a0}]') AS md, regexp_matches(layout_json, '[^\s\x{a0}]') AS ly, replace(lower(trim(engine)), '_', '-') AS e FROM k),
m AS (SELECT pdf_stem, page_num, arg_min(id, n) FILTER (md) AS mid, arg_min(coalesce(e, ''), n) FILTER (md) AS me FROM l GROUP BY ALL),
c AS (SELECT l.pdf_stem, l.page_num, max(CASE WHEN n = 1 THEN id END) AS id, coalesce(any_value(mid), 0) AS markdown_id, coalesce(arg_min(id, n) FILTER (ly AND coalesce(e, '') = me), 0) AS layout_id, max(c) AS readings FROM l JOIN m USING (pdf_stem, page_num) GROUP BY ALL)
SELECT c.*, r.engine, r.engine_identity, r.text, r.score, r.recorded_at, r.reason, mm.markdown, y.layout_json FROM c JOIN pdf_page_readings r ON r.id = c.id LEFT JOIN pdf_page_readings mm ON mm.id = c.markdown_id LEFT JOIN pdf_page_readings y ON y.id = c.layout_id
"""


# ---- 5: near duplicates ----------------------------------------------------------


@query
def p5_found(spark: SparkSession, folder: str) -> DataFrame:
    """Pairs of readings of different documents that share at least half of their three-word sequences."""
    return Forest(table(spark, folder, "pdf_page_readings", "id", "pdf_stem", "text")).between_groups()


ORACLE["p5_found"] = r"""
WITH w AS (SELECT id, pdf_stem, regexp_extract_all(lower(text), '[\p{L}\p{N}]+') AS w FROM pdf_page_readings WHERE text IS NOT NULL),
s AS (SELECT DISTINCT id, pdf_stem, w[i] || ' ' || w[i + 1] || ' ' || w[i + 2] AS g FROM w, unnest(generate_series(1, len(w) - 2)) AS u(i) WHERE len(w) >= 20),
n AS (SELECT id, count(*) AS n FROM s GROUP BY 1),
p AS (SELECT a.id AS id_a, b.id AS id_b, count(*) AS c FROM s a JOIN s b ON a.g = b.g AND a.id < b.id AND a.pdf_stem <> b.pdf_stem GROUP BY ALL)
SELECT id_a, id_b FROM p JOIN n x ON x.id = id_a JOIN n y ON y.id = id_b WHERE c >= 0.5 * (x.n + y.n - c)
"""


@query
def p5_groups(spark: SparkSession, folder: str) -> DataFrame:
    """The class of every reading, copies by class and not as pairs."""
    return Forest(table(spark, folder, "pdf_page_readings", "id", "pdf_stem", "text"), within=True).groups()


ORACLE["p5_groups"] = r"""
WITH RECURSIVE w AS (SELECT id, regexp_extract_all(lower(coalesce(text, '')), '[\p{L}\p{N}]+') AS w FROM pdf_page_readings),
g AS (SELECT DISTINCT id, w[i] || ' ' || w[i + 1] || ' ' || w[i + 2] AS g FROM w, unnest(generate_series(1, len(w) - 2)) AS u(i) WHERE len(w) >= 20),
sets AS (SELECT id, md5(string_agg(g, '|' ORDER BY g)) AS same FROM g GROUP BY id),
own AS (SELECT id, coalesce(same, CASE WHEN len(w) > 0 THEN 'w' || array_to_string(w, ' ') ELSE 'i' || id END) AS same FROM w LEFT JOIN sets USING (id)),
reps AS (SELECT id, min(id) OVER (PARTITION BY same) AS rep FROM own),
s AS (SELECT g.* FROM g WHERE id IN (SELECT rep FROM reps)), n AS (SELECT id, count(*) AS n FROM s GROUP BY 1),
p AS (SELECT a.id AS a, b.id AS b, count(*) AS c FROM s a JOIN s b ON a.g = b.g AND a.id < b.id GROUP BY ALL),
links AS (SELECT a, b FROM p JOIN n x ON x.id = a JOIN n y ON y.id = b WHERE c >= 0.5 * (x.n + y.n - c)),
ways AS (SELECT a, b FROM links UNION ALL SELECT b, a FROM links),
cc AS (SELECT DISTINCT rep AS node, rep AS root FROM reps UNION SELECT ways.b, cc.root FROM cc JOIN ways ON ways.a = cc.node),
c AS (SELECT node, min(root) AS root FROM cc GROUP BY node)
SELECT r.id, least(c.root, r.rep) AS class_id, (SELECT count(*) FROM ways WHERE a = r.rep) AS links FROM reps r JOIN c ON c.node = r.rep
"""


# ---- 2: personal information -----------------------------------------------------


@query
def p2_found(spark: SparkSession, folder: str) -> DataFrame:
    """Every distinct piece of personal information by reading and field."""
    return personal_information(table(spark, folder, "pdf_page_readings", "id", "text", "markdown")).select("id", "field", "kind", "snippet").distinct()


@query
def p2_redacted(spark: SparkSession, folder: str) -> DataFrame:
    """The texts and markdowns with typed placeholders."""
    return redacted(table(spark, folder, "pdf_page_readings", "id", "text", "markdown"))


# ---- 3: scanning damage ----------------------------------------------------------


@query
def p3_found(spark: SparkSession, folder: str) -> DataFrame:
    """What scanning did to each prose reading, item by item."""
    readings = table(spark, folder, "pdf_page_readings", "id", "pdf_stem", "page_num", "text")
    return scan_repair(readings, learn(readings)).select("id", F.explode("found").alias("f")).select("id", "f.kind", "f.item").distinct()


@query
def p3_repaired(spark: SparkSession, folder: str) -> DataFrame:
    """Prose readings as continuous paragraphs."""
    readings = table(spark, folder, "pdf_page_readings", "id", "pdf_stem", "page_num", "text")
    return scan_repair(readings, learn(readings)).select("id", "repaired")


# ---- 7: names --------------------------------------------------------------------


@query
def p7_found(spark: SparkSession, folder: str) -> DataFrame:
    """Pairs of spellings of one person or organisation."""
    linked = link_names(table(spark, folder, "doc_entities", "payload"), table(spark, folder, "graph_review_decisions", "target_json")).where("links > 0")
    a, b = (linked.select("kind", "entity", F.col("name").alias(f"name_{x}")) for x in "ab")
    return a.join(b, ["kind", "entity"]).where(F.col("name_a") < F.col("name_b")).select("name_a", "name_b").distinct()


@query
def p7_entities(spark: SparkSession, folder: str) -> DataFrame:
    """Every name with the entity it stands for."""
    return link_names(table(spark, folder, "doc_entities", "payload"), table(spark, folder, "graph_review_decisions", "target_json"))


# ---- 9: leaked evaluation texts --------------------------------------------------


@query
def p9_found(spark: SparkSession, folder: str) -> DataFrame:
    """Documents that hold at least half of a test passage, with the items concerned."""
    return leaked_passages(table(spark, folder, "documents", "doc_id", "text"), table(spark, folder, "eval_items", "item_id", "passage")).select("doc_id", "item_id").distinct()


@query
def p9_clean(spark: SparkSession, folder: str) -> DataFrame:
    """The documents without those that leak a test item."""
    documents = table(spark, folder, "documents")
    leaked = leaked_passages(documents, table(spark, folder, "eval_items", "item_id", "passage")).select("doc_id").distinct()
    return documents.join(leaked, "doc_id", "left_anti").select("doc_id", "lang", "source", "n_chars")


# ---- 10: spam --------------------------------------------------------------------


@query
def p10_found(spark: SparkSession, folder: str) -> DataFrame:
    """Documents made of keywords, links or tags."""
    return spam_pages(table(spark, folder, "documents", "doc_id", "text", "lang")).where("is_spam").select("doc_id").distinct()


@query
def p10_curves(spark: SparkSession, folder: str) -> DataFrame:
    """The rank-frequency figures of every document."""
    return spam_pages(table(spark, folder, "documents", "doc_id", "text", "lang"))


# ---- 8: containers ---------------------------------------------------------------


@query
def p8_assignment(spark: SparkSession, folder: str) -> DataFrame:
    """Which container every document goes into."""
    return fill_containers(token_counts(table(spark, folder, "documents", "doc_id", "text"), TOKENIZER))


@query
def p8_fill(spark: SparkSession, folder: str) -> DataFrame:
    """How full the containers are."""
    used = fill_containers(token_counts(table(spark, folder, "documents", "doc_id", "text"), TOKENIZER)).groupBy("container").agg(F.sum("tokens").alias("used"))
    return used.agg(F.count(F.lit(1)).alias("containers"), F.sum("used").alias("tokens"), F.max("used").alias("fullest"), F.round(F.avg("used") / CAPACITY, 4).alias("mean_fill"))


@query
def p8_checked(spark: SparkSession, folder: str) -> DataFrame:
    """Whether the containers keep their rules: documents placed, places used twice, containers over their size, documents cut without need or not whole."""
    sizes = materialize(token_counts(table(spark, folder, "documents", "doc_id", "text"), TOKENIZER), "sizes")
    placed = materialize(fill_containers(sizes), "placed")
    of_doc = placed.groupBy("doc_id").agg(F.sum("tokens").alias("sum"), F.count(F.lit(1)).alias("pieces"), F.count_distinct("piece").alias("different"))
    j = of_doc.join(sizes, "doc_id")
    docs = j.agg(F.count(F.lit(1)).alias("documents"), F.count_if(F.col("sum") != F.col("tokens")).alias("not_whole"), F.count_if(F.col("pieces") != F.col("different")).alias("twice"), F.count_if((F.col("pieces") > 1) & (F.col("tokens") <= CAPACITY)).alias("cut"))
    over = placed.groupBy("container").agg(F.sum("tokens").alias("used")).agg(F.count_if(F.col("used") > CAPACITY).alias("too_full"))
    return docs.crossJoin(over)  # single rows


ORACLE["p8_checked"] = "SELECT count(*) AS documents, 0 AS not_whole, 0 AS twice, 0 AS cut, 0 AS too_full FROM documents WHERE replace(text, ' ', '') <> ''"
