"""Entities and relations of pages as a graph."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from pagewright.functions import text as T

PAYLOAD = "struct<entiteter:array<struct<typ:string,namn:string>>,relationer:array<struct<fran:string,typ:string,till:string>>>"
LABELS = ("person", "plats", "organisation")


def parsed(df: DataFrame) -> DataFrame:
    """Latest payload of each page, read; rows with broken or empty JSON are gone."""
    stamp = F.struct(F.coalesce("extracted_at", F.lit("")), F.coalesce("payload", F.lit("")))
    latest = df.groupBy("pdf_stem", "page_num").agg(F.max_by("payload", stamp).alias("payload"))
    return latest.withColumn("p", F.from_json("payload", PAYLOAD)).where(F.col("p.entiteter").isNotNull())


def entities(pages: DataFrame) -> DataFrame:
    """One row per entity: stem, page, ``idx``, ``typ`` (trimmed, lower case), ``namn``, ``norm``; blank names are gone."""
    e = pages.select("pdf_stem", "page_num", F.posexplode("p.entiteter").alias("idx", "e"))
    e = e.select("pdf_stem", "page_num", "idx", F.lower(F.trim("e.typ")).alias("typ"), F.trim("e.namn").alias("namn"))
    return e.where(F.col("namn") != "").withColumn("norm", T.normalize_name(F.col("namn")))


def relations(pages: DataFrame) -> DataFrame:
    """One row per relation as written."""
    return pages.select("pdf_stem", "page_num", F.posexplode("p.relationer").alias("idx", "r")).select("pdf_stem", "page_num", "idx", F.trim("r.fran").alias("fran"), F.trim("r.typ").alias("typ"), F.trim("r.till").alias("till"))


def surname_map(ents: DataFrame) -> DataFrame:
    """Per document the family names that exactly one full person name ends with."""
    people = ents.where((F.col("typ") == "person") & F.col("norm").contains(" "))
    named = people.select("pdf_stem", F.element_at(F.split("norm", " "), -1).alias("surname"), "norm")
    return named.groupBy("pdf_stem", "surname").agg(F.min("norm").alias("full"), F.max("norm").alias("_last")).where(F.col("full") == F.col("_last")).drop("_last")


def resolved(ents: DataFrame) -> DataFrame:
    """Entities with single-word persons expanded by the document's family names."""
    full = surname_map(ents).select(F.col("pdf_stem").alias("_stem"), F.col("surname").alias("_surname"), F.col("full").alias("_full"))
    j = ents.join(full, (F.col("pdf_stem") == F.col("_stem")) & (F.col("norm") == F.col("_surname")) & (F.col("typ") == "person"), "left")
    return j.withColumn("norm", F.coalesce("_full", "norm")).drop("_stem", "_surname", "_full")


def mentions(ents: DataFrame) -> DataFrame:
    """Distinct mention edges of known kinds."""
    return resolved(ents).where(F.col("typ").isin(*LABELS)).select("pdf_stem", "page_num", F.col("typ").alias("label"), "norm").distinct()


def relation_edges(ents: DataFrame, rels: DataFrame) -> DataFrame:
    """Relations whose ends are both entities of their page, resolved."""
    known = resolved(ents).where(F.col("typ").isin(*LABELS)).select("pdf_stem", "page_num", T.normalize_name(F.col("namn")).alias("raw"), "norm", F.col("typ").alias("label")).distinct()
    r = rels.select("pdf_stem", "page_num", F.col("typ").alias("rel"), T.normalize_name(F.col("fran")).alias("f"), T.normalize_name(F.col("till")).alias("t")).where(F.col("rel") != "")
    a = known.select("pdf_stem", "page_num", F.col("raw").alias("f"), F.col("norm").alias("src"), F.col("label").alias("src_label"))
    b = known.select("pdf_stem", "page_num", F.col("raw").alias("t"), F.col("norm").alias("dst"), F.col("label").alias("dst_label"))
    return r.join(a, ["pdf_stem", "page_num", "f"]).join(b, ["pdf_stem", "page_num", "t"]).select("pdf_stem", "page_num", "rel", "src_label", "src", "dst_label", "dst").distinct()


# What a reviewer is told about an occurrence.
ISSUES = {
    "duplicate": "Dubblett på sidan", "empty": "Tomt namn", "unknown": "Okänd entitetstyp", "short": "Kort eller ensamt personnamn; kontrollera initialer", "junk": "Möjlig maskering eller OCR-skräp",
    "missing": "Saknad ändpunkt: ", "ambiguous": "Tvetydig ändpunkt: ", "untyped": "Tom relationstyp", "self": "Självkant",
}


def occurrences(pages: DataFrame) -> DataFrame:
    """Every entity and relation of the pages as written: stem, page, ``kind``, ``idx``, ``typ``, ``namn``, ``fran``, ``till`` ('' where not given)."""
    blank = F.lit("")
    text = lambda c: F.coalesce(F.col(c), blank)
    e = pages.select("pdf_stem", "page_num", F.posexplode("p.entiteter").alias("idx", "x")).select("pdf_stem", "page_num", F.lit("entity").alias("kind"), "idx", text("x.typ").alias("typ"), text("x.namn").alias("namn"), blank.alias("fran"), blank.alias("till"))
    r = pages.select("pdf_stem", "page_num", F.posexplode("p.relationer").alias("idx", "x")).select("pdf_stem", "page_num", F.lit("relation").alias("kind"), "idx", text("x.typ").alias("typ"), blank.alias("namn"), text("x.fran").alias("fran"), text("x.till").alias("till"))
    return e.unionByName(r)


def audited(rows: DataFrame) -> DataFrame:
    """``occurrences`` with ``issues``, what a reviewer would ask about each, in a fixed order.

    The kinds that a page gives each name are gathered per page once; a relation's ends
    are looked up there. Repeats are counted in windows over the same text of one page.
    """
    key = ["pdf_stem", "page_num"]
    labels = rows.where("kind = 'entity'").groupBy(*key, T.normalize_name(F.col("namn")).alias("norm")).agg(F.count_distinct("typ").alias("kinds"))
    again = F.row_number().over(Window.partitionBy(*key, "kind", "typ", "namn", "fran", "till").orderBy("idx")) > 1
    out = rows.withColumn("again", again)
    for end in ("fran", "till"):
        known = labels.select(*key, F.col("norm").alias(f"_{end}"), F.col("kinds").alias(f"_{end}_kinds"))
        out = out.withColumn(f"_{end}", T.normalize_name(F.col(end))).join(known, [*key, f"_{end}"], "left")
    is_entity, name = F.col("kind") == "entity", F.trim("namn")
    mark = lambda cond, text: F.when(cond, F.lit(text))

    def lost(end: str) -> Column:
        n = F.col(f"_{end}_kinds")
        return F.when(~is_entity & ((F.col(f"_{end}") == "") | n.isNull()), ISSUES["missing"] + end).when(~is_entity & (n > 1), ISSUES["ambiguous"] + end)

    found = F.array(
        mark(F.col("again"), ISSUES["duplicate"]), mark(is_entity & (name == ""), ISSUES["empty"]), mark(is_entity & ~F.col("typ").isin(*LABELS), ISSUES["unknown"]),
        mark(is_entity & (F.col("typ") == "person") & ((F.length(name) <= 4) | ~name.rlike(r"\S\s+\S")), ISSUES["short"]), mark(is_entity & name.rlike(r"(?i)MASK|\x{fffd}|[\[\]{}|_]|\d"), ISSUES["junk"]),
        lost("fran"), lost("till"), mark(~is_entity & (F.trim("typ") == ""), ISSUES["untyped"]), mark(~is_entity & (F.col("_fran") == F.col("_till")), ISSUES["self"]),
    )
    return out.select(*key, "kind", "idx", "typ", "namn", "fran", "till", F.array_compact(found).alias("issues"))


def facets(ents: DataFrame) -> DataFrame:
    """Per kind and name (without case): number of documents and the most frequent spelling (ties: the smallest)."""
    known = ents.where(F.col("typ").isin(*LABELS)).withColumn("key", F.lower("namn"))
    spelled = known.groupBy("typ", "key", "namn").agg(F.count(F.lit(1)).alias("c"))
    shown = spelled.groupBy("typ", "key").agg(F.min_by("namn", F.struct(-F.col("c"), F.col("namn"))).alias("spelling"))
    return known.groupBy("typ", "key").agg(F.count_distinct("pdf_stem").alias("documents")).join(shown, ["typ", "key"])


def ego(edges: DataFrame, centres: DataFrame, norm: str = "norm") -> DataFrame:
    """Neighbours of the centres over relations in both directions: ``centre``, ``rel``, ``other``, ``way``, ``n`` (edges that join them).

    Every edge is read once and looked at from both ends.
    """
    ends = F.array(F.struct(F.col("src").alias("centre"), F.col("dst").alias("other"), F.lit("out").alias("way")), F.struct(F.col("dst").alias("centre"), F.col("src").alias("other"), F.lit("in").alias("way")))
    seen = edges.select("rel", F.explode(ends).alias("e")).select("e.centre", "rel", "e.other", "e.way")
    return seen.join(centres.select(F.col(norm).alias("centre")).distinct(), "centre", "left_semi").groupBy("centre", "rel", "other", "way").agg(F.count(F.lit(1)).alias("n"))


def once(rows: DataFrame, rid: str) -> DataFrame:
    """Rows with the same id once; rows without one all stay."""
    return rows.where(F.col(rid).isNotNull()).dropDuplicates([rid]).unionByName(rows.where(F.col(rid).isNull()))


def centres_of(names: DataFrame, ents: DataFrame, name: str = "name") -> DataFrame:
    """For each name the entity it most likely means: the same name whatever its case, else the shortest that contains it; ``name``, ``label``, ``norm``, ``namn``.

    Names are a stated query list; entities are reduced to their distinct names first.
    """
    known = ents.where(F.col("typ").isin(*LABELS)).groupBy(F.col("typ").alias("label"), "norm").agg(F.min("namn").alias("namn"))
    wanted = names.select(F.col(name).alias("name")).where(F.trim("name") != "").distinct()
    hits = known.join(F.broadcast(wanted), F.lower("namn").contains(F.lower("name")))  # a stated list
    order = F.struct((F.lower("namn") != F.lower("name")).alias("part"), F.length("namn").alias("size"), "namn", "label", "norm")
    return hits.groupBy("name").agg(F.min_by(F.struct("label", "norm", "namn"), order).alias("e")).select("name", "e.*")


def elements(centres: DataFrame, rels: DataFrame, docs: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Nodes and edges of a picture around the centres.

    ``rels``: ``s_norm``, ``s_namn``, ``s_label``, ``e_norm``, ``e_namn``, ``e_label``, ``typ``;
    ``docs``: ``stem``, ``nr``, ``titel``, ``centre``. Nodes: ``id``, ``label``, ``name`` (a star
    for centres, cut to 45 characters), ``stem``; a node given several times stays a centre
    if it is one. Edges: ``source``, ``target``, ``name`` with how many there are; those
    without both nodes are gone.
    """
    doc = F.concat(F.lit("doc:"), F.col("stem"))
    none = F.lit(None).cast("string").alias("stem")
    nodes = (
        centres.select(F.col("norm").alias("id"), F.col("namn").alias("shown"), "label", none, F.lit(0).alias("o"))
        .unionByName(rels.select(F.col("s_norm").alias("id"), F.col("s_namn").alias("shown"), F.col("s_label").alias("label"), none, F.lit(1).alias("o")))
        .unionByName(rels.select(F.col("e_norm").alias("id"), F.col("e_namn").alias("shown"), F.col("e_label").alias("label"), none, F.lit(1).alias("o")))
        .unionByName(docs.select(doc.alias("id"), document_label(F.col("nr"), F.col("titel"), F.col("stem")).alias("shown"), F.lit("Dokument").alias("label"), "stem", F.lit(2).alias("o")))
    )
    nodes = nodes.groupBy("id").agg(F.min(F.struct("o", F.coalesce("shown", "id").alias("shown"), "label", "stem")).alias("x"))
    short = F.when(F.length("x.shown") > 45, F.concat(F.substring("x.shown", 1, 44), F.lit("…"))).otherwise(F.col("x.shown"))
    nodes = nodes.select("id", "x.label", F.when(F.col("x.o") == 0, F.concat(F.lit("★ "), short)).otherwise(short).alias("name"), "x.stem")
    links = rels.select(F.col("s_norm").alias("source"), F.col("e_norm").alias("target"), F.coalesce("typ", F.lit("")).alias("rel")).unionByName(docs.select(doc.alias("source"), F.col("centre").alias("target"), F.lit("nämner").alias("rel")))
    edges = links.groupBy("source", "target", "rel").agg(F.count(F.lit(1)).alias("n"))
    edges = edges.join(nodes.select(F.col("id").alias("source")), "source", "left_semi").join(nodes.select(F.col("id").alias("target")), "target", "left_semi")
    return nodes, edges.select("source", "target", F.when(F.col("n") > 1, F.concat("rel", F.lit(" (×"), F.col("n").cast("string"), F.lit(")"))).otherwise(F.col("rel")).alias("name"))


def document_label(nr: Column, title: Column, stem: Column) -> Column:
    """'number — title', or what there is of them, or the stem."""
    n, t = F.trim(F.coalesce(nr, F.lit(""))), F.trim(F.coalesce(title, F.lit("")))
    return F.when((n != "") & (t != ""), F.concat(n, F.lit(" — "), t)).when(t != "", t).when(n != "", n).otherwise(stem)


def stems_by_entity(ents: DataFrame) -> DataFrame:
    """``key`` (a name in small letters) and ``pdf_stem`` of every document that holds it."""
    return ents.select(F.lower("namn").alias("key"), "pdf_stem").distinct()


def document_fields(stem: Column) -> Column:
    """Number and title in a document's name."""
    f = T.filename_fields(stem)
    return F.struct(f["nr"].alias("nr"), f["titel"].alias("titel"))


def replaced(live: DataFrame, wanted: DataFrame, owner: str) -> DataFrame:
    """Live edges after those of ``owner`` are replaced by the wanted ones; edges of others stay, and no edge is there twice."""
    return live.where(F.col("owner") != owner).unionByName(wanted.withColumn("owner", F.lit(owner)).select(*live.columns)).distinct()


def orphan_nodes(nodes: DataFrame, edges: DataFrame, node: str = "norm") -> DataFrame:
    """Nodes that no edge touches any more."""
    touched = edges.select(F.explode(F.array("src", "dst")).alias(node)).distinct()
    return nodes.join(touched, node, "left_anti")


def comparison(wanted: DataFrame, live: DataFrame, key: list[str], owner: str = "owner") -> DataFrame:
    """One row: wanted edges that are missing, live ones that are surplus, ``duplicates`` among the live and ``legacy`` ones without an owner."""
    w, v = wanted.select(*key).distinct(), live.where(F.col(owner).isNotNull()).select(*key)
    counts = lambda df, name: df.agg(F.count(F.lit(1)).alias(name))
    one = counts(w.subtract(v), "missing").crossJoin(counts(v.distinct().subtract(w), "surplus"))  # single rows
    return one.crossJoin(v.groupBy(*key).agg((F.count(F.lit(1)) - 1).alias("x")).agg(F.coalesce(F.sum("x"), F.lit(0)).alias("duplicates"))).crossJoin(counts(live.where(F.col(owner).isNull()), "legacy"))


def fingerprint(rows: DataFrame, *columns: str) -> DataFrame:
    """A digest of a table whatever the order of its rows: from their number and the sums of four parts of their digests, so nothing is gathered."""
    h = F.sha2(F.concat_ws("\x1f", *[F.coalesce(F.col(c).cast("string"), F.lit("")) for c in columns]), 256)
    part = lambda i: F.sum(F.conv(F.substring("h", 1 + 15 * i, 15), 16, 10).cast("decimal(38,0)")).alias(f"s{i}")
    sums = rows.select(h.alias("h")).agg(F.count(F.lit(1)).alias("n"), *[part(i) for i in range(4)])
    return sums.select(F.sha2(F.concat_ws("|", F.col("n").cast("string"), *[F.coalesce(F.col(f"s{i}"), F.lit(0)).cast("decimal(38,0)").cast("string") for i in range(4)]), 256).alias("fingerprint"))


def difference(wanted: DataFrame, live: DataFrame) -> DataFrame:
    """Rows of two graphs that differ, with ``side`` 'missing' (wanted only) or 'surplus' (live only)."""
    return wanted.subtract(live).withColumn("side", F.lit("missing")).unionByName(live.subtract(wanted).withColumn("side", F.lit("surplus")))


def merged(nodes: DataFrame, new: DataFrame, key: list[str], order: str) -> DataFrame:
    """Nodes after new ones are merged in: one per key; of each property the first value that was written stays."""
    props = [c for c in nodes.columns if c not in key]
    rows = nodes.withColumn("_o", F.lit(-1).cast("long")).unionByName(new.select(*nodes.columns, F.col(order).cast("long").alias("_o")))
    return rows.groupBy(*key).agg(*[F.min_by(c, F.when(F.col(c).isNotNull(), F.struct("_o", F.col(c)))).alias(c) for c in props])


def by_labels(edges: DataFrame) -> DataFrame:
    """How many edges go from each kind of node to each, as they are written kind by kind."""
    return edges.groupBy("src_label", "dst_label").agg(F.count(F.lit(1)).alias("n"))


def preview_of(runs: DataFrame, expected: str, order: str = "id") -> DataFrame:
    """The newest saved preview with the expected fingerprint (no row: nothing was previewed in this state)."""
    return runs.where(F.col("fingerprint") == expected).orderBy(F.desc(order)).limit(1)


def guard(rows: DataFrame, expected: str, *columns: str) -> None:
    """Raise if a table isn't as it was when its fingerprint was taken."""
    if fingerprint(rows, *columns).first()[0] != expected:
        raise RuntimeError("the source has changed since the preview")


def decoded_centres(token: Column) -> Column:
    """Centres shared in a link: a base64 list of name, kind and key; incomplete ones are left out, a broken link gives none."""
    padded = F.concat(F.translate(token, "-_", "+/"), F.repeat(F.lit("="), F.pmod(-F.length(token), F.lit(4))))
    valid = token.rlike(r"^[A-Za-z0-9_-]+$")
    got = F.from_json(F.when(valid, F.decode(F.unbase64(padded), "UTF-8")), "array<struct<namn:string,label:string,norm:string>>")
    clean = F.transform(got, lambda e: F.struct(*[F.trim(F.coalesce(e[c], F.lit(""))).alias(c) for c in ("namn", "label", "norm")]))
    return F.coalesce(F.filter(clean, lambda e: (e["namn"] != "") & (e["label"] != "") & (e["norm"] != "")), F.array().cast("array<struct<namn:string,label:string,norm:string>>"))
