import difflib
import json
import random
import re

import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from pagewright.functions import text as T
from pagewright.operators import chunk as C
from pagewright.operators import geo, graph, layout, pages, quality, retrieval, state


def one(spark, column, **values):
    df = spark.createDataFrame([tuple(values.values())], ", ".join(f"{k} string" for k in values)) if values else spark.range(1)
    return df.select(column.alias("x")).first()[0]


@pytest.mark.parametrize(
    "text,score",
    [("", 0.0), ("   ", 0.0), ("Vittnet såg bilen vid torget och gick sedan hem.", None)],
)
def test_score(spark, text, score):
    df = quality.scored(spark.createDataFrame([(text,), (None,)], "text string")).collect()
    assert df[1]["quality"] == 0.0
    assert df[0]["quality"] == score if score is not None else df[0]["quality"] > 60


def test_score_falls_with_junk(spark):
    got = quality.scored(spark.createDataFrame([(1, "Vittnet såg bilen vid torget"), (2, "V1ttn3t ¤§ s4g b#l£n ¤ v2d"), (3, "supercalifragilisticexpialidocious " * 3)], "i int, text string")).orderBy("i").collect()
    assert got[0]["quality"] > got[1]["quality"] and got[0]["quality"] > got[2]["quality"]


def test_normalize_text(spark):
    raw = "ﬁlt sto\xadder﻿\r\n\x0b|  |\n.....\n<b>Ord</b>\n\n\n\nslut\x0cSida två\n·"
    once = one(spark, T.normalize_text(F.col("t")), t=raw)
    assert once == "filt stoder\nOrd\n\nslut\x0cSida två"
    assert one(spark, T.normalize_text(F.col("t")), t=once) == once
    assert one(spark, T.normalize_text(F.col("t")), t=None) is None


def test_markers(spark):
    t = "a" * 100 + "[MASKAD]" + " b\n c " + "[MASKAD]"
    assert one(spark, T.marker_count(F.col("t")), t=t) == 2
    s = one(spark, T.marker_snippets(F.col("t")), t=t)
    assert s[0].startswith("…" + "a" * 80 + "[MASKAD] b c [MASKAD]") and not s[1].endswith("…")
    assert one(spark, T.marker_snippets(F.col("t")), t="") == []
    assert one(spark, T.normalize_mask_markers(F.col("t")), t="x [svärtat] y ███ z [redacted] [Not]") == "x [MASKAD] y [MASKAD] z [MASKAD] [Not]"


def test_keys_and_names(spark):
    k = one(spark, T.archive_keys(F.col("t")), t="HK0001066-64-B och UA0001062-22-EAD, xAB123-4x")
    assert [(r["prefix"], r["base"], r["version"], r["suffix"]) for r in k] == [("HK", 1066, 64, "B"), ("UA", 1062, 22, "E"), ("UA", 1062, 22, "A"), ("UA", 1062, 22, "D")]
    assert one(spark, T.display_name(F.col("t")), t=" Berg,  Anna ") == "Anna Berg"
    assert one(spark, T.normalize_name(F.col("t")), t="Gata 3, Stad") == "gata 3, stad"
    assert one(spark, T.build_filename([F.col("a"), F.col("b")]), a="x/y ", b=None) == "x-y"
    assert one(spark, T.build_filename([F.col("a")]), a="  ") == "fil"
    assert one(spark, T.drive_id(F.col("t")), t="https://h/open?id=ab_c-1") == "ab_c-1"
    assert one(spark, T.drive_id(F.col("t")), t="nope") is None


def test_markdown_to_text(spark):
    md = "# Rubrik\n> citat\n| a | b |\n|---|---|\n| **c** | d |\n- punkt  "
    assert one(spark, T.markdown_to_text(F.col("t")), t=md) == "Rubrik\ncitat\na\tb\nc\td\n- punkt"


def test_dehyphenate(spark):
    assert one(spark, T.dehyphenate(F.col("t")), t="cy-\nkel sprit-\neller Nils-\nGöran") == "cykel sprit-\neller Nils-\nGöran"


def test_clock(spark):
    assert [one(spark, T.clock_minutes(F.col("t")), t=x) for x in ("23:50", "00:10", "25:00", None)] == [1430, 1450, None, None]
    assert [one(spark, T.time_of(F.col("t")), t=x) for x in ("kl 9.05 ca", "21:30", "dnr 4351-192", "")] == ["09:05", "21:30", None, None]


def test_upsert_latest_and_nulls(spark):
    target = spark.createDataFrame([(1, "a", 1), (2, "b", 1)], "k int, v string, n int")
    updates = spark.createDataFrame([(2, "c", 5), (2, None, 6), (3, "d", 1)], "k int, v string, n int")
    got = {r["k"]: r["v"] for r in state.upsert(target, updates, ["k"], [F.col("n")]).collect()}
    assert got == {1: "a", 2: None, 3: "d"}
    got = {r["k"]: r["v"] for r in state.upsert(target, updates, ["k"], [F.col("n")], keep_null=False).collect()}
    assert got == {1: "a", 2: "b", 3: "d"}
    got = {r["k"]: r["v"] for r in state.insert_missing(target, updates, ["k"]).collect()}
    assert got == {1: "a", 2: "b", 3: "d"}
    assert state.upsert(target.limit(0), updates.limit(0), ["k"], [F.col("n")]).count() == 0


def test_index_action(spark):
    rows = [(True, None, 5.0, None, False), (True, 5.0, 5.0, None, False), (True, 4.0, 5.0, None, False), (True, 0.0, 5.0, 3.0, False), (True, 0.0, 5.0, None, False), (False, 5.0, 5.0, None, True), (False, None, 5.0, None, False)]
    df = spark.createDataFrame(rows, "i boolean, s double, d double, since double, bad boolean")
    got = [r[0] for r in df.select(state.index_action(*[F.col(c) for c in df.columns])).collect()]
    assert got == ["reingest", "skip", "reingest", "reingest", "skip", "skip", "new"]


def test_transitions(spark):
    states = ["queued", "running", "cancel_requested", "succeeded", "failed", "cancelled", "interrupted"]
    df = spark.createDataFrame([(a, b) for a in states for b in states], "a string, b string").withColumn("ok", state.may_become(F.col("a"), F.col("b")))
    legal = {(r["a"], r["b"]) for r in df.where("ok").collect()}
    assert ("queued", "running") in legal and ("running", "succeeded") in legal and ("succeeded", "running") not in legal and ("queued", "succeeded") not in legal
    assert len(legal) == 1 + 2 + 1 + 2 + 3 + 3


def test_rrf_and_interleave(spark):
    a = spark.createDataFrame([("x", 0), ("y", 1)], "k string, rank int")
    b = spark.createDataFrame([("z", 0), ("x", 1)], "k string, rank int")
    assert [r["k"] for r in retrieval.rrf([a, b], "k", 5).collect()] == ["x", "z", "y"]
    assert [r["k"] for r in retrieval.interleave(a, b, "k", 5).orderBy("place").collect()] == ["x", "z", "y"]


def test_fuzzy_ratio(spark):
    df = spark.createDataFrame([(1, "en cykel"), (2, "en cyckel"), (3, "båt"), (4, "")], "id int, text string")
    got = {r["id"]: r["score"] for r in retrieval.fuzzy(df, "id", "text", "cykel", 9, 0.7).collect()}
    assert got == {1: 1.0, 2: round(difflib.SequenceMatcher(None, "cykel", "cyckel").ratio(), 3)}


def test_graph_rules(spark):
    rows = [("d", 1, '{"entiteter": [{"typ": "person", "namn": "Berg, Anna"}, {"typ": "Person ", "namn": "Berg"}, {"typ": "plats", "namn": ""}], "relationer": [{"fran": "Berg", "typ": "såg", "till": "Anna Berg"}]}', "2"), ("d", 1, "{", "1"), ("d", 2, "{", "1"), ("d", 3, None, "1")]
    p = graph.parsed(spark.createDataFrame(rows, "pdf_stem string, page_num int, payload string, extracted_at string"))
    e = graph.entities(p)
    assert {(r["norm"], r["typ"]) for r in e.collect()} == {("anna berg", "person"), ("berg", "person")}
    assert [r["norm"] for r in graph.mentions(e).collect()] == ["anna berg"]
    edge = graph.relation_edges(e, graph.relations(p)).collect()
    assert [(r["src"], r["dst"]) for r in edge] == [("anna berg", "anna berg")]


def test_places(spark):
    places = spark.createDataFrame([("Odenplan (norra)",), ("Sveavägen",)], "place string")
    raw = spark.createDataFrame([("sveavägen",), ("hörnet Sveavägen",), ("Sveavagen",), ("xyz",), (" ",), (None,)], "t string")
    got = {r["t"]: (r["place"], r["how"]) for r in geo.match_places(raw, "t", places, "place").collect()}
    assert got == {"sveavägen": ("Sveavägen", "exact"), "hörnet Sveavägen": ("Sveavägen", "fuzzy"), "Sveavagen": ("Sveavägen", "fuzzy")}


words = st.lists(st.text("abcåäö", min_size=1, max_size=30), min_size=0, max_size=120)


@settings(max_examples=40, deadline=None)
@given(words, st.sampled_from([" ", "\n"]))
def test_chunks_cover_the_text(ws, sep):
    text = sep.join(ws)
    got = C.chunk(text, 120, 30)
    assert all(0 < len(c) <= 120 for _, _, c in got)
    assert set("".join(text.split())) == set("".join("".join(c for _, _, c in got).split()))
    for (_, end, _), (start, _, _) in zip(got, got[1:]):
        assert start < end or start == end - 30 or start > end - 31


@settings(max_examples=40, deadline=None)
@given(st.lists(st.text("abc ?|\n", min_size=1, max_size=200), max_size=8))
def test_markdown_chunks_keep_every_word(blocks):
    md = "\n\n".join(blocks)
    got = C.chunk_markdown(md, 150)
    assert all(len(c) <= 150 for c in got)
    assert sorted(set("".join(got)) - set(" \n|-")) == sorted(set(md) - set(" \n|-"))


def conserved(md, size):
    """Every word of a page's Markdown stands in a chunk that is kept, and every chunk is within its size."""
    got = C.chunk_markdown(md, size)
    assert all(len(c) <= size for c in got)
    kept = " ".join(c for c in got if len(c.partition("\n")[2] if c.startswith(C.HEADER_MARK) else c) >= C.LEAST)
    body = md.partition("\n")[2] if md.startswith(C.HEADER_MARK) else md
    words = re.findall(r"\w+", body)
    assert sum(map(len, words)) < 2 * C.LEAST or not set(words) - set(re.findall(r"\w+", kept))


def test_short_units_between_long_ones_are_kept():
    one, two = "Första stycket " + "ord " * 190, "Andra stycket " + "ord " * 190
    conserved("\n\n".join([one.strip(), "**M:** Ja, det stämmer.", two.strip()]), 800)
    conserved("Lång " + "x" * 787 + "\n\n**M:** Ja.", 800)
    conserved("**M:** Ja.\n\n" + ("Stycke " + "ord " * 190).strip(), 800)


def test_dialogues_lose_no_unit():
    rng = random.Random(21)
    words = "vittnet uppger att hon gick längs kajen mot hamnen den kvällen".split()
    for n in range(300):
        size = rng.choice([200, 400, 800])
        parts = [f"{C.HEADER_MARK} Förhör med X"] if rng.random() < 0.5 else []
        for k in range(rng.randint(1, 12)):
            r = rng.random()
            said = rng.choice(["Ja.", "Nej, det sa jag.", " ".join(rng.choices(words, k=rng.randint(1, 130)))])
            parts.append(f"**F:** {said}" if r < 0.3 else f"**M:** {said}" if r < 0.6 else f"{said} s{n}k{k}" if r < 0.9 else "| Plats | Tid |\n| --- | --- |\n" + "\n".join(f"| {rng.choice(words)} {i} | {i}.10 |" for i in range(rng.randint(1, 40))))
        conserved("\n\n".join(parts), size)


def test_long_rows_are_parted_at_cells():
    row = "| " + " | ".join(f"cell {i} " + "ord " * 8 for i in range(12)) + " |"
    got = C.chunk_markdown("| a | b |\n| --- | --- |\n" + row, 200)
    assert all(len(c) <= 200 for c in got) and all(any(f"cell {i} " in c for c in got) for i in range(12))
    assert all(x.startswith("|") and x.endswith("|") for c in got for x in c.split("\n") if x)


def test_question_stays_with_its_answer():
    pad = "Text " * 90
    got = C.chunk_markdown(f"{pad}\n\n**F:** {'Vad såg du? ' * 20}\n\nPaus.\n\n**S:** {'En bil. ' * 20}", 800)
    assert any("Vad såg du?" in c and "Paus." in c and "En bil." in c for c in got)


def test_a_header_makes_no_short_chunk_useful(spark):
    head = "> Sidhuvud: Förhör med vittnet om iakttagelser vid hamnen den kvällen och natten, sida 3 av 5"
    assert one(spark, C.is_useful(F.col("c"), markdown=True), c=head + "\n**M:** Ja.") is False
    assert one(spark, C.is_useful(F.col("c"), markdown=True), c=head + "\n" + "Vittnet uppger att hon gick hem. " * 3) is True


def test_markdown_chunk_repeats_table_head():
    md = "> Sidhuvud: x\n| a | b |\n|---|---|\n" + "\n".join(f"| rad {i} | värde {i} |" for i in range(40))
    got = C.chunk_markdown(md, 300)
    assert len(got) > 2 and all(c.startswith("> Sidhuvud: x\n") and "| a | b |" in c for c in got)


def test_overlay(spark):
    base = spark.createDataFrame([("d", 1, "ett"), ("d", 2, "två")], "k string, page_num int, text string")
    new = spark.createDataFrame([("d", 2, "2"), ("d", 4, "4"), ("d", 0, "bort"), ("e", 2, None)], "k string, page_num int, text string")
    got = {r["k"]: r["text"] for r in pages.overlaid(base, new, "k").collect()}
    assert got == {"d": "ett\f2\f\f4", "e": "\f"}


def test_overlay_of_odd_pages(spark):
    schema = "k string, page_num int, text string"
    base = spark.createDataFrame([("d", 3, "tre"), ("d", -1, "bort"), ("d", None, "bort"), ("z", 0, "bort"), (None, 2, "två")], schema)
    new = spark.createDataFrame([("d", 3, None), (None, 2, "två"), (None, 3, "tre")], schema)
    got = {r["k"]: r["text"] for r in pages.overlaid(base, new, "k").collect()}
    assert got == {"d": "\f\ftre", None: "\f\f"}
    assert pages.overlaid(base.limit(0), new.limit(0), "k").count() == 0
    with pytest.raises(Exception, match="given twice"):
        pages.overlaid(base, spark.createDataFrame([("d", 4, "a"), ("d", 4, "b")], schema), "k").collect()


@given(st.dictionaries(st.integers(-2, 12), st.one_of(st.none(), st.sampled_from(["", "a", "å\n"]))), st.dictionaries(st.integers(-2, 12), st.one_of(st.none(), st.sampled_from(["", "b"]))))
@settings(max_examples=15, deadline=None)
def test_overlay_is_a_map_of_pages(spark, old, new):
    frame = lambda m: spark.createDataFrame([("d", n, t) for n, t in m.items()], "k string, page_num int, text string")
    want = {n: t or "" for n, t in {**old, **{n: t for n, t in new.items() if t is not None or n not in old}}.items() if n >= 1}
    got = [r["text"] for r in pages.overlaid(frame(old), frame(new), "k").collect()]
    assert got == (["\f".join(want.get(i + 1, "") for i in range(max(want)))] if want else [])


def page(spark, *blocks):
    """A page read from (label, html, order)."""
    raw = json.dumps([{"label": k, "html": h, "reading_order": o, "bbox": [0, 10 * i, 50, 10 * i + 9]} for i, (k, h, o) in enumerate(blocks)])
    return layout.parsed(spark.createDataFrame([("p", raw)], "k string, raw string"), ["k"], "raw")


def test_layout(spark):
    p = page(spark, ("Text", "<p>Först</p><script>x</script>", 2), ("Table", "<table><tr><th colspan='2'>A</th></tr><tr><td>b</td><td>c|d</td></tr></table>", 1), ("Text", "<h5>sist</h5> <input type='checkbox' checked>", None))
    r = p.select(layout.page_text(F.col("blocks")).alias("text"), layout.page_markdown(F.col("blocks")).alias("md"), "degraded").first()
    assert r["text"] == "A\nb\tc|d\nFörst\nsist\n☒" and not r["degraded"]
    assert r["md"].startswith("| A |  |\n| --- | --- |\n| b | c\\|d |\n\nFörst")


def test_blocks_of_their_own(spark):
    p = page(spark, ("ListGroup", "före<ul><li>a</li><li>b</li></ul>efter", 0), ("Equation", "se <math>x^2</math> här", 1), ("Table", "<p>Rubrik</p><table><caption>Bild</caption><tr><td rowspan=2>x</td><td>y</td></tr><tr><td>z</td></tr></table>noter", 2), ("Table", "<p>tom</p>", 3), ("PageFooter", "sid 3", 4), ("Code", "<pre>a  b</pre>", 5))
    b = p.first()["blocks"]
    assert [(x["kind"], x["text"]) for x in b] == [("PARAGRAPH", "före"), ("LIST_ITEM", "a"), ("LIST_ITEM", "b"), ("PARAGRAPH", "efter"), ("FORMULA", "x^2"), ("PARAGRAPH", "se här"), ("PARAGRAPH", "Rubrik"), ("CAPTION", "Bild"), ("TABLE", "x\ty\nz"), ("PARAGRAPH", "noter"), ("PARAGRAPH", "tom"), ("PAGE_FOOTER", "sid 3"), ("CODE", "a  b")]
    assert p.first()["degraded"] and [x["order"] for x in b] == list(range(len(b)))
    md = p.select(layout.page_markdown(F.col("blocks"))).first()[0]
    assert "| x | y |\n| --- | --- |\n|  | z |" in md and "sid 3" not in md and "$$\nx^2\n$$" in md and "```\na  b\n```" in md


def test_dialogue_and_headers(spark):
    p = page(spark, ("PageHeader", "Förhör  med X", 0), ("Text", "F: Var det så?<br>S: Ja.<br># inte en rubrik", 1))
    assert p.select(layout.page_markdown(F.col("blocks"))).first()[0] == "> Sidhuvud: Förhör med X\n\n**F:** Var det så?\n\n**S:** Ja.\n\\# inte en rubrik"
    empty = layout.parsed(spark.createDataFrame([("a", None), ("b", "{"), ("c", "[]"), ("d", "[1]")], "k string, raw string"), ["k"], "raw")
    assert empty.where(F.size("blocks") > 0).count() == 0


def test_redactions_beside_marks(spark):
    p = page(spark, ("Text", "ett", 0), ("Text", "två [Redacted]", 1), ("Text", "tre", 2))
    got = p.select(layout.with_redactions(F.col("blocks"), F.array(F.array(F.lit(12), F.lit(14)), F.array(F.lit(27), F.lit(28)), F.array(F.lit(0), F.lit(1)))).alias("b")).first()["b"]
    assert [x["text"] for x in got] == ["[MASKAD]", "ett", "två [Redacted]", "tre", "[MASKAD]"] and [x["order"] for x in got] == [0, 1, 2, 3, 4]
    fixed = p.select(layout.replace_redacted(F.col("blocks")).alias("b")).first()["b"]
    assert fixed[1]["text"] == "två [MASKAD]"


def test_dark_blocks(spark):
    ys = [*range(10, 20), 23, *range(40, 44)]
    got = pages.dark_blocks(spark.createDataFrame([("p", y) for y in ys], "p string, y int"), "p", "y").collect()
    assert [(r["top"], r["bottom"]) for r in got] == [(10, 23)]
