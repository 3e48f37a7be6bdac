import json

import pytest
from pyspark.sql import functions as F

from pagewright.operators import citations, forms, layout, replies, review
from pagewright.sources import files


FORM = {"name": "a", "match": ["PROMEMORIA"], "labels": {"01": "Namn", "02": "Adress", "03": "Telefon", "04": "Yrke", "05": "Datum", "06": "Klockan", "18": "I sak", "20": "Tagit del", "21": "Spanchef", "22": "Registrator"}, "free_text": ["18"], "printed": ["Spaningschef"], "aliases": {"06": ["Utskriftsdatum"]}}
BLOCKS = [
    ("PROMEMORIA", [0, 0, 100, 10]), ("01 Namn", [0, 20, 100, 30]), ("Anna Berg", [0, 31, 100, 41]), ("02 Adress", [120, 20, 220, 30]), ("Storgatan 5", [120, 31, 220, 41]), ("03 Telefon 08-12", [0, 60, 100, 70]),
    ("04 Yrke", [0, 100, 50, 110]), ("Kock", [60, 100, 100, 110]), ("05 Datum 06 Klockan", [0, 140, 190, 150]), ("860228      23.21", [0, 151, 170, 161]), ("Spaningschef", [300, 140, 400, 150]), ("Vittnet gick hem.", [0, 300, 200, 310]),
]


def test_form_fields(spark):
    df = spark.createDataFrame([("p", BLOCKS), ("q", None), ("r", [])], "k string, blocks array<struct<text:string,bbox:array<int>>>")
    t = forms.template(FORM)
    got = {r["number"]: r["value"] for r in forms.form_fields(df, ["k"], "blocks", [t]).collect()}
    assert got == {"01": "Anna Berg", "02": "Storgatan 5", "03": "08-12", "04": "Kock", "05": "860228", "06": "23.21"}
    blocks = [{"text": x, "bbox": b} for x, b in BLOCKS]
    fields, left = forms.extract(blocks, t)
    assert set(left) == {"PROMEMORIA", "Spaningschef", "Vittnet gick hem."} and [f["label"] for f in fields][:2] == ["Namn", "Adress"]
    assert forms.choose_template([x for x, _ in BLOCKS], [forms.template(FORM | {"name": "b", "match": ["ANNAT"]}), t]).name == "a"
    assert forms.choose_template(["inget"], [t]) is None


def test_form_options_tables_and_outliers():
    t = forms.template(FORM | {"match": []})
    boxes = [{"text": "04 Yrke", "bbox": [0, 100, 50, 110]}, {"text": "☒ kock ☐ svarvare", "bbox": [0, 111, 150, 121]}, {"text": "01 Namn", "bbox": [0, 20, 100, 30]}, {"text": "02 Adress", "bbox": [0, 60, 100, 70]}]
    fields, _ = forms.extract(boxes, t, 1000)
    assert [(f["label"], f["checked"]) for f in fields if f["checked"] is not None] == [("kock", True), ("svarvare", False)]
    assert forms.table_fields([["01 Namn", "02 Adress"], ["Anna", "Storgatan 5"]], t)[0][1]["value"] == "Storgatan 5"
    assert forms.table_fields([["01 Namn", "annat"], ["Anna", "x"]], t) is None
    assert forms.table_fields([["18 I sak"], ["Hon gick hem."]], t) == ([{"number": "18", "label": "I sak", "value": "", "checked": None, "source": ""}], ["Hon gick hem."])
    assert forms.order_outliers([(1, 0, 10), (2, 0, 20), (9, 0, 5), (3, 0, 30)]) == {2} and forms.order_outliers([]) == set()
    foot = [forms.Line(f"{n} x", 0, y, 50, y + 5, 5, number=n) for n, y in ((20, 900), (21, 905), (22, 910), (21, 300))]
    assert [e.y0 for e in forms.footer_outliers(foot, 18, 1000)] == [300] and len(forms.footer_outliers(foot[:2], 18, 1000)) == 2
    assert forms.value_like("krinsp Lennart Gustafsson") and forms.value_like("860308") and not forms.value_like("nej") and not forms.value_like("Hon gick. sedan hem 3")
    assert forms.label_match("Avsnitt12", "Avsnitt") == (1.0, "12") and forms.is_printed("| Spaningschef |", t)
    for bad in ({"name": ""}, {"labels": {"99": "x"}}, {"free_text": ["07"]}, {"extra": 1}, {"aliases": {"01": "x"}}):
        with pytest.raises(ValueError):
            forms.template(FORM | bad)
    assert [x.name for x in forms.templates([("f", json.dumps({"templates": [FORM]}))])] == ["a"]
    with pytest.raises(ValueError):
        forms.templates([("f", "{")])


def test_masks(spark):
    df = spark.createDataFrame([(["a", "b", "c", "d"], [50.0, 90.0], 100), (["a"], [], 100)], "l array<string>, m array<double>, h int")
    got = [r[0] for r in df.select(forms.insert_masks(F.col("l"), F.col("m"), F.col("h"))).collect()]
    assert got == ["a\nb\n[MASKAD]\nc\nd\n[MASKAD]", "a"]


def test_layout_shapes_and_usage(spark):
    df = spark.createDataFrame([('[{"text": "x"}]',), ('{"dpi": 200, "blocks": [{"text": "y"}]}',), ("{",)], "j string")
    got = [r[0] for r in df.select(layout.from_stored(F.col("j"))).collect()]
    assert got[0]["dpi"] == 300 and got[1]["dpi"] == 200 and got[1]["blocks"][0]["text"] == "y" and got[2] is None
    u = spark.createDataFrame([('{"prompt_tokens": 5, "completion_tokens": 2}',), ('{"input_tokens": 1, "cache_read_input_tokens": 3, "output_tokens": 4}',)], "j string").select(forms.usage_fields(F.col("j")).alias("u")).select("u.*").collect()
    assert [tuple(r) for r in u] == [(5, 2, 0), (4, 4, 3)]


def test_citations(spark):
    a = spark.createDataFrame([(1, "Se [HK1-2, sida 3, 9] och [samma dokument, sida 5], XX9-9, sida 1 <b> [Nr HK1-2] [samma sida] [Nr HK…]"), (2, None)], "id int, a string")
    got = [(r["nr"], r["cut"], list(r["pages"]), r["back"]) for r in citations.cited(a, ["id"], "a").orderBy("place").collect()]
    assert got == [("HK1-2", False, [3, 9], ""), ("", False, [5], "dokument"), ("XX9-9", False, [1], ""), ("HK1-2", False, [], ""), ("", False, [], "sida"), ("HK", True, [], "")]
    assert [(c.nr, c.cut, c.pages, c.back) for c in citations.citations_of(a.first()["a"])] == got
    docs = spark.createDataFrame([("HK1-2", "x/HK1-2.pdf"), ("HK1-2 — bilaga", "b"), ("XX9-9_b", "c"), ("XX9-9 d", "d"), ("XX9-99", "e"), ("Pol-1_ATitel", "f")], "stem string, path string")
    hits = citations.resolved(citations.cited(a, ["id"], "a").where("back = '' and not cut").select("id", "nr").distinct(), docs.select("stem"))
    assert {(r["nr"], r["stem"]) for r in hits.collect()} == {("HK1-2", "HK1-2"), ("XX9-9", "XX9-9_b"), ("XX9-9", "XX9-9 d")}
    cut = spark.createDataFrame([(1, "HK"), (2, "Pol-1"), (3, "XX9-9_")], "id int, nr string")
    assert {(r["id"], r["stem"]) for r in citations.resolved_cut(cut, docs).collect()} == {(2, "Pol-1_ATitel"), (3, "XX9-9_b")}
    known = docs.where("stem = 'HK1-2'")
    assert {r["id"] for r in citations.resolved_cut(cut, docs, known).collect()} == {1, 2, 3}
    long = spark.createDataFrame([(1, "Pol-1_A")], "id int, nr string")
    assert citations.resolved(long, docs).first()["stem"] == "Pol-1_ATitel"
    out = {r["id"]: r["linked"] for r in citations.linked(a, ["id"], "a", docs).collect()}
    assert out[2] is None and out[1].count("<a href") == 2 + 2 + 1 + 1 and out[1].count("page=5") == 1 and "[Nr HK…]" in out[1]


def test_replies(spark):
    assert replies.name_list('se [Nr 12, sida 3]: ["Anna", " anna ", 3, "Bo"] ["x"]') == ["Anna", "Bo"]
    assert replies.name_list("[") == replies.name_list(None) == []
    df = spark.createDataFrame([(1, 'x {"observationer": [{"person": "A", "plats": "B", "citat": "C", "confidence": "sure"}, {"person": " ", "plats": "B", "citat": "C"}]}'), (2, "{"), (3, None)], "id int, raw string")
    got = replies.observations(df, ["id"], "raw").collect()
    assert [(r["id"], r["person"], r["confidence"]) for r in got] == [(1, "A", "medium")]


def test_item_key_is_canonical(spark):
    import hashlib

    got = spark.range(1).select(review.item_key(F.lit('a"å'), F.lit(3), "entity", F.lit(0))).first()[0]
    assert got == hashlib.sha256('["a\\"å",3,"entity",0]'.encode()).hexdigest()


def test_files(spark, tmp_path):
    (tmp_path / "a.bin").write_bytes(b"%PDF-1.7 x")
    (tmp_path / "b.bin").write_bytes(b"RIFF0000WEBP")
    (tmp_path / "c.bin").write_bytes(b"")
    got = {r["path"][-5:]: r["extension"] for r in files.sniffed(spark, str(tmp_path / "*.bin")).collect()}
    assert got == {"a.bin": ".pdf", "b.bin": ".webp"}
    (tmp_path / "Å b.txt").write_text("sida ett\fsida två", encoding="utf-8")
    r = files.text_documents(spark, str(tmp_path)).first()
    assert r["stem"] == "Å b" and r["text"].count("\f") == 1 and r["text_mtime"] > 1e9
    (tmp_path / "list.csv").write_text("rubrik,x\nnr,link,titel\n1,https://h/d/abc,T\n2,,U\n")
    assert [r["link"] for r in files.link_list(spark, str(tmp_path / "list.csv"), "link").collect()] == ["https://h/d/abc"]
    (tmp_path / "log.txt2").write_text("\n".join(f"rad {i}" for i in range(20)))
    assert [r["line"] for r in files.log_tail(spark, str(tmp_path / "log.txt2"), 3).orderBy("back").collect()] == ["rad 19", "rad 18", "rad 17"]


def test_order_and_headers(spark):
    assert forms.order_outliers([(1, 0, 0), (2, 0, 10), (3, 0, 90), (4, 0, 30), (5, 0, 40)]) == {2}  # places, from 0
    assert forms.order_outliers([]) == set()
    df = spark.createDataFrame([("Förhörsledare: Anna\nBerg\nTolk Bo\n\nTolk x",), (None,)], "t string")
    got = [[(r["label"], r["value"]) for r in x[0]] for x in df.select(forms.header_fields(F.col("t"), ("Förhörsledare", "Tolk"))).collect()]
    assert got == [[("Förhörsledare", "Anna Berg"), ("Tolk", "Bo")], []]


def test_small_rules(spark):
    from pagewright.operators import state

    assert [state.clamp(x, 5, 50, 20) for x in (None, "x", 3, 99, "7")] == [20, 20, 5, 50, 7]
    df = spark.createDataFrame([(404,), (429,), (500,)], "s int")
    assert [r[0] for r in df.select(state.failure_note(F.col("s"))).collect()] == ["failed:404", None, None]
    cur = spark.createDataFrame([(1, "a"), (2, "b")], "k int, v string")
    hist = spark.createDataFrame([], "k int, v string, reason string")
    assert [tuple(r) for r in state.archived(hist, cur, cur.where("k = 2").select("k"), ["k"], "rescan").collect()] == [(2, "b", "rescan")]
    kept, gone = state.reset_orphans(cur, cur.where("k = 1").select("k"), "k")
    assert kept.count() == gone.count() == 1 and gone.first()["action"] == "reset"
