"""Operations by name."""

import json

import pytest

from pagewright.plans import registry


def test_operations_run_by_name(spark, folder):
    docs = spark.read.parquet(f"{folder}/documents.parquet")
    assert registry.run("quality", docs.select("doc_id", "text")).count() == docs.count()
    assert registry.run("normalize", docs.selectExpr("doc_id as pdf_stem", "text")).where("changed").count() > 0
    assert 0 < registry.run("search_archive", docs, query="och", top_k=5).count() <= 5
    pages = spark.createDataFrame([("a", 1, "text")], "pdf_stem string, page_num int, text string")
    assert registry.run("get_page", pages, source="../a", page=1).first()["status"] == "refused"
    assert registry.run("get_page", pages, source="a").first()["text"] == "text"
    with pytest.raises(KeyError):
        registry.run("nothing")


def test_parameters_are_typed_and_hold_no_secrets():
    o = registry.OPERATIONS["worst"]
    assert json.loads(o.serialized({"limit": 3})) == {"limit": 3} and o.checked({}) == {"limit": 20}
    for bad in ({"limit": "3"}, {"limit": True}, {"other": 1}):
        with pytest.raises(ValueError):
            o.checked(bad)
    with pytest.raises(ValueError):
        registry.Operation("x", "", lambda: None, {"api_key": (str, "")}).serialized({"api_key": "s"})
