"""Upsert, ownership, exports (cells, fences, placeholders), lifecycle fold, audit defects."""

from pyspark.sql import functions as F

from crawlscope.operators import audit as A
from crawlscope.operators import exports as EX
from crawlscope.operators import progress as P
from crawlscope.operators import store as ST


def test_upsert_keeps_first_id(spark):
    rows = [("p1", "s", "https://a/x", 1, 1, "ok"), ("p2", "s", "https://a/x", 2, 2, "later")]
    df = spark.createDataFrame(rows, "page_id string, scan_id string, normalized_url string, seq long, "
                                     "created_seq long, status string")
    out = ST.upsert_pages(df.limit(1), df.filter("seq = 2")).first()
    assert out.page_id == "p1" and out.created_seq == 1 and out.status == "later"


def test_ownership_rejects_orphan_entity(spark):
    pages = spark.createDataFrame([("p",)], "page_id string")
    blocks = spark.createDataFrame([("b", "p")], "block_id string, page_id string")
    ents = spark.createDataFrame([("e", "zz", "p")], "entity_id string, block_id string, page_id string")
    assert [r.page_id for r in ST.ownership_rejects(pages, blocks, ents).collect()] == ["p"]


def test_csv_cells_and_fence(spark):
    df = spark.createDataFrame([('a,"b"', "x```y"), (None, "plain")], "v string, raw string")
    got = df.select(EX.csv_cell("v").alias("c"), EX.md_fence("raw").alias("f")).collect()
    assert got[0].c == '"a,""b"""' and got[1].c == ""
    assert got[0].f.startswith("````json\n") and got[1].f.startswith("```json\n")


def test_csv_rows_shapes(spark):
    pages = spark.createDataFrame([("p1", "https://a/1,2"), ("p2", "https://a/2")], "page_id string, url string")
    blocks = spark.createDataFrame([("b1", "p1", 0, '{"a":1}', None), ("b2", "p1", 1, "{", "JSON-LD parse error: x")],
                                   "block_id string, page_id string, ordinal int, raw_text string, parse_error string")
    ents = spark.createDataFrame([("b1", "000000000", "https://schema.org", ["A", "B"], '{"a":1}')],
                                 "block_id string, entity_path string, context string, types array<string>, "
                                 "serialized string")
    lines = sorted(r.line for r in EX.csv_rows(pages, blocks, ents).collect())
    assert lines == ['"https://a/1,2",0,https://schema.org,A|B,valid,"{""a"":1}"',
                     '"https://a/1,2",1,,,invalid,{', "https://a/2,,,,,"]


def test_lifecycle_fold(spark):
    ev = spark.createDataFrame([("a", "started", 1, None), ("a", "urls_listed", 2, None), ("a", "cancel", 3, None),
                                ("a", "completed", 9, None), ("b", "started", 1, None), ("b", "cancel", 2, None),
                                ("b", "error", 5, "boom"), ("c", "started", 1, None)],
                               "scan_id string, type string, seq int, message string")
    got = {r.scan_id: (r.status, r.error) for r in P.scan_status(ev).collect()}
    assert got == {"a": ("canceled", None), "b": ("failed", "boom"), "c": ("discovering", None)}


def test_audit_required_properties(spark):
    pages = spark.createDataFrame([("p", "https://a/", "success", None)], "page_id string, url string, status string, error string")
    blocks = spark.createDataFrame([("b", "p", 0, None)], "block_id string, page_id string, ordinal int, parse_error string")
    ents = spark.createDataFrame([("p", "", "https://schema.org", ["Product"], '{"@type":"Product","name":""}')],
                                 "page_id string, entity_path string, context string, types array<string>, serialized string")
    got = {(r.evidence, r.severity) for r in A.observation_checks(pages, blocks, ents).filter("check_id = 'AU-14'").collect()}
    assert ("Product empty name", "medium") in got and ("Product no image", "low") in got
    assert F is not None


def test_audit_nested_offer(spark):
    pages = spark.createDataFrame([("p", "https://a/", "success", None)], "page_id string, url string, status string, error string")
    blocks = spark.createDataFrame([("b", "p", 0, None)], "block_id string, page_id string, ordinal int, parse_error string")
    ser = '{"@type":"Product","image":"i.png","name":"","offers":{"@type":"Offer","price":""}}'
    ents = spark.createDataFrame([("p", "", "https://schema.org", ["Product"], ser)],
                                 "page_id string, entity_path string, context string, types array<string>, serialized string")
    got = {(r.location, r.evidence, r.severity)
           for r in A.observation_checks(pages, blocks, ents).filter("check_id = 'AU-14'").collect()}
    assert ("https://a/#/offers[0]", "Offer empty price", "medium") in got
    assert ("https://a/#/offers[0]", "Offer no availability", "low") in got
    assert ("https://a/#", "Product empty name", "medium") in got
