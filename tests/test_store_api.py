"""Stored-table API: lookups, listings, child replacement, cascade, partitioned
write/read with commit markers, scope, and audit report helpers."""

import hashlib
import tempfile
from collections import Counter

import pytest
from pyspark.sql import functions as F

from crawlscope.operators import audit as A
from crawlscope.operators import exports as EX
from crawlscope.operators import store as ST


@pytest.fixture()
def tables(spark):
    scans = spark.createDataFrame([("s1", "https://a/", 1), ("s2", "https://b/", 2)],
                                  "scan_id string, target_url string, created_ms long")
    pages = spark.createDataFrame([("p2", "s1", "https://a/z", "success"), ("p1", "s1", "https://a/b", "no_jsonld"),
                                   ("p3", "s2", "https://b/x", "success")],
                                  "page_id string, scan_id string, url string, status string")
    blocks = spark.createDataFrame([("b2", "p2", 1, "s1"), ("b1", "p2", 0, "s1"), ("b3", "p3", 0, "s2")],
                                   "block_id string, page_id string, ordinal int, scan_id string")
    ents = spark.createDataFrame([("e1", "b1", "p2", "000000001", "s1"), ("e0", "b1", "p2", "000000000", "s1"),
                                  ("e3", "b3", "p3", "", "s2")],
                                 "entity_id string, block_id string, page_id string, entity_path string, scan_id string")
    return scans, pages, blocks, ents


def test_lookups_raise_not_found(spark, tables):
    scans, pages, _, _ = tables
    assert ST.get_scan(scans, "s1").count() == 1
    with pytest.raises(ST.NotFound, match="Scan not found: nope"):
        ST.get_scan(scans, "nope")
    assert ST.get_page(pages, "s1", "p1").first().url == "https://a/b"
    with pytest.raises(ST.NotFound, match="Page not found: p3"):
        ST.get_page(pages, "s1", "p3")
    assert ST.latest_scan(scans).first().scan_id == "s2"


def test_listings_ordered(spark, tables):
    _, pages, blocks, ents = tables
    assert [r.url for r in ST.list_pages(pages, "s1").collect()] == ["https://a/b", "https://a/z"]
    assert [r.url for r in ST.list_pages(pages, "s1", "success").collect()] == ["https://a/z"]
    assert [r.ordinal for r in ST.page_blocks(blocks, "p2").collect()] == [0, 1]
    assert [r.entity_id for r in ST.page_entities(ents.drop("page_id"), blocks, "p2").collect()] == ["e0", "e1"]
    assert ST.scan_blocks(blocks.drop("scan_id"), pages).filter("scan_id = 's1'").count() == 2
    assert ST.scan_entities(ents.drop("scan_id", "page_id"), blocks, pages).filter("scan_id = 's2'").count() == 1


def test_replace_children_and_cascade(spark, tables):
    scans, pages, blocks, ents = tables
    new_pages = pages.filter("page_id = 'p2'")
    new_blocks = spark.createDataFrame([("b9", "p2", 0, "s1")], blocks.schema)
    new_ents = spark.createDataFrame([], ents.schema)
    b, e = ST.replace_children(blocks, ents, new_pages, new_blocks, new_ents)
    assert sorted(r.block_id for r in b.collect()) == ["b3", "b9"]
    assert [r.entity_id for r in e.collect()] == ["e3"]
    keep = spark.createDataFrame([("s2",)], "scan_id string")
    s, p, b2, e2 = ST.cascade_delete(scans, pages, blocks, ents, keep)
    assert (s.count(), p.count(), b2.count(), e2.count()) == (1, 1, 1, 1)


def test_write_read_commit_marker(spark, tables):
    scans, pages, blocks, ents = tables
    root = tempfile.mkdtemp(prefix="crawlscope-store-")
    ST.write_scan_tables(spark, root, {"pages": pages, "jsonld_blocks": blocks, "schema_entities": ents,
                                       "scans": scans})
    ST.write_scan_tables(spark, root, {"pages": pages.filter("scan_id = 's1'").withColumn("status", F.lit("x"))})
    back = ST.read_scan_tables(spark, root)
    got = {(r.scan_id, r.status) for r in back["pages"].collect()}
    assert ("s2", "success") in got and ("s1", "x") in got and ("s1", "success") not in got
    assert back["jsonld_blocks"].count() == blocks.count()  # tables that a run does not write keep their rows
    none = {"pages": pages.filter("scan_id = 's1'"), "jsonld_blocks": blocks.limit(0), "schema_entities": ents.limit(0)}
    ST.write_scan_tables(spark, root, none)
    back = ST.read_scan_tables(spark, root)
    assert {r.scan_id for r in back["jsonld_blocks"].collect()} == {r.scan_id for r in back["schema_entities"].collect()} == {"s2"}
    assert {r.scan_id for r in back["scans"].collect()} == {"s1", "s2"}


def test_persist_refuses_foreign_children(spark, tables):
    import pytest
    _, pages, blocks, ents = tables
    root = tempfile.mkdtemp(prefix="crawlscope-store-")
    with pytest.raises(ValueError, match="do not belong"):
        ST.persist_pages(spark, root, pages.filter("page_id = 'p1'"), blocks, ents)


def test_scope_and_report_helpers(spark, tables):
    _, pages, _, _ = tables
    assert EX.page_scope(pages, "p1").count() == 1 and EX.page_scope(pages, None).count() == 3
    empty = spark.createDataFrame([], A.FINDING_SCHEMA)
    summary = {r.severity: r.findings for r in A.severity_summary(empty).collect()}
    assert summary == {s: 0 for s in A.SEVERITIES}
    head = A.render_report(empty).orderBy("rank").first().line
    assert "No export/data defects found." in head


def lookups(spark, folder, rows):
    """Rows of st_lookups over pages (page_id, url), how often each comes."""
    from crawlscope.plans import catalog
    pages = [(k, url, f"<html><head><title>{k}</title></head></html>") for k, url in rows]
    spark.createDataFrame(pages, "page_id long, url string, html string").write.parquet(f"{folder}/pages.parquet")
    parts = [(k, f"name {k}", "brand", k) for k in sorted({k for k, _ in rows})]
    spark.createDataFrame(parts, "p_partkey long, p_name string, p_brand string, p_size int").write.parquet(f"{folder}/part.parquet")
    return Counter(tuple(r) for r in catalog.st_lookups(spark, str(folder)).collect())


NOPE = [("ST-1", "nope", "Scan not found: nope"), ("ST-7", "nope", "Page not found: nope")]


def test_lookups_of_a_scan_without_blocks(spark, tmp_path):
    """The host of most pages has a private address, so none of them has blocks;
    pages without URL belong to no scan."""
    base, other = "https://a.example.org", "https://ab.example.org"
    got = lookups(spark, tmp_path / "rejected", [(1, base + "/x"), (2, base + "/y"), (10, other + "/z"), (3, None), (4, None), (5, None)])
    assert got == Counter([("ST-1", base, base + "/"), ("ST-3", base + "/x", "fetch_error"), ("ST-3", base + "/y", "fetch_error"), ("ST-13", None, "0 0"), *NOPE])
    assert lookups(spark, tmp_path / "no_url", [(3, None)]) == lookups(spark, tmp_path / "empty", []) == Counter([("ST-13", None, "0 0"), *NOPE])


def test_lookups_of_urls_requested_twice(spark, tmp_path):
    """The last snapshot of a URL is its page; each block and entity is found once."""
    base = "https://ab.example.org"
    got = lookups(spark, tmp_path, [(1, base + "/ab"), (10, base + "/ab"), (17, base + "/pag"), (26, base + "/pag#top"), (34, base + "/pag"), (48, base + "/q"), (48, base + "/q")])
    paths = (("0000000000", "WebPage"), ("0000000002.0000000000", "Product"), ("0000000002.0000000001", "Offer"))

    def text(k):
        return ('[{"name":"name %d","@type":"WebPage","@context":"https://schema.org"},"plain",{"@graph":[{"name":"name %d","@type":"Product"},'
                '{"price":"%d","@type":["Offer",7]}],"@context":"https://schema.org"}]' % (k, k, k))

    def md5(x):
        return hashlib.md5(x.encode()).hexdigest()
    statuses = [("/ab", "success"), ("/pag", "success"), ("/q", "no_jsonld")]
    assert got == Counter([
        ("ST-1", base, base + "/"), *[("ST-3", base + u, s) for u, s in statuses], *[("ST-3 success", base + u, s) for u, s in statuses if s == "success"],
        ("ST-7", hashlib.sha256(f"{base}|{base}/ab".encode()).hexdigest(), base + "/ab"),
        ("ST-8", "0", md5(text(10))), *[("ST-9", f"0/{p}", kind) for p, kind in paths],
        ("ST-10", base + "/ab#0", md5(text(10))), ("ST-10", base + "/pag#0", md5(text(34))),
        *[("ST-11", f"{base}{u}#0/{p}", kind) for u in ("/ab", "/pag") for p, kind in paths], ("ST-13", base + "/ab", "1 3"), *NOPE])
