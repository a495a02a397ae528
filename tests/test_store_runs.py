"""The store's runs: snapshots, empty tables, two writers, replays, pruned
reads, removal of old runs."""

import pytest
from pyspark.sql import functions as F

from crawlscope.operators import store as ST

PAGE = "page_id string, scan_id string, url string, normalized_url string, status string, seq long, created_seq long"
BLOCK = "block_id string, page_id string, ordinal int, raw_text string, scan_id string"
ENTITY = "entity_id string, block_id string, page_id string, entity_path string, scan_id string"


def page(page_id, scan, url, seq, status="success"):
    return (page_id, scan, url, url, status, seq, seq)


def frames(spark, pages, blocks=(), entities=(), extra=""):
    return (spark.createDataFrame(list(pages), PAGE), spark.createDataFrame(list(blocks), BLOCK + extra), spark.createDataFrame(list(entities), ENTITY + extra))


def stored(spark, root):
    t = ST.read_scan_tables(spark, root)
    return ({(r.scan_id, r.url): (r.page_id, r.seq, r.created_seq, r.status) for r in t["pages"].collect()},
            {(r.page_id, r.block_id) for r in t["jsonld_blocks"].collect()}, {(r.page_id, r.entity_id) for r in t["schema_entities"].collect()})


def test_two_snapshots_on_an_empty_store(spark, tmp_path):
    root = str(tmp_path / "s")
    ST.persist_pages(spark, root, *frames(spark, [page("p1", "s", "u", 1, "no_jsonld"), page("p2", "s", "u", 2)],
                                          [("b1", "p1", 0, "x", "s"), ("b2", "p2", 0, "y", "s")], [("e1", "b1", "p1", "", "s"), ("e2", "b2", "p2", "", "s")]))
    assert stored(spark, root) == ({("s", "u"): ("p1", 2, 1, "success")}, {("p1", "b2")}, {("p1", "e2")})


def test_snapshots_that_share_an_id(spark, tmp_path):
    root = str(tmp_path / "s")
    extra = ", seq long"
    ST.persist_pages(spark, root, *frames(spark, [page("p", "s", "u", 1), page("p", "s", "u", 2)],
                                          [("b", "p", 0, "old", "s", 1), ("b", "p", 0, "new", "s", 2)], [("e", "b", "p", "", "s", 2)], extra))
    t = ST.read_scan_tables(spark, root)
    assert [r.raw_text for r in t["jsonld_blocks"].collect()] == ["new"] and t["schema_entities"].count() == 1
    assert t["jsonld_blocks"].columns == ["block_id", "page_id", "ordinal", "raw_text", "scan_id"] or set(t["jsonld_blocks"].columns) == {
        "block_id", "page_id", "ordinal", "raw_text", "scan_id"}


def test_later_snapshots_replace_children_and_earlier_ones_do_not(spark, tmp_path):
    root = str(tmp_path / "s")
    ST.persist_pages(spark, root, *frames(spark, [page("p1", "s", "u", 5), page("q", "s", "v", 5)], [("b1", "p1", 0, "x", "s"), ("b9", "q", 0, "x", "s")],
                                          [("e9", "b9", "q", "", "s")]))
    ST.persist_pages(spark, root, *frames(spark, [page("p2", "s", "u", 7, "http_error")], [("b2", "p2", 0, "x", "s")]))
    ST.persist_pages(spark, root, *frames(spark, [page("p3", "s", "u", 6, "fetch_error")], [("b3", "p3", 0, "x", "s")]))
    pages, blocks, entities = stored(spark, root)
    assert pages == {("s", "u"): ("p1", 7, 5, "http_error"), ("s", "v"): ("q", 5, 5, "success")}
    assert blocks == {("p1", "b2"), ("q", "b9")} and entities == {("q", "e9")}


def test_tables_without_rows_are_read(spark, tmp_path):
    root = str(tmp_path / "s")
    ST.persist_pages(spark, root, *frames(spark, [page("p", "s", "u", 1)]))
    t = ST.read_scan_tables(spark, root)
    assert (t["pages"].count(), t["jsonld_blocks"].count(), t["schema_entities"].count()) == (1, 0, 0)
    assert "raw_text" in t["jsonld_blocks"].columns
    ST.persist_pages(spark, root, *frames(spark, [page("p", "s", "u", 2)], [("b", "p", 0, "x", "s")]))
    ST.persist_pages(spark, root, *frames(spark, [page("p", "s", "u", 3)]))
    assert stored(spark, root)[1] == set()
    assert ST.read_scan_tables(spark, str(tmp_path / "nothing")) == {}


def test_two_writers_never_share_a_number(spark, tmp_path, monkeypatch):
    """Another run is committed between a writer's look and its commit."""
    root = str(tmp_path / "s")
    ST.persist_pages(spark, root, *frames(spark, [page("p", "s", "u", 1)]))
    create, raced = ST._create, []

    def other_first(spark_, path, text):
        if not raced:
            raced.append(1)
            ST.persist_pages(spark, root, *frames(spark, [page("q", "s", "v", 1)], [("b", "q", 0, "x", "s")]))
        return create(spark_, path, text)
    monkeypatch.setattr(ST, "_create", other_first)
    ST.persist_pages(spark, root, *frames(spark, [page("r", "s", "w", 1)]))
    pages, blocks, _ = stored(spark, root)
    assert set(pages) == {("s", "u"), ("s", "v"), ("s", "w")} and blocks == {("q", "b")}
    assert [c.seq for c in ST.commits(spark, root)] == [1, 2, 3]


def test_a_replayed_run_is_written_once(spark, tmp_path, monkeypatch):
    root = str(tmp_path / "s")
    rows = frames(spark, [page("p", "s", "u", 1)], [("b", "p", 0, "x", "s")])
    publish = ST._publish

    def dies(*a):
        raise RuntimeError("lost")
    monkeypatch.setattr(ST, "_publish", dies)
    with pytest.raises(RuntimeError):
        ST.persist_pages(spark, root, *rows, run="batch-0")
    assert ST.read_scan_tables(spark, root) == {}
    monkeypatch.setattr(ST, "_publish", publish)
    for _ in range(2):
        assert ST.persist_pages(spark, root, *rows, run="batch-0") == "batch-0"
    assert stored(spark, root)[1] == {("p", "b")} and len(ST.commits(spark, root)) == 1


def test_a_lookup_opens_one_folder(spark, tmp_path):
    root = str(tmp_path / "s")
    for k in range(2):
        ST.persist_pages(spark, root, *frames(spark, [page(f"p{n}", f"s{n}", "u", k) for n in range(30)], [(f"b{n}", f"p{n}", 0, "x", f"s{n}") for n in range(30)]))
    t = ST.read_scan_tables(spark, root, "s7")
    plan = t["pages"]._jdf.queryExecution().explainString(spark._jvm.org.apache.spark.sql.execution.ExplainMode.fromString("formatted"))
    found = next(line for line in plan.split("\n") if "PartitionFilters" in line)
    assert "bucket#" in found and "xxhash64" not in found  # a number by then
    (run,) = {f.split("/run=")[1].split("/")[0] for f in t["pages"].inputFiles()}
    assert run == [c.mark for c in ST.commits(spark, root)][-1]
    assert [r.page_id for r in t["pages"].collect()] == ["p7"] and t["jsonld_blocks"].count() == 1
    assert ST.read_scan_tables(spark, root, "none")["pages"].count() == 0


def test_old_runs_are_removed(spark, tmp_path):
    import os
    root = str(tmp_path / "s")
    runs = [ST.persist_pages(spark, root, *frames(spark, [page(f"p{n}", f"s{n}", "u", k) for n in range(3 - k)])) for k in range(3)]
    ST.persist_pages(spark, root, *frames(spark, [page("p0", "s0", "u", 9)]), run="last")
    before = stored(spark, root)
    assert ST.compact(spark, root) == [runs[2]]  # the others still hold a scan
    assert stored(spark, root) == before and len(ST.commits(spark, root)) == 1
    assert set(os.listdir(f"{root}/pages")) >= {"run=last", f"run={runs[0]}", f"run={runs[1]}"}
    ST.persist_pages(spark, root, *frames(spark, [page(f"p{n}", f"s{n}", "u", 10) for n in range(3)]))
    assert set(ST.compact(spark, root)) == {"last", runs[0], runs[1]}
    assert {v[1] for v in stored(spark, root)[0].values()} == {10} and F is not None


def test_roundtrip_of_urls_requested_twice(spark, tmp_path):
    """Two rows of one URL are two snapshots: the first gives the number, the
    last the children; rows that come twice are one."""
    import hashlib

    from crawlscope.plans import catalog

    base = "https://ab.example.org"
    rows = [(k, base + path, f"<html><head><title>{k}</title></head></html>") for k, path in ((1, "/ab"), (10, "/ab"), (17, "/pag"), (34, "/pag"), (49, "/abcd"), (49, "/abcd"))]
    spark.createDataFrame(rows, "page_id long, url string, html string").write.parquet(f"{tmp_path}/pages.parquet")
    spark.createDataFrame([(k, f"name {k}", "brand", k) for k in (1, 10, 17, 34, 49)], "p_partkey long, p_name string, p_brand string, p_size int").write.parquet(f"{tmp_path}/part.parquet")
    got = {r.url: r for r in catalog.st_persist_roundtrip(spark, str(tmp_path)).collect()}

    def text(k):
        return ('[{"name":"name %d","@type":"WebPage","@context":"https://schema.org"},"plain",{"@graph":[{"name":"name %d","@type":"Product"},'
                '{"price":"%d","@type":["Offer",7]}],"@context":"https://schema.org"}]' % (k, k, k))
    assert {u: (r.created_seq, r.seq, r.ordinals, r.n_entities) for u, r in got.items()} == {
        base + "/ab": (2, 20, "0", 3), base + "/pag": (34, 68, "0", 3), base + "/abcd": (98, 1_000_000_098, "", 0)}
    assert [got[base + u].texts for u in ("/ab", "/pag")] == [hashlib.md5(text(k).encode()).hexdigest() for k in (10, 34)]
    assert got[base + "/pag"].page_id.startswith("old-") and not got[base + "/ab"].page_id.startswith("old-")
