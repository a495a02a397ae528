"""Readers (SRC-1, SRC-2), artifact inventory (AU-21), typed events (STR-4),
direct sitemap override (SM-4)."""

import os
import tempfile

from crawlscope.operators import audit as A
from crawlscope.operators import robots as R
from crawlscope.operators import sitemaps as S
from crawlscope.sources import crawl
from crawlscope.streaming import pipeline as SP


def test_readers(spark):
    root = tempfile.mkdtemp(prefix="crawlscope-src-")
    rows = [("s", "https://a/", 200, "text/html", "3", None, "<p>", None, 5, 1)]
    spark.createDataFrame(rows, crawl.RESPONSE_SCHEMA).write.parquet(f"{root}/resp")
    assert crawl.read_responses(spark, f"{root}/resp").first().http_status == 200
    os.makedirs(f"{root}/docs/scan_id=s1")
    with open(f"{root}/docs/scan_id=s1/robots.txt", "w") as fh:
        fh.write("User-agent: *\nDisallow: /x\n")
    d = crawl.read_documents(spark, f"{root}/docs").first()
    assert d.scan_id == "s1" and d.body.startswith("User-agent")


def test_inventory(spark, tmp_path):
    from crawlscope.operators import ranges as RG
    doc = '{\n  "formatVersion": 1,\n  "scan": {},\n  "pages": []\n}'
    for name, text in (("a-schema-scan.json", doc), ("b-x-schema-page.json", doc[:-4]), ("c.csv", "h\nrow"), ("d.csv", "h\nrow\n"), ("e.txt", "x")):
        (tmp_path / name).write_text(text)
    found = A.artifact_inventory(A.read_artifacts(RG.file_ranges(spark, str(tmp_path), 8))).collect()
    got = {r.name: (r.format, r.scope, r.complete) for r in found}
    assert got == {"a-schema-scan.json": ("json", "site", True), "b-x-schema-page.json": ("json", "page", False),
                   "c.csv": ("csv", "site", False), "d.csv": ("csv", "site", False)}  # no row of six cells

def test_typed_events(spark):
    ctl = spark.createDataFrame([("a", "started", 1, None), ("a", "error", 3, "boom")],
                                "scan_id string, type string, seq long, message string")
    pages = spark.createDataFrame([("a", 2)], "scan_id string, seq long")
    got = [(r.event, r.message) for r in SP.typed_events(ctl, pages).orderBy("seq").collect()]
    assert got == [("scan_state", None), ("page_completed", None), ("scan_error", "boom")]


def test_direct_sitemap_override(spark):
    scans = spark.createDataFrame([("d", "https://a/", "https://a/custom.xml"), ("n", "https://b/", None)],
                                  "scan_id string, target_url string, sitemap_url string")
    robots = spark.createDataFrame([("n", "Sitemap: https://b/r.xml\n")], "scan_id string, body string")
    queue, errs = S.candidates(scans, R.sitemaps(robots), robots)
    got = sorted((r.scan_id, r.pos, r.source) for r in queue.collect())
    assert got == [("d", 0, "https://a/custom.xml"), ("n", 0, "https://b/sitemap.xml"),
                   ("n", 1, "https://b/sitemap_index.xml"), ("n", 2, "https://b/r.xml")]
    assert errs.count() == 0
