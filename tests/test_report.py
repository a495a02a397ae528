"""The audit report's template, blocked pages, update time of a found sitemap,
names of replayed batches."""

from pyspark.sql import functions as F

from crawlscope.operators import audit as A
from crawlscope.operators import extract as X
from crawlscope.operators import robots as R
from crawlscope.operators import sitemaps as S
from crawlscope.streaming import pipeline as SP


def test_report_follows_the_template(spark):
    rows = [("AU-2", "medium", A.DEFECT, "json:s", "https://a/1", "twice", "Counts", "Fix"), ("AU-1", "critical", A.DEFECT, "json:s", "scan", "id", "Shape", "Fix"),
            ("AU-13", "low", A.OBSERVATION, "entities", "x", None, "Context", "Declare")]
    coverage = spark.createDataFrame([("s", "AU-9", "json", "unavailable", "cut"), ("t", "AU-9", "json", "checked", ""), ("s", "AU-16", "csv", "unavailable", "no artifact"),
                                      ("s", "", "csv", "limit", "ids")], "scan_id string, check_id string, format string, state string, reason string")
    lines = [r.line for r in A.render_report(spark.createDataFrame(rows, A.FINDING_SCHEMA), coverage).orderBy("rank", "key").collect()]
    assert lines[0] == "# Export Audit\n\n## Findings\n\n2 export/data defects."
    assert lines[1] == ("\n### [critical] AU-1: Shape\n- Category: export/data defect\n- Location: json:s scan\n- Evidence: id\n- Impact: Shape\n"
                        "- Recommendation: Fix")
    assert lines[2].startswith("\n### [medium] AU-2") and lines[3].startswith("\n### [low] AU-13") and "- Evidence: \n" in lines[3]
    assert lines[4:] == ["\n## Coverage\n- Artifacts checked: csv 0, json 2", "- Check AU-16 of csv unavailable for 1 scans",
                         "- Check AU-9 of json unavailable for 1 scans", "- Summary: critical 1, high 0, medium 1, low 1, info 0"]


def test_forbidden_requests_become_blocked_pages(spark):
    requests = spark.createDataFrame([("s", "https://a/x/1", 1, None), ("s", "https://a/y", 2, None), ("t", "https://a/x/2", 3, None), ("u", "https://a/x/3#f", 4, None)],
                                     "scan_id string, url string, seq long, sitemap_source string")
    docs = spark.createDataFrame([(s, "User-agent: *\nDisallow: /x\n") for s in "stu"], "scan_id string, body string")
    scans = spark.createDataFrame([("s", True), ("t", False), ("u", True)], "scan_id string, respect_robots boolean")
    fetch, forbidden = R.split_blocked(requests, docs, scans)
    assert sorted(r.seq for r in fetch.collect()) == [2, 3] and fetch.columns == requests.columns
    pages = {r.url: r for r in X.blocked_pages(forbidden, R.MSG_BLOCKED).collect()}
    assert set(pages) == {"https://a/x/1", "https://a/x/3"}
    assert all((p.status, p.http_status, p.error, p.block_count) == ("blocked", None, "Blocked by robots.txt", 0) for p in pages.values())


def test_found_sitemap_updates_the_scan(spark):
    scans = spark.createDataFrame([("a", None, 5), ("b", "https://b/m.xml", 5), ("c", None, 5)], "scan_id string, sitemap_url string, updated_ms long")
    urls = spark.createDataFrame([("a", "u", "https://a/2.xml", "2"), ("a", "u", "https://a/1.xml", "1"), ("b", "u", "https://b/x.xml", "1")],
                                 "scan_id string, url string, source string, order_key string")
    got = {r.scan_id: (r.sitemap_url, r.updated_ms) for r in S.scan_sitemap_url(scans, urls, F.lit(9).cast("long")).collect()}
    assert got == {"a": ("https://a/1.xml", 9), "b": ("https://b/m.xml", 5), "c": (None, 5)}


def test_replays_have_one_name():
    assert SP.run_name("/c/x", 3) == SP.run_name("/c/x", 3) != SP.run_name("/c/y", 3)
    assert SP.run_name("/c/x", 1).endswith("-1")
