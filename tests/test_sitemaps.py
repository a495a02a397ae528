"""Sitemap parsing, redirects, traversal order, cycles and errors."""

from pyspark.sql import functions as F

from crawlscope.operators import sitemaps as S

SCHEMA = "scan_id string, url string, http_status int, location string, body string"


def discover(spark, rows, queue, limit=5_000_000, hops=5, same=True, dns=None):
    docs = spark.createDataFrame(rows, SCHEMA)
    q = spark.createDataFrame(queue, "scan_id string, source string, pos int")
    scans = spark.createDataFrame([("s", limit, hops, same)], "scan_id string, max_response_bytes long, max_redirects int, same_origin_only boolean")
    d = S.discover(q, S.parse_documents(docs), scans, dns)
    urls = [r.url for r in d.urls.orderBy("order_key").collect()]
    errs = {r.source: r.message for r in d.errors.collect()}
    return urls, errs


def test_index_cycle_and_order(spark):
    rows = [("s", "https://a/idx.xml", 200, None,
             "<sitemapindex><sitemap><loc>https://a/one.xml</loc></sitemap>"
             "<sitemap><loc>https://a/idx.xml#x</loc></sitemap><sitemap><loc>https://a/two.xml</loc></sitemap>"
             "</sitemapindex>"),
            ("s", "https://a/one.xml", 200, None, "<urlset><url><loc> https://a/1 </loc></url></urlset>"),
            ("s", "https://a/two.xml", 200, None, "<urlset><url><loc>https://a/2?x=1&amp;y=2</loc></url></urlset>")]
    urls, errs = discover(spark, rows, [("s", "https://a/idx.xml", 0), ("s", "https://a/one.xml", 1)])
    assert urls == ["https://a/1", "https://a/2?x=1&amp;y=2"]
    assert errs == {}


def test_errors_continue(spark):
    rows = [("s", "https://a/bad.xml", 200, None, "<urlset><url>"),
            ("s", "https://a/empty.xml", 200, None, "<urlset/>"),
            ("s", "https://a/404.xml", 404, None, ""),
            ("s", "https://a/ok.xml", 200, None, "<urlset><url><loc>https://a/p</loc></url></urlset>")]
    urls, errs = discover(spark, rows, [("s", "https://a/bad.xml", 0), ("s", "https://a/empty.xml", 1),
                                        ("s", "https://a/404.xml", 2), ("s", "http://127.0.0.1/s.xml", 3),
                                        ("s", "https://a/missing.xml", 4), ("s", "https://a/ok.xml", 5)])
    assert urls == ["https://a/p"]
    assert errs["https://a/bad.xml"].startswith(S.MSG_INVALID_PREFIX)
    assert errs["https://a/empty.xml"] == S.MSG_ROOT
    assert errs["https://a/404.xml"] == "HTTP 404"
    assert errs["http://127.0.0.1/s.xml"] == "Target must not resolve to a private network"
    assert errs["https://a/missing.xml"] == S.MSG_NO_DOCUMENT


def test_redirects_followed_and_limited(spark):
    rows = [("s", "https://a/r1.xml", 301, "/r2.xml", ""),
            ("s", "https://a/r2.xml", 302, "https://a/final.xml", ""),
            ("s", "https://a/final.xml", 200, None, "<urlset><url><loc>https://a/x</loc></url></urlset>"),
            ("s", "https://a/loop.xml", 302, "/loop.xml", ""),
            ("s", "https://a/away.xml", 302, "https://b/final.xml", ""),
            ("s", "https://a/noloc.xml", 302, None, "")]
    urls, errs = discover(spark, rows, [("s", "https://a/r1.xml", 0), ("s", "https://a/loop.xml", 1),
                                        ("s", "https://a/away.xml", 2), ("s", "https://a/noloc.xml", 3)])
    assert urls == ["https://a/x"]
    assert errs["https://a/loop.xml"] == S.MSG_REDIRECT_LIMIT
    assert errs["https://a/away.xml"] == S.MSG_OUTSIDE
    assert errs["https://a/noloc.xml"] == "HTTP 302"
    assert F is not None


def test_redirect_to_missing_document(spark):
    rows = [("s", "https://a/r.xml", 301, "/gone.xml", "")]
    urls, errs = discover(spark, rows, [("s", "https://a/r.xml", 0)])
    assert urls == [] and errs["https://a/r.xml"] == S.MSG_NO_DOCUMENT


def test_repeated_loc_entry_dropped(spark):
    rows = [("s", "https://a/m.xml", 200, None,
             "<urlset><url><loc>https://a/1</loc><loc>https://a/2</loc></url><url><loc>https://a/3</loc></url>"
             "<url>https://a/plain</url></urlset>")]
    urls, errs = discover(spark, rows, [("s", "https://a/m.xml", 0)])
    assert urls == ["https://a/3", "https://a/plain"] and errs == {}


def test_scan_settings_and_addresses_rule_discovery(spark):
    page = "<urlset><url><loc>https://a/p</loc></url></urlset>"
    rows = [("s", "https://a/1.xml", 200, None, page), ("s", "https://a/2.xml", 302, "https://b/2.xml", ""), ("s", "https://b/2.xml", 200, None, page),
            ("s", "https://a/3.xml", 301, "/1.xml", "")]
    queue = [("s", f"https://a/{i}.xml", i) for i in (1, 2, 3)]
    urls, errs = discover(spark, rows, queue, limit=10)
    assert urls == [] and set(errs.values()) == {S.MSG_TOO_LARGE, S.MSG_OUTSIDE}
    urls, errs = discover(spark, rows, queue, hops=0)
    assert len(urls) == 1 and errs["https://a/2.xml"] == errs["https://a/3.xml"] == S.MSG_REDIRECT_LIMIT
    dns = spark.createDataFrame([("a", "203.0.113.1"), ("b", "10.0.0.1")], "host string, address string")
    assert discover(spark, rows, queue, same=False, dns=dns)[1] == {"https://a/2.xml": "Target must not resolve to a private network"}
    assert discover(spark, rows, queue, dns=dns)[1] == {"https://a/2.xml": S.MSG_OUTSIDE}  # origin before addresses
    none = spark.createDataFrame([("a", None)], "host string, address string")
    assert set(discover(spark, rows, queue, dns=none)[1].values()) == {"Target must not resolve to a private network"}
    assert set(discover(spark, rows, queue, dns=none.limit(0))[1].values()) == {"Target hostname could not be resolved"}


def test_cdata_locations_are_literal(spark):
    rows = [("s", "https://a/1.xml", 200, None, "<urlset><url><loc><![CDATA[https://a/?x=1&y=2]]></loc></url>"
             "<url><loc>https://a/?x=1&amp;y=3</loc></url></urlset>")]
    assert discover(spark, rows, [("s", "https://a/1.xml", 0)])[0] == ["https://a/?x=1&y=2", "https://a/?x=1&amp;y=3"]


def test_transport_errors(spark):
    docs = spark.createDataFrame([("s", "https://a/1.xml", None, None, None, "timeout"), ("s", "https://a/2.xml", None, None, None, "reset")],
                                 SCHEMA + ", error string")
    assert sorted(r.error for r in S.parse_documents(docs).collect()) == [S.MSG_FAILED_PREFIX + "reset", S.MSG_TIMEOUT]
