"""Export names (URL-9/10, SNK-9), status labels and listing (EX-9), settings rounding (EX-10)."""

from pyspark.sql import functions as F

from crawlscope.operators import exports as EX
from crawlscope.operators import urlset as U


def test_export_names(spark):
    rows = [("https://Shop.Example.com/", "https://shop.example.com/"),
            ("https://shop.example.com/", "https://shop.example.com/a/b/c%20d.html"),
            ("not a url", None),
            ("https://shop.example.com/", "https://shop.example.com/" + "x" * 120)]
    df = spark.createDataFrame(rows, "target string, page string")
    got = [(r.site_basename, r.page_basename) for r in U.export_names(df, "target", "page").collect()]
    assert got[0] == ("shop.example.com-schema-scan", "shop.example.com-home-schema-page")
    assert got[1] == ("shop.example.com-schema-scan", "shop.example.com-b-c-20d.html-schema-page")
    assert got[2] == ("scan-schema-scan", "scan-page-schema-page")
    assert got[3][1] == "shop.example.com-" + "x" * 80 + "-schema-page"
    ext = spark.createDataFrame([("json",), ("markdown",), ("csv",)], "f string").select(U.export_extension("f"))
    assert [r[0] for r in ext.collect()] == ["json", "md", "csv"]


def test_status_labels_and_listing(spark):
    pages = spark.createDataFrame([("s", "u1", "ok", 200, None), ("s", "u2", "weird_state", None, ""),
                                   ("s", "u3", "http_error", 404, "HTTP 404")],
                                  "scan_id string, url string, status string, http_status int, error string")
    got = [(r.status_label, r.http, r.error) for r in EX.page_listing(pages).orderBy("url").collect()]
    assert got == [("Success", "200", "-"), ("weird state", "-", "-"), ("HTTP error", "404", "HTTP 404")]


def test_settings_round_half_up(spark):
    df = spark.createDataFrame([(1, '{"maxRedirects": 2.5, "delayMs": -0.4, "timeoutMs": 1000}')], "id int, s string")
    r = U.normalize_settings(df, "s").first()
    assert r.max_redirects == 3 and r.delay_ms == 250 and r.timeout_ms == 1000
    assert F is not None
