"""Fetch classification, JSON-LD extraction, strict parsing, flattening, page status."""

from pyspark.sql import functions as F

from crawlscope.functions import content as FC
from crawlscope.functions import jsonld as FJ
from crawlscope.operators import extract as X


def test_content_type_and_sizes(spark):
    df = spark.createDataFrame([(" Text/HTML; charset=utf-8 ", "4", "abcd", 4), (None, "4", "abcd", 3),
                                ("text/html", None, "éé", 3), ("text/html", "x", "éé", 4)],
                               "ct string, cl string, body string, mx int")
    out = df.select(FC.normalize_content_type("ct").alias("n"),
                    FC.fetch_outcome(F.lit(200), "ct", "cl", "body", "mx")["fetch_status"].alias("s")).collect()
    assert out[0].n == "text/html" and out[0].s == "ok"
    assert out[1].n == "" and out[1].s == "not_html"
    assert out[2].s == "too_large"
    assert out[3].s == "ok"


def test_http_error_and_redirect_classes(spark):
    df = spark.createDataFrame([(404,), (304,), (418,), (200,)], "s int")
    got = [r[0] for r in df.select(FC.http_status_class("s")).collect()]
    assert got == ["error", "redirect", "error", "ok"]


def scripts(spark, html):
    df = spark.createDataFrame([(html,)], "h string")
    return df.select(FJ.ld_json_scripts("h")).first()[0]


def test_tokenizer_cases(spark):
    html = ('<!-- <script type="application/ld+json">{"hidden":1}</script> -->'
            "<SCRIPT type='application/ld+json' data-x=\"a>b\">{\"a\":1}</SCRIPT >"
            '<script type="application/json">{"b":2}</script>'
            '<title><script type="application/ld+json">{"no":1}</script></title>'
            '<script type="application/ld+json"></script>'
            '<script type=application/ld+json>[1]</script>'
            '<script type="application/ld+json">{"tail":1}')
    assert scripts(spark, html) == ['{"a":1}', "", "[1]", '{"tail":1}']


def test_strict_json(spark):
    cases = ['{"a":1}', '{"a":1} x', "", "null", "1,2", '{"a":', "[1,2]", '"s"', '{"a":1,"a":2}']
    df = spark.createDataFrame([(c,) for c in cases], "r string")
    got = [r[0] for r in df.select(FJ.strict_json_valid("r")).collect()]
    assert got == [True, False, False, True, False, False, True, True, True]


def test_flattening_and_projections(spark):
    raw = ('[{"@context":"https://schema.org","@type":"WebPage"},'
           '{"@context":"x","@graph":[{"@type":["Product","Thing",3]},[{"@type":"Offer","@context":{"v":1}}]]},'
           '{"@graph":{"@type":"Nested"}}, 5, null]')
    blocks = spark.createDataFrame([("b", "p", 0, raw, None)],
                                   "block_id string, page_id string, ordinal int, raw_text string, parse_error string")
    out = X.entities_from_blocks(blocks).orderBy("entity_path").collect()
    assert [r.entity_path for r in out] == ["0000000000", "0000000001.0000000000", "0000000001.0000000001.0000000000",
                                            "0000000002"]
    assert out[0].context == "https://schema.org" and out[0].types == ["WebPage"]
    assert out[1].context is None and out[1].types == ["Product", "Thing"]
    assert out[2].context == '{"v":1}' and out[2].types == ["Offer"]
    assert out[3].types == []


def test_page_status(spark):
    resolved = spark.createDataFrame([
        ("s", "https://a/1", "ok", None, ['{"a":1}', "{"]),
        ("s", "https://a/2", "ok", None, ["{"]),
        ("s", "https://a/3", "ok", None, []),
        ("s", "https://a/4", "ok", None, ["null"]),
        ("s", "https://a/5", "http_error", "HTTP 404", None),
        ("s", "https://a/6", "not_html", "Response is not HTML", None)],
        "scan_id string, normalized_url string, fetch_status string, message string, scripts array<string>")
    resolved = (resolved.withColumn("sitemap_source", F.lit(None).cast("string"))
                .withColumn("http_status", F.lit(200)).withColumn("content_type", F.lit("text/html"))
                .withColumn("duration_ms", F.lit(1)).withColumn("seq", F.lit(1)))
    got = {r.url: r.status for r in X.pages_from_resolved(resolved).collect()}
    assert got == {"https://a/1": "success", "https://a/2": "invalid_jsonld", "https://a/3": "no_jsonld",
                   "https://a/4": "success", "https://a/5": "http_error", "https://a/6": "fetch_error"}


def test_tokenizer_large_script_no_stack_overflow(spark):
    big = '{"a":"' + ("x" * 3_000_000) + '"}'
    html = "<html><head><!-- c --><script type='application/ld+json'>" + big + "</script></head></html>"
    got = scripts(spark, html)
    assert len(got) == 1 and len(got[0]) == len(big)


def test_script_inside_attribute_is_not_a_tag(spark):
    html = ('<div title="<script type=\'application/ld+json\'>{&quot;x&quot;:1}</script>">t</div>'
            '<script type="application/ld+json">{"real":1}</script>')
    assert scripts(spark, html) == ['{"real":1}']


def test_entities_keep_the_source_text(spark):
    raw = ('[ {"z": 1.0, "a" : 1e2, "n":12345678901234567890123, "@graph" : [ {"x":"q\\" 1.0, 2", "@context":{"v":2.50,"b":[ 1 ]}, "@type":["T",7]} , 3 ,'
           ' "{\\"fake\\":1}" ]}, "str 5", 5, null, [1, {"b":-2E+3, "a.b\\"": {}}], true]')
    df = spark.createDataFrame([("p", [raw, '"s"', '{"k":"\ue000 1", "d":1.0}'])], "page_id string, scripts array<string>")
    blocks = X.blocks_from_pages(df)
    got = {r.entity_path: (r.serialized, r.context, r.types) for r in X.entities_from_blocks(blocks.filter("ordinal = 0")).collect()}
    assert got == {"0000000000.0000000000": ('{"x":"q\\" 1.0, 2","@context":{"v":2.50,"b":[1]},"@type":["T",7]}', '{"v":2.50,"b":[1]}', ["T"]),
                   "0000000004.0000000001": ('{"b":-2E+3,"a.b\\"":{}}', None, [])}
    parsed = [r.parsed_json for r in blocks.orderBy("ordinal").collect()]
    assert parsed[0].startswith('[{"z":1.0,"a":1e2,"n":12345678901234567890123,"@graph":[') and parsed[1] == '"s"'
    assert parsed[2] == '{"k":"\ue000 1","d":1.0}'
