"""Exports as whole artifacts: bytes, parts, scope, gate."""

import hashlib
import json
import os

import pytest

from crawlscope.operators import artifact as AR
from crawlscope.operators.extract import ScanTables


@pytest.fixture()
def tables(spark):
    scans = spark.createDataFrame(
        [("s1", "https://a.example/", None, "completed", 1767225600000, 1767225602000, 3, 3, 3, 1, 1, None),
         ("s2", "https://b.example/", "https://b.example/m.xml", "failed", 1767225600000, 1767225602000, 0, 0, 0, 0, 0, 'b"oom\x1f'),
         ("s3", "https://c.example/", None, "crawling", 1767225600000, 1767225602000, 1, 1, 0, 0, 0, None)],
        "scan_id string, target_url string, sitemap_url string, status string, created_ms long, updated_ms long, discovered long, queued long, "
        "completed long, successful long, failed long, error string")
    for column, _ in AR.SETTINGS_FIELDS:
        from pyspark.sql import functions as F
        scans = scans.withColumn(column, F.lit(True) if column in ("respect_robots", "same_origin_only") else F.lit(5))
    page = "page_id string, scan_id string, url string, normalized_url string, sitemap_source string, status string, http_status int, content_type string, " \
           "duration_ms int, error string, block_count int, seq long, created_ms long"
    pages = spark.createDataFrame(
        [("p2", "s1", "https://a.example/b", "https://a.example/b", None, "success", 200, "text/html", 7, None, 2, 1, 1767225600001),
         ("p1", "s1", "https://a.example/a,b|c", "https://a.example/a,b|c", "https://a.example/m", "no_jsonld", 200, "text/html", 7, None, 0, 2, 1767225600002),
         ("p3", "s1", "https://a.example/c", "https://a.example/c", None, "http_error", 404, None, None, "HTTP 404", 0, 3, 1767225600003),
         ("p9", "s3", "https://c.example/", "https://c.example/", None, "success", 200, "text/html", 1, None, 0, 1, 1767225600001)], page)
    raw = '{ "b":1.0, "a":[1, {"x":[], "y":{}}], "s":"q\\"\\u001f" }'
    blocks = spark.createDataFrame(
        [("k1", "p2", 0, raw, '{"b":1.0,"a":[1,{"x":[],"y":{}}],"s":"q\\"\\u001f"}', None), ("k2", "p2", 1, "{```\n", None, "JSON-LD parse error: x|y")],
        "block_id string, page_id string, ordinal int, raw_text string, parsed_json string, parse_error string")
    ents = spark.createDataFrame([("e1", "k1", "p2", "", "https://schema.org", ["A", "B"], '{"b":1.0}'), ("e2", "k1", "p2", "1", None, [], "{}")],
                                 "entity_id string, block_id string, page_id string, entity_path string, context string, types array<string>, serialized string")
    return scans, ScanTables(pages, blocks, ents)


def read(folder, manifest):
    out = {}
    for r in sorted(manifest.collect(), key=lambda r: r.part):
        with open(os.path.join(folder, r.file), "rb") as f:
            f.seek(r.first)
            out[r.scan_id, r.name] = out.get((r.scan_id, r.name), b"") + f.read(r.bytes)
    return out


def test_bytes_of_a_single_writer(spark, tmp_path, tables):
    scans, t = tables
    manifest, refused = AR.export_scans(scans, t, str(tmp_path))
    assert [(r.scan_id, r.error) for r in refused.collect()] == [("s3", "Scan is still active")]
    files = read(str(tmp_path), manifest)
    assert set(files) == {(s, f"{h}.example-schema-scan.{e}") for s, h in (("s1", "a"), ("s2", "b")) for e in ("json", "csv", "md")}
    text = files["s1", "a.example-schema-scan.json"].decode()
    doc = json.loads(text)
    assert text.replace("1.0", "1.5") == json.dumps(json.loads(text.replace("1.0", "1.5")), indent=2, ensure_ascii=False)
    assert list(doc) == ["formatVersion", "scan", "pages"] and len(doc["scan"]) == 13
    assert [p["page"]["id"] for p in doc["pages"]] == ["p1", "p2", "p3"]
    assert doc["pages"][1]["blocks"][0]["parsed"] == {"b": 1.0, "a": [1, {"x": [], "y": {}}], "s": 'q"\x1f'}
    assert doc["pages"][1]["entities"][0]["types"] == ["A", "B"] and doc["pages"][0]["page"]["createdAt"] == "2026-01-01T00:00:00.002Z"
    empty = files["s2", "b.example-schema-scan.json"].decode()
    assert empty.endswith('"pages": []\n}') and '"error": "b\\"oom\\u001f"' in empty and json.loads(empty)["scan"]["sitemapUrl"].endswith("m.xml")
    lines = files["s1", "a.example-schema-scan.csv"].decode()
    assert lines == ('page_url,block_index,context,type,parse_status,serialized_json\n"https://a.example/a,b|c",,,,,\n'
                     'https://a.example/b,0,https://schema.org,A|B,valid,"{""b"":1.0}"\nhttps://a.example/b,0,,,valid,{}\n'
                     'https://a.example/b,1,,,invalid,"{```\n"\nhttps://a.example/c,,,,,\n')
    md = files["s1", "a.example-schema-scan.md"].decode()
    assert md.startswith("# Sitemap Schema Scan\n\nTarget: https://a.example/\nStatus: completed\nPages: 3\n\n## https://a.example/a,b\\|c\n")
    assert "\n\nParse error: JSON-LD parse error: x\\|y\n\n````json\n{```\n\n````\n## https://a.example/c\n" in md and md.endswith("- Error: HTTP 404\n")
    digests = {(r.scan_id, r.name): (r.bytes, r.sha256) for r in AR.artifact_digests(manifest, str(tmp_path)).collect()}
    assert digests == {k: (len(v), hashlib.sha256(v).hexdigest()) for k, v in files.items()}


def test_page_scope(spark, tmp_path, tables):
    scans, t = tables
    manifest, _ = AR.export_scans(scans, t, str(tmp_path), page_id="p2")
    files = read(str(tmp_path), manifest)
    assert set(files) == {("s1", f"a.example-b-schema-page.{e}") for e in ("json", "csv", "md")}
    assert [p["page"]["id"] for p in json.loads(files["s1", "a.example-b-schema-page.json"])["pages"]] == ["p2"]


def test_many_parts_make_one_artifact(spark, tmp_path, tables):
    """Rows of one scan dealt over many tasks."""
    from pyspark.sql import functions as F

    scans, t = tables
    many = t.pages.filter("page_id = 'p3'").crossJoin(spark.range(400)).withColumns(
        {"page_id": F.concat(F.lit("n"), F.col("id").cast("string")), "url": F.concat("url", F.col("id").cast("string"))}).drop("id")
    spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "false")
    try:
        manifest, _ = AR.export_scans(scans, ScanTables(many, t.blocks, t.entities), str(tmp_path))
    finally:
        spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "true")
    parts = {r.format: r.n for r in manifest.filter("scan_id = 's1'").groupBy("format").agg(F.count("*").alias("n")).collect()}
    assert max(parts.values()) > 1
    files = read(str(tmp_path), manifest)
    urls = [p["page"]["url"] for p in json.loads(files["s1", "a.example-schema-scan.json"])["pages"]]
    assert urls == sorted(urls) and len(urls) == 400


def test_damaged_part_is_refused(spark, tmp_path, tables):
    scans, t = tables
    manifest, _ = AR.export_scans(scans, t, str(tmp_path))
    name = manifest.first().file
    path = os.path.join(str(tmp_path), name)
    data = bytearray(open(path, "rb").read())
    data[3] ^= 1
    open(path, "wb").write(bytes(data))
    with pytest.raises(Exception, match="is damaged"):
        AR.artifact_digests(manifest, str(tmp_path)).collect()
