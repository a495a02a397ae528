"""Operator 11: round trips, equal bytes, retries, damage, defined cases."""

import base64
import glob
import gzip
import hashlib
import os
import random

import pytest

from crawlscope.llm import warc

from .common import ODD, words

SCHEMA = "page_id long, url string, html string, size int, place string, shard string"


def rows_of(seed=7, n=160):
    rng = random.Random(seed)
    rows = [(i * 3, f"https://h{i % 5}.example/{i}", t) for i, t in enumerate(ODD)]
    rows += [(100 + i, f"http://x.example/{i} é\n" if i % 9 == 0 else f"http://x.example/{i}", words(rng, rng.randrange(5, 80), 500)) for i in range(n)]
    shared = [words(rng, 40) for _ in range(4)]
    rows += [(1000 + rng.randrange(500), f"u{i}", rng.choice(shared)) for i in range(n)]  # copies, repeated ids
    rows += [(5, None, "same")] * 7 + [(5, "", "same"), (None, "n", "same"), (None, None, None), (None, "only", "null id")]
    rng.shuffle(rows)
    return [(*r, 1, "p", "s") for r in rows]


def digest(text):
    return base64.b32encode(hashlib.sha1((text or "").encode()).digest()).decode()


def expected(rows, least=0):
    """(page_id, bytes, digest, type, refers_to) by the definition, sorted."""
    groups = {}
    for page, _, html, *_ in rows:
        groups.setdefault(html or "", []).append(page)
    out = []
    for html, pages in groups.items():
        size = len(html.encode())
        pages.sort(key=lambda p: (p is None, p or 0))
        for k, page in enumerate(pages):
            revisit = size >= least and k > 0
            out.append((page, size, digest(html), "revisit" if revisit else "response", pages[0] if revisit else None))
    return sorted(out, key=repr)


def got(df):
    return sorted(((r.page_id, r.payload_bytes, r.payload_digest, r.record_type, r.refers_to) for r in df.collect()), key=repr)


def files(folder):
    return {os.path.basename(f): open(f, "rb").read() for f in glob.glob(f"{folder}/*.warc.gz")}


@pytest.mark.parametrize("least", [0, 30])
def test_archive_reads_back(spark, tmp_path, least):
    rows = rows_of()
    manifest = warc.write_archive(spark.createDataFrame(rows, SCHEMA), str(tmp_path / "a"), min_bytes=least, shard_bytes=20_000, file_bytes=3000)
    assert manifest.count() > 10 and not os.path.exists(tmp_path / "a/_temporary")
    back = warc.read_archive(spark, str(tmp_path / "a"), with_payload=True)
    assert got(back) == expected(rows, least)
    texts = {digest(h): h or "" for _, _, h, *_ in rows}
    assert all(r.html == texts[r.payload_digest] for r in back.where("record_type = 'response'").collect())
    assert {r.file for r in manifest.collect()} == set(files(tmp_path / "a"))


def test_bytes_depend_on_the_pages_alone(spark, tmp_path):
    rows = rows_of(8)
    one = spark.createDataFrame(rows, SCHEMA).repartition(7)
    two = spark.createDataFrame(rows[::-1], SCHEMA).repartition(2)
    for name, pages in (("a", one), ("b", two)):
        warc.write_archive(pages, str(tmp_path / name), shard_bytes=30_000, file_bytes=4000)
    assert files(tmp_path / "a") == files(tmp_path / "b")


def test_members_are_plain_warc_records(spark, tmp_path):
    rows = rows_of(9, 20)
    warc.write_archive(spark.createDataFrame(rows, SCHEMA), str(tmp_path / "a"))
    ids, refers = [], []
    for data in files(tmp_path / "a").values():
        text = gzip.decompress(data)
        while text:
            head, _, rest = text.partition(b"\r\n\r\n")
            fields = dict(line.split(": ", 1) for line in head.decode().split("\r\n")[1:])
            n = int(fields["Content-Length"])
            assert head.startswith(b"WARC/1.1\r\n") and rest[n:n + 4] == b"\r\n\r\n"
            ids.append(fields["WARC-Record-ID"])
            refers += [fields["WARC-Refers-To"]] if "WARC-Refers-To" in fields else []
            text = rest[n + 4:]
    assert len(set(ids)) == len(ids) and set(refers) <= set(ids) and refers


def test_equal_rows_are_split_and_long_files_read_in_parts(spark, tmp_path, monkeypatch):
    monkeypatch.setattr(warc, "SAME_ROWS", 50)
    monkeypatch.setattr(warc, "SPLIT_BYTES", 2000)
    rows = [(1, "u", "<p>same</p>", 1, "p", "s")] * 500 + [(2, "v", "other", 1, "p", "s")]
    manifest = warc.write_archive(spark.createDataFrame(rows, SCHEMA), str(tmp_path / "a"), shard_bytes=40_000)
    assert manifest.count() > 2 and max(len(r.splits) for r in manifest.collect()) > 2
    assert got(warc.read_archive(spark, str(tmp_path / "a"))) == expected(rows)


def test_damage_and_second_writes_are_refused(spark, tmp_path):
    pages = spark.createDataFrame(rows_of(10, 10), SCHEMA)
    warc.write_archive(pages, str(tmp_path / "a"))
    with pytest.raises(FileExistsError):
        warc.write_archive(pages, str(tmp_path / "a"))
    name = next(iter(files(tmp_path / "a")))
    text = gzip.decompress(files(tmp_path / "a")[name])
    with pytest.raises(OSError):
        list(warc.parse_records(_members(gzip.compress(text.replace(b"word word", b"ward word", 1)))))
    with pytest.raises(OSError):
        list(warc.parse_records(_members(gzip.compress(text)[:-40])))


def _members(data):
    import io

    return warc.Members(io.BytesIO(data), len(data))


def test_a_file_renamed_before_a_retry_stays(spark, tmp_path):
    """The renaming job may run again: a file that has its name is left."""
    import shutil

    pages = spark.createDataFrame(rows_of(11, 10), SCHEMA)
    warc.write_archive(pages, str(tmp_path / "a"))
    before = files(tmp_path / "a")
    shutil.copytree(tmp_path / "a", tmp_path / "b")
    shutil.rmtree(tmp_path / "b/manifest")  # as if the driver had died before publishing
    warc.write_archive(pages, str(tmp_path / "b"))
    assert files(tmp_path / "b") == before


def test_empty_table(spark, tmp_path):
    warc.write_archive(spark.createDataFrame([], SCHEMA), str(tmp_path / "a"))
    assert warc.read_archive(spark, str(tmp_path / "a")).count() == 0


def test_registered_query(spark, tmp_path):
    rows = rows_of(12)
    spark.createDataFrame(rows, SCHEMA).write.parquet(str(tmp_path / "pages.parquet"))
    out = warc.op11_warc(spark, str(tmp_path))
    assert out.columns == ["page_id", "payload_bytes", "payload_digest", "record_type", "refers_to"]
    assert got(out) == expected(rows)
