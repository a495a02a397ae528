"""URL filters by a sort-merge range join (operator 6).

A rule (host, path) becomes a key: the host's labels from the last to the
first, each followed by a dot, then a separator and the path.  All keys that
start with a rule's key form one interval of the sort order.  As a rule fits
subdomains too, a url asks with one key for each suffix of its host.  Rules and
asked keys are range-partitioned together; a rule goes to every partition that
its interval meets, each partition is swept once in order, and a stack holds
the rules whose intervals are open (intervals nest, as prefixes do).

Of the rules that fit a url the longest wins (host and path together; of equal
ones the longer host); without one the verdict is ``default``.

Each distinct (host, path) is judged once, so repeated urls cost nothing.

Defined cases: null urls and urls without ``://`` have empty host and path,
which no rule fits; empty labels count as labels; of rules that repeat a host
and path, block wins; rules with a null or empty host are ignored, a null path
is empty.  Extra columns are ignored.
"""

from __future__ import annotations

import bisect
import sys

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from crawlscope.llm.store import prepare, save
from crawlscope.session import ship_with_tasks

ship_with_tasks(sys.modules[__name__])

SEPARATOR = "\x01"
BOUNDS = 4096  # most partitions of the sweep

_UPPER, _LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"


def host_of(url: Column) -> Column:
    return F.translate(F.coalesce(F.regexp_extract(url, r"(?s)\A(?:(?!://).)*://([^/?#]*)", 1), F.lit("")), _UPPER, _LOWER)


def path_of(url: Column) -> Column:
    return F.coalesce(F.regexp_extract(url, r"(?s)\A(?:(?!://).)*://[^/?#]*([^?#]*)", 1), F.lit(""))


def reversed_host(host: Column) -> Column:
    return F.concat(F.array_join(F.reverse(F.split(host, r"\.", -1)), "."), F.lit("."))


def canonical(host: Column, path: Column) -> Column:
    """Key of a rule or of one suffix of a url's host, as binary: the order of
    bytes is that of the sweep."""
    return F.concat(reversed_host(host), F.lit(SEPARATOR), path).cast("binary")


def asked_keys(hosts: DataFrame) -> DataFrame:
    """(host, path, key): one row for each suffix of the host."""
    labels = F.split("host", r"\.", -1)
    suffix = F.explode(F.sequence(F.lit(1), F.size(labels)))
    return (hosts.where("host != ''").withColumn("k", suffix)
            .withColumn("suffix", F.array_join(F.slice(labels, -F.col("k"), F.col("k")), "."))
            .select("host", "path", canonical(F.col("suffix"), F.col("path")).alias("key")))


def bounds_of(keys: DataFrame, parts: int) -> list[bytes]:
    """At most ``parts`` - 1 keys that cut the sorted keys into parts of about
    equal size, from a sample of a fixed number of keys by hash (it decides the
    balance only, never the result)."""
    wanted = 32 * parts
    n = keys.count()
    share = min(1.0, wanted / max(1, n))
    some = keys.where(F.pmod(F.xxhash64("key"), F.lit(1_000_000)) < int(share * 1_000_000) + 1).select("key").limit(2 * wanted).collect()
    ordered = sorted(bytes(r.key) for r in some)
    cuts = [ordered[i * len(ordered) // parts] for i in range(1, parts)] if ordered else []
    return sorted(set(cuts))


def _place(bounds: list[bytes]):
    def run(batches):
        for batch in batches:
            part = [bisect.bisect_right(bounds, k) for k in batch.column("key").to_pylist()]
            yield pa.RecordBatch.from_arrays([pa.array(part, pa.int32()), *batch.columns], names=["part", *batch.schema.names])
    return run


def _place_rules(bounds: list[bytes]):
    """A rule in every partition that holds keys starting with its own."""
    def run(batches):
        for batch in batches:
            rows, parts = [], []
            for i, key in enumerate(batch.column("key").to_pylist()):
                first, after = bisect.bisect_right(bounds, key), successor(key)
                last = len(bounds) if after is None else bisect.bisect_left(bounds, after)
                for p in range(first, max(first, last) + 1):
                    rows.append(i)
                    parts.append(p)
            out = batch.take(pa.array(rows, pa.int64()))
            yield pa.RecordBatch.from_arrays([pa.array(parts, pa.int32()), *out.columns], names=["part", *batch.schema.names])
    return run


def successor(key: bytes) -> bytes | None:
    """The first key after all that start with ``key``."""
    stem = key.rstrip(b"\xff")
    return stem[:-1] + bytes([stem[-1] + 1]) if stem else None


def _sweep(batches):
    """Rows sorted by (part, key, kind): kind 0 opens a rule, kind 1 asks."""
    stack, part = [], None
    for batch in batches:
        host, path, rule, size, own, allow = [], [], [], [], [], []
        for r in zip(*(batch.column(c).to_pylist() for c in ("part", "key", "kind", "host", "path", "allow"))):
            if r[0] != part:
                part, stack = r[0], []
            while stack and not r[1].startswith(stack[-1][0]):
                stack.pop()
            if r[2] == 0:
                stack.append((r[1], r[3] + r[4], len(r[3]), r[5]))
            elif stack:
                _, name, length, verdict = stack[-1]
                host.append(r[3])
                path.append(r[4])
                rule.append(name)
                size.append(len(name))
                own.append(length)
                allow.append(verdict)
        yield pa.RecordBatch.from_arrays([pa.array(host, pa.string()), pa.array(path, pa.string()), pa.array(rule, pa.string()),
                                          pa.array(size, pa.int32()), pa.array(own, pa.int32()), pa.array(allow, pa.bool_())],
                                         names=["host", "path", "rule", "size", "own", "allow"])


def judge(pages: DataFrame, rules: DataFrame, default: str = "allow", parts: int | None = None) -> DataFrame:
    """(page_id, host, path, rule, verdict) for every row of ``pages``."""
    spark = pages.sparkSession
    prepare(spark)
    url = F.col("url").cast("string")
    rows = pages.select("page_id", host_of(url).alias("host"), path_of(url).alias("path"))
    asked = save(asked_keys(rows.select("host", "path").distinct()), "asked")
    parts = parts or min(BOUNDS, int(spark.conf.get("spark.sql.shuffle.partitions")))
    bounds = bounds_of(asked, parts)
    known = (rules.where("host is not null and host != ''")
             .groupBy(F.translate("host", _UPPER, _LOWER).alias("host"), F.coalesce("path", F.lit("")).alias("path"))
             .agg(F.min("allow").alias("allow")).withColumn("key", canonical(F.col("host"), F.col("path"))))
    fields = "part int, key binary, kind int, host string, path string, allow boolean"
    opened = known.select("key", F.lit(0).alias("kind"), "host", "path", "allow").mapInArrow(_place_rules(bounds), fields)
    asking = asked.select("key", F.lit(1).alias("kind"), "host", "path", F.lit(None).cast("boolean").alias("allow")).mapInArrow(_place(bounds), fields)
    swept = (opened.unionByName(asking).repartitionById(len(bounds) + 1, "part").sortWithinPartitions("part", "key", "kind")
             .mapInArrow(_sweep, "host string, path string, rule string, size int, own int, allow boolean"))
    best = swept.groupBy("host", "path").agg(F.max(F.struct("size", "own", "rule", "allow")).alias("m")).select("host", "path", "m.rule", "m.allow")
    return (rows.join(best, ["host", "path"], "left")
            .select("page_id", "host", "path", "rule",
                    F.when(F.col("allow").isNull(), default).when(F.col("allow"), "allow").otherwise("block").alias("verdict")))


# Fixed by the query's contract: host, path, allowed.
RULES = [("org", "/", True), ("example.org", "/es/", False), ("example.org", "/en/1", False), ("com", "/fr/", True), ("com", "/de/", False)]


def op6_url_filters(spark, sf_dir: str) -> DataFrame:
    """Operator 6 over the whole ``pages`` table with the contract's rules."""
    from crawlscope.sources.tables import load

    values = ", ".join(f"('{h}', '{p}', {str(a).lower()})" for h, p, a in RULES)
    rules = spark.sql(f"SELECT * FROM VALUES {values} AS r(host, path, allow)")
    return judge(load(spark, sf_dir, "pages"), rules)


ORACLE_SQL = r"""
with u as (select page_id, case when contains(url, '://') then substr(url, instr(url, '://') + 3) else '' end s from pages),
h as (select page_id, translate(regexp_extract(s, '^[^/?#]*'), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') host,
             regexp_extract(s, '^[^/?#]*([^?#]*)', 1) path from u),
r(rh, rp, v) as (values ('org', '/', 'allow'), ('example.org', '/es/', 'block'), ('example.org', '/en/1', 'block'), ('com', '/fr/', 'allow'), ('com', '/de/', 'block')),
m as (select page_id, arg_max(rh || rp, length(rh || rp)) rule, arg_max(v, length(rh || rp)) v
      from h join r on (host = rh or ends_with(host, '.' || rh)) and starts_with(path, rp) group by 1)
select h.page_id, host, path, rule, coalesce(v, 'allow') verdict from h left join m using (page_id)
"""
