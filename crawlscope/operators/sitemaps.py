"""Sitemap discovery over captured sitemap documents (SM-1..SM-9).

Documents are parsed once (a narrow ``from_xml`` map) into a compact table
of (kind, locations, error).  Discovery then walks sitemap indexes
breadth-first with a frontier loop: each round joins the frontier to the
parsed documents, emits page URLs, enqueues child sitemaps and removes
already-visited canonical URLs with a ``left_anti`` join.  Every round's
frontier and visited set are checkpointed, so lineage stays short and a lost
executor recomputes one round at most.

Order: the reference's FIFO queue visits sources level by level, and within
a level by the position path from the initial candidates.  ``order_key``
(zero-padded level + path + position) sorts exactly like that queue.
"""

from __future__ import annotations

from typing import NamedTuple

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from crawlscope.functions import urls as FU
from crawlscope.operators import extract as FX
from crawlscope.session import materialize

# Fixed messages.
MSG_ROOT = "Sitemap XML must contain urlset or sitemapindex"
MSG_INVALID_PREFIX = "Invalid sitemap XML: "
MSG_MALFORMED = "document is not well-formed"
MSG_TOO_LARGE = "Sitemap response exceeds size limit"
MSG_FAILED_PREFIX = "Sitemap fetch failed: "
MSG_TIMEOUT = "Sitemap fetch timed out"
MSG_NO_DOCUMENT = "Sitemap fetch failed: no captured response"
MSG_REDIRECT_LIMIT = "Redirect limit exceeded"

_XML_SCHEMA = ("url array<struct<loc:array<string>,_VALUE:string>>, "
               "sitemap array<struct<loc:array<string>,_VALUE:string>>, _corrupt_record string")
_ROOT_RE = ("^\\s*(?:<\\?xml[^>]*\\?>\\s*)?(?:<!--.*?-->\\s*)*(?:<!DOCTYPE[^>]*>\\s*)?(?:<!--.*?-->\\s*)*"
            "<(?:[A-Za-z_][\\w.-]*:)?([A-Za-z_][\\w.-]*)")


def _pad(col):
    """Ten digits hold every int, so the texts sort like the numbers."""
    return F.lpad(col.cast("string"), 10, "0")


def fetch_outcomes(docs: DataFrame) -> DataFrame:
    """SM-9: outcome of each captured response, but for its size.

    docs: scan_id, url, http_status, location, body and, where captured, error
    (text of a transport failure; ``timeout`` for a timed-out fetch).  Adds
    ``fetch_error`` (NULL when the body is usable): transport failure; 3xx
    without Location -> ``HTTP n``; other non-2xx -> ``HTTP n``.  3xx with a
    Location is followed by ``resolve_redirects``.
    """
    s = F.col("http_status")
    failure = F.col("error") if "error" in docs.columns else F.lit(None).cast("string")
    err = (F.when(failure == "timeout", F.lit(MSG_TIMEOUT))
           .when(failure.isNotNull(), F.concat(F.lit(MSG_FAILED_PREFIX), failure))
           .when((s >= 300) & (s < 400) & (F.coalesce("location", F.lit("")) == ""),
                 F.concat(F.lit("HTTP "), s.cast("string")))
           .when((s >= 300) & (s < 400), F.lit(None))
           .when((s < 200) | (s >= 300), F.concat(F.lit("HTTP "), s.cast("string"))))
    return docs.withColumn("fetch_error", err)


def latest_documents(parsed: DataFrame, scans: DataFrame) -> DataFrame:
    """SM-5, SM-9: of a document captured more than once, the latest capture at
    or before the scan's ``as_of`` (without one: the latest)."""
    if "as_of" in scans.columns:
        bound = scans.select("scan_id", F.col("as_of").alias("_as_of"))
        parsed = parsed.join(bound, "scan_id", "left").filter(F.coalesce(F.col("seq") <= F.col("_as_of"), F.lit(True))).drop("_as_of")
    rest = [c for c in parsed.columns if c not in ("scan_id", "doc_key")]
    last = parsed.groupBy("scan_id", "doc_key").agg(F.max(F.struct("seq", "kind", *[c for c in rest if c not in ("seq", "kind")])).alias("_last"))
    return last.select("scan_id", "doc_key", "_last.*").drop("seq")


def limit_documents(parsed: DataFrame, scans: DataFrame) -> DataFrame:
    """SM-9: a usable body above its scan's ``max_response_bytes`` is an error;
    of several captures the one that counts is taken first.  Only the parsed rows meet the settings, never the bodies."""
    p = latest_documents(parsed, scans).join(scans.select("scan_id", "max_response_bytes"), "scan_id", "left")
    large = F.col("body_read") & (F.col("body_bytes") > F.col("max_response_bytes"))
    large = F.coalesce(large, F.lit(False))
    return p.select("scan_id", "doc_key", F.when(large, "error").otherwise(F.col("kind")).alias("kind"),
                    F.when(~large, F.col("locs")).alias("locs"), "location",
                    F.when(large, MSG_TOO_LARGE).otherwise(F.col("error")).alias("error"))


def parse_documents(docs: DataFrame, decode_entities: bool = False) -> DataFrame:
    """SM-1, SM-2, SM-9: one row per captured document with its verdict.

    Output: scan_id, doc_key (canonical URL), kind ('urlset' / 'index' /
    'redirect' / 'error'), locs (array<string>), location, error, body_bytes,
    body_read (the body is what the verdict rests on).
    ``decode_entities=False`` keeps ``&amp;`` undecoded in locations (the
    reference parser does not process entities).
    """
    d = fetch_outcomes(docs)
    d = FU.with_url(d, "url", "_u").withColumn("doc_key", F.coalesce(F.col("_u.href_nofrag"), F.col("url")))
    body = F.coalesce(F.col("body"), F.lit(""))
    checked = F.from_xml(body, _XML_SCHEMA, {"mode": "PERMISSIVE", "ignoreNamespace": "true"})
    # Outside CDATA sections, whose text is literal, every & stays undecoded.
    pieces = F.split(body, "(?=<!\\[CDATA\\[)|(?<=\\]\\]>)")
    literal = F.array_join(F.transform(pieces, lambda x: F.when(x.startswith("<![CDATA["), x)
                                       .otherwise(F.replace(x, F.lit("&"), F.lit("&amp;")))), "")
    to_parse = body if decode_entities else literal
    parsed = F.from_xml(to_parse, _XML_SCHEMA, {"mode": "PERMISSIVE", "ignoreNamespace": "true"})
    root = F.regexp_extract(body, _ROOT_RE, 1)
    empty_root = body.rlike("^\\s*(?:<\\?xml[^>]*\\?>\\s*)?(?:<!--.*?-->\\s*)*<(?:[\\w.-]+:)?(urlset|sitemapindex)\\b[^>]*"
                            "(?:/>|>\\s*</(?:[\\w.-]+:)?(urlset|sitemapindex)\\s*>)\\s*$")

    def locs(arr):
        # An entry with a repeated <loc> is not a string location: dropped.
        vals = F.transform(arr, lambda e: F.when(F.size(e["loc"]) == 1, F.element_at(e["loc"], 1))
                           .when(e["loc"].isNull(), e["_VALUE"]))
        return F.transform(F.filter(vals, lambda v: v.isNotNull() & (F.length(v) > 0)), lambda v: F.trim(v))

    d = d.withColumn("_chk", checked).withColumn("_doc", parsed).withColumn("_root", root)
    is_redirect = (F.col("http_status") >= 300) & (F.col("http_status") < 400) & F.col("fetch_error").isNull()
    malformed = F.col("_chk._corrupt_record").isNotNull() | (F.trim(body) == "")
    kind = (F.when(F.col("fetch_error").isNotNull(), "error").when(is_redirect, "redirect")
            .when(malformed, "error").when(empty_root, "error")
            .when(F.col("_root") == "urlset", "urlset").when(F.col("_root") == "sitemapindex", "index")
            .otherwise("error"))
    error = (F.when(F.col("fetch_error").isNotNull(), F.col("fetch_error")).when(is_redirect, F.lit(None))
             .when(malformed, F.lit(MSG_INVALID_PREFIX + MSG_MALFORMED))
             .when(empty_root | ~F.col("_root").isin("urlset", "sitemapindex"), F.lit(MSG_ROOT)))
    out_locs = (F.when(kind == "urlset", F.coalesce(locs(F.col("_doc.url")), F.array().cast("array<string>")))
                .when(kind == "index", F.coalesce(locs(F.col("_doc.sitemap")), F.array().cast("array<string>"))))
    seq = F.col("seq").cast("long") if "seq" in docs.columns else F.lit(0).cast("long")
    return d.select("scan_id", "doc_key", seq.alias("seq"), kind.alias("kind"), out_locs.alias("locs"), "location",
                    error.alias("error"), F.octet_length(body).cast("long").alias("body_bytes"),
                    (F.col("fetch_error").isNull() & ~is_redirect).alias("body_read"))


MSG_OUTSIDE = "URL is outside the target origin"


def resolve_redirects(parsed: DataFrame, scans: DataFrame, verdicts: DataFrame | None = None) -> DataFrame:
    """SM-9: follow captured 3xx sitemap responses to their final document.

    A chain follows at most its scan's ``max_redirects`` hops (the next
    redirect is ``Redirect limit exceeded``); targets must pass the URL policy,
    where the scan asks for it stay on the first document's origin, and
    resolve to public addresses, in this order.  Each round is
    a join of the pending redirects with the parsed documents, checkpointed;
    the loop ends when no chain is pending.  Returns ``parsed`` with redirect
    rows replaced by their final outcome.
    """
    docs = parsed.select("scan_id", F.col("doc_key").alias("cur_key"), "kind", "locs", "error", "location")
    start = parsed.filter(F.col("kind") == "redirect").select("scan_id", "doc_key")
    settings = scans.select("scan_id", "max_redirects", "same_origin_only")
    start = FU.with_url(start, "doc_key", "_d").join(settings, "scan_id", "left").select(
        "scan_id", "doc_key", F.col("doc_key").alias("cur_key"), F.col("_d.origin").alias("init_origin"),
        F.lit(0).alias("hops"), "max_redirects", "same_origin_only")
    frontier = materialize(start)
    finals = []
    while not frontier.isEmpty():
        j = frontier.join(docs, ["scan_id", "cur_key"], "left")
        j = FU.with_url(j, "cur_key", "_c").withColumn("_abs", FU.resolve_reference("location", "_c"))
        j = FX.with_address_check(FU.with_url(j, "_abs", "_n"), "_n", verdicts)
        is_redirect = F.coalesce(F.col("kind") == "redirect", F.lit(False))
        reason = (F.when(~is_redirect, F.lit(None))
                  .when(F.col("hops") >= F.col("max_redirects"), F.lit(MSG_REDIRECT_LIMIT))
                  .when(FU.policy_reason(F.col("_n")).isNotNull(), FU.policy_reason(F.col("_n")))
                  .when(F.col("same_origin_only") & (F.col("_n.origin") != F.col("init_origin")), F.lit(MSG_OUTSIDE))
                  .when(F.col("_n_address").isNotNull(), F.col("_n_address"))
                  # A redirect to itself meets the limit, whatever that is.
                  .when(F.col("_n.href_nofrag") == F.col("cur_key"), F.lit(MSG_REDIRECT_LIMIT)))
        step = materialize(j.select(
            "scan_id", "doc_key", "init_origin", "hops", "max_redirects", "same_origin_only", "kind", "locs", "error",
            F.when(is_redirect & reason.isNull(), F.lit("next")).otherwise(F.lit("done")).alias("_step"),
            reason.alias("_reason"), F.col("_n.href_nofrag").alias("_next")))
        finals.append(step.filter(F.col("_step") == "done").select(
            "scan_id", "doc_key",
            F.when(F.col("_reason").isNotNull() | F.col("kind").isNull(), F.lit("error")).otherwise(F.col("kind"))
            .alias("kind"),
            F.when(F.col("_reason").isNotNull() | F.col("kind").isNull(), F.lit(None)).otherwise(F.col("locs"))
            .alias("locs"),
            F.when(F.col("_reason").isNotNull(), F.col("_reason"))
            .when(F.col("kind").isNull(), F.lit(MSG_NO_DOCUMENT)).otherwise(F.col("error")).alias("error")))
        frontier = step.filter(F.col("_step") == "next").select(
            "scan_id", "doc_key", F.col("_next").alias("cur_key"), "init_origin", (F.col("hops") + 1).alias("hops"),
            "max_redirects", "same_origin_only")
    out = parsed.filter(F.col("kind") != "redirect").select("scan_id", "doc_key", "kind", "locs", "error")
    for f in finals:
        out = out.unionByName(f)
    return out.withColumn("location", F.lit(None).cast("string"))


def candidates(scans: DataFrame, robots_sitemaps: DataFrame, robots_docs: DataFrame,
               verdicts: DataFrame | None = None) -> tuple[DataFrame, DataFrame]:
    """SM-3, SM-4: initial queue per scan, and robots errors.

    With a direct ``sitemap_url`` the queue is just that URL; otherwise it is
    ``/sitemap.xml``, ``/sitemap_index.xml`` and then the robots-declared
    sitemaps in file order.  A robots file that its host's addresses forbid,
    that was not captured, answered with another status than 2xx or is larger
    than the scan allows is an error and declares nothing; discovery continues.
    Returns (queue: scan_id, source, pos), (errors: scan_id, source, message).
    """
    t = FX.with_address_check(FU.with_url(scans, "target_url", "_t"), "_t", verdicts)
    status = F.col("http_status") if "http_status" in robots_docs.columns else F.lit(200)
    order = F.col("seq").cast("long") if "seq" in robots_docs.columns else F.lit(0).cast("long")
    captured = robots_docs.select("scan_id", order.alias("_seq"), status.alias("_status"), F.octet_length("body").alias("_bytes")).groupBy(
        "scan_id").agg(F.max(F.struct("_seq", "_status", "_bytes")).alias("_r")).select("scan_id", F.lit(True).alias("_have"), "_r._status", "_r._bytes")
    t = t.join(captured, "scan_id", "left")
    limit = F.col("max_response_bytes") if "max_response_bytes" in scans.columns else F.lit(None).cast("long")
    message = (F.when(F.col("_t_address").isNotNull(), F.col("_t_address"))
               .when(F.col("_have").isNull(), F.lit(MSG_NO_DOCUMENT))
               .when((F.col("_status") < 200) | (F.col("_status") >= 300), F.concat(F.lit("HTTP "), F.col("_status").cast("string")))
               .when(F.col("_bytes") > limit, F.lit(MSG_TOO_LARGE)))
    s = t.select("scan_id", "sitemap_url", F.col("_t.origin").alias("origin"), message.alias("message"))
    direct = s.filter(F.col("sitemap_url").isNotNull()).select(
        "scan_id", F.col("sitemap_url").alias("source"), F.lit(0).alias("pos"))
    auto = s.filter(F.col("sitemap_url").isNull())
    defaults = auto.select("scan_id", F.explode(F.array(
        F.struct(F.concat("origin", F.lit("/sitemap.xml")).alias("source"), F.lit(0).alias("pos")),
        F.struct(F.concat("origin", F.lit("/sitemap_index.xml")).alias("source"), F.lit(1).alias("pos"))))
        .alias("c")).select("scan_id", "c.source", "c.pos")
    declared = robots_sitemaps.join(auto.filter(F.col("message").isNull()).select("scan_id"), "scan_id", "left_semi").select(
        "scan_id", F.col("url").alias("source"), (F.lit(2) + F.col("pos")).alias("pos"))
    robots_err = auto.filter(F.col("message").isNotNull()).select(
        "scan_id", F.concat("origin", F.lit("/robots.txt")).alias("source"), "message")
    return direct.unionByName(defaults).unionByName(declared), robots_err


class Discovery(NamedTuple):
    urls: DataFrame     # scan_id, url, source, order_key
    errors: DataFrame   # scan_id, source, message, order_key


def discover(queue: DataFrame, parsed: DataFrame, scans: DataFrame, dns: DataFrame | None = None) -> Discovery:
    """SM-5, SM-6 (+URL-7): breadth-first traversal of sitemap sources.

    ``queue``: scan_id, source, pos (initial candidates).  Sources are
    de-duplicated on their canonical URL (fragment dropped, raw text when
    unparseable): the first occurrence in queue order is visited, later ones
    are skipped, so cycles end.  Policy failures (URL rule, then resolved
    addresses), missing documents, documents above the scan's byte limit and
    bad XML become errors; traversal continues.
    """
    verdicts = materialize(FX.dns_verdicts(dns)) if dns is not None else None
    parsed = materialize(limit_documents(parsed, scans))  # bodies are parsed once
    frontier = queue.select("scan_id", "source", F.lit(0).alias("level"),
                            F.array(F.col("pos").cast("int")).alias("path"))
    visited = None
    url_parts, err_parts = [], []
    docs = resolve_redirects(parsed, scans, verdicts).select(
        "scan_id", F.col("doc_key").alias("canonical"), "kind", "locs", "error")
    level = 0
    while True:
        f = FU.with_url(frontier, "source", "_s")
        f = f.withColumn("canonical", F.coalesce(F.col("_s.href_nofrag"), F.col("source")))
        f = FX.with_address_check(f, "_s", verdicts)
        f = f.withColumn("reason", F.coalesce(FU.policy_reason(F.col("_s")), F.col("_s_address"))).drop("_s", "_s_address")
        w = Window.partitionBy("scan_id", "canonical").orderBy("path")
        f = f.withColumn("_rn", F.row_number().over(w)).filter(F.col("_rn") == 1).drop("_rn")
        if visited is not None:
            f = f.join(visited, ["scan_id", "canonical"], "left_anti")
        f = materialize(f.join(docs, ["scan_id", "canonical"], "left"))
        key = F.concat(_pad(F.col("level")), F.lit("."), F.array_join(F.transform("path", lambda x: _pad(x)), "."))
        message = (F.when(F.col("reason").isNotNull(), F.col("reason"))
                   .when(F.col("kind").isNull(), F.lit(MSG_NO_DOCUMENT))
                   .when(F.col("kind") == "error", F.col("error")))
        err_parts.append(f.filter(message.isNotNull()).select("scan_id", "source", message.alias("message"),
                                                              key.alias("order_key")))
        ok = f.filter(message.isNull())
        url_parts.append(ok.filter(F.col("kind") == "urlset").select(
            "scan_id", "source", key.alias("_k"), F.posexplode("locs").alias("_p", "url"))
            .select("scan_id", "url", "source", F.concat("_k", F.lit(":"), _pad(F.col("_p"))).alias("order_key")))
        seen = f.select("scan_id", "canonical")
        visited = seen if visited is None else visited.unionByName(seen)  # f is materialised: only new keys are added
        nxt = ok.filter(F.col("kind") == "index").select(
            "scan_id", F.posexplode("locs").alias("_p", "source"), "path").select(
            "scan_id", "source", F.lit(level + 1).alias("level"),
            F.concat("path", F.array(F.col("_p").cast("int"))).alias("path"))
        nxt = materialize(nxt)
        if nxt.isEmpty():
            break
        frontier = nxt
        level += 1
    urls, errors = url_parts[0], err_parts[0]
    for u in url_parts[1:]:
        urls = urls.unionByName(u)
    for e in err_parts[1:]:
        errors = errors.unionByName(e)
    return Discovery(urls, errors)


def discover_scans(scans: DataFrame, robots_sitemaps: DataFrame, robots_docs: DataFrame, sitemap_docs: DataFrame,
                   dns: DataFrame | None = None) -> tuple[Discovery, DataFrame]:
    """SM-1..SM-9 for all scans: (discovery, robots errors)."""
    verdicts = FX.dns_verdicts(dns) if dns is not None else None
    queue, robots_errors = candidates(scans, robots_sitemaps, robots_docs, verdicts)
    return discover(queue, parse_documents(sitemap_docs), scans, dns), robots_errors


def scan_sitemap_url(scans: DataFrame, urls: DataFrame, now_ms=None) -> DataFrame:
    """SM-8 / ST-14: a scan's sitemap_url is the given one, else the first
    non-empty source (discovery order) that yielded URLs; a scan that gets one
    this way is updated at ``now_ms``."""
    first = urls.filter(F.length("source") > 0).groupBy("scan_id").agg(
        F.min_by("source", "order_key").alias("_first"))
    out = scans.join(first, "scan_id", "left")
    if now_ms is not None:
        found = F.col("sitemap_url").isNull() & F.col("_first").isNotNull()
        out = out.withColumn("updated_ms", F.when(found, now_ms).otherwise(F.col("updated_ms")))
    return out.withColumn("sitemap_url", F.coalesce("sitemap_url", "_first")).drop("_first")
