"""URL lists of scans: policy, ordered distinct + cap, attribution, requests,
settings and export names (URL-1..URL-10, SM-7, AG-2, EX-10, EX-11, SNK-9)."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from crawlscope.functions import urls as FU

# Fixed request messages.
MSG_BAD_TARGET = "Target URL must be valid HTTP(S)"
MSG_BAD_SITEMAP = "Sitemap URL must be valid HTTP(S)"

# Fixed settings: name -> (min, max, default); flags default to true.
SETTINGS_RANGES = {
    "maxUrls": (1, 500, 500),
    "concurrency": (1, 16, 4),
    "delayMs": (0, 60_000, 250),
    "timeoutMs": (1_000, 120_000, 15_000),
    "maxResponseBytes": (1_000, 50_000_000, 5_000_000),
    "maxRedirects": (0, 10, 5),
}
SETTINGS_FLAGS = ("respectRobots", "sameOriginOnly")
# Upper bound of max_urls guaranteed by settings normalisation.
MAX_URLS_BOUND = SETTINGS_RANGES["maxUrls"][1]


def _snake(name: str) -> str:
    return "".join("_" + ch.lower() if ch.isupper() else ch for ch in name)


def filter_sitemap_urls(discovered: DataFrame, scans: DataFrame, order_col: str = "seq",
                        bound: int = MAX_URLS_BOUND) -> DataFrame:
    """URL-4..URL-7, SM-7: normalise against each scan's target origin, skip
    entries failing policy or outside the origin, keep the first occurrence of
    each normalised URL (with its source), and cap at ``max_urls`` in
    discovery order.

    ``discovered``: scan_id, url, source, ``order_col`` (any orderable key).
    Output: scan_id, url (normalised), source, first_seq, rank.
    The dedup is a hash aggregate on (scan_id, url) - fine-grained keys, no
    hot group; the cap is a top-k per scan with a literal bound, which Spark
    plans as a WindowGroupLimit (partial top-k before the shuffle), so a scan
    holding most URLs sends at most ``bound`` rows per task.  ``bound`` must
    cover every scan's ``max_urls`` (a larger one fails the job); a scan
    without ``max_urls`` gets the default.
    """
    cap = F.coalesce("max_urls", F.lit(SETTINGS_RANGES["maxUrls"][2]))
    cap = F.when(cap > bound, F.raise_error(F.lit(f"a scan's max_urls exceeds the bound {bound}")).cast("int")).otherwise(cap)
    targets = FU.with_url(scans.select("scan_id", "target_url", "max_urls"), "target_url", "_tgt").select(
        "scan_id", cap.alias("max_urls"), F.col("_tgt.origin").alias("target_origin"))
    d = FU.with_url(discovered.join(targets, "scan_id"), "url", "_u")
    d = d.filter(FU.policy_reason(F.col("_u")).isNull() & (F.col("_u.origin") == F.col("target_origin")))
    firsts = d.groupBy("scan_id", F.col("_u.href_nofrag").alias("url")).agg(
        F.min(order_col).alias("first_seq"),
        F.min_by("source", order_col).alias("source"),
        F.first("max_urls").alias("max_urls"))
    w = Window.partitionBy("scan_id").orderBy("first_seq", "url")
    ranked = firsts.withColumn("rank", F.row_number().over(w)).filter(F.col("rank") <= bound)
    return ranked.filter(F.col("rank") <= F.col("max_urls")).drop("max_urls")


def url_counts(capped: DataFrame) -> DataFrame:
    """AG-2: discovered = queued = size of the capped list per scan."""
    return capped.groupBy("scan_id").agg(F.count(F.lit(1)).alias("discovered")) \
        .withColumn("queued", F.col("discovered"))


def validate_requests(requests: DataFrame) -> DataFrame:
    """URL-1, EX-11: accept or reject scan requests.

    requests: request_id, target_url, sitemap_url (nullable).  Output adds
    target_href, sitemap_href, reject_reason (NULL when accepted) and
    target_reason (the URL-1 rule that failed).
    """
    r = FU.with_url(FU.with_url(requests, "target_url", "_t"), "sitemap_url", "_s")
    t_reason = FU.policy_reason(F.col("_t"))
    s_reason = F.when(F.col("sitemap_url").isNotNull(), FU.policy_reason(F.col("_s")))
    reject = (F.when(F.col("target_url").isNull() | t_reason.isNotNull(), F.lit(MSG_BAD_TARGET))
              .when(s_reason.isNotNull(), F.lit(MSG_BAD_SITEMAP)))
    return r.select("request_id", "target_url", "sitemap_url",
                    F.when(t_reason.isNull(), F.col("_t.href")).alias("target_href"),
                    F.when(F.col("sitemap_url").isNotNull() & s_reason.isNull(), F.col("_s.href")).alias("sitemap_href"),
                    t_reason.alias("target_reason"), reject.alias("reject_reason"))


def normalize_settings(df: DataFrame, json_col: str) -> DataFrame:
    """EX-10: settings JSON text -> typed settings columns.

    Numbers out of range, non-numbers and non-finite values fall back to the
    default (no clamping); in-range numbers round half up (``floor(x+0.5)``);
    flags are true unless literally ``false``; a non-object gives defaults.
    """
    v = F.try_parse_json(F.col(json_col))
    is_obj = F.coalesce(F.schema_of_variant(v).startswith("OBJECT"), F.lit(False))
    cols = {}
    for key, (lo, hi, default) in SETTINGS_RANGES.items():
        x = F.try_variant_get(v, f"$.{key}", "variant")
        t = F.schema_of_variant(x)
        numeric = t.isin("BIGINT", "INT", "SMALLINT", "TINYINT", "DOUBLE", "FLOAT") | t.startswith("DECIMAL")
        val = F.try_variant_get(x, "$", "double")
        ok = is_obj & F.coalesce(numeric & ~F.isnan(val) & (val >= lo) & (val <= hi), F.lit(False))
        cols[_snake(key)] = F.when(ok, F.floor(val + 0.5).cast("int")).otherwise(F.lit(default))
    for key in SETTINGS_FLAGS:
        x = F.try_variant_get(v, f"$.{key}", "variant")
        is_false = (F.schema_of_variant(x) == "BOOLEAN") & (F.try_variant_get(x, "$", "boolean") == F.lit(False))
        cols[_snake(key)] = ~F.coalesce(is_obj & is_false, F.lit(False))
    return df.withColumns(cols)


def export_names(df: DataFrame, target_col: str, page_col: str | None) -> DataFrame:
    """URL-9, URL-10, SNK-9: export basenames (site and page) per row."""
    out = FU.with_url(df, target_col, "_tg")
    host = FU.host_label(F.col("_tg"))
    out = out.withColumn("host_label", host).withColumn("site_basename", F.concat(host, F.lit("-schema-scan")))
    if page_col is not None:
        out = FU.with_url(out, page_col, "_pg")
        slug = F.when(F.col(page_col).isNull(), F.lit("page")).otherwise(FU.path_slug(F.col("_pg")))
        out = (out.withColumn("page_slug", slug)
               .withColumn("page_basename", F.concat(host, F.lit("-"), slug, F.lit("-schema-page"))).drop("_pg"))
    return out.drop("_tg")


def export_extension(fmt) -> F.Column:
    """SNK-9: file extension for an export format."""
    c = F.col(fmt) if isinstance(fmt, str) else fmt
    return F.when(c == "markdown", F.lit("md")).otherwise(c)


def scans_from_requests(requests: DataFrame, json_col: str = "settings_json") -> DataFrame:
    """EX-10 + EX-11 -> SNK-4: accepted scan requests become queued scans
    (target and sitemap as normalised hrefs, typed settings); rejected
    requests are left out (see ``validate_requests`` for their reasons)."""
    ok = validate_requests(requests).filter(F.col("reject_reason").isNull())
    settings = normalize_settings(requests.select("request_id", json_col), json_col).drop(json_col)
    return ok.join(settings, "request_id").select(
        F.concat(F.lit("scan-"), F.col("request_id").cast("string")).alias("scan_id"),
        F.col("target_href").alias("target_url"), F.col("sitemap_href").alias("sitemap_url"),
        *[_snake(k) for k in SETTINGS_RANGES], *[_snake(k) for k in SETTINGS_FLAGS],
        F.lit("queued").alias("status"))
