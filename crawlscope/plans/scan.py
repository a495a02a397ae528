"""End-to-end scan over captured data for every scan at once:
candidates -> sitemap discovery -> URL policy, dedup and cap -> fetch
resolution -> extraction -> page status, blocks and entities."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from crawlscope.operators import extract as X
from crawlscope.operators import robots as R
from crawlscope.operators import sitemaps as S
from crawlscope.operators import urlset as U


def run_scans(scans: DataFrame, robots_docs: DataFrame, sitemap_docs: DataFrame, responses: DataFrame,
              dns: DataFrame | None = None, with_entities: bool = True) -> tuple[X.ScanTables, DataFrame]:
    """Returns the scan tables and the scans with their discovered sitemap_url (SM-8)."""
    disc, _robots_errors = S.discover_scans(scans, R.sitemaps(robots_docs), robots_docs, sitemap_docs, dns)
    capped = U.filter_sitemap_urls(disc.urls.withColumnRenamed("order_key", "seq"), scans)
    requests = capped.select("scan_id", "url", F.col("first_seq").alias("seq"),
                             F.col("source").alias("sitemap_source"))
    tables = X.process_pages(requests, responses, scans, dns, with_entities=with_entities)
    return tables, S.scan_sitemap_url(scans, disc.urls)
