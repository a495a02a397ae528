"""crawlscope: analytics over captured website crawls, expressed as Spark jobs.

Inputs are tables of captured responses (robots texts, sitemap texts, HTML
pages) for many sites at once; outputs are page / block / entity tables,
progress counters, JSON / CSV / Markdown exports and an audit of those
exports.  Every public function takes and returns DataFrames.
"""

from crawlscope.session import configure, get_spark

__all__ = ["configure", "get_spark"]
