"""Plan-shape guards for scale: HTML never enters a shuffle, the per-scan cap
is a partial top-k, and filters/projections reach the parquet scan."""

import re

import pytest

from crawlscope.operators import extract as X
from crawlscope.operators import urlset as U
from crawlscope.sources import captures as C

SF = "/root/testdata/sf0.001"


def formatted(df) -> str:
    return df._jdf.queryExecution().explainString(
        df.sparkSession._jvm.org.apache.spark.sql.execution.ExplainMode.fromString("formatted"))


def exchange_inputs(plan: str) -> list[str]:
    """Input column lists of every shuffle Exchange node in a formatted plan."""
    out = []
    for block in re.split(r"\n\(\d+\) ", plan):
        if block.startswith("Exchange") and "hashpartitioning" in block or block.startswith("Exchange\n"):
            m = re.search(r"Input \[\d+\]: \[(.*?)\]", block)
            if m:
                out.append(m.group(1))
    return out


@pytest.mark.skipif(not __import__("os").path.exists(SF), reason="driver test data not present")
def test_no_html_in_shuffles(spark):
    summ = X.summarize_responses(C.responses(spark, SF), C.scans(spark, SF))
    inputs = exchange_inputs(formatted(summ))
    assert inputs, "expected at least one exchange"
    for cols in inputs:
        names = {c.split("#")[0].strip() for c in cols.split(",")}
        assert not names & {"body", "html"}, cols


@pytest.mark.skipif(not __import__("os").path.exists(SF), reason="driver test data not present")
def test_cap_is_partial_top_k(spark):
    cap = U.filter_sitemap_urls(C.discovered(spark, SF), C.scans(spark, SF))
    plan = formatted(cap)
    assert "WindowGroupLimit" in plan and "Partial" in plan


@pytest.mark.skipif(not __import__("os").path.exists(SF), reason="driver test data not present")
def test_scan_prunes_columns(spark):
    reqs = C.page_requests(spark, SF)
    plan = formatted(reqs)
    scan = [b for b in re.split(r"\n\(\d+\) ", plan) if b.startswith("Scan parquet")]
    assert scan and all("html" not in re.search(r"ReadSchema: (.*)", b).group(1) for b in scan)
