"""Export every scan in all three formats, read the artifacts back in ranges
and audit them (SNK-1..3, SRC-4, AU-1..AU-22)."""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession

from crawlscope.operators import artifact as AR
from crawlscope.operators import audit as A
from crawlscope.operators import ranges as RG
from crawlscope.operators.extract import ScanTables
from crawlscope.session import checkpoint_dir


def audit_artifacts(a: A.Artifacts) -> tuple[DataFrame, DataFrame]:
    """Findings of all artifact checks, and their coverage."""
    findings = A.damage_findings(a)
    for part in (A.json_checks(a), A.csv_checks(a), A.markdown_checks(a), A.cross_format(a)):
        findings = findings.unionByName(part)
    return findings, A.coverage(a)


def export_folder(spark: SparkSession) -> str:
    return f"{checkpoint_dir(spark).rstrip('/')}/exports-{uuid.uuid4().hex}"


def audit_exports(spark: SparkSession, scans: DataFrame, t: ScanTables, folder: str | None = None) -> tuple[DataFrame, DataFrame]:
    """Exports, reads back and audits: (findings, coverage)."""
    folder = folder or export_folder(spark)
    manifest, _ = AR.export_scans(scans, t, folder)
    findings, coverage = audit_artifacts(A.read_artifacts(RG.part_ranges(manifest, folder)))
    return findings.unionByName(A.observation_checks(t.pages, t.blocks, t.entities)), coverage
