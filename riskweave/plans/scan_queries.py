"""Queries over a scan of the present files."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from riskweave.operators import marts
from riskweave.operators.scan import scan
from riskweave.runtime import cut, table


def _scan(spark: SparkSession, d: str) -> DataFrame:
    return scan(table(spark, d, "files", "file_id", "repo", "path", "suffix", "text"))


def scan_findings(spark: SparkSession, d: str) -> DataFrame:
    """All rules over all files, suppressed and deduplicated."""
    return _scan(spark, d).select("file_id", "repo", "file", "line", "detector", "rule_id", "severity", "owasp_llm", "confidence", "location", "fingerprint", F.size("trace").alias("steps"))


def scan_posture(spark: SparkSession, d: str) -> DataFrame:
    """A02, A03 over the scan: score and grade of each repo."""
    return marts.posture(cut(_scan(spark, d)), "repo").select("repo", "findings", "penalty", "score", "grade")


QUERIES = {"scan_findings": scan_findings, "scan_posture": scan_posture}
ORACLE: dict = {}
