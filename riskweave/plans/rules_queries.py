"""Queries of the line rules over files and evidence."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from riskweave.operators.rules import RULES, line_findings, rules_sql
from riskweave.runtime import spread, table


def line_rules(spark: SparkSession, d: str) -> DataFrame:
    """R01, R02, R05, R06, R10-R15, R17 on files: every hit of every line rule."""
    return line_findings(spread(table(spark, d, "files", "file_id", "repo", "path", "suffix", "text"))).select("key", "file_id", "line", "severity")


def evidence_rules(spark: SparkSession, d: str) -> DataFrame:
    """The line rules over the evidence of findings, read as one-line Python and JavaScript files."""
    f = table(spark, d, "findings", "finding_id", "repo", "file", "evidence").distinct()
    x = f.select(F.col("finding_id").alias("file_id"), "repo", F.col("file").alias("path"), F.explode(F.array(F.lit(".py"), F.lit(".js"))).alias("suffix"), F.col("evidence").alias("text"))
    return line_findings(spread(x)).groupBy("key", "severity").agg(F.count(F.lit(1)).alias("hits"))


QUERIES = {"line_rules": line_rules, "evidence_rules": evidence_rules}
ORACLE = {
    "line_rules": rules_sql(RULES),
    "evidence_rules": "with e as (select distinct finding_id, repo, file, evidence from findings), files as (select finding_id * 2 + s.n as file_id, repo, file as path, s.suffix as suffix, evidence as text from e, (values (0, '.py'), (1, '.js')) as s(n, suffix)), q as (" + rules_sql(RULES) + ") select key, severity, count(*) as hits from q group by 1, 2",
}
