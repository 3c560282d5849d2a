"""Queries of problem 7 (a few keys hold most records) with their SQL."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from riskweave.operators.heavy_keys import heavy_keys, key_percentiles, key_summary
from riskweave.runtime import table


def detector_name(c: str | Column = "detector") -> Column:
    """Detector names equal up to letter case and ``_`` or ``-``."""
    return F.lower(F.replace(F.trim(c), F.lit("_"), F.lit("-")))


def clean_confidence(c: str | Column = "confidence") -> Column:
    """Confidence clamped to 0..1; NaN becomes null."""
    x = F.col(c) if isinstance(c, str) else c
    return F.when(x.isNotNull() & ~F.isnan(x), F.least(F.lit(1.0), F.greatest(F.lit(0.0), x)))


def _distinct_findings(spark: SparkSession, d: str) -> DataFrame:
    """One row a finding_id: repeated deliveries are equal rows, so the pre-aggregated minimum is that row."""
    f = table(spark, d, "findings", "finding_id", "rule_id", "detector", "repo", "confidence")
    return (
        f.groupBy("finding_id")
        .agg(F.min(F.struct("rule_id", detector_name().alias("detector"), "repo", clean_confidence().alias("conf"))).alias("x"))
        .select("finding_id", "x.*")
    )


def p7_found(spark: SparkSession, d: str) -> DataFrame:
    """rule_ids with more than 5 % of the distinct finding_ids."""
    return heavy_keys(table(spark, d, "findings", "rule_id", "finding_id"), "rule_id", "finding_id", 0.05).select("rule_id")


def _stats(spark: SparkSession, d: str, key: str) -> DataFrame:
    f = _distinct_findings(spark, d)
    a = key_summary(f, key, "conf").select(key, F.col("n").alias("findings"), F.round("mean", 6).alias("mean_confidence"), F.round("mode", 6).alias("mode_confidence"))
    b = key_summary(f, key, "repo").select(F.col(key).alias("_k"), F.col("n_values").alias("repos"))
    return a.join(b, F.col(key).eqNullSafe(F.col("_k"))).select(key, "findings", "mean_confidence", "mode_confidence", "repos")


def p7_rule_stats(spark: SparkSession, d: str) -> DataFrame:
    """Count, mean and mode of confidence, and number of repos of each rule_id."""
    return _stats(spark, d, "rule_id")


def p7_detector_stats(spark: SparkSession, d: str) -> DataFrame:
    """Count, mean and mode of confidence, and number of repos of each detector."""
    return _stats(spark, d, "detector")


def p7_confidence_percentiles(spark: SparkSession, d: str) -> DataFrame:
    """Exact 10th, 50th and 90th percentile of confidence for each detector."""
    return key_percentiles(_distinct_findings(spark, d), "detector", "conf", [0.1, 0.5, 0.9]).select("detector", "p", F.round("value", 6).alias("confidence"))


_DIST = """with f as (select finding_id, min(rule_id) as rule_id, min(lower(replace(trim(detector),'_','-'))) as detector,
 min(repo) as repo, min(case when not isnan(confidence) then least(1.0, greatest(0.0, confidence)) end) as conf
 from findings group by finding_id)"""


def _sql(key: str) -> str:
    return f"""{_DIST}, m as (select {key}, conf, row_number() over (partition by {key} order by count(*) desc, conf) as rn
 from f where conf is not null group by {key}, conf)
select f.{key}, count(*) as findings, round(avg(f.conf), 6) as mean_confidence,
 round(max(m.conf), 6) as mode_confidence, count(distinct f.repo) as repos
from f left join m on m.{key} = f.{key} and m.rn = 1 group by f.{key}"""


QUERIES = {
    "p7_found": p7_found,
    "p7_rule_stats": p7_rule_stats,
    "p7_detector_stats": p7_detector_stats,
    "p7_confidence_percentiles": p7_confidence_percentiles,
}
ORACLE = {
    "p7_found": """select rule_id from findings where rule_id is not null group by rule_id
 having count(distinct finding_id) > 0.05 * (select count(distinct finding_id) from findings)""",
    "p7_rule_stats": _sql("rule_id"),
    "p7_detector_stats": _sql("detector"),
    "p7_confidence_percentiles": f"""{_DIST}, r as (select detector, conf, row_number() over (partition by detector order by conf) as rn,
 count(*) over (partition by detector) as n from f where conf is not null),
 p as (select unnest([0.1, 0.5, 0.9]::double[]) as p)
select r.detector, p.p, round(min(r.conf), 6) as confidence from r, p where r.rn >= greatest(1, ceil(p.p * r.n)) group by r.detector, p.p""",
}
