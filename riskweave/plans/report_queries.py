"""Queries of reports, dependencies and external results."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from riskweave.operators import findings as fd
from riskweave.operators.facts import python_facts
from riskweave.operators.reports import json_reports, sarif
from riskweave.operators.taint import file_findings
from riskweave.runtime import cut, table
from riskweave.sources.external import classifier_hit, verdict
from riskweave.sources.manifests import is_ai_package

_BASE = ("scan_id", "detector", "rule_id", "title", "remediation", "severity", "owasp_llm", "file", "line", "evidence", "confidence", "confidence_tier", "det_ord", "emit_ord")


def json_report_sizes(spark: SparkSession, d: str) -> DataFrame:
    """The JSON document of each scan: number of findings, score and grade read back from it."""
    j = json_reports(fd.delivered(spark, d, *_BASE))
    return j.select("scan_id", F.size(F.from_json(F.get_json_object("json", "$.findings"), "array<struct<rule_id:string>>")).alias("findings"), F.get_json_object("json", "$.score").cast("int").alias("score"), F.get_json_object("json", "$.grade").alias("grade"))


def sarif_documents(spark: SparkSession, d: str) -> DataFrame:
    """The SARIF document of each scan: results and rules read back from it."""
    j = sarif(fd.delivered(spark, d, *_BASE))
    n = lambda p: F.size(F.from_json(F.get_json_object("json", p), "array<struct<id:string>>"))
    return j.select("scan_id", n("$.runs[0].results").alias("results"), n("$.runs[0].tool.driver.rules").alias("rules"))


def dependency_evidence(spark: SparkSession, d: str) -> DataFrame:
    """Evidence of the dependency rules by whether it names a package of the AI ecosystem."""
    f = fd.delivered(spark, d, "rule_id", "evidence").where("rule_id like 'ORTHO-DEP-%'")
    return f.groupBy("rule_id", is_ai_package("evidence").alias("ai_package")).agg(F.count(F.lit(1)).alias("findings"))


def evidence_syntax(spark: SparkSession, d: str) -> DataFrame:
    """completion calls without a cap among evidence that parses as Python, by rule."""
    f = fd.delivered(spark, d, "rule_id", "evidence")
    x = f.select(F.col("finding_id").alias("file_id"), F.lit(".py").alias("suffix"), F.trim("evidence").alias("text"), "rule_id")
    u = file_findings(cut(python_facts(x))).where("rule_id = 'ORTHO-CONSUME-001'").select("file_id", (F.col("severity") == "MEDIUM").alias("explicit"))
    return u.join(x, "file_id").groupBy("rule_id", "explicit").agg(F.count(F.lit(1)).alias("calls"))


def model_answers(spark: SparkSession, d: str) -> DataFrame:
    """Verdicts and labels read from model answers made of all findings."""
    f = fd.delivered(spark, d, "confidence_tier", "severity", "confidence", "evidence")
    tier = F.when(F.col("confidence_tier") == "deterministic", "confirmed").otherwise(F.coalesce("confidence_tier", F.lit("none")))
    spoken = F.concat(F.lit("I say "), tier, F.when(F.col("severity") == "LOW", F.lit(", not false")).otherwise(F.lit("")))
    answer = F.when(F.col("finding_id") % 3 == 0, spoken).otherwise(F.concat(F.lit("Sure: "), F.to_json(F.struct(F.upper(tier).alias("verdict"), F.lit("not confirmed").alias("reason"))), F.lit(" done")))
    score = F.when(F.isnan("confidence"), 0.0).otherwise(F.coalesce("confidence", F.lit(0.0)))
    items = F.to_json(F.array(F.struct(F.lit("SAFE").alias("label"), F.lit(2.0).alias("score")), F.struct(F.coalesce("severity", F.lit("benign")).alias("label"), score.alias("score"))))
    return f.select("finding_id", verdict(answer).alias("verdict"), classifier_hit(items).alias("label"))


QUERIES = {f.__name__: f for f in (json_report_sizes, sarif_documents, dependency_evidence, evidence_syntax, model_answers)}
from riskweave.plans.findings_queries import _F, _ORDER, _TRUST  # noqa: E402

ORACLE = {
    "json_report_sizes": f"""{_F}, x as (select g.*, s.weight, row_number() over (partition by scan_id, owasp_llm, g.severity order by {_ORDER.replace('sev_value', 'g.sev_value')}) - 1 as n from g join sev s on s.severity = g.severity where {_TRUST}),
 p as (select scan_id, sum(weight * pow(0.6, n) * conf) as penalty from x group by scan_id), c as (select scan_id, count(*) as findings from g group by scan_id),
 q as (select c.scan_id, c.findings, coalesce(least(100, greatest(0, round_even(100 * exp(-penalty / 100), 0)))::int, 100) as score from c left join p on p.scan_id = c.scan_id)
 select scan_id, findings::int as findings, score, case when score >= 90 then 'A' when score >= 75 then 'B' when score >= 60 then 'C' when score >= 40 then 'D' else 'F' end as grade from q""",
    "sarif_documents": f"{_F} select scan_id, count(*)::int as results, count(distinct rule_id)::int as rules from g where sev_value is not null group by scan_id",
    "model_answers": f"""{_F}, t as (select *, case when confidence_tier = 'deterministic' then 'confirmed' else coalesce(confidence_tier, 'none') end as tier, coalesce(case when isnan(confidence) then 0 else confidence end, 0) as score from g)
 select finding_id, case when finding_id % 3 = 0 then case when contains(tier, 'confirmed') then 'confirmed' when contains(tier, 'false') or severity = 'LOW' then 'false_positive' else 'uncertain' end
  when lower(tier) in ('confirmed', 'uncertain', 'false_positive') then lower(tier) else 'uncertain' end as verdict,
 case when severity is not null and score >= 0.5 then severity end as label from t""",
}
