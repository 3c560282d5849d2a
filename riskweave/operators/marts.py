"""Posture marts: score, grade, severities, business risk, compliance, rates, benchmark figures."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from riskweave.functions.text import clamp01, grade
from riskweave.operators import dims
from riskweave.operators.dims import DECAY
from riskweave.operators.findings import rank_order, trusted


def posture(f: DataFrame, by: str = "scan_id") -> DataFrame:
    """(by, findings, penalty, score, grade): weights decay by 0.6 for each further finding of a category and severity.

    Findings without a known severity weigh nothing. Only trusted findings count.
    """
    s = F.broadcast(dims.severities(f.sparkSession).select("severity", "weight"))
    x = trusted(f).withColumn("_conf", clamp01("confidence")).join(s, "severity")
    w = Window.partitionBy(by, "owasp_llm", "severity").orderBy(*rank_order())
    x = x.withColumn("p", F.col("weight") * F.pow(F.lit(DECAY), F.row_number().over(w) - 1) * F.col("_conf"))
    g = x.groupBy(by).agg(F.count(F.lit(1)).alias("findings"), F.sum("p").alias("penalty"))
    score = F.least(F.lit(100), F.greatest(F.lit(0), F.bround(100 * F.exp(-F.col("penalty") / 100)).cast("int")))
    return g.withColumn("score", score).withColumn("grade", grade("score")).withColumn("penalty", F.round("penalty", 4))


def severity_counts(f: DataFrame, *by: str) -> DataFrame:
    return trusted(f).where("severity is not null").groupBy(*by, "severity").agg(F.count(F.lit(1)).alias("findings"))


def risk_drivers(f: DataFrame, by: str = "repo") -> DataFrame:
    """Per category: count, worst severity, loss band, consequence, and its place among the drivers of ``by``."""
    s = F.broadcast(dims.severities(f.sparkSession).select("severity", "ale_low", "ale_high"))
    o = F.broadcast(dims.owasp(f.sparkSession).select("owasp_llm", "owasp_name", "consequence"))
    g = f.join(s, "severity").groupBy(by, "owasp_llm").agg(F.count(F.lit(1)).alias("findings"), F.max("sev_value").alias("worst"), F.sum("ale_low").alias("ale_low"), F.sum("ale_high").alias("ale_high"))
    g = g.join(o, "owasp_llm", "left").withColumn("owasp_name", F.coalesce("owasp_name", F.lit("Unknown"))).withColumn("consequence", F.coalesce("consequence", F.lit("")))
    return g.withColumn("driver", F.row_number().over(Window.partitionBy(by).orderBy(F.desc("worst"), F.desc("findings"), "owasp_llm")))


def compliance(f: DataFrame, *by: str) -> DataFrame:
    """(by, framework, control, description, findings, rules): distinct sorted rules that touch each control."""
    spark = f.sparkSession
    # distinct (category, rule) pairs are few; they are built before the join fans out to the controls
    g = f.groupBy(*by, "owasp_llm", "rule_id").agg(F.count(F.lit(1)).alias("n"))
    g = g.join(F.broadcast(dims.owasp_controls(spark)), "owasp_llm").join(F.broadcast(dims.controls(spark)), ["framework", "control"], "left")
    g = g.withColumn("description", F.coalesce("description", F.lit("")))
    return g.groupBy(*by, "framework", "control", "description").agg(F.sum("n").alias("findings"), F.array_sort(F.collect_set("rule_id")).alias("rules"))


def assign_agents(f: DataFrame) -> DataFrame:
    """``f`` with the remediation agent of its detector, or the fallback."""
    a = F.broadcast(dims.agents(f.sparkSession))
    i, n, auto = dims.FALLBACK_AGENT
    return f.join(a, "detector", "left").withColumns({"agent_id": F.coalesce("agent_id", F.lit(i)), "agent_name": F.coalesce("agent_name", F.lit(n)), "auto_available": F.coalesce("auto_available", F.lit(auto))})


def gate(f: DataFrame, by: str, fail_on: int = 4) -> DataFrame:
    """(by, worst, exit_code): 1 when a trusted finding reaches ``fail_on``."""
    g = trusted(f).groupBy(by).agg(F.max("sev_value").alias("worst"))
    return g.withColumn("exit_code", F.when(F.col("worst") >= fail_on, 1).otherwise(0))


def shown_by_profile(f: DataFrame) -> DataFrame:
    """(profile, shown, hidden, advisory): findings above, below the profile's floor, and advisory ones."""
    # severities and tiers are counted first: at most a dozen rows meet the four profiles
    c = f.groupBy("sev_value", F.coalesce("confidence_tier", F.lit("")).alias("tier")).agg(F.count(F.lit(1)).alias("n"))
    four = F.array(*[F.struct(F.lit(p[0]).alias("profile"), F.lit(p[1]).alias("floor")) for p in dims.PROFILES])
    x = c.withColumn("p", F.explode(four)).select("sev_value", "tier", "n", "p.profile", "p.floor")
    adv, up = F.col("tier") == "advisory", F.col("sev_value") >= F.col("floor")
    pick = lambda cond, name: F.sum(F.when(cond, F.col("n")).otherwise(0)).alias(name)
    return x.groupBy("profile").agg(pick(~adv & up, "shown"), pick(~adv & ~F.coalesce(up, F.lit(False)), "hidden"), pick(adv, "advisory"))


def precision_recall(cases: DataFrame) -> DataFrame:
    """``cases`` (category, expected, fired) as (category, tp, fp, fn, precision, recall, f1), with a row for all.

    An empty denominator counts as 1 for precision and recall.
    """
    t = lambda c, n: F.sum(F.when(c, 1).otherwise(0)).alias(n)
    e, f = F.col("expected"), F.col("fired")
    g = cases.rollup("category").agg(t(e & f, "tp"), t(~e & f, "fp"), t(e & ~f, "fn"))
    g = g.withColumn("category", F.coalesce("category", F.lit("ALL")))
    ratio = lambda a, b: F.when(a + b == 0, 1.0).otherwise(a / (a + b))
    g = g.withColumn("precision", ratio(F.col("tp"), F.col("fp"))).withColumn("recall", ratio(F.col("tp"), F.col("fn")))
    return g.withColumn("f1", F.when(F.col("precision") + F.col("recall") == 0, 0.0).otherwise(2 * F.col("precision") * F.col("recall") / (F.col("precision") + F.col("recall"))))


def case_status(cases: DataFrame) -> DataFrame:
    """``cases`` (case, expect, fired, known_miss) with status caught, known-miss or REGRESSION."""
    ok = F.array_sort(F.array_intersect("fired", "expect")) == F.array_sort(F.array_distinct("expect"))
    return cases.withColumn("status", F.when(ok, "caught").when(F.col("known_miss"), "known-miss").otherwise("REGRESSION"))
