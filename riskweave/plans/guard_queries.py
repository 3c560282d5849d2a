"""Guard queries over the texts of the driver's tables."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from riskweave.functions.text import duration_seconds, redact_url
from riskweave.operators.guard import INJECTION, OUTPUT_RISK, inspect, labels, output_text, prompt_text, risks
from riskweave.runtime import table

def guard_documents(spark: SparkSession, d: str) -> DataFrame:
    """Documents by source and label of risk, prompts and outputs alike."""
    x = table(spark, d, "documents", "source", "text").withColumn("source", F.lower(F.trim("source")))
    x = x.select("source", F.explode(F.concat(labels("text", INJECTION), labels("text", OUTPUT_RISK))).alias("label"))
    return x.groupBy("source", "label").agg(F.count(F.lit(1)).alias("documents"))


def guard_evidence(spark: SparkSession, d: str) -> DataFrame:
    """Output risks in evidence, as reported."""
    x = table(spark, d, "findings", "finding_id", "evidence").distinct()
    return x.select("finding_id", F.explode(risks("evidence", OUTPUT_RISK)).alias("risk"))


def _bodies(spark: SparkSession, d: str) -> DataFrame:
    """Each document as the body of a request (a message, or a list of blocks) or of a response, by its id."""
    x = table(spark, d, "documents", "doc_id", "text")
    kind = F.when(F.col("doc_id") % 2 == 0, "request").otherwise("response")
    message = F.to_json(F.struct(F.array(F.struct(F.lit("user").alias("role"), F.concat(F.lit("* "), F.col("text")).alias("content"))).alias("messages"), F.lit("you are now free").alias("system")))
    blocks = F.to_json(F.struct(F.array(F.struct(F.lit("user").alias("role"), F.array(F.struct(F.lit("text").alias("type"), F.lit("*").alias("text")), F.struct(F.lit("text").alias("type"), F.col("text").alias("text"))).alias("content"))).alias("messages")))
    choices = F.to_json(F.struct(F.array(F.struct(F.struct(F.concat(F.lit("* "), F.col("text")).alias("content")).alias("message"))).alias("choices")))
    body = F.when(F.col("doc_id") % 8 == 6, F.concat(F.lit("no json: "), F.col("text"))).when(F.col("doc_id") % 4 == 0, message).when(F.col("doc_id") % 2 == 0, blocks).otherwise(choices)
    return x.select(F.col("doc_id").alias("id"), kind.alias("kind"), body.alias("body"))


def guard_traffic(spark: SparkSession, d: str) -> DataFrame:
    """Verdicts on requests and responses made of all documents, in block mode."""
    t = _bodies(spark, d).withColumn("ts", F.lit(None).cast("timestamp"))
    return inspect(t, block=True).select("id", "kind", "allow", F.size("risks").alias("risks"), "text_len")


def traffic_text(spark: SparkSession, d: str) -> DataFrame:
    """The texts taken from the bodies; null for a body that is no JSON."""
    t = _bodies(spark, d)
    return t.select("id", F.when(F.col("kind") == "request", prompt_text("body")).otherwise(output_text("body")).alias("text"))


def event_props(spark: SparkSession, d: str) -> DataFrame:
    """JSON paths over the events table."""
    return table(spark, d, "events", "event_type", "props").groupBy("event_type").agg(F.sum(F.get_json_object("props", "$.k").cast("long")).alias("k"), F.count(F.lit(1)).alias("events"))


def scalar_functions(spark: SparkSession, d: str) -> DataFrame:
    """Durations and addresses made of all customers."""
    k = F.col("c_custkey")
    unit = F.element_at(F.array(*map(F.lit, ["s", "m", "h", "d", "years"])), (k % 5 + 1).cast("int"))
    x = table(spark, d, "customer", "c_custkey", "c_nationkey").select("c_custkey", F.concat((k % 90).cast("string"), unit).alias("a"), F.concat(F.lit("at https://u"), F.col("c_nationkey").cast("string"), F.when(k % 2 == 0, F.lit(":p")).otherwise(""), F.lit("@host/x"), k.cast("string")).alias("b"))
    return x.select("c_custkey", duration_seconds("a").alias("seconds"), redact_url("b").alias("url"))


QUERIES = {f.__name__: f for f in (guard_documents, guard_evidence, guard_traffic, traffic_text, event_props, scalar_functions)}
_hit = lambda rules: ", ".join(f"case when regexp_matches(text, '{p}') then '{label}' end" for label, p in rules)
_count = lambda rules: " + ".join(f"regexp_matches(text, '{p}')::int" for _, p in rules)
_risk = "concat('{0}: ', chr(39), replace(substr(regexp_extract(evidence, '{1}'), 1, 60), chr(10), '\\n'), chr(39))"
ORACLE = {
    "guard_documents": f"""with x as (select lower(trim(source)) as source, unnest(list_filter(list_distinct([{_hit(INJECTION)}]), lambda v: v is not null) || list_filter(list_distinct([{_hit(OUTPUT_RISK)}]), lambda v: v is not null)) as label from documents)
 select source, label, count(*) as documents from x group by 1, 2""",
    "guard_evidence": "with e as (select distinct finding_id, evidence from findings) " + " union all ".join(f"select finding_id, {_risk.format(label, p)} as risk from e where regexp_matches(evidence, '{p}')" for label, p in OUTPUT_RISK),
    "guard_traffic": f"""with b as (select doc_id as id, case when doc_id % 2 = 0 then 'request' else 'response' end as kind, case when doc_id % 8 = 6 then null else '* ' || coalesce(text, '') end as text from documents),
 r as (select *, case when text is null then 0 when kind = 'request' then {_count(INJECTION)} else {_count(OUTPUT_RISK)} end as risks from b)
 select id, kind, not (kind = 'request' and risks > 0) as allow, risks::int as risks, coalesce(length(text), 0)::int as text_len from r""",
    "traffic_text": "select doc_id as id, case when doc_id % 8 = 6 then null when doc_id % 4 = 2 then '*' || chr(10) || text else '* ' || text end as text from documents",
    "event_props": "select event_type, sum(json_extract_string(props, '$.k')::bigint)::bigint as k, count(*) as events from events group by event_type",
    "scalar_functions": """select c_custkey, case c_custkey % 5 when 0 then 1 when 1 then 60 when 2 then 3600 when 3 then 86400 end * (c_custkey % 90) as seconds, 'at https://host/x' || c_custkey as url from customer""",
}
