"""External results as tables: analyzer output, baselines, labelled corpora, model verdicts."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

# Categories of an analyzer's check, in order of preference, and its severities.
CATEGORY = [("LLM01", r"(?i)prompt.?inject"), ("LLM02", r"(?i)secret|credential|api.?key|token"), ("LLM05", r"(?i)eval|exec|xss|sql|innerhtml|command.?inject|output"), ("LLM03", r"(?i)pickle|deserial|torch\.load|supply"), ("LLM06", r"(?i)agency|tool"), ("LLM10", r"(?i)max.?tokens|unbounded|rate.?limit")]
LEVELS = {"ERROR": "HIGH", "WARNING": "MEDIUM", "INFO": "LOW"}
RESULT = "struct<results:array<struct<check_id:string,path:string,start:struct<line:int>,extra:struct<severity:string,message:string,lines:string,fix:string,metadata:string>>>>"


def first_match(text: Column, pairs: list[tuple[str, str]], default: str) -> Column:
    """The name of the first pattern that matches."""
    c = F.lit(default)
    for name, p in reversed(pairs):
        c = F.when(text.rlike(p), name).otherwise(c)
    return c


def analyzer_findings(raw: DataFrame, column: str = "json") -> DataFrame:
    """Findings of analyzer result documents, each (rule, file, line) once; documents that are no JSON give none."""
    x = raw.select(F.explode(F.from_json(column, RESULT)["results"]).alias("r")).select("r.*")
    # an unknown category stays empty; one named in the metadata stands when it is of the list
    meta = F.coalesce("extra.metadata", F.lit(""))
    check = F.when(F.coalesce("check_id", F.lit("")) == "", "semgrep").otherwise(F.col("check_id"))
    message = F.trim(F.when(F.coalesce("extra.message", F.lit("")) == "", check).otherwise(F.col("extra.message")))
    own = F.trim(F.coalesce(F.get_json_object(meta, "$.owasp"), F.lit("")))
    lines = F.regexp_replace(F.coalesce("extra.lines", F.lit("")), r"^\s+|\s+$", "")
    sev = F.coalesce(F.element_at(F.create_map(*[F.lit(v) for kv in LEVELS.items() for v in kv]), F.upper("extra.severity")), F.lit("MEDIUM"))
    about = F.concat_ws(" ", check, message, meta)
    f = x.select(
        F.concat(F.lit("SEMGREP:"), F.substring(F.element_at(F.split(check, r"\."), -1), 1, 60)).alias("rule_id"),
        F.substring(F.split(message, "\n")[0], 1, 120).alias("title"),
        sev.alias("severity"),
        F.when(own.startswith("LLM"), own).otherwise(first_match(about, CATEGORY, "")).alias("owasp_llm"),
        F.col("path").alias("file"),
        F.coalesce("start.line", F.lit(0)).alias("line"),
        F.substring(F.when(lines == "", message).otherwise(lines), 1, 200).alias("evidence"),
        F.lit(0.75).alias("confidence"),
    )
    return f.groupBy("rule_id", "file", "line").agg(F.min(F.struct("title", "severity", "owasp_llm", "evidence", "confidence")).alias("x")).select("rule_id", "file", "line", "x.*")


def read_baseline(spark: SparkSession, path: str) -> DataFrame:
    """(fingerprint) of a baseline file ``{"version": 1, "fingerprints": [...]}``; a broken file accepts nothing."""
    j = spark.read.schema("version int, fingerprints array<string>").option("multiLine", True).option("mode", "PERMISSIVE").json(path)
    return j.select(F.explode("fingerprints").alias("fingerprint")).distinct()


def write_baseline(f: DataFrame, path: str) -> None:
    """The sorted distinct fingerprints as one JSON document."""
    g = f.select(F.lower("fingerprint").alias("fp")).where("fp is not null").agg(F.array_sort(F.collect_set("fp")).alias("fingerprints"))
    g.select(F.lit(1).alias("version"), "fingerprints").coalesce(1).write.mode("overwrite").json(path)


def labelled_cases(spark: SparkSession, path: str) -> DataFrame:
    """(file, expect, known_miss) of a labelled corpus ``{"cases": [{file, expect, known_miss}]}``."""
    j = spark.read.schema("cases array<struct<file:string,expect:array<string>,known_miss:boolean>>").option("multiLine", True).json(path)
    return j.select(F.explode("cases").alias("c")).select("c.file", "c.expect", F.coalesce("c.known_miss", F.lit(False)).alias("known_miss"))


def verdict(text: str | Column) -> Column:
    """confirmed, uncertain or false_positive: of the outermost JSON object in a model's answer, else by its words, confirmed
    first; null for a null answer."""
    t = F.col(text) if isinstance(text, str) else text
    json = F.regexp_extract(t, r"(?s)(\{.*\})", 1)
    said = F.lower(F.trim(F.coalesce(F.get_json_object(json, "$.verdict"), F.lit("uncertain"))))
    object_ = F.when(said.isin("confirmed", "uncertain", "false_positive"), said).otherwise("uncertain")
    words = F.when(F.lower(t).contains("confirmed"), "confirmed").when(F.lower(t).contains("false"), "false_positive").otherwise("uncertain")
    return F.when(t.isNotNull(), F.when(F.get_json_object(json, "$").isNotNull(), object_).otherwise(words))


def classifier_hit(items: str | Column, threshold: float = 0.5) -> Column:
    """The highest-scored label of a classifier's answer that is not benign and reaches ``threshold``, or null."""
    x = F.from_json(F.col(items) if isinstance(items, str) else items, "array<struct<label:string,score:double>>")
    bad = F.filter(x, lambda v: ~F.lower(v["label"]).isin("safe", "benign", "ok", "label_0", "legit") & (v["score"] >= threshold))
    best = F.array_max(F.transform(bad, lambda v: F.struct(v["score"].alias("score"), v["label"].alias("label"))))
    return best["label"]
