"""One scan: the findings of all rules over the files of one or many repositories, suppressed, deduplicated and scored."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from riskweave.functions.text import fingerprint, location, split_lines, squeeze
from riskweave.operators.facts import syntax_facts
from riskweave.operators.findings import first_per, inline_suppressed, sev_values
from riskweave.operators.rules import line_findings
from riskweave.operators.taint import syntax_findings
from riskweave.runtime import broadcast_if_small, cut
from riskweave.sources.manifests import advisories_for, dependency_findings

# Detector, title, category and confidence of the rules that are no line rules, in order of detectors.
ABOUT = {
    "ORTHO-PI-001": ("prompt-hardening", "Untrusted input joined to a system prompt without trust boundary", "LLM01", 0.8),
    "ORTHO-OUTPUT-001": ("output-handling", "Model output reaches", "LLM05", 0.8),
    "ORTHO-AGENCY-001": ("tool-exposure", "Tool can reach", "LLM06", 0.85),
    "ORTHO-PROMPTLEAK-001": ("prompt-leakage", "System prompt written to a log", "LLM07", 0.7),
    "ORTHO-MISINFO-001": ("misinformation", "Model answer returned without grounding in a high-stakes file", "LLM09", 0.4),
    "ORTHO-CONSUME-001": ("unbounded-consumption", "Model call without limit on generated length", "LLM10", 0.55),
    "ORTHO-CONSUME-002": ("unbounded-consumption", "Endless loop that calls a model", "LLM10", 0.6),
    "ORTHO-DEP-001": ("dependency-audit", "AI package without a pinned version", "LLM03", 0.7),
    "ORTHO-DEP-002": ("dependency-audit", "Package from an untrusted source", "LLM03", 0.8),
    "ORTHO-DEP-003": ("dependency-audit", "Known advisory", "LLM03", 0.9),
}
STEP = "array<struct<line:int,role:string,snippet:string>>"


def _about(rule: Column, field: int) -> Column:
    return F.element_at(F.create_map(*[F.lit(x) for k, v in ABOUT.items() for x in (k, v[field])]), rule)


def _described(x: DataFrame, files: DataFrame) -> DataFrame:
    """(file_id, rule_id, line, severity, detail, trace) with what a finding needs; evidence is the line's own text."""
    want = x.select("file_id").distinct()
    src = files.select("file_id", "repo", F.col("path").alias("file"), "text").join(broadcast_if_small(want), "file_id", "left_semi")
    src = src.select("file_id", "repo", "file", split_lines("text").alias("ls"))
    x = x.join(src, "file_id")
    x = x.withColumn("evidence", F.coalesce(F.substring(squeeze(F.get("ls", F.col("line") - 1)), 1, 200), F.lit(""))).drop("ls")
    rule = F.col("rule_id")
    title = F.when(F.col("detail") != "", F.concat_ws(" ", _about(rule, 1), "detail")).otherwise(_about(rule, 1))
    ord_ = F.element_at(F.create_map(*[F.lit(v) for i, k in enumerate(ABOUT) for v in (k, 1000 + i)]), rule)
    return x.select("file_id", "repo", "file", "line", _about(rule, 0).alias("detector"), "rule_id", title.alias("title"), "severity", _about(rule, 2).alias("owasp_llm"), "evidence", _about(rule, 3).alias("confidence"), "trace", ord_.alias("det_ord"))


def scan(files: DataFrame, advisories: DataFrame | None = None, marker: str = "riskweave") -> DataFrame:
    """The findings of a scan of ``files`` (file_id, repo, path, suffix, text), one row a (rule, file, line), and for tools
    a capability; where a line rule and a syntax rule meet, the line rule's row stands.

    Line rules, syntax rules within and across files, dependency rules, and with ``advisories`` those as well; findings
    silenced by a directive are left out. Null and empty texts give none. Columns are those of the findings table;
    ``finding_id`` is a hash of the finding's place and rule.
    """
    code = line_findings(files).select("file_id", "repo", "file", "line", "detector", "rule_id", "title", "severity", "owasp_llm", "evidence", "confidence", F.array().cast(STEP).alias("trace"), "det_ord")
    none = F.array().cast(STEP).alias("trace")
    other = syntax_findings(files, cut(syntax_facts(files))).unionByName(dependency_findings(files).select("file_id", "rule_id", "line", "severity", F.col("package").alias("detail"), none))
    if advisories is not None:
        a = advisories_for(files, advisories)
        other = other.unionByName(a.select("file_id", F.lit("ORTHO-DEP-003").alias("rule_id"), "line", F.lit("HIGH").alias("severity"), F.concat_ws(" ", "package", "version", "title").alias("detail"), none))
    x = code.unionByName(_described(cut(other), files))
    x = x.withColumn("sev_value", F.element_at(sev_values(), F.col("severity"))).withColumn("confidence_tier", F.lit("deterministic")).withColumn("emit_ord", F.col("line"))
    x = x.withColumn("location", location("file", "line")).withColumn("fingerprint", fingerprint("rule_id", "file", "evidence"))
    x = cut(first_per(x.withColumn("finding_id", F.xxhash64("file_id", "rule_id", "line", F.when(F.col("rule_id") == "ORTHO-AGENCY-001", F.regexp_extract("title", r"shell|SQL|code|write|delete|HTTP", 0)))), ["finding_id"], [F.col("det_ord")], tie=None))
    return x.join(inline_suppressed(x, files, marker), "finding_id", "left_anti")
