"""Findings of the syntax rules: what is found within files, and what crosses them."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from riskweave.runtime import cut


def tagged(facts: DataFrame, tag: str) -> DataFrame:
    return facts.where(F.col("tag") == tag)


def tool_functions(facts: DataFrame) -> DataFrame:
    """(file_id, fn, asks): functions exposed to a model by decorator, tool literal or tool constructor."""
    f = tagged(facts, "func").select("file_id", F.col("s1").alias("fn"), F.col("b2").alias("asks"), F.col("b1").alias("deco"))
    named = tagged(facts, "tool").select("file_id", F.col("s1").alias("fn")).distinct()
    return f.where("deco").unionByName(f.join(named, ["file_id", "fn"], "left_semi")).groupBy("file_id", "fn").agg(F.max("asks").alias("asks"))


def file_findings(facts: DataFrame) -> DataFrame:
    """(file_id, rule_id, line, severity, detail, trace): the findings within files, with their way from source to sink."""
    step = F.transform("refs", lambda x: F.struct(F.split(x, r"\|", 3)[0].cast("int").alias("line"), F.split(x, r"\|", 3)[1].alias("role"), F.split(x, r"\|", 3)[2].alias("snippet")))
    return tagged(facts, "finding").select("file_id", F.col("s1").alias("rule_id"), "line", F.col("s3").alias("severity"), F.col("s2").alias("detail"), step.alias("trace"))


def syntax_findings(files: DataFrame, facts: DataFrame) -> DataFrame:
    """(file_id, rule_id, line, severity, detail, trace) of all syntax rules, across files of a repo as well: in Python by
    imports, in other languages by names that one file alone defines.

    A line that a rule already found within its file isn't found again across files. ``files`` has file_id, repo, path and
    suffix.
    """
    from riskweave.operators import crossmodule as cm

    own = file_findings(facts)
    mods = cm.modules(files)
    calls = cut(cm.resolved_calls(facts, mods).unionByName(cm.named_calls(facts, files)))
    none = F.array().cast("array<struct<line:int,role:string,snippet:string>>")
    row = lambda df, rule, sev, detail: df.select("file_id", F.lit(rule).alias("rule_id"), "line", sev.alias("severity"), detail.alias("detail"), none.alias("trace"))
    high = F.lit("HIGH")
    far = row(cm.cross_module_sinks(facts, mods, calls), "ORTHO-OUTPUT-001", high, F.col("kind"))
    far = far.unionByName(row(cm.cross_module_prompts(facts, mods, calls), "ORTHO-PI-001", high, F.lit("")))
    t = cm.cross_module_tools(facts, mods, calls)
    far = far.unionByName(row(t, "ORTHO-AGENCY-001", F.when(F.col("asks"), "MEDIUM").otherwise("CRITICAL"), F.col("capability"))).distinct()
    return own.unionByName(far.join(own.select("file_id", "rule_id", "line").distinct(), ["file_id", "rule_id", "line"], "left_anti"))
