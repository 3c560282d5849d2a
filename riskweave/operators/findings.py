"""Plumbing of the findings table: deliveries, ranking, duplicates, suppression, baseline, fixes."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from riskweave.functions.text import clamp01, detector_name, severity_name, split_lines
from riskweave.operators.dims import SEVERITIES
from riskweave.runtime import table


def sev_values() -> Column:
    """Severity name to value, as a map."""
    return F.create_map(*[x for s in SEVERITIES for x in (F.lit(s[0]), F.lit(s[1]))])


def delivered(spark: SparkSession, d: str, *columns: str) -> DataFrame:
    """One row a finding_id with ``columns``; severities and detectors in their canonical spelling.

    Repeated deliveries are equal rows; where they differ the smallest row stands. A map column can't be asked for.
    """
    f = table(spark, d, "findings", "finding_id", *[c for c in columns if c != "finding_id"])
    rest = [c for c in f.columns if c != "finding_id"]
    f = f.where("finding_id is not null").groupBy("finding_id").agg(F.min(F.struct(*rest)).alias("x")).select("finding_id", "x.*")
    if "severity" in rest:
        f = f.withColumn("severity", severity_name()).withColumn("sev_value", F.element_at(sev_values(), F.col("severity")))
    if "detector" in rest:
        f = f.withColumn("detector", detector_name())
    return f


def trusted(f: DataFrame) -> DataFrame:
    """Without advisory findings, which count in no tally, score or gate."""
    return f.where(F.coalesce("confidence_tier", F.lit("")) != "advisory")


def rank_order() -> list[Column]:
    """The total order of a scan: severity, confidence, file, line, then order of emission."""
    return [F.desc_nulls_last("sev_value"), F.desc("_conf"), F.asc_nulls_last("file"), F.asc_nulls_last("line"), F.asc_nulls_last("det_ord"), F.asc_nulls_last("emit_ord"), F.asc("finding_id")]


def ranked(f: DataFrame, by: str = "scan_id") -> DataFrame:
    """``f`` with ``rank`` within each scan."""
    return f.withColumn("_conf", clamp01("confidence")).withColumn("rank", F.row_number().over(Window.partitionBy(by).orderBy(*rank_order()))).drop("_conf")


def first_per(f: DataFrame, keys: list[str], order: list[Column], tie: str | None = "finding_id") -> DataFrame:
    """The first row of each key, by a pre-aggregated minimum: no window sort, and a heavy key costs one row a task.

    ``order`` must be orderable columns, smallest first; ties go to the smaller ``tie``.
    """
    rest = [c for c in f.columns if c not in keys]
    o = F.struct(*[c.alias(f"o{i}") for i, c in enumerate(order)], *([F.col(tie).alias("oid")] if tie else []))
    return f.groupBy(*keys).agg(F.min_by(F.struct(*rest), o).alias("x")).select(*keys, "x.*")


def without_baseline(f: DataFrame, baseline: DataFrame) -> DataFrame:
    """Findings whose fingerprint (letter case aside) nobody accepted; a null fingerprint is never accepted."""
    b = baseline.select(F.lower(F.trim("fingerprint")).alias("_fp")).where("_fp is not null").distinct()
    return f.join(b, F.lower(F.trim("fingerprint")) == F.col("_fp"), "left_anti")


def new_and_gone(before: DataFrame, after: DataFrame, keys: list[str]) -> DataFrame:
    """Rows of ``keys`` with state new or gone between two sets of findings."""
    a, b = before.select(*keys).distinct(), after.select(*keys).distinct()
    new = b.join(a, keys, "left_anti").withColumn("state", F.lit("new"))
    return new.unionByName(a.join(b, keys, "left_anti").withColumn("state", F.lit("gone")))


def not_near(candidates: DataFrame, known: DataFrame, within: int = 2) -> DataFrame:
    """Candidates with no known finding in the same repo and file within so many lines.

    The range becomes an equality on blocks of 2 x within + 1 lines (a line falls into its own block and its neighbours),
    so a file with very many findings doesn't turn into a nested loop over all its pairs.
    """
    w = 2 * within + 1
    k = known.select(F.col("repo").alias("_r"), F.col("file").alias("_f"), F.col("line").alias("_l"), F.explode(F.array(F.floor((F.col("line") - within) / w), F.floor((F.col("line") + within) / w))).alias("_b")).distinct()
    near = (candidates["repo"] == k["_r"]) & (candidates["file"] == k["_f"]) & (F.floor(candidates["line"] / w) == k["_b"]) & (F.abs(candidates["line"] - k["_l"]) <= within)
    return candidates.join(k, near, "left_anti")


def directive(marker: str) -> str:
    """The pattern of ``# marker: ignore``, ``# marker: ignore[LLM03, RULE-1]`` or ``// marker: ignore LLM03``."""
    return rf"(?i)(?:#|//)\s*{marker}:\s*ignore(?:\[([^\]]*)\]|\s+([A-Za-z0-9_,\- ]+))?"


def inline_suppressed(f: DataFrame, files: DataFrame, marker: str = "riskweave") -> DataFrame:
    """finding_ids silenced by a directive on their line, or on the line above when that is a comment and nothing else.

    A directive without a list silences everything; a list names categories or rules. Only lines that findings point at are
    joined, after the files' lines with a directive have been filtered out.
    """
    pattern = directive(marker)
    x = files.where(F.col("text").rlike(rf"(?i){marker}:\s*ignore")).select("repo", F.col("path").alias("file"), F.posexplode(split_lines("text")).alias("p", "raw"))
    x = x.where(F.col("raw").rlike(pattern)).withColumn("alone", F.col("raw").rlike(r"^\s*(?:#|//)"))
    x = x.withColumn("what", F.lower(F.concat(F.regexp_extract("raw", pattern, 1), F.regexp_extract("raw", pattern, 2))))
    x = x.select("repo", "file", "alone", "what", F.explode(F.array(F.struct((F.col("p") + 1).alias("line"), F.lit(False).alias("above")), F.struct((F.col("p") + 2).alias("line"), F.lit(True).alias("above")))).alias("t"))
    x = x.where("not t.above or alone").select("repo", "file", F.col("t.line").alias("line"), "what")
    j = f.join(x, ["repo", "file", "line"])
    names = F.transform(F.split("what", r"[,\s]+"), lambda v: F.trim(v))
    hit = (F.trim("what") == "") | F.array_contains(names, F.lower("owasp_llm")) | F.array_contains(names, F.lower("rule_id"))
    return j.where(hit).select("finding_id").distinct()
