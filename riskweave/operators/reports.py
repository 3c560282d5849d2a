"""Sinks of a scan: JSON and SARIF built as nested columns, console, HTML and facts texts from small marts."""

from __future__ import annotations

import html

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from riskweave.functions.text import fingerprint, location
from riskweave.operators import dims, marts

TITLE = "AI application risk report"


def json_reports(findings: DataFrame, by: str = "scan_id", version: str = "0.1.0") -> DataFrame:
    """(by, json): one document a scan with score, grade, counts and findings, written in parallel with ``df.write.text``.

    A document holds the findings of one scan; that is its definition, and its only unbounded part.
    """
    p = marts.posture(findings, by)
    c = marts.severity_counts(findings, by).groupBy(by).agg(F.map_from_entries(F.sort_array(F.collect_list(F.struct("severity", "findings")))).alias("counts"))
    item = F.struct("finding_id", "detector", "rule_id", "severity", "owasp_llm", "file", "line", "evidence", "confidence", location("file", "line").alias("location"))
    f = findings.groupBy(by).agg(F.sort_array(F.collect_list(item)).alias("findings"))
    x = f.join(p.select(by, "score", "grade"), by, "left").join(c, by, "left")
    return x.select(by, F.to_json(F.struct(F.lit(version).alias("version"), F.coalesce("score", F.lit(100)).alias("score"), F.coalesce("grade", F.lit("A")).alias("grade"), "counts", "findings")).alias("json"))


def code_flow(trace: str) -> Column:
    """A trace as SARIF thread-flow locations; line 0 becomes 1."""
    return F.transform(trace, lambda s: F.struct(F.struct(F.struct(F.greatest(s["line"], F.lit(1)).alias("startLine"), F.struct(s["snippet"].alias("text")).alias("snippet")).alias("region")).alias("physicalLocation"), F.struct(F.concat_ws(": ", s["role"], s["snippet"]).alias("text")).alias("message")))


def sarif(findings: DataFrame, by: str = "scan_id", version: str = "0.1.0") -> DataFrame:
    """(by, json): one SARIF 2.1.0 document a scan; each rule once, by its first finding."""
    s = F.broadcast(dims.severities(findings.sparkSession).select("severity", "sev_value", "level", "security_severity"))
    f = findings.drop("sev_value").join(s, "severity")
    rules = f.groupBy(by, "rule_id").agg(F.min_by(F.struct("title", "remediation", "security_severity", "owasp_llm"), "finding_id").alias("r"))
    rules = rules.select(by, F.struct(F.col("rule_id").alias("id"), F.col("r.title").alias("name"), F.struct(F.col("r.title").alias("text")).alias("shortDescription"), F.struct(F.col("r.remediation").alias("text")).alias("fullDescription"), F.struct(F.col("r.owasp_llm").alias("owasp-llm"), F.col("r.security_severity").alias("security-severity")).alias("properties")).alias("rule"))
    rules = rules.groupBy(by).agg(F.sort_array(F.collect_list("rule")).alias("rules"))
    conf = F.when(F.col("confidence").isNull() | F.isnan("confidence"), 0.0).otherwise(F.col("confidence"))
    place = F.struct(F.struct(F.struct(F.col("file").alias("uri")).alias("artifactLocation"), F.struct(F.greatest(F.coalesce("line", F.lit(0)), F.lit(1)).alias("startLine"), F.struct(F.col("evidence").alias("text")).alias("snippet")).alias("region")).alias("physicalLocation"))
    flow = F.when(F.size("trace") > 0, F.array(F.struct(F.array(F.struct(code_flow("trace").alias("locations"))).alias("threadFlows")))) if "trace" in f.columns else F.lit(None)
    res = F.struct("finding_id", F.col("rule_id").alias("ruleId"), "level", F.struct(F.col("title").alias("text")).alias("message"), F.array(place).alias("locations"), F.struct(fingerprint("rule_id", "file", "evidence").alias("primaryLocationLineHash")).alias("partialFingerprints"), F.round(F.col("sev_value") * 10.0 * conf, 1).alias("rank"), flow.alias("codeFlows"))
    g = f.groupBy(by).agg(F.sort_array(F.collect_list(res)).alias("results")).join(rules, by)
    run = F.struct(F.struct(F.struct(F.lit("riskweave").alias("name"), F.lit(version).alias("version"), F.col("rules")).alias("driver")).alias("tool"), F.transform("results", lambda x: x.dropFields("finding_id")).alias("results"))
    return g.select(by, F.to_json(F.struct(F.lit("2.1.0").alias("version"), F.array(run).alias("runs"))).alias("json"))


def summary(findings: DataFrame) -> dict:
    """The small marts of one report, on the driver: counts, drivers (at most ten categories), controls (a few dozen)."""
    one = findings.withColumn("_all", F.lit(1))
    p = marts.posture(one, "_all").first()
    return {
        "score": p["score"] if p else 100,
        "grade": p["grade"] if p else "A",
        "counts": {r["severity"]: r["findings"] for r in marts.severity_counts(findings).collect()},
        "drivers": [r.asDict() for r in marts.risk_drivers(one, "_all").orderBy("driver").limit(10).collect()],
        "controls": [r.asDict() for r in marts.compliance(findings).orderBy("framework", "control").limit(100).collect()],
    }


def console(findings: DataFrame, profile: str = "engineer", most: int = 200) -> str:
    """A report as text for a profile: findings above its floor, business drivers, controls."""
    row = next(p for p in dims.PROFILES if p[0] == profile)
    s = summary(findings)
    out = [f"{TITLE}: score {s['score']} ({s['grade']})", "  ".join(f"{k} {s['counts'].get(k, 0)}" for k, *_ in dims.SEVERITIES)]
    if row[2]:
        top = findings.where(F.col("sev_value") >= row[1]).orderBy(F.desc("sev_value"), F.desc("confidence"), "file", "line").limit(most)
        for r in top.collect():
            out.append(f"[{r['severity']}] {r['rule_id']} {r['file']}:{r['line']}")
            if row[3]:
                out.append(f"    {r['evidence']}")
    if row[5]:
        low, high = sum(d["ale_low"] for d in s["drivers"]), sum(d["ale_high"] for d in s["drivers"])
        out.append(f"Yearly loss exposure ${low:,} to ${high:,}")
        out += [f"  {d['owasp_llm']} {d['owasp_name']}: {d['findings']}: {d['consequence']}" for d in s["drivers"][:5]]
    if row[6]:
        out += [f"  {c['framework']} {c['control']} {c['description']}: {', '.join(c['rules'])}" for c in s["controls"]]
    return "\n".join(out)


def narrative(findings: DataFrame) -> str:
    """The deterministic executive summary, from the three main drivers."""
    s = summary(findings)
    top = "; ".join(f"{d['owasp_name']} ({d['findings']})" for d in s["drivers"][:3]) or "none"
    return f"Posture {s['score']} of 100 (grade {s['grade']}). Main drivers: {top}."


def html_report(findings: DataFrame, profile: str = "engineer") -> str:
    """A self-contained page."""
    body = html.escape(console(findings, profile))
    return f"<!doctype html><html><head><meta charset='utf-8'><title>{TITLE}</title><style>body{{font:14px sans-serif;margin:2em}}pre{{white-space:pre-wrap}}</style></head><body><h1>{TITLE}</h1><pre>{body}</pre></body></html>"
