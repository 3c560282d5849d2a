"""Queries over findings, baseline and files, with their SQL."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from riskweave.functions.text import fingerprint, is_test_path, location, snippet, split_lines
from riskweave.operators import dims, marts
from riskweave.operators import findings as fd
from riskweave.runtime import table

RANK = ("scan_id", "severity", "confidence", "file", "line", "det_ord", "emit_ord")


def findings_ranked(spark: SparkSession, d: str) -> DataFrame:
    """The total order of each scan's findings."""
    return fd.ranked(fd.delivered(spark, d, *RANK)).select("scan_id", "finding_id", "rank")


def posture_by_scan(spark: SparkSession, d: str) -> DataFrame:
    """Score and grade of each scan."""
    return marts.posture(fd.delivered(spark, d, *RANK, "owasp_llm", "confidence_tier")).select("scan_id", "findings", "penalty", "score", "grade")


def severity_counts(spark: SparkSession, d: str) -> DataFrame:
    """Trusted findings by repo and severity."""
    return marts.severity_counts(fd.delivered(spark, d, "repo", "severity", "confidence_tier"), "repo")


def risk_drivers(spark: SparkSession, d: str) -> DataFrame:
    """Loss bands and the five main drivers of each repo."""
    return marts.risk_drivers(fd.delivered(spark, d, "repo", "severity", "owasp_llm")).where("driver <= 5")


def compliance_exposure(spark: SparkSession, d: str) -> DataFrame:
    """Controls touched, with their rules."""
    g = marts.compliance(fd.delivered(spark, d, "owasp_llm", "rule_id"))
    return g.select("framework", "control", "description", "findings", F.concat_ws(",", "rules").alias("rules"))


def baseline_anti(spark: SparkSession, d: str) -> DataFrame:
    """Findings not accepted before, by repo, and how many were."""
    f = fd.delivered(spark, d, "repo", "fingerprint")
    kept = fd.without_baseline(f, table(spark, d, "baseline", "fingerprint")).groupBy("repo").agg(F.count(F.lit(1)).alias("kept"))
    return f.groupBy("repo").agg(F.count(F.lit(1)).alias("total")).join(kept, "repo", "left").fillna(0, ["kept"]).withColumn("baselined", F.col("total") - F.col("kept"))


def baseline_fingerprints(spark: SparkSession, d: str) -> DataFrame:
    """The sorted distinct fingerprints a baseline file holds."""
    return fd.delivered(spark, d, "fingerprint").select(F.lower(F.trim("fingerprint")).alias("fingerprint")).where("fingerprint is not null").distinct()


def fix_diff(spark: SparkSession, d: str) -> DataFrame:
    """Fingerprints new or gone in batch 11 against batch 10, by repo and file."""
    f = fd.delivered(spark, d, "repo", "file", "fingerprint", "batch_no").withColumn("fingerprint", F.lower("fingerprint")).where("fingerprint is not null")
    return fd.new_and_gone(f.where("batch_no = 10"), f.where("batch_no = 11"), ["repo", "file", "fingerprint"]).groupBy("repo", "state").agg(F.count(F.lit(1)).alias("fingerprints"))


def near_dup_range_anti(spark: SparkSession, d: str) -> DataFrame:
    """Advisory findings with no other finding within two lines."""
    f = fd.delivered(spark, d, "repo", "file", "line", "confidence_tier")
    adv = F.coalesce("confidence_tier", F.lit("")) == "advisory"
    return fd.not_near(f.where(adv), f.where(~adv)).select("finding_id")


def dedup_first_per_line(spark: SparkSession, d: str) -> DataFrame:
    """The first finding of each scan, file, line and rule."""
    f = fd.delivered(spark, d, "scan_id", "file", "line", "rule_id", "det_ord", "emit_ord")
    return fd.first_per(f, ["scan_id", "file", "line", "rule_id"], [F.col("det_ord"), F.col("emit_ord")]).select("scan_id", "file", "line", "rule_id", "finding_id")


def remediation_plan(spark: SparkSession, d: str) -> DataFrame:
    """Findings by remediation agent."""
    f = marts.assign_agents(fd.delivered(spark, d, "detector", "rule_id"))
    return f.groupBy("agent_id", "agent_name", "auto_available").agg(F.count(F.lit(1)).alias("findings"), F.countDistinct("rule_id").alias("rules"))


def gate_exit(spark: SparkSession, d: str) -> DataFrame:
    """Worst severity and exit code of each scan at the HIGH gate."""
    return marts.gate(fd.delivered(spark, d, "scan_id", "severity", "confidence_tier"), "scan_id")


def profile_counts(spark: SparkSession, d: str) -> DataFrame:
    """Findings shown and hidden by each profile."""
    return marts.shown_by_profile(fd.delivered(spark, d, "severity", "confidence_tier"))


def detector_counts(spark: SparkSession, d: str) -> DataFrame:
    """Findings by detector."""
    return fd.delivered(spark, d, "detector").groupBy("detector").agg(F.count(F.lit(1)).alias("findings"))


def finding_rates(spark: SparkSession, d: str) -> DataFrame:
    """Per category the share of repos with a HIGH or worse finding, and findings per repo."""
    f = fd.delivered(spark, d, "repo", "severity", "owasp_llm")
    r = f.groupBy("owasp_llm", "repo").agg(F.count(F.lit(1)).alias("n"), F.max(F.coalesce((F.col("sev_value") >= 4).cast("int"), F.lit(0))).alias("high"))
    return r.groupBy("owasp_llm").agg(F.sum("n").alias("findings"), F.count(F.lit(1)).alias("repos"), F.round(F.avg("high"), 6).alias("share_high"), F.round(F.avg("n"), 6).alias("per_repo"))


def kloc_rates(spark: SparkSession, d: str) -> DataFrame:
    """Findings per thousand lines over the last good run of each repo."""
    p = table(spark, d, "per_repo", "repo", "status", "loc", "findings", "batch_no").where("status = 'ok' and loc > 0")
    key = F.regexp_replace(F.regexp_replace(F.lower(F.trim("repo")), r"/+$", ""), r"\.git$", "")
    g = p.select(key.alias("repo"), "batch_no", "loc", "findings").groupBy("repo").agg(F.max(F.struct("batch_no", "loc", "findings")).alias("x"))
    return g.select("repo", F.round(1000 * F.col("x.findings") / F.col("x.loc"), 6).alias("per_kloc"))


def evidence_context(spark: SparkSession, d: str) -> DataFrame:
    """Six lines of code around each finding, its own marked; the first twelve for a finding on the whole file.
    The evidence stands where no such lines exist: the file is gone, empty or shorter.

    Lines are split once a file and cut once a (file, line), before they meet the findings.
    """
    f = fd.delivered(spark, d, "repo", "file", "line", "evidence")
    files = table(spark, d, "files", "repo", "path", "text").where("text is not null and text <> ''")
    files = files.select("repo", F.col("path").alias("file"), split_lines("text").alias("ls"))
    at = f.select("repo", "file", "line").where("line is not null").distinct().join(files, ["repo", "file"]).where(F.col("line") <= F.size("ls"))
    from_ = F.greatest(F.lit(1), F.col("line") - 6)
    around = F.when(F.col("line") <= 0, F.slice("ls", 1, 12)).otherwise(F.slice("ls", from_, F.greatest(F.lit(1), F.col("line") + 6 - from_ + 1)))
    first = F.when(F.col("line") <= 0, F.lit(1)).otherwise(from_)
    marked = F.transform(around, lambda x, i: F.concat(F.when(i + first == F.col("line"), ">> ").otherwise("   "), (i + first).cast("string"), F.lit(": "), x))
    c = at.select("repo", "file", "line", F.concat_ws("\n", marked).alias("context"))
    return f.join(c, ["repo", "file", "line"], "left").select("finding_id", F.coalesce("context", "evidence", F.lit("")).alias("context"))


def sarif_results(spark: SparkSession, d: str) -> DataFrame:
    """The columns of a SARIF result."""
    s = F.broadcast(dims.severities(spark).select("severity", "level", "security_severity", F.col("sev_value").alias("_v")))
    f = fd.delivered(spark, d, "rule_id", "file", "line", "evidence", "severity", "confidence").join(s, "severity")
    rank = F.round(F.col("_v") * 10.0 * F.when(F.col("confidence").isNull() | F.isnan("confidence"), 0.0).otherwise(F.col("confidence")), 1)
    return f.select("finding_id", "level", "security_severity", rank.alias("rank"), location("file", "line").alias("location"), fingerprint("rule_id", "file", "evidence").alias("partial_fingerprint"))


def sarif_rules(spark: SparkSession, d: str) -> DataFrame:
    """Each rule once, with the title of its first finding."""
    f = fd.delivered(spark, d, "rule_id", "title", "remediation")
    return f.groupBy("rule_id").agg(F.min_by(F.struct("title", "remediation"), "finding_id").alias("x")).select("rule_id", "x.title", "x.remediation")


def sampled_findings(spark: SparkSession, d: str) -> DataFrame:
    """A seeded sample of 50 findings, by hash order."""
    f = table(spark, d, "findings", "finding_id").distinct()
    return f.withColumn("h", F.sha1(F.concat(F.col("finding_id").cast("string"), F.lit("|0")))).orderBy("h", "finding_id").limit(50).select("finding_id")


def triage_queue(spark: SparkSession, d: str) -> DataFrame:
    """The forty findings to corroborate first."""
    f = fd.delivered(spark, d, "severity", "confidence", "file", "line", "det_ord", "emit_ord").withColumn("_conf", F.greatest(F.lit(0.0), F.least(F.lit(1.0), F.when(F.isnan("confidence"), 0.0).otherwise(F.coalesce("confidence", F.lit(0.0))))))
    return f.orderBy(*fd.rank_order()).limit(40).select("finding_id")


def smallest_files(spark: SparkSession, d: str) -> DataFrame:
    """The eight smallest code files of each repo, up to 24 kB."""
    f = table(spark, d, "files", "file_id", "repo", "path", "suffix", "bytes").where((F.col("bytes") > 0) & (F.col("bytes") <= 24_000) & F.lower("suffix").isin(".py", ".js", ".ts", ".go", ".java"))
    w = Window.partitionBy("repo").orderBy("bytes", "path")
    return f.withColumn("n", F.row_number().over(w)).where("n <= 8").select("repo", "file_id", F.col("n").cast("int").alias("n"))


def loc_by_repo(spark: SparkSession, d: str) -> DataFrame:
    """Lines of code by repo."""
    f = table(spark, d, "files", "repo", "suffix", "text").where(F.lower("suffix").isin(".py", ".js", ".ts", ".go", ".java") & F.col("text").isNotNull())
    return f.select("repo", F.size(split_lines("text")).alias("n")).groupBy("repo").agg(F.sum("n").alias("loc"), F.count(F.lit(1)).alias("files"))


def test_path_findings(spark: SparkSession, d: str) -> DataFrame:
    """Findings of rules by whether they lie in test code."""
    f = fd.delivered(spark, d, "rule_id", "file", "evidence")
    return f.groupBy("rule_id", is_test_path("file").alias("in_tests")).agg(F.count(F.lit(1)).alias("findings"), F.max(F.length(snippet("evidence", 160))).alias("longest"))


def scan_errors(spark: SparkSession, d: str) -> DataFrame:
    """Errors of scans by the detector that reported them."""
    s = table(spark, d, "scan_results", "scan_id", "errors").where("errors is not null").select("scan_id", F.explode(F.array_distinct("errors")).alias("e")).distinct()
    return s.groupBy(F.regexp_extract("e", r"^([A-Za-z-]+):", 1).alias("detector")).agg(F.count(F.lit(1)).alias("errors"))


def trace_steps(spark: SparkSession, d: str) -> DataFrame:
    """Code-flow steps of findings with a trace, first and last four kept."""
    f = table(spark, d, "findings", "finding_id", "trace").where(F.size("trace") > 0).groupBy("finding_id").agg(F.first("trace").alias("t"))
    n = F.size("t")
    kept = F.when(n > 5, F.concat(F.slice("t", 1, 1), F.slice("t", -4, 4))).otherwise(F.col("t"))
    return f.select("finding_id", F.posexplode(kept).alias("step", "s")).select("finding_id", F.col("step").alias("step"), "s.line", "s.role", "s.snippet")


_SEV = dims.sql_values([(s[0], s[1], s[2], s[3], s[4], s[5], s[6]) for s in dims.SEVERITIES], "severity", "sev_value", "weight", "ale_low", "ale_high", "level", "security_severity")
_F = f"""with sev as (select * from {_SEV}),
 f as (select distinct on (finding_id) * exclude (sev_value) replace (upper(trim(severity)) as severity, lower(replace(trim(detector), '_', '-')) as detector) from findings where finding_id is not null),
 g as (select f.*, s.sev_value, case when confidence is null or isnan(confidence) then 0.0 else least(1.0, greatest(0.0, confidence)) end as conf from f left join sev s on s.severity = f.severity)"""
_ORDER = "sev_value desc nulls last, conf desc, file asc nulls last, line asc nulls last, det_ord asc nulls last, emit_ord asc nulls last, finding_id"
_TRUST = "coalesce(confidence_tier, '') <> 'advisory'"
_CODE = "('.py', '.js', '.ts', '.go', '.java')"
_OC = dims.sql_values([(k, *x.split(" ", 1)) for k, v in dims.OWASP_CONTROLS.items() for x in v], "owasp_llm", "framework", "control")
_CT = dims.sql_values([(a, c, t) for a, x in dims.CONTROLS.items() for c, t in x.items()], "framework", "control", "description")
_OW = dims.sql_values([(k, v, dims.CONSEQUENCE[k]) for k, v in dims.OWASP.items()], "owasp_llm", "owasp_name", "consequence")
_AG = dims.sql_values(dims.AGENTS, "detector", "agent_id", "agent_name", "auto_available")
_LINES = r"string_split_regex(regexp_replace(text, '(\r\n|[\n\r\x0B\f\x1C\x1D\x1E\x{85}\x{2028}\x{2029}])$', ''), '\r\n|[\n\r\x0B\f\x1C\x1D\x1E\x{85}\x{2028}\x{2029}]')"
_TESTS = r"'(?i)((^|/)(tests?|__tests__|fixtures?|mocks?|examples?|samples?|demos?)(/)|conftest|_test\.|\.test\.|(^|/)test_|\.spec\.)'"
_TRIM = r"regexp_replace(%s, '^\s+|\s+$', '', 'g')"

QUERIES = {k: v for k, v in list(globals().items()) if callable(v) and getattr(v, "__module__", "") == __name__ and not k.startswith("_")}
ORACLE = {
    "findings_ranked": f"{_F} select scan_id, finding_id, row_number() over (partition by scan_id order by {_ORDER})::int as rank from g",
    "posture_by_scan": f"""{_F}, x as (select g.*, s.weight, row_number() over (partition by scan_id, owasp_llm, g.severity order by {_ORDER.replace('sev_value', 'g.sev_value')}) - 1 as n
  from g join sev s on s.severity = g.severity where {_TRUST}),
 p as (select scan_id, count(*) as findings, sum(weight * pow(0.6, n) * conf) as penalty from x group by scan_id),
 q as (select *, least(100, greatest(0, round_even(100 * exp(-penalty / 100), 0)))::int as score from p)
 select scan_id, findings, round(penalty, 4) as penalty, score, case when score >= 90 then 'A' when score >= 75 then 'B' when score >= 60 then 'C' when score >= 40 then 'D' else 'F' end as grade from q""",
    "severity_counts": f"{_F} select repo, severity, count(*) as findings from g where {_TRUST} and severity is not null group by 1, 2",
    "risk_drivers": f"""{_F}, h as (select repo, g.owasp_llm, count(*) as findings, max(s.sev_value) as worst, sum(s.ale_low)::bigint as ale_low, sum(s.ale_high)::bigint as ale_high from g join sev s on s.severity = g.severity group by 1, 2),
 k as (select h.*, coalesce(o.owasp_name, 'Unknown') as owasp_name, coalesce(o.consequence, '') as consequence, row_number() over (partition by repo order by worst desc, findings desc, h.owasp_llm)::int as driver
  from h left join (select * from {_OW}) o on o.owasp_llm = h.owasp_llm) select * from k where driver <= 5""",
    "compliance_exposure": f"""{_F} select c.framework, c.control, coalesce(t.description, '') as description, count(*) as findings, array_to_string(list_sort(list(distinct g.rule_id)), ',') as rules
 from g join (select * from {_OC}) c on c.owasp_llm = g.owasp_llm left join (select * from {_CT}) t on t.framework = c.framework and t.control = c.control group by 1, 2, 3""",
    "baseline_anti": f"""{_F}, b as (select distinct lower(trim(fingerprint)) as fp from baseline where fingerprint is not null)
 select repo, count(*) as total, count(*) filter (where b.fp is null) as kept, count(*) filter (where b.fp is not null) as baselined from g left join b on b.fp = lower(trim(fingerprint)) group by repo""",
    "baseline_fingerprints": "select distinct lower(trim(fingerprint)) as fingerprint from findings where fingerprint is not null",
    "fix_diff": f"""{_F}, a as (select distinct repo, file, lower(fingerprint) as fp from g where batch_no = 10 and fingerprint is not null), b as (select distinct repo, file, lower(fingerprint) as fp from g where batch_no = 11 and fingerprint is not null),
 d as (select repo, 'new' as state from b anti join a using (repo, file, fp) union all select repo, 'gone' from a anti join b using (repo, file, fp)) select repo, state, count(*) as fingerprints from d group by 1, 2""",
    "near_dup_range_anti": f"""{_F} select a.finding_id from g a where coalesce(a.confidence_tier, '') = 'advisory' and not exists
 (select 1 from g b where coalesce(b.confidence_tier, '') <> 'advisory' and b.repo = a.repo and b.file = a.file and abs(b.line - a.line) <= 2)""",
    "dedup_first_per_line": f"{_F}, r as (select *, row_number() over (partition by scan_id, file, line, rule_id order by det_ord, emit_ord, finding_id) as n from g) select scan_id, file, line, rule_id, finding_id from r where n = 1",
    "remediation_plan": f"""{_F} select coalesce(agent_id, 'review') as agent_id, coalesce(agent_name, 'Manual Review Agent') as agent_name, coalesce(auto_available, false) as auto_available, count(*) as findings, count(distinct rule_id) as rules
 from g left join (select * from {_AG}) a on a.detector = g.detector group by 1, 2, 3""",
    "gate_exit": f"{_F} select scan_id, max(sev_value) as worst, case when max(sev_value) >= 4 then 1 else 0 end as exit_code from g where {_TRUST} group by scan_id",
    "profile_counts": f"""{_F} select p.profile, count(*) filter (where coalesce(confidence_tier, '') <> 'advisory' and sev_value >= floor) as shown,
 count(*) filter (where coalesce(confidence_tier, '') <> 'advisory' and not coalesce(sev_value >= floor, false)) as hidden, count(*) filter (where coalesce(confidence_tier, '') = 'advisory') as advisory
 from g, (select * from {dims.sql_values([x[:2] for x in dims.PROFILES], 'profile', 'floor')}) p group by p.profile""",
    "detector_counts": f"{_F} select detector, count(*) as findings from g group by detector",
    "finding_rates": f"""{_F}, r as (select owasp_llm, repo, count(*) as n, max(case when sev_value >= 4 then 1 else 0 end) as high from g group by 1, 2)
 select owasp_llm, sum(n)::bigint as findings, count(*) as repos, round(avg(high), 6) as share_high, round(avg(n), 6) as per_repo from r group by owasp_llm""",
    "kloc_rates": r"""with p as (select regexp_replace(regexp_replace(lower(trim(repo)), '/+$', ''), '\.git$', '') as repo, loc, findings, batch_no from per_repo where status = 'ok' and loc > 0),
 r as (select *, row_number() over (partition by repo order by batch_no desc, loc desc, findings desc) as n from p) select repo, round(1000 * findings / loc, 6) as per_kloc from r where n = 1""",
    "evidence_context": f"""{_F}, j as (select finding_id, line, {_LINES} as ls from g join files on files.repo = g.repo and files.path = g.file where text is not null and text <> ''),
 k as (select finding_id, line, unnest(range(1, len(ls) + 1)) as no, unnest(ls) as x from j where line <= len(ls)),
 c as (select finding_id, string_agg(case when no = line then '>> ' else '   ' end || no || ': ' || x, chr(10) order by no) as context from k
  where case when line <= 0 then no <= 12 else no between line - 6 and line + 6 end group by 1)
 select finding_id, coalesce(c.context, g.evidence, '') as context from g left join c using (finding_id)""",
    "sarif_results": f"""{_F} select finding_id, s.level, s.security_severity, round(s.sev_value * 10.0::double * case when confidence is null or isnan(confidence) then 0.0 else confidence end, 1) as rank,
 case when coalesce(line, 0) = 0 then file else file || ':' || line end as location,
 substr(sha1(coalesce(rule_id, '') || '|' || coalesce(file, '') || '|' || coalesce({_TRIM % 'evidence'}, '')), 1, 16) as partial_fingerprint from g join sev s on s.severity = g.severity""",
    "sarif_rules": f"{_F}, r as (select *, row_number() over (partition by rule_id order by finding_id) as n from g) select rule_id, title, remediation from r where n = 1",
    "sampled_findings": "select finding_id from (select distinct finding_id from findings) order by sha1(finding_id::varchar || '|0'), finding_id limit 50",
    "triage_queue": f"{_F} select finding_id from g order by {_ORDER} limit 40",
    "smallest_files": f"""with f as (select repo, file_id, row_number() over (partition by repo order by bytes, path)::int as n from files where bytes > 0 and bytes <= 24000 and lower(suffix) in {_CODE}) select repo, file_id, n from f where n <= 8""",
    "loc_by_repo": f"select repo, sum(case when text = '' then 0 else len({_LINES}) end)::bigint as loc, count(*) as files from files where text is not null and lower(suffix) in {_CODE} group by repo",
    "test_path_findings": f"{_F} select rule_id, coalesce(regexp_matches(file, {_TESTS}), false) as in_tests, count(*) as findings, max(length(substr({_TRIM % 'evidence'}, 1, 160)))::int as longest from g group by 1, 2",
    "scan_errors": "with e as (select distinct scan_id, unnest(errors) as e from scan_results where errors is not null) select regexp_extract(e, '^([A-Za-z-]+):', 1) as detector, count(*) as errors from e group by 1",
    "trace_steps": """with t as (select distinct on (finding_id) finding_id, trace from findings where len(trace) > 0),
 k as (select finding_id, case when len(trace) > 5 then trace[1:1] || trace[-4:] else trace end as t from t),
 s as (select finding_id, unnest(range(len(t))) as step, unnest(t) as s from k) select finding_id, step::int as step, s.line as line, s.role as role, s.snippet as snippet from s""",
}
