"""Line rules over source files: every rule in one pass, without a shuffle.

A file's lines are an array. For each rule the positions whose line matches are filtered, the frame of lines around them is
a slice of the same array, and only hits are exploded. So all rules run in one scan of ``files``, whatever their windows,
and files that lack a rule's marker are skipped by one match on their whole text.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from riskweave.functions.text import NEGATION, TEST_PATH, fingerprint, is_test_path, location, split_lines, squeeze, strip_comment
from riskweave.operators.dims import SEVERITIES


@dataclass(frozen=True)
class Rule:
    """A line rule.

    ``pattern`` must match the line (with its comment cut off when ``code``), ``unless_line`` must not. Over the frame of
    ``before`` lines before to ``after`` lines after, ``frame`` must match and ``unless_frame`` must not. ``file`` must
    match somewhere in the file. ``calm`` is a mitigation that counts only on a line without a negation; ``calm_file`` asks
    for it in the whole file as well. Where it holds, the rule is dropped, or gets ``calm_severity`` and confidence.
    """

    key: str
    detector: str
    rule_id: str
    title: str
    severity: str
    owasp: str
    suffixes: tuple[str, ...]
    pattern: str
    confidence: float
    code: bool = True
    before: int = 0
    after: int = 0
    frame: str = ""
    unless_line: str = ""
    unless_frame: str = ""
    file: str = ""
    calm: str = ""
    calm_file: bool = False
    calm_severity: str = ""
    calm_confidence: float = 0.0
    tests_info: bool = False
    size: int = 200
    roles: bool = False


PY, JS = (".py", ".ipynb"), (".js", ".jsx", ".ts", ".tsx")
# The patterns, windows, severities and confidences of the rules.
_SAFE_LOAD = r"(?i)(safetensors|weights_only\s*=\s*True|SafeLoader|revision\s*=)"
_CAP = r"(?i)(max_?tokens|max_?output_?tokens|max_?completion_?tokens|maxoutputtokencount)"
_CONFIRM = r"(?i)(confirm|approval|human_in_the_loop|require_approval|allowlist|whitelist)"
_TOOL = r"""(?i)(@tool\b|@function_tool|@Tool\b|\[KernelFunction\]|KernelFunction\b|StructuredTool|['"]function['"]\s*:|['"]tools['"]\s*:|register_tool|mcp\.tool|FunctionDeclaration|FunctionDefinition|#\[tool\]|new\s+\w*Tool)"""
_IMPORT = r"^\s*((use|import|from|#include|require|require_relative)\b|using\s+[\w.]+\s*;)"
_SYSTEM = r"""(?i)((system_prompt|system_message|system_instruction)\s*[:=]|['"]role['"]\s*:\s*['"]system['"])"""
_CONCAT = r"""(?i)((f['"].*\{[^}]*(user|input|query|question|message|content|request)[^}]*\}.*['"])|(['"].*['"]\s*\+\s*\w*(user|input|query|question|message|request)\w*)|(\.format\([^)]*(user|input|query|message))|(%\s*\([^)]*(user|input|query)[^)]*\)))"""
_HARDENED = r"(?i)(untrusted|do not follow|ignore any instructions|delimited by|<user_input>|treat .* as data|never reveal|do not disclose your (system )?prompt)"
_LOGGED = r"(?i)((^|[^\w.])(logger|logging|log|print|console|warnings?|traceback|sys\.std(out|err)|pprint)\s*\.?\s*\w*\s*\(|^\s*raise )"
_OUTPUT = r"(?i)(completion|response|answer|generated|\boutput\b|choices)"
_SANITIZED = r"(?i)(sanitiz|escape|bleach|validate|allowlist|whitelist|JSON\.parse)"
_UNTRUSTED_TEXT = r"(?i)\b(requests\.get|httpx|urllib|fetch\(|WebBaseLoader|scrape|crawl|upload|request\.files|user_input|external_url|rss|email)"
_VECTORS = r"(?i)(vector|embedding|\bembed\b|chroma|faiss|pinecone|weaviate|qdrant|milvus|retriever|vectorstore|langchain|llama_?index|semantic|rag\b)"
_PROVEN = r"(?i)(sanitiz|clean|allowlist|whitelist|verify|signature|provenance|trusted_source|validate)"
_FINETUNE = r"(?i)(fine_tuning\.jobs\.create|fine_tunes\.create|FineTuningJob|create_fine_tune|\.finetune\s*\(|SFTTrainer|\.push_to_hub\s*\()"
_PROMPT_FILES = (".prompt", ".yaml", ".yml", ".json", *JS)
_SHELL, _FILE, _HTTP = "shell/command execution", "arbitrary file write/delete", "arbitrary outbound HTTP"
TOOL_SINKS: dict[tuple[str, ...], dict[str, str]] = {
    JS: {_SHELL: r"(?i)\b(child_process|exec\(|execSync|spawn\()", _FILE: r"(?i)\b(fs\.writeFile|fs\.unlink|fs\.rm)\b", _HTTP: r"(?i)\b(fetch\(|axios\b)"},
    (".go",): {_SHELL: r"\bexec\.Command(Context)?\(", _FILE: r"\b(os\.Remove(All)?\(|os\.WriteFile\(|ioutil\.WriteFile\()", _HTTP: r"\bhttp\.(Get|Post|NewRequest)\("},
    (".java", ".kt"): {_SHELL: r"(Runtime\.getRuntime\(\)\s*\.\s*exec\b|new\s+ProcessBuilder\b|ProcessBuilder\()", _FILE: r"\b(Files\.(write|delete|deleteIfExists)\(|new\s+FileWriter\(|\.writeText\()", _HTTP: r"(HttpClient\b|\.openConnection\(|RestTemplate\b|new\s+URL\()"},
    (".cs",): {_SHELL: r"(Process\.Start\(|new\s+Process\()", _FILE: r"\bFile\.(WriteAllText|WriteAllBytes|Delete)\(", _HTTP: r"(HttpClient\b|new\s+WebClient\b|WebRequest\.Create\()"},
    (".rb",): {_SHELL: r"(\bsystem\(|\bexec\(|\bIO\.popen\(|%x\(|`[^`]*`)", _FILE: r"\b(File\.(delete|write|unlink)\(|FileUtils\.rm\b)", _HTTP: r"\bNet::HTTP\b"},
    (".php",): {_SHELL: r"\b(exec|shell_exec|system|passthru|proc_open)\s*\(", _FILE: r"\b(unlink|file_put_contents|fwrite)\s*\(", _HTTP: r"\b(curl_exec|fsockopen)\s*\("},
    (".rs",): {_SHELL: r"\bCommand::new\(", _FILE: r"\b(fs::write\(|fs::remove_file\(|fs::remove_dir_all\()", _HTTP: r"\breqwest::(get|post|Client|blocking|ClientBuilder)\b"},
}
COMPLETIONS: dict[tuple[str, ...], str] = {
    (".java", ".kt"): r"\.(completions|messages)\(\)\s*\.\s*create\s*\(",
    (".cs",): r"(\.CompleteChat(Async)?\s*\(|\.Messages\.Create\s*\()",
    (".rb",): r"(\.chat\(\s*parameters|\.messages\.create\s*\()",
    (".php",): r"->\s*(chat|messages)\(\)\s*->\s*create\s*\(",
    (".rs",): r"\.(chat|messages)\(\)\s*\.\s*create\s*\(",
}
_LOADS = {
    "pickle deserialization": (r"(?i)\b(pickle\.load|pickle\.loads|cPickle)\b", ""),
    "torch.load (pickle-backed)": (r"(?i)\btorch\.load\s*\(", ""),
    "joblib.load": (r"(?i)\bjoblib\.load\s*\(", ""),
    "yaml.load (unsafe)": (r"(?i)\byaml\.load\s*\(", r"(?i)\byaml\.load\s*\(.*Loader\s*=\s*yaml\.SafeLoader"),
    "keras/h5 lambda layer": (r"(?i)\bLambda\s*\(", ""),
}
_KEY = r"(sk-(proj-|ant-|svc-)?[A-Za-z0-9_-]{20,}|AKIA[0-9A-Z]{16}|AIza[0-9A-Za-z_-]{35}|gh[pousr]_[A-Za-z0-9]{36}|xox[abpr]-[A-Za-z0-9-]{10,}|-----BEGIN ([A-Z]+ )?PRIVATE KEY-----)"

RULES: list[Rule] = [
    *[
        Rule(f"load-{i}", "unsafe-model-load", "ORTHO-SUPPLY-001", f"{kind}: code executes at load time", "HIGH", "LLM03", PY, p, 0.7, before=1, after=2, unless_line=v, unless_frame=_SAFE_LOAD)
        for i, (kind, (p, v)) in enumerate(_LOADS.items())
    ],
    Rule("hub", "unsafe-model-load", "ORTHO-SUPPLY-002", "Model pulled from a hub without a pinned revision", "LOW", "LLM03", PY, r"""(?i)from_pretrained\s*\(\s*['"][^'"]+['"]\s*\)""", 0.5, unless_line=_SAFE_LOAD),
    Rule("finetune", "data-poisoning", "ORTHO-POISON-001", "Fine-tuning job", "MEDIUM", "LLM04", (*PY, ".js", ".ts"), _FINETUNE, 0.6),
    Rule("train", "data-poisoning", "ORTHO-POISON-002", "Training on data of untrusted origin", "MEDIUM", "LLM04", (*PY, ".js", ".ts"), r"(?i)(\bTrainer\s*\(|\.fit\s*\(|\.train\s*\(|\btraining_file\s*=|\btrain_dataset\s*=)", 0.55, before=5, after=3, unless_line=_FINETUNE, frame=r"(?i)\b(requests\.get|httpx|urllib|WebBaseLoader|scrape|crawl|upload|request\.files|user_input|user_data|external|load_dataset\s*\([^)]*(http|url|user))", calm=r"(?i)(verify|validate|checksum|signature|sanitiz|trusted|provenance|allowlist|vetted)"),
    Rule("rag", "rag-trust", "ORTHO-RAG-001", "Untrusted text indexed without provenance", "MEDIUM", "LLM08", (".py", ".js", ".ts"), r"(?i)\b(add_texts|add_documents|from_documents|from_texts|upsert|index\.add|embed_documents)\s*\(", 0.55, before=7, after=3, frame=_UNTRUSTED_TEXT, file=_VECTORS, calm=_PROVEN),
    Rule("output-eval", "output-handling", "ORTHO-OUTPUT-001", "Model output reaches code execution (eval/exec)", "HIGH", "LLM05", JS, r"(?i)\b(eval|exec)\s*\(", 0.6, before=5, after=1, frame=_OUTPUT, unless_frame=_SANITIZED),
    Rule("output-shell", "output-handling", "ORTHO-OUTPUT-001", "Model output reaches shell execution", "HIGH", "LLM05", JS, r"(?i)\b(child_process|execSync|spawn\()", 0.6, before=5, after=1, frame=_OUTPUT, unless_frame=_SANITIZED),
    Rule("output-html", "output-handling", "ORTHO-OUTPUT-001", "Model output reaches HTML injection (XSS)", "HIGH", "LLM05", JS, r"(?i)(innerHTML\s*=|dangerouslySetInnerHTML)", 0.6, before=5, after=1, frame=_OUTPUT, unless_frame=_SANITIZED),
    Rule("leak", "prompt-leakage", "ORTHO-PROMPTLEAK-001", "System prompt written to a log", "MEDIUM", "LLM07", (".js", ".ts", ".tsx"), r"(?i)((console\.(log|error|warn|info|debug)|logger\.\w+)\s*\(.*(system_?prompt|system_?message|system_?instruction)|(system_?prompt|system_?message|system_?instruction).*(console\.(log|error|warn|info|debug)|logger\.\w+)\s*\()", 0.6),
    Rule("injection", "prompt-hardening", "ORTHO-PI-001", "Untrusted input joined to a prompt without trust boundary", "HIGH", "LLM01", _PROMPT_FILES, _CONCAT, 0.65, code=False, before=3, after=3, file=_SYSTEM, unless_line=_LOGGED, unless_frame=_HARDENED, roles=True),
    Rule("prompt-secret", "prompt-hardening", "ORTHO-PI-002", "Secret inside a system prompt", "HIGH", "LLM07", (".py", *_PROMPT_FILES), r"(?i)(api[_-]?key|password|secret|token)\s*[:=]\s*\S", 0.7, code=False, file=_SYSTEM, frame=_SYSTEM, size=160),
    Rule("secret", "secrets", "ORTHO-SECRET-001", "Credential in source text", "CRITICAL", "LLM02", (".py", *JS, ".go", ".java", ".yaml", ".yml", ".json", ".toml", ".env", ".sh", ".md"), r"(^|[^A-Za-z0-9_-])" + _KEY, 0.9, code=False, unless_line=r"(?i)(example|sample|fake|mock|dummy|xxxx|your[_-]|placeholder|0000)"),
    Rule("secret-split", "secrets", "ORTHO-SECRET-002", "Credential put together from pieces", "CRITICAL", "LLM02", (".py", *JS, ".go", ".java"), r"""['"](sk-|sk-proj-|AKIA|AIza|ghp_|gho_)[A-Za-z0-9_-]*['"]\s*\+\s*['"][A-Za-z0-9_-]{4,}['"]""", 0.8, code=False),
    Rule("uncapped-js", "unbounded-consumption", "ORTHO-CONSUME-001", "Model call without limit on generated length", "MEDIUM", "LLM10", JS, r"(?i)(chat\.completions\.create|responses\.create|messages\.create)\s*\(", 0.55, after=8, unless_frame=r"(?i)(max_tokens|max_output_tokens|maxTokens)", tests_info=True),
    *[Rule(f"uncapped{s[0]}", "unbounded-consumption", "ORTHO-CONSUME-001", "Model call without limit on generated length", "MEDIUM", "LLM10", s, p, 0.55, before=8, after=8, unless_frame=_CAP, tests_info=True) for s, p in COMPLETIONS.items()],
    *[
        Rule(f"agency{s[0]}-{i}", "tool-exposure", "ORTHO-AGENCY-001", f"Tool near {cap}", "CRITICAL", "LLM06", s, p, 0.75, code=False, before=14, after=5, frame=_TOOL, file=_TOOL, unless_line=_IMPORT, calm=_CONFIRM, calm_file=True, calm_severity="MEDIUM", calm_confidence=0.55)
        for s, caps in TOOL_SINKS.items()
        for i, (cap, p) in enumerate(caps.items())
    ],
]


def literals(pattern: str) -> frozenset[str]:
    """Lower-case texts of which every match of ``pattern`` holds at least one, whatever its case; empty if none is certain.

    Of a sequence the part with the longest texts counts, of alternatives all parts together.
    """
    from re import _parser as parser

    def best(a: frozenset[str], b: frozenset[str]) -> frozenset[str]:
        rank = lambda s: min(map(len, s)) if s else 0
        return a if rank(a) >= rank(b) else b

    def of(seq) -> frozenset[str]:
        out, run = frozenset(), ""
        for op, arg in seq:
            name = str(op)
            if name == "LITERAL" and arg < 128:
                run += chr(arg).lower()
                continue
            out, run = best(out, frozenset([run] if run else [])), ""
            if name == "SUBPATTERN":
                out = best(out, of(arg[-1]))
            elif name == "BRANCH":
                parts = [of(x) for x in arg[1]]
                out = best(out, frozenset().union(*parts) if all(parts) else frozenset())
            elif name in ("MAX_REPEAT", "MIN_REPEAT") and arg[0] > 0:
                out = best(out, of(arg[2]))
        return best(out, frozenset([run] if run else []))

    return of(parser.parse(pattern))


_SQUEEZED = r"regexp_replace(element_at(lines, i), '^\\s+|\\s+$', '')"


def _q(p: str) -> str:
    """A text as an SQL literal."""
    return "'" + p.replace("\\", "\\\\").replace("'", "\\'") + "'"


def _may_match(*patterns: str) -> list[str]:
    """Plain searches of the lower-case text for what each pattern cannot do without."""
    each = [sorted(literals(p)) for p in patterns if p]
    return ["(" + " or ".join(f"contains(low, {_q(x)})" for x in xs) + ")" for xs in each if xs]


def _hits(r: Rule) -> str:
    """The hits of a rule as SQL over suffix, text, low, lines and codes; null for a file the rule can't concern.

    Written as text and parsed at once: built from columns, the rules cost more than the files.
    """
    src = "codes" if r.code else "lines"
    part = lambda of: f"slice({of}, greatest(1, i - {r.before}), i + {r.after} - greatest(1, i - {r.before}) + 1)"
    like = lambda what, p: f"rlike({what}, {_q(p)})"
    frame = f"array_join({part(src)}, '\\n')"
    at = f"element_at({src}, i)"
    calm = lambda of: f"exists({of}, x -> {like('x', r.calm)} and not {like('x', NEGATION)})"
    ok = [like(at, r.pattern)]
    ok += [f"not {like(at, r.unless_line)}"] * bool(r.unless_line)
    ok += [like(frame, r.frame)] * bool(r.frame)
    ok += [f"not {like(frame, r.unless_frame)}"] * bool(r.unless_frame)
    ok += [f"not {calm(part('codes'))}"] * bool(r.calm and not r.calm_severity)
    if r.roles:
        roles = f"filter(transform(slice(lines, greatest(1, i - 7), i - greatest(1, i - 7) + 1), x -> lower(regexp_extract(x, {_q(_ROLE)}, 1))), x -> x <> '')"
        ok.append(f"coalesce(try_element_at({roles}, -1), 'system') = 'system'")
    calmed = " and ".join([calm(part("codes")), *[calm("codes")] * r.calm_file]) if r.calm_severity else "false"
    out = f"transform(filter(sequence(1, size(lines)), i -> {' and '.join(ok)}), i -> struct({_q(r.key)} as key, i as line, substring({_SQUEEZED}, 1, {r.size}) as evidence, {calmed} as calmed))"
    whole = f"(?im){r.pattern.removeprefix('(?i)')}" if r.pattern.startswith("(?i)") else f"(?m){r.pattern}"
    # plain searches go first: most files lack what a rule cannot do without
    need = [f"suffix in ({', '.join(map(_q, r.suffixes))})", *_may_match(r.pattern, r.file, r.frame), like("text", whole)]
    need += [like("text", r.file)] * bool(r.file)
    return f"case when {' and '.join(need)} then {out} end"


_ROLE = r"""(?i)['"]role['"]\s*:\s*['"](\w+)['"]"""
EMPTY = "array<struct<key:string,line:int,evidence:string,calmed:boolean>>"


def rule_table(spark: SparkSession, rules: list[Rule] = RULES) -> DataFrame:
    """The rules as a small dimension; ``det_ord`` is their order."""
    rows = [(r.key, r.detector, r.rule_id, r.title, r.severity, r.owasp, r.confidence, r.calm_severity, r.calm_confidence, r.tests_info, i) for i, r in enumerate(rules)]
    return spark.createDataFrame(rows, "key string, detector string, rule_id string, title string, severity string, owasp_llm string, confidence double, calm_severity string, calm_confidence double, tests_info boolean, det_ord int")


def line_findings(files: DataFrame, rules: list[Rule] = RULES) -> DataFrame:
    """Findings of all ``rules`` over ``files`` (file_id, repo, path, suffix, text), in the findings schema's core columns.

    Null and empty texts give none. Further columns of ``files`` are ignored.
    """
    suffix, text = F.lower("suffix"), F.col("text")
    used = sorted({s for r in rules for s in r.suffixes})
    x = files.where(suffix.isin(*used) & text.isNotNull() & (text != "")).select("file_id", "repo", "path", suffix.alias("suffix"), "text")
    x = x.withColumn("low", F.lower("text")).withColumn("lines", split_lines("text")).withColumn("codes", F.transform("lines", strip_comment))
    h = F.expr("concat(" + ", ".join(f"coalesce({_hits(r)}, cast(array() as {EMPTY}))" for r in rules) + ")")
    x = x.select("file_id", "repo", "path", F.explode(h).alias("h")).select("file_id", "repo", F.col("path").alias("file"), "h.*")
    x = x.join(F.broadcast(rule_table(files.sparkSession, rules)), "key")
    x = x.withColumn("severity", F.when(F.col("tests_info") & is_test_path("file"), "INFO").when(F.col("calmed"), F.col("calm_severity")).otherwise(F.col("severity")))
    x = x.withColumn("confidence", F.when(F.col("calmed"), F.col("calm_confidence")).otherwise(F.col("confidence")))
    value = F.create_map(*[v for s in SEVERITIES for v in (F.lit(s[0]), F.lit(s[1]))])
    return x.select("file_id", "repo", "detector", "rule_id", "title", "severity", F.element_at(value, F.col("severity")).alias("sev_value"), "owasp_llm", "file", "line", "evidence", "confidence", F.lit("deterministic").alias("confidence_tier"), location("file", "line").alias("location"), fingerprint("rule_id", "file", "evidence").alias("fingerprint"), "det_ord", "key")


def rules_sql(rules: list[Rule] = RULES) -> str:
    """SQL with the result (key, file_id, line, severity) of ``line_findings``."""
    q = lambda p: "'" + p.replace("'", "''") + "'"
    lines = r"string_split_regex(regexp_replace(text, '(\r\n|[\n\r\x0B\f\x1C\x1D\x1E\x{85}\x{2028}\x{2029}])$', ''), '\r\n|[\n\r\x0B\f\x1C\x1D\x1E\x{85}\x{2028}\x{2029}]')"
    used = sorted({s for r in rules for s in r.suffixes})
    sql = f"""with f as (select file_id, path, lower(suffix) as suffix, text, {lines} as ls from files where text is not null and text <> '' and lower(suffix) in ({", ".join(map(q, used))})),
 l as (select file_id, path, suffix, unnest(ls) as raw, unnest(range(1, len(ls) + 1)) as line from f),
 c as (select *, split_part(split_part(raw, '#', 1), '//', 1) as code from l)"""
    parts = []
    for r in rules:
        s = "code" if r.code else "raw"
        w = f"over (partition by file_id order by line rows between {r.before} preceding and {r.after} following)"
        cols = [f"string_agg({s}, chr(10)) {w} as frame"]
        calm = f"(regexp_matches(code, {q(r.calm)}) and not regexp_matches(code, {q(NEGATION)}))" if r.calm else "false"
        cols.append(f"bool_or({calm}) {w} as calmed")
        cols.append(f"bool_or({calm}) over (partition by file_id) as calmed_file" if r.calm_file else "true as calmed_file")
        if r.roles:
            cols.append(f"last_value(nullif(lower(regexp_extract(raw, {q(_ROLE)}, 1)), '') ignore nulls) over (partition by file_id order by line rows between 7 preceding and current row) as role")
        cond = [f"regexp_matches({s}, {q(r.pattern)})"]
        cond += [f"not regexp_matches({s}, {q(r.unless_line)})"] * bool(r.unless_line)
        cond += [f"regexp_matches(frame, {q(r.frame)})"] * bool(r.frame)
        cond += [f"not regexp_matches(frame, {q(r.unless_frame)})"] * bool(r.unless_frame)
        cond += ["not calmed"] * bool(r.calm and not r.calm_severity)
        cond += ["coalesce(role, 'system') = 'system'"] * r.roles
        cond += [f"exists (select 1 from f where f.file_id = x.file_id and regexp_matches(f.text, {q(r.file)}))"] * bool(r.file)
        sev = f"case when {str(r.tests_info).lower()} and regexp_matches(path, {q(TEST_PATH)}) then 'INFO' when {str(bool(r.calm_severity)).lower()} and calmed and calmed_file then {q(r.calm_severity)} else {q(r.severity)} end"
        inside = f"select *, {', '.join(cols)} from c where suffix in ({', '.join(map(q, r.suffixes))})"
        parts.append(f"select {q(r.key)} as key, file_id, line::int as line, {sev} as severity from ({inside}) x where {' and '.join(cond)}")
    return sql + " " + " union all ".join(parts)
