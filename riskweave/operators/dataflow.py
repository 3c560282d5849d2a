"""Checks within one file, solved where its facts are made: a file is the unit, so nothing is shuffled for them.

``solve`` takes the fact rows of a file (see ``facts``) and adds rows of three kinds:

tag      columns used
finding  s1 rule, s2 detail, s3 severity, line, refs the way from source to sink as ``line|role|text``
summary  s1 function, s2 parameter, n2 position, s3 what the parameter reaches: a kind of sink, or ``prompt``
sink     s1 function, s2 capability, line: what a function does itself

and marks the ``arg`` rows: b2 model output in it, b3 untrusted input in it. What crosses files is joined on these rows.
"""

from __future__ import annotations

import re
from collections import defaultdict
from collections.abc import Callable, Iterable
from dataclasses import dataclass

# Name patterns, sinks and capabilities.
OUTPUT_NAME = re.compile(r"(?i)(completion|response|\banswer|reply|generated|assistant|\boutput(?!_?(?:path|file|dir|folder|name|filename|wav|mp3|pcm|png|jpe?g|gif|csv|json|ya?ml|txt|md|html|pdf|url|uri|dst|dest|target|size|len|count|format|ext|buffer|stream|bytes|fd|handle|loc|location))|\bresp\b|choices)")
USER_NAME = re.compile(r"(?i)(\buser|\binput\b|query|question|\bmessage\b|request|\breq\b|\bprompt\b|\bmsg\b|payload|\bbody\b|user_input|user_query|user_message|user_content)")
SYSTEM_NAME = re.compile(r"(?i)(system_prompt|system_message|system_instruction|sys_prompt|systemprompt|sys_msg)")
DB_RECEIVER = re.compile(r"(?i)(cursor|conn|connection|\bdb\b|database|session|\bcur\b|sql|engine)")
USERFACING = re.compile(r"(?i)(route|endpoint|handler|\bapi\b|\bchat\b|\bask\b|answer|respond|reply|generate_response|\bquery\b|complete_)")
GROUNDING = re.compile(r"(?i)(citation|\bcite\b|\bsource|verif|validat|ground|retriev|\brag\b|disclaimer|confidence|fact.?check|reference|guardrail|moderat)")
HIGH_STAKES = re.compile(r"(?i)(medical|health|diagnos|clinical|patient|symptom|treatment|medication|dosage|prescription|therap|legal|lawyer|attorney|litigation|contract|financial|invest|\btax\b|loan|mortgage|trading|securit)")
SHELL_CALLS = frozenset(["os.system", "subprocess.run", "subprocess.call", "subprocess.Popen", "subprocess.check_output"])
CAPABILITIES = {
    **dict.fromkeys(SHELL_CALLS, "shell/command execution"),
    **dict.fromkeys(["os.remove", "os.unlink", "shutil.rmtree"], "arbitrary file delete"),
    **dict.fromkeys(["requests.get", "requests.post", "requests.put", "requests.delete"], "arbitrary outbound HTTP"),
    **dict.fromkeys(["eval", "exec"], "code execution"),
}
SQL_CALLS, DB_CALLS, TEMPLATES = frozenset(["executescript", "raw"]), frozenset(["execute", "executemany"]), frozenset(["render_template_string", "Template"])
COMPLETIONS = frozenset(["completions.create", "messages.create", "responses.create"])
LOG_METHODS = frozenset("debug info warning warn error exception critical log write".split())
LOG_OBJECTS = frozenset("logging logger log console sys".split())
CAP_KEYS = frozenset("max_tokens max_output_tokens maxtokens max_completion_tokens maxoutputtokens".split())
REQUEST_NAMES = frozenset("request req flask".split())

TAG, SCOPE, LINE, END, N1, N2, S1, S2, S3, REFS, REFS2, KW, B1, B2, B3 = range(15)
SLICE_ROUNDS, TRACE_STEPS = 8, 5


@dataclass(frozen=True)
class Dialect:
    """What names and calls mean in a language."""

    output: re.Pattern
    user: re.Pattern
    system: re.Pattern
    kind: Callable[[tuple], str | None]
    power: Callable[[tuple], str | None]
    #: explicit completion call (True), a likely one (False), or none (None)
    completes: Callable[[tuple], bool | None]
    logs: Callable[[tuple], bool]
    requests: frozenset[str]
    remark: str = "#"
    #: whether functions that return model output count as model calls where they are called
    returns: bool = False


def _row(tag: str, line: int, **v) -> tuple:
    names = ["scope", "line", "end", "n1", "n2", "s1", "s2", "s3", "refs", "refs2", "kw", "b1", "b2", "b3"]
    v = {"scope": "", "line": line, "end": 0} | v
    return (tag, *[v.get(c) for c in names])


def chain(call: tuple) -> str:
    return f"{call[S1]}.{call[S2]}" if call[S1] else call[S2]


def _is_sql(call: tuple) -> bool:
    return call[S2] in SQL_CALLS or call[S2] in DB_CALLS and bool(DB_RECEIVER.search(call[S3] or ""))


def sink_kind(call: tuple) -> str | None:
    """What a call does with model output; None for other calls."""
    if not call[S1] and call[S2] in ("eval", "exec"):
        return "code execution (eval/exec)"
    if chain(call) in SHELL_CALLS:
        return "shell execution"
    if _is_sql(call):
        return "SQL execution"
    if call[S2] in TEMPLATES:
        return "template rendering"
    return "shell execution" if "shell=True" in (call[KW] or ()) else None


def capability(call: tuple) -> str | None:
    """What power a call has, whatever its arguments are."""
    c = CAPABILITIES.get(chain(call))
    if c or not _is_sql(call):
        return c or ("shell/command execution" if "shell=True" in (call[KW] or ()) else "arbitrary file write" if "mode=write" in (call[KW] or ()) else None)
    return "raw SQL execution"


def _logs(call: tuple) -> bool:
    return call[S2] == "print" if not call[S1] else call[S2] in LOG_METHODS or call[S1] in LOG_OBJECTS


def _completes(call: tuple) -> bool | None:
    return True if chain(call) in COMPLETIONS else False if call[S1] and call[S2] in ("generate", "acreate", "complete") else None


PYTHON = Dialect(OUTPUT_NAME, USER_NAME, SYSTEM_NAME, sink_kind, capability, _completes, _logs, REQUEST_NAMES)


# Names, sinks and powers in languages with braces; a key is an object and a method, or a method alone.
BRACE_OUTPUT = re.compile(r"(?i)(completion|response|answer|reply|generated|assistant|output(?!path|file|dir|name|buf|stream|writer|target|location|dest)|resp|choices)")
BRACE_USER = re.compile(r"(?i)(user_?(input|query|message|content|prompt)|\bquestion\b|\binput\b|\bquery\b|\bbody\b|\bpayload\b|\breq\b|\brequest\b|\bmsg\b|\bmessage\b)")
BRACE_SYSTEM = re.compile(r"(?i)(system_?prompt|system_?message|system_?instruction|sys_?prompt)")
BRACE_DB = re.compile(r"(?i)(cursor|conn|connection|\bdb\b|database|session|sql|knex|prisma|pool|statement|stmt|\bmysqli|\bpdo\b)")
BRACE_SHELL = re.compile(r"(?i)(child_?process|^cp$|^cproc$|shelljs|execa)")
HTML, SHELL, CODE = "HTML injection (XSS)", "shell execution", "code execution (eval/exec)"
BRACE_SINKS = {
    **dict.fromkeys(["eval", "Function"], CODE), **dict.fromkeys(["innerHTML", "outerHTML", "dangerouslySetInnerHTML", "insertAdjacentHTML", "document.write", "template.HTML", "Html.Raw"], HTML),
    **dict.fromkeys(["execSync", "spawnSync", "execFile", "exec.Command", "exec.CommandContext", "ProcessBuilder", "Process.Start", "Command.new", "shell_exec", "passthru", "proc_open", "system", "popen", "getRuntime.exec", "runtime.exec"], SHELL),
}
BRACE_SQL = frozenset("query querycontext queryrow queryrowcontext exec execcontext execute executequery executeupdate executesqlraw fromsqlraw raw queryrawunsafe".split())
BRACE_POWERS = {
    **dict.fromkeys(["fs.writeFile", "fs.writeFileSync", "fs.unlink", "fs.rm", "os.Remove", "os.RemoveAll", "os.WriteFile", "Files.write", "Files.delete", "File.Delete", "File.WriteAllText", "unlink", "file_put_contents", "fs.write", "fs.remove_file"], "arbitrary file write/delete"),
    **dict.fromkeys(["fetch", "axios.get", "axios.post", "http.Get", "http.Post", "http.NewRequest", "curl_exec", "reqwest.get"], "arbitrary outbound HTTP"),
}
BRACE_COMPLETIONS = frozenset("completions.create messages.create responses.create".split())
BRACE_COMPLETION_CALLS = frozenset("createchatcompletion createcompletion createchatcompletionstream generatecontent completechat completechatasync".split())


def _brace_kind(call: tuple) -> str | None:
    key = chain(call)
    got = BRACE_SINKS.get(key) or BRACE_SINKS.get(call[S2])
    if got:
        return got
    if call[S2] in ("exec", "spawn") and (not call[S1] or BRACE_SHELL.search(call[S1])):
        return SHELL
    return "SQL execution" if call[S2].lower() in BRACE_SQL and BRACE_DB.search(call[S1] or "") else None


def _brace_power(call: tuple) -> str | None:
    got = BRACE_POWERS.get(chain(call)) or BRACE_POWERS.get(call[S2])
    kind = None if got else _brace_kind(call)
    return got or {SHELL: "shell/command execution", CODE: "code execution", "SQL execution": "raw SQL execution"}.get(kind or "")


def _brace_completes(call: tuple) -> bool | None:
    return True if chain(call) in BRACE_COMPLETIONS or call[S2].lower() in BRACE_COMPLETION_CALLS else None


def _brace_logs(call: tuple) -> bool:
    return bool(call[S1]) and (call[S1].lower() in ("console", "logger", "log", "slog", "logging") or call[S1] == "fmt" and call[S2].startswith("Print"))


BRACES = Dialect(BRACE_OUTPUT, BRACE_USER, BRACE_SYSTEM, _brace_kind, _brace_power, _brace_completes, _brace_logs, frozenset(["req", "request"]), "//", True)


def spread_names(seeds: Iterable[str], assigns: list[tuple], clears: bool) -> set[str]:
    """All names that ``seeds`` reach over assignments; with ``clears`` a sanitizer on top of the value stops them."""
    users = defaultdict(list)
    for a in assigns:
        if not (clears and a[B2]):
            for r in a[REFS]:
                users[r].append(a[S1])
    known = set(seeds)
    todo = list(known)
    while todo:
        for t in users.get(todo.pop(), ()):
            if t not in known:
                known.add(t)
                todo.append(t)
    return known


def trace(names: Iterable[str], tainted: set[str], assigns: list[tuple], params: dict[str, int], sink: int, lines: list[str]) -> list[str]:
    """The way of a taint as ``line|role|text``: a backward slice over the assignments before the sink, the first step and
    the last ones kept."""
    want, steps = {n for n in names if n in tainted}, {}
    before = [a for a in assigns if 0 < a[LINE] <= sink]
    for _ in range(SLICE_ROUNDS if want else 0):
        size = len(want) + len(steps)
        for a in before:
            if a[S1] in want:
                steps.setdefault(a[LINE], "propagates")
                want.update(a[REFS])
        if size == len(want) + len(steps):
            break
    steps |= {at: "source" for p, at in params.items() if p in want}
    steps.pop(sink, None)
    way = sorted(steps.items())
    if len(way) > TRACE_STEPS:
        way = [way[0], *way[1 - TRACE_STEPS :]]
    if way and all(role != "source" for _, role in way):
        way[0] = (way[0][0], "source")
    return [f"{n}|{role}|{lines[n - 1].strip()[:160] if 0 < n <= len(lines) else ''}" for n, role in [*way, (sink, "sink")]]


class File:
    """The facts of one file by tag and scope, with the taint of its scopes worked out when asked for."""

    def __init__(self, rows: list[tuple], text: str, dialect: Dialect):
        self.lines, self.dialect = text.splitlines(), dialect
        self.by: dict[str, dict[str, list[tuple]]] = defaultdict(lambda: defaultdict(list))
        for r in rows:
            self.by[r[TAG]][r[SCOPE]].append(r)
        self.funcs = {s: f[0] for s, f in self.by["func"].items()}
        self._taints: dict[tuple[str, str], set[str]] = {}
        # functions that return model output count as such where a language's calls are read by name
        self.makers: set[str] = set()
        while dialect.returns:
            more = {f[S1] for s, f in self.funcs.items() if any(r[B1] or self.output(s) & set(r[REFS]) for r in self.by["return"][s])} - self.makers
            if not more:
                break
            self.makers |= more
            self._taints.clear()

    def _cached(self, kind: str, scope: str, make: Callable[[], set[str]]) -> set[str]:
        if (kind, scope) not in self._taints:
            self._taints[kind, scope] = make()
        return self._taints[kind, scope]

    def _seeds(self, scope: str, pattern: re.Pattern, kinds: tuple[str, ...] = ("param", "store")) -> set[str]:
        return {n[S1] for n in self.by["name"][scope] if n[S2] in kinds and pattern.search(n[S1])}

    def output(self, scope: str) -> set[str]:
        """Names that hold model output."""
        a = self.by["assign"][scope]
        return self._cached("output", scope, lambda: spread_names(self._seeds(scope, self.dialect.output) | self.makers | {x[S1] for x in a if x[B1] and not x[B2]}, a, True))

    def untrusted(self, scope: str) -> set[str]:
        """Names that hold user input; loop variables are no source, and no sanitizer clears it."""
        a = self.by["assign"][scope]
        loops = {n[S1] for n in self.by["name"][scope] if n[S2] == "loop"}
        user = self.dialect.user
        seeds = (self._seeds(scope, user, ("store",)) - loops) | self._seeds(scope, user, ("param",)) | {x[S1] for x in a if x[B3]}
        return self._cached("untrusted", scope, lambda: spread_names(seeds | self.dialect.requests, a, False))

    def params(self, scope: str) -> dict[str, int]:
        return dict.fromkeys(self.funcs[scope][REFS], self.funcs[scope][LINE]) if scope in self.funcs else {}

    def way(self, names: Iterable[str], tainted: set[str], scope: str, line: int) -> list[str]:
        return trace(names, tainted, self.by["assign"][scope], self.params(scope), line, self.lines)


def _prompts(f: File, scope: str, tainted: set[str]) -> list[tuple[int, list[str]]]:
    """(line, names) of system prompts of a scope that hold a tainted name or request data."""
    if any(t[B1] for t in f.by["text"][scope]):
        return []
    made = [a for a in f.by["assign"][scope] if f.dialect.system.search(a[S1])] + [d for d in f.by["dict"][scope] if d[S1] == "system"]
    return [(a[LINE], a[REFS]) for a in made if a[B3] or tainted & set(a[REFS])]


def summaries(f: File) -> list[tuple]:
    """What each parameter reaches within its function."""
    out = []
    for scope, fn in f.funcs.items():
        calls = [(c, f.dialect.kind(c)) for c in f.by["call"][scope]]
        calls = [(c, k) for c, k in calls if k]
        prompts = _prompts(f, scope, {n for a in [*f.by["assign"][scope], *f.by["dict"][scope]] for n in a[REFS]})
        if not calls and not prompts:
            continue
        for pos, p in enumerate(fn[REFS]):
            t = spread_names([p], f.by["assign"][scope], True)
            kinds = sorted(k for c, k in calls if t & set(c[REFS2] if k == "SQL execution" else c[REFS]))
            if kinds:
                out.append(_row("summary", fn[LINE], s1=fn[S1], s2=p, n2=pos, s3=kinds[0]))
            if prompts and _prompts(f, scope, spread_names([p], f.by["assign"][scope], False)):
                out.append(_row("summary", fn[LINE], s1=fn[S1], s2=p, n2=pos, s3="prompt"))
    return out


def tools(f: File) -> dict[str, bool]:
    """Functions exposed to a model, and whether they ask for confirmation."""
    named = {t[S1] for t in f.by["tool"][""]}
    out: dict[str, bool] = {}
    for fn in f.funcs.values():
        if fn[B1] or fn[S1] in named:
            out[fn[S1]] = out.get(fn[S1], False) or bool(fn[B2])
    return out


def solve(rows: list[tuple], text: str, path: str = "", dialect: Dialect | None = None) -> list[tuple]:
    """``rows`` with marked arguments, and the findings, summaries and sinks of the file."""
    d = dialect or PYTHON
    f = File(rows, text, d)
    found: dict[tuple, tuple] = {}

    def find(rule: str, line: int, severity: str, detail: str = "", way: list[str] | None = None, key: str = "") -> None:
        found.setdefault((rule, line, key), _row("finding", line, s1=rule, s2=detail, s3=severity, refs=way or []))

    marked = []
    for r in rows:
        if r[TAG] == "arg":
            out, bad = f.output(""), f.untrusted(r[SCOPE])
            r = (*r[:B2], bool(r[B1] or out & set(r[REFS])), bool(bad & set(r[REFS])))
        marked.append(r)
    own = summaries(f)
    # model output into a sink: the whole file is the scope
    out = f.output("")
    hits: dict[int, tuple[str, list[str]]] = {}
    for c in f.by["call"][""]:
        kind = d.kind(c)
        names = (c[REFS2] if kind == "SQL execution" else c[REFS]) or []
        if kind and (out & set(names) or (c[B3] if kind == "SQL execution" else c[B2])):
            hits[c[LINE]] = min(hits.get(c[LINE], (kind, names)), (kind, names))
    for line, (kind, names) in hits.items():
        find("ORTHO-OUTPUT-001", line, "HIGH", kind, f.way(names, out, "", line))
    # model output or user input handed to a parameter that reaches a sink or a prompt
    reach = defaultdict(list)
    for s in own:
        reach[s[S1]].append(s)
    calls = {c[N1]: c for c in f.by["call"][""]}
    for r in marked:
        if r[TAG] == "arg" and r[N1] in calls:
            c = calls[r[N1]]
            for s in reach.get(c[S2], ()):
                if r[S1] == s[S2] or r[S1] is None and r[N2] == s[N2]:
                    if s[S3] != "prompt" and r[B2]:
                        find("ORTHO-OUTPUT-001", c[LINE], "HIGH", s[S3], f.way(r[REFS], out, "", c[LINE]))
                    elif s[S3] == "prompt" and r[B3]:
                        find("ORTHO-PI-001", c[LINE], "HIGH", "", f.way(r[REFS], f.untrusted(r[SCOPE]), r[SCOPE], c[LINE]))
    for scope in f.funcs:
        bad = f.untrusted(scope)
        for line, names in _prompts(f, scope, bad):
            find("ORTHO-PI-001", line, "HIGH", "", f.way(names, bad, scope, line))
    leaky = {s: spread_names(f._seeds(s, d.system), f.by["assign"][s], False) for s in ["", *f.funcs]}
    for scope, names in leaky.items():
        for c in f.by["call"][scope]:
            if d.logs(c) and names & set(c[REFS]):
                find("ORTHO-PROMPTLEAK-001", c[LINE], "MEDIUM", "", f.way(c[REFS], names, scope, c[LINE]))
    # what tools can do, by themselves and through local calls
    does, local = defaultdict(set), defaultdict(set)
    names = {fn[S1] for fn in f.funcs.values()}
    for scope, fn in f.funcs.items():
        for c in f.by["call"][scope]:
            if cap := d.power(c):
                does[fn[S1]].add((c[LINE], cap))
            if c[S2] in names:
                local[fn[S1]].add(c[S2])
    for tool, asks in sorted(tools(f).items()):
        seen, todo = {tool}, [tool]
        while todo:
            new = local[todo.pop()] - seen
            seen |= new
            todo += new
        for line, cap in sorted({x for n in seen for x in does[n]}):
            find("ORTHO-AGENCY-001", line, "MEDIUM" if asks else "CRITICAL", cap, key=cap)
    for c, explicit in sorted(((c, d.completes(c)) for c in f.by["call"][""]), key=lambda x: not x[1]):
        if explicit is not None and not CAP_KEYS & {k.lower() for k in c[KW] or ()}:
            find("ORTHO-CONSUME-001", c[LINE], "MEDIUM" if explicit else "LOW")
    for scope in list(f.by["loop"]):
        for x in f.by["loop"][scope]:
            if x[B1] and not x[B2]:
                find("ORTHO-CONSUME-002", x[LINE], "MEDIUM")
    if HIGH_STAKES.search(text) or HIGH_STAKES.search(path):
        for scope, fn in f.funcs.items():
            body = "\n".join(x.split(d.remark, 1)[0] for x in f.lines[fn[LINE] - 1 : fn[END]])
            if USERFACING.search(fn[S1]) and not GROUNDING.search(body):
                for r in f.by["return"][scope]:
                    if r[B1] or f.output(scope) & set(r[REFS]):
                        find("ORTHO-MISINFO-001", r[LINE], "INFO")
    sinks = [_row("sink", line, s1=n, s2=cap) for n, x in does.items() for line, cap in sorted(x)]
    return marked + own + sinks + list(found.values())
