"""Syntax facts of Python files: the one place that parses; every check on them is relational.

A file becomes rows of one wide table, told apart by ``tag``; trees never leave the worker. Rows of a nested function are
repeated for the enclosing functions and for the module (scope ``''``), as a scope is a whole subtree.

tag      columns used
func     scope (own name path), s1 name, refs parameters, b1 exposed as a tool by decorator, b2 asks for confirmation
name     s1 name, s2 kind: param, store or loop
assign   s1 target, refs names read, b1 model call in it, b2 sanitizer on top, b3 request data or input() in it
call     n1 number, s1 object, s2 method, s3 receiver, refs names in arguments, refs2 names in the first one, kw keywords,
         b1 model call, b2 model call among the arguments, b3 model call in the first; kw also holds ``shell=True``
         and, for a file opened to be written, ``mode=write``
arg      n1 call, s1 keyword or null, n2 position, refs names read, b1 model call in it, b2 model output in it, b3 untrusted
         input in it
return   refs names read, b1 model call in it
loop     endless loop: b1 model call in it, b2 a way out
dict     message with role: s1 role, refs names read in its content, b3 request data in it
import   n1 level, s1 module, s2 name or null, s3 local name
tool     s1 name of a function handed over as a tool
text     b1 hardening language among the scope's strings
error    the file doesn't parse

``dataflow.solve`` adds what follows from them within the file.
"""

from __future__ import annotations

import ast
import re
import warnings
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from riskweave.operators.dataflow import BRACES, solve
from riskweave.runtime import spread

# Names and patterns by which calls, names and texts are told apart.
TOOL_DECORATORS = {"tool", "function_tool", "beta_tool", "beta_async_tool", "ai_function"}
TOOL_KEYS = {"fn", "func", "function", "handler", "coroutine"}
TOOL_NAMES = {"name", "tool", "function"}
CONFIRM = {"confirm", "approval", "approve", "require_approval", "human_in_the_loop", "allowlist", "whitelist", "requires_confirmation"}
MODEL_CALLS = {"create", "generate", "complete", "acreate", "acomplete", "agenerate", "chat", "invoke", "ainvoke", "predict", "apredict", "stream", "astream", "generate_content"}
GATED_CALLS = {"run", "arun", "query", "aquery", "call", "acall", "send_message", "ask", "respond"}
MODEL_RECEIVER = re.compile(r"(?i)(llm|chain|agent|chat|query_engine|conversation|\brag\b|\bqa\b|pipeline|assistant|completion|openai|anthropic|gemini|bedrock|ollama|groq|cohere|litellm)")
SANITIZERS = {"loads", "load", "escape", "clean", "sanitize", "validate", "parse", "model_validate", "quote", "quote_plus"}
REQUEST_ROOTS = {"request", "req", "flask"}
HARDENING = re.compile(r"(?i)(untrusted|do not follow|ignore any instructions|delimited by|<user_input>|treat .* as data|never reveal|do not disclose|as data, not|do not obey)")

SCHEMA = "file_id {0}, tag string, scope string, line int, end int, n1 int, n2 int, s1 string, s2 string, s3 string, refs array<string>, refs2 array<string>, kw array<string>, b1 boolean, b2 boolean, b3 boolean"
_NAMES = ["file_id", "tag", "scope", "line", "end", "n1", "n2", "s1", "s2", "s3", "refs", "refs2", "kw", "b1", "b2", "b3"]
_KINDS = [pa.string(), pa.string(), *[pa.int32()] * 4, *[pa.string()] * 3, *[pa.list_(pa.string())] * 3, *[pa.bool_()] * 3]


def _last(n: ast.AST) -> str:
    """Last segment of a name or attribute chain."""
    if isinstance(n, ast.Attribute):
        return n.attr
    if isinstance(n, ast.Call):
        return _last(n.func)
    return n.id if isinstance(n, ast.Name) else ""


def _pair(n: ast.AST) -> tuple[str, str]:
    """(object, method) of a callee."""
    return (_last(n.value), n.attr) if isinstance(n, ast.Attribute) else ("", _last(n))


def _is_model_call(c: ast.Call) -> bool:
    obj, meth = _pair(c.func)
    return meth in MODEL_CALLS or meth in GATED_CALLS and isinstance(c.func, ast.Attribute) and bool(MODEL_RECEIVER.search(obj))


def _refs(*nodes: ast.AST | None) -> list[str]:
    return sorted({x.id for n in nodes if n is not None for x in ast.walk(n) if isinstance(x, ast.Name)})


def _any(test, *nodes: ast.AST | None) -> bool:
    return any(test(x) for n in nodes if n is not None for x in ast.walk(n))


def _model_in(*nodes: ast.AST | None) -> bool:
    return _any(lambda x: isinstance(x, ast.Call) and _is_model_call(x), *nodes)


def _request_in(*nodes: ast.AST | None) -> bool:
    def test(x: ast.AST) -> bool:
        if isinstance(x, ast.Call) and isinstance(x.func, ast.Name) and x.func.id == "input":
            return True
        return isinstance(x, ast.Name) and x.id in REQUEST_ROOTS

    return _any(test, *nodes)


def _text(n: ast.AST | None) -> str:
    """The value of a string constant, else nothing."""
    return n.value if isinstance(n, ast.Constant) and isinstance(n.value, str) else ""


def _flags(c: ast.Call) -> list[str]:
    shell = any(k.arg == "shell" and isinstance(k.value, ast.Constant) and k.value.value is True for k in c.keywords)
    write = isinstance(c.func, ast.Name) and c.func.id == "open" and len(c.args) > 1 and set(_text(c.args[1])) & {"w", "a"}
    return ["shell=True"] * shell + ["mode=write"] * bool(write)


def _targets(t: ast.AST) -> list[str]:
    """Names bound by an assignment target; attributes and subscripts bind none."""
    if isinstance(t, ast.Name):
        return [t.id]
    if isinstance(t, ast.Starred):
        return _targets(t.value)
    return [x for e in t.elts for x in _targets(e)] if isinstance(t, (ast.Tuple, ast.List)) else []


def facts_of(text: str | None) -> list[tuple]:
    """Fact rows of one file, without its id; null and blank texts have none."""
    if not text or not text.strip():
        return []
    rows: list[tuple] = []
    try:
        with warnings.catch_warnings():
            warnings.simplefilter("ignore")
            tree = ast.parse(text)
    except (SyntaxError, ValueError, RecursionError, MemoryError):
        return [("error", "", 0, 0, None, None, None, None, None, None, None, None, None, None, None)]
    calls = 0

    def emit(scopes, tag, line, end=0, n1=None, n2=None, s1=None, s2=None, s3=None, refs=None, refs2=None, kw=None, b1=None, b2=None, b3=None):
        rows.extend((tag, s, line, end, n1, n2, s1, s2, s3, refs, refs2, kw, b1, b2, b3) for s in scopes)

    def visit(node: ast.AST, scopes: list[str], path: str) -> None:
        nonlocal calls
        if isinstance(node, (ast.FunctionDef, ast.AsyncFunctionDef)):
            path = f"{path}.{node.name}" if path else node.name
            scopes = [*scopes, path]
            a = node.args
            params = [x.arg for x in a.args]
            every = [x.arg for x in [*a.posonlyargs, *a.args, *a.kwonlyargs, *filter(None, (a.vararg, a.kwarg))]]
            decorators = [_last(d.func if isinstance(d, ast.Call) else d).lower() for d in node.decorator_list]
            tool = any(d in TOOL_DECORATORS or "tool" in d for d in decorators)
            asks = _any(lambda x: isinstance(x, (ast.Name, ast.Attribute)) and any(w in _last(x).lower() for w in CONFIRM), *node.body)
            emit([path], "func", node.lineno, node.end_lineno or 0, s1=node.name, refs=params, b1=tool, b2=asks)
            for p in every:
                emit(scopes, "name", node.lineno, s1=p, s2="param")
            hard = _any(lambda x: isinstance(x, ast.Constant) and isinstance(x.value, str) and bool(HARDENING.search(x.value)), *node.body)
            emit([path], "text", node.lineno, b1=hard)
        elif isinstance(node, ast.Assign):
            names = [x for t in node.targets for x in _targets(t)]
            top = node.value.value if isinstance(node.value, ast.Await) else node.value
            clean = isinstance(top, ast.Call) and _pair(top.func)[1] in SANITIZERS
            for x in names:
                emit(scopes, "assign", node.lineno, s1=x, refs=_refs(node.value), b1=_model_in(node.value), b2=clean, b3=_request_in(node.value))
        elif isinstance(node, ast.Call):
            calls += 1
            obj, meth = _pair(node.func)
            values = [*node.args, *[k.value for k in node.keywords]]
            first = node.args[0] if node.args else None
            emit(scopes, "call", node.lineno, node.end_lineno or 0, n1=calls, s1=obj, s2=meth, s3=_last(node.func.value) if isinstance(node.func, ast.Attribute) else "", refs=_refs(*values), refs2=_refs(first), kw=[*[k.arg for k in node.keywords if k.arg], *_flags(node)], b1=_is_model_call(node), b2=_model_in(*values), b3=_model_in(first))
            for i, v in enumerate(node.args):
                emit(scopes[-1:], "arg", node.lineno, n1=calls, n2=i, refs=_refs(v), b1=_model_in(v))
            for k in node.keywords:
                if k.arg:
                    emit(scopes[-1:], "arg", node.lineno, n1=calls, s1=k.arg, refs=_refs(k.value), b1=_model_in(k.value))
                    if meth.lower().endswith("tool") or meth in TOOL_DECORATORS:
                        if k.arg in TOOL_KEYS and isinstance(k.value, ast.Name):
                            emit([""], "tool", node.lineno, s1=k.value.id)
                        elif k.arg == "name" and (name := _text(k.value)):
                            emit([""], "tool", node.lineno, s1=name)
        elif isinstance(node, ast.Return) and node.value is not None:
            emit(scopes, "return", node.lineno, refs=_refs(node.value), b1=_model_in(node.value))
        elif isinstance(node, ast.While) and isinstance(node.test, ast.Constant) and bool(node.test.value):
            out = _any(lambda x: isinstance(x, (ast.Break, ast.Return)), *node.body)
            emit(scopes[-1:], "loop", node.lineno, node.end_lineno or 0, b1=_model_in(*node.body), b2=out)
        elif isinstance(node, ast.Dict):
            keys = {k.value: v for k, v in zip(node.keys, node.values, strict=True) if isinstance(k, ast.Constant) and isinstance(k.value, str)}
            role = keys.get("role")
            if isinstance(role, ast.Constant) and isinstance(role.value, str) and "content" in keys:
                emit(scopes, "dict", keys["content"].lineno, s1=role.value.lower(), refs=_refs(keys["content"]), b3=_request_in(keys["content"]))
            if TOOL_KEYS & keys.keys() or _text(keys.get("type")) in ("function", "tool"):
                for k in TOOL_KEYS & keys.keys():
                    if isinstance(keys[k], ast.Name):
                        emit([""], "tool", node.lineno, s1=keys[k].id)
                for k in TOOL_NAMES & keys.keys():
                    if name := _text(keys[k]):
                        emit([""], "tool", node.lineno, s1=name)
        elif isinstance(node, ast.Import):
            for x in node.names:
                emit([""], "import", node.lineno, n1=0, s1=x.name, s3=x.asname or x.name.split(".")[0])
        elif isinstance(node, ast.ImportFrom):
            for x in node.names:
                emit([""], "import", node.lineno, n1=node.level, s1=node.module or "", s2=x.name, s3=x.asname or x.name)
        elif isinstance(node, (ast.For, ast.AsyncFor, ast.comprehension)):
            for x in _targets(node.target):
                emit(scopes, "name", getattr(node, "lineno", 0), s1=x, s2="loop")
        if isinstance(node, ast.Name) and isinstance(node.ctx, ast.Store):
            emit(scopes, "name", node.lineno, s1=node.id, s2="store")
        for child in ast.iter_child_nodes(node):
            visit(child, scopes, path)

    try:
        visit(tree, [""], "")
    except RecursionError:
        return [("error", "", 0, 0, None, None, None, None, None, None, None, None, None, None, None)]
    return rows


#: What is still asked for once a file is solved.
OUTWARD = frozenset(["func", "call", "arg", "import", "tool", "error", "finding", "summary", "sink"])


def _outward(rows: list[tuple]) -> list[tuple]:
    """Without the facts that only matter within their file."""
    return [(*r[:9], None, None, None, *r[12:]) if r[0] in ("call", "arg") else r for r in rows if r[0] in OUTWARD]


def syntax_facts(files: DataFrame, suffixes: tuple[str, ...] | None = None, whole: bool = False) -> DataFrame:
    """The fact table of the files of ``files`` (file_id, suffix, text, and path if there is one) in Python or a language with
    braces, or of ``suffixes`` only; other files are left out. Unless ``whole`` only facts that others ask for are kept.
    """
    from riskweave.operators.brace_facts import LANGUAGES

    path = F.coalesce("path", F.lit("")) if "path" in files.columns else F.lit("")
    x = files.select("file_id", "text", path.alias("path"), F.lower("suffix").alias("suffix")).where(F.col("suffix").isin(*(suffixes or (".py", *LANGUAGES))) & F.col("text").isNotNull())

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from riskweave.operators.brace_facts import brace_facts_of

        for b in batches:
            ids, rows = [], []
            for i, (t, p, s) in enumerate(zip(*(b.column(k).to_pylist() for k in (1, 2, 3)), strict=True)):
                got = solve(facts_of(t), t, p) if s == ".py" else solve(brace_facts_of(LANGUAGES[s], t), t, p, BRACES)
                got = got if whole else _outward(got)
                rows += got
                ids += [i] * len(got)
            cols = list(zip(*rows, strict=True)) if rows else [()] * len(_KINDS)
            yield pa.RecordBatch.from_arrays([b.column(0).take(pa.array(ids, pa.int64())), *[pa.array(c, k) for c, k in zip(cols, _KINDS, strict=True)]], names=_NAMES)

    return spread(x).mapInArrow(run, SCHEMA.format(dict(x.dtypes)["file_id"]))


def python_facts(files: DataFrame, whole: bool = False) -> DataFrame:
    """The fact table of the Python files alone."""
    return syntax_facts(files, (".py",), whole)
