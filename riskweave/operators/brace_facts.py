"""Facts of files in languages with braces, read from their tokens: JavaScript, TypeScript, Go, Java, Kotlin, C#, PHP, Rust.

The rows are those of ``facts``, so that ``dataflow`` solves all languages alike. There is no full parser: tokens, matched
brackets and the ends of statements are enough to tell functions with their parameters, assignments, calls with their
arguments, returns and messages. What cannot be told is left out.
"""

from __future__ import annotations

import re
from bisect import bisect_left, bisect_right
from dataclasses import dataclass

from riskweave.operators.facts import CONFIRM, HARDENING

_TOKEN = re.compile(
    r"""(?P<skip>//[^\n]*|/\*(?:[^*]|\*(?!/))*\*/|[ \t\r\f]+)|(?P<nl>\n)|(?P<str>"{3}(?:[^"]|"(?!""))*"{3}|[$@]*"(?:[^"\\\n]|\\.)*"|'(?:[^'\\\n]|\\.)*'|`(?:[^`\\]|\\.)*`)|(?P<num>\d[\w.]*)|(?P<id>[$@]?[^\W\d]\w*)|(?P<op>=>|:=|\?\.|->|::|[-+*/%&|^.]=|[=!<>]=+|&&|\|\||\?\?|\.\.\.|.)""",
    re.S,
)
_OPENS, _CLOSES = "([{", ")]}"
_HOLE = re.compile(r"\$\{([^{}]*)\}|\{([^{}\"]*)\}|\$(\w+)")
_NAME = re.compile(r"(?<![\w.])[^\W\d]\w*")

# Words by suffix that begin a function, and words that never name a call.
LANGUAGES = {".js": "js", ".jsx": "js", ".ts": "js", ".tsx": "js", ".go": "go", ".java": "java", ".kt": "kotlin", ".cs": "csharp", ".php": "php", ".rs": "rust"}
FUNCTION_WORD = {"go": "func", "kotlin": "fun", "php": "function", "rust": "fn"}
NO_CALL = frozenset("if for while switch catch return with using lock foreach match synchronized when elseif fn func fun function new await typeof sizeof else do in of is as throw async yield and or not".split())
DECLARES = frozenset("const let var val mut final auto public private protected static readonly".split())
MODEL_CALLS = frozenset("create generate complete chat invoke predict stream generatecontent generatetext streamtext createchatcompletion createcompletion createchatcompletionstream createmessage generatefromsingleprompt completechat completechatasync sendmessage chatcompletion".split())
GATED_CALLS = frozenset("run query call ask respond send execute".split())
MODEL_RECEIVER = re.compile(r"(?i)(llm|chain|agent|chat|openai|anthropic|gemini|bedrock|ollama|groq|cohere|mistral|queryengine|conversation|\brag\b|\bqa\b|assistant|completion|messages|responses|\bmodel)")
SANITIZERS = frozenset("rendertostring rendertostaticmarkup sanitize purify escape escapehtml encodeuri encodeuricomponent striptags dompurify escapestring htmlescapestring queryescape quote marshal pathescape htmlspecialchars htmlentities escapeshellarg htmlencode stringify".split())
SANITIZER_NAME = re.compile(r"(?i)^(escape|sanitize|htmlescape)")
REQUEST_ROOTS = frozenset(["req", "request", "$_get", "$_post", "$_request"])
SCRIPT_ROOTS = REQUEST_ROOTS | {"ctx"}
MARKUP = frozenset(["innerHTML", "outerHTML", "dangerouslySetInnerHTML"])


@dataclass
class Function:
    name: str
    params: list[str]
    line: int
    end: int
    body: tuple[int, int]
    scope: str = ""
    tool: bool = False


class Source:
    """The tokens of a text, with matched brackets."""

    def __init__(self, lang: str, text: str):
        self.lang = lang
        self.kind: list[str] = []
        self.text: list[str] = []
        self.line: list[int] = []
        self.first: list[bool] = []  # first token of its line
        line, fresh = 1, True
        for m in _TOKEN.finditer(text):
            if m.lastgroup not in ("skip", "nl"):
                self.kind.append(m.lastgroup)
                self.text.append(m[0])
                self.line.append(line)
                self.first.append(fresh)
                fresh = False
            n = m[0].count("\n")
            line += n
            fresh |= n > 0
        self.match: dict[int, int] = {}
        stack: list[int] = []
        for i, t in enumerate(self.text):
            if self.kind[i] == "op":
                if t in _OPENS:
                    stack.append(i)
                elif t in _CLOSES and stack and _OPENS.index(self.text[stack[-1]]) == _CLOSES.index(t):
                    j = stack.pop()
                    self.match[i], self.match[j] = j, i
        self.size = len(self.text)

    def at(self, i: int) -> str:
        return self.text[i] if 0 <= i < self.size else ""

    def is_id(self, i: int) -> bool:
        return 0 <= i < self.size and self.kind[i] == "id"

    def member(self, i: int) -> bool:
        """Whether token i is a member of something before it."""
        return self.at(i - 1) in (".", "?.", "->", "::")

    def refs(self, a: int, b: int) -> list[str]:
        """Names read between two tokens, those within strings with holes included; keys and members are none."""
        out = set()
        for i in range(a, b):
            if self.kind[i] == "id":
                if not self.member(i) and not (self.at(i + 1) == ":" and self.at(i - 1) in ("{", ",")):
                    out.add(self.text[i])
            elif self.kind[i] == "str" and ("{" in self.text[i] or "$" in self.text[i]):
                for m in _HOLE.finditer(self.text[i]):
                    out.update(_NAME.findall(m[1] or m[2] or ""))
                    if m[3]:
                        out.update([m[3], "$" + m[3]])
        return sorted(out)

    def end(self, i: int) -> int:
        """The token behind the expression that starts at i: a semicolon or comma, a bracket that closes what is around it,
        or a line that doesn't go on."""
        while i < self.size:
            t = self.at(i)
            if self.kind[i] == "op" and t in (";", ",", ")", "]", "}"):
                return i
            if self.first[i] and i and self.lang in ("js", "go", "kotlin") and not (self.kind[i] == "op" and t not in ("{", "(", "[", "!", "@")) and (self.kind[i - 1] != "op" or self.at(i - 1) in (")", "]", "}")):
                return i
            i = self.match[i] + 1 if self.kind[i] == "op" and t in _OPENS and i in self.match else i + 1
        return i

    def split(self, a: int, b: int) -> list[tuple[int, int]]:
        """The parts between two tokens, cut at commas outside brackets."""
        out, at, i = [], a, a
        while i < b:
            if self.at(i) == "," and self.kind[i] == "op":
                out.append((at, i))
                at = i + 1
            i = self.match[i] + 1 if self.kind[i] == "op" and self.at(i) in _OPENS and i in self.match else i + 1
        return [*out, (at, b)] if at < b else out

    def parameter(self, a: int, b: int) -> str:
        """The name of the parameter between two tokens."""
        ids = [i for i in range(a, b) if self.kind[i] == "id" and self.text[i] not in DECLARES]
        stop = next((i for i in range(a, b) if self.at(i) in ("=", ":") and self.kind[i] == "op"), b)
        before = [i for i in ids if i < stop]
        if not before:
            return ""
        pick = before[-1] if self.lang in ("java", "csharp", "php") or self.lang in ("rust", "kotlin") else before[0]
        return "" if self.text[pick] in ("self", "this") else self.text[pick]

    def functions(self) -> list[Function]:
        out = []
        word = FUNCTION_WORD.get(self.lang)
        for i in range(self.size):
            if self.at(i) != "(" or self.kind[i] != "op" or i not in self.match:
                continue
            j = self.match[i]
            name, p = "", i - 1
            if self.at(p) == ">":  # type parameters
                while p > 0 and self.at(p) != "<":
                    p -= 1
                p -= 1
            arrow = self.at(j + 1) == "=>" or self.lang == "js" and self.at(j + 1) == ":" and any(self.at(k) == "=>" for k in range(j + 2, min(j + 12, self.size)))
            if self.is_id(p) and self.text[p] not in NO_CALL and not arrow:
                if self.at(p - 1) in ("new", ".", "?.", "->", "::", "=", "return", "await") or word and self.at(p - 1) != word and not (self.lang == "go" and self.at(p - 1) == ")" and self.at(self.match.get(p - 1, 0) - 1) == "func"):
                    continue
                name = self.text[p]
            elif arrow or self.at(p) in ("function", "async"):
                k = p - 1 if self.at(p) in ("async", "function") else p
                k -= self.at(k) == "async"
                if self.at(k) in ("=", ":") and self.is_id(k - 1):
                    name = self.text[k - 1]
            else:
                continue
            k = j + 1
            steps = 0
            while k < self.size and steps < 40 and self.at(k) not in ("{", ";", "}", "=", "=>") and self.at(k) != ")":
                k = self.match[k] + 1 if self.at(k) in ("(", "[") and k in self.match else k + 1
                steps += 1
            if self.at(k) == "=>" and self.at(k + 1) == "{":
                k += 1
            if self.at(k) == "{" and k in self.match:
                body = (k + 1, self.match[k])
            elif self.at(k) == "=>":
                body = (k + 1, self.end(k + 1))
            else:
                continue
            params = [x for x in (self.parameter(a, b) for a, b in self.split(i + 1, j)) if x]
            deco = self.line[i]
            tool = any("tool" in self.text[q].lower() for q in range(max(0, i - 14), i) if self.kind[q] == "id" and (self.at(q).startswith("@") or self.at(q - 1) == "[" and self.at(q - 2) in ("#", "}", ";", "{", "")))
            out.append(Function(name, params, deco, self.line[min(body[1], self.size - 1)], body, tool=tool))
        return out


def _call(s: Source, i: int) -> tuple[list[str], int]:
    """The chain of names that ends at token i, and its first token."""
    names, first = [s.text[i]], i
    while s.member(first):
        p = first - 2
        while s.at(p) in (")", "]") and p in s.match:
            p = s.match[p] - 1
        if not s.is_id(p):
            break
        names.insert(0, s.text[p])
        first = p
    return names, first


def is_model_call(names: list[str]) -> bool:
    n = names[-1].lower()
    receiver = " ".join(names[:-1])
    if n in ("create", "new", "call", "run", "query", "stream", "send", "execute", "ask", "respond", "chat", "complete", "generate", "predict", "invoke"):
        return bool(MODEL_RECEIVER.search(receiver)) if n in GATED_CALLS or n in ("create", "new", "stream") else len(names) > 1
    return n in MODEL_CALLS


def brace_facts_of(lang: str, text: str | None) -> list[tuple]:
    """Fact rows of one file; null and blank texts have none."""
    if not text or not text.strip():
        return []
    s = Source(lang, text)
    fns = s.functions()
    # functions by where their bodies begin, each with the chain of scopes around and within it
    fns.sort(key=lambda f: (f.body[0], -f.body[1]))
    starts, chains_of, around, stack = [f.body[0] for f in fns], [], [], []
    for n, f in enumerate(fns):
        while stack and fns[stack[-1]].body[1] <= f.body[0]:
            stack.pop()
        outer = chains_of[stack[-1]] if stack else [""]
        name = f.name or f"<{f.line}>"
        f.scope = f"{outer[-1]}.{name}" if outer[-1] else name
        chains_of.append([*outer, f.scope])
        around.append(stack[-1] if stack else -1)
        stack.append(n)
    rows: list[tuple] = []

    def scopes(i: int) -> list[str]:
        """The scopes around token i, the file's first."""
        n = bisect_right(starts, i) - 1
        while n >= 0 and fns[n].body[1] <= i:
            n = around[n]
        return chains_of[n] if n >= 0 else [""]

    def emit(where, tag, line, end=0, n1=None, n2=None, s1=None, s2=None, s3=None, refs=None, refs2=None, kw=None, b1=None, b2=None, b3=None):
        rows.extend((tag, x, line, end, n1, n2, s1, s2, s3, refs, refs2, kw, b1, b2, b3) for x in where)

    heads = {f.body[0]: f for f in fns}
    calls = [i for i in range(s.size) if s.is_id(i) and s.at(i + 1) == "(" and i + 1 in s.match and (s.text[i] not in NO_CALL or s.member(i))]
    defined = {f.name for f in fns}
    chains = {i: _call(s, i) for i in calls}
    model_at = [i for i in calls if is_model_call(chains[i][0])]
    model = lambda a, b: bisect_left(model_at, a) < bisect_left(model_at, b)
    by_start: dict[int, list[int]] = {}
    for c, (_, k) in chains.items():
        by_start.setdefault(k, []).append(c)
    asks = lambda a, b: any(s.kind[i] == "id" and any(w in s.text[i].lower() for w in CONFIRM) for i in range(a, b))
    roots = SCRIPT_ROOTS if lang == "js" else REQUEST_ROOTS
    asked = lambda a, b: any(s.kind[i] == "id" and s.text[i].lower() in roots and not s.member(i) for i in range(a, b))
    for f in heads.values():
        emit([f.scope], "func", f.line, f.end, s1=f.name, refs=f.params, b1=f.tool, b2=asks(*f.body))
        for p in f.params:
            emit(scopes(f.body[0]), "name", f.line, s1=p, s2="param")
        emit([f.scope], "text", f.line, b1=any(s.kind[i] == "str" and bool(HARDENING.search(s.text[i])) for i in range(*f.body)))
        if s.at(f.body[0] - 1) == "=>":
            emit(scopes(f.body[0]), "return", f.line, refs=s.refs(*f.body), b1=model(*f.body))
    number = 0
    for i in range(s.size):
        t = s.text[i]
        if s.kind[i] == "op" and t in ("=", ":=", "+=", ".=") and s.at(i + 1) != ">":
            b = s.end(i + 1)
            refs, made = s.refs(i + 1, b), model(i + 1, b)
            if s.is_id(i - 1) and s.text[i - 1] in MARKUP and s.member(i - 1):
                number += 1
                emit(scopes(i), "call", s.line[i], s.line[i], n1=number, s1=s.at(i - 3), s2=s.text[i - 1], s3=s.at(i - 3), refs=refs, refs2=refs, kw=[], b1=False, b2=made, b3=made)
                continue
            a = i - 1
            while a >= 0 and not (s.kind[a] == "op" and s.at(a) in (";", "{", "}", "(") and not (s.at(a) in ("}", ")") and a in s.match and a == i - 1)) and s.line[a] == s.line[i] and i - a < 24:
                a = s.match[a] - 1 if s.at(a) in ("}", ")", "]") and a in s.match else a - 1
            head = [k for k in range(a + 1, i) if s.kind[k] == "id" and s.text[k] not in DECLARES and not s.member(k)]
            if s.at(a + 1) in DECLARES or s.lang == "go" or s.at(i - 1) in ("}", "]", ")"):
                colon = next((k for k in range(a + 1, i) if s.at(k) == ":" and s.at(i - 1) != "}"), i)
                names = [s.text[k] for k in head if k < colon]
            else:
                names = [s.text[i - 1]] if s.is_id(i - 1) and not s.member(i - 1) else [s.text[head[0]]] if head and s.at(a + 2) == ":" else []
            k = i + 1 + (s.at(i + 1) == "await")
            top = next((c for c in by_start.get(k, ()) if s.match[c + 1] + 1 >= b), None)
            clean = top is not None and (s.text[top].lower() in SANITIZERS or bool(SANITIZER_NAME.match(s.text[top])) or chains[top][0][-2:] == ["JSON", "parse"])
            for x in names:
                emit(scopes(i), "name", s.line[i], s1=x, s2="store")
                emit(scopes(i), "assign", s.line[i], s1=x, refs=refs, b1=made, b2=clean, b3=asked(i + 1, b))
        elif i in chains:
            number += 1
            a, b = i + 2, s.match[i + 1]
            names, _ = chains[i]
            if s.at(b + 1) == "{" and s.text[i] in defined and b + 2 in heads:
                continue  # a definition
            args = s.split(a, b)
            keys = [s.text[k].strip("'\"`") for k in range(a, b) if s.at(k + 1) == ":" and s.kind[k] in ("id", "str")] + [s.text[k] for k in range(a, b) if s.kind[k] == "id" and s.at(k + 1) in (",", "}") and s.at(k - 1) in ("{", ",")]
            first = args[0] if args else (a, a)
            obj = names[-2] if len(names) > 1 else ""
            emit(scopes(i), "call", s.line[i], s.line[b], n1=number, s1=obj, s2=names[-1], s3=obj, refs=s.refs(a, b), refs2=s.refs(*first), kw=[*keys, "chain=" + ".".join(names)], b1=i in model_at, b2=model(a, b), b3=model(*first))
            for n, (x, y) in enumerate(args):
                emit(scopes(i)[-1:], "arg", s.line[i], n1=number, n2=n, refs=s.refs(x, y), b1=model(x, y))
        elif t == "return" and s.kind[i] == "id":
            b = s.end(i + 1)
            emit(scopes(i), "return", s.line[i], refs=s.refs(i + 1, b), b1=model(i + 1, b))
        elif t == "{" and i in s.match:
            parts = {s.text[x].strip("'\"`"): (x + 2, y) for x, y in s.split(i + 1, s.match[i]) if s.at(x + 1) == ":"}
            role = {k.lower(): v for k, v in parts.items()}
            if "role" in role and "content" in role and role["role"][0] < s.size:
                a, b = role["content"]
                emit(scopes(i), "dict", s.line[min(a, s.size - 1)], s1=s.text[role["role"][0]].strip("'\"`").lower(), refs=s.refs(a, b), b3=asked(a, b))
    return rows
