"""Problem 2: credentials embedded in source text, found and masked without moving any other character.

Unnatural strings are those a public subword vocabulary cannot compress: few characters per subword. Such a string is a
credential only with support from its context: the form of a key (short prefix and random body), the name it is assigned
to, the words before it, or its place in a connection address or header. Placeholders, references, names of settings,
hashes, ids and public keys are ruled out. Literals put together from neighbouring pieces are judged as one.
"""

from __future__ import annotations

import base64
import re
from collections.abc import Iterator
from functools import lru_cache

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from riskweave.llm.tokens import TOKENIZER_DIR, encoding
from riskweave.runtime import spread, table

#: A string with fewer characters per subword than this is unnatural.
UNNATURAL = 2.6
#: A spoken credential is sought in so many words after the word for a secret, and beyond them to the end of the sentence.
SPOKEN_WORDS = 6

_SECRET_WORD = r"pass(?:word|wd|phrase|code)?|pwd|secret|token|bearer|credentials?|login|auth(?:orization)?|api[_ -]?key|(?:access|private|signing|secret|service|encryption|account|license|shared|master|deploy|session)[_ -]?key"
_SECRET_NAME = re.compile(rf"(?i)(?:{_SECRET_WORD})(?![a-z])|(?i:apikey)|_pass\b")
_STEMS = ["pass", "pwd", "secret", "token", "bearer", "credential", "login", "auth", "key"]  # each secret word has one
_TO_LOWER = {i: i + 32 for i in range(65, 91)}
#: Names under which a random string is a hash, an id or public.
_OPEN_NAME = re.compile(r"(?i)(?:hash|digest|checksum|commit|revision|integrity|etag|fingerprint|signature|version|uuid|guid|(?:^|_)id|(?:^|_)sha\d*)$|(?:^|_)pub(?:_|$|key)|public|verify_")
_PUBLIC_NAME = re.compile(r"(?i)(?:^|_)pub(?:_|$|key)|public|verify_")
_PLACEHOLDER = re.compile(
    r"(?i)example|sample|dummy|fake|change[-_ ]?(?:me|it)|replace|insert|your[-_ ]|placeholder|not[-_ ]a|todo|redacted|masked|x{4,}|\*{3,}|0{6,}|\.{3,}|1234567|abcdef|^<.*>$|^\[.*\]$|^\{|^(?:none|null|true|false|undefined|password|secret|token|test)$"
)
_BLANKED = re.compile(r"(?i)x{4,}|\*{3,}|0{6,}|\.{3,}|^<.*>$")
_REFERENCE = re.compile(r"\$\{|\$\(|^\$[A-Za-z_]|\{\{|%\(|process\.env|environ|getenv|^env\.|^vault:|^ref:|^\{|^%[A-Z_]+%$|^@[A-Za-z]|\{[A-Za-z_][\w.]*\}")
_SETTING = re.compile(r"^[A-Z][A-Z0-9]*(?:_[A-Z0-9]+)+$")
_UUID = re.compile(r"(?i)^[0-9a-f]{8}-(?:[0-9a-f]{4}-){3}[0-9a-f]{12}$")
_HEX = re.compile(r"(?i)^[0-9a-f]{16,}$")
_KEY_FORM = re.compile(r"^(?:(?:[A-Za-z]{2,10}\d?[-_.])(?:[a-z]{2,8}[-_.])?[A-Za-z0-9_-]{14,}|eyJ[\w-]{6,}\.[\w-]{8,}\.[\w-]{8,}|A[KS]IA[A-Z0-9]{16}|AIza[\w-]{30,})$")
_PASSPHRASE = re.compile(r"^(?=(?:.*[A-Za-z]){5})(?=(?:.*\d){2})(?=.*[!#%*+?&^~@$=]).{9,64}$")

_URL = re.compile(r"""[A-Za-z][A-Za-z0-9+.-]{1,19}://([^\s/:@'"`<>]*):([^\s/@'"`<>]{3,})@""")
_HEADER = re.compile(r"""\b([Bb]asic|[Bb]earer|[Tt]oken)[ \t]+([A-Za-z0-9+/=._~!#%*?-]{8,})""")
_CURL = re.compile(r"""(?:\s-u|--user)[ =]["']?([\w.-]+):([^\s"'@]{4,})""")
_PEM = re.compile(r"-----BEGIN (?:[A-Z0-9]+ )*PRIVATE KEY(?: BLOCK)?-----")
_PEM_BODY = re.compile(r"""(?:\\[nr]|["'`\s+,()\\#*>|-])*([A-Za-z0-9+/=]{16,})""")
#: A further line of a key: a long one by itself, or a short last one.
_PEM_MORE = re.compile(r"""(?:\\[nr]|["'`\s+,()\\#*>|-])*(?:[A-Za-z0-9+/=]{16,}+|(?:(?=[A-Za-z/+]*\d)[A-Za-z0-9+/]+=*|[A-Za-z0-9+/]*=+|[A-Za-z0-9+/]+(?=(?:\\[nr]|["'`\s+,()\\#*>|])*-----END))(?![\w+/=]))(?=[ \t]*(?:["'`\\\r\n]|-----|$))""")
_PEM_END = re.compile(r"-----END[A-Z0-9 ]*-----")
# name, separator, value; a type annotation or a closing bracket may stand between
_ASSIGN = re.compile(
    r"""([A-Za-z_][\w.-]*)["'`]?\]?[ \t]*(?::[ \t]*(?:str|string|String|any|&str|Optional\[str\])[ \t]*)?(?::=|=>|=(?!=)|:(?![:=/]))[ \t]*(?:\([ \t]*)?(?:[rbuf]{0,2}(?P<q>["'`])(?P<v>(?:(?!(?P=q))[^\\\n]|\\.)*)(?P=q)|(?P<b>[^\s"'`,;(){}\[\]]+))"""
)
_SEAM = re.compile(r"""[ \t]*(?:[+.\\]|\.\.)?[ \t]*\\?(?:\r?\n[ \t]*(?:[+.][ \t]*)?)?[rbuf]{0,2}(["'`])((?:(?!\1)[^\\\n]|\\.)*)\1""")
_PLUS = re.compile(r"""(?<=[\w=+/:@!?#%*-])["'`](?:[ \t]*\+[ \t]*(?:\r?\n[ \t]*)?|[ \t]*\\?\r?\n[ \t]*\+?[ \t]*|[ \t]+)["'`](?=[\w=+/:@!?#%*-])""")
_RANDOM = re.compile(r"(?<![\w+/.\\-])[A-Za-z][\w+/.-]{17,}={0,2}")
_LIST = re.compile(r"""(?:""|''|``)\.join\([ \t]*[\[(]|[=:(,][ \t]*(\[)(?=[ \t\r\n]*[rbuf]{0,2}["'`])""")
_LIST_END = re.compile(r"""\][ \t\r\n]*\.join\((?:""|''|``)\)""")
_LIST_ITEM = re.compile(r"""[ \t\r\n]*[rbuf]{0,2}(["'`])((?:(?!\1)[^\\\n]|\\.)*)\1[ \t\r\n]*,?""")
_LOGIN = re.compile(r"^[\w.@-]{2,40}:[!-~]{6,60}$")
_BEFORE = re.compile(r"""([A-Za-z_][\w-]*)["'`]?[ \t]*(?::[ \t]*\w+[ \t]*)?(?::=|=>|[:=])[ \t(]*["'`]?$""")
_SPOKEN = re.compile(rf"(?i)(?:{_SECRET_WORD})(?![\w])|\b\w+_(?:{_SECRET_WORD})(?!\w)")
_COMMENT = re.compile(r"(?:^|[\s;{}(),])(?:#|//|--|/\*|\*|;|<!--)\s?|^\s*[>*-] ")
_PIECE = re.compile(r"\S+")


@lru_cache(maxsize=200_000)
def chars_per_subword(s: str, tokenizer_dir: str = TOKENIZER_DIR) -> float:
    """Length over number of subwords; the smaller, the less like language or identifiers."""
    return len(s) / max(1, len(encoding(tokenizer_dir).encode_ordinary(s)))


def _random_like(v: str) -> bool:
    """Several kinds of characters and few characters a subword."""
    digits = sum(map(str.isdigit, v))
    kinds = (digits > 0) + any(map(str.islower, v)) + any(map(str.isupper, v))
    mixed = kinds == 3 or kinds == 2 and digits >= 4 and len(v) >= 20 and not re.search(r"[_.-]", v)
    return mixed and len(set(v)) >= 8 and chars_per_subword(v) < UNNATURAL


def _ruled_out(v: str) -> bool:
    """Placeholders and references; the words of placeholders do not count in a value built like a password."""
    if len(v) < 6 or len(set(v)) < 5 or _REFERENCE.search(v):
        return True
    return bool((_BLANKED if _PASSPHRASE.match(v) else _PLACEHOLDER).search(v))


def _key_form(v: str) -> bool:
    """A key known by its form alone, whatever its name."""
    if _ruled_out(v) or "--" in v or v.startswith(("sha1-", "sha256-", "sha512-")) or not _KEY_FORM.match(v):
        return False
    if v.startswith(("AKIA", "ASIA")):
        return chars_per_subword(v) < UNNATURAL
    if v.startswith("eyJ"):
        return _random_like(v.replace(".", ""))
    run = max(re.findall(r"[A-Za-z0-9]+", _body(v)), key=len, default="")
    return len(run) >= 12 and any(map(str.isdigit, run)) and any(map(str.islower, run)) and any(map(str.isupper, run)) and _random_like(_body(v))


def _pieced(v: str) -> bool:
    """A string put together from pieces that no language or table of data explains."""
    return _key_form(v) or len(v) >= 20 and not _ruled_out(v) and bool(re.fullmatch(r"[\w+/=.-]+", v)) and _random_like(v) and bool(re.search(r"[A-Za-z0-9+/]{16,}", v))


def _encoded_login(v: str) -> bool:
    """Base64 of ``name:password``."""
    if len(v) % 4 or len(v) < 20 or "." in v or "-" in v or "_" in v:
        return False
    try:
        return bool(_LOGIN.match(base64.b64decode(v, validate=True).decode("ascii")))
    except ValueError:
        return False


def _body(v: str) -> str:
    """The part of a key after its prefix."""
    if v.startswith(("eyJ", "AKIA", "ASIA", "AIza")):
        return v
    cut = max(v.find(c) for c in "-_.")
    m = re.match(r"^[A-Za-z]{2,10}\d?[-_.](?:[a-z]{2,8}[-_.])?", v)
    return v[m.end() :] if m and cut >= 0 else v


def _named_value(v: str) -> bool:
    """A literal value that is a credential under a name that says so."""
    if _ruled_out(v) or _SETTING.match(v) or _UUID.match(v) or any(c.isspace() for c in v) or v.startswith(("sha1-", "sha256-", "sha512-", "-----BEGIN")):
        return False
    if "://" in v or v.startswith(("./", "http")) or v.startswith("/") and chars_per_subword(v) >= UNNATURAL:
        return False
    return bool(_HEX.match(v)) and chars_per_subword(v) < UNNATURAL or bool(_PASSPHRASE.match(v)) or _key_form(v) or len(v) >= 12 and _random_like(v)


def _spoken_value(v: str) -> bool:
    """A word of running text that is a credential when secrets are being spoken of."""
    if len(v) < 9 or _ruled_out(v) or _SETTING.match(v) or _UUID.match(v) or "://" in v or "(" in v:
        return False
    return bool(_HEX.match(v)) or bool(_PASSPHRASE.match(v)) and not re.search(r"[=]", v[:-2]) or _key_form(v) or len(v) >= 14 and any(map(str.isdigit, v)) and bool(re.fullmatch(r"[\w+/=.-]+", v)) and _random_like(v)


def _joined(text: str, end: int, first: str) -> tuple[str, int]:
    """A literal that ends at ``end`` together with the literals concatenated to it."""
    out = first
    while m := _SEAM.match(text, end):
        out += m[2]
        end = m.end()
    return out, end


def _speaking_lines(text: str) -> list[tuple[int, int]]:
    """(start, end) of the lines on which a name or a word speaks of secrets; plain substrings lead to them."""
    low, got = text.lower(), set()
    if len(low) != len(text):
        low = text.translate(_TO_LOWER)
    for stem in _STEMS:
        at = low.find(stem)
        while at >= 0:
            a = low.rfind("\n", 0, at) + 1
            b = low.find("\n", at)
            b = len(low) if b < 0 else b
            got.add((a, b))
            at = low.find(stem, b)
    return [x for x in sorted(got) if _SECRET_NAME.search(text, *x)]


def find_credentials(text: str | None) -> list[tuple[int, int, str]]:
    """(start, end, kind) of every credential, in order, not overlapping; null and empty texts have none."""
    if not text:
        return []
    got: list[tuple[int, int, str]] = []
    add = lambda a, b, kind: got.append((a, b, kind))
    if "://" in text:
        for m in _URL.finditer(text):
            if not _ruled_out(m[2]) and not _SETTING.match(m[2]) and not m[2].startswith("$"):
                add(m.start(2), m.end(2), "address")
    low = "asic " in text or "earer " in text or "oken " in text
    if low:
        for m in _HEADER.finditer(text):
            v = m[2]
            if not _ruled_out(v) and (len(v) >= 12 and _random_like(v.rstrip("=")) or _PASSPHRASE.match(v)) and not (m[1][0] in "tT" and not _key_form(v)):
                add(m.start(2), m.end(2), "header")
    if " -u" in text or "--user" in text:
        for m in _CURL.finditer(text):
            if not _ruled_out(m[2]) and not _SETTING.match(m[2]):
                add(m.start(2), m.end(2), "header")
    if "PRIVATE KEY" in text:
        for m in _PEM.finditer(text):
            b = _PEM_BODY.match(text, m.end())
            if b and not _ruled_out(b[1]) and chars_per_subword(b[1]) < UNNATURAL:
                last = b.end()
                while more := _PEM_MORE.match(text, last):
                    last = more.end()
                # the end of the block may stand behind lines of another form, but not far off
                end = text.find("-----END", b.end(), max(last + 200, b.end() + 8000))
                stop = _PEM_END.match(text, end) if end >= 0 else None
                add(m.start(), stop.end() if stop else last, "private key")
    lines = _speaking_lines(text)
    for a, b in lines:
        for m in _ASSIGN.finditer(text, a, b):
            name, v = m[1], m["v"]
            if not _SECRET_NAME.search(name) or _OPEN_NAME.search(name):
                continue
            if v is not None:
                end = m.end()
                if text[end : end + 1] in " +.\\\r\n\t\"'`":
                    v, end = _joined(text, end, v)
                if _named_value(v):
                    add(m.start("v"), end - 1, "assignment")
            elif re.fullmatch(r"[\s-]*(?:export\s+|set\s+|ENV\s+|[>#*-]\s*)*", text[a : m.start(1)]) and _named_value(m["b"]):
                # a bare word is a value in settings only: nothing but the name and, perhaps, a keyword before it
                add(m.start("b"), m.end("b"), "setting")
    done = 0
    for m in _PLUS.finditer(text):
        q = text[m.start()]
        a = text.rfind(q, text.rfind("\n", 0, m.start()) + 1, m.start())
        if a < done:
            continue
        v, done = _joined(text, m.start() + 1, text[a + 1 : m.start()])
        u = _URL.search(v) if "://" in v else None
        if u and not _ruled_out(u[2]) and not _SETTING.match(u[2]):
            add(a + 1, done - 1, "address")
        elif len(v) >= 18 and _pieced(v):
            named = _BEFORE.search(text[text.rfind("\n", 0, a) + 1 : a + 1])
            if not (named and _PUBLIC_NAME.search(named[1])):
                add(a + 1, done - 1, "key")
    if ".join(" in text:
        for m in _LIST.finditer(text):
            end, pieces = m.end(), []
            while p := _LIST_ITEM.match(text, end):
                pieces.append(p)
                end = p.end()
            if m[1] and not _LIST_END.match(text, max(0, text.find("]", end))):
                continue
            v = "".join(p[2] for p in pieces)
            named = _BEFORE.search(text[text.rfind("\n", 0, m.start()) + 1 : m.start() + (text[m.start()] in "=:(,")])
            if len(pieces) > 1 and not (named and _PUBLIC_NAME.search(named[1])) and (_pieced(v) or named and _SECRET_NAME.search(named[1]) and _named_value(v)):
                add(pieces[0].start(2), pieces[-1].end(2), "key")
    for m in _RANDOM.finditer(text):
        v = m[0].rstrip(".=") if m[0].startswith("eyJ") else m[0].rstrip(".")
        if any(map(str.isdigit, v)) or v.startswith(("AKIA", "ASIA")):
            if _key_form(v) or _encoded_login(v):
                a = text.rfind("\n", 0, m.start()) + 1
                named = _BEFORE.search(text[a : m.start()])
                if not (named and _PUBLIC_NAME.search(named[1])) and not _data_row(text, a, m.start(), m.end()):
                    add(m.start(), m.start() + len(v), "key")
    for a, b in lines:
        bare = 0  # up to here the sentence is known to hold no value
        for m in _SPOKEN.finditer(text, a, b):
            if not _spoken_place(text, a, m.start()):
                continue
            stopped = m.end() < bare
            for k, p in enumerate(_PIECE.finditer(text, m.end(), b)):
                if k >= SPOKEN_WORDS and stopped:
                    break
                v = p[0].strip("\"'`,;:()[]<>{}")
                stopped |= v.endswith((".", "!", "?"))
                v = v.rstrip(".")
                if _spoken_value(v):
                    at = p.start() + p[0].find(v)
                    add(at, at + len(v), "spoken")
                    break
                bare = max(bare, p.end())
    got.sort(key=lambda x: (x[0], -x[1]))
    out: list[tuple[int, int, str]] = []
    for g in got:
        if out and g[0] < out[-1][1]:
            continue
        out.append(g)
    return out


def _spoken_place(text: str, a: int, at: int) -> bool:
    """Whether ``at``, on the line that starts at ``a``, lies in a comment, in a literal or in plain running text."""
    before = text[a:at]
    if _COMMENT.search(before):
        return True
    if any(before.count(q) % 2 for q in "\"'`"):
        return True
    return not re.search(r"[=({;]", before) and len(before.split()) >= 2


def _data_row(text: str, a: int, start: int, end: int) -> bool:
    """Whether a random string is an entry of a table of data: nothing on the line but literals and commas."""
    b = text.find("\n", end)
    line = text[a : len(text) if b < 0 else b].strip()
    return bool(re.fullmatch(r"""(?:["'][^"']*["'],?\s*)+""", line)) and line.endswith(",")


def mask(text: str | None, places: list[tuple[int, int, str]]) -> str | None:
    """``text`` with every place overwritten by ``*``; line breaks and quotes within a place stay, and so do all offsets."""
    if not text or not places:
        return text
    out, last = [], 0
    for a, b, _ in places:
        out += [text[last:a], re.sub(r"""[^\s"'`+\\]""", "*", text[a:b])]
        last = b
    return "".join([*out, text[last:]])


def scan(df: DataFrame, ident: str, column: str, redact: bool = False) -> DataFrame:
    """(id, line_no, start, stop, kind[, masked]): one row a credential of ``column``; offsets count characters from 0.

    With ``redact`` there is one row a text that holds credentials, with the masked text. Rows with a null id are kept.
    """
    x = df.select(F.col(ident).alias("id"), F.col(column).alias("text"))
    kind = dict(x.dtypes)["id"]
    schema = f"id {kind}, masked string" if redact else f"id {kind}, line_no int, start int, stop int, kind string"

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            ids, rows = b.column(0), []
            for i, t in enumerate(b.column(1).to_pylist()):
                places = find_credentials(t)
                if places and redact:
                    rows.append((i, mask(t, places)))
                elif places:
                    line, at = 1, 0
                    for s, e, k in places:
                        line += t.count("\n", at, s)
                        at = s
                        rows.append((i, line, s, e, k))
            c = list(zip(*rows, strict=True)) if rows else [()] * (2 if redact else 5)
            first = ids.take(pa.array(c[0], pa.int64()))
            if redact:
                yield pa.RecordBatch.from_arrays([first, pa.array(c[1], pa.string())], names=["id", "masked"])
            else:
                yield pa.RecordBatch.from_arrays([first, *[pa.array(c[k], pa.int32()) for k in (1, 2, 3)], pa.array(c[4], pa.string())], names=["id", "line_no", "start", "stop", "kind"])

    return x.mapInArrow(run, schema)


def _both(spark: SparkSession, d: str, redact: bool) -> DataFrame:
    # equal deliveries of a finding are scanned once: the narrow (id, evidence) pairs are made distinct first
    f = table(spark, d, "findings", "finding_id", "evidence").distinct()
    a = scan(spread(table(spark, d, "files", "file_id", "text")), "file_id", "text", redact).select(F.lit("file").alias("holder"), "*")
    b = scan(f, "finding_id", "evidence", redact).select(F.lit("finding").alias("holder"), "*")
    return a.unionByName(b).withColumnRenamed("id", "holder_id")


def p2_places(spark: SparkSession, d: str) -> DataFrame:
    """Every credential with its place."""
    return _both(spark, d, False).distinct()


def p2_found(spark: SparkSession, d: str) -> DataFrame:
    return _both(spark, d, False).select("holder", "holder_id", "line_no").distinct()


def p2_redacted(spark: SparkSession, d: str) -> DataFrame:
    """The texts that hold credentials, masked."""
    return _both(spark, d, True)


QUERIES = {"p2_found": p2_found, "p2_places": p2_places, "p2_redacted": p2_redacted}
ORACLE: dict = {}
