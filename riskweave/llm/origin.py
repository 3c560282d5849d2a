"""Problem 1: generated, minified, vendored and data files among source files.

Every file is reduced to its token pattern: comments go, strings, numbers and identifiers become one symbol each, keywords
and punctuation stay. A word is such a symbol with the punctuation behind it; the distinct shingles of five words are
clustered by MinHash banding, and every link is verified by the exact Jaccard overlap of the shingle sets. Files with the
same shingle set form one class before banding, and within a band bucket members are linked to a few centres at a time;
members of the bucket that no chain of links joins yet are then compared with each other, so a bucket of one family doesn't
emit all its pairs and no two classes above the threshold and in a common bucket end in different clusters.

What a file is follows from its cluster:

* literals and separators only: a blob of **data**;
* a cluster over several repositories, most of whose members declare to be a copy: its members that share their very lines
  with other repositories, names included, are **vendored**, whether they declare it or not;
* a family, the members of a cluster within one repository, whose stock of patterns is small for its length, be it by many
  alike files or by files that repeat one template over and over, or a cluster most of whose members declare it: the output
  of a tool, **generated**.

A file no cluster explains is judged by what can be seen on it alone: the name of a lock file, the layout of a minified one,
a declaration, and the exact share of an upstream's lines it holds, as a copy inside a larger file overlaps too little with
its original to cluster with it.
"""

from __future__ import annotations

import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from riskweave.runtime import broadcast_if_small, cut, drop, spread, table

#: 14 bands of 8 rows meet a pair at an overlap of 0.8 with probability 0.92, at 0.85 with 0.99, at 0.9 with more than 0.999.
JACCARD, BANDS, ROWS = 0.8, 14, 8
SPREAD = (1 - JACCARD) / (1 + JACCARD) + 1e-9  # sets above JACCARD differ in at most this share of the sum of their sizes
#: Share of an upstream's lines (of UPSTREAM_LINE characters or more) that makes a file a copy of it.
UPSTREAM_SHARE, UPSTREAM_LINE = 0.8, 20
#: A family of n symbols repeats itself when its stock of distinct five-symbol shingles is below TEMPLATE x sqrt(200 n): the
#: stock of ordinary code grows slower than its length. LEAST_SYMBOLS: least size of a file for that, and for a blob, whose
#: share of literals and separators is BLOB; FAMILY_SYMBOLS: of one of several files of a family, and of a copy.
TEMPLATE, BLOB, LEAST_SYMBOLS, FAMILY_SYMBOLS = 0.25, 0.75, 40, 100
#: Least number of lines of UPSTREAM_LINE characters or more by which a file is told to be a copy within its cluster.
LEAST_LINES = 4
#: A minified file: most characters in lines of MINIFIED_LINE or more, almost no white space.
MINIFIED_LINE, MINIFIED_SHARE, MINIFIED_SPACE = 200, 0.6, 0.09

# Suffixes of code, in which templates and tables count; keywords that stay unmasked; names of lock files.
CODE = frozenset(".py .js .jsx .mjs .cjs .ts .tsx .go .java .kt .cs .rb .php .rs .c .h .cc .cpp .hpp .swift .scala .css".split())
KEYWORDS = "and as assert async await boolean break case catch chan class const continue def default defer del double elif else enum except export extends false False final finally float for func function global go if implements import in int interface is lambda let long map match new nil None null or package pass private protected public raise range return select static struct super switch this throw throws true True try type var void while with yield".split()
LOCK_NAMES = re.compile(r"(?i)(?:^|/)(?:package-lock\.json|npm-shrinkwrap\.json|yarn\.lock|pnpm-lock\.ya?ml|poetry\.lock|pipfile\.lock|cargo\.lock|gemfile\.lock|composer\.lock|go\.sum|uv\.lock|[^/]+\.lock(?:\.json)?)$")

_KEYWORD = {w: chr(0x100 + i) for i, w in enumerate(KEYWORDS)}
_WORD, _WORDS = re.compile(r"[A-Za-z_]\w*"), re.compile(r"\w+")
_STRING = re.compile(r'''"""(?:[^"\\]|\\.|"(?!""))*"""|"(?:[^"\\\n]|\\.)*"|'(?:[^'\\\n]|\\.)*'|`(?:[^`\\]|\\.)*`''')
_REMARK = re.compile(r"#[^\n]*|//[^\n]*|/\*[^*]*\*+(?:[^/*][^*]*\*+)*/")
_NUMBER = re.compile(r"[-\d](?<![A-Za-z_$].)(?:(?<=\d)|\d)[\w.]*")  # begins with a set, for which the search is quick
_NAME = re.compile(r"[A-Za-z_$][\w$]*")
_START = r"^[ \t]*(?:#|//|/?\*+|--|;|<!--|%)[ \t]*"
#: Remarks by which a tool or a copy declares itself; they must begin the remark, so that mere mention does not count.
DECLARED_OUTPUT = re.compile(
    _START + r"(?:@generated\b|<auto-?generated|auto-?generated\b|(?:this (?:file|code) (?:was|is) )?auto(?:matically)?[ -]?(?:generated|created|produced)|code generated\b|generated (?:on \S+ )?(?:by|from|with|using)\b|machine (?:output|generated)|do not (?:modify|edit)[^\n]*(?:generated|produced) (?:from|by)|[^\n]*automatisch [^\n]*(?:erzeugt|generiert)|[^\n]*g[ée]n[ée]r[ée] automatiquement|fichier (?:produit|g[ée]n[ée]r[ée]) par|archivo (?:generado|producido) por|datei erzeugt von|[^\n]*generado autom[áa]ticamente)",
    re.I,
)
DECLARED_COPY = re.compile(
    _START + r"(?:vendored (?:copy of|from)|bundled \S+, (?:upstream|version|release)|part of \S+, (?:release|version)|\S+ v?\d[\w.]*[ \t]*[-:–][ \t]*(?:third[- ]party|copied from)|(?:this is )?third[- ]party code|copied (?:verbatim )?from (?:the )?upstream)",
    re.I,
)
_REMARK_LINE = re.compile(r"#|//|\*|--|;|%|<\?")
_OPENS = ("/*", "<!--")
_LOCK_TEXT = re.compile(r'"lockfileVersion"|"integrity": *"sha\d+-|^# THIS IS AN AUTOGENERATED', re.M)


def pattern(text: str) -> str:
    """The token pattern: one character a token; \\x01 string, \\x02 number, \\x03 identifier, keywords from U+0100."""
    t = _STRING.sub("\x01", text)
    t = _REMARK.sub("", t)
    t = _NUMBER.sub("\x02", t)
    if t.isascii() and "$" not in t:  # every word is a keyword or a name
        return "".join(_WORD.sub(lambda m: _KEYWORD.get(m[0], "\x03"), t).split())
    t = _WORDS.sub(lambda m: _KEYWORD.get(m[0], m[0]), t)
    return "".join(_NAME.sub("\x03", t).split())


_PLACES = np.random.default_rng(3).integers(1, 1 << 62, 5, dtype=np.uint64) | np.uint64(1)


def _mix(h: np.ndarray, shift: int = 31) -> np.ndarray:
    h = h * np.uint64(0x9E3779B97F4A7C15)
    return h ^ (h >> np.uint64(shift))


def _runs(h: np.ndarray) -> np.ndarray:
    """Hashes of all runs of five; fewer than five are one run."""
    if len(h) < 5:
        h = np.concatenate([h, np.zeros(5 - len(h), np.uint64)])
    n = len(h) - 4
    out = h[:n] * _PLACES[0]
    for k in range(1, 5):
        out += h[k : k + n] * _PLACES[k]
    return _distinct(_mix(out))


def _distinct(h: np.ndarray) -> np.ndarray:
    """``h`` sorted, each value once."""
    h = np.sort(h)
    return h[np.concatenate([[True], h[1:] != h[:-1]])] if len(h) else h


def _stock(p: str, b: np.ndarray) -> int:
    """Number of distinct runs of five symbols, exactly; 5 x 12 bits hold a run unless a symbol lies beyond."""
    if len(b) < 5 or b.max() >= 4096:
        return len({p[i : i + 5] for i in range(max(1, len(p) - 4))})
    w = b[:-4].copy()
    for k in range(1, 5):
        w <<= np.uint64(12)
        w |= b[k : len(b) - 4 + k]
    return len(_distinct(w))


def shingles(p: str) -> tuple[np.ndarray, int]:
    """(distinct hashed shingles of five words, number of distinct runs of five symbols) of a pattern.

    The leading 32 bits are kept for the verification, in which a chance clash of two of a file's few hundred shingles would
    shift the overlap by one.
    """
    b = np.frombuffer(p.encode("utf-32-le"), np.uint32).astype(np.uint64)
    stock = _stock(p, b)
    starts = np.flatnonzero((b <= 3) | (b >= 0x100))
    if len(b) and not (len(starts) and starts[0] == 0):
        starts = np.concatenate([[0], starts])
    if len(starts):
        place = np.arange(len(b)) - np.repeat(starts, np.diff(np.append(starts, len(b))))
        b = np.add.reduceat(_mix((b + np.uint64(7)) * (place.astype(np.uint64) * np.uint64(2) + np.uint64(0x9E3779B1))), starts)
    return _runs(b), stock


_RNG = np.random.default_rng(5)
_A = _RNG.integers(1, 1 << 62, BANDS * ROWS, dtype=np.uint64) | np.uint64(1)
_B = _RNG.integers(0, 1 << 62, BANDS * ROWS, dtype=np.uint64)


def minima(s: np.ndarray) -> np.ndarray:
    """The MinHash signature of a set."""
    h = s[:, None] * _A
    h += _B
    return h.min(0) >> np.uint64(20)


def banded(signatures: np.ndarray) -> np.ndarray:
    """One hash a band of each signature."""
    low = signatures.reshape(-1, BANDS, ROWS)
    h = np.arange(BANDS, dtype=np.uint64) + np.uint64(1)
    for k in range(ROWS):
        h = (h ^ low[:, :, k]) * np.uint64(0x9E3779B97F4A7C15)
        h ^= h >> np.uint64(29)
    return (h >> np.uint64(32)).astype(np.uint32).view(np.int32)


def bands(s: np.ndarray) -> list[int]:
    """One hash a band of the MinHash signature."""
    return banded(minima(s))[0].tolist()


def sketch(s: np.ndarray) -> list[int]:
    """256 parity bits: two sets that differ in d shingles have sketches that differ in at most d bits."""
    odd = np.bincount((s & np.uint64(255)).astype(np.int64), minlength=256) & 1
    return np.packbits(odd.astype(np.uint8)).view(np.int64).tolist()


def _remarks(lines: list[str], opens: str, closes: str) -> int:
    """Number of lines of the block of remarks and blank lines with which ``lines`` begin."""
    inside = ""
    for k, line in enumerate(lines):
        x = line.strip()
        if inside:
            if inside in x:
                inside = ""
            continue
        block = next(((a, b) for a, b in zip(opens.split(), closes.split(), strict=True) if (x.startswith(a) if a in _OPENS else x.endswith(a))), None)
        if block:
            a, b = block
            rest = x[len(a) :] if a in _OPENS else x[: -len(a)]
            if a not in _OPENS and b in rest and not x.startswith(b):
                return k  # code with a remark behind it
            inside = "" if b in rest else b
        elif x and not _REMARK_LINE.match(x):
            return k
    return len(lines)


def edges(lines: list[str]) -> list[str]:
    """The lines at which a file declares itself: the whole block of remarks and blank lines at its head and at its foot, and
    in any case the first six and last four lines."""
    head = max(6, _remarks(lines, "/* <!--", "*/ -->"))
    foot = max(4, _remarks(lines[::-1], "*/ -->", "/* <!--"))
    return lines if head + foot >= len(lines) else lines[:head] + lines[-foot:]


def line_hashes(text: str | None) -> list[int]:
    """The distinct lines of ``text`` that count for a copy, without layout, as 64-bit hashes in order."""
    import xxhash

    each = (" ".join(x.split()) for x in (text or "").split("\n") if len(x) >= UPSTREAM_LINE)
    return sorted({xxhash.xxh64_intdigest(x) - (1 << 63) for x in each if len(x) >= UPSTREAM_LINE})


_FIELDS = {"code": pa.bool_(), "n": pa.int32(), "stock": pa.int32(), "literal": pa.float64(), "named": pa.float64(), "lock": pa.bool_(), "minified": pa.bool_(), "output": pa.bool_(), "declared": pa.bool_(), "cls": pa.int64(), "k": pa.int32()}
_FIELDS |= {f"s{i}": pa.int64() for i in range(4)} | {"bands": pa.list_(pa.int32()), "shingles": pa.list_(pa.int32()), "lines": pa.list_(pa.int64())}
_SQL = {pa.bool_(): "boolean", pa.int32(): "int", pa.int64(): "bigint", pa.float64(): "double", pa.list_(pa.int32()): "array<int>", pa.list_(pa.int64()): "array<bigint>"}


def describe(files: DataFrame) -> DataFrame:
    """One row a file with its shingles, its lines, the measures of its pattern and what it declares. Null text is empty text."""
    x = files.select("file_id", "repo", "path", "suffix", "text")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        import xxhash

        for b in batches:
            rows = []
            for path, suffix, text in zip(*(b.column(i).to_pylist() for i in (2, 3, 4)), strict=True):
                t, path = text or "", path or ""
                p = pattern(t)
                s, stock = shingles(p)
                n = len(p)
                lit = p.count("\x01") + p.count("\x02")
                sep = p.count(",") + p.count(";") + p.count("[") + p.count("]") + p.count("{") + p.count("}")
                lines = t.split("\n")
                size = max(1, len(t))
                wide = sum(len(x) for x in lines if len(x) >= MINIFIED_LINE) / size
                space = 1 - len("".join(t.split())) / size
                edge = edges(lines)
                rows.append((
                    (suffix or "").lower() in CODE,
                    n,
                    stock,
                    (lit + sep) / max(1, n) if lit >= 0.3 * n else 0.0,
                    p.count("\x03") / max(1, n),
                    bool(LOCK_NAMES.search(path)) or (suffix or "").lower() in (".json", ".lock") and bool(_LOCK_TEXT.search(t)),
                    wide > MINIFIED_SHARE and space < MINIFIED_SPACE,
                    any(DECLARED_OUTPUT.match(x) for x in edge),
                    any(DECLARED_COPY.match(x) for x in edge),
                    xxhash.xxh64_intdigest(s.tobytes()) - (1 << 63),
                    len(s),
                    *sketch(s),
                    minima(s),
                    (s >> np.uint64(32)).astype(np.uint32).view(np.int32),
                    line_hashes(t),
                ))
            cols = list(zip(*rows, strict=True)) if rows else [()] * len(_FIELDS)
            if rows:
                at = list(_FIELDS).index("bands")
                cols[at] = banded(np.stack(cols[at]))
            yield pa.RecordBatch.from_arrays([b.column(0), b.column(1), *[pa.array(list(c), k) for c, k in zip(cols, _FIELDS.values(), strict=True)]], names=["file_id", "repo", *_FIELDS])

    return spread(x).mapInArrow(run, f"file_id {dict(x.dtypes)['file_id']}, repo string, " + ", ".join(f"{c} {_SQL[k]}" for c, k in _FIELDS.items()))


def _shared(b: DataFrame, single: bool = False) -> DataFrame:
    """Rows (bucket, cls, label) of buckets that hold more than one group (``label``), with the largest group of the bucket
    (``main``) and the number of rows outside it (``rest``). Counts are partial sums before they are shuffled, and the join
    back is split where a bucket is hot. With ``single`` every row of a bucket is a group, which takes one shuffle less."""
    if single:
        g = b.groupBy("bucket").agg(F.max("label").alias("main"), (F.count(F.lit(1)) - 1).alias("rest")).where("rest > 0")
        return b.join(g, "bucket")
    g = b.groupBy("bucket", "label").agg(F.count(F.lit(1)).alias("n")).groupBy("bucket")
    g = g.agg(F.max(F.struct("n", "label")).alias("top"), F.sum("n").alias("size"), F.count(F.lit(1)).alias("groups")).where("groups > 1")
    return b.join(g.select("bucket", F.col("top.label").alias("main"), (F.col("size") - F.col("top.n")).alias("rest")), "bucket")


def near_links(described: DataFrame, leaders: int = 64) -> DataFrame:
    """(a, b): verified links between classes of equal shingle sets of ``described`` (cls, k, bands, shingles).

    In each round some members of every bucket lead (first a single one, then about ``leaders`` from outside the bucket's
    largest group, then that many times more in each further round), and are compared with all members of other groups,
    whatever those were linked to before. Members of one group are joined by links found so far. A member that led is done
    with the bucket, and the bucket is done when all its members are of one group. So every pair of a bucket is compared or joined by other links, and a bucket of one
    family of any size costs one comparison a member, and one more for each member outside the family. A comparison first
    bounds the difference of the sets by their sizes and sketches, in the join; only pairs within that bound are verified,
    and shingles are fetched only for classes that share a bucket.
    """
    about = ["k", "s0", "s1", "s2", "s3"]
    b = described.groupBy("cls").agg(F.first("bands").alias("bands"))
    b = b.select("cls", F.posexplode("bands").alias("no", "h")).select("cls", F.xxhash64("no", "h").alias("bucket"), F.col("cls").alias("label"))
    b = cut(_shared(b, single=True))
    near = b.select("cls").distinct()
    classes = cut(described.select("cls", *about, "shingles").join(near, "cls", "left_semi").groupBy("cls").agg(*[F.first(c).alias(c) for c in [*about, "shingles"]]))
    small = lambda end: classes.select(F.col("cls").alias(end), *[F.col(c).alias(f"{end}_{c}") for c in about])
    odd = sum((F.bit_count(F.col(f"a_{c}").bitwiseXOR(F.col(f"b_{c}"))) for c in about[1:]), F.lit(0))
    differ = F.col("a_k") + F.col("b_k")
    fits = (F.abs(F.col("a_k") - F.col("b_k")) <= SPREAD * differ) & (odd <= SPREAD * differ)
    out, many = None, 0
    while True:
        first = F.col("cls") == F.col("main")  # at first every label is a class of its own
        m = b.withColumn("leads", first if many == 0 else (F.col("label") != F.col("main")) & (F.pmod(F.xxhash64("cls", F.lit(many)), F.col("rest")) < many))
        lead = m.where("leads").select("bucket", F.col("cls").alias("l_cls"), F.col("label").alias("l_label"))
        met = m.join(lead, "bucket").where("l_label <> label").select(F.least("l_cls", "cls").alias("a"), F.greatest("l_cls", "cls").alias("b")).distinct()
        met = met.join(small("a"), "a").join(small("b"), "b").where(fits).select("a", "b")
        v = met.join(classes.select(F.col("cls").alias("a"), F.col("shingles").alias("x")), "a").join(classes.select(F.col("cls").alias("b"), F.col("shingles").alias("y")), "b")
        both = F.size(F.array_intersect("x", "y"))
        ok = v.where(both >= JACCARD * (F.size("x") + F.size("y") - both)).select("a", "b")
        out, old = cut(ok if out is None else out.unionByName(ok)), out
        drop(old)
        rest = m.where("not leads").select("bucket", "cls").join(_labels(out), "cls", "left").withColumn("label", F.coalesce("label", "cls"))
        b, old = cut(_shared(rest)), b
        drop(old)
        many = max(1, many) * leaders
        if b.isEmpty():
            drop(b)
            drop(classes)
            return out


def _labels(links: DataFrame) -> DataFrame:
    """(cls, label) of all linked classes, by two steps along the links in one job: classes of one label are connected, but
    connected classes may have several labels, which costs comparisons and loses none."""
    e = links.unionByName(links.select(F.col("b").alias("a"), F.col("a").alias("b")))
    one = e.groupBy("a").agg(F.max("b").alias("m")).select(F.col("a").alias("cls"), F.greatest("a", "m").alias("label"))
    return e.join(one.withColumnRenamed("cls", "b"), "b").groupBy(F.col("a").alias("cls")).agg(F.max("label").alias("label"))


def components(edges: DataFrame) -> DataFrame:
    """(cls, cluster) of all classes with an edge: connected components by smallest label, with a shortcut over the label's
    own label each round."""
    e = cut(edges.select("a", "b").unionByName(edges.select(F.col("b").alias("a"), F.col("a").alias("b"))).distinct())
    lab = cut(e.select(F.col("a").alias("cls")).distinct().withColumn("cluster", F.col("cls")))
    while True:
        near = e.join(lab.withColumnRenamed("cls", "b"), "b").groupBy(F.col("a").alias("cls")).agg(F.min("cluster").alias("low"))
        nxt = lab.join(near, "cls").select("cls", "cluster", F.least("cluster", "low").alias("low"))
        up = lab.select(F.col("cls").alias("low"), F.col("cluster").alias("top"))
        nxt = cut(nxt.join(up, "low", "left").select("cls", "cluster", F.least("low", F.coalesce("top", "low")).alias("new")))
        if nxt.where("new < cluster").isEmpty():
            drop(e)
            drop(nxt)
            return lab
        drop(lab)
        lab = nxt.select("cls", F.col("new").alias("cluster"))
        lab._written = nxt._written


def upstream_copies(described: DataFrame, originals: DataFrame) -> DataFrame:
    """(file_id): files that hold UPSTREAM_SHARE or more of the lines of an original; exact, for any number of originals.

    Both sides are rows with ``lines``. A file that holds so many of an original's lines holds at least one of any
    (1 - UPSTREAM_SHARE) of them and one more; of each original those lines lead to it that the fewest originals have. So a
    line that is common everywhere multiplies nothing, and only files that are led to are held against whole originals.
    """
    u = originals.where(F.size("lines") > 0).select(F.xxhash64("lines").alias("u"), F.col("lines").alias("u_lines")).dropDuplicates(["u"])
    each = u.select("u", F.size("u_lines").alias("size"), F.explode("u_lines").alias("h"))
    rare = each.join(each.groupBy("h").agg(F.count(F.lit(1)).alias("df")), "h").withColumn("no", F.row_number().over(Window.partitionBy("u").orderBy("df", "h")))
    rare = rare.where(F.col("no") <= F.col("size") - F.ceil(UPSTREAM_SHARE * F.col("size") - 1e-9) + 1).select("u", "h")
    led = described.select("file_id", F.explode("lines").alias("h")).join(broadcast_if_small(rare), "h").select("file_id", "u").distinct()
    j = led.join(described.select("file_id", "lines"), "file_id").join(u, "u")
    return j.where(F.size(F.array_intersect("lines", "u_lines")) >= UPSTREAM_SHARE * F.size("u_lines") - 1e-9).select("file_id").distinct()


def shared_lines(members: DataFrame) -> DataFrame:
    """(cluster, repo, cls, file_id): files that share the better half of their lines with other repositories of their
    cluster. ``members`` is (cluster, repo, cls, file_id, lines), all lines of each file; null repositories count as one."""
    about = ["cluster", "repo", "cls", "file_id"]
    x = members.withColumn("repo", F.coalesce("repo", F.lit(""))).where(F.size("lines") >= LEAST_LINES)
    x = x.select(*about, F.size("lines").alias("size"), F.xxhash64("lines").alias("text"), F.explode("lines").alias("h"))
    both = x.groupBy("cluster", "h").agg(F.min("repo").alias("p"), F.max("repo").alias("q")).where("p <> q").select("cluster", "h")
    g = x.join(both, ["cluster", "h"]).select(*about, "size", "text", "h").distinct().groupBy(*about, "size", "text").agg(F.count(F.lit(1)).alias("n"))
    return g.where(F.col("n") * 2 >= F.col("size")).select(*about).distinct()


def origins(files: DataFrame, upstream: DataFrame) -> DataFrame:
    """(file_id, repo, cluster, files, repos, kind, evidence): one row a file.

    ``files`` and ``repos`` are exact sizes of the cluster. ``kind`` is one of lock, minified, data,
    generated, vendored, written; ``evidence`` says what decided it: name, layout, cluster (its members), family (those in
    the file's repository), lines (shared within a cluster over repositories), upstream, declaration, or none. A null or empty text is written. ``upstream``
    needs a text column; null texts there are ignored. Repeated file_ids give a row each. Further columns are ignored.
    """
    x = cut(describe(files))
    u = cut(describe(upstream.where("text is not null").select(*[F.lit("").alias(c) for c in ("file_id", "repo", "path", "suffix")], "text")))
    lab = components(near_links(x))
    need = ["file_id", "repo", "cls", "code", "n", "stock", "literal", "named", "lock", "minified", "output", "declared"]
    copied = upstream_copies(x, u).withColumn("copied", F.lit(True))
    labelled = lambda df, *more: df.select(*need, *more).join(lab, "cls", "left").withColumn("cluster", F.coalesce("cluster", "cls"))
    y = labelled(x)
    # a cluster may hold a third of all files: sums are partial before the shuffle, by repository first
    f = y.groupBy("cluster", "repo").agg(
        F.count(F.lit(1)).alias("members"),
        F.sum(F.col("n").cast("long")).alias("f_n"),
        F.avg("stock").alias("f_stock"),
        F.avg(F.col("stock") / F.greatest(F.lit(1), "n") * F.sqrt(F.greatest(F.lit(1), "n"))).alias("f_repeat"),
        F.sum("literal").alias("f_literal"),
        F.sum(F.col("output").cast("int")).alias("f_output"),
        F.sum(F.col("declared").cast("int")).alias("f_declared"),
    )
    g = f.groupBy("cluster").agg(
        F.sum("members").alias("files"),
        F.count("repo").alias("repos"),
        (F.sum("f_literal") / F.sum("members")).alias("c_literal"),
        (F.sum("f_output") / F.sum("members")).alias("c_output"),
        (F.sum("f_declared") / F.sum("members")).alias("c_declared"),
        (F.sum(F.col("f_repeat") * F.col("members")) / F.sum("members")).alias("c_repeat"),
    )
    wide = labelled(x, "lines").where(F.col("code") & (F.col("n") >= FAMILY_SYMBOLS))
    several = g.where("c_declared >= 0.5 and repos > 1").select("cluster")
    over = shared_lines(wide.join(several, "cluster", "left_semi")).withColumn("shared", F.lit(True)).withColumnRenamed("repo", "_repo")
    y = y.join(g, "cluster").withColumn("_repo", F.coalesce("repo", F.lit("")))
    y = y.join(f.select("cluster", F.coalesce("repo", F.lit("")).alias("_repo"), "members", "f_n", "f_stock").groupBy("cluster", "_repo").agg(*[F.max(c).alias(c) for c in ("members", "f_n", "f_stock")]), ["cluster", "_repo"])
    y = y.join(over, ["cluster", "_repo", "cls", "file_id"], "left").join(copied, "file_id", "left")
    code = F.col("code") & (F.col("n") >= LEAST_SYMBOLS)
    # the stock against what ordinary code of that length has: below 1 is repetition
    bound = TEMPLATE * 200**0.5
    family = F.when((F.col("members") > 1) & (F.col("n") >= FAMILY_SYMBOLS), F.col("f_stock") / (bound * F.sqrt("f_n"))).otherwise(F.lit(1.0))
    repeats = code & (F.col("named") < 0.8)
    says = [
        (F.col("lock"), "lock", "name"),
        (F.col("minified") & F.col("code"), "minified", "layout"),
        (code & (F.col("c_literal") >= BLOB), "data", "cluster"),
        (F.coalesce("shared", F.lit(False)), "vendored", "lines"),
        (F.coalesce("copied", F.lit(False)), "vendored", "upstream"),
        (repeats & (F.col("c_repeat") < bound), "generated", "cluster"),
        (code & (F.col("c_output") >= 0.5) & (F.col("files") > 1) & (F.col("c_repeat") < 1.6 * bound), "generated", "cluster"),
        (repeats & (family < 1), "generated", "family"),
        (F.col("declared"), "vendored", "declaration"),
        (F.col("output"), "generated", "declaration"),
    ]
    verdict = F.struct(F.lit("written").alias("kind"), F.lit("none").alias("evidence"))
    for when, kind, why in reversed(says):
        verdict = F.when(when, F.struct(F.lit(kind).alias("kind"), F.lit(why).alias("evidence"))).otherwise(verdict)
    return y.withColumn("_v", verdict).select("file_id", "repo", "cluster", "files", "repos", "_v.kind", "_v.evidence")


def _origins(spark: SparkSession, d: str) -> DataFrame:
    return origins(table(spark, d, "files", "file_id", "repo", "path", "suffix", "text"), table(spark, d, "upstream_files", "text"))


def p1_found(spark: SparkSession, d: str) -> DataFrame:
    return _origins(spark, d).where("kind <> 'written'").select("file_id").distinct()


def p1_origins(spark: SparkSession, d: str) -> DataFrame:
    """Every file with its cluster and kind."""
    return _origins(spark, d)


def p1_detectors(spark: SparkSession, d: str) -> DataFrame:
    """Findings by detector over the files that somebody wrote; findings whose file is gone or unknown are counted apart."""
    det = F.lower(F.translate(F.trim("detector"), "_", "-"))
    path = F.lower(F.regexp_replace(F.trim("file"), r"^(?:\./)+|\\", ""))
    f = table(spark, d, "findings", "finding_id", "repo", "file", "detector")
    f = f.groupBy("finding_id").agg(F.min(F.struct("repo", path.alias("path"), det.alias("detector"))).alias("x")).select("finding_id", "x.*")
    o = _origins(spark, d).select("file_id", "kind").join(table(spark, d, "files", "file_id", F.col("repo"), F.lower("path").alias("path")), "file_id")
    j = f.join(o.select("repo", "path", "kind"), ["repo", "path"], "left").withColumn("kind", F.coalesce("kind", F.lit("gone")))
    g = j.where("kind in ('written', 'gone')").groupBy("detector")
    return g.agg(F.count(F.when(F.col("kind") == "written", 1)).alias("findings"), F.count(F.when(F.col("kind") == "gone", 1)).alias("findings_without_file"))


QUERIES = {"p1_found": p1_found, "p1_origins": p1_origins, "p1_detectors": p1_detectors}
ORACLE: dict = {}
