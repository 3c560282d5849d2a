"""Problem 10: per-document text statistics, and a Gaussian mixture over them that tells prose from lists, tables and junk.

Statistics are taken over whole texts. The mixture is fitted by expectation-maximization over all documents: every
iteration is one distributed pass that adds up each component's sufficient statistics (a few hundred numbers, whatever the
number of documents), until the likelihood no longer rises. Components are then named by the inspected examples below, and
a document is what its component is. Only documents the mixture leaves in doubt get an exact check of the share of characters
in running sentences.
"""

from __future__ import annotations

import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from riskweave.runtime import cut, spread, table

# Common words of English, French, Spanish and German.
COMMON = {
    "en": "the a an of to in and or is are was were be been that this these those it its as at by for from with on not no but if then so when which who while until than there had has have do does we he she they you i please more because every each one another near against before after under during without within across through beyond outside inside let any some all nobody nothing",
    "fr": "le la les un une des du de et ou est sont que qui ce cette dans par pour avec sur pas ne plus mais si lorsque quand parce puis il elle depuis au aux en se",
    "es": "el los las una y o es son por para con sin no del al lo se cuando pero aunque desde cada hasta ya muy",
    "de": "der die das den dem des ein eine einer eines einem und oder ist sind war nicht mit von zu im am auf für aber wenn dann dass weil nach aus bei ob nur es sich noch auch",
}
_COMMON = frozenset(w for v in COMMON.values() for w in v.split())
_PREFIX = re.compile(r"^[\s>#*•|]+|^\s*//+\s*|^\s*--\s+|^\s*;+\s")
_ITEM = re.compile(r"^\s*(?:[-*+•·]|\d{1,3}[.)]|\[[ xX]\]|[a-z][.)])\s+")
_WORD = re.compile(r"""^["'“‘«(¿¡*_`]*[^\W\d_]+(?:['’-][^\W\d_]+)*["'”’»)*_`]*[.,;:!?…]*["'”’»)]*$""")
_END = re.compile(r"""[.!?…;]["'”’»)*_]*$""")
_STRIP = ".,;:!?\"'“”()*_`"
#: A running sentence has so many words, most of them plain words, some of them common ones.
SENTENCE_WORDS, PLAIN_SHARE, COMMON_SHARE = (4, 60), 0.7, 0.12
#: Share of common words of text that runs on without an end.
RUN_ON = (0.2, 0.55)

STATS = ["n_chars", "n_words", "n_lines", "mean_word_len", "symbol_ratio", "digit_ratio", "end_punct_lines", "common_share", "plain_share", "mean_line_words", "sentence_share"]
#: What the mixture sees.
FEATURES = ["mean_word_len", "symbol_ratio", "digit_ratio", "end_punct_lines", "common_share", "plain_share", "mean_line_words", "sentence_share"]
_SQUEEZE = {"mean_word_len": 20.0, "mean_line_words": 40.0}


def _sentence(words: list[str], chars: int, ended: bool = True) -> int:
    """``chars`` when the words make a running sentence, else 0.

    Words without an end, or too many for one sentence, still run on when common words are mixed in as prose has them:
    neither as rare as in a list of names nor as frequent as in a heap.
    """
    n = len(words)
    if n < SENTENCE_WORDS[0] or sum(1 for w in words if _WORD.match(w)) < PLAIN_SHARE * n:
        return 0
    common = sum(1 for w in words if w.strip(_STRIP).lower() in _COMMON or "'" in w[:3])
    if not ended or n > SENTENCE_WORDS[1]:
        return chars if n >= 12 and RUN_ON[0] * n <= common <= RUN_ON[1] * n else 0
    return chars if common >= max(1, COMMON_SHARE * n) else 0


def sentence_chars(text: str) -> int:
    """Characters in running sentences: quoted, wrapped, commented or lower-case lines are joined to paragraphs first."""
    good, para = 0, []

    def flush() -> int:
        got, words, chars = 0, [], 0
        for line in para:
            for w in line.split():
                words.append(w)
                chars += len(w) + 1
                if _END.search(w):
                    got += _sentence(words, chars)
                    words, chars = [], 0
        para.clear()
        return got + _sentence(words, chars, ended=False)

    for line in text.split("\n"):
        s = _PREFIX.sub("", line.strip()).strip()
        if not s:
            good += flush()
        elif _ITEM.match(line) or (not para and len(s.split()) < 5 and not _END.search(s)):
            good += flush()
            s = _ITEM.sub("", line).strip()
            if len(s.split()) >= 6:
                para.append(s)
        else:
            para.append(s)
    return good + flush()


def text_stats(text: str | None) -> list[float] | None:
    """The values of STATS; null for null or blank text."""
    if text is None or not text.strip():
        return None
    body = text.strip()
    words, lines = body.split(), [x for x in body.split("\n") if x.strip()]
    n = len(words)
    symbols = sum(1 for c in body if not (c.isalnum() or c.isspace() or c in ".,;:!?'\"-()"))
    return [
        float(len(text)),
        float(n),
        float(len(lines)),
        sum(map(len, words)) / n,
        symbols / len(body),
        sum(map(str.isdigit, body)) / len(body),
        sum(1 for x in lines if _END.search(x.rstrip())) / len(lines),
        sum(1 for w in words if w.strip(_STRIP).lower() in _COMMON) / n,
        sum(1 for w in words if _WORD.match(w)) / n,
        n / len(lines),
        min(1.0, sentence_chars(text) / len(body)),
    ]


# Inspected examples, written for this purpose; each starts one component of the mixture.
EXAMPLES: list[tuple[str, list[str]]] = [
    ("prose", ["The scanner read the whole tree before it wrote a report. When a rule fired twice, only the first line was kept, and nobody had to look at the rest.", "We found that the guard had dropped the reply because the prompt was too long. It was plain that the limit should be raised."]),
    ("prose", ["> the team looked at the log and saw\n> that nothing had been written since the\n> last run. it was not clear who had\n> stopped the service.", "Der Bericht ist nicht fertig, weil die Prüfung noch läuft. Wenn sie endet, dann wird das Ergebnis auf der Seite gezeigt."]),
    ("list", ["- red widget\n- blue widget\n- green gadget\n- small handle\n- large crank\n- spare part", "Shopping\n1. Bread.\n2. Milk.\n3. Salt.\n4. Flour.\n5. Eggs.\n6. Rice."]),
    ("list", ["alpha==1.2.3\nbeta==0.4.11\ngamma==2.0.1\ndelta==7.1.9\nomega==3.3.3", "[x] src/one.py\n[ ] src/two.go\n[x] lib/three.ts\n[ ] lib/four.py"]),
    ("table", ["name | count | size\n---|---|---\none | 12 | 400\ntwo | 99 | 812\nsix | 40 | 731", "id,kind,share\n1,red,20%\n2,blue,31%\n3,green,49%\n4,grey,0%"]),
    ("table", ["2030-01-02T03:04:05 INFO [core] start=1f2e rc=0\n2030-01-02T03:04:06 WARN [core] retry=77aa rc=4\n2030-01-02T03:04:09 INFO [core] stop=9b3c rc=0", "a\tb\tc\n10\t20\t30\n11\t21\t31\n12\t22\t32"]),
    ("junk", ["Home » Shop » Cart | Login | Share | Top", "apple house river stone cloud table green paper light water north field"]),
    ("junk", ["#@=%^ {}[]*&^ ~~+-/ <>|= ;;{{ $$^% @@!# ()*& ^%$#", "QmFzZTY0IGRhdGEgaXMgbm90IHByb3NlLCBldmVu\naWYgaXQgZGVjb2RlcyB0byBhIHNlbnRlbmNlLiBT\nbyBpdCBzdGF5cyBvdXQu"]),
    ("junk", ["of to the in at is as by that with for from it the and of in to or as at be", "the is of in and that for it at on with as by from to the of or is in a"]),
]


def stats_table(docs: DataFrame) -> DataFrame:
    """(doc_id, STATS...): one row a row of ``docs`` (doc_id, text); all statistics are null for null or blank text."""
    out = docs.select("doc_id", "text")
    schema = f"doc_id {dict(out.dtypes)['doc_id']}, " + ", ".join(f"{c} double" for c in STATS)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            rows = [text_stats(t) for t in b.column(1).to_pylist()]
            cols = [pa.array([None if r is None else r[i] for r in rows], pa.float64()) for i in range(len(STATS))]
            yield pa.RecordBatch.from_arrays([b.column(0), *cols], names=["doc_id", *STATS])

    return spread(out).mapInArrow(run, schema)


def _matrix(columns: dict[str, np.ndarray], centre: np.ndarray, scale: np.ndarray) -> np.ndarray:
    x = np.stack([np.minimum(columns[c], _SQUEEZE.get(c, np.inf)) for c in FEATURES], axis=1)
    return (x - centre) / scale


def _log_density(x: np.ndarray, w: np.ndarray, mu: np.ndarray, var: np.ndarray) -> np.ndarray:
    """(n, k): log of weight x density for diagonal Gaussians."""
    return np.log(w) - 0.5 * (np.log(2 * np.pi * var).sum(1) + (((x[:, None, :] - mu) ** 2) / var).sum(2))


def _responsibilities(x: np.ndarray, w: np.ndarray, mu: np.ndarray, var: np.ndarray) -> np.ndarray:
    p = _log_density(x, w, mu, var)
    p = np.exp(p - p.max(1, keepdims=True))
    return p / p.sum(1, keepdims=True)


class Mixture:
    """A fitted mixture: standardization, weights, means, variances and the kind of each component."""

    def __init__(self, centre, scale, w, mu, var):
        self.centre, self.scale, self.w, self.mu, self.var = centre, scale, w, mu, var
        self.kinds: list[str] = []

    def name_components(self) -> None:
        """Each component takes the kind of the inspected example nearest to its mean.

        Not that of the examples it is responsible for: the examples are few and short, and a wide component can claim those
        of another kind.
        """
        near = []
        for kind, texts in EXAMPLES:
            s = np.array([text_stats(t) for t in texts])
            x = _matrix({c: s[:, STATS.index(c)] for c in FEATURES}, self.centre, self.scale)
            near += [(kind, e) for e in x]
        self.kinds = [min(near, key=lambda n, mu=mu: float(((n[1] - mu) ** 2).sum()))[0] for mu in self.mu]


def fit(stats: DataFrame, gain: float = 1e-3, iterations: int = 100, floor: float = 0.02) -> Mixture | None:
    """The mixture over all rows of ``stats`` with statistics; None where there are none.

    Starts at the inspected examples, so it has no random part. Ends when the mean log-likelihood of a document rises by
    less than ``gain``, after ``iterations`` at the latest. ``floor`` is the least variance of a standardized statistic.
    """
    s = stats.select(*[F.least(F.col(c), F.lit(_SQUEEZE.get(c, 1e18))).alias(c) for c in FEATURES]).where(F.col(FEATURES[0]).isNotNull())
    r = s.agg(F.count(F.lit(1)).alias("n"), *[F.avg(c).alias("m_" + c) for c in FEATURES], *[F.stddev_pop(c).alias("s_" + c) for c in FEATURES]).first()
    if not r["n"]:
        return None
    centre = np.array([r["m_" + c] for c in FEATURES])
    scale = np.array([max(r["s_" + c], 1e-6) for c in FEATURES])
    mu = []
    for _, texts in EXAMPLES:
        t = np.array([text_stats(x) for x in texts])
        mu.append(_matrix({c: t[:, STATS.index(c)] for c in FEATURES}, centre, scale).mean(0))
    k, d = len(mu), len(FEATURES)
    m = Mixture(centre, scale, np.full(k, 1 / k), np.array(mu), np.ones((k, d)))
    last = -np.inf
    for _ in range(iterations):

        def e_step(batches: Iterator[pa.RecordBatch], m=m) -> Iterator[pa.RecordBatch]:
            acc = np.zeros((k + 1, 1 + 2 * d))  # the last row holds the log-likelihood
            for b in batches:
                if b.num_rows:
                    x = _matrix({c: b.column(i).to_numpy(zero_copy_only=False) for i, c in enumerate(FEATURES)}, m.centre, m.scale)
                    p = _log_density(x, m.w, m.mu, m.var)
                    top = p.max(1, keepdims=True)
                    g = np.exp(p - top)
                    acc[k, 0] += (top[:, 0] + np.log(g.sum(1))).sum()
                    g /= g.sum(1, keepdims=True)
                    acc[:k] += np.concatenate([g.sum(0)[:, None], g.T @ x, g.T @ (x * x)], axis=1)
            i, j = np.indices(acc.shape)
            yield pa.RecordBatch.from_arrays([pa.array(i.ravel(), pa.int32()), pa.array(j.ravel(), pa.int32()), pa.array(acc.ravel())], names=["i", "j", "v"])

        acc = np.zeros((k + 1, 1 + 2 * d))
        for i, j, v in s.mapInArrow(e_step, "i int, j int, v double").groupBy("i", "j").agg(F.sum("v")).collect():
            acc[i, j] = v
        likelihood, acc = acc[k, 0] / r["n"], acc[:k]
        if likelihood - last < gain:
            break
        last = likelihood
        n = np.maximum(acc[:, :1], 1e-9)
        mean = acc[:, 1 : 1 + d] / n
        keep = acc[:, 0] > 1e-3  # a component nothing belongs to stays where it is
        m = Mixture(centre, scale, np.maximum(acc[:, 0] / acc[:, 0].sum(), 1e-9), np.where(keep[:, None], mean, m.mu), np.where(keep[:, None], np.maximum(acc[:, 1 + d :] / n - mean**2, floor), m.var))
    m.name_components()
    return m


def classify(stats: DataFrame, m: Mixture | None) -> DataFrame:
    """``stats`` with ``kind`` (prose, list, table, junk; null without statistics) and ``p_prose``."""
    if m is None:
        return stats.withColumn("kind", F.lit(None).cast("string")).withColumn("p_prose", F.lit(None).cast("double"))

    @F.pandas_udf("struct<kind string, p_prose double>")
    def of(*cols):
        import pandas as pd

        ok = cols[0].notna().to_numpy()
        kind, p = np.full(len(ok), None, object), np.full(len(ok), np.nan)
        if ok.any():
            x = _matrix({c: cols[i].to_numpy()[ok] for i, c in enumerate(FEATURES)}, m.centre, m.scale)
            g = _responsibilities(x, m.w, m.mu, m.var)
            kind[ok] = np.array(m.kinds, object)[g.argmax(1)]
            p[ok] = g[:, [a == "prose" for a in m.kinds]].sum(1)
        return pd.DataFrame({"kind": kind, "p_prose": p})

    return stats.withColumn("_k", of(*[F.col(c) for c in FEATURES])).select("*", "_k.kind", "_k.p_prose").drop("_k")


#: Documents whose posterior of prose lies between 1 - SURE and SURE are in doubt.
SURE = 0.9999


def not_prose(classified: DataFrame) -> DataFrame:
    """(doc_id): documents whose component isn't prose; in doubt those of which less than half is running sentences."""
    p = F.col("p_prose")
    return classified.where((F.col("kind") != "prose") & (p <= 1 - SURE) | (p > 1 - SURE) & (p < SURE) & (F.col("sentence_share") < 0.5)).select("doc_id").distinct()


def p10_stats(spark: SparkSession, d: str) -> DataFrame:
    """All statistics and the mixture's verdict for every document."""
    s = cut(stats_table(table(spark, d, "documents", "doc_id", "text")))
    return classify(s, fit(s))


def p10_found(spark: SparkSession, d: str) -> DataFrame:
    """Texts that are not prose."""
    return not_prose(p10_stats(spark, d))


QUERIES = {"p10_found": p10_found, "p10_stats": p10_stats}
ORACLE: dict = {}
