"""Problem 8: evaluation items inside documents, in whole or in part.

Windows of words are embedded by the CGK random walk, which turns edit distance into Hamming distance: at step j the walk
writes the word under its cursor and moves on or stays by a random bit of (j, word). Bit sampling over the written words
gives hash keys; several independent walks and samples reach the wanted recall. An item can be held in two stretches, so
its windows are of the size of the least stretch that counts; an item shorter than that has one window of its own size.

Windows of items (every offset) meet windows of documents under equal keys in a join. A document only sends the keys of
which a bit map of all items' keys, of fixed size, knows; the pairs that meet are reduced, before they are shuffled, to the
parts of the item in which they meet, and a pair goes on when these are as many as half of the item must have. Such pairs
are verified by local alignment over the whole texts.
"""

from __future__ import annotations

import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from riskweave.runtime import broadcast_if_small, cut, spread, table

WINDOW, STEPS, SAMPLE, WALKS, STRIDE = 8, 18, 8, 6, 2
#: Least share of the item's words held, most changed words per held word, least words of a stretch, and of a quotation.
HELD, CHANGED, STRETCH, QUOTED = 0.46, 1 / 6, 8, 10
#: An item is cut into parts of PART words; windows must meet in one part for each SPAN words of it, one at least.
PART, SPAN = 8, 32
#: Bits of the map of the items' keys.
BITS = 1 << 24

_TAG = re.compile(r"<[^<>\n]{1,80}>")
_BREAK = re.compile(r"(?<=[^\W\d_])-[ \t]*\r?\n[ \t>#*]*(?=[^\W\d_])")
_WORD = re.compile(r"[^\W_]+")


def words_of(text: str | None) -> list[str]:
    """Words without case, punctuation, markup and line breaks."""
    if not text:
        return []
    if "<" in text:
        text = _TAG.sub(" ", text)
    if "-" in text:
        text = _BREAK.sub("", text)
    return _WORD.findall(text.lower())


def _rng_walks(seed: int = 11) -> tuple[np.ndarray, list[np.ndarray]]:
    rng = np.random.default_rng(seed)
    return rng.integers(1, 1 << 62, WALKS, dtype=np.uint64) | np.uint64(1), [np.sort(rng.choice(STEPS, SAMPLE, replace=False)) for _ in range(WALKS)]


_SALTS, _SAMPLES = _rng_walks()
_GOLD = np.uint64(0x9E3779B97F4A7C15)
_WORDS: dict[str, int] = {}


def _numbers(words: list[str]) -> np.ndarray:
    """A 64-bit number for each word, the same in every process."""
    import xxhash

    if len(_WORDS) > 2_000_000:
        _WORDS.clear()
    out = []
    for w in words:
        h = _WORDS.get(w)
        if h is None:
            h = _WORDS[w] = xxhash.xxh64_intdigest(w)
        out.append(h)
    return np.array(out, np.uint64)


def _mixed(h: np.ndarray) -> np.ndarray:
    h = h * _GOLD
    return h ^ (h >> np.uint64(29))


def _flatten(texts: list[np.ndarray], size: int, stride: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """All texts in one array, the starts of their windows of ``size`` words, and each window's text; shorter texts have none.
    The last window of a text is among its windows."""
    sizes = np.array([len(t) for t in texts], np.int64)
    flat = np.concatenate([*texts, np.zeros(WINDOW, np.uint64)])
    first = np.concatenate([[0], np.cumsum(sizes)])[:-1]
    n = np.where(sizes >= size, -(-(sizes - size) // stride) + 1, 0)
    owner = np.repeat(np.arange(len(texts)), n)
    nth = (np.arange(len(owner)) - np.repeat(np.concatenate([[0], np.cumsum(n)])[:-1], n)) * stride
    return flat, first[owner] + np.minimum(nth, sizes[owner] - size) if len(owner) else np.zeros(0, np.int64), owner


def window_keys(texts: list[np.ndarray], size: int, stride: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(key, text, offset) of every window and walk. Windows below WINDOW words belong to items that allow no change: their
    key is that of all their words."""
    flat, starts, owner = _flatten(texts, size, stride)
    first = np.concatenate([[0], np.cumsum([len(t) for t in texts])])[:-1].astype(np.int64)
    offset = starts - first[owner] if len(owner) else starts
    if size < WINDOW:
        key = np.full(len(starts), size, np.uint64)
        for j in range(size):
            key = _mixed(key ^ flat[starts + j])
        return key.view(np.int64), owner, offset
    keys = []
    for r in range(WALKS):
        moves = _mixed(flat * _SALTS[r])
        at, end = starts.copy(), starts + size
        key = np.full(len(starts), 1000 + r, np.uint64)
        wanted = set(_SAMPLES[r].tolist())
        for j in range(int(_SAMPLES[r][-1]) + 1):
            inside = at < end
            if j in wanted:
                key = _mixed(key ^ np.where(inside, flat[at], np.uint64(1)))
            at = at + (inside & ((moves[at] >> np.uint64(j)) & np.uint64(1)).astype(bool))
        keys.append(key)
    return np.concatenate(keys).view(np.int64), np.tile(owner, WALKS), np.tile(offset, WALKS)


def _trigrams(t: np.ndarray) -> np.ndarray:
    return (t[:-2].astype(np.int64) << 42) | (t[1:-1].astype(np.int64) << 21) | t[2:] if len(t) > 2 else np.zeros(0, np.int64)


def _stretch(x: np.ndarray, y: np.ndarray, least: int) -> tuple[int, int, int, int, int] | None:
    """Best local alignment of x in y (match 1, any edit -2): (x from, to, y from, to, edits); None below ``least`` words.

    Row by row with one row kept: each cell carries in one number where its alignment began and how many edits it has.
    """
    n, m = len(x), len(y)
    if n < least or m < least:
        return None
    place = np.arange(m + 1)
    step = 2 * place
    fresh = place << 16  # i << 42, j << 16, edits
    h, tag = np.zeros(m + 1, np.int64), fresh.copy()
    row, new = np.zeros(m + 1, np.int64), np.zeros(m + 1, np.int64)
    best, got = 0, None
    for i in range(1, n + 1):
        same = y == x[i - 1]
        diag, up = h[:-1] + (3 * same - 2), h[1:] - 2
        across = diag >= up
        top = np.where(across, diag, up)
        begun = fresh + (i << 42)
        new[0] = begun[0]
        new[1:] = np.where(top > 0, np.where(across, tag[:-1] + ~same, tag[1:] + 1), begun[1:])
        np.maximum(top, 0, out=row[1:])
        lifted = row + step
        run = np.maximum.accumulate(lifted)
        k = np.maximum.accumulate(np.where(lifted == run, place, 0))  # where the run of insertions began
        h = run - step
        tag = new[k] + (place - k)
        j = int(h.argmax())
        if h[j] > best:
            best, t = int(h[j]), int(tag[j])
            got = (t >> 42, i, t >> 16 & (1 << 26) - 1, j, t & 0xFFFF)
    return got if got and got[1] - got[0] >= least else None


def _near(x: np.ndarray, doc: np.ndarray) -> np.ndarray:
    """The parts of ``doc`` within len(x) words of a trigram of x; as many words of no item stand between two parts as no
    alignment can bridge. Every stretch that counts shares a trigram with the item, so none is lost."""
    n = len(x)
    hit = np.flatnonzero(np.isin(_trigrams(doc), _trigrams(x)))
    if not len(hit):
        return doc[:0]
    if len(doc) <= 4 * n:
        return doc
    out, a, b = [], max(0, int(hit[0]) - n), int(hit[0]) + n + 3
    for h in hit[1:].tolist():
        if h - n > b:
            out += [doc[a:b], np.zeros(n, doc.dtype)]
            a = h - n
        b = h + n + 3
    return np.concatenate([*out, doc[a:b]])


def holds(item: list[str], doc: list[str]) -> bool:
    """Whether the document holds the item: at least HELD of its words, and QUOTED words where it has as many, in order in
    one or two stretches of STRETCH words or more, with at most CHANGED of them changed. An item below STRETCH words must be
    held whole and unchanged.
    """
    n = len(item)
    if not n:
        return False
    vocab = {w: k for k, w in enumerate(dict.fromkeys(item), 1)}  # 0: a word that isn't the item's
    x, y = np.array([vocab[w] for w in item], np.int32), np.array([vocab.get(w, 0) for w in doc], np.int32)
    if n < STRETCH:
        return len(y) >= n and bool((np.lib.stride_tricks.sliding_window_view(y, n) == x).all(1).any())
    need = max(HELD * n, min(n, QUOTED))
    # held words in two stretches have two trigrams less each, and a change spoils three at most
    if int(np.isin(_trigrams(x), _trigrams(y)).sum()) < need - 4 - 3 * CHANGED * need:
        return False
    y = _near(x, y)
    best = _stretch(x, y, STRETCH)
    if best is None:
        return False
    i0, i1, j0, j1, changed = best
    held = i1 - i0
    if held < need:
        more = [s for s in (_stretch(x[:i0], y[:j0], STRETCH), _stretch(x[i1:], y[j1:], STRETCH)) if s]
        if more:
            a = max(more, key=lambda s: s[1] - s[0])
            held, changed = held + a[1] - a[0], changed + a[4]
    return held >= need and changed <= CHANGED * held


def item_windows(items: DataFrame) -> DataFrame:
    """(key, item_id, part, need, size): the keys of all windows of the items, the part of the item each lies in, and in how
    many parts of it windows must meet."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            words = [_numbers(words_of(t)) for t in b.column(1).to_pylist()]
            for size in sorted({min(len(w), WINDOW) for w in words} - {0}):
                rows = [i for i, w in enumerate(words) if min(len(w), WINDOW) == size]
                key, owner, offset = window_keys([words[i] for i in rows], size, 1)
                need = np.array([max(1, len(words[i]) // SPAN) for i in rows])
                ids = b.column(0).take(pa.array(np.array(rows)[owner]))
                yield pa.RecordBatch.from_arrays([pa.array(key), ids, pa.array((offset // PART % 64).astype(np.int32)), pa.array(need[owner].astype(np.int32)), pa.array(np.full(len(key), size, np.int32))], names=["key", "item_id", "part", "need", "size"])

    return items.select("item_id", "text").mapInArrow(run, f"key bigint, item_id {dict(items.dtypes)['item_id']}, part int, need int, size int").distinct()


def key_map(keys: DataFrame) -> np.ndarray:
    """A bit map of BITS bits with the bits of all ``key`` set: BITS / 8 bytes, whatever the number of keys."""
    at = keys.select(F.pmod("key", F.lit(BITS)).cast("int").alias("at")).distinct()
    out = np.zeros(BITS // 8, np.uint8)
    for r in at.groupBy(F.shiftright("at", 14).alias("chunk")).agg(F.collect_list(F.col("at").bitwiseAND(F.lit((1 << 14) - 1)).cast("short")).alias("bits")).toLocalIterator():
        i = r["chunk"] * (1 << 14) + np.array(r["bits"], np.int64)
        np.bitwise_or.at(out, i >> 3, (1 << (i & 7)).astype(np.uint8))
    return out


def document_keys(docs: DataFrame, sizes: list[int], known: np.ndarray) -> DataFrame:
    """(doc_id, key): the keys of the documents' windows of the items' sizes that the map ``known`` has."""
    shared = docs.sparkSession.sparkContext.broadcast(known)  # BITS / 8 bytes

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        bits = shared.value
        for b in batches:
            for lo in range(0, b.num_rows, 500):
                part = b.slice(lo, 500)
                texts = [_numbers(words_of(t)) for t in part.column(1).to_pylist()]
                for size in sizes:
                    key, owner, _ = window_keys(texts, size, STRIDE if size == WINDOW else 1)
                    at = key % BITS
                    ok = (bits[at >> 3] >> (at & 7).astype(np.uint8)) & 1 == 1
                    if ok.any():
                        x = np.unique(np.stack([owner[ok], key[ok]], 1), axis=0)
                        yield pa.RecordBatch.from_arrays([part.column(0).take(pa.array(x[:, 0])), pa.array(x[:, 1])], names=["doc_id", "key"])

    return docs.mapInArrow(run, f"doc_id {dict(docs.dtypes)['doc_id']}, key bigint")


def leaks(docs: DataFrame, items: DataFrame) -> DataFrame:
    """(doc_id, item_id): documents with the items they hold, distinct.

    ``docs`` has doc_id and text, ``items`` item_id and text; null and empty texts hold and are held by nothing. Ids are
    taken as unique; of repeated ones each text counts.
    """
    d = spread(docs.select("doc_id", "text"))
    t = items.where("text is not null").select("item_id", "text")
    w = cut(item_windows(t))
    sizes = sorted(r[0] for r in w.select("size").distinct().collect())  # at most WINDOW
    met = document_keys(d, sizes, key_map(w)).join(broadcast_if_small(w), "key").groupBy("doc_id", "item_id")
    met = met.agg(F.bit_or(F.call_function("shiftleft", F.lit(1).cast("long"), F.col("part"))).alias("parts"), F.max("need").alias("need"))
    pairs = cut(met.where(F.bit_count("parts") >= F.col("need")).select("doc_id", "item_id"))
    j = pairs.join(d.withColumnRenamed("text", "doc"), "doc_id").join(broadcast_if_small(t.withColumnRenamed("text", "item"), 20_000), "item_id").select("doc_id", "item_id", "doc", "item")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        last: tuple = (None, [])
        for b in batches:
            ok = []
            for doc, item in zip(b.column(2).to_pylist(), b.column(3).to_pylist(), strict=True):
                if last[0] != doc:
                    last = (doc, words_of(doc))
                ok.append(holds(words_of(item), last[1]))
            yield pa.RecordBatch.from_arrays([b.column(0), b.column(1)], names=["doc_id", "item_id"]).filter(pa.array(ok, pa.bool_()))

    return j.mapInArrow(run, f"doc_id {dict(docs.dtypes)['doc_id']}, item_id {dict(items.dtypes)['item_id']}").distinct()


def p8_found(spark: SparkSession, d: str) -> DataFrame:
    return leaks(table(spark, d, "documents", "doc_id", "text"), table(spark, d, "eval_items", "item_id", "text"))


QUERIES = {"p8_found": p8_found}
ORACLE: dict = {}
