"""Problem 5: each new batch against all history, by a segment index for bounded edit distance.

A text is written as the string of its distinct word tokens in sorted order. On such strings the edit distance with
insertions and deletions is the size of the symmetric difference of the token sets, so a Jaccard overlap of at least t is
the bound  d(a, b) <= (1 - t) / (1 + t) x (|a| + |b|).

A stored string of length n is cut into k + 1 segments of fixed number and place, where k is the largest distance the
bound allows for any partner (partners are at most n / t long). By the pigeonhole principle a partner within the bound
holds at least one segment unchanged, at most k places off. A segment is stored under (group, length, number, hash).
A probe enumerates, for each length a partner may have, the substrings that can be a segment of such a string, and looks
them up; every hit is then verified exactly. ``SegmentIndex`` keeps the segments and token strings of what was accepted in a
folder; a batch is decided against them and among itself, and what it adds is appended. Texts of history are never read
again, and repeats of history add nothing to it.
"""

from __future__ import annotations

import uuid

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from riskweave.runtime import cut, drop, shared_folder, table

T = 0.8


def token_string(c: str | Column) -> Column:
    """Distinct word tokens (runs of letters, digits, ``_``; case ignored) as 64-bit hashes, in sorted order."""
    words = F.array_distinct(F.filter(F.split(F.lower(c), r"(?U)[^\w]+"), lambda x: x != ""))
    return F.array_sort(F.transform(words, lambda x: F.xxhash64(x)))


def _sketch() -> Column:
    """31 bits with one bit set for each token: sets that differ in d tokens have sketches that differ in at most d bits."""
    return F.aggregate("toks", F.lit(0), lambda a, x: a.bitwiseOR(F.call_function("shiftleft", F.lit(1), F.pmod(F.shiftrightunsigned(x, 32), F.lit(31)).cast("int")))).alias("bits")


def _bound(n: Column, t: float) -> Column:
    """Largest distance allowed between a string of length n and any partner of at most n / t tokens."""
    return F.floor((1 - t) / (1 + t) * (n + F.floor(n / t + 1e-9)) + 1e-9).cast("int")


def _key(seg: Column) -> Column:
    """One 64-bit key for (group, length, segment number, segment); a chance clash only adds a pair to verify."""
    return F.xxhash64("grp", "n", "no", seg)


def segments(strings: DataFrame, t: float = T) -> DataFrame:
    """(key, id, bits): the k + 1 segments of each string of ``strings`` (grp, id, ord, toks). Appending is a union of these."""
    n = F.size("toks")
    s = strings.where(n > 0).select("grp", "id", "toks", _sketch(), n.alias("n"), F.least(_bound(n, t) + 1, n).alias("k1"))
    s = s.withColumn("no", F.explode(F.sequence(F.lit(0), F.col("k1") - 1)))
    at = lambda i: F.floor(i * F.col("n") / F.col("k1")).cast("int")
    return s.select(_key(F.slice("toks", at(F.col("no")) + 1, at(F.col("no") + 1) - at(F.col("no")))).alias("key"), "id", "bits")


def probes(strings: DataFrame, t: float = T, longer: bool = True) -> DataFrame:
    """(key, id, bits, d): for each possible partner length n the substrings that may equal segment ``no``, multi-match-aware.

    A segment of a partner of length n that starts at p appears in the probe (length m) at p + s, where the shift s is the
    surplus of tokens inserted before it over those deleted. Over the whole string the surplus is m - n, in d edits at
    most. Hence at most (d + m - n) / 2 insertions and (d - m + n) / 2 deletions, and s and (m - n) - s keep to them. Of
    several unchanged segments one is enough: the first segment with fewer edits before it than its number, and, from the
    right, fewer edits after it than segments follow, so that |s| <= no and |(m - n) - s| <= k - no. Without ``longer`` only partners up to the probe's own
    length are sought: enough where every string is both stored and a probe.
    """
    m = F.size("toks")
    s = strings.where(m > 0).select("grp", "id", "toks", _sketch(), m.alias("m"))
    top = F.floor(F.col("m") / t + 1e-9).cast("int") if longer else F.col("m")
    s = s.withColumn("n", F.explode(F.sequence(F.ceil(F.col("m") * t - 1e-9).cast("int"), top)))
    s = s.withColumn("d", F.floor((1 - t) / (1 + t) * (F.col("m") + F.col("n")) + 1e-9).cast("int")).withColumn("k1", F.least(_bound(F.col("n"), t) + 1, F.col("n")))
    s = s.withColumn("no", F.explode(F.sequence(F.lit(0), F.col("k1") - 1)))
    at = lambda i: F.floor(i * F.col("n") / F.col("k1")).cast("int")
    more = F.col("m") - F.col("n")
    ins, dele = F.floor((F.col("d") + more) / 2).cast("int"), F.floor((F.col("d") - more) / 2).cast("int")
    left, right = F.col("no"), F.col("k1") - 1 - F.col("no")
    low = F.greatest(-F.least(dele, left), more - F.least(ins, right))
    high = F.least(F.least(ins, left), more + F.least(dele, right))
    s = s.withColumn("p", at(F.col("no"))).withColumn("len", at(F.col("no") + 1) - at(F.col("no")))
    s = s.withColumn("lo", F.greatest(F.lit(0), F.col("p") + low)).withColumn("hi", F.least(F.col("m") - F.col("len"), F.col("p") + high)).where("lo <= hi")
    s = s.select("grp", "id", "bits", "d", "toks", "n", "no", "len", F.explode(F.sequence("lo", "hi")).alias("q"))
    return s.select(_key(F.slice("toks", F.col("q") + 1, F.col("len"))).alias("key"), "id", "bits", F.col("d").cast("short").alias("d"))


def _similar(a: Column, b: Column, t: float) -> Column:
    """|a & b| / |a | b| >= t as integers: (n + m) (t / (1 + t)) <= |a & b|."""
    return F.size(F.array_intersect(a, b)) * (1 + t) >= (F.size(a) + F.size(b)) * t - 1e-9


def links(history: DataFrame, batch: DataFrame | None = None, t: float = T) -> DataFrame:
    """(a, b, a_ord, b_ord): verified pairs of an earlier string a (history) and a later string b (batch); exact.

    Both are (grp, id, ord, toks); ``ord`` orders arrival. Without ``batch`` all pairs within ``history`` are found. The
    join is on one key of (group, length, segment number, segment), so a group of any size is spread by its segments; the
    sketches drop nearly all chance meetings in the join itself.
    """
    x = history if batch is None else history.unionByName(batch)
    h = segments(history, t).select("key", F.col("id").alias("a"), F.col("bits").alias("a_bits"))
    p = probes(history if batch is None else batch, t, longer=batch is not None).withColumnRenamed("id", "b")
    c = h.join(p, "key").where((F.col("a") != F.col("b")) & (F.bit_count(F.col("a_bits").bitwiseXOR(F.col("bits"))) <= F.col("d")))
    c = c.select("a", "b").distinct()
    if batch is None:
        c = c.select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b")).distinct()
    y = x.select("id", "ord", "toks")
    v = c.join(y.alias("x"), F.col("a") == F.col("x.id")).select("a", "b", F.col("x.ord").alias("a_ord"), F.col("x.toks").alias("a_toks"))
    v = v.join(y.alias("y"), F.col("b") == F.col("y.id")).select("a", "b", "a_ord", "a_toks", F.col("y.ord").alias("b_ord"), F.col("y.toks").alias("b_toks"))
    v = v.where(_similar(F.col("a_toks"), F.col("b_toks"), t))
    if batch is not None:
        return v.where("a_ord < b_ord").select("a", "b", "a_ord", "b_ord")
    early = F.col("a_ord") < F.col("b_ord")
    pick = lambda p, q, name: F.when(early, F.col(p)).otherwise(F.col(q)).alias(name)
    return v.select(pick("a", "b", "a"), pick("b", "a", "b"), pick("a_ord", "b_ord", "a_ord"), pick("b_ord", "a_ord", "b_ord"))


def decide(pairs: DataFrame) -> DataFrame:
    """(first, dup): b repeats the earliest linked a that itself repeats nothing.

    A string without an earlier link is a first; a string whose linked firsts are known repeats the earliest of them; one
    linked only to repeats is a first itself. The rule is applied in arrival order until nothing is open: each round
    decides every string all of whose earlier partners are decided, so the number of rounds is the longest chain of links,
    not the number of batches or rows; each round reads only what is still open.
    """
    open_, done = pairs, None
    while True:
        left = open_.select("b").distinct()
        # a partner that is no open b is a first
        state = open_.join(left.select(F.col("b").alias("a"), F.lit(True).alias("a_open")), "a", "left")
        g = state.groupBy("b").agg(
            F.min(F.struct("a_ord", "a", F.coalesce("a_open", F.lit(False)).alias("undecided"))).alias("least"),
            F.min(F.when(F.col("a_open").isNull(), F.struct("a_ord", "a"))).alias("first"),
        )
        # the earliest partner is a first: decided, as no earlier one can come
        now = cut(g.where(~F.col("least.undecided")).select(F.col("least.a").alias("first"), F.col("b").alias("dup")))
        done, old = now if done is None else cut(done.unionByName(now)), done
        drop(old)
        gone = now.select(F.col("dup").alias("x"))
        rest = open_.join(gone, open_["b"] == gone["x"], "left_anti")
        rest, old = cut(rest.join(gone, rest["a"] == gone["x"], "left_anti")), open_
        drop(old)
        if rest.isEmpty():
            return done
        open_ = rest


def finding_strings(df: DataFrame) -> DataFrame:
    """(grp, id, ord, toks) of ``findings``; the group is (repo, rule_id).

    Null evidence and evidence without word tokens give an empty string, which repeats nothing. Null repo or rule_id form
    groups of their own. Repeated deliveries of a finding stay; they are copies of each other.
    """
    return df.where("finding_id is not null").select(
        F.xxhash64("repo", F.isnull("repo"), "rule_id", F.isnull("rule_id")).alias("grp"),
        F.col("finding_id").alias("id"),
        F.struct(F.coalesce("batch_no", F.lit(2147483647)).alias("b"), F.col("finding_id").alias("i")).alias("ord"),
        F.coalesce(token_string("evidence"), F.array().cast("array<bigint>")).alias("toks"),
    )


def _classes(strings: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(strings with their class, one string a class): exact copies are one class, for which its earliest string stands.

    A class is named by two independent 64-bit hashes of group and tokens. Empty strings repeat nothing and are left out.
    """
    w = strings.where(F.size("toks") > 0).withColumn("c1", F.xxhash64("grp", "toks")).withColumn("c2", F.xxhash64("toks", F.lit(1), "grp"))
    reps = w.groupBy("c1", "c2").agg(F.min("ord").alias("ord"), F.first("grp").alias("grp"), F.first("toks").alias("toks"))
    return w, cut(reps.select("c1", "c2", "grp", F.col("ord.i").alias("id"), "ord", "toks"))


def _inherit(w: DataFrame, reps: DataFrame, d: DataFrame) -> DataFrame:
    """(first_id, dup_id) of all strings from the decisions ``d`` on the classes; a copy inherits its class's first."""
    of = reps.select("c1", "c2", "id").join(d, F.col("id") == F.col("dup"), "left").select("c1", "c2", F.coalesce("first", "id").alias("first_id"))
    return w.select("c1", "c2", "id").join(of, ["c1", "c2"]).where("id <> first_id").select("first_id", F.col("id").alias("dup_id")).distinct()


def repeats(strings: DataFrame, t: float = T) -> DataFrame:
    """(first_id, dup_id) over all of ``strings``, every batch against what came before it.

    Exact copies are collapsed first, so a group of copies of any size costs one string. Copies need not be linked to each
    other; each inherits its class's first.
    """
    w, reps = _classes(strings)
    return _inherit(w, reps, decide(cut(links(reps.select("grp", "id", "ord", "toks"), t=t))))


class SegmentIndex:
    """The index of accepted strings in a folder all executors share.

    Each accepted batch is three tables under its number: ``segments`` (key, id, bits) and ``strings`` (grp, id, ord, toks)
    of its firsts, and ``repeats`` (first_id, dup_id), which is written last. A batch whose adding was cut short is written
    anew under the same number.
    """

    def __init__(self, spark: SparkSession, path: str, t: float = T):
        self.spark, self.path, self.t = spark, path.rstrip("/"), t

    def batches(self) -> int:
        """Number of batches accepted so far."""
        jvm, conf = self.spark.sparkContext._jvm, self.spark.sparkContext._jsc.hadoopConfiguration()
        n = 0
        while True:
            p = jvm.org.apache.hadoop.fs.Path(f"{self.path}/repeats/{n}/_SUCCESS")
            if not p.getFileSystem(conf).exists(p):
                return n
            n += 1

    def _read(self, name: str, n: int) -> DataFrame:
        return self.spark.read.parquet(*[f"{self.path}/{name}/{i}" for i in range(n)])

    def add(self, batch: DataFrame) -> DataFrame:
        """(first_id, dup_id) of ``batch`` (grp, id, ord, toks), whose strings arrive after all that the index holds.

        Only the batch is probed; of the index the segments are read, and the token strings of those that a probe meets.
        """
        n = self.batches()
        w, reps = _classes(batch)
        rest, known = reps, None
        if n:
            p = probes(reps, self.t).withColumnRenamed("id", "b")
            h = self._read("segments", n).select("key", F.col("id").alias("a"), F.col("bits").alias("a_bits"))
            c = h.join(p, "key").where(F.bit_count(F.col("a_bits").bitwiseXOR(F.col("bits"))) <= F.col("d")).select("a", "b").distinct()
            old = self._read("strings", n).select(F.col("id").alias("a"), F.col("ord").alias("a_ord"), F.col("toks").alias("a_toks"))
            v = c.join(old, "a").join(reps.select(F.col("id").alias("b"), "toks"), "b").where(_similar(F.col("a_toks"), F.col("toks"), self.t))
            known = cut(v.groupBy("b").agg(F.min(F.struct("a_ord", "a")).alias("x")).select(F.col("x.a").alias("first"), F.col("b").alias("dup")))
            rest = cut(reps.join(known.select(F.col("dup").alias("id")), "id", "left_anti"))
        d = decide(cut(links(rest.select("grp", "id", "ord", "toks"), t=self.t)))
        firsts = rest.join(d.select(F.col("dup").alias("id")), "id", "left_anti")
        segments(firsts, self.t).write.mode("overwrite").parquet(f"{self.path}/segments/{n}")
        firsts.select("grp", "id", "ord", "toks").write.mode("overwrite").parquet(f"{self.path}/strings/{n}")
        _inherit(w, reps, d if known is None else d.unionByName(known)).write.mode("overwrite").parquet(f"{self.path}/repeats/{n}")
        return self.spark.read.parquet(f"{self.path}/repeats/{n}")


def p5_found(spark: SparkSession, d: str) -> DataFrame:
    return repeats(finding_strings(table(spark, d, "findings", "finding_id", "batch_no", "repo", "rule_id", "evidence")))


def p5_last_batch(spark: SparkSession, d: str) -> DataFrame:
    """The repeats in the last batch, against an index of all batches before it."""
    s = cut(finding_strings(table(spark, d, "findings", "finding_id", "batch_no", "repo", "rule_id", "evidence")))
    last = s.agg(F.max("ord.b")).first()[0]
    index = SegmentIndex(spark, f"{shared_folder(spark)}/{uuid.uuid4().hex}")
    index.add(s.where(F.col("ord.b") < F.lit(last)))
    return index.add(s.where(F.col("ord.b") == F.lit(last)))


QUERIES = {"p5_found": p5_found, "p5_last_batch": p5_last_batch}
# a class without earlier links is a first; one linked to such firsts repeats the earliest of them
ORACLE = {
    "p5_found": r"""with f as (select distinct finding_id as id, coalesce(batch_no, 2147483647) as b, coalesce(repo, chr(1)) || chr(2) || coalesce(rule_id, chr(1)) as grp,
  list_sort(list_distinct(list_filter(regexp_split_to_array(lower(evidence), '[^\p{L}\p{N}\p{M}_]+'), lambda x: x <> ''))) as toks from findings where finding_id is not null),
 c as (select grp, toks, min(row(b, id)) as o from f where len(toks) > 0 group by 1, 2),
 l as (select x.o as a, y.o as b from c x join c y on x.grp = y.grp and x.o < y.o and len(x.toks) >= 0.8 * len(y.toks) and len(y.toks) >= 0.8 * len(x.toks)
  where 1.8 * len(list_intersect(x.toks, y.toks)) >= 0.8 * (len(x.toks) + len(y.toks)) - 1e-9),
 d as (select b, min(a) as a from l where a not in (select b from l) group by 1),
 r as (select c.grp, c.toks, coalesce(d.a, c.o) as first from c left join d on c.o = d.b)
select distinct r.first[2] as first_id, f.id as dup_id from f join r using (grp, toks) where r.first[2] <> f.id""",
}
