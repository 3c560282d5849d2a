"""Problem 9: mixing sources to target weights by systematic sampling.

Every source has a number of expected copies of each of its documents, min(max_repeats, target x total / size). Within a
source the documents' expected copies are prefix-summed, one random offset is added, and a document is emitted once for
each integer boundary its interval crosses: never more often than max_repeats, and all in all exactly the expected number
up to one.

The order within a source is that of a hash of doc_id. Its leading bits cut every source into blocks of about equal
size, so the prefix sum is the block's offset (a sum over at most 2^bits pre-aggregated rows a source) plus the rank in the
block; no task holds a whole source.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from riskweave.llm.tokens import TOKENIZER_DIR, token_count
from riskweave.runtime import broadcast_if_small, cut, spread, table


def source_key(c: str | Column = "source") -> Column:
    """Source names equal up to case, padding and separators."""
    return F.regexp_replace(F.lower(c), r"[\s_\-./]+", "")


def sized(docs: DataFrame, tokenizer_dir: str = TOKENIZER_DIR) -> DataFrame:
    """(doc_id, key, tokens): every row of ``docs`` (doc_id, source, text); null source gives a null key."""
    return spread(docs.select("doc_id", "source", "text")).select("doc_id", source_key().alias("key"), token_count("text", tokenizer_dir).alias("tokens"))


def plan(sizes: DataFrame, targets: DataFrame) -> DataFrame:
    """(source, key, target_share, max_repeats, docs, tokens, total, copies, short): one row a target source.

    ``total`` is the size of all documents, those of sources without a target included. A source without documents, or
    whose documents have no tokens, gets 0 copies and is short when its target is above 0.
    """
    per = sizes.groupBy("key").agg(F.count(F.lit(1)).alias("docs"), F.sum("tokens").alias("tokens"))
    per = cut(per)  # one row a source, so that the texts are read once for both uses
    total = per.agg(F.coalesce(F.sum("tokens"), F.lit(0))).first()[0]
    t = targets.select("source", "target_share", "max_repeats").dropDuplicates(["source"]).withColumn("key", source_key())
    x = t.join(per.where("key is not null"), "key", "left").withColumn("total", F.lit(total).cast("long")).fillna(0, ["docs", "tokens"])
    want = F.col("target_share") * F.col("total")
    x = x.withColumn("copies", F.when(F.col("tokens") > 0, F.least(F.col("max_repeats").cast("double"), want / F.col("tokens"))).otherwise(0.0))
    return x.withColumn("short", F.col("max_repeats") * F.col("tokens") < want)


def systematic(sizes: DataFrame, mix: DataFrame, seed: int = 7, bits: int = 12) -> DataFrame:
    """(doc_id, source, tokens, copies): documents with at least one copy. ``doc_id`` is taken as unique."""
    m = mix.select("key", "source", F.col("copies").alias("e")).where("e > 0")
    h = sizes.join(broadcast_if_small(m), "key").withColumn("h", F.xxhash64("doc_id", F.lit(seed)))  # one row a target source
    h = h.withColumn("blk", F.shiftrightunsigned("h", 64 - bits))
    per = h.groupBy("source", "blk").agg(F.count(F.lit(1)).alias("n"))
    per = per.withColumn("before", F.sum("n").over(Window.partitionBy("source").orderBy("blk")) - F.col("n")).drop("n")
    x = h.join(per, ["source", "blk"]).withColumn("rank", F.col("before") + F.row_number().over(Window.partitionBy("source", "blk").orderBy("h", "doc_id")))
    # one offset in [0, 1) a source
    u = F.pmod(F.xxhash64("source", F.lit(seed)), F.lit(1 << 20)) / F.lit(float(1 << 20))
    n = F.floor(F.col("rank") * F.col("e") + u) - F.floor((F.col("rank") - 1) * F.col("e") + u)
    return x.withColumn("copies", n.cast("int")).where("copies > 0").select("doc_id", "source", "tokens", "copies")


def _sizes(spark: SparkSession, d: str) -> DataFrame:
    return sized(table(spark, d, "documents", "doc_id", "source", "text"))


def p9_copies(spark: SparkSession, d: str) -> DataFrame:
    """The mixture: each document taken, with its number of copies."""
    s = cut(_sizes(spark, d))
    return systematic(s, plan(s, table(spark, d, "mix_targets")))


def p9_report(spark: SparkSession, d: str) -> DataFrame:
    """Target and actual shares of each source, the repeats used, and whether it falls short."""
    s = cut(_sizes(spark, d))
    p = cut(plan(s, table(spark, d, "mix_targets")))
    got = systematic(s, p).groupBy("source").agg(F.sum("copies").alias("copies_taken"), F.sum(F.col("copies") * F.col("tokens")).alias("tokens_taken"))
    x = p.select("source", "target_share", "max_repeats", "docs", "tokens", "total", F.round("copies", 6).alias("repeats")).join(got, "source", "left").fillna(0, ["copies_taken", "tokens_taken"])
    x = cut(x)  # one row a target source
    # a source falls short when every one of its documents is used as often as it may be, and that is not enough
    x = x.withColumn("short", (F.col("tokens_taken") == F.col("max_repeats") * F.col("tokens")) & (F.col("tokens_taken") < F.col("target_share") * F.col("total"))).drop("total")
    taken = x.agg(F.coalesce(F.sum("tokens_taken"), F.lit(0))).first()[0]
    return x.withColumn("actual_share", F.round(F.col("tokens_taken") / F.lit(max(taken, 1)), 6))


def p9_found(spark: SparkSession, d: str) -> DataFrame:
    """The sources that fall short, by the copies drawn."""
    return p9_report(spark, d).where("short").select("source")


QUERIES = {"p9_found": p9_found, "p9_copies": p9_copies, "p9_report": p9_report}
ORACLE: dict = {}
