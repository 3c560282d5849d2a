"""Problem 4: a reproducible sample that only grows, by frozen batch bottom-k.

A member belongs to the batch in which it first arrived; of each batch exactly ceil(rate x size) members with the smallest
salted hashes are taken. A batch is immutable once closed, so its choice never changes, and later batches only add.

The k-th hash of a batch is found without sorting it in one task: members are counted by hash range (pre-aggregated),
prefix sums over the ranges name the one range in which the k-th hash lies, and only that range's members are ranked.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from riskweave.runtime import cut, table

RATE = 0.1
SALT = "frozen-v1"


def frozen_sample(df: DataFrame, stratum: str, member: str, batch: str, rate: float = RATE, salt: str = SALT, hex_digits: int = 3) -> DataFrame:
    """(stratum, member, batch): the sampled members.

    Repeated rows of a member count once, in its earliest batch. Rows with a null member or batch are not members and are
    left out. ``rate`` <= 0 gives no rows, >= 1 all. Equal hashes are ordered by member. ``hex_digits`` sets the number of
    hash ranges (16 to that power a batch).
    """
    m = df.select(F.col(stratum).alias("_s"), F.col(member).alias("_m"), F.col(batch).alias("_b")).where("_m is not null and _b is not null")
    m = m.groupBy("_s", "_m").agg(F.min("_b").alias("_b"))
    m = cut(m.withColumn("_h", F.md5(F.concat(F.lit(salt + "|"), F.col("_m")))))
    m = m.withColumn("_r", F.substring("_h", 1, hex_digits))
    per = m.groupBy("_s", "_b", "_r").agg(F.count(F.lit(1)).alias("n"))
    over = Window.partitionBy("_s", "_b")
    per = per.withColumn("upto", F.sum("n").over(over.orderBy("_r"))).withColumn("size", F.sum("n").over(over))
    # rate is a decimal here, so that ceil(0.1 x 30) is 3
    per = per.withColumn("k", F.ceil(F.lit(str(rate)).cast("decimal(12,6)") * F.col("size")).cast("long"))
    edge = per.select(F.col("_s").alias("s2"), F.col("_b").alias("b2"), F.col("_r").alias("r2"), "upto", "n", "k")
    j = m.join(edge, m["_s"].eqNullSafe(edge["s2"]) & (m["_b"] == edge["b2"]) & (m["_r"] == edge["r2"]))
    whole = j.where("upto <= k").select("_s", "_m", "_b")
    part = j.where("upto > k and upto - n < k").withColumn("rn", F.row_number().over(Window.partitionBy("_s", "_b").orderBy("_h", "_m")))
    part = part.where(F.col("rn") <= F.col("k") - (F.col("upto") - F.col("n"))).select("_s", "_m", "_b")
    return whole.unionByName(part).select(F.col("_s").alias(stratum), F.col("_m").alias(member), F.col("_b").alias(batch))


def repo_key(c: str | Column = "repo") -> Column:
    """One spelling of a repo name: case, padding, a trailing ``.git`` and trailing slashes do not count."""
    return F.regexp_replace(F.regexp_replace(F.lower(F.trim(c)), r"/+$", ""), r"\.git$", "")


def members(spark: SparkSession, d: str) -> DataFrame:
    """(kind, member, batch_no): repo@commit of ``per_repo`` and the fingerprints of ``findings`` (letter case aside).

    A failed run without commit and a finding without fingerprint name no member.
    """
    p = table(spark, d, "per_repo", "repo", "commit", "batch_no").select(
        F.lit("repo").alias("kind"), F.concat(repo_key(), F.lit("@"), F.lower(F.trim("commit"))).alias("member"), F.col("batch_no").cast("int").alias("batch_no")
    )
    f = table(spark, d, "findings", "fingerprint", "batch_no").select(
        F.lit("finding").alias("kind"), F.lower(F.trim("fingerprint")).alias("member"), F.col("batch_no").cast("int").alias("batch_no")
    )
    return p.unionByName(f)


def p4_sample(spark: SparkSession, d: str) -> DataFrame:
    """A tenth of the members of each kind and arrival batch."""
    return frozen_sample(members(spark, d), "kind", "member", "batch_no")


QUERIES = {"p4_sample": p4_sample}
ORACLE = {
    "p4_sample": f"""with m as (
 select 'repo' as kind, regexp_replace(regexp_replace(lower(trim(repo)), '/+$', ''), '\\.git$', '') || '@' || lower(trim("commit")) as member, batch_no from per_repo
 union all select 'finding', lower(trim(fingerprint)), batch_no from findings),
 g as (select kind, member, min(batch_no)::int as batch_no from m where member is not null and batch_no is not null group by 1, 2),
 r as (select *, row_number() over (partition by kind, batch_no order by md5('{SALT}|' || member), member) as rn,
  count(*) over (partition by kind, batch_no) as n from g)
select kind, member, batch_no from r where rn <= ceil({RATE}::decimal(12,6) * n)""",
}
