"""Queries over Python syntax facts, and fix-points over the driver's tables."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from riskweave.operators.facts import python_facts, syntax_facts
from riskweave.operators.fixpoint import reach
from riskweave.operators.taint import syntax_findings
from riskweave.runtime import cut, table


def python_rules(spark: SparkSession, d: str) -> DataFrame:
    """R01, R12-R14, R16-R18 on Python files, by syntax, within and across files."""
    files = table(spark, d, "files", "file_id", "repo", "path", "suffix", "text")
    return syntax_findings(files, cut(python_facts(files)))


def syntax_rules(spark: SparkSession, d: str) -> DataFrame:
    """R01, R12-R14, R16-R18 on all languages with syntax facts: Python, JavaScript, TypeScript, Go, Java, Kotlin, C#, PHP, Rust."""
    files = table(spark, d, "files", "file_id", "repo", "path", "suffix", "text")
    return syntax_findings(files, cut(syntax_facts(files)))


def fact_counts(spark: SparkSession, d: str) -> DataFrame:
    """Facts by kind over all Python files."""
    return python_facts(table(spark, d, "files", "file_id", "suffix", "text"), whole=True).groupBy("tag").agg(F.count(F.lit(1)).alias("facts"), F.countDistinct("file_id").alias("files"))


def part_reach(spark: SparkSession, d: str) -> DataFrame:
    """X19, X20 at scale: regions reachable from parts over suppliers and nations, as a fix-point on edges."""
    node = lambda kind, c: F.concat(F.lit(kind), F.col(c).cast("string"))
    ps = table(spark, d, "lineitem", "l_partkey", "l_suppkey").select(F.pmod("l_partkey", F.lit(10)).alias("g"), node("s", "l_suppkey").alias("node")).distinct()
    sn = table(spark, d, "supplier", "s_suppkey", "s_nationkey").select(node("s", "s_suppkey").alias("src"), node("n", "s_nationkey").alias("dst"))
    nr = table(spark, d, "nation", "n_nationkey", "n_regionkey").select(node("n", "n_nationkey").alias("src"), node("r", "n_regionkey").alias("dst"))
    back = nr.select(F.col("dst").alias("src"), F.col("src").alias("dst"))  # makes the graph cyclic
    e = sn.unionByName(nr).unionByName(back).withColumn("g", F.explode(F.sequence(F.lit(0).cast("bigint"), F.lit(9).cast("bigint"))))
    return reach(e, ps, ["g"]).groupBy("g").agg(F.count(F.lit(1)).alias("nodes"))


QUERIES = {f.__name__: f for f in (python_rules, syntax_rules, fact_counts, part_reach)}
ORACLE = {
    "part_reach": """with recursive e as (select 's' || s_suppkey as src, 'n' || s_nationkey as dst from supplier union select 'n' || n_nationkey, 'r' || n_regionkey from nation union select 'r' || n_regionkey, 'n' || n_nationkey from nation),
 t as (select distinct l_partkey % 10 as g, 's' || l_suppkey as node from lineitem union select t.g, e.dst from t join e on e.src = t.node)
 select g, count(*) as nodes from t group by g""",
}
