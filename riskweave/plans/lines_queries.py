"""Queries over lines of files."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from riskweave.functions.text import module_key, split_lines, strip_comment
from riskweave.operators.crossmodule import unambiguous
from riskweave.plans.findings_queries import _LINES
from riskweave.runtime import table


def line_stats(spark: SparkSession, d: str) -> DataFrame:
    """Lines, lines with code and greatest length by suffix."""
    f = table(spark, d, "files", "suffix", "text").where("text is not null and text <> ''")
    x = f.select(F.lower("suffix").alias("suffix"), F.explode(split_lines("text")).alias("raw"))
    return x.groupBy("suffix").agg(F.count(F.lit(1)).alias("lines"), F.sum((F.trim(strip_comment("raw")) != "").cast("int")).alias("code_lines"), F.max(F.length("raw")).alias("longest"))


def role_before_line(spark: SparkSession, d: str) -> DataFrame:
    """For each return statement of a Python file, the name of the last function defined at most seven lines before.

    The last match in a frame of lines, as an array slice: no shuffle.
    """
    f = table(spark, d, "files", "file_id", "suffix", "text").where("lower(suffix) = '.py' and text is not null and text <> ''")
    p = r"^\s*(?:async )?def (\w+)"
    x = f.select("file_id", split_lines("text").alias("ls"))
    at = F.filter(F.sequence(F.lit(1), F.size("ls")), lambda i: F.element_at("ls", i).rlike(r"^\s*return\b"))
    x = x.select("file_id", "ls", F.explode(at).alias("line"))
    first = F.greatest(F.lit(1), F.col("line") - 7)
    names = F.filter(F.transform(F.slice("ls", first, F.col("line") - first + 1), lambda s: F.regexp_extract(s, p, 1)), lambda v: v != "")
    return x.select("file_id", "line", F.when(F.size(names) > 0, F.element_at(names, -1)).alias("fn"))


def module_keys(spark: SparkSession, d: str) -> DataFrame:
    """Modules by their last segment, where one file of a repo alone has it."""
    f = table(spark, d, "files", "file_id", "repo", "path").select("repo", "file_id", F.element_at(module_key("path"), -1).alias("name"))
    return unambiguous(f, ["repo"], "name", "file_id").select("repo", "name", "file_id")


def enclosing_function(spark: SparkSession, d: str) -> DataFrame:
    """Assignments to fields of JavaScript files with the nearest line above that opens a function; an as-of join.

    Per-file windows over lines; a file is the unit of both sides, so its lines are the most a task holds of it at once.
    """
    f = table(spark, d, "files", "file_id", "suffix", "text").where("lower(suffix) = '.js' and text is not null and text <> ''")
    x = f.select("file_id", F.posexplode(split_lines("text")).alias("p", "raw"))
    opened = F.last(F.when(F.col("raw").rlike(r"^(async )?function (\w+)"), F.regexp_extract("raw", r"^(?:async )?function (\w+)", 1)), ignorenulls=True)
    x = x.withColumn("fn", opened.over(Window.partitionBy("file_id").orderBy("p").rowsBetween(Window.unboundedPreceding, 0)))
    return x.where(F.col("raw").rlike(r"^  \w+\.\w+ = ")).select("file_id", (F.col("p") + 1).alias("line"), "fn")


QUERIES = {f.__name__: f for f in (line_stats, role_before_line, module_keys, enclosing_function)}
_L = f"f as (select file_id, repo, path, lower(suffix) as suffix, {_LINES} as ls from files where text is not null and text <> ''), l as (select file_id, suffix, unnest(ls) as raw, unnest(range(1, len(ls) + 1))::int as line from f)"
ORACLE = {
    "line_stats": f"with {_L} select suffix, count(*) as lines, count(*) filter (where trim(split_part(split_part(raw, '#', 1), '//', 1), ' ') <> '') as code_lines, max(length(raw))::int as longest from l group by suffix",
    "role_before_line": f"""with {_L}, w as (select *, last_value(nullif(regexp_extract(raw, '^\\s*(?:async )?def (\\w+)', 1), '') ignore nulls) over (partition by file_id order by line rows between 7 preceding and current row) as fn from l where suffix = '.py')
 select file_id, line, fn from w where regexp_matches(raw, '^\\s*return\\b')""",
    "module_keys": r"with m as (select repo, file_id, list_extract(string_split(regexp_replace(path, '\.[^./]*$', ''), '/'), -1) as name from files) select repo, name, min(file_id) as file_id from m group by 1, 2 having count(distinct file_id) = 1",
    "enclosing_function": f"""with {_L}, w as (select *, last_value(nullif(regexp_extract(raw, '^(?:async )?function (\\w+)', 1), '') ignore nulls) over (partition by file_id order by line rows between unbounded preceding and current row) as fn from l where suffix = '.js')
 select file_id, line, fn from w where regexp_matches(raw, '^  \\w+\\.\\w+ = ')""",
}
