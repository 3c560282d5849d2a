"""Checks across modules: imports, re-exports, calls and parameters of other files of a repo."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from riskweave.functions.text import module_key
from riskweave.operators.brace_facts import LANGUAGES
from riskweave.operators.fixpoint import chains, reach
from riskweave.operators.taint import tagged, tool_functions
from riskweave.runtime import cut


def modules(files: DataFrame) -> DataFrame:
    """(repo, file_id, key): module keys of Python files; a package's ``__init__`` is also known by its folder."""
    m = files.where(F.lower("suffix") == ".py").select("repo", "file_id", module_key("path").alias("key"))
    pkg = m.where(F.element_at("key", -1) == "__init__").select("repo", "file_id", F.slice("key", 1, F.size("key") - 1).alias("key")).where(F.size("key") > 0)
    return m.unionByName(pkg)


def import_targets(facts: DataFrame, mods: DataFrame) -> DataFrame:
    """(file_id, local, name, target): imports resolved to files of the same repo.

    An absolute import meets every module whose key ends in its segments, by an equality on exploded suffixes, and counts
    only when one file fits. A relative import is exact. ``name`` is the imported name, or null for a module.
    """
    i = tagged(facts, "import").select("file_id", F.col("n1").alias("level"), "s1", "s2", F.col("s3").alias("local"))
    i = i.join(mods.select("file_id", "repo", F.col("key").alias("own")).dropDuplicates(["file_id"]), "file_id")
    segs = F.filter(F.split("s1", r"\."), lambda x: x != "")
    # from a import b: b is a name of a, or the module a.b
    plain = i.withColumn("segs", segs).withColumn("name", F.col("s2"))
    sub = i.where("s2 is not null").withColumn("segs", F.concat(segs, F.array("s2"))).withColumn("name", F.lit(None).cast("string"))
    x = plain.unionByName(sub)
    rel = F.concat(F.slice("own", 1, F.greatest(F.lit(0), F.size("own") - F.col("level"))), F.col("segs"))
    x = x.withColumn("want", F.array_join(F.when(F.col("level") > 0, rel).otherwise(F.col("segs")), "/")).where("want <> ''")
    ends = mods.select("repo", F.col("file_id").alias("target"), F.explode(F.transform(F.sequence(F.lit(1), F.size("key")), lambda k: F.struct(F.array_join(F.slice("key", k, F.size("key")), "/").alias("want"), (k == 1).alias("whole")))).alias("e")).select("repo", "target", "e.want", "e.whole")
    j = x.join(ends, ["repo", "want"]).where((F.col("level") == 0) | F.col("whole")).where("target <> file_id")
    g = j.groupBy("file_id", "local", "name", "want").agg(F.min("target").alias("target"), F.max("target").alias("other"))
    return g.where("target = other").select("file_id", "local", "name", "target").distinct()


def resolved_names(facts: DataFrame, mods: DataFrame, hops: int = 6) -> DataFrame:
    """(file_id, local, target, fn): imported functions at the file that defines them, through at most ``hops`` re-exports."""
    t = import_targets(facts, mods).where("name is not null")
    at = lambda f, n: F.concat(F.col(f).cast("string"), F.lit("|"), F.col(n))
    links = t.select(at("file_id", "local").alias("src"), at("target", "name").alias("dst")).distinct()
    end = chains(links, hops).withColumnRenamed("src", "_s").withColumnRenamed("dst", "_d")
    defs = tagged(facts, "func").select(F.col("file_id").alias("target"), F.col("s1").alias("fn")).distinct()
    defs = defs.withColumn("_d", at("target", "fn"))
    k = t.select("file_id", "local").distinct().withColumn("_s", at("file_id", "local"))
    return k.join(end, "_s").join(defs, "_d").select("file_id", "local", "target", "fn")


def resolved_calls(facts: DataFrame, mods: DataFrame) -> DataFrame:
    """(file_id, n1, line, target, fn): calls of functions of other files, by imported name or as module.function."""
    c = tagged(facts, "call").where("scope = ''").select("file_id", "n1", "line", "s1", "s2").distinct()
    names = resolved_names(facts, mods)
    names = cut(names)
    a = c.where("s1 = ''").join(names.withColumnRenamed("local", "s2"), ["file_id", "s2"]).select("file_id", "n1", "line", "target", "fn")
    m = import_targets(facts, mods).where("name is null").select("file_id", F.col("local").alias("s1"), "target")
    defs = tagged(facts, "func").select(F.col("file_id").alias("target"), F.col("s1").alias("fn")).distinct()
    b = c.where("s1 <> ''").join(m, ["file_id", "s1"]).withColumnRenamed("s2", "fn").join(defs, ["target", "fn"]).select("file_id", "n1", "line", "target", "fn")
    return a.unionByName(b).distinct()


def named_calls(facts: DataFrame, files: DataFrame) -> DataFrame:
    """(file_id, n1, line, target, fn): calls of functions of other files in languages without resolvable imports: a name
    counts when exactly one file of the repo and language defines it, and the caller's file does not."""
    lang = F.element_at(F.create_map(*[F.lit(x) for kv in LANGUAGES.items() for x in kv]), F.lower("suffix"))
    own = files.select("file_id", "repo", lang.alias("lang")).where("lang is not null")
    defs = tagged(facts, "func").where("s1 <> ''").select("file_id", F.col("s1").alias("fn")).distinct().join(own, "file_id")
    one = unambiguous(defs, ["repo", "lang"], "fn", "file_id").withColumnRenamed("file_id", "target")
    c = tagged(facts, "call").where("scope = ''").select("file_id", "n1", "line", F.col("s2").alias("fn")).distinct().join(own, "file_id")
    return c.join(one, ["repo", "lang", "fn"]).where("target <> file_id").select("file_id", "n1", "line", "target", "fn")


def _handed_over(facts: DataFrame, calls: DataFrame, mark: str) -> DataFrame:
    """(file_id, line, kind): arguments with ``mark`` that meet a summarized parameter of another file."""
    s = tagged(facts, "summary").select(F.col("file_id").alias("target"), F.col("s1").alias("fn"), F.col("n2").alias("pos"), F.col("s2").alias("param"), F.col("s3").alias("kind"))
    a = tagged(facts, "arg").where(mark).select("file_id", "n1", "n2", F.col("s1").alias("kw"))
    j = calls.join(s, ["target", "fn"]).join(a, ["file_id", "n1"]).where("kw = param or (kw is null and n2 = pos)")
    return j.groupBy("file_id", "line").agg(F.min(F.when(F.col("kind") != "prompt", F.col("kind"))).alias("kind"), F.max((F.col("kind") == "prompt")).alias("prompt"))


def cross_module_sinks(facts: DataFrame, mods: DataFrame, calls: DataFrame | None = None) -> DataFrame:
    """(file_id, line, kind): model output handed to a function of another file whose parameter reaches a sink."""
    return _handed_over(facts, resolved_calls(facts, mods) if calls is None else calls, "b2").where("kind is not null").select("file_id", "line", "kind")


def cross_module_prompts(facts: DataFrame, mods: DataFrame, calls: DataFrame | None = None) -> DataFrame:
    """(file_id, line): untrusted input handed to a function of another file whose parameter becomes a system prompt."""
    return _handed_over(facts, resolved_calls(facts, mods) if calls is None else calls, "b3").where("prompt").select("file_id", "line")


def cross_module_tools(facts: DataFrame, mods: DataFrame, calls: DataFrame | None = None) -> DataFrame:
    """(file_id, tool, line, asks, target, capability): capabilities of other files that a tool reaches over calls between
    files; ``line`` is the tool's own. Only what tools reach is followed."""
    f = tagged(facts, "func").select("file_id", "scope", F.col("s1").alias("fn"))
    node = lambda a, b: F.concat(F.col(a).cast("string"), F.lit("|"), F.col(b))
    inner = tagged(facts, "call").where("scope <> ''").join(f, ["file_id", "scope"]).select("file_id", "n1", "fn", "s1", "s2").distinct()
    names = f.select("file_id", F.col("fn").alias("s2")).distinct()
    local = inner.where("s1 = ''").join(names, ["file_id", "s2"]).select(node("file_id", "fn").alias("src"), node("file_id", "s2").alias("dst"))
    calls = resolved_calls(facts, mods) if calls is None else calls
    far = inner.select("file_id", "n1", F.col("fn").alias("caller")).join(calls, ["file_id", "n1"]).select(node("file_id", "caller").alias("src"), node("target", "fn").alias("dst"))
    tools = tool_functions(facts).select("file_id", F.col("fn").alias("tool"), "asks", node("file_id", "fn").alias("start"))
    r = reach(local.unionByName(far), tools.select("start", F.col("start").alias("node")), ["start"], by_key=False)
    cap = tagged(facts, "sink").select(node("file_id", "s1").alias("node"), F.col("file_id").alias("target"), F.col("s2").alias("capability")).distinct()
    at = tagged(facts, "func").groupBy("file_id", F.col("s1").alias("tool")).agg(F.min("line").alias("line"))
    x = tools.join(r, "start").join(cap, "node").where("target <> file_id").join(at, ["file_id", "tool"])
    return x.select("file_id", "tool", "line", "asks", "target", "capability").distinct()


def unambiguous(names: DataFrame, by: list[str], name: str, owner: str) -> DataFrame:
    """Names defined by exactly one ``owner`` within ``by``: the join key of languages without resolvable imports."""
    g = names.groupBy(*by, name).agg(F.min(owner).alias(owner), F.max(owner).alias("_m"))
    return g.where(F.col(owner) == F.col("_m")).drop("_m")
