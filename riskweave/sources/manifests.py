"""Dependency manifests (pip lines, npm JSON) as tables, and the dependency rules over them."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from riskweave.functions.text import split_lines

# Packages of the AI ecosystem (matched as substrings) and patterns of sources and pins.
AI_PACKAGES = "langchain llama-index llama_index llamaindex openai anthropic transformers torch tensorflow keras huggingface sentence-transformers chromadb pinecone weaviate qdrant faiss litellm guidance crewai autogen semantic-kernel instructor dspy vllm ollama cohere google-generativeai groq mistralai haystack @anthropic-ai @langchain @huggingface @google/generative-ai @mistralai ai-sdk".split()
PIP_SOURCE = r"(?i)\b(git\+|https?://|file:|svn\+|hg\+)"
PIP_INDEX = r"(?i)^\s*--(extra-)?index-url\s+"
PIP_HOME = r"(?i)^\s*--(extra-)?index-url\s+https://pypi\.org"
PIP_PIN = r"==\s*[0-9]"
NPM_SOURCE = r"(?i)^(git\+|https?://|file:|github:|git://|link:)"
NPM_LOOSE = r"^[\^~]|\*|^latest$|^>=|\bx\b|^\s*$"
NPM_EXACT = r"^\d+\.\d+\.\d+([-+].+)?$"
SECTIONS = ["dependencies", "devDependencies", "optionalDependencies"]


def is_ai_package(name: str | Column) -> Column:
    n = F.lower(F.trim(name))
    return F.exists(F.array(*map(F.lit, AI_PACKAGES)), lambda p: F.contains(n, p))


def pip_requirements(files: DataFrame) -> DataFrame:
    """(file_id, line, raw, req, package, version) of requirements files; blank and comment lines are left out."""
    f = files.where(F.col("path").rlike(r"(?i)(^|/)([^/]*requirements[^/]*\.txt|constraints\.txt)$") & F.col("text").isNotNull())
    x = f.select("file_id", F.posexplode(split_lines("text")).alias("p", "raw")).withColumn("req", F.regexp_replace("raw", r"^\s+|\s+$", ""))
    x = x.where((F.col("req") != "") & ~F.col("req").startswith("#"))
    v = F.regexp_extract("req", r"==\s*([A-Za-z0-9_.\-+!]+)", 1)
    return x.select("file_id", (F.col("p") + 1).alias("line"), "raw", "req", F.split("req", r"[<>=!~;\[\s]", 2)[0].alias("package"), F.when(v != "", v).alias("version"))


def npm_dependencies(files: DataFrame) -> DataFrame:
    """(file_id, line, section, package, spec) of package.json files; a file that is no JSON has none."""
    f = files.where(F.col("path").rlike(r"(^|/)package\.json$") & F.col("text").isNotNull()).select("file_id", "text")
    maps = F.array(*[F.struct(F.lit(s).alias("section"), F.from_json(F.get_json_object("text", f"$.{s}"), "map<string,string>").alias("deps")) for s in SECTIONS])
    x = f.select("file_id", split_lines("text").alias("ls"), F.explode(maps).alias("m")).select("file_id", "ls", "m.section", F.explode("m.deps").alias("package", "spec"))
    quoted = F.concat(F.lit('"'), F.col("package"), F.lit('"'))
    at = F.filter(F.sequence(F.lit(1), F.size("ls")), lambda i: F.contains(F.element_at("ls", i), quoted))
    return x.select("file_id", F.coalesce(F.get(at, 0), F.lit(1)).alias("line"), "section", "package", "spec")


def dependency_findings(files: DataFrame) -> DataFrame:
    """(file_id, rule_id, line, package, severity): loosely pinned AI packages and untrusted install sources."""
    p = pip_requirements(files)
    other = F.col("req").rlike(PIP_INDEX) & ~F.col("req").rlike(PIP_HOME)
    source = F.col("req").rlike(PIP_SOURCE)
    loose = is_ai_package("package") & ~F.col("req").rlike(PIP_PIN)
    rule = F.when(other | (source & ~F.col("req").rlike(PIP_INDEX)), "ORTHO-DEP-002").when(loose & ~F.col("req").rlike(PIP_INDEX), "ORTHO-DEP-001")
    a = p.withColumn("rule_id", rule).select("file_id", "rule_id", "line", "package")
    n = npm_dependencies(files).where(is_ai_package("package") & F.col("spec").isNotNull())
    b = n.withColumn("rule_id", F.when(F.col("spec").rlike(NPM_SOURCE), "ORTHO-DEP-002").when(F.col("spec").rlike(NPM_LOOSE), "ORTHO-DEP-001")).select("file_id", "rule_id", "line", "package")
    x = a.unionByName(b).where("rule_id is not null")
    return x.withColumn("severity", F.when(F.col("rule_id") == "ORTHO-DEP-002", "HIGH").otherwise("LOW"))


def advisories_for(files: DataFrame, advisories: DataFrame) -> DataFrame:
    """(file_id, line, package, version, title): exactly pinned AI packages with known advisories, the first six named.

    ``advisories`` is an offline table (ecosystem, name, version, ids); it is joined, never asked over a network.
    """
    p = pip_requirements(files).where(is_ai_package("package") & F.col("version").isNotNull()).select("file_id", "line", F.lit("PyPI").alias("ecosystem"), "package", "version")
    n = npm_dependencies(files).where(is_ai_package("package") & F.col("spec").rlike(NPM_EXACT)).select("file_id", "line", F.lit("npm").alias("ecosystem"), "package", F.col("spec").alias("version"))
    a = advisories.select("ecosystem", F.col("name").alias("package"), "version", F.array_sort(F.array_distinct("ids")).alias("ids")).where(F.size("ids") > 0)
    more = F.size("ids") - 6
    title = F.concat(F.array_join(F.slice("ids", 1, 6), ", "), F.when(more > 0, F.concat(F.lit(" +"), more.cast("string"), F.lit(" more"))).otherwise(""))
    return p.unionByName(n).join(a, ["ecosystem", "package", "version"]).select("file_id", "line", "package", "version", title.alias("title"))
