"""Prompt and output guard: the same column expressions in batch and in streams.

A risk is ``label: 'matched text'`` with the first 60 characters of the match. Null and empty texts are clean. A model's
verdict can only add a risk, never take one away; a failing model adds none.
"""

from __future__ import annotations

from collections.abc import Callable
from functools import wraps

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

# Labels and patterns of the guard, in the order in which risks are reported.
INJECTION = [
    ("instruction override", r"(?i)ignore\s+(all\s+|the\s+|any\s+)?(previous|prior|above|earlier)\s+(instructions|prompts|context)"),
    ("instruction override", r"(?i)disregard\s+(all\s+|the\s+|your\s+)?(previous|above|prior|system)"),
    ("persona hijack", r"(?i)you\s+are\s+now\b|new\s+instructions:|from\s+now\s+on\s+you"),
    ("system-prompt exfiltration", r"(?i)(reveal|repeat|print|show|leak)\s+(me\s+)?(your\s+)?(system\s+)?(prompt|instructions)"),
    ("jailbreak", r"(?i)\b(developer\s+mode|jailbreak|DAN\b|do\s+anything\s+now|unfiltered)\b"),
    ("guardrail bypass", r"(?i)\b(bypass|override|turn\s+off|disable)\b.{0,20}\b(safety|guardrail|filter|policy|restriction)"),
    ("delimiter breakout", r"</?(system|assistant|instructions)\s*>|```\s*system"),
]
OUTPUT_RISK = [
    ("leaked credential", r"\b(sk-(?:proj-|ant-)?[A-Za-z0-9_-]{20,}|AKIA[0-9A-Z]{16}|AIza[0-9A-Za-z_-]{35})\b"),
    ("executable payload", r"(?i)(<script\b|javascript:|onerror\s*=|eval\s*\(|document\.cookie)"),
    ("system-prompt leak", r"(?i)(my\s+system\s+prompt\s+is|i\s+was\s+instructed\s+to|the\s+instructions\s+i\s+received)"),
]


def _quoted(s: Column) -> Column:
    """In quotes, with line breaks and tabs written out."""
    t = F.replace(F.replace(F.replace(F.replace(s, F.lit("\\"), F.lit("\\\\")), F.lit("\n"), F.lit("\\n")), F.lit("\t"), F.lit("\\t")), F.lit("\r"), F.lit("\\r"))
    plain = F.concat(F.lit("'"), t, F.lit("'"))
    double = F.concat(F.lit('"'), t, F.lit('"'))
    both = F.concat(F.lit("'"), F.replace(t, F.lit("'"), F.lit("\\'")), F.lit("'"))
    return F.when(~s.contains("'"), plain).when(~s.contains('"'), double).otherwise(both)


def risks(text: str | Column, rules: list[tuple[str, str]]) -> Column:
    """The risks of a text, as an array of strings; empty for a clean, empty or null text."""
    t = F.coalesce(F.col(text) if isinstance(text, str) else text, F.lit(""))
    each = [F.when(t.rlike(p), F.concat(F.lit(label + ": "), _quoted(F.substring(F.regexp_extract(t, p, 0), 1, 60)))) for label, p in rules]
    return F.filter(F.array(*each), lambda x: x.isNotNull())


def labels(text: str | Column, rules: list[tuple[str, str]]) -> Column:
    """The labels alone, each once."""
    t = F.coalesce(F.col(text) if isinstance(text, str) else text, F.lit(""))
    return F.array_distinct(F.filter(F.array(*[F.when(t.rlike(p), F.lit(label)) for label, p in rules]), lambda x: x.isNotNull()))


def guard_result(text: str | Column, where: str = "prompt", model_risk: Column | None = None) -> Column:
    """struct<ok, risks, where> of a prompt or an output; ``model_risk`` is a further risk or null."""
    r = risks(text, INJECTION if where == "prompt" else OUTPUT_RISK)
    if model_risk is not None:
        r = F.concat(r, F.filter(F.array(model_risk), lambda x: x.isNotNull()))
    return F.struct((F.size(r) == 0).alias("ok"), r.alias("risks"), F.lit(where).alias("where"))


def model_risk(model: Callable, text: str | Column, threshold: float = 0.5) -> Column:
    """Risk string of an optional model, ``model(list of texts) -> list of (label, score)``; null where it is benign or fails."""

    @F.pandas_udf("string")
    def of(s):
        import pandas as pd

        try:
            got = model(s.fillna("").tolist())
        except Exception:  # fail open: the patterns still stand
            return pd.Series([None] * len(s), dtype=object)
        benign = {"safe", "benign", "ok", "label_0", "legit"}
        return pd.Series([f"model: {a} {b:.2f}" if a and str(a).lower() not in benign and b >= threshold else None for a, b in got], dtype=object)

    return of(text)


def _text_of(v: Column) -> Column:
    """Text of a content value: a string, or the texts of its blocks joined by line breaks."""
    blocks = F.from_json(v, "array<struct<type:string,text:string,content:string>>")
    joined = F.array_join(F.filter(F.transform(blocks, lambda b: F.coalesce(b["text"], b["content"])), lambda x: x.isNotNull()), "\n")
    return F.when(v.startswith("["), F.coalesce(joined, v)).otherwise(v)


def prompt_text(body: str | Column) -> Column:
    """Text of a request body: contents of its messages, then ``prompt`` and ``input``, joined by line breaks; a ``system``
    text is the application's own and isn't looked at.

    A body that is no JSON object has none (null).
    """
    b = F.col(body) if isinstance(body, str) else body
    m = F.from_json(F.get_json_object(b, "$.messages"), "array<map<string,string>>")
    parts = F.concat(F.coalesce(F.transform(m, lambda x: _text_of(F.element_at(x, "content"))), F.array().cast("array<string>")), F.array(*[_text_of(F.get_json_object(b, f"$.{k}")) for k in ("prompt", "input")]))
    t = F.array_join(F.filter(parts, lambda x: x.isNotNull() & (x != "")), "\n")
    return F.when(F.get_json_object(b, "$").startswith("{"), t)


def output_text(body: str | Column) -> Column:
    """Text of a response body: its choices' messages or texts, and its content blocks, joined by line breaks."""
    b = F.col(body) if isinstance(body, str) else body
    c = F.from_json(F.get_json_object(b, "$.choices"), "array<struct<message:struct<content:string>,text:string>>")
    parts = F.concat(F.coalesce(F.flatten(F.transform(c, lambda x: F.array(_text_of(x["message"]["content"]), x["text"]))), F.array().cast("array<string>")), F.array(_text_of(F.get_json_object(b, "$.content")), F.get_json_object(b, "$.output_text")))
    t = F.array_join(F.filter(parts, lambda x: x.isNotNull() & (x != "")), "\n")
    return F.when(F.get_json_object(b, "$").startswith("{"), t)


def inspect(traffic: DataFrame, block: bool = False) -> DataFrame:
    """Requests and responses (id, ts, kind, body) with their verdicts.

    allow is false only for a risky request in block mode; bodies that are no JSON pass.
    """
    text = F.when(F.col("kind") == "request", prompt_text("body")).otherwise(output_text("body"))
    x = traffic.withColumn("text", text)
    r = F.when(F.col("kind") == "request", risks("text", INJECTION)).otherwise(risks("text", OUTPUT_RISK))
    x = x.withColumn("risks", r)
    return x.withColumn("allow", (F.lit(not block) | (F.col("kind") != "request") | (F.size("risks") == 0))).withColumn("text_len", F.length(F.coalesce("text", F.lit("")))).drop("text", "body")


class PromptInjectionError(Exception):
    """Raised by ``guarded`` in block mode."""


def guarded(spark, mode: str = "monitor", prompt_arg: str | None = None, on_risk: Callable | None = None):
    """Decorator around a model call: inputs are scanned before it, its output after it (which never raises)."""

    def scan(text: str, where: str) -> list[str]:
        return spark.createDataFrame([(text,)], "t string").select(guard_result("t", where)["risks"]).first()[0] if text else []

    def wrap(fn: Callable) -> Callable:
        @wraps(fn)
        def call(*args, **kwargs):
            seen = [kwargs[prompt_arg]] if prompt_arg in kwargs else [*args, *kwargs.values()]
            found = scan("\n".join(x for x in seen if isinstance(x, str)), "prompt")
            if found and on_risk:
                on_risk(found, "prompt")
            if found and mode == "block":
                raise PromptInjectionError("; ".join(found))
            out = fn(*args, **kwargs)
            found = scan(out, "output") if isinstance(out, str) else []
            if found and on_risk:
                on_risk(found, "output")
            return out

        return call

    return wrap
