"""Deterministic fixes of single lines, and their verification by re-scanning."""

from __future__ import annotations

import re
from collections.abc import Callable

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

_TORCH = re.compile(r"\btorch\.load\s*\(")
_YAML = re.compile(r"\byaml\.load\s*\(")


def closing(s: str, at: int) -> int:
    """Place of the bracket that closes the one at ``at``, or -1."""
    depth = 0
    for i, c in enumerate(s[at:], at):
        depth += (c == "(") - (c == ")")
        if c == ")" and depth == 0:
            return i
    return -1


def fix_line(rule_id: str, title: str, line: str) -> str | None:
    """The line with its unsafe load made safe; None where no safe edit within the line is known."""
    kind = (title or "").lower()
    if rule_id != "ORTHO-SUPPLY-001":
        return None
    if "torch.load" in kind and "weights_only" not in line and (m := _TORCH.search(line)):
        end = closing(line, m.end() - 1)
        if end < 0:
            return None
        comma = ", " if line[m.end() : end].strip() else ""
        return f"{line[:end]}{comma}weights_only=True{line[end:]}"
    if "yaml.load" in kind and "Loader" not in line and _YAML.search(line):
        return _YAML.sub("yaml.safe_load(", line, count=1)
    return None


def candidate_fixes(findings: DataFrame, files: DataFrame) -> DataFrame:
    """(finding_id, repo, file, line, old, new, text): proposed file texts; every other line and all line ends stay.

    ``findings`` needs finding_id, repo, file, line, rule_id, title; ``files`` repo, path, text. Only files with a fixable
    finding are read.
    """
    f = findings.where("line > 0 and rule_id = 'ORTHO-SUPPLY-001'").select("finding_id", "repo", "file", "line", "rule_id", "title")
    j = f.join(files.where("text is not null").select("repo", F.col("path").alias("file"), "text"), ["repo", "file"])

    @F.pandas_udf("struct<old string, new string, text string>")
    def propose(line, rule, title, text):
        import pandas as pd

        rows = []
        for n, r, t, x in zip(line, rule, title, text, strict=True):
            parts = x.splitlines(keepends=True)
            old = new = None
            if n <= len(parts):
                old = parts[n - 1].rstrip("\r\n")
                new = fix_line(r, t, old)
            ok = new is not None and new != old
            rows.append((old if ok else None, new if ok else None, "".join([*parts[: n - 1], new + parts[n - 1][len(old) :], *parts[n:]]) if ok else None))
        return pd.DataFrame(rows, columns=["old", "new", "text"])

    x = j.withColumn("p", propose("line", "rule_id", "title", "text"))
    return x.where("p.new is not null").select("finding_id", "repo", "file", "line", "p.old", "p.new", "p.text")


def verified(fixes: DataFrame, scan: Callable[[DataFrame], DataFrame], before: DataFrame) -> DataFrame:
    """Fixes after which the finding is gone and no new HIGH or CRITICAL finding stands in its file.

    ``scan`` maps files (file_id, repo, path, suffix, text) to findings (file_id, fingerprint, sev_value); each candidate
    is scanned by itself, under the finding's id. ``before`` has finding_id, repo, file, fingerprint, sev_value.
    """
    files = fixes.select(F.col("finding_id").alias("file_id"), "repo", F.col("file").alias("path"), F.concat(F.lit("."), F.regexp_extract("file", r"\.([^./]+)$", 1)).alias("suffix"), "text")
    after = scan(files).select(F.col("file_id").alias("finding_id"), "fingerprint", "sev_value")
    mine = before.select("finding_id", "fingerprint")
    still = after.join(mine, ["finding_id", "fingerprint"]).select("finding_id")
    old = fixes.select("finding_id", "repo", "file").join(before.select("repo", "file", "fingerprint"), ["repo", "file"]).select("finding_id", "fingerprint").distinct()
    worse = after.where("sev_value >= 4").join(old, ["finding_id", "fingerprint"], "left_anti").select("finding_id")
    return fixes.join(still.unionByName(worse).distinct(), "finding_id", "left_anti")


def fenced_code(answer: str, original: str, least: float = 0.4) -> str | None:
    """The code block of a model's answer, unless it is much shorter than the original."""
    m = re.search(r"```[\w-]*\n(.*?)```", answer or "", re.S)
    code = m[1] if m else None
    return code if code and len(code) >= least * len(original) else None
