"""Column functions on text, paths and scores; all of them stay in the JVM."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# The path and negation patterns.
TEST_PATH = r"(?i)((^|/)(tests?|__tests__|fixtures?|mocks?|examples?|samples?|demos?)(/)|conftest|_test\.|\.test\.|(^|/)test_|\.spec\.)"
NEGATION = r"(?i)\b(no|not|without|lacks?|missing|skip|bypass|disabled?|todo|fixme)\b"
LINE_BREAK = r"\r\n|[\n\r\x0B\f\x1C\x1D\x1E\x85  ]"


def _c(c: str | Column) -> Column:
    return F.col(c) if isinstance(c, str) else c


def is_test_path(path: str | Column) -> Column:
    return F.coalesce(_c(path).rlike(TEST_PATH), F.lit(False))


def split_lines(text: str | Column) -> Column:
    """Lines at any line break; a final break opens no further line; null and empty texts have no lines."""
    t = F.regexp_replace(_c(text), rf"({LINE_BREAK})\z", "")
    return F.when(F.coalesce(F.length(_c(text)), F.lit(0)) == 0, F.array().cast("array<string>")).otherwise(F.split(t, LINE_BREAK))


def strip_comment(line: str | Column) -> Column:
    """A line up to its first ``#`` and then its first ``//``; URLs are cut as well, on purpose."""
    return F.substring_index(F.substring_index(_c(line), "#", 1), "//", 1)


def squeeze(s: str | Column) -> Column:
    """Without white space at either end."""
    return F.regexp_replace(_c(s), r"^\s+|\s+$", "")


def snippet(line: str | Column, size: int = 200) -> Column:
    return F.substring(squeeze(line), 1, size)


def location(file: str | Column, line: str | Column) -> Column:
    """``file:line``, or the file alone where the line is 0 or null."""
    return F.when(F.coalesce(_c(line), F.lit(0)) == 0, _c(file)).otherwise(F.concat(_c(file), F.lit(":"), _c(line).cast("string")))


def fingerprint(rule_id: str | Column, file: str | Column, evidence: str | Column) -> Column:
    """First 16 hex digits of SHA-1 over rule, file and squeezed evidence; nulls count as empty."""
    z = lambda x: F.coalesce(x, F.lit(""))
    return F.substring(F.sha1(F.concat_ws("|", z(_c(rule_id)), z(_c(file)), z(squeeze(evidence)))), 1, 16)


def clamp01(x: str | Column) -> Column:
    """Limited to 0..1; null and NaN count as 0."""
    c = _c(x)
    return F.when(c.isNull() | F.isnan(c), F.lit(0.0)).otherwise(F.least(F.lit(1.0), F.greatest(F.lit(0.0), c)))


def severity_name(c: str | Column = "severity") -> Column:
    return F.upper(F.trim(_c(c)))


def detector_name(c: str | Column = "detector") -> Column:
    return F.lower(F.translate(F.trim(_c(c)), "_", "-"))


def grade(score: str | Column) -> Column:
    s = _c(score)
    return F.when(s >= 90, "A").when(s >= 75, "B").when(s >= 60, "C").when(s >= 40, "D").otherwise("F")


def module_key(path: str | Column) -> Column:
    """Path segments without the suffix."""
    return F.split(F.regexp_replace(_c(path), r"\.[^./]*$", ""), "/")


def redact_url(s: str | Column) -> Column:
    """User and password of URLs taken out."""
    return F.regexp_replace(_c(s), r"(://)[^/@\s]*@", "$1")


def duration_seconds(c: str | Column) -> Column:
    """Seconds of ``45s``, ``30m``, ``6h``, ``1d``; null for anything else."""
    t = F.lower(F.trim(_c(c)))
    n = F.regexp_extract(t, r"^(\d+)\s*([smhd])$", 1)
    u = F.regexp_extract(t, r"^(\d+)\s*([smhd])$", 2)
    unit = F.when(u == "s", 1).when(u == "m", 60).when(u == "h", 3600).when(u == "d", 86400)
    return F.when(n != "", n.cast("long") * unit)


def money(c: str | Column) -> Column:
    return F.concat(F.lit("$"), F.format_number(_c(c), 0))
