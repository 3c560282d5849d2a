import hashlib
import math
import random

from pyspark.sql import functions as F

from riskweave.functions import text as T
from riskweave.operators import findings as fd
from riskweave.operators import marts
from riskweave.operators.dims import OWASP, OWASP_CONTROLS, SEVERITIES


def test_text_functions(spark):
    rows = [("a\r\nb\rc\n",), ("",), (None,), ("x # y // z\nhttps://h/p",), ("one\x0ctwo\x85three four",)]
    got = spark.createDataFrame(rows, "t string").select(T.split_lines("t")).collect()
    assert [r[0] for r in got] == [["a", "b", "c"], [], [], ["x # y // z", "https://h/p"], ["one", "two", "three", "four"]]
    x = spark.createDataFrame([("x # y // z", "tests/a.py", 0.5), ("https://h/p", "src/a.py", float("nan"))], "t string, p string, c double")
    got = [tuple(r) for r in x.select(T.strip_comment("t"), T.is_test_path("p"), T.clamp01("c"), T.location("p", F.lit(0)), T.location("p", F.lit(3))).collect()]
    assert got == [("x ", True, 0.5, "tests/a.py", "tests/a.py:3"), ("https:", False, 0.0, "src/a.py", "src/a.py:3")]


def test_fingerprint_is_sha1(spark):
    r = spark.createDataFrame([("R", "fä.py", "\t é \n")], "r string, f string, e string").select(T.fingerprint("r", "f", "e")).first()[0]
    assert r == hashlib.sha1("R|fä.py|é".encode()).hexdigest()[:16]


def _score(rows):
    w = {s[0]: s[2] for s in SEVERITIES}
    seen, p = {}, 0.0
    for o, s, c in rows:
        n = seen.get((o, s), 0)
        seen[o, s] = n + 1
        p += w[s] * 0.6**n * min(1, max(0, c))
    return round(100 * math.exp(-p / 100))


def test_posture_equals_brute_force(spark):
    rnd = random.Random(4)
    rows = []
    for scan in range(5):
        for i in range(40 * scan):
            rows.append((scan * 1000 + i, scan, rnd.choice(list(OWASP)), rnd.choice(SEVERITIES)[0], rnd.random() * 1.4 - 0.2, f"f{i % 3}", i, 0, i, "deterministic" if i % 9 else "advisory"))
    df = spark.createDataFrame(rows, "finding_id long, scan_id int, owasp_llm string, severity string, confidence double, file string, line int, det_ord int, emit_ord int, confidence_tier string").withColumn("sev_value", F.element_at(fd.sev_values(), F.col("severity")))
    got = {r["scan_id"]: r["score"] for r in marts.posture(df).collect()}
    val = {s[0]: s[1] for s in SEVERITIES}
    for scan in range(1, 5):
        mine = sorted([r for r in rows if r[1] == scan and r[9] != "advisory"], key=lambda r: (-val[r[3]], -min(1, max(0, r[4])), r[5], r[6]))
        assert got[scan] == _score([(r[2], r[3], r[4]) for r in mine])
    assert 0 not in got


def test_suppression(spark):
    text = "x = 1  # riskweave: ignore\n# riskweave: ignore[LLM03]\ny = 2\nz = 3 // riskweave: ignore R-9\nw = 4\n"
    files = spark.createDataFrame([("r", "a.py", text)], "repo string, path string, text string")
    f = spark.createDataFrame([(i, "r", "a.py", line, owasp, rule) for i, (line, owasp, rule) in enumerate([(1, "LLM01", "A"), (3, "LLM03", "A"), (3, "LLM01", "A"), (4, "LLM01", "r-9"), (5, "LLM01", "R-9"), (0, "LLM01", "A")])], "finding_id int, repo string, file string, line int, owasp_llm string, rule_id string")
    assert sorted(r[0] for r in fd.inline_suppressed(f, files).collect()) == [0, 1, 3]


def test_not_near_baseline_and_diff(spark):
    k = spark.createDataFrame([("r", "a", 10), ("r", "a", 1)], "repo string, file string, line int")
    c = spark.createDataFrame([(i, "r", "a", i) for i in range(0, 16)] + [(99, "r", "b", 10), (100, None, "a", 10)], "finding_id int, repo string, file string, line int")
    near = {i for i in range(16) if abs(i - 10) <= 2 or abs(i - 1) <= 2}
    assert {r[0] for r in fd.not_near(c, k).select("finding_id").collect()} == ({*range(16), 99, 100} - near)
    f = spark.createDataFrame([("AB",), ("cd",), (None,)], "fingerprint string")
    assert sorted(str(r[0]) for r in fd.without_baseline(f, spark.createDataFrame([("ab ",), (None,)], "fingerprint string")).collect()) == ["None", "cd"]
    d = fd.new_and_gone(f, spark.createDataFrame([("cd",), ("ef",)], "fingerprint string"), ["fingerprint"])
    assert {tuple(r) for r in d.where("fingerprint is not null").collect()} == {("ef", "new"), ("AB", "gone")}


def test_marts_small(spark):
    f = spark.createDataFrame([("LLM01", "R1"), ("LLM01", "R2"), ("LLM99", "R3")], "owasp_llm string, rule_id string")
    got = marts.compliance(f).collect()
    assert len(got) == len(OWASP_CONTROLS["LLM01"]) and all(r["rules"] == ["R1", "R2"] for r in got)
    cases = spark.createDataFrame([("A", True, True), ("A", False, True), ("B", True, False), ("C", False, False)], "category string, expected boolean, fired boolean")
    pr = {r["category"]: (r["precision"], r["recall"]) for r in marts.precision_recall(cases).collect()}
    assert pr == {"A": (0.5, 1.0), "B": (1.0, 0.0), "C": (1.0, 1.0), "ALL": (0.5, 0.5)}
    st = spark.createDataFrame([(["A"], ["A", "B"], False), (["A"], [], True), (["A"], [], False)], "expect array<string>, fired array<string>, known_miss boolean")
    assert [r["status"] for r in marts.case_status(st).collect()] == ["caught", "known-miss", "REGRESSION"]
