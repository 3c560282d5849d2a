import statistics
from collections import Counter

from riskweave.operators.heavy_keys import heavy_keys, key_percentiles, key_summary

ROWS = [("a", float(i % 7)) for i in range(300)] + [("b", 1.0), ("b", None), ("c", None), (None, 2.0), (None, 2.0), ("d", float("nan")), ("d", 3.0)]


def frame(spark, rows=ROWS):
    return spark.createDataFrame([(*r, "x") for r in rows], "k string, v double, _w string")


def test_summary_equals_brute_force(spark):
    got = {r["k"]: r for r in key_summary(frame(spark), "k", "v").collect()}
    for k in {"a", "b", "c", "d", None}:
        vs = [v for kk, v in ROWS if kk == k]
        ok = [v for v in vs if v is not None and v == v]
        assert got[k]["n"] == len(vs) and got[k]["n_values"] == len(set(ok))
        if ok:
            c = Counter(ok)
            assert abs(got[k]["mean"] - statistics.fmean(ok)) < 1e-12
            assert got[k]["mode"] == min(c, key=lambda v: (-c[v], v))
        else:
            assert got[k]["mean"] is None and got[k]["mode"] is None


def test_percentiles_are_exact(spark):
    rows = [("a", float(i * i % 101)) for i in range(997)] + [("b", 5.0)]
    got = {(r["k"], r["p"]): r["value"] for r in key_percentiles(frame(spark, rows), "k", "v", [0.0, 0.25, 0.5, 1.0], bins=8).collect()}
    assert {(r["k"], r["p"]): r["value"] for r in key_percentiles(frame(spark, [*rows, ("a", 1e300)]), "k", "v", [0.5], bins=8).collect()}["a", 0.5] == sorted([v for k, v in rows if k == "a"] + [1e300])[498]
    a = sorted(v for k, v in rows if k == "a")
    import math

    for p in (0.0, 0.25, 0.5, 1.0):
        assert got["a", p] == a[max(1, math.ceil(p * len(a))) - 1] and got["b", p] == 5.0


def test_heavy_keys_and_empty(spark):
    df = spark.createDataFrame([("r1", i) for i in range(50)] * 2 + [("r2", 100), ("r2", None), (None, 7)], "k string, u int")
    assert [tuple(r) for r in heavy_keys(df, "k", "u", 0.5).collect()] == [("r1", 50)]
    assert heavy_keys(df.limit(0), "k", "u", 0.5).count() == 0 and key_summary(df.limit(0), "k", "u").count() == 0
