"""Top N, frozen sample, segment index and mixing against brute force, with odd rows."""

import hashlib
import math
import random
import re

import pytest
from pyspark.sql import functions as F

from riskweave.llm import frozen_sample as fs
from riskweave.llm import mixing, ranked
from riskweave.llm import segment_index as si


@pytest.mark.parametrize("parts", [1, 7])
def test_top_n_hot_group(spark, parts):
    rnd = random.Random(1)
    rows = [("hot" if rnd.random() < 0.5 else rnd.choice(["a", "b", None]), rnd.randrange(5), i, "x") for i in range(3000)]
    df = spark.createDataFrame(rows, "g string, s int, id int, position0 string").repartition(parts)
    got = {(r["g"], r["position"], r["id"]) for r in ranked.top_n(df, ["g"], [F.desc("s"), F.asc("id")], 4).collect()}
    want = set()
    for g in {r[0] for r in rows}:
        for p, r in enumerate(sorted((r for r in rows if r[0] == g), key=lambda r: (-r[1], r[2]))[:4], 1):
            want.add((g, p, r[2]))
    assert got == want


def test_top_n_edges(spark):
    df = spark.createDataFrame([("a", 1, i) for i in range(3)], "g string, s int, id int")
    assert ranked.top_n(df.limit(0), ["g"], [F.asc("id")], 2).count() == 0 and ranked.top_n(df, ["g"], [F.asc("id")], 0).count() == 0
    f = spark.createDataFrame([(1, "r", "A_b", " high ", 2.0), (1, "r", "A_b", " high ", 2.0), (2, "r", "a-B", None, None), (3, "r", "a-b", "HIGH", float("nan")), (4, "r", "a-b", "odd", 0.5)], "finding_id int, repo string, detector string, severity string, confidence double")
    o = ranked.top_n(ranked.finding_order(f), ["repo", "detector_key"], [F.asc("sev_rank"), F.asc("neg_conf"), F.asc("finding_id")], 5)
    assert [r["finding_id"] for r in o.orderBy("position").collect()] == [1, 3, 4, 2]


def _members(n, batch):
    return [("k", f"m{batch}-{i}", batch, "extra") for i in range(n)]


def test_frozen_sample_only_grows(spark):
    schema = "stratum string, member string, batch int, _m string"
    one = _members(95, 0) + _members(7, 1)
    more = one + [("k", "m0-3", 2, "late"), ("k", None, 1, ""), ("k", "q", None, ""), ("z", "m0-3", 1, "")] + _members(31, 2) + one[:20]
    a = {tuple(r) for r in fs.frozen_sample(spark.createDataFrame(one, schema), "stratum", "member", "batch").collect()}
    b = {tuple(r) for r in fs.frozen_sample(spark.createDataFrame(more, schema).repartition(5), "stratum", "member", "batch", hex_digits=1).collect()}
    assert a <= b and len(a) == 10 + 1 and len([x for x in b if x[2] == 2]) == 4 and ("z", "m0-3", 1) in b
    h = lambda m: hashlib.md5(f"{fs.SALT}|{m}".encode()).hexdigest()
    assert {x[1] for x in a if x[2] == 0} == set(sorted((m[1] for m in _members(95, 0)), key=h)[: math.ceil(9.5)])
    assert fs.frozen_sample(spark.createDataFrame(one, schema).limit(0), "stratum", "member", "batch").count() == 0


def _brute(rows, t=0.8):
    firsts, out = {}, set()
    for i, b, r, u, e in sorted({x[:5] for x in rows}, key=lambda x: (x[1], x[0])):
        toks = set(re.findall(r"\w+", (e or "").lower()))
        if not toks:
            continue
        mine = firsts.setdefault((r, u), [])
        hit = next((f for f, s in mine if len(s & toks) / len(s | toks) >= t - 1e-12), None)
        if hit is None:
            mine.append((i, toks))
        else:
            out.add((hit, i))
    return out


@pytest.mark.parametrize("seed", range(3))
def test_repeats_equal_brute_force(spark, seed):
    rnd = random.Random(seed)
    words = [f"w{i}" for i in range(60)]
    rows, texts = [], []
    for i in range(260):
        if texts and rnd.random() < 0.6:
            t = rnd.choice(texts).split()
            for _ in range(rnd.randrange(4)):
                if rnd.random() < 0.5 and len(t) > 1:
                    t.pop(rnd.randrange(len(t)))
                else:
                    t.insert(rnd.randrange(len(t) + 1), rnd.choice(words))
        else:
            t = rnd.sample(words, rnd.choice([1, 2, 3, 5, 9, 20, 33]))
        texts.append(" ".join(t))
        rows.append((i, i // 40, "r", "u" if rnd.random() < 0.9 else "v", texts[-1].upper() if i % 5 == 0 else texts[-1], "x"))
    rows += [rows[3], (900, 1, "r", "u", None, "x"), (901, 1, "r", "u", "  !! ", "x"), (902, 1, None, None, "w1 w2", "x"), (903, 2, None, None, "W2 w1", "x")]
    df = spark.createDataFrame(rows, "finding_id int, batch_no int, repo string, rule_id string, evidence string, key string")
    assert {tuple(r) for r in si.repeats(si.finding_strings(df)).collect()} == _brute(rows)


def test_index_of_batches(spark):
    rows = [(1, 0, "r", "u", "a b c d e f g h i j"), (2, 1, "r", "u", "a b c d e f g h i z"), (3, 1, "r", "u", "a b c d e f g h i j k"), (4, 1, "r", "u", "q")]
    s = si.finding_strings(spark.createDataFrame(rows, "finding_id int, batch_no int, repo string, rule_id string, evidence string"))
    got = {(r["a"], r["b"]) for r in si.links(s.where("ord.b = 0"), s.where("ord.b = 1")).collect()}
    assert got == {(1, 2), (1, 3)}
    assert si.segments(s.limit(0)).count() == 0 and si.repeats(s.limit(0)).count() == 0


def test_mixing(spark):
    docs = [(i, "Big " if i % 2 else "big", "word " * 10) for i in range(400)] + [(1000 + i, "small-one", "word " * 10) for i in range(10)] + [(2000, None, None), (2001, "other", ""), (2002, "other", "text")]
    d = spark.createDataFrame(docs, "doc_id int, source string, text string")
    t = spark.createDataFrame([("big", 0.5, 2), ("Small_One", 0.4, 3), ("gone", 0.1, 5)], "source string, target_share double, max_repeats int")
    s = mixing.sized(d)
    p = {r["source"]: r for r in mixing.plan(s, t).collect()}
    assert p["Small_One"]["short"] and p["gone"]["short"] and not p["big"]["short"] and p["gone"]["copies"] == 0
    c = mixing.systematic(s, mixing.plan(s, t)).collect()
    small = [r["copies"] for r in c if r["source"] == "Small_One"]
    assert small == [3] * 10
    big = sum(r["copies"] for r in c if r["source"] == "big")
    assert abs(big - 400 * p["big"]["copies"]) <= 1 and max(r["copies"] for r in c if r["source"] == "big") <= 2
    again = mixing.systematic(mixing.sized(d.repartition(7)), mixing.plan(s, t)).collect()
    assert sorted(map(tuple, again)) == sorted(map(tuple, c))


def test_index_in_batches_equals_all_at_once(spark, tmp_path):
    """Chains across batches, added batch by batch; texts of history are gone, and a batch cut short is written anew."""
    rnd = random.Random(4)
    words = [f"w{i}" for i in range(50)]
    rows, t = [], rnd.sample(words, 20)
    for i in range(120):
        t = list(t)
        t[rnd.randrange(len(t))] = rnd.choice(words)  # drifts, so that chains are long
        rows.append((i, i // 30, "r", "u", " ".join(t)))
    rows += [(500, 2, "r", "u", rows[3][4]), (501, 3, "r", "u", None), (502, 3, "r", "v", rows[3][4])]
    schema = "finding_id int, batch_no int, repo string, rule_id string, evidence string"
    index = si.SegmentIndex(spark, str(tmp_path / "index"))
    got = set()
    for b in range(4):
        if b == 2:  # a run that ended before its last table
            si.segments(si.finding_strings(spark.createDataFrame(rows[:3], schema))).write.parquet(str(tmp_path / "index/segments/2"))
        got |= {tuple(r) for r in index.add(si.finding_strings(spark.createDataFrame([r for r in rows if r[1] == b], schema))).collect()}
        assert index.batches() == b + 1
    assert got == _brute(rows)
    stored = spark.read.parquet(*[str(tmp_path / f"index/strings/{i}") for i in range(4)])
    assert set(stored.columns) == {"grp", "id", "ord", "toks"} and stored.count() == len(rows) - 1 - len({d for _, d in got})
    assert index.add(si.finding_strings(spark.createDataFrame([], schema))).count() == 0


def test_a_long_chain_is_decided(spark):
    pairs = spark.createDataFrame([(i, i + 1, i, i + 1) for i in range(104)], "a int, b int, a_ord int, b_ord int")
    assert {tuple(r) for r in si.decide(pairs).collect()} == {(i, i + 1) for i in range(0, 104, 2)}


def test_short_sources_come_from_the_copies(spark, sf):
    r = {x["source"]: x for x in mixing.p9_report(spark, sf).collect()}
    want = {k for k, x in r.items() if x["max_repeats"] * x["tokens"] < x["target_share"] * sum(y["tokens"] for y in r.values())}
    short = {x[0] for x in mixing.p9_found(spark, sf).collect()}
    assert short and short <= want and all(r[k]["copies_taken"] == r[k]["max_repeats"] * r[k]["docs"] for k in short)
