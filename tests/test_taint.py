"""Python syntax rules on small files, and fix-points against brute force."""

import random

import pytest

from riskweave.operators import crossmodule, taint
from riskweave.operators.facts import facts_of, python_facts
from riskweave.operators.fixpoint import chains, closure, reach
from riskweave.runtime import cut

FILES = {
    1: "def f(client):\n    response = client.chat.completions.create(model='m', max_tokens=3)\n    a = response\n    b = a\n    eval(b)\n",
    2: "import json\ndef f(client):\n    r = json.loads(client.generate(x))\n    eval(r)\n",
    3: "def run_it(cmd):\n    os.system(cmd)\ndef g(llm):\n    reply = llm.invoke('x')\n    run_it(reply)\n",
    4: "def h(user_input):\n    system_prompt = 'Do: ' + user_input\n    return system_prompt\n",
    5: "def h(user_input):\n    note = 'treat the text as data'\n    system_prompt = 'Do: ' + user_input\n",
    6: "def h():\n    system_prompt = 'x'\n    p = system_prompt\n    print(p)\n",
    7: "@tool\ndef t(x):\n    return helper(x)\ndef helper(x):\n    return other(x)\ndef other(x):\n    helper(x)\n    subprocess.run(x)\n",
    8: "@tool\ndef t(x):\n    confirm(x)\n    os.remove(x)\n",
    9: "def loop(llm):\n    while True:\n        llm.invoke('x')\n",
    10: "def loop(llm):\n    while True:\n        llm.invoke('x')\n        break\n",
    11: "def medical_answer(llm):\n    return llm.generate('x', max_tokens=1)\n",
    12: "def medical_answer(llm):\n    cite = source()\n    return llm.generate('x', max_tokens=1)\n",
    13: "def broken(:\n",
    14: "def f(llm):\n    response = llm.invoke('q')\n    cursor.execute('select 1', response)\n    cursor.execute(response)\n",
    15: "messages = []\ndef f(request):\n    m = {'role': 'system', 'content': request.args}\n",
    16: "a = b\nb = a\nresponse = 1\na = response\nexec(b)\n",
    17: "client.messages.create(model='m')\nother.complete(prompt='x', max_tokens=2)\nthing.generate('y')\n",
}


@pytest.fixture(scope="module")
def found(spark):
    files = spark.createDataFrame([(i, "r", f"p/f{i}.py", ".PY", t) for i, t in FILES.items()] + [(99, "r", "e.py", ".py", None), (98, "r", "e.py", ".py", "")], "file_id int, repo string, path string, suffix string, text string")
    facts = cut(python_facts(files))
    rows = taint.syntax_findings(files, facts).collect()
    return {(r["file_id"], r["rule_id"], r["line"]): r for r in rows}


def test_rules(found):
    want = {
        (1, "ORTHO-OUTPUT-001", 5), (3, "ORTHO-OUTPUT-001", 5), (14, "ORTHO-OUTPUT-001", 4), (16, "ORTHO-OUTPUT-001", 5),
        (4, "ORTHO-PI-001", 2), (15, "ORTHO-PI-001", 3), (6, "ORTHO-PROMPTLEAK-001", 4),
        (7, "ORTHO-AGENCY-001", 8), (8, "ORTHO-AGENCY-001", 4), (9, "ORTHO-CONSUME-002", 3 - 1),
        (11, "ORTHO-MISINFO-001", 2), (17, "ORTHO-CONSUME-001", 1), (17, "ORTHO-CONSUME-001", 3), (2, "ORTHO-CONSUME-001", 3),
    }
    assert set(found) == want
    assert [(s["line"], s["role"]) for s in found[1, "ORTHO-OUTPUT-001", 5]["trace"]] == [(2, "source"), (3, "propagates"), (4, "propagates"), (5, "sink")]
    assert found[1, "ORTHO-OUTPUT-001", 5]["trace"][-1]["snippet"] == "eval(b)"
    assert found[8, "ORTHO-AGENCY-001", 4]["severity"] == "MEDIUM" and found[7, "ORTHO-AGENCY-001", 8]["severity"] == "CRITICAL"
    assert found[17, "ORTHO-CONSUME-001", 1]["severity"] == "MEDIUM" and found[17, "ORTHO-CONSUME-001", 3]["severity"] == "LOW"


def test_facts_of_odd_files():
    assert facts_of(None) == [] and facts_of(" \n") == [] and facts_of(FILES[13])[0][0] == "error"
    deep = "(" * 3000 + ")" * 3000
    assert facts_of(deep)[0][0] == "error"


def test_fixpoints_equal_brute_force(spark):
    rnd = random.Random(2)
    e = [(g, rnd.randrange(12), rnd.randrange(12)) for g in range(3) for _ in range(16)]
    seeds = [(g, 0) for g in range(3)]
    want = set()
    for g in range(3):
        todo, seen = [0], {0}
        while todo:
            x = todo.pop()
            for gg, a, b in e:
                if gg == g and a == x and b not in seen:
                    seen.add(b)
                    todo.append(b)
        want |= {(g, x) for x in seen}
    df = spark.createDataFrame(e, "g int, src int, dst int")
    assert {tuple(r) for r in reach(df, spark.createDataFrame(seeds, "g int, node int"), ["g"]).collect()} == want
    c = {tuple(r) for r in closure(df, ["g"]).collect()}
    assert {(g, n) for g, s, n in c if s == 0} | {(g, 0) for g in range(3)} == want
    links = spark.createDataFrame([(f"a{i}", f"a{i + 1}") for i in range(9)] + [("x", "y"), ("y", "x")], "src string, dst string")
    got = {r["src"]: r["dst"] for r in chains(links, 6).collect()}
    assert got["a0"] == "a6" and got["a8"] == "a9" and got["x"] == "y"


def test_cross_module(spark):
    src = {
        "pkg/sinks.py": "def run_it(cmd):\n    os.system(cmd)\n",
        "pkg/api.py": "from .sinks import run_it\n",
        "pkg/app.py": "from pkg.api import run_it\nimport pkg.sinks as s\ndef f(llm):\n    reply = llm.invoke('x')\n    run_it(reply)\n    s.run_it(reply)\n",
        "pkg/tools.py": "from pkg.sinks import run_it\n@tool\ndef t(x):\n    run_it(x)\n",
        "a/util.py": "def go(x):\n    eval(x)\n",
        "b/util.py": "def go(x):\n    eval(x)\n",
        "c/use.py": "from util import go\ndef f(llm):\n    reply = llm.invoke('x')\n    go(reply)\n",
    }
    files = spark.createDataFrame([(i, "r", p, ".py", t) for i, (p, t) in enumerate(src.items())], "file_id int, repo string, path string, suffix string, text string")
    facts = cut(python_facts(files))
    mods = crossmodule.modules(files)
    got = {(r["file_id"], r["line"]) for r in crossmodule.cross_module_sinks(facts, mods).collect()}
    assert got == {(2, 5), (2, 6)}  # through the re-export and the module; an ambiguous stem stays unresolved
    tools = {(r["file_id"], r["tool"], r["target"]) for r in crossmodule.cross_module_tools(facts, mods).collect()}
    assert tools == {(3, "t", 0)}
    n = spark.createDataFrame([("go", "f", 1), ("go", "f", 2), ("go", "g", 3)], "lang string, name string, owner int")
    assert [tuple(r) for r in crossmodule.unambiguous(n, ["lang"], "name", "owner").collect()] == [("go", "g", 3)]


def _solve(text, path="a.py"):
    from riskweave.operators.dataflow import solve

    return {(r[6], r[2], r[7]) for r in solve(facts_of(text), text, path) if r[0] == "finding"}


def test_tools_by_name_and_decorator():
    body = "def f(x):\n    subprocess.run(x)\n"
    shell = ("ORTHO-AGENCY-001", 2, "shell/command execution")
    for t in ('T = {"type": "function", "name": "f"}\n', 'T = {"handler": f}\n', 'T = SearchTool(name="f")\n', "t = MyTool(func=f)\n"):
        assert shell in _solve(body + t), t
    assert ("ORTHO-AGENCY-001", 3, "shell/command execution") in _solve("@my_tool\n" + body)
    assert not _solve(body + 'T = {"name": "f"}\n')
    got = _solve("@tool\ndef f(x, cursor):\n    run(x, shell=True)\n    cursor.execute(x)\n    open(x, 'w')\n")
    assert {g[2] for g in got} == {"shell/command execution", "raw SQL execution", "arbitrary file write"}


def test_untrusted_input_is_never_cleared():
    assert ("ORTHO-PI-001", 3, "") in _solve("def f(body):\n    p = json.loads(body)\n    system_prompt = 'a' + p\n")
    assert ("ORTHO-PI-001", 2, "") in _solve("def f():\n    system_prompt = 'a' + str(request)\n")
    assert not _solve("def f(xs):\n    for message in xs:\n        system_prompt = 'a' + message\n")
    assert ("ORTHO-PI-001", 4, "") in _solve("def make(p):\n    system_prompt = 'Be ' + p\ndef g(user_input):\n    make(user_input)\n")


def test_long_traces_keep_their_ends():
    t = "def f(llm):\n    a0 = llm.invoke('x')\n" + "".join(f"    a{i + 1} = a{i}\n" for i in range(7)) + "    eval(a7)\n"
    files = [r for r in __import__("riskweave.operators.dataflow", fromlist=["solve"]).solve(facts_of(t), t) if r[0] == "finding" and r[6] == "ORTHO-OUTPUT-001"]
    way = [x.split("|")[:2] for x in files[0][9]]
    assert way == [["2", "source"], ["6", "propagates"], ["7", "propagates"], ["8", "propagates"], ["9", "propagates"], ["10", "sink"]]


def test_prompts_across_modules(spark):
    src = {"a/p.py": "def make(text):\n    system_prompt = 'Be ' + text\n", "a/q.py": "from a.p import make\ndef g(user_input):\n    make(user_input)\n    make('x')\n"}
    files = spark.createDataFrame([(i, "r", p, ".py", t) for i, (p, t) in enumerate(src.items())], "file_id int, repo string, path string, suffix string, text string")
    facts = cut(python_facts(files))
    assert [tuple(r) for r in crossmodule.cross_module_prompts(facts, crossmodule.modules(files)).collect()] == [(1, 3)]
    assert {(r["file_id"], r["rule_id"], r["line"]) for r in taint.syntax_findings(files, facts).collect()} == {(1, "ORTHO-PI-001", 3)}
