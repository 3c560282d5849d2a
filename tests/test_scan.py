"""A scan of a planted tree: every family of rules, within and across files, suppressed and scored."""

from collections import Counter

from riskweave.operators import marts
from riskweave.operators.scan import scan

EVAL = "def f{i}(llm):\n    reply = llm.invoke('x', max_tokens=3)\n    eval(reply){note}\n"
TREE = {
    "app/sinks.py": "def run_it(cmd):\n    os.system(cmd)\n",
    "app/far.py": "from app.sinks import run_it\ndef g(llm):\n    reply = llm.invoke('x')\n    run_it(reply)\n@tool\ndef t(x):\n    run_it(x)\n",
    "app/prompt.py": "def h(user_input):\n    system_prompt = 'Do: ' + user_input\n    print(system_prompt)\n",
    "app/loop.py": "def loop(llm):\n    while True:\n        llm.invoke('x')\n",
    "app/medical.py": "def medical_answer(llm):\n    return llm.generate('x', max_tokens=1)\n",
    "app/call.py": "client.messages.create(model='m')\n",
    "app/load.py": "x = pickle.load(f)\n",
    "web/a.js": "const completion = f();\neval(completion)\n",
    "requirements.txt": "openai\nopenai==1.0.0\nfoo @ git+https://x/y\n",
    "src/quiet.py": "# riskweave: ignore[LLM05]\nclient.generate('x')\n" + EVAL.format(i=0, note="  # riskweave: ignore"),
    "empty.py": "",
    "gone.py": None,
}


def test_scan(spark):
    rows = [(i, "r", p, "." + p.rsplit(".", 1)[1], t, "x") for i, (p, t) in enumerate(TREE.items())]
    rows += [(100 + i, "many", f"m/f{i}.py", ".py", EVAL.format(i=i, note=""), "x") for i in range(100)]
    files = spark.createDataFrame(rows, "file_id int, repo string, path string, suffix string, text string, rule_id string")
    adv = spark.createDataFrame([("PyPI", "openai", "1.0.0", ["A-1"])], "ecosystem string, name string, version string, ids array<string>")
    x = scan(files, adv)
    got = x.collect()
    of = {(r["file"], r["rule_id"], r["line"]): r for r in got if r["repo"] == "r"}
    assert set(of) == {
        ("app/far.py", "ORTHO-OUTPUT-001", 4), ("app/far.py", "ORTHO-AGENCY-001", 6), ("app/prompt.py", "ORTHO-PI-001", 2), ("app/prompt.py", "ORTHO-PROMPTLEAK-001", 3),
        ("app/loop.py", "ORTHO-CONSUME-002", 2), ("app/medical.py", "ORTHO-MISINFO-001", 2), ("app/call.py", "ORTHO-CONSUME-001", 1), ("app/load.py", "ORTHO-SUPPLY-001", 1),
        ("web/a.js", "ORTHO-OUTPUT-001", 2), ("requirements.txt", "ORTHO-DEP-001", 1), ("requirements.txt", "ORTHO-DEP-002", 3), ("requirements.txt", "ORTHO-DEP-003", 2),
        ("src/quiet.py", "ORTHO-CONSUME-001", 2),
    }
    assert of["app/prompt.py", "ORTHO-PI-001", 2]["evidence"] == "system_prompt = 'Do: ' + user_input" and len(of["app/prompt.py", "ORTHO-PI-001", 2]["trace"]) == 2
    assert of["app/far.py", "ORTHO-OUTPUT-001", 4]["evidence"] == "run_it(reply)" and of["requirements.txt", "ORTHO-DEP-003", 2]["title"] == "Known advisory openai 1.0.0 A-1"
    assert Counter(r["rule_id"] for r in got if r["repo"] == "many") == {"ORTHO-OUTPUT-001": 100} and len({r["finding_id"] for r in got}) == len(got)
    p = {r["repo"]: r for r in marts.posture(x, "repo").collect()}
    assert p["r"]["findings"] == len(of) and p["many"]["findings"] == 100 and p["r"]["grade"] in "ABCDF"
    assert scan(files.limit(0)).count() == 0
