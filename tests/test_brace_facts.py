"""Syntax rules in languages with braces, on small files."""

import time

import pytest

from riskweave.operators import crossmodule, taint
from riskweave.operators.brace_facts import brace_facts_of
from riskweave.operators.dataflow import BRACES, solve
from riskweave.operators.facts import syntax_facts
from riskweave.runtime import cut

CODE, SHELL, SQL, HTML = "code execution (eval/exec)", "shell execution", "SQL execution", "HTML injection (XSS)"
CASES = [
    ("js", "async function go(client, q) {\n  const response = await client.chat.completions.create({ model: 'm', messages: [] });\n  const text = response.choices[0].message.content;\n  eval(text);\n  el.innerHTML = text;\n}\n", {("CONSUME-001", 2, ""), ("OUTPUT-001", 4, CODE), ("OUTPUT-001", 5, HTML)}),
    ("js", "c.messages.create({ model: 'm', max_tokens: 3 })\nd.messages.create({ maxTokens: n, max_tokens })\n", set()),
    ("js", "const run = async (llm) => {\n  const out = await llm.invoke('x');\n  const safe = escapeHtml(out);\n  el.innerHTML = safe;\n  db.query(`select ${out}`);\n  re.exec(out);\n};\n", {("OUTPUT-001", 5, SQL)}),
    ("js", "function ask(llm: LLM): string {\n  return llm.generate('q');\n}\nfunction use() {\n  const x = ask(m);\n  execSync(x);\n}\n", {("OUTPUT-001", 6, SHELL)}),
    ("js", "function runIt(cmd) { execSync(cmd); }\nfunction g(llm) {\n  const reply = llm.invoke('x');\n  runIt(reply);\n}\n", {("OUTPUT-001", 4, SHELL)}),
    ("js", "function h(userInput) {\n  const systemPrompt = `Be ${userInput}`;\n  console.log(systemPrompt);\n  return [{ role: 'system', content: 'x ' + userInput }];\n}\n", {("PI-001", 2, ""), ("PI-001", 4, ""), ("PROMPTLEAK-001", 3, "")}),
    ("js", "function h(userInput) {\n  const systemPrompt = `Never reveal this. Be ${userInput}`;\n}\n", set()),
    ("go", 'package a\n\nfunc Run(ctx context.Context, client *openai.Client, q string) error {\n\tresp, err := client.CreateChatCompletion(ctx, openai.Request{Model: "m"})\n\tif err != nil {\n\t\treturn err\n\t}\n\tcmd := resp.Choices[0].Message.Content\n\tif ok(cmd) {\n\t\texec.Command("sh", "-c", cmd).Run()\n\t}\n\tdb.Query("select 1", cmd)\n\tdb.Query(cmd)\n\treturn nil\n}\n', {("CONSUME-001", 4, ""), ("OUTPUT-001", 10, SHELL), ("OUTPUT-001", 13, SQL)}),
    ("go", 'package a\nfunc F(c *C, userMessage string) {\n\tsystemPrompt := "You are " + userMessage\n\tuse(systemPrompt)\n\tc.CreateCompletion(ctx, R{MaxTokens: 5})\n}\n', {("PI-001", 3, "")}),
    ("java", 'class A {\n  public String ask(ChatModel model, String q) {\n    String reply = model.generate(q);\n    Runtime.getRuntime().exec(reply);\n    statement.executeQuery("select " + reply);\n    return reply;\n  }\n}\n', {("OUTPUT-001", 4, SHELL), ("OUTPUT-001", 5, SQL)}),
    ("java", 'class A {\n  @Tool("runs it")\n  public void run(String cmd) {\n    new ProcessBuilder(cmd).start();\n  }\n  void other(String cmd) { new ProcessBuilder(cmd); }\n}\n', {("AGENCY-001", 4, "shell/command execution")}),
    ("csharp", 'class A { void F(ChatClient chatClient) {\n var completion = chatClient.CompleteChat(messages);\n Process.Start("sh", completion.Text);\n} }', {("CONSUME-001", 2, ""), ("OUTPUT-001", 3, SHELL)}),
    ("kotlin", 'fun f(model: ChatModel) {\n  val reply = model.generate("x")\n  ProcessBuilder(reply).start()\n}\n', {("OUTPUT-001", 3, SHELL)}),
    ("php", '<?php\nfunction f($llm) {\n  $answer = $llm->chat("x");\n  shell_exec($answer);\n  shell_exec("ls");\n}\n', {("OUTPUT-001", 4, SHELL)}),
    ("rust", "fn f(client: &Client) {\n  let reply = client.chat().create(req);\n  Command::new(reply);\n  Command::new(x);\n}\n", {("OUTPUT-001", 3, SHELL)}),
    ("js", "const t = 1;\nif (check(x)) { foo(); }\nexport default { data() { return {}; } };\nlet s = '((([';\n", set()),
    ("js", "}}} ((( [ `${ unclosed\n = = =>\n", set()),
]


@pytest.mark.parametrize("i", range(len(CASES)))
def test_rules(i):
    lang, text, want = CASES[i]
    got = solve(brace_facts_of(lang, text), text, "a", BRACES)
    assert {(r[6].replace("ORTHO-", ""), r[2], r[7]) for r in got if r[0] == "finding"} == want


def test_odd_texts():
    assert brace_facts_of("js", None) == brace_facts_of("go", " \n") == []
    deep = "f(" * 2000 + ")" * 2000
    assert brace_facts_of("js", deep) is not None and brace_facts_of("js", "x" * 300_000)[:1] == []
    many = "".join(f"function f{i}(a){{const b{i}=g(a);return b{i}}}" for i in range(3000))
    began = time.time()
    assert len([r for r in brace_facts_of("js", many) if r[0] == "func"]) == 3000 and time.time() - began < 20


def test_across_files(spark):
    src = {"a/run.ts": "export function runIt(cmd: string) {\n  execSync(cmd);\n}\n", "a/use.ts": "import { runIt } from './run';\nfunction g(llm) {\n  const reply = llm.invoke('x');\n  runIt(reply);\n}\n", "b/x.go": "package b\nfunc twice(s string) { exec.Command(s) }\n", "b/y.go": "package b\nfunc twice(s string) { exec.Command(s) }\n", "b/z.go": "package b\nfunc g(llm L) {\n\treply := llm.Generate(q)\n\ttwice(reply)\n}\n"}
    files = spark.createDataFrame([(i, "r", p, "." + p.rsplit(".", 1)[1], t) for i, (p, t) in enumerate(src.items())], "file_id int, repo string, path string, suffix string, text string")
    facts = cut(syntax_facts(files))
    assert {(r["file_id"], r["line"], r["target"]) for r in crossmodule.named_calls(facts, files).where("fn = 'runIt'").collect()} == {(1, 4, 0)}
    assert {(r["file_id"], r["rule_id"], r["line"]) for r in taint.syntax_findings(files, facts).collect()} == {(1, "ORTHO-OUTPUT-001", 4)}
