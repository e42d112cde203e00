import pytest

from weftline.functions import includes as I
from weftline.operators import adoption, gating
from weftline.operators import models as M
from weftline.operators import reports as R
from weftline.operators import tables as B
from weftline.sources import scan


def test_screening(spark):
    assert M.parse_screen(" 1, 3 9.", 3) == {1, 3} and M.parse_screen("None.", 3) == set()
    with pytest.raises(ValueError):
        M.parse_screen("1 and 2", 3)
    terms = spark.createDataFrame([(f"t{k:03d}", k) for k in range(30)] + [(None, 5)], "term string, n int")
    got = {r.term: r.picked for r in M.screen_terms(terms, lambda: M.ScreeningProvider(20), size=7).collect()}
    assert len(got) == 30 and all(got[f"t{k:03d}"] == (k >= 20) for k in range(30))

    class Mute:
        def complete(self, prompt):
            return "no idea"

    assert {r.picked for r in M.screen_terms(terms, Mute).collect()} == {None}
    assert M.screen_terms(terms.limit(0), Mute).count() == 0


def test_decisions():
    assert M.parse_decisions('[1] "버퍼:"\n[2] -\n[3] 가 or 나\n[4] (x)\n[9] 밖', 4) == {1: "버퍼", 2: None}
    assert M.decide_terms(M.ScreeningProvider(), ["heap", "binary heap", "heap"]) == {"heap": "HEAP", "binary heap": "BINARY HEAP"}
    assert "heap = HEAP" in M.decide_prompt(["binary heap"], [[("heap", "HEAP")]])
    assert M.waves(["a b", "c"]) == (["c"], ["a b"])


def test_fusion_and_style():
    one, two = {1: "가"}, {1: "나", 2: "다"}
    prompt = M.fuse_prompt([(1, "a"), (2, "b")], [one, two], "item")
    assert prompt.count("Draft ") == 2 and "[2] 다" in prompt and prompt == M.fuse_prompt([(1, "a"), (2, "b")], [one, two], "item")
    assert M.parse_style("good\nfine") == (True, None, None) and M.parse_style("ACCEPTABLE\nstiff") == (True, "warning", "stiff") and M.parse_style("")[0] is False


def test_judging(spark):
    assert M.parse_verdict('x {"overall": "b", "accuracy": "A"} y', True) == {"accuracy": "baseline", "fluency": "tie", "translationese": "tie", "overall": "candidate"}
    with pytest.raises(ValueError):
        M.parse_verdict("no", True)
    schema = "pick_id bigint, baseline string, candidate string, judge string, judge_model string, shown_order string, error string"
    pairs = spark.createDataFrame([(1, "x", "y", "j", "m", "AB", None), (1, "x", "y", "k", "m", "AB", "failed")], schema)
    plan = {tuple(r) for r in M.judging_plan(pairs, pairs, pairs).collect()}
    assert plan == {(1, "x", "y", "j", "m", "BA"), (1, "x", "y", "k", "m", "AB"), (1, "x", "y", "k", "m", "BA")}
    judges = spark.createDataFrame([("j", "m", "openai"), ("k", "m", "google")], "judge string, judge_model string, company string")
    own = spark.createDataFrame([("y", "openai")], "candidate string, company string")
    assert {r.judge for r in M.judging_plan(pairs, judges, pairs, own).collect()} == {"k"}
    rows = spark.createDataFrame([(1, "x", "y", "j", "m", o, "s", "short", "much longer") for o in ("AB", "BA")] + [(2, "x", "y", "j", "m", "AB", "s", "same", "same")], schema.replace("error string", "source string, baseline_text string, candidate_text string"))
    got = {(r.pick_id, r.shown_order): (r.verdicts.overall, r.attempts) for r in M.judge(rows, lambda: M.HashJudge("longer")).collect()}
    assert got == {(1, "AB"): ("candidate", 2), (1, "BA"): ("candidate", 2), (2, "AB"): ("tie", 1)}

    class Broken:
        def complete(self, prompt):
            return "?"

    failed = M.judge(rows.limit(1), Broken).first()
    assert failed.verdicts is None and failed.error and failed.attempts == 3
    assert [r[0] for r in spark.createDataFrame([("codex",), ("gemini",), ("x",), (None,)], "t string").select(M.company(__import__("pyspark").sql.functions.col("t"))).collect()] == ["openai", "google", "other", "other"]


def test_runs_resume(spark):
    items = spark.createDataFrame([(n, [([(0, "one"), (1, "two")],)]) for n in ("a", "b")], "item string, blocks array<struct<segments:array<struct<index:int,source:string>>>>")
    done = spark.createDataFrame([("a", "c", 0), ("b", "other", 0)], "item string, candidate string, repeat_no int")
    from weftline.operators.requests import EchoProvider

    got = M.run_items(items, done, "c", EchoProvider).collect()
    assert [(r.item, r.finals, len(r.calls), r.error) for r in got] == [("b", {0: "ONE", 1: "TWO"}, 1, None)]

    class Down:
        def complete(self, prompt):
            raise OSError("down")

    failed = M.run_items(items, done, "c", Down).first()
    assert failed.error == "down" and len(failed.calls) == 3 and failed.finals == {}


def test_block_gates():
    segments = [(0, "b0", "Call `one` and then wait for the buffer to be sealed. Then it ends."), (1, "b0", "[!NOTE] Read `two` now."), (2, "b1", "Plain text.")]
    good = {0: "`one`을 부르고 버퍼가 봉인되기를 기다립니다. 그러면 끝납니다.", 1: "[!NOTE] 이제 `two`를 읽습니다.", 2: "평문입니다."}
    assert all(all(c.values()) for c, _, _ in gating.check_item("markdown", segments, good, 0.22).values())
    bad = gating.check_item("markdown", segments, {0: "`one`.", 1: "이제 읽습니다."}, 0.22)
    failed = {b: {k for k, ok in c.items() if not ok} for b, (c, _, _) in bad.items()}
    assert failed == {"b0": {"audit", "alert-markers", "truncation"}, "b1": {"present"}}
    swapped = gating.check_item("markdown", segments, good | {0: good[1].replace("[!NOTE] ", ""), 1: "[!NOTE] " + good[0]}, 0.0)
    assert not swapped["b0"][0]["alignment"]


def test_adoption(spark):
    from weftline.functions.glossary import Glossary

    schema = "id int, source string, translation string, glossary_snapshot map<string,string>, issues array<string>"
    rows = [(1, "The heap.", "힙입니다.", {}, ["Term 'heap' should be translated as '힙'", "other"]), (2, "The heap.", "더미입니다.", {}, None), (3, "The heap.", "힙입니다.", {"heap": "힙"}, []), (4, "The heap.", None, None, None), (5, None, "힙", None, None)]
    got = {r.id: r for r in adoption.adopt(spark.createDataFrame(rows, schema), Glossary({"heap": "힙"}), ["id"]).collect()}
    assert set(got) == {1, 2} and got[1].adopted and got[1].cleared and got[1].snapshot == {"heap": "힙"} and got[1].issues == ["other"]
    assert not got[2].adopted and got[2].unmet == ["heap"]
    total = {(r.what, r.name): r.segments for r in adoption.summary(adoption.adopt(spark.createDataFrame(rows, schema), Glossary({"heap": "힙"}), ["id"])).collect()}
    assert total == {("adopted", None): 1, ("cleared", None): 1, ("stale", None): 1, ("stale term", "heap"): 1}


def test_reports(spark, tmp_path):
    rates = spark.createDataFrame([("b", "first", 8, 7), ("a", "final", 3, 3), ("a", "first", 0, 0)], "candidate string, variant string, rows bigint, passed bigint")
    table = R.gate_table(rates)
    assert {r.line for r in table.collect()} == {"| a | — | 100.0% (3/3) |", "| b | 87.5% (7/8) | — |"}
    R.write_report(table, "candidate", ["# Report", ""], f"file://{tmp_path}/report")
    text = "\n".join(r[0] for r in spark.read.text(f"file://{tmp_path}/report").collect())
    assert text.startswith("# Report\n\n| a ")
    pages = spark.createDataFrame([("i", '{"blocks": [{"segments": []}], "sides": [], "x": "</script>"}')], "item string, page string")
    html = R.html_pages(pages).first().html
    assert html.count("</script>") == 2 and '"<\\/script>"' in html


def test_lines_and_includes():
    source = "One\nline.\n\nTwo.\n\n\nThree\nis\nlong.\n"
    target = "One line.\n\nTwo\nis two.\n\nThree is long.\nEnd"
    blocks = lambda text, parts: [("p", text.index(p), text.index(p) + len(p)) for p in parts]
    known = I.LineMap.between(source, blocks(source, ["One\nline.", "Two.", "Three\nis\nlong."]), target, blocks(target, ["One line.", "Two\nis two.", "Three is long."]))
    assert [known.line(n) for n in range(9)] == [0, 0, 1, 2, 4, 4, 5, 5, 5]
    assert I.LineMap.between(source, [("p", 0, 3)], target, []) is None
    text = ".. include:: a.rst\n   :start-line: 3\n   :end-line: -1\n\n.. include:: b.rst\n"
    assert I.include_targets(text) == [("a.rst", 3, -1), ("b.rst", None, None)]
    assert I.rewrite_lines(text, {"a.rst": known}) == text.replace("start-line: 3", "start-line: 2")
    assert I.rewrite_lines("", {}) == ""


def test_references_follow_their_labels():
    labels = I.definition_labels("[The heap]: http://x\n[b]: /y\n")
    assert labels == {"the heap", "b"}
    assert I.full_references("See [the heap] and [b].", "[힙]과 [b]를 봅니다.", labels) == "[힙][the heap]과 [b]를 봅니다."
    assert I.full_references("See [the heap].", "[힙]과 [둘].", labels) == "[힙]과 [둘]."
    assert I.full_references("See [the heap][].", "[힙][]을 봅니다.", labels) == "[힙][the heap]을 봅니다."


def test_file_rules(spark):
    rows = [(f, 1, r, c, f"{r}{c}", r == 0) for f in ("docs/a.md", "b.md") for r in (0, 1) for c in (0, 1)]
    cells = spark.createDataFrame(rows, "path string, table_no int, table_row int, column int, text string, label_row boolean")
    got = {(r.path, r.table_row, r.column) for r in B.apply_file_rules(cells, ["path", "table_no"], "path", [{"files": "docs/*.md", "skip": ["1"]}]).filter("not offered").collect()}
    assert got == {("docs/a.md", 1, 1)}
    assert B.apply_file_rules(cells, ["path", "table_no"], "path", [{"files": "b.*", "skip": ["0"]}]).filter("not offered").count() == 1


def test_toml_and_revisions(spark, tmp_path):
    import subprocess

    (tmp_path / "terms.toml").write_text('[terms.heap]\ntranslation = "힙"\nexcept = ["heap of"]\n[whole."See also"]\ntranslation = "참고"\n[rejected]\nterms = ["launch"]\n')
    got = {(r.section, r.term): (r.translation, tuple(r.excepts)) for r in scan.toml_entries(spark, f"file://{tmp_path}/terms.toml").collect()}
    assert got == {("terms", "heap"): ("힙", ("heap of",)), ("whole", "See also"): ("참고", ()), ("rejected terms", "launch"): (None, ())}
    git = lambda *a: subprocess.run(["git", "-C", str(tmp_path), "-c", "user.name=a", "-c", "user.email=a@b", *a], check=True, capture_output=True)
    git("init", "-q")
    for text in ("가", "나"):
        (tmp_path / "s.json").write_text('{"segments": [{"id": "1", "source_hash": 18446744073709551615, "translation": "%s"}]}' % text)
        git("add", "s.json")
        git("commit", "-qm", "x")
    for revision, want in (("HEAD~1", "가"), ("HEAD", "나")):
        assert [(r.path, int(r.source_hash), r.translation) for r in scan.revision_states(spark, str(tmp_path), revision, ["s.json", "none.json"]).collect()] == [("s.json", 2**64 - 1, want)]


def test_patches_and_json_lines(spark, tmp_path):
    (tmp_path / "a.patch").write_text("--- a/x.md\n+++ b/x.md\n@@ -1 +1 @@\n-a\n+b\n--- a/gone.md\n+++ /dev/null\n")
    assert [r.target for r in scan.patched_files(spark, f"file://{tmp_path}/a.patch").collect()] == ["x.md", "gone.md"]
    rows = spark.createDataFrame([(1, "가"), (2, None)], "n int, t string")
    scan.write_json_lines(rows, f"file://{tmp_path}/rows")
    assert {tuple(r) for r in scan.json_lines(spark, f"file://{tmp_path}/rows", "n int, t string").select("n", "t").collect()} == {(1, "가"), (2, None)}
    assert "wait for the heap" in M.decide_prompt(["heap"], [[]], examples={"heap": "They wait for the heap now."})


def test_providers_and_style():
    class Critic:
        def complete(self, prompt):
            return "ACCEPTABLE\nstiff"

    assert M.style_issues(Critic(), "a", "b") == [("warning", "stiff")]
    assert M.make_provider("echo", fails="x").fails == "x"
    with pytest.raises(ValueError):
        M.make_provider("network")


def test_titles_names_and_constructs():
    from weftline.functions import quality as Q
    from weftline.operators import alignment as A
    from weftline.sources import parsers as P

    text = "The Heap\n========\n\nSee `the heap`_ and ``x``.\n\nNothing here.\n"
    found = P.segments(text, P.rst(text))
    out = P.reconstruct(text, found, {found[0].id: "힙 구조"}, "rst")
    assert "`힙 구조`_" in out and out.startswith("힙 구조\n=======\n") and "Nothing here." in out
    assert A.restates_a_name({"argument", "clinic"}, "이 Argument Clinic은 좋습니다.") and not A.restates_a_name({"argument"}, "`argument`를 봅니다.")
    assert A.misaligned([("It is good.", "Argument Clinic은 좋습니다."), ("Argument Clinic is here.", "여기 있습니다.")]) == {}
    assert Q.constructs("*a* **b** [c](d) ![e](f) [^1] <https://x> <b>g</b> ~~h~~ `*i*`") == {"italic": 1, "bold": 1, "link": 1, "image": 1, "footnote reference": 1, "autolink": 1, "inline HTML": 2, "strikethrough": 1}
    assert Q.construct_issues("See [a](b).", "보세요.", "markdown") == ["link 0 of 1"]
