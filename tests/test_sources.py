import json
import random

import pytest

from weftline.operators import alignment as A
from weftline.operators import requests as R
from weftline.sources import parsers as P
from weftline.sources import scan
from weftline.streaming import state as ST

SAMPLES = {
    "markdown": "---\ntitle: x\n---\n# Top {#top}\n\nOne line.\nTwo *more*. Three.\n\n- [ ] item one\n  goes on\n- item two\n\n> [!NOTE]\n> Quoted text.\n\n| a | b |\n|---|---|\n| c | d |\n\n```py\ncode\n```\n\nSetext\n======\n\n---\n<div>\n<p>Html <b>text</b></p>\n</div>\n",
    "mdx": "import X from 'x'\n\n# Title\n\n<Card>\n\nInside text.\n\n</Card>\n",
    "myst": "(target)=\n# Title\n\n:::{note}\nA note.\n:::\n\n% comment\n",
    "mkdocs": "!!! note\n    Text here.\n\n$$\nx = 1\n$$\n\nAfter.\n",
    "rmarkdown": "# T\n\n```{r}\nx <- 1\n```\n\nValue `r x` here.\n\n$$y$$\n",
    "asciidoc": "= Title\n:attr: v\n\nNOTE: Mind this.\n\n* one\n** two\n\n----\ncode\n----\n\n|===\n|a |b\n2+|wide\n|===\n\n.Caption\nText. More.\n",
    "rst": "Title\n=====\n\nText with ``code``::\n\n    literal\n\n.. note:: Careful now.\n\n.. code-block:: c\n\n    int a;\n\n- one\n- two\n\n===  ===\na    b\n===  ===\nc    d\n===  ===\n\n+---+---+\n| x | y |\n+---+---+\n\n.. [1] Foot note.\n",
    "latex": "\\documentclass{article}\n\\begin{document}\n\\section{One $x$}\nText \\emph{here}. % no\n\nMore.\n\\begin{itemize}\n\\item first\n\\item second\n\\end{itemize}\n\\begin{verbatim}\nx\n\\end{verbatim}\n\\end{document}\n",
    "xhtml": "<html><body><h1>Head</h1><p>Text <em>with</em> more. And two.</p><ul><li>One</li><li>Two</li></ul><pre>code</pre><!-- no --></body></html>",
    "csv": 'name,note\na1,"Quoted, ""text"""\n12,34\r\nb,plain\n',
    "bikeshed": "<pre class=metadata>\nTitle: X\n</pre>\n\n# Intro\n\nSee [[REF]] text.\n",
    "markdeep": "**Title**\n\nText.\n\n**************\n* diagram *\n**************\n",
    "verso": "#doc\n\n# Head\n\nText.\n\n%%%\ntag\n%%%\n",
}


@pytest.mark.parametrize("name", sorted(SAMPLES))
def test_round_trip(name):
    text, parse = SAMPLES[name], P.parser_by_name(name)
    found = P.segments(text, parse(text))
    assert found and P.reconstruct(text, found, {}) == text
    again = P.reconstruct(text, found, {s.id: s.source for s in found})
    assert [s.source for s in P.segments(again, parse(again))] == [s.source for s in found]
    done = P.reconstruct(text, found, {found[0].id: "NEW"})
    assert "NEW" in done
    assert parse("") == [] and P.segments("", []) == []


@pytest.mark.parametrize("name", sorted(SAMPLES))
def test_any_text_survives(name):
    rng = random.Random(1)
    parse = P.parser_by_name(name)
    for _ in range(150):
        chars = list(SAMPLES[name])
        for _ in range(rng.randrange(8)):
            chars[rng.randrange(len(chars))] = rng.choice("\n <>|`*#=-가\\{}$\"")
        text = "".join(chars)
        assert P.reconstruct(text, P.segments(text, parse(text)), {}) == text


def test_segments():
    found = P.segments(SAMPLES["markdown"], P.markdown(SAMPLES["markdown"]))
    sources = [s.source for s in found]
    assert sources[:4] == ["Top", "One line.", "Two *more*.", "Three."] and "item one goes on" in sources and "c" in sources and "code" not in sources and "Setext" in sources
    assert found[0].id == "section:0/block:1/seg:0" or found[0].section in (0, 1)
    with pytest.raises(ValueError):
        P.parser_by_name("nothing")
    assert P.splice("abcdef", [(2, 4, "X"), (3, 5, "Y")]) == "abXef"


def test_parse_frame(spark):
    from pyspark.sql import functions as F

    rows = spark.createDataFrame([(1, "# 가\n\nText.", "markdown"), (2, None, "rst"), (3, "x", "unknown"), (4, "", "csv")], "doc_id bigint, text string, parser string")
    got = [(r.doc_id, r.source, r.start, r.end) for r in P.parse_documents(rows, "doc_id", "text", F.col("parser")).collect()]
    assert got == [(1, "가", 2, 5), (1, "Text.", 7, 12)]
    names = spark.createDataFrame([("a/b.Rmd",), ("c.adoc",), ("d",)], "p string").select(P.parser_column(F.col("p")).alias("n"))
    assert [r.n for r in names.collect()] == ["rmarkdown", "asciidoc", "markdown"]


def test_scan(spark, tmp_path):
    for name in ("docs/a.md", "docs/b.ko.md", "docs/deep/c.md", "x.txt"):
        (tmp_path / name).parent.mkdir(parents=True, exist_ok=True)
        (tmp_path / name).write_text(name)
    rules = [{"path": "docs", "pattern": "**/*.md", "exclude": ["*.ko.md"]}]
    got = scan.source_files(spark, f"file://{tmp_path}", rules).select("path", scan.output_path(__import__("pyspark").sql.functions.col("path")).alias("out")).collect()
    assert {(r.path, r.out) for r in got} == {("docs/a.md", "docs/a.ko.md"), ("docs/deep/c.md", "docs/deep/c.ko.md")}
    big = 2**64 - 3
    (tmp_path / "s.json").write_text(json.dumps({"version": 1, "source_hash": big, "segments": [{"id": "section:0/block:0/seg:0", "source": "a", "source_hash": big, "context_hash": 0, "translation": None, "glossary_snapshot": {}, "issues": []}]}))
    assert int(scan.states(spark, f"file://{tmp_path}/s.json").first().source_hash) == big
    (tmp_path / "items.open.jsonl").write_text('{"a": 1}\n\n{"a": 2}\n')
    rows = scan.json_lines(spark, f"file://{tmp_path}/items.open.jsonl", "a int").collect()
    assert [(r.a, r.bucket) for r in rows] == [(1, "open"), (2, "open")]


def test_replies():
    assert R.parse_reply("hello\n[1] one\ngoes on\n\nstray\n[2]\n[3] three") == {1: "one goes on", 3: "three"}
    assert R.parse_reply("bare", [4]) == {4: "bare"}
    for bad in (("bare", [1, 2]), ("", [1])):
        with pytest.raises(ValueError):
            R.parse_reply(*bad)
    assert "[1] a" in R.build_prompt([(1, "a")], "en", "ko") and R.build_prompt([(1, "a")], "en", "ko", template="{segments}!") == "[1] a!"


def test_retries():
    provider = R.EchoProvider(fails="hard", times=1)
    done = R.render_batch(provider, {1: "easy", 2: "hard"}, lambda s, t: [], "en", "ko")
    assert done == {1: ("EASY", 2, []), 2: ("HARD", 2, [])}
    kept = R.render_batch(R.EchoProvider(), {1: "a", 2: "b"}, lambda s, t: ["no"] if s == "b" else [], "en", "ko", retries=2)
    assert kept[1][1] == 1 and kept[2] == ("B", 3, ["no"])
    pace = R.RateLimiter()
    for _ in range(9):
        pace.refused()
    assert pace.pause == pytest.approx(6.4)
    pace.succeeded(500)
    assert pace.pause == pytest.approx(6.4 * 0.8)


def test_misalignment(spark):
    rows = [("f", 0, "Call `alpha_one` now.", "`beta_two`를 호출합니다."), ("f", 1, "Call `beta_two` now.", "`gamma`를 호출합니다."), ("f", 2, "Nothing here.", None), ("f", 9, "Call `gamma` last.", "마지막")]
    got = A.misaligned_in_sequence(spark.createDataFrame(rows, "path string, at int, s string, t string"), "path", "at", "s", "t").collect()
    assert {(r.at, r.offset) for r in got} == {(0, 1), (1, 2)}


def test_stream_merges_every_version(spark, tmp_path):
    base = f"file://{tmp_path}"
    schema = "k string, n bigint, v string"
    for i, rows in enumerate([[("a", 1, "x"), ("b", 2, "y")], [("a", 3, "z")], [("b", 1, "old")]]):
        spark.createDataFrame(rows, schema).coalesce(1).write.parquet(f"{base}/in/{i}")
    source = spark.read.parquet(f"{base}/in/0").schema
    stream = ST.read_stream(spark, f"{base}/in/*", source)
    ST.merge_states(stream, f"{base}/out", f"{base}/log", ["k"], "n").awaitTermination()
    found = ST.read_states(spark, f"{base}/out")
    assert {tuple(r) for r in found.select("k", "n", "v").collect()} == {("a", 3, "z"), ("b", 2, "y")}


def test_a_batch_writes_only_the_buckets_it_touches(spark, tmp_path):
    import os

    base = f"file://{tmp_path}"
    schema = "k string, n bigint"
    for i, rows in enumerate([[(f"k{j}", 1) for j in range(200)], *([("k7", n)] for n in range(2, 6))]):
        spark.createDataFrame(rows, schema).coalesce(1).write.parquet(f"{base}/in/{i}")
    ST.merge_states(ST.read_stream(spark, f"{base}/in/*", spark.read.parquet(f"{base}/in/0").schema), f"{base}/out", f"{base}/log", ["k"], "n").awaitTermination()
    known = ST.versions(spark, f"{base}/out")
    assert known == [3, 4]
    assert [len([d for d in os.listdir(f"{tmp_path}/out/data/{n}") if d.startswith("bucket=")]) for n in known] == [1, 1]
    got = {r.k: r.n for r in ST.read_states(spark, f"{base}/out").collect()}
    assert len(got) == 200 and got["k7"] == 5 and got["k8"] == 1


def test_state_files(spark, tmp_path):
    from weftline.sources import scan

    rows = spark.createDataFrame([("a.md",), ("./b/c.rst",), ("/abs/d.md",)], "path string")
    got = [tuple(r) for r in rows.select(scan.state_path("path"), scan.state_path("path", "state/")).collect()]
    assert got == [("a.md.state.json", "state/a.md.state.json"), ("./b/c.rst.state.json", "state/b/c.rst.state.json"), ("/abs/d.md.state.json", "/abs/d.md.state.json")]
    target = f"file://{tmp_path}/saved"
    for k in (1, 2):
        scan.write_states(spark.createDataFrame([("a.md", "s", k, 2, 1)], "path string, seg_id string, feed_id bigint, source_hash bigint, at int"), target, "path", "at")
        assert [r.feed_id for r in scan.read_written_states(spark, target).collect()] == [k]


def test_event_sessions(spark):
    import datetime as dt

    t = dt.datetime(2026, 1, 1)
    rows = spark.createDataFrame([(1, t), (1, t + dt.timedelta(minutes=10)), (1, t + dt.timedelta(hours=2))], "user_id bigint, ts timestamp")
    assert sorted(r.events for r in ST.sessions(rows).collect()) == [1, 2]
