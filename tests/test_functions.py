import random

import pytest
from hypothesis import given
from hypothesis import strategies as st

from weftline.functions import columns as C
from weftline.functions import glossary as G
from weftline.functions import text as X


def test_sentences():
    assert X.split_sentences("Dr. Smith met Phillip J. Eby. He left.") == ["Dr. Smith met Phillip J. Eby.", "He left."]
    assert X.split_sentences("Crate A. The end") == ["Crate A.", "The end"]
    assert X.split_sentences("See https://a.com/x.Get now. Next") == ["See https://a.com/x.Get now.", "Next"]
    assert X.split_sentences("Use `a. B` here. Then `c") == ["Use `a. B` here.", "Then `c"]
    assert X.split_sentences("한국어 문장입니다. 다음 문장.") == ["한국어 문장입니다. 다음 문장."]
    assert X.split_sentences(" \n") == [] and X.split_sentences("") == []


@given(st.text(alphabet="aB. !?`\n가", max_size=60))
def test_sentences_keep_every_character(text):
    assert "".join("".join(s.split()) for s in X.split_sentences(text)) == "".join(text.split())


def test_hashes():
    assert X.content_hash("") == 0xEF46DB3751D8E999
    assert X.context_hash(None, None) == X.context_hash(0, 0)
    assert X.position("section:1/block:2/seg:3") == (1, 2, 3) and X.position("x") is None
    assert X.flat_index(1, 2, 3) == 1002003


def test_normalisation():
    assert X.normalize_whole("**Propose using:**") == "propose using"
    assert X.normalize_inline("a\n> b\n\n   c ") == "a b c"
    assert X.display_width("가a") == 3
    assert X.split_at_space("aaa bbb ccc", 4) == 3 and X.split_at_space("aaa bbb ccc", 8) == 7
    assert X.heading_slug("A B-c!") == "a-b-c" and X.heading_slug("가") is None
    assert X.shorten("a  b", 2) == "a …"


def test_links():
    assert X.extract_urls("[x](https://a.b/c_(d))에서 https://x.y/z.") == ["https://a.b/c_(d)", "https://x.y/z"]
    assert X.extract_urls("link:https://a.b[t]", brackets_end=True) == ["https://a.b"]
    assert X.markdown_destinations("![i](img/a.png) [b](https://x) [c](d(e).md)") == ["img/a.png", "d(e).md"]
    assert X.alert_markers("> [!TIP]\n[!note") == ["[!TIP]", "[!note"]


def test_register():
    assert X.off_register_endings("한다. 합니다. 갑시다. 해요. 읽자.") == ["…한다.", "…해요."]


def test_multisets():
    assert X.multiset_difference(["a", "a", "b"], ["a"]) == ["a", "b"]
    assert X.is_multiset_subset(["a"], ["a", "b"]) and not X.is_multiset_subset(["a", "a"], ["a"])


def test_glossary():
    g = G.Glossary({"tensor": "텐서", "Tensor Unit": "유닛", "future": "퓨처"}, {"future": ["in the future"]}, {"abstract": ("Abstract", "초록")})
    assert g.find("A Tensor Unit. In the future") == {"Tensor Unit": "유닛"}
    assert g.find("`tensor` my_tensor tensor.py --tensor @tensor") == {}
    assert g.find("**Abstract:**") == {"Abstract": "초록"}
    assert g.unmet("a tensor", "하나") == [("tensor", "텐서")]
    assert g.unmet("Abstract", "초록") == []


def test_terms():
    assert G.prose_chunks("The page tables of `x` are 3 big things") == [["The", "page", "tables", "of"], ["are"], ["big", "things"]]
    assert ("page tables", "page tables") in G.ngrams(["The", "page", "tables", "of"])
    assert G.singulars("page policies") == ["page policy", "page polici", "page policie"] and G.singulars("class") == []


@pytest.mark.parametrize("seed", [1, 2])
def test_columns_equal_python(spark, seed):
    rng = random.Random(seed)
    texts = ["".join(rng.choice("ab. !?가나`[]()3*_ \n") for _ in range(rng.randrange(50))) for _ in range(60)] + ["", " ", "가" * 500]
    rows = spark.createDataFrame([(t,) for t in texts], "t string").select("t", C.sentence_count("t").alias("n"), C.display_width("t").alias("w"), C.prose_letters("t").alias("p"), C.alert_markers("t").alias("m")).collect()
    for r in rows:
        assert (r.n, r.w, r.p, r.m) == (X.sentence_count(r.t), X.display_width(r.t), X.prose_letters(r.t), X.alert_markers(r.t)), r.t


def test_table_rules(spark):
    from pyspark.sql import functions as F

    rows = spark.createDataFrame([(["A", "x", "B"],), ([],)], "h array<string>")
    assert [r[0] for r in rows.select(C.matches_headers(["a", "b"], "h")).collect()] == [True, False]
    assert [r[0] for r in rows.select(C.matches_headers([], "h")).collect()] == [True, True]
    cell = spark.createDataFrame([(0, "Name"), (1, None)], "i int, h string")
    assert [r[0] for r in cell.select(C.keeps_column(F.col("i"), F.col("h"), [], ["name", "1"])).collect()] == [False, False]
