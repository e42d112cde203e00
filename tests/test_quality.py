import random

from weftline.functions import quality as Q


def test_emphasis():
    assert Q.emphasis("*a* **b** ***c***")[0] == [(0, 3, 1), (4, 9, 2), (10, 17, 1), (11, 16, 2)]
    assert Q.emphasis("min_heap_size 5 * 3") == ([], [])
    assert Q.emphasis("`*a*` \\*b\\*")[0] == []
    assert Q.emphasis("**굵게(예)**를")[0] == [] and Q.emphasis("**굵게(예)**를")[1]


def test_repairs():
    assert Q.repair("markdown", "**bold (x)** it", "**굵게(예)**를") == "**굵게(예**)를"
    assert Q.repair("markdown", "_a_ it", "_가_를") == "*가*를"
    assert Q.repair("rst", "", "``x``를") == "``x``\\ 를"
    assert Q.repair("asciidoc", "", "*가*를") == "**가**를"
    assert Q.repair("rmarkdown", "@key", "@key를") == "@{key}를"


def test_evaluators():
    assert Q.evaluate("Call `a` at https://x.y.", "`a`를 https://x.y 에서 호출합니다.") == []
    assert Q.evaluate("Call `a`.", "호출합니다.") == ["code a is missing"]
    assert Q.evaluate("See https://x.y.", "봅니다.") == ["link https://x.y is missing"]
    assert Q.evaluate("One (two).", "하나 ((둘))입니다.") == ["parentheses are doubled"]
    assert Q.evaluate("One.", "하나다.") == ["ending …하나다. leaves the register"]
    assert Q.evaluate("One.", "# 하나입니다.") == ["the first characters open a heading"]
    assert Q.evaluate("[[A]] b.", "가입니다.", "bikeshed") == ["token [[A]] differs"]


def test_tags_round_trip():
    rng = random.Random(1)
    pieces = ["*a*", "**b c**", "`code`", "[link](x.md)", "![i](p.png)", "<br>", "plain", "[r][l]", "_e_", "2 * 3"]
    for _ in range(300):
        text = " ".join(rng.choice(pieces) for _ in range(rng.randrange(8)))
        tagged, tags = Q.tagify(text)
        assert Q.untag(tagged, tags) == text and Q.tag_problems(tagged, tags) == []
    tagged, tags = Q.tagify("*a* `b`")
    assert Q.tag_problems("<g1>x", tags) == ["tag 1 is not closed", "tag 2 is missing"]
    assert Q.tagify("") == ("", [])


def test_layout():
    assert Q.adornment("가나", "=") == "===="
    rows = [["이름", "n"], ["a", "두 칸"]]
    assert Q.read_grid(Q.grid_table(rows)) == rows and Q.grid_table([]) == ""
    assert len({Q.X.display_width(line) for line in Q.grid_table(rows).split("\n")}) == 1
    assert Q.anonymous_duplicates([("A", "x"), ("a", "x"), ("a ", "y")]) == [2]
    assert Q.lost_targets("Name\n====\n", "See Name_.\n") == ["name"]
