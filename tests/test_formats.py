from weftline.functions import formats as M
from weftline.functions import quality as Q


def test_code_that_stands_for_code():
    assert M.stands_for("ParamSpec", "ParamSpecs") and M.stands_for("tp_alloc", "tp_alloc()") and M.stands_for("MyRing", "MyRing.") and M.stands_for("f()", "f())")
    assert not M.stands_for("i", "is") and not M.stands_for("({next(){}})", "({next(){}")
    assert M.stands_for("OR", "ORs") and M.shed_edges("") == ""
    assert M.unmatched_code(["a", "bars", "x"], ["bar", "a", "new"]) == (["x"], ["new"])
    assert M.written_as_text("a heap here", "heap") and not M.written_as_text("heaps", "heap")


def test_asciidoc_pairs():
    assert M.unclosable_pairs("the `heap`에 and *bold* text") == ["`heap`에"]
    assert M.unclosable_pairs("``heap``에, min_heap_size, 2 * 3 * 4") == []
    assert M.unclosable_quotes('"`term`"은 and "`other`" here') == ['"`term`"은']
    assert Q.format_issues("Use `heap` now.", "`heap`을 씁니다.", "asciidoc") and not Q.format_issues("Use `heap` now.", "``heap``을 씁니다.", "asciidoc")
    assert Q.repair("asciidoc", "Use `heap`.", "`heap`을 씁니다.") == "``heap``을 씁니다."


def test_rst_pairs():
    assert M.rst_broken_pairs("``x``를 and **b** and :ref:`t` fine") == ["``x``를"]
    assert M.rst_broken_pairs("``x``\\ 를, *e* and `n <t>`_ here") == []
    assert M.rst_broken_references("[2]_에서 and [RFC]_ here") == ["[2]_에"]
    assert M.rst_reference_runs("`a`_ and ``b`` and `c <d>`__ .") == 4
    assert Q.repair("rst", "See ``x``.", "``x``를 봅니다.") == "``x``\\ 를 봅니다."
    assert M.audit("rst", "See ``x``.", "``x``를 봅니다.", Q.construct_issues, Q.repair)[0] == "Repaired"
    assert M.audit("rst", "See ``x``.", "봅니다.", Q.construct_issues, Q.repair)[0] == "Unrepairable"
    assert M.audit("rst", "See ``x``.", "봅니다 ``x``.", Q.construct_issues, Q.repair) == ("Sound", "봅니다 ``x``.", [])


def test_verso_and_latex():
    assert M.verso_structure("{ref}[a] $`x` {lean}`b c` {name}") == ["code {lean}`b c`", "label {ref}", "math $`x`", "role {name}"]
    assert M.restore_verso("{lean}`a\u00a0b` x", "y {lean}`a b`") == "y {lean}`a\u00a0b`"
    assert Q.format_issues("{ref}[a] text", "text", "verso") == ["structure label {ref} differs"]
    assert M.without_reference_keys("see \\cite[p. 1]{key} and \\href{http://x}{label} \\indexsee{a}{b}.") == "see   and  {label}  ."


def test_xml_tags():
    source = 'A <em class="x">b <code>c &lt; d</code></em> <br/> e</p> <!-- n -->'
    text, tags = M.xml_tagify(source)
    assert text == "A <g1>b <x2/></g1> <x3/> e<x4/> <x5/>" and Q.untag(text, tags) == source
    assert M.xml_prose("<p>a <b>b</b> &amp; <script>no</script> c</p>") == "a b & c"
    assert M.xml_tagify("") == ("", [])
