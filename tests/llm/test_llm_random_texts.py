"""Any text at all is taken without a crash, and long ones in linear time."""

import time

from hypothesis import given, settings
from hypothesis import strategies as st

from weftline.llm import bitext, encode, leakage, markup, pairs, repetition, terminal

PIECES = ["<b>", "</b>", "<pre>", "</pre>", "<!--", "-->", "<a href='", "```", "~~~", "`", "$", "$$", "\\[", "\\]", "\\begin{verbatim}", "\\end{verbatim}", "\\section{", "{", "}", "{{", "}}", "[[", "]]", "'''", "==", "* ", "# ", "- ", "1. ", "|", "&amp;", "&#0;", "\n", "\n\n", " ", "\t", "\0", "​", "　", "a", "Word", "sealed buffer", "I cannot translate this.", "번역할 수 없습니다.", "한국어 문장", "日本語", "ру", "é", "\U0001f600", "12", "...", "…", ".", "'s", "!'", "�", "ﬀ", "İ"]
TEXTS = st.lists(st.sampled_from(PIECES), max_size=40).map("".join)
ENCODER = encode.ForcedEncoder("/opt/tokenizers/byte_bpe_50k.tiktoken")


@settings(max_examples=400, deadline=None, derandomize=True)
@given(a=TEXTS, b=TEXTS)
def test_any_text(a, b):
    assert isinstance(markup.elements(a), list) and isinstance(markup.clean(a), str)
    assert ENCODER.encode(a) == ENCODER.core.encode_ordinary(a)
    assert all(0.0 <= x <= 1.0 for x in repetition.measure(a))
    assert pairs.defect_of(a, b, "ko", -1.0) in (None, "empty", "truncated", "refusal", "copy", "wrong_language")
    assert len(terminal.matrix([(a, b), (None, b)], frozenset())) == 2
    leakage.leaked(leakage.Index([(1, a)]), [b, a, None])
    lexicon = bitext.Lexicon()
    sides = a.split("\n"), b.split("\n")
    assert all(0 <= i < len(sides[0]) and 0 <= j < len(sides[1]) for i, j in bitext.align(*sides, lexicon))


def test_long_texts():
    for piece in PIECES:
        text = (piece + " x") * 5000
        for read in (markup.elements, repetition.measure, leakage.unmarked, ENCODER.encode, pairs.plain, lambda t: terminal.features(t, t, frozenset()), lambda t: pairs.defect_of("A source.", t, "ko", -1.0)):
            began = time.time()
            read(text)
            assert time.time() - began < 20, (piece, read)
