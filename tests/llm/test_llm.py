import random

import numpy as np
import pytest

from weftline.llm import bitext, consensus, encode, leakage, markup, pairs, ranking, repetition, terminal, truncation

VOCABULARY = "/opt/tokenizers/byte_bpe_50k.tiktoken"


# --- markup


@pytest.mark.parametrize(
    ("text", "found"),
    [
        (None, []),
        ("", []),
        ("plain $5 - $2 and 5 * 3 * 2, C:\\temp\\x, vector<int> a; {\"a\": 1} issue #7 a -- b", []),
        ("```py\n# no <b>heading</b>\n```", [("markdown", "code")]),
        ("<pre><code>a &lt; b</code></pre>", [("html", "code")]),
        ("\\begin{verbatim}\n$x$\n\\end{verbatim}", [("latex", "code")]),
        ('<syntaxhighlight lang="c">\nint a;\n</syntaxhighlight>', [("wiki", "code")]),
        ("Text $x_{1}=2$ and \\(y\\)", [("latex", "formula")]),
        ("<math><mi>x</mi></math>", [("html", "formula")]),
        ("{{math|a = 1}}", [("wiki", "formula")]),
        ("== H ==\n* a", [("wiki", "heading"), ("wiki", "list")]),
        ("## H ##\n* a", [("markdown", "heading"), ("markdown", "list")]),
        ("**bold** at the start", [("markdown", "other")]),
        ("*# a\n** b", [("wiki", "list")]),
        ("Title\n=====\n\n1. a\n2. b", [("markdown", "heading"), ("markdown", "list")]),
        ("<ul><li>a<li>b</ul> &nbsp;", [("html", "list"), ("html", "other")]),
        ("\\section{A} \\begin{itemize}\\item x\\end{itemize}~\\cite{k}", [("latex", "heading"), ("latex", "list"), ("latex", "other")]),
        ("[[a|b]] '''c'''", [("wiki", "other")]),
    ],
)
def test_elements(text, found):
    assert markup.elements(text) == found


def test_clean_keeps_structure():
    got = markup.clean("<h2>Top</h2><p>Some <b>bold</b> text of a line.</p><ul><li>one</ul>\n```\nx < 1\n```\n$a_1$ end")
    assert "# Top" in got and "Some bold text" in got and "- one" in got and "x < 1" in got and "$a_1$" in got and "<" not in got.replace("x < 1", "")
    assert markup.clean(None) is None and markup.clean("") == ""


def test_regions_select_the_content(monkeypatch):
    """Rows of links are no content; without the clusters they stay."""
    menu = '<div class="nav"><a href="/">Home</a> <a href="/d">Docs</a> <a href="/a">API</a> <a href="/f">FAQ</a></div>'
    body = [f"<p>The <b>cursor</b> waits for line {k} until the buffer is sealed and the worker ends.</p>" for k in range(6)]
    text = "\n".join([menu, menu, *body, menu, "<h2>End</h2>", menu])
    got = markup.clean(text)
    assert "Home" not in got and "FAQ" not in got and "# End" in got and got.count("The cursor waits") == 6
    assert ("html", "other") in markup.elements(menu)
    monkeypatch.setattr(markup, "content_lines", lambda ratios: [True] * len(ratios))
    assert markup.clean(text).count("Home") == 4


def test_many_code_blocks_take_linear_time():
    import time

    for block in ("```\nx\n```\n", "<pre>x</pre>\n", "\\begin{verbatim}\nx\n\\end{verbatim}\n"):
        assert len(markup.Markup(block * 20 + "end").blocks) == 20
    began = time.time()
    markup.Markup("```\nx\n```\n" * 20000)
    assert time.time() - began < 10


def test_markup_frame(spark):
    rows = spark.createDataFrame([(1, "<b>a</b>", None, "x"), (2, None, "", "x"), (1, "<b>a</b>", None, "x")], "id bigint, source string, translation string, side string")
    assert [tuple(r) for r in markup.find_markup(rows, "id").collect()] == [(1, "source", "html", "other")] * 2
    assert markup.find_markup(rows.limit(0), "id").count() == 0


# --- truncation


def _sentences(rng, n):
    subject, verb = ["스냅샷은", "커서는", "렉서가", "버퍼는", "작업자는"], ["기다립니다.", "시작합니다.", "끝납니다.", "바뀝니다.", "읽습니다."]
    english = ["snapshot", "cursor", "lexer", "buffer", "worker"]
    out = []
    for _ in range(n):
        k, number = rng.randrange(5), rng.randrange(999)
        out.append((f"The {english[k]} waits for {number} steps.", f"{subject[k]} {number}번 단계를 {rng.choice(verb)}"))
    return " ".join(a for a, _ in out), " ".join(b for _, b in out)


def test_held_out_cuts_are_found():
    rng = random.Random(2)
    whole = [_sentences(rng, rng.randrange(1, 4)) for _ in range(900)]
    model = terminal.fit(whole[:600])
    held = whole[600:]
    lost = [(s, terminal.cut(t, rng, frozenset())) for s, t in held] + [(s, c) for s, t in held if (c := terminal.cut_after_sentence(t, rng))]
    assert (model.margin(held) > 0).mean() < 0.03
    assert (model.margin([x for x in lost if x[1].strip()]) > 0).mean() > 0.95
    # an outdated translation of other sources is whole
    assert (model.margin([(a[0], b[1]) for a, b in zip(held, held[7:])]) > 0).mean() < 0.2


def test_no_sample_calls_nothing_cut():
    assert terminal.fit([]).margin([("a", "b")]).tolist() == [0.0]
    assert terminal.fit([]).margin([]).tolist() == []


def _with_a_limit(n, at, of):
    """n texts of varied length, each of which ends in a full stop but one in `of`, which stops at a length of `at`."""
    rng = random.Random(14)
    whole = [" ".join(_sentences(rng, 1)[1].split() * 30)[: rng.randrange(110, 300)] + f" {k}." for k in range(n)]
    return [(f"{k} " + t)[: at - 1] + "x" if k % of == 0 else t for k, t in enumerate(whole)]


def test_limits_are_counted_over_all_rows(spark, monkeypatch):
    models = []
    for module in (truncation, pairs):
        real = module.fit
        monkeypatch.setattr(module, "fit", lambda *a, real=real, **k: models.append(real(*a, **k)) or models[-1])
    values = _with_a_limit(1200, 100, 40)
    texts = spark.createDataFrame([("segment_states", k, 0, "p", "A source.", t) for k, t in enumerate(values)], "src string, row_id bigint, pos int, owner string, source string, text string")
    truncation.truncated_texts(texts, bound=60)
    assert models[0].limits == {100}
    rows = spark.createDataFrame([(k, "A source.", t, "ko") for k, t in enumerate(values)], "pair_id bigint, source string, translation string, target_lang string")
    models.clear()
    pairs.flag_pairs(rows, "pair_id", "source", "translation", "target_lang", bound=60)
    assert models[0].limits == {100}


def test_common_limits():
    near = {n: 2 for n in range(50, 150)}
    assert terminal.common_limits(near | {88: 33, 120: 13}) == {88, 120}
    # eight among many lengths of two each are chance, and any length can be a limit
    assert terminal.common_limits(near | {88: 8}) == frozenset()
    assert terminal.common_limits({1 << 17: 20}) == {1 << 17}
    assert terminal.common_limits({}) == frozenset()


def test_truncation_frame(spark):
    rng = random.Random(3)
    texts = [("segment_states", k, 0, "p", *_sentences(rng, 2)) for k in range(300)] + [("segment_states", 999, 0, "p", "A source.", None), ("segment_states", 998, 0, "p", "A source.", " ")]
    schema = "src string, row_id bigint, pos int, owner string, source string, text string"
    scored = truncation.truncated_texts(spark.createDataFrame(texts, schema))
    assert scored.filter("row_id >= 998 and truncated").count() == 0 and scored.count() == 302
    assert truncation.rates(scored).first()["texts"] == 300
    assert truncation.truncated_texts(spark.createDataFrame([], schema)).count() == 0


# --- pairs

SOURCE = "The remote cursor writes 12 lines into the buffer and then exits."


@pytest.mark.parametrize(
    ("source", "response", "target", "defect"),
    [
        (SOURCE, None, "ko", "empty"),
        (SOURCE, "<p></p>", "ko", "empty"),
        (SOURCE, "\u200b", "ko", "empty"),
        (SOURCE, SOURCE.upper(), "ko", "copy"),
        (SOURCE, "번역: " + SOURCE, "ko", "copy"),
        (SOURCE, SOURCE.replace("remote ", ""), "ja", "copy"),
        (SOURCE, "죄송하지만 이 내용은 번역해 드릴 수 없습니다.", "ko", "refusal"),
        (SOURCE, "As a language model I am unable to help with that request.", "ko", "refusal"),
        (SOURCE, "Der Cursor schreibt die Zeilen und das ist nicht alles.", "ko", "wrong_language"),
        (SOURCE, "カーソルは行を書き込みます。", "ko", "wrong_language"),
        (SOURCE, "원격 커서는 버퍼에 12줄을 쓴 뒤 종료합니다.", "ko", None),
        (SOURCE, '도구는 "번역할 수 없습니다"를 출력합니다.', "ko", None),
        ("`flush_block`", "`flush_block`", "ko", None),
        ("opal v12", "opal v12", "ko", None),
        ("https://a.example/x", "https://a.example/x", "ko", None),
        (SOURCE, "원격 커서는 버퍼에", None, None),
    ],
)
def test_defects(source, response, target, defect):
    assert pairs.defect_of(source, response, target, -1.0) == defect


#: Written by hand, without a look at the dictionaries: wrong languages and refusals in wordings of their own.
HELD_OUT_LANGUAGES = [
    ("ko", "Курсор записывает двенадцать строк в буфер и завершает работу."),
    ("de", "Курсор записывает двенадцать строк в буфер и завершает работу."),
    ("en", "Снимок ждёт, пока рабочий процесс не освободит буфер."),
    ("uk", "Этот файл читается при каждом запуске, и его нельзя менять, если процесс ещё работает."),
    ("ko", "يكتب المؤشر اثني عشر سطرا في المخزن ثم ينتهي."),
    ("ja", "يكتب المؤشر اثني عشر سطرا في المخزن ثم ينتهي."),
    ("fr", "يقرأ العامل الملف قبل كل تشغيل."),
    ("ko", "เคอร์เซอร์เขียนสิบสองบรรทัดลงในบัฟเฟอร์แล้วจบการทำงาน"),
    ("en", "เคอร์เซอร์เขียนสิบสองบรรทัดลงในบัฟเฟอร์แล้วจบการทำงาน"),
    ("ko", "Il cursore scrive dodici righe nel buffer e poi termina."),
    ("de", "Il cursore scrive dodici righe nel buffer e poi termina."),
    ("pt", "Il cursore non scrive nel buffer se la coda è piena."),
    ("ko", "O cursor escreve doze linhas no buffer e depois termina."),
    ("es", "O cursor não escreve no buffer quando a fila está cheia."),
    ("en", "O cursor escreve doze linhas no buffer e depois termina, mas não fecha a fila."),
    ("ko", "Ο δρομέας γράφει δώδεκα γραμμές στην προσωρινή μνήμη."),
    ("ru", "커서는 버퍼에 열두 줄을 쓴 뒤 종료합니다."),
    ("th", "カーソルはバッファに十二行を書き込んで終了します。"),
    ("ar", "The cursor writes twelve lines into the buffer and then it exits."),
    ("zh", "The cursor writes twelve lines into the buffer and then it exits."),
    ("hi", "De cursor schrijft twaalf regels in de buffer en wordt dan gesloten."),
]
HELD_OUT_REFUSALS = [
    ("en", "Sadly I won't be able to help you with that."), ("en", "This content cannot be translated."), ("en", "I have to decline this request."), ("ko", "We're not comfortable providing a rendering of this passage."),
    ("de", "Leider kann ich Ihnen bei dieser Anfrage nicht weiterhelfen."), ("de", "Ich darf diesen Text nicht übersetzen."), ("es", "No me es posible traducir este fragmento."), ("fr", "Il m'est impossible de traduire ce passage."), ("fr", "Nous ne pouvons pas répondre à cette demande."),
    ("it", "Non sono in grado di tradurre questo testo."), ("it", "Mi dispiace, ma devo fermarmi qui."), ("pt", "Não consigo ajudar com este pedido."), ("pt", "Peço desculpa, mas não posso traduzir isto."), ("ru", "Я не могу перевести этот текст."), ("ru", "К сожалению, выполнить этот запрос невозможно."),
    ("ar", "لا يمكنني ترجمة هذا النص."), ("ar", "أعتذر، لن أستطيع مساعدتك في ذلك."), ("th", "ขออภัย ฉันแปลข้อความนี้ไม่ได้"), ("th", "ไม่สามารถช่วยแปลข้อความนี้ได้"), ("zh", "很抱歉，我无法翻译这段内容。"), ("zh", "我不能协助完成该请求。"), ("ko", "이 문장은 번역해 드리기 어렵습니다."), ("ja", "この文章の翻訳はいたしかねます。"), ("pl", "Nie mogę przetłumaczyć tego tekstu."),
]
HELD_OUT_SOUND = [
    ("ru", "Курсор записывает двенадцать строк в буфер и завершает работу."), ("uk", "Цей файл читається при кожному запуску, і його не можна змінювати."), ("ar", "يكتب المؤشر اثني عشر سطرا في `buffer` ثم ينتهي."), ("th", "เคอร์เซอร์เขียนสิบสองบรรทัดลงในบัฟเฟอร์แล้วจบการทำงาน"),
    ("it", "Il cursore non scrive nel buffer se la coda è piena."), ("pt", "O cursor não escreve no buffer quando a fila está cheia."), ("en", "Requests without a token are declined."), ("en", "The server cannot process more than 12 lines."), ("ko", "토큰이 없는 요청은 거절됩니다."), ("ko", "GitHub Actions는 OpenSSL 대신 NumPy를 사용합니다."),
    ("ja", "カーソルはバッファに 12 行を書き込みます。"), ("zh", "光标向缓冲区写入十二行，然后退出。"), ("de", "Der Cursor schreibt zwölf Zeilen in den Puffer und wird dann beendet."), ("fr", "Le serveur ne peut pas traiter plus de douze lignes."), ("es", "No se puede abrir el archivo sin permiso."), ("ru", "Процесс не может обработать больше двенадцати строк."), ("el", "Ο δρομέας γράφει δώδεκα γραμμές."),
]


def test_held_out_languages_and_refusals():
    wrong = [pairs.defect_of(SOURCE, t, want, -1.0) == "wrong_language" for want, t in HELD_OUT_LANGUAGES]
    refusals = [pairs.defect_of(SOURCE, t, want, -1.0) == "refusal" for want, t in HELD_OUT_REFUSALS]
    sound = [pairs.defect_of(SOURCE, t, want, -1.0) is None for want, t in HELD_OUT_SOUND]
    missed = [t for (_, t), ok in zip(HELD_OUT_LANGUAGES + HELD_OUT_REFUSALS + HELD_OUT_SOUND, wrong + refusals + sound) if not ok]
    assert np.mean(wrong) >= 0.9 and np.mean(refusals) >= 0.9 and np.mean(sound) >= 0.9, missed


def test_an_apology_is_translated():
    assert pairs.defect_of("Sorry, the page was not found.", "죄송합니다. 페이지를 찾을 수 없습니다.", "ko", -1.0) is None


def test_every_target_language_is_sampled(spark):
    rows = [(k, f"The cursor waits for line {k}.", f"Text {k} wartet.", f"l{k % 12}") for k in range(600)]
    frame = spark.createDataFrame(rows, "pair bigint, source string, response string, target string")
    _, sizes = pairs.census(frame)
    found = pairs.sample(frame, sizes, bound=20)
    assert {t for *_, t in found} == {f"l{k}" for k in range(12)} and 120 < len(found) < 400
    assert len(pairs.sample(frame, sizes, bound=20, total=60)) < 130
    assert len(pairs.sample(frame, sizes)) == 600


def test_compression_decides_copies(monkeypatch):
    """Nearly a copy: its pieces are the prompt's, and only the compressed size tells it from a text of the prompt's words in another order."""
    near = SOURCE.replace("remote ", "")
    words = SOURCE.rstrip(".").split()
    shuffled = " ".join(f"{a} zu {b} auf" for a, b in zip(words[::-1], words[3:]))
    assert pairs.copied(SOURCE, near) and not pairs.copied(SOURCE, shuffled)
    monkeypatch.setattr(pairs, "COPY_SHARE", 0.0)
    assert not pairs.copied(SOURCE, near)


def test_terminal_margin_decides_last():
    assert pairs.defect_of(SOURCE, "원격 커서는 버퍼에 12", "ko", 1.0) == "truncated"


def test_pairs_frame(spark):
    schema = "pair_id bigint, source string, translation string, target_lang string, defect string"
    rows = spark.createDataFrame([(1, SOURCE, None, "ko", "clash"), (1, SOURCE, None, "ko", "clash"), (2, None, "가나다.", None, None)], schema)
    got = pairs.flag_pairs(rows, "pair_id", "source", "translation", "target_lang")
    assert sorted((r.pair_id, r.defect) for r in got.collect() if r.pair_id == 1) == [(1, "empty")] * 2
    assert pairs.flag_pairs(rows.limit(0), "pair_id", "source", "translation", "target_lang").count() == 0


# --- consensus and ranking


def _votes(rng, items, skills):
    truth = {i: rng.choice(["baseline", "candidate", "tie"]) for i in range(items)}
    labels = ["baseline", "candidate", "tie"]
    rows = []
    for i in truth:
        for a, skill in skills.items():
            for order in ("AB", "BA"):
                v = truth[i] if rng.random() < abs(skill) else rng.choice(labels)
                if skill == 0:
                    v = "baseline" if order == "AB" else "candidate"
                if skill < 0:
                    v = {"baseline": "candidate", "candidate": "baseline"}.get(v, v)
                rows.append((i, a, order, v, len(rows)))
    return truth, rows


BALLOTS = "item bigint, annotator string, context string, label string, seq bigint"


def test_consensus_beats_the_majority(spark):
    rng = random.Random(4)
    truth, rows = _votes(rng, 150, {"good": 0.8, "fair": 0.7, "first": 0, "turned": -0.8, "first2": 0, "turned2": -0.7, "fine": 0.75})
    labels, weights = consensus.Consensus(spark.createDataFrame(rows, BALLOTS)).run()
    got = {r.item: r.label for r in labels.collect()}
    assert np.mean([got[i] == truth[i] for i in truth]) > 0.9
    v = {r.annotator: r.reliability for r in weights.collect()}
    assert v["good"] > 0.3 and v["turned"] < -0.2 and abs(v["first"]) < 0.2


def test_power_iteration_equals_the_dense_matrix(spark):
    rng = random.Random(6)
    _, rows = _votes(rng, 60, {"a": 0.9, "b": 0.5, "c": 0.7, "d": 0})
    run = consensus.Consensus(spark.createDataFrame(rows, BALLOTS))
    names = ["a", "b", "c", "d"]
    x = np.zeros((4, 60 * 3))
    for r in run.centred.collect():
        x[names.index(r.annotator), r.item * 3 : r.item * 3 + 3] = [r.x0, r.x1, r.x2]
    c = x @ x.T
    np.fill_diagonal(c, 0)
    w, vec = np.linalg.eig(c / (60 * 3))
    lead = np.abs(np.real(vec[:, np.argmax(np.real(w))]))
    for found in (run.reliabilities(), run._joined_reliabilities(40)):
        got = {r.annotator: r.v for r in found.collect()}
        got = np.array([abs(got[n]) for n in names])
        assert np.allclose(got / np.linalg.norm(got), lead / np.linalg.norm(lead), atol=0.02)


def test_gathered_and_joined_votes_agree(spark, monkeypatch):
    rng = random.Random(16)
    _, rows = _votes(rng, 80, {"a": 0.9, "b": 0.5, "c": 0.7, "d": 0, "e": -0.6})
    ballots = spark.createDataFrame(rows, BALLOTS)
    labels, weights = consensus.Consensus(ballots).run()
    monkeypatch.setattr(consensus, "GATHERED", 2)
    joined, joined_weights = consensus.Consensus(ballots).run()
    assert {tuple(r) for r in labels.collect()} == {tuple(r) for r in joined.collect()}
    by = {r.annotator: r.reliability for r in weights.collect()}
    assert all(abs(by[r.annotator] - r.reliability) < 1e-6 for r in joined_weights.collect())


def test_the_reliabilities_decide(spark):
    """Eight careless annotators outvote two careful ones; only the weights of the eigenvector give the true labels."""
    rng = random.Random(18)
    truth, rows = _votes(rng, 120, {"good": 0.97, "fine": 0.95, **{f"w{k}": 0.05 for k in range(8)}})
    run = consensus.Consensus(spark.createDataFrame(rows, BALLOTS))
    labels, weights = run.run()
    share = lambda df: np.mean([truth[r.item] == r.label for r in df.collect()])
    equal = weights.withColumn("v", weights["v"] * 0 + 1)
    assert share(labels) > 0.95 > share(run.spectral(equal)) + 0.03
    assert share(run.calibrated(labels)) > 0.95


def test_consensus_edge_cases(spark):
    rows = [(1, "a", None, "tie", 1), (1, "a", None, "tie", 2), (2, None, "AB", "tie", 3), (None, "a", "AB", "tie", 4), (3, "a", "AB", None, 5)]
    labels, _ = consensus.Consensus(spark.createDataFrame(rows, BALLOTS)).run()
    assert [tuple(r) for r in labels.collect()] == [(1, "tie")]
    labels, weights = consensus.Consensus(spark.createDataFrame([], BALLOTS)).run()
    assert labels.count() == 0 and weights.count() == 0


def _games(rng, strength, n):
    names = list(strength)
    out = []
    for _ in range(n):
        a, b = rng.sample(names, 2)
        out.append((a, b, float(rng.random() < 1 / (1 + np.exp(strength[b] - strength[a])))))
    return out


OUTCOMES = "left string, right string, score double"


def test_ranking_on_the_driver_and_joined_agree(spark):
    rng = random.Random(8)
    strength = {f"s{k}": 1.0 * k for k in range(5)}
    games = _games(rng, strength, 2000) + [("x", "y", 1.0)] * 5 + [("lonely", "lonely", 1.0), ("s1", None, 1.0), ("s2", "s3", None)]
    df = spark.createDataFrame(games, OUTCOMES)
    got = {r.system: r for r in ranking.rank(df).collect()}
    order = sorted(got, key=lambda s: got[s].rank_no)
    assert [s for s in order if s.startswith("s")] == [f"s{k}" for k in range(4, -1, -1)]
    assert got["lonely"].strength == 0.0 and got["x"].strength > 0 > got["y"].strength
    joined = {r.system: r for r in ranking.rank(df, most=2).collect()}
    assert joined.keys() == got.keys()
    assert all(joined[s].rank_no == got[s].rank_no and joined[s].comparisons == got[s].comparisons and abs(joined[s].strength - got[s].strength) < 0.01 for s in got)
    assert ranking.rank(df.limit(0)).count() == 0


def _dense(count, i, j, margin, weight, rounds):
    """Brute force: the whole Laplacian, solved directly in each round."""
    theta = np.zeros(count)
    for _ in range(rounds):
        u = np.sqrt(weight) / np.maximum(np.abs(margin - theta[i] + theta[j]), ranking.FLOOR)
        m = np.eye(count) * ranking.PRIOR
        for x, y, s in ((i, i, 1), (j, j, 1), (i, j, -1), (j, i, -1)):
            np.add.at(m, (x, y), s * u)
        new = np.linalg.solve(m, np.bincount(i, u * margin, count) - np.bincount(j, u * margin, count))
        moved, theta = np.abs(new - theta).max(), new
        if moved < ranking.TOLERANCE:
            break
    return theta


def test_a_long_chain_is_solved_to_its_ends():
    """2,000 systems of which each met only its neighbours: strengths travel along the whole chain, as in the direct solution."""
    rng = np.random.default_rng(4)
    i, j = np.arange(1999), np.arange(1, 2000)
    margin, weight = rng.normal(0.0, 1.0, 1999), rng.uniform(1, 50, 1999)
    assert np.allclose(ranking.solve(2000, i, j, margin, weight, 3), _dense(2000, i, j, margin, weight, 3), atol=1e-5)
    small = rng.integers(0, 30, (2, 200))
    i, j = small[:, small[0] != small[1]]
    margin, weight = rng.normal(0.0, 1.0, len(i)), rng.uniform(1, 50, len(i))
    assert np.allclose(ranking.solve(30, i, j, margin, weight), _dense(30, i, j, margin, weight, ranking.ROUNDS), atol=1e-4)


# --- bitexts


def _bitexts(rng, n):
    nouns = {"cursor": "커서", "lexer": "렉서", "buffer": "버퍼", "queue": "대기열", "worker": "작업자", "socket": "소켓"}
    verbs = {"reads": "읽습니다", "moves": "옮깁니다", "seals": "봉인합니다"}
    docs = []
    for _ in range(n):
        s, t, links = [], [], []
        for _ in range(rng.randrange(4, 9)):
            a, b, v, k = rng.choice(list(nouns)), rng.choice(list(nouns)), rng.choice(list(verbs)), rng.randrange(1000, 9999)
            roll = rng.random()
            en, ko = f"The {a} {v} the {b} {k} times.", f"{nouns[a]}는 {nouns[b]}를 {k}번 {verbs[v]}."
            if roll < 0.1:
                s.append(en)
            elif roll < 0.2:
                t.append(ko)
            else:
                links.append((len(s), len(t)))
                s.append(en)
                t.append(ko)
        docs.append((s, t, links))
    return docs


def test_alignment():
    rng = random.Random(9)
    docs = _bitexts(rng, 60)
    lexicon = bitext.fit_lexicon([(s, t) for s, t, _ in docs])
    got = [set(bitext.align(s, t, lexicon)) for s, t, _ in docs]
    want = [set(x) for _, _, x in docs]
    hits = sum(len(a & b) for a, b in zip(got, want))
    assert hits / sum(map(len, got)) > 0.97 and hits / sum(map(len, want)) > 0.97
    assert bitext.align([], ["a"], lexicon) == []


def test_chain_is_longest():
    assert bitext.chain([(0, 0, 1), (1, 5, 1), (2, 1, 1), (3, 2, 1)]) == [(0, 0), (2, 1), (3, 2)]
    assert bitext.chain([]) == []


def test_names_and_cognates_are_anchors():
    lexicon = bitext.Lexicon()
    # names stay in Latin letters, and no number or code is shared
    source = ["GitHub Actions runs the job first.", "Then OpenSSL signs the archive.", "At last NumPy reads it."]
    target = ["먼저 GitHub Actions가 작업을 실행합니다.", "이어서 OpenSSL로 보관 파일에 서명합니다.", "마지막으로 NumPy가 읽습니다."]
    assert bitext.chain(bitext.Document(source, target).points()) == [(0, 0), (1, 1), (2, 2)]
    assert bitext.align(source, target, lexicon) == [(0, 0), (1, 1), (2, 2)]
    # a name that one side has alone is no anchor, so it can't speak against a pair
    assert not any(a[0] in "wg" for s in bitext.Document(source[:1], ["먼저 작업을 실행합니다."]).anchors for x in s for a in x)
    doc = bitext.Document(["The operation was cancelled.", "It needs authentication."], ["L'opération a été annulée.", "Une authentification est requise."])
    assert "g:opera" in doc.anchors[0][0] & doc.anchors[1][0] and "g:authe" in doc.anchors[0][1] & doc.anchors[1][1]


def test_scores_of_a_table_equal_those_in_parts(monkeypatch):
    rng = random.Random(19)
    docs = _bitexts(rng, 30)
    lexicon = bitext.fit_lexicon([(s, t) for s, t, _ in docs])
    whole = [bitext.align(s, t, lexicon) for s, t, _ in docs]
    monkeypatch.setattr(bitext, "CELLS", 1)
    assert [bitext.align(s, t, lexicon) for s, t, _ in docs] == whole


def test_words_that_the_sample_lacks_bring_documents(spark):
    rows = [(k, [(0, f"The cursor waits {k}.")], [(0, f"커서 {k}.")]) for k in range(200)] + [(500 + k, [(0, f"A rare gazebo waits {k}.")], [(0, f"정자 {k}.")]) for k in range(4)] + [(900, [(0, "Once only hapax.")], [(0, "한번.")])]
    named = spark.createDataFrame(rows, "doc bigint, source array<struct<idx:int,text:string>>, target array<struct<idx:int,text:string>>")
    got = bitext.sample(named, bound=20)
    held = sum("gazebo" in s[0] for s, _ in got)
    assert held >= 2 and len(got) < 60
    assert len(bitext.sample(named, bound=20, more=1)) == 21 and len(bitext.sample(named)) == 205


def _same_lexicon(got, want):
    for a, b in ((got.forward, want.forward), (got.backward, want.backward)):
        assert b and {w: set(x) for w, x in a.items()} == {w: set(x) for w, x in b.items()}
        assert all(abs(a[w][f] - odds) < 1e-9 for w, x in b.items() for f, odds in x.items())


def test_the_lexicon_is_that_of_all_documents(spark, monkeypatch):
    """Broadcast or, with too many words or links, by joins: each equals the fit of all documents at once, and gives the same links."""
    rng = random.Random(12)
    docs = [(s, t) for s, t, _ in _bitexts(rng, 20)]
    sides = "source array<struct<idx:int,text:string>>, target array<struct<idx:int,text:string>>"
    rows = [(k, list(enumerate(s)), list(enumerate(t))) for k, (s, t) in enumerate(2 * docs)] + [(900, None, [(0, "x")]), (901, [], [])]
    named = spark.createDataFrame(rows, "doc bigint, " + sides)
    want = bitext.fit_lexicon(2 * docs)
    links = sorted((k, i, j) for k, (s, t) in enumerate(2 * docs) for i, j in bitext.align(s, t, want))
    broadcast = bitext.fit_documents(named)
    _same_lexicon(broadcast, want)
    joined = bitext.fit_documents(named, most=3)
    _same_lexicon(bitext._lexicon_of([r.asDict(recursive=True) for r in joined.collect()]), want)
    for lexicon in (broadcast, joined):
        monkeypatch.setattr(bitext, "fit_documents", lambda *_, lexicon=lexicon: lexicon)
        assert sorted(map(tuple, bitext.align_documents(named, "doc", target="target").collect())) == links
    pairs = bitext.checkpoint(bitext.sentence_pairs(named, None))
    seen = pairs.selectExpr("0 side", "explode(a) w").unionAll(pairs.selectExpr("1 side", "explode(b) w")).groupBy("side", "w").count().withColumnRenamed("count", "n").collect()
    assert bitext._fit_broadcast(pairs, seen, 3) is None
    whole = bitext._fit_broadcast(pairs, seen, bitext.LINKS)
    for name, value in (("CELLS", 1), ("LINKS", 2), ("_TABLE", 0)):
        monkeypatch.setattr(bitext, name, value)
        _same_lexicon(bitext._fit_broadcast(pairs, seen, 10**6), whole)


def test_a_renderings_count_does_not_depend_on_a_sample(spark):
    """1,050 documents render a word one way and as many another: both renderings get the odds of all of them, which 800 documents don't give."""
    docs = [([f"The gazebo waits {1000 + k} days."], [f"{'정자' if k % 2 else '누각'} {1000 + k}일."]) for k in range(2100)]
    rows = [(k, list(enumerate(s)), list(enumerate(t))) for k, (s, t) in enumerate(docs)]
    named = spark.createDataFrame(rows, "doc bigint, source array<struct<idx:int,text:string>>, target array<struct<idx:int,text:string>>")
    want = bitext.fit_lexicon(docs)
    _same_lexicon(bitext.fit_documents(named), want)
    part = bitext.fit_lexicon(bitext.sample(named))
    assert part.backward != want.backward


def test_long_gaps_are_aligned_whole():
    rng = np.random.default_rng(5)
    lexicon = bitext.Lexicon()
    # one sentence against 400 without an anchor between
    assert bitext.align(["The cursor reads."], [f"커서 {chr(0xAC00 + k)}" for k in range(400)], lexicon) == []
    # 250 sentences left out: the true diagonal lies that far off the straight one
    n, m, lost = 450, 700, 250
    scores = rng.normal(-1.0, 0.3, (n, m))
    scores[np.arange(n), np.arange(n) + lost] = 2.0
    assert sorted(bitext.gap(scores, scores)) == [(i, i + lost) for i in range(n)]


def test_gap_is_the_same_in_blocks():
    rng = np.random.default_rng(6)
    for _ in range(50):
        shape = tuple(rng.integers(1, 14, 2))
        left, right = rng.normal(0, 1.2, shape), rng.normal(0, 1.2, shape)
        whole = bitext.gap(left, right)
        assert all(bitext.gap(left, right, cells) == whole for cells in (1, 20, 45))


def test_bitext_frame(spark):
    schema = "bitext_id bigint, source array<struct<idx:int,text:string>>, translation array<struct<idx:int,text:string>>, source_idx int"
    rows = [(1, [(4, "Run `a_b` now."), (2, None)], [(7, "`a_b`를 실행합니다.")], 5), (2, None, [(0, "x")], 5), (3, [], [], 5)]
    got = bitext.align_documents(spark.createDataFrame(rows, schema), "bitext_id")
    assert [tuple(r) for r in got.collect()] == [(1, 4, 7)]


# --- encoding


def test_encoding_equals_the_tokenizer():
    known = encode.ForcedEncoder(VOCABULARY)
    rng = random.Random(1)
    alphabet = " \n\t\r\x0b\u3000\u2003\x85\xa0\x1caàbQz'sts'rell!!?..12½한국漢é\U0001f600"
    texts = ["".join(rng.choice(alphabet) for _ in range(rng.randrange(60))) for _ in range(3000)] + ["qz" * 3000, " " * 5000, "漢" * 3000, "<|endoftext|> I'll"]
    for text in texts:
        assert known.encode(text) == known.core.encode_ordinary(text), text[:80]
    assert known.encode(None) == [] and known.encode("") == []


def test_forced_pairs_are_in_no_token():
    known = encode.ForcedEncoder(VOCABULARY)
    assert all(not known.forced[a, b] for t in known.ranks for a, b in zip(t, t[1:]))


def test_texts_are_cut_at_forced_pairs(monkeypatch):
    known = encode.ForcedEncoder(VOCABULARY)
    rng = random.Random(3)
    for alphabet in ("qzxjQZ'st!?; 한글漢é", "abc한국어 문서\n.,()'"):
        for _ in range(500):
            text = "".join(rng.choice(alphabet) for _ in range(rng.randrange(2, 60)))
            at = known.cuts(text).tolist()
            parts = [text[i:j] for i, j in zip([0, *at], [*at, len(text)])]
            assert all(known.forced[text[i - 1].encode()[-1], text[i].encode()[0]] for i in at)
            # fragments are encoded apart and put together again
            assert [i for p in parts for i in known.core.encode_ordinary(p)] == known.core.encode_ordinary(text)
    assert len(known.cuts("The xqzj reader of 문서")) >= 4
    # no cut is made where it would change what the pre-tokenizer sees: after white space, before an apostrophe in signs
    assert 3 not in known.cuts("a  \x01b").tolist() and 1 not in known.cuts("!'s").tolist()
    # the encoder sees the fragments, not the text
    calls = []
    monkeypatch.setattr(known, "core", type("Spy", (), {"encode_ordinary": lambda self, p: calls.append(p) or [0]})())
    known.encode("xqzj xqzj")
    assert len(calls) > 1 and "xqzj xqzj" not in calls


def test_encoding_frame(spark):
    rows = spark.createDataFrame([(1, "a b", [9]), (2, None, None), (3, "", None), (1, "a b", None)], "doc_id bigint, text string, ids array<int>")
    got = sorted((r.doc_id, r.ids) for r in encode.encode_column(rows, "doc_id", "text").collect())
    assert got == [(1, [64, 275]), (1, [64, 275]), (2, []), (3, [])]
    assert encode.encode_column(rows.limit(0), "doc_id", "text").count() == 0


# --- leakage


def _items(rng, n):
    words = [f"w{k}" + "abcdefghij"[k % 10] * (k % 5) for k in range(400)]
    shared = " ".join(rng.choices(words, k=15))
    return [(k, (shared + " " if k % 2 else "") + " ".join(rng.choices(words, k=rng.randrange(40, 80)))) for k in range(n)], words, shared


def test_leaks():
    rng = random.Random(10)
    items, words, shared = _items(rng, 12)
    index = leakage.Index(items)
    body = {k: t.removeprefix(shared).split() for k, t in items}
    noise = lambda n: " ".join(rng.choices(words, k=n))
    run = noise(20) + " <b>" + "</b>,\n".join(body[3][5:19]).upper() + " " + noise(20)
    edited = [w if i % 6 else rng.choice(words) for i, w in enumerate(body[4])]
    broken = " ".join(body[6][:14]).replace(body[6][7], body[6][7][:2] + "-\n" + body[6][7][2:])
    texts = [run, noise(9) + " ".join(edited) + noise(9), shared + " " + noise(20), " ".join(body[5][:8]) + noise(30), None, "", broken, noise(3000) + " ".join(body[7][10:30])]
    assert leakage.leaked(index, texts) == [[3], [4], [], [], [], [], [6], [7]]
    assert leakage.leaked(leakage.Index([]), ["a b c"]) == [[]]


def test_long_texts_are_searched_in_windows(monkeypatch):
    rng = random.Random(11)
    items, words, _ = _items(rng, 4)
    index = leakage.Index(items)
    monkeypatch.setattr(leakage, "WINDOW", 4096)
    text = " ".join(rng.choices(words, k=3000)) + " " + items[2][1] + " " + " ".join(rng.choices(words, k=500))
    assert leakage.leaked(index, [text]) == [[2]]


def test_markup_of_any_length_hides_nothing():
    rng = random.Random(21)
    items, words, _ = _items(rng, 4)
    index = leakage.Index(items)
    body = items[2][1].split()[:12]
    for between in ('<span style="' + "x" * 5000 + '">', "<!-- " + "y " * 4000 + " -->", "<a title='" + "it>s " * 900 + "' href=x>"):
        assert leakage.leaked(index, [" ".join(body[:6]) + " " + between + " " + " ".join(body[6:])]) == [[2]]
    # what only looks like a tag stays text
    assert leakage.without_tags("if a <b, then c > d and <!-- open") == "if a <b, then c > d and <!-- open"


def test_the_lemma_loses_no_changed_item():
    """Against a search of every document by unfiltered alignment, with words changed, added and dropped up to the budget."""
    rng = random.Random(22)
    items, words, _ = _items(rng, 30)
    index = leakage.Index(items)
    for trial in range(120):
        item = index.items[rng.randrange(30)]
        text, budget = list(item.words), item.budget()
        for _ in range(budget):
            at = rng.randrange(len(text))
            roll = rng.random()
            text[at : at + (roll < 0.7)] = [] if roll < 0.3 else [rng.choice(words)]
        own = [w for w, o in zip(item.words, item.own) if o]
        want = leakage.common_in_order(own, text) >= leakage.COVER * len(own)
        noise = rng.choices(words, k=60)
        found = leakage.leaked(index, [" ".join(noise[:30] + text + noise[30:])])[0]
        assert not want or item.key in found, trial
    # single words all through the text: no run of twelve is left, only alignment in the band can tell
    item = index.items[2]
    text = [w if k % 5 else "other" for k, w in enumerate(item.words)]
    assert leakage.leaked(index, [" ".join(text)]) == [[2]]
    assert leakage.common_in_order(["a", "b"], ["a", "b"], (np.array([1, 0]), np.array([2, 2]))) == 1


def test_leak_frame_in_blocks(spark, monkeypatch):
    rng = random.Random(12)
    items, _, _ = _items(rng, 6)
    docs = spark.createDataFrame([(1, items[0][1], 7), (2, None, 7), (3, items[5][1], 7)], "doc_id bigint, text string, item_id bigint")
    held = spark.createDataFrame([*items, (99, None)], "item_id bigint, text string")
    monkeypatch.setattr(leakage, "BLOCK", 1200)
    assert {tuple(r) for r in leakage.find_leaks(docs, "doc_id", "text", held, "item_id", "text").collect()} == {(1, 0), (3, 5)}
    assert leakage.find_leaks(docs, "doc_id", "text", held.limit(0), "item_id", "text").count() == 0


def _copied_items(rng):
    """Six items after one sentence; the first stands under four ids, one of them with a word changed."""
    items, words, _ = _items(rng, 6)
    shared = " ".join(rng.choices(words, k=15))
    items = [(k, shared + " " + t) for k, t in items]
    text = items[0][1]
    changed = text.split()
    changed[-20] = "another"
    return [*items, (20, text), (21, text), (22, " ".join(changed))], text, shared + " " + " ".join(rng.choices(words, k=20))


def test_copies_of_an_item_are_all_reported():
    items, text, only_shared = _copied_items(random.Random(13))
    assert leakage.leaked(leakage.Index(items), [text, only_shared]) == [[0, 20, 21, 22], []]


def test_copies_in_several_blocks_are_all_reported(spark, monkeypatch):
    items, text, only_shared = _copied_items(random.Random(13))
    docs = spark.createDataFrame([(1, text), (2, only_shared)], "doc_id bigint, text string")
    held = spark.createDataFrame(items, "item_id bigint, text string")
    monkeypatch.setattr(leakage, "BLOCK", 1200)
    assert sorted(tuple(r) for r in leakage.find_leaks(docs, "doc_id", "text", held, "item_id", "text").collect()) == [(1, 0), (1, 20), (1, 21), (1, 22)]


# --- repetition


def test_repeated_shares():
    sentence = "The quick cursor reads seven sealed buffers. "
    assert repetition.measure(None) == repetition.measure("  ") == (0.0, 0.0, 0.0, 0.0)
    assert repetition.repeated_passages(sentence * 4) == pytest.approx(0.75, abs=0.03)
    assert repetition.repeated_passages("1. " + sentence + "\n2) " + sentence.upper()) == pytest.approx(0.5, abs=0.08)
    assert repetition.repeated_passages(" ".join(f"w{chr(97 + k % 26)}{chr(97 + k // 26)}" for k in range(300))) == 0.0
    assert repetition.repeated_passages("索引は作業者に依存しません。" * 5) > 0.6


def _brute_share(text, n=4):
    import re

    tokens = [(m.start(), m.group().casefold()) for m in re.finditer(r"[^\W_]+", text) if not m.group().isdecimal()]
    seen, covered = set(), [False] * len(tokens)
    for i in range(len(tokens) - n + 1):
        gram = tuple(w for _, w in tokens[i : i + n])
        if gram in seen:
            covered[i : i + n] = [True] * n
        seen.add(gram)
    ends = [s for s, _ in tokens][1:] + [len(text)]
    return sum(e - s for (s, _), e, c in zip(tokens, ends, covered) if c) / len(text)


def test_share_equals_brute_force():
    rng = random.Random(13)
    for _ in range(200):
        text = " ".join(rng.choice(["aa", "bb", "cc", "7", "Dd,"]) for _ in range(rng.randrange(1, 60)))
        assert repetition.repeated_passages(text) == pytest.approx(_brute_share(text)), text
        assert repetition.repeated_shares(text)[0] == pytest.approx(_brute_share(text, 2)), text


def test_repetition_inside_a_word():
    assert repetition.repeated_passages("Reads a line. " + "sealedbuffer" * 40) > 0.85
    assert repetition.repeated_passages("정적 용어집. " + "정적용어집" * 40) > 0.85
    assert repetition.repeated_shares("Donaudampfschifffahrtsgesellschaft reads a line.") == (0.0, 0.0)


def test_the_host_decides_about_short_phrases(spark):
    """A document that reaches the share only with phrases of two and three words is reported at a bad host and not at a sound one."""
    rng = random.Random(7)
    other = iter(f"{chr(97 + k % 26)}{chr(97 + k // 26 % 26)}{chr(97 + k // 676)}" for k in range(17000))
    doubtful = lambda: " ".join("sealed buffer " + next(other) for _ in range(30))
    bad, sound = "same words again and again here. " * 6, lambda: " ".join(next(other) for _ in range(30))
    rows = [(k, bad, "bad") for k in range(30)] + [(50, doubtful(), "bad"), (51, doubtful(), "sound")] + [(100 + k, sound(), rng.choice(["sound", "a", "b"])) for k in range(200)]
    got = {r.doc_id: r for r in repetition.repetition(spark.createDataFrame(rows, "doc_id bigint, text string, source string")).collect()}
    assert all(got[k].phrases >= 0.3 > got[k].passages for k in (50, 51))
    assert got[50].repetitive and not got[51].repetitive and all(got[k].repetitive for k in range(30))


def test_host_rates(spark):
    bad, good = "same words again and again here. " * 6, " ".join(f"w{chr(97 + k)}" for k in range(26))
    rows = [(k, bad if k % 2 else good, "bad") for k in range(40)] + [(100 + k, good, f"h{k % 5}") for k in range(200)] + [(900, None, None), (901, bad, "single")]
    got = repetition.repetition(spark.createDataFrame(rows, "doc_id bigint, text string, source string"))
    by = {r.doc_id: r for r in got.collect()}
    assert by[1].bad_host and by[1].passages > 0.3 and not by[100].bad_host and by[900].passages == 0.0
    assert by[901].host_rate < 0.9
    assert repetition.repetition(spark.createDataFrame([], "doc_id bigint, text string, source string")).count() == 0
