"""Defective prompt and response pairs: empty, truncated, refused, copied or in another language.

A response is compressed with its prompt as a zstandard dictionary; one that shrinks to almost
nothing repeats the prompt. Scripts tell languages apart first, dictionaries of function words those that share a
script; dictionaries of how one declines and of what is declined give refusals, and the terminal-context
model tells truncated responses. No pair gets two: the first that holds of empty, refusal, copy,
wrong_language, truncated stands.
"""

from __future__ import annotations

import functools
import html
import re
import unicodedata
from collections import Counter
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from weftline.llm.terminal import TerminalModel, common_limits, fit, open_ended

#: Pairs of each stratum (target language, heading or not), up to chance, that the terminal model is fitted on, and of all strata together (documented bounds; scoring has none).
SAMPLE, TOTAL = 6000, 60_000
#: A response at most this share of its plain size, when compressed with the prompt, repeats the prompt.
COPY_SHARE = 0.45
#: A copy has at least this share of the prompt's letters; and this share of its GRAM-letter pieces occurs in the prompt, without which it can't shrink that far.
COPY_COVER, COPY_PIECES, GRAM = 0.4, 0.3, 4

# How one declines, by language. Followed or preceded closely by what is declined it is a refusal.
DECLINES = (
    r"\b(?:I|we)(?:'m| am|'re| are)? (?:\w+ )?(?:cannot|can't|can not|couldn't|won't|will not|not able to|unable to|not allowed to|not permitted to|not comfortable|decline|refuse|must decline|have to decline|prefer not|am not going to)\b",
    r"\b(?:this|your|that) (?:request|text|content|segment|sentence|passage|translation)\b[^.!?\n]{0,30}\b(?:cannot be|can't be|can not be|declined|refused|not possible|is not available|not supported|not permitted)\b",
    r"\b(?:unable|not able|not possible) to (?=help|assist|translat|comply|provide|fulfil|process)",
    r"(?:我|我们|我們|本人)[^。！？\n]{0,12}(?:无法|無法|不能|不便|拒绝|拒絕|没办法|沒辦法)",
    r"\b(?:kann|können|darf|möchte|werde|muss)\b[^.!?\n]{0,40}\b(?:nicht|ablehnen)\b|\bnicht möglich\b|\blehne\b[^.!?\n]{0,30}\bab\b",
    r"\bno (?:puedo|podemos|me es posible|es posible|estoy autorizad[oa]|soy capaz)\b|\b(?:rechazo|debo rechazar|debo declinar)\b",
    r"\b(?:je|nous) ne (?:peux|peut|pouvons|puis|suis|sommes)\b|\b(?:je refuse|je dois refuser|je décline|impossible de)\b|\bil m'est impossible\b",
    r"\bnon (?:posso|possiamo|riesco|sono in grado|mi è possibile|è possibile)\b|\b(?:impossibile|devo rifiutare|mi rifiuto)\b",
    r"\bnão (?:posso|podemos|consigo|conseguimos|sou capaz|me é possível|é possível|estou autorizad[oa])\b|\b(?:recuso|devo recusar)\b",
    r"\b(?:kan|kunnen|mag|zal)\b[^.!?\n]{0,30}\bniet\b|\bniet mogelijk\b",
    r"\bnie (?:mogę|możemy|jestem w stanie|wolno mi|da się)\b|\bodmawiam\b",
    r"\bне (?:могу|можем|смогу|сможем|в состоянии|имею права|буду)\b|\b(?:невозможно|отказываюсь|вынужден\w* отказать)\b",
    r"\bне (?:можу|можемо|зможу)\b|\b(?:неможливо|відмовляюся)\b",
    r"(?:لا|لن) (?:أستطيع|يمكنني|نستطيع|يمكننا|أقدر|يسعني|أتمكن)|لست قادر|غير قادر|يتعذر علي|أرفض",
    r"ไม่สามารถ|ไม่อาจ|ขอปฏิเสธ",
    r"\b(?:không thể|từ chối)\b",
    r"(?:नहीं कर सक|असमर्थ|नहीं दे सक)",
    r"\b(?:yapamam|edemem|çeviremem|edemiyor\w*|yapamıyor\w*|mümkün değil)\b",
)
# What is declined, by language.
TASKS = (
    r"\b(?:help|assist\w*|translat\w+|compl(?:y|ies|ete)|provide|fulfil\w*|process|render|answer|respond|do (?:that|this|so)|continue|support (?:this|that)|work on|carry out|request)\b",
    r"(?:翻译|翻譯|协助|協助|帮助|幫助|帮忙|幫忙|提供|处理|處理|回答|请求|請求)",
    r"\b(?:übersetz\w*|helfen|hilfe|weiterhelfen|anfrage|bearbeiten|beantworten|unterstützen|erfüllen|bereitstellen)\b",
    r"\b(?:tradu\w+|ayud\w+|asist\w+|proporcionar|cumplir|responder|atender|solicitud|petición)\b",
    r"\b(?:tradu\w+|aider|aide|assister|fournir|répondre|traiter|satisfaire|demande|requête)\b",
    r"\b(?:tradu\w+|aiut\w+|assist\w+|fornir\w*|rispond\w+|soddisf\w+|elabora\w*|richiesta)\b",
    r"\b(?:tradu\w+|ajud\w+|fornecer|atender|responder|processar|pedido|solicitação)\b",
    r"\b(?:vertal\w*|helpen|verzoek|beantwoorden|verwerken)\b",
    r"\b(?:przetłumacz\w*|tłumacz\w*|pomóc|pomoc\w*|prośb\w+|odpowiedzieć|wykonać)\b",
    r"\b(?:перев\w+|помо\w+|выполн\w+|ответ\w+|запрос\w*|просьб\w+|обработ\w+)\b",
    r"\b(?:перекла\w+|допомо\w+|викон\w+|відпові\w+|запит\w*|прохан\w+)\b",
    r"(?:ترجم|مساعد|تلبي|تقديم|الإجابة|طلب|معالجة)",
    r"(?:แปล|ช่วย|ให้บริการ|ตอบ|ดำเนินการ|คำขอ)",
    r"\b(?:dịch|giúp|hỗ trợ|trả lời|yêu cầu|cung cấp)\b",
    r"(?:अनुवाद|मदद|सहायता|अनुरोध|उत्तर)",
    r"\b(?:çevir\w*|yardım\w*|istek\w*|yanıt\w*|talep\w*|talebi\w*)\b",
)
# What only a refusal says, and apologies, which are one unless the prompt apologises as well.
DECLARED = (
    r"\bas an? (?:AI|artificial intelligence|(?:large )?language model)\b", r"\b(?:outside|beyond) (?:of )?(?:what I am allowed|my (?:scope|abilities|capabilities|guidelines))", r"\b(?:translation|request) (?:declined|refused)\b", r"\bagainst (?:my|our) (?:policy|policies|guidelines)\b", r"\bmay violate\b", r"\bI must decline\b", r"\bdecline to (?:translate|help|assist|answer)",
    r"(?:번역|도와|옮길|옮겨|답변|답해|응할|응답|제공|처리|수행)[^.\n]{0,14}(?:수 없|수가 없|어렵|어려운|불가|못합|못 합|않겠)", r"도와드리기 어려", r"(?:요청|번역)[^.\n]{0,10}(?:거절하겠|사양하겠|거부하겠|삼가겠)",
    r"翻訳(?:する|を行う|は|を)?[^。\n]{0,10}(?:できません|できかね|致しかね|いたしかね|控えさせ|不可能)", r"お(?:手伝い|応え|答え|役に立)[^。\n]{0,6}(?:できません|できかね|かねます|られません|てません)", r"対応できません", r"(?:ご要望|リクエスト|ご依頼|ご質問)[^。\n]{0,16}(?:できません|できかね|応じられ|応じかね|お断り)", r"お断り",
    r"정책상", r"적절하지 않다고 판단", r"다른 (?:문장|요청)을 보내", r"양해 부탁", r"언어 모델(?:로서|이라|이므로)",
    r"言語モデルとして", r"作为(?:一个)?(?:人工智能|AI|语言模型)", r"\bals KI(?:-\w+)?\b", r"\bcomo (?:una? )?(?:IA|modelo de (?:lenguaje|linguagem))\b", r"\ben tant qu'(?:IA|intelligence artificielle)\b", r"\bcome (?:IA|modello linguistico)\b", r"\bкак (?:ИИ|языковая модель)\b", r"بصفتي (?:نموذج|ذكاء)",
)
APOLOGIES = (
    r"\bI(?:'m| am) (?:very |so |truly )?sorry\b", r"\b(?:my|our) apologies\b", r"\bI apologi[sz]e\b", r"죄송", r"申し訳", r"\bes tut mir (?:sehr )?leid\b", r"\blo siento\b", r"\bje (?:suis|regrette)\b[^.]{0,12}\b(?:désolée?|navrée?)\b", r"\bje regrette\b",
    r"\bmi dispiace\b", r"\b(?:sinto muito|peço desculpas?|lamento)\b", r"\bhet spijt me\b", r"\bprzykro mi\b", r"\b(?:извините|прошу прощения|приношу извинения|к сожалению, я)\b", r"\bвибачте\b", r"(?:آسف|أعتذر|عذر[اًا]+|للأسف)", r"ขออภัย|ขอโทษ", r"抱歉|对不起|對不起", r"\bxin lỗi\b", r"(?:क्षमा करें|माफ़ करें)", r"\büzgünüm\b",
)
#: Characters between how one declines and what.
NEAR = 60


def _either(patterns: tuple[str, ...]) -> tuple[re.Pattern, re.Pattern]:
    """The patterns of Latin letters, and the others."""
    latin = [p for p in patterns if max(p) < "\u0370" or "\u1e00" <= max(p) <= "\u1eff"]
    return re.compile("|".join(latin), re.IGNORECASE), re.compile("|".join(p for p in patterns if p not in latin), re.IGNORECASE)


_DECLINES, _TASKS, _DECLARED, _APOLOGY = map(_either, (DECLINES, TASKS, DECLARED, APOLOGIES))
_SORRY = re.compile("|".join((*APOLOGIES, r"\bsorry\b", r"\bapolog\w+", r"\bregret")), re.IGNORECASE)
#: Three words of Latin letters in a row: a text without them declines nothing in a language written so.
_ACCENTED = re.compile("[Ḁ-ỿ]")
_LATIN_PROSE = re.compile(r"[^\W\d_]['’]?[^\W\d_]*[ ,:]+[^\W\d_]['’]?[^\W\d_]*[ ,:]+[^\W\d_]")
# Frequent function words by language.
FUNCTION_WORDS = {
    "en": "the a an of to and in is are for with that this it its not on by from when if before after which only every each our you has have been be there more",
    "de": "der die das und ist nicht mit von für auf ein eine einen dem den des zu im wird werden wenn bis bevor weil ohne sie als alle jedes auch noch haben wir durch vom pro fehlt",
    "es": "el la los las de que y en un una no se con por para del al es su como más cuando sin porque cada antes lo si sobre está",
    "fr": "le la les des et en un une est pas ne que pour dans avec sur au du ce cette sans quand chaque avant il elle",
    "it": "il lo la gli le di che e in un una non si con per del della dei è come più quando senza perché ogni prima dopo nel alla dalla",
    "pt": "o a os as de que e em um uma não se com por para do da dos das no na é como mais quando sem porque cada antes ao pelo está",
    "nl": "de het een van en in is niet met voor op dat die te zijn wordt worden als bij door zonder elke ook naar wanneer",
    "pl": "i w nie na z do się jest że to jak po przez dla od oraz gdy bez każdy przed jeśli",
    "tr": "ve bir bu için ile de da değil olarak daha her önce sonra eğer gibi olan kadar",
    "vi": "và của là không trong một được cho với các này khi để từ những nếu mỗi trước",
    "sv": "och att det som en ett är inte med för på av den till om när utan varje innan",
    "ru": "и в не на с что по для это как от из если или к при до без каждый перед когда",
    "uk": "і в не на з що по для це як від із якщо або до при без кожен перед коли та",
    "bg": "и в не на с че по за това как от ако или към при до без всеки преди когато е се",
}
# Scripts by their ranges of letters, and the languages written in each.
SCRIPTS = {
    "hangul": ("가-힣ㄱ-ㆎᄀ-ᇿ", "ko"), "kana": ("ぁ-ヿㇰ-ㇿ", "ja"), "han": ("㐀-䶿一-鿿豈-﫿", "zh ja"), "cyrillic": ("Ѐ-ԯ", "ru uk bg sr mk be kk ky mn"), "greek": ("Ͱ-Ͽἀ-῿", "el"), "arabic": ("\u0600-\u06ff\u0750-\u077f\u08a0-\u08ff\ufb50-\ufdff\ufe70-\ufeff", "ar fa ur ps"),
    "hebrew": ("\u0590-\u05ff", "he yi"), "thai": ("\u0e00-\u0e7f", "th"), "devanagari": ("\u0900-\u097f", "hi mr ne"), "bengali": ("\u0980-\u09ff", "bn"), "tamil": ("\u0b80-\u0bff", "ta"), "georgian": ("\u10a0-\u10ff", "ka"), "armenian": ("\u0530-\u058f", "hy"), "khmer": ("\u1780-\u17ff", "km"), "lao": ("\u0e80-\u0eff", "lo"),
}
_SCRIPTS = {k: re.compile(f"[{r}]") for k, (r, _) in SCRIPTS.items()}
_LATIN, _OTHER = re.compile("[A-Za-zªºÀ-ÖØ-öø-ɏḀ-ỿ]"), re.compile("[^\x00-ɏḀ-ỿ\u2000-\u206f\u3000-\u303f]+")
_BY_SCRIPT = {k: v.split() for k, (_, v) in SCRIPTS.items()}
_SCRIPT_OF = {lang: k for k, langs in reversed(_BY_SCRIPT.items()) for lang in langs} | {"ja": "kana", "zh": "han"}
_SETS = {k: frozenset(v.split()) for k, v in FUNCTION_WORDS.items()}
_QUOTED = re.compile(r"`[^`\n]*`|\"[^\"\n]*\"|“[^”\n]*”|‘[^’\n]*’|「[^」\n]*」|『[^』\n]*』|«[^»\n]*»")
_TAG = re.compile(r"</?[A-Za-z][^<>]*>|<!--.*?-->", re.DOTALL)
_WORD = re.compile(r"[^\W\d_]+")
_CODE = re.compile(r"`[^`\n]*`|https?://\S+|\S*[/_\\@]\S*|--?\w[\w-]*|\S+\(\)|\b\w*\d[\w.]*\b|\b[a-z]+[A-Z]\w*|\b[A-Z][a-z]+[A-Z]\w*")


@functools.cache
def _unseen() -> re.Pattern:
    """Format and control characters, but for line ends and tabs."""
    return re.compile("[" + "".join(re.escape(chr(c)) for c in range(0x110000) if chr(c) not in "\n\t" and unicodedata.category(chr(c)) in ("Cf", "Cc")) + "]")


@functools.lru_cache(8192)
def plain(text: str) -> str:
    """The text without tags, entities, invisible characters and character variants."""
    if "&" in text:
        text = html.unescape(text)
    if "<" in text:
        text = _TAG.sub(" ", text)
    if not text.isascii():
        text = unicodedata.normalize("NFKC", text)
    return text if text.replace("\n", "").replace("\t", "").isprintable() else _unseen().sub("", text)


def nothing(text: str | None) -> bool:
    """Nothing to read: no letter and no digit is left."""
    return not text or not any(c.isalnum() for c in plain(text))


@functools.lru_cache(8192)
def letters(text: str) -> str:
    return " ".join(re.findall(r"\w+", plain(text).casefold()))


def untranslatable(source: str) -> bool:
    """Nothing but code, names or addresses: no ordinary word is left; or a name with a version, or a command line."""
    bare = plain(source).strip()
    rest = _WORD.findall(_CODE.sub(" ", bare))
    if not rest:
        return True
    return len(rest) == 1 and bool(re.fullmatch(r"[\w.-]+ v?\d[\w.]*|[a-z][\w.-]* (?:--?\w[\w-]*(?:[ =]\S+)? ?)+|[a-z]\w*", bare))


def copied(source: str, response: str) -> bool:
    """The response repeats the prompt, exactly or nearly."""
    import zstandard

    a, b = letters(source), letters(response)
    if not a or not b:
        return False
    if a == b:
        return True
    # a prefix of a few words is shared by chance where names stay untranslated
    if len(b) < COPY_COVER * len(a) or len(b) < 12:
        return False
    if a.isascii() and len(b.encode("ascii", "ignore")) < COPY_PIECES * len(b):
        return False
    ours = {a[i : i + GRAM] for i in range(len(a) - GRAM + 1)}
    pieces = {b[i : i + GRAM] for i in range(len(b) - GRAM + 1)}
    if len(pieces & ours) < COPY_PIECES * len(pieces):
        return False
    raw = b.encode()
    alone = len(zstandard.ZstdCompressor(level=3, write_content_size=False, write_checksum=False).compress(raw))
    given = zstandard.ZstdCompressionDict(a.encode(), dict_type=zstandard.DICT_TYPE_RAWCONTENT)
    both = len(zstandard.ZstdCompressor(level=19, dict_data=given, write_content_size=False, write_checksum=False).compress(raw))
    return both <= COPY_SHARE * min(alone, len(raw)) and (len(b) >= 60 or both <= 20)


def script_counts(text: str) -> dict[str, int]:
    """Letters of each script that occurs; Latin ones are counted as latin."""
    found = {"latin": len(_LATIN.findall(text))}
    rest = "" if text.isascii() else "".join(_OTHER.findall(text))
    for k, p in _SCRIPTS.items():
        if not rest:
            break
        without = p.sub("", rest)
        if len(without) < len(rest):
            found[k] = len(rest) - len(without)
        rest = without
    return found


def _hits(text: str) -> dict[str, int]:
    """Function words of each language."""
    words = [w.casefold() for w in _WORD.findall(_CODE.sub(" ", text))]
    return {k: sum(w in v for w in words) for k, v in _SETS.items()}


def language(text: str, want: str = "") -> str | None:
    """The language of a text without its code and quotes: by script, and by function words where languages share one; None if nothing tells.

    Where a script has several languages and function words don't tell them apart, it is `want` if that is one of them.
    """
    bare = _QUOTED.sub(" ", text)
    counts = script_counts(bare)
    latin = counts.pop("latin", 0)
    other = sum(counts.values())
    # function words tell only where Latin letters prevail, or languages share the script
    hits = _hits(bare) if latin > 2 * other or "cyrillic" in counts else {}
    in_latin = {k: n for k, n in hits.items() if k not in _SCRIPT_OF}
    best = max(in_latin, key=lambda k: (in_latin[k], k == want), default=None)
    if other:
        # some words of another script stay in a translation; its function words don't
        if best and in_latin[best] >= 2 and latin > 2 * other:
            return best
        if counts.get("kana"):
            counts["kana"] += counts.pop("han", 0)
        script = max(counts, key=counts.get)
        langs = _BY_SCRIPT[script]
        known = {k: hits[k] for k in langs if k in hits}
        first = max(known, key=lambda k: (known[k], k == want), default=None)
        if first and known[first] >= 2 and known[first] > known.get(want, -1):
            return first if want not in langs or want in known else want
        return want if want in langs and script != "han" else langs[0]
    return best if best and in_latin[best] >= 2 and in_latin[best] > in_latin.get(want, 0) or best == want and in_latin.get(want, 0) >= 2 else None


def refused(response: str, source: str = "") -> bool:
    """A refusal outside quotes and code: it says so, it declines a task, or it apologises though the prompt does not."""
    bare = _QUOTED.sub(" ", response)
    kinds = [0] if bare.isascii() else [0, 1]
    if len(kinds) == 2 and not _LATIN_PROSE.search(bare.encode("latin-1", "replace").decode("latin-1").replace("?", "")) and not _ACCENTED.search(bare):
        kinds = [1]
    for k in kinds:
        if _DECLARED[k].search(bare) or any(_TASKS[k].search(bare, max(0, m.start() - NEAR), m.end() + NEAR) for m in _DECLINES[k].finditer(bare)):
            return True
        if _APOLOGY[k].search(bare) and not _SORRY.search(source):
            return True
    return False


def _base(tag: str | None) -> str:
    return (tag or "").strip().casefold().replace("_", "-").split("-")[0]


def defect_of(source: str | None, response: str | None, target: str | None, margin: float) -> str | None:
    """The defect of one pair, or None. A null prompt is empty; an unknown or null target makes no response wrong."""
    if nothing(response):
        return "empty"
    source = source or ""
    if letters(source) == letters(response) and untranslatable(source):
        return None
    want = _base(target)
    if refused(response, source) and not refused(source):
        return "refusal"
    if copied(source, response):
        return "copy"
    found = language(response, want)
    if found and want and found != want:
        return "wrong_language"
    if found is None and _SCRIPT_OF.get(want) and source:
        # Latin letters only: the begin of a sentence that starts with a name of the prompt, or a foreign text
        ours, theirs = letters(response).split(), set(letters(source).split())
        if ours and not set(ours) <= theirs and script_counts(response)["latin"] > 20:
            return "wrong_language"
        if ours and set(ours) <= theirs and not untranslatable(source):
            return "truncated"
    return "truncated" if margin > 0 else None


def _sound(source: str | None, response: str | None, target: str | None) -> bool:
    return source is not None and response is not None and defect_of(source, response, target, -1.0) is None


_WHOLE = 1 << 32


def _stratum() -> list[Column]:
    """The target's language, and whether the source is a heading."""
    base = F.split(F.translate(F.lower(F.trim(F.coalesce("target", F.lit("")))), "_", "-"), "-")[0]
    return [base.alias("t"), F.coalesce(F.col("source").rlike(r"(?s)[\p{L}\p{N}]\s*$"), F.lit(False)).alias("s")]


def census(pairs: DataFrame) -> tuple[frozenset[int], dict[tuple[str, bool], int]]:
    """The common limits, from the lengths of the distinct open-ended responses of all pairs, and the size of each stratum, in one pass.

    Responses are told apart by hash and rows reduced map-side; what reaches the driver are counts by length.
    """
    ended = open_ended(F.col("response"))
    rows = pairs.filter(F.col("source").isNotNull() & F.col("response").isNotNull()).select(*_stratum(), F.when(ended, F.length("response")).alias("n"), F.when(ended, F.xxhash64("response")).alias("h"))
    counted = rows.groupBy("t", "s", "n", "h").agg(F.count("*").alias("c")).groupBy("t", "s", "n").agg(F.sum("c").alias("c"), F.count("h").alias("texts")).collect()
    lengths: Counter = Counter()
    sizes: Counter = Counter()
    for r in counted:
        sizes[r["t"], r["s"]] += r["c"]
        if r["n"] is not None:
            lengths[r["n"]] += r["texts"]
    return common_limits(lengths), dict(sizes)


def sample(pairs: DataFrame, sizes: dict[tuple[str, bool], int], bound: int = SAMPLE, total: int = TOTAL) -> list[tuple[str, str, str]]:
    """About `bound` pairs of every target language, headings and others apart, and about `total` in all, in one pass: those whose hashed id lies below the share that gives so many."""
    if not sizes:
        return []
    each = min(bound, max(1, total // len(sizes)))
    hashed = F.pmod(F.xxhash64("pair"), F.lit(_WHOLE))
    # strata of one size have one threshold: the plan grows with the sizes above the bound, not with the languages
    large = {k: n for k, n in sizes.items() if n > each}
    threshold = F.lit(_WHOLE)
    for (t, s), n in large.items():
        threshold = F.when((F.col("t") == t) & (F.col("s") == s), F.lit(int(_WHOLE * each / n))).otherwise(threshold)
    rows = pairs.filter(F.col("source").isNotNull() & F.col("response").isNotNull()).select("source", "response", "target", *_stratum(), hashed.alias("_h")).filter(F.col("_h") < threshold)
    found = rows.select("source", "response", "target", "_h").toPandas().sort_values(["_h", "response"], kind="stable")
    return list(zip(found["source"], found["response"], found["target"]))


def flag_pairs(pairs: DataFrame, key: str, source: str, response: str, target: str, bound: int = SAMPLE) -> DataFrame:
    """(key, defect) of every pair; defect is null for a sound one.

    Null, empty, blank and mark-only responses are empty. Very long texts are read whole. Repeated rows give
    repeated rows; an empty table gives none. Other columns are dropped, so theirs can't clash.
    """
    named = pairs.select(F.col(key).alias("pair"), F.col(source).cast("string").alias("source"), F.col(response).cast("string").alias("response"), F.col(target).cast("string").alias("target"))
    limits, sizes = census(named)
    model = fit([(s, t) for s, t, lang in sample(named, sizes, bound) if _sound(s, t, lang)], cuts=3, limits=limits)
    shared = pairs.sparkSession.sparkContext.broadcast(model)
    kind = pairs.schema[key].dataType.simpleString()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        terminal: TerminalModel = shared.value
        for whole in batches:
            for at in range(0, max(1, whole.num_rows), 2048):
                batch = whole.slice(at, 2048)
                sources, responses, targets = (batch.column(i).to_pylist() for i in (1, 2, 3))
                margins = terminal.margin([(s or "", r or "") for s, r in zip(sources, responses)])
                found = [defect_of(s, r, t, m) for s, r, t, m in zip(sources, responses, targets, margins.tolist())]
                yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(found, pa.string())], names=[key, "defect"])

    return named.mapInArrow(run, f"`{key}` {kind}, defect string")
