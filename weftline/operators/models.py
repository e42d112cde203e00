"""Exchanges with a model: term screening and decisions, fusion of drafts, style, blind judging, evaluation runs. A provider is an object with complete(prompt); prompts and replies are plain text."""

from __future__ import annotations

import json
import re
from collections.abc import Callable, Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from weftline.functions.text import content_hash, rotate_drafts, snippet
from weftline.operators.requests import EchoProvider, Provider, build_prompt, parse_reply

# The company behind each type of provider.
COMPANIES = {"claude_code": "anthropic", "claude-code": "anthropic", "anthropic": "anthropic", "codex": "openai", "openai": "openai", "openai_compatible": "openai", "gemini": "google"}
#: Terms of one screening request, and characters of a rendering.
SCREENED, LONGEST = 250, 80


def company(kind: Column) -> Column:
    """The company of a provider type, other for those not known."""
    known = F.create_map(*(F.lit(x) for kv in COMPANIES.items() for x in kv))
    return F.coalesce(F.try_element_at(known, kind), F.lit("other"))


# --- terms


def screen_prompt(terms: list[tuple[str, int]], source_lang: str = "en", target_lang: str = "ko") -> str:
    listed = "\n".join(f"{k}. {t} ({n})" for k, (t, n) in enumerate(terms, 1))
    return f"Which of these recurring words of {source_lang} are terms that need one fixed rendering in {target_lang}? Answer with their numbers and commas, or none.\n\n{listed}"


def parse_screen(reply: str, count: int) -> set[int]:
    """The numbers picked; numbers out of range are dropped, anything that is no number is an error, and none picks nothing."""
    bare = reply.strip()
    if bare.rstrip(".").lower() == "none":
        return set()
    picked = set()
    for token in re.split(r"[,\s]+", bare):
        if token:
            if not token.rstrip(".").isdigit():
                raise ValueError(f"{token!r} is no number")
            picked.add(int(token.rstrip(".")))
    return {n for n in picked if 1 <= n <= count}


def screen_terms(terms: DataFrame, make: Callable[[], Provider], size: int = SCREENED) -> DataFrame:
    """(term, picked): which terms (term, n) a model picks, asked in batches of `size` in the order of their names. A batch whose reply is malformed gives null, so that it is asked again."""
    from weftline.operators.state import numbered

    named = terms.filter("term is not null").select("term", F.col("n").cast("bigint").alias("n"), F.lit("").alias("_all"))
    batched = numbered(named, "_all", ["term"], "_i").withColumn("batch", F.floor(F.col("_i") / F.lit(size)).cast("bigint"))
    lists = batched.groupBy("batch").agg(F.sort_array(F.collect_list(F.struct("_i", "term", "n"))).alias("terms"))

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        provider = make()
        for batch in batches:
            out = []
            for entries in batch["terms"]:
                asked = [(e["term"], int(e["n"])) for e in entries]
                try:
                    picked = parse_screen(provider.complete(screen_prompt(asked)), len(asked))
                    out += [(t, k in picked) for k, (t, _) in enumerate(asked, 1)]
                except ValueError:
                    out += [(t, None) for t, _ in asked]
            yield pd.DataFrame({"term": [t for t, _ in out], "picked": pd.Series([p for _, p in out], dtype=object)})

    return lists.select("terms").mapInPandas(run, "term string, picked boolean")


def decide_prompt(terms: list[str], fixed: list[list[tuple[str, str]]], target_lang: str = "ko", examples: dict[str, str] | None = None) -> str:
    """Numbered terms with the fixed renderings of their parts; under each an excerpt of a text that uses it, if there is one."""
    lines = [f"[{k}] {t}" + (" (" + ", ".join(f"{a} = {b}" for a, b in parts) + ")" if parts else "") + (f"\n    {snippet(examples[t], t, 80)}" if t in (examples or {}) else "") for k, (t, parts) in enumerate(zip(terms, fixed), 1)]
    return f"Give one rendering in {target_lang} of each numbered term, or - where it should not be fixed.\n\n" + "\n".join(lines)


def parse_decisions(reply: str, count: int) -> dict[int, str | None]:
    """Renderings by number, None for a rejected term; entries that are empty, long, bracketed or alternatives are left out, so that they are asked again."""
    found: dict[int, str | None] = {}
    for number, text in parse_reply(reply).items():
        bare = text.strip().strip('"“”').strip()
        if not 1 <= number <= count:
            continue
        if bare in ("-", "—", "–"):
            found[number] = None
        elif bare and len(bare) <= LONGEST and not re.search(r"[\[\]()/→\n]| or ", bare):
            found[number] = bare.rstrip(":：").strip()
    return found


def waves(terms: list[str]) -> tuple[list[str], list[str]]:
    """Terms to decide first, single words, and those after, which hold others and get their renderings as fixed parts."""
    return [t for t in terms if " " not in t], [t for t in terms if " " in t]


def decide_terms(provider: Provider, terms: list[str]) -> dict[str, str | None]:
    """Decisions of a glossary's worth of terms in two waves; undecided ones are left out."""
    decided: dict[str, str | None] = {}
    for wave in waves(sorted(set(terms))):
        for at in range(0, len(wave), SCREENED):
            part = wave[at : at + SCREENED]
            fixed = [[(w, decided[w]) for w in t.split() if decided.get(w)] for t in part]
            try:
                reply = parse_decisions(provider.complete(decide_prompt(part, fixed)), len(part))
            except ValueError:
                continue
            decided |= {part[k - 1]: v for k, v in reply.items()}
    return decided


# --- drafts and style


def fuse_prompt(segments: list[tuple[int, str]], drafts: list[dict[int, str]], key: str, source_lang: str = "en", target_lang: str = "ko") -> str:
    """A request with anonymous drafts in an order that a hash of key sets."""
    parts = [build_prompt(segments, source_lang, target_lang), "Write each text anew with the drafts in view; keep the numbers."]
    for n, draft in enumerate(rotate_drafts(drafts, key), 1):
        parts.append(f"Draft {n}:\n" + "\n".join(f"[{i}] {draft[i]}" for i, _ in segments if i in draft))
    return "\n\n".join(parts)


def parse_style(reply: str) -> tuple[bool, str | None, str | None]:
    """(passed, severity, message) of a style judge's reply: GOOD, ACCEPTABLE with a warning, anything else an error; the second line tells why."""
    lines = [line.strip() for line in reply.splitlines()]
    first, why = (lines[0].upper() if lines else ""), (lines[1] if len(lines) > 1 else "")
    if first.startswith("GOOD"):
        return True, None, None
    if first.startswith("ACCEPTABLE"):
        return True, "warning", why or "acceptable, could be better"
    return False, "error", why or "the style is poor"


def style_issues(provider: Provider, source: str, text: str, target_lang: str = "ko") -> list[tuple[str, str]]:
    """(severity, message) of a model's opinion on the style; a warning never makes a text fail."""
    reply = provider.complete(f"Is this natural {target_lang}? Answer GOOD, ACCEPTABLE or POOR, and why on a second line.\n\nSource:\n{source}\n\nText:\n{text}")
    _, severity, message = parse_style(reply)
    return [(severity, message or "")] if severity else []


# --- judging


def judging_plan(picks: DataFrame, judges: DataFrame, done: DataFrame, own: DataFrame | None = None) -> DataFrame:
    """(pick_id, baseline, candidate, judge, judge_model, shown_order) still to be judged: every pick by every judge in both orders but what is done without error, and none by a judge of the candidate's own company.

    judges: judge, judge_model and company, a checked few. own: candidate, company.
    """
    few = judges.select("judge", "judge_model", *(["company"] if own is not None else [])).distinct().limit(1001).collect()
    if len(few) > 1000:
        raise ValueError("more than 1000 judges")
    panel = F.array(*(F.struct(*(F.lit(r[c]).alias(c) for c in r.asDict())) for r in few)) if few else F.array().cast("array<struct<judge:string,judge_model:string,company:string>>")
    wanted = picks.select("pick_id", "baseline", "candidate").distinct().withColumn("j", F.explode(panel)).withColumn("shown_order", F.explode(F.array(F.lit("AB"), F.lit("BA")))).select("pick_id", "baseline", "candidate", "j.*", "shown_order")
    if own is not None:
        made = own.select(F.col("candidate").alias("_c"), F.col("company").alias("_o"))
        wanted = wanted.join(made, (F.col("candidate") == F.col("_c")) & (F.col("company") == F.col("_o")) & (F.col("company") != "other"), "left_anti").drop("company")
    finished = done.filter("error is null").select("pick_id", "baseline", "candidate", "judge", "judge_model", "shown_order").distinct()
    return wanted.join(finished, ["pick_id", "baseline", "candidate", "judge", "judge_model", "shown_order"], "left_anti")


def judge_prompt(source: str, a: str, b: str) -> str:
    return f"Which text renders the source better? Answer in JSON with accuracy, fluency, translationese and overall, each A, B or tie, and a reason.\n\nSource:\n{source}\n\nA:\n{a}\n\nB:\n{b}"


def parse_verdict(reply: str, baseline_first: bool) -> dict[str, str]:
    """Each criterion as baseline, candidate or tie, from the JSON object in a reply; a reply without one is an error."""
    m = re.search(r"\{.*\}", reply, re.DOTALL)
    if not m:
        raise ValueError("the reply holds no verdict")
    answers = json.loads(m[0])
    side = lambda v: {("A", True): "baseline", ("B", False): "baseline", ("A", False): "candidate", ("B", True): "candidate"}.get((str(v).strip().upper(), baseline_first), "tie")
    return {k: side(answers.get(k)) for k in ("accuracy", "fluency", "translationese", "overall")}


def judge(plan: DataFrame, make: Callable[[], Provider], attempts: int = 3) -> DataFrame:
    """The plan's rows (with source, baseline_text and candidate_text) judged: plan's keys, verdicts, error and attempts. A reply that can't be read is asked for again, up to `attempts` times; then the row holds the error."""
    keys = ["pick_id", "baseline", "candidate", "judge", "judge_model", "shown_order"]
    kinds = ", ".join(f"{k} {plan.schema[k].dataType.simpleString()}" for k in keys)

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        provider = make()
        for batch in batches:
            out = []
            for r in batch.to_dict("records"):
                first, texts = r["shown_order"] == "AB", (r["baseline_text"] or "", r["candidate_text"] or "")
                verdict, error, used = None, None, 0
                while verdict is None and used < attempts:
                    used += 1
                    try:
                        verdict, error = parse_verdict(provider.complete(judge_prompt(r["source"] or "", *(texts if first else texts[::-1]))), first), None
                    except (ValueError, OSError) as e:
                        error = str(e)
                out.append((*(r[k] for k in keys), verdict, error, used))
            yield pd.DataFrame(out, columns=[*keys, "verdicts", "error", "attempts"])

    return plan.select(*keys, "source", "baseline_text", "candidate_text").mapInPandas(run, f"{kinds}, verdicts struct<accuracy:string,fluency:string,translationese:string,overall:string>, error string, attempts int")


class HashJudge:
    """A deterministic judge: the longer text wins, equal lengths are decided by a hash; the first answer to a text that holds `fails` can't be read."""

    def __init__(self, fails: str = "\0") -> None:
        self.fails, self.seen = fails, set()

    def complete(self, prompt: str) -> str:
        if self.fails in prompt and prompt not in self.seen:
            self.seen.add(prompt)
            return "I can't say."
        a, _, b = prompt.partition("\n\nA:\n")[2].partition("\n\nB:\n")
        answer = "A" if len(a) > len(b) else "B" if len(b) > len(a) else "AB"[content_hash(a + b) % 2] if a != b else "tie"
        return json.dumps(dict.fromkeys(("accuracy", "fluency", "translationese", "overall"), answer) | {"reason": ""})


class ScreeningProvider:
    """A deterministic screener: picks the terms that occur at least `least` times, and renders a term as its capitals."""

    def __init__(self, least: int = 1) -> None:
        self.least = least

    def complete(self, prompt: str) -> str:
        if re.search(r"^\[\d+\]", prompt, re.MULTILINE):
            return "\n".join(f"[{m[1]}] {m[2].upper()}" for m in re.finditer(r"^\[(\d+)\] ([^\n(]*?)(?: \([^\n]*\))?$", prompt, re.MULTILINE))
        return ", ".join(m[1] for m in re.finditer(r"^(\d+)\. .* \((\d+)\)$", prompt, re.MULTILINE) if int(m[2]) >= self.least) or "none"


# --- evaluation runs


def run_items(items: DataFrame, done: DataFrame, candidate: str, make: Callable[[], Provider], tries: int = 3, repeat_no: int = 0) -> DataFrame:
    """(item, candidate, repeat_no, calls, finals, error) of the items that `done` (item, candidate, repeat_no) lacks: each is one request; a call that fails is tried again, every call is recorded, and what fails to the last holds the error."""
    left = items.join(done.filter((F.col("candidate") == candidate) & (F.col("repeat_no") == repeat_no)).select("item").distinct(), "item", "left_anti")
    texts = F.map_from_entries(F.array_distinct(F.flatten(F.transform("blocks", lambda b: F.transform(b["segments"], lambda s: F.struct(s["index"], s["source"]))))))
    kind = items.schema["item"].dataType.simpleString()

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        provider = make()
        for batch in batches:
            out = []
            for name, asked in zip(batch["item"], batch["texts"]):
                segments = sorted((int(k), v) for k, v in dict(asked).items() if v is not None)
                calls, finals, error = [], {}, None
                for _ in range(tries):
                    try:
                        finals = parse_reply(provider.complete(build_prompt(segments, "en", "ko")), [k for k, _ in segments])
                        calls.append((len(segments), None))
                        error = None
                        break
                    except (ValueError, OSError) as e:
                        error = str(e)
                        calls.append((len(segments), error))
                out.append((name, calls, finals, error))
            yield pd.DataFrame(out, columns=["item", "calls", "finals", "error"])

    rows = left.select("item", texts.alias("texts")).mapInPandas(run, f"item {kind}, calls array<struct<requested:int,error:string>>, finals map<int,string>, error string")
    return rows.select("item", F.lit(candidate).alias("candidate"), F.lit(repeat_no).alias("repeat_no"), "calls", "finals", "error")


# --- making providers

PROVIDERS: dict[str, Callable[..., Provider]] = {"echo": EchoProvider, "hash": HashJudge, "screening": ScreeningProvider}


def make_provider(kind: str, **settings) -> Provider:
    """The provider of a type, with its settings; types of a network are registered in PROVIDERS by those who have them. An unknown type is an error."""
    if kind not in PROVIDERS:
        raise ValueError(f"no provider of type {kind}")
    return PROVIDERS[kind](**settings)
