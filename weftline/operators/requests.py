"""Requests to a text provider: prompts, replies, retries of what failed, pacing. Providers are plain objects; a deterministic one is here for tests."""

from __future__ import annotations

import re
from collections.abc import Callable, Iterator
from dataclasses import dataclass, field
from typing import Protocol

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

_ENTRY = re.compile(r"\[(\d+)\](.*)")


def build_prompt(segments: list[tuple[int, str]], source_lang: str, target_lang: str, context: str = "", glossary: dict[str, str] | None = None, feedback: str | None = None, template: str | None = None) -> str:
    """The template with its fields filled in, or the built-in sections; empty sections are left out."""
    body = "\n".join(f"[{i}] {t}" for i, t in segments)
    terms = "\n".join(f"{a} = {b}" for a, b in sorted((glossary or {}).items()))
    if template is not None:
        fields = {"segments": body, "source_lang": source_lang, "target_lang": target_lang, "context": context, "glossary": terms, "feedback": feedback or ""}
        return re.sub(r"\{(\w+)\}", lambda m: fields.get(m[1], m[0]), template)
    parts = [f"Render each numbered text from {source_lang} in {target_lang}. Answer with the same numbers."]
    parts += [f"{name}:\n{value}" for name, value in (("Terms", terms), ("Context", context), ("Mind this", feedback), ("Texts", body)) if value]
    return "\n\n".join(parts)


def parse_reply(reply: str, segments: list[int] | None = None) -> dict[int, str]:
    """Texts by number: lines after an entry continue it, a blank line closes it, an entry without text holds none, other lines are dropped.

    A bare answer counts if exactly one segment was asked for. A reply without any text is an error.
    """
    found: dict[int, str] = {}
    open_: int | None = None
    for line in reply.splitlines():
        line = line.strip()
        if not line:
            open_ = None
        elif m := _ENTRY.match(line):
            text, number = m[2].strip(), int(m[1])
            open_ = number if text else None
            if text:
                found[number] = text
        elif open_ is not None:
            found[open_] += " " + line
    if not found and segments and len(segments) == 1 and reply.strip():
        return {segments[0]: reply.strip()}
    if not found:
        raise ValueError("the reply holds no numbered text")
    return found


class Provider(Protocol):
    def complete(self, prompt: str) -> str: ...


@dataclass
class EchoProvider:
    """Answers each text with a fixed change; texts that hold `fails` are left out the first `times` times."""

    change: Callable[[str], str] = str.upper
    fails: str = "\0"
    times: int = 0
    seen: dict[str, int] = field(default_factory=dict)

    def complete(self, prompt: str) -> str:
        out = []
        for m in re.finditer(r"^\[(\d+)\] (.*)$", prompt, re.MULTILINE):
            self.seen[m[2]] = self.seen.get(m[2], 0) + 1
            if self.fails not in m[2] or self.seen[m[2]] > self.times:
                out.append(f"[{m[1]}] {self.change(m[2])}")
        return "\n".join(out)


class RateLimiter:
    """The pause between calls: doubled after a refusal for load up to 64 times, shortened by a tenth after a success and by a fifth while much quota is left; never under the floor."""

    def __init__(self, floor: float = 0.1) -> None:
        self.floor, self.factor = floor, 1.0

    @property
    def pause(self) -> float:
        return self.floor * self.factor

    def refused(self) -> None:
        self.factor = min(64.0, self.factor * 2)

    def succeeded(self, remaining: int | None = None) -> None:
        self.factor = max(1.0, self.factor * (0.8 if remaining is not None and remaining > 100 else 0.9))


def render_batch(provider: Provider, texts: dict[int, str], check: Callable[[str, str], list[str]], source_lang: str, target_lang: str, retries: int = 3) -> dict[int, tuple[str | None, int, list[str]]]:
    """(text, attempts, issues) of each number: a reply that misses numbers is asked for again as a whole, one that fails the check only for the failing ones, with the issues as feedback. What still fails after the last attempt is kept with its issues."""
    done: dict[int, tuple[str | None, int, list[str]]] = {}
    open_, feedback = dict(texts), None
    for attempt in range(1, retries + 2):
        try:
            reply = parse_reply(provider.complete(build_prompt(sorted(open_.items()), source_lang, target_lang, feedback=feedback)), sorted(open_))
        except ValueError as e:
            reply, feedback = {}, str(e)
        if set(open_) - set(reply):
            for n in open_:
                done[n] = (reply.get(n), attempt, ["missing"] if n not in reply else [])
            feedback = "Numbers were missing."
            continue
        failing = {}
        for n, source in open_.items():
            issues = check(source, reply[n])
            done[n] = (reply[n], attempt, issues)
            if issues:
                failing[n] = source
        if not failing:
            break
        open_, feedback = failing, "; ".join(sorted({i for n in failing for i in done[n][2]}))
    return done


def render(batches: DataFrame, make: Callable[[], Provider], check: Callable[[str, str], list[str]], source_lang: str = "en", target_lang: str = "ko", retries: int = 3) -> DataFrame:
    """(batch, pos, translation, attempts, issues) from (batch, texts: map<int,string>). One provider a task; the number of partitions bounds the concurrency. Null or empty maps give no rows."""
    kind = batches.schema["batch"].dataType.simpleString()

    def run(parts: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        provider = make()
        for part in parts:
            out = []
            for name, texts in zip(part["batch"], part["texts"]):
                wanted = {int(k): v for k, v in (dict(texts) if texts is not None else {}).items() if v is not None}
                for n, (text, attempts, issues) in sorted(render_batch(provider, wanted, check, source_lang, target_lang, retries).items() if wanted else []):
                    out.append((name, n, text, attempts, issues))
            yield pd.DataFrame(out, columns=["batch", "pos", "translation", "attempts", "issues"])

    return batches.select(F.col("batch"), F.col("texts")).mapInPandas(run, f"batch {kind}, pos int, translation string, attempts int, issues array<string>")
