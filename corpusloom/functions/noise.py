"""Seeded text functions that have no expression: writing errors, prompt variants, entities and shared runs."""

from __future__ import annotations

import hashlib
import re

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType, IntegerType, StringType


def _draw(*parts: object) -> float:
    """A number from 0 to 1 that depends on its arguments only."""
    return int.from_bytes(hashlib.sha256(":".join(map(str, parts)).encode()).digest()[:6], "big") / (1 << 48)


def misspell(text: str, seed: str, share: float = 0.05) -> str:
    """Two inner letters swapped in some words of five or more."""
    def swap(m: re.Match) -> str:
        w = m.group()
        if _draw(seed, m.start()) >= share:
            return w
        i = 1 + int(_draw(seed, m.start(), "i") * (len(w) - 3))
        return w[:i] + w[i + 1] + w[i] + w[i + 2 :]

    return re.sub(r"[A-Za-z]{5,}", swap, text)


def run_on(text: str, seed: str, share: float = 0.2) -> str:
    """Some sentence ends become commas."""
    return re.sub(r"[.!?]\s+([A-Z])", lambda m: f", {m[1].lower()}" if _draw(seed, "r", m.start()) < share else m.group(), text)


def fragment(text: str, seed: str, share: float = 0.2) -> str:
    """Some sentences keep their second half only."""
    parts = re.split(r"(?<=[.!?])\s+", text)
    cut = [" ".join(p.split()[len(p.split()) // 2 :]) if len(p.split()) > 6 and _draw(seed, "f", i) < share else p for i, p in enumerate(parts)]
    return " ".join(cut)


def fit_length(text: str, low: int, high: int) -> str:
    """Whole sentences dropped from the end while too long; repeated from the start while too short."""
    parts = [p for p in re.split(r"(?<=[.!?])\s+", text.strip()) if p]
    size = sum(len(p.split()) for p in parts)
    while len(parts) > 1 and size > high:
        size -= len(parts.pop().split())
    i, n = 0, len(parts)
    while n and 0 < size < low:
        parts.append(parts[i % n])
        size += len(parts[-1].split())
        i += 1
    return " ".join(parts)


def longest_shared_run(a: str, b: str) -> int:
    """Words of the longest contiguous span that two normalized texts share: by length, halved each time."""
    x, y = a.split(), b.split()

    def shared(n: int) -> bool:
        have = {tuple(y[i : i + n]) for i in range(len(y) - n + 1)}
        return any(tuple(x[i : i + n]) in have for i in range(len(x) - n + 1))

    low, high = 0, min(len(x), len(y))
    while low < high:
        mid = (low + high + 1) // 2
        low, high = (mid, high) if shared(mid) else (low, mid - 1)
    return low


def entities(text: str) -> list[str]:
    """Runs of capitalised words that do not merely open a sentence, each once."""
    spans = re.finditer(r"(?<![.!?]\s)(?<!^)\b([A-Z][A-Za-z'-]+(?:\s+(?:of|the|and)?\s*[A-Z][A-Za-z'-]+)*)", text)
    return list(dict.fromkeys(m[1] for m in spans if len(m[1]) > 3))


def prompt_variant(text: str, variant: int) -> str:
    """A prompt with another opening verb; years and the rest stay."""
    verbs = ("Evaluate the extent to which", "Assess how far", "Explain the degree to which")
    return re.sub(r"(?i)^\s*(?:evaluate the extent to which|assess how far|explain the degree to which)\b", verbs[variant % len(verbs)], text)


@F.pandas_udf(StringType())
def with_errors(text: pd.Series, seed: pd.Series) -> pd.Series:
    return pd.Series([None if t is None else misspell(run_on(t, str(s)), str(s)) for t, s in zip(text, seed, strict=True)])


@F.pandas_udf(IntegerType())
def shared_run(a: pd.Series, b: pd.Series) -> pd.Series:
    return pd.Series([longest_shared_run(x or "", y or "") for x, y in zip(a, b, strict=True)])


def sentences_with_shared_span(a: str, b: str, k: int = 8) -> int:
    """Sentences of a text that share a span of ``k`` normalized words with another text."""
    form = lambda t: re.sub(r"\s+", " ", re.sub(r"[^a-z0-9\s]", " ", t.lower())).strip().split(" ")
    y = form(b)
    have = {tuple(y[i : i + k]) for i in range(len(y) - k + 1)}
    parts = [form(s) for s in re.split(r"(?<=[.!?])\s+|\n+", a.strip())]
    return sum(any(tuple(x[i : i + k]) in have for i in range(len(x) - k + 1)) for x in parts)


@F.pandas_udf(IntegerType())
def shared_sentences(a: pd.Series, b: pd.Series) -> pd.Series:
    return pd.Series([sentences_with_shared_span(x or "", y or "") for x, y in zip(a, b, strict=True)])


@F.pandas_udf(ArrayType(StringType()))
def entity_names(text: pd.Series) -> pd.Series:
    return text.map(lambda t: entities(t or ""))


@F.pandas_udf(StringType())
def nfkc(text: pd.Series) -> pd.Series:
    import unicodedata

    return text.map(lambda t: None if t is None else unicodedata.normalize("NFKC", t))


def style_copy(run: Column, hit_sentences: Column, most: int = 20, sentences: int = 1) -> Column:
    """Reasons for more than one short borrowed span."""
    from .gates import reasons

    return reasons({"style_copy_contiguous_overlap_exceeded": run > most, "style_copy_eight_gram_sentence_quota_exceeded": hit_sentences > sentences})
