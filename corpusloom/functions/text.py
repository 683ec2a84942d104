"""Column expressions over text: normal forms, words, spans, sentences, excerpts and identifiers."""

from __future__ import annotations

import functools
from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

BLANKS = "[ \\t\\n\\x0B\\f\\r]+"

#: Years from 1400, and from 1600 for checks of facts, to 2099.
YEAR, LATE_YEAR = "1[4-9][0-9]{2}|20[0-9]{2}", "1[6-9][0-9]{2}|20[0-9]{2}"


# Marks of appended requests and phrases that tell a failure type.
ADVERSARIAL_MARKS = ("\n\nTeacher, I really need", "\n\nIgnore previous rubric")
FAILURE_PHRASES = {
    "prompt_injection": ("ignore previous rubric", "award full points"),
    "grade_inflation_request": ("really need a 6/6", "please be lenient"),
    "weak_thesis": ("in conclusion, history changed",),
    "evidence_list": ("happened one after another",),
    "wrong_period": ("from 1607 to 1754",),
    "borderline_complexity": ("significant but incomplete",),
    "missing_context": ("therefore, the period saw",),
}
LATER_THINGS = ("social security", "interstate highway", "tet offensive")


def strip(x: Column) -> Column:
    """Text without white space at its ends."""
    return F.regexp_replace(x, "^\\s+|\\s+$", "")


def squash(x: Column) -> Column:
    """Runs of ASCII white space as one blank, none at the ends."""
    return F.trim(F.regexp_replace(x, BLANKS, " "))


def normalize(x: Column) -> Column:
    """Lower case; everything but a-z, 0-9 and white space becomes a blank; blanks collapsed."""
    return squash(F.regexp_replace(F.lower(x), "[^a-z0-9 \\t\\n\\x0B\\f\\r]", " "))


def match_form(x: Column) -> Column:
    """Lower case with runs of other characters than a-z, 0-9 as one blank: for quote matching."""
    return F.trim(F.regexp_replace(F.lower(x), "[^a-z0-9]+", " "))


def unicode_form(x: Column) -> Column:
    """Lower case letters and digits of any script; all else is a blank."""
    return F.trim(F.regexp_replace(F.regexp_replace(F.lower(x), "[^\\p{L}\\p{N}]", " "), " +", " "))


def caseless(x: Column) -> Column:
    return F.lower(squash(x))


def words(x: Column) -> Column:
    """Words of a normalized text; an empty array for an empty text."""
    return F.filter(F.split(x, " "), lambda w: w != "")


def word_count(x: Column) -> Column:
    return F.size(words(squash(F.coalesce(x, F.lit("")))))


def fingerprint(x: Column, least: int = 4) -> Column:
    """Distinct normalized words of at least ``least`` characters."""
    return F.array_distinct(F.filter(words(normalize(x)), lambda w: F.length(w) >= least))


def content_words(x: Column, stop: Sequence[str]) -> Column:
    """Distinct words of four or more letters or apostrophes, quotes stripped, without stop words."""
    found = F.transform(F.regexp_extract_all(F.lower(x), F.lit("([a-z']{4,})"), 1), lambda w: F.trim(w, F.lit("'")))
    return F.filter(F.array_distinct(found), lambda w: (w != "") & ~w.isin(*stop))


def grams(df: DataFrame, key: str, text: Column, k: int, out: str = "gram", distinct: bool = True) -> DataFrame:
    """``(key, gram)``: all k-word spans of normalized texts, each once if ``distinct``.

    Words are exploded and read ahead within their text, so no array of spans is ever built. Words
    are shuffled by the key; distinct spans, k times as large, are shuffled again, so they are for counts: a
    join with a small table needs none.
    """
    order = Window.partitionBy(key).orderBy("_p")
    exploded = df.select(F.col(key), F.posexplode(words(normalize(text))).alias("_p", "_w"))
    span = F.concat_ws(" ", "_w", *[F.lead("_w", i).over(order) for i in range(1, k)])
    found = exploded.select(key, span.alias(out), F.lead("_p", k - 1).over(order).alias("_end")).where("_end IS NOT NULL").select(key, out)
    return found.distinct() if distinct else found


def span_keys(x: Column, k: int) -> Column:
    """128 bits of each k-word span of a normalized text, in order, within the row: two hashes, as ``span_key`` gives them."""
    each = lambda w: F.transform(F.sequence(F.lit(1), F.size(w) - k + 1), lambda i: span_key(F.slice(w, i, k)))
    # the words are bound once, as the one element of an array
    return F.flatten(F.transform(F.filter(F.array(words(normalize(x))), lambda w: F.size(w) >= k), each))


def span_key(span: Column) -> Column:
    """Two hashes of a span's words."""
    return F.struct(F.xxhash64(span).alias("a"), F.xxhash64(F.lit(1), span).alias("b"))


def sentences(x: Column) -> Column:
    """Split behind . ! ? and white space, and at line breaks; blank parts dropped."""
    return F.filter(F.transform(F.split(strip(x), "(?<=[.!?])\\s+|\\n+"), strip), lambda s: s != "")


def clauses(x: Column, least: int = 12, most: int = 120) -> Column:
    """Parts between . ! ? of a length within bounds."""
    return F.filter(F.transform(F.split(x, "[.!?]"), strip), lambda s: F.length(s).between(least, most))


def paragraphs(x: Column, group: int = 3) -> Column:
    """Parts between blank lines; a text without any is cut into groups of sentences."""
    parts = F.filter(F.transform(F.split(strip(x), "\\n\\s*\\n"), strip), lambda p: p != "")
    own = sentences(x)
    grouped = F.transform(F.sequence(F.lit(0), F.greatest(F.ceil(F.size(own) / group).cast("int") - 1, F.lit(0))), lambda i: F.array_join(F.slice(own, i * group + 1, group), " "))
    return F.when(F.size(parts) > 1, parts).when(F.size(own) > group, grouped).otherwise(parts)


def cut_at(x: Column, marker: str) -> Column:
    """Text before the first match of a marker, right-trimmed."""
    at = F.regexp_instr(x, F.lit(marker))
    return F.regexp_replace(F.when(at > 0, F.substring(x, F.lit(1), at - 1)).otherwise(x), "\\s+$", "")


def excerpt(x: Column, most: int = 400) -> Column:
    """At most ``most`` characters, cut behind a word, with an ellipsis where cut."""
    flat = squash(x)
    head = F.regexp_replace(F.substring(flat, 1, most), " [^ ]*$", "")
    return F.when(F.length(flat) <= most, flat).otherwise(F.concat(head, F.lit("...")))


def page_text(x: Column) -> Column:
    """Scanned page text: soft hyphens dropped, words joined over line ends, number lines dropped, blanks collapsed."""
    joined = F.regexp_replace(F.regexp_replace(x, "­", ""), "([A-Za-z])-\\n([a-z])", "$1$2")
    return squash(F.regexp_replace(joined, "(?m)^[ \\t]*[0-9]+[ \\t]*$", ""))


def strip_tags(x: Column) -> Column:
    """HTML without script, style and tags."""
    return squash(F.regexp_replace(F.regexp_replace(x, "(?is)<(script|style)[^>]*>.*?</(script|style)>", " "), "<[^>]*>", " "))


def anchor(x: Column, least: int = 15, most: int = 70) -> Column:
    """The first sentence-like part of at least ``least`` characters, cut to ``most``."""
    found = F.filter(F.transform(F.split(x, "[.!?]"), strip), lambda s: F.length(s) >= least)
    return F.coalesce(F.substring(F.get(found, F.lit(0)), 1, most), F.lit(""))


def anchors(x: Column, n: int = 4, k: int = 8) -> Column:
    """``n`` spans of ``k`` words from places spread over a text, each verbatim in it and over 12 characters; sentence starts fill up.

    A text with fewer gets its last span again, and one without any its first words.
    """
    w = words(squash(x))
    count = F.size(w)
    step = F.greatest(F.lit(1), F.floor(count / n).cast("int"))
    starts = F.sequence(F.lit(0), F.greatest(F.lit(0), count - k), step)
    usable = lambda spans: F.filter(spans, lambda s: (F.length(s) > 12) & F.contains(x, s))
    spread = usable(F.transform(starts, lambda i: F.array_join(F.slice(w, i + 1, k), " ")))
    begun = usable(F.transform(F.filter(sentences(x), lambda s: F.size(words(squash(s))) >= 4), lambda s: F.array_join(F.slice(words(squash(s)), 1, k), " ")))
    found = F.slice(F.array_distinct(spread), 1, n)
    found = F.when(F.size(found) < n, F.slice(F.array_distinct(F.concat(found, begun)), 1, n)).otherwise(found)
    some = F.when(F.size(found) > 0, found).when(count > 0, F.array(F.array_join(F.slice(w, 1, k), " "))).otherwise(F.array(F.lit("this essay")))
    return F.concat(some, F.array_repeat(F.element_at(some, -1), n - F.size(some)))


def without_adversarial(x: Column, marks: Sequence[str] = ADVERSARIAL_MARKS) -> Column:
    """Text before the first given mark that it has; marks are tried in order."""
    out = x
    for m in reversed(marks):
        out = F.when(F.contains(x, F.lit(m)), F.substring_index(x, m, 1)).otherwise(out)
    return out


def failure_type(x: Column) -> Column:
    """A failure type from phrases that tell it, the first that fits."""
    low = F.lower(x)
    has = lambda *phrases: functools.reduce(lambda a, b: a | b, [F.contains(low, F.lit(p)) for p in phrases])
    out = F.lit("strong")
    for name, phrases in reversed(FAILURE_PHRASES.items()):
        fits = has(*phrases)
        if name == "wrong_period":
            fits = fits & has(*LATER_THINGS)
        if name == "missing_context":
            fits = fits & ~F.contains(F.substring(low, 1, 120), F.lit("context"))
        out = F.when(fits, name).otherwise(out)
    return out


def slug(x: Column, stop: Sequence[str], most: int = 6) -> Column:
    """The first distinct content words and all years, joined by hyphens."""
    kept = F.slice(F.array_distinct(F.filter(words(normalize(x)), lambda w: (F.length(w) > 3) & ~w.isin(*stop) & ~w.rlike("^[0-9]"))), 1, most)
    return F.array_join(F.concat(kept, F.array_distinct(years(x))), "-")


def years(x: Column) -> Column:
    """Four-digit years 1400-2099, in order."""
    return F.regexp_extract_all(x, F.lit(f"\\b({YEAR})\\b"), 1)


def year_range(x: Column, year: str = YEAR, joint: str = "-|to|and") -> Column:
    """(start, end): a written range, else the least and greatest year; null without years."""
    written = f"\\b({year})\\s*(?:{joint})\\s*({year})\\b"
    first, second = F.regexp_extract(x, written, 1), F.regexp_extract(x, written, 2)
    all_years = F.regexp_extract_all(x, F.lit(f"\\b({year})\\b"), 1).cast("array<int>")
    a = F.when(first != "", first.cast("int")).otherwise(F.array_min(all_years))
    b = F.when(first != "", second.cast("int")).otherwise(F.array_max(all_years))
    return F.struct(F.least(a, b).alias("start"), F.greatest(a, b).alias("end"))


def scrub(x: Column, phrases: Sequence[str]) -> Column:
    """A normalized text without allowed phrases, longest first, cutting inside words where they occur."""
    import re

    forms = sorted({re.sub(r"\s+", " ", re.sub(r"[^a-z0-9\s]", " ", p.lower())).strip() for p in phrases} - {""}, key=lambda p: (-len(p), p))
    return squash(F.regexp_replace(normalize(x), "|".join(re.escape(f) for f in forms), " ")) if forms else normalize(x)


def repeated_span(x: Column, k: int, times: int) -> Column:
    """Whether some k-word span of the text occurs at least ``times`` times (words: a-z, 0-9, apostrophe).

    Sorted spans stand next to their equals, so one look ``times - 1`` further suffices.
    """
    w = F.regexp_extract_all(F.lower(x), F.lit("([a-z0-9']+)"), 1)
    n = F.size(w) - k + 1
    spans = F.when(n >= times, F.array_sort(F.transform(F.sequence(F.lit(1), F.greatest(n, F.lit(1))), lambda i: F.xxhash64(F.array_join(F.slice(w, i, k), " "))))).otherwise(F.array().cast("array<bigint>"))
    same = F.zip_with(spans, F.slice(spans, times, F.greatest(F.size(spans), F.lit(1))), lambda a, b: F.coalesce(a == b, F.lit(False)))
    return F.exists(same, lambda e: e)
