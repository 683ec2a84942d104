"""Gates: predicates that return machine-readable reasons. A gate is ok where its reasons are empty."""

from __future__ import annotations

import functools
from collections.abc import Mapping, Sequence

from pyspark.sql import Column
from pyspark.sql import functions as F

from . import text as T

# Patterns, word lists and ranges that define the gates' results.
REWRITE = (r"\bhere is a revised\b", r"\bimproved (thesis|essay|version)\b", r"\byou should rewrite\b", r"\btry this thesis instead\b")
HALLUCINATION = (r"\baccording to document\b", r"\bprimary source quote\b")
CONTAMINATION = (
    r"\bscoring commentary\b",
    r"\blong essay question\s+\d+\s*\(continued\)",
    r"\blong essay question\s+\d+\b",
    r"\bthesis(?:/claim)? score:\s*\d",
    r"\bcontextualization score:\s*\d",
    r"\bevidence score:\s*\d",
    r"\banalysis and reasoning score:\s*\d",
    r"\btotal score:\s*\d",
    r"\bpage\s+\d+\s+of\s+\d+\b",
    r"\bthe response (?:earned|did not earn)\b",
)
#: All of the reference's patterns; the SQL of the queries has those of CONTAMINATION only.
SOURCE_CONTAMINATION = (
    *CONTAMINATION,
    r"©\s*\d{4}\s+college board",
    r"\bap(?:®|\s+)?\s*united states history\s+20\d{2}\b",
    r"visit\s+college board on the web",
)
LEAKAGE = (
    r"\btarget (?:total|score|rubric profile)\b",
    r"\btraining data(?:set)?\b",
    r"\bstudent persona\b",
    r"\bknowledge profile\b",
    r"\bthese generation instructions\b",
    r"\bi was asked to write\b",
)
ARTIFACTS = {
    "memory_or_notes": (r"\b(?:class\s+)?notes?\b", r"\bfrom memory\b", r"\bmy memory\b", r"\bin my notes\b", r"\bcoming up in notes\b"),
    "planning_or_draft_process": (r"\b(?:outline|outlining|checklist|draft|drafting|rewrite|rewriting)\b", r"\bwriting process\b", r"\bas i (?:write|plan|draft)\b", r"\bi am (?:writing|planning|drafting)\b", r"\bmargins?\b"),
    "physical_test_conditions": (r"\b(?:bluebooks?|pencils?|erasers?|seating|clocks?)\b", r"\b(?:test conditions?|timed test|exam room)\b", r"(?:^|[^A-Za-z])pens?(?:[^A-Za-z]|$)"),
    "knowledge_admission": (r"\bi (?:cannot|can't|can not) recall\b", r"\bi (?:don't|do not|cant|can't) remember\b", r"\bi forget\b", r"\bi (?:don't|do not) know (?:the|enough|much)\b", r"\bmissing knowledge\b", r"\bfuzzy in my (?:notes|memory)\b"),
    "generator_mattering_stub": (r"\bmattering\b",),
    "prompt_or_instruction_leakage": (r"\bthese generation instructions\b", r"\bi was asked to write\b", r"\btarget (?:total|score|rubric)\b", r"\bstudent persona\b", r"\bstyle reference\b", r"\bfact cards?\b"),
    "timing_theater_filler": ("hard to finish in time", "lost a little time", "running out of time", "not enough time"),
    "stock_classroom_filler": ("teachers say", "classmates argued", "my outline was short", "worksheet"),
}
#: Marks of a scoring document within an essay; a match names the mark.
MARKERS = {
    "scoring_commentary": r"\bScoring\s+Commentary\b",
    "commentary_page_header": r"(?:^|\n)[ \t]*Long\s+Essay\s+Question\s+\d+(?:\s*\(continued\))?[ \t]*(?:\n|$)",
    "ap_page_header": r"\bAP(?:®|\s+)?\s*United\s+States\s+History\s+20\d{2}\b",
    "sample_score_header": r"(?:^|\n)[ \t]*Sample:\s*\d+[A-C]\b|(?:^|\n)[ \t]*(?:Thesis(?:/Claim)?|Contextualization|Evidence|Analysis\s+and\s+Reasoning|Total)(?:\s+Score)?:\s*\d+\b",
    "commentary_row_label": r"(?:^|\n)[ \t]*[A-D]\.[ \t]+(?:Thesis/Claim|Contextualization|Evidence|Analysis\s+and\s+Reasoning)\b",
    "document_page_marker": r"(?:^|\n)[ \t]*(?:Page[ \t]+\d+[ \t]+of[ \t]+\d+[ \t]+\d+[ \t]*(?:\r?\n[ \t]*)?[A-C]|Sample[ \t]+\d+[ \t]*[A-C][ \t]+\d+[ \t]+of[ \t]+\d+)[ \t]*(?:\n|$)",
    "copyright_footer": r"©\s*20\d{2}\s+College\s+Board|Visit\s+College\s+Board\s+on\s+the\s+web|\bapcentral\.collegeboard\.org\b|\bcollegeboard\.org\b",
    "commentary_boilerplate": r"Student\s+samples\s+are\s+quoted\s+verbatim|\bThe\s+response\s+(?:earned|did\s+not\s+earn)\b|\bearned\s+(?:0|1|2|one|two)\s+points?\b",
}
#: Words near a late year that excuse it, and the characters to either side that are searched.
LATER_CUES, CUE_REACH = r"\b(?:later|legacy|eventually|would later|afterward|today)\b", 40
INDEPENDENT = ("independent_consensus", "adjudicated")
FILLER = ("hard to finish in time", "teachers say", "classmates argued", "my outline was short", "lost a little time")
STOP_WORDS = ("this", "that", "with", "from", "have", "were", "their", "about", "which", "essay")
CRITERIA = {"thesis": (0, 1), "contextualization": (0, 1), "evidence": (0, 2), "analysis_reasoning": (0, 2)}


def reasons(checks: Mapping[str, Column]) -> Column:
    """Names of the checks that hold, in order; a null check does not."""
    return F.filter(F.array(*[F.when(c, F.lit(name)) for name, c in checks.items()]), lambda r: r.isNotNull())


def sorted_reasons(*parts: Column) -> Column:
    """The union of reason arrays, sorted, each once."""
    return F.array_sort(F.array_distinct(F.concat(*parts)))


def all_true(checks: Sequence[Column]) -> Column:
    return functools.reduce(lambda a, b: a & b, checks, F.lit(True))


def any_true(checks: Sequence[Column]) -> Column:
    return functools.reduce(lambda a, b: a | b, checks, F.lit(False))


def markers(x: Column) -> Column:
    """Names of the marks of a scoring document in an essay, in order."""
    return reasons({name: x.rlike(f"(?i){pattern}") for name, pattern in MARKERS.items()})


def any_of(x: Column, patterns: Sequence[str]) -> Column:
    """Whether any pattern occurs, in either case: one alternation, so one scan of the text."""
    return x.rlike("(?i)(?:" + "|".join(f"(?:{p})" for p in patterns) + ")")


def artifact_categories(x: Column) -> Column:
    checks = {name: any_of(x, patterns) for name, patterns in ARTIFACTS.items()}
    checks["prompt_or_instruction_leakage"] = checks["prompt_or_instruction_leakage"] | any_of(x, LEAKAGE)
    return reasons(checks)


def refers_to(feedback: Column, essay: Column) -> Column:
    """Two shared content words, or a sentence of the essay, or a word over five letters that is part of the essay's text."""
    said, written = T.content_words(feedback, STOP_WORDS), T.content_words(essay, STOP_WORDS)
    low = F.lower(essay)
    quoted = F.exists(T.clauses(essay), lambda c: F.contains(F.lower(feedback), F.lower(c)))
    within = F.exists(said, lambda w: (F.length(w) > 5) & F.contains(low, w))
    return (F.size(said) > 0) & (F.size(written) > 0) & ((F.size(F.array_intersect(said, written)) >= 2) | quoted | within)


def quotes(x: Column) -> Column:
    """Spans of twelve or more characters in double quotes, or in single quotes at word boundaries."""
    return F.concat(F.regexp_extract_all(x, F.lit('"([^"]{12,})"'), 1), F.regexp_extract_all(x, F.lit("(?<![A-Za-z])'([^']{12,})'(?![A-Za-z])"), 1))


def hallucinates(x: Column, essay: Column) -> Column:
    """Whether a text names a source it has not, or quotes three or more words that the essay lacks."""
    form = T.match_form(essay)
    segments = F.flatten(F.transform(quotes(x), lambda q: F.transform(F.split(q, "\\.\\.\\.|…"), T.match_form)))
    strange = F.exists(segments, lambda s: (F.size(F.split(s, " ")) >= 3) & ~F.contains(form, s))
    return any_of(x, HALLUCINATION) | strange


def essay_gate(essay: Column, feedback: Column) -> Column:
    """The composed quality gate of an essay and its feedback."""
    return reasons({
        "feedback_not_grounded": ~refers_to(feedback, essay),
        "rewrites_essay": any_of(feedback, REWRITE),
        "source_text_contamination": any_of(essay, SOURCE_CONTAMINATION),
        "generation_prompt_leakage": any_of(essay, LEAKAGE),
        "hallucinated_quote": hallucinates(feedback, essay),
    })


def case_gate(parsed: Column, response: Column, essay: Column, spans: Column, method: Column, strict: bool = False) -> Column:
    """Reasons of the full gate, in order: of a response that is not parsed or not valid, only those.

    ``parsed``: ``jsonx.parse_udf`` of the response. ``spans``: criterion to quoted spans, which must be in the essay; a
    strict gate asks independently labeled cases for them.
    """
    said = {c: parsed["feedback"][c] for c in CRITERIA}
    both = F.concat_ws(" ", *said.values())
    checks = {f"feedback_not_grounded_{c}": ~F.coalesce(refers_to(said[c], essay), F.lit(False)) for c in CRITERIA}
    checks |= {"rewrites_essay": any_of(response, REWRITE), "source_text_contamination": any_of(essay, SOURCE_CONTAMINATION), "generation_prompt_leakage": any_of(essay, LEAKAGE), "hallucinated_quote": hallucinates(both, essay)}
    form, given = T.match_form(essay), F.coalesce(F.size(spans) > 0, F.lit(False))
    for c in CRITERIA:
        own = F.coalesce(F.try_element_at(spans, F.lit(c)), F.array().cast("array<string>"))
        strange = F.exists(own, lambda s: (T.strip(s) != "") & ~F.contains(form, T.match_form(s)))
        checks[f"missing_feedback_span_{c}"] = given & (F.size(own) == 0)
        checks[f"ungrounded_feedback_span_{c}"] = given & strange
    checks["missing_feedback_spans"] = F.lit(strict) & ~given & F.coalesce(method.isin(*INDEPENDENT), F.lit(False))
    found = F.coalesce(parsed["reasons"], F.array().cast("array<string>"))
    invalid = F.coalesce(parsed["invalid"], F.array().cast("array<string>"))
    return F.when(parsed["json"].isNull(), found).when(F.size(invalid) > 0, F.concat(found, invalid)).otherwise(F.concat(found, reasons(checks)))


def length_band(reference: Column) -> tuple[Column, Column]:
    """(low, high) word counts allowed for a reference of so many words; halves round to even."""
    ref = F.greatest(F.lit(1), reference.cast("int"))
    times = lambda x: F.bround(ref * F.lit(x)).cast("int")
    low = F.when(ref < 120, F.greatest(F.lit(70), times(0.70))).when(ref > 420, times(0.75)).otherwise(times(0.80))
    wide = F.greatest(times(1.40), F.least(F.lit(320), F.greatest(F.lit(180), ref + 100)))
    high = F.when(ref < 120, F.greatest(wide, low + 25)).when(ref > 420, times(1.25)).otherwise(times(1.20))
    return low, high


def length_gate(essay_words: Column, reference: Column) -> Column:
    """At most one reason: outside the reference's band, else too short."""
    low, high = length_band(reference)
    outside = ~essay_words.between(low, high)
    known = reference.isNotNull() & (reference > 0)
    return reasons({"length_outside_reference_band": known & outside, "essay_too_short": known & ~outside & (essay_words < 40)})


def score_gate(scores: Mapping[str, Column]) -> Column:
    """``missing_<c>`` and ``out_of_range_<c>``; scores are integer columns."""
    checks = {}
    for name, (low, high) in CRITERIA.items():
        checks[f"missing_{name}"] = scores[name].isNull()
        checks[f"out_of_range_{name}"] = ~scores[name].between(low, high)
    return reasons(checks)


def filler_dense(x: Column, n_words: Column, most: int = 360) -> Column:
    hits = sum((F.lower(x).contains(p).cast("int") for p in FILLER), F.lit(0))
    return (hits >= 3) & (n_words <= most)


def fact_check(prompt: Column, essay: Column) -> Column:
    """The first failed check of an essay, or null."""
    w = F.filter(F.split(T.squash(essay), " "), lambda x: x != "")
    unique = F.size(F.array_distinct(F.transform(w, F.lower))) / F.size(w)
    span = T.year_range(prompt, T.LATE_YEAR, "-|–|—|to|and|through")
    own = F.regexp_extract_all(essay, F.lit(f"\\b({T.LATE_YEAR})\\b"), 1).cast("array<int>")
    late = F.array_distinct(F.filter(own, lambda y: y > span["end"] + 40))
    anachronism = F.exists(late, lambda y: ~excused(essay, y))
    absurd = F.size(F.filter(own, lambda y: (y < span["start"] - 350) | (y > span["end"] + 120))) >= 2
    return (
        F.when(F.size(w) < 8, F.lit("empty_or_too_short"))
        .when((F.length(F.regexp_replace(essay, "[^A-Za-z]", "")) < 20) | ~essay.rlike("[aeiouAEIOU]"), F.lit("nonsense_text"))
        .when((unique < 0.18) & (F.size(w) > 20), F.lit("nonsense_repetition"))
        .when(anachronism | absurd, F.lit("anachronistic_year"))
    )


def excused(essay: Column, year: Column) -> Column:
    """Whether some occurrence of a year has a cue of what came later within reach, to either side."""
    parts = F.split(essay, F.concat(F.lit("\\b"), year.cast("string"), F.lit("\\b")))
    joined = lambda first, n: F.call_function("array_join", F.slice(parts, first, n), year.cast("string"))

    def near(i: Column) -> Column:
        before, after = joined(F.lit(1), i), joined(i + 1, F.size(parts))
        reach = F.concat(F.right(before, F.lit(CUE_REACH)), year.cast("string"), F.left(after, F.lit(CUE_REACH)))
        return reach.rlike(f"(?i){LATER_CUES}")

    return F.when(F.size(parts) > 1, F.exists(F.sequence(F.lit(1), F.greatest(F.size(parts) - 1, F.lit(1))), near)).otherwise(F.lit(False))


def all_known(values: Column, allowed: Sequence[str]) -> Column:
    """Whether an array holds no value outside ``allowed``."""
    return F.size(F.array_except(values, F.array(*[F.lit(a) for a in allowed]))) == 0


def at_least(x: Column, floor: float) -> Column:
    """A threshold that fails closed on null."""
    return F.coalesce(x >= floor, F.lit(False))


def at_most(x: Column, ceiling: float) -> Column:
    return F.coalesce(x <= ceiling, F.lit(False))
