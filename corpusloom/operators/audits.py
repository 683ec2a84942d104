"""Audits of graded cases: each gives ``(id, reasons)``, sorted and each once, and a summary of a few rows.

A case table has ``id, pos, split, prompt, essay, response, failure_type, tags``, ``scores`` and ``feedback`` (structs of
the four criteria), ``provenance`` and ``labeling`` (structs). ``pos`` is the order of input: of equal texts the first one
counts as seen, whether it is accepted or not. Firsts are found by a partial aggregate and a join, so a text that a third
of all rows have meets no window.
"""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import gates as G
from ..functions import jsonx as X
from ..functions import text as T
from . import overlap as O

# Tags, labels and thresholds that define the audits' results.
REAL_TAGS = ("ap_central", "real_eval", "tom_richey", "quizlet", "seed_real")
OFFICIAL_TAGS = ("ap_central", "real_eval", "college_board", "tom_richey", "quizlet")
ADVERSARIAL = ("grade_inflation_request", "prompt_injection")
INDEPENDENT = ("independent_consensus", "adjudicated")
REVIEW_RATE, LONG_WORDS, LONG_RATE, LEAST_ROWS = 0.10, 400, 0.10, 102
IDEAL_ROWS, MEDIAN_WORDS = 250, 150
VERSIONS = ("2023", "2024-2026")
TOTALS = tuple(range(7))
REAL_PREFIXES = ("ap_central_", "tom_richey_", "quizlet_", "real_eval")
BOUNDARIES = ("thesis_0_1", "contextualization_0_1", "evidence_0_1", "evidence_1_2", "analysis_reasoning_0_1", "analysis_reasoning_1_2")
LEAST_CONFIDENCE = 0.85
INSTRUCTIONS = ("target score", "target total", "hidden calibration", "student persona", "these instructions", "training data")
INFLATION = ("6/6", "full credit", "be lenient")
INJECTION = ("ignore previous", "ignore prior", "award full points")
LENGTH_TOLERANCE = 0.15

NONE = "array<string>"


def only(*parts: Column) -> Column:
    """Reason arrays and single reasons as one array without nulls."""
    return F.filter(F.array(*parts), lambda r: r.isNotNull())


def total(scores: str = "scores") -> Column:
    return sum((F.col(f"{scores}.{c}") for c in G.CRITERIA), F.lit(0)).cast("int")


def feedback_text(feedback: str = "feedback") -> Column:
    return F.concat_ws(" ", *[F.col(f"{feedback}.{c}") for c in G.CRITERIA])


def with_quality(cases: DataFrame, strict: bool) -> DataFrame:
    """Adds ``quality``, the reasons of the full gate on the response, essay and feedback spans; the response is parsed once."""
    parsed = cases.withColumn("_p", X.parse_udf("response"))
    gate = G.case_gate(F.col("_p"), F.col("response"), F.col("essay"), F.col("labeling.feedback_spans"), F.col("labeling.method"), strict)
    return parsed.withColumn("quality", gate).drop("_p")


def with_first(cases: DataFrame, value: Column, into: str) -> DataFrame:
    """Adds ``into``, the id of the first row with the same value; null for that row itself."""
    keyed = cases.withColumn("_v", F.sha2(F.coalesce(value, F.lit("")), 256))
    first = keyed.groupBy("_v").agg(F.min(F.struct("pos", "id")).alias("_f"), F.count("*").alias("_n")).where("_n > 1").select("_v", "_f")
    joined = keyed.join(first, "_v", "left")
    return joined.withColumn(into, F.when(F.col("_f.pos") < F.col("pos"), F.col("_f.id"))).drop("_v", "_f")


def leaked_ids(cases: DataFrame, held: DataFrame, same_prompt_only: bool = False) -> DataFrame:
    """Distinct ``(id)`` of cases that copy a held-out text, or share eight words in a row with one which their own prompt has not.

    ``held(id, prompt, essay)``. Of equal normalized prompts a word-set Jaccard of 0.82 counts, otherwise that a text has
    40 words or three quarters of its own in common. A text too short to compare counts as a copy. With
    ``same_prompt_only``, copies are sought among texts of the same prompt alone.
    """
    normal = lambda d: d.select("id", T.normalize(F.coalesce("prompt", F.lit(""))).alias("p"), T.normalize(F.coalesce("essay", F.lit(""))).alias("norm")).withColumn("scrubbed", F.col("norm"))
    if O.fits_held(normal(held)):
        found = O.held_flags(normal(cases), normal(held), 4, 8, 0.82, 40, 0.75, same_prompt_only)
        return found.where((F.col("chars") < 80) | (F.col("n") == 0) | F.col("copy") | F.col("span")).select("id").distinct()
    form = lambda d: d.select("id", T.normalize(F.coalesce("prompt", F.lit(""))).alias("p"), F.coalesce("essay", F.lit("")).alias("text"))
    a, b = form(cases), form(held)
    short = a.where(O.too_short(F.col("text"))).select("id")
    words = lambda d: d.select("id", "p", T.fingerprint(F.col("text")).alias("t")).select("id", "p", F.size("t").alias("n"), F.explode("t").alias("token"))
    left, right = words(a), words(b).select(F.col("id").alias("other"), F.col("p").alias("q"), F.col("n").alias("m"), "token")
    met = left.join(right, [left["token"] == right["token"], *([F.col("p") == F.col("q")] if same_prompt_only else [])])
    shared = met.groupBy("id", "p", "n", "other", "q", "m").agg(F.count("*").alias("x"))
    near = F.col("x") >= F.lit(0.82) * (F.col("n") + F.col("m") - F.col("x"))
    over = F.col("x") >= F.least(F.lit(40).cast("double"), F.col("n") * 0.75)
    copies = shared.where(F.when((F.col("p") != "") & (F.col("p") == F.col("q")), near).otherwise(over)).select("id")
    spans = O.met_spans(a, T.grams(b.withColumnRenamed("id", "other"), "other", F.col("text"), 8).select("gram").distinct(), "id", 8).distinct()
    echoed = T.grams(a.select("id", F.col("p").alias("text")), "id", F.col("text"), 8)
    return short.unionByName(copies).unionByName(spans.join(echoed, ["id", "gram"], "left_anti").select("id")).distinct()


def result(rows: DataFrame, *parts: Column) -> DataFrame:
    r = G.sorted_reasons(*parts)
    return rows.select("*", r.alias("reasons")).withColumn("accepted", F.size("reasons") == 0)


def audit_training(cases: DataFrame, held: DataFrame | None = None) -> DataFrame:
    """``cases`` with ``reasons`` and ``accepted``: split, source, tags, labels, the full gate, copies, repeated feedback and leakage."""
    seen = with_first(with_first(with_quality(cases, strict=True), T.normalize(F.col("essay")), "_essay"), T.normalize(feedback_text()), "_said")
    leak = F.lit(False)
    if held is not None:
        seen = seen.join(leaked_ids(cases, held).withColumn("_leak", F.lit(True)), "id", "left")
        leak = F.col("_leak").isNotNull()
    ordinary = ~F.col("failure_type").isin(*ADVERSARIAL)
    named = G.reasons({
        "not_train_split": F.col("split") != "train",
        "real_source_in_training": F.col("provenance.source_type").isin("college_board", "external"),
        "real_source_tag_in_training": has_any("tags", REAL_TAGS),
        "ordinary_case_not_independently_labeled": ordinary & ~F.coalesce(F.col("labeling.method").isin(*INDEPENDENT), F.lit(False)),
        "missing_prompt_family_id": ordinary & (F.coalesce("provenance.prompt_family_id", F.lit("")) == ""),
        "forbidden_eval_leakage": leak,
    })
    return result(seen, named, F.col("quality"), copies()).drop("quality", "_essay", "_said", "_leak")


def copies() -> Column:
    """``exact_duplicate_of:<id>`` and ``repeated_feedback_of:<id>`` from the first rows seen."""
    return only(F.concat(F.lit("exact_duplicate_of:"), "_essay"), F.concat(F.lit("repeated_feedback_of:"), "_said"))


def has_any(tags: str, names: Sequence[str]) -> Column:
    return F.coalesce(F.arrays_overlap(F.col(tags), F.array(*[F.lit(n) for n in names])), F.lit(False))


def audit_collection(cases: DataFrame, allowed: Sequence[str]) -> DataFrame:
    """``cases`` with ``reasons`` and ``accepted``: allowed splits, the full gate, copies and repeated feedback."""
    seen = with_first(with_first(with_quality(cases, strict=True), T.normalize(F.col("essay")), "_essay"), T.normalize(feedback_text()), "_said")
    named = G.reasons({"unexpected_split": ~F.coalesce(F.col("split").isin(*allowed), F.lit(False))})
    return result(seen, named, F.col("quality"), copies()).drop("quality", "_essay", "_said")


def repeated(cases: DataFrame) -> Column:
    return F.col("_id_first") < F.col("pos")


def with_id_first(cases: DataFrame) -> DataFrame:
    """Adds ``_id_first``, the first place of an id."""
    return cases.join(cases.groupBy("id").agg(F.min("pos").alias("_id_first")), "id")


def audit_targets(cases: DataFrame) -> DataFrame:
    """``cases`` with ``reasons`` and ``accepted``: ids, essays, split, source, tags, and a target with one grounded sentence a criterion."""
    seen = with_first(with_id_first(cases), F.array_join(T.words(T.caseless(F.col("essay"))), " "), "_essay")
    said = {c: F.col(f"feedback.{c}") for c in G.CRITERIA}
    checks = {
        "duplicate_id": repeated(cases),
        "duplicate_essay": F.col("_essay").isNotNull(),
        "not_train_split": F.col("split") != "train",
        "non_synthetic_or_unknown_source": ~F.coalesce(F.col("provenance.source_type") == "synthetic", F.lit(False)),
        "official_source_tag": has_any("tags", OFFICIAL_TAGS),
    }
    for c, (low, high) in G.CRITERIA.items():
        checks[f"invalid_score:{c}"] = ~F.coalesce(F.col(f"scores.{c}").between(low, high), F.lit(False))
        checks[f"invalid_feedback:{c}"] = F.coalesce(T.strip(said[c]), F.lit("")) == ""
        checks[f"feedback_not_grounded:{c}"] = ~F.coalesce(G.refers_to(said[c], F.col("essay")), F.lit(False))
        checks[f"feedback_not_one_sentence:{c}"] = F.size(F.filter(F.split(T.strip(F.coalesce(said[c], F.lit(""))), "(?<=[.!?])\\s+"), lambda s: s != "")) != 1
    return result(seen, G.reasons(checks)).drop("_essay", "_id_first")


def targets_summary(audited: DataFrame) -> DataFrame:
    """One row: counts, distributions of accepted rows and ``global_reasons``."""
    ok = F.col("accepted")
    g = audited.agg(
        F.count("*").alias("total"),
        F.count_if(ok).alias("accepted"),
        F.array_sort(F.collect_set(F.when(ok, total()))).alias("totals"),
        F.array_sort(F.collect_set(F.when(ok, F.col("provenance.rubric_version")))).alias("versions"),
        F.count_if(ok & (T.word_count(F.col("essay")) >= LONG_WORDS)).alias("long"),
    )
    checks = {
        "not_substantially_larger_than_v2": F.col("total") <= LEAST_ROWS,
        "missing_total_band": F.col("totals") != F.array(*[F.lit(t) for t in TOTALS]),
        "missing_rubric_version": F.col("versions") != F.array(*[F.lit(v) for v in VERSIONS]),
        "insufficient_long_essays": F.when(F.col("accepted") > 0, F.col("long") / F.col("accepted")).otherwise(0.0) < LONG_RATE,
    }
    return g.withColumn("global_reasons", G.reasons(checks))


def audit_coverage(cases: DataFrame, tag: str = "synth_v4") -> DataFrame:
    """``cases`` with ``reasons`` and ``accepted``: ids, essays, tags, source and the full gate."""
    seen = with_first(with_id_first(with_quality(cases, strict=False)), F.array_join(T.words(T.caseless(F.col("essay"))), " "), "_essay")
    checks = {
        "duplicate_id": repeated(cases),
        "duplicate_essay": F.col("_essay").isNotNull(),
        "official_source_tag": has_any("tags", (*OFFICIAL_TAGS, "seed_real")),
        "non_synthetic_source": ~F.coalesce(F.col("provenance.source_type") == "synthetic", F.lit(False)),
        f"missing_{tag}_tag": ~has_any("tags", (tag,)),
    }
    return result(seen, G.reasons(checks), F.col("quality")).drop("quality", "_essay", "_id_first")


def coverage_summary(audited: DataFrame) -> DataFrame:
    """One row: counts, least, upper median and greatest words of accepted rows, warnings, errors and ``clean``.

    The median is exact: words of accepted rows are counted by value first, so one row a distinct count is sorted.
    """
    ok = F.col("accepted")
    rows = audited.select(ok, total().alias("t"), T.word_count(F.col("essay")).alias("w"), real_row().alias("real"))
    g = rows.agg(F.count("*").alias("total"), F.count_if(ok).alias("accepted"), F.array_sort(F.collect_set(F.when(ok, F.col("t")))).alias("totals"), F.min(F.when(ok, F.col("w"))).alias("least_words"), F.max(F.when(ok, F.col("w"))).alias("most_words"), F.count_if("real").alias("n_real"))
    counts = rows.where("accepted").groupBy("w").agg(F.count("*").alias("n")).agg(F.array_sort(F.collect_list(F.struct("w", "n"))).alias("h"))
    half = F.floor(F.aggregate("h", F.lit(0).cast("long"), lambda s, x: s + x["n"]) / 2)
    walk = F.aggregate("h", F.struct(F.lit(0).cast("long").alias("s"), F.lit(None).cast("int").alias("m")), lambda a, x: F.struct((a["s"] + x["n"]).alias("s"), F.when(a["m"].isNull() & (a["s"] + x["n"] > half), x["w"]).otherwise(a["m"]).alias("m")))
    one = g.crossJoin(F.broadcast(counts.select(F.coalesce(walk["m"], F.lit(0)).alias("median_words"))))  # one row each
    missing = F.array_except(F.array(*[F.lit(t) for t in TOTALS]), F.col("totals"))
    one = one.withColumn("warnings", G.reasons({"few_rows": F.col("total") < IDEAL_ROWS, "short_median": (F.col("accepted") > 0) & (F.col("median_words") < MEDIAN_WORDS)}))
    errors = only(F.when(F.size(missing) > 0, F.concat(F.lit("missing_total_bands:"), F.concat_ws(",", missing.cast(NONE)))), F.when(F.col("n_real") > 0, F.lit("real_rows")))
    return one.withColumn("errors", errors).withColumn("clean", (F.col("accepted") == F.col("total")) & (F.size("errors") == 0))


def real_row() -> Column:
    """Whether a row is real: by tag, id, source or generator."""
    prefix = F.lit(False)
    for p in REAL_PREFIXES:
        prefix = prefix | F.col("id").cast("string").startswith(p)
    return has_any("tags", (*OFFICIAL_TAGS, "seed_real")) | prefix | F.coalesce(F.col("provenance.source_type") == "college_board", F.lit(False)) | F.coalesce(F.col("provenance.generator_name").isin("ap_central", "tom_richey", "quizlet"), F.lit(False))


def training_summary(audited: DataFrame) -> DataFrame:
    """One row: counts, the share of independently labeled rows that a person reviewed, and ``global_reasons``."""
    starts = lambda p: F.count_if(F.exists("reasons", lambda r: r.startswith(p)))
    own = F.col("accepted") & F.coalesce(F.col("labeling.method").isin(*INDEPENDENT), F.lit(False))
    g = audited.agg(F.count("*").alias("total"), F.count_if("accepted").alias("accepted"), starts("exact_duplicate_of:").alias("exact_duplicates"), starts("repeated_feedback_of:").alias("repeated_feedback"), F.count_if(own).alias("labeled"), F.count_if(own & F.coalesce("labeling.human_reviewed", F.lit(False))).alias("reviewed"))
    rate = F.when(F.col("labeled") > 0, F.col("reviewed") / F.col("labeled")).otherwise(0.0)
    return g.withColumn("review_rate", F.round(rate, 4)).withColumn("global_reasons", G.reasons({"human_review_rate_below_10_percent": (F.col("labeled") > 0) & (rate < REVIEW_RATE)}))


def distribution(audited: DataFrame, value: Column) -> DataFrame:
    """``(value, n)`` over accepted rows; null is ``unknown``."""
    return audited.where("accepted").groupBy(F.coalesce(value.cast("string"), F.lit("unknown")).alias("value")).agg(F.count("*").alias("n"))


def audit_golden(cases: DataFrame, reviews: DataFrame, host: str, source: str = "college_board", least: float = 0.9) -> DataFrame:
    """``(id, reasons, accepted)`` of official cases and of reviews for unknown cases (``review:<id>``).

    ``reviews(case_id, reviewer, essay_verified, scores_verified, provenance_verified)``.
    """
    p = lambda c: F.col(f"provenance.{c}")
    blank = lambda c: F.coalesce(p(c), F.lit("")) == ""
    ok = (F.coalesce("reviewer", F.lit("")) != "") & F.coalesce("essay_verified", F.lit(False)) & F.coalesce("scores_verified", F.lit(False)) & F.coalesce("provenance_verified", F.lit(False))
    told = reviews.groupBy("case_id").agg(F.count("*").alias("_reviews"), F.bool_and(ok).alias("_ok")).withColumnRenamed("case_id", "id")
    counts = cases.groupBy("id").agg(F.count("*").alias("_ids"))
    seen = with_first(with_quality(cases, strict=True), T.normalize(F.col("essay")), "_essay").join(counts, "id").join(told, "id", "left")
    url = F.coalesce(p("source_url"), F.lit(""))
    name = F.lower(F.regexp_extract(url, "^[A-Za-z][A-Za-z0-9+.-]*://(?:[^/?#@]*@)?([^/?#:]*)", 1))
    version = F.when(p("year") <= 2023, VERSIONS[0]).otherwise(VERSIONS[1])
    checks = {
        "duplicate_case_id": F.col("_ids") > 1,
        "not_official_college_board": ~F.coalesce(p("source_type") == source, F.lit(False)),
        "incomplete_provenance": blank("source_id") | blank("source_url") | blank("file_sha256") | blank("sample_id") | p("year").isNull() | ~F.coalesce(p("set_number").isin(1, 2), F.lit(False)) | p("leq_number").isNull(),
        "unverified_source_url": (url != "") & (name != host),
        "untrusted_extraction_method": ~F.coalesce(p("extraction_method") == "pdf_text", F.lit(False)),
        "low_extraction_confidence": ~F.coalesce(p("extraction_confidence") >= least, F.lit(False)),
        "rubric_version_mismatch": ~F.coalesce(p("rubric_version") == version, F.lit(False)),
        "duplicate_essay": F.col("_essay").isNotNull(),
        "missing_manual_review": F.col("_reviews").isNull(),
        "duplicate_manual_review": F.col("_reviews") > 1,
        "incomplete_manual_review": (F.col("_reviews") == 1) & ~F.col("_ok"),
    }
    own = result(seen, G.reasons(checks), F.col("quality")).select(F.col("id").cast("string").alias("id"), "reasons", "accepted")
    orphans = reviews.select("case_id").distinct().join(cases.select(F.col("id").alias("case_id")), "case_id", "left_anti")
    return own.unionByName(orphans.select(F.concat(F.lit("review:"), F.col("case_id").cast("string")).alias("id"), F.array(F.lit("review_for_unknown_case")).alias("reasons"), F.lit(False).alias("accepted")))


def permits(record: Mapping, use: str) -> bool:
    """Whether a permission record grants a use; anything missing does not."""
    return record.get("status") == "granted" and use in (record.get("allowed_uses") or ())


def require_permission(record: Mapping, use: str) -> None:
    if not permits(record, use):
        raise PermissionError(f"the permission record does not grant {use!r}")


def candidate_reasons(overlap: Column, hard: Column) -> Column:
    """Reasons of a candidate row, in order; ``overlap`` and ``hard`` are reason arrays that come first.

    Reads ``authenticity_reviews``, ``rubric_reviews`` (arrays of structs), ``resolved_grade``, ``distribution_match``
    (structs), ``fact_passed``, ``selection_class``, ``boundary_type``, ``contrast_pair_id``, ``contrast_side``, ``prompt``,
    ``prompt_family_id`` and ``style_seed_id``.
    """
    no = F.lit(False)
    auth = F.coalesce(F.col("authenticity_reviews"), F.array())
    likes = F.transform(auth, lambda r: F.coalesce(r["student_like"], no) & F.coalesce(r["timed_ap_consistent"], no))
    names = F.transform(auth, lambda r: F.coalesce(r["reviewer_id"], F.lit("")))
    split = (F.get(likes, F.lit(0)) != F.get(likes, F.lit(1))) & (F.size(auth) < 3)
    two = F.size(auth) >= 2
    about = only(
        F.when(~two, "missing_two_authenticity_reviews"),
        F.when(two & (F.size(F.array_distinct(names)) != F.size(auth)), "authenticity_reviewers_not_independent"),
        F.when(two & split, "authenticity_disagreement_requires_third_reader").when(two & (F.size(F.filter(likes, lambda x: x)) < 2), "authenticity_gate_failed"),
    )
    reviews = F.slice(F.coalesce(F.col("rubric_reviews"), F.array()), 1, 3)
    three = F.size(reviews) == 3
    valid = lambda s: s.isNotNull() & G.all_true([F.coalesce(s[c].between(low, high), no) for c, (low, high) in G.CRITERIA.items()])
    readers = F.array_distinct(F.transform(reviews, lambda r: F.coalesce(r["reader_id"], F.lit(""))))
    bad = F.transform(F.filter(reviews, lambda r: ~valid(r["scores"])), lambda r: F.lit("invalid_reader_scores"))
    unsure = F.exists(reviews, lambda r: F.coalesce(r["confidence"], F.lit(0.0)) < LEAST_CONFIDENCE) | (F.size(F.array_distinct(F.transform(reviews, lambda r: F.to_json(r["scores"])))) > 1)
    grade = F.col("resolved_grade")
    scored = only(
        F.when(unsure & ~F.coalesce(grade["adjudicated"], no), "rubric_adjudication_required"),
        F.when(grade["scores"].isNull(), "missing_resolved_scores").when(~valid(grade["scores"]), "invalid_resolved_scores"),
        F.when(grade["feedback"].isNull(), "missing_resolved_feedback").when(~G.all_true([grade["feedback"][c].isNotNull() for c in G.CRITERIA]), "invalid_resolved_feedback"),
    )
    rubric = F.when(three, F.concat(only(F.when(F.size(readers) != 3, "rubric_readers_not_independent")), bad, scored)).otherwise(F.array(F.lit("missing_three_blind_rubric_reviews")))
    kind = F.coalesce("selection_class", F.lit(""))
    match = F.coalesce(F.col("distribution_match.style_within_tolerance"), F.col("distribution_match.passed"), no)
    text = lambda c: F.coalesce(F.col(c), F.lit("")) != ""
    rest = only(
        F.when(~F.coalesce("fact_passed", no), "historical_fact_check_failed"),
        F.when(~kind.isin("golden_matched", "boundary"), "invalid_selection_class").when((kind == "golden_matched") & ~match, "golden_distribution_match_not_verified"),
        F.when((kind == "boundary") & ~F.coalesce(F.col("boundary_type").isin(*BOUNDARIES), no), "invalid_boundary_type"),
        F.when((kind == "boundary") & ~(text("contrast_pair_id") & F.coalesce(F.col("contrast_side").isin("lower", "upper"), no)), "incomplete_boundary_pair_metadata"),
        F.when(~text("prompt"), "missing_prompt"),
        F.when(~(text("prompt_family_id") & text("style_seed_id")), "missing_split_group_metadata"),
    )
    return F.concat(overlap, hard, about, rubric, rest)


def generated_reasons(rows: DataFrame, held: DataFrame) -> DataFrame:
    """``rows`` with ``reasons``: leaked prose, a length beyond the task's band, instruction words, missing adversarial markers.

    ``rows(id, prompt, essay, low, high, task_type, adversarial_type)``; ``held(id, prompt, essay)``.
    """
    leaked = leaked_ids(rows, held, same_prompt_only=True).withColumn("_leak", F.lit(True))
    n, low = T.word_count(F.col("essay")), F.lower(F.coalesce("essay", F.lit("")))
    any_word = lambda marks: G.any_true([F.contains(low, F.lit(m)) for m in marks])
    hostile, inflate = F.col("task_type") == "adversarial", F.coalesce(F.col("adversarial_type") == ADVERSARIAL[0], F.lit(False))
    checks = {
        "leaked_prose": F.col("_leak"),
        "length_out_of_band": (n < F.col("low") * (1 - LENGTH_TOLERANCE)) | (n > F.col("high") * (1 + LENGTH_TOLERANCE)),
        "generator_instruction_leakage": any_word(INSTRUCTIONS),
        "missing_grade_inflation_request": hostile & inflate & ~any_word(INFLATION),
        "missing_prompt_injection": hostile & ~inflate & ~any_word(INJECTION),
    }
    return rows.join(leaked, "id", "left").withColumn("reasons", G.reasons(checks)).drop("_leak")


def preflight(expected: DataFrame, found: DataFrame, training: DataFrame, held: DataFrame) -> DataFrame:
    """``(name, reason)`` of what stops a training run: missing artifacts, wrong row counts or digests, held-out rows.

    ``expected`` and ``found`` are ``(name, n_rows, sha256)``; ``training`` and ``held`` are ``(id, essay)``. No rows: go ahead.
    """
    e, f = expected.alias("e"), found.alias("f")
    j = e.join(f, F.col("e.name") == F.col("f.name"), "left")
    why = F.when(F.col("f.name").isNull(), "missing_artifact").when(F.col("e.n_rows") != F.col("f.n_rows"), "wrong_row_count").when(~F.col("e.sha256").eqNullSafe(F.col("f.sha256")), "hash_mismatch")
    files = j.select(F.col("e.name").alias("name"), why.alias("reason")).where("reason IS NOT NULL")
    digest = F.when(T.strip(F.coalesce("essay", F.lit(""))) != "", F.sha2(T.strip(F.col("essay")), 256))
    rows, other = training.select(F.col("id").cast("string").alias("name"), digest.alias("h")), held.select(F.col("id").cast("string").alias("name"), digest.alias("h"))
    by_id = rows.where("name <> ''").join(other.select("name").distinct(), "name", "left_semi").select("name")
    by_text = rows.join(other.where("h IS NOT NULL").select("h").distinct(), "h", "left_semi").select("name")
    return files.unionByName(by_id.unionByName(by_text).distinct().withColumn("reason", F.lit("held_out_row_in_training")))


def release_checks(summary: DataFrame, thresholds: Mapping[str, float], baseline: Mapping[str, float]) -> DataFrame:
    """``summary`` with a boolean a check and ``release_ready``: all seven fail closed on anything missing.

    Reads ``qwk, total_mae, total_within_one_rate, structured_output_valid_rate, evidence_grounding_rate, total_score_mean``
    and ``exact_<criterion>``; each criterion must be strictly better than its baseline.
    """
    better = [F.coalesce(F.col(f"exact_{c}") > b, F.lit(False)) for c, b in baseline.items()]
    checks = {
        "qwk_ok": G.at_least(F.col("qwk"), thresholds["qwk"]),
        "total_mae_ok": G.at_most(F.col("total_mae"), thresholds["total_mae"]),
        "within_one_ok": G.at_least(F.col("total_within_one_rate"), thresholds["total_within_one_rate"]),
        "valid_ok": G.at_least(F.col("structured_output_valid_rate"), thresholds["structured_output_valid_rate"]),
        "grounding_ok": G.at_least(F.col("evidence_grounding_rate"), thresholds["evidence_grounding_rate"]),
        "mean_bias_ok": G.at_most(F.abs(F.col("total_score_mean") - thresholds["reference_total_mean"]), thresholds["maximum_mean_bias"]),
        "criteria_improve": G.all_true(better),
    }
    return summary.select("*", *[c.alias(n) for n, c in checks.items()], G.all_true(list(checks.values())).alias("release_ready"))


def greedy_distinct(rows: DataFrame, keys: Sequence[str], order: str) -> DataFrame:
    """Rows taken in order unless an earlier taken row has one of their keys.

    In each round the rows that are the first undecided holders of all their keys are taken, and what shares a key with
    them is dropped: an aggregate a key, no pairs, so a key of any number of rows costs one row a partition. The least
    undecided row is always taken; rounds go on until none is left.
    """
    from ..sources.tables import durable

    left, taken = durable(rows), None
    while left.head(1):
        firsts = left
        for k in keys:
            firsts = firsts.join(left.groupBy(k).agg(F.min(order).alias(f"_{k}")), k).where(F.col(f"_{k}") == F.col(order)).drop(f"_{k}")
        firsts = durable(firsts.select(*rows.columns))
        taken = firsts if taken is None else taken.unionByName(firsts)
        for k in keys:
            left = left.join(firsts.select(k).distinct(), k, "left_anti")
        left = durable(left.select(*rows.columns))
    return rows.limit(0) if taken is None else taken


def assemble_mix(cases: DataFrame, target: int, share: float = 0.15) -> DataFrame:
    """At most ``target`` cases ``(id, pos, hostile)``, each unlike all before it in id, essay and feedback.

    Ordinary ones come first, then adversarial ones, to their quotas; the latter differ from the taken ordinary ones too.
    """
    hostile = round(target * share)
    digest = lambda c: F.sha2(F.coalesce(c, F.lit("")), 256)
    keyed = cases.select("id", "pos", F.coalesce(F.col("failure_type").isin(*ADVERSARIAL), F.lit(False)).alias("hostile"), digest(F.col("id").cast("string")).alias("k1"), digest(T.normalize(F.col("essay"))).alias("k2"), digest(T.normalize(feedback_text())).alias("k3"))
    keys = ("k1", "k2", "k3")
    first = greedy_distinct(keyed.where("NOT hostile"), keys, "pos").orderBy("pos").limit(target - hostile)
    rest = keyed.where("hostile")
    for k in keys:
        rest = rest.join(first.select(k).distinct(), k, "left_anti")
    return first.unionByName(greedy_distinct(rest, keys, "pos").orderBy("pos").limit(hostile)).select("id", "pos", "hostile")
