"""Queries that SQL has no form for, against plain versions over whole tables."""

import collections
import hashlib
import random
import re
import unicodedata

import pytest
from pyspark.sql import functions as F

from corpusloom.functions import gates as G
from corpusloom.functions import noise as N
from corpusloom.functions import tokens
from corpusloom.operators import audits as A
from corpusloom.operators import joins as J
from corpusloom.operators import select as S
from corpusloom.plans import audit_queries, gate_queries, registry
from corpusloom.sources import tables as R

from .test_audits import found, grounded, hallucinates, norm, spans

QUERIES = registry.queries()


@pytest.fixture(scope="module")
def documents(spark, data):
    return {r["doc_id"]: r for r in spark.read.parquet(f"{data}/documents.parquet").collect()}


def md5(x):
    return hashlib.md5(x.encode()).hexdigest()


def test_quality_gate(spark, data):
    have = {r["doc_id"]: r["reasons"] for r in QUERIES["quality_gate"](spark, data).collect()}
    rows = gate_queries.planted(spark, data).collect()
    want = {}
    for r in rows:
        x, said = r["x"], r["x"][:100]
        hits = {"feedback_not_grounded": not grounded(said, x), "rewrites_essay": found(G.REWRITE, said), "source_text_contamination": found(G.SOURCE_CONTAMINATION, x), "generation_prompt_leakage": found(G.LEAKAGE, x), "hallucinated_quote": hallucinates(said, x)}
        want[r["doc_id"]] = ",".join(k for k, hit in hits.items() if hit)
    assert have == want


def run(a, b):
    best = 0
    last = [0] * (len(b) + 1)
    for x in a:
        now = [0]
        for j, y in enumerate(b):
            now.append(last[j] + 1 if x == y else 0)
        best, last = max(best, *now), now
    return best


def test_style_copies(spark, data, documents):
    items = {r["item_id"]: r["text"] for r in spark.read.parquet(f"{data}/benchmark.parquet").collect()}
    have = {(r["doc_id"], r["item_id"]): (r["run"], r["hits"], r["reasons"]) for r in QUERIES["style_copies"](spark, data).collect()}
    want = {}
    for d, r in documents.items():
        for i, item in items.items():
            if spans(r["text"]) & spans(item):
                n = run(norm(r["text"]).split(), norm(item).split())
                hits = sum(bool(spans(s) & spans(item)) for s in re.split(r"(?<=[.!?])\s+|\n+", r["text"].strip()))
                want[d, i] = n, hits, ",".join(name for name, bad in (("style_copy_contiguous_overlap_exceeded", n > 20), ("style_copy_eight_gram_sentence_quota_exceeded", hits > 1)) if bad)
    assert have == want and want


def test_seeded_functions(spark, data, documents):
    first = {r["doc_id"]: r["digest"] for r in QUERIES["seeded_errors"](spark, data).collect()}
    assert first == {r["doc_id"]: r["digest"] for r in QUERIES["seeded_errors"](spark, data).collect()}
    assert first == {k: md5(N.misspell(N.run_on(r["text"], str(k)), str(k))) for k, r in documents.items()}
    assert sum(first[k] != md5(r["text"]) for k, r in documents.items()) > 0.8 * len(documents)
    text = "One sentence is here now. Another one has more than six words in it. End."
    assert N.fit_length(text, 1, 8) == "One sentence is here now." and len(N.fit_length(text, 40, 60).split()) >= 40
    assert N.fragment(text, "s", 1.0) == "One sentence is here now. than six words in it. End."
    assert N.prompt_variant("Assess how far trade changed from 1750 to 1800.", 0) == "Evaluate the extent to which trade changed from 1750 to 1800."
    assert {r["doc_id"]: r["n_entities"] for r in QUERIES["entity_names"](spark, data).collect()} == {k: len(N.entities(r["text"])) for k, r in documents.items()}


def test_matched_lengths(spark, data, documents):
    got = QUERIES["matched_length_sample"](spark, data).collect()
    pool, target = collections.Counter(), collections.defaultdict(list)
    for k, r in documents.items():
        pool[r["lang"]] += k % 2
        if k % 2 == 0:
            target[r["lang"]].append(r["n_chars"])
    own = collections.defaultdict(list)
    for r in got:
        own[r["lang"]].append(r["n_chars"])
    assert {k: len(v) for k, v in own.items()} == {k: min(20, n) for k, n in pool.items() if n and target[k]}
    assert len({r["doc_id"] for r in got}) == len(got) and all(r["doc_id"] % 2 for r in got)
    for lang, sizes in own.items():  # its median is nearer to the target's than the spread of the target
        middle = sorted(target[lang])[len(target[lang]) // 2]
        assert abs(sorted(sizes)[len(sizes) // 2] - middle) <= max(target[lang]) - min(target[lang])


def test_token_lengths(spark, data, documents):
    coder = tokens.tokenizer("byte_bpe_50k.json")
    want = collections.defaultdict(list)
    for r in documents.values():
        want[r["lang"]].append(len(coder.encode(r["text"], add_special_tokens=False).ids))
    assert {r["lang"]: (r["least"], r["most"], r["total"]) for r in QUERIES["token_lengths"](spark, data).collect()} == {k: (min(v), max(v), sum(v)) for k, v in want.items()}


def test_page_text_in_compatibility_form(spark, data):
    def clean(x):
        x = re.sub("([A-Za-z])-\n([a-z])", r"\1\2", unicodedata.normalize("NFKC", x).replace("­", ""))
        x = re.sub(r"(?m)^[ \t]*[0-9]+[ \t]*$", "", x)
        return re.sub("[ \t\n\x0b\f\r]+", " ", x).strip(" ")

    pages = spark.read.parquet(f"{data}/pages.parquet").collect()
    assert {r["page_id"]: r["digest"] for r in QUERIES["page_text_normal"](spark, data).collect()} == {r["page_id"]: md5(clean(r["html"])) for r in pages}


def test_parsers_read_whole_texts(spark, data, documents):
    got = collections.defaultdict(dict)
    for r in QUERIES["parsed_whole_sheets"](spark, data).collect():
        got[r["kind"], int(r["doc"])][r["sample_id"]] = (r["total"], r["error"], r["digest"])
    for k, r in documents.items():
        text = r["text"]
        assert got["sheet", k]["1A"] == (1, None, md5(f"{text.strip()}\nlast page")) or not text.strip()
        flat = re.sub(r"\s+", " ", text).strip()
        assert ("1" in got["labelled", k]) == (len(flat) >= 100) and got["labelled", k]["2"][0] == 4
        if len(flat) >= 100:
            assert got["labelled", k]["1"] == (3, None, md5(flat))
        if len(text.strip()) >= 120:
            assert got["cards", k]["1"][2] == md5(text.strip())


def test_split_by_set(spark):
    rows = [(1, 1, "p", 2020, "a"), (2, 1, "p", 2020, "b"), (3, 2, "q", 2020, "a"), (4, 2, "q", 2021, "a")]
    schema = "id long, set_number int, prompt string, year int, sample string"
    group = ["year", "prompt"]
    one, two = S.split_by_set(spark.createDataFrame(rows, schema), group, "sample", {1: 2, 2: 2})
    assert {r["id"] for r in one.collect()} == {1, 2} and {r["id"] for r in two.collect()} == {3, 4}
    for extra, reason in (((5, 3, "r", 2020, "a"), "bad_set_number"), ((5, None, "r", 2020, "a"), "bad_set_number"), ((1, 1, "z", 2020, "a"), "duplicate_id"), ((5, 1, "p", 2020, "B"), "duplicate_sample"), ((5, 2, "p", 2020, "c"), "prompt_on_both_sides")):
        with pytest.raises(ValueError, match=reason):
            S.split_by_set(spark.createDataFrame([*rows, extra], schema), group, "sample")
    with pytest.raises(ValueError, match="wrong_count"):
        S.split_by_set(spark.createDataFrame(rows, schema), group, "sample", {1: 3})


def test_greedy_distinct_with_a_hot_key(spark):
    rows = [(i, "hot" if i % 3 else f"k{i}", f"b{i // 2}") for i in range(300)]
    seen, want = (set(), set()), []
    for i, a, b in rows:
        if a not in seen[0] and b not in seen[1]:
            want.append(i)
            seen[0].add(a)
            seen[1].add(b)
    got = A.greedy_distinct(spark.createDataFrame(rows, "pos long, k1 string, k2 string"), ("k1", "k2"), "pos")
    assert sorted(r["pos"] for r in got.collect()) == want
    assert A.greedy_distinct(spark.createDataFrame([], "pos long, k1 string"), ("k1",), "pos").count() == 0


def test_long_lists_of_ranges(spark):
    rng = random.Random(8)
    rows = [(i, a := rng.randrange(400), a + rng.randrange(60)) for i in range(80)]
    ranges = [(i, a := rng.randrange(400), a + rng.randrange(25)) for i in range(50)]
    x, y = spark.createDataFrame(rows, "k int, s int, e int"), spark.createDataFrame(ranges, "o int, low int, high int")
    want = {}
    for k, s, e in rows:
        met = [(min(e, h) - max(s, low) + 1, -o) for o, low, h in ranges if s <= h and low <= e]
        if met:
            want[k] = (-max(met)[1], max(met)[0])
    for most in (10_000, 5):
        assert {r["k"]: (r["o"], r["overlap"]) for r in J.best_range(x, y, "k", "s", "e", "o", "low", "high", most).collect()} == want


def test_coverage_by_pairs_equals_a_scan():
    rng = random.Random(9)
    rows = [(f"f{i}", rng.choice("abc"), rng.choice("xyz")) for i in range(60)]
    taken, left, want = [("t", "a", "x")], list(rows), []
    by = [collections.Counter(), collections.Counter(), collections.Counter()]
    for x in taken:
        by[0][x[1]] += 1
        by[1][x[2]] += 1
        by[2][x[1:]] += 1
    while len(want) < 25:
        best = min(left, key=lambda x: (by[0][x[1]], by[1][x[2]], by[2][x[1:]], hashlib.sha256(f"s:p:{x[0]}".encode()).hexdigest()))
        left.remove(best)
        want.append(best)
        by[0][best[1]] += 1
        by[1][best[2]] += 1
        by[2][best[1:]] += 1
    assert S.coverage_greedy(rows, 25, "s", "p", taken) == want


def test_prefix_digests_follow_the_order(spark):
    df = spark.createDataFrame([(3, "a"), (1, "z"), (2, "m")], "k int, t string")
    (part, digest) = R.prefix_tables(df, "k", [2])[2]
    assert [r["k"] for r in part.collect()] == [1, 2]
    assert digest == hashlib.sha256(b'{"k":1,"t":"z"}\n{"k":2,"t":"m"}').hexdigest()


def test_audit_queries_have_a_row_a_case(spark, data, documents):
    n = len(documents)
    for name in ("full_quality_gate", "audit_training_cases", "audit_collection_cases", "audit_target_cases", "audit_coverage_cases", "candidate_reasons", "generated_candidates", "text_anchors"):
        assert QUERIES[name](spark, data).count() == n, name
    assert QUERIES["audit_golden_cases"](spark, data).where("NOT id LIKE 'review:%'").count() == n
    assert QUERIES["audit_training_summary"](spark, data).first()["total"] == n
    mixed = QUERIES["assembled_mix"](spark, data).collect()
    assert len({r["id"] for r in mixed}) == len(mixed) and sum(r["hostile"] for r in mixed) <= 18 and len(mixed) <= 120
    assert audit_queries.nested(spark, data).select(F.col("id")).distinct().count() == n
