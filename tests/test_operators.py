import io
import random
import zipfile

import numpy as np
import pytest
from pyspark.sql import functions as F

from corpusloom.functions import gates as G
from corpusloom.functions import jsonx as X
from corpusloom.functions import metrics as M
from corpusloom.functions import noise as N
from corpusloom.functions import text as T
from corpusloom.operators import joins as J
from corpusloom.operators import overlap as O
from corpusloom.operators import select as S
from corpusloom.sources import parsers as P
from corpusloom.sources import tables as R
from corpusloom.streaming import streams as K


def one(spark, column, **values):
    """A column expression's value over one row."""
    return spark.range(1).select(*[F.lit(v).alias(k) for k, v in values.items()]).select(column.alias("v")).first()["v"]


@pytest.mark.parametrize("text,want", [("", ""), ("  A--B\n c! ", "a b c"), ("naïve ß", "na ve"), ("x y", "x y")])
def test_normalize(spark, text, want):
    assert one(spark, T.normalize(F.col("t")), t=text) == want


@pytest.mark.parametrize("n,want", [(7, 0), (8, 1), (9, 2), (0, 0)])
def test_spans_of_short_texts(spark, n, want):
    df = spark.createDataFrame([(1, " ".join(f"w{i}" for i in range(n)))], "k long, text string")
    assert T.grams(df, "k", F.col("text"), 8).count() == want


def test_spans_of_null(spark):
    assert T.grams(spark.createDataFrame([(1, None)], "k long, text string"), "k", F.col("text"), 2).count() == 0


def test_repeated_span(spark):
    assert one(spark, T.repeated_span(F.col("t"), 2, 3), t="a b x a b y a b")
    assert not one(spark, T.repeated_span(F.col("t"), 2, 3), t="a b x a b")
    assert not one(spark, T.repeated_span(F.col("t"), 8, 3), t="")


def test_paragraphs_fall_back_to_sentences(spark):
    assert len(one(spark, T.paragraphs(F.col("t")), t="A. B. C. D.")) == 2
    assert len(one(spark, T.paragraphs(F.col("t")), t="a\n\nb")) == 2


def test_year_range(spark):
    assert tuple(one(spark, T.year_range(F.col("t")), t="from 1860 to 1850 or 1700")) == (1850, 1860)
    assert tuple(one(spark, T.year_range(F.col("t")), t="none")) == (None, None)


def test_gates_of_null_and_empty(spark):
    assert one(spark, G.artifact_categories(F.col("t")), t="") == []
    assert one(spark, G.essay_gate(F.lit("The long trade of towns grew."), F.lit("The long trade of towns")), t="") == []
    assert one(spark, G.at_least(F.lit(None).cast("double"), 0.5), t="") is False


def test_quotes_and_contractions(spark):
    essay = F.lit("The farmers' alliance wanted silver and gold money for all")
    assert not one(spark, G.hallucinates(F.lit("Bacon's claim isn't \"silver and gold money\""), essay), t="")
    assert one(spark, G.hallucinates(F.lit("It says 'railroads were built by hand'"), essay), t="")


@pytest.mark.parametrize("text,reason", [('{"a": 1}', []), ('x {"a": 1} y', ["json_extracted_from_prose"]), ("[1]", ["not_json_object"]), ('{"a": 1}]', ["json_extracted_from_prose"]), ("", ["invalid_json"]), ('{"a": NaN}', [])])
def test_lenient_parse(text, reason):
    assert X.parse_lenient(text)[1] == reason


def test_payload_types():
    good = {"scores": {"thesis": 1, "contextualization": 0, "evidence": 2, "analysis_reasoning": 1}, "total": 4, "feedback": dict.fromkeys(G.CRITERIA, "x")}
    assert X.check_payload(good) == []
    assert X.check_payload({**good, "scores": {**good["scores"], "thesis": True}}) == ["out_of_range_thesis", "total_mismatch"]
    assert X.check_payload({**good, "scores": {"thesis": 1}})[0] == "missing_contextualization"
    assert X.check_payload({**good, "scores": 3}) == ["missing_scores"]
    assert X.check_strict(good) == ["unexpected_top_level_keys"]


def test_balanced_objects_and_repair():
    assert X.balanced_objects('a {"x": "}{\\""} {b}') == [(2, 15), (16, 19)]
    text = '{"thesis": "1", "contextualization": 0, "evidence": 2, "analysis_reasoning": 1, "explanations": {"thesis": " a", "contextualization": "b", "evidence": "c", "analysis_reasoning": "d"}} end'
    value, raw, actions, errors = X.repair(text)
    assert value["total"] == 4 and not raw and not errors
    assert actions == ["extracted_balanced_object", "moved_top_level_scores", "renamed_explanations_to_feedback", "coerced_integral_string:thesis", "trimmed_feedback:thesis", "computed_total"]
    assert X.repair('{"scores": {}} {"scores": {}}')[3] == ["ambiguous_multiple_grade_objects"]
    assert X.repair("")[3] == ["no_parseable_json_object"]


def matrix_kappa(pairs):
    pairs = [(min(6, max(0, r)), min(6, max(0, p))) for r, p in pairs if p is not None and p >= 0]
    n = len(pairs)
    if n < 2:
        return None
    observed = sum((r - p) ** 2 for r, p in pairs) / n
    expected = sum((r - p) ** 2 for r, _ in pairs for _, p in pairs) / n / n
    return None if not expected else 1 - observed / expected


@pytest.mark.parametrize("pairs", [[(1, 1), (2, 2), (3, 4)], [(3, 3)] * 4, [(0, 9), (6, 5), (2, -1), (1, None)], [(1, 1)]])
def test_kappa(spark, pairs):
    got = spark.createDataFrame(pairs, "r int, p int").agg(M.kappa(F.col("r"), F.col("p")).alias("k")).first()["k"]
    want = matrix_kappa(pairs)
    assert got is None if want is None else got == pytest.approx(want)


def sequential(n, edges):
    taken = set()
    for i in range(n):
        if not any((i, j) in edges for j in taken):
            taken.add(i)
    return taken


def test_greedy_equals_loop(spark):
    rng = random.Random(3)
    for n in (1, 6, 12):
        edges = {(i, j) for i in range(n) for j in range(i) if rng.random() < 0.3}
        got = O.greedy_accept(spark.range(n).withColumnRenamed("id", "k"), spark.createDataFrame([*edges] or [(0, 1)][:0], "later long, earlier long"), "k")
        assert {r["k"] for r in got.collect() if r["accepted"]} == sequential(n, edges)


def test_jaccard_pairs_equal_brute_force(spark):
    rng = random.Random(5)
    words = [f"word{i}" for i in range(60)]
    rows = []
    for g in range(12):
        base = rng.sample(words, rng.randint(3, 25))
        rows += [(len(rows) + i, " ".join(w if rng.random() > 0.08 else rng.choice(words) for w in base)) for i in range(3)]
    rows = [(i, t) for i, (_, t) in enumerate(rows)] + [(900, ""), (901, None), (902, "a b c")]
    got = {(r["a"], r["b"]) for r in O.jaccard_pairs(spark.createDataFrame(rows, "k long, text string"), "k").collect()}
    sets = {k: set((t or "").split()) - {w for w in (t or "").split() if len(w) < 4} for k, t in rows}
    want = {(a, b) for a in sets for b in sets if a < b and sets[a] and sets[b] and len(sets[a] & sets[b]) >= 0.82 * len(sets[a] | sets[b])}
    assert got == want


def test_longest_run():
    assert N.longest_shared_run("a b c d e", "x b c d y") == 3
    assert N.longest_shared_run("", "a") == 0
    assert N.misspell("something else", "s") == N.misspell("something else", "s")
    assert 3 <= len(N.fit_length("One two. Three four five. Six.", 3, 5).split()) <= 5


def test_apportion_and_subset():
    assert S.apportion(10, {"a": 0.7, "b": 0.15, "c": 0.15}) == {"a": 7, "b": 2, "c": 1}
    assert sum(S.apportion(7, {str(i): 1 / 7 for i in range(7)}, floor=1).values()) == 7
    assert S.exact_subset([("a", 2, 1), ("b", 1, 1), ("c", 3, 0)], 4, 1) == ["b", "c"]
    assert S.exact_subset([("a", 2, 1)], 1, 1) is None


def test_family_splits_are_whole_and_order_free(spark):
    rows = [(i, f"f{i % 20}", f"a{i % 4}", f"b{i % 3}") for i in range(60)]
    split = lambda r: {x["id"]: x["split"] for x in S.family_splits(spark.createDataFrame(r, "id long, fam string, a string, b string"), "fam", "a", "b", {"train": 0.7, "dev": 0.15, "test": 0.15}, "s").collect()}
    got = split(rows)
    assert got == split(rows[::-1])
    by = {}
    for i, f, *_ in rows:
        by.setdefault(f, set()).add(got[i])
    assert all(len(v) == 1 for v in by.values())
    assert sorted([next(iter(v)) for v in by.values()].count(s) for s in ("train", "dev", "test")) == [3, 3, 14]


def test_strict_join_fails_on_unknown(spark):
    a, b = spark.createDataFrame([(1,), (2,)], "k long"), spark.createDataFrame([(1, "x")], "k long, v string")
    with pytest.raises(Exception, match="without a case"):
        J.strict_inner(a, b, "k").collect()
    with pytest.raises(Exception, match="one side"):
        J.paired(a, b, "k").collect()


def test_sheet_parser():
    text = "Sample 1A 1 of 2\nshort\nSample 1A 1 of 2\nlonger page\nSample 1A 2 of 2\nend\nSample: 1A\nThesis: 1\nEvidence: 2\nTotal Score: 4"
    (got,) = P.parse_sheet(text)
    assert got["text"] == "longer page\nend" and got["total"] == 4 and got["error"] == "row_sum_mismatch"
    assert P.parse_sheet("") == [] and P.parse_labelled("") == []
    assert P.parse_cards("no")[0]["error"] == "not_a_card_set"


def test_docx_parser():
    ns = "http://schemas.openxmlformats.org/wordprocessingml/2006/main"
    lines = ["Essay 1", "Text of it", "Scores: 1 0 2 1 total 4", "Essay 2", "More", "Scores: 1 1 1 1 total 5"]
    xml = f'<w:document xmlns:w="{ns}"><w:body>' + "".join(f"<w:p><w:r><w:t>{x}</w:t></w:r></w:p>" for x in lines) + "</w:body></w:document>"
    out = io.BytesIO()
    with zipfile.ZipFile(out, "w") as z:
        z.writestr("word/document.xml", xml)
    got = P.parse_docx(out.getvalue())
    assert [g["error"] for g in got] == [None, "row_sum_mismatch"] and got[0]["text"] == "Text of it"
    assert P.parse_docx(b"x")[0]["error"] == "not_a_docx"


def test_append_is_idempotent_and_guards_identity(spark, tmp_path):
    sink = str(tmp_path / "sink")
    rows = spark.createDataFrame([(1, "a"), (1, "a"), (2, "a")], "k long, run string")
    K.append_new(rows, sink, "k", "run")
    K.append_new(rows, sink, "k", "run")
    assert spark.read.parquet(sink).count() == 2
    with pytest.raises(ValueError, match="identity"):
        K.append_new(spark.createDataFrame([(1, "b")], "k long, run string"), sink, "k", "run")


def test_sinks(spark, tmp_path):
    df = spark.createDataFrame([(1, ["private"])], "k long, tags array<string>")
    with pytest.raises(ValueError):
        R.export_public(df, str(tmp_path / "x"), ["private"])
    files = R.export_public(df, str(tmp_path / "y"), ["other"], private_columns=["tags"])
    assert len(R.tree_hash(files)) == 64 and R.tree_hash(files) != R.tree_hash(files, framed=False)
    R.write_json_atomic(str(tmp_path / "a.json"), {"b": 1})
    R.write_json_atomic(str(tmp_path / "a.json"), {"b": 2}, backup=True)
    assert (tmp_path / "a.json.bak").exists()
    (tmp_path / "p.txt").write_text('{"phrase": "New York"}\nplain\nplain\n\n')
    assert R.read_phrases(spark, str(tmp_path / "p.txt")) == ["New York", "plain"]
    assert "| k |" in R.markdown(df.select("k"), "t")


def test_empty_tables(spark):
    empty = spark.createDataFrame([], "k long, text string")
    assert O.jaccard_pairs(empty, "k").count() == 0
    assert O.greedy_accept(empty.select("k"), spark.createDataFrame([], "later long, earlier long"), "k").count() == 0
    assert S.priority_sample(empty, F.col("k"), "k", 0.1).count() == 0


def test_range_conflicts_meet_by_blocks_of_values(spark):
    rng = random.Random(5)
    rows = [(i, rng.choice("xy"), rng.randrange(3), s := rng.randrange(-40, 40), s + rng.choice([-3, 0, 1, 4, 9])) for i in range(150)]
    rows += [(150, "x", 1, None, 3), (151, "x", 0, 2, None), (152, None, 0, 1, 2), rows[4], rows[5]]
    found = J.range_conflicts(spark.createDataFrame(rows, "id long, topic string, split int, s int, e int"), "id", "topic", "split", "s", "e")
    meets = lambda p, q: None not in (*p, *q) and p[1] == q[1] and p[2] != q[2] and p[0] < q[0] and p[3] <= q[4] and q[3] <= p[4]
    assert sorted(map(tuple, found.collect())) == sorted((p[0], q[0], p[1]) for p in rows for q in rows if meets(p, q))
    assert "_b" in found._jdf.queryExecution().optimizedPlan().toString().split("Join Inner", 1)[1].split("\n")[0]


def test_range_conflicts_make_only_pairs_that_they_return(spark, monkeypatch):
    """Rows of one range meet others as one list, hot blocks are dealt out, and ids in several lists or splits are as in a plain join."""
    monkeypatch.setattr(J, "RANGE_IDS", 8, raising=False)
    rng = random.Random(6)
    rows = [(i, "x" if i % 9 else "y", rng.randrange(3), s := 1 + 5 * rng.randrange(60), s + rng.randrange(7)) for i in range(6000)]
    rows += [(7, "x", (rows[7][2] + 1) % 3, 1, 300), *((6000 + i, "z", i % 2, 4, 4) for i in range(50))]
    found = J.range_conflicts(spark.createDataFrame(rows, "id long, topic string, split int, s int, e int"), "id", "topic", "split", "s", "e")
    i, t, p, s, e = (np.array(x) for x in zip(*rows, strict=True))
    meets = (t[:, None] == t) & (p[:, None] != p) & (i[:, None] < i) & (s[:, None] <= e) & (s <= e[:, None])
    a, b = np.nonzero(meets)
    got = found.toPandas().sort_values(["a", "b", "topic"], ignore_index=True)
    want = np.lexsort((t[a], i[b], i[a]))
    assert (got["a"].to_numpy() == i[a][want]).all() and (got["b"].to_numpy() == i[b][want]).all() and (got["topic"].to_numpy() == t[a][want]).all()
    plan = found._jdf.queryExecution().optimizedPlan().toString()
    assert "Generate explode" in plan.split("Join Inner", 1)[0]
