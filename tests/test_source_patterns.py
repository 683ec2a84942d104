"""All of the reference's contamination patterns, and its threshold of filler."""

from pyspark.sql import functions as F

from corpusloom.functions import gates as G
from corpusloom.plans import gate_queries, registry

BAD = ["\u00a9 2023 College Board", "AP United States History 2023", "AP\u00ae United States History 2019", "Visit College Board on the Web"]
FINE = ["the college board met in 2023", "united states history 1865", "visit the web"]


def test_three_patterns_reject(spark, monkeypatch):
    rows = spark.createDataFrame([(i, f"some text. {t} and more") for i, t in enumerate(BAD + FINE)], "doc_id long, x string")
    monkeypatch.setattr(gate_queries, "planted", lambda spark, folder: rows)
    want = {i: i < len(BAD) for i in range(len(BAD + FINE))}
    assert {r["doc_id"]: r["contaminated"] for r in registry.queries()["pattern_gates"](spark, "").collect()} == want
    assert {r["reason"]: r["n"] for r in registry.queries()["reject_counts"](spark, "").collect()}["source_text_contamination"] == len(BAD)
    gate = rows.select("doc_id", G.essay_gate(F.col("x"), F.lit("")).alias("r")).collect()
    assert {r["doc_id"]: "source_text_contamination" in r["r"] for r in gate} == want


def test_filler_is_dense_from_three_markers(spark, monkeypatch):
    texts = [" ".join(G.FILLER[:n]) for n in range(6)] + [" ".join(G.FILLER[:3]) + " word" * 360]
    rows = spark.createDataFrame(list(enumerate(texts)), "doc_id long, x string")
    monkeypatch.setattr(gate_queries, "planted", lambda spark, folder: rows)
    got = {r["doc_id"]: r["dense"] for r in registry.queries()["filler_density_three"](spark, "").collect()}
    assert got == {0: False, 1: False, 2: False, 3: True, 4: True, 5: True, 6: False}
