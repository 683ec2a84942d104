"""The pipeline's near-duplicate stage against a brute force at 5 words and 0.8."""

import random
import re
from pathlib import Path

import corpus_pipeline
from corpusloom.llm import common as common_helpers
from corpusloom.llm import jaccard_join


def shingles(text, n):
    w = re.findall(r"[^\x20\x09-\x0D]+", re.sub("[A-Z]", lambda m: m.group().lower(), text or ""))
    return {tuple(w[i : i + n]) for i in range(len(w) - n + 1)} if len(w) >= n else {tuple(w)} if w else set()


def first_of_groups(rows, n, percent):
    sets = [(k, shingles(t, n)) for k, t in rows]
    top = {k: k for k, _ in sets}

    def find(x):
        while top[x] != x:
            x = top[x]
        return x

    for i, (a, s) in enumerate(sets):
        for b, t in sets[:i]:
            if s and t and 100 * len(s & t) >= percent * len(s | t):
                x, y = find(a), find(b)
                top[max(x, y)] = min(x, y)
    return {find(k) for k in top}


def test_stage_links_five_word_shingles_from_four_fifths(spark):
    rng = random.Random(21)
    word = lambda: "".join(rng.choices("abcdefghij", k=5))
    rows = []
    for n in (5, 6, 9, 14, 20, 40, 90, 200, 400):
        base = [word() for _ in range(n)]
        rows.append(base)
        for share in (0.05, 0.15, 0.2, 0.24, 0.26, 0.3):  # a Jaccard of 0.95 to 0.77
            rows.append(base + [word() for _ in range(round(share * n))])
        for edits in (1, 2, n // 40, n // 20):
            w = list(base)
            for _ in range(edits):
                w[rng.randrange(n)] = word()
            rows.append(w)
    rng.shuffle(rows)
    rows = [(i, " ".join(w)) for i, w in enumerate(rows)]
    rows += [(len(rows), ""), (len(rows) + 1, None), (len(rows) + 2, rows[0][1].upper())]
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    kept = [r["doc_id"] for r in corpus_pipeline.drop_near_duplicates(spark, docs, "").collect()]
    want = first_of_groups(rows, 5, 80)
    assert sorted(kept) == sorted(want)
    assert want != first_of_groups(rows, 4, 85)


def test_links_between_sets_of_two_heads_are_kept(spark, monkeypatch):
    """Chains whose neighbours link: most of their links are between sets that link with different heads, or with none."""
    monkeypatch.setattr(jaccard_join, "GROUP_GRAMS", 300)
    monkeypatch.setattr(jaccard_join, "HEADS", 4)
    rng = random.Random(22)
    rows = []
    for chain in range(12):
        tail = [f"c{chain}x{i}" for i in range(100)]
        for i in range(8):  # each drops three words in front and adds three at the end
            rows.append((len(rows), " ".join(tail[3 * i : 3 * i + 60])))
    assert len(first_of_groups(rows, 4, 85)) == 12
    rng.shuffle(rows)
    got = jaccard_join.jaccard_components(spark.createDataFrame(rows, "doc_id bigint, text string"), 4, 85).collect()
    assert {r["component_id"] for r in got} == first_of_groups(rows, 4, 85)
    near = corpus_pipeline.drop_near_duplicates(spark, spark.createDataFrame(rows, "doc_id bigint, text string"), "").collect()
    assert {r["doc_id"] for r in near} == first_of_groups(rows, 5, 80)


def test_more_ids_than_a_broadcast_holds_shuffle_no_texts(spark, monkeypatch):
    """Ids come in passes; null ids, copies and documents with several texts are as with one pass."""
    rng = random.Random(23)
    word = lambda: "".join(rng.choices("abcdefghij", k=5))
    common = [word() for _ in range(40)]
    rows = [(None, "a null id " + " ".join(common))]
    for i in range(120):
        base = [word() for _ in range(20)]
        rows += [(i, " ".join(base + common)), (1000 + i, " ".join(base + common[:-2])), (2000 + i, " ".join(base))]
    rows += [rows[7], rows[8], (1, rows[50][1])]
    docs = spark.createDataFrame(rows, "doc_id bigint, text string")
    found = lambda: sorted(map(str, jaccard_join.jaccard_components(docs).collect()))
    kept = lambda: sorted(map(str, jaccard_join.keep_first(docs).collect()))
    want = found(), kept()
    monkeypatch.setattr(common_helpers, "MAX_IDS", 50)
    plans, run = [], common_helpers.map_arrow
    monkeypatch.setattr(jaccard_join, "map_arrow", lambda df, *more: (plans.append(df), run(df, *more))[1])
    assert (found(), kept()) == want
    explained = [df._jdf.queryExecution().executedPlan().toString() for df in plans if df.columns == ["k", "text"]]
    assert len(explained) > 4
    assert not [p for p in explained if "SortMergeJoin" in p or "ShuffledHashJoin" in p]


def test_groups_that_hardly_link_are_not_sent_once_a_block(spark, monkeypatch):
    """Sets that share frequent grams and few links: what is shuffled grows with the sets, not with their square, and results are those of a brute force."""
    rng = random.Random(24)
    word = lambda: "".join(rng.choices("abcdefghij", k=6))
    passages = [[word() for _ in range(24)] for _ in range(20)]
    rows = []
    for _ in range(100):
        base = [w for p in rng.sample(passages, 5) for w in p]
        rows += [(len(rows), " ".join(base)), (len(rows) + 1, " ".join([*base, word()]))]
    docs = spark.createDataFrame(rows, "doc_id bigint, text string")
    want = first_of_groups(rows, 4, 85)
    assert len(want) > 90
    monkeypatch.setattr(jaccard_join, "LONG", 8)
    monkeypatch.setattr(jaccard_join, "GROUP_GRAMS", 2_000)
    monkeypatch.setattr(jaccard_join, "INDEX_GRAMS", 3_000, raising=False)
    sent, run = [], jaccard_join._links
    monkeypatch.setattr(jaccard_join, "_links", lambda rows, percent: (sent.append(rows.count()), run(rows, percent))[1])
    assert {r["component_id"] for r in jaccard_join.jaccard_components(docs).collect()} == want
    assert sum(sent) <= 2 * len(rows), sent
    monkeypatch.setattr(jaccard_join, "MAX_BLOCKS", 1_000_000)  # by blocks, in turns
    monkeypatch.setattr(jaccard_join, "TURN_GRAMS", 200_000)
    assert {r["component_id"] for r in jaccard_join.jaccard_components(docs).collect()} == want
    assert sum(sent) > 2 * len(rows), sent


def test_tables_are_deleted_behind_their_last_reader(spark):
    """Of the written tables, those with all sets, classes and list entries are gone before the result is read."""
    rng = random.Random(25)
    word = lambda: "".join(rng.choices("abcdefghij", k=4))
    common = [word() for _ in range(30)]
    docs = spark.createDataFrame([(i, " ".join([*(word() for _ in range(30)), *common])) for i in range(80)], "doc_id bigint, text string")
    shared = common_helpers.shared_folder(spark).removeprefix("file:")
    there = lambda: {p.name for p in Path(shared, "corpusloom").iterdir()} if Path(shared, "corpusloom").exists() else set()
    before = there()
    found = jaccard_join.jaccard_components(docs)
    left = {name.split("-")[0] for name in there() - before}
    assert not left & {"sets", "classes", "counts", "touched", "moved", "lists", "candidates"}, left
    assert found.count() == 80
    assert spark.conf.get(common_helpers.CLEANUP, None) in (None, "false")
