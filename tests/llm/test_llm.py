import collections
import hashlib
import random
import re
import zlib

import numpy as np
import pytest
from pyspark.sql import functions as F

from corpusloom.llm import bpe, chat, components, decontaminate, jaccard_join, media, oracles, packing, queries, secrets, sharding, token_files, toxicity, url_filter
from tests.parity import same

TEXTS = "doc_id long, text string"
EDGES = [(1, ""), (2, None), (3, "  \n"), (4, "one"), (4, "one"), (None, "a null id"), (5, "x" * 300_000), (6, "Ünï çödé \U0001f600 \u0000 end"), (7, "A b c d e f")]


@pytest.fixture(scope="module")
def edges(spark):
    return spark.createDataFrame([(k, t, "clash") for k, t in EDGES], TEXTS + ", shard string")


@pytest.fixture(scope="module")
def empty(spark):
    return spark.createDataFrame([], TEXTS)


@pytest.mark.parametrize("name", sorted(oracles.oracle_sql()))
def test_query_equals_sql(spark, data, name):
    same(spark, data, queries.queries()[name], oracles.oracle_sql()[name])


# 1 sharding


def shards(spark, rows, limit):
    got = sharding.assign_shards(spark.createDataFrame(rows, "doc_id long, bytes long"), limit=limit).collect()
    assert len(got) == len(rows)
    total = collections.Counter()
    for r in got:
        total[r["shard"]] += r["bytes"]
    return got, total


def test_shards_split_only_what_is_too_large(spark):
    rng = random.Random(1)
    rows = [(i, rng.randint(0, 900)) for i in range(600)]
    got, total = shards(spark, rows, 9000)
    assert all(n <= 9000 for n in total.values())
    assert all(r["shard_bytes"] == total[r["shard"]] for r in got)
    h = {i: int(hashlib.md5(str(i).encode()).hexdigest()[:8], 16) for i, _ in rows}
    for r in got:  # one bit less would be too large
        if r["depth"]:
            assert sum(b for i, b in rows if h[i] >> (33 - r["depth"]) == h[r["doc_id"]] >> (33 - r["depth"])) > 9000
            assert r["shard"] == format(h[r["doc_id"]], "032b")[: r["depth"]]


def test_one_key_beyond_the_limit_is_paged(spark):
    got, total = shards(spark, [(7, 100)] * 500 + [(8, 5000), (9, 10)], 1000)
    assert all(n <= 1000 for s, n in total.items() if n != 5000)
    assert len({r["shard"] for r in got if r["doc_id"] == 7}) <= 60


def test_shards_of_edge_rows(edges, empty):
    assert sharding.shard_documents(edges).count() == len(EDGES)
    assert sharding.shard_documents(empty).count() == 0


# 2 decontamination


def edit_distance(a, b):
    row = list(range(len(b) + 1))
    for i, x in enumerate(a):
        new = [i + 1]
        for j, y in enumerate(b):
            new.append(min(row[j] + (x != y), row[j + 1] + 1, new[-1] + 1))
        row = new
    return row[-1]


def test_align_equals_brute_force():
    rng = random.Random(2)
    for _ in range(60):
        a = [rng.randint(0, 3) for _ in range(rng.randint(1, 10))]
        b = [rng.randint(0, 3) for _ in range(rng.randint(1, 16))]
        edits, start, end = decontaminate.align(np.array(a), np.array(b))
        best = min(edit_distance(a, b[i:j]) for i in range(len(b) + 1) for j in range(i, len(b) + 1))
        assert edits == best == edit_distance(a, b[start:end])


def words(rng, n):
    return " ".join("".join(rng.choice("abcdefghij") for _ in range(rng.randint(2, 7))) for _ in range(n))


def test_regions_are_found_with_edits_and_not_elsewhere():
    rng = random.Random(4)
    items = [(i, words(rng, 40)) for i in range(12)]
    w = decontaminate.Windows.build(items)
    for trial in range(40):
        key, item = rng.choice(items)
        chars = list(item.upper() if trial % 2 else item)
        for _ in range(trial % 5):  # edits all over the item, within the budget of a window
            chars[rng.randrange(len(chars))] = rng.choice("xyz")
        planted = words(rng, rng.randint(0, 80)) + "\n\t " + "".join(chars).replace(" ", "  ") + " " + words(rng, 50)
        assert {r[0] for r in decontaminate.regions(planted, w)} == {key}
        assert decontaminate.regions(words(rng, 150), w) == []


def test_regions_across_blocks(monkeypatch):
    rng = random.Random(6)
    items = [(1, words(rng, 40))]
    monkeypatch.setattr(decontaminate, "BLOCK_CHARS", 300)
    w = decontaminate.Windows.build(items)
    text = words(rng, 90) + " " + items[0][1] + " " + words(rng, 90)
    (r,) = decontaminate.regions(text, w)
    assert text[r[1] : r[2]].strip() == items[0][1]


def test_regions_of_edge_rows(spark, edges, empty):
    bench = spark.createDataFrame([(1, "x" * 200), (2, ""), (3, None), (4, "short")], "item_id long, text string")
    got = decontaminate.contaminated_regions(edges, bench).collect()
    assert {(r["doc_id"], r["item_id"]) for r in got} == {(5, 1)}
    assert decontaminate.contaminated_regions(empty, bench).count() == 0
    assert decontaminate.contaminated_regions(edges, bench.limit(0)).count() == 0
    assert decontaminate.drop_contaminated(edges, bench).count() == len(EDGES) - 1


# 3 n-gram Jaccard join


def gram_set(text):
    w = re.findall(r"[^\x20\x09-\x0D]+", re.sub("[A-Z]", lambda m: m.group().lower(), text or ""))
    return {tuple(w[i : i + 4]) for i in range(len(w) - 3)} if len(w) >= 4 else {tuple(w)} if w else set()


def brute_components(rows):
    sets = [(k, gram_set(t)) for k, t in rows if k is not None]
    top = {k: k for k, _ in sets}

    def find(x):
        while top[x] != x:
            x = top[x]
        return x

    for i, (a, s) in enumerate(sets):
        for b, t in sets[:i]:
            if s and t and 100 * len(s & t) >= 85 * len(s | t):
                x, y = find(a), find(b)
                top[max(x, y)] = min(x, y)
    return {k: (len(s), find(k)) for k, s in sets}


@pytest.mark.parametrize("grams", [400_000, 3_000])
def test_components_equal_brute_force(spark, monkeypatch, grams):
    monkeypatch.setattr(jaccard_join, "GROUP_GRAMS", grams)
    rng = random.Random(8)
    vocabulary = ["".join(rng.choice("abcdefg") for _ in range(3)) for _ in range(2000)]
    rows = []

    def add(base, edits):
        w = list(base)
        for _ in range(edits):
            w[rng.randrange(len(w))] = rng.choice(vocabulary)
        rows.append((len(rows), " ".join(w)))

    base = rng.choices(vocabulary, k=140)
    for _ in range(70):
        add(base, rng.randint(0, 7))
    for n in range(1, 15):
        for e in (0, 0, 1):
            add(vocabulary[:n], e)
    passage = rng.choices(vocabulary, k=60)
    for _ in range(50):
        add(rng.choices(vocabulary, k=rng.randint(3, 60)) + passage, 0)
    for _ in range(15):
        b = rng.choices(vocabulary, k=rng.randint(5, 300))
        for _ in range(3):
            add(b, rng.randint(0, max(1, len(b) // 20)))
    rows += [(len(rows) + i, t) for i, t in enumerate(["", None, " \n", rows[3][1]])]
    got = {r["doc_id"]: (r["n_shingles"], r["component_id"]) for r in jaccard_join.jaccard_components(spark.createDataFrame(rows, TEXTS)).collect()}
    assert got == brute_components(rows)


def test_components_of_edge_rows(edges, empty):
    got = jaccard_join.jaccard_components(edges.select("doc_id", "text"))
    assert got.count() == len(EDGES)
    assert {r["component_id"] for r in got.collect() if r["doc_id"] == 4} == {4}
    assert jaccard_join.jaccard_components(empty).count() == 0


def test_subsets_prove_links():
    for a in range(1, 15):
        for b in range(a, 15):
            need = jaccard_join.pair_overlap(a, b)
            if 100 * a >= 85 * b:
                assert need in jaccard_join.subset_sizes(a) and need in jaccard_join.subset_sizes(b)
            assert all((100 * o >= 85 * (a + b - o)) == (o >= need) for o in range(a + 1))


def test_connected_components(spark):
    rng = random.Random(9)
    pairs = [(i, i + 1) for i in range(60)] + [(rng.randint(100, 160), rng.randint(100, 160)) for _ in range(45)] + [(7, 7)]
    top = {x: x for p in pairs for x in p}
    for _ in top:
        for a, b in pairs:
            top[a] = top[b] = min(top[a], top[b])
    got = {r["node"]: r["component"] for r in components.components(spark.createDataFrame(pairs, "u long, v long")).collect()}
    assert got == {x: c for x, c in top.items() if x in got} and {x for p in pairs for x in p if p[0] != p[1]} == set(got)


# 4 secrets


def plain_base(text):
    a = [m.span() for m in re.finditer(r"""(password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", text, re.I | re.A) if len(m[2]) >= 6]
    b = [m.span() for m in re.finditer(r"AKIA[A-Z0-9]+", text) if len(m[0]) >= 20]
    c = [m.span() for m in re.finditer(r"[0-9a-f]+", text) if len(m[0]) >= 24]
    return {"assign": a, "access": b, "hex": c}


def test_base_spans_equal_plain_search():
    rng = random.Random(10)
    parts = ["password", "PASSWD", "secret", "token", "api_key", "apikey", "=", ":", " ", '"', "'", "AKIA", "ABCD1234EFGH5678", "abc", "0123456789abcdef", "f" * 24, "ſecret", "\n", "é", "x=y"]
    for _ in range(3000):
        text = "".join(rng.choices(parts, k=rng.randint(0, 14)))
        assert secrets.base_spans(text) == plain_base(text)


def training_texts(rng, n):
    return [words(rng, 60) + " token = " + hashlib.sha1(str(i).encode()).hexdigest() + " " + words(rng, 30) + f" mail{i}.example.com {rng.randint(10**15, 10**16)}" for i in range(n)]


def test_network_finds_what_the_patterns_miss():
    rng = random.Random(11)
    x, y = secrets.labelled_findings(training_texts(rng, 250))
    net = secrets.train(x, y, epochs=8)
    x2, y2 = secrets.labelled_findings(training_texts(rng, 80), seed=99)
    found = net.probability(x2) >= net.threshold
    assert found[y2 > 0].mean() > 0.95 and found[y2 == 0].mean() < 0.02
    text = f"see Authorization: Bearer ghp_{hashlib.sha1(b'z').hexdigest()[:36].upper()} and {words(rng, 20)}"
    assert "[REDACTED]" in secrets.redact(text, net) and secrets.redact("plain words only", net) == "plain words only"


def test_scan_of_edge_rows(edges, empty):
    got = secrets.scan(edges, None).collect()
    assert len(got) == len(EDGES) and all(not r["findings"] for r in got)
    assert secrets.scan(empty, None).count() == 0
    assert secrets.train_on(empty) is None
    assert secrets.redact_documents(edges, None).columns == edges.columns
    assert secrets.redact("secret=abcdef012345678901234567 x", None) == "[REDACTED] x"


# 5 token files


@pytest.mark.parametrize("values", [[], [0], [5], [0, 0, 0, 7], list(range(1000)), [3] * 700 + [10**9]])
def test_elias_fano_round_trip(values):
    code = token_files.EliasFano.from_bytes(memoryview(token_files.EliasFano.encode(np.array(values, np.int64)).to_bytes()))
    assert code.decode().tolist() == values
    assert [code.select(i) for i in range(len(values))] == values
    with pytest.raises(IndexError):
        code.select(len(values))


def test_elias_fano_is_small():
    ends = np.cumsum(np.random.default_rng(0).integers(1, 1000, 20_000))
    assert len(token_files.EliasFano.encode(ends).to_bytes()) * 8 < 20_000 * (2.5 + np.log2(ends[-1] / 20_000))


def test_words_encode_as_the_library_does():
    rng = random.Random(12)
    marks = [*"ab'’stmdrevl  \n\t .!?1２Ⅳéß漢😀\u00a0\u2003\u0085\x1c\x00", "'ll", "'ve", "<|endoftext|>"]
    texts = ["".join(rng.choices(marks, k=rng.randint(0, 30))) for _ in range(4000)]
    coder = bpe.encoder("byte_bpe_50k.json")
    ids, offsets = coder.encode(texts)
    for i, e in enumerate(coder.tokenizer.encode_batch(texts, add_special_tokens=False)):
        assert ids[offsets[i] : offsets[i + 1]].tolist() == e.ids


def test_long_texts_are_cut_between_words(monkeypatch):
    monkeypatch.setattr(bpe, "PASS_CHARS", 50)
    coder = bpe.WordEncoder(bpe.tokenizer_path("byte_bpe_50k.json"), max_words=40)
    text = words(random.Random(13), 200) + "  \n x" + "y" * 120
    assert "".join(bpe.split_long(text, 50)) == text
    ids, _ = coder.encode([text, ""])
    assert ids.tolist() == coder.tokenizer.encode(text, add_special_tokens=False).ids


def test_token_files_round_trip(spark, edges, empty):
    coder = bpe.encoder("byte_bpe_50k.json")
    got = token_files.read_documents(token_files.write_corpus(edges, end_id=2, chunk_ids=20)).collect()
    assert len(got) == len(EDGES)
    assert sorted(r["start"] for r in got) == np.cumsum([0, *[r["n_tokens"] for r in sorted(got, key=lambda r: (r["start"], r["n_tokens"]))][:-1]]).tolist()
    crc = {(k, zlib.crc32(np.array([*coder.tokenizer.encode(t or "", add_special_tokens=False).ids, 2], "<u4").tobytes())) for k, t in EDGES}
    assert {(r["doc_id"], r["ids_crc32"]) for r in got} == crc
    ordered = [r["doc_id"] if r["doc_id"] is not None else -1 for r in sorted(got, key=lambda r: r["start"])]
    assert ordered == sorted(ordered)
    assert token_files.read_documents(token_files.write_corpus(empty)).count() == 0


# 6 toxicity


def test_classifier_on_held_out_texts():
    rng = random.Random(14)
    bad = ["vile", "wretched", "loathsome"]
    make = lambda y: words(rng, rng.randint(20, 200)) + (" " + rng.choice(bad).upper() + "!! " if y else " ") + words(rng, 30)
    labels = [int(rng.random() < 0.2) for _ in range(1200)]
    texts = [make(y) for y in labels]
    model = toxicity.fit(texts[:900], np.array(labels[:900]))
    p = model.score(texts[900:])
    assert ((p >= 0.5) == np.array(labels[900:])).mean() > 0.97
    assert ((0 <= p) & (p <= 1)).all()


def test_toxicity_of_edge_rows(spark, edges, empty):
    none = spark.createDataFrame([], "doc_id long, toxic int")
    model = toxicity.train(edges, none)
    got = toxicity.score(edges, model)
    assert got.count() == len(EDGES) and got.columns == [*edges.columns, "toxicity"]
    assert toxicity.score(empty, model).count() == 0
    assert all(0 <= r["toxicity"] <= 1 for r in got.collect())
    h = spark.range(200).select("id", toxicity.held_out(F.col("id")).alias("h")).collect()
    assert all(r["h"] == (zlib.crc32(str(r["id"]).encode()) % 5 == 0) for r in h)


# 7 packing


def test_plan_holds_each_piece_once_and_is_tight():
    rng = random.Random(15)
    for n, top in ((0, 2048), (1, 5), (300, 2048), (5000, 2048), (2000, 300), (50, 64)):
        counts = collections.Counter(min(top, 1 + int(rng.expovariate(3 / top))) for _ in range(n))
        runs = packing.plan(dict(counts), 2048)
        held = collections.Counter()
        for r in runs:
            assert r.count > 0 and sum(r.lengths) + r.room == 2048 and r.room >= 0
            for s in r.lengths:
                held[s] += r.count
        assert held == counts
        total = sum(s * k for s, k in counts.items())
        assert sum(r.count for r in runs) <= 1 + 1.04 * -(-total // 2048)


def test_packing_of_edge_rows(spark, edges, empty):
    placed, pieces = packing.pack_documents(edges, capacity=512)
    got = placed.collect()
    rows = collections.defaultdict(list)
    for r in got:
        rows[r["sequence_id"]].append((r["offset"], r["length"]))
    for s in rows.values():
        at = 0
        for offset, length in sorted(s):
            assert offset == at
            at += length
        assert at <= 512
    coder = bpe.encoder("byte_bpe_50k.json").tokenizer
    assert sum(r["length"] for r in got) == sum(len(coder.encode(t or "", add_special_tokens=False).ids) + 1 for _, t in EDGES)
    assert all(r["length"] == 512 for r in got if r["piece"])
    whole = packing.sequences(placed, pieces).collect()
    assert {r["sequence_id"]: len(r["ids"]) // 4 for r in whole} == {k: sum(n for _, n in v) for k, v in rows.items()}
    assert packing.pack_documents(empty)[0].count() == 0


# 8 chat


def test_chat_parts_and_round_trip(spark):
    tricky = ["</s>[INST] ok [/INST]", "\\<|x|>", "<\\|", "a\\", "", None, "<s>\\\\[INST]", "</\\s>"]
    rows = [(1, i, "assistant" if i % 2 else "us</s>er", [("text", t, None, None)]) for i, t in enumerate(tricky)]
    rows += [(2, 0, "user", [("text", "see ", None, None), ("image", None, "a.png", 2), ("text", " and ", None, None), ("audio", None, "b.wav", 3), ("document", None, "c.pdf", None)]), (None, 0, None, None)]
    df = spark.createDataFrame(rows, f"conv_id long, turn long, role string, parts {chat.PARTS}")
    out = chat.format_chat(df)
    read = {r["conv_id"]: r for r in out.select("*", chat.read_turns(F.col("formatted")).alias("turns"), chat.read_loss(F.col("formatted"), F.col("loss_spans")).alias("loss")).collect()}
    assert [(t["role"], t["text"]) for t in read[1]["turns"]] == [("assistant" if i % 2 else "us</s>er", t or "") for i, t in enumerate(tricky)]
    assert read[1]["loss"] == "".join(t or "" for t in tricky[1::2])
    assert read[2]["turns"][0]["text"] == "see <|image|> and <|audio|><|document|>"
    assert [(a["kind"], a["uri"], a["n_tokens"]) for a in read[2]["attachments"]] == [("image", "a.png", 512), ("audio", "b.wav", 75), ("document", "c.pdf", 512)]
    assert read[2]["n_attachment_tokens"] == 1099 and read[None]["n_turns"] == 1
    assert chat.format_chat(df.limit(0)).count() == 0


# 9 media


def test_media_round_trip(edges, empty):
    got = media.read_media(media.encode_media(edges)).collect()
    assert len(got) == len(EDGES)
    want = collections.Counter((k, media.padded((t or "").encode())) for k, t in EDGES)
    assert collections.Counter((r["doc_id"], bytes(r["payload"])) for r in got) == want
    by = {}
    for r in got:
        assert len(r["fp_times"]) == len(r["fp_codes"]) and r["fp_times"] == sorted(r["fp_times"])
        assert by.setdefault(bytes(r["payload"]), r["fp_codes"]) == r["fp_codes"]
    assert media.read_media(media.encode_media(empty)).count() == 0


def test_peaks_do_not_depend_on_blocks(monkeypatch):
    x = np.frombuffer(words(random.Random(16), 3000).encode(), np.uint8)
    whole = media.peaks(x)
    monkeypatch.setattr(media, "BLOCK", 17)
    parts = media.peaks(x)
    assert [a.tolist() for a in whole] == [a.tolist() for a in parts]


# 10 url filters


def test_cascade_is_exact(spark):
    rng = random.Random(17)
    keys = [(f"h{i}.example.com", rng.random() < 0.3) for i in range(3000)]
    df = spark.createDataFrame(keys, "key string, listed boolean")
    cascade = url_filter.build_cascade(df)
    got = {r["key"]: r["in"] for r in df.select("key", cascade.contains(F.col("key")).alias("in")).collect()}
    assert got == dict(keys) and len(cascade.levels) > 1
    assert cascade.size_bits < 12 * 3000
    for share in (True, False):
        c = url_filter.build_cascade(df.select("key", F.lit(share).alias("listed")))
        assert df.where(c.contains(F.col("key")) != share).count() == 0
    assert url_filter.build_cascade(df, max_bits=64) is None
    assert url_filter.build_cascade(df.limit(0)).levels == []


def test_urls_of_edge_rows(spark):
    urls = [None, "", "no scheme", "http://", "HTTP://A.Example.NET/en/x?y#z", "x://example.net?/en/", "https://free-bets.example.com", "a://org/fr/", "a://b.net//c://d", "http://m.ads-track.example.org:80/", "http://xexample.com/de/", "a://example.com/de/\nq"]
    df = spark.createDataFrame([(i, u, "h") for i, u in enumerate([*urls, urls[6]])], "page_id long, url string, host string")
    got = {r["page_id"]: (r["host"], r["path"], r["rule"], r["verdict"]) for r in url_filter.filter_urls(df).collect()}
    assert got[0] == got[1] == got[2] == ("", "", None, "allow")
    assert got[4] == ("a.example.net", "/en/x", "example.net/en/", "allow")
    assert got[5] == ("example.net", "", None, "allow")
    assert got[6] == got[12] == ("free-bets.example.com", "", None, "block")
    assert got[7] == ("org", "/fr/", "org/fr/", "allow")
    assert got[8] == ("b.net", "//c://d", "net/", "block")
    assert got[10][2] is None and got[11][2] == "example.com/de/"
    fallback = url_filter.filter_urls(df, max_bits=1)
    assert {r["page_id"]: r["verdict"] for r in fallback.collect()} == {k: v[3] for k, v in got.items()}


# pipeline


def test_pipeline_stages(spark, data):
    import corpus_pipeline

    docs = spark.read.parquet(f"{data}/documents.parquet")
    before = {r["doc_id"]: r["text"] for r in docs.collect()}
    kept = docs
    for name, stage in corpus_pipeline.STAGES[:-1]:
        last, kept = kept, corpus_pipeline.stash(stage(spark, kept, data), name)
        assert kept.columns == docs.columns
        ids = {r["doc_id"] for r in kept.collect()}
        assert ids <= {r["doc_id"] for r in last.collect()}
        if name == "near_duplicates":
            own = [(r["doc_id"], r["text"]) for r in last.collect()]
            assert ids == {c for _, c in brute_components(own).values()}
    changed = [r for r in kept.collect() if r["text"] != before[r["doc_id"]]]
    assert all("[REDACTED]" in r["text"] for r in changed)
    assert not any(plain_base(r["text"])["hex"] for r in kept.collect())
    packed = corpus_pipeline.STAGES[-1][1](spark, kept, data)
    assert {r["doc_id"] for r in packed.collect()} == {r["doc_id"] for r in kept.collect()}
