"""Queries against plain versions on a small table, and cases that caps or hashes could lose."""

import collections
import hashlib
import random
import time
import wave
import zlib

import numpy as np
import pyarrow.parquet as pq
import pytest
from pyspark.sql import functions as F

import corpus_pipeline
from corpusloom.llm import bpe, decontaminate, jaccard_join, media, oracles, packing, queries, secrets, sharding, token_files, toxicity, url_filter
from tests.parity import same

from .test_llm import TEXTS, brute_components, edit_distance, plain_base, words


@pytest.fixture(scope="module")
def documents(data):
    return pq.read_table(f"{data}/documents.parquet").to_pylist()


# 1 sharding


@pytest.mark.parametrize("limit", [1 << 14, 1 << 16])
def test_small_shards_equal_sql(spark, data, limit):
    def query(spark, folder):
        docs = spark.read.parquet(f"{folder}/documents.parquet").select("doc_id", F.coalesce(F.octet_length("text").cast("long"), F.lit(0).cast("long")).alias("bytes"))
        return sharding.assign_shards(docs, limit=limit).where(F.col("shard_bytes") <= limit).select("doc_id", "shard", "depth", "bytes", "shard_bytes")

    same(spark, data, query, oracles.OP1.replace("33554432", str(limit)))


def test_deep_levels_and_pages_of_one_key(spark):
    rows = [(7, 100)] * 300 + [(7, 900), (7, 5000), (7, 600)] + [(i, 10) for i in range(100, 130)]
    got = sharding.assign_shards(spark.createDataFrame(rows, "doc_id long, bytes long"), limit=1000).collect()
    assert collections.Counter((r["doc_id"], r["bytes"]) for r in got) == collections.Counter(rows)
    held = collections.defaultdict(list)
    for r in got:
        held[r["shard"]].append(r["bytes"])
    assert all(sum(b) <= 1000 or b == [5000] for b in held.values())
    assert all(len(b) == 1 for b in held.values() if max(b) > 500)
    assert len([b for b in held.values() if b[0] == 100]) <= 34  # pages are filled to the limit less the largest row


def test_shards_keep_the_callers_columns(spark):
    df = spark.createDataFrame([(1, "ab", "mine", 5, "x")], "doc_id long, text string, shard string, bytes int, `a.b` string")
    got = sharding.shard_documents(df)
    assert got.columns == ["doc_id", "text", "shard", "bytes", "a.b", "_bytes", "_shard", "depth", "page", "shard_bytes"]
    assert got.first()["shard"] == "mine" and got.first()["_bytes"] == 2


# 2 decontamination


def test_regions_equal_a_naive_scan():
    rng = random.Random(31)
    options = {"q": 4, "width": 20, "rate": 0.1, "least": 10}
    for trial in range(40):
        letters = "abc " if trial % 3 else "ab"
        items = [(i, "".join(rng.choices(letters, k=rng.randint(10, 60)))) for i in range(4)]
        w = decontaminate.Windows.build(items, **options)
        text = "".join(rng.choices(letters, k=rng.randint(0, 40)))
        for _ in range(2):
            _, item = rng.choice(items)
            a = rng.randrange(len(item))
            part = list(item[a : a + rng.randint(5, 40)])
            for _ in range(rng.randint(0, 3)):
                if part:
                    part[rng.randrange(len(part))] = rng.choice(letters)
            text += "".join(part) + "".join(rng.choices(letters, k=rng.randint(0, 10)))
        x = "".join(map(chr, decontaminate.normal(text)[0].tolist()))
        want = set()
        for key, item in items:
            code = "".join(map(chr, decontaminate.normal(item.strip())[0].tolist()))
            if len(code) < 10:
                continue
            wide = min(20, len(code))
            e = min(int(0.1 * wide), (wide - 4) // 4)
            for at in {*range(0, len(code) - wide + 1, decontaminate.STEP), len(code) - wide}:
                window = code[at : at + wide]
                if any(edit_distance(window, x[i : i + n]) <= e for n in range(max(1, wide - e), wide + e + 1) for i in range(len(x) - n + 1)):
                    want.add(key)
        assert {r[0] for r in decontaminate.regions(text, w, q=4)} == want


def test_excerpts_from_inside_an_item_are_found():
    rng = random.Random(32)
    item = words(rng, 120)
    w = decontaminate.Windows.build([(1, item)])
    for a in range(0, 300, 7):
        part = item[a : a + decontaminate.WIDTH + decontaminate.STEP - 1]
        assert decontaminate.regions(f"{words(rng, 9)} {part} {words(rng, 9)}", w), a


def test_short_items_are_whole_texts_only():
    w = decontaminate.Windows.build([(1, "What is  a Town?"), (2, "")])
    assert decontaminate.regions(" what is a town?\n", w) == [(1, 0, 17, 1, 0)]
    assert not decontaminate.regions("so what is a town? no one knows", w) and not decontaminate.regions("", w)


@pytest.mark.parametrize("unit", ["x", "ab", "na "])
def test_runs_cost_little(unit):
    w = decontaminate.Windows.build([(1, unit * 150), (2, "other text " * 20)])
    text = unit * (100_000 // len(unit)) + " end"
    decontaminate.regions("warm", w)
    began = time.process_time()
    found = decontaminate.regions(text, w)
    assert time.process_time() - began < 2 and {r[0] for r in found} == {1}
    assert found[0][1] <= 10 and found[-1][2] >= 99_990


def test_wide_and_narrow_texts_have_equal_grams():
    text = "Größe of the smaller towns, and so on" * 3
    narrow, wide = decontaminate.normal(text)[0], decontaminate.normal(text + "漢")[0]
    assert narrow.dtype == np.uint8 and wide.dtype == np.uint32
    assert decontaminate.grams(narrow).tolist() == decontaminate.grams(wide)[: len(text) - 9].tolist()


# 3 n-gram Jaccard join


def test_one_document_with_several_texts(spark):
    rng = random.Random(33)
    base = [words(rng, 40) for _ in range(4)]
    rows = [(5, base[0]), (5, base[1]), (9, base[0]), (8, base[1]), (3, base[2]), (4, base[2] + " tail"), (3, base[3]), (11, base[3]), (20, words(rng, 30))]
    got = collections.defaultdict(set)
    for r in jaccard_join.jaccard_components(spark.createDataFrame(rows, TEXTS)).collect():
        got[r["doc_id"]].add(r["component_id"])
    assert got == {5: {5}, 9: {5}, 8: {5}, 3: {3}, 4: {3}, 11: {3}, 20: {20}}


def test_a_large_group_in_blocks(spark, monkeypatch):
    monkeypatch.setattr(jaccard_join, "GROUP_GRAMS", 6_000)
    monkeypatch.setattr(jaccard_join, "HOT_CLASS", 4)
    rng = random.Random(34)
    base = words(rng, 70).split(" ")
    rows = []
    for i in range(400):
        w = list(base)
        for _ in range(rng.choice([0, 1, 2, 3, 5])):
            w[rng.randrange(len(w))] = f"w{rng.randrange(1000)}"
        rows.append((i, " ".join(w)))
    rows += [(1000 + i, " ".join(base[:60]) + " " + words(rng, rng.choice([2, 30]))) for i in range(60)]
    rng.shuffle(rows)
    got = {r["doc_id"]: (r["n_shingles"], r["component_id"]) for r in jaccard_join.jaccard_components(spark.createDataFrame(rows, TEXTS)).collect()}
    assert got == brute_components(rows)


# 4 secrets


def test_query_of_secrets_equals_a_plain_search(spark, data, documents):
    got = {r["doc_id"]: r for r in queries.op4_secret_scans(spark, data).collect()}
    assert len(got) == len(documents)
    for row in documents:
        plain, r = plain_base(row["text"] or ""), got[row["doc_id"]]
        spans = sorted((a, k, b) for k, kind in enumerate(("assign", "access", "hex")) for a, b in plain[kind])
        told = [f"{('assign', 'access', 'hex')[k]}:{a}:{b}" for a, k, b in spans]
        assert (r["n_assign"], r["n_access"], r["n_hex"]) == tuple(len(plain[k]) for k in ("assign", "access", "hex"))
        assert r["base_sha256"] == hashlib.sha256(",".join(told).encode()).hexdigest()
        shown = r["spans"].split(",") if r["spans"] else []
        assert [s for s in shown if not s.startswith("learned:")] == told
        assert [int(s.split(":")[1]) for s in shown] == sorted(int(s.split(":")[1]) for s in shown)


def credential(rng, spec):
    prefix, alphabet, n = spec
    return prefix + "".join(rng.choices(alphabet, k=n))


def test_formats_left_out_of_training_are_found(documents):
    """Recall of each format by a network that has not seen it, on documents that it has not seen either."""
    rng = random.Random(35)
    own = [r["text"] for r in documents if r["text"]]
    train, held = own[::2], own[1::2]
    train = [t + f" token = {hashlib.sha1(str(i).encode()).hexdigest()} AKIA{hashlib.sha1(t.encode()).hexdigest()[:16].upper()}" for i, t in enumerate(train)]
    for k, spec in enumerate(secrets.FORMATS):
        x, y = secrets.labelled_findings(train, formats=[f for i, f in enumerate(secrets.FORMATS) if i != k])
        network = secrets.train(x, y, epochs=6)
        said = [" ".join(t.split()[:40]) for t in held[:60]]
        found = sum(any(f["kind"] in ("learned", "hex", "access") and f["end"] > len(s) for f in secrets.findings([f"{s} {rng.choice(secrets.LEADS)}{credential(rng, spec)} ."], network)[0]) for s in said)
        plain = sum(bool([f for f in secrets.findings([s], network)[0] if f["kind"] == "learned"]) for s in said)
        assert found >= 0.9 * len(said), spec
        assert plain <= 0.1 * len(said), spec


def test_candidates_without_digits_and_long_texts(spark):
    text = "see QxZvBnMqWeRtYuIoPlKj here, internationalization and RESPONSIBILITY"
    assert [text[a:b] for a, b in secrets.candidates(text, {})] == ["QxZvBnMqWeRtYuIoPlKj"]
    rng = random.Random(36)
    rows = [(i, words(rng, 20_000 if i == 1 else 60) + f" token = {hashlib.sha1(str(i).encode()).hexdigest()} see a1b2c3d4e5f6-{i}") for i in range(12)]
    _, _, document = secrets.training_windows(spark.createDataFrame(rows, TEXTS))
    assert set(document) == set(range(12))  # the long one too


# 5 token files


def test_ids_beyond_sixteen_bits_are_kept():
    ids, ends = np.array([1, 70_000, 5], np.uint32), np.array([2, 3])
    assert token_files.bytes_of(65_535) == 2 and token_files.bytes_of(65_536) == 4
    got, offsets, _ = token_files.read_shard(token_files.write_shard(ids, ends, token_files.bytes_of(70_000)))
    assert got.tolist() == ids.tolist() and offsets.decode().tolist() == [2, 3]
    with pytest.raises(ValueError, match="70000"):
        token_files.write_shard(ids, ends, 2)
    keys = [None, None, -(1 << 62), -5, 0, 0, 7, 1 << 62]
    assert token_files.read_keys(memoryview(token_files.code_keys(keys))) == keys
    assert token_files.read_keys(memoryview(token_files.code_keys([None]))) == [None]


def test_select_ranges_equal_all_values():
    values = np.cumsum(np.random.default_rng(1).integers(0, 900, 3000))
    code = token_files.EliasFano.encode(values)
    for a, b in ((0, 3000), (0, 0), (255, 257), (256, 256), (1000, 2999), (2999, 3000)):
        assert code.select_range(a, b).tolist() == values[a:b].tolist()


def test_words_of_one_hash_are_told_apart(monkeypatch):
    monkeypatch.setattr(bpe, "_hashes", lambda points, at, sizes: sizes.astype(np.uint64))
    coder = bpe.WordEncoder(bpe.tokenizer_path("byte_bpe_50k.json"))
    texts = ["one two six ten", "", "two one one six", "seven three eight"]
    ids, offsets = coder.encode(texts)
    for i, t in enumerate(texts):
        assert ids[offsets[i] : offsets[i + 1]].tolist() == coder.tokenizer.encode(t, add_special_tokens=False).ids


def test_new_words_cost_less_than_whole_library_calls():
    rng = random.Random(31)
    texts = [" ".join("".join(rng.choices("abcdefghilmnoprstuvé", k=rng.randint(4, 10))) for _ in range(100)) for _ in range(100)]
    path, ratios = bpe.tokenizer_path("byte_bpe_50k.json"), []
    bpe.char_classes()
    for _ in range(3):
        coder = bpe.WordEncoder(path)
        at = time.process_time()
        ids, _ = coder.encode(texts)
        cost = time.process_time() - at
        plain = bpe.WordEncoder(path).tokenizer
        at = time.process_time()
        for t in texts:
            plain.encode_batch([f" {w}" for w in t.split(" ")], add_special_tokens=False)
        ratios.append(cost / (time.process_time() - at))
    assert ids.tolist() == [i for e in plain.encode_batch(texts, add_special_tokens=False) for i in e.ids]
    assert min(ratios) < 0.85


@pytest.mark.parametrize("kind", ["as it is", "an added token", "a normalizer"])
def test_words_go_to_the_model_only_where_that_is_all(tmp_path, kind):
    from tokenizers import Tokenizer, normalizers

    whole = Tokenizer.from_file(bpe.tokenizer_path("byte_bpe_50k.json"))
    if kind == "an added token":
        whole.add_tokens(["zebra"])
    elif kind == "a normalizer":
        whole.normalizer = normalizers.Lowercase()
    whole.save(str(tmp_path / "t.json"))
    coder = bpe.WordEncoder(str(tmp_path / "t.json"))
    assert (coder.model is not None) == (kind == "as it is")
    texts = ["zebra", "A zebra's 12 漢字 😀\x00 <|endoftext|>", ""]
    ids, offsets = coder.encode(texts)
    for i, t in enumerate(texts):
        assert ids[offsets[i] : offsets[i + 1]].tolist() == coder.tokenizer.encode(t, add_special_tokens=False).ids


def test_query_of_token_files_equals_the_library(spark, data, documents):
    coder = bpe.encoder("byte_bpe_50k.json").tokenizer
    at, want = 0, set()
    for row in sorted(documents, key=lambda r: r["doc_id"]):
        ids = [*coder.encode(row["text"] or "", add_special_tokens=False).ids, 2]
        want.add((row["doc_id"], at, len(ids), packing.crc_of(ids)))
        at += len(ids)
    assert {tuple(r[c] for c in ("doc_id", "start", "n_tokens", "ids_crc32")) for r in queries.op5_token_files(spark, data).collect()} == want


# 6 toxicity


def test_query_of_toxicity_on_the_held_out_fold(spark, data, documents):
    folder = data.replace("sf0.001", "sf0.01")
    labels = {r["doc_id"]: r["toxic"] for r in pq.read_table(f"{folder}/labels.parquet").to_pylist()}
    got = {r["doc_id"]: r for r in queries.op6_toxicity(spark, folder).collect()}
    assert all(r["held_out"] == (zlib.crc32(str(k).encode()) % 5 == 0) and r["predicted"] == int(r["score"] >= 0.5) and 0 <= r["score"] <= 1 for k, r in got.items())
    held = [(got[k]["score"], y) for k, y in labels.items() if k in got and got[k]["held_out"]]
    assert np.mean([(s >= 0.5) == y for s, y in held]) >= 0.88
    bad, good = [s for s, y in held if y], [s for s, y in held if not y]
    assert np.mean([a > b for a in bad for b in good]) >= 0.85


def test_a_document_that_is_labelled_twice(spark):
    rng = random.Random(37)
    docs = spark.createDataFrame([(i, words(rng, 30) + (" vile!!" if i % 4 == 0 else "")) for i in range(300)], TEXTS)
    labels = [(i, int(i % 4 == 0)) for i in range(300)] + [(i, 0) for i in range(0, 300, 4)]
    a = toxicity.train(docs, spark.createDataFrame(labels, "doc_id long, toxic int"))
    b = toxicity.train(docs, spark.createDataFrame(labels[::-1], "doc_id long, toxic int"))
    assert np.array_equal(a.weights, b.weights) and a.score(["so vile!!"])[0] > a.score(["so mild"])[0]


# 7 packing


def test_query_of_packing_equals_a_plain_encoder(spark, data, documents):
    coder = bpe.encoder("byte_bpe_50k.json").tokenizer
    want, total = set(), 0
    got = queries.op7_best_fit_packing(spark, data).collect()
    for row in documents:
        ids = [*coder.encode(row["text"] or "", add_special_tokens=False).ids, 0]
        first = len(ids) - (-(-len(ids) // 2048) - 1) * 2048
        cuts = [0, *range(first, len(ids) + 1, 2048)]
        want |= {(row["doc_id"], i, a, b - a, packing.crc_of(ids[a:b])) for i, (a, b) in enumerate(zip(cuts, cuts[1:], strict=False))}
        total += len(ids)
    assert {tuple(r[c] for c in ("doc_id", "piece", "start", "length", "ids_crc32")) for r in got} == want
    rows = collections.defaultdict(list)
    for r in got:
        rows[r["sequence_id"]].append((r["offset"], r["length"]))
    for s in rows.values():
        s.sort()
        assert s[0][0] == 0 and all(a + n == b for (a, n), (b, _) in zip(s, s[1:], strict=False)) and sum(s[-1]) <= 2048
    assert len(rows) <= 1.01 * -(-total // 2048) + 1


def test_plans_stay_small_and_tight():
    rng = np.random.default_rng(2)
    for n in (20_000, 400_000):
        lengths = 1 + rng.exponential(500, n).astype(int) % 2048
        counts = collections.Counter(lengths.tolist())
        runs = packing.plan(dict(counts), 2048)
        held = collections.Counter()
        for r in runs:
            for s in r.lengths:
                held[s] += r.count
        assert held == counts and sum(r.count for r in runs) <= 1.002 * -(-int(lengths.sum()) // 2048) + 1
        assert len(packing.slots(runs)) < 60_000


def test_one_length_in_many_shares(spark, monkeypatch):
    monkeypatch.setattr(packing, "SHARE", 16)
    rows = [(i, 100 if i % 3 else i % 40 + 1, "a", i) for i in range(400)]
    got = packing.pack(spark.createDataFrame(rows, "doc_id long, length long, offset string, `x.y` long"), capacity=256)
    assert got.columns == ["doc_id", "length", "offset", "x.y", "sequence_id", "_offset"]
    places = collections.defaultdict(list)
    for r in got.collect():
        places[r["sequence_id"]].append((r["_offset"], r["length"]))
    assert sum(map(len, places.values())) == 400
    for s in places.values():
        s.sort()
        assert s[0][0] == 0 and all(a + n == b for (a, n), (b, _) in zip(s, s[1:], strict=False)) and sum(s[-1]) <= 256


# 9 media


def test_query_of_media_equals_a_plain_version(spark, data, documents):
    got = {r["doc_id"]: r for r in queries.op9_media_columns(spark, data).collect()}
    assert len(got) == len(documents)
    for row in documents:
        raw, r = (row["text"] or "").encode(), got[row["doc_id"]]
        payload = raw + bytes(-len(raw) % 64 or (0 if raw else 64))
        stored = media.to_wav(payload)
        assert (r["n_bytes"], r["payload_bytes"], r["media_bytes"]) == (len(raw), len(payload), len(stored))
        assert r["payload_sha256"] == hashlib.sha256(payload).hexdigest() and r["tail_crc32"] == zlib.crc32(payload[-64:]) and r["media_sha256"] == hashlib.sha256(stored).hexdigest()
        times, codes = media.fingerprint(np.frombuffer(payload, np.uint8))
        told = ",".join(map(str, times.tolist())) + "|" + ",".join(map(str, codes.tolist()))
        assert r["feature"] == f"{len(times)}:{hashlib.sha256(told.encode()).hexdigest()}"
    with wave.open(__import__("io").BytesIO(stored)) as w:
        assert w.getsampwidth() == w.getnchannels() == 1 and w.readframes(w.getnframes()) == payload


def test_last_samples_are_in_a_frame():
    for n in (64, 256, 257, 300, 384, 5000):
        x = np.full(n, 60, np.uint8)
        y = x.copy()
        y[-1] += 40
        a, b = (np.concatenate([m for _, m, _ in media.spectra(s)]) for s in (x, y))
        assert a.shape == b.shape and not np.allclose(a[-1], b[-1])


def test_last_frame_of_a_full_block_keeps_its_peaks(monkeypatch):
    rng = np.random.default_rng(3)
    x = rng.integers(0, 256, media.FRAME + 18 * media.HOP).astype(np.uint8)  # 19 frames
    whole = media.peaks(x)
    for block in (17, 7):
        monkeypatch.setattr(media, "BLOCK", block)
        assert [p.tolist() for p in media.peaks(x)] == [p.tolist() for p in whole]


# 10 url filters


def test_split_cascades_answer_as_one(spark):
    rng = random.Random(38)
    names = [f"h{i}.example.com" for i in range(900)]
    listed = sorted(rng.sample(names, 250))
    df = spark.createDataFrame([(n,) for n in [*names, *names[:50], None]], "host string")
    got = url_filter.mark_listed(df, "host", listed, max_bits=256)
    assert collections.Counter((r["host"], r["is_listed"]) for r in got.collect()) == collections.Counter((n, n in listed) for n in [*names, *names[:50], None])
    table = spark.createDataFrame([(d,) for d in [*listed, listed[0], "absent.org"]], "domain string")
    by_table = url_filter.mark_listed(df, "host", table)
    assert collections.Counter(tuple(r) for r in by_table.collect()) == collections.Counter(tuple(r) for r in got.collect())


def test_rules_of_equal_length_and_an_empty_table(spark):
    df = spark.createDataFrame([(1, "a://x.com/a", "kept")], "page_id long, url string, other string")
    rules = (("allow", "x.com", "/a"), ("block", "x.com", "/a"))
    for order, verdict in ((rules, "allow"), (rules[::-1], "block")):
        assert url_filter.filter_urls(df, rules=order).first()["verdict"] == verdict
    assert url_filter.filter_urls(df.limit(0)).count() == 0
    long = spark.createDataFrame([(1, "a://free-bets.example.com/" + "x" * 300_000)], "page_id long, url string")
    assert url_filter.filter_urls(long).first()["verdict"] == "block"


# pipeline


def test_pipeline_keeps_columns_of_any_name(spark, data):
    extra = "toxicity double, _toxicity int, gone long, hit long, _hit long, h string, window int, `a.b` string"
    rng = random.Random(39)
    rows = [(i, words(rng, 50), 0.9, i, i, i, i, "h", 1, "dot") for i in range(6)] + [(None, "no id", *[None] * 8), (7, None, *[None] * 8), (8, "", *[None] * 8)]
    docs = spark.createDataFrame(rows, f"doc_id long, text string, {extra}")
    want = {tuple(r) for r in docs.collect()}
    for name, stage in corpus_pipeline.STAGES[:-1]:
        docs = corpus_pipeline.stash(stage(spark, docs, data), name)
        assert {tuple(r) for r in docs.collect()} == want, name
    assert corpus_pipeline.STAGES[-1][1](spark, docs, data).count() == len(rows)
    none = docs.limit(0)
    for _, stage in corpus_pipeline.STAGES:
        none = stage(spark, none, data)
        assert none.count() == 0
