"""Benchmark decontamination by the q-gram lemma.

Texts are compared in a normal form: lower case, a run of white space as one blank. The windows of a benchmark
item are its stretches of ``width`` characters from every ``STEP``-th on, and the last one; an item that is shorter is
one window, with edits in proportion. A region of a text that holds a window with at most e edits shares at least
``width - q + 1 - q e`` q-grams with it, on diagonals that lie within 2e + 1 of each other. So, for each text:

1. q-grams that occur in the benchmark are found by a bitmap, then by search;
2. stretches with too few of them for any window are left out;
3. the rest are counted by item and overlapping diagonal band (twice 2e + 1 wide);
4. windows whose q-grams reach the bound in a band are verified by a banded alignment, which gives span and edits.

So every excerpt of ``width + STEP - 1`` characters or more is found if its edits are within the budget.

The index holds each place of the benchmark once. It is broadcast in parts of at most ``PART_CHARS`` characters, one
pass a part, so a benchmark of any size fits. Texts are read in blocks that overlap by more than a window, and hits in
slices of about ``ENTRIES`` entries. Where hits are many, long runs that repeat with a short period are cut to twice a
window first, which holds every match of the whole run.

Edge cases: null and empty texts and items have no region; an item under ``least`` characters is too short to tell a
passage and is found only where it is a whole text; repeated rows and items report each; ties of alignments go to the
leftmost end; an empty benchmark gives no rows; extra columns are dropped by ``contaminated_regions`` and kept by
``drop_contaminated``, whatever their names.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import map_arrow, own, small, spare, stash, texts
from .token_files import slices

Q, WIDTH, RATE, LEAST, STEP = 10, 80, 0.05, 40, 8
PART_CHARS, BLOCK_CHARS, ENTRIES = 2_000_000, 1 << 20, 1 << 20

#: Longest period of a run that is cut.
PERIOD = 16

REGIONS = "doc_id bigint, item_id bigint, start bigint, end bigint, windows int, edits int"

_lower: np.ndarray | None = None
_latin = b""


def lower_table() -> np.ndarray:
    """Each code point's lower case (itself where that is longer than one), white space as a blank."""
    global _lower
    if _lower is None:
        found = np.arange(0x110000, dtype=np.uint32)
        for c in range(0x110000):
            s = chr(c)
            low = s.lower()
            if s.isspace():
                found[c] = 32
            elif low != s and len(low) == 1:
                found[c] = ord(low)
        _lower = found
    return _lower


def normal(text: str) -> tuple[np.ndarray, np.ndarray]:
    """(code points of the normal form, each one's place in the text); bytes, if all are under 256."""
    try:
        x = np.frombuffer(text.encode("latin-1").translate(latin_table()), np.uint8)
    except UnicodeEncodeError:
        x = lower_table()[np.frombuffer(text.encode("utf-32-le", "surrogatepass"), np.uint32)]
    blank = x == 32
    at = np.flatnonzero(~(blank[1:] & blank[:-1])) + 1
    at = np.concatenate([np.zeros(min(1, len(x)), np.int64), at])
    return (x if len(at) == len(x) else x[at]), at


def latin_table() -> bytes:
    global _latin
    if not _latin:
        _latin = bytes(lower_table()[:256].tolist())
    return _latin


def grams(x: np.ndarray, q: int = Q) -> np.ndarray:
    """A 64-bit hash of the q-gram that starts at each place, for q up to 16; code points count by a byte each."""
    n = len(x) - q + 1
    if n <= 0:
        return np.empty(0, np.uint64)
    if x.dtype != np.uint8:
        x = (x ^ (x >> 8) ^ (x >> 16)).astype(np.uint8)
    eight = np.ndarray((len(x),), "<u8", x.tobytes() + bytes(8), strides=(1,))
    h = eight[:n] & np.uint64((1 << 8 * min(q, 8)) - 1)
    h *= np.uint64(0x9E3779B97F4A7C15)
    h ^= h >> np.uint64(29)
    if q > 8:  # the last eight bytes overlap the first
        h += eight[q - 8 : q - 8 + n] * np.uint64(0xD1342543DE82EF95)
        h ^= h >> np.uint64(32)
    h *= np.uint64(0xBF58476D1CE4E5B9)
    return h


def collapsed(x: np.ndarray, at: np.ndarray, keep: int) -> tuple[np.ndarray, np.ndarray]:
    """Without the middles of runs with a period of up to ``PERIOD``: ``keep`` characters stay at both ends, in phase."""
    for period in range(1, PERIOD + 1):
        if len(x) <= 2 * keep + period:
            break
        same = np.concatenate([[0], (x[period:] == x[:-period]).astype(np.int8), [0]])
        step = np.diff(same)
        start, end = np.flatnonzero(step == 1), np.flatnonzero(step == -1) + period
        cut = (end - start - 2 * keep) // period * period
        long = cut > 0
        if long.any():
            edge = np.zeros(len(x) + 1, np.int64)
            np.add.at(edge, start[long] + keep, 1)
            np.add.at(edge, start[long] + keep + cut[long], -1)
            stay = np.cumsum(edge[:-1]) == 0
            x, at = x[stay], at[stay]
    return x, at


@dataclass
class Windows:
    """The benchmark's items, one after another, and an index of their q-grams."""

    item: np.ndarray  # id of each item
    start: np.ndarray  # of each item in ``codes``
    size: np.ndarray  # of each item
    width: np.ndarray  # of an item's windows
    edits: np.ndarray  # that a window may have
    codes: np.ndarray
    keys: np.ndarray  # sorted distinct q-grams
    first: np.ndarray  # places of key i: first[i] to first[i + 1]
    place: np.ndarray
    bitmap: np.ndarray
    shift: np.uint64
    whole: dict[str, list[int]]  # items that are too short for windows

    @classmethod
    def build(cls, items: list[tuple[int, str]], q: int = Q, width: int = WIDTH, rate: float = RATE, least: int = LEAST) -> Windows:
        item, codes, whole = [], [], {}
        for key, text in items:
            x, _ = normal((text or "").strip())
            if len(x) >= max(least, q):
                item.append(key)
                codes.append(x.astype(np.uint32))
            elif len(x):
                whole.setdefault("".join(map(chr, x.tolist())), []).append(key)
        size = np.array([len(c) for c in codes], np.int64)
        start = np.cumsum(size) - size
        wide = np.minimum(size, width)
        edits = np.minimum((rate * wide).astype(np.int64), (wide - q) // q)
        hashes = [grams(c, q) for c in codes]
        every = np.concatenate([*hashes, np.empty(0, np.uint64)])
        places = np.concatenate([*(np.arange(len(h)) + s for h, s in zip(hashes, start, strict=True)), np.empty(0, np.int64)]).astype(np.int32)
        order = np.argsort(every, kind="stable")
        keys, first = np.unique(every[order], return_index=True)
        bits = min(26, max(20, len(keys).bit_length() + 4))
        bitmap = np.zeros(1 << bits, bool)
        bitmap[keys >> np.uint64(64 - bits)] = True
        return cls(np.array(item, np.int64), start, size, wide, edits, np.concatenate([*codes, np.empty(0, np.uint32)]), keys, np.append(first, len(every)).astype(np.int32), places[order], bitmap, np.uint64(64 - bits), whole)

    def bound(self, q: int = Q) -> np.ndarray:
        """q-grams that a region within the edit budget of a window shares at least."""
        return self.width - q + 1 - q * self.edits


def align(window: np.ndarray, region: np.ndarray) -> tuple[int, int, int]:
    """(edits, start, end) of the region's part nearest to the window; the leftmost end on ties."""
    ends = _last_row(window, region, True)
    end = int(ends.argmin())
    starts = _last_row(window[::-1], region[:end][::-1], False)
    return int(ends[end]), end - int(starts.argmin()), end


def _last_row(a: np.ndarray, b: np.ndarray, free_start: bool) -> np.ndarray:
    """Edits from the whole of a to each prefix of b (to its best suffix, if free_start)."""
    index = np.arange(len(b) + 1)
    row = np.zeros(len(b) + 1, np.int64) if free_start else index.copy()
    for i, c in enumerate(a):
        new = row + 1
        np.minimum(new[1:], row[:-1] + (b != c), out=new[1:])
        new[0] = i + 1
        row = np.minimum.accumulate(new - index) + index
    return row


def regions(text: str, w: Windows, q: int = Q) -> list[tuple[int, int, int, int, int]]:
    """``(item_id, start, end, windows, edits)``: merged regions of a text that hold benchmark windows."""
    found: set[tuple[int, int, int, int]] = set()
    if len(w.keys):
        bound = w.bound(q)
        longest, most = int(w.width.max()), int(w.edits.max())
        overlap = 2 * longest + 8 * most + q
        tail_x, tail_at = np.empty(0, np.uint8), np.empty(0, np.int64)
        for begin in range(0, len(text), BLOCK_CHARS):
            x, at = normal(text[begin : begin + BLOCK_CHARS])
            if begin:
                x, at = np.concatenate([tail_x, x]), np.concatenate([tail_at, at + begin])
            found.update(_block(x, at, w, bound, int(bound.min()), longest + most, q))
            tail_x, tail_at = x[-overlap:], at[-overlap:]
    if w.whole and 0 < len(text) <= BLOCK_CHARS:
        said = "".join(map(chr, normal(text.strip())[0].tolist())) if len(text.strip()) <= 64 * LEAST else ""
        found.update((item, 0, len(text), 0) for item in w.whole.get(said, []))
    merged: list[list[int]] = []
    for item, start, end, edits in sorted(found):
        if merged and merged[-1][0] == item and start <= merged[-1][2]:
            merged[-1][2] = max(merged[-1][2], end)
            merged[-1][3] += 1
            merged[-1][4] = max(merged[-1][4], edits)
        else:
            merged.append([item, start, end, 1, edits])
    return [tuple(m) for m in merged]


def _hits(x: np.ndarray, w: Windows, least: int, span: int, q: int) -> tuple[np.ndarray, np.ndarray]:
    """(places, keys) of benchmark q-grams with ``least - 1`` others within a region's length."""
    h = grams(x, q)
    hit = np.flatnonzero(w.bitmap[h >> w.shift])
    if len(hit) >= least:
        key = np.minimum(np.searchsorted(w.keys, h[hit]), len(w.keys) - 1)
        real = w.keys[key] == h[hit]
        hit, key = hit[real], key[real]
    if len(hit) < least:
        return np.empty(0, np.int64), np.empty(0, np.int64)
    dense = np.flatnonzero(hit[least - 1 :] - hit[: len(hit) - least + 1] < span)
    edge = np.zeros(len(hit) + 1, np.int64)
    np.add.at(edge, dense, 1)
    np.add.at(edge, dense + least, -1)
    near = np.cumsum(edge[:-1]) > 0
    return hit[near], key[near]


def _block(x: np.ndarray, at: np.ndarray, w: Windows, bound: np.ndarray, least: int, span: int, q: int) -> Iterator[tuple[int, int, int, int]]:
    hit, key = _hits(x, w, least, span, q)
    if not len(hit):
        return
    ends = np.cumsum(w.first[key + 1] - w.first[key], dtype=np.int64)
    if ends[-1] > ENTRIES:
        x, at = collapsed(x, at, span + PERIOD)
        hit, key = _hits(x, w, least, span, q)
        ends = np.cumsum(w.first[key + 1] - w.first[key], dtype=np.int64)
    a = 0
    while a < len(hit):  # slices that hold the hits of any region together
        b = int(np.searchsorted(ends, (ends[a - 1] if a else 0) + ENTRIES, side="right"))
        b = max(b, int(np.searchsorted(hit, hit[a] + 2 * span)))
        yield from _regions(x, at, w, bound, hit[a:b], key[a:b], q)
        a = len(hit) if b >= len(hit) else max(a + 1, int(np.searchsorted(hit, hit[b - 1] - span)))


def _regions(x: np.ndarray, at: np.ndarray, w: Windows, bound: np.ndarray, hit: np.ndarray, key: np.ndarray, q: int) -> Iterator[tuple[int, int, int, int]]:
    """Verified windows from some hits."""
    count = (w.first[key + 1] - w.first[key]).astype(np.int64)
    ends = np.cumsum(count)
    place = w.place[np.repeat(w.first[key] - (ends - count), count) + np.arange(ends[-1])].astype(np.int64)
    item = np.searchsorted(w.start, place, side="right") - 1
    size = 2 * w.edits + 1
    shift = len(w.codes)  # diagonals from 0 on
    band = (np.repeat(hit, count) - place + shift) // size[item]
    found = np.unique(np.concatenate([band << 32 | place, (band - 1) << 32 | place]))  # by band, then place: each place once
    band, place = found >> 32, found & 0xFFFFFFFF
    item = np.searchsorted(w.start, place, side="right") - 1
    last = np.arange(len(found)) + bound[item] - 1
    i = np.flatnonzero(last < len(found))
    j, n = last[i], w.width[item[i]] - q + 1
    i = i[(band[j] == band[i]) & (item[j] == item[i]) & (place[j] - place[i] < n)]
    if not len(i):
        return
    j, own = last[i], item[i]
    begin, end = w.start[own], w.start[own] + w.size[own] - w.width[own]  # first and last window of the item
    low, high = np.maximum(place[j] - (w.width[own] - q), begin), np.minimum(place[i], end)  # windows with all of i to j
    on = begin + -(-(low - begin) // STEP) * STEP
    wanted = [(band[i] << 32 | end)[(low <= end) & (end <= place[i])]]
    while (fits := on <= high).any():
        wanted.append((band[i] << 32 | on)[fits])
        on = on + STEP
    for b, first in ((k >> 32, k & 0xFFFFFFFF) for k in np.unique(np.concatenate(wanted)).tolist()):
        own = int(np.searchsorted(w.start, first, side="right")) - 1
        wide, e = int(w.width[own]), int(w.edits[own])
        code = w.codes[first : first + wide]
        diagonal = b * (2 * e + 1) - shift
        low = max(0, first + diagonal - e)
        region = x[low : max(0, first + diagonal + 2 * (2 * e + 1) + wide + e)]
        if len(region) >= wide and len(same := np.flatnonzero((np.lib.stride_tricks.sliding_window_view(region, wide) == code).all(axis=1))):
            edits, start, end = 0, int(same[0]), int(same[0]) + wide
        else:
            edits, start, end = align(code, region)
        if edits <= e and end > start:
            yield int(w.item[own]), int(at[low + start]), int(at[low + end - 1]) + 1, edits


def benchmark_parts(benchmark: DataFrame, part_chars: int = PART_CHARS) -> list[DataFrame]:
    """The benchmark in parts of about ``part_chars`` characters each, by a hash of the item."""
    total = benchmark.agg(F.sum(F.length("text")).alias("n")).first()["n"] or 0
    n = max(1, -(-total // part_chars))
    return [benchmark.where(F.pmod(F.xxhash64("item_id", "text"), F.lit(n)) == i) for i in range(n)]


def contaminated_regions(docs: DataFrame, benchmark: DataFrame, **options) -> DataFrame:
    """``(doc_id, item_id, start, end, windows, edits)`` of each region of a text that a benchmark item has."""
    spark = docs.sparkSession
    found = None
    for part in benchmark_parts(benchmark.select(F.col("item_id").cast("long").alias("item_id"), "text")):
        items = [(r["item_id"], r["text"]) for r in part.orderBy("item_id", "text").collect()]  # bounded by PART_CHARS
        shared = spark.sparkContext.broadcast(Windows.build(items, **options))

        def scan(batches: Iterator[pa.RecordBatch], shared=shared) -> Iterator[pa.RecordBatch]:
            for keys, words in slices(batches):
                rows = [(k, *r) for k, t in zip(keys, words, strict=True) for r in regions(t, shared.value)]
                columns = list(zip(*rows, strict=True)) if rows else [[]] * 6
                yield pa.RecordBatch.from_arrays([pa.array(c, pa.int64() if i < 4 else pa.int32()) for i, c in enumerate(columns)], names=["doc_id", "item_id", "start", "end", "windows", "edits"])

        rows = map_arrow(texts(docs), scan, REGIONS)
        found = rows if found is None else found.unionByName(rows)
    return found


def drop_contaminated(docs: DataFrame, benchmark: DataFrame, key: str = "doc_id", text: str = "text", **options) -> DataFrame:
    """``docs`` without the rows of documents that hold a benchmark region."""
    hit = spare(docs, "hit")
    found = contaminated_regions(docs.select(F.col(key).alias("doc_id"), F.col(text).alias("text")), benchmark, **options)
    ids = stash(found.select(F.col("doc_id").alias(hit)).where(F.col(hit).isNotNull()).distinct(), "contaminated")
    return docs.join(small(ids), F.col(key) == F.col(hit), "left_anti").select(*own(docs))
