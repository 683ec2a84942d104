"""Best-fit packing of token pieces into sequences of a fixed capacity, by linear grouping.

Lengths are integers up to the capacity, so a histogram (one count a length) says all that the plan
needs, however large the corpus. On it the driver

1. sorts large lengths, cuts them into ``GROUPS`` groups of equal cardinality and rounds each up to its group's
   largest length;
2. builds configurations of the few rounded lengths: the longest one left, filled by an exact bounded
   subset-sum over the others, repeated while the counts allow;
3. puts the groups' actual lengths in place of the rounded ones;
4. keeps the sequences with no more than ``SLACK`` tokens of room, takes the others apart and starts again with what
   they held: fewer pieces in as many groups are rounded less;
5. gives small lengths, longest first, to the sequences with the least room that they fit in.

The plan is a list of runs (so many sequences alike) of a size that the capacity, the groups and the rounds bound.
Pieces get ranks within their length, in parallel, and look up their sequence and offset by rank.

Edge cases: null text is empty and holds its end id; repeated rows are packed one by one, and ties of length go by the
other columns; very long texts are cut into pieces; an empty table gives no piece; extra columns of documents are
dropped, those of pieces kept, whatever their names.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterator, Sequence

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import MAX_IDS, map_arrow, own, small, spare, stash, texts
from .token_files import slices

#: Groups of large lengths, room in tokens that a sequence may keep before the last round, and rounds at most.
GROUPS, SLACK, ROUNDS = 256, 2, 200

#: Pieces of one length that are ranked together, about; more where there would be over half of ``MAX_IDS`` shares.
SHARE = 1 << 12

PIECES = "doc_id bigint, piece int, start bigint, length bigint, ids binary"


def token_pieces(docs: DataFrame, capacity: int = 2048, tokenizer: str = "byte_bpe_50k.json", end_id: int = 0) -> DataFrame:
    """``(doc_id, piece, start, length, ids)``: each document's ids and end id; longer ones cut so that only the first piece is shorter. ``ids``: little-endian unsigned 32-bit."""

    def pieces(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from .bpe import encoder

        coder = encoder(tokenizer)
        for keys, words in slices(batches):
            ids, offsets = coder.encode(words)
            ids, offsets = np.insert(ids, offsets[1:], end_id), offsets + np.arange(len(offsets))
            sizes = np.diff(offsets)
            n = -(-sizes // capacity)
            doc = np.repeat(np.arange(len(keys)), n)
            piece = np.arange(len(doc)) - np.repeat(np.cumsum(n) - n, n)
            first = sizes - (n - 1) * capacity
            start = np.where(piece == 0, 0, first[doc] + (piece - 1) * capacity)
            length = np.where(piece == 0, first[doc], capacity)
            raw, at = ids.astype("<u4").tobytes(), (offsets[doc] + start) * 4
            yield pa.RecordBatch.from_arrays([pa.array([keys[d] for d in doc.tolist()], pa.int64()), pa.array(piece, pa.int32()), pa.array(start, pa.int64()), pa.array(length, pa.int64()), pa.array([raw[a : a + 4 * b] for a, b in zip(at.tolist(), length.tolist(), strict=True)], pa.binary())], names=["doc_id", "piece", "start", "length", "ids"])

    return map_arrow(texts(docs), pieces, PIECES)


class Run:
    """``count`` sequences with pieces of the same ``lengths`` and ``room`` left in each."""

    __slots__ = ("count", "lengths", "room")

    def __init__(self, count: int, lengths: tuple[int, ...], room: int):
        self.count, self.lengths, self.room = count, lengths, room


def _fill(room: int, sizes: list[int], left: dict[int, int]) -> list[int]:
    """The fullest bounded subset sum of ``sizes`` up to ``room``, as a list of sizes."""
    reached, via = 1, []
    full = (1 << (room + 1)) - 1
    for s in sizes:
        for _ in range(min(left[s], room // s)):
            wider = (reached | (reached << s)) & full
            if wider == reached:
                break
            via.append((s, reached))
            reached = wider
        if reached >> room & 1:
            break
    at, chosen = reached.bit_length() - 1, []
    for s, before in reversed(via):
        if not before >> at & 1:
            chosen.append(s)
            at -= s
    return chosen


def plan(histogram: dict[int, int], capacity: int, groups: int = GROUPS, small: float = 1 / 16, slack: int = SLACK) -> list[Run]:
    """Runs of alike sequences that hold each piece of the histogram once."""
    runs: list[Run] = []
    left = {s: n for s, n in histogram.items() if s > capacity * small}
    for turn in range(ROUNDS):
        members = _groups(left, groups)
        exact = all(len({s for s, _ in m}) == 1 for m in members.values())
        made = [r for config, times in _configurations(members, capacity) for r in _substitute(config, times, members, capacity)]
        tight = sum(r.count * len(r.lengths) for r in made if r.room <= slack)
        if exact or tight * 1000 < sum(left.values()) or turn == ROUNDS - 1:  # nothing is rounded any more, or little comes of it
            runs += made
            break
        runs += [r for r in made if r.room <= slack]
        left = {}
        for r in made:
            for s in r.lengths if r.room > slack else ():
                left[s] = left.get(s, 0) + r.count
    return _best_fit(runs, {s: n for s, n in histogram.items() if s <= capacity * small}, capacity)


def _groups(left: dict[int, int], groups: int) -> dict[int, list[list[int]]]:
    """Groups of equal cardinality, longest first: a group's largest length, and its ``[length, count]`` from long to short."""
    each = max(1, -(-sum(left.values()) // groups))
    members: dict[int, list[list[int]]] = {}
    held, top = 0, 0
    for s in sorted(left, reverse=True):
        n = left[s]
        while n:
            if not held:
                top = s
            take = min(n, each - held)
            members.setdefault(top, []).append([s, take])
            held, n = (held + take) % each, n - take
    return members


def _configurations(members: dict[int, list[list[int]]], capacity: int) -> list[tuple[list[int], int]]:
    """``(rounded lengths, times)``: the longest one left, filled by the fullest subset sum over the others, as often as the counts allow."""
    rounded = {top: sum(n for _, n in m) for top, m in members.items()}
    found, sizes = [], sorted(rounded, reverse=True)
    while sizes:
        first = sizes[0]
        rounded[first] -= 1
        config = [first, *_fill(capacity - first, [s for s in sizes if s <= capacity - first], rounded)]
        rounded[first] += 1
        times = min(rounded[s] // config.count(s) for s in set(config))
        for s in config:
            rounded[s] -= times
        sizes = [s for s in sizes if rounded[s]]
        found.append((config, times))
    return found


def _take(queue: list[list[int]], n: int) -> list[tuple[int, int]]:
    """Removes ``n`` members from the end of a group: ``(length, count)`` in order."""
    taken = []
    while n:
        length, held = queue[-1]
        count = min(held, n)
        taken.append((length, count))
        queue[-1][1] -= count
        if count == held:
            queue.pop()
        n -= count
    return taken


def _substitute(config: list[int], times: int, members: dict[int, list[list[int]]], capacity: int) -> Iterator[Run]:
    """``times`` sequences of a configuration with actual lengths: a new run wherever a slot's length changes."""
    queues = [_take(members[s], times)[::-1] for s in config]
    while times:
        count = min(q[-1][1] for q in queues)
        lengths = tuple(q[-1][0] for q in queues)
        for q in queues:
            length, held = q.pop()
            if held > count:
                q.append((length, held - count))
        yield Run(count, lengths, capacity - sum(lengths))
        times -= count


def _best_fit(runs: list[Run], small: dict[int, int], capacity: int) -> list[Run]:
    by_room: dict[int, list[Run]] = {}
    for r in runs:
        by_room.setdefault(r.room, []).append(r)
    for s in sorted(small, reverse=True):
        left = small[s]
        while left:
            room = next((x for x in range(s, capacity + 1) if by_room.get(x)), None)
            if room is None:
                each = capacity // s
                count = max(1, left // each)
                n = min(each, left)
                by_room.setdefault(capacity - n * s, []).append(Run(count, (s,) * n, capacity - n * s))
                left -= count * n
                continue
            run = by_room[room].pop()
            n = 1 if left < run.count else min(room // s, left // run.count)
            count = min(run.count, left)
            if count < run.count:
                by_room[room].append(Run(run.count - count, run.lengths, room))
            by_room.setdefault(room - n * s, []).append(Run(count, run.lengths + (s,) * n, room - n * s))
            left -= count * n
    return [r for at in sorted(by_room) for r in by_room[at]]


def slots(runs: list[Run]) -> list[tuple[int, int, int, int, int]]:
    """``(length, first rank, end rank, first sequence, offset)``: where the pieces of a length go."""
    found, used, base = [], {}, 0
    for r in runs:
        offset = 0
        for s in r.lengths:
            rank = used.get(s, 0)
            found.append((s, rank, rank + r.count, base, offset))
            used[s] = rank + r.count
            offset += s
        base += r.count
    return found


def pack(pieces: DataFrame, capacity: int = 2048, groups: int = GROUPS) -> DataFrame:
    """``pieces`` with ``sequence_id`` and ``offset``; ``length`` is from 1 to ``capacity``. Columns of these two names are kept, and the new ones get ``_`` before theirs.

    ``pieces`` is read three times; give a written table. A rank within a length comes from shares of the length of
    about ``SHARE`` pieces each, so a length that a third of all pieces have is ranked in as many tasks as it needs.
    """
    spark = pieces.sparkSession
    sizes = [(r["length"], r["n"]) for r in pieces.groupBy("length").agg(F.count("*").alias("n")).collect()]  # at most ``capacity`` rows
    if any(s is None or not 0 < s <= capacity for s, _ in sizes):
        raise ValueError("a length is beyond the capacity")
    runs = plan(dict(sizes), capacity, groups)
    each = max(SHARE, -(-sum(n for _, n in sizes) // (MAX_IDS // 2)))
    shares = spark.createDataFrame(arrow([(s, -(-n // each)) for s, n in sizes], ("length", "shares")), "length long, shares long")
    rows = pieces.select(F.struct(*own(pieces)).alias("row"), F.col("length").cast("long").alias("length"))
    rows = rows.join(F.broadcast(shares), "length").select("row", "length", F.pmod(F.xxhash64("row"), F.col("shares")).alias("share"))
    counts = rows.groupBy("length", "share").agg(F.count("*").alias("n"))  # at most capacity + MAX_IDS / 2 rows
    ahead = Window.partitionBy("length").orderBy("share").rowsBetween(Window.unboundedPreceding, 0)
    before = stash(counts.select("length", "share", (F.sum("n").over(ahead) - F.col("n")).alias("before")), "shares")
    rank = F.row_number().over(Window.partitionBy("length", "share").orderBy("row")).cast("long") - 1
    ranked = rows.withColumn("rank", rank).join(small(before), ["length", "share"]).select("row", "length", (F.col("rank") + F.col("before")).alias("at"))
    # the plan has at most ROUNDS * (2 * groups + capacity) runs of at most 16 large lengths, whatever the number of pieces
    where = spark.createDataFrame(arrow(slots(runs), ("to", "first", "last", "sequence", "offset")), "to long, first long, last long, sequence long, offset long")
    placed = ranked.join(F.broadcast(where), (F.col("length") == F.col("to")) & (F.col("at") >= F.col("first")) & (F.col("at") < F.col("last")))
    return placed.select(*[F.col("row")[c].alias(c) for c in pieces.columns], (F.col("sequence") + F.col("at") - F.col("first")).alias(spare(pieces, "sequence_id")), F.col("offset").alias(spare(pieces, "offset")))


def arrow(rows: list[tuple], names: Sequence[str]) -> pa.Table:
    columns = list(zip(*rows, strict=True)) if rows else [()] * len(names)
    return pa.table([pa.array(c, pa.int64()) for c in columns], names=list(names))


def pack_documents(docs: DataFrame, capacity: int = 2048, tokenizer: str = "byte_bpe_50k.json", end_id: int = 0) -> tuple[DataFrame, DataFrame]:
    """(placements, pieces with ids): the pieces are a written table; placements carry their crc32."""
    pieces = stash(token_pieces(docs, capacity, tokenizer, end_id), "pieces")
    meta = stash(pieces.select("doc_id", "piece", "start", "length", F.crc32("ids").alias("ids_crc32")), "piece-sizes")
    return pack(meta, capacity), pieces


def sequences(placed: DataFrame, pieces: DataFrame) -> DataFrame:
    """``(sequence_id, ids)``: the packed sequences themselves, ids joined in offset order."""
    keys = ["doc_id", "piece", "start", "length", "ids_crc32"]
    own = pieces.withColumn("ids_crc32", F.crc32("ids"))
    n = Window.partitionBy(*keys).orderBy(F.lit(1))
    left = placed.withColumn("_k", F.row_number().over(n)).withColumn("doc_id", F.coalesce("doc_id", F.lit(-(1 << 63))))
    right = own.withColumn("_k", F.row_number().over(n)).withColumn("doc_id", F.coalesce("doc_id", F.lit(-(1 << 63))))
    both = left.join(right, [*keys, "_k"])
    parts = F.sort_array(F.collect_list(F.struct("offset", F.hex("ids").alias("ids"))))
    return both.groupBy("sequence_id").agg(parts.alias("parts")).select("sequence_id", F.unhex(F.array_join(F.col("parts.ids"), "")).alias("ids"))


def crc_of(ids: list[int]) -> int:
    return zlib.crc32(np.asarray(ids, "<u4").tobytes())
