"""URL filters: host/path rules and a Bloom filter cascade, in DataFrame expressions only.

A cascade answers membership of listed keys exactly for every key of a known universe. Level 0
encodes the listed keys; level 1 encodes the other keys that level 0 wrongly accepts; level 2 the
listed keys that level 1 wrongly accepts, and so on until a level accepts nothing wrongly. A key's
answer is the parity of the first level that rejects it. No join takes part in a lookup.

Edge cases: a null url or one without ``://`` has empty host and path, fits no rule and is allowed;
repeated rows are judged alike; of rules of equal length the first given wins; an empty table or list gives a cascade
without levels; very long urls are read whole; extra columns are kept but for those with names of results, which are
replaced.
"""

from __future__ import annotations

import math
from collections.abc import Sequence
from dataclasses import dataclass, field

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import stash

UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"

#: (verdict, host, path); the longest fitting rule wins.
RULES = (("block", "net", "/"), ("allow", "example.net", "/en/"), ("block", "example.com", "/de/"), ("allow", "org", "/fr/"))

#: Listed domains; their subdomains are listed too.
LISTED = tuple(f"{name}.example.{tld}" for name in ("ads-track", "adult-x", "casino-win", "cheap-pills", "free-bets", "spam-farm") for tld in ("com", "net", "org"))

#: Bits that one level may hold as a literal (512 KB); larger cascades are split.
MAX_LEVEL_BITS = 1 << 22

#: Parts of a split cascade that one pass over the rows looks up (8 MB of literals a level).
PASS_PARTS = 16


def host_of(url: Column) -> Column:
    """Text after the first ``://`` up to ``/``, ``?``, ``#`` or the end, A-Z lower-cased; else empty."""
    return F.translate(F.regexp_extract(_rest(url), "^[^/?#]*", 0), UPPER, LOWER)


def path_of(url: Column) -> Column:
    """What follows the host, up to ``?``, ``#`` or the end."""
    return F.regexp_extract(_rest(url), "^[^/?#]*([^?#]*)", 1)


def _rest(url: Column) -> Column:
    at = F.instr(url, "://")
    return F.when(at > 0, F.substring(url, at + 3, F.length(url))).otherwise(F.lit(""))


def rule_of(host: Column, path: Column, rules: Sequence[tuple[str, str, str]] = RULES) -> tuple[Column, Column]:
    """(rule text, its verdict) of the longest rule that fits, the first given of equally long ones; nulls where none does."""
    name, verdict = F.lit(None).cast("string"), F.lit(None).cast("string")
    for what, h, p in sorted(reversed(list(rules)), key=lambda r: len(r[1]) + len(r[2])):
        fits = ((host == h) | host.endswith(f".{h}")) & path.startswith(p)
        name, verdict = F.when(fits, F.lit(h + p)).otherwise(name), F.when(fits, F.lit(what)).otherwise(verdict)
    return name, verdict


@dataclass
class Cascade:
    """Levels of (bits, hashes, words)."""

    levels: list[tuple[int, int, list[int]]] = field(default_factory=list)

    def contains(self, key: Column) -> Column:
        """True iff ``key``, a member of the universe, is listed."""
        answer = F.lit(bool(self.levels) and len(self.levels) % 2 == 1)
        for depth in range(len(self.levels) - 1, -1, -1):
            answer = F.when(self.accepts(depth, key), answer).otherwise(F.lit(depth % 2 == 1))
        return F.coalesce(answer, F.lit(False))

    def accepts(self, depth: int, key: Column) -> Column:
        bits, hashes, words = self.levels[depth]
        held = F.split(F.lit(",".join(map(str, words))), ",").cast("array<bigint>")  # folded to one literal
        hit = F.lit(True)
        for at in _positions(key, depth, bits, hashes):
            word = F.get(held, F.shiftright(at, 6).cast("int"))
            hit = hit & (word.bitwiseAND(F.call_function("shiftleft", F.lit(1).cast("long"), F.pmod(at, F.lit(64)).cast("int"))) != 0)
        return F.coalesce(hit, F.lit(False))

    @property
    def size_bits(self) -> int:
        return sum(bits for bits, _, _ in self.levels)


def _positions(key: Column, depth: int, bits: int, hashes: int) -> list[Column]:
    return [F.pmod(F.xxhash64(F.lit(depth * 64 + i), key), F.lit(bits).cast("long")) for i in range(hashes)]


def build_cascade(universe: DataFrame, max_bits: int = MAX_LEVEL_BITS, max_levels: int = 64) -> Cascade | None:
    """``universe``: ``(key, listed boolean)``, one row a key. None if a level would pass ``max_bits``.

    Only filter words reach the driver: about 1.44 log2(1/p) bits for each encoded key, checked first.
    """
    keys = stash(universe.where(F.col("key").isNotNull()).select("key", F.coalesce("listed", F.lit(False)).alias("listed")), "universe")
    n = {r["listed"]: r["n"] for r in keys.groupBy("listed").agg(F.count("*").alias("n")).collect()}
    cascade = Cascade()
    inside, outside = keys.where("listed"), keys.where("not listed")
    size, rate = n.get(True, 0), min(0.5, max(1e-6, n.get(True, 0) * math.sqrt(0.5) / max(1, n.get(False, 0))))
    while size:
        hashes = max(1, round(math.log2(1 / rate)))
        bits = max(64, math.ceil(size * hashes / math.log(2) / 64) * 64)
        if bits > max_bits:
            return None
        if len(cascade.levels) == max_levels:
            raise RuntimeError("two different keys share all their hashes")
        depth = len(cascade.levels)
        at = inside.select(F.explode(F.array(*_positions(F.col("key"), depth, bits, hashes))).alias("at"))
        set_bits = at.groupBy(F.shiftright("at", 6).alias("word")).agg(F.bit_or(F.call_function("shiftleft", F.lit(1).cast("long"), F.pmod("at", F.lit(64)).cast("int"))).alias("bits"))
        words = [0] * (bits // 64)
        for row in set_bits.collect():
            words[row["word"]] = row["bits"]
        cascade.levels.append((bits, hashes, words))
        wrongly = outside.where(cascade.accepts(depth, F.col("key")))
        inside, outside = wrongly, inside
        size, rate = wrongly.count(), 0.5
    return cascade


def above(host: Column) -> Column:
    """A host and the domains above it."""
    labels = F.split(host, "\\.")
    return F.transform(F.sequence(F.lit(1), F.size(labels)), lambda i: F.array_join(F.slice(labels, i, F.size(labels)), "."))


def key_universe(hosts: DataFrame, domains: Sequence[str] | DataFrame) -> DataFrame:
    """``(key, listed)`` of each distinct host; a table of domains, ``(domain)``, is met by a join, here and never in a lookup."""
    if isinstance(domains, DataFrame):
        each = hosts.select("key", F.explode(above(F.col("key"))).alias("domain"))
        on = each.join(domains.select("domain").distinct(), "domain", "left_semi").select("key").distinct().withColumn("listed", F.lit(True))
        return hosts.join(on, "key", "left").withColumn("listed", F.coalesce("listed", F.lit(False)))
    return hosts.withColumn("listed", F.arrays_overlap(above(F.col("key")), F.array(*[F.lit(d) for d in domains]).cast("array<string>")))


def mark_listed(df: DataFrame, host: str, domains: Sequence[str] | DataFrame = LISTED, max_bits: int = MAX_LEVEL_BITS, into: str = "is_listed") -> DataFrame:
    """Adds boolean ``into``. The universe is every distinct host of ``df``, so the answer is exact.

    A cascade with a level beyond ``max_bits`` is split by a prefix of the keys' hashes into parts that hold less, and a
    key asks the cascade of its part. ``PASS_PARTS`` parts are built and looked up in one pass over ``df``, whose rows are
    written, so the driver holds one pass's words at a time.
    """
    universe = stash(key_universe(df.select(F.col(host).alias("key")).where(F.col(host).isNotNull()).distinct(), domains), "hosts")
    limit, parts = max(64, max_bits), 1
    cascade = build_cascade(universe, limit)
    if cascade is not None:
        return df.withColumn(into, cascade.contains(F.col(host)))
    while True:
        parts *= 2
        found = _by_parts(df, host, universe, parts, limit, into)
        if found is not None:
            return found


def _by_parts(df: DataFrame, host: str, universe: DataFrame, parts: int, limit: int, into: str) -> DataFrame | None:
    """``mark_listed`` with so many parts; none if a part is still too large."""
    bits = parts.bit_length() - 1
    part = lambda key: F.coalesce(F.shiftrightunsigned(F.xxhash64(F.lit(-1), key), 64 - bits), F.lit(0).cast("long"))
    most = universe.where("listed").groupBy(part(F.col("key")).alias("part")).agg(F.count("*").alias("n")).agg(F.max("n")).first()[0]
    if most * 2 > limit and most > 1:  # no level has under 1.4 bits a key
        return None
    found = None
    for first in range(0, parts, PASS_PARTS):
        held = range(first, min(parts, first + PASS_PARTS))
        answer = F.lit(False)
        for i in held:
            cascade = build_cascade(universe.where(part(F.col("key")) == i), limit)
            if cascade is None:
                return None
            answer = F.when(part(F.col(host)) == i, cascade.contains(F.col(host))).otherwise(answer)
        rows = stash(df.where(part(F.col(host)).between(held[0], held[-1])).withColumn(into, answer), "marked")
        found = rows if found is None else found.unionByName(rows)
    return found


def filter_urls(pages: DataFrame, url: str = "url", rules: Sequence[tuple[str, str, str]] = RULES, domains: Sequence[str] | DataFrame = LISTED, max_bits: int = MAX_LEVEL_BITS) -> DataFrame:
    """Adds host, path, rule, is_listed and verdict (the rule's, else block for listed hosts) to each page; columns of these names are replaced, unless the url is one of them."""
    names = ("host", "path", "rule", "is_listed", "verdict")
    if url in names:
        raise ValueError(f"{url} is the name of a result")
    clash = [c for c in pages.columns if c.lower() in names]
    parsed = pages.drop(*clash).withColumn("host", host_of(F.col(url))).withColumn("path", path_of(F.col(url)))
    marked = mark_listed(parsed, "host", domains, max_bits)
    rule, by_rule = rule_of(F.col("host"), F.col("path"), rules)
    return marked.withColumn("rule", rule).withColumn("verdict", F.coalesce(by_rule, F.when(F.col("is_listed"), "block").otherwise("allow")))
