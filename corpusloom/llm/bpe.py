"""Byte-level BPE encoding of whole texts with the tokenizers library, one call for each distinct word.

Merges of a byte-level BPE never cross the words that its pre-tokenizer cuts, so encoding a word once
and looking it up ever after gives the library's ids. Words are cut by array operations on code
points that follow the pre-tokenizer's pattern::

    's|'t|'re|'ve|'m|'ll|'d| ?\\p{L}+| ?\\p{N}+| ?[^\\s\\p{L}\\p{N}]+|\\s+(?!\\S)|\\s+

and looked up by a 64-bit hash of their code points; the words behind equal hashes are compared, and texts with two
words of one hash are encoded by the library as they are. The cache is emptied beyond ``max_words``.
Strings of special tokens are ordinary text.

A word that is not in the cache goes to the library's model as it is: it is cut already, and its bytes are turned into the
vocabulary's letters for many words at once. Where a tokenizer does more than that before its model (``_bare``), words go
through all of it.
"""

from __future__ import annotations

import os
from itertools import chain

import numpy as np

LETTER, NUMBER, SPACE, OTHER, BREAK = 1, 2, 3, 0, 4

#: Characters that one pass of array operations takes, and words that are kept apart before they are merged.
PASS_CHARS, LATEST = 1 << 18, 1 << 15

_classes: np.ndarray | None = None
_encoders: dict[str, WordEncoder] = {}


def tokenizer_path(name: str) -> str:
    if os.path.exists(name):
        return name
    import public_tokenizers

    return public_tokenizers.path(name)


def encoder(name: str) -> WordEncoder:
    """This process's encoder for a vocabulary file."""
    if name not in _encoders:
        _encoders[name] = WordEncoder(tokenizer_path(name))
    return _encoders[name]


def char_classes() -> np.ndarray:
    """Class of each code point."""
    global _classes
    if _classes is None:
        import regex

        everything = "".join(chr(c) for c in range(0x110000) if not 0xD800 <= c < 0xE000)
        found = np.zeros(0x110000, np.uint8)
        for kind, pattern in ((LETTER, r"\p{L}"), (NUMBER, r"\p{N}"), (SPACE, r"\s")):
            found[[ord(c) for c in regex.findall(pattern, everything)]] = kind
        found[0x1C:0x20] = OTHER  # white space to Python only
        _classes = found
    return _classes


def code_points(text: str) -> np.ndarray:
    return np.frombuffer(text.encode("utf-32-le", "surrogatepass"), np.uint32)


def word_starts(points: np.ndarray, breaks: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(starts, class at each start) of the pre-tokenizer's words; ``breaks``: positions of separators between texts."""
    n = len(points)
    kind = char_classes()[points]
    kind[breaks] = BREAK
    start = np.empty(n + 3, bool)
    start[0] = True
    np.not_equal(kind[1:], kind[:-1], out=start[1:n])
    start[n:] = True
    start[breaks] = True
    last = np.flatnonzero((kind[:-1] == SPACE) & (kind[1:] < SPACE))  # a white space run's end before a word
    start[last] = True
    start[last[points[last] == 0x20] + 1] = False  # the blank belongs to the word
    quote = np.flatnonzero((points == 0x27) & start[:n])
    quote = quote[quote + 1 < n]
    quote = quote[kind[quote + 1] == LETTER]
    if len(quote):
        first = points[quote + 1]
        after = np.minimum(quote + 2, n - 1)
        second = np.where((quote + 2 < n) & (kind[after] == LETTER), points[after], 0)
        one = np.isin(first, [ord(c) for c in "stmd"])
        two = ((first == ord("r")) | (first == ord("v"))) & (second == ord("e")) | (first == ord("l")) & (second == ord("l"))
        start[quote[one | two] + 1] = False
        start[quote[one] + 2] = True
        start[quote[two] + 3] = True
    at = np.flatnonzero(start[:n])
    return at, kind[at]


_powers = np.ones(1, np.uint64)


def _hashes(points: np.ndarray, at: np.ndarray, sizes: np.ndarray) -> np.ndarray:
    """A 64-bit hash of each word: code points mixed, times powers of an odd number by place, summed."""
    global _powers
    longest = int(sizes.max())
    if longest > len(_powers):
        _powers = np.cumprod(np.full(max(longest, 64), 0x9E3779B97F4A7C15, np.uint64))
    mixed = (points.astype(np.uint64) + np.uint64(0x632BE5AB)) * np.uint64(0xD6E8FEB86659FD93)
    mixed ^= mixed >> np.uint64(32)
    mixed *= np.uint64(0xC2B2AE3D27D4EB4F)
    place = np.arange(len(points)) - np.repeat(at, sizes)
    mixed *= _powers[place]
    found = np.add.reduceat(mixed, at) + sizes.astype(np.uint64) * np.uint64(0xFF51AFD7ED558CCD)
    found ^= found >> np.uint64(31)
    return found


def gather(starts: np.ndarray, counts: np.ndarray) -> np.ndarray:
    """Indices of the concatenated ranges ``starts[i] .. starts[i] + counts[i]``."""
    ends = np.cumsum(counts)
    return np.repeat(starts - (ends - counts), counts) + np.arange(int(ends[-1]) if len(ends) else 0)


def byte_letters() -> np.ndarray:
    """Letter of each byte in a byte-level vocabulary: printable Latin-1 stands for itself, the others follow each other from U+0100."""
    kept = np.zeros(256, bool)
    kept[0x21:0x7F] = kept[0xA1:0xAD] = kept[0xAE:] = True
    return np.where(kept, np.arange(256), 0xFF + np.cumsum(~kept)).astype("<u2")


def _bare(tokenizer) -> bool:
    """Whether words that are cut already need nothing but their bytes' letters before the model."""
    from tokenizers import pre_tokenizers

    before = tokenizer.pre_tokenizer
    plain = isinstance(before, pre_tokenizers.ByteLevel) and not before.add_prefix_space and tokenizer.normalizer is None
    return plain and tokenizer.truncation is None and all(t.special for t in tokenizer.get_added_tokens_decoder().values())


def split_long(text: str, limit: int = PASS_CHARS) -> list[str]:
    """Pieces of a very long text that encode as the whole does: cut before a blank between two non-blanks."""
    pieces, at = [], 0
    while len(text) - at > limit:
        cut = at + limit
        while True:
            cut = text.find(" ", cut)
            if cut < 0 or cut + 1 >= len(text):
                cut = len(text)
                break
            if not text[cut - 1].isspace() and not text[cut + 1].isspace():
                break
            cut += 1
        pieces.append(text[at:cut])
        at = cut
    return [*pieces, text[at:]] if at < len(text) or not pieces else pieces


class Growing:
    """An array that is appended to; its room doubles, so appending does not copy it each time."""

    def __init__(self, first: list[int], dtype: type):
        self.room, self.n = np.array(first, dtype), len(first)

    def extend(self, more: np.ndarray) -> None:
        if self.n + len(more) > len(self.room):
            wider = np.empty(max(2 * len(self.room), self.n + len(more), 1024), self.room.dtype)
            wider[: self.n] = self.room[: self.n]
            self.room = wider
        self.room[self.n : self.n + len(more)] = more
        self.n += len(more)

    @property
    def all(self) -> np.ndarray:
        return self.room[: self.n]


class WordEncoder:
    """Ids of texts; keeps the ids of up to ``max_words`` distinct words, some 80 bytes each."""

    def __init__(self, path: str, max_words: int = 600_000):
        os.environ.setdefault("TOKENIZERS_PARALLELISM", "false")
        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_file(path)
        self.tokenizer.encode_special_tokens = True
        self.largest_id = max(self.tokenizer.get_vocab(with_added_tokens=True).values())
        self.model = self.tokenizer.model if _bare(self.tokenizer) else None
        self.letters = byte_letters()
        self.max_words = max_words
        self.clear()

    def clear(self) -> None:
        # hashes with their slots: many that are sorted, and the latest, sorted apart until there are enough to merge
        self.tiers = [(np.empty(0, np.uint64), np.empty(0, np.int32)) for _ in range(2)]
        self.ids, self.offsets = Growing([], np.uint32), Growing([0], np.int32)
        self.points, self.ends = Growing([], np.uint32), Growing([0], np.int32)  # the words themselves, as the slots have them

    def encode(self, texts: list[str]) -> tuple[np.ndarray, np.ndarray]:
        """(all ids, offsets): text i has ``ids[offsets[i]:offsets[i + 1]]``."""
        found, counts, group, size = [], np.zeros(len(texts), np.int64), [], 0
        pieces = ((i, p) for i, t in enumerate(texts) for p in (split_long(t) if len(t) > PASS_CHARS else (t,)))
        for i, piece in pieces:
            if group and size + len(piece) > PASS_CHARS:
                found.append(self._pass(group, counts))
                group, size = [], 0
            group.append((i, piece))
            size += len(piece) + 1
        if group:
            found.append(self._pass(group, counts))
        return (np.concatenate(found) if found else np.empty(0, np.uint32)), np.concatenate([[0], np.cumsum(counts)])

    def _pass(self, group: list[tuple[int, str]], counts: np.ndarray) -> np.ndarray:
        joined = "\n".join(p for _, p in group) + "\n"
        points = code_points(joined)
        breaks = np.cumsum([len(p) + 1 for _, p in group]) - 1
        at, kind = word_starts(points, breaks)
        sizes = np.diff(at, append=len(points))
        hashes = _hashes(points, at, sizes)
        word = kind != BREAK
        points_kept = np.ones(len(points), bool)
        points_kept[breaks] = False
        at, sizes, hashes = at[word], sizes[word], hashes[word]
        if not len(at):
            return np.empty(0, np.uint32)
        distinct, first, which = np.unique(hashes, return_index=True, return_inverse=True)
        slots = self._slots(distinct, at[first], sizes[first], points)
        begin, end = self.ends.all[slots], self.ends.all[slots + 1]
        if not np.array_equal((end - begin)[which], sizes):
            return self._plain(group, counts)
        said = points[points_kept]  # the words' code points, one word after another
        index = np.repeat((begin[which] - (np.cumsum(sizes) - sizes)).astype(np.int32), sizes)
        index += np.arange(len(said), dtype=np.int32)
        if not np.array_equal(self.points.all[index], said):
            return self._plain(group, counts)
        first_id = self.offsets.all[slots]
        per_word = (self.offsets.all[slots + 1] - first_id)[which]
        ids = self.ids.all[gather(first_id[which], per_word)]
        ends = np.concatenate([[0], np.cumsum(per_word)])[np.searchsorted(at, breaks)]
        np.add.at(counts, [i for i, _ in group], np.diff(ends, prepend=0))
        return ids

    def _plain(self, group: list[tuple[int, str]], counts: np.ndarray) -> np.ndarray:
        """Ids by the library alone, where two words have one hash."""
        coded = [e.ids for e in self.tokenizer.encode_batch([p for _, p in group], add_special_tokens=False)]
        np.add.at(counts, [i for i, _ in group], [len(c) for c in coded])
        return np.fromiter((x for c in coded for x in c), np.uint32)

    def _coded(self, points: np.ndarray, sizes: np.ndarray) -> list[list[int]]:
        """Ids of each word by the library; ``points``: the words' code points, one word after another."""
        text, ends = points.tobytes().decode("utf-32-le", "surrogatepass"), np.cumsum(sizes)
        if self.model is None:
            words = [text[a:b] for a, b in zip((ends - sizes).tolist(), ends.tolist(), strict=True)]
            return [e.ids for e in self.tokenizer.encode_batch(words, add_special_tokens=False)]
        letters = self.letters[np.frombuffer(text.encode(), np.uint8)].tobytes().decode("utf-16-le")
        width = 1 + (points >= 0x80).astype(np.int64) + (points >= 0x800) + (points >= 0x10000)
        ends = np.cumsum(width)[ends - 1].tolist()
        tokenize = self.model.tokenize
        return [[t.id for t in tokenize(letters[a:b])] for a, b in zip([0, *ends[:-1]], ends, strict=True)]

    def _slots(self, distinct: np.ndarray, at: np.ndarray, sizes: np.ndarray, points: np.ndarray) -> np.ndarray:
        if self.offsets.n + len(distinct) > self.max_words:
            self.clear()
        found = np.full(len(distinct), -1, np.int64)
        for keys, slots in self.tiers:
            if len(keys):
                place = np.minimum(np.searchsorted(keys, distinct), len(keys) - 1)
                known = keys[place] == distinct
                found[known] = slots[place[known]]
        new = np.flatnonzero(found < 0)
        if len(new):
            said = points[gather(at[new], sizes[new])]
            coded = self._coded(said, sizes[new])
            found[new] = self.offsets.n - 1 + np.arange(len(new))
            self.points.extend(said)
            self.ends.extend(self.ends.all[-1] + np.cumsum(sizes[new]))
            self.ids.extend(np.fromiter(chain.from_iterable(coded), np.uint32))
            self.offsets.extend(self.offsets.all[-1] + np.cumsum([len(c) for c in coded]))
            many, latest = self.tiers
            latest = self._merged(latest, (distinct[new], found[new].astype(np.int32)))
            self.tiers = [self._merged(many, latest), (latest[0][:0], latest[1][:0])] if len(latest[0]) > LATEST else [many, latest]
        return found

    @staticmethod
    def _merged(a: tuple[np.ndarray, np.ndarray], b: tuple[np.ndarray, np.ndarray]) -> tuple[np.ndarray, np.ndarray]:
        place = np.searchsorted(a[0], b[0])
        return np.insert(a[0], place, b[0]), np.insert(a[1], place, b[1])
