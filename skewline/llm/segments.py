"""Texts as segments (lines and sentences) of folded characters, and the hashed features of a segment, in whole arrays.

A passage in quotation marks is one mark, whatever its length, so what is merely quoted adds nothing.
"""

from __future__ import annotations

import re
import unicodedata
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np

BITS = 17
SIZES = (3, 5)
#: characters of which pairs count by presence, whatever the length of the segment
MARKS = "{}[]<>$%@#_&«»|=~`"
D, M = 1 << BITS, 1 << 16
#: a one for each mark; all lie below 255
_IS_MARK = bytes(chr(c) in MARKS for c in range(256))
#: characters that are worked on at once, about
PACK = 200_000
QUOTED, TITLE, LINE, INNER, STOP = 0xE000, 0xE001, 0xE002, 0xE003, 0xE004
#: every alternative begins with its own character, so that the search skips to such characters
_QUOTES = re.compile(r""""(?<!\w")(?=\S)[^"\n]*[^"\s]"(?!\w)|„[^“”\n]+[“”]|“[^”\n]+”|「[^」\n]+」|『[^』\n]+』|«[^»\n]*\s[^»\n]*»""")

_OPENING = '"„“「『«'


def _fold_table() -> np.ndarray:
    """Code point -> folded code point (0: dropped), for the basic plane; other planes keep a single mark."""
    t = np.arange(65536, dtype=np.uint16)
    for cp in range(65536):
        c = chr(cp)
        if c == "\n" or 0xD800 <= cp < 0xE000:
            continue
        if c.isspace() or unicodedata.category(c) in ("Cf", "Cc", "Mn"):
            t[cp] = 0
        elif c.isdigit():
            t[cp] = ord("0")
        elif cp < 0x2000 or 0xFF00 <= cp:
            d = unicodedata.normalize("NFKD", c)[0].lower()[:1]
            t[cp] = ord(d) if ord(d) < 65536 and not d.isspace() else 0
    return t


_FOLD: list[np.ndarray] = []


def fold_table() -> np.ndarray:
    if not _FOLD:
        _FOLD.append(_fold_table())
    return _FOLD[0]


def _points(text: str) -> np.ndarray:
    units = text.encode("utf-16-le", "surrogatepass")
    if len(units) == 2 * len(text):  # nothing beyond the basic plane
        return np.frombuffer(units, np.uint16)
    cp = np.frombuffer(text.encode("utf-32-le", "surrogatepass"), np.uint32)
    return np.minimum(cp, 65535).astype(np.uint16)


def squeeze(text: str) -> str:
    """Text without white space, accents and case, digits as 0."""
    f = fold_table()[_points(text)]
    return f[f > 0].tobytes().decode("utf-16-le", "replace")


@dataclass
class Segments:
    """Segments of a batch of texts: their document, their bounds in ``text``, and their folded characters."""

    text: str
    doc: np.ndarray
    start: np.ndarray
    end: np.ndarray
    chars: np.ndarray
    first: np.ndarray  # whether it is its text's first
    alone: np.ndarray  # whether it is its text's only one
    at: np.ndarray  # its first character

    @property
    def size(self) -> np.ndarray:
        """Characters of each segment, with its two marks."""
        return np.diff(self.at, append=len(self.chars))

    def raw(self, i: int) -> str:
        return self.text[self.start[i] : self.end[i]]

    def folded(self, i: int) -> bytes:
        return self.chars[self.at[i] : self.at[i + 1] if i + 1 < len(self.at) else len(self.chars)].tobytes()

    def folded_of(self, which: np.ndarray) -> list[bytes]:
        """``folded`` of many."""
        all_, start, size = self.chars.tobytes(), 2 * self.at[which], 2 * self.size[which]
        return [all_[a:b] for a, b in zip(start.tolist(), (start + size).tolist())]


def of_folded(parts: list[bytes], alone: np.ndarray) -> Segments:
    """Segments again from their folded characters."""
    chars = np.frombuffer(b"".join(parts), np.uint16)
    size = np.array([len(p) // 2 for p in parts], np.int64)
    at = np.cumsum(size) - size
    z = np.zeros(len(parts), np.int64)
    return Segments("", z, z, z, chars, chars[at] == TITLE, np.asarray(alone, bool), at)


def segments(texts: list[str | None]) -> Segments:
    parts = [_QUOTES.sub(chr(QUOTED), t) if t and any(q in t for q in _OPENING) else t or "" for t in texts]
    joined = "\n".join(parts) + "\n"
    cp = _points(joined)
    starts = np.zeros(len(parts) + 1, np.int64)
    np.cumsum([len(p) + 1 for p in parts], out=starts[1:])
    folded = fold_table().take(cp, mode="clip")  # all within
    blank = (folded == 0) | (cp == 10)
    ender = (cp == 46) | (cp == 33) | (cp == 63)
    ends = (cp == 10) | (cp == 0x3002) | (cp == 0xFF01) | (cp == 0xFF1F)  # a segment ends with this character
    ends[:-1] |= ender[:-1] & blank[1:]
    kept = np.flatnonzero(~blank)
    if not len(kept):
        z = np.zeros(0, np.int64)
        return Segments(joined, z, z, z, z.astype(np.uint16), z.astype(bool), z.astype(bool), z)
    # a segment begins with the first character kept after an end
    begin = np.zeros(len(kept) + 1, bool)
    begin[np.searchsorted(kept, np.flatnonzero(ends), "right")] = True
    begin[0] = True
    where = np.flatnonzero(begin[:-1])
    n = np.diff(where, append=len(kept))
    start, end = kept[where], kept[where + n - 1] + 1
    doc = np.searchsorted(starts, start, "right") - 1
    first = np.concatenate([[True], doc[1:] != doc[:-1]])
    alone = first & np.concatenate([first[1:], [True]])
    line = np.searchsorted(np.flatnonzero(cp == 10), start)
    begins = np.concatenate([[True], line[1:] != line[:-1]])
    size = n + 2
    at = np.cumsum(size) - size
    chars = np.empty(int(size.sum()), np.uint16)
    body = np.ones(len(chars), bool)
    body[at] = False
    body[at + size - 1] = False
    chars[body] = folded[kept]
    chars[at] = np.where(first, TITLE, np.where(begins, LINE, INNER))
    chars[at + size - 1] = STOP
    return Segments(joined, doc, start, end, chars, first, alone, at)


def packs(texts: list[str | None], chars: int = PACK) -> Iterator[tuple[int, list[str | None]]]:
    """(number of its first text, texts): runs of texts of about ``chars`` characters, which a processor's cache holds; no text is cut."""
    a = n = 0
    for b, t in enumerate(texts):
        n += len(t or "")
        if n >= chars:
            yield a, texts[a : b + 1]
            a, n = b + 1, 0
    if a < len(texts):
        yield a, texts[a:]


def grams(s: Segments) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """(column of the n-gram that begins at each character, places of those that don't lie within a segment), for each size."""
    for k, n in enumerate(SIZES):
        if len(s.chars) < n:
            continue
        h = _hash(s.chars, n, k)
        h >>= np.uint32(32 - BITS)
        h += np.uint32(k * D)
        yield h.astype(np.int64), _across(s, n)


def _across(s: Segments, n: int) -> np.ndarray:
    """Places of the n-grams that begin in a segment and end beyond it."""
    at = s.at[1:, None] - np.arange(1, n)
    # of a segment shorter than n - 1 these reach into the one before, where they are among its own last places
    return at[(at >= 0) & (at <= len(s.chars) - n)]


def _hash(chars: np.ndarray, n: int, seed: int) -> np.ndarray:
    h = np.full(len(chars) - n + 1, seed * 0x9E3779B1 & 0xFFFFFFFF, np.uint32)
    for i in range(n):
        h *= np.uint32(0x01000193)
        h ^= chars[i : len(chars) - n + 1 + i]
    h ^= h >> np.uint32(15)
    h *= np.uint32(0x85EBCA6B)
    return h


def keys(s: Segments) -> np.ndarray:
    """64-bit key of each segment's folded characters, whatever batch it comes in."""
    if not len(s.at):
        return np.zeros(0, np.uint64)
    # every segment has its two marks and a character, so one trigram at least
    h = _hash(s.chars, 3, 7).astype(np.uint64)
    h += np.uint64(1)
    # times 1 + golden x the place in the segment
    golden = np.uint64(0x9E3779B97F4A7C15)
    place = np.arange(len(h), dtype=np.uint64)
    place *= golden
    place -= np.repeat(s.at.astype(np.uint64) * golden - np.uint64(1), s.size)[: len(h)]
    h *= place
    h[_across(s, 3)] = 0
    out = np.add.reduceat(h, s.at)
    out ^= out >> np.uint64(29)
    return out * np.uint64(0xBF58476D1CE4E5B9)


def per_segment(s: Segments, values: np.ndarray) -> np.ndarray:
    """Sums of per-character values by segment; ``values`` may lack the last characters'."""
    at = np.minimum(s.at, len(values) - 1)
    return np.where(s.at < len(values), np.add.reduceat(values, at), 0)


def only(s: Segments, which: np.ndarray) -> Segments:
    """The segments of a mask."""
    size = s.size
    body, size = np.repeat(which, size), size[which]
    return Segments(s.text, s.doc[which], s.start[which], s.end[which], s.chars[body], s.first[which], s.alone[which], np.cumsum(size) - size)


def marks(s: Segments) -> tuple[np.ndarray, np.ndarray]:
    """(segment, hash) of each pair of characters with a mark in it, and of what stands before marks; repeats in a segment count once."""
    if len(s.chars) < 2:
        return np.zeros(0, np.int64), np.zeros(0, np.int64)
    m = np.frombuffer(np.minimum(s.chars, 255).astype(np.uint8).tobytes().translate(_IS_MARK), bool)
    seg = lambda at: np.searchsorted(s.at, at, "right") - 1
    at = np.flatnonzero(m[:-1] | m[1:])
    of = seg(at)
    at, of = (x[at < (s.at + s.size)[of] - 1] for x in (at, of))
    a, b = s.chars[at].astype(np.int64), s.chars[at + 1].astype(np.int64)
    # letters are one kind here: which mark they touch is what matters
    a, b = (np.where(m[at + k], x, np.where(x == 48, 48, np.where(x >= 0xE000, x, 97))) for k, x in ((0, a), (1, b)))
    pairs = of * M + (a * 31 + b * 1009) % (M // 2)
    # the four characters before each run of marks
    run = np.flatnonzero(m[4:] & ~m[3:-1]) + 4
    of = seg(run)
    run, of = (x[s.at[of] <= run - 4] for x in (run, of))
    h = np.zeros(len(run), np.int64)
    for k in (4, 3, 2, 1):
        h = h * 31 + s.chars[run - k]
    both = np.unique(np.concatenate([pairs, of * M + M // 2 + h % (M // 2)]))
    return both // M, both % M


def shape(s: Segments) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(n-gram count, length class, title class) of each segment."""
    n = s.size - 2
    return n, np.minimum(np.log2(np.maximum(n, 1)).astype(int), 11), s.first.astype(int) + s.alone
