"""Vectorised structural index of many JSON texts at once.

Bitmaps of quotes, brackets and delimiters are built over the bytes of a whole batch; prefix sums give the string mask
and the nesting depth; one stable sort by depth links every token to the bracket that holds it and to its place there.
The same ordinals prove the grammar, so texts that aren't valid JSON are known without a parser.
"""

from __future__ import annotations

import json
import re

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc

WS, OTHER, OBJ, ARR, END_OBJ, END_ARR, COLON, COMMA = range(8)
STR, SCALAR = 8, 9
_CLASS = np.full(256, OTHER, np.uint8)
_CLASS[[9, 10, 13, 32]] = WS
for _c, _k in zip(b"{[}]:,", (OBJ, ARR, END_OBJ, END_ARR, COLON, COMMA)):
    _CLASS[_c] = _k
_HEX = np.zeros(256, bool)
_HEX[list(b"0123456789abcdefABCDEF")] = True
_ESC = np.zeros(256, bool)
_ESC[list(b'"\\/bfnrtu')] = True
_BAD_SCALAR = re.compile(rb"^(?!(?:-?(?:0|[1-9][0-9]*)(?:\.[0-9]+)?(?:[eE][+-]?[0-9]+)?|true|false|null)$).*$", re.M)
#: numbers that need no closer look
PLAIN = r"^-?[0-9]{1,15}(\.[0-9]{1,17})?$"
NUMBER = re.compile(rb"\s*[+-]?(?:[0-9]+\.?[0-9]*|\.[0-9]+)(?:[eE][+-]?[0-9]+)?\s*")


class Tape:
    """Tokens of a batch of texts.

    kind, pos, end (one past the last byte), doc, parent (token of the bracket, -1 at the root), ordinal (among the
    tokens in that bracket), root (token of each text's value, -1 if the text isn't valid).
    """

    def __init__(self, texts: list[bytes | None]):
        n = len(texts)
        joined = b"\n".join(t or b"" for t in texts) + b"\n"
        self.raw = joined
        b = self.b = np.frombuffer(joined, np.uint8)
        starts = np.zeros(n + 1, np.int64)
        np.cumsum([len(t or b"") + 1 for t in texts], out=starts[1:])
        doc_of = lambda p: np.searchsorted(starts, p, "right") - 1
        ok = np.ones(n, bool)

        # escapes: a byte after an odd run of backslashes
        slash = np.flatnonzero(b == 92)
        escaped = np.zeros(len(b) + 1, bool)
        if len(slash):
            first = np.concatenate([[True], np.diff(slash) != 1])
            run = slash - slash[np.maximum.accumulate(np.where(first, np.arange(len(slash)), 0))]
            escaped[slash[run % 2 == 0] + 1] = True
        quote = (b == 34) & ~escaped[:-1]
        at = np.flatnonzero(quote)
        per_doc = np.bincount(doc_of(at), minlength=n) if len(at) else np.zeros(n, int)
        odd = per_doc % 2 == 1
        if odd.any():
            ok &= ~odd
            at = at[~odd[doc_of(at)]]
            quote = np.zeros(len(b), bool)
            quote[at] = True
        inside = (np.cumsum(quote, dtype=np.int32) & 1).astype(bool)  # from the opening quote up to before the closing one
        opening, closing = at[0::2], at[1::2]

        # text inside strings: no control bytes, only known escapes
        wrong = np.flatnonzero(inside & (b < 32))
        ok[doc_of(wrong)] = False
        esc = np.flatnonzero(escaped[:-1] & inside)
        ok[doc_of(esc[~_ESC[b[esc]]])] = False
        uni = esc[b[esc] == 117]
        if len(uni):
            room = np.concatenate([b, np.zeros(4, np.uint8)])
            good = np.logical_and.reduce([_HEX[room[uni + k]] for k in range(1, 5)])
            ok[doc_of(uni[~good])] = False

        cls = _CLASS[b]
        cls[inside] = STR
        cls[closing] = STR
        scalar = cls == OTHER
        s_start = np.flatnonzero(scalar & ~np.concatenate([[False], scalar[:-1]]))
        s_end = np.flatnonzero(scalar & ~np.concatenate([scalar[1:], [False]])) + 1
        self._scalars(b, scalar, s_start, ok, doc_of)
        struct = np.flatnonzero((cls >= OBJ) & (cls <= COMMA))
        pos = np.concatenate([struct, opening, s_start])
        order = np.argsort(pos, kind="stable")
        pos = pos[order]
        kind = np.concatenate([cls[struct], np.full(len(opening), STR, np.uint8), np.full(len(s_start), SCALAR, np.uint8)])[order]
        end = np.concatenate([struct + 1, closing + 1, s_end])[order]
        doc = doc_of(pos)

        # depth by prefix sum; texts that don't balance are dropped before they can shift others
        for _ in range(2):
            delta = np.where(kind <= ARR, 1, np.where(kind <= END_ARR, -1, 0))
            depth = np.cumsum(delta)
            first = np.searchsorted(doc, np.arange(n))
            before = np.concatenate([[0], depth])[first]
            depth = depth - before[doc]
            ok[doc[depth < 0]] = False
            last = np.searchsorted(doc, np.arange(n), "right")
            ok[(last > first) & (np.concatenate([[0], np.cumsum(delta)])[last] - before != 0)] = False
            keep = ok[doc]
            if keep.all():
                break
            pos, end, kind, doc = pos[keep], end[keep], kind[keep], doc[keep]
        m = len(pos)
        opens = (kind == OBJ) | (kind == ARR)
        ends = (kind == END_OBJ) | (kind == END_ARR)
        level = np.where(opens, depth - 1, np.where(ends, depth + 1, depth)) if m else np.zeros(0, int)

        # one stable sort by level brings each bracket and its tokens together
        child = np.flatnonzero(~ends)
        o = np.flatnonzero(opens)
        key = np.concatenate([depth[o], level[child], level[ends]]) if m else np.zeros(0, int)
        who = np.concatenate([o, child, np.flatnonzero(ends)])
        what = np.concatenate([np.zeros(len(o), np.int8), np.ones(len(child), np.int8), np.full(int(ends.sum()), 2, np.int8)])
        # position within the level; a bracket as holder comes right at its own place
        by = np.lexsort((who, key))
        who, what, key = who[by], what[by], key[by]
        place = np.arange(len(who))
        holder = np.maximum.accumulate(np.where(what == 0, place, -1)) if len(who) else place
        parent = np.full(m, -1, np.int64)
        ordinal = np.zeros(m, np.int64)
        deep = key > 0
        parent[who[deep & (what > 0)]] = who[holder[deep & (what > 0)]]
        ordinal[who[deep & (what > 0)]] = (place - holder - 1)[deep & (what > 0)]
        top = (key == 0) & (what == 1)
        roots = who[top]
        count = np.bincount(doc[roots], minlength=n)
        ok &= count == 1

        # grammar: which kind may stand at which ordinal
        value = opens | (kind == STR) | (kind == SCALAR)
        in_obj = np.zeros(m, bool)
        has = parent >= 0
        in_obj[has] = kind[parent[has]] == OBJ
        q = ordinal % 4
        fine_obj = np.where(q == 0, kind == STR, np.where(q == 1, kind == COLON, np.where(q == 2, value, kind == COMMA)))
        fine_arr = np.where(ordinal % 2 == 0, value, kind == COMMA)
        fine = np.where(has, np.where(in_obj, fine_obj, fine_arr), value)
        # at a closing bracket the ordinal is the number of tokens before it
        fine_end = np.where(in_obj, (kind == END_OBJ) & ((q == 3) | (ordinal == 0)), (kind == END_ARR) & ((ordinal % 2 == 1) | (ordinal == 0)))
        fine = np.where(ends, fine_end, fine)
        ok[doc[~fine]] = False
        self.kind, self.pos, self.end, self.doc, self.parent, self.ordinal = kind, pos, end, doc, parent, ordinal
        self.is_value = value & np.where(has & in_obj, q == 2, True) & ~ends
        self.in_obj = in_obj
        self.root = np.full(n, -1, np.int64)
        self.root[doc[roots]] = roots
        self.root[~ok] = -1
        self.n = n
        # tokens of a level in order: the key of a value stands two tokens before it
        self._slot_of = np.zeros(m, np.int64)
        self._slot_of[who[what > 0]] = place[what > 0]
        self._at_slot = who
        self._slashes: np.ndarray | None = None

    @staticmethod
    def _scalars(b, scalar, s_start, ok, doc_of) -> None:
        """Marks the texts in which something outside strings is neither a number nor true, false or null."""
        if not len(s_start):
            return
        keep = scalar | np.concatenate([[False], scalar[:-1]])
        lines = np.where(scalar, b, 10)[keep].tobytes()
        bad = [m.start() for m in _BAD_SCALAR.finditer(lines) if m.group()]
        if bad:
            breaks = np.flatnonzero(np.frombuffer(lines, np.uint8) == 10)
            ok[doc_of(s_start[np.searchsorted(breaks, bad)])] = False

    def name_keys(self, names: list[str]) -> dict[str, np.ndarray]:
        """For each name, an array from an object's token to the token of that member's value (the last if repeated), or -1."""
        v = np.flatnonzero(self.is_value & self.in_obj)
        k = self._at_slot[self._slot_of[v] - 2] if len(v) else v
        start, length = self.pos[k] + 1, self.end[k] - self.pos[k] - 2
        found = np.full(len(v), -1)
        for size in {len(x) for x in names}:
            c = np.flatnonzero(length == size)
            if not len(c):
                continue
            chars = self.b[start[c][:, None] + np.arange(size)]
            for i, x in enumerate(names):
                if len(x) == size:
                    found[c[(chars == np.frombuffer(x.encode(), np.uint8)).all(1)]] = i
        index = {x: i for i, x in enumerate(names)}
        if 92 in self.b:  # keys spelt with escapes
            cum = np.concatenate([[0], np.cumsum(self.b == 92)])
            for c in np.flatnonzero(cum[start + length] > cum[start]):
                found[c] = index.get(self.string(k[c]), -1)
        out = {}
        for i, x in enumerate(names):
            slot = np.full(len(self.pos) + 1, -1, np.int64)  # the last entry answers for "no object"
            hit = v[found == i]
            slot[self.parent[hit]] = hit
            out[x] = slot
        return out

    def bytes_of(self, token: int) -> bytes:
        return self.raw[self.pos[token] : self.end[token]]

    def string(self, token: int) -> str:
        raw = self.bytes_of(token)
        return json.loads(raw) if b"\\" in raw else raw[1:-1].decode("utf-8", "replace")

    def text(self, token: int) -> str | None:
        """A string's text, a scalar as it is written; None for null, brackets and nothing."""
        if token < 0:
            return None
        if self.kind[token] == STR:
            return self.string(token)
        if self.kind[token] == SCALAR:
            raw = self.bytes_of(token)
            return None if raw == b"null" else raw.decode("utf-8", "replace")
        return None

    def kind_of(self, tokens: np.ndarray) -> np.ndarray:
        """Kinds of tokens, 255 for -1."""
        return np.where(tokens >= 0, self.kind[np.maximum(tokens, 0)] if len(self.kind) else 255, 255)

    def slices(self, start: np.ndarray, end: np.ndarray) -> pa.Array:
        """The bytes between as one array of strings."""
        size = np.maximum(end - start, 0)
        stop = np.concatenate([[0], np.cumsum(size)])
        data = self.b[np.repeat(start - stop[:-1], size) + np.arange(stop[-1])]
        return pa.Array.from_buffers(pa.large_binary(), len(size), [None, pa.py_buffer(stop.astype(np.int64)), pa.py_buffer(np.ascontiguousarray(data))])

    def _bounds(self, tokens: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
        """(kind, first byte, one past the last, whether it holds a backslash) of each token's text, without quotes."""
        kind = self.kind_of(tokens)
        at = np.maximum(tokens, 0)
        held = (kind == STR) | (kind == SCALAR)
        if not len(self.pos):
            z = np.zeros(len(tokens), np.int64)
            return kind, z, z, z.astype(bool)
        start = np.where(held, self.pos[at] + (kind == STR), 0)
        end = np.where(held, self.end[at] - (kind == STR), 0)
        if self._slashes is None:
            self._slashes = np.concatenate([[0], np.cumsum(self.b == 92)])
        return kind, start, end, self._slashes[end] > self._slashes[start]

    def texts(self, tokens: np.ndarray, strings_only: bool = False) -> pa.Array:
        """``text`` of many tokens at once."""
        kind, start, end, odd = self._bounds(tokens)
        raw = self.slices(start, end)
        none = (kind != STR) if strings_only else (kind != STR) & (kind != SCALAR)
        if not strings_only:
            none |= (kind == SCALAR) & np.asarray(pc.equal(raw, pa.scalar(b"null", pa.large_binary())).to_numpy(zero_copy_only=False), bool)
        out = raw.cast(pa.large_string()).cast(pa.string())
        slow = np.flatnonzero(odd & (kind == STR))
        if len(slow):
            # a lone surrogate can't be written as a string
            values = [json.loads(self.bytes_of(t)).encode("utf-8", "replace").decode() for t in tokens[slow].tolist()]
            out = pc.replace_with_mask(out, pa.array(odd & (kind == STR)), pa.array(values, pa.string()))
        return pc.if_else(pa.array(none), pa.scalar(None, pa.string()), out)

    def numbers(self, tokens: np.ndarray) -> np.ndarray:
        """Numbers, or strings that hold a number; NaN for anything else. Overflow gives infinity."""
        out = np.full(len(tokens), np.nan)
        kind, start, end, odd = self._bounds(tokens)
        held = ((kind == STR) | (kind == SCALAR)) & (end > start)
        raw = self.slices(start, end)
        plain = held & ~odd & np.asarray(pc.match_substring_regex(raw, PLAIN).to_numpy(zero_copy_only=False), bool)
        i = np.flatnonzero(plain)
        out[i] = raw.take(pa.array(i)).cast(pa.large_string()).cast(pa.float64()).to_numpy()
        for i in np.flatnonzero(held & ~plain).tolist():
            text = self.string(int(tokens[i])).encode("utf-8", "replace") if odd[i] else self.raw[start[i] : end[i]]
            if NUMBER.fullmatch(text):
                out[i] = float(text)
        return out

    def elements(self, containers: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """(place in ``containers``, index, token) of each object held by arrays; an object in place of an array is its own element 0."""
        mine = np.full(len(self.pos) + 1, -1, np.int64)
        kinds = self.kind_of(containers)
        arrays, single = np.flatnonzero(kinds == ARR), np.flatnonzero(kinds == OBJ)
        mine[containers[arrays]] = arrays
        t = np.flatnonzero(self.kind == OBJ)
        own = mine[self.parent[t]]
        t, own = t[(own >= 0) & (self.parent[t] >= 0)], own[(own >= 0) & (self.parent[t] >= 0)]
        who, idx, tok = np.concatenate([own, single]), np.concatenate([self.ordinal[t] // 2, np.zeros(len(single), np.int64)]), np.concatenate([t, containers[single]])
        order = np.argsort(who, kind="stable")
        return who[order], idx[order], tok[order]

    def items(self, containers: np.ndarray, size: int) -> np.ndarray:
        """(containers, size) tokens of arrays that hold exactly ``size`` values; -1 elsewhere."""
        out = np.full((len(containers), size), -1, np.int64)
        mine = np.full(len(self.pos) + 1, -1, np.int64)
        arrays = np.flatnonzero(self.kind_of(containers) == ARR)
        mine[containers[arrays]] = arrays
        t = np.flatnonzero(self.is_value & ~self.in_obj & (self.parent >= 0))
        own = mine[self.parent[t]]
        t, own = t[own >= 0], own[own >= 0]
        counts = np.bincount(own, minlength=len(containers)) if len(own) else np.zeros(len(containers), int)
        fits = counts[own] == size
        out[own[fits], self.ordinal[t[fits]] // 2] = t[fits]
        return out
