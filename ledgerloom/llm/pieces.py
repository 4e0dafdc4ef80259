"""Vectorised pre-tokens of byte-level BPE vocabularies, and a bounded memo from pre-token to ids.

The split is that of the pattern 's|'t|'re|'ve|'m|'ll|'d| ?\\p{L}+| ?\\p{N}+| ?[^\\s\\p{L}\\p{N}]+|\\s+(?!\\S)|\\s+, found for a
whole chunk of texts at once from character classes. Every pre-token is hashed; a direct-mapped table of fixed size
answers for those met before, the rest are encoded once each. Characters that this Python's Unicode tables don't
know are classed by the library's own pre-tokenizer, when one is met.

A text longer than a chunk is read in windows. What a window's end may still change is held back: its last pre-token,
and the two characters that a contraction may take. A pre-token longer than a window is encoded as it streams.
"""

from __future__ import annotations

import functools
import unicodedata
from collections.abc import Callable, Iterable, Iterator, Sequence

import numpy as np

from . import wordkernel as wk

LETTER, NUMBER, SPACE, OTHER, NONE, UNKNOWN = range(6)
SPECIAL = "<|endoftext|>"
WINDOW = 1 << 20


@functools.cache
def _classes() -> np.ndarray:
    kind = {"L": LETTER, "N": NUMBER}
    out = np.array([UNKNOWN if (c := unicodedata.category(chr(i))) == "Cn" else kind.get(c[0], OTHER) for i in range(0x110000)], np.uint8)
    out[[*range(9, 14), 0x20, 0x85, 0xA0, 0x1680, *range(0x2000, 0x200B), 0x2028, 0x2029, 0x202F, 0x205F, 0x3000]] = SPACE
    return out


def classes(cp: np.ndarray) -> np.ndarray:
    """The class of each code point."""
    known = _classes()
    out = known[cp]
    new = np.unique(cp[out == UNKNOWN])
    if len(new):
        from tokenizers.pre_tokenizers import ByteLevel

        split = ByteLevel(add_prefix_space=False, use_regex=True).pre_tokenize_str
        for c in new.tolist():
            whole = [len(split(x + chr(c))) == 1 for x in "a1!"]
            known[c] = whole.index(True) if whole[:2] != [False, False] else OTHER
        out = known[cp]
    return out


@functools.cache
def _values() -> np.ndarray:
    return wk.mix(np.arange(1, 0x110001, dtype=np.uint64))


def starts(cp: np.ndarray, first: np.ndarray) -> np.ndarray:
    """Index of the first character of every pre-token; first: where each text begins, and the end."""
    n = len(cp)
    if not n:
        return np.zeros(0, np.int64)
    cls = classes(cp)
    head = np.zeros(n + 1, bool)
    head[first] = True
    prev = np.full(n, NONE, np.uint8)
    prev[1:] = cls[:-1]
    prev[head[:n]] = NONE
    white = cls == SPACE
    follows = np.zeros(n, bool)
    follows[:-1] = ~white[1:] & ~head[1:n]
    joins = np.zeros(n, bool)
    joins[1:] = cp[:-1] == 0x20
    joins &= ~head[:n]
    begin = np.where(white, (prev != SPACE) | follows, (cls != prev) & ~joins) | head[:n]
    quotes = np.flatnonzero((cp == 0x27) & begin)
    if len(quotes):
        pad = np.concatenate([cp, np.zeros(2, cp.dtype)])
        edge = np.concatenate([head, np.ones(2, bool)])
        a, b = pad[quotes + 1], pad[quotes + 2]
        one = np.isin(a, [ord(c) for c in "stmd"]) & ~edge[quotes + 1]
        two = (((a == ord("r")) | (a == ord("v"))) & (b == ord("e")) | (a == ord("l")) & (b == ord("l"))) & ~edge[quotes + 1] & ~edge[quotes + 2]
        for q, size in ((quotes[one], 2), (quotes[two], 3)):
            begin[q + 1] = False
            after = q + size
            begin[after[after < n]] = True
    return np.flatnonzero(begin)


class Encoder:
    """Ids of whole texts, by chunk. encode: a list of pre-tokens to a list of id lists; stream: the parts of one
    pre-token to its ids."""

    def __init__(self, encode: Callable[[list[str]], Sequence[Sequence[int]]], special_id: int, stream: Callable[[Iterable[bytes]], Iterator[int]] | None = None, slots: int = 1 << 21, most: int = 1 << 20):
        self.encode_pieces, self.special_id, self.most = encode, special_id, most
        self.stream = stream or (lambda parts: iter(encode([b"".join(parts).decode()])[0]))
        self.mask = np.uint64(slots - 1)
        self.key, self.at = np.zeros(slots, np.uint64), np.zeros(slots, np.int32)
        self.clear()

    def clear(self) -> None:
        self.key[:] = 0
        self.off, self.len, self.ids = np.zeros(0, np.int64), np.zeros(0, np.int64), np.zeros(0, np.int32)

    def chunk(self, data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Ids of all rows of UTF-8 data, and where each row's begin."""
        raw = data.tobytes()
        if SPECIAL.encode() in raw:
            return self._special(raw, offsets)
        text = raw.decode()
        cp = np.frombuffer(text.encode("utf-32-le", "surrogatepass"), np.uint32)
        count = np.zeros(len(data) + 1, np.int64)
        np.cumsum((data & 0xC0) != 0x80, out=count[1:])
        first = count[offsets]
        begin = starts(cp, first)
        if not len(begin):
            return np.zeros(0, np.int32), np.zeros(len(offsets), np.int64)
        end = np.append(begin[1:], len(cp))
        h = wk.segment_hash(_values()[cp], begin, end, wk._BASE)
        if len(self.len) > self.most:
            self.clear()
        slot = h & self.mask
        entry, miss = self.at[slot], np.flatnonzero(self.key[slot] != h)
        if len(miss):
            fresh, one, back = np.unique(h[miss], return_index=True, return_inverse=True)
            one = miss[one]
            got = self.encode_pieces([text[s:e] for s, e in zip(begin[one].tolist(), end[one].tolist(), strict=True)])
            size = np.fromiter(map(len, got), np.int64, len(got))
            entry[miss] = back + len(self.len)
            where = fresh & self.mask
            self.key[where], self.at[where] = fresh, np.arange(len(fresh)) + len(self.len)
            self.off = np.concatenate([self.off, np.cumsum(size) - size + len(self.ids)])
            self.len = np.concatenate([self.len, size])
            self.ids = np.concatenate([self.ids, np.fromiter((i for x in got for i in x), np.int32, int(size.sum()))])
        size = self.len[entry]
        stop = np.zeros(len(size) + 1, np.int64)
        np.cumsum(size, out=stop[1:])
        ids = self.ids[np.arange(stop[-1]) + np.repeat(self.off[entry] - stop[:-1], size)]
        return ids, stop[np.searchsorted(begin, first)]

    def long(self, data: np.ndarray, window: int = WINDOW) -> Iterator[np.ndarray]:
        """Ids of one text, window by window."""
        mark = SPECIAL.encode()
        raw, at = memoryview(data), 0
        find = data.tobytes().find if len(data) <= window else functools.partial(_find, raw)
        while True:
            cut = find(mark, at)
            yield from self._plain(raw[at : cut if cut >= 0 else len(raw)], window)
            if cut < 0:
                return
            yield np.array([self.special_id], np.int32)
            at = cut + len(mark)

    def _plain(self, raw: memoryview, window: int) -> Iterator[np.ndarray]:
        at, size = 0, len(raw)
        while at < size:
            end = min(size, at + window)
            while end < size and raw[end] & 0xC0 == 0x80:
                end -= 1
            if end < size:
                text = bytes(raw[at:end]).decode()
                cp = np.frombuffer(text.encode("utf-32-le", "surrogatepass"), np.uint32)
                begin = starts(cp, np.zeros(1, np.int64))
                begin = begin[begin < len(cp) - 3]
                if begin[-1] == 0:  # one pre-token fills the window
                    parts = _Giant(raw, at, window, int(classes(cp[min(1, len(cp) - 1) :][:1])[0]), cp)
                    for ids in _batched(self.stream(parts)):
                        yield np.array(ids, np.int32)
                    at = parts.end
                    continue
                end = at + len(text[: int(begin[-1])].encode())
            part = np.frombuffer(raw[at:end], np.uint8)
            yield self.chunk(part, np.array([0, len(part)]))[0]
            at = end

    def _special(self, raw: bytes, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        mark = SPECIAL.encode()
        rows = [raw[s:e].split(mark) for s, e in zip(offsets[:-1].tolist(), offsets[1:].tolist(), strict=True)]
        out, stop = [], [0]
        for parts in rows:
            ids: list[np.ndarray] = []
            for k, part in enumerate(parts):
                if k:
                    ids.append(np.array([self.special_id], np.int32))
                ids.append(self.chunk(np.frombuffer(part, np.uint8), np.array([0, len(part)]))[0])
            out.append(np.concatenate(ids))
            stop.append(stop[-1] + len(out[-1]))
        return np.concatenate(out), np.array(stop)


def _find(raw: memoryview, mark: bytes, at: int, window: int = WINDOW) -> int:
    """bytes.find over a view, window by window."""
    while at < len(raw):
        found = bytes(raw[at : at + window + len(mark)]).find(mark)
        if found >= 0:
            return at + found
        at += window
    return -1


def _batched(ids: Iterator[int], most: int = 1 << 16) -> Iterator[list[int]]:
    held: list[int] = []
    for i in ids:
        held.append(i)
        if len(held) == most:
            yield held
            held = []
    if held:
        yield held


class _Giant:
    """Bytes, in parts, of a pre-token that goes on over windows; end: where it ends. White space gives its last
    character up to what follows it."""

    def __init__(self, raw: memoryview, at: int, window: int, kind: int, cp: np.ndarray):
        self.raw, self.at, self.window, self.kind, self.end = raw, at, window, kind, at

    def __iter__(self) -> Iterator[bytes]:
        at, size, first = self.at, len(self.raw), True
        while at < size:
            end = min(size, at + self.window)
            while end < size and self.raw[end] & 0xC0 == 0x80:
                end -= 1
            text = bytes(self.raw[at:end]).decode()
            cp = np.frombuffer(text.encode("utf-32-le", "surrogatepass"), np.uint32)
            same = classes(cp) == self.kind
            if first:
                same[0] = True
            stop = len(cp) if same.all() else int(np.argmin(same))
            over = stop < len(cp)
            if self.kind == SPACE and not over and end < size:  # hold the last one back
                stop -= 1
            if self.kind == SPACE and over and stop > 1:
                stop -= 1
            part = text[:stop].encode()
            yield part
            at += len(part)
            self.end, first = at, False
            if over:
                return
