"""Token ids of many texts at once: numpy finds the words of a batch, each different word is encoded once.

Texts of ASCII and accented Latin letters are joined to one buffer of bytes. Character
classes give the pieces of the vocabulary's split pattern (letters, single digits, runs of
other marks, English contractions), a rolling hash names each piece, and a table of fixed
size maps names to ids; a newer word takes the place of an older one in its slot. Pieces
longer than `LONGEST` bytes never use the table. Two different shorter pieces with one
64-bit name would be confused; that is the only way to differ from `WordBpe`. All other
texts go through `WordBpe` one by one.
"""

from __future__ import annotations

import re
from functools import lru_cache

import numpy as np

from tablesmith.llm.bpe import WordBpe, load
from tablesmith.llm.repeats import BYTE_VALUE, SPACE, Rolled

BATCH_BYTES = 1 << 20
SLOTS = 1 << 21
KEPT_IDS = 1 << 23
LONGEST = 32
LETTER, DIGIT, MARK, BLANK = 0, 1, 2, 3
KIND = np.full(256, MARK, np.uint8)
KIND[128:] = LETTER
KIND[ord("a"):ord("z") + 1] = LETTER
KIND[ord("0"):ord("9") + 1] = DIGIT
KIND[SPACE] = BLANK
# texts with anything but ASCII and Latin letters need the full pattern; so does I with a dot, whose small form is two characters
OTHER = re.compile("[^\x00-\x7f\xc0-\xd6\xd8-\xf6\xf8-įı-ɏ]|<\\|").search
GAP = re.compile(r"[ \t\n]").search


def pieces(b: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Start and stop of each piece of a lower-case text that ends with four blanks."""
    kind = KIND[b]
    change = np.empty(len(b), bool)
    change[0] = True
    np.not_equal(kind[1:], kind[:-1], out=change[1:])
    start = (change | (kind == DIGIT)) & (kind != BLANK)
    # a contraction: an apostrophe alone before s, t, m, d, re, ve or ll
    a = np.flatnonzero((b == 0x27) & start)
    a = a[kind[a + 1] == LETTER]
    x, y = b[a + 1], b[a + 2]
    one = (x == ord("s")) | (x == ord("t")) | (x == ord("m")) | (x == ord("d"))
    two = ((x == ord("r")) | (x == ord("v"))) & (y == ord("e")) | (x == ord("l")) & (y == ord("l"))
    a, ends = a[one | two], (a + np.where(one, 2, 3))[one | two]
    start[a + 1] = False
    start[ends[kind[ends] == LETTER]] = True
    edge = np.flatnonzero(start | (change & (kind == BLANK)))
    first = start[edge]
    return edge[first], np.append(edge[1:], len(b))[first]


def spread(first: np.ndarray, sizes: np.ndarray) -> np.ndarray:
    """first[k], first[k] + 1, ... sizes[k] numbers for each k."""
    ends = np.cumsum(sizes)
    out = np.repeat(first - (ends - sizes), sizes)
    out += np.arange(len(out))
    return out


class BatchBpe:
    def __init__(self, bpe: WordBpe):
        self.bpe = bpe
        self.clear()

    def clear(self) -> None:
        self.name = np.zeros(SLOTS, np.uint64)
        self.place = np.zeros(SLOTS, np.int32)
        self.size = np.zeros(SLOTS, np.int32)
        self.ids = np.zeros(1 << 16, np.uint32)
        self.used = 0

    def _keep(self, ids: list[int]) -> int:
        """Append ids to the buffer; their place."""
        at, self.used = self.used, self.used + len(ids)
        if self.used > len(self.ids):
            self.ids = np.concatenate([self.ids, np.zeros(max(len(self.ids), len(ids)), np.uint32)])
        self.ids[at:self.used] = ids
        return at

    def _batch(self, texts: list[bytes]) -> list[bytes]:
        """Ids of lower-case texts."""
        if self.used > KEPT_IDS:
            self.clear()
        raw = b" ".join(texts) + b"    "
        b = np.frombuffer(raw, np.uint8)
        start, stop = pieces(b)
        length = stop - start
        name = Rolled(BYTE_VALUE[b]).stretch(start, stop) | np.uint64(1)
        slot = (name >> np.uint64(20)) & np.uint64(SLOTS - 1)
        place, size = self.place[slot], self.size[slot]
        short = length <= LONGEST
        missing = np.flatnonzero((self.name[slot] != name) & short)
        word = self.bpe.encode_word
        if len(missing):
            names, one, which = np.unique(name[missing], return_index=True, return_inverse=True)
            found = [word(raw[start[k]:stop[k]].decode()) for k in missing[one].tolist()]
            at = np.array([self._keep(ids) for ids in found], np.int32)
            n = np.array([len(ids) for ids in found], np.int32)
            place[missing], size[missing] = at[which], n[which]
            slots = slot[missing[one]]
            self.name[slots], self.place[slots], self.size[slots] = names, at, n
        for k in np.flatnonzero(~short).tolist():
            ids = word(raw[start[k]:stop[k]].decode())
            place[k], size[k] = self._keep(ids), len(ids)
        ids = self.ids[spread(place.astype(np.int64), size.astype(np.int64))].astype("<u4").tobytes()
        # ids before each text's first piece
        before = np.concatenate([[0], np.cumsum(size, dtype=np.int64)])
        edges = np.cumsum([0] + [len(t) + 1 for t in texts])
        cut = (4 * before[np.searchsorted(start, edges)]).tolist()
        return [ids[i:j] for i, j in zip(cut, cut[1:])]

    def encode(self, texts: list[str]) -> list[bytes]:
        """Ids of each text as little-endian unsigned 32-bit integers."""
        out: list[list[bytes]] = [[] for _ in texts]
        waiting: list[tuple[int, bytes]] = []
        total = 0

        def flush() -> None:
            for (k, _), ids in zip(waiting, self._batch([t for _, t in waiting])):
                out[k].append(ids)
            waiting.clear()

        for k, text in enumerate(texts):
            if "<|" in text or not text.isascii() and OTHER(text):
                out[k].append(self.bpe.encode(text))
                continue
            at, text = 0, text.lower()
            while at < len(text):  # very long texts in parts that end at a blank
                gap = GAP(text, at + BATCH_BYTES)
                stop = gap.start() if gap else len(text)
                waiting.append((k, text[at:stop].encode()))
                total += len(waiting[-1][1])
                at = stop
                if total >= BATCH_BYTES:
                    flush()
                    total = 0
        if waiting:
            flush()
        return [x[0] if len(x) == 1 else b"".join(x) for x in out]


@lru_cache(maxsize=1)
def batch_encoder(vocabulary: str) -> BatchBpe:
    """One encoder for each worker process."""
    return BatchBpe(load(vocabulary))
