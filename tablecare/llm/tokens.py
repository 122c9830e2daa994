"""Token ids of whole texts by the tokenizers library, each distinct piece of text encoded once.

Byte-level BPE of this kind splits a text by a pattern before it merges anything, and the pattern always splits
before ASCII white space that follows something else, and between an ASCII letter and ASCII punctuation. Texts are
cut at those places only, each distinct piece goes through the library once, and ids are put together again.

Pieces of up to SHORT bytes are kept between batches in a hash table of arrays: a piece is two 64-bit numbers (its
bytes and its length), so a hit is exact, and a table of SLOTS places takes 22 bytes a place. When it is full, pieces
that were met in many batches stay. Longer pieces are encoded anew in each batch. Both bound memory only.
"""

from __future__ import annotations

import zlib
from functools import lru_cache

import numpy as np
import pyarrow as pa

from .common import ragged, slices

#: Ends every document.
END_ID = 0
#: Bytes of a piece that is kept, places of the table, the share of them in use at most, pieces worked on at a time.
SHORT, SLOTS, FULL, PIECES_AT_ONCE = 15, 1 << 20, 0.6, 200_000

_KIND = np.zeros(256, np.uint8)
_KIND[[0x20, 0x09, 0x0A, 0x0D]] = 1
_KIND[[c for c in range(128) if chr(c).isalpha()]] = 2
_KIND[[c for c in range(33, 127) if not chr(c).isalnum()]] = 3
#: White space outside space, tab and line ends, or what some table might call so: (first, last) code points.
_OTHER_SPACE = ((0x0B, 0x0C), (0x1C, 0x1F), (0x85, 0x85), (0xA0, 0xA0), (0x1680, 0x1680), (0x180E, 0x180E), (0x2000, 0x200F), (0x2028, 0x202F), (0x205F, 0x2060), (0x3000, 0x3000), (0xFEFF, 0xFEFF))
_SPACES = [chr(c).encode() for a, b in _OTHER_SPACE for c in range(a, b + 1)]
_SPACE_HEAD = np.zeros(256, bool)
_SPACE_HEAD[[s[0] for s in _SPACES]] = True
_KEEP = np.array([(1 << 8 * k) - 1 for k in range(9)], np.uint64)


def _after_other_space(data: np.ndarray) -> np.ndarray:
    """Places right after a white-space character of _OTHER_SPACE."""
    head = np.flatnonzero(_SPACE_HEAD[data])
    if not len(head):
        return head
    padded = np.concatenate([data[: int(head[-1]) + 3], np.zeros(2, np.uint8)])
    code = padded[head].astype(np.uint32) | padded[head + 1].astype(np.uint32) << 8 | padded[head + 2].astype(np.uint32) << 16
    out = []
    for n in (1, 2, 3):
        known = [int.from_bytes(s, "little") for s in _SPACES if len(s) == n]
        out.append(head[np.isin(code & ((1 << 8 * n) - 1), np.array(known, np.uint32))] + n)
    return np.concatenate(out)


class Encoder:
    """Whole-text encoding with a bounded table of pieces."""

    def __init__(self, path: str, slots: int = SLOTS):
        import os

        os.environ["TOKENIZERS_PARALLELISM"] = "false"  # one core a task
        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_file(path)
        self.tokenizer.encode_special_tokens = True
        self._set_up(slots)

    def _set_up(self, slots: int) -> None:
        self.at_once = min(PIECES_AT_ONCE, slots // 4)  # so that a call's new pieces always have room
        self.slots, self.shift = slots, np.uint64(64 - (slots.bit_length() - 1))
        self._clear()

    def _clear(self) -> None:
        self.low, self.high = np.zeros(self.slots, np.uint64), np.zeros(self.slots, np.uint64)  # high is 0 where a place is free
        self.begin, self.count, self.met = np.zeros(self.slots, np.int32), np.zeros(self.slots, np.uint8), np.zeros(self.slots, np.uint8)
        self.flat, self.used, self.pieces = np.zeros(1 << 16, np.uint32), 0, 0

    def _home(self, low: np.ndarray, high: np.ndarray) -> np.ndarray:
        mixed = (low ^ high * np.uint64(0x9E3779B97F4A7C15)) * np.uint64(0xD6E8FEB86659FD93)
        return (((mixed ^ mixed >> np.uint64(32)) * np.uint64(0xBF58476D1CE4E5B9)) >> self.shift).astype(np.int64)

    def _find(self, low: np.ndarray, high: np.ndarray) -> np.ndarray:
        """Each key's place, or -1."""
        slot, out, open_ = self._home(low, high), np.full(len(low), -1, np.int64), np.arange(len(low))
        while len(open_):
            at = slot[open_]
            held = self.high[at]
            same = (held == high[open_]) & (self.low[at] == low[open_])
            out[open_[same]] = at[same]
            open_ = open_[~same & (held != 0)]
            slot[open_] = (slot[open_] + 1) & (self.slots - 1)
        return out

    def _insert(self, low: np.ndarray, high: np.ndarray) -> np.ndarray:
        """Places of new, distinct keys."""
        slot, open_ = self._home(low, high), np.arange(len(low))
        while len(open_):
            free = open_[self.high[slot[open_]] == 0]
            _, first = np.unique(slot[free], return_index=True)
            won = free[first]
            self.low[slot[won]], self.high[slot[won]] = low[won], high[won]
            lost = np.ones(len(low), bool)
            lost[won] = False
            open_ = open_[lost[open_]]
            # Places taken by another key, also just now, are left for the next.
            taken = open_[self.high[slot[open_]] != 0]
            slot[taken] = (slot[taken] + 1) & (self.slots - 1)
        self.pieces += len(low)
        return slot

    def _hold(self, ids: np.ndarray, extra: np.ndarray) -> None:
        """Append ids that stay, and after them some that the next call may overwrite."""
        total = self.used + len(ids) + len(extra)
        while total > len(self.flat):
            self.flat = np.concatenate([self.flat, np.zeros_like(self.flat)])
        self.flat[self.used : self.used + len(ids)] = ids
        self.used += len(ids)
        self.flat[self.used : self.used + len(extra)] = extra

    def _shrink(self) -> None:
        """Keep the pieces met most often, half of what fits at most."""
        most = int(self.slots * FULL / 2)
        met = np.bincount(self.met[self.high != 0], minlength=256)
        least = int(np.flatnonzero(np.append(np.cumsum(met[::-1])[::-1], 0) <= most)[0])
        keep = np.flatnonzero((self.high != 0) & (self.met >= least))
        low, high, begin, count, times = self.low[keep], self.high[keep], self.begin[keep], self.count[keep], self.met[keep] // 2
        ids = self.flat[ragged(begin.astype(np.int64), count.astype(np.int64))]
        self._clear()
        self._hold(ids, np.zeros(0, np.uint32))
        at = self._insert(low, high)
        self.begin[at], self.count[at], self.met[at] = np.cumsum(count, dtype=np.int64) - count, count, times

    def _ids(self, pieces: list[str]) -> tuple[np.ndarray, np.ndarray]:
        ids = [e.ids for e in self.tokenizer.encode_batch_fast(pieces, add_special_tokens=False)]
        counts = np.fromiter(map(len, ids), np.int64, len(ids))
        return np.fromiter((i for x in ids for i in x), np.uint32, int(counts.sum())), counts

    def _encode(self, data: np.ndarray, words: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Ids of some pieces one after another, and how many each has. words: the 8 bytes from each place on."""
        if self.pieces > FULL * self.slots:
            self._shrink()
        size = ends - starts
        begin, count = np.zeros(len(starts), np.int64), np.zeros(len(starts), np.int64)
        short = np.flatnonzero(size <= SHORT)
        at, n = starts[short], size[short]
        low = words[at] & _KEEP[np.minimum(n, 8)]
        high = words[np.minimum(at + 8, len(words) - 1)] & _KEEP[np.maximum(n - 8, 0)] | n.astype(np.uint64) << np.uint64(56)
        slot = self._find(low, high)
        new = np.flatnonzero(slot < 0)
        ids = np.zeros(0, np.uint32)
        if len(new):
            order = new[np.lexsort((high[new], low[new]))]
            first = np.append(True, (low[order[1:]] != low[order[:-1]]) | (high[order[1:]] != high[order[:-1]]))
            one = order[first]
            ids, counts = self._ids(slices(data, at[one], at[one] + n[one]).cast(pa.large_string()).to_pylist())
            made = self._insert(low[one], high[one])
            self.begin[made], self.count[made] = self.used + np.cumsum(counts) - counts, counts
            slot[order] = made[np.cumsum(first) - 1]
        begin[short], count[short] = self.begin[slot], self.count[slot]
        self.met[slot] = np.minimum(self.met[slot], 254) + 1
        more = np.zeros(0, np.uint32)
        long_ = np.flatnonzero(size > SHORT)
        if len(long_):
            found = slices(data, starts[long_], ends[long_]).cast(pa.large_string()).dictionary_encode()
            more, counts = self._ids(found.dictionary.to_pylist())
            which = found.indices.to_numpy()
            begin[long_], count[long_] = (self.used + len(ids) + np.cumsum(counts) - counts)[which], counts[which]
        self._hold(ids, more)
        return self.flat[ragged(begin, count)], count

    def encode(self, data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Ids of all rows one after another without the end id, and the rows' offsets in them."""
        return self._rows(data, offsets)

    def _cuts(self, data: np.ndarray) -> np.ndarray:
        """Whether each place after the first may begin a piece."""
        kind = _KIND[data]
        cut = ((kind[1:] == 1) & (kind[:-1] != 1)) | ((kind[1:] == 3) & (kind[:-1] == 2))
        after = _after_other_space(data)
        cut[after[after < len(data)] - 1] = False
        return cut

    def _rows(self, data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        rows, size = len(offsets) - 1, len(data)
        if not size:
            return np.zeros(0, np.uint32), np.zeros(rows + 1, np.int64)
        cut = np.append(True, self._cuts(data))
        cut[offsets[:-1][offsets[:-1] < offsets[1:]]] = True
        starts = np.flatnonzero(cut)
        ends = np.append(starts[1:], size)
        padded = np.concatenate([data, np.zeros(16, np.uint8)])
        words = np.ndarray((size + 8,), "<u8", padded, strides=(1,))
        parts = [self._encode(data, words, starts[a : a + self.at_once], ends[a : a + self.at_once]) for a in range(0, len(starts), self.at_once)]
        total = np.concatenate([[0], np.cumsum(np.concatenate([n for _, n in parts]))])
        return np.concatenate([ids for ids, _ in parts]), total[np.searchsorted(starts, offsets, "left")]


@lru_cache(maxsize=2)
def encoder(path: str) -> Encoder:
    """One for each Python worker, kept from task to task."""
    return Encoder(path)


def with_end(ids: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The end id after every row."""
    return np.insert(ids, offsets[1:], END_ID), offsets + np.arange(len(offsets))


def crc_of(ids: np.ndarray) -> int:
    return zlib.crc32(np.ascontiguousarray(ids, "<u4"))
