"""SentencePiece models of merge type (BPE): encoding by backtracking, and decoding.

Merging joins, again and again, the neighbours whose joined piece has the highest score, leftmost first. A sequence of
pieces is what merging makes of a text if and only if each two neighbours are what merging makes of the two joined.
So the sequence can be found from left to right: take the longest piece at a place (Aho-Corasick finds all pieces in one
pass); if it doesn't go with the piece before it, a shorter prefix; if none does, the place has failed for good (every
prefix of the text has one sequence only), is marked so in a bitfield, and the piece before it becomes shorter.
Whether two pieces go together is asked of merging itself, on the few letters of the two, and remembered.

A text is cut where no piece of the model has the two letters side by side, as before a space that follows a letter;
each distinct part is encoded once and kept in the bounded table of `tokens.Encoder`.
"""

from __future__ import annotations

from functools import lru_cache

import ahocorasick
import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import column, text_pieces, unused
from .tokens import SLOTS, Encoder

#: Stands for a space in pieces.
SPACE = "▁"
#: Answers that are remembered: whether two pieces go together; ids of parts that the table of parts doesn't hold.
PAIRS, LONG_PARTS = 1 << 17, 1 << 15


class Merges:
    """The pieces of a model, and the sequence of pieces of a text."""

    def __init__(self, path: str):
        from sentencepiece import SentencePieceProcessor

        model = SentencePieceProcessor(model_file=path)
        plain = [i for i in range(len(model)) if not (model.is_control(i) or model.is_unknown(i) or model.is_byte(i) or model.is_unused(i))]
        self.bytes_of = {int(model.id_to_piece(i)[3:5], 16): i for i in range(len(model)) if model.is_byte(i)}
        self.end_id = model.eos_id()
        probe = "  ﬁ Å  a\t"
        if model.normalize(probe) != SPACE + probe.replace(" ", SPACE) or len(self.bytes_of) != 256 or self.end_id < 0:
            raise ValueError("a model that keeps texts as they are, with a space before them, byte pieces and an end piece is needed")
        self.ids = {model.id_to_piece(i): i for i in plain}
        self.scores = {model.id_to_piece(i): model.get_score(i) for i in plain if len(model.id_to_piece(i)) > 1}
        self.automaton = ahocorasick.Automaton()
        for piece in self.scores:
            self.automaton.add_word(piece, len(piece))
        self.automaton.make_automaton()
        self.fits = lru_cache(PAIRS)(lambda a, b: self.merged(a + b) == [a, b])
        self.reachable = lru_cache(None)(lambda piece: self.merged(piece) == [piece])  # as many as the model has pieces
        self.shorter = lru_cache(None)(self._shorter)

    def merged(self, text: str) -> list[str]:
        """Plain merging: for texts of a few letters."""
        out = list(text)
        while True:
            scores = [self.scores.get(a + b, -np.inf) for a, b in zip(out, out[1:], strict=False)]
            if not scores or (best := max(scores)) == -np.inf:
                return out
            i = scores.index(best)
            out[i : i + 2] = [out[i] + out[i + 1]]

    def _shorter(self, piece: str) -> str:
        """The longest piece that a longer one begins with; a single letter is always one."""
        return next((p for k in range(len(piece) - 1, 1, -1) if (p := piece[:k]) in self.scores and self.reachable(p)), piece[0])

    def pieces(self, text: str) -> list[str]:
        longest = [1] * len(text)
        for end, size in self.automaton.iter(text):
            start = end - size + 1
            if size > longest[start] and self.reachable(text[start : end + 1]):
                longest[start] = size
        out: list[str] = []
        failed, at, n = bytearray(len(text) // 8 + 1), 0, len(text)
        piece = text[: longest[0]] if n else ""
        while at < n:
            end = at + len(piece)
            if not failed[end >> 3] >> (end & 7) & 1 and (not out or self.fits(out[-1], piece)):
                out.append(piece)
                at = end
                piece = text[at : at + longest[at]] if at < n else ""
            elif len(piece) > 1:
                piece = self.shorter(piece)
            else:
                failed[at >> 3] |= 1 << (at & 7)
                piece = out.pop()
                at -= len(piece)
        return out

    def encode(self, text: str) -> list[int]:
        """Ids of a part of a text, in which spaces stand for themselves; a letter without a piece is its bytes."""
        out = []
        for piece in self.pieces(text.replace(" ", SPACE)):
            known = self.ids.get(piece)
            out += [known] if known is not None else [self.bytes_of[b] for b in piece.encode()]
        return out


class PieceEncoder(Encoder):
    """Whole-text encoding: parts of texts by Merges, those of few bytes kept in a table of arrays."""

    def __init__(self, path: str, slots: int = SLOTS):
        self.merges = Merges(path)
        self._set_up(slots)
        self.long_part = lru_cache(LONG_PARTS)(lambda part: tuple(self.merges.encode(part)))
        pairs = {(a, b) for piece in self.merges.scores for a, b in zip(piece, piece[1:], strict=False)}
        #: Whether two bytes side by side may be in one piece; unknown, so true, beyond ASCII.
        self.joined = np.ones((256, 256), bool)
        self.joined[:128, :128] = False
        for a, b in pairs:
            a, b = a.replace(SPACE, " "), b.replace(SPACE, " ")
            if a < "\x80" and b < "\x80":
                self.joined[ord(a), ord(b)] = True
        if not any(b == SPACE and a >= "\x80" and a != SPACE for a, b in pairs):
            self.joined[128:, 0x20] = False
            self.joined[SPACE.encode()[-1], 0x20] = True  # the sign itself before a space

    def _ids(self, pieces: list[str]) -> tuple[np.ndarray, np.ndarray]:
        ids = [self.long_part(p) if len(p) < 256 else self.merges.encode(p) for p in pieces]
        counts = np.fromiter(map(len, ids), np.int64, len(ids))
        return np.fromiter((i for x in ids for i in x), np.uint32, int(counts.sum())), counts

    def encode(self, data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Ids of all rows one after another without the end id, and the rows' offsets in them; every text that isn't empty gets a space before it."""
        filled = offsets[:-1] < offsets[1:]
        data = np.insert(data, offsets[:-1][filled], 0x20)
        return self._rows(data, offsets + np.append(0, np.cumsum(filled)))

    def _cuts(self, data: np.ndarray) -> np.ndarray:
        return ~self.joined[data[:-1], data[1:]]


@lru_cache(maxsize=2)
def encoder(path: str) -> PieceEncoder:
    """One for each Python worker, kept from task to task."""
    return PieceEncoder(path)


def encode(docs: DataFrame, model: str, text: str = "text") -> DataFrame:
    """The table with one more column, ids: the pieces of each text and the end id; null or empty gives the end id alone.

    Every row has one row, repeated ones too. A column of the name `ids` is left alone (the new one gets underscores).
    """
    (name,) = unused(docs, "ids")

    @F.arrow_udf("array<int>")
    def ids_of(texts: pa.Array) -> pa.Array:
        own, parts = encoder(model), []
        for _, _, data, offsets in text_pieces(texts):
            ids, ends = own.encode(data, offsets)
            ids, ends = np.insert(ids.astype(np.int32), ends[1:], own.merges.end_id), ends + np.arange(len(ends))
            parts.append(pa.ListArray.from_arrays(pa.array(ends, pa.int32()), pa.array(ids)))
        return pa.concat_arrays(parts) if parts else pa.array([], pa.list_(pa.int32()))

    return docs.withColumn(name, ids_of.asNondeterministic()(column(text)))  # so that it is not evaluated once for each use of the column


def decode(tokens: DataFrame, model: str, ids: str = "ids") -> DataFrame:
    """The table with one more column, decoded: the text of each row's ids by the library; null ids give null."""
    (name,) = unused(tokens, "decoded")

    @F.arrow_udf("string")
    def text_of(rows: pa.Array) -> pa.Array:
        own = _library(model)
        return pa.array([own.decode(x.values.to_numpy(zero_copy_only=False).tolist()) if x.is_valid else None for x in rows], pa.string())

    return tokens.withColumn(name, text_of.asNondeterministic()(column(ids)))


@lru_cache(maxsize=2)
def _library(model: str):
    from sentencepiece import SentencePieceProcessor

    return SentencePieceProcessor(model_file=model)
