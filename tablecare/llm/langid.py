"""Language identification by nearest centroids of TF-IDF n-gram vectors, with rejection by distance.

A text becomes hashed counts of its letter n-grams of one to three bytes (letters lower-cased, everything else one
space), dampened, weighted by inverse document frequency over all training documents, and normalised. Each language
has several centroids, clustered by cosine on a bounded sample of its documents. The nearest centroid names the
language; a text much further from it than the language's own texts of its length is rejected.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import byte_set, column, crc_of_id, text_pieces, unused

#: Hash buckets of n-grams, longest n-gram, centroids a language, steps of clustering.
DIMS, LONGEST, CENTROIDS, STEPS = 8192, 3, 4, 8
#: Documents a language that centroids are fitted on: that many are expected, FIT_MOST is never passed.
FIT_EXPECTED, FIT_MOST = 1000, 2000
#: Longer texts are nearer to their centroid, so floors go by the binary logarithm of a text's n-grams, from SHORT_CLASS (under
#: it nothing is rejected: a word or two tell too little) to LONG_CLASS (and all above). A floor is FLOOR_SHARE of the
#: similarity that FLOOR_QUANTILE of the class's fitted texts stay under; a class of under CLASS_LEAST texts joins the next longer one.
FLOOR_SHARE, FLOOR_QUANTILE, SHORT_CLASS, LONG_CLASS, CLASS_LEAST = 0.5, 0.01, 6, 12, 30

_LETTER = byte_set((0x61, 0x7A), (0x80, 0xFF))
_MIX = np.array([0x9E3779B1, 0x85EBCA77, 0xC2B2AE3D], np.uint32)


def counts(data: np.ndarray, offsets: np.ndarray, dims: int = DIMS) -> np.ndarray:
    """Hashed n-gram counts of lower-cased texts, a row each."""
    rows = len(offsets) - 1
    letter = _LETTER[data]
    keep = letter.copy()
    keep[1:] |= letter[:-1]
    filled = offsets[:-1] < offsets[1:]
    keep[offsets[:-1][filled]] = letter[offsets[:-1][filled]]
    text = np.where(letter, data, 0x20)[keep].astype(np.uint32)
    row = np.repeat(np.arange(rows), np.diff(offsets))[keep]
    out = np.zeros(rows * dims, np.float32)
    code = np.zeros(len(text), np.uint32)
    for n in range(1, LONGEST + 1):
        if len(text) < n:
            break
        code = code[: len(text) - n + 1] * np.uint32(0x01000193) + (text[n - 1 :] + np.uint32(n)) * _MIX[n - 1]
        whole = row[n - 1 :] == row[: len(text) - n + 1]
        if n == 1:
            whole &= text != 0x20
        cell = row[: len(whole)] * dims + (((code ^ code >> 15) * np.uint32(0x2C1B3C6D)) >> 12) % np.uint32(dims)
        out += np.bincount(cell[whole], minlength=rows * dims).astype(np.float32)
    return out.reshape(rows, dims)


def vectors(count: np.ndarray, idf: np.ndarray) -> np.ndarray:
    x = np.log1p(count) * idf
    norm = np.linalg.norm(x, axis=1, keepdims=True)
    return np.divide(x, norm, out=np.zeros_like(x), where=norm > 0)


def _pieces(texts: pa.Array, rows: int = 256) -> Iterator[tuple[int, int, np.ndarray]]:
    texts = pc.utf8_lower(pc.fill_null(texts, ""))
    for first in range(0, len(texts), rows):
        for a, b, data, offsets in text_pieces(texts.slice(first, rows)):
            yield first + a, first + b, counts(data, offsets)


def length_class(count: np.ndarray) -> np.ndarray:
    """0 for the shortest texts, which are never rejected, then one class for each doubling of n-grams."""
    n = np.log2(np.maximum(count.sum(axis=1), 1))
    return np.clip(np.floor(n).astype(np.int64) - SHORT_CLASS + 1, 0, LONG_CLASS - SHORT_CLASS + 1)


def floors_of(like: np.ndarray, kind: np.ndarray) -> list[float]:
    """The floor of every length class from the similarities of a language's fitted texts; never above the next longer class's."""
    out, held = [], np.zeros(0)
    above = np.inf
    for k in range(LONG_CLASS - SHORT_CLASS + 1, 0, -1):
        held = np.concatenate([held, like[kind == k]]) if len(held) < CLASS_LEAST else like[kind == k]
        if len(held) >= CLASS_LEAST:
            above = min(above, FLOOR_SHARE * float(np.quantile(held, FLOOR_QUANTILE)))
        elif len(held):  # too few to tell: half of what the next longer class asks for
            above = min(above, FLOOR_SHARE * float(held.min()))
        out.append(above if np.isfinite(above) else 0.0)
    return [0.0, *out[::-1]]


def cluster(x: np.ndarray, k: int = CENTROIDS, steps: int = STEPS) -> tuple[np.ndarray, np.ndarray]:
    """Unit centroids by cosine and each row's centroid; starts are rows far from one another."""
    picked = [int((x @ x.mean(axis=0)).argmax())]
    near = x @ x[picked[0]]
    while len(picked) < min(k, len(x)):
        picked.append(int(near.argmin()))
        near = np.maximum(near, x @ x[picked[-1]])
    centre = x[picked]
    for _ in range(steps):
        own = (x @ centre.T).argmax(axis=1)
        centre = np.stack([x[own == j].mean(axis=0) if (own == j).any() else centre[j] for j in range(len(centre))])
        norm = np.linalg.norm(centre, axis=1, keepdims=True)
        centre = np.divide(centre, norm, out=np.zeros_like(centre), where=norm > 0)
    return centre, (x @ centre.T).argmax(axis=1)


@dataclass
class Model:
    idf: np.ndarray
    langs: list[str] = field(default_factory=list)
    centres: np.ndarray = field(default_factory=lambda: np.zeros((0, DIMS), np.float32))
    floors: np.ndarray = field(default_factory=lambda: np.zeros((0, 1)))

    def predict(self, count: np.ndarray) -> tuple[list[int], np.ndarray, np.ndarray]:
        """Nearest centroid, similarity (0 to 1) and whether the text is near enough to it."""
        if not self.langs:
            return [-1] * len(count), np.zeros(len(count)), np.zeros(len(count), bool)
        like = vectors(count, self.idf) @ self.centres.T
        best = like.argmax(axis=1)
        score = np.clip(like[np.arange(len(like)), best].astype(float), 0, 1)
        return best.tolist(), score, score >= self.floors[best, length_class(count)]


def fit(docs: DataFrame) -> Model:
    """Learn from rows of docs (doc_id, text, lang) with a language.

    Document frequencies cover all rows. Centroids are fitted on the texts whose hash (of identifier and text) falls in a
    share that makes FIT_EXPECTED different ones of each language expected; copies count once. The driver receives DIMS
    numbers, and for each language its row count and CENTROIDS vectors of DIMS numbers; languages are few and named by people.
    """
    docs = docs.where(F.col("lang").isNotNull()).select("doc_id", "text", "lang")

    def frequencies(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        seen = np.zeros(DIMS, np.int64)
        for batch in batches:
            for _, _, count in _pieces(batch.column("text")):
                seen += (count > 0).sum(axis=0)
        used = np.flatnonzero(seen)
        yield pa.RecordBatch.from_arrays([pa.array(used), pa.array(seen[used])], ["cell", "n"])

    rows = {r.lang: r.n for r in docs.groupBy("lang").agg(F.count("*").alias("n")).collect()}
    df = np.zeros(DIMS)
    for r in docs.select("text").mapInArrow(frequencies, "cell long, n long").groupBy("cell").agg(F.sum("n").alias("n")).collect():
        df[r.cell] = r.n
    idf = (np.log((1 + sum(rows.values())) / (1 + df)) + 1).astype(np.float32)
    if not rows:
        return Model(idf)

    def centroids(group: pa.Table) -> pa.Table:
        group = group.sort_by("order").slice(0, FIT_MOST)
        x, kind = np.zeros((group.num_rows, DIMS), np.float32), np.zeros(group.num_rows, np.int64)
        for a, b, count in _pieces(group.column("text").combine_chunks(), 64):
            x[a:b], kind[a:b] = vectors(count, idf), length_class(count)
        some = np.flatnonzero(x.any(axis=1))
        if not len(some):
            return pa.table({"lang": pa.array([], pa.string()), "floors": pa.array([], pa.list_(pa.float64())), "centre": pa.array([], pa.binary())})
        x, kind = (x, kind) if len(some) == len(x) else (x[some], kind[some])
        centre, own = cluster(x)
        like = np.concatenate([(x[a : a + 256] @ centre.T)[np.arange(len(own[a : a + 256])), own[a : a + 256]] for a in range(0, len(x), 256)])
        return pa.table({"lang": [group["lang"][0].as_py()] * len(centre), "floors": [floors_of(like, kind)] * len(centre), "centre": [c.astype("<f4").tobytes() for c in centre]})

    share = F.create_map(*[F.lit(x) for lang, n in rows.items() for x in (lang, int(1e6 * min(1.0, FIT_EXPECTED / n)))])
    sample = docs.withColumn("order", F.xxhash64("doc_id", "text")).where(F.pmod("order", F.lit(1_000_000)) < F.element_at(share, F.col("lang")))
    sample = sample.groupBy("lang", "order").agg(F.any_value("text").alias("text"))
    found = sorted(sample.groupBy("lang").applyInArrow(centroids, "lang string, floors array<double>, centre binary").collect(), key=lambda r: (r.lang, bytes(r.centre)))
    return Model(idf, [r.lang for r in found], np.stack([np.frombuffer(r.centre, "<f4") for r in found]), np.array([r.floors for r in found])) if found else Model(idf)


def identify(docs: DataFrame, model: Model, prefix: str = "") -> DataFrame:
    """docs with <prefix>lang_pred, <prefix>score and <prefix>rejected for every row.

    A null text, or one without a letter, is `und` with score 0 and rejected; so is every text if the model knows no
    language. Any other text has the nearest centroid's language, rejected if it lies too far off. Existing columns
    keep their names and values; the three new ones replace columns of the same names.
    """

    @F.arrow_udf("struct<lang: string, score: double, near: boolean>")
    def nearest(texts: pa.Array) -> pa.Array:
        lang, score, near = [], [], []
        for _, _, count in _pieces(texts):
            best, like, ok = model.predict(count)
            lang += [model.langs[b] if b >= 0 else None for b in best]
            score.append(like)
            near.append(ok)
        flat = lambda x, kind: np.concatenate(x) if x else np.zeros(0, kind)
        return pa.StructArray.from_arrays([pa.array(lang, pa.string()), pa.array(flat(score, float)), pa.array(flat(near, bool))], ["lang", "score", "near"])

    nearest = nearest.asNondeterministic()  # so that a filter on what it gives does not evaluate it twice
    letters = F.coalesce(F.col("text").rlike(r"\p{L}"), F.lit(False))
    own = unused(docs, "nearest")[0]
    known = letters & F.col(f"{own}.lang").isNotNull()
    new = {f"{prefix}lang_pred": F.when(known, F.col(f"{own}.lang")).otherwise("und"), f"{prefix}score": F.when(known, F.col(f"{own}.score")).otherwise(0.0), f"{prefix}rejected": ~(known & F.col(f"{own}.near"))}
    return docs.withColumn(own, nearest(F.col("text"))).withColumns(new).drop(own)


def held_out(modulus: int = 4, remainder: int = 2):
    """Whether a document is kept from training, by its identifier; a null identifier is not."""
    return F.coalesce(F.pmod(crc_of_id(), F.lit(modulus)) == remainder, F.lit(False))


def keep_identified(docs: DataFrame) -> DataFrame:
    """Rows of docs (doc_id, text, lang, any others) whose text is not rejected, with the columns of docs.

    A null, an empty and a letterless text are rejected; a text of a word or two is not for its distance.
    """
    model = fit(docs.where(~held_out()))
    prefix = "own_"
    while {f"{prefix}{n}".lower() for n in ("lang_pred", "score", "rejected")} & {c.lower() for c in docs.columns}:
        prefix += "_"
    return identify(docs, model, prefix).where(~F.col(f"{prefix}rejected")).select(*[column(c) for c in docs.columns])
