"""Near-duplicate documents by SimHash: tiled exact comparison of fingerprints, then connected components.

A fingerprint holds, bit by bit, the majority of the hashes of a text's shingles. Fingerprints are tiled, a tile's
members are packed into rows of bounded size, and two packed rows are compared whole with numpy exclusive-or and bit
counts. Only links that join parts (a spanning forest of each pair of rows) leave a task, so a large group of near
copies gives links in proportion to its size.

near_duplicates() links fingerprints of 64 bits that differ in `radius` bits at most. They are tiled by the population
counts of four lanes of 16 bits: two that are near have lane counts that differ by at most the radius in sum, so a tile
meets only its neighbours in that sense and all other tile pairs are skipped.

keep_one() wants the Jaccard similarity of shingle sets. Its fingerprints are of FINE_PARTS times 64 bits, enough for a
radius that reaches every similar pair and next to no other. Tiles are of similar numbers of shingles, as sets of
similarity t differ in size by a factor of 1 / t at most; packed rows whose population counts differ beyond the radius
are skipped. What the fingerprints propose is checked on the shingle sets themselves before it links.
"""

from __future__ import annotations

from collections.abc import Iterator
from itertools import product

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import NON_SPACE, column, drop_table, lower_ascii, materialize, mixed, ragged, runs, text_pieces, unused, word_codes

#: Differing bits of a link, words of a shingle, hash seed, fingerprints packed in a row, rounds of components at most.
RADIUS, SHINGLE_WORDS, SEED, TILE_ROWS, MAX_ROUNDS = 2, 3, 42, 2048, 60
LANES, LANE_BITS = 4, 16
#: Near copies: words of a shingle and least Jaccard similarity of a link.
NEAR_WORDS, NEAR_SIMILARITY = 5, 0.8
#: Words of 64 bits in their fingerprints, and bits that candidates differ by at most, in the first word and in all. A pair
#: at similarity 0.8 differs in 39 of 256 bits on average, with a standard deviation of 6, and in 49 of them where the sets
#: are very small; unrelated pairs differ in 128, with one of 8.
FINE_PARTS, FINE_FIRST, FINE_RADIUS = 4, 24, 72
#: Texts compared at a time, and bytes of their sets on average.
PART_TEXTS, PART_BYTES = 256, 4 << 20
#: Groups whose table is broadcast at most.
FEW_GROUPS = 100_000
#: Parts of a group, and rows of a tile, that one task compares with all others.
PARTS_A_TASK, ROWS_A_TASK = 2, 16
#: Near pairs that a task holds before it keeps a forest of them.
FOREST_PAIRS = 1 << 20
#: Shingles hashed at a time.
HASHED_AT_ONCE = 1 << 16
_STEPS = np.array([0, 0x9E3779B97F4A7C15, 0x3C6EF372FE94F82A, 0xDAA66D2C7DDF743F], np.uint64)


def shingles_of(data: np.ndarray, offsets: np.ndarray, words: int, seed: int = SEED) -> tuple[np.ndarray, np.ndarray]:
    """Hashes of all shingles, row after row, and how many each row has; a row with fewer words has one of them all."""
    starts, ends, row = runs(data, offsets, NON_SPACE)
    rows = len(offsets) - 1
    if not len(starts):
        return np.zeros(0, np.uint64), np.zeros(rows, np.int64)
    # Text with single spaces: a shingle is one slice of it.
    keep = NON_SPACE[data]
    keep[ends[ends < len(data)]] = True
    flat = np.where(NON_SPACE[data], data, 0x20)[keep].astype(np.uint8)
    moved = np.cumsum(keep, dtype=np.int32 if len(data) < 1 << 31 else np.int64)
    size = ends - starts
    starts = moved[starts] - 1
    ends = starts + size
    count = np.bincount(row, minlength=rows)
    del moved, keep, row, size
    first = np.cumsum(count) - count
    shingles = np.where(count, np.maximum(count - words + 1, 1), 0)
    owner = np.repeat(np.arange(rows), shingles)
    begin = np.arange(len(owner)) - np.repeat(np.cumsum(shingles) - shingles, shingles) + first[owner]
    stop = np.minimum(begin + words, first[owner] + count[owner]) - 1
    text, digest, hashes = flat.tobytes(), xxhash.xxh64_intdigest, np.zeros(len(owner), np.uint64)
    for at in range(0, len(owner), HASHED_AT_ONCE):
        part = slice(at, at + HASHED_AT_ONCE)
        hashes[part] = np.fromiter((digest(text[a:b], seed) for a, b in zip(starts[begin[part]].tolist(), ends[stop[part]].tolist(), strict=True)), np.uint64, len(owner[part]))
    return hashes, shingles


def majority(hashes: np.ndarray, parts: int = 1) -> np.ndarray:
    """`parts` 64-bit words: the bits set in over half of the hashes, and in over half of what they are mixed to."""
    ones = np.zeros(64 * parts, np.int64)
    for at in range(0, len(hashes), 255 * 64):
        part = hashes[at : at + 255 * 64]
        if parts > 1:
            part = np.concatenate([part[:, None], mixed(part[:, None] + _STEPS[None, 1:parts])], axis=1)
        bits = np.unpackbits(np.ascontiguousarray(part, "<u8").view(np.uint8).reshape(len(part), -1), axis=1, bitorder="little")
        full = len(bits) // 255 * 255  # sums of 255 bits fit into a byte
        ones += bits[:full].reshape(-1, 255, len(ones)).sum(axis=1, dtype=np.uint8).sum(axis=0, dtype=np.int64) + bits[full:].sum(axis=0, dtype=np.uint8)
    return np.packbits(2 * ones > len(hashes), bitorder="little").view("<u8").astype(np.uint64)


def fingerprints_of(data: np.ndarray, offsets: np.ndarray, words: int = SHINGLE_WORDS, seed: int = SEED) -> np.ndarray:
    """One unsigned 64-bit fingerprint a row: the majority of its shingles' hash bits."""
    hashes, shingles = shingles_of(data, offsets, words, seed)
    ends = np.cumsum(shingles)
    return np.array([majority(hashes[b - n : b])[0] for n, b in zip(shingles.tolist(), ends.tolist(), strict=True)], np.uint64)


def sets_of(data: np.ndarray, offsets: np.ndarray, words: int = NEAR_WORDS) -> Iterator[np.ndarray]:
    """The distinct 64-bit shingle hashes of each row, ascending, from the hashes of its words in lower case (A-Z)."""
    data = lower_ascii(data)
    starts, ends, row = runs(data, offsets, NON_SPACE)
    code = word_codes(data, starts, ends)
    bounds = np.searchsorted(row, np.arange(len(offsets)))
    whole = np.zeros(max(0, len(code) - words + 1), np.uint64)
    for k in range(words):
        whole = mixed(whole ^ code[k : k + len(whole)])
    for a, b in zip(bounds.tolist(), bounds[1:].tolist(), strict=False):
        if b - a >= words:
            yield np.unique(whole[a : b - words + 1])
        elif b > a:  # the whole text, told apart from a shingle by its number of words
            one = np.full(1, b - a, np.uint64)
            for k in range(a, b):
                one = mixed(one ^ code[k : k + 1])
            yield one
        else:
            yield np.zeros(0, np.uint64)


def fingerprint(text, words: int = SHINGLE_WORDS, seed: int = SEED):
    """The fingerprint of a text column as a signed long; null or no words: 0."""

    @F.arrow_udf("long")
    def of(texts: pa.Array) -> pa.Array:
        parts = [fingerprints_of(lower_ascii(data), offsets, words, seed) for _, _, data, offsets in text_pieces(texts)]
        return pa.array(np.concatenate(parts).view(np.int64) if parts else np.zeros(0, np.int64))

    return of(text)


def _neighbours(radius: int) -> list[tuple[int, ...]]:
    """Lane count differences of sum at most radius, one of each opposite two."""
    near = [d for d in product(range(-radius, radius + 1), repeat=LANES) if sum(map(abs, d)) <= radius]
    return [d for d in near if d >= (0,) * LANES]


def _join(label: np.ndarray, i: int, j: int) -> None:
    label[label == label[j]] = label[i]


def _parts(nodes: np.ndarray, label: np.ndarray) -> list[tuple[int, int]]:
    """(smallest node of a part, other node of it) for every part of several nodes."""
    order = np.lexsort((nodes, label))
    first = np.append(True, label[order[1:]] != label[order[:-1]])
    least = nodes[order][first][np.cumsum(first) - 1]
    return [(a, b) for a, b in zip(least.tolist(), nodes[order].tolist(), strict=True) if a != b]


def _forest(left: np.ndarray, right: np.ndarray, radius: int, same: bool) -> list[tuple[int, int]]:
    """Links between fingerprints (smallest of a part, member) that join what lies within radius in two rows."""
    nodes = left if same else np.concatenate([left, right])
    label, shift = np.arange(len(nodes)), 0 if same else len(left)
    for at in range(0, len(left), 256):
        near = np.bitwise_count(left[at : at + 256, None] ^ right[None, :]) <= radius
        if same:
            near &= np.arange(len(right))[None, :] > np.arange(at, at + len(near))[:, None]
        for i in np.flatnonzero(near.any(axis=1)):
            for own in np.unique(label[np.flatnonzero(near[i]) + shift]):
                if own != label[at + i]:
                    label[label == own] = label[at + i]
    return _parts(nodes, label)


def links(prints: DataFrame, radius: int = RADIUS, tile_rows: int = TILE_ROWS) -> DataFrame:
    """low, high: links of a spanning forest over distinct fingerprints (column fp, a table) at most radius bits apart."""
    steps = _neighbours(radius)
    lane = [F.bit_count(F.shiftrightunsigned("fp", LANE_BITS * i).bitwiseAND(F.lit((1 << LANE_BITS) - 1))).cast("long") for i in range(LANES)]
    #: Lane counts of -radius to 16 + radius in base 32.
    tile = sum((x + radius) * (32**i) for i, x in enumerate(lane))
    tiled = prints.select("fp", tile.alias("tile"))
    sizes = tiled.groupBy("tile").agg(F.ceil(F.count("*") / tile_rows).alias("parts"))
    packed = materialize(
        tiled.join(sizes, "tile").withColumn("part", F.pmod(F.xxhash64("fp"), F.col("parts")))
        .groupBy("tile", "part").agg(F.collect_list("fp").alias("members")), "tiles"
    )
    moves = F.array(*[F.lit(sum(d * (32**i) for i, d in enumerate(step))).cast("long") for step in steps])
    # A tile that meets one of many parts is met in several tasks: those parts are dealt out, and it goes to each.
    moved = lambda df: df.withColumn("move", F.explode(moves)).withColumns({"own": F.col("tile"), "tile": F.col("tile") + F.col("move")}).drop("move")
    salts = moved(sizes.where(F.col("parts") > ROWS_A_TASK)).groupBy("tile").agg(F.ceil(F.max("parts") / ROWS_A_TASK).alias("salts"))
    dealt = F.coalesce("salts", F.lit(1))
    left = moved(packed.withColumnRenamed("members", "left")).join(salts, "tile", "left").withColumn("salt", F.pmod("part", dealt)).drop("salts")
    right = packed.join(salts, "tile", "left").select("tile", F.col("part").alias("other"), F.col("members").alias("right"), F.explode(F.sequence(F.lit(0).cast("long"), dealt - 1)).alias("salt"))
    pairs = left.join(right, ["tile", "salt"]).where((F.col("own") != F.col("tile")) | (F.col("part") <= F.col("other")))

    def compare(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            own, tiles, part, other = (batch.column(c).to_numpy(zero_copy_only=False) for c in ("own", "tile", "part", "other"))
            found = []
            for k in range(batch.num_rows):
                a, b = (batch.column(c)[k].values.to_numpy(zero_copy_only=False).view(np.uint64) for c in ("left", "right"))
                found += _forest(a, b, radius, own[k] == tiles[k] and part[k] == other[k])
            if found:
                both = np.array(found, np.uint64).view(np.int64)
                yield pa.RecordBatch.from_arrays([pa.array(both[:, 0]), pa.array(both[:, 1])], ["low", "high"])

    return pairs.select("own", "tile", "part", "other", "left", "right").mapInArrow(compare, "low long, high long").distinct()


def components(edges: DataFrame, max_rounds: int = MAX_ROUNDS) -> DataFrame:
    """node, root: the smallest node reachable, for every node of edges (low, high).

    In a round each node goes to the least of itself and its neighbours, and on to where that one goes; then the edges are
    those between the places gone to, each once. So edges shrink from round to round, and none are left in the end.
    """
    both = materialize(edges.select(F.col("low").alias("a"), F.col("high").alias("b")).union(edges.select("high", "low")), "edges")
    labels = None
    for _ in range(max_rounds):
        hook = both.groupBy("a").agg(F.least(F.col("a"), F.min("b")).alias("to"))
        further = hook.select(F.col("a").alias("to"), F.col("to").alias("next"))
        moved = materialize(hook.join(further, "to").select(F.col("a").alias("node"), F.col("next").alias("root")), "moved")
        before, labels = labels, moved
        if before is not None:
            then = moved.select(F.col("node").alias("root"), F.col("root").alias("then"))
            labels = materialize(before.join(then, "root", "left").select("node", F.coalesce("then", "root").alias("root")), "labels")
            drop_table(before)
        ends = [moved.select(F.col("node").alias(x), F.col("root").alias(f"{x}_to")) for x in ("a", "b")]
        left = both.join(ends[0], "a").join(ends[1], "b").where("a_to != b_to").select(F.col("a_to").alias("a"), F.col("b_to").alias("b")).distinct()
        left = materialize(left, "edges")
        drop_table(both)
        if before is not None:
            drop_table(moved)
        both = left
        if both.isEmpty():
            drop_table(both)
            return labels
    raise RuntimeError(f"components not settled after {max_rounds} rounds")


def groups(docs: DataFrame, radius: int = RADIUS, words: int = SHINGLE_WORDS, seed: int = SEED) -> tuple[DataFrame, DataFrame]:
    """(members, classes): doc_id and fp of every row; fp, root, component_id of every distinct fingerprint."""
    members = materialize(docs.select("doc_id", fingerprint(F.col("text"), words, seed).alias("fp")), "prints")
    prints = materialize(members.groupBy("fp").agg(F.min("doc_id").alias("least")), "distinct")
    roots = components(links(prints, radius))
    rooted = prints.join(roots.withColumnRenamed("node", "fp"), "fp", "left").select("fp", "least", F.coalesce("root", "fp").alias("root"))
    least = rooted.groupBy("root").agg(F.min("least").alias("component_id"))
    return members, materialize(rooted.join(least, "root").select("fp", "root", "component_id"), "classes")


def near_duplicates(docs: DataFrame, radius: int = RADIUS, words: int = SHINGLE_WORDS, seed: int = SEED) -> DataFrame:
    """doc_id, fingerprint, component_id for every row of docs (doc_id, text): the smallest doc_id reachable over links.

    Null and empty texts have fingerprint zero and link like any other. Repeated rows stay, each with its component; a
    null doc_id is never the smallest unless its whole component is null. No rows give no rows.
    """
    members, classes = groups(docs, radius, words, seed)
    return members.join(classes, "fp").select("doc_id", F.lower(F.lpad(F.hex("fp"), 16, "0")).alias("fingerprint"), "component_id")


def _fine(texts: DataFrame) -> DataFrame:
    """doc_id, copy, node, size, p0, p1, ... of every row of texts (doc_id, copy, text): its shingle set's hash, size and fingerprint."""
    names = ["node", "size", *(f"p{i}" for i in range(FINE_PARTS))]
    kind = texts.schema["doc_id"].dataType.simpleString()

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for row, to, data, offsets in text_pieces(batch.column("text")):
                found = [(xxhash.xxh3_64_intdigest(x.tobytes()), len(x), *majority(x, FINE_PARTS).tolist()) for x in sets_of(data, offsets)]
                values = np.array(found, np.uint64).view(np.int64)
                own = [batch.column(c).slice(row, to - row) for c in ("doc_id", "copy")]
                yield pa.RecordBatch.from_arrays([*own, *(pa.array(np.ascontiguousarray(v)) for v in values.T)], ["doc_id", "copy", *names])

    return texts.mapInArrow(work, f"doc_id {kind}, copy long, " + ", ".join(f"{n} long" for n in names))


def _wide_forest(left: np.ndarray, right: np.ndarray, same: bool) -> list[tuple[int, int]]:
    """Candidate links of a least spanning forest, fewest differing bits first, of nodes (rows of node, p0, p1, ...)."""
    both = left if same else np.concatenate([left, right])
    label, shift = np.arange(len(both)), 0 if same else len(left)
    found = []
    for at in range(0, len(left), 128):
        i, j = np.nonzero(np.bitwise_count(left[at : at + 128, 1, None] ^ right[None, :, 1]) <= FINE_FIRST)
        i += at
        if same:
            later = j > i
            i, j = i[later], j[later]
        bits = np.bitwise_count(left[i, 1:] ^ right[j, 1:]).sum(axis=1, dtype=np.int64)
        near = bits <= FINE_RADIUS
        found.append(np.stack([bits[near], i[near], j[near] + shift]))
        if sum(x.shape[1] for x in found) > FOREST_PAIRS:
            found = [_least(found, label.copy())]
    pairs = _least(found, label)
    node = both[:, 0].view(np.int64)
    return list(zip(node[pairs[1]].tolist(), node[pairs[2]].tolist(), strict=True))


def _least(found: list[np.ndarray], label: np.ndarray) -> np.ndarray:
    """Of columns (bits, i, j) those of a least spanning forest."""
    pairs = np.concatenate(found, axis=1) if found else np.zeros((3, 0), np.int64)
    pairs = pairs[:, np.argsort(pairs[0], kind="stable")]
    keep = []
    step = max(256, pairs.shape[1] // 64)
    for at in range(0, pairs.shape[1], step):
        part = pairs[:, at : at + step]
        for k in np.flatnonzero(label[part[1]] != label[part[2]]):
            i, j = part[1, k], part[2, k]
            if label[i] != label[j]:
                _join(label, i, j)
                keep.append(at + k)
    return pairs[:, keep]


def candidates(prints: DataFrame, similarity: float = NEAR_SIMILARITY, tile_rows: int = TILE_ROWS) -> DataFrame:
    """low, high: links of least spanning forests over distinct nodes (a table of node, size, p0, ...) whose sizes and fingerprints are near."""
    words = [f"p{i}" for i in range(FINE_PARTS)]
    tile = F.floor(F.log(F.greatest(F.col("size"), F.lit(1)).cast("double")) / float(-np.log(similarity))).cast("int")
    ones = sum((F.bit_count(w) for w in words[1:]), F.bit_count(words[0])).cast("int")
    tiled = prints.select("node", *words, tile.alias("tile"), ones.alias("ones"))
    sizes = tiled.groupBy("tile").agg(F.ceil(F.count("*") / tile_rows).alias("parts"))
    packed = materialize(
        tiled.join(F.broadcast(sizes), "tile")  # a row for each power of 1 / similarity
        .withColumn("part", F.pmod(F.xxhash64("node"), F.col("parts")))
        .groupBy("tile", "part").agg(F.flatten(F.collect_list(F.array("node", *words))).alias("members"), F.min("ones").alias("least"), F.max("ones").alias("most")), "tiles"
    )
    # A tile that meets one of many parts is met in several tasks: those parts are dealt out, and it goes to each.
    meets = F.explode(F.array("tile", F.col("tile") + 1)).alias("meets")
    salts = sizes.select("parts", meets).select("meets", F.ceil(F.col("parts") / ROWS_A_TASK).cast("int").alias("salts")).groupBy("meets").agg(F.max("salts").alias("salts"))
    salts = F.broadcast(salts)  # as sizes
    left = packed.select("tile", "part", F.col("members").alias("left"), "least", "most", meets).join(salts, "meets").withColumn("salt", F.pmod("part", F.col("salts")).cast("int")).drop("salts")
    right = packed.select(F.col("tile").alias("meets"), F.col("part").alias("other"), F.col("members").alias("right"), F.col("least").alias("least2"), F.col("most").alias("most2")).join(salts, "meets").withColumn("salt", F.explode(F.sequence(F.lit(0), F.col("salts") - 1))).drop("salts")
    pairs = left.join(right, ["meets", "salt"]).where(((F.col("tile") != F.col("meets")) | (F.col("part") <= F.col("other"))) & (F.col("least") - F.col("most2") <= FINE_RADIUS) & (F.col("least2") - F.col("most") <= FINE_RADIUS))
    same = (F.col("tile") == F.col("meets")) & (F.col("part") == F.col("other"))

    def compare(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            found = []
            for a, b, one in zip(batch.column("left"), batch.column("right"), batch.column("same").to_pylist(), strict=True):
                x, y = (v.values.to_numpy(zero_copy_only=False).view(np.uint64).reshape(-1, 1 + FINE_PARTS) for v in (a, b))
                found += _wide_forest(x, y, one)
            yield _pairs(found)

    return pairs.select("left", "right", same.alias("same")).mapInArrow(compare, "low long, high long").distinct()


def _similar(a: np.ndarray, b: np.ndarray, similarity: float) -> bool:
    if min(len(a), len(b)) < similarity * max(len(a), len(b)):
        return False
    both = np.concatenate([a, b])
    both.sort(kind="stable")
    common = int((both[1:] == both[:-1]).sum())
    return common >= similarity * (len(a) + len(b) - common)


def _exact_forest(left: list[tuple], right: list[tuple] | None, similarity: float) -> list[tuple[int, int]]:
    """Links between nodes (node, label, fingerprint, set) of two parts, or within one, whose sets are similar enough.

    A node meets all candidates at once: the shingles it shares with each are counted in one pass over their sets. What
    shares a label, or is joined already, is no candidate.
    """
    both = left + (right or [])
    prints, size = np.stack([x[2] for x in both]), np.array([len(x[3]) for x in both])
    label = np.unique([x[1] for x in both], return_inverse=True)[1]
    place = np.unique(np.concatenate([x[3] for x in both]), return_inverse=True)[1] if size.any() else np.zeros(0, np.int64)
    ends = np.cumsum(size)
    held, out = np.zeros(len(place), bool), []
    for i in range(len(left)):
        away = np.arange(len(left) if right else i + 1, len(both))
        away = away[label[away] != label[i]]
        away = away[np.bitwise_count(prints[i] ^ prints[away]).sum(axis=1, dtype=np.int64) <= FINE_RADIUS]
        away = away[np.minimum(size[away], size[i]) >= similarity * np.maximum(size[away], size[i])]
        if not len(away) or not size[i]:
            continue
        own = place[ends[i] - size[i] : ends[i]]
        held[own] = True
        counts = np.concatenate([[0], np.cumsum(held[place[ragged(ends[away] - size[away], size[away])]])])
        held[own] = False
        stop = np.cumsum(size[away])
        common = counts[stop] - counts[stop - size[away]]
        for j in away[common >= similarity * (size[i] + size[away] - common)]:
            if label[i] != label[j]:
                out.append((both[i][0], both[j][0]))
                _join(label, i, j)
    return out


def _pairs(found: list[tuple[int, int]]) -> pa.RecordBatch:
    both = np.sort(np.array(found, np.int64).reshape(-1, 2), axis=1)
    return pa.RecordBatch.from_arrays([pa.array(both[:, 0]), pa.array(both[:, 1])], ["low", "high"])


def shingle_sets(texts: DataFrame, grouped: DataFrame, words: int = NEAR_WORDS) -> DataFrame:
    """node and its shingle set for every node of grouped (node, doc_id, copy), from the row of texts that stands for it."""
    chosen = texts.join(grouped, texts["doc_id"].eqNullSafe(grouped["doc_id"]) & (texts["copy"] == grouped["copy"]))

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for row, to, data, offsets in text_pieces(batch.column("text")):
                yield pa.RecordBatch.from_arrays([batch.column("node").slice(row, to - row), pa.array([x.tobytes() for x in sets_of(data, offsets, words)], pa.binary())], ["node", "set"])

    # Copies of one row under one identifier give their node several times: one stays.
    return chosen.select("node", "text").mapInArrow(work, "node long, set binary").dropDuplicates(["node"])


def verified(edges: DataFrame, sets: DataFrame, similarity: float = NEAR_SIMILARITY) -> DataFrame:
    """The links of edges (low, high) whose sets are similar enough."""
    a, b = (sets.select(F.col("node").alias(end), F.col("set").alias(f"{end}_set")) for end in ("low", "high"))

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            x, y = ([np.frombuffer(v.as_buffer(), np.uint64) for v in batch.column(c)] for c in ("low_set", "high_set"))
            yield batch.select(["low", "high"]).filter(pa.array([_similar(p, q, similarity) for p, q in zip(x, y, strict=True)], pa.bool_()))

    return edges.join(a, "low").join(b, "high").select("low", "high", "low_set", "high_set").mapInArrow(work, "low long, high long")


def similar_links(grouped: DataFrame, sets: DataFrame, similarity: float = NEAR_SIMILARITY) -> DataFrame:
    """low, high: links that join what is similar enough within proposed groups but not linked yet.

    grouped has node, root (the group), parts (how many it is cut into), label (what is linked already) and p0, p1, ... of
    each node. The parts of a group meet two by two.
    """
    names = [f"p{i}" for i in range(FINE_PARTS)]
    member = F.struct("node", "label", F.array(*names).alias("print"), "set")
    packed = materialize(
        grouped.join(sets, "node").select("root", "parts", F.pmod(F.xxhash64("node"), F.col("parts")).alias("part"), member.alias("m"))
        .groupBy("root", "parts", "part").agg(F.collect_list("m").alias("left")), "parts"
    )
    # Parts of a large group meet in several tasks: one side is dealt out, the other goes to each.
    salts = F.ceil(F.col("parts") / PARTS_A_TASK).cast("int")
    many = packed.where("parts > 1").withColumn("salts", salts)
    dealt = many.select("root", "part", "left", F.pmod("part", F.col("salts")).cast("int").alias("salt"))
    everywhere = many.select("root", F.col("part").alias("other"), F.col("left").alias("right"), F.explode(F.sequence(F.lit(0), F.col("salts") - 1)).alias("salt"))
    across = dealt.join(everywhere, ["root", "salt"]).where("part < other").select("left", "right")
    pairs = packed.select("left", F.lit(None).cast(packed.schema["left"].dataType).alias("right")).union(across)

    def members(cell: pa.Scalar) -> list[tuple] | None:
        if not cell.is_valid:
            return None
        value = cell.values
        prints = value.field("print").flatten().to_numpy(zero_copy_only=False).view(np.uint64).reshape(-1, FINE_PARTS)
        return list(zip(value.field("node").to_pylist(), value.field("label").to_pylist(), prints, (np.frombuffer(x.as_buffer(), np.uint64) for x in value.field("set")), strict=True))

    def compare(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            yield _pairs([x for a, b in zip(batch.column("left"), batch.column("right"), strict=True) for x in _exact_forest(members(a), members(b), similarity)])

    return pairs.mapInArrow(compare, "low long, high long").distinct()


def keep_one(docs: DataFrame, similarity: float = NEAR_SIMILARITY, words: int = NEAR_WORDS, part_texts: int = PART_TEXTS, tile_rows: int = TILE_ROWS) -> DataFrame:
    """The rows of docs without near copies: of each component the row with the smallest doc_id, with all columns.

    Two texts link where the Jaccard similarity of their sets of shingles (`words` words, A-Z in lower case; fewer words:
    the whole text) is at least `similarity`. Null and empty texts have the empty set and are copies of one another. Of
    repeated rows one stays; a null doc_id stays only where its whole component is null. No rows give no rows. Columns
    other than doc_id and text may have any names.
    """
    texts = docs.select("doc_id", F.coalesce(F.xxhash64("text"), F.lit(0)).alias("copy"), "text")
    rows = materialize(_fine(texts), "prints")
    words_ = [f"p{i}" for i in range(FINE_PARTS)]
    # The row that stands for a node: smallest identifier, null last.
    own = F.min(F.struct(F.col("doc_id").isNull().alias("unknown"), "doc_id", "copy")).alias("own")
    nodes = materialize(rows.groupBy("node").agg(own, *[F.any_value(c).alias(c) for c in ("size", *words_)]).select("node", "own.*", "size", *words_), "nodes")
    # Proposed links are checked on the sets; only groups that this leaves in several parts are compared whole.
    edges = materialize(candidates(nodes, similarity, tile_rows), "candidates")
    grouped = materialize(nodes.join(components(edges), "node").drop("unknown"), "grouped")
    sets = materialize(shingle_sets(texts, grouped.select("node", "doc_id", "copy"), words), "sets")
    links_ = materialize(verified(edges, sets, similarity), "links")
    drop_table(edges)
    roots = components(links_)
    labelled = grouped.join(roots.withColumnRenamed("root", "label"), "node", "left").withColumn("label", F.coalesce("label", "node"))
    # Groups in several parts, and how many a comparison cuts them into by number and bytes.
    cut = F.greatest(F.ceil(F.count("*") / part_texts), F.ceil(F.sum("size") * 8 / PART_BYTES)).alias("parts")
    torn = materialize(labelled.groupBy("root").agg(F.min("label").alias("a"), F.max("label").alias("b"), cut).where("a < b").select("root", "parts"), "torn")
    if n_torn := torn.count():
        # A small table (16 bytes a row) goes to every task, so that a large group's rows need not meet in one.
        few = F.broadcast(torn) if n_torn <= FEW_GROUPS else torn
        more = materialize(similar_links(labelled.join(few, "root"), sets, similarity), "more")
        roots = components(links_.union(more))
    best = nodes.join(roots, "node", "left").groupBy(F.coalesce("root", "node").alias("root")).agg(F.min(F.struct("unknown", "doc_id", "copy")).alias("own"))
    key_id, key_copy, mark = unused(docs, "keep_id", "keep_copy", "copy")
    best = materialize(best.select(F.col("own.doc_id").alias(key_id), F.col("own.copy").alias(key_copy)), "keep")
    for done in (rows, nodes, grouped, sets, links_, torn):
        drop_table(done)
    marked = docs.withColumn(mark, F.coalesce(F.xxhash64("text"), F.lit(0)))
    stay = marked.join(best, F.col("doc_id").eqNullSafe(best[key_id]) & (marked[mark] == best[key_copy]), "left_semi")
    return stay.dropDuplicates(["doc_id", mark]).select(*[column(c) for c in docs.columns])
