import random
import re

import xxhash

from tablecare.llm import simhash

from .support import frame, rows


def brute(data, radius=2):
    def print_of(text):
        w = re.findall(r"[^\x20\x09-\x0D]+", "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in text or ""))
        if not w:
            return 0
        h = [xxhash.xxh64_intdigest(" ".join(w[i : i + 3]).encode(), 42) for i in range(max(1, len(w) - 2))]
        return sum(1 << b for b in range(64) if 2 * sum(x >> b & 1 for x in h) > len(h))

    prints = [print_of(t) for _, t, *_ in data]
    part = list(range(len(data)))
    for i in range(len(data)):
        for j in range(i):
            if (prints[i] ^ prints[j]).bit_count() <= radius and part[i] != part[j]:
                old, new = part[i], part[j]
                part = [new if p == old else p for p in part]
    least = {p: min(d[0] for d, q in zip(data, part, strict=True) if q == p) for p in part}
    return [(d[0], f"{f:016x}", least[p]) for d, f, p in zip(data, prints, part, strict=True)]


def test_near_duplicates_equal_brute_force(spark, sf):
    got = simhash.near_duplicates(frame(spark, clash=True)).collect()
    assert sorted((r.doc_id, r.fingerprint, r.component_id) for r in got) == sorted(brute(rows()))
    docs = spark.read.parquet(f"{sf}/documents.parquet")
    got = simhash.near_duplicates(docs).collect()
    assert sorted(map(tuple, got)) == sorted(brute([(r.doc_id, r.text) for r in docs.collect()]))


def test_links_within_and_across_tiles(spark):
    import random

    rng = random.Random(3)
    base = [rng.getrandbits(64) for _ in range(40)]
    prints = sorted({b ^ sum(1 << k for k in rng.sample(range(64), rng.randint(0, 3))) for b in base for _ in range(12)})
    signed = [p - (1 << 64) if p >> 63 else p for p in prints]
    roots = simhash.components(simhash.links(spark.createDataFrame([(s,) for s in signed], "fp long"), tile_rows=4)).collect()
    got = {r.node % 2**64: r.root for r in roots}
    part = {p: p for p in prints}
    for i, a in enumerate(prints):
        for b in prints[:i]:
            if (a ^ b).bit_count() <= 2 and part[a] != part[b]:
                old, new = part[a], part[b]
                part = {k: new if v == old else v for k, v in part.items()}
    groups = {}
    for p, g in part.items():
        groups.setdefault(g, set()).add(p)
    for members in groups.values():
        if len(members) > 1:
            assert len({got[m] for m in members}) == 1 and set(got) & members == members
        else:
            assert not set(got) & members
    assert len({got[m] for m in got}) == sum(len(g) > 1 for g in groups.values())


def test_empty_table(spark):
    assert simhash.near_duplicates(frame(spark, [])).count() == 0


def test_a_tile_of_many_parts_is_many_tasks_work(spark, monkeypatch):
    """Most fingerprints in one tile: no task compares all of its parts, and the links stay."""
    from tablecare.llm import simhash

    monkeypatch.setattr(simhash, "ROWS_A_TASK", 2)
    rng = random.Random(8)
    hot = [int("0" * 8 + "1" * 8, 2) * 0x0001000100010001]
    while len(hot) < 900:  # bits move within a lane: the tile is one
        x = rng.choice(hot)
        lane = 16 * rng.randrange(4)
        ones, zeros = ([b for b in range(16) if x >> lane + b & 1 == v] for v in (1, 0))
        hot.append(x ^ 1 << lane + rng.choice(ones) ^ 1 << lane + rng.choice(zeros))
    values = sorted(set(hot) | {x ^ 1 << rng.randrange(64) for x in hot[:80]})
    df = spark.createDataFrame([(v - (1 << 64) if v >= 1 << 63 else v,) for v in values], "fp long")
    got = simhash.links(df, 2, tile_rows=32)
    parent = {v: v for v in values}

    def root(v):
        while parent[v] != v:
            v = parent[v]
        return v

    for i, a in enumerate(values):
        for b in values[i + 1 :]:
            if (a ^ b).bit_count() <= 2:
                parent[root(a)] = root(b)
    want = {}
    for v in values:
        want.setdefault(root(v), set()).add(v)
    found = {v: v for v in values}

    def top(v):
        while found[v] != v:
            v = found[v]
        return v

    for r in got.collect():
        a, b = r.low % (1 << 64), r.high % (1 << 64)
        found[top(a)] = top(b)
    parts = {}
    for v in values:
        parts.setdefault(top(v), set()).add(v)
    assert sorted(map(sorted, parts.values())) == sorted(map(sorted, want.values()))


def test_components_of_chains_stars_and_random_graphs(spark):
    rng = random.Random(4)
    names = rng.sample(range(-(10**9), 10**9), 400)
    edges = [(names[i], names[i + 1]) for i in range(120)] + [(names[150], n) for n in names[151:250]] + [tuple(rng.sample(names[260:], 2)) for _ in range(110)] + [(names[5], names[5])]
    parent = {n: n for e in edges for n in e}

    def root(n):
        while parent[n] != n:
            n = parent[n]
        return n

    for a, b in edges:
        a, b = sorted((root(a), root(b)))
        parent[b] = a
    got = simhash.components(spark.createDataFrame(edges, "low long, high long"))
    assert {r.node: r.root for r in got.collect()} == {n: root(n) for n in parent}
    assert simhash.components(spark.createDataFrame([], "low long, high long")).count() == 0
