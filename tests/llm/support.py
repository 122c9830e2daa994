"""Small tables with the awkward cases every operator meets, and brute-force helpers."""

from __future__ import annotations

import random

SCHEMA = "doc_id long, text string, lang string, source string, n_chars long"

LETTERS = {"en": ["the", "of", "and", "that", "with", "house", "thing"], "de": ["der", "und", "nicht", "straße", "über", "haus"], "fr": ["le", "été", "où", "maison", "avec"]}


def prose(rng: random.Random, lang: str, n: int) -> str:
    words = [rng.choice(LETTERS[lang]) + rng.choice(["", "", "a", "en"]) for _ in range(n)]
    out, at = [], 0
    while at < n:
        k = rng.randint(4, 12)
        part = words[at : at + k]
        out.append(part[0].capitalize() + (" " + " ".join(part[1:]) if part[1:] else "") + ".")
        at += k
    return " ".join(out)


def rows(seed: int = 1, n: int = 60) -> list[tuple]:
    rng = random.Random(seed)
    out = []
    for i in range(n):
        lang = rng.choice(list(LETTERS))
        out.append((i, prose(rng, lang, rng.choice([1, 3, 20, 120])), lang, "hot" if i % 3 else f"s{i % 5}", i))
    copy = prose(rng, "en", 150)
    out += [(100 + i, copy if i % 2 else copy + " Tail.", "en", "hot", 1) for i in range(12)]
    out += [(200, None, None, None, None), (201, "", "en", "s1", 0), (202, "  \n\t ", "en", "s1", 5), (203, "x", None, "s1", 1)]
    out += [(204, "a b c " * 4000, "en", "s2", 24000), (205, "don't  stop…it's here   it'll\r\n\r\n  go!!", "en", "s2", 3)]
    out += [out[5], out[5]]  # repeated rows
    return out


#: Names that the operators use for columns of their own, here in the user's table.
CLASHES = """fp root length piece start tile score rank _rank ids n id _id copy _copy key _key tokens _tokens size _size block _block pass _pass
mark _mark _start weight exponent nearest _nearest scan _scan keep_id _keep_id keep_copy keep_fp mark_id mark_copy spans first cut cut_n_removed removed own_rejected
lang_pred rejected node label low high sequence_id offset bucket before dealt name passes blocks budget held _train train rare value tf component_id fingerprint
h1 h2 begin labels n_words detections p0 p1 unknown own copy_id _mix_tokens __key""".split()


def frame(spark, data=None, clash: bool = False):
    df = spark.createDataFrame(rows() if data is None else data, SCHEMA)
    return df.selectExpr("*", *[f"concat('mine-', doc_id, '-{name}') AS `{name}`" for name in CLASHES], "1 AS `dotted.name`") if clash else df


def same_columns(before, after) -> bool:
    """Whether the user's columns of rows that are left hold what they held; both frames come from frame(clash=True)."""
    own = [c for c in CLASHES if c in after.columns]
    return after.columns[: len(before.columns)] == before.columns and all(r[c] == (f"mine-{r.doc_id}-{c}" if r.doc_id is not None else None) for r in after.collect() for c in own)
