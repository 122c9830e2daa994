import math
import random
import re
import zlib
from collections import Counter

import numpy as np
import pytest

from tablecare.llm import langid, licenses, lm, mixing, substrings
from tablecare.llm.common import byte_view

from .support import frame, prose, rows

import pyarrow as pa


def low(text):
    return "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in text or "")


def ppm(training, order):
    """Brute-force prediction by partial matching: contexts as byte strings, exclusion by sets."""
    follow = {}
    for text in training:
        b = bytes([lm.BEFORE] * order) + text + bytes([lm.END])
        for i in range(order, len(b)):
            for k in range(order + 1):
                follow.setdefault(b[i - k : i], Counter())[b[i]] += 1

    def symbol(context, x):
        out, gone = 0.0, set()
        for k in range(order, -1, -1):
            counts = follow.get(context[len(context) - k :] if k else b"")
            if not counts:
                continue
            live = {s: n for s, n in counts.items() if s not in gone}
            if not live:
                continue
            total = sum(live.values()) + len(live)
            if x in live:
                return out + math.log10(live[x] / total)
            out += math.log10(len(live) / total)
            gone |= set(live)
        return out - math.log10(lm.SYMBOLS - len(gone))

    def score(text):
        b = bytes([lm.BEFORE] * order) + text + bytes([lm.END])
        return sum(symbol(b[i - order : i], b[i]) for i in range(order, len(b)))

    return score


@pytest.mark.parametrize("most", [lm.FREQUENT_KEYS, 300, 0])
def test_scores_equal_brute_force(spark, most):
    data = [r for r in rows() if r[0] != 204]
    held = [zlib.crc32(str(r[0]).encode()) % 10 == 0 for r in data]
    model = ppm([low(r[1]).encode() for r, h in zip(data, held, strict=True) if not h], lm.ORDER)
    tokens = [[*re.findall(r"[^\x20\x09-\x0D]+", low(r[1])), None] for r in data]
    c = Counter(t for ts, h in zip(tokens, held, strict=True) if not h for t in ts)
    n, v = sum(c.values()), len(c)
    want = sorted((r[0], h, len(ts), sum(c[t] > 0 for t in ts), n, round(sum(math.log10((c[t] + 0.1) / (n + 0.1 * (v + 1))) for t in ts), 6), round(model(low(r[1]).encode()), 6)) for r, h, ts in zip(data, held, tokens, strict=True))
    got = lm.score(frame(spark, data, clash=True), most=most).collect()
    for a, b in zip(sorted((r.doc_id, r.held_out, r.n_tokens, r.n_known, r.train_tokens, r.base_score, r.score) for r in got), want, strict=True):
        assert a[:5] == b[:5] and a[5:] == pytest.approx(b[5:], rel=1e-6)


def test_scores_without_rows_or_training(spark):
    from pyspark.sql import functions as F

    assert lm.score(frame(spark, [])).count() == 0
    got = lm.score(frame(spark, [(1, "ab", None, None, 2)]), train=F.lit(False)).first()
    assert got.score == pytest.approx(-3 * math.log10(lm.SYMBOLS)) and got.base_score == 0 and got.held_out


def test_languages_held_out(spark):
    rng = random.Random(5)
    data = [(i, prose(rng, lang, rng.choice([3, 30, 200])), lang, "s", 1) for i in range(240) for lang in [["en", "de", "fr"][i % 3]]]
    data += [(900, None, "en", "s", 1), (901, "12 34 !!", "en", "s", 1), (902, "", None, "s", 1), (903, "漢字漢字漢字語語語", None, "s", 1), data[0]]
    docs = frame(spark, data, clash=True)
    model = langid.fit(docs.where(~langid.held_out()))
    got = langid.identify(docs, model).collect()
    assert len(got) == len(data)
    by = {r.doc_id: r for r in got}
    test = [r for r in got if r.doc_id < 900 and zlib.crc32(str(r.doc_id).encode()) % 4 == 2]
    assert np.mean([r.lang_pred == r.lang for r in test]) > 0.95 and not any(r.rejected for r in test)
    assert all(by[i].lang_pred == "und" and by[i].rejected and by[i].score == 0 for i in (900, 901, 902))
    assert by[903].rejected and by[903].lang_pred in model.langs
    kept = langid.keep_identified(docs)
    assert kept.columns == docs.columns and kept.count() == len(data) - 4


def test_what_is_no_known_language_goes_and_the_given_texts_stay(spark):
    docs = spark.read.parquet("/root/testdata/sf0.01/documents.parquet").select("doc_id", "text", "lang")
    model = langid.fit(docs.where(~langid.held_out()))
    odd = ["Это русский текст, который написан кириллицей и не входит в известные языки.", "数据处理系统用于大规模训练语言模型的数据", "xqzv wkjx qqzz vvkx zzqx wwvk jjqx kkzx qvxz", "asdf jkl; qwer uiop zxcv m,./ asdf qwer zxcv"]
    got = langid.identify(spark.createDataFrame(list(enumerate(odd)), "doc_id long, text string"), model).collect()
    assert all(r.rejected for r in got)
    given = langid.identify(docs.where(langid.held_out()), model).where("text IS NOT NULL")
    assert given.where("rejected").count() <= 0.005 * given.count()
    assert given.where("lang_pred = lang").count() >= 0.99 * given.count()


def test_predictions_equal_plain_nearest_centroids(spark):
    """A dictionary version of the n-grams, weights and cosines, with the fitted centroids."""
    docs = spark.read.parquet("/root/testdata/sf0.001/documents.parquet").select("doc_id", "text", "lang")
    train = [r for r in docs.collect() if zlib.crc32(str(r.doc_id).encode()) % 4 != 2]
    model = langid.fit(docs.where(~langid.held_out()))

    def cells(text):
        letters = re.sub(rb"[^a-z\x80-\xff]+", b" ", (text or "").lower().encode())
        letters = letters[1:] if letters[:1] == b" " and not (text or " ")[:1].isalpha() else letters
        out = Counter()
        for n in (1, 2, 3):
            for i in range(len(letters) - n + 1):
                part = letters[i : i + n]
                if part == b" ":
                    continue
                code = 0
                for k in range(1, n + 1):
                    code = (code * 0x01000193 + (part[k - 1] + k) * int(langid._MIX[k - 1])) % 2**32
                out[((code ^ code >> 15) * 0x2C1B3C6D % 2**32 >> 12) % langid.DIMS] += 1
        return out

    seen = Counter(c for r in train for c in cells(r.text))
    idf = {c: math.log((1 + len(train)) / (1 + n)) + 1 for c, n in seen.items()}
    for r in langid.identify(docs, model).collect():
        weight = {c: math.log1p(n) * idf.get(c, math.log(1 + len(train)) + 1) for c, n in cells(r.text).items()}
        norm = math.sqrt(sum(w * w for w in weight.values())) or 1.0
        like = [sum(w * float(centre[c]) for c, w in weight.items()) / norm for centre in model.centres]
        assert r.score == pytest.approx(max(like), abs=2e-5) and like[model.langs.index(r.lang_pred)] is not None
        assert max(x for x, lang in zip(like, model.langs, strict=True) if lang == r.lang_pred) == pytest.approx(max(like), abs=2e-5)


def test_languages_of_nothing(spark):
    empty = frame(spark, [])
    assert langid.identify(empty, langid.fit(empty)).count() == 0
    assert langid.identify(frame(spark, [(1, "abc", None, None, 1)]), langid.fit(empty)).first().lang_pred == "und"


def brute_phrases(text):
    words = re.findall(licenses.WORD, low(text))
    at = sorted((i, label) for p, label in licenses.PHRASES.items() for i in range(len(words)) if words[i : i + len(p.split())] == p.split())
    return len(words), len(at), at[0][0] if at else None, at[-1][0] if at else None, ",".join(sorted({label for _, label in at}))


def test_license_scan(spark):
    texts = [r[1] for r in rows()] + ["MIT  License; The Apache-License. GENERAL\nPUBLIC, license general public licenses", "mit licensé mit license", "SPDX-License-Identifier: BSD-3-Clause", "GNU Lesser General Public License v2.1", "see creativecommons.org: https://creativecommons.org/licenses/by-sa/4.0", "mitlicense amit license"]
    data = [(i, t, None, None, 0) for i, t in enumerate(texts)]
    got = licenses.scan(frame(spark, data, clash=True)).orderBy("doc_id").collect()
    assert [(r.n_words, r.n_base, r.first_word, r.last_word, r.base_labels) for r in got] == [brute_phrases(t) for t in texts]
    labels = {r.doc_id: r.labels for r in got}
    n = len(rows())
    assert labels[n + 2] == "bsd-3-clause" and labels[n + 3] == "gpl,lgpl-2.1" and labels[n + 4] == "cc-by-sa-4.0" and set(labels[n].split(",")) >= {"mit", "gpl", "apache"}
    assert all(0 <= r.score <= 1 and set(r.base_labels.split(",")) - {""} <= set(r.labels.split(",")) for r in got)
    assert licenses.scan(frame(spark, [])).count() == 0


def test_license_rules_and_suppression():
    rules = licenses.rules()
    assert len(rules) >= 300 and [r.priority for r in rules] == sorted(r.priority for r in rules)
    found = licenses.detect("released under the gnu general public license, version 3 and the mit license")
    assert [d.label for d in found] == ["gpl-3.0", "mit"]
    for a in found:
        assert not any(a is not b and b.start <= a.start and a.end <= b.end for b in found)


#: A text for each alternative of a rule that its family's first keyword does not stand in, and hard-wrapped notices.
GATED = [
    "Expat License", "ASL 2.0", "ASL2", "PSF license", "PSF\nlicence", "MS-PL", "MS-RL", "ODbL", "same terms\nas Perl itself", "open rail", "Open RAIL-M licence",
    "png reference\nlibrary license", "licenced under CC BY 4.0", "licenced under a Creative Commons Attribution-ShareAlike 3.0", "see the licence file for details", "end-user licence agreement",
    "All rights\nreserved", "Permission to use,\ncopy, modify, and/or distribute this software for any purpose\nwith or without fee is hereby granted", "general\npublic licence",
    "Redistributions of\n  source code must retain the above\ncopyright notice", "Permission is\u00a0hereby\u2003granted, free of charge, to any person obtaining a copy of this software\nand associated documentation files", "free\x1cdocumentation\x85license 1.2", "creative\r\ncommons\tattribution 4.0",
]


def test_license_gate_loses_nothing(spark):
    texts = GATED + [t.replace(" ", "\n") for t in GATED]
    got = licenses.scan(frame(spark, [(i, t, None, None, 0) for i, t in enumerate(texts)])).orderBy("doc_id").collect()
    for r, t in zip(got, texts, strict=True):
        want = licenses.detect(low(t), gated=False)
        assert want and [(d.label, d.start, d.end, d.confidence) for d in r.detections] == [d[:4] for d in want], t
    assert len({(r.priority, r.label, r.pattern) for r in licenses.rules()}) == len(licenses.rules())


def test_license_gate_loses_nothing_of_the_given_table(spark):
    docs = spark.read.parquet("/root/testdata/sf0.01/documents.parquet").select("doc_id", "text")
    for r in licenses.scan(docs).collect():
        assert [(d.label, d.start, d.end) for d in r.detections] == [d[:3] for d in licenses.detect(low(r.text), gated=False)]


#: Texts as they stand in files, and near ones that must not hit the label.
HIT_AND_MISS = [
    ("apache-2.0", "Licensed to the Apache Software Foundation (ASF) under one\nor more contributor license agreements.", "donated to the Apache Software Foundation (ASF) last year"),
    ("apache-2.0", "Unless required by applicable law or agreed to in writing, software\ndistributed under the License is distributed on an \"AS IS\" BASIS,", "unless required by applicable law, taxes are paid on an as is basis"),
    ("mit", "subject to the following conditions: The above copyright notice and this permission notice shall be included in all\ncopies or substantial portions of the Software.", "substantial portions of the software were rewritten"),
    ("gpl-classpath-exception", "Linking this library statically or dynamically with other modules is making a combined work based on this library.", "linking this library statically is slow"),
    ("apache-llvm-exception", "Part of the project, under the Apache License v2.0 with LLVM Exceptions.", "an llvm exception was thrown"),
    ("bsd", "Redistribution and use in source and binary forms, with or without\nmodification, are permitted provided that", "we ship source and binary forms of it"),
    ("bsd-3-clause", "may be used to endorse or promote products derived from this software without specific prior written permission", "they endorse or promote products derived from milk"),
    ("mpl-2.0", "This Source Code Form is subject to the terms of the Mozilla Public\nLicense, v. 2.0.", "this source code form is subject to change"),
    ("epl-1.0", "This program and the accompanying materials are made available under the terms of the Eclipse Public License v1.0", "the accompanying materials are made of paper"),
    ("zlib", "The origin of this software must not be misrepresented; you must not claim that you wrote it", "the facts must not be misrepresented"),
    ("unlicense", "Anyone is free to copy, modify, publish, use, compile, sell, or\ndistribute this software", "anyone is free to copy the recipe"),
    ("json", "The Software shall be used for Good, not Evil.", "a story for good, not evil people"),
    ("postgresql", "for any purpose, without fee, and without a written agreement is hereby granted, provided that the above copyright notice", "we worked without a written agreement for years"),
    ("ofl-1.1", "Copyright 2010, with Reserved Font Name Something", "a reserved font name is a name"),
    ("gpl-2.0", "the GNU General Public License as published by the Free Software Foundation; either version 2 of the License", "either version 2 or version 3 of the map will do"),
    ("agpl-3.0", "must prominently offer all users interacting with it remotely through a computer network an opportunity", "they talked through a computer network"),
    ("beerware", "If we meet some day, and you think this stuff is worth it, you can buy me a beer in return.", "will you buy me a beer tonight?"),
    ("all-rights-reserved", "No part of this publication may be reproduced, stored or transmitted, without the prior written permission of the publisher", "no changes without prior written notice"),
    ("sspl-1.0", "under the Server Side Public License, version 1", "server side public pages"),
    ("busl-1.1", "Business Source License 1.1", "our business source is reliable"),
]


def test_license_texts_hit_and_near_ones_miss(spark):
    texts = [t for _, hit, miss in HIT_AND_MISS for t in (hit, miss)]
    got = licenses.scan(frame(spark, [(i, t, None, None, 0) for i, t in enumerate(texts)])).orderBy("doc_id").collect()
    for k, (label, *_) in enumerate(HIT_AND_MISS):
        assert label in got[2 * k].labels.split(",") and got[2 * k].score >= 0.9, label
        assert label not in got[2 * k + 1].labels.split(","), label
    patterns = [r.pattern.pattern for r in licenses.rules()]
    assert len(set(zip(patterns, (r.label for r in licenses.rules()), strict=True))) == len(patterns)


def test_license_suppression_does_not_hang_on_order():
    text = "released under the gnu lesser general public license v2.1 or later, see https://www.gnu.org/licenses/lgpl-2.1 and the mit license"
    want = licenses.detect(text)
    rules = licenses.rules()
    rng = random.Random(0)
    for _ in range(5):
        rng.shuffle(rules)
        assert licenses.detect(text, gated=False) == want
    rules.sort(key=lambda r: r.priority)
    licenses.rules.cache_clear()


def passage(rng, n=70):
    return prose(rng, "en", n)


def test_repeated_passages_go_but_for_the_first(spark):
    rng = random.Random(9)
    shared = passage(rng)
    data = [(i, prose(rng, "de", 60) + " und " + shared + " aber " + prose(rng, "de", 40), "de", "s", 1) for i in (3, 7, 9)]
    data += [(i, prose(rng, "fr", 90), "fr", "s", 1) for i in range(20, 26)] + [(30, None, "fr", "s", 1), (31, "", "fr", "s", 1), (32, "Un mot.", "fr", "s", 1), (33, "Un mot.", "fr", "s", 1)]
    data += [(40, "x y z " * 300, "en", "s", 1), data[4], data[4]]
    got = substrings.remove_repeats(frame(spark, data, clash=True)).collect()
    assert len(got) == len(data)
    by = {r.doc_id: r for r in got}
    text = {d: t for d, t, *_ in data}
    assert by[3].text == text[3] and by[3].n_removed == 0
    inner = shared.split()[24:-24]
    for i in (7, 9):
        assert by[i].n_removed > 0 and " ".join(inner) not in by[i].text and 3 in by[i].first_ids
        assert by[i].text.startswith(" ".join(text[i].split()[:50])) and by[i].text.endswith(" ".join(text[i].split()[-35:]))
    for i in [*range(20, 26), 30, 31, 32, 33]:
        assert by[i].text == text[i] and by[i].n_removed == 0 and by[i].first_ids == []
    assert substrings.remove_repeats(frame(spark, [])).count() == 0


def plain_spans(text):
    """(begin, n) in words of every span of a text, and its words: loops over lists."""
    words, begins, last_end = [], [], 0
    for m in re.finditer(r"[^\x20\x09-\x0D]+", text or ""):
        gap = text[last_end : m.start()]
        if not words or re.search(r"[\n-\r]", gap) or re.search(r"[.!?][^0-9A-Za-z\x80-\uffff.!?]*$", words[-1]):
            begins.append(len(words))
        words.append(m.group())
        last_end = m.end()
    bounds, out = [*begins, len(words)], set()
    for i in range(len(begins)):
        for step in (1, -1):
            a = b = i
            while 0 <= a and b < len(begins):
                if b - a + 1 >= substrings.SENTENCES and bounds[b + 1] - bounds[a] >= substrings.WORDS:
                    out.add((bounds[a], bounds[b + 1] - bounds[a]))
                    break
                a, b = (a, b + 1) if step > 0 else (a - 1, b)
    return out, [low(w) for w in words]


def test_whole_removal_equals_brute_force(spark):
    rng = random.Random(21)
    shared = [passage(rng, n) for n in (30, 45, 60, 90)]
    data = []
    for i in range(24):
        parts = [prose(rng, rng.choice(["en", "de"]), rng.randint(1, 50)) for _ in range(3)]
        parts.insert(1, rng.choice(shared))
        if i % 3 == 0:
            parts.append(rng.choice(shared))
        data.append((i, rng.choice([" ", "\n", "  "]).join(parts), "en", "s", 1))
    data += [(50, None, "en", "s", 1), (51, "", "en", "s", 1), data[3], (52, data[4][1], "en", "s", 1)]
    places, texts = {}, {}
    for doc_id, text, *_ in data:
        spans, words = plain_spans(text)
        found = substrings.Sentences(*byte_view(pa.array([text], pa.string())))
        assert {(int(found.first[a]), int(found.first[b] - found.first[a])) for a, b in zip(*found.spans(), strict=True)} == spans
        spans |= {(int(w), substrings.WORDS) for w in found.windows()}
        texts[doc_id] = (text, words)
        for a, n in spans:
            places.setdefault(tuple(words[a : a + n]), set()).add((doc_id, a))
    covered = {}
    for words, at in places.items():
        first = min(at)
        for doc_id, a in at:
            if not (doc_id == first[0] and a < first[1] + len(words)):
                covered.setdefault(doc_id, set()).update(range(a, a + len(words)))
    got = substrings.remove_repeats(frame(spark, data, clash=True)).collect()
    assert len(got) == len(data)
    for r in got:
        text, words = texts[r.doc_id]
        gone = {k for x in r.removed for k in range(x.begin, x.begin + x.n)}
        assert gone == covered.get(r.doc_id, set())
        assert [low(w) for w in (r.text or "").split()] == [w for k, w in enumerate(words) if k not in gone]
        assert (r.text == text) if not gone else r.n_removed > 0
    assert sum(map(bool, covered.values())) > 10


def distinct(rng, n):
    return " ".join(f"w{rng.randrange(10**9)}" for _ in range(n))


def test_passages_pasted_in_mid_sentence(spark):
    rng, data, want = random.Random(12), [], {}
    for i in range(60):
        n = rng.randint(51, 80)
        words = distinct(rng, n).split()
        if i % 3:  # one whole sentence inside; the ends run on into other text
            words[14] += "."
            words[14 + min(30, n - 20)] += "."
        text = " ".join(words)
        for k in (0, 1):
            before, after = (distinct(rng, rng.randint(0, 60)) for _ in range(2))
            data.append((1000 * k + i, f"{before} {text} {after}", "en", "s", 1))
        want[1000 + i] = (before, words, after)
    got = {r.doc_id: r for r in substrings.remove_repeats(frame(spark, data)).collect()}
    for i in range(60):
        assert got[i].text == data[2 * i][1] and got[i].n_removed == 0
    for i, (before, words, after) in want.items():
        left = got[i].text.split()
        kept = [w for w in words if w in set(left)]
        assert got[i].n_removed > 0 and got[i].first_ids == [i - 1000] and left == [*before.split(), *kept, *after.split()]
        cut = [w not in set(left) for w in words]
        assert sum(cut) >= 25 and cut.index(True) < 25 and cut[::-1].index(True) < 25 and all(cut[cut.index(True) : len(cut) - cut[::-1].index(True)])


def test_a_text_of_one_period_keeps_its_first_span(spark):
    got = substrings.remove_repeats(frame(spark, [(1, "x y z " * 300, "en", "s", 1)])).first()
    assert 25 <= len(got.text.split()) < 900 and got.text.startswith("x y z x y z")


def test_spans_equal_brute_force():
    rng = random.Random(2)
    texts = [prose(rng, "en", n) for n in (0, 5, 60, 200)] + ["word " * 100, "a. b! c? d\ne\n\nF g H", None]
    s = substrings.Sentences(*byte_view(pa.array(texts, pa.string())))
    begin, end = s.spans()
    got = set(zip(begin.tolist(), end.tolist(), strict=True))
    want = set()
    size = np.diff(s.first)
    for i in range(len(s.row)):
        for ahead in (True, False):
            parts = []
            j = i
            while 0 <= j < len(s.row) and s.row[j] == s.row[i]:
                parts.append(j)
                if len(parts) >= substrings.SENTENCES and size[parts].sum() >= substrings.WORDS:
                    want.add((min(parts), max(parts) + 1))
                    break
                j += 1 if ahead else -1
    assert got == want


def test_equal_spans_have_equal_hashes():
    rng = random.Random(3)
    shared = prose(rng, "en", 80)
    s = substrings.Sentences(*byte_view(pa.array(["Ab cd. " + shared, "Ef gh ij! Kl. " + shared.replace(" ", "  ").upper()])))
    begin, end = s.spans()
    h = list(zip(*s.hashes(begin, end), strict=True))
    seen = {}
    words = [w for t in ["Ab cd. " + shared, "Ef gh ij! Kl. " + shared] for w in low(t).split()]
    for key, a, b in zip(h, s.first[begin], s.first[end], strict=True):
        assert seen.setdefault(key, words[a:b]) == words[a:b]
    assert len(seen) == len({tuple(v) for v in seen.values()}) < len(h)


def brute_exponent(sizes, limit=None, entropy=None):
    p = np.array(sizes) / sum(sizes)
    a, b = 0.0, 1.0
    for _ in range(60):
        mid = (a + b) / 2
        w = p**mid / (p**mid).sum()
        if entropy is None:
            ok = (w / p).max() / (w / p).min() <= limit
            a, b = (a, mid) if ok else (mid, b)
        else:
            ok = -(w * np.log(w)).sum() >= entropy
            a, b = (mid, b) if ok else (a, mid)
    return b if entropy is None else a


@pytest.mark.parametrize("limit,entropy,total", [(2.0, None, None), (1.0, None, None), (4.0, None, 3000), (None, 1.2, None)])
def test_mixing(spark, limit, entropy, total):
    data = rows()
    got = mixing.mix(frame(spark, data, clash=True), limit, entropy, total, block_tokens=500).collect()
    n = lambda t: len(re.findall(r"[^\x20\x09-\x0D]+", t or "")) + 1
    sizes = Counter()
    for r in data:
        sizes[r[3]] += n(r[1])
    a = brute_exponent(list(sizes.values()), limit, entropy)
    z = sum((s / sum(sizes.values())) ** a for s in sizes.values())
    weight = {k: (s / sum(sizes.values())) ** a / z for k, s in sizes.items()}
    whole = total or max(s / weight[k] for k, s in sizes.items())
    for source, size in sizes.items():
        mine = sorted((r for r in got if r.source == source), key=lambda r: r.start)
        assert mine[0].weight == pytest.approx(weight[source], rel=1e-6)
        at = 0
        for r in mine:  # gapless, pass by pass
            assert r.start == at and r.tokens == n(r.text) and r["pass"] == at // size
            at += r.tokens
        budget = whole * weight[source]
        assert budget - 1 <= at and mine[-1].start < budget + 1
    if total is None:
        assert {r.doc_id for r in got} == {r[0] for r in data}
        once = Counter(r.doc_id for r in got if r["pass"] == 0)
        assert once == Counter(r[0] for r in data)
    order = [r.doc_id for r in sorted((r for r in got if r.source == "hot" and r["pass"] == 0), key=lambda r: r.start)]
    assert order != sorted(order)


def test_mixing_of_nothing(spark):
    assert mixing.mix(frame(spark, [])).count() == 0


def test_contained_detections_are_found_in_n_log_n():
    rng = random.Random(2)
    for _ in range(300):
        ranked = [licenses.Detection("x", a := rng.randint(0, 12), a + rng.randint(1, 6), 1.0, 0) for _ in range(rng.randint(0, 25))]
        kept = []
        for d in ranked:
            if not any(k.start <= d.start and d.end <= k.end for k in kept):
                kept.append(d)
        assert licenses._not_contained(ranked) == kept


def test_a_passage_of_two_sentences_goes(spark):
    rng = random.Random(31)
    two = f"Ab {distinct(rng, 13)}. Cd {distinct(rng, 13)}."
    around = lambda: f"Ef {distinct(rng, 20)}."
    texts = [(around(), around()) for _ in range(4)]
    data = [(i, f"{a} {two if i < 2 else around()} {b}", "en", "s", 1) for i, (a, b) in enumerate(texts)]
    got = {r.doc_id: r for r in substrings.remove_repeats(frame(spark, data)).collect()}
    assert got[1].text.split() == " ".join(texts[1]).split() and got[1].n_removed == 2 and got[1].first_ids == [0]
    assert all(got[i].text == data[i][1] and got[i].n_removed == 0 for i in (0, 2, 3))
