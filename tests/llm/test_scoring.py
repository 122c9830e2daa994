"""Op 4's counts and prices by place: equal to plain counts and a dict whatever shares a place."""

import random
from collections import Counter

import numpy as np
import pytest
from pyspark.sql import functions as F

from tablecare.llm import lm

from .support import frame, rows


def by_hand(data):
    found = Counter()
    for text, train in data:
        low = bytes(b | 0x20 if 0x41 <= b <= 0x5A else b for b in (text or "").encode())
        padded = bytes([lm.BEFORE] * lm.ORDER) + low + bytes([lm.END])
        for i in range(lm.ORDER, len(padded)):
            found[int.from_bytes(padded[i - lm.ORDER : i + 1]), train] += 1
        for word in [*low.translate(bytes.maketrans(b"\t\n\v\f\r", b" " * 5)).split(b" "), None]:
            if word is None or word:
                found[word, train] += 1
    return found


@pytest.mark.parametrize("among", [lm.PLACES, 64, 2])
def test_counts_equal_plain_counts(spark, among):
    data = [(r[1], r[0] % 3 != 0) for r in rows()]
    hand = by_hand(data)
    keys = {k for k, _ in hand}
    got = {r.key: (r.n, r.n_train) for r in lm.count(spark.createDataFrame(data, "text string, _train boolean").repartition(3), among).collect()}
    assert len(got) == len(keys)
    assert {k: v for k, v in got.items() if k >= 0} == {k: (hand[k, True] + hand[k, False], hand[k, True]) for k in keys if isinstance(k, int)}
    assert Counter(v for k, v in got.items() if k < 0) == Counter((hand[k, True] + hand[k, False], hand[k, True]) for k in keys if not isinstance(k, int))


def test_counts_are_grouped_once_dealt(spark):
    """A task gives out distinct keys: grouping them before they are dealt is work for nothing."""
    plan = lm.count(spark.createDataFrame([("a", True)], "text string, _train boolean"))._jdf.queryExecution().executedPlan().toString().splitlines()
    dealt = next(i for i, line in enumerate(plan) if "Exchange" in line)
    assert not any("Aggregate" in line for line in plan[dealt:])
    assert sum("Exchange" in line for line in plan) == 1


@pytest.mark.parametrize("size", [0, 1, 2, 5, 3000])
def test_lookup_equals_dict(size):
    rng = random.Random(size)
    keys = np.array(rng.sample(range(-(1 << 46), 1 << 46), size), np.int64)
    values = np.array([rng.random() for _ in keys])
    want = dict(zip(keys.tolist(), values.tolist(), strict=True))
    wanted = np.array([*keys.tolist(), *keys.tolist()[:7], -(1 << 63), 1 << 47, 9999, 9999], np.int64)
    lookup = lm.Lookup(keys, values)
    assert size < 3000 or len(lookup.other_keys) > 1  # some share a place
    value, missed = lookup.find(wanted)
    assert value.tolist() == [want.get(k, 0.0) for k in wanted.tolist()]
    assert missed.tolist() == [i for i, k in enumerate(wanted.tolist()) if k not in want]
    assert all(len(x) == 0 for x in lookup.find(wanted[:0]))


def test_rows_of_unknown_training_are_held_out(spark):
    data = [(1, "ab ab", "en", "s", 5), (2, "ab", "en", "s", 2), (None, "cd", "en", "s", 2)]
    got = {r.text_id: r for r in lm.score(frame(spark, data), train=F.col("doc_id") == 1).withColumnRenamed("doc_id", "text_id").collect()}
    assert {k: r.held_out for k, r in got.items()} == {1: False, 2: True, None: True}
    assert {r.train_tokens for r in got.values()} == {3} and got[None].n_known == 1 and got[2].n_known == 2
