"""Buckets of near copies dealt to rounds give the links of one round."""

import os
import random

from skyfold.llm import neardup, store


def test_rounds_change_nothing(spark, monkeypatch):
    assert [neardup._rounds(*x) for x in ((0, 0), (5, 10), (10, 10), (11, 10), (155, 45))] == [1, 1, 1, 2, 4]
    rng = random.Random(3)
    words = [f"w{rng.randrange(400)}" for _ in range(60)]
    rows = []
    for i in range(40):  # a chain: each text changes one word of the one before
        words = list(words)
        words[rng.randrange(60)] = f"n{i}"
        rows.append((i, " ".join(words)))
    docs = spark.createDataFrame(rows + [(100, "alone here"), (101, None)], "doc_id long, text string")
    one = sorted(tuple(r) for r in neardup.components(docs).collect())
    monkeypatch.setattr(neardup, "_rounds", lambda members, classes: 3)
    since = store.mark()
    assert sorted(tuple(r) for r in neardup.components(docs).collect()) == one
    assert len({r[2] for r in one}) < 42
    left = {p.rpartition("/")[2].rpartition("-")[0] for p in store._made[since:]}
    assert left == {"near-classes", "near-rows"} and all(os.path.isdir(p.removeprefix("file:")) for p in store._made[since:])
