"""A small table with every awkward case: nulls, empty and long texts, repeated rows, copies, clashing columns."""

from __future__ import annotations

import random

SCHEMA = "doc_id long, text string, lang string, source string, n_chars long, `Size` string, hits int, _k int, shard string, `Target` double"


def rows(seed: int = 3, n: int = 120) -> list[tuple]:
    rng = random.Random(seed)
    vocab = [f"w{i}" for i in range(400)] + ["é", "日本", "The", "the", "«x»", "a,", "B."]
    def text(k):
        return rng.choice(["", " "]) + rng.choice([" ", "\n", "  "]).join(rng.choices(vocab, k=k))
    out = []
    for i in range(n):
        out.append([i, text(rng.choice([0, 1, 3, 5, 9, 12, 30, 80, 200])), rng.choice(["en", None]), rng.choice(["a", "b", "c", None, ""])])
    shared = " ".join(rng.choices(vocab, k=70))
    for i in range(30):  # a passage that many share, near copies, exact copies
        out.append([1000 + i, text(20) + " " + shared + " " + text(15), "en", "a"])
    base = rng.choices(vocab, k=150)
    for i in range(25):
        own = list(base)
        for _ in range(rng.choice([1, 2, 4, 6])):
            own[rng.randrange(len(own))] = f"edit{i}"
        out.append([2000 + i, " ".join(own), "en", "b"])
    out += [[3000 + i, " ".join(base), "en", "b"] for i in range(10)]
    out.append([4000, " ".join(["same"] * 3000), "en", "c"])
    out.append([4001, "x" * 50_000 + " " + " ".join(["same"] * 70), "en", "c"])
    out.append([4002, None, None, None])
    out.append([None, " ".join(base), None, "a"])
    out.append([None, None, None, None])
    out += [[4003, "twice the same row here", "en", "a"]] * 2
    out += [[4004, text(60), "en", "a"], [4004, text(61), "en", "b"]]
    return [(d, t, lang, s, None if t is None else len(t), "clash", 1, 2, "x", 0.5) for d, t, lang, s in out]
