"""Lexical ranks over several slices of queries: one shuffle of the records, null texts, ties."""

from collections import Counter
from math import sqrt

from skyfold.operators import retrieve


def test_slices_share_one_pass_of_the_records(spark, monkeypatch):
    monkeypatch.setattr(retrieve, "QUERY_SLICE", 2)
    monkeypatch.setattr(retrieve, "RECORD_BLOCK", 3)
    docs = {i: " ".join(f"w{(i * j) % 7}" for j in range(1, 9)) for i in range(40)} | {40: None, 41: ""}
    asked = {0: "w1 w2 w2", 1: "w3", 2: "w0 w6 W5", 3: None, 4: "nothing here", 5: "w4 w1"}
    d = spark.createDataFrame(list(docs.items()), "id long, text string")
    q = spark.createDataFrame(list(asked.items()), "qid long, text string")
    out = retrieve.lexical_topk(d, q, 4)
    plan = out._jdf.queryExecution().optimizedPlan().toString()
    assert plan.count("MapInPandas") >= 2 and "Repartition" not in plan  # no slice shuffles the records again
    norm = lambda c: sqrt(sum(n * n for n in c.values()))
    want = set()
    for qid, text in asked.items():
        a = Counter((text or "").lower().split())
        scores = []
        for i, t in docs.items():
            b = Counter((t or "").split())
            dot = sum(n * b[w] for w, n in a.items())
            if dot:
                scores.append((-round(dot / norm(a) / norm(b), 9), i))
        want |= {(qid, r + 1, s) for r, (s, i) in enumerate(sorted(scores)[:4])}
    assert {(r["qid"], r["rank"], -round(r["score"], 9)) for r in out.collect()} == want


def test_blocks_meet_in_tasks(spark, monkeypatch):
    """Queries reach the records without passing the driver; equal records of different blocks score the same, one word may be very long."""
    monkeypatch.setattr(retrieve, "QUERY_SLICE", 7)
    monkeypatch.setattr(retrieve, "RECORD_BLOCK", 10)
    monkeypatch.setattr(retrieve, "OFTEN", 3)
    monkeypatch.setattr(retrieve, "SPREAD", 20)
    monkeypatch.setattr(retrieve, "BLOCK_WORDS", 60)
    monkeypatch.setattr(retrieve, "_slices", None)
    long = "x" * 100_000
    text = lambda i: " ".join(f"t{(i * j * j + j) % 23}" for j in range(1 + i % 13)) + (f" {long}" if i % 50 == 7 else "")
    docs = {1000 - i: text(i % 90) for i in range(300)}
    asked = {i: text(3 * i + 1) for i in range(40)}
    out = retrieve.lexical_topk(spark.createDataFrame(list(docs.items()), "id long, text string"), spark.createDataFrame(list(asked.items()), "qid long, text string"), 5)
    assert "CartesianProduct" in out._jdf.queryExecution().executedPlan().toString()
    count = {i: Counter(t.split()) for i, t in docs.items()}
    norm = lambda c: sqrt(sum(n * n for n in c.values()))
    want = set()
    for qid, t in asked.items():
        a = Counter(t.split())
        scores = ((sum(n * c[w] for w, n in a.items()) / (norm(a) * norm(c)), -i) for i, c in count.items())
        best = sorted(((round(s, 12), i) for s, i in scores if s), reverse=True)[:5]
        want |= {(qid, r + 1, -i, s) for r, (s, i) in enumerate(best)}
    assert {(r["qid"], r["rank"], r["id"], round(r["score"], 12)) for r in out.collect()} == want
