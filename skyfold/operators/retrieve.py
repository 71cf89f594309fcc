"""Retrieval over mission records: lexical and vector ranks, question routing, batch answers."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window, functions as F

from skyfold.operators.concepts import CONCEPT_CLASSES, concept
from skyfold.session import cut, once

# Routing words in order.
QUERY_SLICE = 4096
RECORD_BLOCK = 512  # records that meet a block of queries at a time
BLOCK_WORDS = 400_000  # words of such a block, unless one record has more
OFTEN = 256  # words of a block of queries that are scored by a matrix product
SPREAD = 2_000_000  # single products held at a time
BLOCK = "id array<long>, norm array<double>, words string, ends array<int>, word array<int>, n array<int>"
TOP = "qid long, id long, score double"
LIMIT_SOURCES = 50
COUNT = r"\b(how many|count|number of|total)\b"
DAMAGED = r"\b(damaged|destroyed|collapsed|flooded|affected)\b"
MEASURE = r"\b(measure|height|area|volume|size|how tall|how big|dimensions)\b"
DAMAGE = r"\b(damage|destroyed|collapse|collapsed|flood|flooded|landslide|debris|rubble|blocked|blockage)\b"
LOCATE = r"\b(where|show|find|list|locate|highlight|which)\b"
RISK = r"\b(risk|danger|unsafe|emergency|access|evacuat)\b"
CHANGE = r"\b(change|compare|added|removed|new|difference|different|progress|vs)\b"
RECOMMEND = r"\b(recommend|re-fly|refly|improve|better|rescan|optimiz)\b"
SUMMARY = r"\b(summary|overview|what is there|report)\b"


def tokens(text: Column) -> Column:
    return F.regexp_extract_all(F.lower(text), F.lit("([a-z0-9]+)"), F.lit(1))


def build_records(**parts: DataFrame) -> DataFrame:
    """Index rows ``id, mission_id, kind, doc, text``; each part brings ``mission_id, seq, text``.

    Objects beyond the first 200 of a mission are kept as one overflow row.
    """
    rows = None
    for kind, df in parts.items():
        d = df.select("mission_id", "seq", "text").filter("text IS NOT NULL AND trim(text) <> ''")
        if kind == "object":
            w = Window.partitionBy("mission_id").orderBy("seq")
            first = d.withColumn("_i", F.row_number().over(w)).filter("_i <= 200").drop("_i")
            total = d.groupBy("mission_id").agg(F.count(F.lit(1)).alias("n"), F.max("seq").alias("seq")).filter("n > 200")
            d = first.unionByName(total.select("mission_id", (F.col("seq") + 1).alias("seq"), F.concat(F.lit("and "), F.col("n") - 200, F.lit(" more objects")).alias("text")))
        d = d.withColumn("kind", F.lit(kind))
        rows = d if rows is None else rows.unionByName(d)
    return rows.select("mission_id", "kind", "seq", "text", F.concat_ws(":", "mission_id", "kind", "seq").alias("id"))


def _slices(queries: DataFrame, cols: list[str], qid: str):
    """Query rows in slices of a bounded size, so that each slice may ride with the tasks."""
    q = once(queries.select(*cols))
    n = max(1, -(-q.count() // QUERY_SLICE))
    for i in range(n):
        yield q.filter(F.pmod(F.xxhash64(qid), F.lit(n)) == i).collect()


def _spread(records: DataFrame) -> DataFrame:
    """Records in at least as many tasks as the session shuffles with; large scans stay where they are."""
    n = int(records.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    return records.repartition(n, "id") if records.rdd.getNumPartitions() < n else records


def _local_top(score: np.ndarray, ids: np.ndarray, qids: np.ndarray, k: int) -> pd.DataFrame:
    """Best ``k`` records per query of one batch, ties to the smaller id."""
    order = np.argsort(ids, kind="stable")
    score, ids = score[order], ids[order]
    take = np.argsort(-score, axis=0, kind="stable")[:k]
    out = pd.DataFrame({"qid": np.repeat(qids, len(take)), "id": ids[take].T.ravel(), "score": np.take_along_axis(score, take, 0).T.ravel()})
    return out[out["score"] > 0]


def _ranked(parts: list[DataFrame], k: int) -> DataFrame:
    from functools import reduce

    w = Window.partitionBy("qid").orderBy(F.desc("score"), "id")
    return reduce(DataFrame.unionByName, parts).withColumn("rank", F.row_number().over(w)).filter(F.col("rank") <= k)


def _terms(text: Column) -> Column:
    return F.coalesce(tokens(text), F.array().cast("array<string>"))


def _packed(rows: DataFrame, most: int) -> DataFrame:
    """Rows ``id, tok`` in blocks of at most ``most``: a list of words, and how often each row has which of them.

    Words are letters and digits, so they are held as one string with blanks between.
    """

    def task(it: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in it:
            size = b["tok"].map(len).to_numpy(np.int64)
            full = np.concatenate([[0], np.cumsum(size)])
            start = 0
            while start < len(b):
                end = min(start + most, max(start + 1, int(np.searchsorted(full, full[start] + BLOCK_WORDS, "right")) - 1), len(b))
                code, words = pd.factorize(np.concatenate([np.empty(0, object), *b["tok"].iloc[start:end]]))
                key, n = np.unique(np.repeat(np.arange(end - start), size[start:end]) * max(len(words), 1) + code, return_counts=True)
                row, word = np.divmod(key, max(len(words), 1))
                yield pd.DataFrame({
                    "id": [b["id"].iloc[start:end].to_numpy()], "norm": [np.sqrt(np.bincount(row, n * n, end - start))], "words": [" ".join(words)],
                    "ends": [np.searchsorted(row, np.arange(end - start), "right").astype(np.int32)], "word": [word.astype(np.int32)], "n": [n.astype(np.int32)],
                })
                start = end

    return rows.mapInPandas(task, BLOCK)


class _Asked:
    """A block of queries and the best ``k`` records of each so far."""

    def __init__(self, b: dict, k: int):
        self.qid, self.norm, self.n, self.k = b["qid"], b["q_norm"], b["q_n"].astype(float), k
        self.ends, self.term = b["q_ends"].astype(np.int64), b["q_word"].astype(np.int64)
        self.size = np.diff(self.ends, prepend=0)
        words = b["q_words"].split()
        self.at = {w: i for i, w in enumerate(words)}
        # lists of the queries of each word; those of the words asked most make a matrix
        row = np.repeat(np.arange(len(self.qid)), self.size)
        weight = (self.n / self.norm[row]).astype(np.float32)
        order = np.argsort(self.term, kind="stable")
        self.listed, self.weight = row[order], weight[order]
        self.count = np.bincount(self.term, minlength=len(words))
        self.first = np.cumsum(self.count) - self.count
        often = np.argsort(-self.count, kind="stable")[:OFTEN]
        self.often = np.full(len(words), -1)
        self.often[often] = np.arange(len(often))
        self.matrix = np.zeros((len(often), len(self.qid)), np.float32)
        held = self.often[self.term] >= 0
        self.matrix[self.often[self.term[held]], row[held]] = weight[held]
        # what a sum of so many single-precision products may be off
        self.off = (self.size + 8) * 2.4e-7
        self.score, self.id = np.zeros((len(self.qid), k)), np.zeros((len(self.qid), k), np.int64)

    def meet(self, b: dict) -> None:
        """Score a block of records: in single precision against all queries, and exactly what may belong to the best."""
        size, words = len(b["id"]), b["words"].split()
        ends, word, n = b["ends"].astype(np.int64), b["word"].astype(np.int64), b["n"].astype(float)
        row = np.repeat(np.arange(size), np.diff(ends, prepend=0))
        term = np.array([self.at.get(w, -1) for w in words], np.int64)
        known = np.flatnonzero(term[word] >= 0)
        if not len(known):
            return
        t, r = term[word[known]], row[known]
        w = (n[known] / b["norm"][r]).astype(np.float32)
        held = self.often[t] >= 0
        left = np.zeros((size, len(self.matrix)), np.float32)
        left[r[held], self.often[t[held]]] = w[held]
        score = left @ self.matrix
        flat = score.reshape(-1)
        t, r, w = t[~held], r[~held], w[~held]
        total = np.cumsum(self.count[t])
        start = 0
        while start < len(t):
            end = max(start + 1, int(np.searchsorted(total, (total[start - 1] if start else 0) + SPREAD, "right")))
            c = self.count[t[start:end]]
            at = np.repeat(self.first[t[start:end]] - np.cumsum(c) + c, c) + np.arange(c.sum())
            np.add.at(flat, np.repeat(r[start:end] * len(self.qid), c) + self.listed[at], np.repeat(w[start:end], c) * self.weight[at])
            start = end
        low = np.maximum(self.score[:, -1] - self.off, 1e-30)
        near = score >= low.astype(np.float32)
        many = np.flatnonzero(near.sum(0) > self.k)
        if len(many):
            kth = np.partition(score[:, many], size - self.k, axis=0)[size - self.k]
            low[many] = np.maximum(low[many], kth - 2 * self.off[many])
            near[:, many] = score[:, many] >= low[many].astype(np.float32)
        r, q = np.nonzero(near)
        if not len(r):
            return
        # counts are multiplied as whole numbers, so that equal records score the same in any block
        back = np.full(len(self.at), -1)
        back[term[term >= 0]] = np.flatnonzero(term >= 0)
        c = self.size[q]
        at = np.repeat(self.ends[q] - np.cumsum(c), c) + np.arange(c.sum())
        found = back[self.term[at]]
        key = np.repeat(r * len(words), c) + found
        own = row * len(words) + word
        place = np.minimum(np.searchsorted(own, key), len(own) - 1)
        dot = np.where((found >= 0) & (own[place] == key), n[place] * self.n[at], 0.0)
        exact = np.add.reduceat(dot, np.cumsum(c) - c) / (self.norm[q] * b["norm"][r])
        seen = np.unique(q)
        qs = np.concatenate([np.repeat(seen, self.k), q])
        scores, ids = np.concatenate([self.score[seen].ravel(), exact]), np.concatenate([self.id[seen].ravel(), b["id"][r]])
        order = np.lexsort((ids, -scores, qs))
        first = np.searchsorted(qs[order], seen)
        take = order[first[:, None] + np.arange(self.k)]
        self.score[seen], self.id[seen] = scores[take], ids[take]

    def best(self) -> pd.DataFrame:
        out = pd.DataFrame({"qid": np.repeat(self.qid, self.k), "id": self.id.ravel(), "score": self.score.ravel()})
        return out[out["score"] > 0]


def lexical_topk(records: DataFrame, queries: DataFrame, k: int = 5) -> DataFrame:
    """Cosine of raw term counts; ``records(id, text)``, ``queries(qid, text)``.

    Records and queries are packed in blocks of bounded size, the records written once.  A task meets its blocks of records with one
    block of queries after the other: no record is shuffled for it and no query passes the driver; of a task only the best ``k`` for
    each query leave it.
    """
    spark = records.sparkSession
    few = spark.sparkContext.defaultParallelism
    terms = _spread(records.select("id", "text")).select("id", _terms(F.col("text")).alias("tok"))
    left = cut(_packed(terms, RECORD_BLOCK).coalesce(few))
    asked = once(queries.select(F.col("qid").alias("id"), "text"))
    asked = cut(asked.repartition(max(1, -(-asked.count() // QUERY_SLICE))).select("id", _terms(F.col("text")).alias("tok")).filter(F.size("tok") > 0))
    right = _packed(asked, QUERY_SLICE)
    right = right.select(F.monotonically_increasing_id().alias("slice"), F.col("id").alias("qid"), *[F.col(c).alias(f"q_{c}") for c in right.columns if c != "id"])

    def task(it: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        met: dict[int, _Asked] = {}
        for b in it:
            for row in b.to_dict("records"):
                if row["slice"] not in met:
                    met[row["slice"]] = _Asked(row, k)
                met[row["slice"]].meet(row)
        for one in met.values():
            yield one.best()

    return _ranked([left.hint("shuffle_replicate_nl").crossJoin(right).mapInPandas(task, TOP)], k)


def vector_topk(records: DataFrame, queries: DataFrame, k: int = 5) -> DataFrame:
    """Cosine of stored embeddings; ``records(id, embedding)``, ``queries(qid, embedding)``."""
    parts = []
    for rows in _slices(queries, ["qid", "embedding"], "qid"):
        if not rows:
            continue
        m = np.array([r["embedding"] for r in rows], dtype=float).T
        m /= np.maximum(np.sqrt((m * m).sum(0)), 1e-12)
        shared = records.sparkSession.sparkContext.broadcast((m, np.array([r["qid"] for r in rows])))

        def task(it: Iterator[pd.DataFrame], shared=shared) -> Iterator[pd.DataFrame]:
            m, qids = shared.value
            for b in it:
                if len(b):
                    v = np.stack(b["embedding"].to_numpy()).astype(float)
                    yield _local_top(v @ m / np.maximum(np.sqrt((v * v).sum(1)), 1e-12)[:, None], b["id"].to_numpy(), qids, k)

        parts.append(_spread(records.select("id", "embedding")).mapInPandas(task, "qid long, id long, score double"))
    return _ranked(parts, k)


def route_questions(questions: DataFrame) -> DataFrame:
    """Intent and concept of every question, first matching rule wins."""
    q = F.lower(F.trim(F.col("text")))
    c = concept(q)
    known = c.isNotNull()
    intent = (
        F.when(q == "", "clarify")
        .when(q.rlike(COUNT) & q.rlike(DAMAGED), "count_damage")
        .when(q.rlike(COUNT) & known, "count")
        .when(q.rlike(COUNT), "count_kinds")
        .when(known & q.rlike(MEASURE), "measure")
        .when(q.rlike(DAMAGE), "damage")
        .when(known & q.rlike(LOCATE), "locate")
        .when(q.rlike(RISK), "risk")
        .when(q.rlike(CHANGE), "change")
        .when(q.rlike(RECOMMEND), "recommendation")
        .when(q.rlike(SUMMARY), "summary")
        .otherwise("retrieval")
    )
    return questions.select("*", c.alias("concept"), intent.alias("intent"))


def answer_batch(routed: DataFrame, objects: DataFrame) -> DataFrame:
    """Counts and sums for the object questions, one row per question.

    Objects are summed per class first, so the join meets a handful of rows.
    """
    classes = [(c, k) for c, ks in CONCEPT_CLASSES.items() for k in ks]
    m = objects.sparkSession.createDataFrame(classes, "concept string, class string")
    w = Window.partitionBy("concept").orderBy("object_id")
    obj = objects.join(F.broadcast(m), "class")
    agg = obj.groupBy("concept").agg(F.count(F.lit(1)).alias("n"), *[F.sum(c).alias(f"total_{c}") for c in ("height", "area", "volume")])
    src = obj.withColumn("i", F.row_number().over(w)).filter(F.col("i") <= LIMIT_SOURCES).groupBy("concept").agg(
        F.concat_ws(",", F.transform(F.array_sort(F.collect_list("object_id")), lambda x: x.cast("string"))).alias("sources")
    )
    per = agg.join(src, "concept")
    q = F.lower("text")
    metric = F.when(q.contains("volume"), "volume").when(q.contains("height") | q.contains("tall"), "height").when(q.contains("area") | q.contains("size"), "area").otherwise("height")
    j = routed.filter(F.col("intent").isin("count", "measure", "locate")).join(F.broadcast(per), "concept", "left")
    value = F.when(F.col("intent") == "measure", F.when(metric == "volume", F.col("total_volume")).when(metric == "area", F.col("total_area")).otherwise(F.col("total_height"))).otherwise(F.coalesce("n", F.lit(0)).cast("double"))
    return j.select("qid", "intent", "concept", value.alias("answer"), "sources")


def low_confidence(objects: DataFrame, question: str | None = None, default: float = 0.8) -> DataFrame:
    """Objects below the percentage named in the question, else below 80 %."""
    pct = F.regexp_extract(F.lit(question or ""), r"(\d+(?:\.\d+)?)\s*%", 1).try_cast("double") / 100
    return objects.filter(F.coalesce("confidence", F.lit(1.0)) < F.coalesce(pct, F.lit(default)))


def class_summary(objects: DataFrame) -> DataFrame:
    return objects.groupBy("mission_id", "class").agg(F.count(F.lit(1)).alias("objects"), F.sum("height").alias("height"), F.sum("area").alias("area"), F.sum("volume").alias("volume"))
