"""Exact top-k search by inner product over an impact-ordered index, score at a time."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, Window, functions as F

from skyfold.llm.store import columns, prepare, written

K = 5
SCALE = 256
STEP = 4  # width of a quantised impact
SHARD, BLOCK = 4096, 512  # vectors of an index shard, queries of a block
FEW = 0.02  # share of documents that may still be members when a proof is worth rescoring


class Index:
    """Postings of one shard: for every dimension and quantised impact the rows that hold it, in descending impact.

    ``tails[c]`` is, for each row, the length of what the segments before check point ``c`` do not tell about its vector.
    """

    def __init__(self, rows: np.ndarray, ids: np.ndarray, vectors: np.ndarray):
        self.rows, self.ids, self.vectors = rows, ids, vectors
        n, dim = vectors.shape
        level = np.floor_divide(vectors, STEP)
        self.mid = level * STEP + (STEP - 1) / 2
        row, col = np.divmod(np.arange(n * dim), dim)
        value = level.ravel()
        impact = np.abs(self.mid).ravel()
        order = np.lexsort((row, value, col, -impact))
        row, col, value, impact = row[order], col[order], value[order], impact[order]
        edge = np.flatnonzero(np.concatenate([[True], (col[1:] != col[:-1]) | (value[1:] != value[:-1])])) if len(row) else np.zeros(0, int)
        self.row, self.edge = row, np.append(edge, len(row))
        self.col, self.level, self.impact = col[edge], value[edge] * STEP + (STEP - 1) / 2, impact[edge]
        # check points: impacts 1/2, 1/4, ... of the largest, and the end
        top = float(self.impact[0]) if len(edge) else 0.0
        marks = sorted({int(np.searchsorted(-self.impact, -top / 2**c, "right")) for c in range(1, 7)} | {len(edge)})
        self.checks = [m for m in marks if m > 0]
        self.tails = []
        for m in self.checks:
            done = np.abs(self.mid) >= self.impact[m - 1] if m < len(edge) else np.ones_like(self.mid, bool)
            self.tails.append(np.sqrt((np.where(done, vectors - self.mid, vectors) ** 2).sum(1)))

    def search(self, query_rows: np.ndarray, queries: np.ndarray, k: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Place of the query, vec_id and score of rows that hold each query's ``k`` best, exactly scored; a query's own row is none.

        Segments are read in descending impact.  At a check point a row's score lies within ``|query| * tail`` of what is summed up
        (Cauchy-Schwarz), so a row whose upper bound is below the k-th lower bound is proved out.  Reading stops only when that leaves
        few possible members, or at the end; they are scored from their vectors.
        """
        q = queries.astype(float)
        norm = np.sqrt((q**2).sum(1))
        acc = np.zeros((len(self.ids), len(q)))
        own = self.rows[:, None] == query_rows[None, :]
        at = 0
        possible = ~own
        for m, tail in zip(self.checks, self.tails):
            for s in range(at, m):
                acc[self.row[self.edge[s] : self.edge[s + 1]]] += self.level[s] * q[:, self.col[s]]
            at = m
            slack = tail[:, None] * norm[None, :] * (1 + 1e-9) + 1e-6
            low = np.where(own, -np.inf, acc - slack)
            best = np.partition(low, -k, axis=0)[-k] if len(low) >= k else np.full(len(q), -np.inf)
            possible = ~own & (acc + slack >= best)
            if possible.mean() <= FEW:
                break
        rows, which = np.nonzero(possible)
        score = np.empty(len(rows), np.int64)
        for i in range(0, len(rows), 65536):
            score[i : i + 65536] = (self.vectors[rows[i : i + 65536]] * queries[which[i : i + 65536]]).sum(1)
        order = np.lexsort((self.ids[rows], -score, which))
        rows, which, score = rows[order], which[order], score[order]
        place = np.arange(len(which)) - np.searchsorted(which, which)
        keep = place < k
        return which[keep], self.ids[rows[keep]], score[keep]


def _packed(vectors: DataFrame, size: int, name: str) -> DataFrame:
    """Vectors dealt evenly into rows ``no, rows, ids, data, dim`` of about ``size`` vectors; the number of rows follows the table."""
    n = max(1, -(-vectors.count() // size))

    def pack(pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.sort_values(["vec_id", "row"])
        dim = max(map(len, pdf["v"]), default=0)
        data = np.zeros((len(pdf), dim), np.int64)
        for i, v in enumerate(pdf["v"]):
            data[i, : len(v)] = v
        return pd.DataFrame({"no": [pdf["no"].iloc[0]], "rows": [pdf["row"].to_numpy(np.int64).tobytes()], "ids": [pdf["vec_id"].to_numpy(np.int64).tobytes()], "data": [data.tobytes()], "dim": [dim]})

    dealt = vectors.withColumn("no", F.pmod(F.monotonically_increasing_id(), F.lit(n)))
    return written(dealt.groupBy("no").applyInPandas(pack, "no long, rows binary, ids binary, data binary, dim long"), name)


def _unpack(rows: bytes, ids: bytes, data: bytes, dim: int, width: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    keys = np.frombuffer(ids, np.int64)
    own = np.frombuffer(data, np.int64).reshape(len(keys), dim)
    return np.frombuffer(rows, np.int64), keys, np.pad(own, ((0, 0), (0, width - dim))) if dim < width else own


def top_k(embeddings: DataFrame, is_query, k: int = K, shard: int = SHARD, block: int = BLOCK) -> DataFrame:
    """``query_id, rank, vec_id, score``: the ``k`` best integer inner products of each query with all rows but its own.

    ``embeddings(vec_id, embedding)``; components become ``floor(256 * x)``.  ``is_query`` is a condition on the rows.  Rows are dealt
    into index shards, queries into blocks; each shard meets each block of the stated query set once, and only the ``k`` best of a
    shard leave it.  Ties go to the smaller vec_id.  Every row has a number of its own: rows that share a vec_id are queries and
    candidates each, and only a query's own row is barred.

    Vectors that are null or hold null or non-finite components take no part, nor do null vec_ids; shorter vectors count as zero beyond
    their end; fewer than ``k`` other rows give fewer results; an empty table gives none.  Other columns are ignored.
    """
    columns(embeddings, "vec_id", "embedding")
    spark = embeddings.sparkSession
    prepare(spark)
    wide = F.col("embedding").cast("array<double>")
    fine = F.col("embedding").isNotNull() & F.col("vec_id").isNotNull() & F.forall(wide, lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf")))
    vectors = embeddings.filter(fine).select(F.col("vec_id").cast("long").alias("vec_id"), F.transform(wide, lambda x: F.floor(x * SCALE)).alias("v"), F.coalesce(is_query, F.lit(False)).alias("asks"), F.monotonically_increasing_id().alias("row"), F.array_max(F.transform(wide, lambda x: F.abs(x) * SCALE)).alias("most"))
    vectors = written(vectors, "topk-vectors")
    most, dim = vectors.agg(F.max("most"), F.max(F.size("v"))).first()
    if dim and (most + 1) ** 2 * dim >= 2.0**63:
        raise ValueError(f"components up to {most / SCALE} in {dim} dimensions may give products beyond 64 bits")
    vectors = vectors.drop("most")
    shards, blocks = _packed(vectors.drop("asks"), shard, "topk-shards"), _packed(vectors.filter("asks").drop("asks"), block, "topk-queries")
    n = shards.count()
    asked = blocks.select(F.col("rows").alias("q_rows"), F.col("ids").alias("q_ids"), F.col("data").alias("q_data"), F.col("dim").alias("q_dim"), F.explode(F.sequence(F.lit(0).cast("long"), F.lit(max(0, n - 1)).cast("long"))).alias("no"))
    met = shards.join(asked.hint("shuffle_merge"), "no").sortWithinPartitions("no")

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        last, index = None, None
        for frame in frames:
            for r in frame.itertuples(index=False):
                width = max(r.dim, r.q_dim)
                if (r.no, width) != last:
                    index = Index(*_unpack(r.rows, r.ids, r.data, r.dim, width))
                    last = (r.no, width)
                rows, ids, queries = _unpack(r.q_rows, r.q_ids, r.q_data, r.q_dim, width)
                q, v, s = index.search(rows, queries, k)
                yield pd.DataFrame({"row": rows[q], "query_id": ids[q], "vec_id": v, "score": s})

    found = met.mapInPandas(run, "row long, query_id long, vec_id long, score long")
    rank = F.row_number().over(Window.partitionBy("row").orderBy(F.desc("score"), "vec_id"))
    return found.withColumn("rank", rank).filter(F.col("rank") <= k).select("query_id", "rank", "vec_id", "score")


def digest(embeddings: DataFrame) -> DataFrame:
    return top_k(embeddings, F.col("vec_id") % 50 == 0)


SQL = """WITH v AS (SELECT row_number() OVER () AS rid, vec_id, list_transform(embedding, lambda x: floor(256 * x::DOUBLE)) AS e FROM embeddings
  WHERE embedding IS NOT NULL AND vec_id IS NOT NULL AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0),
s AS (SELECT q.rid, q.vec_id AS query_id, c.vec_id, CAST(list_inner_product(q.e, c.e) AS BIGINT) AS score FROM v q JOIN v c ON q.rid != c.rid WHERE q.vec_id % 50 = 0)
SELECT query_id, CAST(row_number() OVER (PARTITION BY rid ORDER BY score DESC, vec_id) AS INTEGER) AS rank, vec_id, score FROM s QUALIFY rank <= 5"""
