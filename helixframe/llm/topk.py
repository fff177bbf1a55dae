"""Exact top-k inner-product search by columnar branch and bound.

Vectors are dealt into cells (a block of queries by a block of rows). A cell holds its rows in vertical layout, dimension by
dimension, and accumulates scores one block of dimensions at a time. What a row can still gain is at most the product of the
remaining lengths of both vectors (its remaining mass); rows whose best possible score is below the k-th best certain score
are compacted away before the next block."""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from helixframe.llm.common import ship

DIMENSIONS = 16
OUT = "query_id long, vec_id long, score long"
LONG = (1 << 63) - 1


def best(q: np.ndarray, x: np.ndarray, k: int, own: np.ndarray | None = None) -> tuple[list[np.ndarray], list[np.ndarray]]:
    """For each row of q (integers in float64 or object): the indexes of all columns of x (dimensions by rows) that can be
    among its k best, and their exact scores. own: for each row of q the column that takes no part, or -1."""
    d, n = x.shape
    edges = [*range(0, d, DIMENSIONS), d]
    mass_x = [np.sqrt((x[a:] * x[a:]).astype(float).sum(0)) for a in edges]
    mass_q = [np.sqrt((q[:, a:] * q[:, a:]).astype(float).sum(1)) for a in edges]
    first = q[:, : edges[1]] @ x[: edges[1]]
    found, scores = [], []
    for i in range(len(q)):
        rows, score = np.arange(n), first[i]
        if own is not None and own[i] >= 0:
            rows = np.delete(rows, own[i])
            score = score[rows]
        for j in range(1, len(edges)):
            if j > 1:
                a, b = edges[j - 1], edges[j]
                score = score + q[i, a:b] @ x[a:b][:, rows]
            if len(rows) > k:
                at = score.astype(float)
                rest = mass_q[j][i] * mass_x[j][rows] * (1 + 1e-9)
                slack = 1e-9 * (np.abs(at) + rest)
                sure = np.partition(at - rest - slack, len(rows) - k)[len(rows) - k]
                keep = at + rest + slack >= sure
                rows, score = rows[keep], score[keep]
        found.append(rows)
        scores.append(score)
    return found, scores


def _cell(k: int):
    def run(t: pa.Table) -> pa.Table:
        ids = t.column("vec_id").to_numpy()
        is_query = t.column("is_query").to_numpy()
        vectors = t.column("v").combine_chunks()
        values, offsets = vectors.flatten().to_numpy(), np.asarray(vectors.offsets) - vectors.offsets[0].as_py()
        d = int(np.diff(offsets).max(initial=0))
        m = np.zeros((len(ids), max(d, 1)))
        lengths = np.diff(offsets)
        m[np.repeat(np.arange(len(ids)), lengths), np.arange(len(values)) - np.repeat(offsets[:-1], lengths)] = np.floor(256 * values.astype(float))
        if float(np.abs(m).max(initial=0)) ** 2 * m.shape[1] >= 2.0**53:  # beyond exact doubles: Python's integers
            m = np.array([[int(v) for v in row] for row in m], object)
        q, x, x_ids = m[is_query], np.ascontiguousarray(m[~is_query].T), ids[~is_query]
        at = {v: i for i, v in enumerate(x_ids.tolist())}
        out_q, out_v, out_s = [], [], []
        asked = ids[is_query].tolist() if len(x_ids) else []
        for query, rows, score in zip(asked, *best(q[: len(asked)], x, k, np.array([at.get(v, -1) for v in asked], int)), strict=True):
            order = sorted(zip([-max(-LONG, min(LONG, int(s))) for s in score], x_ids[rows].tolist(), strict=True))[:k]
            out_q += [query] * len(order)
            out_v += [v for _, v in order]
            out_s += [-s for s, _ in order]
        return pa.table({"query_id": pa.array(out_q, pa.int64()), "vec_id": pa.array(out_v, pa.int64()), "score": pa.array(out_s, pa.int64())})

    return run


def top_k(vectors: DataFrame, is_query: Column, k: int = 5, query_block: int = 2048) -> DataFrame:
    """vectors: vec_id and embedding; other columns are ignored. Returns query_id, rank (from 1), vec_id, score: the k highest
    integer inner products of floor(256 x) with every other row, ties to the smaller vec_id.

    Rows with a null vec_id, a null vector or a null or non-finite component take no part; of rows that share a vec_id the one
    with the smallest vector stands for all. Shorter vectors count as filled up with zeros. Scores beyond a long are held at its ends.
    No query or no row: no result. Work is queries times rows, in blocks; rows go to each block of queries once."""
    ship(vectors.sparkSession)
    finite = F.forall("embedding", lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf")))
    rows = vectors.where(F.col("vec_id").isNotNull() & F.col("embedding").isNotNull() & finite).groupBy("vec_id").agg(F.min("embedding").alias("v"))
    n, n_queries = (int(x or 0) for x in vectors.agg(F.count("vec_id"), F.sum(is_query.cast("int"))).first())
    block = min(65_536, max(1024, n // 64))
    wide, high = max(1, -(-n // block)), max(1, -(-n_queries // query_block))
    code = F.xxhash64("vec_id")
    cells = rows.select("vec_id", "v", F.lit(False).alias("is_query"), F.pmod(code, F.lit(wide)).alias("c"), F.explode(F.sequence(F.lit(0).cast("long"), F.lit(high - 1).cast("long"))).alias("r"))
    asked = rows.where(is_query).select("vec_id", "v", F.lit(True).alias("is_query"), F.explode(F.sequence(F.lit(0).cast("long"), F.lit(wide - 1).cast("long"))).alias("c"), F.pmod(code, F.lit(high)).alias("r"))
    found = cells.unionByName(asked).groupBy("c", "r").applyInArrow(_cell(k), OUT)
    rank = F.row_number().over(Window.partitionBy("query_id").orderBy(F.desc("score"), "vec_id"))
    return found.withColumn("rank", rank).where(F.col("rank") <= k).select("query_id", "rank", "vec_id", "score")


def op10_top_k(spark: SparkSession, sf_dir: str) -> DataFrame:
    vectors = spark.read.parquet(f"{sf_dir}/embeddings.parquet")
    return top_k(vectors, F.col("vec_id") % 50 == 0)


OP10_SQL = """
WITH v AS (
  SELECT vec_id, list_transform(embedding, lambda x: CAST(floor(256 * CAST(x AS DOUBLE)) AS BIGINT)) AS v
  FROM embeddings
  WHERE vec_id IS NOT NULL AND embedding IS NOT NULL AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0),
s AS (
  SELECT q.vec_id AS query_id, c.vec_id, CAST(list_sum(list_transform(list_zip(q.v, c.v), lambda p: p[1] * p[2])) AS BIGINT) AS score
  FROM v q JOIN v c ON q.vec_id <> c.vec_id WHERE q.vec_id % 50 = 0)
SELECT query_id, CAST(rank AS INTEGER) AS rank, vec_id, score
FROM (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, vec_id) AS rank FROM s) t WHERE rank <= 5
"""
