"""Exact top-k inner products by pivot-table elimination.

Each vector's distances to a few dozen pivots are computed once and kept beside it. By the triangle inequality the
greatest difference of two rows of that table is a lower bound of the vectors' distance, and so, with
the norms, gives an upper bound of their inner product. A tile of candidates is gone through in the
order of that bound, and left as soon as the bound falls under the k-th score found: the result is exact.

The pivots are chosen from ``SAMPLE`` vectors (those with the smallest hashed ids), farthest first; they
steer cost only. Queries and candidates meet in tiles of bounded size, each vector in its own block.

Defined cases: vectors that are null or hold a null or non-finite component take no part; only vectors
of one dimension are compared; every row with a repeated id is a candidate of its own, but not for queries
of that id, whose rows share one list; ties go to the smaller id; fewer than k candidates give them all; an
empty table gives no rows; other columns are not read.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from lakequill.llm.common import checkpointed

SCALE = 1024
SAMPLE, PIVOTS = 1024, 32
QUERY_BLOCK = 2048
LEAST_BLOCK, MOST_BLOCK = 2048, 65_536


def quantized(vectors: list) -> np.ndarray:
    """floor(1024 x) for each component, x as double; whole numbers held as doubles while all sums stay exact, else as Python integers."""
    v = np.floor(np.array(vectors, np.float64) * SCALE)
    top = float(np.abs(v).max()) if v.size else 0.0
    if top * top * max(1, v.shape[1]) < 2**50:
        return v
    return np.array([[int(x) for x in row] for row in v], object)


def choose_pivots(sample: np.ndarray, n: int = PIVOTS) -> np.ndarray:
    """Farthest-first choice out of a sample."""
    chosen, far = [0], None
    while len(chosen) < min(n, len(sample)):
        d = ((sample - sample[chosen[-1]]) ** 2).sum(1)
        far = d if far is None else np.minimum(far, d)
        chosen.append(int(far.argmax()))
    return sample[chosen]


def table_row(v: np.ndarray, pivots: np.ndarray) -> np.ndarray:
    """Distances to the pivots, from exact squares."""
    norms, to = (v * v).sum(1), (pivots * pivots).sum(1)
    return np.sqrt(np.maximum(0, norms[:, None] + to[None, :] - 2 * (v @ pivots.T)))


def search_tile(q_ids, q, q_table, c_ids, c, table, k: int) -> Iterator[tuple[int, int, int]]:
    """Best k candidates of each query inside one tile, as (query, candidate, score); both with their rows of the pivot table."""
    order = np.argsort(c_ids, kind="stable")
    c_ids, c, table = c_ids[order], c[order], table[order]
    if q.dtype == object or c.dtype == object:
        for i, row in zip(q_ids.tolist(), q, strict=True):
            scores = [(-int(sum(int(a) * int(b) for a, b in zip(row, x, strict=True))), j) for j, x in zip(c_ids.tolist(), c, strict=True) if j != i]
            yield from ((i, j, -s) for s, j in sorted(scores)[:k])
        return
    norms = (c * c).sum(1)
    for i, row, to in zip(q_ids.tolist(), q, q_table, strict=True):
        apart = np.abs(table - to).max(1)
        own = float((row * row).sum())
        bound = (own + norms - apart * apart) / 2 + 1e-9 * (own + norms) + 1
        by_bound = np.argsort(-bound, kind="stable")
        best_s, best_j = np.empty(0), np.empty(0, np.int64)
        at, step = 0, 4 * k
        while at < len(by_bound):
            if len(best_s) == k and bound[by_bound[at]] < best_s[-1]:
                break
            some = by_bound[at : at + step]
            some = some[c_ids[some] != i]
            s, j = np.concatenate([best_s, c[some] @ row]), np.concatenate([best_j, c_ids[some]])
            keep = np.lexsort((j, -s))[:k]
            best_s, best_j = s[keep], j[keep]
            at, step = at + step, step * 2
        yield from zip([i] * len(best_j), best_j.tolist(), best_s.astype(np.int64).tolist(), strict=True)


def top_k(vectors: DataFrame, is_query, k: int = 10, key: str = "vec_id", vector: str = "embedding") -> DataFrame:
    """``(query_id, rank, vec_id, score)`` for the rows that ``is_query`` holds of, against all rows but the query's own."""
    spark = vectors.sparkSession
    v = F.col(vector)
    usable = v.isNotNull() & F.col(key).isNotNull() & (F.size(v) > 0) & F.forall(v, lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x.cast("double")) < F.lit(float("inf"))))
    valid = vectors.where(usable).select(F.col(key).cast("long").alias("vec_id"), v.cast("array<double>").alias("v")).withColumn("dim", F.size("v"))
    valid = checkpointed(valid.withColumn("row", F.monotonically_increasing_id()))
    rows = valid.count()
    if not rows:
        return spark.createDataFrame([], "query_id long, rank int, vec_id long, score long")
    block = min(MOST_BLOCK, max(LEAST_BLOCK, rows // (4 * spark.sparkContext.defaultParallelism)))
    c_blocks = -(-rows // block)
    sample = valid.orderBy(F.xxhash64("vec_id"), "vec_id", "v").limit(SAMPLE).select("dim", "v").collect()
    by_dim: dict[int, list] = {}
    for r in sample:
        by_dim.setdefault(r["dim"], []).append(r["v"])
    pivots = {d: choose_pivots(p) for d, vs in by_dim.items() if (p := quantized(vs)).dtype != object}

    def measured(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            for dim, part in pdf.groupby("dim"):
                x, ps = quantized(part.v.tolist()), pivots.get(int(dim))
                exact = ps is not None and x.dtype != object
                yield part.assign(d=list(table_row(x, ps)) if exact else [[]] * len(part))

    # the pivot table: every vector's distances, once
    valid = checkpointed(valid.mapInPandas(measured, "vec_id long, v array<double>, dim int, row long, d array<double>"))
    queries = valid.where(is_query(F.col("vec_id")))
    q_blocks = max(1, -(-queries.count() // QUERY_BLOCK))

    def tile(key_, q: pd.DataFrame, c: pd.DataFrame) -> pd.DataFrame:
        out = []
        if len(q) and len(c):
            qv, cv, qd, cd = quantized(q.v.tolist()), quantized(c.v.tolist()), q.d.tolist(), c.d.tolist()
            if any(len(x) == 0 for x in (*qd, *cd)):
                # too large for exact sums of doubles, or a dimension that the sample lacks
                big = max(float(np.abs(x).max()) for x in (qv, cv)) ** 2 * qv.shape[1] >= 2**50
                ps = cv[: 2 * PIVOTS]
                qv, cv = (np.array([[int(x) for x in r] for r in m], object) for m in (qv, cv)) if big else (qv, cv)
                qd, cd = ([[]] * len(qv), [[]] * len(cv)) if big else (table_row(qv, ps), table_row(cv, ps))
            out = list(search_tile(q.vec_id.to_numpy(), qv, np.array([*qd]), c.vec_id.to_numpy(), cv, np.array([*cd]), k))
        return pd.DataFrame(out, columns=["query_id", "vec_id", "score"]).astype("int64")

    def spread(n: int):
        return F.explode(F.sequence(F.lit(0), F.lit(n - 1)))

    mine = lambda n: F.pmod(F.xxhash64("row"), F.lit(n)).cast("int")
    qs = queries.select("dim", spread(c_blocks).alias("c"), mine(q_blocks).alias("q"), "vec_id", "v", "d")
    cs = valid.select("dim", mine(c_blocks).alias("c"), spread(q_blocks).alias("q"), "vec_id", "v", "d")
    found = qs.groupBy("dim", "c", "q").cogroup(cs.groupBy("dim", "c", "q")).applyInPandas(tile, "query_id long, vec_id long, score long")
    ranked = found.withColumn("rank", F.row_number().over(W.partitionBy("query_id").orderBy(F.desc("score"), "vec_id")))
    return ranked.where(F.col("rank") <= k).select("query_id", "rank", "vec_id", "score")


ORACLE = """
WITH v AS (
  SELECT vec_id, list_transform(embedding, lambda x: CAST(floor(1024 * CAST(x AS DOUBLE)) AS BIGINT)) AS e FROM embeddings
  WHERE embedding IS NOT NULL AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0
), s AS (
  SELECT q.vec_id AS query_id, c.vec_id AS vec_id, CAST(list_sum(list_transform(list_zip(q.e, c.e), lambda p: p[1] * p[2])) AS BIGINT) AS score
  FROM v q JOIN v c ON q.vec_id <> c.vec_id WHERE q.vec_id % 100 = 0
), r AS (SELECT *, CAST(row_number() OVER (PARTITION BY query_id ORDER BY score DESC, vec_id) AS INTEGER) AS rank FROM s)
SELECT query_id, rank, vec_id, score FROM r WHERE rank <= 10
"""
