"""Exact top-k inner-product search with block-at-a-time pruning."""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tidemark.session import ship

#: Rows of a document-range block, whose term maxima bound its scores.
BLOCK = 256
#: Candidates of one task at most, as forward index of its blocks, on average.
SHARD = 8192
#: Queries that a task holds at a time, on average.
QUERY_BLOCK = 2048


def quantised(vector: Column, scale: int = 1024) -> Column:
    """floor(scale * x) of each component; null for a vector that is null or holds a null or non-finite component."""
    wide = F.transform(vector, lambda x: x.cast("double"))
    finite = ~F.exists(wide, lambda x: x.isNull() | F.isnan(x) | (F.abs(x) == float("inf")))
    return F.when(vector.isNotNull() & finite, F.transform(wide, lambda x: F.floor(F.lit(float(scale)) * x).cast("long")))


def _matrix(rows, width: int) -> np.ndarray:
    """Vectors as rows, shorter ones filled with zeros."""
    out = np.zeros((len(rows), width), np.int64)
    for k, row in enumerate(rows):
        out[k, : len(row)] = row
    return out


def _products(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Exact integer products: by floating point where all partial sums stay below 2**53."""
    most = float(np.abs(a).max(initial=0)) * float(np.abs(b).max(initial=0)) * max(1, a.shape[1])
    if most < 2**53:
        return (a.astype(np.float64) @ b.T.astype(np.float64)).astype(np.int64)
    return a @ b.T


def search_shard(query_ids, queries, ids, vectors, k: int, block: int = BLOCK):
    """Per query its ``k`` best candidates (score down, id up) of one shard.

    Blocks are ranges of candidates in the order of their ids. A block's
    bound for a query sums, over components, the larger of the query's
    component times the block's maximum and times its minimum. Each query
    meets the blocks by falling bound and stops where the bound is below its
    k-th score; queries that meet the same block in the same round are scored
    together through the block's rows.
    """
    order = np.argsort(ids, kind="stable")
    ids, vectors = ids[order], vectors[order]
    cuts = np.arange(0, len(ids), block)
    highs, lows = np.maximum.reduceat(vectors, cuts), np.minimum.reduceat(vectors, cuts)
    # The larger of q*high and q*low is q*high for q >= 0 and q*low for q < 0.
    bounds = _products(np.maximum(queries, 0), highs) + _products(np.minimum(queries, 0), lows)
    visit = np.argsort(-bounds, axis=1, kind="stable")
    best = [(np.empty(0, np.int64), np.empty(0, np.int64))] * len(query_ids)
    alive = np.arange(len(query_ids))
    for step in range(len(cuts)):
        own = visit[alive, step]
        bound = bounds[alive, own]
        kth = np.array([best[q][0][k - 1] if len(best[q][0]) >= k else np.iinfo(np.int64).min for q in alive])
        stay = bound >= kth  # equal scores may still win by a smaller id
        alive, own = alive[stay], own[stay]
        if not len(alive):
            break
        for b in np.unique(own):
            mine = alive[own == b]
            part = slice(cuts[b], min(cuts[b] + block, len(ids)))
            scores = _products(queries[mine], vectors[part])
            for q, row in zip(mine, scores, strict=True):
                fit = np.flatnonzero(ids[part] != query_ids[q])
                s, i = np.r_[best[q][0], row[fit]], np.r_[best[q][1], ids[part][fit]]
                top = np.lexsort((i, -s))[:k]
                best[q] = (s[top], i[top])
    return best


def top_k(df: DataFrame, is_query: Column, id_col: str = "vec_id", vector_col: str = "embedding", k: int = 10, scale: int = 1024) -> DataFrame:
    """The ``k`` candidates of highest integer inner product for each query row.

    Queries are the rows for which ``is_query`` holds; candidates are all
    rows with another id. Candidates are dealt by a hash of id and vector
    into shards of a fixed size, queries into blocks of a fixed size; each
    shard meets each query block once, on the executors, and returns at most
    ``k`` rows a query, from which the best are ranked. The work is that of
    all queries against all rows less what the block bounds prune; no side is
    broadcast or held whole anywhere, and no key gathers more than a shard.

    Rows with a null id take no part, nor do vectors that are null or hold a
    null or non-finite component. Shorter vectors count as filled with zeros;
    empty ones score 0. Ties go to the smaller id. Repeated candidate rows
    each count; of repeated query rows with one id and vector one is asked,
    and of different vectors under one id each. An empty table, or fewer than
    ``k`` candidates, gives what there is.
    """
    ship(df.sparkSession)
    rows = df.where(F.col(id_col).isNotNull()).select(F.col(id_col).cast("long").alias("id"), quantised(F.col(vector_col), scale).alias("v"), F.coalesce(is_query, F.lit(False)).alias("q")).where(F.col("v").isNotNull())
    size = rows.agg(F.count("*").alias("n"), F.count_if("q").alias("m"), F.max(F.size("v")).alias("width")).first()
    shards, blocks, width = max(1, -(-size["n"] // SHARD)), max(1, -(-size["m"] // QUERY_BLOCK)), size["width"] or 0
    deal = lambda seed, n, *more: F.pmod(F.xxhash64(F.lit(seed), "id", "v", *more), F.lit(n))
    # By id and vector, so that neither a common vector nor a range of ids makes a large shard.
    candidates = rows.select("id", "v", deal(1, shards).alias("shard")).withColumn("part", F.explode(F.sequence(F.lit(0), F.lit(blocks - 1))))
    queries = rows.where("q").select("id", "v").distinct().withColumn("part", deal(2, blocks).cast("int")).withColumn("shard", F.explode(F.sequence(F.lit(0).cast("long"), F.lit(shards - 1).cast("long"))))

    def search(q: pd.DataFrame, c: pd.DataFrame) -> pd.DataFrame:
        out: dict[str, list] = {"query_id": [], "number": [], "vec_id": [], "score": []}
        if len(q) and len(c):
            q = q.sort_values("id", kind="stable")
            ids = q["id"].to_numpy()
            found = search_shard(ids, _matrix(list(q["v"]), width), c["id"].to_numpy(), _matrix(list(c["v"]), width), k)
            digest = q["digest"].to_numpy()
            for n, (scores, mates) in enumerate(found):
                out["query_id"] += [ids[n]] * len(mates)
                out["number"] += [digest[n]] * len(mates)
                out["vec_id"] += mates.tolist()
                out["score"] += scores.tolist()
        return pd.DataFrame(out)

    queries = queries.withColumn("digest", F.xxhash64("v"))
    found = queries.groupBy("part", "shard").cogroup(candidates.groupBy("part", "shard")).applyInPandas(search, "query_id long, number long, vec_id long, score long")
    w = Window.partitionBy("query_id", "number").orderBy(F.col("score").desc(), F.col("vec_id"))
    return found.withColumn("rank", F.row_number().over(w)).where(F.col("rank") <= k).select("query_id", "rank", F.col("vec_id"), "score")
