"""Centroid clustering: Lloyd's rounds with Drake's adaptive bounds, exact on integers."""

from __future__ import annotations

import hashlib
import uuid

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tidemark.llm.frames import cut, remove, shared_folder
from tidemark.llm.topk import quantised
from tidemark.session import ship

#: A bound must be better by this share, so that the rounding of square roots decides nothing.
SLACK = 1e-9


def squared(vectors: np.ndarray, centroids: np.ndarray) -> np.ndarray:
    """Exact squared distances of all vectors to all centroids: by a floating-point product where all sums stay below 2**53."""
    most = max(np.abs(vectors).max(initial=0), np.abs(centroids).max(initial=0))
    if 4 * float(most) ** 2 * max(1, vectors.shape[1]) < 2**53:
        v, c = vectors.astype(np.float64), centroids.astype(np.float64)
        return ((v * v).sum(1)[:, None] - 2 * (v @ c.T) + (c * c).sum(1)).astype(np.int64)
    out = np.empty((len(vectors), len(centroids)), np.int64)
    for k, c in enumerate(centroids):
        out[:, k] = ((vectors - c) ** 2).sum(1)
    return out


def ranked(vectors: np.ndarray, centroids: np.ndarray, keep: int) -> dict[str, np.ndarray]:
    """By a scan of all centroids: each vector's nearest one, the ``keep`` next ones with lower bounds, and one bound for the rest.

    ``near``: numbers by rising distance, the nearest first; ``low``: the
    distance of each but the first, and of the one behind them, which bounds
    all others; ``up``: the distance of the first.
    """
    d = squared(vectors, centroids)
    order = np.argsort(d, axis=1, kind="stable")  # ties: smaller number
    root = np.sqrt(np.take_along_axis(d, order[:, : keep + 2], 1).astype(np.float64))
    if root.shape[1] < keep + 2:  # no others are left
        root = np.pad(root, ((0, 0), (0, keep + 2 - root.shape[1])), constant_values=np.inf)
    near = order[:, : keep + 1]
    return {"near": np.pad(near, ((0, 0), (0, keep + 1 - near.shape[1])), constant_values=-1), "up": root[:, 0], "low": root[:, 1:]}


def moved(state: dict[str, np.ndarray], vectors: np.ndarray, centroids: np.ndarray, steps: np.ndarray, keep: int) -> tuple[dict[str, np.ndarray], np.ndarray]:
    """The state after the centroids moved by ``steps``, and how far down each vector's list was looked at: ``keep`` + 1 is a scan of all.

    Bounds first move with their centroids, the rest's by the largest step; a
    bound also holds for all behind it. Vectors whose distance to their
    centroid is certainly below the first bound stay. For others this
    distance is measured; those that are certainly nearer than the bound at
    some place of their list are ranked anew among the centroids before that
    place; all others against all centroids. Where ``keep`` is less than
    before, the last bounds join the rest's.
    """
    near, up, low = state["near"], state["up"], state["low"]
    more = steps.max(initial=0.0)
    by = np.r_[steps, np.inf]  # for -1, a place without a centroid
    up = up + by[near[:, 0]]
    low = low - np.c_[np.where(near[:, 1:] < 0, 0, by[near[:, 1:]]), np.full(len(low), more)]
    low = np.minimum.accumulate(low[:, ::-1], axis=1)[:, ::-1]
    near, low = near[:, : keep + 1].copy(), low[:, : keep + 1].copy()
    looked = np.zeros(len(near), np.int64)
    open_ = np.flatnonzero(~(up * (1 + SLACK) < low[:, 0] * (1 - SLACK)))
    if len(open_):
        own = ((vectors[open_] - centroids[near[open_, 0]]) ** 2).sum(1)
        up[open_] = np.sqrt(own.astype(np.float64))
        looked[open_] = (~(up[open_, None] * (1 + SLACK) < low[open_] * (1 - SLACK))).sum(1)
    for z in range(1, keep + 1):  # ranks that are in question, the nearest's apart
        rows = np.flatnonzero(looked == z)
        if not len(rows):
            continue
        some = near[rows, : z + 1]
        d = np.stack([((vectors[rows] - centroids[some[:, k]]) ** 2).sum(1) for k in range(z + 1)], 1)
        order = np.lexsort((some, d), axis=1)
        near[rows, : z + 1] = np.take_along_axis(some, order, 1)
        root = np.sqrt(np.take_along_axis(d, order, 1).astype(np.float64))
        up[rows] = root[:, 0]
        # The bound at the place that was certain holds for all behind it, so what stands before is no larger.
        low[rows, :z] = np.minimum(root[:, 1:], low[rows, z][:, None])
    rows = np.flatnonzero(looked > keep)
    if len(rows):
        fresh = ranked(vectors[rows], centroids, keep)
        near[rows], up[rows], low[rows] = fresh["near"], fresh["up"], fresh["low"]
    return {"near": near, "up": up, "low": low}, looked


def _matrix(column, width: int, kind) -> np.ndarray:
    return column.flatten().to_numpy(zero_copy_only=False).astype(kind).reshape(len(column), width)


def _listed(rows: np.ndarray, kind) -> pa.Array:
    flat = pa.array(rows.reshape(-1), kind)
    return pa.ListArray.from_arrays(pa.array(np.arange(0, rows.size + 1, rows.shape[1]), pa.int32()), flat)


STATE = "vec_id {id}, v array<int>, near array<short>, up double, low array<double>, looked int"
LAST = "vec_id {id}, cluster int, distance long, looked int"


def _pass(rows: DataFrame, centroids: np.ndarray, keep: int, kept: int | None = None, steps: np.ndarray | None = None, last: bool = False) -> DataFrame:
    """The state of all vectors, from a scan or, with ``steps`` and lists of ``kept``, from the state before; if it is the last, clusters and exact distances instead."""
    width = centroids.shape[1]

    def assign(batches):
        for batch in batches:
            if not len(batch):
                continue
            v = _matrix(batch.column(1), width, np.int64)
            if steps is None:
                state, looked = ranked(v, centroids, keep), np.full(len(v), keep + 1)
            else:
                before = {"near": _matrix(batch.column(2), kept + 1, np.int64), "up": batch.column(3).to_numpy(), "low": _matrix(batch.column(4), kept + 1, np.float64)}
                state, looked = moved(before, v, centroids, steps, keep)
            if last:
                nearest = state["near"][:, 0]
                distance = ((v - centroids[nearest]) ** 2).sum(1)
                yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(nearest, pa.int32()), pa.array(distance), pa.array(looked, pa.int32())], ["vec_id", "cluster", "distance", "looked"])
                continue
            out = [batch.column(0), batch.column(1), _listed(state["near"], pa.int16()), pa.array(state["up"]), _listed(state["low"], pa.float64()), pa.array(looked, pa.int32())]
            yield pa.RecordBatch.from_arrays(out, ["vec_id", "v", "near", "up", "low", "looked"])

    columns = ["vec_id", "v"] if steps is None else ["vec_id", "v", "near", "up", "low"]
    return rows.select(*columns).mapInArrow(assign, (LAST if last else STATE).format(id=rows.schema["vec_id"].dataType.simpleString()))


def kmeans(df: DataFrame, id_col: str = "vec_id", vector_col: str = "embedding", clusters: int = 40, rounds: int = 5, width: int = 64, scale: int = 256, seed: int = 2) -> tuple[DataFrame, np.ndarray, list[dict]]:
    """Vectors' clusters (id, cluster, distance), the centroids, and per round its list's length and how many vectors were looked at how far.

    Components are floor(``scale`` * x). Centroids start as the ``clusters``
    vectors with the smallest sha256 of ``seed:id``; each round assigns every
    vector to the nearest, by squared distance, then number, and moves each
    centroid that has vectors to the floor of their mean; then all are
    assigned once more. All is exact: bounds only spare comparisons.

    Each vector keeps the numbers of its next nearest centroids with a lower
    bound each, and one bound for the rest (a quarter of all centroids; fewer
    in later rounds if no vector needed more). State goes to the shared
    folder each round, so a lost executor costs no round; the state before is
    removed. Sums are combined in the tasks; what reaches the driver and is
    sent out are ``clusters`` times ``width`` numbers.

    Vectors take part that have ``width`` components, none null, non-finite,
    or so large that a squared distance might not fit a long (beyond 2**27
    after scaling, at 64 components). A row without an id is assigned and counts but is no starting
    centroid. Repeated rows each count; those with one id start by the order
    of their components. With fewer vectors than ``clusters`` there are fewer
    centroids; an empty table has none. Other columns are not read.
    """
    spark = df.sparkSession
    ship(spark)
    v = quantised(F.col(f"`{vector_col}`"), scale)
    rows = df.where(F.size(F.col(f"`{vector_col}`")) == width).select(F.col(f"`{id_col}`").alias("vec_id"), v.alias("v"))
    largest = int((2**62 / width) ** 0.5) // 2
    fits = F.forall("v", lambda x: x.between(-largest, largest))
    rows = rows.where(F.col("v").isNotNull()).where(fits).withColumn("v", F.col("v").cast("array<int>"))
    start = rows.where("vec_id is not null").select(F.sha2(F.concat(F.lit(f"{seed}:"), F.col("vec_id").cast("string")), 256).alias("h"), "v").orderBy("h", "v").limit(clusters).collect()
    centroids = np.array([r["v"] for r in start], np.int64).reshape(-1, width)
    if not len(centroids):
        empty = spark.createDataFrame([], f"vec_id {rows.schema['vec_id'].dataType.simpleString()}, cluster int, distance long")
        return empty, centroids, []
    folder = f"{shared_folder(spark).rstrip('/')}/clusters/{uuid.uuid4().hex}"
    keep = max(1, min(len(centroids) // 4, len(centroids) - 2))
    state, kept, steps, log = rows, None, None, []
    for k in range(rounds + 1):
        after = _pass(state, centroids, keep, kept, steps, last=k == rounds)
        if k < rounds:
            after.write.parquet(f"{folder}/{k}")
            state, kept = spark.read.parquet(f"{folder}/{k}"), keep
        else:
            state = cut(after)
        if k:
            remove(spark, f"{folder}/{k - 1}")
        looked = {r["looked"]: r["n"] for r in state.groupBy("looked").agg(F.count("*").alias("n")).collect()}
        log.append({"round": k, "kept": keep, "looked": looked})
        if k == rounds:
            break
        sums = state.groupBy(F.get("near", F.lit(0)).alias("cluster")).agg(F.count("*").alias("n"), F.array(*[F.sum(F.get("v", F.lit(i))) for i in range(width)]).alias("s")).collect()
        new = centroids.copy()
        for r in sums:
            new[r["cluster"]] = np.array(r["s"], np.int64) // r["n"]  # rounds down
        steps, centroids = np.sqrt(((new - centroids) ** 2).sum(1).astype(np.float64)) * (1 + SLACK), new
        if k:  # the first scan tells nothing of lists
            far = max(looked)
            keep = max(1, len(centroids) // 8, min(keep, far)) if far <= keep else keep
    return state.drop("looked"), centroids, log


def cluster_rows(df: DataFrame, id_col: str = "vec_id", vector_col: str = "embedding", **more) -> DataFrame:
    """Per vector of :func:`kmeans`: cluster, distance, inertia of the cluster and of all, and the sha256 of the final centroid's components."""
    rows, centroids, _ = kmeans(df, id_col, vector_col, **more)
    found = {r["cluster"]: r["d"] for r in rows.groupBy("cluster").agg(F.sum("distance").alias("d")).collect()}
    total = sum(found.values())
    side = [(k, found.get(k), total, hashlib.sha256(",".join(map(str, c)).encode()).hexdigest()) for k, c in enumerate(centroids.tolist())]
    side = df.sparkSession.createDataFrame(side, "cluster int, cluster_inertia long, inertia long, centroid_sha256 string")
    return rows.join(F.broadcast(side), "cluster").select(F.col("vec_id").alias(id_col), "cluster", "distance", "cluster_inertia", "inertia", "centroid_sha256")


def cluster_sql(clusters: int = 40, rounds: int = 5, width: int = 64, scale: int = 256, seed: int = 2) -> str:
    """SQL that gives the rows of :func:`cluster_rows` over ``embeddings``, every vector against every centroid in each round."""

    def assigned(k: int) -> str:
        """The nearest centroid of each vector; a distance and a number are compared as one list."""
        d = "CAST(list_sum(list_transform(list_zip(v.x, c.x), lambda p: (p[1] - p[2]) * (p[1] - p[2]))) AS BIGINT)"
        return f"a{k} AS MATERIALIZED (SELECT row_no, any_value(vec_id) AS vec_id, any_value(v.x) AS x, min([{d}, c.cluster]) AS best FROM v, c{k} c GROUP BY row_no)"

    def centred(k: int) -> str:
        """Sums by component; the remainder is made positive, so that division rounds down."""
        return f"""s{k} AS (SELECT best[2] AS cluster, i, CAST(sum(x[i]) AS BIGINT) AS s, count(*) AS n FROM (SELECT best, x, unnest(range(1, {width + 1})) AS i FROM a{k}) GROUP BY ALL),
m{k} AS (SELECT cluster, list((s - ((s % n) + n) % n) // n ORDER BY i) AS x FROM s{k} GROUP BY cluster),
c{k + 1} AS MATERIALIZED (SELECT c.cluster, coalesce(m.x, c.x) AS x FROM c{k} c LEFT JOIN m{k} m USING (cluster))"""

    steps = [x for k in range(rounds) for x in (assigned(k), centred(k))] + [assigned(rounds)]
    return f"""
WITH q AS (
  SELECT vec_id, list_transform(embedding, lambda x: CAST(floor({scale} * CAST(x AS DOUBLE)) AS BIGINT)) AS x
  FROM embeddings
  WHERE len(embedding) = {width} AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0
), v AS MATERIALIZED (SELECT row_number() OVER () AS row_no, vec_id, x FROM q),
c0 AS MATERIALIZED (
  SELECT row_number() OVER (ORDER BY h, x) - 1 AS cluster, x
  FROM (SELECT sha256('{seed}:' || vec_id) AS h, x FROM v WHERE vec_id IS NOT NULL ORDER BY h, x LIMIT {clusters})
), {", ".join(steps)}
SELECT vec_id, CAST(best[2] AS INTEGER) AS cluster, best[1] AS distance,
       CAST(sum(best[1]) OVER (PARTITION BY best[2]) AS BIGINT) AS cluster_inertia, CAST(sum(best[1]) OVER () AS BIGINT) AS inertia,
       sha256(array_to_string(c.x, ',')) AS centroid_sha256
FROM a{rounds} a JOIN c{rounds} c ON a.best[2] = c.cluster
"""
