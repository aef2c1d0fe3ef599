import hashlib
import math
import random

import numpy as np
import pytest

from tidemark.llm.clusters import cluster_rows, kmeans, moved, ranked, squared
from tidemark.llm.frames import read


def plain(rows, clusters=40, rounds=5, width=64, scale=256):
    kept = [(i, tuple(math.floor(scale * float(x)) for x in v)) for i, v in rows if v is not None and len(v) == width and all(x is not None and math.isfinite(x) for x in v)]
    kept = [(i, v) for i, v in kept if all(abs(x) <= 2**27 for x in v)]
    start = sorted((hashlib.sha256(f"2:{i}".encode()).hexdigest(), v) for i, v in kept if i is not None)[:clusters]
    c = [list(v) for _, v in start]
    for k in range(rounds + 1):
        best = [min((sum((a - b) ** 2 for a, b in zip(v, x, strict=True)), n) for n, x in enumerate(c)) for _, v in kept] if c else []
        if k < rounds:
            for n in range(len(c)):
                mine = [v for (_, v), b in zip(kept, best, strict=True) if b[1] == n]
                if mine:
                    c[n] = [sum(p) // len(mine) for p in zip(*mine, strict=True)]
    sums = {n: sum(d for d, m in best if m == n) for n in range(len(c))}
    sha = [hashlib.sha256(",".join(map(str, x)).encode()).hexdigest() for x in c]
    return [(i, n, d, sums[n], sum(sums.values()), sha[n]) for (i, _), (d, n) in zip(kept, best, strict=True)] if c else []


def ordered(rows):
    return sorted(map(tuple, rows), key=str)


@pytest.mark.parametrize("clusters,spread", [(40, 5), (12, 60), (3, 4), (2, 3), (1, 3)])
def test_bounds_equal_scans(clusters, spread):
    """Round after round of moving centroids: the same nearest centroid as a scan gives, with ties, and fewer scans."""
    rng = np.random.default_rng(clusters)
    centres = rng.integers(-spread, spread, (clusters, 8)) * 3
    v = (centres[rng.integers(0, clusters, 900)] + rng.integers(-2, 3, (900, 8))).astype(np.int64)
    c = v[:clusters].copy()
    keep = max(1, min(clusters // 4, clusters - 2))
    state, scans = ranked(v, c, keep), []
    for step in range(12):
        new = c + rng.integers(-1, 2, c.shape) * (rng.random((clusters, 1)) < 0.3)
        shift = np.sqrt(((new - c) ** 2).sum(1)) * (1 + 1e-9)
        keep = max(1, keep - step % 2)
        state, looked = moved(state, v, new, shift, keep)
        c = new
        assert state["near"][:, 0].tolist() == squared(v, c).argmin(1).tolist()
        scans.append((looked > keep).mean())
    assert np.mean(scans) < 1


def test_distances_are_exact():
    v = np.array([[2**27, -(2**27)] * 32, [1, 2] * 32])
    c = np.array([[-(2**27), 2**27] * 32, [0, 0] * 32])
    assert squared(v, c).tolist() == [[64 * 2**56, 64 * 2**54], [32 * ((2**27 + 1) ** 2 + (2**27 - 2) ** 2), 160]]


def test_whole_table(spark, sf):
    df = read(spark, sf, "embeddings")
    assert ordered(cluster_rows(df).collect()) == ordered(plain([(r.vec_id, r.embedding) for r in df.collect()]))
    log = kmeans(df)[2]
    assert all(sum(x["looked"].values()) == df.count() for x in log)
    assert sum(n for z, n in log[-1]["looked"].items() if z <= log[-1]["kept"]) > 0


@pytest.mark.parametrize("clusters", [5, 40])
def test_odd_rows(spark, clusters):
    rng = random.Random(5)
    vec = lambda: [rng.choice([-0.5, 0.25, 0.26, 1.0]) for _ in range(64)]
    rows = [(k, vec(), 1, "x") for k in range(30)]
    rows += [rows[3]] * 9 + [(7, vec(), 1, "x"), (None, vec(), 1, "x"), (40, None, 1, "x"), (41, [1.0] * 63, 1, "x"), (42, [None] + [1.0] * 63, 1, "x"), (43, [float("nan")] + [1.0] * 63, 1, "x"), (44, [float("-inf")] * 64, 1, "x"), (45, [1e300] * 64, 1, "x"), (46, [-1e300] * 64, 1, "x"), (47, [0.0] * 64, 1, "x")]
    df = spark.createDataFrame(rows, "vec_id long, embedding array<double>, cluster int, v string").repartition(3)
    got = ordered(cluster_rows(df, clusters=clusters).collect())
    assert got == ordered(plain([r[:2] for r in rows], clusters))
    assert cluster_rows(df.limit(0)).collect() == []
    assert cluster_rows(df.where("vec_id is null")).collect() == []
    one = df.where("vec_id = 47")
    assert ordered(cluster_rows(one).collect()) == ordered(plain([(47, [0.0] * 64)]))
