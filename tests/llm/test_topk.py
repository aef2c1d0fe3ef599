import math
import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from tidemark.llm import topk
from tidemark.llm.frames import read
from tidemark.llm.topk import search_shard, top_k


def plain(rows, every, k=10):
    ok = [(i, [math.floor(1024 * float(x)) for x in v]) for i, v in rows if i is not None and v is not None and all(x is not None and math.isfinite(x) for x in v)]
    out = set()
    for i, q in ok:
        if i % every == 0:
            scored = sorted((-sum(a * b for a, b in zip(q, v)), j) for j, v in ok if j != i)[:k]
            out |= {(i, n + 1, j, -s) for n, (s, j) in enumerate(scored)}
    return out


def test_shard_equals_scan():
    rng = np.random.default_rng(2)
    for trial in range(20):
        n, d = rng.integers(1, 400), 6
        v = rng.integers(-9, 9, (n, d)) * rng.integers(0, 2, (n, 1))
        ids = rng.permutation(1000)[:n]
        got = search_shard(ids[:5], v[:5], ids, v, 4, block=16)
        for q in range(min(5, n)):
            scores = v @ v[q]
            want = sorted((-scores[j], ids[j]) for j in range(n) if ids[j] != ids[q])[:4]
            assert [(-s, i) for s, i in zip(*got[q], strict=True)] == want


@pytest.mark.parametrize("shard,block", [(8192, 2048), (50, 2)])
def test_whole_table(spark, sf, monkeypatch, shard, block):
    monkeypatch.setattr(topk, "SHARD", shard)
    monkeypatch.setattr(topk, "QUERY_BLOCK", block)
    df = read(spark, sf, "embeddings")
    got = [tuple(r) for r in top_k(df, F.col("vec_id") % 100 == 0).collect()]
    assert len(got) == len(set(got)) and set(got) == plain([(r.vec_id, r.embedding) for r in df.collect()], 100)


def test_edges(spark):
    rng = random.Random(4)
    rows = [(k, [rng.choice([-1.0, 0.5, 0.25]) for _ in range(4)], 0) for k in range(30)]
    rows += [(100, None, 0), (101, [1.0, None, 1.0, 1.0], 0), (102, [float("nan")] * 4, 0), (103, [float("inf")] * 4, 0), (None, [9.0] * 4, 0), (110, [], 0), (111, [1.0], 0)]
    df = spark.createDataFrame(rows, "vec_id long, embedding array<float>, score int")
    got = {tuple(r) for r in top_k(df, F.col("vec_id") % 10 == 0).collect()}
    padded = [(i, v if v is None or not v and i is None else list(v) + [0.0] * (4 - len(v))) for i, v, _ in rows]
    assert got == plain(padded, 10)
    assert top_k(df.limit(0), F.col("vec_id") % 10 == 0).count() == 0
    assert top_k(df.limit(2), F.col("vec_id") % 10 == 0).count() == 1


def test_blocks_are_skipped_where_terms_are_skewed(monkeypatch):
    """Rows whose terms lie in few places of the range, as in ordered sparse data: most blocks are never scored."""
    rng = np.random.default_rng(3)
    vectors = np.zeros((4096, 64), np.int64)
    for k in range(4096):
        vectors[k, k // 64 : k // 64 + 1] = rng.integers(100, 1000)
    seen = []
    products = topk._products
    monkeypatch.setattr(topk, "_products", lambda a, b: seen.append(len(a) * len(b)) or products(a, b))
    ids, asked = np.arange(4096), np.arange(0, 4096, 100)
    best = topk.search_shard(asked, vectors[asked], ids, vectors, 10, block=64)
    scores = vectors[asked] @ vectors.T
    for q, (s, i) in zip(asked, best, strict=True):
        row = scores[q // 100].copy()
        others = np.delete(ids, q)
        want = others[np.lexsort((others, -row[others]))[:10]]
        assert i.tolist() == want.tolist() and s.tolist() == row[want].tolist()
    assert sum(seen) < 0.2 * len(asked) * 4096
