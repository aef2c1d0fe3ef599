import zlib

import numpy as np

from tidemark.llm.calibration import calibrated, isotonic
from tidemark.llm.frames import read
from tidemark.llm.quality import FourierMap, STATISTICS, _summed, quality_scores, statistics


def auc(pairs):
    pos, neg = [s for s, y in pairs if y], [s for s, y in pairs if not y]
    return sum((p > n) + 0.5 * (p == n) for p in pos for n in neg) / (len(pos) * len(neg))


def test_isotonic_pools_and_rises():
    rng = np.random.default_rng(1)
    x = rng.normal(size=500)
    y = (rng.random(500) < 1 / (1 + np.exp(-2 * x))).astype(float)
    fit = calibrated(np.sort(x), isotonic(x, y, np.ones(500)))
    assert (np.diff(fit) >= 0).all() and 0 < fit.min() < 0.2 and 0.8 < fit.max() < 1
    assert calibrated(np.zeros(1), isotonic(np.empty(0), np.empty(0), np.empty(0)))[0] == 0.5


def test_kernel_is_approximated():
    rng = np.random.default_rng(3)
    x = rng.normal(size=(30, 5))
    z = FourierMap(np.zeros(5), np.ones(5), 20000, 2.0, 1)(x)[:, :20000]
    want = np.exp(-((x[:, None] - x[None]) ** 2).sum(-1) / (2 * 4))
    assert np.abs(z @ z.T - want).max() < 0.05


def test_sums_are_whole(spark):
    rng = np.random.default_rng(4)
    x, y = rng.normal(size=(300, len(STATISTICS))), rng.random(300)
    expand = FourierMap(np.zeros(len(STATISTICS)), np.ones(len(STATISTICS)), 20, 2.0, 1)
    df = spark.createDataFrame([(list(map(float, a)), float(b)) for a, b in zip(x, y)], "x array<double>, y double").repartition(7)
    gram, moment = _summed(df, expand)
    z = expand(x)
    assert np.allclose(gram, z.T @ z) and np.allclose(moment, z.T @ y)


def test_statistics():
    assert not statistics(b"").any()
    s = dict(zip(STATISTICS, statistics(b"AA AA aa!! |\n\xc3\xa9 1"), strict=True))
    assert s["same_as_last"] == 1 / 6 and s["distinct_words"] == 5 / 6 and s["capital_words"] == 2 / 6 and abs(s["lone_marks"] - 1 / 6) < 1e-9
    assert abs(s["bars"] - 1 / 17) < 1e-9 and np.isfinite(list(s.values())).all()
    assert np.isfinite(statistics(b" \n ")).all()


def test_held_out_rows(spark):
    sf = "/root/testdata/sf0.01"
    docs, labels = read(spark, sf, "documents"), read(spark, sf, "labels")
    got = {r.doc_id: r for r in quality_scores(docs, labels).collect()}
    assert len(got) == docs.count()
    pairs = []
    for r in labels.collect():
        g = got[r.doc_id]
        assert g.held_out == (zlib.crc32(str(r.doc_id).encode()) % 3 == 1) and 0 <= g.score <= 1 and g.predicted == (g.score >= 0.5)
        if g.held_out:
            pairs.append((g.score, r.quality))
    assert auc(pairs) > 0.95


def test_edges(spark):
    docs = spark.createDataFrame([(1, None, 1), (None, "a b", 2), (2, "x", 3), (2, "x", 3)], "doc_id long, text string, quality int")
    none = spark.createDataFrame([], "doc_id long, quality int")
    got = quality_scores(docs, none).collect()
    assert len(got) == 4 and all(r.score == 0.5 for r in got)
    odd = spark.createDataFrame([(1, None), (None, 1), (2, 1), (2, 0), (99, 1)], "doc_id long, quality int")
    assert all(0 <= r.score <= 1 for r in quality_scores(docs, odd).collect())
    assert quality_scores(docs.limit(0), odd).count() == 0


def test_few_labels(spark):
    """Eight labels that tell good from bad are enough for an order, though not for a calibration."""
    good, bad = "The committee met on Tuesday and agreed on the budget for the coming year. ", "$$$ CLICK!!! >>> 123 ### "
    docs = spark.createDataFrame([(k, (good if k % 2 else bad) * (3 + k % 3)) for k in range(40)], "doc_id long, text string")
    labels = spark.createDataFrame([(k, k % 2) for k in range(12)], "doc_id long, quality int")
    rows = quality_scores(docs, labels).collect()
    low, high = max(r.score for r in rows if not r.doc_id % 2), min(r.score for r in rows if r.doc_id % 2)
    assert low < high and all(0 <= r.score <= 1 for r in rows)
