import random
import zlib

import numpy as np

from tidemark.llm.boosting import BoostedTrees
from tidemark.llm.frames import read
from tidemark.llm.toxicity import FEATURES, Lexicon, fit, toxicity, without_toxic


def auc(pairs):
    pos, neg = [s for s, y in pairs if y], [s for s, y in pairs if not y]
    return sum((p > n) + 0.5 * (p == n) for p in pos for n in neg) / (len(pos) * len(neg))


def test_trees_learn_an_interaction():
    rng = np.random.default_rng(0)
    x = rng.random((2000, 4))
    y = ((x[:, 0] > 0.5) ^ (x[:, 1] > 0.4)).astype(float)
    model = BoostedTrees().fit(x[:1500], y[:1500])
    assert ((model.margin(x[1500:]) > 0) == y[1500:]).mean() > 0.95


def test_features():
    look = Lexicon({"grump": 2.0, "blar-": 1.0})
    f = dict(zip(FEATURES, look.features("You GRUMP! blarney is 1d1ot soooo fine? blar"), strict=True))
    assert f["entry_density"] == 2 / 8 and f["heaviest"] == 2 and f["second_person"] == 1 / 8 and f["near_second_person"] == 2 / 8
    assert f["obfuscated_words"] == f["obfuscated_entries"] == f["stretched_words"] == f["capital_words"] == 1 / 8
    assert not look.features("").any() and not look.features(" \n").any()
    look.REMEMBERED = 1
    assert np.array_equal(look.features("a grump b"), look.features("a grump b"))


def test_held_out_rows(spark):
    sf = "/root/testdata/sf0.01"
    docs, labels = read(spark, sf, "documents"), read(spark, sf, "labels")
    got = {r.doc_id: r for r in toxicity(docs, labels).collect()}
    assert len(got) == docs.count()
    pairs = []
    for r in labels.collect():
        g = got[r.doc_id]
        assert g.held_out == (zlib.crc32(str(r.doc_id).encode()) % 5 == 0) and 0 <= g.score <= 1 and g.predicted == (g.score >= 0.5)
        if g.held_out:
            pairs.append((g.score, r.toxic))
    assert auc(pairs) > 0.9
    kept = without_toxic(docs, fit(docs, labels))
    assert kept.columns == docs.columns
    assert {r.doc_id for r in kept.collect()} == {k for k, g in got.items() if g.score < 0.5}


def test_edges(spark):
    docs = spark.createDataFrame([(1, None, 1), (None, "a b", 2), (2, "x", 3), (2, "x", 3)], "doc_id long, text string, toxic int")
    none = spark.createDataFrame([], "doc_id long, toxic int")
    assert [r.score for r in toxicity(docs, none).collect()] == [0.5] * 4
    odd = spark.createDataFrame([(1, None), (None, 1), (2, 1), (2, 0), (3, 0), (99, 1)], "doc_id long, toxic int")
    assert all(0 <= r.score <= 1 for r in toxicity(docs, odd).collect())
    assert toxicity(docs.limit(0), odd).count() == 0


def test_filter_on_more_labels(spark):
    """Of the labelled rows that were held out, nine in ten toxic ones go (some labels are noise), and all clean ones stay."""
    sf = "/root/testdata/sf0.1"
    docs, labels = read(spark, sf, "documents"), read(spark, sf, "labels")
    marks = {r.doc_id: r.toxic for r in labels.collect() if zlib.crc32(str(r.doc_id).encode()) % 5 == 0}
    kept = {r.doc_id for r in without_toxic(docs, fit(docs, labels)).select("doc_id").collect()}
    gone = set(marks) - kept
    assert sum(marks[k] for k in gone) >= 0.9 * sum(marks.values())
    assert sum(1 - marks[k] for k in gone) <= 0.002 * len(marks)


def test_equal_texts_with_different_labels(spark):
    """A text counts once, with its mean label, whatever the order of the rows."""
    rng = random.Random(2)
    words = ["".join(rng.choices("abcdefgh", k=5)) for _ in range(200)]
    rows, marks = [], []
    for k in range(300):
        toxic = k % 3 == 0
        rows.append((k, " ".join(rng.choices(words, k=20)) + (" you vilething" if toxic else "")))
        marks.append((k, int(toxic)))
    rows += [(300 + k, rows[0][1]) for k in range(9)]
    marks += [(300 + k, k % 2) for k in range(9)]
    schema = "doc_id long, text string", "doc_id long, toxic int"
    scores = []
    for seed in (1, 2):
        random.Random(seed).shuffle(rows)
        random.Random(seed).shuffle(marks)
        out = toxicity(spark.createDataFrame(rows, schema[0]).repartition(seed + 2), spark.createDataFrame(marks, schema[1]))
        scores.append({r.doc_id: r.score for r in out.collect()})
    assert scores[0] == scores[1]


def test_a_word_is_weighed_by_the_beginnings_that_are_listed():
    from tidemark.llm.toxicity import Lexicon, entries_of

    weights = {"idiots": 1.5, "idio-": 2.0, "stup-": 1.0, "stupid-": 3.0, "n": 0.5}
    looks = Lexicon(weights)
    assert [k for k, _ in looks.stems] == [4, 6]  # others are not looked up
    for word in ["", "n", "idio", "idiot", "idiots", "stup", "stupi", "stupid", "stupidly", "stupidest", "漢字漢字漢字"]:
        assert looks._weigh(word) == max(weights.get(e, 0.0) for e in entries_of(word))
    look = [False, False, False, False, False]
    assert [list(map(bool, looks._look(w)[2:])) for w in ("noooo", "no!!!", "²²²", "1d1ot", "YOU", "you")] == [
        [*look[:4], True], look, [*look[:4], False], [False, False, True, True, False], [True, True, False, False, False], [True, False, False, False, False],
    ]
