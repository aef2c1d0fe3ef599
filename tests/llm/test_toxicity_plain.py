"""Toxicity scores end to end against a plain computation on one machine: lexicon, features, trees, knots, scores."""

import math
import zlib
from collections import Counter, defaultdict
from fractions import Fraction

import numpy as np
import regex
import xxhash

from tidemark.llm.frames import read
from tidemark.llm.toxicity import INSULTS, SECOND_PERSON, STAND_INS, toxicity

SF, IDS = "/root/testdata/sf0.1", 2500


def beginnings(word):
    return {word} | {word[:k] + "-" for k in (4, 5, 6, 7, 8) if len(word) > k}


def lexica(rows):
    """Weights by entry from (text, y, fold): of all rows, then without each fold."""
    counts = defaultdict(Counter)
    for text, y, fold in rows:
        for entry in set().union(*map(beginnings, regex.findall(r"\p{L}+", text.lower()))):
            counts[entry][y, fold] += 1
    sizes = Counter((y, fold) for _, y, fold in rows)
    of = lambda c, y, folds: sum(c[y, f] for f in folds)
    odds = lambda c, folds: math.log((of(c, 1, folds) + 0.5) / (of(sizes, 1, folds) + 1)) - math.log((of(c, 0, folds) + 0.5) / (of(sizes, 0, folds) + 1))
    tried = {e: c for e, c in counts.items() if sum(c.values()) >= 3}
    base = of(sizes, 1, range(3)) / len(rows)
    found = []
    for e, c in tried.items():
        n, share = sum(c.values()), of(c, 1, range(3)) / sum(c.values())
        against = (1 - share) * math.log((1 - share) / (1 - base)) if share < 1 else 0
        surprise = n * ((share * math.log(share / base) if share else 0) + against)
        if odds(c, range(3)) > math.log(3) and surprise > math.log(len(tried) / 20):
            found.append(e)
    assert 10 < len(found) < 6000
    keep = lambda folds: {e: odds(tried[e], folds) for e in found if of(tried[e], 1, folds) >= 2 and odds(tried[e], folds) > math.log(3)}
    return [keep([0, 1, 2])] + [keep([f for f in range(3) if f != out]) for out in range(3)]


def features(text, lexicon):
    words = text.split()
    if not words:
        return [0.0] * 18
    n, size, raw = len(words), len(text), text.encode()
    heaviest = lambda w: max([lexicon.get(e, 0.0) for e in beginnings(w)])
    bare = [w.strip(".,;:!?\"'()[]{}*#%&$-_«»¿¡…") for w in words]
    low = [w.lower() for w in bare]
    weight = [heaviest(w) for w in low]
    insult, second = [w in INSULTS for w in low], [w in SECOND_PERSON for w in low]
    hit = [w > 0 or i for w, i in zip(weight, insult)]
    mixed = [any(map(str.isalpha, w)) and not w.isalpha() and "@" not in w[1:-1] and not set(w) & set("-'’./:") for w in bare]
    clear = ["".join(filter(str.isalpha, w.translate(STAND_INS))) for w in low]
    hidden = [m and (c in INSULTS or heaviest(c) > 0) for m, c in zip(mixed, clear)]
    stretched = [any(w[k] == w[k + 1] == w[k + 2] and w[k].isalpha() for k in range(len(w) - 2)) for w in low]
    you = [k for k, s in enumerate(second) if s]
    near = sum(any(abs(k - j) <= 6 for j in you) for k, h in enumerate(hit) if h)
    marks = sum(33 <= b <= 47 or 58 <= b <= 64 or 91 <= b <= 96 or 123 <= b <= 126 for b in raw)
    return [
        sum(hit) / n, np.array(weight).sum() / n, max(weight), math.log1p(sum(hit)), math.log1p(len({w for w, h in zip(words, hit) if h})), sum(insult) / n,
        near / n, sum(second) / n, sum(65 <= b <= 90 for b in raw) / size, sum(len(w) > 2 and w.isupper() for w in bare) / n, raw.count(b"!") / size, raw.count(b"?") / size, marks / size,
        sum(mixed) / n, sum(hidden) / n, sum(stretched) / n, math.log1p(n), sum(hit[:50]),
    ]


class Trees:
    """The trees by their definition: node by node, feature by feature. Sums are taken row by row, as rounding decides between splits that are equally good."""

    def __init__(self, x, y):
        self.edges, n = [], len(y)
        for column in x.T:
            values = np.unique(column)
            inner = values if len(values) <= 48 else np.unique(np.quantile(values, np.arange(49) / 48))
            self.edges.append((inner[1:] + inner[:-1]) / 2)
        binned, share = self.bins(x), (y.sum() + 0.5) / (n + 1)
        self.base, self.trees = math.log(share / (1 - share)), []
        margin = np.full(n, self.base)
        for _ in range(80):
            p = 1 / (1 + np.exp(-margin))
            g, h = p - y, np.maximum(p * (1 - p), 1e-9)
            tree = self.grow(binned, g, h, np.arange(n), 3)
            self.trees.append(tree)
            margin += self.walk(tree, binned)

    def bins(self, x):
        return np.array([[np.searchsorted(e, v) for e, v in zip(self.edges, row)] for row in x])

    def grow(self, binned, g, h, rows, depth):
        if not depth:
            total_g, total_h = (np.cumsum(v[rows])[-1] for v in (g, h))
            return -total_g / (total_h + 2) * 0.15
        best, chosen = 1e-6, None
        for k in range(binned.shape[1]):
            left_g, left_h = (np.cumsum(np.bincount(binned[rows, k], v[rows], 49)) for v in (g, h))
            all_g, all_h = left_g[-1], left_h[-1]
            for place in range(49):
                a, b = left_h[place], all_h - left_h[place]
                if a >= 1 and b >= 1:
                    own, other = left_g[place], all_g - left_g[place]
                    gain = own * own / (a + 2) + other * other / (b + 2) - all_g * all_g / (all_h + 2)
                    if gain > best:
                        best, chosen = gain, (k, place)
        if chosen is None:
            return self.grow(binned, g, h, rows, 0)
        right = binned[rows, chosen[0]] > chosen[1]
        return (*chosen, self.grow(binned, g, h, rows[~right], depth - 1), self.grow(binned, g, h, rows[right], depth - 1))

    def walk(self, tree, binned):
        if not isinstance(tree, tuple):
            return np.full(len(binned), tree)
        right = binned[:, tree[0]] > tree[1]
        return np.where(right, self.walk(tree[3], binned), self.walk(tree[2], binned))

    def margin(self, x):
        binned = self.bins(x)
        return self.base + sum(self.walk(t, binned) for t in self.trees)


def knots(margins, y):
    """The rising fit as slopes of the largest convex line under the running sums."""
    order = np.argsort(margins, kind="stable")
    at, y = margins[order], y[order].astype(int)
    sums, k, i, xs, levels = [0, *np.cumsum(y).tolist()], len(y), 0, [], []
    prior = (sums[-1] + 0.5) / (k + 1)
    while i < k:
        end = min(range(i, k), key=lambda j: (Fraction(sums[j + 1] - sums[i], j + 1 - i), -j))
        for x in dict.fromkeys([at[i], at[end]]):
            xs.append(x)
            levels.append((sums[end + 1] - sums[i] + prior) / (end + 2 - i))
        i = end + 1
    return np.array(xs), np.maximum.accumulate(levels)


def test_scores_are_those_of_a_plain_computation(spark):
    docs, labels = read(spark, SF, "documents").select("doc_id", "text").where(f"doc_id < {IDS}"), read(spark, SF, "labels")
    got = {r.doc_id: (r.held_out, r.score, r.predicted) for r in toxicity(docs, labels).collect()}
    texts = {r.doc_id: r.text for r in docs.collect()}
    marks = {r.doc_id: r.toxic for r in labels.select("doc_id", "toxic").collect() if r.toxic is not None}
    out = lambda d: zlib.crc32(str(d).encode()) % 5 == 0
    same = defaultdict(list)
    for d in sorted(texts):
        if d in marks and not out(d) and texts[d] is not None:
            same[texts[d]].append(d)
    taught = sorted((ids[0], text, int(sum(marks[d] for d in ids) * 2 >= len(ids))) for text, ids in same.items())

    def fold(text):
        h = xxhash.xxh64_intdigest(text.encode(), seed=42)
        return (h - (1 << 64) * (h >> 63)) % 3

    rows = [(text, y, fold(text)) for _, text, y in taught]
    words, folds, y = lexica(rows), np.array([f for *_, f in rows]), np.array([float(y) for _, y, _ in rows])
    assert len(rows) > 300 and 10 < y.sum() < len(rows) / 2
    x = np.array([features(text, words[1 + f]) for text, _, f in rows])
    margins = np.zeros(len(y))
    for f in range(3):
        margins[folds == f] = Trees(x[folds != f], y[folds != f]).margin(x[folds == f])
    ids, trees, (kx, ky) = sorted(texts), Trees(x, y), knots(margins, y)
    raw = trees.margin(np.array([features(texts[d] or "", words[0]) for d in ids]))
    want = np.clip(np.interp(raw, kx, ky) + 1e-6 * np.tanh(raw), 0, 1)
    assert np.allclose([got[d][1] for d in ids], want, atol=1e-6)
    assert all(got[d][0] == out(d) and got[d][2] == (got[d][1] >= 0.5) for d in ids)
