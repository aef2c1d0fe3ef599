import hashlib
import random
import re
import zlib

import numpy as np
import pytest

from tidemark.llm import runs
from tidemark.llm.runs import common_prefixes, next_smaller, periodic_runs, run_digests, runs_of, runs_of_texts, suffix_ranks



def brute(words, shortest=12):
    """All runs by trying each period at each place; the smallest period of a stretch stands."""
    n, found = len(words), {}
    for q in range(1, n // 2 + 1):
        i = 0
        while i + q < n:
            j = i
            while j + q < n and words[j] == words[j + q]:
                j += 1
            if j - i >= q and j - i + q >= shortest:
                found.setdefault((i, j - i + q), q)
            i = j + 1
    return sorted((s, l, q) for (s, l), q in found.items())


def random_words(rng, n):
    """Sequences with squares, cubes and powers of powers among random words."""
    out = []
    while len(out) < n:
        part = [rng.choice("abc") for _ in range(rng.randint(1, 9))]
        part = part * rng.choice([1, 1, 2, 3])
        out += part * rng.choice([1, 2, 4]) if rng.random() < 0.5 else [rng.choice("abcdefgh") for _ in range(rng.randint(1, 15))]
    return out[:n]


def test_pieces():
    rng = random.Random(1)
    for _ in range(60):
        s = [rng.randint(0, 2) for _ in range(rng.randint(1, 40))] + [9]
        rank = suffix_ranks(np.array(s))
        assert sorted(range(len(s)), key=lambda k: s[k:]) == np.argsort(rank).tolist()
        pairs = [(a, b) for a in range(len(s)) for b in range(len(s)) if a != b]
        if pairs:
            a, b = map(np.array, zip(*pairs, strict=True))
            want = [next(k for k in range(99) if s[x + k : x + k + 1] != s[y + k : y + k + 1]) for x, y in pairs]
            assert common_prefixes(np.array(s), rank, a, b).tolist() == want
        assert next_smaller(rank).tolist() == [next((j for j in range(i, len(s)) if rank[j] < rank[i]), len(s)) for i in range(len(s))]


def test_runs_equal_brute_force():
    rng = random.Random(2)
    for _ in range(150):
        words = random_words(rng, rng.randint(0, 120))
        code = {w: k for k, w in enumerate(dict.fromkeys(words))}
        s = np.array([code[w] for w in words], np.int64)
        for shortest in (2, 12):
            assert [tuple(r) for r in runs_of(s, shortest).tolist()] == brute(words, shortest)


def test_texts_together_equal_texts_alone():
    rng = random.Random(3)
    texts = [random_words(rng, rng.choice([0, 3, 11, 12, 60, 300])) for _ in range(80)] + [["x"] * 500, ["x", "y"] * 6, ["x"] * 11, [str(k) for k in range(99)]]
    assert runs_of_texts(texts) == [brute(t) for t in texts]
    with pytest.raises(ValueError):
        runs_of_texts(texts, 5)


def test_long_text():
    words = [str(k * k % 1009) for k in range(50_000)] + ["a", "b", "c"] * 40_000
    (found,) = runs_of_texts([words])
    assert (50_000, 120_000, 3) in found and found[0][2] == 1009


def digests(doc_id, text):
    words = re.findall(r"[^\x20\x09-\x0D]+", text or "")
    n, h = len(words), zlib.crc32(str(doc_id).encode()) if doc_id is not None else 1
    g = h // 10
    if h % 10 == 0 and n > 0:
        a = g % n
        p = 1 + (n - a) // (3 + g % 8)
        words = [w if i < a else words[a + (i - a) % p] for i, w in enumerate(words)]
    found = brute(words)
    gone = {k for s, l, q in found for k in range(s + q, s + l)}
    first = min(((-l, s, q) for s, l, q in found), default=None)
    listed = "".join(f"{s},{l},{q}\n" for s, q, l in sorted((s, q, l) for s, l, q in found))
    sha = lambda x: hashlib.sha256(x.encode()).hexdigest()
    one = (first[1], -first[0], first[2], 1000 * -first[0] // first[2]) if first else (None,) * 4
    return (doc_id, len(found), *one, sha(listed), sha(" ".join(w for k, w in enumerate(words) if k not in gone)))


def test_whole_table_and_edges(spark, sf):
    from tidemark.llm.frames import read

    df = read(spark, sf, "documents")
    got = [tuple(r) for r in run_digests(df).collect()]
    want = [digests(r.doc_id, r.text) for r in df.collect()]
    assert sorted(got) == sorted(want) and sum(r[1] > 0 for r in got) > 5


def test_odd_rows(spark, monkeypatch):
    monkeypatch.setattr(runs, "AT_ONCE", 40)
    lines = ["la " * 20, "la " * 20, None, "", " \n\t", "é ü " * 9 + "\x1f x", "a b c d e f g a b c d e f g a b", "x" * 100_000, "w " * 3]
    rows = [(k, t, 1, "r") for k, t in enumerate(lines)] + [(None, "la " * 20, 1, "r"), (0, "la " * 20, 1, "r")]
    df = spark.createDataFrame(rows, "doc_id long, text string, runs int, collapsed string").coalesce(1)
    got = sorted(map(str, map(tuple, run_digests(df).collect())))
    assert got == sorted(str(digests(i, t)) for i, t, *_ in rows)
    assert run_digests(df.limit(0)).collect() == []
    spans = {r.doc_id: (r.runs, r.collapsed) for r in periodic_runs(df.where("doc_id = 6")).collect()}
    assert [tuple(r) for r in spans[6][0]] == [(0, 16, 7)] and spans[6][1] == "a b c d e f g"
