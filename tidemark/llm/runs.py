"""Periodic runs of words: maximal repetitions by the runs theorem."""

from __future__ import annotations

import zlib

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tidemark.session import ship

#: Words of the shortest run.
SHORTEST = 12
#: Consecutive words that must occur again in their text for a run to hold them.
GRAM = SHORTEST // 2
#: Words that are searched at a time, unless one text has more.
AT_ONCE = 1 << 18


def suffix_ranks(s: np.ndarray) -> np.ndarray:
    """The inverse suffix array of ``s``, whose last value occurs once, by doubling; only suffixes that are not told apart yet are sorted again."""
    n = len(s)
    _, rank = np.unique(s, return_inverse=True)
    order = np.argsort(rank, kind="stable")
    # A suffix' rank is the place at which its group of equal prefixes begins.
    first = np.r_[True, rank[order][1:] != rank[order][:-1]]
    rank = np.empty(n, np.int64)
    rank[order] = np.maximum.accumulate(np.where(first, np.arange(n), 0))
    length = 1
    while True:
        alone = first & np.r_[first[1:], True]
        places = np.flatnonzero(~alone)
        if not len(places):
            return rank
        open_ = order[places]
        # Equal prefixes of this length end before the last value, so there is a suffix behind each.
        key = rank[open_] * n + rank[open_ + length]
        by = np.argsort(key, kind="stable")
        open_, key = open_[by], key[by]
        order[places] = open_
        first[places] = np.r_[True, key[1:] != key[:-1]]
        rank[open_] = np.maximum.accumulate(np.where(first[places], places, 0))
        length *= 2


def neighbour_prefixes(s: np.ndarray, rank: np.ndarray) -> np.ndarray:
    """For each place in the suffix array the length of the prefix shared with the suffix before it."""
    n = len(s)
    order = np.empty(n, np.int64)
    order[rank] = np.arange(n)
    before = np.full(n, -1, np.int64)
    before[order[1:]] = order[:-1]
    text, prior = s.tolist(), before.tolist()
    out, h = [0] * n, 0
    for i in range(n):  # the prefix of the next suffix is shorter by one at most
        j = prior[i]
        if j < 0:
            h = 0
            continue
        while text[i + h] == text[j + h]:  # the last value occurs once, so one of them differs before the end
            h += 1
        out[i] = h
        if h:
            h -= 1
    lcp = np.empty(n, np.int64)
    lcp[rank] = out
    return lcp


def common_prefixes(s: np.ndarray, rank: np.ndarray, a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """How many values the suffixes at ``a`` and ``b``, which differ, have in common.

    It is the least of the neighbours' prefixes between their ranks, by a
    sparse table. Its rows are made one after the other, and each answers the
    questions for its length, so that one row is held at a time.
    """
    ra, rb = rank[a], rank[b]
    low, high = np.minimum(ra, rb) + 1, np.maximum(ra, rb) + 1
    level = np.frexp((high - low).astype(np.float64))[1] - 1
    out = np.zeros(len(a), np.int64)
    row = neighbour_prefixes(s, rank)
    for k in range(int(level.max(initial=-1)) + 1):
        if k:
            half = 1 << (k - 1)
            row = np.minimum(row[:-half], row[half:])
        mine = np.flatnonzero(level == k)
        out[mine] = np.minimum(row[low[mine]], row[high[mine] - (1 << k)])
    return out


def next_smaller(values: np.ndarray) -> np.ndarray:
    """For each place the next one with a smaller value, or the length."""
    n = len(values)
    v, out, stack = values.tolist(), [n] * n, []
    for i, x in enumerate(v):
        while stack and v[stack[-1]] > x:
            out[stack.pop()] = i
        stack.append(i)
    return np.array(out, np.int64)


def runs_of(s: np.ndarray, shortest: int = SHORTEST) -> np.ndarray:
    """Rows (start, length, period) of all runs of ``shortest`` or more values of ``s``, sorted.

    Each run is found by a Lyndon root: in one of the two orders of values
    the longest Lyndon word at some place of the run is its period. That word
    ends at the next place whose suffix is smaller. It is extended to both
    sides while values one period apart are equal, and is a run if two
    periods fit. No root is a power, so the period is the smallest.
    """
    if len(s) < 2:
        return np.empty((0, 3), np.int64)
    s = np.r_[s, s.max() + 1]  # occurs once
    rank = suffix_ranks(s)
    n = len(s)
    begins, ends = [], []
    for values in (rank, n - 1 - rank):  # the reversed order reverses the ranks
        end = next_smaller(values)
        place = np.flatnonzero(end < n)
        begins.append(place)
        ends.append(end[place])
    pair = np.unique(np.c_[np.concatenate(begins), np.concatenate(ends)], axis=0)
    i, j = pair[:, 0], pair[:, 1]
    right = common_prefixes(s, rank, i, j)
    r = np.r_[s[:-1][::-1], s[-1]]
    back = suffix_ranks(r)
    # Values before i and j, read backwards; before the first there is none.
    left = np.zeros(len(i), np.int64)
    inner = np.flatnonzero(i > 0)
    left[inner] = common_prefixes(r, back, n - 1 - i[inner], n - 1 - j[inner])
    start, length, period = i - left, j + right - i + left, j - i
    fit = length >= np.maximum(shortest, 2 * period)
    return np.unique(np.c_[start[fit], length[fit], period[fit]], axis=0)


def _stretches(codes: np.ndarray, owner: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Starts and ends of the stretches of texts that may hold runs.

    Every word of a run stands in ``GRAM`` consecutive words that occur again
    in the same text, one period on or back. Sequences are told by a hash:
    where two share it by chance a stretch is longer than it need be.
    """
    n = len(codes)
    if n < SHORTEST:
        return np.empty(0, np.int64), np.empty(0, np.int64)
    m = n - GRAM + 1
    mixed = (codes.astype(np.uint64) + np.uint64(1)) * np.uint64(0x9E3779B97F4A7C15)
    key = owner[:m].astype(np.uint64) * np.uint64(0xD6E8FEB86659FD93)
    for k in range(GRAM):
        key = (key ^ mixed[k : k + m]) * np.uint64(0xFF51AFD7ED558CCD)
        key ^= key >> np.uint64(29)
    whole = owner[:m] == owner[GRAM - 1 :]
    held = np.flatnonzero(whole)
    if not len(held):
        return held, held
    order = held[np.argsort(key[held], kind="stable")]
    same = key[order][1:] == key[order][:-1]
    again = np.zeros(m, bool)
    again[order[np.r_[same, False] | np.r_[False, same]]] = True
    edge = np.zeros(n + 1, np.int64)
    at = np.flatnonzero(again)
    np.add.at(edge, at, 1)
    np.add.at(edge, at + GRAM, -1)
    covered = np.cumsum(edge[:-1]) > 0
    # A stretch ends where a text does.
    begin = covered & np.r_[True, ~covered[:-1] | (owner[1:] != owner[:-1])]
    end = covered & np.r_[~covered[1:] | (owner[1:] != owner[:-1]), True]
    starts, ends = np.flatnonzero(begin), np.flatnonzero(end) + 1
    long_ = ends - starts >= SHORTEST
    return starts[long_], ends[long_]


def runs_of_texts(texts: list[list], shortest: int = SHORTEST) -> list[list[tuple[int, int, int]]]:
    """For each list of words its runs (start, length, period), sorted; all texts are searched as one sequence, with a value of its own behind each stretch."""
    if shortest < SHORTEST:
        raise ValueError(f"runs have {SHORTEST} words at least")
    out: list[list[tuple[int, int, int]]] = [[] for _ in texts]
    sizes = np.array([len(t) for t in texts], np.int64)
    code: dict = {}
    codes = np.fromiter((code.setdefault(w, len(code)) for t in texts for w in t), np.int64, int(sizes.sum()))
    owner = np.repeat(np.arange(len(texts)), sizes)
    starts, ends = _stretches(codes, owner)
    if not len(starts):
        return out
    parts, bases, at = [], [], 0
    for k, (a, b) in enumerate(zip(starts, ends, strict=True)):
        parts += [codes[a:b], [len(code) + k]]
        bases.append(at)
        at += b - a + 1
    found = runs_of(np.concatenate(parts), shortest)
    own = np.searchsorted(bases, found[:, 0], side="right") - 1
    place = found[:, 0] - np.array(bases)[own] + starts[own]
    first = np.r_[0, np.cumsum(sizes)[:-1]]
    for text, start, length, period in zip(owner[place].tolist(), (place - first[owner[place]]).tolist(), found[:, 1].tolist(), found[:, 2].tolist(), strict=True):
        out[text].append((start, length, period))
    return out


def _kept(words: list[bytes], runs) -> bytes:
    gone = np.zeros(len(words) + 1, np.int64)
    for start, length, period in runs:
        gone[start + period] += 1
        gone[start + length] -= 1
    return b" ".join([w for w, g in zip(words, np.cumsum(gone[:-1]).tolist(), strict=True) if not g]) if runs else b" ".join(words)


def planted(doc_id: int | None, words: list[bytes]) -> list[bytes]:
    """``words`` with a periodic tail in a tenth of all texts, by their ids; one without an id stays."""
    h = 1 if doc_id is None else zlib.crc32(str(doc_id).encode())
    n, g = len(words), h // 10
    if h % 10 or not n:
        return words
    a = g % n
    p = 1 + (n - a) // (3 + g % 8)
    period, rest = words[a : a + p], n - a
    return words[:a] + (period * (rest // p + 1))[:rest]


def periodic_runs(df: DataFrame, id_col: str = "doc_id", text_col: str = "text", shortest: int = SHORTEST, prepare=None) -> DataFrame:
    """Per row its id, the ``runs`` of its text's words, and ``collapsed``, the text with one period left of each.

    Words are what stands between ASCII white space. A run is a longest
    stretch of ``shortest`` or more words (12 at least) in which words one
    period apart are equal, with room for two periods; runs are given as
    (start, length, period), sorted, words numbered from 0. ``collapsed`` are
    the words that no run holds behind its first period, joined by blanks.
    ``prepare``, if given, makes of a row's id and words those to search.

    One narrow pass on Arrow batches, without a shuffle. Short texts are
    searched together; what a task holds is in proportion to its batch, or to
    the longest text.

    A null or empty text has no words and no runs, and an empty
    ``collapsed``; a null id stays null; repeated rows each give a row. An
    empty table gives no rows. Other columns are not read.
    """
    ship(df.sparkSession)
    kind = pa.list_(pa.struct([("start", pa.int64()), ("length", pa.int64()), ("period", pa.int64())]))

    def found(ids, texts):
        runs = runs_of_texts(texts, shortest)
        rows = [[dict(zip(("start", "length", "period"), r, strict=True)) for r in own] for own in runs]
        kept = [_kept(words, own) for words, own in zip(texts, runs, strict=True)]
        return pa.RecordBatch.from_arrays([ids, pa.array(rows, kind), pa.array(kept, pa.binary())], ["id", "runs", "collapsed"])

    def search(batches):
        for batch in batches:
            ids, texts, held, begun = batch.column(0), [], 0, 0
            for k, (own, text) in enumerate(zip(ids.to_pylist(), batch.column(1), strict=True)):
                words = (text.as_py() or b"").split()
                texts.append(prepare(own, words) if prepare else words)
                held += len(words)
                if held >= AT_ONCE:
                    yield found(ids.slice(begun, len(texts)), texts)
                    texts, held, begun = [], 0, k + 1
            if texts:
                yield found(ids.slice(begun, len(texts)), texts)

    rows = df.select(F.col(f"`{id_col}`").alias("id"), F.col(f"`{text_col}`").cast("string").cast("binary").alias("text"))
    id_type = rows.schema["id"].dataType.simpleString()
    out = rows.mapInArrow(search, f"id {id_type}, runs array<struct<start: bigint, length: bigint, period: bigint>>, collapsed binary")
    return out.select(F.col("id").alias(id_col), "runs", F.col("collapsed").cast("string").alias("collapsed"))


def run_digests(df: DataFrame, id_col: str = "doc_id", text_col: str = "text", prepare=planted) -> DataFrame:
    """Per row the number of runs, the longest one (then that which starts first, then that of the smallest period), and digests of all runs and of the collapsed text.

    Without runs the longest one's columns are null. ``df`` as for :func:`periodic_runs`.
    """
    rows = periodic_runs(df, id_col, text_col, prepare=prepare)
    first = F.array_min(F.transform("runs", lambda r: F.struct((-r["length"]).alias("l"), r["start"].alias("s"), r["period"].alias("p"))))
    by_period = F.array_sort(F.transform("runs", lambda r: F.struct(r["start"].alias("s"), r["period"].alias("p"), r["length"].alias("l"))))
    listed = F.array_join(F.transform(by_period, lambda r: F.concat_ws(",", r["s"], r["l"], r["p"])), "\n")
    listed = F.when(F.size("runs") > 0, F.concat(listed, F.lit("\n"))).otherwise("")
    rows = rows.select(id_col, "runs", "collapsed", first.alias("longest"), listed.alias("listed"))
    return rows.select(
        id_col,
        F.size("runs").cast("long").alias("n_runs"),
        F.col("longest.s").alias("start"),
        (-F.col("longest.l")).alias("length"),
        F.col("longest.p").alias("period"),
        F.expr("-longest.l * 1000 div longest.p").alias("exponent_milli"),
        F.sha2("listed", 256).alias("runs_sha256"),
        F.sha2("collapsed", 256).alias("collapsed_sha256"),
    )
