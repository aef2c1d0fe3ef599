"""Byte-pair merging of many pre-tokens at a time on ragged numpy arrays.

All symbols of a batch lie in one flat array, with the number of the
pre-token each belongs to. One round finds every adjacent pair's rank, the
lowest rank within each pre-token, and replaces all its occurrences at once;
pre-tokens without a mergeable pair leave the arrays. The number of rounds is
that of the longest chain of merges, not that of the pre-tokens.

A merge only makes symbols whose own merges rank behind it, so applying all
occurrences of a pre-token's lowest pair together, from the left where they
overlap, gives what merging them one by one gives.
"""

from __future__ import annotations

from itertools import chain, islice

import numpy as np

NONE = np.iinfo(np.int32).max


class RankMerger:
    """Encodes byte strings by the merges of one vocabulary."""

    #: Bytes that one call of the array code holds at most, but for a single longer pre-token.
    BLOCK = 1 << 20
    #: Places of a hash table, as a power of two.
    PLACES = 19

    def __init__(self, byte_ids, merges):
        self.byte_ids = np.asarray(byte_ids, dtype=np.int64)
        table = np.asarray(merges, dtype=np.int64).reshape(-1, 3)
        self.made = table[:, 2]
        # Pairs lie in hash tables of their own; a pair whose place is taken goes to the next table.
        keys, ranks, self.tables = (table[:, 0] << 32 | table[:, 1]).astype(np.uint64), np.arange(len(table)), []
        while len(keys):
            factor = np.uint64(0x9E3779B97F4A7C15 + 2 * 0x632BE59BD9B4E019 * len(self.tables) & 0xFFFFFFFFFFFFFFFF)
            place = (keys * factor) >> np.uint64(64 - self.PLACES)
            _, first = np.unique(place, return_index=True)
            key_at, rank_at = np.full(1 << self.PLACES, np.uint64(0xFFFFFFFFFFFFFFFF)), np.full(1 << self.PLACES, NONE, np.int32)
            key_at[place[first]], rank_at[place[first]] = keys[first], ranks[first]
            self.tables.append((factor, key_at, rank_at))
            rest = np.ones(len(keys), bool)
            rest[first] = False
            keys, ranks = keys[rest], ranks[rest]

    def encode(self, words: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
        """All ids in a row (uint32), and the number of ids of each word."""
        ids, counts, begin = [], [], 0
        while begin < len(words):
            end, size = begin, 0
            while end < len(words) and (end == begin or size + len(words[end]) <= self.BLOCK):
                size += len(words[end])
                end += 1
            a, b = self._block(words[begin:end])
            ids.append(a)
            counts.append(b)
            begin = end
        if not ids:
            return np.empty(0, np.uint32), np.empty(0, np.int64)
        return np.concatenate(ids), np.concatenate(counts)

    def _ranks(self, symbols, owner):
        rank = np.full(len(symbols), NONE, np.int32)
        if len(symbols) > 1:
            key = (symbols[:-1] << 32 | symbols[1:]).view(np.uint64)
            for factor, key_at, rank_at in self.tables:
                place = ((key * factor) >> np.uint64(64 - self.PLACES)).view(np.int64)
                np.minimum(rank[:-1], np.where(key_at[place] == key, rank_at[place], NONE), out=rank[:-1])
            rank[:-1][owner[:-1] != owner[1:]] = NONE
        return rank

    def _block(self, words):
        lengths = np.fromiter(map(len, words), np.int64, len(words))
        symbols = self.byte_ids[np.frombuffer(b"".join(words), np.uint8)]
        owner = np.repeat(np.arange(len(words)), lengths)
        done_symbols, done_owner = [], []
        while len(symbols):
            rank = self._ranks(symbols, owner)
            starts = np.flatnonzero(np.r_[True, owner[1:] != owner[:-1]])
            sizes = np.diff(np.r_[starts, len(owner)])
            lowest = np.repeat(np.minimum.reduceat(rank, starts), sizes)
            over = lowest == NONE
            if over.any():
                done_symbols.append(symbols[over])
                done_owner.append(owner[over])
                stay = ~over
                symbols, owner, rank, lowest = symbols[stay], owner[stay], rank[stay], lowest[stay]
                if not len(symbols):
                    break
            chosen = rank == lowest
            # In a run of neighbouring choices every second one, from its left end, is merged.
            place = np.arange(len(symbols))
            first = chosen & ~np.r_[False, chosen[:-1]]
            since = place - np.maximum.accumulate(np.where(first, place, 0))
            merge = np.flatnonzero(chosen & (since % 2 == 0))
            symbols = symbols.copy()
            symbols[merge] = self.made[rank[merge]]
            keep = np.ones(len(symbols), bool)
            keep[merge + 1] = False
            symbols, owner = symbols[keep], owner[keep]
        if not done_symbols:
            return np.empty(0, np.uint32), lengths * 0
        symbols, owner = np.concatenate(done_symbols), np.concatenate(done_owner)
        order = np.argsort(owner, kind="stable")
        return symbols[order].astype(np.uint32), np.bincount(owner, minlength=len(words))


class _Numbers(dict):
    """Numbers words by their first occurrence."""

    def __missing__(self, word):
        n = self[word] = len(self)
        return n


class TextEncoder:
    """Encodes whole texts: special strings, pre-tokens by the byte-level pattern, merges.

    A pre-token is encoded where it first occurs and then known by a number;
    its ids lie in one flat array, from which texts' ids are gathered. After
    ``REMEMBERED`` pre-tokens that memory starts anew.
    """

    REMEMBERED = 1_000_000

    def __init__(self, spec: dict, pattern: str):
        import regex

        self.find = regex.compile(pattern).findall
        self.special = dict(spec["special"])
        longest_first = sorted(self.special, key=len, reverse=True)
        self.split = regex.compile("(" + "|".join(map(regex.escape, longest_first)) + ")").split if self.special else None
        self.merger = RankMerger(spec["byte_ids"], spec["merges"])
        self._forget()

    def _forget(self) -> None:
        self.number = _Numbers()
        self.ids, self.ends = np.empty(1 << 20, np.uint32), np.zeros(1 << 16, np.int64)
        self.known = 0

    def pieces(self, text: str) -> list[str]:
        """Pre-tokens; special strings stay whole where they occur."""
        if self.split is None or not any(s in text for s in self.special):
            return self.find(text)
        out: list[str] = []
        for part in self.split(text):
            out += [part] if part in self.special else self.find(part)
        return out

    def _learn(self) -> None:
        """Encodes the words that were numbered since the last call."""
        fresh = list(islice(self.number, self.known, None))
        if not fresh:
            return
        ids, counts = self.merger.encode([w.encode("utf-8", "surrogatepass") for w in fresh])
        if not self.special.keys().isdisjoint(fresh):
            parts = np.split(ids, np.cumsum(counts)[:-1])
            parts = [np.array([self.special[w]], np.uint32) if w in self.special else part for w, part in zip(fresh, parts, strict=True)]
            ids, counts = np.concatenate(parts), np.array([len(part) for part in parts])
        used = int(self.ends[self.known])
        if used + len(ids) > len(self.ids):
            self.ids = np.resize(self.ids, 2 * (used + len(ids)))
        if self.known + len(fresh) >= len(self.ends):
            self.ends = np.resize(self.ends, 2 * (self.known + len(fresh) + 1))
        self.ids[used : used + len(ids)] = ids
        self.ends[self.known + 1 : self.known + 1 + len(fresh)] = used + np.cumsum(counts)
        self.known += len(fresh)

    def runs(self, texts, chars: int):
        """Texts' words as numbers, for runs of about ``chars`` characters: the numbers, and where each text ends among them."""
        run: list[list[str]] = []
        size = 0
        for text in texts:
            run.append(self.pieces(text or ""))
            size += len(text or "")
            if size >= chars:
                yield self._numbered(run)
                run, size = [], 0
        if run:
            yield self._numbered(run)

    def _numbered(self, run):
        if self.known > self.REMEMBERED:
            self._forget()
        ends = np.cumsum(np.fromiter(map(len, run), np.int64, len(run)))
        numbers = np.fromiter(map(self.number.__getitem__, chain.from_iterable(run)), np.int64, ends[-1])
        self._learn()
        return numbers, ends

    def counts(self, texts, chars: int = 1 << 21):
        """Per text its number of ids."""
        for numbers, ends in self.runs(texts, chars):
            total = np.r_[0, np.cumsum(self.ends[numbers + 1] - self.ends[numbers])][np.r_[0, ends]]
            yield from np.diff(total).tolist()

    def id_arrays(self, texts, chars: int = 1 << 21):
        """Per text its ids (little-endian unsigned 32-bit)."""
        for numbers, ends in self.runs(texts, chars):
            begins = self.ends[numbers]
            sizes = self.ends[numbers + 1] - begins
            after = np.cumsum(sizes)
            row = self.ids[np.repeat(begins - after + sizes, sizes) + np.arange(after[-1] if len(after) else 0)].astype("<u4", copy=False)
            bounds = np.r_[0, after][np.r_[0, ends]].tolist()
            for begin, end in zip(bounds, bounds[1:], strict=False):
                yield row[begin:end]


_ENCODERS: dict[tuple[str, str], TextEncoder] = {}


def encoder_of(spec: dict, pattern: str) -> TextEncoder:
    """One encoder for each vocabulary and Python worker."""
    key = (pattern, spec["digest"])
    if key not in _ENCODERS:
        _ENCODERS[key] = TextEncoder(spec, pattern)
    return _ENCODERS[key]
