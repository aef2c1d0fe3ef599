"""Surge detection in the state of each series, row by row, with the order statistic of its slopes."""

from __future__ import annotations

import math
from bisect import bisect_left, insort
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle

from tidemark.functions.time import GRID_ORIGIN_S
from tidemark.operators.surge import BASELINE_ROWS, LEAD_MINUTES, SurgePolicy
from tidemark.schema import SERIES
from tidemark.session import ship

#: Values of a block of the sorted slopes; one of twice as many is split.
BLOCK = 256
PROVIDER = "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"
OUT = "workload_id string, source_fingerprint string, observed_at timestamp, triggered boolean, demand double, value double, slope double, baseline double, slope_p95 double"
#: Rows of the run, the open slot, its first and last row's time, the latest values, the order of slopes that count, and when the state is to go.
HEAD = "n long, slot long, first_us long, last_us long, lead double, values array<double>, added long, removed long, highs array<double>, sizes array<long>, ids array<long>, seen_ms long"


class SortedBlocks:
    """Numbers in order, in blocks of a map: an insertion, a removal or a rank touches one or two blocks. ``read`` and ``write`` are the map's; the directory is kept by the caller."""

    def __init__(self, highs: list[float], sizes: list[int], ids: list[int], read, write, drop):
        self.highs, self.sizes, self.ids, self.read, self.write, self.drop = list(highs), list(sizes), list(ids), read, write, drop

    def __len__(self) -> int:
        return sum(self.sizes)

    def _put(self, at: int, block: list[float]) -> None:
        self.highs[at], self.sizes[at] = block[-1], len(block)
        self.write(self.ids[at], block)

    def add(self, value: float) -> None:
        if not self.ids:
            self.highs, self.sizes, self.ids = [value], [1], [0]
            self.write(0, [value])
            return
        at = min(bisect_left(self.highs, value), len(self.ids) - 1)
        block = self.read(self.ids[at])
        insort(block, value)
        if len(block) > 2 * BLOCK:
            new = max(self.ids) + 1
            for kept, values in ((self.highs, block[BLOCK]), (self.sizes, 0), (self.ids, new)):
                kept.insert(at + 1, values)
            self._put(at + 1, block[BLOCK:])
            block = block[:BLOCK]
        self._put(at, block)

    def remove(self, value: float) -> None:
        at = bisect_left(self.highs, value)
        block = self.read(self.ids[at])
        del block[bisect_left(block, value)]
        if block:
            self._put(at, block)
        else:
            self.drop(self.ids[at])
            for kept in (self.highs, self.sizes, self.ids):
                del kept[at]

    def rank(self, k: int) -> float:
        """The k-th smallest, from 1."""
        for size, block in zip(self.sizes, self.ids, strict=True):
            if k <= size:
                return self.read(block)[k - 1]
            k -= size
        raise IndexError(k)


class SurgeState(StatefulProcessor):
    """State of a series: its latest run of real slots, as a few values, and the slopes before them.

    ``head`` has the numbers, ``sorted`` the slopes' blocks in order, ``fifo``
    the slopes as they came, of which the oldest goes when there are more than
    ``rows``. All are of the current run; a gap clears them. A timer clears a
    series that has been silent for ``idle_s``.
    """

    def __init__(self, interval_s: int, policy: SurgePolicy, rows: int, idle_s: int):
        self.interval_s, self.policy, self.rows, self.idle_ms = interval_s, policy, rows, idle_s * 1000

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.head = handle.getValueState("head", HEAD)
        self.sorted = handle.getMapState("sorted", "block long", "slopes array<double>")
        self.fifo = handle.getMapState("fifo", "block long", "slopes array<double>")

    def _get(self, held, block: int) -> list[float]:
        return list(held.getValue((block,))[0]) if held.containsKey((block,)) else []

    def _clear(self) -> None:
        self.head.clear()
        self.sorted.clear()
        self.fifo.clear()

    def _slope(self, new: float, old: float) -> float:
        return (new - old) / (self.interval_s / 60)

    def _settle(self, h: dict, blocks: SortedBlocks, slope: float) -> None:
        """A slope that is no longer among those that confirm counts for the quantile; the oldest beyond the window does no more."""
        blocks.add(slope)
        part = self._get(self.fifo, h["added"] // BLOCK)
        self.fifo.updateValue((h["added"] // BLOCK,), (part + [slope],))
        h["added"] += 1
        if self.rows and h["added"] - h["removed"] > self.rows:
            oldest = self._get(self.fifo, h["removed"] // BLOCK)
            blocks.remove(oldest[h["removed"] % BLOCK])
            h["removed"] += 1
            if h["removed"] % BLOCK == 0:
                self.fifo.removeKey((h["removed"] // BLOCK - 1,))

    def handleInputRows(self, key, rows: Iterator[pd.DataFrame], timerValues) -> Iterator[pd.DataFrame]:
        names = [c.split(" ")[0] for c in HEAD.split(", ")]
        known = self.head.get() if self.head.exists() else None
        h = dict(zip(names, known, strict=True)) if known else {"n": 0, "slot": 0, "first_us": 0, "last_us": -(1 << 62), "lead": LEAD_MINUTES, "values": [], "added": 0, "removed": 0, "highs": [], "sizes": [], "ids": [], "seen_ms": 0}
        h["values"] = list(h["values"])
        blocks = SortedBlocks(h["highs"], h["sizes"], h["ids"], lambda b: self._get(self.sorted, b), lambda b, v: self.sorted.updateValue((b,), (v,)), lambda b: self.sorted.removeKey((b,)))
        k, keep, step = self.policy.confirmations, BASELINE_ROWS + self.policy.confirmations + 1, self.interval_s * 1_000_000
        for at, value, lead in pd.concat(list(rows)).sort_values("at_us", kind="stable")[["at_us", "observed_value", "lead_minutes"]].itertuples(index=False):
            at, slot = int(at), (int(at) + GRID_ORIGIN_S * 1_000_000) // step
            if at < h["last_us"]:
                continue  # what comes late can't be put between slopes that count already
            h["lead"] = LEAD_MINUTES if pd.isna(lead) else float(lead)
            if h["n"] and slot == h["slot"]:
                h["values"][-1], h["last_us"] = float(value), at
                continue
            if h["n"] and at - h["last_us"] >= 1.5 * step:
                self.sorted.clear()
                self.fifo.clear()
                blocks.highs, blocks.sizes, blocks.ids = [], [], []
                h |= {"n": 0, "values": [], "added": 0, "removed": 0}
            h["values"].append(float(value))
            h |= {"n": h["n"] + 1, "slot": slot, "first_us": at, "last_us": at}
            # Of the slopes, one per row but the first, the last k confirm.
            if h["n"] >= k + 2:
                v = h["values"]
                self._settle(h, blocks, self._slope(v[-1 - k], v[-2 - k]))
            h["values"] = h["values"][-(keep + 1) :]
        now = timerValues.getCurrentProcessingTimeInMs() if self.idle_ms else 0
        if self.idle_ms and not h["seen_ms"]:
            self.handle.registerTimer(now + self.idle_ms)
        h |= {"seen_ms": now, "highs": blocks.highs, "sizes": blocks.sizes, "ids": blocks.ids}
        self.head.update(tuple(h[c] for c in names))
        if h["n"]:
            yield pd.DataFrame([[*key, pd.Timestamp(h["last_us"], unit="us"), *self._signals(h, blocks)]], columns=[c.split(" ")[0] for c in OUT.split(", ")])

    def _signals(self, h: dict, blocks: SortedBlocks):
        v, n, p, k = h["values"], h["n"], self.policy, self.policy.confirmations
        p95 = blocks.rank(min(max(math.ceil(0.95 * len(blocks)), 1), len(blocks))) if len(blocks) else None

        def row(back: int):
            """(value, slope, baseline) of the row so many before the last; None where there is none."""
            at = len(v) - 1 - back
            before = v[max(0, at - BASELINE_ROWS) : at]
            return v[at], self._slope(v[at], v[at - 1]) if at > 0 else None, sum(before) / len(before) if before else None

        def candidate(value, slope, baseline) -> bool:
            if slope is None or baseline is None or p95 is None:
                return False
            return slope > 0 and baseline > 0 and (p95 <= 0 or slope >= p95 * p.slope_multiplier) and value >= baseline * p.baseline_multiplier

        value, slope, baseline = row(0)
        confirmed = n >= k + BASELINE_ROWS and h["lead"] > 0 and all(candidate(*row(b)) for b in range(k))
        demand = min(value + max(0.0, slope) * h["lead"], value * p.most_multiplier) if confirmed else 0.0
        return confirmed, demand, value, slope, baseline, p95

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo) -> Iterator[pd.DataFrame]:
        seen = self.head.get()[-1] if self.head.exists() else None
        if seen is not None and seen + self.idle_ms > expiredTimerInfo.getExpiryTimeInMs():
            self.handle.registerTimer(seen + self.idle_ms)
        else:
            self._clear()
        yield pd.DataFrame(columns=[c.split(" ")[0] for c in OUT.split(", ")])

    def close(self) -> None:
        pass


def surge_stream(samples: DataFrame, interval_s: int, policy: SurgePolicy = SurgePolicy(), rows: int = 0, idle_s: int = 0) -> DataFrame:
    """After each batch, the signals of the series that had rows: batch twin ``surges`` of ``real_suffix``.

    ``samples`` (series, observed_at, observed_value, and lead_minutes where
    it is known) come in order of time, batch by batch; within a batch they
    are sorted, and a row that is older than the last one of its series is
    left out. ``rows`` bounds the slopes that the quantile is taken over, 0
    takes those of the whole run. A series' state is a few numbers and its
    slopes in blocks, of which a row touches two. With ``idle_s`` it goes so
    long after the last row, by a timer; a query with timers runs on and on,
    so that is for one with a processing-time trigger. State is kept by the
    RocksDB store, which this needs.
    """
    spark = samples.sparkSession
    ship(spark)
    spark.conf.set("spark.sql.streaming.stateStore.providerClass", PROVIDER)
    lead = F.col("lead_minutes") if "lead_minutes" in samples.columns else F.lit(None)
    own = samples.select(*SERIES, F.unix_micros("observed_at").alias("at_us"), "observed_value", lead.cast("double").alias("lead_minutes"))
    return own.groupBy(*SERIES).transformWithStateInPandas(SurgeState(interval_s, policy, rows, idle_s), OUT, "Update", "ProcessingTime" if idle_s else "None")
