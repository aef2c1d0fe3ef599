"""Surges in state against the batch operator, whatever the batches."""

import random

import pytest
from pyspark.sql import Window
from pyspark.sql import functions as F

from tests.helpers import series
from tidemark.operators.quality import real_suffix
from tidemark.operators.surge import SurgePolicy, surges
from tidemark.schema import SAMPLES, SERIES
from tidemark.streaming import surge_state
from tidemark.streaming.surge_state import SortedBlocks


def test_sorted_blocks_equal_a_list(monkeypatch):
    monkeypatch.setattr(surge_state, "BLOCK", 4)
    rng, store, plain = random.Random(1), {}, []
    blocks = SortedBlocks([], [], [], lambda b: list(store[b]), store.__setitem__, store.pop)
    for _ in range(3000):
        if plain and rng.random() < (0.3 if len(plain) < 200 else 0.7):
            blocks.remove(plain.pop(rng.randrange(len(plain))))
        else:
            plain.append(float(rng.randrange(40)))
            blocks.add(plain[-1])
        if plain:
            k = rng.randint(1, len(plain))
            assert blocks.rank(k) == sorted(plain)[k - 1] and len(blocks) == len(plain)
    assert set(store) == set(blocks.ids) and max(blocks.sizes) <= 8


def points(seed):
    """Slots with several rows, gaps, and steep ends."""
    rng, out, k = random.Random(seed), [], 0.0
    for _ in range(150):
        k += rng.choice([1, 1, 1, 1, 1, 1, 0.3, 1.4]) if rng.random() > 0.02 else rng.choice([2, 5])
        out.append((round(k, 3), 10 + rng.random()))
    end = out[-1][0]
    return out + [(end + 1, 20.0), (end + 2, 32.0)] if seed % 2 else out


@pytest.mark.parametrize("splits,rows,k", [(1, 0, 2), (5, 0, 2), (23, 0, 1), (4, 30, 2)])
def test_state_equals_batch(spark, tmp_path, splits, rows, k):
    policy = SurgePolicy(confirmations=k)
    data = {f"s{s}": points(s) for s in range(4)}
    for part in range(splits):
        frames = [series(spark, p[len(p) * part // splits : len(p) * (part + 1) // splits], w) for w, p in data.items()]
        df = frames[0]
        for f in frames[1:]:
            df = df.unionByName(f)
        df.coalesce(1).write.mode("append").parquet(str(tmp_path / "in"))
    source = spark.readStream.schema(SAMPLES).option("maxFilesPerTrigger", 1).parquet(str(tmp_path / "in"))
    out = surge_state.surge_stream(source, 60, policy, rows)

    def keep(batch, number):
        batch.withColumn("batch", F.lit(number)).write.mode("append").parquet(str(tmp_path / "out"))

    out.writeStream.outputMode("update").foreachBatch(keep).option("checkpointLocation", str(tmp_path / "state")).trigger(availableNow=True).start().awaitTermination()
    got = {}
    for r in spark.read.parquet(str(tmp_path / "out")).orderBy("batch").collect():
        got[r.workload_id] = r
    df = series(spark, data["s0"], "s0")
    for w in ("s1", "s2", "s3"):
        df = df.unionByName(series(spark, data[w], w))
    suffix = real_suffix(df, 60)
    if rows:
        back = F.row_number().over(Window.partitionBy(*SERIES).orderBy(F.col("observed_at").desc()))
        suffix = suffix.withColumn("back", back).where(F.col("back") <= rows + k + 1).drop("back")
    leads = df.select(*SERIES).distinct().select(*SERIES, F.lit(2.0).alias("lead_minutes"))
    near = lambda x: None if x is None else round(x, 9)
    want = surges(suffix, 60, leads, policy).collect()
    assert len(want) == len(got) == 4 and any(r.triggered for r in want)
    for r in want:
        g = got[r.workload_id]
        assert [g.triggered, *map(near, (g.demand, g.value, g.slope, g.baseline, g.slope_p95))] == [r.triggered, *map(near, (r.demand, r.value, r.slope, r.baseline, r.slope_p95))]


class Held:
    """A value of state, in memory."""

    def __init__(self, value=None):
        self.value, self.timers = value, []

    def exists(self):
        return self.value is not None

    def get(self):
        return self.value

    def clear(self):
        self.value = None

    def registerTimer(self, at):
        self.timers.append(at)

    def getExpiryTimeInMs(self):
        return self.value


def test_idle_series_go():
    p = surge_state.SurgeState(60, SurgePolicy(), 0, 10)
    p.handle, p.head, p.sorted, p.fifo = Held(), Held((0, 5_000)), Held({}), Held({})
    assert sum(map(len, p.handleExpiredTimer(("w", "f"), None, Held(10_000)))) == 0
    assert p.handle.timers == [15_000] and p.head.exists()  # it had rows meanwhile
    list(p.handleExpiredTimer(("w", "f"), None, Held(15_000)))
    assert not p.head.exists() and not p.sorted.exists()
