"""The sampling cycle: which series are due, asking for them with tries and pauses, and filling a new series' window."""

from __future__ import annotations

import time
from collections.abc import Callable, Iterator
from functools import reduce

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tidemark.functions.text import jitter_s
from tidemark.operators.quality import sufficient_history
from tidemark.operators.repair import query_chunks
from tidemark.operators.store import insert_missing
from tidemark.schema import SERIES
from tidemark.session import cut, ship
from tidemark.sources.payloads import instant_values
from tidemark.sources.sampler import CONCURRENT, fetch_all

Ask = Callable[[DataFrame], DataFrame]


def due(contracts: DataFrame, now: Column, window_s: int = 15) -> DataFrame:
    """The active contracts whose second of the interval this is: its start and a repeatable delay below the window, or below the interval if that is shorter."""
    ship(contracts.sparkSession)
    interval, second = F.col("interval_s"), F.unix_seconds(now)
    window = F.when(interval < window_s, interval).otherwise(window_s) if window_s > 0 else interval
    rows = contracts.where((F.col("status") == "active") & (interval >= 1)).withColumn("delay_s", jitter_s(F.col("workload_id"), window))
    return rows.where(F.pmod(second, interval) == F.col("delay_s"))


def sample_cycle(contracts: DataFrame, now: Column, ask: Ask, failed: DataFrame | None = None, tries: int = 3, backoff_s: float = 0.5) -> tuple[DataFrame, DataFrame]:
    """The samples of all contracts that answer, and an outcome for each: sampled, recovered (it is among ``failed``) or failed.

    ``ask`` gets the contracts that have no answer yet, with ``attempt`` from 0
    and the ``wait_s`` it should pause before it asks, which doubles from try
    to try; it returns (series, value, fault). Each try's answers are kept, so
    that no source is asked twice for one. One that never answers takes
    nothing from the others.
    """
    left, kept = contracts, []
    for attempt in range(max(tries, 1)):
        wait = backoff_s * 2 ** (attempt - 1) if attempt else 0.0
        asked = left.withColumns({"attempt": F.lit(attempt), "wait_s": F.lit(wait)})
        answers = cut(ask(asked).select(*SERIES, F.col("value").cast("double").alias("value"), "fault"))
        rows = asked.select(*SERIES, "cluster_id").join(answers, SERIES, "left").withColumn("fault", F.when(F.col("value").isNull(), F.coalesce("fault", F.lit("no_answer"))))
        last = attempt == max(tries, 1) - 1
        kept.append((rows if last else rows.where("fault is null")).withColumns({"tries": F.lit(attempt + 1), "waited_s": F.lit(backoff_s * (2**attempt - 1))}))
        left = left.join(rows.where("fault is null").select(*SERIES), SERIES, "left_anti")
    rows = reduce(DataFrame.unionByName, kept)
    was = (failed.select(*SERIES).distinct() if failed is not None else contracts.select(*SERIES).where("false")).withColumn("was_failed", F.lit(True))
    status = F.when(F.col("fault").isNotNull(), "failed").when(F.col("was_failed"), "recovered").otherwise("sampled")
    outcomes = rows.join(was, SERIES, "left").select(*SERIES, status.alias("status"), "fault", "tries", "waited_s", "value")
    samples = rows.where("fault is null").select("cluster_id", *SERIES, now.alias("observed_at"), F.col("value").alias("observed_value"))
    return samples, outcomes


def bootstrap(samples: DataFrame, contracts: DataFrame, start: Column, end: Column, interval_s: int, ask: Ask, points: int = 10_000) -> DataFrame:
    """``samples`` with the whole window of each series read that has too little of it: ``ask`` gets (series, first_s, last_s) chunks and returns (cluster_id, series, observed_at, observed_value). What is there stays."""
    lacking = sufficient_history(samples, contracts, start, end, interval_s).where(~F.col("sufficient")).select(*SERIES)
    windows = contracts.join(lacking, SERIES, "left_semi").withColumns({"start_s": F.unix_seconds(start), "end_s": F.unix_seconds(end), "interval_s": F.lit(interval_s).cast("long")})
    return insert_missing(samples, ask(query_chunks(windows, points)), interval_s)


def ask_instants(now: Column, timeout_s: float = 10.0, concurrent: int = CONCURRENT) -> Ask:
    """An ``ask`` that puts each contract's query to its server over HTTP, in Arrow batches on the executors; a source that can't be reached is a fault.

    A batch pauses once, as long as any of its rows is to wait, and then has
    ``concurrent`` requests under way.
    """

    def fetch(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            if len(pdf):
                time.sleep(float(pdf["wait_s"].max()))
            bodies = list(fetch_all(pdf[["server_address", "query", "at"]].itertuples(index=False, name=None), concurrent, timeout_s=timeout_s))
            yield pdf[SERIES].assign(body=bodies)

    def ask(rows: DataFrame) -> DataFrame:
        ship(rows.sparkSession)
        asked = rows.select(*SERIES, "server_address", "query", "wait_s", F.unix_seconds(now).alias("at"))
        return instant_values(asked.mapInPandas(fetch, "workload_id string, source_fingerprint string, body string")).select(*SERIES, "value", "fault")

    return ask
