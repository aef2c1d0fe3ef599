"""Asking metric services for current values: bounded concurrent requests, and a stream of the samples that fall due."""

from __future__ import annotations

import json
import time
import urllib.parse
import urllib.request
from collections.abc import Iterable, Iterator
from concurrent.futures import ThreadPoolExecutor
from datetime import datetime, timezone

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.datasource import DataSource, DataSourceStreamReader, InputPartition

from tidemark.functions.text import fnv1a
from tidemark.schema import SERIES
from tidemark.session import ship
from tidemark.sources.payloads import instant_values

#: Requests under way at a time in one task, and tries of one.
CONCURRENT, TRIES = 8, 3


def fetch(address: str, query: str, at: int, timeout_s: float = 10.0, tries: int = 1, backoff_s: float = 0.5) -> str:
    """The body of a source's answer; where it can't be reached, one that says so. Pauses double from try to try."""
    url = f"{address.rstrip('/')}/api/v1/query?{urllib.parse.urlencode({'query': query, 'time': at})}"
    for attempt in range(max(1, tries)):
        if attempt:
            time.sleep(backoff_s * 2 ** (attempt - 1))
        try:
            with urllib.request.urlopen(url, timeout=timeout_s) as answer:
                return answer.read().decode("utf-8", "replace")
        except (OSError, ValueError) as e:
            fault = str(e)
    return json.dumps({"status": "error", "errorType": "unreachable", "error": fault})


def fetch_all(asked: Iterable[tuple[str, str, int]], concurrent: int = CONCURRENT, **more) -> Iterator[str]:
    """The bodies of (address, query, time) requests in their order, no more than ``concurrent`` under way at a time."""
    with ThreadPoolExecutor(max_workers=max(1, concurrent)) as pool:
        yield from pool.map(lambda a: fetch(*a, **more), asked)


def due_seconds(workload_id: str, interval_s: int, since: int, until: int, window_s: int = 15) -> range:
    """The seconds of (since, until] at which a series is due: its interval's start and a repeatable delay, as in ``sampling.due``."""
    window = min(interval_s, window_s) if window_s > 0 else interval_s
    delay = fnv1a(workload_id) % window
    first = since + 1 + (delay - since - 1) % interval_s
    return range(first, until + 1, interval_s)


class _Shard(InputPartition):
    """Some contracts, each with the seconds at which to ask."""

    def __init__(self, asked: list):
        self.asked = asked


class _DueReader(DataSourceStreamReader):
    def __init__(self, options: dict):
        self.options = options
        self.contracts = json.loads(options["contracts"])

    def initialOffset(self) -> dict:
        return {"second": int(self.options.get("since", str(int(time.time()))))}

    def latestOffset(self) -> dict:
        return {"second": int(self.options.get("until", str(int(time.time()))))}

    def partitions(self, start: dict, end: dict) -> list[InputPartition]:
        shards: list[list] = [[] for _ in range(int(self.options.get("shards", "8")))]
        for c in self.contracts:
            seconds = due_seconds(c["workload_id"], int(c["interval_s"]), start["second"], end["second"], int(self.options.get("jitter", "15")))
            if len(seconds):
                shards[fnv1a(c["workload_id"]) % len(shards)].append((c, list(seconds)))
        return [_Shard(s) for s in shards if s]

    def read(self, partition: _Shard):
        asked = [(c, at) for c, seconds in partition.asked for at in seconds]
        o = self.options
        more = {"timeout_s": float(o.get("timeout", "10")), "tries": int(o.get("tries", str(TRIES))), "backoff_s": float(o.get("backoff", "0.5"))}
        bodies = fetch_all([(c["server_address"], c["query"], at) for c, at in asked], int(o.get("concurrent", str(CONCURRENT))), **more)
        for (c, at), body in zip(asked, bodies, strict=True):
            yield (c.get("cluster_id"), c["workload_id"], c["source_fingerprint"], datetime.fromtimestamp(at, timezone.utc), body)

    def commit(self, end: dict) -> None:
        pass


class DueSamples(DataSource):
    """``spark.readStream.format("due_samples")``: each contract is asked at every second at which it is due.

    Offsets are seconds, so a query that starts again from its checkpoint
    asks for what came due meanwhile, and for nothing twice, unless a batch
    failed and is run again. Partitions are shards of contracts. ``contracts``
    is a JSON array of their addresses, queries, keys and intervals; other
    options: since, until, shards, concurrent, tries, backoff, timeout,
    jitter.
    """

    @classmethod
    def name(cls) -> str:
        return "due_samples"

    def schema(self) -> str:
        return "cluster_id string, workload_id string, source_fingerprint string, observed_at timestamp, body string"

    def streamReader(self, schema) -> DataSourceStreamReader:
        return _DueReader(dict(self.options))


FIELDS = ["cluster_id", *SERIES, "server_address", "query", "interval_s"]


def options_of(settings: dict) -> dict:
    """Options of the source from the sampling process' settings (``config.SAMPLING``); a jitter below a second counts as one."""
    return {"concurrent": settings["max_concurrent"], "tries": settings["max_retries"] + 1, "backoff": settings["initial_backoff"], "timeout": settings["query_timeout"], "jitter": max(1, int(settings["jitter_window"]))}


def due_stream(spark: SparkSession, contracts: DataFrame, **options) -> DataFrame:
    """(cluster_id, series, observed_at, observed_value, fault) of the active contracts as they fall due: a value, or why there is none.

    The contracts' few fields pass the driver, as the source's partitions are
    planned there: some hundred bytes a contract. A changed set of contracts
    takes a restart.
    """
    ship(spark)
    spark.dataSource.register(DueSamples)
    rows = contracts.where("status = 'active' and interval_s >= 1").select(*FIELDS).collect()
    reader = spark.readStream.format("due_samples").option("contracts", json.dumps([r.asDict() for r in rows]))
    for name, value in options.items():
        reader = reader.option(name, str(value))
    return instant_values(reader.load()).select("cluster_id", *SERIES, "observed_at", F.col("value").alias("observed_value"), "fault")
