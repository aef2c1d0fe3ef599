"""Sampling from services: who is due when, requests side by side, the stream, and a new series' window."""

import datetime as dt
import json
import threading
import time
from http.server import BaseHTTPRequestHandler, ThreadingHTTPServer
from urllib.parse import parse_qs, urlparse

import pytest
from pyspark.sql import functions as F

from tests.helpers import START, at, series
from tidemark.operators import sampling
from tidemark.sources import sampler
from tidemark.streaming import twins

BASE = int(START.timestamp())


class Server:
    """Answers the time it is asked for; counts requests, and those under way."""

    def __init__(self):
        self.asked, self.now, self.most, self.lock, self.fail = [], 0, 0, threading.Lock(), {}
        outer = self

        class Handler(BaseHTTPRequestHandler):
            def do_GET(self):
                q = {k: v[0] for k, v in parse_qs(urlparse(self.path).query).items()}
                with outer.lock:
                    outer.asked.append((q["query"], int(q["time"])))
                    outer.now += 1
                    outer.most = max(outer.most, outer.now)
                    left = outer.fail.get(q["query"], 0)
                    outer.fail[q["query"]] = left - 1
                time.sleep(0.05)
                with outer.lock:
                    outer.now -= 1
                if left > 0:
                    self.send_error(503)
                    return
                self.send_response(200)
                self.end_headers()
                self.wfile.write(json.dumps({"status": "success", "data": {"resultType": "scalar", "result": [0, str(int(q["time"]) - BASE)]}}).encode())

            def log_message(self, *args):
                pass

        self.http = ThreadingHTTPServer(("127.0.0.1", 0), Handler)
        threading.Thread(target=self.http.serve_forever, daemon=True).start()
        self.address = f"http://127.0.0.1:{self.http.server_port}"


@pytest.fixture
def server():
    s = Server()
    yield s
    s.http.shutdown()


def declared(spark, server, n=4, interval=60):
    rows = [(f"w{k}", "f", "main", server.address, f"q{k}", interval * (1 + k % 2), "active") for k in range(n)] + [("off", "f", "main", server.address, "off", interval, "inactive")]
    return spark.createDataFrame(rows, "workload_id string, source_fingerprint string, cluster_id string, server_address string, query string, interval_s long, status string")


def test_seconds_are_those_of_the_schedule(spark, server):
    rows = declared(spark, server)
    for second in range(BASE, BASE + 240, 7):
        due = {r.workload_id for r in sampling.due(rows, F.timestamp_seconds(F.lit(second))).collect()} if second < BASE + 30 else None
        mine = {f"w{k}" for k in range(4) if second in sampler.due_seconds(f"w{k}", 60 * (1 + k % 2), second - 1, second)}
        assert due is None or due == mine
    # Nothing falls between two ranges, nothing into both.
    whole = list(sampler.due_seconds("w1", 120, BASE, BASE + 999))
    parts = [s for a in range(BASE, BASE + 999, 37) for s in sampler.due_seconds("w1", 120, a, min(a + 37, BASE + 999))]
    assert parts == whole and len(whole) in (8, 9)


def test_stream_asks_no_slot_twice(spark, server, tmp_path):
    rows = declared(spark, server)
    drain = lambda until: twins.drained(sampler.due_stream(spark, rows, since=BASE, until=until, shards=2, backoff=0.01), str(tmp_path))
    server.fail["q1"] = 2  # the first two requests of one source
    got = drain(BASE + 300).collect()
    first = [a for a in server.asked if a[0] != "q1"]
    want = {(f"w{k}", s) for k in range(4) for s in sampler.due_seconds(f"w{k}", 60 * (1 + k % 2), BASE, BASE + 300)}
    utc = lambda t: int(t.replace(tzinfo=dt.timezone.utc).timestamp())
    assert {(r.workload_id, utc(r.observed_at)) for r in got} == want and len(got) == len(want)
    assert all(r.fault is None and r.observed_value == utc(r.observed_at) - BASE for r in got)
    assert len(first) == len(set(first)) and len([a for a in server.asked if a[0] == "q1"]) == 2 + len([w for w in want if w[0] == "w1"])
    # Started again from its checkpoint it asks for what came due meanwhile.
    server.asked.clear()
    again = drain(BASE + 600).collect()
    assert len(server.asked) == len(set(server.asked)) and all(s > BASE + 300 for _, s in server.asked)
    assert {(r.workload_id, utc(r.observed_at)) for r in again} == {(f"w{k}", s) for k in range(4) for s in sampler.due_seconds(f"w{k}", 60 * (1 + k % 2), BASE, BASE + 600)}


def test_requests_are_side_by_side_and_bounded(spark, server):
    rows = declared(spark, server, 24).where("status = 'active'").coalesce(1)
    samples, outcomes = sampling.sample_cycle(rows, F.lit(at(5)), sampling.ask_instants(F.lit(at(5)), concurrent=6), tries=1)
    assert {r.observed_value for r in samples.collect()} == {300.0} and {r.status for r in outcomes.collect()} == {"sampled"}
    assert 2 <= server.most <= 6
    gone = rows.limit(1).withColumn("server_address", F.lit("http://127.0.0.1:9"))
    _, outcomes = sampling.sample_cycle(gone, F.lit(at(5)), sampling.ask_instants(F.lit(at(5)), 1.0), tries=2, backoff_s=0.01)
    r = outcomes.first()
    assert (r.status, r.fault, r.tries) == ("failed", "not_successful", 2)


def test_bootstrap_reads_whole_windows_of_series_that_lack_them(spark):
    full, poor = series(spark, [5.0] * 60, "full"), series(spark, [(k, 1.0) for k in (3, 9)], "poor")
    rows = full.select("cluster_id", "workload_id", "source_fingerprint").distinct().unionByName(poor.select("cluster_id", "workload_id", "source_fingerprint").distinct())
    asked = []

    def ask(parts):
        got = parts.collect()
        asked.extend((r.workload_id, r.first_s - BASE, r.last_s - BASE) for r in got)
        out = [("main", r.workload_id, r.source_fingerprint, at((s - BASE) / 60), 2.0) for r in got for s in range(r.first_s, r.last_s + 1, 60)]
        return spark.createDataFrame(out, "cluster_id string, workload_id string, source_fingerprint string, observed_at timestamp, observed_value double")

    out = sampling.bootstrap(full.unionByName(poor), rows, F.lit(at(0)), F.lit(at(59)), 60, ask, 21)
    got = {w: sorted((r.observed_at, r.observed_value) for r in out.where(F.col("workload_id") == w).collect()) for w in ("full", "poor")}
    assert sorted(asked) == [("poor", 0, 1200), ("poor", 1200, 2400), ("poor", 2400, 3540)]
    assert len(got["full"]) == 60 and len(got["poor"]) == 60 and dict(got["poor"])[at(3)] == 1.0 and dict(got["poor"])[at(4)] == 2.0
