"""Learned forecasters of the horizon maximum: quantile-boosted trees and gated recurrent networks.

A series is one group, bounded by its training window, and series are fitted
side by side: trees one by one, networks of one shape in stacks. Artifacts are
JSON, so that no code is ever loaded with a model.
"""

from __future__ import annotations

import base64
import hashlib
import json
import math
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tidemark.operators.features import FEATURE_SCHEMA, WARM_UP
from tidemark.operators.gated import GatedNetwork, train_stack
from tidemark.schema import SERIES, apart
from tidemark.session import ship

#: Fixed values of the engines: rounds and rates by quantile; sizes of the networks.
TREES = {"p50": (80, 0.1), "upper": (120, 0.08)}
DEPTH = 4
NATIVE = {"length": 60, "hidden": 12, "epochs": 8, "batch": 16, "rate": 0.003, "clip": 5.0, "decay": 0.0, "examples": 512}
#: The native network as it is fitted at each cut of a walk-forward.
VALIDATION = NATIVE | {"epochs": 3}
CONFORMAL = {"length": 120, "hidden": 32, "epochs": 24, "batch": 128, "rate": 0.001, "clip": 1.0, "decay": 0.0001, "examples": 2048}


class QuantileTrees:
    """Trees on histogram bins; splits by the gradients of the quantile loss, leaves by the quantile of their residuals."""

    def __init__(self, q: float, rounds: int, rate: float, depth: int = DEPTH, bins: int = 64, least: int = 4):
        self.q, self.rounds, self.rate, self.depth, self.bins, self.least = q, rounds, rate, depth, bins, least

    def fit(self, x: np.ndarray, y: np.ndarray) -> QuantileTrees:
        n, width = x.shape
        self.edges = []
        for k in range(width):
            cuts = np.unique(np.quantile(x[:, k], np.linspace(0, 1, self.bins + 1)[1:-1]))
            self.edges.append(cuts)
        binned = np.stack([np.searchsorted(e, x[:, k], side="left") for k, e in enumerate(self.edges)], axis=1)
        flat = binned + np.arange(width) * self.bins
        self.base = float(np.quantile(y, self.q))
        now, self.grown = np.full(n, self.base), []
        for _ in range(self.rounds):
            push = np.where(y > now, self.q, self.q - 1)
            node, splits = np.zeros(n, np.int64), []
            for level in range(self.depth):
                count = 1 << level
                cell = (node[:, None] * width * self.bins + flat).reshape(-1)
                g = np.bincount(cell, np.repeat(push, width), count * width * self.bins).reshape(count, width, self.bins).cumsum(axis=2)
                c = np.bincount(cell, minlength=count * width * self.bins).reshape(count, width, self.bins).cumsum(axis=2)
                rest_g, rest_c = g[:, :, -1:] - g, c[:, :, -1:] - c
                gain = g**2 / (c + 1) + rest_g**2 / (rest_c + 1) - g[:, :, -1:] ** 2 / (c[:, :, -1:] + 1)
                gain[(c < self.least) | (rest_c < self.least)] = 0
                best = gain.reshape(count, -1).argmax(axis=1)
                good = gain.reshape(count, -1)[np.arange(count), best] > 1e-9
                feature, place = np.where(good, best // self.bins, -1), best % self.bins
                splits.append((feature, place))
                own = feature[node]
                node = 2 * node + ((own >= 0) & (binned[np.arange(n), np.maximum(own, 0)] > place[node]))
            order = np.lexsort((y - now, node))
            leaves = np.zeros(1 << self.depth)
            sizes = np.bincount(node, minlength=len(leaves))
            ends = sizes.cumsum()
            residual = (y - now)[order]
            for leaf in np.flatnonzero(sizes):
                at = max(0, math.ceil(self.q * sizes[leaf]) - 1)
                leaves[leaf] = residual[ends[leaf] - sizes[leaf] + at] * self.rate
            now += leaves[node]
            self.grown.append((splits, leaves))
        return self

    def predict(self, x: np.ndarray) -> np.ndarray:
        binned = np.stack([np.searchsorted(e, x[:, k], side="left") for k, e in enumerate(self.edges)], axis=1)
        out, rows = np.full(len(x), self.base), np.arange(len(x))
        for splits, leaves in self.grown:
            node = np.zeros(len(x), np.int64)
            for feature, place in splits:
                own = feature[node]
                node = 2 * node + ((own >= 0) & (binned[rows, np.maximum(own, 0)] > place[node]))
            out += leaves[node]
        return out

    def dump(self) -> dict:
        return {"q": self.q, "base": self.base, "edges": [e.tolist() for e in self.edges], "trees": [[[f.tolist(), p.tolist()] for f, p in s] + [v.tolist()] for s, v in self.grown]}

    @classmethod
    def load(cls, spec: dict) -> QuantileTrees:
        out = cls(spec["q"], len(spec["trees"]), 0.0)
        out.base, out.edges = float(spec["base"]), [np.array(e, float) for e in spec["edges"]]
        out.grown = [([(np.array(f), np.array(p)) for f, p in tree[:-1]], np.array(tree[-1], float)) for tree in spec["trees"]]
        if not all(np.isfinite(v).all() for _, v in out.grown):
            raise ValueError("leaf values must be finite")
        return out


def time_split(n: int, steps: int, shares=(0.8, 0.1)) -> tuple[slice, slice, slice]:
    """Training, calibration and holdout examples in time order, with a horizon left out between them so that no label reaches over."""
    a, b = int(n * shares[0]), int(n * (shares[0] + shares[1]))
    return slice(0, max(0, a - steps)), slice(a, max(a, b - steps)), slice(b, n)


def residual_quantile(residuals: np.ndarray, q: float) -> float:
    """Split-conformal offset: the ceil((n+1)q)-th residual, 0 at least."""
    if not len(residuals):
        return 0.0
    return max(0.0, float(np.sort(residuals)[min(len(residuals), math.ceil((len(residuals) + 1) * q)) - 1]))


def _horizon_maxima(values: np.ndarray, steps: int) -> np.ndarray:
    """Entry k: the largest of the ``steps`` values after place k."""
    return np.lib.stride_tricks.sliding_window_view(values[1:], steps).max(axis=1) if len(values) > steps else np.empty(0)


def evenly_spaced(n: int, most: int) -> np.ndarray:
    return np.arange(n) if n <= most else np.arange(most) * (n - 1) // max(1, most - 1)


def _calendar(times: pd.Series) -> np.ndarray:
    minute, day = times.dt.hour * 60 + times.dt.minute, (times.dt.dayofweek + 1) % 7
    turns = [minute / 1440, day / 7, (times.dt.day - 1) / times.dt.days_in_month, (times.dt.month - 1) / 12]
    waves = [f(2 * np.pi * t.to_numpy(float)) for t in turns for f in (np.sin, np.cos)]
    return np.stack([*waves, day.isin([0, 6]).to_numpy(float)], axis=1)


def _clock(pdf: pd.DataFrame) -> pd.Series:
    """The wall clock of the rows: ``clock`` where there is one, that of the business time zone."""
    return pdf["clock"] if "clock" in pdf else pdf["observed_at"]


#: Networks that are fitted together at most; numbers of their states at one step, which should stay in a core's cache; rows of the series that wait for a stack.
STACK, STATES, WAITING = 32, 1 << 12, 1 << 20


class _Task:
    """One network to fit: what a series shows of it, and where its result goes."""

    def __init__(self, values: np.ndarray, inputs: np.ndarray, steps: int, q: float, shape: dict, conformal: bool):
        length = shape["length"]
        n = len(values) - steps - length + 1
        self.q, self.length, self.usable = q, length, n >= 20 and bool(np.isfinite(values).all())
        if not self.usable:
            return
        self.parts = time_split(n, steps) if conformal else (slice(0, n), slice(0, 0), slice(0, 0))
        # The scale sees training inputs only, so later values can't leak into it.
        seen = values[: self.parts[0].stop + length - 1]
        low, scale = float(seen.min()), float(seen.max() - seen.min())
        self.low, self.scale = low, scale if scale >= 1e-9 else 1.0
        rows = np.hstack([((values - self.low) / self.scale)[:, None], inputs])
        self.windows = np.lib.stride_tricks.sliding_window_view(rows, length, axis=0)[:n].transpose(0, 2, 1)
        self.labels = (_horizon_maxima(values, steps)[length - 1 : length - 1 + n] - self.low) / self.scale
        self.pick, self.rows = evenly_spaced(self.parts[0].stop, shape["examples"]), len(rows)


def _fitted(tasks: list[_Task], shape: dict, reset_first: bool) -> list[dict]:
    """The artifacts of usable tasks with as many examples each, fitted together."""
    nets = [GatedNetwork(t.windows.shape[2], shape["hidden"], reset_first) for t in tasks]
    windows, picks = [_Picked(t.windows, t.pick) for t in tasks], [t.labels[t.pick] for t in tasks]
    train_stack(nets, windows, picks, [t.q for t in tasks], shape["epochs"], min(shape["batch"], max(1, len(picks[0]))), shape["rate"], shape["clip"], shape["decay"], clip_each=reset_first)
    for t, net in zip(tasks, nets, strict=True):
        spare = t.parts[1]
        if spare.stop > spare.start:
            # In parts, as the windows overlap and are copied.
            ends = [*range(spare.start, spare.stop, 256), spare.stop]
            over = [t.labels[i:j] - net.quantiles(t.windows[i:j])[:, 1] for i, j in zip(ends, ends[1:], strict=False)]
            net.offset = residual_quantile(np.concatenate(over), t.q)
    return [{"format": "gated-network", "length": t.length, "minimum": t.low, "scale": t.scale, "quantile": t.q, "network": net.dump()} for t, net in zip(tasks, nets, strict=True)]


class _Picked:
    """Some of a series' windows, copied as they are asked for."""

    def __init__(self, windows: np.ndarray, pick: np.ndarray):
        self.windows, self.pick = windows, pick

    def __getitem__(self, part: np.ndarray) -> np.ndarray:
        return self.windows[self.pick[part]]


class Stacks:
    """Collects networks to fit, with a tag each, and fits those with equally many examples together.

    What waits is bounded by ``STACK`` networks of a kind and ``WAITING`` rows
    in all, and a stack by ``STATES`` numbers a step, so that wide networks are
    fitted one by one, as their products are large enough alone.
    """

    def __init__(self, shape: dict, reset_first: bool, conformal: bool):
        self.shape, self.reset_first, self.conformal = shape, reset_first, conformal
        self.high = max(1, min(STACK, STATES // (shape["batch"] * shape["hidden"])))
        self.waiting: dict[int, list] = {}
        self.rows = 0

    def add(self, tag, values: np.ndarray, inputs: np.ndarray, steps: int, q: float) -> list[tuple]:
        """The (tag, artifact) pairs that are done with this one; a series that is too short gets none."""
        task = _Task(values, inputs, steps, q, self.shape, self.conformal)
        if not task.usable:
            return []
        same = self.waiting.setdefault(len(task.pick), [])
        same.append((tag, task))
        self.rows += task.rows
        if len(same) >= self.high:
            return self._fit(len(task.pick))
        return self.rest() if self.rows > WAITING else []

    def _fit(self, size: int) -> list[tuple]:
        tags, tasks = zip(*self.waiting.pop(size), strict=True)
        self.rows -= sum(t.rows for t in tasks)
        return list(zip(tags, _fitted(list(tasks), self.shape, self.reset_first), strict=True))

    def rest(self) -> list[tuple]:
        """The pairs of all that still waits."""
        return [pair for size in sorted(self.waiting) for pair in self._fit(size)]


def train_sequence(pdf: pd.DataFrame, steps: int, q: float, shape: dict, reset_first: bool, conformal: bool) -> dict | None:
    """An artifact of one series, or None if it is too short."""
    pdf, stacks = pdf.sort_values("observed_at"), Stacks(shape, reset_first, conformal)
    done = stacks.add(None, pdf["observed_value"].to_numpy(float), _calendar(_clock(pdf)), steps, q) + stacks.rest()
    return done[0][1] if done else None


def train_trees(x: np.ndarray, y: np.ndarray, names: list[str], q: float) -> dict:
    trees = {k: QuantileTrees(0.5 if k == "p50" else q, rounds, rate).fit(x, y).dump() for k, (rounds, rate) in TREES.items()}
    return {"format": "quantile-trees", "schema": FEATURE_SCHEMA, "features": names, "quantile": q, "trees": trees}


def encoded(artifact: dict) -> tuple[bytes, str]:
    """An artifact's bytes and their SHA-256."""
    raw = json.dumps(artifact, sort_keys=True, separators=(",", ":")).encode()
    return raw, hashlib.sha256(raw).hexdigest()


def decoded(raw: bytes, sha256: str | None = None, q: float | None = None) -> dict:
    """A checked artifact with its model under 'model'; ValueError says what is wrong."""
    if sha256 is not None and hashlib.sha256(raw).hexdigest() != sha256:
        raise ValueError("the artifact is not what its digest says")
    spec = json.loads(raw)
    if not 0 < spec.get("quantile", 0) < 1 or (q is not None and abs(spec["quantile"] - q) > 1e-9):
        raise ValueError("the artifact is for another quantile")
    if spec.get("format") == "quantile-trees":
        if spec["schema"] != FEATURE_SCHEMA or spec["features"] != sorted(spec["features"]):
            raise ValueError("the artifact is for other features")
        spec["model"] = {k: QuantileTrees.load(t) for k, t in spec["trees"].items()}
    elif spec.get("format") == "gated-network":
        if not np.isfinite([spec["minimum"], spec["scale"]]).all() or spec["scale"] <= 0 or spec["length"] < 1:
            raise ValueError("the artifact's scale or length can't hold")
        spec["model"] = GatedNetwork.load(spec["network"])
    else:
        raise ValueError("no artifact format that is known")
    return spec


def predict_sequence(spec: dict, pdf: pd.DataFrame) -> tuple[float, float] | None:
    """(p50, upper) after the last row, 0 at least and in order; None with too few rows."""
    pdf = pdf.sort_values("observed_at").tail(spec["length"])
    if len(pdf) < spec["length"]:
        return None
    rows = np.hstack([((pdf["observed_value"].to_numpy(float) - spec["minimum"]) / spec["scale"])[:, None], _calendar(_clock(pdf))])
    low, high = spec["model"].quantiles(rows[None])[0] * spec["scale"] + spec["minimum"]
    low = max(0.0, float(low))
    return low, max(low, float(high))


ARTIFACT = "workload_id string, source_fingerprint string, engine string, artifact binary, artifact_sha256 string, rows long"


def _own(rows: DataFrame, steps: Column | int, q: Column | float) -> DataFrame:
    """Rows with their series' steps and quantile."""
    one = lambda x: x if isinstance(x, Column) else F.lit(x)
    return rows.withColumns({"steps_": one(steps).cast("int"), "q_": one(q).cast("double")})


def _by_series(samples: DataFrame, steps: Column | int, q: Column | float) -> DataFrame:
    """Whole series in time order, one after the other in their partition, with their steps and quantile."""
    clock = ["clock"] if "clock" in samples.columns else []
    rows = _own(samples, steps, q).select(*SERIES, "observed_at", "observed_value", *clock, "steps_", "q_")
    return rows.repartition(*SERIES).sortWithinPartitions(*SERIES, "observed_at")


def _each_series(batches: Iterator[pd.DataFrame]) -> Iterator[tuple[tuple, pd.DataFrame]]:
    """(key, rows) of each series in batches that hold them one after the other; one that goes over batches is put together."""
    key, parts = None, []
    for batch in batches:
        for found, rows in batch.groupby(SERIES, sort=False, dropna=False):
            found = tuple(None if pd.isna(k) else k for k in found)
            if parts and found != key:
                yield key, pd.concat(parts, ignore_index=True)
                parts = []
            key = found
            parts.append(rows)
    if parts:
        yield key, pd.concat(parts, ignore_index=True)


def train_networks(samples: DataFrame, steps: Column | int, q: Column | float, kind: str = "native", shape: dict | None = None) -> DataFrame:
    """One artifact row per series that is long enough. ``kind``: 'native' (reset first) or 'conformal' (reset after, with an offset).

    ``steps`` and ``q`` may be columns of ``samples``; ``clock``, if there is
    one, is the wall clock that the calendar's inputs are taken from. Samples
    are dealt by series once; a task reads its series one after the other and
    fits them in stacks.
    """
    ship(samples.sparkSession)
    shape = shape or (NATIVE if kind == "native" else CONFORMAL)
    columns = [*SERIES, "engine", "artifact", "artifact_sha256", "rows"]

    def fit(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        stacks = Stacks(shape, kind == "native", kind != "native")
        table = lambda done: pd.DataFrame([[*key, "gru", *encoded(artifact), rows] for (key, rows), artifact in done], columns=columns)
        for key, pdf in _each_series(batches):
            done = stacks.add((key, len(pdf)), pdf["observed_value"].to_numpy(float), _calendar(_clock(pdf)), int(pdf["steps_"].iloc[0]), float(pdf["q_"].iloc[0]))
            if done:
                yield table(done)
        yield table(stacks.rest())

    return _by_series(samples, steps, q).mapInPandas(fit, ARTIFACT)


def train_tree_models(rows: DataFrame, q: Column | float, steps: Column | int = 0, season: Column | int = 0, settings: tuple[str, ...] = (), least: int = 4) -> DataFrame:
    """One artifact row per series, from the rows of ``tree_rows``, or from feature rows without a label.

    Those get theirs here, the largest of the next ``steps`` values, from row
    ``season`` of the series on; ``q``, ``steps`` and ``season`` may be columns,
    then ``settings`` names those that are no features.
    """
    ship(rows.sparkSession)
    given = {"q_": q, "steps_": steps, "season_": season}
    names = sorted(c for c in rows.columns if c not in (*SERIES, "observed_at", "label", *settings))
    labelled = "label" in rows.columns

    def fit(key: tuple, pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.sort_values("observed_at")
        x, n, places = pdf[names].to_numpy(np.float32 if not labelled else float), int(pdf["steps_"].iloc[0]), slice(None)
        if labelled:
            y = pdf["label"].to_numpy(float)
        else:
            y = _horizon_maxima(pdf["current_value"].to_numpy(float), n).astype(np.float32)
            places = slice(max(0, int(pdf["season_"].iloc[0]) - WARM_UP), len(y))
        x, y = x[places].astype(float), y[places.start or 0 :].astype(float)
        if len(y) < least:
            return pd.DataFrame(columns=[*SERIES, "engine", "artifact", "artifact_sha256", "rows"])
        artifact = train_trees(x, y, names, float(pdf["q_"].iloc[0]))
        return pd.DataFrame([[*key, "xgboost", *encoded(artifact), len(y)]], columns=[*SERIES, "engine", "artifact", "artifact_sha256", "rows"])

    wide = rows.withColumns({c: x if isinstance(x, Column) else F.lit(x) for c, x in given.items()})
    return wide.select(*SERIES, "observed_at", *names, *(["label"] if labelled else []), *given).groupBy(*SERIES).applyInPandas(fit, ARTIFACT)


def predict_rows(inputs: DataFrame, artifacts: DataFrame) -> DataFrame:
    """(series, observed_at, p50, upper) from feature rows and the tree artifacts of their series."""
    names = sorted(c for c in inputs.columns if c not in (*SERIES, "observed_at", "label"))

    def score(key: tuple, rows: pd.DataFrame, models: pd.DataFrame) -> pd.DataFrame:
        if not len(rows) or not len(models):
            return pd.DataFrame(columns=[*SERIES, "observed_at", "p50", "upper"])
        spec = decoded(bytes(models["artifact"].iloc[0]), models["artifact_sha256"].iloc[0])
        x = rows[spec["features"]].to_numpy(float)
        low = np.maximum(spec["model"]["p50"].predict(x), 0)
        return rows[[*SERIES, "observed_at"]].assign(p50=low, upper=np.maximum(spec["model"]["upper"].predict(x), low))

    ship(inputs.sparkSession)
    rows = inputs.select(*SERIES, "observed_at", *names)
    return apart(rows).groupBy(*SERIES).cogroup(apart(artifacts).groupBy(*SERIES)).applyInPandas(score, "workload_id string, source_fingerprint string, observed_at timestamp, p50 double, upper double")


def predict_last(samples: DataFrame, artifacts: DataFrame) -> DataFrame:
    """(series, p50, upper) after each series' last row, from its network artifact; null with too few rows."""

    def score(key: tuple, rows: pd.DataFrame, models: pd.DataFrame) -> pd.DataFrame:
        if not len(rows) or not len(models):
            return pd.DataFrame(columns=[*SERIES, "p50", "upper"])
        out = predict_sequence(decoded(bytes(models["artifact"].iloc[0]), models["artifact_sha256"].iloc[0]), rows)
        return pd.DataFrame([[*key, *(out or (None, None))]], columns=[*SERIES, "p50", "upper"]).astype({"p50": float, "upper": float})

    ship(samples.sparkSession)
    rows = samples.select(*SERIES, "observed_at", "observed_value", *(["clock"] if "clock" in samples.columns else []))
    return apart(rows).groupBy(*SERIES).cogroup(apart(artifacts).groupBy(*SERIES)).applyInPandas(score, "workload_id string, source_fingerprint string, p50 double, upper double")


def refit_walk_forward(rows: DataFrame, q: float, cuts: int, steps: int, least: int = 60) -> DataFrame:
    """(series, cut, actual, p50, upper): the tree model fitted anew before each of the last ``cuts`` places, a horizon apart, in parallel.

    Each (series, cut) is one group that holds the rows whose label was
    known at the cut, and the row to predict.
    """
    names = sorted(c for c in rows.columns if c not in (*SERIES, "observed_at", "label"))
    back = F.row_number().over(Window.partitionBy(*SERIES).orderBy(F.col("observed_at").desc()))
    n = F.count("*").over(Window.partitionBy(*SERIES))
    numbered = rows.withColumn("back", back).withColumn("n", n).withColumn("cut", F.explode(F.sequence(F.lit(0), F.lit(cuts - 1))))
    at = F.col("cut") * steps + 1
    used = numbered.where((F.col("back") == at) | (F.col("back") >= at + steps)).withColumn("is_target", F.col("back") == at)

    def fit(key: tuple, pdf: pd.DataFrame) -> pd.DataFrame:
        past, target = pdf[~pdf["is_target"]].sort_values("observed_at"), pdf[pdf["is_target"]]
        if len(past) < least or not len(target):
            return pd.DataFrame(columns=[*SERIES, "cut", "actual", "p50", "upper"])
        spec = decoded(encoded(train_trees(past[names].to_numpy(float), past["label"].to_numpy(float), names, q))[0])
        x = target[names].to_numpy(float)
        low = max(0.0, float(spec["model"]["p50"].predict(x)[0]))
        return pd.DataFrame([[*key, float(target["label"].iloc[0]), low, max(low, float(spec["model"]["upper"].predict(x)[0]))]], columns=[*SERIES, "cut", "actual", "p50", "upper"])

    ship(rows.sparkSession)
    return used.groupBy(*SERIES, "cut").applyInPandas(fit, "workload_id string, source_fingerprint string, cut int, actual double, p50 double, upper double")


def refit_networks(samples: DataFrame, steps: Column | int, q: Column | float, most: int = 12, kind: str = "native", shape: dict | None = None) -> DataFrame:
    """(series, cut, q, actual, p50, upper): the network fitted anew to the rows before each of the last ``most`` cuts, and the maximum of the ``steps`` rows behind it.

    A cut is the number of rows before it; the first has a sequence, a horizon
    and one row before it. Values behind a cut take no part in its fit. Where
    a series is too short for two horizons behind that, or a cut for a fit, it
    has no row. Rows are dealt by series once, however many cuts there are; a
    series' cuts are fitted in stacks.
    """
    shape = shape or (VALIDATION if kind == "native" else CONFORMAL)
    columns = [*SERIES, "cut", "q", "actual", "p50", "upper"]

    def table(done: list[tuple]) -> pd.DataFrame:
        rows = []
        for (key, cut, actual, past), artifact in done:
            low, upper = predict_sequence(decoded(encoded(artifact)[0]), past)
            rows.append([*key, cut, artifact["quantile"], actual, low, upper])
        return pd.DataFrame(rows, columns=columns)

    def fit(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        stacks = Stacks(shape, kind == "native", kind != "native")
        for key, pdf in _each_series(batches):
            values, inputs = pdf["observed_value"].to_numpy(float), _calendar(_clock(pdf))
            ahead, level, n = int(pdf["steps_"].iloc[0]), float(pdf["q_"].iloc[0]), len(pdf)
            first = shape["length"] + ahead + 1
            if n <= first + ahead:
                continue
            maxima = _horizon_maxima(values, ahead)
            for cut in range(max(first, n - ahead - most + 1), n - ahead + 1):
                if not np.isfinite(maxima[cut - 1]):
                    continue
                done = stacks.add((key, cut, float(maxima[cut - 1]), pdf.iloc[cut - shape["length"] : cut]), values[:cut], inputs[:cut], ahead, level)
                if done:
                    yield table(done)
        yield table(stacks.rest())

    ship(samples.sparkSession)
    return _by_series(samples, steps, q).mapInPandas(fit, "workload_id string, source_fingerprint string, cut int, q double, actual double, p50 double, upper double")


def text_of(raw: bytes) -> str:
    """An artifact's bytes as text for JSON columns."""
    return base64.b64encode(raw).decode()
