"""Inference of stored model versions at held-out origins, and of those that serve at the last row."""

from __future__ import annotations

import math

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tidemark.functions.time import local
from tidemark.operators.features import PROVIDERS, calendar_features
from tidemark.operators.forecast import ENGINES, smoothed_peak
from tidemark.operators.learned import _calendar, decoded
from tidemark.schema import SERIES, apart
from tidemark.session import ship

#: What is wrong with a model at an origin.
BAD_ARTIFACT, BAD_PREDICTION = "invalid_artifact", "invalid_prediction"


def with_features(rows: DataFrame, wanted: Column, timezone: str = "timezone") -> tuple[DataFrame, list[str]]:
    """``rows`` with ``features``, an array in the order of the names given back, where ``wanted`` holds; all windows share one sort."""
    out = rows
    for provider in [*PROVIDERS[:-1], lambda x: calendar_features(x, F.col(timezone))]:
        out = provider(out)
    names = sorted(c for c in out.columns if c not in rows.columns)
    return out.select(*rows.columns, F.when(wanted, F.array(*[F.col(c).cast("float") for c in names])).alias("features")), names


def seasonal(history: np.ndarray, season: int, steps: int) -> float | None:
    """The last season's largest value over the next ``steps`` places."""
    return float(history[len(history) - season :][: min(steps, season)].max()) if len(history) >= season else None


def rolling(history: np.ndarray, steps: int, q: float) -> tuple[float, float] | None:
    """Nearest-rank median and q-quantile of the maxima of all windows of ``steps`` values."""
    if len(history) <= steps:
        return None
    peaks = np.sort(np.lib.stride_tricks.sliding_window_view(history, steps).max(axis=1))
    rank = lambda share: float(peaks[min(max(math.ceil(share * len(peaks)), 1), len(peaks)) - 1])
    return rank(0.5), rank(q)


def statistical(engine: str, history: np.ndarray, season: int, steps: int, q: float) -> tuple[float, float] | None:
    """(p50, upper) of an engine without a fit, after the last of ``history``; None where that is too short."""
    if engine == "seasonal-baseline":
        peak = seasonal(history, season, steps)
        return None if peak is None else (peak, peak)
    if engine == "rolling-quantile":
        return rolling(history, steps, q)
    if engine == "holt-winters":
        return (smoothed_peak(history, season, steps),) * 2 if len(history) >= 2 * season else None
    raise ValueError(f"no engine {engine!r}")


def at_cuts(model: dict, rows: pd.DataFrame, cuts: np.ndarray, names: list[str]) -> np.ndarray:
    """(p50, upper) of one model after each of the ``cuts`` first rows of a series; NaN where history is too short.

    ``rows`` have the value, the wall clock, the first place of their segment,
    and features where trees ask. Only what lies before a cut is looked at, in
    its segment, and no more than the training window or the model's own
    length.
    """
    values = rows["observed_value"].to_numpy(float)
    first = rows["segment_at"].to_numpy(np.int64)
    season, steps, q, window = (rows[c].iloc[0] for c in ("season", "steps", "quantile", "window"))
    out = np.full((len(cuts), 2), np.nan)
    if not ENGINES[model["engine"]].needs_artifact:
        for k, c in enumerate(cuts):
            out[k] = statistical(model["engine"], values[max(first[c - 1], c - int(window)) : c], int(season), int(steps), float(q)) or (np.nan, np.nan)
        return np.maximum(out, 0)
    spec = decoded(bytes(model["artifact"]), model["artifact_sha256"], float(q))
    if spec["format"] == "quantile-trees":
        place = {name: k for k, name in enumerate(names)}
        if any(f not in place for f in spec["features"]):
            raise ValueError("the artifact is for other features")
        has = np.array([rows["features"].iloc[c - 1] is not None for c in cuts], bool)
        x = np.array([rows["features"].iloc[c - 1] for c in cuts[has]], float).reshape(-1, len(names))[:, [place[f] for f in spec["features"]]]
        fit = np.isfinite(x).all(axis=1)
        x, kept = x[fit], np.flatnonzero(has)[fit]
        if len(kept):
            out[kept, 0], out[kept, 1] = (spec["model"][k].predict(x) for k in ("p50", "upper"))
    else:
        length = spec["length"]
        kept = np.flatnonzero(cuts - length >= first[cuts - 1])
        inputs = np.hstack([((values - spec["minimum"]) / spec["scale"])[:, None], _calendar(rows["clock"])])
        if len(kept):
            windows = np.stack([inputs[c - length : c] for c in cuts[kept]])
            out[kept] = spec["model"].quantiles(windows) * spec["scale"] + spec["minimum"]
    out = np.maximum(out, 0)
    out[:, 1] = np.maximum(out[:, 1], out[:, 0])
    return out


ROWS = ["observed_at", "observed_value", "clock", "segment_at", "is_origin", "features", "season", "steps", "quantile", "window"]
MODEL = ["model", "engine", "artifact", "artifact_sha256"]
SCORED = "workload_id string, source_fingerprint string, origin timestamp, model string, p50 double, upper double, fault string"


def predict_at(rows: DataFrame, models: DataFrame, names: list[str]) -> DataFrame:
    """(series, origin, model, p50, upper, fault): every model of a series after each of its rows that ``is_origin``.

    One pass: a series' rows meet its models, a handful, in one group, which
    its window bounds; equal rows serve all models. ``rows`` have the columns
    ``ROWS``, ``models`` a name under ``model`` and the artifact, null for
    engines without one. A model that can't be read is a fault on each origin
    of its series, as is a prediction that can't be made or is not finite;
    other models and series are not touched.
    """
    ship(rows.sparkSession)

    def score(key: tuple, pdf: pd.DataFrame, known: pd.DataFrame) -> pd.DataFrame:
        columns = [*SERIES, "origin", "model", "p50", "upper", "fault"]
        parts = []
        if len(pdf) and len(known):
            pdf = pdf.sort_values("observed_at").reset_index(drop=True)
            cuts = np.flatnonzero(pdf["is_origin"].to_numpy(bool)) + 1
            for model in known.sort_values("model").to_dict("records"):
                try:
                    got, fault = at_cuts(model, pdf, cuts, names), None
                except (ValueError, KeyError, TypeError):
                    got, fault = np.full((len(cuts), 2), np.nan), BAD_ARTIFACT
                bad = ~np.isfinite(got).all(axis=1)
                part = pd.DataFrame({"origin": pdf["observed_at"].to_numpy()[cuts - 1], "model": model["model"], "p50": got[:, 0], "upper": got[:, 1]})
                part["fault"] = [fault or (BAD_PREDICTION if b else None) for b in bad]
                parts.append(part)
        if not parts:
            return pd.DataFrame(columns=columns)
        out = pd.concat(parts)
        out[SERIES] = list(key)
        return out[columns].astype({"p50": float, "upper": float})

    left = apart(rows.select(*SERIES, *ROWS)).groupBy(*SERIES)
    return left.cogroup(apart(models.select(*SERIES, *MODEL)).groupBy(*SERIES)).applyInPandas(score, SCORED)


def wall_clock(timezone: Column) -> Column:
    """A row's time on the clock of its series' business zone."""
    return local(F.col("observed_at"), timezone)
