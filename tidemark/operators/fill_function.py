"""The bounded gap filler as a table function, for callers from SQL."""

from __future__ import annotations

import math
from dataclasses import dataclass

from pyspark.sql import SparkSession
from pyspark.sql.functions import AnalyzeArgument, AnalyzeResult, OrderingColumn, PartitioningColumn, udtf
from pyspark.sql.types import BooleanType, DataType, DoubleType, IntegerType, LongType, NumericType, StringType, StructField, StructType, TimestampNTZType, TimestampType

from tidemark.functions.time import GRID_ORIGIN_S
from tidemark.operators.fill import MOST_CHANGE, MOST_SHARE, MOST_STEPS, REAL_TAIL, RECENT
from tidemark.schema import SERIES
from tidemark.session import ship

MICROS = 1_000_000


@dataclass
class Analysis(AnalyzeResult):
    """What the function's calls are told: the type of times."""

    time: DataType | None = None


def _number(value) -> bool:
    return value is not None and math.isfinite(value)


def model_input(points: list[tuple[int, float | None]], interval_s: int, max_gap_s: int, lookback: int) -> tuple[list[tuple[int, float | None, bool]], bool, int, str]:
    """(rows of (time, value, estimated), older rows dropped, estimated rows, status) of one series' ``points`` in order of time, in microseconds."""
    step = interval_s * MICROS
    if lookback > 0:
        points = [p for p in points if points[-1][0] - p[0] <= (lookback + MOST_STEPS) * step]
    repeated = any(a[0] == b[0] for a, b in zip(points, points[1:], strict=False))
    latest = list({(at + GRID_ORIGIN_S * MICROS) // step: (at, value) for at, value in points}.values())
    invalid = any(not _number(v) or v < 0 for _, v in latest)
    rows, dropped = [(*latest[0], False)], False
    for (before_at, before), (at, value) in zip(latest, latest[1:], strict=False):
        gap, steps = at - before_at, math.floor((at - before_at) / step + 0.5)
        if gap >= 1.5 * step:
            aligned = abs(gap - steps * step) <= step / 4 and steps <= MOST_STEPS
            stable = _number(value) and _number(before) and abs(value - before) / max(1.0, before, value) <= MOST_CHANGE
            if gap <= max_gap_s * MICROS + step / 4 and aligned and stable:
                rows += [(before_at + k * step, (1 - k * step / gap) * before + k * step / gap * value, True) for k in range(1, steps)]
            else:
                rows, dropped = [], True
        rows.append((at, value, False))
    if lookback > 0:
        rows = rows[-lookback:]
    estimated, recent = sum(r[2] for r in rows), rows[-RECENT:]
    status = "ok"
    if repeated:
        status = "not_ordered"
    elif invalid:
        status = "invalid_value"
    elif estimated and estimated / len(rows) > MOST_SHARE:
        status = "too_many_estimated"
    elif estimated and sum(r[2] for r in recent) / len(recent) > MOST_SHARE:
        status = "too_many_recent"
    elif any(r[2] for r in rows[-REAL_TAIL:]):
        status = "short_real_tail"
    return rows, dropped, estimated, status


class BoundedFill:
    """``SELECT * FROM bounded_fill(TABLE(samples), interval_s, max_gap_s, lookback)``: the rows of ``operators.fill.bounded_fill``.

    The function itself asks for its table by series and in order of time, so
    no caller can forget either; the table needs the columns of a series,
    ``observed_at`` and ``observed_value``, takes ``sequence`` into account
    where samples of one time differ by it, and ignores any other. Settings
    are constants; they and the table's columns are checked when the query is
    planned. A call holds one series' points, which its training window
    bounds. Rows without a time are left out; null in a series column is a
    series of its own; a null value is an invalid one. An empty table gives
    no rows.
    """

    @staticmethod
    def analyze(samples: AnalyzeArgument, interval_s: AnalyzeArgument, max_gap_s: AnalyzeArgument = None, lookback: AnalyzeArgument = None) -> Analysis:
        if not samples.isTable:
            raise ValueError("bounded_fill takes a table: TABLE(samples)")
        types = {f.name: f.dataType for f in samples.dataType.fields}
        lacking = [c for c in (*SERIES, "observed_at", "observed_value") if c not in types]
        if lacking:
            raise ValueError(f"bounded_fill: the table has no column {', '.join(lacking)}")
        if not isinstance(types["observed_at"], (TimestampType, TimestampNTZType)) or not isinstance(types["observed_value"], NumericType):
            raise ValueError("bounded_fill: observed_at must be a timestamp and observed_value a number")
        for name, given, least in (("interval_s", interval_s, 1), ("max_gap_s", max_gap_s, 0), ("lookback", lookback, 0)):
            if given is not None and (not given.isConstantExpression or not isinstance(given.dataType, (IntegerType, LongType)) or given.value is None or given.value < least):
                raise ValueError(f"bounded_fill: {name} must be a constant whole number of {least} or more")
        made = [StructField("observed_at", types["observed_at"]), StructField("observed_value", DoubleType()), StructField("is_estimated", BooleanType()), StructField("used_suffix", BooleanType()), StructField("estimated_count", LongType()), StructField("status", StringType())]
        order = [OrderingColumn(c) for c in ("observed_at", "sequence") if c in types]
        return Analysis(schema=StructType([StructField(c, types[c]) for c in SERIES] + made), partitionBy=[PartitioningColumn(c) for c in SERIES], orderBy=order, time=types["observed_at"])

    def __init__(self, analysis: Analysis):
        self.time, self.series, self.settings, self.points = analysis.time, None, None, []

    def eval(self, samples, interval_s, max_gap_s=300, lookback=0):
        self.series, self.settings = tuple(samples[c] for c in SERIES), (interval_s, max_gap_s, lookback)
        if samples["observed_at"] is not None:
            value = samples["observed_value"]
            self.points.append((self.time.toInternal(samples["observed_at"]), None if value is None else float(value)))

    def terminate(self):
        if self.points:
            rows, *facts = model_input(self.points, *self.settings)
            for at, value, estimated in rows:
                yield (*self.series, self.time.fromInternal(at), value, estimated, *facts)


def register(spark: SparkSession, name: str = "bounded_fill") -> None:
    """Makes the function known to the session's SQL as ``name``."""
    ship(spark)
    spark.udtf.register(name, udtf(BoundedFill))
