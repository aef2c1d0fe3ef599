"""Settings of the processes from their environment: ``load`` takes a lookup of names, so tests need no environment."""

from __future__ import annotations

import re
from collections.abc import Callable, Iterable
from dataclasses import dataclass
from typing import Any

from tidemark.operators.promote import EvaluationPolicy
from tidemark.operators.repair import RepairLimits

PREFIX = "TIDEMARK_"
Lookup = Callable[[str], str | None]

_UNITS = {"h": 3600.0, "m": 60.0, "s": 1.0, "ms": 1e-3, "us": 1e-6, "ns": 1e-9}
_DURATION = re.compile(r"(\d+(?:\.\d*)?|\.\d+)(ms|us|ns|h|m|s)")


def duration_s(text: str) -> float:
    """Seconds of '1h30m', '500ms' or '0'."""
    text = text.strip()
    parts = _DURATION.findall(text)
    if text == "0":
        return 0.0
    if not parts or "".join(n + u for n, u in parts) != text:
        raise ValueError("must be a duration")
    return sum(float(n) * _UNITS[u] for n, u in parts)


def _positive_duration(text: str) -> float:
    out = duration_s(text)
    if out <= 0:
        raise ValueError("must be a positive duration")
    return out


def _number(least: int) -> Callable[[str], int]:
    def read(text: str) -> int:
        if not re.fullmatch(r"[+-]?\d+", text.strip()) or int(text) < least:
            raise ValueError(f"must be a whole number of {least} at least")
        return int(text)

    return read


def _switch(text: str) -> bool:
    known = {"1": True, "t": True, "true": True, "0": False, "f": False, "false": False}
    if text.strip().lower() not in known:
        raise ValueError("must be true or false")
    return known[text.strip().lower()]


def _names(text: str) -> tuple[str, ...]:
    out = tuple(dict.fromkeys(x.strip() for x in text.split(",") if x.strip()))
    if not out:
        raise ValueError("must name at least one")
    return out


@dataclass(frozen=True)
class Setting:
    """A name, how its text is read, and the default; none means that it must be set."""

    name: str
    read: Callable[[str], Any] = str.strip
    default: Any = None


#: Names and defaults of the two processes' settings; durations in seconds.
CONTROL = (
    Setting("CLUSTER_ID"), Setting("STORE"), Setting("SCALER_ADDRESSES", _names), Setting("METRICS_ADDRESS", default=":8080"), Setting("HEALTH_ADDRESS", default=":8081"), Setting("LEADER_ELECTION", _switch, True),
    Setting("NAMESPACE", default="tidemark-system"), Setting("CLEANUP_INTERVAL", _positive_duration, 86_400.0), Setting("MIN_TRAINING_WINDOW", _positive_duration, 7 * 86_400.0),
    Setting("RECOVERY_ENABLED", _switch, True), Setting("RECOVERY_INTERVAL", _positive_duration, 30.0), Setting("RECOVERY_PROBE_TIMEOUT", _positive_duration, 5.0),
)
SAMPLING = (
    Setting("CLUSTER_ID"), Setting("STORE"), Setting("TICK_INTERVAL", _positive_duration, 1.0), Setting("QUERY_TIMEOUT", _positive_duration, 10.0), Setting("INITIAL_BACKOFF", _positive_duration, 0.5), Setting("JITTER_WINDOW", _positive_duration, 15.0),
    Setting("RECOVERY_WINDOW", _positive_duration, 86_400.0), Setting("MAX_CONCURRENT", _number(1), 8), Setting("MAX_RETRIES", _number(0), 2), Setting("METRICS_ADDRESS", default=":8080"),
)


def load(settings: Iterable[Setting], lookup: Lookup) -> dict[str, Any]:
    """The settings by their lower-case names; ValueError names the first that is missing or can't hold. Blank counts as not set."""
    out = {}
    for s in settings:
        text = (lookup(PREFIX + s.name) or "").strip()
        if not text and s.default is None:
            raise ValueError(f"{PREFIX}{s.name} is required")
        try:
            out[s.name.lower()] = s.read(text) if text else s.default
        except ValueError as e:
            raise ValueError(f"{PREFIX}{s.name} {e}") from None
    return out


def _over(defaults: Any, names: dict[str, tuple[str, Callable[[str], Any]]], lookup: Lookup) -> dict[str, Any]:
    out = {}
    for field, (name, read) in names.items():
        text = (lookup(PREFIX + name) or "").strip()
        try:
            out[field] = read(text) if text else getattr(defaults, field)
        except ValueError as e:
            raise ValueError(f"{PREFIX}{name} {e}") from None
    return out


def evaluation_policy(lookup: Lookup) -> EvaluationPolicy:
    """The policy of evaluations; one that can't hold is refused, not weakened."""
    names = {
        "mode": ("PROMOTION_MODE", str), "window_s": ("EVALUATION_WINDOW", duration_s), "min_duration_s": ("EVALUATION_MIN_DURATION", duration_s), "min_windows": ("EVALUATION_MIN_WINDOWS", int), "max_windows": ("EVALUATION_MAX_WINDOWS", int),
        "coverage_tolerance": ("COVERAGE_TOLERANCE", float), "minimum_improvement": ("MIN_IMPROVEMENT", float), "max_relative_underprediction": ("MAX_RELATIVE_UNDERPREDICTION", float), "rollback": ("ROLLBACK_ENABLED", _switch),
    }
    return EvaluationPolicy(**_over(EvaluationPolicy(), names, lookup))


def repair_limits(lookup: Lookup) -> RepairLimits:
    """The limits of history repairs."""
    names = {"timeout_s": ("REPAIR_TIMEOUT", duration_s), "query_timeout_s": ("REPAIR_QUERY_TIMEOUT", duration_s), "points": ("REPAIR_MAX_POINTS", int)}
    return RepairLimits(**_over(RepairLimits(), names, lookup))
