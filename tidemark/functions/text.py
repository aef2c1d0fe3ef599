"""Strict parses, addresses, fingerprints."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from tidemark.schema import finite


def parse_finite(text: Column) -> Column:
    """A number that is finite, or null."""
    value = text.try_cast("double")
    return F.when(finite(value), value)


def is_plain_address(address: Column) -> Column:
    """An absolute http(s) address with a host, without credentials or fragment."""
    return F.coalesce(F.trim(address).rlike(r"^https?://[^/?#@\s]+([/?][^#\s]*)?$"), F.lit(False))


def fingerprint(*parts: Column) -> Column:
    """SHA-256 of the parts as one JSON array of strings; a null part is a null in it."""
    return F.sha2(F.to_json(F.array(*[p.cast("string") for p in parts])), 256)


#: Fixed values of the 64-bit FNV-1a hash.
FNV_OFFSET, FNV_PRIME = 14695981039346656037, 1099511628211


def fnv1a(text: str) -> int:
    """FNV-1a over one text's UTF-8 bytes."""
    state = FNV_OFFSET
    for byte in text.encode():
        state = (state ^ byte) * FNV_PRIME & 0xFFFFFFFFFFFFFFFF
    return state


def fnv1a_64(text: Column) -> Column:
    """FNV-1a over the UTF-8 bytes, as a decimal; null for null.

    The state is two halves of 32 bits, so that no product leaves 64 bits: the
    prime is 2^40 and a small rest, and the first part only moves the lower half.
    """
    half = lambda x: F.lit(x).cast("long")
    rest, mask = half(FNV_PRIME - (1 << 40)), half(0xFFFFFFFF)

    def step(state: Column, pair: Column) -> Column:
        low = state["low"].bitwiseXOR(F.conv(pair, 16, 10).cast("long"))
        product = low * rest
        high = state["high"] * rest + F.shiftright(product, 32) + F.shiftleft(low, 8)
        return F.struct(high.bitwiseAND(mask).alias("high"), product.bitwiseAND(mask).alias("low"))

    pairs = F.regexp_extract_all(F.hex(F.encode(text, "UTF-8")), F.lit(".."), F.lit(0))
    start = F.struct(half(FNV_OFFSET >> 32).alias("high"), half(FNV_OFFSET & 0xFFFFFFFF).alias("low"))
    whole = lambda s: (s["high"].cast("decimal(10,0)") * F.lit(1 << 32).cast("decimal(10,0)") + s["low"].cast("decimal(10,0)")).cast("decimal(20,0)")
    return F.aggregate(pairs, start, step, whole)


def jitter_s(workload_id: Column, window_s: Column | int) -> Column:
    """A repeatable delay below ``window_s`` for one workload."""
    window = (F.lit(window_s) if isinstance(window_s, int) else window_s).cast("decimal(20,0)")
    return F.when(window > 0, F.pmod(fnv1a_64(workload_id), window).cast("long")).otherwise(0)
