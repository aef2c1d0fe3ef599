"""Cluster capacity and health, as far as they are sums and predicates."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: Parts of a core, powers of a byte.
_SUFFIXES = {"m": 1e-3, "k": 1e3, "M": 1e6, "G": 1e9, "T": 1e12, "Ki": 2.0**10, "Mi": 2.0**20, "Gi": 2.0**30, "Ti": 2.0**40}


def quantity(text: Column) -> Column:
    """'250m', '1.5', '512Mi' as a number; null for anything else."""
    number = F.regexp_extract(text, r"^([0-9]*\.?[0-9]+)(m|k|M|G|T|Ki|Mi|Gi|Ti)?$", 1)
    suffix = F.regexp_extract(text, r"^([0-9]*\.?[0-9]+)(m|k|M|G|T|Ki|Mi|Gi|Ti)?$", 2)
    scale = F.create_map(*[F.lit(x) for pair in _SUFFIXES.items() for x in pair])
    return F.when(number != "", number.cast("double") * F.when(suffix == "", 1.0).otherwise(F.element_at(scale, suffix)))


def pod_request(containers: Column, init_containers: Column, overhead: Column, resource: str) -> Column:
    """What a pod reserves: the sum over its containers or its largest init container, whichever is more, and its overhead."""
    value = lambda c: F.coalesce(c[resource], F.lit(0).cast("long"))
    total = F.aggregate(F.coalesce(containers, F.array()), F.lit(0).cast("long"), lambda s, c: s + value(c))
    largest = F.coalesce(F.array_max(F.transform(init_containers, value)), F.lit(0).cast("long"))
    return F.greatest(total, largest) + F.coalesce(overhead[resource], F.lit(0).cast("long"))


def capacity(nodes: DataFrame, pods: DataFrame, key: list[str], fraction: float = 0.25) -> DataFrame:
    """Per cluster: allocatable, requested, available and budget, in thousandths of a core and bytes.

    ``pods``: ``phase`` and the two requests; finished pods reserve nothing.
    """
    share = round((fraction if 0 < fraction <= 1 else 0.25) * 1000)
    have = nodes.groupBy(*key).agg(F.sum("cpu_milli").alias("allocatable_cpu"), F.sum("memory").alias("allocatable_memory"), F.count("*").alias("nodes"))
    used = pods.where(~F.col("phase").isin("Succeeded", "Failed")).groupBy(*key).agg(F.sum("cpu_milli").alias("requested_cpu"), F.sum("memory").alias("requested_memory"))
    out = have.join(used, key, "left").na.fill(0, ["requested_cpu", "requested_memory"])
    for r in ("cpu", "memory"):
        out = out.withColumn(f"available_{r}", F.col(f"allocatable_{r}") - F.col(f"requested_{r}"))
        scaled = F.col(f"available_{r}") * share
        out = out.withColumn(f"budget_{r}", ((scaled - F.pmod(scaled, F.lit(1000))) / 1000).cast("long"))
    return out


def fits(extra: Column, each: Column, available: Column, fraction: float = 0.25) -> Column:
    """Whether ``extra`` more replicas of ``each`` stay within the fraction of what is available, in whole thousandths."""
    share = round((fraction if 0 < fraction <= 1 else 0.25) * 1000)
    return extra * each * 1000 <= available * share


def capacity_allows(proposals: DataFrame, capacities: DataFrame, key: list[str], fraction: float = 0.25) -> DataFrame:
    """Proposals (current, desired, cpu_milli, memory of one replica) with ``allowed``; no more replicas are always, unknown sizes never."""
    rows = proposals.join(capacities, key, "left")
    extra = F.ceil(F.col("desired") - F.col("current"))
    known = (F.col("cpu_milli") > 0) & (F.col("memory") > 0) & (F.col("nodes") > 0)
    ok = known & fits(extra, F.col("cpu_milli"), F.col("available_cpu"), fraction) & fits(extra, F.col("memory"), F.col("available_memory"), fraction)
    return rows.withColumn("allowed", (extra <= 0) | F.coalesce(ok, F.lit(False))).select(*proposals.columns, "allowed")


def health(nodes: DataFrame, pods: DataFrame, key: list[str], most_unschedulable: int = 0) -> DataFrame:
    """Per cluster: all nodes ready, and few enough pods that can't be placed."""
    ready = nodes.groupBy(*key).agg(F.bool_and(F.coalesce("ready", F.lit(False))).alias("nodes_ready"), F.count("*").alias("nodes"))
    stuck = (F.col("phase") == "Pending") & F.col("unschedulable")
    waiting = pods.groupBy(*key).agg(F.count_if(F.coalesce(stuck, F.lit(False))).alias("unschedulable"))
    out = ready.join(waiting, key, "left").na.fill(0, ["unschedulable"])
    return out.withColumn("healthy", F.col("nodes_ready") & (F.col("unschedulable") <= most_unschedulable))
