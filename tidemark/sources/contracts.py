"""Contracts from declarative scaling objects: one candidate per predictive trigger, with all that is against it."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tidemark.functions.text import fingerprint, is_plain_address
from tidemark.functions.time import format_duration, parse_duration
from tidemark.schema import finite

OBJECT = "namespace string, name string, uid string, generation bigint, target string, min_replicas int, max_replicas int, triggers array<struct<type:string, name:string, metadata:map<string,string>>>"
#: Defaults and bounds of a contract, in seconds where they are times.
HORIZON, WINDOW, INTERVAL, QUANTILE, ENGINE = 600, 30 * 86400, 60, 0.95, "xgboost"
LEAST_WINDOW, MOST_WINDOW = 7 * 86400, 90 * 86400
ENGINES = ("seasonal-baseline", "rolling-quantile", "holt-winters", "xgboost", "gru")
_TRUE, _FALSE = ("1", "t", "T", "TRUE", "true", "True"), ("0", "f", "F", "FALSE", "false", "False")


@dataclass(frozen=True)
class ParseOptions:
    cluster_id: str = "main"
    scaler_addresses: tuple[str, ...] = ()
    default_min: int = 0
    default_max: int = 100
    least_window_s: int = LEAST_WINDOW


def objects(texts: DataFrame, body: str = "body") -> DataFrame:
    """Rows with the parsed object under ``spec``, from JSON."""
    return texts.withColumn("spec", F.from_json(F.col(body), OBJECT))


def triggers(rows: DataFrame, options: ParseOptions) -> DataFrame:
    """One row per trigger, with its ``role``: predictive, reactive_source (named by a predictive one), or other."""
    flat = rows.select("object_id", "spec", F.posexplode("spec.triggers").alias("place", "trigger"))
    meta = lambda k: F.trim(F.element_at(F.col("trigger.metadata"), k))
    predictive = (F.col("trigger.type") == "external") & F.coalesce(meta("scalerAddress").isin(*options.scaler_addresses) if options.scaler_addresses else F.lit(False), F.lit(False))
    flat = flat.withColumn("predictive", predictive).withColumn("source_name", F.when(F.col("predictive"), F.coalesce(meta("sourceTrigger"), F.lit(""))))
    named = F.filter(F.collect_set("source_name").over(Window.partitionBy("object_id")), lambda n: n != "")
    role = F.when(F.col("predictive"), "predictive").when((F.coalesce("trigger.name", F.lit("")) != "") & F.array_contains(named, F.col("trigger.name")), "reactive_source").otherwise("other")
    return flat.withColumn("role", role)


def _violation(field: str, message: str) -> Column:
    return F.lit(f"{field}: {message}")


def contracts(rows: DataFrame, options: ParseOptions) -> DataFrame:
    """Per predictive trigger (object_id, place): the parsed contract, its fingerprints, and ``violations``; fingerprints are null where there are any.

    The source is found by joining a trigger's source name to the names of
    its object's triggers; it must be exactly one, and of type prometheus.
    """
    flat = triggers(rows, options)
    others = flat.where(F.coalesce("trigger.name", F.lit("")) != "").groupBy("object_id", F.col("trigger.name").alias("source_name")).agg(F.count("*").alias("sources"), F.min(F.struct("place", "trigger.type")).alias("first"), F.min_by("trigger.metadata", "place").alias("source_meta"))
    own = flat.where("predictive")
    names = own.groupBy("object_id", F.coalesce("trigger.name", F.lit("")).alias("trigger_name")).agg(F.count("*").alias("same_name"))
    used = own.where("source_name <> ''").groupBy("object_id", "source_name").agg(F.count("*").alias("same_source"))
    t = own.withColumn("trigger_name", F.coalesce("trigger.name", F.lit(""))).join(names, ["object_id", "trigger_name"]).join(used, ["object_id", "source_name"], "left").join(others, ["object_id", "source_name"], "left")
    raw = lambda k: F.element_at(F.col("trigger.metadata"), k)
    text = lambda k: F.coalesce(F.trim(raw(k)), F.lit(""))
    source = lambda k: F.coalesce(F.trim(F.element_at(F.col("source_meta"), k)), F.lit(""))
    found: list[Column] = []
    add = lambda when, field, message: found.append(F.when(F.coalesce(when, F.lit(False)), _violation(field, message)))

    def duration(k: str, default: float, least_exclusive: bool) -> Column:
        value = parse_duration(text(k))
        ok = value > 0 if least_exclusive else value >= 0
        add((text(k) != "") & ~F.coalesce(ok, F.lit(False)), f"metadata.{k}", "is no duration above zero" if least_exclusive else "is no duration from zero on")
        return F.when((text(k) != "") & ok, value).otherwise(F.lit(float(default)))

    def flag(k: str) -> Column:
        add((text(k) != "") & ~text(k).isin(*_TRUE, *_FALSE), f"metadata.{k}", "is neither true nor false")
        return text(k).isin(*_TRUE)

    add(F.col("trigger_name") == "", "triggers[].name", "is missing")
    add(F.col("same_name") > 1, "triggers[].name", "is shared by several predictive triggers")
    add(F.col("source_name") == "", "triggers[].metadata.sourceTrigger", "is missing")
    add(F.col("same_source") > 1, "triggers[].metadata.sourceTrigger", "serves several predictive triggers")
    add((F.col("source_name") != "") & (F.coalesce("sources", F.lit(0)) != 1), "triggers[].metadata.sourceTrigger", "names no trigger, or several")
    one = F.col("sources") == 1
    add(one & (F.col("first.type") != "prometheus"), "triggers[].metadata.sourceTrigger", "is no prometheus trigger")
    real = one & (F.col("first.type") == "prometheus")
    threshold = source("threshold").try_cast("double")
    add(real & ~is_plain_address(source("serverAddress")), "source.metadata.serverAddress", "is no plain http(s) address")
    add(real & (source("query") == ""), "source.metadata.query", "is missing")
    add(real & ~F.coalesce(finite(threshold) & (threshold > 0), F.lit(False)), "source.metadata.threshold", "is not above zero")
    horizon, window, interval = duration("forecastHorizon", HORIZON, True), duration("trainingWindow", WINDOW, True), duration("samplingInterval", INTERVAL, True)
    startup, buffer = duration("startupLatency", 0, False), duration("safetyBuffer", 0, False)
    immediate, clear = flag("immediateTraining"), flag("clearOldModels")
    q = text("quantile").try_cast("double")
    add((text("quantile") != "") & ~F.coalesce((q > 0) & (q < 1), F.lit(False)), "metadata.quantile", "lies outside (0, 1)")
    quantile = F.when((text("quantile") != "") & (q > 0) & (q < 1), q).otherwise(QUANTILE)
    engine = F.when(text("modelEngine") == "", ENGINE).otherwise(text("modelEngine"))
    add(~engine.isin(*ENGINES), "metadata.modelEngine", "is no known engine")
    add((window < options.least_window_s) | (window > MOST_WINDOW), "metadata.trainingWindow", "is shorter or longer than allowed")
    for value, k in ((window, "trainingWindow"), (interval, "samplingInterval"), (horizon, "forecastHorizon")):
        add(value != F.floor(value), f"metadata.{k}", "holds a fraction of a second")
    decision = horizon + startup + buffer
    add(F.pmod(window, F.greatest(interval, F.lit(1e-9))) != 0, "metadata.trainingWindow", "is no multiple of samplingInterval")
    add((decision <= 0) | (F.pmod(decision, F.greatest(interval, F.lit(1e-9))) != 0), "metadata.forecastHorizon", "with latency and buffer is no multiple of samplingInterval above zero")
    zone = F.when(text("businessTimezone") == "", "UTC").otherwise(text("businessTimezone"))
    add(~zone.isin("UTC", "GMT") & ~zone.rlike(r"^[A-Z][A-Za-z_]+(/[A-Z][A-Za-z_+-]*)+$"), "metadata.businessTimezone", "is no zone name")
    low, high = F.coalesce("spec.min_replicas", F.lit(options.default_min)), F.coalesce("spec.max_replicas", F.lit(options.default_max))
    add(low < 0, "spec.minReplicaCount", "is negative")
    add(high <= 0, "spec.maxReplicaCount", "is not above zero")
    add(low > high, "spec", "minReplicaCount exceeds maxReplicaCount")
    blank = lambda c: F.coalesce(F.trim(c), F.lit("")) == ""
    add(blank(F.col("spec.namespace")) | blank(F.col("spec.name")) | blank(F.col("spec.target")) | F.lit(not options.cluster_id.strip()), "object", "lacks a name, namespace, target or cluster")
    violations = F.array_compact(F.array(*found))
    out = t.select(
        "object_id", "place", F.lit(options.cluster_id).alias("cluster_id"), F.col("spec.namespace").alias("namespace"), F.col("spec.name").alias("scaled_name"), F.col("spec.target").alias("target"),
        "trigger_name", F.col("source_name").alias("source_trigger"), source("serverAddress").alias("server_address"), source("query").alias("query"), threshold.alias("threshold"),
        quantile.alias("quantile"), horizon.alias("horizon_s"), window.alias("training_window_s"), interval.alias("interval_s"), startup.alias("startup_s"), buffer.alias("buffer_s"),
        immediate.alias("immediate_training"), clear.alias("clear_old_models"), engine.alias("engine"), zone.alias("timezone"), low.alias("min_replicas"), high.alias("max_replicas"), violations.alias("violations"),
    )
    good = F.size("violations") == 0
    out = out.withColumn("source_fingerprint", F.when(good, fingerprint(F.col("server_address"), F.col("query"))))
    settings = ["threshold", "min_replicas", "max_replicas", "horizon_s", "quantile", "training_window_s", "interval_s", "engine", "timezone", "startup_s", "buffer_s", "immediate_training", "clear_old_models"]
    return out.withColumn("policy_revision", F.when(good, fingerprint(F.col("source_fingerprint"), *[F.col(c) for c in settings])))


def trigger_report(rows: DataFrame, options: ParseOptions) -> DataFrame:
    """One row per trigger for display: role, validity, and the contract's settings of predictive ones."""
    parsed = contracts(rows, options).select("object_id", "place", "engine", format_duration(F.col("horizon_s")).alias("horizon"), format_duration(F.col("training_window_s")).alias("training_window"), (F.size("violations") == 0).alias("valid"))
    flat = triggers(rows, options).select("object_id", "place", F.coalesce("trigger.name", F.lit("")).alias("trigger_name"), F.col("trigger.type").alias("trigger_type"), "role")
    return flat.join(parsed, ["object_id", "place"], "left")
