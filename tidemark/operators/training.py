"""Runs over all series at once: training of candidates, and evaluation of models against each other."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tidemark.functions.time import seconds_between, slot
from tidemark.operators import evaluate, learned, promote, scoring
from tidemark.operators.evaluate import METRICS
from tidemark.operators.features import FEATURE_SCHEMA, PROVIDERS, WARM_UP, calendar_features, evenly, feature_rows
from tidemark.operators.forecast import ENGINES
from tidemark.operators.quality import ordered, slot_dedup, training_segment
from tidemark.schema import SERIES, finite
from tidemark.session import cut

#: What a training run holds out, at most.
HOLDOUT_S, HOLDOUT_SHARE = 48 * 3600, 5
#: Fixed value: names of the inputs that models are made for.
SCHEMAS = {"xgboost": FEATURE_SCHEMA, "gru": "demand-calendar-sequence-v1"}


def holdout_split(samples: DataFrame, interval_s: Column | int, holdout_s: int = HOLDOUT_S) -> DataFrame:
    """Rows with ``is_holdout``: the last ones, as many as the time holds but no more than a fifth."""
    whole = Window.partitionBy(*SERIES)
    back = F.row_number().over(whole.orderBy(F.col("observed_at").desc()))
    n = F.count("*").over(whole)
    return samples.withColumn("back", back).withColumn("n", n).withColumn("is_holdout", F.col("back") <= F.least(F.floor(F.lit(holdout_s) / interval_s), F.floor(F.col("n") / HOLDOUT_SHARE))).drop("back", "n")


#: What a run takes from a contract.
SETTINGS = ["cluster_id", "engine", "interval_s", "steps", "season", "quantile", "timezone", "window_s", "contract"]


def training_settings(contracts: DataFrame, season_s: int, engine: str | None = None) -> DataFrame:
    """(series, SETTINGS, fault) of the active contracts: all in rows of the contract's own interval; a fault is a contract that can't be trained for."""
    have = set(contracts.columns)
    own = lambda name, default: F.coalesce(F.col(name), F.lit(default)) if name in have else F.lit(default)
    active = contracts.where("status = 'active'").withColumns({"startup_s": own("startup_s", 0), "buffer_s": own("buffer_s", 0), "timezone": own("timezone", "UTC"), "policy_revision": own("policy_revision", ""), "cluster_id": own("cluster_id", "")})
    asked = F.lit(engine) if engine else F.when(F.trim(own("engine", "")) == "", "seasonal-baseline").otherwise(F.trim(own("engine", "")))
    rows = active.select(*SERIES, "cluster_id", asked.alias("engine"), F.col("interval_s").cast("long").alias("interval_s"), promote.evaluation_contract(season_s).alias("contract"), F.col("quantile").cast("double").alias("quantile"), "timezone", own("training_window_s", None).cast("long").alias("window_s"))
    whole = lambda s: F.pmod(s, F.when(F.col("interval_s") > 0, F.col("interval_s"))) == 0
    fault = (
        F.when(~F.coalesce((F.col("interval_s") > 0) & (F.col("contract.horizon_s") > 0) & whole(F.col("contract.horizon_s")) & (F.col("quantile") > 0) & (F.col("quantile") < 1), F.lit(False)), "invalid_contract")
        .when(~whole(F.lit(season_s)), "season_not_on_the_grid")
        .when(~F.col("timezone").isin(*promote.ZONES), "unknown_timezone")
        .when(~F.col("engine").isin(*ENGINES), "unknown_engine")
    )
    rows = rows.withColumn("fault", fault)
    fits = F.when(F.col("fault").isNull(), F.col("interval_s"))
    return rows.withColumns({"steps": F.try_divide(F.col("contract.horizon_s"), fits).cast("int"), "season": F.try_divide(F.lit(season_s), fits).cast("int")}).select(*SERIES, *SETTINGS, "fault")


def train_by_contract(samples: DataFrame, contracts: DataFrame, now: Column, season_s: int, engine: str | None = None, shape: dict | None = None, kind: str = "native", holdout_s: int = HOLDOUT_S) -> tuple[DataFrame, DataFrame]:
    """Candidate models of all active contracts whose series has a long enough segment, and an outcome per contract.

    Each series is trained for its contract: engine, interval, decision
    horizon, quantile, business time zone, and training window up to the last
    whole interval before ``now``; ``engine``, if given, holds for all. Fits
    see the newest contiguous segment of a season and a quarter or more, less
    its holdout; a candidate's ``trained_until`` is the last time a fit has
    seen. Engines without an artifact get one that says so. Models are rows of
    the models table with what they were made for in ``hyperparameters``, and
    ``rows``; ids follow from series, engine, data and time.

    Rows that are fitted go to the shared folder once; each engine's series
    are fitted side by side from there. Outcomes name what is wrong with a
    contract, else 'insufficient_contiguous_history',
    'insufficient_history_after_holdout' or 'training_failed'.
    """
    asked = training_settings(contracts, season_s, engine)
    good = asked.where("fault is null").drop("fault")
    rows = samples.select(*SERIES, "observed_at", "observed_value").join(good.select(*SERIES, "interval_s", "season", "window_s"), SERIES)
    end = F.timestamp_micros(F.unix_micros(now) - F.pmod(F.unix_micros(now), F.col("interval_s") * 1_000_000))
    inside = F.col("window_s").isNull() | ((F.col("observed_at") >= end - F.make_dt_interval(secs=F.col("window_s"))) & (F.col("observed_at") < end))
    segment = training_segment(rows.where(inside), F.col("interval_s"), F.col("season") + F.floor(F.col("season") / 4))
    split = holdout_split(segment, F.col("interval_s"), holdout_s)
    sizes = split.groupBy(*SERIES).agg(F.count_if(~F.col("is_holdout")).alias("rows"), F.count_if("is_holdout").alias("reserved"), F.max("season").alias("season"), F.min(F.when(~F.col("is_holdout"), F.col("observed_at"))).alias("trained_from"), F.max(F.when(~F.col("is_holdout"), F.col("observed_at"))).alias("trained_until"))
    sizes = cut(sizes.withColumn("enough", (F.col("reserved") >= 1) & (F.col("rows") >= F.col("season"))).drop("season"))
    fitted = split.where(~F.col("is_holdout")).join(sizes.where("enough").select(*SERIES), SERIES, "left_semi").select(*SERIES, "observed_at", "observed_value")
    usable = cut(fitted.join(good.select(*SERIES, "engine"), SERIES))
    settings = good.select(*SERIES, "steps", "season", "quantile", "timezone")
    of = lambda e: usable.where(F.col("engine") == e).drop("engine")
    dated = lambda e: of(e).join(good.select(*SERIES, "timezone"), SERIES)
    features = feature_rows(dated("xgboost"), [*PROVIDERS[:-1], lambda x: calendar_features(x, F.col("timezone"))]).join(settings, SERIES)
    trees = learned.train_tree_models(features, F.col("quantile"), F.col("steps"), F.col("season"), ("steps", "season", "quantile", "timezone"))
    clocked = dated("gru").withColumn("clock", scoring.wall_clock(F.col("timezone"))).drop("timezone").join(settings, SERIES)
    networks = learned.train_networks(clocked, F.col("steps"), F.col("quantile"), kind, shape)
    text = F.to_json(F.struct(F.lit("statistical").alias("format"), F.col("engine"), F.lit(season_s).alias("season_s"))).cast("binary")
    plain = usable.where(~F.col("engine").isin("xgboost", "gru")).select(*SERIES, "engine").distinct().select(*SERIES, text.alias("artifact"), F.sha2(text, 256).alias("artifact_sha256"))
    made = reduce(DataFrame.unionByName, [x.select(*SERIES, "artifact", "artifact_sha256") for x in (trees, networks, plain)])
    hyper = F.to_json(F.struct(F.col("contract").alias("evaluation_contract")))
    report = F.to_json(F.struct(F.struct(F.lit("withheld").alias("action"), F.lit("awaiting_evaluation").alias("reason")).alias("promotion"), F.col("rows").alias("sample_count"), F.col("reserved").alias("holdout_sample_count")))
    named = F.coalesce(F.element_at(F.create_map(*[F.lit(x) for kv in SCHEMAS.items() for x in kv]), F.col("engine")), F.lit("v1"))
    digest = evaluate.dataset_fingerprint(usable)
    models = cut(made.join(sizes, SERIES).join(digest, SERIES).join(good, SERIES).select(
        F.sha2(F.concat_ws("|", *SERIES, "engine", "fingerprint", F.unix_micros(now).cast("string")), 256).alias("model_id"), "cluster_id", *SERIES, "engine", F.lit("candidate").alias("status"), now.alias("created_at"), F.lit(None).cast("timestamp").alias("activated_at"),
        "trained_from", "trained_until", "quantile", named.alias("feature_schema"), F.col("fingerprint").alias("dataset_fingerprint"), hyper.alias("hyperparameters"), report.alias("validation_metrics"), "artifact", "artifact_sha256", "rows",
    ))
    done = models.select(*SERIES, "model_id", F.col("rows").alias("dataset_size"))
    reason = F.when(F.col("model_id").isNull(), F.coalesce("fault", F.when(F.col("enough").isNull(), "insufficient_contiguous_history").when(~F.col("enough"), "insufficient_history_after_holdout").otherwise("training_failed")))
    outcomes = asked.select(*SERIES, "fault").join(sizes.select(*SERIES, "enough"), SERIES, "left").join(done, SERIES, "left")
    outcomes = outcomes.withColumns({"status": F.when(F.col("model_id").isNotNull(), "succeeded").otherwise("failed"), "failure_reason": reason}).drop("fault", "enough")
    return models, outcomes


def train_candidates(samples: DataFrame, engine: str, interval_s: int, season: int, steps: int, q: float, now: Column, shape: dict | None = None) -> tuple[DataFrame, DataFrame]:
    """:func:`train_by_contract` with one setting for all series of ``samples``, over all their rows."""
    contracts = samples.select(*SERIES).distinct().select(*SERIES, F.lit(interval_s).alias("interval_s"), F.lit(steps * interval_s).alias("horizon_s"), F.lit(q).alias("quantile"), F.lit("active").alias("status"))
    return train_by_contract(samples, contracts, now, season * interval_s, engine, shape)


def evaluation_reports(
    samples: DataFrame, plan: DataFrame, forecasts: DataFrame, now: Column, interval_s: int, steps: int, history: int, q: float, threshold: float, policy: promote.EvaluationPolicy = promote.EvaluationPolicy()
) -> DataFrame:
    """One report per planned series: action, reason, and the evidence with its digest and metrics, for the commit to decide again.

    ``samples`` has one row per slot; ``plan`` is that of
    ``promote.evaluation_plan``; ``forecasts`` (series, origin, model, upper)
    are of the models 'candidate' (the target), 'baseline', and where there
    are any 'champion' and 'previous', at all rows of ``samples``.
    """
    window = now - F.make_dt_interval(secs=F.lit(policy.window_s))
    afters = plan.where(F.col("reason").isNull()).select(*SERIES, F.greatest("evidence_after", window).alias("after"))
    rows = samples.withColumns({"interval_s": F.lit(interval_s), "steps": F.lit(steps), "quantile": F.lit(q), "threshold": F.lit(threshold)})
    origins = evaluate.paired_origins(rows, interval_s, steps, history, afters=afters, carry=CARRIED)
    facts = samples.groupBy(*SERIES).agg(F.max("observed_at").alias("latest"))
    settings = plan.select(*SERIES, F.lit(interval_s).alias("interval_s"), F.lit(steps).alias("steps"), F.lit(q).alias("q"))
    return _reports(plan, settings, facts, origins, forecasts, now, policy)


#: Settings of a series that go with its origins.
CARRIED = ("interval_s", "steps", "quantile", "threshold")


def _reports(plan: DataFrame, settings: DataFrame, facts: DataFrame, origins: DataFrame, forecasts: DataFrame, now: Column, policy: promote.EvaluationPolicy) -> DataFrame:
    """Reports from a plan: ``settings`` (series, interval_s, steps, q), ``facts`` (series, latest and, where it is known, fault and void), origins and forecasts."""
    status = evaluate.comparison_status(origins, F.col("steps"), F.col("interval_s"), policy.min_windows, policy.min_duration_s).withColumnRenamed("reason", "evidence")
    minutes = F.col("steps") * F.col("interval_s") / 60
    scored = evaluate.compared(origins, forecasts, F.col("quantile"), F.col("threshold"), minutes, policy.max_windows)
    prints = evaluate.comparison_fingerprint(origins, forecasts, policy.max_windows)
    metrics = F.struct(*[F.col(c) for c in METRICS])
    by_model = scored.groupBy(*SERIES).pivot("model", ["candidate", "champion", "baseline", "previous"]).agg(F.first(metrics))
    rows = plan.join(settings, SERIES, "left").join(status, SERIES, "left").join(by_model, SERIES, "left").join(facts, SERIES, "left").join(prints, SERIES, "left")
    q, interval, horizon = F.col("q"), F.col("interval_s"), F.col("steps") * F.col("interval_s")
    age = seconds_between(now, F.col("latest"))
    stale = F.coalesce((age < 0) | (age > 3 * interval), F.lit(True))
    fresh = promote.fresh_evidence(F.col("start"), F.col("end"), now, now, horizon, interval, F.col("fingerprint"), policy)
    # The candidate has its turn if the plan looks at one: its target is not the active model.
    is_candidate = ~F.col("target_id").eqNullSafe(F.col("expected_active_id"))
    verdict = promote.promotion(F.col("candidate"), F.when(is_candidate, F.col("champion")), F.col("baseline"), q, policy)
    back = promote.promotion(F.col("previous"), F.col("candidate"), F.col("baseline"), q, policy.stricter())
    renewed = promote.may_revalidate(F.col("candidate"), F.col("baseline"), q, policy)
    rows = rows.withColumns({"verdict": verdict, "back": back, "renewed": renewed})
    shadow = policy.mode == "shadow"
    told = [c for c in ("fault", "void") if c in facts.columns]
    blocked = F.coalesce(
        F.col("reason"),
        F.when(F.col("target_id").isNull(), "no_model"),
        *[F.col("fault") for c in told if c == "fault"],
        F.when(stale, "stale_source"),
        *[F.col("void") for c in told if c == "void"],
        F.when(F.coalesce(F.col("evidence") != "ok", F.lit(True)), "insufficient_or_invalid_evidence"),
        F.when(~fresh, "evaluation_not_current"),
    )
    returns = F.col("previous").isNotNull() & F.col("previous_id").isNotNull() & F.lit(policy.rollback) & F.col("back.promote")
    action = (
        F.when(blocked.isNotNull(), "withheld")
        .when(is_candidate & F.col("verdict.promote"), "shadow" if shadow else "promote")
        .when(is_candidate, "rejected")
        .when(F.col("renewed"), "revalidated")
        .when(returns, "shadow_rollback" if shadow else "rollback")
        .otherwise("degraded")
    )
    reason = (
        F.when(blocked.isNotNull(), blocked)
        .when(is_candidate, F.col("verdict.reason"))
        .when(F.col("renewed"), "active_revalidation_passed")
        .when(returns, F.col("back.reason"))
        .otherwise("active_revalidation_failed")
    )
    more = [c for c in ("previous_id", "follows_id", "policy_revision", "contract") if c in plan.columns]
    return rows.select(*SERIES, action.alias("action"), reason.alias("reason"), "target_id", "expected_active_id", *more, now.alias("at"), F.col("eligible_windows").alias("windows"), "start", "end", "fingerprint", "candidate", "champion", "baseline", "previous")


def evaluate_models(samples: DataFrame, contracts: DataFrame, models: DataFrame, now: Column, season_s: int, policy: promote.EvaluationPolicy = promote.EvaluationPolicy()) -> DataFrame:
    """One report per active contract, from its stored models scored at held-out origins.

    ``promote.evaluation_plan`` says which models a series compares: the
    target, the champion, the one to go back to, and the seasonal baseline.
    All of them forecast at the same disjoint origins behind everything that
    they have seen, each from what lies before the origin. Interval, horizon,
    quantile, time zone, threshold and training window are the contract's.

    Samples are read from the longest look back before the policy's window on,
    and dealt by series. Origins and forecasts, a few hundred a series, are
    kept in the shared folder, so that inference runs once.

    A value that is negative or not finite, or a repeated time, withholds the
    series, as does a prediction that can't be made. An artifact that can't
    be read is an invalid one; as a champion it gives way to the baseline.
    """
    plan = promote.evaluation_plan(models, contracts, now, season_s, policy)
    open_ = plan.where("reason is null")
    have = set(contracts.columns)
    asked = contracts.where("status = 'active'").select(*SERIES, "threshold", (F.col("training_window_s") if "training_window_s" in have else F.lit(None)).cast("long").alias("window_s"))
    c = lambda name: F.col(f"contract.{name}")
    whole = (c("horizon_s") > 0) & (F.pmod(c("horizon_s"), c("interval_s")) == 0) & (F.pmod(c("season_s"), c("interval_s")) == 0) & (c("season_s") > 0)
    settings = cut(open_.join(asked, SERIES).select(
        *SERIES, c("interval_s").alias("interval_s"), (c("horizon_s") / c("interval_s")).cast("int").alias("steps"), (c("season_s") / c("interval_s")).cast("int").alias("season"), c("quantile").alias("quantile"), c("timezone").alias("timezone"), "threshold", "history",
        F.coalesce("window_s", F.lit(LONGEST_S)).alias("window_s"), F.col("evidence_after").alias("after"), F.coalesce(whole & finite(F.col("threshold").cast("double")) & (F.col("threshold") > 0), F.lit(False)).alias("comparable"),
    ))
    reach = F.greatest("window_s", F.lit(2 * season_s).cast("long"))
    oldest = now - F.make_dt_interval(secs=F.lit(policy.window_s + max(LONGEST_S, 2 * season_s)))
    own = samples.where(F.col("observed_at").between(oldest, now)).select(*SERIES, "observed_at", "observed_value").join(settings, SERIES)
    own = own.where(F.col("observed_at") >= F.col("after") - F.make_dt_interval(secs=reach))
    bad = ~finite(F.col("observed_value")) | (F.col("observed_value") < 0) | F.coalesce(F.col("observed_at") == F.lag("observed_at").over(ordered()), F.lit(False))
    facts = cut(own.withColumn("bad", bad).groupBy(*SERIES).agg(F.max("observed_at").alias("latest"), F.max("bad").alias("bad"), F.first("comparable").alias("comparable")))
    fit = facts.where("comparable and not bad").select(*SERIES)
    slots = slot_dedup(own.join(fit, SERIES, "left_semi"), F.col("interval_s")).drop("slot")
    origins = cut(evaluate.paired_origins(slots, F.col("interval_s"), F.col("steps"), F.col("history"), F.col("after"), carry=CARRIED))
    chosen = evenly(origins, policy.max_windows, SERIES, "origin").select(*SERIES, F.col("origin").alias("observed_at"), F.lit(True).alias("is_origin"))
    roles = {"candidate": "target_id", "champion": "champion_id", "previous": "previous_id"}
    named = F.explode(F.create_map(*[x for role, c_ in roles.items() for x in (F.lit(role), F.col(c_))])).alias("model", "model_id")
    known = open_.select(*SERIES, named).where("model_id is not null").join(models.select(*SERIES, "model_id", "engine", "artifact", "artifact_sha256"), [*SERIES, "model_id"])
    base = settings.select(*SERIES, F.lit("baseline").alias("model"), F.lit("seasonal-baseline").alias("engine"), F.lit(None).cast("binary").alias("artifact"), F.lit(None).cast("string").alias("artifact_sha256"))
    known = known.drop("model_id").unionByName(base)
    treed = known.where("engine = 'xgboost'").select(*SERIES).distinct().withColumn("treed", F.lit(True))
    marked = slots.join(chosen, [*SERIES, "observed_at"], "left").join(treed, SERIES, "left")
    marked = marked.withColumn("segment", slot(F.col("observed_at"), F.col("interval_s")) - F.row_number().over(ordered()))
    marked = marked.withColumns({"is_origin": F.coalesce("is_origin", F.lit(False)), "place": F.row_number().over(ordered()) - 1, "clock": scoring.wall_clock(F.col("timezone")), "window": F.floor(F.col("window_s") / F.col("interval_s"))})
    marked = marked.withColumn("segment_at", F.min("place").over(Window.partitionBy(*SERIES, "segment")))
    rows, names = scoring.with_features(marked, F.col("is_origin") & F.col("treed") & (F.col("place") - F.col("segment_at") >= WARM_UP))
    found = cut(scoring.predict_at(rows, known, names))
    fault = lambda model, kind: F.max(F.coalesce((F.col("model") == model) & (F.col("fault") == kind), F.lit(False)))
    faults = found.groupBy(*SERIES).agg(
        F.when(fault("candidate", scoring.BAD_ARTIFACT), "invalid_artifact").when(fault("previous", scoring.BAD_ARTIFACT), "invalid_rollback_artifact").alias("fault"),
        F.when(F.max(F.coalesce(F.col("fault") == scoring.BAD_PREDICTION, F.lit(False))), "insufficient_or_invalid_evidence").alias("void"),
    )
    void = F.coalesce("void", F.when(~F.col("comparable") | F.col("bad"), "insufficient_or_invalid_evidence"))
    facts = facts.join(faults, SERIES, "left").select(*SERIES, "latest", "fault", void.alias("void"))
    usable = found.where("fault is null").select(*SERIES, "origin", "model", "upper")
    return _reports(plan, settings.select(*SERIES, "interval_s", "steps", F.col("quantile").alias("q")), facts, origins, usable, now, policy)


#: Fixed value: the longest training window, in seconds.
LONGEST_S = 90 * 86_400


def lifecycle(samples: DataFrame, contracts: DataFrame, models: DataFrame, now: Column, season_s: int, policy: promote.EvaluationPolicy = promote.EvaluationPolicy()) -> tuple[DataFrame, DataFrame]:
    """Reports on the stored models, and the models as they are after those that may be written."""
    reports = cut(evaluate_models(samples, contracts, models, now, season_s, policy))
    return reports, promote.committed(models, reports, contracts, now, season_s, policy)
