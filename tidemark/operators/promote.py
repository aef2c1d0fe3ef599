"""Which model may serve: gates, the promotion ladder, revalidation, and the steps around them."""

from __future__ import annotations

from dataclasses import dataclass, replace
from zoneinfo import available_timezones

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tidemark.operators.features import WARM_UP
from tidemark.operators.store import append_audit, latest_per
from tidemark.schema import SERIES, finite

#: Fixed value: slack of all comparisons.
SLACK = 1e-9
#: The rungs of the ladder in their order, and what a candidate is measured against.
INVALID_POLICY, UNSAFE, INCOMPARABLE, REGRESSION = "invalid_policy", "candidate_safety_gate_failed", "incomparable_reference", "underprediction_regression"
EQUIVALENT, NO_GAIN, PASSED = "safe_baseline_equivalent", "insufficient_loss_improvement", "paired_evaluation_passed"
CHAMPION, BASELINE = "active_champion", "deterministic_baseline"
#: Reasons that take a candidate out for good.
TERMINAL = ("incompatible_contract", "candidate_expired", "invalid_artifact", "invalid_training_boundary")


@dataclass(frozen=True)
class EvaluationPolicy:
    mode: str = "automatic"
    window_s: int = 48 * 3600
    min_duration_s: int = 24 * 3600
    min_windows: int = 72
    max_windows: int = 288
    coverage_tolerance: float = 0.03
    minimum_improvement: float = 0.03
    max_relative_underprediction: float = 0.5
    rollback: bool = True

    def __post_init__(self):
        ok = self.mode in ("automatic", "shadow", "off") and self.window_s >= self.min_duration_s > 0 and 2 <= self.min_windows <= self.max_windows
        if not ok or not 0 <= self.coverage_tolerance < 1 or not 0 <= self.minimum_improvement < 1 or not 0 <= self.max_relative_underprediction <= 1:
            raise ValueError("the evaluation policy can't hold")

    def stricter(self) -> EvaluationPolicy:
        """For going back to an earlier model: a tenth better at least."""
        return replace(self, minimum_improvement=max(0.10, self.minimum_improvement))

    @property
    def candidate_expiry_s(self) -> int:
        return max(72 * 3600, self.window_s + self.min_duration_s)


def valid_metrics(m: Column) -> Column:
    share = lambda c: finite(c) & c.between(0, 1)
    return m.isNotNull() & (m["windows"] > 0) & share(m["coverage"]) & share(m["underprediction_rate"]) & finite(m["mean_absolute_error"]) & (m["mean_absolute_error"] >= 0) & finite(m["pinball"]) & (m["pinball"] >= 0)


def safe_metrics(m: Column, q: Column, p: EvaluationPolicy) -> Column:
    held = lambda c: finite(m[c]) & (m[c] >= 0)
    return (
        valid_metrics(m) & (m["windows"] >= p.min_windows) & (m["coverage"] >= q - p.coverage_tolerance) & held("mean_underprediction") & held("max_relative_underprediction")
        & (m["max_relative_underprediction"] <= p.max_relative_underprediction) & held("peak_mean_underprediction") & held("excess_replica_minutes")
    )


def promotion(candidate: Column, champion: Column, baseline: Column, q: Column, p: EvaluationPolicy = EvaluationPolicy()) -> Column:
    """struct(promote, reason, reference): the first rung that a candidate fails, or why it passes.

    Metrics are structs of the nine scores; the reference is the champion, or
    the baseline where there is none (null).
    """
    reference = F.when(champion.isNotNull(), champion).otherwise(baseline)
    name = F.when(champion.isNotNull(), CHAMPION).otherwise(BASELINE)
    worse = lambda c: candidate[c] > reference[c] + SLACK
    not_true = lambda c: ~F.coalesce(c, F.lit(False))
    # One expression says which rung it is; the rest follows from that.
    rung = (
        F.when(not_true(finite(q) & (q > 0) & (q < 1)), INVALID_POLICY)
        .when(not_true(safe_metrics(candidate, q, p)), UNSAFE)
        .when(not_true(valid_metrics(reference) & (reference["windows"] == candidate["windows"])), INCOMPARABLE)
        .when(worse("mean_underprediction") | worse("peak_mean_underprediction") | worse("underprediction_rate"), REGRESSION)
        .when(champion.isNull() & (candidate["pinball"] <= SLACK) & (reference["pinball"] <= SLACK), EQUIVALENT)
        .when(candidate["pinball"] >= reference["pinball"] * (1 - p.minimum_improvement) - SLACK, NO_GAIN)
        .otherwise(PASSED)
    )
    named = F.when(~rung.isin(INVALID_POLICY, UNSAFE, INCOMPARABLE), name)
    return F.struct(rung.isin(EQUIVALENT, PASSED).alias("promote"), rung.alias("reason"), named.alias("reference"))


def may_revalidate(active: Column, baseline: Column, q: Column, p: EvaluationPolicy = EvaluationPolicy()) -> Column:
    """A serving model's validity may be renewed: safe, and no more than a tenth worse than the baseline."""
    ok = (q > 0) & (q < 1) & safe_metrics(active, q, p) & valid_metrics(baseline) & (active["windows"] == baseline["windows"]) & (active["pinball"] <= baseline["pinball"] * 1.1 + SLACK)
    return F.coalesce(ok, F.lit(False))


def fresh_evidence(start: Column, end: Column, at: Column, now: Column, horizon_s: Column, interval_s: Column, fingerprint: Column, p: EvaluationPolicy = EvaluationPolicy()) -> Column:
    """Evidence that a decision may rest on: complete, ending shortly before the report, which is of now."""
    s = lambda a, b: (F.unix_micros(a) - F.unix_micros(b)) / 1_000_000
    ok = (
        (F.coalesce(fingerprint, F.lit("")) != "") & (horizon_s > 0) & (interval_s > 0) & (end <= at) & (s(end, start) >= p.min_duration_s)
        & (s(at, end) <= horizon_s + 3 * interval_s) & (s(now, at) <= 600) & (s(at, now) <= 60)
    )
    return F.coalesce(ok, F.lit(False))


def evaluation_candidates(models: DataFrame, key: list[str] = SERIES) -> DataFrame:
    """One model per series and status: the oldest open candidate, else the newest.

    Candidates count if they are newer than the newest active model and not
    rejected for good; ``validation_metrics`` is JSON with the last report
    under ``promotion``.
    """
    newest = models.where("status = 'active'").groupBy(*key).agg(F.max("created_at").alias("active_at"))
    action = F.coalesce(F.get_json_object("validation_metrics", "$.promotion.action"), F.lit(""))
    reason = F.coalesce(F.get_json_object("validation_metrics", "$.promotion.reason"), F.lit(""))
    rows = models.join(newest, key, "left").withColumn("action", action).withColumn("report_reason", reason)
    later = F.col("created_at") > F.coalesce("active_at", F.timestamp_seconds(F.lit(0)))
    open_ = rows.where((F.col("status") != "candidate") | (later & (F.col("action") != "rejected") & ~F.col("report_reason").isin(*TERMINAL)))
    age = F.unix_micros("created_at")
    ranked = latest_per(open_, [*key, "status"], F.when(F.col("status") == "candidate", age).otherwise(-age), F.col("model_id"))
    return ranked.select(*models.columns)


def model_validity(models: DataFrame) -> DataFrame:
    """Active models with ``valid_from``: the later of their activation and their last validation."""
    validated = F.try_to_timestamp(F.get_json_object("validation_metrics", "$.validated_at"))
    return models.where("status = 'active'").withColumn("valid_from", F.greatest("activated_at", validated))


#: What a model was made for and an evaluation is about. A model without one is from before there were any.
CONTRACT = "struct<version:string,policy_revision:string,horizon_s:bigint,interval_s:bigint,season_s:bigint,quantile:double,timezone:string>"
CONTRACT_VERSION = "1"


def evaluation_contract(season_s: int) -> Column:
    """The contract of a row of declared contracts, for all of its decision horizon."""
    horizon = F.col("horizon_s") + F.coalesce("startup_s", F.lit(0)) + F.coalesce("buffer_s", F.lit(0))
    return F.struct(F.lit(CONTRACT_VERSION).alias("version"), F.col("policy_revision"), horizon.cast("long").alias("horizon_s"), F.col("interval_s").cast("long").alias("interval_s"), F.lit(season_s).cast("long").alias("season_s"), F.col("quantile").cast("double").alias("quantile"), F.col("timezone"))


def comparable_contract(a: Column, b: Column) -> Column:
    """Contracts that may be compared: equal but for the policy revision."""
    blank = lambda c: c.withField("policy_revision", F.lit(""))
    return blank(a).eqNullSafe(blank(b))


def artifact_intact(quantile: Column) -> Column:
    """Whether a model's artifact is what its digest says and, if it names a quantile, made for this one."""
    return _as_written() & _for_quantile(_own_quantile(), quantile)


def _as_written() -> Column:
    return F.coalesce(F.sha2("artifact", 256) == F.col("artifact_sha256"), F.lit(False))


def _own_quantile() -> Column:
    # A cast, as bytes that are no text must not end the query.
    return F.get_json_object(F.col("artifact").cast("string"), "$.quantile").try_cast("double")


def _for_quantile(own: Column, quantile: Column) -> Column:
    return own.isNull() | (F.abs(own - quantile) <= SLACK)


def artifact_lookback() -> Column:
    """Rows that a model's inference looks at, by its engine and artifact; 0 where it looks at all of its history."""
    length = F.get_json_object(F.col("artifact").cast("string"), "$.length").try_cast("int")
    return F.when(F.col("engine") == "xgboost", F.lit(WARM_UP + 1)).when(F.col("engine") == "gru", F.coalesce(length, F.lit(0))).otherwise(F.lit(0))


#: Names of the time zones that a contract may have.
ZONES = sorted(available_timezones())


def evaluation_plan(models: DataFrame, contracts: DataFrame, now: Column, season_s: int, p: EvaluationPolicy = EvaluationPolicy()) -> DataFrame:
    """Per series with an active contract, what its evaluation run looks at, and the ``reason`` where it can't.

    The candidate is the target, unless its last report is newer than the
    active model's: then that one has its turn, so that neither starves the
    other. The champion is the active model if it is of the target's engine,
    intact and made for a comparable contract. An active model may give way to
    ``previous_id``, the model it followed by its own report, if that one is
    retired and was made for the same contract. Evidence begins behind all
    that these models have seen, for a return behind the activation too, and
    no earlier than the policy's window. A policy that is off plans nothing.
    """
    rows = contracts.where("status = 'active'").select(*SERIES, F.col("engine").alias("own_engine"), "policy_revision", evaluation_contract(season_s).alias("contract"))
    if p.mode == "off":
        rows = rows.where("false")
    report = lambda path: F.get_json_object("validation_metrics", f"$.promotion.{path}")
    made_for = F.from_json(F.get_json_object("hyperparameters", "$.evaluation_contract"), CONTRACT)
    # What is asked of an artifact is one row's; the artifacts themselves are not sorted and shuffled.
    light = models.withColumns({"as_written": _as_written(), "own_quantile": _own_quantile(), "lookback": artifact_lookback()}).drop("artifact")
    known = evaluation_candidates(light).join(rows.select(*SERIES, "contract"), SERIES)
    intact = F.col("as_written") & _for_quantile(F.col("own_quantile"), F.col("contract.quantile"))
    known = known.withColumn("facts", F.struct("created_at", "model_id", "trained_until", "engine", "activated_at", made_for.alias("contract"), F.coalesce(F.try_to_timestamp(report("at")), F.timestamp_seconds(F.lit(0))).alias("report_at"), report("previous_id").alias("followed"), intact.alias("intact"), "lookback"))
    newest = lambda status: F.max(F.when(F.col("status") == status, F.col("facts")))
    found = known.groupBy(*SERIES).agg(newest("candidate").alias("candidate"), newest("active").alias("active"), newest("retired").alias("retired"))
    wide = rows.join(found, SERIES, "left")
    waits = F.coalesce(F.col("candidate.report_at") > F.col("active.report_at"), F.lit(False))
    wide = wide.withColumn("candidate", F.when(~waits, F.col("candidate"))).withColumn("target", F.coalesce("candidate", "active"))
    has, serving = F.col("candidate").isNotNull(), F.col("active").isNotNull()
    unversioned = lambda m: F.coalesce(F.col(f"{m}.contract.version"), F.lit("")) == ""
    legacy = ~has & unversioned("target") & (F.col("target.engine") == F.col("own_engine"))
    age = (F.unix_micros(now) - F.unix_micros("candidate.created_at")) / 1_000_000
    champion = has & serving & (F.col("active.engine") == F.col("target.engine")) & (unversioned("active") | comparable_contract(F.col("active.contract"), F.col("contract"))) & F.col("active.intact")
    returns = ~has & serving & F.lit(p.rollback) & F.col("retired.model_id").eqNullSafe(F.col("active.followed")) & F.col("retired").isNotNull() & F.col("retired.contract").eqNullSafe(F.col("contract"))
    # As columns, since each is asked for several times.
    wide = wide.withColumns({"is_champion": F.coalesce(champion, F.lit(False)), "may_return": F.coalesce(returns, F.lit(False))})
    champion, returns = F.col("is_champion"), F.col("may_return")
    reason = (
        F.when(F.col("target").isNull(), "no_model")
        .when(~F.col("target.contract").eqNullSafe(F.col("contract")) & ~legacy, "incompatible_contract")
        .when(F.col("target.trained_until").isNull() | (F.col("target.trained_until") > now), "invalid_training_boundary")
        .when(has & (age > p.candidate_expiry_s), "candidate_expired")
        .when(~F.col("target.intact"), "invalid_artifact")
        .when(returns & ~F.col("retired.intact"), "invalid_rollback_artifact")
        .when(~F.coalesce((F.col("contract.interval_s") > 0) & F.col("contract.timezone").isin(*ZONES), F.lit(False)), "invalid_contract")
    )
    wide, reason = wide.withColumn("reason", reason), F.col("reason")
    action = F.when(reason.isNotNull(), "withheld").when(has, F.lit("shadow" if p.mode == "shadow" else "evaluate_candidate")).otherwise("revalidate")
    both = lambda is_, m: F.when(is_, F.struct(F.col(f"{m}.lookback").alias("lookback"), F.col(f"{m}.engine").alias("engine")))
    compared = F.array_compact(F.array(both(F.col("target").isNotNull(), "target"), both(champion, "active"), both(returns, "retired")))
    # Rows that each origin needs behind it: a season, two where an engine smooths, and what the longest look back takes.
    seasons = F.when(F.exists(compared, lambda m: m["engine"] == "holt-winters"), 2).otherwise(1)
    history = F.greatest(F.array_max(F.transform(compared, lambda m: m["lookback"])), F.try_divide(seasons * F.col("contract.season_s"), F.col("contract.interval_s")).cast("int"))
    after = F.greatest("target.trained_until", F.when(champion, F.col("active.trained_until")), F.when(returns, F.col("retired.trained_until")), F.when(returns, F.col("active.activated_at")), now - F.make_dt_interval(secs=F.lit(p.window_s)))
    return wide.select(
        *SERIES, action.alias("action"), reason.alias("reason"), F.col("target.model_id").alias("target_id"), F.col("active.model_id").alias("expected_active_id"), F.when(champion, F.col("active.model_id")).alias("champion_id"),
        F.when(returns, F.col("retired.model_id")).alias("previous_id"), F.when(reason.isNull(), after).alias("evidence_after"), F.when(has, F.col("active.model_id")).otherwise(F.col("active.followed")).alias("follows_id"), "policy_revision", "contract", history.alias("history"),
    )


def commit_faults(reports: DataFrame, contracts: DataFrame, models: DataFrame, now: Column, season_s: int, p: EvaluationPolicy = EvaluationPolicy()) -> DataFrame:
    """Reports that may not be written, and why: all is decided again from the evidence, as it may have changed since.

    ``reports`` have the plan's target_id, expected_active_id, policy_revision
    and contract, the action, ``at``, the evidence's start, end and
    fingerprint, and the metrics candidate, champion, baseline and previous.
    There are no row locks here: this is checked at the write, by one writer.
    """
    current = contracts.where("status = 'active'").select(*SERIES, F.col("policy_revision").alias("now_revision"), F.col("engine").alias("now_engine"))
    made_for = F.from_json(F.get_json_object("hyperparameters", "$.evaluation_contract"), CONTRACT)
    active = models.where("status = 'active'").groupBy(*SERIES).agg(F.max(F.struct("created_at", "model_id", "trained_until", "activated_at", F.get_json_object("validation_metrics", "$.promotion.previous_id").alias("followed"))).alias("active"))
    target = models.select(*SERIES, F.col("model_id").alias("written_id"), F.struct("status", "engine", "trained_until", made_for.alias("contract")).alias("target"))
    back = F.col("action") == "rollback"
    rows = reports.withColumn("written_id", F.when(back, F.col("previous_id")).otherwise(F.col("target_id"))).join(current, SERIES, "left").join(active, SERIES, "left").join(target, [*SERIES, "written_id"], "left")
    switches, renews = F.col("action").isin("promote", "rollback"), F.col("action") == "revalidated"
    q = F.col("contract.quantile")
    fresh = fresh_evidence(F.col("start"), F.col("end"), F.col("at"), now, F.col("contract.horizon_s"), F.col("contract.interval_s"), F.col("fingerprint"), p)
    behind = lambda t: F.col("start") >= F.coalesce(F.col(t), F.lit("1970-01-01").cast("timestamp"))
    compatible = F.col("target.contract").eqNullSafe(F.col("contract")) & (F.col("contract.policy_revision") == F.col("now_revision")) & F.lit(p.mode == "automatic") & behind("target.trained_until")
    compatible = compatible & (F.col("champion").isNull() | behind("active.trained_until")) & (~back | (behind("active.activated_at") & behind("active.trained_until")))
    verdict = promotion(F.col("candidate"), F.col("champion"), F.col("baseline"), q, p)["promote"]
    returned = promotion(F.col("previous"), F.col("candidate"), F.col("baseline"), q, p.stricter())["promote"]
    renewed = (F.col("target.status") == "active") & (F.col("contract.policy_revision") == F.col("now_revision")) & behind("target.trained_until") & may_revalidate(F.col("candidate"), F.col("baseline"), q, p)
    false_or_null = lambda c: ~F.coalesce(c, F.lit(False))
    fault = (
        F.when(false_or_null(F.col("now_revision") == F.col("policy_revision")), "policy_changed")
        .when(~F.col("active.model_id").eqNullSafe(F.col("expected_active_id")), "active_model_changed")
        .when(false_or_null(F.col("target.engine") == F.col("now_engine")), "unknown_target")
        .when((switches | renews) & ~fresh, "evidence_not_current")
        .when(renews & false_or_null(renewed), "renewal_refused")
        .when(switches & false_or_null(compatible), "incompatible_evidence")
        .when(switches & ~F.when(back, returned).otherwise(verdict), "evidence_refuses")
        .when((F.col("action") == "promote") & (F.col("target.status") != "candidate"), "unexpected_status")
        .when(back & ((F.col("target.status") != "retired") | ~F.lit(p.rollback)), "unexpected_status")
        .when(back & ~F.col("active.followed").eqNullSafe(F.col("written_id")), "not_the_previous_champion")
    )
    return rows.withColumn("fault", fault).where("fault is not null").select(*SERIES, "target_id", "fault")


def switched(models: DataFrame, reports: DataFrame, now: Column) -> DataFrame:
    """Models after reports that passed: the target (of a return, the previous model) active, the series' active one retired."""
    winner = F.when(F.col("action") == "rollback", F.col("previous_id")).otherwise(F.col("target_id"))
    r = reports.where(F.col("action").isin("promote", "rollback")).select(*SERIES, winner.alias("winner_id"))
    rows = models.join(r, SERIES, "left")
    wins = F.col("winner_id") == F.col("model_id")
    loses = F.col("winner_id").isNotNull() & ~F.coalesce(wins, F.lit(False)) & (F.col("status") == "active")
    return rows.withColumn("activated_at", F.when(wins, now).otherwise(F.col("activated_at"))).withColumn("status", F.when(wins, "active").when(loses, "retired").otherwise(F.col("status"))).select(*models.columns)


def committed(models: DataFrame, reports: DataFrame, contracts: DataFrame, now: Column, season_s: int, p: EvaluationPolicy = EvaluationPolicy()) -> DataFrame:
    """Models after the reports that may be written: switched, and each report on its model."""
    refused = commit_faults(reports, contracts, models, now, season_s, p).select(*SERIES)
    passed = reports.where(F.col("target_id").isNotNull()).join(refused, SERIES, "left_anti")
    return audited(switched(models, passed, now), passed)


def audited(models: DataFrame, reports: DataFrame, kept: int = 20) -> DataFrame:
    """Models whose ``validation_metrics`` hold the report written on them, behind the last ones of its ``history``.

    A report keeps the link to the model that its target followed. A renewal
    or a switch makes its time the model's validation.
    """
    back = F.col("action") == "rollback"
    follows = F.when(F.col("action") == "promote", F.col("expected_active_id")).when(back, F.col("expected_active_id")).otherwise(F.col("follows_id"))
    entry = F.to_json(F.struct("action", "reason", F.date_format("at", "yyyy-MM-dd'T'HH:mm:ss.SSSSSS'Z'").alias("at"), follows.alias("previous_id")))
    renewed = F.when(F.col("action").isin("promote", "rollback", "revalidated"), F.date_format("at", "yyyy-MM-dd'T'HH:mm:ss.SSSSSS'Z'"))
    own = reports.select(*SERIES, F.when(back, F.col("previous_id")).otherwise(F.col("target_id")).alias("model_id"), entry.alias("entry"), renewed.alias("renewed"))
    rows = models.join(own, [*SERIES, "model_id"], "left")
    before = F.from_json(F.get_json_object("validation_metrics", "$.history"), "array<string>")
    validated = F.coalesce("renewed", F.get_json_object("validation_metrics", "$.validated_at"))
    parts = F.array(F.concat(F.lit('"promotion":'), F.col("entry")), F.concat(F.lit('"history":['), F.array_join(append_audit(before, F.col("entry"), kept), ","), F.lit("]")), F.concat(F.lit('"validated_at":"'), validated, F.lit('"')))
    text = F.concat(F.lit("{"), F.array_join(F.array_compact(parts), ","), F.lit("}"))
    return rows.withColumn("validation_metrics", F.when(F.col("entry").isNotNull(), text).otherwise(F.col("validation_metrics"))).select(*models.columns)
