"""Report plans over run-log DataFrames (column names of the run-log kinds).

REP0a-d are the four SQL queries (totals, summary, idle rows, parallel
batches); REP1-5 are the ranked report tables with display cells; REP6 is the
per-section status.

A report's state comes from its gate (is there a row to show, did any fail). A built
report takes it as observed metrics of the pass that writes its sorted rows: no job of
its own. A report that has no input or is withheld returns an empty table with the same
columns. For the status table without reports, ``gate_*`` are one aggregate each.
"""

from __future__ import annotations

from typing import NamedTuple

from pyspark.sql import Column, DataFrame, Observation, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from runlens.functions.checks import all_clean
from runlens.functions.labels import (CHECK, CROSS, DASH, emphasise_nonzero, tristate_label,
                                      value_label)
from runlens.functions.numeric import dround, measure, num_text, to_seconds
from runlens.functions.text import error_reason
from runlens.operators import dims
from runlens.operators.batches import batch_summary as _batch_summary
from runlens.operators.latest import latest_per_key, latest_with_fallback
from runlens.operators.order import captcha_order, enum_rank, survivor_key, with_position
from runlens.operators.stats import (METRIC_ORDER, STAGES, complete_rows, stage_summary,
                                     stage_totals)

OK, NO_INPUT, HAS_ERRORS = "ok", "no_input", "has_errors"
# Stealth modes shown, tier threshold on the reCAPTCHA score.
STEALTH_MODES = ["default", "stealth"]
SCORE_THRESHOLD = 0.3


class Report(NamedTuple):
    df: DataFrame
    state: str
    n_rows: int = 0


class Gate(NamedTuple):
    """Rows the report would show, and its state."""
    n_rows: int
    state: str


def _measures(n: Column, failed: Column | None = None) -> list[Column]:
    """``n`` (an aggregate) and whether ``failed`` (a predicate) holds anywhere."""
    any_failed = F.max(F.lit(False)) if failed is None else F.coalesce(F.bool_or(failed), F.lit(False))
    return [n.alias("n"), F.coalesce(any_failed, F.lit(False)).alias("failed")]


def _as_gate(n: int | None, failed: bool) -> Gate:
    rows = int(n or 0)
    return Gate(rows, NO_INPUT if not rows else HAS_ERRORS if failed else OK)


def _gate(df: DataFrame, n: Column, failed: Column | None = None) -> Gate:
    r = df.agg(*_measures(n, failed)).first()
    return _as_gate(r["n"], r["failed"])


def _ranked(df: DataFrame, order: list[Column | str], name: str, failed: Column | None = None) -> tuple[DataFrame, Gate]:
    """``df`` with its rows' positions, and the gate over these rows, in one pass."""
    seen = Observation()
    out = with_position(df, order, name, watch=(seen, _measures(F.count(F.lit(1)), failed)))
    return out, _as_gate(seen.get["n"], seen.get["failed"])


def _withheld(df: DataFrame, state: str) -> Report:
    return Report(df.limit(0), state, 0)


def _not_true(c: str) -> Column:
    return ~F.coalesce(F.col(c), F.lit(False))


def _count_keys(df: DataFrame, keys: list[str]) -> DataFrame:
    return df.groupBy(*keys).agg(F.lit(1).alias("one"))


def gate_lifecycle(runs: DataFrame, stages: list[str] = STAGES) -> Gate:
    """Providers with a complete successful run."""
    ok = complete_rows(runs, ["provider"] + stages[:3]).where(F.col("success") == F.lit(True))
    return _gate(_count_keys(ok, ["provider"]), F.count(F.lit(1)))


def gate_idle(idle: DataFrame) -> Gate:
    return _gate(idle, F.count(F.lit(1)), _not_true("success"))


def gate_stealth(stealth: DataFrame) -> Gate:
    """Provider x shown mode pairs with a known outcome."""
    rows = stealth.where(F.col("mode").isin(STEALTH_MODES) & F.col("success").isNotNull())
    return _gate(_count_keys(rows, ["provider", "mode"]), F.count(F.lit(1)))


def gate_captcha(captcha: DataFrame, tie: list[str] | None = None) -> Gate:
    """Providers; an error if a provider's latest record failed."""
    tie = TIES["captcha"] if tie is None else tie
    latest = latest_per_key(captcha.select("provider", "created_at", "success", *_other(tie)),
                            ["provider"], "created_at", tie)
    return _gate(latest, F.count(F.lit(1)), _not_true("success"))


def gate_parallel(batches: DataFrame) -> Gate:
    return _gate(_count_keys(batches, ["provider", "sequential_mode", "concurrency"]), F.count(F.lit(1)))


# Tie-breaks after created_at, in the columns of each record kind: rows that
# agree in all of them show the same cells.
TIES = {
    "idle": ["created_at", "session_id", "total_ms", "step1_ms", "step2_ms", "reconnect_ms"],
    "stealth": ["success", "total_ms", "recaptcha_score", "sannysoft_webdriver_detected",
                "sannysoft_headless_detected", "areyouheadless_detected", "error_message"],
    "captcha": ["success", "total_ms", "solve_ms", "supported", "captcha_detected", "captcha_solved"],
}


def _other(tie: list[str]) -> list[str]:
    return [t for t in tie if t not in ("provider", "created_at", "success")]


# ---- REP0a-d: the SQL queries ----------------------------------------------

def totals(runs: DataFrame) -> DataFrame:
    """REP0a: per provider runs, avg/median total, avg per stage (successes),
    fastest first."""
    out = stage_totals(runs, ["provider"], STAGES, "success", 0)
    return out.orderBy(F.col("avg_total_ms").asc_nulls_last(), F.col("provider").asc_nulls_last())


def summary(runs: DataFrame) -> DataFrame:
    """REP0b: provider x metric statistics with success rate, in metric order."""
    out = stage_summary(runs, ["provider"], STAGES, "success", 0)
    return out.orderBy(F.col("provider").asc_nulls_last(), enum_rank("metric", METRIC_ORDER))


def idle_rows(idle: DataFrame, tie: list[str] | None = None) -> DataFrame:
    """REP0c: one cleaned row per idle run, by provider, then ``tie`` (the record's
    own columns, so that a provider's rows spread over the sort's ranges)."""
    tie = TIES["idle"] if tie is None else tie
    ms = lambda c: dround(measure(idle, c), 0)
    return (idle.orderBy(F.col("provider").asc_nulls_last(), *[F.col(t).asc_nulls_last() for t in tie]).select(
        "provider", "success", "session_survived",
        ms("step1_ms").alias("step1_ms"),
        to_seconds(measure(idle, "idle_ms"), 1).alias("idle_actual_s"),
        ms("reconnect_ms").alias("reconnect_ms"),
        ms("step2_ms").alias("step2_ms"),
        ms("session_release_ms").alias("release_ms"),
        to_seconds(measure(idle, "total_ms"), 1).alias("total_s"),
        "step2_title", "error_stage", "error_message"))


def parallel_summary(batches: DataFrame) -> DataFrame:
    """REP0d: batches per (provider, mode, concurrency), fastest first."""
    return _batch_summary(batches).orderBy(
        F.col("avg_parallel_ms").asc_nulls_last(), "provider", "sequential_mode", "max_sessions")


# ---- REP1: lifecycle ranking --------------------------------------------------

def report_lifecycle(runs: DataFrame, pricing: dict = dims.LIFECYCLE_PRICING,
                     stages: list[str] = STAGES) -> Report:
    """Rank providers by average total of complete successful runs (provider and
    the first three stages present; the release stage may be missing)."""
    complete = complete_rows(runs, ["provider"] + stages[:3])
    tot = stage_totals(complete, ["provider"], stages, "success", 0)
    ranked, gate = _ranked(tot, [F.col("avg_total_ms").asc_nulls_last(),
                                 F.col("provider").asc_nulls_last()], "rank")
    return Report(_lifecycle_cells(ranked, pricing), gate.state, gate.n_rows)


def _lifecycle_cells(df: DataFrame, pricing: dict) -> DataFrame:
    ms = lambda c: value_label(c, "ms", 0)
    return df.select(
        "rank", "provider",
        ms("avg_total_ms").alias("avg_total"), ms("median_total_ms").alias("median_total"),
        ms("avg_create_ms").alias("avg_create"), ms("avg_connect_ms").alias("avg_connect"),
        ms("avg_goto_ms").alias("avg_goto"), ms("avg_release_ms").alias("avg_release"),
        dims.lookup("provider", pricing, DASH).alias("pricing"))


# ---- REP2: idle survival ------------------------------------------------------

def report_idle(idle: DataFrame, cost: dict = dims.IDLE_COST, cost_rank: dict = dims.IDLE_COST_RANK,
                tie: list[str] | None = None) -> Report:
    """One line per idle record; withheld when any record failed.

    Order: survivors first, then cost rank (unknown 99), then provider, then
    ``tie`` (the report keeps SQL order for ties; the tie-break makes it
    deterministic).
    """
    tie = TIES["idle"] if tie is None else tie
    keyed = idle.select(
        "provider", "session_survived", "success",
        *[dround(measure(idle, c), 0).alias(f"_{c}") for c in ("step1_ms", "reconnect_ms", "step2_ms")],
        to_seconds(measure(idle, "total_ms"), 1).alias("_total_s"),
        *[F.col(t).alias(f"_t{i}") for i, t in enumerate(tie)],
        survivor_key("session_survived").alias("_surv"),
        dims.lookup("provider", cost_rank, dims.DEFAULT_RANK).alias("_cost"))
    ranked, gate = _ranked(keyed, ["_surv", "_cost", F.col("provider").asc_nulls_last(),
                                   *[F.col(f"_t{i}").asc_nulls_last() for i in range(len(tie))]],
                           "rank", _not_true("success"))
    rows = ranked.select("rank", "provider", "session_survived", "success", F.col("_step1_ms").alias("step1_ms"),
                         F.col("_reconnect_ms").alias("reconnect_ms"), F.col("_step2_ms").alias("step2_ms"),
                         F.col("_total_s").alias("total_s"))
    if gate.state != OK:
        return _withheld(_idle_cells(rows, cost), gate.state)
    return Report(_idle_cells(rows, cost), OK, gate.n_rows)


def _idle_cells(df: DataFrame, cost: dict) -> DataFrame:
    return df.select(
        "rank", "provider",
        tristate_label("session_survived", CHECK, f"{CROSS} reconnected").alias("survived_idle"),
        value_label("step1_ms", "ms", 0).alias("step1"),
        value_label("step2_ms", "ms", 0).alias("step2"),
        value_label("reconnect_ms", "ms", 0).alias("reconnect"),
        value_label("total_s", "s", 1).alias("total"),
        dims.lookup("provider", cost, DASH).alias("cost"))


# ---- REP3: stealth matrix -----------------------------------------------------

def report_stealth(stealth: DataFrame, plan: dict = dims.STEALTH_PLAN,
                   tie: list[str] | None = None) -> Report:
    """Latest success (else latest failure) per provider x mode, providers in
    tier order (0 clean + score >= 0.3, 1 clean, 2 fixed by stealth, 3 none)."""
    tie = TIES["stealth"] if tie is None else tie
    rows = stealth.where(F.col("mode").isin(STEALTH_MODES))
    tiered = _tiered(latest_with_fallback(rows, ["provider", "mode"], "success", "created_at", tie))
    ranked, gate = _ranked(tiered, ["tier", F.col("provider").asc_nulls_last(),
                                    enum_rank("mode", STEALTH_MODES)], "position")
    return Report(_stealth_cells(ranked, plan), gate.state, gate.n_rows)


def _tiered(chosen: DataFrame) -> DataFrame:
    clean = all_clean("sannysoft_webdriver_detected", "sannysoft_headless_detected",
                      "areyouheadless_detected")
    ok = F.col("success") == F.lit(True)
    is_default = ok & (F.col("mode") == "default")
    by_provider = Window.partitionBy("provider")  # at most two rows per provider
    has_default = F.max(F.when(is_default, F.lit(True))).over(by_provider)
    default_clean = F.max(F.when(is_default, clean)).over(by_provider)
    default_score = F.max(F.when(is_default, F.col("recaptcha_score"))).over(by_provider)
    has_stealth = F.max(F.when(ok & (F.col("mode") == "stealth"), F.lit(True))).over(by_provider)
    tier = (F.when(has_default.isNull(), 3)
            .when(~default_clean, F.when(has_stealth, 2).otherwise(3))
            .when(F.coalesce(default_score, F.lit(0.0)) >= SCORE_THRESHOLD, 0)
            .otherwise(1))
    return chosen.withColumn("tier", tier).withColumn("_clean", clean)


def _stealth_cells(df: DataFrame, plan: dict) -> DataFrame:
    failed = ~F.coalesce(F.col("success"), F.lit(False))
    flag = lambda c: F.when(failed, F.lit(DASH)).otherwise(tristate_label(c, "Detected", "Clean"))
    score = F.when(F.col("recaptcha_score").isNull(), F.lit(DASH)) \
             .otherwise(num_text("recaptcha_score", 6))
    return df.select(
        "position", "provider", "mode", "tier",
        F.when(failed, F.lit(f"{CROSS} plan gate"))
         .when(F.col("_clean"), F.lit(CHECK)).otherwise(F.lit(CROSS)).alias("pass"),
        flag("sannysoft_webdriver_detected").alias("webdriver"),
        flag("sannysoft_headless_detected").alias("headless_ua"),
        flag("areyouheadless_detected").alias("areyouheadless"),
        F.when(failed, F.lit(DASH)).otherwise(score).alias("recaptcha_score"),
        F.when(failed, error_reason("error_message"))
         .otherwise(dims.lookup("provider", plan, DASH)).alias("stealth_plan"))


# ---- REP4: captcha --------------------------------------------------------------

def report_captcha(captcha: DataFrame, cost: dict = dims.CAPTCHA_COST,
                   plan_order: dict = dims.CAPTCHA_PLAN_ORDER,
                   tie: list[str] | None = None) -> Report:
    """Latest record per provider; withheld when any latest record failed.

    Supported first; unsupported by plan order; supported by solve time with a
    missing time read as 0; ties keep (supported, solve time NULLS LAST, provider).
    """
    tie = TIES["captcha"] if tie is None else tie
    latest = latest_per_key(captcha, ["provider"], "created_at", tie) \
        .withColumn("solve_s", to_seconds(measure(captcha, "solve_ms"), 1))
    plan_rank = dims.lookup("provider", plan_order, dims.DEFAULT_RANK)
    ranked, gate = _ranked(latest, captcha_order("supported", "solve_s", plan_rank, "provider"), "position",
                           _not_true("success"))
    if gate.state != OK:
        return _withheld(_captcha_cells(ranked, cost), gate.state)
    return Report(_captcha_cells(ranked, cost), OK, gate.n_rows)


def _captcha_cells(df: DataFrame, cost: dict) -> DataFrame:
    mark = lambda c: tristate_label(c, CHECK, CROSS)
    solve = F.when(F.col("solve_s").isNotNull(), F.concat(num_text("solve_s", 1), F.lit("s"))) \
             .when(F.coalesce(F.col("supported"), F.lit(False)), F.lit("timeout")) \
             .otherwise(F.lit(DASH))
    return df.select(
        "position", "provider", mark("supported").alias("free_tier"),
        mark("captcha_detected").alias("detected"), mark("captcha_solved").alias("solved"),
        solve.alias("solve_time"), dims.lookup("provider", cost, DASH).alias("cost_per_solve"))


# ---- REP5: parallel ----------------------------------------------------------------

def report_parallel(batches: DataFrame, limits: dict = dims.CONCURRENCY_LIMIT_TEXT) -> Report:
    """Rank (provider, mode, concurrency) groups: parallel first, then overhead ratio."""
    agg = batches.groupBy("provider", "sequential_mode", "concurrency").agg(
        F.count(F.lit(1)).alias("runs"),
        dround(F.avg(measure(batches, "sessions_succeeded")), 1).alias("avg_succeeded"),
        dround(F.avg(measure(batches, "total_parallel_ms")), 0).alias("avg_parallel_ms"),
        # whole ten-thousandths: the mean is the same in any order of summing
        dround(F.avg(F.round(measure(batches, "overhead_ratio") * 10000, 0)) / 10000, 4).alias("avg_overhead_ratio"),
        F.sum(F.when(F.col("success"), 0).otherwise(1)).cast("long").alias("failed_batches"))
    ranked, gate = _ranked(agg, [F.col("sequential_mode").asc_nulls_last(),
                                 F.col("avg_overhead_ratio").asc_nulls_last(),
                                 F.col("provider").asc_nulls_last(),
                                 F.col("concurrency").asc_nulls_last()], "rank")
    return Report(_parallel_cells(ranked, limits), gate.state, gate.n_rows)


def _parallel_cells(df: DataFrame, limits: dict) -> DataFrame:
    seq = F.coalesce(F.col("sequential_mode"), F.lit(False))
    return df.select(
        "rank", "provider",
        F.when(seq, F.lit(f"{CROSS} sequential")).otherwise(F.lit(CHECK)).alias("true_parallel"),
        F.when(F.col("avg_overhead_ratio").isNull(), F.lit(DASH))
         .otherwise(num_text("avg_overhead_ratio", 4)).alias("overhead_ratio"),
        F.concat(F.coalesce(num_text("avg_succeeded", 1), F.lit(DASH)), F.lit(" / "),
                 F.coalesce(F.col("concurrency").cast("string"), F.lit(DASH))).alias("sessions_succeeded"),
        emphasise_nonzero("failed_batches").alias("failed_batches"),
        dims.lookup("provider", limits, DASH).alias("free_tier_concurrency"))


# ---- REP6: status ------------------------------------------------------------------

STATUS_SCHEMA = T.StructType([
    T.StructField("section", T.StringType()), T.StructField("n_rows", T.LongType()),
    T.StructField("state", T.StringType()), T.StructField("bad_lines", T.LongType())])


def report_status(spark: SparkSession, gates: dict[str, Gate | Report],
                  bad_lines: dict[str, int] | None = None) -> DataFrame:
    """section, n_rows, state (ok / no_input / has_errors) and unreadable input
    lines per report. Gates (or built reports) supply the counts: no further pass."""
    bad = bad_lines or {}
    rows = [(name, g.n_rows if g.state == OK else 0, g.state, bad.get(name, 0)) for name, g in gates.items()]
    return spark.createDataFrame(rows, STATUS_SCHEMA)
