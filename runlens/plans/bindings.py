"""The library's operators bound to the driver's test tables.

The test tables hold no run logs, so each generic operator runs on a stand-in
built from them (the bindings below only rename and derive columns; the
operator under test does the work):

  runs     lineitem: provider = l_returnflag, success = (l_linestatus = 'F'),
           stages l_quantity, l_extendedprice, l_discount, l_tax with a zero
           discount / tax read as a missing stage;
  log      events: provider-like keys event_type / user_id, created_at = ts,
           tie-break event_id, success = (value < 35);
  batches  orders with their lineitem rows as sessions (ms = l_quantity,
           ok = l_linestatus = 'F', wall time = o_totalprice);
  captures documents.text, conversations.text, pages.html.

Every callable takes (spark, sf_dir) and reads whole tables. Column names and
types match the SQL in ``runlens.plans.oracle``.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from runlens.functions import (all_clean, any_phrase, check_detected, check_lookup,
                               check_verdict, dround, duration_ms, error_reason, iso_date,
                               iso_text, page_title, parse_checks, phrase_class,
                               rate_limited, row_total, safe_double, score_at_least,
                               score_extract, shortfall, split_clean, stealth_flags, to_seconds,
                               tristate_label, truncate_text, value_label)
from runlens.operators import dims
from runlens.operators.batches import (batch_summary, combine_rollups, fill_empty_batches,
                                       overhead_ratio, rollup_nested, rollup_rows)
from runlens.operators.latest import (any_failure, distinct_keys, latest_per_key,
                                      latest_with_fallback, sibling_values)
from runlens.operators.order import captcha_order, enum_rank, snapshot, survivor_key, with_position
from runlens.operators.stats import (STAGES, TOTAL, complete_rows, run_tally, stage_summary,
                                     stage_totals, stats_with_rate, success_rate,
                                     unpivot_stages)
from runlens.plans import reports
from runlens.session import scratch_path
from runlens.sources.quarantine import ingest_logs, quarantined, replay
from runlens.sources.runlogs import scan_json, scan_runs
from runlens.sources.sinks import append_runs, read_converted, replace_slice, to_json_text, write_report

RUN_STAGES = ["l_quantity", "l_extendedprice", "l_discount", "l_tax"]
METRICS = RUN_STAGES + [TOTAL]
# rounding of hash-compared doubles: a place where ties of 2-place inputs cannot fall
P = 4


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir.rstrip('/')}/{name}.parquet")


# ---- stand-ins --------------------------------------------------------------------

def runs(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "lineitem").select(
        F.col("l_returnflag").alias("provider"),
        (F.col("l_linestatus") == "F").alias("success"),
        "l_orderkey", "l_linenumber", "l_quantity", "l_extendedprice",
        F.nullif("l_discount", F.lit(0.0)).alias("l_discount"),
        F.nullif("l_tax", F.lit(0.0)).alias("l_tax"))


def log(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "events").select(
        "event_id", F.col("ts").alias("created_at"), "user_id", "event_type", "value", "props",
        (F.col("value") < 35).alias("success"))


def _k(props: str = "props") -> Column:
    return F.get_json_object(F.col(props), "$.k").cast("int")


def sessions(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "lineitem").select(
        F.col("l_orderkey").alias("batch_id"), "l_linenumber", "l_partkey", "l_suppkey",
        F.col("l_quantity").alias("session_total_ms"),
        (F.col("l_linestatus") == "F").alias("success"))


def batches(spark: SparkSession, d: str) -> DataFrame:
    """Orders LEFT JOIN their session rollup (flat form); empty batches filled."""
    roll = rollup_rows(sessions(spark, d), ["batch_id"])
    orders = table(spark, d, "orders")
    joined = orders.join(roll, orders["o_orderkey"] == roll["batch_id"], "left").drop("batch_id")
    return fill_empty_batches(joined, T.DoubleType())


# sessions that go into nested records together: a record holds at most as many
SESSIONS_PER_RECORD = 8


def nested_batches(spark: SparkSession, d: str) -> DataFrame:
    """Orders with their sessions as array<struct> records (the nested record
    shape of a parallel batch). Sessions are dealt in runs of
    ``SESSIONS_PER_RECORD`` as they are read, so a batch is split over records
    and no array grows with it; an order without sessions is one record with a
    NULL array."""
    part = F.expr(f"monotonically_increasing_id() div {SESSIONS_PER_RECORD}")
    records = (sessions(spark, d).withColumn("part", part)
               .groupBy("batch_id", "part").agg(F.collect_list(F.struct(
                   F.col("l_linenumber").alias("session_index"), "session_total_ms", "success"))
                   .alias("sessions")))
    orders = table(spark, d, "orders")
    return orders.join(records, orders["o_orderkey"] == records["batch_id"], "left").drop("batch_id")


def _batch_frame(spark: SparkSession, d: str, concurrency: Column) -> DataFrame:
    b = batches(spark, d)
    return b.select(
        "o_orderkey", F.col("o_orderpriority").alias("provider"),
        (F.col("o_orderstatus") == "P").alias("sequential_mode"),
        concurrency.alias("concurrency"),
        "sessions_succeeded", "sequential_equivalent_ms",
        F.col("o_totalprice").alias("total_parallel_ms"),
        overhead_ratio("o_totalprice", "sequential_equivalent_ms").alias("overhead_ratio"),
        "success")


def idle(spark: SparkSession, d: str, all_ok: bool = False) -> DataFrame:
    e = log(spark, d)
    v = F.col("value")
    survived = F.when(v > 100, F.lit(None).cast("boolean")).otherwise(v < 35)
    ok = v.isNotNull() if all_ok else (v < 35)
    return e.select(
        "event_id", "created_at", F.col("event_type").alias("provider"),
        ok.alias("success"), survived.alias("session_survived"),
        F.floor(v * 100).cast("long").alias("step1_ms"),
        F.floor(v * 1000).cast("long").alias("idle_ms"),
        F.when(~survived, F.floor(v * 10)).cast("long").alias("reconnect_ms"),
        (F.col("event_id") % 1000).alias("step2_ms"),
        F.col("event_type").alias("step2_title"),
        F.when(v > 300, F.lit(None)).otherwise(F.col("event_id") % 500).cast("long")
         .alias("session_release_ms"),
        (F.floor(v * 1000).cast("long") + F.col("event_id") % 1000).alias("total_ms"),
        F.when(~ok, F.lit("step2")).alias("error_stage"),
        F.when(~ok, F.concat(F.lit("Error: slow "), F.col("event_id").cast("string")))
         .alias("error_message"))


STEALTH_MODE_OF = {"click": "default", "view": "stealth"}


def stealth(spark: SparkSession, d: str) -> DataFrame:
    e = log(spark, d)
    k = _k()
    mode = F.coalesce(dims.lookup("event_type", STEALTH_MODE_OF), F.lit("other"))
    ok = F.col("value") < 60
    return e.select(
        "event_id", "created_at", F.col("user_id").cast("string").alias("provider"),
        mode.alias("mode"), ok.alias("success"),
        F.when(k % 7 == 0, F.lit(None).cast("boolean")).otherwise(k % 2 == 0)
         .alias("sannysoft_webdriver_detected"),
        (k % 3 == 0).alias("sannysoft_headless_detected"),
        (k % 5 == 0).alias("areyouheadless_detected"),
        (k / F.lit(100.0)).alias("recaptcha_score"),
        F.when(~ok, F.concat(F.lit("Error: blocked "), F.col("event_id").cast("string"),
                             F.lit("\n    at step"))).alias("error_message"))


CAPTCHA_UNSUPPORTED_TYPES = ["error", "signup"]


def captcha(spark: SparkSession, d: str, all_ok: bool = True) -> DataFrame:
    e = log(spark, d)
    v = F.col("value")
    sup = ~F.col("event_type").isin(CAPTCHA_UNSUPPORTED_TYPES)
    return e.select(
        "event_id", "created_at", "user_id", F.col("user_id").cast("string").alias("provider"),
        "event_type", sup.alias("supported"),
        F.when(sup, v > 5).alias("captcha_detected"),
        F.when(sup, v > 10).alias("captcha_solved"),
        F.when(sup & (v >= 10), v * F.lit(1000.0)).alias("solve_ms"),
        (v.isNotNull() if all_ok else v < 35).alias("success"))


# ---- scans and sinks ----------------------------------------------------------------

EVENT_JSON = T.StructType([
    T.StructField("event_id", T.LongType()), T.StructField("ts", T.TimestampNTZType()),
    T.StructField("user_id", T.LongType()), T.StructField("event_type", T.StringType()),
    T.StructField("value", T.DoubleType()), T.StructField("props", T.StringType())])

BATCH_JSON = T.StructType([
    T.StructField("o_orderkey", T.LongType()), T.StructField("o_orderpriority", T.StringType()),
    T.StructField("part", T.LongType()),
    T.StructField("sessions", T.ArrayType(T.StructType([
        T.StructField("session_index", T.IntegerType()),
        T.StructField("session_total_ms", T.DoubleType()),
        T.StructField("success", T.BooleanType())])))])


def q_json_scan(spark, d):
    path = scratch_path(spark, "events-json")
    table(spark, d, "events").write.mode("overwrite").json(path)
    ev = scan_json(spark, path, EVENT_JSON)
    return ev.groupBy("event_type").agg(
        F.count(F.lit(1)).alias("n_rows"), dround(F.sum("value"), P).alias("total_value"),
        F.min("event_id").alias("first_event_id"), F.max("event_id").alias("last_event_id"))


def q_json_nested_scan(spark, d):
    path = scratch_path(spark, "batches-json")
    nested_batches(spark, d).select("o_orderkey", "o_orderpriority", "part", "sessions") \
        .write.mode("overwrite").json(path)
    b = scan_json(spark, path, BATCH_JSON)
    arr = F.coalesce(F.col("sessions"), F.array().cast(BATCH_JSON["sessions"].dataType))
    per_batch = b.groupBy("o_orderpriority", "o_orderkey").agg(
        F.sum(F.size(arr)).cast("long").alias("n"),
        F.sum(F.aggregate(arr, F.lit(0.0),
                          lambda acc, s: acc + F.coalesce(s["session_total_ms"], F.lit(0.0)))).alias("s"))
    return per_batch.groupBy("o_orderpriority").agg(
        F.count(F.lit(1)).alias("n_batches"), F.sum("n").cast("long").alias("n_sessions"),
        dround(F.sum("s"), P).alias("total_session_ms"))


def q_json_roundtrip(spark, d):
    v = F.when(F.col("value") > 300, F.lit(None).cast("double")).otherwise(F.col("value"))
    ev = table(spark, d, "events").select("event_id", "event_type", v.alias("value"))
    text = to_json_text(ev)
    back = text.select(F.from_json("json", "event_id BIGINT, event_type STRING, value DOUBLE").alias("r"),
                       F.col("json").contains('"value":null').alias("null_kept"))
    return back.select("r.event_id", "r.event_type", "r.value", "null_kept")


# ---- projections and predicates -----------------------------------------------------

def q_safe_cast(spark, d):
    ev = table(spark, d, "events")
    return ev.select("event_id",
                     safe_double(F.get_json_object("props", "$.k")).alias("k_value"),
                     safe_double("event_type").alias("type_value"))


def _row_ids(df):
    return [df["l_orderkey"], df["l_linenumber"]]


def q_row_total_strict(spark, d):
    r = runs(spark, d)
    return r.select(*_row_ids(r), dround(row_total(RUN_STAGES, strict=True), P).alias("total"))


def q_row_total_lenient(spark, d):
    r = runs(spark, d)
    return r.select(*_row_ids(r), dround(row_total(RUN_STAGES, strict=False), P).alias("total"))


SHORTFALL_FLOOR = 30000.0


def q_shortfall(spark, d):
    r = runs(spark, d)
    return r.select(*_row_ids(r), dround(shortfall(row_total(RUN_STAGES, strict=False),
                                                   SHORTFALL_FLOOR), P).alias("shortfall"))


def q_unit_convert(spark, d):
    li = table(spark, d, "lineitem")
    return li.select(*_row_ids(li), to_seconds("l_extendedprice", 1).alias("price_s"))


def q_complete_rows(spark, d):
    return complete_rows(runs(spark, d), ["provider", "l_quantity", "l_extendedprice", "l_discount"])


def _flags(r: DataFrame) -> DataFrame:
    return r.select(*_row_ids(r),
                    (F.col("l_discount") > 0.05).alias("flag_a"),
                    (F.col("l_tax") > 0.04).alias("flag_b"),
                    (F.nullif("l_quantity", F.lit(50.0)) > 25).alias("flag_c"))


def q_all_clean(spark, d):
    f = _flags(runs(spark, d))
    return f.withColumn("clean", all_clean("flag_a", "flag_b", "flag_c"))


def q_tristate_label(spark, d):
    f = _flags(runs(spark, d))
    return f.select("l_orderkey", "l_linenumber",
                    tristate_label("flag_a", "Detected", "Clean").alias("label_a"),
                    tristate_label("flag_b", "✅", "❌").alias("label_b"),
                    tristate_label("flag_c", "✅", "❌ reconnected").alias("label_c"))


def q_score_tier(spark, d):
    r = runs(spark, d)
    score = F.col("l_discount") * F.lit(10.0)
    return r.select(*_row_ids(r), dround(score, P).alias("score"),
                    score_at_least(score).alias("tier_pass"),
                    score_at_least(score, 0.7).alias("human_like"))


# ---- dimension lookups --------------------------------------------------------------
# Fixed values of the bindings: dims over event types, one type left out on purpose.
EVENT_LABEL = {"click": "Click", "view": "View", "purchase": "Purchase", "signup": "Signup"}
EVENT_RANK = {"click": 1, "view": 2, "purchase": 3, "signup": 4}
EVENT_ALIASES = {"click": "CLICK", "clk": "CLICK", "view": "VIEW", "purchase": "PURCHASE",
                 "buy": "PURCHASE", "signup": "SIGNUP"}
EVENT_EXCLUSIONS = {"error": "errors are not served", "signup": "requires a paid plan"}
EVENT_VARIANTS = {"click", "view", "signup"}
EVENT_LIMITS = {"click": 1, "view": 1, "purchase": 2}


def q_lookup_default(spark, d):
    ev = table(spark, d, "events").select("event_id", "event_type")
    out = dims.lookup_default(ev, EVENT_LABEL, "event_type", "label", dims.DASH)
    return dims.lookup_default(out, EVENT_RANK, "event_type", "rank", dims.DEFAULT_RANK)


def q_lookup_frame(spark, d):
    """A dimension given as data, with many rows a key: the last one counts."""
    e = table(spark, d, "events")
    dim = e.where("event_type <> 'error'").select("event_type", "user_id", "event_id")
    found = dims.lookup_default(e.select("event_id", "event_type"), dim, "event_type", "user_id", -1, "last_user", order="event_id")
    return found.select("event_id", "last_user")


def q_canonical_key(spark, d):
    ev = table(spark, d, "events")
    raw = F.concat(F.lit("  "), F.upper("event_type"), F.lit(" "))
    return ev.select("event_id", raw.alias("raw"),
                     dims.canonical_provider(raw, EVENT_ALIASES).alias("canonical"))


def q_capability(spark, d):
    ev = table(spark, d, "events")
    supported, reason = dims.capability("event_type", EVENT_EXCLUSIONS, EVENT_VARIANTS)
    return ev.select("event_id", supported.alias("supported"), reason.alias("not_supported_reason"))


def q_limit_exceeded(spark, d):
    ev = table(spark, d, "events")
    lim = dims.lookup("event_type", EVENT_LIMITS)
    conc = (F.floor("value").cast("int") % 4 + 1)
    return ev.select("event_id", lim.alias("max_concurrency"), conc.alias("concurrency"),
                     dims.limit_exceeded(lim, conc).alias("sequential_mode"))


# ---- aggregations over runs ---------------------------------------------------------

def q_stage_totals(spark, d):
    return stage_totals(runs(spark, d), ["provider"], RUN_STAGES, places=P)


def q_stage_summary(spark, d):
    return stage_summary(runs(spark, d), ["provider"], RUN_STAGES, places=P)


def q_success_rate(spark, d):
    sr = success_rate(runs(spark, d))
    return sr.select("provider", dround("success_rate", P).alias("success_rate"), "row_count")


def q_unpivot_stages(spark, d):
    return unpivot_stages(runs(spark, d), ["provider", "success"], RUN_STAGES)


def q_stats_with_rate(spark, d):
    return stats_with_rate(runs(spark, d), ["provider"], RUN_STAGES, places=P)


def q_run_tally(spark, d):
    return run_tally(runs(spark, d))


def q_enum_order(spark, d):
    s = stage_summary(runs(spark, d), ["provider"], RUN_STAGES, places=P)
    ranked = with_position(s, [F.col("provider").asc_nulls_last(), enum_rank("metric", METRICS)],
                           "position")
    return ranked.select("provider", "metric", "avg_ms", "position")


# ---- latest records -----------------------------------------------------------------

def q_latest_per_key(spark, d):
    out = latest_per_key(log(spark, d), ["event_type"], "created_at", ["event_id"])
    return out.select("event_type", "event_id", "user_id", "value")


def q_latest_per_keys(spark, d):
    out = latest_per_key(log(spark, d), ["user_id", "event_type"], "created_at", ["event_id"])
    return out.select("user_id", "event_type", "event_id", "value")


def q_latest_with_fallback(spark, d):
    out = latest_with_fallback(log(spark, d), ["user_id", "event_type"], "success", "created_at",
                               ["event_id"])
    return out.select("user_id", "event_type", "event_id", "success")


def q_sibling_score(spark, d):
    rows = log(spark, d).where(F.col("event_type").isin("click", "view"))
    chosen = latest_with_fallback(rows, ["user_id", "event_type"], "success", "created_at", ["event_id"])
    return sibling_values(chosen, ["user_id"], "event_type", {"click": "click", "view": "view"},
                          ["success", "value"])


def q_distinct_keys(spark, d):
    e = log(spark, d)
    return distinct_keys(e.where(F.col("success")), e.where(~F.col("success")),
                         ["user_id", "event_type"])


def q_any_failure(spark, d):
    return any_failure(log(spark, d), ["user_id", "event_type"], "success")


# ---- batches -------------------------------------------------------------------------

ROLLUP_OUT = ["o_orderkey", "n_sessions", "sessions_succeeded", "sessions_failed",
              "sequential_equivalent_ms", "success"]


def _rollup_out(df):
    return df.select("o_orderkey", "n_sessions", "sessions_succeeded", "sessions_failed",
                     dround("sequential_equivalent_ms", P).alias("sequential_equivalent_ms"),
                     "success")


def q_batch_rollup(spark, d):
    return _rollup_out(batches(spark, d))


def q_batch_rollup_nested(spark, d):
    return _rollup_out(combine_rollups(rollup_nested(nested_batches(spark, d)), ["o_orderkey"]))


def q_overhead_ratio(spark, d):
    b = batches(spark, d)
    return b.select("o_orderkey", overhead_ratio("o_totalprice", "sequential_equivalent_ms")
                    .alias("overhead_ratio"))


def q_batch_summary(spark, d):
    # the batches are rolled up from their sessions: once, as the medians read them more than once
    b = snapshot(_batch_frame(spark, d, F.col("n_sessions").cast("int")))
    return batch_summary(b)


# ---- ordering ------------------------------------------------------------------------

def q_rank_position(spark, d):
    per_user = log(spark, d).groupBy("user_id").agg(
        dround(F.avg("value"), P).alias("avg_value"), F.count(F.lit(1)).alias("n_events"))
    return with_position(per_user, [F.col("avg_value").asc_nulls_last(), "user_id"], "position")


def _latest_captcha(spark, d, all_ok=True):
    c = latest_per_key(captcha(spark, d, all_ok), ["user_id"], "created_at", ["event_id"])
    return c.withColumn("solve_s", to_seconds("solve_ms", 1))


def q_mixed_sort(spark, d):
    c = _latest_captcha(spark, d)
    ranked = with_position(c, [F.col("supported").desc_nulls_last(),
                               F.col("solve_s").asc_nulls_last(), F.col("user_id").asc()], "position")
    return ranked.select("user_id", "supported", "solve_s", "position")


CAPTCHA_PLAN_RANK = {"signup": 0}


def q_captcha_order(spark, d):
    c = _latest_captcha(spark, d).withColumn(
        "plan_rank", dims.lookup("event_type", CAPTCHA_PLAN_RANK, dims.DEFAULT_RANK))
    ranked = with_position(c, captcha_order("supported", "solve_s", F.col("plan_rank"), "user_id"),
                           "position")
    return ranked.select("user_id", "supported", "solve_s", "plan_rank", "position")


IDLE_COST_RANK = {"click": 0, "view": 1, "purchase": 2, "signup": 3}


def q_survivor_order(spark, d):
    i = idle(spark, d)
    keyed = i.withColumn("cost_rank", dims.lookup("provider", IDLE_COST_RANK, dims.DEFAULT_RANK))
    ranked = with_position(keyed, [survivor_key("session_survived"), "cost_rank",
                                   F.col("provider").asc_nulls_last(), "event_id"], "position")
    return ranked.select("event_id", "provider", "session_survived", "cost_rank", "position")


# ---- text and captures ----------------------------------------------------------------

def q_value_label(spark, d):
    ev = table(spark, d, "events")
    v = F.when(F.col("value") > 300, F.lit(None).cast("double")).otherwise(F.col("value"))
    return ev.select("event_id", value_label(v, "ms", 2).alias("value_ms"),
                     value_label(dround(v, 0), "ms", 0).alias("value_ms_whole"),
                     value_label(to_seconds(v * 1000, 1), "s", 1).alias("value_s"))


def q_error_reason(spark, d):
    doc = table(spark, d, "documents")
    return doc.select("doc_id", error_reason(F.concat(F.lit("Error: "), F.col("text"))).alias("reason"))


def q_rate_limited(spark, d):
    doc = table(spark, d, "documents")
    return doc.select("doc_id", rate_limited("text").alias("rate_limited"))


def q_truncate_text(spark, d):
    doc = table(spark, d, "documents")
    return doc.select("doc_id", truncate_text("text").alias("head"))


# Fixed values of the binding: phrases that occur in the test prose.
PHRASES_EXACT = ["Eau", "The"]
PHRASES_LOWER = ["nicht", "with"]
PHRASE_RULES = [("nicht", False), ("the", True), ("ou", False)]


def q_any_phrase(spark, d):
    doc = table(spark, d, "documents")
    return doc.select("doc_id", any_phrase("text", PHRASES_EXACT, PHRASES_LOWER).alias("verified"))


def q_phrase_class(spark, d):
    c = table(spark, d, "conversations")
    return c.select("conv_id", "turn", phrase_class("text", PHRASE_RULES).alias("verdict"))


def score_texts(spark, d) -> DataFrame:
    """Captured text in three shapes, one per score-capture rule."""
    ev = table(spark, d, "events")
    k = F.get_json_object("props", "$.k")
    uid = F.col("user_id").cast("string")
    shape = F.col("event_id") % 3
    text = (F.when(shape == 0, F.concat(F.lit("Your Score: 0."), k))
            .when(shape == 1, F.concat(k, F.lit("."), uid, F.lit(" / 100 points")))
            .otherwise(F.concat(F.lit("result\n0."), k, F.lit("\ndone"))))
    return ev.select("event_id", text.alias("text"))


def q_score_extract(spark, d):
    return score_texts(spark, d).select("event_id", score_extract("text").alias("score"))


def q_page_title(spark, d):
    p = table(spark, d, "pages")
    return p.select("page_id", page_title("html").alias("title"))


def q_split_clean(spark, d):
    p = table(spark, d, "part")
    raw = F.concat(F.regexp_replace("p_name", " ", " , "), F.lit(",, "), F.col("p_type"), F.lit(" ,"))
    items = split_clean(raw)
    return p.select("p_partkey", F.array_join(items, "|").alias("items"),
                    F.size(items).cast("long").alias("n_items"))


def check_rows(spark, d) -> DataFrame:
    """A stored check table per event: JSON array of {label, result, style, className}."""
    ev = table(spark, d, "events")
    v = F.col("value")
    first = F.struct(F.concat(F.upper("event_type"), F.lit(" check")).alias("label"),
                     F.when(v < 35, F.lit("passed")).when(v > 100, F.lit("failed")).alias("result"),
                     F.lit(None).cast("string").alias("style"),
                     F.lit(None).cast("string").alias("className"))
    second = F.struct(F.lit("WebDriver (New)").alias("label"),
                      F.lit(None).cast("string").alias("result"),
                      F.when(v < 10, F.lit("color: red")).when(v < 50, F.lit("color: green"))
                       .alias("style"),
                      F.when(v > 300, F.lit("failed")).alias("className"))
    raw = F.to_json(F.array(first, second))
    return ev.select("event_id", "event_type", raw.alias("raw"))


def q_check_lookup(spark, d):
    c = check_rows(spark, d).withColumn("rows", parse_checks("raw"))
    hit = check_lookup("rows", "click")
    return c.select("event_id", hit["label"].alias("label"), hit["result"].alias("result"))


def q_check_verdict(spark, d):
    c = check_rows(spark, d).withColumn("rows", parse_checks("raw"))
    return c.select("event_id",
                    check_verdict(check_lookup("rows", "webdriver")).alias("webdriver"),
                    check_detected("rows", ["view", "webdriver"]).alias("detected"))


def q_duration_ms(spark, d):
    ev = table(spark, d, "events")
    span = ev.groupBy("user_id").agg(F.min("ts").alias("first_ts"), F.max("ts").alias("last_ts"))
    return span.select("user_id", duration_ms("first_ts", "last_ts").alias("duration_ms"),
                       dround(duration_ms("first_ts", "last_ts", fractional=True), 3)
                       .alias("duration_ms_frac"))


def q_iso_date(spark, d):
    ev = table(spark, d, "events")
    span = ev.groupBy("user_id").agg(F.min("ts").alias("first_ts"))
    return span.select("user_id", iso_date("first_ts").alias("first_day"),
                       iso_text("first_ts").alias("first_iso"))


def q_run_detail(spark, d):
    return reports.idle_rows(idle(spark, d), tie=["created_at", "event_id"])


def q_text_measures(spark, d):
    """Stage totals over a log whose measures are text, some of it no number."""
    r = runs(spark, d)
    texts = [F.when(F.col("l_linenumber") == 3, F.concat(F.col(s).cast("string"), F.lit("ms")))
             .otherwise(F.col(s).cast("string")).alias(s) for s in RUN_STAGES]
    return stage_totals(r.select("provider", "success", *texts), ["provider"], RUN_STAGES, places=P)


def q_stealth_flags(spark, d):
    """Flags from a stored check table and page text per event."""
    c = check_rows(spark, d)
    text = F.concat(F.lit("Result: You are "), F.when(F.col("event_id") % 2 == 0, "not ").otherwise(""),
                    F.when(F.col("event_id") % 3 == 0, "Chrome headless").when(F.col("event_id") % 3 == 1, "headless").otherwise("here"))
    flags = stealth_flags("raw", text)
    return c.select("event_id", *[v.alias(k) for k, v in flags.items()])


# ---- report tables -----------------------------------------------------------------------
# Fixed values of the bindings: display dims with one key left out (shown as the default).
RUN_PRICING = {"A": "plan A, metered", "N": "plan N, flat"}
IDLE_COST = {"click": "1 coin", "view": "2 coins", "purchase": "half a coin", "signup": "3 coins"}
STEALTH_PLAN = {"1": "tier one", "2": "tier two (extra)"}
CAPTCHA_COST = {"1": "ten coins", "3": "on request"}
CAPTCHA_PLAN = {"2": 0, "5": 1}
PARALLEL_LIMITS = {"1-URGENT": "three", "2-HIGH": "one", "3-MEDIUM": "two", "5-LOW": "five"}
PARALLEL_CONCURRENCY = 3


def r_lifecycle(spark, d):
    return reports.report_lifecycle(runs(spark, d), RUN_PRICING, stages=RUN_STAGES)


def r_idle(spark, d):
    return reports.report_idle(idle(spark, d, all_ok=True), IDLE_COST, IDLE_COST_RANK,
                               tie=["created_at", "event_id"])


def r_stealth(spark, d):
    return reports.report_stealth(stealth(spark, d), STEALTH_PLAN, tie=["event_id"])


def r_captcha(spark, d, all_ok=True):
    return reports.report_captcha(captcha(spark, d, all_ok), CAPTCHA_COST, CAPTCHA_PLAN,
                                  tie=["event_id"])


def r_parallel(spark, d):
    b = _batch_frame(spark, d, F.lit(PARALLEL_CONCURRENCY))
    return reports.report_parallel(b, PARALLEL_LIMITS)


def q_report_status(spark, d):
    """The status table from the gates alone: no report is built."""
    return reports.report_status(spark, {
        "lifecycle": reports.gate_lifecycle(runs(spark, d), RUN_STAGES),
        "idle": reports.gate_idle(idle(spark, d, all_ok=True)),
        "stealth": reports.gate_stealth(stealth(spark, d)),
        "captcha": reports.gate_captcha(captcha(spark, d), ["event_id"]),
        "parallel": reports.gate_parallel(_batch_frame(spark, d, F.lit(PARALLEL_CONCURRENCY))),
        "captcha_gated": reports.gate_captcha(captcha(spark, d, all_ok=False), ["event_id"]),
        "stealth_empty": reports.gate_stealth(stealth(spark, d).withColumn("mode", F.lit("other"))),
    })


# ---- run logs and the run store -------------------------------------------------------------
# Input of these queries: run logs written from the tables, one file set per kind.

def _lifecycle_runs(spark, d) -> DataFrame:
    """The runs stand-in under the lifecycle record's names."""
    names = dict(zip(RUN_STAGES, STAGES))
    r = runs(spark, d)
    return r.select(*[F.col(c).alias(names[c]) for c in RUN_STAGES], "provider", "success",
                    F.col("l_orderkey").cast("string").alias("id"))


def _write_logs(texts: DataFrame, folder: str, prefix: str) -> None:
    """JSON texts (``value``) as log files of a kind: ``<prefix>-<n>.jsonl`` in ``folder``."""
    spark = texts.sparkSession
    part = f"{folder}/_writing-{prefix}"
    texts.write.text(part)
    path = spark._jvm.org.apache.hadoop.fs.Path
    store = path(folder).getFileSystem(spark._jsc.hadoopConfiguration())
    for i, f in enumerate(store.globStatus(path(f"{part}/part-*"))):
        store.rename(f.getPath(), path(f"{folder}/{prefix}-{i}.jsonl"))
    store.delete(path(part), True)


def _log_folder(spark, d, bad: bool = False, cut_by: int = 5) -> str:
    """A results folder: lifecycle and idle logs; ``bad``: every seventh lifecycle line cut short."""
    folder = scratch_path(spark, "logs")
    text = F.col("json")
    cut = F.when(F.lit(bad) & (F.col("id").cast("long") % 7 == 0), text.substr(F.lit(1), F.length(text) - cut_by)).otherwise(text)
    _write_logs(to_json_text(_lifecycle_runs(spark, d)).select(cut.alias("value")), folder, "runs")
    _write_logs(to_json_text(idle(spark, d).drop("event_id", "created_at")).select(F.col("json").alias("value")), folder, "idle")
    return folder


def _by_provider(df: DataFrame) -> DataFrame:
    return df.groupBy("provider").agg(
        F.count(F.lit(1)).alias("n_rows"), F.count_if(F.col("success")).alias("n_success"),
        dround(F.sum("page_goto_ms"), P).alias("goto_ms"))


def q_kind_routing(spark, d):
    """Rows and providers of each kind in a folder that holds several."""
    rows = scan_runs(spark, _log_folder(spark, d), None, with_file=True)
    return rows.groupBy("kind").agg(F.count(F.lit(1)).alias("n_rows"), F.count_distinct("provider").alias("n_providers"))


def q_kind_schema(spark, d):
    """Lifecycle logs through the kind's schema: fractional times survive."""
    return _by_provider(scan_runs(spark, _log_folder(spark, d), "lifecycle"))


def q_bad_lines(spark, d):
    """Good and bad lines of a log whose lines are partly cut short, stored in one pass."""
    store = scratch_path(spark, "store")
    ingest_logs(spark, _log_folder(spark, d, bad=True), store)
    n = quarantined(spark, store).where("kind = 'lifecycle'").agg(F.count(F.lit(1)).alias("n_bad"))
    return _by_provider(read_converted(spark, store, "lifecycle")).crossJoin(n)  # one row


def q_quarantine_replay(spark, d):
    """Lines without their last brace: quarantined, repaired and replayed, twice; each run is there once."""
    store = scratch_path(spark, "store")
    ingest_logs(spark, _log_folder(spark, d, bad=True, cut_by=1), store)
    freed = [replay(spark, store, lambda line: F.concat(line, F.lit("}"))) for _ in range(2)]
    left = quarantined(spark, store).agg(F.count(F.lit(1)).alias("n_left"))
    return (_by_provider(read_converted(spark, store, "lifecycle")).crossJoin(left)  # one row
            .withColumn("n_replayed", F.lit(sum(freed)).cast("long")))


def q_missing_input(spark, d):
    """A kind without files beside one with files: no rows, no error."""
    folder = _log_folder(spark, d)
    kinds = [scan_runs(spark, folder, k).agg(F.count(F.lit(1)).alias("n_rows")).select(F.lit(k).alias("kind"), "n_rows")
             for k in ("idle", "stealth", "captcha", "parallel")]
    return reduce(DataFrame.unionByName, kinds)


def _odd_keys(df: DataFrame) -> DataFrame:
    """The runs under provider keys that look like numbers or paths."""
    return df.withColumn("provider", dims.lookup("provider", {"A": "007", "N": "a:b/c=%", "R": ""}))


def q_append_sink(spark, d):
    """The runs appended in two steps, the second one tried twice, read back with the scan."""
    store, r = scratch_path(spark, "store"), _odd_keys(_lifecycle_runs(spark, d))
    append_runs(r.where("success"), store, "lifecycle", batch_id="good")
    for _ in range(2):
        append_runs(r.where("NOT success"), store, "lifecycle", batch_id="bad")
    return _by_provider(scan_runs(spark, store, "lifecycle"))


def q_replace_slice(spark, d):
    """One provider's slice replaced by part of itself as read from the store, one by nothing, the others kept."""
    store, r = scratch_path(spark, "store"), _odd_keys(_lifecycle_runs(spark, d))
    append_runs(r, store, "lifecycle")
    old = read_converted(spark, store, "lifecycle", ["007"])
    replace_slice(old.where("page_goto_ms > 0.05"), store, [("lifecycle", "007"), ("lifecycle", "")])
    return _by_provider(scan_runs(spark, store, "lifecycle"))


def q_report_sink(spark, d):
    """A report written as data and read back."""
    path = scratch_path(spark, "report")
    write_report(q_stage_totals(spark, d), path, "parquet")
    return spark.read.parquet(path)


def _df(report_fn):
    def run(spark, d):
        return report_fn(spark, d).df
    run.__name__ = report_fn.__name__
    run.__doc__ = report_fn.__doc__
    return run


QUERIES = {
    "json_scan": q_json_scan,
    "json_nested_scan": q_json_nested_scan,
    "json_roundtrip": q_json_roundtrip,
    "safe_cast": q_safe_cast,
    "row_total_strict": q_row_total_strict,
    "row_total_lenient": q_row_total_lenient,
    "shortfall": q_shortfall,
    "unit_convert": q_unit_convert,
    "complete_rows": q_complete_rows,
    "all_clean": q_all_clean,
    "tristate_label": q_tristate_label,
    "score_tier": q_score_tier,
    "lookup_default": q_lookup_default,
    "lookup_frame": q_lookup_frame,
    "canonical_key": q_canonical_key,
    "capability": q_capability,
    "limit_exceeded": q_limit_exceeded,
    "stage_totals": q_stage_totals,
    "stage_summary": q_stage_summary,
    "success_rate": q_success_rate,
    "unpivot_stages": q_unpivot_stages,
    "stats_with_rate": q_stats_with_rate,
    "run_tally": q_run_tally,
    "enum_order": q_enum_order,
    "latest_per_key": q_latest_per_key,
    "latest_per_keys": q_latest_per_keys,
    "latest_with_fallback": q_latest_with_fallback,
    "sibling_score": q_sibling_score,
    "distinct_keys": q_distinct_keys,
    "any_failure": q_any_failure,
    "batch_rollup": q_batch_rollup,
    "batch_rollup_nested": q_batch_rollup_nested,
    "overhead_ratio": q_overhead_ratio,
    "batch_summary": q_batch_summary,
    "rank_position": q_rank_position,
    "mixed_sort": q_mixed_sort,
    "captcha_order": q_captcha_order,
    "survivor_order": q_survivor_order,
    "value_label": q_value_label,
    "error_reason": q_error_reason,
    "rate_limited": q_rate_limited,
    "truncate_text": q_truncate_text,
    "any_phrase": q_any_phrase,
    "phrase_class": q_phrase_class,
    "score_extract": q_score_extract,
    "page_title": q_page_title,
    "split_clean": q_split_clean,
    "check_lookup": q_check_lookup,
    "check_verdict": q_check_verdict,
    "duration_ms": q_duration_ms,
    "iso_date": q_iso_date,
    "run_detail": q_run_detail,
    "text_measures": q_text_measures,
    "stealth_flags": q_stealth_flags,
    "kind_routing": q_kind_routing,
    "kind_schema": q_kind_schema,
    "bad_lines": q_bad_lines,
    "quarantine_replay": q_quarantine_replay,
    "missing_input": q_missing_input,
    "append_sink": q_append_sink,
    "replace_slice": q_replace_slice,
    "report_sink": q_report_sink,
    "report_lifecycle": _df(r_lifecycle),
    "report_idle": _df(r_idle),
    "report_stealth": _df(r_stealth),
    "report_captcha": _df(r_captcha),
    "report_parallel": _df(r_parallel),
    "report_status": q_report_status,
}
