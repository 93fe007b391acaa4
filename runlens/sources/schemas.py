"""Explicit schemas for the five run-log kinds (no inference: an all-NULL
column would otherwise change type from run to run). Times are doubles: a
fractional millisecond is a value, not a bad field."""

from __future__ import annotations

from pyspark.sql import types as T

S, B, D, I = T.StringType(), T.BooleanType(), T.DoubleType(), T.IntegerType()


def _f(name, dtype):
    return T.StructField(name, dtype, True)


LIFECYCLE = T.StructType([
    _f("created_at", S), _f("id", S),
    _f("session_creation_ms", D), _f("session_connect_ms", D),
    _f("page_goto_ms", D), _f("session_release_ms", D),
    _f("provider", S), _f("success", B), _f("error_stage", S), _f("error_message", S),
])

IDLE = T.StructType([
    _f("created_at", S), _f("provider", S), _f("session_id", S),
    _f("step1_ms", D), _f("idle_ms", D), _f("session_survived", B),
    _f("reconnect_ms", D), _f("step2_ms", D), _f("step2_title", S),
    _f("session_release_ms", D), _f("total_ms", D),
    _f("success", B), _f("error_stage", S), _f("error_message", S),
])

STEALTH = T.StructType([
    _f("created_at", S), _f("provider", S), _f("mode", S),
    _f("sannysoft_webdriver_detected", B), _f("sannysoft_headless_detected", B),
    _f("sannysoft_user_agent_suspicious", B), _f("sannysoft_raw", S),
    _f("areyouheadless_detected", B), _f("areyouheadless_raw", S),
    _f("recaptcha_score", D), _f("total_ms", D),
    _f("success", B), _f("error_stage", S), _f("error_message", S),
])

CAPTCHA = T.StructType([
    _f("created_at", S), _f("provider", S), _f("supported", B), _f("not_supported_reason", S),
    _f("captcha_detected", B), _f("captcha_solved", B), _f("solve_ms", D), _f("total_ms", D),
    _f("success", B), _f("error_stage", S), _f("error_message", S),
])

SESSION = T.StructType([
    _f("created_at", S), _f("provider", S), _f("session_index", I), _f("session_id", S),
    _f("session_creation_ms", D), _f("session_connect_ms", D), _f("page_goto_ms", D),
    _f("session_release_ms", D), _f("session_total_ms", D),
    _f("success", B), _f("error_stage", S), _f("error_message", S),
])

PARALLEL = T.StructType([
    _f("created_at", S), _f("provider", S), _f("run", I), _f("concurrency", I),
    _f("sequential_mode", B), _f("sessions", T.ArrayType(SESSION)),
    _f("sessions_succeeded", I), _f("sessions_failed", I),
    _f("total_parallel_ms", D), _f("sequential_equivalent_ms", D), _f("overhead_ratio", D),
    _f("success", B), _f("error_message", S),
])

KIND_SCHEMAS = {
    "lifecycle": LIFECYCLE, "idle": IDLE, "stealth": STEALTH,
    "captcha": CAPTCHA, "parallel": PARALLEL,
}


def merged_schema(kinds=None) -> T.StructType:
    """Union of the kinds' fields by name (first type wins), for scans that
    read several kinds through one glob."""
    seen, fields = set(), []
    for k in (kinds or KIND_SCHEMAS):
        for f in KIND_SCHEMAS[k].fields:
            if f.name not in seen:
                seen.add(f.name)
                fields.append(f)
    return T.StructType(fields)
