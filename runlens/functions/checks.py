"""Check-table rules: stored JSON arrays of {label, result, style, className}
rows are parsed with ``from_json`` and inspected with higher-order functions."""

from __future__ import annotations

from functools import reduce
from operator import and_

from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql import types as T

from runlens.functions._col import col
from runlens.functions.text import phrase_class

CHECK_ROW = T.StructType([
    T.StructField("label", T.StringType()),
    T.StructField("result", T.StringType()),
    T.StructField("style", T.StringType()),
    T.StructField("className", T.StringType()),
])
CHECK_ROWS = T.ArrayType(CHECK_ROW)

# Label fragments looked up per flag, first fragment first.
WEBDRIVER_FRAGMENTS = ["webdriver (new)", "webdriver"]
HEADLESS_FRAGMENTS = ["headchr_ua", "headchr"]
USER_AGENT_FRAGMENTS = ["user agent"]


def parse_checks(raw: Column | str) -> Column:
    """JSON text -> array<struct<label,result,style,className>> (NULL on NULL/bad JSON)."""
    return F.from_json(col(raw), CHECK_ROWS)


def check_lookup(rows: Column | str, fragment: str) -> Column:
    """First row whose label contains ``fragment`` (case-insensitive), else NULL."""
    frag = fragment.lower()
    return F.get(F.filter(col(rows), lambda r: F.lower(r["label"]).contains(frag)), 0)


def check_verdict(row: Column) -> Column:
    """failed / red -> true (detected); passed / green -> false; otherwise NULL."""
    res = F.lower(F.coalesce(row["result"], F.lit("")))
    sty = F.lower(F.coalesce(row["style"], F.lit("")))
    cls = F.lower(F.coalesce(row["className"], F.lit("")))
    failed = res.contains("failed") | sty.contains("red") | cls.contains("failed")
    passed = res.contains("passed") | sty.contains("green") | cls.contains("passed")
    return (F.when(row.isNull(), F.lit(None).cast("boolean"))
            .when(failed, F.lit(True))
            .when(passed, F.lit(False)))


def check_detected(rows: Column | str, fragments: list[str]) -> Column:
    """Verdict of the first fragment that gives one (``a ?? b``)."""
    return F.coalesce(*[check_verdict(check_lookup(rows, f)) for f in fragments])


def stealth_flags(checks_raw: Column | str, page_text: Column | str) -> dict[str, Column]:
    """The four stealth flags from the stored captures: the check table's JSON
    and the text of the headless page. NULL where a capture says neither."""
    rows = parse_checks(checks_raw)
    return {
        "sannysoft_webdriver_detected": check_detected(rows, WEBDRIVER_FRAGMENTS),
        "sannysoft_headless_detected": check_detected(rows, HEADLESS_FRAGMENTS),
        "sannysoft_user_agent_suspicious": check_detected(rows, USER_AGENT_FRAGMENTS),
        "areyouheadless_detected": phrase_class(page_text),
    }


def all_clean(*flags: Column | str) -> Column:
    """True only when every tri-state flag is false; NULL is not clean."""
    return F.coalesce(reduce(and_, [~col(f) for f in flags]), F.lit(False))


# Fixed value: the report tier's reCAPTCHA v3 threshold.
TIER_SCORE = 0.3


def score_at_least(score: Column | str, threshold: float = TIER_SCORE) -> Column:
    """Score threshold with a missing score read as 0 (never NULL)."""
    return F.coalesce(col(score), F.lit(0.0)) >= F.lit(threshold)
