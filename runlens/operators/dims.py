"""Dimension lookups with defaults.

Fixed maps (a handful of entries known when the code is written) become a
literal ``map`` expression: a projection inside whole-stage codegen, with no
join and no shuffle. A dimension given as a DataFrame is joined; its side is
broadcast only when the caller states a row bound, otherwise AQE chooses at
run time from the measured size (falling back to a sort-merge join).
"""

from __future__ import annotations

from itertools import chain

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from runlens.functions._col import col
from runlens.functions.text import canonical_key

DASH = "—"
DEFAULT_RANK = 99

# ---- Fixed values: the report's provider dimensions -------------------------
LIFECYCLE_PRICING = {
    "KERNEL": "$0.0000167/sec (active only, idle free)",
    "STEEL": "$0.10/hr",
    "HYPERBROWSER": "$0.10/hr",
    "BROWSERLESS": "1 unit/30s (1,000 units/mo free)",
    "BROWSERBASE": "$0.12/hr (Developer), 1 hr/mo free",
    "ANCHORBROWSER": "$0.05/hr + $0.01/session",
}
IDLE_COST = {
    "KERNEL": "$0.00 (idle free)",
    "STEEL": "~$0.0017",
    "HYPERBROWSER": "~$0.0017",
    "BROWSERLESS": "2 units (free tier)",
    "BROWSERBASE": "~$0.0020",
    "ANCHORBROWSER": "~$0.0108 (incl. $0.01 create fee)",
}
IDLE_COST_RANK = {
    "KERNEL": 0, "STEEL": 1, "HYPERBROWSER": 2, "BROWSERLESS": 3, "BROWSERBASE": 4, "ANCHORBROWSER": 5,
}
STEALTH_PLAN = {
    "BROWSERLESS": "Free (stealth endpoint)",
    "KERNEL": "Free (managed proxy included)",
    "STEEL": "Paid (proxy add-on)",
    "HYPERBROWSER": "Paid ($10/GB proxy)",
    "ANCHORBROWSER": "Free (worked on trial account; Growth tier $2,000/mo per docs)",
    "BROWSERBASE": "Scale plan (custom pricing)",
}
CAPTCHA_COST = {
    "BROWSERLESS": "10 units/solve (~$0.02 on paid)",
    "KERNEL": "~$0.0006/solve (GB-seconds)",
    "STEEL": "Starter plan ($29/mo) required",
    "BROWSERBASE": "Developer plan ($20/mo) required",
    "HYPERBROWSER": "Paid plan required",
    "ANCHORBROWSER": "Starter plan ($50/mo) required",
}
CAPTCHA_PLAN_ORDER = {"BROWSERBASE": 0, "STEEL": 1, "HYPERBROWSER": 2, "ANCHORBROWSER": 3}
CONCURRENCY_LIMIT_TEXT = {
    "STEEL": "3 (free tier)",
    "KERNEL": "5 (free tier)",
    "ANCHORBROWSER": "5 (free tier)",
    "BROWSERLESS": "2 (free tier)",
    "HYPERBROWSER": "1 (free tier)",
    "BROWSERBASE": "1 (free tier)",
}
MAX_CONCURRENCY = {"BROWSERBASE": 1, "HYPERBROWSER": 1, "BROWSERLESS": 2}
CAPTCHA_NOT_SUPPORTED = {
    "BROWSERBASE": "Requires Developer plan ($20/mo) — not available on free tier",
    "ANCHORBROWSER": "Requires paid residential proxy ($8/GB) — not available without additional cost",
    "HYPERBROWSER": "Built-in CAPTCHA solving exists (solveCaptchas=true) but requires a paid plan — not available on free tier",
    "STEEL": "Built-in CAPTCHA solving exists (solveCaptcha=true) but requires Developer plan or above — not available on free tier",
}
CAPTCHA_VARIANT = {"BROWSERLESS", "KERNEL"}
STEALTH_VARIANT = {"BROWSERLESS", "BROWSERBASE", "ANCHORBROWSER", "HYPERBROWSER", "KERNEL", "STEEL"}
PROVIDER_ALIASES = {
    "browserless": "BROWSERLESS",
    "browserbase": "BROWSERBASE",
    "bb": "BROWSERBASE",
    "anchorbrowser": "ANCHORBROWSER",
    "anchor": "ANCHORBROWSER",
    "hyperbrowser": "HYPERBROWSER",
    "hyper": "HYPERBROWSER",
    "kernel": "KERNEL",
    "steel": "STEEL",
}
# -----------------------------------------------------------------------------


def map_literal(mapping: dict) -> Column:
    """A literal map column built from a small fixed dict."""
    if not mapping:
        return F.create_map()
    return F.create_map(*chain.from_iterable((F.lit(k), F.lit(v)) for k, v in mapping.items()))


def lookup(key: Column | str, mapping: dict, default=None) -> Column:
    """``mapping[key] ?? default`` as an expression; a NULL key never matches."""
    hit = F.try_element_at(map_literal(mapping), col(key))
    return hit if default is None else F.coalesce(hit, F.lit(default))


def lookup_default(df: DataFrame, dim: DataFrame | dict, on: str, value: str,
                   default, out: str | None = None, order: str | None = None) -> DataFrame:
    """Add ``out`` = dim value for ``df[on]``, ``default`` when absent.

    ``dim`` is a dict (literal map, no join) or a DataFrame with columns
    ``on`` and ``value``; AQE picks that join's strategy from measured sizes. Like a
    map, the DataFrame keeps one value a key: that of the row with the largest
    ``order`` (ties, or no ``order``: the largest value, NULL last of all), so ``df``
    keeps its rows however often a key repeats.
    """
    out = out or value
    if isinstance(dim, dict):
        return df.withColumn(out, lookup(on, dim, default))
    rank = F.struct(*([F.col(order)] if order else []), F.col(value))
    side = dim.groupBy(F.col(on).alias("_rl_dk")).agg(F.max(F.struct(rank.alias("r"), F.col(value).alias("v")))["v"].alias("_rl_dv"))
    joined = df.join(side, df[on] == side["_rl_dk"], "left")
    return joined.withColumn(out, F.coalesce(F.col("_rl_dv"), F.lit(default))).drop("_rl_dk", "_rl_dv")


def canonical_provider(raw: Column | str, aliases: dict = PROVIDER_ALIASES) -> Column:
    """Alias or name -> canonical key (trim + lower + alias map); unknown -> NULL."""
    return lookup(canonical_key(raw), aliases)


def resolve_keys(df: DataFrame, raw: str, out: str = "provider",
                 aliases: dict = PROVIDER_ALIASES) -> tuple[DataFrame, DataFrame]:
    """(rows whose ``raw`` key resolves, with ``out`` = canonical key; rows whose
    key is unknown or NULL, kept as they are for review). One projection each,
    no join."""
    keyed = df.withColumn(out, canonical_provider(raw, aliases))
    return keyed.where(F.col(out).isNotNull()), keyed.where(F.col(out).isNull()).drop(out)


def capability(key: Column | str, exclusions: dict = CAPTCHA_NOT_SUPPORTED,
               variants: set = CAPTCHA_VARIANT) -> tuple[Column, Column]:
    """(supported, not_supported_reason): supported = no exclusion reason AND a
    variant exists for the key."""
    reason = lookup(key, exclusions)
    has_variant = F.coalesce(col(key).isin(list(variants)), F.lit(False)) if variants else F.lit(False)
    return reason.isNull() & has_variant, reason


def limit_exceeded(limit: Column | str, concurrency: Column | str) -> Column:
    """Sequential mode rule: the limit (NULL = no limit) is below the concurrency."""
    return F.coalesce(col(limit) < col(concurrency), F.lit(False))
