"""Scalar column helpers (built-in expressions only; no Python UDFs)."""

from runlens.functions.numeric import (dround, measure, num_text, row_total, safe_double,
                                       shortfall, to_seconds)
from runlens.functions.labels import emphasise_nonzero, tristate_label, value_label
from runlens.functions.text import (any_phrase, canonical_key, error_reason, first_line,
                                    page_title, phrase_class, rate_limited, remove_first,
                                    score_extract, split_clean, truncate_text)
from runlens.functions.checks import (all_clean, check_detected, check_lookup,
                                      check_verdict, parse_checks, score_at_least, stealth_flags)
from runlens.functions.time import duration_ms, iso_date, iso_text

__all__ = [
    "dround", "measure", "num_text", "row_total", "safe_double", "shortfall", "to_seconds",
    "emphasise_nonzero", "tristate_label", "value_label",
    "any_phrase", "canonical_key", "error_reason", "first_line", "page_title", "phrase_class",
    "rate_limited", "remove_first", "score_extract", "split_clean", "truncate_text",
    "all_clean", "check_detected", "check_lookup", "check_verdict", "parse_checks",
    "score_at_least", "stealth_flags",
    "duration_ms", "iso_date", "iso_text",
]
