"""Text rules over captured text: error reasons, classifiers, number capture,
page titles, list cleaning. All are built-in string/regex expressions, so they
run inside whole-stage codegen over whole texts.

"""

from __future__ import annotations

import json
import re
from functools import reduce
from html.entities import html5
from operator import or_

from pyspark.sql import Column
from pyspark.sql import functions as F

from runlens.functions._col import col

# ---- Fixed values (rules the reports and collectors define) ----------------
# Rate-limit classifier applied to an error message: any of these phrases,
# case-insensitively (the alternation rate|limit|429|too many); HTTP status 429
# also counts.
RATE_LIMIT_PHRASES = ["rate", "limit", "429", "too many"]
RATE_LIMIT_STATUS = 429
# Verification phrases: the first is matched case-sensitively, the others on lower-cased text.
VERIFY_PHRASES_EXACT = ["Verification Success"]
VERIFY_PHRASES_LOWER = ["recaptcha-success", "verification was successful"]
# Headless verdict phrases, checked in this order on lower-cased text; first hit wins.
HEADLESS_PHRASES = [
    ("you are not chrome headless", False),
    ("you are chrome headless", True),
    ("you are not headless", False),
    ("you are headless", True),
]
# Score capture cascade: labelled score, then a number before a slash, then a
# line that is exactly a decimal fraction. The capture patterns use JavaScript's
# whitespace set (its \s also matches NBSP and the Unicode spaces), spelled out
# because Java's and RE2's \s are ASCII-only; \x{...} reads the same in both.
JS_SPACE = (r"\t\n\x0B\f\r \x{00A0}\x{1680}\x{2000}-\x{200A}\x{2028}\x{2029}"
            r"\x{202F}\x{205F}\x{3000}\x{FEFF}")
SCORE_LABELLED = r"(?i)score[:" + JS_SPACE + r"]+([\d.]+)"
SCORE_BEFORE_SLASH = r"([\d.]+)[" + JS_SPACE + r"]*/"
SCORE_BARE_LINE = r"(?m)^(0\.\d+)$"
ERROR_PREFIX = "Error: "
TRUNCATE_CHARS = 500
# ----------------------------------------------------------------------------

# parseFloat reads the longest numeric prefix ('0.3.' -> 0.3); a plain cast would give NULL.
_NUMBER_PREFIX = r"^([0-9]*\.?[0-9]+|[0-9]+)"
# HTML whitespace (tab, LF, FF, CR, space) collapses to one space in a title.
_HTML_SPACE = r"[ \t\n\f\r]+"
_TITLE = r"(?is)<title[^>]*>(.*?)</title>"


def first_line(c: Column | str) -> Column:
    """Text before the first newline; NULL reads as empty text."""
    return F.substring_index(F.coalesce(col(c), F.lit("")), "\n", 1)


def remove_first(c: Column | str, needle: str) -> Column:
    """Remove only the first occurrence of ``needle`` (non-global replace)."""
    c = col(c)
    pos = F.instr(c, needle)
    head = c.substr(F.lit(1), pos - F.lit(1))
    tail = c.substr(pos + F.lit(len(needle)), F.lit(1 << 30))
    return F.when(pos > 0, F.concat(head, tail)).otherwise(c)


def error_reason(c: Column | str, prefix: str = ERROR_PREFIX) -> Column:
    """First line of an error message with the first ``Error: `` removed."""
    return remove_first(first_line(c), prefix)


def rate_limited(message: Column | str, status: Column | str | None = None,
                 phrases: list[str] = RATE_LIMIT_PHRASES, pattern: str | None = None) -> Column:
    """Rate-limit classifier: status 429, or the message contains one of the
    phrases (case-insensitive substring search on the lower-cased text, about 3x
    faster than the equivalent regex alternation on long texts), or matches
    ``pattern`` when a regex is given instead."""
    text = F.coalesce(col(message), F.lit(""))
    if pattern is not None:
        hit = text.rlike(pattern)
    else:
        lc = F.lower(text)
        hit = reduce(or_, [lc.contains(p.lower()) for p in phrases])
    if status is not None:
        hit = F.coalesce(col(status) == RATE_LIMIT_STATUS, F.lit(False)) | hit
    return hit


def truncate_text(c: Column | str, n: int = TRUNCATE_CHARS) -> Column:
    """First ``n`` characters (code points)."""
    return F.substring(col(c), 1, n)


def any_phrase(c: Column | str, exact: list[str] = VERIFY_PHRASES_EXACT,
               lower: list[str] = VERIFY_PHRASES_LOWER) -> Column:
    """True when any phrase occurs: ``exact`` case-sensitively, ``lower`` on lower-cased text."""
    c = col(c)
    lc = F.lower(c)
    tests = [c.contains(p) for p in exact] + [lc.contains(p.lower()) for p in lower]
    return F.coalesce(reduce(or_, tests), F.lit(False)) if tests else F.lit(False)


def phrase_class(c: Column | str, rules: list[tuple[str, object]] = HEADLESS_PHRASES) -> Column:
    """Ordered classifier: value of the first phrase found in lower-cased text, else NULL."""
    lc = F.lower(col(c))
    out = None
    for phrase, value in rules:
        cond = lc.contains(phrase.lower())
        out = F.when(cond, F.lit(value)) if out is None else out.when(cond, F.lit(value))
    return out


def score_extract(c: Column | str) -> Column:
    """Number captured by the score cascade, parsed like ``parseFloat``.

    The cascade falls through only when a step finds no match; a match that is
    not a number (e.g. '...') gives NULL without trying the next step.
    """
    t = col(c)
    steps = [F.nullif(F.regexp_extract(t, p, 1), F.lit(""))
             for p in (SCORE_LABELLED, SCORE_BEFORE_SLASH, SCORE_BARE_LINE)]
    m = F.coalesce(*steps)
    num = F.nullif(F.regexp_extract(m, _NUMBER_PREFIX, 1), F.lit(""))
    return num.try_cast("double")


# Character references decoded in titles: all names of the HTML standard (the
# standard library's table; some are valid without the semicolon), the longest
# that fits, and numeric references of any length. The pattern only takes what may be a
# name; a look-up by first letter tells whether it is, or begins with, one.
HTML_ENTITY = rf"&(#[0-9]+;?|#[xX][0-9a-fA-F]+;?|[A-Za-z][A-Za-z0-9]{{1,{max(map(len, html5)) - 2}}};?)"
_NAMES = json.dumps({a: {n: c for n, c in html5.items() if n[0] == a} for a in sorted({n[0] for n in html5})})
_open = [len(n) for n in html5 if not n.endswith(";")]  # valid without the semicolon
_OPEN_LENGTHS = range(max(_open), min(_open) - 1, -1)
REPLACEMENT_CHAR = 0xFFFD
# Numeric references 0x80-0x9F name Windows-1252 characters (HTML parsing rules).
WINDOWS_1252 = {
    0x80: 0x20AC, 0x82: 0x201A, 0x83: 0x0192, 0x84: 0x201E, 0x85: 0x2026, 0x86: 0x2020,
    0x87: 0x2021, 0x88: 0x02C6, 0x89: 0x2030, 0x8A: 0x0160, 0x8B: 0x2039, 0x8C: 0x0152,
    0x8E: 0x017D, 0x91: 0x2018, 0x92: 0x2019, 0x93: 0x201C, 0x94: 0x201D, 0x95: 0x2022,
    0x96: 0x2013, 0x97: 0x2014, 0x98: 0x02DC, 0x99: 0x2122, 0x9A: 0x0161, 0x9B: 0x203A,
    0x9C: 0x0153, 0x9E: 0x017E, 0x9F: 0x0178,
}


def _code_point_text(n: Column) -> Column:
    """Code point -> one-character string (its UTF-32 bytes decoded); 0,
    surrogates and values above U+10FFFF become U+FFFD and 0x80-0x9F take their
    Windows-1252 meaning, as an HTML parser does."""
    valid = (n > 0) & (n <= 0x10FFFF) & ~((n >= 0xD800) & (n <= 0xDFFF))
    remap = F.create_map(*[F.lit(x) for kv in WINDOWS_1252.items() for x in kv])
    cp = F.when(valid, F.coalesce(F.try_element_at(remap, n.cast("int")).cast("long"), n)) \
          .otherwise(F.lit(REPLACEMENT_CHAR))
    return F.decode(F.unhex(F.lpad(F.hex(cp), 8, "0")), "UTF-32")


def _entity_text(e: Column) -> Column:
    """'#38;' / '#x26' / 'amp;' -> the character(s) it stands for."""
    is_hex = F.lower(F.substring(e, 2, 1)) == F.lit("x")
    digits = F.regexp_replace(e, "^#[xX]?0*|;$", "")
    # more digits than any code point has: out of range
    n = F.when(digits == "", F.lit("0")).when(F.length(digits) > 8, F.lit(str(0x110000))) \
         .when(is_hex, F.conv(digits, 16, 10)).otherwise(digits)
    def name(known: Column) -> Column:
        # the longest: all of it, or as much of its beginning as is valid without a semicolon
        found = [F.try_element_at(known, e)]
        found += [F.concat(F.try_element_at(known, F.substring(e, 1, k)), F.substring(e, k + 1, F.length(e))) for k in _OPEN_LENGTHS]
        return F.coalesce(*found, F.concat(F.lit("&"), e))

    # first letter -> name -> characters: one literal, parsed when the query is planned
    known = F.try_element_at(F.from_json(F.lit(_NAMES), "map<string,map<string,string>>"), F.substring(e, 1, 1))
    return (F.when(F.startswith(e, F.lit("#")), _code_point_text(n.cast("long")))
            .otherwise(F.transform(F.array(known), name)[0]))


def decode_entities(c: Column | str) -> Column:
    """Decode character references in one pass (``&amp;#38;`` gives ``&#38;``):
    split the text at each reference, decode the references, interleave."""
    text = col(c)
    c = F.when(F.contains(text, F.lit("&")), text)
    parts = F.split(c, HTML_ENTITY)
    decoded = F.transform(F.regexp_extract_all(c, F.lit(HTML_ENTITY), 1), _entity_text)
    tail = F.concat(decoded, F.array(F.lit("")))
    return F.coalesce(F.array_join(F.zip_with(parts, tail, lambda p, d: F.concat(p, d)), ""), text)


def page_title(html: Column | str) -> Column:
    """Document title from stored HTML: first <title> element, character
    references decoded, ASCII whitespace collapsed and trimmed; '' when there
    is none."""
    raw = F.regexp_extract(col(html), _TITLE, 1)
    return F.trim(F.regexp_replace(decode_entities(raw), _HTML_SPACE, " "))


def js_trim(c: Column) -> Column:
    """Without JavaScript white space at either end."""
    return F.regexp_replace(c, f"^[{JS_SPACE}]+|[{JS_SPACE}]+$", "")


def split_clean(c: Column | str, sep: str = ",") -> Column:
    """'a, b,,c ' -> ['a', 'b', 'c']: split, trim each item, drop empty items."""
    parts = F.split(col(c), re.escape(sep))
    trimmed = F.transform(parts, js_trim)
    return F.filter(trimmed, lambda x: x != F.lit(""))


def canonical_key(c: Column | str) -> Column:
    """Normalised lookup key: trimmed and lower-cased."""
    return F.lower(js_trim(col(c)))
