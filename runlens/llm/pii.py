"""Personal data and the terms that disclose it, with SQL functions only.

Base spans are e-mail addresses, IP addresses, card numbers and phone numbers.
Their values are the protected entities. Over the whole corpus, the words of the
texts that hold an entity are counted with it, wherever they stand; a word's
point-wise mutual information with the entity, as a share of the entity's own
information, says how much the word discloses. Words at or above ``DISCLOSED``
in texts that show the entity in at least ``SUPPORT`` different contexts (the
``CONTEXT`` characters on either side) get spans of their own in every text that
holds them. Counts are of distinct texts and contexts, so copies of one document
support nothing, and an entity of fewer contexts discloses by no word. ``sanitised`` replaces
base spans by their kind and generalises the words to the kind they disclose.

Patterns are written so that Java's matcher neither recurses nor rescans a run
of characters; they find what the stated ones find.

Defined cases: a null text has no spans (and stays null in ``sanitised``);
offsets are code points; where spans overlap, ``sanitised`` replaces their union
by the first one's kind; repeated rows and null ids are rows like others; extra
columns are kept by ``sanitised`` and not read else.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from runlens.llm.common import cut, text_of

#: Characters on either side that tell contexts apart; share of an entity's
#: information a term may disclose; different contexts needed.
CONTEXT, DISCLOSED, SUPPORT = 80, 0.95, 3
#: Term hashes (8 bytes each) that may be broadcast to thin out the corpus's words.
BROADCAST_TERMS = 1_000_000

_OCTET = "0*(?:25[0-5]|2[0-4][0-9]|1[0-9][0-9]|[0-9]?[0-9])"
_LOCAL = "A-Za-z0-9._%+-"
#: kind -> pattern, in order.
PATTERNS = {
    "email": rf"(?:(?<![{_LOCAL}])|\G)[{_LOCAL}]++@[A-Za-z0-9-]++(?:\.[A-Za-z0-9-]++)++",
    "ip": r"(?<![0-9])[0-9]++(?:\.[0-9]++){3}",
    "card": r"[0-9](?:[\x20-]?[0-9])++",
    "phone": r"\+[0-9][\x20().0-9-]+[0-9]",
}
_DIGITS = "[^0-9]"
#: What a text must contain for a kind to be looked for.
_HINT = {"email": "@", "phone": "+"}
#: A term is a word that starts with a letter, of three characters or more.
_TERM = r"\p{L}[\p{L}\p{N}]{2,}+"


def _valid(kind: str, value: Column) -> Column:
    digits = F.regexp_replace(value, _DIGITS, "")
    if kind == "ip":
        return value.rlike(rf"^{_OCTET}(?:\.{_OCTET}){{3}}$")
    if kind == "card":
        return F.length(digits).between(16, 19) & F.call_function("luhn_check", digits)
    if kind == "phone":
        return F.length(digits).between(8, 15)
    return F.lit(True)


#: Matches that are placed in one go; see ``_placed``.
BLOCK = 256


def _bound(value: Column, use) -> Column:
    """``use(value)`` with the value computed once, however often it is named."""
    return F.transform(F.array(value), use)[0]


def _placed(kind: str, matches: Column, gaps: Column) -> Column:
    """(kind, start, end, value) of each valid match, from the matches and the text between them.

    Lengths are summed within blocks of matches, then over blocks, and only valid matches are
    kept on the way: a text that is one long table of numbers takes time in proportion to its length.
    """
    n = lambda x: F.length(x).cast("long")
    span = "struct<kind:string,start:bigint,end:bigint,value:string>"

    def add(acc: Column, x: Column) -> Column:
        start = acc["at"] + n(x["gap"])
        end = start + n(x["value"])
        found = F.array(F.struct(F.lit(kind).alias("kind"), start.alias("start"), end.alias("end"), x["value"].alias("value")))
        return F.struct(end.alias("at"), F.when(_valid(kind, x["value"]), F.concat(acc["out"], found)).otherwise(acc["out"]).alias("out"))

    def blocks(pairs: Column) -> Column:
        nothing = F.struct(F.lit(0).cast("long").alias("at"), F.array().cast(f"array<{span}>").alias("out"))
        last = F.floor((F.size(pairs) - 1) / BLOCK).cast("int")
        return F.transform(F.sequence(F.lit(0), last), lambda b: F.aggregate(F.slice(pairs, b * BLOCK + 1, F.lit(BLOCK)), nothing, add))

    def joined(parts: Column) -> Column:
        zero = F.struct(F.lit(0).cast("long").alias("at"), F.array().cast("array<bigint>").alias("out"))
        starts = F.aggregate(parts, zero, lambda acc, x: F.struct(
            (acc["at"] + x["at"]).alias("at"), F.concat(acc["out"], F.array(acc["at"])).alias("out")))["out"]
        moved = F.zip_with(parts, starts, lambda x, by: F.transform(x["out"], lambda s: F.struct(
            s["kind"].alias("kind"), (s["start"] + by).alias("start"), (s["end"] + by).alias("end"), s["value"].alias("value"))))
        return F.flatten(moved)

    pairs = F.zip_with(F.slice(gaps, 1, F.size(matches)), matches, lambda g, m: F.struct(g.alias("gap"), m.alias("value")))
    return _bound(_bound(pairs, blocks), joined)


def with_base(docs: DataFrame) -> DataFrame:
    """``docs`` (text) with ``base``: array of (kind, start, end, value), by kind as listed, then start."""
    text = text_of()
    none = F.array().cast("array<struct<kind:string,start:bigint,end:bigint,value:string>>")
    out = docs
    for kind, pattern in PATTERNS.items():
        hint = text.contains(_HINT[kind]) if kind in _HINT else text.rlike("[0-9]")
        out = out.withColumn(f"_m_{kind}", F.when(hint, F.regexp_extract_all(text, F.lit(pattern), F.lit(0))))

    def spans_of(kind: str) -> Column:
        m = F.col(f"_m_{kind}")
        return F.when(F.size(m) > 0, _placed(kind, m, F.split(text, PATTERNS[kind], -1))).otherwise(none)

    return out.withColumn("base", F.concat(*map(spans_of, PATTERNS))).drop(*[f"_m_{k}" for k in PATTERNS])


def _key() -> Column:
    """Two hashes and the length name a text."""
    t = text_of()
    return F.struct(F.xxhash64(t).alias("a"), F.xxhash64(t, F.lit(1)).alias("b"), F.length(t).alias("n"))


def _terms(text: Column) -> Column:
    return F.array_distinct(F.regexp_extract_all(F.lower(text), F.lit(_TERM), F.lit(0)))


def _contexts(text: Column, base: Column) -> Column:
    """(kind, entity, context hash) of each base span."""
    def near(s: Column) -> Column:
        start, end = s["start"].cast("int"), s["end"].cast("int")
        before = text.substr(F.greatest(start - CONTEXT, F.lit(0)) + 1, F.least(start, F.lit(CONTEXT)))
        before = F.when(start > CONTEXT, F.regexp_replace(before, r"^\S*", "")).otherwise(before)
        after = text.substr(end + 1, F.lit(CONTEXT))
        after = F.when(F.length(after) == CONTEXT, F.regexp_replace(after, r"\S*$", "")).otherwise(after)
        words = F.regexp_replace(F.concat_ws(" ", before, after), PATTERNS["email"], " ")
        value = F.when(s["kind"] == "email", F.lower(s["value"])).when(s["kind"] == "ip", s["value"]).otherwise(F.regexp_replace(s["value"], _DIGITS, ""))
        return F.struct(s["kind"].alias("kind"), value.alias("entity"), F.xxhash64(words).alias("context"))

    return F.transform(base, near)


def disclosing(found: DataFrame, docs: DataFrame) -> DataFrame | None:
    """(key, kind, term): the disclosing terms of each distinct text that holds any; None if there is none.

    ``found``: key, contexts and terms (null without contexts) of each row of ``docs``.
    """
    each = found.select("key", F.explode("contexts").alias("c")).select("key", "c.*").distinct()
    total = found.agg(F.count_distinct("key")).first()[0]
    entities = each.groupBy("kind", "entity").agg(F.count_distinct("context").alias("contexts"), F.count_distinct("key").alias("df_e"))
    # a term has no more contexts than its entity has
    entities = cut(entities.where((F.col("contexts") >= SUPPORT) & (F.col("df_e") < total)).select("kind", "entity", "df_e"))
    widest = entities.agg(F.max("df_e")).first()[0]
    if widest is None:
        return None
    # SUPPORT contexts of a text say as much as all it has
    holders = each.groupBy("key", "kind", "entity").agg(F.slice(F.array_sort(F.collect_set("context")), 1, SUPPORT).alias("contexts")).join(entities, ["kind", "entity"])
    terms = (found.where("terms IS NOT NULL").join(holders.select("key").distinct(), "key", "left_semi")
             .select("key", F.explode("terms").alias("term")).distinct())
    # mutual >= DISCLOSED * information is co / df_t >= (df_e / total) ** (1 - DISCLOSED), and co <= df_e;
    # the holders' share of df_t already rules out most words
    least = F.pow(F.col("df_e") / total, F.lit(1 - DISCLOSED)) * (1 - 1e-9)
    some_t = terms.groupBy("term").agg(F.count("*").alias("some_t")).where(F.col("some_t") * (widest / total) ** (1 - DISCLOSED) * (1 - 1e-9) <= widest)
    pairs = terms.join(some_t, "term").join(holders, "key").where(F.col("some_t") * least <= F.col("df_e"))
    beside = pairs.select("kind", "entity", "term", "df_e", "some_t", F.posexplode("contexts").alias("at", "context")).groupBy("kind", "entity", "term", "df_e", "some_t").agg(
        F.count_distinct("context").alias("contexts"), F.count_if(F.col("at") == 0).alias("co"))
    beside = cut(beside.where((F.col("contexts") >= SUPPORT) & (F.col("co") >= F.col("some_t") * least)).drop("contexts", "some_t"))
    if not beside.limit(1).count():
        return None
    words = docs.select(_key().alias("key"), F.explode(_terms(text_of())).alias("term"))
    wanted = beside.select("term").distinct()
    if wanted.count() <= BROADCAST_TERMS:  # checked: at most 8 MB of hashes; the exact join follows either way
        some = wanted.select(F.xxhash64("term").alias("_h"))
        words = words.join(F.broadcast(some), F.xxhash64("term") == F.col("_h"), "left_semi")
    holding = cut(words.join(wanted, "term").distinct())
    df_t = holding.groupBy("term").agg(F.count("*").alias("df_t"))
    information = -F.log2(F.col("df_e") / total)
    mutual = F.log2(F.col("co") * F.lit(float(total)) / (F.col("df_e") * F.col("df_t")))
    told = (beside.join(df_t, "term")
            .where((information > 0) & (mutual >= DISCLOSED * information))
            .groupBy("term").agg(F.min("kind").alias("kind")))
    return holding.join(told, "term").select("key", "kind", "term")


def _term_spans(text: Column, terms: Column) -> Column:
    """(kind, start, end, value) of each whole-word occurrence of ``terms``."""
    pattern = F.concat(F.lit(r"(?iu)(?<![\p{L}\p{N}])(?:"), F.array_join(terms, "|"), F.lit(r")(?![\p{L}\p{N}])"))
    m = F.regexp_extract_all(text, pattern, F.lit(0))
    return F.when(F.size(m) > 0, _placed("term", m, F.split(text, pattern, -1)))


def with_spans(docs: DataFrame) -> DataFrame:
    """``docs`` with ``base`` and ``added``: the spans of disclosing terms, with the kind each discloses."""
    based = with_base(docs)
    words = _terms(F.regexp_replace(text_of(), PATTERNS["email"], " "))
    found = cut(based.select(_key().alias("key"), _contexts(text_of(), F.col("base")).alias("contexts"), F.when(F.size("base") > 0, words).alias("terms")))
    terms = disclosing(found, docs)
    kind_of = "map<string,string>"
    if terms is None:
        return based.withColumns({"added": F.array().cast("array<struct<kind:string,start:bigint,end:bigint,value:string>>"), "discloses": F.lit(None).cast(kind_of)})
    per = terms.groupBy("key").agg(F.map_from_entries(F.collect_set(F.struct("term", "kind"))).alias("discloses")).withColumnRenamed("key", "_key")
    joined = based.withColumn("_k", _key()).join(per, F.col("_k") == F.col("_key"), "left").drop("_k", "_key")
    spans = F.when(F.col("discloses").isNotNull(), _term_spans(text_of(), F.map_keys("discloses")))
    clear = F.filter(F.coalesce(spans, F.array().cast("array<struct<kind:string,start:bigint,end:bigint,value:string>>")),
                     lambda t: ~F.exists("base", lambda b: (b["start"] < t["end"]) & (t["start"] < b["end"])))
    return joined.withColumn("added", clear)


def report(docs: DataFrame) -> DataFrame:
    """doc_id, counts per kind, base_sha256 and spans of each row of ``docs`` (doc_id, text)."""
    shown = lambda s: F.concat_ws(":", s["kind"], s["start"], s["end"])

    def count(kind: str) -> Column:
        return F.size(F.filter("base", lambda s: s["kind"] == kind)).cast("long").alias(f"n_{kind}")

    return with_spans(docs.select("doc_id", "text")).select(
        "doc_id", *map(count, PATTERNS), F.sha2(F.array_join(F.transform("base", shown), ","), 256).alias("base_sha256"),
        F.array_join(F.transform(F.concat("base", "added"), shown), ",").alias("spans"))


def sanitised(docs: DataFrame) -> DataFrame:
    """``docs`` with every span of the text replaced; ``n_chars``, if there, follows."""
    columns = docs.columns
    rows = with_spans(docs.select(F.struct(*columns).alias("_row"), "text"))
    kind = lambda s: F.concat(F.lit("["), F.when(s["kind"] == "term", F.concat(F.element_at("discloses", F.lower(s["value"])), F.lit("-related"))).otherwise(s["kind"]), F.lit("]"))
    spans = F.array_sort(F.transform(F.concat("base", "added"), lambda s: F.struct(s["start"].alias("start"), s["end"].alias("end"), kind(s).alias("put"))))
    text = F.col("text")

    def put(acc: Column, s: Column) -> Column:
        at = acc["at"]
        piece = F.concat(text.substr(at.cast("int") + 1, (s["start"] - at).cast("int")), s["put"])
        return F.struct(F.greatest(at, s["end"]).alias("at"), F.when(s["start"] >= at, F.concat(acc["out"], F.array(piece))).otherwise(acc["out"]).alias("out"))

    def end(acc: Column) -> Column:
        return F.concat(F.array_join(acc["out"], ""), text.substr(acc["at"].cast("int") + 1, F.length(text)))

    start = F.struct(F.lit(0).cast("long").alias("at"), F.array().cast("array<string>").alias("out"))
    clean = F.when(F.size(spans) > 0, F.aggregate(spans, start, put, end)).otherwise(text)
    out = rows.withColumn("_clean", clean)
    new = {"text": F.col("_clean")} | ({"n_chars": F.length("_clean").cast(dict(docs.dtypes)["n_chars"])} if "n_chars" in columns else {})
    return out.select(*[new.get(c, F.col(f"_row.`{c}`")).alias(c) for c in columns])
