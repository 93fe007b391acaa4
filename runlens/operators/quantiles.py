"""Exact per-group quantiles by histogram refinement, one method at every size.

Three aggregates narrow down the value at each wanted rank:

1. a histogram per group over fixed logarithmic cells (4,096 to a factor of e),
2. for the cells that hold a wanted rank, one of 65,536 even steps between the
   cell's least and largest value,
3. for the steps that hold a wanted rank, the count of each distinct value.

A cell of one value is settled; only open cells go on, mostly none after the second
step. Cells follow the order of the values, so running counts over them give the ranks
each one covers. Every aggregate combines before its shuffle: a task sends a row per
cell, not per value, and no rows are sorted or range-partitioned. The last step
spans at most 2^24 distinct doubles, in practice the few of a 2^-28th of the value,
so no task holds a group whatever its share of the rows.

The input is read once for the first histogram, whose cells also carry the sums and
deviations, and once more for each later step; write it to a table first when it is
costly to compute. What is kept between the steps (the histogram; two cells at most for
each group and quantile) is checkpointed and the bytes of the open cells are counted:
up to ``BROADCAST_BYTES`` they are sent to every task, beyond that the same join
shuffles and AQE splits skewed parts.

``group_quantiles(..., method="approx")`` is the opt-in sketch
(``percentile_approx``: bounded memory, rank error 1/accuracy).
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Observation, Window
from pyspark.sql import functions as F

from runlens.operators.order import snapshot

BROADCAST_BYTES = 16 << 20
LOG_CELLS, STEPS = 4096, 65536
# ln of the least double is -744.4: with this added every magnitude's logarithm is positive
_LN_SHIFT = 746
_INF_CELL, _NAN_CELL = 1 << 40, 1 << 41
_V, _N, _ONE, _CELL = "_rl_v", "_rl_n", "_rl_one", "_rl_cell"
_LO, _HI, _LOW, _TOT = "_rl_lo", "_rl_hi", "_rl_low", "_rl_tot"
_FOUND = [_LO, _HI, _LOW, _TOT]
_ROW_BYTES = 96


def _log_cell(v: Column) -> Column:
    """Cell of a value: never falls as the value rises (NaN last, as Spark orders it)."""
    size = F.least(F.floor((F.log(F.abs(v)) + _LN_SHIFT) * LOG_CELLS), F.lit(_INF_CELL))
    return F.when(F.isnan(v), F.lit(_NAN_CELL)).when(v > 0, size).when(v < 0, -size).otherwise(F.lit(0).cast("long"))


def _step(v: Column, lo: Column, hi: Column) -> Column:
    """Which of the even steps from ``lo`` to ``hi`` a value is in."""
    return F.when(hi > lo, F.least(F.floor((v - lo) / (hi - lo) * STEPS), F.lit(STEPS - 1))).otherwise(F.lit(0).cast("long"))


def _ranks(p: float, tot: Column) -> tuple[Column, Column, Column]:
    """(fractional rank, the rank below, the rank above) of a quantile, from 0."""
    at = (tot - 1) * F.lit(float(p))
    return at, F.floor(at), F.ceil(at)


def _covers(rank: Column) -> Column:
    return (F.col(_LOW) <= rank) & (rank < F.col(_LOW) + F.col(_N))


def _cells(rows: DataFrame, group: list[str], cell: Column, more: list[Column] = []) -> DataFrame:
    """Rows counted by cell, with the least and largest value of each."""
    return rows.groupBy(*group, cell.alias(_CELL)).agg(
        F.count(_V).alias(_N), F.min(_V).alias("_min"), F.max(_V).alias("_max"), *more)


def _ranked(cells: DataFrame, group: list[str]) -> DataFrame:
    """Cells with the rank each one starts at (``_LOW``) and the group's count (``_TOT``)."""
    whole = Window.partitionBy(*group)
    before = F.sum(_N).over(whole.orderBy(_CELL).rowsBetween(Window.unboundedPreceding, Window.currentRow)) - F.col(_N)
    base = F.col(_LOW) if _LOW in group else F.lit(0).cast("long")
    tot = F.col(_TOT) if _TOT in group else F.sum(_N).over(whole)
    own = [g for g in group if g not in _FOUND]
    return cells.select(*own, F.col("_min").alias(_LO), F.col("_max").alias(_HI), (base + before).alias(_LOW),
                        tot.alias(_TOT), F.col(_N))


def _inside(vals: DataFrame, picked: DataFrame, own: list[str], small: bool) -> DataFrame:
    """The values that lie in one of the picked cells of their group."""
    right = picked.select(*[F.col(k).alias(f"_rl_k{i}") for i, k in enumerate(own)], *_FOUND,
                          _log_cell(F.col(_LO)).alias("_rl_at"))
    same = [F.col(k).eqNullSafe(F.col(f"_rl_k{i}")) for i, k in enumerate(own)]
    on = reduce(Column.__and__, same, (F.col(_CELL) == F.col("_rl_at")) & F.col(_V).between(F.col(_LO), F.col(_HI)))
    return (vals.withColumn(_CELL, _log_cell(F.col(_V)))
            .join(F.broadcast(right) if small else right, on).select(*own, _V, *_FOUND))


def _at_ranks(vals: DataFrame, histogram: DataFrame, own: list[str], probs: dict[str, float]) -> DataFrame:
    """One row per group: the quantiles of its values, narrowed down from ``histogram``."""
    some = reduce(Column.__or__, [_covers(r) for p in probs.values() for r in _ranks(p, F.col(_TOT))[1:]])
    width = reduce(Column.__add__, [F.coalesce(F.octet_length(F.col(k).cast("string")), F.lit(0)) for k in own])
    is_open = F.col(_LO) < F.col(_HI)

    def kept(cells: DataFrame) -> tuple[DataFrame, int | None]:
        """The cells that hold a wanted rank, and the bytes of the open ones (None: no open cell)."""
        seen = Observation()
        out = snapshot(cells.where(some).observe(seen, F.sum(F.when(is_open, width + F.lit(_ROW_BYTES))).alias("open")))
        return out, seen.get["open"]

    picked, size = kept(_ranked(histogram, own))
    settled = picked.where(~is_open)
    for cell in (_step(F.col(_V), F.col(_LO), F.col(_HI)), F.col(_V)):
        if size is None:
            break
        rows = _inside(vals, picked.where(is_open), own, size <= BROADCAST_BYTES)
        picked, size = kept(_ranked(_cells(rows, own + _FOUND, cell), own + _FOUND))
        settled = settled.unionByName(picked.where(~is_open))

    aggs, cols = [], []
    for i, (name, p) in enumerate(probs.items()):
        at, below, above = _ranks(p, F.col(_TOT))
        aggs += [F.max(F.when(_covers(r), F.col(_LO))).alias(f"_rl_{side}{i}") for side, r in (("b", below), ("a", above))]
        lo, hi = F.col(f"_rl_b{i}"), F.col(f"_rl_a{i}")
        cols.append(F.when(lo == hi, lo).otherwise(lo + (hi - lo) * (at - F.floor(at))).alias(name))
    return settled.groupBy(*own, _TOT).agg(*aggs).select(*own, *cols)


def value_stats(df: DataFrame, keys: list[str], value: str | Column, probs: dict[str, float],
                sums: dict[str, Column] | None = None, means: dict[str, Column] | None = None,
                mean: str | None = None, stddev: str | None = None,
                where: Column | None = None) -> DataFrame:
    """One row per group of ``keys``: quantiles of ``value`` (NULLs and rows
    outside ``where`` ignored; NULL when nothing is left), and over all rows
    the ``sums`` and ``means`` of the given expressions. ``mean`` / ``stddev``
    name the mean and sample deviation of ``value`` itself when wanted.
    """
    sums, means = sums or {}, means or {}
    v = (F.col(value) if isinstance(value, str) else value).cast("double")
    v = v if where is None else F.when(where, v)
    own = keys or [_ONE]
    rows = (df if keys else df.withColumn(_ONE, F.lit(1))).withColumn(_V, v)
    more = [F.sum(c).alias(f"_s_{n}") for n, c in sums.items()]
    more += [x for n, c in means.items() for x in (F.sum(c.cast("double")).alias(f"_m_{n}"), F.count(c).alias(f"_c_{n}"))]
    more += [F.sum(_V).alias("_x"), F.var_pop(_V).alias("_var")]
    # the cell of NULL values is NULL and counts none
    histogram = snapshot(_cells(rows, own, F.when(F.col(_V).isNotNull(), _log_cell(F.col(_V))), more))

    tot, by_key = F.sum(_N), Window.partitionBy(*own)
    centre = F.sum("_x").over(by_key) / F.nullif(tot.over(by_key), F.lit(0))
    off = F.col("_x") / F.nullif(F.col(_N), F.lit(0)) - F.col("_rl_centre")
    parts = [F.sum(f"_s_{n}").alias(n) for n in sums]
    parts += [(F.sum(f"_m_{n}") / F.nullif(F.sum(f"_c_{n}"), F.lit(0))).alias(n) for n in means]
    if mean:
        parts.append(F.max("_rl_centre").alias(mean))
    if stddev:
        dev = F.sum(F.col(_N) * (F.col("_var") + off * off))
        parts.append(F.when(tot > 1, F.sqrt(dev / F.nullif(tot - 1, F.lit(0)))).alias(stddev))
    stats = histogram.withColumn("_rl_centre", centre).groupBy(*own).agg(*(parts or [tot.alias(_N)]))

    vals = rows.select(*own, _V).where(F.col(_V).isNotNull())
    quantiles = _at_ranks(vals, histogram.where(F.col(_CELL).isNotNull()), own, probs)
    right = quantiles.select(*[F.col(k).alias(f"_rl_k{i}") for i, k in enumerate(own)], *probs)
    on = reduce(Column.__and__, [F.col(k).eqNullSafe(F.col(f"_rl_k{i}")) for i, k in enumerate(own)])
    # a row per group on either side
    return stats.join(right, on, "left").select(*keys, *sums, *means, *probs, *[c for c in (mean, stddev) if c])


def group_quantiles(df: DataFrame, keys: list[str], value: str, probs: dict[str, float],
                    method: str = "exact", accuracy: int = 10000) -> DataFrame:
    """One row per group that has a non-NULL value: ``keys`` + one column per prob."""
    vals = df.where(F.col(value).isNotNull())
    if method == "approx":
        return vals.groupBy(*keys).agg(*[F.percentile_approx(F.col(value).cast("double"), p, accuracy)
                                         .alias(n) for n, p in probs.items()])
    if method != "exact":
        raise ValueError(f"unknown quantile method {method!r}")
    return value_stats(vals, keys, value, probs)
