"""Exact quantiles of groups of any size, by ranks.

A pass over the samples counts those between two bounds in bins and keeps each bin's number and extremes; a rank's next bounds are the
extremes of the bin that holds it. So every pass narrows a rank to a share of what was left, until ``LEAF`` samples at most, or equal ones,
are left, which one task sorts. Bins count on the map side: a pass shuffles a few numbers for each bin, never the samples.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from geostrata.functions.arrays import valid
from geostrata.sources.scratch import saved

BINS = 1024
#: Samples of one rank's bounds that a task sorts at most.
LEAF = 1 << 16
#: Ranks that are broadcast to the traces at most; more of them are joined by a shuffle.
BROADCAST_RANKS = 100_000


def _with(ranks: DataFrame, df: DataFrame, by: list[str]) -> DataFrame:
    """``df`` with its groups' ranks."""
    if not by:
        return df.crossJoin(F.broadcast(ranks))  # two ranks for each quantile asked for
    small = ranks.limit(BROADCAST_RANKS + 1).count() <= BROADCAST_RANKS
    named = ranks.withColumnsRenamed({c: f"_of_{c}" for c in by})
    same = F.lit(True)
    for c in by:
        same = same & F.col(c).eqNullSafe(F.col(f"_of_{c}"))
    return df.join(F.broadcast(named) if small else named, same).drop(*(f"_of_{c}" for c in by))


def _inside(data: str) -> Column:
    return F.filter(data, lambda x: (x >= F.col("_low")) & (x <= F.col("_high")))


def _bin(x: Column, low: Column, high: Column) -> Column:
    """A number that doesn't fall as x grows: the extremes have bins of their own, since bounds may be infinite."""
    middle = F.nanvl(F.floor((x - low) / (high - low) * (BINS - 2)).cast("double"), F.lit(0.0))
    return F.when(x <= low, 0).when(x >= high, BINS - 1).otherwise(1 + F.least(F.greatest(middle, F.lit(0.0)), F.lit(BINS - 3.0)).cast("int"))


def at_ranks(traces: DataFrame, by: list[str], ranks: DataFrame, leaf: int = LEAF) -> DataFrame:
    """by, rank, value: the ``rank``-th smallest sample (from 0) of a group, for rows (by, rank, _n, _low, _high) of ``ranks``.

    ``traces`` has by and ``x``, arrays of samples without missing ones.
    """
    state = saved(ranks.withColumn("_before", F.lit(0).cast("long")).withColumnRenamed("_n", "_in"), "ranks")
    open_ = (F.col("_in") > leaf) & (F.col("_low") < F.col("_high"))
    done = state.where(~open_)
    while not state.where(open_).isEmpty():
        wide = state.where(open_)
        binned = _with(wide, traces, by).select(*by, "rank", "_before", "_low", "_high", F.explode(_inside("x")).alias("v"))
        bins = binned.groupBy(*by, "rank", "_before", _bin(F.col("v"), F.col("_low"), F.col("_high")).alias("_bin")).agg(F.count("*").alias("_k"), F.min("v").alias("_min"), F.max("v").alias("_max"))
        upto = F.sum("_k").over(Window.partitionBy(*by, "rank").orderBy("_bin")) + F.col("_before")  # BINS rows for a rank
        found = bins.withColumn("_upto", upto).where((F.col("rank") < F.col("_upto")) & (F.col("rank") >= F.col("_upto") - F.col("_k")))
        state = saved(found.select(*by, "rank", F.col("_k").alias("_in"), F.col("_min").alias("_low"), F.col("_max").alias("_high"), (F.col("_upto") - F.col("_k")).alias("_before")), "ranks")
        done = done.unionByName(state.where(~open_))
    done = saved(done, "ranks")
    equal = done.where("_low = _high").select(*by, "rank", F.col("_low").alias("value"))
    rest = _with(done.where("_low < _high"), traces, by).select(*by, "rank", "_before", F.explode(_inside("x")).alias("v"))
    sorted_ = rest.groupBy(*by, "rank", "_before").agg(F.array_sort(F.collect_list("v")).alias("_all"))  # ``leaf`` samples at most
    return equal.unionByName(sorted_.select(*by, "rank", F.get("_all", (F.col("rank") - F.col("_before")).cast("int")).alias("value")))


def exact_quantiles(df: DataFrame, data_col: str, q: list[float], by: list[str] = (), names: list[str] | None = None, leaf: int = LEAF) -> DataFrame:
    """by and a column for each of ``q``, linear between the two nearest ranks; a group without samples has no row."""
    by, names = list(by), names or [f"q{v:g}".replace(".", "_") for v in q]
    traces = df.select(*by, valid(F.col(data_col)).alias("x")).where(F.size("x") > 0)
    groups = traces.groupBy(*by).agg(F.sum(F.size("x")).alias("_n"), F.min(F.array_min("x")).alias("_low"), F.max(F.array_max("x")).alias("_high"))
    groups = saved(groups.where("_n > 0"), "groups")
    place = [(F.col("_n") - 1) * F.lit(float(v)) for v in q]
    floors = [F.floor(p).cast("long") for p in place]
    both = F.array_distinct(F.array(*floors, *(F.least(f + 1, F.col("_n") - 1) for f in floors)))
    found = at_ranks(traces, by, groups.select(*by, "_n", "_low", "_high", F.explode(both).alias("rank")), leaf)
    values = found.groupBy(*by).agg(F.map_from_entries(F.collect_list(F.struct("rank", "value"))).alias("_at"))  # two for each quantile

    def between(p, f):
        low, high = F.element_at("_at", f), F.element_at("_at", F.least(f + 1, F.col("_n") - 1))
        return F.when(low == high, low).otherwise(low + (high - low) * (p - f))

    joined = groups.crossJoin(F.broadcast(values)) if not by else groups.join(values.withColumnsRenamed({c: f"_of_{c}" for c in by}), [F.col(c).eqNullSafe(F.col(f"_of_{c}")) for c in by])
    return joined.select(*by, *(between(p, f).alias(name) for p, f, name in zip(place, floors, names)))
