"""Metric maps: values by item, then by place or bin; and the summaries of headers that are such maps."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from geostrata.operators.quantiles import exact_quantiles

AGGREGATES = {
    "mean": F.avg, "avg": F.avg, "min": F.min, "max": F.max, "sum": F.sum, "std": F.stddev_samp, "var": F.var_samp, "median": F.median,
    "count": F.count, "first": F.first, "nunique": F.count_distinct,
}


def default_aggregate(lower_is_better: bool | None) -> str:
    """The worst value stands for a group; the mean where no direction is worse."""
    return {True: "max", False: "min", None: "mean"}[lower_is_better]


def aggregate(value: Column, agg) -> Column:
    """A named aggregate, or a callable from column to column: a grouped-aggregate Pandas UDF is one."""
    return AGGREGATES[agg](value) if isinstance(agg, str) else agg(value)


def fold_map(df: DataFrame, by: list[str]) -> DataFrame:
    return df.groupBy(*by).agg(F.count("*").alias("fold"))


def header_map(df: DataFrame, col: str, by: list[str], agg="mean", drop_duplicates: bool = False) -> DataFrame:
    df = df.select(*by, col).distinct() if drop_duplicates else df
    return df.groupBy(*by).agg(aggregate(F.col(col), agg).alias(col))


def item_map(df: DataFrame, value: str, index: list[str], coords: list[str], agg="mean") -> DataFrame:
    """One row per item: its coordinates, which have to agree within the item, and its value. List values are exploded first."""
    if df.schema[value].dataType.typeName() == "array":
        df = df.withColumn(value, F.explode(value))
    bounds = [x for c in coords for x in (F.min(c).alias(c), F.max(c).alias(f"_{c}_high"))]
    out = df.groupBy(*index).agg(*bounds, aggregate(F.col(value), agg).alias(value))
    same = F.lit(True)
    for c in coords:
        same = same & F.col(c).eqNullSafe(F.col(f"_{c}_high"))
    checked = F.when(same, F.col(value)).otherwise(F.raise_error(F.lit("an item has more than one place")).cast("double"))
    return out.select(*index, *coords, checked.alias(value))


def scatter_map(items: DataFrame, value: str, coords: list[str], agg="mean") -> DataFrame:
    """Items of equal place aggregated, with their number."""
    return items.groupBy(*coords).agg(aggregate(F.col(value), agg).alias(value), F.count("*").alias("n_items"))


def bin_map(items: DataFrame, value: str, coords: list[str], bin_size: list[float], agg="mean") -> DataFrame:
    """Items binned from the smallest coordinate on; bins are named by number and by their middle."""
    low = items.agg(*(F.min(c).alias(f"_{c}_low") for c in coords))
    placed = items.crossJoin(F.broadcast(low))  # one row of minima
    number = {c: F.floor((F.col(c) - F.col(f"_{c}_low")) / size).cast("long") for c, size in zip(coords, bin_size)}
    placed = placed.withColumns({f"{c}_bin": n for c, n in number.items()})
    middle = [(F.col(f"_{c}_low") + F.col(f"{c}_bin") * size + size // 2).alias(f"{c}_middle") for c, size in zip(coords, bin_size)]
    return placed.groupBy(*(f"{c}_bin" for c in coords), *(f"_{c}_low" for c in coords)).agg(aggregate(F.col(value), agg).alias(value), F.count("*").alias("n_items")).select(*(f"{c}_bin" for c in coords), *middle, value, "n_items")


def evaluate(items: DataFrame, value: str, agg="mean") -> DataFrame:
    return items.agg(aggregate(F.col(value), agg).alias(value))


def worst(items: DataFrame, value: str, by: list[str], lower_is_better: bool | None = None) -> DataFrame:
    """The place that is worst: highest, lowest, or furthest from the mean. Ties go to the smallest key."""
    if lower_is_better is None:
        center = items.agg(F.avg(value).alias("_mean"))
        return items.crossJoin(F.broadcast(center)).withColumn("_off", F.abs(F.col(value) - F.col("_mean"))).orderBy(F.desc("_off"), *by).limit(1).drop("_off", "_mean")
    return items.orderBy(F.desc(value) if lower_is_better else F.asc(value), *by).limit(1)


def append(a: DataFrame, b: DataFrame) -> DataFrame:
    return a.unionByName(b)


def centered_norm(items: DataFrame, value: str, quantile: float) -> DataFrame:
    """The mean and a quantile of absolute deviations from it: the range of a map's colours."""
    center = items.agg(F.avg(value).alias("center"))
    far = items.crossJoin(F.broadcast(center)).select(F.array(F.abs(F.col(value) - F.col("center"))).alias("far"))
    return center.crossJoin(exact_quantiles(far, "far", [quantile], names=["half_range"]))  # one row each


def histogram(df: DataFrame, value: str, low: float, high: float, bins: int) -> DataFrame:
    """Counts of equal bins of [low, high], the upper end included, from one pass."""
    b = F.least(F.floor((F.col(value) - low) / ((high - low) / bins)), F.lit(bins - 1)).cast("int")
    return df.where(F.col(value).between(low, high)).groupBy(b.alias("bin")).agg(F.count("*").alias("n"))
