"""Header validation: a report of rules broken, each of them one aggregate."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from geostrata.operators.spatial import radius_pairs


def _report(df: DataFrame, rule: str, bad, total=None) -> DataFrame:
    return df.agg(F.lit(rule).alias("rule"), bad.cast("long").alias("n_bad"), (F.count("*") if total is None else total).cast("long").alias("n"))


def empty_headers(df: DataFrame, cols: list[str]) -> DataFrame:
    """rule, n_bad (1 if a header is 0 or null throughout), n: for every column, from one pass."""
    found = df.agg(F.count("*").alias("n"), *(F.every(F.coalesce(F.col(c) == 0, F.lit(True))).cast("long").alias(c) for c in cols))
    return found.select(F.explode(F.array(*(F.struct(F.concat(F.lit("empty "), F.lit(c)).alias("rule"), F.coalesce(F.col(c), F.lit(0)).alias("n_bad"), F.col("n").alias("n")) for c in cols))).alias("r")).select("r.*")


def duplicates(df: DataFrame, key: list[str]) -> DataFrame:
    groups = df.groupBy(*key).agg(F.count("*").alias("_n"))
    return _report(groups, "duplicate " + ",".join(key), F.coalesce(F.sum("_n") - F.count("*"), F.lit(0)), F.coalesce(F.sum("_n"), F.lit(0)))


def negative(df: DataFrame, col: str) -> DataFrame:
    return _report(df, f"negative {col}", F.count_if(F.col(col) < 0))


def mismatch(df: DataFrame, a: str, b: str) -> DataFrame:
    """A zero in one of two headers that should be zero together."""
    zero = lambda c: F.abs(F.col(c)) <= 1e-8
    return _report(df, f"{a} and {b} not zero together", F.count_if(zero(a) != zero(b)))


def offsets(df: DataFrame, source: tuple[str, str], receiver: tuple[str, str], offset: str, atol: float = 10.0) -> DataFrame:
    far = F.hypot(F.col(source[0]) - F.col(receiver[0]), F.col(source[1]) - F.col(receiver[1]))
    return _report(df, "offset differs from distance", F.count("*") - F.count_if(F.abs(far - F.col(offset)) <= atol))


def midpoints(df: DataFrame, source: tuple[str, str], receiver: tuple[str, str], cdp: tuple[str, str], atol: float = 10.0) -> DataFrame:
    off = F.hypot(*((F.col(s) + F.col(r)) / 2 - F.col(c) for s, r, c in zip(source, receiver, cdp)))
    return _report(df, "midpoint differs from CDP", F.count("*") - F.count_if(off <= atol))


def unique_per_key(df: DataFrame, key: list[str], col: str) -> DataFrame:
    """Keys that have more than one value of a header."""
    groups = df.groupBy(*key).agg((F.min(col) != F.max(col)).alias("_bad"))
    return _report(groups, f"several {col} by " + ",".join(key), F.count_if("_bad"))


def elevations(df: DataFrame, id_col: str, x: str, y: str, elevation: str, radius: float = 50.0, atol: float = 5.0) -> DataFrame:
    """Places whose elevation differs from the mean of those around them."""
    places = df.select(id_col, x, y, elevation).distinct()
    pairs = radius_pairs(places, places, radius, id_col, id_col, (x, y), (x, y), keep_right=[elevation])
    around = pairs.groupBy("left_id").agg((F.sum(F.col(elevation).cast("decimal(18,2)")) / F.count("*")).cast("double").alias("_mean"))
    return _report(places.join(around, places[id_col] == around["left_id"]), "elevation differs from its surroundings", F.count_if(F.abs(F.col(elevation) - F.col("_mean")) > atol))


def report(*rules: DataFrame) -> DataFrame:
    return reduce(DataFrame.unionByName, rules).withColumn("share", F.coalesce(F.try_divide(F.col("n_bad"), F.col("n")), F.lit(0.0)))
