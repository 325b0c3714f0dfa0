"""Parts and surveys put together: union, one-to-one joins, and headers that come from or go to other tables."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def concat(*parts: DataFrame) -> DataFrame:
    """The parts one after another, each row with its part's number."""
    return reduce(DataFrame.unionByName, (p.withColumn("part", F.lit(i)) for i, p in enumerate(parts)))


def unique_or_fail(df: DataFrame, on: list[str]) -> DataFrame:
    """``df``, failing while it runs if a key repeats: the check is a count by key joined to the same keys, in the same stage."""
    counted = df.groupBy(*on).agg(F.count("*").alias("_n"), *(F.first(c).alias(c) for c in df.columns if c not in on))
    return counted.withColumn("_ok", F.when(F.col("_n") == 1, True).otherwise(F.raise_error(F.lit("merge keys are not unique")).cast("boolean"))).where("_ok").drop("_n", "_ok").select(*df.columns)


def merge(left: DataFrame, right: DataFrame, on: list[str], names: tuple[str, str] = ("before", "after"), validate_unique: bool = True) -> DataFrame:
    """Inner join of two parts on their keys; each survey's other headers go to a struct under its name."""
    left, right = (unique_or_fail(x, on) if validate_unique else x for x in (left, right))
    packed = [x.select(*on, F.struct(*(c for c in x.columns if c not in on)).alias(n)) for x, n in zip((left, right), names)]
    return packed[0].join(packed[1], on)


def filter_equal(merged: DataFrame, names: list[str], headers: list[str]) -> DataFrame:
    """Rows on whose headers all surveys agree."""
    kept = F.lit(True)
    for h in headers:
        for other in names[1:]:
            kept = kept & F.col(f"{names[0]}.{h}").eqNullSafe(F.col(f"{other}.{h}"))
    return merged.where(kept)


def load_headers(df: DataFrame, table: DataFrame, on: list[str], how: str = "inner") -> DataFrame:
    """Columns of another table joined to headers on keys cast to the headers' types; clashing names get ``_loaded``."""
    if how not in ("inner", "left"):
        raise ValueError("how is inner or left")
    table = table.select(*(F.col(c).cast(df.schema[c].dataType).alias(c) if c in on else F.col(c).alias(f"{c}_loaded" if c in df.columns else c) for c in table.columns))
    return df.join(table, on, how)


def store_headers(df: DataFrame, found: DataFrame, on: list[str], cols: list[str]) -> DataFrame:
    """New values of some rows put into the whole table: others keep theirs, a new column is null elsewhere."""
    renamed = found.select(*on, *(F.col(c).alias(f"_{c}_new") for c in cols))
    joined = df.join(renamed, on, "left")
    return joined.withColumns({c: F.coalesce(f"_{c}_new", F.col(c)) if c in df.columns else F.col(f"_{c}_new") for c in cols}).drop(*(f"_{c}_new" for c in cols))
