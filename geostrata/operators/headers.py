"""Trace headers as a table: selection, functions over columns, gathers by key, order and position."""

from __future__ import annotations

from collections.abc import Callable

import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from geostrata.sources.scratch import saved

#: Coordinate columns of a gather type, by its index columns in any order: fixed values.
INDEX_TO_COORDS = {
    "FieldRecord": ("SourceX", "SourceY"), "SourceX SourceY": ("SourceX", "SourceY"), "GroupX GroupY": ("GroupX", "GroupY"), "TRACE_SEQUENCE_FILE": ("CDP_X", "CDP_Y"), "FieldRecord TraceNumber": ("CDP_X", "CDP_Y"),
    "SourceX SourceY GroupX GroupY": ("CDP_X", "CDP_Y"), "CDP": ("CDP_X", "CDP_Y"), "CDP_X CDP_Y": ("CDP_X", "CDP_Y"), "INLINE_3D CROSSLINE_3D": ("INLINE_3D", "CROSSLINE_3D"),
    "SUPERGATHER_INLINE_3D SUPERGATHER_CROSSLINE_3D": ("SUPERGATHER_INLINE_3D", "SUPERGATHER_CROSSLINE_3D"),
}


def coords_of(index: list[str] | str, source_ids: list[str] | None = None, receiver_ids: list[str] | None = None) -> tuple[str, str]:
    """The coordinate columns of gathers by ``index``; a survey's own columns of source or receiver ids have the source's or the receiver's."""
    asked = {index} if isinstance(index, str) else set(index)
    known = [(set(k.split()), v) for k, v in INDEX_TO_COORDS.items()] + [(set(source_ids or ()), ("SourceX", "SourceY")), (set(receiver_ids or ()), ("GroupX", "GroupY"))]
    for columns, found in known:
        if asked and columns == asked:
            return found
    raise KeyError(f"no coordinates are known for an index of {sorted(asked)}")


def drawn(index: list[str], seed: int) -> Column:
    """An even number in [0, 1) for each key, the same in every engine: from the digits of a digest of the key and the seed."""
    digits = F.substring(F.md5(F.concat_ws(":", F.lit(str(seed)), *(F.col(c).cast("string") for c in index)).cast("binary")), 1, 12)
    return F.conv(digits, 16, 10).cast("long") / float(1 << 48)


def select(df: DataFrame, cols: list[str] | str) -> DataFrame:
    """Columns by name; an unknown name fails at once and not in a job."""
    cols = [cols] if isinstance(cols, str) else list(cols)
    if missing := set(cols) - set(df.columns):
        raise KeyError(f"no such headers: {sorted(missing)}")
    return df.select(*cols)


def filter_headers(df: DataFrame, condition: Callable | Column, cols: list[str] | None = None, use_pandas: bool = False) -> DataFrame:
    """Rows for which the condition holds: a Column, a callable from Columns to a Column, or, with ``use_pandas``, one from Series to booleans."""
    if isinstance(condition, Column):
        return df.where(condition)
    if not use_pandas:
        return df.where(condition(*(F.col(c) for c in cols)))

    @F.pandas_udf("boolean")
    def holds(*series: pd.Series) -> pd.Series:
        return pd.Series(condition(*series)).astype(bool)

    return df.where(holds(*(F.col(c) for c in cols)))


def apply_headers(df: DataFrame, function: Callable, cols: list[str], res_cols: list[str] | None = None, schema: str | None = None) -> DataFrame:
    """New columns from old ones: by Columns if the function takes them, else by pandas Series with the given ``schema``."""
    res_cols = res_cols or cols
    if schema is None:
        found = function(*(F.col(c) for c in cols))
        found = found if isinstance(found, (tuple, list)) else [found]
        return df.withColumns(dict(zip(res_cols, found, strict=True)))

    @F.pandas_udf(schema)
    def computed(*series: pd.Series) -> pd.DataFrame:
        out = function(*series)
        return pd.concat(out, axis=1, keys=res_cols) if isinstance(out, (tuple, list)) else out

    if len(res_cols) == 1:
        return df.withColumn(res_cols[0], computed(*(F.col(c) for c in cols)))
    return df.withColumn("_made", computed(*(F.col(c) for c in cols))).select(*(c for c in df.columns if c not in res_cols), *(F.col(f"_made.{c}").alias(c) for c in res_cols))


def isclose_all(df: DataFrame, a: str, b: str, rtol: float = 1e-5, atol: float = 1e-8) -> Column:
    return F.abs(F.col(a) - F.col(b)) <= atol + rtol * F.abs(F.col(b))


def indices(df: DataFrame, index: list[str]) -> DataFrame:
    return df.select(*index).distinct().orderBy(*index)


def contains(df: DataFrame, index: list[str], key: tuple) -> bool:
    return not df.where(gather_condition(index, key)).isEmpty()


def gather_condition(index: list[str], key: tuple) -> Column:
    out = F.lit(True)
    for c, v in zip(index, key, strict=True):
        out = out & (F.col(c) == F.lit(v))
    return out


def get_gather(df: DataFrame, index: list[str], key: tuple) -> DataFrame:
    """The traces of one gather; the condition reaches the scan."""
    return df.where(gather_condition(index, key))


#: Keys that are broadcast to the traces at most; more of them are joined by a shuffle.
BROADCAST_KEYS = 100_000


def get_gathers(df: DataFrame, index: list[str], keys: list[tuple], order: str) -> DataFrame:
    """The traces of the gathers asked for, in the order of asking, repeated if asked for twice."""
    spark = df.sparkSession
    schema = ", ".join(["ask long", *(f"`{c}` {df.schema[c].dataType.simpleString()}" for c in index)])
    asked = spark.createDataFrame([(i, *k) for i, k in enumerate(keys)], schema)
    return df.join(F.broadcast(asked) if len(keys) <= BROADCAST_KEYS else asked, index).orderBy("ask", *index, order)


def sample_gather(df: DataFrame, index: list[str], seed: int = 0) -> DataFrame:
    """The traces of one gather that the seed picks."""
    picked = df.select(*index).distinct().orderBy(drawn(index, seed), *index).limit(1)
    return df.join(F.broadcast(picked), index, "left_semi")


def sort_gathers(df: DataFrame, index: list[str], by: list[str], tie: str) -> DataFrame:
    """Traces numbered within each gather in the order of ``by``, ties as in the file."""
    return df.withColumn("trace_pos", F.row_number().over(Window.partitionBy(*index).orderBy(*by, tie)) - 1)


def gather_numbers(df: DataFrame, index: list[str]) -> DataFrame:
    """Each trace with the ordinal of its gather among all gathers: keys are ranked, not traces.

    Keys are sorted into ranges; a key's ordinal is its place in its range and the number of keys in the ranges before. So no task
    sees more than a range. The sorted keys are written once, as ranges come from a sample.
    """
    keys = saved(df.select(*index).distinct().orderBy(*index).withColumn("_at", F.monotonically_increasing_id()), "keys")  # partition and place in it
    keys = keys.withColumn("_range", F.shiftright("_at", 33)).withColumn("_place", F.col("_at").bitwiseAND(F.lit((1 << 33) - 1)))
    sizes = keys.groupBy("_range").agg(F.count("*").alias("_n"))
    before = sizes.select("_range", (F.sum("_n").over(Window.orderBy("_range")) - F.col("_n")).alias("_before"))  # a row for each range
    numbered = keys.join(F.broadcast(before), "_range").select(*index, (F.col("_before") + F.col("_place")).alias("gather_pos"))
    return df.join(numbered, index)


def subset_by_positions(df: DataFrame, index: list[str], positions: list[int]) -> DataFrame:
    return gather_numbers(df, index).where(F.col("gather_pos").isin(positions)).drop("gather_pos")


def counts(df: DataFrame, index: list[str]) -> DataFrame:
    """n_traces, n_gathers and the whole part of their ratio."""
    found = df.agg(F.count("*").alias("n_traces"), F.count_distinct(*index).alias("n_gathers"))
    return found.withColumn("fold", F.floor(F.try_divide(F.col("n_traces"), F.col("n_gathers"))).cast("long"))


def common_value(df: DataFrame, index: list[str], col: str) -> DataFrame:
    """A header of each gather if its traces agree on it, else null."""
    return df.groupBy(*index).agg(F.when(F.min(col) == F.max(col), F.min(col)).alias(col))


def split(df: DataFrame, index: list[str], shares: tuple[float, float, float], seed: int = 0) -> DataFrame:
    """A column ``split`` of train, test or validation, alike for all traces of a gather, by a hash of its key."""
    u = drawn(index, seed)
    return df.withColumn("split", F.when(u < shares[0], "train").when(u < shares[0] + shares[1], "test").otherwise("validation"))
