"""Header tables, velocity functions and near-surface models in text files, read and written by Spark."""

from __future__ import annotations

import re

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F


def read_table(spark: SparkSession, path: str, columns: list[str] | None = None, usecols: list[int] | None = None, fmt: str = "fwf", sep: str = ",", skiprows: int = 0, decimal: str | None = ".", types: dict[str, str] | None = None, has_header: bool = False, encoding: str = "UTF-8") -> DataFrame:
    """A table of numbers separated by white space (``fwf``) or ``sep`` (``csv``): columns by name, chosen by position.

    Positions may be negative; they and the names are in ascending order of position. ``skiprows`` rows are skipped of every file; with
    ``has_header`` the next one is a heading, which gives the names, or those of ``columns`` are looked for in it. Without ``decimal``
    the sign is a comma where the first row of numbers of a ``fwf`` file has no point.
    """
    if columns is None and not has_header:
        raise ValueError("a table without a heading needs the names of its columns")
    if has_header or decimal is None:
        # a few rows of the first file tell what all are like
        top = [r.value for r in spark.read.option("encoding", encoding).text(path).limit(skiprows + has_header + 1).collect()]
        cells = lambda line: [c.strip() for c in (line.split() if fmt == "fwf" else line.split(sep))]
        if len(top) <= skiprows + has_header - 1:
            raise ValueError(f"{path} ends before its heading")
        if has_header:
            names = cells(top[skiprows])
            if usecols is not None:
                usecols = [i % len(names) for i in usecols]
                columns = columns or [names[i] for i in usecols]
            elif columns is not None:
                if missing := set(columns) - set(names):
                    raise ValueError(f"no such columns: {sorted(missing)}")
                usecols = [names.index(c) for c in columns]
            columns = columns or names
            skiprows += 1
        if decimal is None:
            decimal = "." if fmt == "csv" or len(top) <= skiprows or "." in top[-1] else ","
    if usecols is not None and any(a >= 0 and b >= 0 and a > b for a, b in zip(usecols, usecols[1:])) and not has_header:
        raise ValueError("positions are in ascending order")
    spark_text = spark.read.option("encoding", encoding)
    lines = spark_text.text(path)
    if skiprows:
        lines = lines.select("value", F.col("_metadata.file_path").alias("_file"), F.col("_metadata.file_block_start").alias("_at"), F.monotonically_increasing_id().alias("_n"))
        place = F.row_number().over(Window.partitionBy("_file").orderBy("_n"))  # a few rows of each file's beginning
        first = lines.where("_at = 0").select("_n", "_file", place.alias("_place")).where(F.col("_place") <= skiprows)
        lines = lines.join(first.select("_n"), "_n", "left_anti")
    value = F.trim("value")
    parts = F.split(value, r"\s+") if fmt == "fwf" else F.transform(F.split(value, re.escape(sep)), lambda s: F.trim(s))
    lines = lines.where(value != "").select(parts.alias("p"))
    at = usecols if usecols is not None else range(len(columns))

    def cell(i: int, name: str) -> Column:
        raw = F.element_at("p", i + 1 if i >= 0 else i)
        raw = F.replace(raw, F.lit(","), F.lit(".")) if decimal == "," else raw
        return raw.cast((types or {}).get(name, "double")).alias(name)

    return lines.select(*(cell(i, c) for i, c in zip(at, columns, strict=True)))


def write_table(df: DataFrame, path: str, fmt: str = "fwf", sep: str = ",", decimal: str = ".", precision: int = 2, min_width: int = 0, header: bool = False, append: bool = False) -> None:
    """Numbers with fixed decimals: right-justified to the widest of each column (``fwf``), or separated (``csv``)."""
    if fmt == "csv" and decimal != ".":
        raise ValueError("a csv file has decimal points")
    mode = "append" if append else "errorifexists"
    kinds = dict(df.dtypes)
    text = {c: (F.format_string(f"%.{precision}f", F.col(c)) if kinds[c] in ("double", "float") or kinds[c].startswith("decimal") else F.col(c).cast("string")) for c in df.columns}
    text = {c: F.coalesce(F.replace(v, F.lit("."), F.lit(",")) if decimal == "," else v, F.lit("nan")) for c, v in text.items()}
    rows = df.select(*(v.alias(c) for c, v in text.items()))
    if fmt == "csv":
        rows.write.mode(mode).option("header", header).option("sep", sep).csv(path)
        return
    widths = rows.agg(*(F.max(F.length(c)).alias(c) for c in df.columns)).first()
    width = {c: max(widths[c] or 0, min_width, len(c) if header else 0) for c in df.columns}
    body = rows.select(F.concat_ws(" ", *(F.lpad(c, width[c], " ") for c in df.columns)).alias("value"))
    if header:
        top = df.sparkSession.createDataFrame([(" ".join(c.rjust(width[c]) for c in df.columns),)], "value string")
        body = top.union(body).coalesce(1)  # a file with its names on top is one file
    body.write.mode(mode).text(path)


def read_vfuncs(spark: SparkSession, path: str, coords: tuple[str, str] = ("INLINE_3D", "CROSSLINE_3D")) -> DataFrame:
    """coords, x, y: the records ``VFUNC c1 c2`` of text files, each followed by pairs of knots; an odd count is an error."""
    records = spark.read.option("lineSep", "VFUNC").text(path).where(F.trim("value") != "")
    numbers = F.transform(F.split(F.trim(F.regexp_replace("value", r"\s+", " ")), " "), lambda s: s.cast("double"))
    parts = records.select(numbers.alias("n"))
    n = F.size("n")
    parts = parts.withColumn("n", F.when((n % 2 == 0) & (n > 2), F.col("n")).otherwise(F.raise_error(F.lit("a velocity function needs pairs of numbers")).cast("array<double>")))
    at = lambda first: F.transform(F.sequence(F.lit(first), n - 1, F.lit(2)), lambda i: F.get("n", i))
    return parts.select(F.get("n", F.lit(0)).cast("long").alias(coords[0]), F.get("n", F.lit(1)).cast("long").alias(coords[1]), at(2).alias("x"), at(3).alias("y"))


def write_vfuncs(df: DataFrame, path: str, coords: tuple[str, str] = ("INLINE_3D", "CROSSLINE_3D"), x: str = "x", y: str = "y") -> None:
    """Records of velocity functions, numbers rounded and 8 wide, four pairs to a line."""
    number = lambda v: F.format_string("%-8d", F.rint(v).cast("long"))
    pairs = F.zip_with(x, y, lambda a, b: F.concat(number(a), number(b)))
    lines = F.transform(F.sequence(F.lit(0), (F.size(x) - 1).cast("int"), F.lit(4)), lambda i: F.array_join(F.slice(pairs, i + 1, F.lit(4)), ""))
    head = F.concat(F.format_string("%-8s", F.lit("VFUNC")), number(F.col(coords[0])), number(F.col(coords[1])))
    df.select(F.concat_ws("\n", head, F.array_join(lines, "\n")).alias("value")).write.text(path)


def read_refractors(spark: SparkSession, path: str, n_refractors: int) -> DataFrame:
    """name_x, name_y, x, y, is_uphole_corrected, t0, x1.., v1.. from tables separated by white space, headings skipped."""
    names = ["t0", *(f"x{i}" for i in range(1, n_refractors)), *(f"v{i}" for i in range(1, n_refractors + 1))]
    p = F.split(F.trim("value"), r"\s+")
    rows = spark.read.text(path).where(F.trim("value") != "").select(p.alias("p")).where(F.get("p", F.lit(0)) != "name_x")
    kinds = {"name_x": "string", "name_y": "string", "x": "double", "y": "double", "is_uphole_corrected": "boolean"} | dict.fromkeys(names, "double")
    return rows.select(*((F.get("p", F.lit(i)) if kind == "string" else F.get("p", F.lit(i)).try_cast(kind)).alias(c) for i, (c, kind) in enumerate(kinds.items())))


def write_refractors(df: DataFrame, path: str) -> None:
    write_table(df.select(*(F.col(c).cast("string").alias(c) if t in ("string", "boolean") else F.col(c) for c, t in df.dtypes)), path, header=True)
