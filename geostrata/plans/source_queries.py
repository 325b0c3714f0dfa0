"""Queries through files: what is written to the shared folder and read back, with the tables themselves as SQL twins."""

from __future__ import annotations

from pyspark.sql import functions as F

from geostrata.operators import combine
from geostrata.plans.plane_queries import _POINTS, suppliers
from geostrata.plans.registry import query, table
from geostrata.plans.trace_queries import _E, traces, with_offset
from geostrata.sources import segy, text
from geostrata.sources.scratch import scratch


def _written(spark, d, name):
    """The traces as SEG-Y files below the path that is returned; CDP is a trace's number."""
    segy.register(spark)
    path = scratch(spark, name)
    df = with_offset(traces(spark, d)).select(F.col("vec_id").cast("int").alias("CDP"), F.col("label").cast("int").alias("FieldRecord"), F.col("offset").cast("int").alias("offset"), F.col("embedding").alias("data"))
    df.write.format("segy").mode("append").option("sample_interval", 2.0).save(path)
    return path


@query("segy_round_trip", f"WITH {_E} SELECT CAST(vec_id AS INT) AS cdp, CAST(label AS INT) AS record, CAST(vec_id % 40 * 10 AS INT) AS off, i, round(x, 6) AS x FROM e")
def segy_round_trip(spark, d):
    back = spark.read.format("segy").option("headers", "CDP,FieldRecord,offset").load(_written(spark, d, "segy") + "/*.sgy")
    return back.select(F.col("CDP").alias("cdp"), F.col("FieldRecord").alias("record"), F.col("offset").alias("off"), F.posexplode("data").alias("i", "x")).select("cdp", "record", "off", F.col("i").cast("long").alias("i"), F.round(F.col("x").cast("double"), 6).alias("x"))


@query("segy_limits", f"WITH {_E} SELECT CAST(vec_id AS INT) AS cdp, CAST((i - 10) // 2 AS BIGINT) AS i, round(x, 6) AS x FROM e WHERE i >= 10 AND i < 60 AND (i - 10) % 2 = 0")
def segy_limits(spark, d):
    back = spark.read.format("segy").option("headers", "CDP").option("limits", "10:-4:2").load(_written(spark, d, "segy") + "/*.sgy")
    return back.select(F.col("CDP").alias("cdp"), F.posexplode("data").alias("i", "x")).select("cdp", F.col("i").cast("long").alias("i"), F.round(F.col("x").cast("double"), 6).alias("x"))


@query("segy_headers", "SELECT label AS record, count(*) AS n, CAST(sum(vec_id % 40 * 10) AS BIGINT) AS total FROM embeddings GROUP BY label")
def segy_headers(spark, d):
    back = spark.read.format("segy").option("headers", "FieldRecord,offset").option("data", "false").load(_written(spark, d, "segy") + "/*.sgy")
    return back.groupBy(F.col("FieldRecord").cast("long").alias("record")).agg(F.count("*").alias("n"), F.sum("offset").alias("total"))


@query("segy_aggregate", f"WITH {_E} SELECT count(DISTINCT vec_id) AS n, count(DISTINCT vec_id) AS last, CAST(sum(DISTINCT vec_id) AS BIGINT) AS total, round(sum(x * x), 3) AS energy FROM e")
def segy_aggregate(spark, d):
    path, out = _written(spark, d, "segy"), scratch(spark, "survey")
    segy.aggregate(spark, path + "/*.sgy", out)
    back = spark.read.format("segy").option("headers", "CDP").load(out + "/*.sgy")
    energy = F.aggregate(F.col("data").cast("array<double>"), F.lit(0.0), lambda acc, x: acc + x * x)
    return back.agg(F.count("*").alias("n"), F.max("TRACE_SEQUENCE_FILE").alias("last"), F.sum("CDP").alias("total"), F.round(F.sum(energy), 3).alias("energy"))


@query("segy_parent_headers", "SELECT md5(rpad('C 1 SURVEY OF ' || count(*) || ' TRACES', 3200, ' ')) AS text, md5(rpad('C 1 MORE ON ' || sum(vec_id), 3200, ' ')) AS extended, count(*) AS n_traces, true AS same_binary FROM embeddings")
def segy_parent_headers(spark, d):
    """Traces are dumped with the headers of a parent file, and these read again."""
    n, total = traces(spark, d).agg(F.count("*"), F.sum("vec_id")).first()
    segy.register(spark)
    df = traces(spark, d).select(F.col("vec_id").cast("int").alias("CDP"), F.col("embedding").alias("data"))
    parent, out = scratch(spark, "parent"), scratch(spark, "dump")
    df.coalesce(1).write.format("segy").mode("append").option("text", f"C 1 SURVEY OF {n} TRACES").option("extended", f"C 1 MORE ON {total}").save(parent)
    df.write.format("segy").mode("append").option("parent", parent + "/*.sgy").save(out)
    headers = lambda path: spark.read.format("segy_files").load(path + "/*.sgy").select("n_traces", F.md5(F.col("text").cast("binary")).alias("text"), "binary", F.col("extended_text").alias("pages"))
    first = headers(parent).select(F.col("binary").alias("parent_binary"))
    rows = headers(out).crossJoin(F.broadcast(first))  # one file
    counted = spark.read.format("segy").option("headers", "CDP").option("data", "false").load(out + "/*.sgy").select("file").groupBy("file").count().agg(F.sum("count").alias("n_traces"))
    same = rows.groupBy("text", F.md5(F.get("pages", F.lit(0)).cast("binary")).alias("extended")).agg(F.every(F.col("binary") == F.col("parent_binary")).alias("same_binary"))
    return same.crossJoin(counted)


for _fmt in ("fwf", "csv"):

    @query(f"table_{_fmt}", f"WITH {_POINTS} SELECT id, round(x, 3) AS x, round(y, 3) AS y FROM s")
    def table_file(spark, d, fmt=_fmt):
        path = scratch(spark, "table")
        text.write_table(suppliers(spark, d).select("id", "x", "y"), path, fmt, precision=3, header=True)
        return text.read_table(spark, path, ["id", "x", "y"], fmt=fmt, skiprows=1, types={"id": "bigint"})


@query("table_with_heading", f"WITH {_POINTS} SELECT y, id FROM (SELECT CAST(id AS DOUBLE) AS id, round(y, 3) AS y FROM s)")
def table_with_heading(spark, d):
    """Two columns by the names of a heading, numbers with decimal commas that nothing says."""
    path = scratch(spark, "table")
    text.write_table(suppliers(spark, d).select("id", "x", "y"), path, "fwf", precision=3, header=True, decimal=",")
    return text.read_table(spark, path, ["y", "id"], has_header=True, decimal=None)


@query("header_files", "SELECT o_orderkey, o_custkey, o_totalprice AS price FROM orders")
def header_files(spark, d):
    """Headers dumped to a text file and loaded again by their keys."""
    keys, path, o = ["o_orderkey", "o_custkey"], scratch(spark, "headers"), table(spark, d, "orders")
    text.write_table(o.select(*keys, F.col("o_totalprice").cast("double").alias("price")), path, "csv", precision=2)
    found = text.read_table(spark, path, [*keys, "price"], fmt="csv", types=dict.fromkeys(keys, "bigint"))
    return combine.load_headers(o.select(*keys), found, keys).select(*keys, "price")


@query("first_break_files", "SELECT o_orderkey, CASE WHEN o_orderkey % 3 > 0 THEN o_totalprice END AS first_break FROM orders")
def first_break_files(spark, d):
    """Picks of some traces dumped in columns of fixed width, decimal commas and all, and loaded again: traces without one stay."""
    path, o = scratch(spark, "picks"), table(spark, d, "orders")
    text.write_table(o.where("o_orderkey % 3 > 0").select("o_orderkey", F.col("o_totalprice").cast("double").alias("first_break")), path, decimal=",")
    found = text.read_table(spark, path, ["o_orderkey", "first_break"], decimal=",", types={"o_orderkey": "bigint"})
    return combine.load_headers(o.select("o_orderkey"), found, ["o_orderkey"], "left").select("o_orderkey", "first_break")


@query("vfunc_files", f"WITH {_POINTS} SELECT id, CAST(x AS BIGINT) AS line, unnest([0.0::DOUBLE, 500, 1000, 1500, 2000]) AS t, unnest([1500.0::DOUBLE + id, 1700 + id, 1900 + id * 2, 2100 + id, 2600 - id % 7]) AS v FROM s")
def vfunc_files(spark, d):
    i, path = F.col("id").cast("double"), scratch(spark, "vfuncs")
    times = F.array(*(F.lit(float(t)) for t in (0, 500, 1000, 1500, 2000)))
    models = suppliers(spark, d).select("id", F.col("x").cast("long").alias("line"), times.alias("t"), F.array(1500 + i, 1700 + i, 1900 + i * 2, 2100 + i, 2600 - i % 7).alias("v"))
    text.write_vfuncs(models, path, ("id", "line"), "t", "v")
    back = text.read_vfuncs(spark, path, ("id", "line"))
    return back.select("id", "line", F.explode(F.arrays_zip("x", "y")).alias("k")).select("id", "line", F.col("k.x").alias("t"), F.col("k.y").alias("v"))


@query("refractor_files", f"WITH {_POINTS} SELECT x, round(y, 2) AS y, id % 2 = 0 AS is_uphole_corrected, 10.0::DOUBLE + id % 5 AS t0, 100.0::DOUBLE + id AS x1, 1500.0::DOUBLE + id AS v1, 2500.0::DOUBLE + id AS v2 FROM (SELECT id, x, floor(y) AS y FROM s)")
def refractor_files(spark, d):
    i, path = F.col("id").cast("double"), scratch(spark, "refractors")
    models = suppliers(spark, d).select(F.lit("SourceX").alias("name_x"), F.lit("SourceY").alias("name_y"), "x", F.floor("y").cast("double").alias("y"), (F.col("id") % 2 == 0).alias("is_uphole_corrected"), (10 + i % 5).alias("t0"), (100 + i).alias("x1"), (1500 + i).alias("v1"), (2500 + i).alias("v2"))
    text.write_refractors(models, path)
    return text.read_refractors(spark, path, 2).drop("name_x", "name_y")
