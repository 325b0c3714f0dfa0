"""Queries over headers.

``lineitem`` is the table of traces: ``l_orderkey`` is the record, ``l_linenumber`` the trace number, ``l_quantity`` the offset.
"""

from __future__ import annotations

from pyspark.sql import functions as F

from geostrata.operators import combine, headers, maps, supergathers, validation
from geostrata.plans.registry import query, table


def lines(spark, d):
    return table(spark, d, "lineitem")


@query("hdr_filter", "SELECT l_orderkey, l_linenumber, l_quantity FROM lineitem WHERE l_quantity > 25 AND l_discount < 0.05")
def hdr_filter(spark, d):
    return headers.filter_headers(lines(spark, d), lambda q, x: (q > 25) & (x < 0.05), ["l_quantity", "l_discount"]).select("l_orderkey", "l_linenumber", "l_quantity")


@query("hdr_filter_pandas", "SELECT l_orderkey, l_linenumber FROM lineitem WHERE l_quantity > 40")
def hdr_filter_pandas(spark, d):
    return headers.filter_headers(lines(spark, d), lambda q: q.map(lambda v: v > 40), ["l_quantity"], use_pandas=True).select("l_orderkey", "l_linenumber")


@query("hdr_apply", "SELECT l_orderkey, l_linenumber, CAST(CAST(l_extendedprice AS DECIMAL(12, 2)) * (1 - CAST(l_discount AS DECIMAL(4, 2))) AS DOUBLE) AS net FROM lineitem")
def hdr_apply(spark, d):
    return headers.apply_headers(lines(spark, d), lambda p, x: (p.cast("decimal(12,2)") * (1 - x.cast("decimal(4,2)"))).cast("double"), ["l_extendedprice", "l_discount"], ["net"]).select("l_orderkey", "l_linenumber", "net")


@query("hdr_apply_pandas", "SELECT l_orderkey, l_linenumber, l_quantity + l_linenumber AS total FROM lineitem")
def hdr_apply_pandas(spark, d):
    return headers.apply_headers(lines(spark, d), lambda a, b: a + b, ["l_quantity", "l_linenumber"], ["total"], "double").select("l_orderkey", "l_linenumber", "total")


@query("hdr_sort", "SELECT l_orderkey, l_partkey, l_suppkey, l_linenumber, row_number() OVER (PARTITION BY l_orderkey ORDER BY l_quantity, l_partkey, l_suppkey, l_linenumber) - 1 AS trace_pos FROM lineitem")
def hdr_sort(spark, d):
    df = headers.sort_gathers(lines(spark, d), ["l_orderkey"], ["l_quantity", "l_partkey", "l_suppkey"], "l_linenumber")
    return df.select("l_orderkey", "l_partkey", "l_suppkey", "l_linenumber", F.col("trace_pos").cast("long").alias("trace_pos"))


@query("get_gather", "SELECT l_linenumber, l_partkey, l_quantity FROM lineitem WHERE l_orderkey = 100")
def get_gather(spark, d):
    return headers.get_gather(lines(spark, d), ["l_orderkey"], (100,)).select("l_linenumber", "l_partkey", "l_quantity")


@query("get_gathers", "SELECT ask, l_orderkey, l_partkey, l_linenumber FROM lineitem JOIN (VALUES (0, 7), (1, 3), (2, 7)) t(ask, k) ON l_orderkey = k")
def get_gathers(spark, d):
    return headers.get_gathers(lines(spark, d), ["l_orderkey"], [(7,), (3,), (7,)], "l_linenumber").select("ask", "l_orderkey", "l_partkey", "l_linenumber")


@query("indices", "SELECT DISTINCT l_orderkey FROM lineitem")
def indices(spark, d):
    return headers.indices(lines(spark, d), ["l_orderkey"])


@query("subset_by_positions", "SELECT l_orderkey, count(*) AS n FROM lineitem WHERE l_orderkey IN (SELECT l_orderkey FROM (SELECT l_orderkey, row_number() OVER (ORDER BY l_orderkey) - 1 AS p FROM (SELECT DISTINCT l_orderkey FROM lineitem)) WHERE p IN (0, 5, 17)) GROUP BY l_orderkey")
def subset_by_positions(spark, d):
    return maps.fold_map(headers.subset_by_positions(lines(spark, d), ["l_orderkey"], [0, 5, 17]), ["l_orderkey"]).withColumnRenamed("fold", "n")


@query("counts", "SELECT count(*) AS n_traces, count(DISTINCT l_orderkey) AS n_gathers, CAST(floor(count(*) / count(DISTINCT l_orderkey)) AS BIGINT) AS fold FROM lineitem")
def counts(spark, d):
    return headers.counts(lines(spark, d), ["l_orderkey"])


@query("common_value", "SELECT l_orderkey, CASE WHEN min(l_suppkey) = max(l_suppkey) THEN min(l_suppkey) END AS l_suppkey FROM lineitem GROUP BY l_orderkey")
def common_value(spark, d):
    return headers.common_value(lines(spark, d), ["l_orderkey"], "l_suppkey")


_DRAWN = "CAST('0x' || substr(md5('{}:' || {}), 1, 12) AS BIGINT) / 281474976710656.0::DOUBLE"


@query("split_hash", f"WITH u AS (SELECT {_DRAWN.format(7, 'o_custkey')} AS u FROM orders) SELECT CASE WHEN u < 0.8 THEN 'train' WHEN u < 0.8 + 0.1 THEN 'test' ELSE 'validation' END AS split, count(*) AS n FROM u GROUP BY 1")
def split_hash(spark, d):
    return headers.split(table(spark, d, "orders"), ["o_custkey"], (0.8, 0.1, 0.1), 7).groupBy("split").agg(F.count("*").alias("n"))


@query("sample_gather", f"SELECT l_orderkey, l_linenumber, l_quantity FROM lineitem WHERE l_orderkey = (SELECT l_orderkey FROM lineitem ORDER BY {_DRAWN.format(3, 'l_orderkey')}, l_orderkey LIMIT 1)")
def sample_gather(spark, d):
    return headers.sample_gather(lines(spark, d), ["l_orderkey"], 3).select("l_orderkey", "l_linenumber", "l_quantity")


@query("fold_map", "SELECT l_orderkey, count(*) AS fold FROM lineitem GROUP BY l_orderkey")
def fold_map(spark, d):
    return maps.fold_map(lines(spark, d), ["l_orderkey"])


@query("header_map_max", "SELECT l_suppkey, max(l_quantity) AS l_quantity FROM lineitem GROUP BY l_suppkey")
def header_map_max(spark, d):
    return maps.header_map(lines(spark, d), "l_quantity", ["l_suppkey"], "max")


@query("header_map_distinct", "SELECT l_suppkey, sum(l_quantity) AS l_quantity FROM (SELECT DISTINCT l_suppkey, l_quantity FROM lineitem) GROUP BY l_suppkey")
def header_map_distinct(spark, d):
    return maps.header_map(lines(spark, d), "l_quantity", ["l_suppkey"], "sum", drop_duplicates=True)


@query("header_map_median", "SELECT l_suppkey, median(l_quantity) AS l_quantity FROM lineitem GROUP BY l_suppkey")
def header_map_median(spark, d):
    return maps.header_map(lines(spark, d), "l_quantity", ["l_suppkey"], "median")


@query("header_map_nunique", "SELECT l_suppkey, count(DISTINCT l_partkey) AS l_partkey FROM lineitem GROUP BY l_suppkey")
def header_map_nunique(spark, d):
    return maps.header_map(lines(spark, d), "l_partkey", ["l_suppkey"], "nunique")


def customer_items(spark, d):
    """One item per customer, at the point of its nation and the whole hundreds of its balance."""
    return table(spark, d, "customer").select("c_custkey", F.col("c_nationkey").cast("long").alias("x"), F.floor(F.col("c_acctbal") / 100).alias("y"), F.col("c_acctbal").alias("v"))


@query("item_map", "SELECT l_orderkey, min(l_orderkey % 7) AS x, max(l_quantity) AS l_quantity FROM lineitem GROUP BY l_orderkey")
def item_map(spark, d):
    return maps.item_map(lines(spark, d).withColumn("x", F.col("l_orderkey") % 7), "l_quantity", ["l_orderkey"], ["x"], "max")


@query("item_map_list", "SELECT label, round(max(x), 6) AS v FROM (SELECT label, unnest(embedding)::DOUBLE AS x FROM embeddings) GROUP BY label")
def item_map_list(spark, d):
    items = table(spark, d, "embeddings").select("label", F.col("label").alias("x"), F.col("embedding").cast("array<double>").alias("v"))
    return maps.item_map(items, "v", ["label"], ["x"], "max").select("label", F.round("v", 6).alias("v"))


_ITEMS = "c AS (SELECT c_custkey, CAST(c_nationkey AS BIGINT) AS x, CAST(floor(c_acctbal / 100) AS BIGINT) AS y, c_acctbal AS v FROM customer)"


@query("scatter_map", f"WITH {_ITEMS} SELECT x, y, max(v) AS v, count(*) AS n_items FROM c GROUP BY x, y")
def scatter_map(spark, d):
    return maps.scatter_map(customer_items(spark, d), "v", ["x", "y"], "max")


@query("bin_map", f"WITH {_ITEMS}, m AS (SELECT min(x) AS lx, min(y) AS ly FROM c) SELECT CAST(floor((x - lx) / 5) AS BIGINT) AS x_bin, CAST(floor((y - ly) / 20) AS BIGINT) AS y_bin, any_value(lx) + floor((x - lx) / 5)::BIGINT * 5 + 2 AS x_middle, any_value(ly) + floor((y - ly) / 20)::BIGINT * 20 + 10 AS y_middle, min(v) AS v, count(*) AS n_items FROM c, m GROUP BY 1, 2, floor((x - lx) / 5), floor((y - ly) / 20)")
def bin_map(spark, d):
    return maps.bin_map(customer_items(spark, d), "v", ["x", "y"], [5, 20], "min")


@query("map_reaggregate", f"WITH {_ITEMS}, s AS (SELECT x, y, max(v) AS v FROM c GROUP BY x, y) SELECT x, min(v) AS v FROM s GROUP BY x")
def map_reaggregate(spark, d):
    return maps.header_map(maps.scatter_map(customer_items(spark, d), "v", ["x", "y"], "max"), "v", ["x"], "min")


@query("map_worst", f"WITH {_ITEMS}, s AS (SELECT x, sum(CAST(v AS DECIMAL(18, 2)))::DOUBLE AS v FROM c GROUP BY x) SELECT x, v FROM s ORDER BY v DESC, x LIMIT 1")
def map_worst(spark, d):
    items = customer_items(spark, d).groupBy("x").agg(F.sum(F.col("v").cast("decimal(18,2)")).cast("double").alias("v"))
    return maps.worst(items, "v", ["x"], True)


@query("map_evaluate", f"WITH {_ITEMS} SELECT max(v) AS v FROM c")
def map_evaluate(spark, d):
    return maps.evaluate(customer_items(spark, d), "v", "max")


@query("map_append", f"WITH {_ITEMS} SELECT x, count(*) AS fold FROM (SELECT * FROM c UNION ALL SELECT * FROM c WHERE v < 0) GROUP BY x")
def map_append(spark, d):
    items = customer_items(spark, d)
    return maps.fold_map(maps.append(items, items.where("v < 0")), ["x"])


@query("header_histogram", "SELECT CAST(least(floor(l_quantity / 5), 9) AS INT) AS bin, count(*) AS n FROM lineitem WHERE l_quantity BETWEEN 0 AND 50 GROUP BY 1")
def header_histogram(spark, d):
    return maps.histogram(lines(spark, d), "l_quantity", 0, 50, 10)


@query("validate_report", """
WITH g AS (SELECT count(*) AS n FROM lineitem GROUP BY l_orderkey, l_linenumber), u AS (SELECT count(*) AS n, min(l_suppkey) <> max(l_suppkey) AS bad FROM lineitem GROUP BY l_partkey),
r AS (SELECT 'duplicate l_orderkey,l_linenumber' AS rule, CAST(sum(n) - count(*) AS BIGINT) AS n_bad, CAST(sum(n) AS BIGINT) AS n FROM g
UNION ALL SELECT 'negative c_acctbal', count(*) FILTER (c_acctbal < 0), count(*) FROM customer
UNION ALL SELECT 'l_discount and l_tax not zero together', count(*) FILTER ((abs(l_discount) <= 1e-8) <> (abs(l_tax) <= 1e-8)), count(*) FROM lineitem
UNION ALL SELECT 'several l_suppkey by l_partkey', count(*) FILTER (bad), count(*) FROM u
UNION ALL SELECT 'empty l_quantity', CAST(bool_and(l_quantity = 0) AS BIGINT), count(*) FROM lineitem UNION ALL SELECT 'empty l_tax', CAST(bool_and(l_tax = 0) AS BIGINT), count(*) FROM lineitem)
SELECT rule, n_bad, n, n_bad / n AS share FROM r""")
def validate_report(spark, d):
    df = lines(spark, d)
    return validation.report(
        validation.duplicates(df, ["l_orderkey", "l_linenumber"]), validation.negative(table(spark, d, "customer"), "c_acctbal"), validation.mismatch(df, "l_discount", "l_tax"),
        validation.unique_per_key(df, ["l_partkey"], "l_suppkey"), validation.empty_headers(df, ["l_quantity", "l_tax"]),
    )


def shots(spark, d):
    """A planar layout from order numbers: sources on a 50 m grid, receivers within it, offsets and midpoints partly wrong."""
    k, n = F.col("l_orderkey"), F.col("l_linenumber")
    sx, sy, gx, gy = k % 20 * 50, F.floor(k / 20) % 20 * 50, k % 13 * 25, n * 25
    return lines(spark, d).select(sx.cast("double").alias("sx"), sy.cast("double").alias("sy"), gx.cast("double").alias("gx"), gy.cast("double").alias("gy"), (F.hypot(sx - gx, sy - gy) + F.when(k % 10 == 0, 30).otherwise(0)).alias("offset"), ((sx + gx) / 2 + F.when(k % 7 == 0, 15).otherwise(0)).alias("cx"), ((sy + gy) / 2).alias("cy"))


_SHOTS = """s AS (SELECT l_orderkey AS k, l_orderkey % 20 * 50 AS sx, l_orderkey // 20 % 20 * 50 AS sy, l_orderkey % 13 * 25 AS gx, l_linenumber * 25 AS gy FROM lineitem)"""


@query("validate_geometry", f"WITH {_SHOTS}, r AS (SELECT 'offset differs from distance' AS rule, count(*) FILTER (k % 10 = 0) AS n_bad, count(*) AS n FROM s UNION ALL SELECT 'midpoint differs from CDP', count(*) FILTER (k % 7 = 0), count(*) FROM s) SELECT rule, n_bad, n, n_bad / n AS share FROM r")
def validate_geometry(spark, d):
    df = shots(spark, d)
    return validation.report(validation.offsets(df, ("sx", "sy"), ("gx", "gy"), "offset"), validation.midpoints(df, ("sx", "sy"), ("gx", "gy"), ("cx", "cy")))


@query("index_concat", "SELECT part, count(*) AS n FROM (SELECT 0 AS part FROM orders WHERE o_orderstatus = 'O' UNION ALL SELECT 1 FROM orders WHERE o_orderstatus <> 'O') GROUP BY part")
def index_concat(spark, d):
    o = table(spark, d, "orders")
    return combine.concat(o.where("o_orderstatus = 'O'"), o.where("o_orderstatus <> 'O'")).groupBy("part").agg(F.count("*").alias("n"))


@query("index_merge_1to1", "SELECT a.o_orderkey, a.o_totalprice AS before, b.o_totalprice * 2 AS after FROM orders a JOIN orders b USING (o_orderkey) WHERE b.o_orderkey % 3 = 0")
def index_merge_1to1(spark, d):
    o = table(spark, d, "orders").select("o_orderkey", "o_totalprice")
    m = combine.merge(o, o.where("o_orderkey % 3 = 0").withColumn("o_totalprice", F.col("o_totalprice") * 2), ["o_orderkey"])
    return m.select("o_orderkey", F.col("before.o_totalprice").alias("before"), F.col("after.o_totalprice").alias("after"))


@query("merge_filter_equal", "SELECT o_orderkey FROM orders WHERE o_custkey % 2 = 0")
def merge_filter_equal(spark, d):
    o = table(spark, d, "orders").select("o_orderkey", "o_custkey")
    m = combine.merge(o, o.withColumn("o_custkey", F.col("o_custkey") + F.col("o_custkey") % 2), ["o_orderkey"])
    return combine.filter_equal(m, ["before", "after"], ["o_custkey"]).select("o_orderkey")


@query("load_headers_inner", "SELECT l_orderkey, l_linenumber, l_partkey, o_totalprice FROM lineitem JOIN orders ON l_orderkey = o_orderkey")
def load_headers_inner(spark, d):
    t = table(spark, d, "orders").select(F.col("o_orderkey").cast("string").alias("l_orderkey"), "o_totalprice")
    return combine.load_headers(lines(spark, d), t, ["l_orderkey"]).select("l_orderkey", "l_linenumber", "l_partkey", "o_totalprice")


@query("load_headers_left", "SELECT l_orderkey, l_linenumber, l_partkey, o_totalprice AS l_quantity_loaded FROM lineitem LEFT JOIN orders ON l_orderkey = o_orderkey")
def load_headers_left(spark, d):
    t = table(spark, d, "orders").select(F.col("o_orderkey").alias("l_orderkey"), F.col("o_totalprice").alias("l_quantity"))
    return combine.load_headers(lines(spark, d), t, ["l_orderkey"], "left").select("l_orderkey", "l_linenumber", "l_partkey", "l_quantity_loaded")


@query("store_headers", "SELECT o_orderkey, CASE WHEN o_orderkey % 5 = 0 THEN -1 ELSE o_totalprice END AS o_totalprice, CASE WHEN o_orderkey % 5 = 0 THEN o_custkey END AS pick FROM orders")
def store_headers(spark, d):
    o = table(spark, d, "orders")
    found = o.where("o_orderkey % 5 = 0").select("o_orderkey", F.lit(-1.0).alias("o_totalprice"), F.col("o_custkey").alias("pick"))
    return combine.store_headers(o, found, ["o_orderkey"], ["o_totalprice", "pick"]).select("o_orderkey", "o_totalprice", "pick")


def bins(spark, d):
    return table(spark, d, "part").select("p_partkey", F.col("p_size").cast("long").alias("il"), (F.col("p_partkey") % 40).alias("xl"))


@query("supergathers", """
WITH b AS (SELECT p_partkey, CAST(p_size AS BIGINT) AS il, p_partkey % 40 AS xl FROM part),
c AS (SELECT DISTINCT il, xl FROM b WHERE il % 10 = 5 AND xl % 10 = 5)
SELECT p_partkey, c.il AS center_il, c.xl AS center_xl FROM b JOIN c ON b.il BETWEEN c.il - 1 AND c.il + 1 AND b.xl BETWEEN c.xl - 1 AND c.xl + 1""")
def supergathers_query(spark, d):
    out = supergathers.generate(bins(spark, d), ("il", "xl"), size=(3, 3), step=(10, 10), origin=(5, 5), border_indent=None)
    return out.select("p_partkey", F.col("center_il"), F.col("center_xl"))


@query("supergather_mask", """
WITH b AS (SELECT DISTINCT CAST(p_size AS BIGINT) AS il, p_partkey % 40 AS xl FROM part)
SELECT a.il, a.xl FROM b a JOIN b n ON n.il BETWEEN a.il - 1 AND a.il + 1 AND n.xl BETWEEN a.xl - 1 AND a.xl + 1 GROUP BY a.il, a.xl HAVING count(*) = 9""")
def supergather_mask(spark, d):
    return supergathers.eroded(bins(spark, d).select("il", "xl").distinct(), ("il", "xl"), (1, 1))


@query("optimal_origin", "WITH b AS (SELECT CAST(p_size AS BIGINT) AS il FROM part), o AS (SELECT il % 10 AS origin, count(*) AS n FROM b GROUP BY 1) SELECT origin, n FROM o ORDER BY n DESC, abs(origin - 5), origin LIMIT 1")
def optimal_origin(spark, d):
    return supergathers.optimal_origin(bins(spark, d), "il", 10)
