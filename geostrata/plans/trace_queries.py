"""Queries over traces: ``embeddings.embedding`` holds a trace's 64 samples, ``vec_id`` is its number and ``label`` its gather.

The sample interval is 2 ms and the delay 0; a trace's offset is 10 m times its number modulo 40.
"""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from geostrata.functions.arrays import limits, longest_run, samples
from geostrata.operators import crops, gathers, maps, moveout, qc, signal, velocity
from geostrata.plans.registry import query, table

N, DT = 64, 2.0
_E = "e AS (SELECT vec_id, label, unnest(embedding)::DOUBLE AS x, generate_subscripts(embedding, 1) - 1 AS i FROM embeddings)"
_M = "m AS (SELECT vec_id, min(label) AS label, avg(x) AS mean, stddev_pop(x) AS std, min(x) AS low, max(x) AS high, max(abs(x)) AS top FROM e GROUP BY vec_id)"


def traces(spark, sf_dir):
    return table(spark, sf_dir, "embeddings")


def with_offset(df):
    return df.withColumn("offset", (F.col("vec_id") % 40 * 10).cast("double"))


def _rounded(df, keep, col, digits=6, name="x"):
    """keep, i, x: the samples of an array column, one to a row."""
    return df.select(*keep, F.posexplode(col).alias("i", "_x")).select(*keep, F.col("i").cast("long").alias("i"), F.round("_x", digits).alias(name))


@query("qc_trace_basic", f"WITH {_E}, {_M} SELECT vec_id, CAST(abs(high - low) <= 1e-8 + 1e-5 * abs(low) AS DOUBLE) AS dead, round(abs(mean / (std + 1e-10)), 6) AS abs_mean, round(top / (std + 1e-10), 6) AS max_abs FROM m")
def qc_trace_basic(spark, d):
    return qc.qc(traces(spark, d), "embedding", ["dead", "abs_mean", "max_abs"]).select("vec_id", "dead", F.round("abs_mean", 6).alias("abs_mean"), F.round("max_abs", 6).alias("max_abs"))


@query("qc_map_by_gather", f"WITH {_E}, {_M} SELECT label, max(CAST(abs(high - low) <= 1e-8 + 1e-5 * abs(low) AS DOUBLE)) AS dead, round(max(abs(mean / (std + 1e-10))), 6) AS abs_mean, round(max(top / (std + 1e-10)), 6) AS max_abs, count(*) AS fold FROM m GROUP BY label")
def qc_map_by_gather(spark, d):
    df = qc.qc(traces(spark, d), "embedding", ["dead", "abs_mean", "max_abs"])
    return df.groupBy("label").agg(F.max("dead").alias("dead"), F.round(F.max("abs_mean"), 6).alias("abs_mean"), F.round(F.max("max_abs"), 6).alias("max_abs"), F.count("*").alias("fold"))


@query("qc_summary", f"WITH {_E}, {_M}, b AS (SELECT 'abs_mean' AS metric, count(*) FILTER (abs(mean / (std + 1e-10)) >= 0.1) AS n_bad, count(*) AS n FROM m UNION ALL SELECT 'dead', count(*) FILTER (abs(high - low) <= 1e-8 + 1e-5 * abs(low)), count(*) FROM m UNION ALL SELECT 'max_abs', count(*) FILTER (top / (std + 1e-10) >= 15), count(*) FROM m) SELECT metric, n_bad, round(n_bad / n, 6) AS share_bad FROM b")
def qc_summary(spark, d):
    names = ["abs_mean", "dead", "max_abs"]
    return qc.summary(qc.qc(traces(spark, d), "embedding", names), names).withColumn("share_bad", F.round("share_bad", 6))


@query("filter_by_metric", f"WITH {_E}, {_M} SELECT vec_id FROM m WHERE abs(mean / (std + 1e-10)) < 0.1")
def filter_by_metric(spark, d):
    return qc.filter_by_metric(qc.qc(traces(spark, d), "embedding", ["abs_mean"]), "abs_mean").select("vec_id")


@query("remove_dead", f"WITH {_E}, {_M} SELECT vec_id FROM m WHERE NOT abs(high - low) <= 1e-8 + 1e-5 * abs(low)")
def remove_dead(spark, d):
    return qc.remove_dead(traces(spark, d), "embedding").select("vec_id")


@query("spikes", f"WITH {_E}, s AS (SELECT vec_id, abs(2 * x - (lag(x) OVER w + lead(x) OVER w)) / 3 AS s FROM e WINDOW w AS (PARTITION BY vec_id ORDER BY i)) SELECT vec_id, round(max(s), 6) AS spikes FROM s GROUP BY vec_id")
def spikes(spark, d):
    return traces(spark, d).select("vec_id", F.round(qc.spikes(F.col("embedding")), 6).alias("spikes"))


@query("autocorrelation", f"WITH {_E}, s AS (SELECT vec_id, x * lag(x) OVER (PARTITION BY vec_id ORDER BY i) AS s FROM e) SELECT vec_id, round(avg(s), 8) AS autocorrelation FROM s GROUP BY vec_id")
def autocorrelation(spark, d):
    return traces(spark, d).select("vec_id", F.round(qc.autocorrelation(F.col("embedding")), 8).alias("autocorrelation"))


_CLIPPED = "c AS (SELECT vec_id, i, greatest(least(round(x * 10), 1), -1) AS x FROM e)"


def clipped(spark, d):
    """Traces whose samples are cut off at one step of 0.1, so that runs of equal values occur."""
    return traces(spark, d).select("vec_id", F.transform(samples(F.col("embedding")), lambda x: F.greatest(F.least(F.round(x * 10), F.lit(1.0)), F.lit(-1.0))).alias("data"))


@query("max_const_len", f"WITH {_E}, {_CLIPPED}, g AS (SELECT vec_id, x, i - row_number() OVER (PARTITION BY vec_id, x ORDER BY i) AS g FROM c), r AS (SELECT vec_id, count(*) AS n FROM g GROUP BY vec_id, x, g) SELECT vec_id, CAST(CASE WHEN max(n) > 1 THEN max(n) ELSE 0 END AS DOUBLE) AS max_const_len FROM r GROUP BY vec_id")
def max_const_len(spark, d):
    return clipped(spark, d).select("vec_id", qc.max_const_len(F.col("data")).alias("max_const_len"))


@query(
    "max_clips_len",
    f"""WITH {_E}, {_CLIPPED}, m AS (SELECT *, max(x) OVER p AS high, min(x) OVER p AS low FROM c WINDOW p AS (PARTITION BY vec_id)),
g AS (SELECT vec_id, x, high, low, i - row_number() OVER (PARTITION BY vec_id, x ORDER BY i) AS g FROM m), r AS (SELECT vec_id, x, high, low, count(*) AS n FROM g GROUP BY vec_id, x, g, high, low),
t AS (SELECT vec_id, coalesce(max(n) FILTER (x = high AND n > 1), 0) AS t, coalesce(max(n) FILTER (x = low AND n > 1), 0) AS b, any_value(high = low) AS flat FROM r GROUP BY vec_id)
SELECT vec_id, CAST(CASE WHEN flat THEN t + b ELSE greatest(t, b) END AS DOUBLE) AS max_clips_len FROM t""",
)
def max_clips_len(spark, d):
    return clipped(spark, d).select("vec_id", qc.max_clips_len(F.col("data")).alias("max_clips_len"))


_OFF = "o AS (SELECT vec_id, label, i, x, CAST(vec_id % 40 * 10 AS DOUBLE) AS off FROM e)"


@query("window_rms", f"WITH {_E}, {_OFF} SELECT label, round(sqrt(sum(x * x) FILTER (off BETWEEN 50 AND 300 AND i BETWEEN 10 AND 40) / nullif(count(*) FILTER (off BETWEEN 50 AND 300 AND i BETWEEN 10 AND 40), 0)), 8) AS rms FROM o GROUP BY label")
def window_rms(spark, d):
    df = qc.window_rms(with_offset(traces(spark, d)), "embedding", "offset", (50, 300), (20, 80), DT)
    return qc.rms_map(df, ["label"]).withColumn("rms", F.round("rms", 8))


@query("window_rms_ratio", f"WITH {_E}, {_OFF}, s AS (SELECT label, sqrt(avg(x * x) FILTER (off BETWEEN 0 AND 390 AND i BETWEEN 0 AND 20)) AS a, sqrt(avg(x * x) FILTER (off BETWEEN 0 AND 390 AND i BETWEEN 30 AND 60)) AS b FROM o GROUP BY label) SELECT label, round(a / b, 8) AS ratio FROM s")
def window_rms_ratio(spark, d):
    df = with_offset(traces(spark, d))
    df = qc.window_rms(qc.window_rms(df, "embedding", "offset", (0, 390), (0, 40), DT, prefix="a"), "embedding", "offset", (0, 390), (60, 120), DT, prefix="b")
    return qc.rms_ratio_map(df, ["label"], "a", "b").withColumn("ratio", F.round("ratio", 8))


@query("adaptive_window_rms", f"WITH {_E}, {_OFF}, w AS (SELECT vec_id, i, x, round_even((off / 5 + 6) / 2, 0)::INT AS mid FROM o), s AS (SELECT vec_id, x FROM w WHERE i >= least(greatest(mid - 5, 0), 63) AND i < least(greatest(mid + 5, 0), 63)) SELECT vec_id, round(sqrt(avg(x * x)), 8) AS rms FROM s GROUP BY vec_id")
def adaptive_window_rms(spark, d):
    df = qc.adaptive_window_rms(with_offset(traces(spark, d)), "embedding", F.col("offset") / 5, 20, 6, DT)
    return qc.rms_map(df.where("rms_n > 0"), ["vec_id"]).withColumn("rms", F.round("rms", 8))


@query("stats_global", f"WITH {_E} SELECT count(*) AS n, min(x) AS min, max(x) AS max, round(avg(x), 8) AS mean, round(stddev_pop(x), 8) AS std FROM e")
def stats_global(spark, d):
    return gathers.stats(traces(spark, d), "embedding").withColumns({"mean": F.round("mean", 8), "std": F.round("std", 8)})


@query("stats_by_gather", f"WITH {_E} SELECT label, count(*) AS n, min(x) AS min, max(x) AS max, round(avg(x), 8) AS mean, round(stddev_pop(x), 8) AS std FROM e GROUP BY label")
def stats_by_gather(spark, d):
    return gathers.stats(traces(spark, d), "embedding", ["label"]).withColumns({"mean": F.round("mean", 8), "std": F.round("std", 8)})


@query("stats_quantiles", f"WITH {_E} SELECT round(quantile_cont(x, 0.01), 8) AS q0_01, round(quantile_cont(x, 0.5), 8) AS q0_5, round(quantile_cont(x, 0.99), 8) AS q0_99 FROM e")
def stats_quantiles(spark, d):
    q = gathers.quantiles(traces(spark, d), "embedding", [0.01, 0.5, 0.99])
    return q.select(*(F.round(c, 8).alias(c) for c in q.columns))


@query("stats_quantiles_gather", f"WITH {_E} SELECT label, round(quantile_cont(x, 0.05), 8) AS q0_05, round(quantile_cont(x, 0.333), 8) AS q0_333, max(x) AS q1 FROM e GROUP BY label")
def stats_quantiles_gather(spark, d):
    q = gathers.quantiles(traces(spark, d), "embedding", [0.05, 0.333, 1.0], ["label"])
    return q.select("label", *(F.round(c, 8).alias(c) for c in ("q0_05", "q0_333")), "q1")


@query("trace_quantile", f"WITH {_E} SELECT vec_id, round(quantile_cont(x, 0.9), 8) AS q FROM e GROUP BY vec_id")
def trace_quantile(spark, d):
    return traces(spark, d).select("vec_id", F.round(gathers.trace_quantile(F.col("embedding"), 0.9), 8).alias("q"))


@query("scale_standard_trace", f"WITH {_E}, {_M} SELECT vec_id, i, round((x - mean) / (std + 1e-10), 6) AS x FROM e JOIN m USING (vec_id)")
def scale_standard_trace(spark, d):
    return _rounded(gathers.scale_standard(traces(spark, d), "embedding"), ["vec_id"], "scaled")


@query("scale_standard_gather", f"WITH {_E}, g AS (SELECT label, avg(x) AS mean, stddev_pop(x) AS std FROM e GROUP BY label) SELECT vec_id, i, round((x - mean) / (std + 1e-10), 6) AS x FROM e JOIN g USING (label)")
def scale_standard_gather(spark, d):
    return _rounded(gathers.scale_standard(traces(spark, d), "embedding", ["label"]), ["vec_id"], "scaled")


@query("scale_standard_global", f"WITH {_E}, g AS (SELECT avg(x) AS mean, stddev_pop(x) AS std FROM e) SELECT vec_id, i, round((x - mean) / (std + 1e-10), 6) AS x FROM e, g")
def scale_standard_global(spark, d):
    return _rounded(gathers.scale_standard(traces(spark, d), "embedding", []), ["vec_id"], "scaled")


@query("scale_maxabs", f"WITH {_E}, q AS (SELECT vec_id, greatest(abs(quantile_cont(x, 0.05)), abs(quantile_cont(x, 0.95))) AS s FROM e GROUP BY vec_id) SELECT vec_id, i, round(greatest(least(x / (s + 1e-10), 1), -1), 6) AS x FROM e JOIN q USING (vec_id)")
def scale_maxabs(spark, d):
    return _rounded(gathers.scale_maxabs(traces(spark, d), "embedding", 0.05, 0.95, clip=True), ["vec_id"], "scaled")


@query("scale_minmax", f"WITH {_E}, {_M} SELECT vec_id, i, round((x - low) / (high - low + 1e-10), 6) AS x FROM e JOIN m USING (vec_id)")
def scale_minmax(spark, d):
    return _rounded(gathers.scale_minmax(traces(spark, d), "embedding"), ["vec_id"], "scaled")


@query("scale_maxabs_gather", f"WITH {_E}, q AS (SELECT label, greatest(abs(quantile_cont(x, 0.05)), abs(quantile_cont(x, 0.95))) AS s FROM e GROUP BY label) SELECT vec_id, i, round(x / (s + 1e-10), 6) AS x FROM e JOIN q USING (label)")
def scale_maxabs_gather(spark, d):
    return _rounded(gathers.scale_maxabs(traces(spark, d), "embedding", 0.05, 0.95, by=["label"]), ["vec_id"], "scaled")


@query("scale_minmax_gather", f"WITH {_E}, q AS (SELECT label, min(x) AS low, max(x) AS high FROM e GROUP BY label) SELECT vec_id, i, round((x - low) / (high - low + 1e-10), 6) AS x FROM e JOIN q USING (label)")
def scale_minmax_gather(spark, d):
    return _rounded(gathers.scale_minmax(traces(spark, d), "embedding", by=["label"]), ["vec_id"], "scaled")


@query("scale_minmax_global", f"WITH {_E}, q AS (SELECT min(x) AS low, max(x) AS high FROM e) SELECT vec_id, i, round((x - low) / (high - low + 1e-10), 6) AS x FROM e, q")
def scale_minmax_global(spark, d):
    return _rounded(gathers.scale_minmax(traces(spark, d), "embedding", by=[]), ["vec_id"], "scaled")


_AGC = """c AS (SELECT i, greatest(4, least(i, 59)) AS j FROM range(64) t(i)), k AS (SELECT a.vec_id, c.i, count(*) FILTER (a.x <> 0) AS n, sum(a.x * a.x) AS q, sum(abs(a.x)) AS s
FROM e a JOIN c ON a.i BETWEEN c.j - 4 AND c.j + 4 GROUP BY a.vec_id, c.i)"""


@query("agc_rms", f"WITH {_E}, {_AGC} SELECT vec_id, i, round(x * sqrt(n / (q + 1e-15)), 5) AS x FROM e JOIN k USING (vec_id, i)")
def agc_rms(spark, d):
    return _rounded(gathers.apply_agc(traces(spark, d), "embedding", N, 16, DT), ["vec_id"], "gained", 5)


@query("agc_abs", f"WITH {_E}, {_AGC} SELECT vec_id, i, round(x * (n / (s + 1e-15)), 5) AS x FROM e JOIN k USING (vec_id, i)")
def agc_abs(spark, d):
    return _rounded(gathers.apply_agc(traces(spark, d), "embedding", N, 16, DT, "abs"), ["vec_id"], "gained", 5)


@query("agc_undo", f"WITH {_E} SELECT vec_id, i, round(x, 6) AS x FROM e")
def agc_undo(spark, d):
    return _rounded(gathers.undo_agc(gathers.apply_agc(traces(spark, d), "embedding", N, 16, DT), "gained", "agc_coefs"), ["vec_id"], "restored")


@query("sdc_apply", f"WITH {_E}, v AS (SELECT i, (2 * i) * (1594.3 + 2 * i * (1844.5 - 1594.3) / 600) ** 2 AS c FROM range(64) t(i)) SELECT vec_id, i, round(x * c / (SELECT c FROM v WHERE i = 63), 6) + 0 AS x FROM e JOIN v USING (i)")
def sdc_apply(spark, d):
    return _rounded(gathers.apply_sdc(traces(spark, d), "embedding", N, DT), ["vec_id"], "corrected")


@query("sdc_undo", f"WITH {_E} SELECT vec_id, i, CASE WHEN i > 0 THEN round(x, 6) END AS x FROM e")  # the gain at time 0 is 0, which can't be undone
def sdc_undo(spark, d):
    df = gathers.apply_sdc(gathers.apply_sdc(traces(spark, d), "embedding", N, DT), "corrected", N, DT, out="restored", undo=True)
    return _rounded(df, ["vec_id"], "restored").withColumn("x", F.when(~F.isnan("x"), F.col("x")))


@query("pick_to_mask", f"WITH {_E} SELECT vec_id, i, CAST(i >= round_even(((vec_id % 61) * 2.1 + 1) / 2, 0) AS INT) AS mask FROM e")
def pick_to_mask(spark, d):
    return traces(spark, d).select("vec_id", F.posexplode(gathers.pick_to_mask(F.col("vec_id") % 61 * F.lit(2.1) + 1, N, DT)).alias("i", "mask")).withColumn("i", F.col("i").cast("long"))


@query("mask_to_pick", f"WITH {_E}, g AS (SELECT vec_id, i, i - row_number() OVER (PARTITION BY vec_id ORDER BY i) AS g FROM e WHERE x >= 0.05), r AS (SELECT vec_id, min(i) AS s, count(*) AS n FROM g GROUP BY vec_id, g), b AS (SELECT vec_id, s, row_number() OVER (PARTITION BY vec_id ORDER BY n DESC, s) AS k FROM r) SELECT t.vec_id, coalesce(s, 0) * 2.0::DOUBLE AS pick FROM embeddings t LEFT JOIN b ON b.vec_id = t.vec_id AND k = 1")
def mask_to_pick(spark, d):
    return traces(spark, d).select("vec_id", gathers.mask_to_pick(samples(F.col("embedding")), DT, threshold=0.05).alias("pick"))


@query("mute", f"WITH {_E}, {_OFF} SELECT vec_id, i, round(CASE WHEN i >= round_even((20 + (off - 100) * 0.2) / 2, 0) THEN x ELSE 0 END, 6) AS x FROM o")
def mute(spark, d):
    df = with_offset(traces(spark, d))
    return _rounded(df.withColumn("muted", gathers.mute(F.col("embedding"), gathers.muting_time(F.col("offset"), ([100, 300], [20, 60])), DT, fill=0.0)), ["vec_id"], "muted")


_RV = "CASE WHEN off <= 100 THEN 10 + off * 1000 / 2000 ELSE 60 + (off - 100) * 1000 / 4000 END"


@query("refractor_time", f"SELECT vec_id, round({_RV}, 6) AS t FROM (SELECT vec_id, CAST(vec_id % 40 * 10 AS DOUBLE) AS off FROM embeddings)")
def refractor_time(spark, d):
    return with_offset(traces(spark, d)).select("vec_id", F.round(gathers.refractor_time(F.col("offset"), {"t0": 10, "x1": 100, "v1": 2000, "v2": 4000}), 6).alias("t"))


@query("lmo_shift", f"WITH {_E}, {_OFF}, s AS (SELECT vec_id, i, x, round_even((100 - ({_RV})) / 2, 0)::INT AS s FROM o), w AS (SELECT vec_id, i + s AS i, x FROM s) SELECT e.vec_id, e.i, round(coalesce(w.x, 0), 6) AS x FROM e LEFT JOIN w USING (vec_id, i)")
def lmo_shift(spark, d):
    df = gathers.apply_lmo(with_offset(traces(spark, d)), "embedding", "offset", {"t0": 10, "x1": 100, "v1": 2000, "v2": 4000}, DT, 100, 0.0)
    return _rounded(df, ["vec_id"], "corrected")


_NMO = """h AS (SELECT vec_id, label, off, i, sqrt((2.0 * i) ** 2 + (off / 2.0) ** 2) / 2 AS pos FROM o), c AS (SELECT h.vec_id, h.label, h.off, h.i, a.x * (1 - (pos - floor(pos))) + coalesce(b.x, 0) * (pos - floor(pos)) AS x
FROM h JOIN o a ON a.vec_id = h.vec_id AND a.i = floor(pos) LEFT JOIN o b ON b.vec_id = h.vec_id AND b.i = floor(pos) + 1 WHERE pos <= 63)"""


@query("nmo_constant", f"WITH {_E}, {_OFF}, {_NMO} SELECT e.vec_id, e.i, round(coalesce(c.x, 0), 6) AS x FROM e LEFT JOIN c USING (vec_id, i)")
def nmo_constant(spark, d):
    return _rounded(gathers.apply_nmo(with_offset(traces(spark, d)), "embedding", "offset", N, DT, 2000, fill=0.0), ["vec_id"], "corrected")


@query("nmo_stack", f"WITH {_E}, {_OFF}, {_NMO} SELECT label, i, round(avg(x), 6) AS stacked FROM c WHERE off < 2.0 * i * 2 * sqrt(1.65 ** 2 - 1) GROUP BY label, i")
def nmo_stack(spark, d):
    df = gathers.apply_nmo(with_offset(traces(spark, d)), "embedding", "offset", N, DT, 2000, max_stretch_factor=0.65)
    return gathers.stack(df, "corrected", ["label"]).select("label", F.col("i").cast("long").alias("i"), F.round("stacked", 6).alias("stacked"))


@query("nmo_variable", f"""
WITH {_E}, {_OFF}, v AS (SELECT i, 2.0::DOUBLE * i AS t, CASE WHEN i <= 30 THEN 1.8 + 2.0::DOUBLE * i * 0.2 / 60 ELSE 2.0 + (2.0::DOUBLE * i - 60) * 0.4 / 66 END AS v FROM range(64) r(i)),
g AS (SELECT i, t, v, (coalesce(lead(v) OVER (ORDER BY i), v) - coalesce(lag(v) OVER (ORDER BY i), v)) / (CASE WHEN i IN (0, 63) THEN 2 ELSE 4 END) AS g FROM v),
h AS (SELECT vec_id, label, off, i, x, t, sqrt(t * t + (off / v) * (off / v)) AS h, t - off * off * g / (v * v * v) AS z FROM o JOIN g USING (i)),
own AS (SELECT vec_id, label, off, max(CASE WHEN z <= 0 OR h > 1.65 * z THEN i ELSE -1 END) AS own FROM h GROUP BY vec_id, label, off),
last AS (SELECT vec_id, max(own) OVER (PARTITION BY label ORDER BY off RANGE BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW) AS last FROM own)
SELECT h.vec_id, h.i, round(CASE WHEN h.i <= last OR h.h > 126 THEN 0 ELSE a.x * (1 - (h.h / 2 - floor(h.h / 2))) + coalesce(b.x, 0) * (h.h / 2 - floor(h.h / 2)) END, 6) AS x
FROM h JOIN last USING (vec_id) LEFT JOIN e a ON a.vec_id = h.vec_id AND a.i = floor(h.h / 2) LEFT JOIN e b ON b.vec_id = h.vec_id AND b.i = floor(h.h / 2) + 1""")
def nmo_variable(spark, d):
    df = gathers.apply_nmo(with_offset(traces(spark, d)), "embedding", "offset", N, DT, ([0, 60, 126], [1800, 2000, 2400]), ["label"], 0.65, fill=0.0)
    return _rounded(df, ["vec_id"], "corrected")


@query("stack_mean", f"WITH {_E} SELECT label, i, round(avg(x), 6) AS stacked FROM e GROUP BY label, i")
def stack_mean(spark, d):
    return gathers.stack(traces(spark, d), "embedding", ["label"]).select("label", F.col("i").cast("long").alias("i"), F.round("stacked", 6).alias("stacked"))


@query("stack_amplified", f"WITH {_E} SELECT label, i, round(sum(x) * (0.3 / sqrt(count(*)) + 0.7 / count(*)), 6) AS stacked FROM e GROUP BY label, i")
def stack_amplified(spark, d):
    return gathers.stack(traces(spark, d), "embedding", ["label"], 0.3).select("label", F.col("i").cast("long").alias("i"), F.round("stacked", 6).alias("stacked"))


for _mode, _sql in {"S": "abs(sum(x)) / count(*) / (1 + 1e-8)", "NS": "abs(sum(x)) / (sum(abs(x)) + 1e-8)", "SEMBLANCE": "sum(x) ** 2 / count(*) / (sum(x * x) + 1e-8)", "CC": "(sum(x) ** 2 - sum(x * x)) / 2 / (1 + 1e-8)", "ENCC": "(sum(x) ** 2 - sum(x * x)) / greatest(count(*) - 1, 1) / (sum(x * x) + 1e-8)"}.items():

    @query(f"coherency_{_mode.lower()}", f"WITH {_E} SELECT label, i, round({_sql}, 6) AS coherency FROM e GROUP BY label, i")
    def coherency(spark, d, mode=_mode):
        return gathers.coherency(traces(spark, d), "embedding", ["label"], mode).select("label", F.col("i").cast("long").alias("i"), F.round("coherency", 6).alias("coherency"))


@query("semblance_window", f"WITH {_E}, p AS (SELECT label, i, sum(x) ** 2 / count(*) AS a, sum(x * x) AS b FROM e GROUP BY label, i) SELECT label, i, round(sum(a) OVER w / (sum(b) OVER w + 1e-8), 6) AS coherency FROM p WINDOW w AS (PARTITION BY label ORDER BY i ROWS BETWEEN 5 PRECEDING AND 4 FOLLOWING)")
def semblance_window(spark, d):
    return gathers.coherency(traces(spark, d), "embedding", ["label"], "SEMBLANCE", 5).select("label", F.col("i").cast("long").alias("i"), F.round("coherency", 6).alias("coherency"))


VELOCITIES = [1500.0, 1800.0, 2100.0, 2400.0, 3000.0]


@query("spectrum_small", f"""
WITH {_E}, {_OFF}, t AS (SELECT v - 1 AS v_ix, [1500.0, 1800, 2100, 2400, 3000][v]::DOUBLE / 1000 AS v FROM range(1, 6) r(v)),
h AS (SELECT vec_id, label, i, v_ix, sqrt((2.0 * i) ** 2 + (off / v) ** 2) / 2 AS pos FROM o, t),
c AS (SELECT h.label, h.i, v_ix, a.x * (1 - (pos - floor(pos))) + coalesce(b.x, 0) * (pos - floor(pos)) AS x
  FROM h LEFT JOIN e a ON a.vec_id = h.vec_id AND a.i = floor(pos) AND pos <= 63 LEFT JOIN e b ON b.vec_id = h.vec_id AND b.i = floor(pos) + 1 AND pos <= 63),
p AS (SELECT label, i, v_ix, CASE WHEN i = 63 THEN 0 ELSE coalesce(sum(x) ** 2 / count(x), 0) END AS a, CASE WHEN i = 63 THEN 0 ELSE coalesce(sum(x * x), 0) END AS b FROM c GROUP BY label, i, v_ix)
SELECT label, CAST(i AS INT) AS t_ix, CAST(v_ix AS INT) AS v_ix, round(sum(a) OVER w / (sum(b) OVER w + 1e-8), 6) AS value
FROM p WINDOW w AS (PARTITION BY label, v_ix ORDER BY i ROWS BETWEEN 5 PRECEDING AND 4 FOLLOWING)""")
def spectrum_small(spark, d):
    s = velocity.vertical_spectrum(with_offset(traces(spark, d)), ["label"], "embedding", "offset", VELOCITIES, DT, 20)
    return s.withColumn("value", F.round("value", 6))


def _residual_sql(low: str, high: str) -> str:
    """Each gather's function runs from ``low`` to ``high`` m/s; margins of 0.2, velocities 100 m/s apart, windows of 20 ms."""
    return f"""
WITH {_E}, {_OFF}, k AS (SELECT DISTINCT label FROM e), f AS (SELECT label, i, {low} + ({high} - ({low})) * i / 63.0::DOUBLE AS v0 FROM k, range(64) r(i)),
s AS (SELECT label, min(v0 * 0.8) AS first, CAST(ceil((max(v0 * 1.2) - min(v0 * 0.8)) / 100) AS BIGINT) + 1 AS n_v FROM f GROUP BY label),
g AS (SELECT label, unnest(range(n_v)) AS v_ix, first + 100.0::DOUBLE * unnest(range(n_v)) AS v FROM s),
d AS (SELECT label, i, v0, first, arg_min(v_ix, (abs(v - v0 * 0.8), v_ix)) AS low, arg_min(v_ix, (abs(v - v0 * 1.2), v_ix)) AS high FROM f JOIN s USING (label) JOIN g USING (label) GROUP BY ALL),
h AS (SELECT vec_id, label, i, v_ix, sqrt((2.0 * i) ** 2 + (off / (v / 1000)) ** 2) / 2 AS pos FROM o JOIN g USING (label)),
c AS (SELECT h.label, h.i, v_ix, a.x * (1 - (pos - floor(pos))) + coalesce(b.x, 0) * (pos - floor(pos)) AS x
  FROM h LEFT JOIN e a ON a.vec_id = h.vec_id AND a.i = floor(pos) AND pos <= 63 LEFT JOIN e b ON b.vec_id = h.vec_id AND b.i = floor(pos) + 1 AND pos <= 63),
p AS (SELECT label, i, v_ix, CASE WHEN i = 63 THEN 0 ELSE coalesce(sum(x) ** 2 / count(x), 0) END AS a, CASE WHEN i = 63 THEN 0 ELSE coalesce(sum(x * x), 0) END AS b FROM c GROUP BY label, i, v_ix),
w AS (SELECT label, i, v_ix, sum(a) OVER w / (sum(b) OVER w + 1e-8) AS value FROM p WINDOW w AS (PARTITION BY label, v_ix ORDER BY i ROWS BETWEEN 5 PRECEDING AND 4 FOLLOWING)),
m AS (SELECT d.*, m_ix, -0.2 + m_ix * 0.4 / (n_m - 1) AS margin FROM d JOIN (SELECT label, max(high - low) AS n_m FROM d GROUP BY label) USING (label), LATERAL (SELECT unnest(range(n_m)) AS m_ix)),
q AS (SELECT *, least(greatest((v0 * (1 + margin) - first) / 100, low), high) AS pos FROM m)
SELECT q.label, CAST(q.i AS INT) AS t_ix, CAST(m_ix AS INT) AS m_ix, round(margin, 6) AS margin, round(a.value * (1 - (pos - floor(pos))) + coalesce(b.value, 0) * (pos - floor(pos)), 5) AS value
FROM q JOIN w a ON a.label = q.label AND a.i = q.i AND a.v_ix = floor(pos) LEFT JOIN w b ON b.label = q.label AND b.i = q.i AND b.v_ix = floor(pos) + 1"""


def _residual(df, models):
    s = moveout.residual_spectra(df, models, ["label"], "embedding", "offset", DT, N, "t", "v", 0.2, 100, 20)
    return s.withColumns({"margin": F.round("margin", 6), "value": F.round("value", 5)})


def gather_velocities(spark, d, constant=False):
    """A velocity function per label: 1800 m/s to 2400 m/s over the trace, faster by 10 and 30 m/s with each label unless constant."""
    k = F.lit(0.0) if constant else F.col("label").cast("double")
    return traces(spark, d).select("label").distinct().select("label", F.array(F.lit(0.0), F.lit(126.0)).alias("t"), F.array(1800 + 10 * k, 2400 + 30 * k).alias("v"))


@query("spectrum_residual", _residual_sql("1800", "2400"))
def spectrum_residual(spark, d):
    return _residual(with_offset(traces(spark, d)), gather_velocities(spark, d, constant=True))


@query("residual_field", _residual_sql("1800 + 10 * label", "2400 + 30 * label"))
def residual_field(spark, d):
    return _residual(with_offset(traces(spark, d)), gather_velocities(spark, d))


@query("nmo_field", f"""
WITH {_E}, {_OFF}, k AS (SELECT DISTINCT label FROM e), v AS (SELECT label, i, 2.0::DOUBLE * i AS t, (1800 + 10 * label + (600 + 20 * label) * i / 63.0::DOUBLE) / 1000 AS v FROM k, range(64) r(i)),
g AS (SELECT label, i, t, v, (coalesce(lead(v) OVER w, v) - coalesce(lag(v) OVER w, v)) / (CASE WHEN i IN (0, 63) THEN 2 ELSE 4 END) AS g FROM v WINDOW w AS (PARTITION BY label ORDER BY i)),
h AS (SELECT vec_id, label, off, i, x, t, sqrt(t * t + (off / v) * (off / v)) AS h, t - off * off * g / (v * v * v) AS z FROM o JOIN g USING (label, i)),
own AS (SELECT vec_id, label, off, max(CASE WHEN z <= 0 OR h > 1.65 * z THEN i ELSE -1 END) AS own FROM h GROUP BY vec_id, label, off),
last AS (SELECT vec_id, max(own) OVER (PARTITION BY label ORDER BY off RANGE BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW) AS last FROM own)
SELECT h.vec_id, h.i, round(CASE WHEN h.i <= last OR h.h > 126 THEN 0 ELSE a.x * (1 - (h.h / 2 - floor(h.h / 2))) + coalesce(b.x, 0) * (h.h / 2 - floor(h.h / 2)) END, 6) AS x
FROM h JOIN last USING (vec_id) LEFT JOIN e a ON a.vec_id = h.vec_id AND a.i = floor(h.h / 2) LEFT JOIN e b ON b.vec_id = h.vec_id AND b.i = floor(h.h / 2) + 1""")
def nmo_field(spark, d):
    df = moveout.nmo_by_model(with_offset(traces(spark, d)), gather_velocities(spark, d), ["label"], "embedding", "offset", N, DT, max_stretch_factor=0.65, fill=0.0)
    return _rounded(df, ["vec_id"], "corrected")


_GATHER_RV = "CASE WHEN off <= 100 + 10 * label THEN 10 + label + off * 1000 / (2000 + 50 * label) ELSE 10 + label + (100 + 10 * label) * 1000 / (2000 + 50.0::DOUBLE * label) + (off - 100 - 10 * label) * 1000 / (4000 + 100 * label) END"


@query("lmo_field", f"WITH {_E}, {_OFF}, s AS (SELECT vec_id, i, x, round_even((100.37::DOUBLE - ({_GATHER_RV}) + vec_id % 3) / 2, 0)::INT AS s FROM o), w AS (SELECT vec_id, i + s AS i, x FROM s) SELECT e.vec_id, e.i, round(coalesce(w.x, 0), 6) AS x FROM e LEFT JOIN w USING (vec_id, i)")
def lmo_field(spark, d):
    k = F.col("label").cast("double")
    models = traces(spark, d).select("label").distinct().select("label", (10 + k).alias("t0"), (100 + 10 * k).alias("x1"), (2000 + 50 * k).alias("v1"), (4000 + 100 * k).alias("v2"), F.lit(True).alias("is_uphole_corrected"))
    df = with_offset(traces(spark, d)).withColumn("uphole", (F.col("vec_id") % 3).cast("double"))
    return _rounded(moveout.lmo_by_model(df, models, ["label"], "embedding", "offset", 2, DT, 100.37, 0.0, "uphole"), ["vec_id"], "corrected")


@query("velocity_pick")
def velocity_pick(spark, d):
    s = velocity.vertical_spectrum(with_offset(traces(spark, d)), ["label"], "embedding", "offset", VELOCITIES, DT, 20)
    picked = velocity.stacking_velocities(s, ["label"], VELOCITIES, DT, times_step=20)
    return picked.select("label", F.explode(F.arrays_zip("times", "velocities")).alias("k")).select("label", F.col("k.times").alias("t"), F.col("k.velocities").alias("v"))


@query("signal_leakage", f"""
WITH {_E}, {_OFF}, t AS (SELECT v - 1 AS v_ix, [1500.0, 1800, 2100][v]::DOUBLE / 1000 AS v FROM range(1, 4) r(v)),
h AS (SELECT vec_id, label, i, v_ix, sqrt((2.0 * i) ** 2 + (off / v) ** 2) / 2 AS pos FROM o, t),
c AS (SELECT h.label, h.i, v_ix, a.x * (1 - (pos - floor(pos))) + coalesce(b.x, 0) * (pos - floor(pos)) AS x
  FROM h LEFT JOIN e a ON a.vec_id = h.vec_id AND a.i = floor(pos) AND pos <= 63 LEFT JOIN e b ON b.vec_id = h.vec_id AND b.i = floor(pos) + 1 AND pos <= 63),
p AS (SELECT label, i, v_ix, CASE WHEN i = 63 THEN 0 ELSE coalesce(sum(x) ** 2 / count(x), 0) END AS a, CASE WHEN i = 63 THEN 0 ELSE coalesce(sum(x * x), 0) END AS b FROM c GROUP BY label, i, v_ix),
w AS (SELECT label, i, v_ix, sum(a) OVER w / (sum(b) OVER w + 1e-8) AS b, sum(a * 0.01) OVER w / (sum(b * 0.01) OVER w + 1e-8) AS d FROM p WINDOW w AS (PARTITION BY label, v_ix ORDER BY i ROWS BETWEEN 13 PRECEDING AND 12 FOLLOWING)),
r AS (SELECT label, i, max(b) - min(b) AS b, max(d) - min(d) AS d FROM w GROUP BY label, i)
SELECT label, round(greatest(max(d / (1 + 1e-6 - b)), 0), 4) AS leakage FROM r GROUP BY label""")
def signal_leakage(spark, d):
    df = with_offset(traces(spark, d))
    after = df.withColumn("embedding", F.transform(samples(F.col("embedding")), lambda x: x * 0.9))
    return velocity.signal_leakage(df, after, ["label"], "vec_id", "embedding", "offset", VELOCITIES[:3], DT).withColumn("leakage", F.round("leakage", 4))


@query("limits", f"WITH {_E} SELECT vec_id, CAST((i - 10) // 2 AS BIGINT) AS i, round(x, 8) AS x FROM e WHERE i >= 10 AND i < 60 AND (i - 10) % 2 = 0")
def limits_query(spark, d):
    return _rounded(traces(spark, d).withColumn("cut", limits(samples(F.col("embedding")), 10, -4, 2)), ["vec_id"], "cut", 8)


@query("longest_positive_run", f"WITH {_E}, g AS (SELECT vec_id, i - row_number() OVER (PARTITION BY vec_id ORDER BY i) AS g FROM e WHERE x > 0), r AS (SELECT vec_id, count(*) AS n FROM g GROUP BY vec_id, g) SELECT vec_id, max(n) AS n FROM r GROUP BY vec_id")
def longest_positive_run(spark, d):
    return traces(spark, d).select("vec_id", longest_run(F.transform(samples(F.col("embedding")), lambda x: x > 0)).cast("long").alias("n"))


@query("resample_linear", f"WITH {_E}, t AS (SELECT k, k * 1.5 AS pos FROM range(43) t(k)) SELECT a.vec_id, k AS i, round(a.x * (1 - (pos - floor(pos))) + coalesce(b.x, 0) * (pos - floor(pos)), 6) AS x FROM t JOIN e a ON a.i = floor(pos) LEFT JOIN e b ON b.vec_id = a.vec_id AND b.i = floor(pos) + 1")
def resample_linear(spark, d):
    return _rounded(traces(spark, d).withColumn("r", signal.resample_linear(F.col("embedding"), N, DT, 3.0)), ["vec_id"], "r")


# at whole samples the cubic is the sample; half-way its four neighbours weigh -1, 9, 9 and -1 sixteenths, mirrored at the ends
@query("resample_cubic", f"""
WITH {_E}, t AS (SELECT k, k // 2 AS low, k % 2 AS odd FROM range(127) r(k)),
n AS (SELECT k, odd, unnest([low - 1, low, low + 1, low + 2]) AS j, unnest([-0.0625::DOUBLE, 0.5625, 0.5625, -0.0625]) AS w, unnest([0.0::DOUBLE, 1, 0, 0]) AS w0 FROM t)
SELECT vec_id, k AS i, round(sum(x * CASE WHEN odd = 1 THEN w ELSE w0 END), 6) AS x FROM n JOIN e ON e.i = CASE WHEN abs(j) < 64 THEN abs(j) ELSE 126 - j END GROUP BY vec_id, k""")
def resample_cubic(spark, d):
    return _rounded(signal.resample(traces(spark, d), "embedding", N, DT, 1.0), ["vec_id"], "resampled")


_SINC = "CASE WHEN k = 10 THEN 1 ELSE sin(pi() * {0} / 250 * (k - 10)) / (pi() * {0} / 250 * (k - 10)) END * {0} / 250"


@query("bandpass", f"""
WITH {_E}, h AS (SELECT k, ({_SINC.format("100.0")} - {_SINC.format("10.0")}) * (0.54 - 0.46 * cos(2 * pi() * k / 20)) AS h FROM range(21) r(k)),
s AS (SELECT sum(h * cos(pi() * 55 / 250 * (k - 10))) AS s FROM h),
n AS (SELECT i, k, i + k - 10 AS j FROM range(64) r(i), range(21) q(k))
SELECT vec_id, n.i, round(sum(x * h / s), 6) AS x FROM n JOIN h USING (k) JOIN e ON e.i = CASE WHEN j < 0 THEN -j WHEN j > 63 THEN 126 - j ELSE j END, s GROUP BY vec_id, n.i""")
def bandpass(spark, d):
    return _rounded(signal.bandpass(traces(spark, d), "embedding", DT, 10, 100, 21), ["vec_id"], "filtered")


_ORIGINS = "(SELECT unnest([0, 15, 30, 44]) AS t0)"


@query("crop_grid", f"WITH {_E} SELECT vec_id, t0 AS origin_sample, i - t0 AS k, x FROM e, {_ORIGINS} WHERE i >= t0 AND i < t0 + 20")
def crop_grid(spark, d):
    c = signal.crop(traces(spark, d), "embedding", "vec_id", 1 << 20, N, (1 << 20, 20), (1 << 20, 15), ["vec_id"]).drop("origin_trace")
    return c.select("vec_id", "origin_sample", F.posexplode(samples(F.col("data"))).alias("k", "x")).withColumn("k", F.col("k").cast("long"))


@query("crop_assemble", f"WITH {_E} SELECT vec_id AS trace, i, round(x, 6) AS x FROM e")
def crop_assemble(spark, d):
    c = signal.crop(traces(spark, d).withColumn("embedding", samples(F.col("embedding"))), "embedding", "vec_id", 1 << 20, N, (1 << 20, 20), (1 << 20, 15))
    return signal.assemble(c).select("trace", F.col("i").cast("long").alias("i"), F.round("x", 6).alias("x"))


_NUMBERED = "n AS (SELECT vec_id, label, row_number() OVER (PARTITION BY label ORDER BY vec_id) - 1 AS pos, embedding AS e FROM embeddings), z AS (SELECT label, count(*) AS nt FROM n GROUP BY label)"
#: Which of n positions stands for position p under each mode; a constant's is none.
_STANDS = {"constant": "CASE WHEN {p} < {n} THEN {p} END", "edge": "least({p}, {n} - 1)", "wrap": "{p} % {n}", "symmetric": "CASE WHEN {p} % (2 * {n}) < {n} THEN {p} % (2 * {n}) ELSE 2 * {n} - 1 - {p} % (2 * {n}) END", "reflect": "CASE WHEN {p} % greatest(2 * {n} - 2, 1) < {n} THEN {p} % greatest(2 * {n} - 2, 1) ELSE 2 * {n} - 2 - {p} % greatest(2 * {n} - 2, 1) END"}


def numbered(spark, d):
    """Traces numbered in their gathers from 0, as the headers of a survey number them."""
    t = traces(spark, d)
    return t.withColumn("pos", F.row_number().over(Window.partitionBy("label").orderBy("vec_id")) - 1)


def _crop_sql(origins: str, mode: str) -> str:
    trace, sample = (_STANDS[mode].format(p=p, n=n) for p, n in (("(ot + row)", "nt"), ("(os + k)", "64")))
    return f"""WITH {_NUMBERED}, o AS ({origins}),
r AS (SELECT o.*, nt, row, {trace} AS t FROM o JOIN z USING (label), (SELECT unnest(range(5)) AS row)),
s AS (SELECT r.*, k, {sample} AS i FROM r, (SELECT unnest(range(7)) AS k))
SELECT s.label, s.crop, CAST(row AS INT) AS row, k, round(coalesce(CAST(e[i + 1] AS DOUBLE), 0), 6) AS x FROM s LEFT JOIN n ON n.label = s.label AND n.pos = s.t"""


def _crop_rows(spark, d, origins, mode):
    df = numbered(spark, d)
    out = crops.crops(df, origins(crops.sizes(df, ["label"], "embedding")), ["label"], ["embedding"], "pos", (5, 7), mode)
    return out.select("label", "crop", "row", F.posexplode("embedding").alias("k", "x")).select("label", "crop", "row", F.col("k").cast("long").alias("k"), F.round("x", 6).alias("x"))


_LISTED = [(0, 0), (2, 60), (40, 10), (500, 63)]
_LISTED_SQL = "SELECT label, CAST(c AS VARCHAR) AS crop, [0, 2, 40, 500][c + 1] AS ot, [0, 60, 10, 63][c + 1] AS os FROM z, (SELECT unnest(range(4)) AS c)"
_DRAWN_SQL = "SELECT label, CAST(c AS VARCHAR) AS crop, CAST('0x' || substr(md5('7:' || label || ':' || c || ':trace'), 1, 12) AS BIGINT) % (1 + greatest(nt - 5, 0)) AS ot, CAST('0x' || substr(md5('7:' || label || ':' || c || ':sample'), 1, 12) AS BIGINT) % 58 AS os FROM z, (SELECT unnest(range(6)) AS c)"


@query("crop_drawn", _crop_sql(_DRAWN_SQL, "constant"))
def crop_drawn(spark, d):
    return _crop_rows(spark, d, lambda g: crops.drawn(g, ["label"], (5, 7), 6, 7), "constant")


for _mode in _STANDS:

    @query(f"crop_listed_{_mode}", _crop_sql(_LISTED_SQL, _mode))
    def crop_listed(spark, d, mode=_mode):
        return _crop_rows(spark, d, lambda g: crops.listed(g, ["label"], _LISTED), mode)


@query("crop_joint", f"WITH {_NUMBERED}, o AS (SELECT label, ot, os FROM z, LATERAL (SELECT unnest(list_distinct(list_append(list_filter(range(0, nt, 3), lambda v: v < greatest(nt - 5, 0)), greatest(nt - 5, 0)))) AS ot), (SELECT unnest([0, 30, 57]) AS os)), r AS (SELECT label, ot, os, ot + row AS t FROM o, (SELECT unnest(range(5)) AS row)) SELECT r.label, ot, os, round(sum(list_sum(list_slice(e, CAST(os + 1 AS INT), CAST(os + 7 AS INT)))), 4) AS total, round(sum(list_sum(list_transform(list_slice(e, CAST(os + 1 AS INT), CAST(os + 7 AS INT)), lambda x: x * x))), 4) AS squares FROM r JOIN n ON n.label = r.label AND n.pos = r.t GROUP BY ALL")
def crop_joint(spark, d):
    """Two components, the samples and their squares, cropped at the same origins."""
    df = numbered(spark, d).withColumn("squared", F.transform(samples(F.col("embedding")), lambda x: x * x))
    origins = crops.grid(crops.sizes(df, ["label"], "embedding"), ["label"], (5, 7), (3, 30))
    out = crops.crops(df, origins, ["label"], ["embedding", "squared"], "pos", (5, 7))
    total = lambda c: F.round(F.sum(F.aggregate(c, F.lit(0.0), lambda acc, x: acc + x)), 4)
    return out.groupBy("label", F.col("origin_trace").alias("ot"), F.col("origin_sample").alias("os")).agg(total("embedding").alias("total"), total("squared").alias("squares"))


@query("model_inputs", f"WITH {_E} SELECT label, row_number() OVER (PARTITION BY label ORDER BY vec_id, i) - 1 AS pos, x FROM e")
def model_inputs(spark, d):
    return signal.model_inputs(traces(spark, d), ["label"], "vec_id", "embedding").select("label", F.posexplode(samples(F.col("input"))).alias("pos", "x")).withColumn("pos", F.col("pos").cast("long"))


@query("model_outputs", f"WITH {_E}, r AS (SELECT label, vec_id, row_number() OVER (PARTITION BY label ORDER BY vec_id) - 1 AS row FROM embeddings) SELECT e.label, row, round(sum(x), 6) AS total FROM e JOIN r USING (vec_id) GROUP BY e.label, row")
def model_outputs(spark, d):
    out = signal.split_outputs(signal.model_inputs(traces(spark, d), ["label"], "vec_id", "embedding"), ["label"])
    return out.select("label", F.col("row").cast("long").alias("row"), F.round(F.aggregate(samples(F.col("data")), F.lit(0.0), lambda a, x: a + x), 6).alias("total"))


@query("amplitude_histogram", f"WITH {_E} SELECT least(floor((x + 0.5) / (1.0 / 20)), 19)::INT AS bin, count(*) AS n FROM e WHERE x BETWEEN -0.5 AND 0.5 GROUP BY 1")
def amplitude_histogram(spark, d):
    return maps.histogram(gathers.exploded(traces(spark, d), "embedding", []), "x", -0.5, 0.5, 20)
