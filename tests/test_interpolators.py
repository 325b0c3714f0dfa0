"""The interpolators of fields at their own knots, coordinates of indices, and headings of tables."""

import pytest
from pyspark.sql import functions as F

from geostrata.operators import fields, headers
from geostrata.sources import text


def test_every_interpolator_meets_its_knots(spark):
    rows = [(i, float(i % 5 + i % 3 * 0.1), float(i // 5), 3.0 * (i % 5 + i % 3 * 0.1) - i // 5, float(i % 7)) for i in range(25)]
    params = spark.createDataFrame(rows, "id long, x double, y double, t0 double, v1 double")
    for name in fields.SURFACES:
        found = {r.query_id: r for r in fields.values_at(params, params, "id", ["t0", "v1"], name).collect()}
        assert len(found) == 25 and all(found[r[0]].t0 == pytest.approx(r[3], abs=1e-6) and found[r[0]].v1 == pytest.approx(r[4], abs=1e-6) for r in rows)
    between = spark.createDataFrame([(1, 1.7, 2.2), (2, 90.0, 90.0)], "id long, x double, y double")
    for name in ("delaunay", "ct", "rbf"):
        assert {r.query_id: r.t0 for r in fields.values_at(params, between, "id", ["t0"], name).collect()}[1] == pytest.approx(3 * 1.7 - 2.2, abs=1e-6)
    near = fields.weights_of(params, between, "id", radius=1.0).groupBy("query_id").agg(F.count("*").alias("n"), F.sum("weight").alias("w")).collect()
    assert {r.query_id for r in near} == {1, 2} and all(r.w == pytest.approx(1) for r in near)
    with pytest.raises(ValueError, match="idw, delaunay"):
        fields.weights_of(params, between, "id", "ct")


def test_coordinates_of_indices():
    assert headers.coords_of("TRACE_SEQUENCE_FILE") == headers.coords_of(["TraceNumber", "FieldRecord"]) == headers.coords_of(["GroupX", "SourceY", "GroupY", "SourceX"]) == ("CDP_X", "CDP_Y")
    assert headers.coords_of(["CROSSLINE_3D", "INLINE_3D"]) == ("INLINE_3D", "CROSSLINE_3D") and headers.coords_of(["Line", "Point"], source_ids=["Point", "Line"]) == ("SourceX", "SourceY")
    assert headers.coords_of(["Station"], receiver_ids=["Station"]) == ("GroupX", "GroupY")
    with pytest.raises(KeyError):
        headers.coords_of([])


def test_headings_and_decimals(spark, tmp_path):
    (tmp_path / "a.txt").write_text("made by hand\n  a    b  c\n 1  2,5 3\n-4  0,25 6\n")
    (tmp_path / "b.csv").write_text("a;b\n1.5;2\n", encoding="utf-8")
    rows = lambda df: [tuple(r) for r in df.collect()]
    path = str(tmp_path / "a.txt")
    assert rows(text.read_table(spark, path, has_header=True, skiprows=1, decimal=None)) == [(1, 2.5, 3), (-4, 0.25, 6)]
    assert rows(text.read_table(spark, path, ["c", "b"], has_header=True, skiprows=1, decimal=None)) == [(3, 2.5), (6, 0.25)]
    assert text.read_table(spark, path, usecols=[0, -1], has_header=True, skiprows=1, decimal=",").columns == ["a", "c"]
    assert rows(text.read_table(spark, str(tmp_path / "b.csv"), fmt="csv", sep=";", has_header=True, decimal=None)) == [(1.5, 2.0)]
    for bad in ({"columns": ["z"], "has_header": True, "skiprows": 1}, {}, {"columns": ["a", "b"], "usecols": [2, 0]}):
        with pytest.raises(ValueError):
            text.read_table(spark, path, **bad)
