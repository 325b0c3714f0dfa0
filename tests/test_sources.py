"""Files written and read again."""

import os

import numpy as np
import pytest
from pyspark.sql import functions as F

from geostrata.sources import scratch, segy, text


@pytest.fixture(scope="module")
def traces(spark):
    segy.register(spark)
    rng = np.random.default_rng(1)
    return spark.createDataFrame([(i, i % 7, [float(x) for x in rng.integers(-100, 100, 24)]) for i in range(60)], "CDP int, offset int, data array<float>")


def test_appended_files_stay_and_overwritten_ones_go(spark, traces, tmp_path):
    path = str(tmp_path / "s")
    save = lambda df, mode: df.repartition(2).write.format("segy").mode(mode).save(path)
    read = lambda: sorted(r.CDP for r in spark.read.format("segy").option("headers", "CDP").load(path + "/*.sgy").collect())
    save(traces.where("CDP < 20"), "append")
    save(traces.where("CDP between 20 and 39"), "append")
    assert read() == list(range(40)) and len(os.listdir(path)) == 4
    save(traces.where("CDP >= 50"), "overwrite")
    assert read() == list(range(50, 60)) and len(os.listdir(path)) == 2


@pytest.mark.parametrize("limits", [":", "3:", "-5:", "2:20:3", ":-4", "::-1"])
def test_limits_reach_the_reader(spark, traces, tmp_path, limits):
    path = str(tmp_path / "s")
    traces.write.format("segy").mode("append").save(path)
    cut = slice(*(int(v) if v else None for v in limits.split(":")))
    found = {r.CDP: list(r.data) for r in spark.read.format("segy").option("headers", "CDP").option("limits", limits).load(path + "/*.sgy").collect()}
    assert found == {r.CDP: list(r.data)[cut] for r in traces.collect()}


def test_empty_limits_fail(spark, traces, tmp_path):
    traces.write.format("segy").mode("append").save(str(tmp_path / "s"))
    with pytest.raises(Exception, match="no samples"):
        spark.read.format("segy").option("limits", "20:10").load(str(tmp_path / "s/*.sgy")).collect()


@pytest.mark.parametrize("out_format", [None, 1])
def test_files_are_aggregated_side_by_side(spark, traces, tmp_path, monkeypatch, out_format):
    monkeypatch.setattr(segy, "COPIED", 7)
    path, out = str(tmp_path / "s"), str(tmp_path / "o")
    traces.repartitionByRange(3, "CDP").sortWithinPartitions("CDP").write.format("segy").mode("append").save(path)
    segy.aggregate(spark, path + "/*.sgy", out, sample_format=out_format)
    segy.aggregate(spark, path + "/*.sgy", out, name="more")
    back = spark.read.format("segy").option("headers", "CDP,offset,TRACE_SEQUENCE_LINE").load(out + "/part-*.sgy").orderBy("TRACE_SEQUENCE_FILE").collect()
    assert [(r.TRACE_SEQUENCE_FILE, r.TRACE_SEQUENCE_LINE, r.CDP, r.offset, list(r.data)) for r in back] == [(i + 1, i + 1, r.CDP, r.offset, list(r.data)) for i, r in enumerate(traces.orderBy("CDP").collect())]
    assert len(os.listdir(out)) == 2


def test_files_of_unlike_lengths_are_not_aggregated(spark, traces, tmp_path):
    traces.write.format("segy").mode("append").save(str(tmp_path / "s"))
    traces.withColumn("data", F.slice("data", 1, 10)).write.format("segy").mode("append").save(str(tmp_path / "s"))
    with pytest.raises(ValueError, match="differ"):
        segy.aggregate(spark, str(tmp_path / "s/*.sgy"), str(tmp_path / "o"))


def test_headings_are_skipped_in_every_file(spark, tmp_path):
    for i in range(3):
        (tmp_path / f"{i}.txt").write_text("# of a survey\n a  b\n" + "".join(f"{i * 10 + k} {k}.5\n" for k in range(4)))
    found = text.read_table(spark, str(tmp_path), ["a", "b"], skiprows=2).orderBy("a").collect()
    assert [tuple(r) for r in found] == [(i * 10 + k, k + 0.5) for i in range(3) for k in range(4)]


def test_scratch_is_removed(spark):
    saved = scratch.saved(spark.range(3), "numbers")
    assert saved.count() == 3
    scratch.clean(spark)
    assert not os.path.exists(f"{scratch.shared_dir(spark).removeprefix('file://')}/geostrata-{spark.sparkContext.applicationId}")


def test_headers_of_a_parent_are_kept(spark, tmp_path):
    segy.register(spark)
    rows = [(i, 1000 + i, -5, [float(i + k) for k in range(7)]) for i in range(30)]
    df = spark.createDataFrame(rows, "CDP int, SourceX int, offset int, data array<float>")
    df.coalesce(1).write.format("segy").mode("append").option("text", "C 1 LINE ÄÖ").option("extended", "page one\fpage two").option("sample_format", 1).save(str(tmp_path / "a"))
    parent = next((tmp_path / "a").glob("*.sgy"))
    df.limit(20).repartition(3).write.format("segy").mode("append").option("parent", str(parent)).option("sample_format", 1).save(str(tmp_path / "b"))
    head = parent.read_bytes()[: 3600 + 6400]
    files = list((tmp_path / "b").glob("*.sgy"))
    assert files and all(f.read_bytes()[: len(head)] == head for f in files)
    back = spark.read.format("segy").option("headers", "CDP,SourceX,offset").load(str(tmp_path / "b") + "/*.sgy").collect()
    assert len(back) == 20 and all((r.SourceX, r.offset, list(r.data)) == (1000 + r.CDP, -5, rows[r.CDP][3]) for r in back)
    info = spark.read.format("segy_files").load(str(parent)).first()
    assert (info.n_traces, info.n_samples, info.sample_interval, info.sample_format) == (30, 7, 2.0, 1) and info.text.startswith("C 1 LINE ÄÖ ") and [bytes(e).decode("cp500").strip() for e in info.extended] == ["page one", "page two"]
    segy.aggregate(spark, str(tmp_path / "[ab]") + "/*.sgy", str(tmp_path / "c"))
    assert spark.read.format("segy").option("headers", "CDP").load(str(tmp_path / "c") + "/*.sgy").agg({"CDP": "sum"}).first()[0] == sum(range(30)) + sum(r.CDP for r in back)
    with pytest.raises(Exception, match="don't fit"):
        df.withColumn("YearDataRecorded", df.CDP + 70_000).write.format("segy").mode("append").save(str(tmp_path / "d"))


def test_files_are_read_by_ranges(spark, tmp_path):
    """Through a file system that opens by ranges only, as those of object stores do."""
    from pyarrow import fs

    segy.register(spark)
    spark.createDataFrame([(i, [float(i + k) for k in range(9)]) for i in range(50)], "CDP int, data array<float>").coalesce(1).write.format("segy").mode("append").option("extended", "page").save(str(tmp_path))
    opened = lambda path: (fs.SubTreeFileSystem(str(tmp_path), fs.LocalFileSystem()), path.removeprefix("store://bucket").lstrip("/"))
    found = segy.named("store://bucket/*.sgy", opened)
    assert len(found) == 1 and found[0].startswith("store://bucket/part-") and segy.layout(found[0], ">", opened)[:2] == (50, 9)
    reader = segy.SegyReader({"path": str(tmp_path) + "/none", "limits": "2:8:3"}, ["CDP"], True)
    batches = list(reader.read(segy._Range(found[0], 5, 45), opened))
    assert [(n, x) for b in batches for n, x in zip(b.column(2).to_pylist(), b.column(3).to_pylist())] == [(i, [i + 2.0, i + 5.0]) for i in range(5, 45)]
