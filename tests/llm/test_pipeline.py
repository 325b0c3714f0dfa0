"""The pipeline against plain versions of its stages, and the registered queries on the smallest tables."""

import re

import pytest
from conftest import SF
from pyspark.sql import functions as F
from test_text_operators import brute_components

import corpus_pipeline
from geostrata.llm import quality
from geostrata.llm.common import saved, table
from geostrata.llm.queries import ORACLE_SQL, QUERIES


def test_stages_one_by_one(spark):
    docs = table(spark, SF, "documents")
    kept = {r.doc_id: r.text for r in docs.collect()}
    good = {r.doc_id for r in quality.score(docs, table(spark, SF, "labels")).where("predicted = 1").collect()}
    kept = {i: t for i, t in kept.items() if i in good}
    best: dict = {}
    for i, t in kept.items():
        best.setdefault(re.sub(r"[\x20\x09-\x0D]", "", t or ""), []).append((-len(t or ""), i))
    exact = {min(group)[1] for group in best.values()}
    exact = {i: t for i, t in kept.items() if i in exact}
    _, component = brute_components(exact.items(), 5)
    near = {i: t for i, t in exact.items() if component[i] == i}
    words = lambda t: re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", (t or "").translate({c: c + 32 for c in range(65, 91)}))
    grams = lambda w, n: {tuple(w[i : i + n]) for i in range(len(w) - n + 1)}
    windows: dict = {}
    for r in table(spark, SF, "benchmark").collect():
        if w := words(r.text):
            windows.setdefault(min(10, len(w)), set()).update(grams(w, min(10, len(w))))
    clean = {i: t for i, t in near.items() if not any(grams(words(t), n) & known for n, known in windows.items())}
    for (name, stage), wanted in zip(corpus_pipeline.STAGES, (kept, exact, near, clean, clean)):
        out = saved(stage(spark, docs, SF), name)
        assert {r.doc_id for r in out.collect()} == set(wanted), name
        assert out.columns == table(spark, SF, "documents").columns or name == "packing"
        docs = out


def test_rows_with_null_and_repeated_ids_are_judged_one_by_one(spark, tmp_path):
    words = lambda name, n=40: " ".join(f"{name}{i}" for i in range(n))
    near = words("n", 200)
    rows = [
        (None, words("a")), (None, words("a")), (None, words("b")), (1, words("c")), (1, words("c")), (1, words("d")),
        (2, near), (2, near + " more"), (2, words("e")), (None, near + " end"), (3, words("leak")), (3, words("f")), (None, words("leak") + " x"), (None, words("g")),
    ]
    spark.createDataFrame([(1, words("leak", 12))], "item_id long, text string").write.parquet(f"{tmp_path}/benchmark.parquet")
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    for name, stage in corpus_pipeline.STAGES[1:4]:
        docs = saved(stage(spark, docs, str(tmp_path)), name)
    found = [(r.doc_id, r.text.split()[0]) for r in docs.collect()]
    assert sorted(found, key=str) == sorted([(None, "a0"), (None, "b0"), (1, "c0"), (1, "d0"), (2, "n0"), (2, "e0"), (3, "f0"), (None, "g0")], key=str)


def test_stages_with_odd_rows(spark, tmp_path):
    """Nulls, empty and long texts, repeats and columns whose names the operators use, through all stages but the classifier."""
    long = " ".join(f"l{i % 5000}" for i in range(40_000))
    rows = [(1, None), (2, ""), (3, " \n"), (4, long), (5, long + " "), (6, long.replace("l7 ", "x7 ", 1)), (7, "leak " * 12), (8, "one"), (8, "one"), (9, "two words")]
    spark.createDataFrame([("i", "leak " * 12), (None, None), ("e", "")], "item_id string, text string").write.parquet(f"{tmp_path}/benchmark.parquet")
    extra = ("row_key", "id", "a", "kept", "words", "row", "norm", "n_tokens", "tokens", "component", "Row_Key_")
    docs = spark.createDataFrame(rows, "doc_id long, text string").withColumns({c: F.lit(c) for c in extra})
    for name, stage in corpus_pipeline.STAGES[1:4]:
        docs = saved(stage(spark, docs, str(tmp_path)), name)
        assert docs.columns == ["doc_id", "text", *extra]
    assert sorted(r.doc_id for r in docs.collect()) == [3, 5, 8, 9]  # of equal texts the longest stays, and of near copies the smallest id
    packed = corpus_pipeline.STAGES[4][1](spark, docs, str(tmp_path)).collect()
    assert sorted((r.doc_id, r.n_tokens > 40_000) for r in packed) == [(3, False), (5, True), (8, False), (9, False)]
    found = quality.keep(spark.createDataFrame(rows, "doc_id long, text string").withColumn("x", F.lit(1)), spark.createDataFrame([(1, 1)], "doc_id long, quality int"))
    assert found.columns == ["doc_id", "text", "x"] and found.count() <= len(rows)


def test_pipeline_without_documents(spark, tmp_path):
    for name in ("documents", "labels", "benchmark"):
        table(spark, SF, name).limit(0).write.parquet(f"{tmp_path}/{name}.parquet")
    assert corpus_pipeline.run(spark, str(tmp_path)).count() == 0


@pytest.mark.parametrize("name", sorted(ORACLE_SQL))
def test_sql_twins(spark, name):
    from compare import connect, rows

    wanted = connect(SF).sql(ORACLE_SQL[name]).df()
    assert rows(QUERIES[name](spark, SF).toPandas()) == rows(wanted)
