"""The corpus pipeline: documents to padded batches, in five stages of the text operators.

Each stage reads all that its predecessor kept and drops what its operator decides against; the last one packs what is left.
Verdicts are on rows: a row has a key of its own, which is its id only where all ids are unique and not null.

Defined results: null and empty texts have no passage and are judged by the classifier's bias; those it keeps are exact copies of
one another, near copies of nothing and never contaminated, and go to the bucket of no tokens. Of rows repeated one stays. Texts are
whole at every stage, whatever their length. Columns besides doc_id and text are carried along, whatever their names; the last
stage drops them. Empty tables give an empty result.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from geostrata.llm import decontaminate, exact_dedup, minhash, packing, quality
from geostrata.llm.common import saved, table


def _keyed(docs: DataFrame) -> tuple[DataFrame, str]:
    """``docs`` with a long of its own for every row, and that column's name: the id where no id is null or repeated, else the row's
    number in the order of ids, null ones last, so that the smallest key has the smallest id. The numbers are written once and read
    again."""
    key = "row_key"
    while key in {c.lower() for c in docs.columns}:
        key += "_"
    if docs.groupBy("doc_id").count().where("doc_id is null or count > 1").isEmpty():
        return docs.withColumn(key, F.col("doc_id").cast("long")), key
    ordered = docs.orderBy(F.col("doc_id").asc_nulls_last(), F.xxhash64("text"), F.monotonically_increasing_id())
    return saved(ordered.withColumn(key, F.monotonically_increasing_id()), "keyed"), key


def _without(docs: DataFrame, bad: DataFrame, key: str) -> DataFrame:
    """The rows of ``docs`` whose key is not in ``bad``: a shuffled join on the key, as neither side has a bound."""
    return docs.join(bad.select(key).hint("merge"), key, "left_anti").drop(key)


def good_quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the quality classifier, fitted on the labelled rows outside the held-out fold, predicts to be good."""
    return quality.keep(docs, table(spark, sf_dir, "labels"))


def exact_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of texts that are equal without white space: the longest, then the smallest id."""
    docs, key = _keyed(docs)
    return _without(docs, exact_dedup.exact_dedup(docs, key).where("not kept"), key)


def near_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document, the smallest id, of each component of documents linked by a similarity of 0.8 on shingles of five words."""
    docs, key = _keyed(docs)
    return _without(docs, minhash.near_duplicates(docs, key, words=5).where("not kept"), key)


def benchmark_free(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that share no window of ten words, nor a shorter item, with the benchmark."""
    docs, key = _keyed(docs)
    return _without(docs, decontaminate.decontaminate(docs, table(spark, sf_dir, "benchmark"), key).where("contaminated"), key)


def packed(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The token ids of every document and its place in the batches of optimal length buckets."""
    return packing.pack(docs)


STAGES = [("quality", good_quality), ("exact_dedup", exact_copies), ("near_dedup", near_copies), ("decontamination", benchmark_free), ("packing", packed)]
#: A trained classifier decides in the first stage, which SQL can't express; tests compare with a brute-force version.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    for name, stage in STAGES[:-1]:
        docs = saved(stage(spark, docs, sf_dir), name)
    return STAGES[-1][1](spark, docs, sf_dir)
