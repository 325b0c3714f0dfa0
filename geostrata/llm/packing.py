"""Packing by optimal length buckets.

Every text is tokenized by a public vocabulary. A histogram of all lengths goes to the driver, where dynamic programming chooses
the upper bounds of at most ``n_buckets`` buckets so that padding every document to its bucket's bound wastes the fewest tokens
in total. Batches of a token budget then form inside each bucket, of the documents' token ids, padded to the bound. Whole
documents only: none is cut, dropped or split, and the ids decode to the text.

Defined results: null and empty texts have no tokens and go to bucket 0 with bound 0, in batches of ``budget`` documents. A
document longer than the budget is a batch of its own. The order in a bucket is by a hash of the row's place in the table, so
rows with equal ids are separate documents like any others. A text is tokenized whole, whatever its length, by one task. An empty
table gives an empty result. Other columns of the input are not read.
"""

from __future__ import annotations

import base64
import re
from functools import cache

import numpy as np
import pyarrow as pa
import tiktoken
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from geostrata.llm.common import only, saved_by_batches, slices

N_BUCKETS = 12
#: Tokens of a batch, padding included.
BUDGET = 65536
#: Documents that a task numbers, about.
SHARD_DOCS = 250_000
#: The setting that names the vocabulary, a file of ranks that the driver reads, and where it is else looked for.
TOKENIZER, DEFAULT_TOKENIZER = "spark.geostrata.tokenizer", "/opt/tokenizers/byte_bpe_50k.tiktoken"
#: The pattern that cuts texts before the vocabulary's merges, and the id that is free for padding.
PATTERN = r"""'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"""
PAD = 50256


@cache
def encoding(ranks: bytes) -> tiktoken.Encoding:
    """The tokenizer of a file of ranks; a worker makes it once."""
    return tiktoken.Encoding("ranks", pat_str=PATTERN, mergeable_ranks={base64.b64decode(a): int(b) for a, b in map(bytes.split, ranks.splitlines())}, special_tokens={})


#: Runs of white space from this length on are cut here, as the pattern's backtracking over a long one runs out of stack.
LONG_RUN = 10_000
_LONG_RUN = re.compile(r"[\t-\r \x85\xa0\u1680\u2000-\u200a\u2028\u2029\u202f\u205f\u3000]{%d,}" % LONG_RUN)


def token_ids(known: tiktoken.Encoding, text: str) -> np.ndarray:
    """The ids of a text. Where a long run of white space stands before other text, the pattern takes all of it but its last character for one
    piece, and at the text's end all of it; such a piece goes to the merges as it is, and what is between is encoded by itself."""
    found, at = [], 0
    for run in _LONG_RUN.finditer(text):
        end = run.end() if run.end() == len(text) else run.end() - 1
        found += [known.encode_to_numpy(text[at : run.start()]), np.array(known._encode_single_piece(text[run.start() : end]), np.int64)]
        at = end
    return np.concatenate([*found, known.encode_to_numpy(text[at:])]).astype(np.int32) if found else known.encode_to_numpy(text).astype(np.int32)


def ranks_of(spark: SparkSession, path: str | None = None) -> bytes:
    with open(path or spark.conf.get(TOKENIZER, DEFAULT_TOKENIZER), "rb") as f:
        return f.read()


def tokenized(docs: DataFrame, ranks: bytes) -> DataFrame:
    """row (its place), id, tokens and n_tokens of every row of ``docs`` (id, text)."""
    shared = docs.sparkSession.sparkContext.broadcast(ranks)  # a vocabulary, whatever the corpus

    def run(batches):
        known = encoding(shared.value)
        for batch in slices(batches, 1, 1 << 20):
            found = [token_ids(known, t) if t else np.zeros(0, np.int32) for t in batch.column(1).to_pylist()]
            ends = np.cumsum([0, *(len(x) for x in found)])
            tokens = pa.ListArray.from_arrays(pa.array(ends, pa.int32()), pa.array(np.concatenate(found), pa.int32()))
            yield pa.RecordBatch.from_arrays([batch.column(0), tokens, pa.array(np.diff(ends), pa.int64())], ["id", "tokens", "n_tokens"])

    return docs.mapInArrow(run, f"id {docs.schema['id'].dataType.simpleString()}, tokens array<int>, n_tokens long").withColumn("row", F.monotonically_increasing_id())


def choose_bounds(lengths: np.ndarray, counts: np.ndarray, n_buckets: int) -> list[int]:
    """Upper bounds of at most ``n_buckets`` buckets with the least total padding; ``lengths`` ascend and are positive.

    cost(a, b) = lengths[b] * (C[b] - C[a]) - (S[b] - S[a]) for a bucket of items a+1..b. For one b the best a is that of a line
    a -> best[a] + S[a] - lengths[b] * C[a], with slopes that fall as a grows and queries that rise, so each round is one walk
    over a lower hull: exact, in time in proportion to the distinct lengths.
    """
    n = len(lengths)
    if not n:
        return []
    x = [int(v) for v in lengths]
    c, s = [0], [0]
    for v, k in zip(x, counts.tolist()):
        c.append(c[-1] + int(k))
        s.append(s[-1] + int(k) * v)
    best = [x[b - 1] * c[b] - s[b] if b else 0 for b in range(n + 1)]
    back = [[0] * (n + 1)]
    for _ in range(min(n_buckets, n) - 1):
        hull: list[int] = []
        new, take, at = [0] * (n + 1), [0] * (n + 1), 0

        def y(a, best=best):
            return best[a] + s[a]

        for b in range(1, n + 1):
            a = b - 1
            while len(hull) - at > 1 and (y(a) - y(hull[-2])) * (c[hull[-1]] - c[hull[-2]]) <= (y(hull[-1]) - y(hull[-2])) * (c[a] - c[hull[-2]]):
                hull.pop()
            hull.append(a)
            at = min(at, len(hull) - 1)
            while at + 1 < len(hull) and y(hull[at + 1]) - x[b - 1] * c[hull[at + 1]] <= y(hull[at]) - x[b - 1] * c[hull[at]]:
                at += 1
            take[b] = hull[at]
            new[b] = y(hull[at]) - x[b - 1] * c[hull[at]] + x[b - 1] * c[b] - s[b]
        best = new
        back.append(take)
    bounds, b = [], n
    for take in reversed(back):
        if b == 0:
            break
        bounds.append(x[b - 1])
        b = take[b]
    return bounds[::-1]


def pack(df: DataFrame, id_col: str = "doc_id", text_col: str = "text", n_buckets: int = N_BUCKETS, budget: int = BUDGET, tokenizer: str | None = None, shard_docs: int = SHARD_DOCS) -> DataFrame:
    """One row per row of ``df``: id, n_tokens, bucket, bucket_tokens (its bound), batch_id (in the bucket), slot (in the batch),
    batch_docs, padding, and tokens, the document's ids.

    Documents of a bucket are numbered through: first within shards of the bucket, then shifted by the sizes of the shards
    before, so a bucket of any size is spread over tasks and its batches are all full but the last.
    """
    docs = saved_by_batches(tokenized(only(df, id=id_col, text=text_col), ranks_of(df.sparkSession, tokenizer)), "tokens")
    # n different lengths have n * (n + 1) / 2 tokens at least: ten million million tokens have 5 million lengths at most
    histogram = docs.where("n_tokens > 0").groupBy("n_tokens").count().toPandas().sort_values("n_tokens")
    bounds = choose_bounds(histogram["n_tokens"].to_numpy(np.int64), histogram["count"].to_numpy(np.int64), n_buckets)
    # the buckets' bounds are at most n_buckets constants of the plan
    bucket, bound = F.lit(0), F.lit(0).cast("long")
    for i, upper in reversed(list(enumerate(bounds, 1))):
        bucket, bound = F.when((F.col("n_tokens") > 0) & (F.col("n_tokens") <= upper), i).otherwise(bucket), F.when((F.col("n_tokens") > 0) & (F.col("n_tokens") <= upper), F.lit(upper).cast("long")).otherwise(bound)
    shards = max(64, -(-docs.count() // shard_docs))
    placed = docs.select("row", "n_tokens", bucket.alias("bucket"), bound.alias("bucket_tokens"), F.xxhash64("row").alias("h")).withColumn("shard", F.pmod("h", F.lit(shards)).cast("int"))
    sizes = placed.groupBy("bucket", "shard").agg(F.count("*").alias("n"))
    # one row for a shard of a bucket
    before = F.coalesce(F.sum("n").over(Window.partitionBy("bucket").orderBy("shard").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    sizes = sizes.select("bucket", "shard", before.alias("before"), F.sum("n").over(Window.partitionBy("bucket")).alias("bucket_docs"))
    numbered = placed.withColumn("number", F.row_number().over(Window.partitionBy("bucket", "shard").orderBy("h")) - 1).join(sizes, ["bucket", "shard"]).withColumn("number", F.col("number") + F.col("before"))
    capacity = F.greatest(F.floor(F.lit(budget) / F.greatest("bucket_tokens", F.lit(1))), F.lit(1)).cast("long")
    batch = F.floor(F.col("number") / capacity).cast("long")
    numbered = numbered.select(
        "row", "bucket", "bucket_tokens", batch.alias("batch_id"), (F.col("number") - batch * capacity).alias("slot"),
        F.least(capacity, F.col("bucket_docs") - batch * capacity).alias("batch_docs"), (F.col("bucket_tokens") - F.col("n_tokens")).alias("padding"),
    )
    return docs.join(numbered, "row").select(F.col("id").alias(id_col), "n_tokens", "bucket", "bucket_tokens", "batch_id", "slot", "batch_docs", "padding", "tokens")


def batches(packed: DataFrame, id_col: str = "doc_id", pad: int = PAD) -> DataFrame:
    """One row per batch of pack()'s result: bucket, batch_id, ids and tokens, which holds every document's tokens, padded to the
    bound, in the order of slots: the budget's number of them, or those of one longer document, or none (bucket 0)."""
    padded = F.concat("tokens", F.array_repeat(F.lit(pad), F.col("padding").cast("int")))
    rows = packed.groupBy("bucket", "batch_id").agg(F.array_sort(F.collect_list(F.struct("slot", F.col(f"`{id_col}`").alias("id"), padded.alias("tokens")))).alias("rows"))
    return rows.select("bucket", "batch_id", F.col("rows.id").alias("ids"), F.flatten("rows.tokens").alias("tokens"))
