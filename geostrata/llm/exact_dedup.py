"""Exact deduplication with an extendible-hash index on shared files.

The key of a text is the 64-bit hash of its normalised bytes. A directory of 2**depth slots, addressed by the key's high bits,
says which bucket holds a key; where a bucket holds more than its capacity it splits, and the directory doubles when the bucket
was already as deep as the directory. Contiguous buckets make a key range, and one owner task per range chains the entries of a
key, compares their bytes and writes the range's part of the index. Copies are folded into one entry inside every scan task
before the shuffle, so a text that makes up a third of all rows reaches its owner as one entry per scan task's buffer.

Defined results: a null text counts as empty, and all empty texts are copies of each other. Of equal texts the row with most code
points in the original text, then the smallest id, stays; a null id comes after all others. Rows repeated with the same id and
text carry the same decision. Empty tables give empty results. Other columns of the input are not read.
"""

from __future__ import annotations

import hashlib

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from geostrata.llm.common import only, saved, utf8

#: The bytes that normalising deletes, all of them white space.
SPACE = b"\x20\x09\x0a\x0b\x0c\x0d"
#: Text bytes that a bucket holds before it splits.
BUCKET_BYTES = 8 << 20
#: A directory has 2**MAX_DEPTH slots at most; buckets that deep no longer split, their chains grow instead.
MAX_DEPTH = 16
#: Bytes of texts that a scan task holds while it folds copies.
FOLD_BYTES = 24 << 20

_LAST = np.iinfo(np.int64).max


def _key(norm: bytes) -> int:
    return xxhash.xxh3_64_intdigest(norm) - (1 << 63)


def _texts(column: pa.Array):
    """The normalised bytes of every row."""
    data, offsets = utf8(column)
    data = data.tobytes()
    for a, b in zip(offsets[:-1].tolist(), offsets[1:].tolist()):
        yield data[a:b].translate(None, SPACE)


def digests(docs: DataFrame) -> DataFrame:
    """id, key, sha, n_chars (code points of the original), n_bytes (of the normalised text) of every row."""

    def run(batches):
        for batch in batches:
            norm = list(_texts(batch.column(1)))
            yield pa.RecordBatch.from_arrays([
                batch.column(0).cast(pa.int64()), pa.array([_key(x) for x in norm], pa.int64()), pa.array([hashlib.sha256(x).digest() for x in norm], pa.binary()),
                pc.utf8_length(pc.fill_null(batch.column(1), "")).cast(pa.int64()), pa.array([len(x) for x in norm], pa.int64()),
            ], ["id", "key", "sha", "n_chars", "n_bytes"])

    return docs.mapInArrow(run, "id long, key long, sha binary, n_chars long, n_bytes long")


def split_buckets(load: np.ndarray, capacity: int) -> tuple[np.ndarray, np.ndarray]:
    """Builds the directory by doubling. ``load`` is the weight below each of 2**max_depth key prefixes.

    Returns the directory (prefix of its depth to bucket number, numbered in key order) and each bucket's load.
    """
    most = int(np.log2(len(load)))
    total = np.concatenate([[0], np.cumsum(load)])
    depth, slots, deep = 0, np.zeros(1, np.int64), {0: 0}  # a bucket is known by its first slot at MAX_DEPTH
    full = [0]
    while full:
        bucket = full.pop()
        width = len(load) >> deep[bucket]
        if total[bucket + width] - total[bucket] <= capacity or deep[bucket] == most:
            continue
        if deep[bucket] == depth:  # the directory doubles: each slot becomes two that share its bucket
            slots, depth = np.repeat(slots, 2), depth + 1
        deep[bucket] += 1
        upper = bucket + width // 2
        deep[upper] = deep[bucket]
        scale = len(load) >> depth
        slots[upper // scale : (bucket + width) // scale] = upper
        full += [bucket, upper]
    firsts, slots = np.unique(slots, return_inverse=True)
    ends = np.append(firsts[1:], len(load))
    return slots, total[ends] - total[firsts]


def deal(loads: np.ndarray, owners: int) -> np.ndarray:
    """The owner of each bucket: contiguous buckets of about equal load."""
    before = np.cumsum(loads) - loads
    return np.minimum(before * owners // max(int(loads.sum()), 1), owners - 1).astype(np.int64)


def entries(docs: DataFrame, owner_of_slot: np.ndarray) -> DataFrame:
    """Copies folded within each scan task: owner, key, norm, n, n_chars and id of the best copy, one row per distinct text held."""
    shift = 64 - int(np.log2(len(owner_of_slot)))

    def run(batches):
        held, size = {}, 0

        def flush():
            keys = np.array([_key(x) for x in held], np.int64)
            slot = (keys.view(np.uint64) ^ np.uint64(1 << 63)) >> np.uint64(shift) if shift < 64 else np.zeros(len(keys), np.uint64)
            best = list(held.values())
            return pa.RecordBatch.from_arrays([
                pa.array(owner_of_slot[slot.astype(np.int64)], pa.int32()), pa.array(keys), pa.array(list(held), pa.binary()),
                pa.array([x[0] for x in best], pa.int64()), pa.array([-x[1] for x in best], pa.int64()), pa.array([x[2] for x in best], pa.int64()),
            ], ["owner", "key", "norm", "n", "n_chars", "id"])

        for batch in batches:
            ids = pc.fill_null(batch.column(0).cast(pa.int64()), _LAST).to_pylist()
            chars = pc.utf8_length(pc.fill_null(batch.column(1), "")).to_pylist()
            for norm, id_, n in zip(_texts(batch.column(1)), ids, chars):
                if old := held.get(norm):
                    held[norm] = (old[0] + 1, *min(old[1:], (-n, id_)))
                else:
                    held[norm] = (1, -n, id_)
                    size += len(norm) + 200
                if size > FOLD_BYTES:
                    yield flush()
                    held, size = {}, 0
        if held:
            yield flush()

    return docs.mapInArrow(run, "owner int, key long, norm binary, n long, n_chars long, id long")


def _own(batches):
    """An owner task: its entries come sorted by key; those of one key form a chain, in which bytes decide what is equal."""
    names = ["key", "sha", "group_size", "best_chars", "keep_id"]
    key, chain, done = None, {}, []

    def rows():
        return pa.RecordBatch.from_arrays([pa.array(x, t) for x, t in zip(zip(*done), (pa.int64(), pa.binary(), pa.int64(), pa.int64(), pa.int64()))], names)

    def close():
        done.extend((key, hashlib.sha256(norm).digest(), n, -chars, None if id_ == _LAST else id_) for norm, (n, chars, id_) in chain.items())

    for batch in batches:
        columns = [batch.column(i).to_pylist() for i in range(1, 6)]
        for k, norm, n, chars, id_ in zip(*columns):
            if k != key:
                close()
                key, chain = k, {}
            old = chain.get(norm)  # a dict of bytes compares them in full
            chain[norm] = (old[0] + n, *min(old[1:], (-chars, id_))) if old else (n, -chars, id_)
        if len(done) > 5000:
            yield rows()
            done.clear()
    close()
    if done:
        yield rows()


def build_index(docs: DataFrame, found: DataFrame, bucket_bytes: int = BUCKET_BYTES, max_depth: int = MAX_DEPTH) -> DataFrame:
    """The index: key, sha, group_size, best_chars and keep_id of every distinct normalised text, on shared files."""
    prefix = F.shiftrightunsigned(F.col("key").bitwiseXOR(F.lit(-(1 << 63))), 64 - max_depth) if max_depth else F.lit(0)
    load = np.zeros(1 << max_depth, np.int64)
    # 2**max_depth rows at most come to the driver
    for row in found.groupBy("key").agg(F.max("n_bytes").alias("n_bytes")).groupBy(prefix.alias("slot")).agg(F.sum(F.col("n_bytes") + 64).alias("load")).collect():
        load[row.slot] = row.load
    slots, loads = split_buckets(load, bucket_bytes)
    owners = max(1, min(len(loads), int(docs.sparkSession.conf.get("spark.sql.shuffle.partitions"))))
    dealt = entries(docs, deal(loads, owners)[slots])
    return saved(dealt.repartitionById(owners, "owner").sortWithinPartitions("key").mapInArrow(_own, "key long, sha binary, group_size long, best_chars long, keep_id long"), "index")


def exact_dedup(df: DataFrame, id_col: str = "doc_id", text_col: str = "text", bucket_bytes: int = BUCKET_BYTES, max_depth: int = MAX_DEPTH) -> DataFrame:
    """One row per row of ``df``: id, keep_id, group_size, kept, text_sha256.

    Only texts with copies are joined back to the rows, on an equi-join that adaptive execution may split where one text is hot.
    """
    docs = only(df, id=id_col, text=text_col)
    found = saved(digests(docs), "digests")
    index = build_index(docs, found, bucket_bytes, max_depth).where("group_size > 1")
    joined = found.join(index, ["key", "sha"], "left")
    return joined.select(
        F.col("id").alias(id_col), F.when(F.col("group_size").isNull(), F.col("id")).otherwise(F.col("keep_id")).alias("keep_id"), F.coalesce("group_size", F.lit(1)).cast("long").alias("group_size"),
        (F.col("group_size").isNull() | (F.col("id").eqNullSafe(F.col("keep_id")) & (F.col("n_chars") == F.col("best_chars")))).alias("kept"), F.lower(F.hex("sha")).alias("text_sha256"),
    )
