"""What the text operators share: the library's scratch tables, and Arrow buffers as numpy arrays."""

from __future__ import annotations

import ctypes
from functools import cache

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from geostrata.sources.scratch import clean, saved, scratch, shared_dir

__all__ = ["clean", "dropped", "mix64", "only", "released", "saved", "saved_by_batches", "saved_lean", "scratch", "shared_dir", "slices", "table", "utf8", "word_hashes"]


#: Bytes of an Arrow batch where a table is saved by batches.
BATCH_BYTES = 4 << 20


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def _saved_under(df: DataFrame, name: str, settings: dict[str, str]) -> DataFrame:
    """saved() under settings that are put back afterwards."""
    conf = df.sparkSession.conf
    before = {k: conf.get(k) for k in settings}
    try:
        for k, v in settings.items():
            conf.set(k, v)
        return saved(df, name)
    finally:
        for k, v in before.items():
            conf.set(k, v)


def saved_lean(df: DataFrame, name: str) -> DataFrame:
    """saved(), after which the shuffle files of making ``df`` are gone, and written so as to need little room. Tables dealt by some of the
    columns that join them are joined as they lie, and lists are collected from rows that are in order already."""
    return _saved_under(df, name, {"spark.sql.classic.shuffleDependency.fileCleanup.enabled": "true", "spark.sql.parquet.compression.codec": "zstd", "spark.sql.requireAllClusterKeysForCoPartition": "false", "spark.sql.execution.useObjectHashAggregateExec": "false"})


def saved_by_batches(df: DataFrame, name: str) -> DataFrame:
    """saved(), whose Arrow batches hold about BATCH_BYTES, or one larger row: else 10,000 rows of text are whole in the JVM and in a worker."""
    return _saved_under(df, name, {"spark.sql.execution.arrow.maxBytesPerBatch": str(BATCH_BYTES)})


def dropped(table_: DataFrame) -> None:
    """Removes the files of a table that saved() made and that nothing will read any more."""
    hadoop = table_.sparkSession.sparkContext._jsc.hadoopConfiguration()
    for parent in {f.rpartition("/")[0] for f in table_.inputFiles()}:
        path = table_.sparkSession.sparkContext._jvm.org.apache.hadoop.fs.Path(parent)
        path.getFileSystem(hadoop).delete(path, True)


def only(df: DataFrame, **columns: str) -> DataFrame:
    """Just the columns that an operator reads, under its own names, so that no other column can clash with one it makes."""
    return df.select(*(F.col(f"`{source}`").alias(name) for name, source in columns.items()))


def utf8(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """The UTF-8 bytes of a string column, null as empty, and the n + 1 offsets of its rows in them."""
    column = pc.fill_null(column, "").cast(pa.large_string())
    _, offsets, data = column.buffers()
    if len(column) == 0:
        return np.zeros(0, np.uint8), np.zeros(1, np.int64)
    offsets = np.frombuffer(offsets, np.int64)[column.offset : column.offset + len(column) + 1]
    data = np.frombuffer(data, np.uint8)[offsets[0] : offsets[-1]] if data is not None else np.zeros(0, np.uint8)
    return data, offsets - offsets[0]


@cache
def _libc():
    """The C library where it can give back memory, else None."""
    libc = ctypes.CDLL(None)
    return libc if hasattr(libc, "malloc_trim") else None


def released() -> None:
    """Gives back the memory that this process has freed but holds, numpy's and Arrow's."""
    pa.default_memory_pool().release_unused()
    if _libc():
        _libc().malloc_trim(0)


def slices(batches, column: int, most_bytes: int = 4 << 20, most_rows: int = 2048):
    """Arrow batches cut so that one holds at most so many bytes of a string column, or a single row. What a batch took goes back to the
    system after it and after the last: workers are used again by later stages, and what they keep adds up to theirs."""
    for batch in batches:
        if batch.num_rows == 0:
            continue
        _, offsets = utf8(batch.column(column))
        at = 0
        while at < batch.num_rows:
            end = int(np.searchsorted(offsets, offsets[at] + most_bytes, "right")) - 1
            end = min(max(end, at + 1), at + most_rows, batch.num_rows)
            yield batch.slice(at, end - at)
            at = end
        released()


def mix64(x: np.ndarray) -> np.ndarray:
    """The finishing steps of the splitmix64 generator: a bijection on 64 bits that spreads every input bit."""
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


def word_hashes(data: np.ndarray, offsets: np.ndarray, is_word: np.ndarray, fold: np.ndarray | None = None) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """The 64-bit hash of every word of every row, the row of each word, and where it starts.

    ``is_word`` tells for each of the 256 byte values whether it belongs to words, ``fold`` replaces bytes. A word's bytes
    enter the hash eight at a time, so no array longer than the text's bytes is made.
    """
    if fold is not None:
        data = fold[data]
    if not len(data):
        return np.zeros(0, np.uint64), np.zeros(0, np.int64), np.zeros(0, np.int64)
    inside = is_word[data]
    first = np.zeros(len(data), bool)
    first[offsets[:-1][offsets[:-1] < len(data)]] = True
    begins = inside.copy()
    begins[1:] &= ~inside[:-1] | first[1:]
    starts = np.flatnonzero(begins)
    ends = inside.copy()
    ends[:-1] &= ~inside[1:] | first[1:]
    size = np.flatnonzero(ends) + 1 - starts
    padded = np.concatenate([data, np.zeros(8, np.uint8)])
    eight = np.ndarray((len(data),), "<u8", padded.data, 0, (1,))
    low = np.array([(1 << (8 * n)) - 1 for n in range(9)], np.uint64)
    hashes = mix64(size.astype(np.uint64) + np.uint64(0x9E3779B97F4A7C15))
    live, at = np.arange(len(starts)), 0
    while len(live):
        chunk = eight[starts[live] + at] & low[np.minimum(size[live] - at, 8)]
        hashes[live] = mix64(hashes[live] * np.uint64(0xD1342543DE82EF95) + chunk)
        at += 8
        live = live[size[live] > at]
    return hashes, np.searchsorted(offsets, starts, "right") - 1, starts
