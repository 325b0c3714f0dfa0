"""Compression of vectors to codes of four bytes: product codebooks by integer Lloyd rounds, searched by Exponion.

Components become integers, vectors are cut into ``PARTS`` equal parts, and every part position has a codebook of its own. A round
is one pass of tasks that assign the parts and one aggregate of sums; only the sums, one row for each component of an entry,
reach the driver. Each pass starts a part's search at the entry it had before. With u its distance to that entry, no entry that is
as near lies farther from that entry than 2u, so the entries are scanned in the order of their distance from it up to there and
no further. All distances are integers, so equal ones are equal and go to the lower index.

Defined results: rows whose vector is null, empty or holds a null, NaN or infinite component are dropped. Vectors of differing lengths,
of a length that ``PARTS`` doesn't divide, and components of 16384 and more raise ValueError, since errors would not be whole or
not fit. Null ids come last in the order of ids, equal ids are ordered by their vectors, and repeated rows are vectors like any others. With
fewer vectors than entries the codebooks are as small as their number. Null labels are equal to one another. An empty table gives an
empty result. Other columns are not read, whatever their names.
"""

from __future__ import annotations

import hashlib

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from geostrata.llm.common import only, saved

PARTS, ENTRIES, ROUNDS, SCALE = 4, 256, 4, 1024
#: Integer components are below this, so that a squared distance of parts of 4096 components fits in 64 bits.
MOST = 1 << 24
#: Entries that are measured at once.
STEP = 32


def exact(width: int, most: int) -> type:
    """The number type in which squared distances of such parts are exact; floats are the faster one."""
    return np.float64 if width * (2 * most) ** 2 < 1 << 53 else np.int64


def squared(points: np.ndarray, entries: np.ndarray) -> np.ndarray:
    """Squared distances of all points from all entries, exact in the type of exact()."""
    return (points * points).sum(1)[:, None] - 2 * (points @ entries.T) + (entries * entries).sum(1)


def nearest(points: np.ndarray, start: np.ndarray, book: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The index of each point's nearest entry, the lowest of equally near ones, and its squared distance.

    ``start`` is an entry of each point from which its search begins.
    """
    kind = exact(book.shape[1], int(max(np.abs(points).max(initial=0), np.abs(book).max(initial=0))))
    points, book = points.astype(kind), book.astype(kind)
    between = squared(book, book)
    order = np.argsort(between, axis=1, kind="stable")
    between = np.take_along_axis(between, order, 1)
    found = start.astype(np.int64)
    least = ((points - book[found]) ** 2).sum(1)
    grouped = np.argsort(start, kind="stable")
    for rows in np.split(grouped, np.flatnonzero(np.diff(start[grouped])) + 1) if len(grouped) else []:
        origin = start[rows[0]]
        reach = np.searchsorted(between[origin], 4 * least[rows], "right")
        by_reach = np.argsort(-reach, kind="stable")
        rows, reach = rows[by_reach], reach[by_reach]
        for at in range(0, int(reach[0]), STEP):
            live = rows[: np.searchsorted(-reach, -at, "left")]
            entries = order[origin, at : at + STEP]
            far = squared(points[live], book[entries])
            low = far.min(1)
            index = np.where(far == low[:, None], entries, len(book)).min(1)
            better = (low < least[live]) | ((low == least[live]) & (index < found[live]))
            found[live[better]], least[live[better]] = index[better], low[better]
    return found, least.astype(np.int64)


def integer_vectors(df: DataFrame) -> DataFrame:
    """id, label and x, the integer components, of the rows of ``df`` (id, vector, label) whose vectors are whole."""
    bad = F.exists("vector", lambda x: x.isNull() | F.isnan(x) | (F.abs(x) == float("inf")))
    whole = df.where(F.col("vector").isNotNull() & (F.size("vector") > 0)).where(~bad)
    return whole.select("id", "label", F.transform("vector", lambda x: F.floor(F.lit(float(SCALE)) * x.cast("double"))).alias("x"))


def _matrix(column: pa.Array) -> np.ndarray:
    return column.flatten().to_numpy(zero_copy_only=False).astype(np.int64).reshape(len(column), -1)


def assigned(state: DataFrame, books: np.ndarray) -> DataFrame:
    """``state`` (id, label, x, code) with the code of each part's nearest entry and ``error``, the squared distances' sum."""

    def run(batches):
        for batch in batches:
            if not batch.num_rows:
                continue
            parts = _matrix(batch.column("x")).reshape(batch.num_rows, len(books), -1)
            before = _matrix(batch.column("code"))
            found = [nearest(parts[:, j], before[:, j], book) for j, book in enumerate(books)]
            codes = np.stack([c for c, _ in found], 1).astype(np.int32)
            ends = pa.array(np.arange(batch.num_rows + 1, dtype=np.int32) * len(books))
            yield pa.RecordBatch.from_arrays([batch.column("id"), batch.column("label"), batch.column("x"), pa.ListArray.from_arrays(ends, pa.array(codes.ravel())), pa.array(np.sum([d for _, d in found], 0))], ["id", "label", "x", "code", "error"])

    kinds = {f.name: f.dataType.simpleString() for f in state.schema}
    return state.select("id", "label", "x", "code").mapInArrow(run, f"id {kinds['id']}, label {kinds['label']}, x array<bigint>, code array<int>, error long")


def moved(state: DataFrame, books: np.ndarray) -> np.ndarray:
    """The codebooks whose entries are the floored means of the parts assigned to them; entries without any stay."""
    n_parts, k, width = books.shape

    def run(batches):
        sums = np.zeros((n_parts, k, width + 1), np.int64)  # the last place counts
        for batch in batches:
            parts, codes = _matrix(batch.column(0)).reshape(batch.num_rows, n_parts, width), _matrix(batch.column(1))
            for j in range(n_parts):
                by_code = np.argsort(codes[:, j], kind="stable")
                used, first = np.unique(codes[by_code, j], return_index=True)
                if len(used):
                    sums[j, used, :width] += np.add.reduceat(parts[by_code, j], first, axis=0)
                    sums[j, used, width] += np.diff(np.append(first, len(codes)))
        key = np.flatnonzero(sums)
        yield pa.RecordBatch.from_arrays([pa.array(key), pa.array(sums.ravel()[key])], ["key", "value"])

    rows = state.select("x", "code").mapInArrow(run, "key long, value long").groupBy("key").agg(F.sum("value").alias("value")).toPandas()
    sums = np.zeros(n_parts * k * (width + 1), np.int64)
    sums[rows["key"].to_numpy(np.int64)] = rows["value"].to_numpy(np.int64)
    sums = sums.reshape(n_parts, k, width + 1)
    counts = sums[..., width:]
    return np.where(counts > 0, sums[..., :width] // np.maximum(counts, 1), books)


def compressed(df: DataFrame, id_col: str = "vec_id", vector_col: str = "embedding", label_col: str = "label", n_parts: int = PARTS, n_entries: int = ENTRIES, rounds: int = ROUNDS) -> tuple[DataFrame, np.ndarray]:
    """id, label, x, code (the entries' indices by part) and error of every whole vector, and the codebooks (part, entry, component)."""
    state = saved(integer_vectors(only(df, id=id_col, vector=vector_col, label=label_col)).withColumn("code", F.array_repeat(F.lit(0), n_parts)), "vectors")
    size, largest = F.size("x"), F.greatest(F.array_max("x"), -F.array_min("x"))
    least, most, top = state.agg(F.min(size), F.max(size), F.max(largest)).first()
    if least is None:
        return state.withColumn("error", F.lit(0).cast("long")), np.zeros((n_parts, 0, 0), np.int64)
    if least != most or most % n_parts or top >= MOST:
        raise ValueError(f"vectors need one length that {n_parts} divides, and components below {MOST // SCALE}: found lengths {least} to {most}, components up to {top / SCALE}")
    first = state.orderBy(F.col("id").asc_nulls_last(), "x").select("x").limit(n_entries).collect()
    books = np.array([r[0] for r in first], np.int64).reshape(len(first), n_parts, -1).transpose(1, 0, 2)
    for _ in range(rounds):
        state = saved(assigned(state, books), "assigned")
        books = moved(state, books)
    return saved(assigned(state, books), "assigned"), books


def vector_codes(df: DataFrame, id_col: str = "vec_id", vector_col: str = "embedding", label_col: str = "label") -> DataFrame:
    """One row per whole vector: id, code (two hex digits for each part), error, label_error (the sum of the errors of equal
    labels) and codebooks_sha256 (of all final components by part, entry and position, comma-joined)."""
    found, books = compressed(df, id_col, vector_col, label_col)
    digest = hashlib.sha256(",".join(map(str, books.ravel().tolist())).encode()).hexdigest()
    by_label = found.groupBy("label").agg(F.sum("error").alias("label_error")).withColumnRenamed("label", "of_label")
    code = F.lower(F.array_join(F.transform("code", lambda c: F.lpad(F.hex(c), 2, "0")), ""))
    rows = found.join(by_label, F.col("label").eqNullSafe(F.col("of_label")))
    return rows.select(F.col("id").alias(id_col), code.alias("code"), "error", "label_error", F.lit(digest).alias("codebooks_sha256"))
