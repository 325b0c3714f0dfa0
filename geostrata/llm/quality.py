"""Quality classifier by attention-based multiple-instance learning.

A document is a bag of passages of ``PASSAGE`` bytes, each of which stands by itself. A passage is encoded from the frequencies of
pairs of neighbouring character classes and from how often words repeat at once; gated attention weighs the passages, and the weighted mean of their codes is scored. All weights are learned
together from document labels alone, on a bounded sample of the labelled rows that are not held out; labels, languages, sources
and ids are no inputs. Scoring is one pass over the table without a shuffle. Texts are encoded CHUNK bytes at a time, of which the
arrays take about forty times as much; of longer texts only the passages' codes are kept beside the text, a fifth of its bytes.

Defined results: null and empty texts have no passage; their representation is the zero vector and their score what the
model's bias makes of it. A null id belongs to no fold: it is scored, not held out, never trained on. Where labels repeat for
an id their mean, rounded up from 0.5, counts; null labels do not. Without any labelled row the score is 0.5 throughout.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from geostrata.llm.common import only, slices, utf8, word_hashes

PASSAGE = 512
#: Labelled documents that the model is fitted on at most, those with the smallest hash of their id.
SAMPLE = 6000
#: A document of more passages is not used for fitting; it is scored whole like any other. So features of 220 MB at most are fitted on.
SAMPLE_PASSAGES = 64
#: Bytes of texts that are encoded at once.
CHUNK = 1 << 21
THRESHOLD = 0.7
SEED = 20240229

_GROUPS = ["aeiou", "bcdfghjklmnpqrstvwxyz", "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "0123456789", " ", "\n\r\t\x0b\x0c", ".", ",;:", "!?", "|", "#$%&*+=@^~_<>{}[]\\/`"]
N_CLASSES = len(_GROUPS) + 2
_CLASS = np.full(256, len(_GROUPS), np.int64)  # what no group has: other ASCII
_CLASS[128:] = len(_GROUPS) + 1
for _i, _group in enumerate(_GROUPS):
    _CLASS[[ord(c) for c in _group]] = _i
#: The last two: the share of words that repeat the word before, and that repeat the one before that.
N_FEATURES = N_CLASSES * N_CLASSES + 2
_IN_WORD = ~np.isin(np.arange(256), list(b" \n\r\t\x0b\x0c"))


def passages(data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Where the passages of some documents begin and, at last, where they end; and the number of passages of each document."""
    counts = -(-np.diff(offsets) // PASSAGE)
    first = np.cumsum(counts) - counts
    starts = np.repeat(offsets[:-1], counts) + (np.arange(int(counts.sum())) - np.repeat(first, counts)) * PASSAGE
    return np.append(starts, len(data)), counts


def features(data: np.ndarray, starts: np.ndarray) -> np.ndarray:
    """The features of the passages that begin at ``starts[:-1]``, of bytes ``starts[0]`` to ``starts[-1]``."""
    n = len(starts) - 1
    data, starts = data[starts[0] : starts[-1]], starts - starts[0]
    of_byte = np.repeat(np.arange(n), np.diff(starts))
    classes = _CLASS[data]
    same = of_byte[1:] == of_byte[:-1]
    pairs = (of_byte[:-1] * N_FEATURES + classes[:-1] * N_CLASSES + classes[1:])[same]
    found = np.bincount(pairs, minlength=n * N_FEATURES).reshape(n, N_FEATURES).astype(np.float32)
    found = np.sqrt(found / np.maximum(found.sum(1, keepdims=True), 1))
    words, rows, _ = word_hashes(data, starts, _IN_WORD)
    per = np.maximum(np.bincount(rows, minlength=n), 1)
    for back in (1, 2):
        again = (words[back:] == words[:-back]) & (rows[back:] == rows[:-back])
        found[:, -back] = np.bincount(rows[back:][again], minlength=n) / per
    return found


def in_chunks(data: np.ndarray, starts: np.ndarray):
    """The features of passages, those of CHUNK bytes at a time."""
    step = CHUNK // PASSAGE
    for at in range(0, len(starts) - 1, step):
        yield features(data, starts[at : at + step + 1])


class AttentionMil:
    """Encoder, gated attention and scorer, with their gradients."""

    def __init__(self, hidden: int = 24, gate: int = 12, seed: int = SEED):
        rng = np.random.default_rng(seed)
        draw = lambda *shape: rng.normal(0, 1 / np.sqrt(shape[0]), shape).astype(np.float32)
        self.p = {"We": draw(N_FEATURES, hidden) * 3, "be": np.zeros(hidden, np.float32), "V": draw(hidden, gate), "U": draw(hidden, gate), "w": draw(gate) * 0.1, "o": draw(hidden), "b": np.zeros(1, np.float32)}

    def encode(self, x: np.ndarray) -> np.ndarray:
        return np.tanh(x @ self.p["We"] + self.p["be"])

    def attend(self, h: np.ndarray, counts: np.ndarray) -> tuple[np.ndarray, tuple]:
        """The scores of documents with so many passages each, whose codes are ``h``, and what gradients need."""
        p = self.p
        has = np.flatnonzero(counts)
        z = np.zeros((len(counts), len(p["o"])), h.dtype)
        state = None
        if len(has):
            sizes = counts[has]
            at = np.cumsum(sizes) - sizes
            t, g = np.tanh(h @ p["V"]), 1 / (1 + np.exp(-(h @ p["U"])))
            e = (t * g) @ p["w"]
            e = np.exp(e - np.repeat(np.maximum.reduceat(e, at), sizes))
            a = e / np.repeat(np.add.reduceat(e, at), sizes)
            z[has] = np.add.reduceat(a[:, None] * h, at)
            state = (sizes, at, h, t, g, a)
        return 1 / (1 + np.exp(-np.clip(z @ p["o"] + p["b"], -60, 60))), (has, z, state)

    def forward(self, x: np.ndarray, counts: np.ndarray) -> tuple[np.ndarray, tuple]:
        return self.attend(self.encode(x), counts)

    def scores(self, data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """The scores of whole texts and their numbers of passages."""
        starts, counts = passages(data, offsets)
        h = np.concatenate([np.zeros((0, len(self.p["be"])), np.float32), *(self.encode(x) for x in in_chunks(data, starts))])
        return self.attend(h, counts)[0].astype(np.float64), counts

    def gradients(self, x: np.ndarray, counts: np.ndarray, y: np.ndarray) -> dict[str, np.ndarray]:
        """Those of the mean cross-entropy of some documents."""
        p = self.p
        s, (has, z, state) = self.forward(x, counts)
        ds = ((s - y) / len(y)).astype(z.dtype)
        grad = {"o": z.T @ ds, "b": ds.sum(keepdims=True)}
        if state:
            sizes, at, h, t, g, a = state
            dz = np.repeat(ds[has, None] * p["o"], sizes, 0)
            da = (dz * h).sum(1)
            de = a * (da - np.repeat(np.add.reduceat(a * da, at), sizes))
            dt, dg = de[:, None] * p["w"] * g * (1 - t * t), de[:, None] * p["w"] * t * g * (1 - g)
            dh = (a[:, None] * dz + dt @ p["V"].T + dg @ p["U"].T) * (1 - h * h)
            grad |= {"w": (t * g).T @ de, "V": h.T @ dt, "U": h.T @ dg, "We": x.T @ dh, "be": dh.sum(0)}
        return grad

    def fit(self, x: np.ndarray, counts: np.ndarray, y: np.ndarray, steps: int = 400, batch: int = 128, rate: float = 4e-3, decay: float = 1e-4, seed: int = SEED) -> AttentionMil:
        rng, p = np.random.default_rng(seed), self.p
        ends = np.cumsum(counts)
        epochs = -(-steps // max(1, len(y) // batch))
        m, v, step = {k: np.zeros_like(w) for k, w in p.items()}, {k: np.zeros_like(w) for k, w in p.items()}, 0
        for epoch in range(epochs):
            for ids in np.array_split(rng.permutation(len(y)), max(1, len(y) // batch)):
                rows = np.concatenate([np.arange(ends[i] - counts[i], ends[i]) for i in ids])
                step += 1
                for k, d in self.gradients(x[rows], counts[ids], y[ids]).items():
                    m[k] = 0.9 * m[k] + 0.1 * d
                    v[k] = 0.999 * v[k] + 0.001 * d * d
                    p[k] -= (rate * (1 - epoch / epochs)) * (m[k] / (1 - 0.9**step) / (np.sqrt(v[k] / (1 - 0.999**step)) + 1e-8) + decay * p[k]).astype(np.float32)
        return self


def held_out(id_):
    """Every id whose crc32 has the remainder 2 by 4; unknown for a null id."""
    return F.coalesce(F.crc32(id_.cast("string").cast("binary")) % 4 == 2, F.lit(False))


def training_set(docs: DataFrame, labels: DataFrame, sample: int = SAMPLE) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Features, passage counts and labels of at most ``sample`` labelled documents outside the held-out fold."""
    chosen = labels.where(F.col("label").isNotNull() & F.col("id").isNotNull() & ~held_out(F.col("id"))).groupBy("id").agg((F.avg("label") >= 0.5).cast("int").alias("label")).orderBy(F.xxhash64("id"), "id").limit(sample)

    def encoded(batches):
        for batch in slices(batches, 1):
            data, offsets = utf8(batch.column(1))
            starts, counts = passages(data, offsets)
            x = np.concatenate([np.zeros((0, N_FEATURES), np.float32), *in_chunks(data, starts)])
            ends = np.cumsum(counts)
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(2), pa.array([x[e - c : e].tobytes() for e, c in zip(ends, counts)], pa.binary())], ["id", "label", "x"])

    short = docs.where(F.coalesce(F.octet_length("text"), F.lit(0)) <= PASSAGE * SAMPLE_PASSAGES)
    # ``sample`` rows of two numbers: small enough to broadcast whatever the corpus
    rows = short.join(F.broadcast(chosen), "id").select("id", "text", "label").mapInArrow(encoded, "id long, label int, x binary").toPandas()
    rows = rows.sort_values(["id", "x"]).drop_duplicates("id") if len(rows) else rows
    x = [np.frombuffer(r, np.float32).reshape(-1, N_FEATURES) for r in rows.x] if len(rows) else []
    return np.concatenate([np.zeros((0, N_FEATURES), np.float32), *x]), np.array([len(r) for r in x], np.int64), np.array(rows.label if len(rows) else [], np.float32)


def fitted(df: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text", label_col: str = "quality", sample: int = SAMPLE) -> AttentionMil:
    """The model, fitted on the labelled rows of ``df`` that are not held out."""
    docs = only(df, id=id_col, text=text_col).withColumn("id", F.col("id").cast("long"))
    known = only(labels, id=id_col, label=label_col).withColumn("id", F.col("id").cast("long"))
    x, counts, y = training_set(docs, known, sample)
    model = AttentionMil()
    if len(y):
        model.fit(x, counts, y)
    else:
        model.p["o"][:] = 0

    return model


def score(df: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text", label_col: str = "quality", sample: int = SAMPLE, threshold: float = THRESHOLD) -> DataFrame:
    """One row per row of ``df``: id, score, predicted, n_passages, held_out."""
    model = fitted(df, labels, id_col, text_col, label_col, sample)

    def run(batches):
        for batch in slices(batches, 1):
            s, n = model.scores(*utf8(batch.column(1)))
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(s), pa.array((s >= threshold).astype(np.int32)), pa.array(n, pa.int64())], [id_col, "score", "predicted", "n_passages"])

    docs = only(df, id=id_col, text=text_col).withColumn("id", F.col("id").cast("long"))
    return docs.mapInArrow(run, f"`{id_col}` long, score double, predicted int, n_passages long").withColumn("held_out", held_out(F.col(f"`{id_col}`")))


def keep(df: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text", label_col: str = "quality", sample: int = SAMPLE, threshold: float = THRESHOLD) -> DataFrame:
    """The rows of ``df`` that the model predicts to be good, with all their columns."""
    model, at = fitted(df, labels, id_col, text_col, label_col, sample), df.columns.index(text_col)

    def run(batches):
        for batch in slices(batches, at):
            good = model.scores(*utf8(batch.column(at)))[0] >= threshold
            yield batch.filter(pa.array(good))

    return df.mapInArrow(run, df.schema)
