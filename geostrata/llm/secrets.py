"""Secret scans: rule findings, and a character convolutional network over every other candidate with its context.

The base rules are matched on every whole text, and their spans always stay. Candidates are runs of 16 or more characters of the
alphabet that keys are made of. The network, written in numpy, reads a candidate's characters and the context on both sides; over
a run longer than its body it slides by one character, and the highest score counts. It is trained on labelled findings: made-up
ones of a fixed seed (keys of many kinds, and numbers, dates, paths, identifiers and the like, in prose, code, settings and
addresses), and from a bounded sample of the texts the candidates that a rule found, and words as what is none. Scores are
calibrated on a held-back part, and the threshold is the highest one that keeps ``RECALL`` of its findings. Candidates at or above
it, and not wholly inside a base span, are added.

Defined results: a null text counts as empty and has no spans. Spans that begin at one place come in the order of kinds. A text of
any length is scanned whole by one task, in time in proportion to its length. Rows repeated give rows repeated; a null id is kept. Without any
finding in the sample the made-up ones alone are the positives. Other columns of the input are not read.
"""

from __future__ import annotations

import hashlib
import re
from bisect import bisect_right
from random import Random

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from geostrata.llm.common import only, saved, slices, utf8

#: The base rules, in the order in which kinds are listed.
ASSIGN = re.compile(r"""(password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", re.I | re.A)
ACCESS = re.compile(r"AKIA[A-Z0-9]+")
HEX = re.compile(r"[0-9a-f]{24,}")
KINDS = ["assign", "access", "hex", "network"]
#: A text that has none of these has no base match.
_MAYBE = r"(?i:password|passwd|secret|token|api_?key)|AKIA[A-Z0-9]{16}|[0-9a-f]{24}"

LEAST = 16
LEFT, BODY, RIGHT = 24, 40, 16
#: Findings, and words, that the network is fitted on besides so many made-up cases of each.
SAMPLE, MADE = 1500, 5000
RECALL = 0.99
SEED = 20240301

_ALPHABET = "abcdefghijklmnopqrstuvwxyzABCDEFGHIJKLMNOPQRSTUVWXYZ0123456789=:\"' _-+/.\n"
_OTHER, _NONE = len(_ALPHABET), len(_ALPHABET) + 1
_CODE = np.full(256, _OTHER, np.uint8)
_CODE[[ord(c) for c in _ALPHABET]] = np.arange(len(_ALPHABET))
_RUN = np.zeros(256, bool)
_RUN[[ord(c) for c in "abcdefghijklmnopqrstuvwxyzABCDEFGHIJKLMNOPQRSTUVWXYZ0123456789+/_=-"]] = True


def base_spans(text: str) -> list[tuple[int, int, int]]:
    """(start, number of the kind, end) of the base rules' findings, in code points, leftmost and non-overlapping per kind."""
    found = [(m.start(), 0, m.end()) for m in ASSIGN.finditer(text) if m.end(2) - m.start(2) >= 6]
    found += [(m.start(), 1, m.end()) for m in ACCESS.finditer(text) if m.end() - m.start() >= 20]
    found += [(m.start(), 2, m.end()) for m in HEX.finditer(text)]
    return sorted(found)


def joined(spans: list[tuple[int, int, int]]) -> str:
    return ",".join(f"{KINDS[kind]}:{start}:{end}" for start, kind, end in spans)


def candidates(data: np.ndarray, offsets: np.ndarray, every: bool = False) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Row, first byte and end of the candidates of some texts; bytes count from the first text's beginning. Unless ``every`` is set, only
    those with a digit or with both cases."""
    inside = np.concatenate([[False], _RUN[data], [False]])
    change = inside[1:] != inside[:-1]
    inner = offsets[1:-1]
    change[inner[(inner > 0) & (inner < len(data))]] |= inside[1:][inner[(inner > 0) & (inner < len(data))]]
    # a run that crosses from one text to the next is two: its border is both an end and a start
    edges = np.flatnonzero(change)
    starts = edges[inside[1:][edges]] if len(edges) else edges
    ends = np.flatnonzero(np.concatenate([(~inside[1:] & inside[:-1])]) | (np.isin(np.arange(len(data) + 1), inner) & inside[:-1])) if len(edges) else edges
    keep = ends - starts >= LEAST
    starts, ends = starts[keep], ends[keep]
    if every:
        return np.searchsorted(offsets, starts, "right") - 1, starts, ends
    count = lambda low, high: np.diff(np.concatenate([[0], np.cumsum((data >= low) & (data <= high))])[np.stack([starts, ends])], axis=0)[0]
    likely = (count(48, 57) > 0) | ((count(65, 90) > 1) & (count(97, 122) > 1))
    starts, ends = starts[likely], ends[likely]
    return np.searchsorted(offsets, starts, "right") - 1, starts, ends


def windows(data: np.ndarray, offsets: np.ndarray, rows: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
    """The codes that the network reads: LEFT characters before a candidate, its first BODY, and RIGHT after it."""
    code = np.append(_CODE[data], np.uint8(_NONE))
    take = lambda at, low, high: code[np.where((at >= low[:, None]) & (at < high[:, None]), at, len(data))]
    low, high = offsets[rows], offsets[rows + 1]
    return np.concatenate([
        take(starts[:, None] + np.arange(-LEFT, 0), low, high), take(starts[:, None] + np.arange(BODY), starts, ends), take(ends[:, None] + np.arange(RIGHT), low, high),
    ], 1) if len(rows) else np.zeros((0, LEFT + BODY + RIGHT), np.uint8)


def best_scores(model: CharCnn, data: np.ndarray, offsets: np.ndarray, rows: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
    """Every candidate's highest score over all places of the body in it."""
    places = np.maximum(ends - starts - BODY + 1, 1)
    which, first = np.repeat(np.arange(len(rows)), places), np.cumsum(places) - places
    best = np.zeros(len(rows))
    for at in range(0, len(which), 8192):
        w = which[at : at + 8192]
        begin = starts[w] + np.arange(at, at + len(w)) - first[w]
        np.maximum.at(best, w, model.scores(windows(data, offsets, rows[w], begin, np.minimum(begin + BODY, ends[w]))))
    return best


class CharCnn:
    """Filters over WIDTH characters, each one's maximum, and a logistic layer; Platt-calibrated."""

    WIDTH = 5

    def __init__(self, filters: int = 24, seed: int = SEED):
        rng = np.random.default_rng(seed)
        self.w = rng.normal(0, 0.25, (self.WIDTH, _NONE + 1, filters)).astype(np.float32)
        self.c, self.o, self.b = np.zeros(filters, np.float32), rng.normal(0, 0.3, filters).astype(np.float32), np.float32(0)
        self.scale, self.shift, self.threshold = 1.0, 0.0, 0.5

    def _pooled(self, x: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        n = x.shape[1] - self.WIDTH + 1
        z = self.c + sum(self.w[k][x[:, k : k + n]] for k in range(self.WIDTH))
        at = z.argmax(1)
        return np.maximum(np.take_along_axis(z, at[:, None], 1)[:, 0], 0), at

    def logits(self, x: np.ndarray) -> np.ndarray:
        return np.concatenate([np.zeros(0), *(self._pooled(x[i : i + 512])[0] @ self.o + self.b for i in range(0, len(x), 512))])

    def scores(self, x: np.ndarray) -> np.ndarray:
        return 1 / (1 + np.exp(-np.clip(self.scale * self.logits(x) + self.shift, -60, 60)))

    def fit(self, x: np.ndarray, y: np.ndarray, epochs: int = 8, batch: int = 64, rate: float = 0.08, seed: int = SEED) -> CharCnn:
        rng = np.random.default_rng(seed)
        order = rng.permutation(len(y))
        held, seen = order[: len(y) // 4], order[len(y) // 4 :]
        g2 = [np.full_like(v, 1e-3) for v in (self.w, self.c, self.o)]  # sums of squared gradients, by which steps are scaled
        for _ in range(epochs):
            for ids in np.array_split(rng.permutation(seen), max(1, len(seen) // batch)):
                pooled, at = self._pooled(x[ids])
                d = (1 / (1 + np.exp(-np.clip(pooled @ self.o + self.b, -60, 60))) - y[ids]).astype(np.float32) / len(ids)
                dz = d[:, None] * self.o * (pooled > 0)
                dw = np.zeros_like(self.w)
                for k in range(self.WIDTH):
                    np.add.at(dw[k], (np.take_along_axis(x[ids], at + k, 1), np.arange(dw.shape[2])[None, :]), dz)
                for i, (value, grad) in enumerate(((self.w, dw), (self.c, dz.sum(0)), (self.o, pooled.T @ d))):
                    g2[i] += grad * grad
                    value -= rate * grad / np.sqrt(g2[i])
                self.b -= np.float32(rate * d.sum())
        self._calibrate(self.logits(x[held]), y[held])
        return self

    def _calibrate(self, logits: np.ndarray, y: np.ndarray) -> None:
        if y.min(initial=1) == y.max(initial=0) or not len(y):
            return
        target = np.where(y > 0, (y.sum() + 1) / (y.sum() + 2), 1 / ((y == 0).sum() + 2))
        for _ in range(200):  # Platt's two parameters by gradient descent
            e = 1 / (1 + np.exp(-np.clip(self.scale * logits + self.shift, -60, 60))) - target
            self.scale -= 0.05 * float((e * logits).mean())
            self.shift -= 0.05 * float(e.mean())
        found = np.sort(1 / (1 + np.exp(-np.clip(self.scale * logits[y > 0] + self.shift, -60, 60))))
        self.threshold = float(found[int((1 - RECALL) * len(found))])


_LOWER, _UPPER, _DIGIT = "abcdefghijklmnopqrstuvwxyz", "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "0123456789"
_KEY_ALPHABETS = [_DIGIT + "abcdef", _DIGIT + "ABCDEF", _UPPER + _DIGIT, _LOWER + _DIGIT, _UPPER + _LOWER + _DIGIT, _UPPER + _LOWER + _DIGIT + "+/", _UPPER + _LOWER + _DIGIT + "-_", _LOWER, _UPPER + _LOWER]
_KEY_HEADS = ["", "", "", "", "", "", "AKIA", "ghp_", "sk_live_", "xoxb-", "eyJ", "AIza", "pk-", "key-", "SG_"]
_SAID_BEFORE = [" the key is ", "Authorization: Bearer ", "Authorization: Basic ", 'key: "', "export KEY=", "secret_access_key = ", "?sig=", "https://user:", "'auth' => '", "--with-key ", "<key>", "(", " use ", "credentials: ", "private: ", " "]


def made(rng: Random) -> tuple[str, str, str, int]:
    """A made-up case: context before, candidate, context after, and whether the candidate is a secret."""
    pick = rng.choice
    draw = lambda alphabet, low, high: "".join(rng.choices(alphabet, k=rng.randrange(low, high)))
    # words of syllables, as texts have them in any language
    word = lambda low=1, high=5: "".join(pick("bcdfghjklmnprstvwz") * (rng.random() < 0.8) + pick("aeiou") + pick(["", "", "n", "r", "s", "t", "ch"]) for _ in range(rng.randrange(low, high)))
    prose = lambda: " ".join(word() for _ in range(5)) + " "
    after = pick(["", " " + prose(), '"', "'", "\n" + prose(), ", " + prose(), ".", ");", "&x=1", "</key>"])
    if rng.random() < 0.5:
        body = pick(_KEY_HEADS) + draw(pick(_KEY_ALPHABETS), 20, 44)
        body += pick(["", "", "", "", "=", "=="])
        if rng.random() < 0.2:  # what stands before it is part of the run
            body = pick(["KEY", "AUTH_VALUE", "client_id", "hooks", "SERVICE_X_KEY", "v1/auth"]) + pick("=/") + body
        return prose() + pick(_SAID_BEFORE) if rng.random() < 0.6 else prose(), body, after, 1
    a, b, c, n = word(2), word(2), word(2), rng.randrange(1, 3000)
    joint = pick("-_/")
    body = pick([
        lambda: draw(_DIGIT, 16, 20), lambda: f"{a}{joint}{b}{joint}{c}{joint}{n}", lambda: f"{2000 + n % 30}-{1 + n % 12:02}-{1 + n % 28:02}{joint}{a}{joint}{b}", lambda: f"{a.title()}{b.title()}{c.title()}{word().title()}",
        lambda: word(6, 12), lambda: word(6, 12).title(), lambda: "/" + joint.join(word() for _ in range(rng.randrange(3, 9))), lambda: "-".join(draw(_DIGIT, 4, 5) for _ in range(4)),
        lambda: pick("=-_+/") * rng.randrange(16, 60), lambda: pick(_LOWER + _UPPER + _DIGIT) * rng.randrange(16, 60), lambda: "-".join(draw(_DIGIT + "abcdef", k, k + 1) for k in (8, 4, 4, 4, 12)), lambda: f"{a.upper()}_{b.upper()}_{c.upper()}",
        lambda: f"{draw(_DIGIT, 1, 4)}-{draw(_DIGIT, 3, 6)}-{draw(_DIGIT, 4, 8)}-{draw(_DIGIT, 1, 4)}" + "0" * 4, lambda: f"{a}={n}", lambda: f"20{n % 100:02}{1 + n % 12:02}{1 + n % 28:02}T{n % 24:02}{n % 60:02}{n % 59:02}_{a}{n}", lambda: f"{a}/{b}/{c}_v{n % 9}_{n}_{word()}",
        *(3 * [lambda: draw(_DIGIT, 16, 20)]), lambda: pick(_LOWER + _UPPER) * rng.randrange(16, 60), lambda: f"{a}_{b}_{c}".upper(), lambda: word(6, 12), lambda: "-".join(draw(_DIGIT + "abcdef", k, k + 1) for k in (8, 4, 4, 4, 12)),
    ])()
    while len(body) < LEAST:
        body += joint + word()
    return prose() + pick(["", "", "", pick(_SAID_BEFORE), "see ", "no. ", "ISBN ", "https://www", "card "]), body, after, 0


def lessons(n: int = MADE, seed: int = SEED) -> tuple[np.ndarray, np.ndarray]:
    """Windows and labels of 2 * n made-up cases; of a candidate that is longer than the body, its end or any part."""
    rng, texts, labels = Random(seed), [], []
    for _ in range(2 * n):
        before, body, after, label = made(rng)
        if len(body) > BODY:
            at = len(body) - BODY if label else rng.randrange(len(body) - BODY + 1)
            body = body[at : at + BODY]
        texts.append((before, body, after))
        labels.append(label)
    return _encode(texts), np.array(labels, np.float32)


def _encode(texts: list[tuple[str, str, str]]) -> np.ndarray:
    """Windows of (context before, candidate, context after)."""
    out = np.full((len(texts), LEFT + BODY + RIGHT), _NONE, np.uint8)
    for i, (before, body, after) in enumerate(texts):
        b = _CODE[np.frombuffer(before.encode()[-LEFT:], np.uint8)]
        out[i, LEFT - len(b) : LEFT] = b
        for at, s in ((LEFT, body.encode()[:BODY]), (LEFT + BODY, after.encode()[:RIGHT])):
            out[i, at : at + len(s)] = _CODE[np.frombuffer(s, np.uint8)]
    return out


def _findings(share: float):
    """Windows of all rule findings (label 1), and of words (label 0) of that share of the texts, chosen by the texts' own hashes."""

    def run(batches):
        for batch in slices(batches, 0):
            data, offsets = utf8(batch.column(0))
            raw = data.tobytes()
            rows, starts, ends = candidates(data, offsets)
            x = windows(data, offsets, rows, np.maximum(starts, ends - BODY), ends)  # findings are at the ends of runs
            out = []
            for i, (r, a, b) in enumerate(zip(rows.tolist(), starts.tolist(), ends.tolist())):
                low = max(int(offsets[r]), a - 40)
                near = raw[low : min(int(offsets[r + 1]), b)].decode("utf-8", "replace")
                if any(end == len(near) for _, _, end in base_spans(near)):
                    out.append((1, x[i].tobytes()))
            for r in range(len(offsets) - 1):
                piece = raw[offsets[r] : offsets[r + 1]]
                if len(piece) > 60 and (h := int.from_bytes(hashlib.md5(piece).digest()[:8], "big")) < share * (1 << 64):
                    at = h % (len(piece) - 50)
                    words = piece[at : at + 200].split(b" ")
                    for w in words[1:3]:
                        body = w if len(w) >= 6 else b" ".join(words[1:4])
                        out.append((0, _encode([(piece[max(0, at - LEFT) : at].decode("utf-8", "replace"), body.decode("utf-8", "replace"), "")])[0].tobytes()))
            if out:
                labels, xs = zip(*out)
                yield pa.RecordBatch.from_arrays([pa.array(labels, pa.int32()), pa.array(xs, pa.binary())], ["label", "x"])

    return run


def train(docs: DataFrame, sample: int = SAMPLE) -> CharCnn:
    """The network, fitted on made-up cases and on about ``sample`` findings and as many words of the texts.

    One scan writes the windows of all findings and of the words of a share of the texts; of these, distinct ones with hashes below
    a cut-off, which follows from their number, come to the driver: twice ``sample`` of 80 bytes at most of each kind.
    """
    share = min(1.0, sample / max(docs.count(), 1))
    found = saved(docs.select("text").mapInArrow(_findings(share), "label int, x binary").distinct(), "findings")
    made_x, made_y = lessons()
    xs, ys = [made_x], [made_y]
    for label, n in found.groupBy("label").count().collect():
        below = F.pmod(F.xxhash64("x"), F.lit(1 << 40)) < int(min(1.0, sample / n) * (1 << 40))
        drawn = found.where((F.col("label") == label) & below).orderBy("x").limit(2 * sample) if n > 2 * sample else found.where(F.col("label") == label).orderBy("x")
        x = np.frombuffer(b"".join(r.x for r in drawn.select("x").collect()), np.uint8).reshape(-1, LEFT + BODY + RIGHT)
        xs.append(x)
        ys.append(np.full(len(x), label, np.float32))
        if label:  # once more without their context, so that form counts by itself
            x = x.copy()
            x[:, :LEFT] = _OTHER
            xs.append(x)
            ys.append(np.ones(len(x), np.float32))
    return CharCnn().fit(np.concatenate(xs), np.concatenate(ys))


#: Bytes whose code points are counted at once.
COUNTED = 1 << 22


def _begun(data: np.ndarray, at: np.ndarray) -> np.ndarray:
    """How many code points begin before each of some ascending places of UTF-8 bytes."""
    counts = np.zeros(len(at), np.int64)
    total, low = 0, 0
    for high in range(0, len(data) + COUNTED, COUNTED):
        inner = np.searchsorted(at, [low, high], "left")
        if inner[1] > inner[0]:
            running = np.append(0, np.cumsum((data[low:high] & 0xC0) != 0x80))
            counts[inner[0] : inner[1]] = total + running[at[inner[0] : inner[1]] - low]
        total += int(((data[low:high] & 0xC0) != 0x80).sum())
        low = high
    counts[np.searchsorted(at, low, "left") :] = total
    return counts


def _reaches(spans) -> tuple[list[int], list[int]]:
    """The starts of spans in order, and how far those up to each reach."""
    starts, ends, most = [], [], 0
    for start, _, end in sorted(spans):
        most = max(most, end)
        starts.append(start)
        ends.append(most)
    return starts, ends


def _within(reaches: tuple[list[int], list[int]], start: int, end: int) -> bool:
    """Whether one of the spans holds the whole of another."""
    k = bisect_right(reaches[0], start)
    return k > 0 and reaches[1][k - 1] >= end


def scan(df: DataFrame, id_col: str = "doc_id", text_col: str = "text", model: CharCnn | None = None) -> DataFrame:
    """One row per row of ``df``: id, n_assign, n_access, n_hex, base_sha256, spans, n_added, all spans as kind:start:end."""
    docs = only(df, id=id_col, text=text_col)
    model = model or train(docs)

    def run(batches):
        for batch in slices(batches, 1):
            column = pc.fill_null(batch.column(1), "")
            data, offsets = utf8(column)
            spans: dict[int, list] = {}
            for i in np.flatnonzero(pc.match_substring_regex(column, _MAYBE).to_numpy(zero_copy_only=False)).tolist():
                spans[i] = base_spans(data[offsets[i] : offsets[i + 1]].tobytes().decode())
            added = [0] * batch.num_rows
            rows, starts, ends = candidates(data, offsets, every=True)
            if len(rows):
                good = best_scores(model, data, offsets, rows, starts, ends) >= model.threshold
                rows, starts, ends = rows[good], starts[good], ends[good]
                # candidates are ASCII, so a start's place in code points is a count of what begins before it: one running count of the slice
                at = np.concatenate([offsets[:-1], starts])
                order = np.argsort(at, kind="stable")
                begun = np.zeros(len(at), np.int64)
                begun[order] = _begun(data, at[order])
                first = begun[len(offsets) - 1 :] - begun[rows]
                base = {i: _reaches(spans.get(i, ())) for i in set(rows.tolist())}
                for r, start, n in zip(rows.tolist(), first.tolist(), (ends - starts).tolist()):
                    if not _within(base[r], start, start + n):
                        spans.setdefault(r, []).append((start, 3, start + n))
                        added[r] += 1
            found = [sorted(spans.get(i, ())) for i in range(batch.num_rows)]
            basis = [[s for s in x if s[1] < 3] for x in found]
            of = lambda kind: pa.array([sum(s[1] == kind for s in x) for x in basis], pa.int64())
            yield pa.RecordBatch.from_arrays([
                batch.column(0), of(0), of(1), of(2), pa.array([hashlib.sha256(joined(x).encode()).hexdigest() for x in basis]), pa.array([joined(x) for x in found], pa.string()), pa.array(added, pa.int64()),
            ], [id_col, "n_assign", "n_access", "n_hex", "base_sha256", "spans", "n_added"])

    return docs.select(F.col("id").cast("long"), "text").mapInArrow(run, f"`{id_col}` long, n_assign long, n_access long, n_hex long, base_sha256 string, spans string, n_added long")
