"""Alignment of the tokens that two vocabularies cut the same text into.

Texts are cut into *segments* at places where both vocabularies always cut: before a space that follows no white space. The tokens of a
text are those of its segments, one after the other, so each distinct segment is tokenized and aligned once for the whole corpus, and the
relational work grows with distinct segments instead of tokens. On segments it goes: tokens by posexplode, their ends by a windowed sum of
their byte lengths, an equi-join on segment and end, and the running count of common ends, the cuts, as the number of a group. Between two
neighbouring ends lies one token of either vocabulary, and two tokens overlap if and only if one such interval lies in both: a link is an
interval with its two tokens, so ranges are joined without making the pairs of a group.

A *slice* is the documents of one task up to ``SLICE`` characters; it numbers its own segments, and a document is the list of these numbers. A distinct
segment carries its *places*, the slices that hold it with its number in each, so once aligned it is dealt to the slices without a join on its text; there
documents are composed in arrays. How many documents hold a pair linked is counted in slices, a document once, and then summed. Segments get the sums over
their links' counts by a join on the pair, and slices meet them once more.

Defined results: null and empty texts have no tokens, nor have texts whose tokens' bytes differ from the text with a space before it (as those with
U+2581); their numbers are 0, their digest is empty, and they count for no pair. A text is cut whole, whatever its length; one without spaces is one segment.
Rows with equal or null ids are documents of their own. An empty table gives an empty result. Other columns are not read, whatever their names.
"""

from __future__ import annotations

import hashlib
import json
import re
from functools import cache, reduce
from itertools import chain

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import sentencepiece
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from tokenizers import Tokenizer

from geostrata.llm.common import dropped, only, released, saved_lean, slices, utf8

#: Settings that name the two vocabularies' files, which the driver reads, and where they are else looked for.
FILES = {"spark.geostrata.align.a": "/opt/tokenizers/byte_bpe_50k.json", "spark.geostrata.align.b": "/opt/tokenizers/piece_bpe_32k.model"}
#: Characters of a slice, about: a task composes a slice's documents in arrays of about ten times as much memory.
SLICE = 1 << 24
#: Aligned segments reach the slices in so many rounds: only one round's shuffle files are on the disks at a time.
ROUNDS = 3
#: Segments are aligned in so many parts, for the same reason.
PARTS = 2
#: Pairs whose counts are broadcast; more of them are joined.
FEW_PAIRS = 200_000
#: Places whose segments are tokenized at once, and occurrences of pairs that are counted at once.
PLACES, PAIRS = 10_000, 1 << 19
#: What counts as white here: all that either side may take for it, since a place that is no cut does no harm.
WHITE = frozenset(c for c in map(chr, range(0x3001)) if c.isspace()) | {"\u180e"}
_NO_CUT = re.compile("[" + "".join(map(re.escape, sorted(WHITE))) + "] ")
_ODD = "^ |[" + "".join(f"\\x{{{ord(c):x}}}" for c in sorted(WHITE)) + "] "
_SPACE = "▁"


class ByteLevel:
    """A byte-level vocabulary (JSON)."""

    def __init__(self, content: bytes):
        self.known = Tokenizer.from_buffer(content)
        self.known.encode_special_tokens = True
        # the format's fixed rule: bytes that print stand for themselves, the others for the code points from 256 on
        plain = [*range(33, 127), *range(161, 173), *range(174, 256)]
        sign = {chr(b): b for b in plain} | {chr(256 + i): b for i, b in enumerate(b for b in range(256) if b not in plain)}
        special = {t.content for t in self.known.get_added_tokens_decoder().values()}
        vocabulary = self.known.get_vocab()
        self.bytes = [b""] * (max(vocabulary.values()) + 1)
        for token, i in vocabulary.items():
            self.bytes[i] = token.encode() if token in special else bytes(sign[c] for c in token)
        cutter = json.loads(content).get("pre_tokenizer") or {}
        self.cuts_at_spaces = cutter.get("type") == "ByteLevel" and cutter.get("use_regex", True) and not cutter.get("add_prefix_space")

    def encode(self, texts: list[str]) -> list[list[int]]:
        """The tokens of texts with a space before each."""
        return [e.ids for e in self.known.encode_batch_fast([" " + t for t in texts], add_special_tokens=False)]


class Pieces:
    """A vocabulary of pieces with a mark for spaces, which adds the space before a text itself."""

    def __init__(self, content: bytes):
        self.known = sentencepiece.SentencePieceProcessor(model_proto=content)
        ids = range(self.known.get_piece_size())
        names = [self.known.id_to_piece(i) for i in ids]
        self.bytes = [bytes([int(n[3:5], 16)]) if self.known.is_byte(i) else n.replace(_SPACE, " ").encode() for i, n in zip(ids, names)]
        self.space = self.known.piece_to_id(_SPACE)
        whole = "a  b c "
        self.cuts_at_spaces = not self.known.is_unknown(self.space) and not any(_SPACE in n.lstrip(_SPACE) for n in names) and b"".join(self.bytes[i] for i in self.known.encode(whole)) == b" " + whole.encode()

    def encode(self, texts: list[str]) -> list[list[int]]:
        """The tokens of texts with a space before each."""
        return [ids if t else [self.space] for t, ids in zip(texts, self.known.encode(texts, num_threads=1))]


@cache
def vocabularies(a: bytes, b: bytes) -> tuple[ByteLevel, Pieces]:
    """Both vocabularies; a worker makes them once."""
    return ByteLevel(a), Pieces(b)


def contents(spark: SparkSession) -> tuple[bytes, bytes]:
    found = []
    for setting, path in FILES.items():
        with open(spark.conf.get(setting, path), "rb") as f:
            found.append(f.read())
    return tuple(found)


def segments(text: str) -> list[str]:
    """The segments of a text, each without the space it begins with: joined by spaces they are the text."""
    if text[0] != " " and not _NO_CUT.search(text):
        return text.split(" ")
    found, held = [], None
    for part in text.split(" "):
        held = part if held is None else held + " " + part
        if part and part[-1] not in WHITE:
            found.append(held)
            held = None
    return found if held is None else [*found, held]


def cut(texts: pa.Array, at_spaces: bool) -> pa.ListArray:
    """The segments of every text of a batch, none of null and empty ones; texts that are cut before all their spaces are so in one call."""
    texts = pc.fill_null(texts, "").cast(pa.string())
    odd = np.ones(len(texts), bool)
    if at_spaces:
        odd = pc.or_(pc.equal(texts, ""), pc.match_substring_regex(texts, _ODD)).to_numpy(zero_copy_only=False)
    plain = pc.split_pattern(texts.filter(pa.array(~odd)), " ")
    if not odd.any():
        return plain
    own = [[] if not t else segments(t) if at_spaces else [t] for t in texts.filter(pa.array(odd)).to_pylist()]
    order = np.argsort(np.concatenate([np.flatnonzero(~odd), np.flatnonzero(odd)]))
    return pa.concat_arrays([plain, pa.array(own, plain.type)]).take(pa.array(order))


def sliced(docs: DataFrame, at_spaces: bool, most: int) -> DataFrame:
    """Rows of documents (slice, row, id, seq) and of segments (slice, at, segment) of all slices; ``seq`` holds a document's ``at`` in order."""

    def run(batches):
        first, number = TaskContext.get().partitionId() << 32, 0
        ids, cuts, size = [], [], 0

        def closed():
            numbered = pa.chunked_array([x.flatten() for x in cuts]).dictionary_encode().combine_chunks()
            ends = np.cumsum(np.concatenate([[0], *(x.value_lengths() for x in cuts)]), dtype=np.int32)
            n, k = len(ends) - 1, len(numbered.dictionary)
            slice_ = first + number
            id_column = pa.chunked_array(ids).combine_chunks()
            none = lambda kind, m: pa.nulls(m, kind)
            yield pa.RecordBatch.from_arrays([pa.array(np.full(n, slice_)), pa.array(np.arange(n, dtype=np.int32)), id_column, pa.ListArray.from_arrays(pa.array(ends), numbered.indices), none(pa.int32(), n), none(pa.string(), n)], names)
            yield pa.RecordBatch.from_arrays([pa.array(np.full(k, slice_)), none(pa.int32(), k), none(id_column.type, k), none(pa.list_(pa.int32()), k), pa.array(np.arange(k, dtype=np.int32)), numbered.dictionary], names)

        for batch in slices(batches, 1):
            lists, chars, at = cut(batch.column(1), at_spaces), pc.fill_null(pc.utf8_length(batch.column(1)), 0).to_numpy(), 0
            while at < batch.num_rows:
                sizes = size + np.cumsum(chars[at:], dtype=np.int64)
                n = min(int(np.searchsorted(sizes, most)) + 1, len(sizes))  # the document that fills a slice is its last
                ids.append(batch.column(0).slice(at, n))
                cuts.append(lists.slice(at, n))
                at, size = at + n, int(sizes[n - 1])
                if size >= most:
                    yield from closed()
                    number, size = number + 1, 0
                    ids.clear()
                    cuts.clear()
        if cuts:
            yield from closed()

    names = ["slice", "row", "id", "seq", "at", "segment"]
    return docs.mapInArrow(run, f"slice long, row int, id {docs.schema['id'].dataType.simpleString()}, seq array<int>, at int, segment string")


def batched(vocabulary: ByteLevel | Pieces, size: np.ndarray, texts: list[str], spans: np.ndarray) -> tuple[np.ndarray, np.ndarray] | None:
    """The tokens of segments and how many each has, from the one text that they make; ``spans`` are the segments' bytes. None where
    the tokens don't end where the segments do or their bytes differ."""
    ids = np.array(vocabulary.encode([" ".join(texts)])[0], np.int32)
    last = np.searchsorted(np.cumsum(size[ids]), np.cumsum(spans))
    if len(ids) == 0 or last[-1] != len(ids) - 1 or (np.cumsum(size[ids])[last] != np.cumsum(spans)).any() or b"".join(map(vocabulary.bytes.__getitem__, ids.tolist())) != (" " + " ".join(texts)).encode():
        return None
    return ids, np.diff(last, prepend=-1)


def one_by_one(vocabulary: ByteLevel | Pieces, texts: list[str]) -> tuple[np.ndarray, np.ndarray]:
    """The same segment by segment; one whose tokens' bytes differ has none."""
    found = [ids if b"".join(map(vocabulary.bytes.__getitem__, ids)) == (" " + t).encode() else [] for t, ids in zip(texts, vocabulary.encode(texts))]
    return np.fromiter(chain.from_iterable(found), np.int32), np.array([len(x) for x in found], np.int64)


def tokenized(parts: DataFrame, a: bytes, b: bytes, at_spaces: bool) -> DataFrame:
    """Every distinct segment with the places that hold it (slices of_slice, and its numbers at in them), its tokens of both vocabularies and
    their sizes in bytes; without any where bytes differ. Equal segments lie side by side, as a sort by one number puts them; where a batch of ``PLACES``
    ends among them, or another segment has their number, they are several rows, and each place is in one of them."""
    shared = parts.sparkSession.sparkContext.broadcast((a, b))  # two vocabularies, whatever the corpus

    def run(batches):
        both = vocabularies(*shared.value)
        sizes = [np.array([len(x) for x in v.bytes], np.int32) for v in both]
        for batch in slices(batches, 0, most_rows=PLACES):
            runs = pc.run_end_encode(batch.column(0))
            held_by, first = runs.values, np.append(0, runs.run_ends.to_numpy())
            of_slice, at = (pa.ListArray.from_arrays(pa.array(first.astype(np.int32)), batch.column(c)) for c in (1, 2))
            texts = held_by.to_pylist()
            # a segment that ends in white space is the last of its text: nothing may follow it
            inner = [i for i, t in enumerate(texts) if at_spaces and t and t[-1] not in WHITE]
            for rows in (inner, sorted(set(range(len(texts))) - set(inner))):
                if not rows:
                    continue
                own = [texts[i] for i in rows]
                spans = np.array([1 + len(t.encode()) for t in own])
                found = [(batched(v, size, own, spans) if rows is inner else None) or one_by_one(v, own) for v, size in zip(both, sizes)]
                whole = (found[0][1] > 0) & (found[1][1] > 0)
                columns = [x.take(pa.array(rows)) for x in (of_slice, at)]
                for (ids, counts), size in zip(found, sizes):
                    ids = ids[np.repeat(whole, counts)]
                    ends = pa.array(np.append(0, np.cumsum(np.where(whole, counts, 0))).astype(np.int32))
                    columns += [pa.ListArray.from_arrays(ends, pa.array(ids)), pa.ListArray.from_arrays(ends, pa.array(size[ids].astype(np.int16)))]
                yield pa.RecordBatch.from_arrays(columns, ["of_slice", "at", "a", "a_sizes", "b", "b_sizes"])

    places = parts.where("segment is not null").select("segment", "slice", "at").repartition("segment").sortWithinPartitions(F.xxhash64("segment"))
    return places.mapInArrow(run, "of_slice array<long>, at array<int>, a array<int>, a_sizes array<smallint>, b array<int>, b_sizes array<smallint>").withColumn("seg", F.monotonically_increasing_id())


def ends(tokens: DataFrame, side: str) -> DataFrame:
    """seg, end and id of every token of one side."""
    each = tokens.select("seg", side, f"{side}_sizes").repartition("seg").select("seg", F.posexplode(F.arrays_zip(side, f"{side}_sizes")).alias("pos", "token")).select("seg", "pos", f"token.{side}", F.col(f"token.{side}_sizes").cast("long").alias("size"))
    return each.select("seg", side, F.sum("size").over(Window.partitionBy("seg").orderBy("pos").rowsBetween(Window.unboundedPreceding, 0)).alias("end"))


def intervals(tokens: DataFrame) -> DataFrame:
    """A row for every end of a token in ``tokens`` (seg, a, a_sizes, b, b_sizes): seg, end, the tokens a and b that end there, null for
    none, the number of the group it belongs to, and link_a and link_b, the tokens over the interval that ends there. Both sides are dealt by
    segment, lists as they are, and stay so: neither the join nor a window moves a token."""
    both = ends(tokens, "a").join(ends(tokens, "b"), ["seg", "end"], "full_outer")
    later = Window.partitionBy("seg").orderBy(F.desc("end")).rowsBetween(Window.unboundedPreceding, 0)
    cut = (F.col("a").isNotNull() & F.col("b").isNotNull()).cast("int")
    # cuts are counted from the segment's end, so that one order serves for groups and links
    return both.select("seg", "end", "a", "b", (-F.sum(cut).over(later)).alias("group"), F.last("a", True).over(later).alias("link_a"), F.last("b", True).over(later).alias("link_b"))


def written(batches):
    """Rows of segments (seg, of_slice, at, n_a, n_b, n_groups, groups, links) from those with their intervals r (end, link, mark) in any order."""
    for batch in batches:
        r = batch.column("r")
        counts = np.nan_to_num(r.value_lengths().to_numpy(zero_copy_only=False)).astype(np.int64)
        end, link, mark = (x.to_numpy(zero_copy_only=False) for x in r.flatten().flatten())
        n, of_row = len(counts), np.repeat(np.arange(len(counts)), counts)
        order = np.argsort(of_row * (int(end.max(initial=0)) + 1) + end, kind="stable")
        row, ids, kind = of_row[order], link[order], mark[order] & 3
        group = np.cumsum(np.append(True, (np.diff(row) != 0) | (np.diff(mark[order] >> 2) != 0))[: len(row)]) - 1
        cuts = row[kind == 3]

        def joined(values, of, most, sign):
            return pc.binary_join(pa.ListArray.from_arrays(pa.array(np.append(0, np.cumsum(np.bincount(of, minlength=most))).astype(np.int32)), values), sign)

        sides = [joined(pa.array(x[kind & bit > 0]).cast(pa.string()), group[kind & bit > 0], len(cuts), ",") for bit, x in ((1, ids >> 32), (2, ids & (1 << 32) - 1))]
        columns = [batch.column(c) for c in ("seg", "of_slice", "at")] + [pa.array(np.bincount(x, minlength=n).astype(np.int32)) for x in (row[kind & 1 > 0], row[kind & 2 > 0], cuts)]
        columns += [joined(pc.binary_join_element_wise(*sides, "|"), cuts, n, ";"), pa.ListArray.from_arrays(pa.array(np.append(0, np.cumsum(counts)).astype(np.int32)), pa.array(link))]
        yield pa.RecordBatch.from_arrays(columns, ["seg", "of_slice", "at", "n_a", "n_b", "n_groups", "groups", "links"])


def aligned(tokens: DataFrame) -> DataFrame:
    """One row per row of ``tokens``: seg, of_slice, at, n_a, n_b, n_groups, groups (their text) and links (a pair's ids as one number)."""
    link = F.col("link_a").cast("long") * (1 << 32) + F.col("link_b")
    # which sides' tokens end here: a token that does is the one over the interval
    ends_here = F.col("a").isNotNull().cast("int") + 2 * F.col("b").isNotNull().cast("int")
    rows = intervals(tokens).groupBy("seg").agg(F.collect_list(F.struct("end", link.alias("link"), (F.col("group") * 4 + ends_here).alias("mark"))).alias("r"))
    return tokens.select("seg", "of_slice", "at").join(rows, "seg", "left").mapInArrow(written, "seg long, of_slice array<long>, at array<int>, n_a int, n_b int, n_groups int, groups string, links array<long>")


def at_places(found: DataFrame, *columns: str) -> DataFrame:
    """A row (of_slice, at and ``columns``) for every place of every row."""
    return found.select(F.explode(F.arrays_zip("of_slice", "at")).alias("place"), *columns).select("place.of_slice", "place.at", *columns)


def _lists(column: pa.ChunkedArray) -> tuple[np.ndarray, np.ndarray]:
    """The values of a list column and the offsets of its rows in them; null rows are empty."""
    column = column.combine_chunks() if isinstance(column, pa.ChunkedArray) else column
    counts = np.nan_to_num(column.value_lengths().to_numpy(zero_copy_only=False)).astype(np.int64)
    return column.flatten().to_numpy(zero_copy_only=False), np.append(0, np.cumsum(counts))


def _held(docs: pa.Table, found: pa.Table) -> tuple[np.ndarray, np.ndarray]:
    """The rows of ``found`` that hold a slice's documents' segments, in order, and the offsets of the documents in them."""
    seq, offsets = _lists(docs["seq"])
    rows = np.empty(found.num_rows, np.int64)
    rows[found["at"].to_numpy()] = np.arange(found.num_rows)
    return rows[seq], offsets


def _distinct(values: np.ndarray) -> np.ndarray:
    """np.unique by sorting: numpy's own hashes integers, thirty times slower on half a million of them."""
    values = np.sort(values)
    return values[np.append(True, values[1:] != values[:-1])[: len(values)]]


def _sums(values: np.ndarray, seq: np.ndarray, offsets: np.ndarray) -> np.ndarray:
    """The sum of a segment's value over the segments of each document."""
    total = np.append(0, np.cumsum(values[seq]) if len(seq) else np.zeros(0, np.int64))
    return total[offsets[1:]] - total[offsets[:-1]]


def held_pairs(seq: np.ndarray, offsets: np.ndarray, links: np.ndarray, link_offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The distinct pairs of some documents' segments, and how many of the documents hold each."""
    names = _distinct(links)
    pair = np.searchsorted(names, links)
    counts, k = np.zeros(len(names), np.int64), len(link_offsets) - 1
    of_doc = np.repeat(np.arange(len(offsets) - 1), np.diff(offsets))
    size = np.diff(link_offsets)
    weight = np.append(0, np.cumsum(size[seq]) if len(seq) else np.zeros(0, np.int64))[offsets]
    at = 0
    while at < len(offsets) - 1:  # whole documents of so many occurrences at most, or one document
        to = max(at + 1, int(np.searchsorted(weight, weight[at] + PAIRS, "right")) - 1)
        own = _distinct(of_doc[offsets[at] : offsets[to]] * k + seq[offsets[at] : offsets[to]])
        doc, seg = own // max(k, 1), own % max(k, 1)
        n = size[seg]
        places = np.repeat(link_offsets[seg] - (np.cumsum(n) - n), n) + np.arange(int(n.sum()))
        held = _distinct(np.repeat(doc, n) * len(names) + pair[places])
        counts += np.bincount(held % max(len(names), 1), minlength=len(names))[: len(names)] if len(held) else 0
        at = to
    return names, counts


def digests(groups: pa.Array, seq: np.ndarray, offsets: np.ndarray) -> list[str]:
    """The digest of every document's groups, those of its segments with a semicolon between; "" without segments."""
    large = pa.large_string()
    said, found, at = pc.binary_join_element_wise(pa.scalar("", large), groups.cast(large), pa.scalar(";", large)), [], 0
    while at < len(offsets) - 1:  # whole documents of so many segments at most, or one document
        to = max(at + 1, int(np.searchsorted(offsets, offsets[at] + PAIRS, "right")) - 1)
        data, ends = utf8(said.take(pa.array(seq[offsets[at] : offsets[to]])))
        ends = ends[offsets[at : to + 1] - offsets[at]]
        found += [hashlib.sha256(data[start + 1 : end]).hexdigest() if end > start else "" for start, end in zip(ends[:-1], ends[1:])]
        at = to
    return found


def composed(docs: DataFrame, found: DataFrame, id_type: str) -> DataFrame:
    """Rows of documents (slice, row, id, n_a, n_b, n_groups, n_links, groups_sha256) and of the pairs of a slice (pair, n_docs)."""

    def run(left: pa.Table, right: pa.Table) -> pa.Table:
        seq, offsets = _held(left, right)
        n = left.num_rows
        of = {c: right[c].to_numpy().astype(np.int64) for c in ("n_a", "n_b", "n_groups")}
        links, link_offsets = _lists(right["links"])
        of["n_links"] = np.diff(link_offsets)
        whole = (_sums((of["n_a"] == 0).astype(np.int64), seq, offsets) == 0) & (np.diff(offsets) > 0)
        said = np.where(whole, digests(right["groups"].combine_chunks(), seq, offsets), "")
        kept = np.repeat(whole, np.diff(offsets))
        pairs, counts = held_pairs(seq[kept], np.append(0, np.cumsum(np.where(whole, np.diff(offsets), 0))), links, link_offsets)
        m = len(pairs)
        padded = lambda values: pa.concat_arrays([pa.array(values, pa.int64()), pa.nulls(m, pa.int64())])
        columns = {"slice": padded(left["slice"].to_numpy()), "row": padded(left["row"].to_numpy()), "id": pa.concat_arrays([left["id"].combine_chunks(), pa.nulls(m, left["id"].type)])}
        columns |= {c: padded(np.where(whole, _sums(v, seq, offsets), 0)) for c, v in of.items()}
        columns["groups_sha256"] = pa.concat_arrays([pa.array(said, pa.string()), pa.nulls(m, pa.string())])
        columns |= {c: pa.concat_arrays([pa.nulls(n, pa.int64()), pa.array(v, pa.int64())]) for c, v in (("pair", pairs), ("n_docs", counts))}
        released()
        return pa.table(columns)

    schema = f"slice long, row long, id {id_type}, n_a long, n_b long, n_groups long, n_links long, groups_sha256 string, pair long, n_docs long"
    return docs.groupBy("slice").cogroup(found.groupBy("of_slice")).applyInArrow(run, schema)


def summed(docs: DataFrame, found: DataFrame) -> DataFrame:
    """slice, row, n_best and count_sum of every document from those of its segments."""

    def run(left: pa.Table, right: pa.Table) -> pa.Table:
        seq, offsets = _held(left, right)
        columns = {"slice": left["slice"], "row": left["row"].cast(pa.int64())}
        return pa.table(columns | {c: _sums(right[c].to_numpy().astype(np.int64), seq, offsets) for c in ("n_best", "count_sum")})

    return docs.groupBy("slice").cogroup(found.groupBy("of_slice")).applyInArrow(run, "slice long, row long, n_best long, count_sum long")


def pair_counts(pairs: DataFrame) -> DataFrame:
    """pair, count (of documents) and best (1 if its count is the highest of its A id) from the pairs of slices."""
    counts = pairs.groupBy("pair").agg(F.sum("n_docs").alias("count"))
    highest = counts.groupBy(F.shiftright("pair", 32).alias("a")).agg(F.max("count").alias("highest"))
    return counts.withColumn("a", F.shiftright("pair", 32)).join(highest, "a").select("pair", "count", (F.col("count") == F.col("highest")).cast("int").alias("best"))


def of_round(slice_, r: int, n: int):
    """Whether a slice is met in round ``r`` of ``n``: a task's slices, and the first ones of tasks, go to one round after the other, so that rounds are of one size
    where slices are few."""
    return F.pmod(F.shiftright(slice_, 32) + slice_.bitwiseAND((1 << 32) - 1), F.lit(n)) == r


def align(df: DataFrame, id_col: str = "doc_id", text_col: str = "text", slice_chars: int = SLICE, few_pairs: int = FEW_PAIRS) -> DataFrame:
    """One row per row of ``df``: id, n_a, n_b, n_groups, n_links, n_best, count_sum and groups_sha256."""
    a, b = contents(df.sparkSession)
    at_spaces = all(v.cuts_at_spaces for v in vocabularies(a, b))
    docs = only(df, id=id_col, text=text_col)
    parts = saved_lean(sliced(docs, at_spaces, slice_chars), "slices")
    tokens = saved_lean(tokenized(parts, a, b, at_spaces), "tokens")
    rows = parts.where("seq is not null").select("slice", "row", "id", "seq")
    id_type = docs.schema["id"].dataType.simpleString()
    known = reduce(DataFrame.unionByName, [saved_lean(aligned(tokens.where(F.pmod("seg", F.lit(PARTS)) == p)), "aligned") for p in range(PARTS)])
    dropped(tokens)
    # a segment that isn't whole has no tokens, so their number tells
    meet = lambda r: at_places(known, "n_a", "n_b", "n_groups", "groups", "links").where(of_round(F.col("of_slice"), r, ROUNDS))
    both = reduce(DataFrame.unionByName, [saved_lean(composed(rows.where(of_round(F.col("slice"), r, ROUNDS)), meet(r), id_type), "composed") for r in range(ROUNDS)])
    counts = saved_lean(pair_counts(both.where("pair is not null")), "counts")
    counts = F.broadcast(counts) if counts.count() <= few_pairs else counts
    of_links = known.select("seg", F.explode("links").alias("pair")).join(counts, "pair").groupBy("seg").agg(F.sum("best").alias("n_best"), F.sum("count").alias("count_sum"))
    values = saved_lean(known.select("seg", "of_slice", "at").join(of_links, "seg", "left").drop("seg").na.fill(0, ["n_best", "count_sum"]), "values")
    dropped(known)
    sums = saved_lean(summed(rows, at_places(values, "n_best", "count_sum")), "sums")
    found = both.where("slice is not null").join(sums, ["slice", "row"])
    # a document without tokens counts for nothing, whatever its other segments
    has = F.col("groups_sha256") != ""
    return found.select(F.col("id").alias(id_col), "n_a", "n_b", "n_groups", "n_links", *(F.when(has, F.col(c)).otherwise(0).alias(c) for c in ("n_best", "count_sum")), "groups_sha256")
