"""Near-duplicate detection: one-permutation MinHash with optimal densification, banded buckets and star-shaped candidates.

One pass over the texts hashes every document's set of word shingles once. The high bits of a shingle's hash choose one of BINS
bins, whose smallest hash is the bin's value; an empty bin takes the value of the first occupied bin in a probe sequence of its
own, the same for all documents, so bins stay independent and unbiased however small a set is. ROWS bins make a band, and equal
bands make a bucket. In a bucket only the edges from its centre, the smallest id, to the others are candidates, which bounds
them by the documents times the bands; every candidate is confirmed on the full sets before it links.

Inside a scan task stars are confirmed at once, and a member that its centre confirms is folded under it: the first round sees
it as its centre, so a group of copies of any size arrives there as one row per slice of a task and band.

Stars alone can miss a link between two members that a bucket's centre confirms neither or only one of. So what stars leave in
different components is tested too, and the folded members of such buckets come back for that: every pair of one bucket and two
components is tested. Buckets of up to FEW members with up to SMALL such pairs a member are tested by further stars, whose centres are outside the
bucket's most frequent component. Of the others' members each set keeps a prefix, its rarest shingles by counts of COUNTS bins of hashes, which is one order for all
sets and needs no table of shingles: as many as a set that is alike enough can't miss, a fifth of them and one more. Only sets of different components that share one of these go on, so that a
template's words, which bring texts into one bucket, bring no work. What goes on is compared in blocks of a bounded number of
shingles and documents: a task compares two blocks by matrix products of which only links leave it, and the sets of a family that
shares prefixes meet in as many tasks as it takes; blocks of the family's most frequent component are not compared with one another.

At a similarity of 0.8 two sets share no bucket with a probability of (1 - 0.8**6)**42 = 3e-6.

Defined results: a text of fewer words than a shingle is one shingle of all its words; a text without words, null or empty, has
no shingle and links with nothing. Rows repeated with the same id are one document. A null id gets a row of its own that links
with nothing. Empty tables give empty results. Other columns of the input are not read.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from geostrata.llm.common import mix64, only, saved, slices, utf8, word_hashes
from geostrata.llm.components import connected_components

BINS, ROWS, BANDS = 256, 6, 42
#: Links of one centre that one task confirms.
STAR = 256
#: Pairs of different components for each member of a bucket, and members of it, up to which further stars are used, and the shingles of a block beyond that.
SMALL, FEW, BLOCK = 16, 64, 150_000
#: Bins in which shingles are counted, whatever the corpus: the rarest ones are those of the smallest bins.
COUNTS = 1 << 18
#: Documents of a block: a task compares two blocks by matrices of so many rows and columns.
BLOCK_DOCS = 2048
#: Shares are compared as integers: PERCENT * union <= 100 * intersection.
PERCENT = 80

_FOLD = np.arange(256, dtype=np.uint8)
_FOLD[65:91] += 32
_IN_WORD = ~np.isin(np.arange(256), [0x20, 9, 10, 11, 12, 13])
_MIX = np.uint64(0x9FB21C651E98DF25)


def _probes() -> tuple[np.ndarray, np.ndarray]:
    """For every bin, bins to look at in turn: random ones at first, and at last every bin once."""
    bins = np.arange(BINS, dtype=np.uint64)[:, None]
    draw = lambda n, salt: (mix64(bins * np.uint64(1 << 20) + np.arange(n, dtype=np.uint64) + np.uint64(salt)) % np.uint64(BINS)).astype(np.int64)
    return draw(24, 1 << 40), np.concatenate([draw(1024, 1 << 41), np.tile(np.arange(BINS), (BINS, 1))], 1)


_SHORT, _LONG = _probes()


def shingle_sets(data: np.ndarray, offsets: np.ndarray, words: int) -> list[np.ndarray]:
    """The sorted distinct shingle hashes of every document."""
    h, rows, _ = word_hashes(data, offsets, _IN_WORD, _FOLD)
    n = len(offsets) - 1
    per = np.bincount(rows, minlength=n) if len(rows) else np.zeros(n, np.int64)
    first = np.cumsum(per) - per
    acc = mix64(h + _MIX)
    for j in range(1, words):
        if len(h) > j:
            acc[:-j] = mix64(acc[:-j] * _MIX + h[j:])
    out = []
    for a, k in zip(first.tolist(), per.tolist()):
        if k >= words:
            out.append(np.unique(acc[a : a + k - words + 1]))
        elif k:  # fewer words than a shingle has: the whole sequence, told apart from shingles by its length
            x = mix64(h[a : a + 1] + np.uint64(k))
            for j in range(1, k):
                x = mix64(x * _MIX + h[a + j : a + j + 1])
            out.append(x)
        else:
            out.append(np.zeros(0, np.uint64))
    return out


def signatures(sets: list[np.ndarray]) -> np.ndarray:
    """The bins' values of non-empty sets, densified: one row per set."""
    values = np.zeros((len(sets), BINS), np.uint64)
    shift = np.uint64(64 - int(np.log2(BINS)))
    for i, s in enumerate(sets):
        bins = (s >> shift).astype(np.int64)  # sets are sorted, so a bin's first hash is its smallest
        new = np.flatnonzero(np.concatenate([[True], bins[1:] != bins[:-1]]))
        own = values[i]
        own[bins[new]] = s[new]
        if len(new) < BINS:
            has = np.zeros(BINS, bool)
            has[bins[new]] = True
            empty = np.flatnonzero(~has)
            probes = _SHORT[empty]
            hit = has[probes]
            at = hit.argmax(1)
            ok = hit[np.arange(len(empty)), at]
            own[empty[ok]] = own[probes[np.arange(len(empty)), at][ok]]
            if not ok.all():
                rest = empty[~ok]
                probes = _LONG[rest]
                own[rest] = own[probes[np.arange(len(rest)), has[probes].argmax(1)]]
    return values


def bands(values: np.ndarray) -> np.ndarray:
    """The hash of every band, in which the band's number counts."""
    parts = values[:, : ROWS * BANDS].reshape(len(values), BANDS, ROWS)
    acc = np.broadcast_to(mix64(np.arange(1, BANDS + 1, dtype=np.uint64)), (len(values), BANDS)).copy()
    for r in range(ROWS):
        acc = mix64(acc * _MIX + parts[:, :, r])
    return acc


def linked(a: np.ndarray, b: np.ndarray, percent: int = PERCENT) -> bool:
    """Whether two sorted sets are alike enough, from the sizes of their intersection and union."""
    if 100 * min(len(a), len(b)) < percent * max(len(a), len(b)) or not len(a):
        return False
    if len(a) > len(b):
        a, b = b, a
    at = np.searchsorted(b, a)
    both = int((b[np.minimum(at, len(b) - 1)] == a).sum())
    return 100 * both >= percent * (len(a) + len(b) - both)


def _scan(words: int, percent: int):
    """The rows that a scan task gives: kind 0 (id, set size), 1 (centre, member confirmed here), 2 (bucket, id), 3 (bucket, id folded under its centre)."""

    def run(batches):
        for batch in slices(batches, 1, 8 << 20, 4096):
            sets = shingle_sets(*utf8(batch.column(1)), words)
            ids = batch.column(0)
            out = [(np.zeros(len(sets), np.int8), ids, pa.array([len(s) for s in sets], pa.int64()))]
            known = ~ids.is_null().to_numpy(zero_copy_only=False)
            live = np.array([i for i, s in enumerate(sets) if len(s) and known[i]], np.int64)
            if len(live):
                number = ids.fill_null(0).to_numpy(zero_copy_only=False)
                live = live[np.argsort(number[live], kind="stable")]
                keys = np.concatenate([bands(signatures([sets[i] for i in live[a : a + 1024]])) for a in range(0, len(live), 1024)])
                who = np.repeat(np.arange(len(live)), BANDS)
                flat = keys.ravel()
                order = np.lexsort((who, flat))
                flat, who = flat[order], who[order]
                begins = np.concatenate([[True], flat[1:] != flat[:-1]])
                centre = who[np.flatnonzero(begins)[np.cumsum(begins) - 1]]
                member = np.flatnonzero(centre != who)
                pairs, of = np.unique(centre[member] * len(live) + who[member], return_inverse=True)
                good = np.array([linked(sets[live[p // len(live)]], sets[live[p % len(live)]], percent) for p in pairs.tolist()], bool)
                stays = np.ones(len(flat), bool)
                if len(pairs):
                    stays[member[good[of]]] = False
                    edges = pairs[good]
                    out.append((np.ones(len(edges), np.int8), pa.array(number[live[edges // len(live)]]), pa.array(number[live[edges % len(live)]])))
                out.append((np.where(stays, 2, 3).astype(np.int8), pa.array(flat.view(np.int64)), pa.array(number[live[who]])))
            for kind, a, b in out:
                yield pa.RecordBatch.from_arrays([pa.array(kind), a.cast(pa.int64()), b.cast(pa.int64())], ["kind", "a", "b"])

    return run


def _confirm(words: int, percent: int):
    """Tests stars: rows come grouped by (centre, part), the centre's own text first in each group."""

    def run(batches):
        key, centre = None, None
        for batch in batches:
            for piece in slices([batch], 4):
                sets = shingle_sets(*utf8(piece.column(4)), words)
                found = []
                for i, row in enumerate(zip(*(piece.column(j).to_pylist() for j in range(4)))):
                    if not row[2]:
                        key, centre = row[:2], sets[i]
                    elif row[:2] == key and linked(centre, sets[i], percent):
                        found.append((row[0], row[3]))
                if found:
                    a, b = zip(*found)
                    yield pa.RecordBatch.from_arrays([pa.array(a, pa.int64()), pa.array(b, pa.int64())], ["a", "b"])

    return run


def confirmed(pairs: DataFrame, docs: DataFrame, words: int, percent: int) -> DataFrame:
    """Those of the distinct ``pairs`` (a: centre, b: member) that link. A centre of many members is dealt out in parts of STAR."""
    parts = pairs.groupBy("a").agg(F.ceil(F.count("*") / STAR).cast("int").alias("parts"))
    placed = pairs.join(parts, "a").select("a", F.pmod(F.xxhash64("b"), F.col("parts")).cast("int").alias("part"), F.col("b").alias("id"), F.lit(True).alias("is_member"))
    centres = parts.select("a", F.explode(F.sequence(F.lit(0), F.col("parts") - 1)).alias("part"), F.col("a").alias("id"), F.lit(False).alias("is_member"))
    rows = saved(placed.union(centres), "stars").hint("merge").join(docs, "id").select("a", "part", "is_member", "id", "text")
    return rows.repartition("a", "part").sortWithinPartitions("a", "part", "is_member").mapInArrow(_confirm(words, percent), "a long, b long")


def _compare(words: int, percent: int):
    """Tests two blocks against each other: rows come grouped by (family, i, j), and say to which of both blocks they belong."""

    def links(group):
        sides = [[r for r in group if r[0] == 0], [r for r in group if r[0] == 1]]
        left, right = sides[0], sides[1] or sides[0]
        if not left or not right:
            return
        tokens = np.concatenate([r[3] for r in left] + [r[3] for r in right])
        at = np.repeat(np.arange(len(left) + len(right)), [len(r[3]) for r in (*left, *right)])
        _, code, count = np.unique(tokens, return_inverse=True, return_counts=True)
        shared = np.flatnonzero(count > 1)
        both = np.zeros((len(left), len(right)), np.float32)
        for low in range(0, len(shared), 2048):
            column = np.full(len(count), -1, np.int64)
            column[shared[low : low + 2048]] = np.arange(len(shared[low : low + 2048]))
            column = column[code]
            hit = column >= 0
            dense = np.zeros((len(left) + len(right), min(2048, len(shared) - low)), np.float32)
            dense[at[hit], column[hit]] = 1
            both += dense[: len(left)] @ dense[len(left) :].T
        size = [np.array([len(r[3]) for r in side], np.int64) for side in (left, right)]
        n = both.astype(np.int64)
        i, j = np.nonzero(100 * n >= percent * (size[0][:, None] + size[1] - n))
        label = [np.array([r[2] for r in side], np.int64)[at] for side, at in ((left, i), (right, j))]
        other = np.flatnonzero(label[0] != label[1])
        # of all links between two components one is enough to make them one
        _, first = np.unique(np.sort(np.stack([x[other] for x in label]), axis=0), axis=1, return_index=True)
        for k in other[first].tolist():
            yield left[i[k]][1], right[j[k]][1]

    def run(batches):
        key, group = None, []

        def close():
            found = list(links(group))
            if found:
                a, b = zip(*found)
                yield pa.RecordBatch.from_arrays([pa.array(a, pa.int64()), pa.array(b, pa.int64())], ["a", "b"])

        for batch in batches:
            for piece in slices([batch], 6):
                sets = shingle_sets(*utf8(piece.column(6)), words)
                for k, row in enumerate(zip(*(piece.column(c).to_pylist() for c in range(6)))):
                    if row[:3] != key:
                        yield from close()
                        key, group = row[:3], []
                    group.append((*row[3:], sets[k]))
        yield from close()

    return run


def _whole_sets(words: int):
    """id, label and the sorted shingle hashes of every document."""

    def run(batches):
        for batch in slices(batches, 2, 1 << 20):
            sets = shingle_sets(*utf8(batch.column(2)), words)
            ends = np.cumsum([0, *map(len, sets)])
            hashes = pa.LargeListArray.from_arrays(pa.array(ends), pa.array(np.concatenate([*sets, np.zeros(0, np.uint64)]).view(np.int64)))
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), hashes.cast(pa.list_(pa.int64()))], ["id", "label", "hashes"])

    return run


def _hashes(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """The hashes of a batch's sets and the offsets of its rows in them."""
    return column.flatten().to_numpy().view(np.uint64), np.append(0, np.cumsum(column.value_lengths().to_numpy()))


def _bin_counts(bins: int):
    """The number of shingles of a task's sets in each bin that has any."""

    def run(batches):
        n = np.zeros(bins, np.int64)
        for batch in batches:
            n += np.bincount((_hashes(batch.column(0))[0] % np.uint64(bins)).astype(np.int64), minlength=bins)
        has = np.flatnonzero(n)
        yield pa.RecordBatch.from_arrays([pa.array(has), pa.array(n[has])], ["bin", "n"])

    return run


def prefix(shingles: np.ndarray, often: np.ndarray, percent: int) -> np.ndarray:
    """The rarest of a sorted set's shingles, by their bins' counts and then by themselves, of which sets that are alike enough share one."""
    order = np.argsort(often[(shingles % np.uint64(len(often))).astype(np.int64)], kind="stable")
    return shingles[order[: len(shingles) - (len(shingles) * percent + 99) // 100 + 1]]


def _prefixes(often, percent: int):
    """A row for each shingle of each set's prefix: the shingle's hash, the id, its label."""

    def run(batches):
        for batch in batches:
            flat, ends = _hashes(batch.column(2))
            found = [prefix(flat[a:b], often.value, percent) for a, b in zip(ends[:-1], ends[1:])]
            at = pa.array(np.repeat(np.arange(len(found)), [len(x) for x in found]))
            yield pa.RecordBatch.from_arrays([pa.array(np.concatenate([*found, np.zeros(0, np.uint64)]).view(np.int64)), batch.column(0).take(at), batch.column(1).take(at)], ["a", "b", "component"])

    return run


def sharing_prefixes(mixed: DataFrame, docs: DataFrame, words: int, percent: int) -> DataFrame:
    """a (a shingle), b (an id), component: the entries of ``mixed`` whose sets share one of their rarest shingles with one of another component.

    Two sets that link share at least ``percent`` of either's shingles, so they share one of all but those and one more, whatever order all sets are cut in.
    """
    members = mixed.select(F.col("b").alias("id"), F.col("component").alias("label")).distinct()
    sets = saved(docs.join(members.hint("merge"), "id").select("id", "label", "text").mapInArrow(_whole_sets(words), "id long, label long, hashes array<long>"), "shingles")
    counts = sets.select("hashes").mapInArrow(_bin_counts(COUNTS), "bin long, n long").groupBy("bin").agg(F.sum("n").alias("n")).toPandas()
    often = np.zeros(COUNTS, np.int64)  # of one size for every corpus
    often[counts["bin"]] = counts["n"]
    shared_counts = docs.sparkSession.sparkContext.broadcast(often)
    prefixes = saved(sets.mapInArrow(_prefixes(shared_counts, percent), "a long, b long, component long"), "prefixes")
    shared = prefixes.groupBy("a").agg(F.min("component").alias("low"), F.max("component").alias("high")).where("low < high").select("a")
    return saved(prefixes.join(shared.hint("merge"), "a", "left_semi"), "shared")


def compared_in_blocks(mixed: DataFrame, sizes: DataFrame, docs: DataFrame, words: int, percent: int) -> DataFrame:
    """Links between members of one family of components, which share entries (a, b, component) of ``mixed``: of two blocks and two
    components one, if there is any. Only links leave the tasks."""
    # families are made of components: members of one are together already
    held = saved(mixed.select("a", "component").distinct(), "held")
    least = held.groupBy("a").agg(F.min("component").alias("least"))
    families = connected_components(held.join(least.hint("merge"), "a").select(F.col("least").alias("a"), F.col("component").alias("b")).distinct())
    known = sizes.groupBy(F.col("a").alias("id")).agg(F.max("b").alias("size"))
    labelled = mixed.select(F.col("b").alias("id"), F.col("component").alias("label")).distinct()
    members = saved(labelled.join(families.select(F.col("id").alias("label"), F.col("component").alias("family")), "label").join(known, "id"), "members")
    labels = members.groupBy("family", "label").agg(F.sum("size").alias("size"), F.count("*").alias("n"))
    # the blocks of the largest component come first, and are compared with the others only
    most = labels.groupBy("family").agg(F.max_by("label", F.struct("size", "label")).alias("most"), F.max(F.struct("size", "label", "n")).alias("first"), F.sum("size").alias("all"), F.sum("n").alias("n"))
    needed = lambda size, n: F.greatest(F.ceil(size / BLOCK), F.ceil(n / BLOCK_DOCS)).cast("int")
    blocks = most.select("family", "most", needed(F.col("first.size"), F.col("first.n")).alias("first"), needed(F.col("all") - F.col("first.size"), F.col("n") - F.col("first.n")).alias("rest"))
    is_most, total = F.col("label") == F.col("most"), F.col("first") + F.col("rest")
    own = F.when(is_most, F.pmod(F.xxhash64("id"), F.col("first"))).otherwise(F.col("first") + F.pmod(F.xxhash64("id"), F.col("rest"))).cast("int")
    placed = members.join(blocks, "family").withColumn("own", own).withColumn("other", F.explode(F.sequence(F.when(is_most, F.col("first")).otherwise(F.lit(0)), total - 1)))
    i, j = F.least("own", "other"), F.greatest("own", "other")
    met = saved(placed.select("family", i.alias("i"), j.alias("j"), (F.col("own") > F.col("other")).cast("int").alias("side"), "id", "label"), "blocks")
    rows = met.hint("merge").join(docs, "id").select("family", "i", "j", "side", "id", "label", "text")
    return rows.repartition("family", "i", "j").sortWithinPartitions("family", "i", "j", "side", "id").mapInArrow(_compare(words, percent), "a long, b long")


def near_duplicates(df: DataFrame, id_col: str = "doc_id", text_col: str = "text", words: int = 5, percent: int = PERCENT) -> DataFrame:
    """One row per row of ``df``: id, n_shingles, component_id (the smallest id that links reach), kept (it is the id itself)."""
    docs = only(df, id=id_col, text=text_col).withColumn("id", F.col("id").cast("long"))
    rows = saved(docs.mapInArrow(_scan(words, percent), "kind byte, a long, b long"), "sets")
    # what the scan tasks left together: buckets and their centres; a bucket of any size is a join's key, which adaptive execution may split
    stays = rows.where("kind = 2").select("a", "b")
    centres = saved(stays.groupBy("a").agg(F.min("b").alias("centre"), F.count("*").alias("n")).where("n > 1").select("a", "centre"), "centres")
    buckets = saved(stays.join(centres, "a").select("a", "b", "centre"), "buckets")
    # only members of a bucket are compared; their texts are moved once, by a join that is the same at every size
    texts = saved(docs.join(buckets.select(F.col("b").alias("id")).distinct().hint("merge"), "id"), "texts")
    links = rows.where("kind = 1 and a <> b").select("a", "b")
    pairs = saved(buckets.where("b <> centre").select(F.col("centre").alias("a"), "b").distinct(), "pairs")
    links = saved(links.union(confirmed(pairs, texts, words, percent)), "links")
    components = connected_components(links)
    # what a bucket holds besides matters where it is of two components
    named = lambda entries: entries.join(components, entries.b == components.id, "left").withColumn("component", F.coalesce("component", "b")).drop("id")
    stayed = saved(named(buckets).select("a", "b", "component", (F.col("b") == F.col("centre")).alias("is_centre")), "stayed")
    open_ = stayed.groupBy("a").agg(F.min("component").alias("low"), F.max("component").alias("high")).where("low < high").select("a")
    folded = saved(named(rows.where("kind = 3").select("a", "b").join(open_, "a", "left_semi")).select("a", "b", "component"), "folded")
    # a centre is done with where nothing is folded: its links to all that stayed are known
    folds = folded.select("a").distinct().withColumn("folds", F.lit(True))
    stayed = stayed.join(open_, "a", "left_semi").join(folds, "a", "left").where("folds or not is_centre").select("a", "b", "component")
    entries = saved(stayed.union(folded).distinct(), "entries")
    shares = entries.groupBy("a", "component").agg(F.count("*").alias("n"))
    shares = shares.groupBy("a").agg(F.max_by("component", F.struct("n", "component")).alias("most"), F.sum("n").alias("n"), F.sum(F.col("n") * F.col("n")).alias("squares"), F.count("*").alias("components"))
    mixed = saved(entries.join(shares.where("components > 1"), "a").select("a", "b", "component", "most", ((F.col("n") <= FEW) & ((F.col("n") * F.col("n") - F.col("squares")) / 2 <= SMALL * F.col("n"))).alias("few")), "mixed")
    small = mixed.where("few")
    other = small.where("component <> most").select("a", F.col("b").alias("c"), F.col("component").alias("c_component"))
    pairs = small.join(other, "a").where("component <> c_component and (component = most or b < c)")
    pairs = saved(pairs.select(F.col("c").alias("a"), "b").distinct(), "pairs")
    # those that were folded in every bucket of theirs have no text there yet
    late = mixed.select(F.col("b").alias("id")).distinct().join(buckets.select(F.col("b").alias("id")).distinct(), "id", "left_anti")
    texts = texts.unionByName(saved(docs.join(late.hint("merge"), "id"), "late"))
    more = confirmed(pairs, texts, words, percent)
    large = mixed.where("not few")
    if not large.isEmpty():
        shared = sharing_prefixes(large, texts, words, percent)
        if not shared.isEmpty():
            more = more.union(compared_in_blocks(shared, rows.where("kind = 0"), texts, words, percent))
    more = saved(more, "links")
    if not more.isEmpty():
        components = connected_components(links.union(more))
    found = rows.where("kind = 0").select(F.col("a").alias("id"), F.col("b").alias("n_shingles")).join(components, "id", "left")
    component = F.coalesce("component", "id")
    return found.select(F.col("id").alias(id_col), "n_shingles", component.alias("component_id"), component.eqNullSafe(F.col("id")).alias("kept"))
