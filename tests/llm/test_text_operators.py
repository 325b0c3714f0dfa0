"""Each operator against a brute-force version, on rows with nulls, empty and long texts, ties, repeats and clashing columns."""

import base64
import gzip
import hashlib
import itertools
import random
import re
import zlib

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from geostrata.llm import chat, common, components, decontaminate, exact_dedup, minhash, packing, pii, quality, secrets, warc
from geostrata.llm.common import saved, scratch, slices, utf8, word_hashes

DOCS = [
    (1, "The quick brown fox jumps over the lazy dog and runs away from all of the others"),
    (2, "The quick brown fox jumps over the lazy dog and runs away from all of the  others\n"),
    (3, "the QUICK brown fox jumps over the lazy dog and runs away from all of the other"),
    (4, None), (5, ""), (6, " \t\n"), (7, "one"), (8, "one"), (9, "word " * 5000), (10, "é ü ß 漢字 " * 3), (11, "one two"), (11, "one two"), (None, "one two"), (12, "x" * 30000),
]
LOWER = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


@pytest.fixture(scope="module")
def docs(spark):
    """Documents with further columns whose names the operators use inside."""
    df = spark.createDataFrame(DOCS, "doc_id long, text string")
    return df.withColumns({c: F.lit(c) for c in ("id", "key", "row", "a", "words", "score", "kind")})


@pytest.fixture(scope="module")
def empty(spark):
    return spark.createDataFrame([], "doc_id long, text string")


def got(df, *cols):
    return sorted((tuple(r[c] for c in cols) for r in df.collect()), key=str)


def test_slices_cover_all_rows():
    batch = pa.RecordBatch.from_pydict({"i": list(range(50)), "t": ["x" * (i * 7 % 40) for i in range(50)]})
    assert [i for part in slices([batch], 1, 60, 7) for i in part.column(0).to_pylist()] == list(range(50))


def test_word_hashes_tell_words_apart():
    texts = ["alpha beta alpha", "", "beta", "a" * 100 + " " + "a" * 101]
    h, rows, _ = word_hashes(*utf8(pa.array(texts)), ~np.isin(np.arange(256), list(b" ")))
    assert rows.tolist() == [0, 0, 0, 2, 3, 3]
    assert h[0] == h[2] and h[1] == h[3] and len(set(h.tolist())) == 4


def test_exact_dedup(docs, empty):
    norm = {i: (t or "").translate(str.maketrans("", "", " \t\n\v\f\r")) for i, t in enumerate(t for _, t in DOCS)}
    wanted = []
    for k, (i, t) in enumerate(DOCS):
        same = [DOCS[j] for j in norm if norm[j] == norm[k]]
        best = min(same, key=lambda r: (-len(r[1] or ""), r[0] is None, r[0] or 0))
        wanted.append((i, best[0], len(same), i == best[0] and len(t or "") == len(best[1] or ""), hashlib.sha256(norm[k].encode()).hexdigest()))
    cols = ("doc_id", "keep_id", "group_size", "kept", "text_sha256")
    assert got(exact_dedup.exact_dedup(docs), *cols) == sorted(wanted, key=str)
    assert got(exact_dedup.exact_dedup(docs, bucket_bytes=100, max_depth=4), *cols) == sorted(wanted, key=str)
    assert exact_dedup.exact_dedup(empty).count() == 0


def test_buckets_split_until_they_fit():
    load = np.random.default_rng(0).integers(0, 9, 64)
    load[5] = 100
    slots, loads = exact_dedup.split_buckets(load, 20)
    assert loads.sum() == load.sum() and loads.max() == 100 and sorted(loads)[-2] <= 20
    owners = exact_dedup.deal(loads, 4)
    assert (np.diff(owners) >= 0).all() and owners.max() <= 3 and (np.diff(slots) >= 0).all()


def shingles(text, n):
    w = re.findall(r"[^\x20\x09-\x0D]+", (text or "").translate(LOWER))
    return frozenset(tuple(w[i : i + n]) for i in range(len(w) - n + 1)) if len(w) >= n else frozenset([tuple(w)] if w else [])


def brute_components(rows, n):
    sets = {i: shingles(t, n) for i, t in rows if i is not None}
    root = {i: i for i in sets}

    def find(i):
        while root[i] != i:
            i = root[i]
        return i

    for a, b in itertools.combinations(sets, 2):
        both = len(sets[a] & sets[b])
        if both and 100 * both >= 80 * len(sets[a] | sets[b]):
            x, y = find(a), find(b)
            root[max(x, y)] = min(x, y)
    return sets, {i: find(i) for i in sets}


def edited(rng, words, share):
    return " ".join(w if rng.random() > share else f"e{rng.integers(10**6)}" for w in words)


@pytest.mark.parametrize("n", [2, 5])
def test_near_duplicates(spark, docs, empty, n):
    rng = np.random.default_rng(n)
    rows = list(DOCS)
    for g in range(6):
        words = [f"g{g}w{i}" for i in range(60)]
        rows += [(100 + 20 * g + k, edited(rng, words, 0.01 * (k % 9))) for k in range(20)]
    sets, component = brute_components(rows, n)
    wanted = [(i, len(shingles(t, n)), component.get(i, i), component.get(i, i) == i) for i, t in rows]
    df = spark.createDataFrame(rows, "doc_id long, text string").repartition(5).withColumn("a", F.lit(1))
    assert got(minhash.near_duplicates(df, words=n), "doc_id", "n_shingles", "component_id", "kept") == sorted(wanted, key=str)
    assert minhash.near_duplicates(empty, words=n).count() == 0


def test_blocks_find_what_stars_miss(spark, monkeypatch):
    """One bucket for all: members that their centre doesn't confirm are still compared with one another."""
    rng = np.random.default_rng(7)
    core = [f"c{i}" for i in range(200)]
    rows = [(0, " ".join(core))]
    for g in range(12):
        own = core[:150] + [f"g{g}x{i}" for i in range(50)]
        rows += [(1 + 3 * g + k, edited(rng, own, 0.005)) for k in range(3)]
    _, component = brute_components(rows, 2)
    monkeypatch.setattr(minhash, "BLOCK", 3000)
    monkeypatch.setattr(minhash, "SMALL", 4)
    df = spark.createDataFrame(rows, "doc_id long, text string").repartition(30)
    assert got(minhash.near_duplicates(df, words=2), "doc_id", "component_id") == sorted(component.items(), key=str)


def test_short_texts_of_one_template_are_told_apart(spark):
    """All share a shingle and many a bucket, none links but the planted pairs; the blocks hold what shares rare shingles only."""
    rows = [(i, f"user posted w{i}") for i in range(6000)] + [(10_000 + i, f"user posted w{i} " + " ".join(f"x{k}" for k in range(i % 3))) for i in range(5)]
    rows += [(20_000 + i, " ".join(f"a{i}b{k}" for k in range(30))) for i in range(2)] + [(30_000 + i, " ".join([f"a{i}b{k}" for k in range(29)] + ["end"])) for i in range(2)]
    wanted = {i: i for i, _ in rows} | {10_000: 0, 10_003: 3, 30_000: 20_000, 30_001: 20_001}
    df = spark.createDataFrame(rows, "doc_id long, text string").repartition(3)
    assert dict(got(minhash.near_duplicates(df, words=2), "doc_id", "component_id")) == wanted


@pytest.mark.parametrize(("docs_of_block", "words"), [(3, 2), (2048, 3)])
def test_prefixes_and_blocks_of_few_documents_lose_no_link(spark, monkeypatch, docs_of_block, words):
    rng = np.random.default_rng(docs_of_block)
    core, rows = [f"c{i}" for i in range(60)], []
    for g in range(40):
        own = core[: 30 + g % 7] + [f"g{g % 9}x{i}" for i in range(30 - g % 5)]
        rows.append((g, edited(rng, own, 0.03 * (g % 3))))
    _, component = brute_components(rows, words)
    monkeypatch.setattr(minhash, "BLOCK_DOCS", docs_of_block)
    monkeypatch.setattr(minhash, "SMALL", 0)
    df = spark.createDataFrame(rows, "doc_id long, text string").repartition(8)
    assert got(minhash.near_duplicates(df, words=words), "doc_id", "component_id") == sorted(component.items(), key=str)


@pytest.mark.parametrize(("parts", "small"), [(1, 16), (2, 0)])
def test_members_folded_under_a_centre_still_link(spark, monkeypatch, parts, small):
    """A bridge m with m ~ c for 30 lower ids c and m ~ d, but no c ~ d: nearly every bucket of m and d folds m under some c."""
    rng = np.random.default_rng(11)
    words = [f"w{i}" for i in range(200)]

    def swapped(tag):
        at = set(rng.choice(np.arange(1, 199, 2), 9, False).tolist())
        return " ".join(f"{tag}{i}" if i in at else w for i, w in enumerate(words))

    rows = [*((k, swapped(f"c{k}x")) for k in range(1, 31)), (50, " ".join(words)), (60, swapped("d"))]
    sets, component = brute_components(rows, 2)
    alike = lambda a, b: len(sets[a] & sets[b]) / len(sets[a] | sets[b])
    assert alike(50, 60) >= 0.8 and all(alike(k, 60) < 0.8 for k in range(1, 31)) and component[60] == 1
    monkeypatch.setattr(minhash, "SMALL", small)
    frames = [spark.createDataFrame(r, "doc_id long, text string").coalesce(1) for r in ([rows] if parts == 1 else [rows[:-1], rows[-1:]])]
    assert got(minhash.near_duplicates(frames[0] if parts == 1 else frames[0].union(frames[1]), words=2), "doc_id", "component_id") == sorted(component.items(), key=str)


@pytest.mark.parametrize("parts", [1, 4, 30])
def test_links_just_above_the_threshold(spark, parts):
    """Triples in which only the middle text links with both others, and pairs on both sides of 0.8: recall is 1, here as elsewhere."""
    rng, rows = np.random.default_rng(parts), []
    for g in range(60):
        words = [f"g{g}w{i}" for i in range(202)]
        rows += [(3 * g, " ".join(words[:201])), (3 * g + 1, " ".join(words)), (3 * g + 2, " ".join(words[40:]))]  # 0.995, 0.8, and 0.796 between the outer ones
    for g in range(200):
        words, n = [f"p{g}w{i}" for i in range(101)], int(rng.integers(20, 25))
        rows += [(1000 + 2 * g, " ".join(words)), (1001 + 2 * g, " ".join(words[: 101 - n]))]
    _, component = brute_components(rows, 2)
    df = spark.createDataFrame([rows[i] for i in rng.permutation(len(rows))], "doc_id long, text string").repartition(parts)
    assert got(minhash.near_duplicates(df, words=2), "doc_id", "component_id") == sorted(component.items(), key=str)


@pytest.mark.parametrize("small", [16, 0])
def test_outliers_of_a_large_component_are_not_paired_with_all_of_it(spark, monkeypatch, small):
    """Buckets of 300 members of one component and a few texts that are just less alike: neither pairs nor shingles become rows of a join."""
    rng, saved, made = np.random.default_rng(5), minhash.saved, {}
    words = [f"w{i}" for i in range(200)]
    rows = [(i, edited(rng, words, 0.004)) for i in range(300)] + [(1000 + k, " ".join(words[:160] + [f"o{k}x{i}" for i in range(40)])) for k in range(12)]
    rows += [(2000, " ".join(words[:150] + [f"o3x{i}" for i in range(40)]))]  # links with an outlier only
    _, component = brute_components(rows, 2)
    assert component[2000] == 1003 and len(set(component.values())) == 13

    def counted(df, name):
        out = saved(df, name)
        made[name] = max(made.get(name, 0), out.count())
        return out

    monkeypatch.setattr(minhash, "SMALL", small)
    monkeypatch.setattr(minhash, "saved", counted)
    df = spark.createDataFrame(rows, "doc_id long, text string").repartition(8)
    assert got(minhash.near_duplicates(df, words=2), "doc_id", "component_id") == sorted(component.items(), key=str)
    assert made["stars"] <= 4 * len(rows) and made.get("shingles", 0) <= len(rows), made


def test_prefixes_of_sets_that_link_meet_in_any_order():
    rng = np.random.default_rng(9)
    for n in (1, 2, 4, 5, 9, 60):
        for _ in range(200):
            often = rng.integers(0, 3, int(rng.integers(1, 50)))
            a = np.unique(rng.integers(0, 1 << 63, n).astype(np.uint64) * np.uint64(2))
            b = np.unique(np.concatenate([a[rng.random(len(a)) < 0.9], rng.integers(0, 1 << 63, n // 8).astype(np.uint64)]))
            if minhash.linked(a, b):
                assert len(np.intersect1d(minhash.prefix(a, often, 80), minhash.prefix(b, often, 80)))
                assert len(minhash.prefix(a, often, 80)) == len(a) - -(-len(a) * 80 // 100) + 1


def test_workers_give_back_what_a_batch_took():
    """A small array at the heap's top keeps what lies below it, unless it is given back."""

    def resident():
        with open("/proc/self/statm") as f:
            return int(f.read().split()[1]) * 4096

    batch = pa.record_batch({"text": ["a"] * 10})
    for _ in common.slices(iter([batch]), 0):
        held = [np.ones(100_000, np.uint8) for _ in range(2000)]
        most, held = resident(), held[-1:]
    assert most - resident() > 100_000_000 and held[0].sum() == 100_000


def test_saved_by_batches_holds_few_bytes_at_once(spark):
    df = spark.range(0, 8000, 1, 1).select(F.repeat(F.lit("x"), 4000).alias("text"))
    before = spark.conf.get("spark.sql.execution.arrow.maxBytesPerBatch")

    def sizes(batches):
        for batch in batches:
            yield pa.record_batch({"n": [sum(len(t) for t in batch.column(0).to_pylist())]})

    found = [r.n for r in common.saved_by_batches(df.mapInArrow(sizes, "n long"), "sizes").collect()]
    assert sum(found) == 32_000_000 and max(found) <= common.BATCH_BYTES + 4000
    assert spark.conf.get("spark.sql.execution.arrow.maxBytesPerBatch") == before


def test_densified_bins_agree_as_often_as_sets_do():
    rng = np.random.default_rng(3)
    agree, trials = 0, 300
    for _ in range(trials):
        a = np.sort(rng.integers(0, 1 << 63, 10).astype(np.uint64) * np.uint64(2))
        b = np.sort(np.concatenate([a[:8], rng.integers(0, 1 << 63, 2).astype(np.uint64) * np.uint64(2)]))
        s = minhash.signatures([a, b])
        agree += (s[0] == s[1]).mean()
    assert agree / trials == pytest.approx(8 / 12, abs=0.02)


def test_components_of_a_path_and_a_star(spark):
    links = [(i, i + 1) for i in range(40)] + [(100, i) for i in range(101, 130)] + [(7, 7)]
    found = components.connected_components(spark.createDataFrame(links, "a long, b long"))
    assert got(found, "id", "component") == sorted([(i, 0) for i in range(41)] + [(i, 100) for i in range(100, 130)], key=str)


def test_decontamination(spark, docs, empty):
    a = " ".join(f"w{i}" for i in range(30))
    items = [(1, a), (2, "short one here"), (3, "UNO"), (4, None), (5, ""), (6, "x y z " * 8), (None, "null item id"), (10, "short one here")]
    rows = [(1, "foo " + a + " bar"), (2, None), (3, ""), (5, "Short, one-here uno"), (6, "x y z " * 30), (7, " ".join(f"w{i}" for i in range(5, 14))), (8, " ".join(f"w{i}" for i in range(5, 15))), (8, "dup uno"), (None, a[10:60]), (9, "ünö uno É é"), (11, "filler " * 40_000 + a + " filler" * 9_000)]
    words = lambda t: re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", (t or "").translate(LOWER))
    known = {}
    for i, t in items:
        w = words(t)
        for j in range(len(w) - min(10, len(w)) + 1 if w else 0):
            known.setdefault(tuple(w[j : j + min(10, len(w))]), set()).add("" if i is None else str(i))
    wanted = []
    for i, t in rows:
        w, hit, found = words(t), set(), set()
        for n in {len(k) for k in known}:
            for j in range(len(w) - n + 1):
                if tuple(w[j : j + n]) in known:
                    hit |= set(range(j, j + n))
                    found |= known[tuple(w[j : j + n])]
        wanted.append((i, len(w), len(hit), len(found), hashlib.sha256(",".join(sorted(found)).encode()).hexdigest(), bool(hit)))
    df, bench = spark.createDataFrame(rows, "doc_id long, text string").withColumn("words", F.lit(1)), spark.createDataFrame(items, "item_id long, text string").withColumn("n", F.lit(1))
    cols = ("doc_id", "n_words", "n_hit", "n_items", "items_sha256", "contaminated")
    assert got(decontaminate.decontaminate(df, bench), *cols) == sorted(wanted, key=str)
    assert got(decontaminate.decontaminate(df, bench, broadcast_rows=2), *cols) == sorted(wanted, key=str)
    assert decontaminate.decontaminate(empty, bench).count() == 0
    assert not any(r.contaminated for r in decontaminate.decontaminate(docs, bench.limit(0)).collect())


def test_bucket_bounds_are_optimal():
    rng = np.random.default_rng(0)
    for _ in range(60):
        n, k = int(rng.integers(1, 8)), int(rng.integers(1, 5))
        lengths, counts = np.sort(rng.choice(np.arange(1, 40), n, False)), rng.integers(1, 20, n)
        cost = lambda bounds: sum(int(c) * (min(b for b in bounds if b >= v) - int(v)) for v, c in zip(lengths, counts))  # noqa: B023, E731
        best = min(cost([*s, int(lengths[-1])]) for m in range(min(k, n)) for s in itertools.combinations(map(int, lengths[:-1]), m))
        bounds = packing.choose_bounds(lengths, counts, k)
        assert len(bounds) <= k and cost(bounds) == best


def test_packing_keeps_every_document(spark, docs, empty):
    known = packing.encoding(packing.ranks_of(spark))
    packed = packing.pack(docs, n_buckets=3, budget=50, shard_docs=1).persist()
    found = packed.toPandas()
    texts = sorted((str(i), t or "") for i, t in DOCS)
    ids = found.doc_id.astype("Int64").astype(object).where(found.doc_id.notna(), None)
    assert sorted((str(i), known.decode(list(x))) for i, x in zip(ids, found.tokens)) == texts and (found.tokens.map(len) == found.n_tokens).all()
    for (bucket, _), batch in found.groupby(["bucket", "batch_id"]):
        assert len(batch) == batch.batch_docs.iloc[0] and sorted(batch.slot) == list(range(len(batch)))
        assert bucket == 0 or len(batch) == 1 or len(batch) * batch.bucket_tokens.iloc[0] <= 50
    # the least padding of all choices of three bounds, and in every bucket only the last batch has room
    lengths = sorted(n for n in found.n_tokens if n)
    cost = lambda bounds: sum(min(b for b in bounds if b >= n) - n for n in lengths)
    assert found.padding.sum() == min(cost([*s, lengths[-1]]) for s in itertools.combinations(sorted(set(lengths)), 2))
    for _, rows in found[found.bucket > 0].groupby("bucket"):
        capacity = max(50 // rows.bucket_tokens.iloc[0], 1)
        assert (rows[rows.batch_id < rows.batch_id.max()].batch_docs == capacity).all() and rows.batch_id.nunique() == -(-len(rows) // capacity)
    assert found[found.doc_id.isin([4, 5])].bucket.eq(0).all() and packing.pack(empty).count() == 0
    whole = {(r.bucket, r.batch_id): r for r in packing.batches(packed).collect()}
    assert sum(len(r.ids) for r in whole.values()) == len(DOCS)
    for (bucket, batch), rows in found.groupby(["bucket", "batch_id"]):
        rows, r = rows.sort_values("slot"), whole[bucket, batch]
        assert list(r.tokens) == [x for tokens, n in zip(rows.tokens, rows.padding) for x in [*tokens, *[packing.PAD] * n]] and len(r.tokens) == len(rows) * rows.bucket_tokens.iloc[0]


def test_long_runs_of_white_space_have_the_same_ids(spark):
    known = packing.encoding(packing.ranks_of(spark))
    for run in (" ", "\n", "\t\n ", "\u3000 ", "\x1c"):
        for text in ("a" + run * 20_000 + "b", "x" + run * 15_000, run * 12_000 + "y", run * 30_000, "a" + run * 11_000 + " b" + run * 10_000 + "\nc" + " " * 9_999 + "d"):
            assert packing.token_ids(known, text).tolist() == known.encode_ordinary(text)
    texts = ["a" + run * (5_000_000 // len(run)) + "b" for run in (" ", "\n", " \n\t")]
    found = packing.pack(spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")).collect()
    assert [known.decode(list(r.tokens)) for r in sorted(found)] == texts


def test_bounds_of_long_texts_are_exact(spark):
    """Lengths far above any grid: two that differ by one token get bounds of their own."""
    texts = spark.createDataFrame([(i, " a" * n) for i, n in enumerate([200_000, 200_001, 200_001, 5])], "doc_id long, text string")
    assert packing.pack(texts, n_buckets=3).agg(F.sum("padding")).first()[0] == 0


SECRETS = [
    (1, 'é password = "abc123def" and PASSWD:x api_key=short token=abcdef'), (2, "AKIA" + "A1B2" * 4 + " AKIASHORT"), (3, "deadbeef" * 3 + " " + "ab12" * 5), (4, None), (5, ""), (6, "İ secret: 'x/y+z==' ſecret=abcdefgh"),
    (7, "token=" + "0123456789abcdef" * 2), (8, "plain words only, and 2024-01-01_report_final_version"),
]


def test_secret_rules_and_added_spans(spark, empty):
    model = secrets.CharCnn().fit(*secrets.lessons(400))
    found = {r.doc_id: r for r in secrets.scan(spark.createDataFrame(SECRETS, "doc_id long, text string").withColumn("spans", F.lit(1)), model=model).collect()}
    for i, text in SECRETS:
        spans = []
        for kind, rule, least, group in (("assign", secrets.ASSIGN.pattern, 6, 2), ("access", r"AKIA[A-Z0-9]+", 20, 0), ("hex", r"[0-9a-f]+", 24, 0)):
            spans += [(m.start(), ["assign", "access", "hex"].index(kind), kind, m.end()) for m in re.finditer(rule, text or "", re.I | re.A if kind == "assign" else 0) if len(m[group]) >= least]
        spans = [f"{k}:{a}:{b}" for a, _, k, b in sorted(spans)]
        assert found[i].base_sha256 == hashlib.sha256(",".join(spans).encode()).hexdigest()
        assert set(spans) - {""} <= set(found[i].spans.split(",")) and found[i].n_assign == sum(s.startswith("assign") for s in spans)
    assert secrets.scan(empty, model=model).count() == 0


def test_secret_candidates():
    texts = ["x 0123456789abcdef0123", "0123456789abcdefAA", "", "ab", "zz AbCdEfGhIjKlMnOpQr", "thisisalongwordwithoutdigits é 1111111111111111"]
    rows, starts, ends = secrets.candidates(*utf8(pa.array(texts)))
    data = utf8(pa.array(texts))[0].tobytes()
    assert rows.tolist() == [0, 1, 4, 5] and [data[a:b] for a, b in zip(starts, ends)] == [b"0123456789abcdef0123", b"0123456789abcdefAA", b"AbCdEfGhIjKlMnOpQr", b"1111111111111111"]


def test_candidates_are_scored_whole(spark):
    class Sevens:  # a network that knows one kind of key: 16 equal characters 7 or Q
        threshold = 0.5

        def scores(self, x):
            return np.array([max((r == secrets._CODE[ord(c)]).sum() for c in "7Q") >= 16 for r in x[:, secrets.LEFT : secrets.LEFT + secrets.BODY]], float)

    name = "NAME_OF_A_LONG_SETTING_OF_SERVICE_X_AND_OF_Y="
    texts = [name + "7" * 20, "é " + "Q" * 20, "ZQ" + "7" * 24 + "QZ", "7" * 24]
    found = secrets.scan(spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string"), model=Sevens()).orderBy("doc_id").collect()
    assert [r.spans for r in found] == [f"network:0:{len(name) + 20}", "network:2:22", "network:0:28,hex:2:26", "hex:0:24"]


def test_secrets_are_told_from_numbers_and_names():
    """Recall and precision on made-up cases of another seed."""
    model, rng = secrets.CharCnn().fit(*secrets.lessons()), random.Random(99)
    cases = [secrets.made(rng) for _ in range(3000)]
    data, offsets = utf8(pa.array(["".join(c[:3]) for c in cases]))
    rows, starts, ends = secrets.candidates(data, offsets, every=True)
    best, secret = np.zeros(len(cases)), np.array([c[3] for c in cases], bool)
    np.maximum.at(best, rows, secrets.best_scores(model, data, offsets, rows, starts, ends))
    found = best >= model.threshold
    assert found[secret].mean() > 0.98 and found[~secret].mean() < 0.03


def test_secret_training_is_on_few_of_many_findings(spark, monkeypatch):
    rows = [(i % 7 or None, f"some words before it, as texts have them, and token = {i:032x} and some words after it") for i in range(300)] + [(1, None), (2, ""), (3, "x" * 100_000)]
    df = spark.createDataFrame(rows, "doc_id long, text string")
    seen = []
    monkeypatch.setattr(secrets, "lessons", lambda: (np.zeros((0, secrets.LEFT + secrets.BODY + secrets.RIGHT), np.uint8), np.zeros(0, np.float32)))
    monkeypatch.setattr(secrets.CharCnn, "fit", lambda self, x, y: seen.append((x, y)) or self)
    secrets.train(df.select("text"), 20)
    x, y = seen[0]
    assert 20 <= y.sum() <= 2 * 40 and (y == 0).sum() <= 40 and x.shape == (len(y), 80)  # findings with and without their context
    out = secrets.scan(df, model=secrets.CharCnn()).collect()
    assert len(out) == len(rows) and sum(r.n_assign for r in out) == 300 and sum(r.doc_id is None for r in out) == 43


def test_secret_threshold_keeps_its_recall():
    model, y = secrets.CharCnn(), np.array([1.0] * 100 + [0.0] * 300)
    logits = np.concatenate([np.linspace(-4, 4, 100), np.linspace(-6, 2, 300)])
    model._calibrate(logits, y)
    scores = 1 / (1 + np.exp(-(model.scale * logits + model.shift)))
    assert (scores[y > 0] >= model.threshold).mean() >= 0.99


TURNS = [(1, 0, "user", "a"), (1, 1, "assistant", r"\### Assistant: </turn> ok"), (1, 2, "assistant", None), (2, 5, None, "x: y"), (None, 0, "assistant", "z"), (3, 1, "assistant", "b"), (3, 0, "system", ""), (3, 1, "assistant", "b"), (4, 0, "user", "q\n" * 3000)]


def test_chat_is_read_back(spark):
    df = spark.createDataFrame(TURNS, "conv_id long, turn long, role string, text string").withColumn("piece", F.lit(1)).repartition(3)
    formatted = chat.format_chat(df)
    found = {r.conv_id: r for r in chat.read_back(formatted).collect()}
    for conv in {t[0] for t in TURNS}:
        turns = sorted(((t[1], t[2] or "", t[3] or "") for t in TURNS if t[0] == conv))
        loss = "".join(x for _, r, x in turns if r == "assistant")
        r = found[conv]
        assert r.turns_sha256 == hashlib.sha256("".join(f"{a}\n{b}\n" for _, a, b in turns).encode()).hexdigest()
        assert (r.n_turns, r.loss_chars, r.loss_sha256) == (len(turns), len(loss), hashlib.sha256(loss.encode()).hexdigest())
        assert r.formatted_chars == len(chat.standard([(a, b) for _, a, b in turns])) and not r.rewrites_history
    assert chat.read_back(chat.format_chat(df.limit(0))).count() == 0


def test_rewrites_of_turns_far_back_are_told():
    turns = [("system", "s1"), *(("user", "u"), ("assistant", "a")) * 6, ("system", "s2")]
    assert [r for *_, r in chat.pieces(chat.rewriting, turns)] == [False] * 13 + [True]
    numbered = lambda turns: "".join(f"{i}:{r}:{t};" for i, (r, t) in enumerate(turns))
    assert "".join(p for p, *_ in chat.pieces(numbered, turns)) == numbered(turns)
    assert list(chat.pieces(chat.standard, turns)) == list(chat.pieces(chat.standard, turns, window=4))


def forgetful(turns):
    """Drops the first turn after six, and puts words before all turns."""
    return "begin " + chat.standard(turns[1:] if len(turns) > 6 else turns)


@pytest.mark.parametrize("render", [chat.rewriting, forgetful, lambda turns: f"{len(turns)} turns\n" + chat.standard(turns), lambda turns: "begin " + chat.standard(turns), lambda turns: chat.standard(turns) + "end"])
def test_windows_that_are_too_small_make_no_difference(render):
    """Over 200 turns with a system turn here and there, windowed rendering gives what full prefixes give."""
    turns = [("system" if i % 67 == 0 else ("user", "assistant")[i % 2], f"text {i % 5}") for i in range(200)]
    full = list(chat.pieces(render, turns))
    assert list(chat.pieces(render, turns, window=3)) == full
    if not any(r for *_, r in full):
        assert "".join(p for p, *_ in full) == render(turns)
    assert all(piece[a:b] == text for (piece, a, b, _), (_, text) in zip(full[1:], turns[1:]))


def test_windowed_rendering_takes_linear_work():
    seen = []
    counted = lambda turns: seen.append(len(turns)) or chat.standard(turns)
    turns = [("user", "abc")] * 4000
    assert len(list(chat.pieces(counted, turns, window=chat.STANDARD_WINDOW))) == 4000 and sum(seen) < 15 * 4000


def test_null_turns_come_first(spark):
    rows = [(1, 2, "user", "c"), (1, None, "user", "a"), (1, 1, "user", "b"), (1, 1, None, None), (1, 1, "user", "b")]
    out = chat.format_chat(spark.createDataFrame(rows, "conv_id long, turn long, role string, text string")).orderBy("seq").collect()
    assert [chat.parse(r.piece)[0] for r in out] == [("user", "a"), ("", ""), ("user", "b"), ("user", "b"), ("user", "c")]


def test_templates_that_rewrite_history_are_told():
    turns = [("system", "s1"), ("user", "u"), ("system", "s2"), ("assistant", "a")]
    assert any(r for *_, r in chat.pieces(chat.rewriting, turns)) and not any(r for *_, r in chat.pieces(chat.standard, turns))
    for text in ("", "x", "xy", "user", "</turn>", "\\", "y" * 50):
        piece, start, end, _ = list(chat.pieces(chat.standard, [("user", text), ("assistant", text)]))[1]
        assert chat.unescape(piece[start:end]) == text


def test_surrogates(spark, empty):
    rows = [(1, "Mr. John Smith at +1 (429) 555-5467 or 8.2.3.4, 4111 1111 1111 1111 / 4111111111111111."), (2, "A.B09@Mail1.example.com a.b09@mail1.example.com Frau Müller"), (3, None), (4, ""), (5, "+14295555467 version 1.2.3 on 2023-01-15, 1234567890123456"), (5, "a.b09@mail1.example.com"), (None, "8.2.3.4")]
    found = pii.surrogates(spark.createDataFrame(rows, "doc_id long, text string").withColumn("kind", F.lit(1)), key="k")
    out = {(r.doc_id, r.n_entities): r.text for r in found.collect()}
    one, two, five = out[1, 5], out[2, 3], out[5, 1]
    phone = re.search(r"\+1 \((\d{3})\) (\d{3})-(\d{4})", one)
    cards = re.findall(r"4\d{3}(?: ?\d{4}){3}", one)
    assert one.startswith("Mr. ") and phone and "429" not in phone[1] and len({c.replace(" ", "") for c in cards}) == 1 and cards[0][4] == " "
    assert "8.2.3.4" not in one and re.search(r"or (\S+),", one)[1] == out[None, 1]
    mails = re.findall(r"\S+@\S+", two)
    assert mails[0] == mails[1] and mails[0].endswith(".com") and "Müller" not in two and "Frau " in two
    texts = [r.text for r in found.collect() if r.doc_id == 5]
    assert mails[0] in texts and f"+1{phone[1]}{phone[2]}{phone[3]} version 1.2.3 on 2023-01-15, 1234567890123456" in texts and five
    assert out[3, 0] is None and out[4, 0] == "" and pii.surrogates(empty, key="k").count() == 0


def test_surrogates_are_distinct(spark):
    mentions = spark.range(400).select(F.lit("name").alias("kind"), F.concat(F.lit("Mr. A"), F.translate(F.col("id").cast("string"), "0123456789", "abcdefghij")).alias("canon"))
    known = pii.dictionary(mentions, "k")
    assert known.select("surrogate").distinct().count() == 400 and known.join(mentions.select(F.col("canon").alias("surrogate")), "surrogate").isEmpty()


def test_mentions_of_a_name_are_one_entity(spark):
    rows = [(1, "Mr. John Smith met Dr. Smith, Mr Smith and John Smith. Smith's car; Smithers stays. Frau Weber-Vogt"), (2, "Dr John Smith"), (3, "Smith, without a title")]
    out = {r.doc_id: r.text for r in pii.surrogates(spark.createDataFrame(rows, "doc_id long, text string"), key="k").collect()}
    given, family = re.match(r"Mr\. (\w+) (\w+) met", out[1]).groups()
    assert out[1].startswith(f"Mr. {given} {family} met Dr. {family}, Mr {family} and {given} {family}. {family}'s car; Smithers stays. Frau ")
    assert "Weber" not in out[1] and out[2] == f"Dr {given} {family}" and out[3] == rows[2][1] and "Smith" not in (given, family)


def test_surrogates_suffice_for_any_number_of_names(spark, monkeypatch):
    monkeypatch.setattr(pii, "_SYLLABLES", {"latin": ["ba", "be", "bo"], "cyrillic": ["ба"]})
    mentions = spark.range(60).select(F.lit("name").alias("kind"), F.concat(F.lit("A"), F.translate(F.col("id").cast("string"), "0123456789", "abcdefghij")).alias("canon"))
    assert pii.dictionary(mentions, "k").select("surrogate").distinct().count() == 60  # 27 names of three syllables


def test_surrogates_of_few_letters_end(spark, monkeypatch):
    """All one-letter addresses of a host, whose surrogate's host has all of them, too."""
    monkeypatch.setattr(pii, "STEADY", 1)
    letters = [chr(97 + i) for i in range(26)]
    one = spark.createDataFrame([("email", "a@xy.com")], "kind string, canon string")
    host = pii.dictionary(one, "k").first().surrogate.split("@")[1]
    known = pii.dictionary(spark.createDataFrame([("email", f"{c}@{h}") for c in letters for h in ("xy.com", host)], "kind string, canon string"), "k").collect()
    assert len({r.surrogate for r in known} | {r.canon for r in known}) == 104
    phones = pii.dictionary(spark.range(100, 1000).select(F.lit("ssn").alias("kind"), F.col("id").cast("string").alias("canon")), "k").collect()
    assert len({r.surrogate for r in phones} | {r.canon for r in phones}) == 1800


def test_texts_that_overflow_patterns(spark):
    rows = [(1, "x@" + "a." * 50_000 + "com"), (2, "Mr. Smith " * 20_000), (3, "1" * 200_000 + " " + "1-" * 100_000), (4, "a" * 300_000 + "@" + "b" * 300_000), (5, "A" * 100_000 + " +" + "1 " * 50_000), (6, " ".join("Dr. " + "".join("abcdefghij"[int(d)] for d in str(i)).title() for i in range(10, 3000)))]
    out = {r.doc_id: (r.text, r.n_entities) for r in pii.surrogates(spark.createDataFrame(rows, "doc_id long, text string"), key="k").collect()}
    assert out[2][1] == 20_000 and "Smith" not in out[2][0] and out[4] == (rows[3][1], 0) and out[6][1] == 2990 and len(set(out[6][0].split()[1::2])) == 2990


def test_surrogates_need_a_key(spark, docs):
    with pytest.raises(ValueError):
        pii.surrogates(docs)


def test_surrogates_of_random_texts(spark):
    """Mentions between known words: one surrogate for one entity and one entity for one surrogate, in each mention's own format."""
    rng = random.Random(3)
    digits = lambda n: "".join(rng.choice("0123456789") for _ in range(n))
    pool = []  # kind, entity, ways to write it
    for _ in range(40):
        a, b, c = digits(3), digits(3), digits(4)
        pool.append(("phone", f"1{a}{b}{c}", [f"+1 ({a}) {b}-{c}", f"+1{a}{b}{c}", f"+1 {a} {b} {c}"]))
        mail = f"{rng.choice('abcdef')}{digits(2)}.{rng.choice('xyz')}@host{digits(1)}.example.org"
        pool.append(("email", mail, [mail, mail.upper()]))
        ip = ".".join(str(rng.randrange(1, 255)) for _ in range(4))
        pool.append(("ip", ip, [ip]))
        name = rng.choice(["Anna", "Berta", "Ida"]) + " " + "".join(rng.choice("abcdefgh") for _ in range(6)).title()
        pool.append(("name", name, [f"Mrs. {name}", f"Frau {name}", f"Dr {name}"]))
    texts = [[rng.choice(pool) for _ in range(rng.randrange(5))] for _ in range(80)]
    written = [[rng.choice(ways) for _, _, ways in t] for t in texts]
    rows = [(i, "".join(f"word {i} and {m}, " for m in ms) + "the end") for i, ms in enumerate(written)]
    out = {r.doc_id: r for r in pii.surrogates(spark.createDataFrame(rows, "doc_id long, text string"), key="k").collect()}
    shape = lambda x: re.sub("[0-9]", "0", re.sub("[a-z]", "a", re.sub("[A-Z]", "A", x)))
    bare = lambda kind, x: {"phone": re.sub("[^0-9]", "", x), "email": x.lower(), "ip": x, "name": re.sub(r"\A(Mrs\.|Frau|Dr) ", "", x)}[kind]
    mapping = {}
    for i, (t, ms) in enumerate(zip(texts, written)):
        found = re.fullmatch("".join(f"word {i} and (.+?), " for _ in ms) + "the end", out[i].text).groups()
        assert out[i].n_entities == len(ms)
        for (kind, entity, _), mention, new in zip(t, ms, found):
            assert mapping.setdefault((kind, entity), bare(kind, new)) == bare(kind, new) != entity
            assert shape(new) == shape(mention) if kind in ("phone", "email") else new.split()[:-2] == mention.split()[:-2]
    assert len(set(mapping.values())) == len(mapping)


def test_archives_round_trip(spark):
    rows = [(3, "http://b.example.com/x", "<p>é</p>"), (1, "http://a.example.com:80/?q=%0D#f", "same"), (2, "https://www.a.example.com/", "same"), (4, None, None), (5, "u", ""), (6, "http://a.example.com/", "WARC/1.1\r\n\r\nWARC-Type: x\r\n\r\n"), (None, "n", "same"), (7, "a\r\nb", "x" * 100000), (2, "r", "other"), (8, "v", "twice"), (8, "v", "twice")]
    df = spark.createDataFrame(rows, "page_id long, url string, html string").withColumns({c: F.lit(1) for c in ("digest", "size", "id", "value", "first_id", "record", "time", "run")}).repartition(3)
    found = warc.archive(df).collect()
    for r in found:  # every record is read by itself
        with open(r.archive.removeprefix("file:"), "rb") as f:
            f.seek(r.offset)
            content = gzip.decompress(f.read(r.length))
        assert content.startswith(b"WARC/1.1\r\n") and f"<urn:capture:{r.page_id if r.page_id is not None else ''}>".encode() in content and warc.record(content)[0]["WARC-Type"] == r.record_type
    wanted = []
    for i, _, t in rows:
        body = (t or "").encode()
        same = [r[0] for r in rows if (r[2] or "") == (t or "") and r[0] is not None]
        first = min(same) if same else None
        revisit = first is not None and i is not None and i > first
        wanted.append((i, len(body), base64.b32encode(hashlib.sha1(body).digest()).decode(), "revisit" if revisit else "response", first if revisit else None))
    assert sorted(((r.page_id, r.payload_bytes, r.payload_digest, r.record_type, r.refers_to) for r in found), key=str) == sorted(wanted, key=str)
    order = [(r.url_key, r.time, r.page_id is None, r.page_id or 0) for r in found]
    assert order == sorted(order) and warc.archive(df.limit(0)).count() == 0
    assert all(r.record_type == "response" for r in warc.archive(df, min_bytes=5).collect() if r.payload_bytes < 5)


def test_index_is_ordered_over_ranges(spark):
    """Many runs of one hot URL and of a repeated page, in ranges of a few rows: the partitions follow one another in one order."""
    rows = [(i % 40 if i % 3 else None, "http://h.example.com/" if i % 2 else f"http://{i % 7}.example.com/{i % 5}", f"text {i % 11}") for i in range(600)]
    df = spark.createDataFrame(rows, "page_id long, url string, html string").repartition(9)
    path = scratch(spark, "warc")
    warc.write_warc(df, path)
    runs = saved(warc.read_warc(spark, path), "runs")
    merged = warc.merge_runs(runs, 20)
    sizes = [r["count"] for r in merged.groupBy(F.spark_partition_id()).count().collect()]
    keys = [warc._order(tuple(r)) for r in merged.collect()]
    assert keys == sorted(keys) and len(keys) == 600 and max(sizes) < 200 and sorted(map(tuple, runs.collect()), key=warc._order) == [tuple(r) for r in merged.collect()]


def test_loser_tree_merges():
    rng = np.random.default_rng(0)
    for k in range(8):
        runs = [sorted(((f"k{int(rng.integers(5))}", "t", int(rng.integers(9)), "u", int(rng.integers(9)), "run") for _ in range(int(rng.integers(0, 6)))), key=warc._order) for _ in range(k)]
        assert [warc._order(x) for x in warc.LoserTree(runs)] == sorted(warc._order(x) for r in runs for x in r)


def test_quality_is_learned_from_labels(spark, docs, empty):
    rng = np.random.default_rng(0)
    vowels, rows, labels = list("aeiou"), [], []
    for i in range(400):
        good = i % 3 > 0
        words = ["".join(rng.choice(list("bcdfgst"), 2)) + str(rng.choice(vowels)) for _ in range(80)]
        rows.append((i, " ".join(words) + "." if good else "".join(w.upper() + "!!" for w in words)))
        labels.append((i, int(good)))
    df, known = spark.createDataFrame(rows, "doc_id long, text string"), spark.createDataFrame([*labels, (None, 1), (5, None)], "doc_id long, quality int")
    found = quality.score(df, known).toPandas().set_index("doc_id").sort_index()
    assert found.held_out.tolist() == [zlib.crc32(str(i).encode()) % 4 == 2 for i in range(400)]
    assert (found.predicted == [y for _, y in labels])[found.held_out].mean() > 0.97 and found.score.between(0, 1).all()
    odd = quality.score(docs, known)
    assert odd.count() == len(DOCS) and odd.where("score is null or held_out is null").isEmpty()
    assert quality.score(docs, known.limit(0)).where("score <> 0.5").isEmpty() and quality.score(empty, known).count() == 0
    assert quality.keep(df.withColumn("score", F.lit("x")), known).columns == ["doc_id", "text", "score"]


def test_attention_gradients_are_right():
    """Against differences of the loss at both sides of every parameter that is looked at."""
    rng = np.random.default_rng(1)
    x, counts, y = rng.random((7, quality.N_FEATURES)), np.array([3, 0, 4]), np.array([1.0, 0.0, 0.0])
    model = quality.AttentionMil(seed=1)
    model.p = {k: v.astype(np.float64) for k, v in model.p.items()}
    loss = lambda: float(-(y * np.log(s := model.forward(x, counts)[0]) + (1 - y) * np.log(1 - s)).mean())
    for k, d in model.gradients(x, counts, y).items():
        flat, d = model.p[k].reshape(-1), np.asarray(d).reshape(-1)
        for i in rng.integers(0, len(flat), 12):
            old, ends = flat[i], []
            for step in (1e-5, -1e-5):
                flat[i] = old + step
                ends.append(loss())
            flat[i] = old
            assert (ends[0] - ends[1]) / 2e-5 == pytest.approx(d[i], rel=1e-4, abs=1e-9), k


def test_texts_are_scored_by_passages(monkeypatch):
    """Against a plain version, one passage and one document at a time; the size of chunks makes no difference."""
    rng = np.random.default_rng(2)
    texts = ["", "a", "the the cat " * 400, "é漢" * 700, "".join(rng.choice(list("ab C1.\n|#"), 5000)), "x" * 512, "word " * 103]
    data, offsets = utf8(pa.array(texts))
    model = quality.AttentionMil(seed=3)
    p, wanted = model.p, []
    for text in texts:
        raw, codes = text.encode(), []
        for at in range(0, len(raw), quality.PASSAGE):
            piece = raw[at : at + quality.PASSAGE]
            pairs = np.zeros((quality.N_CLASSES, quality.N_CLASSES))
            for a, b in zip(piece, piece[1:]):
                pairs[quality._CLASS[a], quality._CLASS[b]] += 1
            words = re.split(rb"[ \n\r\t\x0b\x0c]+", piece.strip(b" \n\r\t\x0b\x0c"))
            again = [sum(words[i] == words[i - back] for i in range(back, len(words))) / len(words) for back in (2, 1)]
            codes.append(np.tanh(np.concatenate([np.sqrt(pairs.reshape(-1) / max(pairs.sum(), 1)), again]) @ p["We"] + p["be"]))
        z = np.zeros(len(p["o"]))
        if codes:
            e = np.exp([(np.tanh(h @ p["V"]) / (1 + np.exp(-(h @ p["U"])))) @ p["w"] for h in codes])
            z = (e[:, None] / e.sum() * np.array(codes)).sum(0)
        wanted.append(1 / (1 + np.exp(-(z @ p["o"] + p["b"][0]))))
    for chunk in (512, 1 << 21):
        monkeypatch.setattr(quality, "CHUNK", chunk)
        assert model.scores(data, offsets)[0] == pytest.approx(wanted, abs=1e-5)


def test_places_of_many_findings_are_counted_once(monkeypatch):
    monkeypatch.setattr(secrets, "COUNTED", 7)
    rng = random.Random(1)
    for n in (0, 1, 7, 14, 50):
        data = "".join(rng.choice("aé漢🙂") for _ in range(n)).encode()
        at = np.sort(np.array([rng.randrange(len(data) + 1) for _ in range(20)] + [0, len(data)]))
        assert secrets._begun(np.frombuffer(data, np.uint8), at).tolist() == [sum(b & 0xC0 != 0x80 for b in data[:k]) for k in at]
    for _ in range(200):
        spans = [(a, 0, a + rng.randrange(1, 9)) for a in (rng.randrange(30) for _ in range(rng.randrange(6)))]
        a, b = sorted((rng.randrange(30), rng.randrange(30)))
        assert secrets._within(secrets._reaches(spans), a, b) == any(s <= a and b <= e for s, _, e in spans)


def test_account_and_insurance_numbers_are_of_their_type(spark):
    valid = ["DE89 3704 0044 0532 0130 00", "GB82WEST12345698765432", "FR14 2004 1010 0505 0001 3M02 606"]
    left = lambda account: int("".join(str(int(c, 36)) for c in account[4:] + account[:4])) % 97
    rows = [(i, f"to {v} now") for i, v in enumerate(valid)] + [(9, "no account: DE88 3704 0044 0532 0130 00")] + [(100 + i, f"insured as {i:03}-45-6789 here") for i in range(100, 400)]
    found = {r.doc_id: r for r in pii.surrogates(spark.createDataFrame(rows, "doc_id long, text string"), key="k").collect()}
    for i, v in enumerate(valid):
        new = found[i].text[3:-4]
        assert new != v and left(new.replace(" ", "")) == 1 and new[:2] == v[:2] and [c == " " for c in new] == [c == " " for c in v] and [c.isdigit() for c in new[4:]] == [c.isdigit() for c in v[4:]]
    assert found[9].text == rows[3][1] and found[9].n_entities == 0
    numbers = [found[i].text.split()[2] for i, _ in rows[4:]]
    assert len(set(numbers)) == 300 and all(re.fullmatch(r"(?!000|666|9)\d{3}-(?!00)\d\d-(?!0000)\d{4}", n) for n in numbers)


def test_archives_are_cut_by_bytes(spark, monkeypatch):
    rng = np.random.default_rng(0)
    page = lambda n: "".join(chr(33 + int(x)) for x in rng.integers(0, 90, n))
    rows = [(i, f"http://h{i}.org/", page(20_000)) for i in range(40)]
    whole = list(warc._compressed([pa.RecordBatch.from_pydict({"r": [r[2] for r in rows]})]))
    monkeypatch.setattr(warc, "BUNDLE_BYTES", 50_000)
    cut = list(warc._compressed([pa.RecordBatch.from_pydict({"r": [r[2] for r in rows]})]))
    sizes = [len(b.column(0)[0].as_py()) for b in cut]
    assert len(whole) == 1 and len(cut) > 10 and max(sizes) <= 51_000
    joined = warc.EMPTY.join(b.column(0)[0].as_py() for b in cut)
    assert [c for _, _, c in warc.members(joined)] == [r[2].encode() + b"\r\n\r\n" for r in rows] and joined == whole[0].column(0)[0].as_py()


def test_every_turn_is_checked_by_the_query(spark):
    """A template that drops its first turn when there are exactly five is told at turns five and six."""
    odd = lambda turns: "".join(f"[{r}]{t}" for r, t in (turns[1:] if len(turns) == 5 else turns))
    flags = [p[3] for p in chat.pieces(odd, [("user", f"t{i}") for i in range(8)])]
    assert flags == [False] * 4 + [True, True, False, False]
