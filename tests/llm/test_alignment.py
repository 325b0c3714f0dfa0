"""Token alignment against whole texts, tokenized and linked one by one."""

import hashlib
import random
from collections import Counter, defaultdict

import numpy as np
import pyarrow as pa
import pytest
from conftest import SF
from pyspark.sql import functions as F

from geostrata.llm import align
from geostrata.llm.common import table

ODD = [
    (1, "The quick brown fox isn't over-\nestimating 12345 things, naïve café \t tabs  and   spaces "), (2, None), (3, ""), (4, " "), (5, "   "), (6, "a "), (7, "\n\n x \n"), (8, "漢字かな交じり文 🙂👩‍👩‍👧 ﬁ é"), (9, "with ▁ mark inside"),
    (10, "<|endoftext|> <s> </s> <0x41> <unk>"), (11, "x\u180e y  z　 w\x00\x1c v"), (12, "The quick brown fox"), (12, "The quick brown fox"), (None, "The quick"), (13, "y" * 30_000), (14, "a" + " " * 50_000 + "b" + "\n" * 50_000), (15, "word " * 20_000),
]
COLUMNS = ["doc_id", "n_a", "n_b", "n_groups", "n_links", "n_best", "count_sum", "groups_sha256"]


def brute(spark, rows):
    """Whole texts through both vocabularies; ends compared as sets, every token pair by its byte ranges."""
    a, b = align.vocabularies(*align.contents(spark))
    made, held = [], Counter()
    for _, text in rows:
        links, groups, tokens = [], [], ([], [])
        if text:
            ids = a.known.encode(" " + text, add_special_tokens=False).ids, b.known.encode(text)
            if all(b"".join(v.bytes[i] for i in x) == (" " + text).encode() for v, x in zip((a, b), ids)):
                spans = []
                for v, x in zip((a, b), ids):
                    at, own = 0, []
                    for i in x:
                        own.append((at, at := at + len(v.bytes[i]), i))
                    spans.append(own)
                cuts = {e for _, e, _ in spans[0]} & {e for _, e, _ in spans[1]}
                by_group = defaultdict(lambda: ([], []))
                order = {c: k for k, c in enumerate(sorted(cuts))}
                last = sorted(cuts)
                for side, own in enumerate(spans):
                    k = 0
                    for _, e, i in own:
                        by_group[last[k]][side].append(str(i))
                        k += e in order
                groups = [",".join(by_group[c][0]) + "|" + ",".join(by_group[c][1]) for c in last]
                k = 0
                for s, e, i in spans[0]:
                    while spans[1][k][1] <= s:
                        k += 1
                    m = k
                    while m < len(spans[1]) and spans[1][m][0] < e:
                        links.append((i, spans[1][m][2]))
                        m += 1
                tokens = ids
        held.update(set(links))
        made.append((links, groups, tokens))
    best = Counter()
    for (i, _), n in held.items():
        best[i] = max(best[i], n)
    return sorted(((d, len(t[0]), len(t[1]), len(g), len(x), sum(held[p] == best[p[0]] for p in x), sum(held[p] for p in x), hashlib.sha256(";".join(g).encode()).hexdigest() if g else "") for (d, _), (x, g, t) in zip(rows, made)), key=str)


@pytest.mark.parametrize(("parts", "chars"), [(1, 1 << 24), (4, 3000)])
def test_alignment_by_brute_force(spark, parts, chars):
    rng = random.Random(3)
    alphabet = ["a", "b", "é", "the", "ing", " ", " ", " ", "  ", "\n", "\t", "1", "99", ".", ",", "'s", "-", "漢", "🙂", " ", "Zz", "<s>"]
    rows = ODD + [(100 + i, "".join(rng.choice(alphabet) for _ in range(rng.randrange(1, 120)))) for i in range(150)]
    df = spark.createDataFrame(rows, "doc_id long, text string").repartition(parts).withColumns({c: F.lit(1) for c in ("id", "seg", "slice", "n_a", "at", "row", "pair")})
    found = align.align(df, slice_chars=chars)
    assert found.columns == COLUMNS
    assert sorted(map(tuple, found.collect()), key=str) == brute(spark, rows)
    assert align.align(df.where("false")).count() == 0


def test_alignment_of_the_documents(spark):
    docs = table(spark, SF, "documents")
    rows = [(r.doc_id, r.text) for r in docs.select("doc_id", "text").collect()]
    assert sorted(map(tuple, align.align(docs).collect()), key=str) == brute(spark, rows)


def test_segments_join_to_the_text_and_cut_where_both_cut():
    for text in (t for _, t in ODD if t):
        cut = align.segments(text)
        assert " ".join(cut) == text and all(s and s[-1] not in align.WHITE for s in cut[:-1])


def test_few_slices_are_dealt_evenly_over_rounds(spark):
    """By hashes one of four rounds had 15 of 32 slices and their shuffle files."""
    for tasks, each in ((32, 1), (7, 9), (1, 30)):
        found = spark.range(tasks * each).select((F.floor(F.col("id") / each) * (1 << 32) + F.col("id") % each).cast("long").alias("slice"))
        sizes = [found.where(align.of_round(F.col("slice"), r, align.ROUNDS)).count() for r in range(align.ROUNDS)]
        assert sum(sizes) == tasks * each and max(sizes) - min(sizes) <= 1


def test_segments_carry_the_places_that_hold_them(spark):
    """Each place is in one row, with its segment's tokens, also where an Arrow batch ends among equal segments."""
    rows = [(i, "some words of some text, the same every time " + "x y z"[i % 4 :]) for i in range(40)]
    docs = spark.createDataFrame(rows, "id long, text string").repartition(3)
    a, b = align.contents(spark)
    parts = align.sliced(docs, True, 200).localCheckpoint()
    before = spark.conf.get("spark.sql.execution.arrow.maxRecordsPerBatch")
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", 5)
    try:
        tokens = align.tokenized(parts, a, b, True).collect()
    finally:
        spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", before)
    vocabularies = align.vocabularies(a, b)
    found = [(s, at, *(b"".join(v.bytes[i] for i in ids).decode() for v, ids in zip(vocabularies, (r.a, r.b)))) for r in tokens for s, at in zip(r.of_slice, r.at, strict=True)]
    held = [(r.slice, r.at, " " + r.segment, " " + r.segment) for r in parts.where("segment is not null").collect()]
    assert sorted(found) == sorted(held) and len(tokens) < len(held) / 2


def test_no_join_reads_the_texts_of_segments(spark, monkeypatch):
    """Aligned segments met the slices in joins on their texts, once a round and once more for the sums."""
    plans, saved = [], align.saved_lean
    monkeypatch.setattr(align, "saved_lean", lambda df, name: plans.append(df._jdf.queryExecution().optimizedPlan().toString()) or saved(df, name))
    align.align(spark.createDataFrame([(1, "the quick brown fox"), (2, "the brown dog")], "doc_id long, text string"))
    joins = [line for plan in plans for line in plan.splitlines() if "Join " in line]
    assert joins and not any("segment" in line for line in joins)


def test_counts_of_many_pairs_are_joined(spark):
    rows = [(i, f"some words, {i % 7} of {i % 5} kinds") for i in range(60)]
    df = spark.createDataFrame(rows, "doc_id long, text string").repartition(3)
    before = spark.conf.get("spark.sql.autoBroadcastJoinThreshold")
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", -1)  # else Spark broadcasts so few by itself
    try:
        for few in (0, 1000):
            assert sorted(map(tuple, align.align(df, slice_chars=100, few_pairs=few).collect()), key=str) == brute(spark, rows)
    finally:
        spark.conf.set("spark.sql.autoBroadcastJoinThreshold", before)


def test_segments_are_cut_by_batches_as_one_by_one():
    texts = [t for _, t in ODD] + ["a b", "x\u00a0 y", "\x1f z", "a\u3000 b c", "tail  "]
    for at_spaces in (True, False):
        assert align.cut(pa.array(texts, pa.string()), at_spaces).to_pylist() == [[] if not t else align.segments(t) if at_spaces else [t] for t in texts]


def test_digests_are_those_of_the_joined_groups():
    groups, seq, offsets = ["1|2", "3,4|5;6|7", "8|9"], np.array([0, 1, 1, 2]), np.array([0, 2, 2, 4])
    assert align.digests(pa.array(groups), seq, offsets) == [hashlib.sha256(x).hexdigest() if x else "" for x in (b"1|2;3,4|5;6|7", b"", b"3,4|5;6|7;8|9")]
