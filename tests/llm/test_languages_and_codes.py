"""Language identification and vector codes against brute-force versions and held-out labels."""

import hashlib
import math
import random
import zlib

import numpy as np
import pytest
import zstandard
from conftest import SF
from pyspark.sql import functions as F

from geostrata.llm import language, vector_codes
from geostrata.llm.common import table

TEXTS = {"en": "the quick brown fox and the other dogs were running with them through this field", "de": "der schnelle braune fuchs und die anderen hunde liefen durch das feld nicht mit ihnen", "fr": "le renard brun et les autres chiens sont dans les champs avec nous pour une journée"}


def said(rng, lang, n):
    return " ".join(rng.choice(TEXTS[lang].split()) for _ in range(n))


@pytest.fixture(scope="module")
def labelled(spark):
    rng = random.Random(5)
    rows = [(i, said(rng, lang, rng.randrange(5, 400)), lang) for i in range(240) for lang in [rng.choice("en en de fr".split())]]
    rows += [(1000, None, "en"), (1001, "", "de"), (1002, "12 345 !?\n\n", "fr"), (1003, said(rng, "de", 60_000), None), (None, said(rng, "fr", 30), "fr"), (7, said(rng, "en", 30), "de")]
    return rows, spark.createDataFrame(rows, "doc_id long, text string, lang string").withColumns({c: F.lit(1) for c in ("id", "held_out", "score", "place")})


def test_languages_by_brute_force(spark, labelled):
    rows, df = labelled
    found = sorted(map(tuple, language.languages(df, narrow=0.0).collect()), key=str)
    model = language.fit(df.select(F.col("doc_id").alias("id"), F.col("text"), F.col("lang")).withColumn("text", language.letters(r"\n")))
    assert [x for x, _ in model][0] == "en" and len(model) == 3 and all(len(c) <= language.DICT_BYTES for _, c in model)
    wanted = []
    for i, text, _ in rows:
        letters = " ".join("".join(c if c.isalpha() else " " for c in (text or "").lower()).split()).encode()
        sizes = [sum(len(zstandard.ZstdCompressor(level=language.LEVEL, dict_data=zstandard.ZstdCompressionDict(c, dict_type=zstandard.DICT_TYPE_RAWCONTENT), write_content_size=False, write_dict_id=False, write_checksum=False).compress(letters[a : a + language.CHUNK])) for a in range(0, len(letters), language.CHUNK)) for _, c in model]
        order = sorted(range(3), key=lambda k: (sizes[k], k))  # noqa: B023
        held = i is not None and zlib.crc32(str(i).encode()) % 5 == 0
        wanted.append((i, held, model[order[0]][0] if letters else "und", 1 - sizes[order[0]] / sizes[order[1]] if letters else 0.0))
    assert found == sorted(wanted, key=str)
    right = [(lang, r[2]) for r in found for lang in [dict((i, x) for i, _, x in rows[:240]).get(r[0])] if r[1] and lang]
    assert len(right) > 20 and np.mean([a == b for a, b in right]) > 0.95


def test_held_out_languages_of_the_documents(spark):
    docs = table(spark, SF, "documents")
    both = language.languages(docs, narrow=0.0).join(docs.select("doc_id", "lang"), "doc_id").where("held_out and lang is not null").select("lang", "lang_pred").collect()
    assert len(both) > 20 and np.mean([r.lang == r.lang_pred for r in both]) >= 0.9


def test_narrow_margins_are_rejected_and_tables_without_labels_give_und(spark, labelled):
    _, df = labelled
    plain, strict = ({r.doc_id: r for r in language.languages(df.where("doc_id is not null and doc_id != 7"), narrow=n).collect()} for n in (0.0, 0.2))
    assert all(strict[i].lang_pred == (r.lang_pred if r.score >= 0.2 else "und") and strict[i].score == r.score for i, r in plain.items())
    assert len({r.lang_pred for r in plain.values()}) == 4 and sum(r.lang_pred == "und" for r in strict.values()) > 3
    assert {(r.lang_pred, r.score) for r in language.languages(df.withColumn("lang", F.lit(None).cast("string"))).collect()} == {("und", 0.0)}
    assert {r.lang_pred for r in language.languages(df.where("lang = 'de' and doc_id != 1001")).collect()} == {"de"}
    assert language.languages(df.where("false")).count() == 0


def brute_codes(rows, n_entries, rounds):
    """Lloyd rounds over Python integers, every entry measured for every part."""
    kept = [(i, [math.floor(1024 * x) for x in v], label) for i, v, label in rows if v and all(x is not None and math.isfinite(x) for x in v)]
    kept.sort(key=lambda r: (r[0] is None, r[0] or 0, r[1]))
    width = len(kept[0][1]) // 4
    parts = [[v[j * width : (j + 1) * width] for _, v, _ in kept] for j in range(4)]
    far = lambda a, b: sum((x - y) ** 2 for x, y in zip(a, b))
    code, error, books = [""] * len(kept), [0] * len(kept), []
    for own in parts:
        book = own[:n_entries]
        for r in range(rounds + 1):
            near = [min((far(x, c), k) for k, c in enumerate(book)) for x in own]
            if r < rounds:
                for k in range(len(book)):
                    mine = [x for x, (_, e) in zip(own, near) if e == k]
                    if mine:
                        book[k] = [sum(c) // len(mine) for c in zip(*mine)]
        books += [c for entry in book for c in entry]
        code, error = [a + f"{k:02x}" for a, (_, k) in zip(code, near)], [a + d for a, (d, _) in zip(error, near)]
    digest = hashlib.sha256(",".join(map(str, books)).encode()).hexdigest()
    return sorted(((i, c, e, sum(x for x, (_, _, other) in zip(error, kept) if other == label), digest) for (i, _, label), c, e in zip(kept, code, error)), key=str)


@pytest.mark.parametrize(("n", "scale"), [(400, 0.02), (5, 1.0), (300, 1000.0)])
def test_vector_codes_by_brute_force(spark, n, scale):
    rng = np.random.default_rng(n)
    rows = [(int(i), [float(np.float32(x)) for x in rng.normal(0, scale, 8)], int(rng.integers(0, 3)) if i % 5 else None) for i in rng.permutation(n)]
    rows += [(None, rows[0][1], 1), (3, rows[1][1], None), (n + 1, None, 1), (n + 2, [0.5] * 7 + [None], 1), (n + 3, [float("nan")] + [0.0] * 7, 1), (n + 4, [float("inf")] * 8, 2), (n + 5, [], 2)]
    df = spark.createDataFrame(rows, "vec_id long, embedding array<float>, label int").repartition(3).withColumns({c: F.lit(1) for c in ("id", "x", "code", "error")})
    found = vector_codes.vector_codes(df)
    assert found.columns == ["vec_id", "code", "error", "label_error", "codebooks_sha256"]
    assert sorted(map(tuple, found.collect()), key=str) == brute_codes(rows, 256, 4)
    assert vector_codes.vector_codes(df.where("false")).count() == 0
    with pytest.raises(ValueError, match="one length"):
        vector_codes.vector_codes(df.withColumn("embedding", F.slice("embedding", 1, 6)))


def test_exponion_meets_full_search_on_ties():
    rng = np.random.default_rng(1)
    for top in (3, 50, 1 << 23):
        points, book = rng.integers(-top, top, (500, 4)), rng.integers(-top, top, (40, 4))
        book[7] = book[30]
        far = ((points[:, None].astype(object) - book[None].astype(object)) ** 2).sum(2)
        found, least = vector_codes.nearest(points, rng.integers(0, 40, 500), book)
        assert found.tolist() == [int(np.argmin(row)) for row in far] and least.tolist() == [int(min(row)) for row in far]
