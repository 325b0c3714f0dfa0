"""Languages by compression: a text is of the language whose dictionary makes it smallest.

Each language has a raw-content dictionary of zstandard, at most ``DICT_BYTES`` of labelled text. Of a text only the letters in lower
case are compressed, with spaces for what is between them. It is cut into chunks of
``CHUNK`` bytes, so that the dictionary is near at every place of it; every chunk is compressed with every dictionary, and the
language of the least total wins. The relative margin to the second is the score. Fitting draws documents by the hash of their
id up to a bound per language; scoring is one pass over the table without a shuffle, a slice of 4 MB or one text at a time.

Defined results: null texts and those without a letter are ``und`` with score 0, and so is everything where no row is labelled. Of equal
totals the language with more labelled bytes wins, then the smaller name; the score is 0. With one language only there is no second, and the
score is 1. Texts are compressed whole, whatever their length. A null id belongs to no fold: it is predicted, not held out, never
learned from. Repeated rows are predicted alike. An empty table gives an empty result. Other columns are not read, whatever their names.
"""

from __future__ import annotations

from collections import Counter

import numpy as np
import pyarrow as pa
import zstandard
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from geostrata.llm.common import only, slices, utf8

#: Bytes of a language's dictionary at most, all that a model keeps of it.
DICT_BYTES = 1 << 17
#: Of a language, texts of about so many bytes are drawn to make its dictionary.
SAMPLE_BYTES = 8 * DICT_BYTES
CHUNK, LEVEL = 4096, 3
#: Texts whose best total is less than this share below the second are rejected where a caller asks for it.
NARROW = 0.005
NONE = "und"


def letters(kept: str = ""):
    """What of a text goes into compression: its letters in lower case, with one space for what is between them."""
    return F.trim(F.regexp_replace(F.lower("text"), rf"[^\p{{L}}{kept}]+", " "))


def held_out(id_col: str = "id"):
    """Whether a row is of the fold that nothing is learned from."""
    return F.coalesce(F.crc32(F.col(id_col).cast("string").cast("binary")) % 5 == 0, F.lit(False))


def fit(docs: DataFrame) -> list[tuple[str, bytes]]:
    """Languages with their dictionaries, those with more labelled bytes first, from ``docs`` (id, text, lang).

    Two aggregates of one row per language, and texts of about ``SAMPLE_BYTES`` per language, reach the driver.
    """
    labelled = docs.where(~held_out() & F.col("id").isNotNull() & F.col("lang").isNotNull() & F.col("text").rlike(r"\p{L}"))
    sizes = {r["lang"]: r["n"] for r in labelled.groupBy("lang").agg(F.sum(F.octet_length("text")).alias("n")).collect()}
    if not sizes:
        return []
    # of each language the rows with the smallest hashes, down to a share that brings about SAMPLE_BYTES
    cut = F.element_at(F.create_map(*(F.lit(x) for lang, n in sizes.items() for x in (lang, float(min(1.0, SAMPLE_BYTES / n))))), F.col("lang"))
    place = F.pmod(F.xxhash64("id"), F.lit(1 << 40))
    # a longer text gives its first SAMPLE_BYTES only: what is drawn stays bounded
    drawn = labelled.where(place < cut * float(1 << 40)).select("lang", place.alias("place"), F.substring("text", 1, SAMPLE_BYTES).alias("text")).collect()
    lines = {lang: dict.fromkeys(line for _, t in sorted((r["place"], r["text"]) for r in drawn if r["lang"] == lang) for line in t.splitlines()) for lang in sizes}
    of = Counter(line for own in lines.values() for line in own)
    found = []
    for lang in sorted(sizes, key=lambda x: (-sizes[x], x)):
        # a line that other languages have too tells nothing
        found.append((lang, "\n".join(line for line in lines[lang] if of[line] == 1).encode("utf-8", "replace")[:DICT_BYTES]))
    return [(lang, content) for lang, content in found if content]


def compressors(model: list[tuple[str, bytes]]) -> list[zstandard.ZstdCompressor]:
    made = []
    for _, content in model:
        dictionary = zstandard.ZstdCompressionDict(content, dict_type=zstandard.DICT_TYPE_RAWCONTENT)
        dictionary.precompute_compress(level=LEVEL)
        made.append(zstandard.ZstdCompressor(dict_data=dictionary, write_checksum=False, write_content_size=False, write_dict_id=False))
    return made


def totals(data: memoryview, known: list[zstandard.ZstdCompressor]) -> list[int]:
    """The compressed size of a whole text with each dictionary."""
    return [sum(len(c.compress(data[at : at + CHUNK])) for at in range(0, len(data), CHUNK)) for c in known]


def verdict(sizes: list[int]) -> tuple[int, float]:
    """The index of the least size, the first of equal ones, and its relative margin to the second."""
    best = min(range(len(sizes)), key=sizes.__getitem__)
    second = min((n for i, n in enumerate(sizes) if i != best), default=None)
    return best, 1.0 if second is None else 1.0 - sizes[best] / second


def identify(df: DataFrame, model: list[tuple[str, bytes]], id_col: str = "doc_id", text_col: str = "text", narrow: float = NARROW) -> DataFrame:
    """One row per row of ``df``: id, lang_pred, score. Texts with a score below ``narrow`` are rejected as ``und`` and keep their score."""
    docs = only(df, id=id_col, text=text_col).withColumn("text", letters())

    def run(batches):
        known = compressors(model)
        for batch in slices(batches, 1):
            data, offsets = utf8(batch.column(1))
            view, langs, scores = memoryview(np.ascontiguousarray(data)), [], []
            for i, text in enumerate(batch.column(1)):
                if not known or not text.is_valid or not data[offsets[i] : offsets[i + 1]].size:
                    langs.append(NONE)
                    scores.append(0.0)
                    continue
                best, score = verdict(totals(view[offsets[i] : offsets[i + 1]], known))
                langs.append(model[best][0] if score >= narrow else NONE)
                scores.append(score)
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(langs, pa.string()), pa.array(scores, pa.float64())], ["id", "lang_pred", "score"])

    return docs.mapInArrow(run, f"id {docs.schema['id'].dataType.simpleString()}, lang_pred string, score double").withColumnRenamed("id", id_col)


def languages(df: DataFrame, id_col: str = "doc_id", text_col: str = "text", lang_col: str = "lang", narrow: float = NARROW) -> DataFrame:
    """One row per row of ``df``: id, held_out, lang_pred, score; learned from the labelled rows that are not held out."""
    model = fit(only(df, id=id_col, text=text_col, lang=lang_col).withColumn("text", letters(r"\n")))
    found = identify(df, model, id_col, text_col, narrow)
    return found.select(F.col(f"`{id_col}`"), held_out(f"`{id_col}`").alias("held_out"), "lang_pred", "score")
