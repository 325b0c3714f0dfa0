"""Benchmark decontamination by winnowing, in DataFrame operations only.

Every run of K words has a hash, and of every W neighbouring hashes the smallest is kept with its position: the fingerprints. Two
texts that share a span of K + W - 1 = SPAN words choose the same hash inside it, so joining fingerprints of documents and of
benchmark items finds a place in every shared window of SPAN words. There the match is extended: each window of SPAN words around
the hash is compared word by word, and those that are equal are hits. Items shorter than SPAN are one window; the runs of their
length are hashed and compared directly.

The items' fingerprints are broadcast if they are few (``broadcast_rows``): then one pass over the documents finds all matches, and
besides its fingerprints a document gives one row for itself. Beyond that fingerprints alone are joined by hash, what matches joins
the words, and the documents' own rows come from the saved words.

Defined results: words are as the pattern says, A-Z lowered; null and empty texts have none and are never hit. Items without words
never occur; items repeated with one id are one item, null ids count as the empty string. Rows repeated give rows repeated, null
document ids are kept. An empty benchmark hits nothing. A text's words
and hashes are arrays of one row, so a text of any length takes memory in proportion to it in one task. Other columns of the inputs are not read.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from geostrata.llm.common import only, saved

SPAN, K = 10, 5
W = SPAN - K + 1
#: Fingerprints of the benchmark that are broadcast at most.
BROADCAST_ROWS = 200_000
#: Low bits of a fingerprint that hold its position, enough for any array; the rest is hash. Windows are compared word by word, so hashes need not be unlike.
POSITION_BITS = 31

_SEPARATORS = "".join(chr(c) for c in [*range(0x00, 0x30), *range(0x3A, 0x41), *range(0x5B, 0x61), *range(0x7B, 0x80)])
_UPPER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ"


def words(text: Column) -> Column:
    """The array of words ``[^\\x00-\\x2F\\x3A-\\x60\\x7B-\\x7F]+`` of a text with A-Z lowered."""
    spaced = F.translate(F.coalesce(text, F.lit("")), _UPPER + _SEPARATORS, _UPPER.lower() + " " * len(_SEPARATORS))
    return F.array_remove(F.split(spaced, " "), "")


def _from(a: Column, skip: int) -> Column:
    return F.slice(a, skip + 1, F.greatest(F.size(a) - skip, F.lit(0)))


def _upto(a: Column, less: int) -> Column:
    return F.slice(a, 1, F.greatest(F.size(a) - less, F.lit(0)))


def _pairs(a: Column, shift: int, f) -> Column:
    """f of every two elements ``shift`` apart."""
    return F.zip_with(_upto(a, shift), _from(a, shift), f)


def _steps(df: DataFrame, source: str, length: int, f) -> tuple[DataFrame, str]:
    """A column that combines every ``length`` neighbours of ``source``, by doubling; f is associative or position-free enough."""
    name, reach = source, 1
    while reach < length:
        step = min(reach, length - reach)
        out = f"{source}_{length}_{reach + step}"
        df = df.withColumn(out, _pairs(F.col(name), step, f))
        name, reach = out, reach + step
    return df, name


def _located(hashes: Column) -> Column:
    """Hashes with their low bits replaced by their position, so the least of some is the leftmost of the least hashes."""
    return F.transform(hashes, lambda h, i: F.shiftleft(F.shiftrightunsigned(h, POSITION_BITS), POSITION_BITS).bitwiseOR(i.cast("long")))


def fingerprints(df: DataFrame) -> DataFrame:
    """``df`` with a column ``prints``: the winnowed hashes of its column ``words``, and ``h``: the hashes of the words."""
    df = df.withColumn("h", F.transform("words", lambda w: F.xxhash64(w)))
    df, grams = _steps(df, "h", K, lambda a, b: F.xxhash64(a, b))
    df = df.withColumn("located", _located(F.col(grams)))
    df, least = _steps(df, "located", W, lambda a, b: F.least(a, b))
    return df.withColumn("prints", F.array_distinct(least))


def _hash(v: Column) -> Column:
    return F.shiftright(v, POSITION_BITS)


def _place(v: Column) -> Column:
    return v.bitwiseAND(F.lit((1 << POSITION_BITS) - 1)).cast("int")


_ITSELF = -1


def _near(v: Column, length: int) -> Column:
    """The words of a document that windows around a fingerprint can have: with it those of an item of that length, or of SPAN."""
    at = _place(v)
    if length:
        return F.slice("words", at + 1, F.lit(length))
    before = F.least(at, F.lit(W - 1))
    return F.slice("words", at - before + 1, before + SPAN)


def _windows() -> Column:
    """Starts of the windows of SPAN words in the document that equal the item's, around one match of fingerprints."""
    tests, first = [], F.least("place", F.lit(W - 1))
    for back in range(W):
        here, there = first - back, F.col("before") - back
        inside = (here >= 0) & (there >= 0) & (here + SPAN <= F.size("near")) & (there + SPAN <= F.size("context"))
        tests.append(F.when(inside, F.when(F.slice("near", here + 1, SPAN) == F.slice("context", there + 1, SPAN), F.col("place") - back)))
    return F.array_compact(F.array(*tests))


def decontaminate(df: DataFrame, items: DataFrame, id_col: str = "doc_id", text_col: str = "text", item_col: str = "item_id", item_text_col: str = "text", broadcast_rows: int = BROADCAST_ROWS) -> DataFrame:
    """One row per row of ``df``: id, n_words, n_hit, n_items, items_sha256, contaminated."""
    bench = only(items, item=item_col, text=item_text_col).select(F.coalesce(F.col("item").cast("string"), F.lit("")).alias("item"), words(F.col("text")).alias("words"))
    bench = saved(bench.withColumn("n", F.size("words")).where("n > 0"), "items")
    at = _place(F.col("v"))
    before = F.least(at, F.lit(W - 1))
    context = F.slice("words", at - before + 1, before + SPAN)
    # every such item has prints; of a plain explode Catalyst would infer a filter and write the whole chain out in it, many times over
    index = fingerprints(bench.where(F.col("n") >= SPAN)).select("item", "words", F.explode_outer("prints").alias("v")).select(_hash(F.col("v")).alias("print"), "item", before.alias("before"), context.alias("context"))
    index = saved(index.distinct(), "index")
    # at most SPAN - 1 lengths come to the driver
    lengths = sorted(r.n for r in bench.where(F.col("n") < SPAN).select("n").distinct().collect())

    docs = only(df, id=id_col, text=text_col).withColumn("row", F.monotonically_increasing_id())
    docs = docs.select("row", "id", words(F.col("text")).alias("words")).withColumn("n_words", F.size("words"))
    small = index.limit(broadcast_rows + 1).count() <= broadcast_rows and bench.limit(broadcast_rows + 1).count() <= broadcast_rows
    if not small:
        docs = saved(docs, "words")
    printed = fingerprints(docs)
    # (length, fingerprint) pairs; length 0 stands for winnowed ones and for the document's own row. Rows to broadcast items bring the words
    # that they are compared by; rows that are shuffled meet them after the join
    near = lambda v, n: [_near(v, n).alias("near")] if small else []
    tagged = lambda a, n: F.transform(a, lambda v: F.struct(F.lit(n).alias("length"), v.alias("v"), *near(v, n)))
    given = [tagged(F.col("prints"), 0)]
    for length in lengths:
        printed, grams = _steps(printed, "h", length, lambda a, b: F.xxhash64(a, b))
        given.append(tagged(_located(F.col(grams)), length))
    if small:
        given.append(F.array(F.struct(F.lit(0).alias("length"), F.lit(_ITSELF).cast("long").alias("v"), F.array().cast("array<string>").alias("near"))))
    known = index.select(F.lit(0).alias("length"), "print", "item", "before", "context")
    for length in lengths:
        short, grams = _steps(bench.where(F.col("n") == length).withColumn("h", F.transform("words", lambda w: F.xxhash64(w))), "h", length, lambda a, b: F.xxhash64(a, b))
        known = known.union(short.select(F.lit(length), _hash(F.element_at(_located(F.col(grams)), 1)), "item", F.lit(0), "words").distinct())
    rows = printed.select("row", "id", "n_words", F.explode(F.concat(*given)).alias("p")).select("row", "id", "n_words", "p.*").withColumn("print", _hash(F.col("v"))).withColumn("place", _place(F.col("v")))
    own = (F.col("v") == _ITSELF) & (F.col("length") == 0)
    if small:
        found = rows.join(F.broadcast(known), ["length", "print"], "left").where(own | F.col("item").isNotNull())
    else:
        # a frequent passage has many rows of one fingerprint on the documents' side, which adaptive execution may split
        found = rows.join(known, ["length", "print"]).join(docs.select("row", "words"), "row")
        of_length = F.lit(None).cast("array<string>")
        for length in lengths:
            of_length = F.when(F.col("length") == length, _near(F.col("v"), length)).otherwise(of_length)
        found = found.withColumn("near", F.when(F.col("length") == 0, _near(F.col("v"), 0)).otherwise(of_length)).drop("words")
    whole = F.when(F.col("near") == F.col("context"), F.array("place")).otherwise(F.array().cast("array<int>"))
    starts = F.when(own, F.array().cast("array<int>")).when(F.col("length") == 0, _windows()).otherwise(whole)
    hits = found.withColumn("starts", starts).where(own | (F.size("starts") > 0)).withColumn("span", F.when(F.col("length") == 0, SPAN).otherwise(F.col("length"))).select("row", "id", "n_words", F.when(~own, F.col("item")).alias("item"), F.explode_outer("starts").alias("start"), "span")
    # each hit adds the words that no hit before it has covered
    before_it = F.coalesce(F.max(F.col("start") + F.col("span")).over(Window.partitionBy("row").orderBy("start", "span").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    new = F.when(F.col("start").isNotNull(), F.greatest(F.col("start") + F.col("span") - F.greatest("start", before_it), F.lit(0))).otherwise(0)
    if not small:
        hits = hits.union(docs.select("row", "id", "n_words", F.lit(None).cast("string"), F.lit(None).cast("int"), F.lit(0)))
    counted = hits.distinct().withColumn("new", new).groupBy("row").agg(F.first("id").alias("id"), F.max("n_words").alias("n_words"), F.sum("new").alias("n_hit"), F.sort_array(F.collect_set("item")).alias("items"))
    return counted.select(
        F.col("id").alias(id_col), F.col("n_words").cast("long").alias("n_words"), "n_hit", F.size("items").cast("long").alias("n_items"), F.sha2(F.array_join("items", ","), 256).alias("items_sha256"), (F.col("n_hit") > 0).alias("contaminated"),
    )
