"""Personal data replaced by surrogates, in DataFrame operations only.

Entities are found by one pattern per text. Each has a canonical form (addresses in lower case, numbers as their digits), so
that its mentions refer to one entity however they are written; all distinct entities of the corpus make a dictionary, in which
every entity gets a surrogate from a keyed hash of its canonical form: digits for digits, letters for letters, the same
country code, card network, top-level domain, title and script, names of the title's gender, and a valid check digit for a
card. A number like a card's or an account's whose check digits are wrong is none and stays. Surrogates that two entities share, or that are themselves an entity of the corpus, are drawn again with the next
attempt's hash, the smallest canonical form keeping its own, until all are distinct. Each mention then gets its entity's
surrogate in the mention's own format. Texts without an entity are never shuffled and stay as they are. An address has labels of 63
characters and 127 of them at most, as names of hosts do.

A name's canonical form is the bare name, without its title, which only steers the surrogate's gender. One word of a full name that
the same text introduces is that full name (the first one whose family name it is, else given name), and gets that word's part of
the surrogate. Names that a title introduces are also replaced where the same text repeats them, or a word of them, without one.
No two names share a surrogate's family name.

Defined results: a null text stays null and has no entity; empty texts stay empty. Rows repeated give rows repeated, with the same
surrogates; null ids are kept. Empty tables give empty results. Other columns of the input are not read.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from geostrata.llm.common import only, saved

#: The setting that holds the key of all hashes. There is no default: without a key the operator fails.
KEY = "spark.geostrata.pii.key"

#: Attempts after which surrogates of addresses and of telephone and insurance numbers get longer.
STEADY = 5

_TITLES = {"m": ["Mr", "Herr", "Señor", "Sr", "Monsieur", "Sir", "Господин"], "f": ["Mrs", "Ms", "Miss", "Frau", "Señora", "Sra", "Madame", "Mme", "Госпожа"], "n": ["Dr", "Prof"]}
_ANY_TITLE = "|".join(t for group in _TITLES.values() for t in group)
_NAME = rf"\p{{Lu}}\p{{Ll}}+(?:[ -](?!(?:{_ANY_TITLE})(?!\p{{L}}))\p{{Lu}}\p{{Ll}}+)?"
PATTERNS = {
    "email": r"(?<![A-Za-z0-9._%+-])[A-Za-z0-9._%+-]++@[A-Za-z0-9-]{1,63}(?:\.[A-Za-z0-9-]{1,63}){0,125}\.[A-Za-z]{2,63}",
    "iban": r"(?<![A-Za-z0-9])[A-Z]{2}[0-9]{2}(?: ?[A-Z0-9]{4}){3,7}(?: ?[A-Z0-9]{1,3})?(?![A-Za-z0-9])",
    "card": r"(?<![0-9A-Za-z._-])[2-6][0-9]{3}(?:[0-9]{9,12}|([ -])[0-9]{4}\1[0-9]{4}\1[0-9]{1,4}|[ -][0-9]{6}[ -][0-9]{5})(?![0-9A-Za-z_-]|\.[0-9])",
    "phone": r"(?<![0-9A-Za-z+.-])(?:\+[0-9]{1,3}[ .-]?(?:\([0-9]{1,4}\)[ .-]?)?[0-9]{2,4}(?:[ .-]?[0-9]{2,4}){1,4}|\([0-9]{3}\) ?[0-9]{3}[ .-][0-9]{4}|[0-9]{3}([.-])[0-9]{3}\2[0-9]{4})(?![0-9A-Za-z])",
    "ssn": r"(?<![0-9A-Za-z-])[0-9]{3}-[0-9]{2}-[0-9]{4}(?![0-9A-Za-z-])",
    "ip": r"(?<![0-9A-Za-z.])(?:(?:25[0-5]|2[0-4][0-9]|1?[0-9]?[0-9])\.){3}(?:25[0-5]|2[0-4][0-9]|1?[0-9]?[0-9])(?![0-9A-Za-z]|\.[0-9])",
    "name": rf"(?<![\p{{L}}0-9])(?:{_ANY_TITLE})\.? {_NAME}",
}
_TITLE = rf"\A(?:{_ANY_TITLE})\.? "
ANY = "|".join(f"(?:{p})" for p in PATTERNS.values())
_INITIALS = "".join(sorted({t[0] for group in _TITLES.values() for t in group}))
#: Every entity has one of these, and few texts do: the cheap test that comes first. An address has its sign, a number five digits with
#: little between them or dots, an account number two letters and two digits, and a name a title, of which the initial is looked for first.
_HINT = rf"@|[0-9](?:[ .()-]{{0,2}}[0-9]){{4}}|[0-9]\.[0-9]{{1,3}}\.[0-9]|[A-Z]{{2}}[0-9]{{2}}|(?=[{_INITIALS}])(?:{_ANY_TITLE})\.? \p{{Lu}}"
#: Names are put together from these fixed syllables; given names by gender and script.
_SYLLABLES = {"latin": "ba bel bor bru cal cor dan del dor fal far gar gil hal har jor kel kin lan lor mar mel mor nor pel ran ros sal sel tal tor val ver wal".split(), "cyrillic": "ба бел бор ва вар гор дан дол жар зар кал кор лан мар мел нор пол ран рос сал тал тор фал хар".split()}
_GIVEN = {
    ("latin", "m"): "Adrian Bruno Carl Daniel Emil Felix Georg Hugo Ivan Jonas Karl Leo Martin Noel Oscar Paul".split(),
    ("latin", "f"): "Alma Berta Clara Diana Elena Flora Greta Helena Irma Julia Karla Laura Marta Nora Olga Paula".split(),
    ("latin", "n"): "Alex Andrea Charlie Dominique Eden Jordan Kim Luca Maxime Noa Robin Sam Sascha Toni".split(),
    ("cyrillic", "m"): "Антон Борис Виктор Глеб Денис Егор Иван Кирилл Леонид Максим".split(),
    ("cyrillic", "f"): "Анна Вера Галина Дарья Елена Жанна Инна Клара Лидия Мария".split(),
    ("cyrillic", "n"): "Саша Женя Валя Слава".split(),
}


def _digits(s: Column) -> Column:
    return F.regexp_replace(s, r"[^0-9]", "")


def kind_of(entity: Column) -> Column:
    """The first pattern that is the whole mention; ``none`` for a card number whose check digit is wrong, and for an account number that doesn't
    leave 1 modulo 97: they are none."""
    out = F.lit("name")
    for kind in reversed([k for k in PATTERNS if k != "name"]):
        out = F.when(entity.rlike(rf"\A(?:{PATTERNS[kind].replace(chr(92) + '2', chr(92) + '1')})\z"), kind).otherwise(out)
    digits = _digits(entity)
    valid = _luhn(F.substr(digits, F.lit(1), F.length(digits) - 1)) == F.substr(digits, F.length(digits), F.lit(1))
    account = F.replace(entity, F.lit(" "), F.lit(""))
    return F.when((out == "card") & ~valid, "none").when((out == "iban") & (_modulo_97(F.concat(F.substr(account, F.lit(5)), F.substr(account, F.lit(1), F.lit(4)))) != 1), "none").otherwise(out)


def canonical(kind: Column, entity: Column) -> Column:
    return F.when(kind.isin("card", "phone", "ssn"), _digits(entity)).when(kind == "email", F.lower(entity)).when(kind == "iban", F.replace(entity, F.lit(" "), F.lit(""))).when(kind == "name", F.regexp_replace(entity, _TITLE, "")).otherwise(entity)


def gender_of(mention: Column) -> Column:
    """m or f by the mention's title, else null."""
    title = F.regexp_replace(F.regexp_extract(mention, _TITLE, 0), r"\.? \z", "")
    return F.when(title.isin(_TITLES["m"]), "m").when(title.isin(_TITLES["f"]), "f")


def _last(name: Column) -> Column:
    return F.substring_index(name, " ", -1)


def _with_repeats(bare_names: Column) -> Column:
    """The pattern of a text: all entities, and the names that it introduces and their words, longest first. Names are of letters,
    spaces and hyphens, which stand for themselves."""
    words = F.array_distinct(F.concat(bare_names, F.flatten(F.transform(bare_names, lambda x: F.split(x, " ")))))
    longest = F.transform(F.sort_array(F.transform(words, lambda x: F.struct(F.length(x).alias("n"), x.alias("x"))), False), lambda s: s["x"])
    return F.when(F.size(words) > 0, F.concat(F.lit(ANY + r"|(?<![\p{L}0-9])(?=\p{Lu})(?:"), F.array_join(longest, "|"), F.lit(r")(?![\p{L}0-9])"))).otherwise(F.lit(ANY))


def _hash(key: str, *parts: Column) -> Column:
    """A keyed hash as 64 hexadecimal digits: the key stands on both sides of what is hashed."""
    return F.sha2(F.concat_ws("\x1f", F.lit(key), *parts, F.lit(key)), 256)


def _number(h: Column, at: int, n: int = 8) -> Column:
    return F.conv(F.substring(h, at, n), 16, 10).cast("long")


def _redrawn(s: Column, h: Column) -> Column:
    """``s`` with its letters and digits replaced by others of the same case, drawn from the hash by their position."""
    chars = F.split(s, "")

    def one(c: Column, i: Column) -> Column:
        v = F.conv(F.substr(h, F.pmod(i * 2, F.lit(60)) + 1, F.lit(4)), 16, 10).cast("int") + i
        letter = lambda first: F.char((F.lit(first) + F.pmod(v, F.lit(26))).cast("int"))
        return F.when(c.rlike("[0-9]"), F.pmod(v, F.lit(10)).cast("string")).when(c.rlike("[a-z]"), letter(97)).when(c.rlike("[A-Z]"), letter(65)).otherwise(c)

    return F.array_join(F.transform(chars, one), "")


def _luhn(digits: Column) -> Column:
    """The check digit of a card number's other digits."""
    doubled = F.transform(F.reverse(F.split(digits, "")), lambda d, i: F.when(i % 2 == 0, F.when(d.cast("int") > 4, d.cast("int") * 2 - 9).otherwise(d.cast("int") * 2)).otherwise(d.cast("int")))
    return F.pmod(-F.aggregate(doubled, F.lit(0), lambda a, d: a + F.coalesce(d, F.lit(0))), F.lit(10)).cast("string")


def _modulo_97(account: Column) -> Column:
    """What digits and capital letters, which stand for 10 to 35, leave as one number modulo 97."""
    def step(acc, c):
        v = F.when(c.rlike("[0-9]"), c.cast("int")).otherwise(F.ascii(c) - 55)
        return F.pmod(acc * F.when(v > 9, 100).otherwise(10) + v, F.lit(97)).cast("int")

    return F.aggregate(F.split(account, ""), F.lit(0), step)


def _pick(values: list[str], v: Column) -> Column:
    return F.element_at(F.array(*(F.lit(x) for x in values)), (F.pmod(v, F.lit(len(values))) + 1).cast("int"))


def _name(entity: Column, h: Column, attempt: Column, gender: Column) -> Column:
    """A given name of the gender where the name has two words, and a family name, in the entity's script. A family name has three
    syllables and one more for every attempt, so that there are enough for any number of entities."""
    script = F.when(entity.rlike(r"\p{IsCyrillic}"), "cyrillic").otherwise("latin")
    by_script = lambda make: F.when(script == "cyrillic", make("cyrillic")).otherwise(make("latin"))
    drawn = F.transform(F.sequence(F.lit(0), attempt + 2), lambda i: _number(F.sha2(F.concat_ws("\x1f", h, i.cast("string")), 256), 1))
    family = F.initcap(by_script(lambda s: F.array_join(F.transform(drawn, lambda v: _pick(_SYLLABLES[s], v)), "")))
    given = by_script(lambda s: F.when(gender == "m", _pick(_GIVEN[s, "m"], _number(h, 33))).when(gender == "f", _pick(_GIVEN[s, "f"], _number(h, 33))).otherwise(_pick(_GIVEN[s, "n"], _number(h, 33))))
    return F.when(entity.contains(" "), F.concat(given, F.lit(" "), family)).when(entity.contains("-"), F.concat(given, F.lit("-"), family)).otherwise(family)


def surrogate(kind: Column, canon: Column, attempt: Column, key: str, gender: Column) -> Column:
    """The canonical form's surrogate, itself in canonical form. ``gender`` (m, f or null) is a name's."""
    h = _hash(key, kind, canon, attempt.cast("string"))
    at = F.substring_index(canon, "@", -1)
    top = F.concat(F.lit("."), F.substring_index(at, ".", -1))
    body = F.substr(at, F.lit(1), F.length(at) - F.length(top))
    # where a kind has few surrogates of a mention's length, the later attempts draw longer ones
    more = lambda c: _redrawn(F.repeat(F.lit(c), F.greatest(attempt - STEADY, F.lit(0)).cast("int")), _hash(key, F.lit("more"), canon, attempt.cast("string")))
    email = F.concat(_redrawn(F.substring_index(canon, "@", 1), h), more("a"), F.lit("@"), _redrawn(body, _hash(key, F.lit("domain"), body)), top)
    card_body = F.concat(F.substr(canon, F.lit(1), F.lit(1)), _redrawn(F.substr(canon, F.lit(2), F.length(canon) - 2), h))
    card = F.concat(card_body, _luhn(card_body))
    head = F.greatest(F.length(canon) - 10, F.lit(0))  # digits before the last ten are the country's
    phone = F.concat(F.substr(canon, F.lit(1), head), _redrawn(F.substr(canon, head + 1, F.lit(10)), h), more("0"))
    ip = F.concat_ws(".", *((F.pmod(_number(h, 1 + 8 * i), F.lit(254)) + 1).cast("string") for i in range(4)))
    country, account = F.substr(canon, F.lit(1), F.lit(2)), _redrawn(F.substr(canon, F.lit(5), F.length(canon)), h)
    iban = F.concat(country, F.lpad((98 - _modulo_97(F.concat(account, country, F.lit("00")))).cast("string"), 2, "0"), account)
    # an insurance number's area is 001 to 899 without 666, its group and its serial are not 0
    area = 1 + F.pmod(_number(h, 41), F.lit(898))
    ssn = F.concat(F.lpad((area + (area >= 666).cast("int")).cast("string"), 3, "0"), F.lpad((1 + F.pmod(_number(h, 49), F.lit(99))).cast("string"), 2, "0"), F.lpad((1 + F.pmod(_number(h, 57), F.lit(9999))).cast("string"), 4, "0"), more("0"))
    return F.when(kind == "email", email).when(kind == "card", card).when(kind == "phone", phone).when(kind == "ssn", ssn).when(kind == "ip", ip).when(kind == "iban", iban).otherwise(_name(canon, h, attempt, gender))


def _formatted(kind: Column, mention: Column, canon: Column, found: Column) -> Column:
    """A canonical surrogate written the way the mention is: its separators, its spaces, its case, its title, its part of the name."""
    put = F.aggregate(
        F.split(mention, ""), F.struct(F.lit("").alias("out"), F.lit(1).alias("at")),
        lambda acc, c: F.when(c.rlike("[0-9A-Z]"), F.struct(F.concat(acc["out"], F.substr(found, acc["at"], F.lit(1))).alias("out"), (acc["at"] + 1).alias("at"))).otherwise(F.struct(F.concat(acc["out"], c).alias("out"), acc["at"].alias("at"))),
    )
    put = F.concat(put["out"], F.substr(found, put["at"], F.length(found)))
    bare = F.regexp_replace(mention, _TITLE, "")
    part = F.when(bare == canon, found).when(bare == _last(canon), _last(found)).otherwise(F.substring_index(found, " ", 1))
    return F.when(kind == "name", F.concat(F.regexp_extract(mention, _TITLE, 0), part)).when(kind.isin("card", "phone", "ssn", "iban"), put).when((kind == "email") & (mention == F.upper(mention)) & (mention != F.lower(mention)), F.upper(found)).otherwise(found)


def dictionary(entities: DataFrame, key: str) -> DataFrame:
    """kind, canon and surrogate of every distinct entity; no two of a kind share a surrogate (names: a family name), and none is an
    entity itself. A column ``gender`` of ``entities`` counts where an entity's mentions agree on it."""
    gender = F.col("gender") if "gender" in entities.columns else F.lit(None).cast("string")
    distinct = entities.groupBy("kind", "canon").agg(F.min(gender).alias("low"), F.max(gender).alias("high"))
    distinct = distinct.select("kind", "canon", F.when(F.col("low") == F.col("high"), F.col("low")).alias("gender"))
    drawn = saved(distinct.select("kind", "canon", "gender", F.lit(0).alias("attempt"), surrogate(F.col("kind"), F.col("canon"), F.lit(0), key, F.col("gender")).alias("surrogate")), "drawn")
    mark = lambda c: F.when(F.col("kind") == "name", _last(F.col(c))).otherwise(F.col(c)).alias("mark")
    names = drawn.select("kind", mark("canon"), F.lit(True).alias("taken")).distinct()
    while True:
        # surrogates are as good as distinct: groups are of one or a few rows
        first = F.row_number().over(Window.partitionBy("kind", "mark").orderBy("attempt", "canon"))
        checked = saved(drawn.withColumn("mark", mark("surrogate")).withColumn("place", first).join(names, ["kind", "mark"], "left").select("kind", "canon", "gender", "attempt", "surrogate", ((F.col("place") > 1) | F.col("taken").isNotNull()).alias("again")), "checked")
        if checked.where("again").isEmpty():
            return checked.select("kind", "canon", "surrogate")
        attempt = F.col("attempt") + F.col("again").cast("int")
        drawn = checked.select("kind", "canon", "gender", attempt.alias("attempt"), F.when(F.col("again"), surrogate(F.col("kind"), F.col("canon"), attempt, key, F.col("gender"))).otherwise(F.col("surrogate")).alias("surrogate"))


def _full_names(names: DataFrame) -> DataFrame:
    """row, canon (one word) and full: the first of a text's full names whose family name that word is, else whose given name."""
    full = names.select("row", F.posexplode("names").alias("at", "full")).where(F.col("full").contains(" "))
    word = lambda rank, c: full.select("row", c.alias("canon"), F.struct(F.lit(rank).alias("rank"), "at").alias("order"), "full")
    return word(0, _last(F.col("full"))).union(word(1, F.substring_index("full", " ", 1))).groupBy("row", "canon").agg(F.min_by("full", "order").alias("full"))


def surrogates(df: DataFrame, id_col: str = "doc_id", text_col: str = "text", key: str | None = None) -> DataFrame:
    """One row per row of ``df``: id, text with surrogates, n_entities. ``key``, or else the setting KEY, is needed."""
    key = key or df.sparkSession.conf.get(KEY, None)
    if not key:
        raise ValueError(f"surrogates need a secret key: pass one or set {KEY}")
    docs = only(df, id=id_col, text=text_col)
    found = F.when(F.col("text").rlike(_HINT), F.regexp_extract_all(F.col("text"), F.lit(ANY), F.lit(0)))
    # the patterns run over the texts once; what they found is kept beside them
    docs = saved(docs.withColumn("entities", F.coalesce(found, F.array().cast("array<string>"))).withColumn("row", F.monotonically_increasing_id()), "scanned")
    some = docs.where(F.size("entities") > 0)
    # what a title introduces in a text is looked for in that text a second time, without one
    names = F.transform(F.filter("entities", lambda x: x.rlike(_TITLE)), lambda x: F.regexp_replace(x, _TITLE, ""))
    some = some.withColumn("names", F.array_distinct(names)).withColumn("pattern", _with_repeats(F.col("names")))
    some = some.withColumn("entities", F.when(F.size("names") > 0, F.regexp_extract_all("text", "pattern", F.lit(0))).otherwise(F.col("entities")))
    mentions = some.select("row", F.posexplode("entities").alias("pos", "mention")).withColumn("kind", kind_of(F.col("mention"))).withColumn("canon", canonical(F.col("kind"), F.col("mention")))
    mentions = mentions.select("row", "pos", "mention", "kind", "canon", gender_of(F.col("mention")).alias("gender"))
    in_full = _full_names(some.where(F.size("names") > 0)).withColumn("kind", F.lit("name"))
    mentions = mentions.join(in_full, ["row", "kind", "canon"], "left").select("row", "pos", "mention", "kind", F.coalesce("full", "canon").alias("canon"), "gender")
    mentions = saved(mentions, "mentions")
    known = dictionary(mentions.where("kind <> 'none'"), key)
    # an entity that is mentioned everywhere is one row of the dictionary: adaptive execution may split its mentions
    put = F.when(F.col("surrogate").isNull(), F.col("mention")).otherwise(_formatted(F.col("kind"), F.col("mention"), F.col("canon"), F.col("surrogate")))
    new = mentions.join(known, ["kind", "canon"], "left").select("row", F.struct("pos", put.alias("new")).alias("one"), F.col("surrogate").isNotNull().cast("int").alias("is_entity"))
    new = new.groupBy("row").agg(F.transform(F.array_sort(F.collect_list("one")), lambda x: x["new"]).alias("new"), F.sum("is_entity").cast("int").alias("n_entities"))  # a text's own mentions
    pieces = F.zip_with(F.when(F.size("names") > 0, F.split("text", F.col("pattern"), -1)).otherwise(F.split("text", ANY, -1)), F.col("new"), lambda kept, put: F.concat(kept, F.coalesce(put, F.lit(""))))
    replaced = some.join(new, "row").select("id", F.array_join(pieces, "").alias("text"), "n_entities")
    same = docs.where(F.size("entities") == 0).select("id", "text", F.lit(0).alias("n_entities"))
    return same.union(replaced).select(F.col("id").alias(id_col), F.col("text").alias(text_col), "n_entities")
