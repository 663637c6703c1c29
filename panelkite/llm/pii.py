"""Personal data: pattern spans, and terms that give their owners away.

The patterns find the protected values. A value stands for several protected entities: itself, the
group it belongs to (mail domain, network, card issuer, area), its kind, and personal data as such. How
strongly a term in a text with an entity reveals it is estimated from the whole corpus: with p over
distinct texts, the pointwise mutual information log p(entity, term) / p(entity) p(term), as a share of
the entity's own information -log p(entity). A term that discloses more than a threshold is generalised,
and beyond a second one removed, if chance does not explain how often the two are together.

Two kinds of evidence are pooled, as single cases prove nothing. Words that mix letters and digits
(keys, codes) hardly ever come back and are counted by their length. Names, the words of an address
before its @, are tested as one relation: whether texts use the names of their own addresses more often
than the corpus does; each then discloses its address by its own counts.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .shared import ascii_lower, settled

KINDS = ("email", "ip", "card", "phone")

# What the patterns accept is fixed. Possessive quantifiers, and starts only where a run starts or the
# last match ended, keep the time linear in the text and find the same matches. Runs of digits with too
# few or too many for a card are passed over at once; they could not be accepted.
LOCAL = "[A-Za-z0-9._%+-]"
PATTERNS = {
    "email": rf"(?:\G|(?<!{LOCAL})){LOCAL}++@[A-Za-z0-9-]++(?:\.[A-Za-z0-9-]++)++",
    "ip": r"(?<![0-9])[0-9]++\.[0-9]++\.[0-9]++\.[0-9]++",
    "card": r"(?<![0-9])(?<![0-9][\x20-])[0-9](?:[\x20-]?+[0-9]){11,18}+(?![\x20-]?[0-9])",
    "phone": r"\+[0-9][\x20().0-9-]+[0-9]",
}
#: Cheap tests that a text without any match of a kind fails.
MAY_HAVE = {"email": "@", "ip": "[0-9]\\.[0-9]", "card": "[0-9]", "phone": "\\+[0-9]"}

CHANCE = 0.01  # bound on the probability that any term is marked by chance
GENERALISE = 0.5
REMOVE = 0.8
TERM = "term"
#: Words in which terms are counted: letters and digits, and what joins them inside a word.
WORD = r"[\p{L}\p{N}]+(?:['’_-][\p{L}\p{N}]+)*+"
#: Words of at least this many letters and digits, both present, are counted by their length.
CODE = 8
#: Words of fewer letters in an address are no names.
NAME = 3
VALUE, GROUP, KIND, ANY = range(4)


def _digits(value: Column) -> Column:
    return F.regexp_replace(value, "[^0-9]", "")


def _luhn(digits: Column) -> Column:
    """Whether the digits, every second from the right doubled, sum to a multiple of ten."""
    doubled = F.transform(
        F.split(F.reverse(digits), ""),
        lambda d, i: F.when(i % 2 == 0, d.cast("int")).otherwise(
            F.when(d.cast("int") > 4, d.cast("int") * 2 - 9).otherwise(d.cast("int") * 2)
        ),
    )
    return F.aggregate(doubled, F.lit(0), lambda a, d: a + d) % 10 == 0


def _accepted(kind: str, value: Column) -> Column:
    if kind == "ip":
        parts = F.transform(F.split(value, r"\."), lambda p: F.ltrim(p, F.lit("0")))
        return F.forall(parts, lambda p: (F.length(p) <= 3) & (F.coalesce(p.try_cast("int"), F.lit(0)) <= 255))
    if kind == "card":
        return F.length(_digits(value)).between(12, 19) & _luhn(_digits(value))
    if kind == "phone":
        return F.length(_digits(value)).between(9, 15)
    return F.lit(True)


def located(text: Column, pattern: str) -> Column:
    """(start, end, value) of the matches of `pattern`, in code points.

    What lies between matches comes from splitting at them; starts are the running lengths.
    """
    values = F.regexp_extract_all(text, F.lit(pattern), F.lit(0))
    between = F.transform(F.split(text, pattern, -1), lambda x: F.length(x))
    empty = F.struct(
        F.lit(0).alias("end"), F.array().cast("array<struct<start:int,end:int,value:string>>").alias("spans")
    )

    def add(acc, piece):
        start = acc["end"] + piece["gap"]
        end = start + F.length(piece["value"])
        span = F.struct(start.alias("start"), end.alias("end"), piece["value"].alias("value"))
        return F.struct(end.alias("end"), F.array_append(acc["spans"], span).alias("spans"))

    pieces = F.arrays_zip(between.alias("gap"), values.alias("value"))
    return F.aggregate(F.slice(pieces, 1, F.size(values)), empty, add, lambda acc: acc["spans"])


SPAN = "array<struct<start:int,end:int,value:string>>"
MARK = "array<struct<start:int,end:int,disclosure:double>>"


def _spans_of(text: Column, k: int) -> Column:
    kind = KINDS[k]
    spans = F.filter(located(text, PATTERNS[kind]), lambda s: _accepted(kind, s["value"]))
    spans = F.when(F.rlike(text, F.lit(MAY_HAVE[kind])), spans).otherwise(F.array().cast(SPAN))
    return F.transform(spans, lambda s: F.struct(s["start"], F.lit(k).alias("k"), s["end"], s["value"]))


def pattern_spans(text: Column) -> Column:
    """All accepted pattern matches of a text as (start, k, end, value), by start and kind number."""
    return F.array_sort(F.concat(*(_spans_of(text, k) for k in range(len(KINDS)))))


def _outside(text: Column, base: Column) -> Column:
    """The text with its values left out."""
    start = F.struct(F.lit(0).alias("end"), F.array().cast("array<string>").alias("parts"))

    def add(acc, s):
        part = F.substring(text, acc["end"] + 1, F.greatest(s["start"] - acc["end"], F.lit(0)))
        return F.struct(
            F.greatest(acc["end"], s["end"]).alias("end"), F.array_append(acc["parts"], part).alias("parts")
        )

    done = F.aggregate(base, start, add)
    return F.concat_ws(" ", done["parts"], F.substring(text, done["end"] + 1, F.length(text)))


def _term(word: Column) -> Column:
    """What a word is counted as: in lower case, codes as # and their length."""
    code = (F.length(word) >= CODE) & word.rlike("[0-9]") & word.rlike(r"\p{L}")
    return F.when(code, F.concat(F.lit("#"), F.length(word))).otherwise(F.lower(word))


def _terms_of(text: Column) -> Column:
    """The distinct terms of a text."""
    return F.array_distinct(F.transform(F.regexp_extract_all(text, F.lit(WORD), F.lit(0)), _term))


def _free_terms(text: Column, base: Column) -> Column:
    """The distinct terms of a text outside its values."""
    # a word that touches a value may leave a part that is no word of the text
    return F.array_intersect(_terms_of(_outside(text, base)), _terms_of(text))


def _entity(level: int, k: Column, key: Column | str) -> Column:
    key = F.lit(key) if isinstance(key, str) else key
    return F.struct(F.lit(level).alias("level"), F.concat_ws(":", k.cast("string"), key).alias("entity"))


def _group(k: Column, value: Column) -> Column:
    """Mail domain, first half of an address of a network, issuer of a card, country and area."""
    return (
        F.when(k == 0, F.substring_index(value, "@", -1))
        .when(k == 1, F.substring_index(value, ".", 2))
        .when(k == 2, F.substring(_digits(value), 1, 6))
        .otherwise(F.substring(_digits(value), 1, 4))
    )


def _entities_of(base: Column) -> Column:
    """The distinct protected entities that the values of a text stand for, on all levels."""

    def of(s: Column) -> Column:
        k, value = s["k"], ascii_lower(s["value"])
        return F.array(
            _entity(VALUE, k, value), _entity(GROUP, k, _group(k, value)), _entity(KIND, k, ""),
            _entity(ANY, F.lit(""), ""),
        )

    return F.array_distinct(F.flatten(F.transform(base, of)))


def _names_of(base: Column) -> Column:
    """(level, entity, term) of the names in the mail addresses of a text."""

    def of(s: Column) -> Column:
        value = ascii_lower(s["value"])
        words = F.regexp_extract_all(F.substring_index(value, "@", 1), F.lit(f"[a-z]{{{NAME},}}"), F.lit(0))
        entity = _entity(VALUE, s["k"], value)
        return F.transform(words, lambda w: F.struct(entity["level"], entity["entity"], w.alias("term")))

    named = F.transform(F.filter(base, lambda s: s["k"] == 0), of)
    return F.array_distinct(F.flatten(named))


def _texts(shares: Column) -> Column:
    """Distinct texts from the shares of their copies, which sum to one for each text."""
    return F.round(F.sum(shares)).cast("long").alias("texts")


def with_share(docs: DataFrame) -> DataFrame:
    """`docs` with `share`, one over the number of rows with the same text."""
    one, two = F.xxhash64("text"), F.xxhash64(F.lit(1), "text")
    keyed = docs.withColumns({"_a": one, "_b": two})
    copies = keyed.groupBy("_a", "_b").agg(F.count("*").alias("n")).where("n > 1")
    copies = settled(copies, "copies")
    return keyed.join(copies, ["_a", "_b"], "left").withColumn("share", 1 / F.coalesce("n", F.lit(1))).drop("_a", "_b", "n")


def disclosures(docs: DataFrame, found: DataFrame) -> DataFrame:
    """(level, entity, term, disclosure) of the terms that reveal an entity by GENERALISE or more.

    All counts are of distinct texts: with the entity, with the term, with both anywhere, and in all;
    copies of a text prove nothing. Counts count by what they prove: were the term dealt to texts at
    random, both would be together so often with at most exp(-with_entity * d) of probability (d the
    divergence of the shares of texts with the term, among those with the entity and among all); that,
    times all entities of the level and all terms, must not exceed the level's part of CHANCE. Entities and terms in too few texts to
    meet that bound with any partner are left out before pairs are made. Names are tested as one
    relation, by the bound on a sum of rare events. An entity that is in every text has no information
    to disclose.
    """
    entities = settled(
        found.select("share", F.explode("entities").alias("e"))
        .groupBy("e.level", "e.entity").agg(_texts(F.col("share")).alias("with_entity")),
        "with-entity",
    )
    terms = settled(
        docs.select("share", F.explode(_terms_of(F.col("text"))).alias("term"))
        .groupBy("term").agg(_texts(F.col("share")).alias("with_term")),
        "with-term",
    )
    total = settled(
        docs.agg(_texts(F.col("share")).alias("total")).crossJoin(terms.agg(F.count("*").alias("n_terms"))), "total"
    )  # one row
    spread = lambda df: df.join(F.broadcast(total))
    # each level has an equal part of CHANCE: a row per level
    proof_needed = F.log(F.lit(ANY + 1.0)) + F.log("n") + F.log("n_terms") - F.log(F.lit(CHANCE))
    levels = spread(entities.groupBy("level").agg(F.count("*").alias("n"))).select("level", proof_needed.alias("needed"))
    levels = settled(levels, "levels")

    # no pair proves more than log(total) for each text with both
    often = spread(entities.join(F.broadcast(levels), "level"))
    often = settled(often.where(F.col("with_entity") * F.log("total") >= F.col("needed")), "often")
    words = found.select("_row", "share", F.explode("terms").alias("term"))
    least = levels.agg(F.min("needed").alias("needed"))  # one row
    enough = spread(words.groupBy("term").agg(_texts(F.col("share")).alias("n"))).join(F.broadcast(least))
    enough = enough.where(F.col("n") * F.log("total") >= F.col("needed"))
    enough = settled(enough.select("term"), "candidate-terms")
    held = found.select("_row", F.explode("entities").alias("e")).select("_row", "e.level", "e.entity")
    held = held.join(often.select("level", "entity"), ["level", "entity"], "left_semi")
    held = held.groupBy("_row").agg(F.collect_list(F.struct("level", "entity")).alias("es"))  # those of one text
    pairs = (
        words.join(enough, "term", "left_semi").join(held, "_row")
        .select("share", "term", F.explode("es").alias("e"))
        .groupBy("e.level", "e.entity", "term").agg(_texts(F.col("share")).alias("together"))
    )
    counted = pairs.join(often, ["level", "entity"]).join(terms, "term")
    shared = F.log(F.col("together") * F.col("total") / (F.col("with_entity") * F.col("with_term")))
    own = F.log(F.col("total") / F.col("with_entity"))
    with_both, overall = F.col("together") / F.col("with_entity"), F.col("with_term") / F.col("total")
    without = F.when(with_both < 1, (1 - with_both) * F.log((1 - with_both) / (1 - overall))).otherwise(0.0)
    proof = F.col("with_entity") * (with_both * F.log(with_both / overall) + without)
    revealing = (F.col("level"), F.col("entity"), F.col("term"), (shared / own).alias("disclosure"))
    by_count = counted.where((own > 0) & (shared > 0) & (proof >= F.col("needed"))).select(*revealing)

    named = settled(
        found.select("share", "terms", F.explode("names").alias("n"))
        .select("n.*", "share", F.array_contains("terms", F.col("n.term")).alias("beside"))
        .groupBy("level", "entity", "term")
        .agg(F.sum("share").alias("cases"), _texts(F.when(F.col("beside"), F.col("share"))).alias("together"))
        .join(terms, "term"),
        "names",
    )
    sums = spread(named).agg(
        F.sum("together").alias("seen"), F.sum(F.col("cases") * F.col("with_term") / F.col("total")).alias("expected")
    )
    more = F.col("seen") * F.log(F.col("seen") / F.col("expected")) - (F.col("seen") - F.col("expected"))
    proven = sums.where((F.col("seen") > F.col("expected")) & (more >= -F.log(F.lit(CHANCE)))).select("seen")
    by_name = (
        spread(named.where("together > 0").join(F.broadcast(proven)))  # one row or none
        .join(entities, ["level", "entity"])
        .where((own > 0) & (shared > 0))
        .select(*revealing)
    )
    both = by_count.unionByName(by_name).where(F.col("disclosure") >= GENERALISE)
    return both.groupBy("level", "entity", "term").agg(F.max("disclosure").alias("disclosure"))


def _marked(text: Column, base: Column, terms: Column) -> Column:
    """(start, end, disclosure) of all words of a text that are in the map `terms` and outside `base`."""
    words = F.regexp_extract_all(text, F.lit(WORD), F.lit(0))
    between = F.transform(F.split(text, WORD, -1), lambda x: F.length(x))
    empty = F.struct(F.lit(0).alias("end"), F.array().cast(MARK).alias("spans"))

    def add(acc, piece):
        start = acc["end"] + piece["gap"]
        end = start + F.length(piece["word"])
        span = F.struct(start.alias("start"), end.alias("end"), piece["disclosure"].alias("disclosure"))
        spans = F.when(piece["disclosure"].isNull(), acc["spans"]).otherwise(F.array_append(acc["spans"], span))
        return F.struct(end.alias("end"), spans.alias("spans"))

    pieces = F.transform(
        F.slice(F.arrays_zip(between.alias("gap"), words.alias("word")), 1, F.size(words)),
        lambda p: F.struct(p["gap"], p["word"], F.try_element_at(terms, _term(p["word"])).alias("disclosure")),
    )
    spans = F.aggregate(pieces, empty, add, lambda acc: acc["spans"])
    inside = lambda w: F.exists(base, lambda s: (w["start"] < s["end"]) & (s["start"] < w["end"]))
    return F.filter(spans, lambda w: ~inside(w))


def find(docs: DataFrame) -> DataFrame:
    """(doc_id, _text, base, terms): spans of each row of `docs`, in code points, ends exclusive.

    `base` are the pattern matches (start, k, end, value), k the place in KINDS, by start and k; `terms`
    are all words (start, end, disclosure) of a text that disclose an entity in it, none of them inside a
    base span, by start. `_text` is a hash of the text, which with doc_id tells rows apart.

    A null or empty text has no spans. Rows without a doc_id are rows like others; rows that are equal
    get equal spans and each comes back. An empty table gives an empty one. Other columns are not read.
    """
    docs = docs.select("doc_id", F.coalesce("text", F.lit("")).alias("text"))
    shared = with_share(docs)
    base = F.col("base")
    found = shared.select(
        "doc_id", F.xxhash64("text").alias("_text"), "share", "text", pattern_spans(F.col("text")).alias("base")
    ).where(F.size("base") > 0).withColumns(
        {"entities": _entities_of(base), "names": _names_of(base), "terms": _free_terms(F.col("text"), base)}
    )
    # ids only tell the rows of this table apart, which is written once
    with_data = settled(found.withColumn("_row", F.monotonically_increasing_id()), "values")
    revealing = settled(disclosures(shared, with_data), "terms")
    words = with_data.select("_row", F.explode("terms").alias("term"))
    near = words.join(revealing.select("term").distinct(), "term", "left_semi")
    held = with_data.select("_row", "doc_id", "_text", F.explode("entities").alias("e")).select(
        "_row", "doc_id", "_text", "e.level", "e.entity"
    )
    by_term = (
        near.join(held, "_row").join(revealing, ["level", "entity", "term"])
        .groupBy("doc_id", "_text", "term").agg(F.max("disclosure").alias("disclosure"))
        .groupBy(F.col("doc_id").alias("_id"), F.col("_text").alias("_t"))
        .agg(F.map_from_entries(F.collect_list(F.struct("term", "disclosure"))).alias("by_term"))
    )
    spans = with_data.select("doc_id", "_text", "text", "base").dropDuplicates(["doc_id", "_text"])
    marked = spans.join(by_term, spans["doc_id"].eqNullSafe(by_term["_id"]) & (spans["_text"] == by_term["_t"]), "left").select(
        F.col("doc_id").alias("_id"), F.col("_text").alias("_t"), "base",
        F.when(F.col("by_term").isNotNull(), _marked(F.col("text"), F.col("base"), F.col("by_term"))).alias("terms"),
    )
    rows = docs.select("doc_id", F.xxhash64("text").alias("_text"))
    none = "array<struct<start:int,k:int,end:int,value:string>>"
    return rows.join(marked, rows["doc_id"].eqNullSafe(marked["_id"]) & (rows["_text"] == marked["_t"]), "left").select(
        "doc_id", "_text",
        F.coalesce("base", F.array().cast(none)).alias("base"),
        F.coalesce("terms", F.array().cast(MARK)).alias("terms"),
    )


def labels(base: Column, terms: Column, with_terms: bool) -> Column:
    """kind:start:end of the spans by start, then kind in the order of KINDS, terms last."""
    names = F.array(*(F.lit(k) for k in (*KINDS, TERM)))
    spans = F.transform(base, lambda s: F.struct(s["start"], s["k"], s["end"]))
    if with_terms:
        added = F.transform(terms, lambda s: F.struct(s["start"], F.lit(len(KINDS)).alias("k"), s["end"]))
        spans = F.array_sort(F.concat(spans, added))
    return F.array_join(
        F.transform(spans, lambda s: F.concat_ws(":", F.get(names, s["k"]), s["start"], s["end"])), ","
    )


def cleaned(text: Column, base: Column, terms: Column) -> Column:
    """The text with values and generalised terms as ``[KIND]`` and terms beyond REMOVE left out.

    Where spans overlap, what begins first is replaced and the rest of the other is left out.
    """
    names = F.array(*(F.lit(f"[{k.upper()}]") for k in (*KINDS, TERM)))
    spans = F.array_sort(
        F.concat(
            F.transform(base, lambda s: F.struct(s["start"], s["end"], F.get(names, s["k"]).alias("by"))),
            F.transform(
                terms,
                lambda s: F.struct(
                    s["start"], s["end"],
                    F.when(s["disclosure"] >= REMOVE, F.lit("")).otherwise(F.lit(f"[{TERM.upper()}]")).alias("by"),
                ),
            ),
        )
    )
    start = F.struct(F.lit(0).alias("end"), F.array().cast("array<string>").alias("parts"))

    def add(acc, s):
        plain = F.substring(text, acc["end"] + 1, F.greatest(s["start"] - acc["end"], F.lit(0)))
        by = F.when(s["start"] >= acc["end"], s["by"]).otherwise(F.lit(""))
        return F.struct(
            F.greatest(acc["end"], s["end"]).alias("end"), F.concat(acc["parts"], F.array(plain, by)).alias("parts")
        )

    done = F.aggregate(spans, start, add)
    return F.concat(F.array_join(done["parts"], ""), F.substring(text, done["end"] + 1, F.length(text)))


def sanitise(docs: DataFrame) -> DataFrame:
    """`docs` with `base`, `terms` (see ``find``) and `clean_text`; a null text stays null.

    Input columns with these names are replaced.
    """
    docs = docs.drop("base", "terms", "clean_text")
    found = find(docs).distinct().withColumnsRenamed({"doc_id": "_id", "_text": "_t"})
    same = docs["doc_id"].eqNullSafe(found["_id"]) & (F.xxhash64(F.coalesce(docs["text"], F.lit(""))) == found["_t"])
    return docs.join(found, same).drop("_id", "_t").withColumn(
        "clean_text", cleaned(F.col("text"), F.col("base"), F.col("terms"))
    )
