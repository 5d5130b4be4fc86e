"""Quality rules with a distribution test, in DataFrame functions only.

Base measures of each whole text (words, symbols, repeated lines and word
windows) decide ``base_failed``. The method compares two histograms of the
document with references of its language by the Jensen-Shannon distance (base
2, 0 to 1): character classes, and the common words below. References are the
sums over all documents of each language in ``COMMON_WORDS``; a document of
another or unknown language is held against the nearest reference.
Minimum-length guards: fewer than MIN_CHARS word characters or MIN_WORDS words
leave that test out. The word test rejects a document that is far from its own
reference, from all others and from the even mixtures of two, so that prose in
two languages or under a wrong language stays. The lists say nothing about a
stated language that has no reference: there it is left out.

Defined results: null or empty text has no words and fails the base rule;
without any reference nothing is rejected by the method; repeated rows are
judged alike; texts of any length are read whole; extra columns are ignored, and
``keep_good`` carries them along whatever their names.
"""

from __future__ import annotations

import math
from collections.abc import Callable
from itertools import combinations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tallyweir.llm._common import Scratch, if_few, stage, unused

Column = F.Column
Field = Callable[[str], Column]

#: Frequent words by language; fixed lists.
COMMON_WORDS = {
    "de": "der die und in den von zu das mit sich des auf für ist im dem nicht ein eine als".split(),
    "en": "the of and to in that is was for it with as his on be at by had are from".split(),
    "es": "de la que el en y a los se del las un por con no una su para es al".split(),
    "fr": "de la le et les des en un du une que est pour qui dans par plus pas au sur".split(),
}
VOCABULARY = sorted({w for words in COMMON_WORDS.values() for w in words})

WHITE = " \t\n\x0b\x0c\r"
_WHITE_RE = r"[\x20\x09-\x0D]+"
CLASSES = {"lower": r"\p{Ll}", "upper": r"\p{Lu}", "digit": r"\p{Nd}", "mark": r"\p{P}\p{S}"}


def let(value: Column, body: Callable[[Column], Column]) -> Column:
    """``body`` with ``value`` evaluated once; a column named in a lambda would be evaluated at each step."""
    return F.transform(F.array(value), body)[0]


def words_of(text: Column) -> Column:
    """The words of a text as an array."""
    return let(F.btrim(text, F.lit(WHITE)), lambda t: F.when(t == "", F.expr("cast(array() as array<string>)")).otherwise(F.split(t, _WHITE_RE)))


def _kept_chars(text: Column, pattern: str) -> Column:
    return F.length(F.regexp_replace(text, f"[^{pattern}]+", ""))


def _repeat_words(words: Column) -> Column:
    """How many words lie in a 3-word window that the text holds twice or more."""

    def covered(hashes: Column) -> Column:
        pairs = F.sort_array(F.transform(hashes, lambda h, i: F.struct(h.alias("h"), i.alias("i"))))

        def inside(s: Column) -> Column:
            again = F.filter(s, lambda x, j: F.coalesce(x["h"] == F.get(s, j - 1)["h"], F.lit(False)) | F.coalesce(x["h"] == F.get(s, j + 1)["h"], F.lit(False)))
            return F.size(F.array_distinct(F.flatten(F.transform(again, lambda x: F.array(x["i"], x["i"] + 1, x["i"] + 2)))))

        return F.when(F.size(F.array_distinct(hashes)) == F.size(hashes), 0).otherwise(let(pairs, inside))

    hashes = F.transform(F.sequence(F.lit(0), F.size(words) - 3), lambda i: F.xxhash64(words[i], words[i + 1], words[i + 2]))
    return F.when(F.size(words) < 3, 0).otherwise(let(hashes, covered)).cast("long")


def _histograms(t: Column) -> list[Column]:
    """Character-class counts, and counts of the common words that occur (their place in VOCABULARY, and n)."""
    listed = "|".join(sorted(VOCABULARY, key=lambda w: (-len(w), w)))
    common = F.regexp_extract_all(F.lower(t), F.lit(rf"(?<![^\x20\x09-\x0D])({listed})(?=[\x20\x09-\x0D.,]|$)"), F.lit(1))
    vocabulary = F.array(*[F.lit(w) for w in VOCABULARY])
    counted = let(common, lambda a: F.transform(F.array_distinct(a), lambda w: F.struct((F.array_position(vocabulary, w) - 1).cast("int").alias("i"), (F.size(a) - F.size(F.array_remove(a, w))).alias("n"))))
    return [F.length(F.regexp_replace(t, _WHITE_RE, "")).cast("long").alias("word_chars"), *[_kept_chars(t, p).cast("long").alias(f"c_{c}") for c, p in CLASSES.items()], counted.alias("common")]


def measured(text: Column) -> Column:
    """All measures of a text as one struct, each evaluated once."""

    def body(t: Column) -> Column:
        lines = F.filter(F.split(t, "\n"), lambda x: F.btrim(x, F.lit(WHITE)) != "")
        dup = let(lines, lambda a: F.size(a) - F.size(F.array_distinct(a))).cast("long")
        by_words = let(words_of(t), lambda w: F.struct(F.size(w).cast("long").alias("n"), _repeat_words(w).alias("r")))
        return let(by_words, lambda w: F.struct(w["n"].alias("n_words"), w["r"].alias("n_repeat_words"), _kept_chars(t, "#*$%&|<>").cast("long").alias("n_symbols"), dup.alias("n_dup_lines"), *_histograms(t)))

    return let(F.coalesce(text, F.lit("")), body)


def measures(docs: DataFrame) -> DataFrame:
    """Base measures and both histograms of every document: one narrow row each, no exchange."""
    return docs.select("doc_id", "lang", measured(F.col("text")).alias("m")).select("doc_id", "lang", "m.*")


def references(histograms: DataFrame) -> dict[str, tuple[list[float], list[float]]]:
    """Class shares and common-word shares (the last: all other words) by language, over all documents.

    What reaches the driver is bounded by the fixed word lists.
    """
    own = histograms.where(F.col("lang").isin(*COMMON_WORDS) & (F.col("n_words") > 0))
    sums = own.groupBy("lang").agg(F.sum("n_words").alias("n_words"), F.sum("word_chars").alias("chars"), *[F.sum(f"c_{c}").alias(f"c_{c}") for c in CLASSES]).collect()
    hits = own.select("lang", F.explode("common").alias("x")).groupBy("lang", "x.i").agg(F.sum("x.n").alias("n")).collect()
    out = {}
    for row in sums:
        shares = [row[f"c_{c}"] / row["chars"] for c in CLASSES]
        words = [0.0] * len(VOCABULARY)
        for hit in hits:
            if hit["lang"] == row["lang"]:
                words[hit["i"]] = hit["n"] / row["n_words"]
        out[row["lang"]] = ([*shares, max(0.0, 1 - sum(shares))], [*words, max(0.0, 1 - sum(words))])
    return out


def _part(p: Column, q: Column) -> Column:
    """p log2(2 p / (p + q)) / 2, and 0 at p = 0."""
    return F.when(p > 0, 0.5 * p * F.log2(2 * p / (p + q))).otherwise(0.0)


def _distance(divergence: Column) -> Column:
    return F.sqrt(F.greatest(F.lit(0.0), F.least(F.lit(1.0), divergence)))


def class_distance(m: Field, shares: list[float]) -> Column:
    chars = F.greatest(m("word_chars"), F.lit(1)).cast("double")
    own = [m(f"c_{c}") / chars for c in CLASSES]
    own.append(F.greatest(F.lit(0.0), 1 - sum(own[1:], own[0])))
    terms = [_part(p, F.lit(q)) + _part(F.lit(q), p) for p, q in zip(own, shares, strict=True)]
    return _distance(sum(terms[1:], terms[0]))


def word_distance(m: Field, shares: list[float] | Column) -> Column:
    """Sums over the document's own words; a common word it lacks adds half its reference share."""
    table = shares if isinstance(shares, Column) else F.array(*[F.lit(q) for q in shares])
    rest = (m("n_words") - F.aggregate(m("common"), F.lit(0), lambda a, x: a + x["n"])).cast("int")
    found = F.concat(m("common"), F.array(F.struct(F.lit(len(VOCABULARY)).alias("i"), rest.alias("n"))))

    def term(x: Column) -> Column:
        share = F.greatest(x["n"], F.lit(0)) / F.greatest(m("n_words"), F.lit(1)).cast("double")
        return let(F.struct(share.alias("p"), F.get(table, x["i"]).alias("q")), lambda y: _part(y["p"], y["q"]) + _part(y["q"], y["p"]) - 0.5 * y["q"])

    return _distance(F.aggregate(found, F.lit(0.5), lambda a, x: a + term(x)))


def mixed_distance(m: Field, refs: dict[str, tuple[list[float], list[float]]]) -> Column:
    """The word distance to the nearest of all references and of the even mixtures of two."""
    words = [found[1] for _, found in sorted(refs.items())]
    tables = words + [[(p + q) / 2 for p, q in zip(a, b, strict=True)] for a, b in combinations(words, 2)]
    return F.array_min(F.transform(F.array(*[F.array(*[F.lit(q) for q in t]) for t in tables]), lambda t: word_distance(m, t)))


#: Jensen-Shannon distances above which a document is rejected, and the lengths from which each test applies.
#: A text without any listed word is about 0.37 away from its reference, prose of MIN_WORDS words about 0.2.
CLASS_LIMIT, WORD_LIMIT, MIN_CHARS, MIN_WORDS = 0.25, 0.265, 200, 100


def _verdict(m: Field, lang: Column, refs: dict[str, tuple[list[float], list[float]]]) -> dict[str, Column]:
    def nearest(make: Callable[[Field, list[float]], Column], which: int) -> Column:
        if not refs:
            return F.lit(0.0)
        made = {name: make(m, found[which]) for name, found in sorted(refs.items())}
        out = F.least(*made.values()) if len(made) > 1 else next(iter(made.values()))
        for name, column in made.items():
            out = F.when(lang == name, column).otherwise(out)
        return out

    failed = (m("n_words") < 50) | (100 * m("n_repeat_words") > 50 * m("n_words"))
    return {"base_failed": failed, "class_distance": nearest(class_distance, 0), "word_distance": nearest(word_distance, 1)}


def _odd(m: Field, lang: Column, refs: dict[str, tuple[list[float], list[float]]], classes: Column, words: Column) -> Column:
    odd = (m("word_chars") >= MIN_CHARS) & (classes > CLASS_LIMIT)
    if not refs:
        return odd
    listed = lang.isNull() | lang.isin(*refs)
    return odd | (listed & (m("n_words") >= MIN_WORDS) & (words > WORD_LIMIT) & (mixed_distance(m, refs) > WORD_LIMIT))


def passes_base(text: Column) -> Column:
    """Whether a text has 50 words or more, at most half of them in 3-word windows that repeat."""
    return let(words_of(F.coalesce(text, F.lit(""))), lambda w: (F.size(w) >= 50) & (100 * _repeat_words(w) <= 50 * F.size(w)))


def judge(docs: DataFrame) -> DataFrame:
    """One row per document: base measures, both distances, ``base_failed`` and ``kept``."""
    found = stage(measures(docs), "quality")
    refs = references(found)
    columns = _verdict(F.col, F.col("lang"), refs)
    base = ["doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words"]
    odd = _odd(F.col, F.col("lang"), refs, columns["class_distance"], columns["word_distance"])
    return found.select(*base, columns["base_failed"].alias("base_failed"), (~columns["base_failed"] & ~odd).alias("kept"), *[columns[k].alias(k) for k in ("class_distance", "word_distance")])


def keep_good(docs: DataFrame) -> DataFrame:
    """``docs`` without the documents that the base rules or the method reject.

    Every text is measured once. Verdicts depend on text and language alone, so
    the rejected ones are known by a 128-bit fingerprint of both; they are sent
    to all executors if a count shows that they are few, else joined by a shuffle.
    """
    # a hash passes over nulls, so it is told where they are
    prints = [F.xxhash64(F.lit(seed), F.col("text").isNull(), "text", "lang") for seed in (1, 2)]
    with Scratch(docs.sparkSession, "quality") as scratch:
        found = scratch.stage(docs.select(prints[0].alias("t1"), prints[1].alias("t2"), "lang", measured(F.col("text")).alias("m")).select("t1", "t2", "lang", "m.*"), "measures")
        refs = references(found)
        made = _verdict(F.col, F.col("lang"), refs)
        odd = _odd(F.col, F.col("lang"), refs, made["class_distance"], made["word_distance"])
        out = stage(found.where(made["base_failed"] | odd).select("t1", "t2").distinct(), "rejected")
    names = unused(docs, "t1", "t2")
    marked = docs.withColumn(names[0], prints[0]).withColumn(names[1], prints[1])
    return marked.join(if_few(out.toDF(*names)), names, "left_anti").select(*docs.columns)
