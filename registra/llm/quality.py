"""Quality rules: a threshold table compiled into projections of built-in expressions.

Every rule is a row of a table: a measure, the least and the greatest value that passes. ``verdict``
turns the table into one boolean column; ``measures`` computes what the rules read. No user
function runs, and no row is shuffled. Null and empty texts have no words: all counts are zero.
"""

from __future__ import annotations

from collections.abc import Sequence
from functools import reduce
from typing import NamedTuple

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

WORD = r"[^\x20\x09-\x0D]+"
SYMBOL = r"[#*$%&|<>]"

# Common function words of English, German, French and Spanish
STOP_WORDS = (
    "the", "of", "and", "to", "in", "is", "that", "it", "was", "for", "with", "on", "as", "are", "be", "this", "by", "from",
    "der", "die", "und", "den", "das", "von", "zu", "mit", "sich", "auf", "ist", "nicht", "ein", "eine", "als", "im", "dem", "des",
    "le", "la", "les", "et", "du", "en", "un", "une", "est", "que", "qui", "dans", "par", "pour", "au", "sur", "pas", "avec",
    "el", "los", "las", "de", "y", "del", "se", "por", "con", "para", "no", "su", "al", "lo", "como", "una",
)


class Rule(NamedTuple):
    """A measure must lie between ``least`` and ``most``; None: no bound."""

    measure: str
    least: float | None = None
    most: float | None = None


RULES = (
    Rule("n_words", 10, 1_000_000),
    Rule("mean_word_length", 2.0, 14.0),
    Rule("symbol_ratio", None, 0.15),
    Rule("exclamation_ratio", None, 0.30),
    Rule("n_stop_words", 2, None),
    Rule("duplicate_line_ratio", None, 0.50),
    Rule("bullet_line_ratio", None, 0.90),
    Rule("ellipsis_line_ratio", None, 0.30),
    Rule("repeat_word_ratio", None, 0.20),
)


def measures(docs: DataFrame, text: str = "text", window: int = 5) -> DataFrame:
    """The rows of ``docs`` with a struct ``__m`` of counts and ratios of the text.

    ``n_words``, ``word_chars`` (code points in words), ``n_symbols``, ``n_dup_lines`` (lines with a
    word that equal an earlier line), ``n_repeat_words`` (words in windows of ``window`` words found
    twice or more in the text), and the ratios of the rules. Windows are told apart by 64-bit hashes
    within one text. Sorting happens only for texts that repeat a window.
    """
    value = F.coalesce(F.col(text), F.lit(""))
    lines = F.filter(F.split(value, "\n", -1), lambda line: line.rlike(r"[^\x20\x09-\x0D]"))
    out = docs.select(
        "*",
        F.regexp_extract_all(value, F.lit(f"({WORD})"), F.lit(1)).alias("__words"),
        lines.alias("__lines"),
    )
    n = F.size("__words")
    grams = F.when(
        n >= window,
        F.transform(
            F.sequence(F.lit(0), n - window),
            lambda i: F.xxhash64(*[F.get("__words", i + j) for j in range(window)]),
        ),
    )
    out = out.withColumn("__grams", grams)
    twice = F.size(F.array_distinct("__grams")) < F.size("__grams")
    ordered = F.when(twice, F.sort_array(F.transform("__grams", lambda h, i: F.struct(h.alias("h"), i.alias("i")))))
    out = out.withColumn("__ordered", ordered)
    same = F.filter(
        "__ordered",
        lambda x, i: (F.get("__ordered", i - 1)["h"] == x["h"]) | (F.get("__ordered", i + 1)["h"] == x["h"]),
    )
    out = out.withColumn("__places", F.sort_array(F.transform(same, lambda x: x["i"])))
    reach = F.transform("__places", lambda p, i: F.least(F.coalesce(F.get("__places", i + 1) - p, F.lit(window)), F.lit(window)))
    repeat = F.coalesce(F.aggregate(reach, F.lit(0), lambda a, b: a + b), F.lit(0)).cast("bigint")
    stops = F.array(*[F.lit(w) for s in STOP_WORDS for w in (s, s.capitalize())])

    def share(pattern: str) -> Column:
        return F.size(F.filter("__lines", lambda line: line.rlike(pattern)))

    counts = F.struct(
        n.cast("bigint").alias("n_words"),
        F.length(F.regexp_replace(value, r"[\x20\x09-\x0D]+", "")).cast("bigint").alias("word_chars"),
        F.regexp_count(value, F.lit(SYMBOL)).cast("bigint").alias("n_symbols"),
        (F.size("__lines") - F.size(F.array_distinct("__lines"))).cast("bigint").alias("n_dup_lines"),
        repeat.alias("n_repeat_words"),
        F.size(F.array_intersect("__words", stops)).cast("bigint").alias("n_stop_words"),
        F.regexp_count(value, F.lit("!")).cast("bigint").alias("n_exclamations"),
        F.size("__lines").cast("bigint").alias("n_lines"),
        share(r"^\s*[-*•]\s").cast("bigint").alias("n_bullets"),
        share(r"(\.\.\.|…)\s*$").cast("bigint").alias("n_ellipses"),
    )
    out = out.withColumn("__c", counts)

    def ratio(a: str, b: str) -> Column:
        return F.coalesce(F.try_divide(F.col(f"__c.{a}"), F.col(f"__c.{b}")), F.lit(0.0))

    ratios = (
        ratio("word_chars", "n_words").alias("mean_word_length"),
        ratio("n_symbols", "n_words").alias("symbol_ratio"),
        ratio("n_exclamations", "n_words").alias("exclamation_ratio"),
        ratio("n_dup_lines", "n_lines").alias("duplicate_line_ratio"),
        ratio("n_bullets", "n_lines").alias("bullet_line_ratio"),
        ratio("n_ellipses", "n_lines").alias("ellipsis_line_ratio"),
        ratio("n_repeat_words", "n_words").alias("repeat_word_ratio"),
    )
    plain = [F.col(f"__c.{c}").alias(c) for c in ("n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "n_stop_words", "n_lines")]
    return out.withColumn("__m", F.struct(*plain, *ratios)).drop("__words", "__lines", "__grams", "__ordered", "__places", "__c")


def verdict(rules: Sequence[Rule] = RULES, measured: str = "__m") -> Column:
    """True where every rule of the table passes."""
    tests = []
    for rule in rules:
        value = F.col(f"{measured}.{rule.measure}")
        if rule.least is not None:
            tests.append(value >= F.lit(rule.least))
        if rule.most is not None:
            tests.append(value <= F.lit(rule.most))
    return reduce(lambda a, b: a & b, tests, F.lit(True))
