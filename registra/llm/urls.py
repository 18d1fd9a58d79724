"""URL filtering: rules by host and path, then a weighted vocabulary.

A rule names a host with its subdomains and a path prefix; the longest rule that fits decides. A URL
without a rule is judged by its words: an Aho-Corasick automaton finds all strict and soft terms at
once, a find counts only between boundaries (no ASCII letter or digit beside it), and one strict
term or several different soft ones block the URL.
"""

from __future__ import annotations

from collections.abc import Sequence
from typing import NamedTuple

import ahocorasick
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"

# Terms that block alone, and terms that block in company
STRICT = (
    "adult", "porn", "porno", "xxx", "sex", "nsfw", "escort", "hentai", "casino", "gambling", "viagra", "cialis",
    "spam", "spam-farm", "malware", "phishing", "warez", "torrent",
)
SOFT = (
    "ads", "track", "tracking", "tracker", "click", "free", "win", "winner", "bet", "bets", "betting", "cheap", "pills", "pharmacy",
    "deal", "deals", "bonus", "loan", "loans", "crypto", "hot", "dating", "prize", "lottery", "farm", "promo", "popup",
)


class UrlRule(NamedTuple):
    host: str
    path: str
    verdict: str

    @property
    def name(self) -> str:
        return self.host + self.path


def host(url: str) -> Column:
    """Between the first ``://`` and the next ``/``, ``?``, ``#`` or the end, A-Z in lower case; else empty."""
    found = F.regexp_extract(F.col(url), r"(?s)^.*?://([^/?#]*)", 1)
    return F.coalesce(F.translate(found, UPPER, LOWER), F.lit(""))


def path(url: str) -> Column:
    """What follows the host, up to ``?``, ``#`` or the end; empty where there is no ``://``."""
    return F.coalesce(F.regexp_extract(F.col(url), r"(?s)^.*?://[^/?#]*([^?#]*)", 1), F.lit(""))


def rule(rules: Sequence[UrlRule], host_: Column, path_: Column, field: str) -> Column:
    """Name or verdict of the longest rule that fits; null where none does.

    Rules of one length are tried with the longer host first, then by name.
    """
    out = F.lit(None).cast("string")
    for r in sorted(rules, key=lambda r: (len(r.name), len(r.host), r.name)):
        fits = ((host_ == r.host) | host_.endswith("." + r.host)) & path_.startswith(r.path)
        out = F.when(fits, getattr(r, field)).otherwise(out)
    return out


def automaton(strict: Sequence[str], soft: Sequence[str]) -> ahocorasick.Automaton:
    found = ahocorasick.Automaton()
    for term in {*strict, *soft}:
        found.add_word(term, (term, term in set(strict)))
    found.make_automaton()
    return found


def _word(c: str) -> bool:
    return c.isascii() and c.isalnum()


def counts(found: ahocorasick.Automaton, url: str) -> tuple[int, int]:
    """Strict finds, and different soft terms found."""
    text = url.lower() if url.isascii() else "".join(c.lower() if c.isascii() else c for c in url)
    strict, soft = 0, set()
    for end, (term, hard) in found.iter(text):
        start = end - len(term) + 1
        if (start and _word(text[start - 1])) or (end + 1 < len(text) and _word(text[end + 1])):
            continue
        if hard:
            strict += 1
        else:
            soft.add(term)
    return strict, len(soft)


def judge(
    pages: DataFrame, rules: Sequence[UrlRule], url: str = "url", strict: Sequence[str] = STRICT, soft: Sequence[str] = SOFT, most_soft: int = 1
) -> DataFrame:
    """The rows of ``pages`` with a struct ``__url``: ``host``, ``path``, ``rule``, ``verdict``, ``n_strict``, ``n_soft``.

    More than ``most_soft`` different soft terms block. A null or empty URL has no host, no path and
    no terms, and is allowed. Rows are judged one by one; nothing is shuffled.
    """

    @F.arrow_udf("struct<n_strict: int, n_soft: int>")
    def counted(column: pa.Array) -> pa.Array:
        found = automaton(strict, soft)
        both = [counts(found, u) if u else (0, 0) for u in column.to_pylist()]
        return pa.StructArray.from_arrays(
            [pa.array([b[0] for b in both], pa.int32()), pa.array([b[1] for b in both], pa.int32())], ["n_strict", "n_soft"]
        )

    out = pages.withColumn("__n", counted(F.col(url)))
    own = F.when((F.col("__n.n_strict") >= 1) | (F.col("__n.n_soft") > most_soft), "block").otherwise("allow")
    host_, path_ = host(url), path(url)
    return out.withColumn(
        "__url",
        F.struct(
            host_.alias("host"), path_.alias("path"), rule(rules, host_, path_, "name").alias("rule"),
            F.coalesce(rule(rules, host_, path_, "verdict"), own).alias("verdict"),
            F.col("__n.n_strict").alias("n_strict"), F.col("__n.n_soft").alias("n_soft"),
        ),
    ).drop("__n")
