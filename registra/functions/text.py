"""Text expressions: normalising, shortening, labelling and formatting."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column
from pyspark.sql import functions as F

# ---- fixed values -------------------------------------------------------------------------
# All blanks a Unicode-aware strip removes, as a regex class and as characters.
BLANK = r"[\s\x1c-\x1f\x85\p{Z}]"
BLANKS = (
    "\t\n\x0b\x0c\r\x1c\x1d\x1e\x1f \x85\xa0\u1680\u2000\u2001\u2002\u2003\u2004\u2005\u2006"
    "\u2007\u2008\u2009\u200a\u2028\u2029\u202f\u205f\u3000"
)

# Quotation marks removed around an organisation label.
LABEL_QUOTES = "«»\"'“”„‟"

# Legal-form prefix of an organisation name (full label variant).
LEGAL_PREFIX = (
    r"^\s*(?:"
    r"(?:фг[абвк](?:оу|ун|бун|уп)?\s+(?:во|дпо|нпо|впо|спо|ниц)?\s*)|"
    r"(?:(?:федерал[ьн]+ое|муниципальн[оеый]+)\s+)?"
    r"государственн[оеый]+\s+"
    r"(?:(?:бюджетн[оеый]+|автономн[оеый]+|казённ[оеый]+|казенн[оеый]+)\s+)?"
    r"(?:образовательн[оеый]+\s+)?"
    r"(?:научн[оеый]+\s+)?"
    r"(?:(?:учреждение|предприятие|учебн[оеый]+\s+заведение)\s+)?"
    r"(?:высшего\s+(?:профессионального\s+)?образования\s+)?"
    r"(?:дополнительного\s+(?:профессионального\s+)?образования\s+)?"
    r")"
    r"[«\"'“„]?\s*"
)

# Phrases removed anywhere in a name, list view.
SHORT_NAME_PHRASES = (
    r"федеральное\s+государственное\s+(бюджетное|автономное|казённое|казенное)?\s*"
    r"(образовательное\s+)?учреждение\s+(высшего\s+(профессионального\s+)?образования\s+)?",
    r"государственное\s+(бюджетное|автономное|казённое|казенное)\s*"
    r"(образовательное\s+)?учреждение\s*(науки\s+)?",
    r"(?:фгбоу|фгаоу|фгку|фгуп|фгбун|фгбну)\s+(?:во|дпо|нпо|впо)?\s*",
)

# Phrases removed anywhere in a name, graph view.
NODE_LABEL_PHRASES = (
    r"федеральное\s+государственное\s+(бюджетное|автономное|казённое|казенное)?\s*"
    r"(образовательное\s+)?учреждение\s+(высшего\s+.{0,30}образования\s+)?",
    r"государственное\s+(бюджетное|автономное)\s*(образовательное\s+)?учреждение\s*",
    r"(?:фгбоу|фгаоу|фгку|фгуп|фгбун|фгбну)\s+(?:во|дпо)?\s*",
)
NAME_QUOTES = "[\"'«»]"

# Literal abbreviations, report view.
ABBREVIATIONS = (
    (
        "ФЕДЕРАЛЬНОЕ ГОСУДАРСТВЕННОЕ БЮДЖЕТНОЕ ОБРАЗОВАТЕЛЬНОЕ УЧРЕЖДЕНИЕ ВЫСШЕГО ОБРАЗОВАНИЯ",
        "ФГБОУ ВО",
    ),
    (
        "ФЕДЕРАЛЬНОЕ ГОСУДАРСТВЕННОЕ АВТОНОМНОЕ ОБРАЗОВАТЕЛЬНОЕ УЧРЕЖДЕНИЕ ВЫСШЕГО ОБРАЗОВАНИЯ",
        "ФГАОУ ВО",
    ),
)

REGISTRY_SEARCH_URL = "https://www.rosrid.ru/nioktr/search?number="
BILLION, MILLION, THOUSAND, NO_VALUE = " млрд", " млн", " тыс", "—"
ROUBLE = " ₽"
PROJECTS_WORD = " проектов"
# ---- end of fixed values ------------------------------------------------------------------

_FLAGS = "(?iuU)"  # Cyrillic case folding and Unicode blanks need both u and U


def strip(c: Column) -> Column:
    """Remove every kind of Unicode blank at both ends (SQL ``trim`` removes spaces only)."""
    return F.btrim(c, F.lit(BLANKS))


def is_blank(c: Column) -> Column:
    """True when only blanks are left. Stops at the first other character of a long text."""
    return ~c.rlike("[^" + BLANK[1:])


def stripped_equals(c: Column, tokens: Sequence[str]) -> Column:
    """True when the stripped text is one of the tokens, without copying long texts."""
    options = "|".join("\\Q" + t + "\\E" for t in tokens)
    return c.rlike(f"^{BLANK}*+(?:{options}){BLANK}*+\\z")


def norm_keyword(c: Column) -> Column:
    """Lower-cased keyword without surrounding spaces."""
    return F.lower(F.trim(c))


def tags(c: Column, n: int | None = None, pattern: str = "[;,]") -> Column:
    """First ``n`` non-empty stripped parts of a delimited string."""
    parts = F.filter(F.transform(F.split(c, pattern), strip), lambda x: x != "")
    return parts if n is None else F.slice(parts, 1, n)


def clean_org_label(c: Column) -> Column:
    """Label without legal-form prefix and quotes; kept whole when 4 or fewer characters remain."""
    quotes = "[" + LABEL_QUOTES + "]"
    bare = strip(F.regexp_replace(c, _FLAGS + LEGAL_PREFIX, ""))
    bare = strip(F.regexp_replace(bare, f"^{quotes}+|{quotes}+$", ""))
    return F.coalesce(F.when(F.length(bare) > 4, bare).otherwise(c), F.lit(""))


def _without_phrases(c: Column, phrases: tuple[str, ...]) -> Column:
    for phrase in phrases:
        c = F.regexp_replace(c, _FLAGS + phrase, "")
    c = F.regexp_replace(c, NAME_QUOTES, "")
    return strip(F.regexp_replace(c, r"(?U)\s+", " "))


def short_name(c: Column, n: int = 52) -> Column:
    """Organisation name without boilerplate, cut with an ellipsis."""
    clean = _without_phrases(F.coalesce(c, F.lit("")), SHORT_NAME_PHRASES)
    return F.when(F.length(clean) > n, F.concat(F.substring(clean, 1, n), F.lit("…"))).otherwise(
        clean
    )


def node_label(c: Column, mode: str, n: int) -> Column:
    """Graph label: boilerplate removed for institutions only, cut without an ellipsis."""
    label = F.coalesce(c, F.lit(""))
    if mode == "institutions":
        clean = _without_phrases(label, NODE_LABEL_PHRASES)
        label = F.when(clean != "", clean).otherwise(label)
    return F.substring(label, 1, n)


def shorten(c: Column, n: int = 55) -> Column:
    """Report label: two literal abbreviations, stripped, first ``n`` characters."""
    for long, short in ABBREVIATIONS:
        c = F.replace(c, F.lit(long), F.lit(short))
    return F.substring(strip(c), 1, n)


def registry_link(c: Column, base: str = REGISTRY_SEARCH_URL) -> Column:
    """Registry search link with the key percent-encoded as a URI component."""
    enc = F.replace(F.url_encode(c), F.lit("+"), F.lit("%20"))
    # form encoding also escapes these five, URI components keep them
    for code, char in (("%21", "!"), ("%27", "'"), ("%28", "("), ("%29", ")"), ("%7E", "~")):
        enc = F.replace(enc, F.lit(code), F.lit(char))
    return F.concat(F.lit(base), enc)


def _let(value: Column, body) -> Column:
    """``body`` of a value that is worked out once, however often the body uses it."""
    return F.get(F.transform(F.array(value), body), F.lit(0))


def fixed(c: Column, digits: int) -> Column:
    """Decimal text with a fixed number of digits, rounded from the exact binary value.

    Ties go away from zero. A product such as ``32.55 * 10`` can look like a tie only because it
    was rounded, so its rounding error is worked out too and decides.
    """
    scale = 10**digits

    def rounded(part: Column, high: Column) -> Column:
        def up(product: Column) -> Column:
            error = (high * scale - product) + (part - high) * scale
            below = F.floor(product)
            rest = product - below
            return below + F.when((rest > 0.5) | ((rest == 0.5) & (error >= 0)), 1).otherwise(0)

        return _let(part * scale, up)

    def units(size: Column) -> Column:
        def of_part(part: Column) -> Column:
            # the upper half of the digits, whose product with the scale is exact
            upper = _let(part * 134217729.0, lambda spread: spread - (spread - part))
            return _let(upper, lambda high: rounded(part, high))

        return F.floor(size) * scale + _let(size - F.floor(size), of_part)

    def with_point(text: Column) -> Column:
        cut = F.length(text) - digits
        return F.concat(text.substr(F.lit(1), cut), F.lit("."), text.substr(cut + 1, F.lit(digits)))

    def shown(text: Column) -> Column:
        wide = F.lpad(text, F.greatest(F.length(text), F.lit(digits + 1)), F.lit("0"))
        return _let(wide, with_point) if digits else text

    number = _let(F.abs(c.cast("double")), units).cast("string")
    return F.concat(F.when(c < 0, F.lit("-")).otherwise(F.lit("")), _let(number, shown))


def grouped(c: Column) -> Column:
    """Whole number with no-break spaces between groups of three digits."""
    return F.replace(F.format_number(F.floor(c + 0.5), 0), F.lit(","), F.lit(" "))


def format_budget(c: Column, variant: str = "list") -> Column:
    """Money as text.

    ``list`` and ``map`` take thousands of roubles and differ in the digits of millions;
    ``trend`` and ``trend_full`` take billions.
    """
    if variant in ("list", "map"):
        digits = 1 if variant == "list" else 0
        return (
            F.when(c.isNull() | (c == 0), F.lit(NO_VALUE))
            .when(c >= 1_000_000, F.concat(fixed(c / 1_000_000, 1), F.lit(BILLION + ROUBLE)))
            .when(c >= 1_000, F.concat(fixed(c / 1_000, digits), F.lit(MILLION + ROUBLE)))
            .otherwise(F.concat(grouped(c), F.lit(THOUSAND + ROUBLE)))
        )
    if variant in ("trend", "trend_full"):
        digits, unit = (1, "") if variant == "trend" else (2, ROUBLE)
        return (
            F.when(c >= 1, F.concat(fixed(c, digits), F.lit(BILLION + unit)))
            .when(c > 0, F.concat(fixed(c * 1000, 0), F.lit(MILLION + unit)))
            .otherwise(F.lit(NO_VALUE))
        )
    raise ValueError(f"unknown variant {variant!r}")


def format_count(c: Column, full: bool = False) -> Column:
    """Project counts as text: ``1.2k`` or ``1 234`` followed by the word for projects."""
    none = c.isNull() | (c == 0)
    if full:
        return F.when(none, F.lit(NO_VALUE)).otherwise(F.concat(grouped(c), F.lit(PROJECTS_WORD)))
    return (
        F.when(none, F.lit(NO_VALUE))
        .when(c >= 1000, F.concat(fixed(c / 1000, 1), F.lit("k")))
        .otherwise(c.cast("bigint").cast("string"))
    )


def prefix(c: Column, n: int) -> Column:
    """First ``n`` characters."""
    return F.substring(c, 1, n)
