"""Text expressions: normalised search terms, labels, lists and addresses."""

from __future__ import annotations

from functools import lru_cache

from pyspark.sql import Column, SparkSession
from pyspark.sql import functions as F

#: What trimming removes at both ends (tab, line and form feeds, all kinds of spaces, the byte-order mark).
EDGE_SPACE = "[\\x{9}-\\x{d}\\x{20}\\x{a0}\\x{1680}\\x{2000}-\\x{200a}\\x{2028}\\x{2029}\\x{202f}\\x{205f}\\x{3000}\\x{feff}]"
#: Separators of rendered lists.
SEPARATORS = {"en": ", ", "zhHans": "、", "page": "; ", "panel": " / "}


@lru_cache(maxsize=1)
def diacritics() -> str:
    """A regular-expression class of all characters of the Unicode property Diacritic, as the JVM's Unicode library has it."""
    found = SparkSession.getActiveSession()._jvm.com.ibm.icu.text.UnicodeSet("[:Diacritic:]")
    ranges = [(found.getRangeStart(i), found.getRangeEnd(i)) for i in range(found.getRangeCount())]
    return "[" + "".join(f"\\x{{{a:x}}}-\\x{{{b:x}}}" for a, b in ranges) + "]"


def strip_js(text: Column) -> Column:
    """Without white space at both ends, of every Unicode kind."""
    return F.regexp_replace(text, f"^{EDGE_SPACE}+|{EDGE_SPACE}+$", "")


def normalize_term(text: Column) -> Column:
    """Compatibility decomposition, no diacritics, lower case, then trimmed; null stays null.

    ASCII text decomposes to itself and has two diacritics only. Other text is rid of its most frequent marks by a class of
    one range first; the class of all others is tried on characters beyond ASCII alone.
    """
    ascii_ = F.length(text) == F.octet_length(text)
    decomposed = F.when(text.isNotNull(), F.reflect(F.lit("com.ibm.icu.text.Normalizer"), F.lit("decompose"), text, F.lit(True)))
    other = F.regexp_replace(decomposed, f"[\\x{{300}}-\\x{{34e}}^`]|(?![\\x{{0}}-\\x{{7f}}]){diacritics()}", "")
    return strip_js(F.lower(F.when(ascii_, F.translate(text, "^`", "")).otherwise(other)))


def search_text(*parts: Column) -> Column:
    """The normalised space-joined text of labels, alias arrays, slug and id, in that order; nulls are left out."""
    return normalize_term(F.concat_ws(" ", *parts))


def href(slug: Column) -> Column:
    return F.concat(F.lit("/flavor/"), slug)


def ordinal_label(position: Column) -> Column:
    """Position from 0 as a number from 1 with at least two digits."""
    n = (position + 1).cast("string")
    return F.when(F.length(n) < 2, F.lpad(n, 2, "0")).otherwise(n)


def to_fixed(x: Column, digits: int = 1) -> Column:
    """Fixed decimals by the number's exact binary value, halves away from zero."""
    size, a = 10**digits, F.abs(x)
    low = F.floor(a * size)
    # the sign of a - (low + 1/2) / size without rounding: both halves of a's digits times a small integer are exact
    c = a * 134217729.0
    high = c - (c - a)
    over = (high * (2 * size) - (low * 2 + 1)) + (a - high) * (2 * size)
    n = low + F.when(over >= 0, 1).otherwise(0)
    text = F.concat(F.floor(n / size).cast("string"), F.concat(F.lit("."), F.lpad((n % size).cast("string"), digits, "0")) if digits else F.lit(""))
    return F.when(x.isNotNull(), F.concat(F.when((x < 0) & (n > 0), F.lit("-")).otherwise(F.lit("")), text))


def decode(labels: dict[str, str], key: Column) -> Column:
    """The label of a key; null for an unknown one."""
    pairs = [F.lit(x) for kv in labels.items() for x in kv]
    return F.create_map(*pairs)[key]


def join_list(values: Column, style: str = "en") -> Column:
    return F.array_join(values, SEPARATORS[style])


def first_present(*values: Column) -> Column:
    return F.coalesce(*values)


def caption(asset: Column, with_asset: Column, without: Column) -> Column:
    return F.when(asset.isNotNull(), with_asset).otherwise(without)


def upper_label(text: Column) -> Column:
    return F.upper(text)


def bilingual(zh: Column, en: Column) -> Column:
    return F.concat(zh, F.lit(" / "), en)


def comma_list(text: Column, most: int = 2) -> Column:
    """The first entries of a comma-separated list, trimmed, without empty ones."""
    return F.slice(F.filter(F.transform(F.split(F.coalesce(text, F.lit("")), ","), strip_js), lambda x: x != ""), 1, most)


def query_parameter(url: Column, name: str, default: str = "") -> Column:
    """A parameter of a URL's query string, decoded; the default if absent."""
    raw = F.regexp_extract(url, rf"[?&]{name}=([^&#]*)", 1)
    return F.when(url.rlike(rf"[?&]{name}="), F.url_decode(raw)).otherwise(F.lit(default))


def is_home(path: Column) -> Column:
    """Whether a path is the front page, which has a theme of its own."""
    return path == "/"


def trailing_slash(path: Column) -> Column:
    """Page paths get a slash at their end, before the query string; other paths stay."""
    return F.regexp_replace(path, r"^(/flavor/[^/?]+|/atlas|/methodology)(\?.*)?$", "$1/$2")
