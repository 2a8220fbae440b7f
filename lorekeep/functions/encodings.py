"""Percent, query, anchor and dot encodings; base-36 hashes; HTML entities."""

from __future__ import annotations

import html
from collections.abc import Callable
from functools import reduce
from operator import add

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql import types as T

_WHITESPACE = " \t\n\r\x0b\x0c"


def _escape(text: Column, keep: str, mark: str, space: str | None = None) -> Column:
    """Replace each character outside the class ``keep`` by its UTF-8 bytes in hex."""

    def one(char: Column) -> Column:
        octets = F.regexp_replace(F.hex(F.encode(char, "UTF-8")), "(..)", mark + "$1")
        out = F.when(char.rlike(keep), char)
        if space is not None:
            out = out.when(char == " ", F.lit(space))
        return out.otherwise(octets)

    # most texts need no escaping at all; they skip the per-character work
    escaped = F.array_join(F.transform(F.split(text, ""), one), "")
    return F.when(text.rlike(f"^{keep}*$"), text).otherwise(escaped)


def url_encode(text: Column) -> Column:
    """Path style: everything but letters, digits and ``-_.~``."""
    return _escape(text, "[A-Za-z0-9_.~-]", "%")


def query_encode(text: Column) -> Column:
    """Query style: like the path style, a space becomes ``+``."""
    return _escape(text, "[A-Za-z0-9_.-]", "%", space="+")


def _decode(text: Column) -> Column:
    # a percent sign without two hex digits stands for itself
    return F.try_url_decode(F.regexp_replace(text, "%(?![0-9A-Fa-f]{2})", "%25"))


def url_decode(text: Column) -> Column:
    """Inverse of :func:`url_encode`; NULL when the octets are not UTF-8."""
    return _decode(F.replace(text, F.lit("+"), F.lit("%2B")))


def query_decode(text: Column) -> Column:
    return _decode(text)


def anchor_text(text: Column) -> Column:
    """Underscores to spaces, trimmed, runs of spaces squashed, leading colons dropped."""
    out = F.regexp_replace(F.replace(text, F.lit("_"), F.lit(" ")), r"^\s+|\s+$", "")
    return F.regexp_replace(F.regexp_replace(out, " +", " "), "^:+", "")


def dot_encode(text: Column) -> Column:
    """Section anchor in the legacy format."""
    return _escape(anchor_text(text), "[A-Za-z0-9_.:-]", ".", space="_")


def anchor_encode(text: Column, legacy: bool = False) -> Column:
    """Section anchor in the html5 format, or the legacy one on request."""
    if legacy:
        return dot_encode(text)
    prepared = F.regexp_replace(anchor_text(text), "%([a-fA-F0-9]{2})", "%25$1")

    def one(char: Column) -> Column:
        octets = F.regexp_replace(F.hex(F.encode(char, "UTF-8")), "(..)", "%$1")
        return (
            F.when(char.isin(list(_WHITESPACE)), F.lit("_"))
            .when(char.rlike(r"[\[\]|\p{Z}\p{C}]"), octets)
            .otherwise(char)
        )

    encoded = F.array_join(F.transform(F.split(prepared, ""), one), "")
    return F.when(prepared.rlike(r"^[^\[\]|\p{Z}\p{C}]*$"), prepared).otherwise(encoded)


# 160 bits are ten limbs of 16 bits, or six groups of six base-36 digits; all steps fit 64 bits
_LIMBS, _GROUPS, _GROUP = 10, 6, 36**6


def _let(value: Column, use: Callable[[Column], Column]) -> Column:
    """``use`` of a value that is worked out once."""
    return F.element_at(F.transform(F.array(value), use), 1)


def _recoded(parts: Column, base: int, n: int, other: int, m: int) -> Column:
    """The last ``m`` digits in base ``other`` of a number of ``n`` digits in ``base``, both highest first.

    The places of one base are constants in the other: each new digit is one sum, and the carries go up once.
    """

    def sums(part: Column) -> Column:
        places = [[base**i // other**j % other for i in range(n)] for j in range(m)]
        return F.array(*[reduce(add, [part[n - 1 - i] * F.lit(x).cast("long") for i, x in enumerate(row)]) for row in places])

    def carried(total: Column) -> Column:
        out, value = [], None
        for j in range(m):
            value = total[j] if value is None else total[j] + F.floor(value / other)
            out.append(value % other)
        return F.array(*reversed(out))

    return _let(_let(parts, sums), carried)


def sha1_to_base36(digest: Column | str) -> Column:
    """Hex digest to the 31-digit base-36 storage form; NULL for no digest. Worked out in the JVM."""
    digest = F.col(digest) if isinstance(digest, str) else digest
    padded = F.lpad(digest, 4 * _LIMBS, "0")
    limbs = F.transform(
        F.sequence(F.lit(0), F.lit(_LIMBS - 1)), lambda i: F.conv(F.substring(padded, i * 4 + 1, F.lit(4)), 16, 10).cast("long")
    )
    groups = _recoded(limbs, 65536, _LIMBS, _GROUP, _GROUPS)
    digits = F.transform(groups, lambda x: F.lpad(F.lower(F.conv(x.cast("string"), 10, 36)), 6, "0"))
    return F.when(F.length(digest) > 0, F.right(F.array_join(digits, ""), F.lit(31)))


def sha1_from_base36(stored: Column | str) -> Column:
    """31-digit base-36 storage form to the 40-digit hex digest; NULL for none."""
    stored = F.col(stored) if isinstance(stored, str) else stored
    padded = F.lpad(stored, 6 * _GROUPS, "0")
    groups = F.transform(
        F.sequence(F.lit(0), F.lit(_GROUPS - 1)), lambda i: F.conv(F.substring(padded, i * 6 + 1, F.lit(6)), 36, 10).cast("long")
    )
    limbs = _recoded(groups, _GROUP, _GROUPS, 65536, _LIMBS)
    digits = F.array_join(F.transform(limbs, lambda x: F.lower(F.lpad(F.hex(x), 4, "0"))), "")
    return F.when(F.length(stored) > 0, digits)


@F.pandas_udf(T.StringType())
def unescape_entities(text: pd.Series) -> pd.Series:
    """HTML entities to characters; call it on text that contains an ``&``."""
    return text.map(html.unescape, na_action="ignore")


@F.pandas_udf(T.ArrayType(T.StringType()))
def unescape_each(texts: pd.Series) -> pd.Series:
    """HTML entities to characters in arrays of short texts, such as headings."""
    return texts.map(lambda items: None if items is None else [html.unescape(x) for x in items])
