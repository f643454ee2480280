"""Column functions for the marketplace's texts, prices, dates and input masks."""

from __future__ import annotations

import sys
import unicodedata

from pyspark.sql import Column
from pyspark.sql import functions as F

# Every decimal digit outside ASCII, as the site's number parser accepts them all.
_DIGITS = [c for c in map(chr, range(128, sys.maxunicode + 1)) if unicodedata.category(c) == "Nd"]
_ASCII = "".join(str(unicodedata.digit(c)) for c in _DIGITS)


def ascii_digits(c: Column) -> Column:
    """Decimal digits of any script (such as full-width ones) to ASCII digits."""
    return F.translate(c, "".join(_DIGITS), _ASCII)


def parse_price(c: Column, kind: str = "decimal(12,2)") -> Column:
    """``'¥ 1,234'`` to 1234.00; null when it is not a number."""
    return ascii_digits(F.regexp_replace(c, "[¥,]", "")).try_cast(kind)


# Year of four digits, month and day of one or two; a one-digit day may follow a space.
_BIRTHDAY = r"\A(?!0000)[0-9]{4}/(1[0-2]|0[1-9]|[1-9])/(3[01]|[12][0-9]|0[1-9]| ?[1-9])\z"


def parse_birthday(c: Column) -> Column:
    """``'2024/1/5'`` to a date; null when it is no real day in that form."""
    text = ascii_digits(c)
    return F.when(F.regexp_like(text, F.lit(_BIRTHDAY)), F.try_to_date(F.replace(text, F.lit(" ")), "yyyy/M/d"))


def whole_yen(c: Column) -> Column:
    """A price as shown: the integer part."""
    return c.cast("bigint")


def padded_id(n: Column) -> Column:
    """1 to ``'00001'``; longer numbers keep all their digits."""
    return F.format_string("%05d", n)


def same_id(left: Column, right: int | Column) -> Column:
    """Compare a stored id with a number as the site does: ``'00001'`` equals 1; other text never does."""
    return left.try_cast("bigint") == (F.lit(right) if isinstance(right, int) else right)


def file_extension(c: Column) -> Column:
    """The part after the last dot in lower case; the whole name when there is no dot."""
    return F.lower(F.element_at(F.split(c, r"\."), -1))


def split_list(c: Column) -> Column:
    """A comma-joined list to an array; an empty or missing one gives an empty array."""
    return F.when(F.coalesce(c, F.lit("")) == "", F.array().cast("array<string>")).otherwise(F.split(c, ","))


def count_filled(items: Column) -> Column:
    """Number of entries that are not blank."""
    return F.size(F.filter(items, lambda x: F.trim(x) != ""))


def japanese_time(c: Column) -> Column:
    return F.date_format(c, "yyyy年MM月dd日 HH:mm:ss")


def line_breaks(c: Column) -> Column:
    return F.regexp_replace(c, "\n", "<br>")


def public_path(c: Column) -> Column:
    """A stored icon path without the ``./static/`` prefix."""
    return F.replace(c, F.lit("./static/"), F.lit(""))


def digits_only(c: Column) -> Column:
    return F.regexp_replace(c, "[^0-9]", "")


def postal_mask(c: Column) -> Column:
    """At most seven digits, a hyphen after the third when more follow."""
    d = F.substring(digits_only(c), 1, 7)
    return F.when(F.length(d) > 3, F.concat(F.substring(d, 1, 3), F.lit("-"), F.substring(d, 4, 4))).otherwise(d)


def date_mask(c: Column) -> Column:
    """At most eight digits with slashes after the fourth and sixth when more follow."""
    d = F.substring(digits_only(c), 1, 8)
    year, month, day = F.substring(d, 1, 4), F.substring(d, 5, 2), F.substring(d, 7, 2)
    return (
        F.when(F.length(d) > 6, F.concat_ws("/", year, month, day))
        .when(F.length(d) > 4, F.concat_ws("/", year, month))
        .otherwise(d)
    )


def price_mask(c: Column) -> Column:
    """The first seven digits as a grouped yen amount, ``'¥ 1,234'``; empty when there is no digit."""
    d = F.substring(digits_only(c), 1, 7)
    return F.when(d == "", "").otherwise(F.concat(F.lit("¥ "), F.format_number(d.try_cast("bigint"), 0)))
