"""Column expressions that clean raw source values without raising."""

from __future__ import annotations

from collections.abc import Mapping

from pyspark.sql import Column
from pyspark.sql import functions as F

# The characters that are white space, and what counts as a number
# written as text.
_WHITE_SPACE = (
    " \t\n\v\f\r\x1c\x1d\x1e\x1f\x85\xa0\u1680"
    "\u2000\u2001\u2002\u2003\u2004\u2005\u2006\u2007\u2008\u2009\u200a"
    "\u2028\u2029\u202f\u205f\u3000"
)
_NUMBER_TEXT = r"^\s*[+-]?(\d+\.?\d*|\.\d+)([eE][+-]?\d+)?\s*$"


def strip_rest(text: Column) -> Column:
    """Remove every kind of white space from both ends of a text without blanks
    there. The trim by a set is costly and only done where an end may need it.

    The text is used several times: pass a column, not an expression.
    """
    first, last = F.substring(text, 1, 1), F.substring(text, -1, 1)
    stripped = F.trim(text, F.lit(_WHITE_SPACE))
    return F.when(_may_be_space(first) | _may_be_space(last), stripped).otherwise(text)


def _may_be_space(char: Column) -> Column:
    """False only for a character that is no white space."""
    return (
        (char <= " ")
        | char.between("\x85", "\xa0")
        | (char == "\u1680")
        | char.between("\u2000", "\u205f")
        | (char == "\u3000")
    )


def count_from_number(col: Column) -> Column:
    """A count that is never negative: NULL and NaN give 0, fractions are cut off.

    A number too large for a bigint gives NULL, for the contract to reject. The
    input appears once: a filter on the result is pushed to the scan as a whole.
    """
    zero = F.lit(0.0)
    number = F.nanvl(F.coalesce(col.cast("double"), zero), zero)
    return F.greatest(number, zero).try_cast("bigint")


def count_from_text(col: Column) -> Column:
    """``count_from_number`` of a text; what is not a number counts as 0."""
    return count_from_number(F.regexp_substr(col, F.lit(_NUMBER_TEXT)).try_cast("double"))


def count_from_integer(col: Column) -> Column:
    zero = F.lit(0).cast("bigint")
    return F.greatest(F.coalesce(col.cast("bigint"), zero), zero)


def timestamp(col: Column) -> Column:
    """A zone-less timestamp, NULL where the value is none."""
    return col.try_cast("timestamp_ntz")


def minutes(col: Column) -> Column:
    return F.make_dt_interval(F.lit(0), F.lit(0), col.cast("int"))


def offset_minutes(store: Column, offsets: Mapping[int, int]) -> Column:
    """The clock offset of a store, 0 for a store without one.

    The table comes from a settings file, so it is part of the expression: the rows
    stay where they are, whatever the number of stores in it.
    """
    table = F.lit(None).cast("map<bigint,int>")
    if offsets:
        ids, late = (F.lit(list(values)) for values in zip(*sorted(offsets.items()), strict=True))
        table = F.map_from_arrays(ids.cast("array<bigint>"), late.cast("array<int>"))
    return F.coalesce(table[store.try_cast("bigint")], F.lit(0))
