"""What counts as missing, and how identifiers are compared.

A value is missing if it is null or a stand-in: a blank, a filler word, an impossible number, date or id.
"""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# Words that sources write where they have no value (compared in lower case, without outer blanks).
FILLERS = (
    "", "-", "--", "?", ".", "n/a", "na", "n.a.", "nan", "nil", "none", "none given", "not given", "not known",
    "not specified", "not stated", "null", "tbd", "unk", "unknown", "unspecified", "missing", "x", "xx", "xxx",
)

#: The same list as SQL text.
FILLERS_SQL = "(" + ", ".join(f"'{word}'" for word in FILLERS) + ")"

#: Dates outside this range are epoch or end-of-time stand-ins (1899-12-30, 1970-01-01, 2099-12-31, 9999-12-31 ...).
FIRST_DATE, LAST_DATE = "1970-01-02", "2099-12-30"

#: Numbers that stand for a missing value where negative ones are possible.
NO_SCORE = (-1.0, -9.0, -99.0, -999.0, -9999.0)


def code(column: Column) -> Column:
    """Ids, codes and labels: letter case and outer blanks never make them different."""
    return F.upper(F.trim(column))


def text_value(column: Column) -> Column:
    """Trimmed text, or null for a filler."""
    return F.when(~F.lower(F.trim(column)).isin(*FILLERS), F.trim(column))


def date_value(column: Column) -> Column:
    """The date, or null for a stand-in date."""
    return F.when(column.between(F.lit(FIRST_DATE).cast("date"), F.lit(LAST_DATE).cast("date")), column)


def count_value(column: Column) -> Column:
    """A count, or null where it is NaN or negative (an impossible number)."""
    as_double = column.cast("double")
    return F.when(~F.isnan(as_double) & (as_double >= 0), column)


def score_value(column: Column) -> Column:
    """A score, which may be negative, or null where it is NaN or one of the numbers written for a missing one."""
    as_double = column.cast("double")
    return F.when(~F.isnan(as_double) & ~as_double.isin(*NO_SCORE), column)


def id_value(column: Column) -> Column:
    """An id in comparable form, or null: fillers, placeholders without a digit and a bare zero are stand-ins."""
    plain = code(column)
    return F.when(plain.rlike("[0-9]") & ~plain.rlike("^0+$") & ~F.lower(plain).isin(*FILLERS), plain)


def group_value(column: Column) -> Column:
    """A group id of an earlier run in comparable form, or null; a number part of zeros alone (CE-00000000) is a stand-in
    here, while a record's own id may be numbered zero."""
    plain = id_value(column)
    return F.when(~plain.rlike("^[^0-9]*0+$"), plain)


def coordinates(latitude: Column, longitude: Column) -> tuple[Column, Column]:
    """The pair, or nulls: both must be present and possible, and (0, 0) is a stand-in."""
    good = (
        latitude.isNotNull() & longitude.isNotNull() & ~F.isnan(latitude) & ~F.isnan(longitude)
        & (F.abs(latitude) <= 90) & (F.abs(longitude) <= 180) & ~((latitude == 0) & (longitude == 0))
    )
    return F.when(good, latitude), F.when(good, longitude)
