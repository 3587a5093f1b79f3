"""Column expressions: numbers, texts and times."""

from __future__ import annotations

from itertools import chain

from pyspark.sql import Column
from pyspark.sql import functions as F

from clinprep import config


def rint(c: Column, digits: int) -> Column:
    """Round half to even on the scaled double."""
    scale = F.lit(float(10**digits))
    return F.rint(c * scale) / scale


def strip(c: Column) -> Column:
    """Without any white space at both ends (trim knows spaces only). Texts that begin and end with a printed ASCII character stay, unsearched."""
    printed = lambda at: F.substring(c, at, 1).between("!", "~")
    return F.when(printed(1) & printed(-1), c).otherwise(F.regexp_replace(c, r"^\s+|\s+$", ""))


def to_double(c: Column) -> Column:
    """The number a text spells, null if it spells none."""
    return F.nullif(c, F.lit("")).try_cast("double")


def numeric_view(c: Column) -> Column:
    """P5: the first signed number found anywhere in a text."""
    return to_double(F.regexp_extract(c.cast("string"), r"(-?\d+(?:\.\d+)?)", 1))


def magnitude(c: Column) -> Column:
    """The number of a measurement; the whole cell must be a number and at most a unit."""
    return to_double(F.regexp_extract(c.cast("string"), config.MEASUREMENT, 1))


def unit(c: Column) -> Column:
    """The lower-cased unit, empty for a bare number or no measurement."""
    return F.coalesce(F.lower(F.regexp_extract(c.cast("string"), config.MEASUREMENT, 2)), F.lit(""))


def spelling(c: Column) -> Column:
    """Name of the first datetime spelling a text begins with."""
    out = F.lit(config.UNRECOGNISED)
    for name, pattern in reversed(config.SPELLINGS):
        out = F.when(c.rlike(pattern), F.lit(name)).otherwise(out)
    return F.when(c.isNotNull(), out)


MONTHS = "jan feb mar apr may jun jul aug sep oct nov dec".split()
#: By spelling: the whole text, and where year, month, day, hour and minute begin in it.
PARTS = [
    (r"^\d{4}-\d{2}-\d{2} \d{2}:\d{2}$", (1, 6, 9, 12, 15)),
    (r"^\d{4}/\d{2}/\d{2} \d{2}:\d{2}$", (1, 6, 9, 12, 15)),
    (r"^\d{2}/\d{2}/\d{4} \d{2}:\d{2}$", (7, 4, 1, 12, 15)),
    (r"^[A-Za-z]{3} \d{2} \d{4} \d{2}:\d{2}$", (8, 1, 5, 13, 16)),
]
#: Further forms for texts that match no spelling, day first.
FALLBACKS = ["dd-MM-yyyy HH:mm", "dd.MM.yyyy HH:mm", "d MMM yyyy HH:mm", "yyyy-MM-dd", "dd/MM/yyyy"]


def parse_datetime(c: Column, fallbacks: list[str] | None = None) -> Column:
    """A text's instant by its surface form, free of any time zone.

    The first spelling that a stripped text begins with decides; the rest of the text must then fit it
    too, or the result is null. Only texts of no known spelling go through the fallbacks.
    """
    return parse_stripped(strip(c), fallbacks)


def parse_stripped(text: Column, fallbacks: list[str] | None = None) -> Column:
    """parse_datetime of a text without white space at its ends. The parts of a whole text stand at fixed places, so it is searched once."""
    out = F.lit(None).cast("timestamp_ntz")
    for form in reversed(FALLBACKS if fallbacks is None else fallbacks):
        out = F.coalesce(F.try_to_timestamp(text, F.lit(form)).cast("timestamp_ntz"), out)
    begun = text.rlike("|".join(begins for _, begins in config.SPELLINGS))
    out = F.when(begun, F.lit(None).cast("timestamp_ntz")).otherwise(out)
    number = lambda at, n=2: F.substring(text, at, n).try_cast("int")
    for (_, begins), (whole, (y, m, d, h, minute)) in reversed(list(zip(config.SPELLINGS, PARTS, strict=True))):
        month = F.array_position(F.array(*[F.lit(n) for n in MONTHS]), F.lower(F.substring(text, m, 3))).cast("int") if begins.startswith("^[A-Z") else number(m)
        made = F.try_make_timestamp_ntz(number(y, 4), month, number(d), number(h), number(minute), F.lit(0).cast("decimal(16,6)"))
        out = F.when(text.rlike(whole), made).otherwise(out)
    return out


def floor_hour(c: Column) -> Column:
    return F.date_trunc("hour", c).cast("timestamp_ntz")


def hours_between(start: Column, end: Column) -> Column:
    return F.timestamp_diff("SECOND", start, end).cast("double") / 3600.0


def literal_map(entries: dict[str, str]) -> Column:
    return F.create_map(*[F.lit(x) for x in chain.from_iterable(entries.items())])
