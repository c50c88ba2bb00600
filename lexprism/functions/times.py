"""Times written in mixed forms, read without a list of patterns.

A text is taken apart by its shape (ISO, three numbers, or a month by name),
and its parts are put together in the standard form. Whether the first of three
numbers is the day or the month is decided from all rows that use the same
separator.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .arrays import bind

SEPARATORS = ("/", "-", ".")
# The first three letters of the English months.
MONTHS = "jan feb mar apr may jun jul aug sep oct nov dec".split()

_CLOCK = r"(?:(?:T|,? +)(\d{1,2}):(\d{2})(?::(\d{2})(?:[.,](\d{1,9}))?)? *([AaPp]\.?[Mm]\.?)?)?"
_ZONE = r" *(Z|UTC|GMT|[+-]\d{2}:?\d{2})?"
_WEEKDAY = r"(?:[A-Za-z]{3,9},? +)?"
_NAME = r"([A-Za-z]{3,9})\.?"
# The first three groups of each shape are its date parts, the other six clock and zone.
SHAPES = {
    "year_first": rf"^(\d{{4}})[-/.](\d{{1,2}})[-/.](\d{{1,2}}){_CLOCK}{_ZONE}$",
    "compact": rf"^(\d{{4}})(\d{{2}})(\d{{2}}){_CLOCK}{_ZONE}$",
    "year_last": rf"^(\d{{1,2}})[-/.](\d{{1,2}})[-/.](\d{{4}}){_CLOCK}{_ZONE}$",
    "day_name": rf"^{_WEEKDAY}(\d{{1,2}})(?:st|nd|rd|th)?[ -]{_NAME},?[ -](\d{{4}}){_CLOCK}{_ZONE}$",
    "name_day": rf"^{_WEEKDAY}{_NAME} +(\d{{1,2}})(?:st|nd|rd|th)?,? +(\d{{4}}){_CLOCK}{_ZONE}$",
}


def _text(column: Column | str) -> Column:
    return F.trim((F.col(column) if isinstance(column, str) else column).cast("string"))


def _month(name: Column) -> Column:
    """The month's number as text; null for a word that is the beginning of no month's name."""
    place = F.array_position(F.array(*[F.lit(m) for m in MONTHS]), F.lower(F.substring(name, 1, 3)))
    return F.when(place > 0, place.cast("string"))


def day_first(df: DataFrame, column: str) -> frozenset[str]:
    """The separators between whose three numbers the first is the day, decided over all rows in one pass.

    So it is where some first number is above 12 and no second one. Otherwise
    the month comes first, and rows that this does not fit are unreadable.
    """
    text = _text(f"`{column}`")
    first, second = (F.regexp_extract(text, SHAPES["year_last"], at).try_cast("int") for at in (1, 2))
    split = F.regexp_extract(text, r"^\d{1,2}([-/.])\d{1,2}[-/.]\d{4}", 1)
    cells = [F.max(F.when(split == mark, number)).alias(f"{i}{j}") for i, mark in enumerate(SEPARATORS) for j, number in enumerate((first, second))]
    row = df.agg(*cells).first()
    return frozenset(mark for i, mark in enumerate(SEPARATORS) if (row[f"{i}0"] or 0) > 12 >= (row[f"{i}1"] or 0))


def mixed_time(column: Column | str, days_first: frozenset[str] = frozenset()) -> Column:
    """The time a text names, in whichever of the shapes it has; null for any other text.

    A text without an offset is in the session's time zone. Names of months are
    English, in full or by three letters.
    """
    text = _text(column)
    parts = "|".join(f"${at}" for at in range(1, 10))

    def taken(shape: str) -> Column:
        """The name of the shape and the nine parts of a text that has it."""
        told = F.concat(F.lit(f"{shape}|"), F.regexp_replace(text, SHAPES[shape], parts))
        return F.when(text.rlike(SHAPES[shape]), F.split(told, r"\|", -1))

    def standard(p: Column) -> Column:
        shape, first, second, third = (F.get(p, F.lit(at)) for at in range(4))
        hour, minute, second_of, fraction, half, zone = (F.nullif(F.get(p, F.lit(at)), F.lit("")) for at in range(4, 10))
        year_first = shape.isin("year_first", "compact")
        turned = F.regexp_extract(text, r"^\d{1,2}([-/.])", 1).isin(list(days_first)) if days_first else F.lit(False)
        month = F.when(year_first, second).when(shape == "day_name", _month(second)).when(shape == "name_day", _month(first))
        month = month.otherwise(F.when(turned, second).otherwise(first))
        day = F.when(year_first, third).when(shape == "day_name", first).when(shape == "name_day", second)
        day = day.otherwise(F.when(turned, first).otherwise(second))
        date = F.concat_ws("-", F.when(year_first, first).otherwise(third), F.lpad(month, 2, "0"), F.lpad(day, 2, "0"))
        clock, afternoon = hour.cast("int"), F.upper(F.substring(half, 1, 1)) == "P"
        clock = F.when(half.isNull(), clock).when(clock.between(1, 12), clock % 12 + F.when(afternoon, 12).otherwise(0))
        time = F.concat(
            F.lit(" "), F.lpad(clock.cast("string"), 2, "0"), F.lit(":"), minute, F.lit(":"), F.coalesce(second_of, F.lit("00")),
            F.lit("."), F.substring(F.coalesce(fraction, F.lit("0")), 1, 6),
        )
        zone = F.when(zone.isin("UTC", "GMT"), "Z").otherwise(F.regexp_replace(zone, r"^([+-]\d\d):?(\d\d)$", "$1:$2"))
        told = F.concat(date, F.when(hour.isNull(), F.lit(" 00:00:00")).otherwise(time), F.coalesce(zone, F.lit("")))
        return F.when(month.isNotNull(), told)

    mixed = bind(F.coalesce(*[taken(shape) for shape in SHAPES]), standard)
    return F.coalesce(F.try_to_timestamp(text), F.try_to_timestamp(mixed))
