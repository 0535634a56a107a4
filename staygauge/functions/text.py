"""Column functions on text: cleaning, numbers, city and day keys."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column
from pyspark.sql import functions as F

from staygauge import fixed_values as fixed

# (?U) gives \s, \d, \w and \b their Unicode meaning: page text is full of no-break spaces.
UNICODE = "(?U)"


def once(value: Column, use) -> Column:
    """``use(value)`` with ``value`` computed once, however often ``use`` mentions it, also inside its own lambdas."""
    return F.get(F.transform(F.array(value), use), F.lit(0))


def blank_to_null(text: Column) -> Column:
    return F.nullif(text, F.lit(""))


def clean_text(text: Column) -> Column:
    """Blanks collapsed to one space and trimmed; empty becomes NULL."""
    return blank_to_null(F.trim(F.regexp_replace(text, UNICODE + r"\s+", " ")))


def parse_number(text: Column) -> Column:
    """Number left after dropping everything but digits, dot and minus; NULL if that is no number."""
    return F.regexp_replace(text, r"[^0-9.-]", "").try_cast("double")  # as empty text is none


def price_number(text: Column) -> Column:
    """``$1,234.00`` to 1234.0; text that is no price becomes NULL."""
    return F.translate(text, "$,", "").try_cast("double")


def first_group(text: Column, pattern: str, group: int = 1, flags: str = "(?iU)") -> Column:
    """Captured group of the first match, NULL without a match."""
    return blank_to_null(F.regexp_extract(text, flags + pattern, group))


def only_references(html: Column, names: tuple[str, ...]) -> Column:
    """HTML in which these character references count, with their semicolon; any other stays the text it is written as."""
    return F.regexp_replace(html, rf"&(?!(?:{'|'.join(names)});)", "&amp;")


def city_key(city: Column) -> Column:
    return F.lower(F.translate(city, "_", " "))


def month_day(date_text: Column) -> Column:
    """``yyyy-MM-dd`` to ``MM-dd``; NULL if it is no date."""
    return F.date_format(F.try_to_date(date_text, "yyyy-MM-dd"), "MM-dd")


def month_day_of(date_text: Column) -> Column:
    """``MM-dd`` part of an ISO date by position, or the text itself if it already has that form."""
    iso = (F.length(date_text) >= 10) & (F.substring(date_text, 5, 1) == "-") & (F.substring(date_text, 8, 1) == "-")
    short = (F.length(date_text) == 5) & (F.substring(date_text, 3, 1) == "-")
    return F.when(iso, F.substring(date_text, 6, 5)).when(short, date_text)


def normal_city(city: Column, suffixes: list[str] | None = None, prefix: str = fixed.CITY_PREFIX) -> Column:
    """City name as the season index spells it: lower case, without country suffixes and the leading prefix.

    Suffixes come off in list order, each at most once, as later ones may appear only after an earlier one is gone.
    """
    suffixes = fixed.CITY_SUFFIXES if suffixes is None else suffixes
    name = F.trim(F.lower(city))
    bare = reduce(lambda text, suffix: F.trim(F.regexp_replace(text, rf"\Q{suffix}\E$", "")), suffixes, name)
    return F.trim(F.regexp_replace(bare, rf"^\Q{prefix}\E", ""))


def part_before_comma(text: Column) -> Column:
    return F.substring_index(text, ",", 1)


def log_length(text: Column, empty_marks: tuple[str, ...] = ()) -> Column:
    """log(1 + number of characters); NULL and the given marks count as empty."""
    filled = F.coalesce(text, F.lit(""))
    if empty_marks:
        filled = F.when(filled.isin(*empty_marks), "").otherwise(filled)
    return F.log1p(F.length(filled).cast("double"))


def first_filled(*candidates: Column, kind: str = "number") -> Column:
    """First candidate that is neither NULL nor empty (0, empty text, empty array).

    A field that only ever had empty values keeps the first of them instead of turning NULL.
    """
    def filled(value: Column) -> Column:
        if kind == "number":
            return F.nullif(value, F.lit(0.0))
        if kind == "text":
            return blank_to_null(value)
        return F.when(F.size(value) > 0, value)

    return F.coalesce(*[filled(c) for c in candidates], *candidates)
