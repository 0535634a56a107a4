"""Typed places to coloured calendars."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame

from staygauge import fixed_values as fixed
from staygauge.operators.matching import match_places
from staygauge.operators.season import expand_calendar


def place_calendar(
    inputs: DataFrame, lookup: DataFrame, start: Column, column: str = "place", days: int = fixed.CALENDAR_SPAN_DAYS,
) -> DataFrame:
    """Every input row for each of ``days`` dates, with the matched location and the day's colour class.

    ``lookup``: (location, date, color). A place that no location matches, a missing one too, is green on all days.
    """
    matched = match_places(inputs, lookup.select("location"), column).drop("score")
    return expand_calendar(lookup, matched, start, days)
