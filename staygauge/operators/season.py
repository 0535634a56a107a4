"""Season index: how far a day's price lies from the city's usual price, and its colour."""

from __future__ import annotations

from pyspark.ml.feature import QuantileDiscretizer
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from staygauge import fixed_values as fixed
from staygauge.functions.money import day_class, season_colour
from staygauge.functions.text import city_key, month_day, month_day_of, normal_city, price_number
from staygauge.session import settle


def daily_prices(calendar: DataFrame, min_prices_exclusive: int = fixed.SEASON_MIN_PRICES_EXCLUSIVE) -> DataFrame:
    """Mean log price and number of prices by city and day of year, for days with enough prices.

    The only pass over the raw calendar: three columns are read, and each task sends at most 366 rows per city to the
    shuffle, so a city with a third of all rows costs no more there than any other.
    """
    return (
        calendar.select(
            price_number(F.col("adjusted_price")).alias("amount"),
            city_key(F.col("city")).alias("city"),
            month_day(F.col("date")).alias("date"),
        )
        .filter("amount IS NOT NULL")
        .groupBy("city", "date")
        .agg(F.avg(F.log1p("amount")).alias("price"), F.count(F.lit(1)).alias("prices"))
        .filter(F.col("prices") > min_prices_exclusive)
    )


def relative_prices(
    daily: DataFrame, anchor_day: str = fixed.SEASON_ANCHOR_DAY, min_days: int = fixed.SEASON_MIN_DAYS
) -> DataFrame:
    """Price relative to the anchor day and z-score within the city, for cities that cover the year.

    One window serves all four expressions; a city has at most 366 rows here.
    """
    city = Window.partitionBy("city")
    return (
        daily.select(
            "city",
            "date",
            (F.col("price") - F.avg(F.when(F.col("date") == anchor_day, F.col("price"))).over(city)).alias("price_relative"),
            F.try_divide(F.col("price") - F.avg("price").over(city), F.stddev_samp("price").over(city)).alias("z_score"),
            F.count(F.lit(1)).over(city).alias("days"),
        )
        .filter(F.col("days") >= min_days)
        .drop("days")
    )


def season_colours(scored: DataFrame, relative_error: float = 0.001) -> DataFrame:
    """Colour by quarter of the z-scores of all cities; rows without a z-score are left out."""
    if scored.filter("z_score IS NOT NULL").isEmpty():  # nothing to take quantiles of
        return scored.select("city", "date", "price_relative", F.lit(None).cast("string").alias("stoplight")).limit(0)
    buckets = QuantileDiscretizer(
        numBuckets=len(fixed.SEASON_COLOURS), inputCol="z_score", outputCol="bucket",
        relativeError=relative_error, handleInvalid="skip",
    )
    coloured = buckets.fit(scored).transform(scored)
    return coloured.select("city", "date", "price_relative", season_colour(F.col("bucket")).alias("stoplight"))


def season_index(
    calendar: DataFrame,
    anchor_day: str = fixed.SEASON_ANCHOR_DAY,
    min_prices_exclusive: int = fixed.SEASON_MIN_PRICES_EXCLUSIVE,
    min_days: int = fixed.SEASON_MIN_DAYS,
    relative_error: float = 0.001,
) -> DataFrame:
    """Raw calendar (adjusted_price, city, date) to (city, date, price_relative, stoplight).

    The per-day table is settled first, so that finding the quantiles does not read the raw calendar a second time.
    """
    scored = relative_prices(daily_prices(calendar, min_prices_exclusive), anchor_day, min_days)
    return season_colours(settle(scored, "season"), relative_error)


def season_lookup(index: DataFrame, prefix: str = fixed.DAY_CLASS_PREFIX) -> DataFrame:
    """Season index as (location, date, color, price_relative), the form the calendar view looks up."""
    return index.select(
        F.col("city").alias("location"), "date", day_class(F.col("stoplight"), prefix).alias("color"), "price_relative"
    )


def season_adjustment(
    requests: DataFrame, index: DataFrame, city: Column, date: Column, name: str = "calendar_adjustment_log"
) -> DataFrame:
    """Add the log-price adjustment for each row's city and date; 0 where the index has none.

    The index has at most 366 rows per city and one row per key, so the join neither multiplies nor skews; whether it
    is broadcast is left to the planner, which sees its size.
    """
    by_key = (
        index.groupBy(F.trim(F.lower("city")).alias("season_city"), F.col("date").alias("season_day"))
        .agg(F.max("price_relative").alias("season_relative"))
    )
    keyed = requests.withColumns({"season_city": normal_city(city), "season_day": month_day_of(date)})
    return keyed.join(by_key, ["season_city", "season_day"], "left").select(
        *requests.columns, F.coalesce("season_relative", F.lit(0.0)).alias(name)
    )


def expand_calendar(
    lookup: DataFrame,
    places: DataFrame,
    start: Column,
    days: int = fixed.CALENDAR_SPAN_DAYS,
    prefix: str = fixed.DAY_CLASS_PREFIX,
) -> DataFrame:
    """Colour class of each of ``days`` consecutive dates for each place (column ``location``, NULL if unmatched).

    A place or day that the lookup does not know is green.
    """
    dates = F.explode(F.sequence(start, F.date_add(start, days - 1)))
    wanted = places.select("*", dates.alias("day")).withColumn("date", F.date_format("day", "MM-dd"))
    return wanted.join(lookup.select("location", "date", "color"), ["location", "date"], "left").select(
        *places.columns,
        F.date_format("day", "yyyy-MM-dd").alias("date"),
        F.coalesce("color", F.lit(f"{prefix}{fixed.SEASON_COLOURS[0]}")).alias("color"),
    )
