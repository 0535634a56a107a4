"""Column functions on prices: currency, comparison with the listed price, labels."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from staygauge import fixed_values as fixed


def text_map(entries: dict) -> Column:
    return F.create_map(*[F.lit(x) for pair in entries.items() for x in pair])


def usd_rate(currency: Column, rates: dict[str, float] | None = None) -> Column:
    """Dollars per unit; NULL for an unknown or missing currency. The rate table is a small literal, so no join."""
    return F.try_element_at(text_map(rates or fixed.USD_RATES), F.trim(F.upper(currency)))


def to_usd(amount: Column, currency: Column, rates: dict[str, float] | None = None) -> Column:
    return amount.cast("double") * usd_rate(currency, rates)


def from_usd(amount: Column, currency: Column, rates: dict[str, float] | None = None) -> Column:
    return F.try_divide(amount.cast("double"), usd_rate(currency, rates))


def currency_of_symbol(symbol: Column) -> Column:
    """Code of a currency symbol; an unknown symbol stands for itself, a blank one is NULL."""
    bare = F.nullif(F.trim(symbol), F.lit(""))
    return F.coalesce(F.try_element_at(text_map(fixed.CURRENCY_OF_SYMBOL), bare), bare)


def percent_over_listed(difference: Column, listed: Column) -> Column:
    return F.when(listed > 0, F.try_divide(difference, listed) * 100).otherwise(F.lit(0.0))


def deal_label(percent: Column) -> Column:
    margin = fixed.DEAL_MARGIN_PERCENT
    return F.when(percent > margin, "good").when(percent < -margin, "bad").otherwise("neutral")


def deal_text(difference_usd: Column, percent: Column) -> Column:
    amount = F.format_string("%.2f", F.abs(difference_usd))
    margin = fixed.DEAL_MARGIN_PERCENT
    return (
        F.when(percent > margin, F.concat(F.lit("GOOD DEAL ($"), amount, F.lit(" below expected)")))
        .when(percent < -margin, F.concat(F.lit("OVERPRICED ($"), amount, F.lit(" more than expected)")))
        .otherwise("FAIR PRICE")
    )


def season_label(adjustment_usd: Column) -> Column:
    margin = fixed.SEASON_MARGIN_USD
    return F.when(adjustment_usd > margin, "PEAK").when(adjustment_usd < -margin, "LOW").otherwise("NORMAL")


def season_colour(bucket: Column) -> Column:
    """Colour of a quantile bucket 0..3, NULL for a row without a bucket."""
    names = F.array(*[F.lit(c) for c in fixed.SEASON_COLOURS])
    return F.get(names, bucket.cast("int"))


def day_class(colour: Column, prefix: str = fixed.DAY_CLASS_PREFIX) -> Column:
    return F.concat(F.lit(prefix), colour)
