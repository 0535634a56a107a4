import pytest
from pyspark.sql import functions as F

from staygauge.functions import geo, money, text


def values(spark, rows, schema, *columns):
    return [tuple(r) for r in spark.createDataFrame(rows, schema).select(*columns).collect()]


def test_parse_number_and_clean_text(spark):
    rows = [("$1,234.50",), ("1.670,00",), ("n/a",), ("-",), ("1.2.3",), (None,)]
    got = values(spark, rows, "t string", text.parse_number(F.col("t")))
    assert [g[0] for g in got] == [1234.5, 1.67, None, None, None, None]
    got = values(spark, [("  a   b\n",), ("   ",), (None,)], "t string", text.clean_text(F.col("t")))
    assert [g[0] for g in got] == ["a b", None, None]


def test_calendar_keys(spark):
    got = values(spark, [("greater_London", "$1,234.00", "2024-02-29"), ("x", "free", "2023-02-29")], "c string, p string, d string",
                 text.city_key(F.col("c")), text.price_number(F.col("p")), text.month_day(F.col("d")))
    assert got == [("greater london", 1234.0, "02-29"), ("x", None, None)]


@pytest.mark.parametrize("city, normal", [
    ("Greater London, United Kingdom", "london"), (" Austin, TX, USA ", "austin"), ("New York, NY", "new york"),
    ("Paris, France", "paris, france"), ("Broward County", "broward county"), ("X, USA, UK", "x"), ("", "")])
def test_normal_city(spark, city, normal):
    assert values(spark, [(city,)], "c string", text.normal_city(F.col("c"))) == [(normal,)]


def test_month_day_of(spark):
    got = values(spark, [("2026-12-25",), ("04-13",), ("2026-12-25T10:00",), ("soon",), (None,)], "d string", text.month_day_of(F.col("d")))
    assert [g[0] for g in got] == ["12-25", "04-13", "12-25", None, None]


def test_currency(spark):
    got = values(spark, [(100.0, " eur "), (100.0, "UNKNOWN"), (None, "EUR"), (100.0, None)], "a double, c string",
                 F.round(money.to_usd(F.col("a"), F.col("c")), 6), F.round(money.from_usd(F.col("a"), F.col("c")), 6))
    assert got == [(117.04, 85.440875), (None, None), (None, None), (None, None)]
    got = values(spark, [("₪",), (" CA$ ",), ("฿",), ("  ",), (None,)], "s string", money.currency_of_symbol(F.col("s")))
    assert [g[0] for g in got] == ["ILS", "CAD", "฿", None, None]


def test_labels(spark):
    got = values(spark, [(10.0,), (10.1,), (-10.0,), (-10.1,)], "p double", money.deal_label(F.col("p")), money.season_label(F.col("p")),
                 money.deal_text(F.lit(-12.345), F.col("p")))
    assert got == [("neutral", "NORMAL", "FAIR PRICE"), ("good", "PEAK", "GOOD DEAL ($12.35 below expected)"),
                   ("neutral", "NORMAL", "FAIR PRICE"), ("bad", "LOW", "OVERPRICED ($12.35 more than expected)")]
    assert values(spark, [(5.0, 0.0)], "d double, l double", money.percent_over_listed(F.col("d"), F.col("l"))) == [(0.0,)]


def test_haversine(spark):
    rows = [(51.5074, -0.1278, 48.8566, 2.3522), (0.0, 0.0, 0.0, 180.0), (90.0, 0.0, 90.0, 77.0)]
    got = values(spark, rows, "a double, b double, c double, d double", F.round(geo.haversine_km(F.col("a"), F.col("b"), F.col("c"), F.col("d")), 2))
    assert [g[0] for g in got] == [343.56, 20015.09, 0.0]


def test_first_filled_skips_zero_but_keeps_it_as_last_resort(spark):
    rows = [(0.0, 3.0), (None, 0.0), (0.0, None), (None, None)]
    got = values(spark, rows, "a double, b double", text.first_filled(F.col("a"), F.col("b")))
    assert [g[0] for g in got] == [3.0, 0.0, 0.0, None]
