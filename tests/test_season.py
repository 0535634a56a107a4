import datetime as dt
import math

import pytest
from pyspark.sql import functions as F

from staygauge.operators import season
from staygauge.sources import tables


@pytest.fixture(scope="module")
def prices(spark):
    """Three cities: a full leap year with 11 prices a day, one with a day short of it, one without the anchor day."""
    days = [(dt.date(2024, 1, 1) + dt.timedelta(d)).isoformat() for d in range(366)]
    rows = []
    for n, day in enumerate(days):
        full = 10 if day == "2024-03-01" else 11
        rows += [("Full_City", day, f"${1000 + n % 50:,}.00")] * 11 + [("Full_City", day, "n/a")]
        rows += [("gaps", day, "$5.00")] * (full if day not in ("2024-05-05",) else 3)
        if day != "2024-09-25":
            rows += [("no_anchor", day, f"${n + 1}.00")] * 11
    return spark.createDataFrame(rows, "city string, date string, adjusted_price string")


def test_season_index(spark, prices):
    got = season.season_index(prices, relative_error=0.0).toPandas()
    assert sorted(got.city.unique()) == ["full city", "no anchor"]  # 364 kept days are too few
    full = got[got.city == "full city"].set_index("date")
    assert len(full) == 366 and "02-29" in full.index
    anchor = 1000 + (dt.date(2024, 9, 25) - dt.date(2024, 1, 1)).days % 50
    assert full.price_relative["01-02"] == pytest.approx(math.log1p(1001) - math.log1p(anchor))
    assert got[got.city == "no anchor"].price_relative.isna().all()
    assert set(got.stoplight) == {"green", "yellow", "orange", "red"}


def test_adjustment_uses_normal_city_and_day(spark):
    index = spark.createDataFrame([("london", "12-25", 0.5, "red")], "city string, date string, price_relative double, stoplight string")
    asked = spark.createDataFrame([("Greater London, UK", "2026-12-25"), ("London", "12-25"), ("Paris", "2026-12-25"), (None, None)], "c string, d string")
    got = season.season_adjustment(asked, index, F.col("c"), F.col("d"), "adj").orderBy("c", "d").collect()
    assert [(r.c, r.adj) for r in got] == [(None, 0.0), ("Greater London, UK", 0.5), ("London", 0.5), ("Paris", 0.0)]


def test_calendar_expansion_defaults_to_green(spark):
    lookup = spark.createDataFrame([("rome", "02-28", "airbnb-day-red", 0.1)], "location string, date string, color string, price_relative double")
    places = spark.createDataFrame([("rome",), (None,)], "location string")
    got = season.expand_calendar(lookup, places, F.to_date(F.lit("2026-02-27")), days=730).collect()
    assert len(got) == 1460
    red = sorted(r.date for r in got if r.color == "airbnb-day-red")
    assert red == ["2026-02-28", "2027-02-28"] and all(r.color == "airbnb-day-green" for r in got if r.location is None)


def test_upsert_and_required_columns(spark, tmp_path):
    columns = "location string, date string, color string, price_relative double"
    old = spark.createDataFrame([("a", "01-01", "g", 0.0), ("b", "01-01", "g", 0.0)], columns)
    new = spark.createDataFrame([("a", "01-01", "r", 1.0)], columns)
    assert sorted(map(tuple, tables.upsert_season_lookup(old, new).collect())) == [("a", "01-01", "r", 1.0), ("b", "01-01", "g", 0.0)]
    old.write.parquet(str(tmp_path / "bad"))
    with pytest.raises(ValueError, match="city"):
        tables.read_season_index(spark, str(tmp_path / "bad"))


def test_readers_of_the_lookup_see_whole_versions(spark, tmp_path, monkeypatch):
    path = str(tmp_path / "lookup")
    rows = lambda df: sorted(map(tuple, df.collect()))
    schema = "location string, date string, color string, price_relative double"
    with pytest.raises(ValueError):
        tables.read_season_lookup(spark, path)
    old = [(place, f"01-0{day}", "g", 0.0) for place in ("a", "b", "c") for day in (1, 2)]
    tables.write_season_lookup(spark.createDataFrame(old, schema), path)
    begun = tables.read_season_lookup(spark, path)  # a reader that begins before the upsert
    during = []
    new = [("b", "01-02", "r", 1.0), ("d", "01-01", "r", 2.0)]
    merged = [r for r in old if r[:2] != ("b", "01-02")] + new
    real_write = tables.upsert_season_lookup

    def reads_meanwhile(current, incoming):
        during.append(rows(tables.read_season_lookup(spark, path)))
        return real_write(current, incoming)

    monkeypatch.setattr(tables, "upsert_season_lookup", reads_meanwhile)
    assert tables.write_season_lookup(spark.createDataFrame(new, schema), path) == 1
    # A version whose files are there but that is not published yet does not count.
    spark.createDataFrame([("a", "x", "y", 9.0)], schema).write.partitionBy("location").parquet(f"{path}/parts/2")
    spark.createDataFrame([("a", 2)], "location string, part long").write.parquet(f"{path}/manifests/3")
    assert during == [sorted(old)] and rows(begun) == sorted(old) and rows(tables.read_season_lookup(spark, path)) == sorted(merged)


def test_many_upserts_are_rewritten_as_one(spark, tmp_path):
    path = str(tmp_path / "lookup")
    schema = "location string, date string, color string, price_relative double"
    for k in range(tables.MAX_PARTS + 3):
        tables.write_season_lookup(spark.createDataFrame([(f"p{k}", "01-01", "g", float(k))], schema), path)
    found = tables.read_season_lookup(spark, path)
    assert sorted(r.price_relative for r in found.collect()) == [float(k) for k in range(tables.MAX_PARTS + 3)]
    parts = tables._manifest(spark, path, tables.MAX_PARTS + 2).select("part").distinct().count()
    assert parts <= tables.MAX_PARTS
