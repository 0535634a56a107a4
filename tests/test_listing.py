import math

import pytest
from pyspark.sql import functions as F

from staygauge.operators import listing


@pytest.mark.filterwarnings("ignore")
def test_columns_are_selected_renamed_and_missing_ones_reported(spark):
    df = spark.createDataFrame([("a", "t", 1)], "name string, is_supperhost string, other int")
    with pytest.warns(UserWarning, match="hosts_year"):
        assert listing.select_listing_columns(df).columns == ["name", "is_superhost"]
    with pytest.raises(ValueError):
        listing.select_listing_columns(df.select("other"))


def test_bad_values_become_null(spark):
    df = spark.createDataFrame([("null", "12.5", "maybe", '["2 beds"]', '{"num_of_nights": "x", "taxes": "5"}')],
                               "price string, lat string, is_superhost string, details string, pricing_details string")
    row = listing.enforce_listing_types(df).first()
    assert (row.price, row.lat, row.is_superhost, row.details) == (None, 12.5, None, ["2 beds"])
    assert (row.pricing_details.num_of_nights, row.pricing_details.taxes) == (None, "5")


@pytest.mark.parametrize("details, name, beds, bedrooms, baths", [
    (["2 beds", "1.5 baths"], None, 2.0, 0.0, 1.5), (["shared 1 bath"], "x", 0.0, 0.0, 0.0), (["Shared 1.5 baths"], "x", 0.0, 0.0, 0.0),
    ([], "Loft with 3 BEDROOMS and 1 bathroom", 0.0, 3.0, 1.0), (None, None, 0.0, 0.0, 0.0), (["1 bed", "2 bedrooms", "2.5 bathrooms"], "9 beds", 1.0, 2.0, 2.5)])
def test_room_counts(spark, details, name, beds, bedrooms, baths):
    df = spark.createDataFrame([(details, name)], "details array<string>, name string")
    row = listing.with_room_counts(df).first()
    assert (row.num_beds, row.num_bedrooms, row.num_baths) == (beds, bedrooms, baths)


@pytest.mark.parametrize("text, count", [
    ('[{"group_name":"A","items":[{"name":"x"},{"name":"y"}]},{"group_name":"Not included","items":[{"name":"z"}]}]', 2),
    ('[{"group_name":null,"items":[{"name":"x"}]},{"group_name":"B","items":null},{"group_name":"C","items":[{"name":"q"}]}]', 1),
    ("broken", 0), (None, 0), ("[]", 0)])
def test_amenities(spark, text, count):
    df = spark.createDataFrame([(text,)], "a string")
    assert df.select(listing.amenity_count(F.col("a"))).first()[0] == count


def test_price_rules(spark):
    rows = [(100.0, (29.0, None)), (100.0, (30.0, None)), (100.0, (None, 5.0)), (100.0, None), (0.0, (2.0, None)), (-1.0, (2.0, 50.0)), (None, (2.0, None))]
    df = spark.createDataFrame(rows, "price double, pricing_details struct<num_of_nights:double,price_per_night:double>")
    kept = listing.with_log_price(listing.short_stays(df)).collect()
    assert [r.price for r in kept] == [100.0, 0.0, 50.0, None]
    priced = listing.priced_only(listing.with_log_price(listing.short_stays(df))).collect()
    assert [r.price_cleaned for r in priced] == [math.log1p(100.0), math.log1p(50.0)]


def test_ratios_keep_null_in_training_and_zero_in_scoring(spark):
    df = spark.createDataFrame(
        [(None, 2.0, 1.0, None, 1, 4.5, 10.0, 4.0)],
        "num_beds double, num_bedrooms double, num_baths double, guests double, is_superhost_binary int, host_rating double, property_number_of_reviews double, ratings double")
    train, score = listing.with_ratios(df).first(), listing.with_ratios(df, missing_rooms_are_zero=True).first()
    assert train.beds_per_guest is None and score.beds_per_guest == 0.0
    assert (train.bedrooms_per_guest, train.total_rooms, train.rooms_per_guest) == (2.0, 3.0, 3.0)
    assert (train.superhost_rating_interaction, train.review_volume_quality, train.guest_capacity_ratio) == (4.5, 40.0, 0.0)


def test_flags_and_city(spark):
    df = spark.createDataFrame([("STUDIO flat", "t", "Paris, France"), (None, None, None), ("x", "2", "")], "name string, is_superhost string, location string")
    got = listing.with_city(listing.with_superhost_flag(listing.with_studio_flag(df))).collect()
    assert [(r.is_studio_binary, r.is_superhost_binary, r.city) for r in got] == [(1, 1, "Paris"), (0, 0, None), (0, 0, "")]
