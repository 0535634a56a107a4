"""Raw listing rows to typed and derived features. Every function is lazy and adds no action."""

from __future__ import annotations

import warnings

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import StringType

from staygauge import fixed_values as fixed
from staygauge.functions.text import blank_to_null, part_before_comma
from staygauge.operators.stats import keep_top_groups


def select_listing_columns(df: DataFrame) -> DataFrame:
    """Known columns that the input has, two of them renamed; the scan reads nothing else."""
    wanted = {name: name for name in fixed.LISTING_COLUMNS} | fixed.LISTING_RENAMES
    present = {}
    for source, target in wanted.items():
        found = source if source in df.columns else target if target in df.columns else None
        if found is None:
            warnings.warn(f"column {source} is not in the input and is left out", stacklevel=2)
        else:
            present[target] = found
    if not present:
        raise ValueError("the input has none of the listing columns")
    return df.select(*[F.col(found).alias(target) for target, found in present.items()])


def enforce_listing_types(df: DataFrame) -> DataFrame:
    """JSON text to arrays and structs, everything else to its type; values that do not fit become NULL."""
    kinds = dict(df.dtypes)

    def typed(name: str) -> Column:
        if name in fixed.LISTING_JSON_TYPES and isinstance(df.schema[name].dataType, StringType):
            return F.from_json(F.col(name), fixed.LISTING_JSON_TYPES[name]).alias(name)
        wanted = fixed.LISTING_SCALAR_TYPES.get(name)
        if wanted and kinds[name] != wanted:
            return F.col(name).try_cast(wanted).alias(name)
        return F.col(name)

    return df.select(*[typed(name) for name in df.columns])


def short_stays(df: DataFrame, limit: int = fixed.LONGEST_STAY_NIGHTS) -> DataFrame:
    """Listings whose price is for fewer than ``limit`` nights; an unknown number of nights drops the row."""
    return df.filter(F.col("pricing_details.num_of_nights") < limit)


def with_log_price(df: DataFrame) -> DataFrame:
    """Nightly price where known, else the list price; ``price_cleaned`` is its log, NULL unless positive."""
    price = F.coalesce("pricing_details.price_per_night", "price")
    return df.withColumns({"price": price, "price_cleaned": F.when(price > 0, F.log1p(price))})


def priced_only(df: DataFrame) -> DataFrame:
    """Rows with a usable price. A positive price always has a log, a NULL price fails the comparison."""
    return df.filter((F.col("price") > 0) & F.col("price_cleaned").isNotNull())


def with_room_counts(df: DataFrame) -> DataFrame:
    """Beds, bedrooms and baths from the details, else from the name, else 0."""
    details = F.concat_ws(" ", F.col("details"))

    def count_of(pattern: str) -> Column:
        found = [blank_to_null(F.regexp_extract(text, pattern, 1)) for text in (details, F.col("name"))]
        return F.coalesce(*found, F.lit("0")).cast("float").cast("double")

    return df.withColumns({
        "num_beds": count_of(fixed.BEDS_PATTERN),
        "num_bedrooms": count_of(fixed.BEDROOMS_PATTERN),
        "num_baths": count_of(fixed.BATHS_PATTERN),
    })


def with_city(df: DataFrame) -> DataFrame:
    return df.withColumn("city", part_before_comma(F.col("location")))


def contains_word(text: Column, word: str) -> Column:
    """1 if the text contains the word in any case, else 0, also for NULL."""
    return F.coalesce(F.lower(text).contains(word).cast("int"), F.lit(0))


def with_studio_flag(df: DataFrame) -> DataFrame:
    return df.withColumn("is_studio_binary", contains_word(F.col("name"), "studio"))


def truthy_flag(value: Column) -> Column:
    """1 for t, true or 1 in any case, else 0."""
    return F.coalesce(F.lower(value.cast("string")).isin("t", "true", "1").cast("int"), F.lit(0))


def with_superhost_flag(df: DataFrame) -> DataFrame:
    return df.withColumn("is_superhost_binary", truthy_flag(F.col("is_superhost")))


def amenity_count(amenities_json: Column) -> Column:
    """Number of items in all named groups but the excluded one. A group without items counts 0, bad JSON counts 0."""
    groups = F.from_json(amenities_json, fixed.AMENITIES_TYPE)
    offered = F.filter(groups, lambda g: g["group_name"] != fixed.EXCLUDED_AMENITY_GROUP)
    total = F.aggregate(offered, F.lit(0), lambda acc, g: acc + F.coalesce(F.size(g["items"]), F.lit(0)))
    return F.coalesce(total, F.lit(0))


def with_amenity_count(df: DataFrame) -> DataFrame:
    return df.withColumn("amenities_count", amenity_count(F.col("amenities"))).drop("amenities")


def with_ratios(df: DataFrame, missing_rooms_are_zero: bool = False) -> DataFrame:
    """Eight ratio and product features in one projection.

    Training leaves a ratio NULL when its bed or bedroom count is NULL; scoring takes the count as 0.
    """
    def known(name: str) -> Column:
        return F.coalesce(F.col(name).cast("double"), F.lit(0.0))

    def rooms(name: str) -> Column:
        return known(name) if missing_rooms_are_zero else F.col(name).cast("double")

    per_guest, per_bedroom = known("guests") + 1, known("num_bedrooms") + 1
    total_rooms = known("num_bedrooms") + known("num_baths")
    return df.withColumns({
        "beds_per_guest": F.try_divide(rooms("num_beds"), per_guest),
        "bedrooms_per_guest": F.try_divide(rooms("num_bedrooms"), per_guest),
        "guest_capacity_ratio": F.try_divide(known("guests"), per_bedroom),
        "superhost_rating_interaction": known("is_superhost_binary") * known("host_rating"),
        "review_volume_quality": known("property_number_of_reviews") * known("ratings"),
        "total_rooms": total_rooms,
        "bed_to_bedroom_ratio": F.try_divide(rooms("num_beds"), per_bedroom),
        "rooms_per_guest": F.try_divide(total_rooms, per_guest),
    })


def listing_features(raw: DataFrame, top_cities: int = 100) -> DataFrame:
    """Raw listings to features, one lazy plan.

    The stay filter comes right after the types, so later steps see fewer rows. The cities are counted in a second,
    column-pruned pass (nights and location only); no list of cities passes through the driver.
    """
    df = enforce_listing_types(select_listing_columns(raw))
    df = with_city(with_room_counts(with_log_price(short_stays(df))))
    df = keep_top_groups(df, "city", top_cities)
    return with_ratios(with_amenity_count(with_superhost_flag(with_studio_flag(df))))


def snapshot_features(snapshots: DataFrame) -> DataFrame:
    """Flat scoring features of parsed pages (column ``data``), before geography."""
    numbers = ["num_bedrooms", "num_beds", "num_baths", "guests", "ratings", "host_rating", "host_number_of_reviews",
               "property_number_of_reviews", "host_year", "lat", "long"]
    flat = snapshots.select(
        "*",
        *[F.col(f"data.{n}").try_cast("double").alias(n) for n in numbers],
        F.col("data.num_amenities").try_cast("double").alias("amenities_count"),
        F.col("data.city").alias("parsed_city"),
        F.coalesce(F.col("data.is_superhost").cast("int"), F.lit(0)).alias("is_superhost_binary"),
        contains_word(F.col("data.name"), "studio").alias("is_studio_binary"),
    )
    return with_ratios(flat, missing_rooms_are_zero=True)


def text_lengths(description: Column, location_details: Column) -> dict[str, Column]:
    from staygauge.functions.text import log_length

    return {
        "description_length_logp1": log_length(description),
        "loc_details_length_logp1": log_length(location_details, empty_marks=("[]",)),
    }


def model_row(df: DataFrame, *keep: str) -> DataFrame:
    """The model's 19 + 2 inputs in their fixed order, after the ``keep`` columns."""
    doubles = [F.col(c).cast("double").alias(c) for c in fixed.CONTINUOUS_FEATURES]
    return df.select(*keep, *doubles, *[F.col(c).cast("int").alias(c) for c in fixed.BINARY_FEATURES])
