"""Projections, filters and scalar functions."""

from pyspark.sql import functions as F

from staygauge import fixed_values as fixed
from staygauge.functions import money, text
from staygauge.operators import listing
from staygauge.workloads.registry import six, table, workload
from staygauge.workloads.standins import LISTINGS_SQL, raw_listings


@workload("select_and_cast", """
SELECT p_partkey AS guests, TRY_CAST(p_brand AS DOUBLE) AS price, TRY_CAST(replace(p_brand, 'Brand#', '') AS DOUBLE) AS host_year,
  p_name AS name, p_size % 2 = 0 AS is_superhost
FROM part""")
def select_and_cast(spark, sf_dir):
    """Known columns only, under their final names, with values that do not fit turned NULL."""
    raw = table(spark, sf_dir, "part").select(
        F.col("p_name").alias("name"), F.col("p_brand").alias("price"),
        F.regexp_replace("p_brand", "Brand#", "").alias("hosts_year"), F.col("p_partkey").cast("string").alias("guests"),
        F.when(F.col("p_size") % 2 == 0, "t").otherwise("f").alias("is_supperhost"), "p_type", "p_retailprice",
    )
    typed = listing.enforce_listing_types(listing.select_listing_columns(raw))
    return typed.withColumn("guests", F.col("guests").cast("long"))


@workload("json_struct_fields", """
SELECT event_id, CAST(json_extract(props, '$.k') AS BIGINT) AS k, CAST(json_extract(props, '$.k') AS DOUBLE) + 1 AS num_of_nights,
  'fee ' || json_extract_string(props, '$.k') AS special_offer, CAST(NULL AS DOUBLE) AS cleaning_fee
FROM events""")
def json_struct_fields(spark, sf_dir):
    k = F.from_json("props", "k long")["k"]
    details = F.concat(F.lit('{"num_of_nights": '), k + 1, F.lit(', "special_offer": "fee '), k, F.lit('", "cleaning_fee": "none"}'))
    parsed = table(spark, sf_dir, "events").withColumn("pricing_details", F.from_json(details, fixed.PRICING_DETAILS_TYPE))
    return parsed.select("event_id", k.alias("k"), "pricing_details.num_of_nights", "pricing_details.special_offer",
                         "pricing_details.cleaning_fee")


@workload("json_nested_count", "SELECT k, amenities_count FROM (WITH " + LISTINGS_SQL + " SELECT * FROM listed) t")
def json_nested_count(spark, sf_dir):
    typed = listing.short_stays(listing.enforce_listing_types(raw_listings(spark, sf_dir)))
    return typed.select(F.col("listing_key").alias("k"), listing.amenity_count(F.col("amenities")).alias("amenities_count"))


@workload("keyword_flag", """
SELECT p_partkey, CAST(contains(lower(p_name), 'ring') AS INTEGER) AS has_word FROM part""")
def keyword_flag(spark, sf_dir):
    return table(spark, sf_dir, "part").select("p_partkey", listing.contains_word(F.upper("p_name"), "ring").alias("has_word"))


@workload("truthy_flag", """
SELECT event_id, CAST(event_id % 5 IN (0, 1, 3) AS INTEGER) AS flag FROM events""")
def truthy_flag(spark, sf_dir):
    words = F.array(*[F.lit(w) for w in ("T", "True", "no", "1")])
    return table(spark, sf_dir, "events").select(
        "event_id", listing.truthy_flag(F.get(words, (F.col("event_id") % 5).cast("int"))).alias("flag"))


@workload("unit_extract", """
SELECT p_partkey, CAST(p_size AS DOUBLE) AS num_beds, CAST(p_size % 7 + 0.5 AS DOUBLE) AS num_bedrooms,
  CAST(CASE WHEN p_partkey % 3 = 0 THEN 0 ELSE p_size % 4 + 0.5 END AS DOUBLE) AS num_baths
FROM part""")
def unit_extract(spark, sf_dir):
    """Counts from text; a shared bath is no private one, also with a fraction."""
    size, key = F.col("p_size"), F.col("p_partkey")
    rows = table(spark, sf_dir, "part").select(
        "p_partkey", F.concat(size, F.lit(" beds in a "), "p_name").alias("name"),
        F.array(
            F.concat((size % 7), F.lit(".5 BEDROOMS")),
            F.concat(F.when(key % 3 == 0, "shared ").otherwise("private "), size % 4, F.lit(".5 baths")),
        ).alias("details"),
    )
    return listing.with_room_counts(rows).select("p_partkey", "num_beds", "num_bedrooms", "num_baths")


@workload("first_part", """
SELECT p_partkey, split_part(p_name, ' ', 1) AS city FROM part""")
def first_part(spark, sf_dir):
    rows = table(spark, sf_dir, "part").select("p_partkey", F.regexp_replace("p_name", " ", ", ").alias("location"))
    return listing.with_city(rows).select("p_partkey", "city")


@workload("log_price", """
SELECT l_orderkey, l_linenumber, CASE WHEN l_quantity > 5 THEN l_extendedprice ELSE l_tax END AS price,
  round(ln(1 + CASE WHEN l_quantity > 5 THEN l_extendedprice ELSE l_tax END), 6) + 0.0 AS price_cleaned
FROM lineitem WHERE l_quantity < 30 AND (l_quantity > 5 OR l_tax > 0)""")
def log_price(spark, sf_dir):
    rows = table(spark, sf_dir, "lineitem").select(
        "l_orderkey", "l_linenumber", F.col("l_tax").alias("price"),
        F.struct(F.col("l_quantity").alias("num_of_nights"),
                 F.when(F.col("l_quantity") > 5, F.col("l_extendedprice")).alias("price_per_night")).alias("pricing_details"),
    )
    priced = listing.priced_only(listing.with_log_price(listing.short_stays(rows)))
    return priced.select("l_orderkey", "l_linenumber", "price", six(F.col("price_cleaned")).alias("price_cleaned"))


RATIOS_SQL = """
  round({beds} / (coalesce(guests, 0) + 1), 6) + 0.0 AS beds_per_guest, round({rooms} / (coalesce(guests, 0) + 1), 6) + 0.0 AS bedrooms_per_guest,
  round(coalesce(guests, 0) / (coalesce(num_bedrooms, 0) + 1), 6) + 0.0 AS guest_capacity_ratio,
  round(coalesce(is_superhost_binary, 0) * coalesce(host_rating, 0), 6) + 0.0 AS superhost_rating_interaction,
  round(coalesce(property_number_of_reviews, 0) * coalesce(ratings, 0), 6) + 0.0 AS review_volume_quality,
  round(coalesce(num_bedrooms, 0) + coalesce(num_baths, 0), 6) + 0.0 AS total_rooms,
  round({beds} / (coalesce(num_bedrooms, 0) + 1), 6) + 0.0 AS bed_to_bedroom_ratio,
  round((coalesce(num_bedrooms, 0) + coalesce(num_baths, 0)) / (coalesce(guests, 0) + 1), 6) + 0.0 AS rooms_per_guest"""
RATIO_NAMES = ["beds_per_guest", "bedrooms_per_guest", "guest_capacity_ratio", "superhost_rating_interaction",
               "review_volume_quality", "total_rooms", "bed_to_bedroom_ratio", "rooms_per_guest"]
ROOMS = """SELECT l_orderkey, l_partkey, l_linenumber,
    CASE WHEN l_linenumber = 1 THEN NULL ELSE l_quantity END AS num_beds, CAST(CASE WHEN l_linenumber = 2 THEN NULL ELSE p_size END AS DOUBLE) AS num_bedrooms,
    CAST(l_linenumber AS DOUBLE) AS num_baths, CASE WHEN l_linenumber = 3 THEN NULL ELSE l_quantity / 4 END AS guests,
    l_partkey % 2 AS is_superhost_binary, l_discount * 50 AS host_rating, l_quantity AS property_number_of_reviews, l_tax * 60 AS ratings
  FROM lineitem JOIN part ON l_partkey = p_partkey"""


def _rooms(spark, sf_dir):
    table(spark, sf_dir, "lineitem").createOrReplaceTempView("staygauge_lineitem")
    table(spark, sf_dir, "part").createOrReplaceTempView("staygauge_part")
    return spark.sql(ROOMS.replace("FROM lineitem", "FROM staygauge_lineitem").replace("JOIN part", "JOIN staygauge_part"))


@workload("ratio_features", f"WITH r AS ({ROOMS}) SELECT l_orderkey, l_partkey, l_linenumber,"
          + RATIOS_SQL.format(beds="num_beds", rooms="num_bedrooms") + " FROM r")
def ratio_features(spark, sf_dir):
    df = listing.with_ratios(_rooms(spark, sf_dir))
    return df.select("l_orderkey", "l_partkey", "l_linenumber", *[six(F.col(c)).alias(c) for c in RATIO_NAMES])


@workload("ratio_features_for_scoring", f"WITH r AS ({ROOMS}) SELECT l_orderkey, l_partkey, l_linenumber,"
          + RATIOS_SQL.format(beds="coalesce(num_beds, 0)", rooms="coalesce(num_bedrooms, 0)") + " FROM r")
def ratio_features_for_scoring(spark, sf_dir):
    df = listing.with_ratios(_rooms(spark, sf_dir), missing_rooms_are_zero=True)
    return df.select("l_orderkey", "l_partkey", "l_linenumber", *[six(F.col(c)).alias(c) for c in RATIO_NAMES])


@workload("listing_features", f"""
WITH {LISTINGS_SQL},
top AS (SELECT city FROM listed GROUP BY city ORDER BY count(*) DESC, city ASC NULLS LAST LIMIT 20)
SELECT city, price, round(CASE WHEN price > 0 THEN ln(1 + price) END, 6) + 0.0 AS price_cleaned, ratings, guests, host_rating,
  num_beds, num_bedrooms, num_baths, is_studio_binary, is_superhost_binary, amenities_count,
  {RATIOS_SQL.format(beds="num_beds", rooms="num_bedrooms")}
FROM listed WHERE city IN (SELECT city FROM top)""")
def listing_features(spark, sf_dir):
    """The whole feature chain over raw listings: 25 cities, the 20 most frequent stay."""
    df = listing.listing_features(raw_listings(spark, sf_dir), top_cities=20)
    return df.select(
        "city", "price", six(F.col("price_cleaned")).alias("price_cleaned"), "ratings", "guests", "host_rating", "num_beds",
        "num_bedrooms", "num_baths", "is_studio_binary", "is_superhost_binary", "amenities_count",
        *[six(F.col(c)).alias(c) for c in RATIO_NAMES])


@workload("text_length_features", """
SELECT doc_id, round(ln(1 + length(text)), 6) + 0.0 AS description_length_logp1,
  round(ln(1 + CASE WHEN lang = 'en' THEN 0 ELSE length(lang) END), 6) + 0.0 AS loc_details_length_logp1
FROM documents""")
def text_length_features(spark, sf_dir):
    lengths = listing.text_lengths(F.col("text"), F.when(F.col("lang") == "en", "[]").otherwise(F.col("lang")))
    return table(spark, sf_dir, "documents").select("doc_id", *[six(c).alias(n) for n, c in lengths.items()])


_CODES = list(fixed.USD_RATES) + ["XXX"]


@workload("currency_convert", f"""
WITH rates AS (SELECT * FROM (VALUES {", ".join(f"({i}, '{c}', {fixed.USD_RATES.get(c, 'NULL')})" for i, c in enumerate(_CODES))}) AS t(i, code, rate))
SELECT o_orderkey, round(o_totalprice * CAST(rate AS DOUBLE), 8) + 0.0 AS usd, round(o_totalprice / CAST(rate AS DOUBLE), 4) + 0.0 AS local
FROM orders JOIN rates ON o_custkey % {len(_CODES)} = i""")
def currency_convert(spark, sf_dir):
    codes = F.array(*[F.lit(f" {c.lower()} ") for c in _CODES])
    rows = table(spark, sf_dir, "orders").withColumn("currency", F.get(codes, (F.col("o_custkey") % len(_CODES)).cast("int")))
    return rows.select(
        "o_orderkey",
        (F.round(money.to_usd(F.col("o_totalprice"), F.col("currency")), 8) + 0.0).alias("usd"),
        (F.round(money.from_usd(F.col("o_totalprice"), F.col("currency")), 4) + 0.0).alias("local"))


@workload("deal_label", """
WITH r AS (SELECT l_orderkey, l_partkey, l_linenumber, l_extendedprice / 40 AS predicted, p_retailprice * (l_linenumber - 1) AS listed
  FROM lineitem JOIN part ON l_partkey = p_partkey),
d AS (SELECT *, predicted - listed AS diff, CASE WHEN listed > 0 THEN (predicted - listed) / listed * 100 ELSE 0 END AS pct FROM r)
SELECT l_orderkey, l_partkey, l_linenumber, round(diff, 6) + 0.0 AS difference_usd, round(pct, 6) + 0.0 AS difference_pct,
  CASE WHEN pct > 10 THEN 'good' WHEN pct < -10 THEN 'bad' ELSE 'neutral' END AS stoplight,
  CASE WHEN pct > 10 THEN 'GOOD DEAL' WHEN pct < -10 THEN 'OVERPRICED' ELSE 'FAIR PRICE' END AS assessment
FROM d""")
def deal_label(spark, sf_dir):
    rows = table(spark, sf_dir, "lineitem").join(table(spark, sf_dir, "part"), F.col("l_partkey") == F.col("p_partkey"))
    listed = F.col("p_retailprice") * (F.col("l_linenumber") - 1)
    diff = F.col("l_extendedprice") / 40 - listed
    pct = money.percent_over_listed(diff, listed)
    return rows.select(
        "l_orderkey", "l_partkey", "l_linenumber", six(diff).alias("difference_usd"), six(pct).alias("difference_pct"),
        money.deal_label(pct).alias("stoplight"),
        F.regexp_extract(money.deal_text(diff, pct), r"^([A-Z ]+[A-Z])", 1).alias("assessment"))


@workload("normal_city", """
SELECT n_nationkey, lower(n_name) AS city, CASE WHEN n_nationkey % 3 = 2 THEN NULL ELSE '0' || (n_nationkey % 9 + 1) || '-15' END AS day FROM nation""")
def normal_city(spark, sf_dir):
    key = F.col("n_nationkey")
    place = F.concat(F.lit("  Greater "), "n_name", F.when(key % 2 == 0, ", United Kingdom").otherwise(", TX, USA "))
    day = F.concat(F.lit("0"), key % 9 + 1, F.lit("-15"))
    return table(spark, sf_dir, "nation").select(
        "n_nationkey", text.normal_city(place).alias("city"),
        text.month_day_of(F.when(key % 3 == 0, F.concat(F.lit("2026-"), day)).when(key % 3 == 1, day).otherwise("next week")).alias("day"))
