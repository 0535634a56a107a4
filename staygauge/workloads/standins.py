"""Rental tables derived from the benchmark tables: same rows, same growth, columns of the shapes the engine reads.

Each derivation has a twin in SQL, so that a check computes its expectation from the base tables.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from staygauge.session import spread
from staygauge.workloads.registry import table


# --- calendar: one priced day per line item, the region as city ---------------------------------
def calendar(spark: SparkSession, sf_dir: str) -> DataFrame:
    items = table(spark, sf_dir, "lineitem").select("l_suppkey", "l_extendedprice", "l_shipdate")
    places = (
        table(spark, sf_dir, "supplier").select("s_suppkey", "s_nationkey")
        .join(table(spark, sf_dir, "nation"), F.col("s_nationkey") == F.col("n_nationkey"))
        .join(table(spark, sf_dir, "region"), F.col("n_regionkey") == F.col("r_regionkey"))
    )
    return items.join(places, F.col("l_suppkey") == F.col("s_suppkey")).select(
        F.concat(F.lit("$"), F.format_number("l_extendedprice", 2)).alias("adjusted_price"),
        F.translate("r_name", " ", "_").alias("city"),
        F.date_format("l_shipdate", "yyyy-MM-dd").alias("date"),
    )


SEASON_SQL = """
prices AS (
  SELECT lower(replace(r_name, '_', ' ')) AS city, strftime(l_shipdate, '%m-%d') AS date, ln(1 + l_extendedprice) AS price
  FROM lineitem JOIN supplier ON l_suppkey = s_suppkey JOIN nation ON s_nationkey = n_nationkey
  JOIN region ON n_regionkey = r_regionkey
), daily AS (
  SELECT city, date, avg(price) AS price FROM prices GROUP BY city, date HAVING count(*) > 3
), scored AS (
  SELECT city, date,
    price - avg(CASE WHEN date = '09-25' THEN price END) OVER (PARTITION BY city) AS price_relative,
    (price - avg(price) OVER (PARTITION BY city)) / stddev_samp(price) OVER (PARTITION BY city) AS z
  FROM daily QUALIFY count(*) OVER (PARTITION BY city) >= 365
), cuts AS (
  SELECT quantile_disc(z, 0.25) AS a, quantile_disc(z, 0.5) AS b, quantile_disc(z, 0.75) AS c FROM scored
), season AS (
  SELECT city, date, price_relative,
    CASE WHEN z < a THEN 'green' WHEN z < b THEN 'yellow' WHEN z < c THEN 'orange' ELSE 'red' END AS stoplight
  FROM scored, cuts WHERE z IS NOT NULL
)"""

# --- customers as places with coordinates all over the globe ------------------------------------
GLOBE_LAT = "((c_custkey * 7919) % 18000) / 1e2 - 9e1"
GLOBE_LONG = "((c_custkey * 104729) % 36000) / 1e2 - 18e1"


def globe_points(spark: SparkSession, sf_dir: str) -> DataFrame:
    places = table(spark, sf_dir, "nation").select(F.col("n_nationkey").alias("c_nationkey"), F.col("n_name").alias("city"))
    return spread(table(spark, sf_dir, "customer"), "c_custkey", rows_per_task=16_384).join(places, "c_nationkey").select(
        "c_custkey", "city", "c_acctbal",
        F.expr(f"CAST({GLOBE_LAT} AS DOUBLE)").alias("lat"), F.expr(f"CAST({GLOBE_LONG} AS DOUBLE)").alias("long"),
    )


GLOBE_SQL = f"""
globe AS (
  SELECT c_custkey, n_name AS city, c_acctbal, CAST({GLOBE_LAT} AS DOUBLE) AS lat, CAST({GLOBE_LONG} AS DOUBLE) AS long
  FROM customer JOIN nation ON c_nationkey = n_nationkey
)"""


def sql_km(lat1: str, lon1: str, lat2: str, lon2: str) -> str:
    a = (f"(pow(sin(radians({lat2} - {lat1}) / 2), 2) + cos(radians({lat1})) * cos(radians({lat2}))"
         f" * pow(sin(radians({lon2} - {lon1}) / 2), 2))")
    return f"round(2 * 6371.0 * atan2(sqrt(least({a}, 1.0)), sqrt(1 - least({a}, 1.0))), 6)"


# --- town points: customers in quarters of a town per nation, some of them strays ----------------
# Two quarters about 3 km apart, each about 300 m wide; one customer in nine lies somewhere in between.
TOWN_LAT = """(c_nationkey * 5 - 60) + CASE WHEN c_custkey % 9 = 0 THEN ((c_custkey * 7919) % 4001) / 4e3 * 8e-2
  ELSE (c_custkey % 2) * 2e-2 + ((c_custkey * 31) % 101) / 1e2 * 3e-3 END"""
TOWN_LONG = """(c_nationkey * 11 - 130) + CASE WHEN c_custkey % 9 = 0 THEN ((c_custkey * 104729) % 4001) / 4e3 * 8e-2
  ELSE (c_custkey % 2) * 2e-2 + ((c_custkey * 57) % 103) / 1e2 * 3e-3 END"""


def town_points(spark: SparkSession, sf_dir: str) -> DataFrame:
    places = table(spark, sf_dir, "nation").select(F.col("n_nationkey").alias("c_nationkey"), F.col("n_name").alias("city"))
    return spread(table(spark, sf_dir, "customer"), "c_custkey", rows_per_task=16_384).join(places, "c_nationkey").select(
        "c_custkey", "city", "c_acctbal",
        F.expr(f"CAST({TOWN_LAT} AS DOUBLE)").alias("lat"), F.expr(f"CAST({TOWN_LONG} AS DOUBLE)").alias("long"),
    )


TOWN_SQL = f"""
town AS (
  SELECT c_custkey, n_name AS city, c_acctbal, CAST({TOWN_LAT} AS DOUBLE) AS lat, CAST({TOWN_LONG} AS DOUBLE) AS long
  FROM customer JOIN nation ON c_nationkey = n_nationkey
)"""

# --- raw listings: one per order -----------------------------------------------------------------
_CURRENCIES = "array('USD', 'eur', ' GBP ', 'ILS', 'XXX')"
LISTING_PRICE = "40 + 25 * (o_orderkey % 5) + 8 * (1 + o_orderkey % 3) + round(o_totalprice / 20000.0, 2)"


def raw_listings(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Listings as they come: numbers and flags as text, nested fields as JSON text, some of it bad or missing."""
    rows = (
        spread(table(spark, sf_dir, "orders").select("o_orderkey", "o_custkey", "o_totalprice", "o_orderpriority", "o_orderstatus"),
               "o_orderkey", rows_per_task=32_768)
        .join(table(spark, sf_dir, "customer").select("c_custkey", "c_nationkey"), F.col("o_custkey") == F.col("c_custkey"))
        .join(table(spark, sf_dir, "nation"), F.col("c_nationkey") == F.col("n_nationkey"))
        .join(table(spark, sf_dir, "region"), F.col("n_regionkey") == F.col("r_regionkey"))
    )
    return rows.selectExpr(
        "o_orderkey AS listing_key",
        """CASE WHEN o_orderkey % 7 = 0 THEN 'Bright STUDIO with 1.5 baths' WHEN o_orderkey % 7 = 1 THEN 'Cosy loft, 2 beds'
             ELSE concat('Home ', o_orderpriority) END AS name""",
        "CASE WHEN o_orderkey % 13 = 0 THEN 'null' ELSE CAST(o_totalprice AS STRING) END AS price",
        f"""CASE WHEN o_orderkey % 17 = 0 THEN NULL ELSE concat('{{"num_of_nights": ', 1 + o_orderkey % 35, ', "price_per_night": ',
             CASE WHEN o_orderkey % 3 = 0 THEN 'null' ELSE CAST({LISTING_PRICE} AS STRING) END, '}}') END AS pricing_details""",
        f"{_CURRENCIES}[o_orderkey % 5] AS currency",
        """'["Lovely stay"]' AS reviews""",
        "CAST(3 + (o_orderkey % 20) / 10.0 AS STRING) AS ratings",
        "CASE WHEN o_orderkey % 19 = 0 THEN NULL ELSE concat(n_name, ', ', r_name) END AS location",
        """CAST((c_nationkey * 5 - 60) + (o_custkey % 4) * 2e-2 + ((o_orderkey * 31) % 101) / 1e2 * 3e-3 AS DOUBLE) AS lat""",
        """CAST((c_nationkey * 11 - 130) + (o_custkey % 3) * 2e-2 + ((o_orderkey * 57) % 103) / 1e2 * 3e-3 AS DOUBLE) AS long""",
        "CAST(1 + o_orderkey % 8 AS STRING) AS guests",
        """'[{"name": "Cleanliness", "value": "4.8"}]' AS category_rating""",
        "CAST(o_orderkey % 300 AS STRING) AS host_number_of_reviews",
        "CASE WHEN o_orderkey % 23 = 0 THEN 'n/a' ELSE CAST((o_orderkey % 50) / 10.0 AS STRING) END AS host_rating",
        "concat(o_orderkey % 101, '%') AS host_response_rate",
        "CAST(o_orderkey % 150 AS STRING) AS property_number_of_reviews",
        """CASE WHEN o_orderkey % 7 = 1 THEN '[]' WHEN o_orderkey % 6 = 0 THEN 'not json'
             ELSE concat('["', 1 + o_orderkey % 4, ' beds","', o_orderkey % 5, ' bedrooms","',
               CASE WHEN o_orderkey % 10 = 2 THEN 'shared 1.5 baths' ELSE concat(1 + o_orderkey % 3, '.5 baths') END, '"]') END AS details""",
        """CASE WHEN o_orderkey % 29 = 0 THEN 'oops' ELSE concat('[{"group_name": "Bath", "items": [{"name": "Towels", "value": "y"}',
             repeat(',{"name": "Soap", "value": "y"}', CAST(o_orderkey % 4 AS INT)),
             ']},{"group_name": "Not included", "items": [{"name": "Sauna", "value": "n"}]},{"group_name": null, "items": [{"name": "x", "value": "y"}]},',
             '{"group_name": "Kitchen", "items": null}]') END AS amenities""",
        "concat('A place of order ', o_orderkey) AS description",
        "'[]' AS location_details",
        "element_at(array('t', 'false', '1', 'maybe'), CAST(1 + o_orderkey % 4 AS INT)) AS is_supperhost",
        "CAST(1 + o_orderkey % 15 AS STRING) AS hosts_year",
    )


LISTINGS_SQL = f"""
listed AS (
  SELECT o_orderkey AS k,
    CASE WHEN o_orderkey % 19 = 0 THEN NULL ELSE n_name END AS city,
    CASE WHEN o_orderkey % 3 <> 0 THEN {LISTING_PRICE} WHEN o_orderkey % 13 = 0 THEN NULL ELSE o_totalprice END AS price,
    CAST(3 + (o_orderkey % 20) / 10.0 AS DOUBLE) AS ratings,
    CAST(1 + o_orderkey % 8 AS DOUBLE) AS guests,
    CASE WHEN o_orderkey % 23 = 0 THEN NULL ELSE CAST((o_orderkey % 50) / 10.0 AS DOUBLE) END AS host_rating,
    CAST(o_orderkey % 150 AS DOUBLE) AS property_number_of_reviews,
    o_orderkey % 7 <> 1 AND o_orderkey % 6 <> 0 AS has_details,
    CAST(CASE WHEN o_orderkey % 7 <> 1 AND o_orderkey % 6 <> 0 THEN 1 + o_orderkey % 4 WHEN o_orderkey % 7 = 1 THEN 2 ELSE 0 END AS DOUBLE) AS num_beds,
    CAST(CASE WHEN o_orderkey % 7 <> 1 AND o_orderkey % 6 <> 0 THEN o_orderkey % 5 ELSE 0 END AS DOUBLE) AS num_bedrooms,
    CAST(CASE WHEN o_orderkey % 7 <> 1 AND o_orderkey % 6 <> 0 AND o_orderkey % 10 <> 2 THEN 1.5 + o_orderkey % 3
      WHEN o_orderkey % 7 = 0 THEN 1.5 ELSE 0 END AS DOUBLE) AS num_baths,
    CAST(o_orderkey % 7 = 0 AS INTEGER) AS is_studio_binary,
    CAST(o_orderkey % 4 IN (0, 2) AS INTEGER) AS is_superhost_binary,
    CAST(CASE WHEN o_orderkey % 29 = 0 THEN 0 ELSE 1 + o_orderkey % 4 END AS INTEGER) AS amenities_count
  FROM orders JOIN customer ON o_custkey = c_custkey JOIN nation ON c_nationkey = n_nationkey
  WHERE o_orderkey % 17 <> 0 AND 1 + o_orderkey % 35 < 30
)"""

# --- captured listing pages: one per customer ------------------------------------------------------
_SYMBOL = "element_at(array('₪', '$', '€', '£'), CAST(1 + c_custkey % 4 AS INT))"
_GAP = "repeat('- ', 40)"
_PAGE_PARTS = [
    "'<!DOCTYPE html><html><head><title>Page ', c_custkey, '</title><style>p{margin:0}</style>'",
    """'<script>var geo = {"lat":', c_custkey % 90, '.25,"lng":-', c_custkey % 180, '.5}; var t = "</p>";</script>'""",
    """CASE WHEN c_custkey % 4 = 0 THEN concat('<script type="application/ld+json">[{"@type":"BreadcrumbList","name":"no"},
       {"@type":["Product","Thing"],"name":"Loft ', c_custkey, '","address":{"addressLocality":"', n_name, '","addressCountry":"', r_name, '"},
       "geo":{"latitude":"10.5","longitude":20.25},"offers":[{"price":"1,100","priceCurrency":"EUR"}],
       "aggregateRating":{"ratingValue":4.5,"reviewCount":"77"},"review":[{"reviewBody":"Nice  place"},{"name":""}],"numberOfRooms":3,
       "host":{"memberSince":"May 2012","rating":4.9,"responseRate":"90%"},"amenityFeature":[{"name":"Wifi"},{"value":"Pool"}]}]</script>')
       WHEN c_custkey % 4 = 1 THEN '<script type="application/ld+json">{"@type":"House","name":</script>' ELSE '' END""",
    "'</head><body><header><h1>House  ', c_custkey, ' &amp; garden</h1><h2>Sub ', c_custkey, '</h2></header>'",
    """CASE WHEN c_custkey % 5 <> 0 THEN concat('<section><div><h2 elementtiming="LCP-target">Entire home in ', n_name, ', ', r_name,
       ' 4.93</h2></div><ol class="x lgx66tx"><li>', 1 + c_custkey % 60, ' guests</li><li><span aria-hidden="true"> · </span>', c_custkey % 4,
       ' bedrooms</li><li>', 1 + c_custkey % 3, ' beds</li><li>', 1 + c_custkey % 2, '.5 baths</li></ol></section>') ELSE '' END""",
    """CASE WHEN c_custkey % 11 = 0 THEN '<div data-testid="pdp-section-summary">2 guests · Studio · 1 bath</div>' ELSE '' END""",
    """CASE WHEN c_custkey % 2 = 0 THEN concat('<p>4.', 10 + c_custkey % 90, ' · ', c_custkey % 400, ' reviews</p>') ELSE '<p>7 reviews</p>' END""",
    f"""CASE WHEN c_custkey % 3 = 0 THEN concat('<p>', {_SYMBOL}, format_number(1000 + c_custkey, 0), '&nbsp;for ', 1 + c_custkey % 6, ' nights</p>')
       WHEN c_custkey % 3 = 1 THEN concat({_GAP}, '<p>', {_SYMBOL}, 100 + c_custkey, ' per night</p>', {_GAP}, '<p>Parking fee: ', {_SYMBOL}, '5 per night</p>')
       ELSE concat({_GAP}, '<p>Now ', {_SYMBOL}, ' ', 200 + c_custkey, '</p>', {_GAP}, '<p>Cleaning fee ', {_SYMBOL}, 10 + c_custkey % 7,
         '</p><p>Airbnb service fee ', {_SYMBOL}, '9</p><p>Taxes ', {_SYMBOL}, 3 + c_custkey % 5, '.50</p>') END""",
    "'<p>Hosting since 20', 10 + c_custkey % 10, ' Response rate: ', c_custkey % 101, '%</p>'",
    "CASE WHEN c_custkey % 7 = 0 THEN '<p>33 reviews · Superhost</p>' ELSE '' END",
    "CASE WHEN c_custkey % 3 <> 0 THEN '<p>4.68 out of 5 average rating</p>' ELSE '' END",
    "'<button>Show all ', 20 + c_custkey % 50, ' amenities</button><!-- skip -->'",
    "CASE WHEN c_custkey % 6 = 0 THEN concat('<div data-testid=\"review-item\"><p>Great ', c_custkey, '</p></div>') ELSE '' END",
    """'<h2>About this place</h2> Lovely ', c_custkey, ' here. <h2>Where you\\'ll sleep</h2>Room<h2>Where you\\'ll be</h2>In ', n_name,
       ' center <h2>What this place offers</h2>Wifi<h2>Reviews</h2>So good that this text is longer than thirty characters<h2>Meet your Host</h2>Bob '""",
    "CASE WHEN c_custkey % 8 <> 7 THEN repeat('and so on ', 60) ELSE '' END, '</body></html>'",
]


def captured_pages(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = (
        spread(table(spark, sf_dir, "customer").select("c_custkey", "c_nationkey"), "c_custkey")
        .join(table(spark, sf_dir, "nation"), F.col("c_nationkey") == F.col("n_nationkey"))
        .join(table(spark, sf_dir, "region"), F.col("n_regionkey") == F.col("r_regionkey"))
    )
    return rows.selectExpr(
        "CASE WHEN c_custkey % 2 = 0 THEN CAST(c_custkey AS STRING) END AS listingId",
        "CASE WHEN c_custkey % 2 = 1 THEN CAST(c_custkey AS STRING) END AS listing_id",
        """concat('https://www.airbnb.com/', CASE WHEN c_custkey % 10 = 9 THEN 'help/' ELSE 'rooms/' END, c_custkey, CASE WHEN c_custkey % 3 <> 0 THEN
             concat('?check_in=2026-0', 1 + c_custkey % 9, '-10&check_out=2026-0', 1 + c_custkey % 9, '-', 12 + c_custkey % 5) ELSE '' END) AS url""",
        f"concat({', '.join(_PAGE_PARTS)}) AS html",
        "date_format(timestamp_seconds(1767225600 + c_custkey), \"yyyy-MM-dd'T'HH:mm:ss'Z'\") AS capturedAt",
    )


PAGES_SQL = """
facts AS (
  SELECT c_custkey AS k, n_name, r_name, c_custkey % 4 = 0 AS ld, c_custkey % 5 <> 0 AS over,
    CASE WHEN c_custkey % 3 <> 0 THEN '2026-0' || (1 + c_custkey % 9) || '-10' END AS check_in,
    CASE WHEN c_custkey % 3 <> 0 THEN '2026-0' || (1 + c_custkey % 9) || '-' || (12 + c_custkey % 5) END AS check_out,
    CAST(CASE WHEN c_custkey % 3 = 0 THEN 1 + c_custkey % 6 END AS DOUBLE) AS offer_nights,
    CAST(CASE WHEN c_custkey % 3 = 0 THEN 1000 WHEN c_custkey % 3 = 1 THEN 100 ELSE 200 END + c_custkey AS DOUBLE) AS offer_amount,
    ['ILS', 'USD', 'EUR', 'GBP'][1 + c_custkey % 4] AS offer_currency
  FROM customer JOIN nation ON c_nationkey = n_nationkey JOIN region ON n_regionkey = r_regionkey
), expected AS (
  SELECT k, ld, over, n_name, r_name, offer_nights, offer_amount, offer_currency, check_in, check_out,
    CASE WHEN ld THEN 'Loft ' || k ELSE 'House ' || k || ' & garden' END AS name,
    CASE WHEN over THEN 'Entire home' END AS property_type,
    CAST(CASE WHEN ld THEN 1100 ELSE offer_amount END AS DOUBLE) AS price,
    CASE WHEN ld THEN 'EUR' ELSE offer_currency END AS currency,
    CASE WHEN ld THEN ['Nice place'] WHEN k % 6 = 0 THEN ['Great ' || k]
      ELSE ['So good that this text is longer than thirty characters'] END AS reviews,
    CAST(CASE WHEN ld THEN 4.5 WHEN k % 2 = 0 THEN (410 + k % 90) / 100 END AS DOUBLE) AS ratings,
    CASE WHEN ld THEN n_name || ', ' || r_name ELSE 'Sub ' || k END AS location,
    CAST(CASE WHEN ld THEN 10.5 ELSE k % 90 + 0.25 END AS DOUBLE) AS lat,
    CAST(CASE WHEN ld THEN 20.25 ELSE -(k % 180) - 0.5 END AS DOUBLE) AS long,
    CAST(CASE WHEN over AND 1 + k % 60 <= 50 THEN 1 + k % 60 WHEN ld THEN 3 WHEN k % 11 = 0 THEN 2 END AS DOUBLE) AS guests,
    CAST(CASE WHEN k % 3 = 2 THEN 9 END AS DOUBLE) AS airbnb_service_fee,
    CAST(CASE WHEN k % 3 = 2 THEN 10 + k % 7 END AS DOUBLE) AS cleaning_fee,
    CAST(CASE WHEN k % 3 = 2 THEN 3.5 + k % 5 END AS DOUBLE) AS taxes,
    coalesce(offer_nights, 2 + k % 5) AS num_of_nights,
    CAST(CASE WHEN k % 7 = 0 THEN 33 END AS DOUBLE) AS host_number_of_reviews,
    CAST(CASE WHEN ld THEN 4.9 WHEN k % 3 <> 0 THEN 4.68 END AS DOUBLE) AS host_rating,
    CASE WHEN ld THEN '90%' ELSE (k % 101) || '%' END AS host_response_rate,
    CAST(CASE WHEN ld THEN 77 WHEN k % 2 = 0 THEN k % 400 ELSE 7 END AS DOUBLE) AS property_number_of_reviews,
    k % 7 = 0 AS is_superhost,
    CAST(CASE WHEN ld THEN 2012 ELSE 2010 + k % 10 END AS DOUBLE) AS host_year,
    CASE WHEN ld THEN ['Wifi', 'Pool'] WHEN k % 11 = 0 THEN ['2 guests', 'Studio', '1 bath'] ELSE CAST([] AS VARCHAR[]) END AS details,
    'Lovely ' || k || ' here.' AS description, 'In ' || n_name || ' center' AS location_details,
    CASE WHEN over THEN n_name || ', ' || r_name END AS city,
    CAST(CASE WHEN over THEN k % 4 END AS DOUBLE) AS num_bedrooms, CAST(CASE WHEN over THEN 1 + k % 3 END AS DOUBLE) AS num_beds,
    CAST(CASE WHEN over THEN 1.5 + k % 2 END AS DOUBLE) AS num_baths, CAST(20 + k % 50 AS DOUBLE) AS num_amenities
  FROM facts
)"""
