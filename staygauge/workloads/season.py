"""Season index and calendar queries."""

from pyspark.sql import functions as F

from staygauge.functions.money import season_label
from staygauge.operators.season import expand_calendar, season_adjustment, season_index, season_lookup
from staygauge.session import new_folder
from staygauge.sources.tables import read_season_lookup, upsert_season_lookup, write_season_lookup
from staygauge.plans.calendar import place_calendar
from staygauge.workloads.registry import six, table, workload
from staygauge.workloads.standins import SEASON_SQL, calendar


def index(spark, sf_dir):
    """Season index of the stand-in calendar. The stand-in has few prices per day, so more than 3 are enough."""
    return season_index(calendar(spark, sf_dir), min_prices_exclusive=3, relative_error=0.0)


@workload("season_index", f"""
WITH {SEASON_SQL}
SELECT city, date, round(price_relative, 6) + 0.0 AS price_relative, stoplight FROM season ORDER BY city, date""")
def season_index_query(spark, sf_dir):
    return index(spark, sf_dir).withColumn("price_relative", six(F.col("price_relative"))).orderBy("city", "date")


def _upsert_sql(changed: str) -> str:
    return f"""
WITH {SEASON_SQL},
versions AS (
  SELECT city AS location, date, 'airbnb-day-' || stoplight AS color, price_relative, 1 AS version FROM season
  UNION ALL
  SELECT city, date, 'airbnb-day-red', price_relative + 1, 2 FROM season WHERE {changed}
)
SELECT location, date, color, round(price_relative, 6) + 0.0 AS price_relative FROM versions
QUALIFY row_number() OVER (PARTITION BY location, date ORDER BY version DESC) = 1"""


@workload("season_lookup_sink", _upsert_sql("date < '07-01' AND city < 'b'"))
def season_lookup_sink(spark, sf_dir):
    """The lookup on disk after an upsert of some locations."""
    path = new_folder(spark, "lookup")
    old = season_lookup(index(spark, sf_dir))
    write_season_lookup(old, path)
    new = old.filter((F.col("date") < "07-01") & (F.col("location") < "b")).withColumns({
        "color": F.lit("airbnb-day-red"), "price_relative": F.col("price_relative") + 1})
    write_season_lookup(new, path)
    return read_season_lookup(spark, path).withColumn("price_relative", six(F.col("price_relative")))


@workload("season_lookup_upsert", _upsert_sql("date < '07-01'"))
def season_lookup_upsert(spark, sf_dir):
    old = season_lookup(index(spark, sf_dir))
    new = old.filter(F.col("date") < "07-01").withColumns({
        "color": F.lit("airbnb-day-red"), "price_relative": F.col("price_relative") + 1})
    return upsert_season_lookup(old, new).withColumn("price_relative", six(F.col("price_relative")))


@workload("calendar_expand", f"""
WITH {SEASON_SQL},
places AS (SELECT DISTINCT lower(r_name) AS location FROM region UNION ALL SELECT DISTINCT n_name FROM nation),
days AS (SELECT location, CAST(d AS DATE) AS day FROM places, generate_series(DATE '2026-01-21', DATE '2026-01-21' + 729, INTERVAL 1 DAY) AS g(d))
SELECT days.location, strftime(day, '%Y-%m-%d') AS date, coalesce('airbnb-day-' || stoplight, 'airbnb-day-green') AS color
FROM days LEFT JOIN season ON season.city = days.location AND season.date = strftime(day, '%m-%d')""")
def calendar_expand(spark, sf_dir):
    regions = table(spark, sf_dir, "region").select(F.lower("r_name").alias("location")).distinct()
    nations = table(spark, sf_dir, "nation").select(F.col("n_name").alias("location")).distinct()
    lookup = season_lookup(index(spark, sf_dir))
    return expand_calendar(lookup, regions.unionByName(nations), F.to_date(F.lit("2026-01-21")))


@workload("place_calendar", f"""
WITH {SEASON_SQL},
typed AS (SELECT r_regionkey, kind, lower(r_name) AS name, CASE kind WHEN 0 THEN r_name WHEN 1 THEN 'Greater ' || r_name || ' area' WHEN 2 THEN '0123456789' END AS place
  FROM region, range(4) AS k(kind)),
days AS (SELECT r_regionkey, kind, place, CASE WHEN kind < 2 THEN name END AS location, CAST(d AS DATE) AS day
  FROM typed, generate_series(DATE '2026-01-21', DATE '2026-01-21' + 729, INTERVAL 1 DAY) AS g(d))
SELECT r_regionkey, kind, place, location, strftime(day, '%Y-%m-%d') AS date, coalesce('airbnb-day-' || stoplight, 'airbnb-day-green') AS color
FROM days LEFT JOIN season ON season.city = days.location AND season.date = strftime(day, '%m-%d')""")
def place_calendar_query(spark, sf_dir):
    """Region names as typed, in a longer text, unlike any location, and missing."""
    kind, name = F.col("kind"), F.col("r_name")
    typed = table(spark, sf_dir, "region").select("r_regionkey", "r_name", F.explode(F.sequence(F.lit(0).cast("long"), F.lit(3).cast("long"))).alias("kind"))
    typed = typed.select("r_regionkey", "kind", F.when(kind == 0, name).when(kind == 1, F.concat(F.lit("Greater "), name, F.lit(" area")))
                         .when(kind == 2, "0123456789").alias("place"))
    return place_calendar(typed, season_lookup(index(spark, sf_dir)), F.to_date(F.lit("2026-01-21")))


@workload("season_adjust", f"""
WITH {SEASON_SQL}
SELECT event_id, round(coalesce(price_relative, 0), 6) + 0.0 AS calendar_adjustment_log
FROM events JOIN region ON user_id % 5 = r_regionkey
LEFT JOIN season ON season.city = lower(r_name) AND season.date = strftime(ts, '%m-%d') AND event_type <> 'error'""")
def season_adjust(spark, sf_dir):
    """Events as requests for a date; the place is spelled with prefix and country, errors carry no usable date."""
    requests = table(spark, sf_dir, "events").join(
        table(spark, sf_dir, "region"), F.col("user_id") % 5 == F.col("r_regionkey")
    ).select(
        "event_id",
        F.concat(F.lit("Greater "), F.initcap("r_name"), F.lit(", United Kingdom")).alias("place"),
        F.when(F.col("event_type") == "error", "soon").otherwise(F.date_format("ts", "yyyy-MM-dd")).alias("day"),
    )
    adjusted = season_adjustment(requests, index(spark, sf_dir), F.col("place"), F.col("day"))
    return adjusted.select("event_id", six(F.col("calendar_adjustment_log")).alias("calendar_adjustment_log"))


@workload("season_label", """
SELECT event_id, CASE WHEN value - 20 > 10 THEN 'PEAK' WHEN value - 20 < -10 THEN 'LOW' ELSE 'NORMAL' END AS season
FROM events""")
def season_label_query(spark, sf_dir):
    return table(spark, sf_dir, "events").select("event_id", season_label(F.col("value") - 20).alias("season"))
