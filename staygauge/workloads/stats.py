"""Aggregations, medians with fallback, top groups, splits and samples."""

from pyspark.sql import functions as F

from staygauge.operators import stats
from staygauge.operators.outliers import drop_coordinate_outliers, flag_coordinate_outliers
from staygauge.workloads.registry import six, table, workload
from staygauge.workloads.standins import GLOBE_SQL, TOWN_SQL, globe_points, town_points

@workload("top_cities", """
WITH t AS (SELECT c_nationkey FROM customer GROUP BY 1 ORDER BY count(*) DESC, 1 LIMIT 7)
SELECT c_custkey, c_nationkey FROM customer WHERE c_nationkey IN (SELECT c_nationkey FROM t)""")
def top_cities(spark, sf_dir):
    return stats.keep_top_groups(table(spark, sf_dir, "customer").select("c_custkey", "c_nationkey"), "c_nationkey", 7)


@workload("distinct_cities", """
SELECT DISTINCT n_name AS city FROM supplier JOIN nation ON s_nationkey = n_nationkey""")
def distinct_cities(spark, sf_dir):
    rows = table(spark, sf_dir, "supplier").join(table(spark, sf_dir, "nation"), F.col("s_nationkey") == F.col("n_nationkey"))
    return stats.distinct_values(rows.select(F.col("n_name").alias("city")), "city")


@workload("city_statistics", f"""
WITH {GLOBE_SQL}
SELECT city, round(quantile_disc(ln(1 + abs(c_acctbal)), 0.5), 6) + 0.0 AS median_city, quantile_disc(lat, 0.5) + 0.0 AS center_lat,
  quantile_disc(long, 0.5) + 0.0 AS center_lon
FROM globe GROUP BY city""")
def city_statistics(spark, sf_dir):
    rows = globe_points(spark, sf_dir).withColumn("price_cleaned", F.log1p(F.abs("c_acctbal")))
    return stats.city_statistics(rows).select(
        "city", six(F.col("median_city")).alias("median_city"), (F.col("center_lat") + 0.0).alias("center_lat"),
        (F.col("center_lon") + 0.0).alias("center_lon"))


CLUSTERED = """
priced AS (
  SELECT o_orderkey, n_name AS city, CASE WHEN o_orderkey % 4 = 0 THEN -1 ELSE o_custkey % 6 END AS cluster_id,
    ln(1 + o_totalprice) AS price_cleaned, (o_orderkey * 7919) % 100 < 85 AND n_nationkey <> 7 AS is_train
  FROM orders JOIN customer ON o_custkey = c_custkey JOIN nation ON c_nationkey = n_nationkey
)"""


@workload("median_fallback", f"""
WITH {CLUSTERED},
cities AS (SELECT city, quantile_disc(price_cleaned, 0.5) AS m FROM priced WHERE is_train GROUP BY city),
clusters AS (SELECT city, cluster_id, quantile_disc(price_cleaned, 0.5) AS m FROM priced WHERE is_train AND cluster_id <> -1 GROUP BY ALL),
overall AS (SELECT quantile_disc(price_cleaned, 0.5) AS m FROM priced WHERE is_train)
SELECT o_orderkey, round(coalesce(cities.m, overall.m), 6) + 0.0 AS median_city,
  round(coalesce(clusters.m, cities.m, overall.m), 6) + 0.0 AS cluster_median
FROM priced CROSS JOIN overall LEFT JOIN cities USING (city)
LEFT JOIN clusters ON clusters.city = priced.city AND clusters.cluster_id = priced.cluster_id""")
def median_fallback(spark, sf_dir):
    """Medians of the training rows on all rows; nation 7 has no training rows and takes the overall median."""
    rows = (
        table(spark, sf_dir, "orders").select("o_orderkey", "o_custkey", "o_totalprice")
        .join(table(spark, sf_dir, "customer").select("c_custkey", "c_nationkey"), F.col("o_custkey") == F.col("c_custkey"))
        .join(table(spark, sf_dir, "nation"), F.col("c_nationkey") == F.col("n_nationkey"))
        .select(
            "o_orderkey", F.col("n_name").alias("city"),
            F.when(F.col("o_orderkey") % 4 == 0, -1).otherwise(F.col("o_custkey") % 6).alias("cluster_id"),
            F.log1p("o_totalprice").alias("price_cleaned"),
            ((F.col("o_orderkey") * 7919 % 100 < 85) & (F.col("n_nationkey") != 7)).alias("is_train"))
    )
    train = rows.filter("is_train")
    cities, clusters, overall = stats.fallback_medians(train.withColumns({"lat": F.lit(0.0), "long": F.lit(0.0)}))
    with_city = stats.with_city_median(rows, cities, overall)
    full = stats.with_cluster_median(with_city, clusters, overall)
    return full.select("o_orderkey", six(F.col("median_city")).alias("median_city"), six(F.col("cluster_median")).alias("cluster_median"))


@workload("non_null_counts", """
SELECT 'big_value' AS feature, count(CASE WHEN value > 20 THEN value END) AS non_null, count(*) AS rows FROM events
UNION ALL SELECT 'click_user', count(CASE WHEN event_type = 'click' THEN user_id END), count(*) FROM events
UNION ALL SELECT 'never', 0, count(*) FROM events""")
def non_null_counts(spark, sf_dir):
    rows = table(spark, sf_dir, "events").select(
        F.when(F.col("value") > 20, F.col("value")).alias("big_value"),
        F.when(F.col("event_type") == "click", F.col("user_id")).alias("click_user"), F.lit(None).cast("double").alias("never"))
    return stats.non_null_counts(rows, rows.columns)


@workload("hash_split", """
SELECT l_orderkey, l_partkey, l_linenumber,
  CASE WHEN (l_orderkey * 7919 + l_linenumber * 104729) % 100 < 85 THEN 'train' ELSE 'validation' END AS split FROM lineitem""")
def hash_split(spark, sf_dir):
    bucket = F.pmod(F.col("l_orderkey") * 7919 + F.col("l_linenumber") * 104729, F.lit(100))
    return stats.with_split(table(spark, sf_dir, "lineitem"), bucket).select("l_orderkey", "l_partkey", "l_linenumber", "split")


LINE_KEY = ["l_orderkey", "l_partkey", "l_suppkey", "l_linenumber"]


@workload("sample_rows", f"""
SELECT {", ".join(LINE_KEY)} FROM lineitem ORDER BY md5(concat_ws('|', 42, {", ".join(LINE_KEY)})), {", ".join(LINE_KEY)} LIMIT 5000""")
def sample_rows(spark, sf_dir):
    return stats.sample_rows(table(spark, sf_dir, "lineitem").select(*LINE_KEY), 5000, LINE_KEY)


OUTLIER_SQL = """
places AS (SELECT c_custkey, city, CASE WHEN c_custkey % 31 = 0 THEN NULL WHEN c_custkey % 50 = 7 THEN lat + 60 ELSE lat END AS lat, long FROM town),
b AS (SELECT city, quantile_cont(lat, [0.25, 0.75]) AS qa, quantile_cont(long, [0.25, 0.75]) AS qo FROM places WHERE lat IS NOT NULL GROUP BY city HAVING count(*) >= 10),
flagged AS (SELECT c_custkey, places.city, lat IS NOT NULL AND NOT (
    lat BETWEEN qa[1] - 3 * (qa[2] - qa[1]) AND qa[2] + 3 * (qa[2] - qa[1])
    AND long BETWEEN qo[1] - 3 * (qo[2] - qo[1]) AND qo[2] + 3 * (qo[2] - qo[1])) AS is_outlier
  FROM places JOIN b ON places.city = b.city)"""


def _strays(spark, sf_dir):
    key = F.col("c_custkey")
    return town_points(spark, sf_dir).withColumn(
        "lat", F.when(key % 31 == 0, None).when(key % 50 == 7, F.col("lat") + 60).otherwise(F.col("lat")))


@workload("geo_outliers", f"WITH {TOWN_SQL}, {OUTLIER_SQL} SELECT c_custkey, city FROM flagged WHERE NOT is_outlier")
def geo_outliers(spark, sf_dir):
    return drop_coordinate_outliers(_strays(spark, sf_dir)).select("c_custkey", "city")


@workload("geo_outlier_flags", f"WITH {TOWN_SQL}, {OUTLIER_SQL} SELECT city, is_outlier, count(*) AS listings FROM flagged GROUP BY ALL")
def geo_outlier_flags(spark, sf_dir):
    return flag_coordinate_outliers(_strays(spark, sf_dir)).groupBy("city", "is_outlier").agg(F.count(F.lit(1)).alias("listings"))


@workload("exact_quartiles", """
SELECT l_returnflag, m AS measure, round(quantile_cont(v, 0.25), 6) + 0.0 AS q1, round(quantile_cont(v, 0.75), 6) + 0.0 AS q3
FROM (SELECT l_returnflag, 'l_extendedprice' AS m, l_extendedprice AS v FROM lineitem UNION ALL SELECT l_returnflag, 'l_quantity', l_quantity FROM lineitem)
GROUP BY ALL""")
def exact_quartiles(spark, sf_dir):
    """Groups larger than the sketch's accuracy: the narrowed search still gives the exact quartiles."""
    q = stats.exact_quantiles(table(spark, sf_dir, "lineitem"), ["l_returnflag"], ["l_extendedprice", "l_quantity"], [0.25, 0.75])
    return q.select("l_returnflag", "measure", six(F.col("quantiles")[0]).alias("q1"), six(F.col("quantiles")[1]).alias("q3"))
