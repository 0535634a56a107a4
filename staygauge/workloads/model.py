"""Model preparation, training, quality, reports, scoring."""

from pyspark.ml import Pipeline
from pyspark.ml.functions import vector_to_array
from pyspark.sql import functions as F

from staygauge import fixed_values as fixed
from staygauge.operators import reports
from staygauge.operators.extraction import parse_pages
from staygauge.operators.geography import geography_index, with_cluster, with_geography
from staygauge.operators.model import FeatureSet, feature_category, predict, preparation_stages, regression_metrics, scored_sample
from staygauge.operators.stats import city_statistics, cluster_statistics, overall_median
from staygauge.plans.scoring import score_captures, scoring_error
from staygauge.plans.training import SPLIT_KEY, train_engine, training_tables
from staygauge.operators.listing import listing_features
from staygauge.session import new_folder, settle
from staygauge.sources.artifacts import load_engine, save_engine
from staygauge.workloads.geo import centres
from staygauge.workloads.pages import captures
from staygauge.workloads.registry import six, table, workload
from staygauge.workloads.season import index
from staygauge.workloads.standins import PAGES_SQL, SEASON_SQL, TOWN_SQL, captured_pages, raw_listings, sql_km, town_points

_ENGINES = {}


def engine(spark, sf_dir):
    """One engine per session and table folder, as it is trained in production; several queries use it."""
    key = (spark.sparkContext.applicationId, sf_dir)
    if key not in _ENGINES:
        _ENGINES[key] = train_engine(raw_listings(spark, sf_dir), index(spark, sf_dir))
    return _ENGINES[key]


# ---- preparation ----------------------------------------------------------------------------------
@workload("impute_scale", """
WITH r AS (
  SELECT l_orderkey, l_partkey, l_linenumber, CASE WHEN l_linenumber = 1 THEN NULL ELSE l_quantity END AS a,
    CASE WHEN l_linenumber = 2 THEN NULL ELSE l_extendedprice END AS b, CASE WHEN l_linenumber = 3 THEN NULL ELSE CAST(l_tax > 0.02 AS INTEGER) END AS c
  FROM lineitem),
s AS (SELECT quantile_disc(a, 0.5) AS ma, quantile_disc(b, 0.5) AS mb, CASE WHEN sum(c) > count(c) - sum(c) THEN 1 ELSE 0 END AS mc FROM r),
f AS (SELECT l_orderkey, l_partkey, l_linenumber, coalesce(a, ma) AS a, coalesce(b, mb) AS b, coalesce(c, mc) AS c FROM r, s),
m AS (SELECT avg(a) AS aa, stddev_samp(a) AS sa, avg(b) AS ab, stddev_samp(b) AS sb FROM f)
SELECT l_orderkey, l_partkey, l_linenumber, round((a - aa) / sa, 6) + 0.0 AS quantity, round((b - ab) / sb, 6) + 0.0 AS price, CAST(c AS DOUBLE) AS taxed FROM f, m""")
def impute_scale(spark, sf_dir):
    line = F.col("l_linenumber")
    rows = table(spark, sf_dir, "lineitem").select(
        "l_orderkey", "l_partkey", "l_linenumber", F.when(line != 1, F.col("l_quantity")).alias("quantity"),
        F.when(line != 2, F.col("l_extendedprice")).alias("price"), F.when(line != 3, (F.col("l_tax") > 0.02).cast("int")).alias("taxed"))
    stages = preparation_stages(FeatureSet(("quantity", "price"), ("taxed",)), median_error=0.0)
    ready = Pipeline(stages=stages).fit(rows).transform(rows).withColumn("v", vector_to_array("features"))
    return ready.select("l_orderkey", "l_partkey", "l_linenumber", six(F.col("v")[0]).alias("quantity"), six(F.col("v")[1]).alias("price"),
                        F.col("v")[2].alias("taxed"))


@workload("regression_metrics", """
WITH r AS (SELECT l_returnflag, ln(1 + l_extendedprice) AS y, ln(1 + p_retailprice * l_quantity) AS p FROM lineitem JOIN part ON l_partkey = p_partkey),
s AS (SELECT l_returnflag, count(*) AS n, sum((y - p) * (y - p)) AS sse, avg(abs(y - p)) AS mae, var_pop(y) * count(*) AS sst,
  quantile_disc(abs(y - p), 0.5) AS medae, avg(abs((y - p) / y)) * 100 AS mape FROM r GROUP BY l_returnflag)
SELECT l_returnflag, n, round(sqrt(sse / n), 6) + 0.0 AS "RMSE", round(mae, 6) + 0.0 AS "MAE", round(1 - sse / sst, 6) + 0.0 AS "R2",
  round(1 - (sse / sst) * (n - 1) / (n - 2 - 1), 6) + 0.0 AS "Adj_R2", round(medae, 6) + 0.0 AS "MedAE", round(mape, 6) + 0.0 AS "MAPE" FROM s""")
def regression_metrics_query(spark, sf_dir):
    rows = table(spark, sf_dir, "lineitem").join(table(spark, sf_dir, "part"), F.col("l_partkey") == F.col("p_partkey")).select(
        "l_returnflag", F.log1p("l_extendedprice").alias("price_cleaned"), F.log1p(F.col("p_retailprice") * F.col("l_quantity")).alias("prediction"))
    found = regression_metrics(rows, ["l_returnflag"], 2)
    return found.select("l_returnflag", "n", *[six(F.col(c)).alias(c) for c in ("RMSE", "MAE", "R2", "Adj_R2", "MedAE", "MAPE")])


# ---- training ----------------------------------------------------------------------------------------
@workload("training_tables")
def training_tables_query(spark, sf_dir):
    """Split, clusters and medians of all listings; iterative clustering, checked on a fixture instead of by SQL."""
    rows = training_tables(listing_features(raw_listings(spark, sf_dir)))
    return rows.select("city", "split", "cluster_id", "price_cleaned", "median_city", "cluster_median")


@workload("train_engine")
def train_engine_query(spark, sf_dir):
    """The whole training; its result is the quality on both splits."""
    return engine(spark, sf_dir).metrics


@workload("score_training_rows")
def score_training_rows(spark, sf_dir):
    e = engine(spark, sf_dir)
    rows = training_tables(listing_features(raw_listings(spark, sf_dir)))
    return predict(rows, e.model).select("city", "split", "price_cleaned", "prediction", "prediction_real")


@workload("prediction_sample")
def prediction_sample(spark, sf_dir):
    """1000 scored listings of the training tables."""
    e = engine(spark, sf_dir)
    rows = training_tables(listing_features(raw_listings(spark, sf_dir)))
    return scored_sample(predict(rows, e.model), [c for c in SPLIT_KEY if c in rows.columns])


@workload("artifact_roundtrip", f"""
WITH {SEASON_SQL}
SELECT city, date, round(price_relative, 6) + 0.0 AS price_relative, stoplight FROM season""")
def artifact_roundtrip(spark, sf_dir):
    """Everything an engine holds, saved and loaded again; the loaded season index is the result."""
    folder = new_folder(spark, "engine")
    save_engine(engine(spark, sf_dir), folder)
    return load_engine(spark, folder).season.withColumn("price_relative", six(F.col("price_relative")))


# ---- reports -----------------------------------------------------------------------------------------
@workload("feature_importance")
def feature_importance(spark, sf_dir):
    e = engine(spark, sf_dir)
    return reports.feature_importance(spark, e.model, e.features)


@workload("importance_by_category")
def importance_by_category(spark, sf_dir):
    e = engine(spark, sf_dir)
    return reports.importance_by_category(reports.feature_importance(spark, e.model, e.features))


# Importances made from a given table: every feature's share of the account balances of its customers.
IMPORTANCE_SQL = "features(feature, category, k) AS (VALUES " + ", ".join(
    f"('{f}', '{c}', {k})" for k, (f, c) in enumerate(fixed.FEATURE_CATEGORY.items())) + f"""),
importances AS (SELECT feature, category, sum(abs(c_acctbal)) AS importance FROM customer JOIN features ON c_custkey % {len(fixed.FEATURE_CATEGORY)} = k GROUP BY ALL)"""


def _importances(spark, sf_dir):
    names = F.array(*[F.lit(f) for f in fixed.FEATURE_CATEGORY])
    rows = table(spark, sf_dir, "customer").select(
        F.get(names, (F.col("c_custkey") % len(fixed.FEATURE_CATEGORY)).cast("int")).alias("feature"), F.abs("c_acctbal").alias("x"))
    sums = rows.groupBy("feature").agg(F.sum("x").alias("importance"))
    return sums.withColumn("category", feature_category(F.col("feature")))


@workload("importance_by_category_table", f"""
WITH {IMPORTANCE_SQL} SELECT category, round(sum(importance), 6) + 0.0 AS importance FROM importances GROUP BY category""")
def importance_by_category_table(spark, sf_dir):
    found = reports.importance_by_category(_importances(spark, sf_dir))
    return found.withColumn("importance", six(F.col("importance")))


@workload("top_features_table", f"""
WITH {IMPORTANCE_SQL} SELECT feature, category, round(importance, 6) + 0.0 AS importance FROM importances ORDER BY importances.importance DESC, feature LIMIT 15""")
def top_features_table(spark, sf_dir):
    return reports.top_features(_importances(spark, sf_dir), 15).withColumn("importance", six(F.col("importance")))


@workload("top_features")
def top_features(spark, sf_dir):
    e = engine(spark, sf_dir)
    return reports.top_features(reports.feature_importance(spark, e.model, e.features), 15)


MEASURES = ["l_quantity", "l_extendedprice", "l_discount", "l_tax"]


@workload("correlations", " UNION ALL ".join(
    f"SELECT '{b}' AS feature_a, '{a}' AS feature_b, round(corr({b}, {a}), 6) + 0.0 AS r FROM lineitem"
    for i, a in enumerate(MEASURES) for b in MEASURES[i + 1:]))
def correlations(spark, sf_dir):
    return reports.correlations(table(spark, sf_dir, "lineitem"), MEASURES, -1.0).withColumn("r", six(F.col("r")))


@workload("strong_correlations", """
WITH r AS (SELECT l_quantity, l_extendedprice, l_extendedprice * (1 - l_discount) AS revenue FROM lineitem)
SELECT feature_a, feature_b, round(r, 6) + 0.0 AS r FROM (
  SELECT 'l_extendedprice' AS feature_a, 'l_quantity' AS feature_b, corr(l_extendedprice, l_quantity) AS r FROM r
  UNION ALL SELECT 'revenue', 'l_quantity', corr(revenue, l_quantity) FROM r
  UNION ALL SELECT 'revenue', 'l_extendedprice', corr(revenue, l_extendedprice) FROM r) WHERE abs(r) > 0.5""")
def strong_correlations(spark, sf_dir):
    rows = table(spark, sf_dir, "lineitem").withColumn("revenue", F.col("l_extendedprice") * (1 - F.col("l_discount")))
    return reports.correlations(rows, ["l_quantity", "l_extendedprice", "revenue"], 0.5).withColumn("r", six(F.col("r")))


@workload("feature_distribution", " UNION ALL ".join(f"""
SELECT '{c}' AS feature, count(*) AS n, round(avg({c}), 6) + 0.0 AS mean, quantile_disc({c}, 0.5) + 0.0 AS median, round(stddev_samp({c}), 6) + 0.0 AS std,
  round(avg(pow(({c} - m) / s, 3)), 6) + 0.0 AS skew, min({c}) AS low, max({c}) AS high
FROM lineitem, (SELECT avg({c}) AS m, stddev_pop({c}) AS s FROM lineitem)""" for c in MEASURES))
def feature_distribution(spark, sf_dir):
    found = reports.distribution_summary(table(spark, sf_dir, "lineitem"), MEASURES)
    return found.select("feature", "n", "median", "low", "high", *[six(F.col(c)).alias(c) for c in ("mean", "std", "skew")])


@workload("feature_histogram", " UNION ALL ".join(f"""
SELECT feature, bin, round(low + bin * w, 6) + 0.0 AS left_edge, round(low + (bin + 1) * w, 6) + 0.0 AS right_edge, count(*) AS n
FROM (SELECT '{c}' AS feature, low, w, CAST(least(floor(({c} - low) / w), 29) AS INTEGER) AS bin
  FROM lineitem, (SELECT min({c}) AS low, (max({c}) - min({c})) / 30 AS w FROM lineitem)) GROUP BY ALL""" for c in ("l_quantity", "l_extendedprice")))
def feature_histogram(spark, sf_dir):
    found = reports.histogram(table(spark, sf_dir, "lineitem"), ["l_quantity", "l_extendedprice"])
    return found.select("feature", "bin", "n", six(F.col("left_edge")).alias("left_edge"), six(F.col("right_edge")).alias("right_edge"))


@workload("feature_impact", " UNION ALL ".join(f"""
SELECT feature, bin, round((low + bin * w - CASE WHEN bin = 0 THEN 20 * w * 0.001 ELSE 0 END + low + (bin + 1) * w) / 2, 6) + 0.0 AS center,
  round(avg(p), 6) + 0.0 AS mean, round(stddev_samp(p), 6) + 0.0 AS std, count(*) AS n,
  round(avg(p) - stddev_samp(p), 6) + 0.0 AS band_low, round(avg(p) + stddev_samp(p), 6) + 0.0 AS band_high
FROM (SELECT '{c}' AS feature, low, w, CAST(least(greatest(ceil(({c} - low) / w) - 1, 0), 19) AS INTEGER) AS bin, ln(1 + l_extendedprice) AS p
  FROM lineitem, (SELECT min({c}) AS low, (max({c}) - min({c})) / 20 AS w FROM lineitem)) GROUP BY feature, low, w, bin HAVING count(*) >= 5"""
    for c in ("l_quantity", "l_extendedprice")))
def feature_impact(spark, sf_dir):
    scored = table(spark, sf_dir, "lineitem").withColumn("prediction", F.log1p("l_extendedprice"))
    found = reports.feature_impact(scored, ["l_quantity", "l_extendedprice"])
    return found.select("feature", "bin", "n", *[six(F.col(c)).alias(c) for c in ("center", "mean", "std", "band_low", "band_high")])


# ---- geography of scored pages -------------------------------------------------------------------------
TOWN_CENTRES = "centres AS (SELECT city, quantile_disc(lat, 0.5) AS clat, quantile_disc(long, 0.5) AS clon FROM town GROUP BY city)"
HAS_CLUSTERS = "n_nationkey % 3 <> 0"


def _town(spark, sf_dir):
    points, key = town_points(spark, sf_dir), F.col("c_custkey")
    known = points.filter((key % 9 != 0) & (F.regexp_extract("city", r"(\d+)$", 1).cast("int") % 3 != 0))
    return points, known.select("city", "lat", "long", (key % 2).alias("cluster_id"), F.log1p(F.abs("c_acctbal")).alias("price_cleaned"))


GEO_SQL = f"""
known AS (SELECT city, lat, long, c_custkey % 2 AS cluster_id, ln(1 + abs(c_acctbal)) AS price FROM town JOIN nation ON city = n_name
  WHERE c_custkey % 9 <> 0 AND {HAS_CLUSTERS}),
near AS (SELECT c_custkey, lat, long, centres.city, {sql_km("lat", "long", "clat", "clon")} AS km FROM town, centres),
first_city AS (SELECT * FROM near QUALIFY row_number() OVER (PARTITION BY c_custkey ORDER BY km, city) = 1),
fallback AS (SELECT * FROM near WHERE city IN (SELECT city FROM known) QUALIFY row_number() OVER (PARTITION BY c_custkey ORDER BY km, city) = 1),
target AS (SELECT f.c_custkey, f.lat, f.long, f.city AS nearest_city,
    CASE WHEN f.city IN (SELECT city FROM known) THEN f.city WHEN b.km <= 900 THEN b.city END AS cluster_city
  FROM first_city f JOIN fallback b USING (c_custkey)),
placed AS (SELECT t.c_custkey, t.nearest_city, t.cluster_city, coalesce(k.cluster_id, -1) AS cluster_id FROM target t LEFT JOIN known k ON k.city = t.cluster_city
  QUALIFY row_number() OVER (PARTITION BY t.c_custkey ORDER BY round(sqrt(pow(t.lat - k.lat, 2) + pow(t.long - k.long, 2)), 9), k.cluster_id) = 1)"""


@workload("cluster_fallback", f"WITH {TOWN_SQL}, {TOWN_CENTRES}, {GEO_SQL} SELECT c_custkey, nearest_city, cluster_city, cluster_id FROM placed")
def cluster_fallback(spark, sf_dir):
    """A third of the towns have no clusters; their places look in the nearest town that has, up to 900 km away."""
    from staygauge.operators.neighbours import nearest_city

    points, known = _town(spark, sf_dir)
    places = geography_index(centres(points), known.select("city", "lat", "long", "cluster_id"))
    found = with_cluster(nearest_city(points, places.centres), places, within_km=900)
    return found.select("c_custkey", "nearest_city", "cluster_city", "cluster_id")


@workload("page_geography", f"""
WITH {TOWN_SQL}, {TOWN_CENTRES}, {GEO_SQL.replace("900", "50")},
prices AS (SELECT city, ln(1 + abs(c_acctbal)) AS price FROM town),
city_m AS (SELECT city, quantile_disc(price, 0.5) AS m FROM prices GROUP BY city), all_m AS (SELECT quantile_disc(price, 0.5) AS m FROM prices),
cluster_m AS (SELECT city, cluster_id, quantile_disc(price, 0.5) AS m FROM known GROUP BY ALL)
SELECT c_custkey, nearest_city, p.cluster_id, round(coalesce(city_m.m, all_m.m), 6) + 0.0 AS median_city,
  round(coalesce(cluster_m.m, city_m.m, all_m.m), 6) + 0.0 AS cluster_median
FROM placed p CROSS JOIN all_m LEFT JOIN city_m ON city_m.city = p.nearest_city
LEFT JOIN cluster_m ON cluster_m.city = p.cluster_city AND cluster_m.cluster_id = p.cluster_id""")
def page_geography(spark, sf_dir):
    points, known = _town(spark, sf_dir)
    priced = points.withColumn("price_cleaned", F.log1p(F.abs("c_acctbal")))
    cities = settle(city_statistics(priced), "cities")
    places = geography_index(cities, known.select("city", "lat", "long", "cluster_id"))
    found = with_geography(points, cities, cluster_statistics(known), places, overall_median(priced))
    return found.select("c_custkey", "nearest_city", "cluster_id", *[six(F.col(c)).alias(c) for c in ("median_city", "cluster_median")])


# ---- scoring -----------------------------------------------------------------------------------------------
@workload("scoring_errors", f"""
WITH {PAGES_SQL} SELECT k, CASE WHEN NOT over THEN 'Missing critical fields: [''city'']' END AS error FROM expected""")
def scoring_errors(spark, sf_dir):
    return parse_pages(captures(spark, sf_dir)).select(F.col("listing_id").cast("long").alias("k"), scoring_error().alias("error"))


@workload("score_captures")
def score_captures_query(spark, sf_dir):
    """Captured pages to predictions: which pages are scored is certain, the predicted prices depend on the trees."""
    scored = score_captures(captured_pages(spark, sf_dir), engine(spark, sf_dir))
    p = "prediction."
    return scored.select(
        "listing_id", "status", p + "predicted_price_per_night_usd", p + "predicted_price_base_usd", p + "calendar_adjustment_log",
        p + "listed_price_per_night_usd", p + "difference_usd", p + "difference_pct", p + "city", p + "cluster_id", p + "currency",
        p + "listed_price_original", p + "stoplight", p + "assessment", p + "error")
