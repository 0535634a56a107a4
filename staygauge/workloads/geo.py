"""Nearest city, nearest cluster, neighbourhood clusters."""

from pyspark.sql import functions as F

from staygauge.operators.density import city_cluster_view, city_radius, density_clusters
from staygauge.operators.neighbours import knn_vote, nearest_city, nearest_cluster, neighbour_distance
from staygauge.operators.stats import city_statistics, top_groups
from staygauge.workloads.registry import six, workload
from staygauge.workloads.standins import GLOBE_SQL, TOWN_SQL, globe_points, sql_km, town_points

CENTRES = "centres AS (SELECT city, quantile_disc(lat, 0.5) AS clat, quantile_disc(long, 0.5) AS clon FROM globe GROUP BY city)"


def centres(points):
    return city_statistics(points.withColumn("price_cleaned", F.lit(0.0))).select("city", "center_lat", "center_lon")


NEAREST = f"""
WITH {GLOBE_SQL}, {CENTRES},
ranked AS (SELECT c_custkey, centres.city, {sql_km("lat", "long", "clat", "clon")} AS km FROM globe, centres)
SELECT c_custkey, {{city}} AS nearest_city, {{km}} AS nearest_city_km FROM ranked
QUALIFY row_number() OVER (PARTITION BY c_custkey ORDER BY km, city) = 1"""


@workload("nearest_city", NEAREST.format(city="city", km="km"))
def nearest_city_query(spark, sf_dir):
    points = globe_points(spark, sf_dir)
    return nearest_city(points, centres(points)).select("c_custkey", "nearest_city", "nearest_city_km")


@workload("nearest_city_within", NEAREST.format(city="CASE WHEN km <= 3000 THEN city END", km="CASE WHEN km <= 3000 THEN km END"))
def nearest_city_within(spark, sf_dir):
    points = globe_points(spark, sf_dir)
    return nearest_city(points, centres(points), within_km=3000).select("c_custkey", "nearest_city", "nearest_city_km")


# Cluster points: all customers but the strays; the quarter they live in is their cluster. Every customer asks.
KNOWN = "known AS (SELECT c_custkey, city, lat, long, c_custkey % 2 AS cluster_id FROM town WHERE c_custkey % 9 <> 0)"


def _sides(spark, sf_dir):
    points, key = town_points(spark, sf_dir), F.col("c_custkey")
    quarter = points.withColumn("cluster_id", F.when(key % 9 == 0, -1).otherwise(key % 2))
    return points, quarter.filter("cluster_id != -1").select("city", "lat", "long", "cluster_id")


@workload("knn_assign", f"""
WITH {TOWN_SQL}, {KNOWN},
votes AS (
  SELECT a.c_custkey, k.cluster_id FROM town a JOIN known k USING (city)
  QUALIFY row_number() OVER (PARTITION BY a.c_custkey ORDER BY {sql_km("a.lat", "a.long", "k.lat", "k.long")}, k.cluster_id) <= 10),
winners AS (SELECT c_custkey, cluster_id FROM votes GROUP BY c_custkey, cluster_id QUALIFY row_number() OVER (PARTITION BY c_custkey ORDER BY count(*) DESC, cluster_id) = 1)
SELECT a.c_custkey, coalesce(w.cluster_id, -1) AS cluster_id FROM town a LEFT JOIN winners w USING (c_custkey)""")
def knn_assign(spark, sf_dir):
    points, known = _sides(spark, sf_dir)
    return knn_vote(points, known).select("c_custkey", "cluster_id")


@workload("nn_assign", f"""
WITH {TOWN_SQL}, {KNOWN},
winners AS (
  SELECT a.c_custkey, k.cluster_id FROM town a JOIN known k USING (city)
  QUALIFY row_number() OVER (PARTITION BY a.c_custkey ORDER BY round(sqrt(pow(a.lat - k.lat, 2) + pow(a.long - k.long, 2)), 9), k.cluster_id) = 1)
SELECT a.c_custkey, coalesce(w.cluster_id, -1) AS cluster_id FROM town a LEFT JOIN winners w USING (c_custkey)""")
def nn_assign(spark, sf_dir):
    points, known = _sides(spark, sf_dir)
    return nearest_cluster(points, known).select("c_custkey", "cluster_id")


KTH = f"""
kth AS (
  SELECT a.c_custkey, a.city, {sql_km("a.lat", "a.long", "b.lat", "b.long")} AS km FROM town a JOIN town b USING (city)
  QUALIFY row_number() OVER (PARTITION BY a.c_custkey ORDER BY {sql_km("a.lat", "a.long", "b.lat", "b.long")}) = 10)"""


@workload("neighbour_distance", f"WITH {TOWN_SQL}, {KTH} SELECT c_custkey, km AS kth_km FROM kth")
def neighbour_distance_query(spark, sf_dir):
    return neighbour_distance(town_points(spark, sf_dir), 10).select("c_custkey", "kth_km")


@workload("city_radius", f"WITH {TOWN_SQL}, {KTH} SELECT city, round(greatest(quantile_disc(km, 0.25), 0.0031855), 6) AS radius_km FROM kth GROUP BY city")
def city_radius_query(spark, sf_dir):
    return city_radius(town_points(spark, sf_dir)).withColumn("radius_km", six(F.col("radius_km")))


RADIUS_KM = 0.12


@workload("density_clusters", f"""
WITH RECURSIVE {TOWN_SQL},
near AS (
  SELECT a.c_custkey AS a, b.c_custkey AS b, {sql_km("a.lat", "a.long", "b.lat", "b.long")} AS km FROM town a JOIN town b USING (city)
  WHERE {sql_km("a.lat", "a.long", "b.lat", "b.long")} <= {RADIUS_KM}),
core AS (SELECT a AS k FROM near GROUP BY a HAVING count(*) >= 10),
links AS (SELECT a, b FROM near WHERE a IN (FROM core) AND b IN (FROM core)),
reach(root, k) AS (SELECT k, k FROM core UNION SELECT r.root, l.b FROM reach r JOIN links l ON r.k = l.a),
parts AS (SELECT k, min(root) AS part FROM reach GROUP BY k),
joined AS (
  SELECT k, part, true AS is_core FROM parts UNION ALL
  SELECT a, part, false FROM (SELECT a, p.part FROM near JOIN parts p ON near.b = p.k JOIN town t ON t.c_custkey = p.k
    WHERE a NOT IN (FROM core) QUALIFY row_number() OVER (PARTITION BY a ORDER BY km, t.lat, t.long) = 1)),
kept AS (SELECT part, t.city, min(CASE WHEN is_core THEN {{'lat': t.lat, 'long': t.long}} END) AS corner FROM joined JOIN town t ON t.c_custkey = joined.k
  GROUP BY part, t.city HAVING count(*) >= 10),
numbered AS (SELECT part, row_number() OVER (PARTITION BY city ORDER BY corner) - 1 AS cluster_id FROM kept)
SELECT town.c_custkey, town.city, coalesce(n.cluster_id, -1) AS cluster_id
FROM town LEFT JOIN joined ON joined.k = town.c_custkey LEFT JOIN numbered n USING (part)""")
def density_clusters_query(spark, sf_dir):
    return density_clusters(town_points(spark, sf_dir), RADIUS_KM).select("c_custkey", "city", "cluster_id")


@workload("city_cluster_view")
def city_cluster_view_query(spark, sf_dir):
    """The clusters of the city with most places, with a radius derived from the data; 20 000 of its places at most."""
    city = top_groups(town_points(spark, sf_dir), "city", 1).first()["city"]
    places = town_points(spark, sf_dir).filter(F.col("city") == city)
    return city_cluster_view(density_clusters(places), city, ["c_custkey"])
