"""Matching of typed place names."""

from pyspark.sql import functions as F

from staygauge.operators.matching import match_places
from staygauge.workloads.registry import six, table, workload


def _locations(spark, sf_dir):
    nations = table(spark, sf_dir, "nation").select(F.lower("n_name").alias("location"))
    return nations.unionByName(table(spark, sf_dir, "region").select(F.lower("r_name").alias("location")))


@workload("fuzzy_location", """
WITH locations AS (SELECT DISTINCT lower(n_name) AS location FROM nation UNION SELECT DISTINCT lower(r_name) FROM region),
typed AS (SELECT c_custkey, CASE c_custkey % 4 WHEN 0 THEN ' ' || n_name || ' ' WHEN 1 THEN 'Greater ' || n_name || ' area' WHEN 2 THEN upper(substr(r_name, 1, 4))
    ELSE n_name || ' in ' || r_name END AS place
  FROM customer JOIN nation ON c_nationkey = n_nationkey JOIN region ON n_regionkey = r_regionkey),
scored AS (SELECT DISTINCT place, location, CASE WHEN location = lower(trim(place)) THEN 100
    WHEN contains(lower(trim(place)), location) OR contains(location, lower(trim(place))) THEN 60 + least(length(location), length(trim(place))) END AS score
  FROM (SELECT DISTINCT place FROM typed), locations),
best AS (SELECT * FROM scored WHERE score IS NOT NULL QUALIFY row_number() OVER (PARTITION BY place ORDER BY score DESC, location) = 1)
SELECT c_custkey, place, location, CAST(score AS DOUBLE) AS score FROM typed LEFT JOIN best USING (place)""")
def fuzzy_location(spark, sf_dir):
    """Equal and contained names: these two tiers decide every one of these texts."""
    kind, nation = F.col("c_custkey") % 4, F.col("n_name")
    typed = (
        table(spark, sf_dir, "customer").join(table(spark, sf_dir, "nation"), F.col("c_nationkey") == F.col("n_nationkey"))
        .join(table(spark, sf_dir, "region"), F.col("n_regionkey") == F.col("r_regionkey"))
        .select("c_custkey", F.when(kind == 0, F.concat(F.lit(" "), nation, F.lit(" ")))
                .when(kind == 1, F.concat(F.lit("Greater "), nation, F.lit(" area"))).when(kind == 2, F.upper(F.substring("r_name", 1, 4)))
                .otherwise(F.concat(nation, F.lit(" in "), F.col("r_name"))).alias("place"))
    )
    return match_places(typed, _locations(spark, sf_dir))


# The sequence ratio in SQL: of two texts the longest common block, the first one in the name, then in the typed text; the parts
# before and after it go on by themselves. A block is (length, -start in the name, -start in the typed text).
_BLOCK = """list_max(list_prepend({'k': 0, 'i': 0, 'j': 0}, flatten(list_transform(range(1, length(a) + 1), lambda i:
    flatten(list_transform(range(1, length(b) + 1), lambda j: list_transform(
        list_filter(range(1, least(length(a) - i, length(b) - j) + 2), lambda k: a[i:i + k - 1] = b[j:j + k - 1]),
        lambda k: {'k': k, 'i': -i, 'j': -j})))))))"""


@workload("fuzzy_location_ratio", f"""
WITH RECURSIVE locations AS (SELECT DISTINCT lower(n_name) AS location FROM nation UNION SELECT DISTINCT lower(r_name) FROM region),
typed AS (SELECT c_custkey, translate(n_name, 'TO', '70') || CASE WHEN c_custkey % 3 = 0 THEN 'x' ELSE '' END AS place
  FROM customer JOIN nation ON c_nationkey = n_nationkey),
pairs AS (SELECT place, lower(trim(place)) AS clean, location FROM (SELECT DISTINCT place FROM typed), locations),
parts(place, location, a, b, block) AS (
  SELECT place, location, a, b, {_BLOCK} FROM (SELECT place, location, location AS a, clean AS b FROM pairs)
  UNION ALL
  SELECT place, location, a, b, {_BLOCK} FROM (
    SELECT place, location, unnest([a[:-block.i - 1], a[block.k - block.i:]]) AS a, unnest([b[:-block.j - 1], b[block.k - block.j:]]) AS b
    FROM parts WHERE block.k > 0)),
ratios AS (SELECT place, location, sum(block.k) AS common FROM parts GROUP BY place, location),
scored AS (
  SELECT place, location, CASE WHEN clean = location THEN 100 WHEN contains(clean, location) OR contains(location, clean)
    THEN 60 + least(length(location), length(clean)) WHEN 4 * common > length(clean) + length(location)
    THEN 100.0 * common / (length(clean) + length(location)) END AS score FROM pairs JOIN ratios USING (place, location)),
best AS (SELECT * FROM scored WHERE score IS NOT NULL QUALIFY row_number() OVER (PARTITION BY place ORDER BY score DESC, location) = 1)
SELECT c_custkey, place, location, round(score, 6) + 0.0 AS score FROM typed LEFT JOIN best USING (place)""")
def fuzzy_location_ratio(spark, sf_dir):
    """Misspelled names: only the sequence ratio finds them."""
    typed = table(spark, sf_dir, "customer").join(table(spark, sf_dir, "nation"), F.col("c_nationkey") == F.col("n_nationkey")).select(
        "c_custkey", F.concat(F.translate("n_name", "TO", "70"), F.when(F.col("c_custkey") % 3 == 0, "x").otherwise("")).alias("place"))
    matched = match_places(typed, _locations(spark, sf_dir))
    return matched.withColumn("score", six(F.col("score")))
