"""Group statistics, medians with fallback, top groups, splits and samples."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from staygauge import fixed_values as fixed
from staygauge.session import settle

# A broadcast by hint needs a bound known before the query runs; beyond it the planner chooses by measured size.
MAX_HINTED_ROWS = 10_000


def bounded(df: DataFrame, rows: int) -> DataFrame:
    """Hint a broadcast for a table that cannot have more than ``rows`` rows, if that is few enough."""
    return F.broadcast(df) if rows <= MAX_HINTED_ROWS else df


def top_groups(df: DataFrame, group: str, k: int) -> DataFrame:
    """The k most frequent groups with their row counts; equal counts are ordered by group."""
    counts = df.groupBy(group).agg(F.count(F.lit(1)).alias("listings"))
    return counts.orderBy(F.desc("listings"), F.asc_nulls_last(group)).limit(k)


def keep_top_groups(df: DataFrame, group: str, k: int) -> DataFrame:
    return df.join(bounded(top_groups(df, group, k).select(group), k), group, "left_semi")


def distinct_values(df: DataFrame, column: str) -> DataFrame:
    return df.select(column).distinct().orderBy(column)


def exact_medians(df: DataFrame, by: list[str], columns: dict[str, str]) -> DataFrame:
    """The lower median of each column per group, as columns with the given names; groups without any value are left out."""
    found = exact_quantiles(df, by, list(columns), [0.5], discrete=True)
    return found.groupBy(*by).agg(*[
        F.max(F.when(F.col("measure") == c, F.col("quantiles")[0])).alias(name) for c, name in columns.items()])


def city_statistics(listings: DataFrame) -> DataFrame:
    """Exact median log price and median position per city."""
    return exact_medians(listings, ["city"], {"price_cleaned": "median_city", "lat": "center_lat", "long": "center_lon"})


def cluster_statistics(listings: DataFrame) -> DataFrame:
    """Exact median log price per cluster, without noise."""
    return exact_medians(listings.filter(F.col("cluster_id") != fixed.NO_CLUSTER), ["city", "cluster_id"], {"price_cleaned": "cluster_median"})


def overall_median(listings: DataFrame) -> DataFrame:
    """One row with the exact median log price of all listings."""
    return exact_medians(listings, [], {"price_cleaned": "global_median"})


def fallback_medians(listings: DataFrame) -> tuple[DataFrame, DataFrame, DataFrame]:
    """``city_statistics``, ``cluster_statistics`` and ``overall_median`` of listings (city, cluster_id, price_cleaned, lat, long),
    all three from the same two passes."""
    none = F.lit(None)
    city, cluster, place = F.col("city"), F.col("cluster_id").cast("long"), [F.col("lat").cast("double"), F.col("long").cast("double")]

    def level(n: int, own_city: Column, own_cluster: Column, places: list[Column]) -> Column:
        return F.struct(F.lit(n).alias("level"), own_city.cast("string").alias("city"), own_cluster.cast("long").alias("cluster_id"),
                        F.col("price_cleaned"), *[p.cast("double").alias(name) for p, name in zip(places, ("lat", "long"), strict=True)])

    levels = F.array(level(0, city, none, place), level(1, city, cluster, [none, none]), level(2, none, none, [none, none]))
    rows = listings.select(F.inline(levels)).filter((F.col("level") != 1) | (F.col("cluster_id") != fixed.NO_CLUSTER))
    found = settle(exact_medians(rows, ["level", "city", "cluster_id"], {
        "price_cleaned": "median", "lat": "center_lat", "long": "center_lon"}), "medians")
    return (
        found.filter("level = 0 AND city IS NOT NULL").select("city", F.col("median").alias("median_city"), "center_lat", "center_lon"),
        found.filter("level = 1 AND city IS NOT NULL").select("city", "cluster_id", F.col("median").alias("cluster_median")),
        found.filter("level = 2").select(F.col("median").alias("global_median")))


def with_city_median(df: DataFrame, cities: DataFrame, overall: DataFrame | None = None) -> DataFrame:
    """Add ``median_city``; cities without one take the overall median if it is given."""
    joined = df.join(cities.select("city", "median_city"), "city", "left")
    if overall is None:
        return joined
    return joined.withColumn("median_city", F.coalesce("median_city", overall.scalar()))


def with_cluster_median(df: DataFrame, clusters: DataFrame, overall: DataFrame, cluster: str = "cluster_id") -> DataFrame:
    """Add ``cluster_median``: that of the cluster, else of the city, else of all listings."""
    joined = df.join(clusters.select("city", cluster, "cluster_median"), ["city", cluster], "left")
    return joined.withColumn("cluster_median", F.coalesce("cluster_median", "median_city", overall.scalar()))


def non_null_counts(df: DataFrame, columns: list[str]) -> DataFrame:
    """One row per column with its number of non-NULL values and the number of rows, from one pass."""
    wide = df.agg(F.count(F.lit(1)).alias("rows"), *[F.count(c).alias(c) for c in columns])
    pairs = F.array(*[F.struct(F.lit(c).alias("feature"), F.col(c).alias("non_null")) for c in columns])
    return wide.select(F.explode(pairs).alias("p"), "rows").select("p.feature", "p.non_null", "rows")


def split_bucket(*keys: str) -> Column:
    """Bucket 0..99 of a row's key. It depends on the key only, so a split survives any repartitioning."""
    return F.pmod(F.xxhash64(*keys), F.lit(100))


def with_split(df: DataFrame, bucket: Column, train_percent: int = 85) -> DataFrame:
    return df.withColumn("split", F.when(bucket < train_percent, "train").otherwise("validation"))


def sample_rows(df: DataFrame, rows: int, key: list[str], seed: int = 42) -> DataFrame:
    """``rows`` rows in a hash order of their key: the same rows however the table is partitioned; all if there are fewer."""
    return df.orderBy(F.md5(F.concat_ws("|", F.lit(seed), *key)), *key).limit(rows)


# Shares of a group's rows beside a quantile that are ranked: the sketch errs by 1/ACCURACY of them, which is a rank or less in
# a small group, and the neighbour rank is needed too.
ACCURACY = 10_000
REACH = {"small": 0.03, "large": 3.0 / ACCURACY}
TINY = 100  # rows; in a group below that a rank is more than any such share


def quantile_bands(rows: DataFrame, by: list[str], columns: list[str], probabilities: list[float]) -> DataFrame:
    """(by..., bands): for each column m and probability q that the group has values for, the limits of a band of values that
    is certain to hold the quantile, and the number of values. One pass; sketches merge on the map side."""
    bounds = [min(1.0, max(0.0, p + sign * reach)) for reach in REACH.values() for p in probabilities for sign in (-1, 1)]
    wide = rows.groupBy(*by).agg(*[part for i, c in enumerate(columns) for part in (
        F.percentile_approx(c, bounds, ACCURACY).alias(f"sketch{i}"), F.count(c).alias(f"total{i}"),
        F.min(c).alias(f"lowest{i}"), F.max(c).alias(f"highest{i}"))])

    def limit(i: int, q: int, end: int) -> Column:
        total, ends = F.col(f"total{i}"), (f"lowest{i}", f"highest{i}")
        at = 2 * q + end
        return F.when(total < TINY, F.col(ends[end])).when(total <= ACCURACY, F.col(f"sketch{i}")[at]).otherwise(
            F.col(f"sketch{i}")[2 * len(probabilities) + at])

    bands = F.array(*[
        F.struct(F.lit(i).alias("m"), F.lit(q).alias("q"), F.col(f"total{i}").alias("total"), limit(i, q, 0).alias("lo"), limit(i, q, 1).alias("hi"))
        for i in range(len(columns)) for q in range(len(probabilities))])
    return wide.select(*by, F.filter(bands, lambda b: b["total"] > 0).alias("bands"))


def exact_quantiles(
    df: DataFrame, by: list[str], columns: list[str], probabilities: list[float], discrete: bool = False,
) -> DataFrame:
    """Exact quantiles per group, one row per (group, column) with array ``quantiles``: with linear interpolation, or
    ``discrete``, the first value that the share of rows reaches. Rows of a NULL group are a group.

    A sketch narrows each quantile to a band (``quantile_bands``). A second pass counts what lies below a band on the map side
    and moves the band's values only, as (value, count) pairs behind one row that stands for all below. These are range-sorted
    over all tasks; prefix sums of the tasks' counts tell which task holds a rank, and only that task's values are added up.
    A band of any size thus takes as many tasks as it needs, and a group of copies is one pair.
    """
    rows = df.select(*by, *[F.col(c).cast("double").alias(f"value{i}") for i, c in enumerate(columns)])
    group = [F.col(b).alias(f"group{i}") for i, b in enumerate(by)] or [F.lit(0).alias("group0")]
    own = [f"group{i}" for i in range(len(group))]
    values = [f"value{i}" for i in range(len(columns))]
    rows = rows.select(*group, *values)
    bands = settle(quantile_bands(rows, own, values, probabilities), "bands")
    named = bands.select(*[F.col(g).alias(f"of_{g}") for g in own], "bands")
    same = reduce(Column.__and__, [F.col(g).eqNullSafe(F.col(f"of_{g}")) for g in own])
    value = lambda b: F.get(F.array(*values), b["m"])
    met = F.filter("bands", lambda b: value(b) <= b["hi"])
    kept = F.transform(met, lambda b: F.struct(b["m"].alias("m"), b["q"].alias("q"), F.when(value(b) >= b["lo"], value(b)).alias("value")))
    key = [*own, "m", "q"]
    counted = rows.join(named, same).select(*own, F.inline(kept)).groupBy(*key, "value").agg(F.count(F.lit(1)).alias("copies"))
    order = [*key, F.asc_nulls_first("value")]
    ranged = settle(counted.repartitionByRange(*order).sortWithinPartitions(*order).withColumn("task", F.spark_partition_id()), "ranged")

    p = F.get(F.array(*[F.lit(float(x)) for x in probabilities]), F.col("q"))
    position = F.greatest(F.ceil(p * F.col("total")) - 1, F.lit(0)) if discrete else p * (F.col("total") - 1)
    earlier = Window.partitionBy(*key).orderBy("task").rowsBetween(Window.unboundedPreceding, -1)
    # The rows of the sorted table add up to all of a group's values, as one row stands for those below; those above are not in it.
    tasks = ranged.groupBy(*key, "task").agg(F.sum("copies").alias("n")).withColumn("before", F.coalesce(F.sum("n").over(earlier), F.lit(0)))
    ranks = bands.select(*own, F.inline("bands")).select(*key, "total").withColumn("rank", F.floor(position)).withColumn("share", position - F.col("rank"))
    ranks = ranks.select(*[F.col(k).alias(f"of_{k}") for k in key], "rank", "share")
    at = reduce(Column.__and__, [F.col(k).eqNullSafe(F.col(f"of_{k}")) for k in key])
    holders = tasks.join(ranks, at).filter("before <= rank + 1 AND before + n > rank")
    holders = holders.select(*[f"of_{k}" for k in key], F.col("task").alias("of_task"), "before", "rank", "share")
    running = Window.partitionBy(*key, "task").orderBy("value").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    last = ranged.join(holders, at & (F.col("task") == F.col("of_task"))).withColumn("upto", F.col("before") + F.sum("copies").over(running))
    picked = last.groupBy(*key).agg(
        F.min(F.when(F.col("upto") > F.col("rank"), F.col("value"))).alias("low"),
        F.min(F.when(F.col("upto") > F.col("rank") + 1, F.col("value"))).alias("high"),
        F.first("share").alias("share"),
    )
    found = F.col("low") + F.col("share") * (F.coalesce("high", "low") - F.col("low"))
    measure = F.get(F.array(*[F.lit(c) for c in columns]), F.col("m"))
    return picked.groupBy(*own, "m").agg(
        F.transform(F.sort_array(F.collect_list(F.struct("q", found.alias("v")))), lambda s: s["v"]).alias("quantiles")
    ).select(*[F.col(g).alias(b) for g, b in zip(own, by, strict=False)], measure.alias("measure"), "quantiles")
