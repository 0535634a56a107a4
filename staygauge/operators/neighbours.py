"""Exact nearest-neighbour lookups without pairing every point with every reference.

Space is cut into a hierarchy of grid cells, each level four times finer. For every occupied *query cell* the search
keeps a short list of reference cells that can still hold one of the k nearest references of any point inside, judged
by cell-to-cell distance bounds and cell weights alone. Both sides descend together until a list covers few reference
points; those points then become an array beside the query cell. A query row finds its candidates with equi-joins and
ranks them in place, so rows are never multiplied, and neither a hot group nor a hot place produces a pair explosion.
Copies of a reference are one weighted point.
"""

from __future__ import annotations

import math
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, Observation, SparkSession
from pyspark.sql import functions as F

from staygauge.functions.geo import haversine_km, unit_vector
from staygauge.functions.nearest import close_candidates, reachable_cells
from staygauge.session import settle

_DEEPEST = 20  # 4**20 cells per axis: about 10 micrometres on the globe
_BITS = 2  # each level halves the cell side twice
_ALL = "all_references"  # stands for the group where there is none
_SPACES = {
    "haversine": {"axes": ["axis_x", "axis_y", "axis_z"], "low": -1.0, "span": 2.0},
    "euclidean": {"axes": ["axis_x", "axis_y"], "low": -180.0, "span": 360.0},
}
LEAF = 128  # references that a row ranks in place
LEVELS = 6  # levels whose cells an index holds; the last ones are 1024 times finer than the first


def _cell(axes: list[Column], low: float, span: float) -> Column:
    side = span / 4.0**_DEEPEST
    return F.array(*[F.floor((a - low) / side) for a in axes])


def _up(cell: Column, levels: int) -> Column:
    """Ancestor of a cell. The shift rounds towards minus infinity, so cells outside the span work too."""
    return F.transform(cell, lambda c: F.shiftright(c, _BITS * levels)) if levels else cell


def _total(array: Column, field: str) -> Column:
    return F.aggregate(array, F.lit(0).cast("long"), lambda acc, c: acc + c[field])


def _prune(lists: DataFrame, k: int, dimensions: int, side: int = 1) -> DataFrame:
    """``lists`` with only those cells in ``near`` that can hold one of the k nearest references of some point in ``home``."""
    kind = lists.schema["near"].dataType
    return lists.withColumn("near", reachable_cells(F.col("near"), F.col("home"), k, dimensions, kind, side))


@dataclass(frozen=True)
class NeighbourIndex:
    """References of a nearest-neighbour search, prepared once and probed by any number of query tables, streams included.

    ``groups``: (by..., references, candidates) a row per group, with all its references as an array where these are few.
    ``points`` and ``cells``: the references of the other groups with their finest cells, and how many lie in the cells of
    ``LEVELS`` levels from ``start`` on; finer ones are counted when a query needs them. ``start`` is None if no group needs cells.
    """

    by: list[str]
    payload: list[str]
    metric: str
    leaf: int
    start: int | None
    groups: DataFrame
    points: DataFrame
    cells: DataFrame

    @property
    def axes(self) -> list[str]:
        return _SPACES[self.metric]["axes"]

    def level(self, level: int) -> DataFrame:
        """(by..., cell, weight, points) of a level."""
        if level < self.start + LEVELS:
            return self.cells.filter(F.col("level") == level).drop("level")
        return self.points.groupBy(*self.by, _up(F.col("cell"), _DEEPEST - level).alias("cell")).agg(
            F.sum("copies").alias("weight"), F.count(F.lit(1)).alias("points"))

    def save(self, path: str) -> None:
        spark = self.groups.sparkSession
        for name in ("groups", "points", "cells"):
            getattr(self, name).write.mode("overwrite").parquet(f"{path}/{name}")
        shape = [(list(self.by), list(self.payload), self.metric, self.leaf, self.start)]
        spark.createDataFrame(shape, "by array<string>, payload array<string>, metric string, leaf int, start int").write.mode("overwrite").parquet(f"{path}/shape")

    @staticmethod
    def load(spark: SparkSession, path: str) -> NeighbourIndex:
        shape = spark.read.parquet(f"{path}/shape").first()
        tables = {name: spark.read.parquet(f"{path}/{name}") for name in ("groups", "points", "cells")}
        return NeighbourIndex(list(shape["by"]), list(shape["payload"]), shape["metric"], shape["leaf"], shape["start"], **tables)


def build_index(references: DataFrame, by: list[str], payload: list[str], metric: str, leaf: int = LEAF) -> NeighbourIndex:
    """Index of references (by..., payload..., axes...). Copies become one weighted point; references without a place are left out."""
    space, key = _SPACES[metric], by or [_ALL]
    axes, low, span = space["axes"], space["low"], space["span"]
    refs = references if by else references.withColumn(_ALL, F.lit(1))
    usable = " AND ".join(f"{a} IS NOT NULL" for a in axes)
    points = settle(
        refs.filter(usable).groupBy(*key, *axes, *payload).agg(F.count(F.lit(1)).alias("copies"))
        .withColumn("cell", _cell([F.col(a) for a in axes], low, span)),
        "reference-points",
    )
    extent = F.greatest(*[F.max(a) - F.min(a) for a in axes], F.lit(0.0))
    sizes = settle(points.groupBy(*key).agg(
        F.count(F.lit(1)).alias("points"), F.sum("copies").alias("references"), extent.alias("extent")), "group-sizes")
    few = F.col("points") <= leaf
    widest = sizes.filter(~few).agg(F.max("extent")).first()[0]
    arrays = points.join(sizes.filter(few).select(*key), key, "left_semi").groupBy(*key).agg(
        F.collect_list(F.struct(*payload, "copies")).alias("candidates"))
    groups = settle(sizes.select(*key, "references").join(arrays, key, "left"), "neighbour-groups")
    empty_cells = points.limit(0).select(*key, F.lit(0).alias("level"), "cell", F.col("copies").alias("weight"), F.col("copies").alias("points"))
    if widest is None:
        return NeighbourIndex(key, payload, metric, leaf, None, groups, points.limit(0), empty_cells)
    # Where the widest group still fits into eight cells per axis: coarser levels tell too little apart.
    start = _DEEPEST if widest == 0 else max(0, min(_DEEPEST, math.floor(math.log(span / widest, 4)) + 1))
    large = settle(points.join(groups.filter("candidates IS NULL").select(*key), key, "left_semi"), "large-groups")
    levels = F.array(*[
        F.struct(F.lit(n).alias("level"), _up(F.col("cell"), _DEEPEST - n).alias("cell"))
        for n in range(start, min(start + LEVELS, _DEEPEST + 1))])
    cells = large.select(*key, "copies", F.inline(levels)).groupBy(*key, "level", "cell").agg(
        F.sum("copies").alias("weight"), F.count(F.lit(1)).alias("points"))
    return NeighbourIndex(key, payload, metric, leaf, start, groups, large, settle(cells, "reference-cells"))


def candidate_lists(queries: DataFrame, index: NeighbourIndex, k: int) -> DataFrame:
    """``queries`` (by..., axes...) plus ``candidates``: an array of (payload..., copies) that holds the k nearest references, and
    ``references``, how many its group has. Rows without a reference in their group have NULLs, those without coordinates too,
    unless their group is small.

    Groups of few references are joined as they are. For the others, query cells and the index's cells descend together.
    """
    by, axes = index.by, index.axes
    low, span = _SPACES[index.metric]["low"], _SPACES[index.metric]["span"]
    if by == [_ALL]:
        queries = queries.withColumn(_ALL, F.lit(1))
    if index.start is None:
        return queries.join(index.groups, by, "left").drop(_ALL)
    usable = " AND ".join(f"{a} IS NOT NULL" for a in axes)
    queries = queries.withColumn("fine", F.when(F.expr(usable), _cell([F.col(a) for a in axes], low, span)))
    large = index.groups.filter("candidates IS NULL").select(*by)
    homes = settle(queries.filter("fine IS NOT NULL").join(large, by, "left_semi").select(*by, "fine").distinct(), "query-cells")
    entry = F.struct("cell", "weight", "points")
    home0 = homes.select(*by, _up(F.col("fine"), _DEEPEST - index.start).alias("home")).distinct()
    lists = home0.join(index.level(index.start), by).groupBy(*by, "home").agg(F.collect_list(entry).alias("near"))
    found = None
    for level in range(index.start, _DEEPEST + 1):
        pruned = _prune(lists, k, len(axes))
        small = (_total(F.col("near"), "points") <= index.leaf) if level < _DEEPEST else F.lit(True)
        counts = Observation()
        lists = settle(pruned.withColumn("small", small).observe(
            counts, F.count_if("small").alias("done"), F.count_if(F.expr("NOT small")).alias("open")), f"lists-{level}")
        if counts.get["done"]:
            members = index.points.withColumn("cell", _up(F.col("cell"), _DEEPEST - level))
            done = (
                lists.filter("small").select(*by, "home", F.explode("near.cell").alias("cell")).join(members, [*by, "cell"])
                .groupBy(*by, "home").agg(F.collect_list(F.struct(*index.payload, "copies")).alias("near_points"))
                .withColumn("level", F.lit(level)))
            found = done if found is None else found.unionByName(done)
        if not counts.get["open"]:
            break
        # Children of the open query cells, each with the children of those of its parent's reference cells that it can reach.
        children = homes.select(
            *by, _up(F.col("fine"), _DEEPEST - level).alias("home"), _up(F.col("fine"), _DEEPEST - level - 1).alias("child")
        ).distinct()
        finer = index.level(level + 1).groupBy(*by, _up(F.col("cell"), 1).alias("parent")).agg(F.collect_list(entry).alias("inner"))
        reached = _prune(
            lists.filter("NOT small").join(children, [*by, "home"]).select(*by, F.col("child").alias("home"), "near"),
            k, len(axes), side=2**_BITS)
        lists = (
            reached.select(*by, "home", F.explode("near.cell").alias("parent"))
            .join(finer, [*by, "parent"]).groupBy(*by, "home").agg(F.flatten(F.collect_list("inner")).alias("near"))
        )
    everyone = queries.join(index.groups, by, "left")
    if found is None:
        return everyone.drop("fine", _ALL)
    found = settle(found, "candidates")
    # Which level a query cell ended on: one of those that it has an ancestor in.
    spots = F.array(*[
        F.struct(F.lit(n).alias("level"), _up(F.col("fine"), _DEEPEST - n).alias("home")) for n in range(index.start, level + 1)])
    ends = homes.select(*by, "fine", F.inline(spots)).join(found.select(*by, "level", "home"), [*by, "level", "home"], "left_semi")
    located = everyone.join(ends, [*by, "fine"], "left").join(found, [*by, "home", "level"], "left")
    return located.withColumn("candidates", F.coalesce("candidates", "near_points")).drop("home", "level", "fine", "near_points", _ALL)


def _ranked(distance, columns: list[str]) -> Column:
    """Candidates ordered by distance, then by the listed fields, each as (distance, fields..., copies)."""
    return F.sort_array(F.transform("candidates", lambda c: F.struct(
        distance(c).alias("distance"), *[c[x].alias(x) for x in columns], c["copies"].alias("copies"))))


def _kilometres(lat: str, lon: str):
    # Compared to the millimetre: closer than that is a tie, which the label then settles.
    return lambda c: F.round(haversine_km(F.col(lat), F.col(lon), c["ref_lat"], c["ref_long"]), 6)


def _degrees(lat: str, lon: str):
    return lambda c: F.round(F.sqrt(F.pow(F.col(lat) - c["ref_lat"], 2) + F.pow(F.col(lon) - c["ref_long"], 2)), 9)


def _on_sphere(df: DataFrame, lat: str, lon: str) -> DataFrame:
    x, y, z = unit_vector(F.col(lat), F.col(lon))
    return df.withColumns({"axis_x": x, "axis_y": y, "axis_z": z})


def index_of(references: DataFrame, by: list[str], label: str, metric: str, lat: str = "lat", lon: str = "long") -> NeighbourIndex:
    """Index of places (by..., label, lat, lon), for distances over the globe ("haversine") or in degrees ("euclidean")."""
    refs = references.select(*by, F.col(label).alias("ref_label"), F.col(lat).alias("ref_lat"), F.col(lon).alias("ref_long"))
    return build_index(_placed(refs, metric, "ref_lat", "ref_long"), by, ["ref_label", "ref_lat", "ref_long"], metric)


def _placed(df: DataFrame, metric: str, lat: str, lon: str) -> DataFrame:
    if metric == "haversine":
        return _on_sphere(df, lat, lon)
    return df.withColumns({"axis_x": F.col(lat).cast("double"), "axis_y": F.col(lon).cast("double")})


def _nearest(points: DataFrame, index: NeighbourIndex, k: int, lat: str = "lat", lon: str = "long") -> DataFrame:
    """points + ``ranked``: array of (distance, label, copies) that starts with the k nearest references; + ``references``."""
    listed = candidate_lists(_placed(points, index.metric, lat, lon), index, k)
    kind = listed.schema["candidates"].dataType
    close = close_candidates(F.col("candidates"), F.array(*index.axes), k, index.metric, kind)
    listed = listed.withColumn("candidates", close)  # the exact distances only for the few that remain
    distance = (_kilometres if index.metric == "haversine" else _degrees)(lat, lon)
    ranked = F.when(F.col(lat).isNotNull() & F.col(lon).isNotNull(), _ranked(distance, ["ref_label"]))
    return listed.withColumn("ranked", ranked).drop("candidates", *index.axes)


def city_index(centres: DataFrame) -> NeighbourIndex:
    """Index of ``centres`` (city, center_lat, center_lon)."""
    return index_of(centres, [], "city", "haversine", "center_lat", "center_lon")


def nearest_city(
    points: DataFrame, centres: DataFrame | NeighbourIndex, name: str = "nearest_city", within_km: float | None = None,
) -> DataFrame:
    """Add the nearest centre's city and its distance (``<name>_km``); NULL without coordinates or beyond ``within_km``.

    ``centres``: (city, center_lat, center_lon), or their index. Equally near centres are ordered by city.
    """
    index = centres if isinstance(centres, NeighbourIndex) else city_index(centres)
    ranked = _nearest(points, index, 1).drop("references")
    best = F.get("ranked", F.lit(0))
    near = F.lit(True) if within_km is None else best["distance"] <= within_km
    return ranked.withColumns({name: F.when(near, best["ref_label"]), f"{name}_km": F.when(near, best["distance"])}).drop("ranked")


def knn_vote(
    points: DataFrame, cluster_points: DataFrame | NeighbourIndex, k: int = 10, min_points: int = 10, metric: str = "haversine",
    name: str = "cluster_id", by: str = "city",
) -> DataFrame:
    """Add the cluster that most of the k nearest cluster points of the same city belong to.

    Each of the k has one vote; equal votes go to the smaller cluster id, equal distances are ordered by cluster id.
    -1 without coordinates or in a city with fewer than ``min_points`` cluster points. ``cluster_points`` (city, lat, long,
    cluster_id) may be given as their index.
    """
    from staygauge.fixed_values import NO_CLUSTER

    index = cluster_points if isinstance(cluster_points, NeighbourIndex) else index_of(cluster_points, [by], "cluster_id", metric)
    ranked = _nearest(points, index, k)
    # A copied point votes as often as it occurs, up to the k places.
    voters = F.slice(F.flatten(F.transform(F.slice("ranked", 1, k), lambda r: F.array_repeat(r["ref_label"], F.least(r["copies"], F.lit(k)).cast("int")))), 1, k)
    tallies = F.transform(F.array_distinct("voters"), lambda c: F.struct(
        (-F.size(F.filter("voters", lambda v: v == c))).alias("votes"), c.alias("cluster")))
    winner = F.when(F.col("references") >= min_points, F.array_min(tallies)["cluster"])
    return (
        ranked.withColumn("voters", voters)
        .withColumn(name, F.coalesce(winner, F.lit(NO_CLUSTER)).cast("long"))
        .drop("voters", "ranked", "references")
    )


def nearest_cluster(
    points: DataFrame, cluster_points: DataFrame | NeighbourIndex, name: str = "cluster_id", by: str = "city", metric: str = "euclidean",
) -> DataFrame:
    """Add the cluster of the single nearest cluster point of the same city, by distance in degrees."""
    return knn_vote(points, cluster_points, k=1, min_points=1, metric=metric, name=name, by=by)


def neighbour_distance(points: DataFrame, k: int, by: str = "city", name: str = "kth_km") -> DataFrame:
    """Add each point's distance to the k-th nearest point of its group, itself included, copies counted."""
    refs = points.select(by, F.lit(0).alias("ref_none"), "lat", "long")
    ranked = _nearest(points, index_of(refs, [by], "ref_none", "haversine"), k)
    reach = F.aggregate(
        "ranked", F.struct(F.lit(0).cast("long").alias("seen"), F.lit(None).cast("double").alias("km")),
        lambda acc, r: F.when(acc["seen"] >= k, acc).otherwise(F.struct((acc["seen"] + r["copies"]).alias("seen"), r["distance"].alias("km"))),
        lambda acc: F.when(acc["seen"] >= k, acc["km"]),
    )
    return ranked.withColumn(name, reach).drop("ranked", "references")
