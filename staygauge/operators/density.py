"""Neighbourhood clusters: dense groups of places within each city.

A place with at least ``min_size`` listings within the radius (itself included) is a core place. Core places within the
radius of each other belong to one cluster; other places join the cluster of the nearest core place within the radius;
the rest is noise (-1).

The plan never compares all places of a group. Places lie in grid cells whose diagonal is the radius, so all core
places of a cell belong together and a cell with enough listings has only core places. Only places of thin cells (fewer
than ``min_size`` listings each) are compared with their surroundings, which is linear in the data; clusters are grown
between cells, first by a few extreme places per cell, then, only where two grown parts still touch, by place.
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from staygauge import fixed_values as fixed
from staygauge.functions.geo import chord_of_km_column, haversine_km, unit_vector
from staygauge.operators.components import connected_components
from staygauge.operators.neighbours import neighbour_distance
from staygauge.operators.stats import sample_rows
from staygauge.session import release, settle

MERGE_KM = fixed.CLUSTER_MERGE_RADIANS * fixed.EARTH_RADIUS_KM
_STEPS = [(i, j, k) for i in range(-2, 3) for j in range(-2, 3) for k in range(-2, 3)]
_DEPTH = 6  # how often facing cells are cut into quarters
_FEW = 4096  # pairs of places that two boxes may have to be compared place by place


def city_radius(points: DataFrame, min_size: int = fixed.MIN_CLUSTER_SIZE, share: float = 0.25, by: str = "city") -> DataFrame:
    """(city, radius_km): the distance within which the densest ``share`` of a city's places see ``min_size`` listings.

    Never below the merge distance, within which clusters always become one.
    """
    reach = neighbour_distance(points.filter("lat IS NOT NULL AND long IS NOT NULL").select(by, "lat", "long"), min_size, by)
    return reach.groupBy(by).agg(
        F.greatest(F.percentile_approx("kth_km", share), F.lit(MERGE_KM)).alias("radius_km")).filter("radius_km IS NOT NULL")


def _moved(cell: Column, steps: list[tuple]) -> Column:
    """The cells that lie ``steps`` away."""
    offsets = F.array(*[F.array(*[F.lit(x).cast("long") for x in step]) for step in steps])
    return F.transform(offsets, lambda o: F.zip_with(cell, o, lambda a, b: a + b))


def _sum(values: Column) -> Column:
    return F.aggregate(values, F.lit(0.0), lambda acc, x: acc + x)


def _close(a: Column, b: Column, km: Column) -> Column:
    return F.round(haversine_km(a["lat"], a["long"], b["lat"], b["long"]), 6) <= km


def _surroundings(spots: DataFrame, by: str) -> DataFrame:
    """One row per (spot, cell within its radius that the globe passes through), the cell as ``other``. Axis by axis, in plain
    arithmetic that Spark compiles."""
    found = spots.select(by, "spot", "pos", "cell", "side", "chord", "radius_km", *[F.lit(0.0).alias(c) for c in ("gap", "inner", "outer")])
    for axis in range(3):
        steps = F.transform(F.sequence(F.lit(-2), F.lit(2)), lambda i: i.cast("long"))
        found = found.select("*", F.explode(steps).alias("step")).withColumn(f"at{axis}", F.col("cell")[axis] + F.col("step")).drop("step")
        low, high, position = F.col(f"at{axis}") * F.col("side"), (F.col(f"at{axis}") + 1) * F.col("side"), F.col("pos")[axis]
        found = found.withColumns({
            "gap": F.col("gap") + F.pow(F.greatest(low - position, position - high, F.lit(0.0)), 2),
            "inner": F.col("inner") + F.pow(F.greatest(low, -high, F.lit(0.0)), 2),
            "outer": F.col("outer") + F.pow(F.greatest(F.abs(low), F.abs(high)), 2),
        }).filter(F.col("gap") <= F.pow(F.col("chord"), 2) * 1.000001)
    on_globe = found.filter((F.col("inner") <= 1 + 1e-9) & (F.col("outer") >= 1 - 1e-9))
    return on_globe.select(by, "spot", "pos", "chord", "radius_km", F.array("at0", "at1", "at2").alias("other"))


def _within(pairs: DataFrame) -> DataFrame:
    """Pairs (spot, pos, neighbour, neighbour_pos) within the radius, with their distance ``km``; the chord rules most out cheaply."""
    squared = sum((F.pow(F.col("pos")[i] - F.col("neighbour_pos")[i], 2) for i in range(3)), F.lit(0.0))
    close = pairs.filter(squared <= F.pow(F.col("chord") + 1e-9, 2))
    km = F.round(haversine_km(F.col("spot.lat"), F.col("spot.long"), F.col("neighbour.lat"), F.col("neighbour.long")), 6)
    return close.withColumn("km", km).filter("km <= radius_km")


def density_clusters(
    points: DataFrame,
    radius_km: float | DataFrame | None = None,
    min_size: int = fixed.MIN_CLUSTER_SIZE,
    by: str = "city",
) -> DataFrame:
    """Add ``cluster_id``: 0, 1, ... per city in order of the clusters' southernmost core place, -1 for noise.

    ``radius_km``: one radius, a table (city, radius_km), or None to derive it per city from the data. All rows are
    kept; rows without coordinates are noise.
    """
    located = points.filter("lat IS NOT NULL AND long IS NOT NULL")
    if radius_km is None:
        radius_km = city_radius(points, min_size, by=by)
    # Copies of a place become one weighted spot, so a pile of them costs one row from here on.
    spots = located.groupBy(by, F.struct("lat", "long").alias("spot")).agg(F.count(F.lit(1)).alias("copies"))
    spots = spots.join(radius_km, by) if isinstance(radius_km, DataFrame) else spots.withColumn("radius_km", F.lit(float(radius_km)))
    position = F.array(*unit_vector(F.col("spot.lat"), F.col("spot.long")))
    spots = spots.withColumns({"pos": position, "chord": chord_of_km_column(F.col("radius_km"))})
    spots = spots.withColumn("side", F.col("chord") / math.sqrt(3) * (1 - 1e-9))
    spots = settle(spots.withColumn("cell", F.transform("pos", lambda x: F.floor(x / F.col("side")))), "spots")
    release(points.sparkSession)

    weights = spots.groupBy(by, "cell").agg(F.sum("copies").alias("weight"))
    thick = weights.filter(F.col("weight") >= min_size).select(by, "cell")
    thin_spots = spots.join(thick, [by, "cell"], "left_anti")
    facing = [F.col("cell").alias("other"), F.col("spot").alias("neighbour"), F.col("pos").alias("neighbour_pos")]
    near = _within(_surroundings(thin_spots, by).join(spots.select(by, *facing, "copies"), [by, "other"]))
    thin_core = near.groupBy(by, "spot").agg(F.sum("copies").alias("seen")).filter(F.col("seen") >= min_size).select(by, "spot")
    core = settle(
        spots.join(thick, [by, "cell"], "left_semi").unionByName(thin_spots.join(thin_core, [by, "spot"], "left_semi")), "core")

    parts = _grow(core, by)
    release(points.sparkSession)
    core_parts = core.join(parts, [by, "cell"]).select(by, "spot", "pos", "copies", "cell", "part")

    others = spots.join(core.select(by, "spot"), [by, "spot"], "left_anti")  # none of them in a thick cell
    border = (
        _within(_surroundings(others, by).join(core_parts.select(by, *facing, "part"), [by, "other"]))
        .groupBy(by, "spot").agg(F.min_by("part", F.struct("km", "neighbour")).alias("part"))
    )
    members = settle(
        core_parts.select(by, "spot", "copies", "part", F.lit(True).alias("is_core")).unionByName(
            border.join(spots.select(by, "spot", "copies"), [by, "spot"]).select(by, "spot", "copies", "part", F.lit(False).alias("is_core"))),
        "members")
    clusters = members.groupBy(by, "part").agg(
        F.sum("copies").alias("size"), F.min(F.when(F.col("is_core"), F.col("spot"))).alias("corner")).filter(F.col("size") >= min_size)
    numbered = clusters.withColumn("cluster_id", (F.row_number().over(Window.partitionBy(by).orderBy("corner")) - 1).cast("long"))
    labels = members.join(numbered.select(by, "part", "cluster_id"), [by, "part"]).select(
        F.col(by).alias("label_city"), F.col("spot.lat").alias("label_lat"), F.col("spot.long").alias("label_long"), "cluster_id")
    return points.join(
        labels, (F.col(by) == F.col("label_city")) & (F.col("lat") == F.col("label_lat")) & (F.col("long") == F.col("label_long")), "left"
    ).select(*points.columns, F.coalesce("cluster_id", F.lit(fixed.NO_CLUSTER).cast("long")).alias("cluster_id"))


def _boxes(places: DataFrame, keys: list) -> DataFrame:
    """Bounding box, extreme places and number of the places of each key."""
    extremes = [pick("spot", F.col("pos")[axis]) for axis in range(3) for pick in (F.min_by, F.max_by)]
    return places.groupBy(*keys).agg(
        F.array(*[F.min(F.col("pos")[i]) for i in range(3)]).alias("low"),
        F.array(*[F.max(F.col("pos")[i]) for i in range(3)]).alias("high"),
        F.array_distinct(F.array(*extremes)).alias("scouts"), F.count(F.lit(1)).alias("n"))


def _box_gap() -> Column:
    """Squared distance of the boxes (low, high) and (low2, high2)."""
    return _sum(F.zip_with(
        F.arrays_zip("low", "high"), F.arrays_zip("low2", "high2"),
        lambda a, b: F.pow(F.greatest(a["low"] - b["high2"], b["low2"] - a["high"], F.lit(0.0)), 2)))


def _scouts_touch() -> Column:
    return F.exists("scouts", lambda a: F.exists("scouts2", lambda b: _close(a, b, F.col("radius_km"))))


def _coarser(box: str, levels: int) -> Column:
    return F.transform(box, lambda i: F.shiftright(i, 2 * levels))


def _bridges(open_pairs: DataFrame, core: DataFrame, by: str) -> DataFrame:
    """(u, v): parts of facing cells that have places within the radius.

    Both cells of a pair are cut into boxes of a quarter of the side, again and again. Boxes out of reach are dropped, two
    extreme places within the radius settle a pair of cells, and only boxes with few places are compared place by place. So two
    dense cells just beyond the radius cost what lies along their edges, not the product of their places.
    """
    pair = [by, "cell", "other"]
    used = open_pairs.select(by, "cell").unionAll(open_pairs.select(by, F.col("other").alias("cell"))).distinct()
    fine = F.transform("pos", lambda x: F.floor(x / (F.col("side") / F.lit(4.0 ** _DEPTH))))
    places = settle(core.join(used, [by, "cell"], "left_semi").select(by, "cell", "spot", "pos", fine.alias("fine")), "facing")
    links, pairs = [], settle(open_pairs, "open")
    for level in range(1, _DEPTH + 1):
        at = places.withColumn("box", _coarser("fine", _DEPTH - level))
        boxes = settle(_boxes(at, [by, "cell", "box"]), "boxes").withColumn("parent", _coarser("box", 1))
        mine = boxes.select(by, "cell", F.col("box").alias("a"), F.col("parent").alias("a_parent"), "low", "high", "scouts", "n")
        theirs = boxes.select(by, F.col("cell").alias("other"), F.col("box").alias("b"), F.col("parent").alias("b_parent"),
                              *[F.col(c).alias(f"{c}2") for c in ("low", "high", "scouts", "n")])
        if level > 1:
            pairs = pairs.withColumnsRenamed({"a": "a_parent", "b": "b_parent"})
        met = pairs.join(mine, [by, "cell", *["a_parent"] * (level > 1)]).join(theirs, [by, "other", *["b_parent"] * (level > 1)])
        met = settle(met.filter(_box_gap() <= F.pow(F.col("chord"), 2) * 1.000001).select(
            *pair, "radius_km", "chord", "cell_part", "other_part", "a", "b", (F.col("n") * F.col("n2")).alias("product"),
            _scouts_touch().alias("linked")), "facing-boxes")
        links.append(met.filter("linked").select("cell_part", "other_part"))
        rest = met.filter("NOT linked").join(met.filter("linked").select(*pair).distinct(), pair, "left_anti")
        few = F.lit(level == _DEPTH) | (F.col("product") <= _FEW)
        spots = at.select(by, "cell", F.col("box").alias("a"), "spot")
        others = at.select(by, F.col("cell").alias("other"), F.col("box").alias("b"), F.col("spot").alias("neighbour"))
        links.append(
            rest.filter(few).join(spots, [by, "cell", "a"]).join(others, [by, "other", "b"])
            .filter(_close(F.col("spot"), F.col("neighbour"), F.col("radius_km"))).select("cell_part", "other_part"))
        pairs = settle(rest.filter(~few).drop("linked", "product"), "open")
        if pairs.isEmpty():
            break
    out = links[0]
    for more in links[1:]:
        out = out.unionAll(more)
    return out.select(F.col("cell_part").alias("u"), F.col("other_part").alias("v")).distinct()


def _grow(core: DataFrame, by: str) -> DataFrame:
    """(city, cell, part): which cells with core places hang together."""
    cells = settle(_boxes(core, [by, "cell", "radius_km", "chord"]), "cells")
    later = [s for s in _STEPS if s > (0, 0, 0)]  # each unordered pair of cells once
    left = cells.select(by, "cell", "low", "high", "scouts", "radius_km", "chord", F.explode(_moved(F.col("cell"), later)).alias("other"))
    right = cells.select(by, F.col("cell").alias("other"), F.col("low").alias("low2"), F.col("high").alias("high2"), F.col("scouts").alias("scouts2"))
    pairs = settle(
        left.join(right, [by, "other"]).filter(_box_gap() <= F.pow(F.col("chord"), 2) * 1.000001)
        .select(by, "cell", "other", "radius_km", "chord", _scouts_touch().alias("linked")), "pairs")

    node = lambda cell: F.struct(by, F.col(cell).alias("cell"))
    first = connected_components(pairs.filter("linked").select(node("cell").alias("u"), node("other").alias("v")))
    nodes = cells.select(node("cell").alias("node"))
    first = settle(nodes.join(first, "node", "left").select("node", F.coalesce("component", "node").alias("part")), "parts")
    release(core.sparkSession)

    # Cells of different parts that still may touch: compare the places on their facing sides.
    part_of = lambda cell: first.select(F.col(f"node.{by}").alias(by), F.col("node.cell").alias(cell), F.col("part").alias(f"{cell}_part"))
    open_pairs = (
        pairs.filter("NOT linked").join(part_of("cell"), [by, "cell"]).join(part_of("other"), [by, "other"])
        .filter("cell_part != other_part")
    )
    bridges = _bridges(open_pairs.select(by, "cell", "other", "radius_km", "chord", "cell_part", "other_part"), core, by)
    second = connected_components(bridges)
    merged = first.join(second.select(F.col("node").alias("part"), "component"), "part", "left")
    return merged.select(F.col(f"node.{by}").alias(by), "node.cell", F.coalesce("component", "part").alias("part"))


def city_cluster_view(clustered: DataFrame, city: str, key: list[str], rows: int = 20_000, seed: int = 42) -> DataFrame:
    """Sample of one city's places with their clusters, noise flagged; which rows depends on their key only."""
    chosen = sample_rows(clustered.filter(F.col("city") == city), rows, key, seed)
    return chosen.withColumn("is_noise", F.col("cluster_id") == fixed.NO_CLUSTER)
