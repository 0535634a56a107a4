import math
import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from staygauge.operators.components import connected_components
from staygauge.operators.density import density_clusters
from staygauge.operators.neighbours import knn_vote, nearest_city, nearest_cluster, neighbour_distance
from staygauge.operators.outliers import drop_coordinate_outliers, flag_coordinate_outliers
from staygauge.operators.stats import exact_quantiles


def km(a, b):
    la, lo, lb, lp = map(math.radians, (*a, *b))
    h = math.sin((lb - la) / 2) ** 2 + math.cos(la) * math.cos(lb) * math.sin((lp - lo) / 2) ** 2
    return round(2 * 6371 * math.atan2(math.sqrt(h), math.sqrt(1 - h)), 6)


@pytest.fixture(scope="module")
def world():
    """Points of two cities: blobs with copies, strays, the date line and a pole."""
    rng = random.Random(7)
    rows = []
    for i in range(360):
        city = "a" if i % 3 else "b"
        blob = [(10.0, 179.999), (10.02, -179.999), (89.999, 20.0)][i % 3]
        lat, lon = blob[0] + rng.gauss(0, 0.001), blob[1] + rng.gauss(0, 0.001)
        rows.append((i, city, min(lat, 90.0), lon if lon <= 180 else lon - 360))
    rows += [(1000 + i, "a", 10.0, 179.999) for i in range(200)]  # copies of one place
    rows += [(2000 + i, "b", rng.uniform(-80, 80), rng.uniform(-180, 180)) for i in range(20)]
    return rows + [(3000, "a", None, 1.0), (3001, "a", 1.0, None), (3002, "lonely", 5.0, 5.0)]


SCHEMA = "id long, city string, lat double, long double"


def test_nearest_city_by_brute_force(spark, world):
    centres = [("x", 10.0, -179.9), ("y", 10.0, 179.0), ("z", 88.0, -160.0), ("t2", 0.0, 10.0), ("t1", 0.0, -10.0)]
    points = [*world, (9000, "a", 0.0, 0.0)]
    got = nearest_city(spark.createDataFrame(points, SCHEMA), spark.createDataFrame(centres, "city string, center_lat double, center_lon double"), within_km=5000.0).collect()
    assert len(got) == len(points)
    for r in got:
        if r.lat is None or r.long is None:
            assert r.nearest_city is None
            continue
        best = min((km((r.lat, r.long), c[1:]), c[0]) for c in centres)
        assert r.nearest_city == (best[1] if best[0] <= 5000 else None)
    assert next(r for r in got if r.id == 9000).nearest_city == "t1"  # equally near: first name


def test_many_centres_use_several_levels(spark):
    rng = np.random.default_rng(3)
    centres = [(f"c{i:04}", float(a), float(o)) for i, (a, o) in enumerate(zip(rng.uniform(-90, 90, 1500), rng.uniform(-180, 180, 1500)))]
    points = [(i, "a", float(a), float(o)) for i, (a, o) in enumerate(zip(rng.uniform(-90, 90, 300), rng.uniform(-180, 180, 300)))]
    got = nearest_city(spark.createDataFrame(points, SCHEMA), spark.createDataFrame(centres, "city string, center_lat double, center_lon double")).collect()
    for r in got:
        assert (r.nearest_city_km, r.nearest_city) == pytest.approx(min((km((r.lat, r.long), c[1:]), c[0]) for c in centres))


def test_knn_vote_by_brute_force(spark, world):
    known = [(c, la, lo, i % 4) for i, c, la, lo in world if la is not None and lo is not None and i % 2]
    got = knn_vote(spark.createDataFrame(world, SCHEMA), spark.createDataFrame(known, "city string, lat double, long double, cluster_id long")).collect()
    assert len(got) == len(world)
    for r in got:
        mine = sorted((km((r.lat, r.long), k[1:3]), k[3]) for k in known if k[0] == r.city) if r.lat is not None and r.long is not None else []
        labels = [label for _, label in mine[:10]] if len(mine) >= 10 else []
        expected = min(set(labels), key=lambda c: (-labels.count(c), c)) if labels else -1
        assert r.cluster_id == expected


def test_one_neighbour_equals_nearest_cluster(spark, world):
    points = spark.createDataFrame([w for w in world if w[2] is not None and abs(w[2]) < 60], SCHEMA)
    known = points.filter("lat IS NOT NULL AND long IS NOT NULL AND id % 2 = 1").select("city", "lat", "long", (F.col("id") % 5).alias("cluster_id"))
    one = knn_vote(points, known, k=1, min_points=1, metric="euclidean").select("id", "cluster_id")
    assert sorted(map(tuple, one.collect())) == sorted(map(tuple, nearest_cluster(points, known).select("id", "cluster_id").collect()))


def test_neighbour_distance_counts_copies(spark, world):
    got = neighbour_distance(spark.createDataFrame(world, SCHEMA), 10).collect()
    for r in got:
        mine = sorted(km((r.lat, r.long), (w[2], w[3])) for w in world if w[1] == r.city and w[2] is not None and w[3] is not None) if r.lat is not None and r.long is not None else []
        assert r.kth_km == (pytest.approx(mine[9], abs=2e-6) if len(mine) >= 10 else None)


def brute_clusters(rows, radius, least):
    places = [r for r in rows if r[2] is not None and r[3] is not None]
    near = {r[0]: [s[0] for s in places if s[1] == r[1] and km(r[2:], s[2:]) <= radius] for r in places}
    at = {r[0]: r for r in places}
    core = {i for i, n in near.items() if len(n) >= least}
    label = {}
    for seed in sorted(core):
        stack = [seed] if seed not in label else []
        while stack:
            i = stack.pop()
            if i not in label:
                label[i] = seed
                stack += [j for j in near[i] if j in core]
    for i in set(near) - core:
        options = [(km(at[i][2:], at[j][2:]), at[j][2:], label[j]) for j in near[i] if j in core]
        if options:
            label[i] = min(options)[2]
    groups = {}
    for i, seed in label.items():
        groups.setdefault(seed, set()).add(i)
    return {frozenset(g) for g in groups.values() if len(g) >= least}


@pytest.mark.parametrize("radius", [0.1])
def test_density_clusters_by_brute_force(spark, world, radius):
    got = density_clusters(spark.createDataFrame(world, SCHEMA), radius).collect()
    assert len(got) == len(world)
    groups = {}
    for r in got:
        if r.cluster_id != -1:
            groups.setdefault((r.city, r.cluster_id), set()).add(r.id)
    assert {frozenset(g) for g in groups.values()} == brute_clusters(world, radius, 10)
    for city in ("a", "b"):
        ids = sorted({c for k, c in groups if k == city})
        assert ids == list(range(len(ids)))


def test_bridge_between_dense_cells_is_found_by_place(spark):
    """Two dense lines of places whose only close pair is not among the extreme places of its cells."""
    rng = random.Random(1)
    rows = [(i, "a", 45 + rng.uniform(0, 0.004), 7 + rng.uniform(0, 0.0013)) for i in range(300)]
    rows += [(500 + i, "a", 45 + rng.uniform(0, 0.004), 7.0019 + rng.uniform(0, 0.0013)) for i in range(300)]
    for radius in (0.05,):
        got = density_clusters(spark.createDataFrame(rows, SCHEMA), radius).collect()
        groups = {}
        for r in got:
            groups.setdefault(r.cluster_id, set()).add(r.id)
        groups.pop(-1, None)
        assert {frozenset(g) for g in groups.values()} == brute_clusters(rows, radius, 10)


def test_connected_components(spark):
    rng = random.Random(5)
    edges = [(i, i + 1) for i in range(200)] + [(1000, 1000 + i) for i in range(1, 100)] + [(rng.randrange(2000, 2060), rng.randrange(2000, 2060)) for _ in range(50)]
    parent = {}

    def find(x):
        while parent.setdefault(x, x) != x:
            x = parent[x]
        return x

    for a, b in edges:
        x, y = sorted((find(a), find(b)))
        parent[y] = x
    got = {r.node: r.component for r in connected_components(spark.createDataFrame(edges, "u long, v long")).collect()}
    linked = {n for a, b in edges if a != b for n in (a, b)}
    assert got == {n: find(n) for n in linked}
    assert connected_components(spark.createDataFrame([], "u long, v long")).count() == 0


def test_outliers(spark):
    rows = [(i, "big", 10 + i / 100, 20.0 + (i % 7) / 100) for i in range(40)] + [(100, "big", 60.0, 20.0), (101, "big", None, 20.0), (102, "big", 10.1, None)]
    rows += [(200 + i, "small", 80.0 * (i == 3), 0.0) for i in range(9)]
    df = spark.createDataFrame(rows, SCHEMA)
    flagged = {r.id for r in flag_coordinate_outliers(df).filter("is_outlier").collect()}
    assert flagged == {100}
    assert drop_coordinate_outliers(df).count() == len(rows) - 1


def test_exact_quantiles_of_a_large_group_with_copies(spark):
    rng = np.random.default_rng(1)
    values = np.concatenate([np.full(20_000, 3.25), rng.normal(0, 5, 40_000)])
    df = spark.createDataFrame([("a", float(v)) for v in values], "g string, x double")
    got = exact_quantiles(df, ["g"], ["x"], [0.25, 0.5, 0.75]).first()
    assert got.quantiles == pytest.approx(np.quantile(values, [0.25, 0.5, 0.75]))


def test_two_crowded_cells_just_beyond_the_radius(spark):
    """20 000 places each, in two blocks whose gap is a little above and a little below the radius."""
    import time

    radius, degree = 1.0, 111.195
    side = 0.45 / degree
    rows = []
    for gap, city in ((1.0005, "apart"), (0.9995, "joined")):
        for k in range(40_000):
            right = k >= 20_000
            i, j = divmod(k % 20_000, 200)
            lat, long = side * i / 100, side * j / 200
            rows.append((city, lat, long + (side * 199 / 200 + gap / degree if right else 0.0)))
    places = spark.createDataFrame(rows, "city string, lat double, long double")
    start = time.time()
    got = density_clusters(places, radius).groupBy("city").agg(F.countDistinct("cluster_id").alias("n"), F.min("cluster_id").alias("low")).collect()
    assert {r.city: (r.n, r.low) for r in got} == {"apart": (2, 0), "joined": (1, 0)}
    assert time.time() - start < 120


def test_a_saved_index_is_probed_as_it_is(spark, tmp_path):
    """One group of many places and one of few; queries in, near and far from them, with and without a group."""
    import random

    from staygauge.operators.neighbours import NeighbourIndex, index_of

    random.seed(9)
    known = [("big", random.gauss(50, 0.05), random.gauss(8, 0.05), random.randint(0, 3)) for _ in range(900)]
    known += [("small", random.uniform(0, 1), random.uniform(0, 1), k % 2) for k in range(20)] + [("big", None, 8.0, 1)]
    asked = [(k, random.choice(["big", "small", "none", None]), random.gauss(50, 0.1), random.gauss(8, 0.1)) for k in range(80)]
    asked += [(100, "big", 0.0, 0.0), (101, "small", 80.0, -170.0), (102, "big", None, 1.0), (103, "small", 1.0, None)]
    refs = spark.createDataFrame(known, "city string, lat double, long double, cluster_id long")
    points = spark.createDataFrame(asked, "id long, city string, lat double, long double")
    index = index_of(refs, ["city"], "cluster_id", "haversine")
    assert index.start is not None and index.groups.filter("candidates IS NOT NULL").count() == 1
    index.save(str(tmp_path / "index"))
    loaded = NeighbourIndex.load(spark, str(tmp_path / "index"))
    rows = lambda df: sorted((r.id, r.cluster_id) for r in df.collect())
    found = rows(knn_vote(points, loaded))
    assert found == rows(knn_vote(points, refs))
    assert rows(knn_vote(points.filter("city = 'small'"), loaded, min_points=21)) == [(i, -1) for i, c, *_ in asked if c == "small"]
    by_id = dict(found)
    assert by_id[100] >= 0 and by_id[101] >= 0 and by_id[102] == by_id[103] == -1 and all(by_id[i] == -1 for i, c, *_ in asked if c not in ("big", "small"))


def test_places_and_listings_are_dealt_by_number(spark):
    """A small file of many keys is one split; what is derived from it must not be one task."""
    from staygauge.workloads import standins

    cores, folder = spark.sparkContext.defaultParallelism, "/root/testdata/sf0.01"
    for derived in (standins.town_points, standins.globe_points, standins.raw_listings, standins.captured_pages):
        assert derived(spark, folder).rdd.getNumPartitions() >= cores


def test_few_candidates_are_ranked(spark):
    """The exact distances, which Spark interprets, are for about k of the listed places and not for all of them."""
    from staygauge.operators.neighbours import _nearest, index_of

    rng = random.Random(5)
    places = [(i, "a", 10 + rng.random() / 10, 20 + rng.random() / 10) for i in range(400)]
    points = spark.createDataFrame([*places, (900, "a", None, 1.0)], SCHEMA)
    for metric, distance in (("haversine", lambda p, q: km(p, q)), ("euclidean", lambda p, q: round(math.dist(p, q), 9))):
        got = _nearest(points, index_of(points.filter("id < 400"), ["city"], "id", metric), 5).collect()
        assert len(got) == 401
        for r in got:
            if r.lat is None:
                assert r.ranked is None
                continue
            best = sorted((distance((r.lat, r.long), p[2:]), p[0]) for p in places)[:5]
            assert 5 <= len(r.ranked) <= 8
            assert [(x.distance, x.ref_label) for x in r.ranked[:5]] == best
