from difflib import SequenceMatcher

import pytest
from pyspark.sql import functions as F

from staygauge.operators import reports
from staygauge.operators.matching import letters, match_places
from staygauge.operators.model import FeatureSet, preparation_stages
from staygauge.plans.scoring import score_captures
from staygauge.sources.artifacts import load_engine, save_engine
from staygauge.streaming.captures import (
    accepted_times, score_available, suppress_recaptures, suppress_recaptures_stream, undecided_captures, with_capture_id)
from staygauge.workloads.model import engine
from staygauge.workloads.standins import captured_pages

SF = "/root/testdata/sf0.001"


def test_places(spark):
    names = ["london", "los angeles", "new york", "york", "paris"]
    typed = ["London", " greater london area ", "new york city", "Pariss", "lodnon", "qqqq", "", None, "yrok"]
    got = match_places(spark.createDataFrame([(t,) for t in typed], "place string"), spark.createDataFrame([(n,) for n in names], "location string")).collect()

    def expected(t):
        best = (0, None)
        for n in names:
            clean = t.lower().strip()
            score = 100 if n == clean else 60 + min(len(n), len(clean)) if n in clean or clean in n else 0
            ratio = SequenceMatcher(None, n, clean).ratio()
            score = score or (ratio * 50 if ratio > 0.5 else 0)
            best = max(best, (score, n), key=lambda b: b[0])
        return best[1]

    assert {r.place: r.location for r in got} == {t: expected(t) if t else None for t in typed}


def test_candidates_of_a_text_stay_few(spark):
    """Misspelled names among 100 000 locations: nearly all are found at a high ratio, where few names share their rare letters."""
    import random

    from staygauge.operators import matching
    from staygauge.session import settle

    random.seed(3)
    syllables = [a + b for a in "bcdfghjklmnpqrstvwz" for b in ("a", "e", "i", "o", "u", "an", "or", "is")]
    names = sorted({"".join(random.choice(syllables) for _ in range(random.randint(3, 6))) for _ in range(100_000)})
    chosen = random.sample(names, 300)
    typed = [n[:k] + random.choice("xqy") + n[k + 1:] for n in chosen for k in [random.randrange(len(n))]]
    known = spark.createDataFrame([(n, n) for n in names], "location string, low string")
    asked = spark.createDataFrame([(t, t) for t in set(typed)], "typed string, clean string")
    counts = settle(known.select(F.explode(matching.letters(F.col("low"))).alias("letter")).groupBy("letter").agg(F.count(F.lit(1)).alias("n_names")), "letters")
    known, asked = (settle(matching.rarest_first(df, c, counts), "ordered") for df, c in ((known, "low"), (asked, "clean")))
    pairs = settle(matching.candidate_pairs(asked, known, matching.RATIOS[0]), "pairs")
    found = {(r.typed, r.location) for r in pairs.select("typed", "location").collect()}
    expected = {(t, n) for t, n in zip(typed, chosen, strict=True) if SequenceMatcher(None, n, t).ratio() >= matching.RATIOS[0]}
    assert expected <= found and len(found) < 100 * len(typed), (len(found), len(typed))


def test_letters(spark):
    texts = ["", "banana", "aab", "\n\n x", "é日é" * 3, "a" * 5000]
    for r in spark.createDataFrame([(t,) for t in texts], "t string").select("t", letters(F.col("t")).alias("l")).collect():
        assert sorted((x.c, x.n) for x in r.l) == sorted((c, k) for c in set(r.t) for k in range(1, r.t.count(c) + 1))


def test_recaptures(spark):
    seconds = {"a": [0, 30, 59, 61, 61, 119, 121, 500], "b": [10, 69, 70, 71, 130]}
    rows = [(k, s) for k, ss in seconds.items() for s in ss]
    df = spark.createDataFrame(rows, "listing_id string, s long").withColumn("at", F.timestamp_seconds("s"))
    got = accepted_times(df, ["listing_id"], "at").select("listing_id", F.unix_timestamp("at")).collect()
    assert sorted(map(tuple, got)) == [("a", 0), ("a", 61), ("a", 121), ("a", 500), ("b", 10), ("b", 70), ("b", 130)]
    assert suppress_recaptures(df, ["listing_id"], "at").count() == 7


def streamed(spark, schema, folder, seconds=60):
    """Decided captures of a file stream, one file a micro-batch, with those that were left at its end."""
    stream = with_capture_id(spark.readStream.schema(schema).option("maxFilesPerTrigger", 1).parquet(f"{folder}/in"))
    kept = suppress_recaptures_stream(stream, ["listing_id"], "at", seconds)
    kept.writeStream.format("parquet").option("path", f"{folder}/out").option("checkpointLocation", f"{folder}/cp").trigger(availableNow=True).start().awaitTermination()
    return spark.read.parquet(f"{folder}/out"), undecided_captures(spark, f"{folder}/cp", ["listing_id"], "at", seconds)


def test_recapture_stream_over_several_batches(spark, tmp_path):
    start = 1_700_000_000
    rows = [(f"k{i % 7}", start + (i * 37) // 10) for i in range(600)]
    df = spark.createDataFrame(rows, "listing_id string, s long").withColumn("at", F.timestamp_seconds("s")).drop("s")
    for part in range(4):
        low, high = start + part * 150 * 37 // 10, start + (part + 1) * 150 * 37 // 10
        df.filter((F.unix_timestamp("at") >= low) & (F.unix_timestamp("at") < high)).coalesce(1).write.mode("append").parquet(str(tmp_path / "in"))
    decided, rest = streamed(spark, df.schema, str(tmp_path))
    both = decided.unionByName(rest)
    got = sorted(map(tuple, both.select("listing_id", "at").collect()))
    assert got == sorted(map(tuple, accepted_times(df, ["listing_id"], "at").collect())) and len(got) > 100
    assert decided.count() > 100 and rest.count() > 10
    ids = with_capture_id(df).select("listing_id", "at", "capture_id")
    assert both.join(ids, ["listing_id", "at", "capture_id"], "left_anti").isEmpty()


def test_captures_that_arrive_out_of_order(spark, tmp_path):
    """1000 s, then 500 s (still inside the watermark), then 1061 s, twice; times keep their microseconds. No page is in the state."""
    start = 1_700_000_000
    for seconds in [[1000.0], [500.000001], [1061.5, 1061.5], [1100.0]]:
        rows = [("a", start + s, "<html>" + "x" * 5000 + str(k)) for k, s in enumerate(seconds)]
        df = spark.createDataFrame(rows, "listing_id string, s double, html string").withColumn("at", F.timestamp_micros((F.col("s") * 1e6).cast("long"))).drop("s")
        df.coalesce(1).write.mode("append").parquet(str(tmp_path / "in"))
    decided, rest = streamed(spark, df.schema, str(tmp_path))
    pages = with_capture_id(spark.read.parquet(str(tmp_path / "in")))
    back = pages.join(decided.unionByName(rest), ["listing_id", "at", "capture_id"], "left_semi").select("html", F.unix_micros("at").alias("at")).collect()
    assert sorted(r.at - start * 10**6 for r in back) == [500_000_001, 1_000_000_000, 1_061_500_000]
    waiting = spark.read.format("statestore").option("stateVarName", "waiting").load(str(tmp_path / "cp")).select("list_element.*")
    assert waiting.columns == ["micros", "capture_id"] and waiting.count() >= 1


def test_many_captures_of_one_listing(spark):
    """One a second: the work is linear in their number."""
    import time

    times = spark.range(40_000).select(F.lit("a").alias("listing_id"), F.timestamp_seconds(F.col("id")).alias("at"))
    start = time.time()
    assert accepted_times(times, ["listing_id"], "at").count() == 667
    assert time.time() - start < 40


def test_long_runs_of_captures(spark):
    """A listing captured every 7 s for a day, and one every 61 s: more than one chunk of slots."""
    import itertools

    rows = [("a", 7 * i) for i in range(12_000)] + [("b", 61 * i + 30_000) for i in range(2_000)]
    df = spark.createDataFrame(rows, "listing_id string, s long").withColumn("at", F.timestamp_seconds("s"))
    want = []
    for k, group in itertools.groupby(sorted(rows), key=lambda r: r[0]):
        last = None
        for _, s in group:
            if last is None or s >= last + 60:
                want.append((k, s))
                last = s
    got = accepted_times(df, ["listing_id"], "at").select("listing_id", F.unix_timestamp("at")).collect()
    assert sorted(map(tuple, got)) == want


def test_preparation_centres_and_imputes(spark):
    df = spark.createDataFrame([(1.0, 1), (None, 1), (3.0, None), (8.0, 0)], "a double, b int")
    for stage in preparation_stages(FeatureSet(("a",), ("b",)), 0.0):
        df = (stage.fit(df) if hasattr(stage, "fit") else stage).transform(df)
    got = [tuple(r.features) for r in df.collect()]
    assert sum(v[0] for v in got) == pytest.approx(0) and [v[1] for v in got] == [1, 1, 1, 0]
    assert sum(v[0] ** 2 for v in got) / 3 == pytest.approx(1)


def test_impact_bins_are_right_closed(spark):
    df = spark.createDataFrame([(float(x), float(x)) for x in range(0, 21) for _ in range(5)] + [(20.0, 1.0)], "x double, prediction double")
    got = {r.bin: r for r in reports.feature_impact(df, ["x"]).collect()}
    assert got[0].n == 10 and got[1].n == 5 and got[19].n == 6 and got[0].center == pytest.approx(0.49) and got[1].center == 1.5


def test_engine_scores_the_same_from_batch_stream_and_disk(spark, tmp_path):
    fitted = engine(spark, SF)
    quality = {r.split: r for r in fitted.metrics.collect()}
    assert quality["train"].R2 > 0 and set(quality) == {"train", "validation"}
    importance = reports.feature_importance(spark, fitted.model, fitted.features).collect()
    assert sum(r.importance for r in importance) == pytest.approx(1) and {r.category for r in importance} >= {"Geospatial", "Binary"}

    pages = captured_pages(spark, SF)
    pages.write.parquet(str(tmp_path / "in"))
    wanted = ["listing_id", "prediction.predicted_price_per_night_usd", "prediction.cluster_id", "prediction.stoplight", "prediction.error"]
    batch = sorted(map(tuple, score_captures(pages, fitted).select(*wanted).collect()))
    assert batch and all((price is None) == (error is not None) for _, price, _, _, error in batch)
    assert any(error for *_, error in batch) and any(label for *_, label, _ in batch)

    save_engine(fitted, str(tmp_path / "engine"))
    loaded = load_engine(spark, str(tmp_path / "engine"))
    score_available(spark.readStream.schema(pages.schema).parquet(str(tmp_path / "in")), loaded, str(tmp_path / "out"), str(tmp_path / "cp"))
    streamed = spark.read.option("basePath", str(tmp_path / "out")).json(str(tmp_path / "out/batch=*")).select(*wanted)
    for got, want in zip(sorted(map(tuple, streamed.collect())), batch, strict=True):
        assert got[0] == want[0] and got[2:] == want[2:] and got[1] == pytest.approx(want[1])


def test_flagged_outliers_stay_as_noise(spark):
    from staygauge.operators.listing import listing_features
    from staygauge.plans.training import training_tables
    from staygauge.workloads.standins import raw_listings

    features = listing_features(raw_listings(spark, SF)).withColumn("lat", F.when(F.col("ratings") == 3.0, 80.0).otherwise(F.col("lat")))
    kept, dropped = (training_tables(features, radius_km=5.0, outliers=mode) for mode in ("flag", "drop"))
    strays = kept.filter("is_outlier")
    assert strays.count() > 0 and strays.filter("cluster_id != -1 OR split != 'train'").isEmpty()
    assert kept.count() == dropped.count() + strays.count()
    assert kept.filter("cluster_median IS NULL").isEmpty()


def test_a_listings_captures_enter_the_state_in_chunks_and_make_no_rows():
    """Rows, not frames: a frame a listing and batch, nearly always empty, was most of a stream's time."""
    from types import SimpleNamespace

    from staygauge.streaming import captures

    lists, timers = [], []
    state = SimpleNamespace(appendList=lists.append)
    handle = SimpleNamespace(getListState=lambda *_: state, getValueState=lambda *_: None, registerTimer=timers.append)
    decisions = captures._decisions(["k"], 60_000_000)
    decisions.init(handle)
    rows = (SimpleNamespace(micros=1_000_000 * (i + 5), capture_id=str(i)) for i in range(captures.CHUNK_ROWS + 1))
    assert list(decisions.handleInputRows(("a",), rows, SimpleNamespace(getCurrentWatermarkInMs=lambda: 0))) == []
    assert [len(part) for part in lists] == [captures.CHUNK_ROWS, 1] and timers == [5001]


def test_exact_medians_of_a_preparation_are_not_gathered(spark):
    """Spark's imputer keeps all values in its sketches at an error of 0; the exact one is found as all medians are."""
    from pyspark.ml import Pipeline
    from pyspark.ml.feature import Imputer

    rows = spark.createDataFrame([(None, 4.0), (1.0, float("nan")), (7.0, 4.0), (3.0, 0.1 + 0.2)], "`odd.a` double, b double")
    rows = rows.withColumnRenamed("odd.a", "odd a")
    stages = preparation_stages(FeatureSet(("odd a", "b"), ()), median_error=0.0)
    assert not any(isinstance(s, Imputer) for s in stages)
    got = Pipeline(stages=stages[:1]).fit(rows).transform(rows).select("odd a_imputed", "b_imputed").collect()
    assert [tuple(r) for r in got] == [(3.0, 4.0), (1.0, 4.0), (7.0, 4.0), (3.0, 0.1 + 0.2)]


def test_the_driver_collects_its_garbage_between_the_steps_of_clustering(spark):
    """Many small jobs leave plans and broadcasts behind; the heap grew with them although little of it was live."""
    from staygauge.operators.density import density_clusters

    def collections():
        beans = spark._jvm.java.lang.management.ManagementFactory.getGarbageCollectorMXBeans()
        return sum(b.getCollectionCount() for b in beans if "Old" in b.getName() or "MarkSweep" in b.getName())

    places = spark.createDataFrame([("a", 10 + i / 1e5, 20.0) for i in range(12)] + [("a", 50.0, 20.0)], "city string, lat double, long double")
    before = collections()
    assert sorted(r.cluster_id for r in density_clusters(places, 1.0).collect()) == [-1] + [0] * 12
    assert collections() >= before + 3
