"""Match typed place names to the locations of the season lookup."""

from __future__ import annotations

from difflib import SequenceMatcher

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import DoubleType

from staygauge.session import settle

EXACT, SUBSTRING, SIMILAR, LEAST_RATIO = 100.0, 60.0, 50.0, 0.5
RATIOS = (0.85, 0.7, LEAST_RATIO)


@F.pandas_udf(DoubleType())
def sequence_ratio(name: pd.Series, typed: pd.Series) -> pd.Series:
    return pd.Series([SequenceMatcher(None, a, b).ratio() for a, b in zip(name, typed, strict=True)], dtype="float64")


def substrings(text: Column, sizes: list[int]) -> Column:
    """All distinct substrings of a text that have one of the sizes."""
    size = F.length(text)
    some = F.filter(F.array(*[F.lit(n) for n in sizes]).cast("array<int>"), lambda n: n <= size)
    return F.array_distinct(F.flatten(F.transform(some, lambda n: F.transform(
        F.sequence(F.lit(1), size - n + 1), lambda i: F.substr(text, i, n)))))


def letters(text: Column) -> Column:
    """Every letter with its number among equal ones: a set, so that the common letters of two texts are an intersection.

    The sorted letters fall into runs of equal ones, so the work is that of sorting them.
    """
    ordered = F.array_join(F.sort_array(F.filter(F.split(text, ""), lambda c: c != "")), "")
    runs = F.regexp_extract_all(ordered, F.lit(r"(?s)((.)\2*)"), F.lit(1))
    return F.flatten(F.transform(runs, lambda run: F.transform(
        F.sequence(F.lit(1), F.length(run)), lambda n: F.struct(n.alias("n"), F.left(run, F.lit(1)).alias("c")))))


def rarest_first(texts: DataFrame, text: str, counts: DataFrame) -> DataFrame:
    """Add ``own``: the letters of each text, those first that fewest names have (``counts``: letter, n_names)."""
    spread = texts.withColumn("letter", F.explode(letters(F.col(text)))).join(counts, "letter", "left")
    rank = F.struct(F.coalesce("n_names", F.lit(0)).alias("n_names"), "letter")
    return spread.groupBy(*texts.columns).agg(F.transform(F.sort_array(F.collect_list(rank)), lambda r: r["letter"]).alias("own"))


def least_common(size: Column, other: Column, ratio: float) -> Column:
    """Letters that texts of two lengths must share for a sequence ratio of at least ``ratio``, or of more than LEAST_RATIO."""
    half = F.lit(ratio / 2) * (size + other)
    return (F.floor(half) + 1 if ratio == LEAST_RATIO else F.ceil(half - 1e-9)).cast("int")


def candidate_pairs(typed: DataFrame, names: DataFrame, ratio: float) -> DataFrame:
    """(typed, clean, location, low) of all pairs that may have the ratio, by a prefix filter on both sides' letters (``own``).

    Two lengths and the ratio say how many letters must be common. In the common order of letters, the first one that both texts
    have is among the first ones of either, and enough can still follow it on both sides. The lengths are part of the join's key,
    which keeps the prefixes short and spreads a letter that many names have.
    """
    def prefixes(texts: DataFrame, others: DataFrame, own: str, other: str) -> DataFrame:
        size = F.size("own")
        reach = F.sequence(F.ceil(size * ratio / (2 - ratio) - 1e-9).cast("int"), F.floor(size * (2 - ratio) / ratio + 1e-9).cast("int"))
        sizes = others.select(F.size("own").alias(other)).distinct()
        paired = texts.withColumn(own, size).withColumn(other, F.explode(reach)).join(sizes, other)
        least = least_common(F.col(own), F.col(other), ratio)
        first = F.transform(F.slice("own", F.lit(1), F.greatest(F.col(own) - least + 1, F.lit(0))), lambda l, i: F.struct(
            l.alias("letter"), (F.col(own) - i).alias("left")))
        return paired.filter(least <= F.least(own, other)).select(*texts.columns, own, other, F.inline(first))

    lengths = ["letter", "typed_size", "name_size"]
    asked = prefixes(typed, names, "typed_size", "name_size").withColumnRenamed("left", "typed_left")
    known = prefixes(names, typed, "name_size", "typed_size").withColumnsRenamed({"own": "other", "left": "name_left"})
    least = least_common(F.col("typed_size"), F.col("name_size"), ratio)
    met = asked.join(known, lengths).filter(F.least("typed_left", "name_left") >= least)
    return met.filter(F.size(F.array_intersect("own", "other")) >= least).select("typed", "clean", "location", "low").distinct()


def match_places(inputs: DataFrame, locations: DataFrame, column: str = "place") -> DataFrame:
    """Add ``location`` and ``score``: the best match of each typed place, NULL if nothing comes close.

    Equal names score 100, one within the other 60 plus the shorter length, else a sequence ratio above one half scores
    50 times the ratio. Equal scores go to the first name in order. Each distinct text is matched once.

    Equal and contained names meet by equality of whole texts or substrings. For the rest, pairs of a high ratio are looked for
    first (``candidate_pairs``): a text that has one is done, as its best pair is among them, and only texts that nothing
    resembles go on to the next lower ratio, where a letter in common says less.
    """
    typed = inputs.select(F.col(column).alias("typed")).filter("typed != ''").distinct().withColumn("clean", F.lower(F.trim("typed")))
    typed = settle(typed, "typed")
    names = settle(locations.select("location").filter("location IS NOT NULL").distinct().withColumn("low", F.lower("location")), "locations")
    # The lengths of names are few; so are those of texts that a name can hold.
    sizes = sorted(r[0] for r in names.select(F.length("low")).distinct().collect())
    longest = max(sizes, default=0)
    asked = sorted(r[0] for r in typed.select(F.length("clean").alias("n")).filter(F.col("n").between(1, longest)).distinct().collect())

    def rated(pairs: DataFrame, score: Column) -> DataFrame:
        return pairs.select("typed", F.struct((-score).alias("rank"), F.col("location")).alias("best"))

    shorter = SUBSTRING + F.least(F.length("low"), F.length("clean"))
    score = F.when(F.col("low") == F.col("clean"), EXACT).otherwise(shorter)
    inside = typed.withColumn("low", F.explode(substrings(F.col("clean"), [n for n in sizes if n]))).join(names, "low")
    around = names.withColumn("clean", F.explode(substrings(F.col("low"), asked))).join(typed, "clean")
    # The empty name is part of every text.
    empty = [r.location for r in names.filter("low = ''").collect()] if 0 in sizes else []
    direct = rated(inside, score).unionAll(rated(around, score))
    if empty:
        direct = direct.unionAll(rated(typed.select("typed", "clean", F.lit(empty[0]).alias("location"), F.lit("").alias("low")), score))
    found = settle(direct.groupBy("typed").agg(F.min("best").alias("best")), "direct_matches")

    left = settle(typed.filter((F.length("clean") > 0) & (F.length("clean") < 3 * longest)).join(found, "typed", "left_anti"), "left")
    if not left.isEmpty():
        known = names.filter("low != ''")
        counts = settle(known.select(F.explode(letters(F.col("low"))).alias("letter")).groupBy("letter").agg(F.count(F.lit(1)).alias("n_names")), "letters")
        known, left = settle(rarest_first(known, "low", counts), "known"), settle(rarest_first(left, "clean", counts), "left")
        for ratio in RATIOS:
            ratios = candidate_pairs(left, known, ratio).withColumn("ratio", sequence_ratio("low", "clean"))
            good = F.col("ratio") > ratio if ratio == LEAST_RATIO else F.col("ratio") >= ratio
            similar = settle(rated(ratios.filter(good), F.col("ratio") * SIMILAR).groupBy("typed").agg(F.min("best").alias("best")), "similar")
            found = found.unionAll(similar)
            if ratio == LEAST_RATIO:
                break
            left = settle(left.join(similar, "typed", "left_anti"), "left")
            if left.isEmpty():
                break
    return inputs.join(found, F.col(column) == F.col("typed"), "left").select(
        *inputs.columns, F.col("best.location").alias("location"), (-F.col("best.rank")).alias("score"))
