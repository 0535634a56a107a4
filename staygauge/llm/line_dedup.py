"""Line dedup over levelled sorted runs of line hashes. DataFrame operations only."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from staygauge.llm.columns import quoted
from staygauge.session import new_folder, settle

# Fixed values of the contract.
STRIPPED = " \t\n\x0b\f\r"
UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
MIN_CHARS = 40
MIN_DOCS = 5
FANOUT = 4
BATCHES = 5  # more than a level holds, so that the last one meets compacted runs

_KEY = ["h1", "h2"]


def line_key(line: Column) -> Column:
    return F.translate(F.btrim(line, F.lit(STRIPPED)), UPPER, LOWER)


def key_hash(key: Column) -> Column:
    """128 bits of the key: two hashes with different seeds."""
    return F.struct(F.xxhash64(key).alias("h1"), F.xxhash64(F.lit(7), key).alias("h2"))


def lines_of(text: Column) -> Column:
    return F.split(F.coalesce(text.cast("string"), F.lit("")), "\n", -1)


def _key_hashes(text: Column, min_chars: int) -> Column:
    """Per line its key's hash, or null where the key is short."""
    keys = F.transform(lines_of(text), line_key)
    return F.transform(keys, lambda key: F.when(F.char_length(key) >= min_chars, key_hash(key)))


class LineRuns:
    """Sorted runs (h1, h2, n_docs, max_doc) in levels, in a shared folder. No key is in two runs.

    The keys of a batch are merge-joined with the runs: those that no run holds yet (the anti-join) become a sorted run of level 0;
    of the others only the counts of this batch are put aside (``again``). A level that has ``fanout`` runs is compacted into one
    run of the next level by merging, as their keys differ; so n batches leave about fanout * log(n) runs and every key is
    rewritten log(n) times. Runs are only added and replaced as whole tables: a lost executor costs a rerun of its tasks.

    Batches must hold different doc_ids; repeated rows of one doc_id within a batch count as one document.
    """

    def __init__(self, spark: SparkSession, folder: str | None = None, fanout: int = FANOUT, min_chars: int = MIN_CHARS):
        self.spark, self.fanout, self.min_chars = spark, fanout, min_chars
        self.folder = folder or new_folder(spark, "line_runs")
        self.levels: list[list[DataFrame]] = []
        self.again: list[DataFrame] = []
        self._written = 0

    def _write(self, run: DataFrame) -> DataFrame:
        path = f"{self.folder}/run-{self._written}"
        self._written += 1
        run.sortWithinPartitions(*_KEY).write.parquet(path)
        return self.spark.read.schema(run.schema).parquet(path)

    def _runs(self) -> DataFrame | None:
        runs = [run for level in self.levels for run in level]
        return reduce(DataFrame.unionAll, runs) if runs else None

    def all(self) -> DataFrame | None:
        """Every key once, with its counts over all batches."""
        runs = self._runs()
        return _merged(reduce(DataFrame.unionAll, self.again, runs)) if runs is not None else None

    def first_seen(self, keys: DataFrame) -> DataFrame:
        """Rows of ``keys`` (h1, h2, ...) that no run holds yet."""
        runs = self._runs()
        return keys.join(runs.select(*_KEY), _KEY, "left_anti") if runs is not None else keys

    def add(self, batch: DataFrame) -> DataFrame:
        """Add a batch of documents (doc_id, text); returns its own keys with their counts."""
        keys = F.array_distinct(F.array_compact(_key_hashes(F.col("text"), self.min_chars)))
        pairs = batch.select(F.col("doc_id").cast("long"), F.explode(keys).alias("key"))
        pairs = pairs.select("doc_id", "key.*").distinct()
        own = pairs.groupBy(*_KEY).agg(
            F.count(F.lit(1)).alias("n_docs"), F.max(F.struct(F.col("doc_id").isNotNull(), "doc_id"))["doc_id"].alias("max_doc"))
        runs = self._runs()
        if runs is None:
            own = self._write(own)
            self._place(own, 0)
            return own
        # One merge join tells the keys that no run holds from the others.
        marked = self._write(own.join(runs.select(*_KEY, F.lit(True).alias("held")), _KEY, "left"))
        self.again.append(marked.filter("held").drop("held"))
        self._place(marked.filter("held IS NULL").drop("held"), 0)
        return marked.drop("held")

    def _place(self, run: DataFrame, level: int) -> None:
        if level == len(self.levels):
            self.levels.append([])
        self.levels[level].append(run)
        if len(self.levels[level]) >= self.fanout:
            merged = self._write(reduce(DataFrame.unionAll, self.levels[level]).repartition(*_KEY))
            self.levels[level] = []
            self._place(merged, level + 1)

    def repeated(self, min_docs: int = MIN_DOCS) -> DataFrame | None:
        """Keys held by ``min_docs`` documents or more: the runs, with what was put aside for their keys."""
        runs = self._runs()
        if runs is None or not self.again:
            return runs.filter(F.col("n_docs") >= min_docs) if runs is not None else None
        again = _merged(reduce(DataFrame.unionAll, self.again)).withColumnsRenamed({"n_docs": "more", "max_doc": "later"})
        total = runs.join(again, _KEY, "left").withColumns({
            "n_docs": F.col("n_docs") + F.coalesce("more", F.lit(0)), "max_doc": F.greatest("max_doc", "later")})
        return total.filter(F.col("n_docs") >= min_docs).drop("more", "later")


def _merged(runs: DataFrame) -> DataFrame:
    return runs.groupBy(*_KEY).agg(
        F.sum("n_docs").alias("n_docs"), F.max(F.struct(F.col("max_doc").isNotNull(), "max_doc"))["max_doc"].alias("max_doc"))


def dedup_lines(
    docs: DataFrame, min_docs: int = MIN_DOCS, min_chars: int = MIN_CHARS, batches: int = BATCHES, runs: LineRuns | None = None,
) -> DataFrame:
    """Documents (doc_id, text) without repeated lines: all columns of ``docs``, with n_lines, n_dropped and kept_text.

    A line's key is the line stripped of ASCII white space, A-Z in lower case. A key of ``min_chars`` code points or more that
    is found in ``min_docs`` documents or more loses all its lines except in the largest doc_id that holds it. A null or empty
    text is one empty line. Rows of one doc_id are one document; a null doc_id is the smallest. An empty table gives no row.
    Columns of ``docs`` named like a result are replaced.

    The table enters the runs in ``batches`` hash slices of doc_id, each anti-joined with the runs so far. Then the places of repeated lines are found by joining the
    line keys with the repeated keys only; texts are moved once, to meet their places. The keys of a hot line spread by
    (key, doc_id) before they are counted, and Spark's skew handling splits them in the second join.
    """
    runs = runs or LineRuns(docs.sparkSession, min_chars=min_chars)
    slice_of = F.pmod(F.xxhash64(F.lit(11), F.col("doc_id").cast("long")), F.lit(batches))
    for k in range(batches):
        runs.add(docs.filter(slice_of == k))
    # A table of its own, so that the join below has a plain side: Spark can then split the rows of a hot line.
    repeated = settle(runs.repeated(min_docs).select(*_KEY, "max_doc"), "repeated_lines")
    row = [F.col("doc_id").cast("long").alias("row_doc"), F.xxhash64(F.col("text").cast("string")).alias("row_text")]
    places = docs.select(*row, F.posexplode(_key_hashes(F.col("text"), min_chars)).alias("place", "key"))
    places = places.filter("key is not null").select("row_doc", "row_text", "place", "key.*")
    dropped = places.join(repeated, _KEY).filter(~F.col("row_doc").eqNullSafe(F.col("max_doc")))
    dropped = dropped.groupBy("row_doc", "row_text").agg(F.sort_array(F.collect_set("place")).alias("gone"))
    # The lines travel instead of the text, so that after the join they are a column and not split again for every slice.
    others = [quoted(c) for c in docs.columns if c not in ("text", "n_lines", "n_dropped", "kept_text")]
    rows = docs.select(F.struct(*others).alias("others"), row[0].alias("own_doc"), row[1].alias("own_text"),
                       F.col("text").isNull().alias("no_text"), lines_of(F.col("text")).alias("lines"))
    same = F.col("own_doc").eqNullSafe(F.col("row_doc")) & (F.col("own_text") == F.col("row_text"))
    gone, n_lines = F.coalesce("gone", F.array().cast("array<int>")), F.size("lines")
    joined = rows.join(dropped, same, "left").select("others", "no_text", "lines", gone.alias("gone"))
    border = lambda k: F.when(k == 0, -1).when(k > F.size("gone"), n_lines).otherwise(F.get("gone", k - 1))
    between = F.transform(F.sequence(F.lit(0), F.size("gone")),
                          lambda k: F.slice("lines", border(k) + 2, border(k + 1) - border(k) - 1))
    return joined.select(
        "others.*", F.when(~F.col("no_text"), F.array_join("lines", "\n")).alias("text"), n_lines.cast("long").alias("n_lines"),
        F.size("gone").cast("long").alias("n_dropped"), F.array_join(F.flatten(between), "\n").alias("kept_text"))
