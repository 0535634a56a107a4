"""Quality rules: rule statistics of whole texts, judged by an isolation forest."""

from __future__ import annotations

import math
from collections.abc import Iterator
from dataclasses import dataclass, replace

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from staygauge.llm.words import SPACES, bounded, buffer_of, covered, grams, hashes, line_spans, mixed, spans
from staygauge.session import settle

SYMBOLS = b"#*$%&|<>"  # fixed value of the contract
SHORTEST = 50
REPEAT_PERCENT = 50
RUN = 3

TREES = 256
TREE_ROWS = 256
SAMPLE = 20_000  # labelled rows that the trees are drawn from, at most
BINS = 2_000
CLEAN_COST = 20.0  # a share of clean documents lost weighs as much as so many times that share of bad ones found

STATISTICS = ("n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "n_lines", "n_upper", "n_marks")


def _per_text(flag: np.ndarray, offsets: np.ndarray) -> np.ndarray:
    return np.diff(np.concatenate(([0], np.cumsum(flag)))[offsets])


def _table(chars: bytes) -> np.ndarray:
    out = np.zeros(256, dtype=bool)
    out[list(chars)] = True
    return out


_SYMBOL, _MARK = _table(SYMBOLS), _table(b"!?.,;:")


def statistics(column: pa.Array) -> dict[str, np.ndarray]:
    """Counts of each text, whole arrays at a time."""
    data, offsets = buffer_of(column)
    words = spans(data, offsets, SPACES)
    texts, h = words.texts, hashes(words)
    # Equal runs of different texts must differ, so the text's number goes into the hash.
    run, at = grams(h, words.text, RUN)
    _, inverse, times = np.unique(run ^ mixed(words.text[at]), return_inverse=True, return_counts=True)
    repeated = covered(at[times[inverse] > 1], RUN, len(h)) if len(at) else np.zeros(len(h), dtype=bool)
    lines = line_spans(data, offsets)
    spoken = np.flatnonzero(np.searchsorted(words.start, lines.end) > np.searchsorted(words.start, lines.start))
    key = hashes(lines)[spoken] ^ mixed(lines.text[spoken])
    _, first = np.unique(key, return_index=True)
    later = np.ones(len(spoken), dtype=bool)
    later[first] = False
    inside = ~SPACES[data]
    return {
        "n_words": words.counts(),
        "word_chars": _per_text(inside & ((data & 0xC0) != 0x80), offsets),
        "n_symbols": _per_text(_SYMBOL[data], offsets),
        "n_dup_lines": np.bincount(lines.text[spoken[later]], minlength=texts),
        "n_repeat_words": np.bincount(words.text[repeated], minlength=texts),
        "n_lines": np.bincount(lines.text[spoken], minlength=texts),
        "n_upper": _per_text((data >= 65) & (data <= 90), offsets),
        "n_marks": _per_text(_MARK[data], offsets),
    }


def rule_statistics(docs: DataFrame) -> DataFrame:
    """doc_id and the counts of each text of ``docs`` (doc_id, text), a row per row.

    Words are runs of characters other than ASCII white space; n_repeat_words counts the words in runs of three that occur twice
    or more in the text, n_dup_lines the lines with a word that equal an earlier line. Null and empty texts have zeros. Rows
    are counted one by one, repeated or without doc_id too; other columns are not read.
    """
    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in bounded(batches, 1):
            found = statistics(batch.column(1))
            yield pa.RecordBatch.from_arrays([batch.column(0), *(pa.array(found[c].astype(np.int64)) for c in STATISTICS)],
                                             ["doc_id", *STATISTICS])

    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
    return rows.mapInArrow(count, "doc_id long, " + ", ".join(f"{c} long" for c in STATISTICS))


def shares(table: dict[str, np.ndarray]) -> np.ndarray:
    """The statistics as shares that do not grow with the length of a text."""
    c = {k: np.asarray(v, float) for k, v in table.items()}
    words, chars = np.maximum(c["n_words"], 1), np.maximum(c["word_chars"], 1)
    return np.column_stack([
        c["word_chars"] / words, c["n_symbols"] / words, c["n_dup_lines"] / np.maximum(c["n_lines"], 1), c["n_repeat_words"] / words,
        c["n_upper"] / chars, c["n_marks"] / words])


@dataclass(frozen=True)
class Forest:
    """Trees as arrays (tree, node): split feature (-1 in a leaf), split value, left child (the right one follows), path length."""

    feature: np.ndarray
    value: np.ndarray
    child: np.ndarray
    path: np.ndarray
    rows: int
    centre: np.ndarray
    scale: np.ndarray
    threshold: float = 2.0

    def distances(self, x: np.ndarray) -> np.ndarray:
        """How far each share is from that of usual rows, on a logarithmic scale."""
        return np.log1p(np.abs(x - self.centre) / self.scale)

    def scores(self, x: np.ndarray) -> np.ndarray:
        """Anomaly of rows of shares, 0 to 1: 2 ** -(mean path / usual path)."""
        x = self.distances(x)
        total = np.zeros(len(x))
        for feature, value, child, path in zip(self.feature, self.value, self.child, self.path, strict=True):
            node = np.zeros(len(x), np.int64)
            for _ in range(64):
                split = feature[node]
                inner = np.flatnonzero(split >= 0)
                if not len(inner):
                    break
                at = node[inner]
                node[inner] = child[at] + (x[inner, split[inner]] >= value[at])
            total += path[node]
        return 2.0 ** -(total / max(1, len(self.feature)) / usual_path(self.rows))


def usual_path(n: int) -> float:
    """Mean path of an unsuccessful search in a binary tree of n rows."""
    return 1.0 if n <= 2 else 2 * (math.log(n - 1) + 0.5772156649) - 2 * (n - 1) / n


def grow_forest(usual: np.ndarray, every: np.ndarray, trees: int = TREES, tree_rows: int = TREE_ROWS, seed: int = 1) -> Forest:
    """Trees of random splits on ``tree_rows`` usual rows each.

    A split falls anywhere in the node's box, which begins as the range of ``every`` row, and not only between the usual rows in
    it. Where no usual row is, a row is alone after a few splits, so a whole cluster of anomalous rows has short paths too.
    """
    random = np.random.default_rng(seed)
    rows = min(tree_rows, len(usual))
    depth = max(1, math.ceil(math.log2(max(2, rows))))
    size = 2 ** (depth + 1)
    columns = every.shape[1]
    centre = np.median(usual, axis=0) if rows else np.zeros(columns)
    scale = (np.quantile(np.abs(usual - centre), 0.99, axis=0) if rows else np.zeros(columns)) + 1e-3
    blank = Forest(np.full((trees, size), -1), np.zeros((trees, size)), np.zeros((trees, size), np.int64), np.zeros((trees, size)), rows, centre, scale)
    x, ranges = blank.distances(usual), blank.distances(every)
    low, high = (ranges.min(axis=0), ranges.max(axis=0)) if len(ranges) else (np.zeros(columns), np.ones(columns))
    for t in range(trees):
        waiting, used = [(0, random.choice(len(x), rows, replace=False) if rows else np.zeros(0, np.int64), 0, low, high)], 1
        while waiting:
            node, own, level, lo, hi = waiting.pop()
            if level == depth or len(own) <= 1:
                blank.path[t, node] = level + (usual_path(len(own)) if len(own) > 1 else 0)
                continue
            k = random.integers(columns)
            cut = random.uniform(lo[k], hi[k])
            right = x[own, k] >= cut
            blank.feature[t, node], blank.value[t, node], blank.child[t, node] = k, cut, used
            below, above = hi.copy(), lo.copy()
            below[k] = above[k] = cut
            waiting += [(used, own[~right], level + 1, lo, below), (used + 1, own[right], level + 1, above, hi)]
            used += 2
    return blank


def failed(n_words, n_repeat_words):
    """The base rules, for columns and arrays alike."""
    return (n_words < SHORTEST) | (100 * n_repeat_words > REPEAT_PERCENT * n_words)


def fit_quality(stats: DataFrame, labels: DataFrame, sample: int = SAMPLE) -> Forest:
    """A forest grown on good rows, with a threshold calibrated on all labelled rows that pass the base rules.

    ``labels`` (doc_id, quality 0 or 1) are the training rows. The trees are drawn from ``sample`` of them at most, in a hash order
    of doc_id. The threshold weighs a lost good document as ``CLEAN_COST`` found bad ones, from score counts over all labelled
    rows. Without labelled rows nothing is anomalous.
    """
    rows = labels.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("quality").cast("long").alias("quality"))
    rows = rows.filter("doc_id is not null and quality is not null").groupBy("doc_id").agg(F.min("quality").alias("quality"))
    known = stats.join(rows, "doc_id").filter(~failed(F.col("n_words"), F.col("n_repeat_words")))
    known = settle(known, "quality_training")
    some = known.orderBy(F.xxhash64(F.lit(3), "doc_id"), *STATISTICS).limit(sample).toPandas()
    x = shares({c: some[c].to_numpy() for c in STATISTICS})
    good = x[some["quality"].to_numpy() > 0]
    forest = grow_forest(good, x)

    def binned(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            x = shares({c: batch.column(c).to_numpy() for c in STATISTICS})
            yield pa.RecordBatch.from_arrays([batch.column("quality"), pa.array((forest.scores(x) * BINS).astype(np.int64))], ["quality", "bin"])

    if not len(good):
        return forest
    counts = known.mapInArrow(binned, "quality long, bin long").groupBy("quality", "bin").agg(F.count(F.lit(1)).alias("n")).collect()
    table = np.zeros((2, BINS + 2))
    for r in counts:
        table[int(r["quality"] > 0), r["bin"]] += r["n"]
    bad, clean = (np.cumsum(row[::-1])[::-1] / max(1, row.sum()) for row in table)  # share at or above each bin
    gain = (bad - CLEAN_COST * clean)[:BINS + 1]
    best = np.flatnonzero(gain >= gain.max() - 1e-12)
    # Between good and bad rows there may be an empty range of scores: the threshold is its middle.
    return replace(forest, threshold=float(best.mean()) / BINS if gain.max() > 0 else 2.0)


def judge_quality(stats: DataFrame, forest: Forest) -> DataFrame:
    """Adds base_failed, anomaly (0 to 1) and kept to rule statistics. Every row is judged by itself."""
    forest = stats.sparkSession.sparkContext.broadcast(forest)

    @F.pandas_udf("double")
    def anomaly(table):
        import pandas as pd

        return pd.Series(forest.value.scores(shares({c: table[c].to_numpy() for c in STATISTICS})))

    base = failed(F.col("n_words"), F.col("n_repeat_words"))
    scored = stats.withColumn("base_failed", base).withColumn("anomaly", anomaly(F.struct(*STATISTICS)))
    return scored.withColumn("kept", ~F.col("base_failed") & (F.col("anomaly") < forest.value.threshold))
