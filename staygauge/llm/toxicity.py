"""Toxic passages by maximum-scoring segments over token log-odds."""

from __future__ import annotations

import math
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from staygauge.llm.columns import free_name, quoted
from staygauge.llm.words import LOWER, NOT_LETTERS, Spans, bounded, buffer_of, cuts, hashes, release, spans
from staygauge.session import settle

VOCABULARY = 20_000  # tokens with a weight, at most
PRIOR_EACH, PRIOR_POOLED = 0.5, 100.0  # the Dirichlet prior, in texts: for each token, and shared out by pooled frequency
STEM = 4  # bytes of a word's beginning that are a token too, so that inflected forms share their evidence
MIN_Z = 2.5
MIN_DOCS = 2
DRIFT = 0.05
SIGNIFICANT = 0.05  # chance hits a document that a passage may have
THRESHOLD = 0.7
BINS = 32  # for each unit of evidence, in the counts that the calibration is fitted on

MAX_SLOTS = 2 ** 25  # bits of the table of labelled doc_ids; past some 10 million rows it only saves less

_PASSAGE = "struct<start: int, end: int, score: double, chance: double>"


def held_out(doc_id: Column) -> Column:
    return F.crc32(doc_id.cast("string").cast("binary")) % 3 == 1


@dataclass(frozen=True)
class Weights:
    """Sorted token hashes with their scores, and the extreme-value constants of the scores in clean text."""

    tokens: np.ndarray
    scores: np.ndarray
    decay: float
    log_k: float


@dataclass(frozen=True)
class Model:
    """weights of all training rows, and of each half without the other, for calibration; coefficients of the calibration."""

    weights: Weights
    calibration: tuple[float, float, float]


def segments(position: np.ndarray, score: np.ndarray, drift: float) -> list[tuple[int, int, float]]:
    """All maximal scoring segments (first, last, score) of a sequence, given its positive items; each other item scores -drift.

    A segment joins the last earlier one that begins lower as long as its own end is higher (Ruzzo and Tompa, 1999). Every
    segment remembers that earlier one, so the scan is linear.
    """
    found: list[tuple[float, float, int, int, int]] = []  # sum before, sum after, first, last, place of the earlier one
    total, last = 0.0, -1
    for at, gain in zip(position.tolist(), score.tolist(), strict=True):
        total -= drift * (at - last - 1)
        last = at
        before, total = total, total + gain
        first, j = at, len(found) - 1
        while True:
            while j >= 0 and found[j][0] >= before:
                j = found[j][4]
            if j < 0 or found[j][1] >= total:
                break
            before, _, first, _, up = found[j]
            del found[j:]
            j = up
        found.append((before, total, first, at, j))
    return [(first, last, after - before) for before, after, first, last, _ in found]


def tokens_of(column: pa.Array) -> tuple[Spans, np.ndarray, np.ndarray]:
    """Words in lower case, their hashes and the hashes of their stems."""
    data, offsets = buffer_of(column)
    words = spans(data, offsets, NOT_LETTERS)
    stems = Spans(words.data, words.start, np.minimum(words.end, words.start + STEM), words.text, words.texts)
    return words, hashes(words, LOWER), hashes(stems, LOWER) ^ np.uint64(0xA5A5A5A5A5A5A5A5)


def evidence(chances: list[float]) -> tuple[float, float]:
    """Strongest passage and all passages together, as logarithms of the chance to see them in clean text."""
    strength = [max(0.0, -math.log(max(c, 1e-300))) for c in chances]
    return math.log1p(max(strength, default=0.0)), math.log1p(sum(strength))


def passages(column: pa.Array, weights: Weights) -> list[list[tuple[int, int, float, float]]]:
    """Per text its passages (start, end in code points, score, expected chance hits)."""
    data, offsets = buffer_of(column)
    tokens, word, stem = tokens_of(column)
    out: list[list] = [[] for _ in range(tokens.texts)]
    if not len(weights.tokens) or not len(word):
        return out
    gain = np.zeros(len(word))
    for value in (word, stem):
        at = np.minimum(np.searchsorted(weights.tokens, value), len(weights.tokens) - 1)
        gain = np.maximum(gain, np.where(weights.tokens[at] == value, weights.scores[at], 0))
    hit = np.flatnonzero(gain)
    if not len(hit):
        return out
    ends = np.cumsum(tokens.counts())
    text, first = np.unique(tokens.text[hit], return_index=True)
    for i, a, b in zip(text.tolist(), first.tolist(), [*first[1:].tolist(), len(hit)], strict=True):
        own = hit[a:b]
        count = int(ends[i] - (ends[i - 1] if i else 0))
        base = int(ends[i]) - count
        whole = data[offsets[i]:offsets[i + 1]]
        for p, q, score in segments(own - base, gain[own], DRIFT):
            chance = math.exp(min(700.0, weights.log_k + math.log(count) - weights.decay * score))
            start, end = tokens.start[base + p] - offsets[i], tokens.end[base + q] - offsets[i]
            chars = [int(np.count_nonzero((whole[:x] & 0xC0) != 0x80)) for x in (start, end)]
            out[i].append((*chars, score, chance))
    return out


def log_odds(seen: DataFrame, n_tokens: int, all_toxic: float, all_clean: float) -> DataFrame:
    """(token, toxic, clean) with delta and z: log-odds of a token in toxic against clean text, and their z-scores.

    The Dirichlet prior has the pooled frequencies; n_tokens may get a weight.
    """
    prior = PRIOR_EACH + PRIOR_POOLED * (F.col("toxic") + F.col("clean")) / (all_toxic + all_clean)
    a, b, mass = F.col("toxic") + prior, F.col("clean") + prior, PRIOR_EACH * n_tokens + PRIOR_POOLED
    delta = F.log(a / (all_toxic + mass)) - F.log(b / (all_clean + mass))
    return seen.withColumn("delta", delta).withColumn("z", F.col("delta") / F.sqrt(1 / a + 1 / b))


def fitted(seen: DataFrame, n_tokens: int, all_toxic: float, all_clean: float) -> Weights:
    """Weights from ``seen`` (token, toxic, clean), the numbers of toxic and clean texts that hold each token, and their totals."""
    none = Weights(np.zeros(0, np.uint64), np.zeros(0), 1.0, 0.0)
    if not all_toxic or not all_clean:
        return none
    strong = (F.col("z") >= MIN_Z) & (F.col("delta") > 2 * DRIFT) & (F.col("toxic") >= MIN_DOCS)
    best = log_odds(seen, n_tokens, all_toxic, all_clean).filter(strong).orderBy(F.desc("z"), "token").limit(VOCABULARY).toPandas()
    if not len(best):
        return none
    tokens = best["token"].to_numpy(np.int64).view(np.uint64)
    toxic, clean, delta = (best[c].to_numpy(float) for c in ("toxic", "clean", "delta"))
    score = delta - DRIFT
    rate = (clean + PRIOR_EACH + PRIOR_POOLED * (toxic + clean) / (all_toxic + all_clean)) / (all_clean + PRIOR_POOLED)
    rest = max(0.0, 1 - rate.sum())
    lo, hi = 1e-3, 50.0  # the decay solves sum(rate * exp(decay * score)) = 1
    for _ in range(80):
        mid = (lo + hi) / 2
        if np.dot(rate, np.exp(np.minimum(mid * score, 500))) + rest * math.exp(-mid * DRIFT) > 1:
            hi = mid
        else:
            lo = mid
    decay = max(lo, 1e-3)
    # Chance starts of a passage a token: what clean text holds of weighted tokens, each counted at its own score.
    log_k = math.log(max(1e-12, float(np.dot(rate, np.exp(np.minimum(decay * score, 500))))))
    order = np.argsort(tokens)
    return Weights(tokens[order], score[order], decay, log_k)


def _counts(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """(fold, toxic, text) to rows (token, fold, toxic, n): in how many texts of a batch, fold and class the token occurs.

    Texts and not occurrences are counted, else one text that repeats a word a hundred times would decide its weight.
    """
    for batch in bounded(batches, 2):
        tokens, word, stem = tokens_of(batch.column(2))
        value, text = np.concatenate((word, stem)), np.concatenate((tokens.text, tokens.text))
        order = np.lexsort((text, value))
        value, text = value[order], text[order]
        once = np.ones(len(value), dtype=bool)
        once[1:] = (value[1:] != value[:-1]) | (text[1:] != text[:-1])
        value, label = value[once], (batch.column(0).to_numpy() * 2 + batch.column(1).to_numpy())[text[once]]
        for kind in range(4):
            token, n = np.unique(value[label == kind], return_counts=True)
            yield pa.RecordBatch.from_arrays(
                [pa.array(token.view(np.int64)), pa.array(np.full(len(n), kind // 2)), pa.array(np.full(len(n), kind % 2)), pa.array(n)],
                ["token", "fold", "toxic", "n"])


def _maybe_labelled(doc_id: Column, rows: DataFrame) -> Column:
    """False only for a doc_id that ``rows`` does not hold, so that its text need not be moved to be joined. Nulls are false."""
    words = min(MAX_SLOTS, 2 ** math.ceil(math.log2(max(8 * rows.count(), 1024)))) // 64
    slot = F.pmod(F.xxhash64(F.lit(13), "doc_id"), F.lit(words * 64))
    bit = F.call_function("shiftleft", F.lit(1).cast("long"), (slot % 64).cast("int"))
    bits = rows.select(F.shiftrightunsigned(slot, 6).alias("word"), bit.alias("bit"))
    found = bits.groupBy("word").agg(F.bit_or("bit").alias("bits")).toPandas()
    table = np.zeros(words, np.uint64)
    table[found["word"].to_numpy(np.int64)] = found["bits"].to_numpy(np.int64).view(np.uint64)
    table = rows.sparkSession.sparkContext.broadcast(table)

    @F.pandas_udf("boolean")
    def held(slot):
        import pandas as pd

        at = slot.to_numpy(np.int64)
        return pd.Series((table.value[at >> 6] >> (at & 63).astype(np.uint64)) & np.uint64(1) == 1)

    return doc_id.isNotNull() & held(F.pmod(F.xxhash64(F.lit(13), doc_id), F.lit(words * 64)))


def fit_toxicity(docs: DataFrame, labels: DataFrame, sample: int | None = None) -> Model:
    """Fit on labelled documents: ``labels`` (doc_id, toxic 0 or 1) are the training rows, ``docs`` (doc_id, text) any table.

    All labelled rows are used; with ``sample`` that many rows of each class at most, in a hash order of doc_id, each of which then
    counts in the calibration as the rows of its class that it stands for. A doc_id labelled twice is toxic if any row says so;
    null labels and doc_ids are left out. Two folds of texts cross-fit the calibration: a document is scored with the weights of the other
    fold. The calibration is fitted on counts of rows by class and evidence. Without toxic or without clean rows every score is 0.
    """
    rows = labels.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("toxic").cast("long").alias("toxic"))
    rows = rows.filter("doc_id is not null and toxic is not null").groupBy("doc_id").agg(F.max("toxic").alias("toxic"))
    rows = settle(rows.filter("toxic in (0, 1)"), "toxic_labels")
    weight, chosen = {0: 1.0, 1: 1.0}, rows
    if sample is not None:
        held = {r.toxic: r.n for r in rows.groupBy("toxic").agg(F.count(F.lit(1)).alias("n")).collect()}
        weight = {k: max(1.0, held.get(k, 0) / max(1, sample)) for k in (0, 1)}
        order = F.xxhash64(F.lit(3), "doc_id")
        some = [rows.filter(F.col("toxic") == k).orderBy(order, "doc_id").limit(sample) for k in (0, 1)]
        chosen = some[0].unionAll(some[1])
    # Labels grow with the documents, so both sides are dealt by doc_id; only texts that may have a label are moved.
    texts = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
    training = settle(texts.filter(_maybe_labelled(F.col("doc_id"), rows)).join(chosen.hint("merge"), "doc_id").select(
        F.pmod(F.xxhash64(F.lit(5), "text"), F.lit(2)).alias("fold"), "toxic", "text"), "toxic_training")
    # Copies of a text would count as evidence of each of its words, and are in one fold.
    distinct = training.groupBy(F.xxhash64("text"), F.xxhash64(F.lit(9), "text")).agg(
        F.min("fold").alias("fold"), F.max("toxic").alias("toxic"), F.min("text").alias("text")).select("fold", "toxic", "text")
    seen = settle(distinct.mapInArrow(_counts, "token long, fold long, toxic long, n long").groupBy("token").agg(
        *[F.sum(F.when((F.col("fold") == f) & (F.col("toxic") == t), F.col("n")).otherwise(0)).alias(f"n{f}{t}")
          for f in (0, 1) for t in (0, 1)]), "toxic_tokens")
    # Other tokens cannot get a weight; the totals are what the frequencies need of them.
    useful = F.col("n01") + F.col("n11") >= MIN_DOCS
    totals = seen.agg(F.count_if(useful).alias("tokens"), *[F.sum(c).alias(c) for c in seen.columns[1:]]).first()

    def weights(folds: tuple[int, ...]) -> Weights:
        toxic, clean = (sum(F.col(f"n{f}{t}") for f in folds) for t in (1, 0))
        total = [float(sum(totals[f"n{f}{t}"] or 0 for f in folds)) for t in (1, 0)]
        return fitted(seen.filter(useful).select("token", toxic.alias("toxic"), clean.alias("clean")), totals["tokens"], *total)

    halves = [weights((1,)), weights((0,))]
    every = weights((0, 1))

    def calibrating(batches):
        for batch in bounded(batches, 2):
            fold = batch.column(0).to_numpy()
            by = [passages(batch.column(2), w) for w in halves]
            pairs = [evidence([p[3] for p in by[f][i]]) for i, f in enumerate(fold.tolist())]
            yield pa.RecordBatch.from_arrays(
                [batch.column(1), *(pa.array([p[k] for p in pairs], pa.float64()) for k in (0, 1))], ["toxic", "top", "all"])

    # Bins keep what the driver gets small at any number of rows; each stands for its rows by their mean.
    found = training.mapInArrow(calibrating, "toxic long, top double, all double").groupBy(
        "toxic", F.floor(F.col("top") * BINS).alias("top_bin"), F.floor(F.col("all") * BINS).alias("all_bin")).agg(
        F.avg("top").alias("top"), F.avg("all").alias("all"), F.count(F.lit(1)).alias("n")).toPandas()
    found = found.sort_values(["toxic", "top_bin", "all_bin"])
    y = found["toxic"].to_numpy(float)
    rows_of = found["n"].to_numpy(float) * np.where(y == 1, weight[1], weight[0])
    return Model(every, _logistic(found[["top", "all"]].to_numpy(float), y, rows_of))


def _logistic(x: np.ndarray, y: np.ndarray, n: np.ndarray) -> tuple[float, float, float]:
    """Ridge logistic regression by Newton steps on rows that count ``n`` times; the slopes never fall below 0, so more evidence never lowers a score."""
    if not len(y) or y.min() == y.max():
        return (-30.0, 0.0, 0.0)
    use, coefficient = [0, 1, 2], np.zeros(3)
    table = np.column_stack((np.ones(len(x)), x))
    while True:
        beta, a = np.zeros(len(use)), table[:, use]
        for _ in range(60):
            p = 1 / (1 + np.exp(-np.clip(a @ beta, -30, 30)))
            slope = a.T @ (n * (y - p)) - 1e-2 * beta
            curve = (a * (n * p * (1 - p))[:, None]).T @ a + 1e-2 * np.eye(len(use))
            beta = beta + np.clip(np.linalg.solve(curve, slope), -5, 5)
        bad = [k for k, b in zip(use, beta, strict=True) if k and b < 0]
        if not bad:
            coefficient[use] = beta
            return tuple(float(c) for c in coefficient)
        use.remove(bad[0])


def score_toxicity(docs: DataFrame, model: Model) -> DataFrame:
    """All columns of ``docs`` (doc_id, text) with score, predicted and passages (input columns with these names are replaced).

    A text's tokens are runs of letters and digits in lower case; a token scores what its word or its stem does, the larger one. Every maximal scoring segment gets its expected number of
    chance hits in a clean text of that length, K * n * exp(-decay * score); significant ones are returned as passages with
    their place in code points. The segments' chances give the score, calibrated on labelled rows. Null and empty texts have no
    passage and the lowest score. Every row is scored by itself; an empty table gives none.
    """
    model = docs.sparkSession.sparkContext.broadcast(model)

    @F.pandas_udf(f"score double, passages array<{_PASSAGE}>")
    def score(text):
        import pandas as pd

        weights, (bias, top, every) = model.value.weights, model.value.calibration
        column = pa.array(text, pa.large_string(), from_pandas=True)
        found = [own for lo, hi in cuts(column) for own in passages(column.slice(lo, hi - lo), weights)]
        pairs = [evidence([p[3] for p in own]) for own in found]
        release()
        scores = [1 / (1 + math.exp(-max(-30.0, min(30.0, bias + top * a + every * b)))) for a, b in pairs]
        kept = [[{"start": p[0], "end": p[1], "score": p[2], "chance": p[3]} for p in own if p[3] <= SIGNIFICANT] for own in found]
        return pd.DataFrame({"score": scores, "passages": kept})

    named = docs.drop("score", "predicted", "passages")
    own = free_name(named, "toxicity")
    scored = named.withColumn(own, score(F.col("text").cast("string")))
    return scored.select(*map(quoted, named.columns), F.col(own)["score"].alias("score"),
                         (F.col(own)["score"] >= THRESHOLD).cast("int").alias("predicted"), F.col(own)["passages"].alias("passages"))
