"""Callers' columns whose names meet those of helpers and results, or hold dots."""

import public_tokenizers
import pytest
from pyspark.sql import functions as F

import corpus_pipeline as pipeline
from staygauge.llm.bpe import encode
from staygauge.llm.line_dedup import dedup_lines
from staygauge.llm.substring_dedup import dedup_substrings
from staygauge.llm.toxicity import fit_toxicity, score_toxicity
from staygauge.llm.url_filter import judge_urls

SF = "/root/testdata/sf0.001"
NAMES = ["block", "toxicity", "coded_text", "score", "passages", "n_lines", "n_words", "n_removed", "kept_text", "of", "row", "own0", "a.b", "c`d"]


@pytest.fixture(scope="module")
def named(documents):
    rows = documents.limit(60)
    for k, name in enumerate(NAMES):
        rows = rows.withColumn(name, F.concat(F.lit(f"{k}:"), F.col("doc_id")))
    return rows


def carried(df, names):
    """doc_id with the values of these columns, which must be what the caller put there."""
    rows = [r.asDict() for r in df.collect()]
    for r in rows:
        assert all(r[n] == f"{NAMES.index(n)}:{r['doc_id']}" for n in names)
    return len(rows)


def test_operators_keep_columns_of_any_name(named, labels):
    n = named.count()
    results = {"n_lines", "n_words", "n_removed", "kept_text", "score", "passages"}
    rest = [c for c in NAMES if c not in results]
    assert carried(dedup_substrings(named), [*rest, "n_lines", "score", "passages"]) == n
    assert carried(dedup_lines(named), [*rest, "n_words", "n_removed", "score", "passages"]) == n
    assert carried(encode(named, public_tokenizers.path("word_bpe_49k.json")), NAMES) == n
    assert carried(score_toxicity(named, fit_toxicity(named, labels)), [c for c in NAMES if c not in ("score", "passages")]) == n
    urls = named.withColumn("url", F.lit("http://a.example.org/x")).withColumnRenamed("text", "old")
    rules = named.sparkSession.createDataFrame([(["host:a.example.org"], 1.0, 1.0)], "tokens array<string>, confidence double, support double")
    for found in (judge_urls(urls, [], []), judge_urls(urls, [], rules)):
        assert carried(found, NAMES) == n


def test_stages_return_the_callers_columns(spark, named):
    docs = named
    for name, stage in pipeline.STAGES[:-1]:
        out = stage(spark, docs, SF)
        assert out.dtypes == named.dtypes, name
        assert carried(out, NAMES) > 0
