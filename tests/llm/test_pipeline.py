"""Every stage of the pipeline against brute force, on the input that it gets."""

import random

import corpus_pipeline as pipeline
import pytest
from pyspark.sql import functions as F

from staygauge.llm.queries import QUERIES, SQL
from staygauge.llm.toxicity import fit_toxicity, held_out, score_toxicity
from staygauge.session import settle

from .conftest import texts_of
from .test_dedup import WORD, classes_by_force, lines_by_force, substrings_by_force

SF = "/root/testdata/sf0.01"


@pytest.fixture(scope="module")
def planted(spark, more_documents):
    """The documents, odd rows, and planted copies, near copies, passages, lines and toxic texts."""
    random.seed(11)
    word = lambda: "".join(random.choice("bcdfglmnprst") + random.choice("aeiou") for _ in range(random.randint(1, 4)))
    text = lambda n: " ".join(word() for _ in range(n))
    base, passage, line = text(300), text(60), text(12)
    rows = [(10_000, base), (10_001, base), (10_002, " ".join(base.split()[:-3]))]
    rows += [(10_100 + k, f"{text(80)} {passage} {text(80)}") for k in range(3)]
    rows += [(10_200 + k, f"{text(70)}\n{line}\n{text(70)}") for k in range(6)]
    rows += [(10_300, f"{text(40)} idiot {text(10)} moron {text(4)} scum {text(3)} loser trash {text(40)}"), (10_400, None), (10_401, ""), (None, text(20)), (None, None)]
    rows += [(10_500 + k, text(120)) for k in range(10)]
    extra = spark.createDataFrame([(d, t, "en", "src", len(t) if t else None) for d, t in rows], more_documents.schema)
    return settle(more_documents.unionByName(extra), "planted")


@pytest.fixture(scope="module")
def stages(spark, planted):
    """Each stage's input and output."""
    docs, out = planted, {}
    for name, stage in pipeline.STAGES:
        result = settle(stage(spark, docs, SF), name)
        out[name] = (docs, result)
        docs = result
    return out


def by_id(df):
    return sorted(texts_of(df), key=str)


def test_columns(stages, planted):
    assert [name for name, _ in pipeline.STAGES] == ["toxicity", "line_dedup", "similarity_join", "substring_dedup", "packing"]
    for name, (_, result) in stages.items():
        if name != "packing":
            assert result.dtypes == planted.dtypes
            assert result.filter(F.col("text").isNotNull() & (F.col("n_chars") != F.char_length("text"))).count() == 0


def test_toxic_documents_go(stages, spark):
    docs, result = stages["toxicity"]
    labels = spark.read.parquet(f"{SF}/labels.parquet").filter(~held_out(F.col("doc_id")))
    scored = score_toxicity(docs, fit_toxicity(docs, labels))
    assert by_id(result) == by_id(scored.filter("predicted = 0"))
    ids = {d for d, _ in texts_of(result)}
    assert 10_300 not in ids and {10_000, 10_400, 10_401, *range(10_500, 10_510)} <= ids


def test_lines(stages):
    docs, result = stages["line_dedup"]
    changed = {(d, n > 0): kept for d, _, n, kept in lines_by_force(texts_of(docs)) if d is not None}
    want = [(d, changed.get((d, True), t)) for d, t in texts_of(docs)]
    assert by_id(result) == sorted(want, key=str)
    assert sum("\n" in t for d, t in want if d in range(10_200, 10_206)) == 6  # the other lines stay
    assert len({t.split("\n")[1] for d, t in want if d in range(10_200, 10_206) and t.count("\n") == 2}) == 1


def test_near_duplicates(stages):
    docs, result = stages["similarity_join"]
    keep = {d for d, c, *_ in classes_by_force(texts_of(docs)) if d == c}
    assert by_id(result) == sorted({(d, t) for d, t in texts_of(docs) if d in keep or d is None}, key=str)
    assert 10_000 in keep and not {10_001, 10_002} & keep


def test_passages(stages):
    docs, result = stages["substring_dedup"]
    want = {}
    for d, _, n, kept in substrings_by_force(texts_of(docs), 20):
        want.setdefault(d, []).append((n, kept))
    for d, t in texts_of(result):
        assert any(t == kept if n else WORD.findall(t or "") == kept.split() for n, kept in want[d])
    assert result.count() == docs.count()
    own = {d: t for d, t in texts_of(result)}
    assert len(WORD.findall(own[10_100])) == 220 and len(WORD.findall(own[10_101])) == len(WORD.findall(own[10_102])) == 160


def test_packing(stages):
    docs, result = stages["packing"]
    assert result.filter("start = 0").count() == docs.count()
    assert result.groupBy("sequence_id").agg(F.sum("length").alias("n")).filter("n > 2048").count() == 0


def test_stages_of_nothing(spark, planted):
    for _, stage in pipeline.STAGES:
        assert stage(spark, planted.limit(0), SF).collect() == []


def test_queries_are_registered():
    assert sorted(int(name[2:].split("_")[0]) for name in QUERIES) == list(range(1, 14)) and set(SQL) <= set(QUERIES)
    assert pipeline.ORACLE_SQL is None
