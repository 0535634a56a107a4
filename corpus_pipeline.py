"""A cleaning pipeline over ``documents``: toxic documents out, repeated lines out, one document of each near-duplicate class,
repeated passages out, and what is left packed into sequences.

Each stage takes (spark, docs, sf_dir) and returns a DataFrame, which is written as Parquet and read again for the next one.
All stages but the last return the columns of documents. A stage drops a document only if that is its decision: a text that
line or substring dedup leaves empty stays as an empty text.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from staygauge.llm.columns import quoted
from staygauge.llm.line_dedup import dedup_lines
from staygauge.llm.packing import pack_documents
from staygauge.llm.queries import table, tokenizer_path
from staygauge.llm.similarity_join import similarity_classes
from staygauge.llm.substring_dedup import dedup_substrings
from staygauge.llm.toxicity import fit_toxicity, held_out, score_toxicity
from staygauge.session import settle


def _narrow(docs: DataFrame) -> DataFrame:
    """doc_id, text and all the rest in one column, so that no name of it meets a name of an operator."""
    return docs.select("doc_id", "text", F.struct(*[quoted(c) for c in docs.columns if c != "text"]).alias("row"))


def _own(c: str) -> Column:
    return F.col("text") if c == "text" else F.col("row").getField(c)


def _with_text(docs: DataFrame, changed: DataFrame, dropped: str) -> DataFrame:
    """The columns of ``docs``, with the kept text and its length where something was dropped."""
    new = {"text": F.col("kept_text"), "n_chars": F.char_length("kept_text").cast("long")}
    return changed.select(*[
        (F.when(F.col(dropped) > 0, new[c]).otherwise(_own(c)) if c in new else _own(c)).alias(c) for c in docs.columns])


def drop_toxic(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Without the documents that the toxicity model predicts toxic. It learns from labelled rows that are not held out."""
    labels = table(spark, sf_dir, "labels").filter(~held_out(F.col("doc_id")))
    scored = score_toxicity(_narrow(docs), fit_toxicity(docs, labels))
    return scored.filter(F.col("predicted") == 0).select(*[_own(c).alias(c) for c in docs.columns])


def drop_lines(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Without the lines that at least five documents hold, but in the last of them."""
    return _with_text(docs, dedup_lines(_narrow(docs)), "n_dropped")


def drop_near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of each class of near duplicates the document with the smallest doc_id. Rows without doc_id stay."""
    first = similarity_classes(docs).filter("class_id = doc_id").select("doc_id").distinct()
    named = docs.join(first, "doc_id", "left_semi").dropDuplicates(["doc_id", "text"])
    return named.unionByName(docs.filter("doc_id is null")).select(*map(quoted, docs.columns))


def drop_passages(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Without the words of passages of twenty words or more that an earlier document, or the same one before, holds."""
    return _with_text(docs, dedup_substrings(_narrow(docs)), "n_removed")


def pack(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Its workers also hold what the stages before left behind, so their caches are smaller."""
    return pack_documents(docs, tokenizer_path("word_bpe_49k.json"), cache_entries=240_000)


STAGES = [
    ("toxicity", drop_toxic), ("line_dedup", drop_lines), ("similarity_join", drop_near_duplicates),
    ("substring_dedup", drop_passages), ("packing", pack),
]
# Tokens, segments and sampled paths are beyond SQL; tests hold every stage against brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    for name, stage in STAGES[:-1]:
        docs = settle(stage(spark, docs, sf_dir), f"pipeline_{name}")
    return STAGES[-1][1](spark, docs, sf_dir)
