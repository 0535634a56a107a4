"""Line dedup, substring dedup and the similarity join against brute force."""

import re
from collections import Counter, defaultdict

import pytest
from pyspark.sql import functions as F

from staygauge.llm.line_dedup import LineRuns, dedup_lines
from staygauge.llm.similarity_join import runs_for, similarity_classes, survival
from staygauge.llm.substring_dedup import dedup_substrings

from .conftest import texts_of

WORD = re.compile(r"[^\x20\x09-\x0D]+")
UPPER = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def low(doc_id):
    return (doc_id is not None, doc_id or 0)


def lines_by_force(rows, min_docs=5, min_chars=40):
    def key(line):
        return line.strip(" \t\n\x0b\f\r").translate(UPPER)

    holders = defaultdict(set)
    for d, t in rows:
        for line in (t or "").split("\n"):
            if len(key(line)) >= min_chars:
                holders[key(line)].add(d)
    out = []
    for d, t in rows:
        lines = (t or "").split("\n")
        kept = [x for x in lines if len(holders[key(x)]) < min_docs or max(holders[key(x)], key=low) == d]
        out.append((d, len(lines), len(lines) - len(kept), "\n".join(kept)))
    return sorted(out, key=str)


@pytest.mark.parametrize("batches", [1, 6])
def test_line_dedup(edge_docs, documents, batches):
    for docs, least in ((edge_docs, 2), (documents, 5)):
        found = dedup_lines(docs, min_docs=least, min_chars=20, batches=batches)
        got = sorted([(r.doc_id, r.n_lines, r.n_dropped, r.kept_text) for r in found.collect()], key=str)
        assert got == lines_by_force(texts_of(docs), least, 20)
        assert sorted(texts_of(found), key=str) == sorted(texts_of(docs), key=str)


def test_line_dedup_of_nothing(no_docs):
    found = dedup_lines(no_docs)
    assert found.collect() == [] and {"doc_id", "part", "n_lines", "n_dropped", "kept_text"} <= set(found.columns)


def test_runs_are_compacted_and_tell_new_keys(spark, documents):
    runs = LineRuns(spark, fanout=2, min_chars=10)
    slices = [documents.filter(F.col("doc_id") % 5 == k) for k in range(5)]
    seen = set()
    for batch in slices:
        keys = {(r.h1, r.h2) for r in LineRuns(spark, min_chars=10).add(batch).collect()}
        found = LineRuns(spark, min_chars=10).add(batch)
        assert {(r.h1, r.h2) for r in runs.first_seen(found).collect()} == keys - seen
        runs.add(batch)
        seen |= keys
    assert [len(level) for level in runs.levels] == [1, 0, 1]
    assert runs.all().count() == len(seen)
    held = [(r.h1, r.h2) for level in runs.levels for run in level for r in run.collect()]
    assert len(held) == len(set(held)) and set(held) == seen  # each batch added only what no run had
    whole = LineRuns(spark, min_chars=10).add(documents)
    for least in (1, 2, 5):
        assert sorted(map(tuple, runs.repeated(least).collect())) == sorted(map(tuple, whole.filter(F.col("n_docs") >= least).select("h1", "h2", "n_docs", "max_doc").collect()))
    assert runs.again and sum(a.count() for a in runs.again) > 0


def test_dedup_uses_the_levels(spark, documents):
    runs = LineRuns(spark)
    dedup_lines(documents, runs=runs)
    assert [len(level) for level in runs.levels] == [1, 1] and len(runs.again) == 4


def substrings_by_force(rows, window):
    seen, out = set(), []
    for d, t in sorted(rows, key=lambda r: (low(r[0]), r[1] is not None, r[1] or "")):
        words = WORD.findall(t or "")
        gone = [False] * len(words)
        for i in range(len(words) - window + 1):
            own = tuple(words[i:i + window])
            if own in seen:
                gone[i:i + window] = [True] * window
            seen.add(own)
        out.append((d, len(words), sum(gone), " ".join(w for w, g in zip(words, gone, strict=True) if not g)))
    return sorted(out, key=str)


@pytest.mark.parametrize("sizes", [{}, {"block_bytes": 20_000, "slice_windows": 2_000}])
def test_substring_dedup(edge_docs, documents, sizes):
    for docs, window in ((edge_docs, 20), (documents, 20), (documents, 4)):
        found = dedup_substrings(docs, window=window, **sizes)
        got = sorted([(r.doc_id, r.n_words, r.n_removed, r.kept_text) for r in found.collect()], key=str)
        assert got == substrings_by_force(texts_of(docs), window)


def test_substring_dedup_of_nothing(no_docs):
    found = dedup_substrings(no_docs)
    assert found.collect() == [] and {"part", "n_words", "n_removed", "kept_text"} <= set(found.columns)


def classes_by_force(rows, similarity=0.8):
    def shingles(text):
        words = WORD.findall(text or "")
        return frozenset(tuple(words[i:i + 5]) for i in range(max(1, len(words) - 4))) if words else frozenset()

    known = [(d, shingles(t)) for d, t in rows if d is not None]
    members = defaultdict(list)
    for d, s in known:
        members[s].append(d)
    sets = [s for s in members if s]
    name = {s: min(members[s]) for s in sets}
    parent, links = {s: s for s in sets}, Counter()

    def root(s):
        while parent[s] is not s:
            s = parent[s]
        return s

    for i, a in enumerate(sets):
        for b in sets[:i]:
            if len(a & b) >= similarity * len(a | b) - 1e-12:
                links[a] += 1
                links[b] += 1
                parent[root(a)] = root(b)
    least = {}
    for s in sets:
        least[root(s)] = min(least.get(root(s), name[s]), name[s])
    out = [(d, least[root(s)], links[s], len(members[s])) if s else (d, d, 0, 1) for d, s in known]
    return sorted(out + [(None, None, 0, 1) for d, _ in rows if d is None], key=str)


def found_classes(docs):
    return sorted([(r.doc_id, r.class_id, r.n_links, r.n_copies) for r in similarity_classes(docs).collect()], key=str)


def test_similarity_classes(edge_docs):
    assert found_classes(edge_docs) == classes_by_force(texts_of(edge_docs))


def test_similarity_classes_of_nothing(no_docs):
    assert found_classes(no_docs) == []


def test_chains_and_large_groups(spark):
    """A chain whose ends are unlike, a group of 400 edited copies (several blocks), and strangers."""
    base = [f"b{i}" for i in range(200)]
    rows = [(k, " ".join(base[:k] + ["new"] * 0 + [f"e{k}"] + base[k:])) for k in range(5, 195, 1)]
    rows += [(1000 + k, " ".join(base[:190 - k % 10] + [f"c{k}"])) for k in range(300)]
    rows += [(5000 + k, " ".join(f"s{k}_{i}" for i in range(30))) for k in range(50)]
    chain = [f"h{i}" for i in range(400)]
    rows += [(9000 + k, " ".join(chain[10 * k:10 * k + 200])) for k in range(20)]
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    assert found_classes(docs) == classes_by_force(rows)


def test_recall_of_runs():
    assert runs_for(0.999, 3) == 15
    assert (1 - survival(3)) ** runs_for(0.999, 3) <= 0.001


def test_a_similarity_of_just_the_limit_is_a_link(spark):
    """4000 of 5000 shingles in common: more than single precision can compare."""
    words = [f"w{i}" for i in range(10_000)]
    left, right = words[:4504], words[500:5004]
    assert len(left) == len(right) == 4504
    rows = [(1, " ".join(left)), (2, " ".join(right)), (3, " ".join(words[501:5005]))]
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    got = {r.doc_id: (r.class_id, r.n_links) for r in similarity_classes(docs).collect()}
    assert got == {1: (1, 1), 2: (1, 2), 3: (1, 1)}
    mixed_rows = spark.createDataFrame([(1, "a b c d e f"), (1, "u v w x y z"), (2, "u v w x y z"), (3, "g h i j k l")], "doc_id long, text string")
    assert sorted((r.doc_id, r.class_id) for r in similarity_classes(mixed_rows).collect()) == [(1, 1), (1, 1), (2, 1), (3, 3)]
