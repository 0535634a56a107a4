"""Toxicity, quality rules, URL filter and top-k search."""

import itertools
import math
import random
import re
from collections import Counter

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from staygauge.llm.quality import failed, fit_quality, judge_quality, rule_statistics, shares, statistics
from staygauge.llm.toxicity import fit_toxicity, held_out, score_toxicity, segments
from staygauge.llm.topk import SlicedBlock, top_k
from staygauge.llm.url_filter import PathRule, host_of, judge_urls, mine_rules, path_of

from .conftest import texts_of

WORD = re.compile(r"[^\x20\x09-\x0D]+")


# ---- toxicity -------------------------------------------------------------------------------------
def segments_by_force(scores):
    """Recursion of the definition: the best segment (shortest, then first), then the parts beside it."""
    def best(lo, hi):
        found = None
        for a in range(lo, hi):
            total = 0.0
            for b in range(a, hi):
                total += scores[b]
                if total > 1e-9 and (found is None or total > found[0] + 1e-9 or abs(total - found[0]) <= 1e-9 and b - a < found[2] - found[1]):
                    found = (total, a, b)
        if found is None:
            return []
        total, a, b = found
        return [*best(lo, a), (a, b, round(total, 6)), *best(b + 1, hi)]

    return best(0, len(scores))


def test_segments():
    random.seed(4)
    for _ in range(300):
        scores = [random.choice([-0.25, -0.25, -0.25, 1.03125, 0.71875]) for _ in range(random.randint(1, 14))]
        at = np.array([i for i, s in enumerate(scores) if s > 0], np.int64)
        got = segments(at, np.array([s for s in scores if s > 0]), 0.25)
        want = segments_by_force(scores)
        assert sum(s for *_, s in got) == pytest.approx(sum(s for *_, s in want))
        assert max([s for *_, s in got], default=0) == pytest.approx(max([s for *_, s in want], default=0))
        for a, b, s in got:
            assert s == pytest.approx(sum(scores[a:b + 1]))


def test_toxicity_of_held_out_rows(more_documents, labels):
    model = fit_toxicity(more_documents, labels.filter(~held_out(F.col("doc_id"))))
    rows = score_toxicity(more_documents, model).join(labels, "doc_id").filter(held_out(F.col("doc_id"))).collect()
    toxic, clean = [r for r in rows if r.toxic], [r for r in rows if not r.toxic]
    assert sum(r.predicted for r in toxic) >= 0.7 * len(toxic)
    assert sum(r.predicted for r in clean) <= 0.03 * len(clean)
    assert all(0 <= r.score <= 1 and r.predicted == (r.score >= 0.7) for r in rows)
    found = [r for r in rows if r.passages]
    assert found
    for r in found:
        for p in r.passages:
            assert 0 <= p.start < p.end <= len(r.text) and p.chance <= 0.05 and r.text[p.start:p.end].strip() == r.text[p.start:p.end]


def test_toxicity_of_odd_rows(edge_docs, no_docs, more_documents, labels, spark):
    model = fit_toxicity(more_documents, labels)
    rows = score_toxicity(edge_docs, model).collect()
    assert len(rows) == edge_docs.count() and {r.part for r in rows} == set(range(len(rows)))
    lowest = min(r.score for r in rows)
    assert all(r.score == lowest and r.passages == [] for r in rows if not (r.text or "").strip())
    assert score_toxicity(no_docs, model).collect() == []
    untaught = fit_toxicity(edge_docs, spark.createDataFrame([(1, None), (None, 1), (2, 0)], "doc_id long, toxic int"))
    assert {r.predicted for r in score_toxicity(edge_docs, untaught).collect()} == {0}
    assert {r.predicted for r in score_toxicity(edge_docs, fit_toxicity(no_docs, labels.limit(0))).collect()} == {0}


def shared_word(spark, n, toxic, suspect):
    """n texts: the first ``toxic`` ones are toxic and hold a word that ``suspect`` clean ones hold as well."""
    row = F.col("id")
    text = F.concat(F.when(row < toxic + suspect, "grue ").otherwise("plain "), F.lit("with some words number"), row)
    table = spark.range(n).select(row.alias("doc_id"), text.alias("text"), (row < toxic).cast("int").alias("toxic"))
    return table.select("doc_id", "text"), table.select("doc_id", "toxic")


def test_toxicity_of_a_sample_has_the_share_of_all_rows(spark):
    docs, labels = shared_word(spark, 6000, 300, 300)
    whole, part = (score_toxicity(docs, fit_toxicity(docs, labels, **k)) for k in ({}, {"sample": 1000}))
    both = whole.join(part.select("doc_id", F.col("score").alias("other"), F.col("predicted").alias("guess")), "doc_id")
    r = both.agg(F.max(F.abs(F.col("score") - F.col("other"))).alias("gap"), F.sum("predicted").alias("a"), F.sum("guess").alias("b")).first()
    assert r.gap <= 0.1 and r.a == r.b == 0


def test_toxicity_learns_from_all_labelled_rows(spark):
    docs, labels = shared_word(spark, 60_000, 3000, 3000)
    r = score_toxicity(docs, fit_toxicity(docs, labels)).agg(F.max("score").alias("top"), F.sum("predicted").alias("n")).first()
    assert r.top == pytest.approx(0.5, abs=0.03) and r.n == 0


# ---- quality --------------------------------------------------------------------------------------
def counts_by_force(text):
    words = WORD.findall(text or "")
    runs = Counter(tuple(words[i:i + 3]) for i in range(len(words) - 2))
    inside = set()
    for i in range(len(words) - 2):
        if runs[tuple(words[i:i + 3])] > 1:
            inside |= {i, i + 1, i + 2}
    seen, repeated = set(), 0
    for line in (text or "").split("\n"):
        if WORD.search(line):
            repeated += line in seen
            seen.add(line)
    return len(words), sum(map(len, words)), len(re.findall(r"[#*$%&|<>]", text or "")), repeated, len(inside)


def test_rule_statistics(edge_docs, no_docs, documents):
    for docs in (edge_docs, documents):
        names = ("n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words")
        got = sorted([(r.doc_id, *(r[c] for c in names)) for r in rule_statistics(docs).collect()], key=str)
        assert got == sorted([(d, *counts_by_force(t)) for d, t in texts_of(docs)], key=str)
    assert rule_statistics(no_docs).collect() == []


def test_forest_verdicts(more_documents, labels):
    stats = rule_statistics(more_documents)
    forest = fit_quality(stats, labels.filter(~held_out(F.col("doc_id"))))
    rows = judge_quality(stats, forest).join(labels, "doc_id").filter(held_out(F.col("doc_id")) & ~F.col("base_failed")).collect()
    good, bad = [r for r in rows if r.quality], [r for r in rows if not r.quality]
    assert sum(r.kept for r in good) >= 0.95 * len(good) and sum(not r.kept for r in bad) >= 0.8 * len(bad)
    assert all(r.base_failed == failed(r.n_words, r.n_repeat_words) for r in rows)


def path_by_force(forest, t, x):
    node = 0
    while forest.feature[t, node] >= 0:
        node = forest.child[t, node] + (x[forest.feature[t, node]] >= forest.value[t, node])
    return forest.path[t, node]


def test_forest_paths(more_documents, labels, no_docs):
    forest = fit_quality(rule_statistics(more_documents), labels)
    x = shares(statistics(pa.array(["Plain words here. " * 30, "odd*** $$$ %%% " * 40, ""])))
    far = forest.distances(x)
    for i, score in enumerate(forest.scores(x)):
        mean = np.mean([path_by_force(forest, t, far[i]) for t in range(len(forest.feature))])
        usual = 2 * (math.log(forest.rows - 1) + 0.5772156649) - 2 * (forest.rows - 1) / forest.rows
        assert score == pytest.approx(2 ** -(mean / usual))
    empty = fit_quality(rule_statistics(no_docs), labels)
    assert judge_quality(rule_statistics(more_documents), empty).filter("NOT kept AND NOT base_failed").count() == 0


# ---- urls -----------------------------------------------------------------------------------------
RULES = [PathRule("allow", "org", "/"), PathRule("block", "example.org", "/es/"), PathRule("block", "com", "/de/")]
URLS = [None, "", "no scheme", "http://", "HTTP://A.Example.ORG/es/1?x=/de/#y", "http://example.org/es", "http://example.org", "x://notexample.org/es/",
        "http://badexample.com?/de/", "https://www.b.com/de/9", "a://b://c/d", "http://com/de/", "http://org#/es/"]


def parts_by_force(url):
    if url is None or "://" not in url:
        return "", ""
    rest = url.split("://", 1)[1]
    host = re.split(r"[/?#]", rest, maxsplit=1)[0]
    return host.translate(str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")), re.split(r"[?#]", rest[len(host):], maxsplit=1)[0]


def test_path_rules(spark):
    pages = spark.createDataFrame([(k, u, 1, "r") for k, u in enumerate(URLS)], "page_id long, url string, host int, rule string")
    for r in judge_urls(pages, RULES, []).collect():
        host, path = parts_by_force(r.url)
        assert (r.host, r.path) == (host, path), r.url
        fits = [x for x in RULES if (host == x.host or host.endswith("." + x.host)) and path.startswith(x.path)]
        best = max(fits, key=lambda x: len(x.name), default=None)
        assert (r.rule, r.verdict) == ((best.name, best.verdict) if best else (None, "allow")), r.url
    assert judge_urls(pages.limit(0), RULES, []).collect() == []
    assert pages.select(host_of(F.col("url")), path_of(F.col("url"))).count() == len(URLS)


def test_mined_rules(spark):
    """Bad pages are those with the path casino under any host but good.com; half of all pages share one host."""
    random.seed(3)
    rows = []
    for k in range(2000):
        host = "big.com" if k % 2 else random.choice(["a.net", "good.com", "c.net"])
        word = random.choice(["casino", "news", "shop", "wiki"])
        rows.append((k, f"https://{host}/{word}/{k}", word == "casino" and host != "good.com"))
    pages = spark.createDataFrame([(k, u) for k, u, _ in rows] + [(5000, None), (5001, "")], "page_id long, url string")
    labels = spark.createDataFrame([(k, b) for k, _, b in rows[:1500]] + [(None, True), (7, None)], "page_id long, bad boolean")
    rules = mine_rules(pages, labels, min_confidence=0.9)
    assert rules and all(c >= 0.9 for _, c, _ in rules)
    for tokens, confidence, _ in rules:  # confidence and support, counted again
        known = [(u, b) for _, u, b in rows[:1500]]
        held = [b for u, b in known if all(part_of(t, u) for t in tokens)]
        assert confidence == pytest.approx(sum(held) / len(held))
    for a, b in itertools.permutations(rules, 2):
        assert not set(a[0]) <= set(b[0])
    found = {r.page_id: r.verdict for r in judge_urls(pages, [], rules).collect()}
    wrong = sum((found[k] == "block") != b for k, _, b in rows[1500:])
    assert wrong <= 0.02 * 500 and found[5000] == found[5001] == "allow"
    assert mine_rules(pages, labels.limit(0)) == [] and mine_rules(pages.limit(0), labels) == []


def hosts_and_casinos(spark):
    """Six purely bad hosts, and pages under casino on good hosts of which four of five are bad. All pages are labelled."""
    rows = [(k, f"https://www.bad{'abcdef'[k % 6]}.example.net/en/{k}?page=1", True) for k in range(240)]
    rows += [(k, f"http://good{'abcd'[k // 7 % 4]}.org/{'casino' if k < 400 else 'news'}/{k}", k < 400 and k % 5 > 0) for k in range(240, 1200)]
    rows += [(1200, None, False), (1201, "", False), (3, rows[3][1], True)]
    pages = spark.createDataFrame([(k, u, "x") for k, u, _ in rows], "page_id long, url string, matched string")
    return pages, spark.createDataFrame([(k, b) for k, _, b in rows], "page_id long, bad boolean")


def test_mined_rules_are_pruned_before_they_are_counted(spark):
    pages, labels = hosts_and_casinos(spark)
    rules = mine_rules(pages, labels, max_rules=100)
    assert {("path:casino",), ("part:bada",), ("part:badf",)} <= {tokens for tokens, _, _ in rules}
    for a, b in itertools.permutations(rules, 2):
        assert not (set(a[0]) <= set(b[0]) and a[1] >= b[1])
    found = {r.page_id: r.verdict for r in judge_urls(pages, [], rules).collect()}
    assert all(found[k] == ("block" if k < 400 else "allow") for k in found)


def test_more_rules_than_are_broadcast(spark):
    pages, labels = hosts_and_casinos(spark)
    few, many = mine_rules(pages, labels), mine_rules(pages, labels, max_rules=2)
    assert len(few) > 2 and many.count() == len(few)
    want, got = judge_urls(pages, RULES, few), judge_urls(pages, RULES, many)
    assert got.columns == want.columns and sorted(got.collect(), key=str) == sorted(want.collect(), key=str)


def part_of(token, url):
    kind, value = token.split(":", 1)
    host, path = parts_by_force(url)
    pieces = {"scheme": ["https"], "host": host.split("."), "part": re.split("[.-]", host), "path": [re.sub("[0-9]+", "0", p) for p in path.split("/")]}
    return value in pieces.get(kind, [])


# ---- top-k ----------------------------------------------------------------------------------------
def top_by_force(rows, k, modulus):
    good = [(i, np.floor(1024.0 * np.array(v, np.float64)).astype(int)) for i, v in rows
            if i is not None and v is not None and all(x is not None and math.isfinite(x) for x in v)]
    out, asked = [], set()
    for i, q in good:
        if i % modulus or (i, tuple(q)) in asked:
            continue
        asked.add((i, tuple(q)))
        scored = sorted((-int(q @ c), j) for j, c in good if j != i and len(c) == len(q))
        out += [(i, rank, j, -s) for rank, (s, j) in enumerate(scored[:k], 1)]
    return sorted(out)


@pytest.mark.parametrize("block_rows", [40, 100_000])
def test_top_k(spark, block_rows):
    random.seed(5)
    rows = [(k, [float(np.float32(random.uniform(-0.6, 0.6))) for _ in range(16)]) for k in range(400)]
    rows += [(1000 + k, rows[10][1]) for k in range(150)]  # ties
    rows += [(2000, None), (2001, [0.1, None]), (2002, [float("nan")] * 16), (2003, [float("inf")] * 16), (None, rows[0][1]), (2004, [0.5, 0.5]),
             (2005, [0.25, -0.5]), (3, rows[3][1]), (2010, []), (2020, [0.0] * 16), (2030, [-0.1] * 16)]
    df = spark.createDataFrame([(i, v, 7) for i, v in rows], "vec_id long, embedding array<float>, score int")
    got = sorted(map(tuple, top_k(df, F.col("vec_id") % 5 == 0, 10, block_rows=block_rows).collect()))
    assert got == top_by_force(rows, 10, 5)
    assert top_k(df.limit(0), F.col("vec_id") % 5 == 0).collect() == []


def test_slices_leave_few_rows_to_score():
    random_ = np.random.default_rng(1)
    values = random_.integers(-500, 500, (5000, 64))
    block = SlicedBlock.build(np.arange(5000), values)
    query = values[17]
    height = block._sum(query)
    total = sum(np.unpackbits(h.view(np.uint8), bitorder="little")[:5000].astype(int) << i for i, h in enumerate(height))
    coarse = (values - block.low) >> block.shift
    want = np.where(query < 0, 255 - coarse, coarse) @ np.abs(query)
    assert (total == want).all()
    ids, scores = block.search(17, query, 10)
    exact = values @ query
    order = [i for i in np.lexsort((np.arange(5000), -exact)) if i != 17][:10]
    assert ids.tolist() == order and scores.tolist() == exact[order].tolist()


def test_top_k_of_vectors_beyond_64_bits(spark):
    random.seed(6)
    far = [1e30, -1e30, 2e30, 1.5e300, -1.7e305, 1.79e308, 2.0**14, -(2.0**14), 0.3, -0.7, 0.0, 1e-300]
    rows = [(k, [random.choice(far) for _ in range(3)]) for k in range(60)]
    rows += [(100 + k, [random.uniform(-1, 1) for _ in range(3)]) for k in range(40)] + [(200, [1e30]), (205, [-1e30]), (210, [0.5]), (7, rows[7][1])]
    df = spark.createDataFrame(rows, "vec_id long, embedding array<double>")
    exact = [(i, [x.as_integer_ratio()[0] * 1024 // x.as_integer_ratio()[1] for x in v]) for i, v in rows]
    want, asked = [], set()
    for i, q in exact:
        if i % 5 == 0 and (i, tuple(q)) not in asked:
            asked.add((i, tuple(q)))
            scored = sorted((-sum(a * b for a, b in zip(q, c, strict=True)), j) for j, c in exact if j != i and len(c) == len(q))
            want += [(i, rank, j, max(-(2**63), min(2**63 - 1, -s))) for rank, (s, j) in enumerate(scored[:10], 1)]
    assert sorted(map(tuple, top_k(df, F.col("vec_id") % 5 == 0).collect())) == sorted(want)
