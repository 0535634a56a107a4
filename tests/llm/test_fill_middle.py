"""Fill-in-middle against brute force and an exact round trip."""

import hashlib
import random
import re

import pytest

from staygauge.llm.fill_middle import fill_in_middle

from .conftest import texts_of


def by_force(doc_id, text):
    text = text or ""
    units = re.findall("[A-Za-z]+|[^A-Za-z]", text)
    n = len(units)
    h = hashlib.sha256(f"1:{'' if doc_id is None else doc_id}".encode()).hexdigest()
    h1, h2, h3, h4 = (int(h[8 * k:8 * k + 8], 16) for k in range(4))
    a, b = sorted((h1 % (n + 1), h2 % (n + 1)))
    prefix, middle, suffix = ("".join(units[x:y]) for x, y in ((0, a), (a, b), (b, n)))
    if not text or any(m in text for m in ("<P>", "<S>", "<M>")) or h3 % 100 >= 90:
        return doc_id, n, "plain", None, None, text, text
    if h4 % 100 < 20:
        return doc_id, n, "spm", len(prefix), len(middle), f"<S>{suffix}<P>{prefix}<M>{middle}", text
    return doc_id, n, "psm", len(prefix), len(middle), f"<P>{prefix}<S>{suffix}<M>{middle}", text


def sha(text):
    return hashlib.sha256(text.encode()).hexdigest()


@pytest.fixture(scope="module")
def odd_docs(spark, edge_docs):
    random.seed(5)
    signs = ["<", "P", "S", "M", ">", "<P", "S>", "a", "Bc", " ", "\n", "é", "日", "\x00", "0", "<M>"]
    rows = [(k % 70 - 10, "".join(random.choice(signs[:15] if k % 9 else signs) for _ in range(random.randint(0, 60)))) for k in range(200)]
    rows += [(500 + k, "x" * 50_000 + " y" * 30_000) for k in range(3)] + [(600, "same row"), (600, "same row"), (601, "same row")] * 20
    odd = spark.createDataFrame([(d, t, 1, "f") for d, t in rows], "doc_id long, text string, position int, form string")
    return edge_docs.select("doc_id", "text", "part", "score").withColumnsRenamed({"part": "position", "score": "form"}).unionByName(
        odd.selectExpr("doc_id", "text", "cast(position as long) as position", "form"))


@pytest.mark.parametrize("chunk", [7, 4096])
def test_output_and_restoration(odd_docs, documents, chunk):
    for docs in (odd_docs.repartition(3), documents):
        expected = sorted([by_force(d, t) for d, t in texts_of(docs)], key=str)
        rows = fill_in_middle(docs, chunk=chunk, with_texts=True).collect()
        got = [(r.doc_id, r.n, r.form, r.prefix_chars, r.middle_chars, r.output, r.restored) for r in rows]
        assert sorted(got, key=str) == expected
        assert all((r.output_sha256, r.restored_sha256) == (sha(r.output), sha(r.restored)) for r in rows)
    assert {"plain", "psm", "spm"} == {r[2] for r in expected}


def test_digests_without_texts(odd_docs):
    got = sorted([tuple(r) for r in fill_in_middle(odd_docs).collect()], key=str)
    assert got == sorted([(*row[:5], sha(row[5]), sha(row[6])) for row in (by_force(d, t) for d, t in texts_of(odd_docs))], key=str)


def test_nothing(no_docs):
    assert fill_in_middle(no_docs).collect() == []
