"""SimHash near-duplicates against brute force."""

import random
import re

import pytest
from xxhash import xxh64_intdigest

from staygauge.llm.simhash import DISTANCE, first_width, fingerprint, fingerprint_links, simhash_components, word_parts

from .conftest import texts_of

WORD = re.compile(r"[^\x20\x09-\x0D]+")
UPPER = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def fingerprint_by_force(text):
    words = WORD.findall((text or "").translate(UPPER))
    if not words:
        return 0
    shingles = [" ".join(words[i:i + 4]) for i in range(max(1, len(words) - 3))]
    h = [xxh64_intdigest(s.encode(), 42) for s in shingles]
    return sum(1 << b for b in range(64) if 2 * sum(x >> b & 1 for x in h) > len(h))


def parts_by_force(numbers):
    """The smallest number of each number's connected part."""
    left, out = sorted(numbers), {}
    while left:
        part, todo = set(), [left[0]]
        while todo:
            x = todo.pop()
            part.add(x)
            near = [y for y in left if y not in part and (x ^ y).bit_count() <= DISTANCE]
            part.update(near)
            todo += near
        out |= dict.fromkeys(part, min(part))
        left = [x for x in left if x not in part]
    return out


def components_by_force(rows):
    prints = [fingerprint_by_force(t) for _, t in rows]
    part = parts_by_force(set(prints))
    first = {}
    for (d, _), p in zip(rows, prints, strict=True):
        if d is not None:
            first[part[p]] = min(d, first.get(part[p], d))
    return sorted([(d, f"{p:016x}", first.get(part[p])) for (d, _), p in zip(rows, prints, strict=True)], key=str)


def test_components(edge_docs, documents):
    for docs in (edge_docs, documents):
        got = sorted([tuple(r) for r in simhash_components(docs).collect()], key=str)
        assert got == components_by_force(texts_of(docs))


def test_nothing(no_docs):
    assert simhash_components(no_docs).collect() == []


def test_long_texts_are_read_in_parts():
    random.seed(3)
    text = "".join(random.choice(["A", "bc", "é", " ", "  ", "\n", "\x0b", "d" * 40]) for _ in range(3000))
    raw = text.encode()
    parts = list(word_parts(raw, 4, 50))
    news = [w for before, own in zip([[], *parts], parts, strict=False) for w in own[min(3, len(before)):]]
    assert len(parts) > 50 and news == raw.lower().split()
    assert int.from_bytes(fingerprint(raw), "big") == fingerprint_by_force(text)


def near(x, bits):
    for b in random.sample(range(64), bits):
        x ^= 1 << b
    return x


@pytest.mark.parametrize(("width", "small_bucket"), [(4, 1024), (2, 1024), (1, 1024), (4, 3), (1, 3)])
def test_links_of_every_grid_and_of_crowded_cells(spark, width, small_bucket):
    random.seed(width)
    found = set()
    for _ in range(30):  # chains and balls of near fingerprints around random ones; 0 and all ones are borders of the grid
        x = random.choice([0, (1 << 64) - 1, random.getrandbits(64)])
        found.add(x)
        for _ in range(12):
            x = near(x, random.choice([1, 2, 3, 4, 5]))
            found |= {x, near(x, random.choice([3, 4, 5]))}
    numbers = sorted(found)
    signed = [x - (1 << 64) if x >> 63 else x for x in numbers]
    fps = spark.createDataFrame([(x,) for x in signed], "fp long")
    links = [(r.u % (1 << 64), r.v % (1 << 64)) for r in fingerprint_links(fps, width, small_bucket).collect()]
    assert all(u != v for u, v in links) and len(links) == len(set(links))
    label = {x: x for x in numbers}

    def root(x):
        while label[x] != x:
            x = label[x]
        return x

    for u, v in links:
        a, b = sorted((root(u), root(v)))
        label[b] = a
    assert {x: root(x) for x in numbers} == parts_by_force(numbers)


def test_the_grid_grows_finer_with_the_table():
    assert [first_width(n) for n in (1000, 10_000_000, 10**11)] == [4, 2, 1]
