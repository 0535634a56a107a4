"""The prefix trie of conversations against brute force."""

import hashlib
import random
import re
import zlib
from collections import defaultdict

import pytest

from staygauge.llm.prefix_trie import prefix_trie

WORD = re.compile(r"[^\x20\x09-\x0D]+")


def by_force(rows):
    turns = defaultdict(list)
    for c, turn, role, text in rows:
        if c is not None:
            turns[c].append((turn is not None, turn or 0, role or "", text or ""))
    own = {c: [t[2:] for t in sorted(found)] for c, found in turns.items()}
    whole = {}
    for c, found in own.items():
        h = zlib.crc32(str(c).encode()) % 4
        base = c - (c % 20 if c >= 0 else -(-c % 20))
        whole[c] = tuple(own.get(base, [])[:h] + found[h:])
    members = defaultdict(list)
    for c, found in whole.items():
        for d in range(len(found) + 1):
            members[found[:d]].append(c)
    out = []
    children = defaultdict(list)
    for node in members:
        if node:
            children[node[:-1]].append(node)

    def totals(node):
        below, leaves, saved = list(children[node]), int(not children[node]), 0
        todo = [node]
        while todo:
            x = todo.pop()
            saved += (len(members[x]) - 1) * len(WORD.findall(x[-1][1])) if x else 0
            todo += children[x]
            below += children[x] if x is not node else []
            leaves += int(not children[x]) if x is not node else 0
        return leaves, saved

    for node, found in members.items():
        ends = sorted(c for c in found if whole[c] == node)
        out.append((min(found), len(node), min(members[node[:-1]]) if node else None, len(found), len(children[node]), *totals(node),
                    hashlib.sha256(",".join(map(str, ends)).encode()).hexdigest()))
    return sorted(out, key=str)


def rows_of(df):
    return [(r.conv_id, r.turn, r.role, r.text) for r in df.collect()]


@pytest.fixture(scope="module")
def odd(spark):
    random.seed(8)
    rows = []
    for c in [*range(-25, 30), *range(4090, 4125), 100_000_019]:
        for turn in range(random.randint(0, 6)):
            rows.append((c, turn, random.choice(["user", "assistant", None]), random.choice(["hi", "yes no", "", None, "é  ü", "a b c"])))
    rows += [(40 + 20 * k, 0, "user", "same") for k in range(12)] + [(45 + 20 * k, j, "user", "same") for k in range(12) for j in range(3)]
    rows += [(50, None, "user", "first"), (50, 3, "user", "b"), (50, 3, "user", "a"), (50, 3, "assistant", "z"), (50, 3, "user", "a")]
    rows += [(None, 0, "user", "nobody"), (60, None, None, None)]
    rows += [(70, t, "user", f"turn {t % 7}") for t in range(150)] + [(71, t, "user", f"turn {t % 7}") for t in range(149)]
    rows += [(72, 1, "user", "x" * 200 + end) for end in "cab"] + [(73, 5, "user", "long " * 20_000)]
    random.shuffle(rows)
    return spark.createDataFrame([(*r, 1, "e") for r in rows], "conv_id long, turn long, role string, text string, depth int, a string")


def test_odd_conversations(odd):
    # The hashed end of the order of ties is left out: only the first 64 characters tell these rows apart.
    told = odd.filter("conv_id is null or conv_id != 72")
    got = sorted([tuple(r) for r in prefix_trie(told.repartition(5)).collect()], key=str)
    assert got == by_force(rows_of(told))


def test_long_ties_do_not_depend_on_the_partitions(odd):
    a, b = (sorted([tuple(r) for r in prefix_trie(odd.filter("conv_id = 72").repartition(n)).collect()], key=str) for n in (1, 3))
    assert a == b and len(a) == 4 - zlib.crc32(b"72") % 4


def test_table(spark):
    table = spark.read.parquet("/root/testdata/sf0.001/conversations.parquet")
    assert sorted([tuple(r) for r in prefix_trie(table).collect()], key=str) == by_force(rows_of(table))


def test_nothing(odd):
    assert prefix_trie(odd.limit(0)).collect() == []
    assert prefix_trie(odd.filter("conv_id is null")).collect() == []


def test_turnless_root(spark):
    """A single conversation of two turns whose first h are cut and whose base is absent."""
    c = next(c for c in range(1, 1000) if c % 20 and zlib.crc32(str(c).encode()) % 4 >= 2)
    rows = [(c, 0, "user", "a"), (c, 1, "user", "b")]
    got = prefix_trie(spark.createDataFrame(rows, "conv_id long, turn long, role string, text string")).collect()
    assert [tuple(r) for r in got] == [(c, 0, None, 1, 0, 1, 0, hashlib.sha256(str(c).encode()).hexdigest())] == by_force(rows)
