"""SimHash near-duplicates: fingerprints embedded as popcounts of their segments, and a grid range-join of the embeddings."""

from __future__ import annotations

import re
from collections.abc import Iterator
from itertools import combinations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from xxhash import xxh64_digest

from staygauge.llm.similarity_join import _by_key
from staygauge.llm.words import bounded, buffer_of
from staygauge.operators.components import connected_components
from staygauge.session import settle

# Fixed values of the contract.
SHINGLE = 4
SEED = 42
DISTANCE = 4

SMALL_BUCKET = 1024
USUAL_BUCKET = 128  # fingerprints that a cell of the first grid should hold, were they spread evenly
PART_BYTES = 1 << 20

_SPACE = re.compile(rb"[\x20\x09-\x0D]")


def word_parts(raw: bytes, shingle: int, size: int = PART_BYTES) -> Iterator[list[bytes]]:
    """Words of a text in parts, A-Z in lower case. Each part begins with the last ``shingle`` - 1 words of the one before."""
    at, last = 0, []
    while at < len(raw):
        gap = _SPACE.search(raw, at + size) if len(raw) - at > size else None
        end = gap.start() if gap else len(raw)
        words = last + raw[at:end].lower().split()  # of bytes, both know ASCII only
        yield words
        last = words[max(0, len(words) - shingle + 1):]
        at = end


def fingerprint(raw: bytes, shingle: int = SHINGLE) -> bytes:
    """8 bytes, the highest bit first: a bit is 1 if it is set in over half the shingle hashes. No words: zero."""
    ones, n, short = np.zeros(64, np.int64), 0, []
    for words in word_parts(raw, shingle):
        if len(words) < shingle:
            short = words
            continue
        sizes = np.fromiter(map(len, words), np.int64, len(words))
        ends = np.cumsum(sizes + 1) - 1
        joined = b" ".join(words)
        spans = zip((ends - sizes)[:len(words) - shingle + 1].tolist(), ends[shingle - 1:].tolist(), strict=True)
        found = np.frombuffer(b"".join([xxh64_digest(joined[a:b], SEED) for a, b in spans]), np.uint8).reshape(-1, 8)
        for lo in range(0, len(found), 1 << 16):
            ones += np.unpackbits(found[lo:lo + (1 << 16)], axis=1).sum(axis=0, dtype=np.int64)
        n += len(found)
    if not n:
        return xxh64_digest(b" ".join(short), SEED) if short else bytes(8)
    return np.packbits(2 * ones > n).tobytes()


def _fingerprints(shingle: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in bounded(batches, 1):
            data, offsets = buffer_of(batch.column(1))
            whole, at = data.tobytes(), offsets.tolist()
            found = b"".join([fingerprint(whole[a:b], shingle) for a, b in zip(at, at[1:], strict=False)])
            yield pa.RecordBatch.from_arrays(
                [batch.column(0), pa.array(np.frombuffer(found, ">i8").astype(np.int64))], ["doc_id", "fp"])

    return run


def embedding(fps: np.ndarray, width: int) -> np.ndarray:
    """Popcounts of the segments of ``width`` bits: 64 / width numbers a fingerprint. A bit that differs changes one of them by
    one, so the Manhattan distance of two embeddings is never above the number of differing bits."""
    mask = np.uint64((1 << width) - 1)
    shifts = np.arange(0, 64, width).astype(np.uint64)
    return np.bitwise_count((fps.astype(np.uint64)[:, None] >> shifts) & mask)


def _cells(width: int):
    """(cell, fp): the lattice points within Manhattan distance 1 of either half of a fingerprint's embedding."""
    half, bits = 32 // width, {1: 1, 2: 2, 4: 3}[width]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            fps = batch.column(0).to_numpy()
            counts, cells, rows = embedding(fps.view(np.uint64), width).astype(np.int64), [], []
            every = np.arange(len(fps))
            for side in (0, 1):
                own = counts[:, side * half:(side + 1) * half]
                centre = (own << (bits * np.arange(half))).sum(axis=1) + (side << 62)
                cells.append(centre)
                rows.append(every)
                for j in range(half):
                    for step, some in ((1, np.flatnonzero(own[:, j] < width)), (-1, np.flatnonzero(own[:, j] > 0))):
                        cells.append(centre[some] + step * (1 << (bits * j)))
                        rows.append(some)
            yield pa.RecordBatch.from_arrays([pa.array(np.concatenate(cells)), pa.array(fps[np.concatenate(rows)])], ["cell", "fp"])

    return run


def _forest(i: np.ndarray, j: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Links (node, smallest node of its connected part) that replace the links (i, j)."""
    nodes, at = np.unique(np.concatenate((i, j)), return_inverse=True)
    i, j = at[:len(i)], at[len(i):]
    label = np.arange(len(nodes))
    while True:
        low = np.minimum(label[i], label[j])
        new = label.copy()
        for side in (i, j):
            np.minimum.at(new, label[side], low)
            np.minimum.at(new, side, low)
        new = new[new]
        if (new == label).all():
            break
        label = new
    some = np.flatnonzero(label != np.arange(len(nodes)))
    return nodes[some], nodes[label[some]]


def _cell_links(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Whole cells, sorted: every two fingerprints of a cell are compared, and a spanning forest of the links is returned."""
    for table in _by_key(batches, 1):
        cell, fp = table.column("cell").to_numpy(), table.column("fp").to_numpy()
        bits = fp.view(np.uint64)
        first, second, ahead, i = [], [], 0, np.arange(len(cell))
        while len(i):
            ahead += 1
            i = i[i < len(cell) - ahead]
            i = i[cell[i + ahead] == cell[i]]
            near = i[np.bitwise_count(bits[i] ^ bits[i + ahead]) <= DISTANCE]
            first.append(near)
            second.append(near + ahead)
        u, v = _forest(np.concatenate(first), np.concatenate(second))
        yield pa.RecordBatch.from_arrays([pa.array(fp[u]), pa.array(fp[v])], ["u", "v"])


def _middles(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """(middle, fp): all numbers that differ from a fingerprint in at most DISTANCE / 2 bits."""
    flips = [0, *[sum(1 << b for b in bits) for k in range(1, DISTANCE // 2 + 1) for bits in combinations(range(64), k)]]
    masks = np.array(flips, np.uint64)
    for batch in batches:
        fps = batch.column(0).to_numpy()
        for lo in range(0, len(fps), 256):
            some = fps[lo:lo + 256]
            middle = (some.view(np.uint64)[:, None] ^ masks).ravel()
            yield pa.RecordBatch.from_arrays([pa.array(middle.view(np.int64)), pa.array(np.repeat(some, len(masks)))], ["middle", "fp"])


def first_width(fingerprints: int) -> int:
    """The widest segments whose grid spreads so many fingerprints thinly enough; a half has 16, 24 or 32 bits of entropy."""
    for width, copies, bits in ((4, 16, 16), (2, 25, 24)):
        if fingerprints * copies <= USUAL_BUCKET << bits:
            return width
    return 1


def fingerprint_links(fps: DataFrame, width: int | None = None, small_bucket: int = SMALL_BUCKET) -> DataFrame:
    """Links (u, v) of distinct fingerprints (fp) that have the connected parts of all links of at most DISTANCE bits.

    Of two linked fingerprints one half differs in two bits at most, so their embeddings of that half are within Manhattan
    distance two, and a lattice point lies within one of both: it is a cell in which they meet. Pairs that meet are compared
    exactly. Fingerprints in a cell of more than ``small_bucket`` go on to a grid of narrower segments, all their cells anew. If
    a cell is still too large with segments of one bit, its fingerprints are linked over exact middles: two fingerprints are at
    most four bits apart if and only if some number is at most two bits from both, so all that share a number hang on the
    smallest of them. No pair is lost at any step, and rows grow with the fingerprints only.
    """
    links, width = [], width or first_width(fps.count())
    while True:
        cells = settle(fps.select("fp").mapInArrow(_cells(width), "cell long, fp long"), "cells")
        # Settled, so that the join has plain sides: Spark can then split the rows of a hot cell.
        sizes = settle(cells.groupBy("cell").agg(F.count(F.lit(1)).alias("size")).filter("size > 1"), "cell_sizes")
        rows = settle(cells.join(sizes, "cell"), "shared_cells")
        met = rows.filter(F.col("size") <= small_bucket).select("cell", "fp").repartition("cell").sortWithinPartitions("cell")
        links.append(met.mapInArrow(_cell_links, "u long, v long"))
        fps = settle(rows.filter(F.col("size") > small_bucket).select("fp").distinct(), "crowded")
        if fps.isEmpty():
            break
        if width == 1:
            middles = settle(fps.mapInArrow(_middles, "middle long, fp long"), "middles")
            lead = settle(middles.groupBy("middle").agg(F.min("fp").alias("v"), F.count(F.lit(1)).alias("n")).filter("n > 1"), "leads")
            links.append(middles.join(lead.select("middle", "v"), "middle").select(F.col("fp").alias("u"), "v"))
            break
        width //= 2
    out = links[0]
    for more in links[1:]:
        out = out.unionAll(more)
    return out.filter("u != v").distinct()


def simhash_components(
    docs: DataFrame, shingle: int = SHINGLE, width: int | None = None, small_bucket: int = SMALL_BUCKET,
) -> DataFrame:
    """doc_id, fingerprint (16 hex digits) and component_id of every row of ``docs`` (doc_id, text).

    Words are runs of characters other than ASCII white space, A-Z in lower case; a fingerprint has a bit where over half the
    hashes of the text's shingles of ``shingle`` words have it, repeats counted. A shorter text is one shingle; a null or empty
    text has fingerprint zero and is linked like any other. Rows whose fingerprints differ in four bits or fewer are linked;
    component_id is the smallest doc_id of a row's connected part, null if all of them are null. Rows of one doc_id are linked by
    their fingerprints only. Other columns are not read; an empty table gives none.

    Equal fingerprints are one before any comparison (``fingerprint_links``), and hang on their fingerprint by an equi-join.
    """
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
    prints = settle(rows.mapInArrow(_fingerprints(shingle), "doc_id long, fp long"), "fingerprints")
    distinct = settle(prints.groupBy("fp").agg(F.min("doc_id").alias("first")), "distinct_fingerprints")
    parts = connected_components(fingerprint_links(distinct, width, small_bucket))
    placed = settle(distinct.join(parts.withColumnRenamed("node", "fp"), "fp", "left").select(
        "fp", "first", F.coalesce("component", "fp").alias("component")), "placed")
    ids = settle(placed.groupBy("component").agg(F.min("first").alias("component_id")), "component_ids")
    named = settle(placed.join(ids, "component").select("fp", "component_id"), "named_fingerprints")
    hexadecimal = F.lpad(F.lower(F.hex("fp")), 16, "0").alias("fingerprint")
    return prints.join(named, "fp").select("doc_id", hexadecimal, "component_id")
