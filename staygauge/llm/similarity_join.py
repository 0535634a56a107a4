"""Chosen-path similarity join of documents on word shingles, with exact verification."""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from staygauge.llm.words import SPACES, bounded, buffer_of, grams, hashes, mixed, spans
from staygauge.operators.components import connected_components
from staygauge.session import settle

SHINGLE = 5
SIMILARITY = 0.8
RECALL = 0.999
COORDINATES = 64
MARGIN = 0.16  # 3.2 standard deviations of a similarity of 0.8 that is estimated from 64 coordinates
DEPTH = 3
SMALL_BUCKET = 1024
BLOCK = 256

_FEATURES = "doc_id long, n_shingles long, d1 long, d2 long, sketch binary, brief binary"


def survival(depth: int, similarity: float = SIMILARITY) -> float:
    """Chance that a pair of just this similarity shares a node of the given depth in one run: a branching process with a mean of
    one shared child a node."""
    lost = 0.0
    for _ in range(depth):
        lost = math.exp(lost - 1)
    return 1 - lost


def runs_for(recall: float, depth: int) -> int:
    return math.ceil(math.log(1 - recall) / math.log(1 - survival(depth)))


def shingle_sets(texts: pa.Array, shingle: int = SHINGLE) -> tuple[np.ndarray, np.ndarray, int]:
    """Distinct shingle hashes of a batch, sorted by text, with the number of their text. A shorter text is one shingle."""
    data, offsets = buffer_of(texts)
    words = spans(data, offsets, SPACES)
    h = hashes(words)
    value, at = grams(h, words.text, shingle)
    text = words.text[at]
    count = words.counts()
    short = np.flatnonzero((count > 0) & (count < shingle))
    if len(short):
        place = words.start.searchsorted(offsets[short])
        own = np.array([np.bitwise_xor.reduce(mixed(h[p:p + n] + np.arange(n, dtype=np.uint64))) for p, n in zip(place, count[short], strict=True)])
        value, text = np.concatenate((value, mixed(own))), np.concatenate((text, short))
    order = np.lexsort((value, text))
    value, text = value[order], text[order]
    new = np.ones(len(value), dtype=bool)
    new[1:] = (value[1:] != value[:-1]) | (text[1:] != text[:-1])
    return value[new], text[new], words.texts


def _features(shingle: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        factors = mixed(np.arange(COORDINATES) + 5_000) | np.uint64(1)
        for batch in bounded(batches, 1):
            value, text, texts = shingle_sets(batch.column(1), shingle)
            n = np.bincount(text, minlength=texts)
            some = np.flatnonzero(n)
            first = np.concatenate(([0], np.cumsum(n[some])[:-1])).astype(np.int64)
            digest = np.zeros((2, texts), np.int64)
            # 32 bits to split by, so that chance buckets stay few at any size; 16 bits to compare within a bucket.
            sketch = np.zeros((texts, COORDINATES), "<u4")
            if len(some):
                digest[0, some] = np.add.reduceat(mixed(value), first).view(np.int64)
                digest[1, some] = np.add.reduceat(mixed(value ^ np.uint64(0x5BD1E995)), first).view(np.int64)
                for i, factor in enumerate(factors):
                    least = np.minimum.reduceat((value * factor) >> np.uint64(20), first)
                    sketch[some, i] = mixed(least).astype(np.uint32)
            yield pa.RecordBatch.from_arrays(
                [batch.column(0), pa.array(n), pa.array(digest[0]), pa.array(digest[1]),
                 pa.array([row.tobytes() for row in sketch], pa.binary()),
                 pa.array([row.tobytes() for row in sketch.astype("<u2")], pa.binary())],
                ["doc_id", "n_shingles", "d1", "d2", "sketch", "brief"])

    return run


def _sketches(column: pa.Array, kind: str) -> np.ndarray:
    return np.frombuffer(b"".join(column.to_pylist()), kind).reshape(-1, COORDINATES)


def _children(similarity: float):
    """Rows (path, rep) for the coordinates that each row's node samples. The sample depends on the node alone."""
    limit = np.uint64(int((1 << 53) / (similarity * COORDINATES)))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            node = mixed(batch.column(0).to_numpy().view(np.uint64))
            rep, sketch = batch.column(1).to_numpy(), _sketches(batch.column(2), "<u4") if batch.num_rows else None
            paths, reps = [], []
            for i in range(COORDINATES if batch.num_rows else 0):
                chosen = np.flatnonzero((mixed(node + np.uint64(i + 1)) >> np.uint64(11)) < limit)
                paths.append(mixed(node[chosen] ^ ((sketch[chosen, i].astype(np.uint64) << np.uint64(8)) | np.uint64(i))).view(np.int64))
                reps.append(rep[chosen])
            if paths:
                yield pa.RecordBatch.from_arrays([pa.array(np.concatenate(paths)), pa.array(np.concatenate(reps))], ["path", "rep"])

    return run


def _by_key(batches: Iterator[pa.RecordBatch], keys: int) -> Iterator[pa.Table]:
    """Whole groups of rows that come sorted by their first columns; many groups at a time, the last one of a batch kept back."""
    held = None
    for batch in batches:
        table = pa.Table.from_batches([batch])
        table = table if held is None else pa.concat_tables([held, table])
        if not table.num_rows:
            continue
        last = [table.column(k)[table.num_rows - 1].as_py() for k in range(keys)]
        same = np.ones(table.num_rows, dtype=bool)
        for k, value in enumerate(last):
            same &= table.column(k).to_numpy() == value
        cut = int(np.flatnonzero(~same)[-1]) + 1 if not same.all() else 0
        held = table.slice(cut)
        if cut:
            yield table.slice(0, cut)
    if held is not None and held.num_rows:
        yield held


def _groups(table: pa.Table, keys: int) -> list[tuple[int, int]]:
    new = np.zeros(table.num_rows, dtype=bool)
    new[0] = True
    for k in range(keys):
        column = table.column(k).to_numpy()
        new[1:] |= column[1:] != column[:-1]
    first = np.flatnonzero(new)
    return list(zip(first.tolist(), [*first[1:].tolist(), table.num_rows], strict=True))


def _roots(near: np.ndarray) -> np.ndarray:
    """The first row of each connected part of a symmetric table of booleans."""
    label = np.arange(len(near))
    np.fill_diagonal(near, True)
    while True:
        lower = np.where(near, label, len(near)).min(axis=1)
        lower = np.minimum(lower, lower[lower])
        if (lower == label).all():
            return label
        label = lower


def _alike(a: np.ndarray, least: int) -> np.ndarray:
    """Which rows agree with which in at least so many coordinates."""
    out = np.zeros((len(a), len(a)), dtype=bool)
    step = max(1, 1_000_000 // (len(a) * COORDINATES))
    for i in range(0, len(a), step):
        out[i:i + step] = (a[i:i + step, None, :] == a[None, :, :]).sum(axis=2) >= least
    return out


def _bucket_links(similarity: float):
    least = math.floor((similarity - MARGIN) * COORDINATES)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for table in _by_key(batches, 1):
            rep, sketch = table.column("rep").to_numpy(), _sketches(table.column("brief"), "<u2")
            u, v = [], []
            pairs = []
            for a, b in _groups(table, 1):
                if b - a == 2:
                    pairs.append(a)
                elif b - a > 2:
                    root = _roots(_alike(sketch[a:b], least))
                    linked = np.flatnonzero(root != np.arange(b - a))
                    u.append(rep[a + linked])
                    v.append(rep[a + root[linked]])
            at = np.array(pairs, np.int64)
            at = at[(sketch[at] == sketch[at + 1]).sum(axis=1) >= least] if len(at) else at
            u, v = np.concatenate([*u, rep[at]]), np.concatenate([*v, rep[at + 1]])
            yield pa.RecordBatch.from_arrays([pa.array(u, pa.int64()), pa.array(v, pa.int64())], ["u", "v"])

    return run


def candidate_links(reps: DataFrame, similarity: float, recall: float, depth: int) -> DataFrame:
    """Links (u, v) that keep all pairs that share a bucket and look alike in one connected part."""
    spark = reps.sparkSession
    children = _children(similarity)
    roots = spark.range(runs_for(recall, depth)).select(F.xxhash64("id").alias("root"))
    nodes = reps.select(F.explode(F.array(*[F.lit(r.root) for r in roots.collect()])).alias("path"), "rep", "sketch")
    links = []
    for level in range(1, depth + 1):
        rows = nodes.mapInArrow(children, "path long, rep long")
        rows = settle(rows, "paths") if level == 1 else rows
        # Settled, so that the join below has a plain side: Spark can then split the rows of a hot path.
        sizes = settle(rows.groupBy("path").agg(F.count(F.lit(1)).alias("size")).filter("size > 1"), "path_sizes")
        rows = settle(rows.join(sizes, "path"), "buckets")
        small = rows.filter(F.col("size") <= SMALL_BUCKET).join(reps.select("rep", "brief"), "rep").select("path", "rep", "brief")
        sorted_rows = small.repartition("path").sortWithinPartitions("path", "rep")
        links.append(sorted_rows.mapInArrow(_bucket_links(similarity), "u long, v long"))
        nodes = rows.filter(F.col("size") > SMALL_BUCKET).join(reps.select("rep", "sketch"), "rep").select("path", "rep", "sketch")
        if nodes.isEmpty():
            break
    else:
        # Still large after agreeing in several sampled coordinates: taken as candidates together, to be verified exactly.
        lead = nodes.groupBy("path").agg(F.min("rep").alias("v"))
        links.append(nodes.join(lead, "path").select(F.col("rep").alias("u"), "v"))
    out = links[0]
    for more in links[1:]:
        out = out.unionAll(more)
    return out.filter("u != v").distinct()


def _sets(shingle: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in bounded(batches, 3):
            value, text, texts = shingle_sets(batch.column(3), shingle)
            ends = np.cumsum(np.bincount(text, minlength=texts))
            cuts = np.split(value, ends[:-1]) if texts else []
            yield pa.RecordBatch.from_arrays([*batch.columns[:-1], pa.array([c.tobytes() for c in cuts], pa.binary())],
                                             [*batch.schema.names[:-1], "shingles"])

    return run


def _common(left: list[bytes], right: list[bytes]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Sizes of the sets and of all intersections."""
    sets = [np.frombuffer(s, "<u8") for s in (*left, *right)]
    size = np.array([len(s) for s in sets])
    _, item = np.unique(np.concatenate(sets), return_inverse=True)
    times = np.bincount(item)
    used = np.cumsum(times > 1) - 1
    row = np.repeat(np.arange(len(sets)), size)
    keep = times[item] > 1
    item, row = used[item[keep]], row[keep]
    total = np.zeros((len(left), len(right)), np.float32)
    width = 8192
    for lo in range(0, int(item.max()) + 1 if len(item) else 0, width):
        part = (item >= lo) & (item < lo + width)
        table = np.zeros((len(sets), width), np.float32)
        table[row[part], item[part] - lo] = 1
        total += table[:len(left)] @ table[len(left):].T
    return size[:len(left)], size[len(left):], total


def _verify(similarity: float):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for table in _by_key(batches, 3):
            side, rep, raw = table.column("side").to_numpy(), table.column("rep").to_numpy(), table.column("shingles").to_pylist()
            i, j = table.column("i").to_numpy(), table.column("j").to_numpy()
            u, v, n = [], [], []
            for a, b in _groups(table, 3):
                alone = i[a] == j[a]
                cut = a if alone else a + int(np.count_nonzero(side[a:b] == 0))
                left, right = (raw[a:b], raw[a:b]) if alone else (raw[a:cut], raw[cut:b])
                if not left or not right:
                    continue
                own, other, both = _common(left, right)
                # A pair counts if both / (own + other - both) >= similarity, in whole numbers of a ten-thousandth.
                scale = round(similarity * 10_000)
                near = both.astype(np.int64) * (10_000 + scale) >= scale * (own[:, None] + other[None, :])
                names = rep[a:b] if alone else None
                if alone:
                    np.fill_diagonal(near, False)
                    links = near.sum(axis=1)
                    root = _roots(near.copy())
                    u.append(names)
                    v.append(names[root])
                    n.append(links)
                else:
                    # A spanning forest of a two-sided table: parts of left + right.
                    size = len(left) + len(right)
                    table_near = np.zeros((size, size), dtype=bool)
                    table_near[:len(left), len(left):] = near
                    table_near[len(left):, :len(left)] = near.T
                    names = rep[a:b]
                    u.append(names)
                    n.append(table_near.sum(axis=1))
                    v.append(names[_roots(table_near)])
            if u:
                yield pa.RecordBatch.from_arrays(
                    [pa.array(np.concatenate(u), pa.int64()), pa.array(np.concatenate(v), pa.int64()), pa.array(np.concatenate(n), pa.int64())],
                    ["u", "v", "n"])

    return run


def similarity_classes(
    docs: DataFrame, similarity: float = SIMILARITY, shingle: int = SHINGLE, recall: float = RECALL, depth: int = DEPTH,
) -> DataFrame:
    """Near-duplicate classes of documents (doc_id, text): doc_id, class_id, n_links, n_copies, a row per input row.

    Two documents are linked if the Jaccard similarity of their sets of word 5-grams is 0.8 or more; a class is a connected part
    and its id the smallest doc_id in it. n_links counts the other distinct sets linked to the document's set, n_copies the rows
    with just this set. Words are runs of characters other than ASCII white space. A text of one to four words is one shingle of
    them all; a null or empty text is alone, with its own doc_id. Rows that share a doc_id share a class, and the links of all
    their texts are added up. Rows of a null doc_id get a null class and no links. An empty table gives none; other columns are
    not read.

    Equal sets are one representative. Chosen-path runs split the representatives by tokens (coordinate, minimum hash) that each
    node samples, 1/similarity of them on average; a bucket of up to 1024 is brute-forced on sketches, a larger one is split
    again. Runs are repeated until a pair at the limit is met with probability ``recall`` at the greatest depth. What a bucket
    returns is a spanning forest of its similar pairs, never the pairs. Within each connected part, cut in blocks of 256 sets,
    exact similarities are then computed block against block, each pair once, so every link inside a part is found and counted.
    """
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
    known = rows.filter("doc_id is not null")
    features = settle(known.mapInArrow(_features(shingle), _FEATURES), "features")
    content = ["n_shingles", "d1", "d2"]
    reps = settle(features.filter("n_shingles > 0").groupBy(*content).agg(
        F.min("doc_id").alias("rep"), F.count(F.lit(1)).alias("n_copies"), F.min("sketch").alias("sketch"), F.min("brief").alias("brief")), "representatives")
    parts = connected_components(candidate_links(reps, similarity, recall, depth))
    sizes = parts.groupBy("component").agg(F.count(F.lit(1)).alias("size"))
    placed = settle(parts.join(sizes, "component").select(
        F.col("node").alias("doc_id"), "component", F.ceil(F.col("size") / BLOCK).cast("long").alias("blocks")), "parts")
    sets = known.join(placed, "doc_id").select("doc_id", "component", "blocks", "text").mapInArrow(
        _sets(shingle), "rep long, component long, blocks long, shingles binary").distinct()
    own = F.pmod(F.xxhash64("rep"), F.col("blocks"))
    spread = sets.withColumn("own", own).withColumn("other", F.explode(F.sequence(F.lit(0).cast("long"), F.col("blocks") - 1)))
    spread = spread.select("component", F.least("own", "other").alias("i"), F.greatest("own", "other").alias("j"),
                           (F.col("own") > F.col("other")).cast("long").alias("side"), "rep", "shingles")
    compared = spread.repartition("component", "i", "j").sortWithinPartitions("component", "i", "j", "side", "rep")
    verified = settle(compared.mapInArrow(_verify(similarity), "u long, v long, n long"), "verified")
    classes = connected_components(verified.filter("u != v").select("u", "v"))
    links = verified.groupBy("u").agg(F.sum("n").alias("n_links"))
    by_rep = reps.select(*content, "rep", "n_copies").join(links.withColumnRenamed("u", "rep"), "rep", "left").join(
        classes.withColumnRenamed("node", "rep"), "rep", "left").select(
        *content, F.coalesce("component", "rep").alias("class_id"), F.coalesce("n_links", F.lit(0)).alias("n_links"), "n_copies")
    found = features.filter("n_shingles > 0").join(by_rep, content).select("doc_id", "class_id", "n_links", "n_copies")
    none = F.lit(0).cast("long").alias("n_links"), F.lit(1).cast("long").alias("n_copies")
    empty = features.filter("n_shingles = 0").select("doc_id", F.col("doc_id").alias("class_id"), *none)
    unnamed = rows.filter("doc_id is null").select("doc_id", F.col("doc_id").alias("class_id"), *none)
    return found.unionAll(empty).unionAll(unnamed)
