"""Exact top-k inner-product search over a bit-sliced index."""

from __future__ import annotations

import heapq
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from staygauge.session import settle

SCALE = 1024
BITS = 8  # slices of a component; the rest of its bits is resolved exactly at the boundary
BLOCK_ROWS = 32_768
QUERY_ROWS = 256


def quantised(embedding: Column, scale: int = SCALE) -> Column:
    return F.transform(embedding, lambda x: F.floor(F.lit(float(scale)) * x.cast("double")))


def usable(embedding: Column) -> Column:
    """Not null, and without null, infinite or NaN components."""
    good = F.forall(embedding, lambda x: x.isNotNull() & (F.abs(x.cast("double")) < float("inf")))
    return embedding.isNotNull() & F.coalesce(good, F.lit(False))


class SlicedBlock:
    """Rows of quantised vectors with a bitmap over the rows for each of the highest bits of each component."""

    def __init__(self, ids: np.ndarray, values: np.ndarray, low: np.ndarray, shift: int, slices: np.ndarray):
        self.ids, self.values, self.low, self.shift, self.slices = ids, values, low, shift, slices

    @staticmethod
    def build(ids: np.ndarray, values: np.ndarray, bits: int = BITS) -> SlicedBlock:
        order = np.argsort(ids, kind="stable")
        ids, values = ids[order], np.ascontiguousarray(values[order])
        low = values.min(axis=0)
        spread = int((values - low).max(initial=0))
        shift = max(0, spread.bit_length() - bits)
        coarse = ((values - low) >> shift).T
        words = -(-len(ids) // 64)
        slices = np.zeros((coarse.shape[0], bits, words), "<u8")
        for b in range(bits):
            packed = np.packbits(((coarse >> b) & 1).astype(bool), axis=1, bitorder="little")
            slices[:, b].view(np.uint8)[:, :packed.shape[1]] = packed
        return SlicedBlock(ids, values, low, shift, slices)

    def _sum(self, query: np.ndarray) -> list[np.ndarray]:
        """Slices, lowest first, of the sum over components of |q| * coarse value, or of its complement where q is negative.

        Every set bit of |q| adds the component's slices at its own height. Equal heights are added three bitmaps at a time.
        """
        flip = np.where(query < 0, np.uint64(0xFFFFFFFFFFFFFFFF), np.uint64(0))
        slices = self.slices ^ flip[:, None, None]
        size = np.abs(query)
        layers: dict[int, list[np.ndarray]] = {}
        for j in range(int(size.max(initial=0)).bit_length()):
            chosen = slices[(size >> j) & 1 == 1]
            for b in range(chosen.shape[1] if len(chosen) else 0):
                layers.setdefault(j + b, []).append(chosen[:, b])
        out, height = [], 0
        while layers:
            rows = np.concatenate(layers.pop(height, [np.zeros((1, slices.shape[2]), np.uint64)]))
            while len(rows) > 1:
                if len(rows) == 2:
                    rows = np.concatenate((rows, np.zeros_like(rows[:1])))
                full = len(rows) // 3 * 3
                a, b, c = rows[:full:3], rows[1:full:3], rows[2:full:3]
                half = a ^ b
                layers.setdefault(height + 1, []).append((a & b) | (half & c))
                rows = np.concatenate((half ^ c, rows[full:]))
            out.append(rows[0])
            height += 1
        return out

    def search(self, query_id: int, query: np.ndarray, k: int) -> tuple[np.ndarray, np.ndarray]:
        """ids and scores of the k best rows without those of the query's own id; ties go to the smaller id."""
        n = len(self.ids)
        wanted = k + int(np.searchsorted(self.ids, query_id, "right") - np.searchsorted(self.ids, query_id))
        at = np.arange(n)
        if wanted < n:
            height = self._sum(query)
            every = np.packbits(np.ones(n, dtype=bool), bitorder="little")
            every = np.concatenate((every, np.zeros(8 * self.slices.shape[2] - len(every), np.uint8))).view("<u8")
            # From the most significant slice down: above surely hold, tied still share all bits with the boundary.
            above, tied, limit = np.zeros_like(every), every, 0
            for i in range(len(height) - 1, -1, -1):
                more = tied & height[i]
                if int(np.bitwise_count(above | more).sum()) >= wanted:
                    tied, limit = more, limit | (1 << i)
                else:
                    above, tied = above | more, tied & ~height[i]
            # A row's exact score exceeds its sliced one by less than this, in units of the slices.
            slack = int(np.abs(query).sum()) * ((1 << self.shift) - 1)
            low = max(0, limit - (-(-slack // (1 << self.shift))))
            reached, equal = np.zeros_like(every), every
            for i in range(len(height) - 1, -1, -1):
                if (low >> i) & 1:
                    equal = equal & height[i]
                else:
                    reached, equal = reached | (equal & height[i]), equal & ~height[i]
            at = np.flatnonzero(np.unpackbits((reached | equal).view(np.uint8), bitorder="little")[:n])
        at = at[self.ids[at] != query_id]
        score = self.values[at] @ query
        best = np.lexsort((self.ids[at], -score))[:k]
        return self.ids[at][best], score[best]


_INDEX = "dim long, block long, part long, ids binary, vectors binary, low binary, shift long, slices binary"


def build_index(vectors: DataFrame, blocks: int, bits: int = BITS) -> DataFrame:
    """The index: a row per block of ``vectors`` (vec_id, components), by their length and a hash of vec_id, with part -1."""
    rows = vectors.select("vec_id", "components", F.size("components").cast("long").alias("dim"))
    rows = rows.withColumn("block", F.pmod(F.xxhash64(F.lit(13), "vec_id"), F.lit(blocks)))

    def build(key, table):
        dim = key[0].as_py()
        ids = table["vec_id"].to_numpy()
        values = table["components"].combine_chunks().flatten().to_numpy().reshape(len(ids), dim)
        block = SlicedBlock.build(ids, values, bits)
        cells = [dim, key[1].as_py(), -1, block.ids.astype("<i8").tobytes(), block.values.astype("<i8").tobytes(),
                 block.low.astype("<i8").tobytes(), block.shift, block.slices.tobytes()]
        kinds = [pa.int64(), pa.int64(), pa.int64(), pa.binary(), pa.binary(), pa.binary(), pa.int64(), pa.binary()]
        names = ["dim", "block", "part", "ids", "vectors", "low", "shift", "slices"]
        return pa.table([pa.array([c], t) for c, t in zip(cells, kinds, strict=True)], names)

    return rows.groupBy("dim", "block").applyInArrow(build, _INDEX)


# A component below 2**24 and a length up to 2**14 keep every score and every sum of slices within 64 bits.
NARROW, NARROW_LENGTH = 1 << 24, 1 << 14
EXACT_ROWS = 1024  # candidates of a block of whole numbers


def _whole(x: float, scale: int) -> int:
    """floor(scale * x), exactly."""
    over, under = x.as_integer_ratio()
    return over * scale // under


def _exact_scores(candidates: DataFrame, queries: DataFrame, k: int, scale: int) -> DataFrame:
    """(query_id, vec_id, exact): the k best candidates of each block for each query, scored in whole numbers of any size.

    Blocks of candidates meet the queries in parts, as in the index. For the few vectors that 64 bits do not hold.
    """
    blocks = max(1, -(-candidates.count() // EXACT_ROWS))
    parts = max(1, -(-queries.count() // QUERY_ROWS))
    place = lambda df, n, seed, name: df.select(
        F.size("embedding").cast("long").alias("dim"), F.pmod(F.xxhash64(F.lit(seed), "vec_id"), F.lit(n)).alias(name), "vec_id", "embedding")
    every = F.explode(F.sequence(F.lit(0).cast("long"), F.lit(blocks - 1).cast("long"))).alias("block")
    asked = place(queries, parts, 17, "part").select("dim", every, "vec_id", "embedding", F.lit(True).alias("asked"))
    held = place(candidates, blocks, 13, "block").withColumn("asked", F.lit(False))

    def search(stream: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own, rows = None, []
        for batch in stream:
            out = []
            for dim, block, vec_id, embedding, asking in zip(*[c.to_pylist() for c in batch.columns], strict=True):
                if (dim, block) != own:
                    own, rows = (dim, block), []
                values = [_whole(x, scale) for x in embedding]
                if not asking:
                    rows.append((vec_id, values))
                    continue
                scores = [(-sum(a * b for a, b in zip(values, v, strict=True)), i) for i, v in rows if i != vec_id]
                out += [(vec_id, i, str(-s)) for s, i in heapq.nsmallest(k, scores)]
            columns = list(zip(*out, strict=True)) or [(), (), ()]
            yield pa.RecordBatch.from_arrays(
                [pa.array(columns[0], pa.int64()), pa.array(columns[1], pa.int64()), pa.array(columns[2], pa.string())],
                ["query_id", "vec_id", "exact"])

    met = held.unionByName(asked).repartition("dim", "block").sortWithinPartitions("dim", "block", "asked", "vec_id")
    return met.select("dim", "block", "vec_id", F.col("embedding").cast("array<double>"), "asked").mapInArrow(
        search, "query_id long, vec_id long, exact string")


def _sortable(exact: Column) -> Column:
    """Text that sorts as the decimal number does: sign, number of digits, digits; all turned round below zero."""
    digits = F.ltrim(exact, F.lit("-"))
    size = F.lpad(F.length(digits).cast("string"), 4, "0")
    turned = F.translate(F.concat(size, digits), "0123456789", "9876543210")
    return F.when(exact.startswith("-"), F.concat(F.lit("0"), turned)).otherwise(F.concat(F.lit("1"), size, digits))


def top_k(vectors: DataFrame, queries: Column, k: int = 10, scale: int = SCALE, block_rows: int = BLOCK_ROWS) -> DataFrame:
    """The k best other rows for each query row of ``vectors`` (vec_id, embedding): query_id, rank, vec_id, score.

    ``queries`` is a condition on vec_id. Components count as floor(scale * x); the score is the integer inner product, ties go to
    the smaller vec_id. Vectors that are null or hold a null or non-finite component, and rows without vec_id, take no part;
    vectors are compared with those of the same length. Rows that share the query's vec_id are not its candidates; a repeated
    query row is asked once, a repeated candidate counts each time. Fewer candidates than k give fewer rows; other columns are
    not read.

    Every block of rows meets the queries in small parts, in one stream: the block is held, the parts pass by. A part's queries
    are summed over bit slices, the boundary is found from the highest slice down, and only rows within the rounding of the
    slices are scored exactly. A block returns k rows a query, so what is ranked at the end is k times the number of blocks.

    Vectors that are longer than 2**14 or have a component of 2**24 or more after scaling stay out of the index: they meet all
    others in whole numbers of any size. Ranks are exact then too; a score beyond 64 bits is given as the nearest number that has 64.
    """
    good = vectors.select(F.col("vec_id").cast("long").alias("vec_id"), F.col("embedding").alias("embedding"))
    good = good.filter(F.col("vec_id").isNotNull() & usable(F.col("embedding")))
    narrow = (F.size("embedding") <= NARROW_LENGTH) & F.forall("embedding", lambda x: F.abs(x.cast("double")) < NARROW / scale)
    found = _indexed(good.filter(narrow).select("vec_id", quantised(F.col("embedding"), scale).alias("components")), queries, k, block_rows)
    order = Window.partitionBy("query_id").orderBy(F.desc("score"), "vec_id")
    wide = good.filter(~narrow)
    if not wide.isEmpty():
        more = _exact_scores(good, wide.filter(queries).distinct(), k, scale).unionAll(
            _exact_scores(wide, good.filter(narrow & queries).distinct(), k, scale))
        least, greatest = F.lit(-(1 << 63)).cast("long"), F.lit((1 << 63) - 1).cast("long")
        nearest = F.coalesce(F.expr("try_cast(exact AS long)"), F.when(F.col("exact").startswith("-"), least).otherwise(greatest))
        found = found.withColumn("exact", F.col("score").cast("string")).unionByName(more.withColumn("score", nearest))
        order = Window.partitionBy("query_id").orderBy(F.desc(_sortable(F.col("exact"))), "vec_id")
    return found.withColumn("rank", F.row_number().over(order)).filter(F.col("rank") <= k).select("query_id", "rank", "vec_id", "score")


def _indexed(good: DataFrame, queries: Column, k: int, block_rows: int) -> DataFrame:
    """(query_id, vec_id, score) of each block's k best rows for each query, over the bit-sliced index of ``good`` (vec_id, components)."""
    blocks = max(1, -(-good.count() // block_rows))
    index = settle(build_index(good, blocks), "bit_sliced_index")
    asked = good.filter(queries).distinct().select(
        F.col("vec_id"), "components", F.size("components").cast("long").alias("dim"))
    parts = max(1, -(-asked.count() // QUERY_ROWS))
    asked = asked.withColumn("part", F.pmod(F.xxhash64(F.lit(17), "vec_id"), F.lit(parts)))
    batches = asked.groupBy("dim", "part").agg(F.sort_array(F.collect_list(F.struct("vec_id", "components"))).alias("asked"))
    every = F.explode(F.sequence(F.lit(0).cast("long"), F.lit(blocks - 1).cast("long"))).alias("block")
    sent = batches.select("dim", every, "part", "asked")
    empty = F.lit(None).cast("binary")
    rows = index.withColumn("asked", F.lit(None).cast(sent.schema["asked"].dataType)).unionByName(
        sent.select("dim", "block", "part", empty.alias("ids"), empty.alias("vectors"), empty.alias("low"),
                    F.lit(None).cast("long").alias("shift"), empty.alias("slices"), "asked"))

    def search(stream: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        block = held = None
        for batch in stream:
            for r in range(batch.num_rows):
                row = {name: batch.column(name)[r] for name in batch.schema.names}
                dim, own = row["dim"].as_py(), (row["dim"].as_py(), row["block"].as_py())
                if row["part"].as_py() < 0:
                    ids, vectors, low, slices = (np.frombuffer(row[c].as_buffer(), t) for c, t in (
                        ("ids", "<i8"), ("vectors", "<i8"), ("low", "<i8"), ("slices", "<u8")))
                    block = SlicedBlock(ids, vectors.reshape(len(ids), dim), low, row["shift"].as_py(),
                                        slices.reshape(dim, BITS, -1) if dim else slices.reshape(0, BITS, 0))
                    held = own
                    continue
                if held != own:  # no vector of this length has this hash
                    continue
                out = []
                for query in row["asked"].as_py():
                    ids, scores = block.search(query["vec_id"], np.array(query["components"], np.int64), k)
                    out.append((np.full(len(ids), query["vec_id"]), ids, scores))
                columns = [np.concatenate(c).astype(np.int64) for c in zip(*out, strict=True)]
                yield pa.RecordBatch.from_arrays([pa.array(c) for c in columns], ["query_id", "vec_id", "score"])

    met = rows.repartition("dim", "block").sortWithinPartitions("dim", "block", "part")
    return met.mapInArrow(search, "query_id long, vec_id long, score long")
