"""Shortest-pack-first packing of tokenised documents over the histogram of piece lengths."""

from __future__ import annotations

import heapq
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from staygauge.llm.encoding import CACHE_ENTRIES, piece_ids
from staygauge.llm.words import release
from staygauge.session import settle

END_ID = 1
MAX_LENGTH = 2048
PIECES = "doc_id long, start long, length long, ids_crc32 long, doc_tokens long"


def pattern_counts(histogram: dict[int, int], max_length: int) -> list[tuple[int, list[int]]]:
    """(count, lengths) of packs that hold every length as often as the histogram says.

    Lengths are placed longest first, each into the shortest packs that still have room; a pattern whose count is larger than
    what is left to place is split in two. Every length adds two patterns at most, so there are at most 2 * max_length.
    """
    room: dict[int, list[list]] = {}  # free space: patterns as [count, lengths]
    spaces: list[int] = []  # the keys of room, largest first

    def add(space: int, count: int, lengths: list[int]) -> None:
        if space not in room:
            room[space] = []
            heapq.heappush(spaces, -space)
        room[space].append([count, lengths])

    for length in sorted(histogram, reverse=True):
        left = histogram[length]
        while left and spaces and -spaces[0] >= length:
            space = -spaces[0]
            entry = room[space][-1]
            taken = min(left, entry[0])
            left -= taken
            entry[0] -= taken
            if not entry[0]:
                room[space].pop()
                if not room[space]:
                    del room[space]
                    heapq.heappop(spaces)
            add(space - length, taken, [*entry[1], length])
        if left:
            add(max_length - length, left, [length])
    return [(count, lengths) for space in sorted(room) for count, lengths in room[space]]


def slots(patterns: list[tuple[int, list[int]]]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Sorted key (length, first rank), the sequence of that rank and the offset in it, for every slot of every pattern."""
    rows, used, sequence = [], {}, 0
    for count, lengths in patterns:
        offset = 0
        for length in lengths:
            rank = used.get(length, 0)
            rows.append((_key(length, rank), sequence - rank, offset))
            used[length] = rank + count
            offset += length
        sequence += count
    rows.sort()
    table = np.array(rows, dtype=np.int64).reshape(-1, 3)
    return table[:, 0], table[:, 1], table[:, 2]


def _key(length, rank):
    return (length << 48) + rank


RELEASE_BYTES = 64 << 20  # of texts, after which freed memory is given back


def _cutter(path: str, max_length: int, end_id: int, with_ids: bool, cache_entries: int):
    end = end_id.to_bytes(4, "little")

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        ids_of, read = piece_ids(path, cache_entries).of, 0
        part, seen = TaskContext.get().partitionId(), np.zeros(max_length + 1, np.int64)
        for batch in batches:
            rows = []
            for doc_id, text in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
                ids = ids_of(text or "") + end
                tokens = len(ids) // 4
                for start in range(0, tokens, max_length):
                    own = ids[4 * start:4 * (start + max_length)]
                    length = len(own) // 4
                    row = (doc_id, start, length, zlib.crc32(own), tokens, part, int(seen[length]))
                    rows.append((*row, np.frombuffer(own, "<i4")) if with_ids else row)
                    seen[length] += 1
            columns = list(zip(*rows, strict=True)) or [()] * (7 + with_ids)
            names = ["doc_id", "start", "length", "ids_crc32", "doc_tokens", "part", "nth"]
            arrays = [pa.array(c, pa.int64()) for c in columns[:7]]
            if with_ids:
                names, arrays = [*names, "ids"], [*arrays, pa.array(columns[7], pa.list_(pa.int32()))]
            yield pa.RecordBatch.from_arrays(arrays, names)
            read += batch.nbytes
            if read > RELEASE_BYTES:
                release()
                read = 0

    return cut


def pack_documents(
    docs: DataFrame, tokenizer: str, max_length: int = MAX_LENGTH, end_id: int = END_ID, with_ids: bool = False,
    cache_entries: int = CACHE_ENTRIES,
) -> DataFrame:
    """Pieces of all documents (doc_id, text), placed in sequences of at most ``max_length`` tokens.

    A document's ids end with ``end_id``; it is cut every ``max_length`` ids. Returns a row per piece: doc_id, start, length,
    ids_crc32, doc_tokens, sequence_id, offset, and its ids ``with_ids``. Null and empty texts are the end id alone. Rows are
    taken as they are: a repeated row or doc_id, or a null one, is packed each time. An empty table gives no row. Other columns
    are not read.

    A worker caches the ids of up to ``cache_entries`` pieces and as many words. The text is tokenised once; the pieces are settled with their task and their place among the task's pieces of that length.
    A piece's rank within its length is then a sum over (task, length) counts, so no length is ever gathered or sorted. The
    histogram has ``max_length`` rows; the patterns made from it on the driver are 2 * ``max_length`` at most.
    """
    spark = docs.sparkSession
    schema = f"{PIECES}, part long, nth long" + ", ids array<int>" * with_ids
    cut = docs.select(F.col("doc_id").cast("long"), F.col("text").cast("string")).mapInArrow(
        _cutter(tokenizer, max_length, end_id, with_ids, cache_entries), schema)
    pieces = settle(cut, "pieces")
    counts = settle(pieces.groupBy("part", "length").agg(F.count(F.lit(1)).alias("n")), "piece_counts")
    histogram = {r.length: r.n for r in counts.groupBy("length").agg(F.sum("n").alias("n")).collect()}
    table = spark.sparkContext.broadcast(slots(pattern_counts(histogram, max_length)))
    before = Window.partitionBy("length").orderBy("part").rowsBetween(Window.unboundedPreceding, -1)
    first = counts.select("part", "length", F.coalesce(F.sum("n").over(before), F.lit(0)).alias("first"))

    @F.pandas_udf("sequence_id long, offset long")
    def place(length, rank):
        import pandas as pd

        key, sequence, offset = table.value
        rank = rank.to_numpy()
        at = np.searchsorted(key, _key(length.to_numpy(), rank), "right") - 1
        return pd.DataFrame({"sequence_id": sequence[at] + rank, "offset": offset[at]})

    placed = pieces.join(first, ["part", "length"]).withColumn("place", place("length", F.col("first") + F.col("nth")))
    columns = ["doc_id", "start", "length", "ids_crc32", "doc_tokens", "place.sequence_id", "place.offset"]
    return placed.select(*columns, *["ids"] * with_ids)
