"""Substring dedup: a presence filter over hash slices, then exact grouping of the windows in cells that several blocks use."""

from __future__ import annotations

import math
from dataclasses import dataclass
from itertools import compress

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import zstandard
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

from staygauge.llm.columns import quoted
from staygauge.llm.words import SPACES, buffer_of, covered, grams, hashes, release, spans

WINDOW = 20
BLOCK_BYTES = 6 << 20  # text that one task holds
SLICE_WINDOWS = 1 << 20  # windows of one slice of the sketch
CELLS_PER_WINDOW = 16

_MESSAGE = "slice long, block long, n long, packed binary"
_REPLY = "block long, slice long, flags binary"
_RESULTS = ("n_words", "n_removed", "kept_text")


@dataclass(frozen=True)
class Plan:
    """Shape of the sketch: 2**bits cells in all, 2**slice_bits slices, blocks of documents cut at the bounds."""

    window: int
    bits: int
    slice_bits: int
    bounds: tuple[int, ...]

    def slices(self, keys: np.ndarray, bits: int) -> tuple[np.ndarray, np.ndarray]:
        """The slices that sorted keys fall in, and where each begins."""
        if not self.slice_bits:
            return np.zeros(min(1, len(keys)), np.int64), np.array([0, len(keys)] if len(keys) else [0])
        own, first = np.unique((keys >> np.uint64(bits - self.slice_bits)).astype(np.int64), return_index=True)
        return own, np.append(first, len(keys))


def plan_for(docs: DataFrame, window: int, block_bytes: int, slice_windows: int) -> Plan:
    size = docs.agg(F.sum(F.octet_length("text")).alias("bytes"), F.count(F.lit(1)).alias("rows")).first()
    total = size["bytes"] or 0
    blocks = max(1, math.ceil(total / block_bytes))
    bounds: list[int] = []
    if blocks > 1:
        cuts = [k / blocks for k in range(1, blocks)]
        found = docs.agg(F.percentile_approx(F.col("doc_id").cast("long"), cuts, max(10_000, 10 * blocks))).first()[0]
        bounds = sorted({x + 1 for x in found or []})
    windows = max(1, total // 4)
    slice_bits = max(0, math.ceil(math.log2(windows / slice_windows)))
    return Plan(window, max(slice_bits, math.ceil(math.log2(CELLS_PER_WINDOW * windows))) + 1, slice_bits, tuple(bounds))


def packed(values: np.ndarray) -> bytes:
    """Sorted unsigned numbers as compressed byte planes of their differences."""
    steps = np.diff(values, prepend=np.uint64(0)).astype("<u8")
    return zstandard.ZstdCompressor(level=1).compress(np.ascontiguousarray(steps.view(np.uint8).reshape(-1, 8).T).tobytes())


def unpacked(data: bytes, n: int) -> np.ndarray:
    planes = np.frombuffer(zstandard.ZstdDecompressor().decompress(data, max_output_size=8 * n), np.uint8)
    return np.cumsum(np.ascontiguousarray(planes.reshape(8, n).T).view("<u8").ravel(), dtype=np.uint64)


class Block:
    """Windows of a block's documents in order of (doc_id, text), and the distinct ones sorted by hash."""

    def __init__(self, docs: pa.Table, plan: Plan):
        keys = [("doc_id", "ascending"), ("text", "ascending")]
        self.docs = docs.take(pc.sort_indices(docs, sort_keys=keys, null_placement="at_start"))
        data, offsets = buffer_of(self.docs["text"])
        self.words = spans(data, offsets, SPACES)
        h = hashes(self.words)
        high, self.at = grams(h, self.words.text, plan.window)
        low = grams(h, self.words.text, plan.window, seed=1)[0].astype(np.uint32)
        order = np.argsort(high)
        new = self._new(high[order], low[order])
        if np.count_nonzero(new) != np.count_nonzero(np.diff(high[order], prepend=~high[order[:1]]) != 0):
            order = np.lexsort((low, high))  # equal first hashes of different windows: keep equal windows together
            new = self._new(high[order], low[order])
        self.order, self.run = order, np.flatnonzero(new)
        self.high, self.low = high[order][self.run], low[order][self.run]
        self.cells = self.high >> np.uint64(64 - plan.bits)
        self.plan = plan

    @staticmethod
    def _new(high: np.ndarray, low: np.ndarray) -> np.ndarray:
        new = np.ones(len(high), dtype=bool)
        new[1:] = (high[1:] != high[:-1]) | (low[1:] != low[:-1])
        return new

    def candidates(self, replies: pa.Table) -> np.ndarray:
        """Which distinct windows lie in a cell that several blocks use."""
        cells = np.unique(self.cells)
        return flags_of(replies, self.plan.slices(cells, self.plan.bits))[np.searchsorted(cells, self.cells)]


def flags_of(replies: pa.Table, slices: tuple[np.ndarray, np.ndarray]) -> np.ndarray:
    own, first = slices
    by = dict(zip(replies["slice"].to_pylist(), replies["flags"].to_pylist(), strict=True))
    parts = [np.unpackbits(np.frombuffer(by[k], np.uint8), count=n).astype(bool) for k, n in zip(own.tolist(), np.diff(first).tolist(), strict=True)]
    return np.concatenate(parts) if parts else np.zeros(0, dtype=bool)


def _messages(block: int, slices: tuple[np.ndarray, np.ndarray], pack) -> pa.Table:
    release()
    own, first = slices
    rows = [(k, block, b - a, pack(a, b)) for k, a, b in zip(own.tolist(), first[:-1].tolist(), first[1:].tolist(), strict=True)]
    columns = list(zip(*rows, strict=True)) or [(), (), (), ()]
    return pa.table([pa.array(c, t) for c, t in zip(columns, (pa.int64(), pa.int64(), pa.int64(), pa.binary()), strict=True)],
                    ["slice", "block", "n", "packed"])


def _replies(messages: pa.Table, flags: np.ndarray, sizes: list[int]) -> pa.Table:
    release()
    ends = np.cumsum(sizes)
    bits = [np.packbits(flags[e - n:e]).tobytes() for e, n in zip(ends.tolist(), sizes, strict=True)]
    return pa.table([messages["block"], messages["slice"], pa.array(bits, pa.binary())], ["block", "slice", "flags"])


def dedup_substrings(
    docs: DataFrame, window: int = WINDOW, block_bytes: int = BLOCK_BYTES, slice_windows: int = SLICE_WINDOWS,
) -> DataFrame:
    """Documents (doc_id, text) without words covered by a window of ``window`` words that also starts earlier.

    Earlier is a smaller doc_id, or the same document before. Words are runs of characters other than ASCII white space. Returns
    all columns of ``docs`` with n_words, n_removed and kept_text (kept words joined by one space; input columns with these
    names are replaced). A null text has no words; a null doc_id comes before all; rows of one doc_id are documents in order of
    their text, so of equal rows all but one lose their windows. Documents shorter than a window stay. An empty table gives none.

    Documents lie in blocks by doc_id, so that the order of blocks is the order of documents. (1) Each block sends the sketch
    cells of its distinct windows to the slices of the hash space; a slice merges the blocks' counts and answers with one bit a
    cell: used by several blocks or not. The number of cells grows with the words, so the share of chance hits does not.
    (2) A block sends 96-bit hashes of its windows in such cells only; the slice groups them exactly and answers which ones an
    earlier block has. (3) The block removes those, and what repeats within it. No window is lost: equal windows share a cell.
    Nothing is broadcast, a hot window is one entry a block, and tasks hold one block or one slice. Scale ``block_bytes`` and
    ``slice_windows`` with executor memory: the number of messages is blocks times slices.
    """
    kept_names = [c for c in docs.columns if c not in _RESULTS]
    inner = [c if c in ("doc_id", "text") else f"own{i}" for i, c in enumerate(kept_names)]
    docs = docs.select(*[quoted(c).alias(name) for c, name in zip(kept_names, inner, strict=True)])
    plan = plan_for(docs, window, block_bytes, slice_windows)

    @F.pandas_udf("long")
    def block_of(doc_id):
        import pandas as pd

        return pd.Series(np.searchsorted(np.array(plan.bounds, np.int64), doc_id.to_numpy(), "right"))

    number = block_of(F.coalesce(F.col("doc_id").cast("long"), F.lit(-(1 << 63)).cast("long")))
    blocks = docs.withColumn("block", number).groupBy("block")

    def sketch(key, table):
        block = Block(table, plan)
        cells = np.unique(block.cells)
        mask = np.uint64((1 << (plan.bits - plan.slice_bits)) - 1)
        return _messages(key[0].as_py(), plan.slices(cells, plan.bits), lambda a, b: packed(cells[a:b] & mask))

    def merge(messages):
        sizes = messages["n"].to_pylist()
        cells = np.concatenate([unpacked(p, n) for p, n in zip(messages["packed"].to_pylist(), sizes, strict=True)])
        order = np.argsort(cells)
        same = cells[order][1:] == cells[order][:-1]
        flags = np.zeros(len(cells), dtype=bool)
        flags[order[1:][same]] = flags[order[:-1][same]] = True
        return _replies(messages, flags, sizes)

    def digests(key, table, replies):
        block = Block(table, plan)
        some = block.candidates(replies)
        high, low = block.high[some], block.low[some]
        return _messages(key[0].as_py(), plan.slices(high, 64),
                         lambda a, b: packed(high[a:b]) + low[a:b].astype("<u4").tobytes())

    def group(messages):
        sizes = messages["n"].to_pylist()
        parts = list(zip(messages["packed"].to_pylist(), sizes, strict=True))
        high = np.concatenate([unpacked(p[:len(p) - 4 * n], n) for p, n in parts])
        low = np.concatenate([np.frombuffer(p, "<u4", n, len(p) - 4 * n) for p, n in parts])
        order = np.lexsort((np.repeat(np.array(messages["block"].to_pylist()), sizes), low, high))
        flags = np.zeros(len(high), dtype=bool)
        flags[order[1:]] = (high[order][1:] == high[order][:-1]) & (low[order][1:] == low[order][:-1])
        return _replies(messages, flags, sizes)

    def remove(key, table, marks):
        block = Block(table, plan)
        first_round = pc.equal(marks["round"], 1)
        some = block.candidates(marks.filter(first_round))
        earlier = np.zeros(len(block.high), dtype=bool)
        earlier[some] = flags_of(marks.filter(pc.invert(first_round)), plan.slices(block.high[some], 64))
        gone = np.ones(len(block.order), dtype=bool)
        if len(gone):
            gone[np.minimum.reduceat(block.order, block.run)] = earlier
        words = block.words
        lost = covered(block.at[gone], plan.window, len(words.start))
        n_words, n_lost = words.counts(), np.bincount(words.text[lost], minlength=words.texts)
        kept, ends = [], np.cumsum(n_words).tolist()
        data, offsets = buffer_of(block.docs["text"])
        whole, offsets, stay = data.tobytes(), offsets.tolist(), (~lost).tolist()
        for i, (n, out) in enumerate(zip(n_words.tolist(), n_lost.tolist(), strict=True)):
            own = whole[offsets[i]:offsets[i + 1]].split()
            kept.append(b" ".join(compress(own, stay[ends[i] - n:ends[i]]) if out else own).decode())
        table = block.docs.drop_columns("block")
        release()
        for name, values in zip(_RESULTS, (n_words, n_lost, pa.array(kept, pa.string())), strict=True):
            table = table.append_column(name, pa.array(values))
        return table

    replies = blocks.applyInArrow(sketch, _MESSAGE).groupBy("slice").applyInArrow(merge, _REPLY)
    exact = blocks.cogroup(replies.groupBy("block")).applyInArrow(digests, _MESSAGE)
    answers = exact.groupBy("slice").applyInArrow(group, _REPLY)
    marks = replies.withColumn("round", F.lit(1)).unionAll(answers.withColumn("round", F.lit(2)))
    # A block without any window has no mark, and a cogroup keeps it.
    schema = StructType(list(docs.schema.fields)).add("n_words", "long").add("n_removed", "long").add("kept_text", "string")
    found = blocks.cogroup(marks.groupBy("block")).applyInArrow(remove, schema)
    return found.select(*[F.col(name).alias(c) for c, name in zip(kept_names, inner, strict=True)], *_RESULTS)
