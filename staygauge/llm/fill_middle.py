"""Fill-in-middle by secondary sort: unit-chunk pieces sorted by output position, streamed into digests, and sorted back."""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from staygauge.llm.words import bounded, buffer_of

# Fixed values of the contract.
PREFIX, SUFFIX, MIDDLE = "<P>", "<S>", "<M>"
PLAIN_FROM, SPM_BELOW = 90, 20  # of 100
ORDERS = {"plain": ("text",), "psm": ("prefix", "suffix", "middle"), "spm": ("suffix", "prefix", "middle")}
MARKS = {"prefix": PREFIX, "suffix": SUFFIX, "middle": MIDDLE}

CHUNK_UNITS = 4096

_RANK = {PREFIX.encode(): 1, MIDDLE.encode(): 2, SUFFIX.encode(): 3}  # the order of the parts in the original text
_KEY = ["k1", "k2", "task"]
_KEY_FIELDS = "k1 long, k2 long, task int"
_HEAD = "doc_id long, n long, form string, prefix_chars long, middle_chars long, copies long"
_PIECES = f"{_KEY_FIELDS}, position long, piece binary, {_HEAD}"
_LETTER = np.zeros(256, dtype=bool)
_LETTER[[*range(65, 91), *range(97, 123)]] = True


def unit_starts(data: np.ndarray, offsets: np.ndarray) -> np.ndarray:
    """Whether a unit begins at each byte: a run of ASCII letters, or any other code point by itself."""
    letter = _LETTER[data]
    inner = np.concatenate(([False], letter[:-1]))[:len(data)]
    inner[offsets[:-1][offsets[:-1] < len(data)]] = False
    return np.where(letter, ~inner, (data & 0xC0) != 0x80)


def draws(doc_id: int | None) -> tuple[int, int, int, int]:
    shown = hashlib.sha256(b"1:%d" % doc_id if doc_id is not None else b"1:").hexdigest()
    return int(shown[:8], 16), int(shown[8:16], 16), int(shown[16:24], 16), int(shown[24:32], 16)


def form_of(raw: bytes, h3: int, h4: int) -> str:
    if not raw or h3 % 100 >= PLAIN_FROM or any(mark in raw for mark in _RANK):
        return "plain"
    return "spm" if h4 % 100 < SPM_BELOW else "psm"


def _cutter(chunk: int):
    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        task = TaskContext.get().partitionId()
        for batch in bounded(batches, 1):
            data, offsets = buffer_of(batch.column(1))
            whole = data.tobytes()
            new = unit_starts(data, offsets)
            starts = np.flatnonzero(new)
            first = np.searchsorted(starts, offsets)  # number of each text's first unit
            chars = np.concatenate(([0], np.cumsum((data & 0xC0) != 0x80)))
            seen, heads = {}, {}
            k1s, k2s, positions, sent, copies = [], [], [], [], []

            def place(unit, text, starts=starts, first=first, offsets=offsets):
                return int(starts[first[text] + unit]) if unit < first[text + 1] - first[text] else int(offsets[text + 1])

            for i, doc_id in enumerate(batch.column(0).to_pylist()):
                raw = whole[offsets[i]:offsets[i + 1]]
                name = hashlib.blake2b(raw, digest_size=16, key=b"%d" % doc_id if doc_id is not None else b"-").digest()
                if name in seen:  # the same row again: counted here, not sent again
                    copies[seen[name]] += 1
                    continue
                seen[name] = len(sent)
                n = int(first[i + 1] - first[i])
                h1, h2, h3, h4 = draws(doc_id)
                form = form_of(raw, h3, h4)
                lower, upper = sorted((h1 % (n + 1), h2 % (n + 1)))
                units = {"text": (0, n), "prefix": (0, lower), "middle": (lower, upper), "suffix": (upper, n)}
                a, b = place(lower, i), place(upper, i)
                k1, k2 = np.frombuffer(name, "<i8").tolist()
                lengths = (None, None) if form == "plain" else (int(chars[a] - chars[offsets[i]]), int(chars[b] - chars[a]))
                heads[len(sent)] = (doc_id, n, form, *lengths)
                rows = [None]  # the head, then pieces of up to ``chunk`` whole units
                for part in ORDERS[form]:
                    if part != "text":
                        rows.append(MARKS[part].encode())
                    lo, hi = units[part]
                    edges = [place(u, i) for u in (*range(lo, hi, chunk), hi)]
                    rows += [whole[x:y] for x, y in zip(edges, edges[1:], strict=False)]
                k1s += [k1] * len(rows)
                k2s += [k2] * len(rows)
                positions += range(len(rows))
                sent += rows
                copies += [1] * len(rows)
            size = len(sent)
            empty = (None,) * 5
            head = list(zip(*[heads.get(r, empty) for r in range(size)], strict=True)) or [()] * 5
            yield pa.RecordBatch.from_arrays(
                [pa.array(k1s, pa.int64()), pa.array(k2s, pa.int64()), pa.array([task] * size, pa.int32()),
                 pa.array(positions, pa.int64()), pa.array(sent, pa.binary()), pa.array(head[0], pa.int64()),
                 pa.array(head[1], pa.int64()), pa.array(head[2], pa.string()), pa.array(head[3], pa.int64()),
                 pa.array(head[4], pa.int64()), pa.array(copies, pa.int64())],
                [*_KEY, "position", "piece", "doc_id", "n", "form", "prefix_chars", "middle_chars", "copies"])

    return cut


def fim_pieces(docs: DataFrame, chunk: int = CHUNK_UNITS) -> DataFrame:
    """The output texts of all documents (doc_id, text) as pieces in Spark's partitions, sorted by (document, position).

    Position 0 of a document is its head (n, form, lengths, copies), without a piece; the following pieces are its output in
    order, sentinels by themselves. A piece has up to ``chunk`` units. Documents that are equal within a task are one, with the
    number of ``copies``; as the key holds the task, a group of copies is spread like anything else.
    """
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.coalesce(F.col("text").cast("string"), F.lit("")).alias("text"))
    pieces = rows.mapInArrow(_cutter(chunk), _PIECES)
    return pieces.repartition(*_KEY).sortWithinPartitions(*_KEY, "position")


def _rows(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple]:
    for batch in batches:
        yield from zip(*[c.to_pylist() for c in batch.columns], strict=True)


def _batches(rows: Iterator[tuple], schema: pa.Schema, size: int = 4 << 20) -> Iterator[pa.RecordBatch]:
    """Rows as Arrow batches of about ``size`` bytes of pieces or texts."""
    held, used = [], 0
    for row in rows:
        held.append(row)
        used += 64 + sum(len(x) for x in row if isinstance(x, (bytes, str)))
        if used >= size:
            yield _batch(held, schema)
            held, used = [], 0
    yield _batch(held, schema)


def _batch(rows: list[tuple], schema: pa.Schema) -> pa.RecordBatch:
    columns = list(zip(*rows, strict=True)) or [()] * len(schema)
    return pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(columns, schema, strict=True)], schema=schema)


_SORTED_BACK = pa.schema([
    ("k1", pa.int64()), ("k2", pa.int64()), ("task", pa.int32()), ("part", pa.int32()), ("position", pa.int64()), ("piece", pa.binary()),
    ("doc_id", pa.int64()), ("n", pa.int64()), ("form", pa.string()), ("prefix_chars", pa.int64()), ("middle_chars", pa.int64()),
    ("copies", pa.int64()), ("output_sha256", pa.string()), ("output", pa.binary())])


def _written(with_texts: bool):
    """Reads pieces in output order. Passes each on under the part that the sentinels seen so far say, and ends a document with
    its head: (part 0) the copies counted and the output's digest."""
    def run(rows: Iterator[tuple]) -> Iterator[tuple]:
        key = head = digest = None
        part = last = copies = 0
        output: list[bytes] = []

        def ended():
            return (*key, 0, 0, None, *head, copies, digest.hexdigest(), b"".join(output) if with_texts else None)

        for k1, k2, task, position, piece, *rest in rows:
            if (k1, k2, task) != key:
                if key is not None:
                    yield ended()
                key, head, copies, digest, part, last = (k1, k2, task), rest[:5], 0, hashlib.sha256(), 1, 0
                output = []
            if position == 0:
                copies += rest[5]
            elif position != last:  # else the same piece, sent by another batch of the task
                last = position
                digest.update(piece)
                if with_texts:
                    output.append(piece)
                if head[2] != "plain" and piece in _RANK:
                    part = _RANK[piece]
                else:
                    yield (*key, part, position, piece, *[None] * 8)
        if key is not None:
            yield ended()

    return lambda batches: _batches(run(_rows(batches)), _SORTED_BACK)


def _restored(with_texts: bool):
    """Reads pieces in the order of the original text; the head of a document comes first."""
    fields = [("doc_id", pa.int64()), ("n", pa.int64()), ("form", pa.string()), ("prefix_chars", pa.int64()),
              ("middle_chars", pa.int64()), ("output_sha256", pa.string()), ("restored_sha256", pa.string())]
    schema = pa.schema(fields + [("output", pa.string()), ("restored", pa.string())] * with_texts)

    def run(rows: Iterator[tuple]) -> Iterator[tuple]:
        head = digest = None
        texts: list[bytes] = []

        def ended():
            *shown, copies, output_sha256, output = head
            row = (*shown, output_sha256, digest.hexdigest())
            row += (output.decode(), b"".join(texts).decode()) if with_texts else ()
            for _ in range(copies):
                yield row

        for _, _, _, part, _, piece, *rest in rows:
            if part == 0:
                if head is not None:
                    yield from ended()
                head, digest, texts = rest, hashlib.sha256(), []
            else:
                digest.update(piece)
                if with_texts:
                    texts.append(piece)
        if head is not None:
            yield from ended()

    return lambda batches: _batches(run(_rows(batches)), schema)


def fill_in_middle(docs: DataFrame, chunk: int = CHUNK_UNITS, with_texts: bool = False) -> DataFrame:
    """doc_id, n, form, prefix_chars, middle_chars, output_sha256 and restored_sha256 of every row of ``docs`` (doc_id, text),
    and ``with_texts`` the output and the restored text themselves.

    A text is cut into n units: runs of ASCII letters, and every other code point by itself. The borders of prefix, middle and
    suffix and the form are drawn from the doc_id; a null doc_id draws as the empty string does. A null or empty text, and one
    that holds a sentinel, stays plain. Every row gives a row, repeated rows too; other columns are not read; an empty table
    gives none.

    Pieces of up to ``chunk`` units are keyed by (document, output position) and shuffled once; sorted within their partitions
    they stream into the output's digest, so that no task holds a text. The restoration reads the output alone: sentinels tell
    which part a piece belongs to. The pieces are then sorted back within the same partitions and stream into the second digest.
    """
    key = ", ".join(["k1 long", "k2 long", "task int", "part int", "position long", "piece binary"])
    back = fim_pieces(docs, chunk).mapInArrow(_written(with_texts), f"{key}, {_HEAD}, output_sha256 string, output binary")
    result = "doc_id long, n long, form string, prefix_chars long, middle_chars long, output_sha256 string, restored_sha256 string"
    return back.sortWithinPartitions(*_KEY, "part", "position").mapInArrow(
        _restored(with_texts), result + ", output string, restored string" * with_texts)
