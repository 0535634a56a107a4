"""Chat formatting: whole conversations rendered, encoded once, with loss masks aligned by offsets."""

from __future__ import annotations

import hashlib
import os
import re
from collections.abc import Iterator
from dataclasses import dataclass
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from tokenizers import AddedToken, Tokenizer

# The template. A known role has a header of its own; any other one stands between ROLE and ROLE_END.
HEADERS = {"system": "### System: ", "user": "### User: ", "assistant": "### Assistant: ", "tool": "### Tool: "}
ROLE, ROLE_END, TURN_END = "### Role: ", "</role>", "</turn>"
CONTROL = [*HEADERS.values(), ROLE, ROLE_END, TURN_END]
RESERVED = "<|endoftext|>"  # a special token of the tokenizer file: must not come from a text either

PART_CHARS = 1 << 20

_PLAIN = re.compile(r"([#<])(\\*)(## (?:System|User|Assistant|Tool|Role): |/turn>|/role>|\|endoftext\|>)")
_ESCAPED = re.compile(r"([#<])\\(\\*)(## (?:System|User|Assistant|Tool|Role): |/turn>|/role>|\|endoftext\|>)")
_MARK = re.compile("|".join(map(re.escape, CONTROL)))


def escaped(text: str) -> str:
    """One backslash after the first character of a control string; one more where backslashes are already there."""
    return _PLAIN.sub(r"\1\\\2\3", text) if "## " in text or "<" in text else text


def unescaped(text: str) -> str:
    return _ESCAPED.sub(r"\1\2\3", text) if "\\" in text else text


@dataclass(frozen=True)
class Rendered:
    text: str
    loss: list[tuple[int, int]]  # sorted places of the texts that are learned


def render(turns: list[tuple[str, str]], learned: str = "assistant") -> Rendered:
    parts, loss, at = [], [], 0
    for role, text in turns:
        header, own = HEADERS.get(role) or f"{ROLE}{escaped(role)}{ROLE_END}", escaped(text)
        at += len(header)
        if role == learned and own:
            loss.append((at, at + len(own)))
        parts += [header, own, TURN_END]
        at += len(own) + len(TURN_END)
    return Rendered("".join(parts), loss)


def parse(text: str) -> list[tuple[str, str]]:
    """The turns of a rendered text."""
    names = {header: role for role, header in HEADERS.items()}
    turns, at = [], 0
    while at < len(text):
        mark = _MARK.match(text, at)
        start = mark.end()
        role = names.get(mark.group())
        if role is None:
            end = text.index(ROLE_END, start)
            role, start = unescaped(text[start:end]), end + len(ROLE_END)
        end = text.index(TURN_END, start)
        turns.append((role, unescaped(text[start:end])))
        at = end + len(TURN_END)
    return turns


@lru_cache(2)
def chat_tokenizer(path: str) -> Tokenizer:
    """The tokenizer file with the template's control strings as special tokens, which no other token can reach into."""
    os.environ.setdefault("TOKENIZERS_PARALLELISM", "false")
    tokenizer = Tokenizer.from_file(path)
    tokenizer.no_padding()
    tokenizer.no_truncation()
    tokenizer.add_special_tokens([AddedToken(c, special=True, normalized=False) for c in CONTROL])
    return tokenizer


def loss_mask(starts: np.ndarray, ends: np.ndarray, loss: list[tuple[int, int]]) -> np.ndarray:
    """Tokens that lie in a learned span, by binary search of sorted spans; a token that only reaches into one is refused."""
    if not loss:
        return np.zeros(len(starts), dtype=bool)
    first, last = np.array(loss).T
    at = np.searchsorted(first, starts, "right") - 1
    inside = (at >= 0) & (starts < last[np.maximum(at, 0)]) & (ends > starts)
    across = inside & (ends > last[np.maximum(at, 0)])
    if across.any():
        raise ValueError("a token crosses the end of a learned span")
    return inside


def _turns(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple[int | None, list[tuple[str, str]], bool]]:
    """(conversation, some turns, whether it begins here) from rows sorted by conversation; long ones come in parts."""
    key, held, size, begins = object(), [], 0, True
    for batch in batches:
        for conv, role, text in zip(*(c.to_pylist() for c in batch.columns), strict=True):
            if held and (conv != key or size > PART_CHARS):
                yield key, held, begins
                held, size, begins = [], 0, conv != key
            key = conv
            held.append((role or "", text or ""))
            size += len(text or "")
    if held:
        yield key, held, begins


def format_conversations(rows: DataFrame, path: str) -> DataFrame:
    """Conversations (conv_id, turn, role, text) as training examples: conv_id, part, text, ids, loss, one row per conversation.

    Turns come in order of (turn, role, text); repeated rows are repeated turns. Null roles and texts are empty; rows of a null
    conv_id are one conversation. Control strings inside texts are escaped, and ``parse`` gives the turns back. The whole text is
    encoded once with offsets; ``loss`` tells per token whether it belongs to an assistant's text. Control strings are special
    tokens, so tokens end where texts end and masks are exact to the character.

    Rows meet by conversation and stream through a task in order; a conversation above a million characters gives several
    consecutive parts (0, 1, ...), cut between turns, whose ids in order are those of the whole. Other columns are not read; an
    empty table gives no row.
    """
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        tokenizer, part = chat_tokenizer(path), 0
        for conv, turns, begins in _turns(batches):
            part = 0 if begins else part + 1
            shown = render(turns)
            encoded = tokenizer.encode(shown.text, add_special_tokens=False)
            offsets = np.array(encoded.offsets, np.int64).reshape(-1, 2)
            mask = loss_mask(offsets[:, 0], offsets[:, 1], shown.loss)
            yield pa.RecordBatch.from_arrays(
                [pa.array([conv], pa.int64()), pa.array([part], pa.int64()), pa.array([shown.text], pa.string()),
                 pa.array([np.array(encoded.ids, np.int32)], pa.list_(pa.int32())), pa.array([mask], pa.list_(pa.bool_()))],
                ["conv_id", "part", "text", "ids", "loss"])

    named = rows.select(F.col("conv_id").cast("long").alias("conv_id"), F.col("turn").cast("long").alias("turn"),
                        F.col("role").cast("string").alias("role"), F.col("text").cast("string").alias("text"))
    ordered = named.repartition("conv_id").sortWithinPartitions("conv_id", "turn", "role", "text")
    return ordered.select("conv_id", "role", "text").mapInArrow(
        run, "conv_id long, part long, text string, ids array<int>, loss array<boolean>")


def learned_texts(tokenizer: Tokenizer, ids: np.ndarray, loss: np.ndarray) -> list[str]:
    """The texts under the mask, one per run of masked tokens."""
    edge = np.flatnonzero(np.diff(np.concatenate(([0], loss.astype(np.int8), [0]))))
    return [unescaped(tokenizer.decode(ids[a:b].tolist(), skip_special_tokens=False)) for a, b in edge.reshape(-1, 2)]


def read_back(formatted: DataFrame, path: str) -> DataFrame:
    """conv_id, n_turns, turns_sha256, loss_chars, loss_sha256 and formatted_chars, from the output of ``format_conversations``."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        tokenizer = chat_tokenizer(path)
        row: list = []

        def done():
            conv, turns, turns_hash, chars, loss_hash, size = row
            return pa.RecordBatch.from_arrays(
                [pa.array([v], t) for v, t in ((conv, pa.int64()), (turns, pa.int64()), (turns_hash.hexdigest(), pa.string()),
                                               (chars, pa.int64()), (loss_hash.hexdigest(), pa.string()), (size, pa.int64()))],
                ["conv_id", "n_turns", "turns_sha256", "loss_chars", "loss_sha256", "formatted_chars"])

        for batch in batches:
            for k in range(batch.num_rows):
                conv, part, text = (batch.column(c)[k].as_py() for c in range(3))
                ids, loss = (np.array(batch.column(c)[k].values) for c in (3, 4))
                if part == 0:
                    if row:
                        yield done()
                    row = [conv, 0, hashlib.sha256(), 0, hashlib.sha256(), 0]
                for role, own in parse(text):
                    row[1] += 1
                    row[2].update(f"{role}\n{own}\n".encode())
                for own in learned_texts(tokenizer, ids, loss):
                    row[3] += len(own)
                    row[4].update(own.encode())
                row[5] += len(text)
        if row:
            yield done()

    return formatted.mapInArrow(
        run, "conv_id long, n_turns long, turns_sha256 string, loss_chars long, loss_sha256 string, formatted_chars long")
