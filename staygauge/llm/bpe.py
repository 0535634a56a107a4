"""Byte-pair encoding and decoding as streaming transducers with bounded memory."""

from __future__ import annotations

import hashlib
import json
import re
from collections.abc import Iterable, Iterator
from functools import lru_cache
from heapq import heapify, heappop, heappush
from itertools import chain

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from staygauge.llm.columns import free_name, quoted
from staygauge.llm.encoding import BoundedCache, as_signs, byte_signs, lowered, pieces, special_tokens, words_of

BLOCK = 1 << 16  # characters of a text that are held at a time
SHORT = 64  # symbols up to which a scan for the best pair costs less than a heap
CACHE_ENTRIES = 600_000  # about 150 MB: merging in Python costs more than the library does
_NONE = 1 << 60


class Merges:
    """The merge list of a tokenizer file: ranks by pair, ids by token, and how far a merge can be decided by what follows."""

    def __init__(self, path: str):
        with open(path, encoding="utf-8") as file:
            model = json.load(file)["model"]
        self.ids: dict[str, int] = model["vocab"]
        self.end: str = model["end_of_word_suffix"] or ""
        pairs = [tuple(m) if isinstance(m, list) else tuple(m.split(" ")) for m in model["merges"]]
        self.ranks = {pair: rank for rank, pair in enumerate(pairs)}
        self.lookahead = self._lookahead(pairs)

    def _size(self, token: str) -> int:
        return len(token.removesuffix(self.end)) if self.end and len(token) > len(self.end) else len(token)

    def _lookahead(self, pairs: list[tuple[str, str]]) -> int:
        """Symbols after a border that can still decide whether a merge crosses it.

        A merge (u, v) may be undone by another one that takes v's beginning, or a part that v grows from, further right; that
        one must come earlier in the list, and so on. The longest such chain of falling ranks bounds the reach. reach[t]: the
        longest chain, over the merges so far, that begins with the token t on its left.
        """
        reach: dict[str, int] = {}
        left_of: dict[str, str] = {}
        longest = 1
        for u, v in pairs:
            chain, part = self._size(v), v
            while part is not None:
                chain = max(chain, reach.get(part, 0))
                part = left_of.get(part)
            chain += self._size(u)
            reach[u] = max(reach.get(u, 0), chain)
            left_of.setdefault(u + v, u)
            longest = max(longest, chain)
        return longest

    def tokens(self, symbols: list[str]) -> list[str]:
        """Merge the leftmost pair of the lowest rank until none is left. ``symbols`` may be changed."""
        if len(symbols) > SHORT:
            return self._tokens(symbols)
        ranks = self.ranks
        own = [ranks.get(pair, _NONE) for pair in zip(symbols, symbols[1:])]  # noqa: B905
        while own:
            best = min(own)
            if best == _NONE:
                break
            i = own.index(best)
            symbols[i:i + 2] = [symbols[i] + symbols[i + 1]]
            del own[i]
            if i < len(own):
                own[i] = ranks.get((symbols[i], symbols[i + 1]), _NONE)
            if i:
                own[i - 1] = ranks.get((symbols[i - 1], symbols[i]), _NONE)
        return symbols

    def _tokens(self, symbols: list[str]) -> list[str]:
        """The same with a heap of pairs over linked symbols: n log n steps. A pair that is no more has another rank or none."""
        ranks, n = self.ranks, len(symbols)
        after, before = list(range(1, n + 1)), list(range(-1, n - 1))
        heap = [(ranks[pair], i) for i, pair in enumerate(zip(symbols, symbols[1:])) if pair in ranks]  # noqa: B905
        heapify(heap)
        while heap:
            rank, i = heappop(heap)
            j = after[i]
            if not symbols[i] or j >= n or ranks.get((symbols[i], symbols[j])) != rank:
                continue
            symbols[i] += symbols[j]
            symbols[j] = ""
            after[i] = k = after[j]
            if k < n:
                before[k] = i
                if (symbols[i], symbols[k]) in ranks:
                    heappush(heap, (ranks[symbols[i], symbols[k]], i))
            h = before[i]
            if h >= 0 and (symbols[h], symbols[i]) in ranks:
                heappush(heap, (ranks[symbols[h], symbols[i]], h))
        return [token for token in symbols if token]

    def stream(self, signs: Iterable[str], block: int | None = None) -> Iterator[str]:
        """Tokens of one word, given in parts. At most ``block + 2 * lookahead`` symbols (and a part) are held: a token is passed on
        when ``lookahead`` symbols after it are known, and what follows a passed token is encoded as if it began there."""
        held: list[str] = []
        block = block or 2 * self.lookahead
        for part in signs:
            held += part
            while len(held) > block + 2 * self.lookahead:
                window = held[:block + self.lookahead]
                done = 0
                for token in self.tokens(window):
                    if done + len(token) > block:
                        break
                    done += len(token)
                    yield token
                del held[:max(done, 0)]
        if held:
            held[-1] += self.end
            yield from self.tokens(held)


class Encoder:
    """ids and tokens of texts, as the tokenizers library gives them for the same file."""

    def __init__(self, path: str):
        self.merges = Merges(path)
        self.specials = special_tokens(path)
        self.special = re.compile("(" + "|".join(map(re.escape, self.specials)) + ")")
        self.words = BoundedCache(self._word, CACHE_ENTRIES)
        self.pieces = BoundedCache(self._piece, CACHE_ENTRIES)

    def _word(self, word: str) -> tuple[int, ...]:
        signs, ids, size = as_signs(word), self.merges.ids, self.merges.lookahead
        return tuple([ids[t] for t in self.merges.stream(signs[i:i + size] for i in range(0, len(signs), size))])

    def ids_of(self, piece: str) -> list[int]:
        out: list[int] = []
        for part in self.special.split(piece) if "<|" in piece else (piece,):
            if part in self.specials:
                out.append(self.specials[part])
            elif part:
                for word in words_of(lowered(part)):
                    out += self.words[word]
        return out

    def _piece(self, piece: str) -> tuple[tuple[int, ...], bytes]:
        ids = self.ids_of(piece)
        return tuple(ids), b"".join([b" %d" % i for i in ids])

    def stream(self, text: str, block: int = BLOCK) -> Iterator[tuple[list[int], bytes]]:
        """ids, and the same in decimal with a space before each, of one part of the text after the other."""
        for part in blocks(text, block):
            found = list(map(self.pieces.__getitem__, pieces(part)))
            if found:
                yield list(chain.from_iterable([ids for ids, _ in found])), b"".join([shown for _, shown in found])


_GAP = re.compile("[^\\S\x1c-\x1f]")  # the tokenizer does not take these four for white space


def blocks(text: str, size: int = BLOCK) -> Iterator[str]:
    """Parts of at least ``size`` characters, cut before white space: no word, and no character with its marks, is cut."""
    at = 0
    while at < len(text):
        gap = _GAP.search(text, at + size) if len(text) - at > size else None
        end = gap.start() if gap else len(text)
        yield text[at:end]
        at = end


class Decoder:
    """Ids to text, in parts. A state machine over bytes: what does not end a character yet is held back.

    A tokenizer file without a decoder joins its tokens by spaces; one with a byte-level decoder maps their signs to bytes.
    """

    def __init__(self, path: str):
        with open(path, encoding="utf-8") as file:
            spec = json.load(file)
        tokens = {i: t for t, i in spec["model"]["vocab"].items()}
        specials = {t["id"]: t["content"] for t in spec["added_tokens"]}
        size = max([*tokens, *specials]) + 1
        if spec["decoder"] is None:
            self.join, self.table = b" ", [specials.get(i, tokens.get(i, "")).encode() for i in range(size)]
        else:
            back = {sign: b for b, sign in enumerate(byte_signs())}
            raw = [specials.get(i) or tokens.get(i, "") for i in range(size)]
            self.join, self.table = b"", [
                t.encode() if i in specials or any(c not in back for c in t) else bytes(back[c] for c in t) for i, t in enumerate(raw)]

    def stream(self, parts: Iterable[list[int]]) -> Iterator[str]:
        import codecs

        machine = codecs.getincrementaldecoder("utf-8")("replace")
        between = b""
        for ids in parts:
            if ids:
                yield machine.decode(between + self.join.join([self.table[i] for i in ids]))
                between = self.join
        yield machine.decode(b"", True)


@lru_cache(2)
def coder(path: str) -> tuple[Encoder, Decoder]:
    """One per Python worker and tokenizer file, so that tasks share the caches."""
    return Encoder(path), Decoder(path)


def encode(docs: DataFrame, path: str) -> DataFrame:
    """All columns of ``docs`` (doc_id, text) with ids array<int> and decoded (input columns with these names are replaced).

    ids are the library's for this tokenizer file without special tokens added, decoded its decode() of them. Null and empty
    texts have no ids and decode to the empty text. Every row is encoded by itself; an empty table gives none.
    """
    @F.pandas_udf("ids array<int>, decoded string")
    def run(text):
        import pandas as pd

        encoder, decoder = coder(path)
        ids, decoded = [], []
        for own in text.fillna("").tolist():
            parts = [part for part, _ in encoder.stream(own)]
            ids.append([i for part in parts for i in part])
            decoded.append("".join(decoder.stream(parts)))
        return pd.DataFrame({"ids": ids, "decoded": decoded})

    named = docs.drop("ids", "decoded")
    own = free_name(named, "coded_text")
    coded = named.withColumn(own, run(F.col("text").cast("string")))
    return coded.select(*map(quoted, named.columns), f"{own}.*")


def digests(docs: DataFrame, path: str) -> DataFrame:
    """doc_id, n_tokens, ids_sha256 and decoded_sha256 of each text of ``docs`` (doc_id, text).

    The same streams as in ``encode``, hashed part by part: neither the ids nor the decoded text of a document is held whole.
    """
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encoder, decoder = coder(path)
        for batch in batches:
            rows = []
            for text in batch.column(1).to_pylist():
                total, ids_hash, text_hash = 0, hashlib.sha256(), hashlib.sha256()

                def parts(text=text, ids_hash=ids_hash):
                    nonlocal total
                    for own, shown in encoder.stream(text or ""):
                        ids_hash.update(shown if total else shown[1:])
                        total += len(own)
                        yield own

                for decoded in decoder.stream(parts()):
                    text_hash.update(decoded.encode())
                rows.append((total, ids_hash.hexdigest(), text_hash.hexdigest()))
            n, ids, decoded = zip(*rows, strict=True) if rows else ((), (), ())
            yield pa.RecordBatch.from_arrays(
                [batch.column(0), pa.array(n, pa.int64()), pa.array(ids, pa.string()), pa.array(decoded, pa.string())],
                ["doc_id", "n_tokens", "ids_sha256", "decoded_sha256"])

    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
    return rows.mapInArrow(run, "doc_id long, n_tokens long, ids_sha256 string, decoded_sha256 string")
