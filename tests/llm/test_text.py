"""Encoding, chat formatting, packing."""

import hashlib
import random
import zlib

import numpy as np
import public_tokenizers
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F
from tokenizers import Tokenizer

from staygauge.llm.bpe import Decoder, Encoder, Merges, blocks, digests, encode
from staygauge.llm.chat import (
    chat_tokenizer, escaped, format_conversations, learned_texts, loss_mask, parse, read_back, render, unescaped)
from staygauge.llm.encoding import PieceIds
from staygauge.llm.packing import pack_documents, pattern_counts

from .conftest import texts_of

WORD_BPE = public_tokenizers.path("word_bpe_49k.json")
BYTE_BPE = public_tokenizers.path("byte_bpe_50k.json")


@pytest.fixture(scope="module")
def library():
    return Tokenizer.from_file(WORD_BPE)


@pytest.fixture(scope="module")
def encoder():
    return Encoder(WORD_BPE)


def library_ids(library, text):
    return library.encode(text or "", add_special_tokens=False).ids


def test_digests_equal_the_library(edge_docs, documents, library):
    for docs in (edge_docs, documents):
        got = sorted(map(tuple, digests(docs, WORD_BPE).collect()), key=str)
        want = []
        for d, t in texts_of(docs):
            ids = library_ids(library, t)
            shown, decoded = " ".join(map(str, ids)), library.decode(ids, skip_special_tokens=False)
            want.append((d, len(ids), hashlib.sha256(shown.encode()).hexdigest(), hashlib.sha256(decoded.encode()).hexdigest()))
        assert got == sorted(want, key=str)


def test_encode_keeps_other_columns(edge_docs, no_docs, library):
    for r in encode(edge_docs, WORD_BPE).collect():
        assert r.ids == library_ids(library, r.text)
        assert r.decoded == library.decode(r.ids, skip_special_tokens=False)
        assert r.score == "s"
    assert encode(no_docs, WORD_BPE).collect() == [] and digests(no_docs, WORD_BPE).collect() == []


@settings(max_examples=300, deadline=None)
@given(st.text(max_size=60))
def test_any_text(encoder, library, text):
    text = text.encode("utf-8", "ignore").decode()
    parts = [ids for ids, _ in encoder.stream(text, 7)]
    assert [i for part in parts for i in part] == library_ids(library, text)


@settings(max_examples=200, deadline=None)
@given(st.text(alphabet="ab!=.haeinst", min_size=1, max_size=400), st.integers(1, 40), st.integers(1, 50))
def test_words_in_parts(encoder, word, block, part):
    merges = encoder.merges
    whole = merges.tokens([*word[:-1], word[-1] + merges.end])
    assert list(merges.stream((word[i:i + part] for i in range(0, len(word), part)), block)) == whole


@settings(max_examples=200, deadline=None)
@given(st.text(alphabet="ab!=.haeinst", min_size=65, max_size=900))
def test_long_and_short_windows_merge_alike(encoder, word):
    symbols = [*word[:-1], word[-1] + encoder.merges.end]
    with pytest.MonkeyPatch.context() as patch:
        patch.setattr("staygauge.llm.bpe.SHORT", 10_000)
        plain = encoder.merges.tokens(list(symbols))
    assert encoder.merges.tokens(list(symbols)) == plain


def test_very_long_words(encoder, library):
    import time

    random.seed(2)
    for word in ("".join(random.choices("etaoinshrdlu", k=20_000)), "ha" * 6_000, "x" * 9_000):
        assert [i for ids, _ in encoder.stream(word) for i in ids] == library_ids(library, word)
    start = time.process_time()
    assert sum(len(ids) for ids, _ in encoder.stream("".join(random.choices("etaoinshrdlu", k=300_000)))) > 1000
    assert time.process_time() - start < 20


def test_a_window_is_bounded(encoder, monkeypatch):
    merges, longest = encoder.merges, 0
    own = merges.tokens

    def watched(symbols):
        nonlocal longest
        longest = max(longest, len(symbols))
        return own(symbols)

    monkeypatch.setattr(merges, "tokens", watched)
    assert sum(len(t) for t in merges.stream(("ha" * 500 for _ in range(200)), 100)) == 200_000 + len(merges.end)
    assert longest <= 100 + 2 * merges.lookahead + 1000 < 5000


def test_decoding_in_parts():
    tokenizer = Tokenizer.from_file(BYTE_BPE)
    text = "naïve 日本語 🙂 <|endoftext|> end"
    ids = tokenizer.encode(text).ids
    assert "".join(Decoder(BYTE_BPE).stream([i] for i in ids)) == text
    assert Merges(BYTE_BPE).lookahead > 1


def test_blocks_rebuild_the_text():
    for text in ("", "a", "ab cd " * 50, "x" * 500, " ́ " * 40):
        assert "".join(blocks(text, 16)) == text


# ---- chat -----------------------------------------------------------------------------------------
BITS = ["\\", "#", "##", " ", "### User: ", "### Role: ", "</turn>", "</role>", "<|endoftext|>", "<", "/", "é", "\n", "日", "word", "🙂", "\x00",
        "<\\/turn>", "#\\## Tool: "]


@settings(max_examples=300, deadline=None)
@given(st.lists(st.tuples(st.sampled_from(["user", "assistant", "system", "tool", "", "odd</role>"]), st.lists(st.sampled_from(BITS), max_size=7).map("".join)),
                min_size=1, max_size=5))
def test_any_turns(turns):
    shown, tokenizer = render(turns), chat_tokenizer(BYTE_BPE)
    assert parse(shown.text) == turns
    encoded = tokenizer.encode(shown.text, add_special_tokens=False)
    offsets = np.array(encoded.offsets).reshape(-1, 2)
    mask = loss_mask(offsets[:, 0], offsets[:, 1], shown.loss)
    assert "".join(learned_texts(tokenizer, np.array(encoded.ids), mask)) == "".join(t for r, t in turns if r == "assistant")


@given(st.lists(st.sampled_from(BITS), max_size=12).map("".join))
def test_escaping_is_reversible(text):
    assert unescaped(escaped(text)) == text and "</turn>" not in escaped(text) and "### User: " not in escaped(text)


def test_a_token_across_a_border_is_refused():
    with pytest.raises(ValueError):
        loss_mask(np.array([0]), np.array([5]), [(0, 3)])


def test_conversations(spark, monkeypatch):
    said = "\\### Assistant: </turn> ok"
    rows = [(1, 0, "user", "hi"), (1, 1, "assistant", "yo"), (1, 1, "assistant", "yo"), (2, 5, "assistant", None), (2, None, None, "x"),
            (3, 0, "odd", ""), (None, 0, "user", "u"), (None, 1, "assistant", "v"), (-7, 0, "user", said), (-7, 1, "assistant", said),
            *[(4, k, ("user", "assistant")[k % 2], "long text " * 20_000) for k in range(12)]]
    df = spark.createDataFrame([(*r, 1, "z") for r in rows], "conv_id long, turn long, role string, text string, part int, ids string")
    formatted = format_conversations(df, BYTE_BPE)
    assert formatted.filter("conv_id = 4").count() > 1 and formatted.filter("conv_id = 1").count() == 1
    got = {r.conv_id: r for r in read_back(formatted, BYTE_BPE).collect()}
    assert set(got) == {1, 2, 3, 4, None, -7}
    for conv, r in got.items():
        own = sorted(((t is not None, t or 0, ro is not None, ro or "", x or "") for c, t, ro, x in rows if c == conv))
        turns = hashlib.sha256("".join(f"{ro}\n{x}\n" for *_, ro, x in own).encode()).hexdigest()
        loss = "".join(x for *_, ro, x in own if ro == "assistant")
        assert (r.n_turns, r.turns_sha256, r.loss_chars) == (len(own), turns, len(loss)), conv
        assert r.loss_sha256 == hashlib.sha256(loss.encode()).hexdigest()
    assert read_back(format_conversations(df.limit(0), BYTE_BPE), BYTE_BPE).collect() == []


# ---- packing --------------------------------------------------------------------------------------
def test_piece_ids_equal_the_library(library):
    ids = PieceIds(WORD_BPE)
    for text in ("", "Ab, cd! <|endoftext|>x 12", "İΣ \x1c a\x1cb  ", "ᲊꟍ𐵐 Ა"):
        assert ids.of(text) == np.array(library_ids(library, text), "<u4").tobytes()


@pytest.mark.parametrize("max_length", [2048, 64])
def test_packing(edge_docs, library, max_length):
    rows = pack_documents(edge_docs, WORD_BPE, max_length, with_ids=True).collect()
    want = sorted((d, len(ids)) for d, ids in ((d or -1, [*library_ids(library, t), 1]) for d, t in texts_of(edge_docs)))
    texts = {}
    for d, t in texts_of(edge_docs):
        texts.setdefault(d, []).append([*library_ids(library, t), 1])
    by_sequence, begun = {}, []
    for r in rows:
        assert 0 < r.length <= max_length and r.length == len(r.ids) and r.start % max_length == 0
        own = [x[r.start:r.start + r.length] for x in texts[r.doc_id] if len(x) == r.doc_tokens]
        assert r.ids in own and r.ids_crc32 == zlib.crc32(np.array(r.ids, "<u4").tobytes())
        by_sequence.setdefault(r.sequence_id, []).append((r.offset, r.length))
        if r.start == 0:
            begun.append((r.doc_id or -1, r.doc_tokens))
    assert sorted(begun) == want
    assert sum(r.length for r in rows) == sum(n for _, n in want)
    for pieces in by_sequence.values():
        at = 0
        for offset, length in sorted(pieces):
            assert offset == at
            at += length
        assert at <= max_length
    assert sorted(by_sequence) == list(range(len(by_sequence)))


def test_packing_of_nothing(no_docs):
    assert pack_documents(no_docs, WORD_BPE).collect() == []


def test_patterns_hold_the_histogram():
    random.seed(1)
    for _ in range(50):
        histogram = {random.randint(1, 100): random.randint(1, 50) for _ in range(random.randint(1, 60))}
        patterns, placed = pattern_counts(histogram, 100), {}
        for count, lengths in patterns:
            assert count > 0 and sum(lengths) <= 100
            for length in lengths:
                placed[length] = placed.get(length, 0) + count
        assert placed == histogram and len(patterns) <= 2 * len(histogram)


def test_little_padding(more_documents):
    rows = pack_documents(more_documents, WORD_BPE).groupBy("sequence_id").agg(F.sum("length").alias("n")).collect()
    padding = sum(2048 - r.n for r in rows if r.n & (r.n - 1))
    assert padding < 0.02 * 2048 * len(rows)
