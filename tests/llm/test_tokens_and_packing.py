import zlib
from collections import defaultdict

import numpy as np
import public_tokenizers
import pytest
import sentencepiece
from hypothesis import given, settings
from hypothesis import strategies as st
from tokenizers import Tokenizer

from prefloom.llm import packing, tokens
from tests.llm.helpers import SMALL, no_documents, odd_documents, pairs_of, small_documents

PIECES = sentencepiece.SentencePieceProcessor(model_file=public_tokenizers.path(tokens.MODEL))
LIBRARY = Tokenizer.from_file(public_tokenizers.path(packing.VOCABULARY))
COUNTS = tokens.Counts(PIECES)
CODER = packing.WordIds(public_tokenizers.path(packing.VOCABULARY), packing.proved_ranks(public_tokenizers.path(packing.VOCABULARY)))
HARD = st.text(alphabet=" ▁\n\t\r a'sdblRE<|endoftext|>12ßÀ×,.;-_İſ的ñ́\x00", max_size=30)


@settings(max_examples=500, deadline=None)
@given(HARD)
def test_counts_equal_the_library(text):
    assert COUNTS.count([text]) == [len(PIECES.encode(text))]


def test_bounded_memory_keeps_counts():
    counts = tokens.Counts(PIECES, remembered=len(COUNTS.proved) + 5)
    texts = [text for _, text in small_documents()[:20]]
    assert [counts.count([t])[0] for t in texts] == [len(PIECES.encode(t)) for t in texts]


def test_query_4_equals_brute_force(spark):
    rows = tokens.op4_token_counts(spark, SMALL).collect()
    want = [(i, len(t.encode()), len(PIECES.encode(t)), len(PIECES.encode(t)) > 4096) for i, t in small_documents()]
    assert sorted(map(tuple, rows)) == sorted(want)


def test_counts_of_odd_rows(spark):
    frame = odd_documents(spark)
    got = sorted(map(repr, map(tuple, tokens.count_tokens(frame).collect())))
    want = [(i, len(t.encode()), len(PIECES.encode(t)), len(PIECES.encode(t)) > 4096) for i, t in pairs_of(frame)]
    assert got == sorted(map(repr, want))
    assert tokens.count_tokens(no_documents(spark)).count() == 0


@settings(max_examples=500, deadline=None)
@given(HARD)
def test_word_ids_equal_the_library(text):
    got = [n for word in text.split(" ") for n in np.frombuffer(CODER.encode(word), "<u4")] if " " not in text else None
    if got is not None and not any(c.isspace() for c in text):
        assert got == LIBRARY.encode(text, add_special_tokens=False).ids


def check_packing(rows, documents):
    """Each id in exactly one piece, gapless offsets, sequences of a power of two."""
    want = defaultdict(list)
    for doc_id, text in documents:
        want[doc_id].append(np.array(LIBRARY.encode(text, add_special_tokens=False).ids + [2], dtype="<u4"))
    sequences, ids = defaultdict(list), defaultdict(int)
    for row in rows:
        sequences[row.sequence_id].append((row.offset, row.length))
        options = [x for x in want[row.doc_id] if len(x) == row.doc_tokens]
        assert row.ids_crc32 in {zlib.crc32(x[row.start : row.start + row.length].tobytes()) for x in options}
        ids[row.doc_id] += row.length
    assert dict(ids) == {doc_id: sum(map(len, found)) for doc_id, found in want.items()}
    for held in sequences.values():
        held.sort()
        assert [offset for offset, _ in held] == list(np.cumsum([0] + [n for _, n in held])[:-1])
        total = sum(n for _, n in held)
        assert total <= 4096 and total & (total - 1) == 0


def test_query_2_packs_every_id(spark):
    check_packing(packing.op2_packing(spark, SMALL).collect(), small_documents())


def test_packing_odd_rows(spark):
    from pyspark.sql import functions as F

    frame = odd_documents(spark).repartition(3)
    rows = packing.pack(frame).withColumn("ids_crc32", F.crc32("ids")).collect()
    check_packing(rows, pairs_of(frame))
    assert packing.pack(no_documents(spark)).count() == 0


def test_tiers_and_step_groups():
    packer = packing.Packer(0, held=3000)
    random = np.random.default_rng(4)
    sizes = [int(n) for n in random.integers(1, 9000, 300)]
    for doc_id, size in enumerate(sizes):
        packer.add(np.arange(size, dtype="<u4"), doc_id)
    packer.finish()
    rows = packer.emitted()
    assert sum(row[2] for row in rows) == sum(sizes)
    tokens_of = defaultdict(int)
    windows = {row[5]: (row[7], row[8]) for row in rows}
    for window, step in windows.values():
        tokens_of[step] += window
    assert max(tokens_of.values()) <= packing.STEP_TOKENS
    # The first piece of a window of a tier fills more than half of it.
    assert all(row[2] > row[7] // 2 for row in rows if row[6] == 0 and row[7] in packing.TIERS[1:])


def test_windows_must_be_powers_of_two():
    with pytest.raises(ValueError):
        packing.Packer(0, tiers=(300,))
