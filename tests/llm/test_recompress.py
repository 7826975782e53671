import hashlib

import numpy as np
import pyarrow as pa
from hypothesis import given, settings
from hypothesis import strategies as st

from prefloom.llm import recompress
from tests.llm.helpers import SMALL, no_documents, odd_documents, pairs_of, small_documents


def brute(documents, width=20):
    """(doc_id, n_words, n_removed, kept) of documents in order; equal (id, text) are one."""
    first, found = {}, []
    ordered = sorted({(d, t) for d, t in documents}, key=lambda x: (x[0] is not None, x[0] or 0))
    results = {}
    for document in ordered:
        words = [w.decode() for w in document[1].encode().split()]
        gone = [False] * len(words)
        for start in range(len(words) - width + 1):
            window = tuple(words[start : start + width])
            if window in first:
                gone[start : start + width] = [True] * width
            first.setdefault(window, start)
        kept = [w for w, g in zip(words, gone) if not g]
        results[document] = (document[0], len(words), sum(gone), " ".join(kept))
    return sorted((results[d] for d in documents), key=repr)


def rows(frame):
    return sorted(map(tuple, frame.collect()), key=repr)


def test_query_7_equals_brute_force(spark):
    want = [(*r[:3], hashlib.sha256(r[3].encode()).hexdigest()) for r in brute(small_documents())]
    assert rows(recompress.op7_substring_dedup(spark, SMALL)) == sorted(want, key=repr)


def test_many_repeats_of_few_words(spark, conf):
    """Runs, periods, copies and shifted copies, for several widths, rounds and partitions."""
    dice = np.random.default_rng(7)
    texts = []
    for i in range(120):
        words = [f"w{n}" for n in dice.integers(0, 3, dice.integers(0, 60))]
        words += ["run"] * int(dice.integers(0, 30)) + ["a", "b"] * int(dice.integers(0, 20))
        if i > 40:
            other = texts[int(dice.integers(0, i))].split()
            at = int(dice.integers(0, len(other) + 1))
            words[int(dice.integers(0, len(words) + 1)) :] = other[at : at + 50]
        texts.append(" ".join(words))
    documents = list(enumerate(texts))
    frame = spark.createDataFrame(documents, "doc_id BIGINT, text STRING")
    for width, rounds, partitions in ((20, 3, 1), (7, 2, 5), (5, 0, 3), (11, 6, 5)):
        conf("spark.sql.shuffle.partitions", str(partitions))
        got = recompress.remove_repeats(frame.repartition(partitions), width, rounds)
        assert rows(got) == brute(documents, width)


def test_odd_rows(spark):
    frame = odd_documents(spark)
    documents = [(i, t) for i, t in pairs_of(frame)]
    assert rows(recompress.remove_repeats(frame)) == brute(documents)
    assert recompress.remove_repeats(no_documents(spark)).count() == 0


@settings(max_examples=200, deadline=None)
@given(st.lists(st.integers(0, 2), min_size=12, max_size=30), st.lists(st.integers(0, 2), max_size=9), st.lists(st.integers(0, 2), max_size=9))
def test_equal_windows_share_their_name(middle, before, after):
    """What a window is led by does not depend on the words around it."""
    spell = lambda numbers: " ".join(f"w{n}" for n in numbers)
    width, names = 12, {}
    for listed in (middle, before + middle + after, after + middle, middle + before):
        words = recompress.Words(pa.array([spell(listed)], pa.large_string()))
        for name, _, begin, count in zip(*recompress.units(words, width, 2)):
            for start in range(begin, begin + count):
                key = tuple(listed[start : start + width])
                assert names.setdefault(key, name) == name


def test_lowest_of_ranges():
    dice = np.random.default_rng(3)
    values = dice.integers(0, 50, 200).astype(np.uint64)
    start = dice.integers(0, 199, 300)
    end = start + 1 + dice.integers(0, 200 - start - 1 + 1) % np.maximum(200 - start - 1, 1)
    for a, b, at in zip(start, end, recompress.lowest(values, start, end)):
        assert a <= at < b and values[at] == values[a:b].min()
