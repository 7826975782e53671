from collections import Counter, defaultdict

import numpy as np
import pytest

from prefloom.llm import mixing
from prefloom.llm.common import documents
from tests.llm.helpers import SMALL, no_documents, odd_documents, small_documents


def rows(frame):
    return sorted(map(tuple, frame.collect()), key=repr)


def test_targets_stop_at_twice_the_size():
    assert mixing.targets([100, 100, 100]) == pytest.approx([200, 250 / 3, 500 / 3])
    assert mixing.targets([10, 1000, 10]) == pytest.approx([20, 1490, 20])
    assert mixing.targets([]) == [] and mixing.targets([0, 0]) == [0, 0]
    sizes = [7, 900, 3, 55, 1200, 1, 0, 400]
    found = mixing.targets(sizes)
    assert sum(found) == pytest.approx(1.5 * sum(sizes)) and all(t <= 2 * s for t, s in zip(found, sizes))


@pytest.mark.parametrize("size", [1, 2, 3, 10, 255, 256, 257, 5000])
def test_permutation(size):
    for key in (0, 9):
        out = mixing.permute(np.arange(size), np.full(size, size), np.full(size, key))
        assert sorted(out.tolist()) == list(range(size))


def test_query_10(spark):
    got = mixing.op10_mixing(spark, SMALL).collect()
    sizes = {i: len(t.encode().split()) for i, t in small_documents()}
    assert {r.doc_id: r.size for r in got} == sizes
    assert all(0 <= r.taken <= 2 * r.size for r in got)
    by_source = defaultdict(lambda: [0, 0])
    for r in got:
        by_source[r.source_size, r.target][0] += r.size
        by_source[r.source_size, r.target][1] += r.taken
    for (source_size, target), (size, taken) in by_source.items():
        assert size == source_size and abs(taken - target) <= 2 * mixing.BLOCK_WORDS
    assert rows(mixing.op10_mixing(spark, SMALL)) == sorted(map(tuple, got), key=repr)


def test_mix_is_whole_and_independent_of_partitions(spark, conf):
    found = []
    for partitions in ("1", "5"):
        conf("spark.sql.shuffle.partitions", partitions)
        mix = mixing.Mix(documents(spark, SMALL).repartition(int(partitions)), block_words=16, shard_slots=100)
        found.append(rows(mix.pieces))
    assert found[0] == found[1]
    slots = {(p[2], p[3]): 0 for p in ((r.source_no, r.block, r.shard, r.slot) for r in mix.pieces.collect())}
    total = int(mix.plan.slots.sum())
    per_shard = Counter(shard for shard, _ in slots)
    assert len(slots) == total and all(n == 100 for shard, n in per_shard.items() if shard < total // 100)
    taken = Counter((r.source_no, r.block, r["pass"]) for r in mix.pieces.select("source_no", "block", "pass", "shard", "slot").distinct().collect())
    assert max(taken.values()) == 1


def test_odd_rows(spark):
    frame = odd_documents(spark)
    got = mixing.taken_words(frame, block_words=4).collect()
    assert len(got) == frame.count() and all(r.taken <= 2 * r.size for r in got)
    assert mixing.taken_words(no_documents(spark)).count() == 0


def test_mixed_documents_are_cut_from_their_texts(spark):
    frame = documents(spark, SMALL)
    taken = {r.doc_id: r.taken for r in mixing.taken_words(frame).collect()}
    texts = dict(small_documents())
    words = Counter()
    for row in mixing.mixed_documents(frame).collect():
        words[row.doc_id] += len(row.text.encode().split())
        assert row.n_chars == len(row.text) <= len(texts[row.doc_id])
    assert {i: n for i, n in taken.items() if n} == dict(words)
    odd = mixing.mixed_documents(odd_documents(spark))
    assert odd.columns == odd_documents(spark).columns and odd.count() > 0
    assert mixing.mixed_documents(no_documents(spark)).count() == 0
    assert mixing.cut_words(" a b\n c ", [(0, 1), (2, 1)]) == "a c "
