import random
from collections import defaultdict

import numpy as np
import pytest
import xxhash

from prefloom.llm import components, simhash
from tests.llm.helpers import SMALL, no_documents, odd_documents, pairs_of, small_documents


def brute_mark(text, width=3):
    words = [w for w in "".join(c.lower() if "A" <= c <= "Z" else c for c in text).encode().split()]
    if not words:
        return 0
    shingles = [b" ".join(words[i : i + width]) for i in range(max(1, len(words) - width + 1))]
    hashes = [xxhash.xxh64_intdigest(s, 42) for s in shingles]
    return sum(1 << bit for bit in range(64) if 2 * sum(h >> bit & 1 for h in hashes) > len(hashes))


def brute_components(marked):
    marks = sorted({m for _, m in marked})
    root = {m: m for m in marks}

    def find(m):
        while root[m] != m:
            root[m] = root[root[m]]
            m = root[m]
        return m

    for i, a in enumerate(marks):
        for b in marks[i + 1 :]:
            if (a ^ b).bit_count() <= 3:
                root[find(a)] = find(b)
    low = defaultdict(list)
    for doc_id, mark in marked:
        low[find(mark)].append(doc_id)
    least = {key: min((x for x in ids if x is not None), default=None) for key, ids in low.items()}
    return sorted(((i, f"{m:016x}", least[find(m)]) for i, m in marked), key=repr)


def rows(frame):
    return sorted(map(tuple, frame.collect()), key=repr)


def test_query_5_equals_brute_force(spark):
    marked = [(i, brute_mark(t)) for i, t in small_documents()]
    assert rows(simhash.op5_simhash(spark, SMALL)) == brute_components(marked)


def test_odd_rows(spark):
    frame = odd_documents(spark)
    marked = [(i, brute_mark(t)) for i, t in pairs_of(frame)]
    assert rows(simhash.near_duplicates(frame)) == brute_components(marked)
    assert simhash.near_duplicates(no_documents(spark)).count() == 0


@pytest.mark.parametrize("group,free_bits", [(10**6, 15), (3, 15), (1, 30)])
def test_split_groups_lose_no_link(spark, group, free_bits):
    dice = random.Random(5)
    marks = {0, 2**64 - 1}
    for _ in range(12):
        mark = dice.getrandbits(64)
        for _ in range(12):  # chains of near fingerprints
            marks.add(mark)
            for _ in range(dice.randrange(1, 5)):
                mark ^= 1 << dice.randrange(64)
    numbers = np.array(sorted(marks), dtype=np.uint64).view(np.int64).tolist()
    frame = spark.createDataFrame([(n, n) for n in numbers], "node BIGINT, mark BIGINT")
    found = simhash.links(spark, frame, group=group, free_bits=free_bits)
    got = {r.node: r.component for r in components.components(spark, found).collect()}
    want = brute_components([(m, m) for m in sorted(marks)])
    classes = defaultdict(set)
    for number, (mark, _, low) in zip(numbers, sorted(want)):
        classes[low].add(got.get(np.int64(np.uint64(mark).view(np.int64)).item(), np.uint64(mark).view(np.int64).item()))
    assert all(len(x) == 1 for x in classes.values()) and len(set().union(*classes.values())) == len(classes)


def test_components_of_a_long_chain_and_a_star(spark):
    links = [(i, i + 1) for i in range(200)] + [(1000, 1000 + i) for i in range(300)] + [(5, 5), (None, 3)]
    found = components.components(spark, spark.createDataFrame(links, "u BIGINT, v BIGINT")).collect()
    assert sorted((r.node, r.component) for r in found) == [(i, 0) for i in range(201)] + [(1000 + i, 1000) for i in range(300)]


def test_one_of_each_group_stays(spark):
    dice = random.Random(8)
    rows = []
    for group in range(30):
        words = [f"w{dice.randrange(5000)}" for _ in range(400)]
        for copy in range(dice.randrange(1, 5)):
            edited = list(words)
            for edit in range(copy):
                edited[dice.randrange(400)] = f"changed{group}x{copy}x{edit}"
            rows.append((len(rows), " ".join(edited), "x", "y"))
    rows += [(0, rows[0][1], "x", "y"), (None, rows[0][1], "x", "y"), (900, None, "x", "y"), (901, "", "x", "y")]
    frame = spark.createDataFrame(rows, "doc_id BIGINT, text STRING, tie STRING, doc STRING")
    got = simhash.one_of_each(frame)
    want = {low for _, _, low in brute_components([(r[0], brute_mark(r[1] or "")) for r in rows])}
    assert sorted(r.doc_id for r in got.collect()) == sorted(want) and got.columns == frame.columns
    assert 900 in want and 30 < len(want) < len(rows) - 3
    assert simhash.one_of_each(no_documents(spark)).count() == 0
