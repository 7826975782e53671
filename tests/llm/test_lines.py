from collections import defaultdict

import numpy as np
import pytest
from pyspark.sql import functions as F

from prefloom.llm import lines
from prefloom.llm.common import documents
from tests.llm.helpers import SMALL, no_documents, odd_documents, pairs_of, small_documents


def distance(a, b, limit):
    """Plain dynamic programme; more than the limit counts as limit + 1."""
    if abs(len(a) - len(b)) > limit:
        return limit + 1
    row = list(range(len(b) + 1))
    for i, x in enumerate(a, 1):
        new = [i]
        for j, y in enumerate(b, 1):
            new.append(min(row[j] + 1, new[-1] + 1, row[j - 1] + (x != y)))
        row = new
        if min(row) > limit:
            return limit + 1
    return min(row[-1], limit + 1)


def brute(documents, edits=2, min_chars=20):
    """Links among different lines, and (copies, first document) of each line."""
    first, copies = {}, defaultdict(int)
    for doc_id, text in documents:
        for line in text.split("\n"):
            line = line.strip(lines.WHITE)
            if len(line) >= min_chars:
                copies[line] += 1
                known = [x for x in (first.get(line), doc_id) if x is not None]
                first[line] = min(known, default=None)
    listed, found = sorted(copies, key=len), set()
    for i, a in enumerate(listed):
        for b in listed[i + 1 :]:
            if len(b) - len(a) > edits:
                break
            # Within a few edits, a half of one line or the other stays nearly in place.
            if distance(a, b, edits) <= edits:
                found |= {(a, b), (b, a)}
    return found, copies, first


def check(rows, documents, **options):
    found, copies, first = brute(documents, **options)
    near, root = defaultdict(set), {}
    for a, b in found:
        near[a].add(b)
    for line in copies:
        if line not in root:
            todo, seen = [line], {line}
            while todo:
                for other in near[todo.pop()] - seen:
                    seen.add(other)
                    todo.append(other)
            for x in seen:
                root[x] = min((first[y] for y in seen if first[y] is not None), default=None)
    want = sorted(((first[x], len(x), copies[x], root[x], len(near[x])) for x in copies), key=repr)
    assert sorted(((r.doc_id, r.n_chars, r.copies, r.class_doc_id, r.links) for r in rows), key=repr) == want
    return found


def edited(dice, line, edits):
    letters = list(line)
    for _ in range(edits):
        at, kind = int(dice.integers(0, len(letters) + 1)), int(dice.integers(0, 3))
        letter = str(dice.choice(list("abcé日𝄞")))
        if kind == 0:
            letters.insert(at, letter)
        elif at < len(letters):
            letters[at : at + 1] = [letter] * (kind == 1)
    return "".join(letters)


@pytest.mark.parametrize("edits", [1, 2, 3])
def test_bit_parallel_distance(spark, edits):
    dice = np.random.default_rng(edits)
    pairs = []
    for n in range(400):
        a = "".join(dice.choice(list("abé𝄞"), dice.integers(edits, 90)))
        b = edited(dice, a, int(dice.integers(0, 6)))
        if abs(len(a) - len(b)) <= edits and len(b) >= edits:
            pairs.append((n, a, b))
    frame = spark.createDataFrame(pairs, "n INT, a STRING, b STRING")
    x, y = lines.characters(F.col("a")), lines.characters(F.col("b"))
    got = frame.select("n", x.alias("x"), y.alias("y")).select("n", lines.edit_distance(F.col("x"), F.col("y"), edits).alias("d"))
    known = {r.n: r.d for r in got.collect()}
    for n, a, b in pairs:
        want = distance(a, b, edits)
        assert min(known[n], edits + 1) == want


@pytest.mark.parametrize("edits,min_chars", [(1, 8), (2, 12), (3, 12)])
def test_no_link_is_lost(spark, edits, min_chars):
    dice = np.random.default_rng(11)
    texts = []
    for _ in range(25):
        line = "".join(dice.choice(list("ab é日𝄞"), dice.integers(min_chars, 45)))
        texts += [edited(dice, line, int(dice.integers(0, edits + 2))) for _ in range(12)]
    rows = [(i, "\n".join(texts[i::40])) for i in range(40)]
    frame = spark.createDataFrame(rows, "doc_id BIGINT, text STRING")
    found = check(lines.line_classes(frame, edits, min_chars).collect(), rows, edits=edits, min_chars=min_chars)
    assert len(found) > 200
    # The same links where every key counts as crowded.
    listed = lines.document_lines(frame)
    pairs = [
        sorted(map(tuple, lines.links(spark, listed, edits, min_chars, crowd).collect())) for crowd in (0, 10**9)
    ]
    assert pairs[0] == pairs[1] and 2 * len(pairs[0]) == len(found)


def test_many_lines_of_one_template(spark):
    dice = np.random.default_rng(2)
    codes = ["".join(dice.choice(list("0123456789abcdef"), 12)) for _ in range(4000)]
    codes += [code[:-1] + "x" for code in codes[:50]]
    rows = [(i, f"Order number {code} was shipped to the customer today.") for i, code in enumerate(codes)]
    frame = spark.createDataFrame(rows, "doc_id BIGINT, text STRING")
    found = lines.links(spark, lines.document_lines(frame)).collect()
    assert len(found) == 50


def test_query_8_equals_brute_force(spark):
    check(lines.op8_line_dedup(spark, SMALL).collect(), small_documents())


def test_ids_meet_in_a_shuffle_when_many(spark, monkeypatch):
    monkeypatch.setattr(lines, "SENT_IDS", 0)
    check(lines.op8_line_dedup(spark, SMALL).collect(), small_documents())


def test_odd_rows(spark):
    frame = odd_documents(spark)
    check(lines.line_classes(frame, min_chars=4).collect(), pairs_of(frame), min_chars=4)
    assert lines.line_classes(no_documents(spark)).count() == 0


def test_plans_hold_no_python(spark):
    from tests.conftest import plan_of

    for frame in (lines.op8_line_dedup(spark, SMALL), lines.without_repeated_lines(documents(spark, SMALL))):
        assert not any(x in plan_of(frame) for x in ("Python", "Pandas", "Arrow", "Cartesian", "NestedLoop"))


def test_repeated_lines_are_taken_out(spark):
    long = "a line that is long enough to count"
    rows = [
        (3, f"{long}\nshort\n{long}!", 9),
        (1, f"first\n {long}x \nshort", 9),
        (None, long, 9),
        (5, None, None),
        (6, "alone", 5),
        (6, "alone", 5),
    ]
    frame = spark.createDataFrame([(*r, "z", "z") for r in rows], "doc_id BIGINT, text STRING, n_chars BIGINT, gone STRING, tie STRING")
    got = lines.without_repeated_lines(frame)
    assert got.columns == frame.columns
    assert sorted(((r.doc_id, r.text, r.n_chars) for r in got.collect()), key=repr) == sorted(
        [(3, "short", 5), (1, rows[1][1], 9), (None, "", 0), (5, None, None), (6, "alone", 5), (6, "alone", 5)], key=repr
    )
    assert lines.without_repeated_lines(no_documents(spark)).count() == 0


def check_members(rows, documents):
    """Every holder of every non-empty line, and classes as the brute force links them."""
    held = defaultdict(int)
    for doc_id, text in documents:
        for line in text.split("\n"):
            if line := line.strip(lines.WHITE):
                held[doc_id, line] += 1
    assert sorted(((r.doc_id, r.n_chars, r.copies) for r in rows), key=repr) == sorted(
        ((doc_id, len(line), n) for (doc_id, line), n in held.items()), key=repr
    )
    near, holders, root = defaultdict(set), defaultdict(set), {}
    for a, b in brute(documents)[0]:
        near[a].add(b)
    for doc_id, line in held:
        holders[line].add(doc_id)
    for line in holders:
        if line not in root:
            todo = [line]
            while todo:
                x = todo.pop()
                if x not in root:
                    root[x] = line
                    todo += near[x]
    want, got = defaultdict(set), defaultdict(set)
    for line, ids in holders.items():
        want[root[line]] |= ids
    for r in rows:
        got[r.class_id].add(r.doc_id)
    assert sorted(map(repr, map(sorted_ids, want.values()))) == sorted(map(repr, map(sorted_ids, got.values())))
    return held


def sorted_ids(ids):
    return sorted(ids, key=repr)


def test_members_name_every_holder_of_every_line(spark):
    held = check_members(lines.op8_line_members(spark, SMALL).collect(), small_documents())
    # Later holders and lines too short for edits are there.
    assert len(held) > len({line for _, line in held}) and any(len(line) < lines.MIN_CHARS for _, line in held)
    frame = odd_documents(spark)
    check_members(lines.line_members(frame).collect(), pairs_of(frame))
    assert lines.line_members(no_documents(spark)).count() == 0


def test_repeated_short_lines_are_taken_out_of_the_pipeline(spark):
    import corpus_pipeline

    rows = [(2, "Les.\n\n other\nLes"), (1, "Les. \nmore\nmore\n"), (None, "Les"), (3, None)]
    frame = spark.createDataFrame(rows, "doc_id BIGINT, text STRING")
    got = {r.doc_id: r.text for r in corpus_pipeline.line_dedup(spark, frame, SMALL).collect()}
    assert got == {2: "\n other\nLes", 1: "Les. \nmore\n", None: "", 3: None}
