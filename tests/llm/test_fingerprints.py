import hashlib

import numpy as np
from hypothesis import given, settings
from hypothesis import strategies as st

from prefloom.llm import fingerprints as fp
from tests.llm.helpers import SMALL, no_documents, odd_documents, small_documents

TEXT = st.text(alphabet="ab日", max_size=40)


@settings(max_examples=300, deadline=None)
@given(TEXT, TEXT, st.integers(0, 40), st.integers(0, 40))
def test_extensions_equal_brute_force(a, b, i, j):
    i, j = min(i, len(a)), min(j, len(b))
    x, y = fp.PrefixHashes(a), fp.PrefixHashes(b)
    n = 0
    while i + n < len(a) and j + n < len(b) and a[i + n] == b[j + n]:
        n += 1
    assert x.extension(i, y, j) == n
    n = 0
    while n < min(i, j) and a[i - 1 - n] == b[j - 1 - n]:
        n += 1
    assert x.extension_back(i, y, j) == n
    assert (x.fingerprint() == y.fingerprint()) == (a == b)
    assert 0 <= x.likeness(y) <= 1 and (x.likeness(y) == 1 or a != b)


def test_likeness_survives_moved_and_scattered_edits():
    words = [f"w{i * 7919 % 1009}" for i in range(600)]
    edited = [("xx" if i % 60 == 30 else w) for i, w in enumerate(words)]
    a, b = fp.PrefixHashes(" ".join(words)), fp.PrefixHashes(" ".join(edited))
    c = fp.PrefixHashes(" ".join(f"z{i * 31 % 977}" for i in range(600)))
    assert a.likeness(b) > 0.7 and a.likeness(c) < 0.1


def plain_likeness(a, b, width):
    """The share by its definition, from the texts themselves."""
    if not a and not b:
        return 1.0
    short, long = sorted((len(a), len(b)))
    head = 0
    while head < short and a[head] == b[head]:
        head += 1
    tail = 0
    while tail < short - head and a[-1 - tail] == b[-1 - tail]:
        tail += 1
    middles = [x[head : len(x) - tail] for x in (a, b)]
    windows = [{x[i : i + width] for i in range(len(x) - width + 1)} for x in middles]
    counts = []
    for x, others in zip(middles, windows[::-1]):
        inside = {i + k for i in range(len(x) - width + 1) if x[i : i + width] in others for k in range(width)}
        counts.append(len(inside))
    return (head + tail + min(counts)) / long


@settings(max_examples=400, deadline=None)
@given(TEXT, TEXT, st.integers(1, 5))
def test_likeness_equals_brute_force(a, b, width):
    x, y = fp.PrefixHashes(a), fp.PrefixHashes(b)
    assert x.likeness(y, width) == y.likeness(x, width) == plain_likeness(a, b, width)


def test_likeness_looks_at_whole_long_texts():
    dice = np.random.default_rng(5)

    def letters(n):
        return "".join(map(chr, dice.integers(97, 123, n)))

    a, b, passage = letters(1_000_000), letters(900_000), letters(10_000)
    a = a[:300_011] + passage + a[310_011:]
    b = b[:777_777] + passage + b[787_777:]
    x, y = fp.PrefixHashes(a), fp.PrefixHashes(b)
    assert x.likeness(y) == plain_likeness(a, b, fp.WINDOW) and 0.01 <= x.likeness(y) < 0.0101
    # Every 30th character changed: all others lie in windows that both texts have.
    changed = "".join("#" if i % 30 == 29 else c for i, c in enumerate(a))
    assert abs(x.likeness(fp.PrefixHashes(changed)) - 29 / 30) < 1e-4


def brute(documents):
    """Rows in falling order of ids (null lowest), ties by text, each with the next one's text."""
    ordered = sorted(documents, key=lambda x: (-(x[0] if x[0] is not None else -(2**63)), x[1]))
    rows = []
    for (doc_id, text), (_, following) in zip(ordered, ordered[1:] + ordered[:1]):
        n = len(text)
        edited = text[: n - n // 2] + following[: n // 2]
        rows.append((doc_id, n, edited, following, text))
    return rows


def check(rows, documents):
    got = sorted(((r.doc_id, r.n_chars, hashlib.sha256(r.edited.encode()).hexdigest()) for r in rows), key=repr)
    want = brute(documents)
    assert got == sorted(((i, n, hashlib.sha256(e.encode()).hexdigest()) for i, n, e, _, _ in want), key=repr)
    prints = {(r.doc_id, r.n_chars, r.edited): r for r in rows}
    for doc_id, n, edited, following, text in want:
        row, own = prints[doc_id, n, edited], fp.PrefixHashes(text)
        assert (row.fingerprint, row.edited_fingerprint) == (own.fingerprint(), fp.PrefixHashes(edited).fingerprint())


def test_edits_equal_brute_force(spark, conf):
    from prefloom.llm.common import documents

    for partitions in ("1", "5"):
        conf("spark.sql.shuffle.partitions", partitions)
        check(fp.edited_with_next(documents(spark, SMALL)).collect(), small_documents())


def test_query_1_digests(spark):
    rows = fp.op1_fingerprints(spark, SMALL).collect()
    want = {i: hashlib.sha256(e.encode()).hexdigest() for i, _, e, _, _ in brute(small_documents())}
    assert {r.doc_id: r.edited_sha256 for r in rows} == want
    long = [r for r in rows if r.n_chars > 200]
    assert min(r.near_edited for r in long) >= 0.5 and sum(r.near_next < 0.2 for r in long) > 0.9 * len(long)


def test_odd_rows(spark):
    frame = odd_documents(spark)
    documents = [(r.doc_id, r.text or "") for r in frame.select("doc_id", "text").collect()]
    check(fp.edited_with_next(frame).collect(), documents)
    assert fp.edited_with_next(no_documents(spark)).count() == 0
    one = fp.edited_with_next(odd_documents(spark, [(4, "abcd")])).collect()
    assert [r.edited for r in one] == ["abab"] and fp.fingerprints(frame).count() == frame.count()
