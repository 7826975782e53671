import math
from collections import Counter

import numpy as np
import pytest

from prefloom.llm import quality
from tests.llm.helpers import SMALL, no_documents, odd_documents, pairs_of, small_documents


def brute(text):
    words = [w.decode() for w in text.encode().split()]
    lines = [x for x in text.split("\n") if x.encode().split()]
    grams = Counter(zip(words, words[1:], words[2:]))
    inside = {i + k for i in range(len(words) - 2) if grams[tuple(words[i : i + 3])] > 1 for k in range(3)}
    counts = (len(words), sum(map(len, words)), sum(text.count(c) for c in "#*$%&|<>"), len(lines) - len(set(lines)), len(inside))
    return (*counts, counts[0] < 50 or 100 * counts[4] > 50 * counts[0])


def check(rows, documents):
    names = ("doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed")
    got = sorted((tuple(r[name] for name in names) for r in rows), key=repr)
    assert got == sorted(((i, *brute(t)) for i, t in documents), key=repr)
    assert not any(r.kept and r.base_failed for r in rows)


def test_query_6_base_equals_brute_force(spark):
    check(quality.op6_quality_rules(spark, SMALL).collect(), small_documents())


def exact_upper(k, n, error):
    """Clopper-Pearson by bisection on plain binomial sums."""
    low, high = 0.0, 1.0
    for _ in range(60):
        p = (low + high) / 2
        below = math.fsum(math.comb(n, i) * p**i * (1 - p) ** (n - i) for i in range(k + 1))
        low, high = (p, high) if below > error else (low, p)
    return high


@pytest.mark.parametrize("k,n,error", [(0, 10, 0.05), (3, 60, 0.01), (10, 400, 0.002), (0, 1, 0.5)])
def test_bound_is_the_exact_one(k, n, error):
    upper = exact_upper(k, n, error)
    assert quality.bound_holds(k, n, upper + 1e-6, error) and not quality.bound_holds(k, n, upper - 1e-6, error)
    assert not quality.bound_holds(0, 0, 0.5, 0.5)


def levels(text):
    """Least cutoffs, in hundredths, that keep a text."""
    n_words, chars, symbols, repeated, inside, _ = brute(text)
    n_lines = sum(bool(x.split()) for x in text.split("\n"))
    capitals = sum("A" <= c <= "Z" for c in text)
    shares = [symbols / chars, repeated / max(1, n_lines), inside / n_words, capitals / chars]
    return [math.ceil(min(x, 1.0) * 100) for x in shares]


def plain_cutoffs(rows, labels, risk):
    """Cutoffs by stratum, from lists of documents and the exact bound by bisection."""
    passed = {i: levels(text) for i, text, _ in rows if not brute(text)[-1]}
    good, bad = ({i for i, q in labels if q == x and i in passed} for x in (1, 0))
    weight = len(passed) / len(good | bad)
    cutoff, steps = [100] * 4, []
    while True:
        left = [i for i, own in passed.items() if all(x <= c for x, c in zip(own, cutoff))]
        options = []
        for rule in range(4):
            for low in range(cutoff[rule]):
                over = [i for i in left if passed[i][rule] > low]
                gain = 2 * weight * sum(i in bad for i in over) - len(over)
                options.append((round(gain, 6), -rule, low))
        gain, rule, low = max(options)
        if gain <= 0:
            break
        for at in range(cutoff[-rule] - 1, low - 1, -1):
            cutoff[-rule] = at
            steps.append(list(cutoff))
    strata = {lang for i, _, lang in rows if i in good}
    found = {}
    for stratum in strata:
        own = [i for i, _, lang in rows if lang == stratum and i in good]
        found[stratum] = [100] * 4
        for step in steps:
            rejected = sum(any(x > c for x, c in zip(passed[i], step)) for i in own)
            if rejected == len(own) or exact_upper(rejected, len(own), 0.05 / len(strata)) > risk:
                break
            found[stratum] = step
    return found, passed


def planted(n=1200):
    """Documents of three strata: bad ones shout or hold symbols, some good ones do so a little."""
    dice = np.random.default_rng(1)
    rows, labels = [], []
    for i in range(n):
        kind = i % 4
        words = [f"w{i}x{k}" for k in range(60)]
        few = int(dice.integers(0, 3)) if kind or i % 24 else 6
        for k in range(few if kind else int(dice.integers(4, 40))):
            words[k] = words[k] + "##" if i % 8 else words[k].upper() + "ABCD"
        rows.append((i, " ".join(words), ("en", None, "de")[min(2, int(dice.integers(0, 30)) // 14)]))
        if i % 3:
            labels.append((i, 1 if kind else 0))
    return rows, labels


@pytest.mark.parametrize("risk", [0.02, 0.1])
def test_cutoffs_equal_brute_force(spark, risk):
    """Kept is exactly: base passed and every signal within its stratum's cutoff."""
    rows, labels = planted()
    frame = spark.createDataFrame(rows, "doc_id BIGINT, text STRING, lang STRING")
    table = spark.createDataFrame(labels + [(None, 1), (6, None)], "doc_id BIGINT, quality INT")
    got = {r.doc_id: r.kept for r in quality.judge(frame, table, risk=risk).collect()}
    found, passed = plain_cutoffs(rows, labels, risk)
    want = {i: i in passed and all(x <= c for x, c in zip(passed[i], found[lang])) for i, _, lang in rows}
    assert got == want
    # Two strata have labels enough to reject; the third, of a fifteenth of the rows, only at the larger risk.
    assert found["en"] != [100] * 4 and found[None] != [100] * 4
    assert (found["de"] == [100] * 4) == (risk == 0.02)
    kept = quality.without_rejected(frame, table).collect()
    lost = {i for i, _, _ in rows} - {r.doc_id for r in kept}
    assert any(i % 4 == 0 for i in lost) and (risk > 0.02 or sum(i % 4 > 0 for i in lost) <= 0.02 * len(rows))


def test_bound_holds_on_fresh_documents(spark):
    """Good documents that are not labelled are rejected no more often than the risk allows."""
    rows, labels = planted(3000)
    good = [i for i, _, lang in rows if i % 4 and i % 3 == 0 and lang != "de"]
    frame = spark.createDataFrame(rows, "doc_id BIGINT, text STRING, lang STRING")
    table = spark.createDataFrame(labels, "doc_id BIGINT, quality INT")
    got = {r.doc_id: r.kept for r in quality.judge(frame, table).collect()}
    assert sum(not got[i] for i in good) <= 0.02 * len(good)
    assert sum(not got[i] for i in range(0, 3000, 4)) > 1000 * 0.5


def test_copies_of_a_good_document_are_one_piece_of_evidence(spark):
    rows, labels = planted(400)
    one = " ".join(f"v{k}" for k in range(60))
    copies = [(1000 + i, one, "en") for i in range(400)]
    frame = spark.createDataFrame([(i, t, "en") for i, t, _ in rows] + copies, "doc_id BIGINT, text STRING, lang STRING")
    table = spark.createDataFrame(labels + [(i, 1) for i, _, _ in copies], "doc_id BIGINT, quality INT")
    strict = quality.judge(frame, table, risk=0.01).collect()
    assert all(r.kept == (not r.base_failed) for r in strict)


def test_without_labels_only_base_rules_reject(spark):
    frame = odd_documents(spark)
    for labels in ([], [(5, 1), (5, 1)]):
        rows = quality.judge(frame, spark.createDataFrame(labels, "doc_id BIGINT, quality INT")).collect()
        check(rows, pairs_of(frame))
        assert all(r.kept == (not r.base_failed) for r in rows)
    assert quality.judge(no_documents(spark), spark.createDataFrame([], "doc_id BIGINT, quality INT")).count() == 0


def test_rejected_documents_go(spark):
    frame = odd_documents(spark)
    labels = spark.createDataFrame([], "doc_id BIGINT, quality INT")
    kept = {r.doc_id for r in quality.judge(frame, labels).collect() if r.kept}
    got = quality.without_rejected(frame, labels)
    assert got.columns == frame.columns and {r.doc_id for r in got.collect()} == kept
