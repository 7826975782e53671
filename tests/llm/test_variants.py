import re
import zlib
from collections import Counter

import pytest

from prefloom.llm import variants
from tests.llm.helpers import SMALL, no_documents, odd_documents, pairs_of, small_documents

LETTERS = "abcdefghijklmnopqrstuvwxyz" + "".join(map(chr, range(0xC0, 0x100)))


def neighbours(word):
    for i in range(len(word) + 1):
        for c in LETTERS:
            yield word[:i] + c + word[i:]
            if i < len(word):
                yield word[:i] + c + word[i + 1 :]
        if i < len(word):
            yield word[:i] + word[i + 1 :]


def brute(documents, least_chars=6, least_count=5, times=5, dropped=199):
    counts = Counter()
    for doc_id, text in documents:
        for run in re.findall("[A-Za-zÀ-ÿ]+", text):
            run = re.sub("[A-Z]", lambda m: m.group().lower(), run)
            h = zlib.crc32(f"{'' if doc_id is None else doc_id}:{run}".encode())
            if h % dropped == 0:
                run = run[: h % len(run)] + run[h % len(run) + 1 :]
            counts[run] += 1
    words = {w: n for w, n in counts.items() if len(w) >= least_chars and n >= least_count}
    near = {w: {x for x in neighbours(w) if x in words and x != w} for w in words}
    form = {}
    for w, n in words.items():
        best = min(near[w], key=lambda x: (-words[x], x), default=None)
        form[w] = best if best and words[best] >= times * n else None
    rows = []
    for w, n in words.items():
        root = w
        while form[root]:
            root = form[root]
        rows.append((w, form[w], root, n, len(near[w]), form[w] and words[form[w]]))
    return sorted(rows)


def rows(frame):
    return sorted(map(tuple, frame.collect()))


def test_query_12_equals_brute_force(spark):
    want = brute(small_documents())
    got = variants.op12_variants(spark, SMALL)
    assert rows(got) == want and got.columns == ["word", "form", "root", "n", "n_near", "form_n"]
    assert any(r[1] for r in want) and sum(r[4] for r in want) > 50


@pytest.mark.parametrize("least_chars,dropped,times", [(1, 3, 2), (2, 10**6, 3), (3, 7, 5)])
def test_dense_words(spark, least_chars, dropped, times):
    import random

    dice = random.Random(least_chars)
    texts = [
        (n, " ".join("".join(dice.choices("aAbé", [8, 1, 2, 1], k=dice.randrange(1, 7))) for _ in range(60)) + " ÀÿA×b÷c ß-ẞ")
        for n in range(40)
    ]
    # A chain of forms.
    texts += [(100 + i, " ".join(["zz" + "z" * i] * 3**i)) for i in range(6)]
    frame = spark.createDataFrame(texts, "doc_id BIGINT, text STRING")
    want = brute(texts, least_chars, 2, times, dropped)
    got = rows(variants.variants(frame, least_chars, 2, times, dropped))
    assert got == want
    assert any(r[1] and r[2] != r[1] for r in want)


def test_odd_rows(spark):
    frame = odd_documents(spark)
    want = brute(pairs_of(frame), least_chars=3, least_count=1)
    assert rows(variants.variants(frame, least_chars=3, least_count=1)) == want and want
    assert variants.variants(no_documents(spark)).count() == 0
    with pytest.raises(ValueError):
        variants.variants(frame, times=1)
