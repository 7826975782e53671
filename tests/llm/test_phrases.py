import re
from collections import Counter

import pyarrow.parquet as pq
import pytest

from prefloom.llm import phrases
from prefloom.llm.common import STEP_BYTES
from tests.llm.helpers import SMALL, no_documents, odd_documents


def lowered(text):
    return re.sub("[A-Z]", lambda m: m.group().lower(), text)


def brute(documents, longest=5, support=100, top=2000):
    counts, totals = {}, Counter()
    for text, lang in documents:
        lang = "und" if lang is None else lang
        held = counts.setdefault(lang, Counter())
        for piece in re.split(r"[.,;:!?\x0A-\x0D]", lowered(text or "")):
            words = re.findall(r"[^\x20\x09]+", piece)
            totals[lang] += len(words)
            for n in range(1, longest + 1):
                held.update(tuple(words[i : i + n]) for i in range(len(words) - n + 1))
    rows = []
    for lang, held in counts.items():
        found = {p: a for p, a in held.items() if len(p) > 1 and a >= support}
        inside = set()
        for q, f in found.items():
            for n in range(2, len(q)):
                for i in range(len(q) - n + 1):
                    if f >= found[q[i : i + n]]:
                        inside.add(q[i : i + n])
        listed = []
        for p, a in found.items():
            if p not in inside:
                cuts = [(1000 * a * totals[lang] // (held[p[:k]] * held[p[k:]]), k) for k in range(1, len(p))]
                score, k = min(cuts)
                listed.append((-score, -a, " ".join(p).encode(), held[p[:k]], held[p[k:]]))
        for rank, (score, a, phrase, l, r) in enumerate(sorted(listed)[:top], 1):
            rows.append((lang, rank, phrase.decode(), -a, l, r, totals[lang], -score))
    return sorted(rows)


def rows(frame):
    return sorted(map(tuple, frame.collect()))


def test_query_11_equals_brute_force(spark):
    table = pq.read_table(f"{SMALL}/documents.parquet", columns=["text", "lang"])
    want = brute(list(zip(table["text"].to_pylist(), table["lang"].to_pylist())))
    got = phrases.op11_phrases(spark, SMALL)
    assert rows(got) == want and len(want) > 20
    assert got.columns == ["lang", "rank", "phrase", "a", "l", "r", "n", "score"]


@pytest.mark.parametrize("chunk_words,support,top", [(2, 3, 10**6), (10**6, 2, 40)])
def test_any_parse_gives_the_same_counts(spark, chunk_words, support, top):
    texts = ["A b c d e f a b c d e", "a b c, d e f a b\tc d e f g", "the the the the the the the the", "x.y;z A B C D E F", ". ! a b"]
    texts = [(f"{text} {n % 3}é", ["en", None, "fr"][n % 3]) for n, text in enumerate(texts * 7)]
    frame = spark.createDataFrame([(n, *row) for n, row in enumerate(texts)], "hash BIGINT, text STRING, lang STRING")
    got = phrases.phrases(frame, support=support, top=top, chunk_words=chunk_words)
    assert rows(got) == brute(texts, support=support, top=top)


def test_dictionary_holds_repeats_once(spark):
    passage = " ".join(f"w{i * i % 1009}" for i in range(800))
    rows = [(f"start{n} {passage} end{n}", "en") for n in range(50)]
    frame = spark.createDataFrame(rows, "text STRING, lang STRING")
    found = phrases.parse(frame, 0, 16).collect()
    assert sum(r.own * r.uses for r in found) == 50 * 802
    # Only the chunks at both ends differ.
    assert sum(r.own for r in found) < 50 * 802 / 4


def test_odd_rows(spark):
    frame = odd_documents(spark)
    want = brute([(r.text, r.lang) for r in frame.collect()], support=2)
    assert rows(phrases.phrases(frame, support=2)) == want and want
    assert phrases.phrases(no_documents(spark)).count() == 0


def test_texts_of_several_steps_are_all_read(spark):
    # Rows without nulls in one partition, more bytes than one vectorised step takes.
    texts = [(f"{'x' * (STEP_BYTES // 3)}{n % 4} One Two, two THREE Four. One two three\nÉa é{n % 2}", "en" if n % 2 else "de") for n in range(12)]
    frame = spark.createDataFrame(texts, "text STRING, lang STRING").coalesce(1)
    want = brute(texts, support=2)
    assert rows(phrases.phrases(frame, support=2)) == want and {row[0] for row in want} == {"de", "en"}


def test_longer_phrases_are_counted_in_one_pass(spark, monkeypatch):
    # Every n-gram is frequent: a pass for each length would make three rows for most words.
    text = " ".join(f"w{n}" for n in range(300))
    texts = [(text, "en"), (text, "fr"), ("a b c d e, f g h. i j a b c", "en")] * 2
    frame = spark.createDataFrame(texts, "text STRING, lang STRING")
    asked, filter_of = [], phrases.filter_of

    def noted(frequent, length):
        asked.append((length, filter_of(frequent, length)))
        return asked[-1][1]

    monkeypatch.setattr(phrases, "filter_of", noted)
    assert rows(phrases.phrases(frame, support=2)) == brute(texts, support=2)
    assert [length for length, _ in asked] == [1, 2]
    dictionary = phrases.parse(frame, 0)
    made = phrases.starts(dictionary, 3, asked[1][1], 5).collect()
    # One row for each place that two more words follow in its piece, and none for another one.
    assert len(made) == 298 + 298 + 3 + 1 + 3
    assert sum(r.n for r in made) == 2 * (298 + 298 + 3 + 1 + 3)


def test_counts_of_several_lengths(spark):
    texts = ["a b c d e f a b c d", "b c d x b c d", "c d, e f a b c"]
    frame = spark.createDataFrame([(text, "en") for text in texts], "text STRING, lang STRING")
    dictionary = phrases.parse(frame, 0, 2)
    pairs = phrases.grams(dictionary, 2).where("n >= 2")
    names = {r.hash: r.word for r in phrases.vocabulary(frame, 0).collect()}
    want, often = Counter(), Counter()
    for n in range(2, 6):
        for words in [piece.split() for text in texts for piece in text.split(",")]:
            often.update(tuple(words[i : i + n]) for i in range(len(words) - n + 1))
    for key, n in often.items():
        if len(key) > 2 and all(often[key[i : i + 2]] > 1 for i in range(len(key) - 1)):
            want[key] = n
    found = phrases.grams(dictionary, 3, phrases.filter_of(pairs, 2), 5).collect()
    got = {tuple(names[x] for x in r[1:-1] if x): r.n for r in found}
    assert got == want and len(got) == len(found) and max(map(len, got)) == 5
