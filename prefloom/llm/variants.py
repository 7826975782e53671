"""Spelling variants by a dictionary of trie-node pairs.

All prefixes of the words are the nodes of a forward trie, all suffixes those of a reversed one; both
are numbered. A word with one place skipped is a pair of integers: the node of what stands before
the place and the node of what follows. Words that differ in one code point share such a pair; a word
that lacks a code point of another has the pair with nothing skipped. Joins on pairs thus give
exact neighbours: a pair has at most one whole word, and as many skipping ones as there are letters.
"""

import re
import zlib
from collections import Counter

import pyarrow as pa
from pyspark.sql import functions as F

from prefloom.llm.common import documents, steps, stored, texts_of

# Fixed values of the contract: what a word is made of, and which runs lose a letter.
_RUN = re.compile("[A-Za-zÀ-ÿ]+")
_LOWER = str.maketrans({chr(c): chr(c + 32) for c in range(ord("A"), ord("Z") + 1)})
DROPPED = 199
LEAST_CHARS, LEAST_COUNT, TIMES = 6, 5, 5


def lowered(text):
    return text.lower() if text.isascii() else text.translate(_LOWER)


def spelled(doc_id, run, dropped=DROPPED):
    """A lower-cased run as it is counted: some, by a checksum of document and run, lose a code point."""
    check = zlib.crc32(f"{doc_id}:{run}".encode())
    if check % dropped:
        return run
    at = check % len(run)
    return run[:at] + run[at + 1 :]


def counted_words(frame, least_chars=LEAST_CHARS, dropped=DROPPED, id_column="doc_id", text_column="text"):
    """(word, n): how often each word of enough code points occurs. A null id reads as an empty one."""

    def run(batches):
        for batch in steps(batches):
            counts = Counter()
            for doc_id, text in zip(batch.column("doc_id").to_pylist(), texts_of(batch).to_pylist()):
                name = "" if doc_id is None else doc_id
                for found, n in Counter(_RUN.findall(lowered(text))).items():
                    if len(found) >= least_chars:
                        counts[spelled(name, found, dropped)] += n
            held = [(word, n) for word, n in counts.items() if len(word) >= least_chars]
            words, n = zip(*held) if held else ((), ())
            yield pa.RecordBatch.from_arrays([pa.array(words, pa.string()), pa.array(n, pa.int64())], ["word", "n"])

    rows = frame.selectExpr(f"CAST(`{id_column}` AS BIGINT) AS doc_id", f"CAST(`{text_column}` AS STRING) AS text")
    return rows.mapInArrow(run, "word STRING, n BIGINT").groupBy("word").agg(F.sum("n").alias("n"))


def trie_nodes(spark, words):
    """(word, n, letters, before, behind): every word with the numbers of its nodes.

    before[i] is the forward node of its first i letters, behind[i] the reversed node of all letters
    from i on. Numbers are given once to the stored distinct strings, so a task that runs anew
    reads the same ones.
    """
    size = F.char_length("word")
    places = words.select("word", "n", F.posexplode(F.sequence(F.lit(0), size)).alias("at", "_")).select(
        "word", "n", "at",
        F.substring("word", F.lit(1), F.col("at")).alias("head"),
        F.substring("word", F.col("at") + 1, size).alias("tail"),
    )
    places = stored(spark, places)

    def numbered(column, name):
        nodes = stored(spark, places.select(column).distinct()).withColumn(name, F.monotonically_increasing_id())
        return stored(spark, nodes)

    joined = places.join(numbered("head", "before"), "head").join(numbered("tail", "behind"), "tail")
    nodes = joined.groupBy("word", "n").agg(F.array_sort(F.collect_list(F.struct("at", "before", "behind"))).alias("x"))
    return nodes.select("word", "n", F.col("x.before").alias("before"), F.col("x.behind").alias("behind"))


def near_words(spark, words):
    """(word, n, near, near_n): all pairs of words that differ by exactly one edit, in both directions."""
    nodes = stored(spark, trie_nodes(spark, words))
    size = F.char_length("word")
    at = F.posexplode(F.sequence(F.lit(0), size)).alias("at", "_")
    places = nodes.select("word", "n", "before", "behind", at)
    place = F.col("at")
    skipped = places.where(place < size).select(
        "word", "n", "at", F.get("before", place).alias("p"), F.get("behind", place + 1).alias("s")
    )
    whole = places.select(
        F.col("word").alias("near"), F.col("n").alias("near_n"), F.get("before", place).alias("p"), F.get("behind", place).alias("s")
    )
    other = skipped.select(F.col("word").alias("near"), F.col("n").alias("near_n"), "p", "s")
    replaced = skipped.join(other, ["p", "s"]).where("word <> near").select("word", "n", "near", "near_n")
    # Of a run of equal letters the first stands for all: leaving out any of them gives the same word.
    letter = F.substring("word", place + 1, F.lit(1))
    first = skipped.where((place == 0) | (letter != F.substring("word", F.greatest(place, F.lit(1)), F.lit(1))))
    shorter = stored(spark, first.join(whole, ["p", "s"]).select("word", "n", "near", "near_n"))
    longer = shorter.select(F.col("near").alias("word"), F.col("near_n").alias("n"), F.col("word").alias("near"), F.col("n").alias("near_n"))
    return replaced.unionAll(shorter).unionAll(longer)


def roots(spark, forms):
    """(word, root): where following forms ends. A form occurs several times as often as its word, so
    chains are logarithmic in the largest count and a few doublings reach every end."""
    reached = stored(spark, forms.select("word", F.col("form").alias("root")))
    while True:
        ahead = reached.select(F.col("word").alias("root"), F.col("root").alias("next"))
        moved = stored(spark, reached.join(ahead, "root", "left").select("word", F.coalesce("next", "root").alias("root"), "next"))
        if moved.where("next IS NOT NULL").isEmpty():
            return moved.select("word", "root")
        reached = moved.select("word", "root")


def variants(frame, least_chars=LEAST_CHARS, least_count=LEAST_COUNT, times=TIMES, dropped=DROPPED, **columns):
    """word, form, root, n, n_near and form_n of every word that is long and frequent enough.

    A word's form is its most frequent near word (ties: smallest in code-point order) if that occurs
    at least `times` as often, which has to be more than once; root follows forms to the last. Null
    texts have no words; repeated rows count as often as they are there; other columns are left out.
    """
    if times <= 1:
        raise ValueError("a form has to be more frequent than its word")
    spark = frame.sparkSession
    counted = counted_words(frame, least_chars, dropped, **columns)
    words = stored(spark, counted.where(F.col("n") >= least_count))
    best = near_words(spark, words).groupBy("word", "n").agg(
        F.count("*").alias("n_near"), F.min(F.struct((-F.col("near_n")).alias("rarity"), "near")).alias("best")
    )
    most = -F.col("best.rarity")
    taken = most >= times * F.col("n")
    best = stored(
        spark,
        best.select("word", "n_near", F.when(taken, F.col("best.near")).alias("form"), F.when(taken, most).alias("form_n")),
    )
    ends = roots(spark, best.where("form IS NOT NULL"))
    return words.join(best, "word", "left").join(ends, "word", "left").select(
        "word", "form", F.coalesce("root", "word").alias("root"), "n",
        F.coalesce("n_near", F.lit(0)).cast("bigint").alias("n_near"), "form_n",
    )


def op12_variants(spark, folder):
    return variants(documents(spark, folder))
