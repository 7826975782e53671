"""Phrase collocations by prefix-free parsing: a dictionary of overlapping chunks, counted once each.

A text's words are cut into chunks where the hash of two neighbouring words says so, which depends on
content alone: passages that repeat are cut alike and share chunks. A chunk holds the words up to the
next cut and, as context, the few behind it; an n-gram belongs to the chunk it starts in, so
overlaps count once. Distinct chunks and how often the parse uses them are the dictionary; n-grams are
counted in distinct chunks and weighted. Pairs are counted where both words are frequent. All longer
lengths are counted in one pass: a row holds the words from one place on, as far as they are joined
by frequent pairs, and counts for each length that it begins with.

Words are 64-bit hashes while counting; the hash function is changed until no two words of a
language share a value, so counts are exact.
"""

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import xxhash
from pyspark.sql import Window
from pyspark.sql import functions as F

from prefloom.llm.common import coded, documents, ragged, steps, stored, texts_of, words_of

LONGEST, SUPPORT, TOP = 5, 100, 2000
# A cut follows one pair of words in so many.
CHUNK_WORDS = 64
# Bits of the filter of frequent n-grams that every task gets: 2 MB at any size of the data.
FILTER_BITS = 24
# What ends a piece; the mark that stands for it, which no word can hold.
ENDS, MARK = r"[.,;:!?\n-\r]", "."
UNKNOWN = "und"


def mixed(*columns):
    """A 64-bit mixture of columns of 64-bit numbers."""
    value = np.zeros(len(columns[0]), dtype=np.uint64)
    for column in columns:
        value = (value ^ column.view(np.uint64)) * np.uint64(0x9E3779B97F4A7C15)
        value ^= value >> np.uint64(29)
        value *= np.uint64(0xBF58476D1CE4E5B9)
        value ^= value >> np.uint64(32)
    return value


def _hashed(words, seed):
    """Hashes of an array of words; 0 stands for the end of a piece."""
    distinct, codes = coded(words)
    values = [xxhash.xxh64_intdigest(word, seed) or 1 for word in distinct.cast(pa.large_binary()).to_pylist()]
    hashes = np.array(values, dtype=np.uint64)
    mark = pc.index_in(pa.scalar(MARK, words.type), value_set=distinct).as_py() if len(distinct) else None
    if mark is not None:
        hashes[mark] = 0
    return hashes.view(np.int64)[codes], distinct, hashes.view(np.int64)


def _tokens(batch):
    # Lowered last: Arrow's ascii_lower reads the wrong bytes of an array whose first offset is not 0,
    # as a later slice of a batch has once it is cast; the array that the replacement builds has 0.
    texts = pc.replace_substring_regex(texts_of(batch), ENDS, f" {MARK} ")
    return words_of(pc.ascii_lower(texts))


def _texts(frame, id_column, text_column, lang_column):
    return frame.selectExpr(
        f"CAST(`{text_column}` AS STRING) AS text", f"coalesce(CAST(`{lang_column}` AS STRING), '{UNKNOWN}') AS lang"
    )


def vocabulary(rows, seed):
    """(lang, word, hash): every distinct word of each language."""

    def run(batches):
        for batch in steps(batches):
            words, bounds = _tokens(batch)
            langs, places = coded(batch.column("lang"))
            lang = np.repeat(places, np.diff(bounds))
            _, distinct, hashes = _hashed(words, seed)
            _, codes = coded(words)
            seen = np.unique(lang * max(1, len(distinct)) + codes)
            seen = seen[hashes[seen % max(1, len(distinct))] != 0]
            at = seen % max(1, len(distinct))
            yield pa.RecordBatch.from_arrays(
                [
                    langs.take(pa.array(seen // max(1, len(distinct)))).cast(pa.string()),
                    distinct.take(pa.array(at)).cast(pa.string()),
                    pa.array(hashes[at], pa.int64()),
                ],
                ["lang", "word", "hash"],
            )

    return rows.mapInArrow(run, "lang STRING, word STRING, hash BIGINT").distinct()


def parse(rows, seed, chunk_words=CHUNK_WORDS, longest=LONGEST):
    """(lang, own, chunk, uses): the dictionary. A chunk is the hashes of its words, 8 bytes each;
    the first `own` of them are its own, the others belong to the chunks behind it."""

    def run(batches):
        for batch in steps(batches):
            words, bounds = _tokens(batch)
            hashes = _hashed(words, seed)[0]
            langs = batch.column("lang")
            n = len(hashes)
            follows = np.append(hashes[1:], 0)
            cut = mixed(hashes, follows) % np.uint64(chunk_words) == 0 if n else np.zeros(0, bool)
            cut &= (hashes != 0) & (follows != 0)
            starts = bounds[:-1][np.diff(bounds) > 0]
            cut[starts] = True
            begin = np.flatnonzero(cut)
            text = np.searchsorted(bounds, begin, side="right") - 1
            end = np.append(begin[1:], n)
            last = np.minimum(end + longest - 1, bounds[text + 1]) if len(begin) else end
            sizes = last - begin
            flat = hashes[ragged(begin, sizes)] if len(begin) else hashes
            offsets = np.concatenate([[0], np.cumsum(sizes[: len(begin)])]) * 8
            chunks = pa.LargeBinaryArray.from_buffers(
                pa.large_binary(), len(begin), [None, pa.py_buffer(offsets.astype(np.int64)), pa.py_buffer(np.ascontiguousarray(flat))]
            )
            own = (end - begin)[: len(begin)]
            yield pa.RecordBatch.from_arrays(
                [langs.take(pa.array(text)).cast(pa.string()), pa.array(own, pa.int32()), chunks.cast(pa.binary())],
                ["lang", "own", "chunk"],
            )

    parsed = rows.mapInArrow(run, "lang STRING, own INT, chunk BINARY")
    return parsed.groupBy("lang", "own", "chunk").agg(F.count("*").alias("uses"))


def _marked(filters, lang_hash, columns):
    """Whether n-grams may be frequent: the filter of their length has their bit. None passes all."""
    if filters is None:
        return np.ones(len(lang_hash), dtype=bool)
    bit = (mixed(lang_hash, *columns) >> np.uint64(64 - FILTER_BITS)).astype(np.int64)
    return (filters[bit >> 3] >> (bit & 7).astype(np.uint8)) & 1 == 1


def _lang_hashes(langs):
    return np.array([xxhash.xxh64_intdigest(x or "", 7) for x in langs.to_pylist()], dtype=np.uint64).view(np.int64)


def starts(dictionary, length, shorter=None, longest=None):
    """(lang, w0, w1, ..., n): the n-grams of a length, with the words behind them up to `longest` words.

    At most one row for each word of a chunk. `shorter` is the broadcast filter of frequent n-grams
    that are one word shorter: a row holds all words up to the first of which no such n-gram ends in
    the filter, and rows of fewer than `length` words are left out. 0 stands for no word.
    """
    longest = longest or length
    names = [f"w{i}" for i in range(longest)]

    def run(batches):
        filters = None if shorter is None else np.frombuffer(shorter.value, dtype=np.uint8)
        for batch in steps(batches, "chunk"):
            chunks = batch.column("chunk").cast(pa.large_binary())
            offsets = np.frombuffer(chunks.buffers()[1], dtype=np.int64)[chunks.offset : chunks.offset + len(chunks) + 1]
            data = chunks.buffers()[2]
            flat = np.frombuffer(data, dtype=np.int64, count=offsets[-1] // 8) if data is not None else np.zeros(0, np.int64)
            first, sizes = offsets[:-1] // 8, np.diff(offsets) // 8
            own = np.minimum(batch.column("own").to_numpy(), sizes - length + 1)
            own = np.maximum(own, 0)
            at = ragged(first, own)
            row = np.repeat(np.arange(len(own)), own)
            langs, codes = coded(batch.column("lang"))
            lang = codes[row]
            keys = [flat[at + i] for i in range(length)]
            whole = np.ones(len(at), dtype=bool)
            for key in keys:
                whole &= key != 0
            at, row, lang, keys = at[whole], row[whole], lang[whole], [key[whole] for key in keys]
            hashes = _lang_hashes(langs)[lang] if len(langs) else np.zeros(0, np.int64)
            if filters is not None:
                kept = _marked(filters, hashes, keys[:-1]) & _marked(filters, hashes, keys[1:])
                at, row, lang, hashes, keys = at[kept], row[kept], lang[kept], hashes[kept], [key[kept] for key in keys]
            # The rows whose next word still belongs to them.
            going = np.arange(len(at))
            for i in range(length, longest):
                going = going[at[going] + i < (first + sizes)[row[going]]]
                word = flat[at[going] + i]
                kept = (word != 0) & _marked(filters, hashes[going], [*[key[going] for key in keys[i - length + 2 :]], word])
                going = going[kept]
                keys.append(np.zeros(len(at), np.int64))
                keys[i][going] = word[kept]
            n = batch.column("uses").to_numpy()[row]
            # Equal n-grams stand together after sorting by a mixture of them.
            order = np.argsort(mixed(hashes, *keys), kind="stable") if len(n) else np.zeros(0, np.int64)
            lang, n, keys = lang[order], n[order], [key[order] for key in keys]
            new = np.ones(len(n), dtype=bool)
            if len(n):
                new[1:] = lang[1:] != lang[:-1]
                for key in keys:
                    new[1:] |= key[1:] != key[:-1]
            begin = np.flatnonzero(new)
            total = np.add.reduceat(n, begin) if len(begin) else n
            yield pa.RecordBatch.from_arrays(
                [langs.take(pa.array(lang[begin])).cast(pa.string()), *[pa.array(k[begin]) for k in keys], pa.array(total, pa.int64())],
                ["lang", *names, "n"],
            )

    schema = ", ".join(["lang STRING", *[f"{name} BIGINT" for name in names], "n BIGINT"])
    return dictionary.mapInArrow(run, schema)


def grams(dictionary, length, shorter=None, longest=None):
    """(lang, w0, w1, ..., n): n-grams of `length` to `longest` words and how often all texts hold them.

    Shorter ones end in zeros. `shorter` is as in `starts`: only n-grams all of whose parts of
    `length` - 1 words are in it are counted.
    """
    longest = longest or length
    names = [f"w{i}" for i in range(longest)]
    rows = starts(dictionary, length, shorter, longest)
    if longest > length:
        words = F.lit(length)
        for name in names[length:]:
            words += F.when(F.col(name) != 0, 1).otherwise(0)
        rows = rows.withColumn("words", F.explode(F.sequence(F.lit(length), words)))
        rows = rows.withColumns({name: F.when(F.col("words") > i, F.col(name)).otherwise(0) for i, name in enumerate(names)})
    return rows.groupBy("lang", *names).agg(F.sum("n").alias("n"))


def filter_of(frequent, length):
    """The broadcast filter of a table of frequent n-grams. A fixed number of bits is collected."""
    spark = frequent.sparkSession
    names = [f"w{i}" for i in range(length)]

    def run(batches):
        for batch in batches:
            langs, codes = coded(batch.column("lang"))
            hashes = _lang_hashes(langs)[codes] if len(langs) else np.zeros(0, np.int64)
            bit = mixed(hashes, *[batch.column(name).to_numpy() for name in names]) >> np.uint64(64 - FILTER_BITS)
            yield pa.RecordBatch.from_arrays([pa.array(bit.astype(np.int64))], ["bit"])

    bits = frequent.select("lang", *names).mapInArrow(run, "bit BIGINT")
    inside = F.bit_or(F.call_function("shiftleft", F.lit(1).cast("bigint"), F.col("bit").bitwiseAND(F.lit(63)).cast("int")))
    words = bits.groupBy(F.shiftright("bit", 6).alias("word")).agg(inside.alias("bits"))
    held = np.zeros(1 << FILTER_BITS - 6, dtype=np.int64)
    for row in words.toLocalIterator():  # at most 2 ** (FILTER_BITS - 6) rows
        held[row.word] = row.bits
    return spark.sparkContext.broadcast(held.astype("<i8").tobytes())


def phrases(frame, longest=LONGEST, support=SUPPORT, top=TOP, chunk_words=CHUNK_WORDS,
            id_column="doc_id", text_column="text", lang_column="lang"):
    """Each language's first `top` phrases by score: lang, rank, phrase, a, l, r, n, score.

    Null texts are empty, a null language is 'und'. Phrases of 2 to `longest` words that occur
    `support` times are scored at their weakest cut; those that a longer one always surrounds go.
    Repeated rows count as often as they are there; ids and other columns are not looked at.
    """
    spark = frame.sparkSession
    rows = _texts(frame, id_column, text_column, lang_column)
    seed = 0
    while True:
        words = stored(spark, vocabulary(rows, seed))
        if words.groupBy("lang", "hash").count().where("count > 1").isEmpty():
            break
        seed += 1
    dictionary = stored(spark, parse(rows, seed, chunk_words, longest))
    single = stored(spark, grams(dictionary, 1))
    totals = single.groupBy("lang").agg(F.sum("n").alias("total"))
    frequent = single.where(F.col("n") >= support)
    known = frequent.select("lang", F.array("w0").alias("key"), "n")
    for length, end in [(2, 2), (3, longest)]:
        if length <= longest:
            chosen = filter_of(frequent, length - 1)
            frequent = stored(spark, grams(dictionary, length, chosen, end).where(F.col("n") >= support))
            held = F.array(*[f"w{i}" for i in range(end)])
            known = known.unionAll(frequent.select("lang", F.array_remove(held, F.lit(0).cast("bigint")).alias("key"), "n"))
    known = stored(spark, known)
    candidates = known.where(F.size("key") > 1).select("lang", "key", F.col("n").alias("a"))
    # A longer phrase found as often holds one that is a single word longer and as often, too.
    size = F.size("key")
    longer = candidates.where(size > 2).select(
        "lang", "a", F.explode(F.array(F.slice("key", 1, size - 1), F.slice("key", 2, size - 1))).alias("key")
    )
    free = candidates.join(longer.distinct(), ["lang", "key", "a"], "left_anti")
    cuts = free.withColumn("cut", F.explode(F.sequence(F.lit(1), size - 1)))
    cuts = cuts.withColumns({"left": F.slice("key", 1, F.col("cut")), "right": F.slice("key", F.col("cut") + 1, size - F.col("cut"))})
    left = known.select("lang", F.col("key").alias("left"), F.col("n").alias("l"))
    right = known.select("lang", F.col("key").alias("right"), F.col("n").alias("r"))

    def whole(column):
        return F.col(column).cast("decimal(19,0)")

    weighed = cuts.join(left, ["lang", "left"]).join(right, ["lang", "right"]).join(totals, "lang").withColumn(
        "score", F.call_function("div", (F.col("a") * 1000).cast("decimal(19,0)") * whole("total"), whole("l") * whole("r"))
    )
    weakest = weighed.groupBy("lang", "key").agg(
        F.min(F.struct("score", "cut", "a", "l", "r", F.col("total").alias("n"))).alias("x")
    )
    named = (
        weakest.select("lang", "key", "x", F.posexplode("key").alias("at", "hash"))
        .join(words, ["lang", "hash"])
        .groupBy("lang", "key", "x")
        .agg(F.array_sort(F.collect_list(F.struct("at", "word"))).alias("words"))
        .select("lang", F.array_join("words.word", " ").alias("phrase"), "x.*")
    )
    order = [F.desc("score"), F.desc("a"), F.asc("phrase")]
    # The first of each part of a language, then the first of those.
    part = F.pmod(F.xxhash64("phrase"), F.lit(64))
    near = named.withColumn("part", part).withColumn(
        "rank", F.row_number().over(Window.partitionBy("lang", "part").orderBy(*order))
    ).where(F.col("rank") <= top)
    ranked = near.withColumn("rank", F.row_number().over(Window.partitionBy("lang").orderBy(*order)))
    return ranked.where(F.col("rank") <= top).select(
        "lang", F.col("rank").cast("bigint").alias("rank"), "phrase", "a", "l", "r", "n", "score"
    )


def op11_phrases(spark, folder):
    return phrases(documents(spark, folder))
