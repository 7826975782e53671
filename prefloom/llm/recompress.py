"""Removal of repeated word windows by recompression.

Rounds of recompression name runs of one symbol and pairs of symbols, everywhere alike, by hashes
of their parts. Whether two symbols are merged depends on nothing but the two of them, so a border
that survives in one copy of a passage survives in every copy, if all that decided about it lies
inside the passage. Every window of words is led by such a border of its highest round, and
windows that a border leads together are one unit. Equal windows thus share the name of what
surrounds their border: names that occur once settle their windows, equal units need only their
first place, and only different units of one name are compared window by window.
"""

import numpy as np
import pyarrow as pa
import xxhash
import zstandard
from pyspark.sql import functions as F

from prefloom.llm.common import coded, documents, steps, stored, texts_of, words_of

WINDOW, ROUNDS = 20, 3
_LOWEST = -(2**63)
_CNT = 1 << 16  # spans are packed as start * _CNT + number of windows

_ODD = (np.uint64(0x9E3779B97F4A7C15), np.uint64(0xD6E8FEB86659FD93))
_INVERSE = tuple(np.uint64(pow(int(b), -1, 1 << 64)) for b in _ODD)


def mix(x):
    """A 64-bit finalizer on arrays."""
    x = (x ^ (x >> np.uint64(32))) * np.uint64(0xD6E8FEB86659FD93)
    x = (x ^ (x >> np.uint64(32))) * np.uint64(0xD6E8FEB86659FD93)
    return x ^ (x >> np.uint64(32))


def _powers(base, count):
    out = np.full(count, base, dtype=np.uint64)
    out[:1] = 1
    return np.multiply.accumulate(out)


class Words:
    """The words of several texts, as hashes, with hashes of any span."""

    def __init__(self, texts):
        words, self.bounds = words_of(texts)
        self.strings = words
        distinct, places = coded(words)
        names = distinct.cast(pa.large_binary()).to_numpy(zero_copy_only=False)
        hashed = np.fromiter(map(xxhash.xxh3_64_intdigest, names), dtype=np.uint64, count=len(names))
        self.hashes = hashed[places]
        self.prefixes, self.back = [], []
        for base, inverse in zip(_ODD, _INVERSE):
            sums = np.zeros(len(words) + 1, dtype=np.uint64)
            np.cumsum(self.hashes * _powers(base, len(words)), out=sums[1:])
            self.prefixes.append(sums)
            self.back.append(_powers(inverse, len(words) + 1))

    def span(self, start, end, which=0):
        """Hashes of the word sequences [start, end)."""
        prefix = self.prefixes[which]
        return mix((prefix[end] - prefix[start]) * self.back[which][start] + (end - start).astype(np.uint64))

    def windows(self, width):
        """First words of all windows of `width` words of one text."""
        counts = np.maximum(np.diff(self.bounds) - width + 1, 0)
        ends = np.cumsum(counts)
        return np.arange(ends[-1] if len(ends) else 0) + np.repeat(self.bounds[:-1] - ends + counts, counts)


def borders(hashes, rounds=ROUNDS):
    """Of each round, the surviving borders as spans of the words that decided on them.

    Runs of one word are named first. A round then merges each pair of a left and a right symbol;
    a bit of a symbol's hash says which of the two it is in that round.
    """
    n = len(hashes)
    symbols = mix(hashes)
    low, high = np.arange(n + 1), np.arange(n + 1)
    found = []
    for turn in range(rounds + 1):
        if len(symbols) < 2:
            break
        if turn == 0:
            merged = symbols[:-1] == symbols[1:]
        else:
            bits = mix(symbols + np.uint64(turn)) & np.uint64(1)
            merged = (bits[:-1] == 0) & (bits[1:] == 1)
        # A border stays for what its two symbols are, so for all that their outer borders needed.
        low[1:-1], high[1:-1] = np.minimum(low[1:-1], low[:-2]), np.maximum(high[1:-1], high[2:])
        # The outer ends have no neighbour, so nothing settles them beyond the words themselves.
        low[0], high[-1] = -1, n + 1
        stays = np.concatenate([[True], ~merged, [True]])
        first = np.flatnonzero(stays[:-1])
        size = np.diff(np.append(first, len(symbols)))
        named, many = symbols[first], size > 1
        joined = size[many].astype(np.uint64) if turn == 0 else symbols[first[many] + 1] * _ODD[1]
        named[many] = mix(named[many] * _ODD[0] + joined)
        symbols, low, high = named, low[stays], high[stays]
        if turn:
            found.append((low[1:-1].copy(), high[1:-1].copy()))
    return found


def lowest(values, start, end):
    """Where the lowest of values[start:end] stands, for many ranges; none may be empty."""
    tables, step = [np.arange(len(values))], 1
    while 2 * step <= int((end - start).max(initial=1)):
        a, b = tables[-1][:-step], tables[-1][step:]
        tables.append(np.where(values[b] < values[a], b, a))
        step *= 2
    size = end - start
    which = np.log2(size).astype(np.int64)
    out = np.empty(len(start), dtype=np.int64)
    for level, table in enumerate(tables):
        own = np.flatnonzero(which == level)
        a, b = table[start[own]], table[end[own] - (1 << level)]
        out[own] = np.where(values[b] < values[a], b, a)
    return out


def units(words, width=WINDOW, rounds=ROUNDS):
    """Windows of each text in units: name, unit hash, first window, number of windows.

    A window is led by one of the borders of the highest round that its own words alone decided
    on, the one of the lowest hash; its name is the hash of the deciding words. A window without
    such a border is a unit of its own, named by itself.
    """
    start = words.windows(width)
    leader = np.full(len(start), -1, dtype=np.int64)
    name = words.span(start, start + width, 1)
    for level, (low, high) in reversed(list(enumerate(borders(words.hashes, rounds)))):
        free = np.flatnonzero(leader < 0)
        first = np.searchsorted(low, start[free])
        end = np.searchsorted(high, start[free] + width, side="right")
        led = first < end
        if not led.any():
            continue
        names = words.span(np.maximum(low, 0), np.minimum(high, len(words.hashes)), 1) + np.uint64(level)
        free, best = free[led], lowest(names, first[led], end[led])
        leader[free] = best * 64 + level
        name[free] = names[best]
    owner = np.searchsorted(words.bounds, start, side="right")
    new = np.ones(len(start), dtype=bool)
    new[1:] = (leader[1:] != leader[:-1]) | (owner[1:] != owner[:-1]) | (leader[1:] < 0)
    first = np.flatnonzero(new)
    count = np.diff(np.append(first, len(start)))
    begin = start[first]
    return name[first], words.span(begin, begin + count + width - 1), begin, count


def _packed(frame, id_column, text_column):
    """doc_id, the key it is ordered by, a tie among texts of one id, and the text, compressed.

    Texts are shuffled as compressed bytes. The tie is needed only if some id has several texts.
    """
    rows = frame.selectExpr(
        f"CAST(`{id_column}` AS BIGINT) AS doc_id",
        f"coalesce(CAST(`{id_column}` AS BIGINT), {_LOWEST}L) AS key",
        f"coalesce(CAST(`{text_column}` AS STRING), '') AS text",
    )
    several = rows.groupBy("key").agg(F.min(F.xxhash64("text")).alias("a"), F.max(F.xxhash64("text")).alias("b"))
    tie = F.lit(0).cast("bigint") if several.where("a <> b").isEmpty() else F.xxhash64("text")
    return rows.withColumn("tie", tie)


def _batch(columns, names):
    return pa.RecordBatch.from_arrays([pa.array(c, pa.int64()) for c in columns], names)


def _signed(x):
    return np.ascontiguousarray(x).view(np.int64)


_UNIT = "name BIGINT, unit BIGINT, key BIGINT, tie BIGINT, span BIGINT"
_UNIT_NAMES = ["name", "unit", "key", "tie", "span"]


def _first_places(name, unit, key, tie, span):
    """Of equal (name, unit) only the first place; the others are marked as repeats."""
    order = np.lexsort((span, tie, key, unit, name))
    name, unit, key, tie, span = (x[order] for x in (name, unit, key, tie, span))
    same = np.zeros(len(name), dtype=bool)
    same[1:] = (name[1:] == name[:-1]) & (unit[1:] == unit[:-1])
    place = np.zeros(len(name), dtype=bool)
    place[1:] = same[1:] & (key[1:] == key[:-1]) & (tie[1:] == tie[:-1]) & (span[1:] == span[:-1])
    return (name, unit, key, tie, span), same, place


def _name_units(rows, width, rounds):
    """A row per unit and distinct content in each step of texts, and one per repeat in it.

    Repeats are known before any shuffle and carry no unit: their unit is null.
    """

    def run(batches):
        for batch in steps(batches):
            words = Words(texts_of(batch))
            name, unit, begin, count = units(words, width, rounds)
            owner = np.searchsorted(words.bounds, begin, side="right") - 1
            key, tie = (batch.column(c).to_numpy(zero_copy_only=False)[owner] for c in ("key", "tie"))
            span = (begin - words.bounds[owner]) * _CNT + count
            columns, same, place = _first_places(_signed(name), _signed(unit), key, tie, span)
            kept = ~place
            columns = [c[kept] for c in columns]
            columns[1] = pa.array(columns[1], pa.int64(), mask=same[kept])
            yield _batch(columns, _UNIT_NAMES)

    return rows.select("key", "tie", "text").mapInArrow(run, _UNIT)


_FOUND = "key BIGINT, tie BIGINT, span BIGINT, repeat BOOLEAN"


def _resolve(named, ask):
    """Repeats of units, and with `ask` the first places of different units of one name.

    Rows come by name and unit in order of place, so a task remembers one row; nothing is gathered.
    """

    def run(batches):
        held = None  # the only unit so far of the name that the rows so far end in
        last = None  # the row before
        for batch in batches:
            unknown = batch.column("unit").is_null().to_numpy(zero_copy_only=False)
            name, unit, key, tie, span = (
                batch.column(i).fill_null(0).to_numpy(zero_copy_only=False) for i in range(5)
            )
            out = [(key[unknown], tie[unknown], span[unknown], True)]
            known = ~unknown
            rows = np.stack([x[known] for x in (name, unit, key, tie, span)])
            n = rows.shape[1]
            if n:
                before = np.concatenate([last if last is not None else rows[:, :1] - 1, rows[:, :-1]], axis=1)
                if last is None:
                    before[0, 0] = rows[0, 0] ^ 1
                same_name = rows[0] == before[0]
                same = same_name & (rows[1] == before[1])
                moved = same & (rows[2:] != before[2:]).any(axis=0)
                out.append((*rows[2:, moved], True))
                last = rows[:, -1:]
                if ask:
                    firsts = np.flatnonzero(~same)
                    several = same_name[firsts]  # a second or later unit of its name
                    asked = several.copy()
                    asked[:-1] |= several[1:]
                    out.append((*rows[2:, firsts[asked]], False))
                    if len(firsts):
                        if several[0] and held is not None:
                            out.append((*held, False))
                        single = not asked[-1]
                        held = rows[2:, firsts[-1:]] if single else None
            columns = [np.concatenate([x[i] for x in out]) for i in range(3)]
            flags = np.concatenate([np.full(len(x[0]), x[3]) for x in out])
            yield pa.RecordBatch.from_arrays(
                [*[pa.array(c.astype(np.int64)) for c in columns], pa.array(flags)], ["key", "tie", "span", "repeat"]
            )

    ordered = named.repartition(F.coalesce("name", "span"), F.when(F.col("unit").isNull(), F.col("span")))
    return ordered.sortWithinPartitions("name", "unit", "key", "tie", "span").mapInArrow(run, _FOUND)


def _window_rows(rows, asked, width):
    """A row per window of the units asked for, as a unit of its own with a second hash as name."""

    def run(batches):
        for batch in steps(batches):
            words = Words(_unpacked(batch))
            spans = batch.column("spans")
            span = spans.flatten().to_numpy(zero_copy_only=False)
            owner = np.repeat(np.arange(batch.num_rows), np.diff(spans.offsets.to_numpy()))
            count = span % _CNT
            start = np.repeat(span // _CNT, count) + np.arange(count.sum()) - np.repeat(np.cumsum(count) - count, count)
            owner = np.repeat(owner, count)
            begin = start + words.bounds[owner]
            name, unit = words.span(begin, begin + width, 1), words.span(begin, begin + width)
            key, tie = (batch.column(c).to_numpy(zero_copy_only=False)[owner] for c in ("key", "tie"))
            columns, same, place = _first_places(_signed(name), _signed(unit), key, tie, start * _CNT + 1)
            columns = [c[~place] for c in columns]
            columns[1] = pa.array(columns[1], pa.int64(), mask=same[~place])
            yield _batch(columns, _UNIT_NAMES)

    # As many spans as a text has units.
    listed = asked.groupBy("key", "tie").agg(F.collect_list("span").alias("spans"))
    joined = _shipped(rows).join(listed, ["key", "tie"])
    return joined.select("key", "tie", "text", "spans").mapInArrow(run, _UNIT)


def _shipped(rows):
    def run(batches):
        for batch in batches:
            compress = zstandard.ZstdCompressor(level=1).compress
            texts = [compress(text) for text in batch.column("text").cast(pa.large_binary()).to_pylist()]
            columns = [batch.column(c) for c in ("doc_id", "key", "tie")]
            yield pa.RecordBatch.from_arrays([*columns, pa.array(texts, pa.binary())], ["doc_id", "key", "tie", "text"])

    return rows.select("doc_id", "key", "tie", "text").mapInArrow(
        run, "doc_id BIGINT, key BIGINT, tie BIGINT, text BINARY"
    )


def _unpacked(batch):
    expand = zstandard.ZstdDecompressor().decompress
    texts = [expand(text) for text in batch.column("text").to_pylist()]
    return pa.array(texts, pa.large_binary()).cast(pa.large_string())


def remove_repeats(frame, width=WINDOW, rounds=ROUNDS, id_column="doc_id", text_column="text"):
    """Every text without the words of windows that also start earlier.

    Earlier is a smaller id, or the same text and an earlier start; a null id comes first, texts
    of one id come in the order of their hashes, and rows equal in id and text are one document
    that is judged once. Windows are judged on the input. Null texts and texts of fewer words than
    a window lose nothing. Returns doc_id, n_words, n_removed and `kept`, the kept words joined by
    spaces, for every row; other columns are left out.
    """
    spark = frame.sparkSession
    rows = _packed(frame, id_column, text_column)
    found = stored(spark, _resolve(_name_units(rows, width, rounds), ask=True))
    repeats = found.where("repeat").select("key", "tie", "span")
    asked = found.where("NOT repeat").select("key", "tie", "span")
    again = stored(spark, _resolve(_window_rows(rows, asked, width), ask=False))
    repeats = repeats.unionAll(again.select("key", "tie", "span"))
    # As many spans as a text has windows.
    spans = repeats.groupBy("key", "tie").agg(F.collect_list("span").alias("spans"))
    joined = _shipped(rows).join(spans, ["key", "tie"], "left").select("doc_id", "text", "spans")

    def run(batches):
        for batch in steps(batches):
            texts = _unpacked(batch)
            removed, kept, counts = [], [], []
            for text, listed in zip(texts.cast(pa.large_binary()).to_pylist(), batch.column("spans")):
                words = text.split()
                gone = np.zeros(len(words) + 1, dtype=np.int64)
                if listed.is_valid:
                    span = listed.values.to_numpy(zero_copy_only=False)
                    np.add.at(gone, span // _CNT, 1)
                    np.add.at(gone, span // _CNT + span % _CNT + width - 1, -1)
                stays = np.cumsum(gone)[:-1] == 0
                counts.append(len(words))
                removed.append(len(words) - int(stays.sum()))
                kept.append(b" ".join(words[i] for i in np.flatnonzero(stays)) if removed[-1] else b" ".join(words))
            yield pa.RecordBatch.from_arrays(
                [
                    batch.column("doc_id"),
                    pa.array(counts, pa.int64()),
                    pa.array(removed, pa.int64()),
                    pa.array(kept, pa.large_binary()).cast(pa.large_string()).cast(pa.string()),
                ],
                ["doc_id", "n_words", "n_removed", "kept"],
            )

    return joined.mapInArrow(run, "doc_id BIGINT, n_words BIGINT, n_removed BIGINT, kept STRING")


def op7_substring_dedup(spark, folder):
    return remove_repeats(documents(spark, folder)).withColumn("kept_sha256", F.sha2("kept", 256)).drop("kept")
