"""Document fingerprints from modular prefix polynomial hashes.

The prefix array of a text answers whether any two spans are equal in constant time, and a binary
search over it finds how far two texts agree from any two places, forward or backward.
"""

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import functions as F

from prefloom.llm.common import documents, steps, texts_of

# Two primes below 2**31, so that a product of residues fits 62 bits, and a base for each.
PRIMES = (2147483647, 2147483629)
BASES = (1103515877, 1390208809)
# Likeness beyond a common start and end counts what lies in common windows of so many characters.
WINDOW = 24
BLOCKS_PER_PARTITION = 4
_LOWEST = -(2**63)

_powers = [np.ones(1, dtype=np.uint64) for _ in PRIMES]


def powers(which, count):
    """At least `count` powers of one base; the table doubles as longer texts come."""
    table, prime = _powers[which], np.uint64(PRIMES[which])
    while len(table) < count:
        step = np.uint64(int(table[-1]) * BASES[which] % PRIMES[which])
        table = np.concatenate([table, table * step % prime])
    _powers[which] = table
    return table


def _covered(places, length, width):
    """How many of `length` characters lie in one of the windows that begin at the places."""
    change = np.zeros(length + 1, dtype=np.int64)
    change[places] += 1
    change[places + width] -= 1
    return int(np.count_nonzero(np.cumsum(change) > 0))


class PrefixHashes:
    """Prefix hashes of one text over its code points."""

    def __init__(self, text):
        points = np.frombuffer(text.encode("utf-32-le"), dtype="<u4").astype(np.uint64) + np.uint64(1)
        self.length = n = len(points)
        self.prefixes = []
        for which, prime in enumerate(PRIMES):
            terms = points * powers(which, n)[:n] % np.uint64(prime)
            sums = np.zeros(n + 1, dtype=np.uint64)
            np.cumsum(terms, out=sums[1:])
            self.prefixes.append(sums % np.uint64(prime))

    def span(self, start, length, shift, which=0):
        """Hash of a span, moved up to the power `shift`; shift must reach every compared start."""
        prefix, prime = self.prefixes[which], PRIMES[which]
        inside = (int(prefix[start + length]) - int(prefix[start])) % prime
        return inside * int(powers(which, shift - start + 1)[shift - start]) % prime

    def same(self, start, other, other_start, length):
        shift = max(start, other_start)
        return all(
            self.span(start, length, shift, which) == other.span(other_start, length, shift, which)
            for which in range(len(PRIMES))
        )

    def extension(self, start, other, other_start):
        """How many characters agree from two places on."""
        low, high = 0, min(self.length - start, other.length - other_start)
        while low < high:
            middle = (low + high + 1) // 2
            low, high = (middle, high) if self.same(start, other, other_start, middle) else (low, middle - 1)
        return low

    def extension_back(self, end, other, other_end):
        """How many characters agree before two places."""
        low, high = 0, min(end, other_end)
        while low < high:
            middle = (low + high + 1) // 2
            equal = self.same(end - middle, other, other_end - middle, middle)
            low, high = (middle, high) if equal else (low, middle - 1)
        return low

    def windows(self, starts, length, shift, which=0):
        """Hashes of the spans at many places, moved up to the power `shift`."""
        prime, prefix = np.uint64(PRIMES[which]), self.prefixes[which]
        inside = (prefix[starts + length] + prime - prefix[starts]) % prime
        return inside * powers(which, shift + 1)[shift - starts] % prime

    def fingerprint(self):
        """Two residues of the whole text and its length: equal for equal texts."""
        return f"{int(self.prefixes[0][-1]):08x}{int(self.prefixes[1][-1]):08x}-{self.length:x}"

    def likeness(self, other, width=WINDOW):
        """Share of the longer text that agrees, from 0 to 1.

        A character agrees if it lies in the common start, in the common end or, between them, in
        any window of `width` characters that stands anywhere between them in the other text, too.
        The text in which fewer characters agree counts. Two empty texts are alike.
        """
        longest = max(self.length, other.length)
        if longest == 0:
            return 1.0
        shorter = min(self.length, other.length)
        head = self.extension(0, other, 0)
        tail = min(self.extension_back(self.length, other, other.length), shorter - head)
        return (head + tail + self._shared(other, head, tail, width)) / longest

    def _shared(self, other, head, tail, width):
        """Characters between both ends that lie in common windows, in the text that has fewer."""
        shift = max(self.length, other.length)
        texts = [x for x in (self, other) if x.length - head - tail >= width]
        if len(texts) < 2:
            return 0
        starts = [np.arange(head, x.length - tail - width + 1) for x in texts]
        hashes = [x.windows(at, width, shift) for x, at in zip(texts, starts)]
        # Most windows of unlike texts are told apart by a table of low bits; the rest by both hashes.
        mask = np.uint64((1 << (8 * max(map(len, hashes))).bit_length()) - 1)
        slots = [h & mask for h in hashes]
        tables = [np.zeros(int(mask) + 1, dtype=bool) for _ in texts]
        for table, slot in zip(tables, slots):
            table[slot] = True
        maybe = [np.flatnonzero(table[slot]) for table, slot in zip(tables[::-1], slots)]
        keys = [
            h[place] << np.uint64(31) | x.windows(at[place], width, shift, 1)
            for x, at, h, place in zip(texts, starts, hashes, maybe)
        ]
        found = [place[np.isin(key, against)] for place, key, against in zip(maybe, keys, keys[::-1])]
        return min(_covered(place, len(h) + width - 1, width) for place, h in zip(found, hashes))


def fingerprints(frame, id_column="doc_id", text_column="text"):
    """doc_id, n_chars and fingerprint of every row, where it is read. Null counts as empty."""

    def run(batches):
        for batch in steps(batches):
            found = [PrefixHashes(text) for text in texts_of(batch).to_numpy(zero_copy_only=False)]
            yield pa.RecordBatch.from_arrays(
                [
                    batch.column("doc_id"),
                    pa.array([x.length for x in found], pa.int64()),
                    pa.array([x.fingerprint() for x in found], pa.string()),
                ],
                ["doc_id", "n_chars", "fingerprint"],
            )

    rows = frame.selectExpr(f"CAST(`{id_column}` AS BIGINT) AS doc_id", f"CAST(`{text_column}` AS STRING) AS text")
    return rows.mapInArrow(run, "doc_id BIGINT, n_chars BIGINT, fingerprint STRING")


def with_next(frame, key, tie):
    """Rows in blocks of falling `key`, each block followed by the first row of the next one.

    Blocks have about equally many rows; their bounds are quantiles of the key and the one row that
    follows each block is known from the keys alone, so texts are shuffled once. Adds the columns
    `_block` and `_follows`; sort by (`_block`, `_follows`, key falling, tie).
    """
    session = frame.sparkSession
    partitions = int(session.conf.get("spark.sql.shuffle.partitions"))
    count = partitions * BLOCKS_PER_PARTITION
    bounds = frame.stat.approxQuantile(key, [i / count for i in range(1, count)], 0.25 / count)
    bounds = np.unique(np.array(bounds, dtype=np.float64))

    @F.pandas_udf("long")
    def block_of(keys: pd.Series) -> pd.Series:
        return pd.Series(np.searchsorted(bounds, keys.to_numpy(dtype=np.float64), side="right"))

    keyed = frame.withColumn("_block", block_of(F.col(key)))
    # One row per block: as many as the shuffle has partitions, times a constant.
    heads = keyed.groupBy("_block").agg(F.max(key).alias("head")).orderBy(F.desc("_block")).collect()
    follows = {heads[i].head: heads[i - 1]["_block"] for i in range(len(heads))}
    if not follows:
        return keyed.withColumn("_follows", F.lit(0)), partitions

    @F.pandas_udf("long")
    def followed_by(keys: pd.Series) -> pd.Series:
        return keys.map(follows).astype("Int64")

    copies = F.array(
        F.struct(F.col("_block").alias("block"), F.lit(0).alias("follows")),
        F.struct(followed_by(F.col(key)).alias("block"), F.lit(1).alias("follows")),
    )
    return (
        keyed.withColumn("_copy", F.explode(F.filter(copies, lambda c: c["block"].isNotNull())))
        .withColumns({"_block": F.col("_copy.block"), "_follows": F.col("_copy.follows")})
        .drop("_copy"),
        partitions,
    )


def edited_with_next(frame, id_column="doc_id", text_column="text"):
    """Every text beside an edit of it: its last half replaced by the start of the next document.

    The next document is the next one by falling id; after the last comes the first. A null id
    counts as the lowest. Rows of equal id follow each other in the order of their texts; equal
    rows are documents of their own. A null text counts as empty, an only document follows itself.
    Other columns are left out. Texts are shuffled once, into blocks of ids, and streamed there: a
    task holds two texts.
    """
    rows = frame.selectExpr(
        f"CAST(`{id_column}` AS BIGINT) AS doc_id", f"coalesce(CAST(`{text_column}` AS STRING), '') AS text"
    ).withColumn("_key", F.coalesce("doc_id", F.lit(_LOWEST)))
    blocked, partitions = with_next(rows, "_key", "text")
    ordered = blocked.repartition(partitions, "_block").sortWithinPartitions(
        "_block", "_follows", F.desc("_key"), "text"
    )

    def run(batches):
        held, block, closed = None, None, False
        for batch in steps(batches):
            out = []
            columns = [batch.column(name).to_pylist() for name in ("doc_id", "text", "_block", "_follows")]
            for doc_id, text, number, follows in zip(*columns):
                if number != block:
                    held, block, closed = None, number, False
                if closed:
                    continue
                hashes = PrefixHashes(text)
                if held is not None:
                    out.append(_edit(*held, text, hashes))
                held, closed = (doc_id, text, hashes), bool(follows)
            yield _edits(out)

    return ordered.select("doc_id", "text", "_block", "_follows").mapInArrow(
        run,
        "doc_id BIGINT, n_chars BIGINT, edited STRING, fingerprint STRING, edited_fingerprint STRING, "
        "near_edited DOUBLE, near_next DOUBLE",
    )


def _edit(doc_id, text, hashes, following, following_hashes):
    n = hashes.length
    edited = text[: n - n // 2] + following[: n // 2]
    changed = PrefixHashes(edited)
    return (
        doc_id,
        n,
        edited,
        hashes.fingerprint(),
        changed.fingerprint(),
        hashes.likeness(changed),
        hashes.likeness(following_hashes),
    )


def _edits(rows):
    kinds = [pa.int64(), pa.int64(), pa.string(), pa.string(), pa.string(), pa.float64(), pa.float64()]
    names = ["doc_id", "n_chars", "edited", "fingerprint", "edited_fingerprint", "near_edited", "near_next"]
    columns = zip(*rows) if rows else [[]] * len(kinds)
    return pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(columns, kinds)], names)


def op1_fingerprints(spark, folder):
    edits = edited_with_next(documents(spark, folder))
    return edits.withColumn("edited_sha256", F.sha2("edited", 256)).drop("edited")
