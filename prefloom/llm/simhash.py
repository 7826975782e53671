"""SimHash near-duplicates: pigeonhole blocks, a join on blocks, and verified distances.

Fingerprints within `DISTANCE` bits agree on at least one of DISTANCE + 1 blocks of bits. Distinct
fingerprints are grouped by each block. A group too large to compare as a whole is split by blocks
of its remaining bits, in which the same argument holds, until few enough bits remain that no
group can be large. A group gives the links that connect it, never all of its pairs.
"""

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import functions as F

from prefloom.llm.common import documents, steps, stored, texts_of, unused
from prefloom.llm.components import components

WORDS, BITS, DISTANCE, SEED = 3, 64, 3, 42
# Groups above it are split; at this many free bits a group cannot have more distinct members.
GROUP, FREE_BITS = 1 << 14, 15


def simhash(text, words=WORDS, seed=SEED):
    """Unsigned fingerprint of a UTF-8 text: majority bits of its shingles' hashes."""
    found = text.lower().split()  # of bytes: lower-cases A-Z and splits at ASCII white space
    if not found:
        return 0
    joined = b" ".join(found)
    width = min(words, len(found))
    ends = np.cumsum(np.fromiter(map(len, found), np.int64, len(found)) + 1)
    starts = ([0] + ends.tolist())[: len(found) - width + 1]
    digest = xxhash.xxh64_intdigest
    hashes = [digest(joined[a:b], seed) for a, b in zip(starts, (ends[width - 1 :] - 1).tolist())]
    return majority(np.array(hashes, dtype="<u8"))


def majority(hashes):
    bits = np.unpackbits(hashes.view(np.uint8).reshape(-1, 8), axis=1, bitorder="little")
    ones = bits.sum(axis=0, dtype=np.int64)
    return int.from_bytes(np.packbits(2 * ones > len(hashes), bitorder="little").tobytes(), "little")


def fingerprints(frame, words=WORDS, id_column="doc_id", text_column="text"):
    """doc_id, a hash of the text (tie) and the fingerprint as a signed bigint (mark), for every row.

    Null and word-less texts have fingerprint 0.
    """

    def run(batches):
        for batch in steps(batches):
            texts = texts_of(batch).cast(pa.large_binary()).to_pylist()
            marks = np.array([simhash(text, words) for text in texts], dtype=np.uint64)
            yield pa.RecordBatch.from_arrays(
                [batch.column("doc_id"), batch.column("tie"), pa.array(marks.view(np.int64), pa.int64())],
                ["doc_id", "tie", "mark"],
            )

    rows = frame.selectExpr(
        f"CAST(`{id_column}` AS BIGINT) AS doc_id",
        f"coalesce(CAST(`{text_column}` AS STRING), '') AS text",
        f"xxhash64(coalesce(CAST(`{text_column}` AS STRING), '')) AS tie",
    )
    return rows.mapInArrow(run, "doc_id BIGINT, tie BIGINT, mark BIGINT")


def _signed(number):
    return number - (1 << 64) if number >> 63 else number


def split_bits(mask, parts):
    """Bit masks of about equal size that cut up a mask."""
    bits = [bit for bit in range(BITS) if mask >> bit & 1]
    cuts = [len(bits) * i // parts for i in range(parts + 1)]
    return [sum(1 << bit for bit in bits[a:b]) for a, b in zip(cuts, cuts[1:])]


def linked(marks, groups, distance=DISTANCE):
    """Places (a, b) that connect all marks within the distance inside each group; rows are sorted by group."""
    n = len(marks)
    label = np.arange(n)
    bounds = np.flatnonzero(np.diff(groups, prepend=groups[:1] - 1)) if n else np.zeros(0, np.int64)
    sizes = np.diff(np.append(bounds, n))
    small = np.repeat(sizes <= 64, sizes)
    for step in range(1, int(sizes[sizes <= 64].max(initial=1))):
        a = np.flatnonzero(small[:-step] & (groups[step:] == groups[:-step]))
        if not len(a):
            break
        a = a[np.bitwise_count(marks[a] ^ marks[a + step]) <= distance]
        label = merge(label, a, a + step)
    for start, size in zip(bounds[sizes > 64], sizes[sizes > 64]):
        own = marks[start : start + size]
        rows = max(1, (1 << 20) // size)
        for at in range(0, size, rows):
            a, b = np.nonzero(np.bitwise_count(own[at : at + rows, None] ^ own[None, at:]) <= distance)
            label = merge(label, start + at + a, start + at + b)
    moved = np.flatnonzero(label != np.arange(n))
    return moved, label[moved]


def merge(label, a, b):
    """Labels after joining places a[i] and b[i]; a label is the lowest place of its set."""
    while len(a):
        la, lb = label[a], label[b]
        apart = la != lb
        if not apart.any():
            break
        a, b, la, lb = a[apart], b[apart], la[apart], lb[apart]
        low, high = np.minimum(la, lb), np.maximum(la, lb)
        np.minimum.at(label, high, low)
        while True:
            jumped = label[label]
            if (jumped == label).all():
                break
            label = jumped
    return label


def links(spark, marks, distance=DISTANCE, group=GROUP, free_bits=FREE_BITS):
    """Links (u, v) among nodes, enough to connect all whose fingerprints are within the distance.

    `marks` has a row per node: node and its fingerprint `mark`, each mark once.
    """
    held = ["node", "mark"]
    blocks, whole = distance + 1, (1 << BITS) - 1
    masks = {0: [(m, whole & ~m) for m in split_bits(whole, blocks)]}
    level = marks.select(*held).withColumn("fixed", F.lit(0).cast("bigint"))
    found = []
    while True:
        # `fixed` is the mask of bits on which a group agrees; its members are split by each block
        # of the other bits.
        finer = F.create_map(
            *[
                part
                for fixed, blocked in masks.items()
                for part in (
                    F.lit(_signed(fixed)).cast("bigint"),
                    F.array(*[F.lit(_signed(fixed | block)).cast("bigint") for block, _ in blocked]),
                )
            ]
        )
        keyed = level.select(*held, F.explode(finer[F.col("fixed")]).alias("fixed")).withColumn(
            "value", F.col("mark").bitwiseAND(F.col("fixed"))
        )
        keyed = keyed.distinct() if found else keyed
        reached = sorted({fixed | block for fixed, blocked in masks.items() for block, _ in blocked})
        if all(BITS - fixed.bit_count() <= free_bits for fixed in reached):
            found.append(_compare(keyed, distance))
            break
        keyed = stored(spark, keyed)
        sizes = keyed.groupBy("fixed", "value").agg(F.count("*").alias("size"))
        hot = stored(spark, sizes.where(F.col("size") > group).select("fixed", "value"))
        if hot.isEmpty():
            found.append(_compare(keyed, distance))
            break
        found.append(_compare(keyed.join(hot, ["fixed", "value"], "left_anti"), distance))
        level = keyed.join(hot, ["fixed", "value"], "left_semi").select(*held, "fixed")
        masks = {fixed: [(m, 0) for m in split_bits(whole & ~fixed, blocks)] for fixed in reached}
    united = found[0]
    for more in found[1:]:
        united = united.unionAll(more)
    return united


def _compare(keyed, distance):
    """Links inside every group. A task holds one batch and the group it ends in."""
    columns = ["fixed", "value", "node", "mark"]

    def run(batches):
        rest = None
        for batch in batches:
            rows = np.stack([batch.column(i).to_numpy(zero_copy_only=False) for i in range(len(columns))])
            rows = rows if rest is None else np.concatenate([rest, rows], axis=1)
            last = (rows[:2] == rows[:2, -1:]).all(axis=0)
            cut = int(np.argmax(last)) if rows.shape[1] else 0
            yield from emit(rows[:, :cut])
            rest = rows[:, cut:]
        if rest is not None:
            yield from emit(rest)

    def emit(rows):
        change = (np.diff(rows[:2], axis=1) != 0).any(axis=0)
        groups = np.concatenate([[0], np.cumsum(change)]) if rows.shape[1] else np.zeros(0, np.int64)
        marks = np.ascontiguousarray(rows[3]).astype(np.int64).view(np.uint64)
        ends = linked(marks, groups, distance)
        yield pa.RecordBatch.from_arrays([pa.array(rows[2][x], pa.int64()) for x in ends], ["u", "v"])

    ordered = keyed.repartition("fixed", "value").sortWithinPartitions("fixed", "value", "node")
    return ordered.select(*columns).mapInArrow(run, "u BIGINT, v BIGINT")


def classes(spark, marked, distance):
    """(mark, component) of every fingerprint: the fingerprints that links reach have one component."""
    marks = stored(spark, marked.select("mark").distinct())
    reached = components(spark, links(spark, marks.select(F.col("mark").alias("node"), "mark"), distance))
    return marks.join(reached, F.col("mark") == F.col("node"), "left").select(
        "mark", F.coalesce("component", "mark").alias("component")
    )


def near_duplicates(frame, words=WORDS, distance=DISTANCE, id_column="doc_id", text_column="text"):
    """doc_id, fingerprint and component of every row.

    The component is the smallest id reachable over links of at most `distance` bits; null ids
    are never smallest unless all are null. Null and word-less texts have fingerprint 0, linked
    like any other. Equal rows each give a row. Other columns are left out.
    """
    spark = frame.sparkSession
    marked = stored(spark, fingerprints(frame, words, id_column, text_column))
    low = marked.groupBy("mark").agg(F.min("doc_id").alias("low"))
    named = stored(spark, classes(spark, marked, distance).join(low, "mark"))
    lowest = named.groupBy("component").agg(F.min("low").alias("component_id"))
    found = named.join(lowest, "component").select("mark", "component_id")
    return marked.join(found, "mark").select(
        "doc_id", F.lpad(F.lower(F.hex("mark")), 16, "0").alias("fingerprint"), "component_id"
    )


def op5_simhash(spark, folder):
    return near_duplicates(documents(spark, folder))


def one_of_each(frame, words=WORDS, distance=DISTANCE):
    """The table with one document of each group of near copies.

    A group is a component of `near_duplicates`, with the same words and distance. Its document of
    the smallest id stays (null last), of equal ids that of the smallest hash of the text, and of
    equal rows one.
    """
    spark = frame.sparkSession
    marked = stored(spark, fingerprints(frame, words))
    order = F.struct(F.col("doc_id").isNull().alias("none"), "doc_id", "tie")
    lowest = marked.groupBy("mark").agg(F.min(order).alias("order"))
    kept = (
        classes(spark, marked, distance).join(lowest, "mark")
        .groupBy("component")
        .agg(F.min("order").alias("order"))
        .select("order.doc_id", "order.tie")
    )
    doc, tie = unused(frame, "doc", "tie")
    text = F.coalesce(F.col("text").cast("string"), F.lit(""))
    keyed = frame.withColumns({doc: F.col("doc_id").cast("bigint"), tie: F.xxhash64(text)})
    same = F.col(f"d.{doc}").eqNullSafe(F.col("k.doc_id")) & (F.col(f"d.{tie}") == F.col("k.tie"))
    # Equal rows are combined before the shuffle.
    return keyed.alias("d").join(kept.alias("k"), same, "left_semi").dropDuplicates([doc, tie]).drop(doc, tie)
