"""Mixing sources to target weights by fixed-length blocks of words.

Each source's documents, in a pseudorandom order, are one long row of words cut into blocks. Every
output shard draws how many of its slots go to each source; a source's slots, counted through the
shards, are mapped to its blocks by a pseudorandom permutation per pass over the source. Slots and
blocks meet in a join on (source, block), whose keys are even however large a source is.
"""

import math
import re

import numpy as np
import pyarrow as pa
from pyspark.sql import Window
from pyspark.sql import functions as F

from prefloom.llm.common import documents, steps, stored, texts_of, unused, words_of
from prefloom.operators.ordering import running_aggregates

# Weights by place of the source, share of all sizes, and passes over a source.
WEIGHTS = (3, 1, 2)
SHARE, PASSES = 1.5, 2
BLOCK_WORDS, SHARD_SLOTS, SEED = 128, 8192, 20_240
# Documents of a source are ordered in buckets of about this many.
BUCKET = 1 << 12
# Shards whose slots one task lists.
TASK_SHARDS = 16

_WORD = re.compile(r"[^\x20\x09-\x0D]+")


def sized(frame, id_column="doc_id", text_column="text", source_column="source"):
    """doc_id, source, size in words and a hash of the text, for every row. Null text: size 0."""

    def run(batches):
        for batch in steps(batches):
            _, bounds = words_of(texts_of(batch))
            yield pa.RecordBatch.from_arrays(
                [batch.column("doc_id"), batch.column("source"), pa.array(np.diff(bounds), pa.int64()), batch.column("tie")],
                ["doc_id", "source", "size", "tie"],
            )

    rows = frame.selectExpr(
        f"CAST(`{id_column}` AS BIGINT) AS doc_id",
        f"CAST(`{text_column}` AS STRING) AS text",
        f"CAST(`{source_column}` AS STRING) AS source",
        f"xxhash64(CAST(`{text_column}` AS STRING)) AS tie",
    )
    return rows.mapInArrow(run, "doc_id BIGINT, source STRING, size BIGINT, tie BIGINT")


def targets(sizes, weights=WEIGHTS, share=SHARE, passes=PASSES):
    """Words to take from each source, given their sizes in code-point order of their names.

    Weighted shares of `share` times all sizes. A source gives at most `passes` times its size;
    what it cannot give is shared among the others by weight, until none is above.
    """
    total = share * sum(sizes)
    weight = [weights[i % len(weights)] for i in range(len(sizes))]
    target, free = [0.0] * len(sizes), set(range(len(sizes)))
    while free:
        scale = (total - sum(target[i] for i in range(len(sizes)) if i not in free)) / sum(weight[i] for i in free)
        above = {i for i in free if scale * weight[i] > passes * sizes[i]}
        for i in free:
            target[i] = passes * float(sizes[i]) if i in above else scale * weight[i]
        if not above:
            break
        free -= above
    return target


def permute(index, size, key):
    """A pseudorandom permutation of 0..size-1 per key: Feistel rounds, walked back into range."""
    index, size, key = (np.asarray(x, dtype=np.uint64) for x in (index, size, key))
    half = np.ceil(np.log2(np.maximum(size, 2).astype(np.float64) + 1) / 2).astype(np.uint64)
    low = (np.uint64(1) << half) - np.uint64(1)
    out = index.copy()
    moving = np.ones(len(out), dtype=bool)
    while moving.any():
        left, right = out[moving] >> half[moving], out[moving] & low[moving]
        for turn in range(4):
            mixed = mix64(right + key[moving] * np.uint64(0x9E3779B97F4A7C15) + np.uint64(turn + 1))
            left, right = right, left ^ (mixed & low[moving])
        out[moving] = (left << half[moving]) | right
        moving[moving] = out[moving] >= size[moving]
    return out.astype(np.int64)


def mix64(x):
    """The finalizer of a 64-bit multiplicative hash."""
    x = (x ^ (x >> np.uint64(33))) * np.uint64(0xFF51AFD7ED558CCD)
    x = (x ^ (x >> np.uint64(33))) * np.uint64(0xC4CEB9FE1A85EC53)
    return x ^ (x >> np.uint64(33))


class Plan:
    """Sizes, targets, blocks and slots of each source: one entry per source, nothing per document."""

    def __init__(self, rows, block_words=BLOCK_WORDS, **options):
        rows = sorted(rows, key=lambda row: (row.source is None, row.source or ""))
        self.sources = [row.source for row in rows]
        self.sizes = [row.size for row in rows]
        self.targets = targets(self.sizes, **options)
        self.blocks = np.array([-(-size // block_words) for size in self.sizes], dtype=np.int64)
        # A source's last block is shorter: slots are counted in its mean block length.
        self.slots = np.array(
            [round(t * b / s) if s else 0 for t, b, s in zip(self.targets, self.blocks, self.sizes)], dtype=np.int64
        )
        self.slots = np.minimum(self.slots, options.get("passes", PASSES) * self.blocks)

    def settle(self, drawn):
        """Hand slots drawn beyond a source's own to the sources that were drawn too rarely."""
        self.drawn = drawn
        self.surplus_before = np.concatenate([[0], np.cumsum(np.maximum(drawn - self.slots, 0))])
        self.lacking = np.cumsum(np.maximum(self.slots - drawn, 0))

    def place(self, source, index):
        """Source and index of a drawn slot after the settlement."""
        over = index >= self.slots[source]
        rank = self.surplus_before[source[over]] + index[over] - self.slots[source[over]]
        to = np.searchsorted(self.lacking, rank, side="right")
        before = np.where(to > 0, self.lacking[to - 1], 0)
        source, index = source.copy(), index.copy()
        index[over] = self.drawn[to] + rank - before
        source[over] = to
        return source, index


def slots(spark, plan, seed=SEED, shard_slots=SHARD_SLOTS):
    """(shard, slot, source_no, pass, block): what each slot of the mix takes."""
    total = int(plan.slots.sum())
    shards = -(-total // shard_slots)
    chance = plan.slots / max(1, total)

    def draw(batches):
        for batch in batches:
            out = []
            for shard in batch.column("id").to_numpy():
                n = min(shard_slots, total - int(shard) * shard_slots)
                counts = np.random.Generator(np.random.Philox(key=[seed, int(shard)])).multinomial(n, chance)
                used = np.flatnonzero(counts)
                out.append((np.full(len(used), shard), used, counts[used], (np.cumsum(counts) - counts)[used]))
            columns = [np.concatenate(x).astype(np.int64) for x in zip(*out)] if out else [np.zeros(0, np.int64)] * 4
            yield pa.RecordBatch.from_arrays(list(map(pa.array, columns)), ["shard", "source_no", "n", "first"])

    drawn = stored(
        spark,
        spark.range(0, shards, 1, max(1, min(shards, spark.sparkContext.defaultParallelism * 4))).mapInArrow(
            draw, "shard BIGINT, source_no BIGINT, n BIGINT, first BIGINT"
        ),
    )
    sums = np.zeros(len(plan.sources), dtype=np.int64)
    for row in drawn.groupBy("source_no").agg(F.sum("n").alias("n")).collect():  # a row per source
        sums[row.source_no] = row.n
    plan.settle(sums)
    counted = running_aggregates(
        drawn, "shard", {"before": ("sum", F.col("n"))}, by=["source_no"], inclusive=False, span=40
    )

    def expand(batches):
        for batch in batches:
            for at in range(0, batch.num_rows, 64):
                part = batch.slice(at, 64)
                shard, source, n, first, before = (part.column(i).to_numpy() for i in range(5))
                inside = np.arange(n.sum()) - np.repeat(np.cumsum(n) - n, n)
                shard, source = np.repeat(shard, n), np.repeat(source, n)
                source, index = plan.place(source, np.repeat(before, n) + inside)
                size = np.minimum(shard_slots, total - shard * shard_slots)
                slot = permute(np.repeat(first, n) + inside, size, shard + seed)
                blocks = plan.blocks[source]
                turn = index // np.maximum(blocks, 1)
                block = permute(index - turn * blocks, blocks, (source * 64 + turn) * 31 + seed)
                yield pa.RecordBatch.from_arrays(
                    list(map(pa.array, (shard, slot, source, turn, block))), ["shard", "slot", "source_no", "pass", "block"]
                )

    # Few rows that become many: a given number of partitions is not merged.
    tasks = -(-shards // TASK_SHARDS) or 1
    return counted.select("shard", "source_no", "n", "first", "before").repartition(tasks, "shard").mapInArrow(
        expand, "shard BIGINT, slot BIGINT, source_no BIGINT, pass BIGINT, block BIGINT"
    )


def with_offsets(sizes, rows):
    """Each document's first word among its source's, in a pseudorandom order of documents.

    Running sums are taken inside buckets of hashed ids and carried over bucket totals, so no task
    sees a source.
    """
    bits = max(0, math.ceil(math.log2(max(1, rows) / BUCKET)))
    order = F.xxhash64("doc_id", "tie", F.lit("order"))
    # The top bits; a shift by 64 would be a shift by 0.
    bucket = F.shiftrightunsigned(order, 64 - bits) if bits else F.lit(0).cast("bigint")
    hashed = sizes.withColumns({"_order": order, "_bucket": bucket})
    inside = Window.partitionBy("source", "_bucket").orderBy("_order", "doc_id", "size")
    inside = inside.rowsBetween(Window.unboundedPreceding, Window.currentRow)
    totals = hashed.groupBy("source", "_bucket").agg(F.sum("size").alias("_total"))
    ahead = Window.partitionBy("source").orderBy("_bucket")
    carried = totals.select(
        "source", "_bucket", (F.sum("_total").over(ahead) - F.col("_total")).alias("_carried")
    )
    within = hashed.withColumn("_within", F.sum("size").over(inside) - F.col("size")).alias("w")
    same = F.expr("w.source <=> c.source AND w._bucket = c._bucket")
    return within.join(carried.alias("c"), same).select(
        "w.doc_id", "w.source", "w.size", "w.tie", (F.col("_carried") + F.col("_within")).alias("offset")
    )


class Mix:
    """A mix of a table of documents.

    `sized` has a row per document: doc_id, source, size, tie, source_no, source_size, target and
    its offset in its source. `pieces` has a row per slot and document in it: shard, slot, pass,
    source_no, block, offset (of the document in its source), start and length in words.
    """

    def __init__(self, frame, seed=SEED, block_words=BLOCK_WORDS, shard_slots=SHARD_SLOTS, **columns):
        spark = frame.sparkSession
        sizes = stored(spark, sized(frame, **columns))
        by_source = sizes.groupBy("source").agg(F.sum("size").alias("size"), F.count("*").alias("rows"))
        found = by_source.collect()  # one row per source: what a mixture sets weights for
        self.plan = plan = Plan(found, block_words)
        numbered = spark.createDataFrame(
            [(n, s, z, t) for n, (s, z, t) in enumerate(zip(plan.sources, plan.sizes, plan.targets))],
            "source_no BIGINT, _source STRING, source_size BIGINT, target DOUBLE",
        )
        offsets = with_offsets(sizes, sum(row.rows for row in found))
        # As small as the plan, which is in the driver already.
        named = offsets.join(F.broadcast(numbered), F.col("source").eqNullSafe(F.col("_source"))).drop("_source")
        self.sized = stored(spark, named)
        first, last = F.col("offset"), F.col("offset") + F.col("size")
        blocks = F.sequence(F.floor(first / block_words), F.floor((last - 1) / block_words))
        cut = self.sized.where("size > 0").select(
            "source_no", "offset", "size", F.explode(blocks).alias("block")
        )
        start = F.greatest(F.col("block") * block_words, first)
        end = F.least((F.col("block") + 1) * block_words, last)
        cut = cut.select(
            "source_no", "block", "offset", (start - first).alias("start"), (end - start).alias("length")
        )
        # Slots look few before they are expanded: without the hint they would be broadcast.
        self.pieces = slots(spark, plan, seed, shard_slots).hint("merge").join(cut, ["source_no", "block"])


def taken_words(frame, **options):
    """doc_id, size, source_size, target and taken words of every row of the table.

    Null text has size 0 and is never taken; the null source is a source of its own, last in order;
    equal rows are documents of their own; null ids are kept. Other columns are left out. A
    document is taken at most PASSES times. The same table, seed and lengths give the same mix.
    """
    mix = Mix(frame, **options)
    taken = mix.pieces.groupBy("source_no", "offset").agg(F.sum("length").alias("taken"))
    keys = [F.col("d.source_no") == F.col("t.source_no"), F.col("d.offset") == F.col("t.offset"), F.col("d.size") > 0]
    return mix.sized.alias("d").join(taken.alias("t"), keys, "left").select(
        "doc_id", "size", "source_size", "target", F.coalesce("taken", F.lit(0)).cast("bigint").alias("taken")
    )


def op10_mixing(spark, folder):
    return taken_words(documents(spark, folder))


def mixed_documents(frame):
    """The documents of a mix, with the columns of the table.

    Each pass over a source gives a copy of a document, cut to the blocks that the pass takes; the
    words of a copy keep their order and the white space after them. n_chars is counted anew.
    """
    mix = Mix(frame)
    whole = [F.col("s.source_no") == F.col("p.source_no"), F.col("s.offset") == F.col("p.offset"), F.col("s.size") > 0]
    # As many entries as a document has blocks, times the passes.
    copies = (
        mix.pieces.groupBy("source_no", "offset", "pass")
        .agg(F.array_sort(F.collect_list(F.struct("start", "length"))).alias("cuts"))
        .groupBy("source_no", "offset")
        .agg(F.array_sort(F.collect_list(F.struct("pass", "cuts"))).alias("copies"))
    )
    named = mix.sized.alias("s").join(copies.alias("p"), whole).select("s.doc_id", "s.tie", F.col("p.copies").alias("copies"))
    # Equal rows have equal texts: their copies are all cut from one of them.
    cuts = named.groupBy("doc_id", "tie").agg(F.flatten(F.collect_list("copies")).alias("copies"))
    doc, tie, taken = unused(frame, "doc", "tie", "taken")
    texts = frame.withColumns({doc: F.col("doc_id").cast("bigint"), tie: F.xxhash64(F.col("text").cast("string"))})
    same = F.col(f"d.{doc}").eqNullSafe(F.col("c.doc_id")) & (F.col(f"d.{tie}") == F.col("c.tie"))
    joined = (
        texts.dropDuplicates([doc, tie]).alias("d").join(cuts.alias("c"), same)
        .select("d.*", F.explode("c.copies").alias(taken)).drop(doc, tie)
    )
    names = frame.columns
    at_text, at_chars = names.index("text"), names.index("n_chars") if "n_chars" in names else None

    def cut(batches):
        for batch in steps(batches):
            texts = []
            listed = batch.column(taken).to_pylist()
            for text, copy in zip(texts_of(batch).to_pylist(), listed):
                texts.append(cut_words(text, [(c["start"], c["length"]) for c in copy["cuts"]]))
            columns = [batch.column(name) for name in names]
            columns[at_text] = pa.array(texts, batch.schema.field("text").type)
            if at_chars is not None:
                columns[at_chars] = pa.array(list(map(len, texts))).cast(batch.schema.field("n_chars").type)
            yield pa.RecordBatch.from_arrays(columns, names)

    return joined.mapInArrow(cut, frame.schema)


def cut_words(text, cuts):
    """The words at rising (start, length), each with the white space that follows it."""
    at = [found.start() for found in _WORD.finditer(text)] + [len(text)]
    return "".join(text[at[start] : at[start + length]] for start, length in cuts)
