"""What the corpus operators share: reading tables, words, bounded batches, stored results."""

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc

from prefloom.session import scratch_folder

# Text handed to one vectorised step. Longer texts come alone.
STEP_BYTES = 4 << 20


def documents(spark, folder):
    return spark.read.parquet(f"{folder}/documents.parquet")


def stored(spark, frame):
    """Write a frame below spark.checkpoint.dir and read it back: the lineage ends there.

    Every executor can read the files, so a lost executor costs no recomputation.
    """
    path = scratch_folder(spark)
    frame.write.parquet(path)
    return spark.read.schema(frame.schema).parquet(path)


def steps(batches, column="text", limit=STEP_BYTES):
    """Arrow batches cut so that the named column holds about `limit` bytes in each."""
    for batch in batches:
        sizes = pc.fill_null(pc.binary_length(batch.column(column)), 0).to_numpy(zero_copy_only=False)
        ends = np.cumsum(sizes, dtype=np.int64)
        start = 0
        while start < batch.num_rows:
            before = ends[start - 1] if start else 0
            stop = max(start + 1, int(np.searchsorted(ends, before + limit, side="right")))
            yield batch.slice(start, stop - start)
            start = stop


def texts_of(batch, column="text"):
    """The texts of a batch, null as the empty text, with 64-bit offsets."""
    texts = batch.column(column).cast(pa.large_string())
    return pc.fill_null(texts, "")


def words_of(texts):
    """All words of all texts in one array, and where each text's words begin and end."""
    lists = pc.ascii_split_whitespace(texts)
    flat, ends = lists.flatten(), lists.offsets.to_numpy()
    ends = ends - ends[0]
    filled = pc.greater(pc.binary_length(flat), 0)
    kept = np.concatenate([[0], np.cumsum(filled.to_numpy(zero_copy_only=False), dtype=np.int64)])
    return flat.filter(filled), kept[ends]


def coded(words):
    """Distinct words of an array, and each word's place among them."""
    encoded = words.dictionary_encode()
    return encoded.dictionary, encoded.indices.to_numpy(zero_copy_only=False).astype(np.int64)


def ragged(starts, lengths):
    """The places starts[i], starts[i] + 1, ... of every piece i, one piece after the other."""
    lengths = np.asarray(lengths, dtype=np.int64)
    ends = np.cumsum(lengths)
    shift = np.repeat(np.asarray(starts, dtype=np.int64) - (ends - lengths), lengths)
    return shift + np.arange(ends[-1] if len(ends) else 0, dtype=np.int64)


def unused(frame, *names):
    """Names for helper columns that the frame does not have yet, in any case of letters."""
    taken = {name.lower() for name in frame.columns}
    found = []
    for name in names:
        while name.lower() in taken:
            name = f"_{name}"
        taken.add(name.lower())
        found.append(name)
    return found
