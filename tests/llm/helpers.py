"""Small tables with every awkward case, and plain readings of the given ones."""

import pyarrow.parquet as pq

from tests.conftest import TESTDATA

SMALL = f"{TESTDATA}/sf0.001"
SCHEMA = (
    "doc_id BIGINT, text STRING, lang STRING, source STRING, n_chars BIGINT, "
    # Names that operators use themselves.
    "mark STRING, component STRING, _block STRING, words STRING, size STRING, kept STRING, start STRING"
)


def odd_documents(spark, texts=None):
    """(doc_id, text) with nulls, empty and long texts, ties and repeated rows."""
    long = " ".join(f"wörd{i % 977}" for i in range(30_000))
    texts = texts or [
        (1, "one two three four"),
        (1, "one two three four"),
        (1, "same id, other text"),
        (2, None),
        (None, "no id at all"),
        (None, None),
        (3, ""),
        (4, " \t\n "),
        (5, long),
        (6, long + " more"),
        (7, "a"),
        (-9, "日本語 テキスト\n\x0bé é"),
        (9_000_000_000_000_000_000, "far id"),
    ]
    rows = [(i, t, "en" if n % 3 else None, "s" if n % 2 else None, None, *["x"] * 7) for n, (i, t) in enumerate(texts)]
    return spark.createDataFrame(rows, SCHEMA)


def no_documents(spark):
    return spark.createDataFrame([], SCHEMA)


def pairs_of(frame):
    return [(row.doc_id, row.text or "") for row in frame.select("doc_id", "text").collect()]


def small_documents():
    table = pq.read_table(f"{SMALL}/documents.parquet", columns=["doc_id", "text"])
    return list(zip(table["doc_id"].to_pylist(), [text or "" for text in table["text"].to_pylist()]))


def by_id(frame):
    return {row.doc_id: row for row in frame.collect()}
