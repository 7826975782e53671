"""The corpus pipeline: quality rules, line dedup, near-dedup, mixing and packing.

Each stage takes (spark, docs, sf_dir), works on all that its predecessor kept and returns a
DataFrame; run() writes it as Parquet below spark.checkpoint.dir and reads it back as the next
stage's documents. All stages but the last return the columns of documents.
"""

from pyspark.sql import functions as F

from prefloom.llm import lines, mixing, packing, quality, simhash
from prefloom.llm.common import documents, stored


def quality_rules(spark, docs, sf_dir):
    """Documents that the base rules or a risk-controlled cutoff rejects go."""
    return quality.without_rejected(docs, spark.read.parquet(f"{sf_dir}/labels.parquet"))


def line_dedup(spark, docs, sf_dir):
    """Lines with an earlier line within the edit threshold go, shorter ones with an equal line; documents stay."""
    return lines.without_repeated_lines(docs, shorter=True)


def near_dedup(spark, docs, sf_dir):
    """One document of each group of near copies stays."""
    return simhash.one_of_each(docs)


def mix_sources(spark, docs, sf_dir):
    """Documents cut and repeated as the mix takes their blocks; a copy is a row of its own."""
    return mixing.mixed_documents(docs)


def pack_sequences(spark, docs, sf_dir):
    """Pieces of token sequences: their ids and a checksum of them."""
    return packing.pack(docs).withColumn("ids_crc32", F.crc32("ids"))


STAGES = [
    ("quality rules", quality_rules),
    ("line dedup", line_dedup),
    ("near-dedup", near_dedup),
    ("mix", mix_sources),
    ("pack", pack_sequences),
]

# Exact binomial cutoffs, hash permutations and subword ids are beyond SQL.
ORACLE_SQL = None


def run(spark, sf_dir):
    docs = documents(spark, sf_dir)
    for _, stage in STAGES:
        docs = stored(spark, stage(spark, docs, sf_dir))
    return docs
