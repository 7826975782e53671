"""Folders that grow while a run or a labelling job writes to them.

Only stateless operators take part, so there is no watermark and no state: each file is parsed
once, in the same expressions the batch operators use. Lines of a stream have no position.
"""

from pyspark.sql import functions as F

from prefloom import schemas
from prefloom.functions import text as T
from prefloom.operators.runlog import parse_log


def follow_log(spark, folder, files_per_batch=100):
    """Parsed log lines as files arrive; runs are told apart by file path."""
    lines = spark.readStream.option("maxFilesPerTrigger", files_per_batch).text(folder)
    return parse_log(
        lines.select(
            F.xxhash64("_metadata.file_path").alias("run_id"),
            F.lit(None).cast("bigint").alias("line_no"),
            "value",
        )
    )


def follow_pairs(spark, folder, files_per_batch=100):
    """Prompt and both responses of labelled pairs as files arrive."""
    pairs = (
        spark.readStream.schema(schemas.PAIR_FILE)
        .option("mode", "FAILFAST")
        .option("maxFilesPerTrigger", files_per_batch)
        .json(folder)
    )
    chosen, rejected = F.col("chosen"), F.col("rejected")
    return pairs.select(
        T.prompt_of(chosen).alias("prompt"),
        T.response_of(chosen).alias("chosen"),
        T.response_of(rejected).alias("rejected"),
    )
