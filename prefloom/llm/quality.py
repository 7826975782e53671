"""Quality rules whose cutoffs limit the share of good documents that they reject.

Each rule rejects a document whose signal, a share from 0 to 1, is above a cutoff. All rules are
tightened along one path of cutoffs, from the one that rejects nothing on; the path is laid by the
signals of all documents and of those labelled bad, so which ones are labelled good only tests it. In every
stratum they show how many of them each step rejects by any rule, and the exact binomial upper bound
of that share has to stay within the allowed risk. The first step that fails ends the path, so no
correction is needed along it or for the rules; strata are corrected for by dividing the error.
"""

import math

import numpy as np
import pandas as pd
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import functions as F

from prefloom.llm.common import coded, documents, steps, stored, texts_of, unused, words_of

# At most this share of a stratum's good documents is rejected, but for this probability.
RISK, ERROR = 0.02, 0.05
GRID = 100
MIN_WORDS, REPEAT_PERCENT = 50, 50
RULES = ("symbols", "repeated_lines", "repeated_words", "capitals")
_SPACE = " \t\n\r\x0b\x0c"


def repeated_words(places, bounds, distinct, width=3):
    """Words of each text that lie in a window found more than once in that text."""
    n = len(places)
    text = np.repeat(np.arange(len(bounds) - 1), np.diff(bounds))
    starts = np.flatnonzero(text[: n - width + 1] == text[width - 1 :]) if n >= width else np.zeros(0, np.int64)
    key = places[starts]
    for step in range(1, width):
        key = np.unique(key * distinct + places[starts + step], return_inverse=True)[1]
    _, inverse, counts = np.unique(text[starts] * np.int64(n + 1) + key, return_inverse=True, return_counts=True)
    again = starts[counts[inverse] > 1]
    inside = np.zeros(n, dtype=bool)
    for step in range(width):
        inside[again + step] = True
    return np.bincount(text[inside], minlength=len(bounds) - 1)


def _sums(values, bounds):
    return np.diff(np.concatenate([[0], np.cumsum(values, dtype=np.int64)])[bounds])


def measures(frame, id_column="doc_id", text_column="text", stratum_column="lang"):
    """Counts per row, where it is read. Null text: no words; null stratum: one of its own."""
    kinds = ["n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "n_lines", "n_capitals"]

    def run(batches):
        for batch in steps(batches):
            texts = texts_of(batch)
            words, bounds = words_of(texts)
            distinct, places = coded(words)
            lines = [[x for x in t.split("\n") if x.strip(_SPACE)] for t in texts.to_numpy(zero_copy_only=False)]
            columns = [
                np.diff(bounds),
                _sums(pc.utf8_length(words).to_numpy(zero_copy_only=False), bounds),
                pc.count_substring_regex(texts, "[#*$%&|<>]").to_numpy(zero_copy_only=False),
                np.array([len(x) - len(set(x)) for x in lines], dtype=np.int64),
                repeated_words(places, bounds, len(distinct)),
                np.array(list(map(len, lines)), dtype=np.int64),
                pc.count_substring_regex(texts, "[A-Z]").to_numpy(zero_copy_only=False),
            ]
            yield pa.RecordBatch.from_arrays(
                [*[batch.column(c) for c in ("doc_id", "tie", "stratum")], *[pa.array(c.astype(np.int64)) for c in columns]],
                ["doc_id", "tie", "stratum", *kinds],
            )

    rows = frame.selectExpr(
        f"CAST(`{id_column}` AS BIGINT) AS doc_id",
        f"coalesce(CAST(`{text_column}` AS STRING), '') AS text",
        f"xxhash64(coalesce(CAST(`{text_column}` AS STRING), '')) AS tie",
        f"coalesce(CAST(`{stratum_column}` AS STRING), '') AS stratum",
    )
    return rows.mapInArrow(
        run, "doc_id BIGINT, tie BIGINT, stratum STRING, " + ", ".join(f"{kind} BIGINT" for kind in kinds)
    )


def signals():
    """Each rule's signal from the counts; 0 where there is nothing to count."""

    def share(part, whole):
        return F.coalesce(F.least(F.col(part) / F.nullif(F.col(whole), F.lit(0)), F.lit(1.0)), F.lit(0.0))

    return {
        "symbols": share("n_symbols", "word_chars"),
        "repeated_lines": share("n_dup_lines", "n_lines"),
        "repeated_words": share("n_repeat_words", "n_words"),
        "capitals": share("n_capitals", "word_chars"),
    }


def base_failed():
    return (F.col("n_words") < MIN_WORDS) | (100 * F.col("n_repeat_words") > REPEAT_PERCENT * F.col("n_words"))


def binomial_cdf(k, n, p):
    """P(X <= k) by a sum of logarithms."""
    if p <= 0 or k >= n:
        return 1.0
    if p >= 1:
        return 0.0
    i = np.arange(k + 1)
    whole = math.lgamma(n + 1)
    logs = np.array([whole - math.lgamma(x + 1) - math.lgamma(n - x + 1) for x in i])
    logs += i * math.log(p) + (n - i) * math.log1p(-p)
    top = logs.max()
    return float(min(1.0, math.exp(top) * np.exp(logs - top).sum()))


def bound_holds(k, n, limit, error):
    """Whether the exact upper bound of a share, seen k times in n, is within the limit.

    The bound is the share at which so few would be seen with probability `error`; it is within the
    limit exactly if that probability is no larger at the limit itself.
    """
    return n > 0 and k < n and binomial_cdf(k, n, limit) <= error


def last_holding(good, limit, error):
    """The last step before one fails; step 0 rejects nothing.

    `good` counts good documents by the first step that rejects them; those that no step rejects
    stand at its end.
    """
    n, rejected, best = int(good.sum()), 0, 0
    for step in range(1, len(good) - 1):
        rejected += int(good[step])
        if not bound_holds(rejected, n, limit, error):
            break
        best = step
    return best


def tightened(whole, part, cutoff, weight):
    """The next (rule, cutoff) of the path, None at its end.

    Both counts, of all documents that no cutoff rejects yet and of the bad ones among them, are
    rules by levels, the least cutoffs in 1/grid that keep a document. A bad one stands for `weight`
    documents. Taken is the cutoff whose newly rejected bad documents most outnumber the other ones; of
    equals the first rule's, then the highest. The path ends where they outnumber them nowhere.
    """
    best, most = None, 0.0
    for rule in range(len(whole)):
        down = np.arange(cutoff[rule] - 1, -1, -1)
        gain = np.cumsum(2 * weight * part[rule][down + 1] - whole[rule][down + 1])
        if len(gain) and gain.max() > most + 1e-9:
            best, most = (rule, int(down[gain.argmax()])), float(gain.max())
    return best


def cutoffs(measured, labels, risk=RISK, error=ERROR, grid=GRID):
    """A row per stratum: `cutoffs`, the cutoff of each rule.

    Labels are (doc_id, quality). Equal texts of a stratum count once, good if any label of theirs
    is 1, else bad; documents that fail the base rules are no evidence: those are rejected whatever
    the cutoffs. A stratum with few good labels (fewer than ln(error / strata) / ln(1 - risk)) or none
    gets the cutoff 1 everywhere, which rejects nothing.
    """
    spark = measured.sparkSession
    levels = [F.ceil(signal * grid).cast("int").alias(rule) for rule, signal in signals().items()]
    passed = measured.where(~base_failed())
    marks = labels.groupBy("doc_id").agg(F.max(F.col("quality") == 1).cast("int").alias("good"))
    marked = stored(spark, passed.join(marks, "doc_id", "left").select("stratum", "tie", "good", *levels))
    # Documents of equal levels are one row, combined before the shuffle.
    alike = stored(
        spark,
        marked.groupBy(*RULES).agg(
            F.count("*").alias("whole"), F.count("good").alias("labelled"), F.count_if(F.col("good") == 0).alias("bad")
        ),
    )
    total = alike.agg(F.sum("whole"), F.sum("labelled")).first()
    weight = total[0] / total[1] if total[1] else 0.0
    order, cutoff = [], [grid] * len(RULES)
    each = F.inline(F.array(*[F.struct(F.lit(i).alias("rule"), F.col(r).alias("level")) for i, r in enumerate(RULES)]))
    while weight:
        left = alike.where(" AND ".join(f"{rule} <= {at}" for rule, at in zip(RULES, cutoff))).select("whole", "bad", each)
        counts = np.zeros((2, len(RULES), grid + 1), dtype=np.int64)
        # At most grid + 1 rows a rule.
        for rule, level, *both in left.groupBy("rule", "level").agg(F.sum("whole"), F.sum("bad")).collect():
            counts[:, rule, level] = both
        found = tightened(*counts, cutoff, weight)
        if found is None:
            break
        rule, low = found
        order += [rule] * (cutoff[rule] - low)
        cutoff[rule] = low
    held = marked.where("good IS NOT NULL").groupBy("stratum", "tie").agg(
        F.max("good").alias("good"), *[F.max(rule).alias(rule) for rule in RULES]
    )
    # The first step at which each rule rejects each level; beyond the path for levels never reached.
    end = len(order) + 1
    first, reached = np.full((len(RULES), grid + 1), end), [grid] * len(RULES)
    for step, rule in enumerate(order, 1):
        first[rule, reached[rule]] = step
        reached[rule] -= 1
    tables = [F.array(*[F.lit(int(x)) for x in row]) for row in first]
    step = F.least(*[F.get(table, F.col(rule)) for table, rule in zip(tables, RULES)])
    counted = held.where("good = 1").select("stratum", step.alias("step")).groupBy("stratum", "step").agg(
        F.count("*").alias("n")
    )
    counted = stored(spark, counted)
    strata = counted.select("stratum").distinct().count()

    def select(group: pd.DataFrame) -> pd.DataFrame:
        good = np.bincount(group.step, weights=group.n, minlength=end + 1).astype(np.int64)
        taken = order[: last_holding(good, risk, error / strata)]
        kept = {rule: (grid - taken.count(i)) / grid for i, rule in enumerate(RULES)}
        return pd.DataFrame({"stratum": [group.stratum.iloc[0]], **{rule: [x] for rule, x in kept.items()}})

    kinds = ", ".join(f"{rule} DOUBLE" for rule in RULES)
    found = counted.groupBy("stratum").applyInPandas(select, f"stratum STRING, {kinds}")
    return found.select("stratum", F.struct(*RULES).alias("cutoffs"))


def judge(frame, labels, id_column="doc_id", text_column="text", stratum_column="lang", **options):
    """Id, a hash of the text, counts, base_failed, and whether the document is kept, of every row.

    Labels are (doc_id, quality); quality 1 is good, others bad; null ones and null ids are left out.
    Equal rows each give a row and are judged alike. Documents are read once; their counts are stored.
    """
    spark = frame.sparkSession
    measured = stored(spark, measures(frame, id_column, text_column, stratum_column))
    marked = labels.where("quality IS NOT NULL AND doc_id IS NOT NULL").select(F.col("doc_id").cast("bigint"), "quality")
    found = cutoffs(measured, marked, **options)
    kept = ~base_failed()
    for rule, signal in signals().items():
        kept = kept & F.coalesce(signal <= F.col("cutoffs")[rule], F.lit(True))
    # Adaptive execution sends the few rows of cutoffs to the documents.
    return measured.join(stored(spark, found), "stratum", "left").select(
        "doc_id", "tie", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words",
        base_failed().alias("base_failed"), kept.alias("kept"),
    )


def op6_quality_rules(spark, folder):
    return judge(documents(spark, folder), spark.read.parquet(f"{folder}/labels.parquet")).drop("tie")


def without_rejected(frame, labels):
    """The table without rejected documents; all of its columns and kept rows stay as they are."""
    judged = judge(frame, labels).where("kept").select(F.col("doc_id").alias("doc"), "tie").distinct()
    text = F.coalesce(F.col("text").cast("string"), F.lit(""))
    doc, tie = unused(frame, "doc", "tie")
    keyed = frame.withColumns({doc: F.col("doc_id").cast("bigint"), tie: F.xxhash64(text)})
    same = F.col(f"d.{doc}").eqNullSafe(F.col("j.doc")) & (F.col(f"d.{tie}") == F.col("j.tie"))
    return keyed.alias("d").join(judged.alias("j"), same, "left_semi").drop(doc, tie)
