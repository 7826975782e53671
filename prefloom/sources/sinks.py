"""Writers. All overwrite, so a rerun after a lost job leaves one whole result."""

from pyspark.sql import functions as F

from prefloom.operators.matchups import leaderboard

# The report's title; its headings and row forms are in report_lines.
REPORT_TITLE = "PPO vs DPO vs SFT — Eval Report"


def _write_lines(df, path, columns, order):
    rows = df.orderBy(order) if order else df
    rows.select(*columns).write.mode("overwrite").json(path)


def write_candidates(candidates, path, order=None):
    """Candidate JSON lines with their ids. `order` sorts all texts for readers that count lines."""
    _write_lines(candidates, path, ["cand_id", "prompt", "response_a", "response_b"], order)


def write_labelled_pairs(pairs, path, order=None):
    """Labelled-pair JSON lines with their ids, which the pair reader takes back unchanged."""
    _write_lines(pairs, path, ["pair_id", "chosen", "rejected"], order)


def write_bucketed(df, table, key, buckets, path=None):
    """A table bucketed and sorted by its join key, one file per bucket; returns it.

    Tables stored this way on the same key and bucket count meet, and are grouped by the key,
    without a shuffle, so their texts cross the network once, here. `path` keeps the files outside
    the warehouse.
    """
    keys = [key] if isinstance(key, str) else list(key)
    writer = df.repartition(buckets, *keys).write.mode("overwrite").bucketBy(buckets, *keys).sortBy(*keys)
    (writer.option("path", path) if path else writer).saveAsTable(table)
    return df.sparkSession.table(table)


def eval_document(prompts, generations, counts, board):
    """The evaluation as one row: prompts, generations per model, wins and match-ups."""
    texts = prompts.agg(
        F.transform(
            F.array_sort(F.collect_list(F.struct("prompt_id", "prompt"))), lambda p: p["prompt"]
        ).alias("prompts")
    )
    per_model = generations.groupBy("model").agg(
        F.transform(
            F.array_sort(F.collect_list(F.struct("prompt_id", "response"))), lambda g: g["response"]
        ).alias("responses")
    )
    match = F.concat("name_a", F.lit("_vs_"), "name_b")
    record = F.struct("a_wins", "b_wins", "ties")
    return texts.select(
        "prompts",
        per_model.agg(_map_of(F.col("model"), F.col("responses"))).scalar().alias("generations"),
        board.agg(_map_of(F.col("model"), F.col("wins"))).scalar().alias("wins"),
        counts.agg(_map_of(match, record)).scalar().alias("matchups"),
    )


def _map_of(key, value):
    return F.map_from_entries(F.array_sort(F.collect_list(F.struct(key, value))))


def write_eval_raw(prompts, generations, counts, roster, path):
    """The evaluation's raw results; returns the stored tables by name.

    Four parquet tables: prompts, generations, matchups and wins, the last from the stored
    match-ups, so judging runs once. The layout is the same at every size; `write_eval_document`
    makes the single JSON document of them.
    """
    spark = prompts.sparkSession

    def store(name, table):
        table.write.mode("overwrite").parquet(f"{path}/{name}")
        return spark.read.parquet(f"{path}/{name}")

    stored = {
        "prompts": store("prompts", prompts),
        "generations": store("generations", generations),
        "matchups": store("matchups", counts),
    }
    stored["wins"] = store("wins", leaderboard(stored["matchups"], roster))
    return stored


def write_eval_document(stored, path):
    """The stored evaluation as one JSON document. All of its texts meet in one row."""
    document = eval_document(stored["prompts"], stored["generations"], stored["matchups"], stored["wins"])
    document.select(F.to_json(F.struct("*")).alias("value")).write.mode("overwrite").text(path)


def _json(column):
    """A value as JSON text; the only field of a record, without the record around it."""
    record = F.to_json(F.struct(column.alias("v")))
    return F.when(column.isNull(), "null").otherwise(F.substring(record, F.lit(6), F.char_length(record) - 6))


def document_lines(stored):
    """The stored evaluation as the lines of one JSON document: (section, name, part, place, value).

    In the order of the first four columns the values are the document that `eval_document` holds in
    one row, but no line has more than one text. Only what opens a list or map needs to know that
    it comes first; those are the smallest keys, one per model. Of several responses of a model to a
    prompt the smallest is taken, like in a comparison.
    """
    prompts, wins = stored["prompts"], stored["wins"]
    matchups = stored["matchups"].withColumn("match", F.concat("name_a", F.lit("_vs_"), "name_b"))
    generations = stored["generations"].groupBy("model", "prompt_id").agg(F.min("response").alias("response"))

    def lines(table, section, value, name=F.lit(""), part=F.lit(1), place=F.lit(0)):
        return table.select(
            F.lit(section).alias("section"), name.alias("name"), part.alias("part"),
            place.cast("bigint").alias("place"), value.alias("value"),
        )

    def after_first(is_first, value):
        return F.concat(F.when(is_first, "").otherwise(","), value)

    def smallest(table, column):
        return table.agg(F.min(column)).scalar()

    fixed = F.inline(
        F.array(*[
            F.struct(F.lit(section).alias("section"), F.lit(text).alias("text"))
            for section, text in (
                (0, '{"prompts": ['), (2, '], "generations": {'), (4, '}, "wins": {'), (6, '}, "matchups": {'), (8, "}}")
            )
        ])
    )
    frame = prompts.sparkSession.range(1).select(fixed).select(
        "section", F.lit("").alias("name"), F.lit(1).alias("part"), F.lit(0).cast("bigint").alias("place"), F.col("text").alias("value")
    )
    model, prompt = F.col("model"), F.col("prompt_id")
    # One entry per model.
    firsts = generations.groupBy("model").agg(F.min("prompt_id").alias("first"))
    first_of = firsts.agg(F.map_from_entries(F.collect_list(F.struct("model", "first")))).scalar()
    made = generations.withColumn("_first", F.element_at(first_of, model) == prompt)
    opened = after_first(model == smallest(firsts, "model"), F.concat(_json(model), F.lit(": [")))
    record = F.to_json(F.struct("a_wins", "b_wins", "ties"))
    parts = [
        lines(prompts, 1, after_first(prompt == smallest(prompts, "prompt_id"), _json(F.col("prompt"))), place=prompt),
        lines(firsts, 3, opened, model, F.lit(0)),
        lines(made, 3, after_first(F.col("_first"), _json(F.col("response"))), model, F.lit(1), prompt),
        lines(firsts, 3, F.lit("]"), model, F.lit(2)),
        lines(wins, 5, after_first(model == smallest(wins, "model"), F.concat(_json(model), F.lit(": "), F.col("wins").cast("string"))), model),
        lines(
            matchups, 7,
            after_first(F.col("match") == smallest(matchups, "match"), F.concat(_json(F.col("match")), F.lit(": "), record)),
            F.col("match"),
        ),
    ]
    for part in parts:
        frame = frame.unionAll(part)
    return frame


def write_eval_document_parts(stored, path):
    """The stored evaluation as text files that, one after the other by name, are its one JSON document.

    Lines are sorted by ranges, so every part is written by a task of its own.
    """
    ordered = document_lines(stored).orderBy("section", "name", "part", "place")
    ordered.select("value").write.mode("overwrite").text(path)


def report_lines(counts, board, totals, judge, n_prompts, title=REPORT_TITLE):
    """The report as numbered Markdown lines. Its input has one row per model or pair."""
    fixed = [
        (0, f"# {title}"),
        (1, ""),
        (2, f"Judge: {judge} | Prompts: {n_prompts}"),
        (3, ""),
        (4, "## Overall win counts"),
        (5, ""),
        (6, "| Model | Wins |"),
        (7, "|---|---|"),
        (9, ""),
        (11, ""),
        (12, "## Head-to-head"),
        (13, ""),
        (14, "| Matchup | A wins | B wins | Ties |"),
        (15, "|---|---|---|---|"),
        (17, ""),
    ]
    rows = [
        F.struct(F.lit(n).alias("section"), F.lit("").alias("place"), F.lit(line).alias("value"))
        for n, line in fixed
    ]
    header = board.sparkSession.range(1).select(F.inline(F.array(*rows)))
    # Most wins first: the place sorts as text, so wins are counted down from a fixed width.
    place = F.concat(F.lpad((F.lit(10**15) - F.col("wins")).cast("string"), 16, "0"), F.col("model"))
    models = board.select(
        F.lit(8).alias("section"),
        place.alias("place"),
        F.concat(F.lit("| "), "model", F.lit(" | "), F.col("wins").cast("string"), F.lit(" |")).alias("value"),
    )
    ties = totals.select(
        F.lit(10).alias("section"),
        F.lit("").alias("place"),
        F.concat(
            F.lit("Ties: "), F.col("ties").cast("string"), F.lit(" / "), F.col("total").cast("string"),
            F.lit(" matchups"),
        ).alias("value"),
    )
    judged = totals.select(
        F.lit(18).alias("section"),
        F.lit("").alias("place"),
        F.concat(
            F.lit("Defaulted: "), F.col("defaulted").cast("string"), F.lit(" | Unjudged: "),
            F.col("unjudged").cast("string"),
        ).alias("value"),
    )
    numbers = [F.concat(F.lit(" | "), F.col(name).cast("string")) for name in ("a_wins", "b_wins", "ties")]
    matches = counts.select(
        F.lit(16).alias("section"),
        F.concat("name_a", F.lit("\n"), "name_b").alias("place"),
        F.concat(F.lit("| "), "name_a", F.lit(" vs "), "name_b", *numbers, F.lit(" |")).alias("value"),
    )
    return header.unionByName(models).unionByName(ties).unionByName(matches).unionByName(judged)


def write_eval_report(lines, path):
    """One text file in report order; the table is models-sized."""
    lines.orderBy("section", "place").coalesce(1).select("value").write.mode("overwrite").text(path)
