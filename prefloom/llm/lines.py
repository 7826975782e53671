"""Near-equal lines by a segment-partition edit join, on DataFrame functions only.

A line of m characters is cut into edits + 1 segments. A line within that many edits holds at
least one of them unchanged, at a place that its length and the segment's number confine to a few
positions. Segments and probed substrings are hashed with the length and number they stand for and
meet on equal hashes; under a hash that many lines share they meet on their rarest grams. What meets
is narrowed by character parities, which one edit changes in at most two places, and verified with a
banded bit-parallel edit distance.
"""

from pyspark.sql import functions as F

from prefloom.llm.common import documents, stored, unused
from prefloom.llm.components import components

EDITS, MIN_CHARS = 2, 20
# Ids that may be sent to every executor: 16 bytes each. More meet in a shuffle.
SENT_IDS = 1 << 21
PARITIES = 60
# A key with more rows is crowded: its lines meet on their rarest grams of so many characters.
CROWD, GRAM = 64, 4
# Fixed value: the white space stripped from both ends of a line.
WHITE = " \t\r\x0b\x0c"


def document_lines(frame, id_column="doc_id", text_column="text"):
    """(doc_id, tie, lines) of every row: its lines in order; a null text has one, the empty one."""
    text = F.coalesce(F.col(text_column).cast("string"), F.lit(""))
    return frame.select(
        F.col(id_column).cast("bigint").alias("doc_id"),
        F.xxhash64(text).alias("tie"),
        F.split(text, "\n").alias("lines"),
    )


def _lines(listed, min_chars):
    """A row per line that, stripped, is long enough: its place, text, length and two hashes."""
    line = F.col("line")
    return (
        listed.select("doc_id", "tie", F.posexplode("lines").alias("at", "line"))
        .withColumn("line", F.btrim(line, F.lit(WHITE)))
        .withColumn("n", F.char_length(line))
        .where(F.col("n") >= min_chars)
        .select("doc_id", "tie", "at", "line", "n", F.xxhash64(line).alias("id"), F.hash(line).alias("check"))
    )


def probes(lines, edits, min_chars):
    """(id, key, index, gap): hashes under which lines stand for their own segments (index) and look
    for those of others.

    For an indexed line that is `gap` characters shorter, segment `number` can stand shifted only as
    far as the edits before it, and the edits that remain after it, allow.
    """
    places = [
        (gap, number, shift)
        for gap in range(edits + 1)
        for number in range(edits + 1)
        for shift in range(max(-number, gap - (edits - number)), min(number, gap + (edits - number)) + 1)
    ]
    # One short row expression after a constant list stays small enough to be compiled.
    listed = F.array(
        *[F.struct(*[F.lit(x).alias(name) for name, x in zip(("gap", "number", "shift"), place)]) for place in places]
    )
    length, number, at = F.col("n") - F.col("gap"), F.col("number"), F.col("start") + F.col("shift")
    cut = F.substring("line", (at + 1).cast("int"), F.col("size").cast("int"))
    return (
        lines.select("id", "line", "n", F.inline(listed))
        .withColumn("start", F.call_function("div", length * number, F.lit(edits + 1)))
        .withColumn("size", F.call_function("div", length * (number + 1), F.lit(edits + 1)) - F.col("start"))
        .where((length >= min_chars) & (at >= 0) & (at + F.col("size") <= F.col("n")))
        .select(
            "id",
            F.xxhash64(cut, length, number).alias("key"),
            ((F.col("gap") == 0) & (F.col("shift") == 0)).alias("index"),
            "gap",
        )
    )


def parities(line):
    """Bits that tell which characters, in PARITIES classes, occur an odd number of times."""
    one = F.lit(1).cast("bigint")
    return F.aggregate(
        F.regexp_extract_all(line, F.lit("(?s)."), F.lit(0)),
        F.lit(0).cast("bigint"),
        lambda bits, c: bits.bitwiseXOR(F.call_function("shiftleft", one, F.pmod(F.hash(c), F.lit(PARITIES)))),
    )


def characters(line):
    return F.regexp_extract_all(line, F.lit("(?s)."), F.lit(0))


def _bound(value, body):
    """`body` of a value that is computed once."""
    return F.element_at(F.transform(F.array(value), body), 1)


def edit_distance(a, b, edits):
    """Edit distance of two arrays of characters, exact up to `edits`; larger ones give more.

    Neither array is shorter than `edits`, and their sizes differ by at most it. One word holds
    the vertical differences of the 2 * edits + 1 rows around the diagonal; it moves down a row with
    every column. The distance follows the lowest diagonal to the last row, then that row.
    """
    width = 2 * edits + 1
    whole = (1 << width) - 1
    rows, columns = F.size(a), F.size(b)

    def big(number):
        return F.lit(number).cast("bigint")

    def flip(bits):
        return bits.bitwiseXOR(big(whole))

    def column(state, j):
        equal = None
        for bit in range(width):
            same = F.when(F.get(a, j - edits + bit - 1) == F.get(b, j - 1), big(1 << bit)).otherwise(big(0))
            equal = same if equal is None else equal + same
        up, down = state["up"], state["down"]

        def after(x):
            carried = (x.bitwiseAND(up) + up).bitwiseAND(big(whole))
            return _bound(carried.bitwiseXOR(up).bitwiseOR(x).bitwiseOR(down), step)

        def step(diagonal):
            right = down.bitwiseOR(flip(diagonal.bitwiseOR(up)))
            left = diagonal.bitwiseAND(up)
            lower = F.shiftright(diagonal, 1)
            # The row of the distance: the band's lowest until it is the last one.
            bit = F.call_function("shiftleft", big(1), (rows - j + edits).cast("int"))
            falling = F.when(diagonal.bitwiseAND(big(1 << (width - 1))) == 0, 1).otherwise(0)
            along = F.when(right.bitwiseAND(bit) != 0, 1).when(left.bitwiseAND(bit) != 0, -1).otherwise(0)
            moved = F.when(j + edits <= rows, falling).otherwise(along)
            return F.struct(
                left.bitwiseOR(flip(lower.bitwiseOR(right))).alias("up"),
                lower.bitwiseAND(right).alias("down"),
                (state["distance"] + moved).cast("int").alias("distance"),
            )

        return _bound(equal, after)

    start = F.struct(
        big(whole & ~((1 << edits) - 1)).alias("up"), big(0).alias("down"), F.lit(edits).cast("int").alias("distance")
    )
    return F.aggregate(F.sequence(F.lit(1), columns), start, column)["distance"]


def _only(rows, ids, column):
    """Rows whose column is among the ids: by a broadcast if they are counted and few."""
    few = ids.count() <= SENT_IDS
    return rows.join(F.broadcast(ids) if few else ids, column, "left_semi")


def _pairs(rows, keys, edits, among=None):
    """(u, v) of indexed and probing lines that agree on the keys and nearly on their parities.

    Lines of one length meet in one direction. `among` is a condition on a row's columns of either
    side, as a function of both aliases.
    """
    near = F.bit_count(F.col("a.bits").bitwiseXOR(F.col("b.bits"))) <= 2 * edits
    once = F.when(F.col("b.gap") == 0, F.col("a.id") < F.col("b.id")).otherwise(F.col("a.id") != F.col("b.id"))
    condition = near & once
    for key in keys:
        condition = condition & (F.col(f"a.{key}") == F.col(f"b.{key}"))
    if among is not None:
        condition = condition & among
    return rows.where("index").alias("a").join(rows.alias("b"), condition).select(
        F.least("a.id", "b.id").alias("u"), F.greatest("a.id", "b.id").alias("v")
    )


def _crowded_pairs(spark, rows, texts, edits):
    """The pairs of `_pairs` for keys under which many lines stand, without comparing all of them.

    An edit changes at most GRAM of a line's distinct grams. Two lines within the edits therefore
    share one of their first edits * GRAM + 1 grams in any common order, if they have that many;
    the order is rarest first under the key. Lines of fewer grams, and what is near them, meet on
    character parities instead: 2 * edits changed ones leave one of 2 * edits + 1 blocks unchanged.
    """
    changed = edits * GRAM
    letters = F.col("letters")
    gram = F.array_distinct(
        F.transform(
            F.sequence(F.lit(0), F.greatest(F.size(letters) - GRAM, F.lit(0))),
            lambda i: F.xxhash64(*[F.get(letters, i + n) for n in range(GRAM)]),
        )
    )
    held = rows.select("id").distinct()
    grams = stored(spark, texts.join(held, "id", "left_semi").select("id", gram.alias("grams")))
    placed = rows.select("key", "id").distinct().join(grams, "id")
    single = placed.where(F.size("grams") > changed).select("key", "id", F.explode("grams").alias("gram"))
    counts = single.groupBy("key", "gram").agg(F.count("*").alias("n"))
    first = F.slice(F.array_sort(F.collect_list(F.struct("n", "gram"))), 1, changed + 1)["gram"]
    chosen = single.join(counts, ["key", "gram"]).groupBy("key", "id").agg(first.alias("first"))
    by_gram = stored(spark, rows.join(chosen, ["key", "id"]).select("*", F.explode("first").alias("gram")))
    # A pair meets on the first gram that both have.
    meets = F.get(F.array_intersect("a.first", "b.first"), F.lit(0)) == F.col("a.gram")
    blocks = 2 * edits + 1
    size = PARITIES // blocks

    def part(bits, i):
        return F.shiftright(bits, i * size).bitwiseAND(F.lit((1 << size) - 1))

    cut = F.inline(F.array(*[F.struct(F.lit(i).alias("block"), part("bits", i).alias("part")) for i in range(blocks)]))
    few = placed.where(F.size("grams") <= 2 * changed).select("key", "id")
    by_block = stored(spark, rows.join(few, ["key", "id"], "left_semi").select("*", cut))
    differ = F.col("a.bits").bitwiseXOR(F.col("b.bits"))
    earliest = F.lit(True)
    for i in range(blocks - 1):
        earliest = earliest & ~((F.col("a.block") > i) & (part(differ, i) == 0))
    return _pairs(by_gram, ["key", "gram"], edits, meets).unionAll(
        _pairs(by_block, ["key", "block", "part"], edits, earliest)
    )


def links(spark, listed, edits=EDITS, min_chars=MIN_CHARS, crowd=CROWD):
    """(u, v): hashes of different lines within `edits` edits of each other, u < v, each pair once.

    Lines have at least `min_chars` characters, which is at least edits + 1. Copies of a line are
    one line here. Pairs of equal hash but different text are not linked. `crowd` moves work between
    two exact ways to meet and changes no result.
    """
    lines = _lines(listed, min_chars)
    keyed = probes(lines, edits, min_chars)
    # Copies of a line and their keys are combined before the shuffle.
    shared = stored(
        spark,
        keyed.groupBy("key")
        .agg(F.min("id").alias("low"), F.max("id").alias("high"), F.max("index").alias("indexed"))
        .where("low <> high AND indexed")
        .select("key"),
    )
    met = stored(spark, _only(keyed, shared, "key").distinct())
    meeting = stored(spark, met.select("id").distinct())
    texts = stored(
        spark,
        _only(lines.select("id", "line"), meeting, "id")
        .distinct()
        .withColumns({"bits": parities(F.col("line")), "letters": characters(F.col("line"))}),
    )
    marked = met.join(texts.select("id", "bits"), "id")
    crowded_keys = stored(spark, met.groupBy("key").agg(F.count("*").alias("rows")).where(F.col("rows") > crowd).select("key"))
    pairs = _pairs(marked.join(crowded_keys, "key", "left_anti"), ["key"], edits)
    if not crowded_keys.isEmpty():
        crowded = stored(spark, marked.join(crowded_keys, "key", "left_semi"))
        pairs = pairs.unionAll(_crowded_pairs(spark, crowded, texts, edits))
    pairs = pairs.distinct()
    one = texts.select(F.col("id").alias("u"), F.col("letters").alias("x"))
    other = texts.select(F.col("id").alias("v"), F.col("letters").alias("y"))
    apart = F.abs(F.size("x") - F.size("y")) <= edits
    found = pairs.join(one, "u").join(other, "v").where(apart)
    return stored(
        spark, found.where(edit_distance(F.col("x"), F.col("y"), edits) <= edits).select("u", "v").distinct()
    )


def line_classes(frame, edits=EDITS, min_chars=MIN_CHARS, **columns):
    """A row per different line: its first document, copies, class and links to other lines.

    A class holds the lines reachable over links of at most `edits` edits; class_id is the smallest
    line_id in it and class_doc_id the first document of any of its lines. Null texts have no
    lines; lines of fewer than `min_chars` characters are left out; white space around a line does
    not count. Null ids come after all others as first documents. Other columns are left out.
    """
    spark = frame.sparkSession
    listed = document_lines(frame, **columns)
    lines = stored(
        spark,
        _lines(listed, min_chars)
        .groupBy("id", "check")
        .agg(F.min("doc_id").alias("doc_id"), F.count("*").alias("copies"), F.first("n").alias("n_chars")),
    )
    found = links(spark, listed, edits, min_chars)
    reached = components(spark, found).withColumnRenamed("component", "class_id")
    degree = (
        found.select(F.explode(F.array("u", "v")).alias("node")).groupBy("node").agg(F.count("*").alias("links"))
    )
    linked = stored(spark, reached.join(degree, "node"))
    # Only linked lines need a look beyond their own row.
    firsts = linked.join(lines, linked.node == lines.id).groupBy("class_id").agg(F.min("doc_id").alias("class_doc_id"))
    members = linked.join(firsts, "class_id")
    return lines.join(members, lines.id == members.node, "left").select(
        "doc_id",
        F.col("id").alias("line_id"),
        F.col("n_chars").cast("bigint").alias("n_chars"),
        "copies",
        F.coalesce("class_doc_id", "doc_id").alias("class_doc_id"),
        F.coalesce("class_id", "id").alias("class_id"),
        F.coalesce("links", F.lit(0)).cast("bigint").alias("links"),
    )


def line_members(frame, edits=EDITS, min_chars=MIN_CHARS, **columns):
    """A row per document and different line in it: copies there, and the line's class.

    line_id and class_id are those of `line_classes`; it has one row per line, this one all holders
    of each. Rows of equal id are one document, those of null id too. Lines of fewer than
    `min_chars` characters are in it as well; too short for edits, they are alike only if equal.
    Null texts and empty lines have no rows. Other columns are left out.
    """
    spark = frame.sparkSession
    listed = document_lines(frame, **columns)
    # Copies of a line in a document are combined before the shuffle.
    held = stored(
        spark,
        _lines(listed, 1)
        .groupBy("doc_id", "id", "check")
        .agg(F.count("*").alias("copies"), F.first("n").alias("n_chars")),
    )
    reached = components(spark, links(spark, listed, edits, min_chars))
    return held.join(reached, held.id == reached.node, "left").select(
        "doc_id",
        F.col("id").alias("line_id"),
        F.col("n_chars").cast("bigint").alias("n_chars"),
        "copies",
        F.coalesce("component", "id").alias("class_id"),
    )


def op8_line_dedup(spark, folder):
    return line_classes(documents(spark, folder))


def op8_line_members(spark, folder):
    return line_members(documents(spark, folder))


def without_repeated_lines(frame, edits=EDITS, min_chars=MIN_CHARS, shorter=False):
    """The table with every line taken out that has an earlier line of its class.

    Earlier is a smaller doc_id (null last), then the order of texts' hashes, then the place in the
    text; rows equal in id and text are one document. Shorter lines stay, or with `shorter` go where
    an equal one is earlier. Empty lines and everything else in a text stay. n_chars is counted anew
    where a text changed.
    """
    spark = frame.sparkSession
    listed = document_lines(frame)
    found = links(spark, listed, edits, min_chars)
    reached = stored(spark, components(spark, found))
    places = _lines(listed, 1 if shorter else min_chars).select("doc_id", "tie", "at", "id", "check")
    placed = places.join(reached, places.id == reached.node, "left").select(
        "doc_id", "tie", "at", F.coalesce("component", "id").alias("class"),
        # Lines that nothing links are told apart by both hashes.
        F.when(F.col("component").isNull(), F.col("check")).otherwise(0).alias("check"),
    )
    placed = stored(spark, placed)
    order = F.struct(F.col("doc_id").isNull().alias("none"), "doc_id", "tie", "at")
    first = placed.groupBy("class", "check").agg(F.min(order).alias("first"), F.count("*").alias("copies")).where("copies > 1")
    gone = (
        placed.join(first, ["class", "check"])
        .where(order != F.col("first"))
        .groupBy("doc_id", "tie")
        .agg(F.collect_set("at").alias("gone"))
    )
    text = F.coalesce(F.col("text").cast("string"), F.lit(""))
    doc, own, out = unused(frame, "doc", "tie", "gone")
    marked = frame.withColumns({doc: F.col("doc_id").cast("bigint"), own: F.xxhash64(text)})
    same = F.col(f"d.{doc}").eqNullSafe(F.col("g.doc_id")) & (F.col(f"d.{own}") == F.col("g.tie"))
    joined = marked.alias("d").join(gone.alias("g"), same, "left").select("d.*", F.col("g.gone").alias(out))
    kept = F.array_join(
        F.filter(F.split("text", "\n"), lambda line, at: ~F.array_contains(out, at)), "\n"
    )
    changed = joined.withColumn("text", F.when(F.col(out).isNull(), F.col("text")).otherwise(kept))
    if "n_chars" in frame.columns:
        counted = F.when(F.col(out).isNull(), F.col("n_chars")).otherwise(F.char_length("text"))
        changed = changed.withColumn("n_chars", counted.cast(frame.schema["n_chars"].dataType))
    return changed.drop(doc, own, out)
