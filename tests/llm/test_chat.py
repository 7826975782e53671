import hashlib
from collections import defaultdict

from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from prefloom.llm import chat
from tests.llm.helpers import SMALL

TEXT = st.lists(st.sampled_from(["\\", "### ", "</turn>", "\n", "<part:", ":", ": ", "a", "#", "</tur", "n>"])).map("".join)


@settings(max_examples=500, deadline=None)
@given(st.lists(st.tuples(TEXT, TEXT), max_size=4))
def test_round_trip(turns):
    formatted = "".join(chat.format_turn(role, [chat.Text(text)])[0] for role, text in turns)
    read = list(chat.parse_turns(formatted))
    assert [(role, text) for role, text, _, _ in read] == turns
    assert [chat.unescape(formatted[a:b]) for _, _, a, b in read] == [text for _, text in turns]


def test_typed_parts_become_ordered_placeholders(spark):
    parts = [
        chat.Text("look: <part:image:0> "),
        chat.Image("i.png", 57, 28),
        chat.Audio("a.wav", 1001),
        chat.Document("d.pdf", 2),
        chat.Text(" end"),
    ]
    formatted, start, end, attachments = chat.format_turn("user", parts)
    assert [(a[0], a[1], a[3]) for a in attachments] == [("image", "i.png", 3), ("audio", "a.wav", 26), ("document", "d.pdf", 2048)]
    content = formatted[start:end]
    assert [content[a[2] :].split(">")[0] for a in attachments] == ["<part:image:0", "<part:audio:1", "<part:document:2"]
    rows = spark.createDataFrame(
        [(1, 0, "user", [("image", None, "i.png", 57, 28, None, None), None, ("text", None, None, None, None, None, None)]), (1, 1, "assistant", None)],
        f"conv_id BIGINT, turn BIGINT, role STRING, content {chat.PART_TYPE}",
    )
    found = chat.format_turns(rows, F.col("content")).orderBy("turn").collect()
    assert found[0].attachments[0].tokens == found[0].expanded_tokens == 3 and found[1].attachments == []
    assert found[0].mask_end == 0 and found[1].mask_end == len("### assistant: ")


def brute(rows):
    turns = defaultdict(list)
    for conv_id, turn, role, text in rows:
        turns[conv_id].append((turn is not None, turn or 0, chat.format_turn(role, [chat.Text(text)])[0], role or "", text or ""))
    found = {}
    for conv_id, listed in turns.items():
        listed.sort()
        loss = "".join(t[4] for t in listed if t[3] == "assistant")
        everything = "".join(f"{t[3]}\n{t[4]}\n" for t in listed)
        sha = [hashlib.sha256(x.encode()).hexdigest() for x in (everything, loss)]
        found[conv_id] = (conv_id, len(listed), sha[0], len(loss), sha[1], sum(len(t[2]) for t in listed))
    return found


def test_query_3_equals_brute_force(spark):
    rows = [tuple(r) for r in spark.read.parquet(f"{SMALL}/conversations.parquet").select("conv_id", "turn", "role", "text").collect()]
    rows += [(-7, 0, "user", chat.HARD_TEXT), (-7, 1, "assistant", chat.HARD_TEXT)]
    got = {r.conv_id: tuple(r) for r in chat.op3_chat_formatting(spark, SMALL).collect()}
    assert got == brute(rows)


def test_odd_turns(spark):
    rows = [(1, 0, None, None), (1, 0, "assistant", "x"), (1, 0, "assistant", "x"), (None, None, "a:b", ""), (2, None, "assistant", "y" * 70_000)]
    frame = spark.createDataFrame([(*r, "e", "e") for r in rows], "conv_id BIGINT, turn BIGINT, role STRING, text STRING, formatted STRING, parts STRING")
    ordered = chat.in_order(chat.format_turns(frame, chat.text_parts(F.col("text"))))
    assert {r.conv_id: tuple(r) for r in chat.read_back(ordered).collect()} == brute(rows)
    assert chat.read_back(chat.in_order(chat.format_turns(frame.limit(0), chat.text_parts(F.col("text"))))).count() == 0


def test_neighbouring_texts_make_no_control_string():
    parts = [chat.Text("</tu"), chat.Text("rn>\n##"), chat.Text("# x"), chat.Image("i", 1, 1), chat.Text("<part:image:0>"), chat.Text("\\")]
    formatted, start, end, _ = chat.format_turn("user", parts)
    assert [t[:2] for t in chat.parse_turns(formatted)] == [("user", "</turn>\n### x<part:image:0>\\")]
    assert chat.placeholders(formatted[start:end]) == ["<part:image:0>"]


def test_typed_query_reads_the_same_texts_back(spark):
    plain = {r.conv_id: r for r in chat.op3_chat_formatting(spark, SMALL).collect()}
    typed = {r.conv_id: r for r in chat.op3_typed_parts(spark, SMALL).collect()}
    assert set(plain) == set(typed)
    for name in ("n_turns", "turns_sha256", "loss_chars", "loss_sha256"):
        assert all(plain[i][name] == typed[i][name] for i in plain)
    want = defaultdict(lambda: [0, 0, 0])
    rows = [tuple(r) for r in chat.conversations(spark, SMALL).collect()]
    for conv_id, turn, _, text in rows:
        size, kind = len(text or ""), (conv_id + turn) % 4
        if kind < 3:
            tokens = (-(-(size + 1) // 28) * -(-(size % 500 + 1) // 28), -(-size * 40 * 25 // 1000), (size % 5 + 1) * 1024)[kind]
            want[conv_id][0] += 1
            want[conv_id][1] += tokens
            want[conv_id][2] += len(chat.PLACEHOLDER.format(kind=("image", "audio", "document")[kind], place=0))
    for i, r in typed.items():
        assert [r.n_attachments, r.expanded_tokens] == want[i][:2]
    assert sum(r.n_attachments for r in typed.values()) > 0
    # A text cut in its middle may need fewer escapes, never more.
    assert all(r.formatted_chars <= plain[i].formatted_chars + want[i][2] for i, r in typed.items())


def test_loss_spans_leave_placeholders_out(spark):
    part = ("image", None, "i.png", 10, 10, None, None)
    text = ("text", "a\\b", None, None, None, None, None)
    frame = spark.createDataFrame(
        [(1, 0, "assistant", [text, part, text]), (1, 1, "user", [text])], f"conv_id BIGINT, turn BIGINT, role STRING, content {chat.PART_TYPE}"
    )
    found = chat.format_turns(frame, F.col("content")).orderBy("turn").collect()
    assert [found[0].formatted[s.start : s.end] for s in found[0].loss_spans] == ["a\\\\b", "a\\\\b"] and found[1].loss_spans == []
