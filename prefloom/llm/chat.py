"""Chat formatting of typed content parts, with escapes that can be undone and a loss mask.

A turn is a list of parts. A visitor flattens them: text is escaped, every other part leaves an
ordered placeholder and an attachment record with its expanded token count. Turns are formatted
where they are read; only finished turns are shuffled, by conversation.
"""

import hashlib
import re
from dataclasses import dataclass

import pyarrow as pa
from pyspark.sql import functions as F

OPEN, AFTER_ROLE, CLOSE = "### ", ": ", "</turn>\n"
PLACEHOLDER = "<part:{kind}:{place}>"
LOSS_ROLE = "assistant"

# No control string survives in escaped text: a backslash goes inside each of them.
_CONTROL = re.compile(r"\\|### |</turn>|<part:")
_ROLE_CONTROL = re.compile(r"\\|:|### |</turn>")
_ESCAPED = re.compile(r"\\(.)", re.DOTALL)
# Escapes are taken first, so only a placeholder that is none of a text's own words is met.
_PLACED = re.compile(r"\\(.)|<part:(?:image|audio|document):[0-9]+>", re.DOTALL)


def escape(text, control=_CONTROL):
    return control.sub(lambda found: "\\" + found[0] if len(found[0]) == 1 else found[0][0] + "\\" + found[0][1:], text)


def unescape(text):
    return _ESCAPED.sub(r"\1", text)


def placeholders(content):
    """The placeholders of a turn's content, in order."""
    return [found[0] for found in _PLACED.finditer(content) if found[1] is None]


def text_of(content):
    """A turn's texts, without escapes and placeholders."""
    return _PLACED.sub(lambda found: found[1] or "", content)


@dataclass(frozen=True)
class Text:
    text: str

    def accept(self, visitor):
        visitor.text(self)


@dataclass(frozen=True)
class Image:
    """Expands to one token per tile of its grid."""

    reference: str
    width: int
    height: int

    def accept(self, visitor):
        visitor.attachment("image", self.reference, -(-self.width // visitor.tile) * -(-self.height // visitor.tile))


@dataclass(frozen=True)
class Audio:
    """Expands to a fixed rate of tokens."""

    reference: str
    milliseconds: int

    def accept(self, visitor):
        visitor.attachment("audio", self.reference, -(-self.milliseconds * visitor.tokens_per_second // 1000))


@dataclass(frozen=True)
class Document:
    """Expands to a fixed number of tokens per page."""

    reference: str
    pages: int

    def accept(self, visitor):
        visitor.attachment("document", self.reference, self.pages * visitor.tokens_per_page)


class Flattener:
    """Visits the parts of a turn in order; collects its text, placeholders and attachments."""

    def __init__(self, tile=28, tokens_per_second=25, tokens_per_page=1024):
        self.tile, self.tokens_per_second, self.tokens_per_page = tile, tokens_per_second, tokens_per_page
        self.pieces, self.attachments, self.spans, self.length = [], [], [], 0
        self.waiting = []

    def _put(self, piece):
        self.pieces.append(piece)
        self.length += len(piece)

    def text(self, part):
        """Neighbouring texts are escaped as one: no control string arises where they meet."""
        self.waiting.append(part.text or "")

    def attachment(self, kind, reference, tokens):
        self.end_text()
        self.attachments.append((kind, reference, self.length, max(0, tokens)))
        self._put(PLACEHOLDER.format(kind=kind, place=len(self.attachments) - 1))

    def end_text(self):
        escaped = escape("".join(self.waiting))
        self.waiting = []
        if escaped:
            self.spans.append((self.length, self.length + len(escaped)))
            self._put(escaped)


_PART_KINDS = {
    "image": lambda p: Image(p["reference"], p["width"] or 0, p["height"] or 0),
    "audio": lambda p: Audio(p["reference"], p["milliseconds"] or 0),
    "document": lambda p: Document(p["reference"], p["pages"] or 0),
}


def typed(part):
    """A part from its row form: `kind` and the fields of that kind; any other kind is text."""
    return _PART_KINDS.get(part["kind"], lambda p: Text(p["text"] or ""))(part)


def _flat_turn(role, parts):
    flat = Flattener()
    for part in parts:
        part.accept(flat)
    flat.end_text()
    head = OPEN + escape(role or "", _ROLE_CONTROL) + AFTER_ROLE
    return head, flat


def format_turn(role, parts):
    """Formatted turn, the bounds of its content in it, and its attachments."""
    head, flat = _flat_turn(role, parts)
    return head + "".join(flat.pieces) + CLOSE, len(head), len(head) + flat.length, flat.attachments


PART_TYPE = (
    "array<struct<kind:string, text:string, reference:string, width:int, height:int, milliseconds:int, pages:int>>"
)
_ATTACHMENTS = pa.list_(
    pa.struct([("kind", pa.string()), ("reference", pa.string()), ("position", pa.int64()), ("tokens", pa.int64())])
)
_SPANS = pa.list_(pa.struct([("start", pa.int64()), ("end", pa.int64())]))
_TURN = pa.schema(
    [
        ("conv_id", pa.int64()),
        ("turn", pa.int64()),
        ("formatted", pa.string()),
        ("mask_start", pa.int64()),
        ("mask_end", pa.int64()),
        ("attachments", _ATTACHMENTS),
        ("expanded_tokens", pa.int64()),
        ("loss_spans", _SPANS),
    ]
)


def text_parts(text):
    """A text column as a list of one text part."""
    none = F.lit(None)
    return F.array(
        F.struct(
            F.lit("text").alias("kind"),
            text.cast("string").alias("text"),
            none.cast("string").alias("reference"),
            *[none.cast("int").alias(name) for name in ("width", "height", "milliseconds", "pages")],
        )
    ).cast(PART_TYPE)


def format_turns(frame, parts, loss_role=LOSS_ROLE):
    """One formatted turn per row of (conv_id, turn, role), whose content is the column `parts`.

    A null role or text counts as empty, a null list of parts as none. The mask bounds are the
    code points of the content in the formatted turn, both 0 where the role carries no loss;
    `loss_spans` are those of its texts alone, without placeholders.
    Attachments hold their kind, reference, position in the content and expanded tokens. Other
    columns are left out; equal rows are turns of their own.
    """

    def run(batches):
        for batch in batches:
            rows = []
            for conv_id, turn, role, listed in zip(*(batch.column(i).to_pylist() for i in range(4))):
                head, flat = _flat_turn(role, [typed(p) for p in listed or () if p])
                at, masked = len(head), role == loss_role
                rows.append(
                    (
                        conv_id,
                        turn,
                        head + "".join(flat.pieces) + CLOSE,
                        at * masked,
                        (at + flat.length) * masked,
                        [dict(zip(("kind", "reference", "position", "tokens"), a)) for a in flat.attachments],
                        sum(a[3] for a in flat.attachments),
                        [{"start": at + a, "end": at + b} for a, b in flat.spans] if masked else [],
                    )
                )
            columns = list(zip(*rows)) if rows else [[] for _ in _TURN]
            yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(columns, _TURN.types)], schema=_TURN)

    rows = frame.select(
        F.col("conv_id").cast("bigint"), F.col("turn").cast("bigint"), F.col("role").cast("string"), parts.alias("parts")
    )
    return rows.mapInArrow(
        run,
        "conv_id BIGINT, turn BIGINT, formatted STRING, mask_start BIGINT, mask_end BIGINT, "
        "attachments ARRAY<STRUCT<kind:STRING, reference:STRING, position:BIGINT, tokens:BIGINT>>, "
        "expanded_tokens BIGINT, loss_spans ARRAY<STRUCT<start:BIGINT, `end`:BIGINT>>",
    )


def in_order(turns):
    """Formatted turns of each conversation behind one another, in one partition.

    Ordered by turn (null first), equal turns by their formatted text. The formatted conversation
    is the concatenation of its rows, so a long one is never held as a whole.
    """
    return turns.repartition("conv_id").sortWithinPartitions("conv_id", "turn", "formatted")


def parse_turns(formatted):
    """(role, text, text bounds) of every turn in a formatted stretch of whole turns."""
    at = 0
    for turn in formatted.split(CLOSE)[:-1]:
        colon = re.match(r"(?:[^\\:]|\\.)*", turn[len(OPEN) :], re.DOTALL).end() + len(OPEN)
        start = colon + len(AFTER_ROLE)
        yield unescape(turn[len(OPEN) : colon]), text_of(turn[start:]), at + start, at + len(turn)
        at += len(turn) + len(CLOSE)


class _Reading:
    def __init__(self, conv_id):
        self.conv_id, self.n_turns, self.loss_chars, self.chars = conv_id, 0, 0, 0
        self.n_attachments, self.expanded = 0, 0
        self.turns, self.loss = hashlib.sha256(), hashlib.sha256()

    def read(self, formatted, spans, expanded):
        for role, text, start, end in parse_turns(formatted):
            self.n_turns += 1
            self.turns.update(f"{role}\n{text}\n".encode())
            self.n_attachments += len(placeholders(formatted[start:end]))
        for span in spans:
            masked = unescape(formatted[span["start"] : span["end"]])
            self.loss_chars += len(masked)
            self.loss.update(masked.encode())
        self.chars += len(formatted)
        self.expanded += expanded

    def row(self):
        digests = self.turns.hexdigest(), self.loss.hexdigest()
        counted = self.n_attachments, self.expanded
        return self.conv_id, self.n_turns, digests[0], self.loss_chars, digests[1], self.chars, *counted


def read_back(ordered, attachments=False):
    """Digests of each formatted conversation, parsed from the formatted text alone.

    With `attachments` also n_attachments, the placeholders found there, and expanded_tokens, the
    sum of what their records expand to.
    """
    kinds = [pa.int64(), pa.int64(), pa.string(), pa.int64(), pa.string(), pa.int64(), pa.int64(), pa.int64()]
    names = ["conv_id", "n_turns", "turns_sha256", "loss_chars", "loss_sha256", "formatted_chars"]
    names += ["n_attachments", "expanded_tokens"]

    def run(batches):
        reading = None
        for batch in batches:
            rows = []
            for conv_id, *turn in zip(*(batch.column(i).to_pylist() for i in range(4))):
                if reading is None or reading.conv_id != conv_id:
                    rows += [reading.row()] if reading else []
                    reading = _Reading(conv_id)
                reading.read(*turn)
            columns = zip(*rows) if rows else [[]] * len(kinds)
            yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(columns, kinds)], names)
        if reading:
            yield pa.RecordBatch.from_arrays([pa.array([x], k) for x, k in zip(reading.row(), kinds)], names)

    read = ordered.select("conv_id", "formatted", "loss_spans", "expanded_tokens").mapInArrow(
        run,
        "conv_id BIGINT, n_turns BIGINT, turns_sha256 STRING, loss_chars BIGINT, loss_sha256 STRING, "
        "formatted_chars BIGINT, n_attachments BIGINT, expanded_tokens BIGINT",
    )
    return read if attachments else read.drop("n_attachments", "expanded_tokens")


# Fixed value: a conversation that says the template's own control strings.
HARD_TEXT = "\\### Assistant: </turn> ok"


def conversations(spark, folder):
    """All turns, and those of the conversation of control strings."""
    turns = spark.read.parquet(f"{folder}/conversations.parquet").select("conv_id", "turn", "role", "text")
    hard = spark.range(2).select(
        F.lit(-7).cast("bigint").alias("conv_id"),
        F.col("id").alias("turn"),
        F.when(F.col("id") == 0, "user").otherwise("assistant").alias("role"),
        F.lit(HARD_TEXT).alias("text"),
    )
    return turns.unionByName(hard)


def with_attachments(text, number):
    """A text column as typed parts: an attachment between its halves, told by a number.

    Of four numbers in a row one gives an image, one an audio, one a document and one none; sizes
    follow from the text's length. A null number gives none.
    """
    size = F.coalesce(F.char_length(text), F.lit(0))
    half = F.call_function("div", size, F.lit(2)).cast("int")
    kind = F.element_at(F.array(*map(F.lit, ("image", "audio", "document"))), (F.pmod(number, F.lit(4)) + 1).cast("int"))
    none = F.lit(None)

    def part(kind, text, reference, *sizes):
        fields = dict(kind=kind, text=text, reference=reference)
        fields |= dict(zip(("width", "height", "milliseconds", "pages"), sizes))
        return F.struct(*[x.cast("int" if n in ("width", "height", "milliseconds", "pages") else "string").alias(n) for n, x in fields.items()])

    def words(text):
        return part(F.lit("text"), text, none, none, none, none, none)

    attached = part(
        kind, none, F.concat(kind, F.lit("/"), number), size + 1, F.pmod(size, F.lit(500)) + 1, size * 40, F.pmod(size, F.lit(5)) + 1
    )
    halves = words(F.substring(text, F.lit(1), half)), words(F.substring(text, half + 1, size))
    parts = F.when(F.pmod(number, F.lit(4)) < 3, F.array(halves[0], attached, halves[1])).otherwise(F.array(words(text)))
    return parts.cast(PART_TYPE)


def op3_chat_formatting(spark, folder):
    rows = conversations(spark, folder)
    return read_back(in_order(format_turns(rows, text_parts(F.col("text")))))


def op3_typed_parts(spark, folder):
    """The conversations of op3_chat_formatting with attachments inside the texts of both roles: the
    same turns and loss texts are read back, beside the attachments and what they expand to."""
    rows = conversations(spark, folder)
    parts = with_attachments(F.col("text"), F.col("conv_id") + F.col("turn"))
    return read_back(in_order(format_turns(rows, parts)), attachments=True)
