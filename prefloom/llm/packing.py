"""Hierarchical packing of documents into sequences of several lengths.

A document goes to the tier of the smallest window that holds it; what exceeds the longest window
fills windows of its own. A window of any tier holds one document of its tier, since two would not
fit. Its gap is filled with the largest documents of shorter tiers that fit and closed with a
cut, so a closed window has no padding. Only what is left at the end of a partition is laid end
to end.
"""

import bisect
import json
from array import array

import numpy as np
import public_tokenizers
import pyarrow as pa
import regex
import tiktoken
from pyspark import TaskContext
from pyspark.sql import functions as F
from tokenizers import Tokenizer

from prefloom.llm.common import coded, documents, ragged, steps, texts_of, words_of

VOCABULARY = "word_bpe_49k.json"
END = 2
TIERS = (256, 512, 1024, 2048, 4096)
# Tokens that wait for partners in one task, and tokens of one step group.
HELD_TOKENS = 1 << 20
STEP_TOKENS = 1 << 18
REMEMBERED = 400_000

# Letters of these two ranges need no normalisation beyond lower case.
_PLAIN = regex.compile(r"[!-~À-ÿ]+")
_SPLIT = regex.compile(r"'s|'t|'re|'ve|'m|'ll|'d|[\p{L}]+|[\p{N}]|[^\s\p{L}\p{N}]+")
_MARK, _SUFFIX = b"\xff", "</w>"


def proved_ranks(path):
    """Byte strings and ids of the vocabulary strings that merging builds from their own letters.

    A word's last letter carries an end mark, here one more byte that no UTF-8 text holds. Done
    once, before any text is read.
    """
    with open(path) as file:
        model = json.load(file)["model"]
    vocabulary, byte_of = model["vocab"], _byte_letters()
    rank = {}
    for pair in model["merges"]:
        rank.setdefault(tuple(pair.split(" ") if isinstance(pair, str) else pair), len(rank))
    ids = [vocabulary["".join(pair)] for pair in rank]
    if any(a >= b for a, b in zip(ids, ids[1:])):
        raise ValueError("ids do not follow the order of the merges")
    proved = {}
    for token, number in vocabulary.items():
        ended = token.endswith(_SUFFIX)
        body = token[: -len(_SUFFIX)] if ended else token
        if not body or not all(letter in byte_of for letter in body):
            continue
        parts = list(body)
        parts[-1] += _SUFFIX * ended
        while len(parts) > 1:
            ranks = [rank.get(pair, len(rank)) for pair in zip(parts, parts[1:])]
            best = min(range(len(ranks)), key=ranks.__getitem__)
            if ranks[best] == len(rank):
                break
            parts[best : best + 2] = [parts[best] + parts[best + 1]]
        if len(parts) == 1:
            proved[bytes(byte_of[letter] for letter in body) + _MARK * ended] = number
    return proved


class WordIds:
    """Token ids of white-space words, equal to the library's.

    White space never survives the tokenizer's splitter, so a text's ids are its words' ids in
    order. Pre-tokens of plain letters go to a rank-based merger over the proved strings of the
    same vocabulary. The two mergers agree: ranks follow the order of the merges, and a proved
    string's last two parts can only be the pair that the library's merge names. Everything else
    is left to the library.
    """

    def __init__(self, path, ranks, remembered=REMEMBERED):
        self.library = Tokenizer.from_file(path)
        self.remembered, self.ids, self.pieces = remembered, {}, {}
        self.special = [token.content for token in self.library.get_added_tokens_decoder().values()]
        self.merger = tiktoken.Encoding(
            "words", pat_str=r"[\s\S]+", mergeable_ranks=ranks, special_tokens={}
        )._core_bpe

    def encode(self, word):
        """Ids of one white-space word, as little-endian bytes."""
        if word.isascii() or _PLAIN.fullmatch(word):
            lower = word.lower()
            if lower.isalpha():
                return self.piece(lower)
            if lower[:-1].isalpha() and lower[-1] in ".,;:!?":
                return self.piece(lower[:-1]) + self.piece(lower[-1])
            if word.isprintable() and not any(text in word for text in self.special):
                return b"".join(map(self.piece, _SPLIT.findall(lower)))
        return array("I", self.library.encode(word, add_special_tokens=False).ids).tobytes()

    def piece(self, piece):
        ids = self.pieces.get(piece)
        if ids is None:
            ids = array("I", self.merger.encode_single_piece(piece.encode() + _MARK)).tobytes()
            self.pieces[piece] = ids
        return ids

    def look_up(self, words):
        """Flat ids and the number of ids of each word."""
        if len(self.ids) > self.remembered:
            self.ids.clear()
            self.pieces.clear()
        found, ids = [], self.ids
        for word in words:
            known = ids.get(word)
            if known is None:
                known = ids[word] = self.encode(word)
            found.append(known)
        return np.frombuffer(b"".join(found), dtype="<u4"), np.array([len(x) >> 2 for x in found], dtype=np.int64)

    def encode_texts(self, texts, end=END):
        """Ids of each text of an Arrow array, followed by `end`: flat ids, bounds per text."""
        words, bounds = words_of(texts)
        distinct, places = coded(words)
        ids, lengths = self.look_up(distinct.to_numpy(zero_copy_only=False))
        starts = np.cumsum(lengths) - lengths
        flat = ids[ragged(starts[places], lengths[places])]
        before = np.concatenate([[0], np.cumsum(lengths[places])])[bounds]
        n = len(bounds) - 1
        flat = np.insert(flat, before[1:], end).astype("<u4")
        return flat, before + np.arange(n + 1)


def _byte_letters():
    """The letters by which byte-level vocabularies spell bytes."""
    printable = [*range(0x21, 0x7F), *range(0xA1, 0xAD), *range(0xAE, 0x100)]
    letters = {chr(byte): byte for byte in printable}
    rest = (byte for byte in range(256) if byte not in set(printable))
    return letters | {chr(256 + place): byte for place, byte in enumerate(rest)}


class _Pool:
    """Waiting pieces by length: (length, arrival, ids, doc_id, start, doc_tokens)."""

    def __init__(self):
        self.items, self.tokens, self.arrivals = [], 0, 0

    def add(self, ids, doc_id, start, doc_tokens):
        bisect.insort(self.items, (len(ids), self.arrivals, ids, doc_id, start, doc_tokens), key=lambda x: x[:2])
        self.tokens, self.arrivals = self.tokens + len(ids), self.arrivals + 1

    def take(self, place=-1):
        item = self.items.pop(place)
        self.tokens -= item[0]
        return item

    def fill(self, gap):
        """The largest piece of at most `gap` tokens, or else the largest one cut to `gap`."""
        place = bisect.bisect_right(self.items, gap, key=lambda x: x[0]) - 1
        if place >= 0:
            return self.take(place)
        length, _, ids, doc_id, start, doc_tokens = self.take()
        self.add(ids[gap:], doc_id, start + gap, doc_tokens)
        return gap, 0, ids[:gap], doc_id, start, doc_tokens


class Packer:
    """Packs a stream of documents; emits pieces with the sequence that holds them."""

    def __init__(self, base, tiers=TIERS, held=HELD_TOKENS, step_tokens=STEP_TOKENS):
        if any(tier & (tier - 1) or tier < 1 for tier in tiers):
            raise ValueError("window lengths are powers of two")
        self.tiers, self.held, self.step_tokens = sorted(tiers), held, step_tokens
        self.base, self.sequences, self.pool, self.rows = base, 0, _Pool(), []
        self.windows = {}

    def add(self, ids, doc_id):
        longest, n, start = self.tiers[-1], len(ids), 0
        while n - start > longest:
            self._close([(longest, 0, ids[start : start + longest], doc_id, start, n)], longest)
            start += longest
        self.pool.add(ids[start:], doc_id, start, n)
        if self.pool.tokens > self.held:
            self._pack()

    def _pack(self):
        """Close windows from the longest tier to the shortest until fewer tokens than one wait."""
        while self.pool.items:
            length = self.pool.items[-1][0]
            window = self.tiers[bisect.bisect_left(self.tiers, length)]
            if self.pool.tokens < window:
                return
            pieces = [self.pool.take()]
            gap = window - length
            while gap:
                pieces.append(self.pool.fill(gap))
                gap -= pieces[-1][0]
            self._close(pieces, window)

    def finish(self):
        """Lay what still waits end to end, in windows of falling powers of two."""
        self._pack()
        while self.pool.tokens:
            window = 1 << (self.pool.tokens.bit_length() - 1)
            pieces, gap = [], window
            while gap:
                pieces.append(self.pool.fill(gap))
                gap -= pieces[-1][0]
            self._close(pieces, window)

    def _close(self, pieces, window):
        """Number a window; windows of one length join step groups of equal numbers of tokens."""
        number = self.windows.get(window, 0)
        self.windows[window] = number + 1
        step = self.base + (window.bit_length() << 30) + number // max(1, self.step_tokens // window)
        offset = 0
        for length, _, ids, doc_id, start, doc_tokens in pieces:
            self.rows.append(
                (doc_id, start, length, ids.tobytes(), doc_tokens, self.base + self.sequences, offset, window, step)
            )
            offset += length
        self.sequences += 1

    def emitted(self):
        rows, self.rows = self.rows, []
        return rows


PIECES = pa.schema(
    [
        ("doc_id", pa.int64()),
        ("start", pa.int64()),
        ("length", pa.int64()),
        ("ids", pa.binary()),
        ("doc_tokens", pa.int64()),
        ("sequence_id", pa.int64()),
        ("offset", pa.int64()),
        ("window", pa.int64()),
        ("step_id", pa.int64()),
    ]
)


def pack(frame, path=None, tiers=TIERS, end=END, id_column="doc_id", text_column="text"):
    """Pieces of tokenized documents: ids (little-endian, 4 bytes each) and where they lie.

    Every input row is a document of its own, repeated ids and texts included; a null text counts
    as empty and still yields its end id; a null id stays null. Other columns are left out. Each
    id of a document lies in exactly one piece; sequences have no padding. Rows are packed where
    they are read: no shuffle, and a task holds at most HELD_TOKENS waiting ids and one text. A
    task that runs anew on the same split gives the same pieces and numbers.
    """
    path = path or public_tokenizers.path(VOCABULARY)
    session = frame.sparkSession
    ranks = session.sparkContext.broadcast(proved_ranks(path))  # as large as the vocabulary

    def run(batches):
        coder = WordIds(path, ranks.value)
        packer = Packer(TaskContext.get().partitionId() << 40, tiers)

        def emit():
            rows = packer.emitted()
            columns = zip(*rows) if rows else [[] for _ in PIECES]
            return pa.RecordBatch.from_arrays(
                [pa.array(column, kind) for column, kind in zip(columns, PIECES.types)], schema=PIECES
            )

        for batch in steps(batches):
            ids, bounds = coder.encode_texts(texts_of(batch), end)
            for place, doc_id in enumerate(batch.column("doc_id").to_pylist()):
                packer.add(ids[bounds[place] : bounds[place + 1]], doc_id)
            yield emit()
        packer.finish()
        yield emit()

    rows = frame.selectExpr(f"CAST(`{id_column}` AS BIGINT) AS doc_id", f"CAST(`{text_column}` AS STRING) AS text")
    return rows.mapInArrow(
        run,
        "doc_id BIGINT, start BIGINT, length BIGINT, ids BINARY, doc_tokens BIGINT, sequence_id BIGINT, "
        "offset BIGINT, window BIGINT, step_id BIGINT",
    )


def op2_packing(spark, folder):
    pieces = pack(documents(spark, folder))
    return pieces.withColumn("ids_crc32", F.crc32("ids")).drop("ids")
