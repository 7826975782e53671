"""Token counts with a whole-token shortcut.

A sentencepiece BPE model merges within pre-tokens only, as long as no vocabulary string spans
their border. Which pre-tokens are a single token is proved once, offline, by encoding each
vocabulary string alone; those are counted by a look-up and only the rest is merged by the
library.
"""

import re

import public_tokenizers
import pyarrow as pa
import sentencepiece

from prefloom.llm.common import documents, steps, texts_of

MODEL = "piece_bpe_32k.model"
LIMIT = 4096
SPACE_MARK = "▁"
REMEMBERED = 400_000

# A run of spaces with what follows it, a rest of a line that no space opens, or a line break.
_PRE_TOKEN = re.compile(f"{SPACE_MARK}+[^{SPACE_MARK}\n]*|[^{SPACE_MARK}\n]+|\n")


def _strings(model):
    special = (model.is_control, model.is_unknown, model.is_byte)
    numbers = (n for n in range(model.vocab_size()) if not any(kind(n) for kind in special))
    return [model.id_to_piece(number) for number in numbers]


def check_borders(model):
    """Raise unless no vocabulary string spans the border of two pre-tokens: no space mark after
    another character, and no line break with something beside it."""
    for piece in _strings(model):
        if SPACE_MARK in piece.lstrip(SPACE_MARK) or ("\n" in piece and piece != "\n"):
            raise ValueError(f"vocabulary string {piece!r} spans a pre-token border")


class Alone:
    """Token counts of single pre-tokens, by the library.

    The library puts a space mark before every text; a line break keeps it away from the pre-token.
    """

    def __init__(self, model):
        self.encode, self.head = model.encode, len(model.encode("\n"))

    def __call__(self, pre_tokens):
        return [len(ids) - self.head for ids in self.encode(["\n" + p for p in pre_tokens], num_threads=1)]


def whole_tokens(model):
    """The vocabulary strings that encode alone as exactly one token."""
    strings = _strings(model)
    return [piece for piece, count in zip(strings, Alone(model)(strings)) if count == 1]


class Counts:
    """Token counts of texts: proved pre-tokens, and a bounded memory of merged ones."""

    def __init__(self, model, remembered=REMEMBERED):
        check_borders(model)
        self.alone, self.remembered = Alone(model), remembered
        self.proved = dict.fromkeys(whole_tokens(model), 1)
        self.known = dict(self.proved)

    def count(self, texts):
        split = [
            _PRE_TOKEN.findall(SPACE_MARK + text.replace(" ", SPACE_MARK)) if text else [] for text in texts
        ]
        if len(self.known) > self.remembered:
            self.known = dict(self.proved)
        unknown = list(set().union(*split).difference(self.known))
        if unknown:
            self.known.update(zip(unknown, self.alone(unknown)))
        return [sum(map(self.known.__getitem__, pre_tokens)) for pre_tokens in split]


def count_tokens(frame, path=None, limit=LIMIT, id_column="doc_id", text_column="text"):
    """Per row: id, UTF-8 bytes, tokens of the whole text and whether they are over the limit.

    Every input row gives one row, repeated ids and texts included; a null text counts as empty
    (0 bytes, 0 tokens); a null id stays null. Other columns are left out. No shuffle: rows are
    counted where they are read, in steps of bounded bytes.
    """
    path = path or public_tokenizers.path(MODEL)

    def count(batches):
        model = sentencepiece.SentencePieceProcessor(model_file=path)
        counts = Counts(model)
        for batch in steps(batches):
            texts = texts_of(batch).to_numpy(zero_copy_only=False)
            tokens = counts.count(texts)
            yield pa.RecordBatch.from_arrays(
                [
                    batch.column("doc_id"),
                    pa.array([len(text.encode()) for text in texts], pa.int64()),
                    pa.array(tokens, pa.int64()),
                    pa.array([n > limit for n in tokens], pa.bool_()),
                ],
                ["doc_id", "n_bytes", "n_tokens", "over_limit"],
            )

    rows = frame.selectExpr(f"CAST(`{id_column}` AS BIGINT) AS doc_id", f"CAST(`{text_column}` AS STRING) AS text")
    return rows.mapInArrow(count, "doc_id BIGINT, n_bytes BIGINT, n_tokens BIGINT, over_limit BOOLEAN")


def op4_token_counts(spark, folder):
    return count_tokens(documents(spark, folder))
