"""Transcript text as column expressions."""

from pyspark.sql import functions as F

# The marker that opens an assistant turn, and the cut used when it is absent
# (a last-index search answers -1, and -1 plus the marker's 12 characters leaves 11).
ASSISTANT_MARKER = "\n\nAssistant:"
NO_MARKER_CUT = 11

# Speaker names used inside a transcript.
SPEAKERS = {"user": "Human", "assistant": "Assistant", "system": "System"}

# The characters Python's str.strip removes. Spark's trim knows only the space, and \s in a
# regular expression misses some of these, so stripping always names the list.
STRIP_CHARS = "".join(chr(c) for c in range(0x3001) if chr(c).isspace())

# A token is a run of anything but ASCII white space; both \S dialects in use disagree on \v.
TOKEN_PATTERN = r"[^ \t\n\r\f\x0B]+"


def strip(text):
    return F.btrim(text, F.lit(STRIP_CHARS))


def _tail(transcript):
    """What follows the last marker; the whole transcript when there is none."""
    return F.substring_index(transcript, ASSISTANT_MARKER, -1)


def _head_bytes(transcript):
    """Length up to the end of the last marker, 0 without one.

    Byte lengths are stored with a string, character lengths have to be counted: cutting by
    bytes spares several passes over each transcript.
    """
    return F.octet_length(transcript) - F.octet_length(_tail(transcript))


def has_marker(transcript):
    return _head_bytes(transcript) > 0


def prompt_of(transcript):
    """Everything up to and including the last marker."""
    head = F.substring(transcript.cast("binary"), F.lit(1), _head_bytes(transcript)).cast("string")
    return F.when(has_marker(transcript), head).otherwise(F.left(transcript, F.lit(NO_MARKER_CUT)))


def response_of(transcript):
    """Everything after the last marker, stripped."""
    rest = F.substring(transcript, F.lit(NO_MARKER_CUT + 1), F.length(transcript))
    return strip(F.when(has_marker(transcript), _tail(transcript)).otherwise(rest))


def transcript_of(prompt, response):
    """Prompt and response joined by one space, as in training text and labelled pairs."""
    return F.concat(prompt, F.lit(" "), response)


def reward_input_of(prompt, response):
    """Prompt and response with nothing between them, as the reward model reads them."""
    return F.concat(prompt, response)


def tokens(text):
    return F.regexp_extract_all(text, F.lit(TOKEN_PATTERN), F.lit(0))


def keep_tokens(token_array, budget, side="head"):
    """The first or last `budget` tokens."""
    if budget < 1:
        raise ValueError("budget must be positive")
    if side == "head":
        return F.slice(token_array, 1, budget)
    if side == "tail":
        size = F.size(token_array)
        return F.slice(token_array, F.greatest(size - budget + 1, F.lit(1)), F.lit(budget))
    raise ValueError("side is 'head' or 'tail'")
