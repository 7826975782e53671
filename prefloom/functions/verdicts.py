"""Judge verdicts as a sign: +1 prefers side A, -1 prefers side B, 0 is a tie.

A sign makes the un-swap one multiplication and keeps the aggregation buffer fixed-width, so
resolving retries runs as a hash aggregate instead of sorting verdict texts.
"""

from pyspark.sql import functions as F

from prefloom.functions.text import strip

A, B, TIE = 1, -1, 0


def _sides(raw):
    text = F.upper(raw)
    return F.contains(text, F.lit("A")), F.contains(text, F.lit("B"))


def read_tie_aware(raw):
    """A alone is A, B alone is B, both or neither is a tie. A null stays null."""
    has_a, has_b = _sides(raw)
    return has_a.cast("int") - has_b.cast("int")


def read_forced(raw):
    """A alone is A, everything else is B. A null stays null."""
    has_a, has_b = _sides(raw)
    return F.when(raw.isNull(), None).when(has_a & ~has_b, A).otherwise(B)


def read_strict(raw):
    """Only a reply that is exactly one of the allowed tokens counts; others are null."""
    token = F.upper(strip(raw))
    return F.when(token == "A", A).when(token == "B", B).when(token == "TIE", TIE)


READINGS = {"tie_aware": read_tie_aware, "forced": read_forced, "strict": read_strict}


def letter(sign):
    return F.when(sign > 0, "A").when(sign < 0, "B").when(sign == 0, "TIE")


def is_swapped(seed, *keys):
    """A repeatable coin per item: true shows side B first."""
    text = F.concat_ws("|", F.lit(seed), *[key.cast("string") for key in keys])
    return F.substring(F.md5(text), 1, 1) < "8"


def unswap(sign, swapped):
    return F.when(swapped, -sign).otherwise(sign)
