"""Text cleaning and splitting rules.

Every ``\\s`` / ``\\S`` carries ``(?U)`` so whitespace means Unicode whitespace,
as in Python's ``str`` methods; Java's plain ``\\s`` is ASCII only.
"""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# The default character filter of the Keras text tokenizer
# (each character, plus tab and newline, becomes a separator).
KERAS_FILTERS = '!"#$%&()*+,-./:;<=>?@[\\]^_`{|}~\t\n'


def _c(col) -> Column:
    return F.col(col) if isinstance(col, str) else col


def strip_text(col) -> Column:
    """remove leading and trailing (Unicode) whitespace, like ``str.strip()``."""
    return F.regexp_replace(_c(col), r"(?U)^\s+|\s+$", "")


def clean_alnum(col) -> Column:
    """lower-case, then delete everything but a-z, 0-9 and whitespace.

    Nothing is put in place of a deleted character (``stop-now`` -> ``stopnow``)
    and the text is not trimmed.
    """
    return F.regexp_replace(F.lower(_c(col)), r"(?U)[^a-z0-9\s]", "")


def clean_headline(col) -> Column:
    """drop ``http`` links, keep letters/digits/whitespace/``.,!?``,
    collapse whitespace runs to one space, trim.  Case is kept."""
    t = F.regexp_replace(_c(col), r"(?U)http\S+", "")
    t = F.regexp_replace(t, r"(?U)[^a-zA-Z0-9\s.,!?]", "")
    t = F.regexp_replace(t, r"(?U)\s+", " ")
    return strip_text(t)


def tokenizer_normalize(col) -> Column:
    """F4 (string form): lower-case and turn every filter character into a space."""
    return F.translate(F.lower(_c(col)), KERAS_FILTERS, " " * len(KERAS_FILTERS))


def tokenizer_words(col) -> Column:
    """the token array of the Keras tokenizer: split on single spaces, drop empties.

    Only the space separates words; other whitespace stays inside a token.
    """
    return F.filter(F.split(tokenizer_normalize(col), " "), lambda w: w != "")


def split_words(col) -> Column:
    """``str.split()`` - split on runs of whitespace, no empty words."""
    return F.filter(F.split(_c(col), r"(?U)\s+"), lambda w: w != "")


def join_words(col) -> Column:
    """join an array of words with one space."""
    return F.concat_ws(" ", _c(col))
