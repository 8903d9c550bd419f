"""What the text operators share: words, hashes, keys."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

#: A word: a run of anything but ASCII white space.
WORD = r"[^\x20\x09-\x0D]+"
#: A token for comparisons that ignore case and punctuation.
NOT_TOKEN = r"[^\p{L}\p{N}]+"
#: A letter of a script that is written without spaces.
UNSPACED = r"([\p{IsHan}\p{IsHiragana}\p{IsKatakana}\p{IsThai}\p{IsLao}\p{IsKhmer}\p{IsMyanmar}])"


def body(text: str | Column) -> Column:
    """The text; a null text is an empty one."""
    return F.coalesce(F.col(f"`{text}`") if isinstance(text, str) else text, F.lit(""))


def words(text: str | Column) -> Column:
    """Array of the words of a text."""
    return F.regexp_extract_all(body(text), F.lit(WORD), F.lit(0))


def count_words(text: str | Column) -> Column:
    """Number of words as a long."""
    return F.regexp_count(body(text), F.lit(WORD)).cast("long")


def tokens(text: str | Column) -> Column:
    """Array of lower-cased letter or digit runs; every letter of an unspaced script is one."""
    lower = F.lower(body(text))
    parted = F.when(F.octet_length(lower) == F.length(lower), lower).otherwise(F.regexp_replace(lower, UNSPACED, " $1 "))
    return F.filter(F.split(parted, NOT_TOKEN), lambda t: t != F.lit(""))


def unsigned_hex(value: Column) -> Column:
    """A long's 64 bits as 16 lower-case hex digits."""
    return F.lower(F.lpad(F.hex(value), 16, "0"))
