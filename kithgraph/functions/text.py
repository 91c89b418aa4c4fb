"""Text predicates and tokens. The patterns mean the same in Java's, RE2's and Python's regular expressions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

#: The characters that count as white space (those Python's str.strip removes).
WHITE = r"\x09-\x0d\x1c-\x20\x{85}\x{a0}\x{1680}\x{2000}-\x{200a}\x{2028}\x{2029}\x{202f}\x{205f}\x{3000}"
_WHITE_CHARACTERS = "".join(map(chr, [*range(0x09, 0x0E), *range(0x1C, 0x21), 0x85, 0xA0, 0x1680, *range(0x2000, 0x200B), 0x2028, 0x2029, 0x202F, 0x205F, 0x3000]))
VISIBLE = rf"[^{WHITE}]"
#: Longest runs of letters or digits.
WORD = r"[\p{L}\p{N}]+"


def trimmed(text: Column) -> Column:
    """``text`` without white space at both ends, Unicode white space included."""
    return F.btrim(text, F.lit(_WHITE_CHARACTERS))


def has_text(text: Column) -> Column:
    """True if there is a character other than white space; false for null."""
    return F.coalesce(text.rlike(VISIBLE), F.lit(False))


def words(text: Column) -> Column:
    """Array of the longest runs of letters or digits of the lower-cased text; null for null."""
    return F.regexp_extract_all(F.lower(text), F.lit(WORD), F.lit(0))
