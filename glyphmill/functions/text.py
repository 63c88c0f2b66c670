"""Text as Column expressions: folding, white space, presentation form, tokens, seeds, labels.

Everything here stays in the JVM (built-in functions only). Null gives null throughout.
"""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# Marks deleted by the nominal fold, and the white space of Unicode strings.
FOLD_DELETES = "\u180b\u180c\u180d\u180e\u180f\u200c\u200d\ufeff\ufffe"
NNBSP, MVS = "\u202f", "\u180e"
WHITE = "\\t-\\r\\x1c-\\x20\\x85\\xa0\\u1680\\u2000-\\u200a\\u2028\\u2029\\u202f\\u205f\\u3000"
#: separable vowels, and the range of Mongolian letters
VOWELS, LETTERS = "\\u1820\\u1821", "\\u1820-\\u18aa"


def nominal_fold(text: Column) -> Column:
    """Deletes variation selectors, vowel separator, joiners and byte-order marks; U+202F to space."""
    return F.translate(text, NNBSP + FOLD_DELETES, " ")


def normalize(text: Column) -> Column:
    """Runs of space, tab, line feed and carriage return become one space; white space of any kind is
    stripped from both ends."""
    return F.regexp_replace(F.regexp_replace(text, "[\n\r\t ]+", " "), f"^[{WHITE}]+|[{WHITE}]+$", "")


def presentation(text: Column, replacement: str = " ") -> Column:
    """Replaces every vowel separator that doesn't stand before a separable vowel ending its word."""
    return F.regexp_replace(text, f"{MVS}(?![{VOWELS}](?![{LETTERS}]))", replacement)


def tokens(text: Column) -> Column:
    """Words between white space of any kind; no empty ones."""
    return F.filter(F.split(text, f"[{WHITE}]+"), lambda w: w != "")


def chars(text: Column) -> Column:
    """Code points of a text; an empty array for the empty text."""
    return F.when(text == "", F.array().cast("array<string>")).otherwise(F.split(text, ""))


def u_plus(char: Column) -> Column:
    """``U+XXXX`` of a character, four digits at least."""
    h = F.hex(F.ascii(char))
    return F.concat(F.lit("U+"), F.lpad(h, F.greatest(F.lit(4), F.length(h)), "0"))


def derive_seed(base: int, index: Column) -> Column:
    """(base * 1000003 + index * 2654435761 + 12345) modulo 2**30; factors are reduced first, so large
    indexes can't overflow."""
    m = 1 << 30
    step = F.pmod(index.cast("bigint"), F.lit(m)) * F.lit(2654435761 % m)
    return F.pmod(F.pmod(step, F.lit(m)) + F.lit((base * 1000003 + 12345) % m), F.lit(m))


def line_key(number: Column, variant: Column) -> Column:
    """``line_%08d_v%d``."""
    return F.format_string("line_%08d_v%d", number, variant)
