"""Text functions with the semantics of Unicode-aware strings, as Column expressions."""

from __future__ import annotations

import sys
from functools import lru_cache

from pyspark.sql import Column
from pyspark.sql import functions as F

from quillstream.functions.values import WORDS_PER_MINUTE

#: White space: Unicode's, and the four information separators.
SPACE = r"[\s\x1c-\x1f]"
#: Regex flags: Unicode classes and case, and only \n ends a line.
UNICODE, UNICODE_ANY_CASE = "(?Ud)", "(?iUd)"


def let(value: Column, use) -> Column:
    """use(value), with value worked out once for each row."""
    return F.element_at(F.transform(F.array(value), use), 1)


def strip(c: Column) -> Column:
    return F.regexp_replace(c, rf"(?U)\A{SPACE}+|{SPACE}+\z", "")


def is_blank(c: Column) -> Column:
    return ~c.rlike(rf"(?U)[^\s\x1c-\x1f]")


def word_count(c: Column) -> Column:
    return F.regexp_count(c, F.lit(r"(?U)[^\s\x1c-\x1f]+")).cast("long")


def words(c: Column) -> Column:
    return F.regexp_extract_all(c, F.lit(r"(?U)([^\s\x1c-\x1f]+)"), F.lit(1))


def minutes(word_count: Column, words_per_minute: int = WORDS_PER_MINUTE) -> Column:
    return word_count / F.lit(float(words_per_minute))


@lru_cache
def _folding() -> tuple[str, str, dict[str, str]]:
    """Where full case folding of a lower-case character differs: single characters as two strings for translate, and the rest."""
    one, to, many = [], [], {}
    for k in range(sys.maxunicode + 1):
        if not 0xD800 <= k < 0xE000:
            low = chr(k).lower()
            if len(low) == 1 and (folded := low.casefold()) != low:
                if len(folded) == 1:
                    one.append(low)
                    to.append(folded)
                else:
                    many[low] = folded
    pairs = dict(zip(one, to))
    return "".join(pairs), "".join(pairs.values()), many


def casefold(c: Column) -> Column:
    """Full Unicode case folding; plain lower case where the text is ASCII."""
    one, to, many = _folding()
    folded = F.translate(F.lower(c), one, to)
    for low, full in many.items():
        folded = F.replace(folded, F.lit(low), F.lit(full))
    return F.when(F.octet_length(c) == F.length(c), F.lower(c)).otherwise(folded)


def speaker_key(c: Column) -> Column:
    return strip(casefold(c))


def either(words_) -> str:
    return "|".join(words_)
