"""Text features over whole texts, all as built-in column expressions."""

from __future__ import annotations

from collections.abc import Iterable

from pyspark.sql import Column
from pyspark.sql import functions as F


def _text(col: Column) -> Column:
    return F.coalesce(col, F.lit(""))


def regex_hits(text: Column, pattern: str) -> Column:
    """All matches of a pattern, letter case ignored; null text has none."""
    return F.regexp_extract_all(_text(text), F.lit(f"(?i)({pattern})"), 1)


def section_hits(sections: Iterable[Column], pattern: str) -> Column:
    """Matches over several sections of one record, in section order."""
    return F.flatten(F.array(*[regex_hits(s, pattern) for s in sections]))


def regex_count(text: Column, pattern: str) -> Column:
    return F.regexp_count(_text(text), F.lit(f"(?i){pattern}")).cast("long")


def term_count(text: Column, term: str) -> Column:
    """Non-overlapping occurrences of a term in lower-cased text."""
    low = F.lower(_text(text))
    gone = F.length(low) - F.length(F.replace(low, F.lit(term), F.lit("")))
    return (gone / F.lit(len(term))).cast("long")


def keyword_breadth(text: Column, keywords: Iterable[str]) -> Column:
    """How many different keywords the text contains."""
    low = F.lower(_text(text))
    total = F.lit(0)
    for word in keywords:
        total = total + F.contains(low, F.lit(word)).cast("int")
    return total.cast("long")


def stored_list_len(text: Column) -> Column:
    """Length of a list kept as text; null, empty and malformed text count as 0."""
    # No repeat gives anything back, which never helps here: Java keeps a frame for each round of one that might.
    item = r"""(?:'(?:[^'\\\\]|\\\\.)*+'|"(?:[^"\\\\]|\\\\.)*+"|[^\s,'"\[\]]++)"""
    whole = text.rlike(rf"^\s*+\[\s*+(?:{item}\s*+(?:,\s*+{item}\s*+)*+,?+\s*+)?+\]\s*$")
    return F.when(whole, F.regexp_count(text, F.lit(item))).otherwise(F.lit(0)).cast("long")
