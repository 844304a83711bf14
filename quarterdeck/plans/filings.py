"""Features of filing texts and subsidiary lists."""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quarterdeck.functions.fixed_values import (
    AI_TERM,
    DATA_CENTER_TERM,
    FILING_SECTIONS,
    GLOBAL_KEYWORDS,
    POWER_PATTERN,
    RENEWABLE_TERM,
    US_JURISDICTIONS,
)
from quarterdeck.functions.keys import member_flag
from quarterdeck.functions.text import keyword_breadth, section_hits, term_count
from quarterdeck.sources.payloads import children


def power_mentions(filings: DataFrame, pattern: str = POWER_PATTERN) -> DataFrame:
    """Filings (``ticker``, ``filing_date``, ``sections`` map) with the list of power mentions."""
    texts = [F.try_element_at("sections", F.lit(s)) for s in FILING_SECTIONS]
    return filings.withColumn("mw_mentions", section_hits(texts, pattern))


# Output columns and the terms they count.
TERM_COLUMNS = {"dc_count_10k": DATA_CENTER_TERM, "ai_mentions": AI_TERM, "renewable_mentions": RENEWABLE_TERM}


def text_features(
    filings: DataFrame,
    pattern: str = POWER_PATTERN,
    terms: Mapping[str, str] = TERM_COLUMNS,
    regions: Sequence[str] = GLOBAL_KEYWORDS,
) -> DataFrame:
    """Counts per filing over the whole text of all its sections."""
    text = F.array_join(F.map_values("sections"), "\n", "")
    return power_mentions(filings, pattern).select(
        "ticker",
        "filing_date",
        F.size("mw_mentions").cast("long").alias("mw_mentions"),
        keyword_breadth(text, regions).alias("global_regions"),
        *[term_count(text, term).alias(name) for name, term in terms.items()],
    )


def subsidiaries(filings: DataFrame) -> DataFrame:
    """One row per subsidiary (``subsidiaries`` array of name and jurisdiction structs)."""
    rows = children(filings, F.col("subsidiaries"), ["ticker"], "_s")
    return rows.select(
        "ticker",
        F.col("_s.name").alias("entity_name"),
        F.col("_s.jurisdiction").alias("jurisdiction"),
        member_flag(F.col("_s.jurisdiction"), US_JURISDICTIONS).alias("is_us"),
    )
