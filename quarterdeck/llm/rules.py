"""Quality rules, line first: drop failing lines, then reject documents that lost too much.

Only built-in expressions. Every line with a word is judged by itself:

* punctuation: at least 12 % of its characters are marks such as ``# * $ !``, or it has 60 characters or
  more and no sentence mark at all;
* navigation: three or more separators (``|``, ``>``, bullets), one in 25 characters at least;
* boilerplate: a phrase of site furniture, or a banner in capitals only (20 characters or more).

Lines that fail are removed. A document is rejected if it fails the base rules (fewer than 50 words, or
more than half of its words in repeated three-word windows), or if more than ``max_lost`` per cent of
its word characters were in removed lines.

Defined results: a null text counts as empty; an empty text has no words, fails the base rules and is
not kept; repeated rows and rows with a null id are judged like any other; other columns of the table
are carried in ``doc`` and never looked at. A text of any length is judged whole, in one row.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from quarterdeck.llm.common import boxed, table

# Fixed values.
SPACE = r"[\x20\x09-\x0D]+"
SYMBOLS = "#*$%&|<>"
MARKS = r"[^#*$%&|<>!{}\[\]\\^~_=+@»›•·]+"
SEPARATORS = r"[^|>»›•·]+"
SENTENCE = r"[.!?;:…。！？]"
WORD = r"[^\x20\x09-\x0D]"
CAPITAL = r"[A-ZÀ-ÖØ-Þ]"
SMALL = r"[a-zß-öø-ÿ]"
PHRASES = (
    "all rights reserved", "accept cookies", "cookie policy", "enable javascript", "lorem ipsum",
    "privacy policy", "skip to content", "subscribe to our newsletter", "terms of use",
)


@dataclass(frozen=True)
class Limits:
    """Thresholds of the rules."""

    min_words: int = 50
    max_repeat: int = 50
    mark_share: int = 12
    long_line: int = 60
    separator_gap: int = 25
    min_separators: int = 3
    min_banner: int = 20
    max_lost: int = 30


def _left(text: Column, pattern: str) -> Column:
    """Characters left when all runs of others are taken out."""
    return F.length(F.regexp_replace(text, pattern, ""))


def _has_phrase(text: Column) -> Column:
    lower, found = F.lower(text), F.lit(False)
    for phrase in PHRASES:
        found = found | lower.contains(phrase)
    return found


def _fails(line: Column, marks: Column, may_have_phrase: Column, limits: Limits) -> Column:
    """Whether a line fails; ``marks`` are its marks alone, so that they are looked for once."""
    size, separators = F.length(line), _left(marks, SEPARATORS)
    punctuation = (100 * F.length(marks) >= limits.mark_share * size) | (
        (size >= limits.long_line) & ~line.rlike(SENTENCE)
    )
    navigation = (separators >= limits.min_separators) & (limits.separator_gap * separators >= size)
    banner = (size >= limits.min_banner) & ~line.rlike(SMALL) & line.rlike(CAPITAL)
    return line.rlike(WORD) & (punctuation | navigation | banner | (may_have_phrase & _has_phrase(line)))


def _repeated(words: Column, windows: Column) -> Column:
    """How many words stand in a three-word window that occurs twice or more."""
    placed = F.sort_array(F.transform(windows, lambda w, i: F.struct(w.alias("w"), i.alias("i"))))

    def marks(sorted_windows: Column) -> Column:
        twins = F.filter(
            sorted_windows,
            lambda x, i: (x["w"] == F.get(sorted_windows, i - 1)["w"]) | (x["w"] == F.get(sorted_windows, i + 1)["w"]),
        )
        places = F.flatten(F.transform(twins, lambda x: F.array(x["i"], x["i"] + 1, x["i"] + 2)))
        return F.size(F.array_distinct(places))

    # One lambda variable holds the sorted windows, so that they are sorted once.
    heavy = F.get(F.transform(F.array(placed), marks), F.lit(0))
    return F.when(F.size(F.array_distinct(windows)) == F.size(windows), F.lit(0)).otherwise(heavy)


def judge_lines(docs: DataFrame, text: str = "text", limits: Limits = Limits()) -> DataFrame:
    """One row per document: ``doc`` (its columns), the measures, ``clean_text``, ``base_failed``, ``kept``."""
    whole = boxed(docs, text=text).withColumn("text", F.coalesce("text", F.lit("")))
    split = whole.select(
        "doc", "text",
        F.array_remove(F.split("text", SPACE), "").alias("words"),
        F.split("text", "\n").alias("lines"),
        _has_phrase(F.col("text")).alias("phrase"),
    )
    n = F.size("words")
    windows = F.when(
        n >= 3,
        F.transform(
            F.slice("words", F.lit(1), n - 2),
            lambda w, i: F.concat(w, F.lit(" "), F.get("words", i + 1), F.lit(" "), F.get("words", i + 2)),
        ),
    ).otherwise(F.array().cast("array<string>"))
    marked = F.transform(
        "lines", lambda x: F.struct(x.alias("line"), F.regexp_replace(x, MARKS, "").alias("marks"))
    )
    good = F.filter(marked, lambda x: ~_fails(x["line"], x["marks"], F.col("phrase"), limits))
    cleaned = split.select(
        "doc", "words", "lines",
        windows.alias("windows"),
        F.length(F.array_join("words", "")).cast("long").alias("word_chars"),
        _left(F.col("text"), f"[^{SYMBOLS}]+").cast("long").alias("n_symbols"),
        F.array_join(F.transform(good, lambda x: x["line"]), "\n").alias("clean_text"),
        F.filter("lines", lambda x: x.rlike(WORD)).alias("worded"),
    )
    # Behind ``inline`` a filter on the verdict stays above the measures; pushed below, it would hold copies
    # of the expressions of all steps, and measure each word's text anew.
    measured = cleaned.select("doc", F.inline(F.array(F.struct(
        "clean_text", "word_chars", "n_symbols",
        n.cast("long").alias("n_words"),
        (F.size("worded") - F.size(F.array_distinct("worded"))).cast("long").alias("n_dup_lines"),
        _repeated(F.col("words"), F.col("windows")).cast("long").alias("n_repeat_words"),
        (F.col("word_chars") - _left(F.col("clean_text"), SPACE)).cast("long").alias("lost_chars"),
    ))))
    failed = (F.col("n_words") < limits.min_words) | (
        100 * F.col("n_repeat_words") > limits.max_repeat * F.col("n_words")
    )
    return measured.withColumn("base_failed", failed).withColumn(
        "kept", ~F.col("base_failed") & (100 * F.col("lost_chars") <= limits.max_lost * F.col("word_chars"))
    )


def _sql() -> str:
    phrases = " OR ".join(f"contains(lower(x), '{p}')" for p in PHRASES)
    left = "length(regexp_replace(x, '{}', '', 'g'))".format
    fails = f"""regexp_matches(x, '{WORD}') AND (
        100 * {left(MARKS)} >= 12 * length(x)
        OR (length(x) >= 60 AND NOT regexp_matches(x, '{SENTENCE}'))
        OR ({left(SEPARATORS)} >= 3 AND 25 * {left(SEPARATORS)} >= length(x))
        OR {phrases}
        OR (length(x) >= 20 AND NOT regexp_matches(x, '{SMALL}') AND regexp_matches(x, '{CAPITAL}')))"""
    return f"""
WITH d AS (SELECT row_number() OVER () AS r, doc_id, coalesce(text, '') AS text FROM documents),
l AS (SELECT *, list_filter(regexp_split_to_array(text, '{SPACE}'), lambda x: x <> '') AS words,
             string_split(text, chr(10)) AS lines FROM d),
p AS (SELECT r, unnest(words) AS w, generate_subscripts(words, 1) AS i FROM l),
g AS (SELECT r, i, w || ' ' || lead(w) OVER o || ' ' || lead(w, 2) OVER o AS g FROM p WINDOW o AS (PARTITION BY r ORDER BY i)),
t AS (SELECT r, i FROM (SELECT r, i, count(*) OVER (PARTITION BY r, g) AS c FROM g WHERE g IS NOT NULL) WHERE c > 1),
u AS (SELECT r, count(DISTINCT j) AS n FROM (SELECT r, unnest([i, i + 1, i + 2]) AS j FROM t) GROUP BY r),
m AS (SELECT doc_id, len(words) AS n_words, length(array_to_string(words, '')) AS word_chars,
             length(regexp_replace(text, '[^{SYMBOLS}]+', '', 'g')) AS n_symbols,
             len(list_filter(lines, lambda x: regexp_matches(x, '{WORD}')))
               - len(list_distinct(list_filter(lines, lambda x: regexp_matches(x, '{WORD}')))) AS n_dup_lines,
             coalesce(u.n, 0) AS n_repeat_words,
             length(regexp_replace(array_to_string(list_filter(lines, lambda x: NOT ({fails})), chr(10)), '{SPACE}', '', 'g')) AS left_chars
      FROM l LEFT JOIN u USING (r)),
b AS (SELECT *, n_words < 50 OR 100 * n_repeat_words > 50 * n_words AS base_failed FROM m)
SELECT doc_id, n_words::BIGINT AS n_words, word_chars::BIGINT AS word_chars, n_symbols::BIGINT AS n_symbols,
       n_dup_lines::BIGINT AS n_dup_lines, n_repeat_words::BIGINT AS n_repeat_words,
       (word_chars - left_chars)::BIGINT AS lost_chars, base_failed,
       NOT base_failed AND 100 * (word_chars - left_chars) <= 30 * word_chars AS kept
FROM b"""


#: The same judgement in DuckDB's SQL, by other means: windows over unfolded words.
SQL = _sql()


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    return judge_lines(docs).select(
        "doc.doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "lost_chars",
        "base_failed", "kept",
    )
