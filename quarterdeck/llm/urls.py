"""URL filters: a blocked Bloom filter lets possible hits pass to an exact hash join.

A list has an entry per rule: host, path and verdict. A rule fits its host and all its subdomains where the
URL's path starts with the rule's; of the rules that fit, the one with the longest host and path wins, the
longer host on a tie. A URL's possible keys are its host's ends at label borders, each with the beginnings of
its path that are as long as some path in the list; their number is bounded by the URL.

Every list entry sets ``PROBES`` bits in one block of 512 of the filter. The filter is a small table, a row
per block in use and at most ``MAX_BLOCKS`` rows of 80 bytes, so it can be broadcast whatever the size of
the list: a longer list only lets more false hits pass. They end at the join with the list, by the key itself.

Two lists are looked up: rules, and below them listed hosts and pages, which block a URL that no rule fits.
Rules meet host and path as they are. Listed entries meet the URL's canonical form: no user-info, port or last
dot of the host, ``/`` for an empty path, escapes of unreserved characters undone and others in upper case; dot
segments stay. ``listed_urls`` makes such entries from a table of URLs of any size.

Defined results: host and path as in ``split_url``; a null URL or one without ``://`` has an empty host and
path and is allowed by default; repeated rows are returned as often as they came; rows without an id are
judged like any other. Empty lists allow everything. Two entries of one key: blocking wins. Other columns are not read.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from quarterdeck.llm.common import table
from quarterdeck.session import materialize

# Fixed values.
RULES = [("net", "/", "block"), ("example.net", "/en/", "allow"), ("example.com", "/de/", "block"), ("org", "/fr/", "allow")]
LISTED = [("spam-farm.example.org", "/", "block"), ("cheap-pills.example.com", "/", "block")]

WORDS = 8
PROBES = 6
ENTRY_BITS = 16
MAX_BLOCKS = 1 << 17


def split_url(url: Column) -> tuple[Column, Column]:
    """Host (after the first ``://``, ASCII letters lower-cased) and path (up to ``?``, ``#`` or the end)."""
    at = F.instr(url, "://")
    rest = F.when(at > 0, F.substring(url, at + 3, F.length(url))).otherwise(F.lit(""))
    rest = F.coalesce(rest, F.lit(""))
    host = F.regexp_extract(rest, r"^([^/?#]*)", 1)
    path = F.regexp_extract(rest, r"^[^/?#]*([^?#]*)", 1)
    return F.translate(host, "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"), path


def _unescaped(part: Column) -> Column:
    """Percent escapes of unreserved characters undone, others in upper case; stray percent signs stay."""

    def piece(p: Column, i: Column) -> Column:
        digits, rest = F.substring(p, 1, 2), F.substring(p, 3, 1 << 30)
        char = F.unhex(digits).cast("string")
        escape = F.when(char.rlike("^[A-Za-z0-9._~-]$"), char).otherwise(F.concat(F.lit("%"), F.upper(digits)))
        valid = (i > 0) & digits.rlike("^[0-9A-Fa-f]{2}$")
        return F.when(valid, F.concat(escape, rest)).when(i > 0, F.concat(F.lit("%"), p)).otherwise(p)

    return F.when(part.contains("%"), F.array_join(F.transform(F.split(part, "%"), piece), "")).otherwise(part)


def canonical(host: Column, path: Column) -> tuple[Column, Column]:
    """Host and path of ``split_url`` in the form in which listed entries are looked up."""
    bare = F.regexp_replace(host, r"^.*@|:[0-9]*$", "")
    bare = F.regexp_replace(F.lower(_unescaped(bare)), r"\.$", "")
    return bare, F.when(bare == "", "").when(path == "", "/").otherwise(_unescaped(path))


def _key(host: Column, path: Column) -> Column:
    return F.concat(host, path)


def _bits(key: Column, blocks: int) -> tuple[Column, list[Column]]:
    """Block of a key, and the bits it needs in each of the block's words."""
    h, g = F.xxhash64(key), F.xxhash64(key, F.lit(1))
    words = []
    for w in range(WORDS):
        word = F.lit(0).cast("long")
        for p in range(PROBES):
            place = F.shiftrightunsigned(g, 9 * p).bitwiseAND(F.lit(511))
            mask = F.call_function("shiftleft", F.lit(1).cast("long"), place.bitwiseAND(F.lit(63)).cast("int"))
            word = word.bitwiseOR(F.when(F.shiftright(place, 6) == w, mask).otherwise(F.lit(0).cast("long")))
        words.append(word.alias(f"w{w}"))
    return F.pmod(h, F.lit(blocks)).alias("block"), words


def bloom_filter(keys: DataFrame, blocks: int) -> DataFrame:
    """A row per block in use: ``block`` and its words ``w0`` … ``w7``; ``keys`` has the column ``key``."""
    block, words = _bits(F.col("key"), blocks)
    return keys.select(block, *words).groupBy("block").agg(*[F.bit_or(f"w{w}").alias(f"w{w}") for w in range(WORDS)])


def may_hold(candidates: DataFrame, bloom: DataFrame, blocks: int) -> DataFrame:
    """The candidates whose ``key`` may be in the filter: all that are, and a few others."""
    block, words = _bits(F.col("key"), blocks)
    needed = [w.alias(f"n{i}") for i, w in enumerate(words)]
    held = F.lit(True)
    for w in range(WORDS):
        held = held & (F.col(f"w{w}").bitwiseAND(F.col(f"n{w}")) == F.col(f"n{w}"))
    # At most MAX_BLOCKS rows of 80 bytes, 10 MB.
    return candidates.select("*", block, *needed).join(F.broadcast(bloom), "block").filter(held).select(*candidates.columns)


def listed(spark: SparkSession, rules: list[tuple[str, str, str]], priority: int) -> DataFrame:
    rows = spark.createDataFrame(rules, "host string, path string, verdict string")
    return rows.withColumn("priority", F.lit(priority))


def listed_urls(urls: DataFrame, url: str = "url", verdict: str = "block") -> DataFrame:
    """Entries below the rules from a table of URLs: each fits its canonical form and what lies below it."""
    host, path = canonical(*split_url(F.col(f"`{url}`")))
    rows = urls.select(host.alias("host"), path.alias("path")).filter("host <> ''").distinct()
    return rows.select("host", "path", F.lit(verdict).alias("verdict"), F.lit(1).alias("priority"))


def judge(pages: DataFrame, rules: DataFrame, page_id: str = "page_id", url: str = "url") -> DataFrame:
    """``page_id``, ``host``, ``path``, ``rule`` and ``verdict`` of every page.

    ``rules``: host, path, verdict, priority. A rule of priority 0 is reported; entries of lower priority
    (1) decide where none fits, without being reported.
    """
    host, path = split_url(F.col(f"`{url}`"))
    base = pages.select(F.col(f"`{page_id}`").alias("page_id"), host.alias("host"), path.alias("path"))
    entries = rules.select(
        _key(F.col("host"), F.col("path")).alias("key"), F.length("host").alias("host_size"), "verdict", "priority"
    )
    entries = materialize(entries.groupBy("key", "host_size", "priority").agg(F.max("verdict").alias("verdict")))
    n = entries.count()
    blocks = max(1, min(MAX_BLOCKS, -(-n * ENTRY_BITS // (64 * WORDS))))
    sizes = materialize(rules.select(F.length("path").alias("size")).distinct())
    # At most one row for each length a URL's path can have.
    path_sizes = [r["size"] for r in sizes.orderBy("size").collect()]
    sizes_array = F.array(*[F.lit(s) for s in path_sizes]).cast("array<int>")

    def keys(host: str, path: str, plain: Column, canon: Column) -> Column:
        labels = F.split(host, r"\.")
        ends = F.transform(
            F.sequence(F.lit(1), F.size(labels)), lambda i: F.array_join(F.slice(labels, i, F.size(labels)), ".")
        )
        fitting = F.filter(sizes_array, lambda s: s <= F.length(path))
        return F.flatten(F.transform(ends, lambda e: F.transform(fitting, lambda s: F.struct(
            F.concat(e, F.substring(F.col(path), F.lit(1), s)).alias("key"), F.length(e).alias("host_size"),
            plain.alias("plain"), canon.alias("canon"),
        ))))

    canon_host, canon_path = canonical(F.col("host"), F.col("path"))
    both = base.filter("host <> ''").select("*", canon_host.alias("canon_host"), canon_path.alias("canon_path"))
    same = (F.col("host") == F.col("canon_host")) & (F.col("path") == F.col("canon_path"))
    plain_keys = keys("host", "path", F.lit(True), same)
    # Most URLs are canonical and need no second lookup.
    all_keys = F.when(same, plain_keys).otherwise(
        F.concat(plain_keys, keys("canon_host", "canon_path", F.lit(False), F.lit(True)))
    )
    candidates = both.select("page_id", "host", "path", F.explode(all_keys).alias("k")).select("page_id", "host", "path", "k.*")
    possible = may_hold(candidates, bloom_filter(entries, blocks), blocks)
    hits = possible.join(entries, ["key", "host_size"]).filter(F.when(F.col("priority") == 0, F.col("plain")).otherwise(F.col("canon")))
    hits = hits.select(
        "page_id", "host", "path", F.lit(0).alias("n"),
        F.struct((-F.col("priority")).alias("high"), F.length("key").alias("size"), "host_size", "key", "verdict").alias("hit"),
    )
    rows = base.select("page_id", "host", "path", F.lit(1).alias("n"), F.lit(None).cast(hits.schema["hit"].dataType).alias("hit"))
    # Hits come back to their page by its id, host and path; equal rows are counted and unfolded again.
    judged = rows.unionByName(hits).groupBy("page_id", "host", "path").agg(F.sum("n").alias("n"), F.max("hit").alias("hit"))
    return judged.select(
        "page_id", "host", "path",
        F.when(F.col("hit.high") == 0, F.col("hit.key")).alias("rule"),
        F.coalesce("hit.verdict", F.lit("allow")).alias("verdict"),
        F.explode(F.sequence(F.lit(1).cast("long"), F.greatest("n", F.lit(1).cast("long")))).alias("copy"),
    ).drop("copy")


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    rules = listed(spark, RULES, 0).unionByName(listed(spark, LISTED, 1))
    return judge(table(spark, sf_dir, "pages"), rules)


def _sql() -> str:
    values = ", ".join(
        f"('{h}', '{p}', '{v}', {i})" for i, part in enumerate((RULES, LISTED)) for h, p, v in part
    )
    return f"""
WITH u AS (SELECT row_number() OVER () AS r, page_id,
                  CASE WHEN contains(url, '://') THEN substr(url, instr(url, '://') + 3) ELSE '' END AS rest FROM pages),
p AS (SELECT r, page_id, translate(regexp_extract(coalesce(rest, ''), '^([^/?#]*)', 1),
             'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS host,
             regexp_extract(coalesce(rest, ''), '^[^/?#]*([^?#]*)', 1) AS path FROM u),
l(lh, lp, lv, prio) AS (VALUES {values}),
m AS (SELECT r, lh || lp AS key, lv, prio, row_number() OVER
             (PARTITION BY r ORDER BY prio, length(lh || lp) DESC, length(lh) DESC, lv DESC) AS best
      FROM p JOIN l ON (host = lh OR ends_with(host, '.' || lh)) AND starts_with(path, lp))
SELECT page_id, host, path, CASE WHEN prio = 0 THEN key END AS rule, coalesce(lv, 'allow') AS verdict
FROM p LEFT JOIN (SELECT * FROM m WHERE best = 1) USING (r)"""


SQL = _sql()
