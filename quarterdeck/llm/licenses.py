"""License scans: Dice coefficient over word bigrams between passages and license templates.

A passage is a line, or a paragraph of several lines; it is normalised to lower-case ASCII letters and
digits with single spaces. With a and b distinct bigrams and c of them shared, the coefficient is
2 c / (a + b). It can reach the threshold t only if a lies between b t / (2 - t) and b (2 - t) / t, so only
templates of such sizes are compared. Only built-in expressions; each document is judged whole, in one row.

Defined results: a null or empty text, or one without a passage in reach of a template, has a null license,
coefficient 0 and no hits; equal coefficients go to the alphabetically last name; repeated rows and rows
without an id are judged like any other. Passages of fewer than two words have no bigram and never match.
Other columns are carried in ``doc`` and not read.
"""

from __future__ import annotations

import math
import re

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from quarterdeck.llm.common import boxed, table

THRESHOLD = 0.8

# Notices by which works are placed under a license.
TEMPLATES = {
    "Apache-2.0": "Licensed under the Apache License, Version 2.0.",
    "Apache-2.0-header": (
        "Licensed under the Apache License, Version 2.0 (the \"License\"); you may not use this file except in "
        "compliance with the License. You may obtain a copy of the License at http://www.apache.org/licenses/LICENSE-2.0 "
        "Unless required by applicable law or agreed to in writing, software distributed under the License is distributed "
        "on an \"AS IS\" BASIS, WITHOUT WARRANTIES OR CONDITIONS OF ANY KIND, either express or implied. See the License "
        "for the specific language governing permissions and limitations under the License."
    ),
    "CC-BY-4.0": "This work is licensed under a Creative Commons Attribution 4.0 International License.",
    "CC-BY-NC-4.0": "Licensed under CC BY-NC 4.0.",
    "CC-BY-SA-4.0": "Licensed under CC BY-SA 4.0.",
    "GPL-3.0": "This work is licensed under the GNU General Public License, version 3.",
    "GPL-3.0-header": (
        "This program is free software: you can redistribute it and/or modify it under the terms of the GNU General "
        "Public License as published by the Free Software Foundation, either version 3 of the License, or (at your "
        "option) any later version."
    ),
    "ISC": (
        "Permission to use, copy, modify, and/or distribute this software for any purpose with or without fee is hereby "
        "granted, provided that the above copyright notice and this permission notice appear in all copies."
    ),
    "MIT": "Released under the MIT License.",
    "MIT-grant": (
        "Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated "
        "documentation files (the \"Software\"), to deal in the Software without restriction, including without "
        "limitation the rights to use, copy, modify, merge, publish, distribute, sublicense, and/or sell copies of the "
        "Software, and to permit persons to whom the Software is furnished to do so, subject to the following conditions:"
    ),
    "Unlicense": "This is free and unencumbered software released into the public domain.",
}
OTHER = r"[^a-z0-9]+"


def bigrams_of(passage: str) -> list[str]:
    """The distinct word bigrams of a normalised passage, sorted."""
    words = [w for w in re.split(OTHER, passage.lower()) if w]
    return sorted({f"{a} {b}" for a, b in zip(words, words[1:])})


def sizes_in_reach(size: int, threshold: float) -> tuple[int, int]:
    """Fewest and most bigrams a passage can have to reach the threshold against so many."""
    return math.ceil(size * threshold / (2 - threshold) - 1e-9), math.floor(size * (2 - threshold) / threshold + 1e-9)


def _bigrams(passage: Column) -> Column:
    words = F.array_remove(F.split(F.lower(passage), OTHER), "")
    pairs = F.transform(
        F.array(words),
        lambda ws: F.transform(
            F.slice(ws, F.lit(1), F.greatest(F.size(ws) - 1, F.lit(0))),
            lambda w, i: F.concat(w, F.lit(" "), F.get(ws, i + 1)),
        ),
    )
    return F.array_distinct(F.get(pairs, F.lit(0)))


def scan(
    docs: DataFrame, text: str = "text", templates: dict[str, str] | None = None, threshold: float = THRESHOLD,
) -> DataFrame:
    """``doc`` (the columns of the row), ``license``, ``dice`` of its best passage, ``n_hits`` passages in all."""
    known = {name: bigrams_of(t) for name, t in (templates or TEMPLATES).items()}
    known = {name: b for name, b in known.items() if b}
    reach = {name: sizes_in_reach(len(b), threshold) for name, b in known.items()}
    fewest, most = min(r[0] for r in reach.values()), max(r[1] for r in reach.values())
    whole = boxed(docs, text=text).withColumn("text", F.coalesce("text", F.lit("")))
    blocks = F.filter(F.split("text", r"\n[\x20\x09-\x0D]*\n"), lambda x: x.contains("\n"))
    passages = whole.select("doc", F.concat(F.split("text", "\n"), blocks).alias("passages"))
    # A passage of n bigrams has n words and n - 1 spaces at least.
    long_enough = F.filter("passages", lambda x: F.length(x) >= 2 * fewest + 1)
    counted = passages.select("doc", F.transform(long_enough, lambda x: _bigrams(x)).alias("bigrams"))
    fitting = counted.select("doc", F.filter("bigrams", lambda b: F.size(b).between(fewest, most)).alias("bigrams"))

    def best(b: Column) -> Column:
        found = []
        for name, template in sorted(known.items()):
            common = F.size(F.array_intersect(b, F.array(*map(F.lit, template))))
            dice = 2.0 * common / (F.size(b) + len(template))
            low, high = reach[name]
            found.append(F.when(
                F.size(b).between(low, high) & (F.when(F.size(b).between(low, high), dice) >= threshold),
                F.struct(dice.alias("dice"), F.lit(name).alias("license")),
            ))
        return F.array_max(F.array(*found))

    hits = fitting.select("doc", F.filter(F.transform("bigrams", best), lambda x: x.isNotNull()).alias("hits"))
    top = F.array_max("hits")
    return hits.select(
        "doc", top["license"].alias("license"), F.coalesce(top["dice"], F.lit(0.0)).alias("dice"),
        F.size("hits").cast("long").alias("n_hits"),
    )


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    return scan(docs).select("doc.doc_id", "license", "dice", "n_hits")


def _sql() -> str:
    values = ", ".join(
        "('{}', [{}])".format(n, ", ".join(f"'{b}'" for b in bigrams_of(t))) for n, t in TEMPLATES.items()
    )
    return f"""
WITH d AS (SELECT row_number() OVER () AS r, doc_id, coalesce(text, '') AS text FROM documents),
p AS (SELECT r, unnest(string_split(text, chr(10))) AS p FROM d
      UNION ALL
      SELECT r, p FROM (SELECT r, unnest(regexp_split_to_array(text, '\\n[\\x20\\x09-\\x0D]*\\n')) AS p FROM d)
      WHERE contains(p, chr(10))),
w AS (SELECT r, list_filter(regexp_split_to_array(lower(p), '{OTHER}'), lambda x: x <> '') AS w FROM p),
b AS (SELECT r, list_distinct(list_transform(list_zip(w[:-2], w[2:]), lambda x: x[1] || ' ' || x[2])) AS b FROM w WHERE len(w) > 1),
t(name, t) AS (VALUES {values}),
c AS (SELECT r, row_number() OVER () AS i, b FROM b WHERE len(b) BETWEEN 2 AND 400),
h AS (SELECT r, i, name, 2.0::DOUBLE * len(list_intersect(b, t)) / (len(b) + len(t)) AS dice FROM c, t),
m AS (SELECT r, i, max(struct_pack(dice := dice, name := name)) AS m FROM h WHERE dice >= {THRESHOLD} GROUP BY r, i),
g AS (SELECT r, max(m) AS m, count(*) AS n FROM m GROUP BY r)
SELECT doc_id, g.m.name AS license, coalesce(g.m.dice, 0)::DOUBLE AS dice, coalesce(n, 0)::BIGINT AS n_hits
FROM d LEFT JOIN g USING (r)"""


SQL = _sql()
