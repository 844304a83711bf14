"""Tables out of JSON payloads and nested records."""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import StructType


def json_rows(
    df: DataFrame, body: str, keep: Sequence[str], fields: Mapping[str, str]
) -> DataFrame:
    """Rows of a JSON array of arrays whose first entry is a header.

    Bodies that are missing or without data rows are skipped.
    ``fields`` names the positions and gives each its type; a value that does
    not convert raises.
    """
    rows = F.from_json(F.col(body), "array<array<string>>")
    return (
        df.select(*keep, rows.alias("_rows"))
        .filter(F.size("_rows") > 1)
        .select(*keep, F.explode(F.slice("_rows", 2, F.size("_rows") - 1)).alias("_row"))
        .select(
            *keep,
            *[F.col("_row").getItem(i).cast(t).alias(name) for i, (name, t) in enumerate(fields.items())],
        )
    )


def records(df: DataFrame, body: str, keep: Sequence[str], schema: StructType | str) -> DataFrame:
    """JSON objects with differing keys as a table; a key an object lacks is null."""
    return df.select(*keep, F.from_json(F.col(body), schema).alias("_r")).select(*keep, "_r.*")


def json_default(body: Column, key: str, default: object, dtype: str) -> Column:
    """One field of a JSON object, or a default when it is missing."""
    return F.coalesce(F.get_json_object(body, f"$.{key}").cast(dtype), F.lit(default).cast(dtype))


def children(df: DataFrame, nested: Column, keep: Sequence[str], out: str = "child") -> DataFrame:
    """One row per element of an array, with its position; parents without any vanish."""
    return df.select(*keep, F.posexplode(nested).alias("position", out))


def _joined(section: str, text: str, name: str) -> Column:
    """All texts of one section, in text order, a line feed between; null without the section."""
    found = F.sort_array(F.collect_list(F.when(F.col(section) == name, F.coalesce(text, F.lit("")))))
    return F.when(F.size(found) > 0, F.array_join(found, "\n"))


def sections(
    df: DataFrame, keys: Sequence[str], section: str, text: str, wanted: Sequence[str]
) -> DataFrame:
    """Long-form sections, one row per record and wanted section, missing text as ''.

    Records without any wanted section get an ``error`` text instead of being lost.
    """
    texts = df.groupBy(*keys).agg(
        *[_joined(section, text, s).alias(f"_{s}") for s in wanted]
    )
    rows = F.array(
        *[F.struct(F.lit(s).alias(section), F.coalesce(f"_{s}", F.lit("")).alias(text)) for s in wanted]
    )
    nothing = F.coalesce(*[F.col(f"_{s}") for s in wanted]).isNull()
    return texts.select(
        *keys, F.when(nothing, F.lit("no sections")).alias("error"), F.explode(rows).alias("_s")
    ).select(*keys, "_s.*", "error")
