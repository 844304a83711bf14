"""Typed scans and table sinks."""

from __future__ import annotations

import json
from collections.abc import Mapping, Sequence
from functools import reduce
from urllib.parse import unquote, urlparse

from pyspark.sql import Column, DataFrame, Observation, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import MapType, StringType, StructType

MANIFEST = "_manifest"
EMPTY_MARK = "\ue000"
CSV_OPTIONS = {"header": True, "quote": '"', "escape": '"'}


def raw_csv(
    spark: SparkSession, path: str | list[str], multi_line: bool = True, file_column: str | None = None,
) -> DataFrame:
    """CSV files with a header each as text columns, found by name whatever their order in a file.

    Files whose headers differ are read apart, a group for each header, and stacked by name; a column that some
    files lack is null there. A header is read per file where there are several, in one small job each. Text in
    quotes may hold line feeds, for which a file is read by one task; with ``multi_line`` False, for files that are
    known to hold none, large files are split. ``file_column`` names a column for the file a row comes from.
    """
    paths = [path] if isinstance(path, str) else list(path)

    def read(some: list[str], marked: bool = True) -> DataFrame:
        # Not enforced, so that a header that does not fit raises.
        found = spark.read.csv(some, multiLine=multi_line, enforceSchema=False, **CSV_OPTIONS)
        return found.select("*", F.col("_metadata.file_path").alias(file_column)) if file_column and marked else found

    files = files_below(spark, paths)
    if len(files) < 2:
        return read(paths)
    groups: dict[tuple[str, ...], list[str]] = {}
    for file in files:
        groups.setdefault(tuple(read([file], False).columns), []).append(file)
    named = [read(some) for header, some in groups.items() if header]
    return reduce(lambda a, b: a.unionByName(b, allowMissingColumns=True), named) if named else read(paths)


def files_below(spark: SparkSession, paths: Sequence[str]) -> list[str]:
    """The files of some paths, sorted; their content is not read."""
    return sorted(r["path"] for r in spark.read.format("binaryFile").load(list(paths)).select("path").collect())


def _plain(path: str) -> str:
    """A path without what differs between a listing, a row's file and the caller's spelling."""
    uri = urlparse(path)
    return f"{uri.netloc}{unquote(uri.path) if uri.scheme else path}".rstrip("/")


def raw_csv_tagged(
    spark: SparkSession, paths: Mapping[str, str], tag: str, multi_line: bool = True,
) -> DataFrame:
    """CSV files or folders by their key, as ``raw_csv``, each row with the key of its file in column ``tag``.

    Files of equal headers are one scan, however many there are; the keys come from a table of files that is joined
    by the file a row was read from. A path names a file or a folder, no pattern. Raises where two keys share a file.
    """
    keys: dict[str, str] = {}
    for key, path in paths.items():
        if keys.setdefault(_plain(path), key) != key:
            raise ValueError(f"{path} is named for {keys[_plain(path)]} and {key}")
    relative = {p: key for p, key in keys.items() if not p.startswith("/") and not urlparse(paths[key]).scheme}
    column = "_file_read"
    rows = raw_csv(spark, list(paths.values()), multi_line, column)

    def key_of(file: str) -> str:
        whole = _plain(file)
        parts = whole.split("/")
        owners = {keys[p] for p in ("/".join(parts[: i + 1]) for i in range(len(parts))) if p in keys}
        owners |= {key for p, key in relative.items() if f"/{p}/" in f"{whole}/"}
        if len(owners) != 1:
            raise ValueError(f"{file} belongs to {sorted(owners)}")
        return owners.pop()

    files = [r[0] for r in spark.read.format("binaryFile").load(list(paths.values())).select("_metadata.file_path").collect()]
    table = spark.createDataFrame([(f, key_of(f)) for f in files], f"{column} string, `{tag}` string")
    kept = [F.col(f"`{c}`") for c in rows.columns if c not in (column, tag)]
    return rows.select(*kept, column).join(table, column).drop(column)


def read_csv(
    spark: SparkSession, path: str | list[str], schema: StructType | str, multi_line: bool = True,
) -> DataFrame:
    """CSV with a header, quotes doubled inside quoted text, read with a declared schema; files as in ``raw_csv``.

    A value that does not convert raises."""
    wanted = schema if isinstance(schema, StructType) else StructType.fromDDL(schema)
    raw = raw_csv(spark, path, multi_line)
    return raw.select(*[F.col(f"`{f.name}`").cast(f.dataType).alias(f.name) for f in wanted.fields])


def union_tagged(frames: Mapping[str, DataFrame], tag: str, **constants: Mapping[str, object]) -> DataFrame:
    """Stack tables by column name, each marked with its key; absent columns are null.

    ``constants`` adds further columns with one value per table.
    """
    marked = [
        df.withColumns(
            {tag: F.lit(name), **{c: F.lit(values.get(name)) for c, values in constants.items()}}
        )
        for name, df in frames.items()
    ]
    return reduce(lambda a, b: a.unionByName(b, allowMissingColumns=True), marked)


def pick(df: DataFrame, wanted: Sequence[str]) -> DataFrame:
    """Those of the wanted columns that exist, in the wanted order."""
    return df.select(*[c for c in wanted if c in df.columns])


def _content(df: DataFrame) -> list[Column]:
    """Rows and a sum of row hashes, which depends neither on the order of rows nor on their partitions."""
    cells = [F.to_json(f"`{f.name}`") if isinstance(f.dataType, MapType) else F.col(f"`{f.name}`") for f in df.schema]
    # A hash passes over nulls, so their places are hashed beside the values.
    row = F.xxhash64(*cells, *[c.isNull() for c in cells])
    return [F.count(F.lit(1)).alias("rows"), F.sum(row.cast("decimal(38,0)")).cast("string").alias("content")]


def save_tables(
    data: DataFrame | Sequence[DataFrame],
    names: str | Sequence[str],
    folder: str = "raw",
    base: str = "data",
    fmt: str = "csv",
    overwrite: bool = False,
) -> dict[str, str]:
    """Write one table or several below ``base/folder`` and return their paths.

    Tables and names must pair up; nothing is written otherwise. A table that is there already raises, unless
    ``overwrite``. Rows and content are counted while they are written, with no second run of the plan, and put
    beside the data last, as the manifest ``read_saved`` checks; a table without one was not written to its end.
    """
    frames = [data] if isinstance(data, DataFrame) else list(data)
    labels = [names] if isinstance(names, str) else list(names)
    if len(frames) != len(labels):
        raise ValueError(f"{len(frames)} tables but {len(labels)} names")
    if len(set(labels)) != len(labels):
        raise ValueError("a name is given twice")
    paths = {}
    for df, name in zip(frames, labels):
        path = f"{base.rstrip('/')}/{folder}/{name}"
        seen = Observation()
        writer = df.observe(seen, *_content(df)).write.mode("overwrite" if overwrite else "errorifexists")
        if fmt == "csv":
            writer.csv(path, **CSV_OPTIONS)
        else:
            writer.format(fmt).save(path)
        manifest = json.dumps({"format": fmt, "schema": df.schema.jsonValue(), **seen.get})
        spark = df.sparkSession
        spark.createDataFrame([(manifest,)], "value string").coalesce(1).write.text(f"{path}/{MANIFEST}")
        paths[name] = path
    return paths


def read_saved(spark: SparkSession, path: str) -> DataFrame:
    """A table of ``save_tables`` as it was written; raises where rows, types or content differ from its manifest."""
    (line,) = spark.read.text(f"{path}/{MANIFEST}").collect()
    manifest = json.loads(line["value"])
    schema = StructType.fromJson(manifest["schema"])
    if manifest["format"] == "csv":
        # Quotes around nothing are read as a mark, else they would be null. A text that is the mark itself raises below.
        back = spark.read.csv(path, schema=schema, multiLine=True, mode="FAILFAST", emptyValue=EMPTY_MARK, **CSV_OPTIONS)
        texts = [f.name for f in schema if f.dataType == StringType()]
        back = back.withColumns({c: F.when(F.col(f"`{c}`") == EMPTY_MARK, "").otherwise(F.col(f"`{c}`")) for c in texts})
    else:
        back = spark.read.format(manifest["format"]).load(path)
        types = [(f.name, f.dataType.simpleString()) for f in back.schema]
        if types != [(f.name, f.dataType.simpleString()) for f in schema]:
            raise ValueError(f"types differ: {schema.simpleString()} written, {back.schema.simpleString()} read")
    found = back.agg(*_content(back)).first()
    if found["rows"] != manifest["rows"]:
        raise ValueError(f"wrote {manifest['rows']} rows, read {found['rows']}")
    if found["content"] != manifest["content"]:
        raise ValueError(f"the content of {path} is not what was written")
    return back


def verify_written(written: DataFrame, back: DataFrame) -> tuple[int, int]:
    """Rows and columns of a table read back; raises if they differ from what was written."""
    if written.columns != back.columns:
        raise ValueError(f"columns differ: {written.columns} and {back.columns}")
    rows, again = written.count(), back.count()
    if rows != again:
        raise ValueError(f"wrote {rows} rows, read {again}")
    return rows, len(back.columns)
