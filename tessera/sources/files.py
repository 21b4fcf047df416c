"""Files as views: the reader follows the extension, the name follows the file."""

from __future__ import annotations

import re
import unicodedata
from collections.abc import Collection

from pyspark.sql import DataFrame, SparkSession

COMPRESSED = (".gz", ".zst", ".bz2", ".snappy", ".lz4", ".deflate")
READERS = {"parquet": "parquet", "csv": "csv", "tsv": "tsv", "json": "json_lines", "jsonl": "json_lines", "ndjson": "json_lines", "orc": "orc", "txt": "text", "log": "text"}
#: Words that can't be bare names of tables.
RESERVED = frozenset(
    "all and any as asc between by case cast create cross delete desc describe distinct drop else end except exists explain false for from full group having in inner insert intersect "
    "into is join left like limit natural not null offset on or order outer right select semi set show table then true union update using values when where with".split()
)


class UnknownFormat(ValueError):
    """No reader for a file's extension."""


def reader_for(path: str) -> str:
    """The reader that a path's extension asks for; an extension of compression is looked through."""
    name = path.rstrip("/").rsplit("/", 1)[-1].lower()
    for suffix in COMPRESSED:
        name = name.removesuffix(suffix)
    extension = name.rsplit(".", 1)[-1] if "." in name else ""
    if extension not in READERS:
        raise UnknownFormat(f"no reader for {path}")
    return READERS[extension]


def read(spark: SparkSession, *paths: str) -> DataFrame:
    """The rows of files of one format. Parquet files that differ in columns are united by name."""
    kind = reader_for(paths[0])
    if kind == "parquet":
        return spark.read.option("mergeSchema", "true").parquet(*paths)
    if kind in ("csv", "tsv"):
        return spark.read.option("header", "true").option("inferSchema", "true").option("sep", "\t" if kind == "tsv" else ",").csv(list(paths))
    if kind == "json_lines":
        df = spark.read.json(list(paths))
        if df.columns == ["_corrupt_record"]:  # one document over several lines
            df = spark.read.option("multiLine", "true").json(list(paths))
        return df
    if kind == "orc":
        return spark.read.orc(list(paths))
    return spark.read.text(list(paths))


def table_name(path: str, taken: Collection[str] = ()) -> str:
    """A safe name after a file's: letters, digits and underscores, no reserved word, none that is taken."""
    name = path.rstrip("/").rsplit("/", 1)[-1]
    for suffix in COMPRESSED:
        name = name.removesuffix(suffix)
    name = name.rsplit(".", 1)[0] if "." in name[1:] else name
    plain = unicodedata.normalize("NFKD", name).encode("ascii", "ignore").decode().lower()
    plain = re.sub(r"[^a-z0-9]+", "_", plain).strip("_") or "data"
    if plain[0].isdigit() or plain in RESERVED:
        plain = f"t_{plain}"
    used = {t.lower() for t in taken}
    result, n = plain, 2
    while result in used:
        result, n = f"{plain}_{n}", n + 1
    return result


def blobs(spark: SparkSession, pattern: str) -> DataFrame:
    """Files as rows: path, modificationTime, length, content."""
    return spark.read.format("binaryFile").load(pattern)


def texts(spark: SparkSession, pattern: str) -> DataFrame:
    """Files as rows of their whole text."""
    from pyspark.sql import functions as F

    return spark.read.text(pattern, wholetext=True).select(F.input_file_name().alias("path"), "value")


def export(df: DataFrame, location: str) -> int:
    """Writes one Parquet file and returns its rows. For results that one task can write; ``partitioned`` scales."""
    df.coalesce(1).write.mode("overwrite").parquet(location)
    return df.sparkSession.read.parquet(location).count()


def partitioned(df: DataFrame, location: str, by: list[str], sort: list[str] | None = None) -> None:
    """Writes a folder per value of ``by``; rows are dealt by these values first, so that folders have few files."""
    out = df.repartition(*by)
    if sort:
        out = out.sortWithinPartitions(*by, *sort)
    out.write.mode("overwrite").partitionBy(*by).parquet(location)
