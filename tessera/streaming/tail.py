"""Streams into stores: every micro-batch is published once, whatever is run again."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from tessera.materialization import Materialization
from tessera.store import Store


def tail_files(spark: SparkSession, folder: str, schema, kind: str = "parquet", per_batch: int = 100, pattern: str = "*") -> DataFrame:
    """A stream of the files that a folder has and gets, those whose names match the pattern."""
    return spark.readStream.schema(schema).option("maxFilesPerTrigger", per_batch).option("pathGlobFilter", pattern).format(kind).load(folder)


def append_to(stream: DataFrame, store: Store, table: str, checkpoint: str, available_now: bool = True) -> StreamingQuery:
    """Appends a stream to a table; a batch that was published before is left out when it comes again."""
    if not store.exists(table):
        store.change(lambda c: c.create(table, stream.schema))

    def write(batch: DataFrame, number: int) -> None:
        def work(c) -> None:
            if number > c.tables[table]["notes"].get("batch", -1):
                c.append(table, batch)
                c.note(table, batch=number)

        store.change(work)

    return _start(stream, write, checkpoint, available_now)


def fold_into(stream: DataFrame, target: Materialization, aggregate: Callable[[DataFrame], DataFrame], checkpoint: str, available_now: bool = True) -> StreamingQuery:
    """Folds each micro-batch's partial aggregate into a materialized roll-up, once."""

    def write(batch: DataFrame, number: int) -> None:
        target.append_delta(aggregate(batch), batch=f"stream-{number}")

    return _start(stream, write, checkpoint, available_now)


def _start(stream: DataFrame, write, checkpoint: str, available_now: bool) -> StreamingQuery:
    writer = stream.writeStream.option("checkpointLocation", checkpoint).foreachBatch(write)
    return (writer.trigger(availableNow=True) if available_now else writer).start()


def windowed(stream: DataFrame, time: str, width: str, slide: str | None = None, late: str = "10 minutes", by: list[str] | None = None, value: str | None = None) -> DataFrame:
    """Rows (and the sum of a value) per window and group; rows later than the watermark are dropped by Spark."""
    marked = stream.withWatermark(time, late) if stream.isStreaming else stream
    window = F.window(time, width, slide) if slide else F.window(time, width)
    out = marked.groupBy(window.alias("_w"), *(by or [])).agg(F.count("*").alias("n"), *([F.sum(value).alias(f"sum_{value}")] if value else []))
    return out.select(F.col("_w.start").alias("window_start"), F.col("_w.end").alias("window_end"), *[c for c in out.columns if c != "_w"])


def sessions(stream: DataFrame, time: str, gap: str, by: list[str], late: str = "10 minutes") -> DataFrame:
    """Rows per session: a group's rows that follow one another within ``gap``."""
    marked = stream.withWatermark(time, late) if stream.isStreaming else stream
    out = marked.groupBy(F.session_window(time, gap).alias("_w"), *by).agg(F.count("*").alias("n"))
    return out.select(F.col("_w.start").alias("session_start"), F.col("_w.end").alias("session_end"), *by, "n")
