"""Streaming form of the text source.

The reference reads a fixed file; there is no streaming operator in it.
The same parse expressions apply unchanged to a Structured Streaming text
source, so new labelled lines landing in a folder can be parsed and appended
to the training table that the batch trainers read. No state is kept: each
micro-batch is a pure projection."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from ..sources.text import parse_indexed, parse_plain


def read_points_stream(spark: SparkSession, folder: str, indexed: bool = True,
                       max_files_per_trigger: int | None = None) -> DataFrame:
    """Streaming DataFrame of parsed rows from text files arriving in ``folder``."""
    reader = spark.readStream.format("text")
    if max_files_per_trigger:
        reader = reader.option("maxFilesPerTrigger", str(max_files_per_trigger))
    lines = reader.load(folder)
    return parse_indexed(lines) if indexed else parse_plain(lines)


def append_points(stream: DataFrame, table_path: str, checkpoint_path: str,
                  once: bool = True):
    """Append parsed rows to a parquet table (exactly-once via the stream
    checkpoint). ``once`` processes what is available and stops."""
    writer = (stream.writeStream.format("parquet").option("path", table_path)
              .option("checkpointLocation", checkpoint_path).outputMode("append"))
    if once:
        writer = writer.trigger(availableNow=True)
    return writer.start()
