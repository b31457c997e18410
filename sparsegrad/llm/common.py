"""Shared helpers: whole-table reads, tables written to the shared folder,
size-checked broadcasts and small column idioms."""

from __future__ import annotations

import uuid
from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..session import ensure_checkpoint_dir

#: A word is a maximal run of characters other than the space and these five.
BREAKS = "\t\n\x0b\x0c\r"
SYMBOLS = "#*$%&|<>"

#: Rows of a narrow table (a few scalars a row) that may be broadcast.
BROADCAST_ROWS = 200_000


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def scratch_path(spark: SparkSession, label: str) -> str:
    """A fresh folder below the session's shared checkpoint folder."""
    return f"{ensure_checkpoint_dir(spark)}/{label}-{uuid.uuid4().hex}"


def stored(df: DataFrame, label: str) -> DataFrame:
    """Write ``df`` once as Parquet in the shared folder and read it back.

    Cuts the lineage like ``checkpoint()`` but computes the table once; a lost
    executor rereads the files. They stay until the owner of
    ``spark.checkpoint.dir`` clears that folder."""
    path = scratch_path(df.sparkSession, label)
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def small(df: DataFrame, rows: int, limit: int = BROADCAST_ROWS) -> DataFrame:
    """Broadcast hint if the counted size allows it, else a plain join side
    (a shuffle join, whose hot keys adaptive execution splits)."""
    return F.broadcast(df) if rows <= limit else df


def without(text: Column, chars: str, by: str = "") -> Column:
    """``text`` with each of ``chars`` replaced by plain byte searches, which
    cost less than ``translate`` or a regular expression over long texts."""
    for c in chars:
        text = F.replace(text, F.lit(c), F.lit(by))
    return text


def words_of(text: Column) -> Column:
    """Words of a text that is not null, in order."""
    return F.array_remove(F.split(without(text, BREAKS, " "), " "), "")


def n_symbols(text: Column) -> Column:
    """Symbol characters of a text; texts without any are only searched."""
    symbols = "[" + SYMBOLS + "]"
    rest = F.regexp_replace(text, symbols + "+", "")
    return F.when(text.rlike(symbols), F.length(text) - F.length(rest)).otherwise(0)


def let(value: Column, body: Callable[[Column], Column]) -> Column:
    """Bind a computed value once inside one row: ``body`` may use it often
    without Spark evaluating it again."""
    return F.transform(F.array(value), body)[0]


def materialised(df: DataFrame, **columns: Column) -> DataFrame:
    """Add columns behind a one-row generator. The optimiser does not inline
    the expressions into later filters and projections, so each runs once."""
    packed = F.struct(*[c.alias(k) for k, c in columns.items()])
    return df.select("*", F.inline(F.array(packed)))


def unit_draw(*parts: Column) -> Column:
    """A repeatable uniform draw strictly inside (0, 1) from the hashed parts."""
    bits = F.shiftrightunsigned(F.xxhash64(*parts), 11).cast("double")
    return (bits + F.lit(0.5)) / F.lit(float(1 << 53))


def held_out(doc_id: Column) -> Column:
    """Rows kept away from learning: crc32 of the id as text, modulo 5, is 0."""
    return F.coalesce(F.crc32(doc_id.cast("string").cast("binary")) % 5 == 0, F.lit(False))
