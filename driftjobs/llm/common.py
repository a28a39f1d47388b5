"""Helpers that the text operators share: written tables, size-checked joins, whole-text words."""

from __future__ import annotations

import contextlib
import ctypes
import gc
import uuid
from collections.abc import Iterator

import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from driftjobs.sources.io import discard, go_at_end, shared_folder, written

__all__ = ["attach", "bucketed", "discard", "fine_text", "parts", "row_key", "sized_batches", "spread", "task_count", "text_bytes", "tidy", "words_of", "written"]

#: A side of at most this many values may be broadcast; beyond it the join shuffles.
BROADCAST_VALUES = 1_000_000
#: Bytes of a written table that one task should read at most.
TASK_BYTES = 128 << 20
#: Spark takes no more buckets (``spark.sql.sources.bucketing.maxBuckets``).
MOST_BUCKETS = 100_000
#: Bytes in an Arrow batch for Python.
BATCH_BYTES = 4 << 20


def bucketed(df: DataFrame, *keys: str) -> DataFrame:
    """``df`` written in the shared folder by hash of its keys, so that joins on them move only their other side.

    The catalog forgets the table's name at once; its files stay for the plans that read them, as those of ``written``.
    """
    spark = df.sparkSession
    n, name, path = min(task_count(df), MOST_BUCKETS), f"driftjobs_{uuid.uuid4().hex}", shared_folder(spark)
    df.repartition(n, *keys).write.bucketBy(n, *keys).format("parquet").option("path", path).saveAsTable(name)
    go_at_end(spark, path)
    table = spark.table(name)
    spark.sql(f"DROP TABLE {name}")
    return table


def attach(df: DataFrame, table: DataFrame, key: str, width: F.Column | int = 8) -> DataFrame:
    """Left join of ``table`` (one row per ``key``, already written) to ``df``; a null key matches a null key.

    The table is broadcast only when a sum of its rows' ``width`` (values in a row) proves it small. Otherwise
    both sides are shuffled by key, and Spark splits a hot key's rows of ``df`` over tasks, for ``table`` has one row for it.
    """
    other = table.withColumnRenamed(key, "__key")
    values = table.agg(F.sum(F.lit(width) if isinstance(width, int) else width)).first()[0] or 0
    if values <= BROADCAST_VALUES:
        other = F.broadcast(other)
    return df.join(other, df[key].eqNullSafe(F.col("__key")), "left").drop("__key")


def task_count(table: DataFrame) -> int:
    """How many tasks should share a table: as many as the session has for shuffles, more if they would get over TASK_BYTES of its files.

    Spark knows the size of what is read from files; of a join it only knows a bound that is far too high, and of rows made by the
    driver or an RDD the greatest long: these aren't asked.
    """
    plan = table._jdf.queryExecution().optimizedPlan()
    least = int(table.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    return least if any(x in plan.toString() for x in ("Join", "LogicalRDD")) else max(least, -(-int(str(plan.stats().sizeInBytes())) // TASK_BYTES))


def sized_batches(docs: DataFrame) -> DataFrame:
    """``docs``; from now on its session sends Arrow batches of BATCH_BYTES at most to Python, for whole texts are wide rows.

    Plans read the setting when they run, so it can't be put back here; narrow rows never fill such a batch.
    """
    conf, name = docs.sparkSession.conf, "spark.sql.execution.arrow.maxBytesPerBatch"
    conf.set(name, str(BATCH_BYTES))
    return docs


def fine_text(text: F.Column | str) -> F.Column:
    """The text with U+FFFD for bytes that aren't UTF-8, which Python couldn't read; texts that are UTF-8 keep their bytes.

    Parquet doesn't check strings. Two texts that differ in such bytes alone may be alike to what reads them so.
    """
    return F.make_valid_utf8(text)


def parts(texts: pa.Array, most: int = 1 << 20) -> Iterator[pa.Array]:
    """An Arrow array in slices of some ``most`` bytes of text, so that what is made of them stays small."""
    size = pc.fill_null(pc.binary_length(texts), 0).to_numpy(zero_copy_only=False).astype("int64")
    place = (size.cumsum() - size) // most
    cuts = [0, *(i for i in range(1, len(place)) if place[i] != place[i - 1]), len(place)]
    yield from (texts.slice(a, b - a) for a, b in zip(cuts[:-1], cuts[1:], strict=True))


def spread(df: DataFrame, *keys: str) -> DataFrame:
    """``df`` dealt out by keys to as many tasks as the session has for shuffles, or its size asks for: for few rows of which many are made."""
    return df.repartition(task_count(df), *keys)


def row_key(df: DataFrame) -> F.Column:
    """A hash of all columns: with the id it tells rows apart, except rows that are alike in every column."""
    plain = lambda c, kind: F.to_json(F.struct(df[f"`{c}`"])) if "map<" in kind or "variant" in kind else df[f"`{c}`"]
    return F.xxhash64(*[plain(c, kind) for c, kind in df.dtypes])


def tidy() -> None:
    """At a task's end: give freed memory back, for a worker outlives its tasks and the next may need what it holds."""
    gc.collect()
    pa.default_memory_pool().release_unused()
    with contextlib.suppress(OSError, AttributeError):  # a C library that can't trim
        ctypes.CDLL("libc.so.6").malloc_trim(0)


def text_bytes(text: str | None) -> bytes:
    return b"" if text is None else text.encode("utf-8")


def words_of(text: str | None) -> list[bytes]:
    """Runs of bytes other than 0x20 and 0x09-0x0D, which is what ``bytes.split`` splits at."""
    return text_bytes(text).split()
