"""Helpers shared by the operators: written tables, Arrow batches, words, connected groups."""

from __future__ import annotations

import ctypes
import gc
import sys
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from placewise.runtime import work_path

#: A word is a run of characters outside U+0020 and U+0009..U+000D. On UTF-8 bytes that is bytes.split().
WORD = "[^\\x20\\x09-\\x0D]+"


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def written(df: DataFrame, name: str) -> DataFrame:
    """The frame as a Parquet table in the shared folder: later steps read only the columns they need,
    and a lost executor re-reads files instead of running the chain again."""
    spark = df.sparkSession
    path = work_path(spark, name)
    df.write.parquet(path)
    found = spark.read.schema(df.schema).parquet(path)
    found.work_path = path
    return found


def discard(*tables: DataFrame) -> None:
    """Delete the files of :func:`written` tables that nothing reads any more: all that was made of them is
    written itself."""
    for x in tables:
        path = x.sparkSession._jvm.org.apache.hadoop.fs.Path(x.work_path)
        path.getFileSystem(x.sparkSession._jsc.hadoopConfiguration()).delete(path, True)
    release(tables[0].sparkSession)


def sliced(batches: Iterator[pa.RecordBatch], rows: int = 512) -> Iterator[pa.RecordBatch]:
    """Batches of so many rows at most, so that what is made of them stays small."""
    for x in batches:
        for k in range(0, x.num_rows, rows):
            yield x.slice(k, rows)


def lean() -> None:
    """Worker processes serve one operator after the other. Give back what this one kept for others: their
    tokenizers with all that is cached, and memory that is free already."""
    for name, module in list(sys.modules.items()):
        if name.startswith(f"{__package__}."):
            for kept in ("codec", "codecs", "tables", "vocabulary"):
                clear = getattr(getattr(module, kept, None), "cache_clear", None)
                if clear:
                    clear()
    gc.collect()
    pa.default_memory_pool().release_unused()
    trim = getattr(ctypes.CDLL(None), "malloc_trim", None)  # glibc only
    if trim:
        trim(0)


def release(spark: SparkSession) -> None:
    """Shuffle files of finished steps go when the driver collects its garbage, which a driver with a large heap
    does seldom: ask for it."""
    spark.sparkContext._jvm.System.gc()


def spare_names(df: DataFrame, *names: str) -> list[str]:
    """A column name for each of ``names`` that ``df`` doesn't have: the name itself, or with underscores before it."""
    taken, out = {c.lower() for c in df.columns}, []
    for name in names:
        while name.lower() in taken:
            name = f"_{name}"
        taken.add(name.lower())
        out.append(name)
    return out


def word_count(text: Column) -> Column:
    """Number of words; null counts as no text."""
    return F.coalesce(F.regexp_count(text, F.lit(WORD)), F.lit(0)).cast("long")


def raw(column: pa.Array) -> list[bytes | None]:
    """A text column as UTF-8 bytes."""
    return column.cast(pa.binary()).to_pylist()


def word_runs(text: bytes, carry: int, size: int = 1 << 20) -> Iterator[list[bytes]]:
    """The words of a text in runs of about ``size`` bytes; each run but the first begins with the last
    ``carry`` words of the one before. Memory stays bounded for texts of any length."""
    if len(text) <= size:
        yield text.split()
        return
    tail: list[bytes] = []
    begin = 0
    while begin < len(text):
        end = min(begin + size, len(text))
        while end < len(text) and text[end] not in b" \t\n\r\x0b\x0c":
            end += 1
        words = tail + text[begin:end].split()
        begin = end
        if len(words) > carry or begin >= len(text):
            yield words
            tail = words[len(words) - carry :] if carry else []
        else:
            tail = words


def mixed(h: np.ndarray) -> np.ndarray:
    """A 64-bit finalizer: every input bit reaches every output bit."""
    h = h ^ (h >> np.uint64(32))
    h = h * np.uint64(0xD6E8FEB86659FD93)
    h = h ^ (h >> np.uint64(32))
    h = h * np.uint64(0xD6E8FEB86659FD93)
    return h ^ (h >> np.uint64(32))


def rolled(ids: np.ndarray, k: int) -> np.ndarray:
    """A 64-bit hash of each run of ``k`` consecutive ids."""
    n = len(ids) - k + 1
    if n <= 0:
        return np.zeros(0, "u8")
    h = np.zeros(n, "u8")
    for j in range(k):
        h *= np.uint64(0x9E3779B97F4A7C15)
        h += ids[j : j + n]
    return mixed(h)


def components(edges: DataFrame) -> DataFrame:
    """Connected groups of an undirected graph given as (a, b) longs: (node, component), for nodes with
    an edge; component is the smallest node of the group.

    Large-star and small-star rounds: every node hangs its larger neighbours, then itself and its
    smaller neighbours, under the smallest node it sees. Minimums are combined before the shuffle, and
    the join on a node with very many edges is one that AQE can split. Each round is a written table.
    Loops and repeated edges are ignored; no edges give no rows.
    """
    a, b = F.col("a"), F.col("b")
    now = written(edges.where(a != b).select(F.greatest(a, b).alias("a"), F.least(a, b).alias("b")).distinct(), "edges")
    seen = None
    while True:
        state = now.agg(F.count("*"), F.sum(F.xxhash64("a", "b").cast("decimal(38,0)"))).first()
        if state == seen or not state[0]:
            return now.select(F.col("a").alias("node"), F.col("b").alias("component")).unionAll(
                now.groupBy(b.alias("node")).agg(F.min("b").alias("component"))
            )
        seen = state
        both = now.unionAll(now.select(b.alias("a"), a.alias("b")))
        low = both.groupBy("a").agg(F.min("b").alias("m")).select("a", F.least("a", "m").alias("m"))
        large = both.where(b > a).join(low, "a").select(b.alias("a"), F.col("m").alias("b")).where(a != b).distinct()
        low = large.groupBy("a").agg(F.min("b").alias("m"))
        small = large.join(low, "a").select(F.explode(F.array(F.struct("a", F.col("m").alias("b")), F.struct(b.alias("a"), F.col("m").alias("b")))).alias("e"))
        now = written(small.select("e.*").where(a != b).distinct(), "edges")
