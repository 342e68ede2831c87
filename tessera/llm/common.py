"""Small helpers shared by the text operators.

Text is handled inside tasks as Arrow columns cut into slices of bounded bytes,
so a worker's memory depends on the longest single document, not on the table.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from tessera.session import scratch_path

SLICE_BYTES = 4 << 20
MAX_BROADCAST_LABELS = 10_000


def save(df: DataFrame, name: str) -> DataFrame:
    """Write ``df`` below the shared checkpoint folder and read it back.

    Cuts the lineage with a table that survives lost executors.
    """
    spark = df.sparkSession
    path = scratch_path(spark, name)
    df.write.parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def held_out(doc_id: Column) -> Column:
    """True where crc32 of the id's decimal text leaves remainder 1 by 3 (null id: false)."""
    return F.coalesce(F.crc32(doc_id.cast("string").cast("binary")) % 3 == 1, F.lit(False))


def held_out_py(doc_id: int) -> bool:
    return zlib.crc32(str(doc_id).encode()) % 3 == 1


def slices(batches: Iterator[pa.RecordBatch], text: str,
           max_bytes: int = SLICE_BYTES) -> Iterator[pa.RecordBatch]:
    """Cut record batches so that each piece holds at most ``max_bytes`` of text (one row at least)."""
    for b in batches:
        if not b.num_rows:
            continue
        size = np.cumsum(pc.fill_null(pc.binary_length(b.column(text)), 0).to_numpy().astype(np.int64))
        lo, base = 0, 0
        while lo < b.num_rows:
            hi = max(lo + 1, int(np.searchsorted(size, base + max_bytes, side="right")))
            yield b.slice(lo, hi - lo)
            base, lo = int(size[hi - 1]), hi


def flat_words(text: pa.Array) -> tuple[pa.Array, np.ndarray]:
    """Words (``[^\\x20\\x09-\\x0D]+``) of every text, flat, and the n+1 row offsets (null: no word)."""
    lists = pc.ascii_split_whitespace(pc.fill_null(text, ""))
    words, at = lists.flatten(), lists.offsets.to_numpy().astype(np.int64)
    keep = np.asarray(pc.binary_length(words)) > 0
    before = np.zeros(len(keep) + 1, np.int64)
    np.cumsum(keep, out=before[1:])
    return words.filter(pa.array(keep)), before[at - at[0]]


def joined(words: pa.Array) -> tuple[bytes, np.ndarray, np.ndarray]:
    """All words joined by one space as UTF-8, with each word's start and end in it."""
    if not len(words):
        return b"", np.zeros(0, np.int64), np.zeros(0, np.int64)
    one = pa.ListArray.from_arrays(pa.array([0, len(words)], pa.int32()), words)
    data = pc.binary_join(one, " ")[0].as_buffer().to_pybytes()
    size = np.asarray(pc.binary_length(words)).astype(np.int64)
    end = np.cumsum(size + 1) - 1
    return data, end - size, end


def ranges(starts: np.ndarray, counts: np.ndarray) -> np.ndarray:
    """Concatenation of ``arange(s, s + c)``."""
    total = int(counts.sum())
    if not total:
        return np.zeros(0, np.int64)
    first = np.cumsum(counts) - counts
    return np.repeat(starts - first, counts) + np.arange(total)


def distinct(a: np.ndarray) -> np.ndarray:
    """Sorted distinct values (by sorting: faster here than np.unique's hash table)."""
    s = np.sort(a)
    return s[np.concatenate([[True], s[1:] != s[:-1]])] if len(s) else s


def input_bytes(df: DataFrame, text: str) -> int:
    """Bytes of a text column: one native aggregate, used to size partitions."""
    return int(df.agg(F.coalesce(F.sum(F.octet_length(text)), F.lit(0))).first()[0])


def least_hashes(rows: DataFrame, label: str, key: str, n: int) -> DataFrame:
    """The ``n`` rows of each label with the least hashes of ``key`` (distinct keys are expected).

    A label's rows are first thinned to about twice as many by the hash itself, so the ranking sees a bounded
    number of rows however common a label is.
    """
    hashed = rows.withColumn("_h", F.xxhash64(key))
    count = rows.groupBy(label).agg(F.count(F.lit(1)).alias("_n"))
    if count.limit(MAX_BROADCAST_LABELS + 1).count() <= MAX_BROADCAST_LABELS:
        count = F.broadcast(count)  # else rows would be dealt by label before they are thinned
    share = F.col("_h") / float(1 << 64) + 0.5  # even over [0, 1)
    few = hashed.join(count, label).where(share * F.col("_n") < 2 * n + 100)
    order = Window.partitionBy(label).orderBy("_h", key)
    return few.withColumn("_r", F.row_number().over(order)).where(F.col("_r") <= n).drop("_h", "_n", "_r")


def read(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")
