"""Helpers that the corpus operators share: batch slicing, word splitting, shared storage."""

from __future__ import annotations

import math
import re
import uuid
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import xxhash
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: Text bytes that one pass of a Python kernel holds at a time; longer single texts pass alone.
KERNEL_BYTES = 4 << 20


def read_table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def text_bytes(column: pa.Array) -> list[bytes]:
    """UTF-8 bytes of each value; null counts as empty."""
    return [x or b"" for x in column.cast(pa.binary()).to_pylist()]


def sub_batches(batch: pa.RecordBatch, text: str, limit: int = KERNEL_BYTES) -> Iterator[pa.RecordBatch]:
    """Slices of a batch that hold about ``limit`` bytes of text each; no row is cut."""
    if not batch.num_rows:
        return
    column = batch.column(batch.schema.get_field_index(text)).cast(pa.binary())
    ends = np.cumsum(pc.fill_null(pc.binary_length(column), 0).to_numpy(zero_copy_only=False).astype(np.int64))
    at = 0
    while at < batch.num_rows:
        done = ends[at - 1] if at else 0
        to = max(at + 1, int(np.searchsorted(ends, done + limit, side="right")))
        yield batch.slice(at, to - at)
        at = to


def crc_of_id(doc_id: int | None) -> int | None:
    """Unsigned crc32 of the decimal text of an id; None for a null id."""
    return None if doc_id is None else zlib.crc32(str(doc_id).encode())


def ids_mod(ids: list[int | None], modulus: int) -> np.ndarray:
    """crc32(id as text) mod ``modulus`` for each id, -1 for null."""
    return np.array([-1 if (c := crc_of_id(i)) is None else c % modulus for i in ids], dtype=np.int64)


class WordHash(dict):
    """word bytes -> 64-bit xxHash, remembered up to a bound so that memory stays flat."""

    def __init__(self, seed: int = 0, bound: int = 250_000):
        super().__init__()
        self.seed, self.bound = seed, bound

    def __missing__(self, word: bytes) -> int:
        if len(self) >= self.bound:
            self.clear()
        self[word] = value = xxhash.xxh64_intdigest(word, self.seed)
        return value

    def array(self, words: list[bytes]) -> np.ndarray:
        return np.fromiter(map(self.__getitem__, words), dtype=np.uint64, count=len(words))


def mix(x: np.ndarray) -> np.ndarray:
    """A 64-bit finaliser (xor-shift and multiply) over an array of uint64."""
    x = x ^ (x >> np.uint64(32))
    x = x * np.uint64(0xD6E8FEB86659FD93)
    x ^= x >> np.uint64(32)
    x *= np.uint64(0xD6E8FEB86659FD93)
    x ^= x >> np.uint64(32)
    return x


def gram_hashes(words: np.ndarray, n: int) -> np.ndarray:
    """Hash of each run of ``n`` consecutive word hashes (len(words) - n + 1 of them)."""
    m = len(words) - n + 1
    if m <= 0:
        return np.zeros(0, dtype=np.uint64)
    out = mix(words[:m] + np.uint64(n))
    for k in range(1, n):
        out = mix(out * np.uint64(0x9E3779B97F4A7C15) + words[k : k + m])
    return out


def shared_folder(spark: SparkSession, purpose: str) -> str:
    """A new folder in the shared place that ``spark.checkpoint.dir`` names. Where it is unset, a local session takes
    the warehouse, and one with executors elsewhere, which might not see that, is refused."""
    base = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getConf().get("spark.checkpoint.dir")
    if not base:
        if not re.fullmatch(r"local(\[.*\])?", spark.sparkContext.master):
            raise ValueError("set spark.checkpoint.dir to a folder that the driver and all executors share")
        base = spark.conf.get("spark.sql.warehouse.dir")
    return f"{base.rstrip('/')}/{purpose}-{uuid.uuid4().hex}"


def store(df: DataFrame, purpose: str) -> DataFrame:
    """Write ``df`` as a table in the shared folder and read it back: cuts lineage, survives lost executors."""
    spark = df.sparkSession
    to = shared_folder(spark, purpose)
    df.write.option("compression", "zstd").parquet(to)
    return spark.read.schema(df.schema).parquet(to)


def total_bytes(df: DataFrame, text: str) -> int:
    return df.agg(F.sum(F.octet_length(text))).first()[0] or 0


def pieces(total: int, each: int) -> int:
    return max(1, math.ceil(total / each))


def lower_ascii(text: Column) -> Column:
    """Only A-Z become a-z; other letters stay."""
    return F.translate(text, "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")
