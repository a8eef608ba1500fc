"""Bundles of documents and packed key exchange between them.

Documents are dealt by a hash into bundles of about ``BUNDLE_BYTES`` of text, small enough for one task, at every size
of the table. A bundle asks about 64-bit keys (hashes of n-grams) in packed blocks instead of rows: its distinct keys,
sorted, are cut by value range into shards and sent as delta-coded arrays with values. There are as many shards as
bundles, so a shard holds about as many keys as a bundle whatever the size of the table. Only blocks with keys are
sent: there are never more blocks than keys, so that the exchange grows with the text and not with its square. A shard
sees a key once for each bundle that has it, however often it occurs, so the heaviest key of the corpus is as heavy for
its shard as any key that all bundles have. The answer goes back as arrays in the order of the asked keys.

The hash takes id, text and input partition, so rows that repeat an id or that lack one are dealt to many bundles.
Texts travel compressed. Everything is one lazy plan of shuffles (the exchange of the documents by bundle is reused
between passes), so Spark recomputes what a lost executor held.
"""

from __future__ import annotations

import struct
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute  # noqa: F401
import zstandard
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import pieces, total_bytes

#: Text in a bundle: bounds a task's memory (its arrays take about thirty times this).
BUNDLE_BYTES = 4 << 20
#: Planes below this size are sent as they are.
PLAIN_BYTES = 200
_ARRAY, _PLANE = struct.Struct("<IB"), struct.Struct("<I")

Got = list[tuple[np.ndarray, ...]]
Ask = Callable[[list[int | None], list[bytes], Got], tuple[np.ndarray, tuple[np.ndarray, ...]]]
Blocks = list[list[np.ndarray]]


def pack(*arrays: np.ndarray) -> bytes:
    """Arrays of whole numbers as byte planes, as many as the largest value needs; a plane that zstandard makes smaller is packed."""
    out = []
    squeeze = zstandard.ZstdCompressor(level=1)
    for a in arrays:
        a = a.astype(np.uint64)
        width = max(1, (int(a.max()).bit_length() + 7) // 8) if a.size else 0
        out.append(_ARRAY.pack(a.size, width))
        for plane in np.ascontiguousarray(a.view(np.uint8).reshape(-1, 8)[:, :width].T):
            raw = plane.tobytes()
            packed = squeeze.compress(raw) if len(raw) >= PLAIN_BYTES else raw
            out += [_PLANE.pack(min(len(packed), len(raw))), packed if len(packed) < len(raw) else raw]
    return b"".join(out)


def unpack(data: bytes) -> list[np.ndarray]:
    out, at = [], 0
    expand = zstandard.ZstdDecompressor()
    while at < len(data):
        n, width = _ARRAY.unpack_from(data, at)
        at += _ARRAY.size
        a = np.zeros((n, 8), dtype=np.uint8)
        for k in range(width):
            (size,) = _PLANE.unpack_from(data, at)
            at += _PLANE.size
            a[:, k] = np.frombuffer(data, np.uint8, n, at) if size == n else np.frombuffer(expand.decompress(data[at : at + size]), np.uint8)
            at += size
        out.append(a.reshape(-1).view(np.uint64))
    return out


def pack_sorted(keys: np.ndarray, *values: np.ndarray, spare: int = 0) -> bytes:
    """Sorted keys, whose lowest ``spare`` bits are zero, as steps, and their values."""
    return pack(np.diff(keys >> np.uint64(spare), prepend=np.uint64(0)), *values)


def unpack_sorted(data: bytes, spare: int = 0) -> list[np.ndarray]:
    deltas, *values = unpack(data)
    return [np.cumsum(deltas, dtype=np.uint64) << np.uint64(spare), *values]


def shard_of(keys: np.ndarray, n: int) -> np.ndarray:
    """Which of ``n`` equal ranges of 64-bit keys each key is in."""
    return (((keys >> np.uint64(32)) * np.uint64(n)) >> np.uint64(32)).astype(np.int64)


def _compressed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    pack_text = zstandard.ZstdCompressor(level=3)
    for batch in batches:
        texts = batch.column(2).cast(pa.binary()).to_pylist()
        yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array([pack_text.compress(t) if t else b"" for t in texts], pa.binary())], names=["bundle", "doc_id", "packed"])


class Bundles:
    """A table's documents in bundles, ready to ask."""

    def __init__(self, docs: DataFrame, doc_id: str, text: str, bundle_bytes: int = BUNDLE_BYTES, spare: int = 0):
        """``spare``: how many of the lowest bits of all keys are zero."""
        self.spare = spare
        rows = docs.select(F.col(doc_id).cast("long").alias("doc_id"), F.col(text).alias("text"))
        self.n = pieces(total_bytes(rows, "text"), bundle_bytes)
        bundle = F.pmod(F.xxhash64("doc_id", "text", F.spark_partition_id()), F.lit(self.n)).cast("int")
        self.docs = rows.select(bundle.alias("bundle"), "doc_id", "text").mapInArrow(_compressed, "bundle int, doc_id long, packed binary")

    def ask(self, keys_of: Ask, answers: DataFrame | None = None) -> DataFrame:
        """bundle, shard, asked: each bundle's distinct sorted keys and their values, as packed blocks by shard.

        ``keys_of(ids, texts, answer)`` gives them; ``answer`` holds what ``answers`` sent to this bundle."""
        n, spare = self.n, self.spare

        def blocks(ids: list[int | None], texts: list[bytes], got: Got, bundle: int) -> pa.Table:
            keys, values = keys_of(ids, texts, got)
            shards = shard_of(keys, n)
            starts = np.flatnonzero(np.r_[True, shards[1:] != shards[:-1]]) if keys.size else np.zeros(0, np.int64)
            ends = [*starts[1:].tolist(), keys.size]
            packed = [pack_sorted(keys[a:b], *(v[a:b] for v in values), spare=spare) for a, b in zip(starts.tolist(), ends, strict=False)]
            return pa.table([pa.array([bundle] * len(packed), pa.int32()), pa.array(shards[starts], pa.int32()), pa.array(packed, pa.binary())], names=["bundle", "shard", "asked"])

        return self._each(blocks, "bundle int, shard int, asked binary", answers)

    def answer(self, asked: DataFrame, reply: Callable[[Blocks], list[tuple[np.ndarray, ...]]]) -> DataFrame:
        """bundle, shard, answer: ``reply`` sees the blocks of one shard and gives arrays for each, in the same order.
        A block whose arrays are all empty gets no row."""

        spare = self.spare

        def shard(table: pa.Table) -> pa.Table:
            out = [pack(*a) if any(x.size for x in a) else None for a in reply([unpack_sorted(x, spare) for x in table["asked"].to_pylist()])]
            table = pa.table([table["bundle"].combine_chunks(), table["shard"].combine_chunks(), pa.array(out, pa.binary())], names=["bundle", "shard", "answer"])
            return table.filter(table["answer"].is_valid())

        return asked.groupBy("shard").applyInArrow(shard, "bundle int, shard int, answer binary")

    def totals(self, asked: DataFrame, share: Callable[[Blocks], tuple[int, ...]], width: int) -> DataFrame:
        """bundle, shard (-1), totals: the sums of every shard's ``width`` whole numbers, once for each bundle."""
        names, spare = [f"s{k}" for k in range(width)], self.spare

        def shard(table: pa.Table) -> pa.Table:
            return pa.table([pa.array([x], pa.int64()) for x in share([unpack_sorted(x, spare) for x in table["asked"].to_pylist()])], names=names)

        sums = asked.groupBy("shard").applyInArrow(shard, ", ".join(f"{x} long" for x in names)).agg(*[F.coalesce(F.sum(x), F.lit(0)).alias(x) for x in names])
        return sums.select(F.explode(F.sequence(F.lit(0), F.lit(self.n - 1))).alias("bundle"), F.lit(-1).alias("shard"), F.array(*names).alias("totals"))

    def finish(self, result: Callable, schema: str, answers: DataFrame) -> DataFrame:
        """The rows that ``result(ids, texts, answer)`` makes of each bundle; with a column ``totals`` in ``answers`` it
        gets those as a fourth argument."""
        if "totals" in answers.columns:
            return self._each(lambda ids, texts, got, _, sums: result(ids, texts, got, sums), schema, answers)
        return self._each(lambda ids, texts, got, _: result(ids, texts, got), schema, answers)

    def _each(self, make, schema: str, answers: DataFrame | None) -> DataFrame:
        def one(table: pa.Table) -> tuple[list[int | None], list[bytes]]:
            open_text = zstandard.ZstdDecompressor()
            return table["doc_id"].to_pylist(), [open_text.decompress(x) if x else b"" for x in table["packed"].to_pylist()]

        if answers is None:
            return self.docs.groupBy("bundle").applyInArrow(lambda t: make(*one(t), [], t["bundle"][0].as_py()), schema)
        summed = "totals" in answers.columns

        def both(left: pa.Table, right: pa.Table) -> pa.Table:
            bundle = (left if left.num_rows else right)["bundle"][0].as_py()
            sums = []
            if summed:
                first = right.filter(pa.compute.equal(right["shard"], -1))
                sums = [first["totals"][0].as_py()]
                right = right.filter(pa.compute.greater_equal(right["shard"], 0))
            right = right.sort_by("shard")
            return make(*one(left), [tuple(unpack(x)) for x in right["answer"].to_pylist()], bundle, *sums)

        return self.docs.groupBy("bundle").cogroup(answers.groupBy("bundle")).applyInArrow(both, schema)


def joined(got: Got, k: int) -> np.ndarray:
    """The ``k``-th answer array over all shards, in the order of the sorted keys."""
    return np.concatenate([np.zeros(0, np.uint64), *(g[k] for g in got)])
