"""Importance resampling towards a target distribution by external sort-count.

Documents (the raw side) and target texts become streams of hashed n-gram buckets. Pass one writes, for each slice of
text, one packed uint16 stream with the offsets of its documents to the shared folder. Pass two reads the streams in
blocks, sorts each block and run-length encodes it, merges the runs a task has, and adds them up over all tasks: what is
shuffled is at most one row for each task and bucket. From the counts of both sides each bucket gets a gain, and pass
three gathers the gains along each stream and adds them up between offsets with ``np.add.reduceat``.

The draw adds Gumbel noise made from the id to the weight and takes the highest scores: a range shuffle puts the rows in
order, each task numbers its own, and the sizes of the partitions say where each begins; no task sees all rows.

Defined results: null text counts as empty; a document without features has weight 0; a null id has no noise, so its
score is null, and it is neither drawn nor counted among the candidates; repeated rows are drawn one by one, with ties
in the order id, features, weight; an empty table gives no rows; an empty target has no counts, so common buckets lose;
a very long text is one task's work, with some twenty times its size; other columns are not read.
"""

from __future__ import annotations

import hashlib
import math
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import pieces, store, sub_batches, text_bytes

NGRAM, BUCKETS, SEED, PERCENT, LEAST_WORDS, SCALE = 1, 10_000, 2024, 10, 20, 1000
#: Bucket ids of one sorted block; a task merges its runs when it holds as many.
BLOCK = 1 << 20
#: Rows of the final order in one partition, about.
RANKED_ROWS = 1_000_000
#: Candidates are counted in the same pass, under this bucket.
CANDIDATES = -1

#: Bytes of words stay, A-Z in lower case; all other ASCII separates words.
_WORDS = bytes(b + 32 if 65 <= b <= 90 else b if b >= 128 or 48 <= b <= 57 or 97 <= b <= 122 else 32 for b in range(256))


class Buckets(dict):
    """feature bytes -> bucket, remembered up to a bound so that memory stays flat."""

    def __init__(self, buckets: int, bound: int = 250_000):
        super().__init__()
        self.buckets, self.bound = buckets, bound

    def __missing__(self, feature: bytes) -> int:
        if len(self) >= self.bound:
            self.clear()
        self[feature] = value = zlib.crc32(feature) % self.buckets
        return value


def words_of(text: bytes) -> list[bytes]:
    return text.translate(_WORDS).split()


def features_of(words: list[bytes], n: int) -> list[bytes]:
    """All runs of 1 to ``n`` consecutive words."""
    return words + [b" ".join(words[k : k + size]) for size in range(2, n + 1) for k in range(len(words) - size + 1)]


def _check(n: int, buckets: int) -> None:
    if n < 1 or not 1 <= buckets <= 1 << 16:
        raise ValueError("runs are of one word or more, buckets are numbered by uint16")


def streams(docs: DataFrame, doc_id: str | None, text: str, n: int = NGRAM, buckets: int = BUCKETS) -> DataFrame:
    """One row a slice of text: ids, words (int64, count of each document), offsets (int64, one more than documents),
    stream (uint16), all packed little-endian; known marks the documents with an id (one byte each)."""
    _check(n, buckets)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        bucket = Buckets(buckets)
        for batch in batches:
            for part in sub_batches(batch, batch.schema.names[1]):
                parts, words = [], []
                for t in text_bytes(part.column(1)):
                    w = words_of(t)
                    f = features_of(w, n) if n > 1 else w
                    words.append(len(w))
                    parts.append(np.fromiter(map(bucket.__getitem__, f), dtype="<u2", count=len(f)))
                ids = part.column(0).cast(pa.int64())
                known = ids.is_valid().to_numpy(zero_copy_only=False).astype(np.uint8)
                offsets = np.concatenate([[0], np.cumsum([p.size for p in parts])]).astype("<i8")
                row = (ids.fill_null(0).to_numpy().astype("<i8"), known, np.array(words, dtype="<i8"), offsets, np.concatenate(parts))
                yield pa.RecordBatch.from_arrays([pa.array([x.tobytes()], pa.binary()) for x in row], names=["ids", "known", "words", "offsets", "stream"])

    ids = F.lit(0).cast("long") if doc_id is None else F.col(doc_id).cast("long")
    return docs.select(ids.alias("i"), F.col(text).alias("t")).mapInArrow(run, "ids binary, known binary, words binary, offsets binary, stream binary")


def runs_of(block: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Values and lengths of the runs of a block once it is sorted."""
    block = np.sort(block)
    begin = np.flatnonzero(np.r_[True, block[1:] != block[:-1]]) if block.size else np.zeros(0, dtype=np.int64)
    return block[begin].astype(np.int64), np.diff(np.r_[begin, block.size])


def merged(values: np.ndarray, lengths: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Runs with equal values added up."""
    order = np.argsort(values, kind="stable")
    values, lengths = values[order], lengths[order]
    begin = np.flatnonzero(np.r_[True, values[1:] != values[:-1]]) if values.size else np.zeros(0, dtype=np.int64)
    return values[begin], np.add.reduceat(lengths, begin) if begin.size else lengths


def counts(table: DataFrame, least_words: int = LEAST_WORDS) -> tuple[dict[int, int], int]:
    """Features in each bucket of the streams of ``table``, and how many documents with an id have ``least_words`` words."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        kept: list[tuple[np.ndarray, np.ndarray]] = []
        held, candidates = 0, 0
        for batch in batches:
            for known, words, stream in zip(*(batch.column(k).to_pylist() for k in range(3)), strict=True):
                candidates += int(np.count_nonzero((np.frombuffer(words, "<i8") >= least_words) & (np.frombuffer(known, np.uint8) > 0)))
                flat = np.frombuffer(stream, "<u2")
                for at in range(0, flat.size, BLOCK):
                    kept.append(runs_of(flat[at : at + BLOCK]))
                    held += kept[-1][0].size
                    if held >= BLOCK:
                        kept = [merged(*map(np.concatenate, zip(*kept, strict=True)))]
                        held = kept[0][0].size
        values, lengths = merged(*map(np.concatenate, zip(*kept, strict=True))) if kept else (np.zeros(0, np.int64),) * 2
        yield pa.RecordBatch.from_arrays([pa.array(np.r_[values, CANDIDATES]), pa.array(np.r_[lengths, candidates])], names=["bucket", "n"])

    sums = table.select("known", "words", "stream").mapInArrow(run, "bucket long, n long").groupBy("bucket").agg(F.sum("n").alias("n"))
    out = {r.bucket: r.n for r in sums.collect()}  # one row a bucket
    return out, out.pop(CANDIDATES, 0)


def gains(raw: dict[int, int], target: dict[int, int], buckets: int = BUCKETS) -> np.ndarray:
    """What a feature of each bucket adds to a weight: scaled log ratios of the smoothed shares, rounded down."""
    s, t = sum(raw.values()), sum(target.values())
    return np.array([math.floor(SCALE * math.log((target.get(b, 0) + 1.0) * (s + float(buckets)) / ((raw.get(b, 0) + 1.0) * (t + float(buckets))))) for b in range(buckets)], dtype=np.int64)


def noise(doc_id: int, seed: int) -> int:
    """Scaled Gumbel noise of an id, rounded down."""
    h = int(hashlib.sha256(f"{seed}:{doc_id}".encode()).hexdigest()[:8], 16)
    return math.floor(-SCALE * math.log(-math.log((h + 0.5) / 4294967296)))


def weighted(table: DataFrame, gain: np.ndarray, seed: int = SEED) -> DataFrame:
    """doc_id, n_words, n_features, weight, score of each document of the streams."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for row in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                ids, known, words, offsets, stream = (np.frombuffer(x, k) for x, k in zip(row, ("<i8", np.uint8, "<i8", "<i8", "<u2"), strict=True))
                sizes = np.diff(offsets)
                weight = np.zeros(ids.size, dtype=np.int64)
                if stream.size:
                    some = np.flatnonzero(sizes)
                    weight[some] = np.add.reduceat(gain[stream], offsets[some])
                score = pa.array([w + noise(i, seed) if k else None for i, k, w in zip(ids.tolist(), known.tolist(), weight.tolist(), strict=True)], pa.int64())
                yield pa.RecordBatch.from_arrays([pa.array(ids, mask=known == 0), pa.array(words), pa.array(sizes), pa.array(weight), score], names=["doc_id", "n_words", "n_features", "weight", "score"])

    return table.select("ids", "known", "words", "offsets", "stream").mapInArrow(run, "doc_id long, n_words long, n_features long, weight long, score long")


def numbered(rows: DataFrame, drawn: int, total: int) -> DataFrame:
    """``rows`` with their rank: 1 to ``drawn`` by falling score among the candidates, null for the others."""
    spark = rows.sparkSession
    keys = [F.desc("candidate"), F.desc_nulls_last("score"), F.asc_nulls_last("doc_id"), F.asc("n_features"), F.asc("weight"), F.asc("row")]
    # ``row`` parts rows that are equal otherwise, so that many of them are no single partition.
    parts = max(int(spark.conf.get("spark.sql.shuffle.partitions")), pieces(total, RANKED_ROWS))
    ordered = rows.withColumn("row", F.monotonically_increasing_id()).repartitionByRange(parts, *keys).sortWithinPartitions(*keys)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark import TaskContext

        part, at = TaskContext.get().partitionId(), 0
        for batch in batches:
            n = batch.num_rows
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(np.full(n, part, dtype=np.int32)), pa.array(np.arange(at, at + n))], names=[*batch.schema.names, "part", "at"])
            at += n

    placed = store(ordered.drop("row").mapInArrow(run, "doc_id long, n_words long, n_features long, weight long, score long, candidate boolean, part int, at long"), "ordered")
    sizes = sorted(tuple(r) for r in placed.groupBy("part").agg(F.count("*").alias("n")).collect())  # one row a partition
    before, begin = 0, []
    for part, n in sizes:
        begin.append((part, before))
        before += n
    starts = F.broadcast(spark.createDataFrame(begin, "part int, before long"))
    rank = F.col("before") + F.col("at") + 1
    return placed.join(starts, "part").withColumn("rank", F.when(F.col("candidate") & (rank <= drawn), rank))


def resample(
    docs: DataFrame, target: DataFrame, doc_id: str = "doc_id", text: str = "text", target_text: str = "text",
    n: int = NGRAM, buckets: int = BUCKETS, seed: int = SEED, percent: int = PERCENT, least_words: int = LEAST_WORDS,
) -> DataFrame:
    """doc_id, n_features, weight, score, rank for each row of ``docs``; the drawn ``percent`` of those with at least
    ``least_words`` words have a rank."""
    table = store(streams(docs, doc_id, text, n, buckets), "streams")
    raw, candidates = counts(table, least_words)
    wanted, _ = counts(streams(target, None, target_text, n, buckets))
    rows = weighted(table, gains(raw, wanted, buckets), seed).withColumn("candidate", (F.col("n_words") >= least_words) & F.col("doc_id").isNotNull())
    rows = store(rows, "weights")
    return numbered(rows, percent * candidates // 100, rows.count()).select("doc_id", "n_features", "weight", "score", "rank")
