"""Near-duplicates by Jaccard similarity of word shingles: SimHash at a wide radius proposes, exact similarity decides.

A text's set is the set of its 5-word shingles; two texts link if the Jaccard similarity of their sets is ``SIMILAR`` or
more. Equal sets are one node, with a SimHash fingerprint over the set. At that similarity fingerprints differ in 10 of
64 bits on average (3 standard deviation), and in more than ``RADIUS`` = 24 once in ten million pairs; no split of the
bits into parts finds pairs that far apart, so buckets come from minima of hashes instead: nodes whose minima agree in
all ``ROWS`` hashes of one of ``BANDS`` bands share a bucket (a pair of similarity s shares none with probability
(1 - s^ROWS)^BANDS, 7e-5 at 0.8). Inside the buckets the bit-sliced comparison of ``simhash`` runs:

1. each node proposes its first partner within the radius, exact similarity decides, components are found;
2. buckets that still hold several components are compared again: nodes with a partner within the radius in another
   component meet all of those in the bucket exactly, unless a chain of links joins them already.

So no pair of a bucket within the radius is left undecided, and sets travel for few nodes, not once for each bucket.
Buckets with the same members are compared once. A bucket of more than ``TILE`` nodes is split into tiles that are
compared pair by pair in tasks of their own.

Shingles are 32-bit hashes: two different shingles of a pair of 300-word texts are taken for equal once in 50,000 pairs.

Defined results: words are lower-cased (A-Z only); null text counts as empty, all empty texts are one node; fewer than
five words give one shingle of all words; repeated rows are one node; an empty table gives no rows; a very long text is
shingled whole by one task; all columns stay, whatever their names.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import simhash
from .common import WordHash, gram_hashes, mix, store, sub_batches, text_bytes

SHINGLE, SIMILAR = 5, 0.8
BANDS, ROWS = 24, 5
RADIUS = 24
#: Nodes of a bucket that one task compares with each other or with another such tile.
TILE = 2048
#: Sets that one step compares with a set at once: few at first, as most links are found early.
FIRST, NEXT = 4, 256

MULTIPLIERS = mix(np.arange(1, BANDS * ROWS + 1, dtype=np.uint64)) | np.uint64(1)


def shingles(text: bytes, words: WordHash) -> np.ndarray:
    """The distinct shingle hashes of a text in order."""
    w = words.array(text.lower().split())  # bytes.lower() changes A-Z only
    return np.unique((gram_hashes(w, max(1, min(SHINGLE, len(w)))) >> np.uint64(32)).astype(np.uint32))


def keys_of(sets: list[np.ndarray]) -> np.ndarray:
    """A 64-bit hash of each set; zero for an empty one."""
    out = np.zeros(len(sets), dtype=np.uint64)
    n = np.array([s.size for s in sets], dtype=np.int64)
    if (some := np.flatnonzero(n)).size:
        flat = mix(np.concatenate(sets).astype(np.uint64) + np.uint64(0x9E3779B97F4A7C15))
        starts = (np.cumsum(n) - n)[some]
        out[some] = mix(np.add.reduceat(flat, starts) ^ mix(np.bitwise_xor.reduceat(flat, starts) + n[some].astype(np.uint64)))
    return out


def bands_of(sets: list[np.ndarray]) -> np.ndarray:
    """texts x BANDS bucket hashes; the sets must not be empty."""
    flat = mix(np.concatenate(sets).astype(np.uint64) + np.uint64(0xD1B54A32D192ED03))
    n = np.array([s.size for s in sets], dtype=np.int64)
    starts = np.cumsum(n) - n
    out = np.empty((len(sets), BANDS), dtype=np.uint64)
    for b in range(BANDS):
        h = np.full(len(sets), b, dtype=np.uint64)
        for m in MULTIPLIERS[b * ROWS : (b + 1) * ROWS]:
            h = mix(h * np.uint64(0x9E3779B97F4A7C15) + np.minimum.reduceat(flat * m, starts))
        out[:, b] = h
    return out


def set_keys(texts: list[bytes]) -> np.ndarray:
    words = WordHash()
    return keys_of([shingles(t, words) for t in texts])


def prints_of(sets: list[np.ndarray]) -> np.ndarray:
    """SimHash fingerprint of each set; the sets must not be empty."""
    flat = mix(np.concatenate(sets).astype(np.uint64) + np.uint64(0xA0761D6478BD642F))
    n = np.array([s.size for s in sets], dtype=np.int64)
    starts = np.cumsum(n) - n
    out = np.zeros(len(sets), dtype=np.uint64)
    for b in range(64):
        ones = np.add.reduceat(((flat >> np.uint64(b)) & np.uint64(1)).astype(np.int32), starts)
        out |= (2 * ones > n).astype(np.uint64) << np.uint64(b)
    return out


def signatures(docs: DataFrame, doc_id: str, text: str) -> DataFrame:
    """doc_id, h (hash of the text), fp (hash of the set), sim, bands for each row of ``docs``."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        words = WordHash()
        for batch in batches:
            for part in sub_batches(batch, batch.schema.names[2]):
                sets = [shingles(t, words) for t in text_bytes(part.column(2))]
                some = [k for k, s in enumerate(sets) if s.size]
                bands: list[np.ndarray | None] = [None] * len(sets)
                sim = np.zeros(len(sets), dtype=np.uint64)
                if some:
                    sim[some] = prints_of([sets[k] for k in some])
                    for k, row in zip(some, bands_of([sets[k] for k in some]).view(np.int64), strict=True):
                        bands[k] = row
                yield pa.RecordBatch.from_arrays(
                    [part.column(0).cast(pa.int64()), part.column(1), pa.array(keys_of(sets).view(np.int64)), pa.array(sim.view(np.int64)), pa.array(bands, pa.list_(pa.int64()))],
                    names=["doc_id", "h", "fp", "sim", "bands"],
                )

    return docs.select(F.col(doc_id).cast("long").alias("doc_id"), F.xxhash64(text).alias("h"), text).mapInArrow(run, "doc_id long, h long, fp long, sim long, bands array<long>")


def sets_of(docs: DataFrame, rows: DataFrame, doc_id: str, text: str) -> DataFrame:
    """node, set (its hashes as bytes) for each node of ``rows`` (node, doc_id, h: a row of ``docs`` that has it)."""
    own = docs.select(F.col(doc_id).cast("long").alias("doc_id"), F.xxhash64(text).alias("h"), F.col(text).alias("text"))
    # Shuffled at every size, so that the plan does not change as the table grows. h is of the text: equal texts have it alone.
    found = own.join(rows.hint("shuffle_hash"), (own["h"] == rows["h"]) & own["doc_id"].eqNullSafe(rows["doc_id"])).select("node", "text")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        words = WordHash()
        for batch in batches:
            for part in sub_batches(batch, "text"):
                yield pa.RecordBatch.from_arrays([part.column(0), pa.array([shingles(t, words).tobytes() for t in text_bytes(part.column(1))], pa.binary())], names=["node", "set"])

    return found.mapInArrow(run, "node long, set binary").groupBy("node").agg(F.first("set").alias("set"))


def links(sets: list[np.ndarray], second: np.ndarray | None = None, known: np.ndarray | None = None) -> np.ndarray:
    """The root of each set, all pairs of SIMILAR or more linked; ``second`` as in ``simhash.links``; rows of equal
    ``known`` are linked from the start."""
    n = len(sets)
    size = np.array([s.size for s in sets], dtype=np.int64)
    root = np.arange(n)
    if known is not None:
        _, first, at = np.unique(known, return_index=True, return_inverse=True)
        root = first[at]
    for i in range(1, n):
        ask = np.arange(i)
        fits = np.minimum(size[:i], size[i]) >= SIMILAR * np.maximum(size[:i], size[i]) - 1e-9
        ask = ask[fits if second is None else fits & (second[:i] != second[i])]
        step = FIRST
        while (ask := ask[root[ask] != root[i]]).size:
            now, ask = ask[:step], ask[step:]
            step = NEXT
            flat = np.concatenate([sets[j] for j in now])
            at = np.minimum(np.searchsorted(sets[i], flat), size[i] - 1)
            starts = np.cumsum(size[now]) - size[now]
            both = np.add.reduceat((sets[i][at] == flat).astype(np.int64), starts)
            for j in now[both >= SIMILAR * (size[now] + size[i] - both) - 1e-9]:
                a, b = sorted((root[i], root[j]))
                if a != b:
                    root[root == b] = a
    return root


def buckets(nodes: DataFrame) -> DataFrame:
    """g, t1, t2, second, node, sim: the rows of each bucket that several of ``nodes`` (node, sim, bands) share, by pairs of tiles."""
    rows = nodes.select("node", "sim", F.posexplode("bands").alias("p", "h")).select("node", "sim", F.xxhash64("p", "h").alias("g"))
    h = F.xxhash64(F.lit(5), "node")
    sizes = rows.groupBy("g").agg(F.count("*").alias("n"), F.bit_xor("node").alias("x"), F.bit_xor(h).alias("y"), F.bit_xor(F.xxhash64(F.lit(9), "node")).alias("z")).where("n > 1")
    chosen = sizes.groupBy("n", "x", "y", "z").agg(F.min("g").alias("g")).select("g", "n")
    tiles = F.ceil(F.col("n") / TILE).cast("int")
    rows = rows.join(chosen, "g").withColumn("m", tiles).withColumn("t", F.pmod(h, tiles).cast("int"))
    rows = rows.withColumn("o", F.explode(F.when(F.col("m") == 1, F.array(F.lit(0))).otherwise(F.sequence(F.lit(0), F.col("m") - 1))))
    return rows.select("g", F.least("t", "o").alias("t1"), F.greatest("t", "o").alias("t2"), (F.col("t") > F.col("o")).alias("second"), "node", "sim")


def _dealt(rows: DataFrame) -> DataFrame:
    parts = int(rows.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    return rows.repartition(parts, "g", "t1", "t2").sortWithinPartitions("g", "t1", "t2")


def _runs(*keys: np.ndarray) -> np.ndarray:
    """The number of the run of equal keys that each row is in."""
    new = np.zeros(keys[0].size, dtype=bool)
    new[:1] = True
    for k in keys:
        new[1:] |= k[1:] != k[:-1]
    return np.cumsum(new) - 1


def _close(group: np.ndarray, sim: np.ndarray, crossing: np.ndarray, second: np.ndarray) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """Pairs of rows within the radius; of groups that hold two tiles only pairs across them."""
    for part, marks in ((np.flatnonzero(~crossing), None), (np.flatnonzero(crossing), second)):
        if part.size:
            for a, b in simhash.close_pairs(group[part], sim[part], None if marks is None else marks[part], RADIUS):
                yield part[a], part[b]


def proposals(rows: DataFrame) -> DataFrame:
    """Pairs (a, b): for each node and bucket its first partner within the radius before it, or else after it."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for g, t1, t2, second, node, sim in simhash._whole_groups(batches):
            n = g.size
            before, after = np.full(n, n), np.full(n, n)
            for a, b in _close(_runs(g, t1, t2), sim.view(np.uint64), t1 != t2, second):
                np.minimum.at(before, b, a)
                np.minimum.at(after, a, b)
            partner = np.where(before < n, before, after)
            some = np.flatnonzero(partner < n)
            x, y = node[some], node[partner[some]]
            yield pa.RecordBatch.from_arrays([pa.array(np.minimum(x, y)), pa.array(np.maximum(x, y))], names=["a", "b"])

    return _dealt(rows).mapInArrow(run, "a long, b long").distinct()


def similar(pairs: DataFrame, sets: DataFrame) -> DataFrame:
    """Those of ``pairs`` (a, b) whose sets have a similarity of SIMILAR or more."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            keep = []
            for x, y in zip(batch.column(2).to_pylist(), batch.column(3).to_pylist(), strict=True):
                x, y = np.frombuffer(x, dtype=np.uint32), np.frombuffer(y, dtype=np.uint32)
                keep.append(links([x, y])[1] == 0)
            yield batch.select(["a", "b"]).filter(pa.array(keep, pa.bool_()))

    first = pairs.join(sets.select(F.col("node").alias("a"), F.col("set").alias("x")), "a")
    both = first.join(sets.select(F.col("node").alias("b"), F.col("set").alias("y")), "b").select("a", "b", "x", "y")
    return both.mapInArrow(run, "a long, b long")


def rest(rows: DataFrame, roots: DataFrame, sets: DataFrame) -> DataFrame:
    """Links (a, b) between components (``roots``: node, root) that some bucket still holds apart."""
    rows = rows.join(roots, "node", "left").select("g", "t1", "t2", "second", "node", "sim", F.coalesce("root", "node").alias("root"))
    several = rows.groupBy("g").agg((F.min("root") < F.max("root")).alias("several")).where("several").select("g")

    def apart(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """The rows with a partner within the radius in another component."""
        for g, t1, t2, second, node, sim, root in simhash._whole_groups(batches):
            ask = np.zeros(g.size, dtype=bool)
            for a, b in _close(_runs(g, t1, t2), sim.view(np.uint64), t1 != t2, second):
                other = root[a] != root[b]
                ask[a[other]] = ask[b[other]] = True
            yield pa.RecordBatch.from_arrays([pa.array(x[ask]) for x in (g, t1, t2, second, node, root)], names=["g", "t1", "t2", "second", "node", "root"])

    asked = _dealt(rows.join(several, "g")).mapInArrow(apart, "g long, t1 int, t2 int, second boolean, node long, root long")

    def exact(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for g, t1, t2, second, node, root, packed in simhash._whole_groups(batches):
            a, b = [], []
            run = _runs(g, t1, t2)
            ends = np.flatnonzero(np.r_[run[1:] != run[:-1], True]) + 1
            for s, e in zip([0, *ends[:-1].tolist()], ends.tolist(), strict=True):
                found = links([np.frombuffer(x, dtype=np.uint32) for x in packed[s:e]], second[s:e] if t1[s] != t2[s] else None, root[s:e])
                moved = np.flatnonzero(found != np.arange(found.size))
                a.append(node[s:e][moved])
                b.append(node[s:e][found[moved]])
            a, b = np.concatenate(a), np.concatenate(b)
            yield pa.RecordBatch.from_arrays([pa.array(np.minimum(a, b), pa.int64()), pa.array(np.maximum(a, b), pa.int64())], names=["a", "b"])

    with_sets = asked.join(sets, "node").select("g", "t1", "t2", "second", "node", "root", "set")
    return _dealt(with_sets).mapInArrow(exact, "a long, b long").distinct()


def labelled(docs: DataFrame, doc_id: str, text: str) -> tuple[DataFrame, DataFrame]:
    """(doc_id, fp) of each row, and (fp, root, component_id) of each set."""
    marked = store(signatures(docs, doc_id, text), "signatures")
    nodes = marked.where("bands is not null").groupBy(F.col("fp").alias("node")).agg(F.min_by(F.struct("sim", "bands", "doc_id", "h"), F.struct("doc_id", "h")).alias("x")).select("node", "x.*")

    def edges(_: DataFrame) -> DataFrame:
        rows = store(buckets(nodes.select("node", "sim", "bands")), "buckets")
        pairs = store(proposals(rows), "pairs")
        asked = pairs.select(F.col("a").alias("node")).unionByName(pairs.select(F.col("b").alias("node"))).distinct()
        sets = store(sets_of(docs, nodes.select("node", "doc_id", "h").join(asked, "node"), doc_id, text), "sets")
        found = store(similar(pairs, sets), "similar")
        roots = simhash.components(found)
        return found.unionByName(rest(rows, roots, sets))

    return simhash.named(marked.select("doc_id", "fp"), edges)


def keep_one(docs: DataFrame, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """One row of each component of ``docs``, all columns, chosen as ``simhash.keep_one`` chooses it."""
    return simhash.keep_one(docs, doc_id, text, labelled, set_keys)
