"""SimHash near-duplicates with bit-sliced comparison.

Fingerprints are the bitwise majority of XXH64 (seed 42) over 3-word shingles. Equal fingerprints are one node. Two
nodes within ``RADIUS`` = 2 differing bits agree in at least two of four 16-bit quarters, so six passes group nodes
by a pair of quarters. Inside a group nodes lie in order and their bit planes vertically, 64 nodes a word; carry-save
counters add up the differing bits of a query against a whole word at once, and words in which all nodes have left the
radius are abandoned after every eight planes. Each group sends on a spanning forest of its
links (never all pairs), and the forest's components are found by alternating large-star and small-star rounds.
A group of more than ``TILE`` nodes is split into tiles that are compared pair by pair in tasks of their own, and the
rows of a node with many links or of a fingerprint with many documents are spread over ``SALTS`` tasks.

Defined results: a text without words has fingerprint zero and links like any other; fewer than three words give one
shingle of all words; null text counts as empty; rows with the same doc_id share a component if their texts link,
each keeps its own fingerprint; a null doc_id links others but is never a component's name (a component of null ids
alone gets null); an empty table gives no rows; other columns are not read.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import store, sub_batches, text_bytes

SEED, SHINGLE, RADIUS = 42, 3, 2
#: Pairs of quarters of which one at least is equal if at most two bits differ.
QUARTERS = [(a, b) for a in range(4) for b in range(a + 1, 4)]
#: Nodes of a group that one task compares with each other or with another such tile.
TILE = 8192
#: Tasks over which the rows of one node or fingerprint are spread.
SALTS = 16
#: A longer text is hashed in slices.
LONG_BYTES = 4 << 20


def fingerprint_of(words: list[bytes]) -> int:
    """By the definition, one document at a time (for tests and short use)."""
    if not words:
        return 0
    grams = [b" ".join(words[k : k + SHINGLE]) for k in range(max(1, len(words) - SHINGLE + 1))]
    hashes = [xxhash.xxh64_intdigest(g, SEED) for g in grams]
    return sum(1 << b for b in range(64) if 2 * sum(h >> b & 1 for h in hashes) > len(hashes))


def long_fingerprint(text: bytes) -> int:
    """As ``fingerprint_of``, with the text's shingles hashed and counted in slices."""
    words = text.lower().split()
    n = max(1, len(words) - SHINGLE + 1) if words else 0
    ones = np.zeros(64, dtype=np.int64)
    for at in range(0, n, 1 << 16):
        grams = (b" ".join(words[k : k + SHINGLE]) for k in range(at, min(n, at + (1 << 16))))
        flat = np.array([xxhash.xxh64_intdigest(g, SEED) for g in grams], dtype=np.uint64)
        ones += [np.count_nonzero(flat & (np.uint64(1) << np.uint64(b))) for b in range(64)]
    return sum(1 << b for b in range(64) if 2 * int(ones[b]) > n)


def fingerprints_of(texts: list[bytes]) -> np.ndarray:
    """Fingerprints of a batch of texts."""
    hashes: list[int] = []
    counts = []
    digest = xxhash.xxh64_intdigest
    out = np.zeros(len(texts), dtype=np.uint64)
    for at, text in enumerate(texts):
        if len(text) > LONG_BYTES:
            out[at] = long_fingerprint(text)
            counts.append(0)
            continue
        words = text.lower().split()  # bytes.lower() changes A-Z only
        n = len(words)
        if n <= SHINGLE:
            grams = [b" ".join(words)] if n else []
        else:
            joined = b" ".join(words)
            sizes = np.fromiter(map(len, words), dtype=np.int64, count=n) + 1
            ends = np.cumsum(sizes) - 1
            grams = [joined[a:b] for a, b in zip((ends - sizes + 1).tolist(), ends[SHINGLE - 1 :].tolist(), strict=False)]
        hashes += [digest(g, SEED) for g in grams]
        counts.append(len(grams))
    n = np.array(counts, dtype=np.int64)
    some = np.flatnonzero(n)
    if not some.size:
        return out
    flat = np.array(hashes, dtype=np.uint64)
    starts = (np.cumsum(n) - n)[some]
    for b in range(64):
        ones = np.add.reduceat(((flat >> np.uint64(b)) & np.uint64(1)).astype(np.int64), starts)
        out[some] |= (2 * ones > n[some]).astype(np.uint64) << np.uint64(b)
    return out


def fingerprints(docs: DataFrame, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """doc_id, fp (the 64 bits as a signed long) for each row of ``docs``."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in sub_batches(batch, batch.schema.names[1]):
                yield pa.RecordBatch.from_arrays([part.column(0).cast(pa.int64()), pa.array(fingerprints_of(text_bytes(part.column(1))).view(np.int64))], names=["doc_id", "fp"])

    return docs.select(doc_id, text).mapInArrow(run, "doc_id long, fp long")


# ---- bit-sliced comparison ----


def planes_of(fps: np.ndarray) -> np.ndarray:
    """64 x ceil(n / 64) words: bit i of word w of plane b is bit b of fingerprint 64 w + i."""
    words = -(-fps.size // 64)
    padded = np.zeros(words * 64, dtype=np.uint64)
    padded[: fps.size] = fps
    out = np.empty((64, words), dtype=np.uint64)
    for b in range(64):
        out[b] = np.packbits(((padded >> np.uint64(b)) & np.uint64(1)).astype(np.uint8), bitorder="little").view(np.uint64)
    return out


def within(queries: np.ndarray, words: np.ndarray, planes: np.ndarray, radius: int = RADIUS) -> tuple[np.ndarray, np.ndarray]:
    """Of (query fingerprint, word) comparisons: which have a node within the radius, and the mask of those nodes.

    The counters of all nodes of a word lie as bit planes and begin at 2^k - 1 - radius, so that the carry out of the
    last one marks the nodes with more differing bits than the radius."""
    live = np.arange(queries.size)
    full = np.uint64(0xFFFFFFFFFFFFFFFF)
    k = int(radius).bit_length()
    begin = (1 << k) - 1 - radius
    counter = [np.full(queries.size, full if begin >> j & 1 else 0, dtype=np.uint64) for j in range(k)]
    over = np.zeros(queries.size, dtype=np.uint64)
    for b in range(64):
        flip = np.where((queries[live] >> np.uint64(b)) & np.uint64(1), full, np.uint64(0))
        carry = planes[b, words[live]] ^ flip
        for j in range(k):
            counter[j], carry = counter[j] ^ carry, counter[j] & carry
        over |= carry
        if b % 8 == 7 and b > radius and live.size:
            keep = over != full
            if not keep.all():
                live, over, counter = live[keep], over[keep], [c[keep] for c in counter]
    return live, ~over


class Forest:
    """Union-find over row numbers."""

    def __init__(self, n: int):
        self.parent = np.arange(n)

    def roots(self) -> np.ndarray:
        p = self.parent
        while True:
            q = p[p]
            if np.array_equal(p, q):
                self.parent = p
                return p
            p = q

    def union(self, a: np.ndarray, b: np.ndarray) -> None:
        while a.size:
            p = self.roots()
            x, y = p[a], p[b]
            differ = x != y
            a, b, x, y = a[differ], b[differ], x[differ], y[differ]
            if a.size:
                hook = self.parent.copy()
                np.minimum.at(hook, np.maximum(x, y), np.minimum(x, y))
                self.parent = hook


def links(groups: np.ndarray, fps: np.ndarray, second: np.ndarray | None = None) -> np.ndarray:
    """The root row of each row, rows of one group (a run of equal ``groups``) linked within the radius.

    ``second`` marks the rows of a group's second tile: then only pairs of the two tiles are compared."""
    forest = Forest(fps.size)
    for a, b in close_pairs(groups, fps, second):
        forest.union(a, b)
    return forest.roots()


def close_pairs(groups: np.ndarray, fps: np.ndarray, second: np.ndarray | None = None, radius: int = RADIUS) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """Pairs of rows a < b of one group within the radius, some at a time."""
    n = fps.size
    if not n:
        return
    planes = planes_of(fps)
    new = np.r_[True, groups[1:] != groups[:-1]]
    ends = np.r_[np.flatnonzero(new)[1:], n][np.cumsum(new) - 1]
    rows = np.arange(n)
    first_word = (rows + 1) // 64
    last_word = (ends - 1) // 64
    for step in range(int((last_word - first_word).max()) + 1):
        ask = rows[(first_word + step <= last_word) & (rows + 1 < ends)]
        for at in range(0, ask.size, 1 << 16):
            q = ask[at : at + (1 << 16)]
            word = first_word[q] + step
            live, mask = within(fps[q], word, planes, radius)
            q, word = q[live], word[live]
            base = word * 64
            bits = np.unpackbits(mask.view(np.uint8).reshape(-1, 8), axis=1, bitorder="little").astype(bool)
            i, k = np.nonzero(bits)
            a, b = q[i], base[i] + k
            ok = (b > a) & (b < ends[a])
            if second is not None:
                ok[ok] = second[a[ok]] != second[b[ok]]
            yield a[ok], b[ok]


def candidate_links(nodes: DataFrame) -> DataFrame:
    """Edges (a, b), a < b by number, of a spanning forest of the links between ``nodes`` (node, fp)."""
    keys = F.array(*[F.struct(F.lit(k).alias("p"), _quarter("fp", a).alias("x"), _quarter("fp", b).alias("y")) for k, (a, b) in enumerate(QUARTERS)])
    rows = nodes.select("node", "fp", F.explode(keys).alias("k")).select("node", "fp", (F.shiftleft(F.col("k.p").cast("long"), 32) + F.shiftleft(F.col("k.x"), 16) + F.col("k.y")).alias("g"))
    sizes = rows.groupBy("g").agg(F.count("*").alias("n")).where("n > 1")
    rows = rows.join(sizes, "g")
    # A large group: every row goes to each pair of tiles that its tile is in.
    tiles = F.ceil(F.col("n") / TILE).cast("int")
    tile = F.pmod(F.xxhash64("fp"), tiles).cast("int")
    rows = rows.withColumn("m", tiles).withColumn("t", tile)
    rows = rows.withColumn("o", F.explode(F.when(F.col("m") == 1, F.array(F.lit(0))).otherwise(F.sequence(F.lit(0), F.col("m") - 1))))
    rows = rows.select("g", F.least("t", "o").alias("t1"), F.greatest("t", "o").alias("t2"), (F.col("t") > F.col("o")).alias("second"), "node", "fp")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in _whole_groups(batches):
            g, t1, t2, second, node, fp = batch
            order = np.lexsort((fp, t2, t1, g))
            g, t1, t2, second, node, fp = (x[order] for x in (g, t1, t2, second, node, fp))
            same = (g[1:] == g[:-1]) & (t1[1:] == t1[:-1]) & (t2[1:] == t2[:-1])
            group = np.cumsum(np.r_[True, ~same])
            roots = _two_tiles(group, fp.view(np.uint64), t1 != t2, second)
            moved = np.flatnonzero(roots != np.arange(roots.size))
            a, b = node[moved], node[roots[moved]]
            yield pa.RecordBatch.from_arrays([pa.array(np.minimum(a, b)), pa.array(np.maximum(a, b))], names=["a", "b"])

    parts = int(nodes.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    dealt = rows.repartition(parts, "g", "t1", "t2").sortWithinPartitions("g", "t1", "t2")
    return dealt.mapInArrow(run, "a long, b long").distinct()


def _two_tiles(group: np.ndarray, fps: np.ndarray, crossing: np.ndarray, second: np.ndarray) -> np.ndarray:
    """Roots for groups of which some compare one tile with itself and some two tiles with each other."""
    out = np.arange(fps.size)
    for part, marks in ((np.flatnonzero(~crossing), None), (np.flatnonzero(crossing), second)):
        if part.size:
            out[part] = part[links(group[part], fps[part], None if marks is None else marks[part])]
    return out


def _quarter(fp: str, k: int):
    return F.shiftrightunsigned(F.col(fp), 16 * k).bitwiseAND(F.lit(0xFFFF).cast("long"))


def _whole_groups(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple[np.ndarray, ...]]:
    """Columns of sorted batches, cut so that no group (g, t1, t2) is split; many small groups come together."""
    rest: tuple[np.ndarray, ...] | None = None
    for batch in batches:
        columns = tuple(c.to_numpy(zero_copy_only=False) for c in batch.columns)
        if rest is not None:
            columns = tuple(np.concatenate(x) for x in zip(rest, columns, strict=True))
        g, t1, t2 = columns[:3]
        change = np.flatnonzero((g[1:] != g[:-1]) | (t1[1:] != t1[:-1]) | (t2[1:] != t2[:-1]))
        cut = int(change[-1]) + 1 if change.size else 0
        if cut:
            yield tuple(c[:cut] for c in columns)
        rest = tuple(c[cut:] for c in columns)
    if rest is not None and rest[0].size:
        yield rest


# ---- components ----


def spread(table: DataFrame, rows: DataFrame, key: str, by: str) -> DataFrame:
    """``rows`` with the columns of ``table``, which has one row for each ``key``. Hot keys are split: a key's rows are
    dealt by ``by`` to ``SALTS`` tasks, and its row of ``table`` goes to those tasks that have some."""
    salted = rows.withColumn("salt", F.pmod(F.xxhash64(by), SALTS))
    asked = salted.select(key, "salt").distinct()
    return salted.join(table.join(asked, key), [key, "salt"]).drop("salt")


def with_least(rows: DataFrame, key: str, value: str, by: str) -> DataFrame:
    """``rows`` with ``m``, the least ``value`` of their ``key``, null if none has one; hot keys are split as in ``spread``."""
    salted = rows.withColumn("salt", F.pmod(F.xxhash64(by), SALTS))
    parts = salted.groupBy(key, "salt").agg(F.min(value).alias("m"))
    least = parts.groupBy(key).agg(F.min("m").alias("m"), F.collect_list("salt").alias("salts"))  # at most SALTS of them
    return salted.join(least.select(key, "m", F.explode("salts").alias("salt")), [key, "salt"]).drop("salt")


def components(edges: DataFrame, limit: int = 60) -> DataFrame:
    """(node, root) for every node of ``edges`` (a, b): root is the smallest node reachable.

    Alternating large-star and small-star rounds, each written to the shared folder, until nothing changes."""
    # In each round (u, v) has u > v.
    edges = store(edges.select(F.greatest("a", "b").alias("u"), F.least("a", "b").alias("v")).where("u != v").distinct(), "links")
    last = None
    for _ in range(limit):
        both = edges.unionByName(edges.select(F.col("v").alias("u"), F.col("u").alias("v")))
        large = with_least(both, "u", "v", "v").where("v > u").select(F.col("v").alias("u"), F.least("m", "u").alias("v")).where("u != v").distinct()
        # A node's lower neighbours, and the node itself, go to the least of them.
        small = with_least(large, "u", "v", "v").select(F.explode(F.array("u", "v")).alias("u"), F.col("m").alias("v"))
        edges = store(small.where("u != v").distinct(), "links")
        # Sizes and sums of a round tell whether it changed anything; the sums are of hashes.
        now = edges.agg(F.count("*"), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)"))).first()
        if now == last:
            break
        last = now
    else:
        raise RuntimeError("components did not settle")
    return edges.select(F.col("u").alias("node"), F.col("v").alias("root"))


def _labelled(docs: DataFrame, doc_id: str, text: str) -> tuple[DataFrame, DataFrame]:
    """(doc_id, fp) of each row, and (fp, root, component_id) of each fingerprint."""
    marked = store(fingerprints(docs, doc_id, text), "fingerprints")
    return named(marked, lambda nodes: candidate_links(nodes.select(F.col("fp").alias("node"), "fp")))


def named(marked: DataFrame, edges_of: Callable[[DataFrame], DataFrame]) -> tuple[DataFrame, DataFrame]:
    """``marked`` (doc_id, fp) itself, and (fp, root, component_id) of each fp; ``edges_of`` gives the links of the nodes."""
    # A node is a distinct fingerprint with the smallest doc_id that has it.
    nodes = store(marked.groupBy("fp").agg(F.min("doc_id").alias("least")), "nodes")
    roots = components(edges_of(nodes))
    member = nodes.join(roots.withColumnRenamed("node", "fp"), "fp", "left").select("fp", "least", F.coalesce("root", "fp").alias("root"))
    return marked, store(with_least(member, "root", "least", "fp").select("fp", "root", F.col("m").alias("component_id")), "labels")


def near_duplicates(docs: DataFrame, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """doc_id, fingerprint (16 hex digits), component_id for each row of ``docs``."""
    marked, label = _labelled(docs, doc_id, text)
    return spread(label, marked, "fp", "doc_id").select("doc_id", F.lower(F.lpad(F.hex("fp"), 16, "0")).alias("fingerprint"), "component_id")


def keep_one(docs: DataFrame, doc_id: str = "doc_id", text: str = "text", labelled: Callable = _labelled, prints: Callable = fingerprints_of) -> DataFrame:
    """One row of each component of ``docs``, all columns: the one with its smallest doc_id; where several rows have
    this id, or a component has null ids only, the first by text. ``labelled`` and ``prints`` say what links."""
    marked, label = labelled(docs, doc_id, text)
    first = spread(label, marked, "fp", "doc_id").where((F.col("doc_id") == F.col("component_id")) | F.col("component_id").isNull())
    kept = store(first.groupBy("doc_id").agg(F.count("*").alias("n")), "kept")
    one, several = kept.where("n = 1 and doc_id is not null"), kept.where("n > 1 or doc_id is null")
    # Shuffled at every size: whether the ids could be broadcast must not change how the texts move.
    out = docs.join(one.hint("shuffle_hash"), docs[doc_id] == one["doc_id"], "left_semi")
    if several.isEmpty():
        return out
    # Only rows that repeat an id, or have none, need their fingerprint beside all their columns.
    again = docs.where(docs[doc_id].isNull()).unionByName(docs.join(several, docs[doc_id] == several["doc_id"], "left_semi"))
    rows = _with_fingerprint(again.select(F.struct(*[F.col(f"`{c}`") for c in docs.columns]).alias("row"), F.col(text).alias("text")), prints)
    rows = rows.join(label, "fp").where((F.col(f"row.`{doc_id}`") == F.col("component_id")) | F.col("component_id").isNull())
    chosen = rows.groupBy("root").agg(F.min_by("row", F.struct(F.coalesce(F.col(f"row.`{text}`"), F.lit("")))).alias("row"))
    return out.unionByName(chosen.select("row.*"))


def _with_fingerprint(rows: DataFrame, prints: Callable) -> DataFrame:
    """row, fp from (row, text)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in sub_batches(batch, "text"):
                yield pa.RecordBatch.from_arrays([part.column(0), pa.array(prints(text_bytes(part.column(1))).view(np.int64))], names=["row", "fp"])

    return rows.mapInArrow(run, T.StructType([rows.schema["row"], T.StructField("fp", T.LongType())]))
