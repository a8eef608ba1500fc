"""Exact self-join of texts by Jaccard similarity of their word shingles, with signature trees.

A text's set is its distinct 5-word shingles as 64-bit hashes; two texts link if 100 * intersection >= 80 * union. Equal
sets are one node. The join goes through these steps, each written to the shared folder where it is used twice:

1. One pass over the texts gives node and size of each document, and counts shingles. Those that very many texts have
   (at most ``HOT_TOKENS`` of them by the choice of the limit, so the list may be broadcast) come last in the order of
   shingles, all others go by hash.
2. Linked sets of n share one of their first n - ceil(0.8 n) + 1 shingles in that order. A task sends these once for each
   distinct set, packed by shard; a shard finds the shingles that several sets have and cuts their groups at gaps of
   size. Hot shingles are not dealt by shingle but by set, so that none of them is a task's work. Groups with the same
   members are kept once.
3. A group becomes a **signature tree**: leaves are sets in order of their least hash and size, with a bitmap of their
   shingles; inner nodes hold the OR of their children's bitmaps, the range of sizes and the largest slack (shingles that
   share a bit with another one of their set). A dual traversal from the root against itself drops a pair of tree nodes
   if the size ranges rule out 0.8, if the bits that both have plus the slack can't reach the overlap that the smallest
   sizes need, or if both lie in one component already; pairs of leaves that are left are compared exactly.
4. The first traversal of all groups is by coarse bitmaps, made in step 1, alone: only members with a possible partner go
   on, with their sets. Then each node meets the others in its largest and its smallest group, which links nearly all
   copies, and groups that still hold several components go through their trees again. So every pair that shares a
   prefix shingle is ruled out by a bound, compared, or joined by a chain of links: no link is lost, no pairs are listed.

Groups of more than ``TILE`` sets or ``TILE_TOKENS`` shingles are split into tiles that are compared pair by pair in tasks of
their own. Sets are read from the texts again for nodes in some group, found by a filter of bounded size.

Defined results: words are lower-cased (A-Z only); null text counts as empty; a text without words has no shingles,
links with nothing and is its own component; fewer than five words give one shingle of all words; rows with equal ids
share a component if their texts link; a null id links others but is never a component's name (a component of null ids
alone gets null); an empty table gives no rows; a very long text is shingled whole by one task, with some thirty times
its size; other columns are not read. Two different sets share a 64-bit key once in 10^19 pairs.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import simhash
from .bundles import pack, unpack
from .common import WordHash, gram_hashes, mix, pieces, store, sub_batches, text_bytes
from .near_dedup import keys_of

SHINGLE = 5
#: Texts link if 100 * intersection >= SHARE * union.
SHARE = 80
#: A shingle is hot in LEAST_HOT texts, and where these would be too many in more than a share of 1 / HOT_TOKENS of all.
LEAST_HOT, HOT_TOKENS = 128, 1 << 22
#: Shingles that a task counts at a time, that it packs at a time, and that a shard gets.
COUNTED, BLOCK, SHARD = 1 << 22, 1 << 20, 1 << 20
#: Sets and shingles of a group that one task compares with each other or with another such tile.
TILE, TILE_TOKENS = 2048, 1 << 21
#: Children of a tree node; bits of a leaf's bitmap for each shingle: of coarse ones, and of those made from sets.
FAN, COARSE, FINE = 4, 2, 4
#: Bits of the filter of asked nodes: FILTER_EACH for each, at most FILTER_BITS.
FILTER_EACH, FILTER_BITS = 16, 1 << 27
#: Rows that are compared come in partitions of about this size.
PARTITION_BYTES = 64 << 20
#: A root that no node has: of leaves that are asked anyway.
ASKED = -(1 << 63)
#: Distinct sets that a task remembers having sent.
SEEN = 1 << 20

U = np.uint64


def shingles(text: bytes, words: WordHash) -> np.ndarray:
    """The distinct shingle hashes of a text in order."""
    w = words.array(text.lower().split())  # bytes.lower() changes A-Z only
    return np.unique(gram_hashes(w, min(SHINGLE, len(w)))) if len(w) else np.zeros(0, dtype=np.uint64)


def least_overlap(size: np.ndarray) -> np.ndarray:
    """The overlap that a set of ``size`` needs at least with any set it links with."""
    return -(-SHARE * size // 100)


def linked_by(both: np.ndarray, a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Whether an overlap of ``both`` links sets of sizes ``a`` and ``b``."""
    return (100 + SHARE) * both >= SHARE * (a + b)


def overlap(x: np.ndarray, y: np.ndarray) -> int:
    if x.size < y.size:
        x, y = y, x
    at = np.searchsorted(x, y)
    at[at == x.size] = 0
    return int(np.count_nonzero(x[at] == y))


def _sets(part: pa.RecordBatch, words: WordHash) -> tuple[list[np.ndarray], np.ndarray]:
    sets = [shingles(t, words) for t in text_bytes(part.column(1))]
    return sets, keys_of(sets)


# ---- 1: nodes, hot shingles ----


def signatures(docs: DataFrame, doc_id: str, text: str) -> DataFrame:
    """doc_id, node, n, least (hash), bits (coarse) of each row of ``docs`` (node is null without words), and rows
    without these whose tokens and counts tell which shingles occur in several sets of a block."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        words, names = WordHash(), ["doc_id", "node", "n", "least", "bits", "tokens", "counts"]
        held: dict[int, np.ndarray] = {}
        size = 0

        def counted() -> pa.RecordBatch:
            token, n = np.unique(np.concatenate(list(held.values())), return_counts=True)
            token, n = token[n > 1], n[n > 1].astype("<i8")
            none = pa.nulls(1, pa.int64())
            return pa.RecordBatch.from_arrays([none, none, none, none, pa.nulls(1, pa.binary()), *(pa.array([x.tobytes()], pa.binary()) for x in (token, n))], names=names)

        for batch in batches:
            for part in sub_batches(batch, batch.schema.names[1]):
                sets, keys = _sets(part, words)
                n = np.array([s.size for s in sets], dtype=np.int64)
                nothing = pa.nulls(len(sets), pa.binary())
                least = pa.array([int(s[0] >> U(1)) if s.size else None for s in sets], pa.int64())
                bits = pa.array([bitmap_of(s, COARSE).tobytes() if s.size else None for s in sets], pa.binary())
                yield pa.RecordBatch.from_arrays([part.column(0).cast(pa.int64()), pa.array(keys.view(np.int64), mask=n == 0), pa.array(n), least, bits, nothing, nothing], names=names)
                for key, s in zip(keys.tolist(), sets, strict=True):
                    if s.size and key not in held:
                        held[key] = s
                        size += s.size
                if size >= COUNTED:
                    yield counted()
                    held, size = {}, 0
        if held:
            yield counted()

    return docs.select(F.col(doc_id).cast("long").alias("i"), F.col(text).alias("t")).mapInArrow(run, "doc_id long, node long, n long, least long, bits binary, tokens binary, counts binary")


def hot_tokens(marked: DataFrame, total: int) -> np.ndarray:
    """The hot shingles in order: at most ``HOT_TOKENS``, as all counts together are at most ``total``."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for token, n in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
                yield pa.RecordBatch.from_arrays([pa.array(np.frombuffer(token, "<i8")), pa.array(np.frombuffer(n, "<i8"))], names=["token", "n"])

    limit = max(LEAST_HOT, total // HOT_TOKENS)
    sums = marked.where("tokens is not null").select("tokens", "counts").mapInArrow(run, "token long, n long").groupBy("token").agg(F.sum("n").alias("n"))
    return np.sort(sums.where(F.col("n") > limit).select("token").toArrow().column(0).to_numpy().astype(np.int64).view(np.uint64))


# ---- 2: groups of sets that share a prefix shingle ----


def prefixes(sets: list[np.ndarray], hot: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Token, number of its set and whether it is hot, of the prefix of each set; the sets must not be empty."""
    flat = np.concatenate(sets)
    n = np.array([s.size for s in sets], dtype=np.int64)
    owner = np.repeat(np.arange(len(sets)), n)
    at = np.minimum(np.searchsorted(hot, flat), max(hot.size - 1, 0))
    is_hot = hot[at] == flat if hot.size else np.zeros(flat.size, dtype=bool)
    order = np.lexsort((flat, is_hot, owner))
    rank = np.arange(flat.size) - np.repeat(np.cumsum(n) - n, n)
    keep = order[rank < np.repeat(n - least_overlap(n) + 1, n)]
    return flat[keep], owner[keep], is_hot[keep]


def members(docs: DataFrame, doc_id: str, text: str, hot: np.ndarray, total: int) -> DataFrame:
    """g, node, n: the members of each group."""
    shards = pieces(total * (100 - SHARE) // 100, SHARD)
    shared = docs.sparkSession.sparkContext.broadcast(hot)

    def blocks(token: np.ndarray, owner: np.ndarray, is_hot: np.ndarray, node: np.ndarray, n: np.ndarray) -> pa.RecordBatch:
        by = np.where(is_hot, mix(node[owner] + U(11)), mix(token + U(13)))
        shard = ((by >> U(32)) * U(shards) >> U(32)).astype(np.int64)
        shard = np.where(is_hot, -1 - shard, shard)
        order = np.lexsort((token, shard))
        token, owner, shard = token[order], owner[order], shard[order]
        names, data = [], []
        begin = np.flatnonzero(np.r_[True, shard[1:] != shard[:-1]])
        for a, b in zip(begin.tolist(), [*begin[1:].tolist(), shard.size], strict=True):
            own, local = np.unique(owner[a:b], return_inverse=True)
            names.append(int(shard[a]))
            data.append(pack(np.diff(token[a:b], prepend=U(0)), local, node[own], n[own]))
        return pa.RecordBatch.from_arrays([pa.array(names, pa.int64()), pa.array(data, pa.binary())], names=["shard", "data"])

    def send(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        words, hot, seen = WordHash(), shared.value, set()
        held: list[tuple[np.ndarray, ...]] = []
        sets_held = size = 0

        def flushed() -> pa.RecordBatch:
            return blocks(*(np.concatenate(x) for x in zip(*held, strict=True)))

        for batch in batches:
            for part in sub_batches(batch, batch.schema.names[1]):
                sets, keys = _sets(part, words)
                fresh = []
                for k, (key, s) in enumerate(zip(keys.tolist(), sets, strict=True)):
                    if s.size and key not in seen:
                        seen.add(key)
                        fresh.append(k)
                if len(seen) > SEEN:
                    seen.clear()
                if fresh:
                    token, owner, is_hot = prefixes([sets[k] for k in fresh], hot)
                    held.append((token, owner + sets_held, is_hot, keys[fresh], np.array([sets[k].size for k in fresh], dtype=np.int64)))
                    sets_held += len(fresh)
                    size += token.size
                if size >= BLOCK:
                    yield flushed()
                    held, sets_held, size = [], 0, 0
        if held:
            yield flushed()

    def group(key: tuple, table: pa.Table) -> pa.Table:
        got = []
        for data in table.column("data").to_pylist():
            steps, local, node, n = unpack(data)
            local = local.astype(np.int64)
            got.append((np.cumsum(steps, dtype=np.uint64), node[local], n[local].astype(np.int64)))
        token, node, n = (np.concatenate(x) for x in zip(*got, strict=True))
        order = np.lexsort((node, n, token))
        token, node, n = token[order], node[order], n[order]
        new = np.r_[True, (token[1:] != token[:-1]) | (node[1:] != node[:-1])]
        token, node, n = token[new], node[new], n[new]
        if key[0].as_py() < 0:  # hot ones, whose groups are in all shards
            g = mix(token + U(29))
        else:
            begin = np.flatnonzero(np.r_[True, (token[1:] != token[:-1]) | (100 * n[:-1] < SHARE * n[1:])])
            length = np.diff(np.r_[begin, token.size])
            one, two = (np.add.reduceat(mix(node + U(k)), begin) for k in (17, 23))
            pair = np.empty(begin.size, dtype=[("a", np.uint64), ("b", np.uint64)])
            pair["a"], pair["b"] = one, two
            first = np.zeros(begin.size, dtype=bool)
            first[np.unique(pair, return_index=True)[1]] = True
            keep = np.repeat(first & (length > 1), length)
            g = np.repeat(mix(token[begin] + mix(n[begin].astype(np.uint64) + U(3))), length)
            g, node, n = g[keep], node[keep], n[keep]
        return pa.table({"g": pa.array(g.view(np.int64)), "node": pa.array(node.view(np.int64)), "n": pa.array(n)})

    packed = docs.select(F.col(doc_id).cast("long").alias("i"), F.col(text).alias("t")).mapInArrow(send, "shard long, data binary")
    return packed.groupBy("shard").applyInArrow(group, "g long, node long, n long")


def distinct_groups(rows: DataFrame) -> DataFrame:
    """``rows`` (g, node, n) of groups with several members, one of those with the same members, and the group's count."""
    sizes = rows.groupBy("g").agg(F.count("*").alias("count"), F.bit_xor(F.xxhash64(F.lit(1), "node")).alias("x"), F.bit_xor(F.xxhash64(F.lit(2), "node")).alias("y")).where("count > 1")
    return rows.join(sizes.groupBy("count", "x", "y").agg(F.min("g").alias("g")).select("g", "count"), "g")


def tiled(rows: DataFrame) -> DataFrame:
    """g, t1, t2, second, node, n, root: the rows of each group of several members, by pairs of its tiles."""
    sizes = rows.groupBy("g").agg(F.count("*").alias("count"), F.sum("n").alias("tokens")).where("count > 1")
    tiles = F.ceil(F.greatest(F.col("count") / TILE, F.col("tokens") / TILE_TOKENS)).cast("int")
    rows = rows.join(sizes.select("g", tiles.alias("m")), "g").withColumn("t", F.pmod(F.xxhash64(F.lit(5), "node"), "m").cast("int"))
    rows = rows.withColumn("o", F.explode(F.when(F.col("m") == 1, F.array(F.lit(0))).otherwise(F.sequence(F.lit(0), F.col("m") - 1))))
    return rows.select("g", F.least("t", "o").alias("t1"), F.greatest("t", "o").alias("t2"), (F.col("t") > F.col("o")).alias("second"), "node", "n", "root")


# ---- sets of asked nodes ----


def _positions(node: np.ndarray, bits: int) -> tuple[np.ndarray, np.ndarray]:
    return tuple((mix(node + U(k)) & U(bits - 1)).astype(np.int64) for k in (101, 103))


def node_filter(asked: DataFrame, count: int) -> np.ndarray:
    """A Bloom filter, as 32-bit words, of ``asked`` (node): its size is bounded, a full one only lets more through."""
    bits = min(FILTER_BITS, max(1 << 10, 1 << (FILTER_EACH * count - 1).bit_length()))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            at = np.unique(np.concatenate(_positions(batch.column(0).to_numpy().view(np.uint64), bits)))
            yield pa.RecordBatch.from_arrays([pa.array((at >> 5).astype(np.int32)), pa.array(np.int64(1) << (at & 31))], names=["word", "bit"])

    words = asked.mapInArrow(run, "word int, bit long").groupBy("word").agg(F.bit_or("bit").alias("bit")).toArrow()
    out = np.zeros(bits >> 5, dtype=np.uint32)
    out[words.column(0).to_numpy()] = words.column(1).to_numpy().astype(np.uint32)
    return out


def sets_of(docs: DataFrame, text: str, asked: DataFrame) -> DataFrame:
    """node, set (its hashes in order as bytes) for each node of ``asked`` (node, without repeats)."""
    shared = docs.sparkSession.sparkContext.broadcast(node_filter(asked, asked.count()))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        words, wanted, seen = WordHash(), shared.value, set()
        for batch in batches:
            for part in sub_batches(batch, batch.schema.names[1]):
                sets, keys = _sets(part, words)
                hit = np.array([s.size > 0 for s in sets], dtype=bool)
                for at in _positions(keys, wanted.size << 5):
                    hit &= (wanted[at >> 5] >> (at & 31).astype(np.uint32)) & np.uint32(1) > 0
                fresh = []
                for k in np.flatnonzero(hit).tolist():
                    if (key := int(keys[k])) not in seen:
                        seen.add(key)
                        fresh.append(k)
                if len(seen) > SEEN:
                    seen.clear()
                yield pa.RecordBatch.from_arrays([pa.array(keys[fresh].view(np.int64)), pa.array([sets[k].tobytes() for k in fresh], pa.binary())], names=["node", "set"])

    found = docs.select(F.lit(0).alias("i"), F.col(text).alias("t")).mapInArrow(run, "node long, set binary")
    return found.join(asked.hint("shuffle_hash"), "node").dropDuplicates(["node"])


# ---- 3: signature trees ----


def bitmap_of(tokens: np.ndarray, each: int) -> np.ndarray:
    """The bitmap of a set, as words: a power of two of bits, ``each`` for each shingle at least."""
    bits = max(64, 1 << (each * tokens.size - 1).bit_length())
    out = np.zeros(bits, dtype=np.uint8)
    out[(mix(tokens + U(7)) & U(bits - 1)).astype(np.int64)] = 1
    return np.packbits(out, bitorder="little").view(np.uint64)


def folded(bitmap: np.ndarray, words: int) -> np.ndarray:
    """A bitmap of fewer words that has the same shingles."""
    return np.bitwise_or.reduce(bitmap.reshape(-1, words), axis=0)


class Trees:
    """Signature trees of many groups, with one array of nodes for each level; level 0 holds the leaves."""

    def __init__(self, tree: np.ndarray, n: np.ndarray, root: np.ndarray, bitmaps: np.ndarray):
        """Leaves lie in the order of their ``tree``; ``root`` is the component of each."""
        slack = n - np.bitwise_count(bitmaps).sum(axis=1, dtype=np.int64)
        self.levels = [{"tree": tree, "bits": bitmaps, "lo": n, "hi": n, "slack": slack, "rmin": root, "rmax": root}]
        while True:
            low = self.levels[-1]
            new = np.r_[True, low["tree"][1:] != low["tree"][:-1]]
            if new.all():
                break
            starts = np.flatnonzero(new)
            place = np.arange(new.size) - starts[np.cumsum(new) - 1]
            first = np.flatnonzero(place % FAN == 0)
            self.levels.append(
                {
                    "tree": low["tree"][first], "bits": np.bitwise_or.reduceat(low["bits"], first, axis=0), "lo": np.minimum.reduceat(low["lo"], first), "hi": np.maximum.reduceat(low["hi"], first),
                    "slack": np.maximum.reduceat(low["slack"], first), "first": first, "end": np.r_[first[1:], new.size],
                }
            )
        self.relabel(root)

    def relabel(self, root: np.ndarray) -> None:
        """New components of the leaves."""
        self.levels[0]["rmin"] = self.levels[0]["rmax"] = root
        for low, level in zip(self.levels, self.levels[1:], strict=False):
            level["rmin"], level["rmax"] = np.minimum.reduceat(low["rmin"], level["first"]), np.maximum.reduceat(low["rmax"], level["first"])

    def possible(self, at: int, i: np.ndarray, j: np.ndarray) -> np.ndarray:
        """Which pairs of nodes of a level may hold a link between components."""
        x = self.levels[at]
        lo_i, lo_j, hi_i, hi_j = x["lo"][i], x["lo"][j], x["hi"][i], x["hi"][j]
        one = (x["rmin"][i] == x["rmax"][i]) & (x["rmin"][j] == x["rmax"][j]) & (x["rmin"][i] == x["rmin"][j])
        keep = np.flatnonzero((100 * hi_i >= SHARE * lo_j) & (100 * hi_j >= SHARE * lo_i) & ~one)
        i, j = i[keep], j[keep]
        most = np.bitwise_count(x["bits"][i] & x["bits"][j]).sum(axis=1, dtype=np.int64) + np.minimum(x["slack"][i], x["slack"][j])
        most = np.minimum(most, np.minimum(x["hi"][i], x["hi"][j]))
        return keep[linked_by(most, x["lo"][i], x["lo"][j])]

    def traverse(self, i: np.ndarray, j: np.ndarray) -> Iterator[tuple[np.ndarray, np.ndarray]]:
        """Pairs of different leaves, i before j, that may link, from pairs of top nodes. What ``relabel`` was told
        meanwhile counts for the rest."""
        chunk = max(256, (1 << 20) // self.levels[0]["bits"].shape[1])
        stack = [(len(self.levels) - 1, i, j)]
        while stack:
            at, i, j = stack.pop()
            if i.size > chunk:
                stack.append((at, i[chunk:], j[chunk:]))
                i, j = i[:chunk], j[:chunk]
            keep = self.possible(at, i, j)
            i, j = i[keep], j[keep]
            if not at:
                apart = i < j
                if apart.any():
                    yield i[apart], j[apart]
            elif i.size:
                first, end = self.levels[at]["first"], self.levels[at]["end"]
                a, b = end[i] - first[i], end[j] - first[j]
                pair = np.repeat(np.arange(i.size), a * b)
                k = np.arange(pair.size) - np.repeat(np.cumsum(a * b) - a * b, a * b)
                x, y = first[i][pair] + k // b[pair], first[j][pair] + k % b[pair]
                fits = x <= y  # of a node with itself each pair once
                stack.append((at - 1, x[fits], y[fits]))


def _runs(*keys: np.ndarray) -> np.ndarray:
    """The number of the run of equal keys that each row is in."""
    new = np.zeros(keys[0].size, dtype=bool)
    new[:1] = True
    for k in keys:
        new[1:] |= k[1:] != k[:-1]
    return np.cumsum(new) - 1


def trees_of(run: np.ndarray, crossing: np.ndarray, second: np.ndarray, n: np.ndarray, least: np.ndarray, root: np.ndarray, bitmaps: list[np.ndarray]) -> Iterator[tuple[np.ndarray, Trees, np.ndarray, np.ndarray]]:
    """Trees over the rows of groups (``run``): which rows the leaves are, the trees, and the pairs of top nodes to begin
    with. Groups that are ``crossing`` hold two tiles, of which pairs meet.

    Bitmaps of linked sets have the same width or one is twice as wide, as sizes differ by a quarter at most. So leaves
    of one width meet each other, and those of each width meet those of twice the width, folded."""
    size = np.array([b.size for b in bitmaps], dtype=np.int64)
    side = crossing & second
    for w in np.unique(size).tolist():
        narrow, wide = size == w, size == 2 * w
        ways = [(narrow, side, crossing)]
        if wide.any():
            ways += [((narrow | wide) & ~crossing, wide, ~crossing), (crossing & np.where(second, wide, narrow), side, crossing), (crossing & np.where(second, narrow, wide), side, crossing)]
        for chosen, half, cross in ways:
            rows = np.flatnonzero(chosen)
            if rows.size > 1:
                rows = rows[np.lexsort((n[rows], least[rows], half[rows], run[rows]))]
                trees = Trees(2 * run[rows] + half[rows], n[rows], root[rows], np.stack([bitmaps[k] if bitmaps[k].size == w else folded(bitmaps[k], w) for k in rows.tolist()]))
                top = trees.levels[-1]["tree"]
                meets = np.zeros(run[-1] + 1, dtype=bool)
                meets[run[rows]] = cross[rows]
                alone = np.flatnonzero(~meets[top // 2])
                met = np.flatnonzero(meets[top[:-1] // 2] & (top[:-1] // 2 == top[1:] // 2))
                yield rows, trees, np.r_[alone, met], np.r_[alone, met + 1]


# ---- 4: links ----


def _dealt(rows: DataFrame, size: int) -> DataFrame:
    """``rows``, of ``size`` bytes, with whole groups in one partition, sorted by them."""
    parts = max(int(rows.sparkSession.conf.get("spark.sql.shuffle.partitions")), pieces(size, PARTITION_BYTES))
    return rows.repartition(parts, "g", "t1", "t2").sortWithinPartitions("g", "t1", "t2")


def asked_again(rows: DataFrame, bitmaps: DataFrame, size: int) -> DataFrame:
    """The rows of ``rows`` (as ``tiled`` gives them) that may link with one of another component, by ``bitmaps``."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        names = ["g", "t1", "t2", "second", "node", "n", "root"]
        for g, t1, t2, second, node, n, root, least, bits in simhash._whole_groups(batches):
            ask = np.zeros(g.size, dtype=bool)
            for at, trees, i, j in trees_of(_runs(g, t1, t2), t1 != t2, second, n, least, root, [np.frombuffer(x, np.uint64) for x in bits]):
                part, known = root[at], np.zeros(at.size, dtype=bool)
                for a, b in trees.traverse(i, j):
                    before = np.count_nonzero(known)
                    known[a] = known[b] = True
                    if np.count_nonzero(known) > before:
                        # Leaves that are asked anyway need not meet: from now on they count as one component.
                        trees.relabel(np.where(known, ASKED, part))
                ask[at[known]] = True
            yield pa.RecordBatch.from_arrays([pa.array(x[ask]) for x in (g, t1, t2, second, node, n, root)], names=names)

    joined = rows.join(bitmaps, "node").select("g", "t1", "t2", "second", "node", "n", "root", "least", "bits")
    return _dealt(joined, size).mapInArrow(run, "g long, t1 int, t2 int, second boolean, node long, n long, root long")


def compared(trees: Trees, i: np.ndarray, j: np.ndarray, sets: list[np.ndarray], root: np.ndarray) -> Iterator[tuple[int, int]]:
    """Links (a, b) between leaves that join components, from the pairs of top nodes; ``root`` is changed."""
    for a, b in trees.traverse(i, j):
        changed = False
        while a.size:
            apart = root[a] != root[b]
            a, b = a[apart], b[apart]
            # One partner for each leaf at a time: a link found saves its other comparisons.
            now = np.zeros(a.size, dtype=bool)
            now[np.unique(b, return_index=True)[1]] = True
            for x, y in zip(a[now].tolist(), b[now].tolist(), strict=True):
                if root[x] != root[y] and linked_by(overlap(sets[x], sets[y]), sets[x].size, sets[y].size):
                    low, high = sorted((root[x], root[y]))
                    root[root == high] = low
                    changed = True
                    yield x, y
            a, b = a[~now], b[~now]
        if changed:
            trees.relabel(root)


def linked(rows: DataFrame, sets: DataFrame, size: int) -> DataFrame:
    """Links (a, b) of nodes that join the components of ``rows`` (as ``tiled`` gives them) inside their groups."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for g, t1, t2, second, node, n, root, packed in simhash._whole_groups(batches):
            tokens = [np.frombuffer(x, np.uint64) for x in packed]
            least = np.array([t[0] >> U(1) for t in tokens], dtype=np.int64)
            group = _runs(g, t1, t2)
            found: list[tuple[int, int]] = []
            # Components are known for each group apart: numbers of (group, root).
            numbers = np.unique(root, return_inverse=True)[1]
            own = np.unique(group * (numbers.max() + 1) + numbers, return_inverse=True)[1]
            for at, trees, i, j in trees_of(group, t1 != t2, second, n, least, own, [bitmap_of(t, FINE) for t in tokens]):
                before, after = own[at], own[at]
                trees.relabel(after)
                found += [(int(at[x]), int(at[y])) for x, y in compared(trees, i, j, [tokens[k] for k in at.tolist()], after)]
                label = np.arange(own.max() + 1)
                label[before] = after
                own = label[own]
            a, b = np.array([x for x, _ in found], dtype=np.int64), np.array([y for _, y in found], dtype=np.int64)
            yield pa.RecordBatch.from_arrays([pa.array(np.minimum(node[a], node[b]), pa.int64()), pa.array(np.maximum(node[a], node[b]), pa.int64())], names=["a", "b"])

    joined = rows.join(sets, "node").select("g", "t1", "t2", "second", "node", "n", "root", "set")
    return _dealt(joined, size).mapInArrow(run, "a long, b long")


def _tokens(rows: DataFrame) -> int:
    return rows.agg(F.sum("n")).first()[0] or 0


def _met_again(asked: DataFrame, purpose: str) -> DataFrame:
    """The groups that are left of the rows of ``asked``; many have the same members now."""
    return store(distinct_groups(store(asked.select("g", "node", "n", "root").distinct(), f"{purpose}-rows")), purpose)


def edges(docs: DataFrame, doc_id: str, text: str, marked: DataFrame, total: int) -> DataFrame:
    """Links (a, b) of nodes that join all that the similarity links; ``marked`` are the signatures."""
    found = members(docs, doc_id, text, hot_tokens(marked, total), total)
    groups = store(distinct_groups(store(found, "members")), "groups").select("g", "node", "n")
    inside = groups.select("node").distinct()
    bitmaps = store(marked.select("node", "least", "bits").join(inside, "node").dropDuplicates(["node"]), "bitmaps")
    bytes_each = COARSE / 6  # of a shingle; a power of two of bits has 1.5 times as many as are needed on average
    possible = asked_again(tiled(groups.withColumn("root", F.col("node"))), bitmaps, int(bytes_each * _tokens(groups)))
    rows = _met_again(possible, "possible")
    sets = store(sets_of(docs, text, rows.select("node").distinct()), "sets")
    best = F.struct("count", "g")
    chosen = rows.groupBy("node").agg(F.array_distinct(F.array(F.max(best), F.min(best))).alias("x")).select("node", F.explode("x.g").alias("g"))
    first = store(tiled(rows.select("g", "node", "n").join(chosen, ["g", "node"]).withColumn("root", F.col("node"))), "first")
    links = store(linked(first, sets, 8 * _tokens(first)).distinct(), "links")
    roots = simhash.components(links)
    rows = rows.select("g", "node", "n").join(roots, "node", "left").select("g", "node", "n", F.coalesce("root", "node").alias("root"))
    several = rows.groupBy("g").agg((F.min("root") < F.max("root")).alias("several")).where("several").select("g")
    rest = store(tiled(rows.join(several, "g")), "rest")
    asked = store(tiled(_met_again(asked_again(rest, bitmaps, int(bytes_each * _tokens(rest))), "again")), "asked")
    return links.unionByName(linked(asked, sets, 8 * _tokens(asked)).distinct())


def join(docs: DataFrame, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """doc_id, n_shingles, component_id of each row of ``docs``."""
    marked = store(signatures(docs, doc_id, text), "sizes")
    total = _tokens(marked)
    rows = marked.where("tokens is null").select("doc_id", F.col("node").alias("fp"), F.col("n").alias("n_shingles"))
    with_words = rows.where("fp is not null")
    _, label = simhash.named(with_words, lambda nodes: edges(docs, doc_id, text, marked, total))
    linked_rows = simhash.spread(label, with_words, "fp", "doc_id").select("doc_id", "n_shingles", "component_id")
    return linked_rows.unionByName(rows.where("fp is null").select("doc_id", "n_shingles", F.col("doc_id").alias("component_id")))

