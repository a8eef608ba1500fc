"""Benchmark decontamination by spaced-seed hashing.

Tokens are lower-cased words without ASCII punctuation. Fixed masks of span 8 keep five of eight token positions;
the hash of the kept ones is a seed. Seeds of the benchmark are kept sorted, training texts are hashed at every
position under every mask and joined to them. Each hit names a diagonal of (document, item); along it the matching
run is extended both ways, across substitutions, into maximal scoring segments. A document is contaminated by an item
if segments near each other cover at least ``MIN_MATCH`` matching tokens of it, four of five tokens compared being
equal; an item shorter than that needs four fifths of its tokens.

The benchmark is the small side: it is taken in blocks of at most about ``BLOCK_BYTES`` of text (its size is
measured first), each block shipped to all tasks for one pass over the documents, so its size is never unbounded.

Defined results: null or empty texts have no tokens and match nothing; an item of fewer than 8 tokens, which can't be
told from common speech, matches only a document that has just its tokens; items with equal tokens are compared once and
give a row each, repeated rows of documents too; null ids stay null; empty tables give no rows; a very long text is
compared whole by one task, its hits in slices; other columns are not read, whatever their names.
"""

from __future__ import annotations

from collections import defaultdict
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import WordHash, mix, pieces, sub_batches, total_bytes

#: Fixed masks, 1 for a position that counts. Any two of them ignore different positions.
MASKS = ("11010011", "10110101", "11001101", "11111000")
SPAN = 8
MIN_MATCH, IDENTITY, MISMATCH = 13, 0.8, 3
#: Item lengths within which matching segments must lie in the text to be added up.
STRETCH = 2
BLOCK_BYTES = 8 << 20
#: Hits of seeds that are expanded to (document, item, diagonal) at once.
HITS = 1 << 20
_PUNCT = bytes(c if c >= 128 or chr(c).isalnum() else 32 for c in range(256))


def tokens(text: str | None) -> list[bytes]:
    return (text or "").lower().encode().translate(_PUNCT).split()


def seeds(words: np.ndarray) -> list[np.ndarray]:
    """For each mask the seed at each position that has room for it."""
    m = max(0, len(words) - SPAN + 1)
    out = []
    for number, mask in enumerate(MASKS):
        h = np.full(m, number + 1, dtype=np.uint64)
        for k, c in enumerate(mask):
            if c == "1":
                h = h * np.uint64(0x9E3779B97F4A7C15) + words[k : k + m]
        out.append(mix(h))
    return out


@dataclass
class Benchmark:
    """One block of the benchmark: its distinct items' token hashes end to end, and their sorted seeds."""

    ids: list[list[int | None]]  # of the items that have the same tokens
    words: np.ndarray
    starts: np.ndarray
    lengths: np.ndarray
    seeds: np.ndarray
    places: np.ndarray  # where in ``words`` each seed stands
    bits: int
    bitmap: np.ndarray
    short: dict[tuple[bytes, ...], int]  # items of fewer than SPAN tokens

    @classmethod
    def of(cls, items: list[tuple[int | None, str | None]]) -> Benchmark:
        hashed = WordHash()
        same: dict[tuple[bytes, ...], list[int | None]] = {}
        for i, t in items:
            same.setdefault(tuple(tokens(t)), []).append(i)
        arrays = [hashed.array(list(t)) for t in same]
        lengths = np.array([len(a) for a in arrays], dtype=np.int64)
        starts = np.cumsum(lengths) - lengths
        found, places = [np.zeros(0, np.uint64)], [np.zeros(0, np.int64)]
        for start, words in zip(starts.tolist(), arrays, strict=True):
            for h in seeds(words):
                found.append(h)
                places.append(start + np.arange(len(h)))
        all_seeds, all_places = np.concatenate(found), np.concatenate(places)
        order = np.argsort(all_seeds, kind="stable")
        all_seeds = all_seeds[order]
        bits = min(27, max(16, int(max(1, all_seeds.size) - 1).bit_length() + 5))
        bitmap = np.zeros(1 << bits, dtype=bool)
        bitmap[(all_seeds >> np.uint64(64 - bits)).astype(np.int64)] = True
        short = {t: k for k, t in enumerate(same) if 0 < len(t) < SPAN}
        return cls(list(same.values()), np.concatenate([np.zeros(0, np.uint64), *arrays]), starts, lengths, all_seeds, all_places[order], bits, bitmap, short)

    def matches(self, texts: list[str | None], hashed: WordHash) -> list[tuple[int, int, int, int, int, int]]:
        """(text index, item index, matched tokens, tokens compared, first and last token in the text, exclusive)."""
        lists = [tokens(t) for t in texts]
        lengths = np.array([len(x) for x in lists], dtype=np.int64)
        words = hashed.array([w for x in lists for w in x])
        ends = np.cumsum(lengths)
        found: set[tuple[int, int, int]] = set()
        item_ends = self.starts + self.lengths
        for h in seeds(words) if self.seeds.size else []:
            maybe = np.flatnonzero(self.bitmap[(h >> np.uint64(64 - self.bits)).astype(np.int64)])
            lo, hi = np.searchsorted(self.seeds, h[maybe], "left"), np.searchsorted(self.seeds, h[maybe], "right")
            doc = np.searchsorted(ends, maybe, side="right")
            some = (hi > lo) & (maybe + SPAN <= ends[doc])  # a seed across two texts doesn't count
            maybe, lo, n, doc = maybe[some], lo[some], (hi - lo)[some], doc[some]
            cuts = np.searchsorted(np.cumsum(n), np.arange(0, int(n.sum()), HITS))
            for x, y in zip(cuts.tolist(), [*cuts[1:].tolist(), n.size], strict=False):
                y = max(x + 1, y)
                each = n[x:y]
                q = self.places[np.repeat(lo[x:y] - (np.cumsum(each) - each), each) + np.arange(int(each.sum()))]
                rows = np.stack([np.repeat(doc[x:y], each), np.searchsorted(item_ends, q, side="right"), np.repeat(maybe[x:y], each) - q], axis=1)
                found.update(map(tuple, np.unique(rows, axis=0).tolist()))
        segments: dict[tuple[int, int], list[tuple[int, int, int]]] = defaultdict(list)
        for d, i, diagonal in sorted(found):
            a, b = int(self.starts[i]), int(self.starts[i] + self.lengths[i])
            lo, hi = max(a, int(ends[d] - lengths[d]) - diagonal), min(b, int(ends[d]) - diagonal)
            same = words[lo + diagonal : hi + diagonal] == self.words[lo:hi]
            segments[d, i] += [(lo + x, lo + y, diagonal) for x, y in best_segments(same)]
        out = []
        for (d, i), parts in segments.items():
            if not (parts := self.near(parts, i, words)):
                continue
            matched, compared = self.counts(parts, words)
            if self.enough(matched, compared, i):
                base = int(ends[d] - lengths[d])
                out.append((d, i, matched, compared, min(a + x for a, _, x in parts) - base, max(b + x for _, b, x in parts) - base))
        for d, own in enumerate(lists if self.short else []):
            if len(own) < SPAN and (i := self.short.get(tuple(own))) is not None:
                out.append((d, i, len(own), len(own), 0, len(own)))
        return sorted(out)

    def counts(self, parts: list[tuple[int, int, int]], words: np.ndarray) -> tuple[int, int]:
        """Tokens of the item that match in one of the segments, and that are compared in one."""
        matched = {q for a, b, diagonal in parts for q in (np.flatnonzero(words[a + diagonal : b + diagonal] == self.words[a:b]) + a).tolist()}
        return len(matched), len({q for a, b, _ in parts for q in range(a, b)})

    def enough(self, matched: int, compared: int, i: int) -> bool:
        need = MIN_MATCH if self.lengths[i] >= MIN_MATCH else IDENTITY * self.lengths[i]
        return matched > 0 and matched >= need and matched >= IDENTITY * compared

    def near(self, parts: list[tuple[int, int, int]], i: int, words: np.ndarray) -> list[tuple[int, int, int]]:
        """The segments that are enough together with others that begin in a stretch of the text of ``STRETCH`` times the item's length."""
        parts = sorted(parts, key=lambda p: p[0] + p[2])
        kept: set[int] = set()
        to = 0
        for k, (a, _, diagonal) in enumerate(parts):
            to = max(to, k + 1)
            while to < len(parts) and parts[to][0] + parts[to][2] < a + diagonal + STRETCH * int(self.lengths[i]):
                to += 1
            if self.enough(*self.counts(parts[k:to], words), i):
                kept |= set(range(k, to))
        return [parts[k] for k in sorted(kept)]


def best_segments(same: np.ndarray) -> list[tuple[int, int]]:
    """Maximal segments that score at least 5, a match being worth 1 and a mismatch -3: each grows from its first match
    until its score falls below zero, is cut back to its best end, and the next is looked for from there."""
    hits = same.tolist()
    out, k, n = [], 0, len(hits)
    while k < n:
        if not hits[k]:
            k += 1
            continue
        start, score, best, end = k, 0, 0, k
        while k < n and score >= 0:
            score += 1 if hits[k] else -MISMATCH
            k += 1
            if score > best:
                best, end = score, k
        if best >= 5:
            out.append((start, end))
        k = end
    return out


def blocks(benchmark: DataFrame, item_id: str = "item_id", text: str = "text") -> Iterator[Benchmark]:
    """The benchmark in blocks of bounded size; each is fetched when its turn comes."""
    rows = benchmark.select(F.col(item_id).cast("long").alias("item_id"), F.col(text).alias("text"))
    n = pieces(total_bytes(rows, "text"), BLOCK_BYTES)
    for k in range(n):
        part = rows.where(F.pmod(F.xxhash64("item_id", "text"), F.lit(n)) == k) if n > 1 else rows
        yield Benchmark.of(sorted(((r.item_id, r.text) for r in part.collect()), key=lambda r: (r[0] is not None, r[0] or 0, r[1] or "")))


def find(docs: DataFrame, benchmark: DataFrame, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """A row for each contaminated document and item: doc_id, item_id, n_matched, n_compared, n_item, first_token, end_token."""
    out = None
    for block in blocks(benchmark):
        shipped = docs.sparkSession.sparkContext.broadcast(block)

        def run(batches: Iterator[pa.RecordBatch], shipped=shipped) -> Iterator[pa.RecordBatch]:
            block, hashed = shipped.value, WordHash()
            for batch in batches:
                for part in sub_batches(batch, batch.schema.names[1]):
                    keys = part.column(0).to_pylist()
                    rows = [(keys[d], own, m, n, int(block.lengths[i]), a, b) for d, i, m, n, a, b in block.matches(part.column(1).to_pylist(), hashed) for own in block.ids[i]]
                    columns = list(zip(*rows, strict=True)) if rows else [[]] * 7
                    yield pa.RecordBatch.from_arrays([pa.array(c, pa.int64()) for c in columns], names=COLUMNS)

        got = docs.select(doc_id, text).mapInArrow(run, ", ".join(f"{c} long" for c in COLUMNS))
        out = got if out is None else out.unionByName(got)
    return out


COLUMNS = ["doc_id", "item_id", "n_matched", "n_compared", "n_item", "first_token", "end_token"]


def keep_clean(docs: DataFrame, benchmark: DataFrame, text: str = "text") -> DataFrame:
    """The rows of ``docs``, all columns, that no benchmark item contaminates."""
    at = docs.columns.index(text)
    out = docs
    for block in blocks(benchmark):
        shipped = docs.sparkSession.sparkContext.broadcast(block)

        def run(batches: Iterator[pa.RecordBatch], shipped=shipped) -> Iterator[pa.RecordBatch]:
            hashed = WordHash()
            for batch in batches:
                for part in sub_batches(batch, text):
                    keep = np.ones(part.num_rows, dtype=bool)
                    keep[[d for d, *_ in shipped.value.matches(part.column(at).to_pylist(), hashed)]] = False
                    yield part.filter(pa.array(keep))

        out = out.mapInArrow(run, docs.schema)
    return out
