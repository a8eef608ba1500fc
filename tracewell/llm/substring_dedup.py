"""Substring dedup by seed and extend on winnowed anchors.

A window is 13 consecutive words. Its anchor is the 5-word sequence with the smallest hash among the nine inside it, so
documents that share a window share its anchor at the same place. Pass one joins documents on anchors: which anchors
(the seeds) stand in two documents at least. Pass two extends from seeds only, up to eight words to either side: the
windows around them are joined, and each gets the smallest doc_id that has it. Pass three extends on along the text:
neighbouring windows that smaller documents have grow into one match as long as they follow each other, so matches
are maximal repeats, 13 words or more. Their words are removed. All exchange is in packed blocks (see ``bundles``), so
a passage that a third of all documents share costs each bundle one entry a window.

Windows are compared by 96 bits: a 64-bit key and 32 bits of a second hash. Words are compared by 64-bit hashes.

Defined results: null or empty text has no words and an empty ``kept``; windows are judged on the input; rows with equal
doc_ids never remove each other's words; a null doc_id counts as larger than all others and removes nothing from
others; documents of fewer than 13 words lose nothing; of several smaller documents the smallest names a match; an empty
table gives no rows; a very long text is held whole by one task; other columns are not read, whatever their names.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame

from .bundles import Blocks, Bundles, joined
from .common import WordHash, gram_hashes, mix

WINDOW, ANCHOR = 13, 5
#: Stands for a null doc_id; ids are moved by 2^63 to be unsigned.
NO_ID, ZERO, NONE = np.uint64(0xFFFFFFFFFFFFFFFF), np.uint64(1 << 63), np.zeros(0, np.uint64)
#: Odd multipliers of the second hash, one for each word of a window.
SECOND = mix(np.arange(1, WINDOW + 1, dtype=np.uint64)) | np.uint64(1)


def order_ids(ids: list[int | None]) -> np.ndarray:
    """doc_ids as unsigned numbers in the same order, null last."""
    return np.array([NO_ID if i is None else (i + (1 << 63)) for i in ids], dtype=np.uint64)


class Windows:
    """Windows of a run of documents: key, second hash, anchor and document of each, and where it starts."""

    def __init__(self, texts: list[bytes]):
        self.words = [t.split() for t in texts]
        lengths = np.array([len(w) for w in self.words], dtype=np.int64)
        flat = WordHash().array([w for ws in self.words for w in ws])
        m = max(0, len(flat) - WINDOW + 1)
        doc = np.repeat(np.arange(len(texts)), lengths)
        self.at = np.flatnonzero(doc[:m] == doc[WINDOW - 1 :][:m]) if m else np.zeros(0, np.int64)
        self.doc = doc[self.at]
        self.flat = flat
        if m:
            grams = gram_hashes(flat, ANCHOR)
            least = grams[:m].copy()
            for k in range(1, WINDOW - ANCHOR + 1):
                np.minimum(least, grams[k : k + m], out=least)
            self.anchor = least[self.at]
        else:
            self.anchor = NONE
        self.n_words = len(flat)
        self.doc_starts = np.cumsum(lengths) - lengths

    def hashes(self, some: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Key and second hash of the windows numbered ``some``."""
        at = self.at[some]
        key, second = np.full(at.size, WINDOW, dtype=np.uint64), np.zeros(at.size, dtype=np.uint64)
        for k in range(WINDOW):
            word = self.flat[at + k]
            key = mix(key * np.uint64(0x9E3779B97F4A7C15) + word)
            second += (word ^ (word >> np.uint64(29))) * SECOND[k]
        return key, mix(second) >> np.uint64(32)


def _groups(*keys: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """An order that sorts by the first key, then the next ones, and where each run of equal keys begins in it."""
    order = np.lexsort(keys[::-1]) if len(keys) > 1 else np.argsort(keys[0], kind="stable")
    new = np.zeros(max(0, order.size - 1), dtype=bool)
    for k in keys:
        k = k[order]
        new |= k[1:] != k[:-1]
    return order, np.flatnonzero(np.r_[True, new]) if order.size else order


def anchors_of(ids, texts, _got) -> tuple[np.ndarray, tuple[np.ndarray, ...]]:
    """The bundle's anchors, and whether two of its documents have them."""
    w = Windows(texts)
    owner = order_ids(ids)[w.doc]
    order, starts = _groups(w.anchor)
    if not starts.size:
        return NONE, (NONE,)
    owner = owner[order]
    return w.anchor[order][starts], ((np.minimum.reduceat(owner, starts) != np.maximum.reduceat(owner, starts)).astype(np.uint64),)


def shared_anchors(blocks: Blocks) -> list[tuple[np.ndarray, ...]]:
    """For each block: those of its anchors that two documents have, in it or in two blocks (steps between sorted keys)."""
    values, counts = np.unique(np.concatenate([b[0] for b in blocks]), return_counts=True)
    return [(np.diff(own[(counts[np.searchsorted(values, own)] > 1) | (twice > 0)], prepend=np.uint64(0)),) for own, twice in blocks]


def windows_of(ids, texts, got) -> tuple[np.ndarray, tuple[np.ndarray, ...]]:
    """The bundle's windows around shared anchors, with the second hash, the smallest doc_id of each and whether it has another."""
    w = Windows(texts)
    shared = np.concatenate([NONE, *(np.cumsum(steps, dtype=np.uint64) for steps, in got)])
    some = np.flatnonzero(_member(w.anchor, shared))
    key, second = w.hashes(some)
    order, starts = _groups(key, second)
    if not starts.size:
        return NONE, (NONE, NONE, NONE)
    owner = order_ids(ids)[w.doc[some]][order]
    low, high = np.minimum.reduceat(owner, starts), np.maximum.reduceat(owner, starts)
    return key[order][starts], (second[order][starts], low - ZERO, (low != high).astype(np.uint64))


def _member(values: np.ndarray, sorted_keys: np.ndarray) -> np.ndarray:
    if not sorted_keys.size:
        return np.zeros(values.size, dtype=bool)
    return sorted_keys[np.minimum(np.searchsorted(sorted_keys, values), sorted_keys.size - 1)] == values


def first_documents(blocks: Blocks) -> list[tuple[np.ndarray, ...]]:
    """For each block: its windows that some document of it must give up (steps between the sorted keys, second
    hashes), and the smallest doc_id that has them."""
    key, second, low = (np.concatenate([b[k] for b in blocks]) for k in range(3))
    order, starts = _groups(key, second)
    sizes = np.diff(np.r_[starts, order.size])
    least = np.empty(key.size, dtype=np.uint64)
    least[order] = np.repeat(np.minimum.reduceat((low + ZERO)[order], starts), sizes)
    out, at = [], 0
    for own, check, mine, twice in blocks:
        first = least[at : at + own.size]
        some = (first < mine + ZERO) | (twice > 0)
        out.append((np.diff(own[some], prepend=np.uint64(0)), check[some], first[some] - ZERO))
        at += own.size
    return out


def removal(ids, texts, got) -> pa.Table:
    """The bundle's rows of the result."""
    order, w = order_ids(ids), Windows(texts)
    keys = np.concatenate([NONE, *(np.cumsum(steps, dtype=np.uint64) for steps, *_ in got)])
    checks, first = joined(got, 1), joined(got, 2) + ZERO
    key, second = w.hashes(np.arange(w.at.size)) if keys.size else (NONE, NONE)
    least = np.full(w.at.size, NO_ID, dtype=np.uint64)
    ask = np.flatnonzero(_member(key, keys)) if keys.size else np.zeros(0, np.int64)
    at = np.searchsorted(keys, key[ask])
    while ask.size:  # equal keys with another second hash stand side by side
        hit = checks[at] == second[ask]
        least[ask[hit]] = first[at[hit]]
        ask, at = ask[~hit], at[~hit] + 1
        more = (at < keys.size) & (keys[np.minimum(at, keys.size - 1)] == key[ask])
        ask, at = ask[more], at[more]
    gone = least < order[w.doc]
    edges = np.zeros(w.n_words + 1, dtype=np.int64)
    np.add.at(edges, w.at[gone], 1)
    np.add.at(edges, w.at[gone] + WINDOW, -1)
    keep = np.cumsum(edges[:-1]) == 0
    # Matches: runs of windows that follow each other in one document.
    run = np.flatnonzero(gone)
    new = np.r_[True, (np.diff(run) != 1) | (np.diff(w.doc[run]) != 0)] if run.size else np.zeros(0, bool)
    begins, ends = run[new], np.r_[run[:-1][new[1:]], run[-1:]]
    matches: dict[int, list[dict]] = {}
    starts = w.doc_starts.tolist()
    for a, b, d, f in zip(w.at[begins].tolist(), w.at[ends].tolist(), w.doc[begins].tolist(), (least[begins] - ZERO).view(np.int64).tolist(), strict=True):
        matches.setdefault(d, []).append({"start": a - starts[d], "n_words": b + WINDOW - a, "first_doc": f})
    n_words, n_removed, kept = [], [], []
    for words, start in zip(w.words, starts, strict=True):
        mask = keep[start : start + len(words)]
        left = words if mask.all() else [x for x, k in zip(words, mask.tolist(), strict=True) if k]
        n_words.append(len(words))
        n_removed.append(len(words) - len(left))
        kept.append(b" ".join(left))
    spans = pa.array([matches.get(d, []) for d in range(len(ids))], pa.list_(pa.struct([("start", pa.int32()), ("n_words", pa.int32()), ("first_doc", pa.int64())])))
    return pa.table([pa.array(ids, pa.int64()), pa.array(n_words, pa.int64()), pa.array(n_removed, pa.int64()), pa.array(kept, pa.binary()).cast(pa.string()), spans], names=["doc_id", "n_words", "n_removed", "kept", "repeats"])


SCHEMA = "doc_id long, n_words long, n_removed long, kept string, repeats array<struct<start: int, n_words: int, first_doc: long>>"


def dedup(docs: DataFrame, doc_id: str = "doc_id", text: str = "text", bundle_bytes: int | None = None) -> DataFrame:
    """doc_id, n_words, n_removed, kept (the words left, joined by one space) and repeats (the matches that were
    removed: first word, words, smallest document of its first window) for each row of ``docs``."""
    bundles = Bundles(docs, doc_id, text, **({"bundle_bytes": bundle_bytes} if bundle_bytes else {}))
    anchors = bundles.answer(bundles.ask(anchors_of), shared_anchors)
    windows = bundles.answer(bundles.ask(windows_of, anchors), first_documents)
    return bundles.finish(removal, SCHEMA, windows)
