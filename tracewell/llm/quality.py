"""Quality rules: base counts plus within-document repetition from a suffix array over words.

For each document a suffix array of its words is built by prefix doubling (all documents of a kernel batch in one
flat array; a suffix never leaves its document). The longest common prefix of neighbouring suffixes is read off the
stored doubling ranks; its intervals are the maximal repeated substrings. Spans of repeats of at least
``min_repeat`` words are united, and a document is kept if they cover at most ``max_covered`` of its words and the
longest repeat has at most ``max_longest`` words.

Defined results: a null or empty text has no words and fails the base rule (fewer than 20 words); each row is
judged alone, so repeated rows, ties and order change nothing; an empty table gives no rows; a very long text is judged
whole by one task (ranks take four bytes a word for each doubling that still tells suffixes apart); other columns are
not read, whatever their names.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame

from .common import sub_batches, text_bytes

#: Fixed values of the base rule.
SYMBOLS = b"#*$%&|<>"
WINDOW, MIN_WORDS, REPEAT_PERCENT = 8, 20, 30
SPACE = b" \t\n\r\x0b\x0c"


def repeats(docs: list[list[bytes]]) -> tuple[np.ndarray, np.ndarray]:
    """For each word position of the documents laid end to end: the length of the longest repeat that starts there
    (words, inside its document), and the document's index."""
    lengths = np.array([len(d) for d in docs], dtype=np.int64)
    total = int(lengths.sum())
    owner = np.repeat(np.arange(len(docs)), lengths)
    longest = np.zeros(total, dtype=np.int64)
    if not total:
        return longest, owner
    seen: dict[bytes, int] = {}
    words = np.fromiter((seen.setdefault(w, len(seen)) for d in docs for w in d), dtype=np.int64, count=total)
    left = np.repeat(np.cumsum(lengths), lengths) - np.arange(total)  # words from here to the end of the document
    _, rank = np.unique(owner * np.int64(len(seen)) + words, return_inverse=True)
    ranks = [rank.astype(np.int32)]
    active = _shared(ranks[0], np.arange(total))
    step = 1
    while active.size:
        # Refine only suffixes that still share a rank; the others keep theirs. A suffix that ends inside the next step sorts first.
        rank = ranks[-1]
        beyond = np.where(left[active] > step, rank[np.minimum(active + step, total - 1)] + 1, 0)
        order = np.lexsort((beyond, rank[active]))
        a, r, b = active[order], rank[active][order], beyond[order]
        new_group = np.r_[True, r[1:] != r[:-1]]
        new_rank = new_group | np.r_[True, b[1:] != b[:-1]]
        starts = np.flatnonzero(new_group)
        at = np.arange(a.size)
        first = starts[np.cumsum(new_group) - 1]
        head = np.maximum.accumulate(np.where(new_rank, at, 0))
        refined = rank.copy()
        # Dense ranks leave room: a group of m suffixes is numbered from its old rank scaled to positions.
        refined[a] = r + (head - first)
        if step == 1 and len(ranks) == 1:
            # First refinement: respread the ranks so that a group of m suffixes owns m consecutive numbers.
            base = np.r_[0, np.cumsum(np.bincount(rank))[:-1]]
            ranks[0] = base.astype(np.int32)[rank]
            refined = ranks[0].copy()
            refined[a] = base[r] + (head - first)
        ranks.append(refined)
        step *= 2
        active = _shared(refined, active)
        active = active[left[active] > 0]
        if not np.any(left[active] > step):
            active = active[:0]
    final = ranks[-1]
    shared_any = _shared(ranks[0], np.arange(total))
    order = shared_any[np.lexsort((shared_any, final[shared_any]))]
    lcp = _prefix(order[:-1], order[1:], ranks, left)
    np.maximum.at(longest, order[:-1], lcp)
    np.maximum.at(longest, order[1:], lcp)
    return longest, owner


def _shared(rank: np.ndarray, active: np.ndarray) -> np.ndarray:
    """The positions in ``active`` whose rank is not theirs alone."""
    values = rank[active]
    order = np.argsort(values, kind="stable")
    v = values[order]
    same = np.zeros(v.size, dtype=bool)
    eq = v[1:] == v[:-1]
    same[1:] |= eq
    same[:-1] |= eq
    return active[np.sort(order[same])]


def _prefix(i: np.ndarray, j: np.ndarray, ranks: list[np.ndarray], left: np.ndarray) -> np.ndarray:
    """Longest common prefix of suffixes i and j, by descending powers of two over the stored ranks."""
    n = left.size
    length = np.zeros(i.size, dtype=np.int64)
    room = np.minimum(left[i], left[j])
    for level in range(len(ranks) - 1, -1, -1):
        size = 1 << level
        a, b = i + length, j + length
        ok = (length + size <= room) & (ranks[level][np.minimum(a, n - 1)] == ranks[level][np.minimum(b, n - 1)])
        length += np.where(ok, size, 0)
    return length


def _covered(longest: np.ndarray, owner: np.ndarray, n_docs: int, least: int, whole: bool) -> np.ndarray:
    """Words of each document inside a repeat of at least ``least`` words (``whole``: all of it, else its first ``least``; the union is the same)."""
    starts = np.flatnonzero(longest >= least)
    edges = np.zeros(longest.size + 1, dtype=np.int64)
    np.add.at(edges, starts, 1)
    np.add.at(edges, starts + (longest[starts] if whole else least), -1)
    inside = np.cumsum(edges[:-1]) > 0
    return np.bincount(owner[inside], minlength=n_docs)


def judge(texts: list[bytes], min_repeat: int = 20, max_covered: float = 0.2, max_longest: int = 100) -> dict[str, list]:
    """The base counts and the suffix-array measures of each text."""
    docs = [t.split() for t in texts]
    longest, owner = repeats(docs)
    n = len(docs)
    n_words = np.array([len(d) for d in docs], dtype=np.int64)
    repeat_words = _covered(longest, owner, n, WINDOW, False)
    covered = _covered(longest, owner, n, min_repeat, True)
    top = np.zeros(n, dtype=np.int64)
    np.maximum.at(top, owner, longest)
    failed = (n_words < MIN_WORDS) | (100 * repeat_words > REPEAT_PERCENT * n_words)
    kept = ~failed & (covered <= max_covered * n_words) & (top <= max_longest)
    dup_lines = []
    for t in texts:
        lines = [x for x in t.split(b"\n") if x.strip(SPACE)]
        dup_lines.append(len(lines) - len(set(lines)))
    return {
        "n_words": n_words, "word_chars": [len(b"".join(d).decode()) for d in docs], "n_symbols": [len(t) - len(t.translate(None, SYMBOLS)) for t in texts],
        "n_dup_lines": dup_lines, "n_repeat_words": repeat_words, "base_failed": failed, "kept": kept, "covered_words": covered, "longest_repeat": top,
    }


COLUMNS = {"n_words": pa.int64(), "word_chars": pa.int64(), "n_symbols": pa.int64(), "n_dup_lines": pa.int64(), "n_repeat_words": pa.int64(), "base_failed": pa.bool_(), "kept": pa.bool_(), "covered_words": pa.int64(), "longest_repeat": pa.int64()}


def rules(docs: DataFrame, doc_id: str = "doc_id", text: str = "text", min_repeat: int = 20, max_covered: float = 0.2, max_longest: int = 100) -> DataFrame:
    """One row for each row of ``docs`` with its counts, measures and verdict."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in sub_batches(batch, batch.schema.names[1]):
                got = judge(text_bytes(part.column(1)), min_repeat, max_covered, max_longest)
                yield pa.RecordBatch.from_arrays([part.column(0).cast(pa.int64()), *(pa.array(got[k], t) for k, t in COLUMNS.items())], names=["doc_id", *COLUMNS])

    names = {pa.int64(): "long", pa.bool_(): "boolean"}
    return docs.select(doc_id, text).mapInArrow(run, "doc_id long, " + ", ".join(f"{k} {names[t]}" for k, t in COLUMNS.items()))
