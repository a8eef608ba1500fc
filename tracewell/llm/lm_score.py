"""Language-model scoring with a weighted backoff automaton.

Tokens are words with A-Z lower-cased, then one end token. The model is an n-gram model (``ORDER`` = 3) learned from
all training documents: p(w | h) = (c(hw) + K p(w | h')) / (c(h) + K) with a prior weight K for each order, down to the
base distribution p(w) = (c(w) + 1) / (N + V + 1), so it sums to one over the vocabulary and one unknown word. A text
begins in the history of one start token. As an automaton: every known history is a state; a known n-gram is an arc
of weight log10 p(w | h) to the state of the longest known history that it ends in; any other word leaves the state by
its failure arc, of weight log10(K / (c(h) + K)), to the state of the shorter history; the root has an arc for every
word. Texts are traversed once from left to right: many of them step side by side, each with its state, and add up the
weights of the arcs that they take. A long text steps in pieces; a piece finds its first state by walking the
``ORDER`` - 1 tokens before it, as a state depends on no more.

Counts cover all training documents, without cut-offs. They travel in packed blocks (see ``bundles``): each bundle
of documents sends its distinct n-grams with their training counts and gets the corpus counts of just these back,
which are the states and arcs of the automaton that its documents can visit.

Words and n-grams are keyed by 58 bits of a hash: at 10^13 n-grams one in 17,000 unseen ones is taken for a seen one, at
10^10 one in 17 million. Defined results: null text counts as empty (the end token alone); rows
with a null doc_id are scored but neither trained on nor held out; without training documents N = V = 0 and scores are
those of the base distribution; repeated rows count as often as they stand; an empty table gives no rows; a very long
text is held whole by one task; other columns are not read, whatever their names.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .bundles import Blocks, Bundles, joined
from .common import WordHash, ids_mod, mix

MODULUS, HELD_OUT = 7, 2
#: Longest n-grams; weight of the shorter history for n-grams of 2 words, and of 3 and more.
ORDER, K = 3, (50.0, 8.0)
#: Tokens of a long text that step as one piece.
PIECE = 512
#: Bits of a hash that keys have; the next lower bit tells n-grams (1) from single tokens (0), all others are zero.
KEPT, SPARE = np.uint64(0xFFFFFFFFFFFFFFC0), 5
LOW = np.uint64(1 << SPARE)
#: Keys of the end token and of the text's start.
END, START = np.uint64(0x5E2D58D8B3BCDEC0), np.uint64(0x1B03738712FAD580)


class Grams:
    """The tokens of a run of documents and their distinct n-grams, numbered within each order."""

    def __init__(self, texts: list[bytes], order: int):
        lists = [t.lower().split() for t in texts]  # bytes.lower() changes A-Z only
        self.counts = np.array([len(x) + 1 for x in lists], dtype=np.int64)
        ends = np.cumsum(self.counts + 1)
        self.starts = ends - self.counts - 1  # where each document's start token stands
        flat = np.empty(int(ends[-1]) if ends.size else 0, dtype=np.uint64)
        inside = np.ones(flat.size, dtype=bool)
        inside[self.starts] = inside[ends - 1] = False
        flat[inside] = WordHash().array([w for x in lists for w in x]) & KEPT
        flat[self.starts], flat[ends - 1] = START, END
        self.doc = np.repeat(np.arange(len(texts)), self.counts + 1)
        place = np.arange(flat.size) - self.starts[self.doc]
        token_keys, self.tokens = np.unique(flat, return_inverse=True)
        self.width = np.int64(max(1, token_keys.size))
        #: For each order: key, history * width + last token (sorted), number of the n-gram without its first token.
        self.keys, self.codes, self.shorter = [token_keys], [np.arange(token_keys.size)], [np.zeros(token_keys.size, np.int64)]
        #: For each order the number of the n-gram that ends at each place, -1 where the text has not that many before.
        self.at = [self.tokens]
        for m in range(1, order):
            valid = np.flatnonzero(place >= m)
            codes, number = np.unique(self.at[m - 1][valid - 1] * self.width + self.tokens[valid], return_inverse=True)
            at = np.full(flat.size, -1, dtype=np.int64)
            at[valid] = number
            shorter = np.zeros(codes.size, dtype=np.int64)
            shorter[number] = self.at[m - 1][valid]
            self.keys.append(mix(self.keys[m - 1][codes // self.width] * np.uint64(0x9E3779B97F4A7C15) + token_keys[codes % self.width] + np.uint64(m)) & KEPT | LOW)
            self.codes.append(codes)
            self.shorter.append(shorter)
            self.at.append(at)

    def training_counts(self, trained: np.ndarray) -> list[np.ndarray]:
        """How often documents marked in ``trained`` have each n-gram, by order."""
        weight = trained[self.doc].astype(np.float64)
        out = []
        for keys, at in zip(self.keys, self.at, strict=True):
            some = at >= 0
            out.append(np.bincount(at[some], weights=weight[some], minlength=keys.size).astype(np.uint64))
        return out

    def sorted_keys(self) -> tuple[np.ndarray, np.ndarray]:
        """All n-grams' keys in order, and the order."""
        keys = np.concatenate(self.keys)
        order = np.argsort(keys, kind="stable")
        return keys[order], order


def is_trained(ids: list[int | None]) -> np.ndarray:
    rest = ids_mod(ids, MODULUS)
    return (rest >= 0) & (rest != HELD_OUT)


def counts_of(order: int):
    def run(ids, texts, _got) -> tuple[np.ndarray, tuple[np.ndarray, ...]]:
        """The bundle's distinct n-grams and how often its training documents have them."""
        g = Grams(texts, order)
        keys, by = g.sorted_keys()
        return keys, (np.concatenate(g.training_counts(is_trained(ids)))[by],)

    return run


def _sums(blocks: Blocks) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """A shard's distinct keys, the sums of their counts, and for each key of its blocks which of them it is."""
    keys, at = np.unique(np.concatenate([b[0] for b in blocks]), return_inverse=True)
    return keys, np.bincount(at, weights=np.concatenate([b[1] for b in blocks]).astype(np.float64), minlength=keys.size).astype(np.uint64), at


def corpus_counts(blocks: Blocks) -> list[tuple[np.ndarray, ...]]:
    """For each block the corpus counts of its n-grams."""
    _, total, at = _sums(blocks)
    ends = np.cumsum([b[0].size for b in blocks])
    return [(x,) for x in np.split(total[at], ends[:-1])]


def vocabulary_share(blocks: Blocks) -> tuple[int, int]:
    """A shard's share of V and N."""
    keys, total, _ = _sums(blocks)
    tokens = (keys & LOW == 0) & (keys != START)
    return int(np.count_nonzero(total[tokens])), int(total[tokens].sum())


class Automaton:
    """The states and arcs that the documents of ``grams`` can visit.

    A state is a level (tokens of its history) and a number within it; the arcs that leave a level's states are the
    sorted codes of the n-grams one token longer."""

    def __init__(self, grams: Grams, counts: list[np.ndarray], vocabulary: int, total: int, k: tuple[float, ...]):
        self.grams = grams
        self.counts = [c.astype(np.float64) for c in counts]
        p = (self.counts[0] + 1) / float(total + vocabulary + 1)
        self.arc, self.fail = [np.log10(p)], [np.zeros(1)]
        for m in range(1, len(counts)):
            history = self.counts[m - 1][grams.codes[m] // grams.width]
            weight = k[min(m, len(k)) - 1]
            shorter = p[grams.shorter[m]]
            p = np.where(history > 0, (self.counts[m] + weight * shorter) / (history + weight), shorter)
            self.arc.append(np.log10(p))
            self.fail.append(np.log10(weight / (self.counts[m - 1] + weight)))

    def step(self, level: np.ndarray, state: np.ndarray, token: np.ndarray) -> np.ndarray:
        """Takes each walker's next token: the weights of the arcs taken. ``level`` and ``state`` are moved on."""
        g, top = self.grams, len(self.arc) - 1
        weight = np.zeros(token.size)
        taken = np.zeros(token.size, dtype=np.int64)  # tokens of the n-gram whose arc was taken
        number = np.empty(token.size, dtype=np.int64)
        for m in range(top, 0, -1):
            here = np.flatnonzero((level == m) & (taken == 0))
            if not here.size:
                continue
            code = state[here] * g.width + token[here]
            arc = np.minimum(np.searchsorted(g.codes[m], code), max(0, g.codes[m].size - 1))
            hit = (g.codes[m][arc] == code) & (self.counts[m][arc] > 0) if g.codes[m].size else np.zeros(here.size, bool)
            go, arc, fall = here[hit], arc[hit], here[~hit]
            weight[go] += self.arc[m][arc]
            taken[go], number[go] = m + 1, arc
            weight[fall] += self.fail[m][state[fall]]
            level[fall], state[fall] = m - 1, g.shorter[m - 1][state[fall]]
        root = np.flatnonzero(taken == 0)
        weight[root] += self.arc[0][token[root]]
        known = self.counts[0][token[root]] > 0
        level[root], state[root] = known, np.where(known, token[root], 0)
        for m in range(2, top + 2):
            went = np.flatnonzero(taken == m)
            level[went] = min(m, top)
            state[went] = number[went] if m <= top else g.shorter[m - 1][number[went]]
        return weight

    def traverse(self) -> tuple[np.ndarray, np.ndarray]:
        """Each document's sum of the base distribution's log10 probabilities, and of the arcs taken."""
        g, top = self.grams, len(self.arc) - 1
        n_pieces = -(-g.counts // PIECE)
        doc = np.repeat(np.arange(g.counts.size), n_pieces)
        first = (np.arange(doc.size) - (np.cumsum(n_pieces) - n_pieces)[doc]) * PIECE  # of the piece, after the start token
        length = np.minimum(PIECE, g.counts[doc] - first)
        order = np.argsort(-length, kind="stable")
        doc, first, length = doc[order], first[order], length[order]
        begin = g.starts[doc] + 1 + first
        # The history: the tokens before the piece, the start token among them, walked from the root without weight.
        before = np.minimum(top, first + 1)
        level, state = np.zeros(doc.size, np.int64), np.zeros(doc.size, np.int64)
        for back in range(top, 0, -1):
            walk = np.flatnonzero(before >= back)
            a, b = level[walk], state[walk]
            self.step(a, b, g.tokens[begin[walk] - back])
            level[walk], state[walk] = a, b
        base = np.zeros(g.counts.size)
        score = np.zeros(doc.size)
        for k in range(int(length[0]) if length.size else 0):
            n = int(np.searchsorted(-length, -k, side="left"))  # pieces of more than k tokens
            score[:n] += self.step(level[:n], state[:n], g.tokens[begin[:n] + k])
        root = self.arc[0][g.tokens]
        root[g.starts] = 0.0
        if root.size:
            base = np.add.reduceat(root, g.starts)
        return base, np.bincount(doc, weights=score, minlength=g.counts.size)


def scores(order: int, k: tuple[float, ...]):
    def run(ids, texts, got, sums) -> pa.Table:
        g = Grams(texts, order)
        keys, by = g.sorted_keys()
        counts = joined(got, 0)
        if counts.size != keys.size:
            raise RuntimeError("a bundle's n-grams changed between passes")
        unsorted = np.empty(keys.size, dtype=np.uint64)
        unsorted[by] = counts
        per_order = np.split(unsorted, np.cumsum([x.size for x in g.keys])[:-1])
        v, n = sums
        automaton = Automaton(g, per_order, v, n, k)
        base, score = automaton.traverse()
        seen = per_order[0][g.tokens] > 0
        seen[g.starts] = False
        known = np.add.reduceat(seen.astype(np.int64), g.starts) if seen.size else np.zeros(0, np.int64)
        held = ids_mod(ids, MODULUS) == HELD_OUT
        return pa.table(
            [pa.array(ids, pa.int64()), pa.array(held), pa.array(g.counts), pa.array(known), pa.array([n] * len(ids), pa.int64()), pa.array(base), pa.array(score.astype(np.float64))],
            names=["doc_id", "held_out", "n_tokens", "n_known", "train_tokens", "base_score", "score"],
        )

    return run


def score(docs: DataFrame, doc_id: str = "doc_id", text: str = "text", order: int = ORDER, k: tuple[float, ...] = K, bundle_bytes: int | None = None) -> DataFrame:
    """doc_id, held_out, n_tokens, n_known, train_tokens, base_score, score for each row of ``docs``."""
    bundles = Bundles(docs, doc_id, text, spare=SPARE, **({"bundle_bytes": bundle_bytes} if bundle_bytes else {}))
    asked = bundles.ask(counts_of(order))
    answers = bundles.answer(asked, corpus_counts).withColumn("totals", F.lit(None).cast("array<long>"))
    sums = bundles.totals(asked, vocabulary_share, 2).withColumn("answer", F.lit(None).cast("binary"))
    both = answers.unionByName(sums)
    return bundles.finish(scores(order, k), "doc_id long, held_out boolean, n_tokens long, n_known long, train_tokens long, base_score double, score double", both)
