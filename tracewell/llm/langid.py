"""Language ID with a string kernel: blended-spectrum n-gram presence, Nystroem landmarks, kernel ridge regression.

The kernel of two texts is the mean over n = 1..3 of the cosine of their sets of character n-grams. A bounded
sample of labelled rows is fitted: ``PER_LANG`` for each language, chosen by a hash of the id, ``SAMPLE_ROWS`` in all
(first one of each language, then a second one, and so on), of which the first ``SAMPLE_CHARS`` characters are learned
from. ``LANDMARKS`` of them span the Nystroem space, one-versus-rest ridge regression on it gives one score for each language. All texts
are then scored whole, in blocks: presence matrix of the block times presence matrix of the landmarks, then times
the coefficients.

Defined results: ``und`` with score 0 for a null text or one without letters; ``score`` is the winning one-versus-
rest output moved from [-1, 1] to [0, 1]; ties go to the language first in order; without any labelled training row
every text is ``und``; rows with null doc_id are never trained on and not held out; repeated rows stay; an empty table
gives no rows; a very long text is scored whole, in spans; other columns are not read by ``identify`` and stay as they
are in ``keep_known``, whatever their names.

A text that is unlike every landmark has a score near 0.5, so a score alone can't reject it, and short texts in learned
languages score low as well. ``known`` therefore rejects a text if its score is low and too many of its 3-grams are
unseen. Both limits come from the training rows: a model of one half of them is asked about the other half.
"""

from __future__ import annotations

import math
import re
from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import ids_mod, sub_batches

#: Rows a language that the fit may use, landmarks in all, ridge.
PER_LANG, LANDMARKS, RIDGE = 150, 128, 1e-3
#: Bounds of the sample that is fetched: rows in all, characters of a row.
SAMPLE_ROWS, SAMPLE_CHARS = 6000, 20_000
#: Characters that get a code of their own; the rest share one, all that aren't letters share another.
ALPHABET = 62
ORDERS = (1, 2, 3)
MODULUS, HELD_OUT = 4, 2
#: Texts below this score are rejected by ``keep_known``.
REJECT = 0.3
#: Share of the training rows that may lie beyond each limit of ``known``; standard deviations for a text's length; unseen
#: 3-grams that any text may have (a licence line, a name).
TAIL, DEVIATIONS, FOREIGN = 0.01, 3, 0.05
#: Characters of a text that are coded at once.
SPAN = 1 << 20
#: Letters, and numerals that aren't digits.
LETTER = re.compile(r"[^\W\d_]")
#: Words with digits (numbers, keys) tell nothing about the language.
CODED = re.compile(r"\S*\d\S*")


def has_letter(text: str) -> bool:
    return any(m[0].isalpha() for m in LETTER.finditer(text))


@dataclass
class Model:
    langs: list[str]
    codes: np.ndarray  # code point -> character code
    columns: np.ndarray  # n-gram code -> column, or the last column for those no landmark has
    edges: list[int]  # first column of each order, and their end
    landmarks: np.ndarray  # column x landmark, cosine norms folded in
    coefficients: np.ndarray  # landmark x language
    low: float = 0.0  # scores below this are low
    unseen: float = 1.0  # share of 3-grams without a column that learned texts may have

    def presence(self, texts: list[str]) -> tuple[np.ndarray, np.ndarray]:
        """Presence of the landmarks' n-grams in each text, and the number of distinct n-grams of each order."""
        width = self.edges[-1]
        out = np.zeros((len(texts), width + 1), dtype=np.float32)
        norms = np.ones((len(texts), len(ORDERS)), dtype=np.float32)
        seen = np.zeros(self.columns.size, dtype=bool)
        for k, text in enumerate(texts):
            for grams in gram_codes(text, self.codes):
                seen[grams] = True
            found = np.flatnonzero(seen)
            seen[found] = False
            out[k, self.columns[found]] = 1
            norms[k] = np.maximum(1, np.diff(np.searchsorted(found, ORDER_EDGES)))
        return out[:, :width], norms

    def kernel(self, texts: list[str]) -> np.ndarray:
        found, norms = self.presence(texts)
        out = np.zeros((len(texts), self.landmarks.shape[1]), dtype=np.float32)
        for n, (a, b) in enumerate(zip(self.edges, self.edges[1:], strict=False)):
            out += (found[:, a:b] @ self.landmarks[a:b]) / np.sqrt(norms[:, n : n + 1])
        return out / len(ORDERS)

    def predict(self, texts: list[str | None]) -> tuple[list[str], list[float]]:
        some = [k for k, t in enumerate(texts) if t and has_letter(t)] if self.langs else []
        langs, scores = ["und"] * len(texts), [0.0] * len(texts)
        for at in range(0, len(some), 256):
            part = some[at : at + 256]
            values = self.kernel([texts[k] for k in part]) @ self.coefficients
            best = np.argmax(values, axis=1)
            top = np.clip((values[np.arange(len(part)), best].astype(float) + 1) / 2, 0, 1)
            for k, b, s in zip(part, best.tolist(), top.tolist(), strict=True):
                langs[k], scores[k] = self.langs[b], s
        return langs, scores

    def strange(self, text: str) -> tuple[int, int]:
        """3-grams (occurrences) of the text that no landmark has, and all of them."""
        if has_letter(plain := CODED.sub(" ", text)):
            text = plain
        none = n = 0
        for grams in list(gram_codes(" ".join(text.split()), self.codes))[len(ORDERS) - 1 :: len(ORDERS)]:
            none, n = none + int(np.count_nonzero(self.columns[grams] == self.edges[-1])), n + grams.size
        return none, n

    def known(self, texts: list[str | None], reject: float = REJECT) -> list[bool]:
        """Whether each text is in a learned language."""
        out = []
        for text, lang, score in zip(texts, *self.predict(texts), strict=True):
            ok = lang != "und" and score >= reject
            if ok and score < self.low:
                none, n = self.strange(text)
                ok = none <= self.unseen * n + DEVIATIONS * math.sqrt(n * self.unseen * (1 - self.unseen))
            out.append(ok)
        return out


WIDTH = ALPHABET + 2
#: Where the n-gram codes of each order begin.
ORDER_EDGES = np.cumsum([0, *(WIDTH**n for n in ORDERS)])


def gram_codes(text: str, codes: np.ndarray) -> Iterator[np.ndarray]:
    """n-gram codes of all orders of the lower-cased text, span by span; spans overlap so that no n-gram is lost."""
    points = np.frombuffer(text.lower().encode("utf-32-le", "replace"), dtype=np.uint32)
    for at in range(0, len(points), SPAN):
        c = codes[np.minimum(points[at : at + SPAN + max(ORDERS) - 1], codes.size - 1)]
        grams = c
        for n, start in zip(ORDERS, ORDER_EDGES.tolist(), strict=False):
            if n > 1:
                grams = grams[:-1] * WIDTH + c[n - 1 :]
            yield grams + start


def fit(rows: list[tuple[str, str]], landmarks: int = LANDMARKS, ridge: float = RIDGE) -> Model:
    """A model from (text, language) pairs."""
    rows = [(t, y) for t, y in rows if t and has_letter(t)]
    langs = sorted({y for _, y in rows})
    counts = Counter(c for t, _ in rows for c in t.lower() if c.isalpha() and ord(c) < 0x10000)
    codes = np.zeros(0x10001, dtype=np.int32)
    codes[[k for k in range(0x10000) if not 0xD800 <= k < 0xE000 and chr(k).isalpha()] + [0x10000]] = 1
    for k, (c, _) in enumerate(sorted(counts.items(), key=lambda x: (-x[1], x[0]))[:ALPHABET]):
        codes[ord(c)] = k + 2
    model = Model(langs, codes, np.zeros(0, np.int32), [0], np.zeros((0, 0), np.float32), np.zeros((0, len(langs)), np.float32))
    if not rows:
        return model
    by_lang = {y: [t for t, z in rows if z == y] for y in langs}
    each = max(1, landmarks // len(langs))
    chosen = [t for y in langs for t in by_lang[y][:each]]
    grams = [np.unique(np.concatenate(list(gram_codes(t, codes)))) for t in chosen]
    union = np.unique(np.concatenate(grams))
    model.edges = np.searchsorted(union, ORDER_EDGES).tolist()
    model.columns = np.full(int(ORDER_EDGES[-1]), union.size, dtype=np.int32)
    model.columns[union] = np.arange(union.size)
    matrix = np.zeros((union.size, len(chosen)), dtype=np.float32)
    for k, g in enumerate(grams):
        for a, b in zip(ORDER_EDGES, ORDER_EDGES[1:], strict=False):
            own = g[(g >= a) & (g < b)]
            matrix[model.columns[own], k] = 1 / np.sqrt(max(1, own.size))
    model.landmarks = matrix
    # Nystroem: phi = K(x, Z) W^-1/2; ridge regression on phi, folded back so that scores are K(x, Z) @ coefficients.
    w = model.kernel(chosen).astype(np.float64)
    values, vectors = np.linalg.eigh((w + w.T) / 2)
    values = np.maximum(values, 1e-6 * values.max())
    root = vectors / np.sqrt(values) @ vectors.T
    phi = np.concatenate([model.kernel([t for t, _ in rows[a : a + 256]]) for a in range(0, len(rows), 256)]) @ root
    target = np.array([[1.0 if y == z else -1.0 for z in langs] for _, y in rows])
    share = Counter(y for _, y in rows)
    weight = np.array([len(rows) / (len(langs) * share[y]) for _, y in rows])[:, None]
    beta = np.linalg.solve(phi.T @ (weight * phi) + ridge * len(rows) * np.eye(phi.shape[1]), phi.T @ (weight * target))
    model.coefficients = (root @ beta).astype(np.float32)
    return model


def with_limits(model: Model, rows: list[tuple[str, str]]) -> Model:
    """``model`` with the limits of ``known``, from every second row of each language as judged by a model of the others."""
    halves: tuple[list[tuple[str, str]], list[tuple[str, str]]] = ([], [])
    turn: Counter[str] = Counter()
    for t, y in rows:
        if t and has_letter(t):
            halves[turn[y] % 2].append((t, y))
            turn[y] += 1
    if not halves[1]:  # one row a language tells nothing about others
        return model
    half, texts = fit(halves[0]), [t for t, _ in halves[1]]
    strange = [half.strange(t) for t in texts]
    model.low = float(np.quantile(half.predict(texts)[1], TAIL))
    model.unseen = max(FOREIGN, float(np.quantile([none / n for none, n in strange if n] or [1.0], 1 - TAIL)))
    return model


def held_out(doc_id: Column) -> Column:
    return F.coalesce(F.crc32(doc_id.cast("string")) % MODULUS == HELD_OUT, F.lit(False))


def training_sample(docs: DataFrame, per_lang: int = PER_LANG, rows: int = SAMPLE_ROWS, doc_id: str = "doc_id", text: str = "text", lang: str = "lang") -> list[tuple[str, str]]:
    """(text, language) of at most ``per_lang`` training rows of each language and ``rows`` in all, the same ones on every run."""
    own = docs.select(F.col(doc_id).alias("doc_id"), F.col(lang).alias("lang"), F.col(text).alias("text"))
    usable = own.where(F.col("lang").isNotNull() & (F.col("lang") != "und") & (F.length("text") > 0) & (F.crc32(F.col("doc_id").cast("string")) % MODULUS != HELD_OUT))
    key = F.xxhash64(F.lit(17), "doc_id")
    # Ranked without their texts; each task keeps the first of each language before anything is shuffled.
    first = usable.select("lang", "doc_id", F.row_number().over(Window.partitionBy("lang").orderBy(key, "doc_id")).alias("k")).where(F.col("k") <= per_lang)
    first = first.groupBy("lang", "doc_id").agg(F.min("k").alias("k")).orderBy("k", "lang").limit(rows)
    # The chosen ids are few enough to broadcast; an id that many rows have gives no more rows than before.
    short = usable.select("lang", "doc_id", F.substring("text", 1, SAMPLE_CHARS).alias("text"))
    some = short.join(F.broadcast(first), ["lang", "doc_id"])
    ranked = some.select("lang", "text", F.row_number().over(Window.partitionBy("lang").orderBy("k", "text")).alias("r")).where(F.col("r") <= per_lang)
    return [(r.text, r.lang) for r in ranked.orderBy("r", "lang").limit(rows).collect()]


def train(docs: DataFrame, **names: str) -> Model:
    rows = training_sample(docs, **names)
    return with_limits(fit(rows), rows)


def identify(docs: DataFrame, model: Model, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """doc_id, held_out, lang_pred, score for each row of ``docs``; only the text is looked at."""
    shipped = docs.sparkSession.sparkContext.broadcast(model)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in sub_batches(batch, batch.schema.names[1]):
                langs, scores = shipped.value.predict(part.column(1).to_pylist())
                out = ids_mod(part.column(0).to_pylist(), MODULUS) == HELD_OUT
                yield pa.RecordBatch.from_arrays([part.column(0).cast(pa.int64()), pa.array(out), pa.array(langs, pa.string()), pa.array(scores, pa.float64())], names=["doc_id", "held_out", "lang_pred", "score"])

    return docs.select(doc_id, text).mapInArrow(run, "doc_id long, held_out boolean, lang_pred string, score double")


def keep_known(docs: DataFrame, model: Model, text: str = "text", reject: float = REJECT) -> DataFrame:
    """The rows of ``docs``, all columns, whose text is in a learned language: not ``und``, scored ``reject`` or more, and ``known``."""
    shipped = docs.sparkSession.sparkContext.broadcast(model)
    at = docs.columns.index(text)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in sub_batches(batch, text):
                yield part.filter(pa.array(shipped.value.known(part.column(at).to_pylist(), reject), pa.bool_()))

    return docs.mapInArrow(run, docs.schema)
