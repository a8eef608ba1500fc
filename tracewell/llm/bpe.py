"""Byte-level BPE encoding and decoding in batched numpy merge rounds.

The distinct pieces of a kernel batch lie as one flat array of symbols. Each round looks up every adjacent pair by
binary search over sorted pair keys, takes the lowest rank of each piece, and merges all its occurrences at once
(left to right where they overlap); pieces without a mergeable pair leave the array. Encoded pieces are remembered
up to a bound. The vocabulary file's path is a parameter; special tokens in a text become their single id. A file whose
settings are other than those of plain byte-level BPE is refused.

Defined results: a null text counts as empty (no ids, empty decoded text); rows are independent of each other, repeated
ones stay; of equal pairs that overlap the left one merges; an empty table gives no rows; a very long text is encoded
whole by one task; other columns are not read, but for ``token_rows``, which keeps them and replaces those named
``token_ids`` or ``n_tokens``.
"""

from __future__ import annotations

import hashlib
import json
import re
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import DataFrame

from .common import sub_batches

#: Fixed value: how byte-level BPE splits text before merging.
PATTERN = r"""'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"""


def byte_alphabet() -> list[str]:
    """The printable stand-in of each byte: itself if visible in Latin-1, else the next code point from 256 on."""
    shown = {*range(33, 127), *range(161, 173), *range(174, 256)}
    extra = iter(range(256, 512))
    return [chr(b) if b in shown else chr(next(extra)) for b in range(256)]


def check(spec: dict) -> None:
    """Refuse a tokenizer that does more, or less, than byte-level BPE with ``PATTERN``."""
    model, cut = spec["model"], spec.get("pre_tokenizer") or {}
    plain = cut.get("type") == "ByteLevel" and not cut.get("add_prefix_space") and cut.get("use_regex", True)
    other = [k for k in ("dropout", "unk_token", "continuing_subword_prefix", "end_of_word_suffix", "byte_fallback", "ignore_merges") if model.get(k)]
    odd = [t["content"] for t in spec.get("added_tokens", []) if any(t.get(k) for k in ("single_word", "lstrip", "rstrip", "normalized"))]
    if model.get("type", "BPE") != "BPE" or spec.get("normalizer") or not plain or other or odd:
        raise ValueError(f"not a plain byte-level BPE file: {cut.get('type')}, {other}, {odd}")


class ByteBpe:
    """A byte-level BPE vocabulary as arrays."""

    def __init__(self, path: str, bound: int = 150_000):
        with open(path, encoding="utf-8") as f:
            spec = json.load(f)
        check(spec)
        vocab, merges = spec["model"]["vocab"], spec["model"]["merges"]
        merges = [tuple(m.split(" ")) if isinstance(m, str) else tuple(m) for m in merges]
        alphabet = byte_alphabet()
        back = {c: b for b, c in enumerate(alphabet)}
        self.special = {t["content"]: t["id"] for t in spec.get("added_tokens", [])}
        self.size = max([*vocab.values(), *self.special.values()]) + 1
        self.first = np.array([vocab[c] for c in alphabet], dtype=np.int64)
        keys = np.array([vocab[a] * self.size + vocab[b] for a, b in merges], dtype=np.int64)
        order = np.argsort(keys)
        self.keys, self.rank, self.merged = keys[order], order.astype(np.int64), np.array([vocab[a + b] for a, b in merges], dtype=np.int64)
        token = {i: bytes(back[c] for c in t) for t, i in vocab.items()} | {i: t.encode() for t, i in self.special.items()}
        self.bytes = [token.get(i, b"") for i in range(self.size)]
        self.flat = np.frombuffer(b"".join(self.bytes), dtype=np.uint8)
        self.length = np.array([len(x) for x in self.bytes], dtype=np.int64)
        self.start = np.cumsum(self.length) - self.length
        self.cut = regex.compile("(" + "|".join(map(regex.escape, sorted(self.special, key=len, reverse=True))) + ")") if self.special else None
        self.words = regex.compile(PATTERN)
        self.odd = re.compile(r"[^\S \n]")
        self.dtype = np.dtype("<u2" if self.size <= 1 << 16 else "<u4")
        self.bound = bound
        # Two generations each: what is used again moves to the young one, the rest goes with the old one.
        self.known: dict[str, bytes] = {}  # piece -> packed ids
        self.chunks: dict[str, bytes] = {}  # what stands between spaces -> packed ids, the space before it included
        self.old_known, self.old_chunks = self.known, self.chunks

    def pieces(self, text: str) -> list[str]:
        """The pieces of a text in order; a special token is a piece."""
        if self.cut is None or not any(t in text for t in self.special):
            return self.words.findall(text)
        out: list[str] = []
        for k, part in enumerate(self.cut.split(text)):
            out += [part] if k % 2 else self.words.findall(part)
        return out

    def parts(self, text: str) -> list[str] | None:
        """Text cut where a piece must begin: at every single space and newline. None if it has other or doubled
        white space or special tokens. A part after a space stands without it; one after a newline keeps it; the
        first gets two newlines, which no other part has."""
        if not text or "  " in text or "\n\n" in text or " \n" in text or "\n " in text or text[0] in " \n" or text[-1] in " \n" or self.odd.search(text) or any(t in text for t in self.special):
            return None
        return ("\n\n" + text.replace("\n", " \n")).split(" ")

    def of_part(self, part: str) -> list[str]:
        """The pieces of one of ``parts``."""
        if part.isalpha():
            return [" " + part]
        if part[0] == "\n":
            return self.words.findall(part[2:] if part[:2] == "\n\n" else part)
        if part[-1] in ".,;:!?" and part[:-1].isalpha():
            return [" " + part[:-1], part[-1]]
        return self.words.findall(" " + part)

    def learn(self, pieces: set[str]) -> None:
        """Encode the pieces that aren't known yet, all at once."""
        if len(self.known) > self.bound:
            self.old_known, self.known = self.known, {}
        missing = pieces.difference(self.known)
        self.known.update((p, self.old_known[p]) for p in missing if p in self.old_known)
        fresh = [p for p in missing if p not in self.old_known]
        for at in range(0, len(fresh), 50_000):
            part = fresh[at : at + 50_000]
            ids, ends = self.merge([p.encode() for p in part])
            packed, ends = ids.astype(self.dtype).tobytes(), (ends * self.dtype.itemsize).tolist()
            self.known.update(zip(part, [packed[a:b] for a, b in zip([0, *ends[:-1]], ends, strict=True)], strict=True))
        for t, i in self.special.items():
            self.known[t] = np.array([i], dtype=self.dtype).tobytes()

    def ranks(self, left: np.ndarray, right: np.ndarray) -> np.ndarray:
        """Rank of each pair by binary search, or the number of ranks where there is none."""
        key = left * self.size + right
        at = np.minimum(np.searchsorted(self.keys, key), self.keys.size - 1)
        return np.where(self.keys[at] == key, self.rank[at], self.rank.size)

    def merge(self, words: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
        """Token ids of all words in one array, and where each word's end; by merge rounds over all words together."""
        lengths = np.array([len(w) for w in words], dtype=np.int64)
        symbols = self.first[np.frombuffer(b"".join(words), dtype=np.uint8)]
        owner = np.repeat(np.arange(len(words)), lengths)
        none = self.rank.size
        done: list[tuple[np.ndarray, np.ndarray]] = [(owner[:0], symbols[:0])]
        rank = np.r_[np.where(owner[:-1] == owner[1:], self.ranks(symbols[:-1], symbols[1:]), none), none][: symbols.size]
        while symbols.size:
            starts = np.flatnonzero(np.r_[True, owner[1:] != owner[:-1]])
            least = np.minimum.reduceat(rank, starts)
            sizes = np.diff(np.r_[starts, symbols.size])
            over = least == none
            if over.any():  # these words are finished
                leave = np.repeat(over, sizes)
                done.append((owner[leave], symbols[leave]))
                symbols, owner, rank = symbols[~leave], owner[~leave], rank[~leave]
                least, sizes = least[~over], sizes[~over]
                if not symbols.size:
                    break
            hit = np.flatnonzero(rank == np.repeat(least, sizes))
            if hit.size > 1:  # of a run of overlapping pairs (aa in aaa), take every other one
                new_run = np.r_[True, np.diff(hit) != 1]
                at_run = np.arange(hit.size) - np.flatnonzero(new_run)[np.cumsum(new_run) - 1]
                hit = hit[at_run % 2 == 0]
            symbols[hit] = self.merged[rank[hit]]
            stay = np.ones(symbols.size, dtype=bool)
            stay[hit + 1] = False
            symbols, owner, rank = symbols[stay], owner[stay], rank[stay]
            # Only pairs beside a merged symbol have a new rank.
            now = hit - np.arange(hit.size)
            beside = np.zeros(symbols.size, dtype=bool)
            beside[now] = True
            beside[now[now > 0] - 1] = True
            touched = np.flatnonzero(beside)
            follow = np.minimum(touched + 1, symbols.size - 1)
            inside = (owner[touched] == owner[follow]) & (follow > touched)
            rank[touched] = np.where(inside, self.ranks(symbols[touched], symbols[follow]), none)
        owners, ids = np.concatenate([o for o, _ in done]), np.concatenate([s for _, s in done])
        return ids[np.argsort(owners, kind="stable")], np.cumsum(np.bincount(owners, minlength=len(words)))

    def encode(self, texts: list[str]) -> list[np.ndarray]:
        """The ids of each text."""
        cut = [self.parts(t) for t in texts]
        if len(self.chunks) > self.bound:
            self.old_chunks, self.chunks = self.chunks, {}
        missing = {p for c in cut if c is not None for p in c}.difference(self.chunks)
        self.chunks.update((p, self.old_chunks[p]) for p in missing if p in self.old_chunks)
        split = [(p, self.of_part(p)) for p in missing if p not in self.old_chunks]
        whole = [self.pieces(t) if c is None else [] for t, c in zip(texts, cut, strict=True)]
        self.learn({x for _, ps in split for x in ps} | {x for ps in whole for x in ps})
        piece, chunk = self.known.__getitem__, self.chunks
        chunk.update((p, b"".join(map(piece, ps))) for p, ps in split)
        return [np.frombuffer(b"".join(map(piece, w) if c is None else map(chunk.__getitem__, c)), dtype=self.dtype) for c, w in zip(cut, whole, strict=True)]

    def decode(self, ids: np.ndarray) -> bytes:
        """The text of ids in UTF-8, special tokens included; bytes that aren't UTF-8 become U+FFFD."""
        ids = np.asarray(ids, dtype=np.int64)
        size = self.length[ids]
        ends = np.cumsum(size)
        at = np.repeat(self.start[ids] - (ends - size), size) + np.arange(ends[-1] if ids.size else 0)
        raw = self.flat[at].tobytes()
        try:
            raw.decode()
        except UnicodeDecodeError:
            return raw.decode("utf-8", "replace").encode()
        return raw


@lru_cache(maxsize=2)
def vocabulary(path: str) -> ByteBpe:
    """Once in each worker process."""
    return ByteBpe(path)


def id_lists(ids: list[np.ndarray]) -> pa.Array:
    ends = np.cumsum([0, *(len(i) for i in ids)])
    return pa.ListArray.from_arrays(pa.array(ends, pa.int32()), pa.array(np.concatenate([np.zeros(0, np.int32), *ids]).astype(np.int32)))


def encode(docs: DataFrame, path: str, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """doc_id, ids (array of int), decoded (the text made from the ids again): one row for each row of ``docs``."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        bpe = vocabulary(path)
        for batch in batches:
            for part in sub_batches(batch, batch.schema.names[1]):
                ids = bpe.encode([t or "" for t in part.column(1).to_pylist()])
                yield pa.RecordBatch.from_arrays([part.column(0).cast(pa.int64()), id_lists(ids), pa.array([bpe.decode(i).decode() for i in ids], pa.string())], names=["doc_id", "ids", "decoded"])

    return docs.select(doc_id, text).mapInArrow(run, "doc_id long, ids array<int>, decoded string")


def digests(docs: DataFrame, path: str, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """The same work as ``encode``, returned as counts and digests of ids and decoded text, so that rows stay small."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        bpe = vocabulary(path)
        decimal = [b"%d" % i for i in range(bpe.size)]
        for batch in batches:
            for part in sub_batches(batch, batch.schema.names[1]):
                ids = bpe.encode([t or "" for t in part.column(1).to_pylist()])
                sums = [hashlib.sha256(b",".join([decimal[i] for i in x.tolist()])).hexdigest() for x in ids]
                texts = [hashlib.sha256(bpe.decode(x)).hexdigest() for x in ids]
                yield pa.RecordBatch.from_arrays([part.column(0).cast(pa.int64()), pa.array([len(x) for x in ids], pa.int64()), pa.array(sums, pa.string()), pa.array(texts, pa.string())], names=["doc_id", "n_tokens", "ids_sha256", "decoded_sha256"])

    return docs.select(doc_id, text).mapInArrow(run, "doc_id long, n_tokens long, ids_sha256 string, decoded_sha256 string")


def token_rows(docs: DataFrame, path: str, text: str = "text") -> DataFrame:
    """``docs`` with the text replaced by its ids: all other columns, ``token_ids`` (array of int) and ``n_tokens``."""
    names = docs.columns
    at = names.index(text)
    rest = [k for k in range(len(names)) if k != at and names[k] not in ("token_ids", "n_tokens")]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        bpe = vocabulary(path)
        for batch in batches:
            for part in sub_batches(batch, text):
                ids = bpe.encode([t or "" for t in part.column(at).to_pylist()])
                yield pa.RecordBatch.from_arrays([*(part.column(k) for k in rest), id_lists(ids), pa.array([len(i) for i in ids], pa.int64())], names=[*(names[k] for k in rest), "token_ids", "n_tokens"])

    fields = [f"`{names[k]}` {docs.schema[names[k]].dataType.simpleString()}" for k in rest]
    return docs.mapInArrow(run, ", ".join([*fields, "token_ids array<int>", "n_tokens long"]))
