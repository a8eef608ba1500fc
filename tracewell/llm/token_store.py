"""Token ids in binary files with bit-plane shuffling.

File format (little endian), one file holding whole documents in ascending doc_id order:

    magic ``TWPLANE1``, u32 length of the header, header (JSON: id width in bits, plane mode, ids a chunk)
    chunks: every plane of a block of ids, each a zstandard frame
    tables: zstandard frames of the doc_ids (i64), null flags (u8) and id counts (u32) of the documents
    chunk index: for each chunk u64 offset, u32 ids, and u32 length of each plane; then of the three tables
    footer: u64 offset of the index, u32 chunks, u64 documents, magic

In mode ``bit`` plane k holds bit k of every id of the block, in mode ``byte`` byte k. A chunk is read by its index
entry without the others.

``write`` sorts documents by range partitions of doc_id, so that files in order of (part, number) hold ascending
ids; each task writes files under names of its own attempt in the shared folder and only files of tasks that
succeeded reach the file index, a table beside them, so lost executors leave no wrong files. ``read_documents``
takes the starts of files from sums over parts, then over the files of a part.

Defined results: null text counts as empty (only the end id); null doc_ids come first and keep a null id; rows with
equal doc_ids are ordered by a hash of their text and may stand in several parts; an empty table gives no files; a very
long text is encoded whole by one task and gets a file of its own; other columns are not read, whatever their names.
"""

from __future__ import annotations

import json
import os
import re
import struct
import unicodedata
import uuid
import zlib
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
import regex
import zstandard
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .common import pieces, shared_folder, store, sub_batches, total_bytes

MAGIC = b"TWPLANE1"
CHUNK_IDS = 1 << 16
#: Ids that a file holds before the next one begins; a longer document gets a file of its own.
FILE_IDS = 4 << 20
#: Text of a range partition, which one task encodes.
PART_BYTES = 16 << 20


# ---- planes ----


def to_planes(ids: np.ndarray, bits: int, mode: str) -> list[bytes]:
    if mode == "byte":
        raw = ids.astype("<u4").view(np.uint8).reshape(-1, 4)
        return [np.ascontiguousarray(raw[:, k]).tobytes() for k in range((bits + 7) // 8)]
    ids = ids.astype(np.uint32)
    return [np.packbits((ids >> np.uint32(k)).astype(np.uint8) & 1).tobytes() for k in range(bits)]


def from_planes(planes: list[bytes], n: int, mode: str) -> np.ndarray:
    out = np.zeros(n, dtype=np.uint32)
    for k, plane in enumerate(planes):
        raw = np.frombuffer(plane, dtype=np.uint8)
        out |= raw.astype(np.uint32) << np.uint32(8 * k) if mode == "byte" else np.unpackbits(raw, count=n).astype(np.uint32) << np.uint32(k)
    return out


# ---- files ----


def _open(uri: str, mode: str):
    """A file of the shared folder: a plain path or file:// by the operating system, else by the store's client."""
    path = re.sub(r"^file:(//)?(?=/)", "", uri)
    if "://" not in path:
        if mode == "wb":
            os.makedirs(os.path.dirname(path), exist_ok=True)
        return open(path, mode)
    from pyarrow import fs

    system, path = fs.FileSystem.from_uri(uri)
    if mode == "wb":
        system.create_dir(path.rpartition("/")[0], recursive=True)
    return system.open_output_stream(path) if mode == "wb" else system.open_input_file(path)


class PlaneWriter:
    """Writes one file; documents are given in order."""

    def __init__(self, out, bits: int, mode: str = "bit", level: int = 1):
        self.out, self.bits, self.mode, self.pack = out, bits, mode, zstandard.ZstdCompressor(level=level)
        header = json.dumps({"bits": bits, "mode": mode, "chunk_ids": CHUNK_IDS}).encode()
        self.at = out.write(MAGIC + struct.pack("<I", len(header)) + header)
        self.at = len(MAGIC) + 4 + len(header)
        self.waiting: list[np.ndarray] = []
        self.n_waiting = self.n_ids = 0
        self.index: list[tuple[int, int, list[int]]] = []
        self.docs: list[int | None] = []
        self.counts: list[int] = []

    def add(self, doc_id: int | None, ids: np.ndarray) -> None:
        self.docs.append(doc_id)
        self.counts.append(len(ids))
        self.waiting.append(ids)
        self.n_waiting += len(ids)
        self.n_ids += len(ids)
        if self.n_waiting >= CHUNK_IDS:
            self._flush(False)

    def _flush(self, last: bool) -> None:
        ids = np.concatenate(self.waiting) if self.waiting else np.zeros(0, np.uint32)
        whole = len(ids) if last else len(ids) // CHUNK_IDS * CHUNK_IDS
        for a in range(0, whole, CHUNK_IDS):
            block = ids[a : min(a + CHUNK_IDS, whole)]
            self._put(len(block), [self.pack.compress(p) for p in to_planes(block, self.bits, self.mode)])
        self.waiting, self.n_waiting = [ids[whole:]], len(ids) - whole

    def _put(self, n: int, frames: list[bytes]) -> None:
        self.index.append((self.at, n, [len(f) for f in frames]))
        self.out.write(b"".join(frames))
        self.at += sum(map(len, frames))

    def close(self) -> None:
        self._flush(True)
        chunks = len(self.index)
        null = np.array([d is None for d in self.docs], dtype=np.uint8)
        ids = np.array([0 if d is None else d for d in self.docs], dtype="<i8")
        self._put(len(self.docs), [self.pack.compress(x.tobytes()) for x in (ids, null, np.array(self.counts, dtype="<u4"))])
        table = b"".join(struct.pack(f"<QI{len(sizes)}I", at, n, *sizes) for at, n, sizes in self.index)
        self.out.write(table + struct.pack("<QIQ", self.at, chunks, len(self.docs)) + MAGIC)
        self.out.close()


class PlaneReader:
    """Reads one file; ``chunk(k)`` reads a single chunk."""

    def __init__(self, data: bytes):
        self.data = data
        if data[:8] != MAGIC or data[-8:] != MAGIC:
            raise ValueError("not a token file, or cut off")
        size = struct.unpack_from("<I", data, 8)[0]
        spec = json.loads(data[12 : 12 + size])
        self.mode, bits = spec["mode"], spec["bits"]
        at, self.n_chunks, self.n_docs = struct.unpack_from("<QIQ", data, len(data) - 28)
        planes = bits if self.mode == "bit" else (bits + 7) // 8
        row = struct.Struct(f"<QI{planes}I")
        self.index = [row.unpack_from(data, at + k * row.size) for k in range(self.n_chunks)]
        self.tables = struct.unpack_from("<QI3I", data, at + self.n_chunks * row.size)
        self.unpack = zstandard.ZstdDecompressor()

    def _frames(self, at: int, sizes: tuple[int, ...]) -> list[bytes]:
        out = []
        for size in sizes:
            out.append(self.unpack.decompress(self.data[at : at + size]))
            at += size
        return out

    def chunk(self, k: int) -> np.ndarray:
        at, n, *sizes = self.index[k]
        return from_planes(self._frames(at, tuple(sizes)), n, self.mode)

    def documents(self) -> tuple[list[int | None], np.ndarray]:
        ids, null, counts = self._frames(self.tables[0], self.tables[2:])
        return [None if z else int(i) for i, z in zip(np.frombuffer(ids, "<i8"), null, strict=True)], np.frombuffer(counts, "<u4").astype(np.int64)

    def ids(self) -> np.ndarray:
        return np.concatenate([np.zeros(0, np.uint32), *(self.chunk(k) for k in range(self.n_chunks))])


# ---- encoding ----


class WordEncoder:
    """Whole texts by the tokenizers library, with what stands between white space encoded once.

    The tokenizer drops white space before merging, so a text's ids are those of its parts. Parts of ASCII and
    Latin letters are cut by the tokenizer's own pattern and only new pieces reach its model; any other part goes
    through the whole tokenizer. A tokenizer with other settings encodes whole texts by itself.
    """

    #: Fixed value: the tokenizer's pattern for pieces.
    PATTERN = r"'s|'t|'re|'ve|'m|'ll|'d|[\p{L}]+|[\p{N}]|[^\s\p{L}\p{N}]+"
    #: The settings under which a text's ids are those of its parts.
    NORMALIZER = {"type": "Sequence", "normalizers": [{"type": "NFC"}, {"type": "Replace", "pattern": {"Regex": r"\s+"}, "content": " "}, {"type": "Lowercase"}]}
    PRE_TOKENIZER = {"type": "Sequence", "pretokenizers": [{"type": "Split", "pattern": {"Regex": PATTERN}, "behavior": "Removed", "invert": True}, {"type": "ByteLevel", "add_prefix_space": False, "trim_offsets": True, "use_regex": False}]}

    def __init__(self, path: str, bound: int = 300_000):
        from tokenizers import Tokenizer

        from .bpe import byte_alphabet

        self.tokenizer = Tokenizer.from_file(path)
        self.tokenizer.no_truncation()
        self.tokenizer.no_padding()
        self.model = self.tokenizer.model
        self.bits = (self.tokenizer.get_vocab_size() - 1).bit_length()
        self.dtype = np.dtype("<u2" if self.bits <= 16 else "<u4")
        self.plain = re.compile(r"[!-~À-ɏ]+")
        self.special = [t.content for t in self.tokenizer.get_added_tokens_decoder().values()]
        self.cut = regex.compile(self.PATTERN)
        self.table = {b: c for b, c in enumerate(byte_alphabet())}
        with open(path, encoding="utf-8") as f:
            spec = json.load(f)
        self.whole = (spec["normalizer"], spec["pre_tokenizer"], spec.get("post_processor")) != (self.NORMALIZER, self.PRE_TOKENIZER, None)
        self.bound = bound
        self.parts: dict[bytes, bytes] = {}
        self.old_parts = self.parts
        self.pieces: dict[str, bytes] = {}
        self.old_pieces = self.pieces

    def _piece(self, piece: str) -> bytes:
        got = self.pieces.get(piece)
        if got is None:
            got = self.old_pieces.get(piece)
            if got is None:
                got = np.array([t.id for t in self.model.tokenize(piece.encode().decode("latin-1").translate(self.table))], dtype=self.dtype).tobytes()
            self.pieces[piece] = got
        return got

    def _part(self, part: bytes) -> bytes:
        text = part.decode()
        if not self.plain.fullmatch(text) or any(t in text for t in self.special) or not text.isascii() and not unicodedata.is_normalized("NFC", text):
            return np.array(self.tokenizer.encode(text, add_special_tokens=False).ids, dtype=self.dtype).tobytes()
        text = "".join([c.lower() for c in text]) if not text.isascii() else text.lower()
        if text.isalpha():
            return self._piece(text)
        return b"".join([self._piece(p) for p in self.cut.findall(text)])

    def encode(self, texts: list[bytes]) -> list[np.ndarray]:
        if self.whole:
            return [np.array(self.tokenizer.encode(t.decode(), add_special_tokens=False).ids, dtype=self.dtype) for t in texts]
        if len(self.parts) > self.bound:
            self.old_parts, self.parts = self.parts, {}
        if len(self.pieces) > self.bound:
            self.old_pieces, self.pieces = self.pieces, {}
        split = [t.split() for t in texts]
        known, old = self.parts, self.old_parts
        for p in set().union(*split).difference(known):
            known[p] = old[p] if p in old else self._part(p)
        return [np.frombuffer(b"".join(map(known.__getitem__, s)), dtype=self.dtype) for s in split]


@lru_cache(maxsize=2)
def word_encoder(path: str) -> WordEncoder:
    return WordEncoder(path)


# ---- tables ----

INDEX_SCHEMA = "part int, number int, path string, n_docs long, n_ids long"


def write(docs: DataFrame, folder: str, tokenizer: str, doc_id: str = "doc_id", text: str = "text", end_id: int = 1, mode: str = "bit") -> DataFrame:
    """Encode ``docs`` and write token files into ``folder``; returns the file index, which stands in the shared folder too."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encoder = word_encoder(tokenizer)
        bits = max(encoder.bits, int(end_id).bit_length())
        end = np.array([end_id], dtype=encoder.dtype)
        part, attempt = TaskContext.get().partitionId(), uuid.uuid4().hex[:12]
        done: list[tuple] = []
        writer, path = None, ""

        def close() -> None:
            writer.close()
            done.append((part, len(done), path, len(writer.docs), writer.n_ids))

        for batch in batches:
            for some in sub_batches(batch, "text"):
                ids = encoder.encode([x or b"" for x in some.column(1).cast(pa.binary()).to_pylist()])
                for key, own in zip(some.column(0).to_pylist(), ids, strict=True):
                    if writer and writer.n_ids + len(own) > FILE_IDS:
                        close()
                        writer = None
                    if not writer:
                        path = f"{folder}/part-{part:06d}-{len(done):05d}-{attempt}.ids"
                        writer = PlaneWriter(_open(path, "wb"), bits, mode)
                    writer.add(key, np.concatenate([own, end]))
        if writer:
            close()
        columns = list(zip(*done, strict=True)) if done else [[]] * 5
        yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(columns, (pa.int32(), pa.int32(), pa.string(), pa.int64(), pa.int64()), strict=True)], names=["part", "number", "path", "n_docs", "n_ids"])

    rows = docs.select(F.col(doc_id).cast("long").alias("doc_id"), F.col(text).alias("text"))
    order = [F.col("doc_id").asc_nulls_first(), F.xxhash64("text")]
    ordered = rows.repartitionByRange(pieces(total_bytes(rows, "text"), PART_BYTES), *order).sortWithinPartitions(*order)
    return store(ordered.mapInArrow(run, INDEX_SCHEMA), "token-index")


def read_documents(index: DataFrame) -> DataFrame:
    """doc_id, start, n_tokens, ids_crc32 of every document of the files that ``index`` names."""
    parts = index.groupBy("part").agg(F.sum("n_ids").alias("ids"))
    before = parts.select("part", (F.sum("ids").over(Window.orderBy("part")) - F.col("ids")).alias("part_start"))
    files = index.join(before, "part").withColumn("start", F.col("part_start") + F.sum("n_ids").over(Window.partitionBy("part").orderBy("number")) - F.col("n_ids"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for path, start in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
                with _open(path, "rb") as f:
                    reader = PlaneReader(f.read())
                docs, counts = reader.documents()
                ends = np.cumsum(counts)
                raw = memoryview(reader.ids().astype("<u4").tobytes())
                sums = [zlib.crc32(raw[4 * (b - n) : 4 * b]) for b, n in zip(ends.tolist(), counts.tolist(), strict=True)]
                yield pa.RecordBatch.from_arrays([pa.array(docs, pa.int64()), pa.array(start + ends - counts, pa.int64()), pa.array(counts, pa.int64()), pa.array(sums, pa.int64())], names=["doc_id", "start", "n_tokens", "ids_crc32"])

    return files.select("path", "start").repartition(int(index.sparkSession.conf.get("spark.sql.shuffle.partitions")), "path").mapInArrow(run, "doc_id long, start long, n_tokens long, ids_crc32 long")


def round_trip(spark: SparkSession, docs: DataFrame, tokenizer: str) -> DataFrame:
    """Write ``docs`` as token files in the shared folder and return what is read back from them."""
    return read_documents(write(docs, shared_folder(spark, "tokens"), tokenizer))
