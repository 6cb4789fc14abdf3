"""Operator 8: token ids in files of bit- or byte-plane-shuffled, zstandard-compressed blocks.

A file holds the ids of whole documents in ascending order of doc_id. Its ids are cut into
blocks of fixed size; a block is transposed into byte planes (all lowest bytes, then all next
bytes, ...) or bit planes; each plane is compressed by itself. A chunk index at the end gives
the place of every plane and of the documents' ids and lengths (16 bytes a document, compressed),
so a reader can fetch any block.

    magic "SVT1" | planes ... | ids, lengths | index (zstandard of JSON) | length of the index (u32) | "SVT1"

Documents are dealt to files by ranges of doc_id, and files are named by range, so that files
in order of name hold the documents in ascending order. A task streams its documents into a
temporary file in the shared folder and moves it into place when it is whole: a lost executor's
task is simply run again.

Defined results: null or empty texts have the end id alone; null ids come first; rows of equal
ids are stored each, in no fixed order; an empty table gives an empty result; other columns are
ignored.
"""

from __future__ import annotations

import json
import re
import struct
import uuid
import zlib
from array import array
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.fs
import zstandard
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window
from tokenizers import Tokenizer

from .bpe import byte_alphabet, read_spec
from .common import bounded_batches, held, only, shared_dir, shuffle_width, spread

MAGIC = b"SVT1"
BLOCK = 1 << 18  # ids of a block


def to_planes(ids: np.ndarray, width: int, bits: bool) -> list[bytes]:
    """The byte planes, or the packed bit planes, of ids of ``width`` bytes."""
    octets = np.ascontiguousarray(ids.astype("<u8").view(np.uint8).reshape(-1, 8)[:, :width].T)
    if not bits:
        return [p.tobytes() for p in octets]
    return [np.packbits(octets[k // 8] >> (k % 8) & 1).tobytes() for k in range(8 * width)]


def from_planes(planes: list[bytes], n: int, width: int, bits: bool) -> np.ndarray:
    octets = np.zeros((n, 8), np.uint8)
    if bits:
        for k, p in enumerate(planes):
            octets[:, k // 8] |= np.unpackbits(np.frombuffer(p, np.uint8), count=n) << (k % 8)
    else:
        for k, p in enumerate(planes):
            octets[:, k] = np.frombuffer(p, np.uint8)
    return octets.reshape(-1).view("<u8")


class PlaneWriter:
    """Writes a file block by block; holds one block, and the ids and lengths of the file's documents."""

    def __init__(self, sink, width: int = 2, bits: bool = False, block: int = BLOCK, level: int = 3):
        self.sink, self.width, self.bits, self.block = sink, width, bits, block
        self.packer = zstandard.ZstdCompressor(level=level)
        self.at, self.blocks, self.waiting, self.held = len(MAGIC), [], [], 0
        self.ids, self.lengths, self.without = array("q"), array("q"), []
        sink.write(MAGIC)

    def add(self, doc_id: int | None, ids: np.ndarray) -> None:
        if doc_id is None:
            self.without.append(len(self.ids))
        self.ids.append(doc_id or 0)
        self.lengths.append(len(ids))
        self.waiting.append(ids)
        self.held += len(ids)
        if self.held >= self.block:
            whole = np.concatenate(self.waiting)
            while len(whole) >= self.block:
                self._write(whole[: self.block])
                whole = whole[self.block :]
            self.waiting, self.held = [whole], len(whole)

    def _write(self, ids: np.ndarray) -> None:
        if len(ids) and int(ids.max()) >> (8 * self.width):
            raise ValueError(f"an id needs more than {self.width} bytes")
        spans = []
        for plane in to_planes(ids, self.width, self.bits):
            packed = self.packer.compress(plane)
            self.sink.write(packed)
            spans.append((self.at, len(packed)))
            self.at += len(packed)
        self.blocks.append((len(ids), spans))

    def close(self) -> None:
        if self.held:
            self._write(np.concatenate(self.waiting))
        spans = []
        for column in (self.ids, self.lengths):
            packed = self.packer.compress(np.array(column, "<i8").tobytes())
            self.sink.write(packed)
            spans.append((self.at, len(packed)))
            self.at += len(packed)
        index = self.packer.compress(json.dumps({"width": self.width, "bits": self.bits, "blocks": self.blocks, "docs": spans, "without": self.without}).encode())
        self.sink.write(index)
        self.sink.write(struct.pack("<I", len(index)) + MAGIC)


class PlaneReader:
    """Reads the chunk index, then blocks or documents on demand."""

    def __init__(self, source):
        self.source = source
        end = source.size()
        length, magic = struct.unpack("<I4s", self._at(end - 8, 8))
        if magic != MAGIC:
            raise ValueError("no token file")
        self.unpacker = zstandard.ZstdDecompressor()
        index = json.loads(self.unpacker.decompress(self._at(end - 8 - length, length)))
        self.width, self.bits, self.blocks = index["width"], index["bits"], index["blocks"]
        self.ids, self.lengths = (np.frombuffer(self.unpacker.decompress(self._at(*s)), "<i8") for s in index["docs"])
        self.without = frozenset(index["without"])

    def _at(self, offset: int, length: int) -> bytes:
        self.source.seek(offset)
        return self.source.read(length)

    def block(self, k: int) -> np.ndarray:
        n, spans = self.blocks[k]
        return from_planes([self.unpacker.decompress(self._at(*s)) for s in spans], n, self.width, self.bits)

    def documents(self) -> Iterator[tuple[int | None, np.ndarray]]:
        """doc_id and ids of all documents in order; holds a block and a document."""
        k, left = 0, np.zeros(0, np.uint64)
        for i, (doc_id, n) in enumerate(zip(self.ids.tolist(), self.lengths.tolist(), strict=True)):
            parts = []
            while n > len(left):
                parts.append(left)
                n -= len(left)
                left, k = self.block(k), k + 1
            parts.append(left[:n])
            left = left[n:]
            yield None if i in self.without else doc_id, np.concatenate(parts)

    def document(self, k: int) -> np.ndarray:
        """Ids of the k-th document, from the blocks that hold it alone."""
        start, n, parts = int(self.lengths[:k].sum()), int(self.lengths[k]), []
        for b, (size, _) in enumerate(self.blocks):
            if start < size and n > 0:
                parts.append(self.block(b)[start : start + n])
                n -= len(parts[-1])
            start = max(0, start - size)
        return np.concatenate(parts) if parts else np.zeros(0, np.uint64)


class CachedEncoder(dict):
    """The tokenizers library's ids of whole texts.

    The library's splitting never joins what ASCII white space parts (its pattern has no token
    with white space in it), so texts are cut there and the ids of the recurring parts are kept.
    A part of Latin-1 letters, then marks (no apostrophe), is two words for the library's pattern;
    it goes to the library's BPE model word by word. Any other part goes through the whole library.
    """

    PLAIN = re.compile("([a-zß-öø-ÿ]*)([!-&(-/:-@\\[-`{-~]*)")

    def __init__(self, spec: str, kept: int = 400_000, kept_bytes: int = 24_000_000):
        super().__init__()
        self.library, self.kept, self.kept_bytes, self.held = Tokenizer.from_str(spec), kept, kept_bytes, 0
        self.library.no_padding()
        self.library.no_truncation()
        self.written = {b: c for c, b in byte_alphabet().items()}
        self.words: dict[str, bytes] = {}

    def _word(self, word: str) -> bytes:
        if (ids := self.words.get(word)) is None:
            as_bytes = word if word.isascii() else word.encode().decode("latin-1").translate(self.written)
            ids = array("I", [t.id for t in self.library.model.tokenize(as_bytes)]).tobytes()
            self.words[word] = ids
        return ids

    def __missing__(self, part: bytes) -> bytes:
        text = part.decode()
        if m := self.PLAIN.fullmatch(text.lower()):
            ids = b"".join([self._word(w) for w in m.groups() if w])
        else:
            ids = array("I", self.library.encode(text, add_special_tokens=False).ids).tobytes()
        self.held += len(part)
        self[part] = ids
        return ids

    def batch(self, texts: list[str]) -> list[np.ndarray]:
        if len(self) > self.kept or self.held > self.kept_bytes:
            self.clear()
            self.words.clear()
            self.held = 0
        return [np.frombuffer(b"".join([self[p] for p in t.encode().split()]), np.uint32) for t in texts]


def encoder(spec: str) -> CachedEncoder:
    kept = held("tokens")
    if (key := hash(spec)) not in kept:
        kept.clear()
        kept[key] = CachedEncoder(spec)
    return kept[key]


def write(docs: DataFrame, folder: str, vocabulary: str, end_id: int = 2, files: int | None = None, width: int = 2, bits: bool = False) -> DataFrame:
    """Encode and write all documents; returns the manifest: file, name, n_docs, n_tokens, start.

    ``files`` is the number of doc_id ranges: by default the session's shuffle width, more where a
    file would hold over 128 MB of the planned scan.
    """
    spark = docs.sparkSession
    spec = spark.sparkContext.broadcast(read_spec(vocabulary))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark import TaskContext

        part, tokens, docs_n, writer = TaskContext.get().partitionId(), 0, 0, None
        fs, root = pa.fs.FileSystem.from_uri(folder) if "://" in folder or folder.startswith("file:") else (pa.fs.LocalFileSystem(), folder)
        encode = encoder(spec.value)
        tail = np.array([end_id], np.uint32)
        draft, name = f"{root}/.{part:06d}-{uuid.uuid4().hex}", f"tokens-{part:06d}.svt"
        for b in batches:
            if writer is None and b.num_rows:
                fs.create_dir(root, recursive=True)
                sink = fs.open_output_stream(draft)
                writer = PlaneWriter(sink, width, bits)
            for doc_id, ids in zip(b.column(0).to_pylist(), encode.batch([t or "" for t in b.column(1).to_pylist()]), strict=True):
                writer.add(doc_id, np.concatenate([ids, tail]))
                tokens, docs_n = tokens + len(ids) + 1, docs_n + 1
        if writer:
            writer.close()
            sink.close()
            fs.move(draft, f"{root}/{name}")
            yield pa.RecordBatch.from_arrays([pa.array([part], pa.int32()), pa.array([name]), pa.array([docs_n], pa.int64()), pa.array([tokens], pa.int64())], names=["file", "name", "n_docs", "n_tokens"])

    bounded_batches(spark)
    files = files or spread(docs, 128 << 20, shuffle_width(spark))
    # texts that share an id may go to several files
    ranged = only(docs, "doc_id", "text").repartitionByRange(files, F.col("doc_id").asc_nulls_first(), F.xxhash64("text")).sortWithinPartitions(F.col("doc_id").asc_nulls_first())
    made = f"{folder}-manifest"
    ranged.mapInArrow(run, "file int, name string, n_docs long, n_tokens long").write.parquet(made)
    manifest = spark.read.parquet(made)  # a row a file
    return manifest.withColumn("start", F.coalesce(F.sum("n_tokens").over(Window.orderBy("file").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)))


def read(spark: SparkSession, folder: str, manifest: DataFrame, id_type: str = "bigint") -> DataFrame:
    """doc_id, start, n_tokens, ids_crc32 of each stored document, from the files."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        fs, root = pa.fs.FileSystem.from_uri(folder) if "://" in folder or folder.startswith("file:") else (pa.fs.LocalFileSystem(), folder)
        for b in batches:
            for name, start in zip(b.column(0).to_pylist(), b.column(1).to_pylist(), strict=True):
                with fs.open_input_file(f"{root}/{name}") as source:
                    rows = []
                    for doc_id, ids in PlaneReader(source).documents():
                        rows.append((doc_id, start, len(ids), zlib.crc32(ids.astype("<u4").tobytes())))
                        start += len(ids)
                        if len(rows) == 4096:
                            yield packed(rows)
                            rows = []
                    if rows:
                        yield packed(rows)

    def packed(rows: list[tuple]) -> pa.RecordBatch:
        return pa.RecordBatch.from_arrays([pa.array(c, pa.int64()) for c in zip(*rows, strict=True)], names=["doc_id", "start", "n_tokens", "ids_crc32"])

    names = manifest.select("name", "start")
    return names.repartition(max(1, min(names.count(), 4096)), "name").mapInArrow(run, "doc_id long, start long, n_tokens long, ids_crc32 long").withColumn("doc_id", F.col("doc_id").cast(id_type))


def write_and_read(docs: DataFrame, vocabulary: str, **how) -> DataFrame:
    folder = shared_dir(docs.sparkSession, "tokens")
    manifest = write(docs, folder, vocabulary, **how)
    return read(docs.sparkSession, folder, manifest, docs.schema["doc_id"].dataType.simpleString())
