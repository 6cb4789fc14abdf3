"""Operator 7: benchmark decontamination by SimHash windows.

Windows of the size of a benchmark item slide over a document. A window's fingerprint is the
SimHash of its words. A multi-index finds the items whose fingerprints lie within ``RADIUS``
bits: the 64 bits are cut into four blocks, and two fingerprints within 19 bits agree up to 4
bits in some block, so a table of all 16-bit values within 4 bits of an item's block misses
none. The candidates are then verified by the exact similarity of weighted word shingles (sum
of the smaller counts over sum of the larger counts).

A window that holds no shingle of any item has similarity 0 to all of them, so only windows
over such a shingle, in the sizes of the items that have it, are fingerprinted.

The items are a query set: they go through in blocks of about ``ITEMS`` rows and ``ITEM_BYTES``
bytes at most, each broadcast by itself, against all documents.

Defined results: null, empty and word-free texts and items match nothing; an item of fewer words
than a shingle is one shingle, found as such; a text shorter than an item is one window; rows
without an id match like others; repeated rows match each; items of equal texts match each;
empty tables give empty results; other columns are ignored by the search and kept by the filter.
"""

from __future__ import annotations

from collections.abc import Iterator
from itertools import combinations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.pandas.types import to_arrow_type

from .common import bounded_batches, held, only, release
from .jaccard import Shingler, mixed

RADIUS = 19
BLOCKS, WIDTH, NEAR = 4, 16, 4
ITEMS = 2000
ITEM_BYTES = 16 << 20  # of a block


def simhashes(words: np.ndarray, starts: np.ndarray, size: int) -> np.ndarray:
    """SimHash of the windows of ``size`` words (fewer at the end) at ``starts``: each word votes with the bits of its hash."""
    first, last = int(starts.min()), min(len(words), int(starts.max()) + size)
    bits = np.unpackbits(mixed(words[first:last]).view(np.uint8).reshape(-1, 8), axis=1).astype(np.int32)
    sums = np.concatenate([np.zeros((1, 64), np.int32), np.cumsum(bits, axis=0, dtype=np.int32)])
    a, b = starts - first, np.minimum(starts + size, last) - first
    ones = sums[b] - sums[a]
    return np.packbits(2 * ones > (b - a)[:, None], axis=1).view(np.uint64).reshape(-1)


class HammingIndex:
    """All fingerprints within ``RADIUS`` bits, by tables of near values of each 16-bit block."""

    def __init__(self, prints: np.ndarray):
        self.prints = prints
        masks = np.array([sum(1 << i for i in c) for d in range(NEAR + 1) for c in combinations(range(WIDTH), d)], np.uint16)
        self.tables = []
        for k in range(BLOCKS):
            near = (self.block(prints, k)[:, None] ^ masks[None, :]).reshape(-1)
            owner = np.repeat(np.arange(len(prints), dtype=np.int32), len(masks))
            order = np.argsort(near, kind="stable")
            self.tables.append((np.searchsorted(near[order], np.arange((1 << WIDTH) + 1)), owner[order]))

    @staticmethod
    def block(prints: np.ndarray, k: int) -> np.ndarray:
        return (prints >> np.uint64(WIDTH * k) & np.uint64((1 << WIDTH) - 1)).astype(np.uint16)

    def within(self, prints: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Positions in ``prints``, items and distances of all pairs within the radius."""
        at, items = [], []
        for k, (starts, owners) in enumerate(self.tables):
            b = self.block(prints, k).astype(np.int64)
            counts = starts[b + 1] - starts[b]
            at.append(np.repeat(np.arange(len(prints)), counts))
            offset = np.arange(counts.sum()) - np.repeat(np.cumsum(counts) - counts, counts)
            items.append(owners[np.repeat(starts[b], counts) + offset])
        pair = np.unique(np.concatenate(at) * len(self.prints) + np.concatenate(items))
        w, i = pair // len(self.prints), pair % len(self.prints)
        apart = np.bitwise_count(prints[w] ^ self.prints[i])
        near = apart <= RADIUS
        return w[near], i[near], apart[near]


def weighted_similarity(a: np.ndarray, b: np.ndarray) -> float:
    """Weighted Jaccard similarity of two multisets of shingles."""
    keys, which = np.unique(np.concatenate([a, b]), return_inverse=True)
    x, y = np.bincount(which[: len(a)], minlength=len(keys)), np.bincount(which[len(a) :], minlength=len(keys))
    return float(np.minimum(x, y).sum() / max(1, np.maximum(x, y).sum()))


class Items:
    """A block of benchmark items, indexed."""

    def __init__(self, rows: list[tuple[int, str]], words: int):
        self.shingler, self.words = Shingler(words), words
        found = [(i, self.shingler.word_hashes(t)) for i, t in rows]
        found = [(i, w) for i, w in found if len(w)]
        self.ids = [i for i, _ in found]
        self.sizes = np.array([len(w) for _, w in found], np.int64)
        self.shingles = [self.shingler.of_words(w) for _, w in found]
        prints = np.array([simhashes(w, np.zeros(1, np.int64), len(w))[0] for _, w in found], np.uint64)
        self.index = HammingIndex(prints)
        owner = np.repeat(np.arange(len(found)), [len(s) for s in self.shingles])
        every = np.concatenate(self.shingles) if found else np.zeros(0, np.uint64)
        order = np.argsort(every, kind="stable")
        self.keys, self.owner = every[order], owner[order]
        self.maybe = np.zeros(1 << 20, bool)
        self.maybe[(self.keys >> np.uint64(44)).astype(np.int64)] = True
        self.short = [(i, w) for i, (_, w) in enumerate(found) if len(w) < words]

    def _hits(self, shingles: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Positions of a text's shingles that items have, and the items, one row each."""
        at = np.flatnonzero(self.maybe[(shingles >> np.uint64(44)).astype(np.int64)])
        if not len(at):
            return at, at
        low, high = np.searchsorted(self.keys, shingles[at]), np.searchsorted(self.keys, shingles[at], "right")
        counts = high - low
        offset = np.arange(counts.sum()) - np.repeat(np.cumsum(counts) - counts, counts)
        return np.repeat(at, counts), self.owner[np.repeat(low, counts) + offset]

    def matches(self, text: str | None, threshold: float, first: bool = False) -> list[tuple[int, int, int, float, int]]:
        """item, first word, words, similarity and distance of each item's best window in the text that reaches the threshold."""
        w = self.shingler.word_hashes(text)
        shingles = self.shingler.of_words(w)
        if not len(w) or not self.ids:
            return []
        at, items = self._hits(shingles)
        at, items = [at], [items]
        for i, own in self.short:  # items of fewer words than a shingle
            where = np.flatnonzero(w[: len(w) - len(own) + 1] == own[0]) if len(own) <= len(w) else np.zeros(0, np.int64)
            for k in range(1, len(own)):
                where = where[w[where + k] == own[k]]
            at.append(where)
            items.append(np.full(len(where), i, np.int64))
        at, items = np.concatenate(at), np.concatenate(items)
        if not len(at):
            return []
        best: dict[int, tuple[int, int, int, float, int]] = {}
        sizes = self.sizes[items]
        for size in np.unique(sizes):
            over = np.unique(at[sizes == size])
            lead = max(0, int(size) - self.words)
            starts = np.unique((over[:, None] - np.arange(lead + 1)[None, :]).reshape(-1).clip(0, max(0, len(w) - int(size))))
            prints = simhashes(w, starts, int(size))
            for k, i, apart in zip(*self.index.within(prints), strict=True):
                if self.sizes[i] != size:
                    continue
                start = int(starts[k])
                window = self.shingler.of_words(w[start : start + int(size)])
                similarity = weighted_similarity(window, self.shingles[i])
                if similarity >= threshold and (i not in best or similarity > best[i][3]):
                    best[i] = self.ids[i], start, int(min(size, len(w) - start)), similarity, int(apart)
                    if first:
                        return list(best.values())
        return list(best.values())


def item_blocks(benchmark: DataFrame, items: int) -> Iterator[list[tuple[int, str]]]:
    """The items in blocks of about ``items`` rows, less where they are long."""
    rows = only(benchmark, "item_id", "text").where("text IS NOT NULL")
    n, size = rows.agg(F.count("*"), F.coalesce(F.sum(F.octet_length("text")), F.lit(0))).first()
    blocks = max(1, -(-n // items), -(-size // ITEM_BYTES))
    for k in range(blocks):
        yield [(r["item_id"], r["text"]) for r in rows.where(F.pmod(F.xxhash64("item_id", "text"), F.lit(blocks)) == k).orderBy("item_id", "text").collect()]


def _indexed(rows: list[tuple[int, str]], words: int) -> Items:
    kept, key = held("items"), hash((words, *rows))
    if key not in kept:
        kept.clear()
        kept[key] = Items(rows, words)
    return kept[key]


def find(docs: DataFrame, benchmark: DataFrame, words: int = 5, threshold: float = 0.8, items: int = ITEMS) -> DataFrame:
    """doc_id, item_id, first_word, n_words, similarity, distance of each document and item that match."""
    spark = docs.sparkSession
    bounded_batches(spark)
    names = ["doc_id", "item_id", "first_word", "n_words", "similarity", "distance"]
    doc_kind, item_kind = docs.schema["doc_id"].dataType, benchmark.schema["item_id"].dataType
    kinds = [to_arrow_type(doc_kind), to_arrow_type(item_kind), pa.int64(), pa.int64(), pa.float64(), pa.int32()]
    out = None
    for block in item_blocks(benchmark, items):
        sent = spark.sparkContext.broadcast(block)

        def run(batches: Iterator[pa.RecordBatch], sent=sent) -> Iterator[pa.RecordBatch]:
            own = _indexed(sent.value, words)
            for b in batches:
                rows = [(d, *m) for d, t in zip(b.column(0).to_pylist(), b.column(1).to_pylist(), strict=True) for m in own.matches(t, threshold)]
                cols = list(zip(*rows, strict=True)) if rows else [()] * 6
                yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(cols, kinds, strict=True)], names=names)

        found = only(docs, "doc_id", "text").mapInArrow(run, f"doc_id {doc_kind.simpleString()}, item_id {item_kind.simpleString()}, first_word long, n_words long, similarity double, distance int")
        out = found if out is None else out.union(found)
    return out


def drop_matches(docs: DataFrame, benchmark: DataFrame, words: int = 5, threshold: float = 0.8, items: int = ITEMS) -> DataFrame:
    """The rows, with all columns, that hold no benchmark item; judged in passes, without a join."""
    bounded_batches(docs.sparkSession)
    at = docs.columns.index("text")
    for block in item_blocks(benchmark, items):
        sent = docs.sparkSession.sparkContext.broadcast(block)

        def run(batches: Iterator[pa.RecordBatch], sent=sent) -> Iterator[pa.RecordBatch]:
            own = _indexed(sent.value, words)
            for b in batches:
                yield b.filter(pa.array([not own.matches(t, threshold, first=True) for t in b.column(at).to_pylist()], pa.bool_()))
            release()

        docs = docs.mapInArrow(run, docs.schema)
    return docs
