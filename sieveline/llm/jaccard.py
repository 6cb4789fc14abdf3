"""Operator 10: n-gram Jaccard join by parity sketches.

A document's sketch XORs the hashes of its shingles into blocks. Only a shingle of the
symmetric difference can change a block, so the blocks in which two sketches differ (and the
bits in which their 512-bit parity sketches differ) never outnumber the symmetric difference.
Similar documents differ in so few shingles that, of the blocks of their size band, some must
be equal: by pigeonhole a pair shares one of its first ``d + 1`` blocks, d being the largest
difference that the threshold allows, in any order of blocks that depends on their contents
alone. The order puts blocks of many uncommon shingles first. Documents that share such a block
are candidates; size and parity sketches prune them; the shingle sets decide.

Equal sets are one class from the start. In a block's bucket every class is compared with the
smallest one (first within a chunk of the input, then among the chunks' smallest), so a large
group of near copies costs a star, not all pairs. Links so found are joined to components;
classes that share a bucket but not yet a component are compared in a second step, by their
sketches inside the bucket and then exactly, so that no link that could join two components is
missed.

Defined results: a text without words, or null, has no shingles and is its own component; a row
without an id has no component and links nothing; rows of one id and different texts are
classes of their own; repeated rows are one class; an empty table gives an empty result; other
columns are ignored, whatever their names. Ids are integers. Shingles, texts and classes are
known by 64-bit hashes. The filter ``keep_first`` keeps one row of each component and of each
repeated row; rows without an id take part in it by their texts, after all rows with one.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import bounded_batches, fresh, held, only, release, setting, spread, stored
from .graph import components

M1, M2, M3 = np.uint64(0x9E3779B97F4A7C15), np.uint64(0xC2B2AE3D27D4EB4F), np.uint64(0x165667B19E3779F9)
BAND = 3  # sizes of a band span this factor
SHARE = 2.5  # shingles of a band's largest sets for each block
CHUNK = 500_000  # sketch entries that a task holds; its arrays are copied some ten times
COUNTED = 1_000_000  # shingles that a task holds to count them
CROWD = 2048  # classes of a bucket that one task compares; larger buckets are dealt out as pairs of blocks
KNOWN = 6  # buckets of a class that its rows in the second step know of
WORDS = 8  # 64-bit words of a parity sketch: within 0.8 it tells apart sets of up to some 1000 shingles
COMMON = 1 << 16  # length of the list of the most frequent shingles


def mixed(x: np.ndarray) -> np.ndarray:
    x = (x ^ x >> np.uint64(31)) * M2
    return (x ^ x >> np.uint64(29)) * M1


class Shingler:
    """Sorted distinct 64-bit shingle hashes of texts; hashes of recurring words are kept."""

    def __init__(self, words: int, kept: int = 200_000):
        self.words, self.kept, self.known = words, kept, {}
        self.factors = [np.uint64(xxhash.xxh64_intdigest(str(i)) | 1) for i in range(words)]

    def _learn(self, word: bytes) -> int:
        h = xxhash.xxh64_intdigest(word)
        if len(word) <= 64:
            self.known[word] = h
        return h

    def word_hashes(self, text: str | None) -> np.ndarray:
        if len(self.known) > self.kept:
            self.known.clear()
        get, learn = self.known.get, self._learn
        return np.array([h if (h := get(t)) is not None else learn(t) for t in (text or "").encode().lower().split()], np.uint64)

    def hashes(self, text: str | None) -> np.ndarray:
        """The hash of each word position's shingle, in order."""
        return self.of_words(self.word_hashes(text))

    def of_words(self, w: np.ndarray) -> np.ndarray:
        n = len(w) - self.words + 1
        if n <= 0:
            return np.array([xxhash.xxh64_intdigest(w.tobytes())], np.uint64) if len(w) else w
        total = np.zeros(n, np.uint64)
        for i, f in enumerate(self.factors):
            total += w[i : i + n] * f
        return mixed(total)

    def set(self, text: str | None) -> np.ndarray:
        s = np.sort(self.hashes(text))
        return s[np.concatenate([[True], s[1:] != s[:-1]])] if len(s) else s


def node_of(shingles: np.ndarray) -> int:
    """The class of a set, as a signed 64-bit number."""
    h = xxhash.xxh64_intdigest(shingles.tobytes())
    return h - (1 << 64) if h >> 63 else h


def first_size(num: int, den: int) -> int:
    """The smallest size of the first band: the smallest set that links to one of another size; smaller ones link only if equal."""
    return -(-num // (den - num)) if den > num else 1


def band_of(n: int, first: int) -> tuple[int, int, int]:
    """Number, smallest size and blocks of the band of sets of ``n``; the first band begins at ``first``."""
    band, low = 0, first
    while n >= low * BAND:
        band, low = band + 1, low * BAND
    return band, low, max(16, int(low * BAND / SHARE))


def sketch_keys(shingles: np.ndarray, common: np.ndarray, num: int, den: int) -> np.ndarray:
    """Keys of the sketch blocks by which a set is found, in its own band and in the next where a larger partner may be."""
    n, first = len(shingles), first_size(num, den)
    if n < first:
        return np.zeros(0, np.uint64)
    rare = np.ones(n, np.int64)
    if len(common):
        at = np.minimum(np.searchsorted(common, shingles), len(common) - 1)
        rare[common[at] == shingles] = 0
    toggles, differ = mixed(shingles ^ M3), n * (den - num) // num
    band, low, blocks = band_of(n, first)
    bands = [(band, blocks)]
    if n * den // num >= low * BAND:
        bands.append((band + 1, band_of(low * BAND, first)[2]))
    out = []
    for number, m in bands:
        place = ((shingles >> np.uint64(32)) * np.uint64(m) >> np.uint64(32)).astype(np.int64)
        starts = np.flatnonzero(np.concatenate([[True], place[1:] != place[:-1]]))
        words, counts = np.bitwise_xor.reduceat(toggles, starts), np.diff(np.append(starts, n))
        uncommon = np.add.reduceat(rare, starts)
        keys = mixed(words + place[starts].astype(np.uint64) * M1 + np.uint64(number + 1) * M3)
        if differ + 1 < len(keys):
            keys = keys[np.lexsort((keys, -counts, -uncommon))[: differ + 1]]
        elif differ + 1 > len(keys):  # too few blocks have shingles: empty ones count as well
            empty = np.setdiff1d(np.arange(m), place[starts])[: differ + 1 - len(keys)]
            keys = np.concatenate([keys, mixed(empty.astype(np.uint64) * M1 + np.uint64(number + 1) * M3)])
        out.append(keys)
    return np.concatenate(out)


def parity_sketch(shingles: np.ndarray) -> list[int]:
    """``WORDS`` signed numbers of 64 bits each: each shingle toggles one bit."""
    odd = np.bincount((shingles & np.uint64(64 * WORDS - 1)).astype(np.int64), minlength=64 * WORDS) & 1
    return np.packbits(odd.astype(np.uint8)).view(">i8").astype(np.int64).tolist()


def key_range(keys: np.ndarray, ranges: int) -> np.ndarray:
    return ((keys >> np.uint64(40)) * np.uint64(ranges) >> np.uint64(24)).astype(np.int64)


def starred(keys: np.ndarray, nodes: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Sorted keys with the smallest node of each, by position; each entry's leader; what entries are repeated."""
    order = np.lexsort((nodes, keys))
    keys, nodes = keys[order], nodes[order]
    fresh = np.concatenate([[True], (keys[1:] != keys[:-1]) | (nodes[1:] != nodes[:-1])])
    keys, nodes = keys[fresh], nodes[fresh]
    first = np.concatenate([[True], keys[1:] != keys[:-1]])
    return keys, nodes, np.flatnonzero(first)[np.cumsum(first) - 1]


def common_shingles(docs: DataFrame, words: int) -> np.ndarray:
    """Sorted hashes of the ``COMMON`` most frequent of the shingles that occur in many documents of some chunk.

    The list only orders blocks, equally for all documents; what it misses costs time, not links.
    """
    bounded_batches(docs.sparkSession)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held("jaccard")
        shingler, sets, size = Shingler(words), [], 0

        def frequent() -> pa.RecordBatch:
            s = np.sort(np.concatenate(sets))
            starts = np.flatnonzero(np.concatenate([[True], s[1:] != s[:-1]]))
            counts = np.diff(np.append(starts, len(s)))
            often = counts >= 8
            return pa.RecordBatch.from_arrays([pa.array(s[starts[often]].view(np.int64)), pa.array(counts[often])], names=["shingle", "n"])

        for b in batches:
            for text in b.column(0).to_pylist():
                sets.append(shingler.set(text))
                size += len(sets[-1])
                if size > COUNTED:
                    yield frequent()
                    sets, size = [], 0
        if size:
            yield frequent()
        shingler.known.clear()
        sets = []
        release()

    top = only(docs, "text").mapInArrow(run, "shingle long, n long").groupBy("shingle").agg(F.sum("n").alias("n")).orderBy(F.desc("n"), "shingle").limit(COMMON).collect()
    return np.sort(np.array([r["shingle"] for r in top], np.int64).view(np.uint64))


def sketched(docs: DataFrame, words: int, num: int, den: int, ranges: int) -> DataFrame:
    """Rows of three kinds: documents (doc_id, print, n, node, sketch; print: the text's hash), pairs found within a chunk (key, node, leader), packed sketch entries (range, keys, nodes)."""
    spark = docs.sparkSession
    common = spark.sparkContext.broadcast(common_shingles(docs, words))  # at most COMMON numbers
    schema = "doc_id long, print long, n long, node long, sketch array<long>, key long, leader long, range int, keys binary, nodes binary"

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held("jaccard")
        shingler, keys, nodes, size = Shingler(words), [], [], 0

        def batch(**cols) -> pa.RecordBatch:
            n = len(next(iter(cols.values())))
            kinds = (("doc_id", pa.int64()), ("print", pa.int64()), ("n", pa.int64()), ("node", pa.int64()), ("sketch", pa.list_(pa.int64())), ("key", pa.int64()), ("leader", pa.int64()), ("range", pa.int32()), ("keys", pa.binary()), ("nodes", pa.binary()))
            return pa.RecordBatch.from_arrays([pa.nulls(n, k) if c not in cols else v if isinstance(v := cols[c], pa.Array) else pa.array(v, k) for c, k in kinds], names=[c for c, _ in kinds])

        def flush() -> Iterator[pa.RecordBatch]:
            k, v, lead = starred(np.concatenate(keys), np.repeat(np.array([x for x, _ in nodes], np.int64), [c for _, c in nodes]))
            near = lead != np.arange(len(k))
            if near.any():
                yield batch(key=k[near].view(np.int64), node=v[near], leader=v[lead[near]])
            k, v = k[~near], v[~near]
            cuts = np.searchsorted(key_range(k, ranges), np.arange(ranges + 1))
            full = np.flatnonzero(np.diff(cuts))
            yield batch(range=full, keys=[k[cuts[r] : cuts[r + 1]].tobytes() for r in full], nodes=[v[cuts[r] : cuts[r + 1]].tobytes() for r in full])

        for b in batches:
            ids, ns, own, sketches = b.column(0).to_pylist(), [], [], []
            for doc_id, text in zip(ids, b.column(1).to_pylist(), strict=True):
                s = shingler.set(text)
                ns.append(len(s))
                own.append(node_of(s) if len(s) and doc_id is not None else None)
                sketches.append(parity_sketch(s))
                if own[-1] is not None and len(k := sketch_keys(s, common.value, num, den)):
                    keys.append(k)
                    nodes.append((own[-1], len(k)))
                    size += len(k)
            yield batch(doc_id=ids, print=b.column(2), n=ns, node=own, sketch=sketches)
            if size > CHUNK:
                yield from flush()
                keys, nodes, size = [], [], 0
        if size:
            yield from flush()
        shingler.known.clear()
        keys, nodes = [], []
        release()

    rows = only(docs, "doc_id", "text").select(F.col("doc_id").cast("long").alias("doc_id"), "text", F.xxhash64("text").alias("print"))
    return stored(rows.mapInArrow(run, schema), "sketches")


def candidates(sketches: DataFrame) -> DataFrame:
    """key, node, leader: classes that share a sketch block with a smaller class; a block has a row for each chunk at most here."""

    def gather(group: pa.Table) -> pa.Table:
        keys, nodes = np.frombuffer(b"".join(group["keys"].to_pylist()), np.uint64), np.frombuffer(b"".join(group["nodes"].to_pylist()), np.int64)
        k, v, lead = starred(keys, nodes)
        near = lead != np.arange(len(k))
        return pa.table({"key": k[near].view(np.int64), "node": v[near], "leader": v[lead[near]]})

    across = sketches.where("range IS NOT NULL").select("range", "keys", "nodes").groupBy("range").applyInArrow(gather, "key long, node long, leader long")
    return stored(sketches.where("leader IS NOT NULL").select("key", "node", "leader").union(across), "candidates")


def pruned(pairs: DataFrame, classes: DataFrame, num: int, den: int) -> DataFrame:
    """Distinct pairs (a, b) that sizes and parity sketches allow."""
    a, b = (classes.select(F.col("node").alias(x), F.col("n").alias(f"n{x}"), F.col("sketch").alias(f"s{x}")) for x in "ab")
    most = F.expr(f"CAST(floor({den - num} * (na + nb) / {den + num}D) AS long)")
    hamming = sum((F.bit_count(F.col("sa")[i].bitwiseXOR(F.col("sb")[i])) for i in range(WORDS)), F.lit(0))
    return pairs.distinct().join(a, "a").join(b, "b").where((F.lit(den) * F.least("na", "nb") >= F.lit(num) * F.greatest("na", "nb")) & (hamming <= most)).select("a", "b")


class Buckets:
    """Classes of some buckets, a row for each class and bucket, compared by their sketches.

    ``unit`` is the bucket, or a pair of blocks of a crowded one; ``side`` is 0 for rows to be
    compared among themselves, else 1 or 2 for those to be compared with the other side.
    ``keys`` has the first few buckets of each row's class, the most crowded first: a pair does not
    leave a bucket if both are known to be in an earlier one, so it leaves one or two of those it shares.
    """

    def __init__(self, unit: np.ndarray, key: np.ndarray, side: np.ndarray, node: np.ndarray, root: np.ndarray, size: np.ndarray, sketch: np.ndarray, keys: np.ndarray, num: int, den: int):
        self.unit, self.key, self.side, self.node, self.root, self.size, self.sketch, self.keys, self.num, self.den = unit, key, side, node, root, size, sketch, keys, num, den

    def near(self, i: np.ndarray, j: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Of the pairs of rows, those of different components that sizes and parity sketches allow."""
        ok = (self.root[i] != self.root[j]) & ((self.side[i] == 0) | (self.side[i] != self.side[j]))
        i, j = i[ok], j[ok]
        a, b = self.size[i], self.size[j]
        ok = self.den * np.minimum(a, b) >= self.num * np.maximum(a, b)
        i, j = i[ok], j[ok]
        apart = np.bitwise_count(self.sketch[i] ^ self.sketch[j]).sum(axis=1, dtype=np.int64)
        ok = apart <= (self.den - self.num) * (self.size[i] + self.size[j]) // (self.den + self.num)
        return i[ok], j[ok]

    def first(self, i: np.ndarray, j: np.ndarray) -> np.ndarray:
        """False where both classes are known to be in an earlier bucket."""
        a, b = self.keys[i], self.keys[j]
        own = a == self.key[i][:, None]  # all that are listed come before a bucket that is not
        at = np.where(own.any(axis=1), own.argmax(axis=1), a.shape[1])
        shared = (a[:, :, None] == b[:, None, :]).any(axis=2) & (np.arange(a.shape[1]) < at[:, None])
        return ~shared.any(axis=1)

    def pairs(self) -> np.ndarray:
        """Pairs of classes, smaller first."""
        found = [np.zeros((0, 2), np.int64)]

        def keep(i: np.ndarray, j: np.ndarray) -> None:
            i, j = self.near(i, j)
            for part in range(0, len(i), 20_000):
                x, y = i[part : part + 20_000], j[part : part + 20_000]
                ok = self.first(x, y)
                x, y = self.node[x[ok]], self.node[y[ok]]
                found.append(np.stack([np.minimum(x, y), np.maximum(x, y)], axis=1))

        unit = self.unit
        starts = np.flatnonzero(np.concatenate([[True], unit[1:] != unit[:-1]])) if len(unit) else np.zeros(0, np.int64)
        counts = np.diff(np.append(starts, len(unit)))
        small = np.repeat(counts <= 64, counts)
        for d in range(1, min(64, len(unit))):
            at = np.flatnonzero((unit[:-d] == unit[d:]) & small[d:])
            if not len(at):
                break
            keep(at, at + d)
        for start, n in zip(starts[counts > 64], counts[counts > 64], strict=True):
            for top in range(0, n, 64):  # a strip of the square at a time
                i, j = np.arange(start + top, start + min(n, top + 64)), np.arange(start + top + 1, start + n)
                i, j = (x.reshape(-1) for x in np.broadcast_arrays(i[:, None], j[None, :]))
                keep(i[i < j], j[i < j])
        return np.unique(np.concatenate(found), axis=0)


def unlinked_pairs(members: DataFrame, classes: DataFrame, num: int, den: int, ranges: int) -> DataFrame:
    """a, b: pairs of ``members`` (key, node, root, crowd: the members of the key) that share a bucket, not a component, and may be similar.

    They are compared by their sketches where the bucket is; only what passes leaves the task.
    """
    rows = members.select("key", "node", "root", F.ceil(F.col("crowd") / CROWD).cast("int").alias("blocks"))
    own = F.pmod(F.xxhash64("node"), F.col("blocks")).cast("int")
    rows = rows.withColumn("own", own).withColumn("other", F.explode(F.sequence(F.lit(0), F.col("blocks") - 1)))
    unit = F.xxhash64("key", F.least("own", "other"), F.greatest("own", "other"))
    side = F.when(F.col("own") == F.col("other"), 0).when(F.col("own") < F.col("other"), 1).otherwise(2).cast("int")
    rows = rows.select(unit.alias("unit"), "key", side.alias("side"), "node", "root")
    order = F.sort_array(F.collect_list(F.struct((-F.col("crowd")).alias("c"), "key")))  # as many as a text has sketch blocks
    keys = members.groupBy(F.col("node").alias("in_keys")).agg(F.slice(order, 1, KNOWN)["key"].alias("keys"))
    early = [F.coalesce(F.get("keys", F.lit(i)), F.lit((1 << 63) - 1)).alias(f"k{i}") for i in range(KNOWN)]
    about = classes.join(keys, F.col("node") == F.col("in_keys")).select(F.col("node").alias("of"), F.col("n").alias("size"), *early, *[F.col("sketch")[i].alias(f"s{i}") for i in range(WORDS)])
    rows = rows.join(about, F.col("node") == F.col("of")).select(F.pmod("unit", F.lit(ranges)).cast("int").alias("range"), "unit", "key", "side", "node", "root", "size", *[f"k{i}" for i in range(KNOWN)], *[f"s{i}" for i in range(WORDS)])

    def compare(group: pa.Table) -> pa.Table:
        group = group.sort_by("unit").combine_chunks()
        col = lambda c: group[c].to_numpy()
        sketches = np.stack([col(f"s{i}") for i in range(WORDS)], axis=1).view(np.uint64)
        early = np.stack([col(f"k{i}") for i in range(KNOWN)], axis=1)
        found = Buckets(col("unit"), col("key"), col("side"), col("node"), col("root"), col("size"), sketches, early, num, den).pairs()
        return pa.table({"a": found[:, 0], "b": found[:, 1]})

    return rows.groupBy("range").applyInArrow(compare, "a long, b long").distinct()


def shingle_sets(docs: DataFrame, wanted: DataFrame, words: int) -> DataFrame:
    """node, shingles of the classes in ``wanted`` (node, doc_id: one of its documents)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held("jaccard")
        shingler = Shingler(words)
        for b in batches:
            sets = [shingler.set(t) for t in b.column(1).to_pylist()]
            right = [i for i, (s, n) in enumerate(zip(sets, b.column(0).to_pylist(), strict=True)) if len(s) and node_of(s) == n]
            yield pa.RecordBatch.from_arrays([b.column(0).take(pa.array(right, pa.int64())), pa.array([sets[i].tobytes() for i in right], pa.binary())], names=["node", "shingles"])

    texts = only(docs, "doc_id", "text").join(wanted.withColumnRenamed("doc_id", "first_id"), F.col("doc_id") == F.col("first_id"))
    return texts.select("node", "text").mapInArrow(run, "node long, shingles binary")


def verified(pairs: DataFrame, sets: DataFrame, num: int, den: int) -> DataFrame:
    """The pairs (a, b) whose sets reach the threshold; exact."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            keep = []
            for x, y in zip(batch.column(2), batch.column(3), strict=True):
                s, t = np.frombuffer(x.as_buffer(), np.uint64), np.frombuffer(y.as_buffer(), np.uint64)
                both = np.sort(np.concatenate([s, t]))
                inter = int((both[1:] == both[:-1]).sum())
                keep.append(den * inter >= num * (len(s) + len(t) - inter))
            yield pa.RecordBatch.from_arrays([batch.column(0).filter(pa.array(keep, pa.bool_())), batch.column(1).filter(pa.array(keep, pa.bool_()))], names=["a", "b"])

    a, b = sets.select(F.col("node").alias("a"), F.col("shingles").alias("sa")), sets.select(F.col("node").alias("b"), F.col("shingles").alias("sb"))
    return pairs.join(a, "a").join(b, "b").select("a", "b", "sa", "sb").mapInArrow(run, "a long, b long")


def linked_classes(docs: DataFrame, words: int, num: int, den: int, ranges: int | None = None) -> tuple[DataFrame, DataFrame]:
    """Documents (doc_id, print, n, node) and, for the classes that have a link to another, (node, root)."""
    if not num <= den <= num * 1.25:
        raise ValueError("the bands are laid out for thresholds from 0.8 to 1")
    spark = docs.sparkSession
    bounded_batches(spark)
    ranges = ranges or spread(docs)
    sketches = sketched(docs, words, num, den, ranges)
    found = candidates(sketches)
    rows = sketches.where("n IS NOT NULL").select("doc_id", "print", "n", "node", "sketch")
    near = found.select("node").union(found.select("leader")).distinct().withColumnRenamed("node", "near")
    # one row for each class that may have a link; copies are pre-aggregated
    classes = rows.where("node IS NOT NULL").groupBy("node").agg(F.min("doc_id").alias("doc_id"), F.min("n").alias("n"), F.min("sketch").alias("sketch"))
    classes = stored(classes.join(near, F.col("node") == F.col("near"), "left_semi"), "classes")
    # the filter makes Spark send a bounded Bloom filter of the wanted ids to the scan, so that few texts are shuffled
    with setting(spark, "spark.sql.optimizer.runtime.bloomFilter.applicationSideScanSizeThreshold", "0"):
        sets = stored(shingle_sets(docs, classes.where(F.col("n") >= first_size(num, den)).select("node", "doc_id"), words), "sets")
    star = pruned(found.select(F.col("leader").alias("a"), F.col("node").alias("b")), classes, num, den)
    links = stored(verified(star, sets, num, den), "links")
    roots = components(links)
    # second step: pairs of a bucket that are in different components
    members = found.select("key", "node").union(found.select("key", F.col("leader").alias("node"))).distinct()
    placed = members.join(roots.withColumnRenamed("node", "placed"), F.col("node") == F.col("placed"), "left").select("key", "node", F.coalesce("root", "node").alias("root"))
    open_keys = placed.groupBy("key").agg(F.min("root").alias("low"), F.max("root").alias("high"), F.count("*").alias("crowd")).where("low != high").select(F.col("key").alias("open_key"), "crowd")
    left = stored(placed.join(open_keys, F.col("key") == F.col("open_key")).select("key", "node", "root", "crowd"), "open")
    more = stored(verified(unlinked_pairs(left, classes, num, den, ranges), sets, num, den), "more-links")
    if not more.isEmpty():
        roots = components(links.union(more), "all-components")
    return rows.select("doc_id", "print", "n", "node"), roots


def judged(docs: DataFrame, words: int, num: int, den: int) -> DataFrame:
    """doc_id, print, n, node, root and component_id of each row; a row without shingles has none of the last three."""
    rows, roots = linked_classes(docs, words, num, den)
    firsts = rows.where("node IS NOT NULL").groupBy("node").agg(F.min("doc_id").alias("first"))
    placed = stored(firsts.join(roots.withColumnRenamed("node", "linked"), F.col("node") == F.col("linked"), "left").select("node", "first", F.coalesce("root", "node").alias("root")), "placed")
    lowest = placed.groupBy("root").agg(F.min("first").alias("component_id"))
    named = stored(placed.join(lowest.withColumnRenamed("root", "of"), F.col("root") == F.col("of")).select(F.col("node").alias("class"), "root", "component_id"), "named")
    return rows.join(named, F.col("node") == F.col("class"), "left").select("doc_id", "print", "n", "node", "root", "component_id")


def near_duplicates(docs: DataFrame, words: int = 4, num: int = 85, den: int = 100) -> DataFrame:
    """doc_id, n_shingles, component_id of each row: documents link when den * intersection >= num * union."""
    own = F.when(F.col("node").isNull(), F.col("doc_id")).otherwise(F.col("component_id"))
    return judged(docs, words, num, den).select("doc_id", F.col("n").alias("n_shingles"), own.alias("component_id"))


def keep_first(docs: DataFrame, words: int = 5, num: int = 8, den: int = 10) -> DataFrame:
    """One row of each group of near duplicates, that of the smallest id, with all columns.

    A row is known by its id and its text's hash. Of rows that repeat both one stays, no matter
    which; texts without words are near nothing. A row without an id is known by a number made
    of its text that comes after other ids.
    """
    key, mark = fresh(docs, "key"), fresh(docs, "print")
    ident = F.coalesce(F.col("doc_id").cast("long"), F.xxhash64("text").bitwiseAND(F.lit((1 << 62) - 1)).bitwiseOR(F.lit(1 << 62)))
    known = docs.withColumns({key: ident, mark: F.xxhash64("text")})
    found = judged(known.select(F.col(key).alias("doc_id"), "text"), words, num, den)
    each = found.groupBy("doc_id", "print").agg(F.count("*").alias("copies"), F.min("node").alias("node"), F.min("root").alias("root"), F.min("component_id").alias("component_id"))
    # an id may have several texts in one component, where the smallest print decides, and texts in several components
    first = each.where("doc_id = component_id").groupBy("root", "doc_id").agg(F.min(F.struct("print", "copies")).alias("one")).select("doc_id", "one.*")
    kept = stored(first.union(each.where("node IS NULL").select("doc_id", "print", "copies")), "kept").select(F.col("doc_id").alias(fresh(docs, "kept_key")), F.col("print").alias(fresh(docs, "kept_print")), F.col("copies").alias(fresh(docs, "copies")))
    k, p, n = kept.columns
    rows = known.join(kept, (F.col(key) == F.col(k)) & (F.col(mark) == F.col(p)))
    once = rows
    if not kept.where(F.col(n) > 1).isEmpty():
        once = rows.where(F.col(n) == 1).union(rows.where(F.col(n) > 1).dropDuplicates([key, mark]))
    return once.select(*[F.col(f"`{c}`") for c in docs.columns])
