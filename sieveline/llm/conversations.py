"""Operator 12: prefix trie of conversations.

A node is a distinct sequence of first turns. Each turn gives two 64-bit hashes of its place, role and
text; the digest of a sequence is their exclusive or, so that all prefixes of a conversation are
running values, and a node's parent is its digest without its own turn: parent edges need no search.
Rows with the same digest are one node, counted before they are shuffled. From there a node is known
by its smallest conversation and its depth.

Leaves and savings go up by pointer jumping: in a round of step ``s`` each node gives what it holds to
the ancestor ``s`` above and then points ``2s`` above, so that the deepest path takes a logarithmic
number of rounds. Gifts to one ancestor are added up before they are shuffled, pointers to the root
are known without a join, and each round is written to the shared folder.

No conversation need fit in a task: turns are dealt by ranges of conversation and turn, and numbered
and digested within a range first, then by what all ranges before hold. The ids that end at a node
are joined in blocks of 1024 neighbouring ids, and these go through SHA-256 one after the other.

Sequences are told apart by 128 bits.

Defined results: a null role or text is the empty one; turns without a number come first; turns of
equal number are ordered by role and then by a hash of their text; repeated rows are turns each; rows
without a conversation belong to none and make no node; very long texts are taken whole, but only
their lengths and hashes are shuffled; an empty table gives an empty result; other columns are
ignored.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import bounded_batches, only, stored

BLOCK_BITS = 10
NODE = ["depth", "x1", "x2"]


def zero() -> Column:
    return F.lit(0).cast("long")


def numbered(conversations: DataFrame) -> tuple[DataFrame, DataFrame]:
    """conv_id, part, local, t1, t2, size of each turn; and conv_id, part, before, n of each range of a conversation.

    ``local`` is a turn's place among its conversation's turns in its range, ``before`` what lies in earlier ranges.
    """
    text, role = F.coalesce("text", F.lit("")), F.coalesce("role", F.lit(""))
    turns = only(conversations, "conv_id", "turn", "role", "text").where("conv_id IS NOT NULL")
    turns = turns.select("conv_id", "turn", role.alias("role"), F.xxhash64(role, text).alias("t1"), F.xxhash64(F.lit(1), text, role).alias("t2"), F.length(text).cast("long").alias("size"))
    # the last key only parts repeated rows
    order = [F.col("conv_id"), F.asc_nulls_first("turn"), F.col("role"), F.col("t1"), F.col("t2"), F.monotonically_increasing_id()]
    dealt = turns.repartitionByRange(*order).sortWithinPartitions("conv_id", F.asc_nulls_first("turn"), "role", "t1", "t2")
    # numbers ascend in the order of the rows of a range
    dealt = stored(dealt.select("conv_id", "t1", "t2", "size", F.spark_partition_id().alias("part"), F.monotonically_increasing_id().alias("at")), "turns")
    spans = dealt.groupBy("conv_id", "part").agg(F.min("at").alias("first"), F.count("*").alias("n"))
    earlier = Window.partitionBy("conv_id").orderBy("part").rowsBetween(Window.unboundedPreceding, -1)
    spans = stored(spans.withColumn("before", F.coalesce(F.sum("n").over(earlier), zero())), "spans")
    return dealt, spans


def rebuilt(dealt: DataFrame, spans: DataFrame, heads: int = 6, family: int = 100) -> tuple[DataFrame, DataFrame]:
    """conv_id, part, depth, t1, t2, size of each rebuilt turn; and conv_id, length of each conversation.

    The first h turns come from the first conversation of a family, h being drawn from the id; the rest are its own.
    """
    lengths = spans.groupBy("conv_id").agg(F.sum("n").alias("n"))
    drawn = F.crc32(F.col("conv_id").cast("string").cast("binary")) % heads
    convs = lengths.select("conv_id", "n", (F.col("conv_id") - F.col("conv_id") % family).alias("base"), drawn.alias("h"))
    bases = lengths.select(F.col("conv_id").alias("base"), F.col("n").alias("base_n"))
    convs = convs.join(bases, "base", "left").withColumn("m", F.least("h", F.coalesce("base_n", zero()))).withColumn("length", F.col("m") + F.greatest(F.col("n") - F.col("h"), zero()))
    convs = stored(convs.select("conv_id", "base", "h", "m", "length"), "conversations")
    placed = dealt.join(spans.select("conv_id", "part", "first", "before"), ["conv_id", "part"]).withColumn("place", F.col("before") + F.col("at") - F.col("first") + 1)
    row = lambda part, depth: ["conv_id", part.alias("part"), depth.alias("depth"), "t1", "t2", "size"]
    own = placed.join(convs.select("conv_id", "h", "m"), "conv_id").where("place > h").select(*row(F.col("part"), F.col("place") - F.col("h") + F.col("m")))
    first = placed.where((F.col("place") < heads) & (F.col("conv_id") % family == 0)).select(F.col("conv_id").alias("base"), "place", "t1", "t2", "size")
    lent = first.join(convs.select("conv_id", "base", "m"), "base").where("place <= m").select(*row(F.lit(-1), F.col("place")))
    return own.unionByName(lent), convs.select("conv_id", "length")


def digested(turns: DataFrame) -> DataFrame:
    """conv_id, depth, x1, x2, p1, p2, size: the digest of each prefix and of its parent."""
    turns = turns.withColumns({"g1": F.xxhash64("depth", "t1", "t2"), "g2": F.xxhash64("t2", "depth", "t1", F.lit(2))}).drop("t1", "t2")
    turns = stored(turns, "rebuilt")
    earlier = Window.partitionBy("conv_id").orderBy("part").rowsBetween(Window.unboundedPreceding, -1)
    totals = turns.groupBy("conv_id", "part").agg(F.bit_xor("g1").alias("s1"), F.bit_xor("g2").alias("s2"))
    totals = totals.select("conv_id", "part", *[F.coalesce(F.bit_xor(f"s{i}").over(earlier), zero()).alias(f"b{i}") for i in (1, 2)])
    upto = Window.partitionBy("conv_id", "part").orderBy("depth").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    rows = turns.withColumns({f"l{i}": F.bit_xor(f"g{i}").over(upto) for i in (1, 2)}).join(totals, ["conv_id", "part"])
    rows = rows.withColumns({f"x{i}": F.col(f"l{i}").bitwiseXOR(F.col(f"b{i}")) for i in (1, 2)})
    return stored(rows.select("conv_id", "depth", "x1", "x2", *[F.col(f"x{i}").bitwiseXOR(F.col(f"g{i}")).alias(f"p{i}") for i in (1, 2)], "size"), "digests")


def ends(digests: DataFrame, lengths: DataFrame) -> DataFrame:
    """depth, x1, x2, ends_sha256 of the nodes at which conversations end."""
    at = digests.join(lengths, "conv_id").where("depth = length").select("conv_id", *NODE)
    nowhere = lengths.where("length = 0").select("conv_id", *[zero().alias(c) for c in NODE])
    block = F.expr(f"shiftright(conv_id, {BLOCK_BITS})").alias("block")
    blocks = at.unionByName(nowhere).groupBy(*NODE, block).agg(F.array_join(F.sort_array(F.collect_list("conv_id")), ",").alias("ids"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        node, state = None, None
        for b in batches:
            done = []
            for *key, ids in zip(*[c.to_pylist() for c in b.columns], strict=True):
                if key == node:
                    state.update(f",{ids}".encode())
                    continue
                if node:
                    done.append((*node, state.hexdigest()))
                node, state = key, hashlib.sha256(ids.encode())
            yield table(done)
        yield table([(*node, state.hexdigest())] if node else [])

    def table(rows: list[tuple]) -> pa.RecordBatch:
        columns = list(zip(*rows, strict=True)) or [(), (), (), ()]
        return pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(columns, (pa.int64(), pa.int64(), pa.int64(), pa.string()), strict=True)], names=[*NODE, "ends_sha256"])

    return blocks.repartition(*NODE).sortWithinPartitions(*NODE, "block").select(*NODE, "ids").mapInArrow(run, "depth long, x1 long, x2 long, ends_sha256 string")


def nodes(digests: DataFrame, lengths: DataFrame) -> DataFrame:
    """conv_id, depth, parent_conv_id, n_convs, n_children, own, ends_sha256 of each node; stored."""
    count = F.count("*").alias("n_convs")
    found = digests.groupBy(*NODE).agg(F.min("conv_id").alias("conv_id"), count, F.max("p1").alias("p1"), F.max("p2").alias("p2"), F.max("size").alias("size"))
    root = lengths.agg(F.min("conv_id").alias("conv_id"), count).where("n_convs > 0")
    root = root.select(*[zero().alias(c) for c in NODE], "conv_id", "n_convs", *[F.lit(None).cast("long").alias(p) for p in ("p1", "p2")], zero().alias("size"))
    found = stored(found.unionByName(root), "nodes")
    kids = found.where("depth > 0").groupBy((F.col("depth") - 1).alias("depth"), F.col("p1").alias("x1"), F.col("p2").alias("x2")).agg(F.count("*").alias("n_children"))
    tree = found.join(kids, NODE, "left").join(ends(digests, lengths), NODE, "left")
    tree = tree.withColumns({"n_children": F.coalesce("n_children", zero()), "ends_sha256": F.coalesce("ends_sha256", F.sha2(F.lit(""), 256)), "own": (F.col("n_convs") - 1) * F.col("size")})
    tree = stored(tree.drop("size"), "tree")
    top = tree.where("depth = 0").select("conv_id").first()
    parents = tree.where("depth > 0 AND n_children > 0").select((F.col("depth") + 1).alias("depth"), F.col("x1").alias("p1"), F.col("x2").alias("p2"), F.col("conv_id").alias("parent_conv_id"))
    below = tree.where("depth > 1").join(parents, ["depth", "p1", "p2"])
    upper = tree.where("depth <= 1").withColumn("parent_conv_id", F.when(F.col("depth") == 1, F.lit(top["conv_id"] if top else None).cast("long")))  # the root's children need no search
    return stored(below.unionByName(upper).drop(*NODE[1:], "p1", "p2"), "edges")


def rollup(tree: DataFrame) -> DataFrame:
    """conv_id, depth, n_leaves, saved_tokens: sums over each node's subtree, in rounds that double the step."""
    state = tree.select("conv_id", "depth", F.col("parent_conv_id").alias("up"), (F.col("n_children") == 0).cast("long").alias("n_leaves"), F.col("own").alias("saved_tokens"))
    reach = tree.agg(F.max("depth"), F.min(F.when(F.col("depth") == 0, F.col("conv_id")))).first()
    deepest, top = reach[0] or 0, reach[1]
    for k in range(int(deepest).bit_length()):
        step = 1 << k
        given = state.where(F.col("depth") >= step).groupBy(F.col("up").alias("conv_id"), (F.col("depth") - step).alias("depth")).agg(F.sum("n_leaves").alias("leaves"), F.sum("saved_tokens").alias("saved"))
        near = state.where(F.col("depth") <= 2 * step).withColumn("up", F.when(F.col("depth") == 2 * step, F.lit(top).cast("long")))
        mids = state.where(F.col("depth") > step).select(F.col("conv_id").alias("up"), (F.col("depth") + step).alias("depth"), F.col("up").alias("next"))
        jumped = state.where(F.col("depth") > 2 * step).join(mids, ["up", "depth"]).withColumn("up", F.col("next")).drop("next")
        summed = near.unionByName(jumped).join(given, ["conv_id", "depth"], "left")
        plus = lambda a, b: (F.col(a) + F.coalesce(b, zero())).alias(a)
        state = stored(summed.select("conv_id", "depth", "up", plus("n_leaves", "leaves"), plus("saved_tokens", "saved")), f"round-{k}")
    return state.select("conv_id", "depth", "n_leaves", "saved_tokens")


def prefix_trie(conversations: DataFrame, heads: int = 6, family: int = 100) -> DataFrame:
    """The nodes of the trie of rebuilt conversations; ``heads=1`` takes them as they are."""
    bounded_batches(conversations.sparkSession)
    dealt, spans = numbered(conversations)
    turns, lengths = rebuilt(dealt, spans, heads, family)
    tree = nodes(digested(turns), lengths)
    rows = tree.join(rollup(tree), ["conv_id", "depth"])
    return rows.select("conv_id", "depth", "parent_conv_id", "n_convs", "n_children", "n_leaves", "saved_tokens", "ends_sha256")
