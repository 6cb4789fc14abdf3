"""Operator 4: language-model scoring by deleted interpolation.

A token's probability mixes the maximum-likelihood estimates of its bigram and of its unigram
with a uniform floor. The mixture weights depend on the bucket (power of two) of the context's
frequency; expectation-maximisation learns them on a deleted fold: the counts of the fold's
tokens under estimates that leave the fold out.

How it runs. Documents are dealt into groups by hash. Each group counts its own distinct
n-grams and sends them, sorted and cut into key ranges, as arrays: a frequent n-gram costs a
row a group, however often it occurs. Each key range adds the counts up and sends back, in the
order asked, what each group needs. A group then holds the counts of all its own n-grams and
scores its documents. A group sends nothing to a range in which it has no n-gram, so there are
never more such rows than n-grams to be counted. Nothing is broadcast but some 100 weights, and a task's memory is
bounded by a group or a key range; by default a group is at most 32 MB of the table's files. Counts are exact for all documents; n-grams are known by 64-bit hashes.

Defined results: a null or empty text is one end token; a row without an id is scored but not
learned from; repeated rows are learned from and scored each; an empty table gives an empty
result; a table without training documents scores by the uniform floor; columns other than
doc_id and text are ignored.
"""

from __future__ import annotations

import math

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import bounded_batches, id_crc, only, spread, stored

END = b" "  # no token holds white space
BUCKETS = 24
M1, M2, M3 = np.uint64(0x9E3779B97F4A7C15), np.uint64(0xC2B2AE3D27D4EB4F), np.uint64(0x165667B19E3779F9)


def pair_keys(first: np.ndarray, second: np.ndarray) -> np.ndarray:
    """64-bit keys of bigrams from the keys of their words."""
    k = (first * M1 ^ (second + M3) * M2) * M3
    k ^= k >> np.uint64(29)
    return k * M1


def tokenised(texts: list[str | None]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Words' keys; token sequence as indices into them, each text closed by its end token; length of each text."""
    index: dict[bytes, int] = {END: 0}
    learn = index.setdefault
    out, lengths = [], []
    for text in texts:
        words = (text or "").encode().lower().split()
        out.append(np.array([learn(w, len(index)) for w in words] + [0], np.int64))
        lengths.append(len(words) + 1)
    keys = np.fromiter((xxhash.xxh64_intdigest(w) for w in index), np.uint64, len(index))
    return keys, np.concatenate(out) if out else np.zeros(0, np.int64), np.array(lengths, np.int64)


def bigrams(keys: np.ndarray, tokens: np.ndarray) -> np.ndarray:
    """The key of each token's bigram; a text begins after an end token."""
    previous = np.concatenate([np.zeros(1, np.int64), tokens[:-1]])
    return pair_keys(keys[previous], keys[tokens])


def counted(keys: np.ndarray, trained: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Sorted distinct keys and how often each occurs where ``trained`` holds."""
    of_training = np.sort(keys[trained])
    starts = np.flatnonzero(np.concatenate([[True], of_training[1:] != of_training[:-1]])) if len(of_training) else np.zeros(0, np.int64)
    distinct, counts = of_training[starts], np.diff(np.append(starts, len(of_training)))
    if trained.all():
        return distinct, counts
    every = np.sort(np.concatenate([distinct, keys[~trained]]))
    every = every[np.concatenate([[True], every[1:] != every[:-1]])]
    out = np.zeros(len(every), np.int64)
    out[np.searchsorted(every, distinct)] = counts
    return every, out


def pack(counts: np.ndarray) -> bytes:
    """Counts as bytes; those from 255 on follow in full."""
    return np.minimum(counts, 255).astype(np.uint8).tobytes() + counts[counts >= 255].astype(np.uint64).tobytes()


def unpack(data: bytes, n: int) -> np.ndarray:
    out = np.frombuffer(data, np.uint8, n).astype(np.int64)
    out[out == 255] = np.frombuffer(data[n:], np.uint64)
    return out


def key_range(keys: np.ndarray, ranges: int) -> np.ndarray:
    """Index of the key range; ascends with the key."""
    return ((keys >> np.uint64(40)) * np.uint64(ranges) >> np.uint64(24)).astype(np.int64)


def group_keys(texts: list[str | None], trained: np.ndarray) -> tuple:
    """What both passes over a group need: tokens, lengths, word keys, bigram keys and the sorted counts of both."""
    keys, tokens, lengths = tokenised(texts)
    by_token = np.repeat(trained, lengths)
    pairs = bigrams(keys, tokens)
    return keys, tokens, lengths, pairs, counted(keys[tokens], by_token), counted(pairs, by_token)


ASKED = "range int, gid int, n1 int, keys1 binary, counts1 binary, n2 int, keys2 binary, counts2 binary"
ANSWER = "gid int, range int, n1 int, n2 int, all1 binary, all2 binary, fold1 binary, fold2 binary, tokens long, distinct long"


def _table(ddl: str, rows: list[tuple]) -> pa.Table:
    kinds = {"int": pa.int32(), "long": pa.int64(), "binary": pa.binary()}
    fields = [f.split(" ") for f in ddl.split(", ")]
    cols = list(zip(*rows, strict=True)) if rows else [()] * len(fields)
    return pa.table([pa.array(c, kinds[k]) for c, (_, k) in zip(cols, fields, strict=True)], names=[n for n, _ in fields])


def _grouped(docs: DataFrame, folds: int, groups: int) -> DataFrame:
    """gid, doc_id, text, rest: documents of the deleted fold are in groups of their own, numbered from ``groups``."""
    rest = F.coalesce(F.pmod(id_crc(F.col("doc_id")), F.lit(folds)), F.lit(0)).cast("int")
    spread = F.xxhash64("doc_id", "text")  # texts that share an id are spread too
    gid = F.when(rest == 1, groups + F.pmod(spread, F.lit(max(1, groups // (folds - 1))))).otherwise(F.pmod(spread, F.lit(groups)))
    return only(docs, "doc_id", "text").select(gid.cast("int").alias("gid"), "doc_id", "text", rest.alias("rest"))


def _counts(rows: DataFrame, groups: int, ranges: int) -> DataFrame:
    """For each group and key range the whole training counts of the group's n-grams, and those of the fold for the fold's groups."""

    def ask(group: pa.Table) -> pa.Table:
        gid = group["gid"][0].as_py()
        trained = np.array(group["rest"].to_pylist()) != 0
        *_, (k1, c1), (k2, c2) = group_keys(group["text"].to_pylist(), trained)
        cut1 = np.searchsorted(key_range(k1, ranges), np.arange(ranges + 1))
        cut2 = np.searchsorted(key_range(k2, ranges), np.arange(ranges + 1))
        out = []
        for r in np.flatnonzero(np.diff(cut1) + np.diff(cut2)).tolist():
            a, b, c, d = cut1[r], cut1[r + 1], cut2[r], cut2[r + 1]
            out.append((r, gid, b - a, k1[a:b].tobytes(), pack(c1[a:b]), d - c, k2[c:d].tobytes(), pack(c2[c:d])))
        return _table(ASKED, out)

    def answer(group: pa.Table) -> pa.Table:
        at, gids = group["range"][0].as_py(), group["gid"].to_pylist()
        parts, seen = {}, (0, 0)
        for kind in ("1", "2"):
            sizes = group[f"n{kind}"].to_pylist()
            keys = np.frombuffer(b"".join(group[f"keys{kind}"].to_pylist()), np.uint64)
            counts = np.concatenate([unpack(d, n) for d, n in zip(group[f"counts{kind}"].to_pylist(), sizes, strict=True)])
            of_fold = np.repeat(np.array(gids) >= groups, sizes)
            order = np.argsort(keys)
            ordered = keys[order]
            new = np.concatenate([[True], ordered[1:] != ordered[:-1]]) if len(keys) else np.zeros(0, bool)
            which = np.empty(len(keys), np.int64)
            which[order] = np.cumsum(new) - 1
            n = int(new.sum())
            whole = np.bincount(which, weights=counts, minlength=n).astype(np.int64)
            fold = np.bincount(which[of_fold], weights=counts[of_fold], minlength=n).astype(np.int64)
            if kind == "1":
                seen = int(whole.sum()), int((whole > 0).sum())
            ends = np.cumsum(sizes)
            parts[kind] = [(pack(whole[which[e - s : e]]), pack(fold[which[e - s : e]]) if g >= groups else b"") for g, s, e in zip(gids, sizes, ends, strict=True)]
        n1, n2 = group["n1"].to_pylist(), group["n2"].to_pylist()
        out = [(g, at, n1[i], n2[i], parts["1"][i][0], parts["2"][i][0], parts["1"][i][1], parts["2"][i][1], 0, 0) for i, g in enumerate(gids)]
        out.append((-1, at, 0, 0, b"", b"", b"", b"", *seen))
        return _table(ANSWER, out)

    asked = rows.groupBy("gid").applyInArrow(ask, ASKED)
    return asked.groupBy("range").applyInArrow(answer, ANSWER)


def _aligned(answers: pa.Table, kind: str, name: str) -> np.ndarray:
    """Counts of a group's sorted distinct n-grams, from the answers of all key ranges."""
    got = sorted(zip(answers["range"].to_pylist(), answers[f"n{kind}"].to_pylist(), answers[f"{name}{kind}"].to_pylist(), strict=True))
    return np.concatenate([unpack(d, n) for _, n, d in got]) if got else np.zeros(0, np.int64)


def _context_bucket(context: np.ndarray) -> np.ndarray:
    return np.minimum(np.log2(context + 1.0).astype(np.int64), BUCKETS - 1)


COMBINATIONS = "bucket int, c2 long, context long, c1 long, n long"


def learn_weights(rows: DataFrame, counts: DataFrame, tokens: int, distinct: int, groups: int, rounds: int = 12) -> list[list[float]]:
    """Mixture weights (bigram, unigram, floor) of each context bucket by expectation-maximisation."""
    even = [[0.3, 0.6, 0.1] for _ in range(BUCKETS)]

    def deleted(group: pa.Table, answers: pa.Table) -> pa.Table:
        if not group.num_rows:
            return _table(COMBINATIONS, [])
        keys, toks, _, pairs, (k1, _), (k2, _) = group_keys(group["text"].to_pylist(), np.ones(group.num_rows, bool))
        left1, left2 = _aligned(answers, "1", "all") - _aligned(answers, "1", "fold"), _aligned(answers, "2", "all") - _aligned(answers, "2", "fold")
        unigram = left1[np.searchsorted(k1, keys)]
        c1, context, c2 = unigram[toks], unigram[np.concatenate([[0], toks[:-1]])], left2[np.searchsorted(k2, pairs)]
        bucket = _context_bucket(context)
        context = np.where(c2 > 0, context, 0)  # without a bigram the context decides the bucket alone
        order = np.lexsort((c1, context, c2, bucket))
        table = np.stack([bucket, c2, context, c1])[:, order]
        new = np.flatnonzero(np.concatenate([[True], (table[:, 1:] != table[:, :-1]).any(axis=0)]))
        return pa.table([pa.array(table[0, new], pa.int32()), *(pa.array(table[i, new], pa.int64()) for i in (1, 2, 3)), pa.array(np.diff(np.append(new, table.shape[1])), pa.int64())], names=["bucket", "c2", "context", "c1", "n"])

    fold = rows.where(F.col("gid") >= groups).groupBy("gid").cogroup(counts.where(F.col("gid") >= groups).groupBy("gid")).applyInArrow(deleted, COMBINATIONS)
    seen = stored(fold.groupBy("bucket", "c2", "context", "c1").agg(F.sum("n").alias("n")), "combinations")
    kept = counts.where("gid = -1").agg(F.sum("tokens")).first()[0] or 0
    held = seen.agg(F.sum("n")).first()[0] or 0
    rest = max(1, kept - held)
    weights = even
    if not held:
        return weights
    for _ in range(rounds):
        w = [F.element_at(F.array(*[F.lit(float(b[i])) for b in weights]), F.col("bucket") + 1) for i in range(3)]
        p = [w[0] * F.when(F.col("c2") > 0, F.col("c2") / F.col("context")).otherwise(0.0), w[1] * F.col("c1") / F.lit(float(rest)), w[2] / F.lit(float(distinct + 1))]
        whole = p[0] + p[1] + p[2]
        got = seen.groupBy("bucket").agg(*[F.sum(F.col("n") * x / whole).alias(f"s{i}") for i, x in enumerate(p)]).collect()  # a row a bucket
        before, weights = weights, [list(b) for b in even]
        for r in got:
            s = [max(r[f"s{i}"], 1e-6 * (r["s0"] + r["s1"] + r["s2"])) for i in range(3)]
            weights[r["bucket"]] = [x / sum(s) for x in s]
        if max(abs(a - b) for x, y in zip(before, weights, strict=True) for a, b in zip(x, y, strict=True)) < 1e-4:
            break
    return weights


def score_documents(docs: DataFrame, folds: int = 10, groups: int | None = None) -> DataFrame:
    """doc_id, held_out, n_tokens, n_known, train_tokens, base_score and score of each row.

    Documents whose crc32(doc_id) mod ``folds`` is 0 are held out; those of remainder 1 are the
    fold that the mixture weights are learned on.
    """
    spark = docs.sparkSession
    bounded_batches(spark)
    groups = groups or spread(docs)
    rows = _grouped(docs, folds, groups)
    counts = stored(_counts(rows, groups, groups), "counts")
    total = counts.where("gid = -1").agg(F.sum("tokens"), F.sum("distinct")).first()
    tokens, distinct = int(total[0] or 0), int(total[1] or 0)
    weights = learn_weights(rows, counts, tokens, distinct, groups)
    id_kind = docs.schema["doc_id"].dataType

    def judge(group: pa.Table, answers: pa.Table) -> pa.Table:
        ids, rest = group["doc_id"], np.array(group["rest"].to_pylist(), np.int64)
        keys, toks, lengths, pairs, (k1, _), (k2, _) = group_keys(group["text"].to_pylist(), rest != 0)
        all1, all2 = _aligned(answers, "1", "all"), _aligned(answers, "2", "all")
        unigram = all1[np.searchsorted(k1, keys)]
        c1, context, c2 = unigram[toks], unigram[np.concatenate([[0], toks[:-1]])], all2[np.searchsorted(k2, pairs)]
        w = np.array(weights)[_context_bucket(context)]
        p = w[:, 0] * np.divide(c2, context, out=np.zeros(len(c2)), where=context > 0) + w[:, 1] * (c1 / max(1, tokens)) + w[:, 2] / (distinct + 1)
        base = np.log10((c1 + 0.1) / (tokens + 0.1 * (distinct + 1)))
        starts = np.concatenate([[0], np.cumsum(lengths)[:-1]])
        add = lambda x: np.add.reduceat(x, starts)
        return pa.table(
            [ids.cast(pa.int64()) if pa.types.is_integer(ids.type) else ids, pa.array(rest == 0), pa.array(lengths), pa.array(add((c1 > 0).astype(np.int64))), pa.array(np.full(len(rest), tokens, np.int64)), pa.array(add(base)), pa.array(add(np.log10(p)))],
            names=["doc_id", "held_out", "n_tokens", "n_known", "train_tokens", "base_score", "score"],
        )

    kind = "long" if isinstance(id_kind, (T.LongType, T.IntegerType, T.ShortType)) else id_kind.simpleString()
    scored = rows.groupBy("gid").cogroup(counts.where("gid >= 0").groupBy("gid")).applyInArrow(judge, f"doc_id {kind}, held_out boolean, n_tokens long, n_known long, train_tokens long, base_score double, score double")
    return scored


def perplexity(score: float, n_tokens: int) -> float:
    return math.pow(10, -score / max(1, n_tokens))
