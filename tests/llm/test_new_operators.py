import hashlib
import math
import random
import zlib

import pytest
from pyspark.sql import functions as F

from sieveline.llm import conversations, importance, rules
from sieveline.llm.common import setting

from .helpers import empty_documents, odd_documents, prose, word

SPACE = " \t\n\x0b\x0c\r"


def words(text):
    out, at = [], ""
    for c in text or "":
        if c in SPACE:
            out, at = [*out, at] if at else out, ""
        else:
            at += c
    return [*out, at] if at else out


def counts(text):
    w = words(text)
    seen = {}
    for i in range(len(w) - 4):
        seen.setdefault(tuple(w[i : i + 5]), []).append(i)
    again = {p + k for at in seen.values() if len(at) > 1 for p in at for k in range(5)}
    lines = [x for x in (text or "").split("\n") if words(x)]
    return len(w), sum(map(len, w)), sum((text or "").count(c) for c in "#*$%&|<>"), len(lines), len(lines) - len(set(lines)), len(again)


def small_edge(v):
    rest = max(v.bit_length() - 7, 0)
    return v >> rest << rest


def plain_rules(rows):
    """Verdicts of (lang, source, text) by plain loops."""
    measured = [(lang or "", source or "", counts(text)) for lang, source, text in rows]
    failed = [c[0] < 10 or 100 * c[5] > 20 * c[0] for _, _, c in measured]
    share = lambda c: {"word_length": 1000 * c[1] // max(c[0], 1), "symbols": 1000 * c[2] // max(c[0], 1), "dup_lines": 1000 * c[4] // max(c[3], 1), "repeats": 1000 * c[5] // max(c[0], 1)}
    groups = {}
    for (lang, source, c), bad in zip(measured, failed, strict=True):
        if not bad:
            for m, v in share(c).items():
                groups.setdefault((lang, source, m), []).append(small_edge(v))
                groups.setdefault((lang, m), []).append(small_edge(v))
    quart = lambda v: (len(v), *[min(x for x in v if 4 * sum(y <= x for y in v) >= q * len(v)) for q in (1, 3)])
    groups = {k: quart(v) for k, v in groups.items()}
    kept = []
    for (lang, source, c), bad in zip(measured, failed, strict=True):
        ok = not bad
        for m, v in share(c).items() if ok else ():
            (n, *own), (_, *whole) = groups[lang, source, m], groups[lang, m]
            low, high = [(n * a + 100 * b) / (n + 100) for a, b in zip(own, whole, strict=True)]
            width = 3 * max(high - low, rules.SHARES[m][2]) * (1 + math.sqrt(100 / c[0]))
            ok &= not (v > high + width or m == "word_length" and v < low - width)
        kept.append(ok)
    return [(c[0], c[1], c[2], c[4], c[5], bad, ok) for (_, _, c), bad, ok in zip(measured, failed, kept, strict=True)]


def test_rules_against_plain_loops(spark):
    rng = random.Random(3)
    rows = []
    for i in range(500):
        text = prose(rng, rng.randint(1, 80))
        if i % 9 == 0:
            text = " ".join(x + "$%&" for x in text.split())
        elif i % 10 == 1:
            text = "\n".join([text] * 3)
        elif i % 11 == 2:
            text = " ".join(word(rng) * 9 for _ in range(40))
        elif i % 12 == 3:
            text = text + " " + " ".join(text.split()[:8])
        rows.append((rng.choice(["en", "de", None]), rng.choice(["a", "b", "c", None, ""]), text))
    rows += [("en", "a", None), ("en", "a", ""), (None, None, " \n"), ("en", "a", "one two three four five " * 3), ("xx", "alone", prose(rng, 40)), ("en", "a", "wörd " * 70_000)]
    docs = spark.createDataFrame([(i, *r, 1, 2) for i, r in enumerate(rows)], "doc_id long, lang string, source string, text string, at long, failed long").repartition(4)
    got = {r["doc_id"]: (r["n_words"], r["word_chars"], r["n_symbols"], r["n_dup_lines"], r["n_repeat_words"], r["base_failed"], r["kept"]) for r in rules.judge(docs).collect()}
    want = plain_rules(rows)
    assert [got[i] for i in range(len(rows))] == want
    assert sum(not bad and not ok for *_, bad, ok in want) > 20 and sum(ok for *_, ok in want) > 200
    left = rules.keep(docs)
    assert left.columns == docs.columns and {r["doc_id"] for r in left.collect()} == {i for i, w in enumerate(want) if w[-1]}


def test_rules_on_odd_rows(spark):
    docs = odd_documents(spark)
    assert rules.judge(docs).count() == docs.count()
    assert rules.judge(empty_documents(spark)).count() == rules.keep(empty_documents(spark)).count() == 0


@pytest.mark.parametrize("high", [1, 2])
def test_resampling_against_plain_loops(spark, high):
    rng = random.Random(4)
    rows = [(i, prose(rng, rng.randint(1, 60))) for i in range(400)] + [(7, None), (None, prose(rng, 30)), (None, prose(rng, 31)), (500, ""), (501, "Ünï-12 ÀB x_y " * 9)]
    rows += [(600, prose(rng, 25))] * 300 + [(601, "Is IT"), (602, "word " * 60_000)]
    target = [(1, prose(rng, 50)), (2, None), (3, rows[5][1])]
    docs = spark.createDataFrame([(d, t, 1, 2, 3) for d, t in rows], "doc_id long, text string, rank long, score long, above long").repartition(4)
    aims = spark.createDataFrame(target, "item_id long, text string")

    def features(text):
        lower = "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in text or "")
        w = "".join(c if c in "0123456789abcdefghijklmnopqrstuvwxyz" or ord(c) > 127 else " " for c in lower).split(" ")
        w = [x for x in w if x]
        return len(w), [zlib.crc32(" ".join(w[i : i + n]).encode()) % 500 for n in range(1, high + 1) for i in range(len(w) - n + 1)]

    def gain(b):
        return math.floor(1000 * math.log((aim.count(b) + 1) * (len(corpus) + 500) / ((have[b] + 1) * (len(aim) + 500))))

    found = [(d, *features(t)) for d, t in rows]
    corpus, aim = [b for *_, f in found for b in f], [b for _, t in target for b in features(t)[1]]
    have = [0] * 500
    for b in corpus:
        have[b] += 1
    gains = [gain(b) for b in range(500)]
    want = []
    for d, n, f in found:
        h = int(hashlib.sha256(f"2024:{'' if d is None else d}".encode()).hexdigest()[:8], 16)
        weight = sum(gains[b] for b in f) // len(f) if f else 0
        want.append((d, n, len(f), weight, weight + math.floor(-1000 * math.log(-math.log((h + 0.5) / 2**32)))))
    able = sorted((w for w in want if w[1] >= 20), key=lambda w: (-w[4], w[0] is None, w[0] or 0, w[2], w[1], w[3]))
    drawn = able[: 30 * len(able) // 100]
    ranks = sorted([(*w, i + 1) for i, w in enumerate(drawn)], key=repr)
    got = [tuple(r) for r in importance.resample(docs, aims, 30, high=high, buckets=500).collect()]
    assert sorted((g[:5] for g in got), key=repr) == sorted(want, key=repr)
    assert sorted((g for g in got if g[5]), key=repr) == ranks
    kept = importance.draw(docs, aims, 30, high=high, buckets=500)
    assert kept.columns == docs.columns
    assert sorted((r["doc_id"] for r in kept.collect()), key=repr) == sorted((w[0] for w in drawn), key=repr)


def test_unfolding_and_odd_resampling(spark):
    rows = spark.createDataFrame([("a", 2, 5), ("b", 9001, 7), ("c", 4096, 1)], "k string, copies long, first long")
    got = importance.unfolded(rows, "copies", "first").groupBy("k").agg(F.min("first"), F.max("first"), F.countDistinct("first"), F.count("*")).collect()
    assert sorted(map(tuple, got)) == [("a", 5, 6, 2, 2), ("b", 7, 9007, 9001, 9001), ("c", 1, 4096, 4096, 4096)]
    docs, none = odd_documents(spark), empty_documents(spark)
    assert importance.resample(docs, none).count() == docs.count()
    assert importance.resample(none, docs).count() == importance.draw(none, docs).count() == 0
    assert importance.resample(docs, docs, min_words=10**9).where("rank IS NOT NULL").count() == 0


def plain_trie(rows, heads):
    by = {}
    for c, t, r, x in rows:
        if c is not None:
            by.setdefault(c, []).append((t is not None, t or 0, r or "", x or ""))
    own = {c: [(r, x) for *_, r, x in sorted(v)] for c, v in by.items()}
    built = {c: own.get(c - c % 100, [])[:h] + v[h:] for c, v in own.items() for h in [zlib.crc32(str(c).encode()) % heads]}
    root = {"m": [], "e": [], "k": {}, "t": 0}
    for c in sorted(built):
        n = root
        n["m"].append(c)
        for r, x in built[c]:
            n = n["k"].setdefault((r, x), {"m": [], "e": [], "k": {}, "t": len(x)})
            n["m"].append(c)
        n["e"].append(c)
    order, out = [(root, 0, None)] if built else [], []
    for n, d, _ in order:
        order += [(k, d + 1, n["m"][0]) for k in n["k"].values()]
    for n, d, p in reversed(order):
        n["l"] = sum(k["l"] for k in n["k"].values()) or 1
        n["s"] = (len(n["m"]) - 1) * n["t"] + sum(k["s"] for k in n["k"].values())
        out.append((n["m"][0], d, p, len(n["m"]), len(n["k"]), n["l"], n["s"], hashlib.sha256(",".join(map(str, n["e"])).encode()).hexdigest()))
    return sorted(out, key=repr)


def test_trie_against_a_plain_one(spark):
    rng, rows, seen = random.Random(1), [], set()
    for c in range(1000, 1300):
        for t in [None, *range(rng.randint(0, 7))]:
            if t is not None or rng.random() < 0.1:
                rows.append((c if rng.random() > 0.02 else None, t, rng.choice(["user", "assistant", None]), rng.choice(["a", "bb", "cé🙂", None, ""])))
    rows += [(7, t, "user", f"x{t % 3}") for t in range(700)] + [(2000 + i, t, "user", "hello") for i in range(1500) for t in range(2)] + [(8, 1, "user", "same")] * 40 + [(9, 0, "user", "long " * 100_000)]
    rows = [r for r in rows if r[:2] not in seen and (seen.add(r[:2]) or True) or r[0] == 8]
    frame = spark.createDataFrame([(*r, 1, 2) for r in rows], "conv_id long, turn long, role string, text string, depth long, up long").repartition(5)
    columns = ["conv_id", "depth", "parent_conv_id", "n_convs", "n_children", "n_leaves", "saved_tokens", "ends_sha256"]
    for heads in (6, 1):
        got = conversations.prefix_trie(frame, heads)
        assert got.columns == columns
        assert sorted(map(tuple, got.collect()), key=repr) == plain_trie(rows, heads)
    assert conversations.prefix_trie(frame.limit(0)).count() == 0


def test_turns_are_numbered_across_ranges(spark):
    frame = spark.range(3000).select(F.lit(5).cast("long").alias("conv_id"), (F.col("id") / 3).cast("long").alias("turn"), F.lit("user").alias("role"), F.col("id").cast("string").alias("text"))
    with setting(spark, "spark.sql.adaptive.coalescePartitions.enabled", "false"):
        dealt, spans = conversations.numbered(frame.repartition(7))
    assert spans.count() > 1
    places = dealt.join(spans, ["conv_id", "part"]).select((F.col("before") + F.col("at") - F.col("first") + 1).alias("p")).collect()
    assert sorted(r["p"] for r in places) == list(range(1, 3001))
