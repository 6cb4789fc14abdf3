import hashlib
import math
import random
import zlib
from collections import Counter

import numpy as np
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F
from tokenizers import Tokenizer

from sieveline.llm import bpe, decontaminate, jaccard, lm, quality, tokenfile
from sieveline.llm.queries import vocabulary

from .helpers import empty_documents, odd_documents, prose, shingle_components

BYTES = bpe.ByteBpe(bpe.read_spec(vocabulary("byte_bpe_50k.json")))
LIBRARY = Tokenizer.from_file(vocabulary("byte_bpe_50k.json"))


@settings(max_examples=300, deadline=None)
@given(st.text(alphabet=st.sampled_from(list(" \n\tab'slltre12é漢🙂.,!-= \u0085\x1c")), max_size=60))
def test_bpe_equals_the_library(text):
    want = LIBRARY.encode(text, add_special_tokens=False).ids
    assert BYTES.encode_batch([text]) == [want]
    joined, n, ids, decoded = BYTES.digest_batch([text])[0]
    assert (n, ids) == (len(want), hashlib.sha256(",".join(map(str, want)).encode()).hexdigest())
    assert decoded == hashlib.sha256(LIBRARY.decode(want, skip_special_tokens=False).encode()).hexdigest()
    assert BYTES.decode(want) == text


def test_bpe_small_caches_change_nothing():
    small = bpe.ByteBpe(bpe.read_spec(vocabulary("byte_bpe_50k.json")), cached=3, cached_chars=40)
    texts = [prose(random.Random(i), 30) for i in range(20)] + ["a <|endoftext|> b\n <|endoftext|>c"]
    for t in texts:
        assert small.encode_batch([t])[0] == LIBRARY.encode(t, add_special_tokens=False).ids == [int(x) for x in small.digest_batch([t])[0][0].split(b",")]


def test_bpe_on_odd_rows(spark):
    docs = odd_documents(spark)
    got = bpe.digests(docs, vocabulary("byte_bpe_50k.json"), with_ids=True).collect()
    assert len(got) == docs.count()
    by = {r["doc_id"]: r for r in got}
    assert by[4]["n_tokens"] == 0 and by[4]["ids_sha256"] == hashlib.sha256(b"").hexdigest()
    assert by[10]["ids"] == LIBRARY.encode("Ünïcödé 漢字 🙂 <|endoftext|> it's 12,345.67", add_special_tokens=False).ids
    assert bpe.digests(empty_documents(spark), vocabulary("byte_bpe_50k.json")).count() == 0
    plain = {r["doc_id"]: r for r in bpe.encode(docs, vocabulary("byte_bpe_50k.json")).collect()}
    assert plain[10]["ids"] == by[10]["ids"] and plain[10]["decoded"].startswith("Ünïcödé")


@settings(max_examples=200, deadline=None)
@given(st.lists(st.integers(0, 65535), max_size=200), st.booleans())
def test_planes_round_trip(ids, bits):
    a = np.array(ids, np.uint64)
    assert (tokenfile.from_planes(tokenfile.to_planes(a, 2, bits), len(a), 2, bits) == a).all()


@pytest.mark.parametrize("bits", [False, True])
def test_token_files(spark, tmp_path, bits):
    docs = odd_documents(spark).where("doc_id is not null").dropDuplicates(["doc_id"])
    folder = str(tmp_path / "tokens")
    manifest = tokenfile.write(docs, folder, vocabulary("word_bpe_49k.json"), files=3, bits=bits)
    got = {r["doc_id"]: r for r in tokenfile.read(spark, folder, manifest).collect()}
    library, start = Tokenizer.from_file(vocabulary("word_bpe_49k.json")), 0
    for d in sorted(docs.select("doc_id", "text").collect()):
        ids = library.encode(d["text"] or "", add_special_tokens=False).ids + [2]
        assert (got[d["doc_id"]]["start"], got[d["doc_id"]]["n_tokens"], got[d["doc_id"]]["ids_crc32"]) == (start, len(ids), zlib.crc32(np.array(ids, "<u4").tobytes()))
        start += len(ids)
    import pyarrow.fs

    name = manifest.orderBy("file").first()["name"]
    with pyarrow.fs.LocalFileSystem().open_input_file(f"{folder}/{name}") as f:
        reader = tokenfile.PlaneReader(f)
        assert all((reader.document(k) == ids).all() for k, (_, ids) in enumerate(reader.documents()))


def test_token_files_of_nothing_and_of_nulls(spark):
    assert tokenfile.write_and_read(empty_documents(spark), vocabulary("word_bpe_49k.json")).count() == 0
    got = tokenfile.write_and_read(odd_documents(spark), vocabulary("word_bpe_49k.json")).collect()
    assert len(got) == odd_documents(spark).count() and min(got, key=lambda r: r["start"])["doc_id"] is None


@settings(max_examples=200, deadline=None)
@given(st.text(alphabet=st.sampled_from(list(" \n'sStTréÉß漢İK12.,!<|>́")), max_size=40))
def test_cached_encoder_equals_the_library(text):
    encoder = tokenfile.encoder(bpe.read_spec(vocabulary("word_bpe_49k.json")))
    assert encoder.batch([text])[0].tolist() == encoder.library.encode(text, add_special_tokens=False).ids


def test_lm_counts_and_probabilities(spark):
    docs = odd_documents(spark)
    got = lm.score_documents(docs, groups=3).collect()
    rows = docs.select("doc_id", "text").collect()
    assert len(got) == len(rows)
    tokens = lambda t: (t or "").encode().lower().split() + [b" "]
    held = lambda d: d is None or zlib.crc32(str(d).encode()) % 10 == 0
    train = Counter(w for r in rows if not held(r["doc_id"]) for w in tokens(r["text"]))
    n, v = sum(train.values()), len(train)
    want = {r["doc_id"]: tokens(r["text"]) for r in rows}
    for r in got:
        words = want[r["doc_id"]]
        assert (r["held_out"], r["n_tokens"], r["n_known"], r["train_tokens"]) == (held(r["doc_id"]), len(words), sum(train[w] > 0 for w in words), n)
        assert math.isclose(r["base_score"], sum(math.log10((train[w] + 0.1) / (n + 0.1 * (v + 1))) for w in words), rel_tol=1e-9)
        assert r["score"] < 0 and math.isfinite(r["score"])


def test_lm_beats_its_base_and_sums_to_one(spark):
    rng = random.Random(3)
    words = [prose(rng, 1) for _ in range(40)]
    chain = lambda: " ".join(words[(i * 7 + rng.choice((0, 0, 0, 1))) % 40] for i in range(60))
    docs = spark.createDataFrame([(i, chain()) for i in range(200)], "doc_id long, text string")
    got = lm.score_documents(docs, groups=2).where("held_out").collect()
    assert sum(r["score"] for r in got) > sum(r["base_score"] for r in got)


class PlainModel:
    """Deleted interpolation in plain dictionaries: the counts, the fold's expectation-maximisation, the mixture."""

    def __init__(self, rows):
        tokens = lambda t: (t or "").encode().lower().split() + [b" "]
        rest = lambda d: 0 if d is None else zlib.crc32(str(d).encode()) % 10
        self.one, self.two, fold_one, fold_two, held = Counter(), Counter(), Counter(), Counter(), []
        for d, text in rows:
            seq = tokens(text)
            pairs = list(zip([b" ", *seq[:-1]], seq))
            if rest(d):
                self.one.update(seq)
                self.two.update(pairs)
            if rest(d) == 1:
                fold_one.update(seq)
                fold_two.update(pairs)
                held += pairs
        self.n, self.v = sum(self.one.values()), len(self.one)
        left, even = max(1, self.n - len(held)), [0.3, 0.6, 0.1]
        self.weights = {b: even for b in range(lm.BUCKETS)}
        for _ in range(12 if held else 0):
            got = {}
            for a, b in held:
                context, c2, c1 = self.one[a] - fold_one[a], self.two[a, b] - fold_two[a, b], self.one[b] - fold_one[b]
                k = self.bucket(context if c2 or context else context)
                p = [w * x for w, x in zip(self.weights[k], (c2 / context if c2 else 0.0, c1 / left, 1 / (self.v + 1)))]
                for i in range(3):
                    got.setdefault(k, [0.0] * 3)[i] += p[i] / sum(p)
            before, self.weights = self.weights, {b: even for b in range(lm.BUCKETS)}
            for k, s in got.items():
                s = [max(x, 1e-6 * sum(s)) for x in s]
                self.weights[k] = [x / sum(s) for x in s]
            if max(abs(x - y) for k in before for x, y in zip(before[k], self.weights[k])) < 1e-4:
                break

    @staticmethod
    def bucket(context):
        return min(int(math.log2(context + 1)), lm.BUCKETS - 1)

    def p(self, a, b):
        context = self.one[a]
        w = self.weights[self.bucket(context)]
        return w[0] * (self.two[a, b] / context if context else 0.0) + w[1] * self.one[b] / self.n + w[2] / (self.v + 1)

    def score(self, text):
        seq = (text or "").encode().lower().split() + [b" "]
        return sum(math.log10(self.p(a, b)) for a, b in zip([b" ", *seq[:-1]], seq))


@pytest.mark.parametrize("kind", ["chains", "odd rows"])
def test_lm_against_plain_dictionaries(spark, kind):
    rng = random.Random(3)
    words = [prose(rng, 1) for _ in range(40)]
    chain = lambda: " ".join(words[(i * 7 + rng.choice((0, 0, 0, 1))) % 40] for i in range(rng.randint(1, 60)))
    docs = odd_documents(spark) if kind == "odd rows" else spark.createDataFrame([(i, chain()) for i in range(200)], "doc_id long, text string")
    rows = [(r["doc_id"], r["text"]) for r in docs.collect()]
    model = PlainModel(rows)
    got = sorted((str(r["doc_id"]), r["score"]) for r in lm.score_documents(docs, groups=3).collect())
    want = sorted((str(d), model.score(t)) for d, t in rows)
    assert [a for a, _ in got] == [a for a, _ in want]
    assert all(math.isclose(x, y, rel_tol=1e-6) for (_, x), (_, y) in zip(got, want))
    for a in [b" ", *list(model.one)[:20]]:  # after any word that training has, all words and one unseen have probability 1
        assert math.isclose(sum(model.p(a, b) for b in [*model.one, b"\x00unseen"]), 1.0, rel_tol=1e-9)


def test_lm_of_nothing(spark):
    assert lm.score_documents(empty_documents(spark)).count() == 0


@settings(max_examples=100, deadline=None)
@given(st.lists(st.integers(0, 10**6), max_size=50))
def test_count_packing(counts):
    a = np.array(counts, np.int64)
    assert (lm.unpack(lm.pack(a), len(a)) == a).all()


def test_quality(spark):
    rng = random.Random(1)
    good, bad = lambda: prose(rng, 40), lambda: " ".join(w.upper() + "!!" for w in prose(rng, 40).split())
    docs = spark.createDataFrame([(i, good() if i % 3 else bad(), "x", i % 2) for i in range(400)] + [(None, None, None, None), (900, "", "x", 1)], "doc_id long, text string, lang string, score int")
    labels = spark.createDataFrame([(i, int(i % 3 > 0), 0) for i in range(400)] + [(None, 1, 0), (5000, 0, 0), (3, None, None)], "doc_id long, quality int, toxic int")
    got = quality.classify(docs, labels).collect()
    assert len(got) == 402 and all(0 <= r["score"] <= 1 for r in got)
    held = [r for r in got if r["held_out"]]
    assert held and all(r["predicted"] == int(r["doc_id"] % 3 > 0) for r in held if r["doc_id"] < 400)
    kept = quality.keep_good(docs, labels)
    assert kept.columns == docs.columns and {r["doc_id"] for r in kept.collect()} == {r["doc_id"] for r in got if r["predicted"]}
    assert quality.classify(docs, labels.limit(0)).select(F.max("score")).first()[0] == 0.5
    assert quality.classify(docs.limit(0), labels).count() == 0


def test_ftrl_against_a_plain_loop(spark):
    """The weights that the operator learns equal those of the textbook updates, one feature at a time."""
    rng = random.Random(7)
    texts = [prose(rng, rng.randint(0, 30)) for _ in range(60)]
    docs = spark.createDataFrame([(i, t) for i, t in enumerate(texts)] + [(3, texts[3])] * 5, "doc_id long, text string").repartition(3)
    labels = spark.createDataFrame([(i, i % 2) for i in range(60)], "doc_id long, quality int")
    got = quality.fit(docs, labels, bits=10, epochs=2)
    order = [r["doc_id"] for r in spark.range(60).withColumnRenamed("id", "doc_id").orderBy(F.xxhash64("doc_id", F.lit(9)), "doc_id").collect()]
    hasher, z, n = quality.Hasher(10), [0.0] * 1025, [0.0] * 1025
    alpha, beta, l1, l2 = 1.0, 1.0, 0.02, 0.02
    weight = lambda i: 0.0 if abs(z[i]) <= l1 else -(z[i] - math.copysign(l1, z[i])) / ((beta + math.sqrt(n[i])) / alpha + l2)
    for _ in range(2):
        for d in order:
            feats = Counter(hasher.features(texts[d]).tolist())
            total = sum(feats.values())
            x = {i: k * quality.SCALE / total for i, k in feats.items()} | {1024: 1.0}
            w = {i: weight(i) for i in x}
            p = 1 / (1 + math.exp(-max(-30, min(30, sum(w[i] * x[i] for i in x)))))
            for i in x:
                g = (p - d % 2) * x[i]
                z[i] += g - (math.sqrt(n[i] + g * g) - math.sqrt(n[i])) / alpha * w[i]
                n[i] += g * g
    assert np.allclose(got, [weight(i) for i in range(1025)], rtol=1e-4, atol=1e-5) and np.count_nonzero(got) > 100
    scores = {r["doc_id"]: r["score"] for r in quality.score(docs, got).collect()}
    for d, t in enumerate(texts):
        feats = hasher.features(t).tolist()
        m = float(got[1024]) + sum(quality.SCALE * float(got[i]) / len(feats) for i in feats)
        assert math.isclose(scores[d], 1 / (1 + math.exp(-m)), rel_tol=1e-5)


def test_jaccard_on_odd_rows(spark):
    docs = odd_documents(spark)
    got = jaccard.near_duplicates(docs).collect()
    assert len(got) == docs.count()
    rows = [(r["doc_id"], r["text"]) for r in docs.collect() if r["doc_id"] is not None]
    want = shingle_components(rows, 4, 85, 100)
    assert {r["doc_id"]: (r["n_shingles"], r["component_id"]) for r in got if r["doc_id"] is not None} == want
    assert [r["component_id"] for r in got if r["doc_id"] is None] == [None]
    assert jaccard.near_duplicates(empty_documents(spark)).count() == 0


@pytest.mark.parametrize("words,num,den", [(4, 85, 100), (5, 8, 10)])
def test_jaccard_against_all_pairs(spark, words, num, den):
    """Chains of edits around the threshold, of all sizes, with shared passages: no link is lost."""
    rng = random.Random(words)
    passage, rows = prose(rng, 50), []
    for size in (4, 5, 6, 7, 8, 9, 11, 14, 17, 18, 19, 25, 40, 60, 90, 170, 300):
        for _ in range(3):
            text = prose(rng, size).split()
            for _ in range(5):
                rows.append((len(rows), " ".join(text)))
                for _ in range(rng.randint(1, max(1, size // 40))):
                    text[rng.randrange(len(text))] = prose(rng, 1)
                if rng.random() < 0.4:
                    text = text[: -max(1, size // 20)] or text
    rows += [(len(rows) + i, passage + " " + prose(rng, 40)) for i in range(30)]
    docs = spark.createDataFrame(rows, "doc_id long, text string").repartition(4)
    want = shingle_components(rows, words, num, den)
    got = {r["doc_id"]: (r["n_shingles"], r["component_id"]) for r in jaccard.near_duplicates(docs, words, num, den).collect()}
    assert got == want and any(c != d for d, (_, c) in want.items())
    kept = {r["doc_id"] for r in jaccard.keep_first(docs, words, num, den).collect()}
    assert kept == {c for _, c in want.values()}


def test_sketches_are_complete():
    """Two sets at the threshold share a key, at any size."""
    rng = np.random.default_rng(0)
    for n in list(range(1, 61)) + [100, 161, 162, 500, 1500, 4000]:
        for num, den in ((85, 100), (8, 10), (9, 10), (1, 1)):
            big = np.unique(rng.integers(0, 1 << 63, n * den // num + 2).astype(np.uint64))
            a, b = big[:n], big[: n * den // num]
            assert set(jaccard.sketch_keys(a, big[:0], num, den)) & set(jaccard.sketch_keys(b, np.sort(big[: n // 2]) * 0, num, den)) or (a.tolist() == b.tolist() and len(a) < jaccard.first_size(num, den))


@pytest.mark.parametrize("words,num,den", [(5, 8, 10), (4, 85, 100), (4, 1, 1)])
def test_short_texts_link_to_those_of_a_word_more(spark, words, num, den):
    rng, rows = random.Random(words), []
    for size in (7, 8, 9, 10, 11):
        for before in (False, True):
            text = prose(rng, size)
            rows += [(len(rows), text), (len(rows) + 1, f"{prose(rng, 1)} {text}" if before else f"{text} {prose(rng, 1)}")]
    text = prose(rng, 12).split()
    rows += [(len(rows) + i, " ".join(text[:n])) for i, n in enumerate((8, 9, 10, 11, 12))]  # a chain
    want = shingle_components(rows, words, num, den)
    assert (len({c for _, c in want.values()}) < len(rows)) == (num < den)
    got = jaccard.near_duplicates(spark.createDataFrame(rows, "doc_id long, text string").repartition(3), words, num, den).collect()
    assert {r["doc_id"]: (r["n_shingles"], r["component_id"]) for r in got} == want


def test_small_sketches_are_complete():
    rng = np.random.default_rng(2)
    none = np.zeros(0, np.uint64)
    for num, den in ((8, 10), (85, 100), (9, 10)):
        for n in range(jaccard.first_size(num, den), 40):
            for _ in range(20):
                big = np.unique(rng.integers(0, 1 << 63, n * den // num).astype(np.uint64))
                small = np.sort(rng.permutation(big)[:n])
                assert set(jaccard.sketch_keys(small, none, num, den)) & set(jaccard.sketch_keys(big, none, num, den))


def test_parity_sketch_bounds_the_difference():
    rng = np.random.default_rng(1)
    for n in (5, 50, 400):
        pool = rng.integers(0, 1 << 63, n + 30).astype(np.uint64)
        a, b = np.sort(pool[:n]), np.sort(pool[20 : n + 20])
        apart = sum(bin((x ^ y) & (1 << 64) - 1).count("1") for x, y in zip(jaccard.parity_sketch(a), jaccard.parity_sketch(b), strict=True))
        assert apart <= len(set(a.tolist()) ^ set(b.tolist()))


def test_decontamination(spark):
    rng = random.Random(2)
    items = [(i, prose(rng, rng.randint(12, 40))) for i in range(30)] + [(90, "two words"), (91, None), (92, ""), (93, None)]
    changed = items[3][1].split()
    changed[-1] = "other"
    half = " ".join(items[4][1].split()[: len(items[4][1].split()) // 2])
    rows = [(1, prose(rng, 50) + " " + items[0][1].upper() + "\n" + prose(rng, 50)), (2, " ".join(changed)), (3, prose(rng, 20) + " " + half + " " + prose(rng, 20)), (4, prose(rng, 300)), (5, "say two words now"), (6, None), (7, ""), (8, items[5][1] + " " + items[6][1]), (None, items[7][1])]
    docs, bench = spark.createDataFrame(rows, "doc_id long, text string"), spark.createDataFrame(items, "item_id long, text string")
    got = {(r["doc_id"], r["item_id"]) for r in decontaminate.find(docs, bench).collect()}
    want = {(1, 0), (5, 90), (8, 5), (8, 6), (None, 7)} | ({(2, 3)} if len(changed) >= 14 else set())
    assert got == want
    assert got == {(r["doc_id"], r["item_id"]) for r in decontaminate.find(docs, bench, items=7).collect()}
    assert {r["doc_id"] for r in decontaminate.drop_matches(docs, bench).collect()} == {r[0] for r in rows} - {d for d, _ in got}
    odd = odd_documents(spark)
    assert decontaminate.find(odd, bench).count() == 0 and decontaminate.drop_matches(odd, bench).count() == odd.count()
    assert decontaminate.find(docs, bench.limit(0)).count() == 0 and decontaminate.find(empty_documents(spark), bench).count() == 0


def test_decontamination_against_exhaustive_windows():
    """All windows of the item's size, by exact similarity alone: what the SimHash radius misses is measured."""
    rng, words = random.Random(31), 5
    missed = found = 0
    for trial in range(120):
        item = prose(rng, rng.randint(8, 60)).split()
        near = list(item)
        for _ in range(rng.randint(0, max(1, len(item) // 25))):  # about the threshold
            near[rng.choice((0, 1, 2, -1, -2, -3, rng.randrange(len(item))))] = prose(rng, 1)
        text = prose(rng, rng.randint(0, 40)).split() + near + prose(rng, rng.randint(0, 40)).split()
        grams = lambda s: Counter(tuple(s[i : i + words]) for i in range(len(s) - words + 1))
        want = False
        for i in range(max(1, len(text) - len(item) + 1)):
            a, b = grams(text[i : i + len(item)]), grams(item)
            want |= sum((a & b).values()) >= 0.8 * sum((a | b).values())
        got = bool(decontaminate.Items([(1, " ".join(item))], words).matches(" ".join(text), 0.8))
        assert want or not got  # nothing is found that the exact similarity denies
        found, missed = found + want, missed + (want and not got)
    assert found > 40 and missed == 0


def test_multi_index_finds_all_within_the_radius():
    rng = np.random.default_rng(4)
    prints = rng.integers(0, 1 << 63, 40).astype(np.uint64)
    probes = np.array([int(p) ^ sum(1 << int(k) for k in rng.choice(64, rng.integers(0, 25), replace=False)) for p in np.repeat(prints, 5)], np.uint64)
    w, i, apart = decontaminate.HammingIndex(prints).within(probes)
    want = {(a, b) for a, x in enumerate(probes) for b, y in enumerate(prints) if bin(int(x) ^ int(y)).count("1") <= decontaminate.RADIUS}
    assert set(zip(w.tolist(), i.tolist(), strict=True)) == want


def test_crowded_buckets_lose_no_link(spark, monkeypatch):
    """Copies that are near a text but not near each other, in buckets dealt out as pairs of blocks."""
    monkeypatch.setattr(jaccard, "CROWD", 5)
    rng = random.Random(8)
    base, rows = prose(rng, 150).split(), []
    for i in range(60):
        text = list(base)
        for _ in range(rng.randint(0, 5)):
            text[rng.randrange(150)] = prose(rng, 1)
        rows.append((1000 - i, " ".join(text)))
    docs = spark.createDataFrame(rows, "doc_id long, text string").repartition(5)
    want = shingle_components(rows, 4, 85, 100)
    assert {r["doc_id"]: (r["n_shingles"], r["component_id"]) for r in jaccard.near_duplicates(docs).collect()} == want
    assert len({c for _, c in want.values()}) > 1


def test_close_pairs_against_all_pairs():
    rng = np.random.default_rng(6)
    n = 400
    key = np.sort(rng.choice([1, 1, 1, 2, 3, 4, 5], n))
    nodes, roots, sizes = np.arange(n) * 3 + 1, rng.integers(0, 6, n), rng.integers(20, 40, n)
    sketches = np.repeat(rng.integers(0, 1 << 62, (1, 4)), n, axis=0).astype(np.uint64) ^ (np.uint64(1) << rng.integers(0, 60, (n, 4)).astype(np.uint64))
    side = rng.integers(1, 3, n) * (key > 2)
    found = jaccard.Buckets(key, key, side, nodes, roots, sizes, sketches, key[:, None], 85, 100).pairs()
    a, b = found[:, 0], found[:, 1]
    want = set()
    for i in range(n):
        for j in range(i + 1, n):
            if key[i] == key[j] and roots[i] != roots[j] and (side[i] == 0 or side[i] != side[j]) and 100 * min(sizes[i], sizes[j]) >= 85 * max(sizes[i], sizes[j]):
                if sum(bin(int(x ^ y)).count("1") for x, y in zip(sketches[i], sketches[j], strict=True)) <= 15 * (sizes[i] + sizes[j]) // 185:
                    want.add((nodes[i], nodes[j]))
    assert set(zip(a.tolist(), b.tolist(), strict=True)) == {(int(x), int(y)) for x, y in want} and want


def test_sketches_tell_apart_sets_of_hundreds_of_shingles():
    rng = np.random.default_rng(2)
    for n in (300, 500, 700):
        sketches = np.array([jaccard.parity_sketch(np.sort(rng.integers(0, 1 << 63, n).astype(np.uint64))) for _ in range(80)]).view(np.uint64)
        i, j = np.triu_indices(80, 1)
        apart = np.bitwise_count(sketches[i] ^ sketches[j]).sum(axis=1, dtype=np.int64)
        assert (apart > 2 * (2 * n) // 18).mean() > 0.999


def test_a_pair_leaves_few_of_the_buckets_it_shares(spark):
    # classes 0 to 29 share 40 crowded buckets, each has 30 smaller-numbered ones with one other class, and bucket 7 is of two alone
    rows = [(1000 + k, n) for k in range(40) for n in range(30)] + [(100 + 30 * (n // 2) + k, n) for n in range(30) for k in range(15)] + [(7, 3), (7, 31)]
    crowds = {}
    for key, _ in rows:
        crowds[key] = crowds.get(key, 0) + 1
    members = spark.createDataFrame([(k, n, n, crowds[k]) for k, n in rows], "key long, node long, root long, crowd long")
    classes = spark.createDataFrame([(n, 100, [0] * jaccard.WORDS) for n in range(32)], "node long, n long, sketch array<long>")
    left = []
    found = {(r["a"], r["b"]) for r in jaccard.unlinked_pairs(members, classes, 8, 10, 16).collect()}
    assert found == {(a, b) for a in range(30) for b in range(a + 1, 30)} | {(3, 31)}
    listed = {n: [k for _, k in sorted((-crowds[k], k) for k, m in rows if m == n)][: jaccard.KNOWN] for n in range(32)}
    pad = [(1 << 63) - 1] * jaccard.KNOWN
    for key in sorted(crowds):  # each bucket as if it were alone in its task
        nodes = np.array([n for k, n in rows if k == key])
        ones, zeros = np.full(len(nodes), key), np.zeros(len(nodes), np.int64)
        keys = np.array([(listed[n] + pad)[: jaccard.KNOWN] for n in nodes])
        left += jaccard.Buckets(ones, ones, zeros, nodes, nodes, zeros + 100, np.zeros((len(nodes), jaccard.WORDS), np.uint64), keys, 8, 10).pairs().tolist()
    assert {tuple(p) for p in left} == found and len(left) == len(found)


def test_one_row_of_each_group_stays(spark):
    """Repeated rows, rows without an id, ids of several texts, and columns named like those of the operator."""
    rng = random.Random(12)
    base, other, lone = prose(rng, 60), prose(rng, 60), prose(rng, 40)
    near = base.split()
    near[30] = "changed"
    rows = [(4, other), (4, other), (4, lone), (2, base), (9, " ".join(near)), (None, base), (None, prose(rng, 30)), (7, ""), (7, ""), (8, None), (None, None), (None, None)]
    rows += [rows[6]]
    docs = spark.createDataFrame([(d, t, 1, 2, 3, 4) for d, t in rows], "doc_id long, text string, kept_id long, node long, print long, KEY int").repartition(3)
    got = sorted([(r["doc_id"], r["text"]) for r in jaccard.keep_first(docs).collect()], key=str)
    assert got == sorted([(4, other), (4, lone), (2, base), (None, rows[6][1]), (7, ""), (8, None), (None, None)], key=str)
    assert jaccard.keep_first(docs).columns == docs.columns
    assert jaccard.keep_first(docs.where("doc_id = 9")).count() == 1 and jaccard.keep_first(docs.limit(0)).count() == 0
    before = spark.conf.get("spark.sql.optimizer.runtime.bloomFilter.applicationSideScanSizeThreshold")
    assert before != "0"


def test_a_worker_keeps_things_for_one_operator():
    import gc

    from sieveline.llm.common import held, uncollected

    held("a")["x"] = 1
    assert held("a") == {"x": 1} and held("b") == {} and held("a") == {}
    assert gc.isenabled()
    with uncollected():
        assert not gc.isenabled()
    assert gc.isenabled()


def test_clusters_need_a_shared_folder():
    from sieveline.llm.common import shared_dir

    class Conf:
        def get(self, name, default=None):
            return None

    class Context:
        master = "spark://host:7077"

        def getCheckpointDir(self):  # noqa: N802
            return None

    session = type("Session", (), {"conf": Conf(), "sparkContext": Context()})()
    with pytest.raises(ValueError, match="spark.checkpoint.dir"):
        shared_dir(session, "x")
