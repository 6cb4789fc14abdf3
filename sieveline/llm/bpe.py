"""Operator 1: byte-level BPE encoding and decoding by prefix-sharing trie traversal.

The BPE code of a byte string is fixed by the last token of each of its prefixes: the
code of ``w`` is the code of ``w`` without its last token, followed by that token, and
exactly one token that ends ``w`` stays apart from the last token before it. So the
distinct words of a batch go into a trie; a depth-first walk finds the last token of
each node from the states of its ancestors; a prefix that many words share is encoded
once. An automaton of the vocabulary tells which tokens end at a node.

Defined results: null or empty text has no tokens; a row without an id keeps it null;
repeated rows give repeated results; an empty table gives an empty result; columns other
than the id and the text are ignored. The marker of the vocabulary's added token inside
a text becomes that token.
"""

from __future__ import annotations

import hashlib
import json
from collections.abc import Iterable, Iterator

import ahocorasick
import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import DataFrame
from pyspark.sql import types as T

from .common import bounded_batches, held, only, release, uncollected

#: Fixed value: the public pre-tokenisation pattern of byte-level BPE; \s is the property White_Space.
PATTERN = r"'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\p{White_Space}\p{L}\p{N}]+|\p{White_Space}+(?!\P{White_Space})|\p{White_Space}+"
NEVER = 1 << 60


def byte_alphabet() -> dict[str, int]:
    """Character by which a vocabulary file writes a byte -> that byte."""
    plain = [b for b in range(256) if 33 <= b <= 126 or 161 <= b <= 172 or 174 <= b <= 255]
    rest = [b for b in range(256) if b not in set(plain)]
    return {chr(b): b for b in plain} | {chr(256 + i): b for i, b in enumerate(rest)}


class ByteBpe:
    """Encoder and decoder for the JSON text of a byte-level BPE tokenizer."""

    def __init__(self, spec: str, cached: int = 300_000, cached_chars: int = 20_000_000):
        spec = json.loads(spec)
        model, alphabet = spec["model"], byte_alphabet()
        self.bytes_of: dict[int, bytes] = {i: bytes(alphabet[c] for c in t) for t, i in model["vocab"].items() if all(c in alphabet for c in t)}
        self.added = {a["content"]: a["id"] for a in spec["added_tokens"]}
        for text, i in self.added.items():
            self.bytes_of[i] = text.encode()
        self.ids = {b: i for i, b in self.bytes_of.items() if i not in self.added.values()}
        self.rank: dict[tuple[int, int], int] = {}
        self.halves: dict[int, tuple[int, int]] = {}
        self.born: dict[int, int] = {}
        for r, pair in enumerate(model["merges"]):
            a, b = pair.split(" ") if isinstance(pair, str) else pair
            left, right, whole = model["vocab"][a], model["vocab"][b], model["vocab"][a + b]
            self.rank.setdefault((left, right), r)
            if whole not in self.halves:
                self.halves[whole], self.born[whole] = (left, right), r
        self.endings = ahocorasick.Automaton()
        for token, i in self.ids.items():
            self.endings.add_word(token.decode("latin-1"), (len(token), i))
        if self.ids:
            self.endings.make_automaton()
        self.words = regex.compile(PATTERN)
        self.split_added = regex.compile("(" + "|".join(map(regex.escape, sorted(self.added, key=len, reverse=True))) + ")") if self.added else None
        self.odd_space = regex.compile(r" (?=\p{White_Space}|$)")
        self.cached, self.cached_chars, self.borders, self.held = cached, cached_chars, max(100_000, 4 * cached // 3), 0
        self.open: dict[int, bool] = {}  # known borders: left token shifted by 24 bits, right token
        # caches of two generations: when the young one is full it becomes the old one, which recurring entries leave again
        self.codes: dict[str, tuple[int, ...]] = {}
        self.old_codes: dict[str, tuple[int, ...]] = {}
        self.chunks: dict[str, tuple[bytes, int, bytes] | None] = {}
        self.old_chunks: dict[str, tuple[bytes, int, bytes] | None] = {}
        self.digits = {i: b"%d" % i for i in self.bytes_of}

    def stays_apart(self, left: int, right: int) -> bool:
        """Whether BPE, which makes ``left`` and ``right``, never merges across the border between them.

        Walks back in time: at each moment one part on the right edge of ``left`` and one on
        the left edge of ``right`` touch the border. They would have been merged if their
        merge comes before each of them was itself merged away; of equal merges the leftmost
        comes first.
        """
        if (known := self.open.get(left << 24 | right)) is not None:
            return known
        a, b, a_ends, b_ends, apart = left, right, NEVER, NEVER, True
        while True:
            merge = self.rank.get((a, b), NEVER)
            if merge < a_ends and merge <= b_ends and merge < NEVER:
                apart = False
                break
            a_born, b_born = self.born.get(a, -1), self.born.get(b, -1)
            if a_born < 0 and b_born < 0:
                break
            if a_born > b_born:
                a_ends, a = a_born, self.halves[a][1]
            else:
                b_ends, b = b_born, self.halves[b][0]
        if len(self.open) > self.borders:
            self.open.clear()
        self.open[left << 24 | right] = apart
        return apart

    def encode_words(self, words: Iterable[bytes]) -> dict[bytes, tuple[int, ...]]:
        """Codes of the distinct words, through a trie that is filled in depth-first order."""
        apart, known, endings = self.stays_apart, self.open.get, self.endings.iter
        last, back = [-1], [0]  # of each node: the last token of its prefix; the node where that token starts
        path, before, out = [0], b"", {}
        for word in sorted(set(words)):
            shared, n = 0, min(len(word), len(before))
            while shared < n and word[shared] == before[shared]:
                shared += 1
            del path[shared + 1 :]
            done = shared  # length of the prefix whose state is known
            for at, (size, token) in endings(word.decode("latin-1")):  # of the tokens that end at a place the longest comes first
                if at < done:
                    continue
                node = path[at + 1 - size]
                if size <= at:  # not the first token of the word
                    before_it = last[node]
                    stays = known(before_it << 24 | token)
                    if stays is None:
                        stays = apart(before_it, token)
                    if not stays:
                        continue
                path.append(len(last))
                last.append(token)
                back.append(node)
                done = at + 1
            code, node = [], path[len(word)]
            while node:
                code.append(last[node])
                node = back[node]
            out[word], before = tuple(reversed(code)), word
        return out

    def _learn(self, pieces: set[str]) -> None:
        """Cache the codes of words, those of the new ones all through one trie."""
        if len(self.codes) > self.cached // 4:  # most parts are a word, which the other cache knows
            self.old_codes, self.codes = self.codes, {}
        codes, old, new = self.codes, self.old_codes, {}
        for p in pieces:
            if p not in codes:
                if (code := old.get(p)) is not None:
                    codes[p] = code
                else:
                    new[p.encode()] = p
        self.held += sum(map(len, new))
        for word, code in self.encode_words(new).items():
            codes[new[word]] = code

    def _pieces(self, text: str) -> list[str | int]:
        if self.split_added is None or not any(a in text for a in self.added):
            return self.words.findall(text)
        return [w for part in self.split_added.split(text) if part for w in ([self.added[part]] if part in self.added else self.words.findall(part))]

    def encode_batch(self, texts: list[str]) -> list[list[int]]:
        """Token ids of whole texts."""
        cut = [self._pieces(t) for t in texts]
        self._learn({p for c in cut for p in c if isinstance(p, str)})
        codes = self.codes
        return [[i for p in c for i in ((p,) if isinstance(p, int) else codes[p])] for c in cut]

    def decode(self, ids: Iterable[int]) -> str:
        """The text of ids; bytes that are not UTF-8 become U+FFFD."""
        return b"".join(map(self.bytes_of.__getitem__, ids)).decode("utf-8", "replace")

    # A text is cut at single spaces that a visible character follows: borders between words in
    # any case. What stands between them recurs, so the digits of its ids and its bytes are kept, by
    # the part without its space; the first part, which has none, is known by a key with a space.

    def _keys(self, text: str) -> list[str] | None:
        if any(a in text for a in self.added):
            return None
        parts = text.split(" ")
        if parts[0]:
            parts[0] = "\0 " + parts[0]
        else:
            del parts[0]
        return parts

    def digest_batch(self, texts: list[str]) -> list[tuple[bytes, int, str, str]]:
        """For each text: the joined decimal ids, count of tokens, their sha256, sha256 of the decoded text."""
        cut = [self._keys(t) if t else [] for t in texts]
        if len(self.chunks) > self.cached // 2 or self.held > self.cached_chars // 2:
            self.old_chunks, self.chunks, self.held = self.chunks, {}, 0
            self.old_codes, self.codes = self.codes, {}
        chunks, old, pieces, find = self.chunks, self.old_chunks, {}, self.words.findall
        for p in set().union(*filter(None, cut)).difference(chunks):
            if (chunk := old.get(p)) is not None:
                chunks[p] = chunk
            else:
                part = p[2:] if p[:2] == "\0 " else " " + p
                if self.odd_space.match(part):  # white space after the space: the text is not to be cut here
                    chunks[p] = None
                else:
                    pieces[p] = find(part)
        self._learn({w for ws in pieces.values() for w in ws})
        codes, digits, octets = self.codes, self.digits.__getitem__, self.bytes_of.__getitem__
        for p, ws in pieces.items():
            ids = codes[ws[0]] if len(ws) == 1 else [i for w in ws for i in codes[w]]
            chunks[p] = (b",".join(map(digits, ids)), len(ids), b"".join(map(octets, ids)))
        found = [c if c is None else list(map(chunks.__getitem__, c)) for c in cut]
        found = [None if c is None or None in c else c for c in found]
        odd = [t for t, c in zip(texts, found, strict=True) if c is None]
        odd_ids = iter(self.encode_batch(odd) if odd else [])
        out = []
        for c in found:
            if c is None:
                ids = next(odd_ids)
                joined, n, decoded = b",".join(map(digits, ids)), len(ids), b"".join(map(octets, ids))
            else:
                texts_of, sizes, octets_of = zip(*c, strict=True) if c else ((), (), ())
                joined, n, decoded = b",".join(texts_of), sum(sizes), b"".join(octets_of)
            try:
                decoded.decode()
            except UnicodeDecodeError:
                decoded = decoded.decode("utf-8", "replace").encode()
            out.append((joined, n, hashlib.sha256(joined).hexdigest(), hashlib.sha256(decoded).hexdigest()))
        return out


def loaded(spec: str, cached: int = 300_000) -> ByteBpe:
    """The tokenizer of ``spec``, built once in each Python worker."""
    kept = held("bpe")
    if (key := (hash(spec), cached)) not in kept:
        kept.clear()
        kept[key] = ByteBpe(spec, cached)
    return kept[key]


def read_spec(path: str) -> str:
    """The JSON text of a tokenizer; the driver reads it, the executors get it by broadcast (a few MB, fixed)."""
    with open(path, encoding="utf-8") as f:
        return f.read()


def encode(docs: DataFrame, vocabulary: str, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Id, ``ids`` (array of int) and ``decoded`` of each document."""
    spec = docs.sparkSession.sparkContext.broadcast(read_spec(vocabulary))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        bpe = loaded(spec.value)
        for b in batches:
            ids = bpe.encode_batch([t or "" for t in b.column(1).to_pylist()])
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array(ids, pa.list_(pa.int32())), pa.array([bpe.decode(i) for i in ids], pa.string())], names=["id", "ids", "decoded"])

    bounded_batches(docs.sparkSession)
    kind = docs.schema[id_col].dataType
    out = only(docs, id_col, text_col).mapInArrow(run, T.StructType([T.StructField("id", kind), T.StructField("ids", T.ArrayType(T.IntegerType())), T.StructField("decoded", T.StringType())]))
    return out.withColumnRenamed("id", id_col)


def digests(docs: DataFrame, vocabulary: str, id_col: str = "doc_id", text_col: str = "text", with_ids: bool = False, cached: int = 300_000) -> DataFrame:
    """Id, ``n_tokens``, ``ids_sha256`` and ``decoded_sha256`` of each document, from the codes that :func:`encode` gives; ``ids`` on demand."""
    spec = docs.sparkSession.sparkContext.broadcast(read_spec(vocabulary))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        bpe = loaded(spec.value, cached)
        for b in batches:
            with uncollected():
                got = bpe.digest_batch([t or "" for t in b.column(1).to_pylist()])
            joined, n, ids, decoded = zip(*got, strict=True) if got else ((), (), (), ())
            cols = [b.column(0), pa.array(n, pa.int64()), pa.array(ids, pa.string()), pa.array(decoded, pa.string())]
            if with_ids:
                values = [np.array(j.split(b",") if j else [], np.int32) for j in joined]
                offsets = np.concatenate([[0], np.cumsum([len(v) for v in values])]).astype(np.int32)
                cols.append(pa.ListArray.from_arrays(pa.array(offsets), pa.array(np.concatenate([*values, np.zeros(0, np.int32)]))))
            yield pa.RecordBatch.from_arrays(cols, names=names)
        release()

    bounded_batches(docs.sparkSession)
    names = ["id", "n_tokens", "ids_sha256", "decoded_sha256", *["ids"] * with_ids]
    kind = docs.schema[id_col].dataType.simpleString()
    out = only(docs, id_col, text_col).mapInArrow(run, f"id {kind}, n_tokens long, ids_sha256 string, decoded_sha256 string" + ", ids array<int>" * with_ids)
    return out.withColumnRenamed("id", id_col)


def encode_with_digests(docs: DataFrame, vocabulary: str) -> DataFrame:
    """What :func:`digests` gives, and the token ids; with small caches and batches, as other stages' workers and a full heap are beside it."""
    out = digests(docs, vocabulary, with_ids=True, cached=10_000)
    bounded_batches(docs.sparkSession, 100)
    return out
