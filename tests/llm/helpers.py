"""Tables of odd rows that every operator must take."""

import random

DOCS = "doc_id long, text string, lang string, source string, n_chars long, n long, node long, gid int, score double"
LONG = "wörd " * 60_000


def word(rng):
    return "".join(rng.choice("abcdefghij") for _ in range(rng.randint(2, 7)))


def prose(rng, n):
    return " ".join(word(rng) for _ in range(n))


def odd_documents(spark):
    """Nulls in every column, empty, blank and very long texts, repeated rows, ties, and columns with clashing names."""
    rng = random.Random(5)
    base = prose(rng, 120)
    near = base.split()
    near[60] = "changed"
    rows = [
        (1, base, "en", "s", len(base), 1, 1, 1, 0.5),
        (2, base, "en", "s", len(base), 1, 1, 1, 0.5),
        (2, base, "en", "s", len(base), 1, 1, 1, 0.5),
        (3, " ".join(near), None, None, None, None, None, None, None),
        (4, None, "en", "s", 0, 1, 1, 1, 0.5),
        (5, "", "en", "s", 0, 1, 1, 1, 0.5),
        (6, " \n\t ", "en", "s", 4, 1, 1, 1, 0.5),
        (7, LONG, "en", "s", len(LONG), 1, 1, 1, 0.5),
        (None, "no id at all", None, None, None, None, None, None, None),
        (8, "one two", "en", "s", 7, 1, 1, 1, 0.5),
        (9, "ONE two", "en", "s", 7, 1, 1, 1, 0.5),
        (10, "Ünïcödé 漢字 🙂 <|endoftext|> it's 12,345.67", "en", "s", 7, 1, 1, 1, 0.5),
    ] + [(100 + i, prose(rng, rng.randint(5, 60)), "en", "s", 1, 1, 1, 1, 0.5) for i in range(30)]
    return spark.createDataFrame(rows, DOCS).repartition(3)


def empty_documents(spark):
    return spark.createDataFrame([], DOCS)


def shingle_components(docs, k, num, den):
    """doc_id -> (set size, component), by brute force over all pairs."""
    sets = {}
    for d, text in docs:
        w = (text or "").encode().lower().split()
        sets[d] = {tuple(w[i : i + k]) for i in range(len(w) - k + 1)} or ({tuple(w)} if w else set())
    root = {d: d for d in sets}

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    ids = sorted(sets)
    for i, a in enumerate(ids):
        for b in ids[:i]:
            both = len(sets[a] & sets[b])
            if both and den * both >= num * (len(sets[a]) + len(sets[b]) - both):
                x, y = find(a), find(b)
                root[max(x, y)] = min(x, y)
    return {d: (len(sets[d]), find(d)) for d in ids}
