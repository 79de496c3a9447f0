"""Small documents with every awkward case, and brute-force versions of shingle sets."""

import random

SCHEMA = "doc_id long, text string, lang string, source string, n_chars long"


def prose(rng, n, vocabulary=400, sentence=12):
    words = [f"w{rng.randrange(vocabulary)}x" for _ in range(n)]
    return " ".join(w + ("." if k % sentence == sentence - 1 else "") for k, w in enumerate(words))


def documents(seed=1, n=60):
    """Prose, exact and near copies, and null, empty, blank, short, long and repeated ones."""
    rng = random.Random(seed)
    texts = [prose(rng, rng.randrange(20, 300)) for _ in range(n)]
    texts += texts[:5] * 2
    for t in texts[:8]:
        w = t.split(" ")
        for k in range(0, len(w), 25):
            w[k] = "changed"
        texts.append(" ".join(w))
    texts += [None, "", " \n\t ", "one", "One", "a b c d", prose(rng, 6000), "ÉTÉ straße 日本 😀", "12 34 !!"]
    return [(k, t, ("en", "fr", None)[k % 3], "src", len(t or "")) for k, t in enumerate(texts)]


def frame(spark, rows=None):
    return spark.createDataFrame(documents() if rows is None else rows, SCHEMA)


def words(text):
    return (text or "").encode().lower().split()


def shingles(text, width=5):
    w = words(text)
    return {tuple(w[k : k + width]) for k in range(len(w) - width + 1)} if len(w) >= width else ({tuple(w)} if w else set())


def components(rows, num=75, den=100):
    sets = {d: shingles(t) for d, t, *_ in rows}
    parent = {d: d for d in sets}

    def root(x):
        while parent[x] != x:
            x = parent[x]
        return x

    ids = sorted(sets)
    for k, a in enumerate(ids):
        for b in ids[k + 1 :]:
            both = len(sets[a] & sets[b])
            if both and den * both >= num * len(sets[a] | sets[b]):
                x, y = sorted((root(a), root(b)))
                parent[y] = x
    return {d: (len(s), root(d)) for d, s in sets.items()}
