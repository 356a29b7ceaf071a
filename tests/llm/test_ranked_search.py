import math
import random
import re
from collections import Counter

import numpy as np

from epochwright.llm import ranked_search

TERM = re.compile(r"[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+")
LOWER = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def words(text):
    return TERM.findall((text or "").translate(LOWER))


def brute(docs, items, k=10):
    counts = [(doc, Counter(words(text))) for doc, text in docs]
    n_docs = sum(1 for _, c in counts if c)
    n_terms = sum(c.total() for _, c in counts)
    df = Counter(t for _, c in counts for t in c)
    wanted = {}
    for item, text in items:
        wanted.setdefault(item, set()).update(words(text))
    out = []
    for item, terms in wanted.items():
        scores = []
        for doc, c in counts:
            if not c:
                continue
            m = 10 + 90 * c.total() * n_docs // n_terms
            score = sum(
                math.floor(1000 * math.log((2 * n_docs + 2) / (2 * df[t] + 1))) * (10**9 * c[t] // (1000 * c[t] + 8 * m))
                for t in terms
                if t in c
            )
            if score > 0:
                scores.append((-score, doc is None, doc or 0))
        for rank, (score, none, doc) in enumerate(sorted(scores)[:k], 1):
            out.append((item, rank, None if none else doc, -score))
    return sorted(out, key=str)


def search(spark, docs, items, **options):
    table = spark.createDataFrame(items, "item_id long, text string")
    found = ranked_search.search(docs, table, **options)
    assert sorted(found.columns) == ["doc_id", "item_id", "rank", "score"]
    return sorted(((r["item_id"], r["rank"], r["doc_id"], r["score"]) for r in found.collect()), key=str)


def corpus(rng, n):
    vocabulary = [f"w{i}" for i in range(200)] + ["Été", "été", "ß", "x1", "\U0001f600"]
    out = []
    for i in range(n):
        out.append((i, "-".join(rng.choice(vocabulary) for _ in range(rng.randrange(0, 60)))))
    return out


def test_against_brute_force_with_ties(spark, documents, monkeypatch):
    rng = random.Random(5)
    docs = corpus(rng, 400)
    docs += [(1000 + i, docs[7][1]) for i in range(40)]  # more ties than places
    items = [(i, " ".join(text.split("-")[:12])) for i, text in corpus(rng, 30)] + [(90, docs[7][1]), (90, "w1"), (91, ""), (None, "W3")]
    want = brute(docs, items)
    assert search(spark, documents(docs).repartition(5), items) == want
    monkeypatch.setattr(ranked_search, "PASS_TERMS", 40)  # several passes
    assert search(spark, documents(docs).coalesce(1), items) == want
    assert search(spark, documents(docs), items, k=3) == brute(docs, items, 3)


def test_small_tiles_add_up(monkeypatch):
    rng = np.random.default_rng(1)
    monkeypatch.setattr(ranked_search, "TERM_TILE", 3)
    held = [np.sort(rng.choice(20, 8, replace=False)) for _ in range(5)]
    weights = rng.integers(0, 45_000, 20).astype(float)
    tile = ranked_search._ItemTile(0, held, weights)
    impact = rng.integers(0, 1_000_000, (20, 6))
    impact[4] = 0
    term, place = np.nonzero(impact)
    present, column = np.unique(term, return_inverse=True)
    got = tile.scores(present, column, place, impact[term, place].astype(float), 6)
    want = [[sum(int(weights[t]) * int(impact[t, d]) for t in h) for d in range(6)] for h in held]
    assert got.tolist() == want


def test_odd_rows(spark, odd, nothing):
    items = [(1, "one WORD5 café"), (2, "nowhere"), (3, None)]
    docs = [(r["doc_id"], r["text"]) for r in odd.collect()]
    assert search(spark, odd, items) == brute(docs, items)
    assert search(spark, nothing, items) == []
    assert search(spark, odd, []) == []


def test_long_texts_are_read_whole(monkeypatch):
    monkeypatch.setattr(ranked_search, "_SLICE", 7)
    text = "Alpha beta-gamma  delta/epsilon zeta été"
    assert [t.decode() for some in ranked_search.terms(text) for t in some] == words(text)
