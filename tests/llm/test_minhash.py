import random

import pytest
from pyspark.sql import functions as F

from epochwright.llm import minhash


def find(parent, i):
    while parent[i] != i:
        i = parent[i]
    return i


def components_by_hand(texts):
    sets = [minhash.shingles(t) for t in texts]
    parent = list(range(len(texts)))
    pairs = [(i, j) for j in range(len(texts)) for i in range(j) if minhash.jaccard(sets[i], sets[j]) >= 0.8]
    for i, j in pairs:
        x, y = find(parent, i), find(parent, j)
        parent[max(x, y)] = min(x, y)
    return {i: find(parent, i) for i in range(len(texts))}, pairs


def variants(n, seed, words=600, least=6, most=16):
    """One text with single words changed: few pairs are as similar as 0.8, and the first text is near to few."""
    rng = random.Random(seed)
    base = [f"w{rng.randrange(3000)}" for _ in range(words)]
    out = []
    for i in range(n):
        own = list(base)
        for at in rng.sample(range(words), rng.randrange(least, most + 1)):
            own[at] = f"n{i}x{at}"
        out.append(" ".join(own))
    return out


def test_near_copies_against_brute_force(documents):
    rng = random.Random(4)
    texts = []
    for _ in range(60):  # each with copies in which single words differ: similarity about 0.6 to 0.97
        words = [f"w{rng.randrange(3000)}" for _ in range(200)]
        texts.append(" ".join(words))
        for edits in (1, 3, 4, 6, 9):
            copy = list(words)
            for _ in range(edits):
                copy[rng.randrange(200)] = f"n{rng.randrange(9000)}"
            texts.append(" ".join(copy))
    texts += ["", "  ", "one two", "One  two", "three four"]
    want, pairs = components_by_hand(texts)
    rows = minhash.near_duplicates(documents([(i, t) for i, t in enumerate(texts)])).collect()
    got = {r["doc_id"]: r["component_id"] for r in rows}
    assert len(rows) == len(texts) and len(pairs) > 100
    # all that brute force links, and nothing it does not
    assert got == want
    assert {r["doc_id"] for r in rows if r["kept"]} == set(want.values())


@pytest.mark.parametrize("n, blocks", [(16, 512), (300, 512), (300, 40)])
def test_groups_around_the_threshold_lose_no_link(documents, monkeypatch, n, blocks):
    monkeypatch.setattr(minhash.block_links, "__defaults__", (5, 0.8, blocks, 1 << 20))
    texts = variants(n, 11)
    want, pairs = components_by_hand(texts)
    rows = minhash.near_duplicates(documents([(i, t) for i, t in enumerate(texts)])).collect()
    assert {r["doc_id"]: r["component_id"] for r in rows} == want
    assert n < 300 or len(pairs) > 500


def test_copies_near_the_representative_are_compared_once(documents):
    words = [f"w{i}" for i in range(300)]
    rows = [(i, " ".join(words[:150] + [f"own{i}"] + words[150:])) for i in range(200)]
    docs = documents(rows)
    keys = [(str(i), minhash.band_keys(t).tolist()) for i, t in rows]
    members = minhash.key_members(docs.sparkSession.createDataFrame(keys, "node string, keys array<long>"))
    pairs = minhash.candidates(members)
    assert pairs.count() <= 200 * minhash.BANDS
    near = pairs.withColumn("s", F.lit(0.97))
    assert minhash.undecided(members, near, 0.8).isEmpty()
    assert {r["component_id"] for r in minhash.near_duplicates(docs).collect()} == {0}


def test_no_rows(nothing):
    assert minhash.near_duplicates(nothing).count() == 0
