import random

import numpy as np
import pytest

from epochwright.llm import minhash, near_copies, simhash
from test_minhash import components_by_hand, variants


def near_texts(seed, originals=60):
    """Texts with copies in which single words differ: similarity about 0.6 to 0.97."""
    rng, texts = random.Random(seed), []
    for _ in range(originals):
        words = [f"w{rng.randrange(3000)}" for _ in range(200)]
        texts.append(" ".join(words))
        for edits in (1, 3, 4, 6, 9):
            copy = list(words)
            for _ in range(edits):
                copy[rng.randrange(200)] = f"n{rng.randrange(9000)}"
            texts.append(" ".join(copy))
    return texts


def test_wide_fingerprints_by_hand(monkeypatch):
    text = " ".join(f"w{i}" for i in range(700))
    whole = near_copies.wide_fingerprint(text, 5)
    monkeypatch.setattr(near_copies, "_PART", 50)
    assert (near_copies.wide_fingerprint(text, 5) == whole).all() and whole.shape == (5,)
    assert (near_copies.wide_fingerprint(text, 3) == whole[:3]).all()
    assert (near_copies.wide_fingerprint(None, 2) == near_copies.wide_fingerprint(" ", 2)).all()


def test_differing_bits_follow_the_similarity():
    rng, share = random.Random(3), []
    for _ in range(100):
        base = [f"w{rng.randrange(10**6)}" for _ in range(104)]
        own = list(base)
        own[20], own[60] = "x", "y"  # 90 of 110 shingles in common
        assert 0.8 <= minhash.jaccard(minhash.shingles(" ".join(base)), minhash.shingles(" ".join(own))) < 0.83
        a, b = (near_copies.wide_fingerprint(" ".join(t), 4) for t in (base, own))
        share.append(np.bitwise_count(a ^ b).sum() / 256)
    assert 0.11 < np.mean(share) < 1 - near_copies.AGREE and np.mean(np.array(share) <= 0.25) > 0.98


def test_trees_grow_slowly_with_the_rows():
    small, large = near_copies.layout(10**5), near_copies.layout(10**7)
    assert large[1] < 5 * small[1]
    for bits, trees, words in (small, large, near_copies.layout(0)):
        assert (1 - near_copies.AGREE**bits) ** trees <= near_copies.MISSED
        assert 2 <= words <= near_copies._MOST_WORDS
    assert near_copies.layout(10**12)[2] <= near_copies._MOST_WORDS


def test_groups_by_hand():
    rng = np.random.default_rng(1)
    a, b = rng.integers(0, 2**63, (2, 300), dtype=np.uint64)
    a[100:200], b[100:200] = a[:100] ^ np.uint64(0xFFFF), b[:100] ^ np.uint64(0xFFFF)  # 32 bits
    a[200:], b[200:] = a[:100] ^ np.uint64(0x1FFFF), b[:100] ^ np.uint64(0xFFFF)  # 33, and 1 from the second
    label = near_copies.groups(a, b)
    assert len(set(label)) == 100 and (label[:100] == label[100:200]).all() and (label[:100] == label[200:]).all()
    alone = np.r_[0:100, 200:300]
    assert len(set(near_copies.groups(a[alone], b[alone]))) == 200


@pytest.mark.parametrize("shard_rows, cell_rows", [(2048, 8192), (16, 8192), (2048, 40)])
def test_near_copies_against_brute_force(documents, monkeypatch, shard_rows, cell_rows):
    monkeypatch.setattr(near_copies.members, "__defaults__", (cell_rows,))
    texts = near_texts(4) + ["", "  ", "one two", "One  two", "three four"]
    want, pairs = components_by_hand(texts)
    rows = near_copies.near_duplicates(documents([(i, t) for i, t in enumerate(texts)]), shard_rows=shard_rows).collect()
    assert {r["doc_id"]: r["component_id"] for r in rows} == want and len(pairs) > 100
    assert {r["doc_id"] for r in rows if r["kept"]} == set(want.values())


def test_a_group_around_the_threshold_loses_no_link(documents):
    texts = variants(300, 11)
    want, pairs = components_by_hand(texts)
    rows = near_copies.near_duplicates(documents([(i, t) for i, t in enumerate(texts)])).collect()
    assert {r["doc_id"]: r["component_id"] for r in rows} == want and len(pairs) > 500


def test_the_stage_goes_through_simhash_trees(spark, documents, monkeypatch):
    pipeline = pytest.importorskip("corpus_pipeline")
    grown = []
    monkeypatch.setattr(near_copies, "grow", lambda *a: grown.append(a) or simhash.grow(*a))
    texts = near_texts(5, 10)
    want, _ = components_by_hand(texts)
    left = dict(pipeline.STAGES)["simhash_neardup"](spark, documents(list(enumerate(texts))), "")
    assert {r["doc_id"] for r in left.collect()} == set(want.values())
    assert grown
