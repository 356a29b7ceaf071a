import hashlib
import random
import re

import numpy as np
import pandas as pd
import xxhash

from epochwright.llm import exact_dedup, simhash


def test_cut_points_depend_on_content():
    rng = random.Random(1)
    data = bytes(rng.randrange(97, 123) for _ in range(60_000))
    ends = exact_dedup.cut_points(data)
    moved = exact_dedup.cut_points(b"a few more bytes" + data)
    chunks = {data[a:b] for a, b in zip([0, *ends], ends)}
    others = {(b"a few more bytes" + data)[a:b] for a, b in zip([0, *moved], moved)}
    assert ends[-1] == len(data) and len(chunks & others) > 0.7 * len(chunks)
    assert list(exact_dedup.cut_points(b"")) == []


def test_exact_duplicates_against_brute_force(odd):
    rows = exact_dedup.exact_duplicates(odd).collect()
    norm = lambda t: re.sub(r"[\x20\x09-\x0d]+", " ", t or "")
    given = [(r["doc_id"], norm(r["text"])) for r in odd.select("doc_id", "text").collect()]
    assert len(rows) == len(given)
    for doc, text in given:
        same = [d for d, t in given if t == text]
        first = min((d for d in same if d is not None), default=None)
        got = [r for r in rows if r["doc_id"] == doc and r["text_sha256"] == hashlib.sha256(text.encode()).hexdigest()]
        assert got and all(r["keep_id"] == first and r["group_size"] == len(same) for r in got)
    kept = [r for r in rows if r["kept"]]
    assert len(kept) == len({t for _, t in given})


def test_drop_copies_keeps_one_row_and_all_columns(odd):
    left = exact_dedup.drop_copies(odd)
    assert left.columns == odd.columns
    rows = left.select("doc_id", "text").collect()
    assert sorted((r["doc_id"] or 0) for r in rows) == [0, 1, 3, 4, 5, 6, 9]


def test_shared_identifiers_fall_back_to_digests(odd, monkeypatch):
    before = sorted(map(str, exact_dedup.exact_duplicates(odd).drop("row_key").collect()))
    monkeypatch.setattr(exact_dedup, "chunk_dictionary", lambda made: made.selectExpr("false AS verified"))
    assert sorted(map(str, exact_dedup.exact_duplicates(odd).drop("row_key").collect())) == before


def plain_fingerprint(text):
    words = re.findall(r"[^\x20\x09-\x0D]+", re.sub("[A-Z]", lambda m: m[0].lower(), text or ""))
    shingles = [" ".join(words[i : i + 3]) for i in range(len(words) - 2)] or ([" ".join(words)] if words else [])
    hashes = [xxhash.xxh64_intdigest(s.encode(), 42) for s in shingles]
    return sum(1 << b for b in range(64) if sum(h >> b & 1 for h in hashes) * 2 > len(hashes))


def test_fingerprint_by_the_bit(monkeypatch):
    texts = [None, "", " \t", "One", "one two", "A b C d\x0be f É", "x " * 500 + "y z"]
    whole = [simhash.fingerprint(t) for t in texts]
    assert whole == [plain_fingerprint(t) for t in texts]
    monkeypatch.setattr(simhash, "_PIECE", 16)  # the same over many pieces
    assert [simhash.fingerprint(t) for t in texts] == whole


def classes(points, radius):
    label = list(range(len(points)))

    def find(i):
        while label[i] != i:
            i = label[i]
        return i

    for i in range(len(points)):
        for j in np.flatnonzero(np.bitwise_count(points[i + 1 :] ^ points[i]) <= radius) + i + 1:
            a, b = find(i), find(int(j))
            label[max(a, b)] = min(a, b)
    return [find(i) for i in range(len(points))]


def clustered(seed, groups, size):
    rng = np.random.default_rng(seed)
    centres = rng.integers(0, 2**64, groups, dtype=np.uint64)
    points = []
    for c in centres:
        for _ in range(int(rng.integers(1, size))):
            for bit in rng.integers(0, 64, int(rng.integers(0, 4))):
                c ^= np.uint64(1) << np.uint64(bit)
            points.append(c)
    return np.unique(np.array(points, dtype=np.uint64))


def test_linked_equals_brute_force():
    for seed, groups, size in ((1, 300, 6), (2, 3, 900), (3, 1, 1500)):
        points = clustered(seed, groups, size)
        assert list(simhash.linked(points)) == classes(points, 2)


def test_trees_lose_no_pair():
    points = clustered(5, 400, 9)
    trees = simhash.grow(points[::3], 32)
    rows, shards = simhash.route(points, trees)
    held = [set() for _ in points]
    for r, s in zip(rows, shards):
        held[r].add(int(s))
    for i in range(len(points)):
        for j in np.flatnonzero(np.bitwise_count(points ^ points[i]) <= 2):
            assert held[i] & held[j]
    assert trees.shards > 20


def test_bands_part_all_bits():
    assert sum(simhash.bands(2)) == 2**64 - 1 and len(simhash.bands(2)) == 3


def test_components_of_links_by_spark(spark):
    points = clustered(7, 60, 12)
    frame = spark.createDataFrame([(int(p),) for p in points.view(np.int64)], "fp long")
    got = {r["node"]: r["component"] for r in simhash.components(simhash.links(frame, shard_rows=64)).collect()}
    want = classes(points, 2)
    signed = [int(p) for p in points.view(np.int64)]
    by_root = {}
    for i, root in enumerate(want):
        by_root.setdefault(root, []).append(signed[i])
    expected = {p: min(v) for v in by_root.values() if len(v) > 1 for p in v}
    assert got == expected


def components_of(frame, **limits):
    return {r["node"]: r["component"] for r in simhash.components(simhash.links(frame, **limits)).collect()}


def signed_frame(spark, points):
    return spark.createDataFrame(pd.DataFrame({"fp": points.view(np.int64)}))


def test_shards_stay_small_whatever_the_sample(spark):
    rng = np.random.default_rng(3)
    points = rng.integers(0, 2**64, 50_000, dtype=np.uint64)
    near = points[:600] ^ (np.uint64(1) << rng.integers(0, 64, 600, dtype=np.uint64))
    near ^= np.uint64(1) << rng.integers(0, 64, 600, dtype=np.uint64)
    frame = signed_frame(spark, np.unique(np.concatenate([points, near])))
    whole, crowd = simhash.shards(frame, sample_rows=64, shard_rows=256)
    assert crowd.isEmpty() and whole.groupBy("shard").count().agg({"count": "max"}).first()[0] <= 4 * 256
    got = components_of(frame, sample_rows=64, shard_rows=256)
    for a, b in zip(points[:600].view(np.int64), near.view(np.int64)):
        assert a == b or got[int(a)] == got[int(b)] == min(a, b)
    assert len(got) <= 1200


def test_crowded_fingerprints_are_linked_by_their_neighbours(spark):
    # 600 of the 2,080 at two or fewer bits from one centre, and 300 some bits further
    rng = np.random.default_rng(4)
    bit = lambda: np.uint64(1) << np.uint64(rng.integers(0, 64))
    ball = [np.uint64(2**40 + 99) ^ bit() ^ bit() for _ in range(600)]
    ball += [b ^ bit() ^ bit() ^ bit() for b in ball[:300]]
    points = np.unique(np.array(ball, dtype=np.uint64))
    signed = [int(p) for p in points.view(np.int64)]
    by_root = {}
    for p, root in zip(signed, classes(points, 2)):
        by_root.setdefault(root, []).append(p)
    expected = {p: min(v) for v in by_root.values() if len(v) > 1 for p in v}
    frame = signed_frame(spark, points)
    assert not simhash.shards(frame, shard_rows=8)[1].isEmpty()
    assert components_of(frame, shard_rows=8) == expected
    only = simhash.crowd_links(frame)
    assert {r["node"]: r["component"] for r in simhash.components(only).collect()} == expected


def test_near_duplicates_of_odd_rows(odd, nothing):
    rows = simhash.near_duplicates(odd).collect()
    assert len(rows) == odd.count()
    by = {r["doc_id"]: r for r in rows}
    assert by[1]["fingerprint"] == "0" * 16 and by[4]["component_id"] == 1 and by[2]["component_id"] == 1
    assert by[7]["component_id"] == 3 and by[6]["component_id"] == 5
    assert simhash.near_duplicates(nothing).count() == 0 and exact_dedup.exact_duplicates(nothing).count() == 0
    left = simhash.drop_near_copies(odd)
    assert left.columns == odd.columns and left.filter("doc_id = 3").count() == 1
