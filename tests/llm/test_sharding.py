import zlib
from collections import Counter

import xxhash
from pyspark.sql import functions as F

from epochwright.llm import sharding
from epochwright.llm.queries import op12_sharding
from epochwright.session import materialize

MASK = 2**64 - 1


def signed(v):
    return v - 2**64 if v >= 2**63 else v


def of_long(v, seed):
    return xxhash.xxh64_intdigest((v & MASK).to_bytes(8, "little"), seed & MASK)


def of_int(v, seed):
    return xxhash.xxh64_intdigest((v & 0xFFFFFFFF).to_bytes(4, "little"), seed & MASK)


def by_hand(rows, shards, buckets, seed):
    """Scatter and Fisher-Yates in plain Python: (doc_id, text) -> (shard, slot)."""
    dealt = {}
    for doc, text in rows:
        h = of_int(seed, 42)
        h = of_long(doc, h)
        key = signed(xxhash.xxh64_intdigest(text.encode(), h))
        dealt.setdefault(key % buckets, []).append((key, doc, text))
    out, position = {}, 0
    for bucket in sorted(dealt):
        own, order = sorted(dealt[bucket]), []
        for i in range(len(own)):
            h = of_int(i, of_long(bucket, of_int(seed, 42)))
            j = signed(h) % (i + 1)
            order.append(i)
            order[i], order[j] = order[j], i
        for i in order:
            _, doc, text = own[i]
            shard = position * shards // len(rows)
            out[doc] = (shard, position - -(-shard * len(rows) // shards))
            position += 1
    return out


def placed(docs, **options):
    return [(r["record"], r["shard"], r["slot"]) for r in sharding.sharded(docs, **options).collect()]


def test_against_brute_force(documents):
    rows = [(i * 3, f"text {i % 40}") for i in range(1000)]
    want = by_hand(rows, 16, 20, 7)
    got = {r["doc_id"]: (shard, slot) for r, shard, slot in placed(documents(rows), bucket_rows=50)}
    assert got == want
    # the same whatever the partitions
    again = placed(documents(rows).repartition(13, "text"), bucket_rows=50)
    assert {r["doc_id"]: (shard, slot) for r, shard, slot in again} == want


def check(found, shards=16):
    """Slots are gapless and counts differ by one at most."""
    slots = {}
    for _, shard, slot in found:
        slots.setdefault(shard, []).append(slot)
    assert all(sorted(own) == list(range(len(own))) for own in slots.values())
    counts = [len(slots.get(s, [])) for s in range(shards)]
    assert set(slots) <= set(range(shards)) and max(counts) - min(counts) <= 1


def test_repeated_rows_are_spread_over_buckets(documents):
    docs = materialize(documents([(1, "again", None, "s")] * 3000 + [(i, "own") for i in range(3000)]))
    buckets = sharding.scatter(docs, 60).filter("_record.text = 'again'").groupBy("_bucket").count().collect()
    assert len(buckets) == 60 and max(r["count"] for r in buckets) < 100
    found = placed(docs, bucket_rows=100)
    assert len(found) == 6000
    check(found)
    copies = Counter(shard for r, shard, _ in found if r["text"] == "again")
    assert len(copies) == 16 and max(copies.values()) < 2 * min(copies.values())


def test_large_texts_make_more_buckets(documents):
    rows = [(i, "x" * 10_000) for i in range(64)]
    found = placed(documents(rows), bucket_bytes=20_000)
    assert Counter(r["doc_id"] for r, *_ in found) == Counter(range(64))
    check(found)


def test_odd_rows(odd, nothing, spark, tmp_path):
    found = placed(odd)
    check(found)
    key = lambda r: tuple(map(str, r))
    assert sorted((r for r, *_ in found), key=key) == sorted(odd.collect(), key=key)
    assert placed(nothing) == []
    sharding.write_shards(odd, str(tmp_path / "shards"))
    back = spark.read.parquet(str(tmp_path / "shards"))
    assert back.count() == odd.count() and {"record", "shard", "slot"} == set(back.columns)


def test_query(documents, tmp_path):
    rows = [(1, "é"), (2, None), (3, "abc"), (None, ""), *[(i, "same") for i in range(10, 60)]]
    documents(rows).write.parquet(str(tmp_path / "documents.parquet"))
    found = op12_sharding(documents([]).sparkSession, str(tmp_path)).collect()
    text = {doc: (t or "").encode() for doc, t in rows}
    assert sorted((r["doc_id"] or 0, r["size"], r["text_crc32"]) for r in found) == sorted(
        (doc or 0, len(t) + 1, zlib.crc32(t)) for doc, t in text.items()
    )
    assert {(r["law"], r["grown_shard"]) for r in found} == {("rows", None)}
    check([(None, r["shard"], r["slot"]) for r in found])


def test_orders_are_permutations_and_even(spark):
    sizes = spark.range(4000).select(sharding.fisher_yates(F.lit(4), F.col("id")).alias("o"))
    counts = Counter(tuple(r["o"]) for r in sizes.collect())
    assert len(counts) == 24 and min(counts.values()) > 110 and max(counts.values()) < 230


def test_plan_has_no_python(odd):
    plan = sharding.shuffle_buckets(sharding.scatter(odd, 3), 3)._jdf.queryExecution().toString()
    assert "Python" not in plan and "Arrow" not in plan
