import random

from pyspark.sql import functions as F

from epochwright.operators import indexing
from epochwright.operators.indexing import number_rows, row_index, running_total
from epochwright.session import materialize
from epochwright.sinks.tables import id_shards


def _skewed(spark, n=3000):
    """A third of the rows have one key; one key is NULL."""
    rng = random.Random(1)
    rows = [("hot" if i % 3 == 0 else rng.choice(["a", "b", None]), rng.random(), i) for i in range(n)]
    return rows, spark.createDataFrame(rows, "k string, t double, id long").repartition(7)


def test_row_index_equals_a_sorted_enumeration(spark):
    rows, df = _skewed(spark)
    got = {r["id"]: r["idx"] for r in row_index(df, ["k"], ["t", "id"]).collect()}
    want = {}
    for key in {r[0] for r in rows}:
        group = sorted((r for r in rows if r[0] == key), key=lambda r: r[1:])
        want.update({r[2]: i for i, r in enumerate(group)})
    assert got == want


def test_row_index_splits_a_hot_key(spark, monkeypatch):
    """The hot key's rows are sorted and numbered in more than one partition."""
    seen = []
    write = indexing.materialize

    def spy(df, label):
        seen.append(write(df, label))
        return seen[-1]

    monkeypatch.setattr(indexing, "materialize", spy)
    spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "false")
    try:
        _, df = _skewed(spark)
        row_index(df, ["k"], ["t", "id"])
    finally:
        spark.conf.unset("spark.sql.adaptive.coalescePartitions.enabled")
    parts = seen[0].filter("k = 'hot'").select(F.shiftright("_at", 33)).distinct().count()
    assert parts > 1


def test_row_index_without_keys(spark):
    _, df = _skewed(spark)
    rows = row_index(df, [], ["id"]).collect()
    assert all(r["idx"] == r["id"] for r in rows)


def test_running_total_over_several_blocks(spark):
    step = 9000  # positions far apart, so a key spans many blocks
    rows = [(k, i * step, (i * 7) % 5) for k in ("x", "y") for i in range(40)]
    df = spark.createDataFrame(rows, "k string, p long, v long").repartition(5)
    got = {(r["k"], r["p"]): r["s"] for r in running_total(df, ["k"], "p", F.col("v"), "s").collect()}
    for k in ("x", "y"):
        total = 0
        for i in range(40):
            assert got[(k, i * step)] == total
            total += (i * 7) % 5


def test_number_rows_counts_and_sums_in_one_pass(spark):
    rows = [(None if i % 7 == 0 else i % 3, (i * 37) % 101, i, None if i % 5 == 0 else i % 4) for i in range(400)]
    df = spark.createDataFrame(rows, "k int, t int, id int, v int")
    got = {r["id"]: (r["idx"], r["before"]) for r in number_rows(df, ["k"], ["t", "id"], {"before": F.col("v")}).collect()}
    seen = {}
    for k, t, i, v in sorted(rows, key=lambda r: (str(r[0]), r[1], r[2])):
        n, total = seen.get(k, (0, 0))
        assert got[i] == (n, total)
        seen[k] = (n + 1, total + (v or 0))
    whole = number_rows(df, [], ["id"]).collect()
    assert sorted((r["id"], r["idx"]) for r in whole) == [(i, i) for i in range(400)]


def test_number_rows_spreads_a_hot_key(spark, monkeypatch):
    written = []
    monkeypatch.setattr(indexing, "materialize", lambda df, label: written.append(materialize(df, label)) or written[-1])
    df = spark.range(40_000).select(F.when(F.col("id") % 3 == 0, F.col("id")).otherwise(0).alias("k"), "id")
    spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "false")
    try:
        number_rows(df, ["k"], ["id"]).count()
    finally:
        spark.conf.unset("spark.sql.adaptive.coalescePartitions.enabled")
    hot = written[0].filter("k = 0").select(F.shiftright("_at", 33).alias("p")).groupBy("p").count().collect()
    assert len(hot) > 1 and max(r["count"] for r in hot) < 26_000


def test_id_shards_are_one_sorted_list(spark):
    ids = [f"S{i:03d}" for i in range(103)]
    rows = [(i, "train" if i < "S070" else "test") for i in ids for _ in range(2)]
    shards = id_shards(spark.createDataFrame(rows, "subject_id string, split string").repartition(5), ["split"], 8).collect()
    for split in ("train", "test"):
        own = sorted((r for r in shards if r["split"] == split), key=lambda r: r["shard"])
        assert [r["shard"] for r in own] == list(range(len(own))) and all(r["n_ids"] == len(r["ids"]) for r in own)
        assert all(r["n_ids"] == 8 for r in own[:-1])
        assert [i for r in own for i in r["ids"]] == sorted({i for i, s in rows if s == split})
