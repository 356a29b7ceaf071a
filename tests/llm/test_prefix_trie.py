import hashlib
import random
import zlib
from collections import defaultdict

import pytest
from pyspark.sql import functions as F
from pyspark.sql import types as T

from epochwright.llm import prefix_trie

SCHEMA = T.StructType(
    [
        T.StructField("conv_id", T.LongType()),
        T.StructField("turn", T.LongType()),
        T.StructField("role", T.StringType()),
        T.StructField("text", T.StringType()),
        T.StructField("depth", T.StringType()),
        T.StructField("h1", T.StringType()),
    ]
)
COLUMNS = ["conv_id", "depth", "parent_conv_id", "n_convs", "n_children", "n_leaves", "saved_tokens", "ends_sha256"]


def table(spark, rows):
    return spark.createDataFrame([(*row, "x", "y") for row in rows], SCHEMA)


def crc(c):
    return zlib.crc32(str(c).encode())


def trie(df):
    conv = F.col("conv")
    found = prefix_trie.prefix_trie(df, conv - conv % 5, F.crc32(conv.cast("string").cast("binary")) % 9)
    assert found.columns == COLUMNS
    return sorted(tuple(r) for r in found.collect())


def brute(rows):
    """The same from rebuilt lists of turns, node by node."""
    stored = defaultdict(list)
    for c, turn, role, text in rows:
        if c is not None:
            stored[c].append((turn is not None, turn or 0, role or "", text or ""))
    stored = {c: [t[2:] for t in sorted(turns)] for c, turns in stored.items()}
    rebuilt = {}
    for c, turns in stored.items():
        h = crc(c) % 9
        rebuilt[c] = stored.get(c - c % 5, [])[:h] + turns[h:]
    nodes = defaultdict(list)
    for c, turns in rebuilt.items():
        for d in range(len(turns) + 1):
            nodes[tuple(turns[:d])].append(c)
    out = []
    for key, members in nodes.items():
        under = [k for k in nodes if k[: len(key)] == key]
        children = [k for k in under if len(k) == len(key) + 1]
        leaves = [k for k in under if not any(o[: len(k)] == k and len(o) == len(k) + 1 for o in under)]
        saved = sum((len(nodes[k]) - 1) * len(k[-1][1].encode()) for k in under if k)
        ends = ",".join(str(c) for c in sorted(members) if len(rebuilt[c]) == len(key))
        parent = min(nodes[key[:-1]]) if key else None
        digest = hashlib.sha256(ends.encode()).hexdigest()
        out.append((min(members), len(key), parent, len(members), len(children), len(leaves), saved, digest))
    return sorted(out)


def test_against_brute_force(spark):
    rng = random.Random(3)
    rows = []
    for c in [*range(0, 70), 65_540, 65_541, 131_080, 10**12]:
        if c % 10 == 5:
            continue  # bases that are not there
        for turn in range(rng.randrange(1, 13)):
            rows.append((c, turn, rng.choice(["user", "bot"]), rng.choice(["hé", "yes", "no " * 3])))
    want = brute(rows)
    assert trie(table(spark, rows)) == want
    rng.shuffle(rows)
    assert trie(table(spark, rows)) == want
    assert max(row[1] for row in want) > 9 and any(row[3] > 5 and row[1] > 0 for row in want)


def test_many_equal_conversations_over_stretches_of_ids(spark):
    rows = [(c * 40_000, turn, "user", text) for c in range(60) for turn, text in enumerate(["a", "b", "c"])]
    assert trie(table(spark, rows)) == brute(rows)


def test_odd_rows(spark):
    rows = [
        (1, None, None, None), (1, None, "user", ""), (1, 0, "user", "x" * 100_000), (1, 0, "user", "x" * 100_000),
        (2, 5, "user", "same"), (2, 5, "user", "same"), (3, -4, None, "low"), (None, 0, "user", "nobody's"),
        (-7, 0, "user", "below zero"), (0, 1, "", None),
    ]
    # -7 % 5 is -2 here, so its base is -5 in the table's arithmetic and -10 in Python's; neither is there
    assert trie(table(spark, rows)) == brute(rows)
    assert trie(table(spark, [])) == []


def test_powers(spark):
    for base, exponent in ((7, 0), (7, 1), (12345, 10**6), (2**30, 2**39)):
        assert spark.range(1).select(prefix_trie.power(base, F.lit(exponent))).first()[0] == pow(base, exponent, prefix_trie.PRIME)


def test_a_node_whose_members_differ_is_noticed(spark):
    columns = "conv long, depth long, length long, bytes long, h1 long, h2 long, ka long, kb long, pa long, pb long"
    one, other = (1, 1, 1, 3, 5, 6, 9, 9, 0, 0), (2, 1, 1, 3, 5, 7, 9, 9, 0, 0)
    assert prefix_trie.trie_nodes(spark.createDataFrame([one, one], columns))[1]
    assert not prefix_trie.trie_nodes(spark.createDataFrame([one, other], columns))[1]


def test_unequal_turns_behind_one_hash_are_refused(spark, monkeypatch):
    monkeypatch.setattr(prefix_trie.F, "xxhash64", lambda *a: F.length(a[-1]).cast("long"))
    with pytest.raises(ValueError, match="content hashes"):
        prefix_trie.verify_turns(table(spark, [(1, 0, "user", "a"), (2, 0, "user", "b")]))
