"""A trie over conversations that are rebuilt from a base's head and their own rest, by fingerprints only.

The fingerprint of a sequence of turns is an element of a monoid: (x, s), with
x the base of a polynomial to the power of the length and s the sum of the
turns' hashes times the powers of their places. Sequences are appended by
(x, s)(y, t) = (xy, s + xt). So a rebuilt conversation's prefix is the product
of its base's head and a stretch of its own turns, and that stretch is the
difference of two prefixes, shifted: no rebuilt conversation is ever put
together. Four sums modulo 2**31 - 1 are kept side by side.

Every prefix of every rebuilt conversation is one narrow row that refers to the
stored turn at its end by that turn's content hash; equal prefixes are counted
with map-side combining, so neither the root nor a first turn that a third of
the conversations share is a large group. Sums over a subtree become sums over
its members: each node hands its share to its smallest member, where a suffix
sum along that conversation gathers what lies below.

Nothing rests on a hash: the stored turns behind every content hash are
compared as texts, and all members of a node must have one parent and one last
turn; by induction their whole prefixes are then equal. Should a fingerprint
ever fail that test, the trie is made again with another seed.

Results for odd input: a null role or text is empty; turns of one conversation
with the same number are ordered by role, then by a hash of the text; repeated
turns are turns; rows without a conv_id belong to no conversation and are left
out; a base that is not there gives no head; no rows give no nodes, not even a
root; other columns are not looked at.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator
from functools import reduce

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from epochwright.llm.common import map_once
from epochwright.operators.indexing import number_rows
from epochwright.session import materialize

PRIME = 2**31 - 1
LANES = 4
SEEDS = (101, 202, 303)  # of the fingerprints; the next is for a trie whose fingerprints fail the test
_CHUNK_BITS = 16  # conversations of one stretch of ids whose ids are joined to one text


def stored_turns(conversations: DataFrame) -> DataFrame:
    """(conv, pos, role, bytes, h1, h2): the turns in order, with content hashes instead of texts."""
    role, text = F.coalesce("role", F.lit("")), F.coalesce("text", F.lit(""))
    rows = conversations.filter(F.col("conv_id").isNotNull()).select(
        F.col("conv_id").cast("long").alias("conv"),
        F.col("turn").cast("long").alias("turn"),
        role.alias("role"),
        F.octet_length(text).cast("long").alias("bytes"),
        F.xxhash64(F.lit(1), role, text).alias("h1"),
        F.xxhash64(F.lit(2), text, role).alias("h2"),
    )
    return number_rows(rows, ["conv"], ["turn", "role", "h1", "h2"], out="pos").drop("turn")


def verify_turns(conversations: DataFrame) -> None:
    """Raise if two different turns share their content hashes."""
    role, text = F.coalesce("role", F.lit("")), F.coalesce("text", F.lit(""))
    both = F.struct(role, text)
    twice = (
        conversations.groupBy(F.xxhash64(F.lit(1), role, text), F.xxhash64(F.lit(2), text, role))
        .agg(F.min(both).alias("a"), F.max(both).alias("b"))
        .filter("a <> b")
    )
    if not twice.isEmpty():
        raise ValueError("two different turns have the same content hashes")


def _bases(seed: int) -> list[int]:
    """A base for each lane."""
    return [
        int.from_bytes(hashlib.sha256(f"{seed}:{lane}".encode()).digest()[:8], "little") % (PRIME - 2) + 2
        for lane in range(LANES)
    ]


def power(base: int, exponent: Column) -> Column:
    """``base`` to a power of up to 40 bits, modulo the prime, by its hexadecimal digits."""
    factors = []
    for digit in range(10):
        step = pow(base, 16**digit, PRIME)
        powers = F.expr("array(" + ", ".join(f"{pow(step, k, PRIME)}L" for k in range(16)) + ")")
        factors.append(F.get(powers, F.shiftright(exponent.cast("long"), 4 * digit).bitwiseAND(F.lit(15)).cast("int")))
    return reduce(lambda a, b: a * b % PRIME, factors)


def _lanes(kind: str) -> list[str]:
    return [f"{kind}{lane}" for lane in range(LANES)]


def products(turns: DataFrame, seed: int) -> DataFrame:
    """``turns`` with its prefix products: s0.. before each turn, e0.. with it."""
    hashed = [F.pmod(F.xxhash64(F.lit(seed), F.lit(lane), "h1", "h2"), F.lit(PRIME)) for lane in range(LANES)]
    terms = [
        (hashed[lane] * power(base, F.col("pos")) % PRIME).alias(f"t{lane}") for lane, base in enumerate(_bases(seed))
    ]
    # sums of values below 2**31 stay below 2**63 for as many turns as there can be
    summed = number_rows(
        turns.select("conv", "pos", "bytes", "h1", "h2", *terms),
        ["conv"],
        ["pos"],
        {f"s{lane}": F.col(f"t{lane}") for lane in range(LANES)},
        out="_again",
    )
    return summed.select(
        "conv",
        "pos",
        "bytes",
        "h1",
        "h2",
        *[(F.col(f"s{lane}") % PRIME).alias(f"s{lane}") for lane in range(LANES)],
        *[((F.col(f"s{lane}") + F.col(f"t{lane}")) % PRIME).alias(f"e{lane}") for lane in range(LANES)],
    )


def paths(turns: DataFrame, base: Column, head: Column, seed: int) -> DataFrame:
    """A row for every prefix of every rebuilt conversation.

    ``base`` and ``head`` are made from the column conv: whose head is taken,
    and of how many turns. Columns: conv, depth, length (of the rebuilt
    conversation), bytes and h1, h2 of the last turn, k0.. the fingerprint,
    p0.. the one without the last turn.
    """
    known = materialize(products(turns, seed), "turn-products")
    lengths = known.groupBy("conv").agg(F.count(F.lit(1)).alias("n"))
    convs = materialize(lengths.select("conv", "n", base.cast("long").alias("base"), head.cast("long").alias("h")), "conversations")
    of_base = convs.select(F.col("conv").alias("base"), F.col("n").alias("n_base"))
    sized_convs = (
        convs.join(of_base, "base", "left")
        .withColumn("hb", F.least("h", F.coalesce("n_base", F.lit(0).cast("long"))))
        .withColumn("length", F.col("hb") + F.greatest(F.col("n") - F.col("h"), F.lit(0)))
        .select("conv", "base", "n", "h", "hb", "length")
    )
    sized_convs = materialize(sized_convs, "conversation-lengths")
    side = known.select(F.col("conv").alias("base"), *[c for c in known.columns if c != "conv"])
    inherited = (
        sized_convs.filter("hb > 0")
        .select("conv", "base", "hb", "length")
        .join(side, "base")
        .filter("pos < hb")
    )
    inherited = materialize(inherited, "inherited-turns")
    heads = inherited.select(
        "conv", (F.col("pos") + 1).alias("depth"), "length", "bytes", "h1", "h2",
        *[F.col(f"e{i}").alias(f"k{i}") for i in range(LANES)],
        *[F.col(f"s{i}").alias(f"p{i}") for i in range(LANES)],
    )
    # what comes before a conversation's own rest: the whole head, and its own turns that are left out
    whole_heads = inherited.filter("pos = hb - 1").select("conv", *[F.col(f"e{i}").alias(f"head{i}") for i in range(LANES)])
    skipped = known.select(F.col("conv").alias("_c"), F.col("pos").alias("_p"), *[F.col(f"s{i}").alias(f"skip{i}") for i in range(LANES)])
    with_rest = (
        sized_convs.filter("n > h")
        .join(skipped, (F.col("conv") == F.col("_c")) & (F.col("h") == F.col("_p")))
        .drop("_c", "_p", "base", "n")
        .join(whole_heads, "conv", "left")
        .na.fill(0, _lanes("head"))
    )
    rest = known.join(materialize(with_rest, "rests"), "conv").filter("pos >= h")
    back = F.col("h") - F.col("hb")  # places by which the rest moves forward

    def appended(lane: int, kind: str) -> Column:
        shift = power(pow(_bases(seed)[lane], -1, PRIME), back)
        stretch = F.pmod(F.col(f"{kind}{lane}") - F.col(f"skip{lane}"), F.lit(PRIME).cast("long"))
        return (F.col(f"head{lane}") + stretch * shift) % PRIME

    rests = rest.select(
        "conv", (F.col("pos") - back + 1).alias("depth"), "length", "bytes", "h1", "h2",
        *[appended(i, "e").alias(f"k{i}") for i in range(LANES)],
        *[appended(i, "s").alias(f"p{i}") for i in range(LANES)],
    )
    zero = F.lit(0).cast("long")
    roots = sized_convs.select(
        "conv", zero.alias("depth"), "length", zero.alias("bytes"), zero.alias("h1"), zero.alias("h2"),
        *[zero.alias(c) for c in [*_lanes("k"), *_lanes("p")]],
    )
    packed = lambda kind: [
        (F.shiftleft(f"{kind}0", 31) + F.col(f"{kind}1")).alias(f"{kind}a"),
        (F.shiftleft(f"{kind}2", 31) + F.col(f"{kind}3")).alias(f"{kind}b"),
    ]
    return heads.unionByName(rests).unionByName(roots).select(
        "conv", "depth", "length", "bytes", "h1", "h2", *packed("k"), *packed("p")
    )


NODE = ["depth", "ka", "kb"]


def trie_nodes(prefixes: DataFrame) -> tuple[DataFrame, bool]:
    """Nodes with their counts, and whether each node's members agree in parent and last turn."""
    last, parent = F.struct("h1", "h2"), F.struct("pa", "pb")
    grouped = prefixes.groupBy(*NODE).agg(
        F.min("conv").alias("conv_id"),
        F.count(F.lit(1)).alias("n_convs"),
        F.max("bytes").alias("bytes"),
        F.min(last).alias("_last"),
        F.max(last).alias("_last_too"),
        F.min(parent).alias("_parent"),
        F.max(parent).alias("_parent_too"),
    )
    nodes = materialize(
        grouped.select(
            *NODE, "conv_id", "n_convs", "bytes", F.col("_parent.pa").alias("pa"), F.col("_parent.pb").alias("pb"),
            ((F.col("_last") == F.col("_last_too")) & (F.col("_parent") == F.col("_parent_too"))).alias("_sound"),
        ),
        "trie-nodes",
    )
    return nodes.drop("_sound"), nodes.filter("not _sound").isEmpty()


def _digests(parts: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """SHA-256 of each node's ids, read chunk by chunk in order."""
    key, digest = None, None

    def out():
        return pa.RecordBatch.from_arrays(
            [*[pa.array([k], pa.int64()) for k in key], pa.array([digest.hexdigest()])], names=[*NODE, "ends_sha256"]
        )

    for part in parts:
        for *node, ids in zip(*[part.column(c).to_pylist() for c in [*NODE, "ids"]]):
            if node != key:
                if key is not None:
                    yield out()
                key, digest = node, hashlib.sha256(ids.encode())
            else:
                digest.update(b"," + ids.encode())
    if key is not None:
        yield out()


def end_hashes(prefixes: DataFrame) -> DataFrame:
    """(node, ends_sha256) of the nodes at which a conversation ends.

    Ids are joined to texts in stretches of 65,536 possible ids, many tasks to
    a hot node; only a node with several stretches has them read one after
    another, as the digest must be.
    """
    ends = prefixes.filter("depth = length").select(*NODE, "conv", F.shiftright("conv", _CHUNK_BITS).alias("chunk"))
    chunks = materialize(
        ends.groupBy(*NODE, "chunk").agg(
            F.array_join(F.transform(F.sort_array(F.collect_list("conv")), lambda c: c.cast("string")), ",").alias("ids")
        ),
        "end-chunks",
    )
    counts = chunks.groupBy(*NODE).agg(F.count(F.lit(1)).alias("_n"), F.first("ids").alias("_ids"))
    single = counts.filter("_n = 1").select(*NODE, F.sha2("_ids", 256).alias("ends_sha256"))
    several = materialize(counts.filter("_n > 1").select(*NODE), "ends-in-chunks")
    streams = chunks.join(several, NODE).repartition(*NODE).sortWithinPartitions(*NODE, "chunk").select(*NODE, "ids")
    long = map_once(streams, _digests, "depth long, ka long, kb long, ends_sha256 string", "end-digests")
    return single.unionByName(long)


def below(prefixes: DataFrame, nodes: DataFrame) -> DataFrame:
    """(node, n_leaves, saved_tokens): sums over subtrees.

    A node's share belongs to its smallest member at the node's depth. What
    lies below a node is what its members have from that depth on.
    """
    shares = nodes.select(
        F.col("conv_id").alias("conv"),
        "depth",
        ((F.col("n_convs") - 1) * F.col("bytes")).alias("saved"),
        (F.col("n_children") == 0).cast("long").alias("leaf"),
    )
    holders = materialize(shares, "node-shares")
    along = prefixes.join(holders.select("conv").distinct(), "conv", "left_semi").join(holders, ["conv", "depth"], "left")
    sums = {"_saved": F.col("saved"), "_leaves": F.col("leaf")}
    deepest_first = number_rows(
        along.select("conv", *NODE, "saved", "leaf", (-F.col("depth")).alias("_up")), ["conv"], ["_up"], sums, out="_at"
    )
    with_own = lambda total, own: F.sum(F.col(total) + F.coalesce(F.col(own), F.lit(0)))
    return deepest_first.groupBy(*NODE).agg(
        with_own("_leaves", "leaf").alias("n_leaves"), with_own("_saved", "saved").alias("saved_tokens")
    )


def prefix_trie(conversations: DataFrame, base: Column, head: Column, seeds: tuple[int, ...] = SEEDS) -> DataFrame:
    """A row per node: conv_id, depth, parent_conv_id, n_convs, n_children, n_leaves, saved_tokens, ends_sha256.

    ``base`` and ``head`` say, from the column ``conv``, whose first turns a
    conversation takes over and how many.
    """
    verify_turns(conversations)
    turns = materialize(stored_turns(conversations), "stored-turns")
    for seed in seeds:
        prefixes = materialize(paths(turns, base, head, seed), "trie-paths")
        nodes, sound = trie_nodes(prefixes)
        if sound:
            break
    else:
        raise ValueError("fingerprints of different prefixes met with every seed")
    inner = nodes.filter("depth > 0")
    children = inner.groupBy((F.col("depth") - 1).alias("depth"), F.col("pa").alias("ka"), F.col("pb").alias("kb")).agg(
        F.count(F.lit(1)).alias("n_children")
    )
    parents = nodes.select(
        (F.col("depth") + 1).alias("depth"), F.col("ka").alias("pa"), F.col("kb").alias("pb"), F.col("conv_id").alias("parent_conv_id")
    )
    whole = (
        nodes.join(children, NODE, "left")
        .withColumn("n_children", F.coalesce("n_children", F.lit(0).cast("long")))
        .join(parents, ["depth", "pa", "pb"], "left")
    )
    whole = materialize(whole, "linked-nodes")
    return (
        whole.join(below(prefixes, whole), NODE)
        .join(end_hashes(prefixes), NODE, "left")
        .select(
            "conv_id",
            "depth",
            F.when(F.col("depth") > 0, F.col("parent_conv_id")).alias("parent_conv_id"),
            "n_convs",
            "n_children",
            "n_leaves",
            "saved_tokens",
            F.coalesce("ends_sha256", F.sha2(F.lit("").cast("binary"), 256)).alias("ends_sha256"),
        )
    )
