import math
from collections import Counter
from fractions import Fraction

import pytest
from pyspark.sql import functions as F

from epochwright.llm import mixing


def check(rows):
    """Slots are unique per block, within their windows, and positions follow them."""
    blocks = {}
    for r in rows:
        assert r["release"] <= r["slot"] < r["deadline"]
        assert blocks.setdefault((r["source"], r["block"]), r["slot"]) == r["slot"]
    assert len(set(blocks.values())) == len(blocks)
    assert sorted(r["position"] for r in rows) == list(range(len(rows)))
    order = sorted(rows, key=lambda r: r["position"])
    assert [r["slot"] for r in order] == sorted(r["slot"] for r in rows)
    return blocks


def windows(counts, weights):
    """(release, deadline) of every block from exact fractions, over the whole schedule."""
    weights = {s: Fraction(str(w)) for s, w in weights.items()}
    ends = {s: counts[s] / weights[s] for s in counts}

    def slot_at(turn):
        return sum(min(weights[s] * turn, Fraction(counts[s])) for s in counts)

    return {
        (s, i): (math.floor(slot_at(i / weights[s])), math.ceil(slot_at((i + 1) / weights[s])))
        for s in counts
        for i in range(counts[s])
    }, ends, slot_at


def plain_schedule(counts, weights):
    """Earliest deadline first, slot by slot; ties go to the first name."""
    bounds, _, _ = windows(counts, weights)
    names, done, out = sorted(counts, key=lambda s: (s is not None, s or "")), dict.fromkeys(counts, 0), []
    for slot in range(sum(counts.values())):
        ready = [
            (bounds[s, done[s]][1], i, s)
            for i, s in enumerate(names)
            if done[s] < counts[s] and bounds[s, done[s]][0] <= slot
        ]
        _, _, s = min(ready)
        out.append((s, done[s]))
        done[s] += 1
    return out, bounds


CASES = {
    "unequal": ({"a": 500, "b": 300, "c": 195, "d": 5}, {"a": 0.5, "b": 0.3, "c": 0.195, "d": 0.005}),
    "run out": ({"a": 60, "b": 300, "c": 77, None: 3}, {"a": 5, "b": 3, "c": 2, None: 2}),
    "twenty": ({f"s{i:02d}": 20 + 7 * i for i in range(20)}, {f"s{i:02d}": 1 + (i * i) % 17 for i in range(20)}),
    "equal": ({s: 100 for s in "abcdefg"}, {s: 1 for s in "abcdefg"}),
}


@pytest.mark.parametrize("case", CASES)
@pytest.mark.parametrize("tasks", [1, 7])
def test_slots_equal_a_plain_scheduler(spark, monkeypatch, case, tasks):
    counts, weights = CASES[case]
    monkeypatch.setattr(mixing, "CHUNK", 64)
    want, bounds = plain_schedule(counts, weights)
    names = sorted(counts, key=lambda s: (s is not None, s or ""))
    due = mixing.Due.of([(s, float(weights[s]), counts[s]) for s in names])
    rows = sorted(mixing.schedule(spark, due, tasks).collect(), key=lambda r: r["slot"])
    assert [(names[r["s"]], r["block"]) for r in rows] == want
    assert [r["slot"] for r in rows] == list(range(len(want)))
    for r in rows:
        assert (r["release"], r["deadline"]) == bounds[names[r["s"]], r["block"]]
        assert r["release"] <= r["slot"] < r["deadline"]
    # never a whole block from what is due
    exact = {s: Fraction(str(w)) for s, w in weights.items()}
    _, ends, slot_at = windows(counts, weights)
    turns = sorted(set(ends.values()))
    seen = Counter()
    for t, (s, _) in enumerate(want, 1):
        seen[s] += 1
        before = max([v for v in turns if slot_at(v) <= t], default=Fraction(0))
        speed = sum(exact[x] for x in counts if ends[x] > before)
        turn = before + (t - slot_at(before)) / speed if speed else before
        assert all(abs(seen[x] - min(exact[x] * turn, counts[x])) < 1 for x in counts)


def test_odd_rows(odd, nothing):
    rows = mixing.mix(odd, block_chars=1000).collect()
    assert len(rows) == odd.count()
    check(rows)
    assert mixing.mix(nothing).count() == 0
    order = mixing.order_of(odd)
    assert order.count() == odd.select("doc_id", "text").distinct().count()
    whole = mixing.mixed(odd)
    assert whole.columns == odd.columns and whole.count() == odd.count()


def test_plan_has_no_python(odd):
    plan = mixing.mix(odd)._jdf.queryExecution().toString()
    assert "Python" not in plan and "Arrow" not in plan


def test_weights_hold_until_a_source_runs_out(documents):
    docs = documents([(i, "x" * 10, None, "a" if i < 60 else "b") for i in range(75)])
    weights = docs.select("source").distinct().withColumn("weight", F.when(F.col("source") == "a", 2.0).otherwise(1.0))
    blocks = check(mixing.mix(docs, weights, block_chars=10).collect())
    first = Counter(s for s, _ in sorted(blocks, key=blocks.get)[:45])  # less than a round
    assert first == {"a": 30, "b": 15}
