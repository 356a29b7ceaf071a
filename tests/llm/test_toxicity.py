import random

import numpy as np
from pyspark.sql import functions as F

from epochwright.llm import toxicity


def brute_hits(text, model):
    """Every lexicon word that stands alone in the folded text and in no exception phrase."""
    import re

    folded = toxicity.fold(text)
    covered = [m.span() for p in model.exceptions for m in re.finditer(rf"(?<![^\W\d_]){re.escape(p)}(?![^\W\d_])", folded)]
    out = []
    for word, weight in model.weights.items():
        for m in re.finditer(rf"(?<![^\W\d_]){re.escape(word)}(?![^\W\d_])", folded):
            if not any(a <= m.start() and m.end() <= b for a, b in covered):
                out.append((*m.span(), weight))
    return sorted(out)


def test_fold():
    assert toxicity.fold("1D10T") == "idiot" and toxicity.fold("m0rön") == "morön"
    assert toxicity.fold("іdiоt l​oser ｓcum") == "idiot loser scum"
    assert toxicity.fold("call 5550 or 3.14 now!!") == "call 5550 or 3.14 now!!"


def test_hits_against_brute_force():
    model = toxicity.Model({"trash": 2.0, "loser": 1.5, "clown": 1.0, "réeux": 3.0})
    machine = toxicity.automaton(model)
    texts = ["Trash can, TRASH! tr4sh trashy untrash", "clown fish clown", "", "RÉEUX réeuxment loser-loser", "l0ser\nbracket loser bracket"]
    for text in texts:
        assert sorted(toxicity.hits(toxicity.fold(text), machine)) == brute_hits(text, model)
    assert toxicity.hits("x", toxicity.automaton(toxicity.Model({}, ()))) == []


def made(documents, spark, n=600):
    rng = random.Random(4)
    neutral = ["".join(rng.choices("abcdefgh", k=5)) for _ in range(300)]
    rows, labels = [], []
    for i in range(n):
        toxic = i % 5 == 0
        words = rng.choices(neutral, k=rng.randrange(5, 60))
        if toxic:
            for _ in range(3):
                words.insert(rng.randrange(len(words)), rng.choice(["zounds", "wretch", "varlet"]))
        rows.append((i, " ".join(words)))
        labels.append((i, int(toxic)))
    rows += [(n, None), (n, None), (n + 1, ""), (n + 2, "z0unds wr3tch ѵarlet wretch"), (None, "wretch zounds varlet")]
    rows += [(n + 3, " ".join(rng.choices(neutral, k=50_000)))]
    return documents(rows), spark.createDataFrame(labels, "doc_id long, toxic int")


def test_held_out_rows(documents, spark):
    docs, labels = made(documents, spark)
    model = toxicity.learn(docs, labels, F.pmod("doc_id", F.lit(3)) != 0)
    assert set(model.weights) == {"zounds", "wretch", "varlet"}
    got = toxicity.scores(docs, model).collect()
    assert len(got) == docs.count()
    held = [r for r in got if r["doc_id"] is not None and r["doc_id"] < 600 and r["doc_id"] % 3 == 0]
    assert all((r["score"] >= 0.5) == (r["doc_id"] % 5 == 0) for r in held)
    by = {r["doc_id"]: r["score"] for r in got}
    assert by[600] < 0.5 and by[601] < 0.5 and by[602] > 0.5 and by[None] > 0.5 and by[603] < 0.5
    left = toxicity.drop_toxic(docs, model)
    assert left.columns == docs.columns and left.filter("doc_id < 600").count() == 480


def test_nothing_to_learn_from(nothing, spark, odd):
    labels = spark.createDataFrame([], "doc_id long, toxic int")
    model = toxicity.learn(nothing, labels, F.lit(True))
    assert toxicity.scores(nothing, model).count() == 0
    assert {r["score"] for r in toxicity.scores(odd, model).collect()} == {0.0}
    assert np.allclose(toxicity.probability(np.zeros((2, 4)), model), 0)


def test_disguised_words_teach_the_plain_word(documents, spark):
    rows = [(i, ("z0unds here " if i % 2 else "wret​ch th3re ") + f"plain text {'abcdefghij'[i % 10]}") for i in range(0, 200)]
    rows += [(1000 + i, f"here there plain text {'abcdefghij'[i % 10]}") for i in range(200)]
    labels = spark.createDataFrame([(d, int(d < 1000)) for d, _ in rows], "doc_id long, toxic int")
    model = toxicity.learn(documents(rows), labels, F.lit(True))
    assert {"zounds", "wretch"} <= set(model.weights) and not {"z", "unds", "wret"} & set(model.weights)


def test_one_id_teaches_one_text(documents, spark):
    docs = documents([(7, f"text {i % 40}") for i in range(900)] + [(i, "other") for i in range(20, 40)])
    labels = spark.createDataFrame([(7, 1), *[(i, 0) for i in range(20, 40)]], "doc_id long, toxic int")
    assert toxicity._sample(docs, labels, F.lit(True)).groupBy("doc_id").count().filter("count > 1").isEmpty()


def test_many_exceptions_in_a_long_text():
    model = toxicity.Model({"trash": 2.0})
    text = "trash can trash bin " * 20_000 + "trash"
    assert len(toxicity.hits(text, toxicity.automaton(model))) == 1
