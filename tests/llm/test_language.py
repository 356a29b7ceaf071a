import random

import numpy as np
from pyspark.sql import functions as F

from epochwright.llm import langid

ALPHABETS = {"xx": ["kal", "mor", "tis", "ven"], "yy": ["ouè", "aim", "éra", "quo"], "zz": ["sch", "ung", "äch", "zte"]}


def prose(lang, words, rng):
    return " ".join("".join(rng.choices(ALPHABETS[lang], k=rng.randrange(1, 4))) for _ in range(words))


def test_gradients_against_differences():
    rng = np.random.default_rng(1)
    data = rng.integers(0, 256, (5, 3)).astype(np.uint8)
    table, recur = rng.normal(0, 0.3, (256, 12)), rng.normal(0, 0.3, (4, 12))
    weight = rng.normal(0, 1, (5, 3, 4))
    loss = lambda: float((langid._forward(data, table, recur)[0].astype(float) * weight).sum())
    states, kept = langid._forward(data, table, recur)
    d_table, d_recur = langid._backward(data, weight.astype(np.float32), kept, recur)
    for array, grad in ((table, d_table), (recur, d_recur)):
        used = np.argwhere(np.abs(grad) > 1e-3)
        for i, j in used[:: max(1, len(used) // 12)]:
            step, old = 1e-2, array[i, j]
            array[i, j] = old + step
            up = loss()
            array[i, j] = old - step
            down = loss()
            array[i, j] = old
            assert abs((up - down) / (2 * step) - grad[i, j]) < 0.02 + 0.05 * abs(grad[i, j])


def test_reading_equals_training_pass():
    rng = random.Random(2)
    net = langid.train([prose(k, 300, rng) for k in ALPHABETS], list(ALPHABETS), steps=3)
    data = np.frombuffer(prose("yy", 60, rng).encode()[: langid.WINDOW], np.uint8)
    one = data[:, None]
    ahead, _ = langid._forward(one, net.table[0], net.recur[0])
    back, _ = langid._forward(one[::-1], net.table[1], net.recur[1])
    plain = langid._log_softmax(np.concatenate([ahead, back[::-1]], axis=2) @ net.out + net.bias)[:, 0]
    fast = langid.position_scores(net, data[None, :], np.array([len(data)]))[0]
    assert np.allclose(plain, fast, atol=1e-4)
    # a document's score is the mean over its positions, whatever lies beside it in the batch
    ends = np.array([0, len(data), len(data) + 3])
    three = langid.document_scores(net, np.concatenate([data, data[:3]]), ends)
    assert np.allclose(three[1], plain.mean(axis=0), atol=1e-4) and np.allclose(three[0], 0)


def test_held_out_accuracy_and_odd_rows(documents):
    rng = random.Random(3)
    rows = [(i, prose(k, rng.randrange(3, 200), rng), k) for i, k in enumerate(rng.choices(list(ALPHABETS), k=240))]
    rows += [(1000, None, "xx"), (1001, "", "xx"), (1002, "123 !?", "yy"), (None, prose("zz", 50, rng), None)]
    rows += [(1003, prose("yy", 3000, rng), None)] * 2
    docs = documents(rows)
    got = langid.identify(docs, F.pmod("doc_id", F.lit(4)) == 2).collect()
    assert len(got) == len(rows)
    want = {d: k for d, _, k in rows}
    held = [r for r in got if r["held_out"] and r["doc_id"] < 1000]
    assert np.mean([r["lang_pred"] == want[r["doc_id"]] for r in held]) > 0.95
    by = {r["doc_id"]: r for r in got}
    assert all(by[d]["lang_pred"] == "und" and by[d]["score"] == 0 for d in (1000, 1001, 1002))
    assert by[1003]["lang_pred"] == "yy" and by[None]["lang_pred"] == "zz" and not by[None]["held_out"]


def test_sample_is_bounded_where_ids_repeat(documents):
    rng = random.Random(5)
    rows = [(None if i % 2 else 7, prose("xx", 30, rng), "xx") for i in range(400)]
    rows += [(7, "always the same", "yy")] * 300 + [(i, prose("yy", 30, rng), "yy") for i in range(60)]
    texts, labels = langid.sample(documents(rows), per_lang=20)
    assert 5 <= labels.count("xx") <= 45 and 5 <= labels.count("yy") <= 45
    assert len(set(texts)) == len(texts) <= 80
    everything = langid.sample(documents(rows), per_lang=10_000)[0]
    assert len(everything) == 461 and everything.count("always the same") == 1


def test_nothing_to_learn_from(documents, nothing):
    assert langid.identify(nothing, F.lit(False)).count() == 0
    assert {r["lang_pred"] for r in langid.identify(documents([(1, "abc", None)]), F.lit(False)).collect()} == {"und"}
