import random
import zlib

import numpy as np
import pytest

from epochwright.llm import packing

tokenizers = pytest.importorskip("tokenizers")
public = pytest.importorskip("public_tokenizers")


def ids_of(text):
    tokenizer = tokenizers.Tokenizer.from_file(public.path("byte_bpe_50k.json"))
    tokenizer.encode_special_tokens = True
    return np.array(tokenizer.encode(text or "", add_special_tokens=False).ids + [1], dtype="<u4")


def test_pieces_and_sequences(odd):
    rows = packing.pack_documents(odd).collect()
    texts = [(r["doc_id"], r["text"]) for r in odd.select("doc_id", "text").collect()]
    want = []
    for doc, text in texts:
        ids = ids_of(text)
        want += [
            (str(doc), a, min(2048, len(ids) - a), zlib.crc32(ids[a : a + 2048].tobytes()), len(ids))
            for a in range(0, len(ids), 2048)
        ]
    got = [(str(r["doc_id"]), r["start"], r["length"], r["ids_crc32"], r["doc_tokens"]) for r in rows]
    assert sorted(got) == sorted(want)
    by = {}
    for r in rows:
        by.setdefault(r["sequence_id"], []).append((r["offset"], r["length"]))
    for pieces in by.values():
        at = 0
        for offset, length in sorted(pieces):
            assert offset == at
            at += length
        assert at <= 2048


def test_slices_do_not_change_tokens(monkeypatch):
    text = "It's 3 words,  then\n\nmore ones and cafés " * 50
    whole = ids_of(text)[:-1].tolist()
    monkeypatch.setattr(packing, "SLICE", 100)
    parts = list(packing.slices(text))
    assert len(parts) > 5 and "".join(parts) == text
    assert [i for p in parts for i in ids_of(p)[:-1].tolist()] == whole


def test_plan_covers_all_pieces_near_the_bound():
    rng = random.Random(3)
    histogram = {s: rng.randrange(1, 400) for s in range(3, 120)}
    plan = packing.plan_patterns(histogram, 256)
    total = {}
    for pattern, times in plan:
        assert sum(s * n for s, n in pattern.items()) <= 256 and times > 0
        for s, n in pattern.items():
            total[s] = total.get(s, 0) + n * times
    assert total == histogram
    used = sum(times for _, times in plan)
    assert used <= 1.01 * sum(s * n for s, n in histogram.items()) / 256 + 3
    assert packing.plan_patterns({}, 256) == []


def test_no_rows(nothing):
    assert packing.pack_documents(nothing).count() == 0


def test_added_tokens_inside_text(documents):
    texts = ["a b <|endoftext|> c", "<|endoftext|>", "x<|endoftext|><|endoftext|>\n\ny  <|endoftext", "<|endoftext|> z" * 900]
    tokenizer = tokenizers.Tokenizer.from_file(public.path("byte_bpe_50k.json"))
    want = []
    for doc, text in enumerate(texts):
        ids = np.array(tokenizer.encode(text, add_special_tokens=False).ids + [1], dtype="<u4")
        want += [(doc, a, zlib.crc32(ids[a : a + 2048].tobytes()), len(ids)) for a in range(0, len(ids), 2048)]
    rows = packing.pack_documents(documents(list(enumerate(texts)))).collect()
    assert sorted((r["doc_id"], r["start"], r["ids_crc32"], r["doc_tokens"]) for r in rows) == want
