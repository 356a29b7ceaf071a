import hashlib
import zlib

import regex
from pyspark.sql import functions as F

from epochwright.llm import merkle


def sha(s):
    return hashlib.sha256(s.encode()).hexdigest()


def parts(items, ends):
    out, now = [], []
    for x in items:
        now.append(x)
        if ends(x):
            out, now = [*out, now], []
    return [*out, now] if now else out


def tree_root(text):
    def paragraph(p):
        words = regex.findall(r"[\p{Han}\p{Hiragana}\p{Katakana}\p{Thai}]\s*|[^\s\p{Han}\p{Hiragana}\p{Katakana}\p{Thai}]+\s*|\s+", p)
        assert "".join(words) == p
        runs = [sha("".join(r)) for r in parts(words, lambda w: zlib.crc32(w.encode()) % 4 == 0)]
        return sha(",".join(sha(",".join(t)) for t in parts(runs, lambda h: h[0] == "0")))

    return sha(",".join(sha(",".join(paragraph(p) for p in s.split("\n"))) for s in (text or "").split("\n\n")))


def test_edits_against_brute_force(documents):
    texts = {1: "a b c d e f g h\nsecond line", 2: None, 4: "x", 5: "Title\n\nbody of it \U0001f600 and more\n", 9: "a b c d e f g h\nsecond line",
             6: " ".join(f"w{i % 97}" for i in range(700)), 7: "\u65e5\u672c\u8a9e\u306e\u6587\u7ae0 and words\n\n\n x"}
    rows = {r["doc_id"]: r for r in merkle.edit_fingerprints(documents(list(texts.items()))).collect()}
    order = sorted(texts)
    assert set(rows) == set(order)
    for i, doc in enumerate(order):
        text, after = texts[doc] or "", texts[order[(i + 1) % len(order)]] or ""
        cut = len(text) // 4
        edited = text[: len(text) - cut] + after[:cut]
        row = rows[doc]
        assert row["n_chars"] == len(text)
        assert row["edited_sha256"] == hashlib.sha256(edited.encode()).hexdigest()
        assert row["fingerprint"].startswith(tree_root(text)) and row["edited_fingerprint"].startswith(tree_root(edited))
        assert (row["near_edited"] == 1.0) == (edited == text) and 0 <= row["near_next"] <= 1
    assert rows[1]["fingerprint"] == rows[9]["fingerprint"] and rows[9]["near_next"] == 1.0


def test_odd_rows(odd, nothing, documents):
    assert merkle.edit_fingerprints(odd).count() == odd.count()
    assert merkle.edit_fingerprints(nothing).count() == 0
    assert merkle.edit_fingerprints(documents([(8, "alone")])).first()["near_next"] == 1.0


def compared(spark, x, y):
    frame = spark.createDataFrame([(x, y)], "x string, y string")
    tree = frame.select(merkle.paragraph_tree(F.col("x")).alias("x"), merkle.paragraph_tree(F.col("y")).alias("y"))
    root = lambda c: merkle.root_hash(merkle.section_hashes(F.col(c)))
    return tree.select(
        merkle.changed_stretches(F.col("y"), F.col("x")).alias("at"),
        F.size(F.flatten(F.transform(F.flatten("y"), lambda p: p["stretches"]))).alias("n"),
        merkle.likeness(root("x"), merkle.runs_of(F.col("x")), root("y"), merkle.runs_of(F.col("y"))).alias("like"),
    ).first()


def test_differing_branches_locate_edits(spark):
    found = compared(spark, "a\nb\n\nc\nd\n\ne", "a\nb\n\nc\nD\n\ne")
    assert [tuple(p) for p in found["at"]] == [(1, 1, 0)]
    assert compared(spark, "a\n\nb", "a\n\nb")["at"] == []


def test_a_word_put_in_changes_one_stretch(spark):
    words = [f"word{i}" for i in range(400)]
    for at in (0, 200, 400):
        found = compared(spark, " ".join(words) + " ", " ".join([*words[:at], "new", *words[at:]]) + " ")
        assert found["n"] > 4 and len(found["at"]) <= 2 and 0.95 < found["like"] < 1
    signs = "".join(chr(0x4E00 + i) for i in range(400))
    assert compared(spark, signs, "\u4e8c" + signs)["like"] > 0.95


def test_plan_has_no_python(odd):
    plan = merkle.edit_fingerprints(odd)._jdf.queryExecution().toString()
    assert "Python" not in plan and "Arrow" not in plan
