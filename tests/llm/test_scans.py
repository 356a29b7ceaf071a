import itertools
import random
from collections import Counter

from pyspark.sql import functions as F

import re

from epochwright.llm import licenses, pseudonyms, url_rules

KEY = b"test key"
PRIVATE = (
    "card 4111 1111 1111 1111 and 4111111111111111, phone +1 (702) 555-0742, host 192.168.10.254, born 1984-02-29 "
    "or 29.02.1984, ssn 123-45-6789, DE89 3704 0044 0532 0130 00, jo.smith@mail.example.com, "
    'token = "04dbebab91ab85687d33eeaaf9ac699e1188f962"'
)


def test_permutations_are_one_to_one():
    for size in (2, 7, 10, 100, 1461):
        permute = pseudonyms.Permutation(KEY, "t")
        image = [permute(i, size) for i in range(size)]
        assert sorted(image) == list(range(size))
        assert [permute(v, size, True) for v in image] == list(range(size))


def test_round_trip_and_formats():
    new, spans = pseudonyms.pseudonymise(PRIVATE, KEY)
    assert {k for k, _, _ in spans} == set(pseudonyms.KINDS)
    assert len(new) == len(PRIVATE) or re.sub(r"\d{1,3}(\.\d{1,3}){3}", "", new) != ""
    back, _ = pseudonyms.pseudonymise(new, KEY, back=True)
    assert back == PRIVATE
    for kind, a, b in spans:
        value = new[a:b]
        assert value not in PRIVATE
        if kind == "card":
            digits = re.sub(r"\D", "", value)
            assert pseudonyms.check_digit(digits[:-1]) == int(digits[-1])
    cards = [re.sub(r"\D", "", new[a:b]) for k, a, b in spans if k == "card"]
    assert cards[0] == cards[1]  # equal values stay linked, however they are written
    assert pseudonyms.pseudonymise(PRIVATE, b"other")[0] != new


def test_spellings_of_one_value_stay_linked():
    phones = ["+15551234567", "+1 555 123 4567", "+1 (555) 123-4567", "(555) 123-4567", "555-123-4567", "555.123.4567"]
    new = [pseudonyms.pseudonymise("call " + p + " now", KEY)[0][5:-4] for p in phones]
    assert len({re.sub(r"\D", "", n)[-10:] for n in new}) == 1 and not set(new) & set(phones)
    assert [re.sub(r"\d", "0", n) for n in new] == [re.sub(r"\d", "0", p) for p in phones]
    assert new[0].startswith("+1") and pseudonyms.pseudonymise("+353 1 234 5678", KEY)[0].startswith("+353 ")
    hosts = ["2001:db8::8a2e:370:7334", "2001:0db8:0:0:0:8a2e:0370:7334", "2001:DB8::8A2E:370:7334"]
    new = [pseudonyms.pseudonymise(h, KEY)[0] for h in hosts]
    assert new[0] == new[1] == new[2].lower() != hosts[0]
    assert [pseudonyms.pseudonymise(n, KEY, back=True)[0].lower() for n in new] == [hosts[0]] * 3


def test_dates_keep_their_widths():
    for text in ("1/2/2024", "15.3.2024", "01/02/2024", "25/3/2024", "12/5/2024", "3/15/2024", "9.9.1999", "2024-01-02"):
        new, _ = pseudonyms.pseudonymise(text, KEY)
        assert new != text and re.sub(r"\d", "0", new) == re.sub(r"\d", "0", text)
        assert pseudonyms.pseudonymise(new, KEY, back=True)[0] == text
    days = [f"{m}/{d}/2024" for m in range(1, 10) for d in range(1, 10)]
    assert len({pseudonyms.pseudonymise(d, KEY)[0] for d in days}) == len(days)


def test_what_only_looks_like_a_number_or_address_stays():
    text = "std::vector a::b f::g 12:30:45 1.555.123.4567 x555-123-4567 555-123.4567 2025-555-123-4567"
    assert pseudonyms.pseudonymise(text, KEY)[0] == text


def test_values_that_fail_their_check_stay():
    text = "4111111111111112 999.1.1.1 1.2.3.4.5 2023-02-30 000-12-3456 DE00 3704 0044 0532 0130 00 version 3.11.2"
    assert pseudonyms.pseudonymise(text, KEY)[0] == text


def test_pseudonyms_of_odd_rows(odd, nothing):
    rows = pseudonyms.pseudonyms(odd, KEY).collect()
    assert len(rows) == odd.count() and pseudonyms.pseudonyms(nothing, KEY).count() == 0
    before = {(r["doc_id"], r["text"]) for r in odd.select("doc_id", "text").collect()}
    assert {(r["doc_id"], r["text"]) for r in rows} == before  # none holds private data


TEXTS = [
    "Released under the MIT License.",
    "x mit LICENSE mit license, Apache-License; general_public license general public license",
    "This work is licensed under the GNU General Public License, version 3.",
    "Licensed under CC BY-NC 4.0.",
    "Licensed under the Apache License, Version 2.0.",
    "licensed to the mit, no license",
    None,
    "",
]


def brute_base(text):
    lower = re.sub("[A-Z]", lambda m: m[0].lower(), text or "")
    words = re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", lower)
    found = [
        (i, label)
        for phrase, label in licenses.BASE.items()
        for i in range(len(words))
        if words[i : i + len(phrase.split())] == phrase.split()
    ]
    at = [i for i, _ in found]
    return len(words), len(found), min(at, default=None), max(at, default=None), ",".join(sorted({x for _, x in found}))


def test_licences_against_brute_force(documents, odd, nothing):
    rows = licenses.licenses(documents(list(enumerate(TEXTS)))).collect()
    for r in rows:
        got = (r["n_words"], r["n_base"], r["first_word"], r["last_word"], r["base_labels"])
        assert got == brute_base(TEXTS[r["doc_id"]])
        assert set(filter(None, r["base_labels"].split(","))) <= set(filter(None, r["labels"].split(",")))
    labels = {r["doc_id"]: r["labels"] for r in rows}
    assert [labels[i] for i in (0, 2, 3, 4, 5, 6)] == ["mit", "gpl,gpl-3.0", "cc-by-nc", "apache,apache-2.0", "", ""]
    assert licenses.licenses(odd).count() == odd.count() and licenses.licenses(nothing).count() == 0


def longest(a, b, fits):
    """Longest common sequence of two word lists over the pairs that fit, by the plain table."""
    n = [[0] * (len(b) + 1) for _ in range(len(a) + 1)]
    for i in range(len(a)):
        for j in range(len(b)):
            n[i + 1][j + 1] = n[i][j] + 1 if a[i] == b[j] and fits(i - j) else max(n[i][j + 1], n[i + 1][j])
    return n[-1][-1]


def every_template(words, made, spread, slack):
    """Templates with enough words in order at offsets within ``spread`` of each other, without an index."""
    found = set()
    for t, notice in enumerate(made.words):
        for low in range(-len(notice), len(words)):
            same = sum(1 for q in range(len(notice)) for d in range(spread + 1) if 0 <= low + q + d < len(words) and words[low + q + d] == notice[q])
            if same < licenses.LEAST_MATCH * len(notice) or made.labels[t] in found:
                continue
            n = longest(words, notice, lambda d: low <= d <= low + spread)
            inside = licenses._stands(words, made.phrases[t], low - slack, low + spread + len(notice) + slack)
            if n >= licenses.LEAST_MATCH * len(notice) and inside:
                found.add(made.labels[t])
    return found


def test_index_finds_what_a_full_search_finds():
    made, rng = licenses.index(), random.Random(3)
    for t, (label, notice, phrase) in enumerate(licenses.TEMPLATES):
        words = licenses.words_of("some words before. " + notice.replace("under", "beneath", 1) + " and after")
        if len(words) < 60:
            for _ in range(2):  # words put in, not inside the mandatory phrase
                k = len(licenses.words_of(phrase))
                places = [i for i in range(len(words)) if not any(words[j : j + k] == licenses.words_of(phrase) for j in range(i - k + 1, i))]
                words.insert(rng.choice(places), b"inserted")
        idf = {w: 1.0 / len(p) for w, p in made.postings.items()}
        got = {found for found, _, _ in licenses.scan(words, set(words), made, idf)}
        assert label in got
        if len(words) < 60:
            assert every_template(words, made, licenses.DRIFT, 0) <= got <= every_template(words, made, 2 * licenses.DRIFT, 2)


def test_a_word_put_anywhere_into_a_notice_does_not_hide_it():
    made = licenses.index()
    notice = licenses.words_of(max((n for label, n, _ in licenses.TEMPLATES if label == "mit"), key=len))
    for at in range(0, len(notice), 7):
        words = [*notice[:at], b"inserted", *notice[at:]]
        found = licenses.scan(words, set(words), made, {})
        assert max(share for label, _, share in found if label == "mit") == 1.0


def test_scattered_words_of_a_notice_are_no_notice():
    made, rng = licenses.index(), random.Random(4)
    words = [w for n in made.words for w in n] * 3
    rng.shuffle(words)
    words += [b"gap"] * 300 + licenses.words_of("the mit license")
    assert licenses.scan(words, set(words), made, {}) == []


URLS = [
    "https://www.Example.com/en/1?x=/es/", "http://example.com/en/", "http://a.example.com/en", "ftp://b.net/es/q#://",
    "http://net/fr/", "http://xnet/fr/", "no scheme/en/", None, "", "http://c.com?en", "http://c.com", "http://sub.www.example.com/en/x",
    "http://free-bets.example.org/p/1", "http://plain.example.org/p/1",
]


def brute_rule(url):
    if not url or "://" not in url:
        return "", "", None
    rest = url.split("://", 1)[1]
    host = re.split(r"[/?#]", rest, maxsplit=1)[0]
    path = re.split(r"[?#]", rest[len(host) :], maxsplit=1)[0]
    host = re.sub("[A-Z]", lambda m: m[0].lower(), host)
    fits = [(len(h) + len(p), h + p) for _, h, p in url_rules.RULES if (host == h or host.endswith("." + h)) and path.startswith(p)]
    return host, path, max(fits)[1] if fits else None


def test_url_rules_against_brute_force(spark):
    rows = [(i, u, "<html>", "clash") for i, u in enumerate(URLS)]
    sites = [s for i in range(60) for s in ("free-bets", f"site{i % 3}")]
    rows += [(100 + i, f"http://{s}.example.org/p/{i}", "", "") for i, s in enumerate(sites)]
    pages = spark.createDataFrame(rows, "page_id long, url string, html string, tokens string")
    got = url_rules.judge(pages).collect()
    assert len(got) == len(rows)
    verdicts = {h + p: v for v, h, p in url_rules.RULES}
    for r in got:
        host, path, rule = brute_rule(rows[[x[0] for x in rows].index(r["page_id"])][1])
        assert (r["host"], r["path"], r["rule"]) == (host, path, rule)
        if rule:
            assert r["verdict"] == verdicts[rule]
    by = {r["page_id"]: r["verdict"] for r in got}
    assert by[12] == "block" and by[13] == "allow" and by[7] == "allow"
    empty = url_rules.judge(pages.limit(0))
    assert empty.count() == 0


def brute_rules(rows, support, hosts, confidence):
    """Every combination of up to three tokens of a blocked page, counted over all pages."""
    held = {h: r for h, r in rows["held"].items()}
    wanted = {c for t, _, bad in rows["pages"] if bad for n in (1, 2, 3) for c in itertools.combinations(sorted(t), n)}
    sure = {}
    for c in wanted:
        fits = [(h, bad) for t, h, bad in rows["pages"] if set(c) <= set(t)]
        here, there = [x for x in fits if not held[x[0]]], [x for x in fits if held[x[0]]]
        good = [h for h, bad in here if bad]
        if len(good) >= support and len(set(good)) >= hosts and len(good) >= confidence * len(here):
            if sum(bad for _, bad in there) >= confidence * len(there):
                sure[c] = len(good) / len(here)
    return sure


def test_mined_rules_against_counting(spark):
    rng = random.Random(6)
    pages = []
    for i in range(900):
        tokens = {f"t{rng.randrange(8)}" for _ in range(4)}
        if i % 3 == 0:
            tokens |= {"win", "prize"}
        bad = {"win", "t1"} <= tokens or rng.random() < 0.02
        pages.append((sorted(tokens), f"h{i % 23}", bad))
    rows = [(i, h, t, "block" if bad else "allow") for i, (t, h, bad) in enumerate(pages)] + [(-1, "h0", ["win"], None)]
    frame = spark.createDataFrame(rows, "_row long, host string, tokens array<string>, label string")
    held = {r["host"]: r["held"] for r in frame.select("host", (F.pmod(F.xxhash64("host"), F.lit(4)) == 0).alias("held")).collect()}
    want = brute_rules({"pages": pages, "held": held}, 10, 3, 0.9)
    got = {tuple(r["tokens"]): r["confidence"] for r in url_rules.mine(frame, 10, 0.9, 3).collect()}
    assert ("prize", "t1") in want and ("t1", "win") in want  # one and the same pages: a single token stands for both
    assert set(got) <= set(want) and ("prize", "t1") in got
    for c in want:  # every right combination is a rule, or a shorter or equal one says the same
        plain = {"prize" if t == "win" else t for t in c}
        assert any(set(g) <= plain and got[g] >= want[c] - 1e-12 for g in got), c


def test_mined_combinations_decide_hosts_without_a_seed(spark):
    urls = [f"http://{w}-{i % 9}.example.org/win/x/claim?prize={i}" for i in range(90) for w in ("casino", "free-bets")]
    urls += [f"http://plain{i % 5}.example.org/win/{i}" for i in range(60)]
    urls += [f"http://plain{i % 5}.example.org/claim/{i}" for i in range(60)]
    new = ["http://other.example.org/win/claim?q=1", "http://fresh.example.org/claim/win/"]
    rows = spark.createDataFrame([(i, u) for i, u in enumerate(urls + new)], "page_id long, url string")
    got = {r["page_id"]: r for r in url_rules.judge(rows).collect()}
    for i in range(len(urls), len(urls) + 2):
        assert got[i]["verdict"] == "block" and got[i]["mined"] > 0 and not got[i]["seeded"]
    assert {got[i]["verdict"] for i in range(180, 300)} == {"allow"}


def test_long_paths_give_few_combinations(spark):
    path = "/".join(f"w{chr(97 + i)}" for i in range(25))
    same = [(i, path.split("/"), True) for i in range(30)]
    frame = spark.createDataFrame(same, "_row long, tokens array<string>, bad boolean")
    assert url_rules.combinations(frame).count() == 1  # tokens of the same pages are one
    rng = random.Random(2)
    varied = [(i, rng.sample(path.split("/"), 16), True) for i in range(40)]
    frame = spark.createDataFrame(varied, "_row long, tokens array<string>, bad boolean")
    found = {tuple(r["tokens"]) for r in url_rules.combinations(frame, 10).collect()}
    counts = Counter(c for _, t, _ in varied for n in (1, 2, 3) for c in itertools.combinations(sorted(t), n))
    assert {c for c, n in counts.items() if n >= 10} <= found and len(found) < 4000


def test_hosts_over_a_line_break(spark):
    rows = spark.createDataFrame([(1, "a\nb://X.example.com/en/q\nr?z"), (2, "no\nscheme")], "page_id long, url string")
    got = {r["page_id"]: r for r in url_rules.judge(rows).collect()}
    assert (got[1]["host"], got[1]["path"], got[1]["rule"]) == ("x.example.com", "/en/q\nr", "example.com/en/")
    assert (got[2]["host"], got[2]["path"], got[2]["rule"]) == ("", "", None)


def test_card_or_account_before_other_signs():
    for value, after in (
        ("4111 1111 1111 1111", " 12/26"), ("4111 1111 1111 1111", " 4 5 61"), ("4111-1111-1111-1111", " 123"),
        ("DE89 3704 0044 0532 0130 00", " 2024"), ("BE68 5390 0754 7034", " 2024"), ("BE68539007547034", " ABCD"),
    ):
        new, spans = pseudonymise_once("pay " + value + after)
        assert value not in new and len(spans) == 1, value
        kind, a, b = spans[0]
        back = pseudonyms.replaced(kind, new[a:b], KEY, back=True)
        assert new[:a] + back + new[b:] == "pay " + value + after
    new, _ = pseudonymise_once("12 4111 1111 1111 1111")
    assert "4111 1111 1111 1111" not in new
    # a failed card that is another kind, and one inside a failed match
    new, spans = pseudonymise_once("DE00 4111 1111 1111 1111")
    assert "4111 1111 1111 1111" not in new and [k for k, _, _ in spans] == ["card"]


def pseudonymise_once(text):
    return pseudonyms.pseudonymise(text, KEY)


def test_all_notices_in_one_text():
    made = licenses.index()
    text = " and more words here. ".join(notice for _, notice, _ in licenses.TEMPLATES) + " affero mozilla granted binary"
    words = licenses.words_of(text * 2)
    for sign in (1, -1):
        idf = {w: sign * len(p) for w, p in made.postings.items()}
        found = {(label, begin) for label, begin, _ in licenses.scan(words, set(words), made, idf)}
        got = {label for label, _ in found}
        assert every_template(words, made, licenses.DRIFT, 0) <= got <= every_template(words, made, 2 * licenses.DRIFT, 2)
        assert len(found) >= 2 * len(licenses.TEMPLATES)
        alone = {w: 1.0 for w in made.postings}
        assert found == {(label, begin) for label, begin, _ in licenses.scan(words, set(words), made, alone)}


def test_rare_seeded_host_is_blocked_at_every_size(spark):
    rare = [f"http://cheap-viagra.example.org/p/{i}" for i in range(3)] + [f"http://loan.example.org/p/{i}" for i in range(12)]
    for n in (5, 200, 70_000):
        urls = rare + [f"http://site{chr(97 + i % 20)}.example.org/p/{i}" for i in range(n)]
        pages = spark.createDataFrame(list(enumerate(urls)), "page_id long, url string")
        rows = url_rules.judge(pages).collect()
        assert all((r["verdict"] == "block") == (r["page_id"] < len(rare)) for r in rows)
