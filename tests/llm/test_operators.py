"""The ten operators against brute force, round trips and held-out data."""

from __future__ import annotations

import hashlib
import sys
import zlib
from collections import defaultdict
from pathlib import Path

import numpy as np
import pandas as pd
import pytest
from pyspark.sql import functions as F

sys.path.insert(0, str(Path(__file__).parent))

import brute
from compare import differences

from marlstone.llm import bpe, html_text, language, near_copies, packing, pii, quality, registry, sharding, simhash, spotsigs, url_filter

SCHEMA = "doc_id long, text string, lang string, source string, n_chars long"
EDGES = [
    (0, None, None, None, None), (1, "", "en", "s", 0), (2, " \t\n\x0b ", "en", "s", 5), (3, "One", None, "s", 3), (4, "One", "en", None, 3), (4, "One", "en", None, 3),
    (None, "A null id has these few words here", "en", "s", 1), (5, "naïve İstanbul \u3000\n x\u00a0 y <|endoftext|>  z 東京 🙂", "en", "s", 9), (6, "a b c " * 5000, "en", "s", 30000),
    (7, "line one here\nline one here\n\nother line\n", "en", "s", 1), (8, "x" * 70000, "en", "s", 70000),
]


@pytest.fixture(scope="module")
def edges(spark):
    clash = spark.createDataFrame(EDGES, SCHEMA).withColumns({c: F.lit("clash") for c in ("fp", "k", "n", "row", "shard", "part", "group", "words", "vote_symbols", "n_email", "at", "__hits2")})
    return clash.repartition(3)


@pytest.fixture(scope="module")
def nothing(spark):
    return spark.createDataFrame([], SCHEMA)


@pytest.fixture(scope="module")
def docs(small):
    return pd.read_parquet(f"{small}/documents.parquet").sort_values("doc_id").reset_index(drop=True)


def rows(df):
    return [r.asDict() for r in df.collect()]


def test_simhash_equals_brute_force(spark, small, docs):
    got = registry.op1_simhash(spark, small).toPandas().sort_values("doc_id")
    fps = [brute.fingerprint(t) for t in docs.text]
    assert [f"{x:016x}" for x in fps] == list(got.fingerprint)
    assert [int(docs.doc_id[i]) for i in brute.components(fps, 2)] == list(got.component_id)


def test_simhash_links_are_exact_for_crowded_points(spark):
    """Points around a few centres, and far from all vantage points."""
    rng = np.random.default_rng(5)
    centres = rng.integers(0, 2**63, 40, dtype=np.uint64)
    flips = (np.uint64(1) << rng.integers(0, 64, (40, 60), dtype=np.uint64)) ^ (np.uint64(1) << rng.integers(0, 64, (40, 60), dtype=np.uint64))
    points = np.unique(np.concatenate([(centres[:, None] ^ flips).ravel(), rng.integers(0, 2**63, 2000, dtype=np.uint64)]))
    expected = brute.components(points.tolist(), 2)
    frame = spark.createDataFrame([(int(x),) for x in points.view(np.int64)], "fp long").repartition(5)
    parent = {int(x): int(x) for x in points.view(np.int64)}

    def root(x):
        while parent[x] != x:
            x = parent[x]
        return x

    for a, b in simhash.link(frame, 2).collect():
        parent[root(a)] = root(b)
    classes = defaultdict(set)
    for i, x in enumerate(points.view(np.int64).tolist()):
        classes[root(x)].add(i)
    truth = defaultdict(set)
    for i, c in enumerate(expected):
        truth[c].add(i)
    assert sorted(map(sorted, classes.values())) == sorted(map(sorted, truth.values()))


def test_simhash_edges(edges, nothing):
    got = rows(simhash.near_duplicates(edges))
    assert len(got) == len(EDGES)
    by = {r["doc_id"]: r for r in got}
    assert by[0]["fingerprint"] == by[1]["fingerprint"] == by[2]["fingerprint"] == "0" * 16
    assert by[2]["component_id"] == 0 and by[4]["component_id"] == 3 and by[None]["component_id"] is None
    for r in got:
        text = next(e[1] for e in EDGES if e[0] == r["doc_id"])
        assert r["fingerprint"] == f"{brute.fingerprint(text):016x}"
    assert simhash.near_duplicates(nothing).count() == 0


def test_components_of_a_long_path(spark):
    from marlstone.llm.components import components

    path = spark.createDataFrame([(i, i + 1) for i in range(200)] + [(500, 501), (7, 7)], "a long, b long")
    got = {r["node"]: r["root"] for r in components(path).collect()}
    assert all(got[i] == 0 for i in range(201)) and got[501] == 500


def near_copies_by_brute_force(texts):
    """The least index of each text's group."""
    sets = []
    for t in texts:
        words = (t or "").encode().lower().split()
        sets.append({tuple(words[i : i + 5]) for i in range(max(1, len(words) - 4))} if words else set())
    least = list(range(len(sets)))
    for i, x in enumerate(sets):
        for j in range(i):
            if 5 * len(x & sets[j]) >= 4 * len(x | sets[j]):
                a, b = sorted((least[i], least[j]))
                least = [a if c == b else c for c in least]
    return least


def test_sketches_never_tell_similar_sets_apart():
    rng = np.random.default_rng(3)
    for size in (1, 5, 60, 500, 3000):
        base = rng.integers(0, 2**64, size, np.uint64)
        for share in (0.0, 0.05, 0.3, 1.0):
            other = base[rng.random(size) >= share / 2]
            other = np.unique(np.concatenate([other, rng.integers(0, 2**64, int(share * size / 2), np.uint64)]))
            apart = len(np.setxor1d(base, other))
            assert near_copies.bits_apart(near_copies.sketch(base), near_copies.sketch(other)) <= apart
            assert int(np.bitwise_count(near_copies.parities(base).view("<u8") ^ near_copies.parities(other).view("<u8")).sum()) <= apart


def test_near_copies_with_edited_words_are_linked(spark, docs):
    """Documents, copies with some words replaced, and a crowd around one text."""
    rng = np.random.default_rng(7)
    texts = list(docs.text[:60])
    for share in (0.002, 0.01, 0.03, 0.06):
        for t in texts[:20]:
            words = t.split()
            texts.append(" ".join(f"w{rng.integers(10**9)}" if rng.random() < share else w for w in words))
    base = " ".join(f"b{i}" for i in range(120)).split()
    for _ in range(60):
        texts.append(" ".join(f"c{rng.integers(10**9)}" if rng.random() < 0.02 else w for w in base))
    texts += ["", None, " ", "one two", "One  two", "one three", "a b c d e", "a b c d f"]
    frame = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string").repartition(5)
    expected = near_copies_by_brute_force(texts)
    assert {r["doc_id"]: r["component_id"] for r in near_copies.near_copies(frame).collect()} == dict(enumerate(expected))
    assert len(set(expected)) < len(set(brute.components([brute.fingerprint(t) for t in texts], 2)))
    assert {r["doc_id"] for r in near_copies.one_of_each(frame).collect()} == set(expected)
    assert near_copies.one_of_each(frame.limit(0)).count() == 0


def test_near_copies_are_linked_by_fingerprints_and_checked(spark, monkeypatch):
    """Trees link all that is within their radius; of that stays what is similar."""
    rng = np.random.default_rng(11)
    some = lambda n: [f"w{rng.integers(10**9)}" for _ in range(n)]
    bits = lambda t: simhash.majority(near_copies.shingles(t))
    texts = []
    for _ in range(20):
        base = some(600)
        texts += [" ".join(base), " ".join(base[:300] + some(1) + base[301:]), " ".join(base + some(1))]
    # fingerprints that are near by chance, of sets that are not similar enough
    base = some(100)
    texts.append(" ".join(base))
    while (bits(" ".join(base)) ^ bits(other := " ".join(base + some(27)))).bit_count() > near_copies.RADIUS:
        pass
    texts.append(other)
    within = brute.components([bits(t) for t in texts], near_copies.RADIUS)
    exact = near_copies_by_brute_force(texts)
    assert within[-2:] == [len(texts) - 2] * 2 and exact[-2:] == [len(texts) - 2, len(texts) - 1]

    frame = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string").repartition(3)
    marked = near_copies.marks(frame)
    doc = {r["key"]: r["doc_id"] for r in marked.select("key", "doc_id").collect()}
    linked = list(range(len(texts)))
    for r in near_copies.by_fingerprint(marked).collect():
        x, y = sorted((linked[doc[r["a"]]], linked[doc[r["b"]]]))
        linked = [x if c == y else c for c in linked]
    assert linked == within
    found = lambda: {r["doc_id"]: r["component_id"] for r in near_copies.near_copies(frame).collect()}
    assert found() == dict(enumerate(exact))
    # without postings only the trees link, and what they link is checked
    postings = near_copies.postings
    monkeypatch.setattr(near_copies, "postings", lambda docs: postings(docs).limit(0))
    assert found() == dict(enumerate(within[:-1] + exact[-1:])) and any(c != i for i, c in enumerate(within[:-1]))


KEY = "a key of tests"
PERSONAL = "call +1 (743) 555-3824 or 152.143.123.131, pay 4785380592391139 or 4785 3805 9239 1139 not 2123465659789240; über.54@mail3.example.com token = \"24be64439e3e49cf46b2d7c90f3602a3d0b907ff\" DE89 3704 0044 0532 0130 00, born 1987-02-28, 12/31/1999, 31.12.1999, no 31.02.1999, ssn 123-45-6789 not 000-45-6789"


def luhn(digits):
    return sum(d if i % 2 == 0 else d * 2 - 9 * (d > 4) for i, d in enumerate(int(c) for c in reversed(digits))) % 10 == 0


def test_pii_keeps_formats_and_links(spark):
    import re

    frame = spark.createDataFrame([(1, PERSONAL), (2, "again " + PERSONAL), (3, "clean text of 12 words, 3.14 and 2024"), (4, None), (5, "")], "doc_id long, text string")
    got = {r["doc_id"]: r for r in rows(pii.pseudonymise(frame, KEY))}
    out = got[1]["text"]
    assert got[2]["text"] == "again " + out and got[3]["text"] == "clean text of 12 words, 3.14 and 2024" and got[4]["text"] is None and got[5]["text"] == ""
    for gone in ("743) 555-3824", "152.143.123.131", "4785380592391139", "4785 3805 9239 1139", "54@mail3", "24be64439e3e49cf46b2", "3704 0044", "1987-02-28", "12/31/1999", "31.12.1999", "123-45-6789"):
        assert gone not in out
    assert "2123465659789240" in out and "31.02.1999" in out and "000-45-6789" in out
    cards = re.findall(r"\b(\d{16}|\d{4} \d{4} \d{4} \d{4})\b", out)
    assert luhn(cards[0]) and cards[1].replace(" ", "") == cards[0]
    account = re.search(r"DE\d\d(?: \d{4}){4} \d\d", out)[0].replace(" ", "")
    assert int("".join(str(int(c, 36)) for c in account[4:] + account[:4])) % 97 == 1
    days = re.findall(r"\d{4}-\d\d-\d\d|\d\d/\d\d/\d{4}|\d\d\.\d\d\.\d{4}", out)
    parsed = [pd.to_datetime(d, format=f) for d, f in zip(days, ("%Y-%m-%d", "%m/%d/%Y", "%d.%m.%Y"))]
    assert parsed[1] == parsed[2]
    assert re.search(r'token = "[0-9a-f]{40}"', out) and re.search(r"\+1 \(\d{3}\) \d{3}-\d{4}", out)
    assert {k: v for k, v in got[1].items() if k.startswith("n_")} == {"n_secret": 1, "n_email": 1, "n_iban": 1, "n_ip": 1, "n_date": 3, "n_ssn": 1, "n_phone": 1, "n_card": 2}


def test_pii_finds_cards_and_ibans_among_other_numbers(spark):
    card, account = "4111111111111111", "ES9121000418450200051332"
    spaced, grouped = "4111 1111 1111 1111", "ES91 2100 0418 4502 0005 1332"
    texts = [f"{spaced} 12/26", f"{card} 123", "4111-1111-1111-1111 10 times", f"12 {card}", f"12345 {spaced}", f"{spaced} 5500 0000 0000 0004", f"{card} 2024-01-01", f"{spaced} 10x", f"{grouped} EUR", f"{account} EUR 500", f"AB12 {grouped} PAID", f"{grouped} {spaced}", "1234 5678 9012 3456 12/26", f"{spaced} 12/26/2024", " ".join(["12"] * 300)]
    got = {r["doc_id"]: r for r in rows(pii.pseudonymise(spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string"), KEY))}
    alone = {r["doc_id"]: r["text"] for r in rows(pii.pseudonymise(spark.createDataFrame([(0, card), (1, account), (2, "2024-01-01")], "doc_id long, text string"), KEY))}
    plain = {i: r["text"].replace(" ", "").replace("-", "") for i, r in got.items()}
    for i in (0, 1, 2, 3, 4, 5, 6, 7, 11, 13):
        assert alone[0] in plain[i] and card not in plain[i], texts[i]
    for i in (8, 9, 10, 11):
        assert alone[1] in plain[i] and account not in plain[i], texts[i]
    assert got[0]["text"].endswith(" 12/26") and got[3]["text"].startswith("12 ") and got[9]["text"].endswith(" EUR 500") and got[6]["text"].endswith(alone[2])
    assert "5500" not in got[5]["text"] and got[5]["n_card"] == 2 and "12/26/2024" not in got[13]["text"]
    assert got[12]["text"] == texts[12] and got[14]["text"] == texts[14]


def test_pii_finds_dates_of_timestamps(spark):
    frame = spark.createDataFrame([(1, "1987-02-28T10:00:00Z"), (2, "1987-02-28"), (3, "1987-02-28Tx")], "doc_id long, text string")
    got = {r["doc_id"]: r["text"] for r in rows(pii.pseudonymise(frame, KEY))}
    assert got[2] != "1987-02-28" and got[1] == got[2] + "T10:00:00Z" and got[3] == "1987-02-28Tx"


def test_pii_permutations_are_one_to_one(spark):
    frame = spark.range(20000).select(F.col("id"), F.lpad(F.col("id").cast("string"), 5, "0").alias("d"))
    moved = frame.select(pii.permuted_digits(F.col("d"), "key", "test").alias("m"), pii.feistel(F.col("id") % 17, F.floor(F.col("id") / 17), F.lit(17), F.lit(4297), "key", "test").alias("s"), pii.permuted_text(F.col("d"), "key", "t").alias("p"))
    counted = moved.agg(*(F.count_distinct(c) for c in ("m", "s", "p")), F.min(F.length("m")), F.max(F.length("m"))).first()
    assert tuple(counted) == (20000, 20000, 20000, 5, 5)


def test_pii_equals_brute_force(spark):
    """Each value through a Feistel network in plain Python."""
    rng = np.random.default_rng(11)
    n = lambda high, low=0: int(rng.integers(low, high))
    days = [(pd.Timestamp("1900-01-01") + pd.Timedelta(days=n(73049))) for _ in range(40)]
    values = [d.strftime("%Y-%m-%d") for d in days[:20]] + [f"{d.day}.{d.month}.{d.year}" for d in days[20:]]
    values += [f"{n(256)}.{n(256)}.{n(256)}.{n(256)}" for _ in range(60)] + [f"10.{n(256)}.{n(256)}.{n(256)}" for _ in range(10)] + [f"172.{n(32, 16)}.{n(256)}.{n(256)}" for _ in range(10)] + [f"192.168.{n(256)}.{n(256)}" for _ in range(10)]
    values += [f"+1 ({n(1000):03}) {n(1000):03}-{n(10000):04}" for _ in range(40)] + [f"{n(1000):03}-{n(1000):03}-{n(10000):04}" for _ in range(20)]
    values += [f"{n(1000):03}-{n(100):02}-{n(10000):04}" for _ in range(40)]
    got = {r["doc_id"]: r["text"] for r in rows(pii.pseudonymise(spark.createDataFrame(list(enumerate(values)), "doc_id long, text string"), KEY))}
    assert [got[i] for i in range(len(values))] == [brute.pseudonym(v, KEY) for v in values]


def test_pii_keeps_people_apart_and_formats(spark):
    texts = ["é@b.com", "ñ@b.com", "x@b.com", "b@x.com", "王@例.cn", "李@例.cn", "1.2.1999", "1/13/2020", "10.0.0.1", "127.0.0.1", "version 1.2.3.4", "v1.2.3.4", "000 000 0000", "+4915112345678", "30.02.2000", "ssn 900-12-3456"]
    found = pii.pseudonymise(spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string"), KEY)
    got = {texts[r["doc_id"]]: r for r in rows(found)}
    new = {t: r["text"] for t, r in got.items()}
    assert len(set(new.values())) == len(texts)
    assert all(new[t][0] != t[0] and not new[t].isascii() for t in ("é@b.com", "ñ@b.com", "王@例.cn"))
    assert new["1.2.1999"].count(".") == 2 and not new["1.2.1999"].startswith("0") and ".0" not in new["1.2.1999"] and "/0" not in new["1/13/2020"]
    assert new["10.0.0.1"].startswith("10.") and new["10.0.0.1"] != "10.0.0.1" and new["+4915112345678"].startswith("+49") and len(new["+4915112345678"]) == 14
    for stays in ("127.0.0.1", "version 1.2.3.4", "v1.2.3.4", "000 000 0000", "30.02.2000", "ssn 900-12-3456"):
        assert new[stays] == stays and not any(v for k, v in got[stays].items() if k.startswith("n_"))


def test_pii_takes_long_texts_and_clashing_columns(spark):
    long = "word " * 200000 + "call +1 (743) 555-3824"
    frame = spark.createDataFrame([(1, long, 7, 8), (1, long, 9, 10)], "doc_id long, text string, n_phone int, __hits int")
    kept = rows(pii.replaced(frame, KEY))
    assert [(r["n_phone"], r["__hits"]) for r in kept] == [(7, 8), (9, 10)] and {r["text"][-22:] for r in kept} != {long[-22:]} and {len(r["text"]) for r in kept} == {len(long)}
    assert pii.session_key(spark) == pii.session_key(spark)


def test_pii_edges(edges, nothing):
    assert pii.pseudonymise(edges, KEY).count() == len(EDGES) and pii.pseudonymise(nothing, KEY).count() == 0
    kept = pii.replaced(edges, KEY)
    assert kept.columns == edges.columns and {r["n_email"] for r in rows(kept)} == {"clash"}


def test_quality_counts_equal_brute_force(spark, small, docs, edges, nothing):
    got = registry.op3_quality(spark, small).toPandas().sort_values("doc_id")
    names = ["n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words"]
    assert [brute.base_counts(t) for t in docs.text] == [tuple(x) for x in got[names].values.tolist()]
    failed = (got.n_words < 50) | (100 * got.n_repeat_words > 50 * got.n_words)
    assert list(failed) == list(got.base_failed) and not (got.kept & got.base_failed).any()
    for r in rows(quality.judge(edges)):
        text = next(e[1] for e in EDGES if e[0] == r["doc_id"])
        assert brute.base_counts(text) == tuple(r[c] for c in names)
    assert quality.judge(nothing).count() == 0


def test_quality_agrees_with_labels(spark):
    sf = "/root/testdata/sf0.01"
    labels = spark.read.parquet(f"{sf}/labels.parquet")
    got = registry.op3_quality(spark, sf).filter("not base_failed").join(labels, "doc_id").groupBy("quality", "kept").count().collect()
    n = {(r["quality"], r["kept"]): r["count"] for r in got}
    assert n[(1, True)] >= 0.98 * (n[(1, True)] + n.get((1, False), 0)) and n[(0, False)] >= 0.9 * (n[(0, False)] + n.get((0, True), 0))


def votes_by_brute_force(text):
    import re
    import unicodedata

    n, chars, symbols, dups, repeats = brute.base_counts(text)
    lines = [x for x in (text or "").split("\n") if brute.WORD.search(x)]
    kinds = [unicodedata.category(c) for c in text or ""]
    letters = sum(k[0] in "LMN" for k in kinds)
    ends = len(re.findall(r"[.?!。！？।](?=[ \t\n\x0b\f\r)\]}»’”\"']|$)", text or ""))
    ratio = lambda a, b: a / b if b else None
    bad = lambda x, test: -1 if x is not None and test(x) else 0
    both = lambda x, good, test: 0 if x is None else -1 if test(x) else 1 if good(x) else 0
    return (
        bad(ratio(symbols, n), lambda x: x > 0.1), bad(ratio((text or "").count("!"), n), lambda x: x > 0.1), bad(ratio(kinds.count("Lu"), chars), lambda x: x > 0.35), bad(ratio(repeats, n), lambda x: x > 0.4),
        bad(ratio(dups, len(lines)), lambda x: x > 0.4), bad(ratio(chars, n), lambda x: not 2 <= x <= 14), both(ratio(letters, chars), lambda x: x > 0.93, lambda x: x < 0.87), both(ratio(ends, n), lambda x: 0.02 <= x <= 0.34, lambda x: x < 0.01 or x > 0.6),
    )


def test_quality_verdicts_equal_brute_force(spark, small, docs):
    """Expectation-maximisation over documents, not over patterns of votes."""
    votes = np.array([votes_by_brute_force(t) for t in docs.text])
    odds = np.log(4) + np.where(votes > 0, np.log(4), np.where(votes < 0, -np.log(16), 0)).sum(1)
    for _ in range(50):
        good = 1 / (1 + np.exp(-np.clip(odds, -50, 50)))
        prior = np.log((good.sum() + 1) / (len(good) - good.sum() + 1))
        odds = np.full(len(good), prior)
        for rule in votes.T:
            by = {v: (good[rule == v].sum() + 1, (1 - good)[rule == v].sum() + 1) for v in (1, 0, -1)}
            total = [sum(x[c] for x in by.values()) for c in (0, 1)]
            weight = {v: np.log(x[0] / total[0]) - np.log(x[1] / total[1]) for v, x in by.items()}
            odds = odds + np.where(rule > 0, max(weight[1], 0), np.where(rule < 0, min(weight[-1], 0), 0))
    expected = 1 / (1 + np.exp(-odds))
    got = registry.op3_quality(spark, small).toPandas().sort_values("doc_id").reset_index(drop=True)
    assert np.abs(got.posterior - expected).max() < 1e-6
    assert list(got.kept) == list(~got.base_failed & (expected >= 0.5))
    assert sorted(r["doc_id"] for r in rows(quality.keep_good(spark.read.parquet(f"{small}/documents.parquet")))) == sorted(got.doc_id[got.kept])


def test_quality_em_recovers_accuracies():
    rng = np.random.default_rng(1)
    counts = defaultdict(int)
    for _ in range(20000):
        good = rng.random() < 0.7
        counts[tuple((1 if (rng.random() < p) == good else -1) if rng.random() < 0.8 else 0 for p in (0.95, 0.8, 0.7, 0.9))] += 1
    prior, weights = quality.fit(sorted(counts.items()))
    assert abs(1 / (1 + np.exp(-prior)) - 0.7) < 0.05
    strength = [w[1] - w[-1] for w in weights]
    assert strength[0] > strength[3] > strength[1] > strength[2]


PAGE = """<html><head><title>A &amp; B</title><style>p{}</style><script>var t="</p>";</script></head><body hidden2>
<p>One <b>two</b>
 three<p>Next<br>line<ul><li>a<li>b<ol start=3><li>c<li>d</ol></ul><div style="display: none">gone</div><div hidden>gone</div>
<table><caption>Cap</caption><tr><th>Name<th>N<tr><td>long name<td>1<tr><td colspan=2>wide</table><pre>
  kept   spaces
</pre><noscript>gone</noscript><!-- gone --><dl><dt>t<dd>d</dl>tail &lt;x&gt;</body></html>"""


def test_html_layout():
    title, text = html_text.extract(PAGE)
    assert title == "A & B"
    assert text == "One two three\n\nNext\nline\n\n- a\n- b\n  3. c\n  4. d\n\nCap\nName       N\nlong name  1\nwide\n\n  kept   spaces\n\nt\n    d\n\ntail <x>"


@pytest.mark.parametrize("broken", [None, "", "<", "a < b", "<p", '<a href="x>text', "</p>", "<td>x", "<table><td>a</table>b", "<b>" * 5000 + "x", "<div>" * 3000 + "deep", "<table>" * 50 + "x", "<!-- open", "<script>var x", "&#xZZ; &unknown; &#0;", "<li>" * 3000])
def test_html_broken_markup(broken):
    title, text = html_text.extract(broken)
    assert isinstance(text, str) and title == ""


class Words:
    """Words that are shown, by the standard library's parser: no layout."""

    def __init__(self, page):
        from html.parser import HTMLParser

        self.found = found = []
        state = []

        class Parser(HTMLParser):
            def handle_starttag(self, tag, attrs):
                if tag in ("script", "style", "title", "noscript", "template"):
                    state.append(tag)

            def handle_endtag(self, tag):
                if state and state[-1] == tag:
                    state.pop()

            def handle_data(self, data):
                if not state:
                    found.extend(data.split())

        Parser(convert_charrefs=True).feed(page)


def test_html_has_the_words_of_another_parser(small):
    pages = pd.read_parquet(f"{small}/pages.parquet")
    for page in pages.html:
        marks = {"-", *(f"{i}." for i in range(100))}
        shown = [w for w in html_text.extract(page)[1].split() if w not in marks]
        assert "".join(shown) == "".join(w for w in Words(page).found if w not in marks)


@pytest.mark.parametrize(
    "page, text",
    [
        ("<table><tr>loose text<td>x", "loose text\nx"),
        ("<div style='visibility:hidden'>a<b style='visibility:visible'>B</b>c</div>", "B"),
        ("<style>.x{display:none} @media print{p{display:none}} @media screen{#k .y > b{display:none}}</style><p>p<i class=x>gone</i><div id=k><u class=y>u<b>gone</b><s><b>stays</b></s></u></div>", "p\n\nustays"),
        ("<style>p{display:none}p.a{display:block}p{display:none !important}</style><p class=a>gone", ""),
        ("<style>p{display:none}p.a{display:block}</style><p class=a>stays<p>gone<p style='display:inline'>stays", "stays\n\nstays"),
        ("<p hidden style='display:block'>seen<p hidden>gone", "seen"),
        ("<table>" * 12 + "<tr><td>a<td>b", "a  b"),
        ("<table><tr><td>" * 12 + "<table><tr><td>one<td>2<tr><td>3<td>four</table>", "one  2\n3    four"),
    ],
)
def test_html_visibility_and_tables(page, text):
    assert html_text.extract(page)[1] == text


def test_html_takes_time_in_proportion_to_the_page():
    import time

    for open_tag in ("<div>", "<ul><li>", "<table><tr><td>", "<b>", "<p>", "<div style='visibility:hidden'>"):
        began = time.process_time()
        assert html_text.extract(open_tag * 50000 + "<i style='visibility:visible'>end")[1].split()[-1] == "end"
        assert time.process_time() - began < 20


def test_html_edges(spark, small):
    frame = spark.createDataFrame([(1, None), (None, "<p>x"), (2, ""), (2, ""), (3, "<p>" + "word " * 50000)], "page_id long, html string").withColumn("text", F.lit("clash")).withColumn("k", F.lit(1)).withColumn("h", F.lit(1))
    got = rows(html_text.render_pages(frame))
    assert len(got) == 5 and {r["text"] for r in got if r["page_id"] in (1, 2)} == {""}
    assert html_text.render_pages(frame.limit(0)).count() == 0
    pages = registry.op4_html(spark, small)
    assert pages.count() == spark.read.parquet(f"{small}/pages.parquet").count() and pages.filter("text like '%track(%' or text like '%margin:0%'").count() == 0


def check_shards(frame, got, shards):
    texts = {(r["doc_id"], r["text"]) for r in frame}
    assert len(got) == len(frame)
    slots = defaultdict(list)
    for r in got:
        slots[r["shard"]].append(r["slot"])
    assert all(sorted(s) == list(range(len(s))) for s in slots.values()) and set(slots) <= set(range(shards))
    by_text = defaultdict(set)
    by = defaultdict(set)
    for doc, text in texts:
        by[doc].add(text or "")
    for r in got:
        if len(by[r["doc_id"]]) == 1:
            (text,) = by[r["doc_id"]]
            by_text[text].add(r["shard"])
            assert r["size"] == len(text.encode()) + 16 and r["text_crc32"] == zlib.crc32(text.encode())
    assert all(len(s) == 1 for s in by_text.values())


def test_sharding(spark, small, edges, nothing):
    frame = spark.read.parquet(f"{small}/documents.parquet")
    got = rows(registry.op5_sharding(spark, small))
    check_shards(rows(frame), got, 40)
    sizes = defaultdict(int)
    for r in rows(sharding.assign(frame, 4)):
        sizes[r["shard"]] += r["size"]
    assert max(sizes.values()) < 1.01 * min(sizes.values())
    check_shards(rows(edges), rows(sharding.assign(edges, 3)), 3)
    assert sharding.assign(nothing).count() == 0


def test_sharding_of_many_small_and_one_hot_group(spark):
    frame = spark.range(30000).select(F.col("id").alias("doc_id"), F.when(F.col("id") % 3 == 0, "hot text").otherwise(F.concat(F.lit("t"), "id")).alias("text"))
    got = rows(sharding.assign(frame, 4))
    check_shards(rows(frame), got, 4)


def test_simhash_deals_few_copies_of_points():
    rng = np.random.default_rng(1)
    for n, most in ((10**5, 3.0), (10**6, 4.0)):
        points = rng.integers(0, 2**64, n, np.uint64)
        shards = max(1, -(-n // simhash.SHARD), 8)
        nodes = simhash.grow(np.unique(points[: simhash.SAMPLE * shards]), 2, 1.5 * simhash.SAMPLE)
        sizes = [len(got) for _, got in simhash.deal(nodes, points, 2)]
        assert sum(sizes) < most * n and max(sizes) < 2 * simhash.SHARD


def test_simhash_links_of_many_points_are_exact(spark):
    rng = np.random.default_rng(4)
    base = rng.integers(0, 2**64, 20000, np.uint64)
    flips = (np.uint64(1) << rng.integers(0, 64, 20000, np.uint64)) | (np.uint64(1) << rng.integers(0, 64, 20000, np.uint64))
    points = np.unique(np.concatenate([base, base[:5000] ^ flips[:5000], base[:500] ^ flips[:500] ^ flips[5000:5500]]))
    frame = spark.createDataFrame(pd.DataFrame({"fp": points.view(np.int64)})).repartition(6)
    links = simhash.link(frame, 2).toPandas()
    parent = {int(p): int(p) for p in points.view(np.int64)}

    def root(x):
        while parent[x] != x:
            x = parent[x]
        return x

    for a, b in zip(links.a.tolist(), links.b.tolist()):
        parent[max(root(a), root(b))] = min(root(a), root(b))
    order = points.view(np.int64).tolist()
    for at in range(0, len(points), 2000):
        i, j = np.nonzero(np.bitwise_count(points[at : at + 2000, None] ^ points[None, :]) <= 2)
        assert all(root(order[x + at]) == root(order[y]) for x, y in zip(i.tolist(), j.tolist()))
    assert (np.bitwise_count(links.a.to_numpy(np.int64).view(np.uint64) ^ links.b.to_numpy(np.int64).view(np.uint64)) <= 8).all()


def lpt_by_brute_force(groups, shards):
    """Loads, and how many groups of each size each shard has, by plain LPT."""
    loads, counts = [0] * shards, defaultdict(lambda: [0] * shards)
    for size in sorted(groups, reverse=True):
        i = loads.index(min(loads))
        loads[i] += size
        counts[size][i] += 1
    return loads, counts


def test_sharding_schedules_all_groups_by_size(spark, small):
    rng = np.random.default_rng(2)
    for shards, most, n in ((1, 5, 300), (7, 3, 2000), (7, 900, 2000), (40, 2, 5000), (3, 10**6, 40)):
        groups = [*rng.integers(0, most, n).tolist(), 10**7]
        found = sharding.schedule([(s, groups.count(s)) for s in set(groups)], shards)
        _, counts = lpt_by_brute_force(groups, shards)
        for size, ends in found.items():
            got, last = [0] * shards, 0
            for i, end in ends:
                got[i], last = end - last, end
            assert sum(got) == sum(counts[size]) and (got == counts[size] or not size)
    frame = spark.read.parquet(f"{small}/documents.parquet").select("doc_id", "text")
    texts = [r["text"] for r in rows(frame)]
    groups = [(len(t.encode()) + 16) * texts.count(t) for t in set(texts)]
    loads = [0] * 9
    for r in rows(sharding.assign(frame, 9)):
        loads[r["shard"]] += r["size"]
    assert loads == lpt_by_brute_force(groups, 9)[0]


def test_url_filter_equals_sql(spark):
    sf = "/root/testdata/sf0.01"
    assert differences(registry.op6_url_filter(spark, sf), registry.oracle_sql()["op6_url_filter"], sf) == ""


def test_url_filter_nested_rules_and_edges(spark):
    rules = [("org", "/", "allow"), ("example.org", "/es/", "block"), ("a.example.org", "/es/x", "allow"), ("com", "", "block"), ("b.com", "/p", "allow"), ("b.com", "/p", "allow")]
    urls = [None, "", "no scheme.org/", "HTTP://EXAMPLE.ORG/es/1", "http://a.example.org/es/xy?q#f", "http://xexample.org/es/1", "http://b.com/p/q", "http://c.b.com/p", "http://b.com", "http://org", "http://org/", "x://com#a/b", "http://b.com/p/q", "http://bb.com/p", "http://" + "a." * 200 + "com/"]
    frame = spark.createDataFrame([(i if i != 5 else None, u) for i, u in enumerate(urls)], "page_id long, url string").withColumns({c: F.lit("clash") for c in ("host", "key", "rule", "stack")}).repartition(4)
    got = rows(url_filter.judge(frame, spark.createDataFrame(rules, "host string, path string, verdict string")))

    def brute_force(url):
        rest = url.split("://", 1)[1] if url and "://" in url else ""
        cut = min([rest.find(c) for c in "/?#" if c in rest] + [len(rest)])
        host, path = rest[:cut].lower(), rest[cut:].split("?")[0].split("#")[0]
        fits = [(len(h + p), len(h), h + p, v) for h, p, v in rules if (host == h or host.endswith("." + h)) and path.startswith(p)]
        best = max(fits, default=(0, 0, None, "allow"))
        return host, path, best[2], best[3]

    expected = sorted((repr(i if i != 5 else None), *map(repr, brute_force(u))) for i, u in enumerate(urls))
    assert sorted(tuple(repr(r[c]) for c in ("page_id", "host", "path", "rule", "verdict")) for r in got) == expected
    assert url_filter.judge(frame.limit(0), spark.createDataFrame(rules, "host string, path string, verdict string")).count() == 0
    assert {r["verdict"] for r in rows(url_filter.judge(frame, spark.createDataFrame([], "host string, path string, verdict string")))} == {"allow"}


def test_url_filter_with_ten_thousand_rules_of_one_host(spark):
    rng = np.random.default_rng(5)
    part = lambda: "/" + "".join(rng.choice(list("ab"), rng.integers(1, 3)))
    rules = sorted({(host, "".join(part() for _ in range(rng.integers(0, 9)))) for host in ["big.org"] * 11500 + ["sub.big.org"] * 500 + ["org"] * 50 for _ in (0,)})
    assert sum(h == "big.org" for h, _ in rules) >= 5000
    verdict = {r: "allow" if zlib.crc32("".join(r).encode()) % 2 else "block" for r in rules}
    urls = [f"http://{rng.choice(['big.org', 'x.sub.big.org', 'sub.big.org', 'other.org', 'big.com'])}{''.join(part() for _ in range(rng.integers(0, 10)))}" for _ in range(3000)]
    frame = spark.createDataFrame(list(enumerate(urls)), "page_id long, url string").repartition(3)
    got = rows(url_filter.judge(frame, spark.createDataFrame([(*r, v) for r, v in verdict.items()], "host string, path string, verdict string"), "none"))

    def brute_force(url):
        host, slash, rest = url.removeprefix("http://").partition("/")
        labels, path = host.split("."), slash + rest
        fits = [(len(h) + k, len(h), h + path[:k], verdict[h, path[:k]]) for i in range(len(labels)) for h in [".".join(labels[i:])] for k in range(len(path) + 1) if (h, path[:k]) in verdict]
        return max(fits, default=(0, 0, None, "none"))[2:]

    assert {r["page_id"]: (r["rule"], r["verdict"]) for r in got} == {i: brute_force(u) for i, u in enumerate(urls)}


def edited(texts, i):
    n = len(texts[i]) // 4
    return texts[i][: len(texts[i]) - n] + texts[(i + 1) % len(texts)][:n]


def spots_by_brute_force(text):
    """Each anchor with the next two words that are none, found from the front."""
    import re

    words = re.findall(r"\w+", text.lower())
    content = [(i, w) for i, w in enumerate(words) if w not in spotsigs.ANCHORS]
    found = set()
    for i, word in enumerate(words):
        alone = len(words) > i + 8 and not any(w in spotsigs.ANCHORS for w in words[i : i + 9])
        after = [w for j, w in content if j > i][:2] if alone or word in spotsigs.ANCHORS else []
        if len(after) == 2:
            found.add((word, *after))
    if not found:
        found = {tuple(words[i : i + 3]) for i in range(len(words) - 2)} or {(text[i : i + 3],) for i in range(len(text) - 2)} or {(text,)}
    return found


def test_spotsigs_equals_brute_force(spark, small, docs):
    got = registry.op7_spotsigs(spark, small).toPandas().sort_values("doc_id").reset_index(drop=True)
    texts = list(docs.text)
    assert list(got.doc_id) == list(docs.doc_id)
    for i, text in enumerate(texts[:80]):
        a, b, c = (spots_by_brute_force(t) for t in (text, edited(texts, i), texts[(i + 1) % len(texts)]))
        assert got.edited_sha256[i] == hashlib.sha256(edited(texts, i).encode()).hexdigest() and got.n_chars[i] == len(text)
        assert got.fingerprint[i].split("-")[0] == str(len(a)) and got.edited_fingerprint[i].split("-")[0] == str(len(b))
        for near, other in ((got.near_edited[i], b), (got.near_next[i], c)):
            exact = len(a & other) / len(a | other)
            assert near == (exact if exact >= spotsigs.LEAST else 0.0)
    for x in range(40):
        for y in range(x):
            assert (got.fingerprint[x] == got.fingerprint[y]) == (spots_by_brute_force(texts[x]) == spots_by_brute_force(texts[y]))
    assert (got.near_edited > got.near_next).mean() > 0.97


def test_spotsigs_of_ids_that_are_no_numbers(spark):
    texts = [f"the {i} quick foxes of {i + 1} the lazy dogs are {i * 7} here" for i in range(60)]
    frame = spark.createDataFrame([(f"doc-{i:05}", t) for i, t in enumerate(texts)], "doc_id string, text string").repartition(4)
    got = {r["doc_id"]: r["edited_sha256"] for r in rows(spotsigs.compare_with_next(frame))}
    assert [got[k] for k in sorted(got)] == [hashlib.sha256(edited(texts, i).encode()).hexdigest() for i in range(60)]
    dealt, n = spotsigs.with_next(frame, part_bytes=200)
    assert n > 3 and dealt.filter("not ahead").count() == 60


def test_spotsigs_over_many_ranges(spark, small, docs):
    frame = spark.read.parquet(f"{small}/documents.parquet").select("doc_id", "text")
    dealt, n = spotsigs.with_next(frame, part_bytes=1 << 15)
    assert n > 5 and dealt.filter("ahead").count() == n and dealt.filter("not ahead").count() == len(docs)


def test_spotsigs_edges(edges, nothing):
    got = rows(spotsigs.compare_with_next(edges))
    assert len(got) == len(EDGES) and sum(r["doc_id"] is None for r in got) == 1
    assert len({r["fingerprint"] for r in got if r["doc_id"] in (3, 4)}) == 1
    assert spotsigs.compare_with_next(nothing).count() == 0


def test_spotsigs_pairs_equal_brute_force(spark, small, docs):
    frame = spark.read.parquet(f"{small}/documents.parquet")
    got = {(r["a"], r["b"]): r["likeness"] for r in rows(spotsigs.near_pairs(frame, 0.6))}
    least = {}
    for doc, text in zip(docs.doc_id, docs.text):
        least.setdefault(frozenset(spotsigs.signatures(text)), doc)
    sets = sorted((d, s) for s, d in least.items())
    expected = {(a, b): len(x & y) / len(x | y) for i, (a, x) in enumerate(sets) for b, y in sets[i + 1 :] if len(x & y) >= 0.6 * len(x | y)}
    assert got.keys() == expected.keys() and all(abs(got[k] - v) < 1e-12 for k, v in expected.items())
    assert spotsigs.likeness({"a", "b", "c"}, {"a", "b", "d"}, 0.5) == 0.5 and spotsigs.likeness({"a"}, {"a", "b", "c"}, 0.5) == 0.0


def test_language_equals_brute_force(spark, small, docs):
    """Cosines of n-gram vectors with each centroid, one by one."""
    model = language.fit(spark.read.parquet(f"{small}/documents.parquet"))
    got = {r["doc_id"]: r for r in rows(language.predict(spark.read.parquet(f"{small}/documents.parquet"), model))}
    for doc, text in list(zip(docs.doc_id, docs.text))[:25]:
        raw = bytes(b if 97 <= b <= 122 or b > 127 else 32 for b in f" {text} ".lower().encode())
        while b"  " in raw:
            raw = raw.replace(b"  ", b" ")
        table = defaultdict(int)
        for n, factor in enumerate((2654435761, 2246822519, 3266489917, 668265263), 1):
            for i in range(len(raw) - n + 1):
                table[(int.from_bytes(raw[i : i + n], "big") * factor % 2**32) >> 19] += 1
        vector = {k: np.log1p(v) * model.idf[k] for k, v in table.items()}
        norm = sum(x * x for x in vector.values()) ** 0.5
        cosines = [(sum(x * float(point[k]) for k, x in vector.items()) / norm, name) for point, name in zip(model.points, model.names)]
        best = max(cosines)
        assert got[doc]["lang_pred"] == best[1] and abs(got[doc]["score"] - best[0]) < 1e-4


def test_language_ties_bounds_and_nothing_learned(spark, docs):
    model = language.Centroids(["aa", "bb"], np.ones((2, language.DIMENSIONS), np.float32) / language.DIMENSIONS**0.5, np.ones(language.DIMENSIONS, np.float32))
    assert model.nearest(["a tie of two"])[0][0] == "aa"
    many = spark.createDataFrame([(i, f"text number {i} of some words", f"l{i % 900}") for i in range(3000)], "doc_id long, text string, lang string")
    assert len(set(language.fit(many, most_texts=600).names)) <= language.LANGUAGES
    unlabelled = spark.createDataFrame([(1, "some words", None), (2, "12 34", None), (3, None, None)], "doc_id long, text string, lang string")
    assert [r["doc_id"] for r in rows(language.keep_known(unlabelled, language.fit(unlabelled)))] == [1]
    long = docs.text[0] * 500
    assert language.fit(many).nearest([long])[0][0] != "und"


def test_language_on_held_out(spark):
    got = registry.op8_language(spark, "/root/testdata/sf0.01").join(spark.read.parquet("/root/testdata/sf0.01/documents.parquet").select("doc_id", "lang"), "doc_id").toPandas()
    assert list(got.held_out) == [zlib.crc32(str(d).encode()) % 4 == 2 for d in got.doc_id]
    held = got[got.held_out]
    assert (held.lang == held.lang_pred).mean() > 0.98 and got.score.between(0, 1).all() and got.rejected.mean() < 0.01


def test_language_edges(spark, edges, nothing):
    model = language.fit(edges)
    got = {r["doc_id"]: r for r in rows(language.predict(edges, model))}
    assert all(got[i]["lang_pred"] == "und" and got[i]["score"] == 0 and got[i]["rejected"] for i in (0, 1, 2)) and got[6]["lang_pred"] == "en"
    empty = language.fit(nothing)
    assert {r["lang_pred"] for r in rows(language.predict(edges, empty))} == {"und"} and language.predict(nothing, model).count() == 0
    assert language.keep_known(edges, model).columns == edges.columns


def test_language_rejects_what_it_has_not_learned(spark):
    """Each language left out in turn, letters at random and base64; known texts stay."""
    import base64

    frame = pd.read_parquet("/root/testdata/sf0.1/documents.parquet")
    held = np.array([zlib.crc32(str(d).encode()) % 4 == 2 for d in frame.doc_id])
    learned = {x: [(x, language.counts(t)) for t in frame.text[~held & (frame.lang == x)][:250]] for x in sorted(set(frame.lang))}
    tested = {x: list(frame.text[held & (frame.lang == x)][:120]) for x in learned}
    rejected = lambda model, texts: np.mean([x[2] for x in model.nearest(texts)])
    for x in learned:
        assert rejected(language.train([r for y, rs in learned.items() if y != x for r in rs], 4), tested[x]) > 0.9, x
    model = language.train([r for rs in learned.values() for r in rs], 4)
    rng = np.random.default_rng(3)
    letters = ["".join(rng.choice(list("abcdefghijklmnopqrstuvwxyz   "), n)) for n in (100, 400, 1500) for _ in range(20)]
    assert rejected(model, letters) > 0.9 and rejected(model, [base64.b64encode(rng.bytes(n)).decode() for n in (100, 400, 1500) for _ in range(20)]) > 0.9
    assert rejected(model, [t for ts in tested.values() for t in ts]) < 0.02


def library(name):
    from tokenizers import Tokenizer

    return Tokenizer.from_file(registry.vocabulary(name))


def test_bpe_equals_library(spark, small, docs, edges, nothing):
    tokenizer = library("byte_bpe_50k.json")

    def expected(text):
        ids = tokenizer.encode(text or "", add_special_tokens=False).ids
        return len(ids), hashlib.sha256(np.array(ids, "<u4").tobytes()).hexdigest(), hashlib.sha256(tokenizer.decode(ids, skip_special_tokens=False).encode()).hexdigest()

    got = {r["doc_id"]: (r["n_tokens"], r["ids_sha256"], r["decoded_sha256"]) for r in rows(registry.op9_bpe(spark, small))}
    assert got == {d: expected(t) for d, t in zip(docs.doc_id, docs.text)}
    path = registry.vocabulary("byte_bpe_50k.json")
    again = {r["doc_id"]: (r["n_tokens"], r["ids_sha256"], r["decoded_sha256"]) for r in rows(bpe.digests(edges, path))}
    assert again == {e[0]: expected(e[1]) for e in EDGES}
    back = {r["doc_id"]: r["text"] for r in rows(bpe.decode(bpe.encode(edges, path), path))}
    assert back == {e[0]: e[1] or "" for e in EDGES}
    assert bpe.digests(nothing, path).count() == 0


def test_bpe_over_many_blocks(spark, small, docs, monkeypatch):
    """Blocks end after a few words; a word has one bucket."""
    monkeypatch.setattr(bpe, "BLOCK_WORDS", 300)
    path, frame = registry.vocabulary("byte_bpe_50k.json"), spark.read.parquet(f"{small}/documents.parquet")
    found = bpe.split(frame, "doc_id", "text", 16, True).collect()
    words = {(r["bucket"], x) for r in found for x in bpe._unpack_pieces(r["words"])}
    assert len({w for _, w in words}) == len(words) and len({r["block"] for r in found}) > 20
    tokenizer = library("byte_bpe_50k.json")
    got = {r["doc_id"]: r["ids"] for r in rows(bpe.encode(frame, path))}
    assert got == {d: tokenizer.encode(t, add_special_tokens=False).ids for d, t in zip(docs.doc_id, docs.text)}


def check_packing(frame, got, size=4096, end=2):
    tokenizer = library("word_bpe_49k.json")
    ids = defaultdict(list)
    for doc, text in frame:
        ids[doc].append(np.array([*tokenizer.encode(text or "", add_special_tokens=False).ids, end], "<u4"))
    windows, covered = defaultdict(list), defaultdict(int)
    for r in got:
        assert any(zlib.crc32(x[r["start"] : r["start"] + r["length"]].tobytes()) == r["ids_crc32"] and len(x) == r["doc_tokens"] for x in ids[r["doc_id"]])
        windows[r["sequence_id"]].append((r["offset"], r["length"]))
        covered[r["doc_id"]] += r["length"]
    assert covered == {d: sum(map(len, xs)) for d, xs in ids.items()}
    for pieces in windows.values():
        at = 0
        for offset, length in sorted(pieces):
            assert offset == at
            at += length
        assert at <= size
    return 1 - sum(covered.values()) / size / len(windows)


def test_packing(spark, small, docs, edges, nothing):
    assert check_packing(list(zip(docs.doc_id, docs.text)), rows(registry.op10_packing(spark, small))) < 0.02
    path = registry.vocabulary("word_bpe_49k.json")
    check_packing([e[:2] for e in EDGES], rows(packing.pack(edges, path)))
    check_packing([e[:2] for e in EDGES], rows(packing.pack(edges, path, window=64, open_windows=2)), size=64)
    assert packing.pack(nothing, path).count() == 0


def test_packing_equals_brute_force(spark, docs):
    """One partition, two open windows: best fit, the fullest emitted, one by one."""
    texts, path = list(docs.text[:60]), registry.vocabulary("word_bpe_49k.json")
    frame = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string").coalesce(1)
    got = [tuple(r[c] for c in ("doc_id", "start", "length", "sequence_id", "offset")) for r in rows(packing.pack(frame, path, window=700, open_windows=2))]
    tokenizer = library("word_bpe_49k.json")
    opened, windows, left = [], [], []
    for doc, text in enumerate(texts):
        total = len(tokenizer.encode(text, add_special_tokens=False).ids) + 1
        for start in range(0, total, 700):
            n = min(700, total - start)
            fits = [w for w in opened if sum(p[2] for p in w) + n <= 700]
            if fits:
                window = max(fits, key=lambda w: (sum(p[2] for p in w), -w[0][3]))
            else:
                if len(opened) == 2:
                    fullest = max(opened, key=lambda w: (sum(p[2] for p in w), -w[0][3]))
                    opened.remove(fullest)
                    windows.append(fullest)
                window = []
                opened.append(window)
            window.append((doc, start, n, len(windows) + len(opened) if not window else window[0][3]))
            if sum(p[2] for p in window) == 700:
                opened.remove(window)
                windows.append(window)
    left = sorted((p[:3] for w in opened for p in w), key=lambda p: (-p[2], p[0], p[1]))
    merged = []
    for p in left:
        fits = [w for w in merged if sum(x[2] for x in w) + p[2] <= 700]
        window = max(fits, key=lambda w: sum(x[2] for x in w)) if fits else merged.append([]) or merged[-1]
        window.append(p)
    expected = sorted(sorted(p[:3] for p in w) for w in windows + merged)
    by = defaultdict(list)
    for doc, start, n, sequence, offset in got:
        by[sequence].append((doc, start, n))
    assert sorted(sorted(w) for w in by.values()) == expected


def test_packing_of_ties_and_long_texts(spark):
    path = registry.vocabulary("word_bpe_49k.json")
    frame = [(1, "same words here"), (1, "same words here"), (2, "same words here"), (None, "same words here"), (3, "long text " * 60000)]
    shaped = spark.createDataFrame(frame, "doc_id long, text string").withColumn("part", F.lit("clash")).withColumn("length", F.lit(1))
    check_packing(frame, rows(packing.pack(shaped, path)))


def test_packing_over_many_partitions(spark, small, docs):
    frame = spark.read.parquet(f"{small}/documents.parquet").repartition(40)
    got = rows(packing.pack(frame, registry.vocabulary("word_bpe_49k.json"), open_windows=4))
    assert check_packing(list(zip(docs.doc_id, docs.text)), got) < 0.05
