"""Sharding, mixing, quality rules and personal data against plain Python."""

import hashlib
import random
import re
from collections import Counter

import pytest
from pyspark.sql import functions as F

from maskwright.llm import mixing, pii_votes, quality, sharding

TEXTS = [None, "", " \n\t", "one", "a b c a b c a b c", "x " * 400, "line\nline\n\nline two\n \nline", "Ünï cödé 😀 words #$%", "same", "same", "same"]


@pytest.fixture(scope="module")
def docs(spark):
    rng = random.Random(5)
    rows = [(i, t, "s0" if i % 2 else None, 1) for i, t in enumerate(TEXTS)]
    rows += [(100 + i, " ".join(rng.choice(["the", "of", "and", "to", "in", "a1"]) for _ in range(rng.randrange(1, 120))), f"s{min(i % 7, 3)}", 2) for i in range(200)]
    rows += [(100, rows[20][1], "s1", 2)] * 3 + [(None, "null id", "s2", 3)]
    return spark.createDataFrame(rows, "doc_id long, text string, source string, shard int")


def test_hypergeometric_matrix():
    rng = random.Random(1)
    mean = sum(sharding.hypergeometric(rng, 300, 700, 100) for _ in range(4000)) / 4000
    assert abs(mean - 30) < 0.4
    draws = Counter(sharding.hypergeometric(rng, 2, 2, 2) for _ in range(6000))
    assert abs(draws[1] / 6000 - 4 / 6) < 0.03 and abs(draws[0] / 6000 - 1 / 6) < 0.03
    assert sharding.hypergeometric(rng, 5, 0, 3) == 3 and sharding.hypergeometric(rng, 0, 5, 3) == 0
    m = sharding.communication_matrix([5, 0, 9, 3], [6, 6, 5], 3)
    assert [sum(r) for r in m] == [5, 0, 9, 3] and [sum(c) for c in zip(*m)] == [6, 6, 5]
    big = sharding.hypergeometric(rng, 10**11, 9 * 10**11, 10**6)
    assert abs(big - 10**5) < 2500
    with pytest.raises(ValueError):
        sharding.communication_matrix([1], [2], 0)


def test_shards(docs):
    out = sharding.hypergeometric_shuffle(docs, 8, min_partitions=5).collect()
    assert len(out) == docs.count() and out[0].__fields__ == ["doc_id", "text", "source", "shard", "slot"]
    sizes = Counter(r["shard"] for r in out)
    assert set(sizes) == set(range(8)) and max(sizes.values()) - min(sizes.values()) <= 1
    for s, n in sizes.items():
        assert sorted(r["slot"] for r in out if r["shard"] == s) == list(range(n))
    again = sharding.hypergeometric_shuffle(docs.repartition(7), 8, min_partitions=5).collect()
    key = lambda r: (str(r["doc_id"]), str(r["text"]), r["shard"], r["slot"])
    assert sorted(map(key, out)) == sorted(map(key, again))
    assert sharding.hypergeometric_shuffle(docs.limit(0)).count() == 0


def brute_targets(sizes):
    names = sorted((s for s in sizes if s is not None), key=lambda s: [ord(c) for c in s]) + [s for s in sizes if s is None]
    weights = {s: (3, 1, 2)[i % 3] for i, s in enumerate(names)}
    target, open_, left = dict.fromkeys(names, 0.0), set(names), 1.5 * sum(sizes.values())
    while open_ and left > 1e-9:
        share = left / sum(weights[s] for s in open_)
        full = {s for s in open_ if target[s] + share * weights[s] >= 2 * sizes[s]}
        if not full:
            for s in open_:
                target[s] += share * weights[s]
            break
        for s in full:
            left -= 2 * sizes[s] - target[s]
            target[s] = 2.0 * sizes[s]
        open_ -= full
    return target


def test_mixing(docs):
    out = mixing.mix_counts(docs).collect()
    assert len(out) == docs.count()
    words = lambda t: len(re.findall(r"[^\x20\x09-\x0D]+", t or ""))
    assert all(r["size"] == words(r["text"]) and r["taken"] == r["copies"] * r["size"] and 0 <= r["copies"] <= 2 for r in out)
    sizes = Counter()
    for r in out:
        sizes[r["source"]] += r["size"]
    want = brute_targets(sizes)
    for s, t in want.items():
        own = [r for r in out if r["source"] == s]
        assert all(abs(r["target"] - t) < 1e-6 and r["source_size"] == sizes[s] for r in own)
        assert abs(sum(r["taken"] for r in own) - t) <= 2 * max(r["size"] for r in own)
    mixed = mixing.mixed(docs)
    assert mixed.columns == docs.columns and mixed.count() == sum(r["copies"] for r in out)
    assert sorted(map(str, mixing.mix_counts(docs.repartition(3)).collect())) == sorted(map(str, out))
    assert mixing.mix_counts(docs.limit(0)).count() == 0


def brute_statistics(t):
    t = t or ""
    w = re.findall(r"[^\x20\x09-\x0D]+", t)
    windows = [tuple(w[i : i + 3]) for i in range(len(w) - 2)]
    times, again, seen, dup = Counter(windows), set(), set(), 0
    for i, x in enumerate(windows):
        if times[x] > 1:
            again |= {i, i + 1, i + 2}
    for line in t.split("\n"):
        if re.search(r"[^\x20\x09-\x0D]", line):
            dup += line in seen
            seen.add(line)
    return len(w), sum(map(len, w)), len(re.findall(r"[#*$%&|<>]", t)), dup, len(again)


def test_quality_statistics(docs):
    for r in quality.statistics(docs).collect():
        assert (r["n_words"], r["word_chars"], r["n_symbols"], r["n_dup_lines"], r["n_repeat_words"]) == brute_statistics(r["text"])


def test_quality_rules(spark):
    rng = random.Random(2)
    rows = [{f: rng.random() for f in quality.FEATURES} | {"part": k % 3} for k in range(600)]
    for r in rows:
        r["bad"] = int(r["symbol_share"] > 0.6 and r["mean_word"] < 0.5 or r["upper_share"] > 0.9)
    rules = quality.learn_rules(rows)
    told = [any(all(c.holds(r) for c in rule) for rule in rules) for r in rows]
    assert sum(a == bool(r["bad"]) for a, r in zip(told, rows)) > 0.95 * len(rows)
    df = spark.createDataFrame([tuple(r[f] for f in quality.FEATURES) for r in rows], ", ".join(f"{f} double" for f in quality.FEATURES))
    assert [r[0] for r in df.select(quality.verdict(rules)).collect()] == [not x for x in told]
    assert quality.learn_rules([]) == [] and spark.range(1).select(quality.verdict([])).first()[0]


def test_quality_judged(docs, spark):
    labels = spark.createDataFrame([(100 + i, i % 2, 0) for i in range(100)] + [(None, 1, 0), (7, None, None)], "doc_id long, quality int, toxic int")
    out = quality.judged(docs, quality.learn_from(docs, labels)).collect()
    assert len(out) == docs.count()
    for r in out:
        assert r["base_failed"] == (r["n_words"] < 50 or 100 * r["n_repeat_words"] > 50 * r["n_words"])
        assert not (r["base_failed"] and r["kept"])
    assert quality.judged(docs.limit(0), []).count() == 0 and quality.learn_from(docs, labels.limit(0)) == []


def luhn(d):
    return sum(int(c) if i % 2 == 0 else int(c) * 2 - 9 * (int(c) > 4) for i, c in enumerate(reversed(d))) % 10 == 0


def brute_spans(t):
    t, out = t or "", []
    digits = lambda m: re.sub("[^0-9]", "", m.group())
    for m in re.finditer(r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+", t):
        out.append((m.start(), 0, "email", m.end()))
    for m in re.finditer(r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)", t):
        if all(int(p) <= 255 for p in m.group().split(".")):
            out.append((m.start(), 1, "ip", m.end()))
    for m in re.finditer(r"[0-9]([\x20-]?[0-9])+", t):
        if 12 <= len(digits(m)) <= 19 and luhn(digits(m)):
            out.append((m.start(), 2, "card", m.end()))
    for m in re.finditer(r"\+[0-9][\x20().0-9-]+[0-9]", t):
        if 9 <= len(digits(m)) <= 15:
            out.append((m.start(), 3, "phone", m.end()))
    return sorted(out)


def test_personal_data(spark):
    rng = random.Random(4)
    parts = ["a@b.c", "x.y+z@q-r.co.uk", "+1 (499) 555-6503", "1.2.3.4", "300.1.1.1", "1.2.3.4.5.6", "4111 1111 1111 1111", "4111-1111-1111-1112", "😀", "1 2 3",
             "@", "a@b", "a@b.com+c@d.org", "+", "0001.2.3.004", "token = \"" + "0f" * 20 + "\"", "tel 212-555-0187", "123-45-6789", "word", "\n", "+4915112345678", "1" * 30]
    texts = ["".join(rng.choice(parts) + rng.choice(["", " ", ", ", "x"]) for _ in range(rng.randrange(1, 9))) for _ in range(400)]
    texts += [None, "", "9" * 5000, "a." * 3000, "1 " * 4000]
    df = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    for r in pii_votes.found(df, pii_votes.fit(df)).collect():
        want = brute_spans(r["text"])
        assert [(s["start"], s["rank"], s["kind"], s["stop"]) for s in r["base"]] == want
        assert all(a["stop"] <= w[0] or w[3] <= a["start"] for a in r["added"] for w in want)
    listed = ",".join(f"{k}:{a}:{z}" for a, _, k, z in brute_spans("a@b.c 1.2.3.4"))
    one = spark.createDataFrame([(1, "a@b.c 1.2.3.4")], "doc_id long, text string")
    got = pii_votes.found(one, {}).select(F.sha2(pii_votes.listed(F.col("base")).cast("binary"), 256)).first()[0]
    assert got == hashlib.sha256(listed.encode()).hexdigest()


def test_added_spans(spark):
    """Each kind by its own classifier; all accepted candidates without a base span over them, and no others."""
    yes = {k: [1.0] + [0.0] * 10 for k in pii_votes.ADDED}
    texts = ["tel 212-555-0187, ssn 123-45-6789", "x@" + "AB" * 16 + ".com " + "AB" * 16, "key sk-" + "a1" * 12 + " 4111-1111-1111-1111", "GB82 WEST 1234 5698 7654 32", None, ""]
    texts += ["".join(f"a{i}@b.com 212-555-{i:04d} " for i in range(3000))]
    df = spark.createDataFrame([(i, t, "old") for i, t in enumerate(texts)], "doc_id long, text string, Added string")
    got = {r["doc_id"]: r for r in pii_votes.found(df, yes).collect()}
    values = lambda k: [(s["kind"], texts[k][s["start"] : s["stop"]]) for s in got[k]["added"]]
    assert values(0) == [("local_phone", "212-555-0187"), ("ssn", "123-45-6789")]
    assert values(1) == [("secret", "AB" * 16)] and got[1]["added"][0]["start"] > 34
    assert values(2) == [("secret", "sk-" + "a1" * 12)] and values(3) == [("iban", texts[3])]
    assert got[4]["added"] == [] == got[5]["added"] and len(got[6]["base"]) == 3000 == len(got[6]["added"])
    assert [v for _, v in values(6)] == [f"212-555-{i:04d}" for i in range(3000)]
    assert not any(r["added"] for r in pii_votes.found(df, {}).collect())
    only = pii_votes.found(df.limit(1), {"ssn": yes["ssn"]}).first()["added"]
    assert [s["kind"] for s in only] == ["ssn"]


def test_personal_data_edges(spark):
    """Empty tables teach and hold nothing; repeated rows stay, each with its spans."""
    none = spark.createDataFrame([], "doc_id long, text string")
    assert pii_votes.fit(none) == {} and pii_votes.found(none, {}).count() == 0
    twice = spark.createDataFrame([(1, "token = \"" + "0f" * 20 + "\"")] * 40 + [(2, "commit " + "0f" * 20 + "-1")] * 10, "doc_id long, text string")
    rows = pii_votes.found(twice, pii_votes.fit(twice)).collect()
    assert len(rows) == 50 and all(len(r["added"]) == 1 for r in rows if r["doc_id"] == 1)


def test_votes_are_learned():
    good, bad = (1, 1, 1, 1, 0), (-1, -1, 0, -1, -1)
    counts = {good: 60.0, bad: 40.0, (1, 1, 0, 0, 0): 20.0, (1, -1, 0, -1, -1): 20.0}
    prior, chances = pii_votes.fit_reliabilities(counts)
    assert 0.4 < prior < 0.8 and chances[1][1][1] > 0.8 > 0.3 > chances[1][0][1]
    w = pii_votes.train_classifier(counts, prior, chances)
    score = lambda v: w[0] + sum(w[1 + j] * (x == 1) + w[6 + j] * (x == -1) for j, x in enumerate(v))
    assert score(good) > 0 > score(bad)
