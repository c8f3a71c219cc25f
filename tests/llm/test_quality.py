import random

import numpy as np
from pyspark.sql import functions as F

from terrane.llm import quality


def slow_statistics(text):
    text = text or ""
    for c in "\t\x0b\x0c\r":
        text = text.replace(c, " ")
    words = [w for w in text.replace("\n", " ").split(" ") if w]
    lines, dup, seen = text.split("\n"), 0, set()
    for line in lines:
        if line.strip(" "):
            dup += line in seen
            seen.add(line)
    grams = [tuple(words[i : i + 3]) for i in range(len(words) - 2)]
    covered = {i + k for i, g in enumerate(grams) if grams.count(g) > 1 for k in range(3)}
    return len(words), sum(map(len, words)), sum(text.count(c) for c in "#*$%&|<>"), dup, len(covered)


def test_statistics_match_definition():
    rng = random.Random(1)
    texts = ["", None, " ", "a", "a b", "a b c", "a b c a b c", "a a a a", "é|ß <x>\n\n\né|ß <x>\n", "x\r\nx\nx\r\n \n \n"]
    texts += [" ".join(rng.choice(["a", "b", "c#", "dé", "\n", "e\nf"]) for _ in range(rng.randrange(80))) for _ in range(80)]
    for t in texts:
        assert quality.statistics(None if t is None else t.encode())[:5] == slow_statistics(t), t


def test_learner_finds_planted_rules():
    rng = np.random.default_rng(2)
    names = list(quality.FEATURES)
    x = rng.random((3000, len(names)))
    s, u, d = (names.index(n) for n in ("symbols_per_word", "upper_share", "dup_line_share"))
    bad = (x[:, s] > 0.8) | ((x[:, u] > 0.7) & (x[:, d] > 0.6))
    rules = quality.learn(x[:2000], bad[:2000])
    got = np.logical_or.reduce([quality.covers(r, x[2000:]) for r in rules])
    assert (got == bad[2000:]).mean() > 0.97
    assert quality.learn(x[:0], bad[:0]) == [] and quality.learn(x, np.zeros(3000, dtype=bool)) == []


def test_query_and_expression(spark, documents, tables):
    rng = random.Random(3)
    clean = lambda: " ".join("".join(rng.choices("abcdefgh", k=4)) for _ in range(rng.randrange(55, 90)))
    rows = [(i, clean() if i % 3 else clean().replace(" ", "$$ ")) for i in range(300)]
    rows += [(1000, None), (1001, ""), (1002, "too short"), (1003, "again and again " * 40), (1004, clean()), (1004, clean()), (None, clean())]
    docs = documents(rows).withColumn("_q", F.lit(1)).withColumn("kept", F.lit("clash"))
    labels = spark.createDataFrame([(i, int(i % 3 > 0), 0) for i in range(200)] + [(1, 1, 0), (250, None, 0), (251, 0, 0), (251, 1, 0)], "doc_id long, quality int, toxic int")
    got = sorted(quality.op2_quality(spark, tables(documents=docs, labels=labels)).collect(), key=lambda r: (r.doc_id is None, r.doc_id or 0))
    want = dict(rows[:-3])
    for r in got:
        if r.doc_id in want:
            assert tuple(r[1:6]) == slow_statistics(want[r.doc_id])
            assert r.base_failed == (r.n_words < 50 or 100 * r.n_repeat_words > 50 * r.n_words)
            assert r.kept == (r.doc_id < 300 and r.doc_id % 3 > 0)
    assert len(got) == len(rows) and got[-1].kept and [r.base_failed for r in got[300:304]] == [True] * 4
    none = quality.judged(docs.where("false"), quality.learn_rules(docs, labels.where("false")))
    assert none.count() == 0


def test_every_threshold_and_as_many_rules_as_there_are():
    rng = np.random.default_rng(5)
    x = rng.random((12_000, len(quality.FEATURES)))
    first = list(quality.FEATURES).index("chars_per_word")
    x[:, first] = np.arange(12_000) / 12_000
    bad = np.zeros(12_000, dtype=bool)
    for k in range(30):  # thirty narrow bands of one feature
        bad[400 * k + 100 : 400 * k + 160] = True
    rules = quality.learn(x, bad)
    got = np.logical_or.reduce([quality.covers(r, x) for r in rules])
    assert len(rules) > 24 and (got == bad).mean() > 0.99


def test_repeated_ids_are_read_within_the_bound(spark, documents):
    docs = documents([(1, f"text {k % 40}") for k in range(400)] + [(2, "another")])
    labels = spark.createDataFrame([(1, 1, 0), (2, 0, 0)], "doc_id long, quality int, toxic int")
    assert quality.labelled(docs, labels, 15).count() == 15 and quality.labelled(docs, labels, 1000).count() == 41
