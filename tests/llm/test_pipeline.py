import random
from collections import Counter

import pytest
from pyspark.sql import functions as F

pipeline = pytest.importorskip("corpus_pipeline")

from tests.llm import test_decontamination as leaks  # noqa: E402
from tests.llm import test_mixing_sharding as mixes  # noqa: E402
from tests.llm import test_quality as rules  # noqa: E402
from tests.llm import test_simhash as copies  # noqa: E402


def corpus():
    rng = random.Random(11)
    words = ["".join(rng.choices("abcdefghijk", k=4)) for _ in range(600)]
    text = lambda n: " ".join(rng.choices(words, k=n))
    items = [(k, text(rng.randrange(12, 30))) for k in range(6)]
    rows = [(i, text(rng.randrange(40, 120)), rng.choice(["a", "b", "hot", "hot", "hot", None])) for i in range(260)]
    rows += [(300 + i, t, s) for i, (_, t, s) in enumerate(rows[:30])]  # exact copies
    rows += [(400 + i, t + " end", s) for i, (_, t, s) in enumerate(rows[200:220])]  # nearly
    rows += [(500 + i, f"{text(60)} {items[i % 6][1]} {text(10)}", "b") for i in range(24)]
    rows += [(600 + i, text(80).replace(" ", "## "), "a") for i in range(60)]
    rows += [(700, None, "a"), (701, "", None), (702, "again and again " * 40, "b")]
    labels = [(i, int(i < 600), 0) for i, *_ in rows if i % 2 == 0]
    return rows, items, labels


def test_stages_against_brute_force(spark, documents, tables):
    rows, items, labels = corpus()
    folder = tables(documents=documents(rows), labels=spark.createDataFrame(labels, "doc_id long, quality int, toxic int"), benchmark=spark.createDataFrame(items, "item_id long, text string"))
    docs, kept = documents(rows), [(i, t, s) for i, t, s in rows]
    for (name, stage), number in zip(pipeline.STAGES, range(5), strict=True):
        out = stage(spark, docs, folder)
        if number < 4:
            assert out.columns == docs.columns, name
        got = [(r.doc_id, r.text, r.source) for r in out.collect()]
        if number == 0:
            want = [(i, t, s) for i, t, s in kept if (n := rules.slow_statistics(t))[0] >= 50 and 100 * n[4] <= 50 * n[0] and not 600 <= i < 700]
        elif number == 1:
            fps = [copies.slow_fingerprint(t) for _, t, _ in kept]
            want = [x for x, g in zip(kept, copies.slow_groups([i for i, *_ in kept], fps), strict=True) if x[0] == g]
            assert len(want) < len(kept)
        elif number == 2:
            want = [x for x in kept if not leaks.slow([x[:2]], items)]
            assert len(want) < len(kept)
        elif number == 3:
            sizes = Counter()
            for _, t, s in kept:
                sizes[s] += len((t or "").split())
            target = mixes.reshared(sizes)
            taken = Counter()
            for _, t, s in got:
                taken[s] += len((t or "").split())
            assert set(got) <= set(kept) and all(abs(taken[s] - target[s]) <= 120 for s in sizes)
            want = got
        else:
            per = Counter(r.shard for r in out.collect())
            assert max(per.values()) - min(per.values()) <= 1
            want = kept
        assert sorted(got, key=str) == sorted(want, key=str), name
        kept = got
        docs = spark.createDataFrame(out.collect(), out.schema)
    ran = pipeline.run(spark, folder)
    assert sorted(((r.doc_id, r.text, r.shard, r.slot) for r in ran.collect()), key=str) == sorted(((r.doc_id, r.text, r.shard, r.slot) for r in docs.collect()), key=str)


def test_empty_tables(spark, documents, tables):
    folder = tables(documents=documents([]), labels=spark.createDataFrame([], "doc_id long, quality int, toxic int"), benchmark=spark.createDataFrame([], "item_id long, text string"))
    assert pipeline.run(spark, folder).count() == 0


def test_extra_columns_survive(spark, documents, tables):
    rows, items, labels = corpus()
    docs = documents(rows[:80]).withColumn("_group", F.lit("mine")).withColumn("size", F.lit("x")).withColumn("kept", F.lit(1)).withColumn("fp", F.lit(2)).withColumn("row", F.lit(3))
    folder = tables(documents=docs, labels=spark.createDataFrame(labels, "doc_id long, quality int, toxic int"), benchmark=spark.createDataFrame(items, "item_id long, text string"))
    out = pipeline.run(spark, folder)
    assert out.columns == [*docs.columns, "shard", "slot"]
    assert {(r["_group"], r["size"], r.kept, r.fp, r["row"]) for r in out.collect()} == {("mine", "x", 1, 2, 3)}
