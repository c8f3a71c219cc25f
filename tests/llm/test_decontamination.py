import random

import duckdb
import pytest
from pyspark.sql import functions as F

from terrane.llm import decontamination


def shingles(text, width):
    w = (text or "").lower().split()
    return {tuple(w[i : i + width]) for i in range(len(w) - width + 1)} if w else set()


def slow(rows, items):
    out = set()
    for i, t in rows:
        for k, b in items:
            width = min(5, len((b or "").split()))
            want = shingles(b, width)
            found = len(want & shingles(t, width))
            if want and 10 * found >= 8 * len(want):
                out.add((i, k, len(want), found))
    return sorted(out, key=str)


@pytest.mark.parametrize("broadcast_bytes", [32 << 20, -1])
def test_against_brute_force(spark, documents, monkeypatch, broadcast_bytes):
    monkeypatch.setattr(decontamination, "BROADCAST_BYTES", broadcast_bytes)
    rng = random.Random(7)
    words = [f"w{k}" for k in range(40)]
    text = lambda n: " ".join(rng.choices(words, k=n))
    items = [(k, text(rng.randrange(5, 70))) for k in range(30)] + [(30, "only four words here"), (31, "one"), (32, ""), (33, None), (3, text(20)), (None, text(9))]
    rows = []
    for i in range(150):
        _, b = rng.choice(items[:30])
        parts = b.split()
        for _ in range(rng.randrange(4)):
            parts[rng.randrange(len(parts))] = rng.choice(["changed", parts[0].upper()])
        middle = " ".join(parts)
        if rng.random() < 0.3:  # in two pieces, far apart
            middle = " ".join(parts[: len(parts) // 2 + 4]) + " " + text(300) + " " + " ".join(parts[len(parts) // 2 :])
        rows.append((i, text(rng.randrange(200)) + rng.choice([" ", "\n"]) + middle + " " + text(rng.randrange(50))))
    rows += [(900, None), (901, ""), (902, "ONLY four\twords here"), (903, "one"), (904, "one two"), (906, "before only four words HERE after it"), (907, "only four words and here"), (908, text(60_000) + " one"), (None, items[0][1]), (905, items[-1][1]), (5, items[1][1]), rows[0], rows[0]]
    docs = documents(rows).withColumn("row", F.lit("clash")).withColumn("_w", F.lit(1)).withColumn("item_id", F.lit(2))
    bench = spark.createDataFrame(items, "item_id long, text string").withColumn("need", F.lit("clash"))
    got = sorted({(r.doc_id, r.item_id, r.n_shingles, r.n_found) for r in decontamination.contained(docs, bench).collect()}, key=str)
    want = slow(rows, items)
    assert got == want and len(want) > 60
    assert {(906, 30, 1, 1), (903, 31, 1, 1), (908, 31, 1, 1)} <= set(got) and 907 not in {r[0] for r in got}
    con = duckdb.connect()
    con.register("documents", docs.select("doc_id", "text").toArrow())
    con.register("benchmark", bench.select("item_id", "text").toArrow())
    told = con.execute(f"SELECT DISTINCT doc_id, item_id, n_shingles, n_found FROM ({decontamination.OP8_SQL})").fetchall()
    assert sorted(told, key=str) == want
    hit = {(i, t) for i, t in rows if slow([(i, t)], items)}
    kept = decontamination.clean(docs, bench)
    assert kept.columns == docs.columns
    assert sorted(((r.doc_id, r.text) for r in kept.collect()), key=str) == sorted(((i, t) for i, t in rows if (i, t) not in hit), key=str)


def test_empty_tables(spark, documents):
    none = spark.createDataFrame([], "item_id long, text string")
    some = spark.createDataFrame([(1, "a b c d e f")], "item_id long, text string")
    docs = documents([(1, "x a b c d e f")])
    assert decontamination.contained(docs, none).count() == 0 and decontamination.clean(docs, none).count() == 1
    assert decontamination.contained(docs.where("false"), some).count() == 0 and decontamination.contained(docs, some).count() == 1
