import random
from collections import Counter, defaultdict
from fractions import Fraction

import duckdb
from pyspark.sql import functions as F

from terrane.llm import mixing, sharding


def reshared(sizes):
    """Targets by resharing again and again."""
    names = sorted(sizes, key=lambda s: (s is None, (s or "").encode()))
    weight = {s: i % 3 + 1 for i, s in enumerate(names)}
    target = dict.fromkeys(names, Fraction(0))
    rest, open_ = Fraction(sum(sizes.values())), set(names)
    while rest and open_:
        all_weights = sum(weight[s] for s in open_)
        for s in open_:
            target[s] += rest * weight[s] / all_weights
        rest = Fraction(0)
        for s in list(open_):
            if target[s] >= 3 * sizes[s]:
                rest += target[s] - 3 * sizes[s]
                target[s] = Fraction(3 * sizes[s])
                open_.discard(s)
    return target


def rows_of(rng, n):
    sources = ["b", "a", None, "é", "hot", "tiny", "empty"]
    return [(rng.randrange(n), None if rng.random() < 0.05 else "w " * (0 if s == "empty" else rng.randrange(30) if s != "tiny" else 1), s) for s in rng.choices(sources, [5, 5, 3, 4, 40, 1, 1], k=n)]


def test_targets_and_cut(spark, documents, tables):
    rng = random.Random(1)
    rows = rows_of(rng, 700)
    docs = documents(rows).withColumn("size", F.lit("clash")).withColumn("_group", F.lit(3))
    folder = tables(documents=docs)
    got = mixing.op1_mixing(spark, folder).collect()
    sizes = defaultdict(int)
    for _, t, s in rows:
        sizes[s] += len((t or "").split())
    want = reshared(sizes)
    taken = defaultdict(int)
    mixed = mixing.mix(docs).select("source", "target", "size", "taken", "copies").collect()
    for r in mixed:
        taken[r.source] += r.taken
        assert abs(r.target - want[r.source]) < 1e-6 * max(1, r.target) and 0 <= r.taken <= 3 * r.size and r.copies <= 3
    assert all(taken[s] == round(float(want[s])) or abs(taken[s] - want[s]) <= 0.5 for s in sizes)
    con = duckdb.connect()
    con.execute(f"CREATE VIEW documents AS SELECT * FROM read_parquet('{folder}/documents.parquet/*.parquet')")
    sql = con.execute(mixing.OP1_SQL).fetchall()
    assert Counter(tuple(r) for r in got) == Counter(sql)
    assert sorted(got) == sorted(mixing.op1_mixing(spark, folder).collect())
    copies = mixing.mixed(docs)
    assert copies.columns == docs.columns and copies.count() == sum(r.copies for r in mixed)


def test_mix_of_nothing(spark, documents):
    assert mixing.mix(documents([])).count() == 0
    assert [r.taken for r in mixing.mix(documents([(1, None), (2, " ")])).collect()] == [0, 0]
    assert [(r.target, r.taken) for r in mixing.mix(documents([(1, "a b")])).collect()] == [(2.0, 2)]


def test_shards_match_the_mixture(spark, documents):
    rng = random.Random(2)
    rows = rows_of(rng, 803)
    docs = documents(rows).withColumn("slot", F.lit("clash"))
    out = sharding.interleave(sharding.measured(docs)).collect()
    counts = Counter(r.shard for r in out)
    assert set(counts) == set(range(8)) and max(counts.values()) - min(counts.values()) <= 1
    for s, n in counts.items():
        assert sorted(r.slot for r in out if r.shard == s) == list(range(n))
    per = Counter((r.source, r.shard) for r in out)
    for source, n in Counter(s for *_, s in rows).items():
        assert all(abs(per[source, s] - n / 8) <= 2 for s in range(8))
    assert {(r.law, r.grown_shard) for r in out} == {("rows", None)}


def test_few_rows_and_none(spark, documents, tables, tmp_path):
    assert sharding.interleave(sharding.measured(documents([]))).count() == 0
    few = documents([(1, None), (None, ""), (1, None)])
    out = sharding.op7_sharding(spark, tables(documents=few)).collect()
    assert len(out) == 3 and {r["size"] for r in out} == {1} and {r.text_crc32 for r in out} == {0} and {r.slot for r in out} == {0}
    sharding.write_shards(few, f"{tmp_path}/shards")
    assert spark.read.parquet(f"{tmp_path}/shards").count() == 3
