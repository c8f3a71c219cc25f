import random

import numpy as np
import xxhash
from pyspark.sql import functions as F

from terrane.llm import simhash
from terrane.llm.components import components


def slow_fingerprint(text):
    lowered = "".join(c.lower() if "A" <= c <= "Z" else c for c in text or "")
    for c in "\t\n\x0b\x0c\r":
        lowered = lowered.replace(c, " ")
    words = [w for w in lowered.split(" ") if w]
    shingles = [" ".join(words[i : i + 4]) for i in range(len(words) - 3)] or ([" ".join(words)] if words else [])
    hashes = [xxhash.xxh64_intdigest(s.encode(), 42) for s in shingles]
    return sum(1 << b for b in range(64) if sum(h >> b & 1 for h in hashes) * 2 > len(hashes))


def slow_groups(ids, fps, radius=4):
    root = list(range(len(fps)))

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    for i in range(len(fps)):
        for j in range(i):
            if (fps[i] ^ fps[j]).bit_count() <= radius:
                root[find(i)] = find(j)
    least = {}
    for i, x in enumerate(ids):
        least[find(i)] = min(least.get(find(i), x), x)
    return [least[find(i)] for i in range(len(fps))]


def test_fingerprint_matches_definition():
    rng = random.Random(1)
    texts = ["", None, "a", "A b C", "one two three four", " x\t\ny  z w v ", "ÄÖ É ß K ſ i̇"]
    texts += [" ".join(rng.choice(["the", "Of", "and", "é", "x"]) for _ in range(rng.randrange(1, 60))) for _ in range(60)]
    assert [simhash.fingerprint(None if t is None else t.encode()) for t in texts] == [slow_fingerprint(t) for t in texts]


def test_spark_hash_is_the_same(spark):
    row = spark.range(1).select(F.xxhash64(F.lit("the of and é")).alias("h")).first()
    assert row.h % 2**64 == xxhash.xxh64_intdigest("the of and é".encode(), 42)


def random_fps(rng, n):
    fps = []
    while len(fps) < n:
        base = rng.getrandbits(64)
        for _ in range(rng.randrange(1, 8)):
            fps.append(base)
            for _ in range(rng.randrange(4)):
                base ^= 1 << rng.randrange(64)
    return fps[:n]


def test_links_lose_nothing(spark):
    rng = random.Random(2)
    fps = sorted(set(random_fps(rng, 500)))
    signed = [(x - (1 << 64) if x >> 63 else x,) for x in fps]
    nodes = spark.createDataFrame(signed, "fp long")
    for tile in (2048, 3):  # 3: nearly every tile is cut
        got = {r.node % 2**64: r.root for r in components(simhash.links(nodes, tile=tile)).collect()}
        want = slow_groups(list(range(len(fps))), fps)
        roots = {}
        for x, g in zip(fps, want, strict=True):
            roots.setdefault(g, set()).add(got.get(x, ("alone", x)))
        assert all(len(r) == 1 for r in roots.values())
        assert len({next(iter(r)) for r in roots.values()}) == len(roots)


def test_one_hot_tile(spark):
    rng = np.random.default_rng(3)
    low = rng.choice(2**18, 6000, replace=False).astype(np.int64)  # all agree in most segments
    nodes = spark.createDataFrame([(int(x),) for x in low], "fp long")
    got = {r.node: r.root for r in components(simhash.links(nodes, tile=500)).collect()}
    assert len(got) == len(low) and len(set(got.values())) == 1  # a dense cube is connected at radius 4


def test_finer_segments(spark):
    assert [len(simhash.segment_masks(4, n)) for n in (10, 10**6, 10**9, 10**12)] == [5, 15, 35, 70]
    rng = random.Random(4)
    fps = random_fps(rng, 300)
    for masks in map(lambda n: simhash.segment_masks(4, n), (10, 10**6, 10**9, 10**12)):
        for x in fps[:50]:
            y = x
            for b in rng.sample(range(64), 4):
                y ^= 1 << b
            assert any((x ^ y) & m % 2**64 == 0 for m in masks)


def test_components_of_a_chain(spark):
    edges = spark.createDataFrame([(i, i + 1) for i in range(60)] + [(100, 101), (101, 100), (7, 7)], "a long, b long")
    got = {r.node: r.root for r in components(edges).collect()}
    assert got == {**dict.fromkeys(range(61), 0), 100: 100, 101: 100}


def test_query_against_brute_force(spark, documents, tables):
    rng = random.Random(5)
    base = [" ".join(rng.choice(["alpha", "beta", "gamma", "delta", "eps"]) + str(rng.randrange(9)) for _ in range(80)) for _ in range(12)]
    rows = [(i, rng.choice(base)) for i in range(5, 60)] + [(i, (b := rng.choice(base)) + " tail " + b[:3]) for i in range(60, 90)]
    rows += [(90, None), (91, ""), (92, "  \n"), (93, "one"), (93, "one"), (3, "x " * 30000)]
    out = simhash.op3_simhash(spark, tables(documents=documents(rows)))
    got = sorted((r.doc_id, r.fingerprint, r.component_id) for r in out.collect())
    fps = [slow_fingerprint(t) for _, t in rows]
    want = slow_groups([i for i, _ in rows], fps)
    assert got == sorted((i, f"{f:016x}", g) for (i, _), f, g in zip(rows, fps, want, strict=True))


def test_nulls_and_empty(spark, documents, tables):
    rows = [(None, "a b c d e"), (None, None), (4, None)]
    df = documents(rows).withColumn("fp", F.lit("clash")).withColumn("_th", F.lit(1)).withColumn("component_id", F.lit(0))
    assert sorted(((r.doc_id, r.component_id) for r in simhash.grouped(df).collect()), key=str) == sorted([(None, None), (None, 4), (4, 4)], key=str)
    assert sorted(r.text or "" for r in simhash.survivors(df).collect()) == ["", "a b c d e"]
    assert simhash.grouped(df.where("false")).count() == 0 and simhash.survivors(df.where("false")).count() == 0


def test_survivors_keep_one_of_each(spark, documents):
    rows = [(3, "p q r s t"), (1, "p q r s t"), (1, "p q r s t"), (2, "other words are here now"), (9, "p q r s t")]
    assert sorted((r.doc_id, r.text) for r in simhash.survivors(documents(rows)).collect()) == [(1, "p q r s t"), (2, "other words are here now")]


def test_survivors_of_null_and_shared_ids(spark, documents):
    texts = ["p q r s t", "other words are here now", "a third text of its own", "nothing like the ones before it"]
    rows = [(None, texts[0]), (None, texts[1]), (None, texts[1]), (7, texts[2]), (7, texts[3]), (8, texts[3])]
    kept = [(r.doc_id, r.text) for r in simhash.survivors(documents(rows)).collect()]
    assert sorted(kept, key=str) == sorted([(None, texts[0]), (None, texts[1]), (7, texts[2]), (7, texts[3])], key=str)
