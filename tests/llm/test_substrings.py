import hashlib
import random
from collections import Counter

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from terrane.llm import substrings


def slow(rows):
    texts = [(i, (t or "").encode().split()) for i, t in rows]
    least = {}
    for i, w in texts:
        for k in range(len(w) - 12):
            if i is not None:
                g = tuple(w[k : k + 13])
                least[g] = min(least.get(g, i), i)
    out = []
    for i, w in texts:
        gone = {k + j for k in range(len(w) - 12) if i is not None and least[tuple(w[k : k + 13])] < i for j in range(13)}
        kept = b" ".join(x for k, x in enumerate(w) if k not in gone)
        out.append((i, len(w), len(gone), hashlib.sha256(kept).hexdigest()))
    return sorted(out, key=str)


def corpus(rng, n):
    vocabulary = ["w%d" % k for k in range(300)] + ["the"] * 60
    passages = [" ".join(rng.choices(vocabulary, k=rng.randrange(10, 60))) for _ in range(8)] + ["the " * 30, "la la di " * 20]
    rows = []
    for i in rng.sample(range(5 * n), n):
        parts = [" ".join(rng.choices(vocabulary, k=rng.randrange(0, 40))) for _ in range(3)]
        parts[1:1] = rng.choices(passages, [9, 1, 1, 1, 1, 1, 1, 1, 1, 1], k=rng.randrange(0, 3))
        rows.append((i, rng.choice([" ", "\n", " \t "]).join(parts)))
    return rows


@pytest.mark.parametrize("few", [0, 4])
def test_against_brute_force(spark, documents, tables, monkeypatch, few):
    rng = random.Random(few)
    rows = corpus(rng, 400)
    rows += [(i + 10_000, t) for i, t in rng.sample(rows, 40)] + rows[:3]
    rows += [(None, rows[0][1]), (50_000, None), (50_001, ""), (50_002, "x " * 12), (50_003, "x " * 13), (50_004, "x " * 20_000), (50_005, "é ß " * 9), (50_006, "  " + "z" * 70_000 + " y" * 20 + "\v")]
    docs = documents(rows).withColumn("n", F.lit("clash")).withColumn("row", F.lit(0)).withColumn("kept", F.lit(0))
    monkeypatch.setattr(substrings, "FEW", few)
    if not few:  # every bucket that the sample sees counts as hot; texts, batches, bins and slices are cut small
        for name, value in {"HOT_LEAST": 1, "BATCH_BYTES": 20_000, "PIECE_BYTES": 3_000, "PIECE_WORDS": 50, "BIN_BYTES": 20_000, "SLICE_BYTES": 500}.items():
            monkeypatch.setattr(substrings, name, value)
        rows.append((rows[5][0], rows[9][1]))  # one id, two texts
        docs = documents(rows)
    out = substrings.op9_substrings(spark, tables(documents=docs)).collect()
    assert sorted(((r.doc_id, r.n_words, r.n_removed, r.kept_sha256) for r in out), key=str) == slow(rows)


def test_many_copies_of_one_id(spark, documents):
    text = " ".join(f"w{k % 40}" for k in range(60))
    docs = documents([(7, text)] * 500 + [(3, text)])
    out = substrings.cut(docs).groupBy("doc_id", "n_removed").count().collect()
    assert sorted(map(tuple, out)) == [(3, 0, 1), (7, 60, 500)]


def test_equal_fingerprints_of_unequal_windows(monkeypatch):
    rng = np.random.default_rng(5)
    word = rng.integers(0, 2, 400).astype(np.int32)
    begin = np.arange(0, 380)
    kinds = lambda: len({tuple(word[b : b + 13]) for b in begin.tolist()})
    for prime in (substrings.FINGERPRINT, np.uint64(0)):  # 0: windows with one last word collide
        monkeypatch.setattr(substrings, "FINGERPRINT", prime)
        order, new = substrings._sorted_windows(word, begin)
        assert sorted(order.tolist()) == begin.tolist() and new.sum() == kinds()
        heads = np.flatnonzero(new).tolist()
        for a, b in zip(heads, [*heads[1:], len(order)], strict=True):
            assert len({tuple(word[begin[i] : begin[i] + 13]) for i in order[a:b]}) == 1


def test_no_rows(spark, documents):
    assert substrings.cut(documents([])).count() == 0


def test_a_minimiser_is_the_windows_own():
    rng = random.Random(3)
    words = [rng.choice(["a", "b", "cc", "d%d" % rng.randrange(50)]) for _ in range(200)]
    hashes = lambda w: substrings.word_hashes(*substrings.cut_words([" \t\n".join(w).encode()])[:2])
    whole = hashes(words)
    least = substrings.minimisers(whole)
    assert len(least) == 188
    for k in range(188):
        assert substrings.minimisers(hashes(words[k : k + 13]))[0] == least[k]
    start, count, _ = substrings.super_kmers(whole, np.repeat([0, 1], 100), None)
    assert sum(count) == 2 * 88 and start[0] == 0
    assert set(start.tolist()).isdisjoint(range(88, 100))


def test_pieces_and_slices(monkeypatch):
    """Texts cut into small pieces and bins judged in small slices give what brute force does."""
    for name, value in {"PIECE_BYTES": 2_000, "PIECE_WORDS": 40, "SLICE_BYTES": 300, "BATCH_BYTES": 30_000}.items():
        monkeypatch.setattr(substrings, name, value)
    rows = [(i, t) for i, t in corpus(random.Random(9), 120)]
    batch = pa.RecordBatch.from_pydict({"doc_id": pa.array([i for i, _ in rows], pa.int64()), "tag": pa.array([0] * len(rows), pa.int64()), "text": pa.array([t.encode() for _, t in rows], pa.binary())})
    packed = pa.Table.from_batches(list(substrings._packer(None, 3)(iter([batch])))).sort_by("bin")
    found = pa.Table.from_batches(list(substrings._resolver(iter(packed.to_batches(max_chunksize=7))))).to_pylist()
    verdicts = {r["ref"]: r["blob"] for r in found if r["kind"] == 1}
    parked = [(r["blob"], verdicts[r["ref"]]) for r in found if r["kind"] == 2 and r["ref"] in verdicts]
    joined = pa.RecordBatch.from_arrays([pa.array(c, pa.binary()) for c in zip(*parked, strict=True)], names=["places", "least"])
    runs = [(r["doc"], r["start"], r["n"]) for r in found if r["kind"] == 0] + [(r["doc"], r["start"], r["n"]) for b in substrings._unpark(iter([joined])) for r in b.to_pylist()]
    gone = {(i, k) for i, s, n in runs for k in range(s, s + n)}
    assert {(i, n) for i, n in Counter(i for i, _ in gone).items()} == {(i, n) for i, _, n, _ in slow(rows) if n}


def test_a_spread_passage_makes_few_runs(spark, documents, tables, monkeypatch):
    """Windows of hot minimisers travel singly; where their copies are parked, they make runs of a passage and not of a window."""
    monkeypatch.setattr(substrings, "EVERY", 1)
    monkeypatch.setattr(substrings, "HOT_LEAST", 1)
    passage = " ".join(f"p{j}" for j in range(60))
    own = lambda k, n: " ".join(f"w{k}x{j}" for j in range(n))
    rows = [(k, f"{own(k, k % 90)} {passage} {own(-k, 20)}") for k in range(1, 161)]
    docs = documents(rows).repartition(4)
    runs = substrings.removed_runs(docs, F.lit(0).cast("long"), 200_000)
    assert runs.count() <= 3 * len(rows)
    out = substrings.op9_substrings(spark, tables(documents=docs)).collect()
    assert sorted(((r.doc_id, r.n_words, r.n_removed, r.kept_sha256) for r in out), key=str) == slow(rows)


@pytest.mark.parametrize("spread", [1, 1 << 18])
def test_runs_at_parked_places_are_joined(monkeypatch, spread):
    monkeypatch.setattr(substrings, "SPREAD", spread)
    place = lambda *at: np.array(list(at), dtype=substrings.PLACE).tobytes()
    least = lambda *ids: np.array(ids, dtype=np.int64).tobytes()
    rows = [
        (place((1, 0, 8), (2, 0, 7), (3, 0, 40)), least(1, 2, 1)),  # not the second window in 2
        (place((1, 0, 10), (2, 0, 9), (2, 7, 10), (3, 0, 57)), least(1)),
        (place((2, 0, 33), (3, 0, 56)), least(1)),  # 3: leaves a word before it
        (place((2, 0, 22)), least(1)),
        (place((1, 0, 0)), least(1)),
    ]
    batches = [pa.RecordBatch.from_arrays([pa.array(c, pa.binary()) for c in zip(*r, strict=True)], names=["places", "least"]) for r in (rows[:2], rows[2:])]
    found = [(r["doc"], r["tag"], r["start"], r["n"]) for b in substrings._unpark(iter(batches)) for r in b.to_pylist()]
    assert found == [(2, 0, 7, 39), (2, 7, 10, 13), (3, 0, 40, 15), (3, 0, 56, 14)]


def test_words_of_several_texts():
    texts = [b"  one two", b"", b"\x0bthree\n\n four ", b"\xc3\xa9", b" \t "]
    buffer, starts, whose, place = substrings.cut_words(texts)
    found = [buffer[a:b].tobytes() for a, b in zip(starts, starts[1:], strict=False)]
    assert found == [b"one ", b"two ", b"three ", b"four ", b"\xc3\xa9 "]
    assert whose.tolist() == [0, 0, 2, 2, 3] and place.tolist() == [0, 1, 0, 1, 0]


def test_untouched_texts_are_not_shuffled(spark, documents):
    words = lambda k: " ".join(f"w{k}x{j}" for j in range(30))
    docs = documents([(k, words(k)) for k in range(300)] + [(1000 + k, words(k)) for k in range(5)])
    runs = substrings.removed_runs(docs, F.lit(0).cast("long"), 50_000)
    hit = substrings.touched(runs, docs.select("doc_id", F.lit(0).cast("long").alias("tag"), "text")).where("_hit")
    found = {r.doc_id for r in hit.collect()}
    assert {1000 + k for k in range(5)} <= found and len(found) < 10
