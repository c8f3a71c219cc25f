import random
from itertools import product

import numpy as np
import pyarrow as pa
from pyspark.sql import functions as F

from terrane.llm import toxicity as x


def test_forward_backward_is_exact():
    rng = np.random.default_rng(1)
    emit, step, real = rng.normal(size=(3, 5)), rng.normal(size=(2, 2)), np.array([5, 3, 1])
    p, moves, log_z = x.forward_backward(emit, real, step)
    want, total_moves = np.zeros((3, 5)), np.zeros((2, 2))
    for c in range(3):
        weights = {}
        for y in product((0, 1), repeat=int(real[c])):
            weights[y] = np.exp(sum(emit[c, t] for t in range(real[c]) if y[t]) + sum(step[a, b] for a, b in zip(y, y[1:], strict=False)))
        z = sum(weights.values())
        assert np.isclose(np.log(z), log_z[c])
        for y, w in weights.items():
            want[c, : real[c]] += np.array(y) * w / z
            for a, b in zip(y, y[1:], strict=False):
                total_moves[a, b] += w / z
    assert np.allclose(p, want) and np.allclose(moves, total_moves)
    field = x.Field()
    field.step = step
    assert np.allclose(field.marginals(emit[0].tolist()), want[0])


def test_scores_are_those_of_the_whole_chain():
    """Leaving out tokens at rest changes no score and no marginal; against a chain of every token of the text."""
    rng = np.random.default_rng(4)
    field = x.Field()
    field.weights, field.bias, field.step = {"=bad": 7.0, "=worse": 9.5, "sch": 3.0}, -5.0, np.array([[0.0, -2.0], [-1.0, 1.5]])
    for n in (1, 5, 60, 3_000):
        words = rng.choice(["plain", "other", "bad", "worse", "Schuft"], p=[0.6, 0.38, 0.008, 0.002, 0.01], size=n).tolist() + ["bad"]
        emit = [field.emission(w) for w in words]
        p, _, _ = x.forward_backward(np.array([[field.bias if e is None else e for e in emit]]), np.array([n + 1]), field.step)
        want = 1 - np.prod([1 - q for q, e in zip(p[0], emit, strict=True) if e is not None])
        some, marginal = x._whole(field, words, {})
        assert np.isclose(some, want) and all(np.isclose(q, p[0][i]) for i, q in marginal)
        assert {i for i, q in enumerate(p[0]) if q >= 0.5} == {i for i, q in marginal if q >= 0.5}
    assert 2 < field.rest() < 100 and len(marginal) < 3_000


def test_repeated_ids_are_learned_from_within_the_bound(spark, documents):
    docs = documents([(1, f"text {k % 50}") for k in range(500)] + [(3, "another")])
    labels = spark.createDataFrame([(1, 1, 1), (3, 1, 0)], "doc_id long, quality int, toxic int")
    assert x._sample(docs, labels, 20).count() == 20
    assert x._sample(docs, labels, 1000).count() == 51


def corpus(rng, n):
    words = ["w" + "".join(rng.choices("abcdefghij", k=3)) for _ in range(400)]
    rows, labels = [], []
    for i in range(n):
        text = rng.choices(words, k=rng.randrange(3, 80))
        toxic = rng.random() < 0.2
        if toxic:
            for _ in range(rng.randrange(1, 4)):
                text.insert(rng.randrange(len(text) + 1), rng.choice(["Grobian", "grobian,", "schuft" + rng.choice(words), "OAF"]))
        rows.append((i, " ".join(text)))
        labels.append((i, 1, int(toxic)))
    return rows, labels


def test_held_out_and_offsets(spark, documents, tables):
    rows, labels = corpus(random.Random(2), 900)
    truth = {i: t for i, _, t in labels}
    extra = [(5000, None), (5001, ""), (5002, "12 34"), (5003, "oaf"), (None, "a grobian"), rows[0], rows[0], (5004, "word " * 50_000 + "oaf")]
    docs = documents(rows + extra).withColumn("score", F.lit("clash")).withColumn("_t", F.lit(0)).withColumn("toxic", F.lit(9))
    more = [(0, 1, 1 - truth[0]), (5000, None, None), (None, 1, 1)]  # labels that disagree or are missing
    frame = spark.createDataFrame(labels + more, "doc_id long, quality int, toxic int")
    got = x.op10_toxicity(spark, tables(documents=docs, labels=frame)).collect()
    assert len(got) == len(rows) + len(extra)
    held = [r for r in got if r.held_out and r.doc_id in truth]
    assert len(held) > 150 and sum(r.predicted == truth[r.doc_id] for r in held) / len(held) > 0.97
    assert all(0 <= r.score <= 1 and r.predicted == int(r.score >= 0.3) for r in got)
    by_id = {r.doc_id: r for r in got}
    assert by_id[5003].offsets == "0:3" and by_id[5004].offsets == "250000:250003" and by_id[None].offsets == "2:9"
    assert {by_id[i].predicted for i in (5000, 5001, 5002)} == {0} and len({by_id[i].score for i in (5000, 5001, 5002)}) == 1


def test_without_labels(spark, documents):
    labels = spark.createDataFrame([], "doc_id long, quality int, toxic int")
    docs = documents([(1, "some words")])
    assert [r._t.score for r in x.scored(docs, x.fit(docs, labels)).collect()] == [0.0]
    assert x.scored(docs.where("false"), x.Field()).count() == 0


def test_all_stretches_are_learned_from_and_calibrated_on(spark, documents):
    text = ("oaf " + "word " * 40) * 50
    batch = pa.RecordBatch.from_pydict({"key": ["k"], "text": [text], "toxic": pa.array([1], pa.int32())})
    rows = [r for out in x._segmenter({"=oaf": 0})(iter([batch])) for r in out.to_pylist()]
    assert sum(len(r["found"]) for r in rows) == 50

    rng = random.Random(3)
    plain = lambda n: " ".join(rng.choices("abcdefghij", k=n))
    docs, labels = [], []
    for i in range(400):
        toxic = i % 4 == 0  # murk: weak evidence, once in each toxic text and often in some clean ones
        docs.append((i, f"{plain(30)} grobian murk {plain(30)}" if toxic else " ".join(f"{plain(30)} murk" for _ in range(60)) if i % 8 == 1 else plain(60)))
        labels.append((i, 1, int(toxic)))
    frame = documents(docs)
    field = x.fit(frame, spark.createDataFrame(labels, "doc_id long, quality int, toxic int"))
    learned = {r.doc_id for r in frame.where(~x.held_out(F.col("doc_id"))).collect()}
    whole = [(toxic, x._whole(field, x.TOKEN.findall(docs[i][1]), {})[0]) for i, _, toxic in labels if i in learned]
    again = x.Field()
    x.calibrate(again, whole)
    assert "=murk" in field.weights and np.allclose((again.slope, again.offset, again.none), (field.slope, field.offset, field.none))
