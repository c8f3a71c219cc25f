"""Toxic spans by a linear-chain conditional random field.

Tokens are runs of letters.  Labels are given for documents, so tokens are labelled first: words and word
beginnings that labelled toxic documents have and the others hardly have (their evidence, CERTAIN or more)
mark the tokens of toxic documents.  A two-state chain with those features and transitions is trained on
the labelled tokens by gradient ascent on the conditional likelihood; forward-backward gives each token's
marginal.  A document's score is the chance that one of its tokens is toxic (noisy-or of the marginals),
calibrated on the labelled documents, scored whole as any other; tokens at half or more give the offending
offsets.

The field is fitted on a bounded sample: TRAIN_ROWS labelled rows at most that aren't held out, in an order
hashed from the id, each text of an id once.  Of each text all tokens with a feature are learned from, with STRETCH tokens on either
side; all features with enough evidence count.  Every text is scored whole.

Nulls: a null text is scored as an empty one, which gets the rate of toxic documents among those without a
suspicious token.  Ids whose labels disagree or are null are not learned from; without labels every score
is 0.  Repeated rows get equal scores.
"""

from __future__ import annotations

import re
from collections import Counter
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType, DoubleType, IntegerType, StructField, StructType

from terrane.llm.common import bounded_sample, held_out, random_key, table

TRAIN_ROWS, STRETCH, SEED = 10_000, 12, "toxicity-1:"
#: Beginnings of a word that are features; documents a feature needs; share of toxic documents, at equal class sizes, that makes evidence.
PREFIXES, LEAST_DOCS, SUSPECT, CERTAIN = range(3, 9), 4, 0.75, 0.93
STEPS, RATE, RIDGE, CHUNK = 150, 0.15, 1e-4, 4096
CUT, MEMO = 0.3, 200_000
TOKEN = re.compile(r"[^\W\d_]+")


def features(word: str) -> list[str]:
    w = word.lower()
    return ["=" + w, *[w[:k] for k in PREFIXES if len(w) > k]]


def _counter(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    counts: tuple[Counter, Counter] = Counter(), Counter()
    for batch in batches:
        for text, toxic in zip(batch.column("text").to_pylist(), batch.column("toxic").to_pylist(), strict=True):
            counts[toxic > 0].update({f for w in set(TOKEN.findall(text or "")) for f in features(w)})
    names = list(counts[0] | counts[1])
    for at in range(0, len(names), 100_000):
        part = names[at : at + 100_000]
        yield pa.RecordBatch.from_arrays([pa.array(part, pa.string()), *[pa.array([c[f] for f in part], pa.int64()) for c in counts]], names=["f", "n0", "n1"])


def _segmenter(known: dict[str, int]):
    def segments(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """Stretches of tokens around those with a known feature: for each token the number of its features, then all of them."""
        for batch in batches:
            rows = []
            for key, text, toxic in zip(*(batch.column(c).to_pylist() for c in ("key", "text", "toxic")), strict=True):
                found = [[known[f] for f in features(w) if f in known] for w in TOKEN.findall(text or "")]
                active = [i for i, f in enumerate(found) if f]
                spans: list[list[int]] = []
                for i in active:
                    if spans and i - STRETCH <= spans[-1][1]:
                        spans[-1][1] = i + STRETCH
                    else:
                        spans.append([i - STRETCH, i + STRETCH])
                pieces = [found[max(0, s + k) : min(e + 1, s + k + 8 * STRETCH)] for s, e in spans for k in range(0, e - s + 1, 8 * STRETCH)]
                rows += [(key, toxic, [len(f) for f in p], [x for f in p for x in f]) for p in pieces] or [(key, toxic, [], [])]
            kinds = (pa.string(), pa.int32(), pa.list_(pa.int32()), pa.list_(pa.int32()))
            columns = list(zip(*rows, strict=True)) or [()] * 4
            yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(columns, kinds, strict=True)], names=["key", "toxic", "counts", "found"])

    return segments


def forward_backward(emit: np.ndarray, real: np.ndarray, step: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Marginals of state 1, expected transitions (2, 2) and log partition of chains.

    emit: (chains, tokens) score of state 1 over 0; real: how many tokens each chain has; step[i, j]: score of i then j.
    Messages are scaled to add up to 1 at each token.
    """
    n, length = emit.shape
    inside = (np.arange(length) < real[:, None]).T
    odds, ((m00, m01), (m10, m11)) = np.exp(np.clip(emit, -60, 60)).T, np.exp(step)
    ahead, scale, back = np.empty((2, length, n)), np.ones((length, n)), np.ones((2, length, n))
    scale[0] = 1 + odds[0]
    ahead[0, 0], ahead[1, 0] = 1 / scale[0], odds[0] / scale[0]
    for t in range(1, length):
        a, b = ahead[0, t - 1], ahead[1, t - 1]
        u, v = a * m00 + b * m10, (a * m01 + b * m11) * odds[t]
        total = u + v
        scale[t] = np.where(inside[t], total, 1)
        ahead[0, t], ahead[1, t] = np.where(inside[t], u / total, a), np.where(inside[t], v / total, b)
    for t in range(length - 2, -1, -1):
        u, v = back[0, t + 1] / scale[t + 1], back[1, t + 1] * odds[t + 1] / scale[t + 1]
        back[0, t], back[1, t] = np.where(inside[t + 1], m00 * u + m01 * v, 1), np.where(inside[t + 1], m10 * u + m11 * v, 1)
    marginal = (ahead[1] * back[1] * inside).T
    into = np.stack((back[0, 1:], back[1, 1:] * odds[1:])) / scale[1:] * inside[1:]
    moves = np.einsum("itn,jtn->ij", ahead[:, :-1], into) * np.exp(step)
    return marginal, moves, np.log(scale).sum(axis=0)


class Field:
    """Weights of features, bias and transitions, and the calibration of document scores."""

    def __init__(self) -> None:
        self.weights: dict[str, float] = {}
        self.bias, self.step = -6.0, np.zeros((2, 2))
        self.none, self.slope, self.offset = 0.0, 1.0, 0.0

    def emission(self, word: str) -> float | None:
        """Score of state 1 over 0 for a token; None if it has no known feature."""
        found = [w for f in features(word) if (w := self.weights.get(f)) is not None]
        return self.bias + sum(found) if found else None

    def marginals(self, emit: list[float]) -> list[float]:
        """P(state 1) of each token of one chain, by ratios of the two states."""
        (a, b), (c, d) = np.exp(self.step).tolist()
        r, ahead = 0.0, []
        e = np.exp(np.clip(emit, -60, 60)).tolist()
        for k, x in enumerate(e):
            r = x * ((b + r * d) / (a + r * c)) if k else x
            ahead.append(r)
        out, s = [0.0] * len(e), 1.0
        for k in range(len(e) - 1, -1, -1):
            q = ahead[k] * s
            out[k] = q / (1 + q)
            s = (c + d * e[k] * s) / (a + b * e[k] * s)
        return out

    def rest(self) -> int:
        """After how many tokens without a feature the messages stay as they are, to the precision of a float."""
        (a, b), (c, d) = np.exp(self.step).tolist()
        x = float(np.exp(np.clip(self.bias, -60, 60)))
        large, small = sorted(np.abs(np.linalg.eigvals([[a, b * x], [c, d * x]])).tolist(), reverse=True)
        return int(np.ceil(np.log(1e-16) / np.log(min(0.999, max(1e-16, small / large))))) + 1

    def calibrated(self, any_toxic: float) -> float:
        z = np.log(max(any_toxic, 1e-9)) - np.log(max(1 - any_toxic, 1e-9))
        return float(1 / (1 + np.exp(-np.clip(self.slope * z + self.offset, -50, 50))))


def train(known: list[str], evidence: np.ndarray, rows: list) -> Field:
    """The field from segments (key, toxic, counts, found); evidence: of each feature, the share of toxic documents."""
    field = Field()
    field_rows = sorted((r for r in rows if r.counts), key=lambda r: (len(r.counts), r.key, r.toxic, r.counts, r.found))
    if field_rows and len({r.toxic for r in rows}) == 2:
        parts = []
        for at in range(0, len(field_rows), CHUNK):  # of like length, so that little is padding
            some = field_rows[at : at + CHUNK]
            real = np.array([len(r.counts) for r in some])
            per = np.zeros((len(some), int(real.max())), dtype=np.int64)
            for i, r in enumerate(some):
                per[i, : real[i]] = r.counts
            feature = np.concatenate([np.array(r.found, dtype=np.int64) for r in some])
            token = np.repeat(np.arange(per.size), per.ravel())
            best = np.zeros(per.size)
            np.maximum.at(best, token, evidence[feature])
            label = (best.reshape(per.shape) >= CERTAIN) & (np.array([r.toxic for r in some])[:, None] > 0)
            inside = np.arange(per.shape[1]) < real[:, None]
            seen = np.array([[((label[:, :-1] == i) & (label[:, 1:] == j) & inside[:, 1:]).sum() for j in (0, 1)] for i in (0, 1)], dtype=float)
            parts.append((real, per.shape, feature, token, label & inside, seen))
        total = float(sum(p[0].sum() for p in parts))
        w, bias, step = np.zeros(len(known)), -3.0, np.zeros((2, 2))
        moments = [np.zeros(len(known) + 5), np.zeros(len(known) + 5)]
        for k in range(1, STEPS + 1):
            grad = np.concatenate((-RIDGE * total * w / max(1, len(known)), np.zeros(5)))
            for real, shape, feature, token, label, seen in parts:
                p, moves, _ = forward_backward(bias + np.bincount(token, w[feature], shape[0] * shape[1]).reshape(shape), real, step)
                rest = label - p
                grad += np.concatenate((np.bincount(feature, rest.ravel()[token], len(known)), [rest.sum()], (seen - moves).ravel()))
            grad /= total
            moments[0] = 0.9 * moments[0] + 0.1 * grad
            moments[1] = 0.99 * moments[1] + 0.01 * grad**2
            move = RATE * (moments[0] / (1 - 0.9**k)) / (np.sqrt(moments[1] / (1 - 0.99**k)) + 1e-9)
            w, bias, step = w + move[: len(known)], bias + move[len(known)], step + move[-4:].reshape(2, 2)
        field.weights, field.bias, field.step = dict(zip(known, w.tolist(), strict=True)), float(bias), step - step[0, 0]
    return field


def calibrate(field: Field, whole: list[tuple[int, float | None]]) -> None:
    """Sets the calibration of field from (toxic, chance of a toxic token or None) of whole texts."""
    heard = sorted((some, toxic) for toxic, some in whole if some is not None)
    if heard:
        some, y = (np.array(c, dtype=float) for c in zip(*heard, strict=True))
        z = np.log(np.maximum(some, 1e-9)) - np.log(np.maximum(1 - some, 1e-9))
        beta = np.array([1.0, 0.0])
        x = np.column_stack((z, np.ones(len(z))))
        for _ in range(50):  # Newton's steps, held near slope 1
            q = 1 / (1 + np.exp(-np.clip(x @ beta, -50, 50)))
            h = x.T @ (x * (q * (1 - q))[:, None]) + np.eye(2) * 0.1
            beta = beta - np.clip(np.linalg.solve(h, x.T @ (q - y) + 0.1 * (beta - [1.0, 0.0])), -1, 1)
        field.slope, field.offset = max(0.05, float(beta[0])), float(beta[1])
    quiet = [toxic for toxic, some in whole if some is None]
    field.none = (sum(quiet) / (len(quiet) + 1)) if quiet else 0.0


def _sample(docs: DataFrame, labels: DataFrame, train_rows: int) -> DataFrame:
    """(key, text, toxic) of the labelled rows that are learned from: train_rows at most, each text of an id once."""
    agreed = labels.where("toxic IS NOT NULL AND doc_id IS NOT NULL").where(~held_out(F.col("doc_id"))).groupBy("doc_id").agg(F.min("toxic").alias("toxic"), F.max("toxic").alias("_max")).where("toxic = _max")
    keyed = agreed.select(F.col("doc_id").alias("_id"), random_key(SEED, F.col("doc_id")).alias("_key"), F.col("toxic").cast("int").alias("toxic"))
    chosen = keyed.orderBy("_key", "_id").limit(train_rows)
    rows = docs.select(F.col("doc_id").alias("_id"), F.coalesce("text", F.lit("")).alias("text"))
    return bounded_sample(rows, "text", chosen, train_rows).select(F.col("_key").alias("key"), "text", "toxic")


def fit(docs: DataFrame, labels: DataFrame, train_rows: int = TRAIN_ROWS) -> Field:
    sample = _sample(docs, labels, train_rows)
    sizes = {r.toxic: r.n for r in sample.groupBy((F.col("toxic") > 0).cast("int").alias("toxic")).agg(F.count(F.lit(1)).alias("n")).collect()}
    if not sizes:
        return Field()
    n0, n1 = max(1, sizes.get(0, 0)), max(1, sizes.get(1, 0))
    share = (F.col("n1") / n1) / (F.col("n1") / n1 + (F.col("n0") + 0.5) / n0)
    counts = sample.mapInArrow(_counter, "f string, n0 long, n1 long").groupBy("f").agg(F.sum("n0").alias("n0"), F.sum("n1").alias("n1"))
    kept = counts.where(F.col("n1") >= LEAST_DOCS).withColumn("share", share).where(F.col("share") >= SUSPECT)
    rows = sorted(kept.collect(), key=lambda r: r.f)  # a short row for each kept word or beginning of the bounded sample
    known = {r.f: i for i, r in enumerate(rows)}
    segments = sample.mapInArrow(_segmenter(known), "key string, toxic int, counts array<int>, found array<int>")
    field = train(list(known), np.array([r.share for r in rows], dtype=float), segments.collect())  # the stretches of train_rows texts at most
    whole = sample.mapInArrow(_wholes(sample.sparkSession.sparkContext.broadcast(field)), "toxic int, some double")
    calibrate(field, [(r.toxic, r.some) for r in whole.collect()])  # train_rows short rows at most
    return field


def _whole(field: Field, words: list[str], memo: dict[str, float | None]) -> tuple[float | None, list[tuple[int, float]]]:
    """Chance that one of a text's tokens is toxic, None if none has a known feature, and (token, marginal) of those and the tokens around them.

    A run of tokens without a feature comes to rest after field.rest() of them: the rest of the run, which
    changes nothing, is left out of the chain.
    """
    if len(memo) > MEMO:
        memo.clear()
    for w in set(words):
        if w not in memo:
            memo[w] = field.emission(w)
    active = [i for i, w in enumerate(words) if memo[w] is not None]
    if not active:
        return None, []
    reach, chain, at = field.rest(), [], 0
    for i in (0, *active, len(words) - 1):  # the text's ends disturb the rest, too
        at = max(at, i - reach)
        to = min(len(words), i + reach + 1)
        chain += range(at, to)
        at = max(at, to)
    found = [memo[words[i]] for i in chain]
    marginal = field.marginals([field.bias if e is None else e for e in found])
    clean = sum(np.log1p(-min(p, 1 - 1e-9)) for p, e in zip(marginal, found, strict=True) if e is not None)
    return float(-np.expm1(clean)), list(zip(chain, marginal, strict=True))


def _wholes(shared):
    def wholes(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        memo: dict[str, float | None] = {}
        for batch in batches:
            some = [_whole(shared.value, TOKEN.findall(text or ""), memo)[0] for text in batch.column("text").to_pylist()]
            yield pa.RecordBatch.from_arrays([batch.column("toxic"), pa.array(some, pa.float64())], names=["toxic", "some"])

    return wholes


def _scorer(shared):
    memo: dict[str, float | None] = {}

    def score(field: Field, text: str | None) -> tuple[float, list]:
        if not field.weights or not text:
            return field.none, []
        some, marginal = _whole(field, TOKEN.findall(text), memo)
        if some is None:
            return field.none, []
        told = {i: p for i, p in marginal if p >= 0.5}
        return field.calibrated(some), [(*m.span(), told[i]) for i, m in enumerate(TOKEN.finditer(text)) if i in told] if told else []

    span = StructType([StructField("start", IntegerType()), StructField("end", IntegerType()), StructField("p", DoubleType())])
    kind = pa.struct([("score", pa.float64()), ("spans", pa.list_(pa.struct([("start", pa.int32()), ("end", pa.int32()), ("p", pa.float64())])))])

    @F.arrow_udf(StructType([StructField("score", DoubleType()), StructField("spans", ArrayType(span))]))
    def run(text: pa.Array) -> pa.Array:
        out = [score(shared.value, x) for x in text.to_pylist()]
        return pa.array([{"score": s, "spans": [dict(zip(("start", "end", "p"), x, strict=True)) for x in spans]} for s, spans in out], kind)

    return run


def scored(docs: DataFrame, field: Field) -> DataFrame:
    """docs with struct _t: score, and the spans (start, end, p) of offending tokens in code points."""
    return docs.withColumn("_t", _scorer(docs.sparkSession.sparkContext.broadcast(field))(F.col("text")))


def op10_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    out = scored(docs, fit(docs, table(spark, sf_dir, "labels")))
    offsets = F.array_join(F.transform("_t.spans", lambda x: F.concat_ws(":", x["start"], x["end"])), ",")
    return out.select("doc_id", held_out(F.col("doc_id")).alias("held_out"), F.col("_t.score").alias("score"), (F.col("_t.score") >= CUT).cast("int").alias("predicted"), offsets.alias("offsets"))
