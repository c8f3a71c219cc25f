"""Quality rules: a learned decision list.

Sequential covering over labelled statistics: a rule is grown, one threshold condition at a time, by FOIL's
gain on two thirds of the labelled rows; its last conditions are pruned while that helps on the other
third; the rows that it covers are taken away and the next rule is grown, until one isn't precise enough.
The list is emitted as an ordered Spark conditional expression; its first matching rule rejects a text, and
a text that none matches is kept.

Labels are read from a bounded sample: SAMPLE labelled rows at most, the first in an order hashed from the id,
each text of an id once.  Ids whose labels disagree or are null are not learned from.  Statistics cover every
whole text.  Every threshold between two values is a candidate; rules and conditions end where nothing is gained.

Nulls: a null text has no words.  A text below MIN_WORDS words, or with over half of its words in repeated
windows, has base_failed and is never kept.  Without labels the list is empty and the base decides.
Repeated rows get equal verdicts.  An empty table gives an empty result.
"""

from __future__ import annotations

from dataclasses import dataclass
from functools import reduce

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import LongType, StructField, StructType

from terrane.llm.common import bounded_sample, packed, random_key, table, unpacked

SAMPLE, MIN_WORDS, WINDOW, SEED = 20_000, 50, 3, "quality-1:"
#: Covered rows and precision that a rule needs.
COVER, PRECISION = 5, 0.75

BASE = ("n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words")
COUNTS = (*BASE, "n_upper", "n_digits", "n_marks", "n_lines", "n_distinct")
#: Each feature is a quotient of two counts, or a count.
FEATURES = {
    "n_words": ("n_words", None),
    "chars_per_word": ("word_chars", "n_words"),
    "symbols_per_word": ("n_symbols", "n_words"),
    "dup_line_share": ("n_dup_lines", "n_lines"),
    "repeat_share": ("n_repeat_words", "n_words"),
    "upper_share": ("n_upper", "word_chars"),
    "digit_share": ("n_digits", "word_chars"),
    "marks_per_word": ("n_marks", "n_words"),
    "words_per_line": ("n_words", "n_lines"),
    "distinct_share": ("n_distinct", "n_words"),
}
SYMBOLS, UPPER, DIGITS, MARKS = b"#*$%&|<>", b"ABCDEFGHIJKLMNOPQRSTUVWXYZ", b"0123456789", b"!?.,;:"


def statistics(text: bytes | None) -> tuple[int, ...]:
    """The COUNTS of one UTF-8 text."""
    text = text or b""
    words, lines = text.split(), [x for x in text.split(b"\n") if x.strip()]
    joined, n = b"".join(words), len(words)
    ids: dict[bytes, int] = {}
    number = np.fromiter((ids.setdefault(w, len(ids)) for w in words), dtype=np.int64, count=n)
    repeated = 0
    if n > WINDOW:
        windows = number[: n - WINDOW + 1]
        for k in range(1, WINDOW):  # numbered anew at each step, so that any vocabulary fits
            windows = windows * len(ids) + number[k : n - WINDOW + 1 + k]
            if k + 1 < WINDOW and len(ids) >= 1 << 20:
                windows = np.unique(windows, return_inverse=True)[1]
        order = np.argsort(windows, kind="stable")
        equal = windows[order][1:] == windows[order][:-1]
        again = np.zeros(len(windows), dtype=bool)
        again[order[1:][equal]] = again[order[:-1][equal]] = True
        covered = np.zeros(n, dtype=bool)
        for k in range(WINDOW):
            covered[k : k + len(windows)] |= again
        repeated = int(covered.sum())
    share = [len(joined) - len(joined.translate(None, x)) for x in (SYMBOLS, UPPER, DIGITS, MARKS)]
    return n, len(joined.decode("utf-8", "replace")), share[0], len(lines) - len(set(lines)), repeated, *share[1:], len(lines), len(ids)


@F.arrow_udf(StructType([StructField(x, LongType()) for x in COUNTS]))
def _statistics(text: pa.Array) -> pa.Array:
    rows = [statistics(x) for x in text.to_pylist()]
    columns = zip(*rows, strict=True) if rows else [[] for _ in COUNTS]
    return pa.StructArray.from_arrays([pa.array(c, pa.int64()) for c in columns], names=list(COUNTS))


def with_statistics(docs: DataFrame) -> DataFrame:
    """docs with the counts as struct column _q."""
    return docs.withColumn("_q", _statistics(F.coalesce(F.col("text"), F.lit("")).cast("binary")))


def feature(name: str) -> Column:
    top, below = (x and F.col(f"_q.{x}").cast("double") for x in FEATURES[name])
    return top if below is None else F.when(below > 0, top / below).otherwise(F.lit(0.0))


def base_failed() -> Column:
    return (F.col("_q.n_words") < MIN_WORDS) | (100 * F.col("_q.n_repeat_words") > 50 * F.col("_q.n_words"))


@dataclass(frozen=True)
class Condition:
    feature: str
    above: bool
    threshold: float

    def column(self) -> Column:
        return feature(self.feature) > self.threshold if self.above else feature(self.feature) <= self.threshold

    def holds(self, x: np.ndarray) -> np.ndarray:
        v = x[:, list(FEATURES).index(self.feature)]
        return v > self.threshold if self.above else v <= self.threshold

    def __str__(self) -> str:
        return f"{self.feature} {'>' if self.above else '<='} {self.threshold!r}"


Rule = tuple[Condition, ...]


def covers(rule: Rule, x: np.ndarray) -> np.ndarray:
    return reduce(np.logical_and, (c.holds(x) for c in rule), np.ones(len(x), dtype=bool))


def _grow(x: np.ndarray, bad: np.ndarray) -> Rule:
    rule: Rule = ()
    held = np.ones(len(x), dtype=bool)
    while bad[held].any() and not bad[held].all():
        p0, n0 = bad[held].sum(), held.sum()
        best, best_gain = None, 1e-9
        for k, name in enumerate(FEATURES):
            v, y = x[held, k], bad[held]
            order = np.argsort(v, kind="stable")
            v, y = v[order], y[order]
            edges = np.flatnonzero(v[1:] > v[:-1])
            if not len(edges):
                continue
            below, total = np.cumsum(y), y.sum()
            for above in (False, True):
                n = len(y) - (edges + 1) if above else edges + 1
                p = total - below[edges] if above else below[edges]
                gain = np.where((p > 0) & (n >= COVER), p * (np.log2(np.maximum(p, 1) / n) - np.log2(p0 / n0)), 0)
                at = int(gain.argmax())
                if gain[at] > best_gain:
                    best, best_gain = Condition(name, above, float((v[edges[at]] + v[edges[at] + 1]) / 2)), gain[at]
        if best is None:
            break
        rule = (*rule, best)
        held &= best.holds(x)
    return rule


def _worth(rule: Rule, x: np.ndarray, bad: np.ndarray) -> float:
    c = covers(rule, x)
    return (bad[c].sum() + 1) / (c.sum() + 2)


def learn(x: np.ndarray, bad: np.ndarray) -> list[Rule]:
    """Ordered rules for rejection from features x (columns as FEATURES) and labels bad; rows come shuffled."""
    prune = np.arange(len(x)) % 3 == 2
    rules: list[Rule] = []
    while bad[~prune].any():
        rule = _grow(x[~prune], bad[~prune])
        best = max((rule[:k] for k in range(1, len(rule) + 1)), key=lambda r: (_worth(r, x[prune], bad[prune]), -len(r)), default=())
        c = covers(best, x) if best else np.zeros(len(x), dtype=bool)
        if c.sum() < COVER or bad[c].mean() < PRECISION or (best and _worth(best, x[prune], bad[prune]) < 0.5):
            break
        rules.append(best)
        x, bad, prune = x[~c], bad[~c], prune[~c]
    return rules


def labelled(docs: DataFrame, labels: DataFrame, sample: int = SAMPLE) -> DataFrame:
    """Statistics and label (1: bad) of at most `sample` labelled rows of docs."""
    agreed = labels.where("quality IS NOT NULL AND doc_id IS NOT NULL").groupBy("doc_id").agg(F.min("quality").alias("quality"), F.max("quality").alias("_max")).where("quality = _max")
    keyed = agreed.select(F.col("doc_id").alias("_id"), random_key(SEED, F.col("doc_id")).alias("_key"), "quality")
    texts = docs.select(F.col("doc_id").alias("_id"), F.coalesce("text", F.lit("")).alias("text"))
    rows = with_statistics(bounded_sample(texts, "text", keyed.orderBy("_key", "_id").limit(sample), sample))
    return rows.select("_key", (F.col("quality") == 0).cast("double").alias("_bad"), *[feature(f).alias(f) for f in FEATURES])


def learn_rules(docs: DataFrame, labels: DataFrame, sample: int = SAMPLE) -> list[Rule]:
    rows = np.array([tuple(r)[1:] for r in sorted(labelled(docs, labels, sample).collect())], dtype=float).reshape(-1, 1 + len(FEATURES))
    return learn(rows[:, 1:], rows[:, 0] > 0)


def verdict(rules: list[Rule]) -> Column:
    """False where the first rule that matches is found, else True."""
    chain = None
    for rule in rules:
        test = reduce(lambda a, b: a & b, (c.column() for c in rule))
        chain = F.when(test, F.lit(False)) if chain is None else chain.when(test, F.lit(False))
    return F.lit(True) if chain is None else chain.otherwise(F.lit(True))


def judged(docs: DataFrame, rules: list[Rule]) -> DataFrame:
    """docs with _q, base_failed and kept."""
    return with_statistics(docs).withColumn("base_failed", base_failed()).withColumn("kept", ~F.col("base_failed") & verdict(rules))


def accepted(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """The rows of docs that are kept, with rules learned from those of them that are labelled."""
    rows = docs.select("doc_id", "text", packed(docs))
    return unpacked(judged(rows, learn_rules(rows, labels)).where("kept"))


def op2_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    rules = learn_rules(docs, table(spark, sf_dir, "labels"))
    return judged(docs, rules).select("doc_id", *[F.col(f"_q.{c}").alias(c) for c in BASE], "base_failed", "kept")
