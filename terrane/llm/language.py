"""Language identification by word-first backoff.

A known word counts with its log frequency in each language.  A word that isn't known backs off to its
longest known character n-grams, from ORDER characters down to one, and counts with their mean log
frequency.  A text gets the language of the greatest sum over all its words.

The model is fitted on a bounded sample: of each language TRAIN_ROWS rows with a text that aren't held out, the
first in an order hashed from id and text; of the words and n-grams there it keeps all that occur LEAST times.
Every text is then read whole.

Nulls: a null text, or one without a letter, is `und` with score 0; so is every text if nothing was
learned.  Ties go to the first language in code point order.  Repeated rows get equal predictions.
"""

from __future__ import annotations

import re
from collections import Counter
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql.types import DoubleType, StringType, StructField, StructType

from terrane.llm.common import held_out, table

TRAIN_ROWS, ORDER, LEAST, SEED = 3_000, 5, 2, "language-1:"
#: Words that a worker remembers; words, or n-grams of a word, that are looked up at once.
MEMO, PART = 200_000, 50_000
LETTERS = re.compile(r"[^\W\d_]+")


def grams(word: str) -> Iterator[tuple[int, str]]:
    """(order, n-gram) of a word between its boundary marks."""
    marked = f"<{word}>"
    for order in range(1, ORDER + 1):
        for i in range(len(marked) - order + 1):
            yield order, marked[i : i + order]


def _counter(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Order 0 holds words; n-grams are counted once for each distinct word of a language in a task."""
    words: dict[str, Counter] = {}
    for batch in batches:
        for text, lang in zip(batch.column("text").to_pylist(), batch.column("lang").to_pylist(), strict=True):
            words.setdefault(lang, Counter()).update(LETTERS.findall(text.lower()))
    rows = []
    for lang, counts in words.items():
        parts: Counter = Counter()
        for w in counts:
            parts.update(grams(w))
        rows += [(0, w, lang, n) for w, n in counts.items()] + [(o, g, lang, n) for (o, g), n in parts.items()]
    for at in range(0, len(rows), 100_000):
        columns = zip(*rows[at : at + 100_000], strict=True)
        yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(columns, (pa.int32(), pa.string(), pa.string(), pa.int64()), strict=True)], names=["size", "gram", "lang", "n"])


class Model:
    """Log frequencies of words and n-grams by language: a row of `logs` for each, found by its place in `rows`."""

    def __init__(self, counts: list[tuple[int, str, str, int]]):
        self.langs = sorted({lang for _, _, lang, _ in counts})
        column = {lang: i for i, lang in enumerate(self.langs)}
        #: Of words (order 0) and of the n-grams of each order.
        self.rows: list[dict[str, int]] = [{} for _ in range(ORDER + 1)]
        place = 0
        for size, gram, _, _ in counts:
            if gram not in self.rows[size]:
                self.rows[size][gram] = place
                place += 1
        self.logs = np.full((place, len(column)), 0.05)
        for size, gram, lang, n in counts:
            self.logs[self.rows[size][gram], column[lang]] += n
        for found in self.rows:
            here = np.fromiter(found.values(), dtype=np.int64, count=len(found))
            self.logs[here] = np.log(self.logs[here] / self.logs[here].sum(axis=0))

    def word(self, word: str) -> np.ndarray | None:
        """Relative log frequencies of a lower-case word, the best at 0; None if it has nothing that is known."""
        at = self.rows[0].get(word)
        if at is not None:
            v = self.logs[at]
        elif (v := self._backed_off(f"<{word}>")) is None:
            return None
        return v - v.max()

    def _backed_off(self, marked: str) -> np.ndarray | None:
        for order in range(min(ORDER, len(marked)), 0, -1):
            get, total, known = self.rows[order].get, np.zeros(len(self.langs)), 0
            for a in range(0, len(marked) - order + 1, PART):  # a word can be as long as its text
                part = range(a, min(a + PART, len(marked) - order + 1))
                found = [at for i in part if (at := get(marked[i : i + order])) is not None]
                total += self.logs[found].sum(axis=0)
                known += len(found)
            if known:
                return total / known
        return None


def _predictor(shared):
    #: What the worker has looked up so far: the row of each word in `rows`, -1 for a word that tells nothing.
    memo: dict[str, int] = {}
    rows: list[np.ndarray] = []
    used = [0]

    def learn(model: Model, words: list[str]) -> None:
        if not rows:
            rows.append(np.zeros((MEMO, max(1, len(model.langs)))))
        for w in words:
            v = model.word(w) if any(map(str.isalpha, w)) else None
            if v is None:
                memo[w] = -1
            else:
                rows[0][used[0]] = v
                memo[w] = used[0]
                used[0] += 1

    def predict(model: Model, text: str | None) -> tuple[str, float]:
        found = LETTERS.findall((text or "").lower())
        if not model.langs or not found:
            return "und", 0.0
        total, letters = np.zeros(len(model.langs)), False
        for part in range(0, len(found), PART):
            here = found[part : part + PART]
            new = {w for w in here if w not in memo}
            if len(memo) + len(new) > MEMO:
                memo.clear()
                used[0] = 0
                new = set(here)
            learn(model, sorted(new))
            at = np.array([memo[w] for w in here])
            at = at[at >= 0]
            total += rows[0][at].sum(axis=0)
            letters = letters or len(at) > 0
        if not letters and not any(map(str.isalpha, "".join(found))):
            return "und", 0.0
        best = int(total.argmax())
        odds = np.exp((total - total[best]) / np.sqrt(len(found)))
        return model.langs[best], float(1 / odds.sum())

    @F.arrow_udf(StructType([StructField("lang", StringType()), StructField("score", DoubleType())]))
    def run(text: pa.Array) -> pa.Array:
        out = [predict(shared.value, x) for x in text.to_pylist()]
        return pa.StructArray.from_arrays([pa.array([x[0] for x in out], pa.string()), pa.array([x[1] for x in out], pa.float64())], names=["lang", "score"])

    return run


def _sample(docs: DataFrame, train_rows: int) -> DataFrame:
    """(text, lang) of the rows that are learned from."""
    able = docs.where("text IS NOT NULL AND lang IS NOT NULL").where(~held_out(F.col("doc_id")))
    keyed = able.select("text", "lang", F.xxhash64(F.lit(SEED), "doc_id", "text").alias("_key"))
    share = (F.col("_key").cast("double") + 2.0**63) / 2.0**64
    sizes = keyed.groupBy("lang").agg(F.count(F.lit(1)).alias("_n"))
    # Twice as many as are wanted of each language, then its first ones: a window never sees a whole language.
    few = keyed.select("lang", "_key").withColumn("_share", share).join(F.broadcast(sizes), "lang").where(F.col("_share") * F.col("_n") <= 2.0 * train_rows)
    nth = F.row_number().over(Window.partitionBy("lang").orderBy("_key"))
    last = few.withColumn("_nth", nth).where(F.col("_nth") <= train_rows).groupBy("lang").agg(F.max("_key").alias("_last"))
    return keyed.join(F.broadcast(last), "lang").where(F.col("_key") <= F.col("_last")).select("text", "lang")  # sizes, last: a row for each language


def fit(docs: DataFrame, train_rows: int = TRAIN_ROWS) -> Model:
    counts = _sample(docs, train_rows).mapInArrow(_counter, "size int, gram string, lang string, n long")
    total = counts.groupBy("size", "gram", "lang").agg(F.sum("n").alias("n")).where(F.col("n") >= LEAST)
    return Model(sorted((r["size"], r.gram, r.lang, r.n) for r in total.toLocalIterator()))  # of the size of the bounded sample's vocabulary


def identified(docs: DataFrame, model: Model) -> DataFrame:
    """docs with lang_pred and score."""
    predict = _predictor(docs.sparkSession.sparkContext.broadcast(model))
    return docs.withColumn("_p", predict(F.col("text"))).withColumn("lang_pred", F.col("_p.lang")).withColumn("score", F.col("_p.score")).drop("_p")


def op4_language(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text", "lang")
    return identified(docs, fit(docs)).select("doc_id", held_out(F.col("doc_id")).alias("held_out"), "lang_pred", "score")
