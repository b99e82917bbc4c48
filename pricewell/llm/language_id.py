"""Language ID by words first, then by shorter and shorter character n-grams.

A known word adds its log frequency in each language.  A word that no language knows is looked
up by its character n-grams (with word boundaries), from ``max_gram`` down to single characters: the first
length at which any of its n-grams is known adds the mean of their log frequencies.  A word whose characters
are all unknown says nothing.  The language with the largest sum wins; the score is its share among
the languages when sums are averaged per word.

The model is fitted on a bounded sample: per language ``fit_rows`` distinct labelled texts, or all if it has fewer,
chosen by a hash of the text, so that copies count once and every labelled language has some.  It holds per language the ``vocabulary`` most frequent words and the ``grams``
most frequent n-grams of each length.  Its size is therefore bounded by these parameters and the number of
languages, and it goes to every task; prediction is then one pass over the documents without a shuffle.

Defined cases: null text or text without a letter is ``und`` with score 0; with nothing to learn from, all
is ``und``; languages are the values of the label column as they are, null excluded; a tie takes the smaller
label; repeated rows get equal predictions; an empty table gives an empty result; very long texts are
counted word by word as a whole; other columns are not read.
"""

from __future__ import annotations

import re
import uuid
from collections import Counter

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from pricewell.llm.text import private
from pricewell.plans.session import ship_package

FIT_ROWS = 3000
VOCABULARY = 20_000
GRAMS = 5_000
MAX_GRAM = 4
UNKNOWN = "und"
_WORDS = re.compile(r"[^\W\d_]+")


def words_of(text: str | None) -> list[str]:
    """Runs of letters in lower case."""
    return _WORDS.findall((text or "").lower())


def grams_of(word: str, n: int) -> list[str]:
    """Character n-grams of a word with its boundaries; single characters have none."""
    if n == 1:
        return list(word)
    framed = f"^{word}$"
    return [framed[i : i + n] for i in range(len(framed) - n + 1)]


class Model:
    """Log frequencies of words and n-grams, a row over the languages each."""

    def __init__(self, langs: list[str], counts: dict[tuple[str, int], list[tuple[str, int]]], max_gram: int):
        """``counts[(lang, n)]``: (entry, occurrences), where n is 0 for words, else the n-gram's length."""
        self.langs, self.max_gram, self.name = langs, max_gram, uuid.uuid4().hex
        self.tables: list[tuple[dict[str, int], np.ndarray]] = []
        for n in range(max_gram + 1):
            place = {e: i for i, e in enumerate({e for lang in langs for e, _ in counts.get((lang, n), [])})}
            times = np.zeros((len(place), len(langs)))
            for k, lang in enumerate(langs):
                for e, c in counts.get((lang, n), []):
                    times[place[e], k] = c
            self.tables.append((place, np.log(times + 1) - np.log(times.sum(axis=0) + len(place) + 1)))

    def row(self, word: str) -> np.ndarray | None:
        """What a word says of each language; None if nothing."""
        place, logs = self.tables[0]
        if word in place:
            return logs[place[word]]
        for n in range(self.max_gram, 0, -1):
            place, logs = self.tables[n]
            known = [place[g] for g in grams_of(word, n) if g in place]
            if known:
                return np.add.reduce(logs.take(known, 0)) / len(known)
        return None


class Predictor:
    """A model with the rows of the words met lately."""

    def __init__(self, model: Model, remember: int = 400_000):
        self.model, self.remember = model, remember
        self.place: dict[str, int] = {}
        self.rows = np.zeros((1024, len(model.langs)))
        self.used = 0

    def _learn(self, word: str) -> int:
        """The place of a word's row; -1 for a word without letters."""
        at = -1
        if any(c.isalpha() for c in word):
            at, self.used = self.used, self.used + 1
            if at == len(self.rows):
                self.rows = np.concatenate([self.rows, np.zeros_like(self.rows)])
            row = self.model.row(word)
            self.rows[at] = 0 if row is None else row
        self.place[word] = at
        return at

    def predict(self, text: str | None) -> tuple[str, float]:
        if len(self.place) > self.remember:
            self.place.clear()
            self.used = 0
        get, learn = self.place.get, self._learn
        at = np.array([p if (p := get(w)) is not None else learn(w) for w in words_of(text)], dtype=np.int64)
        at = at[at >= 0]
        if not len(at) or not self.model.langs:
            return UNKNOWN, 0.0
        # Sums over distinct words: a long text costs no more memory than its words.
        distinct, times = np.unique(at, return_counts=True)
        mean = times @ self.rows[distinct] / len(at)
        best = int(np.argmax(mean))
        share = np.exp(mean - mean[best])
        return self.model.langs[best], float(1 / share.sum())


_predictors: dict[str, Predictor] = {}


def _predictor(model: Model) -> Predictor:
    """This worker's predictor for ``model``; it goes on knowing the words of earlier tasks."""
    if model.name not in _predictors:
        _predictors.clear()
        _predictors[model.name] = Predictor(model)
    return _predictors[model.name]


def _sampled(documents: DataFrame, text: str, lang: str, fit_rows: int) -> DataFrame:
    """``fit_rows`` distinct texts per language at most, those with the least hashes."""
    labelled = documents.filter(F.col(lang).isNotNull() & F.col(text).isNotNull()).select(
        F.col(text).alias("text"), F.col(lang).cast("string").alias("lang"),
        F.shiftrightunsigned(F.xxhash64(F.col(text)), 1).alias("h"),
    )
    hashes = labelled.select("lang", "h").distinct()
    sizes = hashes.groupBy("lang").agg(F.count("*").alias("n"), F.min("h").alias("least"))
    # About twice the wanted number lie below the limit, so that only few rows of a language are put in order.
    share = F.lit(float(2 * fit_rows + 64)) / F.col("n")
    limits = sizes.select("lang", "least", F.when(share < 1, (share * 2.0**63).cast("long")).alias("limit"))
    low = hashes.join(F.broadcast(limits), "lang").filter(
        F.col("limit").isNull() | (F.col("h") <= F.col("limit")) | (F.col("h") == F.col("least"))
    )
    nth = F.row_number().over(Window.partitionBy("lang").orderBy("h"))
    drawn = low.select("lang", "h", nth.alias("nth")).filter(F.col("nth") <= fit_rows).select("lang", "h")
    return labelled.join(F.broadcast(drawn), ["lang", "h"]).select("lang", "text").distinct()


def fit(
    documents: DataFrame, text: str = "text", lang: str = "lang", fit_rows: int = FIT_ROWS,
    vocabulary: int = VOCABULARY, grams: int = GRAMS, max_gram: int = MAX_GRAM,
) -> Model:
    """A model of the labelled rows of ``documents``."""
    ship_package(documents.sparkSession)

    def count(batches):
        """Occurrences per (lang, kind, entry) in this task's rows."""
        tallies: dict[tuple[str, int], Counter] = {}
        for batch in batches:
            for lang_, text_ in zip(batch.column(0), batch.column(1)):
                tallies.setdefault((lang_.as_py(), 0), Counter()).update(words_of(text_.as_py()))
        for (lang_, _), words in list(tallies.items()):
            for n in range(1, max_gram + 1):
                tally = tallies[lang_, n] = Counter()
                for word, times in words.items():
                    for gram in grams_of(word, n):
                        tally[gram] += times
        for (lang_, n), tally in tallies.items():
            entries = list(tally)
            for low in range(0, len(entries), 10_000):
                part = entries[low : low + 10_000]
                yield pa.RecordBatch.from_arrays(
                    [pa.array([lang_] * len(part)), pa.array([n] * len(part), pa.int32()), pa.array(part),
                     pa.array([tally[e] for e in part], pa.int64())], ["lang", "n", "entry", "times"],
                )

    counted = _sampled(documents, text, lang, fit_rows).mapInArrow(count, "lang string, n int, entry string, times long")
    summed = counted.groupBy("lang", "n", "entry").agg(F.sum("times").alias("times"))
    best = Window.partitionBy("lang", "n").orderBy(F.desc("times"), "entry")
    kept = summed.withColumn("place", F.row_number().over(best)).filter(
        F.col("place") <= F.when(F.col("n") == 0, vocabulary).otherwise(grams)
    )
    counts: dict[tuple[str, int], list[tuple[str, int]]] = {}
    for row in kept.select("lang", "n", "entry", "times").toArrow().to_pylist():
        counts.setdefault((row["lang"], row["n"]), []).append((row["entry"], row["times"]))
    return Model(sorted({lang_ for lang_, _ in counts}), counts, max_gram)


def predict(documents: DataFrame, model: Model, text: str = "text", keep: list[Column] = ()) -> DataFrame:
    """The columns ``keep`` of ``documents`` plus ``lang_pred`` and ``score`` (0 to 1)."""
    spark = documents.sparkSession
    ship_package(spark)
    shared = spark.sparkContext.broadcast(model)
    rows = documents.select(F.col(text).alias(private("text")), *keep)
    kept = rows.schema[1:]
    fields = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in kept)

    def run(batches):
        predictor = _predictor(shared.value)
        for batch in batches:
            found = [predictor.predict(t.as_py()) for t in batch.column(0)]
            yield pa.RecordBatch.from_arrays(
                [*batch.columns[1:], pa.array([f[0] for f in found], pa.string()),
                 pa.array([f[1] for f in found], pa.float64())],
                [*batch.schema.names[1:], "lang_pred", "score"],
            )

    return rows.mapInArrow(run, f"{fields}{', ' if fields else ''}lang_pred string, score double")
