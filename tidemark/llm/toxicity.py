"""Toxicity severity by cumulative-link ordinal regression.

P(severity <= k) = sigmoid(threshold_k - weights . features): one weight vector for
all ordered thresholds. Features are which of a bounded list of words and word beginnings a text holds;
the list and the weights are fitted on a bounded sample of labelled documents
(``sample_rows``, chosen by a hash of the id), everything else covers all rows.

Null and empty texts have no features and take the severity that the thresholds give.
Without labels, or with one grade only, that grade is everyone's severity. Documents
with several labels count once for each.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from . import common

WORD = regex.compile(r"[^\W\d_]+")


#: Lengths of the word beginnings that are features beside whole words; a hyphen marks them.
STEMS = (3, 4, 5, 6)
REMEMBERED = 100_000


def words_of(text: str) -> set[str]:
    return set(WORD.findall(text.lower()))


def features_of(word: str) -> list[str]:
    """A word and its beginnings: inflected forms of rare words share these."""
    return [word, *[word[:n] + "-" for n in STEMS if len(word) >= n]]


@dataclass
class OrdinalModel:
    """Weights shared by the ordered ``thresholds`` between ``grades``."""

    grades: list[int]
    words: dict[str, float] = field(default_factory=dict)
    thresholds: list[float] = field(default_factory=list)
    known: dict[str, tuple[str, ...]] = field(default_factory=dict)

    def weighted(self, word: str) -> tuple[str, ...]:
        """The features of a word that have a weight, remembered within a bound."""
        if len(self.known) >= REMEMBERED:
            self.known.clear()
        found = self.known[word] = tuple(f for f in features_of(word) if f in self.words)
        return found

    def above(self, text: str) -> list[float]:
        """P(severity > k) for each threshold."""
        known, have = self.known, set()
        for word in words_of(text):
            found = known.get(word)
            if found is None:
                found = self.weighted(word)
            if found:
                have.update(found)
        z = sum(sorted(self.words[f] for f in have))
        return [1.0 / (1.0 + np.exp(min(700.0, t - z))) for t in self.thresholds]

    def expected(self, text: str) -> tuple[float, int]:
        """Expected severity, and the highest grade with a probability over one half of being reached."""
        above, mean, grade = self.above(text), float(self.grades[0]), self.grades[0]
        for k, p in enumerate(above):
            mean += p * (self.grades[k + 1] - self.grades[k])
            if p > 0.5:
                grade = self.grades[k + 1]
        return mean, grade


def fit_thresholds(x: np.ndarray, y: np.ndarray, levels: int, l2: float = 1e-4, steps: int = 400, rate: float = 0.1) -> tuple[np.ndarray, np.ndarray]:
    """Weights and ordered thresholds of the cumulative-link model, by Adam on the mean log-likelihood."""
    n, d = x.shape
    share = np.clip(np.array([(y <= k).mean() for k in range(levels - 1)]), 1e-3, 1 - 1e-3)
    start = np.log(share / (1 - share))
    # Gaps between thresholds stay positive as exponentials.
    p = np.concatenate([np.zeros(d), start[:1], np.log(np.maximum(np.diff(start), 1e-2))])
    m, v = np.zeros_like(p), np.zeros_like(p)
    inf = np.array([np.inf])
    for t in range(1, steps + 1):
        gaps = np.exp(p[d + 1 :])
        theta = np.concatenate([-inf, p[d] + np.concatenate([[0.0], np.cumsum(gaps)]), inf])
        z = x @ p[:d]
        hi, lo = (1 / (1 + np.exp(-np.clip(theta[k] - z, -500, 500))) for k in (y + 1, y))
        like = np.maximum(hi - lo, 1e-12)
        dhi, dlo = hi * (1 - hi) / like, lo * (1 - lo) / like
        g = np.empty_like(p)
        g[:d] = x.T @ (dhi - dlo) / n + l2 * p[:d]
        per = np.array([-(dhi[y == k].sum() - dlo[y == k + 1].sum()) / n for k in range(levels - 1)])
        tail = np.cumsum(per[::-1])[::-1]
        g[d] = tail[0]
        g[d + 1 :] = tail[1:] * gaps
        m = 0.9 * m + 0.1 * g
        v = 0.999 * v + 0.001 * g * g
        p = p - rate * (m / (1 - 0.9**t)) / (np.sqrt(v / (1 - 0.999**t)) + 1e-8)
    theta = p[d] + np.concatenate([[0.0], np.cumsum(np.exp(p[d + 1 :]))])
    return p[:d], theta


def fit(docs: DataFrame, labels: DataFrame, grade: str | Column = "toxic", sample_rows: int = 8000, features: int = 1024, least: int = 3) -> OrdinalModel:
    """Fit on at most ``sample_rows`` labelled documents. Features are picked by their share in graded documents against ungraded ones."""
    graded = labels.select(F.col("doc_id").alias("_id"), (F.col(grade) if isinstance(grade, str) else grade).cast("int").alias("grade")).where("grade is not null and _id is not null")
    chosen = graded.orderBy(F.xxhash64("_id"), "_id", "grade").limit(sample_rows)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[dict]:
        for batch in batches:
            yield {"grade": batch.column("grade"), "words": [sorted({f for w in words_of(t) for f in features_of(w)}) for t in common.text_rows(batch)]}

    sample = common.map_arrow(docs.select("doc_id", "text").join(chosen, F.col("doc_id") == F.col("_id")).select("text", "grade"), run, "grade int, words array<string>")
    sample = common.stash(sample, "graded")
    sizes = {r["grade"]: r["n"] for r in sample.groupBy("grade").agg(F.count("*").alias("n")).collect()}
    grades = sorted(sizes) or [0]
    if len(grades) < 2:
        return OrdinalModel(grades)
    low, total = grades[0], sum(sizes.values())
    rest = total - sizes[low]
    counts = sample.select("grade", F.explode("words").alias("word")).groupBy("word").agg(F.count_if(F.col("grade") > low).alias("hot"), F.count("*").alias("n")).where(F.col("n") >= least)
    rate = lambda x, n: (x + 0.5) / (n + 1.0)
    score = (rate(F.col("hot"), F.lit(rest)) - rate(F.col("n") - F.col("hot"), F.lit(sizes[low]))) / F.sqrt((F.col("n") + 1) / F.lit(total + 2.0))
    picked = [r["word"] for r in counts.orderBy(F.abs(score).desc(), "word").limit(features).collect()]
    place = {w: k for k, w in enumerate(picked)}
    rows = sample.select("grade", F.array_intersect("words", F.array(*map(F.lit, picked))).alias("words")).collect()
    x, y = np.zeros((len(rows), len(picked))), np.array([grades.index(r["grade"]) for r in rows])
    for k, r in enumerate(rows):
        x[k, [place[w] for w in r["words"]]] = 1.0
    weights, thresholds = fit_thresholds(x, y, len(grades))
    return OrdinalModel(grades, {w: float(weights[k]) for w, k in place.items()}, [float(t) for t in thresholds])


def score(docs: DataFrame, model: OrdinalModel, expected: str = "expected_severity", severity: str = "severity") -> DataFrame:
    """All columns plus the expected severity and the grade; columns of these names are replaced. The model's size is that of its word list."""
    docs = docs.drop(expected, severity)
    names = docs.columns
    shared = docs.sparkSession.sparkContext.broadcast(model)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[dict]:
        own = shared.value
        common.remembered("toxicity", dict)  # what another operator kept goes
        for batch in batches:
            found = [own.expected(t) for t in common.text_rows(batch)]
            yield {c: batch.column(c) for c in names} | {expected: [round(m, 6) for m, _ in found], severity: [g for _, g in found]}

    return common.map_arrow(docs, run, common.widened(docs, **{expected: "double", severity: "int"}))


def reject(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """Documents that the model gives the lowest grade; rows without text stay, whatever the grade of an empty text."""
    model = fit(docs, labels)
    empty = F.coalesce("text", F.lit("")) == ""
    expected, severity = common.free(docs, "_tm_expected", "_tm_severity")
    kept = score(docs, model, expected, severity).where((F.col(severity) == model.grades[0]) | empty)
    return kept.drop(expected, severity)


