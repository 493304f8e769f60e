"""Quality scores without hand labels: overlapping heuristics vote, expectation-maximisation weighs them, a hashed linear scorer learns.

Each heuristic labeller votes good, bad or nothing on a text. The counts of all vote patterns over the whole table, a small table
whatever the corpus, go through expectation-maximisation of a latent-class model: it estimates how often each labeller gives each vote
to good and to bad texts, and with it every pattern's posterior probability of good. Posteriors are the soft labels of a logistic
scorer on hashed features, which grades texts on which all labellers abstain, too.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from plumbline.llm._common import column_of, materialize, short_batches

BUCKETS = 1 << 14
WINDOW = 400  # words over which variety, which falls with length, is taken
SAMPLE = 6000  # rows that the scorer is fitted on, at most
STATISTICS = ("words", "symbols", "capitals", "digits", "bars", "shouts", "echo", "variety", "word_length", "line_repeats", "stops", "letters", "distinct", "passages")

_KIND = np.zeros(256, np.uint8)  # of a byte: 1 letter, 2 capital, 3 digit, 4 white space, 5 sentence mark, 6 symbol
_KIND[33:127] = 6
_KIND[128:] = 1
_KIND[97:123] = 1
_KIND[65:91] = 2
_KIND[48:58] = 3
_KIND[[32, *range(9, 14)]] = 4
_KIND[[ord(c) for c in ".,;:'\"-()?"]] = 5
_MIX = np.array([0x9E3779B97F4A7C15, 0xBF58476D1CE4E5B9, 0x94D049BB133111EB, 0xD6E8FEB86659FD93, 0xA0761D6478BD642F], np.uint64)


def statistics(text: str) -> np.ndarray:
    """The numbers that labellers and features look at, in the order of ``STATISTICS``; shares are between 0 and 1."""
    data = text.encode()
    words = data.lower().split()
    n = len(words)
    if not n:
        return np.zeros(len(STATISTICS))
    kinds = np.bincount(_KIND[np.frombuffer(data, np.uint8)], minlength=7)
    shown = len(data) - kinds[4]
    letters = kinds[1] + kinds[2]
    lines = [x for x in data.split(b"\n") if x]
    # all windows have the same length, so the last one goes back into the one before
    starts = [*range(0, n - WINDOW, WINDOW), max(n - WINDOW, 0)]
    variety = sum(len(set(words[i : i + WINDOW])) for i in starts) / (len(starts) * min(n, WINDOW))
    marks = np.fromiter(map(zlib.crc32, words), np.uint64, n)
    fives = sum((marks[i : max(n - 4 + i, i)] * _MIX[i] for i in range(5)), np.zeros(max(n - 4, 0), np.uint64))  # a hash of every five words in a row
    return np.array([
        n,
        kinds[6] / shown,
        kinds[2] / max(letters, 1),
        kinds[3] / shown,
        data.count(b" | ") / n,
        data.count(b"!!") / n,
        sum(map(bytes.__eq__, words, words[1:])) / n,
        variety,
        shown / n,
        1 - len(set(lines)) / max(len(lines), 1),
        data.count(b". ") / n,
        letters / shown,
        len(set(words)) / n,
        1 - len(np.unique(fives)) / max(len(fives), 1) if n > 4 else 0.0,
    ])


@dataclass(frozen=True)
class Labeller:
    """Votes bad (-1) above ``bad``, good (1) below ``good`` (the other way round if ``good`` is larger), else nothing, on texts of ``least`` words or more."""

    name: str
    statistic: str
    good: float
    bad: float
    least: int = 5

    def vote(self, x: np.ndarray) -> int:
        if x[0] < self.least:
            return 0
        v = x[STATISTICS.index(self.statistic)]
        if self.good < self.bad:
            return 1 if v <= self.good else -1 if v >= self.bad else 0
        return 1 if v >= self.good else -1 if v <= self.bad else 0


LABELLERS = (
    Labeller("symbol share", "symbols", 0.02, 0.08),
    Labeller("capital share", "capitals", 0.15, 0.5),
    Labeller("table bars", "bars", 0.0, 0.1),
    Labeller("exclamations", "shouts", 0.005, 0.1),
    Labeller("echoed words", "echo", 0.02, 0.2),
    Labeller("variety", "variety", 0.5, 0.25, least=30),
    Labeller("word length", "word_length", 9.0, 16.0),
    Labeller("letter share", "letters", 0.9, 0.8),
    Labeller("repeated lines", "line_repeats", 0.1, 0.4, least=30),
    Labeller("repeated passages", "passages", 0.1, 0.4, least=30),
)


def pattern(x: np.ndarray) -> str:
    """All labellers' votes as one string of +, - and 0."""
    return "".join("-0+"[label.vote(x) + 1] for label in LABELLERS)


@dataclass
class WeakLabels:
    """The latent-class model: ``prior`` of good, and for class c (0 bad, 1 good) and labeller l the probabilities ``votes[c, l]`` of - and + where it votes. No vote tells nothing (a factor of one)."""

    prior: float
    votes: np.ndarray

    def posterior(self, patterns: list[str]) -> np.ndarray:
        """The probability of good for each pattern."""
        at = np.array([["-0+".index(v) for v in p] for p in patterns]).reshape(len(patterns), -1)
        logs = np.log(self.votes)
        each = logs[:, np.arange(at.shape[1])[None, :], at].sum(axis=2) if at.size else np.zeros((2, len(patterns)))
        z = each[1] - each[0] + np.log(self.prior / (1 - self.prior))
        return 1 / (1 + np.exp(-np.clip(z, -500, 500)))


def expectation_maximisation(counts: dict[str, int], rounds: int = 200, settled: float = 1e-7) -> WeakLabels:
    """Fit the labellers' accuracies to pattern counts. It starts from the votes' majority; one pseudo-count keeps all probabilities positive.

    Labellers are taken to do better than chance: where a fit would turn the classes round, they are turned back.
    """
    patterns = sorted(counts)
    n = np.array([counts[p] for p in patterns], float)
    at = np.array([["-0+".index(v) for v in p] for p in patterns]).reshape(len(patterns), -1)
    lean = (at - 1).sum(axis=1)
    bad_votes = (at == 0).sum(axis=1)
    good = np.where(bad_votes == 0, np.where(lean > 0, 0.9, 0.7), np.where(bad_votes == 1, 0.4, 0.1))
    model = WeakLabels(0.5, np.ones((2, at.shape[1], 3)))
    for _ in range(rounds):
        mass = np.stack([n * (1 - good), n * good])
        votes = np.stack([[[m[at[:, k] == v].sum() + 1.0 for v in (0, 2)] for k in range(at.shape[1])] for m in mass])
        votes /= votes.sum(axis=2, keepdims=True)
        model = WeakLabels(float((mass[1].sum() + 1) / (n.sum() + 2)), np.insert(votes, 1, 1.0, axis=2))
        new = model.posterior(patterns)
        if np.abs(new - good).max(initial=0) < settled:
            break
        good = new
    favour = (model.votes[1, :, 2] - model.votes[1, :, 0] - model.votes[0, :, 2] + model.votes[0, :, 0]).sum()
    return model if favour >= 0 else WeakLabels(1 - model.prior, model.votes[::-1])


_EDGES = (0.0, 0.002, 0.005, 0.01, 0.02, 0.04, 0.07, 0.1, 0.15, 0.2, 0.3, 0.4, 0.5, 0.6, 0.7, 0.8, 0.9, 0.95)


def features(x: np.ndarray) -> list[int]:
    """Hashed features: each statistic's bin, and the bins of two statistics together."""
    bins = []
    for name, v in zip(STATISTICS, x, strict=True):
        b = int(np.log2(v + 1) * 2) if name in ("words", "word_length") else int(np.searchsorted(_EDGES, v, "right"))
        bins.append(f"{name}={b}")
    names = bins + [f"{a}&{b}" for i, a in enumerate(bins) for b in bins[:i]]
    return [zlib.crc32(f.encode()) % BUCKETS for f in names]


class Scorer:
    """A logistic scorer on hashed features; its size is fixed."""

    def __init__(self, weights: np.ndarray, bias: float):
        self.weights, self.bias = weights.astype(np.float32), float(bias)

    def score(self, text: str) -> float:
        """The probability of good; a text without words gets the prior."""
        x = statistics(text)
        z = self.bias + (float(self.weights[features(x)].sum()) if x[0] else 0.0)
        return float(1 / (1 + np.exp(-min(max(z, -500.0), 500.0))))


def fit_scorer(rows: list[list[float]], soft: np.ndarray, prior: float, epochs: int = 8, rate: float = 0.05, decay: float = 1e-4, seed: int = 9) -> Scorer:
    """Stochastic gradient descent on the cross entropy against soft labels."""
    weights, bias = np.zeros(BUCKETS), float(np.log(prior / (1 - prior)))
    held = [(np.array(features(np.array(x))), y) for x, y in zip(rows, soft, strict=True) if x[0]]
    rng = np.random.default_rng(seed)
    for epoch in range(epochs):
        step = rate * (1 - epoch / epochs)
        for i in rng.permutation(len(held)):
            f, y = held[i]
            error = 1 / (1 + np.exp(-np.clip(bias + weights[f].sum(), -60, 60))) - y
            weights[f] -= step * (error + decay * weights[f])
    return Scorer(weights, bias)


def fitted(docs: DataFrame, text_col: str = "text", sample: int = SAMPLE) -> tuple[WeakLabels, Scorer]:
    """Weak labels from the vote patterns of all rows, and a scorer from a bounded sample of them.

    Patterns are counted before the shuffle; there are at most 3 to the number of labellers. The sample takes one row, that of least
    hash, of each of a pattern's two hundred slots of hashes, so rare patterns are learnt as well; then ``sample`` of those.
    """
    short_batches(docs.sparkSession)
    kind = pa.struct([("pattern", pa.string()), ("x", pa.list_(pa.float64()))])

    def seen_in(text: str) -> dict:
        x = statistics(text)
        return {"pattern": pattern(x), "x": x.tolist()}

    @F.arrow_udf("struct<pattern string, x array<double>>")
    def look(parts: Iterator[pa.Array]) -> Iterator[pa.Array]:
        return column_of(seen_in, kind)(parts)

    text = F.coalesce(F.col(text_col), F.lit(""))
    seen = docs.select(look(text).alias("v"), F.xxhash64(text).alias("mark")).select("v.pattern", "v.x", "mark")
    slot = F.pmod(F.col("mark"), F.lit(200)).cast("int")
    sketch = seen.groupBy("pattern", slot.alias("slot")).agg(F.count("*").alias("n"), F.min_by("x", "mark").alias("x"))
    sketch = materialize(sketch, "vote-patterns")
    counts = {r[0]: r[1] for r in sketch.groupBy("pattern").agg(F.sum("n")).collect()}
    if not counts:
        return WeakLabels(0.5, np.ones((2, len(LABELLERS), 3))), Scorer(np.zeros(BUCKETS), 0.0)
    weak = expectation_maximisation(counts)
    picked = sketch.orderBy(F.hash("slot", "pattern"), "pattern", "slot").limit(sample).select("pattern", "x").collect()
    return weak, fit_scorer([r.x for r in picked], weak.posterior([r.pattern for r in picked]), min(max(weak.prior, 0.01), 0.99))


def scorer(spark: SparkSession, model: Scorer):
    """A column function from text to score."""
    shared = spark.sparkContext.broadcast(model)

    @F.arrow_udf("double")
    def score_texts(parts: Iterator[pa.Array]) -> Iterator[pa.Array]:
        return column_of(shared.value.score, pa.float64())(parts)

    return score_texts


def score(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", threshold: float = 0.5, sample: int = SAMPLE) -> DataFrame:
    """(id, score, keep) for every row.

    Scores depend on the texts alone. Null counts as empty, and a text without words scores the share of good texts; repeated rows
    and null ids stay; an empty table gives an empty result; other columns are not looked at.
    """
    _, model = fitted(docs, text_col, sample)
    by_text = scorer(docs.sparkSession, model)
    return docs.select(F.col(id_col).cast("long").alias("id"), by_text(F.coalesce(F.col(text_col), F.lit(""))).alias("score")).withColumn("keep", F.col("score") >= threshold)


def keep_good(docs: DataFrame, text_col: str = "text", threshold: float = 0.5, sample: int = SAMPLE) -> DataFrame:
    """The rows of ``docs``, all columns, whose score reaches the threshold.

    Null and empty texts score the share of good texts; rows with null ids are scored like any other; repeated rows and equal texts stay or go
    together; an empty table stays empty; long texts are read whole; no other column is looked at, so no name clashes.
    """
    _, model = fitted(docs, text_col, sample)
    return docs.where(scorer(docs.sparkSession, model)(F.coalesce(F.col(text_col), F.lit(""))) >= threshold)
