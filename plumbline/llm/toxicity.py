"""Toxicity scores from subword-bag embeddings averaged into a linear softmax.

A word is the bag of itself and its character n-grams, each hashed to a row of an embedding table; a text's vector is the average over
its words, and two softmax outputs read it. Table and outputs are trained together in numpy, by gradient descent on the cross entropy in small
batches, with a step that falls in a straight line. Words never seen in training share n-gram vectors with their spellings that were.

Labelled texts become bags in the tasks that read them; one task trains on the bags of a bounded sample and returns the model. The hidden
layer being linear, a score needs of each table row only its product with the outputs' difference, so that is what the model keeps.
"""

from __future__ import annotations

import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from plumbline.llm._common import Recent, batched, columns_of, forget, kept, materialize, rows, short_batches

WORD = re.compile(r"[^\W\d_]+")
BUCKETS = 1 << 17
DIM = 8
GRAMS = (3, 4, 5)
HELD = 100_000  # stretches whose sums a worker keeps at least
SAMPLE = {1: 1500, 0: 3500}  # labelled rows to fit on, by label, at most
POSTINGS = 30_000_000  # table rows of all bags to fit on, at most: 240 MB in one task
RARE = 4  # texts of the sample that a table row must occur in to be fitted
COMMON = 0.05  # share of texts at which a row's weight has fallen to half
SCALE = 40.0  # what the average is multiplied by before the softmax
_PRIME = np.uint64(0x100000001B3)
_MIX = np.uint64(0x9E3779B97F4A7C15)


def _rows(sums: np.ndarray, kind: int) -> np.ndarray:
    """Table rows from polynomial sums of code points; ``kind`` tells n-grams of different lengths apart."""
    h = (sums + np.uint64(kind)) * _MIX
    return ((h ^ (h >> np.uint64(29))) * _MIX >> np.uint64(64 - BUCKETS.bit_length() + 1)).astype(np.int32)


def grams(words: list[str]) -> tuple[np.ndarray, np.ndarray]:
    """(table rows, the position in ``words`` that each belongs to): a word's own row, and those of its n-grams with the ends marked."""
    if not words:
        return np.zeros(0, np.int32), np.zeros(0, np.int64)
    codes = np.frombuffer("".join([f"<{w}>" for w in words]).encode("utf-32-le", "surrogatepass"), np.uint32).astype(np.uint64)
    sizes = np.fromiter(map(len, words), np.int64, len(words)) + 2
    starts = np.cumsum(sizes) - sizes
    owner = np.repeat(np.arange(len(words)), sizes)
    place = np.arange(len(codes)) - starts[owner]
    powers = np.full(int(sizes.max()), _PRIME)
    powers[0] = 1
    found, owners = [_rows(np.add.reduceat(codes * np.cumprod(powers)[place], starts), 0)], [np.arange(len(words))]
    for n in GRAMS:
        at = np.flatnonzero(place + n <= sizes[owner])
        sums = np.zeros(len(at), np.uint64)
        for k in range(n):
            sums = sums * _PRIME + codes[at + k]
        found.append(_rows(sums, n))
        owners.append(owner[at])
    return np.concatenate(found), np.concatenate(owners)


def words_of(text: str) -> list[str]:
    """The words of each different stretch between white space, lower-cased."""
    return [w for run in dict.fromkeys(text.lower().split()) for w in WORD.findall(run)]


def bag(text: str) -> tuple[np.ndarray, np.ndarray]:
    """The different table rows of a text and the share of its average that each gets."""
    row, owner = grams(words := words_of(text))
    share = 1.0 / np.bincount(owner, minlength=1)[owner] / max(len(words), 1)
    row, back = np.unique(row, return_inverse=True)
    return row, np.bincount(back, share, len(row)).astype(np.float32)


class Model:
    """A fitted scorer: a weight and a number for each table row, and a bias. Its size is fixed, whatever it was fitted on."""

    def __init__(self, weigh: np.ndarray, table: np.ndarray, bias: float):
        self.weigh, self.table, self.bias = weigh.astype(np.float32), table.astype(np.float32), float(bias)

    def _sums(self, runs: list[str]) -> dict[str, complex]:
        """For each stretch the sum over its words of their averaged row values, and, as imaginary part, of the rows' weights."""
        words, home = [], []
        for i, run in enumerate(runs):
            held = WORD.findall(run)
            words += held
            home += [i] * len(held)
        row, owner = grams(words)
        size = np.bincount(owner, minlength=len(words))
        weigh = self.weigh[row].astype(float)
        parts = [np.bincount(np.array(home, np.int64), np.bincount(owner, v, len(words)) / size, len(runs)) for v in (weigh * self.table[row], weigh)] if words else np.zeros((2, len(runs)))
        return dict(zip(runs, (parts[0] + 1j * parts[1]).tolist(), strict=True))

    def scores(self, texts: list[str]) -> list[float]:
        """The probability of label 1 of each text; of a text without words, that of the bias."""
        known = kept(self, lambda: Recent(HELD))
        runs = [dict.fromkeys(t.lower().split()) for t in texts]  # in their order, so that equal texts get equal sums
        known.turn()
        new = known.missing({r for each in runs for r in each})
        known.add(self._sums(sorted(new)))
        sums = [sum(map(known.young.__getitem__, each), 0j) for each in runs]
        z = [self.bias + (SCALE * s.real / s.imag if s.imag else 0.0) for s in sums]
        return (1.0 / (1.0 + np.exp(-np.clip(z, -500.0, 500.0)))).tolist()

    def score(self, text: str) -> float:
        return self.scores([text])[0]


def fit(rows_: np.ndarray, shares: np.ndarray, sizes: np.ndarray, labels: np.ndarray, prior: float, updates: int = 2500, batch: int = 32, rate: float = 0.3, seed: int = 5) -> Model:
    """Fit table and outputs on bags, laid end to end (``sizes`` has their lengths), and their labels. ``prior`` is the share of label 1 among all labelled rows, which the sample's may not be."""
    y = np.asarray(labels, np.float32)
    if not len(y) or y.min() == y.max():
        share = min(max(prior, 0.001), 0.999)
        return Model(np.zeros(BUCKETS), np.zeros(BUCKETS), np.log(share / (1 - share)))
    rng = np.random.default_rng(seed)
    # A row that hardly occurs can only remember its text, and one that occurs everywhere says little: the average is weighted.
    spread = np.bincount(rows_, minlength=BUCKETS)
    weigh = np.where(spread >= RARE, COMMON / (COMMON + spread / len(y)), 0.0).astype(np.float32)
    ends = np.cumsum(sizes)
    bags = []
    for end, n in zip(ends, sizes, strict=True):
        row = rows_[end - n : end]
        w = shares[end - n : end] * weigh[row]
        bags.append((row, (w / max(float(w.sum()), 1e-12)).astype(np.float32)))
    table = rng.uniform(-1 / DIM, 1 / DIM, (BUCKETS, DIM)).astype(np.float32)
    out = rng.normal(0, 1, DIM).astype(np.float32)  # the difference of the two softmax outputs
    out /= np.linalg.norm(out)
    table -= np.outer(table @ out, out)  # no row says anything yet
    share = float(y.mean())
    bias = np.log(share / (1 - share))
    docs = np.flatnonzero(sizes)
    order = np.concatenate([rng.permutation(docs) for _ in range(-(-updates * batch // max(len(docs), 1)))]) if len(docs) else docs
    for n in range(updates if len(docs) else 0):
        step = rate * (1 - n / updates)
        some = order[n * batch : (n + 1) * batch]
        row = np.concatenate([bags[d][0] for d in some])
        place = np.repeat(np.arange(len(some)), [len(bags[d][0]) for d in some])
        weight = np.concatenate([bags[d][1] for d in some])
        z = bias + SCALE * np.bincount(place, weight * (table[row] @ out), len(some))
        error = (1 / (1 + np.exp(-np.clip(z, -60, 60))) - y[some]).astype(np.float32)
        pull = np.bincount(row, weight * error[place], BUCKETS).astype(np.float32) * SCALE
        used = np.flatnonzero(pull)
        grad_out = pull[used] @ table[used]
        table[used] -= np.outer(step * pull[used], out)
        out -= 0.01 * step * grad_out
        bias -= 0.01 * step * float(error.sum())
    prior = min(max(prior, 0.001), 0.999)
    return Model(weigh, table @ out, bias + np.log(prior / (1 - prior)) - np.log(share / (1 - share)))


def labelled_bags(docs: DataFrame, labels: DataFrame, id_col: str, text_col: str, label_col: str, label_id: str, sample: dict[int, int], postings: int) -> tuple[DataFrame, float]:
    """(id, label, rows, shares) of a bounded sample of the labelled rows outside the held-out quarter, and the share of label 1 among all of these.

    Rows are chosen by a hash of their id, as many of a label as ``sample`` says, and of those as many as have ``postings`` table rows together.
    An id labelled twice counts as its larger label; null ids and labels, and labels without a document, are left out.
    """
    texts = docs.select(F.col(id_col).cast("long").alias("id"), F.coalesce(F.col(text_col), F.lit("")).alias("text"))
    known = labels.where(F.col(label_id).isNotNull() & F.col(label_col).isNotNull()).groupBy(F.col(label_id).cast("long").alias("label_id")).agg(F.max(F.col(label_col).cast("int")).alias("label"))
    known = known.where(~held_out(F.col("label_id")) & F.col("label").isin(0, 1)).join(texts.select(F.col("id").alias("label_id")), "label_id", "left_semi")
    known = materialize(known, "labelled")
    counts = {r[0]: r[1] for r in known.groupBy("label").count().collect()}
    chosen = known.limit(0)
    for label, n in sample.items():
        chosen = chosen.unionByName(known.where(F.col("label") == label).orderBy(F.xxhash64("label_id"), "label_id").limit(n))
    picked = texts.join(F.broadcast(chosen), F.col("id") == F.col("label_id"))  # at most sum(sample) ids and labels
    schema = pa.schema([("id", pa.int64()), ("label", pa.int32()), ("rows", pa.list_(pa.int32())), ("shares", pa.list_(pa.float32()))])

    def run(batches):
        forget()
        return batched(schema, ((i, label, *bag(text)) for i, label, text in rows(batches, "id", "label", "text")), 64)

    one = picked.groupBy("id", "label").agg(F.min("text").alias("text"))
    bags = materialize(one.mapInArrow(run, "id long, label int, rows array<int>, shares array<float>"), "bags")
    before = F.sum(F.size("rows").cast("long")).over(Window.orderBy(F.xxhash64("id"), "id"))  # over the sample's sizes alone
    fits = bags.select("id", F.size("rows").alias("n"), "rows").select("id", before.alias("upto")).where(F.col("upto") <= postings).select("id")
    return bags.join(F.broadcast(fits), "id"), counts.get(1, 0) / max(1, sum(counts.values()))


def held_out(id_column):
    """Whether a row's label is never learnt from: crc32 of its id as text, modulo 4, is 2."""
    return F.coalesce(F.crc32(id_column.cast("string").cast("binary")) % 4 == 2, F.lit(False))


def fitted(docs: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text", label_col: str = "toxic", label_id: str = "doc_id", sample: dict[int, int] = SAMPLE, postings: int = POSTINGS) -> Model:
    """The model of a documents and a labels table, fitted in one task on at most ``sum(sample)`` labelled rows and ``postings`` table rows."""
    short_batches(docs.sparkSession)
    bags, prior = labelled_bags(docs, labels, id_col, text_col, label_col, label_id, sample, postings)
    schema = pa.schema([("weigh", pa.binary()), ("rows", pa.binary()), ("bias", pa.float64())])

    def train(batches):
        forget()
        parts = [(b.column("rows").flatten().to_numpy(), b.column("shares").flatten().to_numpy(), b.column("rows").value_lengths().to_numpy(), b.column("label").to_numpy()) for b in batches]
        row, share, sizes, kinds = (np.concatenate(x) for x in zip(*parts, strict=True)) if parts else (np.zeros(0),) * 4
        del parts
        model = fit(row, share, sizes, kinds, prior)
        yield from batched(schema, iter([(model.weigh.tobytes(), model.table.tobytes(), model.bias)]))

    one = bags.repartition(1).sortWithinPartitions("id").mapInArrow(train, "weigh binary, rows binary, bias double").first()
    if one is None:
        return fit(*[np.zeros(0, np.int64)] * 4, prior)
    return Model(np.frombuffer(one[0], np.float32), np.frombuffer(one[1], np.float32), one[2])


def scorer(spark: SparkSession, model: Model):
    """A column function from text to score; what is sent to workers has a fixed size of a megabyte."""
    shared = spark.sparkContext.broadcast(model)

    @F.arrow_udf("double")
    def score_texts(parts: Iterator[pa.Array]) -> Iterator[pa.Array]:
        return columns_of(shared.value.scores, pa.float64())(parts)

    return score_texts


def score(docs: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text", threshold: float = 0.3, **fitting) -> DataFrame:
    """(id, held_out, score, predicted) for every row.

    Scores depend on the text alone. Null counts as empty, and an empty text scores the prior; repeated rows and null ids stay; without
    labels of both kinds every score is the prior; an empty table gives an empty result; other columns are not looked at. One pass over
    the texts without a shuffle.
    """
    by_text = scorer(docs.sparkSession, fitted(docs, labels, id_col, text_col, **fitting))
    ids = F.col(id_col).cast("long")
    scored = docs.select(ids.alias("id"), held_out(ids).alias("held_out"), by_text(F.coalesce(F.col(text_col), F.lit(""))).alias("score"))
    return scored.withColumn("predicted", (F.col("score") >= threshold).cast("int"))


def keep_harmless(docs: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text", threshold: float = 0.3, **fitting) -> DataFrame:
    """The rows of ``docs``, all columns, whose score is below the threshold.

    Null and empty texts have the prior as score, so they stay where toxic rows are rare; rows with null ids are scored like any other; repeated
    rows and equal texts stay or go together; an empty table stays empty; no other column is looked at, so no name clashes.
    """
    by_text = scorer(docs.sparkSession, fitted(docs, labels, id_col, text_col, **fitting))
    return docs.where(by_text(F.coalesce(F.col(text_col), F.lit(""))) < threshold)
