"""The two classifiers: held-out accuracy, odd rows, and the expectation-maximisation on data with known accuracies."""

import random
import zlib

import numpy as np

from plumbline.llm import quality, toxicity

WORDS = "alpha beta gamma delta house garden river mountain window letter paper stone cloud forest music".split()
BAD = ["scoundrel", "scoundrelly", "blockhead", "blockheads", "nitwit"]
ROWS = "doc_id long, text string, score string, id int, lang string"


def prose(rnd, bad=False, n=60):
    words = [rnd.choice(WORDS) + rnd.choice(["", "s", "ing", "ed"]) for _ in range(n)]
    if bad:
        for _ in range(3):
            words[rnd.randrange(n)] = rnd.choice(BAD)
    return " ".join(words)


def test_toxicity_held_out_and_misspelt(spark):
    rnd = random.Random(2)
    data = [(i, prose(rnd, i % 5 == 0), "x", 1, "en") for i in range(500)] + [(None, None, "x", 1, "en"), (901, "", "x", 1, "en"), (902, "q" * 50_000, "x", 1, "en"), (903, data_text := prose(rnd, True), "x", 1, "en"), (903, data_text, "x", 1, "en")]
    labels = spark.createDataFrame([(i, int(i % 5 == 0), 1) for i in range(500)] + [(None, 1, 1), (3, None, 1)], "doc_id long, toxic int, quality int")
    got = toxicity.score(spark.createDataFrame(data, ROWS), labels).collect()
    assert len(got) == len(data)
    for r in got:
        assert r.held_out == (r.id is not None and zlib.crc32(str(r.id).encode()) % 4 == 2)
        assert 0 <= r.score <= 1 and r.predicted == int(r.score >= 0.3)
    held = [r for r in got if r.held_out and r.id < 500]
    assert sum(r.predicted == int(r.id % 5 == 0) for r in held) / len(held) > 0.95
    assert len({r.score for r in got if r.id == 903}) == 1
    bags = [toxicity.bag(d[1]) for d in data[:500]]
    model = toxicity.fit(*(np.concatenate(x) for x in zip(*bags)), np.array([len(b[0]) for b in bags]), np.array([int(i % 5 == 0) for i in range(500)]), 0.2)
    clean, toxic = prose(rnd), prose(rnd).replace(WORDS[0], "scoundreI blokhead")
    assert model.score(clean + " scoundrelz blockheadd") > model.score(clean) and toxic


def test_toxicity_without_labels_or_rows(spark):
    docs = spark.createDataFrame([(1, "a b", "x", 1, "en")], ROWS)
    none = spark.createDataFrame([], "doc_id long, toxic int")
    assert [r.predicted for r in toxicity.score(docs, none).collect()] == [0]
    assert toxicity.score(docs.limit(0), none).count() == 0
    assert toxicity.keep_harmless(docs, none).columns == docs.columns


def test_expectation_maximisation_finds_accuracies():
    rng = np.random.default_rng(4)
    n, right = 20_000, np.array([0.95, 0.8, 0.7, 0.9, 0.85])
    good = rng.random(n) < 0.7
    votes = np.where(rng.random((n, 5)) < right, np.where(good, 1, -1)[:, None], np.where(good, -1, 1)[:, None])
    votes[rng.random((n, 5)) < 0.2] = 0
    names = ["".join("-0+"[v + 1] for v in row) for row in votes]
    counts = {p: names.count(p) for p in set(names)}
    weak = quality.expectation_maximisation(counts)
    assert abs(weak.prior - 0.7) < 0.03
    assert np.abs(weak.votes[1, :, 2] - right).max() < 0.03 and np.abs(weak.votes[0, :, 0] - right).max() < 0.03
    assert ((weak.posterior(names) > 0.5) == good).mean() > 0.93
    assert abs(weak.posterior(["00000"])[0] - weak.prior) < 1e-9


def test_quality_keeps_prose_and_drops_junk(spark):
    rnd = random.Random(3)
    good = [". ".join(prose(rnd, n=12).capitalize() for _ in range(rnd.randint(2, 9))) + "." for _ in range(200)]
    junk = [" ".join(w + rnd.choice(["###", "$$$", "%%%"]) for w in prose(rnd).split()) for _ in range(30)] + [prose(rnd).upper().replace(" ", "!! ") for _ in range(30)]
    texts = good + junk + [None, "", "One two.", "z" * 50_000]
    df = spark.createDataFrame([(i, t, "x", 1, "en") for i, t in enumerate(texts)] + [(None, good[0], "x", 1, "en")], ROWS)
    got = {r.id: r.keep for r in quality.score(df).collect()}
    assert all(got[i] for i in range(len(good))) and not any(got[len(good) + i] for i in range(len(junk)))
    assert got[len(good) + len(junk)] and got[len(good) + len(junk) + 1] and got[None]
    kept = quality.keep_good(df)
    assert kept.columns == df.columns and kept.count() == len(good) + 1 + sum(got[i] for i in range(260, 264))
    assert quality.score(df.limit(0)).count() == 0


def test_statistics_take_every_word():
    at = {k: i for i, k in enumerate(quality.STATISTICS)}
    half = quality.statistics(" ".join(w for i in range(250) for w in (f"w{i}", "x")))  # every second word is the same
    assert abs(half[at["variety"]] - 201 / 400) < 1e-9
    short, longer = (quality.statistics(" ".join(f"w{i % 100}" for i in range(n))) for n in (400, 401))
    assert abs(short[at["variety"]] - longer[at["variety"]]) < 1e-9
    far = quality.statistics(" ".join([f"w{i}" for i in range(300)] * 1000))
    assert abs(far[at["distinct"]] - 0.001) < 1e-9 and far[at["passages"]] > 0.99 and "-" in quality.pattern(far)


def test_grams_are_those_of_a_plain_loop():
    """Rows of a batch of words against each word by itself; their number is that of the n-grams of the marked word, and one."""
    words = ["a", "ab", "straße", "日本", "x" * 300, "ab"]
    row, owner = toxicity.grams(words)
    for i, w in enumerate(words):
        alone, _ = toxicity.grams([w])
        assert row[owner == i].tolist() == alone.tolist()
        assert len(alone) == 1 + sum(max(0, len(w) + 3 - n) for n in toxicity.GRAMS)
    shared = set(toxicity.grams(["blockhead"])[0].tolist()) & set(toxicity.grams(["blokhead"])[0].tolist())
    assert len(shared) > 5 and 0 <= row.min() and row.max() < toxicity.BUCKETS


def test_the_sample_is_bounded_and_labels_without_documents_take_no_place(spark):
    docs = spark.createDataFrame([(i, f"word{i} and some others", "x", 1, "en") for i in range(60)], ROWS)
    labels = spark.createDataFrame([(i, i % 2) for i in range(400)], "doc_id long, toxic int")
    bags, _ = toxicity.labelled_bags(docs, labels, "doc_id", "text", "toxic", "doc_id", {1: 10, 0: 12}, 1 << 40)
    held = bags.collect()
    assert sum(r.label for r in held) == 10 and len(held) == 22 and not any(zlib.crc32(str(r.id).encode()) % 4 == 2 for r in held)
    few, _ = toxicity.labelled_bags(docs, labels, "doc_id", "text", "toxic", "doc_id", {1: 10, 0: 12}, 300)
    assert 0 < sum(len(r.rows) for r in few.collect()) <= 300
