"""Near copies against plain shingle similarity, and the defined results of odd inputs."""

import random

import pytest

from plumbline.llm import simhash_groups

SCHEMA = "doc_id long, text string, gone string, id string, node int"


def shingles(text, words=5):
    held = (text or "").lower().split()
    return {tuple(held[i : i + words]) for i in range(max(1, len(held) - words + 1))} if held else set()


def brute(rows, least=0.8):
    """The group of each row, by the similarity of all pairs."""
    sets = [shingles(t) for _, t in rows]
    group = list(range(len(rows)))
    for i in range(len(rows)):
        for j in range(i):
            both = len(sets[i] | sets[j])
            if not both or len(sets[i] & sets[j]) >= least * both:
                old, new = group[i], group[j]
                group = [new if g == old else g for g in group]
    smallest = {}
    for (d, _), g in zip(rows, group, strict=True):
        smallest[g] = min(d, smallest.get(g, d))
    return sorted((d, smallest[g]) for (d, _), g in zip(rows, group, strict=True))


def frame(spark, rows):
    return spark.createDataFrame([(d, t, "x", "y", 1) for d, t in rows], SCHEMA)


def planted():
    rnd = random.Random(11)
    lexicon = [f"word{i}" for i in range(3000)]
    rows = []
    for g in range(25):
        base = [rnd.choice(lexicon) for _ in range(rnd.randint(150, 400))]
        for _ in range(rnd.choice([1, 2, 3, 6])):
            text = list(base)
            for _ in range(len(base) // 150):  # a similarity of some 0.93
                text[rnd.randrange(len(text))] = rnd.choice(lexicon)
            rows.append((1000 - len(rows), " ".join(text)))
    return rows


def test_against_all_pairs(spark):
    rows = planted() + [(5, None), (6, ""), (7, " \t"), (8, "one"), (9, "ONE"), (10, "two three")]
    assert sorted(map(tuple, simhash_groups.groups(frame(spark, rows)).collect())) == brute(rows)


@pytest.mark.parametrize("most, outsiders", [(2, 0), (4, 4)])
def test_crowds_lose_no_pair(spark, most, outsiders):
    """With such small limits nearly every shared shingle is a crowd: hubs, then outsiders, then all."""
    rnd = random.Random(5)
    passage = [f"p{i}" for i in range(60)]
    texts = []
    for i in range(60):
        base = passage[: rnd.choice([20, 40, 60])] + [f"w{rnd.getrandbits(40)}" for _ in range(rnd.choice([20, 60, 100]))]
        texts += [base, base[:-1] + [f"x{i}"]]
    rows = [(i, " ".join(t)) for i, t in enumerate(texts)]
    found = simhash_groups.groups(frame(spark, rows), most=most, outsiders=outsiders)
    assert sorted(map(tuple, found.collect())) == brute(rows)


def test_keep_first_keeps_columns_and_null_ids(spark):
    rows = [(4, "a b c d e f"), (2, "A b c d e f"), (2, "A b c d e f"), (None, "a b c d e f"), (9, "g h i j k l")]
    kept = simhash_groups.keep_first(frame(spark, rows))
    assert kept.columns == ["doc_id", "text", "gone", "id", "node"]
    assert sorted((r.doc_id for r in kept.collect()), key=str) == [2, 2, 9, None]
    assert simhash_groups.keep_first(frame(spark, [])).collect() == []


def test_edges_of_the_threshold(spark):
    """Appended, truncated and short texts at 0.80 to 0.85, as all pairs have it."""
    rnd = random.Random(21)
    fresh = lambda n: [f"w{rnd.getrandbits(40)}" for _ in range(n)]
    texts = []
    for _ in range(30):
        base = fresh(rnd.randint(60, 200))
        texts += [base, base + fresh(int(len(base) * rnd.uniform(0.17, 0.27)))]
        long = fresh(rnd.randint(60, 200))
        texts += [long, long[: int(len(long) * rnd.uniform(0.78, 0.86))]]
        short = fresh(25)
        texts += [short, short[:-2] + fresh(2)]
    rows = [(i, " ".join(t)) for i, t in enumerate(texts)]
    assert sorted(map(tuple, simhash_groups.groups(frame(spark, rows)).collect())) == brute(rows)


def test_shared_passages_hide_no_copies(spark):
    """A passage that 120 otherwise different texts share, and 20 near copies among them."""
    rnd = random.Random(22)
    passage = [f"p{i}" for i in range(150)]
    texts = [passage + [f"w{rnd.getrandbits(40)}" for _ in range(rnd.choice([20, 30, 60]))] for _ in range(120)]
    texts += [t[:-3] + ["x", "y", f"z{i}"] for i, t in enumerate(texts[:20])]
    rows = [(i, " ".join(t)) for i, t in enumerate(texts)]
    assert sorted(map(tuple, simhash_groups.groups(frame(spark, rows)).collect())) == brute(rows)
