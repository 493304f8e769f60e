"""The manifest against a plain recursion over lists."""

import hashlib
import random
import zlib

import pytest
from pyspark.sql import functions as F

from plumbline.llm import merkle

SCHEMA = "doc_id long, source string, lang string, n_chars long, text string, leaf int, tree string"


def h(*parts):
    return hashlib.sha256("".join(parts).encode()).hexdigest()


def leaf_of(row, text):
    return h(*("-" if v is None else f"{len(str(v).encode())}:{v}" for v in (*row[:4], text)))


def climb(nodes):
    """The root of a list of digests, and each one's siblings (before, after) level by level."""
    ways, at = [[] for _ in nodes], list(range(len(nodes)))
    while len(nodes) > 1:
        for i, place in enumerate(at):
            run = place // 3 * 3
            ways[i].append(("".join(nodes[run:place]), "".join(nodes[place + 1 : run + 3])))
        nodes = [h(*nodes[q : q + 3]) for q in range(0, len(nodes), 3)]
        at = [place // 3 for place in at]
    return nodes[0], ways


def plain(data):
    by_source = {}
    for row in data:
        by_source.setdefault(row[1], []).append((row[0] is not None, row[0] or 0, leaf_of(row, row[4]), row))
    sources = sorted(by_source, key=lambda s: (s is not None, (s or "").encode()))
    trees = {s: climb([x[2] for x in sorted(by_source[s], key=lambda x: x[:3])]) for s in sources}
    root, upper = climb([trees[s][0] for s in sources])
    out = []
    for s, up in zip(sources, upper, strict=True):
        for (_, _, leaf, row), way in zip(sorted(by_source[s], key=lambda x: x[:3]), trees[s][1], strict=True):
            tampered = row[0] is not None and zlib.crc32(str(row[0]).encode()) % 2 == 0 and row[4] is not None
            x = leaf_of(row, row[4].replace("\n", "")) if tampered else leaf
            for before, after in way + up:
                x = h(before, x, after)
            out.append((row[0], leaf, trees[s][0], root, h(*(b + a for b, a in way + up)), x, x == root))
    return out


def documents():
    rnd = random.Random(3)
    sources = ["a", "b", "B", "é", None, "", "-", "=", "𐀀", "￿", "lone"]
    ids = [*range(200), *range(10**12, 10**12 + 40), -5, -(1 << 63), (1 << 63) - 1]
    data = [(i, "a" if rnd.random() < 0.4 else rnd.choice(sources[:-1]), rnd.choice(["en", None]), rnd.choice([None, 3]), rnd.choice([None, "", "x", "a\nb", "ü\n" * 3, "\n"]), 7, "clash") for i in ids]
    data += [(5, "a", "en", 1, "same\n", 1, "t")] * 60 + [(6, "a", "en", i, "other\n", 1, "t") for i in range(70)]
    data += [(None, None, None, None, None, None, None)] * 30 + [(None, "a", None, i, "no id\n", None, None) for i in range(60)]
    data += [(9, "lone", "en", 1, "one\n", 1, None), (77, "big", "en", 1, "w\n" * 200_000, 1, None)]
    rnd.shuffle(data)
    return data


def key(row):
    return tuple(str(x) for x in row)


@pytest.mark.parametrize(("tier", "most"), [(6, 4096), (1, 3), (2, 20)])
def test_against_recursion(spark, monkeypatch, tier, most):
    monkeypatch.setattr(merkle, "TIER", tier)
    monkeypatch.setattr(merkle, "MOST", most)
    data = documents() if tier == 6 else documents()[:250]
    got = merkle.manifest(spark.createDataFrame(data, SCHEMA))
    assert got.columns == ["doc_id", "leaf", "subroot", "root", "proof_sha256", "folded_root", "verified"]
    assert sorted(map(tuple, got.collect()), key=key) == sorted(plain(data), key=key)


@pytest.mark.parametrize("n", [1, 2, 3, 4, 9, 10])
def test_small_trees(spark, n):
    data = [(i, "s", "en", 1, "a\nb", 1, "x") for i in range(n)]
    assert sorted(map(tuple, merkle.manifest(spark.createDataFrame(data, SCHEMA)).collect()), key=key) == sorted(plain(data), key=key)


def test_no_documents(spark):
    got = merkle.manifest(spark.createDataFrame([], SCHEMA))
    assert got.collect() == [] and len(got.columns) == 7


def test_ranks_of_a_crowded_id(spark, monkeypatch):
    """An id that most rows have is told apart by digests' digits, in more than one step."""
    monkeypatch.setattr(merkle, "MOST", 2)
    rows = [("t", "1" + f"{4:016x}" + hashlib.sha256(str(i).encode()).hexdigest(), 1 + i % 3) for i in range(90)] + [("u", "0" * 17 + "ab", 2)]
    got = {r.key: (r.first, r.total) for r in merkle.ranked(spark.createDataFrame(rows, "tree string, key string, n long")).collect()}
    before = 0
    for _, k, n in sorted(rows[:-1]):
        assert got[k] == (before, sum(r[2] for r in rows[:-1]))
        before += n
    assert got["0" * 17 + "ab"] == (0, 2)


def test_untouched_documents_are_folded_too(spark, monkeypatch):
    """With a wrong sibling on every way no document may be found whole, whether its text was tampered with or not."""
    way = merkle._way
    monkeypatch.setattr(merkle, "_way", lambda i: F.transform(way(i), lambda s: F.struct(s.before.alias("before"), F.concat(s.after, F.lit("0")).alias("after"))))
    data = [(i, "s", "en", 1, "no line feed", 1, "x") for i in range(5)]
    got = merkle.manifest(spark.createDataFrame(data, SCHEMA)).collect()
    assert len(got) == 5 and not any(r.verified or r.folded_root == r.root for r in got)
