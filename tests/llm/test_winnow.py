"""Winnowing against a plain version, its guarantee, and the next-row pass."""

import hashlib
import random

import pytest

from plumbline.llm import winnow
from plumbline.llm.winnow import edited, likeness, render, selected

ROWS = "doc_id long, text string, id string, part int, last boolean"
MASK = (1 << 64) - 1


def plain_hash(gram):
    h = sum((ord(c) + 1) * pow(winnow._BASE, j, 1 << 64) for j, c in enumerate(gram)) & MASK
    h ^= h >> 33
    h = h * 0xFF51AFD7ED558CCD & MASK
    h ^= h >> 29
    return (h * 0xC4CEB9FE1A85EC53 & MASK) >> 32


def plain(text, k=winnow.K, w=winnow.W):
    if not text:
        return []
    if len(text) < k:
        k, w = len(text), 1
    elif len(text) < w + k - 1:
        w = 1
    hashes = [plain_hash(text[i : i + k]) for i in range(len(text) - k + 1)]
    found = set()
    for i in range(len(hashes) - w + 1):
        least = min(hashes[i : i + w])
        found.add(max(j for j in range(i, i + w) if hashes[j] == least))
    return [(hashes[j], j) for j in sorted(found)]


def texts():
    rnd = random.Random(6)
    made = ["".join(rnd.choice("ab é𝄞") for _ in range(n)) for n in (1, 5, 15, 16, 17, 62, 63, 64, 200, 1000)]
    return [*made, "a" * 300, "ab" * 200, ""]


@pytest.mark.parametrize("chunk", [70, 1 << 17])
def test_against_plain_windows(monkeypatch, chunk):
    monkeypatch.setattr(winnow, "CHUNK", chunk)
    winnow._powers.cache_clear()
    for text in texts():
        hashes, positions = selected(text)
        assert list(zip(hashes.tolist(), positions.tolist(), strict=True)) == plain(text), text[:30]
    winnow._powers.cache_clear()


def test_shared_passages_are_found():
    rnd = random.Random(8)
    for _ in range(30):
        shared = "".join(rnd.choice("abcdef ") for _ in range(winnow.W + winnow.K - 1))
        a, b = ("".join(rnd.choice("uvwxyz ") for _ in range(rnd.randrange(90))) + shared + "".join(rnd.choice("uvwxyz ") for _ in range(rnd.randrange(90))) for _ in range(2))
        assert set(selected(a)[0].tolist()) & set(selected(b)[0].tolist())


def test_likeness_of_extremes():
    one, none = selected("some text of a length")[0], selected("")[0]
    assert likeness(one, one) == 1 and likeness(none, none) == 1 and likeness(one, none) == 0


@pytest.mark.parametrize("n", [0, 1, 2, 40])
def test_next_rows_against_sorting(spark, n):
    rnd = random.Random(n)
    pool = ["".join(rnd.choice("abc d") for _ in range(rnd.randrange(300))) for _ in range(20)] + [None, "", "é"]
    data = [(rnd.choice([None, *range(-3, 30)]) if n > 2 else i, rnd.choice(pool), "x", 1, True) for i in range(n)]
    if n > 2:
        data += data[:3] + [(50, "long " * 40_000, "x", 1, True)]
    got = sorted(tuple(r) for r in winnow.compare_with_edits(spark.createDataFrame(data, ROWS)).select("n_chars", "edited_sha256", "fingerprint", "edited_fingerprint", "near_edited", "near_next").collect())
    order = sorted(((-(1 << 63) if d is None else d, t or "") for d, t, *_ in data), key=lambda r: (r[0], r[1].encode()))
    want = []
    for i, (_, text) in enumerate(order):
        following = order[(i + 1) % len(order)][1]
        new = edited(text, following)
        a, b, c = (selected(t)[0] for t in (text, new, following))
        want.append((len(text), hashlib.sha256(new.encode()).hexdigest(), render(a), render(b), likeness(a, b), likeness(a, c)))
    assert got == sorted(want)
