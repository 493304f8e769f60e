"""SimHash linking against all pairs, and the defined results of odd inputs."""

import random

import pytest
import xxhash

from plumbline.llm import simhash

SCHEMA = "doc_id long, text string, id string, fp string, n long"


def brute_fp(text, words=3):
    held = (text or "").encode().lower().split()
    grams = [b" ".join(held[i : i + words]) for i in range(max(1, len(held) - words + 1))] if held else []
    hashes = [xxhash.xxh64_intdigest(g, 42) for g in grams]
    return sum(1 << b for b in range(64) if 2 * sum(h >> b & 1 for h in hashes) > len(hashes))


def brute(rows, fps=None, max_diff=2):
    fps = fps or [brute_fp(t) for _, t in rows]
    root = list(range(len(rows)))

    def find(i):
        while root[i] != i:
            i = root[i]
        return i

    for i in range(len(rows)):
        for j in range(i):
            if bin(fps[i] ^ fps[j]).count("1") <= max_diff:
                root[find(i)] = find(j)
    least = {}
    for i, (d, _) in enumerate(rows):
        if d is not None:
            least[find(i)] = min(d, least.get(find(i), d))
    return sorted(((d, f"{fps[i]:016x}", least.get(find(i))) for i, (d, _) in enumerate(rows)), key=str)


def run(spark, rows, **options):
    df = spark.createDataFrame([(d, t, "x", "y", 1) for d, t in rows], SCHEMA)
    return sorted((tuple(r) for r in simhash.near_duplicates(df, **options).collect()), key=str)


def texts():
    rnd = random.Random(3)
    base = [" ".join(rnd.choice("Alpha beta gamma Delta eps zeta eta Theta iota Éa".split()) for _ in range(rnd.randint(1, 60))) for _ in range(12)]
    rows = [(i, t) for i, t in enumerate(base)]
    for i, t in enumerate(base):
        held = t.split()
        held[rnd.randrange(len(held))] = "changed"
        rows.append((100 + i, " ".join(held)))
    rows += [(50, base[3].upper()), (51, base[3].replace(" ", "\t\n ")), (60, None), (61, ""), (62, " \x0b\x0c "), (63, "one"), (64, "ONE  "), (65, "one two"), (7, base[7]), (None, base[2]), (None, "all alone here in this place")]
    return rows


def test_against_all_pairs(spark):
    assert run(spark, texts()) == brute(texts())


@pytest.mark.parametrize("most", [0, 1, 64])
@pytest.mark.parametrize("segments", [4, 8, 16])
def test_links_lose_nothing(spark, most, segments):
    rnd = random.Random(segments)
    fps = {rnd.getrandbits(64) for _ in range(30)}
    for f in list(fps):
        for _ in range(4):
            g = f
            for _ in range(rnd.randint(1, 3)):
                g ^= 1 << rnd.randrange(64)
            fps.add(g)
    fps = sorted(fps)
    signed = [f - (1 << 64) if f >> 63 else f for f in fps]
    edges = simhash.links(spark.createDataFrame([(f,) for f in signed], "fp long"), segments=segments, most=most).collect()
    assert all(bin((a ^ b) & (1 << 64) - 1).count("1") <= 2 for a, b in edges)
    root = {f: f for f in signed}

    def find(i):
        while root[i] != i:
            i = root[i]
        return i

    for a, b in edges:
        root[find(a)] = find(b)
    for i, f in enumerate(fps):
        for j in range(i):
            if bin(f ^ fps[j]).count("1") <= 2:
                assert find(signed[i]) == find(signed[j])


def test_long_text_is_cut_only_at_white_space(monkeypatch):
    text = " ".join(f"w{i % 97}x{i}" for i in range(5000)).encode()
    whole = simhash.fingerprint(text)
    monkeypatch.setattr(simhash, "_word_chunks", lambda data, size=100, f=simhash._word_chunks: f(data, size))
    assert simhash.fingerprint(text) == whole == (lambda f: f - (1 << 64) if f >> 63 else f)(brute_fp(text.decode()))


def test_empty_table(spark):
    assert run(spark, []) == []
