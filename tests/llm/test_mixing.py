"""Mixing against plain recomputation: targets by repeated resharing, exact quotas, taken words near targets."""

import random
import re
from collections import Counter

from plumbline.llm import mixing

SCHEMA = "doc_id long, text string, source string, size string, mark int"


def fill(sizes, weights=(5, 2, 1), cap=3.0):
    """Targets by resharing until none is above its cap; sources by code point, null last."""
    names = sorted(sizes, key=lambda s: (s is None, (s or "").encode("utf-8")))
    weight = {s: weights[i % len(weights)] for i, s in enumerate(names)}
    total, capped = float(sum(sizes.values())), set()
    while True:
        free = [s for s in names if s not in capped]
        left = total - sum(cap * sizes[s] for s in capped)
        level = left / sum(weight[s] for s in free) if free else 0
        over = {s for s in free if weight[s] * level >= cap * sizes[s]}
        if not over:
            return {s: cap * sizes[s] if s in capped else weight[s] * level for s in names}
        capped |= over


def rows(n=400, seed=1):
    rnd = random.Random(seed)
    sources = ["a", "b", "B", "é", "zz", None, "𐀀", "￿"]
    return [(i, "\t ".join("w" * rnd.randint(1, 4) for _ in range(rnd.choice([0, 1, 3, 20, 60]))) or None, "b" if i % 3 == 0 else rnd.choice(sources), "clash", 3) for i in range(n)]


def collect(spark, data, **options):
    mixed = mixing.mix(spark.createDataFrame(data, SCHEMA), **options)
    return [(r.doc.doc_id, r.doc.source, r["size"], r.source_size, r.target, [tuple(d) for d in r.draws]) for r in mixed.collect()]


def check(got, data, slack):
    count = lambda t: len(re.findall(r"[^\x20\x09-\x0D]+", t or ""))
    sizes = Counter()
    for _, text, source, *_ in data:
        sizes[source] += count(text)
    want, taken = fill(sizes), Counter()
    assert Counter((d, s, n) for d, s, n, *_ in got) == Counter((d, s, count(t)) for d, t, s, *_ in data)
    for _, source, size, source_size, target, draws in got:
        assert source_size == sizes[source] and abs(target - want[source]) < 1e-6 * max(1, target)
        assert len(draws) <= 3
        taken[source] += size * len(draws)
    for source, n in taken.items():
        assert abs(n - want[source]) <= slack, (source, n, want[source])


def test_against_resharing(spark):
    data = rows()
    got = collect(spark, data, block_rows=40, shards=5)
    check(got, data, slack=10)
    again = collect(spark, data[::-1], block_rows=40, shards=5)
    assert sorted(map(str, got)) == sorted(map(str, again))


def test_repeated_rows_null_ids_and_a_capped_source(spark):
    data = [(1, "one two", "s", "x", 1)] * 5 + [(None, "a b c", None, "x", 1), (None, None, "t", "x", 1)] + [(i, "w " * 50, "big", "x", 1) for i in range(10, 40)]
    check(collect(spark, data, shards=3), data, slack=50)


def test_few_rows_come_near_their_target(spark):
    rnd = random.Random(8)
    data = [(i, "w " * rnd.choice([3, 7, 40, 90, 300]), f"s{i % 3}", "x", 1) for i in range(45)]
    got = collect(spark, data, shards=3)
    check(got, data, slack=8)
    assert all(sum(n * len(d) for _, s, n, _, _, d in got if s == source) <= t + 1e-6 for _, source, _, _, t, _ in got)
    assert all(0 <= shard < 3 for *_, d in got for shard, *_ in d)


def test_sources_of_few_rows_are_filled_exactly(spark):
    """No choice of up to three draws a row comes nearer to the target from below; repeated rows are drawn together."""
    rnd = random.Random(21)
    data = [(100 * k + i, "w " * rnd.choice([0, 144, rnd.randint(100, 900)]), f"s{k}", "x", 1) for k in range(9) for i in range(rnd.choice([1, 3, 7, 12]))]
    data += [(100, "w " * 50, "s1", "x", 1)] * 2 + [(10_000 + i, "w " * rnd.randint(1, 300), "t", "x", 1) for i in range(60)]
    got = collect(spark, data, shards=3)
    targets = {r[1]: r[4] for r in got}
    for source in {f"s{k}" for k in range(9)}:
        groups, sums = Counter(), {0}
        for i, s, n, *_ in got:
            if s == source:
                groups[i, n] += n
        for n in groups.values():
            sums = {x + k * n for x in sums for k in range(4) if x + k * n <= targets[source] + 1e-6}
        assert sum(n * len(d) for _, s, n, _, _, d in got if s == source) == max(sums)
        assert all(len(d) <= 3 for _, s, *_, d in got if s == source)


def test_quotas_are_dealt_out_exactly(spark):
    draws = spark.createDataFrame([(0, 90), (1, 0), (2, 7), (3, 31)], "rank int, draws long")
    dealt = mixing.split_quotas(draws, 7, seed=4).collect()
    by_rank, by_shard = Counter(), Counter()
    for r in dealt:
        by_rank[r["rank"]] += r.quota
        by_shard[r.shard] += r.quota
    assert dict(by_rank) == {0: 90, 1: 0, 2: 7, 3: 31}
    assert set(by_shard) == set(range(7)) and max(by_shard.values()) - min(by_shard.values()) <= 3


def test_shards_draw_disjoint_blocks_and_the_mix_has_each_draw(spark):
    data = rows(200)
    mixed = mixing.mix(spark.createDataFrame(data, SCHEMA), block_rows=10, shards=4)
    draws = [(r.doc.doc_id, d["pass"], d.shard) for r in mixed.collect() for d in r.draws]
    assert len({(i, p) for i, p, _ in draws}) == len(draws) and {s for *_, s in draws} == set(range(4))
    out = mixing.rows_of_mix(mixed, 4)
    assert out.columns == ["doc_id", "text", "source", "size", "mark"]
    assert Counter(r.doc_id for r in out.collect()) == Counter(i for i, *_ in draws)


def test_empty_table_and_empty_texts(spark):
    assert collect(spark, []) == []
    got = collect(spark, [(1, None, "s", "x", 1), (2, "", "s", "x", 1)])
    assert [(n, t) for _, _, n, _, t, _ in got] == [(0, 0.0), (0, 0.0)]


def test_word_count_is_native(spark):
    df = spark.createDataFrame([("a\x0bb\x0c\x1cc  d ",), (None,), ("",)], "text string")
    assert [r.n for r in df.select(mixing.word_count("text").alias("n")).collect()] == [4, 0, 0]
