"""Every registered query of the audit engine against its SQL, on the smallest tables."""

from __future__ import annotations

import os
import random

import duckdb
import pytest

from plumbline.plans import registry

TABLES = "/root/testdata/sf0.001"

pytestmark = pytest.mark.skipif(not os.path.isdir(TABLES), reason="the test tables aren't here")


@pytest.fixture(scope="module")
def sql():
    con = duckdb.connect()
    for file in os.listdir(TABLES):
        con.execute(f"create view {file.removesuffix('.parquet')} as select * from '{TABLES}/{file}'")
    return con


def plain(value):
    return repr(round(value, 6) + 0.0) if isinstance(value, float) else str(value)


def rows(columns, records):
    order = sorted(range(len(columns)), key=columns.__getitem__)
    return sorted(tuple(plain(r[i]) for i in order) for r in records)


@pytest.mark.parametrize("name", sorted(registry.ORACLE_SQL))
def test_query_agrees_with_sql(spark, sql, name):
    ours = registry.QUERIES[name](spark, TABLES)
    theirs = sql.execute(registry.ORACLE_SQL[name])
    columns = [d[0] for d in theirs.description]
    assert sorted(ours.columns) == sorted(columns)
    assert rows(ours.columns, ours.collect()) == rows(columns, theirs.fetchall())


def plain_deal(spark):
    """The greedy deal over plain lists: every penalty from its definition."""
    orders = sorted((r.o_orderkey, r.o_custkey) for r in spark.read.parquet(f"{TABLES}/orders.parquet").collect())
    home, groups = dict(orders), {}
    for _, customer in orders:
        groups.setdefault(customer, {"size": 0, "counts": dict.fromkeys("ANRZ", 0)})["size"] += 1
    totals = dict.fromkeys("ANRZ", 0)
    for r in spark.read.parquet(f"{TABLES}/lineitem.parquet").select("l_orderkey", "l_returnflag").collect():
        if r[0] in home:
            groups[home[r[0]]]["counts"][r[1]] += 1
            totals[r[1]] += 1
    keys = sorted(groups)
    random.Random(42).shuffle(keys)
    rare = {k: max(n / max(totals[c], 1) for c, n in groups[k]["counts"].items()) for k in keys}
    keys.sort(key=lambda k: (-rare[k], -groups[k]["size"]))
    shares = {"train": 0.7, "val": 0.15, "test": 0.15}
    sizes, counts, found = dict.fromkeys(shares, 0), {s: dict.fromkeys("ANRZ", 0) for s in shares}, {}
    for k in keys:
        def penalty(s):
            goal = len(orders) * shares[s]
            after = sizes[s] + groups[k]["size"]
            spread = [((counts[s][c] + groups[k]["counts"][c] - totals[c] * shares[s]) / max(totals[c] * shares[s], 1)) ** 2 for c in "ANRZ"]
            return ((after - goal) / max(goal, 1)) ** 2 + sum(spread) / 4 + 2.0 * max(0, after - goal) / max(goal, 1), sizes[s]

        s = found[k] = min(shares, key=penalty)
        sizes[s] += groups[k]["size"]
        for c, n in groups[k]["counts"].items():
            counts[s][c] += n
    return found


def test_greedy_split_is_the_plain_deal(spark):
    dealt = registry.QUERIES["greedy_split"](spark, TABLES).collect()
    assert {r.component_id: r.split for r in dealt} == plain_deal(spark)


def test_audit_sample_is_the_shuffled_pool(spark):
    """Without errors: the harder half, then the first of the others, in their order, as the seed shuffles them."""
    rows_ = sorted(registry.event_rows(spark, TABLES).collect(), key=lambda r: r.image)
    hard = sorted(rows_, key=lambda r: (r.min_conf, r.image))[:6]
    pool = [r.image for r in rows_ if r not in hard]
    random.Random(42).shuffle(pool)
    got = registry.QUERIES["audit_sample_zero_error"](spark, TABLES).orderBy("pick").collect()
    assert [r.image for r in got] == [r.image for r in hard] + pool[:6]


def test_manifest_keeps_groups_whole_and_drops_copies(spark):
    rows_ = registry.QUERIES["manifest"](spark, TABLES).collect()
    assert len({r.sha256 for r in rows_}) == len(rows_)
    assert len({r.output_image for r in rows_}) == len(rows_)
    homes = {}
    for r in rows_:
        homes.setdefault(r.group_id, set()).add(r.output_split)
    assert all(len(s) == 1 for s in homes.values())
