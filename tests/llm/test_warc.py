"""Archives: exact round trips, revisits, and the merge against sorting."""

import base64
import hashlib
import random

import pytest

from plumbline.llm import warc

ROWS = "page_id long, url string, html string, digest string"


def pages():
    odd = "<p>é€ WARC/1.1\r\n\r\nContent-Length: 3\r\n\r\nabc</p>\r\n\r\n"
    data = [(i, f"http://h{i % 3}.example.com/p{i % 4}", f"<p>{i % 7}</p>" * (i % 7)) for i in range(60)]
    data += [(100, "https://www.x.org/a?b#c", odd), (99, "http://a b\r\nX: y/", odd), (101, None, None), (102, "http://e.com:8080/", ""), (None, "http://n.com/", odd), (None, "http://n.com/", "alone"), (None, "http://n.com/", "alone"), (5, "http://twice.com", "twice"), (5, "http://twice.com", "twice"), (103, "u" * 3000, "long " * 100_000)]
    return [(*r, "x") for r in data]


def brute(data):
    keeper = {}
    for i, _, html, _ in data:
        if i is not None:
            keeper[html or ""] = min(i, keeper.get(html or "", i))
    out = []
    for i, _, html, _ in data:
        raw = (html or "").encode()
        first = keeper.get(html or "")
        out.append((i, len(raw), base64.b32encode(hashlib.sha1(raw).digest()).decode(), "response" if first in (i, None) else "revisit", None if first in (i, None) else first))
    return sorted(out, key=str)


@pytest.mark.parametrize("parts", [1, 5])
def test_round_trip_and_global_order(spark, parts):
    data = pages()
    df = spark.createDataFrame(data, ROWS).repartition(4)
    path = warc.scratch_path(spark, "test")
    warc.write_archives(df, path, per_archive=11)
    index = warc.merge_runs(warc.read_archives(spark, path), parts).collect()
    assert sorted(((r.page_id, r.payload_bytes, r.payload_digest, r.record_type, r.refers_to) for r in index), key=str) == brute(data)
    ordered = sorted(index, key=lambda r: (r["range"], r.place))
    keys = [warc._order(tuple(r)) for r in ordered]
    assert keys == sorted(keys)
    archives = {r.archive for r in index}
    assert len(archives) > 5
    files = {r.path.rsplit("/", 1)[-1]: bytes(r.content) for r in spark.read.format("binaryFile").load(path).collect()}
    for r in index:  # offset and length give the record by itself
        (headers, block, offset, length), = warc.parse_archive(files[r.archive][r.offset : r.offset + r.length])
        assert headers["WARC-Type"] == r.record_type and (offset, length) == (0, r.length)


def test_long_records_have_archives_of_their_own(spark, monkeypatch):
    monkeypatch.setattr(warc, "SIZES", ((-1, 10, 50), (10, 100, 3), (100, 1 << 62, 1)))
    path = warc.scratch_path(spark, "test")
    warc.write_archives(spark.createDataFrame(pages(), ROWS).coalesce(1), path)
    held = {}
    for r in warc.read_archives(spark, path).collect():
        held.setdefault(r.archive, []).append(r.payload_bytes)
    assert all(len(n) <= (1 if max(n) > 100 else 3 if max(n) > 10 else 50) for n in held.values())
    assert sum(map(len, held.values())) == len(pages())


def test_the_operator_and_empty_tables(spark):
    df = spark.createDataFrame(pages(), ROWS)
    got = warc.archive_and_index(df).collect()
    assert sorted(((r.page_id, r.payload_bytes, r.payload_digest, r.record_type, r.refers_to) for r in got), key=str) == brute(pages())
    assert warc.archive_and_index(df.limit(0)).count() == 0


@pytest.mark.parametrize("runs", [0, 1, 2, 3, 8, 13])
def test_loser_tree_is_a_stable_merge(runs):
    rnd = random.Random(runs)
    held = [sorted((rnd.randrange(20), i) for _ in range(rnd.randrange(9))) for i in range(runs)]
    assert list(warc.LoserTree(held, lambda r: r[0])) == sorted((x for r in held for x in r))


def test_url_keys():
    assert warc.url_key("http://WWW.Example.com:80/a?b#c") == "com,example)/a?b"
    assert warc.url_key("https://m.x.org:8080") == "org,x,m:8080)/"
    assert warc.url_key(None) == ")/" and warc.url_key("http://[bad") == "http://[bad"


def test_damage_is_noticed():
    record = b"WARC/1.1\r\nWARC-Type: response\r\nWARC-Date: d\r\nWARC-Payload-Digest: sha1:X\r\nContent-Length: 25\r\n\r\nHTTP/1.1 200 OK\r\nA: b\r\n\r\nx"
    with pytest.raises(ValueError):
        list(warc.parse_archive(record))
