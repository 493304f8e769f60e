"""Media columns: lossless images, interleaving with aligned captions, and the query against plain recomputation."""

import hashlib
import random
import struct
import zlib

import numpy as np
import pytest

from plumbline.llm import media

ROWS = "doc_id long, text string, id string, digest string, feature string"


@pytest.mark.parametrize("size", [0, 1, 575, 576, 577, 5760, 100_001])
def test_images_are_lossless(size):
    payload = media.to_payload(random.Random(size).randbytes(size))
    assert len(payload) % 576 == 0 and len(payload) > 0 and payload[size:] == b"\xff" * (len(payload) - size)
    stored = media.store_image(payload)
    assert media.load_image(stored) == payload
    assert struct.unpack(">II", stored[16:24]) == (576, len(payload) // 576)
    broken = bytearray(stored)
    broken[-20] ^= 1
    with pytest.raises((ValueError, zlib.error)):
        media.load_image(bytes(broken))


def test_interleaving_keeps_order_and_captions():
    html = "<h1>One</h1><p>before <img src='media:aa' alt='alt a'> after</p><figure><img src='media:bb'><img src='media:cc' alt='no'><figcaption>For <b>both</b></figcaption></figure><script>x</script><p>end &amp; <br>done<figure><figcaption>lonely</figcaption></figure>"
    got = [(s["position"], s["kind"], s["text"] or s["digest"], s["caption"]) for s in media.interleave(html)]
    assert got == [(0, "text", "One", None), (1, "text", "before", None), (2, "media", "aa", "alt a"), (3, "text", "after", None), (4, "media", "bb", "For both"), (5, "media", "cc", "For both"), (6, "text", "end & done", None), (7, "text", "lonely", None)]
    assert media.interleave("") == []


def test_digest_join_keeps_positions(spark):
    docs = spark.createDataFrame([(1, "<p>a</p><img src='media:d1'><img src='media:gone'>"), (2, "<img src='media:d1' alt='c'>"), (3, None)], "doc_id long, html string")
    store = spark.createDataFrame([("d1", 7)], "digest string, size long")
    got = media.resolve(media.sequences(docs), store).collect()
    assert sorted((r.id, r.position, r.kind, r.digest or "", r.caption or "", r["size"] or 0) for r in got) == [(1, 0, "text", "", "", 0), (1, 1, "media", "d1", "", 7), (1, 2, "media", "gone", "", 0), (2, 0, "media", "d1", "c", 7)]


def test_query_against_recomputation(spark):
    texts = ["", None, "a", "one\n\n <b>two</b> & \nthree\nfour", "é" * 288, "x" * 576, "y" * 577, "same", "same", "long text " * 30_000]
    data = [(i, t, "x", "y", "z") for i, t in enumerate(texts)] + [(None, "same", "x", "y", "z"), (7, "same", "x", "y", "z")]
    got = sorted((tuple(r) for r in media.media_features(spark.createDataFrame(data, ROWS)).collect()), key=str)
    want = []
    lines = lambda t: [x for x in (t or "").split("\n") if x.strip()]
    for i, t, *_ in data:
        raw = (t or "").encode()
        payload = raw + b"\xff" * (-len(raw) % 576 or (0 if raw else 576))
        stored = media.store_image(payload)
        want.append((i, len(raw), len(payload), hashlib.sha256(payload).hexdigest(), zlib.crc32(payload[-32:]), len(stored), hashlib.sha256(stored).hexdigest(), media.feature(np.frombuffer(payload, np.uint8)), len(lines(t)) // 2, len(lines(t)) + 1, f"text of {len(raw)} bytes"))
    assert got == sorted(want, key=str)
    assert media.media_features(spark.createDataFrame([], ROWS)).count() == 0


def test_clashing_columns_are_refused(spark):
    held = spark.createDataFrame([(1, [(0, "media", None, "d", None)])], f"id long, segments {media.SEGMENTS}")
    store = spark.createDataFrame([("d", 5)], "digest string, size long")
    assert [tuple(r) for r in media.resolve(held, store).select("id", "position", "digest", "size").collect()] == [(1, 0, "d", 5)]
    for seen, kept in ((held.withColumnRenamed("id", "caption"), store), (held, store.withColumnRenamed("size", "text")), (held, store.withColumnRenamed("size", "ID"))):
        with pytest.raises(ValueError, match="columns of one name"):
            media.resolve(seen, kept)
    assert media.resolve(held.limit(0), store).collect() == []
