"""SimHash near-duplicates, with candidates from pigeonring filtering.

A text's fingerprint has one bit for each of 64 positions: set where more than half of its word shingles have
that bit set in their XXH64. Two fingerprints are linked if at most ``max_diff`` bits differ.

Pigeonring filtering cuts a fingerprint into ``segments`` pieces laid out on a ring. If the total difference is
at most t, some piece starts a chain whose first l pieces differ in at most l*t/segments bits, for every l. For the
longest l whose budget is below one bit that means equality, so those pieces together are an equi-join key;
the longer chains are then checked one after the other before the whole Hamming distance is.
"""

from __future__ import annotations

from collections.abc import Iterable, Iterator
from functools import partial
from itertools import islice

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from plumbline.llm._common import batched, materialize, release, rows, text_bytes
from plumbline.operators.components import connected_components
from plumbline.operators.skew import join_one

BITS = 64
CHUNK = 1 << 20  # bytes of text whose words are held at a time
_H64 = partial(xxhash.xxh64_intdigest, seed=42)
_SPACE = b" \t\n\r\x0b\x0c"


def _word_chunks(data: bytes, size: int = CHUNK) -> Iterator[list[bytes]]:
    """The words of ``data``, cut only at white space, some ``size`` bytes at a time."""
    at = 0
    while at < len(data):
        end = at + size
        while end < len(data) and data[end] not in _SPACE:
            end += 1
        yield data[at:end].split()
        at = end


def shingle_hashes(data: bytes, words: int, hasher=_H64) -> Iterator[np.ndarray]:
    """Hashes of the word shingles, repeats included, in arrays of bounded size.

    A-Z are lower-cased; words are separated by the six ASCII white-space bytes. A text with fewer than ``words``
    words has one shingle, the whole sequence; one without words has none.
    """
    tail: list[bytes] = []
    any_full = False
    for chunk in _word_chunks(data.lower()):
        held = tail + chunk
        n = len(held) - words + 1
        if n > 0:
            any_full = True
            grams = map(b" ".join, zip(*(islice(held, i, None) for i in range(words)), strict=False))
            yield np.fromiter(map(hasher, grams), np.uint64, n)
            tail = held[n:]
        else:
            tail = held
    if not any_full and tail:
        yield np.array([hasher(b" ".join(tail))], np.uint64)


def fingerprint(data: bytes, words: int = 3) -> int:
    """The 64-bit SimHash of a text's bytes as a signed integer; zero where there is no word."""
    return of_hashes(shingle_hashes(data, words))


def of_hashes(parts: Iterable[np.ndarray]) -> int:
    """The SimHash of unsigned 64-bit hashes."""
    ones = np.zeros(BITS, np.int64)
    n = 0
    for hashes in parts:
        n += len(hashes)
        for i in range(0, len(hashes), 4096):
            bits = np.unpackbits(hashes[i : i + 4096].view(np.uint8).reshape(-1, 8), axis=1, bitorder="little")
            ones += bits.sum(axis=0, dtype=np.uint16)
    return int(np.packbits(2 * ones > n, bitorder="little").view(np.int64)[0])


def fingerprints(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", words: int = 3) -> DataFrame:
    """(id, fp): a signed 64-bit fingerprint for every row, null and empty texts included (zero). Null ids and repeated rows each keep their row; an empty
    table gives an empty result; other columns are not looked at; a text of any length is hashed piece by piece."""
    schema = pa.schema([("id", pa.int64()), ("fp", pa.int64())])

    def run(batches):
        return batched(schema, ((i, fingerprint(b, words)) for i, b in rows(batches, "id", "data")))

    return docs.select(F.col(id_col).cast("long").alias("id"), text_bytes(text_col).alias("data")).mapInArrow(run, "id long, fp long")


def _turned(fp: str, start: int, width: int) -> Column:
    k = start * width
    return F.col(fp) if k == 0 else F.expr(f"shiftleft({fp}, {k}) | shiftrightunsigned({fp}, {BITS - k})")


def ring_keys(fps: DataFrame, max_diff: int, segments: int) -> DataFrame:
    """(start, key, fp): for each ring start, the leading segments whose joint budget is below one bit."""
    width = BITS // segments
    lead = -(-segments // max_diff) - 1 if max_diff else segments
    if lead < 1 or width * segments != BITS:
        raise ValueError("segments must divide 64 and exceed the number of differing bits")
    keys = [F.struct(F.lit(i).alias("start"), (_turned("fp", i, width) if lead * width == BITS else F.shiftrightunsigned(_turned("fp", i, width), BITS - lead * width)).alias("key")) for i in range(segments)]
    return fps.select("fp", F.explode(F.array(*keys)).alias("k")).select("k.start", "k.key", "fp")


def chain_holds(a: str, b: str, max_diff: int, segments: int) -> Column:
    """Whether, from segment ``start`` on, every chain of l segments keeps within l*max_diff/segments bits."""
    width = BITS // segments
    diff = f"({a} ^ {b})"
    ring = f"(case when start = 0 then {diff} else shiftleft({diff}, start * {width}) | shiftrightunsigned({diff}, {BITS} - start * {width}) end)"
    checks = [f"bit_count(shiftrightunsigned({ring}, {BITS - n * width})) <= {n * max_diff // segments}" for n in range(1, segments)]
    return F.expr(" and ".join([*checks, f"bit_count({diff}) <= {max_diff}"]))


def links(fps: DataFrame, max_diff: int = 2, segments: int = 8, most: int = 64) -> DataFrame:
    """Edges (a, b) between distinct fingerprints whose components are those of all pairs within ``max_diff`` bits.

    ``fps`` has one distinct fingerprint a row. Keys that at most ``most`` fingerprints share are joined pairwise and
    filtered by chains. The members of fuller keys are linked exactly but without pairs: each is written once
    for every value within ``max_diff / 2`` bits of it; two within reach share such a value, all that share one
    are within reach, and each hangs on the smallest of them. That is 65 rows a fingerprint at most.
    """
    if max_diff not in (0, 2):
        raise ValueError("balls are enumerated for max_diff 0 or 2")
    keys = materialize(ring_keys(fps, max_diff, segments), "ring-keys")
    load = keys.groupBy("start", "key").agg(F.count("*").alias("n")).where("n > 1")
    shared = materialize(keys.join(load, ["start", "key"]), "shared-keys")
    few = shared.where(F.col("n") <= most).select("start", "key", "fp")
    other = few.select(F.col("start").alias("s2"), F.col("key").alias("k2"), F.col("fp").alias("b"))
    near = few.join(other, (F.col("start") == F.col("s2")) & (F.col("key") == F.col("k2")) & (F.col("fp") < F.col("b"))).withColumnRenamed("fp", "a").where(chain_holds("a", "b", max_diff, segments)).select("a", "b")
    crowd = shared.where(F.col("n") > most).select("fp").distinct()
    ball = F.array(F.col("fp"), *(F.expr(f"fp ^ shiftleft(1L, {i})") for i in range(BITS if max_diff else 0)))
    spots = crowd.select("fp", F.explode(ball).alias("spot"))
    hubs = spots.groupBy("spot").agg(F.min("fp").alias("hub"), F.count("*").alias("n")).where("n > 1").select("spot", "hub")
    star = spots.join(hubs, "spot").where("fp <> hub").select(F.col("hub").alias("a"), F.col("fp").alias("b"))
    return near.unionByName(star)


def near_duplicates(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", words: int = 3, max_diff: int = 2, segments: int = 8, most: int = 64) -> DataFrame:
    """(id, fingerprint, component_id) for every row of ``docs``.

    Rows of equal fingerprint are one node with its smallest id, so copies never make pairs, and those of a fingerprint that very many share aren't shuffled. ``component_id`` is the
    smallest id reachable over links. Null and empty texts have fingerprint zero and link like any other; null
    ids stay in the result and never name a component unless all of its ids are null; repeated rows
    are kept; an empty table gives an empty result; other columns of ``docs`` are not looked at.
    """
    each = materialize(fingerprints(docs, id_col, text_col, words), "fingerprints")
    nodes = materialize(each.groupBy("fp").agg(F.min("id").alias("least"), F.count("*").alias("n")), "nodes")
    roots = materialize(connected_components(links(nodes.select("fp"), max_diff, segments, most)), "roots")
    members = roots.unionByName(roots.select(F.col("root").alias("node"), "root").distinct()).join(nodes, F.col("node") == F.col("fp"))
    smallest = members.groupBy("root").agg(F.min("least").alias("component"))
    moved = members.select("node", "root").join(smallest, "root").select(F.col("node").alias("fp"), "component")
    named = materialize(nodes.join(moved, "fp", "left").select("fp", "n", F.coalesce("component", "least").alias("component_id")), "named")
    release(nodes, roots)
    return join_one(each, named, "fp", "n").select("id", F.lpad(F.lower(F.hex("fp")), 16, "0").alias("fingerprint"), "component_id")
