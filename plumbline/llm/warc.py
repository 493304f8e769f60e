"""WARC archives: writing records, reading them back, and merging the captures' sorted runs into one index.

Archives are written by Spark's own writer, records being lines that end in two CRLFs, so a lost task leaves nothing behind. Each is read
back as a whole, cut by Content-Length, and its captures sorted by URL key and time: a run. Runs are dealt to ranges of the key and merged in
each range by a loser tree, which gives the histories of all URLs in one order over the ranges.
"""

from __future__ import annotations

import base64
import hashlib
from collections.abc import Iterable, Iterator
from datetime import UTC, datetime
from urllib.parse import urlsplit

import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from plumbline.llm._common import batched, materialize, rows, scratch_path
from plumbline.operators.skew import join_one

CRLF = "\r\n"
SIZES = ((-1, 128 << 10, 2000), (128 << 10, 4 << 20, 64), (4 << 20, 1 << 62, 1))  # payloads above, up to so many bytes: records an archive, so some 256 MB or one longer record
RANGE_ROWS = 500_000  # captures that a range of the index has, about: some 150 MB of Arrow columns in a task
BEGIN = int(datetime(2024, 1, 1, tzinfo=UTC).timestamp())
_DIGITS, _BASE32 = "0123456789ABCDEFGHIJKLMNOPQRSTUV", "ABCDEFGHIJKLMNOPQRSTUVWXYZ234567"
INDEX = "urlkey string, captured string, page_id long, url string, record_type string, payload_bytes long, payload_digest string, refers_to long, archive string, offset long, length long"


def base32_sha1(data: Column) -> Column:
    """The upper-case base32 form of the SHA-1 of a binary column; 15 hex digits are 12 of base 32."""
    digest = F.sha1(data)
    part = lambda at, n: F.lpad(F.conv(F.substring(digest, at, n), 16, 32), n * 4 // 5, "0")
    return F.translate(F.concat(part(1, 15), part(16, 15), part(31, 10)), _DIGITS, _BASE32)


def with_revisits(pages: DataFrame, id_col: str, url_col: str, html_col: str, least: int = 0) -> DataFrame:
    """(page_id, url, payload, n, digest, refers_to): each payload of ``least`` bytes or more is kept by its smallest id; others refer to that.

    Only digests are shuffled to find the copies, and those of a payload that very many share not even so. The table of copies is written, so its size is known: it is broadcast where it is small, else
    joined by id. A null id never keeps a payload unless all of its copies' ids are null; then all are responses.
    """
    payload = F.coalesce(F.col(html_col), F.lit("")).cast("binary")
    held = pages.select(F.col(id_col).cast("long").alias("page_id"), F.col(url_col).alias("url"), payload.alias("payload"))
    held = held.withColumn("n", F.octet_length("payload").cast("long")).withColumn("digest", base32_sha1(F.col("payload")))
    seen = held.where(F.col("n") >= least).select("page_id", "digest")
    keepers = seen.groupBy("digest").agg(F.min("page_id").alias("keeper"), F.count("*").alias("copies")).where("copies > 1 and keeper is not null")
    copies = join_one(seen, materialize(keepers, "keepers"), "digest", "copies").where("page_id is null or page_id <> keeper").select(F.col("page_id").alias("copy"), F.col("digest").alias("copied"), "keeper").distinct()
    copies = materialize(copies, "revisits")
    return held.join(copies, F.col("page_id").eqNullSafe(F.col("copy")) & (F.col("digest") == F.col("copied")), "left").drop("copy", "copied").withColumnRenamed("keeper", "refers_to")


def record(kind: Column) -> Column:
    """A WARC/1.1 record without its last two CRLFs. Revisits keep the HTTP header, with the payload's length, and leave the payload out."""
    safe = F.regexp_replace(F.coalesce("url", F.lit("")), r"[\x00-\x20\x7f]", "")
    named = lambda c: F.concat(F.lit("<urn:x-page:"), c.cast("string"), F.lit(">"))
    line = lambda name, value: F.coalesce(F.concat(F.lit(name + ": "), value, F.lit(CRLF)), F.lit(""))
    moment = F.timestamp_seconds(F.lit(BEGIN) + F.pmod(F.coalesce("page_id", F.lit(0)), F.lit(10**9)))
    http = F.concat(F.lit(f"HTTP/1.1 200 OK{CRLF}Content-Type: text/html; charset=utf-8{CRLF}"), line("Content-Length", F.col("n").cast("string")), F.lit(CRLF))
    length = F.octet_length(http) + F.when(kind == "response", F.col("n")).otherwise(0)
    head = F.concat(
        F.lit(f"WARC/1.1{CRLF}"),
        line("WARC-Type", kind),
        line("WARC-Record-ID", named(F.col("page_id"))),
        line("WARC-Date", F.date_format(F.convert_timezone(F.current_timezone(), F.lit("UTC"), moment.cast("timestamp_ntz")), "yyyy-MM-dd'T'HH:mm:ss'Z'")),
        line("WARC-Target-URI", F.when(F.col("url").isNotNull(), safe)),
        line("WARC-Payload-Digest", F.concat(F.lit("sha1:"), F.col("digest"))),
        line("WARC-Refers-To", named(F.col("refers_to"))),
        F.when(kind == "revisit", F.lit(f"WARC-Profile: http://netpreserve.org/warc/1.1/revisit/identical-payload-digest{CRLF}")).otherwise(""),
        F.lit(f"Content-Type: application/http; msgtype=response{CRLF}"),
        line("Content-Length", length.cast("string")),
        F.lit(CRLF),
    )
    return F.concat(head, http, F.when(kind == "response", F.col("payload").cast("string")).otherwise(""))


def write_archives(pages: DataFrame, path: str, id_col: str = "page_id", url_col: str = "url", html_col: str = "html", least: int = 0, per_archive: int = 2000) -> None:
    """One record for every row, in archives of ``per_archive`` records at most, and fewer of longer payloads (``SIZES``)."""
    kind = F.when(F.col("refers_to").isNull(), F.lit("response")).otherwise(F.lit("revisit"))
    held = with_revisits(pages, id_col, url_col, html_col, least)
    for above, upto, most in SIZES:
        records = held.where((F.col("n") > above) & (F.col("n") <= upto)).select(record(kind).alias("value"))
        records.write.mode("append").option("lineSep", CRLF * 2).option("maxRecordsPerFile", min(most, per_archive)).option("compression", "none").text(path)


def url_key(url: str | None) -> str:
    """The sort-friendly form of a URL: host labels turned round, then path and query; no scheme, user, port 80/443 or fragment."""
    try:
        parts = urlsplit((url or "").strip())
        host, port = parts.hostname or "", parts.port
    except ValueError:
        return url or ""
    labels = host.removeprefix("www.").split(".")[::-1]
    tail = f":{port}" if port not in (None, 80, 443) else ""
    return ",".join(labels) + tail + ")" + (parts.path or "/") + (f"?{parts.query}" if parts.query else "")


def parse_archive(data: bytes) -> Iterator[tuple[dict[str, str], memoryview, int, int]]:
    """(headers, block, offset, length) of each record."""
    view, at = memoryview(data), 0
    while at < len(data):
        end = data.index(b"\r\n\r\n", at) + 4
        lines = data[at:end].decode("utf-8").split(CRLF)
        if not lines[0].startswith("WARC/"):
            raise ValueError(f"no record at {at}")
        headers = dict(line.split(": ", 1) for line in lines[1:] if line)
        size = int(headers["Content-Length"])
        yield headers, view[end : end + size], at, end + size + 4 - at
        if data[end + size : end + size + 4] != b"\r\n\r\n":
            raise ValueError(f"the record at {at} has no end")
        at = end + size + 4


def _page(urn: str | None) -> int | None:
    return int(urn.removeprefix("<urn:x-page:").removesuffix(">")) if urn else None


def captures_of(name: str, data: bytes) -> list[tuple]:
    """An archive's captures as a run: index rows sorted by URL key and time. Payloads are measured, not taken from the headers."""
    out = []
    for headers, block, offset, length in parse_archive(data):
        body = bytes(block)
        cut = body.index(b"\r\n\r\n") + 4
        http = dict(x.split(": ", 1) for x in body[:cut].decode().split(CRLF)[1:] if x)
        kind, digest = headers["WARC-Type"], headers["WARC-Payload-Digest"].removeprefix("sha1:")
        if kind == "response":
            found = base64.b32encode(hashlib.sha1(memoryview(body)[cut:]).digest()).decode()
            if found != digest or len(body) - cut != int(http["Content-Length"]):
                raise ValueError(f"{name}: the payload at {offset} isn't what was written")
            size = len(body) - cut
        else:
            size = int(http["Content-Length"])
        url = headers.get("WARC-Target-URI")
        out.append((url_key(url), headers["WARC-Date"], _page(headers.get("WARC-Record-ID")), url, kind, size, digest, _page(headers.get("WARC-Refers-To")), name, offset, length))
    return sorted(out, key=_order)


def _order(row: tuple) -> tuple:
    return row[0], row[1], row[2] is not None, row[2] or 0, row[8], row[9]


def read_archives(spark: SparkSession, path: str) -> DataFrame:
    """The index rows of all archives below a path; each archive's are a sorted run."""
    schema = pa.schema([("urlkey", pa.string()), ("captured", pa.string()), ("page_id", pa.int64()), ("url", pa.string()), ("record_type", pa.string()), ("payload_bytes", pa.int64()), ("payload_digest", pa.string()), ("refers_to", pa.int64()), ("archive", pa.string()), ("offset", pa.int64()), ("length", pa.int64())])

    def run(batches):
        return batched(schema, (c for name, data in rows(batches, "path", "content") for c in captures_of(name.rsplit("/", 1)[-1], data)))

    return spark.read.format("binaryFile").load(path).select("path", "content").mapInArrow(run, INDEX)


class LoserTree:
    """Merges sorted runs: an inner node keeps the loser of its match, so the next least row takes one match a level."""

    def __init__(self, runs: list[Iterable], key):
        self.runs, self.key, self.n = [iter(r) for r in runs], key, len(runs)
        self.heads = [self._next(i) for i in range(self.n)]
        self.losers = [-1] * self.n
        for i in range(self.n):
            self._play(i, building=True)

    def _next(self, i: int):
        row = next(self.runs[i], None)
        return (True,) if row is None else (False, self.key(row), i, row)

    def _play(self, i: int, building: bool = False) -> None:
        """Run i's new head goes up the tree against the losers on its way; the winner stays at the root."""
        node = (i + self.n) // 2
        while node:
            other = self.losers[node]
            if building and other < 0:
                self.losers[node] = i
                return
            if self.heads[other][:3] < self.heads[i][:3]:
                self.losers[node], i = i, other
            node //= 2
        self.losers[0] = i

    def __iter__(self):
        while self.n and not self.heads[i := self.losers[0]][0]:
            yield self.heads[i][3]
            self.heads[i] = self._next(i)
            self._play(i)


def merge_runs(captures: DataFrame, parts: int | None = None) -> DataFrame:
    """The global index: ``captures`` with (range, place), by which it is ordered by URL key, time, page and place in the archives.

    Ranges are of the whole order, so neither a URL with many captures nor a repeated row fills one, and there are so many that each has about
    ``RANGE_ROWS`` rows unless ``parts`` says how many. In a range the rows of a run come together, in
    their order; they stay Arrow columns, of which the loser tree reads some rows at a time while it merges the runs.
    """
    spark = captures.sparkSession
    parts = parts or max(int(spark.conf.get("spark.sql.shuffle.partitions")), -(-captures.count() // RANGE_ROWS))
    names = captures.columns
    schema = pa.schema([(n, pa.int64() if t == "bigint" else pa.string()) for n, t in captures.dtypes] + [("range", pa.int64()), ("place", pa.int64())])

    def merge(batches):
        from pyspark import TaskContext

        runs: dict[str, list[pa.RecordBatch]] = {}
        for batch in batches:
            stretches, start = pc.run_end_encode(batch.column("archive")), 0
            for end, archive in zip(stretches.run_ends.to_pylist(), stretches.values.to_pylist(), strict=True):
                runs.setdefault(archive, []).append(batch.slice(start, end - start))
                start = end
        at = TaskContext.get().partitionId()
        tree = LoserTree([rows(iter(parts), *names) for parts in runs.values()], _order)
        return batched(schema, ((*row, at, i) for i, row in enumerate(tree)))

    ranged = captures.repartitionByRange(parts, "urlkey", "captured", "page_id", "archive", "offset").sortWithinPartitions("archive", "urlkey", "captured", F.col("page_id").asc_nulls_first(), "offset")
    return ranged.mapInArrow(merge, INDEX + ", range long, place long")


def archive_and_index(pages: DataFrame, id_col: str = "page_id", url_col: str = "url", html_col: str = "html", least: int = 0, per_archive: int = 2000) -> DataFrame:
    """Write a record for every row to archives in the shared folder, read them back, and return the merged index.

    Null html is an empty payload; null urls and ids leave their header out and come back null; control characters and blanks in a URL are
    dropped from its header. Repeated rows have a record each. An empty table gives an empty index. Other columns are not looked at.
    """
    spark = pages.sparkSession
    path = scratch_path(spark, "warc")
    write_archives(pages, path, id_col, url_col, html_col, least, per_archive)
    return merge_runs(materialize(read_archives(spark, path), "captures"))
