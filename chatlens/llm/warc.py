"""WARC archives of web pages, with revisit records, and a globally ordered capture index.

Writing: the SHA-1 of every payload is grouped; the smallest page_id of equal payloads (of at least
``min_revisit_bytes`` bytes) becomes a response, the others revisits. Records go out as uncompressed WARC 1.1 files
through Spark's text writer whose line separator is the record end, so any store that Spark
writes to will do and failed tasks leave nothing behind.

Index: reading an archive file gives a locally sorted capture run. Runs are dealt by ranges of (URL key, timestamp, page_id),
and each range is merged from its runs by a k-way loser tree, which puts the capture histories in global order.

Defined cases: a null html is an empty payload; a null url has the empty URL key; a null page_id is a capture of its
own that no revisit refers to (it is a revisit if a page with an id has the same payload); a page_id that repeats with the same payload gives
equal records; line breaks in a url are percent-encoded in the archive; other columns are ignored; no
rows give an empty archive and index. Files hold at most ``FILE_RECORDS`` records.
"""

from __future__ import annotations

import gzip
import re
import uuid
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from chatlens.llm.base import checkpoint, without_ids
from chatlens.session import scratch_path

END = "\r\n\r\n"
FILE_RECORDS = 2000  # records of an archive file, which one task reads whole
RANGE_ROWS = 500_000  # index rows aimed at in a range, about 100 MB
HEX32, BASE32 = "0123456789ABCDEFGHIJKLMNOPQRSTUV", "ABCDEFGHIJKLMNOPQRSTUVWXYZ234567"


def sha1_base32(payload: Column) -> Column:
    """Bare upper-case base32 SHA-1: five hexadecimal digits become four base-32 digits."""
    hexed = F.sha1(payload)
    parts = [F.lpad(F.conv(F.substring(hexed, 5 * i + 1, 5), 16, 32), 4, "0") for i in range(8)]
    return F.translate(F.concat(*parts), HEX32, BASE32)


def write_archive(pages: DataFrame, path: str, min_revisit_bytes: int = 0) -> None:
    """Write one record per row of ``pages(page_id, url, html)`` under ``path``."""
    payload = F.coalesce(F.col("html").cast("string"), F.lit(""))
    rows = pages.select(F.col("page_id"), F.regexp_replace(F.regexp_replace(F.coalesce("url", F.lit("")), "\r", "%0D"), "\n", "%0A").alias("url"),
                        payload.alias("html"))
    rows = rows.withColumn("digest", sha1_base32(F.col("html").cast("binary"))).withColumn("bytes", F.octet_length("html").cast("long"))
    rows = rows.withColumn("key", F.concat_ws(":", F.col("page_id").cast("string"), "digest"))
    narrow = rows.drop("html").where(F.col("bytes") >= min_revisit_bytes)
    first = checkpoint(narrow.groupBy("digest").agg(F.min("page_id").alias("first"), F.count("*").alias("n")).where("n > 1 and first is not null").drop("n"), "warc-first")
    revisits = checkpoint(narrow.join(first, "digest").where(~F.col("first").eqNullSafe(F.col("page_id"))), "warc-revisits")
    responses = without_ids(rows, revisits, "key")

    def header(kind: str, more: list[Column], length: Column) -> Column:
        line = lambda name, value: F.concat(F.lit(f"{name}: "), value, F.lit("\r\n"))
        name = lambda c: F.concat(F.lit("<urn:page:"), F.coalesce(F.col(c).cast("string"), F.lit("")), F.lit(">"))
        date = F.date_format(F.timestamp_seconds(F.lit(1_704_067_200) + F.coalesce(F.col("page_id"), F.lit(0))), "yyyy-MM-dd'T'HH:mm:ss'Z'")
        return F.concat(F.lit(f"WARC/1.1\r\nWARC-Type: {kind}\r\n"), line("WARC-Record-ID", name("page_id")), line("WARC-Date", date),
                        line("WARC-Target-URI", F.col("url")), line("WARC-Payload-Digest", F.concat(F.lit("sha1:"), "digest")),
                        line("X-Payload-Length", F.col("bytes").cast("string")),
                        *[line("WARC-Refers-To", name(c)) for c in more], F.lit("Content-Type: text/html; charset=utf-8\r\n"),
                        F.lit("Content-Length: "), length.cast("string"), F.lit(END))

    out = responses.select(F.concat(header("response", [], F.col("bytes")), "html").alias("value")).unionByName(
        revisits.select(header("revisit", ["first"], F.lit(0)).alias("value")))
    out.write.mode("overwrite").option("lineSep", END).option("maxRecordsPerFile", FILE_RECORDS).text(path)


def url_key(url: str) -> str:
    """Sort-friendly key: reversed host labels, then path and query; scheme, port and fragment go."""
    rest = url.partition("://")[2] or url
    host, mark, path = re.match(r"([^/?#]*)([/?]?)([^#]*)", rest, re.S).groups()
    host = re.sub(r":\d*$", "", host.rpartition("@")[2]).lower()
    return ",".join(reversed(host.split("."))) + ")" + (mark or "/") + path if host else ""


def records(data: bytes) -> Iterator[tuple[int, dict[str, str], bytes]]:
    """Offset, header fields and payload of every record of an archive file."""
    if data[:2] == b"\x1f\x8b":
        data = gzip.decompress(data)
    at, end = 0, END.encode()
    while at < len(data):
        stop = data.index(end, at)
        fields = dict(x.split(": ", 1) for x in data[at:stop].decode().split("\r\n")[1:])
        n = int(fields["Content-Length"])
        body = data[stop + 4:stop + 4 + n]
        if len(body) != n or data[stop + 4 + n:stop + 8 + n] != end:
            raise ValueError(f"broken record at byte {at}")
        yield at, fields, body
        at = stop + 8 + n


INDEX = "run string, url_key string, captured string, page_id long, url string, offset long, payload_bytes long, payload_digest string, record_type string, refers_to long"


def capture_runs(spark: SparkSession, path: str) -> DataFrame:
    """One locally sorted run of captures per archive file; payload digests are computed anew and compared."""
    import base64
    import hashlib

    names = [x.split()[0] for x in INDEX.split(", ")]

    def number(name: str | None) -> int | None:
        digits = (name or "")[len("<urn:page:"):-1]
        return int(digits) if digits else None

    def read(batches):
        for b in batches:
            for file, data in zip(b.column("path").to_pylist(), b.column("content")):
                rows = []
                for at, f, body in records(data.as_py()):
                    digest = f["WARC-Payload-Digest"].removeprefix("sha1:")
                    kind = f["WARC-Type"]
                    if kind == "response" and base64.b32encode(hashlib.sha1(body).digest()).decode() != digest:
                        raise ValueError(f"payload of {f['WARC-Record-ID']} does not fit its digest")
                    rows.append((file, url_key(f["WARC-Target-URI"]), f["WARC-Date"], number(f["WARC-Record-ID"]), f["WARC-Target-URI"], at,
                                 int(f["X-Payload-Length"]), digest, kind, number(f.get("WARC-Refers-To"))))
                rows.sort(key=order)
                yield pa.RecordBatch.from_arrays([pa.array(c, pa.int64() if n in ("page_id", "offset", "payload_bytes", "refers_to") else pa.string())
                                                  for n, c in zip(names, zip(*rows) if rows else [[]] * len(names))], names)

    return spark.read.format("binaryFile").load(path).select("path", "content").mapInArrow(read, INDEX)


def order(row) -> tuple:
    """Key of a capture: URL key, timestamp, page_id (null first)."""
    return row[1], row[2], -1 if row[3] is None else row[3]


class LoserTree:
    """k-way merge of sorted runs: each inner node keeps the loser of its match, so one path is replayed a step."""

    def __init__(self, runs: list[Iterator[tuple]]):
        self.runs, self.k = runs, len(runs)
        self.head = [next(r, None) for r in runs]
        self.loser = [-1] * self.k
        for i in range(self.k):
            self._play(i)

    def _less(self, a: int, b: int) -> bool:
        x, y = self.head[a], self.head[b]
        return x is not None and (y is None or (x, a) < (y, b))

    def _play(self, i: int) -> None:
        """Carry run i up from its leaf; at an empty node it waits for its opponent."""
        node, winner = (i + self.k) // 2, i
        while node > 0:
            if self.loser[node] < 0:
                self.loser[node] = winner
                return
            if self._less(self.loser[node], winner):
                self.loser[node], winner = winner, self.loser[node]
            node //= 2
        self.loser[0] = winner

    def __iter__(self):
        while self.k and self.head[w := self.loser[0]] is not None:
            yield self.head[w]
            self.head[w] = next(self.runs[w], None)
            self._play(w)


def merge_index(runs: DataFrame) -> DataFrame:
    """Captures of all runs in global order: partition by partition, each merged by a loser tree; ``place`` counts inside a partition."""
    runs = checkpoint(runs, "warc-runs")
    n = runs.count()
    parts = max(int(runs.sparkSession.conf.get("spark.sql.shuffle.partitions")), -(-n // RANGE_ROWS))
    ranged = runs.repartitionByRange(parts, "url_key", "captured", "page_id").sortWithinPartitions("run", "url_key", "captured", F.asc_nulls_first("page_id"))

    def merge(batches):
        batches = [b for b in batches if b.num_rows]
        if not batches:
            return
        t = pa.Table.from_batches(batches).combine_chunks()
        run = np.unique(np.asarray(t.column("run").combine_chunks().dictionary_encode().indices), return_index=True)[1]
        begin = [*sorted(run.tolist()), t.num_rows]
        keys, times = t.column("url_key").to_pylist(), t.column("captured").to_pylist()
        ids = [-1 if x is None else x for x in t.column("page_id").to_pylist()]
        tree = LoserTree([((keys[i], times[i], ids[i], i) for i in range(a, b)) for a, b in zip(begin, begin[1:])])
        taken = np.array([x[3] for x in tree], np.int64)
        out = t.take(pa.array(taken)).append_column("place", pa.array(np.arange(len(taken))))
        yield from out.to_batches(max_chunksize=10_000)

    return ranged.mapInArrow(merge, INDEX + ", place long")


def archive_and_index(pages: DataFrame, path: str | None = None) -> DataFrame:
    """Write ``pages`` as archives, read them back and return the merged capture index."""
    spark = pages.sparkSession
    path = path or scratch_path(spark, f"warc-{uuid.uuid4().hex}")
    write_archive(pages, path)
    return merge_index(capture_runs(spark, path))
