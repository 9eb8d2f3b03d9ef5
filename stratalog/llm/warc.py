"""WARC archives and their index: sorted capture runs merged by a loser tree.

ISO 28500 (WARC 1.1); Knuth, "The Art of Computer Programming", volume 3, 5.4.1.
"""

from __future__ import annotations

import hashlib
import re
import zlib
from collections.abc import Callable, Iterator
from typing import Any

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..session import scratch_path, store

MIN_REVISIT = 1000
URN = "urn:x-page:"
#: Repeated digests up to this size are broadcast.
BROADCAST_BYTES = 32 << 20
#: An archive file holds about so many bytes of payload at most, unless a single record is larger.
FILE_BYTES = 256 << 20


# --- writing -----------------------------------------------------------------------------


def mark_revisits(pages: DataFrame, id_col: str = "page_id", payload_col: str = "html", min_bytes: int = MIN_REVISIT) -> DataFrame:
    """pages' id, url and payload with payload_bytes, payload_digest and refers_to.

    Of the rows with equal payloads of at least ``min_bytes``, those with the
    largest id answer, all others refer to that id. Rows without an id refer
    too if any row of theirs has one; otherwise they answer. Digests that occur
    once need no answer; the others are broadcast while they are measured to be
    few, so that payloads stay where they lie, and merged with them beyond.
    """
    payload = F.coalesce(F.col(payload_col), F.lit(""))
    seen = pages.select(F.col(id_col).alias("_id"), F.col("url").alias("_url"), payload.alias("_payload")).select(
        "*", F.octet_length("_payload").cast("long").alias("payload_bytes"), F.sha1(F.col("_payload").cast("binary")).alias("payload_digest")
    )
    copies = seen.where(F.col("payload_bytes") >= min_bytes).groupBy("payload_digest").agg(F.max("_id").alias("_first"), F.count("*").alias("_n"))
    copies = store(copies.where("_n > 1 and _first is not null").drop("_n"), "copies")
    copies = F.broadcast(copies) if copies.count() * 128 <= BROADCAST_BYTES else copies.hint("merge")
    refers = F.when(F.col("_id").isNull() | (F.col("_id") < F.col("_first")), F.col("_first"))
    return seen.join(copies, "payload_digest", "left").withColumn("refers_to", refers).drop("_first")


#: What would end or change a header's value, and how it is written there; the percent sign first.
CODED = (("%", "%25"), ("\r", "%0D"), ("\n", "%0A"), (" ", "%20"), ("\t", "%09"))


def _header(name: str, value: Column) -> Column:
    """A header line, or nothing for a null; blanks, line ends and percent signs in the value are coded."""
    safe = value.cast("string")
    for plain, code in CODED:
        safe = F.replace(safe, F.lit(plain), F.lit(code))
    return F.coalesce(F.concat(F.lit(f"{name}: "), safe, F.lit("\r\n")), F.lit(""))


def decoded(value: str) -> str:
    """A header's value as it was before it was coded."""
    plain = {code: c for c, code in CODED}
    return re.sub("%(?:25|0D|0A|20|09)", lambda m: plain[m[0]], value)


def write_warc(pages: DataFrame, path: str, id_col: str = "page_id", payload_col: str = "html", date: Column | None = None, records_per_file: int = 1000) -> None:
    """One record for each row of pages in gzipped WARC 1.1 files below ``path``, response or revisit.

    Spark's own text writer lays the records down, so that the archive goes
    wherever Spark can write, commits with its tasks and is never held in one
    piece. A file has at most ``records_per_file`` records, and fewer where
    payloads are large, so that it can be read in one piece. ``date`` is a timestamp column; without one, the capture time is as
    many seconds after 2000 as the id says.
    """
    marked = mark_revisits(pages, id_col, payload_col)
    largest = pages.agg(F.max(F.octet_length(payload_col))).head()[0] or 1
    records_per_file = max(1, min(records_per_file, FILE_BYTES // largest))
    revisit = F.col("refers_to").isNotNull()
    moment = date if date is not None else F.timestamp_seconds(F.lit(946684800) + F.coalesce(F.col("_id").try_cast("long") % 10**9, F.lit(0)))
    http = F.concat(F.lit("HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nContent-Length: "), F.col("payload_bytes").cast("string"), F.lit("\r\n\r\n"))
    block = F.when(revisit, http).otherwise(F.concat(http, F.col("_payload")))
    record = F.concat(
        F.lit("WARC/1.1\r\nWARC-Type: "), F.when(revisit, "revisit").otherwise("response"), F.lit("\r\n"),
        _header("WARC-Record-ID", F.concat(F.lit(f"<{URN}"), F.coalesce(F.col("_id").cast("string"), F.lit("none")), F.lit(">"))),
        _header("WARC-Target-URI", F.col("_url")),
        _header("WARC-Date", F.date_format(moment, "yyyy-MM-dd'T'HH:mm:ss'Z'")),
        _header("WARC-Payload-Digest", F.concat(F.lit("sha1:"), F.col("payload_digest"))),
        _header("WARC-Profile", F.when(revisit, F.lit("http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"))),
        _header("WARC-Refers-To", F.when(revisit, F.concat(F.lit(f"<{URN}"), F.col("refers_to").cast("string"), F.lit(">")))),
        _header("WARC-Page-ID", F.col("_id")),
        _header("WARC-Payload-Length", F.col("payload_bytes")),
        F.lit("Content-Type: application/http;msgtype=response\r\nContent-Length: "), F.octet_length(block).cast("string"), F.lit("\r\n\r\n"),
        block, F.lit("\r\n\r"),  # the writer's line end is the last byte of the record
    )
    marked.select(record.alias("value")).write.option("lineSep", "\n").option("compression", "gzip").option("maxRecordsPerFile", records_per_file).text(path)


# --- reading -----------------------------------------------------------------------------


def inflate(data: bytes, piece: int = 1 << 20) -> Iterator[bytes]:
    """A gzip file's content in pieces, member after member."""
    while data:
        member = zlib.decompressobj(31)
        while data and not member.eof:
            out = member.decompress(data, piece)
            data = member.unconsumed_tail or member.unused_data
            if out:
                yield out


def records(pieces: Iterator[bytes]) -> Iterator[tuple[dict[str, str], bytes]]:
    """Headers (names in lower case) and block of each record; lengths decide, so that blocks may hold anything."""
    held = bytearray()

    def more() -> bool:
        piece = next(pieces, None)
        if piece is None:
            return False
        held.extend(piece)
        return True

    while True:
        while (end := held.find(b"\r\n\r\n")) < 0:
            if not more():
                if held.strip():
                    raise ValueError("the archive ends within a header")
                return
        lines = held[:end].decode("utf-8", "replace").split("\r\n")
        if not lines[0].startswith("WARC/"):
            raise ValueError(f"not a WARC record: {lines[0][:40]!r}")
        headers = {name.strip().lower(): value.strip(" \t") for name, _, value in (x.partition(":") for x in lines[1:])}
        begin, length = end + 4, int(headers["content-length"])
        while len(held) < begin + length + 4:
            if not more():
                raise ValueError("the archive ends within a record")
        yield headers, bytes(held[begin : begin + length])
        del held[: begin + length + 4]


def url_key(url: str | None) -> str:
    """Sort-friendly key: the host's labels reversed, then the rest, as ``org,example)/path``; empty for a null."""
    if not url:
        return ""
    m = re.match(r"(?s)(?:[A-Za-z][A-Za-z0-9+.\-]*://)?([^/?#]*)(.*)", url)
    return ",".join(reversed(m[1].lower().split("."))) + ")" + (m[2] or "/")


def _entry(headers: dict[str, str], block: bytes) -> tuple:
    kind = headers["warc-type"]
    if kind == "response":
        _, _, payload = block.partition(b"\r\n\r\n")
        size, digest = len(payload), hashlib.sha1(payload).hexdigest()
        if headers.get("warc-payload-digest") != f"sha1:{digest}":
            raise ValueError(f"payload of {headers.get('warc-record-id')} does not match its digest")
    else:
        size, digest = int(headers["warc-payload-length"]), headers["warc-payload-digest"].removeprefix("sha1:")
    refers = headers.get("warc-refers-to")
    refers = decoded(refers.removeprefix(f"<{URN}").removesuffix(">")) if refers else None
    url, page = (None if x is None else decoded(x) for x in (headers.get("warc-target-uri"), headers.get("warc-page-id")))
    return url_key(url), headers.get("warc-date", ""), page, url, size, digest, kind, refers


RUN_FIELDS = (("url_key", pa.string()), ("captured", pa.string()), ("page", pa.string()), ("url", pa.string()), ("payload_bytes", pa.int64()), ("payload_digest", pa.string()), ("record_type", pa.string()), ("refers", pa.string()))
RUN_SCHEMA = "url_key string, captured string, page string, url string, payload_bytes long, payload_digest string, record_type string, refers string"


def _order(row: tuple) -> tuple:
    """URL key, time, then page id as a number where it is one."""
    page = row[2] or ""
    return row[0], row[1], (len(page), page)


def capture_runs(spark: SparkSession, path: str) -> DataFrame:
    """The index of each archive file below ``path`` as a run of its own, sorted by URL key, time and page."""

    def scan(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for name, content in zip(batch.column(0), batch.column(1), strict=True):
                rows = sorted((_entry(*r) for r in records(inflate(content.as_py()))), key=_order)
                columns = list(zip(*rows, strict=True)) if rows else [()] * len(RUN_FIELDS)
                run = zlib.crc32(name.as_py().rpartition("/")[2].encode())
                yield pa.RecordBatch.from_arrays(
                    [*(pa.array(c, t) for c, (_, t) in zip(columns, RUN_FIELDS, strict=True)), pa.array([run] * len(rows), pa.int64())],
                    names=[*(n for n, _ in RUN_FIELDS), "run"],
                )

    files = spark.read.format("binaryFile").option("pathGlobFilter", "*.gz").load(path).select("path", "content")
    return files.mapInArrow(scan, f"{RUN_SCHEMA}, run long")


# --- merging -----------------------------------------------------------------------------


class LoserTree:
    """k sorted runs as one: each inner node keeps the loser of its match, so the next row costs one path of log k matches."""

    def __init__(self, runs: list[Iterator], key: Callable[[Any], Any]):
        self.runs, self.key, self.k = [iter(r) for r in runs], key, len(runs)
        self.rows: list = [None] * self.k
        self.heads: list = [None] * self.k  # keys; None where a run has ended
        for i in range(self.k):
            self._next(i)
        self.tree = [-1] * max(1, self.k)
        for i in range(self.k):
            self._play(i)

    def _next(self, i: int) -> None:
        row = next(self.runs[i], None)
        self.rows[i], self.heads[i] = row, None if row is None else self.key(row)

    def _before(self, a: int, b: int) -> bool:
        """Whether run a's head comes first; ended runs come last, ties go to the earlier run."""
        x, y = self.heads[a], self.heads[b]
        if x is None or y is None:
            return y is None and (x is not None or a < b)
        return x < y or (x == y and a < b)

    def _play(self, winner: int) -> None:
        node = (winner + self.k) // 2
        while node > 0:
            other = self.tree[node]
            if other == -1:
                self.tree[node] = winner
                return
            if self._before(other, winner):
                self.tree[node], winner = winner, other
            node //= 2
        self.tree[0] = winner

    def __iter__(self) -> Iterator:
        while self.k:
            i = self.tree[0]
            if self.heads[i] is None:
                return
            yield self.rows[i]
            self._next(i)
            self._play(i)


def _rows(parts: list[pa.RecordBatch], piece: int = 512) -> Iterator[tuple]:
    """The rows of a run's slice, a few at a time."""
    for part in parts:
        for i in range(0, part.num_rows, piece):
            yield from zip(*(c.to_pylist() for c in part.slice(i, piece).columns), strict=True)


def merge_runs(runs: DataFrame) -> DataFrame:
    """All runs as one history ordered by URL key, time and page, with part and rank: the order is that of (part, rank).

    Each part is a range of that order, drawn from a sample, so that a URL
    captured very often is spread over parts. The shuffle brings it its slice
    of every run; pieces of a slice may come in any order, so Spark lays them
    out again, run by run, and spills where it has to. The slices stay packed
    in columns; a loser tree takes their rows a few at a time.
    """
    fields = [n for n, _ in RUN_FIELDS]

    def merge(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        slices: dict[int, list[pa.RecordBatch]] = {}
        for batch in batches:
            run = batch.column(len(fields)).to_numpy()
            cuts = [0, *(np.flatnonzero(np.diff(run)) + 1).tolist(), batch.num_rows]
            for i, j in zip(cuts[:-1], cuts[1:], strict=True):
                if j > i:
                    slices.setdefault(int(run[i]), []).append(batch.slice(i, j - i).select(fields))
        part, rows, rank = TaskContext.get().partitionId(), [], 0
        for row in LoserTree([_rows(slices[run]) for run in sorted(slices)], _order):
            rows.append(row)
            if len(rows) == 5000:
                yield _batch(rows, part, rank)
                rank, rows = rank + len(rows), []
        yield _batch(rows, part, rank)

    def _batch(rows: list[tuple], part: int, rank: int) -> pa.RecordBatch:
        columns = list(zip(*rows, strict=True)) if rows else [()] * len(RUN_FIELDS)
        n = len(rows)
        return pa.RecordBatch.from_arrays(
            [*(pa.array(c, t) for c, (_, t) in zip(columns, RUN_FIELDS, strict=True)), pa.array([part] * n, pa.int32()), pa.array(range(rank, rank + n), pa.int64())],
            names=[*fields, "part", "rank"],
        )

    page = F.coalesce("page", F.lit(""))
    order = ["url_key", "captured", F.length(page), page]
    return runs.repartitionByRange(*order).sortWithinPartitions("run", *order).select(*fields, "run").mapInArrow(merge, f"{RUN_SCHEMA}, part int, rank long")


def archive_and_index(pages: DataFrame, path: str | None = None, id_col: str = "page_id", payload_col: str = "html", date: Column | None = None) -> DataFrame:
    """Write pages as WARC files, read these back and return their merged index.

    Columns: ``id_col``, payload_bytes, payload_digest, record_type, refers_to,
    url, url_key, captured, part and rank. A null payload is an empty one; null
    ids and URLs come back as null, and rows repeat as they stand in pages. An
    empty table gives an empty index. Columns other than the id, url and
    payload are not read. Without ``path`` the archive lies in the shared
    folder until the driver ends.
    """
    spark, kind = pages.sparkSession, pages.schema[id_col].dataType
    path = path or scratch_path(spark, "warc")
    write_warc(pages, path, id_col, payload_col, date)
    merged = merge_runs(store(capture_runs(spark, path), "runs"))
    return merged.select(
        F.col("page").cast(kind).alias(id_col), "payload_bytes", "payload_digest", "record_type", F.col("refers").cast(kind).alias("refers_to"), "url", "url_key", "captured", "part", "rank"
    )
