"""WARC output and an external merge of its capture index (operator 2).

Each write task sorts its captures by URL key, time and id and appends them to an archive
of its own (one gzip member a record), so every archive is a locally
sorted run. Its index entries go to range partitions of (URL key, time, id).
A merge task holds the index entries of its range and one cursor per run over
that run's contiguous slice, and pulls records through a loser tree: one
comparison per level for each record. Read-ahead of all runs together takes at
most ``AHEAD`` bytes (or one record a run), and an archive is open during a read only. Read in order, the partitions are the globally
ordered capture histories. Groups of more than ``fan_in`` runs are merged in
nested trees.

Payloads are de-duplicated by SHA-1 (pre-aggregated before its shuffle): of
equal payloads of at least ``min_bytes`` bytes the one with the largest page_id
is a response, others are revisits that carry its digest, length and id.

A null html is an empty payload; a null url has the empty key; a null page_id
ranks below all others, and a class of null ids only is all responses. Rows
that repeat the page_id of the response are responses. Extra columns are ignored.
"""

from __future__ import annotations

import hashlib
import uuid
import zlib
from collections.abc import Iterable, Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import filesystem, shared_path, written

AHEAD = 64 << 20  # bytes that a merge task reads ahead in all of its runs
ENTRY = "run int, path string, urlkey string, fetched string, page_id long, offset long, length long"
CAPTURE = "page_id long, payload_bytes long, payload_digest string, record_type string, refers_to long, urlkey string, fetched string, path string, offset long, length long"


def url_key(url):
    """Sort-friendly key: host labels reversed, then ``)`` and the rest; lower-case host, no scheme, port or fragment."""
    url = F.coalesce(url, F.lit(""))
    host = F.lower(F.regexp_extract(url, r"^[A-Za-z][A-Za-z0-9+.\-]*://(?:[^/?#@]*@)?([^/?#:]*)", 1))
    rest = F.regexp_extract(url, r"^[A-Za-z][A-Za-z0-9+.\-]*://[^/?#]*([^#]*)", 1)
    return F.when(host == "", url).otherwise(F.concat(F.array_join(F.reverse(F.split(host, r"\.")), ","), F.lit(")"), rest))


class LoserTree:
    """Merges sorted iterators of (key, value). An inner node keeps the loser of its match; only the winner's path is replayed."""

    _END = object()

    def __init__(self, runs: Iterable[Iterator]):
        self.runs = list(runs)
        self.k = k = max(1, len(self.runs))
        self.head = [next(r, self._END) for r in self.runs] or [self._END]
        self.node = [-1] * k
        for i in range(k):
            self._play(i)

    def _beats(self, a: int, b: int) -> bool:
        x, y = self.head[a], self.head[b]
        if x is self._END or y is self._END:
            return y is self._END and (x is not self._END or a < b)
        return x[0] < y[0] or (x[0] == y[0] and a < b)

    def _play(self, i: int) -> None:
        """Run ``i`` climbs from its leaf; while the tree fills, it waits at the first empty node."""
        at, winner = (i + self.k) // 2, i
        while at:
            other = self.node[at]
            if other < 0:
                self.node[at] = winner
                return
            if self._beats(other, winner):
                self.node[at], winner = winner, other
            at //= 2
        self.node[0] = winner

    def __iter__(self) -> Iterator:
        while (top := self.head[w := self.node[0]]) is not self._END:
            yield top
            self.head[w] = next(self.runs[w], self._END)
            self._play(w)


def merged(runs: list[Iterator], fan_in: int = 64) -> Iterator:
    while len(runs) > fan_in:
        runs = [iter(LoserTree(runs[i : i + fan_in])) for i in range(0, len(runs), fan_in)]
    return iter(LoserTree(runs))


def record(kind: str, page_id: int | None, url: str | None, fetched: str, payload: bytes, digest: str, refers_to: int | None) -> bytes:
    """One WARC 1.1 record; a revisit has no payload."""
    http = b"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nContent-Length: %d\r\n\r\n" % len(payload)
    block = http + (payload if kind == "response" else b"")
    stamp = f"{fetched[:4]}-{fetched[4:6]}-{fetched[6:8]}T{fetched[8:10]}:{fetched[10:12]}:{fetched[12:14]}Z"
    head = [
        "WARC/1.1",
        f"WARC-Type: {kind}",
        f"WARC-Record-ID: <urn:uuid:{uuid.uuid5(uuid.NAMESPACE_URL, f'{page_id}|{fetched}|{digest}')}>",
        f"WARC-Date: {stamp}",
        "WARC-Target-URI: " + (url or "").replace("\r", "%0D").replace("\n", "%0A"),
        f"WARC-Payload-Digest: sha1:{digest}",
        "Content-Type: application/http; msgtype=response",
        f"X-Page-Id: {'' if page_id is None else page_id}",
        f"X-Payload-Length: {len(payload)}",
    ]
    if kind == "revisit":
        head += ["WARC-Profile: http://netpreserve.org/warc/1.1/revisit/identical-payload-digest", f"X-Refers-To-Page: {refers_to}"]
    head.append(f"Content-Length: {len(block)}")
    return "\r\n".join(head).encode() + b"\r\n\r\n" + block + b"\r\n\r\n"


def parse(raw: bytes) -> dict:
    """Headers and payload of one record, checked against its digest."""
    head, _, rest = raw.partition(b"\r\n\r\n")
    lines = head.decode().split("\r\n")
    if not lines[0].startswith("WARC/"):
        raise ValueError("not a WARC record")
    field = dict(x.split(": ", 1) if ": " in x else (x.rstrip(":"), "") for x in lines[1:])
    block = rest[: int(field["Content-Length"])]
    payload = block.partition(b"\r\n\r\n")[2]
    digest = field["WARC-Payload-Digest"].removeprefix("sha1:")
    n = int(field["X-Payload-Length"])
    if field["WARC-Type"] == "response" and (hashlib.sha1(payload).hexdigest() != digest or len(payload) != n):
        raise ValueError(f"payload of {field['WARC-Record-ID']} doesn't match its digest")
    return {"type": field["WARC-Type"], "bytes": n, "digest": digest, "payload": payload, "page_id": int(p) if (p := field["X-Page-Id"]) else None, "refers_to": int(r) if (r := field.get("X-Refers-To-Page")) else None}


def classified(pages: DataFrame, min_bytes: int = 1000) -> DataFrame:
    """``pages`` (page_id, url, fetched, payload) with digest, record_type and refers_to."""
    pages = pages.withColumn("digest", F.sha1("payload"))
    large = pages.where(F.octet_length("payload") >= min_bytes).select("digest", "page_id")
    top = large.groupBy("digest").agg(F.max("page_id").alias("keeper"), F.count("*").alias("copies")).where("copies > 1 and keeper is not null").select("digest", "keeper")
    again = written(large.join(top, "digest").where(~F.col("page_id").eqNullSafe(F.col("keeper"))).distinct(), "revisits").toDF("d", "p", "refers_to")
    both = pages.join(again, F.expr("digest = d and page_id <=> p"), "left")
    return both.select("page_id", "url", "fetched", "payload", "digest", F.when(F.col("refers_to").isNull(), "response").otherwise("revisit").alias("record_type"), "refers_to")


def write(records: DataFrame, folder: str, level: int = 1) -> DataFrame:
    """Write sorted runs; returns their index entries."""
    keyed = records.withColumn("urlkey", url_key(F.col("url"))).sortWithinPartitions("urlkey", "fetched", F.col("page_id").asc_nulls_first())

    def run(parts):
        from pyspark import TaskContext

        fs, base = filesystem(folder)
        fs.create_dir(base, recursive=True)
        part = TaskContext.get().partitionId()
        path = f"{base}/run-{part:06d}-{uuid.uuid4().hex}.warc.gz"  # a retried task writes a file of its own
        at, out = 0, None
        try:
            for batch in parts:
                rows = []
                for r in batch.to_pylist():
                    out = out or fs.open_output_stream(path, compression=None)
                    z = zlib.compressobj(level, zlib.DEFLATED, 31)
                    raw = z.compress(record(r["record_type"], r["page_id"], r["url"], r["fetched"], r["payload"], r["digest"], r["refers_to"])) + z.flush()
                    out.write(raw)
                    rows.append((part, path, r["urlkey"], r["fetched"], r["page_id"], at, len(raw)))
                    at += len(raw)
                if rows:
                    types = [pa.int32(), pa.string(), pa.string(), pa.string(), pa.int64(), pa.int64(), pa.int64()]
                    yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows, strict=True), types, strict=True)], [x.split()[0] for x in ENTRY.split(", ")])
        finally:
            if out is not None:
                out.close()

    return keyed.mapInArrow(run, ENTRY)


def _slice(path: str, entries: list[tuple], ahead: int) -> Iterator[tuple]:
    """(key, (entry, path, record)) of a run's entries in order, reading its archive ahead in pieces; the file is open during a read only."""
    fs, name = filesystem(path)
    lo, held = 0, b""
    for entry in entries:
        offset, length = entry[3], entry[4]
        if not lo <= offset or offset + length > lo + len(held):
            with fs.open_input_file(name) as f:
                f.seek(offset)
                lo, held = offset, f.read(max(length, ahead))
        raw = zlib.decompress(held[offset - lo : offset - lo + length], 31)
        yield entry[:3], (entry, path, parse(raw))


def histories(entries: DataFrame, partitions: int | None = None) -> DataFrame:
    """All captures in global order of (URL key, time, id), read back from the archives."""
    n = partitions or int(entries.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    low = -(2**63)

    def run(parts):
        runs: dict[str, list[tuple]] = {}
        for batch in parts:
            for r in batch.to_pylist():
                runs.setdefault(r["path"], []).append((r["urlkey"], r["fetched"], low if r["page_id"] is None else r["page_id"], r["offset"], r["length"]))
        ahead = min(1 << 18, AHEAD // max(1, len(runs)))
        cursors = [_slice(path, sorted(runs[path], key=lambda e: e[3]), ahead) for path in sorted(runs)]
        names = [x.split()[0] for x in CAPTURE.split(", ")]
        types = [pa.int64(), pa.int64(), pa.string(), pa.string(), pa.int64(), pa.string(), pa.string(), pa.string(), pa.int64(), pa.int64()]
        rows: list[tuple] = []
        for _, (e, path, rec) in merged(cursors):
            rows.append((rec["page_id"], rec["bytes"], rec["digest"], rec["type"], rec["refers_to"], e[0], e[1], path, e[3], e[4]))
            if len(rows) == 5000:
                yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows, strict=True), types, strict=True)], names)
                rows = []
        if rows:
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows, strict=True), types, strict=True)], names)

    return entries.repartitionByRange(n, "urlkey", "fetched", F.col("page_id").asc_nulls_first()).mapInArrow(run, CAPTURE)


def round_trip(pages: DataFrame, min_bytes: int = 1000) -> DataFrame:
    """Write ``pages`` (page_id, url, fetched, payload) as WARC and read all captures back in order."""
    spark = pages.sparkSession
    entries = written(write(classified(pages, min_bytes), shared_path(spark, "warc")), "capture-runs")
    return histories(entries)


def captures(pages: DataFrame) -> DataFrame:
    """page_id, url, fetched (14 digits) and UTF-8 payload of a ``pages`` table, which has no fetch times: one a second by id."""
    start = F.unix_timestamp(F.lit("2024-01-01 00:00:00"))
    second = F.pmod(F.coalesce(F.col("page_id").cast("long"), F.lit(0)), F.lit(10**9))
    return pages.select(
        F.col("page_id").cast("long").alias("page_id"),
        F.col("url").cast("string").alias("url"),
        F.date_format(F.timestamp_seconds(start + second), "yyyyMMddHHmmss").alias("fetched"),
        F.encode(F.coalesce("html", F.lit("")), "UTF-8").alias("payload"),
    )
