"""WARC archives with an externally merged capture index.

Writing: each task writes one or more ``.warc.gz`` files, a gzip member a
record, and beside each a run: the file's captures sorted by URL key, timestamp
and page.  Merging: k-way loser-tree merges of the runs, first in groups while
there are more than ``fan_in``, then by ranges of keys in parallel, give a
globally ordered capture history.  Reading goes by that index.
"""

from __future__ import annotations

import datetime
import hashlib
import re
import uuid
import zlib
from collections.abc import Callable, Iterator
from urllib.parse import quote

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import file_system, scratch, stored, write_atomically

#: Payloads that are shorter than this are stored again rather than revisited.
MIN_REVISIT_BYTES = 100
#: A capture's date is this second plus its page_id, where the caller has no dates.
EPOCH = 1_700_000_000
#: Lines of a run between two entries of its sparse index.
SPARSE = 256

_NAMESPACE = uuid.UUID("6ba7b811-9dad-11d1-80b4-00c04fd430c8")


def url_key(url: str | None) -> str:
    """Sort-friendly key: reversed host, then path and query; '-' for none."""
    m = re.match(r"(?s)^.*?://([^/?#]*)([^#]*)", url or "")
    if not m:
        return "-"
    host = m[1].lower().rpartition("@")[2]
    return quote(",".join(reversed(host.split("."))) + ")" + (m[2] or "/"), safe="!$&'()*+,/:;=?@[]~%-._").replace("%20", "+")


def _stamp(second: int) -> datetime.datetime:
    return datetime.datetime(1970, 1, 1) + datetime.timedelta(seconds=second % 250_000_000_000)


def record(page_id: int | None, url: str | None, payload: bytes, refers_to: int | None, second: int) -> bytes:
    """One WARC record as a gzip member; a revisit has no payload."""
    digest, revisit = hashlib.sha256(payload).hexdigest(), refers_to is not None
    http = f"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nContent-Length: {len(payload)}\r\n\r\n".encode()
    body = http if revisit else http + payload
    head = [
        "WARC/1.1",
        f"WARC-Type: {'revisit' if revisit else 'response'}",
        f"WARC-Record-ID: <urn:uuid:{uuid.uuid5(_NAMESPACE, f'{page_id} {digest}')}>",
        f"WARC-Date: {_stamp(second).isoformat()}Z",
        f"WARC-Payload-Digest: sha256:{digest}",
        f"X-Payload-Length: {len(payload)}",
    ]
    if url is not None:
        head.append("WARC-Target-URI: " + re.sub(r"[\x00-\x1f\x7f]", lambda m: f"%{ord(m[0]):02X}", url))
    if page_id is not None:
        head.append(f"X-Page-Id: {page_id}")
    if revisit:
        head += ["WARC-Profile: http://netpreserve.org/warc/1.1/revisit/identical-payload-digest", f"WARC-Refers-To: <urn:uuid:{uuid.uuid5(_NAMESPACE, f'{refers_to} {digest}')}>", f"X-Refers-To-Page: {refers_to}"]
    head += ["Content-Type: application/http;msgtype=response", f"Content-Length: {len(body)}", "", ""]
    packer = zlib.compressobj(1, zlib.DEFLATED, 31)
    return packer.compress("\r\n".join(head).encode() + body + b"\r\n\r\n") + packer.flush()


def parse(member: bytes) -> tuple[int | None, int, str, str, int | None, bytes]:
    """page_id, payload bytes, digest, type, refers_to, payload (empty for a revisit); checks lengths and digest."""
    raw = zlib.decompress(member, 31)
    cut = raw.index(b"\r\n\r\n")
    lines = raw[:cut].decode().split("\r\n")
    if lines[0] != "WARC/1.1":
        raise ValueError("not a WARC record")
    head = dict(line.split(": ", 1) for line in lines[1:])
    body = raw[cut + 4 : cut + 4 + int(head["Content-Length"])]
    payload = body[body.index(b"\r\n\r\n") + 4 :]
    page, size, digest = head.get("X-Page-Id"), int(head["X-Payload-Length"]), head["WARC-Payload-Digest"].removeprefix("sha256:")
    if head["WARC-Type"] == "response" and (len(payload) != size or hashlib.sha256(payload).hexdigest() != digest):
        raise ValueError(f"the payload of page {page} is damaged")
    refers = head.get("X-Refers-To-Page")
    return None if page is None else int(page), size, digest, head["WARC-Type"], None if refers is None else int(refers), payload


class LoserTree:
    """Merge sorted iterators of comparable items: log2(k) comparisons an item."""

    def __init__(self, sources: list[Iterator]):
        self.sources = [iter(s) for s in sources]
        self.heads = [next(s, None) for s in self.sources]
        k = len(self.sources)
        self.tree, winners = [0] * k, list(range(-k, 0)) + list(range(k))
        for node in range(k - 1, 0, -1):  # leaves are nodes k..2k-1
            a, b = (self._leaf_or(winners, x, k) for x in (2 * node, 2 * node + 1))
            win, lose = (a, b) if self._before(a, b) else (b, a)
            winners[node], self.tree[node] = win, lose
        self.winner = winners[1] if k > 1 else 0

    @staticmethod
    def _leaf_or(winners: list[int], node: int, k: int) -> int:
        return node - k if node >= k else winners[node]

    def _before(self, a: int, b: int) -> bool:
        x, y = self.heads[a], self.heads[b]
        return x is not None and (y is None or (x, a) < (y, b))

    def __iter__(self):
        k = len(self.sources)
        while k and (item := self.heads[win := self.winner]) is not None:
            yield item
            self.heads[win] = next(self.sources[win], None)
            node = (win + k) // 2
            while node:
                if self._before(self.tree[node], win):
                    self.tree[node], win = win, self.tree[node]
                node //= 2
            self.winner = win


def _line(key: str, second: int, page: int | None, file: str, offset: int, length: int) -> str:
    """A run's line; lines compare as (key, timestamp, page, place)."""
    return f"{key} {_stamp(second):%Y%m%d%H%M%S} {(-1 if page is None else page) + 2**63:020d} {file} {offset:014d} {length}"


def _write_run(path: str, lines: Iterator[str]) -> tuple[int, list[str]]:
    """Sorted lines and, beside them, every SPARSE-th with its place; returns a few keys."""
    sparse, count, at = [], 0, 0

    def fill(out):
        nonlocal count, at
        held: list[bytes] = []
        for line in lines:
            if count % SPARSE == 0:
                sparse.append((line, at))
                out.write(b"".join(held))
                held = []
            raw = line.encode() + b"\n"
            held.append(raw)
            at += len(raw)
            count += 1
        out.write(b"".join(held))

    write_atomically(path, fill)
    write_atomically(f"{path}.idx", lambda out: out.write("".join(f"{at}\t{line}\n" for line, at in sparse).encode()))
    return count, [line for line, _ in sparse[:: max(1, len(sparse) // 16)]]


def _read_run(path: str, low: str = "", high: str | None = None) -> Iterator[str]:
    """The run's lines from low up to high, from the place that the sparse index gives."""
    system, name = file_system(path)
    start = 0
    if low:
        with system.open_input_stream(f"{name}.idx") as f:
            for entry in f.read().decode().splitlines():
                at, line = entry.split("\t", 1)
                if line > low:
                    break
                start = int(at)
    with system.open_input_file(name) as f:
        f.seek(start)
        rest = b""
        while chunk := f.read(1 << 18):
            lines = (rest + chunk).split(b"\n")
            rest = lines.pop()
            for raw in lines:
                line = raw.decode()
                if high is not None and line >= high:
                    return
                if line >= low:
                    yield line


def first_payloads(pages: DataFrame) -> DataFrame:
    """(page_id, digest, refers_to) of the captures that revisit an earlier one.

    Digests are counted before any row is joined, and only repeated ones are
    joined back, without payloads.  Null page_ids never revisit nor are referred to.
    """
    payload = F.coalesce(F.col("html"), F.lit("")).cast("binary")
    narrow = pages.select("page_id", F.sha2(payload, 256).alias("digest"), F.octet_length(payload).alias("size")).where(f"size >= {MIN_REVISIT_BYTES} and page_id is not null")
    firsts = narrow.groupBy("digest").agg(F.min("page_id").alias("refers_to"), F.max("page_id").alias("last")).where("refers_to < last").drop("last")
    return narrow.join(firsts, "digest").where("page_id > refers_to").select("page_id", "digest", "refers_to").distinct()


def write_archives(pages: DataFrame, folder: str, max_records: int = 50_000) -> DataFrame:
    """Write WARC files and their runs; returns the runs (run, path, n, keys)."""
    refs = first_payloads(pages)
    payload = F.coalesce(F.col("html"), F.lit("")).cast("binary")
    rows = pages.select("page_id", "url", payload.alias("payload"), F.sha2(payload, 256).alias("digest")).join(refs, ["page_id", "digest"], "left").select("page_id", "url", "payload", "refers_to")
    # in one order, so that a repeated or late copy of a task writes the same archive and the same run
    rows = rows.sortWithinPartitions("page_id", "url", "refers_to", "payload")

    def write(batches):
        import pyarrow as pa
        from pyspark import TaskContext

        task = TaskContext.get().partitionId()
        stream = (row for batch in batches for row in zip(*(batch.column(c).to_pylist() for c in ("page_id", "url", "payload", "refers_to"))))
        held, more, part = [], True, 0
        while more:
            name, captures = f"crawl-{task:06d}-{part:04d}", []

            def fill(out):
                nonlocal more
                offset = 0
                for page, url, body, refers in stream:
                    second = EPOCH + (page or 0)
                    raw = record(page, url, body, refers, second)
                    out.write(raw)
                    captures.append(_line(url_key(url), second, page, f"{name}.warc.gz", offset, len(raw)))
                    offset += len(raw)
                    if len(captures) == max_records:
                        return
                more = False

            write_atomically(f"{folder}/{name}.warc.gz", fill)
            if captures:
                n, keys = _write_run(f"{folder}/{name}.run", iter(sorted(captures)))
                held.append((f"{folder}/{name}.run", n, keys))
            part += 1
        schema = pa.schema([("path", pa.string()), ("n", pa.int64()), ("keys", pa.list_(pa.string()))])
        yield pa.RecordBatch.from_arrays([pa.array(c, t.type) for c, t in zip(zip(*held) if held else ((), (), ()), schema)], schema=schema)

    return stored(rows.mapInArrow(write, "path string, n long, keys array<string>"), "warc-runs")


def _merge_group(prefix: str):
    def merge(pdf):
        import pandas as pd

        path = f"{prefix}-{pdf['g'].iloc[0]:06d}.run"
        n, keys = _write_run(path, iter(LoserTree([_read_run(p) for p in sorted(pdf["path"])])))
        return pd.DataFrame({"path": [path], "n": [n], "keys": [keys]})

    return merge


def merge_runs(runs: DataFrame, folder: str, fan_in: int = 128, per_range: int = 5_000) -> DataFrame:
    """The capture history: (part, rank, url_key, timestamp, file, offset, length), ordered by (part, rank).

    At most ``fan_in`` runs are open at once.  The last pass is cut into ranges
    of about ``per_range`` captures by at most 4,096 sampled keys; keys hold the
    timestamp and page as well, so a URL with very many captures is cut too.
    """
    spark = runs.sparkSession
    count, total = runs.agg(F.count("*"), F.coalesce(F.sum("n"), F.lit(0))).first()
    level = 0
    while count > fan_in:
        groups = -(-count // fan_in)
        level += 1

        # a row a run, numbered in one task
        numbered = runs.withColumn("g", F.pmod(F.row_number().over(Window.orderBy("path")), F.lit(groups)).cast("int"))
        runs = stored(numbered.groupBy("g").applyInPandas(_merge_group(f"{folder}/merged-{level}"), "path string, n long, keys array<string>"), "warc-runs")
        count = runs.count()
    paths = sorted(r.path for r in runs.select("path").collect())  # at most fan_in
    keys = sorted(r.key for r in runs.select(F.explode("keys").alias("key")).orderBy(F.xxhash64("key")).limit(4096).collect())
    parts = max(1, min(len(keys), -(-total // per_range)))
    cuts = ["", *dict.fromkeys(keys[len(keys) * i // parts] for i in range(1, parts)), None]
    ranges = [(i, low, high) for i, (low, high) in enumerate(zip(cuts, cuts[1:]))]

    def history(batches):
        import pyarrow as pa

        schema = pa.schema([("part", pa.int64()), ("rank", pa.int64()), ("url_key", pa.string()), ("timestamp", pa.string()), ("file", pa.string()), ("offset", pa.int64()), ("length", pa.int64())])
        for batch in batches:
            for part, low, high in zip(*(batch.column(c).to_pylist() for c in ("part", "low", "high"))):
                rows: list[tuple] = []
                for rank, line in enumerate(LoserTree([_read_run(p, low, high) for p in paths])):
                    key, stamp, _, file, offset, length = line.split(" ")
                    rows.append((part, rank, key, stamp, file, int(offset), int(length)))
                    if len(rows) == 10_000:
                        yield pa.RecordBatch.from_arrays([pa.array(c, t.type) for c, t in zip(zip(*rows), schema)], schema=schema)
                        rows = []
                if rows:
                    yield pa.RecordBatch.from_arrays([pa.array(c, t.type) for c, t in zip(zip(*rows), schema)], schema=schema)

    table = spark.createDataFrame(ranges, "part long, low string, high string").repartitionByRange(len(ranges), "part")
    return stored(table.mapInArrow(history, "part long, rank long, url_key string, timestamp string, file string, offset long, length long"), "warc-index")


def read_archives(index: DataFrame, folder: str, what: Callable[[bytes], tuple] = parse) -> DataFrame:
    """Each capture of the index, read from its archive and checked; payloads as ``payload``."""

    def read(batches):
        import pyarrow as pa

        schema = pa.schema([("page_id", pa.int64()), ("payload_bytes", pa.int64()), ("payload_digest", pa.string()), ("record_type", pa.string()), ("refers_to", pa.int64()), ("payload", pa.binary()), ("url_key", pa.string()), ("timestamp", pa.string()), ("part", pa.int64()), ("rank", pa.int64())])
        name, file = None, None
        for batch in batches:
            rows, size = [], 0
            for part, rank, key, stamp, path, offset, length in zip(*(batch.column(c).to_pylist() for c in ("part", "rank", "url_key", "timestamp", "file", "offset", "length"))):
                if path != name:
                    if file:
                        file.close()
                    system, base = file_system(folder)
                    name, file = path, system.open_input_file(f"{base}/{path}")
                rows.append((*what(file.read_at(length, offset)), key, stamp, part, rank))
                size += rows[-1][1]
                if size > 16_000_000:
                    yield pa.RecordBatch.from_arrays([pa.array(c, t.type) for c, t in zip(zip(*rows), schema)], schema=schema)
                    rows, size = [], 0
            if rows:
                yield pa.RecordBatch.from_arrays([pa.array(c, t.type) for c, t in zip(zip(*rows), schema)], schema=schema)
        if file:
            file.close()

    out = "page_id long, payload_bytes long, payload_digest string, record_type string, refers_to long, payload binary, url_key string, timestamp string, part long, rank long"
    return index.repartition("file").sortWithinPartitions("file", "offset").mapInArrow(read, out)


def archive(pages: DataFrame, folder: str) -> DataFrame:
    """Write ``pages`` (page_id, url, html) to WARC files, merge their index and read them back.

    Null html is an empty payload; a null URL has key '-'; rows that repeat the
    smallest page_id of a payload are each a response; a null page_id is always
    a response; an empty table gives no rows; further columns are not read.
    """
    return read_archives(merge_runs(write_archives(pages, folder), folder), folder)


def op4_warc(spark, sf_dir: str) -> DataFrame:
    pages = spark.read.parquet(f"{sf_dir}/pages.parquet")
    folder = scratch(spark, "warc")

    def digest(member: bytes) -> tuple:
        return (*parse(member)[:5], None)

    index = merge_runs(write_archives(pages, folder), folder)
    return read_archives(index, folder, digest).select("page_id", "payload_bytes", "payload_digest", "record_type", "refers_to")
