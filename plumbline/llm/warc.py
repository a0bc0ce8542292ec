"""Operator 2. WARC archives with a two-level capture index.

``write`` puts one record per page into gzip archives, a member each, and returns
the captures: key, page_id, archive, offset and length. Of equal payloads the largest
page_id is a response; the others are revisits that name it. ``build_index`` sorts
the captures by reversed-host URL keys over all partitions. Each partition becomes a part of the index: a file of
compressed blocks of lines, and a sparse directory with the first line and the byte range of each block. ``lookup`` asks
for URL keys and page_ids (or keys alone), sends each to the part that may hold it, finds its block by binary search in the
part's directory, reads that range of the block file, and finds its lines by binary search in the block. What it learns is
archive, offset and length; ``read`` then reads just the record's byte range. The driver holds the bounds of the
parts, as many as the sort has partitions, and no lines.

Archives go to the folder that the cluster shares, under a name of the task's
attempt; only what a finished task returns names them, so a task that is lost
or run twice leaves at most a file that nothing reads.

Edge cases: a null html is an empty payload; empty payloads are equal and follow
the same rule; a null url has an empty key; page_ids may repeat (each row has
its own record; rows of the largest id among equal payloads are all responses); a null page_id is a response that nothing refers
to; an empty table gives no archives and no rows; extra columns are ignored.
"""

from __future__ import annotations

import base64
import hashlib
import itertools
import re
import zlib
from bisect import bisect_left
from collections.abc import Iterator
from urllib.parse import urlsplit

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import Scratch, only

#: Payloads of fewer bytes are never revisits.
LEAST_BYTES = 0
#: Captures of a block of the index.
BLOCK_LINES = 2000
LEVEL = 3
#: Bytes of an archive that one task reads records from.
STRETCH = 1 << 26
_DATE = "2024-01-01T00:00:00Z"


def url_key(url: str | None) -> str:
    """Host parts from the last to the first, then the rest: ``com,example,www)/path?query``."""
    try:
        parts = urlsplit((url or "").strip())
        host, port = (parts.hostname or ""), parts.port
    except ValueError:  # not a URL; the text itself sorts
        return re.sub(r"[\t\r\n]", " ", url or "").lower()
    rest = (parts.path or "/") + (f"?{parts.query}" if parts.query else "")
    return ",".join(reversed(host.split("."))) + (f":{port}" if port else "") + ")" + rest.lower()


def base32(sha1: bytes) -> str:
    return base64.b32encode(sha1).decode()


def record(page_id, url: str | None, payload: bytes, digest: str, refers_to) -> bytes:
    """One gzip member: a response with its payload, or a revisit without."""
    head = [
        ("WARC-Type", "response" if refers_to is None else "revisit"),
        ("WARC-Record-ID", f"<urn:page:{'' if page_id is None else page_id}>"),
        ("WARC-Date", _DATE),
        ("WARC-Target-URI", re.sub(r"[\r\n]", " ", url or "")),
        ("WARC-Payload-Digest", f"sha1:{digest}"),
    ]
    if refers_to is not None:
        head += [("WARC-Refers-To", f"<urn:page:{refers_to}>"), ("WARC-Profile", "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest")]
    http = f"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nContent-Length: {len(payload)}\r\n\r\n".encode()
    block = http + (payload if refers_to is None else b"")
    head += [("Content-Type", "application/http; msgtype=response"), ("Content-Length", str(len(block)))]
    gzip = zlib.compressobj(LEVEL, zlib.DEFLATED, 31)
    return gzip.compress("WARC/1.1\r\n".encode() + "".join(f"{k}: {v}\r\n" for k, v in head).encode() + b"\r\n" + block + b"\r\n\r\n") + gzip.flush()


def parse(member: bytes) -> tuple[dict[str, str], bytes, bytes]:
    """Header fields, HTTP head and payload of a record."""
    raw = zlib.decompress(member, 31)
    head, _, rest = raw.partition(b"\r\n\r\n")
    version, *lines = head.decode().split("\r\n")
    if version != "WARC/1.1":
        raise ValueError(f"not a WARC record: {version[:20]}")
    fields = dict(line.split(": ", 1) for line in lines)
    http, _, payload = rest[: int(fields["Content-Length"])].partition(b"\r\n\r\n")
    return fields, http, payload


def _sha1():
    return F.unhex(F.sha1(F.coalesce("html", F.lit(""))))


def revisits(pages: DataFrame, least: int = LEAST_BYTES) -> DataFrame:
    """(page_id, sha1, refers_to) of the payloads that revisit another page's; no texts are shuffled."""
    digests = pages.where(F.col("page_id").isNotNull()).select("page_id", _sha1().alias("sha1"), F.octet_length(F.coalesce("html", F.lit(""))).alias("n")).where(F.col("n") >= least)
    same = digests.groupBy("sha1").agg(F.max("page_id").alias("refers_to"), F.count(F.lit(1)).alias("k")).where("k > 1").drop("k")
    return digests.join(same, "sha1").where("page_id != refers_to").select("page_id", "sha1", "refers_to").distinct()


def qualified(spark: SparkSession, folder: str) -> str:
    """The folder as a URI of the file system that Spark takes it for, which a bare path doesn't name."""
    path = spark._jvm.org.apache.hadoop.fs.Path(folder)
    uri = path.getFileSystem(spark._jsc.hadoopConfiguration()).makeQualified(path).toUri().toString()
    return re.sub("^file:/+", "file:///", uri)


def _store(folder: str):
    """The file system and the path of a qualified folder."""
    from pyarrow import fs

    return fs.FileSystem.from_uri(folder)


CAPTURES = "key string, page_id long, file string, offset long, length int"
CAPTURE_COLUMNS = ["key", "page_id", "file", "offset", "length"]


def write(pages: DataFrame, folder: str, least: int = LEAST_BYTES) -> DataFrame:
    """Write the archives; the captures, one for each row of ``pages``."""
    folder = qualified(pages.sparkSession, folder)
    pages = only(pages, page_id="page_id", url="url", html="html")
    rows = pages.withColumn("sha1", _sha1()).join(revisits(pages, least), ["page_id", "sha1"], "left").drop("sha1")

    def archive(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        from pyspark import TaskContext

        task, out, offset = TaskContext.get(), None, 0
        store, root = _store(folder)
        name = f"{root}/{task.partitionId():05d}-{task.taskAttemptId()}.warc.gz"
        try:
            for batch in batches:
                found = []
                for page_id, url, html, refers in zip(batch.page_id, batch.url, batch.html, batch.refers_to):
                    payload = (html or "").encode()
                    page_id, refers = (None if pd.isna(x) else int(x) for x in (page_id, refers))
                    if out is None:
                        store.create_dir(root, recursive=True)
                        out = store.open_output_stream(name, compression=None)
                    member = record(page_id, url, payload, base32(hashlib.sha1(payload).digest()), refers)
                    out.write(member)
                    found.append((url_key(url), page_id, name.rpartition("/")[2], offset, len(member)))
                    offset += len(member)
                yield pd.DataFrame(found, columns=CAPTURE_COLUMNS).astype({"page_id": "Int64"})
        finally:
            if out is not None:
                out.close()

    return rows.mapInPandas(archive, CAPTURES)


PARTS = "first string, last string, n long, name string"


def build_index(captures: DataFrame, folder: str, lines: int = BLOCK_LINES) -> DataFrame:
    """Write the index; (first, last, n, name): each part's bounds, lines, and the name of its two files."""
    folder = qualified(captures.sparkSession, folder)

    def pack(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        from pyspark import TaskContext

        task, out, offset, n, last, directory = TaskContext.get(), None, 0, 0, "", []
        store, root = _store(folder)
        name = f"{task.partitionId():05d}-{task.taskAttemptId()}"
        held: list[str] = []
        try:
            for k in itertools.chain(batches, [None]):
                if k is not None and len(k):
                    held += k.line.tolist()
                if held and out is None:
                    store.create_dir(root, recursive=True)
                    out = store.open_output_stream(f"{root}/{name}.blocks", compression=None)
                while len(held) >= lines or k is None and held:
                    part, held = held[:lines], held[lines:]
                    block = zlib.compress("\n".join(part).encode(), 6)
                    out.write(block)
                    directory.append(f"{part[0]}\t{offset}\t{len(block)}")
                    offset, n, last = offset + len(block), n + len(part), part[-1]
        finally:
            if out is not None:
                out.close()
        if directory:
            with store.open_output_stream(f"{root}/{name}.directory", compression=None) as f:
                f.write("\n".join(directory).encode())
            yield pd.DataFrame({"first": [directory[0].rsplit("\t", 2)[0]], "last": [last], "n": [n], "name": [name]})

    line = F.concat_ws("\t", "key", F.coalesce(F.col("page_id").cast("string"), F.lit("")), "file", F.col("offset").cast("string"), F.col("length").cast("string"))
    return captures.select(line.alias("line")).repartitionByRange("line").sortWithinPartitions("line").mapInPandas(pack, PARTS)


class _Part:
    """A part of the index, opened for binary search; keeps one block."""

    def __init__(self, store, path: str):
        with store.open_input_stream(f"{path}.directory", compression=None) as f:
            rows = [x.rsplit("\t", 2) for x in f.read().decode().split("\n")]
        self.firsts, self.ranges = [x for x, *_ in rows], [(int(o), int(n)) for _, o, n in rows]
        self.source, self.at, self.lines = store.open_input_file(f"{path}.blocks"), -1, []

    def block(self, k: int) -> list[str]:
        if k != self.at:
            offset, size = self.ranges[k]
            self.at, self.lines = k, zlib.decompress(self.source.read_at(size, offset)).decode().split("\n")
        return self.lines

    def find(self, begin: str) -> Iterator[str]:
        """All lines that start so."""
        for k in range(max(bisect_left(self.firsts, begin) - 1, 0), len(self.firsts)):
            lines = self.block(k)
            i = bisect_left(lines, begin)
            while i < len(lines) and lines[i].startswith(begin):
                yield lines[i]
                i += 1
            if i < len(lines):
                return


def lookup(wanted: DataFrame, parts: DataFrame, folder: str) -> DataFrame:
    """The captures of each different (key, page_id) in ``wanted``, or of each key where it has no column page_id."""
    spark = wanted.sparkSession
    folder = qualified(spark, folder)
    bounds = sorted((r["first"], r["last"], r["name"]) for r in parts.select("first", "last", "name").collect())  # a row a partition
    shared = spark.sparkContext.broadcast(([f for f, *_ in bounds], [x for _, x, _ in bounds], [n for *_, n in bounds]))
    by_id = "page_id" in wanted.columns
    begin = F.concat("key", F.lit("\t"), F.coalesce(F.col("page_id").cast("string"), F.lit("")), F.lit("\t")) if by_id else F.concat("key", F.lit("\t"))

    def route(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        firsts, lasts, names = shared.value
        for batch in batches:
            found = []
            for x in batch.begin:
                # The first part that ends with or after the lines asked for, to the last one that begins before their end.
                found += [(names[k], x) for k in range(bisect_left(lasts, x), bisect_left(firsts, x[:-1] + "\n"))]
            yield pd.DataFrame(found, columns=["name", "begin"])

    def find(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        store, root = _store(folder)
        name = part = None
        for batch in batches:
            found = []
            for own, x in zip(batch.name, batch.begin):
                if own != name:
                    name, part = own, _Part(store, f"{root}/{own}")
                for line in part.find(x):
                    key, page_id, file, offset, length = line.split("\t")
                    found.append((key, int(page_id) if page_id else None, file, int(offset), int(length)))
            yield pd.DataFrame(found, columns=CAPTURE_COLUMNS).astype({"page_id": "Int64"})

    asked = wanted.select(begin.alias("begin")).where("begin is not null").distinct().mapInPandas(route, "name string, begin string")
    return asked.repartition("name").sortWithinPartitions("name", "begin").mapInPandas(find, CAPTURES)


def requests(pages: DataFrame) -> DataFrame:
    """The URL key and page_id of each row."""

    @F.pandas_udf("string")
    def key(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
        for urls in batches:
            yield pd.Series([url_key(u) for u in urls], dtype=object)

    return only(pages, page_id="page_id", url="url").select(key("url").alias("key"), "page_id")


RECORDS = "page_id long, url string, record_type string, refers_to long, payload_bytes long, payload_digest string, payload binary"


def read(captures: DataFrame, folder: str, payloads: bool = True) -> DataFrame:
    """The records in the captures' byte ranges, parsed. Size and digest are those of the full payload."""
    folder = qualified(captures.sparkSession, folder)

    def records(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        store, root = _store(folder)
        last = source = None
        for batch in batches:
            for i in range(0, len(batch), 500):
                found = []
                part = batch.iloc[i : i + 500]
                for file, offset, length in zip(part.file, part.offset, part.length):
                    if file != last:
                        last, source = file, store.open_input_file(f"{root}/{file}")
                    source.seek(offset)
                    fields, http, payload = parse(source.read(length))
                    kind, page = fields["WARC-Type"], fields["WARC-Record-ID"][10:-1]
                    digest = fields["WARC-Payload-Digest"].partition(":")[2]
                    size = int(dict(x.split(": ", 1) for x in http.decode().split("\r\n")[1:])["Content-Length"])
                    if kind == "response":
                        if base32(hashlib.sha1(payload).digest()) != digest or len(payload) != size:
                            raise ValueError(f"page {page}: the payload isn't the one that was written")
                    refers = fields.get("WARC-Refers-To")
                    found.append((int(page) if page else None, fields["WARC-Target-URI"], kind, int(refers[10:-1]) if refers else None, size, digest, payload if payloads and kind == "response" else None))
                yield pd.DataFrame(found, columns=[c.split()[0] for c in RECORDS.split(", ")]).astype({"page_id": "Int64", "refers_to": "Int64"})

    stretch = F.floor(F.col("offset") / STRETCH)
    return captures.repartition("file", stretch).sortWithinPartitions("file", "offset").mapInPandas(records, RECORDS)


def archive_and_read(pages: DataFrame) -> DataFrame:
    """Write every page, index the captures, look up each page by its URL and id, and read the record."""
    scratch = Scratch(pages.sparkSession, "warc")
    archives, index = scratch.path("archives"), scratch.path("index")
    captures = scratch.write(write(pages, archives), "captures")
    parts = scratch.write(build_index(captures, index), "parts")
    scratch.drop("captures")
    found = read(lookup(requests(pages), parts, index), archives, payloads=False)
    return found.select("page_id", "payload_bytes", "payload_digest", "record_type", "refers_to", "url")
