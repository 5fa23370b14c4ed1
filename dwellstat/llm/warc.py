"""WARC archives with revisit records and a two-level capture index.

Writing: captures are sorted by reversed-host key (``com,example,www)/path``) and page id, and each
task writes one archive file with a gzip member per record. Of captures with equal payloads of at
least ``REVISIT_BYTES`` bytes the one with the largest page id is a response and the others are
revisit records that name it; smaller payloads are always written.

Index: the sorted capture lines are cut into blocks of ``BLOCK_LINES``, compressed, and appended to
index files. The directory holds one row per block with its first key. A lookup sorts its keys,
finds the block by binary search in the directory, reads that range of the index file, finds the
line by binary search in the block, and reads that range of the archive.

All files go to the folder shared by the executors (any address Arrow can open). Every attempt of a
task writes a file of its own name and only the finished attempt's rows reach the written index, so
a lost executor leaves at most an unused file behind.

Cases: null html is an empty payload and a null url an empty address; of equal payloads whose ids
are all null each is a response; repeated rows are written and found each; rows that share the
largest id are all responses; an empty table gives no archive and no rows; other columns are ignored.
"""

from __future__ import annotations

import base64
import bisect
import hashlib
import json
import uuid
import zlib
from collections.abc import Iterator

import pyarrow as pa
import pyarrow.compute as pc
import pyarrow.parquet as pq
from pyarrow import fs
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from dwellstat.llm import common
from dwellstat.llm.common import written
from dwellstat.session import scratch_path

REVISIT_BYTES = 1000
BLOCK_LINES = 512
#: Capture time written to every record; a crawl passes its own.
CAPTURED = "1970-01-01T00:00:00Z"
_PROFILE = "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"

common.by_value(__name__)


def reversed_host(url: Column) -> Column:
    """``http://www.example.com:80/a?b`` as ``com,example,www)/a?b``; white space is escaped."""
    clean = F.regexp_replace(F.coalesce(url, F.lit("")), r"[\s\x00-\x20]+", "%20")
    host = F.lower(F.regexp_extract(clean, r"^[A-Za-z][A-Za-z0-9+.-]*://([^/:?#]*)", 1))
    rest = F.regexp_replace(clean, r"^[A-Za-z][A-Za-z0-9+.-]*://[^/?#]*", "")
    return F.concat(F.array_join(F.reverse(F.split(host, r"\.")), ","), F.lit(")"), rest)


def decided(pages: DataFrame, key: str = "page_id", url: str = "url", html: str = "html") -> DataFrame:
    """(capture, digest, refers_to): the captures to be written as revisits."""
    small = pages.select(capture_key(url, key).alias("capture"), F.col(key).alias("page_id"), F.sha1(F.coalesce(F.col(html), F.lit(""))).alias("digest"),
                         F.octet_length(F.coalesce(F.col(html), F.lit(""))).alias("size"))
    small = written(small.where(F.col("size") >= REVISIT_BYTES), "warc-digests")
    first = small.groupBy("digest", "size").agg(F.max("page_id").alias("refers_to"), F.count("*").alias("n")).where("n > 1")
    return (small.join(first, ["digest", "size"]).where("refers_to IS NOT NULL AND NOT page_id <=> refers_to")
            .select("capture", "digest", "refers_to").distinct())


def _record_id(page_id: object, digest: str) -> str:
    return f"<urn:uuid:{uuid.uuid5(uuid.NAMESPACE_URL, f'{page_id}/{digest}')}>"


def _record(url: str, page_id: object, payload: bytes, digest: str, refers_to: object) -> bytes:
    """One record as a gzip member."""
    http = f"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nContent-Length: {len(payload)}\r\n\r\n".encode()
    revisit = refers_to is not None
    block = http if revisit else http + payload
    head = ["WARC/1.1", f"WARC-Type: {'revisit' if revisit else 'response'}", f"WARC-Record-ID: {_record_id(page_id, digest)}",
            f"WARC-Date: {CAPTURED}", f"WARC-Target-URI: {url}", "Content-Type: application/http; msgtype=response",
            f"WARC-Payload-Digest: sha1:{base64.b32encode(bytes.fromhex(digest)).decode()}",
            f"WARC-Block-Digest: sha1:{base64.b32encode(hashlib.sha1(block).digest()).decode()}"]
    if revisit:
        head += [f"WARC-Profile: {_PROFILE}", f"WARC-Refers-To: {_record_id(refers_to, digest)}", f"X-Refers-To-Page: {refers_to}"]
    head += [f"Content-Length: {len(block)}"]
    pack = zlib.compressobj(6, zlib.DEFLATED, 31)
    return pack.compress("\r\n".join(head).encode() + b"\r\n\r\n" + block + b"\r\n\r\n") + pack.flush()


def parsed(member: bytes) -> dict:
    """Headers of a record (lower-case names), its HTTP headers under ``http`` and its payload under ``payload``."""
    raw = zlib.decompress(member, 31)
    head, _, rest = raw.partition(b"\r\n\r\n")
    fields = dict(line.split(": ", 1) for line in head.decode().split("\r\n")[1:])
    out: dict = {k.lower(): v for k, v in fields.items()}
    block = rest[:int(out["content-length"])]
    if base64.b32encode(hashlib.sha1(block).digest()).decode() != out["warc-block-digest"].removeprefix("sha1:"):
        raise ValueError(f"damaged record {out['warc-record-id']}")
    http, _, payload = block.partition(b"\r\n\r\n")
    out["http"] = {k.lower(): v for k, v in (line.split(": ", 1) for line in http.decode().split("\r\n")[1:])}
    out["payload"] = payload
    return out


def write_archives(pages: DataFrame, folder: str, key: str = "page_id", url: str = "url", html: str = "html") -> DataFrame:
    """Writes the archives below ``folder``; returns the written capture lines (capture, page_id, file, offset, length)."""
    kind = dict(pages.dtypes)[key]
    # a capture's decision travels as a row of its own that sorts just before it, so pages are shuffled once
    html_or_empty = F.coalesce(F.col(html), F.lit(""))
    rows = pages.select(capture_key(url, key).alias("capture"), F.lit(1).alias("kind"), F.col(key).alias("page_id"), F.col(url).alias("url"),
                        html_or_empty.alias("html"), F.sha1(html_or_empty).alias("digest"), F.lit(None).cast(kind).alias("refers_to"))
    marks = decided(pages, key, url, html).select("capture", F.lit(0).alias("kind"), F.lit(None).cast(kind).alias("page_id"), F.lit(None).cast("string").alias("url"),
                                                  F.lit(None).cast("string").alias("html"), "digest", "refers_to")

    def write(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        store, top = fs.FileSystem.from_uri(folder)
        name, stream, offset, revisits = f"{uuid.uuid4().hex}.warc.gz", None, 0, {}
        try:
            for batch in batches:
                if stream is None and batch.num_rows:
                    store.create_dir(top, recursive=True)
                    stream = store.open_output_stream(f"{top}/{name}", compression=None)
                offsets, lengths = [], []
                for r in batch.to_pylist():
                    if r["kind"] == 0:
                        if r["capture"] != revisits.get("capture"):
                            revisits = {"capture": r["capture"]}
                        revisits[r["digest"]] = r["refers_to"]
                        continue
                    refers_to = revisits.get(r["digest"]) if r["capture"] == revisits.get("capture") else None
                    address = "".join((r["url"] or "").split())
                    member = _record(address, r["page_id"], r["html"].encode(), r["digest"], refers_to)
                    stream.write(member)
                    offsets.append(offset)
                    lengths.append(len(member))
                    offset += len(member)
                n, real = len(offsets), batch.filter(pc.equal(batch.column("kind"), 1))
                yield pa.RecordBatch.from_arrays(
                    [real.column("capture"), real.column("page_id"), pa.array([name] * n, pa.string()),
                     pa.array(offsets, pa.int64()), pa.array(lengths, pa.int64())], names=["capture", "page_id", "file", "offset", "length"])
        finally:
            if stream is not None:
                stream.close()

    parts = _parts(rows)
    dealt = rows.union(marks).repartitionByRange(parts, "capture").sortWithinPartitions("capture", "kind")
    lines = dealt.mapInArrow(write, f"capture string, page_id {kind}, file string, offset long, length long")
    return written(lines, "warc-captures")


def _parts(df: DataFrame) -> int:
    return int(df.sparkSession.conf.get("spark.sql.shuffle.partitions"))


def capture_key(url: str, page_id: str) -> Column:
    """Sort key of a capture: reversed host and path, then the page id at fixed width."""
    number = F.col(page_id).cast("string")
    return F.concat(reversed_host(F.col(url)), F.lit(" "), F.coalesce(F.lpad(number, 20, "0"), F.lit("-")))


def build_index(captures: DataFrame, folder: str) -> str:
    """Writes index blocks below ``folder`` and the directory as a table; returns the directory's path."""

    def blocks(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        store, top = fs.FileSystem.from_uri(folder)
        name, stream, offset, held = f"{uuid.uuid4().hex}.cdx", None, 0, []

        def emit() -> Iterator[pa.RecordBatch]:
            nonlocal stream, offset
            if stream is None:
                store.create_dir(top, recursive=True)
                stream = store.open_output_stream(f"{top}/{name}", compression=None)
            packed = zlib.compress("\n".join(line for _, line in held).encode())
            stream.write(packed)
            yield pa.RecordBatch.from_arrays([pa.array([held[0][0]]), pa.array([name]), pa.array([offset]), pa.array([len(packed)])],
                                             names=["first_key", "file", "offset", "length"])
            offset += len(packed)
            held.clear()

        try:
            for batch in batches:
                for r in batch.to_pylist():
                    place = json.dumps({"f": r["file"], "o": r["offset"], "n": r["length"]})
                    held.append((r["capture"], f"{r['capture']}\t{place}"))
                    if len(held) == BLOCK_LINES:
                        yield from emit()
            if held:
                yield from emit()
        finally:
            if stream is not None:
                stream.close()

    lines = captures.select("capture", "file", "offset", "length").repartitionByRange(_parts(captures), "capture").sortWithinPartitions("capture")
    directory = f"{folder}-directory"
    lines.mapInArrow(blocks, "first_key string, file string, offset long, length long").sort("first_key").write.parquet(directory)
    return directory


class Reader:
    """Looks captures up through the directory, holding one block and a few open files at a time."""

    def __init__(self, archives: str, index: str, directory: str) -> None:
        self.store, self.archives = fs.FileSystem.from_uri(archives)
        _, self.index = fs.FileSystem.from_uri(index)
        _, where = fs.FileSystem.from_uri(directory)
        found = pq.ParquetDataset(where, filesystem=self.store).read(columns=["first_key", "file", "offset", "length"])
        rows = sorted(zip(*[found.column(c).to_pylist() for c in ("first_key", "file", "offset", "length")], strict=True), key=lambda r: r[0].encode())
        self.firsts, self.blocks = [r[0].encode() for r in rows], rows
        self.held, self.lines, self.open = -1, [], {}

    def _range(self, path: str, offset: int, length: int) -> bytes:
        if path not in self.open:
            if len(self.open) >= 16:
                self.open.pop(next(iter(self.open))).close()
            self.open[path] = self.store.open_input_file(path)
        return self.open[path].read_at(length, offset)

    def _block(self, i: int) -> list[tuple[bytes, dict]]:
        if i != self.held:
            _, name, offset, length = self.blocks[i]
            text = zlib.decompress(self._range(f"{self.index}/{name}", offset, length))
            self.lines = [tuple(line.split(b"\t", 1)) for line in text.split(b"\n")]
            self.held = i
        return self.lines

    def find(self, key: bytes) -> Iterator[dict]:
        """The parsed records of a capture key, in index order."""
        i = max(0, bisect.bisect_left(self.firsts, key) - 1)
        while i < len(self.firsts) and self.firsts[i] <= key:
            lines = self._block(i)
            at = bisect.bisect_left(lines, key, key=lambda x: x[0])
            while at < len(lines) and lines[at][0] == key:
                place = json.loads(lines[at][1])
                yield parsed(self._range(f"{self.archives}/{place['f']}", place["o"], place["n"]))
                at += 1
            i += 1


def looked_up(keys: DataFrame, archives: str, index: str, directory: str, id_type: str = "long") -> DataFrame:
    """(page_id, payload_bytes, payload_digest, record_type, refers_to, html) of the captures in ``keys`` (capture, page_id).

    ``html`` is the payload of a response and null for a revisit.
    """

    def read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        reader = None
        names = ["page_id", "payload_bytes", "payload_digest", "record_type", "refers_to", "html"]
        for batch in batches:
            reader = reader or Reader(archives, index, directory)
            out: list[tuple] = []
            for key, page_id in zip(batch.column("capture").to_pylist(), batch.column("page_id").to_pylist(), strict=True):
                for r in reader.find(key.encode()):
                    digest = base64.b32decode(r["warc-payload-digest"].removeprefix("sha1:")).hex()
                    response = r["warc-type"] == "response"
                    if response and hashlib.sha1(r["payload"]).hexdigest() != digest:
                        raise ValueError(f"damaged payload of {key}")
                    out.append((page_id, int(r["http"]["content-length"]), digest, r["warc-type"],
                                None if response else r["x-refers-to-page"], r["payload"].decode() if response else None))
            columns = list(zip(*out, strict=True)) if out else [[] for _ in names]
            yield pa.RecordBatch.from_arrays(
                [pa.array(columns[0], batch.column("page_id").type), pa.array(columns[1], pa.int64()),
                 *[pa.array(c, pa.string()) for c in columns[2:]]], names=names)

    dealt = keys.distinct().repartitionByRange(_parts(keys), "capture").sortWithinPartitions("capture")
    found = dealt.mapInArrow(read, f"page_id {id_type}, payload_bytes long, payload_digest string, record_type string, refers_to string, html string")
    return found.withColumn("refers_to", F.col("refers_to").cast(id_type))


def round_trip(pages: DataFrame, key: str = "page_id", url: str = "url", html: str = "html") -> DataFrame:
    """Writes the pages as archives with their index and reads every capture back through it."""
    folder = scratch_path(pages.sparkSession, "warc")
    archives, index = f"{folder}/archives", f"{folder}/index"
    captures = write_archives(pages, archives, key, url, html)
    directory = build_index(captures, index)
    keys = pages.select(capture_key(url, key).alias("capture"), F.col(key).alias("page_id"))
    return looked_up(keys, archives, index, directory, dict(pages.dtypes)[key])
