"""WARC archives: written with one gzip member a record, read back by byte ranges.

Writing: each task writes the pages of its partition as one .warc.gz in the
shared folder, whole or not at all. Of pages with equal payloads of at least
`min_revisit_bytes`, the one of largest id is a response and the others revisit
it; that is decided on digests, before any payload is moved. A revisit's header
tells the size and digest of the full payload.

Reading is splittable: a task gets ranges of bytes. From a range's start it
looks for the gzip magic; a place counts as a member if what follows inflates
to a WARC header. A range owns the members that start inside it and reads past
its end to finish the last one. Behind a member the next starts at once, so
the search runs only where a range begins inside one. A member is inflated a
chunk at a time; payloads are hashed and counted as they come. Archives of
other writers may hold any type of record, blocks that are no HTTP messages and
many records a member; a member that is damaged or cut short is an error.

Defined results: a null html is an empty payload; a null page_id is smaller
than all others; rows that share page_id and payload are all responses if that
id is the largest; an empty table gives no archive and no rows; of pages only
the three columns named are read, whatever others there are.
"""

from __future__ import annotations

import base64
import hashlib
import re
import uuid
import zlib

import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from quintet.llm import common

MAGIC = b"\x1f\x8b\x08"
CHUNK = 256 << 10
DATE = "2020-01-01T00:00:00Z"
MANIFEST = "archive string, bytes long"
READ = "archive string, offset long, page_id long, record_type string, refers_to long, url string, payload_bytes long, payload_digest string, record_id string, refers_to_id string"


def base32_sha1(payload: bytes) -> str:
    return base64.b32encode(hashlib.sha1(payload).digest()).decode()


def record_id(ident: int | None) -> str:
    return f"<urn:uuid:{uuid.uuid5(uuid.NAMESPACE_URL, f'page:{ident}')}>"


def member(ident: int | None, url: str | None, payload: bytes, refers_to: int | None, revisit: bool) -> bytes:
    """One record as a gzip member."""
    http = f"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nContent-Length: {len(payload)}\r\n\r\n".encode()
    block = http if revisit else http + payload
    target = re.sub(r"[\x00-\x20\x7f]", lambda m: f"%{ord(m[0]):02X}", url or "")
    lines = [
        "WARC/1.1",
        f"WARC-Type: {'revisit' if revisit else 'response'}",
        f"WARC-Record-ID: {record_id(ident)}",
        f"WARC-Date: {DATE}",
        f"WARC-Target-URI: {target}",
        f"WARC-Payload-Digest: sha1:{base32_sha1(payload)}",
        "Content-Type: application/http; msgtype=response",
        f"Content-Length: {len(block)}",
        f"X-Page-Id: {'' if ident is None else ident}",
    ]
    if revisit:
        lines += [
            f"WARC-Refers-To: {record_id(refers_to)}",
            "WARC-Profile: http://netpreserve.org/warc/1.1/revisit/identical-payload-digest",
            f"X-Refers-To-Page-Id: {'' if refers_to is None else refers_to}",
            f"X-Payload-Bytes: {len(payload)}",
        ]
    raw = "\r\n".join([*lines, "", ""]).encode() + block + b"\r\n\r\n"
    z = zlib.compressobj(1, zlib.DEFLATED, 31)
    return z.compress(raw) + z.flush()


def write(pages: DataFrame, folder: str, *, id_col: str = "page_id", url_col: str = "url", html_col: str = "html", min_revisit_bytes: int = 0) -> DataFrame:
    """Write archives below folder; returns (archive, bytes), computed once."""
    rows = pages.select(F.col(id_col).cast("long").alias("id"), F.col(url_col).alias("url"), F.coalesce(html_col, F.lit("")).alias("html"))
    rows = rows.withColumn("digest", F.sha1(F.encode("html", "utf-8")))
    groups = (
        rows.filter(F.octet_length("html") >= min_revisit_bytes)
        .groupBy("digest").agg(F.count("*").alias("n"), F.max("id").alias("first"))
        .filter("n > 1").select("digest", "first", F.lit(True).alias("grouped"))
    )
    both = rows.join(groups, "digest", "left").select(
        "id", "url", "html", "first", F.expr("coalesce(grouped and not (id <=> first), false)").alias("revisit")
    )

    def archive(batches):
        number, any_row = TaskContext.get().partitionId(), False

        def produce(out):
            for b in common.by_bytes(batches, "html"):
                cols = [b.column(c).to_pylist() for c in ("id", "url", "first", "revisit")]
                for ident, url, first, revisit, html in zip(*cols, common.utf8(b.column("html")), strict=True):
                    out.write(member(ident, url, html, first, revisit))

        import itertools

        batches = (b for b in batches if b.num_rows)
        if (head := next(batches, None)) is None:
            return
        batches = itertools.chain([head], batches)
        path, size = common.write_whole(folder, f"pages-{number:06d}", ".warc.gz", produce)
        yield pa.RecordBatch.from_pydict({"archive": [path], "bytes": [size]})

    return common.cut(both.mapInArrow(archive, MANIFEST))


class Records:
    """Records of one open archive that start within [start, end)."""

    def __init__(self, source, start: int, end: int, size: int):
        self.source, self.start, self.end, self.size = source, start, end, size
        self.have, self.at = b"", 0  # bytes read and the place of the first

    def bytes_at(self, place: int, n: int) -> bytes:
        """Up to n bytes from a place, through one moving buffer."""
        if not (self.at <= place and place + n <= self.at + len(self.have)):
            keep = self.have[place - self.at :] if self.at <= place <= self.at + len(self.have) else b""
            self.source.seek(place + len(keep))
            self.have, self.at = keep + self.source.read(max(n, CHUNK) - len(keep)), place
        return self.have[place - self.at : place - self.at + n]

    def __iter__(self):
        """(place of the member, header, payload size, payload digest) of each record."""
        place, known = self.start, self.start == 0  # known: a member has to start here
        while place < self.end:
            if self.bytes_at(place, len(MAGIC)) != MAGIC:
                if known:
                    self.padding(place)
                    return
                chunk = self.bytes_at(place, min(CHUNK, self.end - place + len(MAGIC) - 1))
                found = chunk.find(MAGIC)
                place += found if found >= 0 else max(1, len(chunk) - len(MAGIC) + 1)
                continue
            parser, inflated = Parser(), self.inflated(place)
            try:
                for piece, after in inflated:
                    for record in parser.feed(piece):
                        yield place, *record
                yield from ((place, *record) for record in parser.finish())
            except (zlib.error, ValueError, EOFError) as e:
                if known or parser.begun:
                    raise ValueError(f"the member at byte {place} is damaged: {e}") from e
                place += 1
                continue
            place, known = after, True

    def padding(self, place: int) -> None:
        """Behind the last member there may be zeros only."""
        while chunk := self.bytes_at(place, CHUNK):
            if chunk.strip(b"\0"):
                raise ValueError(f"no member starts at byte {place}")
            place += len(chunk)

    def inflated(self, place: int):
        """(piece, end of the member so far) of the member at a place, bounded pieces at a time."""
        z, at = zlib.decompressobj(31), place
        while not z.eof:
            piece = self.bytes_at(at, CHUNK // 4)
            if not piece:
                raise EOFError("the archive ends inside it")
            at += len(piece)
            out = z.decompress(piece, CHUNK)
            while True:
                yield out, at - len(z.unused_data)
                if z.eof or not z.unconsumed_tail:  # at the end, the tail is the next member
                    break
                out = z.decompress(z.unconsumed_tail, CHUNK)


class Parser:
    """Records of one member, from its inflated bytes; headers and blocks may be of any length, and only headers are held.

    The payload of an HTTP message is what follows its headers, that of any other record its block.
    """

    def __init__(self):
        self.raw, self.looked = bytearray(), 0
        self.head: dict[str, str] | None = None
        self.begun = False  # whether a record's header has been read

    def feed(self, piece: bytes):
        self.raw += piece
        while self.raw:
            if self.head is None:
                if not self.looked and self.raw[:1] in (b"\r", b"\n"):  # what closes the record before
                    if not (rest := self.raw.lstrip(b"\r\n")):
                        return self.raw.clear()
                    self.raw = rest
                # the prefix rejects false magic; a true header may be of any length
                if not self.raw.startswith(b"WARC/"[: len(self.raw)]):
                    raise ValueError("no record starts there")
                cut, self.looked = self.raw.find(b"\r\n\r\n", self.looked), max(0, len(self.raw) - 3)
                if cut < 0:
                    return None
                lines = self.raw[:cut].decode("utf-8", "replace").split("\r\n")
                self.head = {k.strip().lower(): v.strip() for k, _, v in (x.partition(":") for x in lines[1:])}
                self.raw, self.looked, self.begun = self.raw[cut + 4 :], 0, True
                self.left, self.n, self.sha = int(self.head.get("content-length", "-1")), 0, hashlib.sha1()
                if self.left < 0:
                    raise ValueError("a record has no length")
                self.http = self.head.get("content-type", "").lower().startswith("application/http")
            if self.http:  # up to the blank line that ends its headers
                cut = self.raw.find(b"\r\n\r\n", 0, self.left)
                gone = cut + 4 if cut >= 0 else max(0, len(self.raw) - 3) if len(self.raw) < self.left else self.left
                self.raw, self.left, self.http = self.raw[gone:], self.left - gone, cut < 0 and self.left > gone
                if self.http:
                    return None
            part = self.raw[: self.left]
            self.sha.update(part)
            self.n += len(part)
            self.left -= len(part)
            self.raw = self.raw[len(part) :]
            if self.left:
                return None
            yield from self.closed()
        if self.head is not None and not self.left:
            yield from self.closed()
        return None

    def closed(self):
        head, self.head = self.head, None
        yield head, self.n, base64.b32encode(self.sha.digest()).decode()

    def finish(self):
        """At the member's end nothing may be open."""
        if self.head is not None and self.left or self.raw or not self.begun:
            raise ValueError("its last record is cut short")
        return []


def read(archives: DataFrame, *, split_bytes: int = 4 << 20) -> DataFrame:
    """A row for each record of archives (archive, bytes).

    A revisit's payload size and digest are those that its header tells; archives
    of other writers may lack the size, which resolved() then looks up.
    """
    spark = archives.sparkSession
    ranges = archives.select("archive", "bytes", F.explode(F.expr(f"sequence(0L, greatest(bytes - 1, 0L), {split_bytes}L)")).alias("start"))
    ranges = ranges.repartition(common.partitions(spark), "archive", "start")

    def found(rows):
        kinds = [pa.string() if x.endswith("string") else pa.int64() for x in READ.split(", ")]
        return pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows, strict=True), kinds, strict=True)], names=[x.split()[0] for x in READ.split(", ")])

    def scan(batches):
        for b in batches:
            for path, size, start in zip(*(b.column(c).to_pylist() for c in ("archive", "bytes", "start")), strict=True):
                fs, name = common.open_fs(path)
                out = []
                with fs.open_input_file(name) as f:
                    for place, head, n, digest in Records(f, start, min(size, start + split_bytes), size):
                        kind, told = head.get("warc-type"), head.get("x-payload-bytes")
                        if kind == "revisit":
                            n = int(told) if told else None
                            digest = head["warc-payload-digest"].removeprefix("sha1:") if "warc-payload-digest" in head else None
                        own, ref = head.get("x-page-id"), head.get("x-refers-to-page-id")
                        out.append((path, place, int(own) if own else None, kind, int(ref) if ref else None, head.get("warc-target-uri"), n, digest, head.get("warc-record-id"), head.get("warc-refers-to")))
                        if len(out) == 10_000:
                            yield found(out)
                            out = []
                if out:
                    yield found(out)

    return ranges.mapInArrow(scan, READ)


def resolved(records: DataFrame) -> DataFrame:
    """records with missing payload sizes of revisits taken from the response of the same digest."""
    sizes = records.filter("record_type = 'response'").groupBy("payload_digest").agg(F.max("payload_bytes").alias("full"))
    return records.join(sizes, "payload_digest", "left").withColumn("payload_bytes", F.coalesce("payload_bytes", "full")).drop("full")


def op5_warc(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The contract's digest of `pages`."""
    archives = write(common.table(spark, sf_dir, "pages"), common.fresh_dir(spark, "warc"))
    return read(archives).select("page_id", "payload_bytes", "payload_digest", "record_type", "refers_to")
