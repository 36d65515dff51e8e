"""WARC archives: a de-duplicating writer and a salvage reader.

Writer: one record per row, each its own gzip member. The payload is the page's
bytes behind an HTTP header. Of equal payloads (by SHA-1) of at least
``min_revisit_bytes`` bytes, the row with the smallest id is written as a
response and the others as revisits, which carry the digest and the id they
refer to instead of the payload. The first id of each digest comes from a
grouped minimum over digests, so no group of copies is ever gathered.

Reader: walks members (or plain records), checking framing, CRC, lengths and
block digests. After a failed check it searches on for the next gzip member or
``WARC/`` version line that yields a valid record, returns what follows and
logs the bytes between as a quarantined gap. Inside a sound member of several
records it does the same; such a gap names the member and the bytes of its
content. Of a member that fails late, the records before the damage are returned
too. Archives are read through a sliding buffer in pieces of a megabyte; a stated
length is believed only if a record ends there, and a member is inflated
forward, each of its records returned as its end is confirmed and then
forgotten, so memory is bounded by the largest sound record whatever the size
of members and whatever the damage.

Defined cases: a null payload is an empty one; a null id is written as a
response without a page id if all equal payloads have null ids, else as a
revisit of the smallest id; rows that repeat the smallest id with the same
payload are responses too; a null URL is the empty string; an empty table
gives no archive; other columns are not read.
"""

from __future__ import annotations

import base64
import hashlib
import itertools
import re
import uuid
import zlib

import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .files import attempt_name, locate

VERSION = b"WARC/1.1"
MEMBER = b"\x1f\x8b\x08"
VERSION_LINE = re.compile(rb"WARC/\d\.\d\r\n")
CHUNK = 1 << 20


def base32_sha1(data: bytes) -> str:
    return base64.b32encode(hashlib.sha1(data).digest()).decode()


def record_bytes(headers: list[tuple[str, str]], block: bytes) -> bytes:
    """One uncompressed record; Content-Length and the block digest are added."""
    lines = [*headers, ("WARC-Block-Digest", f"sha1:{base32_sha1(block)}"), ("Content-Length", str(len(block)))]
    head = VERSION + b"\r\n" + "".join(f"{k}: {v}\r\n" for k, v in lines).encode() + b"\r\n"
    return head + block + b"\r\n\r\n"


def member(data: bytes) -> bytes:
    """``data`` as one gzip member."""
    z = zlib.compressobj(6, zlib.DEFLATED, 31)
    return z.compress(data) + z.flush()


def record_id(kind: str, page_id: int | None, url: str, payload: bytes) -> str:
    """The id of a page's record, the same in every run."""
    return f"<urn:uuid:{uuid.UUID(hashlib.sha1(f'{kind}{chr(10)}{page_id}{chr(10)}{url}'.encode() + payload).hexdigest()[:32])}>"


def page_record(page_id: int | None, url: str, payload: bytes, refers_to: int | None, date: str, refers_to_url: str = "") -> bytes:
    """A response record, or a revisit if ``refers_to`` is given."""
    http = f"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nContent-Length: {len(payload)}\r\n\r\n".encode()
    kind = "response" if refers_to is None else "revisit"
    headers = [
        ("WARC-Type", kind),
        ("WARC-Record-ID", record_id(kind, page_id, url, payload)),
        ("WARC-Date", date),
        ("WARC-Target-URI", re.sub(r"\s", "%20", url)),
        ("Content-Type", "application/http; msgtype=response"),
        ("WARC-Payload-Digest", f"sha1:{base32_sha1(payload)}"),
    ]
    if page_id is not None:
        headers.append(("X-Page-Id", str(page_id)))
    if refers_to is None:
        return record_bytes(headers, http + payload)
    headers += [("WARC-Profile", "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"), ("WARC-Refers-To", record_id("response", refers_to, refers_to_url, payload)), ("WARC-Refers-To-Target-URI", re.sub(r"\s", "%20", refers_to_url)), ("X-Refers-To-Page-Id", str(refers_to))]
    return record_bytes(headers, http)


MANIFEST = "path string, records long, bytes long"


def write_warc(pages: DataFrame, out_uri: str, *, id_col: str = "page_id", url_col: str = "url", payload_col: str = "html", min_revisit_bytes: int = 0, file_bytes: int = 64 << 20, date: str = "2024-01-01T00:00:00Z") -> DataFrame:
    """Write archives; returns the lazy manifest, one row per file.

    Only payloads that occur more than once meet the join, whose small side is
    the table of repeated digests; adaptive execution splits a hot digest.
    """
    payload = F.coalesce(F.col(payload_col).cast("binary"), F.lit(b""))
    rows = pages.select(F.col(id_col).cast("long").alias("id"), F.coalesce(F.col(url_col), F.lit("")).alias("url"), payload.alias("payload"), F.sha1(payload).alias("sha"))
    keyed = pages.select(F.col(id_col).cast("long").alias("id"), F.coalesce(F.col(url_col), F.lit("")).alias("url"), F.sha1(payload).alias("sha"))
    least = F.min(F.when(F.col("id").isNotNull(), F.struct("id", "url")))
    repeated = keyed.groupBy("sha").agg(least.alias("first"), F.count(F.lit(1)).alias("n")).filter("n > 1").select("sha", "first")
    revisit = (F.length("payload") >= min_revisit_bytes) & ~F.col("id").eqNullSafe(F.col("first.id"))
    rows = rows.join(repeated, "sha", "left").select("id", "url", "payload", F.when(revisit, F.col("first.id")).alias("refers_to"), F.when(revisit, F.col("first.url")).alias("refers_url"))

    def run(batches):
        task, seq, out, uri, records, size = TaskContext.get().partitionId(), 0, None, "", 0, 0

        def close():
            out.close()
            return pa.RecordBatch.from_pydict({"path": [uri], "records": [records], "bytes": [size]})

        for batch in batches:
            ids, urls, refs, ref_urls = (batch.column(i).to_pylist() for i in (0, 1, 3, 4))
            for i in range(batch.num_rows):
                if out is None:
                    uri = f"{out_uri}/{attempt_name(f'pages-{task:06d}-{seq:05d}', '.warc.gz')}"
                    store, path = locate(uri)
                    out, records, size, seq = store.open_output_stream(path, compression=None), 0, 0, seq + 1
                    info = member(record_bytes([("WARC-Type", "warcinfo"), ("WARC-Record-ID", f"<urn:uuid:{uuid.uuid5(uuid.NAMESPACE_URL, f'{task}/{seq}')}>"), ("WARC-Date", date), ("Content-Type", "application/warc-fields")], b"format: WARC File Format 1.1\r\n"))
                    out.write(info)
                    size += len(info)
                data = member(page_record(ids[i], urls[i], batch.column(2)[i].as_py(), refs[i], date, ref_urls[i] or ""))
                out.write(data)
                records, size = records + 1, size + len(data)
                if size >= file_bytes:
                    yield close()
                    out = None
        if out is not None:
            yield close()

    return rows.mapInArrow(run, MANIFEST)


class Window:
    """The bytes of a file from ``start`` on, read as they are asked for."""

    def __init__(self, source, size: int):
        self.source, self.size, self.start, self.data = source, size, 0, bytearray()

    def upto(self, end: int) -> int:
        """Hold the bytes before ``end``; returns the first position not held."""
        have = self.start + len(self.data)
        if end > have and have < self.size:
            self.source.seek(have)
            self.data += self.source.read(min(self.size, max(end, have + CHUNK)) - have)
        return self.start + len(self.data)

    def forget(self, position: int) -> None:
        if (n := position - self.start) > CHUNK:
            del self.data[:n]
            self.start = position

    def direct(self, begin: int, end: int) -> bytes:
        """Bytes that are not held afterwards."""
        if self.start <= begin and end <= self.start + len(self.data):
            return bytes(self.data[begin - self.start : end - self.start])
        self.source.seek(begin)
        return self.source.read(max(0, min(self.size, end) - begin))

    def piece(self, begin: int, end: int) -> bytes:
        self.upto(end)
        return bytes(self.data[begin - self.start : end - self.start])


class Damaged(Exception):
    """A check of a record failed."""


def parse_header(data: bytes, at: int = 0) -> tuple[dict[str, str], int, int]:
    """Headers of the record that begins at ``at``, the place of its block and the length they state."""
    if not VERSION_LINE.match(data, at):
        raise Damaged("no version line")
    end = data.find(b"\r\n\r\n", at)
    if end < 0:
        raise Damaged("no end of header")
    headers = {}
    for line in data[at : end + 2].split(b"\r\n")[1:-1]:
        name, colon, value = line.partition(b":")
        if not colon:
            raise Damaged("bad header line")
        headers[name.decode(errors="replace").strip().lower()] = value.decode(errors="replace").strip()
    if not headers.get("content-length", "").isdigit():
        raise Damaged("bad content length")
    return headers, end + 4, int(headers["content-length"])


class Content:
    """The inflated bytes of the gzip member at ``at``, read forward and forgotten behind.

    ``ended`` is set at the member's end or where it cannot be read on, which
    ``reason`` then explains; ``position`` is where in the file that is.
    """

    def __init__(self, window: Window, at: int):
        self.window, self.at, self.position = window, at, at
        self.z, self.tail = zlib.decompressobj(31), b""
        self.data, self.start = bytearray(), 0
        self.ended, self.reason = False, ""

    @property
    def end(self) -> int:
        return self.start + len(self.data)

    def fork(self) -> Content:
        """Reads on from the end of what is held, without holding it."""
        other = Content(self.window, self.at)
        other.position, other.z, other.tail, other.start = self.position, self.z.copy(), self.tail, self.end
        other.ended, other.reason = self.ended, self.reason
        return other

    def fetch(self) -> bytes:
        p, w = self.position, self.window
        if w.start <= p and p + (1 << 16) <= self.at + CHUNK:
            return w.piece(p, min(w.upto(p + (1 << 16)), p + (1 << 16)))
        return w.direct(p, p + (1 << 16))

    def inflate(self) -> bytes:
        """The next piece, of at most CHUNK bytes; of a piece that fails, what is sound before the error."""
        while not self.ended:
            if not self.tail:
                self.tail = self.fetch()
                self.position += len(self.tail)
                if not self.tail:
                    self.ended, self.reason = True, "member cut short"
                    break
            before = self.z.copy()
            try:
                out = self.z.decompress(self.tail, CHUNK)
            except zlib.error as e:
                self.ended, self.reason, sound = True, f"member: {e}", []
                for k in range(len(self.tail)):
                    try:
                        sound.append(before.decompress(self.tail[k : k + 1]))
                    except zlib.error:
                        break
                return b"".join(sound)
            self.tail = self.z.unconsumed_tail
            if self.z.eof:
                self.ended = True
                self.position -= len(self.z.unused_data)
            if out:
                return out
        return b""

    def upto(self, n: int) -> int:
        """Hold the bytes before ``n``; returns the first that is not there."""
        while self.end < n and not self.ended:
            self.data += self.inflate()
        return self.end

    def forget(self, to: int) -> None:
        if to - self.start > CHUNK:
            del self.data[: to - self.start]
            self.start = to

    def held(self, begin: int, end: int) -> bytes:
        return bytes(self.data[begin - self.start : end - self.start])

    def pieces(self, begin: int, end: int):
        """The bytes from ``begin`` on, without holding more of them."""
        yield self.held(begin, min(end, self.end))
        ahead = self.fork()
        while ahead.start < end and not ahead.ended:
            piece = ahead.inflate()
            yield piece[max(0, begin - ahead.start) : end - ahead.start]
            ahead.start += len(piece)

    def record(self, at: int) -> tuple[dict[str, str], bytes, int]:
        """Headers, block and end of the record at ``at``. A long block is checked before it is held."""
        want = 1 << 14
        while True:
            self.upto(at + want)
            head = self.held(at, at + want)
            if b"\r\n\r\n" in head or want >= CHUNK or len(head) < want or not VERSION_LINE.match(head):
                break
            want *= 4
        headers, begin, length = parse_header(head)
        begin, stop = at + begin, at + begin + length
        said = headers.get("warc-block-digest", "")
        said = said[5:] if said.startswith("sha1:") else None
        if length > CHUNK:
            digest, seen, last = hashlib.sha1(), 0, b""
            for piece in self.pieces(begin, stop + 4):
                digest.update(piece[: max(0, length - seen)])
                last += piece[max(0, length - seen) :]
                seen += len(piece)
            self._require(seen >= length, last == b"\r\n\r\n", said is None or said == base64.b32encode(digest.digest()).decode())
        whole = self.upto(stop + 4) >= stop
        block = self.held(begin, stop) if whole else b""
        self._require(whole, self.held(stop, stop + 4) == b"\r\n\r\n", said is None or said == base32_sha1(block))
        return headers, block, stop + 4

    @staticmethod
    def _require(whole: bool, closed: bool, same: bool) -> None:
        for holds, reason in ((whole, "block cut short"), (closed, "no end of record"), (same, "block digest differs")):
            if not holds:
                raise Damaged(reason)

    def next_line(self, position: int) -> int:
        """Where the next version line begins, or the end."""
        while True:
            if line := VERSION_LINE.search(self.data, max(0, position - self.start)):
                return self.start + line.start()
            if self.ended:
                return self.end
            position = max(position, self.end - 16)
            self.forget(position)
            self.upto(self.end + 1)

    def records(self):
        """("record", headers, block) of what is valid, one at a time, and ("lost", begin, end, reason) of the bytes between."""
        at, gap, reason = 0, None, ""
        while self.upto(at + 1) > at:
            try:
                headers, block, end = self.record(at)
            except Damaged as e:
                if gap is None:
                    gap, reason = at, str(e)
                at = self.next_line(at + 1)
                self.forget(at)
                continue
            if gap is not None:
                yield "lost", gap, at, reason
                gap = None
            yield "record", headers, block
            at = end
            self.forget(at)
        if gap is not None:
            yield "lost", gap, self.end, reason


def measure(window: Window, at: int) -> tuple[Content, int, str]:
    """The content of the member at ``at``, to be read from its beginning, where the member ends, and why if not soundly."""
    content = Content(window, at)
    content.upto(4 * CHUNK)
    whole = content if content.ended else content.fork()
    while not whole.ended:
        whole.inflate()
    return content, whole.position, whole.reason


def from_first_record(items) -> tuple[list, list]:
    """What is lost before the first record, and that record in a list; empty if there is none."""
    lost = []
    for item in items:
        if item[0] == "record":
            return lost, [item]
        lost.append(item)
    return lost, []


def plain_at(window: Window, at: int) -> tuple[tuple[dict[str, str], bytes], int]:
    """The uncompressed record at ``at`` and its end.

    The length that its header states is not trusted: the end of the record has
    to be where it says, and a block of more than CHUNK bytes is digested in
    pieces before it is held.
    """
    want, data = 1 << 12, b""
    while b"\r\n\r\n" not in data and len(data) < min(CHUNK, window.size - at):
        want *= 4
        data = window.piece(at, min(window.size, at + want))
        if not VERSION_LINE.match(data):
            break
    headers, begin, length = parse_header(data)
    stop = at + begin + length
    if stop > window.size:
        raise Damaged("block cut short")
    if window.direct(stop, stop + 4) != b"\r\n\r\n":
        raise Damaged("no end of record")
    spots = [*range(at + begin, stop, CHUNK), stop]
    pieces = list(zip(spots, spots[1:], strict=False))
    said = headers.get("warc-block-digest", "")
    if length > CHUNK and said.startswith("sha1:"):
        digest = hashlib.sha1()
        for x, y in pieces:
            digest.update(window.direct(x, y))
        if said[5:] != base64.b32encode(digest.digest()).decode():
            raise Damaged("block digest differs")
    block = b"".join(window.piece(x, y) if y <= at + CHUNK else window.direct(x, y) for x, y in pieces)
    if said.startswith("sha1:") and said[5:] != base32_sha1(block):
        raise Damaged("block digest differs")
    return (headers, block), stop + 4


def salvage(source, size: int):
    """Yields ("record", offset, end, headers, block) and ("gap", offset, end, reason, None)."""
    window, at, gap, reason = Window(source, size), 0, None, ""

    def next_start(position: int) -> int:
        """The next place after ``position`` where a member or record may begin."""
        while position < size:
            window.forget(position)
            have = window.upto(position + CHUNK)
            line = VERSION_LINE.search(window.data, position - window.start)
            places = (window.data.find(MEMBER, position - window.start), line.start() if line else -1)
            if found := [x for x in places if x >= 0]:
                return window.start + min(found)
            if have >= size:
                return size
            position = have - 16
        return size

    while at < size:
        window.upto(at + 16)
        items, lost, first, why = iter(()), [], [], ""
        if window.piece(at, min(size, at + 3)) == MEMBER:
            content, end, why = measure(window, at)
            items = content.records()
            lost, first = from_first_record(items)
            if lost and not first and not why:
                why = lost[0][3]
        else:
            try:
                (headers, block), end = plain_at(window, at)
                first = [("record", headers, block)]
            except Damaged as e:
                why = str(e)
        if gap is not None and (first or not why):
            yield "gap", gap, at, reason, None
            gap = None
        begin = at
        if why:
            if gap is None:
                gap, reason = at, why
            at = end = next_start(at + 1)
        for item in itertools.chain(first, items):
            if item[0] == "record":
                yield "record", begin, end, item[1], item[2]
            else:
                lost.append(item)
        if not why:  # of a damaged member, its gap has them
            for _, x, y, said in lost:
                yield "gap", begin, end, f"bytes {x}-{y} of the member's content: {said}", None
            at = end
        window.forget(at)
    if gap is not None:
        yield "gap", gap, size, reason, None


RECORDS = "path string, offset long, length long, kind string, page_id long, refers_to long, uri string, payload_bytes long, payload_digest string, payload binary, reason string"


def read_warc(files: DataFrame, *, with_payload: bool = True) -> DataFrame:
    """Records and gaps of the archives named in ``files.path``.

    ``kind`` is the WARC type, or "gap" for quarantined bytes, with ``reason``.
    ``payload_bytes`` and ``payload_digest`` are of the full payload, for
    revisits as the record states them; responses are checked against theirs.
    """

    def run(batches):
        for batch in batches:
            for path in batch.column(0).to_pylist():
                store, inner = locate(path)
                source = store.open_input_file(inner)
                rows, held = [], 0
                for what, begin, end, headers, block in salvage(source, source.size()):
                    if what == "gap":
                        rows.append((path, begin, end - begin, "gap", None, None, None, None, None, None, headers))
                    else:
                        kind, digest = headers.get("warc-type", ""), headers.get("warc-payload-digest", "").removeprefix("sha1:") or None
                        head, _, payload = block.partition(b"\r\n\r\n") if headers.get("content-type", "").startswith("application/http") else (b"", b"", block)
                        n, reason = len(payload), None
                        if kind == "revisit":
                            stated = re.search(rb"\r\ncontent-length:\s*(\d+)", head, re.I)
                            n, payload = (int(stated[1]) if stated else None), None
                        elif digest and digest != base32_sha1(payload):
                            reason = "payload digest differs"
                        page, refers = headers.get("x-page-id"), headers.get("x-refers-to-page-id")
                        rows.append((path, begin, end - begin, kind, page and int(page), refers and int(refers), headers.get("warc-target-uri"), n, digest, payload if with_payload else None, reason))
                        held += len(block) if with_payload else 200
                    if held > 8 << 20:
                        yield _batch(rows)
                        rows, held = [], 0
                source.close()
                if rows:
                    yield _batch(rows)

    return files.select("path").mapInArrow(run, RECORDS)


def _batch(rows: list[tuple]) -> pa.RecordBatch:
    kinds = [pa.string(), pa.int64(), pa.int64(), pa.string(), pa.int64(), pa.int64(), pa.string(), pa.int64(), pa.string(), pa.binary(), pa.string()]
    names = [x.split()[0] for x in RECORDS.split(", ")]
    return pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows, strict=True), kinds, strict=True)], names)


def list_archives(spark: SparkSession, folder: str) -> DataFrame:
    """Paths of the archives in a folder, listed by Spark."""
    return spark.read.format("binaryFile").option("pathGlobFilter", "*.warc*").load(folder).select("path")
