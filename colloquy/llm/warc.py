"""WARC archives: write one gzip member per record, read them back, salvage what damage leaves."""
import base64
import hashlib
import re
import uuid
import zlib
from collections.abc import Callable, Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, functions as F

from colloquy.operators.scale import shared_dir

#: Payloads below this many bytes are never revisits.
LEAST_SHARED = 100
#: Records of an archive file; a reader's task holds one file.
FILE_RECORDS = 4000
DATE = "1970-01-01T00:00:00Z"
MAGIC, VERSION = b"\x1f\x8b\x08", b"WARC/1."
HEAD = re.compile(rb"WARC/1\.[0-9]+\r\n(?:[^\s:][^:\r\n]*:[^\r\n]*\r\n(?:[ \t][^\r\n]*\r\n)*+)++\r\n")
#: Digits of a length that can be one of a file.
LENGTH = re.compile("[0-9]{1,18}", re.ASCII)
DIGESTS = ("md5", "sha1", "sha224", "sha256", "sha384", "sha512")
#: Compressed bytes that a member is fed at a time.
PIECE = 65536
PROFILE = "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"
SCHEMA = ("kind string, file string, offset long, length long, record_type string, record_id string, uri string, "
          "refers_to string, payload_bytes long, payload_digest string, payload binary, inner_offset long, inner_length long")


def member(data: bytes) -> bytes:
    packer = zlib.compressobj(6, zlib.DEFLATED, 31)
    return packer.compress(data) + packer.flush()


def record(record_id: str, uri: str, kind: str, payload: bytes, size: int, digest: str, refers_to: str | None) -> bytes:
    """One WARC record. A revisit keeps the HTTP head, with the full payload's length, and no payload."""
    uri = "".join(c if c > " " else f"%{ord(c):02X}" for c in uri)
    http = f"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nContent-Length: {size}\r\n\r\n".encode()
    block = http + (payload if kind == "response" else b"")
    head = [f"WARC/1.1\r\nWARC-Type: {kind}", f"WARC-Record-ID: <{record_id}>", f"WARC-Date: {DATE}", f"WARC-Target-URI: {uri}",
            f"WARC-Payload-Digest: sha256:{digest}", f"WARC-Block-Digest: sha256:{hashlib.sha256(block).hexdigest()}",
            "Content-Type: application/http;msgtype=response", f"Content-Length: {len(block)}"]
    if refers_to is not None:
        head += [f"WARC-Refers-To: <{refers_to}>", f"WARC-Profile: {PROFILE}"]
    return "\r\n".join(head).encode() + b"\r\n\r\n" + block + b"\r\n\r\n"


def decided(pages: DataFrame, page_id: str, url: str, html: str) -> DataFrame:
    """Each page as a record to write: of equal payloads of at least 100 bytes the smallest id is the response."""
    text = F.coalesce(F.col(html), F.lit(""))
    d = pages.select(F.col(page_id).cast("long").alias("page_id"), F.col(url).cast("string").alias("url"), text.alias("html"),
                     F.octet_length(text).cast("long").alias("size"), F.sha2(text, 256).alias("digest"))
    firsts = (d.where(F.col("size") >= LEAST_SHARED).groupBy("digest").agg(F.min("page_id").alias("first"))
              .where("first is not null"))
    again = F.col("first").isNotNull() & ~F.col("page_id").eqNullSafe(F.col("first"))
    return (d.join(firsts, "digest", "left")
            .select("page_id", "url", F.when(~again, F.col("html")).alias("html"), "size", "digest",
                    F.when(again, "revisit").otherwise("response").alias("kind"), F.when(again, F.col("first")).alias("refers_to")))


def _members(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    name = lambda n: None if n is None else f"urn:page:{n}"
    for batch in batches:
        html = batch.column("html").cast(pa.binary())
        rest = batch.drop_columns(["html"]).to_pylist()
        for i, r in enumerate(rest):
            data = record(name(r["page_id"]) or "urn:page:none", r["url"] or "", r["kind"], html[i].as_py() or b"", r["size"],
                          r["digest"], name(r["refers_to"]))
            yield pa.RecordBatch.from_pydict({"value": pa.array([member(data)], pa.binary())})


def write_archives(pages: DataFrame, page_id: str, url: str, html: str, path: str | None = None) -> str:
    """Write a record per page to gzip archives in a folder that all executors share; returns the folder.

    Spark's text writer takes the members as they are; its row separator is an empty gzip member, which readers
    of concatenated members pass over. Null pages have empty payloads, a null url is an empty one, and a null id is
    written as "none". Repeated rows of the smallest id are all responses. An empty table writes no record.
    """
    spark = pages.sparkSession
    path = path or f"{shared_dir(spark)}/warc-{uuid.uuid4().hex}"
    rows = decided(pages, page_id, url, html).mapInArrow(_members, "value binary")
    (rows.select(F.col("value").cast("string").alias("value")).write.option("encoding", "ISO-8859-1")
     .option("lineSep", member(b"").decode("latin-1")).option("maxRecordsPerFile", FILE_RECORDS).text(path))
    return path


def _fields(head: bytes) -> dict[str, str]:
    unfolded = re.sub(rb"\r\n[ \t]+", b" ", head)
    pairs = (line.split(b":", 1) for line in unfolded.split(b"\r\n")[1:])
    return {p[0].strip().lower().decode("latin-1"): p[1].strip().decode("utf-8", "replace") for p in pairs if len(p) == 2}


def _length(said: str) -> int | None:
    return int(said) if LENGTH.fullmatch(said) else None


def _agrees(said: str, body: bytes) -> bool | None:
    """Whether a labelled digest (hex or base32) is that of `body`; None if there is none or its kind is not known."""
    kind, _, value = said.partition(":")
    kind, value = kind.strip().lower().replace("-", ""), value.strip().rstrip("=")
    if kind not in DIGESTS:
        return None
    digest = hashlib.new(kind, body).digest()
    if len(value) == 2 * len(digest):
        return value.lower() == digest.hex()
    if len(value) == -(-8 * len(digest) // 5):
        return value.upper() == base64.b32encode(digest).decode().rstrip("=")
    return None


def _plain(data: bytes, at: int, strict: bool = False) -> tuple[dict, int] | None:
    """The record that starts at `at` and its end, or None if any check fails. `strict` asks for a block digest that agrees."""
    if not (head := HEAD.match(data, at)):
        return None
    fields = _fields(head.group()[:-4])
    size = _length(fields.get("content-length", ""))
    if size is None or "warc-type" not in fields:
        return None
    start, end = head.end(), head.end() + size
    if data[end:end + 4] != b"\r\n\r\n":
        return None
    block = bytes(data[start:end])
    agrees = _agrees(fields.get("warc-block-digest", ""), block)
    if agrees is False or (strict and not agrees):
        return None
    kind, digest = fields["warc-type"], fields.get("warc-payload-digest", "")
    payload, web = block, {}
    if kind in ("response", "revisit") and block.startswith(b"HTTP/"):
        http, _, payload = block.partition(b"\r\n\r\n")
        web = _fields(http)
    # a digest of an encoded transfer may be of what was decoded
    if kind == "response" and "transfer-encoding" not in web and _agrees(digest, payload) is False:
        return None
    length = _length(web.get("content-length", "")) if kind == "revisit" else len(payload)
    if digest.lower().startswith("sha256:"):
        digest = digest[7:].lower()
    strip = lambda k: fields[k].strip("<>") if k in fields else None
    return {"kind": "record", "record_type": kind, "record_id": strip("warc-record-id"), "uri": strip("warc-target-uri"),
            "refers_to": strip("warc-refers-to"), "payload_bytes": length, "payload_digest": digest or None,
            "payload": None if kind == "revisit" else payload}, end + 4


def _unpacked(data: memoryview, at: int) -> tuple[bytes, int | None]:
    """A gzip member's content and end; if it is damaged or cut off, what comes out before the damage, and None.

    Fed in pieces, so nothing is copied twice; the piece with the damage is fed again byte by byte.
    """
    unpacker, out, pos = zlib.decompressobj(31), [], at
    while not unpacker.eof and pos < len(data):
        piece, before = data[pos:pos + PIECE], unpacker.copy()
        try:
            out.append(unpacker.decompress(piece))
        except zlib.error:
            try:
                for i in range(len(piece)):
                    out.append(before.decompress(piece[i:i + 1]))
            except zlib.error:
                pass
            return b"".join(out), None
        pos += len(piece)
    return b"".join(out), pos - len(unpacker.unused_data) if unpacker.eof else None


def _searched(data: bytes, starts: tuple[bytes, ...], read: Callable[[int], tuple[list[dict], int | None]]) -> Iterator[dict]:
    """What `read` finds along the data, with a row for every gap. Where it gives no end, go on at the next of `starts`.

    The next place of each start is remembered, so the search reads the data once, however many false starts there are.
    """
    at, bad, ahead = 0, None, dict.fromkeys(starts, -1)
    while at < len(data):
        rows, end = read(at)
        if end is None:
            bad = at if bad is None else bad
            yield from rows
            for start in starts:
                if ahead[start] <= at:
                    found = data.find(start, at + 1)
                    ahead[start] = found if found >= 0 else len(data)
            at = min(ahead.values())
            continue
        if bad is not None:
            yield {"kind": "gap", "offset": bad, "length": at - bad}
            bad = None
        yield from rows
        at = end
    if bad is not None:
        yield {"kind": "gap", "offset": bad, "length": len(data) - bad}


def _records(data: bytes, strict: bool = False) -> Iterator[dict]:
    """Records and gaps of plain bytes."""
    def read(at: int) -> tuple[list[dict], int | None]:
        if (one := _plain(data, at, strict)) is None:
            return [], None
        return [one[0] | {"offset": at, "length": one[1] - at}], one[1]

    return _searched(data, (VERSION,), read)


def salvaged(data: bytes) -> Iterator[dict]:
    """Records and gaps of an archive's bytes, in order.

    Gzip members and plain records may mix, and a member may hold many records. Where a check fails (CRC, header, length, block or
    payload digest), the reader looks for the next member or version line at which a whole record passes all checks; the bytes between
    are one gap. Inside a member it looks for the next version line in the unpacked bytes: such rows have the member's offset and length,
    and their own place in its content as inner_offset and inner_length. A member that is damaged or cut off is a gap, but records that
    came out before the damage are kept if their block digest agrees. Digests of unknown kinds are passed over, not failed.
    """
    view = memoryview(data)

    def read(at: int) -> tuple[list[dict], int | None]:
        if data.startswith(MAGIC, at):
            content, end = _unpacked(view, at)
            place = {"offset": at, "length": (end or at) - at}
            inner = [r | {"inner_offset": r["offset"], "inner_length": r["length"]} | place for r in _records(content, end is None)]
            return inner if end is not None else [r for r in inner if r["kind"] == "record"], end
        if (one := _plain(data, at)) is None:
            return [], None
        return [one[0] | {"offset": at, "length": one[1] - at}], one[1]

    return _searched(data, (MAGIC, VERSION), read)


def read_archives(spark: SparkSession, path: str, *, payloads: bool = True) -> DataFrame:
    """All records of a folder's archives, and a row of kind "gap" for every quarantined stretch of bytes.

    A task holds one file and one record of it. Without `payloads` that column is null. A folder without files
    or with empty files gives no rows.
    """
    names = [f.split(" ")[0] for f in SCHEMA.split(", ")]
    types = {"payload": pa.binary(), "offset": pa.int64(), "length": pa.int64(), "payload_bytes": pa.int64(),
             "inner_offset": pa.int64(), "inner_length": pa.int64()}

    def read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for i in range(batch.num_rows):
                file, rows, held = batch.column("path")[i].as_py(), [], 0
                for row in salvaged(batch.column("content")[i].as_py()):
                    held += row.get("payload_bytes") or 0 if payloads else 100
                    rows.append(row | {"file": file} | ({} if payloads else {"payload": None}))
                    if held > 1 << 22:
                        yield pa.RecordBatch.from_pydict({n: pa.array([r.get(n) for r in rows], types.get(n, pa.string())) for n in names})
                        rows, held = [], 0
                yield pa.RecordBatch.from_pydict({n: pa.array([r.get(n) for r in rows], types.get(n, pa.string())) for n in names})

    files = spark.read.format("binaryFile").option("pathGlobFilter", "[!_.]*").load(path)
    return files.select("path", "content").mapInArrow(read, SCHEMA)
