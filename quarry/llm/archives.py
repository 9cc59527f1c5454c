"""Legacy ARC archives converted to WARC.

An ARC file starts with a version block whose header line and field list say
how later header lines are built: version 1 has ``URL IP date type length``,
version 2 adds ``result checksum location offset filename`` before the length.
A record is a header line, exactly the declared number of bytes, and a line
break.  The converter reads header lines by the version's fields and bodies by
their declared lengths (never by searching for separators) and makes for each
record a WARC record with

* a ``WARC-Record-ID`` made by rule from the record's place and digest,
* the 14-digit date as ``WARC-Date``, and the HTTP or resource content type,
* SHA-1 digests of block and payload,
* type ``response``, or ``revisit`` when an equal payload of at least
  ``least`` bytes is held by a record with a larger page number; a revisit keeps
  the HTTP header and names the record it refers to.

The archives written here begin with a version block and are dealt to both
versions unless one is asked for, so the reader meets both header formats.

Archives are whole files written by Spark's text writer (the record separator
is the line separator), gzip-compressed, so lost executors only repeat their
tasks; they are read back whole, one bounded archive per row, and parsed as a
stream.

Edge cases: a null payload is empty; a null or odd URL is percent-encoded (null
as ``about:blank``); a null page number is written as an empty field and read
back as null, loses against any number, and among themselves the records with
null stay responses; repeated rows make a record each (of records with the same
page number the first place is the response); other columns are ignored; an
empty table makes empty archives and no row.
"""

from __future__ import annotations

import base64
import hashlib
import re
import zlib
from collections.abc import Iterable, Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quarry.session import _app_folder, ensure_checkpoint_dir, materialize

# Fixed values of the two formats.
ARC_FIELDS = {1: "URL IP-address Archive-date Content-type Archive-length",
              2: "URL IP-address Archive-date Content-type Result-code Checksum Location Offset Filename Archive-length"}
REVISIT = "http://netpreserve.org/warc/1.0/revisit/identical-payload-digest"
LEAST = 1000
ARCHIVE_BYTES = 24_000_000
DATE = "20200102030405"
_READ = 1 << 20


def _folder(df: DataFrame, name: str) -> str:
    import uuid

    root = ensure_checkpoint_dir(df.sparkSession).rstrip("/")
    return f"{_app_folder(df.sparkSession, root)}/{name}-{uuid.uuid4().hex}"


# ---- ARC -----------------------------------------------------------------

def version_block(version: int) -> str:
    """The record at the head of an ARC file, without the line break behind it."""
    names = f"{version} 0 quarry\n{ARC_FIELDS[version]}\n"
    middle = {1: "", 2: "200 - - 0 pages.arc "}[version]
    return f"filedesc://pages.arc 0.0.0.0 {DATE} text/plain {middle}{len(names)}\n{names}"


def write_arc(pages: DataFrame, path: str, version: int | None = None, id_col: str = "page_id", url_col: str = "url",
              html_col: str = "html") -> None:
    """Pages as ARC files of about ``ARCHIVE_BYTES`` each, the way old crawlers
    stored them: a version block, then an HTTP response per record.  Without a
    ``version`` the archives are dealt to versions 1 and 2, two at least."""
    body = F.coalesce(F.col(f"`{html_col}`"), F.lit(""))
    url = F.coalesce(F.url_encode(F.col(f"`{url_col}`")), F.lit("about:blank"))
    for quoted, plain in (("%3A", ":"), ("%2F", "/"), ("%3F", "?"), ("%3D", "="), ("%26", "&"), ("%23", "#")):
        url = F.replace(url, F.lit(quoted), F.lit(plain))
    page = F.coalesce(F.col(f"`{id_col}`").cast("string"), F.lit(""))
    http = F.concat(F.lit("HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=UTF-8\r\nX-Page-Id: "), page,
                    F.lit("\r\nContent-Length: "), F.octet_length(body).cast("string"), F.lit("\r\n\r\n"))
    size = (F.octet_length(http) + F.octet_length(body)).cast("string")
    middle = {1: F.lit(f" 192.0.2.1 {DATE} text/html "), 2: F.lit(f" 192.0.2.1 {DATE} text/html 200 - - 0 pages.arc ")}
    form = middle[version] if version else F.when(F.col("_v") == 1, middle[1]).otherwise(middle[2])
    total = pages.agg(F.sum(F.octet_length(body) + 200)).first()[0] or 0
    files = int(max(1 if version else 2, -(-total // ARCHIVE_BYTES)))
    rows = pages.select(F.struct(url.alias("url"), size.alias("size"), http.alias("http"), body.alias("body")).alias("r")).repartition(files)
    rows = rows.withColumn("_v", F.spark_partition_id() % 2 + 1)
    # the version block stands before the first record of a file
    first = F.monotonically_increasing_id().bitwiseAND(F.lit((1 << 33) - 1)) == 0
    block = {v: F.lit(version_block(v) + "\n") for v in (1, 2)}
    head = F.when(F.col("_v") == 1, block[1]).otherwise(block[2]) if version is None else block[version]
    rows = rows.select(F.concat(F.when(first, head).otherwise(""), "r.url", form, "r.size", F.lit("\n"), "r.http", "r.body").alias("value"))
    rows.write.option("lineSep", "\n").option("compression", "gzip").text(path)


def _stream(chunks: Iterable[bytes]) -> Iterator[bytes]:
    """Plain bytes of a (possibly multi-member) gzip stream."""
    first, inflate = True, None
    for raw in chunks:
        if first and raw[:2] == b"\x1f\x8b":
            inflate = zlib.decompressobj(31)
        first = False
        if inflate is None:
            yield raw
            continue
        while raw:
            out = inflate.decompress(raw)
            if out:
                yield out
            raw = inflate.unused_data
            if inflate.eof:
                inflate = zlib.decompressobj(31)
            else:
                break


class Reader:
    """Lines and exact byte counts from a stream of chunks."""

    def __init__(self, content: bytes):
        self.src = _stream(content[i:i + _READ] for i in range(0, len(content), _READ))
        self.buf = bytearray()

    def _more(self) -> bool:
        got = next(self.src, None)
        if got is None:
            return False
        self.buf += got
        return True

    def line(self) -> bytes | None:
        seen = 0
        while (at := self.buf.find(b"\n", seen)) < 0:
            seen = len(self.buf)
            if not self._more():
                if not self.buf:
                    return None
                at = len(self.buf)
                break
        out = bytes(self.buf[:at])
        del self.buf[:at + 1]
        return out.rstrip(b"\r")

    def take(self, n: int) -> bytes:
        while len(self.buf) < n and self._more():
            pass
        if len(self.buf) < n:
            raise ValueError("archive ends inside a record")
        out = bytes(self.buf[:n])
        del self.buf[:n]
        return out


def arc_records(content: bytes, version: int = 1) -> Iterator[tuple[dict, bytes]]:
    """(header fields, body) of every record of one ARC file.  A version block
    (``filedesc:``) sets the fields of the lines after it."""
    r = Reader(content)
    fields = ARC_FIELDS[version].split()
    while (line := r.line()) is not None:
        if not line:
            continue
        values = line.decode("utf-8", "replace").split(" ")
        if line.startswith(b"filedesc:"):
            names = r.take(int(values[-1])).decode("utf-8", "replace").split("\n")
            number = int(re.match(r"\s*(\d+)", names[0]).group(1))
            fields = names[1].split() if len(names) > 1 and names[1].strip() else ARC_FIELDS[number].split()
            continue
        if len(values) < len(fields):
            raise ValueError(f"bad ARC header line: {line[:80]!r}")
        # a URL may hold spaces: the fixed fields are counted from the end
        extra = len(values) - len(fields) + 1
        head = dict(zip(fields, [" ".join(values[:extra]), *values[extra:]]))
        yield head, r.take(int(head["Archive-length"]))


def http_parts(body: bytes) -> tuple[bytes, dict, bytes]:
    """(header block with its blank line, header fields, payload)."""
    if not body.startswith(b"HTTP/"):
        return b"", {}, body
    end = body.find(b"\r\n\r\n")
    end = len(body) if end < 0 else end + 4
    head = {}
    for line in body[:end].split(b"\r\n")[1:]:
        k, _, v = line.partition(b":")
        if v or k:
            head[k.decode("latin-1").strip().lower()] = v.decode("latin-1").strip()
    return body[:end], head, body[end:]


# ---- WARC ----------------------------------------------------------------

def record_id(page: str, digest: str, place: str) -> str:
    h = hashlib.sha1(f"{page}|{digest}|{place}".encode()).hexdigest()
    return f"urn:uuid:{h[:8]}-{h[8:12]}-5{h[13:16]}-8{h[17:20]}-{h[20:32]}"


def _b32(hex_digest: str) -> str:
    return base64.b32encode(bytes.fromhex(hex_digest)).decode()


def warc_record(head: dict, body: bytes, rid: str, refers: str | None) -> bytes:
    """A WARC record without the two line breaks behind it."""
    d = re.sub(r"\D", "", head["Archive-date"]).ljust(14, "0")[:14]
    http, _, payload = http_parts(body)
    block = http if refers else body
    kind = "revisit" if refers else ("response" if http else "resource")
    lines = ["WARC/1.0", f"WARC-Type: {kind}", f"WARC-Target-URI: {head['URL']}",
             f"WARC-Date: {d[:4]}-{d[4:6]}-{d[6:8]}T{d[8:10]}:{d[10:12]}:{d[12:]}Z",
             f"WARC-Record-ID: <{rid}>", f"WARC-IP-Address: {head['IP-address']}",
             f"WARC-Payload-Digest: sha1:{_b32(hashlib.sha1(payload).hexdigest())}",
             f"WARC-Block-Digest: sha1:{_b32(hashlib.sha1(block).hexdigest())}"]
    if refers:
        lines += [f"WARC-Refers-To: <{refers}>", f"WARC-Profile: {REVISIT}"]
    lines += ["Content-Type: " + ("application/http; msgtype=response" if http else head["Content-type"]),
              f"Content-Length: {len(block)}", "", ""]
    return "\r\n".join(lines).encode() + block


def warc_records(content: bytes) -> Iterator[tuple[dict, bytes]]:
    """(header fields, block) of every record, by declared lengths; digests are
    checked."""
    r = Reader(content)
    while (line := r.line()) is not None:
        if not line:
            continue
        if not line.startswith(b"WARC/"):
            raise ValueError(f"not a WARC record: {line[:60]!r}")
        head = {}
        while line := r.line():
            k, _, v = line.decode("utf-8", "replace").partition(":")
            head[k.strip().lower()] = v.strip()
        block = r.take(int(head["content-length"]))
        want = head.get("warc-block-digest", "").rpartition(":")[2]
        if want and want != base64.b32encode(hashlib.sha1(block).digest()).decode():
            raise ValueError("damaged WARC block")
        yield head, block


# ---- Spark ---------------------------------------------------------------

def _files(df: DataFrame, path: str, pattern: str = "part-*") -> DataFrame:
    return (df.sparkSession.read.format("binaryFile").option("pathGlobFilter", pattern).load(path)
            .select("path", "content"))


def arc_index(source: DataFrame, arc_path: str, version: int = 1) -> DataFrame:
    """Written table (file, n, page, rid, digest, bytes): the records of all
    ARC files, without bodies."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for path, content in zip(batch.column(0), batch.column(1)):
                rows = []
                file = path.as_py().rpartition("/")[2]
                for n, (_, body) in enumerate(arc_records(content.as_py(), version)):
                    _, fields, payload = http_parts(body)
                    digest = hashlib.sha1(payload).hexdigest()
                    page = fields.get("x-page-id", "")
                    rows.append((file, n, page, record_id(page, digest, f"{file}:{n}"), digest, len(payload)))
                cols = list(zip(*rows)) or [[]] * 6
                yield pa.RecordBatch.from_arrays(
                    [pa.array(c, t) for c, t in zip(cols, (pa.string(), pa.int32(), pa.string(), pa.string(), pa.string(),
                                                           pa.int64()))], names=["file", "n", "page", "rid", "digest", "bytes"])

    return materialize(_files(source, arc_path).mapInArrow(
        run, "file string, n int, page string, rid string, digest string, bytes bigint"), "arc-index")


def revisits(index: DataFrame, least: int = LEAST) -> DataFrame:
    """(file, n, refers): the records that become revisits."""
    big = index.where((F.col("bytes") >= least) & (F.col("page") != ""))
    best = (big.groupBy("digest").agg(F.count(F.lit(1)).alias("k"), F.max(F.struct(
        F.col("page").cast("long").alias("id"), F.struct("file", "n", "rid").alias("at"))).alias("top"))
        .where("k > 1").select("digest", "top.at.file", "top.at.n", "top.at.rid")
        .toDF("digest", "tfile", "tn", "refers"))
    return big.join(best, "digest").where("file <> tfile or n <> tn").select("file", "n", "refers")


def convert(source: DataFrame, arc_path: str, warc_path: str, version: int = 1, least: int = LEAST) -> None:
    """Write WARC archives with a record for every record of the ARC files."""
    index = arc_index(source, arc_path, version)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for path, content, again in zip(batch.column(0), batch.column(1), batch.column(2)):
                file = path.as_py().rpartition("/")[2]
                refers = {x["n"]: x["refers"] for x in again.as_py() or []}
                out, size = [], 0
                for n, (head, body) in enumerate(arc_records(content.as_py(), version)):
                    _, fields, payload = http_parts(body)
                    digest = hashlib.sha1(payload).hexdigest()
                    rid = record_id(fields.get("x-page-id", ""), digest, f"{file}:{n}")
                    out.append(warc_record(head, body, rid, refers.get(n)))
                    size += len(out[-1])
                    if size > 4_000_000:
                        yield pa.RecordBatch.from_arrays([pa.array(out, pa.binary())], names=["value"])
                        out, size = [], 0
                if out:
                    yield pa.RecordBatch.from_arrays([pa.array(out, pa.binary())], names=["value"])

    # the revisits of one archive of bounded size
    again = revisits(index, least).groupBy("file").agg(F.collect_list(F.struct("n", "refers")).alias("again"))
    files = _files(source, arc_path).withColumn("file", F.element_at(F.split("path", "/"), -1))
    rows = files.join(again, "file", "left").select("path", "content", "again").mapInArrow(run, "value binary")
    (rows.select(F.col("value").cast("string").alias("value"))
     .write.option("lineSep", "\r\n\r\n").option("compression", "gzip").text(warc_path))


def read_back(source: DataFrame, warc_path: str) -> DataFrame:
    """One row per WARC record: page_id, payload_bytes, payload_digest (hex),
    record_type, refers_to (page of the record that a revisit refers to)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for content in batch.column(0):
                rows = []
                for head, block in warc_records(content.as_py()):
                    _, fields, payload = http_parts(block)
                    digest = base64.b32decode(head["warc-payload-digest"].rpartition(":")[2]).hex()
                    size = len(payload)
                    if head["warc-type"] == "revisit":
                        size = int(fields.get("content-length", 0))
                    elif hashlib.sha1(payload).hexdigest() != digest:
                        raise ValueError("damaged WARC payload")
                    page = fields.get("x-page-id", "")
                    rows.append((int(page) if page else None, size, digest, head["warc-type"],
                                 head["warc-record-id"], head.get("warc-refers-to")))
                cols = list(zip(*rows)) or [[]] * 6
                yield pa.RecordBatch.from_arrays(
                    [pa.array(c, t) for c, t in zip(cols, (pa.int64(), pa.int64(), *[pa.string()] * 4))],
                    names=["page_id", "payload_bytes", "payload_digest", "record_type", "rid", "refers"])

    files = _files(source, warc_path).select("content")
    rec = materialize(files.mapInArrow(run, "page_id bigint, payload_bytes bigint, payload_digest string, "
                                            "record_type string, rid string, refers string"), "warc-index")
    named = rec.where("refers is not null").select(F.col("refers").alias("rid")).distinct()
    target = rec.select("rid", F.col("page_id").alias("refers_to")).join(named, "rid").withColumnRenamed("rid", "refers")
    return rec.join(target, "refers", "left").select("page_id", "payload_bytes", "payload_digest", "record_type",
                                                     "refers_to")


def pages_through_archives(pages: DataFrame, version: int | None = None, least: int = LEAST) -> DataFrame:
    """Pages -> ARC files -> WARC files -> one row per record read back."""
    arc, warc = _folder(pages, "arc"), _folder(pages, "warc")
    write_arc(pages, arc, version)
    convert(pages, arc, warc, least=least)  # the version blocks tell the versions
    return read_back(pages, warc)
