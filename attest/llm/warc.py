"""Web archives as seekable Zstandard bundles.

Every page is one WARC record. Records are grouped into independent Zstandard frames of about FRAME
bytes; after the frames comes the seek table of the seekable format, in a skippable frame, whose
footer is at the end of the file. The index maps a record's id to archive, frame, and offset and
length inside the frame's content, so one record costs one range read and one frame.

Of records of equal payloads of LEAST bytes or more that with the largest page_id is the response;
the others are revisits that refer to it and carry no payload.

Only ids and digests are grouped; payloads are dealt once, by page, so copies of one payload spread
over all tasks. Archive names are new for every attempt and the index holds those of successful ones.

Defined results: null html is empty; null page_id is written as a record without number and comes
back as null, and is a revisit if another row has the payload with a number; rows that are equal in
page_id and payload are a record each, of the same type, with their place in the record id; a null url is
``about:blank``; an empty table gives an empty index; payloads of any length are one record; of other
columns none is read, whatever their names.
"""

import hashlib
import re
import struct
import uuid

import pandas as pd
import zstandard
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ._shared import make_folder, new_folder, opened, written

FRAME = 256 << 10
ARCHIVE = 512 << 20
LEAST = 1000
LEVEL = 3
#: Fixed values of the seekable format.
SKIPPABLE, SEEKABLE = 0x184D2A5E, 0x8F92EAB1
DATE = "2024-01-01T00:00:00Z"
PROFILE = "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"


def record_id(page_id: int | None, digest: str, place: str = "") -> str:
    """place tells apart rows that are equal in id and payload; a revisit refers to the id without it."""
    return f"<urn:attest:page:{'none' if page_id is None else page_id}:{digest[:16]}{place and ':' + place}>"


def page_of(record: str) -> int | None:
    name = record.split(":")[3]
    return None if name == "none" else int(name)


def record(page_id: int | None, url: str | None, payload: bytes, digest: str, revisit_of: int | None, is_revisit: bool, place: str = "") -> bytes:
    """One WARC record with its HTTP block."""
    http = f"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nContent-Length: {len(payload)}\r\n\r\n".encode()
    block = http if is_revisit else http + payload
    uri = re.sub(r"[\x00-\x20\x7f]", lambda m: f"%{ord(m[0]):02X}", url or "about:blank")
    head = [
        "WARC/1.1", f"WARC-Type: {'revisit' if is_revisit else 'response'}", f"WARC-Record-ID: {record_id(page_id, digest, place)}", f"WARC-Date: {DATE}", f"WARC-Target-URI: {uri}",
        f"WARC-Payload-Digest: sha1:{digest}", "Content-Type: application/http; msgtype=response", f"Content-Length: {len(block)}",
    ]
    if is_revisit:
        head += [f"WARC-Profile: {PROFILE}", f"WARC-Refers-To: {record_id(revisit_of, digest)}"]
    return ("\r\n".join(head) + "\r\n\r\n").encode("utf-8", "surrogatepass") + block + b"\r\n\r\n"


def parsed(data: bytes) -> tuple[dict[str, str], dict[str, str], bytes]:
    """WARC headers, HTTP headers and payload of one record."""
    head, _, rest = data.partition(b"\r\n\r\n")
    named = lambda x: dict(line.split(": ", 1) for line in x.decode("utf-8", "surrogatepass").split("\r\n")[1:])
    warc = named(head)
    block = rest[: int(warc["Content-Length"])]
    http, _, payload = block.partition(b"\r\n\r\n")
    return warc, named(http), payload


class Writer:
    """A seekable bundle that is written from front to end."""

    def __init__(self, folder: str):
        self.uri = f"{folder}/{uuid.uuid4().hex}.warc.zst"
        system, path = opened(self.uri)
        self.out = system.open_output_stream(path, compression=None)
        self.frames: list[tuple[int, int]] = []
        self.open, self.size, self.total = [], 0, 0
        self.packer = zstandard.ZstdCompressor(level=LEVEL)

    def place(self) -> str:
        """A name for the place of the next record that no other has."""
        return f"{self.uri.rpartition('/')[2].partition('.')[0]}-{len(self.frames)}-{self.size}"

    def add(self, data: bytes) -> tuple[int, int]:
        """Frame and offset in it of the record."""
        at = len(self.frames), self.size
        self.open.append(data)
        self.size += len(data)
        if self.size >= FRAME:
            self.flush()
        return at

    def flush(self) -> None:
        if self.open:
            packed = self.packer.compress(b"".join(self.open))
            self.out.write(packed)
            self.frames.append((len(packed), self.size))
            self.total += len(packed)
            self.open, self.size = [], 0

    def close(self) -> None:
        self.flush()
        table = b"".join(struct.pack("<II", *f) for f in self.frames)
        footer = struct.pack("<IBI", len(self.frames), 0, SEEKABLE)
        self.out.write(struct.pack("<II", SKIPPABLE, len(table) + len(footer)) + table + footer)
        self.out.close()


class Reader:
    """Frames of a bundle by number, through its seek table."""

    def __init__(self, uri: str):
        system, path = opened(uri)
        self.file = system.open_input_file(path)
        size = self.file.size()
        n, _, magic = struct.unpack("<IBI", self.file.read_at(9, size - 9))
        if magic != SEEKABLE:
            raise ValueError(f"no seek table in {uri}")
        self.at, offset = [], 0
        for packed, plain in struct.iter_unpack("<II", self.file.read_at(8 * n, size - 9 - 8 * n)):
            self.at.append((offset, packed, plain))
            offset += packed

    def frame(self, k: int) -> bytes:
        offset, packed, plain = self.at[k]
        return zstandard.ZstdDecompressor().decompress(self.file.read_at(packed, offset), max_output_size=plain)

    def close(self) -> None:
        self.file.close()


def _typed(pages: DataFrame) -> DataFrame:
    """Pages with their digest, and what they are: is_revisit, and the response they refer to."""
    pages = pages.select("page_id", "url", F.coalesce("html", F.lit("")).cast("binary").alias("payload"))
    key = F.coalesce(F.col("page_id").cast("string"), F.lit("-"))
    pages = pages.withColumn("digest", F.sha1("payload")).withColumn("key", key)
    narrow = written(pages.select("page_id", "key", "digest", F.octet_length("payload").alias("size")), "warc-digests")
    response = narrow.filter(F.col("size") >= LEAST).groupBy("digest").agg(F.max("page_id").alias("response"), F.count("*").alias("n")).filter("n > 1 and response is not null").drop("n")
    each = written(narrow.groupBy("key", "digest", "page_id").agg(F.count("*").alias("n")), "warc-each")
    told = each.join(written(response, "warc-responses"), "digest", "left")
    refers = F.when(F.col("page_id").isNull() | (F.col("page_id") != F.col("response")), F.col("response"))
    told = told.select("key", "digest", refers.alias("refers_to"), (F.col("n") > 1).alias("again")).filter("again or refers_to is not null")
    return pages.join(told, ["key", "digest"], "left").drop("key")


def archived(pages: DataFrame) -> DataFrame:
    """Pages with page_id, url and html -> the index: record_id, archive, frame, offset, length."""
    folder = new_folder(pages.sparkSession, "warc")
    make_folder(folder)

    def write(batches):
        out = None
        for batch in batches:
            rows = []
            for page, none, url, payload, digest, refers, again in zip(*(batch[c] for c in ("id", "no_id", "url", "payload", "digest", "refers", "again")), strict=True):
                page = None if none else page
                to = int(refers) if refers else None
                out = out or Writer(folder)
                place = out.place() if again else ""
                data = record(page, url, payload, digest, to, to is not None, place)
                uri, (frame, offset) = out.uri, out.add(data)
                rows.append((record_id(page, digest, place), uri, frame, offset, len(data)))
                if out.total >= ARCHIVE:
                    out.close()
                    out = None
            yield pd.DataFrame(rows, columns=["record_id", "archive", "frame", "offset", "length"])
        if out:
            out.close()

    rows = _typed(pages).select(F.coalesce("page_id", F.lit(0)).alias("id"), F.col("page_id").isNull().alias("no_id"), "url", "payload", "digest", F.col("refers_to").cast("string").alias("refers"), F.coalesce("again", F.lit(False)).alias("again"))
    return written(rows.mapInPandas(write, "record_id string, archive string, frame int, offset long, length long"), "warc-index")


def read_back(index: DataFrame) -> DataFrame:
    """Records that an index names, read from their archives -> page_id, payload_bytes, payload_digest, record_type, refers_to."""
    def read(batches):
        uri, source, number, frame = None, None, None, b""
        for batch in batches:
            rows = []
            for row in batch.itertuples(index=False):
                if row.archive != uri:
                    if source:
                        source.close()
                    uri, source, number = row.archive, Reader(row.archive), None
                if row.frame != number:
                    number, frame = row.frame, source.frame(row.frame)
                warc, http, payload = parsed(frame[row.offset : row.offset + row.length])
                if warc["WARC-Record-ID"] != row.record_id:
                    raise ValueError(f"{row.record_id} is not where the index says")
                if warc["WARC-Type"] == "response":
                    found = len(payload), hashlib.sha1(payload).hexdigest(), "response", None
                else:
                    found = int(http["Content-Length"]), warc["WARC-Payload-Digest"].removeprefix("sha1:"), "revisit", page_of(warc["WARC-Refers-To"])
                rows.append((page_of(row.record_id), *found, row.frame))
            out = pd.DataFrame(rows, columns=["page_id", "payload_bytes", "payload_digest", "record_type", "refers_to", "frame"])
            yield out.astype({"page_id": "Int64", "refers_to": "Int64"})
        if source:
            source.close()

    # Rows of an archive lie together in the index, in the order in which they were written.
    return index.mapInPandas(read, "page_id long, payload_bytes long, payload_digest string, record_type string, refers_to long, frame int")
