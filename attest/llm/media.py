"""Media columns: payloads stored once by content in tar shards; rows carry digest, shard, offset and length.

A payload of 8-bit samples is stored losslessly as a grey TIFF image, 64 samples wide, one strip
compressed by deflate, its directory in front of the strip. So metadata columns need the first
HEADER bytes of a payload only, by a range read inside its shard.

Writing: a task stores each of its distinct payloads once, where it reads them, in tar shards of about
SHARD bytes; payloads are not shuffled. Of a payload that several tasks stored the index names one
place, the first by shard and offset, and all rows point there. A shard's name is new for every attempt,
and the index holds what successful attempts wrote, so a lost executor leaves no wrong row.

Defined results: null text is empty; an empty payload is 64 zeros; equal texts share one stored
payload and all values; repeated rows give repeated rows; an empty table gives an empty index; a text of any length is one
payload; of other columns none is read, whatever their names. Rows meet the index in one join of two
shuffled tables, which Spark splits where a digest is frequent.
"""

import hashlib
import io
import struct
import tarfile
import uuid
import zlib

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ._shared import make_folder, new_folder, opened, written

WIDTH = 64
SHARD = 256 << 20
#: Bytes of a stored payload that hold its header and directory.
HEADER = 8 + 2 + 9 * 12 + 4
LEVEL = 3


# --- the stored form ---


def padded(data: bytes) -> bytes:
    return data + bytes(-len(data) % WIDTH if data else WIDTH)


def to_tiff(samples: bytes) -> bytes:
    strip = zlib.compress(samples, LEVEL)
    rows = len(samples) // WIDTH
    # Fixed values of the format: width, length, bits, compression (8: deflate), black is zero, offset, samples, rows per strip, bytes.
    tags = [(256, WIDTH), (257, rows), (258, 8), (259, 8), (262, 1), (273, HEADER), (277, 1), (278, rows), (279, len(strip))]
    directory = b"".join(struct.pack("<HHII", tag, 4, 1, value) for tag, value in tags)
    return b"II*\0" + struct.pack("<IH", 8, len(tags)) + directory + struct.pack("<I", 0) + strip


def header_of(front: bytes) -> dict[int, int]:
    """Tags of a stored payload from its first bytes."""
    if front[:4] != b"II*\0":
        raise ValueError("not a stored payload")
    n = struct.unpack_from("<H", front, 8)[0]
    return {tag: value for tag, _, _, value in struct.iter_unpack("<HHII", front[10 : 10 + 12 * n])}


def from_tiff(data: bytes) -> bytes:
    tags = header_of(data[:HEADER])
    return zlib.decompress(data[tags[273] : tags[273] + tags[279]])


def feature_of(samples: bytes) -> str:
    """Mean, deviation, mean step between neighbours, and a histogram of 16 bins, in one line."""
    x = np.frombuffer(samples, "uint8").astype("float64")
    bins = np.bincount(np.frombuffer(samples, "uint8") >> 4, minlength=16)
    step = np.abs(np.diff(x)).mean() if len(x) > 1 else 0.0
    return f"{WIDTH}x{len(x) // WIDTH} mean={x.mean():.4f} sd={x.std():.4f} step={step:.4f} bins={'.'.join(map(str, bins))}"


# --- storing ---


class _Shard:
    """A tar file that is written from front to end."""

    def __init__(self, folder: str):
        self.uri = f"{folder}/{uuid.uuid4().hex}.tar"
        system, path = opened(self.uri)
        self.out, self.at = system.open_output_stream(path, compression=None), 0

    def add(self, name: str, data: bytes) -> int:
        info = tarfile.TarInfo(name)
        info.size = len(data)
        head = info.tobuf(tarfile.USTAR_FORMAT)
        offset = self.at + len(head)
        block = head + data + bytes(-len(data) % 512)
        self.out.write(block)
        self.at += len(block)
        return offset

    def close(self) -> None:
        self.out.write(bytes(1024))
        self.out.close()


def payload_digest(text: Column) -> tuple[Column, Column, Column]:
    """Bytes of a text, of its payload, and the payload's digest, without storing it."""
    data = F.coalesce(text, F.lit("")).cast("binary")
    n = F.octet_length(data)
    fill = F.when(n == 0, F.lit(WIDTH)).otherwise(F.pmod(-n, F.lit(WIDTH))).cast("int")
    return n.cast("long"), (n + fill).cast("long"), F.sha2(F.concat(data, F.unhex(F.repeat(F.lit("00"), fill))), 256)


def stored(docs: DataFrame) -> DataFrame:
    """Rows with text -> an index (digest, shard, offset, length) with one row for each distinct payload."""
    folder = new_folder(docs.sparkSession, "media")
    make_folder(folder)

    def write(batches):
        seen, shard = set(), None
        for batch in batches:
            rows = []
            for text in batch["text"].fillna(""):
                samples = padded(text.encode("utf-8", "surrogatepass"))
                digest = hashlib.sha256(samples).hexdigest()
                if digest in seen:
                    continue
                seen.add(digest)
                image = to_tiff(samples)
                shard = shard or _Shard(folder)
                rows.append((digest, shard.uri, shard.add(f"{digest}.tif", image), len(image)))
                if shard.at >= SHARD:
                    shard.close()
                    shard = None
            yield pd.DataFrame(rows, columns=["digest", "shard", "offset", "length"])
        if shard:
            shard.close()

    places = written(docs.select("text").mapInPandas(write, "digest string, shard string, offset long, length long"), "media-places")
    first = places.groupBy("digest").agg(F.min(F.struct("shard", "offset", "length")).alias("at")).select("digest", "at.*")
    # Readers take neighbouring payloads of a shard together.
    return written(written(first, "media-first").repartitionByRange("shard", "offset").sortWithinPartitions("shard", "offset"), "media-index")


def _ranges(batches, columns, of):
    """For each row of an index, what of(file, row) gives; a shard stays open while rows are in it."""
    uri, source = None, None
    for batch in batches:
        rows = []
        for row in batch.itertuples(index=False):
            if row.shard != uri:
                if source:
                    source.close()
                system, path = opened(row.shard)
                uri, source = row.shard, system.open_input_file(path)
            rows.append((row.digest, *of(source, row)))
        yield pd.DataFrame(rows, columns=columns)
    if source:
        source.close()


def metadata(index: DataFrame) -> DataFrame:
    """Metadata columns from the headers only: digest, width, height, bits, strip_bytes."""
    columns = ["digest", "width", "height", "bits", "strip_bytes"]

    def of(source, row):
        tags = header_of(source.read_at(HEADER, row.offset))
        return tags[256], tags[257], tags[258], tags[279]

    return index.mapInPandas(lambda batches: _ranges(batches, columns, of), "digest string, width long, height long, bits long, strip_bytes long")


def features(index: DataFrame) -> DataFrame:
    """Metadata columns from a range read of the header, then columns from the whole stored bytes, read back: digests and a feature. With their place."""
    columns = ["digest", "shard", "offset", "length", "width", "height", "payload_bytes", "payload_sha256", "tail_crc32", "media_bytes", "media_sha256", "feature"]

    def of(source, row):
        tags = header_of(source.read_at(HEADER, row.offset))
        data = source.read_at(row.length, row.offset)
        samples = from_tiff(data)
        return row.shard, row.offset, row.length, tags[256], tags[257], len(samples), hashlib.sha256(samples).hexdigest(), zlib.crc32(samples[-64:]), len(data), hashlib.sha256(data).hexdigest(), feature_of(samples)

    kinds = "digest string, shard string, offset long, length long, width long, height long, payload_bytes long, payload_sha256 string, tail_crc32 long, media_bytes long, media_sha256 string, feature string"
    return index.mapInPandas(lambda batches: _ranges(batches, columns, of), kinds)


def media_columns(docs: DataFrame) -> DataFrame:
    """Documents with doc_id and text -> their stored payload's columns, read back from the shards."""
    index = stored(docs)
    n, _, digest = payload_digest(F.col("text"))
    rows = docs.select("doc_id", n.alias("n_bytes"), digest.alias("digest"))
    return rows.join(features(index), "digest").drop("digest").withColumn("shard", F.element_at(F.split("shard", "/"), -1))


def members(data: bytes) -> dict[str, bytes]:
    """What a shard holds, by a plain tar reader; for checks."""
    with tarfile.open(fileobj=io.BytesIO(data)) as tar:
        return {m.name: tar.extractfile(m).read() for m in tar}
