"""Operator 6: media columns over content-addressed payloads in tar shards.

Every payload is stored under its digest, as a lossless 8-bit grey image
(PNG, 576 samples a line) in a tar shard of the shared folder. Rows carry only
the digest and the place of the member (shard, offset, length). Metadata columns
are filled by range reads of the member's first 33 bytes; features come from the
bytes read back.

Defined results: a null or empty text is a payload of one line of 255s; equal
texts share one member and all values; repeated rows each keep their row; other
columns are ignored; an empty table gives no shard and no row. Long texts only
make taller images. A payload that a third of all rows hold is written once per
task, and its digest meets the others after a partial aggregation.
"""

from __future__ import annotations

import hashlib
import math
import struct
import tarfile
import uuid
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .shared import materialize, new_folder, open_store, read_table

LINE = 576
PAD = 255
PNG_MAGIC = b"\x89PNG\r\n\x1a\n"
HEADER_BYTES = 33
TAIL = 32


# --- the stored form -----------------------------------------------------------------------------


def payload_of(text: str | None) -> bytes:
    raw = (text or "").encode()
    return raw + bytes([PAD]) * (max(-(-len(raw) // LINE), 1) * LINE - len(raw))


def _png_chunk(kind: bytes, data: bytes) -> bytes:
    return struct.pack(">I", len(data)) + kind + data + struct.pack(">I", zlib.crc32(kind + data))


def encode_image(payload: bytes, level: int = 6) -> bytes:
    lines = np.frombuffer(payload, dtype=np.uint8).reshape(-1, LINE)
    filtered = np.zeros((len(lines), LINE + 1), dtype=np.uint8)  # a leading 0 on each line: no filter
    filtered[:, 1:] = lines
    head = struct.pack(">IIBBBBB", LINE, len(lines), 8, 0, 0, 0, 0)
    data = zlib.compress(filtered.tobytes(), level)
    return PNG_MAGIC + _png_chunk(b"IHDR", head) + _png_chunk(b"IDAT", data) + _png_chunk(b"IEND", b"")


def image_header(head: bytes) -> tuple[int, int, int]:
    """(width, height, bits) from the first bytes of a member."""
    if head[:8] != PNG_MAGIC or head[12:16] != b"IHDR":
        raise ValueError("not a PNG header")
    width, height, bits = struct.unpack(">IIB", head[16:25])
    return width, height, bits


def decode_image(image: bytes) -> bytes:
    width, height, _ = image_header(image)
    at, data = 8, []
    while at < len(image):
        size, kind = struct.unpack(">I4s", image[at : at + 8])
        if kind == b"IDAT":
            data.append(image[at + 8 : at + 8 + size])
        at += size + 12
    lines = np.frombuffer(zlib.decompress(b"".join(data)), dtype=np.uint8).reshape(height, width + 1)
    if lines[:, 0].any():
        raise ValueError("only lines without a filter are written here")
    return lines[:, 1:].tobytes()


def feature_of(payload: bytes) -> str:
    """Mean, deviation and entropy of the samples, and a 64-bit sign pattern of 64 equal stretches."""
    samples = np.frombuffer(payload, dtype=np.uint8)
    counts = np.bincount(samples, minlength=256)
    n = len(samples)
    total, squares = int((counts * np.arange(256)).sum()), int((counts * np.arange(256) ** 2).sum())
    mean = total / n
    share = counts[counts > 0] / n
    entropy = -math.fsum(share * np.log2(share))
    sums = samples.reshape(64, -1).sum(axis=1, dtype=np.int64)
    pattern = np.packbits(sums * 64 >= total).tobytes().hex()
    return f"{mean:.6f},{math.sqrt(max(squares / n - mean * mean, 0)):.6f},{entropy:.6f},{pattern}"


# --- tar shards ----------------------------------------------------------------------------------


class TarShard:
    """A tar file written in one pass; ``add`` returns the place of the member's bytes.

    The file is named by the digest of its members' digests, so attempts of one
    task that meet under a name have written the same bytes.
    """

    def __init__(self, folder: str):
        self.folder = folder
        self.store, self.path = open_store(folder)
        self.store.create_dir(self.path, recursive=True)
        self.draft = f"{self.path}/{uuid.uuid4().hex}.draft"
        self.out = self.store.open_output_stream(self.draft)
        self.name = hashlib.sha256()
        self.members: list[tuple[str, int, int]] = []

    def add(self, digest: str, data: bytes) -> None:
        info = tarfile.TarInfo(f"{digest}.png")
        info.size = len(data)
        self.out.write(info.tobuf(tarfile.USTAR_FORMAT))
        self.members.append((digest, self.out.tell(), len(data)))
        self.out.write(data)
        self.out.write(b"\x00" * (-len(data) % tarfile.BLOCKSIZE))
        self.name.update(digest.encode())

    def size(self) -> int:
        return self.out.tell()

    def close(self) -> pa.RecordBatch:
        """Publish the file; returns the index rows of its members."""
        self.out.write(b"\x00" * (2 * tarfile.BLOCKSIZE))
        self.out.close()
        file = f"{self.name.hexdigest()[:40]}.tar"
        self.store.move(self.draft, f"{self.path}/{file}")
        digests, offsets, lengths = zip(*self.members)
        shards = [f"{self.folder}/{file}"] * len(digests)
        return pa.RecordBatch.from_arrays(
            [pa.array(digests), pa.array(shards), pa.array(offsets, type=pa.int64()), pa.array(lengths, type=pa.int64())],
            names=["digest", "shard", "offset", "length"],
        )


INDEX = "digest string, shard string, offset long, length long"


def digest_columns(df: DataFrame, id_col: str, text_col: str) -> DataFrame:
    """Id, byte count and payload digest of each row, without Python."""
    raw: Column = F.coalesce(F.col(text_col), F.lit("")).cast("binary")
    rows = df.select(F.col(id_col).cast("long").alias(id_col), raw.alias("raw"))
    n = F.octet_length("raw").cast("long")
    pad = (F.greatest(F.ceil(n / LINE), F.lit(1)) * LINE - n).cast("int")
    padding = F.unhex(F.repeat(F.lit(f"{PAD:02X}"), pad))
    return rows.select(id_col, n.alias("n_bytes"), F.sha2(F.concat("raw", padding), 256).alias("digest"))


def write_media(df: DataFrame, text_col: str = "text", folder: str | None = None, shard_bytes: int = 256 << 20) -> DataFrame:
    """Store the payloads of ``df``; returns the index, one row per distinct payload.

    No payload is shuffled: each task writes the payloads that are new to it into
    its own shards, and only digests and places are brought together. Where two
    tasks hold the same payload, the address is the first place in order of shard
    and offset; the other member stays in its shard unused.
    """
    folder = folder or new_folder(df.sparkSession, "media")

    def store(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        seen: set[bytes] = set()
        shard = None
        for batch in batches:
            for text in batch.column(0):
                payload = payload_of(text.as_py())
                key = hashlib.sha256(payload).digest()
                if key in seen:
                    continue
                seen.add(key)
                shard = shard or TarShard(folder)
                shard.add(key.hex(), encode_image(payload))
                if shard.size() >= shard_bytes:
                    yield shard.close()
                    shard = None
        if shard is not None:
            yield shard.close()

    written = materialize(df.select(text_col).mapInArrow(store, INDEX), "media-members")
    first = written.groupBy("digest").agg(F.min(F.struct("shard", "offset", "length")).alias("place"))
    return first.select("digest", "place.shard", "place.offset", "place.length")


METADATA = "width long, height long, bits int"
FEATURES = "payload_bytes long, payload_sha256 string, tail_crc32 long, media_bytes long, media_sha256 string, feature string"


def _read_members(index: DataFrame, schema: str, header_only: bool) -> DataFrame:
    """Rows of ``index`` with what reading their members shows."""
    names = [x.split()[0] for x in f"{INDEX}, {schema}".split(", ")]
    kinds = {"long": pa.int64(), "int": pa.int32(), "string": pa.string()}
    types = [kinds[x.split()[1]] for x in f"{INDEX}, {schema}".split(", ")]

    def read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        uri, file = None, None
        for batch in batches:
            rows = []
            for row in batch.to_pylist():
                if row["shard"] != uri:
                    if file is not None:
                        file.close()
                    uri = row["shard"]
                    store, path = open_store(uri)
                    file = store.open_input_file(path)
                if header_only:
                    found = image_header(file.read_at(min(HEADER_BYTES, row["length"]), row["offset"]))
                else:
                    image = file.read_at(row["length"], row["offset"])
                    payload = decode_image(image)
                    found = (
                        len(payload),
                        hashlib.sha256(payload).hexdigest(),
                        zlib.crc32(payload[-TAIL:]),
                        len(image),
                        hashlib.sha256(image).hexdigest(),
                        feature_of(payload),
                    )
                rows.append((row["digest"], row["shard"], row["offset"], row["length"], *found))
            if rows:
                yield pa.RecordBatch.from_arrays([pa.array(c, type=t) for c, t in zip(zip(*rows), types)], names=names)
        if file is not None:
            file.close()

    width = int(index.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    spread = index.select("digest", "shard", "offset", "length").repartition(width, "shard", F.col("offset") % 4)
    return spread.sortWithinPartitions("shard", "offset").mapInArrow(read, f"{INDEX}, {schema}")


def add_metadata(index: DataFrame) -> DataFrame:
    """Width, height and sample size of every member, from its header alone."""
    return _read_members(index, METADATA, header_only=True)


def add_features(index: DataFrame) -> DataFrame:
    """Digests and features of every member, read back whole."""
    return _read_members(index, FEATURES, header_only=False)


def media_rows(df: DataFrame, index: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Each row of ``df`` with its digest and the columns of ``index`` for it."""
    return digest_columns(df, id_col, text_col).join(index, "digest")


def op6_media_columns(spark: SparkSession, sf_dir: str) -> DataFrame:
    documents = read_table(spark, sf_dir, "documents")
    index = write_media(documents)
    described = add_metadata(index).join(add_features(index).drop("shard", "offset", "length"), "digest")
    rows = media_rows(documents, materialize(described, "media-features"))
    return rows.select(
        "doc_id", "n_bytes", "payload_bytes", "payload_sha256", "tail_crc32", "media_bytes", "media_sha256", "feature",
        "digest", "offset", "length", "width", "height",
    )
