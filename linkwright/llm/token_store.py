"""Operator 10: token ids in directly addressable files.

An id is split into chunks of eight bits, lowest first. Level 0 holds the first
chunk of every id; a bitmap says which ids go on to the next level, and a rank
directory (bits set before every block of 512) turns a position on one level
into the position on the next. Any id is therefore read with one look at each
level, without decoding a block.

File layout (little endian): a header of nine 64-bit words (magic, version,
chunk bits, levels, documents, ids, three reserved), a section table of
(offset, bytes) pairs, then the sections: document ids, validity of the document
ids, offsets of the documents, and for each level its chunks, its continuation
bitmap and its rank directory.

Files are written in ascending order of the document id (null first; equal ids
by a hash of the text). Defined results: a null or empty text holds the end id
alone; repeated rows each keep their place; other columns are ignored; an empty
table gives no file and no row. Documents that share one id are spread over
several files, in order.
"""

from __future__ import annotations

import json
import os
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from .shared import materialize, new_folder, open_store, publish, read_table
from .textcut import cuttable, slices

MAGIC = int.from_bytes(b"DACTOKEN", "little")
CHUNK_BITS = 8
BLOCK = 512
HEADER_WORDS = 9


# --- codes ---------------------------------------------------------------------------------------


class Level:
    """Chunks of one level with the bitmap and directory that lead to the next one."""

    def __init__(self, chunks: np.ndarray, bitmap: np.ndarray, directory: np.ndarray):
        self.chunks, self.bitmap, self.directory = chunks, bitmap, directory

    @classmethod
    def build(cls, values: np.ndarray) -> tuple[Level, np.ndarray]:
        """The level for ``values`` and the values that remain above it."""
        above = values >> CHUNK_BITS
        goes_on = above > 0
        bitmap = np.packbits(goes_on, bitorder="little")
        padded = np.zeros(-(-len(values) // BLOCK) * BLOCK, dtype=bool)
        padded[: len(values)] = goes_on
        counts = padded.reshape(-1, BLOCK).sum(axis=1, dtype=np.uint64)
        directory = np.zeros(len(counts) + 1, dtype="<u8")
        np.cumsum(counts, out=directory[1:])
        return cls((values & ((1 << CHUNK_BITS) - 1)).astype(np.uint8), bitmap, directory), above[goes_on]

    def bits(self, first: int, count: int) -> np.ndarray:
        byte = first // 8
        window = self.bitmap[byte : (first + count + 7) // 8]
        return np.unpackbits(window, bitorder="little")[first - 8 * byte : first - 8 * byte + count]

    def rank(self, position: int) -> int:
        """Bits set before ``position``: the directory plus at most one block."""
        block = position // BLOCK
        return int(self.directory[block]) + int(self.bits(block * BLOCK, position - block * BLOCK).sum())


def build_levels(ids: np.ndarray) -> list[Level]:
    levels, rest = [], ids.astype("<u4")
    while len(rest) or not levels:
        level, rest = Level.build(rest)
        levels.append(level)
    return levels


def read_ids(levels: list[Level], first: int, count: int) -> np.ndarray:
    """``count`` ids from position ``first``; only these positions are touched."""
    out = np.zeros(count, dtype=np.uint32)
    index, shift = np.arange(count), 0
    for level in levels:
        if not count:
            break
        out[index] |= level.chunks[first : first + count].astype(np.uint32) << shift
        bits = level.bits(first, count).astype(bool)
        index = index[bits]
        first, count, shift = level.rank(first), int(bits.sum()), shift + CHUNK_BITS
    return out


# --- files ---------------------------------------------------------------------------------------


def write_file(uri: str, doc_ids: list, ids: np.ndarray, lengths: np.ndarray) -> int:
    levels = build_levels(ids)
    offsets = np.zeros(len(lengths) + 1, dtype="<u8")
    np.cumsum(lengths, out=offsets[1:])
    sections = [
        np.array([0 if d is None else d for d in doc_ids], dtype="<i8"),
        np.array([d is not None for d in doc_ids], dtype=np.uint8),
        offsets,
    ]
    for level in levels:
        sections += [level.chunks, level.bitmap, level.directory]
    header = np.zeros(HEADER_WORDS + 2 * len(sections), dtype="<u8")
    header[:6] = MAGIC, 1, CHUNK_BITS, len(levels), len(doc_ids), len(ids)
    at = header.nbytes
    for k, section in enumerate(sections):
        header[HEADER_WORDS + 2 * k : HEADER_WORDS + 2 * k + 2] = at, section.nbytes
        at += -(-section.nbytes // 8) * 8

    def write(out) -> None:
        out.write(header.tobytes())
        for section in sections:
            out.write(section.tobytes())
            out.write(b"\x00" * (-section.nbytes % 8))

    return publish(uri, write)


class TokenFile:
    """Reader of one file; sections are read when first used."""

    KINDS = ("<i8", "u1", "<u8")

    def __init__(self, uri: str):
        store, path = open_store(uri)
        self.file = store.open_input_file(path)
        head = np.frombuffer(self.file.read_at(8 * HEADER_WORDS, 0), dtype="<u8")
        if head[0] != MAGIC:
            raise ValueError(f"{uri} is not a token file")
        self.n_levels, self.n_docs, self.n_ids = (int(x) for x in head[3:6])
        n_sections = 3 + 3 * self.n_levels
        self.table = np.frombuffer(self.file.read_at(16 * n_sections, 8 * HEADER_WORDS), dtype="<u8").reshape(-1, 2)
        self.doc_ids, self.valid, self.offsets = (self.section(k, kind) for k, kind in enumerate(self.KINDS))
        self.levels = [
            Level(*(self.section(3 + 3 * k + j, kind) for j, kind in enumerate(("u1", "u1", "<u8"))))
            for k in range(self.n_levels)
        ]

    def section(self, k: int, kind: str) -> np.ndarray:
        at, size = (int(x) for x in self.table[k])
        return np.frombuffer(self.file.read_at(size, at), dtype=kind)

    def ids(self, first: int, count: int) -> np.ndarray:
        return read_ids(self.levels, first, count)

    def token(self, position: int) -> int:
        return int(self.ids(position, 1)[0])

    def document(self, k: int) -> np.ndarray:
        first, end = int(self.offsets[k]), int(self.offsets[k + 1])
        return self.ids(first, end - first)

    def checksums(self, ids_at_once: int = 1 << 20) -> Iterator[int]:
        """CRC-32 of each document's ids as little-endian unsigned 32-bit integers."""
        first = 0
        while first < self.n_docs:
            last = max(int(np.searchsorted(self.offsets, self.offsets[first] + np.uint64(ids_at_once), "right")) - 1, first + 1)
            start = int(self.offsets[first])
            held = memoryview(self.ids(start, int(self.offsets[last]) - start).astype("<u4").tobytes())
            for k in range(first, last):
                yield zlib.crc32(held[4 * (int(self.offsets[k]) - start) : 4 * (int(self.offsets[k + 1]) - start)])
            first = last

    def close(self) -> None:
        self.file.close()


# --- encoding ------------------------------------------------------------------------------------


#: Marks that are never part of a word's piece; the apostrophe, which may open a contraction, is not one.
MARKS = "!\"#$%&()*+,-./:;<=>?@[\\]^_`{|}~"


def id_width(definition: str) -> str:
    """Type that holds every id of a tokenizer."""
    parts = json.loads(definition)
    model = parts["model"]["vocab"]
    known = model.values() if isinstance(model, dict) else range(len(model))
    return "<u2" if max([*known, *(t["id"] for t in parts.get("added_tokens", []))]) < 1 << 16 else "<u4"


class LibraryEncoder:
    """The tokenizers library behind a cache of chunks.

    Texts are cut only where the byte-level pre-tokenizer has a boundary for
    certain: before a single space, before a single line feed, and between a letter
    and the marks that end a chunk. Arrow splits a block of texts and numbers its
    different chunks; the library encodes those that are new, joined into one text,
    and hands the ids back by their byte lengths. Texts that hold an added token, and
    all texts under another pre-tokenizer, go to the library whole.
    """

    def __init__(self, definition: str, cache_entries: int = 1_000_000):
        os.environ.setdefault("TOKENIZERS_PARALLELISM", "false")
        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_str(definition)
        parts = json.loads(definition)
        pre = parts.get("pre_tokenizer") or {}
        plain = pre.get("type") == "ByteLevel" and not pre.get("add_prefix_space") and pre.get("use_regex", True)
        self.by_chunks = plain and not parts.get("normalizer")
        self.added = [t["content"] for t in parts.get("added_tokens", [])]
        vocabulary = self.tokenizer.get_vocab(with_added_tokens=True)
        self.sizes = np.zeros(max(vocabulary.values()) + 1, dtype=np.int64)
        for token, k in vocabulary.items():
            self.sizes[k] = len(token)
        self.width = id_width(definition)
        self.cache_entries = cache_entries
        # The cache: chunks, and where their ids stand; numbers and texts in arrays, so an entry takes about 40 bytes.
        self.names = pa.array([], type=pa.large_string())
        self.ids = np.empty(0, dtype=self.width)
        self.first, self.count, self.used = np.empty(0, dtype=np.int64), np.empty(0, dtype=np.int32), np.empty(0, dtype=bool)
        self.marks: dict[str, bytes] = {}

    def whole(self, text: str) -> bytes:
        return np.array(self.tokenizer.encode(text, add_special_tokens=False).ids, dtype=self.width).tobytes()

    def mark(self, marks: str) -> bytes:
        known = self.marks.get(marks)
        if known is None:
            known = self.whole(marks)
            if len(self.marks) < 10_000:
                self.marks[marks] = known
        return known

    def encode_chunks(self, chunks: list[str]) -> list[bytes]:
        """Ids of chunks by the library. A chunk stands behind a space, or begins with a line feed."""
        out: list[bytes] = []
        for k in range(0, len(chunks), 8192):
            part = chunks[k : k + 8192]
            text = "".join([c if c[0] == "\n" else " " + c for c in part])
            (found,) = self.tokenizer.encode_batch_fast([text], add_special_tokens=False)
            ids = np.array(found.ids, dtype=self.width)
            ends = np.cumsum(self.sizes[ids])
            wanted = np.cumsum([len(c.encode()) + (c[0] != "\n") for c in part])
            cuts = np.searchsorted(ends, wanted)
            if not np.array_equal(ends[cuts], wanted):
                raise ValueError("a chunk does not end at a token")
            packed, first = ids.tobytes(), 0
            for cut in ((cuts + 1) * ids.itemsize).tolist():
                out.append(packed[first:cut])
                first = cut
        return out

    def learn(self, chunks: list[str], at: list[int]) -> None:
        """Add entries for chunks that have none, in their order. A chunk that ends with marks is put together from its word and them.

        ``at``: the entries of the chunks without their marks, -1 where there is none.
        """
        bases: dict[int, str] = {}
        new: dict[str, bytes] = {}
        for k, chunk in enumerate(chunks):
            base = chunk.rstrip(MARKS)
            if base != chunk and base[-1:].isalpha():
                bases[k] = base
            elif chunk:
                new[chunk] = b""
        known = {bases[k]: self.ids[self.first[n] : self.first[n] + self.count[n]].tobytes() for k, n in enumerate(at) if n >= 0 and k in bases}
        extra = list(dict.fromkeys(w for w in bases.values() if w not in known and w not in new))
        asked = [*new, *extra]
        new = dict(zip(asked, self.encode_chunks(asked)))
        out = []
        for k, chunk in enumerate(chunks):
            base = bases.get(k)
            if base is not None:
                out.append((new[base] if base in new else known[base]) + self.mark(chunk[len(base) :]))
            else:
                out.append(new[chunk] if chunk else self.whole(" "))
        out += [new[w] for w in extra]
        count = np.fromiter(map(len, out), dtype=np.int32, count=len(out)) // np.dtype(self.width).itemsize
        self.first = np.concatenate([self.first, len(self.ids) + np.cumsum(count) - count])
        self.count = np.concatenate([self.count, count])
        self.ids = np.concatenate([self.ids, np.frombuffer(b"".join(out), dtype=self.width)])
        self.names = pa.concat_arrays([self.names, pa.array(chunks + extra, type=pa.large_string())])
        self.used = np.concatenate([self.used, np.ones(len(out), dtype=bool)])

    def forget(self) -> None:
        """Keep the entries that were asked for since the last time; none if that is almost all of them."""
        keep = np.flatnonzero(self.used) if 4 * self.used.sum() < 3 * len(self.used) else np.empty(0, dtype=np.int64)
        count, first = self.count[keep], self.first[keep]
        ends = np.cumsum(count)
        self.ids = self.ids[np.repeat(first - (ends - count), count) + np.arange(ends[-1] if len(ends) else 0)]
        self.names, self.first, self.count = self.names.take(pa.array(keep)), ends - count, count
        self.used = np.zeros(len(keep), dtype=bool)

    def entries(self, chunks: pa.Array) -> np.ndarray:
        """Numbers of the entries of different chunks."""
        if len(self.names) > self.cache_entries:
            self.forget()
        both = pa.concat_arrays([chunks, pc.utf8_rtrim(chunks, MARKS)])
        numbers, of_base = pc.index_in(both, value_set=self.names).fill_null(-1).to_numpy().astype(np.int64).reshape(2, -1)
        missing = numbers < 0
        self.used[numbers[~missing]] = True
        if missing.any():
            numbers[missing] = len(self.names) + np.arange(missing.sum())
            self.learn(chunks.filter(pa.array(missing)).to_pylist(), of_base[missing].tolist())
        return numbers

    def chunked(self, texts: list[str]) -> list[bytes]:
        """Ids of texts without their first chunk, cut at every space."""
        if not texts:
            return []
        split = pc.split_pattern(pa.array(texts, type=pa.large_string()), " ")
        numbered = split.values.dictionary_encode()
        entry = self.entries(numbered.dictionary)
        codes = numbered.indices.to_numpy()
        each = self.count[entry][codes]
        ends = np.zeros(len(each) + 1, dtype=np.int32)  # a block has far fewer ids than 2 ** 31
        np.cumsum(each, out=ends[1:])
        out = self.ids[np.repeat(self.first[entry].astype(np.int32)[codes] - ends[:-1], each) + np.arange(ends[-1], dtype=np.int32)]
        cuts = ends[split.offsets.to_numpy()].tolist()
        return [out[a:b].tobytes() for a, b in zip(cuts, cuts[1:])]

    def group(self, texts: list[str]) -> list[bytes]:
        out: list[bytes] = []
        rests: list[str] = []
        rest_of: list[int] = []
        for text in texts:
            if not self.by_chunks or not cuttable(text) or any(t in text for t in self.added):
                out.append(self.whole(text) if text else b"")
                continue
            if "\n" in text and cuttable(text, "\n"):
                text = text.replace("\n", " \n")
            head, space, rest = text.partition(" ")
            if space:
                rest_of.append(len(out))
                rests.append(rest)
            out.append(self.whole(head) if head else b"")
        for k, ids in zip(rest_of, self.chunked(rests)):
            out[k] += ids
        return out

    def encode_all(self, texts: Iterator[str], chars: int = 1 << 23) -> Iterator[bytes]:
        """Ids of each text in turn; about ``chars`` characters are in work at a time."""
        waiting: list[str] = []
        counts: list[int] = []
        size = 0

        def flush() -> Iterator[bytes]:
            found = self.group(waiting)
            at = 0
            for n in counts:
                yield b"".join(found[at : at + n])
                at += n

        for text in texts:
            parts = list(slices(text)) if self.by_chunks and not any(t in text for t in self.added) else [text]
            waiting += parts
            counts.append(len(parts))
            size += len(text)
            if size >= chars:
                yield from flush()
                waiting, counts, size = [], [], 0
        yield from flush()


_ENCODERS: dict[int, LibraryEncoder] = {}


def _encoder(definition: str) -> LibraryEncoder:
    key = zlib.crc32(definition.encode())
    if key not in _ENCODERS:
        _ENCODERS.clear()
        _ENCODERS[key] = LibraryEncoder(definition)
    return _ENCODERS[key]


# --- operator ------------------------------------------------------------------------------------


MANIFEST = "place int, part int, path string, n_docs long, n_ids long"


def write_tokens(
    df: DataFrame,
    tokenizer: str,
    end_id: int = 0,
    id_col: str = "doc_id",
    text_col: str = "text",
    folder: str | None = None,
    shards: int | None = None,
    file_ids: int = 4_000_000,
) -> DataFrame:
    """Encode, order and write; returns the manifest of files in order.

    ``tokenizer`` is the path of a definition on the driver. Bounds of the order
    come from quantiles of the id column alone; a row goes to its place in one
    shuffle that carries compressed ids. A file ends after ``file_ids`` ids.
    """
    import zstandard

    spark = df.sparkSession
    folder = folder or new_folder(spark, "tokens")
    shards = shards or int(spark.conf.get("spark.sql.shuffle.partitions"))
    with open(tokenizer) as f:
        text = f.read()
    definition, width = spark.sparkContext.broadcast(text), id_width(text)
    rows = df.select(
        F.col(id_col).cast("long").alias("id"), F.coalesce(F.col(text_col), F.lit("")).alias("text")
    ).withColumn("tie", F.xxhash64("text"))
    found = rows.select("id").dropna().approxQuantile("id", [k / shards for k in range(1, shards)], 0.1 / shards)
    bounds = np.array(sorted(map(int, found)), dtype=np.int64)
    lowest = np.iinfo(np.int64).min

    def encode(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encoder = _encoder(definition.value)
        packer = zstandard.ZstdCompressor(level=1)
        end = np.array([end_id], dtype=width).tobytes()
        size = np.dtype(width).itemsize
        for batch in batches:
            keys = np.array([lowest if x is None else x for x in batch.column(0).to_pylist()], dtype=np.int64)
            ties = batch.column(2).to_numpy()
            low, high = np.searchsorted(bounds, keys, "left"), np.searchsorted(bounds, keys, "right")
            share = (ties.astype(np.float64) + 2.0**63) / 2.0**64
            place = np.minimum(low + np.floor(share * (high - low + 1)).astype(np.int64), high)
            at = 0
            for start in range(0, batch.num_rows, 2048):
                part = batch.slice(start, 2048)
                packed, counts = [], []
                for ids in encoder.encode_all(x.as_py() for x in part.column(1)):
                    packed.append(packer.compress(ids + end))
                    counts.append(len(ids) // size + 1)
                n = len(packed)
                yield pa.RecordBatch.from_arrays(
                    [
                        pa.array(place[at : at + n], type=pa.int32()),
                        part.column(0),
                        part.column(2),
                        pa.array(counts, type=pa.int64()),
                        pa.array(packed, type=pa.binary()),
                    ],
                    names=["place", "id", "tie", "n", "ids"],
                )
                at += n

    def write(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        _ENCODERS.clear()  # all texts are encoded by now, and files take memory
        pa.default_memory_pool().release_unused()
        unpacker = zstandard.ZstdDecompressor()
        place, part, docs, lengths, ids, held = None, 0, [], [], [], 0

        def flush() -> pa.RecordBatch:
            path = f"{folder}/shard-{place:06d}-{part:05d}.dac"
            write_file(path, docs, np.concatenate(ids), np.array(lengths, dtype=np.uint64))
            values = [place, part, path, len(docs), sum(lengths)]
            kinds = [pa.int32(), pa.int32(), pa.string(), pa.int64(), pa.int64()]
            return pa.RecordBatch.from_arrays(
                [pa.array([v], type=k) for v, k in zip(values, kinds)], names=["place", "part", "path", "n_docs", "n_ids"]
            )

        for batch in batches:
            for where, doc, _, n, packed in zip(*(batch.column(k) for k in range(5))):
                where, n = where.as_py(), n.as_py()
                if docs and (where != place or held + n > file_ids):
                    yield flush()
                    part = part + 1 if where == place else 0
                    docs, lengths, ids, held = [], [], [], 0
                place = where
                docs.append(doc.as_py())
                lengths.append(n)
                ids.append(np.frombuffer(unpacker.decompress(packed.as_py()), dtype=width))
                held += n
        if docs:
            yield flush()

    encoded = rows.mapInArrow(encode, "place int, id long, tie long, n long, ids binary")
    ordered = encoded.repartitionById(shards, F.col("place")).sortWithinPartitions("place", F.col("id").asc_nulls_first(), "tie")
    return materialize(ordered.mapInArrow(write, MANIFEST), "token-manifest")


def read_tokens(manifest: DataFrame, id_col: str = "doc_id") -> DataFrame:
    """One row per document from the files: start, number of ids, checksum.

    The running start is taken over the files (one row each), never over documents.
    """
    before = W.orderBy("place", "part").rowsBetween(W.unboundedPreceding, -1)
    files = manifest.withColumn("start", F.coalesce(F.sum("n_ids").over(before), F.lit(0)))
    schema = f"`{id_col}` long, start long, n_tokens long, ids_crc32 long"

    def read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for path, start in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()):
                file = TokenFile(path)
                counts = np.diff(file.offsets.astype(np.int64))
                sums = list(file.checksums())
                yield pa.RecordBatch.from_arrays(
                    [
                        pa.array(file.doc_ids.astype(np.int64), mask=file.valid == 0),
                        pa.array(file.offsets[:-1].astype(np.int64) + start),
                        pa.array(counts),
                        pa.array(sums, type=pa.int64()),
                    ],
                    names=[id_col, "start", "n_tokens", "ids_crc32"],
                )
                file.close()

    width = int(manifest.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    return files.select("path", "start").repartition(width, "path").mapInArrow(read, schema)


def op10_token_store(spark: SparkSession, sf_dir: str) -> DataFrame:
    import public_tokenizers

    manifest = write_tokens(read_table(spark, sf_dir, "documents"), public_tokenizers.path("byte_bpe_50k.json"))
    return read_tokens(manifest)
