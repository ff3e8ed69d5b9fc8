"""Operator 1: byte-level BPE encoding and decoding.

Bytes are mapped to Latin-1 so that an Aho-Corasick automaton over the
vocabulary can report, in one pass, the longest token that starts at every
byte. The encoder takes the longest token, checks that it may follow the one
before it (the two, merged alone, stay the same two tokens; the answer is
memoised), and otherwise backs off to the next shorter prefix token or to the
previous position. Every position is refuted at most once, so the work is
linear in the bytes, and the result is the sequence that merging by rank gives.

Defined results: a null text counts as empty; an empty text has no ids; rows
are independent, so repeated rows give repeated results; columns other than the
id and the text are ignored; an empty table gives an empty result. Texts are
encoded whole, in slices cut at certain boundaries, so memory stays bounded by
the text and its ids.
"""

from __future__ import annotations

import base64
import hashlib
from array import array
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .shared import read_table
from .textcut import cuttable, slices

NO_TOKEN = -1


def load_ranks(path: str) -> dict[bytes, int]:
    with open(path, "rb") as lines:
        return {base64.b64decode(token): int(rank) for token, rank in map(bytes.split, lines)}


class BytePairCodec:
    """Encoder and decoder for a table of ranks and a pre-tokenizer pattern."""

    def __init__(self, ranks: dict[bytes, int], pattern: str, cache_entries: int = 500_000):
        import ahocorasick
        import regex

        self.ranks = ranks
        self.pattern = regex.compile(pattern)
        self.cache_entries = cache_entries
        self.token_bytes = [b""] * (max(ranks.values()) + 1)
        for token, rank in ranks.items():
            self.token_bytes[rank] = token
        self.sizes = list(map(len, self.token_bytes))
        self.automaton = ahocorasick.Automaton()
        self.prefix: dict[int, int] = {}
        for token, rank in ranks.items():
            if self.merged(token) == [rank]:
                self.automaton.add_word(token.decode("latin-1"), rank)
        self.automaton.make_automaton()
        self.fits: dict[int, bool] = {}
        self.pieces: dict[str, bytes] = {}
        self.chunks: dict[str, bytes] = {}

    def merged(self, piece: bytes) -> list[int]:
        """Ids by repeated merging of the pair of lowest rank; for short byte strings."""
        ranks = self.ranks
        parts = [piece[i : i + 1] for i in range(len(piece))]
        while len(parts) > 1:
            options = [(ranks[pair], i) for i in range(len(parts) - 1) if (pair := parts[i] + parts[i + 1]) in ranks]
            if not options:
                break
            i = min(options)[1]
            parts[i : i + 2] = [parts[i] + parts[i + 1]]
        return [ranks[part] for part in parts]

    def compatible(self, left: int, right: int) -> bool:
        """True if the two tokens, merged alone, stay these two; remembered in ``fits``."""
        if len(self.fits) >= 2 * self.cache_entries:
            self.fits.clear()
        known = self.fits[left << 32 | right] = self.merged(self.token_bytes[left] + self.token_bytes[right]) == [left, right]
        return known

    def shorter(self, token: int) -> int:
        """The longest token that is a proper prefix of ``token``."""
        known = self.prefix.get(token)
        if known is None:
            whole, known = self.token_bytes[token].decode("latin-1"), NO_TOKEN
            for n in range(len(whole) - 1, 0, -1):
                if whole[:n] in self.automaton:
                    known = self.ranks[whole[:n].encode("latin-1")]
                    break
            self.prefix[token] = known
        return known

    def longest_matches(self, piece: bytes) -> array:
        longest = array("i", [NO_TOKEN]) * len(piece)
        sizes = self.sizes
        for end, token in self.automaton.iter(piece.decode("latin-1")):
            longest[end + 1 - sizes[token]] = token  # ends ascend, so the longest is stored last
        return longest

    def backtrack(self, piece: bytes) -> list[int]:
        """Ids of one pre-tokenizer match."""
        whole = self.ranks.get(piece)
        if whole is not None:
            return [whole]
        n, sizes, fits = len(piece), self.sizes, self.fits
        longest = self.longest_matches(piece)
        open_at = bytearray(b"\x01") * (n + 1)
        path: list[int] = []
        at, token = 0, longest[0]
        while at < n:
            while token != NO_TOKEN:
                end = at + sizes[token]
                if open_at[end]:
                    if not path:
                        break
                    fit = fits.get(path[-1] << 32 | token)
                    if self.compatible(path[-1], token) if fit is None else fit:
                        break
                token = self.shorter(token)
            if token != NO_TOKEN:
                path.append(token)
                at = end
                token = longest[at] if at < n else NO_TOKEN
            else:
                open_at[at] = 0
                if not path:
                    raise ValueError("the vocabulary cannot express this text")
                token = path.pop()
                at -= sizes[token]
        return path

    def encode_piece(self, piece: str) -> bytes:
        known = self.pieces.get(piece)
        if known is None:
            known = np.array(self.backtrack(piece.encode()), dtype="<u4").tobytes()
            if len(piece) <= 64:
                if len(self.pieces) >= self.cache_entries:
                    self.pieces.clear()
                self.pieces[piece] = known
        return known

    def encode_chunk(self, chunk: str) -> bytes:
        return b"".join(map(self.encode_piece, self.pattern.findall(chunk)))

    def encode_slice(self, text: str) -> bytes:
        if not cuttable(text):
            return self.encode_chunk(text)
        first, *rest = text.split(" ")
        chunks = self.chunks
        out = [self.encode_chunk(first)]
        for word in rest:
            known = chunks.get(word)
            if known is None:
                known = self.encode_chunk(" " + word)
                if len(word) <= 64:
                    if len(chunks) >= self.cache_entries:
                        chunks.clear()
                    chunks[word] = known
            out.append(known)
        return b"".join(out)

    def encode(self, text: str) -> bytes:
        """All ids as little-endian unsigned 32-bit integers."""
        return b"".join(map(self.encode_slice, slices(text)))

    def decode(self, ids: bytes) -> bytes:
        lookup = self.token_bytes.__getitem__
        return b"".join(map(lookup, np.frombuffer(ids, dtype="<u4").tolist()))


_CODECS: dict[tuple, BytePairCodec] = {}


def _codec(key: str, ranks: dict[bytes, int], pattern: str) -> BytePairCodec:
    """One codec for a worker, kept between its tasks."""
    if (key, pattern) not in _CODECS:
        _CODECS.clear()
        _CODECS[key, pattern] = BytePairCodec(ranks, pattern)
    return _CODECS[key, pattern]


def encode_decode(
    df: DataFrame, vocabulary: str, pattern: str, id_col: str = "doc_id", text_col: str = "text", with_ids: bool = True
) -> DataFrame:
    """Encode each text and decode the ids again.

    ``vocabulary`` is the path of a rank file on the driver; its contents (below
    1 MB, a property of the vocabulary, not of the data) are sent with the tasks.
    Returns ``id_col``, ``n_tokens``, ``ids_sha256``, ``decoded_sha256`` and, if
    asked for, ``ids`` and ``decoded`` (binary).
    """
    with open(vocabulary, "rb") as f:
        key = hashlib.sha256(f.read()).hexdigest()
    ranks = df.sparkSession.sparkContext.broadcast(load_ranks(vocabulary))
    schema = f"`{id_col}` long, n_tokens long, ids_sha256 string, decoded_sha256 string"
    if with_ids:
        schema += ", ids binary, decoded binary"

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        codec = _codec(key, ranks.value, pattern)
        for batch in batches:
            columns: list[list] = [[], [], [], [], []]
            for text in batch.column(1):
                ids = codec.encode(text.as_py() or "")
                decoded = codec.decode(ids)
                row = (len(ids) // 4, hashlib.sha256(ids).hexdigest(), hashlib.sha256(decoded).hexdigest(), ids, decoded)
                for column, value in zip(columns, row if with_ids else row[:3]):
                    column.append(value)
            kinds = [pa.int64(), pa.string(), pa.string(), pa.binary(), pa.binary()][: 5 if with_ids else 3]
            arrays = [batch.column(0), *(pa.array(c, type=k) for c, k in zip(columns, kinds))]
            names = [id_col, "n_tokens", "ids_sha256", "decoded_sha256", "ids", "decoded"][: len(arrays)]
            yield pa.RecordBatch.from_arrays(arrays, names=names)

    return df.select(F.col(id_col).cast("long").alias("id"), F.col(text_col).alias("text")).mapInArrow(run, schema)


def op1_byte_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    import public_tokenizers

    return encode_decode(
        read_table(spark, sf_dir, "documents"),
        public_tokenizers.path("byte_bpe_multi_50k.tiktoken"),
        public_tokenizers.PATTERN,
        with_ids=False,
    )
