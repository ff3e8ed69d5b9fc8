"""Operator 7: near-duplicate groups by MinHash and a multi-index Hamming join.

Documents with equal shingle sets form a class; everything below works on
classes. Every class has a signature of ``SYMBOLS`` min-hashes of ``BITS`` bits
and a longer sketch of ``SKETCH`` one-byte min-hashes.

Candidates. The signature is split into chunks of four symbols. Two signatures at
distance ``LIMIT`` (in symbols) or less have, by pigeonhole, a chunk with at most
two differing symbols; each chunk therefore emits the keys that leave out every
choice of two symbols, and all pairs within the distance share a key. Classes that
share a key are candidates if their signatures are at distance ``LIMIT`` or less. A
pair at the threshold similarity 0.75 is further apart with probability 3e-7.

Links. A candidate is compared only if the set sizes allow it and the sketches agree
on ``AGREE`` bytes (a pair at 0.75 falls short with probability 3e-6). No pairs of a
bucket are listed. First each class proposes its best partner and the centre of its
bucket; these are confirmed on full shingle sets and joined to components. A large
bucket is dealt into blocks for that, each row into one; the blocks differ from key to
key. Then, in each bucket that holds several components, the classes outside its most
frequent component meet all others, and each bucket emits, for each class, one list of
the other components it has a candidate in; the lists of a class are merged, and the
class is compared, exactly, with all members of each component through an inverted
index. So no link between components is lost, and a group of near copies that hangs
together after the first step is never compared with itself.

Bounds: a task holds a block of ``BLOCK`` rows and, in the second step, the rows of its
bucket outside the most frequent component, which go to every block of the bucket.

Defined results: words are lower-cased in A-Z only and split at ASCII white space;
a null, empty or blank text has no shingle, links with nothing and is its own
component; repeated rows share a class; a class's component id is the smallest
non-null id of its component, and rows with a null id are kept only if the whole
component has null ids. Repeated ids are separate documents. Other columns are
carried along by ``keep_one`` and ignored by ``near_duplicates``.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator
from itertools import combinations

import numpy as np
import pandas as pd
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from .components import connected_components
from .shared import fresh_names, materialize, read_table, row_key, sorted_groups

WORDS = 5
PERCENT = 75
CHUNK = 4
SYMBOLS = 20
ERRORS = 2
LIMIT = (ERRORS + 1) * (SYMBOLS // CHUNK) - 1
BITS = 32
SKETCH = 128
AGREE = 73
BLOCK = 1_024
COMPARE_BLOCK = 1_000

_RANDOM = np.random.default_rng(2024)
_FACTORS = _RANDOM.integers(1, 1 << 63, size=SYMBOLS + SKETCH, dtype=np.uint64) | np.uint64(1)
_SHIFTS = _RANDOM.integers(0, 1 << 63, size=SYMBOLS + SKETCH, dtype=np.uint64)
_MIX = np.uint64(0x9E3779B97F4A7C15)


class _WordHashes(dict):
    def __missing__(self, word: bytes) -> int:
        if len(self) > 200_000:
            self.clear()
        value = self[word] = xxhash.xxh3_64_intdigest(word)
        return value


_HASHES = _WordHashes()


def shingles(text: str | None) -> np.ndarray:
    """Sorted distinct 64-bit hashes of the shingles of a text."""
    words = (text or "").encode().lower().split()  # bytes: A-Z and ASCII white space only
    if not words:
        return np.empty(0, dtype=np.uint64)
    h = np.fromiter(map(_HASHES.__getitem__, words), dtype=np.uint64, count=len(words))
    width = min(WORDS, len(h))
    mixed = np.full(len(h) - width + 1, width, dtype=np.uint64)
    for j in range(width):
        mixed = (mixed ^ h[j : len(h) - width + 1 + j]) * _MIX
        mixed ^= mixed >> np.uint64(31)
    return np.unique(mixed)


def min_hashes(rows: np.ndarray) -> np.ndarray:
    least = np.full(SYMBOLS + SKETCH, np.iinfo(np.uint64).max)
    for start in range(0, len(rows), 2048):
        part = rows[start : start + 2048]
        least = np.minimum(least, (part[None] * _FACTORS[:, None] + _SHIFTS[:, None]).min(axis=1))
    return least


def _finish(least: np.ndarray) -> np.ndarray:
    least = least ^ (least >> np.uint64(32))
    return (least * _MIX) >> np.uint64(32)


def describe(df: DataFrame, id_col: str, text_col: str) -> DataFrame:
    """One row a document: id, row hash, class (hash of the set), set size, signature, sketch."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for start in range(0, batch.num_rows, 1024):
                part = batch.slice(start, 1024)
                nodes, sizes, signatures, sketches = [], [], [], []
                for text in part.column(2):
                    found = shingles(text.as_py())
                    sizes.append(len(found))
                    if len(found):
                        values = _finish(min_hashes(found))
                        nodes.append(hashlib.blake2b(found.tobytes(), digest_size=16).digest())
                        signatures.append((values[:SYMBOLS] >> np.uint64(32 - BITS)).astype("<u4").tobytes())
                        sketches.append((values[SYMBOLS:] & np.uint64(255)).astype(np.uint8).tobytes())
                    else:
                        nodes.append(None)
                        signatures.append(None)
                        sketches.append(None)
                yield pa.RecordBatch.from_arrays(
                    [
                        part.column(0),
                        part.column(1),
                        pa.array(nodes, type=pa.binary()),
                        pa.array(sizes, type=pa.int64()),
                        pa.array(signatures, type=pa.binary()),
                        pa.array(sketches, type=pa.binary()),
                    ],
                    names=["id", "row", "node", "n", "signature", "sketch"],
                )

    rows = df.select(F.col(id_col).cast("long").alias("id"), row_key(id_col, text_col).alias("row"), F.col(text_col).alias("text"))
    return rows.mapInArrow(run, "id long, row binary, node binary, n long, signature binary, sketch binary")


def chunk_keys(classes: DataFrame) -> DataFrame:
    """(key, node): each chunk with each choice of ``ERRORS`` symbols left out."""
    keys = []
    for c in range(SYMBOLS // CHUNK):
        for kept in combinations(range(c * CHUNK, (c + 1) * CHUNK), CHUNK - ERRORS):
            keys.append(F.xxhash64(F.lit("-".join(map(str, kept))), *(F.substring("signature", 4 * k + 1, 4) for k in kept)))
    return classes.select("node", F.explode(F.array(*keys)).alias("key"))


def bucket_rows(classes: DataFrame) -> DataFrame:
    """Members of every bucket with two classes or more: key, part, node, n, signature, sketch; a large bucket is dealt into parts."""
    keys = chunk_keys(classes)
    sizes = keys.groupBy("key").agg(F.count(F.lit(1)).alias("m")).where(F.col("m") > 1)
    members = keys.join(sizes, "key").join(classes.select("node", "n", "signature", "sketch"), "node")
    part = F.pmod(F.xxhash64("node", "key"), F.ceil(F.col("m") / BLOCK)).cast("int").alias("part")
    return members.select("key", part, "node", "n", "signature", "sketch")


class _Members:
    """Classes of a block and which of them are candidates for each other."""

    def __init__(self, table: pa.Table):
        self.nodes = table.column("node").to_pylist()
        self.sizes = table.column("n").to_numpy()
        self.signature = np.frombuffer(b"".join(table.column("signature").to_pylist()), dtype="<u4").reshape(-1, SYMBOLS)
        self.sketch = np.frombuffer(b"".join(table.column("sketch").to_pylist()), dtype=np.uint8).reshape(-1, SKETCH)

    def against_all(self, lines: np.ndarray) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray]]:
        """By blocks of ``lines``: the lines, agreeing bytes of the sketches, candidates."""
        step = max(1, (1 << 22) // max(1, len(self.nodes) * SKETCH))
        for k in range(0, len(lines), step):
            part = lines[k : k + step]
            apart = (self.signature[part, None, :] != self.signature[None, :, :]).sum(axis=2, dtype=np.int16)
            same = (self.sketch[part, None, :] == self.sketch[None, :, :]).sum(axis=2, dtype=np.int16)
            sizes = 100 * np.minimum(self.sizes[part, None], self.sizes[None]) >= PERCENT * np.maximum(self.sizes[part, None], self.sizes[None])
            fits = (apart <= LIMIT) & (same >= AGREE) & sizes
            fits[np.arange(len(part)), part] = False
            yield part, same, fits


def propose(rows: DataFrame) -> DataFrame:
    """(a, b): for each class its most similar partner, and the centre of the largest star it lies in."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for table in sorted_groups(batches, 2):
            members = _Members(table)
            nodes = members.nodes
            best, agree, degree = (np.zeros(len(nodes), dtype=np.int64) for _ in range(3))
            kept = []
            for part, same, fits in members.against_all(np.arange(len(nodes))):
                masked = np.where(fits, same, -1)
                best[part], agree[part], degree[part] = masked.argmax(axis=1), masked.max(axis=1), fits.sum(axis=1)
                kept.append(np.packbits(fits, axis=1))
            with_partner = np.flatnonzero(agree >= 0)
            if not len(with_partner):
                continue
            near = np.unpackbits(np.concatenate(kept), axis=1, count=len(nodes)).astype(bool)
            centre = np.full(len(nodes), -1)
            open_ = degree > 0
            while open_.any():
                c = int(np.argmax(np.where(open_, degree, -1)))
                star = near[c] & open_
                star[c] = False
                centre[star] = c
                open_ &= ~star
                open_[c] = False
            out = [(nodes[i], nodes[best[i]], int(agree[i]), None, 0) for i in with_partner]
            out += [(nodes[i], None, 0, nodes[c], int(degree[c])) for i, c in enumerate(centre.tolist()) if c >= 0]
            kinds = [pa.binary(), pa.binary(), pa.int64(), pa.binary(), pa.int64()]
            yield pa.RecordBatch.from_arrays(
                [pa.array(c, type=k) for c, k in zip(zip(*out), kinds)], names=["node", "best", "agree", "centre", "degree"]
            )

    found = _dealt(rows).mapInArrow(run, "node binary, best binary, agree long, centre binary, degree long")
    per_node = found.groupBy("node").agg(
        F.max(F.when(F.col("best").isNotNull(), F.struct("agree", "best"))).alias("s"),
        F.max(F.when(F.col("centre").isNotNull(), F.struct("degree", "centre"))).alias("c"),
    )
    ends = per_node.select("node", F.explode(F.array("s.best", "c.centre")).alias("other")).where(F.col("other").isNotNull())
    return ends.select(F.least("node", "other").alias("a"), F.greatest("node", "other").alias("b")).distinct()


def _dealt(rows: DataFrame) -> DataFrame:
    width = int(rows.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    return rows.repartition(width, "key", "part").sortWithinPartitions("key", "part", "node")


def similar(a: np.ndarray, b: np.ndarray) -> bool:
    shared = len(np.intersect1d(a, b, assume_unique=True))
    return 100 * shared >= PERCENT * (len(a) + len(b) - shared)


def confirm(pairs: DataFrame, texts: DataFrame) -> DataFrame:
    """The pairs (a, b) that are linked by their full shingle sets; a pair's two texts meet in one row."""
    left, right = texts.select(F.col("node").alias("a"), F.col("text").alias("ta")), texts.select(F.col("node").alias("b"), F.col("text").alias("tb"))
    both = pairs.join(left, "a").join(right, "b").select("a", "b", "ta", "tb")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            linked = [similar(shingles(x.as_py()), shingles(y.as_py())) for x, y in zip(batch.column(2), batch.column(3))]
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1)], names=["a", "b"]).filter(pa.array(linked, type=pa.bool_()))

    return both.mapInArrow(run, "a binary, b binary")


def across(rows: DataFrame, roots: DataFrame) -> DataFrame:
    """(node, root): classes with a candidate in another component, asked from the smaller component.

    Only buckets with several components matter. The rows of a bucket's most frequent component are dealt into its
    blocks; all others go to every block and meet them there, and each other in the block of the one that asks.
    """
    sizes = materialize(roots.groupBy("root").agg(F.count(F.lit(1)).alias("size")), "near-sizes")
    labels = roots.join(sizes, "root").select(F.col("node").alias("n_"), "root", "size")
    joined = rows.join(labels, F.col("node") == F.col("n_"), "left").select(
        "key", "node", "n", "signature", "sketch", F.coalesce("root", "node").alias("root"), F.coalesce("size", F.lit(1)).alias("size")
    )
    joined = materialize(joined, "near-labelled")
    counts = joined.groupBy("key", "root").agg(F.count(F.lit(1)).alias("c")).groupBy("key")
    mixed = counts.agg(F.count(F.lit(1)).alias("roots"), F.max(F.struct("c", "root")).alias("most"), F.sum("c").alias("m")).where(F.col("roots") > 1)
    mixed = materialize(mixed.select(F.col("key").alias("k_"), F.col("most.root").alias("most"), F.ceil(F.col("m") / BLOCK).cast("int").alias("g")), "near-mixed")
    other = F.col("root") != F.col("most")
    own = F.pmod(F.xxhash64("node", "key"), F.col("g")).cast("int")
    dealt = joined.join(mixed, F.col("key") == F.col("k_")).select(
        "key", F.explode(F.when(other, F.sequence(F.lit(0), F.col("g") - 1)).otherwise(F.array(own))).alias("part"),
        "node", "n", "signature", "sketch", "root", "size", other.alias("other"), own.alias("own"),
    )

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for table in sorted_groups(batches, 2):
            other = table.column("other").to_numpy()
            if not other.any():
                continue
            names, label = np.unique(np.array([r.hex() for r in table.column("root").to_pylist()]), return_inverse=True)
            size = table.column("size").to_numpy()
            mine = table.column("own").to_numpy() == table.column("part")[0].as_py()
            members = _Members(table)
            found: list[np.ndarray] = []
            for part, _, fits in members.against_all(np.flatnonzero(other)):
                i, j = np.nonzero(fits & (label[part, None] != label[None]))
                i = part[i]
                asks = (size[i] < size[j]) | ((size[i] == size[j]) & (label[i] > label[j]))
                asker, asked = np.where(asks, i, j), np.where(asks, j, i)
                here = mine[asker] | ~other[asked]
                found.append(np.unique(asker[here] * len(names) + label[asked[here]]))
            pairs = np.unique(np.concatenate(found))
            if len(pairs):
                asker, root = np.divmod(pairs, len(names))
                cut = np.flatnonzero(np.diff(asker)) + 1
                lists = [[bytes.fromhex(names[r]) for r in part] for part in np.split(root, cut)]
                yield pa.RecordBatch.from_arrays(
                    [pa.array([members.nodes[i] for i in asker[np.concatenate([[0], cut])]], type=pa.binary()), pa.array(lists, type=pa.list_(pa.binary()))],
                    names=["node", "roots"],
                )

    # A class's lists from all its buckets are merged before they become rows.
    lists = _dealt(dealt).mapInArrow(run, "node binary, roots array<binary>")
    merged = lists.groupBy("node").agg(F.array_distinct(F.flatten(F.collect_list("roots"))).alias("roots"))
    return merged.select("node", F.explode("roots").alias("root"))


def confirm_across(asked: DataFrame, roots: DataFrame, texts: DataFrame) -> DataFrame:
    """(a, b): component pairs with at least one link between them, by comparing in blocks."""
    asked = materialize(asked, "asked")
    wanted = asked.groupBy("root").agg(F.count(F.lit(1)).alias("askers"))
    members = wanted.join(roots.select("root", "node"), "root", "left").select("root", "askers", F.coalesce("node", "root").alias("node"))
    count = members.groupBy("root").agg(F.count(F.lit(1)).alias("size"), F.first("askers").alias("askers"))
    blocks = count.select("root", F.ceil(F.col("size") / COMPARE_BLOCK).cast("int").alias("mb"), F.ceil(F.col("askers") / COMPARE_BLOCK).cast("int").alias("ab"))
    blocks = materialize(blocks, "near-blocks")

    def side(df: DataFrame, own: str, other: str, asks: bool) -> DataFrame:
        """Rows dealt into their own blocks and repeated for each block of the other side."""
        placed = df.select("root", "node").join(blocks, "root").join(texts, "node")
        return placed.select(
            "root", "node", "text", F.lit(asks).alias("asks"),
            F.pmod(F.xxhash64("node"), F.col(own)).cast("int").alias(f"{own}_at"),
            F.explode(F.sequence(F.lit(0), F.col(other) - 1)).alias(f"{other}_at"),
        )

    met = side(members, "mb", "ab", False).unionByName(side(asked, "ab", "mb", True))

    def meet(group: pd.DataFrame) -> pd.DataFrame:
        have, ask = group[~group["asks"]], group[group["asks"]]
        out = []
        if len(have) and len(ask):
            sets = [shingles(t) for t in have["text"]]
            sizes = np.array([len(s) for s in sets])
            values, owner = np.concatenate(sets), np.repeat(np.arange(len(sets)), sizes)
            order = np.argsort(values, kind="stable")
            values, owner = values[order], owner[order]
            for node, text in zip(ask["node"], ask["text"]):
                mine = shingles(text)
                low, high = np.searchsorted(values, mine, "left"), np.searchsorted(values, mine, "right")
                n = high - low
                at = np.repeat(low - np.concatenate([[0], np.cumsum(n)[:-1]]), n) + np.arange(n.sum())
                shared = np.bincount(owner[at], minlength=len(sets))
                if (100 * shared >= PERCENT * (len(mine) + sizes - shared)).any():
                    out.append((node, have["root"].iloc[0]))
        return pd.DataFrame(out, columns=["a", "b"])

    return met.groupBy("root", "mb_at", "ab_at").applyInPandas(meet, "a binary, b binary")


def near_duplicates(df: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Per document: id, n_shingles, component_id, kept; and ``row``, a 128-bit hash of id and text."""
    described = materialize(describe(df, id_col, text_col), "near-described")
    classes = described.where(F.col("node").isNotNull()).groupBy("node").agg(
        F.min("row").alias("row"), F.first("n").alias("n"), F.first("signature").alias("signature"), F.first("sketch").alias("sketch")
    )
    classes = materialize(classes, "near-classes")
    rows = materialize(bucket_rows(classes), "near-buckets")
    # One text for each class that shares a bucket.
    needed = classes.select("node", F.col("row").alias("r_")).join(rows.select("node").distinct(), "node", "left_semi")
    source = df.select(row_key(id_col, text_col).alias("row"), F.col(text_col).alias("text"))
    texts = source.join(needed, F.col("row") == F.col("r_")).groupBy("node").agg(F.first("text").alias("text"))
    texts = materialize(texts, "near-texts")

    links = materialize(confirm(propose(rows), texts), "near-links")
    roots = materialize(connected_components(links), "near-roots")
    more = confirm_across(across(rows, roots), roots, texts)
    # Links between components, as links between their roots.
    rooted = more.join(roots.select(F.col("node").alias("a"), F.col("root").alias("ra")), "a", "left")
    between = materialize(rooted.select(F.coalesce("ra", "a").alias("a"), "b"), "near-between")
    final = connected_components(links.unionByName(between))

    labelled = described.join(final.select(F.col("node").alias("f_"), "root"), F.col("node") == F.col("f_"), "left")
    own = F.coalesce(F.col("root"), F.col("node"))
    named = labelled.select("id", "row", F.col("n").alias("n_shingles"), own.alias("root"))
    named = materialize(named, "near-named")
    least = named.where(F.col("root").isNotNull()).groupBy("root").agg(F.min("id").alias("least")).select(F.col("root").alias("l_"), "least")
    least = materialize(least, "near-least")
    out = named.join(least, F.col("root") == F.col("l_"), "left")
    component = F.when(F.col("root").isNull(), F.col("id")).otherwise(F.col("least"))
    return out.select(
        F.col("id").alias(id_col), "n_shingles", component.alias("component_id"), F.col("id").eqNullSafe(component).alias("kept"), "row"
    )


def keep_one(df: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row of ``df`` for each group, with all its columns. Of rows that repeat both id and text one stays, any of them."""
    name, own, place = fresh_names(df.columns, "kept_row", "own_row", "place_in_row")
    kept = near_duplicates(df, id_col, text_col).where("kept").select(F.col("row").alias(name)).distinct()
    met = df.withColumn(own, row_key(id_col, text_col)).join(kept, F.col(own) == F.col(name), "left_semi")
    numbered = met.withColumn(place, F.row_number().over(W.partitionBy(own).orderBy(own)))
    return numbered.where(F.col(place) == 1).drop(own, place)


def op7_near_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return near_duplicates(read_table(spark, sf_dir, "documents")).drop("row")
