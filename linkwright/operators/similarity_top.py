"""Top-k similarity join without a row for each pair.

The same weights, similarities and ties as ``top_k(similar_pairs(...), k)``, for
tables whose pairs are too many to be written:

1. Term counts are packed where the rows are, in bundles of one block and side: a list
   of distinct terms and, for each row, places in that list and counts. Where the side of
   a row is known by its key only, bundles are split by side afterwards, where they are: only
   the sides travel, a few bits a row. So no text is shuffled.
2. Only the lists are dealt by term, to count the index rows of each term, and return
   to their bundles; no dictionary of a block is ever in one place. Dropped terms and
   those of one side alone leave the bundles; lengths of vectors are taken before the latter go.
3. Bundles of a block are gathered into groups of bounded size. A task multiplies one
   group of the index with one of the queries, bundle by bundle, and returns the ``k`` best index rows of
   each query; those of all groups are ranked together at the end.

The work still grows with the square of a block; what is written grows with groups
times postings of 5 bytes. Terms are known by a 64-bit hash.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark import StorageLevel
from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..functions.fixed import MAX_DF, MIN_SIMILARITY
from .similarity_join import DIGITS, top_k

#: Rows of a group: of the index, held by a task as a whole, and of the queries.
INDEX_ROWS, QUERY_ROWS = 32_768, 32_768
#: One of so many terms is counted first to see whether a block has terms that stay.
FEW_TERMS = 64
#: Tokens that a bundle may hold before it is closed.
BUNDLE_TOKENS = 8_000_000
#: Tokens that are sorted at a time while a bundle is packed.
SLICE_TOKENS = 500_000
#: Bytes of the sides of all bundles up to which they are broadcast; beyond, they are joined by a shuffle.
SIDES_BYTES = 16_000_000
_PACKED = "block string, own boolean, bundle long, keys array<{key}>, starts binary, places binary, counts binary"
_CODEC = "zstd"


def _packed(a: np.ndarray) -> bytes:
    """Whole numbers by planes of bytes, so that the upper ones, mostly zero, take next to nothing."""
    return pa.compress(np.ascontiguousarray(a.astype("<u4").view(np.uint8).reshape(-1, 4).T).tobytes(), codec=_CODEC, asbytes=True)


def _unpacked(data: bytes, n: int) -> np.ndarray:
    planes = np.frombuffer(pa.decompress(data, decompressed_size=4 * n, codec=_CODEC, asbytes=True), np.uint8)
    return np.ascontiguousarray(planes.reshape(4, n).T).view("<u4").ravel()


def _steps(places: np.ndarray, starts: np.ndarray) -> bytes:
    """Ascending places of each row as differences."""
    steps = np.diff(places, prepend=0)
    first = starts[:-1][np.diff(starts) > 0]
    steps[first] = places[first]
    return _packed(steps)


def _places(data: bytes, starts: np.ndarray) -> np.ndarray:
    sums = np.cumsum(_unpacked(data, int(starts[-1])), dtype=np.int64)
    return sums - np.repeat(np.concatenate([[0], sums])[starts[:-1]], np.diff(starts))


def _runs(part: pa.RecordBatch):
    """Stretches of rows of one block and side, each at most BUNDLE_TOKENS long unless it is a single row."""
    kinds = list(zip(part.column("block").to_pylist(), part.column("own").to_pylist()))
    sizes = np.asarray(pc.list_value_length(part.column("terms")))
    start, held = 0, 0
    for i, kind in enumerate(kinds):
        if i > start and (kind != kinds[start] or held + sizes[i] > BUNDLE_TOKENS):
            yield part.slice(start, i - start)
            start, held = i, 0
        held += sizes[i]
    if kinds:
        yield part.slice(start)


def _slices(ends: np.ndarray):
    """Stretches of rows of up to SLICE_TOKENS, or of one row, so that little is sorted at a time; ``ends``: tokens before each row, and of all."""
    a = 0
    while a < len(ends) - 1:
        b = max(a + 1, int(np.searchsorted(ends, ends[a] + SLICE_TOKENS, side="right")) - 1)
        yield a, b
        a = b


def _pack(batches):
    from pyspark import TaskContext

    task, serial = TaskContext.get().partitionId(), 0
    for batch in batches:
        for run in _runs(batch):
            lists = run.column("terms")
            coded = lists.flatten().dictionary_encode()
            seen = np.asarray(coded.indices)
            frequent = np.argsort(-np.bincount(seen, minlength=len(coded.dictionary)), kind="stable")  # so that steps are small
            place = np.empty(len(frequent), np.int64)
            place[frequent] = np.arange(len(frequent))
            wide, tokens = max(len(frequent), 1), np.asarray(pc.list_value_length(lists)).astype(np.int64)
            found, ends = [], np.concatenate([[0], np.cumsum(tokens)])
            for a, b in _slices(ends):
                cells, counts = np.unique(np.repeat(np.arange(b - a), tokens[a:b]) * wide + place[seen[ends[a] : ends[b]]], return_counts=True)
                found.append(((cells % wide).astype(np.int32), counts.astype(np.int32), np.bincount(cells // wide, minlength=b - a)))
            places, counts, many = (np.concatenate(x) for x in zip(*found))
            starts = np.concatenate([[0], np.cumsum(many)])
            held = np.bincount(places, minlength=len(frequent)).astype(np.int32)
            yield pa.RecordBatch.from_pydict(
                {
                    "block": run.column("block").slice(0, 1), "own": run.column("own").slice(0, 1), "bundle": pa.array([task * 1_000_000 + serial], pa.int64()),
                    "keys": pa.array([run.column("key")], pa.list_(run.schema.field("key").type)), "starts": pa.array([starts.astype(np.int32).tobytes()], pa.binary()),
                    "places": pa.array([_steps(places, starts)], pa.binary()), "counts": pa.array([_packed(counts)], pa.binary()),
                    "terms": pa.array([np.asarray(coded.dictionary)[frequent]], pa.list_(pa.int64())), "held": pa.array([held], pa.list_(pa.int32())),
                }
            )
            serial += 1


def _sides(rows: pa.Table) -> pa.Table:
    """(bundle, sides): for each row of a bundle 1 in the index, 0 among the queries, else 2; packed. ``rows``: bundle, at, own."""
    at = np.asarray(rows.column("at"))
    side = np.full(int(at.max()) + 1, 2, np.uint8)
    side[at] = np.asarray(rows.column("own"))
    return pa.table({"bundle": rows.column("of").slice(0, 1), "sides": pa.array([pa.compress(side.tobytes(), codec=_CODEC, asbytes=True)], pa.binary()), "n": pa.array([len(side)], pa.int32())})


def _split_all(batches):
    for batch in batches:
        for i in range(batch.num_rows):
            yield from _split(pa.Table.from_batches([batch.slice(i, 1)])).to_batches()


def _split(bundle: pa.Table) -> pa.Table:
    """A bundle as one of index rows and one of queries, by its ``sides``; rows of neither side go."""
    at = {name: bundle.column(name)[0] for name in bundle.column_names}
    terms, starts = np.asarray(at["terms"].values), np.frombuffer(at["starts"].as_py(), np.int32)
    places, counts = _places(at["places"].as_py(), starts), _unpacked(at["counts"].as_py(), int(starts[-1]))
    side, n = np.full(len(starts) - 1, 2, np.uint8), at["n"].as_py()
    side[:n] = np.frombuffer(pa.decompress(at["sides"].as_py(), decompressed_size=n, codec=_CODEC, asbytes=True), np.uint8)
    found: dict[str, list] = {name: [] for name in ("own", "bundle", "keys", "starts", "places", "counts", "terms", "held")}
    for own in (1, 0):
        taken = np.flatnonzero(side == own)
        if not len(taken):
            continue
        stays = np.repeat(side == own, np.diff(starts))
        held = np.bincount(places[stays], minlength=len(terms))
        kept = np.flatnonzero(held)
        new = np.cumsum(held > 0) - 1
        first = np.concatenate([[0], np.cumsum(np.diff(starts)[taken])])
        row = (own == 1, 2 * at["bundle"].as_py() + own, at["keys"].values.take(pa.array(taken)), first.astype(np.int32).tobytes(), _steps(new[places[stays]], first), _packed(counts[stays]), terms[kept], held[kept].astype(np.int32))
        for name, value in zip(found, row):
            found[name].append(value)
    kinds = {"own": pa.bool_(), "bundle": pa.int64(), "keys": bundle.schema.field("keys").type, "terms": pa.list_(pa.int64()), "held": pa.list_(pa.int32())}
    arrays = {name: pa.array(values, kinds.get(name, pa.binary())) for name, values in found.items() if name != "keys"}
    arrays["keys"] = pa.array([x.to_pylist() for x in found["keys"]], kinds["keys"])
    block = pa.array([at["block"].as_py()] * len(found["own"]), pa.string())
    return pa.table({"block": block} | {name: arrays[name] for name in found})


def _weigh(bundle: pa.Table, lists: pa.Table) -> pa.Table:
    """A bundle with the weights of its terms and the lengths of its rows, without the terms that are of no use."""
    at = {name: bundle.column(name)[0] for name in bundle.column_names}
    terms = np.asarray(at["terms"].values)
    idf, shared = np.zeros(len(terms)), np.zeros(len(terms), bool)
    place = np.asarray(lists.column("place"))
    df, n = np.asarray(lists.column("df"), dtype=float), np.asarray(lists.column("n"), dtype=float)
    idf[place] = np.log((1 + n) / (1 + df)) + 1
    shared[place] = np.asarray(lists.column("shared"))
    starts = np.frombuffer(at["starts"].as_py(), np.int32)
    places, counts = _places(at["places"].as_py(), starts), _unpacked(at["counts"].as_py(), int(starts[-1]))
    row = np.repeat(np.arange(len(starts) - 1), np.diff(starts))
    lengths = np.sqrt(np.bincount(row, weights=((1 + np.log(counts.astype(float))) * idf[places]) ** 2, minlength=len(starts) - 1))
    stays, kept = shared[places], np.flatnonzero(shared)
    new = np.cumsum(shared, dtype=np.int64) - 1
    left = np.concatenate([[0], np.cumsum(np.bincount(row[stays], minlength=len(starts) - 1))])
    return pa.table(
        {
            "block": bundle.column("block"), "own": bundle.column("own"), "bundle": bundle.column("bundle"), "keys": bundle.column("keys"),
            "starts": pa.array([left.astype(np.int32).tobytes()], pa.binary()),
            "places": pa.array([_steps(new[places[stays]], left)], pa.binary()), "counts": pa.array([_packed(counts[stays])], pa.binary()),
            "terms": pa.array([terms[kept].tobytes()], pa.binary()), "idf": pa.array([idf[kept].tobytes()], pa.binary()),
            "lengths": pa.array([lengths.tobytes()], pa.binary()),
        }
    )


class _Group:
    """Rows of several bundles: keys, and postings as (row, term, weight)."""

    def __init__(self, table: pa.Table):
        self.keys = pc.list_flatten(table.column("keys")).combine_chunks()
        if isinstance(self.keys, pa.ChunkedArray):
            self.keys = pa.concat_arrays(self.keys.chunks)
        starts = [np.frombuffer(x.as_py(), np.int32) for x in table.column("starts")]
        own = [np.frombuffer(x.as_py(), np.int64) for x in table.column("terms")]
        self.vocabulary = np.unique(np.concatenate(own))
        self.n, size = sum(len(x) - 1 for x in starts), sum(int(x[-1]) for x in starts)
        self.row, self.term, self.weight = np.empty(size, np.int32), np.empty(size, np.int32), np.empty(size)
        first, at = 0, 0
        for i, ends in enumerate(starts):
            to = at + int(ends[-1])
            idf, lengths = (np.frombuffer(table.column(c)[i].as_py(), float) for c in ("idf", "lengths"))
            places, counts = _places(table.column("places")[i].as_py(), ends), _unpacked(table.column("counts")[i].as_py(), to - at)
            row = np.repeat(np.arange(len(ends) - 1, dtype=np.int32), np.diff(ends))
            self.weight[at:to] = (1 + np.log(counts.astype(float))) * idf[places] / lengths[row]
            self.term[at:to] = np.searchsorted(self.vocabulary, own[i]).astype(np.int32)[places]
            self.row[at:to] = row + np.int32(first)
            first, at = first + len(ends) - 1, to


def _matcher(k: int, least: float, schema: pa.Schema):
    unit = 10.0**DIGITS

    def best(sums: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        hit = np.flatnonzero(sums > least - 1 / unit)
        sim = np.floor(sums[hit] * unit + 0.5) / unit
        above = sim > least
        hit, sim = hit[above], sim[above]
        if len(hit) > k:
            high = sim >= np.partition(sim, len(sim) - k)[len(sim) - k]
            hit, sim = hit[high], sim[high]
        order = np.argsort(-sim, kind="stable")[:k]
        return hit[order], sim[order]

    def match(cell: pa.Table) -> pa.Table:
        index, queries = cell.filter(cell.column("own")), cell.filter(pc.invert(cell.column("own")))
        if not index.num_rows or not queries.num_rows:
            return schema.empty_table()
        left = _Group(index)
        if not len(left.vocabulary):
            return schema.empty_table()
        by_key = np.asarray(pc.sort_indices(left.keys)).astype(np.int64)  # so that the first of equal ones has the smallest key
        rank = np.empty(left.n, np.int32)
        rank[by_key] = np.arange(left.n, dtype=np.int32)
        starts = np.concatenate([[0], np.cumsum(np.bincount(left.term, minlength=len(left.vocabulary)))])
        order = np.argsort(left.term, kind="stable")
        left.term = None  # what is not needed again goes before more is made
        weights, left.weight = left.weight[order], None
        rows, left.row = rank[left.row[order]], None
        del order
        asked, to, sims = [], [], []
        for i in range(queries.num_rows):  # one bundle at a time, so that a task does not hold the arrays of its whole group
            right = _Group(queries.slice(i, 1))
            place = np.minimum(np.searchsorted(left.vocabulary, right.vocabulary), len(left.vocabulary) - 1)
            known = left.vocabulary[place] == right.vocabulary
            held = known[right.term]
            q_row, q_term, q_weight = right.row[held], place.astype(np.int32)[right.term[held]], right.weight[held]
            right.row = right.term = right.weight = None
            q_starts, of = np.searchsorted(q_row, np.arange(right.n + 1)), []
            for q in np.flatnonzero(np.diff(q_starts)):
                a, b = q_starts[q], q_starts[q + 1]
                first = starts[q_term[a:b]]
                many = starts[q_term[a:b] + 1] - first
                ends = np.cumsum(many)
                posting = np.arange(ends[-1]) + np.repeat(first - (ends - many), many)
                hit, sim = best(np.bincount(rows[posting], weights=weights[posting] * np.repeat(q_weight[a:b], many), minlength=left.n))
                if len(hit):
                    of.append(np.full(len(hit), q))
                    to.append(by_key[hit])
                    sims.append(sim)
            if of:
                asked.append(right.keys.take(pa.array(np.concatenate(of))))
        if not asked:
            return schema.empty_table()
        to = np.concatenate(to)
        block = pa.array([index.column("block")[0].as_py()] * len(to), pa.string())
        return pa.table({"block": block, "query": pa.concat_arrays(asked), "s1": left.keys.take(pa.array(to)), "sim": np.concatenate(sims)}).cast(schema)

    return match


def _dealt(bundles: DataFrame) -> tuple[DataFrame, int, dict[str, int]]:
    """(bundle, mine, others): the group of a bundle and how many groups the other side of its block has; the number of pairs of groups; index rows of each block."""
    groups: dict[bool, dict] = {True: {}, False: {}}
    for r in bundles.select("own", "block", "bundle", F.size("keys").alias("n")).orderBy("own", "block", "bundle").collect():
        closed = groups[r["own"]].setdefault(r["block"], [[0, []]])
        if closed[-1][1] and closed[-1][0] + r["n"] > (INDEX_ROWS if r["own"] else QUERY_ROWS):
            closed.append([0, []])
        closed[-1][0] += r["n"]
        closed[-1][1].append(r["bundle"])
    plan = []
    for own in groups:
        for block in groups[own].keys() & groups[not own].keys():
            plan += [(b, i, len(groups[not own][block])) for i, (_, ids) in enumerate(groups[own][block]) for b in ids]
    bundle, mine, others = zip(*plan) if plan else ((), (), ())
    table = pa.table({"bundle": pa.array(bundle, pa.int64()), "mine": pa.array(mine, pa.int32()), "others": pa.array(others, pa.int32())})
    cells = sum(len(parts) * len(groups[False].get(block, ())) for block, parts in groups[True].items())
    sizes = {block: sum(n for n, _ in parts) for block, parts in groups[True].items()}
    return F.broadcast(bundles.sparkSession.createDataFrame(table)), cells, sizes


def _bundles(rows: DataFrame, terms: Column, key: str) -> DataFrame:
    """Few partitions make large bundles and so short lists; the order makes them the same whenever they are made again."""
    few = rows.coalesce(4 * rows.sparkSession.sparkContext.defaultParallelism).sortWithinPartitions("block", "own", "key")
    schema = f"{_PACKED.format(key=key)}, terms array<long>, held array<int>"
    return few.select("block", "own", "key", terms.alias("terms")).mapInArrow(_pack, schema).persist(StorageLevel.DISK_ONLY)


def similar_top(index: DataFrame, queries: DataFrame, terms, k: int, max_df: float | None = MAX_DF, least: float = MIN_SIMILARITY, held: list | None = None) -> DataFrame:
    """(block, query, s1, sim, rank) of the ``k`` index rows most similar to each query, above ``least``; columns and ``terms`` as in ``similar_pairs``, keys of one type.

    The bundles stay on disk as long as the result may be read; ``held`` takes them, to be unpersisted.
    """
    key_type = index.schema["s1"].dataType
    if queries.schema["query"].dataType != key_type:
        raise TypeError("keys of index and queries differ in type")

    def prepared(df: DataFrame, key: str, own: bool) -> DataFrame:
        return df.where(F.col("block").isNotNull()).select("block", F.lit(own).alias("own"), F.col(key).alias("key"), "text")

    hashed = _hashed(terms)
    rows = prepared(index, "s1", True).unionByName(prepared(queries, "query", False))
    bundles, sizes = _bundles(rows, hashed, key_type.simpleString()), None
    if _repeated(bundles, "block", "own", "key"):  # rows of one key are one record, but each counts for the size of its block
        sizes = {r["block"]: r["n"] for r in bundles.where("own").groupBy("block").agg(F.sum(F.size("keys")).alias("n")).collect()}
        bundles.unpersist()
        merged = rows.groupBy("block", "own", "key").agg(F.flatten(F.collect_list(hashed)).alias("terms"))
        bundles = _bundles(merged, F.col("terms"), key_type.simpleString())
    return _nearest(bundles, key_type, k, max_df, least, held, sizes)


def similar_among(rows: DataFrame, sides: DataFrame, terms, k: int, max_df: float | None = MAX_DF, least: float = MIN_SIMILARITY, held: list | None = None) -> DataFrame | None:
    """``similar_top`` of ``rows`` (block, key, text) by ``sides`` (key, own: whether it is an index row), without a shuffle of texts; none if a key repeats."""
    key_type = rows.schema["key"].dataType
    known = rows.where(F.col("block").isNotNull() & F.col("key").isNotNull()).select("block", F.lit(False).alias("own"), "key", "text")
    whole = _bundles(known, _hashed(terms), key_type.simpleString())
    if _repeated(whole, "key"):
        whole.unpersist()
        return None
    placed = whole.select(F.col("bundle").alias("of"), F.posexplode("keys").alias("at", "key")).join(sides, "key").select("of", "at", "own")
    schema = f"{_PACKED.format(key=key_type.simpleString())}, terms array<long>, held array<int>"
    of_bundle = placed.groupBy("of").applyInArrow(_sides, "bundle long, sides binary, n int").persist()  # some bits for each row
    small = (of_bundle.agg(F.sum(F.length("sides"))).first()[0] or 0) <= SIDES_BYTES
    sided = whole.drop("own", "held").join(F.broadcast(of_bundle) if small else of_bundle, "bundle")  # so bundles stay where they are
    bundles = sided.select("block", "bundle", "keys", "starts", "places", "counts", "terms", "sides", "n").mapInArrow(_split_all, schema).persist(StorageLevel.DISK_ONLY)
    found = _nearest(bundles, key_type, k, max_df, least, held)
    for df in (whole, of_bundle):
        df.unpersist()
    return found


def _hashed(terms) -> Column:
    return F.coalesce(F.transform(terms(F.col("text")), lambda t: F.xxhash64(t)), F.array().cast("array<long>"))


def _repeated(bundles: DataFrame, *by: str) -> bool:
    keys = bundles.select("block", "own", F.explode("keys").alias("key"))
    return bool(keys.groupBy(*by).agg(F.count(F.lit(1)).alias("n")).where("n > 1").head(1))


def _keeping_all(held: DataFrame, sizes: dict[str, int], max_df: float) -> set[str]:
    """Blocks that are so small, or whose terms are all so frequent, that none is dropped. ``held``: block, term, held."""
    small = {b for b, n in sizes.items() if n * max_df < 1}
    left = sizes.keys() - small
    for share in (FEW_TERMS, 1):  # a few terms show for most blocks that one is rare enough
        if left:
            few = held.where((F.col("held") > 0) & (F.col("term") % share == 0) & (F.col("block").isin(list(left)) if share == 1 else F.lit(True)))
            df = few.groupBy("block", "term").agg(F.sum("held").alias("df"))
            known = {r["block"]: r["df"] for r in df.groupBy("block").agg(F.min("df").alias("df")).collect()}
            left = {b for b in left if b not in known or known[b] > sizes[b] * max_df}
    return small | left


def _nearest(bundles: DataFrame, key_type: T.DataType, k: int, max_df: float | None, least: float, kept: list | None, sizes: dict[str, int] | None = None) -> DataFrame:
    """What ``similar_top`` returns, from bundles in which each key stands once; ``sizes``: index rows of each block, if keys had several."""
    spark = bundles.sparkSession
    schema = T.StructType([bundles.schema["block"], T.StructField("query", key_type), T.StructField("s1", key_type), T.StructField("sim", T.DoubleType())])
    if kept is not None:
        kept.append(bundles)
    dealt, cells, held = _dealt(bundles)
    sizes = sizes or held
    if not cells:
        return top_k(spark.createDataFrame([], schema), k)

    listed = bundles.select("block", "own", F.col("bundle").alias("of"), F.posexplode(F.arrays_zip("terms", "held")).alias("place", "x"))
    listed = listed.select("block", F.col("x.terms").alias("term"), "of", "place", F.when(F.col("own"), F.col("x.held")).otherwise(0).alias("held"))
    of_term = W.partitionBy("block", "term")
    counted = listed.withColumns({"df": F.sum("held").over(of_term), "shared": F.min("held").over(of_term) == 0}).where(F.col("df") > 0)
    whole = sizes.keys() if max_df is None else _keeping_all(listed.select("block", "term", "held"), sizes, max_df)
    n = pa.table({"block": pa.array(sizes, pa.string()), "n": pa.array(sizes.values(), pa.int64()), "keeps_all": pa.array([b in whole for b in sizes], pa.bool_())})
    lists = counted.join(F.broadcast(spark.createDataFrame(n)), "block")
    if max_df is not None:
        lists = lists.where(F.col("keeps_all") | (F.col("df") <= F.col("n") * max_df))
    lists = lists.select("of", "place", "df", "n", "shared")

    out = f"{_PACKED.format(key=key_type.simpleString())}, terms binary, idf binary, lengths binary"
    ready = bundles.drop("held").groupBy("bundle").cogroup(lists.groupBy("of")).applyInArrow(_weigh, out).join(dealt, "bundle")
    ready = ready.withColumn("other", F.explode(F.sequence(F.lit(0), F.col("others") - 1)))
    ready = ready.withColumns({"i": F.when(F.col("own"), F.col("mine")).otherwise(F.col("other")), "q": F.when(F.col("own"), F.col("other")).otherwise(F.col("mine"))})
    cell = ready.drop("mine", "other", "others", "bundle").repartition(2 * cells, "block", "i", "q").groupBy("block", "i", "q")

    from pyspark.sql.pandas.types import to_arrow_schema

    return top_k(cell.applyInArrow(_matcher(k, least, to_arrow_schema(schema)), schema), k)
