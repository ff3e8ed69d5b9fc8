"""Operator 3: approximate nearest neighbours by a hierarchical k-means tree.

The tree is fitted on a bounded sample of distinct vectors (``SAMPLE`` rows of
smallest content hash); every row is then put into the leaf it descends to. A
query walks the tree best bin first: a priority queue holds the unexplored
branches by the distance of their centre, and leaves are visited in the order in
which they come out. The number of leaves visited is the smallest that reaches
the wanted recall against brute force over all rows, for a fixed number of
calibration queries, and never less than one.

Vectors are compared by cosine in double precision. Equal vectors form a class,
of which only the ``k + 1`` smallest ids can ever be among the ``k`` nearest (ties
go to the smaller id), so a vector that a third of all rows hold is searched once
and loses nothing. Rows of a leaf are dealt into blocks of ``BLOCK_ROWS``, and each query goes to
every block of the leaves it visits; a row is dealt once, and again only for every
``BLOCK_QUERIES`` queries that visit its leaf. A task holds one block and streams the
queries past it. The number of leaves depends on the sample, so on a growing table the
leaves grow and with them the comparisons of each query; ``sample`` sets the balance.

Defined results: vectors that are null, zero or hold a null or non-finite
component take no part, neither as query nor as candidate; the same holds for
vectors whose length is not the most common one (ties: the smaller). Fewer than k
candidates give fewer rows. Repeated ids count as separate rows. Null ids take no
part. Other columns are ignored; an empty table gives no row.
"""

from __future__ import annotations

import heapq
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from .shared import materialize, read_table

SAMPLE = 16_384
BRANCHING = 12
LEAF_SIZE = 96
CALIBRATION = 192
RECALL = 0.97
BLOCK_ROWS = 8_192
BLOCK_QUERIES = 65_536
SEED = 11


class KMeansTree:
    """Nodes in arrays: children of node i are ``first[i] : first[i] + count[i]``; leaves have none."""

    def __init__(self, centres: np.ndarray, first: np.ndarray, count: np.ndarray):
        self.centres, self.first, self.count = centres, first, count
        self.leaf_of = np.cumsum(count == 0) - 1

    @property
    def n_leaves(self) -> int:
        return int((self.count == 0).sum())

    @classmethod
    def fit(cls, rows: np.ndarray, branching: int = BRANCHING, leaf_size: int = LEAF_SIZE, seed: int = SEED) -> KMeansTree:
        """``rows`` are unit vectors; the tree's size depends on the sample alone."""
        random = np.random.default_rng(seed)
        centres, first, count = [rows.mean(axis=0) if len(rows) else np.zeros(rows.shape[1])], [0], [0]
        waiting = [(0, np.arange(len(rows)))]
        for node, members in waiting:  # grows while it is walked: breadth first, so children stand together
            if len(members) <= leaf_size:
                continue
            label, middle = _kmeans(rows[members], branching, random)
            parts = [members[label == j] for j in range(len(middle))]
            parts = [(p, m) for p, m in zip(parts, middle) if len(p)]
            if len(parts) < 2:
                continue
            first[node], count[node] = len(centres), len(parts)
            for part, centre in parts:
                waiting.append((len(centres), part))
                centres.append(centre)
                first.append(0)
                count.append(0)
        return cls(np.array(centres), np.array(first), np.array(count))

    def descend(self, rows: np.ndarray) -> np.ndarray:
        """Leaf number of each row."""
        node = np.zeros(len(rows), dtype=np.int64)
        moving = np.flatnonzero(self.count[node] > 0)
        while len(moving):
            for parent in np.unique(node[moving]):
                here = moving[node[moving] == parent]
                children = slice(self.first[parent], self.first[parent] + self.count[parent])
                node[here] = self.first[parent] + np.argmin(_distances(rows[here], self.centres[children]), axis=1)
            moving = moving[self.count[node[moving]] > 0]
        return self.leaf_of[node]

    def best_bins(self, query: np.ndarray, leaves: int) -> list[int]:
        """The first ``leaves`` leaves in best-bin-first order."""
        found: list[int] = []
        queue = [(0.0, 0)]
        while queue and len(found) < leaves:
            _, node = heapq.heappop(queue)
            if not self.count[node]:
                found.append(int(self.leaf_of[node]))
                continue
            a, n = self.first[node], self.count[node]
            for child, distance in enumerate(_distances(query[None], self.centres[a : a + n])[0].tolist(), a):
                heapq.heappush(queue, (distance, child))
        return found


def _distances(rows: np.ndarray, centres: np.ndarray) -> np.ndarray:
    return (centres**2).sum(axis=1)[None] - 2 * rows @ centres.T


def _kmeans(rows: np.ndarray, k: int, random: np.random.Generator, rounds: int = 8) -> tuple[np.ndarray, np.ndarray]:
    centres = rows[random.choice(len(rows), size=min(k, len(rows)), replace=False)]
    for _ in range(rounds):
        label = np.argmin(_distances(rows, centres), axis=1)
        sizes = np.bincount(label, minlength=len(centres))
        sums = np.zeros_like(centres)
        np.add.at(sums, label, rows)
        centres = np.where(sizes[:, None] > 0, sums / np.maximum(sizes, 1)[:, None], centres)
    return np.argmin(_distances(rows, centres), axis=1), centres


def _unit(vectors: list) -> np.ndarray:
    return _rows_to_unit(np.array(vectors, dtype=np.float64))


def _rows_to_unit(rows: np.ndarray) -> np.ndarray:
    return rows / np.sqrt((rows * rows).sum(axis=1))[:, None]


def _cosines(query: np.ndarray, rows: np.ndarray) -> np.ndarray:
    """Exact cosines, each by the same sequence of operations, so equal vectors get equal scores."""
    dots = (rows * query).sum(axis=1)
    return dots / (np.sqrt((rows * rows).sum(axis=1)) * np.sqrt((query * query).sum()))


def _best(ids: np.ndarray, scores: np.ndarray, k: int) -> np.ndarray:
    return np.lexsort((ids, -scores))[:k]


def _block_best(ids: np.ndarray, rows: np.ndarray, asked: np.ndarray, queries: np.ndarray, k: int) -> tuple[np.ndarray, ...]:
    """(query, id, score) of at least the ``k`` best rows of each query; scores are exact."""
    rough = _rows_to_unit(queries) @ _rows_to_unit(rows).T
    rough[asked[:, None] == ids[None]] = -np.inf
    floor = np.partition(rough, len(ids) - k, axis=1)[:, len(ids) - k] if len(ids) > k else np.full(len(asked), -2.0)
    q, r = np.nonzero((rough >= floor[:, None] - 1e-9) & (rough > -np.inf))
    a, b = queries[q], rows[r]
    scores = (b * a).sum(axis=1) / (np.sqrt((b * b).sum(axis=1)) * np.sqrt((a * a).sum(axis=1)))
    return _prune([(asked[q], ids[r], scores)], k)


def _prune(parts: list[tuple[np.ndarray, ...]], k: int) -> tuple[np.ndarray, ...]:
    query, ids, scores = (np.concatenate(c) for c in zip(*parts))
    order = np.lexsort((ids, -scores, query))
    query, ids, scores = query[order], ids[order], scores[order]
    start = np.flatnonzero(np.concatenate([[True], query[1:] != query[:-1]])) if len(query) else np.empty(0, dtype=np.int64)
    place = np.arange(len(query)) - np.repeat(start, np.diff(np.append(start, len(query))))
    return query[place < k], ids[place < k], scores[place < k]


def _stretches(batches: Iterator[pa.RecordBatch], keys: int) -> Iterator[pa.RecordBatch]:
    """The batches, cut where one of the first ``keys`` columns changes."""
    for batch in batches:
        if not batch.num_rows:
            continue
        change = np.zeros(batch.num_rows - 1, dtype=bool)
        for k in range(keys):
            column = batch.column(k).to_numpy(zero_copy_only=False)
            change |= column[1:] != column[:-1]
        cuts = [0, *(np.flatnonzero(change) + 1).tolist(), batch.num_rows]
        for a, b in zip(cuts, cuts[1:]):
            yield batch.slice(a, b - a)


def _best_batch(part: tuple[np.ndarray, ...]) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array(c) for c in part], names=["query_id", "id", "score"])


def usable(df: DataFrame, id_col: str, vector_col: str) -> DataFrame:
    """Rows that take part: id and vector (array of double)."""
    rows = df.select(F.col(id_col).cast("long").alias("id"), F.col(vector_col).cast("array<double>").alias("v")).where(
        F.col("id").isNotNull() & F.col("v").isNotNull()
    )
    sound = F.forall("v", lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) != float("inf"))) & F.exists("v", lambda x: x != 0)
    rows = rows.where(sound)
    lengths = rows.groupBy(F.size("v").alias("n")).count().orderBy(F.desc("count"), "n").limit(1).collect()
    return rows.where(F.size("v") == (lengths[0]["n"] if lengths else 0))


def search(
    df: DataFrame,
    is_query,
    id_col: str = "vec_id",
    vector_col: str = "embedding",
    k: int = 5,
    recall: float = RECALL,
    sample: int = SAMPLE,
    block_rows: int = BLOCK_ROWS,
) -> DataFrame:
    """(query_id, rank, id, score): the nearest rows found for the rows where ``is_query`` holds (a condition on ``id``)."""
    spark = df.sparkSession
    rows = materialize(usable(df, id_col, vector_col), "vectors")
    same = W.partitionBy("h", "v").orderBy("id")
    classes = rows.withColumn("h", F.xxhash64("v")).withColumn("r", F.row_number().over(same)).where(F.col("r") <= k + 1)
    classes = materialize(classes.drop("r"), "vector-classes")  # equal vectors keep their k + 1 smallest ids

    picked = classes.dropDuplicates(["h", "v"]).orderBy("h").limit(sample).collect()
    schema = f"query_id long, rank int, `{id_col}` long, score double"
    if not picked:
        return spark.createDataFrame([], schema)
    tree = spark.sparkContext.broadcast(KMeansTree.fit(_unit([r["v"] for r in picked])))
    n_leaves = tree.value.n_leaves

    def place(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if batch.num_rows:
                leaf = tree.value.descend(_unit(batch.column(1).to_pylist()))
                yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array(leaf)], names=["id", "v", "leaf"])

    placed = materialize(classes.select("id", "v").mapInArrow(place, "id long, v array<double>, leaf long"), "vector-leaves")
    queries = rows.where(is_query)
    visits = _calibrate(placed, queries, tree, k, recall)

    def walk(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for start in range(0, batch.num_rows, 64):
                part = batch.slice(start, 64)
                if part.num_rows:
                    bins = [tree.value.best_bins(q, visits) for q in _unit(part.column(1).to_pylist())]
                    yield pa.RecordBatch.from_arrays([part.column(0), part.column(1), pa.array(bins, type=pa.list_(pa.int64()))], names=["id", "v", "bins"])

    # Blocks: (leaf, row block, query block); a row meets each query block of its leaf and the reverse.
    width = int(spark.conf.get("spark.sql.shuffle.partitions"))
    walked = materialize(queries.select("id", "v").repartition(width).mapInArrow(walk, "id long, v array<double>, bins array<long>"), "vector-queries")
    walked = walked.select("id", "v", F.explode("bins").alias("leaf"))

    def blocks(df: DataFrame, rows: int):
        """Number of blocks of a row's leaf."""
        sizes = {r["leaf"]: r["count"] for r in df.groupBy("leaf").count().collect()}  # at most n_leaves rows
        return F.element_at(F.array(*[F.lit(max(1, -(-sizes.get(j, 0) // rows))) for j in range(n_leaves)]), (F.col("leaf") + 1).cast("int"))

    row_blocks, query_blocks = blocks(placed, block_rows), blocks(walked, BLOCK_QUERIES)
    left = placed.withColumn("rb", F.pmod(F.xxhash64("id"), row_blocks).cast("int")).withColumn("qb", F.explode(F.sequence(F.lit(0), query_blocks - 1)))
    right = walked.withColumn("qb", F.pmod(F.xxhash64("id"), query_blocks).cast("int")).withColumn("rb", F.explode(F.sequence(F.lit(0), row_blocks - 1)))
    dealt = left.withColumn("asks", F.lit(False)).unionByName(right.withColumn("asks", F.lit(True)))
    dealt = dealt.select("leaf", "rb", "qb", "asks", "id", "v").repartition(width, "leaf", "rb", "qb").sortWithinPartitions("leaf", "rb", "qb", "asks", "id")

    def meet(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """Each block's best for its queries, which stand behind its rows; a query's results from the blocks of a task are merged before they leave it."""
        held, size, block, ids, v = [], 0, None, [], []
        for group in _stretches(batches, 4):
            *here, asks = (group.column(j)[0].as_py() for j in range(4))
            if here != block:
                block, ids, v = here, [], []
            own = group.column("id").to_numpy()
            vectors = group.column("v").flatten().to_numpy().reshape(len(own), -1)
            if not asks:
                ids, v = [*ids, own], [*v, vectors]
                continue
            if not ids:
                continue
            if len(ids) > 1:
                ids, v = [np.concatenate(ids)], [np.concatenate(v)]
            for start in range(0, len(own), 512):
                held.append(_block_best(ids[0], v[0], own[start : start + 512], vectors[start : start + 512], k))
                size += len(held[-1][0])
                if size >= 200_000:
                    held = [_prune(held, k)]
                    size = len(held[0][0])
                    if size >= 150_000:
                        yield _best_batch(held[0])
                        held, size = [], 0
        if held:
            yield _best_batch(_prune(held, k))

    near = dealt.mapInArrow(meet, "query_id long, id long, score double")
    ranked = near.withColumn("rank", F.row_number().over(W.partitionBy("query_id").orderBy(F.desc("score"), "id")))
    return ranked.where(F.col("rank") <= k).select("query_id", "rank", F.col("id").alias(id_col), "score")


def _calibrate(placed: DataFrame, queries: DataFrame, tree, k: int, recall: float) -> int:
    """Leaves to visit: the smallest number that finds ``recall`` of the true neighbours of the calibration queries."""
    chosen = queries.orderBy(F.xxhash64("id", F.lit(SEED)), "id").limit(CALIBRATION).collect()
    if not chosen:
        return 1
    keys = np.array([r["id"] for r in chosen])
    asked = placed.sparkSession.sparkContext.broadcast((keys, np.array([r["v"] for r in chosen], dtype=np.float64)))

    def brute(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        keys, q = asked.value
        units = _unit(q)
        kept: list[tuple] = [([], [], []) for _ in keys]
        for batch in batches:
            if not batch.num_rows:
                continue
            ids, leaf = batch.column(0).to_numpy(), batch.column(2).to_numpy()
            scores = units @ _unit(batch.column(1).to_pylist()).T
            for j, key in enumerate(keys):
                other = np.flatnonzero(ids != key)
                best = other[_best(ids[other], scores[j][other], k)]
                now = [np.concatenate([a, b]) for a, b in zip(kept[j], (ids[best], scores[j][best], leaf[best]))]
                top = _best(now[0], now[1], k)
                kept[j] = tuple(a[top] for a in now)
        for j in range(len(keys)):
            n = len(kept[j][0])
            yield pa.RecordBatch.from_arrays(
                [pa.array([j] * n, type=pa.int32()), *(pa.array(np.array(a, dtype=t)) for a, t in zip(kept[j], ("i8", "f8", "i8")))],
                names=["q", "id", "score", "leaf"],
            )

    found = placed.mapInArrow(brute, "q int, id long, score double, leaf long")
    ranked = found.withColumn("r", F.row_number().over(W.partitionBy("q").orderBy(F.desc("score"), "id")))
    truth = ranked.where(F.col("r") <= k).select("q", "leaf").collect()  # k rows a calibration query
    order = [{leaf: at for at, leaf in enumerate(tree.value.best_bins(q, tree.value.n_leaves))} for q in _unit(asked.value[1])]
    needed = sorted(order[r["q"]][r["leaf"]] + 1 for r in truth)
    return int(needed[min(len(needed) - 1, int(np.ceil(recall * len(needed))) - 1)]) if needed else 1


def op3_kmeans_tree(spark: SparkSession, sf_dir: str) -> DataFrame:
    return search(read_table(spark, sf_dir, "embeddings"), F.col("id") % 50 == 0)
