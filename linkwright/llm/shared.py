"""Shared storage and small plan helpers used by the operators of this folder.

Everything an executor must see later is written under the folder the cluster
names in ``spark.checkpoint.dir``; a local folder is used only where that
setting is absent (local tests).
"""

from __future__ import annotations

import os
import tempfile
import uuid
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

_LOCAL_DIRS: dict[str, str] = {}


def shared_root(spark: SparkSession) -> str:
    """URI of the shared folder, private to this application."""
    root = spark.conf.get("spark.checkpoint.dir", None)
    app = spark.sparkContext.applicationId
    if not root:
        if not spark.sparkContext.master.startswith("local"):
            raise ValueError("set spark.checkpoint.dir to a folder that all executors share")
        root = _LOCAL_DIRS.setdefault(app, tempfile.mkdtemp(prefix="linkwright-"))
    if "://" not in root and not root.startswith("file:"):
        root = "file://" + os.path.abspath(root)
    return f"{root.rstrip('/')}/linkwright-{app}"


def new_folder(spark: SparkSession, name: str) -> str:
    """A fresh folder URI for one operator call."""
    return f"{shared_root(spark)}/{name}-{uuid.uuid4().hex[:12]}"


def materialize(df: DataFrame, name: str) -> DataFrame:
    """Write ``df`` once to the shared folder and read it back.

    The written table cuts the lineage, so a lost executor never causes the
    work behind it to be done again.
    """
    spark = df.sparkSession
    path = new_folder(spark, name)
    df.write.option("compression", "zstd").parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def open_store(uri: str):
    """(filesystem, path) for a URI; used by executors for the binary formats."""
    from pyarrow import fs

    if uri.startswith("file:"):
        path = uri[len("file:") :]
        while path.startswith("//"):
            path = path[1:]
        return fs.LocalFileSystem(), path
    return fs.FileSystem.from_uri(uri)


def publish(uri: str, write) -> int:
    """Write a file under a private name, then move it to ``uri``.

    A task that dies leaves no file under the final name, and a repeated task
    attempt replaces it with the same bytes. Returns the size.
    """
    store, path = open_store(uri)
    store.create_dir(path.rsplit("/", 1)[0], recursive=True)
    draft = f"{path}.{uuid.uuid4().hex}.draft"
    with store.open_output_stream(draft) as out:
        write(out)
        size = out.tell()
    store.move(draft, path)
    return size


def fresh_names(columns: list[str], *names: str) -> list[str]:
    """Names that do not clash with ``columns``."""
    taken = {c.lower() for c in columns}
    found = []
    for name in names:
        while name.lower() in taken:
            name = "_" + name
        taken.add(name.lower())
        found.append(name)
    return found


def row_key(id_col: str, text_col: str) -> Column:
    """128-bit identity of a document: its id and its text."""
    parts = F.concat_ws("|", F.coalesce(F.col(id_col).cast("string"), F.lit("-")), F.col(text_col).isNull().cast("string"), text_col)
    return F.unhex(F.md5(parts))


def read_table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def sorted_groups(batches: Iterator[pa.RecordBatch], keys: int) -> Iterator[pa.Table]:
    """Consecutive rows with equal first ``keys`` columns, as one table each; input sorted by them."""
    held: list[pa.RecordBatch] = []
    last = None
    for batch in batches:
        if not batch.num_rows:
            continue
        columns = [batch.column(k).to_numpy(zero_copy_only=False) for k in range(keys)]
        change = np.zeros(batch.num_rows - 1, dtype=bool)
        for c in columns:
            change |= c[1:] != c[:-1]
        cuts = [0, *(np.flatnonzero(change) + 1).tolist(), batch.num_rows]
        for a, b in zip(cuts, cuts[1:]):
            key = tuple(c[a] for c in columns)
            if held and key != last:
                yield pa.Table.from_batches(held)
                held = []
            last = key
            held.append(batch.slice(a, b - a))
    if held:
        yield pa.Table.from_batches(held)
