"""The five stages on a small corpus with planted cases, each against brute force on its own input, and the run as a whole."""

from __future__ import annotations

import random

import numpy as np
import pytest
from pyspark.sql import functions as F
from test_llm_operators import _shingles, _wanted_rows

import corpus_pipeline

COLUMNS = ["doc_id", "text", "lang", "source", "n_chars"]


@pytest.fixture(scope="module")
def folder(spark, tmp_path_factory):
    rng = random.Random(41)
    good, bad = [f"good{k}" for k in range(400)], [f"bad{k}!!" for k in range(60)]
    prose = lambda n, words=good: " ".join(rng.choices(words, k=n))
    texts = {i: prose(120) for i in range(60)}
    texts |= {60 + i: prose(60, bad) for i in range(30)}
    block, passage, tiny = "\n".join(prose(6) for _ in range(3)), prose(56), prose(51, good[:100])
    texts |= {100: texts[3], 101: texts[3], 102: texts[4].replace("good1 ", "other ", 1) + " end"}  # copies
    texts |= {110: prose(90) + "\n" + block + "\n" + prose(90), 111: prose(80) + "\n" + block + "\n" + prose(80)}  # repeated lines
    texts |= {120: f"{prose(100)} {passage} {prose(100)}", 121: f"{prose(110)} {passage} {prose(90)}", 122: f"{prose(100)} {tiny} {prose(99)}", 123: f"{tiny} {prose(200)}"}
    texts |= {130: None, 131: "", 132: "good1"}
    path = tmp_path_factory.mktemp("corpus")
    rows = [(i, t, "en", "web", len(t or "")) for i, t in texts.items()] + [(5, texts[5], "en", "web", len(texts[5]))]
    spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars int").repartition(3).write.parquet(f"{path}/documents.parquet")
    labels = [(i, int(i < 60), 0) for i in range(90)]
    spark.createDataFrame(labels, "doc_id long, quality int, toxic int").write.parquet(f"{path}/labels.parquet")
    return str(path)


def rows_of(df):
    return [(r["doc_id"], r["text"]) for r in df.select("doc_id", "text").collect()]


def test_stages_and_run(spark, folder):
    docs = spark.read.parquet(f"{folder}/documents.parquet")
    names, stages = zip(*corpus_pipeline.STAGES)
    assert names == ("quality", "lines", "near_duplicates", "substrings", "packing")

    kept = stages[0](spark, docs, folder).cache()
    ids = sorted(i for i, _ in rows_of(kept))
    assert kept.columns == COLUMNS and not set(range(60, 90)) & set(ids) and len(set(range(60)) - set(ids)) <= 2
    assert dict(rows_of(kept)).items() <= dict(rows_of(docs)).items()

    lined = stages[1](spark, kept, folder).cache()
    before, after = dict(rows_of(kept)), dict(rows_of(lined))
    assert lined.columns == COLUMNS and before.keys() == after.keys()
    changed = {i for i in before if before[i] != after[i]}
    assert changed == {111} & before.keys() and all(r["n_chars"] == len(r["text"]) for r in lined.where("text IS NOT NULL").collect())

    single = stages[2](spark, lined, folder).cache()
    texts = rows_of(lined)
    sets, root = [_shingles(t or "") for _, t in texts], list(range(len(texts)))

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    for a in range(len(texts)):
        for b in range(a):
            if sets[a] and sets[b] and 100 * len(sets[a] & sets[b]) >= 75 * len(sets[a] | sets[b]):
                root[find(a)] = find(b)
    least = {}
    for k, (i, _) in enumerate(texts):
        key = find(k) if sets[k] else -1 - k
        least[key] = min(least.get(key, i), i)
    assert single.columns == COLUMNS and sorted(i for i, _ in rows_of(single)) == sorted(set(least.values()))
    assert not {100, 101, 102} & {i for i, _ in rows_of(single)}

    cut = stages[3](spark, single, folder).cache()
    texts = rows_of(single)
    wanted = {}
    for (i, t), covered in zip(texts, _wanted_rows([t for _, t in texts], 400, 51)):
        data = np.frombuffer((t or "").encode(), dtype=np.uint8)
        wanted[i] = None if t is None else data[~covered.any(axis=0)].tobytes().decode("utf-8", "ignore")
    assert cut.columns == COLUMNS and dict(rows_of(cut)) == wanted
    assert sum(wanted[i] != t for i, t in texts) >= 4  # both planted passages, on both sides

    packed = stages[4](spark, cut, folder)
    assert sorted(r["doc_id"] for r in packed.collect()) == sorted(wanted)
    whole = corpus_pipeline.run(spark, folder)
    assert whole.columns == packed.columns
    assert sorted(map(tuple, whole.collect())) == sorted(map(tuple, packed.collect()))


def test_empty_corpus(spark, folder, tmp_path):
    for name in ("documents", "labels"):
        spark.read.parquet(f"{folder}/{name}.parquet").limit(0).write.parquet(f"{tmp_path}/{name}.parquet")
    assert corpus_pipeline.run(spark, str(tmp_path)).count() == 0


def test_stages_keep_other_columns(spark, folder):
    """Columns whose names the operators use inside, and rows whose texts are null or empty."""
    docs = spark.read.parquet(f"{folder}/documents.parquet")
    for name in ("kept_row", "drawn_id", "cut_text", "node", "key"):
        docs = docs.withColumn(name, F.lit("x"))
    for _, stage in corpus_pipeline.STAGES[:-1]:
        docs_out = stage(spark, docs, folder)
        assert docs_out.columns == docs.columns
        assert {r["doc_id"]: r["text"] for r in docs_out.where("doc_id IN (130, 131)").collect()} == {130: None, 131: ""}
