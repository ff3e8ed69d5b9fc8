from __future__ import annotations

import os
import re
import shutil
import subprocess
import sys
import time
from pathlib import Path

import pytest
from pyspark.sql import functions as F

from linkwright.config import Config, Regime
from linkwright.operators import blocking, context, decide, evaluate, similarity_top, validate
from linkwright.operators.similarity_join import similar_pairs, top_k, word_terms
from linkwright.plans.pipeline import Dictionary, Runner, normalize, predict, train
from linkwright.sources import tables
from linkwright.streaming.link import StreamLinker

SCORED = [("a", "x", 0.9), ("b", "x", 0.9), ("a", "y", 0.6), ("b", "y", 0.4), ("b", "z", 0.2)]


@pytest.fixture(scope="module")
def scored(spark):
    return spark.createDataFrame(SCORED, "s1 string, other string, p double")


def rows(df, *columns):
    return sorted(tuple(r) for r in df.select(*columns).collect())


def test_one_owner_breaks_ties_by_id(scored):
    assert rows(decide.one_owner(scored), "s1", "other") == [("a", "x"), ("a", "y"), ("b", "z")]
    assert rows(decide.decide(scored, 0.5, 0.7), "s1", "other") == [("a", "x")]
    assert decide.one_owner(scored).groupBy("other").count().where("count > 1").count() == 0


def test_expected_f_takes_the_best_prefix(scored):
    # a: one pair 1.125 / 1.38, two pairs 1.875 / 2.38; b: 0.2 does not beat predicting none.
    assert rows(decide.expected_f_decide(scored), "s1", "other") == [("a", "x")]


def test_f05_golden_example(spark):
    predicted = spark.createDataFrame([("s", 47), ("s", 193), ("s", 812)], "s1 string, other long")
    truth = spark.createDataFrame([("s", 47), ("s", 812)], "s1 string, other long")
    ids = spark.createDataFrame([("s",), ("alone",)], "s1 string")
    found = {r["s1"]: r["f05"] for r in evaluate.outcomes(predicted, truth, ids).collect()}
    assert found["s"] == pytest.approx(0.714, abs=1e-3) and found["alone"] == 1.0


def test_context_runner_up(scored):
    found = {(r["s1"], r["other"]): r for r in context.score_context(scored).collect()}
    assert found["a", "x"]["rival_o"] == 0.9 and found["b", "y"]["rival_o"] == 0.6 and found["b", "z"]["p2_o"] == 0.0


def test_lists_and_rules(spark):
    pairs = spark.createDataFrame([("S1-1", "S3-9"), ("S1-1", "S2-4"), ("S1-1", "S2-4")], "s1 string, other string")
    ids = spark.createDataFrame([("S1-1",), ("S1-3",)], "s1 string")
    lists = tables.list_rows(pairs, ids, "matched_entity_ids")
    assert rows(lists, "*") == [("S1-1", "S2-4,S3-9"), ("S1-3", "")]
    bad = spark.createDataFrame([("S1-1", "S2-1,S2-1"), ("S1-1", "S1-7"), ("S1-2", "")], "source1_entity_id string, m string")
    split = validate.split_lists(bad, "m")
    assert rows(validate.repeated_rows(split), "source1_entity_id") == [("S1-1",)]
    assert rows(validate.repeated_ids(split), "*") == [("S1-1",)]
    assert rows(validate.wrong_prefix(split, ["S2-", "S3-"]), "id") == [("S1-7",)]
    assert validate.summary(split).first().asDict() == {"n_rows": 3, "n_empty": 1, "n_filled": 2}


def test_files(spark, tmp_path):
    records = spark.createDataFrame([("S1-1", 'a "b', None, "US")], "entity_id string, business_name string, business_address string, country string")
    tables.write_tsv(records.na.fill(""), f"{tmp_path}/t")
    back = tables.read_tsv(spark, f"{tmp_path}/t")
    assert back.first()["business_name"] == 'a "b' and back.first()["business_address"] == ""
    assert validate.check_file(spark, f"{tmp_path}/none", "m") != []
    tables.write_json(spark, f"{tmp_path}/j", {"thr": 0.7})
    assert tables.read_json(spark, f"{tmp_path}/j") == {"thr": 0.7}
    runner, calls = Runner(spark, str(tmp_path)), []
    for _ in range(2):
        runner.step("s", lambda: calls.append(1) or spark.range(3))
    assert len(calls) == 1
    assert tables.next_run_folder(spark, str(tmp_path), "x").endswith("01_x")


def test_similarity_prefix_property_and_blocks(spark):
    index = spark.createDataFrame([("u", i, t) for i, t in enumerate(["red fox", "red dog", "blue dog", "green cat"])], "block string, s1 long, text string")
    queries = spark.createDataFrame([("u", 7, "red dog"), ("v", 8, "red dog")], "block string, query long, text string")
    pairs = similar_pairs(index, queries, word_terms)
    three, one_ = (rows(top_k(pairs, k), "query", "s1") for k in (3, 1))
    assert one_ == [(7, 1)] and set(one_) <= set(three) and all(q == 7 for q, _ in three)


@pytest.mark.parametrize("max_df", [0.5, None])
def test_similar_top_equals_pairs(spark, monkeypatch, max_df):
    monkeypatch.setattr(similarity_top, "INDEX_ROWS", 7)  # several groups of a block
    monkeypatch.setattr(similarity_top, "QUERY_ROWS", 5)
    words = ["red", "fox", "dog", "blue", "cat", "green", "owl", "grey"]
    text = lambda i: " ".join(words[(i * i + j * (i % 5 + 1)) % 8] for j in range(i % 9)) or None
    index = spark.createDataFrame([("uv"[i % 2], i, text(i)) for i in range(60)] + [("u", 4, "owl owl"), ("w", 90, "red"), (None, 91, "red")], "block string, s1 long, text string")
    queries = spark.createDataFrame([("uvx"[i % 3], i, text(i + 3)) for i in range(40)] + [("u", 3, "grey owl"), (None, 91, "red")], "block string, query long, text string")
    plain = top_k(similar_pairs(index, queries, word_terms, max_df), 3)
    found = similarity_top.similar_top(index, queries, word_terms, 3, max_df)
    columns = ("block", "query", "rank", "s1", "sim")
    assert rows(found, *columns) == rows(plain, *columns) != []
    assert similarity_top.similar_top(index, queries.where("query < 0"), word_terms, 3).count() == 0


def test_found_writes_no_row_for_a_pair(spark, tmp_path):
    from linkwright.plans.fixtures import DocumentTask

    docs = [(i, f"t{i % 30}. word{i % 7} word{i % 5} x{i}", "en") for i in range(60)]
    spark.createDataFrame(docs, "doc_id long, text string, lang string").write.parquet(f"{tmp_path}/documents.parquet")
    task = DocumentTask(spark, str(tmp_path))
    by_pair = re.compile(r"keys=\[block#\d+, query#\d+L?, s1#\d+L?\]")
    plan = lambda df: df._jdf.queryExecution().executedPlan().toString()
    index = task.s1.select(F.col("country").alias("block"), "s1", F.col("body").alias("text"))
    queries = task.other.select(F.col("country").alias("block"), F.col("other").alias("query"), F.col("body").alias("text"))
    assert by_pair.search(plan(similar_pairs(index, queries, word_terms)))
    assert not by_pair.search(plan(task.found()))
    assert task.found().count() > 0
    task.release()


@pytest.mark.parametrize("max_df", [0.2, None])
def test_similar_among_equals_top(spark, monkeypatch, max_df):
    monkeypatch.setattr(similarity_top, "INDEX_ROWS", 7)
    monkeypatch.setattr(similarity_top, "QUERY_ROWS", 5)
    monkeypatch.setattr(similarity_top, "SLICE_TOKENS", 9)
    words = ["red", "fox", "dog", "blue", "cat", "green", "owl", "grey"]
    text = lambda i: " ".join(words[(i * i + j * (i % 5 + 1)) % 8] for j in range(i % 9)) or None
    docs = spark.createDataFrame([("uvw"[i % 7 % 3], i, text(i)) for i in range(90)] + [("x", 100, "red"), (None, 101, "red"), ("u", None, "red")], "block string, key long, text string")
    sides = docs.where("key is not null and key <> 45").select("key", (F.col("key") % 5 < 3).alias("own"))  # 45 is on neither side
    part = lambda own, name: docs.join(sides.where(F.col("own") == own), "key").select("block", F.col("key").alias(name), "text")
    columns = ("block", "query", "rank", "s1", "sim")
    plain = top_k(similar_pairs(part(True, "s1"), part(False, "query"), word_terms, max_df), 3)
    assert rows(similarity_top.similar_among(docs, sides, word_terms, 3, max_df), *columns) == rows(plain, *columns) != []
    assert similarity_top.similar_among(docs.unionByName(docs.where("key = 4")), sides, word_terms, 3, max_df) is None


def test_documents_task_shuffles_no_text(spark, tmp_path):
    from linkwright.plans.fixtures import DocumentTask
    from linkwright.plans.linkage import trait_slices

    docs = [(i, f"t{i % 30}. word{i % 7} word{i % 5} x{i}", "en") for i in range(60)]
    spark.createDataFrame(docs, "doc_id long, text string, lang string").write.parquet(f"{tmp_path}/documents.parquet")
    plan = lambda df: df._jdf.queryExecution().optimizedPlan().toString()
    moved = re.compile(r"Join Inner[^\n]*\n[^\n]*Project (\[|\[[^\n]*?(, |AS ))(body|text)#\d+[,\]]")  # as a column, not as what one is made of
    task = DocumentTask(spark, str(tmp_path))
    assert moved.search(plan(task.other))
    assert task.found().count() > 0
    assert not any(moved.search(plan(df)) for df in task._bundles)
    assert not moved.search(plan(trait_slices(spark, str(tmp_path))))
    task.release()


def test_bundles_stay_and_roles_are_kept(spark, tmp_path, monkeypatch):
    """No shuffle of bundles to split them, and texts read once for the roles."""
    from linkwright.plans.fixtures import DocumentTask

    docs = [(i, f"t{i % 30}. word{i % 7} word{i % 5} x{i}", "en") for i in range(60)]
    spark.createDataFrame(docs, "doc_id long, text string, lang string").write.parquet(f"{tmp_path}/documents.parquet")
    plan = lambda df: df._jdf.queryExecution().optimizedPlan().toString()
    found = []
    for most in (16_000_000, -1):  # sides broadcast, and joined by a shuffle
        monkeypatch.setattr(similarity_top, "SIDES_BYTES", most)
        task = DocumentTask(spark, str(tmp_path))
        found.append(rows(task.found(), "other", "rank", "s1", "sim"))
        assert "CoGroup" not in plan(task._bundles[0])
        task.release()
    assert found[0] == found[1] != []
    task = DocumentTask(spark, str(tmp_path))
    assert all("InMemoryRelation" in plan(df) for df in (task.truth, task.sides, task.ids))
    assert rows(task.truth, "s1", "other") == [(i % 30, i) for i in range(30, 60)]
    assert rows(task.ids, "s1", "country") == [(i, "en") for i in range(30)]
    task.release()


def test_documents_task_with_repeated_ids(spark, tmp_path):
    """A repeated doc_id can stand on both sides; its rows of one side are one record."""
    from linkwright.operators import similarity_top
    from linkwright.plans.fixtures import K, DocumentTask

    docs = [(i, f"t{i % 9}. word{i % 7} word{i % 5} x{i % 4}", "en") for i in range(30)] + [(12, "new. word1 word2", "en")]
    spark.createDataFrame(docs, "doc_id long, text string, lang string").write.parquet(f"{tmp_path}/documents.parquet")
    task = DocumentTask(spark, str(tmp_path))
    index = task.s1.select(F.col("country").alias("block"), "s1", F.col("body").alias("text"))
    queries = task.other.select(F.col("country").alias("block"), F.col("other").alias("query"), F.col("body").alias("text"))
    plain = similarity_top.similar_top(index, queries, word_terms, K).withColumnRenamed("query", "other")
    columns = ("other", "rank", "s1", "sim")
    assert rows(task.found(), *columns) == rows(plain, *columns) != []
    task.release()


def test_key_recall_compares_whole_texts(spark, tmp_path):
    from linkwright.plans.analysis import key_recall_ceiling

    left, right = "aaa " * 80, "bbb " * 80
    bodies = [(left + "zebra", right + "zebra"), (left[:298] + "foobar", right[:298] + "foo"), ("x y", "x y"), (left, left), ("", "")]
    docs = [(2 * i + j, f"t{i}.{body}", "en") for i, pair in enumerate(bodies) for j, body in enumerate(pair)]
    spark.createDataFrame(docs, "doc_id long, text string, lang string").write.parquet(f"{tmp_path}/documents.parquet")
    found = key_recall_ceiling(spark, str(tmp_path)).first().asDict()
    # by token: zebra, aaa; by gram: zebra, xy, aaaa
    assert found == {"pairs": 5, "by_token": 2, "by_gram4": 3, "by_prefix4": 3, "by_any": 3}


def test_ngrams_of_a_long_text_take_one_pass(spark):
    from linkwright.functions import text

    long = spark.range(4).select(F.concat(F.repeat(F.lit("abcdefghij"), 30_000), F.col("id").cast("string")).alias("t"))
    began = time.time()
    assert {r["n"] for r in long.select(F.size(text.char_ngrams(F.col("t"), 4)).alias("n")).collect()} == {11}
    assert time.time() - began < 15
    short = spark.createDataFrame([("",), ("ab",), ("a-b c",), ("abcd",), ("ababab",)], "t string")
    assert [r["g"] for r in short.select(text.char_ngrams(F.col("t"), 4).alias("g")).collect()] == [[], ["ab"], ["abc"], ["abcd"], ["abab", "baba"]]


def test_states_and_regimes(spark):
    df = spark.createDataFrame([("telangana|andhra pradesh",), ("",)], "state string")
    assert rows(blocking.with_blocks(df), "block") == [("",), ("andhra pradesh",)]
    learned = blocking.learned_states(spark.createDataFrame([("us", "ohio", ["akron"])] * 6, "country string, state string, comps array<string>"))
    blank = spark.createDataFrame([(1, "us", "", ["akron"]), (2, "us", "", ["x"])], "other long, country string, state string, comps array<string>")
    assert rows(blocking.fill_states(blank, learned), "other", "state") == [(1, "ohio"), (2, "")]
    assert Regime.of("hard2").for_test() is Regime.WIDE and Config().regime is Regime.PLAIN


def test_normalize_record(spark):
    raw = spark.createDataFrame([("S1-1", "Acmé Pvt. Ltd.", "Flat502, MH", "India"), ("S1-2", None, None, None)], "entity_id string, business_name string, business_address string, country string")
    found = {r["entity_id"]: r for r in normalize(raw).collect()}
    assert (found["S1-1"]["core"], found["S1-1"]["state"], found["S1-1"]["nums"]) == ("acme", "maharashtra", "502")
    assert found["S1-2"]["compact"] == ""


def test_stream(spark, tmp_path):
    index = spark.createDataFrame([("u", 1, "red fox"), ("u", 2, "blue dog")], "block string, s1 long, text string")
    spark.createDataFrame([("u", 9, "a blue dog")], "block string, query long, text string").write.parquet(f"{tmp_path}/in")
    got = []
    stream = spark.readStream.schema("block string, query long, text string").parquet(f"{tmp_path}/in")
    q = StreamLinker(index).start(stream, lambda df, n: got.extend(df.collect()), f"{tmp_path}/cp")
    q.processAllAvailable()
    q.stop()
    assert [(r["query"], r["s1"]) for r in got] == [(9, 2)]


def _sources(spark, n, start=0):
    """Three raw sources: every record of the first has a copy in the second and, each second one, a noisy one in the third."""
    first, second, third, truth = [], [], [], []
    words = ["alpha", "bravo", "cedar", "delta", "ember", "falcon", "garnet", "harbor", "indigo", "jasper", "kestrel", "linden"]
    for k in range(start, start + n):
        name = f"{words[k % 12]} {words[(k * 5 + 1) % 12]} traders{k}"
        address = f"{k} Main Street, Springfield {10000 + k}, Ohio"
        first.append((f"S1-{k}", f"{name} Pvt Ltd", address, "US"))
        second.append((f"S2-{k}", f"{name} Private Limited", address.replace("Street", "St"), "US"))
        truth.append((f"S1-{k}", f"S2-{k}"))
        if k % 2 == 0:
            native = f"भारत traders{k}" if k % 4 == 0 else name[1:]
            third.append((f"S3-{k}", native, address.replace("Main", "Mian"), "US"))
            truth.append((f"S1-{k}", f"S3-{k}"))
            first[-1] = (f"S1-{k}", f"bharat traders{k}" if k % 4 == 0 else f"{name} Pvt Ltd", address, "US")
    schema = "entity_id string, business_name string, business_address string, country string"
    raw = {s: spark.createDataFrame(rows, schema) for s, rows in (("s1", first), ("s2", second), ("s3", third))}
    return raw, spark.createDataFrame(truth, "s1 string, other string")


def test_from_raw_rows_to_files(spark, tmp_path):
    """Training writes dictionary, models, decision and both lists; prediction on new rows uses them and learns nothing."""
    small = {"maxIter": 2, "maxDepth": 3, "minInstancesPerNode": 2, "maxBins": 32}
    raw, truth = _sources(spark, 48)
    config = Config(data="", work=f"{tmp_path}/work", output=f"{tmp_path}/out", regime=Regime.HARD)
    matched = train(spark, raw, truth, config, **small)
    decision = tables.read_json(spark, f"{tmp_path}/work/decision")
    assert decision["macro_f05"] > 0.8 and matched.groupBy("other").count().where("count > 1").count() == 0
    assert tables.read_json(spark, f"{tmp_path}/work/dictionary")["names"]["भारत"] == "bharat"
    index = spark.read.parquet(f"{tmp_path}/work/candidates").select("s1").distinct().count()
    lists = tables.read_tsv(spark, f"{tmp_path}/out/matching_results", tables.TRUTH_COLUMNS)
    assert index <= lists.count() < 48 and lists.where("matched_entity_ids <> ''").count() > 20
    columns = set(spark.read.parquet(f"{tmp_path}/work/scored_second").columns)
    from linkwright.operators import features, model

    assert {*features.BASE, *features.EXTENDED, *features.SECOND, *model.CONTEXT, "rk_name_o", "q"} <= columns

    weights = tables.read_json(spark, f"{tmp_path}/work/importances_2")
    assert weights == sorted(weights, key=lambda x: -x[1]) and abs(sum(w for _, w in weights) - 1) < 1e-6
    new, known = _sources(spark, 20, start=200)
    test = Config(data="", work=f"{tmp_path}/test", output=f"{tmp_path}/test_out", regime=Regime.HARD)
    found = predict(spark, new, test, f"{tmp_path}/work")
    hits = found.join(known, ["s1", "other"], "left_semi").count()
    assert hits >= 0.7 * known.count() and hits >= 0.8 * found.count()
    assert tables.read_tsv(spark, f"{tmp_path}/test_out/candidate_pairs", ("source1_entity_id", "candidate_entity_ids")).count() == 20
    assert validate.check_file(spark, f"{tmp_path}/test_out/matching_results", "matched_entity_ids") == []
    again = Config(data="", work=f"{tmp_path}/again", output=f"{tmp_path}/again_out", regime=Regime.HARD)
    assert predict(spark, new, again, f"{tmp_path}/work", reuse=(f"{tmp_path}/test",)).count() == found.count()
    assert not tables.exists(spark, f"{tmp_path}/again/s1_norm")  # taken from the run before


@pytest.mark.parametrize("short_bytes", [1 << 20, 0])
def test_contained_passages(spark, monkeypatch, short_bytes):
    """Long and short passages, parts of words, repeated items, nulls and the empty text, by both ways for short ones."""
    from linkwright.plans import analysis

    monkeypatch.setattr(analysis, "SHORT_BYTES", short_bytes)
    words = [f"w{k % 13}x{k % 7}" for k in range(120)]
    texts = [" ".join(words[k : k + 30]) for k in range(0, 90, 10)] + [None, "", "ab", "abcdefghij klm", words[5]]
    passages = [" ".join(words[12:20])[1:-1], " ".join(words[0:4]), words[3][1:], "ab", "cdefghij", "bcdefghij kl", None, "", " ".join(words[12:20])[1:-1], "zz zz zz zz zz zz zz"]
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    items = spark.createDataFrame(list(enumerate(passages)), "item_id long, text string")
    wanted = [(i, d) for i, p in enumerate(passages) for d, t in enumerate(texts) if p is not None and t is not None and p in t]
    assert rows(analysis.contained(items, docs), "item_id", "doc_id") == sorted(wanted)


def test_a_step_with_other_rows_is_built_anew(spark, tmp_path):
    pairs = lambda n: spark.range(n).selectExpr("id AS s1", "id + 1 AS other")
    runner = Runner(spark, f"{tmp_path}/a")
    assert runner.step("x", lambda: pairs(3), pairs(3)).count() == 3
    assert runner.step("x", lambda: pairs(5)).count() == 3 and runner.step("x", lambda: pairs(5), pairs(5)).count() == 5


def test_other_scripts_and_the_french_switch(spark):
    from linkwright.functions import text, translit

    assert translit.to_ascii("Москва Ёлка Αθήνα œuf", {}) == "moskva elka athena oeuf"
    assert translit.address_to_ascii("भारत नगर, 5 Main", {}, {"भारत नगर": "bharat nagar"}) == "bharat nagar, 5 main"
    df = spark.createDataFrame([("durand et fils", "3bis rue x", "france")], "n string, a string, country string")
    for french, core, nums in ((True, "durand", "3"), (False, "durand fils", "3")):
        r = df.select(text.name_parts(F.col("n"), F.col("country"), french).alias("n"), text.address_parts(F.col("a"), F.col("country"), french).alias("a")).first()
        assert (r["n"]["core"], r["a"]["nums"]) == (core, nums)


def test_samples_and_regimes(spark):
    df = spark.range(1000).withColumnRenamed("id", "s1")
    a, b = (sorted(r["s1"] for r in tables.seeded_sample(x, ["s1"], 30, seed=3).collect()) for x in (df, df.repartition(7)))
    assert a == b and len(a) == 30 and a != sorted(r["s1"] for r in tables.seeded_sample(df, ["s1"], 30, seed=4).collect())
    again = tables.sample_again(df, 0.5, seed=5)
    assert 350 < again.count() < 650 and again.distinct().count() < again.count()
    kept = blocking.thinned(df, Regime.HARD).count()
    assert 760 < kept < 880 and blocking.thinned(df, Regime.PLAIN).count() == 1000


@pytest.mark.parametrize("gone", [(), ("linkwright/llm", "corpus_pipeline.py"), ("linkwright/llm",), ("corpus_pipeline.py",)])
def test_registry_without_the_extras(tmp_path, gone):
    root = Path(__file__).resolve().parents[1]
    for name in ("linkwright", "corpus_pipeline.py", "__spark_entry__.py"):
        if (root / name).is_dir():
            shutil.copytree(root / name, tmp_path / name, ignore=shutil.ignore_patterns("__pycache__"))
        elif (root / name).exists():
            shutil.copy(root / name, tmp_path / name)
    for name in gone:
        shutil.rmtree(tmp_path / name, ignore_errors=True)
        (tmp_path / name).unlink(missing_ok=True)
    code = (
        "import __spark_entry__ as e; from linkwright.plans import registry as r; core = set(r.queries());"
        "assert set(r.oracle_sql()) <= core <= set(e.queries()); print(*sorted(set(e.queries()) - core))"
    )
    done = subprocess.run([sys.executable, "-B", "-c", code], cwd=tmp_path, env=os.environ | {"PYTHONPATH": str(tmp_path)}, capture_output=True, text=True)
    assert done.returncode == 0, done.stderr
    if "linkwright/llm" in gone:
        assert done.stdout.strip() == ""
