"""Descriptive queries, sampling and splitting, and the trained models."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from ..functions import text
from ..functions.fixed import EDA_STOPWORDS
from ..operators import context, features, model, translit_learn, validate
from ..operators.similarity_join import char_terms, similar_pairs, top_k
from ..sources.tables import list_rows, read_table
from . import duck
from .fixtures import OUTCOME_SQL, TASK_SQL, task
from .linkage import _both_views, _outcomes, _predicted
from .pipeline import pair_table
from .records import BOTH_SQL, addressed

QUERIES, SQL = {}, {}
TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()


def query(sql: str | None = None):
    def add(f):
        QUERIES[f.__name__] = f
        if sql:
            SQL[f.__name__] = sql
        return f

    return add


@query(" UNION ALL ".join(f"SELECT '{t}' AS name, count(*) AS n_rows FROM {t}" for t in TABLES))
def scan_counts(spark, sf_dir) -> DataFrame:
    parts = [read_table(spark, sf_dir, t).agg(F.count(F.lit(1)).alias("n_rows")).select(F.lit(t).alias("name"), "n_rows") for t in TABLES]
    return reduce(lambda a, b: a.union(b), parts)


@query(
    TASK_SQL
    + """, c AS (SELECT t.s1, array_to_string(list_sort(list_distinct(list(d.source))), '+') AS combo FROM truth t JOIN documents d ON t.other = d.doc_id GROUP BY t.s1)
SELECT combo, count(*) AS records FROM c GROUP BY combo"""
)
def source_combos(spark, sf_dir):
    """Which sources a record's matches come from."""
    sources = read_table(spark, sf_dir, "documents", ["doc_id", "source"])
    truth = task(spark, sf_dir).truth.join(sources, F.col("other") == F.col("doc_id"))
    combos = truth.groupBy("s1").agg(F.array_join(F.array_sort(F.collect_set("source")), "+").alias("combo"))
    return combos.groupBy("combo").agg(F.count(F.lit(1)).alias("records"))


@query(
    TASK_SQL
    + f""", tp AS (SELECT a.body AS a, b.body AS b FROM truth t JOIN s1t a ON t.s1 = a.s1 JOIN ot b ON t.other = b.other),
     k AS (SELECT *, list_distinct(list_filter(regexp_extract_all(lower(a), '[a-z0-9]+'), lambda t: length(t) >= 3 AND NOT list_contains({duck.listed(EDA_STOPWORDS)}, t))) AS ta,
                  list_distinct(list_filter(regexp_extract_all(lower(b), '[a-z0-9]+'), lambda t: length(t) >= 3 AND NOT list_contains({duck.listed(EDA_STOPWORDS)}, t))) AS tb,
                  {duck.char_ngrams('a', 4)} AS ga, {duck.char_ngrams('b', 4)} AS gb FROM tp)
SELECT count(*) AS pairs, count(*) FILTER (WHERE list_has_any(ta, tb)) AS by_token, count(*) FILTER (WHERE list_has_any(ga, gb)) AS by_gram4,
       count(*) FILTER (WHERE lower(substr(trim(a), 1, 4)) = lower(substr(trim(b), 1, 4))) AS by_prefix4,
       count(*) FILTER (WHERE list_has_any(ta, tb) OR list_has_any(ga, gb)) AS by_any FROM k"""
)
def key_recall_ceiling(spark, sf_dir):
    """How many true pairs share each blocking key."""
    t = task(spark, sf_dir)
    pairs = t.truth.join(t.s1.select("s1", F.col("body").alias("a")), "s1").join(t.other.select("other", F.col("body").alias("b")), "other")
    start = lambda c: F.substring(c, 1, 300)
    whole_words = lambda c: F.regexp_replace(F.lower(start(c)), "[a-z0-9]+$", "")
    long_grams = lambda c: F.filter(text.char_ngrams(start(c), 4), lambda g: F.length(g) == 4)
    both = lambda f: F.arrays_overlap(f(F.col("a")), f(F.col("b")))
    # What the beginnings share, the whole texts share; all others are compared whole.
    token = F.when(both(lambda c: text.clean_token_set(whole_words(c))), True).otherwise(both(text.clean_token_set))
    gram = F.when(both(long_grams), True).otherwise(both(lambda c: text.char_ngrams(c, 4)))
    prefix = F.lower(F.substring(F.trim("a"), 1, 4)) == F.lower(F.substring(F.trim("b"), 1, 4))
    n = lambda c: F.count(F.when(c, 1))
    marked = pairs.select(token.alias("token"), gram.alias("gram"), prefix.alias("prefix"))
    return marked.agg(
        F.count(F.lit(1)).alias("pairs"), n(F.col("token")).alias("by_token"), n(F.col("gram")).alias("by_gram4"), n(F.col("prefix")).alias("by_prefix4"),
        n(F.col("token") | F.col("gram")).alias("by_any"),
    )


@query(
    "SELECT lang, count(*) AS n, count(*) FILTER (WHERE text IS NULL) AS n_null, round(avg(length(text)), 6) AS mean_length, CAST(median(length(text)) AS DOUBLE) AS median_length, "
    "CAST(max(length(text)) AS INTEGER) AS max_length FROM documents GROUP BY lang"
)
def length_stats(spark, sf_dir):
    n = F.length("text")
    return read_table(spark, sf_dir, "documents").groupBy("lang").agg(
        F.count(F.lit(1)).alias("n"), F.count(F.when(F.col("text").isNull(), 1)).alias("n_null"), F.round(F.avg(n), 6).alias("mean_length"),
        F.median(n).alias("median_length"), F.max(n).alias("max_length"),
    )


@query(
    """SELECT r_name, round(count(*) FILTER (WHERE c_mktsegment = 'AUTOMOBILE') / count(*), 6) AS automobile, round(count(*) FILTER (WHERE c_mktsegment = 'BUILDING') / count(*), 6) AS building,
       round(count(*) FILTER (WHERE c_mktsegment = 'MACHINERY') / count(*), 6) AS machinery, count(*) AS n
FROM customer JOIN nation ON c_nationkey = n_nationkey JOIN region ON n_regionkey = r_regionkey GROUP BY r_name"""
)
def crosstab_share(spark, sf_dir):
    """Row-normalized crosstab by pivot."""
    c, n, r = (read_table(spark, sf_dir, t) for t in ("customer", "nation", "region"))
    rows = c.join(F.broadcast(n), F.col("c_nationkey") == F.col("n_nationkey")).join(F.broadcast(r), F.col("n_regionkey") == F.col("r_regionkey"))
    names = ["AUTOMOBILE", "BUILDING", "MACHINERY"]
    table = rows.groupBy("r_name").pivot("c_mktsegment", names).count().na.fill(0)
    total = rows.groupBy("r_name").agg(F.count(F.lit(1)).alias("n"))
    return table.join(total, "r_name").select("r_name", *[F.round(F.col(x) / F.col("n"), 6).alias(x.lower()) for x in names], "n")


@query("SELECT c_mktsegment, count(*) AS n, round(count(*) / sum(count(*)) OVER (), 6) AS share FROM customer GROUP BY c_mktsegment")
def value_shares(spark, sf_dir):
    counts = read_table(spark, sf_dir, "customer").groupBy("c_mktsegment").agg(F.count(F.lit(1)).alias("n"))
    total = counts.agg(F.sum("n").alias("total"))  # one row
    return counts.crossJoin(total).select("c_mktsegment", "n", F.round(F.col("n") / F.col("total"), 6).alias("share"))


@query("SELECT n_regionkey, arg_max(c_mktsegment, (n, m)) AS common FROM (SELECT n_regionkey, c_mktsegment, count(*) AS n, -row_number() OVER (PARTITION BY n_regionkey ORDER BY c_mktsegment) AS m "
       "FROM customer JOIN nation ON c_nationkey = n_nationkey GROUP BY n_regionkey, c_mktsegment) GROUP BY n_regionkey")
def group_mode(spark, sf_dir):
    """Most frequent value of a group; ties to the first in order."""
    c, n = read_table(spark, sf_dir, "customer"), read_table(spark, sf_dir, "nation")
    rows = c.join(F.broadcast(n), F.col("c_nationkey") == F.col("n_nationkey"))
    return rows.groupBy("n_regionkey").agg(F.mode("c_mktsegment", True).alias("common"))


@query("SELECT c_custkey FROM (SELECT c_custkey, row_number() OVER (PARTITION BY c_nationkey ORDER BY c_custkey) AS r FROM customer) WHERE r % 5 = 0")
def systematic_sample(spark, sf_dir):
    """Every fifth customer of each nation, in order of the key: a sampling operator."""
    w = W.partitionBy("c_nationkey").orderBy("c_custkey")
    return read_table(spark, sf_dir, "customer").withColumn("r", F.row_number().over(w)).where("r % 5 = 0").select("c_custkey")


@query("SELECT c_custkey, c_name FROM customer WHERE c_mktsegment = 'BUILDING' ORDER BY c_acctbal DESC, c_custkey LIMIT 10")
def first_samples(spark, sf_dir):
    """A report of the first ten rows in a stated order."""
    rows = read_table(spark, sf_dir, "customer").where(F.col("c_mktsegment") == "BUILDING")
    return rows.orderBy(F.desc("c_acctbal"), "c_custkey").limit(10).select("c_custkey", "c_name")


@query("SELECT CAST(p AS INTEGER) AS p, CAST(r AS INTEGER) AS r, round(1.25 * p * r / (0.25 * p + r) / 10, 6) AS f05 FROM (SELECT unnest(range(1, 11)) AS p), (SELECT unnest(range(1, 11)) AS r)")
def f05_curve(spark, sf_dir):
    """F0.5 over a grid of precision and recall in tenths."""
    p, r = F.col("p"), F.col("r")
    grid = spark.range(1, 11).select(F.col("id").cast("int").alias("p"), F.explode(F.sequence(F.lit(1), F.lit(10))).alias("r"))
    return grid.select("p", "r", F.round(1.25 * p * r / (0.25 * p + r) / 10, 6).alias("f05"))


_PART = "(s1 * 2654435761) % 1000 % 10"


@query(TASK_SQL + f"SELECT s1, other FROM found WHERE other IN (SELECT other FROM found WHERE {_PART} = 9)")
def competing_pairs(spark, sf_dir):
    """Validation keeps every candidate that competes for a record it touches."""
    return model.split_parts(task(spark, sf_dir).found().select("s1", "other"), F.expr(_PART))[1]


@query(TASK_SQL + f"SELECT CASE WHEN {_PART} <= 2 THEN 'train' WHEN other IN (SELECT other FROM found WHERE {_PART} = 9) THEN 'validation' ELSE 'rest' END AS part, count(*) AS pairs FROM found GROUP BY 1")
def disjoint_cover(spark, sf_dir):
    """Parts of a pair table by semi and anti joins; together they are the whole."""
    pairs = task(spark, sf_dir).found().select("s1", "other")
    training, held = model.split_parts(pairs, F.expr(_PART))
    held = held.join(training, ["s1", "other"], "left_anti")
    rest = pairs.join(training, ["s1", "other"], "left_anti").join(held, ["s1", "other"], "left_anti")
    tagged = [df.select(F.lit(name).alias("part")) for name, df in (("train", training), ("validation", held), ("rest", rest))]
    return reduce(lambda a, b: a.union(b), tagged).groupBy("part").agg(F.count(F.lit(1)).alias("pairs"))


@query("SELECT c_custkey AS s1 FROM customer WHERE (c_custkey * 11) % 100 >= 18")
def density_drop(spark, sf_dir):
    """The index thinned as in the hard regime: a sampling operator."""
    return read_table(spark, sf_dir, "customer").where((F.col("c_custkey") * 11) % 100 >= 18).select(F.col("c_custkey").alias("s1"))


@query(TASK_SQL + "SELECT coalesce(CAST(t.other IS NOT NULL AS INTEGER), 0) AS y, count(*) AS n, round(avg(p), 6) AS mean_p FROM scored s LEFT JOIN truth t ON s.s1 = t.s1 AND s.other = t.other GROUP BY 1")
def class_balance(spark, sf_dir):
    t = task(spark, sf_dir)
    rows = model.labelled(t.scored(), t.truth)
    return rows.groupBy(F.col("y").cast("int").alias("y")).agg(F.count(F.lit(1)).alias("n"), F.round(F.avg("p"), 6).alias("mean_p"))


@query(TASK_SQL + OUTCOME_SQL + "SELECT count(*) AS n, min(p) AS min_p, median(p) AS median_p, max(p) AS max_p FROM pred WHERE s1 IN (SELECT s1 FROM per WHERE n_true = 0)")
def singleton_check(spark, sf_dir):
    """Scores of the matches given to records that have none."""
    t = task(spark, sf_dir)
    alone = _outcomes(t).where("n_true = 0").select("s1")
    wrong = _predicted(t).join(alone, "s1", "left_semi")
    return wrong.agg(F.count(F.lit(1)).alias("n"), F.min("p").alias("min_p"), F.median("p").alias("median_p"), F.max("p").alias("max_p"))


_ORDER_LISTS = "SELECT CAST(o_custkey AS VARCHAR) AS source1_entity_id, string_agg(concat('S', CAST(o_orderkey % 4 AS VARCHAR), '-', CAST(o_orderkey % 7 AS VARCHAR)), ',') AS ids FROM orders GROUP BY o_custkey"


def _order_lists(spark, sf_dir) -> DataFrame:
    rows = read_table(spark, sf_dir, "orders")
    part = F.concat(F.lit("S"), (F.col("o_orderkey") % 4).cast("string"), F.lit("-"), (F.col("o_orderkey") % 7).cast("string"))
    lists = rows.groupBy("o_custkey").agg(F.array_join(F.collect_list(part), ",").alias("ids"))
    return validate.split_lists(lists.select(F.col("o_custkey").cast("string").alias("source1_entity_id"), "ids"), "ids")


@query(f"SELECT source1_entity_id FROM ({_ORDER_LISTS}) WHERE len(string_split(ids, ',')) <> len(list_distinct(string_split(ids, ',')))")
def validate_dups(spark, sf_dir):
    return validate.repeated_ids(_order_lists(spark, sf_dir))


@query(f"SELECT source1_entity_id, id FROM (SELECT source1_entity_id, unnest(string_split(ids, ',')) AS id FROM ({_ORDER_LISTS})) WHERE id NOT LIKE 'S2-%' AND id NOT LIKE 'S3-%'")
def validate_prefix(spark, sf_dir):
    return validate.wrong_prefix(_order_lists(spark, sf_dir), ["S2-", "S3-"])


@query("SELECT CAST(o_custkey AS VARCHAR) AS source1_entity_id, count(*) AS n FROM orders GROUP BY 1 HAVING count(*) > 1")
def validate_repeated_rows(spark, sf_dir):
    rows = read_table(spark, sf_dir, "orders").select(F.col("o_custkey").cast("string").alias("source1_entity_id"))
    return validate.repeated_rows(rows)


@query(f"SELECT source1_entity_id, id FROM (SELECT source1_entity_id, unnest(string_split(ids, ',')) AS id FROM ({_ORDER_LISTS})) WHERE id NOT IN (SELECT concat('S2-', CAST(s_suppkey % 5 AS VARCHAR)) FROM supplier)")
def validate_unknown(spark, sf_dir):
    targets = read_table(spark, sf_dir, "supplier").select(F.concat(F.lit("S2-"), (F.col("s_suppkey") % 5).cast("string")).alias("id"))
    return validate.unknown_ids(_order_lists(spark, sf_dir), targets).select("source1_entity_id", "id")


def _grams(table: str, out: str) -> str:
    return f"""{out} AS (SELECT block, id, term, count(*) AS tf FROM (SELECT block, id, unnest(CASE WHEN length(s) > 3 THEN list_transform(range(1, length(s) - 1), lambda i: substr(s, i, 3)) ELSE [s] END) AS term
      FROM (SELECT country AS block, id, ' ' || t || ' ' AS s FROM {table} WHERE t <> '')) GROUP BY ALL)"""


@query(
    BOTH_SQL
    + f""", rows_ AS (SELECT n.id, country, state, CASE WHEN len(core_tokens) > 0 THEN array_to_string(core_tokens, '') ELSE replace(name_full, ' ', '_') END AS t FROM names n JOIN addrs a ON n.id = a.id),
     li AS (SELECT * FROM rows_ WHERE state <> ''), lq AS (SELECT * FROM rows_ WHERE state = ''), nb AS (SELECT country AS block, count(*) AS n FROM li GROUP BY country),
     {_grams('li', 'g1')}, {_grams('lq', 'gq')},
     df AS (SELECT g1.block, term, count(*) AS df, any_value(n) AS n FROM g1 JOIN nb ON g1.block = nb.block GROUP BY g1.block, term),
     idf AS (SELECT block, term, ln((1 + n) / (1 + df)) + 1 AS idf FROM (SELECT *, n * 0.02 < 1 OR min(df) OVER (PARTITION BY block) > n * 0.02 AS k FROM df) WHERE k OR df <= n * 0.02),
     v1 AS (SELECT block, id, term, w / sqrt(sum(w * w) OVER (PARTITION BY block, id)) AS w FROM (SELECT g1.*, (1 + ln(tf)) * idf AS w FROM g1 JOIN idf ON g1.block = idf.block AND g1.term = idf.term)),
     vq AS (SELECT block, id, term, w / sqrt(sum(w * w) OVER (PARTITION BY block, id)) AS w FROM (SELECT gq.*, (1 + ln(tf)) * idf AS w FROM gq JOIN idf ON gq.block = idf.block AND gq.term = idf.term)),
     sm AS (SELECT * FROM (SELECT vq.block, vq.id AS other, v1.id AS s1, round(sum(v1.w * vq.w), 6) AS sim FROM v1 JOIN vq ON v1.block = vq.block AND v1.term = vq.term GROUP BY ALL) WHERE sim > 0.05)
SELECT s1, other, sim FROM (SELECT *, row_number() OVER (PARTITION BY block, other ORDER BY sim DESC, s1) AS r FROM sm) WHERE r <= 5"""
)
def nostate_fallback(spark, sf_dir):
    """Records without a state search their whole country by the name's character grams, five best."""
    rows = addressed(spark, sf_dir).select("id", F.col("country").alias("block"), "state", text.name_text(F.col("compact"), F.replace("name_full", F.lit(" "), F.lit("_"))).alias("text"))
    index = rows.where("state <> ''").select("block", F.col("id").alias("s1"), "text")
    found = top_k(similar_pairs(index, rows.where("state = ''").select("block", F.col("id").alias("query"), "text"), char_terms), 5)
    return found.select("s1", F.col("query").alias("other"), "sim")


@query(
    """SELECT i.item_id, d.doc_id FROM benchmark i JOIN documents d ON contains(d.text, i.text)"""
)
def benchmark_contained(spark, sf_dir):
    """Documents that hold a whole benchmark passage."""
    return contained(read_table(spark, sf_dir, "benchmark"), read_table(spark, sf_dir, "documents", ["doc_id", "text"]))


RUN = 4  # words of an anchor
SHORT_BYTES = 1 << 20  # of passages too short for an anchor that may be sent to every task


def contained(items: DataFrame, docs: DataFrame) -> DataFrame:
    """(item_id, doc_id): documents whose text contains an item's text; null texts contain nothing and are in nothing.

    The rarest run of four inner words of a passage is its anchor (its first and last word may be parts of words of the
    text), so documents meet passages on equal and rare keys. Passages without four inner words meet on their rarest
    run of characters, unless all of them together are so small that every task can hold them.
    """
    items = items.select("item_id", F.col("text").alias("passage")).where(F.col("passage").isNotNull())
    docs = docs.select("doc_id", "text").where(F.col("text").isNotNull())
    runs = lambda c, n: F.transform(F.sequence(F.lit(1), F.size(c) - (n - 1)), lambda i: F.xxhash64(F.array_join(F.slice(c, i, n), " ")))
    inner = F.slice("w", F.lit(2), F.size("w") - 2)
    split = items.withColumn("w", F.split("passage", " "))
    long = split.where(F.size("w") >= RUN + 2).withColumn("w", inner)
    words = docs.withColumn("w", F.split("text", " ")).where(F.size("w") >= RUN)
    met = _by_rarest(long, words, F.array_distinct(runs(F.col("w"), RUN)), F.array_distinct(runs(F.col("w"), RUN)))
    out = met.join(docs, "doc_id").where(F.contains("text", "passage")).select("item_id", "doc_id")

    short = split.where(F.size("w") < RUN + 2).drop("w")
    size = short.agg(F.sum(F.octet_length("passage"))).first()[0]
    if size is None:
        return out
    if size <= SHORT_BYTES:
        few = docs.join(F.broadcast(short), F.contains("text", "passage"))
        return out.unionByName(few.select("item_id", "doc_id"))
    for n in sorted({min(r["n"], 8) for r in short.select(F.least(F.length("passage"), F.lit(8)).alias("n")).distinct().collect()}):  # 0 to 8
        own = short.where(F.least(F.length("passage"), F.lit(8)) == n)
        if n == 0:
            out = out.unionByName(own.crossJoin(docs.select("doc_id")).select("item_id", "doc_id"))  # the empty text is in every text: this is the result
            continue
        grams = lambda c, n=n: F.array_distinct(F.transform(F.sequence(F.lit(1), F.length(c) - (n - 1)), lambda i: F.xxhash64(F.substring(c, i, F.lit(n)))))
        near = _by_rarest(own, docs.where(F.length("text") >= n), grams(F.col("passage")), grams(F.col("text")))
        out = out.unionByName(near.join(docs, "doc_id").where(F.contains("text", "passage")).select("item_id", "doc_id"))
    return out


def _by_rarest(items: DataFrame, docs: DataFrame, item_keys, doc_keys) -> DataFrame:
    """(item_id, passage, doc_id): documents with the key of an item that the fewest documents have."""
    asked = items.select("item_id", "passage", F.explode(item_keys).alias("key"))
    hits = docs.select("doc_id", F.explode(doc_keys).alias("key")).join(asked.select("key").distinct(), "key", "left_semi")
    counts = hits.groupBy("key").agg(F.count(F.lit(1)).alias("df"))
    best = asked.join(counts, "key", "left").groupBy("item_id", "passage").agg(F.min(F.struct(F.coalesce("df", F.lit(0)).alias("df"), "key")).alias("best"))
    return best.where(F.col("best.df") > 0).select("item_id", "passage", F.col("best.key").alias("key")).join(hits, "key").drop("key")


def _records_of(df: DataFrame, key: str) -> DataFrame:
    """Documents as records: the title is the name, the first 80 characters behind it are the address."""
    line = F.substring("body", 1, 80)
    rows = df.withColumn("n", text.name_parts(text.fold_ascii(F.col("title")), F.col("country"))).withColumn("a", text.address_parts(line, F.col("country")))
    return rows.select(key, "n.*", "a.*", text.lite(F.col("title")).alias("name_lite"), text.lite(line).alias("addr_lite"), text.script_of(F.col("title")).alias("script"))


def _model_rows(spark, sf_dir) -> DataFrame:
    """Candidates of the documents task with all inputs of both stages."""
    t = task(spark, sf_dir)

    def build() -> DataFrame:
        found = _both_views(t)
        strings = pair_table(found, _records_of(t.s1, "s1"), _records_of(t.other, "other"), ("base", "x", "x2"))
        return model.labelled(context.candidate_context(found).join(strings, ["s1", "other"]), t.truth)

    return t.keep("labelled", build)


#: Fewer and smaller trees than the production settings of ``operators.model``, so that a test run is short.
SMALL = {"maxIter": 5, "maxDepth": 4, "minInstancesPerNode": 5, "maxBins": 64}
_FIRST = lambda rows: [c for c in rows.columns if c not in ("s1", "other", "y", *features.EXTENDED, *features.SECOND)]


@query()
def gbt_score(spark, sf_dir):
    """The first stage on all its inputs: fitted on the training part, scores of the validation part with its competitors."""
    rows = _model_rows(spark, sf_dir)
    training, held = model.split_parts(rows, model.bucket(F.col("s1"), 7, 10))
    return model.score(model.train(training, _FIRST(rows), **SMALL), held).select("s1", "other", F.round("p", 4).alias("p"))


@query()
def oof_score(spark, sf_dir):
    """Two stages on all their inputs, both scored out of fold."""
    rows = _model_rows(spark, sf_dir)
    out = model.two_stage(rows, _FIRST(rows), [*features.EXTENDED, *features.SECOND], **SMALL)
    return out.select("s1", "other", F.round("p", 4).alias("p"), F.round("q", 4).alias("q"))


@query()
def learned_dictionary(spark, sf_dir):
    """Native tokens and their Latin spelling, learned from pairs made of the nations' names."""
    names = read_table(spark, sf_dir, "customer").select(F.concat(F.lit("भारत "), F.lower("c_mktsegment")).alias("native"), F.concat(F.lit("bharat "), F.lower("c_mktsegment")).alias("latin"))
    return translit_learn.select_entries(translit_learn.aligned_tokens(names))


@query("SELECT c_nationkey AS s1, string_agg(CAST(c_custkey AS VARCHAR), ',' ORDER BY CAST(c_custkey AS VARCHAR)) AS m FROM customer GROUP BY c_nationkey")
def grouped_lists(spark, sf_dir):
    rows = read_table(spark, sf_dir, "customer").select(F.col("c_nationkey").alias("s1"), F.col("c_custkey").alias("other"))
    return list_rows(rows, rows.select("s1").distinct(), "m").select(F.col("source1_entity_id").alias("s1"), "m")


@query(
    TASK_SQL + "SELECT other, count(*) AS owners FROM truth GROUP BY other HAVING count(*) > 1"
)
def multi_owner(spark, sf_dir):
    """Records with more than one true owner; there should be none."""
    return task(spark, sf_dir).truth.groupBy("other").agg(F.count(F.lit(1)).alias("owners")).where("owners > 1")


@query(BOTH_SQL + ", b AS (SELECT id, country, state FROM names JOIN addrs USING (id)) SELECT country, state, count(*) AS n FROM b GROUP BY country, state")
def block_sizes(spark, sf_dir):
    return addressed(spark, sf_dir).groupBy("country", "state").agg(F.count(F.lit(1)).alias("n"))
