"""Reports: rule grids, bounds of a prediction, keys and postal codes of pairs, examples and samples."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import fixed, kernels, text
from ..operators import blocking, decide, evaluate, features
from ..sources import tables
from . import duck
from .fixtures import OUTCOME_SQL, TASK_SQL, records, task
from .linkage import _REASONS, GRID, _grid_sql, _ids, _predicted
from .records import _PAIR_SQL, BOTH_SQL, REC_SQL, _pairs, addressed

QUERIES, SQL = {}, {}
POWERS, OUTSIDE = (1.0, 1.5, 2.0), (0.0, 0.02, 0.05, 0.1)
GLOBAL = (0.6, 0.65, 0.7, 0.75)


def query(sql: str | None = None):
    def add(f):
        QUERIES[f.__name__] = f
        if sql:
            SQL[f.__name__] = sql
        return f

    return add


# --- rules and bounds ----------------------------------------------------------------------------

_F05 = "CASE WHEN n_pred IS NULL AND n_true IS NULL THEN 1.0 WHEN coalesce(tp, 0) = 0 THEN 0.0 ELSE 1.25 * tp / (n_pred + 0.25 * coalesce(n_true, 0)) END"


@query(
    TASK_SQL
    + f""",
     g AS (SELECT 'threshold' AS rule, CAST(x AS DOUBLE) AS power, CAST(0 AS DOUBLE) AS m FROM (SELECT unnest({list(GLOBAL)}) AS x)
           UNION ALL SELECT 'expected_f', CAST(x AS DOUBLE), CAST(y AS DOUBLE) FROM (SELECT unnest({list(POWERS)}) AS x), (SELECT unnest({list(OUTSIDE)}) AS y)),
     q AS (SELECT power, m, s1, other, sum(q) OVER w AS hits, row_number() OVER w AS k, sum(q) OVER (PARTITION BY power, m, s1) AS total,
                  exp(sum(ln(greatest(least(1 - q, 1.0), 1e-9))) OVER (PARTITION BY power, m, s1)) AS none
           FROM (SELECT g.power, m, s1, other, p ** g.power AS q FROM owners, g WHERE rule = 'expected_f' AND p >= 0.02)
           WINDOW w AS (PARTITION BY power, m, s1 ORDER BY q DESC, other ROWS UNBOUNDED PRECEDING)),
     e AS (SELECT *, round(1.25 * hits / (1.25 * hits + 0.25 * (total - hits + m) + (k - hits)), 9) AS ef FROM q),
     b AS (SELECT power, m, s1, max(ef) AS top, arg_max(k, (ef, -k)) AS best_k, any_value(none) AS alone FROM e GROUP BY ALL),
     dp AS (SELECT 'threshold' AS rule, g.power, m, s1, other FROM owners, g WHERE rule = 'threshold' AND p >= g.power
            UNION ALL SELECT 'expected_f', e.power, e.m, e.s1, other FROM e JOIN b ON e.s1 = b.s1 AND e.power = b.power AND e.m = b.m WHERE top > alone * (1 - e.m) AND k <= best_k),
     ga AS (SELECT rule, power, m, dp.s1, count(*) AS n_pred, count(truth.other) AS tp FROM dp LEFT JOIN truth ON dp.s1 = truth.s1 AND dp.other = truth.other GROUP BY ALL),
     gb AS (SELECT s1, count(*) AS n_true FROM truth GROUP BY s1)
SELECT g.rule, g.power, g.m, count(*) AS n, round(avg({_F05}), 6) AS macro_f05 FROM s1t CROSS JOIN g
LEFT JOIN ga ON s1t.s1 = ga.s1 AND g.rule = ga.rule AND g.power = ga.power AND g.m = ga.m LEFT JOIN gb ON s1t.s1 = gb.s1 GROUP BY ALL"""
)
def rule_grid(spark, sf_dir):
    """Global thresholds (in column power) beside the expected-F rule for every power and weight outside."""
    t = task(spark, sf_dir)
    return decide.compare_rules(t.scored(), t.truth, t.ids.select("s1"), GLOBAL, POWERS, OUTSIDE)


@query(
    TASK_SQL
    + OUTCOME_SQL
    + """SELECT country, count(*) AS n, round(avg(CASE WHEN n_true = 0 THEN 1.0 ELSE 0.0 END), 6) AS floor, round(avg(f05), 6) AS macro_f05,
       round(avg(CASE WHEN n_true = 0 THEN 1.0 WHEN coalesce(h, 0) = 0 THEN 0.0 ELSE 1.25 * h / (h + 0.25 * n_true) END), 6) AS oracle
FROM res LEFT JOIN (SELECT t.s1, count(*) AS h FROM truth t JOIN found f ON t.s1 = f.s1 AND t.other = f.other GROUP BY t.s1) o ON res.s1 = o.s1 GROUP BY country"""
)
def floor_and_oracle(spark, sf_dir):
    """Macro F0.5 between predicting none and predicting exactly the true candidates."""
    t = task(spark, sf_dir)
    nothing = t.truth.limit(0)
    perfect = t.found().select("s1", "other").join(t.truth, ["s1", "other"], "left_semi")
    out = None
    for name, predicted in (("floor", nothing), ("macro_f05", _predicted(t)), ("oracle", perfect)):
        part = evaluate.macro_f05(evaluate.outcomes(predicted, t.truth, _ids(t)), ["country"]).withColumnRenamed("macro_f05", name)
        out = part if out is None else out.join(part.drop("n"), "country")
    return out


@query(
    TASK_SQL
    + _grid_sql(GRID, [0.0])
    + f"""SELECT 'thr' AS kind, thr, round(avg(f05), 6) AS macro_f05 FROM gr GROUP BY thr
UNION ALL SELECT 'floor', CAST(0 AS DOUBLE), round(avg(CASE WHEN gb.s1 IS NULL THEN 1.0 ELSE 0.0 END), 6) FROM s1t LEFT JOIN gb ON s1t.s1 = gb.s1
UNION ALL SELECT 'oracle', CAST(0 AS DOUBLE), round(avg({_F05}), 6) FROM s1t LEFT JOIN gb ON s1t.s1 = gb.s1
  LEFT JOIN (SELECT t.s1, count(*) AS n_pred, count(*) AS tp FROM truth t JOIN found f ON t.s1 = f.s1 AND t.other = f.other GROUP BY t.s1) o ON s1t.s1 = o.s1"""
)
def full_sweep(spark, sf_dir):
    """The threshold sweep with its floor and its oracle."""
    t = task(spark, sf_dir)
    ids = t.ids.select("s1")
    spread = ids.withColumn("thr", F.explode(F.array(*[F.lit(x) for x in GRID])))
    sweep = evaluate.macro_f05(evaluate.outcomes(decide.decide_grid(t.scored(), GRID, [0.0]).drop("rel"), t.truth, spread, ["thr"]), ["thr"])
    perfect = t.found().select("s1", "other").join(t.truth, ["s1", "other"], "left_semi")
    out = sweep.select(F.lit("thr").alias("kind"), "thr", "macro_f05")
    for name, predicted in (("floor", t.truth.limit(0)), ("oracle", perfect)):
        bound = evaluate.macro_f05(evaluate.outcomes(predicted, t.truth, ids))
        out = out.unionByName(bound.select(F.lit(name).alias("kind"), F.lit(0.0).alias("thr"), "macro_f05"))
    return out


_PART = "(s1 * 2654435761) % 1000 % 10"
_NAMED_PART = f"CASE WHEN {_PART} <= 2 THEN 'train' WHEN {_PART} = 9 THEN 'validation' ELSE 'rest' END"


@query(
    TASK_SQL
    + f"""SELECT {_NAMED_PART.replace('s1 *', 's1t.s1 *')} AS part, count(*) AS records, CAST(sum(coalesce(n, 0)) AS BIGINT) AS pairs, count(*) FILTER (WHERE n IS NULL) AS singletons,
       round(count(*) FILTER (WHERE n IS NULL) / count(*), 6) AS singleton_rate FROM s1t LEFT JOIN (SELECT s1, count(*) AS n FROM truth GROUP BY s1) c ON s1t.s1 = c.s1 GROUP BY 1"""
)
def truth_split(spark, sf_dir):
    """Records, true pairs and records without a match in each part of the split."""
    t = task(spark, sf_dir)
    return evaluate.split_report(t.ids.select("s1"), t.truth, F.expr(_NAMED_PART))


@query(
    TASK_SQL
    + """SELECT a.country AS country, b.country AS other_country, a.country = b.country AS same, count(*) AS n, round(count(*) / sum(count(*)) OVER (), 6) AS share
FROM truth t JOIN s1t a ON t.s1 = a.s1 JOIN ot b ON t.other = b.other GROUP BY a.country, b.country"""
)
def cross_country_matches(spark, sf_dir):
    """True pairs by the countries of their records; blocks never cross countries, so pairs that do are lost to blocking."""
    t = task(spark, sf_dir)
    rows = t.truth.join(t.s1.select("s1", "country"), "s1").join(t.other.select("other", F.col("country").alias("other_country")), "other")
    counts = rows.groupBy("country", "other_country").agg(F.count(F.lit(1)).alias("n"))
    total = counts.agg(F.sum("n").alias("total"))  # one row
    return counts.crossJoin(total).select("country", "other_country", (F.col("country") == F.col("other_country")).alias("same"), "n", F.round(F.col("n") / F.col("total"), 6).alias("share"))


# --- examples and samples ------------------------------------------------------------------------


@query(
    TASK_SQL
    + _REASONS
    + """SELECT reason, s1, other, a.title AS title, substr(b.body, 1, 40) AS body FROM
      (SELECT *, row_number() OVER (PARTITION BY reason ORDER BY md5(concat(CAST(s1 AS VARCHAR), '|', CAST(other AS VARCHAR), '|7')), s1, other) AS r FROM missed) m
      JOIN s1t a USING (s1) JOIN ot b USING (other) WHERE r <= 5"""
)
def example_dumps(spark, sf_dir):
    """A report of five missed pairs for each reason, drawn by a seeded hash, with their raw texts."""
    t = task(spark, sf_dir)
    missed = evaluate.miss_reasons(t.truth, _predicted(t), t.found(), decide.one_owner(t.scored()))
    drawn = tables.seeded_sample(missed, ["s1", "other"], 5, seed=7, by=["reason"])
    joined = drawn.join(t.s1.select("s1", "title"), "s1").join(t.other.select("other", "body"), "other")
    return joined.select("reason", "s1", "other", "title", F.substring("body", 1, 40).alias("body"))


@query("SELECT c_custkey, c_name FROM customer ORDER BY md5(concat(CAST(c_custkey AS VARCHAR), '|42')), c_custkey LIMIT 25")
def seeded_sample(spark, sf_dir):
    """A sampling operator: 25 rows in the order of a seeded hash of the key."""
    return tables.seeded_sample(tables.read_table(spark, sf_dir, "customer"), ["c_custkey"], 25, seed=42).select("c_custkey", "c_name")


@query(
    "SELECT c_nationkey, count(*) AS n, array_to_string(list_sort(list(CAST(c_custkey AS VARCHAR)))[1:3], ', ') || CASE WHEN count(*) > 3 THEN ', ...' ELSE '' END AS shown FROM customer GROUP BY c_nationkey"
)
def display_ids(spark, sf_dir):
    """The first ids of each group, as a message shows them."""
    rows = tables.read_table(spark, sf_dir, "customer").select("c_nationkey", F.col("c_custkey").cast("string").alias("id"))
    return tables.shown_ids(rows, "c_nationkey", "id", 3)


# --- states --------------------------------------------------------------------------------------

_LEARNED_SQL = (
    BOTH_SQL
    + r""", comp AS (SELECT r.id, r.country, a.state, unnest(list_transform(string_split(lower(address), ','), lambda x: trim(regexp_replace(x, '[^\p{L}0-9]+', ' ', 'g')))) AS comp
       FROM rec r JOIN addrs a ON r.id = a.id),
     cnt AS (SELECT country, comp, state, count(*) AS n FROM comp WHERE comp <> '' AND state <> '' AND NOT contains(state, '|') GROUP BY ALL),
     learned AS (SELECT country, comp, state AS inferred FROM (SELECT *, sum(n) OVER (PARTITION BY country, comp) AS total FROM cnt) WHERE n / total >= 0.95 AND total >= 5)"""
)


def _with_components(spark, sf_dir) -> DataFrame:
    return addressed(spark, sf_dir).select(F.col("id").alias("other"), "country", "state", text.address_components(F.col("address")).alias("comps"))


@query(_LEARNED_SQL + "SELECT country, comp, inferred FROM learned")
def learned_states(spark, sf_dir):
    """Address components that stand for a state, with the production share."""
    return blocking.learned_states(_with_components(spark, sf_dir))


@query(
    _LEARNED_SQL
    + """, votes AS (SELECT c.id, l.inferred, count(*) AS n FROM comp c JOIN learned l ON c.country = l.country AND c.comp = l.comp WHERE c.state = '' GROUP BY ALL),
     best AS (SELECT id, inferred FROM (SELECT *, row_number() OVER (PARTITION BY id ORDER BY n DESC, inferred) AS r FROM votes) WHERE r = 1)
SELECT r.id AS other, r.country, CASE WHEN a.state = '' THEN coalesce(best.inferred, '') ELSE a.state END AS state FROM rec r JOIN addrs a ON r.id = a.id LEFT JOIN best ON r.id = best.id"""
)
def filled_states(spark, sf_dir):
    """Records with empty states filled from their components."""
    rows = _with_components(spark, sf_dir)
    return blocking.fill_states(rows, blocking.learned_states(rows)).select("other", "country", "state")


# --- keys and postal codes of pairs --------------------------------------------------------------


def _tokens_sql(x: str, least: int) -> str:
    return f"list_filter(regexp_extract_all(lower({x}), '([a-z0-9]+)', 1), lambda t: length(t) >= {least} AND NOT list_contains({duck.listed(fixed.EDA_STOPWORDS)}, t))"


_RAW_PAIRS = f"{REC_SQL}, rp AS (SELECT a.id AS pair, a.country, a.name AS n1, b.name AS n2, a.address AS a1, b.address AS a2, b.country AS country2 FROM rec a JOIN rec b ON a.id % 2 = 0 AND b.id = a.id + 1)"
_KEYS = ["name_token3", "name_token2", "name_gram3", "name_gram4", "prefix3", "prefix4", "addr_token3"]


@query(
    _RAW_PAIRS
    + f""", k AS (SELECT country, list_has_any({_tokens_sql('n1', 3)}, {_tokens_sql('n2', 3)}) AS name_token3, list_has_any({_tokens_sql('n1', 2)}, {_tokens_sql('n2', 2)}) AS name_token2,
       list_has_any({duck.char_ngrams('n1', 3)}, {duck.char_ngrams('n2', 3)}) AS name_gram3, list_has_any({duck.char_ngrams('n1', 4)}, {duck.char_ngrams('n2', 4)}) AS name_gram4,
       c1 <> '' AND substr(c1, 1, 3) = substr(c2, 1, 3) AS prefix3, c1 <> '' AND substr(c1, 1, 4) = substr(c2, 1, 4) AS prefix4,
       list_has_any({_tokens_sql('a1', 3)}, {_tokens_sql('a2', 3)}) AS addr_token3
       FROM (SELECT *, regexp_replace(lower(n1), '[^a-z0-9]', '', 'g') AS c1, regexp_replace(lower(n2), '[^a-z0-9]', '', 'g') AS c2 FROM rp))
SELECT country, count(*) AS pairs, {', '.join(f'count(*) FILTER (WHERE {c}) AS {c}' for c in _KEYS)}, count(*) FILTER (WHERE name_token3 OR addr_token3) AS name_or_addr FROM k GROUP BY country"""
)
def blocking_key_recall(spark, sf_dir):
    """How many pairs share each of eight blocking keys, by country."""
    n1, n2, a1, a2 = (F.col(c) for c in ("name", "name2", "address", "address2"))
    both = lambda f, x, y: F.arrays_overlap(f(x), f(y))
    clean = lambda c: F.regexp_replace(F.lower(c), "[^a-z0-9]", "")
    prefix = lambda n: (clean(n1) != "") & (F.substring(clean(n1), 1, n) == F.substring(clean(n2), 1, n))
    tokens = lambda n: lambda c: text.clean_token_set(c, n)
    grams = lambda n: lambda c: text.char_ngrams(c, n)
    keys = [both(tokens(3), n1, n2), both(tokens(2), n1, n2), both(grams(3), n1, n2), both(grams(4), n1, n2), prefix(3), prefix(4), both(tokens(3), a1, a2)]
    marked = _raw_pairs(spark, sf_dir).select("country", *[k.alias(c) for k, c in zip(keys, _KEYS)])
    n = lambda c: F.count(F.when(c, 1))
    return marked.groupBy("country").agg(
        F.count(F.lit(1)).alias("pairs"), *[n(F.col(c)).alias(c) for c in _KEYS], n(F.col("name_token3") | F.col("addr_token3")).alias("name_or_addr")
    )


def _raw_pairs(spark, sf_dir) -> DataFrame:
    rows = records(spark, sf_dir).select("id", "country", "name", "address")
    right = rows.where(F.col("id") % 2 == 1).select((F.col("id") - 1).alias("pair"), *[F.col(c).alias(f"{c}2") for c in ("country", "name", "address")])
    return rows.where(F.col("id") % 2 == 0).withColumnRenamed("id", "pair").join(right, "pair")


def _postal_sql(a: str, c: str) -> str:
    pin = rf"regexp_extract_all({a}, '\b([1-9][0-9]{{5}})\b', 1)[-1]"
    code = rf"substr(regexp_extract_all({a}, '\b([0-9]{{5}}(?:-[0-9]{{4}})?)\b', 1)[-1], 1, 5)"
    return f"CASE {c} WHEN 'india' THEN {pin} WHEN 'us' THEN {code} END"


@query(
    _RAW_PAIRS
    + f""", s AS (SELECT country, CASE WHEN x IS NOT NULL AND y IS NOT NULL THEN CASE WHEN x = y THEN 'match' ELSE 'mismatch' END
             WHEN x IS NOT NULL OR y IS NOT NULL THEN 'one_missing' ELSE 'both_missing' END AS status
       FROM (SELECT country, {_postal_sql('a1', 'country')} AS x, {_postal_sql('a2', 'country2')} AS y FROM rp))
SELECT country, status, count(*) AS n, round(count(*) / sum(count(*)) OVER (PARTITION BY country), 6) AS share FROM s GROUP BY country, status"""
)
def postal_agreement(spark, sf_dir):
    """Agreement of the postal codes of pairs, with shares by country."""
    pairs = _raw_pairs(spark, sf_dir)
    x, y = text.postal_code(F.col("address"), F.col("country")), text.postal_code(F.col("address2"), F.col("country2"))
    counts = pairs.select("country", text.agreement(x, y).alias("status")).groupBy("country", "status").agg(F.count(F.lit(1)).alias("n"))
    totals = counts.groupBy("country").agg(F.sum("n").alias("total"))
    return counts.join(totals, "country").select("country", "status", "n", F.round(F.col("n") / F.col("total"), 6).alias("share"))


def _similarities(spark, sf_dir) -> DataFrame:
    rows = _raw_pairs(spark, sf_dir)
    kinds = {"ratio": kernels.ratio, "sort": kernels.token_sort_ratio, "set": kernels.token_set_ratio}
    columns: list[Column] = [
        kernels.pair_kernel(k)(F.lower(c), F.lower(f"{c}2")).alias(f"{short}_{n}") for c, short in (("name", "name"), ("address", "addr")) for n, k in kinds.items()
    ]
    return rows.select("pair", "country", "name", "name2", *columns)


@query()
def similarity_percentiles(spark, sf_dir):
    """Percentiles of the string ratios of pairs by country; the ratios have no counterpart in SQL."""
    rows = _similarities(spark, sf_dir)
    names = [f"{a}_{b}" for a in ("name", "addr") for b in ("ratio", "sort", "set")]
    long = rows.select("country", F.explode(F.array(*[F.struct(F.lit(n).alias("kind"), F.col(n).alias("v")) for n in names])).alias("x")).select("country", "x.*")
    return long.groupBy("country", "kind").agg(
        F.round(F.avg("v"), 4).alias("mean"), *[F.round(F.percentile("v", q / 100), 4).alias(f"p{q}") for q in (10, 25, 50, 75, 90)]
    )


@query()
def similarity_examples(spark, sf_dir):
    """A report of three pairs for each rule on the ratios; the ratios have no counterpart in SQL."""
    rule = (
        F.when(F.col("name_ratio") == 100, "exact_name")
        .when((F.col("name_set") > 85) & (F.col("name_ratio") < 60), "abbrev_name")
        .when((F.col("addr_set") > 85) & (F.col("addr_ratio") < 50), "address_reordered")
        .when((F.col("name_sort") < 50) & (F.col("addr_set") > 70), "low_name_high_addr")
    )
    rows = _similarities(spark, sf_dir).withColumn("rule", rule).where(F.col("rule").isNotNull())
    return tables.seeded_sample(rows, ["pair"], 3, seed=1, by=["rule"]).select("rule", "pair", "name", "name2")


# --- features of pairs that SQL can express ------------------------------------------------------

_SETS = "n_jacc n_len1 n_len2 first_tok_eq alias_has legal_eq legal_both a_jacc a_len1 a_len2 a_empty state_eq state_other_empty num_overlap num_jacc".split()


def _jacc(a: str, b: str) -> str:
    both = f"len(list_intersect({a}, {b}))"
    return f"CASE WHEN len({a}) = 0 OR len({b}) = 0 THEN 0.0 ELSE {both} / (len(list_distinct({a})) + len(list_distinct({b})) - {both}) END"


_LEGAL_LIST = duck.listed(sorted(features.LEGAL_KEPT))
_SPLIT = "list_filter(string_split({}, '{}'), lambda t: t <> '')"


@query(
    _PAIR_SQL.replace("SELECT n.id, n.country, core_tokens", "SELECT n.id, n.country, full_tokens, core_tokens")
    + f""", p AS (SELECT a.id AS pair, a.core_tokens AS t1, b.core_tokens AS t2, b.alias_tokens AS al, list_sort(list_distinct(list_filter(a.full_tokens, lambda t: list_contains({_LEGAL_LIST}, t)))) AS l1,
       list_sort(list_distinct(list_filter(b.full_tokens, lambda t: list_contains({_LEGAL_LIST}, t)))) AS l2, {_SPLIT.format('a.addr', ' ')} AS w1, {_SPLIT.format('b.addr', ' ')} AS w2,
       {_SPLIT.format('a.state', '|')} AS s1, {_SPLIT.format('b.state', '|')} AS s2, {_SPLIT.format('a.nums', ' ')} AS m1, {_SPLIT.format('b.nums', ' ')} AS m2
       FROM full_ a JOIN full_ b ON a.id % 2 = 0 AND b.id = a.id + 1)
SELECT pair, round({_jacc('t1', 't2')}, 6) AS n_jacc, CAST(len(t1) AS DOUBLE) AS n_len1, CAST(len(t2) AS DOUBLE) AS n_len2, CAST(len(t1) > 0 AND len(t2) > 0 AND t1[1] = t2[1] AS DOUBLE) AS first_tok_eq,
       CAST(len(al) > 0 AS DOUBLE) AS alias_has, CAST(l1 = l2 AS DOUBLE) AS legal_eq, CAST(len(list_intersect(l1, l2)) > 0 AS DOUBLE) AS legal_both, round({_jacc('w1', 'w2')}, 6) AS a_jacc,
       CAST(len(w1) AS DOUBLE) AS a_len1, CAST(len(w2) AS DOUBLE) AS a_len2, CAST(len(w2) = 0 AS DOUBLE) AS a_empty, CAST(len(list_intersect(s1, s2)) > 0 AS DOUBLE) AS state_eq,
       CAST(len(s2) = 0 AS DOUBLE) AS state_other_empty, CAST(len(list_intersect(m1, m2)) AS DOUBLE) AS num_overlap, round({_jacc('m1', 'm2')}, 6) AS num_jacc FROM p"""
)
def pair_set_features(spark, sf_dir):
    """The base features of pairs that compare sets, as the feature operator computes them."""
    ready = _pairs(spark, sf_dir).withColumns({f"{c}{s}": F.lit("") for c in ("name_lite", "addr_lite", "script") for s in ("", "2")})
    out = features.string_features(features.with_weights(ready, features.idf_table(addressed(spark, sf_dir))), ["pair"], ("base",))
    return out.select("pair", *[F.round(c, 6).alias(c) for c in _SETS])


def _soft_sql(a: str, b: str) -> str:
    """One direction of the soft cosine: sum over ``a`` of weight, partner's weight and likeness."""
    return f"""SELECT pair, sum(w * wy * jw) AS total FROM (SELECT x.pair, x.w, y.w AS wy, CASE WHEN x.term = y.term THEN 1.0 ELSE jaro_winkler_similarity(x.term, y.term) END AS jw,
      row_number() OVER (PARTITION BY x.pair, x.term ORDER BY x.term = y.term DESC, jaro_winkler_similarity(x.term, y.term) DESC, y.pos) AS r
      FROM {a} x JOIN {b} y ON x.pair = y.pair WHERE x.term = y.term OR jaro_winkler_similarity(x.term, y.term) >= 0.9) WHERE r = 1 GROUP BY pair"""


def _unit_sql(side: str) -> str:
    return f"""(SELECT pair, term, pos, idf / sqrt(sum(idf * idf) OVER (PARTITION BY pair)) AS w FROM
      (SELECT pair, term, min(pos) AS pos FROM (SELECT pair, unnest({side}) AS term, generate_subscripts({side}, 1) AS pos FROM pairs) GROUP BY pair, term) JOIN idf USING (term))"""


@query(
    _PAIR_SQL
    + f""", idf AS (SELECT term, ln(n / df) AS idf FROM (SELECT term, count(*) AS df, any_value(n) AS n FROM
      (SELECT unnest(list_distinct(core_tokens)) AS term, (SELECT count(*) FROM names) AS n FROM names
       UNION ALL SELECT unnest(list_distinct(list_filter(string_split(addr, ' '), lambda t: t <> ''))), (SELECT count(*) FROM names) FROM addrs) GROUP BY term)),
     u1 AS {_unit_sql('t1')}, u2 AS {_unit_sql('t2')}, d1 AS ({_soft_sql('u1', 'u2')}), d2 AS ({_soft_sql('u2', 'u1')})
SELECT pairs.pair, CASE WHEN len(t1) = 0 OR len(t2) = 0 THEN -1.0 ELSE round(least(1.0, (coalesce(d1.total, 0) + coalesce(d2.total, 0)) / 2), 4) END AS n2_soft
FROM pairs LEFT JOIN d1 ON pairs.pair = d1.pair LEFT JOIN d2 ON pairs.pair = d2.pair"""
)
def soft_tfidf_names(spark, sf_dir):
    """Soft cosine of the names of pairs, as the feature operator computes it."""
    ready = _pairs(spark, sf_dir).withColumns({f"{c}{s}": F.lit("") for c in ("name_lite", "addr_lite", "script") for s in ("", "2")})
    out = features.string_features(features.with_weights(ready, features.idf_table(addressed(spark, sf_dir))), ["pair"], ("x2",))
    return out.select("pair", F.round("n2_soft", 4).alias("n2_soft"))


# --- ratios of pairs -----------------------------------------------------------------------------

#: Longest common subsequences by rows of the dynamic programme, one step of the recursion for each character of ``b``.
_LCS = """
     lcs AS (SELECT pair, kind, a, b, 0 AS k, list_transform(range(1, length(a) + 1), lambda i: 0) AS row FROM texts
             UNION ALL SELECT pair, kind, a, b, k + 1, list_transform(range(1, length(a) + 1), lambda j: list_max(list_transform(range(1, j + 1),
               lambda i: greatest(row[i], CASE WHEN i > 1 THEN row[i - 1] ELSE 0 END + CASE WHEN substr(a, i, 1) = substr(b, CAST(k + 1 AS BIGINT), 1) THEN 1 ELSE 0 END))))
             FROM lcs WHERE k < length(b)),
     ratios AS (SELECT pair, kind, CASE WHEN length(a) + length(b) = 0 THEN 100.0 ELSE 200.0 * coalesce(list_max(row), 0) / (length(a) + length(b)) END AS r
                FROM lcs WHERE k = length(b))"""


def _sorted_text(x: str) -> str:
    return f"array_to_string(list_sort({x}), ' ')"


@query(
    _PAIR_SQL.replace("WITH rec", "WITH RECURSIVE rec", 1)
    + f""", token_sets AS (SELECT pair, t1, t2, {_sorted_text('list_distinct(list_intersect(t1, t2))')} AS common,
       {_sorted_text('list_distinct(list_filter(t1, lambda t: NOT list_contains(t2, t)))')} AS own1, {_sorted_text('list_distinct(list_filter(t2, lambda t: NOT list_contains(t1, t)))')} AS own2 FROM pairs),
     sides AS (SELECT *, trim(common || ' ' || own1) AS with1, trim(common || ' ' || own2) AS with2 FROM token_sets),
     texts AS (SELECT pair, 'ratio' AS kind, array_to_string(t1, ' ') AS a, array_to_string(t2, ' ') AS b FROM sides
       UNION ALL SELECT pair, 'sort', {_sorted_text('t1')}, {_sorted_text('t2')} FROM sides UNION ALL SELECT pair, 'both', with1, with2 FROM sides
       UNION ALL SELECT pair, 'one', common, with1 FROM sides UNION ALL SELECT pair, 'two', common, with2 FROM sides),
     {_LCS.strip()}
SELECT s.pair, round(max(r) FILTER (WHERE kind = 'ratio'), 4) AS ratio, round(max(r) FILTER (WHERE kind = 'sort'), 4) AS token_sort,
       round(CASE WHEN any_value(len(t1)) = 0 OR any_value(len(t2)) = 0 THEN 0.0 WHEN any_value(common) <> '' AND (any_value(own1) = '' OR any_value(own2) = '') THEN 100.0
             WHEN any_value(common) = '' THEN max(r) FILTER (WHERE kind = 'both') ELSE max(r) FILTER (WHERE kind IN ('both', 'one', 'two')) END, 4) AS token_set
FROM sides s JOIN ratios USING (pair) GROUP BY s.pair"""
)
def token_ratios(spark, sf_dir):
    """Plain, sorted and set ratio of the names of pairs."""
    kinds = {"ratio": kernels.ratio, "token_sort": kernels.token_sort_ratio, "token_set": kernels.token_set_ratio}
    columns = [F.round(kernels.pair_kernel(k)(F.col("core"), F.col("core2")), 4).alias(n) for n, k in kinds.items()]
    return _pairs(spark, sf_dir).select("pair", *columns)
