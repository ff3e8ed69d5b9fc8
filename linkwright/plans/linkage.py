"""Queries over the documents task: retrieval, competition, decisions, evaluation."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators import blocking, context, decide, evaluate, validate
from ..operators.similarity_join import char_terms, similar_pairs, top_k
from ..sources.tables import list_rows, read_table
from .fixtures import OUTCOME_SQL, TASK_SQL, task

QUERIES, SQL = {}, {}
THRESHOLD = 0.5
GRID = [round(0.30 + 0.02 * k, 2) for k in range(31)]


def query(sql: str | None = None, task_sql: bool = True, outcome: bool = False):
    def add(f):
        QUERIES[f.__name__] = f
        if sql:
            SQL[f.__name__] = (TASK_SQL if task_sql else "") + (OUTCOME_SQL if outcome else "") + sql
        return f

    return add


def _predicted(t) -> DataFrame:
    return decide.decide(t.scored(), THRESHOLD)


def _ids(t) -> DataFrame:
    return t.ids


def _outcomes(t) -> DataFrame:
    return evaluate.outcomes(_predicted(t), t.truth, _ids(t))


@query("SELECT s1, other, p FROM pred")
def owned_matches(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Flagship: similarity join, score, one owner, threshold."""
    return _predicted(task(spark, sf_dir)).select("s1", "other", "p")


@query("SELECT s1, other, sim, CAST(rank AS INTEGER) AS rank FROM found")
def tfidf_word_topk(spark, sf_dir):
    return task(spark, sf_dir).found()


def _title_view(t):
    index = t.s1.select(F.col("country").alias("block"), "s1", F.col("title").alias("text"))
    queries = t.other.select(F.col("country").alias("block"), F.col("other").alias("query"), F.col("title").alias("text"))
    build = lambda: similar_pairs(index, queries, char_terms)
    return top_k(t.keep("titles", build), 3)


_CHAR_SQL = r""",
     cw1 AS (SELECT country AS block, s1 AS id, ' ' || unnest(string_split_regex(lower(title), '\s+')) || ' ' AS s FROM s1t),
     cwq AS (SELECT country AS block, other AS id, ' ' || unnest(string_split_regex(lower(title), '\s+')) || ' ' AS s FROM ot),
     c1 AS (SELECT block, id, term, count(*) AS tf FROM (SELECT block, id, unnest(CASE WHEN length(s) > 3 THEN list_transform(range(1, length(s) - 1), lambda i: substr(s, i, 3)) ELSE [s] END) AS term
            FROM cw1 WHERE s <> '  ') GROUP BY ALL),
     cq AS (SELECT block, id, term, count(*) AS tf FROM (SELECT block, id, unnest(CASE WHEN length(s) > 3 THEN list_transform(range(1, length(s) - 1), lambda i: substr(s, i, 3)) ELSE [s] END) AS term
            FROM cwq WHERE s <> '  ') GROUP BY ALL),
     cdf AS (SELECT c1.block, term, count(*) AS df, any_value(n) AS n FROM c1 JOIN nb ON c1.block = nb.block GROUP BY c1.block, term),
     cidf AS (SELECT block, term, ln((1 + n) / (1 + df)) + 1 AS idf FROM
               (SELECT *, n * 0.02 < 1 OR min(df) OVER (PARTITION BY block) > n * 0.02 AS keeps_all FROM cdf) WHERE keeps_all OR df <= n * 0.02),
     cv1 AS (SELECT block, id, term, w / sqrt(sum(w * w) OVER (PARTITION BY block, id)) AS w FROM
              (SELECT c1.block, id, c1.term, (1 + ln(tf)) * idf AS w FROM c1 JOIN cidf ON c1.block = cidf.block AND c1.term = cidf.term)),
     cvq AS (SELECT block, id, term, w / sqrt(sum(w * w) OVER (PARTITION BY block, id)) AS w FROM
              (SELECT cq.block, id, cq.term, (1 + ln(tf)) * idf AS w FROM cq JOIN cidf ON cq.block = cidf.block AND cq.term = cidf.term)),
     csim AS (SELECT * FROM (SELECT cv1.block, cvq.id AS other, cv1.id AS s1, round(sum(cv1.w * cvq.w), 6) AS sim FROM cv1 JOIN cvq
              ON cv1.block = cvq.block AND cv1.term = cvq.term GROUP BY ALL) WHERE sim > 0.05),
     cfound AS (SELECT * FROM (SELECT s1, other, sim, row_number() OVER (PARTITION BY block, other ORDER BY sim DESC, s1) AS rank FROM csim) WHERE rank <= 3)
"""


@query(_CHAR_SQL + "SELECT s1, other, sim, CAST(rank AS INTEGER) AS rank FROM cfound")
def tfidf_char_topk(spark, sf_dir):
    return _title_view(task(spark, sf_dir)).select("s1", F.col("query").alias("other"), "sim", "rank")


def _both_views(t) -> DataFrame:
    def build():
        names = _title_view(t).select("s1", F.col("query").alias("other"), F.col("sim").alias("sim_name_blk"))
        return blocking.merge_views([names, t.found().select("s1", "other", F.col("sim").alias("sim_addr_blk"))])

    return t.keep("views", build)


_VIEWS_SQL = _CHAR_SQL + """,
     views AS (SELECT s1, other, max(n) AS sim_name_blk, max(a) AS sim_addr_blk FROM
               (SELECT s1, other, sim AS n, 0.0 AS a FROM cfound UNION ALL SELECT s1, other, 0.0, sim FROM found) GROUP BY ALL)
"""


@query(_VIEWS_SQL + "SELECT * FROM views")
def view_union_max(spark, sf_dir):
    return _both_views(task(spark, sf_dir))


@query(
    _VIEWS_SQL
    + """SELECT s1, other,
       CAST(rank() OVER (PARTITION BY other ORDER BY sim_name_blk DESC) AS INTEGER) AS rk_name_o, CAST(rank() OVER (PARTITION BY other ORDER BY sim_addr_blk DESC) AS INTEGER) AS rk_addr_o,
       CAST(rank() OVER (PARTITION BY s1 ORDER BY sim_name_blk DESC) AS INTEGER) AS rk_name_s, CAST(rank() OVER (PARTITION BY s1 ORDER BY sim_addr_blk DESC) AS INTEGER) AS rk_addr_s,
       round(max(sim_name_blk) OVER (PARTITION BY other) - sim_name_blk, 6) AS gap_name_o, round(max(sim_addr_blk) OVER (PARTITION BY other) - sim_addr_blk, 6) AS gap_addr_o,
       round(max(sim_name_blk) OVER (PARTITION BY s1) - sim_name_blk, 6) AS gap_name_s,
       count(*) OVER (PARTITION BY other) AS n_cand_o, count(*) OVER (PARTITION BY s1) AS n_cand_s FROM views"""
)
def context_rank_gap(spark, sf_dir):
    out = context.candidate_context(_both_views(task(spark, sf_dir))).drop("sim_name_blk", "sim_addr_blk", "is_s3")
    return out.withColumns({c: F.round(c, 6) for c in ("gap_name_o", "gap_addr_o", "gap_name_s")})


@query(
    """SELECT s1, other, p, round(ln(p / (1 - p)), 6) AS logit,
       max(p) OVER (PARTITION BY other) AS pmax_o, max(p) OVER (PARTITION BY s1) AS pmax_s,
       CAST(row_number() OVER (PARTITION BY other ORDER BY p DESC, s1) AS INTEGER) AS prk_o, CAST(row_number() OVER (PARTITION BY s1 ORDER BY p DESC, other) AS INTEGER) AS prk_s,
       round(sum(p) OVER (PARTITION BY other), 6) AS psum_o, round(sum(p) OVER (PARTITION BY s1), 6) AS psum_s,
       CAST(sum(CASE WHEN p >= 0.5 THEN 1 ELSE 0 END) OVER (PARTITION BY other) AS BIGINT) AS n05_o, CAST(sum(CASE WHEN p >= 0.1 THEN 1 ELSE 0 END) OVER (PARTITION BY s1) AS BIGINT) AS n01_s
       FROM scored WHERE p BETWEEN 1e-7 AND 1 - 1e-7"""
)
def score_context(spark, sf_dir):
    out = context.score_context(task(spark, sf_dir).scored()).where(F.col("p").between(1e-7, 1 - 1e-7))
    rounded = {c: F.round(c, 6) for c in ("logit", "psum_o", "psum_s")}
    return out.withColumns(rounded).select("s1", "other", "p", "logit", "pmax_o", "pmax_s", "prk_o", "prk_s", "psum_o", "psum_s", "n05_o", "n01_s")


_RIVAL = """
       coalesce(nth_value(p, 2) OVER (PARTITION BY other ORDER BY p DESC, s1 ROWS BETWEEN UNBOUNDED PRECEDING AND UNBOUNDED FOLLOWING), 0) AS p2_o,
       coalesce(nth_value(p, 2) OVER (PARTITION BY s1 ORDER BY p DESC, other ROWS BETWEEN UNBOUNDED PRECEDING AND UNBOUNDED FOLLOWING), 0) AS p2_s,
       row_number() OVER (PARTITION BY other ORDER BY p DESC, s1) AS ro, row_number() OVER (PARTITION BY s1 ORDER BY p DESC, other) AS rs,
       max(p) OVER (PARTITION BY other) AS mo, max(p) OVER (PARTITION BY s1) AS ms"""


@query(
    f"""SELECT s1, other, p2_o, p2_s, CASE WHEN ro = 1 THEN p2_o ELSE mo END AS rival_o, CASE WHEN rs = 1 THEN p2_s ELSE ms END AS rival_s,
       round(p - mo, 6) AS gap_o, round(p - ms, 6) AS gap_s FROM (SELECT *, {_RIVAL} FROM scored)"""
)
def runner_up_rival(spark, sf_dir):
    out = context.score_context(task(spark, sf_dir).scored())
    return out.select("s1", "other", "p2_o", "p2_s", "rival_o", "rival_s", F.round("gap_o", 6).alias("gap_o"), F.round("gap_s", 6).alias("gap_s"))


@query("SELECT s1, other, max(p) OVER (PARTITION BY s1) AS top FROM scored QUALIFY p >= 0.002")
def pruned_context(spark, sf_dir):
    """Pairs pruned only after the windows have seen them."""
    return context.prune(context.score_context(task(spark, sf_dir).scored()), 0.002).select("s1", "other", F.col("pmax_s").alias("top"))


@query("SELECT s1, other, p FROM owners")
def one_owner(spark, sf_dir):
    return decide.one_owner(task(spark, sf_dir).scored())


@query("SELECT s1, other, p FROM (SELECT *, max(p) OVER (PARTITION BY s1) AS top FROM pred) WHERE p >= 0.7 * top")
def one_owner_rel(spark, sf_dir):
    return decide.decide(task(spark, sf_dir).scored(), THRESHOLD, 0.7)


_EXPECTED = """,
     q AS (SELECT s1, other, p, sum(p) OVER (PARTITION BY s1 ORDER BY p DESC, other ROWS UNBOUNDED PRECEDING) AS hits, row_number() OVER (PARTITION BY s1 ORDER BY p DESC, other) AS k,
                  sum(p) OVER (PARTITION BY s1) AS total, exp(sum(ln(greatest(least(1 - p, 1.0), 1e-9))) OVER (PARTITION BY s1)) AS none FROM owners WHERE p >= 0.02),
     e AS (SELECT *, round(1.25 * hits / (1.25 * hits + 0.25 * (total - hits + 0.02) + (k - hits)), 9) AS ef FROM q),
     b AS (SELECT s1, max(ef) AS top, arg_max(k, (ef, -k)) AS best_k, any_value(none) AS alone FROM e GROUP BY s1)
SELECT e.s1, other, p FROM e JOIN b ON e.s1 = b.s1 WHERE top > alone * 0.98 AND k <= best_k"""


@query(_EXPECTED)
def expected_f_decide(spark, sf_dir):
    return decide.expected_f_decide(task(spark, sf_dir).scored())


def _grid_f05(t, thresholds, relatives) -> DataFrame:
    rows = decide.decide_grid(t.scored(), thresholds, relatives)
    grid = F.explode(F.array(*[F.struct(F.lit(x).alias("thr"), F.lit(y).alias("rel")) for x in thresholds for y in relatives]))
    ids = t.ids.select("s1", grid.alias("g")).select("s1", "g.thr", "g.rel")
    return evaluate.macro_f05(evaluate.outcomes(rows, t.truth, ids, ["thr", "rel"]), ["thr", "rel"])


def _grid_sql(thresholds, relatives) -> str:
    return f""",
     g AS (SELECT CAST(thr AS DOUBLE) AS thr, CAST(rel AS DOUBLE) AS rel FROM (SELECT unnest({list(thresholds)}) AS thr), (SELECT unnest({list(relatives)}) AS rel)),
     gp AS (SELECT * FROM (SELECT thr, rel, s1, other, p, max(p) OVER (PARTITION BY thr, rel, s1) AS top FROM owners, g WHERE p >= thr) WHERE p >= rel * top),
     ga AS (SELECT thr, rel, gp.s1, count(*) AS n_pred, count(truth.other) AS tp FROM gp LEFT JOIN truth ON gp.s1 = truth.s1 AND gp.other = truth.other GROUP BY ALL),
     gb AS (SELECT s1, count(*) AS n_true FROM truth GROUP BY s1),
     gr AS (SELECT g.thr, g.rel, CASE WHEN n_pred IS NULL AND n_true IS NULL THEN 1.0 WHEN coalesce(tp, 0) = 0 THEN 0.0 ELSE 1.25 * tp / (n_pred + 0.25 * coalesce(n_true, 0)) END AS f05
            FROM s1t CROSS JOIN g LEFT JOIN ga ON s1t.s1 = ga.s1 AND g.thr = ga.thr AND g.rel = ga.rel LEFT JOIN gb ON s1t.s1 = gb.s1)
"""


@query(_grid_sql(decide.THRESHOLDS, decide.RELATIVES) + "SELECT thr, rel, count(*) AS n, round(avg(f05), 6) AS macro_f05 FROM gr GROUP BY thr, rel")
def thr_rel_grid(spark, sf_dir):
    return _grid_f05(task(spark, sf_dir), decide.THRESHOLDS, decide.RELATIVES)


@query(_grid_sql(GRID[::3], [0.0]) + "SELECT thr, count(*) AS n, round(avg(f05), 6) AS macro_f05 FROM gr GROUP BY thr")
def threshold_sweep(spark, sf_dir):
    return _grid_f05(task(spark, sf_dir), GRID[::3], [0.0]).drop("rel")


@query(_grid_sql(GRID, [0.0]).replace("SELECT g.thr, g.rel, CASE", "SELECT country, g.thr, g.rel, CASE") + "SELECT country, thr, count(*) AS n, round(avg(f05), 6) AS macro_f05 FROM gr GROUP BY country, thr")
def stratified_sweep(spark, sf_dir):
    t = task(spark, sf_dir)
    rows = decide.decide_grid(t.scored(), GRID, [0.0]).drop("rel")
    ids = t.ids.select("s1", "country", F.explode(F.array(*[F.lit(x) for x in GRID])).alias("thr"))
    return evaluate.macro_f05(evaluate.outcomes(rows, t.truth, ids, ["thr"]), ["country", "thr"])


@query("SELECT count(*) AS n, round(avg(f05), 6) AS macro_f05 FROM res", outcome=True)
def macro_f05(spark, sf_dir):
    return evaluate.macro_f05(_outcomes(task(spark, sf_dir)))


@query(
    """SELECT country, round(sum(tp) / sum(n_pred), 6) AS micro_p, round(sum(tp) / sum(n_true), 6) AS micro_r,
       round(avg(CASE WHEN n_pred = 0 AND n_true = 0 THEN 1.0 WHEN n_pred = 0 THEN 0.0 ELSE tp / n_pred END), 6) AS macro_p,
       round(avg(CASE WHEN n_pred = 0 AND n_true = 0 THEN 1.0 WHEN n_true = 0 THEN 0.0 ELSE tp / n_true END), 6) AS macro_r FROM res GROUP BY country""",
    outcome=True,
)
def micro_macro_pr(spark, sf_dir):
    return evaluate.precision_recall(_outcomes(task(spark, sf_dir)), ["country"])


@query(
    """SELECT CASE WHEN n_true = 0 AND n_pred = 0 THEN 'perfect_singleton' WHEN n_true = 0 THEN 'false_merge_singleton' WHEN tp = 0 THEN 'total_miss' ELSE 'partial_or_full' END AS outcome,
       count(*) AS n FROM res GROUP BY 1""",
    outcome=True,
)
def outcome_classes(spark, sf_dir):
    return evaluate.outcome_class(_outcomes(task(spark, sf_dir))).groupBy("outcome").agg(F.count(F.lit(1)).alias("n"))


@query(
    """SELECT CASE WHEN f05 = 1 THEN 'ok' WHEN n_true = 0 THEN 'singleton_fp' WHEN tp = 0 THEN 'missed_all' WHEN n_pred > tp AND n_true > tp THEN 'fp_and_fn'
       WHEN n_pred > tp THEN 'fp_only' ELSE 'fn_only' END AS loss_class, count(*) AS n, round(sum(1 - f05) / any_value((SELECT count(*) FROM res)), 6) AS lost FROM res GROUP BY 1""",
    outcome=True,
)
def loss_categories(spark, sf_dir):
    rows = evaluate.loss_class(_outcomes(task(spark, sf_dir)))
    sums = rows.groupBy("loss_class").agg(F.count(F.lit(1)).alias("n"), F.sum(1 - F.col("f05")).alias("lost"))
    total = rows.agg(F.count(F.lit(1)).alias("all"))  # one row
    return sums.crossJoin(total).select("loss_class", "n", F.round(F.col("lost") / F.col("all"), 6).alias("lost"))


_REASONS = """,
     missed AS (SELECT t.s1, t.other, CASE WHEN f.other IS NULL THEN 'not_in_candidates' WHEN o.s1 <> t.s1 THEN 'stolen_by_other_s1' ELSE 'below_thr' END AS reason
                FROM truth t LEFT JOIN pred p ON t.s1 = p.s1 AND t.other = p.other LEFT JOIN found f ON t.s1 = f.s1 AND t.other = f.other
                LEFT JOIN owners o ON t.other = o.other WHERE p.other IS NULL)
"""


@query(_REASONS + "SELECT * FROM missed")
def fn_reasons(spark, sf_dir):
    t = task(spark, sf_dir)
    return evaluate.miss_reasons(t.truth, _predicted(t), t.found(), decide.one_owner(t.scored()))


@query(
    """SELECT p.s1, p.other, CASE WHEN p.other IN (SELECT other FROM truth) THEN 'other_belongs_elsewhere' ELSE 'other_is_distractor' END AS reason
       FROM pred p LEFT JOIN truth t ON p.s1 = t.s1 AND p.other = t.other WHERE t.other IS NULL"""
)
def fp_reasons(spark, sf_dir):
    t = task(spark, sf_dir)
    return evaluate.false_match_reasons(_predicted(t), t.truth)


@query(
    r""",
     traits AS (SELECT other, country = 'en' AS english, regexp_matches(body, '[0-9]') AS has_digit, body = '' AS no_body FROM ot),
     rows_ AS (SELECT t.s1, t.other, p.other AS hit, f.other AS cand, english, has_digit, no_body FROM truth t JOIN traits USING (other)
               LEFT JOIN pred p ON t.s1 = p.s1 AND t.other = p.other LEFT JOIN found f ON t.s1 = f.s1 AND t.other = f.other),
     sl AS (SELECT 'all' AS slice, * FROM rows_ UNION ALL SELECT 'english', * FROM rows_ WHERE english UNION ALL SELECT 'has_digit', * FROM rows_ WHERE has_digit
            UNION ALL SELECT 'no_body', * FROM rows_ WHERE no_body)
SELECT slice, count(*) AS truth, count(*) - count(hit) AS missed, count(*) - count(cand) AS not_candidate,
       round(1 - (count(*) - count(cand)) / count(*), 6) AS block_recall, round((count(*) - count(hit)) / count(*), 6) AS miss_rate FROM sl GROUP BY slice"""
)
def trait_slices(spark, sf_dir):
    t = task(spark, sf_dir)
    traits = t.traits(english=F.col("lang") == "en", has_digit=F.col("body").rlike("[0-9]"), no_body=F.col("body") == "")
    return evaluate.trait_slices(t.truth, _predicted(t), t.found(), traits, ["english", "has_digit", "no_body"])


@query(
    """, c AS (SELECT DISTINCT s1 FROM found), r AS (SELECT t.* FROM truth t SEMI JOIN c ON t.s1 = c.s1)
SELECT (SELECT count(*) FROM found) AS pairs, (SELECT count(*) FROM r SEMI JOIN found f ON r.s1 = f.s1 AND r.other = f.other) AS hits, (SELECT count(*) FROM r) AS relevant,
       round((SELECT count(*) FROM r SEMI JOIN found f ON r.s1 = f.s1 AND r.other = f.other) / (SELECT count(*) FROM r), 6) AS recall,
       round((SELECT count(*) FROM found) / (SELECT count(*) FROM c), 6) AS per_record"""
)
def blocking_recall(spark, sf_dir):
    t = task(spark, sf_dir)
    return blocking.recall_report(t.found().select("s1", "other"), t.truth)


@query(
    """, ranked AS (SELECT s1, other, row_number() OVER (PARTITION BY other ORDER BY sim DESC, s1) AS rank FROM sims)
SELECT CAST(k AS INTEGER) AS k, count(*) AS pairs, count(t.other) AS hits FROM (SELECT unnest([1, 2, 3, 5, 10]) AS k) ks JOIN ranked r ON rank <= k LEFT JOIN truth t ON r.s1 = t.s1 AND r.other = t.other GROUP BY k"""
)
def k_sweep(spark, sf_dir):
    t = task(spark, sf_dir)
    ranked = top_k(t.nearest(10), 10, ["other"]).select("s1", "other", "rank")
    return blocking.k_sweep(ranked, t.truth, [1, 2, 3, 5, 10])


@query(
    """, l AS (SELECT s1, string_agg(CAST(other AS VARCHAR), ',' ORDER BY CAST(other AS VARCHAR)) AS m FROM pred GROUP BY s1)
SELECT s1t.s1 AS source1_entity_id, coalesce(m, '') AS matched_entity_ids FROM s1t LEFT JOIN l ON s1t.s1 = l.s1"""
)
def list_output(spark, sf_dir):
    t = task(spark, sf_dir)
    return list_rows(_predicted(t), t.ids, "matched_entity_ids")


def _lists(t):
    return validate.split_lists(list_rows(_predicted(t), t.ids, "matched_entity_ids"), "matched_entity_ids")


@query("SELECT count(*) AS n_rows, count(*) FILTER (WHERE n_pred = 0) AS n_empty, count(*) FILTER (WHERE n_pred > 0) AS n_filled FROM res", outcome=True)
def validate_summary(spark, sf_dir):
    return validate.summary(_lists(task(spark, sf_dir)))


@query(
    """SELECT s1t.s1 AS source1_entity_id, 'unexpected_row' AS finding FROM s1t WHERE s1 NOT IN (SELECT doc_id FROM labels)
UNION ALL SELECT doc_id, 'missing_row' FROM labels WHERE doc_id NOT IN (SELECT s1 FROM s1t)"""
)
def validate_membership(spark, sf_dir):
    """Rows of the output against a required set: here, the labelled documents."""
    lists = _lists(task(spark, sf_dir))
    required = read_table(spark, sf_dir, "labels").select(F.col("doc_id").alias("source1_entity_id"))
    extra = validate.unexpected_rows(lists, required).select("source1_entity_id", F.lit("unexpected_row").alias("finding"))
    return extra.unionByName(validate.missing_rows(lists, required).select("source1_entity_id", F.lit("missing_row").alias("finding")))


@query("SELECT s1 AS source1_entity_id, CAST(other AS VARCHAR) AS id FROM truth t ANTI JOIN found f ON t.s1 = f.s1 AND t.other = f.other")
def validate_subset(spark, sf_dir):
    """Listed ids that were never candidates: here, of the truth's lists."""
    t = task(spark, sf_dir)
    split = lambda pairs, c: validate.split_lists(list_rows(pairs, t.ids, c), c)
    return validate.outside_candidates(split(t.truth, "matched_entity_ids"), split(t.found(), "candidate_entity_ids"))


@query("SELECT n_true AS matches, count(*) AS records FROM per GROUP BY n_true", outcome=True)
def match_cardinality(spark, sf_dir):
    return _outcomes(task(spark, sf_dir)).groupBy(F.col("n_true").alias("matches")).agg(F.count(F.lit(1)).alias("records"))


@query("SELECT a.country AS c1, b.country AS c2, count(*) AS pairs FROM truth t JOIN s1t a ON t.s1 = a.s1 JOIN ot b ON t.other = b.other GROUP BY ALL")
def partition_check(spark, sf_dir):
    """Countries of true pairs; a strict partition has c1 = c2 only."""
    t = task(spark, sf_dir)
    pairs = t.truth.join(t.s1.select("s1", F.col("country").alias("c1")), "s1").join(t.other.select("other", F.col("country").alias("c2")), "other")
    return pairs.groupBy("c1", "c2").agg(F.count(F.lit(1)).alias("pairs"))


@query(
    """SELECT country, count(*) AS n, round(quantile_cont(sim, 0.1), 6) AS p10, round(quantile_cont(sim, 0.25), 6) AS p25, round(quantile_cont(sim, 0.5), 6) AS p50,
       round(quantile_cont(sim, 0.75), 6) AS p75, round(quantile_cont(sim, 0.9), 6) AS p90 FROM (SELECT country, round(sim, 3) AS sim FROM found JOIN s1t ON found.s1 = s1t.s1) GROUP BY country"""
)
def percentiles_by_group(spark, sf_dir):
    t = task(spark, sf_dir)
    rows = t.found().join(t.ids, "s1").withColumn("sim", F.round("sim", 3))
    shares = (0.1, 0.25, 0.5, 0.75, 0.9)
    return rows.groupBy("country").agg(F.count(F.lit(1)).alias("n"), *[F.round(F.percentile("sim", F.lit(s)), 6).alias(f"p{round(100 * s)}") for s in shares])
