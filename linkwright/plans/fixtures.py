"""Linkage tasks derived from the driver's tables.

Documents: the first sentence is a document's title; the smallest id of a title is
the reference record (s1), the others with that title are to be linked to it by
the rest of their text, inside their language. Business records: names and
addresses put together from the customers.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators.similarity_join import word_terms
from ..operators.similarity_top import similar_among, similar_top
from ..sources.tables import read_table

K = 3
SLOPE, SHIFT = 12.0, 4.0

RECORDS = """
SELECT c_custkey AS id, c_nationkey AS nationkey,
       CASE c_custkey % 8
         WHEN 0 THEN concat(replace(c_name, '#', ' '), ' Pvt. Ltd.')
         WHEN 1 THEN concat(replace(c_name, '#', ' '), ' & Sons, Incorporated (ID: 123)')
         WHEN 2 THEN concat('M/s ', replace(c_name, '#', ' '), ' Bio1ogics dba Acme Trad3rs')
         WHEN 3 THEN concat('www.shop', CAST(c_custkey AS STRING), '.com ', replace(c_name, '#', ' '))
         WHEN 4 THEN concat(replace(c_name, '#', ' '), ' formerly known as Delta Corporation')
         WHEN 5 THEN concat('Établissements ', replace(c_name, '#', ' '), ' Frères SARL')
         WHEN 6 THEN concat(replace(c_name, '#', ' '), ' 3M H0tels')
         ELSE c_name END AS name,
       CASE c_custkey % 6
         WHEN 0 THEN concat('Flat', CAST(c_custkey AS STRING), ', 4gitanjaliplaza, Sector', CAST(c_custkey % 50 AS STRING), ', Mumbai 400001, MH')
         WHEN 1 THEN concat(CAST(c_custkey AS STRING), ' Main Street, Springfield 12345-6789, Delaware, Ohio')
         WHEN 2 THEN concat('3B Rue de la Paix, N°', CAST(c_custkey AS STRING), ', Nord')
         WHEN 3 THEN concat('No. 00', CAST(c_custkey AS STRING), ', 2ndfloor, Bombay Road, <NULL>, Telangana')
         WHEN 4 THEN concat('Suite ', CAST(c_custkey AS STRING), ', 5th Avenue, n/a, NY 10001')
         ELSE '' END AS address,
       CASE c_custkey % 6 WHEN 0 THEN 'india' WHEN 3 THEN 'india' WHEN 2 THEN 'france' ELSE 'us' END AS country
FROM customer
"""


def records(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spark.sql(RECORDS.replace("FROM customer", "FROM {customer}"), customer=read_table(spark, sf_dir, "customer"))


class DocumentTask:
    """Tables of the documents task; those that cost a similarity join are kept once made, until ``release``.

    Documents without a text have neither title nor body and take no part; the SQL leaves them out as well.
    """

    def __init__(self, spark: SparkSession, sf_dir: str):
        docs = read_table(spark, sf_dir, "documents", ["doc_id", "lang", "text"]).where(F.col("text").isNotNull())
        titled = docs.withColumn("title", F.split_part("text", F.lit("."), F.lit(1)))
        titled = titled.withColumn("body", F.substr("text", F.length("title") + 2))
        owners = titled.groupBy("title").agg(F.min("doc_id").alias("owner"))
        roles = titled.join(owners, "title")
        first = F.col("doc_id") <= F.col("owner")  # equal; as an equality it would be a key of the join, and texts would be shuffled once more for it
        self.texts = titled.select(F.col("doc_id").alias("key"), F.col("lang").alias("block"), F.col("body").alias("text"))
        self._narrow = titled.select("doc_id", F.col("lang").alias("country"), "title").join(owners, "title").select("doc_id", "country", "owner")
        self._titled, self._owners, self._first = titled, owners, first
        self.s1 = roles.where(first).select(F.col("doc_id").alias("s1"), F.col("lang").alias("country"), "title", "body")
        self.other = roles.where(~first).select(F.col("doc_id").alias("other"), F.col("lang").alias("country"), "title", "body")
        self._kept: dict[str, DataFrame] = {}
        self._bundles: list[DataFrame] = []

    def keep(self, name: str, build) -> DataFrame:
        if name not in self._kept:
            self._kept[name] = build().persist()
        return self._kept[name]

    def roles(self) -> DataFrame:
        """(doc_id, country, owner), kept, so that the texts are read for their titles once and not for every use of a role."""
        return self.keep("roles", lambda: self._narrow)

    @property
    def sides(self) -> DataFrame:
        return self.roles().select(F.col("doc_id").alias("key"), self._first.alias("own"))

    @property
    def ids(self) -> DataFrame:
        """s1 and country, without the texts."""
        return self.roles().where(self._first).select(F.col("doc_id").alias("s1"), "country")

    @property
    def truth(self) -> DataFrame:
        return self.roles().where(~self._first).select(F.col("owner").alias("s1"), F.col("doc_id").alias("other"))

    def release(self) -> None:
        for df in [*self._kept.values(), *self._bundles]:
            df.unpersist()
        self._kept.clear()
        self._bundles.clear()

    def traits(self, **columns: Column) -> DataFrame:
        """The other documents with ``columns`` of lang, title or body, which are computed before the roles are joined, so that no text is shuffled."""
        narrow = self._titled.select("doc_id", "title", *[c.alias(name) for name, c in columns.items()])
        return narrow.join(self._owners, "title").where(~self._first).select(F.col("doc_id").alias("other"), *columns)

    def nearest(self, k: int) -> DataFrame:
        """The ``k`` records most similar to each other document, above the cut-off: s1, other, sim, rank."""

        def build() -> DataFrame:
            found = similar_among(self.texts, self.sides, word_terms, k, held=self._bundles)
            if found is not None:
                return found.select("s1", F.col("query").alias("other"), "sim", "rank")
            index = self.s1.select(F.col("country").alias("block"), "s1", F.col("body").alias("text"))
            queries = self.other.select(F.col("country").alias("block"), F.col("other").alias("query"), F.col("body").alias("text"))
            return similar_top(index, queries, word_terms, k, held=self._bundles).select("s1", F.col("query").alias("other"), "sim", "rank")

        return self.keep(f"nearest-{k}", build)

    def found(self) -> DataFrame:
        """Candidates: s1, other, sim, rank."""
        return self.nearest(K)

    def scored(self) -> DataFrame:
        """Candidates with the score of a fixed logistic model: s1, other, p."""
        p = F.round(1 / (1 + F.exp(-(SLOPE * F.col("sim") - SHIFT))), 6)
        return self.found().select("s1", "other", p.alias("p"))


_TASKS: dict[tuple[str, str], DocumentTask] = {}


def task(spark: SparkSession, sf_dir: str) -> DocumentTask:
    key = (spark.sparkContext.applicationId, sf_dir)
    if key not in _TASKS:
        _TASKS[key] = DocumentTask(spark, sf_dir)
    return _TASKS[key]


def release_all() -> None:
    """Drop everything that the tasks keep, so that the next query starts cold."""
    for t in _TASKS.values():
        t.release()


#: The same tables in SQL, to be put before a query.
TASK_SQL = r"""
WITH titled AS (SELECT doc_id, lang, split_part(text, '.', 1) AS title, substr(text, length(split_part(text, '.', 1)) + 2) AS body
                FROM documents WHERE text IS NOT NULL),
     roles AS (SELECT *, min(doc_id) OVER (PARTITION BY title) AS owner FROM titled),
     s1t AS (SELECT doc_id AS s1, lang AS country, title, body FROM roles WHERE doc_id = owner),
     ot AS (SELECT doc_id AS other, lang AS country, title, body FROM roles WHERE doc_id <> owner),
     truth AS (SELECT owner AS s1, doc_id AS other FROM roles WHERE doc_id <> owner),
     t1 AS (SELECT country AS block, s1, term, count(*) AS tf FROM
              (SELECT country, s1, unnest(string_split_regex(lower(body), '[^\p{L}\p{N}#]+')) AS term FROM s1t) WHERE term <> '' GROUP BY ALL),
     nb AS (SELECT country AS block, count(*) AS n FROM s1t GROUP BY ALL),
     df AS (SELECT t1.block, term, count(*) AS df, any_value(n) AS n FROM t1 JOIN nb ON t1.block = nb.block GROUP BY t1.block, term),
     idf AS (SELECT block, term, ln((1 + n) / (1 + df)) + 1 AS idf FROM
               (SELECT *, n * 0.02 < 1 OR min(df) OVER (PARTITION BY block) > n * 0.02 AS keeps_all FROM df) WHERE keeps_all OR df <= n * 0.02),
     w1 AS (SELECT block, s1, term, w / sqrt(sum(w * w) OVER (PARTITION BY block, s1)) AS w FROM
              (SELECT t1.block, s1, t1.term, (1 + ln(tf)) * idf AS w FROM t1 JOIN idf ON t1.block = idf.block AND t1.term = idf.term)),
     tq AS (SELECT country AS block, other, term, count(*) AS tf FROM
              (SELECT country, other, unnest(string_split_regex(lower(body), '[^\p{L}\p{N}#]+')) AS term FROM ot) WHERE term <> '' GROUP BY ALL),
     wq AS (SELECT block, other, term, w / sqrt(sum(w * w) OVER (PARTITION BY block, other)) AS w FROM
              (SELECT tq.block, other, tq.term, (1 + ln(tf)) * idf AS w FROM tq JOIN idf ON tq.block = idf.block AND tq.term = idf.term)),
     sims AS (SELECT * FROM (SELECT w1.block, other, s1, round(sum(w1.w * wq.w), 6) AS sim FROM w1 JOIN wq ON w1.block = wq.block AND w1.term = wq.term
              GROUP BY ALL) WHERE sim > 0.05),
     found AS (SELECT * FROM (SELECT s1, other, sim, row_number() OVER (PARTITION BY block, other ORDER BY sim DESC, s1) AS rank FROM sims) WHERE rank <= 3),
     scored AS (SELECT s1, other, round(1 / (1 + exp(-(12.0 * sim - 4.0))), 6) AS p FROM found),
     owners AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY other ORDER BY p DESC, s1) AS r FROM scored) WHERE r = 1),
     pred AS (SELECT s1, other, p FROM owners WHERE p >= 0.5)
"""

#: Per-record outcome of ``pred``, to be put after TASK_SQL.
OUTCOME_SQL = """,
     per AS (SELECT s1t.s1, country, coalesce(n_pred, 0) AS n_pred, coalesce(tp, 0) AS tp, coalesce(n_true, 0) AS n_true FROM s1t
             LEFT JOIN (SELECT pred.s1, count(*) AS n_pred, count(truth.other) AS tp FROM pred
                        LEFT JOIN truth ON pred.s1 = truth.s1 AND pred.other = truth.other GROUP BY pred.s1) a ON s1t.s1 = a.s1
             LEFT JOIN (SELECT s1, count(*) AS n_true FROM truth GROUP BY s1) b ON s1t.s1 = b.s1),
     res AS (SELECT *, CASE WHEN n_pred = 0 AND n_true = 0 THEN 1.0 WHEN tp = 0 THEN 0.0 ELSE 1.25 * tp / (n_pred + 0.25 * n_true) END AS f05 FROM per)
"""
