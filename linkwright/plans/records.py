"""Queries over business records: normalization, states, postings of tokens, pair features."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import fixed, kernels, phonetic, text, translit
from ..operators import blocking, features
from ..sources.tables import read_table
from . import duck
from .fixtures import RECORDS, records

QUERIES, SQL = {}, {}
REC_SQL = f"WITH rec AS ({RECORDS})"


def query(sql: str | None = None):
    def add(f):
        QUERIES[f.__name__] = f
        if sql:
            SQL[f.__name__] = sql
        return f

    return add


@query(f"{REC_SQL} SELECT id, trim({duck.replaced(duck.fold('name'), fixed.NOT_ALNUM, ' ')}) AS name_lite, trim({duck.replaced(duck.fold('address'), fixed.NOT_ALNUM, ' ')}) AS addr_lite FROM rec")
def lite_text(spark, sf_dir):
    return records(spark, sf_dir).select("id", text.lite(F.col("name")).alias("name_lite"), text.lite(F.col("address")).alias("addr_lite"))


_PARTS = f"list_filter(string_split_regex({duck.fold('name')}, {duck.quoted(fixed.ALIAS)}), lambda p: trim(p) <> '')"
_FULL = duck.name_tokens(duck.fold("name"))
NAMES_SQL = f"""{REC_SQL}, parts AS (SELECT *, {_PARTS} AS parts, {_FULL} AS full_tokens FROM rec),
     names AS (SELECT *, array_to_string(full_tokens, ' ') AS name_full,
               CASE WHEN len(parts) > 1 THEN {duck.without_legal(duck.name_tokens('parts[1]'))} ELSE {duck.without_legal('full_tokens')} END AS core_tokens,
               CASE WHEN len(parts) > 1 THEN {duck.without_legal(duck.name_tokens('parts[-1]'))} ELSE [] END AS alias_tokens FROM parts)"""


def named(spark, sf_dir) -> DataFrame:
    rows = records(spark, sf_dir)
    return rows.withColumn("n", text.name_parts(text.fold_ascii(F.col("name")), F.col("country"))).select(*rows.columns, "n.*")


@query(f"{NAMES_SQL} SELECT id, name_full, array_to_string(core_tokens, ' ') AS core, array_to_string(core_tokens, '') AS compact FROM names")
def name_core_legal(spark, sf_dir):
    return named(spark, sf_dir).select("id", "name_full", "core", "compact")


@query(f"{NAMES_SQL} SELECT id, array_to_string(core_tokens, ' ') AS core, array_to_string(alias_tokens, ' ') AS alias FROM names WHERE len(alias_tokens) > 0")
def alias_split(spark, sf_dir):
    return named(spark, sf_dir).where(F.col("alias") != "").select("id", "core", "alias")


_FR = f"CASE country WHEN 'france' THEN {duck.french('t')} ELSE t END"
ADDR_SQL = f"""{REC_SQL}, folded AS (SELECT *, {duck.fold("CASE country WHEN 'france' THEN translate(address, '°º', 'oo') ELSE address END")} AS a FROM rec),
     comps AS (SELECT id, country, k, trim({duck.replaced('c', fixed.NOT_ALNUM, ' ')}) AS key FROM
               (SELECT id, country, trim(unnest(string_split(a, ','))) AS c, generate_subscripts(string_split(a, ','), 1) AS k FROM folded) WHERE NOT list_contains({duck.listed(fixed.NULLISH)}, c)),
     stated AS (SELECT c.*, states.state FROM comps c LEFT JOIN {duck.state_table()} ON c.country = states.country AND c.key = states.key),
     st AS (SELECT id, string_agg(state, '|' ORDER BY k) AS state FROM (SELECT id, state, min(k) AS k FROM stated WHERE state IS NOT NULL GROUP BY id, state) GROUP BY id),
     tk AS (SELECT id, country, {duck.words("string_agg(key, ' ' ORDER BY k)")} AS t0 FROM stated WHERE state IS NULL GROUP BY id, country),
     t1 AS (SELECT id, country, {duck.words("array_to_string(list_transform(t0, lambda t: " + duck.unglue('t') + "), ' ')")} AS t1 FROM tk),
     t2 AS (SELECT id, {duck.words("array_to_string(list_transform(t1, lambda t: " + _FR + "), ' ')")} AS t2 FROM t1),
     t3 AS (SELECT id, array_to_string(list_filter(list_transform(t2, lambda t: {duck.case_of(fixed.ADDR_CANON, 't')}), lambda u: NOT list_contains({duck.listed(fixed.ADDR_STOP)}, u) AND NOT regexp_full_match(u, '[0-9]+')), ' ') AS addr,
               list_transform(regexp_extract_all(array_to_string(t2, ' '), '[0-9]+'), lambda d: CASE WHEN regexp_full_match(d, '0+') THEN '0' ELSE ltrim(d, '0') END) AS nums FROM t2),
     addrs AS (SELECT rec.id, coalesce(addr, '') AS addr, coalesce(st.state, '') AS state,
               coalesce(array_to_string(list_filter(nums, lambda d, i: list_position(nums, d) = i), ' '), '') AS nums
               FROM rec LEFT JOIN t3 ON rec.id = t3.id LEFT JOIN st ON rec.id = st.id)"""


def addressed(spark, sf_dir) -> DataFrame:
    rows = named(spark, sf_dir)
    return rows.withColumn("a", text.address_parts(F.col("address"), F.col("country"))).select(*rows.columns, "a.*")


@query(f"{ADDR_SQL} SELECT * FROM addrs")
def number_extract(spark, sf_dir):
    """Addresses normalized: words, states, numbers."""
    return addressed(spark, sf_dir).select("id", "addr", "state", "nums")


@query(f"{ADDR_SQL} SELECT id, unnest(list_distinct(list_transform(string_split(state, '|'), lambda s: CASE s WHEN 'telangana' THEN 'andhra pradesh' ELSE s END))) AS block FROM addrs")
def block_explode(spark, sf_dir):
    return blocking.with_blocks(addressed(spark, sf_dir)).select("id", "block")


@query(f"SELECT n_name, s.key, s.state FROM nation JOIN {duck.state_table().replace(' AS states(', ' AS s(')} ON s.country = CASE n_name WHEN 'INDIA' THEN 'india' WHEN 'FRANCE' THEN 'france' WHEN 'UNITED STATES' THEN 'us' ELSE 'us' END")
def state_lookup(spark, sf_dir):
    """The state table by nation: codes, names and regions."""
    table = spark.createDataFrame(fixed.state_rows(), "country string, key string, state string")
    country = F.when(F.col("n_name") == "INDIA", "india").when(F.col("n_name") == "FRANCE", "france").otherwise("us")
    return read_table(spark, sf_dir, "nation").withColumn("country", country).join(F.broadcast(table), "country").select("n_name", "key", "state")


@query(f"SELECT p_partkey, {duck.unglue('t')} AS unglued FROM (SELECT p_partkey, 'flat' || p_partkey || CASE p_partkey % 3 WHEN 0 THEN '' WHEN 1 THEN 'plaza' ELSE 'th' END AS t FROM part)")
def unglue_tokens(spark, sf_dir):
    glued = F.expr("'flat' || p_partkey || CASE p_partkey % 3 WHEN 0 THEN '' WHEN 1 THEN 'plaza' ELSE 'th' END")
    return read_table(spark, sf_dir, "part").select("p_partkey", text.unglue(glued).alias("unglued"))


_LEETED = "translate(lower(replace(p_name, ' ', '')), 'oe', '03')"


@query(f"SELECT p_partkey, {duck.deleet('t')} AS word FROM (SELECT p_partkey, {_LEETED} AS t FROM part)")
def deleet(spark, sf_dir):
    return read_table(spark, sf_dir, "part").select("p_partkey", text.deleet(F.expr(_LEETED)).alias("word"))


@query(f"SELECT p_partkey, translate(a, '1i0', 'llo') = translate(b, '1i0', 'llo') AS same FROM (SELECT p_partkey, lower(p_name) AS a, translate(lower(p_name), 'lo', '10') AS b FROM part)")
def homoglyph_eq(spark, sf_dir):
    a, b = F.lower("p_name"), F.translate(F.lower("p_name"), "lo", "10")
    return read_table(spark, sf_dir, "part").select("p_partkey", (text.homoglyph_fold(a) == text.homoglyph_fold(b)).alias("same"))


@query(f"SELECT gram, count(*) AS n FROM (SELECT unnest({duck.char_ngrams('p_name', 3)}) AS gram FROM part) GROUP BY gram")
def char_ngrams(spark, sf_dir):
    grams = read_table(spark, sf_dir, "part").select(F.explode(text.char_ngrams(F.col("p_name"), 3)).alias("gram"))
    return grams.groupBy("gram").agg(F.count(F.lit(1)).alias("n"))


_SHARED = "len(list_intersect(ga, gb))"


@query(
    f"""WITH g AS (SELECT p_partkey, {duck.shingles('lower(p_name)')} AS ga, {duck.shingles('lower(p_type)')} AS gb FROM part)
SELECT p_partkey, round({_SHARED} / (len(ga) + len(gb) - {_SHARED}), 6) AS jaccard FROM g"""
)
def shingle_jaccard(spark, sf_dir):
    a, b = (text.padded_shingles(F.lower(c)) for c in ("p_name", "p_type"))
    return read_table(spark, sf_dir, "part").select("p_partkey", F.round(text.jaccard(a, b), 6).alias("jaccard"))


@query(
    rf"""{REC_SQL} SELECT id, CASE country WHEN 'india' THEN regexp_extract_all(address, '\b([1-9][0-9]{{5}})\b', 1)[-1]
WHEN 'us' THEN substr(regexp_extract_all(address, '\b([0-9]{{5}}(?:-[0-9]{{4}})?)\b', 1)[-1], 1, 5) END AS postal FROM rec"""
)
def postal_codes(spark, sf_dir):
    return records(spark, sf_dir).select("id", text.postal_code(F.col("address"), F.col("country")).alias("postal"))


_IDF_SQL = """ SELECT term, df, round(ln(n / df), 6) AS idf FROM (SELECT term, count(*) AS df, any_value(n) AS n FROM
  (SELECT unnest(list_distinct(core_tokens)) AS term, (SELECT count(*) FROM names) AS n FROM names
   UNION ALL SELECT unnest(list_distinct(list_filter(string_split(addr, ' '), lambda t: t <> ''))), (SELECT count(*) FROM names) FROM addrs) GROUP BY term)"""
BOTH_SQL = NAMES_SQL + "," + ADDR_SQL.removeprefix(REC_SQL + ",")


@query(BOTH_SQL + _IDF_SQL)
def idf_table(spark, sf_dir):
    """Document frequencies over the words of name and address, counted apart."""
    idf = features.idf_table(addressed(spark, sf_dir))
    return idf.select("term", "df", F.round("idf", 6).alias("idf"))


def _pairs(spark, sf_dir) -> DataFrame:
    """Record 2k with record 2k + 1, all columns of the second with the suffix 2."""
    rows = addressed(spark, sf_dir)
    left = rows.where(F.col("id") % 2 == 0).withColumn("pair", F.col("id"))
    right = rows.where(F.col("id") % 2 == 1).select(F.col("id").alias("pair_1"), *[F.col(c).alias(f"{c}2") for c in rows.columns])
    return left.join(right, F.col("pair") + 1 == F.col("pair_1"))


_PAIR_SQL = (
    BOTH_SQL
    + """,
     full_ AS (SELECT n.id, n.country, core_tokens, alias_tokens, addr, state, nums FROM names n JOIN addrs a ON n.id = a.id),
     pairs AS (SELECT a.id AS pair, a.core_tokens AS t1, b.core_tokens AS t2, a.nums AS n1, b.nums AS n2, a.state AS s1, b.state AS s2 FROM full_ a JOIN full_ b ON a.id % 2 = 0 AND b.id = a.id + 1)"""
)


@query(
    _PAIR_SQL
    + f""", idf AS ({_IDF_SQL}),
     u AS (SELECT pair, term, bool_or(one) AS one, bool_or(two) AS two FROM (SELECT pair, unnest(list_distinct(t1)) AS term, true AS one, false AS two FROM pairs
           UNION ALL SELECT pair, unnest(list_distinct(t2)), false, true FROM pairs) GROUP BY pair, term)
SELECT pair, round(sum(CASE WHEN one AND two THEN idf ELSE 0 END) / sum(idf), 4) AS idf_jaccard,
       round(sum(CASE WHEN one AND two THEN idf ELSE 0 END) / sum(CASE WHEN one THEN idf END), 4) AS cover1 FROM u JOIN idf USING (term) GROUP BY pair"""
)
def idf_jaccard(spark, sf_dir):
    rows = addressed(spark, sf_dir)
    out = features.idf_overlap(_pairs(spark, sf_dir).select("pair", "core", "core2"), features.idf_table(rows), "core", "core2")
    return out.select("pair", F.round("idf_jaccard", 4).alias("idf_jaccard"), F.round("cover1", 4).alias("cover1"))


@query(
    _PAIR_SQL
    + """, l AS (SELECT *, list_filter(string_split(n1, ' '), lambda t: t <> '') AS a, list_filter(string_split(n2, ' '), lambda t: t <> '') AS b FROM pairs)
SELECT pair, CASE WHEN len(a) = 0 OR len(b) = 0 THEN -1.0 WHEN a[1] = b[1] THEN 1.0 ELSE 0.0 END AS num_first_eq,
       CASE WHEN len(a) = 0 OR len(b) = 0 THEN -1.0 ELSE round(ln(1 + abs(CAST(substr(a[1], 1, 9) AS BIGINT) - CAST(substr(b[1], 1, 9) AS BIGINT))), 6) END AS num_first_absdiff,
       CAST(len(list_intersect(a, b)) AS DOUBLE) AS num_overlap, CAST(len(a) > 0 AND len(b) > 0 AS DOUBLE) AS nums_both FROM l"""
)
def number_feats(spark, sf_dir):
    out = features.number_features(_pairs(spark, sf_dir))
    return out.select("pair", "num_first_eq", F.round("num_first_absdiff", 6).alias("num_first_absdiff"), "num_overlap", "nums_both")


@query("SELECT a.n_nationkey AS a, b.n_nationkey AS b, round(jaro_winkler_similarity(lower(a.n_name), lower(b.n_name)), 6) AS jw FROM nation a JOIN nation b ON a.n_regionkey = b.n_regionkey")
def jaro_winkler_pairs(spark, sf_dir):
    n = read_table(spark, sf_dir, "nation")
    m = n.select(F.col("n_nationkey").alias("b"), F.col("n_name").alias("other"), "n_regionkey")
    pairs = n.select(F.col("n_nationkey").alias("a"), "n_name", "n_regionkey").join(m, "n_regionkey")
    return pairs.select("a", "b", F.round(kernels.pair_kernel(kernels.jaro_winkler)(F.lower("n_name"), F.lower("other")), 6).alias("jw"))


_ME = """WITH t AS (SELECT DISTINCT p_name, p_type FROM part),
     a AS (SELECT *, unnest(string_split(lower(p_name), ' ')) AS x, generate_subscripts(string_split(p_name, ' '), 1) AS i FROM t),
     best AS (SELECT p_name, p_type, i, max(jaro_winkler_similarity(x, y)) AS m FROM (SELECT *, unnest(string_split(lower(p_type), ' ')) AS y FROM a) GROUP BY ALL)
SELECT p_name, p_type, round(avg(m), 6) AS monge_elkan FROM best GROUP BY p_name, p_type"""


@query(_ME)
def monge_elkan(spark, sf_dir):
    run = kernels.pair_kernel(lambda x, y: kernels.monge_elkan(x.split(), y.split()))
    rows = read_table(spark, sf_dir, "part", ["p_name", "p_type"]).distinct()
    return rows.select("p_name", "p_type", F.round(run(F.lower("p_name"), F.lower("p_type")), 6).alias("monge_elkan"))


def _kernel_columns(a: Column, b: Column) -> list[Column]:
    names = {"ratio": kernels.ratio, "token_sort": kernels.token_sort_ratio, "token_set": kernels.token_set_ratio, "partial": kernels.partial_ratio}
    return [F.round(kernels.pair_kernel(k)(a, b), 6).alias(n) for n, k in names.items()]


@query()
def token_ratio_kernels(spark, sf_dir):
    return _pairs(spark, sf_dir).select("pair", *_kernel_columns(F.col("core"), F.col("core2")))


@query()
def metaphone_feats(spark, sf_dir):
    key = kernels.pair_kernel(lambda x, y: float([phonetic.metaphone(t) for t in x.split() if t.isalpha()] == [phonetic.metaphone(t) for t in y.split() if t.isalpha()]))
    return _pairs(spark, sf_dir).select("pair", key(F.col("core"), F.col("core2")).alias("n2_phon_eq"))


@query()
def pair_features(spark, sf_dir):
    """All string features of a pair: the base group, the extended group and the second extension."""
    rows = addressed(spark, sf_dir)
    ready = _pairs(spark, sf_dir)
    for side in ("", "2"):
        ready = ready.withColumn(f"name_lite{side}", text.lite(F.col(f"name{side}"))).withColumn(f"addr_lite{side}", text.lite(F.col(f"address{side}")))
        ready = ready.withColumn(f"script{side}", text.script_of(F.col(f"name{side}")))
    return features.string_features(features.with_weights(ready, features.idf_table(rows)), ["pair"])


@query()
def soft_tfidf(spark, sf_dir):
    rows = addressed(spark, sf_dir)
    blank = {f"{c}{s}": F.lit("") for c in ("name_lite", "addr_lite", "script") for s in ("", "2")}
    ready = features.with_weights(_pairs(spark, sf_dir).withColumns(blank), features.idf_table(rows))
    out = features.string_features(ready, ["pair"], ("x2",))
    return out.select("pair", F.round("n2_soft", 6).alias("n2_soft"), F.round("a2_soft", 6).alias("a2_soft"))


@query()
def transliterated_names(spark, sf_dir):
    """Names with a Devanagari word, folded to ASCII by dictionary and rules."""
    rows = records(spark, sf_dir)
    native = F.concat(F.lit("भारत गारमेंट्स "), "name")
    return rows.select("id", translit.ascii_column(native, {"भारत": "bharat"}).alias("ascii"), text.script_of(native).alias("script"))


@query(
    f"""{REC_SQL}, comp AS (SELECT id, country, nationkey, unnest(list_transform(string_split(lower(address), ','), lambda x: trim(regexp_replace(x, '[^\\p{{L}}0-9]+', ' ', 'g')))) AS comp FROM rec),
     cnt AS (SELECT country, comp, CAST(nationkey AS VARCHAR) AS state, count(*) AS n FROM comp WHERE comp <> '' GROUP BY ALL)
SELECT country, comp, state AS inferred FROM (SELECT *, sum(n) OVER (PARTITION BY country, comp) AS total FROM cnt) WHERE n / total >= 0.3 AND total >= 5"""
)
def infer_state(spark, sf_dir):
    """Address components that mostly stand with one nation (a looser share than production's 0.95)."""
    rows = records(spark, sf_dir).select("country", F.col("nationkey").cast("string").alias("state"), text.address_components(F.col("address")).alias("comps"))
    return blocking.learned_states(rows, share=0.3)


@query(
    f"""{REC_SQL}, comp AS (SELECT DISTINCT id, country, unnest(list_transform(string_split(lower(address), ','), lambda x: trim(regexp_replace(x, '[^\\p{{L}}0-9]+', ' ', 'g')))) AS comp FROM rec),
     pair AS (SELECT a.country, a.comp AS source, b.comp AS target, count(*) AS n FROM comp a JOIN comp b ON a.id = b.id AND a.comp <> b.comp AND a.comp <> '' AND b.comp <> '' GROUP BY ALL),
     tot AS (SELECT country, comp, count(*) AS seen FROM comp GROUP BY ALL)
SELECT country, source, target, n FROM (SELECT p.*, seen, row_number() OVER (PARTITION BY p.country, source ORDER BY n DESC, target) AS r FROM pair p JOIN tot t ON p.country = t.country AND p.source = t.comp)
WHERE r = 1 AND n >= 5 AND n / seen >= 0.6"""
)
def dict_cooccurrence(spark, sf_dir):
    """Learned dictionary: for each component the one it most often stands with, if often enough."""
    rows = records(spark, sf_dir).select("id", "country", F.array_distinct(text.address_components(F.col("address"))).alias("comps"))
    return features.cooccurring(rows, "comps", least=5, share=0.6)


@query("SELECT CAST(c_custkey AS BIGINT) AS id, CAST((c_custkey * 2654435761) % 1000 % 10 AS BIGINT) AS bucket, CASE WHEN (c_custkey * 2654435761) % 1000 % 10 <= 2 THEN 'train' WHEN (c_custkey * 2654435761) % 1000 % 10 = 9 THEN 'validation' ELSE 'rest' END AS part FROM customer")
def hash_split(spark, sf_dir):
    """Train, validation and rest by a salted integer hash of the id."""
    rows = read_table(spark, sf_dir, "customer").withColumn("bucket", (F.col("c_custkey") * 2654435761) % 1000 % 10)
    part = F.when(F.col("bucket") <= 2, "train").when(F.col("bucket") == 9, "validation").otherwise("rest")
    return rows.select(F.col("c_custkey").alias("id"), "bucket", part.alias("part"))
