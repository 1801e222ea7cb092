"""The engine's operators as queries over the synthetic tables, each with its SQL."""

from __future__ import annotations

import atexit
import shutil
import tempfile
import uuid

from pyspark.sql import Column, DataFrame, Observation, SparkSession, Window
from pyspark.sql import functions as F

from clauseworks.functions import refs as R
from clauseworks.functions import text as X
from clauseworks.operators import dense, embedding, fusion, ivf, lexical, lookup, postings
from clauseworks.plans import index, render
from clauseworks.plans.engine import Engine
from clauseworks.sources import corpus, markup

QUERIES: dict = {}
ORACLES: dict[str, str] = {}

TERMS = ("and", "of", "thing")
LIMIT = 10


def query(sql: str | None):
    def add(f):
        QUERIES[f.__name__] = f
        if sql is not None:
            ORACLES[f.__name__] = sql
        return f

    return add


def _t(spark: SparkSession, d: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{d}/{name}.parquet")


def _str(c: str) -> Column:
    return F.col(c).cast("string")


# lexical search

_TOKENS = r"list_filter(regexp_split_to_array(lower(text), '[^\p{L}\p{N}]+'), lambda x: x <> '')"
_BM25 = f"""
t AS (SELECT doc_id, lang, {_TOKENS} AS ts FROM documents),
s AS (SELECT count(*) AS n, avg(len(ts)) AS avgdl FROM t),
q(term) AS (VALUES {", ".join(f"('{x}')" for x in TERMS)}),
tf AS (SELECT doc_id, lang, len(ts) AS dl, term, len(list_filter(ts, lambda x: x = term)) AS tf FROM t, q),
df AS (SELECT term, count(*) AS df FROM tf WHERE tf > 0 GROUP BY term),
sc AS (SELECT doc_id, any_value(lang) AS lang, round(sum(ln(1.0 + (n - df + 0.5) / (df + 0.5)) * tf * 2.2 / (tf + 1.2 * (1 - 0.75 + 0.75 * dl / avgdl))), 6) AS score
       FROM tf JOIN df USING (term), s WHERE tf > 0 GROUP BY doc_id)"""


@query(f"WITH {_BM25} SELECT doc_id, score FROM sc ORDER BY score DESC, doc_id LIMIT 10")
def bm25_topk(spark, d):
    scored = lexical.search_texts(_t(spark, d, "documents"), list(TERMS), id_col="doc_id")
    return lexical.top(scored, LIMIT).withColumnRenamed("id", "doc_id")


@query(f"WITH {_BM25} SELECT doc_id, score FROM sc WHERE lang = 'en' ORDER BY score DESC, doc_id LIMIT 10")
def bm25_topk_filtered(spark, d):
    """Filtered before the cut; the statistics stay those of all."""
    scored = lexical.search_texts(_t(spark, d, "documents"), list(TERMS), F.col("lang") == "en", id_col="doc_id")
    return lexical.top(scored, LIMIT).withColumnRenamed("id", "doc_id")


@query(f"WITH {_BM25} SELECT doc_id, score FROM sc ORDER BY score DESC, doc_id LIMIT 10")
def bm25_index_topk(spark, d):
    made = lexical.build_for(_t(spark, d, "documents"), list(TERMS), _scratch(spark), "doc_id")
    return lexical.top(lexical.search_index(made, list(TERMS)), LIMIT).withColumnRenamed("id", "doc_id")


@query(f"""WITH t AS (SELECT doc_id, {_TOKENS} AS ts FROM documents), u AS (SELECT DISTINCT doc_id, unnest(ts) AS term FROM t)
SELECT term, count(*) AS df, (SELECT count(*) FROM t) AS n, (SELECT round(avg(len(ts)), 6) FROM t) AS avgdl FROM u GROUP BY term""")
def bm25_index_stats(spark, d):
    made = lexical.build(_t(spark, d, "documents"), "doc_id")
    # one row is joined to all
    return made.term_stats.join(F.broadcast(made.coll_stats)).select("term", "df", "n", F.round("avgdl", 6).alias("avgdl"))


# dense search and fusion: the query vector is that of the row with the least id


def _vectors(spark, d) -> DataFrame:
    return _t(spark, d, "embeddings").select(F.col("vec_id").alias("id"), F.col("embedding").alias("vector"), "label")


def _query_vector(vectors: DataFrame) -> list[float]:
    return list(vectors.orderBy("id").select("vector").first()["vector"])


_COS = """
e AS (SELECT vec_id, label, CAST(embedding AS DOUBLE[]) AS v FROM embeddings), qv AS (SELECT v AS q FROM e ORDER BY vec_id LIMIT 1),
dn AS (SELECT vec_id, label, round(list_cosine_similarity(v, q), 6) AS score FROM e, qv)"""


@query(f"WITH {_COS} SELECT vec_id, score FROM dn ORDER BY score DESC, vec_id LIMIT 10")
def dense_topk(spark, d):
    v = _vectors(spark, d)
    return lexical.top(dense.cosine_scores(v, _query_vector(v)), LIMIT).withColumnRenamed("id", "vec_id")


@query(f"WITH {_COS} SELECT vec_id, score FROM dn WHERE label = 3 ORDER BY score DESC, vec_id LIMIT 10")
def dense_topk_filtered(spark, d):
    v = _vectors(spark, d)
    return lexical.top(dense.cosine_scores(v.where("label = 3"), _query_vector(v)), LIMIT).withColumnRenamed("id", "vec_id")


def _hybrid_sql(lex: str, den: str) -> str:
    return f"""WITH {_BM25}, {_COS},
a AS (SELECT doc_id AS id, row_number() OVER (ORDER BY score DESC, doc_id) AS r FROM sc {lex} ORDER BY score DESC, doc_id LIMIT 20),
b AS (SELECT vec_id AS id, row_number() OVER (ORDER BY score DESC, vec_id) AS r FROM dn {den} ORDER BY score DESC, vec_id LIMIT 20),
f AS (SELECT id, round(sum(1.0 / (60.0 + r)), 6) AS score FROM (SELECT * FROM a UNION ALL SELECT * FROM b) GROUP BY id)
SELECT id, score FROM f ORDER BY score DESC, id LIMIT 10"""


def _hybrid(spark, d, keep_lexical, keep_dense) -> DataFrame:
    v = _vectors(spark, d)
    q = _query_vector(v)
    lex = lexical.top(lexical.search_texts(_t(spark, d, "documents"), list(TERMS), keep_lexical, id_col="doc_id"), 2 * LIMIT)
    den = lexical.top(dense.cosine_scores(v if keep_dense is None else v.where(keep_dense), q), 2 * LIMIT)
    return fusion.fuse([den, lex], LIMIT)


@query(_hybrid_sql("", ""))
def hybrid_rrf(spark, d):
    return _hybrid(spark, d, None, None)


@query(_hybrid_sql("WHERE lang = 'en'", "WHERE label < 5"))
def hybrid_rrf_filtered(spark, d):
    return _hybrid(spark, d, F.col("lang") == "en", F.col("label") < 5)


def _codes_sql(scale: str) -> str:
    return f"""x AS (SELECT vec_id, unnest(CAST(embedding AS DOUBLE[])) AS x, generate_subscripts(embedding, 1) AS i FROM embeddings),
s AS (SELECT {scale} AS m FROM x),
c AS (SELECT vec_id, list(least(greatest(CASE WHEN x >= 0 THEN floor(x * (127.0 / m) + 0.5) ELSE -floor(-x * (127.0 / m) + 0.5) END, -127), 127) ORDER BY i) AS code FROM x, s GROUP BY vec_id)"""


def _int8_sql(scale: str) -> str:
    return f"WITH {_codes_sql(scale)} SELECT vec_id, CAST(list_sum(code) AS BIGINT) AS code_sum, CAST(code[1] AS INT) AS first_code FROM c"


def _int8(spark, d, quantile: float) -> DataFrame:
    v = _vectors(spark, d).withColumn("vector", F.transform("vector", lambda x: x.cast("double")))
    coded = dense.quantise(v, quantile=quantile)
    total = F.aggregate("code", F.lit(0).cast("long"), lambda a, x: a + x)
    return coded.select(F.col("id").alias("vec_id"), total.alias("code_sum"), F.get("code", F.lit(0)).cast("int").alias("first_code"))


@query(_int8_sql("max(abs(x))"))
def int8_quantise(spark, d):
    return _int8(spark, d, 1.0)


@query(_int8_sql("quantile_disc(abs(x), 0.99)"))
def int8_quantise_clipped(spark, d):
    return _int8(spark, d, 0.99)


@query(
    f"""WITH {_COS}, {_codes_sql("quantile_disc(abs(x), 0.99)")},
n AS (SELECT vec_id FROM c, qv ORDER BY list_dot_product(code, q) / greatest(sqrt(list_dot_product(code, code)), 1) DESC, vec_id LIMIT 40)
SELECT vec_id, score FROM dn JOIN n USING (vec_id) ORDER BY score DESC, vec_id LIMIT 10"""
)
def dense_coded_topk(spark, d):
    """Chosen by eight-bit codes, scored by the vectors."""
    v = _vectors(spark, d).withColumn("vector", F.transform("vector", lambda x: x.cast("double")))
    codes = dense.quantise(v, quantile=0.99).select("id", "code")
    return lexical.top(dense.rescored(v, codes, _query_vector(v), LIMIT), LIMIT).withColumnRenamed("id", "vec_id")


# documents of record: search by name and year

_GROUPS = "g AS (SELECT DISTINCT n_name || ' — ' || year(o_orderdate) AS name FROM orders JOIN customer ON o_custkey = c_custkey JOIN nation ON c_nationkey = n_nationkey)"


def _groups(spark, d) -> DataFrame:
    o, c, n = (_t(spark, d, x) for x in ("orders", "customer", "nation"))
    j = o.join(c, o.o_custkey == c.c_custkey).join(n, c.c_nationkey == n.n_nationkey)
    return j.select(F.concat_ws(" — ", "n_name", F.year("o_orderdate").cast("string")).alias("name")).distinct()


@query(rf"""WITH {_GROUPS}, t AS (SELECT name, list_filter(regexp_split_to_array(lower(name), '[^\p{{L}}\p{{N}}]+'), lambda x: x <> '') AS ts FROM g),
s AS (SELECT count(*) AS n, avg(len(ts)) AS avgdl FROM t), q(term) AS (VALUES ('nation'), ('7'), ('1995')),
tf AS (SELECT name, len(ts) AS dl, term, len(list_filter(ts, lambda x: x = term)) AS tf FROM t, q), df AS (SELECT term, count(*) AS df FROM tf WHERE tf > 0 GROUP BY term)
SELECT name, round(sum(ln(1.0 + (n - df + 0.5) / (df + 0.5)) * tf * 2.2 / (tf + 1.2 * (1 - 0.75 + 0.75 * dl / avgdl))), 6) AS score
FROM tf JOIN df USING (term), s WHERE tf > 0 GROUP BY name ORDER BY score DESC, name LIMIT 5""")
def group_search(spark, d):
    scored = lexical.search_texts(_groups(spark, d), ["nation", "7", "1995"], id_col="name", text="name")
    return lexical.top(scored, 5).withColumnRenamed("id", "name")


# chunks, roll-ups, counts

_LINES = r"""l AS (SELECT doc_id, unnest(range(len(string_split(text, chr(10))))) AS pos, unnest(string_split(text, chr(10))) AS line FROM documents),
m AS (SELECT doc_id, pos, trim(regexp_replace(line, '[\s\x1c-\x1f\x0b\x85\x{00a0}\x{1680}\x{2000}-\x{200a}\x{2028}\x{2029}\x{202f}\x{205f}\x{3000}]+', ' ', 'g')) AS text FROM l)"""


@query(f"""WITH {_LINES} SELECT doc_id, CAST(row_number() OVER (PARTITION BY doc_id ORDER BY pos) AS BIGINT) AS ord, text FROM m WHERE length(text) >= 20""")
def line_chunks(spark, d):
    """Lines of a document as its provisions: white space squeezed, the short ones dropped, numbered in order."""
    lines = F.filter(F.transform(F.split("text", "\n"), X.squeeze), lambda t: F.char_length(t) >= markup.SHORTEST_SUBSECTION)
    return _t(spark, d, "documents").select("doc_id", F.posexplode(lines).alias("p", "text")).select("doc_id", (F.col("p") + 1).cast("long").alias("ord"), "text")


_URI = "'/akn/au/act/' || year(o_orderdate) || '/' || o_orderkey || '/eng@' || strftime(o_orderdate, '%Y-%m-%d')"


def _uri() -> Column:
    return F.concat(F.lit("/akn/au/act/"), F.year("o_orderdate").cast("string"), F.lit("/"), _str("o_orderkey"), F.lit("/eng@"), F.date_format("o_orderdate", "yyyy-MM-dd"))


@query(f"""WITH p AS (SELECT 'Act ' || o_custkey AS act_name, o_orderkey AS k, {_URI} AS uri, CASE o_orderstatus WHEN 'O' THEN 'section' WHEN 'F' THEN 'schedule_clause' ELSE 'subsection' END AS kind FROM orders),
g AS (SELECT act_name, arg_min(uri, k) AS frbr_uri, count(*) FILTER (kind = 'section') AS section_count, count(*) FILTER (kind = 'schedule_clause') AS schedule_clause_count FROM p GROUP BY act_name)
SELECT act_name, frbr_uri, CAST(string_split(frbr_uri, '/')[5] AS INT) AS year, string_split(frbr_uri, '@')[2] AS as_at_date, section_count, schedule_clause_count FROM g""")
def group_rollup(spark, d):
    kind = F.when(F.col("o_orderstatus") == "O", "section").when(F.col("o_orderstatus") == "F", "schedule_clause").otherwise("subsection")
    p = _t(spark, d, "orders").select(
        F.concat(F.lit("Act "), _str("o_custkey")).alias("act_name"), _uri().alias("frbr_uri"), kind.alias("provision_type"),
        F.col("o_orderkey").alias("act_ord"), F.lit(0).alias("kind_ord"), F.lit(0).alias("prov_ord"),
    )
    return corpus.roll_up(p).drop("act_ord")


@query("SELECT lang AS act_name, source AS provision_type, count(*) AS n FROM documents GROUP BY ALL")
def kind_counts(spark, d):
    p = _t(spark, d, "documents").select(F.col("lang").alias("act_name"), F.col("source").alias("provision_type"))
    return corpus.kind_counts(p, "act_name")


# citations: the texts are made up from the tables

_SECTIONS = "'Under s ' || l_linenumber || '(' || (l_partkey % 9) || ')(' || chr(97 + CAST(l_suppkey % 26 AS INT)) || ') and section ' || l_orderkey || 'A see Schedule ' || (l_suppkey % 7) || ', clause ' || l_linenumber || ' or para (' || chr(97 + CAST(l_partkey % 26 AS INT)) || ').'"


def _letter(c: str) -> Column:
    return F.char(97 + F.col(c) % 26)


def _section_text() -> Column:
    s = F.lit
    return F.concat(
        s("Under s "), _str("l_linenumber"), s("("), (F.col("l_partkey") % 9).cast("string"), s(")("), _letter("l_suppkey"), s(") and section "), _str("l_orderkey"),
        s("A see Schedule "), (F.col("l_suppkey") % 7).cast("string"), s(", clause "), _str("l_linenumber"), s(" or para ("), _letter("l_partkey"), s(")."),
    )


_INTERNAL_SQL = f"""WITH x AS (SELECT DISTINCT l_orderkey, l_linenumber, l_partkey, l_suppkey, {_SECTIONS} AS t FROM lineitem),
r AS (SELECT DISTINCT l_orderkey, l_linenumber, l_partkey, l_suppkey, unnest(list_concat(
 list_transform(regexp_extract_all(t, '\\bs\\s*(\\d+[A-Z]*)\\((\\d+[A-Z]*)\\)\\(([a-z]+)\\)'), lambda m: regexp_replace(m, '\\bs\\s*(\\d+[A-Z]*)\\((\\d+[A-Z]*)\\)\\(([a-z]+)\\)', '#sec-\\1__subsec-\\2__para-\\3')),
 list_transform(regexp_extract_all(t, '\\bs\\s*(\\d+[A-Z]*)\\((\\d+[A-Z]*)\\)'), lambda m: regexp_replace(m, '\\bs\\s*(\\d+[A-Z]*)\\((\\d+[A-Z]*)\\)', '#sec-\\1__subsec-\\2')),
 list_transform(regexp_extract_all(t, '\\b(?:section|s)\\s+(\\d+[A-Z]*)', 1), lambda m: '#sec-' || m),
 list_transform(regexp_extract_all(t, '(?i)\\bSchedule\\s+(\\d+)[,\\s]+(?:clause|item|Part)\\s+(\\d+[A-Z]?)'), lambda m: regexp_replace(m, '(?i)\\bSchedule\\s+(\\d+)[,\\s]+(?:clause|item|Part)\\s+(\\d+[A-Z]?)', '#schedule-\\1__clause-\\2')),
 list_transform(regexp_extract_all(t, '\\b(?:paragraph|para)\\s+\\(([a-z])\\)', 1), lambda m: '#para-' || m))) AS ref FROM x)
SELECT * FROM r WHERE ref """


def _internal(spark, d) -> DataFrame:
    keys = ["l_orderkey", "l_linenumber", "l_partkey", "l_suppkey"]
    x = _t(spark, d, "lineitem").select(*keys).distinct()
    return x.select(*keys, F.explode(F.array_distinct(R.internal_refs(_section_text()))).alias("ref"))


@query(_INTERNAL_SQL + "LIKE '#sec-%'")
def refs_sections(spark, d):
    return _internal(spark, d).where(F.col("ref").like("#sec-%"))


@query(_INTERNAL_SQL + "NOT LIKE '#sec-%'")
def refs_schedule_para(spark, d):
    return _internal(spark, d).where(~F.col("ref").like("#sec-%"))


@query("""SELECT p_partkey, CASE p_size % 3 WHEN 0 THEN '#part-' || p_size WHEN 1 THEN '#dvs-' || p_size || 'B'
 ELSE '#part-' || CASE WHEN p_size < 10 THEN NULL ELSE CAST(p_size // 10 AS VARCHAR) END END AS ref FROM part WHERE p_size % 3 < 2 OR p_size >= 10""")
def refs_part_division(spark, d):
    """Of ``Part 12 of the`` the pattern gives back digits until it no longer stands before ``of the``."""
    n = _str("p_size")
    text = F.when(F.col("p_size") % 3 == 0, F.concat(F.lit("see Part "), n, F.lit(" here"))).when(
        F.col("p_size") % 3 == 1, F.concat(F.lit("see Division "), n, F.lit("B here"))
    ).otherwise(F.concat(F.lit("see Part "), n, F.lit(" of the Code")))
    return _t(spark, d, "part").select("p_partkey", F.explode(R.internal_refs(text)).alias("ref"))


_CITED = """x AS (SELECT n_nationkey AS k, 'Read the ' || upper(r_name[1]) || lower(r_name[2:]) || ' Trade Act 19' || (70 + r_regionkey) || ' with the Export Order 20' || (10 + n_nationkey % 10) || '.' AS t, upper(r_name[1]) || lower(r_name[2:]) || ' Trade Act 19' || (70 + r_regionkey) AS act, n_nationkey FROM nation JOIN region ON n_regionkey = r_regionkey)"""


def _cited(spark, d) -> tuple[DataFrame, DataFrame]:
    n, r = _t(spark, d, "nation"), _t(spark, d, "region")
    title = F.concat(F.upper(F.substring("r_name", 1, 1)), F.lower(F.substring("r_name", 2, 100)), F.lit(" Trade Act 19"), (70 + F.col("r_regionkey")).cast("string"))
    rows = n.join(r, n.n_regionkey == r.r_regionkey).select(
        F.col("n_nationkey").alias("k"), F.concat(F.lit("Read the "), title, F.lit(" with the Export Order 20"), (10 + F.col("n_nationkey") % 10).cast("string"), F.lit(".")).alias("text")
    )
    index = r.where("r_regionkey < 3").select(title.alias("name"), F.concat(F.lit("/akn/act/"), _str("r_regionkey")).alias("uri"))
    return rows, index


_CROSS = f"""WITH {_CITED}, i AS (SELECT upper(r_name[1]) || lower(r_name[2:]) || ' Trade Act 19' || (70 + r_regionkey) AS name, '/akn/act/' || r_regionkey AS uri FROM region WHERE r_regionkey < 3),
c AS (SELECT k, 1 AS o, unnest(regexp_extract_all(t, '\\bthe\\s+([A-Z][A-Za-z ]+?Act\\s+\\d{{4}})', 1)) AS name FROM x),
j AS (SELECT k, o, coalesce(uri, 'unresolved:' || c.name) AS ref FROM c LEFT JOIN i ON c.name = i.name
      UNION ALL SELECT k, 2, 'unresolved:' || unnest(regexp_extract_all(t, '\\bthe\\s+([A-Z][A-Za-z ]+?(?:Regulation|Instrument|Order|Rules?)\\s+\\d{{4}})', 1)) FROM x)"""


@query(_CROSS + " SELECT k, string_agg(ref, '|' ORDER BY o) AS refs FROM j GROUP BY k")
def refs_cross_act(spark, d):
    rows, index = _cited(spark, d)
    return R.with_refs(rows, index, ["k"]).select("k", F.array_join("refs", "|").alias("refs"))


@query(_CROSS + " SELECT x.k, coalesce((SELECT string_agg(ref, ', ' ORDER BY o) FROM j WHERE j.k = x.k AND NOT starts_with(ref, 'unresolved:')), '') AS shown FROM x")
def visible_refs(spark, d):
    rows, index = _cited(spark, d)
    return R.with_refs(rows, index, ["k"]).select("k", F.array_join(X.visible_refs(F.col("refs")), ", ").alias("shown"))


# identifiers

@query(f"""WITH u AS (SELECT o_orderkey, CASE WHEN o_orderkey % 5 = 0 THEN 'bad/' || o_orderkey ELSE {_URI} END AS uri, 'schedule-' || (o_custkey % 9) || '__clause-' || o_orderkey AS eid FROM orders)
SELECT o_orderkey, coalesce(string_split(uri, '/')[5], '') AS year_text, coalesce(TRY_CAST(coalesce(string_split(uri, '/')[5], '') AS INT), 0) AS year_int,
 CASE WHEN contains(uri, '@') THEN string_split(string_split(uri, '@')[-1], '/')[1] ELSE '' END AS as_at, substr(string_split(eid, '__')[1], 10) AS schedule FROM u""")
def uri_parts(spark, d):
    uri = F.when(F.col("o_orderkey") % 5 == 0, F.concat(F.lit("bad/"), _str("o_orderkey"))).otherwise(_uri())
    eid = F.concat(F.lit("schedule-"), (F.col("o_custkey") % 9).cast("string"), F.lit("__clause-"), _str("o_orderkey"))
    return _t(spark, d, "orders").select("o_orderkey", X.year_text(uri).alias("year_text"), X.year_int(uri).alias("year_int"), X.as_at(uri).alias("as_at"), X.schedule_number(eid).alias("schedule"))


@query("""WITH x AS (SELECT DISTINCT l_orderkey, l_linenumber FROM lineitem),
e AS (SELECT CASE WHEN l_linenumber % 2 = 0 THEN 'section' ELSE 'subsection' END AS kind, 'sec-' || l_linenumber || CASE WHEN l_orderkey % 3 = 0 THEN '' ELSE 'A__subsec-' || l_orderkey END AS eid, l_orderkey, l_linenumber FROM x)
SELECT l_orderkey, l_linenumber, eid, CAST(row_number() OVER (PARTITION BY l_orderkey ORDER BY CASE kind WHEN 'section' THEN 0 ELSE 1 END,
 list_transform(regexp_extract_all(eid, '\\d+'), lambda n: CAST(n AS HUGEINT)), l_orderkey, l_linenumber) AS INT) AS place FROM e""")
def eid_natural_order(spark, d):
    x = _t(spark, d, "lineitem").select("l_orderkey", "l_linenumber").distinct()
    tail = F.when(F.col("l_orderkey") % 3 == 0, "").otherwise(F.concat(F.lit("A__subsec-"), _str("l_orderkey")))
    x = x.withColumn("eid", F.concat(F.lit("sec-"), _str("l_linenumber"), tail)).withColumn("kind", F.when(F.col("l_linenumber") % 2 == 0, "section").otherwise("subsection"))
    order = lookup.reading_order(F.col("kind"), F.col("eid"), "l_orderkey", "l_linenumber")
    return x.select("l_orderkey", "l_linenumber", "eid", F.row_number().over(Window.partitionBy("l_orderkey").orderBy(*order)).alias("place"))


_KEY = "WITH k AS (SELECT doc_id, sha1(unhex('6ba7b8109dad11d180b400c04fd430c8') || encode(text)) AS h FROM documents)"
_KEY_TEXT = "h[1:8] || '-' || h[9:12] || '-5' || h[14:16] || '-' || ('89ab')[CAST(('0x' || h[17:17]) AS INT) % 4 + 1] || h[18:20] || '-' || h[21:32]"


@query(f"{_KEY} SELECT doc_id, {_KEY_TEXT} AS key FROM k")
def content_keys(spark, d):
    return _t(spark, d, "documents").select("doc_id", X.content_key(F.col("text")).alias("key"))


# look-ups

@query("SELECT conv_id, string_agg(text, chr(10) || chr(10) ORDER BY turn) AS text FROM conversations GROUP BY conv_id")
def group_text_concat(spark, d):
    return lookup.joined_text(_t(spark, d, "conversations"), ["conv_id"], ["turn"])


@query("SELECT c_custkey, c_name, c_acctbal FROM customer WHERE c_name = (SELECT max(c_name) FROM customer) LIMIT 1")
def lookup_one(spark, d):
    c = _t(spark, d, "customer")
    name = c.agg(F.max("c_name")).first()[0]
    return c.where(lookup.equals("c_name", name)).select("c_custkey", "c_name", "c_acctbal").limit(1)


@query("""SELECT o_orderkey, o_orderpriority FROM (SELECT * FROM orders WHERE o_orderstatus = 'O' ORDER BY o_orderkey LIMIT 100) ORDER BY o_orderpriority, o_orderkey""")
def lookup_capped(spark, d):
    """The cap comes before the sort."""
    rows = lookup.capped(_t(spark, d, "orders").where(lookup.equals("o_orderstatus", "O")), 100, "o_orderkey")
    return rows.select("o_orderkey", "o_orderpriority").orderBy("o_orderpriority", "o_orderkey")


@query("SELECT DISTINCT CAST(doc_id AS VARCHAR) AS name FROM documents WHERE doc_id NOT IN (SELECT doc_id FROM labels WHERE doc_id IS NOT NULL)")
def missing_names(spark, d):
    names = [_t(spark, d, t).select(_str("doc_id").alias("name")) for t in ("documents", "labels")]
    return corpus.missing(*names)


@query("SELECT s_suppkey, s_name FROM (SELECT *, row_number() OVER (ORDER BY s_suppkey) - 1 AS act_ord FROM supplier) WHERE act_ord >= 3 AND act_ord < 6")
def shard_slice(spark, d):
    s = _t(spark, d, "supplier").withColumn("act_ord", F.row_number().over(Window.orderBy("s_suppkey")) - 1)
    return corpus.shard(s, 1, 3).select("s_suppkey", "s_name")


@query("WITH n AS (SELECT count(*) AS n FROM supplier) SELECT CAST(i AS INT) AS shard, CAST(i * 7 AS INT) AS start, CAST(least((i + 1) * 7, n) AS INT) AS stop FROM n, range(CAST(ceil(n / 7.0) AS BIGINT)) AS t(i)")
def shard_plan(spark, d):
    n = _t(spark, d, "supplier").count()
    rows = [(i, *X.shard_bounds(n, i, 7)) for i in range(X.shard_count(n, 7))]
    return spark.createDataFrame(rows, "shard int, start int, stop int")


# the cache: it is filled with the vectors of the documents whose id a vector has


def _cache(spark, d) -> tuple[DataFrame, DataFrame]:
    docs, e = _t(spark, d, "documents"), _t(spark, d, "embeddings")
    j = docs.join(e, F.col("doc_id") == F.col("vec_id"))
    held = j.select(X.content_key(F.col("text")).alias("id"), F.col("embedding").alias("vector"), F.col("doc_id").alias("seq"))
    return docs, embedding.last_wins(held, "id", "seq").select("id", "vector")


_CACHE = "h AS (SELECT DISTINCT text FROM documents JOIN embeddings ON doc_id = vec_id)"


@query(f"WITH {_CACHE} SELECT count(*) FILTER (text IN (SELECT text FROM h)) AS hits, count(*) FILTER (text NOT IN (SELECT text FROM h)) AS misses FROM documents")
def cache_hit_miss(spark, d):
    return embedding.hit_counts(embedding.lookup(*_cache(spark, d)))


@query(f"""WITH {_CACHE}, m AS (SELECT DISTINCT text FROM documents WHERE text NOT IN (SELECT text FROM h)) SELECT md5(text) AS text_md5 FROM m""")
def cache_dedupe(spark, d):
    return embedding.misses(*_cache(spark, d)).select(F.md5(F.col("text").cast("binary")).alias("text_md5"))


@query("""WITH a AS (SELECT text, doc_id, row_number() OVER (PARTITION BY text ORDER BY doc_id % 3 DESC, doc_id DESC) AS n FROM documents) SELECT md5(text) AS text_md5, doc_id AS from_doc, CAST(doc_id % 3 AS INT) AS shard FROM a WHERE n = 1""")
def cache_merge_last_wins(spark, d):
    parts = _t(spark, d, "documents").select(X.content_key(F.col("text")).alias("id"), F.md5(F.col("text").cast("binary")).alias("text_md5"), F.col("doc_id").alias("from_doc"), (F.col("doc_id") % 3).cast("int").alias("shard"))
    return embedding.last_wins(parts.withColumn("seq", F.struct("shard", "from_doc")), "id", "seq").select("text_md5", "from_doc", "shard")


@query("""WITH s AS (SELECT doc_id % 400 AS id, CAST(doc_id % 4 AS INT) AS shard, doc_id FROM documents), k AS (SELECT *, row_number() OVER (PARTITION BY id ORDER BY shard DESC, doc_id DESC) AS n FROM s)
SELECT id, shard, doc_id, (SELECT count(*) FROM s) AS rows_read FROM k WHERE n = 1""")
def shard_merge(spark, d):
    s = _t(spark, d, "documents").select((F.col("doc_id") % 400).alias("id"), (F.col("doc_id") % 4).cast("int").alias("shard"), "doc_id")
    read = s.count()
    return embedding.last_wins(s.withColumn("seq", F.struct("shard", "doc_id")), "id", "seq").select("id", "shard", "doc_id", F.lit(read).cast("long").alias("rows_read"))


# rendering and markup

@query(f"""WITH p AS (SELECT o_orderkey, 'Order Act ' || (o_custkey % 50) AS act, {_URI} AS uri, CASE WHEN o_orderstatus = 'F' THEN 'schedule_clause' ELSE 'section' END AS kind,
 CASE WHEN o_orderstatus = 'F' THEN 'schedule-' || (o_custkey % 9) || '__clause-1' ELSE 'sec-' || (o_custkey % 9) END AS eid, CAST(o_custkey % 9 AS VARCHAR) AS num, o_orderpriority AS heading FROM orders)
SELECT o_orderkey, '[' || act || ' ' || string_split(uri, '/')[5] || CASE kind WHEN 'schedule_clause' THEN ' Sch ' || substr(string_split(eid, '__')[1], 10) || ' cl ' ELSE ' s ' END || num || ' (' || eid || ') score=0.50 (as at ' || string_split(uri, '@')[2] || ')]'
 || chr(10) || heading || chr(10) || 'Text ' || num || chr(10) || 'Refs: #sec-1' AS block FROM p""")
def citation_render(spark, d):
    clause = F.col("o_orderstatus") == "F"
    nine = (F.col("o_custkey") % 9).cast("string")
    rows = _t(spark, d, "orders").select(
        "o_orderkey", F.concat(F.lit("Order Act "), (F.col("o_custkey") % 50).cast("string")).alias("act_name"), _uri().alias("frbr_uri"),
        F.when(clause, "schedule_clause").otherwise("section").alias("provision_type"),
        F.when(clause, F.concat(F.lit("schedule-"), nine, F.lit("__clause-1"))).otherwise(F.concat(F.lit("sec-"), nine)).alias("eid"),
        nine.alias("provision_num"), F.col("o_orderpriority").alias("heading"), F.concat(F.lit("Text "), nine).alias("text"), F.array(F.lit("#sec-1"), F.lit("unresolved:The Code 1999")).alias("refs"),
    )
    return rows.select("o_orderkey", F.concat(render.head(F.lit("0.50")), render.body()).alias("block"))


_CORPUS = (
    '<akomaNtoso xmlns="http://docs.oasis-open.org/legaldocml/ns/akn/3.0"><act><meta><identification><FRBRExpression><FRBRuri value="%3$s"/></FRBRExpression></identification></meta><body>'
    '<section eId="sec-1"><num>1</num><heading>Short title</heading><content><p>This is the <i>%1$s</i>, see section 2.</p></content></section>'
    '<section eId="sec-2"><num>2</num><subsection eId="sec-2__subsec-1"><content><p>Read this with the %2$s and Part 3.</p></content></subsection>'
    '<subsection eId="sec-2__subsec-2"><content><p>Too short.</p></content></subsection></section></body><attachments><attachment><hcontainer name="schedule" eId="schedule-1">'
    '<hcontainer name="clause" eId="schedule-1__clause-1"><num>1</num><heading>Rates</heading><content><table><tr><td>%4$s</td><td>%5$s</td></tr><tr><td/><td>20</td></tr></table></content></hcontainer>'
    "</hcontainer></attachment></attachments></act></akomaNtoso>"
)
# a customer's Act: its key in letters, and a year
_ACT_SQL = "upper(translate({0}::VARCHAR, '0123456789', 'abcdefghij')[1]) || translate({0}::VARCHAR, '0123456789', 'abcdefghij')[2:] || ' Trade Act ' || (1950 + {0} % 50)"
_ACTS_SQL = f"""a AS (SELECT c_custkey AS k, {_ACT_SQL.format("c_custkey")} AS act, {_ACT_SQL.format("(c_custkey + 1)")} AS other, '/akn/au/act/' || (1950 + c_custkey % 50) || '/' || c_custkey || '/eng@2020-02-03' AS uri,
 c_mktsegment AS seg, CAST(c_nationkey AS VARCHAR) AS nation, CASE WHEN c_custkey % 4 = 3 THEN NULL ELSE '/akn/au/act/' || (1950 + c_custkey % 50) || '/' || c_custkey END AS listed FROM customer)"""


def _act_name(key: Column) -> Column:
    letters = F.translate(key.cast("string"), "0123456789", "abcdefghij")
    return F.concat(F.upper(F.substring(letters, 1, 1)), F.substring(letters, 2, 100), F.lit(" Trade Act "), (1950 + key % 50).cast("string"))


def _act_files(spark, d) -> tuple[DataFrame, DataFrame]:
    """Documents of record made of customers, each citing the next one's, and the index by which three in four of them are resolved."""
    c = _t(spark, d, "customer")
    key = F.col("c_custkey")
    short = F.concat(F.lit("/akn/au/act/"), (1950 + key % 50).cast("string"), F.lit("/"), key.cast("string"))
    xml = F.format_string(_CORPUS, _act_name(key), _act_name(key + 1), F.concat(short, F.lit("/eng@2020-02-03")), F.col("c_mktsegment"), _str("c_nationkey"))
    files = c.select(key.cast("int").alias("act_ord"), _act_name(key).alias("act_name"), F.encode(xml, "UTF-8").alias("content"))
    return files, c.where(key % 4 != 3).select(_act_name(key).alias("name"), short.alias("uri"))


@query(f"""WITH {_ACTS_SQL}, r AS (SELECT a.*, coalesce(b.listed, 'unresolved:' || a.other) AS other_ref, coalesce(a.listed, 'unresolved:' || a.act) AS own_ref FROM a LEFT JOIN a b ON a.other = b.act)
SELECT act AS act_name, uri AS frbr_uri, 'section' AS provision_type, 'sec-1' AS eid, '1' AS provision_num, 'Short title' AS heading, '1 Short title This is the ' || act || ' , see section 2.' AS text, '#sec-2|' || own_ref AS refs FROM r
UNION ALL SELECT act, uri, 'section', 'sec-2', '2', NULL, '2 Read this with the ' || other || ' and Part 3. Too short.', '#part-3|' || other_ref FROM r
UNION ALL SELECT act, uri, 'subsection', 'sec-2__subsec-1', '2(1', NULL, 'Read this with the ' || other || ' and Part 3.', '#part-3|' || other_ref FROM r
UNION ALL SELECT act, uri, 'schedule_clause', 'schedule-1__clause-1', '1', 'Rates', '1 Rates ' || seg || ' | ' || nation || ' 20', '' FROM r""")
def akn_provisions(spark, d):
    """Documents with tables, schedules, URIs and citations of one another."""
    files, index_of = _act_files(spark, d)
    rows = R.with_refs(markup.parse(files.repartition(int(spark.conf.get("spark.sql.shuffle.partitions")), "act_ord")), index_of, ["act_ord", "kind_ord", "prov_ord"])
    return rows.select("act_name", "frbr_uri", "provision_type", "eid", "provision_num", "heading", "text", F.array_join("refs", "|").alias("refs"))


@query(f"""WITH {_ACTS_SQL} SELECT act AS act_name, uri AS frbr_uri, 'schedule-1__clause-1' AS eid, '1 Rates ' || seg || ' | ' || nation || ' 20' AS text FROM a""")
def akn_lateral(spark, d):
    """The parser as a table function in SQL."""
    files, _ = _act_files(spark, d)
    markup.register(spark)
    sql = "SELECT f.act_name, p.frbr_uri, p.eid, p.text FROM {files} f, LATERAL akn_provisions(f.content) p WHERE p.provision_type = 'schedule_clause'"
    return spark.sql(sql, files=files.repartition(int(spark.conf.get("spark.sql.shuffle.partitions")), "act_ord"))


@query(f"""WITH {_ACTS_SQL} SELECT act AS act_name, CAST(1950 + k % 50 AS INT) AS year, '2020-02-03' AS as_at_date, CAST(2 AS BIGINT) AS section_count, CAST(1 AS BIGINT) AS schedule_clause_count FROM a""")
def akn_roll_up(spark, d):
    files, _ = _act_files(spark, d)
    rows = markup.parse(files.repartition(int(spark.conf.get("spark.sql.shuffle.partitions")), "act_ord"))
    return corpus.roll_up(rows).select("act_name", "year", "as_at_date", "section_count", "schedule_clause_count")


@query("""WITH s AS (SELECT *, row_number() OVER (ORDER BY s_suppkey) AS i FROM supplier WHERE s_suppkey % 7 <> 0)
SELECT CAST(i - 1 AS INT) AS act_ord, 'k' || s_suppkey AS slug, s_name AS name, 'x/' || s_suppkey || '.xml' AS xml_path, CASE WHEN s_suppkey % 2 = 0 THEN '/akn/' || s_suppkey END AS frbr_expression_uri FROM s""")
def corpus_index(spark, d):
    """File order is kept, and an entry without a name is passed over."""
    key = _str("s_suppkey")
    entry = F.map_filter(
        F.create_map(F.lit("name"), F.when(F.col("s_suppkey") % 7 != 0, F.col("s_name")), F.lit("xml_path"), F.concat(F.lit("x/"), key, F.lit(".xml")), F.lit("frbr_expression_uri"), F.when(F.col("s_suppkey") % 2 == 0, F.concat(F.lit("/akn/"), key))),
        lambda k, v: v.isNotNull(),
    )
    # an index is one file, of as many entries as there are documents of record
    part = F.struct("s_suppkey", F.concat(F.lit('"k'), key, F.lit('": '), F.to_json(entry)).alias("json"))
    file = _t(spark, d, "supplier").agg(F.array_join(F.transform(F.array_sort(F.collect_list(part)), lambda p: p["json"]), ", ").alias("body"))
    raw = file.select(F.concat(F.lit('{"acts": {'), "body", F.lit("}}")).alias("value"))
    return corpus.index_rows(raw).select("act_ord", "slug", "name", "xml_path", "frbr_expression_uri")


@query(f"{_KEY} SELECT doc_id, {_KEY_TEXT} AS key, 64 AS dim FROM k")
def cached_embedding(spark, d):
    """Each text is embedded once, by hashing of its words; every document gets its text's vector."""
    docs = _t(spark, d, "documents").select("doc_id", "text")
    none = spark.createDataFrame([], "id string, vector array<float>")
    made = embedding.embed_texts(embedding.misses(docs, none), embedding.HashingEmbedder())
    return embedding.lookup(docs, made).select("doc_id", "key", F.size("vector").alias("dim"))


# markup of documents made up from a table, and a store that is filled in parts

_AKN = (
    '<akomaNtoso xmlns="http://docs.oasis-open.org/legaldocml/ns/akn/3.0"><act><meta><identification><FRBRExpression><FRBRuri value="/akn/x/{0}"/></FRBRExpression></identification></meta>'
    '<body><section eId="sec-1"><num>{1}</num><heading>{2}</heading><content><p>Order  {0}\n<i>of</i> customer {1} is here.</p></content></section>'
    '<section eId="sec-2"><num>2</num><subsection eId="sec-2__subsec-1"><num>(1)</num><content><p>Customer {1} keeps the order.</p></content></subsection></section></body></act></akomaNtoso>'
)


@query("""WITH o AS (SELECT o_orderkey AS k, CAST(o_custkey AS VARCHAR) AS c, o_orderpriority AS p FROM orders)
SELECT k, 'section' AS provision_type, 'sec-1' AS eid, c AS provision_num, p AS heading, c || ' ' || p || ' Order ' || k || ' of customer ' || c || ' is here.' AS text FROM o
UNION ALL SELECT k, 'section', 'sec-2', '2', NULL, '2 (1) Customer ' || c || ' keeps the order.' FROM o
UNION ALL SELECT k, 'subsection', 'sec-2__subsec-1', '2(1', NULL, '(1) Customer ' || c || ' keeps the order.' FROM o""")
def akn_orders(spark, d):
    """A document of two sections for every order."""
    text = F.format_string(_AKN.replace("{0}", "%1$s").replace("{1}", "%2$s").replace("{2}", "%3$s"), _str("o_orderkey"), _str("o_custkey"), F.col("o_orderpriority"))
    files = _t(spark, d, "orders").select(F.col("o_orderkey").cast("int").alias("act_ord"), F.lit("Order Act").alias("act_name"), F.encode(text, "UTF-8").alias("content"))
    # the table is one small file: its documents are dealt out before they are parsed
    rows = markup.parse(files.repartition(int(spark.conf.get("spark.sql.shuffle.partitions")), "act_ord"))
    return rows.select(F.col("act_ord").cast("long").alias("k"), "provision_type", "eid", "provision_num", "heading", "text")


def _scratch(spark: SparkSession) -> str:
    """A new folder that driver and executors share; a temporary one only in local mode."""
    shared = spark.conf.get("spark.checkpoint.dir", None)
    if not shared and not spark.sparkContext.master.startswith("local"):
        raise ValueError("set spark.checkpoint.dir to a folder that all executors share")
    if not shared:
        own = tempfile.mkdtemp(prefix="clauseworks-")
        atexit.register(shutil.rmtree, own, ignore_errors=True)
        shared = f"file://{own}"
    return f"{shared.rstrip('/')}/store-{uuid.uuid4().hex}"


def _provisions(spark, d) -> DataFrame:
    """Documents as provisions, with the language as their kind."""
    return _t(spark, d, "documents").select(
        F.coalesce("source", F.lit("")).alias("act_name"), F.lit("").alias("frbr_uri"), F.coalesce("lang", F.lit("")).alias("provision_type"), F.concat(F.lit("sec-"), _str("doc_id")).alias("eid"),
        F.lit(0).alias("act_ord"), F.lit(0).alias("kind_ord"), F.col("doc_id").alias("prov_ord"), "text", F.array().cast("array<string>").alias("terms"), "doc_id", "lang",
    )


class VowelEmbedder:
    """How often each of five letters is in a text, and once more: an embedder that SQL can express."""

    name, dim = "vowels", 5

    def embed(self, texts: list[str], kind: str) -> list[list[float]]:
        return [[1.0 + t.count(v) for v in "aeiou"] for t in texts]


def _store(spark, d) -> index.Collection:
    """Documents as provisions: put in two overlapping shards into one store, which is merged with a third."""
    docs, at, embedder = _provisions(spark, d), _scratch(spark), VowelEmbedder()
    for name, keep in (("a", F.col("doc_id") % 3 == 0), ("a", (F.col("doc_id") % 3 == 1) | (F.col("doc_id") % 2 == 0)), ("b", (F.col("doc_id") % 3 == 2) | (F.col("doc_id") % 5 == 0))):
        index.upsert(index.provision_documents(docs.where(keep)), f"{at}/{name}", embedder, tie="doc_id")
    index.merge(spark, [f"{at}/a", f"{at}/b"], f"{at}/all", tie="doc_id")
    return index.read(spark, f"{at}/all")


def _changed(spark, d) -> index.Collection:
    """Documents in two segments, of which the second takes the place of a third of the first with longer texts."""
    docs, at = _provisions(spark, d), _scratch(spark)
    index.upsert(index.provision_documents(docs), at, VowelEmbedder(), tie="doc_id")
    newer = docs.where("doc_id % 3 = 1").withColumn("text", F.concat("text", F.lit(" and the end of it")))
    index.upsert(index.provision_documents(newer), at, VowelEmbedder(), tie="doc_id")
    return index.read(spark, at)


_CHANGED = "documents AS (SELECT doc_id, lang, source, CASE WHEN doc_id % 3 = 1 THEN text || ' and the end of it' ELSE text END AS text FROM main.documents)"


@query(f"WITH {_CHANGED} SELECT doc_id, md5(text) AS text_md5, md5(text) AS document_md5 FROM documents")
def store_versions(spark, d):
    """Rows that count after a change: segments less their tombstones."""
    rows = _changed(spark, d).payload
    return rows.select("doc_id", F.md5(F.col("text").cast("binary")).alias("text_md5"), F.md5(F.col("document").cast("binary")).alias("document_md5"))


@query(f"WITH {_CHANGED}, {_BM25} SELECT doc_id, score FROM sc ORDER BY score DESC, doc_id LIMIT 10")
def store_changed_search(spark, d):
    """BM25 after a change: counts and lengths are those of rows that count, by blocks that may matter."""
    return _named(_changed(spark, d).search_words(list(TERMS), LIMIT))


@query(f"WITH {_CHANGED}, t AS (SELECT DISTINCT doc_id, unnest({_TOKENS}) AS term FROM documents) SELECT term, count(*) AS df FROM t GROUP BY term")
def store_term_stats(spark, d):
    return _changed(spark, d).term_stats()


def _named(hits: DataFrame) -> DataFrame:
    return hits.select(F.col("tie").alias("doc_id"), F.round("score", 6).alias("score"))


@query(f"WITH {_BM25} SELECT doc_id, score FROM sc WHERE lang = 'en' ORDER BY score DESC, doc_id LIMIT 10")
def store_search(spark, d):
    """BM25 with a filter over a store that was filled by upserts and a merge: as over all documents at once."""
    return _named(_store(spark, d).search_words(list(TERMS), LIMIT, {"provision_type": "en"}))


_VOWELS = "[1.0 + length(text) - length(replace(text, 'a', ''))" + "".join(f", 1.0 + length(text) - length(replace(text, '{v}', ''))" for v in "eiou") + "]"


@query(
    f"""WITH {_BM25}, o AS (SELECT source AS act FROM documents WHERE lang = 'en' AND source IS NOT NULL ORDER BY doc_id LIMIT 1), qv AS (SELECT {_VOWELS} AS q FROM (SELECT 'thing of and' AS text)),
dn AS (SELECT doc_id, round(list_cosine_similarity(CAST({_VOWELS} AS DOUBLE[]), CAST(q AS DOUBLE[])), 9) AS score FROM documents, qv, o WHERE lang = 'en' AND source = act),
a AS (SELECT doc_id, row_number() OVER (ORDER BY score DESC, doc_id) AS r FROM sc WHERE doc_id IN (SELECT doc_id FROM dn) ORDER BY score DESC, doc_id LIMIT 10),
b AS (SELECT doc_id, row_number() OVER (ORDER BY score DESC, doc_id) AS r FROM dn ORDER BY score DESC, doc_id LIMIT 10),
f AS (SELECT doc_id, sum(1.0 / (60.0 + r)) AS score FROM (SELECT * FROM a UNION ALL SELECT * FROM b) GROUP BY doc_id),
k AS (SELECT doc_id, score, row_number() OVER (ORDER BY score DESC, doc_id) AS rank FROM f ORDER BY score DESC, doc_id LIMIT 5)
SELECT CAST(rank AS INT) AS rank, '[' || act || '  s  (sec-' || doc_id || ') score=' || printf('%.2f', score) || ']' || chr(10) || text AS block FROM k JOIN documents USING (doc_id), o"""
)
def engine_hybrid(spark, d):
    """Ingest in two parts, hybrid search with two filters, and rendering with the scores that it gives."""
    at = _scratch(spark)
    act = _t(spark, d, "documents").where("lang = 'en' AND source IS NOT NULL").orderBy("doc_id").select("source").first()["source"]
    docs = _provisions(spark, d).withColumn("provision_num", F.lit("")).withColumn("heading", F.lit(None).cast("string")).withColumn("refs", F.array().cast("array<string>"))
    engine = Engine(spark, at, VowelEmbedder())
    for keep in ("doc_id % 2 = 0", "doc_id % 2 = 1 OR doc_id % 10 = 0"):
        index.upsert(index.provision_documents(docs.where(keep)), f"{at}/{index.PROVISIONS}", engine.embedder, tie="doc_id")
    return render.blocks(engine.search_provisions("thing of and", 5, act, "en"))


@query(f"WITH {_BM25} SELECT doc_id, score FROM sc ORDER BY score DESC, doc_id LIMIT 10")
def bm25_blocks_topk(spark, d):
    """Over postings in blocks: ranges whose bound is below the tenth best score are passed over."""
    rows = _t(spark, d, "documents").select(F.monotonically_increasing_id().alias("doc"), F.col("doc_id").alias("tie"), "text")
    at, seen = _scratch(spark), Observation()
    postings.write(postings.build(rows, seen=seen), at)
    blocks = spark.read.parquet(at)
    df = blocks.where(F.col("term").isin(list(TERMS))).groupBy("term").agg(F.sum("n").alias("df")).collect()
    stats = postings.Stats(seen.get["n"], seen.get["avgdl"] or 0.0, {r["term"]: r["df"] for r in df})
    return _named(postings.search(blocks, stats, LIMIT, first=4))


_MANY = rf"""WITH q AS (SELECT DISTINCT item_id AS qid, unnest({_TOKENS}) AS term FROM benchmark), t AS (SELECT doc_id, {_TOKENS} AS ts FROM documents),
s AS (SELECT count(*) AS n, avg(len(ts)) AS avgdl FROM t), p AS (SELECT doc_id, len(ts) AS dl, unnest(ts) AS term FROM t),
tf AS (SELECT doc_id, dl, term, count(*) AS tf FROM p GROUP BY ALL), df AS (SELECT term, count(*) AS df FROM tf GROUP BY term),
sc AS (SELECT qid, doc_id, round(sum(ln(1.0 + (n - df + 0.5) / (df + 0.5)) * tf * 2.2 / (tf + 1.2 * (1 - 0.75 + 0.75 * dl / avgdl))), 6) AS score FROM q JOIN tf USING (term) JOIN df USING (term), s GROUP BY qid, doc_id)
SELECT qid, CAST(r AS INT) AS rank, doc_id, score FROM (SELECT *, row_number() OVER (PARTITION BY qid ORDER BY score DESC, doc_id) AS r FROM sc) WHERE r <= 5"""


@query(_MANY)
def bm25_many(spark, d):
    """Every text of the benchmark as a query over all documents, in one job."""
    rows = _t(spark, d, "documents").select(F.monotonically_increasing_id().alias("doc"), F.col("doc_id").alias("tie"), "text")
    at, seen = _scratch(spark), Observation()
    postings.write(postings.build(rows, seen=seen), at)
    blocks = spark.read.parquet(at)
    queries = _t(spark, d, "benchmark").select(F.col("item_id").alias("qid"), F.explode(X.tokens(F.coalesce("text", F.lit("")))).alias("term"))
    df = blocks.groupBy("term").agg(F.sum("n").alias("df"))
    found = postings.search_many(blocks, queries, postings.Stats(seen.get["n"], seen.get["avgdl"] or 0.0), df, 5)
    return found.select("qid", "rank", F.col("tie").alias("doc_id"), "score")


@query("""WITH e AS (SELECT vec_id, label, CAST(embedding AS DOUBLE[]) AS v FROM embeddings),
q AS (SELECT label AS qid, list(m ORDER BY i) AS q FROM (SELECT label, i, avg(x) AS m FROM (SELECT label, unnest(v) AS x, generate_subscripts(v, 1) AS i FROM e) GROUP BY label, i) GROUP BY label),
s AS (SELECT qid, vec_id, round(list_cosine_similarity(v, q), 6) AS score FROM e, q)
SELECT qid, CAST(r AS INT) AS rank, vec_id, score FROM (SELECT *, row_number() OVER (PARTITION BY qid ORDER BY score DESC, vec_id) AS r FROM s) WHERE r <= 5""")
def dense_many(spark, d):
    """The mean vector of each label as a query over all vectors, in one job."""
    v = _vectors(spark, d)
    means = v.select("label", F.posexplode("vector").alias("i", "x")).groupBy("label", "i").agg(F.avg(F.col("x").cast("double")).alias("m"))
    means = means.groupBy(F.col("label").alias("qid")).agg(F.transform(F.array_sort(F.collect_list(F.struct("i", "m"))), lambda s: s["m"]).alias("vector"))
    return dense.search_many(v, means, 5).select("qid", "rank", F.col("id").alias("vec_id"), F.round("score", 6).alias("score"))


@query(f"WITH {_COS} SELECT vec_id, score FROM dn ORDER BY score DESC, vec_id LIMIT 10")
def dense_index_topk(spark, d):
    """Over vectors in lists: the nearest list first, then those that may hold a better one."""
    v, at = _vectors(spark, d), _scratch(spark)
    centroids = ivf.train(v, 16, rounds=5)
    ivf.filed(v, centroids).write.partitionBy("list").parquet(at)
    filed = spark.read.parquet(at)
    found = ivf.search(filed, centroids, ivf.list_stats(filed), _query_vector(v), LIMIT, 1, exact=True)
    return lexical.top(found, LIMIT).withColumnRenamed("id", "vec_id")


@query("SELECT count(*) AS rows, count(*) AS vectors, CAST(count(DISTINCT source) AS BIGINT) AS acts FROM documents")
def store_counts(spark, d):
    """A store that was filled by upserts and a merge holds every row and vector once."""
    store = _store(spark, d)
    one = store.payload.agg(F.count("*").alias("rows"), F.countDistinct("act_name").alias("acts"))
    return one.join(F.broadcast(store.vectors.agg(F.count("*").alias("vectors")))).select("rows", "vectors", "acts")  # one row each
