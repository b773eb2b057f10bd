"""Registered queries of the library's own operators, with their SQL for DuckDB."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window as W

from kgspark.functions import text as T
from kgspark.operators import chunking, fusion, graph, graph_documents, metrics, ontology, resolution, retrieval, similar, sync
from kgspark.operators.search_index import SearchIndex
from kgspark.operators.vector_index import VectorIndex
from kgspark.sources.readers import table, web_documents
from kgspark.sources.shared import shared_dir, staged
from kgspark.streaming.changes import ChangeTable

TERMS = ["the", "tion", "ander"]
QUERIES, ORACLES = {}, {}
#: The index of each folder's documents that this application has written, by its id and the folder.
_INDEXES: dict[tuple[str, str], str] = {}


def query(sql: str | None = None):
    """Register a query under its name, with its SQL."""

    def add(f):
        QUERIES[f.__name__] = f
        if sql:
            ORACLES[f.__name__] = sql
        return f

    return add


def _docs(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "documents").select(F.col("doc_id").alias("node_id"), "text")


def _index(spark: SparkSession, d: str) -> SearchIndex:
    """The index of a folder's documents, written by the first query that asks for it; the tables are taken not to change meanwhile."""
    key = spark.sparkContext.applicationId, d
    if key not in _INDEXES:
        path = shared_dir(spark, "index")
        SearchIndex.create(_docs(spark, d), path)
        _INDEXES[key] = path
    return SearchIndex(spark, _INDEXES[key])


def _vectors(spark: SparkSession, d: str) -> tuple[DataFrame, DataFrame]:
    v = table(spark, d, "embeddings").select(F.col("vec_id").alias("node_id"), "embedding")
    return v, v.orderBy("node_id").limit(1)


def _vector_sql(score: str) -> str:
    return f"""WITH v AS (SELECT vec_id AS node_id, CAST(embedding AS DOUBLE[]) AS e FROM embeddings),
 q AS (SELECT e AS q FROM v ORDER BY node_id LIMIT 1)
SELECT node_id, round({score}, 6) AS score FROM v, q ORDER BY score DESC, node_id LIMIT 10"""


@query(_vector_sql("list_cosine_similarity(e, q)"))
def vector_topk_cosine(spark: SparkSession, d: str) -> DataFrame:
    return retrieval.vector_topk(*_vectors(spark, d), 10, "cosine")


@query(_vector_sql("1 / (1 + list_distance(e, q))"))
def vector_topk_l2(spark: SparkSession, d: str) -> DataFrame:
    return retrieval.vector_topk(*_vectors(spark, d), 10, "l2")


@query(_vector_sql("list_inner_product(e, q)"))
def vector_topk_ip(spark: SparkSession, d: str) -> DataFrame:
    return retrieval.vector_topk(*_vectors(spark, d), 10, "ip")


def _bm25_sql() -> str:
    tf = ", ".join(f"len(list_filter(w, lambda x: x = '{t}')) AS tf{i}" for i, t in enumerate(TERMS))
    df = ", ".join(f"count(*) FILTER (WHERE tf{i} > 0) AS df{i}" for i in range(len(TERMS)))
    s = " + ".join(f"ln(1 + (n - df{i} + 0.5) / (df{i} + 0.5)) * tf{i} * 2.5 / (tf{i} + 1.5 * (0.25 + 0.75 * size / mean))" for i in range(len(TERMS)))
    some = " OR ".join(f"tf{i} > 0" for i in range(len(TERMS)))
    return f"""w AS (SELECT doc_id AS node_id, list_filter(string_split_regex(lower(text), '[^a-z0-9]+'), lambda x: x <> '') AS w FROM documents),
 h AS (SELECT node_id, len(w) AS size, {tf} FROM w), st AS (SELECT count(*) AS n, avg(size) AS mean, {df} FROM h),
 bm AS (SELECT node_id, round({s}, 6) AS score FROM h, st WHERE {some})"""


@query(f"WITH {_bm25_sql()} SELECT node_id, score FROM bm ORDER BY score DESC, node_id LIMIT 10")
def bm25_topk(spark: SparkSession, d: str) -> DataFrame:
    return _index(spark, d).search(TERMS)


def _each_sql(score: str) -> str:
    return f"""WITH v AS (SELECT vec_id AS node_id, CAST(embedding AS DOUBLE[]) AS e FROM embeddings), q AS (SELECT node_id AS query_id, e AS q FROM v WHERE node_id % 100 = 0),
 s AS (SELECT query_id, node_id, round({score}, 6) AS score FROM v, q)
SELECT query_id, node_id, score FROM s QUALIFY row_number() OVER (PARTITION BY query_id ORDER BY score DESC, node_id) <= 10"""


def _vectors_each(spark: SparkSession, d: str, metric: str, k: int = 10) -> DataFrame:
    v = _vectors(spark, d)[0]
    return retrieval.vector_topk_each(v, v.where("node_id % 100 = 0").withColumnRenamed("node_id", "query_id"), k, metric)


@query(_each_sql("list_cosine_similarity(e, q)"))
def vector_topk_cosine_each(spark: SparkSession, d: str) -> DataFrame:
    return _vectors_each(spark, d, "cosine")


@query(_each_sql("1 / (1 + list_distance(e, q))"))
def vector_topk_l2_each(spark: SparkSession, d: str) -> DataFrame:
    return _vectors_each(spark, d, "l2")


@query(_each_sql("list_inner_product(e, q)"))
def vector_topk_ip_each(spark: SparkSession, d: str) -> DataFrame:
    return _vectors_each(spark, d, "ip")


@query()
def vector_index_topk_each(spark: SparkSession, d: str) -> DataFrame:
    """As vector_topk_cosine_each, from the nearest cells of an index alone."""
    v = _vectors(spark, d)[0]
    index = VectorIndex.create(v, shared_dir(spark, "vectors"))
    return index.search_each(v.where("node_id % 100 = 0").withColumnRenamed("node_id", "query_id"))


def _bm25_each_sql(docs: str = "documents", asked: str = "documents", k: int = 10) -> str:
    """The k best documents of docs for the terms of every hundredth text of asked, as tables that follow WITH; the last is bm."""
    words = "list_filter(string_split_regex(lower(text), '[^a-z0-9]+'), lambda x: x <> '') AS w"
    return f"""w AS (SELECT doc_id AS node_id, {words} FROM {docs}),
 st AS (SELECT count(*) AS n, avg(len(w)) AS mean FROM w), t AS (SELECT node_id, len(w) AS size, unnest(w) AS term FROM w),
 p AS (SELECT node_id, size, term, count(*) AS tf FROM t GROUP BY ALL), f AS (SELECT term, count(*) AS df FROM p GROUP BY term),
 a AS (SELECT doc_id AS query_id, {words} FROM {asked} WHERE doc_id % 100 = 0), qt AS (SELECT DISTINCT query_id, unnest(w) AS term FROM a),
 s0 AS (SELECT query_id, node_id, round(sum(ln(1 + (n - df + 0.5) / (df + 0.5)) * tf * 2.5 / (tf + 1.5 * (0.25 + 0.75 * size / mean))), 6) AS score FROM qt JOIN p USING (term) JOIN f USING (term), st GROUP BY 1, 2),
 bm AS (SELECT query_id, node_id, score FROM s0 QUALIFY row_number() OVER (PARTITION BY query_id ORDER BY score DESC, node_id) <= {k})"""


def _asked(spark: SparkSession, d: str) -> DataFrame:
    """The terms of every hundredth document, as queries."""
    return _docs(spark, d).where("node_id % 100 = 0").select(F.col("node_id").alias("query_id"), retrieval.tokens(F.col("text")).alias("terms"))


@query(f"WITH {_bm25_each_sql()} SELECT * FROM bm")
def bm25_topk_each(spark: SparkSession, d: str) -> DataFrame:
    return _index(spark, d).search_each(_asked(spark, d))


_CHANGED = """changed AS (SELECT doc_id, CASE WHEN doc_id % 5 = 0 THEN text || ' replaced ' || coalesce(lang, '') ELSE text END AS text FROM documents WHERE doc_id % 7 <> 0
 UNION ALL SELECT -1 - doc_id, 'new ' || lang FROM documents WHERE doc_id % 11 = 0)"""


@query(f"WITH {_CHANGED}, {_bm25_each_sql('changed')} SELECT * FROM bm")
def bm25_after_changes(spark: SparkSession, d: str) -> DataFrame:
    """Searches of an index that documents were deleted from, replaced in and put into since it was written."""
    docs = table(spark, d, "documents").select(F.col("doc_id").alias("node_id"), "text", "lang")
    index = SearchIndex.create(docs.select("node_id", "text"), shared_dir(spark, "index"))
    index.delete(docs.where("node_id % 7 = 0").select("node_id"))
    index.replace(docs.where("node_id % 5 = 0 and node_id % 7 <> 0").select("node_id", F.concat("text", F.lit(" replaced "), F.coalesce("lang", F.lit(""))).alias("text")))
    index.replace(docs.where("node_id % 11 = 0").select((-1 - F.col("node_id")).alias("node_id"), F.concat(F.lit("new "), "lang").alias("text")))
    return index.search_each(_asked(spark, d))


_BOTH = f"""WITH {_bm25_sql()},
 v AS (SELECT vec_id AS node_id, CAST(embedding AS DOUBLE[]) AS e FROM embeddings), q AS (SELECT e AS q FROM v ORDER BY node_id LIMIT 1),
 r AS ((SELECT 'bm25' AS retriever, node_id, score FROM bm ORDER BY score DESC, node_id LIMIT 15)
 UNION ALL (SELECT 'vector', node_id, round(list_cosine_similarity(e, q), 6) AS score FROM v, q ORDER BY score DESC, node_id LIMIT 15))"""


def _results(spark: SparkSession, d: str) -> DataFrame:
    # thirty rows, read more than once
    return staged(fusion.labelled({"bm25": _index(spark, d).search(TERMS, 15), "vector": retrieval.vector_topk(*_vectors(spark, d), 15)}), "results")


def _rank_sql(by: str = "") -> str:
    """The ten best of s with their rank, and flat scores spread over the ranks of all of them; within each value of by, if given."""
    part, lead = (f"PARTITION BY {by}", f"{by}, ") if by else ("", "")
    return f""", top AS (SELECT *, row_number() OVER o AS rank, count(*) OVER p AS n, min(score) OVER p AS low, max(score) OVER p AS high FROM s WINDOW p AS ({part}), o AS ({part} ORDER BY score DESC, node_id))
SELECT {lead}node_id, rank, CASE WHEN n > 1 AND high - low < 0.05 AND high > 0 THEN round(1 - (rank - 1) / CAST(n - 1 AS DOUBLE) * 0.8, 3) WHEN n = 1 AND high > 0 THEN 1.0 ELSE score END AS score FROM top WHERE rank <= 10"""


_RANK = _rank_sql()


@query(_BOTH + """, x AS (SELECT node_id, CASE WHEN max(score) OVER w > min(score) OVER w THEN (score - min(score) OVER w) / (max(score) OVER w - min(score) OVER w) ELSE 1.0 END / 2 AS score
 FROM r WINDOW w AS (PARTITION BY retriever)), s AS (SELECT node_id, round(sum(score), 6) AS score FROM x GROUP BY node_id)""" + _RANK)
def hybrid_relative_fusion(spark: SparkSession, d: str) -> DataFrame:
    return fusion.ranked(fusion.summed(fusion.relative_scores(_results(spark, d), 2)), 10)


@query(_BOTH + """, x AS (SELECT node_id, 1 / (2.0 * (60 + row_number() OVER (PARTITION BY retriever ORDER BY score DESC, node_id))) AS score FROM r),
 s AS (SELECT node_id, round(sum(score), 6) AS score FROM x GROUP BY node_id)""" + _RANK)
def hybrid_rrf(spark: SparkSession, d: str) -> DataFrame:
    return fusion.ranked(fusion.summed(fusion.reciprocal_ranks(_results(spark, d), 2)), 10)


_BOTH_EACH = f"""WITH {_bm25_each_sql(k=15)}, v AS (SELECT vec_id AS node_id, CAST(embedding AS DOUBLE[]) AS e FROM embeddings), vq AS (SELECT node_id AS query_id, e AS q FROM v WHERE node_id % 100 = 0),
 vs AS (SELECT query_id, node_id, round(list_cosine_similarity(e, q), 6) AS score FROM v, vq),
 r AS (SELECT 'bm25' AS retriever, * FROM bm UNION ALL SELECT 'vector', * FROM vs QUALIFY row_number() OVER (PARTITION BY query_id ORDER BY score DESC, node_id) <= 15)"""


def _results_each(spark: SparkSession, d: str) -> DataFrame:
    """For every hundredth id: the best by its text and by its vector."""
    return staged(fusion.labelled({"bm25": _index(spark, d).search_each(_asked(spark, d), 15), "vector": _vectors_each(spark, d, "cosine", 15)}), "results")


@query(_BOTH_EACH + """, x AS (SELECT query_id, node_id, CASE WHEN max(score) OVER w > min(score) OVER w THEN (score - min(score) OVER w) / (max(score) OVER w - min(score) OVER w) ELSE 1.0 END / 2 AS score
 FROM r WINDOW w AS (PARTITION BY query_id, retriever)), s AS (SELECT query_id, node_id, round(sum(score), 6) AS score FROM x GROUP BY ALL)""" + _rank_sql("query_id"))
def hybrid_relative_fusion_each(spark: SparkSession, d: str) -> DataFrame:
    by = ["query_id"]
    return fusion.ranked(fusion.summed(fusion.relative_scores(_results_each(spark, d), 2, by), by=by), 10, by)


@query(_BOTH_EACH + """, x AS (SELECT query_id, node_id, 1 / (2.0 * (60 + row_number() OVER (PARTITION BY query_id, retriever ORDER BY score DESC, node_id))) AS score FROM r),
 s AS (SELECT query_id, node_id, round(sum(score), 6) AS score FROM x GROUP BY ALL)""" + _rank_sql("query_id"))
def hybrid_rrf_each(spark: SparkSession, d: str) -> DataFrame:
    by = ["query_id"]
    return fusion.ranked(fusion.summed(fusion.reciprocal_ranks(_results_each(spark, d), 2, by=by), by=by), 10, by)


@query(f"""WITH {_bm25_sql()} SELECT sha256(trim(text)) AS mark, round(sum(score), 6) AS score, arg_max(node_id, (score, -node_id)) AS node_id, count(*) AS copies
FROM bm JOIN documents ON doc_id = node_id WHERE trim(text) <> '' GROUP BY 1""")
def dedup_sum_scores(spark: SparkSession, d: str) -> DataFrame:
    docs = _docs(spark, d)
    return fusion.dedup_sum(_index(spark, d).scores(TERMS).join(docs, "node_id"))


_STUB = r"(trim(text) <> '' AND length(trim(text)) < 80 AND NOT regexp_matches(trim(text), '[.?!]$'))"
_STEP = " OR ".join("starts_with(lower(trim(text)), '" + x.replace("'", "''") + "')" for x in T.STEPS)
_KIND = rf"CASE WHEN regexp_matches(text, '^\s*$') THEN 'blank' WHEN {_STEP} THEN 'step' WHEN regexp_matches(text, '^[^>\n]+->\s*[A-Z_]+\s*->\s*[^\n]+$') AND length(text) <= 300 THEN 'relation' WHEN {_STUB} THEN 'stub' ELSE 'content' END"
_NOISY = """WITH r AS (SELECT conv_id AS query_id, turn AS node_id, role AS retriever, CAST(CASE WHEN turn % 5 <> 4 THEN turn % 4 - 1 END AS DOUBLE) AS score,
 CASE conv_id % 5 WHEN 0 THEN ' Query: MATCH ' || text WHEN 1 THEN 'Ann -> KNOWS -> ' || role WHEN 2 THEN role WHEN 3 THEN '  ' ELSE text END AS text FROM conversations WHERE text IS NOT NULL)"""


def _noisy(spark: SparkSession, d: str) -> DataFrame:
    """The conversations as results of every kind and score."""
    c, m = table(spark, d, "conversations").where("text is not null"), F.col("conv_id") % 5
    text = F.when(m == 0, F.concat(F.lit(" Query: MATCH "), "text")).when(m == 1, F.concat(F.lit("Ann -> KNOWS -> "), "role")).when(m == 2, F.col("role")).when(m == 3, F.lit("  ")).otherwise(F.col("text"))
    score = F.when(F.col("turn") % 5 != 4, F.col("turn") % 4 - 1).cast("double")
    return c.select(F.col("conv_id").alias("query_id"), F.col("turn").alias("node_id"), F.col("role").alias("retriever"), score.alias("score"), text.alias("text"))


@query(_NOISY + f" SELECT query_id, node_id, score, {_KIND} AS kind FROM r WHERE score >= 0 AND kind <> 'blank'")
def result_noise_filters(spark: SparkSession, d: str) -> DataFrame:
    return fusion.noise_kinds(_noisy(spark, d)).select("query_id", "node_id", "score", "kind")


@query(_NOISY + rf""", k AS (SELECT query_id, node_id, score, CASE WHEN {_KIND} <> 'content' THEN 0 WHEN score > 0 THEN 2 ELSE 1 END AS rank FROM r WHERE NOT regexp_matches(text, '^[ \t\n\x0B\f\r]*$'))
SELECT query_id, node_id, score FROM k QUALIFY rank = max(rank) OVER (PARTITION BY query_id)""")
def graph_result_filter(spark: SparkSession, d: str) -> DataFrame:
    return fusion.graph_results(_noisy(spark, d)).select("query_id", "node_id", "score")


@query(_NOISY + f""", k AS (SELECT retriever, query_id, node_id, {_KIND} AS kind FROM r)
SELECT * FROM k WHERE kind <> 'blank' QUALIFY kind = 'content' OR NOT bool_or(kind = 'content') OVER (PARTITION BY query_id, retriever)""")
def retriever_noise_filter(spark: SparkSession, d: str) -> DataFrame:
    return fusion.without_noise(_noisy(spark, d)).select("retriever", "query_id", "node_id", "kind")


_STRIP = r"regexp_replace({0}, '^[ \t\n\x0B\f\r]+|[ \t\n\x0B\f\r]+\z', '', 'g')"


@query("SELECT conv_id, turn, " + _STRIP.format("regexp_replace(" + _STRIP.format("regexp_replace(" + _STRIP.format("CASE turn % 3 WHEN 0 THEN ' Summary: ' || text WHEN 1 THEN 'The FACTS show:' || text || ' End of Text ' ELSE text END") + f", '{T.OPENING}', '')") + f", '{T.CLOSING}', '')") + " AS core FROM conversations")
def core_content(spark: SparkSession, d: str) -> DataFrame:
    m = F.col("turn") % 3
    text = F.when(m == 0, F.concat(F.lit(" Summary: "), "text")).when(m == 1, F.concat(F.lit("The FACTS show:"), "text", F.lit(" End of Text "))).otherwise(F.col("text"))
    return table(spark, d, "conversations").select("conv_id", "turn", T.core_content(text).alias("core"))


@query("WITH s AS (SELECT doc_id AS node_id, 0.9 + (doc_id % 40) / 1000.0::DOUBLE AS score FROM documents)" + _RANK)
def flat_rescore(spark: SparkSession, d: str) -> DataFrame:
    return fusion.ranked(table(spark, d, "documents").select(F.col("doc_id").alias("node_id"), (0.9 + (F.col("doc_id") % 40) / 1000.0).alias("score")), 10)


@query()
def greedy_result_dedup(spark: SparkSession, d: str) -> DataFrame:
    docs = table(spark, d, "documents").select(F.col("doc_id").alias("node_id"), "text", "source")
    return fusion.greedy_dedup(_vectors_each(spark, d, "cosine", 15).join(docs, "node_id"))


@query("""SELECT conv_id, sha256(string_agg(text, '' ORDER BY turn, text)) AS fingerprint FROM conversations WHERE text IS NOT NULL GROUP BY conv_id""")
def content_fingerprint(spark: SparkSession, d: str) -> DataFrame:
    turns = F.array_sort(F.collect_list(F.struct("turn", "text")))
    c = table(spark, d, "conversations").where("text is not null").groupBy("conv_id").agg(turns.alias("t"))
    return c.select("conv_id", F.sha2(F.array_join(F.transform("t", lambda x: x["text"]), ""), 256).alias("fingerprint"))


@query()
def chunk_separator(spark: SparkSession, d: str) -> DataFrame:
    return chunking.chunks(table(spark, d, "documents"))


@query(r"""SELECT doc_id, CAST(i - 1 AS INTEGER) AS section, p[i] AS text FROM (SELECT doc_id, string_split_regex(text, '\.\n') AS p FROM documents WHERE text IS NOT NULL), unnest(range(1, len(p) + 1)) AS u(i) WHERE trim(p[i]) <> ''""")
def heading_split(spark: SparkSession, d: str) -> DataFrame:
    return chunking.sections(table(spark, d, "documents"), r"\.\n")


@query(r"""SELECT doc_id, source, text FROM (SELECT page_id AS doc_id, url AS source, trim(regexp_replace(replace(replace(replace(replace(replace(replace(replace(replace(
 regexp_replace(regexp_replace(html, '(?is)<script.*?</script>|<style.*?</style>|<!--.*?-->', ' ', 'g'), '<[A-Za-z/!?](?:[^<>"''=]|=\s*"[^"]*"|=\s*''[^'']*''|["''=])*>', ' ', 'g'),
 '&lt;', '<'), '&gt;', '>'), '&quot;', '"'), '&#39;', ''''), '&nbsp;', ' '), '&copy;', '©'), '&middot;', '·'), '&amp;', '&'), '[ \t\r\n]+', ' ', 'g')) AS text FROM pages) WHERE text <> ''""")
def web_pages(spark: SparkSession, d: str) -> DataFrame:
    return web_documents(table(spark, d, "pages"))


@query(r"""WITH l AS (SELECT p_partkey, regexp_replace(regexp_replace(trim(p_type), '[^A-Za-z0-9_]', '_', 'g'), '_+', '_', 'g') AS l,
 regexp_replace(regexp_replace(lower(trim(p_name)), '[^a-z0-9_]+', '_', 'g'), '^_+|_+$', '', 'g') AS s FROM part)
SELECT p_partkey, CASE WHEN l = '' THEN 'Entity' WHEN regexp_matches(l, '^[0-9]') THEN '_' || l ELSE l END AS label,
 upper(CASE WHEN l = '' THEN 'RELATED_TO' WHEN regexp_matches(l, '^[0-9]') THEN '_' || l ELSE l END) AS rel, CASE WHEN s = '' THEN 'entity' ELSE s END AS slug FROM l""")
def sanitized_names(spark: SparkSession, d: str) -> DataFrame:
    p = table(spark, d, "part")
    return p.select("p_partkey", T.label(F.col("p_type")).alias("label"), T.relation_type(F.col("p_type")).alias("rel"), T.slug(F.col("p_name")).alias("slug"))


@query(r"""WITH n AS (SELECT trim(regexp_replace(lower(p_type), '[^a-z0-9]+', ' ', 'g')) AS key, trim(p_type) AS name FROM part), c AS (SELECT key, name, count(*) AS t FROM n WHERE key <> '' GROUP BY ALL)
SELECT key, name AS canonical, spellings FROM (SELECT *, row_number() OVER (PARTITION BY key ORDER BY t DESC, length(regexp_replace(name, '[\p{L}\p{N}\s]', '', 'g')) + length(name) - length(trim(regexp_replace(name, '\s+', ' ', 'g'))), length(name) DESC, name) AS r, count(*) OVER (PARTITION BY key) AS spellings FROM c) WHERE r = 1""")
def canonical_names(spark: SparkSession, d: str) -> DataFrame:
    return graph.canonical_names(table(spark, d, "part").select(T.normalized_key(F.col("p_type")).alias("key"), F.col("p_type").alias("name")))


@query(r"""SELECT doc_id, trim(regexp_replace(strip_accents(lower(left(text, 60))), '[^a-z0-9]+', ' ', 'g')) AS key FROM documents""")
def normalized_keys(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "documents").select("doc_id", T.normalized_key(F.left("text", F.lit(60))).alias("key"))


@query(_NOISY + f""", k AS (SELECT query_id, node_id, retriever, score, {_KIND} AS kind FROM r)
SELECT query_id, node_id, retriever, score FROM k WHERE score >= 0 AND (kind = 'content' OR kind = 'step' AND retriever = 'assistant')""")
def result_content_filter(spark: SparkSession, d: str) -> DataFrame:
    return fusion.content_only(_noisy(spark, d), steps_of=["assistant"]).select("query_id", "node_id", "retriever", "score")


@query(r"""SELECT page_id, CASE WHEN s IN ('', '.', '..') THEN NULL ELSE s END AS file_name FROM (SELECT page_id, trim(regexp_replace(regexp_extract(url, '([^/\\]*)$', 1), '^[A-Za-z]:', '')) AS s FROM pages)""")
def safe_filenames(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "pages").select("page_id", T.safe_filename(F.col("url")).alias("file_name"))


def _triples(spark: SparkSession, d: str) -> DataFrame:
    return graph.relational_triples(*(table(spark, d, n) for n in ("customer", "orders", "nation", "region")))


_T = """WITH t AS (SELECT 'Customer:' || c_custkey AS subject, 'Customer' AS subject_type, 'located in' AS predicate, 'Nation:' || c_nationkey AS obj, 'Nation' AS obj_type FROM customer
 UNION ALL SELECT 'Nation:' || n_nationkey, 'Nation', 'part of', 'Region:' || n_regionkey, 'Region' FROM nation
 UNION ALL SELECT 'Customer:' || o_custkey, 'Customer', 'placed', 'Order:' || o_orderkey, 'Order' FROM orders)"""
_E = _T + ", e AS (SELECT DISTINCT subject AS source, upper(replace(predicate, ' ', '_')) AS label, obj AS target FROM t)"
_N = _T + ", n AS (SELECT name, min(type) AS type FROM (SELECT subject AS name, subject_type AS type FROM t UNION ALL SELECT obj, obj_type FROM t) GROUP BY name)"


@query(r"""SELECT conv_id, turn, CASE WHEN s = '' THEN 'unknown' ELSE s END AS id FROM (SELECT conv_id, turn,
 trim(regexp_replace(translate(regexp_replace(coalesce(text, ''), '[\x00-\x1f\x7f]', '', 'g'), '/#?', ''), '\s+', ' ', 'g')) AS s FROM conversations)""")
def sanitized_node_ids(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "conversations").select("conv_id", "turn", T.node_id(F.col("text"), "/#?").alias("id"))


@query(r"""WITH k AS (SELECT trim(regexp_replace(p_type || ' ' || p_brand, '\s+', ' ', 'g')) AS name, trim(regexp_replace(lower(p_type || ' ' || p_brand), '[^a-z0-9]+', ' ', 'g')) AS key FROM part)
SELECT trim(regexp_replace(lower(split_part(name, ' ', 1)), '[^a-z0-9]+', ' ', 'g')) AS first, count(DISTINCT key) AS full_names FROM k WHERE contains(name, ' ') GROUP BY 1 HAVING count(DISTINCT key) > 1""")
def ambiguous_first_names(spark: SparkSession, d: str) -> DataFrame:
    return graph.ambiguous_first_names(table(spark, d, "part").select(F.concat_ws(" ", "p_type", "p_brand").alias("name")))


@query(_T + " SELECT * FROM t")
def kg_triples(spark: SparkSession, d: str) -> DataFrame:
    return _triples(spark, d)


@query(_N + " SELECT * FROM n")
def kg_nodes(spark: SparkSession, d: str) -> DataFrame:
    return graph.nodes(_triples(spark, d))


@query(_E + " SELECT * FROM e")
def kg_edges(spark: SparkSession, d: str) -> DataFrame:
    return graph.edges(_triples(spark, d))


@query(_E + " SELECT name, CAST(sum(o) AS BIGINT) AS outgoing, CAST(sum(i) AS BIGINT) AS incoming FROM (SELECT source AS name, 1 AS o, 0 AS i FROM e UNION ALL SELECT target, 0, 1 FROM e) GROUP BY name")
def entity_degree(spark: SparkSession, d: str) -> DataFrame:
    return graph.degrees(graph.edges(_triples(spark, d)))


@query(_T + " SELECT subject, subject_type, predicate, obj, obj_type FROM t WHERE (subject_type, predicate, obj_type) IN (VALUES ('Customer', 'placed', 'Order'), ('Nation', 'part of', 'Region'))")
def kg_schema_validate(spark: SparkSession, d: str) -> DataFrame:
    schema = spark.createDataFrame([("Customer", "placed", "Order"), ("Nation", "part of", "Region")], "subject_type string, predicate string, obj_type string")
    return graph.valid(_triples(spark, d), F.broadcast(schema))


@query(_E + """, b AS (SELECT source AS a, target AS b FROM e UNION ALL SELECT target, source FROM e), h1 AS (SELECT DISTINCT b AS name FROM b WHERE a = 'Region:0'),
 h2 AS (SELECT DISTINCT b.b AS name FROM b JOIN h1 ON b.a = h1.name)
SELECT 'Region:0' AS name, 0 AS hop UNION ALL SELECT name, 1 FROM h1 WHERE name <> 'Region:0'
UNION ALL SELECT name, 2 FROM h2 WHERE name <> 'Region:0' AND name NOT IN (SELECT name FROM h1)""")
def khop_neighborhood(spark: SparkSession, d: str) -> DataFrame:
    return graph.neighbourhood(graph.edges(_triples(spark, d)), table(spark, d, "region").where("r_regionkey = 0").select(F.concat(F.lit("Region:"), F.col("r_regionkey").cast("string")).alias("name")))


_SLUG = r"regexp_replace(regexp_replace(lower(trim({0})), '[^a-z0-9_]+', '_', 'g'), '^_+|_+$', '', 'g')"
_RDF = _N + f""", rdf AS (SELECT DISTINCT * FROM (SELECT '{graph.BASE}' || {_SLUG.format('name')} AS s, 'rdf:type' AS p, '{graph.ONTOLOGY}' || type AS o, true AS is_iri FROM n
 UNION ALL SELECT '{graph.BASE}' || {_SLUG.format('name')}, 'rdfs:label', name, false FROM n
 UNION ALL SELECT '{graph.BASE}' || {_SLUG.format('subject')}, '{graph.ONTOLOGY}' || {_SLUG.format('predicate')}, '{graph.BASE}' || {_SLUG.format('obj')}, true FROM t))"""


@query(_RDF + " SELECT * FROM rdf")
def kg_to_rdf(spark: SparkSession, d: str) -> DataFrame:
    return graph.to_rdf(_triples(spark, d))


@query(_RDF + f""" SELECT a.s AS customer, b.o AS region, c.o AS name FROM rdf a JOIN rdf b ON a.o = b.s AND b.p = '{graph.ONTOLOGY}part_of' JOIN rdf c ON c.s = a.s AND c.p = 'rdfs:label'
WHERE a.p = '{graph.ONTOLOGY}located_in'""")
def bgp_join(spark: SparkSession, d: str) -> DataFrame:
    rdf = graph.to_rdf(_triples(spark, d))
    found = graph.match(rdf, [("?customer", graph.ONTOLOGY + "located_in", "?n"), ("?n", graph.ONTOLOGY + "part_of", "?region"), ("?customer", "rdfs:label", "?name")])
    return found.select("customer", "region", "name")


def _snapshots(spark: SparkSession, d: str) -> tuple[DataFrame, DataFrame]:
    docs = table(spark, d, "documents").select("doc_id", "text")
    old = docs.where("doc_id % 7 <> 0").select("doc_id", sync.content_hash().alias("content_hash"), (F.col("doc_id") * 10).alias("ordinal"), F.concat(F.lit("s"), F.col("doc_id") % 5).alias("source_id"))
    new = docs.where("doc_id % 5 <> 0").withColumn("text", F.when(F.col("doc_id") % 3 == 0, F.concat(F.coalesce("text", F.lit("")), F.lit("+"))).otherwise(F.col("text")))
    new = new.select("doc_id", sync.content_hash().alias("content_hash"), (F.col("doc_id") * 10 + F.col("doc_id") % 4 - 1).alias("ordinal"), F.when(F.col("doc_id") % 2 == 0, F.lit("x")).alias("source_id"))
    return old, new


_SNAP = """WITH o AS (SELECT doc_id, sha256(coalesce(text, '')) AS content_hash, doc_id * 10 AS ordinal, 's' || (doc_id % 5) AS source_id FROM documents WHERE doc_id % 7 <> 0),
 w AS (SELECT doc_id, sha256(coalesce(text, '') || CASE WHEN doc_id % 3 = 0 THEN '+' ELSE '' END) AS content_hash, doc_id * 10 + doc_id % 4 - 1 AS ordinal,
  CASE WHEN doc_id % 2 = 0 THEN 'x' END AS source_id FROM documents WHERE doc_id % 5 <> 0)"""


@query(_SNAP + " SELECT coalesce(o.doc_id, w.doc_id) AS doc_id, CASE WHEN o.doc_id IS NULL THEN 'insert' WHEN w.doc_id IS NULL THEN 'delete' WHEN o.content_hash <> w.content_hash THEN 'update' ELSE 'none' END AS action FROM o FULL JOIN w ON o.doc_id = w.doc_id")
def snapshot_diff(spark: SparkSession, d: str) -> DataFrame:
    old, new = _snapshots(spark, d)
    return sync.snapshot_diff(old.select("doc_id", "content_hash"), new.select("doc_id", "content_hash"))


@query(_SNAP + """, r AS (SELECT w.doc_id, CASE WHEN o.doc_id IS NULL THEN 'new' WHEN w.ordinal < o.ordinal THEN 'older' WHEN w.ordinal = o.ordinal THEN 'same ordinal'
 WHEN o.doc_id % 4 = 3 AND o.doc_id % 3 = 0 AND o.doc_id % 9 <> 0 THEN 'just synced' WHEN o.doc_id % 4 >= 2 AND o.doc_id % 3 = 0 THEN 'no hash yet'
 WHEN w.content_hash = o.content_hash THEN 'same content' ELSE 'changed' END AS reason FROM w LEFT JOIN o ON o.doc_id = w.doc_id) SELECT doc_id, reason IN ('new', 'no hash yet', 'changed') AS process, reason FROM r""")
def should_process(spark: SparkSession, d: str) -> DataFrame:
    old, new = _snapshots(spark, d)
    now, i = F.lit("2026-01-01 00:00:00").cast("timestamp"), F.col("doc_id")
    minutes = F.when(i % 9 != 0, F.when(i % 4 == 3, 1).otherwise(10))  # the others were never synced
    bulk = (i % 4 >= 2) & (i % 3 == 0)
    old = old.withColumn("content_hash", F.when(~bulk, F.col("content_hash"))).withColumn("vector_synced_at", now - F.make_dt_interval(F.lit(0), F.lit(0), minutes))
    return sync.should_process(new, old, now)


@query(_SNAP + """ SELECT coalesce(o.doc_id, w.doc_id) AS doc_id, coalesce(w.source_id, o.source_id) AS source_id, coalesce(w.content_hash, o.content_hash) AS content_hash,
 coalesce(w.ordinal, o.ordinal) AS ordinal FROM o FULL JOIN w ON o.doc_id = w.doc_id""")
def upsert_state(spark: SparkSession, d: str) -> DataFrame:
    return sync.upsert(*_snapshots(spark, d))


@query(_SNAP + " SELECT * FROM w UNION ALL SELECT * FROM o WHERE doc_id NOT IN (SELECT doc_id FROM w)")
def replace_by_doc(spark: SparkSession, d: str) -> DataFrame:
    return sync.replace_by_document(*_snapshots(spark, d))


def _state(spark: SparkSession, d: str) -> DataFrame:
    labels = table(spark, d, "labels").select("doc_id", "quality")
    docs = table(spark, d, "documents").select("doc_id", F.col("source").alias("source_id"), "lang")
    return docs.join(labels, "doc_id", "left").select("doc_id", "source_id", (F.col("doc_id") % 10 != 0).alias("vector_synced"), F.col("quality").isNotNull().alias("search_synced"), (F.coalesce("lang", F.lit("")) == "en").alias("graph_synced"))


_STATE = """WITH s AS (SELECT doc_id, source AS source_id, doc_id % 10 <> 0 AS v, quality IS NOT NULL AS q, coalesce(lang, '') = 'en' AS g FROM documents LEFT JOIN labels USING (doc_id))"""


@query(_STATE + """ SELECT source_id, count(*) AS documents, count(*) FILTER (WHERE v) AS vector, count(*) FILTER (WHERE q) AS search, count(*) FILTER (WHERE g) AS graph,
 round(100.0 * count(*) FILTER (WHERE v AND q AND g) / count(*), 2) AS complete_pct FROM s GROUP BY source_id""")
def sync_stats(spark: SparkSession, d: str) -> DataFrame:
    return sync.sync_stats(_state(spark, d))


@query(_STATE + " SELECT doc_id, CASE WHEN NOT v THEN 'vector' WHEN NOT q THEN 'search' WHEN NOT g THEN 'graph' ELSE 'Complete' END AS gap FROM s")
def sync_gap_status(spark: SparkSession, d: str) -> DataFrame:
    return sync.sync_gap(_state(spark, d))


@query("""SELECT doc_id, sha256(text) AS content_hash, min(doc_id) OVER w AS first, count(*) OVER w AS n FROM documents WHERE text IS NOT NULL WINDOW w AS (PARTITION BY text) QUALIFY n > 1""")
def duplicate_contents(spark: SparkSession, d: str) -> DataFrame:
    return sync.duplicates(table(spark, d, "documents"))


@query("SELECT source AS config_id, count(*) AS documents, count(quality) AS with_source_id, round(100.0 * count(quality) / count(*), 2) AS cloud_pct FROM documents LEFT JOIN labels USING (doc_id) GROUP BY 1")
def cloud_source_pct(spark: SparkSession, d: str) -> DataFrame:
    labels = table(spark, d, "labels").select("doc_id", F.col("quality").cast("string").alias("source_id"))
    return sync.source_share(table(spark, d, "documents").select("doc_id", F.col("source").alias("config_id")).join(labels, "doc_id", "left"))


@query(_SNAP + " SELECT CASE WHEN o.doc_id IS NULL THEN 'insert' WHEN w.doc_id IS NULL THEN 'delete' WHEN o.content_hash <> w.content_hash THEN 'update' ELSE 'none' END AS action, count(*) AS n FROM o FULL JOIN w ON o.doc_id = w.doc_id GROUP BY 1")
def update_statistics(spark: SparkSession, d: str) -> DataFrame:
    return snapshot_diff(spark, d).groupBy("action").agg(F.count("*").alias("n"))


def _events(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "events").select("event_id", "ts", F.col("event_type").alias("kind"), "value", F.col("user_id").cast("string").alias("path"))


@query("""WITH e AS (SELECT event_id, ts, CASE WHEN event_type = 'signup' THEN 'CREATE' ELSE 'UPDATE' END AS kind, CAST(user_id AS VARCHAR) AS path, epoch_us(ts) AS us FROM events),
 m AS (SELECT *, last_value(CASE WHEN kind = 'CREATE' THEN us END IGNORE NULLS) OVER (PARTITION BY path ORDER BY ts, event_id ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS made FROM e)
SELECT event_id, ts, kind, path FROM m WHERE kind <> 'UPDATE' OR made IS NULL OR us - made >= 3600000000""")
def burst_debounce(spark: SparkSession, d: str) -> DataFrame:
    kind = F.when(F.col("kind") == "signup", "CREATE").otherwise("UPDATE")
    return sync.burst_collapse(_events(spark, d).select("event_id", "ts", kind.alias("kind"), "path"), 3600)


@query("SELECT event_id, CAST(json_extract_string(props, '$.k') AS BIGINT) AS k FROM events")
def json_config_extract(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "events").select("event_id", F.get_json_object("props", "$.k").cast("long").alias("k"))


@query("SELECT time_bucket(INTERVAL 5 MINUTE, ts) AS start, event_type AS kind, count(*) AS n, round(sum(value), 4) AS total FROM events GROUP BY 1, 2")
def events_5m_rate(spark: SparkSession, d: str) -> DataFrame:
    return metrics.window_rates(_events(spark, d))


@query("SELECT event_type AS kind, round(quantile_cont(value, 0.5), 6) AS p50, round(quantile_cont(value, 0.95), 6) AS p95 FROM events GROUP BY 1")
def latency_percentiles(spark: SparkSession, d: str) -> DataFrame:
    return metrics.percentiles(_events(spark, d))


@query("SELECT event_type AS kind, le, count(*) FILTER (WHERE value <= le) AS n FROM events, (VALUES (50), (100), (200), (500), (1000), (2000), (5000), (10000)) AS b(le) GROUP BY 1, 2")
def latency_histogram(spark: SparkSession, d: str) -> DataFrame:
    return metrics.histogram(_events(spark, d))


@query(_N + ", e AS (SELECT DISTINCT subject AS source, upper(replace(predicate, ' ', '_')) AS label, obj AS target FROM t) SELECT 'node' AS kind, type AS label, count(*) AS n FROM n GROUP BY type UNION ALL SELECT 'edge', label, count(*) FROM e GROUP BY label")
def kg_counts(spark: SparkSession, d: str) -> DataFrame:
    t = _triples(spark, d)
    return graph.counts(graph.nodes(t), graph.edges(t))


@query(_T + " SELECT subject_type, predicate, obj_type, count(*) AS n FROM t GROUP BY ALL")
def observed_schema(spark: SparkSession, d: str) -> DataFrame:
    return graph.observed_schema(_triples(spark, d))


def _statements(spark: SparkSession, d: str) -> DataFrame:
    """An ontology that the parts tell: classes by type, relations by brand, properties by size, each with what its parts give it."""
    p = table(spark, d, "part")
    base, size, key = "http://example.org/parts#", F.col("p_size"), F.col("p_partkey")
    name = lambda c: F.concat(F.lit(base), F.translate(F.col(c), " #", "__"))
    row = lambda s, verb, o, there=None: F.when(F.lit(True) if there is None else there, F.struct(s.alias("s"), F.lit(verb).alias("p"), o.alias("o")))
    kind, relation, prop = name("p_type"), name("p_brand"), F.concat(F.lit(base + "size_"), size.cast("string"))
    xsd = F.element_at(F.array(*[F.lit(ontology.XSD + t) for t in ("decimal", "integer", "boolean", "date", "string")]), (size % 5 + 1).cast("int"))
    all_ = [
        row(kind, ontology.RDF + "type", F.lit(ontology.OWL + "Class"), key % 7 == 0), row(kind, ontology.RDFS + "comment", F.col("p_name"), key % 3 == 0),
        row(relation, ontology.RDF + "type", F.lit(ontology.OWL + "ObjectProperty")), row(relation, ontology.RDFS + "domain", kind, key % 11 == 0), row(relation, ontology.RDFS + "range", kind, key % 13 == 0),
        row(prop, ontology.RDF + "type", F.lit(ontology.OWL + "DatatypeProperty")), row(prop, ontology.RDFS + "domain", kind, (key % 5 == 0) & (size % 2 == 0)), row(prop, ontology.RDFS + "domain", relation, (key % 5 == 0) & (size % 2 == 1)),
        row(prop, ontology.RDFS + "range", xsd, key % 4 == 1),
    ]
    return p.select(F.explode(F.array_compact(F.array(*all_))).alias("x")).select("x.*").distinct()


def _ontology_sql() -> str:
    name = lambda c: f"'http://example.org/parts#' || translate({c}, ' #', '__')"
    kind, relation, prop = name("p_type"), name("p_brand"), "'http://example.org/parts#size_' || p_size"
    xsd = f"'{ontology.XSD}' || ['decimal', 'integer', 'boolean', 'date', 'string'][p_size % 5 + 1]"
    rows = [
        (kind, ontology.RDF + "type", f"'{ontology.OWL}Class'", "p_partkey % 7 = 0"), (kind, ontology.RDFS + "comment", "p_name", "p_partkey % 3 = 0"), (relation, ontology.RDF + "type", f"'{ontology.OWL}ObjectProperty'", "true"),
        (relation, ontology.RDFS + "domain", kind, "p_partkey % 11 = 0"), (relation, ontology.RDFS + "range", kind, "p_partkey % 13 = 0"), (prop, ontology.RDF + "type", f"'{ontology.OWL}DatatypeProperty'", "true"),
        (prop, ontology.RDFS + "domain", kind, "p_partkey % 5 = 0 AND p_size % 2 = 0"), (prop, ontology.RDFS + "domain", relation, "p_partkey % 5 = 0 AND p_size % 2 = 1"), (prop, ontology.RDFS + "range", xsd, "p_partkey % 4 = 1"),
    ]
    every = " UNION ".join(f"SELECT {s} AS s, '{p}' AS p, {o} AS o FROM part WHERE {there}" for s, p, o, there in rows)
    local = lambda c: f"upper(regexp_extract({c}, '([^#/]*)$', 1))"
    return f"""WITH r AS ({every}), dom AS (SELECT s, o AS d FROM r WHERE p = '{ontology.RDFS}domain'), rng AS (SELECT s, o AS g FROM r WHERE p = '{ontology.RDFS}range'),
 cs AS (SELECT s, c.o AS description FROM r LEFT JOIN (SELECT s, o FROM r WHERE p = '{ontology.RDFS}comment') c USING (s) WHERE p = '{ontology.RDF}type' AND r.o = '{ontology.OWL}Class'),
 cl AS (SELECT {local('s')} AS name, min(s) AS uri, arg_min(description, (s, description)) AS description FROM cs GROUP BY 1),
 rel AS (SELECT DISTINCT {local('r.s')} AS name, r.s AS uri, x.name AS domain, y.name AS range FROM r LEFT JOIN dom ON dom.s = r.s LEFT JOIN rng ON rng.s = r.s LEFT JOIN cl x ON x.name = {local('d')}
  LEFT JOIN cl y ON y.name = {local('g')} WHERE p = '{ontology.RDF}type' AND o = '{ontology.OWL}ObjectProperty'),
 pr AS (SELECT DISTINCT coalesce(x.name, y.name) AS owner, CASE WHEN x.name IS NOT NULL THEN 'entity' WHEN y.name IS NOT NULL THEN 'relation' END AS owner_kind, {local('r.s')} AS name,
  CASE WHEN regexp_matches(g, 'decimal|float|double') THEN 'float' WHEN contains(g, 'int') THEN 'int' WHEN contains(g, 'boolean') THEN 'bool' WHEN contains(g, 'date') THEN 'str' ELSE 'string' END AS type,
  coalesce(g, '{ontology.XSD}string') AS datatype FROM r LEFT JOIN dom ON dom.s = r.s LEFT JOIN rng ON rng.s = r.s LEFT JOIN cl x ON x.name = {local('d')}
  LEFT JOIN (SELECT DISTINCT name FROM rel) y ON y.name = {local('d')} WHERE p = '{ontology.RDF}type' AND o = '{ontology.OWL}DatatypeProperty')"""


_ONTOLOGY = _ontology_sql()


@query(_ONTOLOGY + """ SELECT 'class' AS kind, name, uri, description AS a, NULL AS b FROM cl UNION ALL SELECT 'relation', name, uri, domain, range FROM rel
 UNION ALL SELECT 'property', name, owner, owner_kind, type FROM pr""")
def ontology_schema(spark: SparkSession, d: str) -> DataFrame:
    """Classes with their comments, relations with domain and range, properties with their owners and types."""
    rdf = staged(_statements(spark, d), "statements")
    rows = ontology.classes(rdf).select(F.lit("class").alias("kind"), "name", "uri", F.col("description").alias("a"), F.lit(None).cast("string").alias("b"))
    rows = rows.unionByName(ontology.relations(rdf).select(F.lit("relation").alias("kind"), "name", "uri", F.col("domain").alias("a"), F.col("range").alias("b")))
    return rows.unionByName(ontology.properties(rdf).select(F.lit("property").alias("kind"), "name", F.col("owner").alias("uri"), F.col("owner_kind").alias("a"), F.col("type").alias("b")))


@query(_ONTOLOGY + """ SELECT domain AS subject_type, name AS predicate, range AS obj_type FROM rel WHERE domain IS NOT NULL AND range IS NOT NULL
 UNION SELECT domain, rel.name, cl.name FROM rel, cl WHERE domain IS NOT NULL AND range IS NULL""")
def validation_schema(spark: SparkSession, d: str) -> DataFrame:
    return ontology.validation_schema(staged(_statements(spark, d), "statements"))


@query(_ONTOLOGY + f""", t AS (SELECT name, min(datatype) AS datatype FROM pr GROUP BY 1)
SELECT 'Part:' || p_partkey AS s, 'size_' || p_size AS prop, p_brand AS value, coalesce(datatype, '{ontology.XSD}string') AS datatype FROM part LEFT JOIN t ON name = upper('size_' || p_size)""")
def xsd_type_map(spark: SparkSession, d: str) -> DataFrame:
    """Properties of parts as literals of the datatypes that the ontology declares."""
    values = table(spark, d, "part").select(F.concat(F.lit("Part:"), F.col("p_partkey").cast("string")).alias("s"), F.concat(F.lit("size_"), F.col("p_size").cast("string")).alias("prop"), F.col("p_brand").alias("value"))
    return ontology.typed_literals(values, ontology.xsd_types(staged(_statements(spark, d), "statements")))


@query(_E + """, b AS (SELECT source AS node, 'out' AS direction, label, target AS other FROM e UNION ALL SELECT target, 'in', label, source FROM e)
SELECT * FROM b WHERE contains(lower(node), 'nation:1') AND label IN ('LOCATED_IN', 'PART_OF')""")
def entity_onehop_inout(spark: SparkSession, d: str) -> DataFrame:
    return graph.one_hop(graph.edges(_triples(spark, d)), "NATION:1", ["LOCATED_IN", "PART_OF"])


def _own_triples(spark: SparkSession, d: str) -> DataFrame:
    """The triples, each of its subject's document."""
    return _triples(spark, d).withColumn("doc_id", F.col("subject"))


_M = _N + ", m AS (SELECT subject AS doc_id, subject AS name FROM t UNION SELECT subject, obj FROM t)"
_LEFT = _M + ", gone AS (SELECT 'Customer:' || c_custkey AS doc_id FROM customer WHERE c_acctbal < 0), l AS (SELECT name, type FROM n WHERE name IN (SELECT name FROM m WHERE doc_id NOT IN (SELECT doc_id FROM gone)))"


def _gone(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "customer").where("c_acctbal < 0").select(F.concat(F.lit("Customer:"), F.col("c_custkey").cast("string")).alias("doc_id"))


def _nodes_left(spark: SparkSession, d: str) -> DataFrame:
    t = _own_triples(spark, d)
    return graph.without_documents(graph.nodes(t), graph.mentions(t), _gone(spark, d))


@query(_M + " SELECT * FROM m")
def kg_mentions(spark: SparkSession, d: str) -> DataFrame:
    return graph.mentions(_own_triples(spark, d))


@query(_LEFT + " SELECT * FROM l")
def cascade_delete(spark: SparkSession, d: str) -> DataFrame:
    return _nodes_left(spark, d)


@query(_LEFT + ", e AS (SELECT DISTINCT subject AS source, upper(replace(predicate, ' ', '_')) AS label, obj AS target FROM t) SELECT * FROM e WHERE source IN (SELECT name FROM l) AND target IN (SELECT name FROM l)")
def dangling_edge_sweep(spark: SparkSession, d: str) -> DataFrame:
    return graph.without_dangling(graph.edges(_triples(spark, d)), staged(_nodes_left(spark, d), "nodes"))


@query(r"""WITH p AS (SELECT p_partkey, CASE WHEN p_partkey % 3 = 0 THEN lower(p_type) ELSE p_type END AS name FROM part), k AS (SELECT trim(regexp_replace(lower(name), '[^a-z0-9]+', ' ', 'g')) AS key, name, count(*) AS t FROM p GROUP BY ALL),
 c AS (SELECT key, arg_max(name, (t, length(name))) AS canonical FROM k GROUP BY key) SELECT 'Part:' || p_partkey AS subject, 'of type' AS predicate, canonical AS obj FROM p JOIN c ON c.key = trim(regexp_replace(lower(name), '[^a-z0-9]+', ' ', 'g'))""")
def resolved_endpoints(spark: SparkSession, d: str) -> DataFrame:
    name = F.when(F.col("p_partkey") % 3 == 0, F.lower("p_type")).otherwise(F.col("p_type"))
    t = table(spark, d, "part").select(F.concat(F.lit("Part:"), F.col("p_partkey").cast("string")).alias("subject"), F.lit("of type").alias("predicate"), name.alias("obj"))
    names = t.select(T.normalized_key(F.col("obj")).alias("key"), F.col("obj").alias("name"))
    to = names.distinct().join(graph.canonical_names(names), "key").select("name", "canonical")
    return graph.rewritten(t, to).select("subject", "predicate", "obj")


@query(_RDF + f""" SELECT a.s AS x, a.o AS place, b.o AS bought FROM rdf a LEFT JOIN rdf b ON b.s = a.s AND b.p = '{graph.ONTOLOGY}placed'
WHERE a.p IN ('{graph.ONTOLOGY}located_in', '{graph.ONTOLOGY}part_of') AND NOT contains(a.o, 'region_0')""")
def bgp_optional_union(spark: SparkSession, d: str) -> DataFrame:
    rdf = graph.to_rdf(_triples(spark, d))
    there = graph.either(graph.match(rdf, [("?x", graph.ONTOLOGY + "located_in", "?place")]), graph.match(rdf, [("?x", graph.ONTOLOGY + "part_of", "?place")]))
    return graph.optional(there.where(~F.contains("place", F.lit("region_0"))), graph.match(rdf, [("?x", graph.ONTOLOGY + "placed", "?bought")]))


@query(_RDF + r""" SELECT 0 AS section, unnest(['@prefix rdf: <http://www.w3.org/1999/02/22-rdf-syntax-ns#> .', '@prefix rdfs: <http://www.w3.org/2000/01/rdf-schema#> .',
 '@prefix owl: <http://www.w3.org/2002/07/owl#> .', '@prefix xsd: <http://www.w3.org/2001/XMLSchema#> .']) AS line
 UNION ALL SELECT 1, '<' || s || '> ' || CASE WHEN regexp_matches(p, '^(rdf|rdfs|owl|xsd):') THEN p ELSE '<' || p || '>' END || ' ' ||
 CASE WHEN is_iri THEN '<' || o || '>' ELSE '"' || replace(replace(o, '\', '\\'), '"', '\"') || '"' END || ' .' FROM rdf
 UNION ALL SELECT 1, '<' || 'urn:order:' || o_orderkey || '> <http://example.org/ontology#total> "' || CAST(o_totalprice AS DECIMAL(18, 2)) || '"^^xsd:decimal .' FROM orders""")
def turtle_lines(spark: SparkSession, d: str) -> DataFrame:
    rdf = graph.to_rdf(_triples(spark, d)).withColumn("datatype", F.lit(None).cast("string"))
    prices = table(spark, d, "orders").select(
        F.concat(F.lit("urn:order:"), F.col("o_orderkey").cast("string")).alias("s"), F.lit(graph.ONTOLOGY + "total").alias("p"), F.col("o_totalprice").cast("decimal(18,2)").cast("string").alias("o"),
        F.lit(False).alias("is_iri"), F.lit("xsd:decimal").alias("datatype"),
    )
    return graph.turtle(rdf.unionByName(prices))


@query("""SELECT 'Customer:' || o_custkey AS subject, 'placed' AS predicate, 'Order:' || o_orderkey AS obj, unnest(['o_orderkey', 'o_orderstatus', 'o_orderpriority']) AS prop,
 unnest([CAST(o_orderkey AS VARCHAR), o_orderstatus, o_orderpriority]) AS value, unnest(['xsd:integer', 'xsd:string', 'xsd:string']) AS datatype FROM orders""")
def rdf_flat_annotations(spark: SparkSession, d: str) -> DataFrame:
    named = lambda c, n: F.concat(F.lit(n), F.col(c).cast("string"))
    t = table(spark, d, "orders").select("*", named("o_custkey", "Customer:").alias("subject"), F.lit("placed").alias("predicate"), named("o_orderkey", "Order:").alias("obj"))
    return graph.annotations(t, ["o_orderkey", "o_orderstatus", "o_orderpriority"])


@query(_RDF + f""", r AS (SELECT * FROM rdf UNION ALL SELECT '{graph.BASE}customer_' || c_custkey, '{graph.ONTOLOGY}ref_doc_id', CAST(c_nationkey AS VARCHAR), false FROM customer)
SELECT * FROM r WHERE NOT EXISTS (SELECT 1 FROM r x JOIN nation ON x.o = CAST(n_nationkey AS VARCHAR) WHERE x.s = r.s AND x.p = '{graph.ONTOLOGY}ref_doc_id' AND n_regionkey = 0)""")
def rdf_delete_doc(spark: SparkSession, d: str) -> DataFrame:
    refs = table(spark, d, "customer").select(F.concat(F.lit(graph.BASE + "customer_"), F.col("c_custkey").cast("string")).alias("s"), F.lit(graph.ONTOLOGY + "ref_doc_id").alias("p"), F.col("c_nationkey").cast("string").alias("o"), F.lit(False).alias("is_iri"))
    gone = table(spark, d, "nation").where("n_regionkey = 0").select(F.col("n_nationkey").alias("doc_id"))
    return graph.rdf_without_documents(staged(graph.to_rdf(_triples(spark, d)).unionByName(refs), "triples"), gone)


def spelled_names(spark: SparkSession, d: str) -> DataFrame:
    """(doc_id, name): the first three words of each text as a name, in several spellings."""
    front = F.regexp_extract("text", r"\p{L}++(?:\P{L}++\p{L}++){0,2}", 0)  # no more of the text is looked at
    words = F.regexp_extract_all(front, F.lit(r"\p{L}+"), F.lit(0))
    docs = table(spark, d, "documents").select("doc_id", F.array_join(words, " ").alias("name")).where("name <> ''")
    m, name = F.col("doc_id") % 5, F.col("name")
    spelled = F.when(m == 0, F.upper(name)).when(m == 1, F.concat(name, F.lit("."))).when(m == 2, F.concat(F.substring(name, F.lit(1), F.length(name) - 1))).when(m == 3, F.replace(name, F.lit(" "), F.lit("  "))).otherwise(name)
    return docs.select("doc_id", spelled.alias("name"))


@query()
def entity_resolution(spark: SparkSession, d: str) -> DataFrame:
    """Triples of documents and the names they start with, names in one spelling."""
    t = spelled_names(spark, d).select(F.col("doc_id").cast("string").alias("subject"), F.lit("Document").alias("subject_type"), F.lit("starts with").alias("predicate"), F.col("name").alias("obj"), F.lit("Name").alias("obj_type"))
    return resolution.resolve(t, ["Name"])


_SETS = """s AS (SELECT doc_id, list_sort(list_distinct(list_filter(string_split_regex(lower(text), '\\s+'), lambda w: w <> ''))) AS w FROM documents WHERE text IS NOT NULL),
 m AS (SELECT doc_id, min(doc_id) OVER (PARTITION BY w) AS class_id, w FROM s WHERE len(w) > 0), c AS (SELECT class_id, w, len(w) AS n FROM m WHERE doc_id = class_id),
 j AS (SELECT x.class_id AS a, y.class_id AS b, len(list_intersect(x.w, y.w)) AS shared, x.n + y.n - len(list_intersect(x.w, y.w)) AS total FROM c x JOIN c y ON x.class_id < y.class_id AND least(x.n, y.n) * 10 >= greatest(x.n, y.n) * {0}),
 p AS (SELECT * FROM j WHERE shared * 10 >= total * {0})"""


@query("WITH " + _SETS.format(6) + " SELECT a, b, CAST(shared AS INTEGER) AS shared, CAST(total AS INTEGER) AS total FROM p")
def near_dup_jaccard_pairs(spark: SparkSession, d: str) -> DataFrame:
    """Pairs of different sets of words that are similar, by the smallest document of each."""
    return similar.similar_classes(similar.word_classes(table(spark, d, "documents"))[0], 0.6)


@query("WITH " + _SETS.format(7) + """, k AS (SELECT class_id, count(*) AS members FROM m GROUP BY 1), l AS (SELECT a AS class_id, b AS other FROM p UNION ALL SELECT b, a FROM p),
 t AS (SELECT l.class_id, sum(members) AS links FROM l JOIN k ON k.class_id = l.other GROUP BY 1) SELECT doc_id, class_id, CAST(coalesce(links, 0) AS BIGINT) AS links FROM m LEFT JOIN t USING (class_id)""")
def near_dup_jaccard_links(spark: SparkSession, d: str) -> DataFrame:
    """For each document the class of its set of words, and how many documents have a similar one."""
    return similar.similar_texts(table(spark, d, "documents"), 0.7)


def _changes(spark: SparkSession, d: str) -> DataFrame:
    """The events as changes of documents, of which some are of no known kind."""
    e = table(spark, d, "events")
    kind = F.when(F.col("event_id") % 97 == 0, "oops").when(F.col("event_type") == "signup", "CREATE").when(F.col("event_type") == "error", "delete").otherwise("UPDATE")
    return e.select(
        "event_id", F.concat(F.lit("/u/"), F.col("user_id").cast("string")).alias("path"), kind.alias("kind"), F.col("ts").cast("timestamp").alias("ts"),
        F.concat_ws(":", "event_type", F.col("event_id").cast("string")).alias("content"), F.when(F.col("event_id") % 3 == 0, F.concat(F.lit("s"), (F.col("event_id") % 10).cast("string"))).alias("source_id"),
    )


@query("""WITH e AS (SELECT event_id, '/u/' || user_id AS path, CASE event_type WHEN 'signup' THEN 'CREATE' WHEN 'error' THEN 'DELETE' ELSE 'UPDATE' END AS kind, ts, event_type || ':' || event_id AS content,
  CASE WHEN event_id % 3 = 0 THEN 's' || event_id % 10 END AS source_id FROM events WHERE event_id % 97 <> 0 AND user_id IS NOT NULL AND ts IS NOT NULL),
 m AS (SELECT *, last_value(CASE WHEN kind = 'CREATE' THEN epoch_us(ts) END IGNORE NULLS) OVER (PARTITION BY path ORDER BY ts, event_id ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS made FROM e),
 k AS (SELECT * FROM m WHERE kind <> 'UPDATE' OR made IS NULL OR epoch_us(ts) - made >= 3600000000),
 l AS (SELECT path, arg_max(content, (ts, event_id)) AS content, arg_max(kind, (ts, event_id)) AS kind, arg_max(source_id, (ts, event_id)) FILTER (WHERE source_id IS NOT NULL) AS source_id FROM k GROUP BY path)
SELECT path, content, source_id FROM l WHERE kind <> 'DELETE'""")
def stream_replay_matches_batch(spark: SparkSession, d: str) -> DataFrame:
    """What a stream of changes leaves, taken in four batches by time, each of which comes twice."""
    e, folder = staged(_changes(spark, d), "changes"), shared_dir(spark, "stream")
    low, high = e.agg(F.unix_micros(F.min("ts")), F.unix_micros(F.max("ts"))).first()
    at = F.least(F.floor((F.unix_micros("ts") - F.lit(low or 0)) * 4 / ((high or 1) - (low or 0) + 1)), F.lit(3))
    for k in range(4):
        e.where(F.coalesce(at, F.lit(0)) == k).coalesce(1).write.mode("append").parquet(f"{folder}/in")
    kept = ChangeTable(spark, f"{folder}/table", 3600)
    kept.follow(spark.readStream.schema(e.schema).option("maxFilesPerTrigger", 1).parquet(f"{folder}/in"), f"{folder}/mark")
    for batch in kept.batches():
        kept.apply(e, batch)
    return kept.documents().drop("ts")


@query("""SELECT doc_id, version, content FROM (SELECT user_id AS doc_id, max(event_id) AS version, arg_max(event_type || ':' || value, event_id) AS content, arg_max(event_type, event_id) AS last
 FROM events WHERE user_id IS NOT NULL GROUP BY 1) WHERE last <> 'error'""")
def snapshot_then_deltas(spark: SparkSession, d: str) -> DataFrame:
    """The last event of each user, from a snapshot of the first half and later events that overlap it."""
    e = table(spark, d, "events").where("user_id is not null")
    rows = e.select(F.col("user_id").alias("doc_id"), F.col("event_id").alias("version"), F.concat_ws(":", "event_type", F.col("value").cast("string")).alias("content"), (F.col("event_type") == "error").alias("deleted"))
    cut = (rows.agg(F.max("version")).first()[0] or 0) // 2
    none = rows.limit(0).drop("deleted")
    return sync.snapshot_then_deltas(sync.snapshot_then_deltas(none, rows.where(F.col("version") <= cut)), rows.where(F.col("version") > cut // 2))


@query("""WITH s AS (SELECT doc_id, source || '/' || doc_id AS source_id, 's3://b/' || doc_id AS uri, '/' || lang || '/' || doc_id || '.TXT' AS path FROM documents),
 a AS (SELECT doc_id AS event_id, CASE doc_id % 5 WHEN 0 THEN 0 WHEN 1 THEN 1 WHEN 2 THEN 2 WHEN 3 THEN 3 END AS rank, doc_id FROM labels WHERE doc_id % 5 < 4)
SELECT event_id, s.doc_id, ['source_id', 'doc_id', 'uri', 'path'][rank + 1] AS by FROM a JOIN s USING (doc_id)""")
def delete_id_resolution(spark: SparkSession, d: str) -> DataFrame:
    """Which document each delete means, by the first id that is known of it."""
    i, text = F.col("doc_id"), F.col("doc_id").cast("string")
    docs = table(spark, d, "documents")
    state = docs.select("doc_id", F.concat_ws("/", "source", text).alias("source_id"), F.concat(F.lit("s3://b/"), text).alias("uri"), F.concat(F.lit("/"), "lang", F.lit("/"), text, F.lit(".TXT")).alias("path"))
    x = table(spark, d, "labels").select("doc_id").join(state, "doc_id").where(i % 5 < 4)
    # earlier ways name nothing that is there, later ones another document
    asked = x.select(
        i.alias("event_id"), F.when(i % 5 == 0, F.col("source_id")).otherwise("gone").alias("source_id"), F.when(i % 5 == 1, i).when(i % 5 == 0, i + 1).alias("doc_id"),
        F.when(i % 5 == 2, F.col("uri")).when(i % 5 < 2, "s3://b/0").alias("uri"), F.when(i % 5 == 3, F.lower("path")).alias("path"),
    )
    return sync.resolved_deletes(asked, state)


_BUCKETS = """b AS (SELECT event_type AS kind, le, count(*) FILTER (WHERE le IS NULL OR value <= le) AS n FROM events, (VALUES (50), (100), (200), (500), (1000), (2000), (5000), (10000), (NULL)) AS b(le) WHERE value IS NOT NULL GROUP BY 1, 2)"""


@query(f"""WITH {_BUCKETS}, w AS (SELECT *, coalesce(lag(n) OVER o, 0) AS below, coalesce(lag(le) OVER o, 0) AS start, 0.95 * max(n) OVER (PARTITION BY kind) AS wanted FROM b WINDOW o AS (PARTITION BY kind ORDER BY le NULLS LAST))
SELECT kind, round(CASE WHEN le IS NULL THEN start ELSE start + (le - start) * (wanted - below) / (n - below) END, 6) AS quantile FROM w WHERE n >= wanted QUALIFY row_number() OVER (PARTITION BY kind ORDER BY le NULLS LAST) = 1""")
def histogram_quantile(spark: SparkSession, d: str) -> DataFrame:
    """The 95th percentile of each kind of event, from its cumulative buckets."""
    e = _events(spark, d).where("value is not null")
    whole = e.groupBy("kind").agg(F.count("*").alias("n")).select("kind", F.lit(None).cast("int").alias("le"), "n")
    return metrics.bucket_quantile(metrics.histogram(e).unionByName(whole), 0.95, ["kind"])


_COUNTERS = "c AS (SELECT event_type AS series, ts, CAST(row_number() OVER (PARTITION BY event_type, date_trunc('hour', ts) - INTERVAL 1 HOUR * (hour(ts) % 6) ORDER BY ts, event_id) AS DOUBLE) AS value FROM events)"


def _counters(spark: SparkSession, d: str) -> DataFrame:
    """How many events of each kind there were, by a counter that begins anew every six hours."""
    six = F.window("ts", "6 hours")["start"]
    n = F.row_number().over(W.partitionBy("kind", six).orderBy("ts", "event_id"))
    return _events(spark, d).select(F.col("kind").alias("series"), "ts", n.cast("double").alias("value"))


@query(f"""WITH {_COUNTERS}, l AS (SELECT *, lag(value) OVER (PARTITION BY series ORDER BY ts, value) AS was FROM c)
SELECT series, date_trunc('day', ts) AS start, round(sum(CASE WHEN was IS NULL THEN 0 WHEN value >= was THEN value - was ELSE value END), 4) AS increase FROM l GROUP BY 1, 2""")
def counter_increase(spark: SparkSession, d: str) -> DataFrame:
    return metrics.increases(_counters(spark, d))


@query("SELECT event_type AS series, date_trunc('hour', ts) AS start, round(avg(value), 6) AS mean, count(*) AS n FROM events WHERE value IS NOT NULL GROUP BY 1, 2")
def value_mean_over_time(spark: SparkSession, d: str) -> DataFrame:
    return metrics.mean_over_time(_events(spark, d).select(F.col("kind").alias("series"), "ts", "value"))


@query("SELECT user_id AS path, round(CAST(count(*) FILTER (WHERE event_type = 'error') AS DOUBLE) / count(*), 6) AS ratio FROM events WHERE user_id IS NOT NULL GROUP BY 1")
def error_ratio(spark: SparkSession, d: str) -> DataFrame:
    """The share of errors among each user's events."""
    e = table(spark, d, "events").where("user_id is not null").select(F.col("user_id").alias("path"), "event_type")
    n = lambda df: df.groupBy("path").agg(F.count("*").alias("value"))
    return metrics.ratio(n(e.where("event_type = 'error'")), n(e), ["path"])


@query(_E + """, b AS (SELECT source AS a, target AS b FROM e UNION SELECT target, source FROM e), s AS (SELECT n_nationkey AS query_id, 'Nation:' || n_nationkey AS name FROM nation),
 h1 AS (SELECT DISTINCT query_id, b.b AS name FROM s JOIN b ON b.a = s.name), h2 AS (SELECT DISTINCT query_id, b.b AS name FROM h1 JOIN b ON b.a = h1.name),
 f AS (SELECT query_id, name, min(hop) AS hop FROM (SELECT *, 0 AS hop FROM s UNION ALL SELECT *, 1 FROM h1 UNION ALL SELECT *, 2 FROM h2) GROUP BY 1, 2),
 tx AS (SELECT 'Order:' || o_orderkey AS name FROM orders WHERE o_orderkey % 4 = 0),
 x AS (SELECT query_id, name, hop, CASE WHEN name IN (SELECT name FROM tx) THEN 1.0 ELSE 0.6 END AS score FROM f WHERE name IN (SELECT a FROM b) OR name IN (SELECT name FROM tx))
SELECT query_id, name, score, hop FROM x QUALIFY row_number() OVER (PARTITION BY query_id ORDER BY score DESC, hop, name) <= 10""")
def scored_neighbourhood(spark: SparkSession, d: str) -> DataFrame:
    """The best nodes around each nation, where some orders have a text."""
    seeds = table(spark, d, "nation").select(F.col("n_nationkey").alias("query_id"), F.concat(F.lit("Nation:"), F.col("n_nationkey").cast("string")).alias("name"))
    texts = table(spark, d, "orders").where("o_orderkey % 4 = 0").select(F.concat(F.lit("Order:"), F.col("o_orderkey").cast("string")).alias("name"))
    return graph.scored_neighbourhood(graph.edges(_triples(spark, d)), seeds, texts)


@query(_E + """, k AS (SELECT r_regionkey AS query_id, 'REGION:' || r_regionkey AS keyword FROM region UNION ALL SELECT 100 + n_nationkey, 'nation:' || n_nationkey FROM nation),
 x AS (SELECT DISTINCT query_id, label, source || ' -> ' || label || ' -> ' || target AS line FROM e, k WHERE contains(lower(source), lower(keyword)) OR contains(lower(target), lower(keyword)))
SELECT query_id, label, line FROM x QUALIFY row_number() OVER (PARTITION BY query_id, label ORDER BY line) <= 40""")
def relation_paths(spark: SparkSession, d: str) -> DataFrame:
    """Lines for the edges that touch each region's and nation's name."""
    named = lambda t, k, n, at: table(spark, d, t).select((F.col(k) + at).cast("long").alias("query_id"), F.concat(F.lit(n), F.col(k).cast("string")).alias("keyword"))
    words = named("region", "r_regionkey", "REGION:", 0).unionByName(named("nation", "n_nationkey", "nation:", 100))
    return graph.relation_paths(graph.edges(_triples(spark, d)), words)


def _chunk_triples(spark: SparkSession, d: str) -> tuple[DataFrame, DataFrame]:
    """Turns of conversations as chunks, and triples of who said what there."""
    c = table(spark, d, "conversations").where("conv_id is not null and turn is not null")
    chunk = F.concat_ws("-", F.col("conv_id").cast("string"), F.col("turn").cast("string"))
    chunks = c.select(F.col("conv_id").alias("doc_id"), chunk.alias("chunk_id"), F.col("turn").alias("index"), "text")
    word = F.regexp_extract(F.coalesce("text", F.lit("")), r"^\s*(\S+)", 1)
    props = lambda a, b: F.concat(F.lit('{ "turn" : '), a.cast("string"), F.lit(', "a": "'), b, F.lit('" }'))
    t = c.select(
        F.col("conv_id").alias("doc_id"), F.when(F.col("turn") % 3 != 2, chunk).alias("chunk_id"), F.col("turn").alias("at"), F.col("role").alias("subject"), F.when(F.col("turn") % 2 == 0, "Speaker").alias("subject_type"),
        props(F.col("turn"), F.lit("s")).alias("subject_properties"), F.lit("begins with").alias("predicate"), F.regexp_replace(word, r'[\\"]', "").alias("obj"), F.lit("Word").alias("obj_type"),
        F.when(F.col("turn") % 4 == 0, "no json").alias("obj_properties"), props(F.col("turn") * 2, F.col("role")).alias("properties"),
    )
    return t, chunks


_CHUNK_T = r"""WITH c AS (SELECT * FROM conversations WHERE conv_id IS NOT NULL AND turn IS NOT NULL), t AS (SELECT conv_id AS doc_id, CASE WHEN turn % 3 <> 2 THEN conv_id || '-' || turn ELSE CAST(conv_id AS VARCHAR) END AS chunk_id, turn AS pos, role AS subject,
 CASE WHEN turn % 2 = 0 THEN 'Speaker' ELSE 'Entity' END AS subject_type, '{"a":"s","turn":' || turn || '}' AS sp, 'begins with' AS predicate, regexp_replace(regexp_extract(coalesce(text, ''), '^\s*(\S+)', 1), '[\\"]', '', 'g') AS obj,
 '{"a":"' || role || '","turn":' || turn * 2 || '}' AS pp FROM c), n AS (SELECT doc_id, pos, 0 AS side, subject AS name, subject_type AS type, sp AS properties FROM t UNION ALL SELECT doc_id, pos, 1, obj, 'Word', '{}' FROM t),
 f AS (SELECT doc_id, name, arg_min(type, (pos, side, type)) AS type, arg_min(properties, (pos, side, type, properties)) AS properties FROM n WHERE trim(name) <> '' GROUP BY 1, 2)"""


@query(_CHUNK_T + """, e AS (SELECT DISTINCT doc_id, chunk_id, unnest([subject, obj]) AS name FROM t), g AS (SELECT e.doc_id, chunk_id, string_agg(name || '|' || type || '|' || properties, ' ; ' ORDER BY name) AS entities FROM e JOIN f USING (doc_id, name) GROUP BY 1, 2),
 r AS (SELECT doc_id, chunk_id, string_agg(subject || '|BEGINS_WITH|' || obj || '|' || pp, ' ; ' ORDER BY pos, subject, obj, pp) AS relations FROM t GROUP BY 1, 2)
SELECT r.doc_id, r.chunk_id, coalesce(x.text, '') AS text, coalesce(entities, '') AS entities, relations FROM r LEFT JOIN g ON g.doc_id = r.doc_id AND g.chunk_id = r.chunk_id LEFT JOIN c x ON x.conv_id || '-' || x.turn = r.chunk_id""")
def graph_documents_by_chunk(spark: SparkSession, d: str) -> DataFrame:
    x = graph_documents.graph_documents(*_chunk_triples(spark, d))
    flat = lambda c, *names: F.array_join(F.transform(c, lambda v: F.concat_ws("|", *[v[n] for n in names])), " ; ")
    return x.select("doc_id", "chunk_id", "text", flat("entities", "name", "type", "properties").alias("entities"), flat("relations", "source", "type", "target", "properties").alias("relations"))


@query()
def graph_fingerprints(spark: SparkSession, d: str) -> DataFrame:
    return graph_documents.graph_fingerprint(*_chunk_triples(spark, d))


@query(_CHUNK_T + f""" SELECT '{graph_documents.BASE}' || name AS s, 'rdf:type' AS p, '{graph_documents.BASE}' || type AS o, true AS is_iri FROM f
 UNION SELECT '{graph_documents.BASE}' || name, '{graph_documents.BASE}' || k, json_extract_string(properties, k), false FROM f, (VALUES ('a'), ('turn')) v(k) WHERE json_extract_string(properties, k) IS NOT NULL
 UNION SELECT '{graph_documents.BASE}' || subject, '{graph_documents.BASE}begins with', '{graph_documents.BASE}' || obj, true FROM t
 UNION SELECT '{graph_documents.BASE}' || subject, '{graph_documents.BASE}begins with_' || k, json_extract_string(pp, k), false FROM t, (VALUES ('a'), ('turn')) v(k)""")
def property_graph_rdf(spark: SparkSession, d: str) -> DataFrame:
    t = _chunk_triples(spark, d)[0]
    nodes = graph_documents.first_entities(t).select("name", "type", "properties")
    return graph_documents.rdf_view(nodes, t.select(F.col("subject").alias("source"), F.col("predicate").alias("label"), F.col("obj").alias("target"), "properties"))


@query("""WITH RECURSIVE s AS (SELECT conv_id AS id, turn * 7.5::DOUBLE AS start, coalesce(text, '') AS text, row_number() OVER (PARTITION BY conv_id ORDER BY turn, coalesce(text, '')) AS k, count(*) OVER (PARTITION BY conv_id) AS n, max(turn) OVER (PARTITION BY conv_id) * 7.5::DOUBLE AS final FROM conversations WHERE turn IS NOT NULL),
 f AS (SELECT id, k, n, final, start, CASE WHEN start >= 20 THEN 40 ELSE 20 END::DOUBLE AS till, CASE WHEN start >= 20 THEN '' ELSE text || ' ' END AS held, CASE WHEN start >= 20 THEN text || ' ' END AS done FROM s WHERE k = 1
  UNION ALL SELECT s.id, s.k, s.n, s.final, s.start, CASE WHEN s.start >= till THEN till + 20 ELSE till END, CASE WHEN s.start >= till THEN '' ELSE held || s.text || ' ' END, CASE WHEN s.start >= till THEN held || s.text || ' ' END FROM f JOIN s ON s.id = f.id AND s.k = f.k + 1),
 p AS (SELECT id, k, till - 40 AS start, start AS "end", trim(done) AS text FROM f WHERE done IS NOT NULL UNION ALL SELECT id, k + 1, till - 20, final, trim(held) FROM f WHERE k = n)
SELECT id, CAST(row_number() OVER (PARTITION BY id ORDER BY k) - 1 AS INTEGER) AS chunk, start, "end", text FROM p WHERE text <> ''""")
def transcript_chunks(spark: SparkSession, d: str) -> DataFrame:
    """Conversations as transcripts, a turn every seven and a half seconds, in pieces of twenty."""
    c = table(spark, d, "conversations").where("turn is not null")
    return chunking.timed(c.select(F.col("conv_id").alias("id"), (F.col("turn") * 7.5).alias("start"), "text"), 20)


@query(r"""SELECT page_id, regexp_replace(regexp_replace(url, '[\s\-]+', '_', 'g'), '[^A-Za-z0-9_]', '', 'g') AS key FROM pages""")
def metadata_keys(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "pages").select("page_id", T.metadata_key(F.col("url")).alias("key"))


def _order_relations(spark: SparkSession, d: str) -> DataFrame:
    """Who placed which order, with properties of some and the customer's nation as their document."""
    named = lambda c, n: F.concat(F.lit(n), F.col(c).cast("string"))
    key = F.col("o_orderkey")
    props = F.create_map(
        F.lit("Status"), F.when(key % 2 == 0, F.col("o_orderstatus")), F.lit("order priority"), F.when(key % 3 == 0, F.col("o_orderpriority")), F.lit("file_name"), F.lit("x.txt"),
        F.lit("Size"), F.when(key % 3 == 0, key.cast("string")),
    )
    return table(spark, d, "orders").select(named("o_custkey", "Customer:").alias("subject"), F.lit("placed").alias("predicate"), named("o_orderkey", "Order:").alias("obj"), F.when(key % 5 > 0, key % 25).alias("ref_doc_id"), props.alias("properties"))


_ANNOTATED = """WITH r AS (SELECT '<http://example.org/resource/customer_' || o_custkey || '>' AS s, '<http://example.org/ontology#placed>' AS p, '<http://example.org/resource/order_' || o_orderkey || '>' AS o,
 CASE WHEN o_orderkey % 5 > 0 THEN '<http://example.org/ontology#ref_doc_id> "' || o_orderkey % 25 || '"' END AS ref, CASE WHEN o_orderkey % 3 = 0 THEN '"' || o_orderkey || '"^^xsd:integer' END AS size,
 CASE WHEN o_orderkey % 2 = 0 THEN '"' || o_orderstatus || '"' END AS status, CASE WHEN o_orderkey % 3 = 0 THEN '"' || o_orderpriority || '"' END AS priority FROM orders)"""


@query(_ANNOTATED + """, b AS (SELECT s, p, o, concat_ws(' ; ', ref, '<http://example.org/ontology#size> ' || size, '<http://example.org/ontology#status> ' || status, '<http://example.org/ontology#order_priority> ' || priority) AS b FROM r)
SELECT DISTINCT s || ' ' || p || ' ' || o || CASE WHEN b <> '' THEN ' {| ' || b || ' |}' ELSE '' END || ' .' AS line FROM b""")
def rdf_annotation_blocks(spark: SparkSession, d: str) -> DataFrame:
    return graph.annotated_turtle(_order_relations(spark, d), "rdf_1.2", _order_types(spark))


@query(_ANNOTATED + """ SELECT DISTINCT line FROM (SELECT s || ' ' || p || ' ' || o || ' .' AS line FROM r UNION ALL SELECT '<< ' || s || ' ' || p || ' ' || o || ' >> ' || unnest([ref, '<http://example.org/ontology#size> ' || size,
 '<http://example.org/ontology#status> ' || status, '<http://example.org/ontology#order_priority> ' || priority]) || ' .' FROM r) WHERE line IS NOT NULL""")
def rdf_quoted_statements(spark: SparkSession, d: str) -> DataFrame:
    return graph.annotated_turtle(_order_relations(spark, d), "rdf_star", _order_types(spark))


@query(_ANNOTATED + """ SELECT DISTINCT line FROM (SELECT s || ' ' || p || ' ' || o || ' .' AS line FROM r UNION ALL SELECT s || ' ' || unnest(['<http://example.org/ontology#placed__size> ' || size,
 '<http://example.org/ontology#placed__status> ' || status, '<http://example.org/ontology#placed__order_priority> ' || priority]) || ' .' FROM r) WHERE line IS NOT NULL""")
def rdf_flat_properties(spark: SparkSession, d: str) -> DataFrame:
    return graph.annotated_turtle(_order_relations(spark, d), "flat", _order_types(spark))


def _order_types(spark: SparkSession) -> DataFrame:
    return spark.createDataFrame([("SIZE", "xsd:integer")], "name string, datatype string")


_SAID = "SELECT conv_id, turn, CASE turn % 4 WHEN 0 THEN ' I DO NOT know ' || text WHEN 1 THEN text || ' is not mentioned in the text' WHEN 2 THEN 'match (n) return ' || text ELSE text END AS text FROM conversations"


def _said(spark: SparkSession, d: str) -> DataFrame:
    m = F.col("turn") % 4
    text = F.when(m == 0, F.concat(F.lit(" I DO NOT know "), "text")).when(m == 1, F.concat("text", F.lit(" is not mentioned in the text"))).when(m == 2, F.concat(F.lit("match (n) return "), "text")).otherwise(F.col("text"))
    return table(spark, d, "conversations").select("conv_id", "turn", text.alias("text"))


@query(f"WITH s AS ({_SAID}) SELECT conv_id, turn FROM s WHERE NOT (" + " OR ".join([f"starts_with(lower(trim(coalesce(text, ''))), '{x}')".replace("n't", "n''t").replace("i'm", "i''m") for x in T.NO_ANSWER_STARTS] + [f"contains(lower(coalesce(text, '')), '{x}')" for x in T.NO_ANSWER_PARTS]) + ")")
def answers_with_a_result(spark: SparkSession, d: str) -> DataFrame:
    return _said(spark, d).where(~T.is_no_answer(F.col("text"))).select("conv_id", "turn")


@query(f"""WITH s AS ({_SAID}) SELECT conv_id, turn, CASE WHEN regexp_matches(upper(text), 'SELECT|CONSTRUCT|ASK|DESCRIBE') THEN 'sparql' WHEN contains(text, 'g.V(') OR contains(text, 'g.E(') THEN 'gremlin'
 WHEN contains(upper(text), 'FOR ') AND contains(upper(text), ' RETURN ') THEN 'aql' WHEN regexp_matches(upper(text), 'MATCH|CREATE|MERGE') THEN 'cypher' ELSE 'unknown' END AS language FROM s""")
def query_languages(spark: SparkSession, d: str) -> DataFrame:
    return _said(spark, d).select("conv_id", "turn", T.query_language(F.col("text")).alias("language"))
