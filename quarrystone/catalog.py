"""Registered queries of the engine, each with its SQL where SQL can express it.

Every query reads whole tables. documents stand in for loaded sources (doc_id orders them), embeddings for their vectors
(paired by doc_id = vec_id, an arbitrary but fixed pairing), their labels for clusters where SQL has to follow, pages for
fetched pages, conversations for chat threads.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .config import EngineConfig
from .functions import html as H
from .functions import text as T
from .functions import urls as U
from .functions.bpe import RankedBPE
from .functions.tokens import LONGEST, STOP_WORDS, tokens
from .operators import aggregate as A
from .operators import crawl, extract, graph, lexical_index, retrieval, ropes, tree, vector_index
from .operators.chunking import char_windows, chunk, enrich
from .operators.chunking import recursive_pieces as split_pieces
from .sources.collections import last_wins
from .sources.files import csv_rows, missing_sources, normalise
from .stem_sql import stems

CONFIG = EngineConfig()
QUERY = "the rewh of hehely and orre que der und les"
QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
SQL: dict[str, str] = {}


def query(sql: str | None = None):
    def register(f):
        QUERIES[f.__name__] = f
        if sql:
            SQL[f.__name__] = sql
        return f

    return register


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return dict(QUERIES)


def oracle_sql() -> dict[str, str]:
    return dict(SQL)


def _t(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def _docs(spark, sf_dir) -> DataFrame:
    return _t(spark, sf_dir, "documents")


# --- text ETL -------------------------------------------------------------------------------------------------------

NOT_BLANK = r"length(regexp_replace(text, '\s', '', 'g')) > 0"


@query(f"SELECT doc_id, 'Text not found at source' AS title, md5(text) AS text_md5, source, '' AS creation_date FROM documents WHERE {NOT_BLANK}")
def load_documents(spark, sf_dir):
    d = normalise(_docs(spark, sf_dir).select("text", "source", "doc_id"), seq="doc_id")
    return d.select(F.col("seq").alias("doc_id"), "title", F.md5("text").alias("text_md5"), "source", "creation_date")


@query("""SELECT source, md5(t) AS text_md5, n_parts, first_doc, sha256(concat(source, substr(t, 1, 500))) AS document_id FROM
 (SELECT source, string_agg(text, chr(10) || chr(10) ORDER BY doc_id) AS t, count(*) AS n_parts, min(doc_id) AS first_doc FROM documents GROUP BY source) q""")
def concat_by_source(spark, sf_dir):
    d = _docs(spark, sf_dir).select("source", "text", F.col("doc_id").alias("seq"), F.col("doc_id").alias("title"))
    out = A.concat_by_source(d, bits=256)
    return out.select("source", F.md5("text").alias("text_md5"), "n_parts", F.col("title").alias("first_doc"), "document_id")


TOKENS = r"string_split(trim(regexp_replace(text, '\s+', ' ', 'g')), ' ')"
CHUNKS = f"""SELECT doc_id, source, ((s // 360))::INT AS chunk_index, array_to_string(a[s + 1:s + 450], ' ') AS t, len(a[s + 1:s + 450])::INT AS n_tokens FROM
 (SELECT doc_id, source, a, unnest(range(0, greatest(len(a) - 90, 1), 360)) AS s FROM (SELECT doc_id, source, {TOKENS} AS a FROM documents WHERE {NOT_BLANK}) x) y"""


def _chunks(spark, sf_dir) -> DataFrame:
    return chunk(_docs(spark, sf_dir), CONFIG.chunk_size, CONFIG.chunk_overlap)


@query("""SELECT source, doc_id, (coalesce(sum(length(text) + 2) OVER (PARTITION BY source ORDER BY doc_id ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0))::BIGINT AS "offset",
 (sum(length(text) + 2) OVER (PARTITION BY source) - 2)::BIGINT AS n_chars, md5(text) AS piece_md5 FROM documents WHERE text IS NOT NULL""")
def source_rope(spark, sf_dir):
    """concat_by_source without a row of a whole source."""
    out = ropes.rope(_docs(spark, sf_dir), "source", "doc_id")
    return out.select("source", "doc_id", "offset", "n_chars", F.md5("piece").alias("piece_md5"))


SOURCE_CHUNKS = f"""SELECT source, ((s // 360))::INT AS chunk_index, array_to_string(a[s + 1:s + 450], ' ') AS t, len(a[s + 1:s + 450])::INT AS n_tokens FROM
 (SELECT source, a, unnest(range(0, greatest(len(a) - 90, 1), 360)) AS s FROM (SELECT source, {TOKENS} AS a FROM (SELECT source, string_agg(text, chr(10) || chr(10) ORDER BY doc_id) AS text FROM documents GROUP BY source) j WHERE {NOT_BLANK}) x) y"""


@query(f"SELECT source, chunk_index, n_tokens, md5(t) AS text_md5 FROM ({SOURCE_CHUNKS}) c")
def source_chunks(spark, sf_dir):
    """Chunks of each source's joined text, made of its rows."""
    out = ropes.rope_chunks(_docs(spark, sf_dir), "source", "doc_id", CONFIG.chunk_size, CONFIG.chunk_overlap)
    return out.select("source", "chunk_index", "n_tokens", F.md5("original_text").alias("text_md5"))


@query(f"SELECT doc_id, chunk_index, n_tokens, md5(t) AS text_md5 FROM ({CHUNKS}) c")
def chunk_windows(spark, sf_dir):
    return _chunks(spark, sf_dir).select("doc_id", "chunk_index", "n_tokens", F.md5("original_text").alias("text_md5"))


@query("""SELECT doc_id, (i // 12000)::INT AS piece, md5(substr(text, i + 1, 12000)) AS text_md5 FROM
 (SELECT doc_id, text, unnest(range(0, length(text), 12000)) AS i FROM documents) q""")
def char_chunks(spark, sf_dir):
    return _docs(spark, sf_dir).select("doc_id", F.posexplode(char_windows("text")).alias("piece", "t")).select("doc_id", "piece", F.md5("t").alias("text_md5"))


ENRICHED = f"""SELECT doc_id, chunk_index, t, 'Part ' || (chunk_index + 1) AS section, CASE WHEN chunk_index = 0 THEN 'definition' WHEN n_tokens < 450 THEN 'conclusion' ELSE 'evidence' END AS role,
 array_to_string((list_sort(list_distinct(regexp_extract_all(t, '([A-Z][a-z]{{5,}})', 1))))[1:5], ', ') AS entities, array_to_string((string_split(t, ' '))[1:12], ' ') AS context FROM ({CHUNKS}) c"""
TEXT = "'Section: ' || section || chr(10) || 'Role: ' || role || chr(10) || 'Entities: ' || entities || chr(10) || chr(10) || context || chr(10) || chr(10) || t"


@query(rf"SELECT doc_id, chunk_index, role AS chunk_role, entities, md5({TEXT}) AS text_md5, len(string_split(trim(regexp_replace({TEXT}, '\s+', ' ', 'g')), ' '))::INT AS n_tokens FROM ({ENRICHED}) e")
def enriched_text(spark, sf_dir):
    e = enrich(_chunks(spark, sf_dir))
    return e.select("doc_id", "chunk_index", "chunk_role", F.array_join("entities", ", ").alias("entities"), F.md5("text").alias("text_md5"), "n_tokens")


@query("SELECT doc_id, sha256(text) AS unit_id, ('0x' || substr(sha256(text), 1, 16))::UBIGINT::DECIMAL(20,0) AS point_id FROM documents")
def ids_point(spark, sf_dir):
    """With 256 bits, which SQL has too; the engine's default is 512."""
    d = _docs(spark, sf_dir).select("doc_id", T.unit_id("text", 256).alias("unit_id"))
    return d.withColumn("point_id", T.point_id("unit_id"))


@query(f"SELECT count(*) AS n_chunks, sum(n_tokens)::BIGINT AS total_tokens, count(DISTINCT source) AS n_sources, (sum(n_tokens) // greatest(count(*), 1))::BIGINT AS mean_tokens, round(sum(n_tokens) * 0.02::DOUBLE / 1e6, 6) AS cost FROM ({CHUNKS}) c")
def ingest_stats(spark, sf_dir):
    return A.ingest_stats(_chunks(spark, sf_dir))


@query("SELECT doc_id, ((row_number() OVER (ORDER BY doc_id) - 1) // 100)::BIGINT AS batch FROM documents")
def embed_batches(spark, sf_dir):
    return A.batches(_docs(spark, sf_dir).select("doc_id"), "doc_id", CONFIG.embedding_batch_size)


@query("SELECT ('0x' || substr(sha256(text), 1, 16))::UBIGINT::DECIMAL(20,0) AS point_id, max(doc_id) AS doc_id, arg_max(source, doc_id) AS source FROM documents GROUP BY 1")
def upsert_last_wins(spark, sf_dir):
    d = _docs(spark, sf_dir).select(T.point_id(T.unit_id("text", 256)).alias("point_id"), "doc_id", "source")
    return last_wins(d, "point_id", "doc_id")


@query("SELECT doc_id, CASE WHEN length(text) > 1000 THEN substr(text, 1, 1000) || chr(10) || chr(10) || '[... truncated for length ...]' ELSE text END AS text FROM documents")
def truncate_text(spark, sf_dir):
    return _docs(spark, sf_dir).select("doc_id", T.truncate("text", 1000).alias("text"))


@query("SELECT n_nationkey, 'n_nationkey: ' || n_nationkey || chr(10) || 'n_name: ' || n_name || chr(10) || 'n_regionkey: ' || n_regionkey AS text FROM nation")
def csv_row_docs(spark, sf_dir):
    return csv_rows(_t(spark, sf_dir, "nation"), ["n_nationkey", "n_name", "n_regionkey"]).select("n_nationkey", "text")


@query("SELECT * FROM (VALUES ('src0'), ('src999'), ('nowhere')) v(source) WHERE source NOT IN (SELECT DISTINCT source FROM documents)")
def missing_source_check(spark, sf_dir):
    return missing_sources(spark.createDataFrame([("src0",), ("src999",), ("nowhere",)], "source string"), _docs(spark, sf_dir))


@query("SELECT conv_id, string_agg(role || ': ' || text, chr(10) ORDER BY turn) AS history, count(*) AS n_turns FROM conversations GROUP BY conv_id")
def thread_history(spark, sf_dir):
    return A.thread_history(_t(spark, sf_dir, "conversations"))


@query("SELECT source AS collection, count(*) AS points, 'green' AS status FROM documents GROUP BY source")
def collection_status(spark, sf_dir):
    return A.status_rows(_docs(spark, sf_dir).withColumnRenamed("source", "collection"))


# --- lexical, dense, fused ------------------------------------------------------------------------------------------

STOPS = ", ".join(f"'{w}'" for w in STOP_WORDS)
LEXICAL = r"list_filter(regexp_split_to_array(trim(regexp_replace(lower(text), '[^\p{L}\p{N}_\s]', ' ', 'g')), '\s+'), lambda x: x <> '')"
KEPT = f"SELECT doc_id, token FROM (SELECT doc_id, unnest({LEXICAL}) AS token FROM documents) x WHERE token NOT IN ({STOPS}) AND length(token) <= {LONGEST}"
TF = f"SELECT doc_id, stem AS token, count(*) AS tf, max(n) AS n FROM (SELECT doc_id, token, count(*) OVER (PARTITION BY doc_id) AS n FROM ({KEPT}) k) y JOIN ({stems(KEPT)}) s USING (token) GROUP BY doc_id, stem"
WEIGHT = "tf * 2.2::DOUBLE / (tf + 1.2::DOUBLE * (0.25::DOUBLE + 0.75::DOUBLE * n / 256::DOUBLE))"
ASKED = f"SELECT token FROM (SELECT unnest(string_split('{QUERY}', ' ')) AS token) x WHERE token NOT IN ({STOPS})"
QTERMS = f"SELECT token, {WEIGHT} AS qw FROM (SELECT stem AS token, count(*) AS tf, (SELECT count(*) FROM ({ASKED}) c) AS n FROM ({ASKED}) q JOIN ({stems(ASKED)}) s USING (token) GROUP BY stem) t"


@query(f"SELECT doc_id, token, tf, round({WEIGHT}, 6) AS weight FROM ({TF}) t")
def token_tf(spark, sf_dir):
    return retrieval.postings(_docs(spark, sf_dir), "doc_id").select("doc_id", "token", "tf", F.round("weight", 6).alias("weight"))


LEX20 = f"SELECT doc_id, sum(w * qw) AS score FROM (SELECT doc_id, token, {WEIGHT} AS w FROM ({TF}) t) p JOIN ({QTERMS}) q USING (token) GROUP BY doc_id ORDER BY round(score, 9) DESC, doc_id LIMIT 20"


@query(f"SELECT doc_id, round(score, 4) AS score FROM ({LEX20}) l")
def bm25_topk(spark, sf_dir):
    return retrieval.lexical_topk(_docs(spark, sf_dir), QUERY, 20, "doc_id").select("doc_id", F.round("score", 4).alias("score"))


@query(SQL["bm25_topk"])
def bm25_blocks_topk(spark, sf_dir):
    """The same by an index in blocks, of which most are ruled out by their greatest weights."""
    from .functions.checkpoints import stored

    index = stored(lexical_index.blocks(_docs(spark, sf_dir), "doc_id"))
    return lexical_index.topk(index, QUERY, 20, "doc_id").select("doc_id", F.round("score", 4).alias("score"))


IDF = f"""SELECT doc_id, round(sum(w * qw * ln(1 + (nd - df + 0.5::DOUBLE) / (df + 0.5::DOUBLE))), 4) AS score FROM (SELECT doc_id, token, {WEIGHT} AS w, count(*) OVER (PARTITION BY token) AS df FROM ({TF}) t) p
 JOIN ({QTERMS}) q USING (token) CROSS JOIN (SELECT count(DISTINCT doc_id) AS nd FROM ({TF}) z) c GROUP BY doc_id ORDER BY score DESC, doc_id LIMIT 20"""


@query(IDF)
def bm25_idf_topk(spark, sf_dir):
    return retrieval.lexical_topk(_docs(spark, sf_dir), QUERY, 20, "doc_id", idf=True).select("doc_id", F.round("score", 4).alias("score"))


def _query_vector(spark, sf_dir) -> list[float]:
    return _t(spark, sf_dir, "embeddings").where("vec_id = 0").select("embedding").first()[0]


DENSE20 = "SELECT vec_id AS doc_id, list_cosine_similarity(embedding::DOUBLE[], (SELECT embedding::DOUBLE[] FROM embeddings WHERE vec_id = 0)) AS score FROM embeddings ORDER BY score DESC, doc_id LIMIT 20"


@query(f"SELECT doc_id, round(score, 4) AS score FROM ({DENSE20}) d")
def dense_topk(spark, sf_dir):
    e = _t(spark, sf_dir, "embeddings").withColumnRenamed("vec_id", "doc_id")
    return retrieval.dense_topk(e, _query_vector(spark, sf_dir), 20, "doc_id").select("doc_id", F.round("score", 4).alias("score"))


@query("""SELECT query_id, doc_id, rank FROM (SELECT q.vec_id AS query_id, e.vec_id AS doc_id, row_number() OVER (PARTITION BY q.vec_id ORDER BY list_cosine_similarity(e.embedding::DOUBLE[], q.embedding::DOUBLE[]) DESC, e.vec_id)::INT AS rank
 FROM embeddings e, embeddings q WHERE q.vec_id % 50 = 0) x WHERE rank <= 10""")
def dense_topk_many(spark, sf_dir):
    """The stated queries, every vector whose id is divisible by 50, against all."""
    e = _t(spark, sf_dir, "embeddings").withColumnRenamed("vec_id", "doc_id")
    q = e.where("doc_id % 50 = 0").select(F.col("doc_id").alias("query_id"), F.col("embedding").alias("vector"))
    return retrieval.dense_topk_many(e, q, 10, "doc_id").select("query_id", "doc_id", "rank")


def _indexed(spark, sf_dir):
    """An index of all vectors, stored for this query, and the stated queries."""
    from .functions.checkpoints import new_path

    e = _t(spark, sf_dir, "embeddings").withColumnRenamed("vec_id", "doc_id")
    model = vector_index.fit(e, "doc_id")
    index = vector_index.write(vector_index.place(e, model, "doc_id"), new_path(spark, "vectors"), "doc_id")
    return index, model, e.where("doc_id % 50 = 0").select(F.col("doc_id").alias("query_id"), F.col("embedding").alias("vector"))


@query()
def vector_index_topk(spark, sf_dir):
    """The queries of dense_topk_many by the index: some cells, quantised scores, exact scores of candidates (recall is tested)."""
    return vector_index.search(*_indexed(spark, sf_dir), 10, "doc_id").select("query_id", "doc_id", F.round("score", 4).alias("score"), "rank")


@query(SQL["dense_topk_many"])
def vector_index_exact(spark, sf_dir):
    """The same, with bounds: the rows of a full search."""
    return vector_index.search(*_indexed(spark, sf_dir), 10, "doc_id", exact=True).select("query_id", "doc_id", "rank")


FUSED = f"""SELECT doc_id, coalesce(1::DOUBLE / (60 + r1), 0) + coalesce(1::DOUBLE / (60 + r2), 0) AS score FROM (SELECT doc_id, row_number() OVER (ORDER BY score DESC, doc_id) AS r1 FROM ({DENSE20}) d) a
 FULL OUTER JOIN (SELECT doc_id, row_number() OVER (ORDER BY score DESC, doc_id) AS r2 FROM ({LEX20}) l) b USING (doc_id) ORDER BY score DESC, doc_id LIMIT 10"""


def _fused(spark, sf_dir) -> DataFrame:
    e = _t(spark, sf_dir, "embeddings").withColumnRenamed("vec_id", "doc_id")
    return retrieval.hybrid_topk(e, _docs(spark, sf_dir), _query_vector(spark, sf_dir), QUERY, CONFIG.top_k, CONFIG.rrf_k, "doc_id")


@query(f"SELECT doc_id, round(score, 6) AS score FROM ({FUSED}) f")
def rrf_hybrid(spark, sf_dir):
    return _fused(spark, sf_dir).select("doc_id", F.round("score", 6).alias("score"))


RANKED = f"""SELECT doc_id, row_number() OVER (ORDER BY f.score DESC, doc_id)::INT AS rank, round(f.score, 4) AS score, d.text, len({TOKENS})::INT AS n_tokens, d.lang FROM ({FUSED}) f JOIN documents d USING (doc_id)"""
PASSAGE = """'[Passage ' || rank || ' ' || chr(10) || ' Original Text: ' || text || ' ' || chr(10) || ' RAPTOR tree level Raw Chunk ' || chr(10) || ' ' || chr(10) || repeat(' ', 16) || 'Document Section: ' || lang || ' ' || chr(10) || ' Chunk Role: None ' || chr(10) || ' ' || chr(10)
 || repeat(' ', 16) || 'Entities: [' || chr(39) || lang || chr(39) || '] ' || chr(10) || ' RRF Retrieval Score: ' || score || ']' || chr(10) || chr(10) || repeat(' ', 4)"""


PASSAGE_TOKENS = rf"len(string_split(trim(regexp_replace({PASSAGE}, '\s+', ' ', 'g')), ' '))"


def _ranked(spark, sf_dir) -> DataFrame:
    found = _docs(spark, sf_dir).join(F.broadcast(_fused(spark, sf_dir)), "doc_id")
    ranked = found.withColumn("rank", F.row_number().over(Window.orderBy(F.desc("score"), "doc_id")))
    return ranked.select("doc_id", "rank", F.round("score", 4).alias("score"), "text", F.size(tokens("text")).alias("n_tokens"), "lang", F.lit(0).alias("raptor_tree_node_level"))


def _passages(spark, sf_dir) -> DataFrame:
    shown = T.passage("rank", "text", "raptor_tree_node_level", "lang", F.lit(None), F.array("lang"), "score")
    return retrieval.with_passages(_ranked(spark, sf_dir), shown)


@query(f"SELECT doc_id, rank, md5({PASSAGE}) AS passage_md5 FROM ({RANKED}) r")
def passage_format(spark, sf_dir):
    return _passages(spark, sf_dir).select("doc_id", "rank", F.md5("passage").alias("passage_md5"))


@query(f"""SELECT md5(string_agg({PASSAGE}, chr(10) || chr(10) || '---' || chr(10) || chr(10) ORDER BY rank)) AS passages_md5, sum(shown)::BIGINT AS total_tokens, count(*) AS num_passages
 FROM (SELECT *, sum(shown) OVER (ORDER BY rank ROWS UNBOUNDED PRECEDING) AS run FROM (SELECT *, {PASSAGE_TOKENS} AS shown FROM ({RANKED}) r) p) q WHERE run <= 1650""")
def context_pack(spark, sf_dir):
    out = retrieval.assemble(retrieval.pack(_passages(spark, sf_dir), CONFIG.context_tokens))
    return out.select(F.md5("passages_text").alias("passages_md5"), F.when(F.col("num_passages") > 0, F.col("total_tokens")).alias("total_tokens"), "num_passages")


# --- tree -----------------------------------------------------------------------------------------------------------

CENTRES = "SELECT label, i, avg(x) AS c FROM (SELECT label, unnest(embedding::DOUBLE[]) AS x, unnest(range(1, len(embedding) + 1)) AS i FROM embeddings) e GROUP BY label, i"
POSTERIOR = f"""SELECT vec_id, cluster_id, exp(100 * s) / sum(exp(100 * s)) OVER (PARTITION BY vec_id) AS p FROM (SELECT vec_id, c.label AS cluster_id, sum(x * c) AS s FROM
 (SELECT vec_id, unnest(embedding::DOUBLE[]) AS x, unnest(range(1, len(embedding) + 1)) AS i FROM embeddings) e JOIN ({CENTRES}) c USING (i) GROUP BY vec_id, c.label) z"""


@query(f"SELECT vec_id, cluster_id, round(p, 4) AS p FROM ({POSTERIOR}) q WHERE p >= 0.5")
def soft_threshold(spark, sf_dir):
    """Memberships of 0.5 or more over a given posterior: softmax of the similarity to each label's mean vector."""
    e = _t(spark, sf_dir, "embeddings")
    each = e.select("vec_id", "label", F.posexplode(F.col("embedding").cast("array<double>")).alias("i", "x"))
    means = each.groupBy("label", "i").agg(F.avg("x").alias("c")).groupBy("label").agg(F.transform(F.array_sort(F.collect_list(F.struct("i", "c"))), lambda s: s["c"]).alias("c"))
    labels = means.agg(F.array_sort(F.collect_list(F.struct("label", "c"))).alias("centres"))  # one row for each label: a handful
    scored = e.join(F.broadcast(labels)).select("vec_id", F.transform("centres", lambda c: F.struct(c["label"].alias("cluster_id"), F.exp(100 * retrieval.dot("embedding", c["c"])).alias("v"))).alias("s"))
    total = F.aggregate("s", F.lit(0.0), lambda a, x: a + x["v"])
    out = scored.select("vec_id", total.alias("t"), F.explode("s").alias("s")).select("vec_id", "s.cluster_id", (F.col("s.v") / F.col("t")).alias("p"))
    return tree.over_threshold(out, CONFIG.cluster_threshold).select("vec_id", "cluster_id", F.round("p", 4).alias("p"))


MEMBERS = "SELECT e.label AS cluster_id, d.doc_id, d.text, d.source, sha256(d.text) AS id FROM documents d JOIN embeddings e ON d.doc_id = e.vec_id"


def _members(spark, sf_dir) -> DataFrame:
    e = _t(spark, sf_dir, "embeddings").select(F.col("vec_id").alias("doc_id"), F.col("label").alias("cluster_id"))
    d = _docs(spark, sf_dir).select("doc_id", F.col("text").alias("original_text"), "source", T.unit_id("text", 256).alias("id"))
    return d.join(e, "doc_id").withColumn("pos", F.col("doc_id")).withColumn("document_id", F.col("doc_id"))


@query(f"""SELECT cluster_id, text_md5, children_md5, document_id, n_members, source FROM (SELECT cluster_id, md5(string_agg(text, chr(10) || chr(10) || '---' || chr(10) || chr(10) ORDER BY doc_id)) AS text_md5, md5(string_agg(id, ',' ORDER BY doc_id)) AS children_md5,
 min(doc_id) AS document_id, count(*) AS n_members FROM ({MEMBERS}) m GROUP BY cluster_id) a JOIN (SELECT cluster_id, source FROM (SELECT cluster_id, source, row_number() OVER (PARTITION BY cluster_id ORDER BY count(*) DESC, min(doc_id)) AS r FROM ({MEMBERS}) m GROUP BY cluster_id, source) x WHERE r = 1) b USING (cluster_id)""")
def cluster_summary_inputs(spark, sf_dir):
    out = A.cluster_inputs(_members(spark, sf_dir))
    return out.select("cluster_id", F.md5("text").alias("text_md5"), F.md5(F.array_join("children_ids", ",")).alias("children_md5"), "document_id", "n_members", "source")


@query(f"SELECT id, count(DISTINCT cluster_id) AS n_clusters FROM ({MEMBERS}) m GROUP BY id HAVING count(DISTINCT cluster_id) > 1")
def multi_assigned(spark, sf_dir):
    return A.multi_assigned(_members(spark, sf_dir).select("id", "cluster_id").distinct())


@query(f"SELECT level, count(*) AS n FROM (SELECT 0 AS level FROM ({MEMBERS}) m UNION ALL SELECT 1 FROM (SELECT DISTINCT cluster_id FROM ({MEMBERS}) m) c) n GROUP BY level")
def level_counts(spark, sf_dir):
    m = _members(spark, sf_dir)
    return A.level_counts(m.select(F.lit(0).alias("level")).unionByName(A.cluster_inputs(m).select(F.lit(1).alias("level"))))


@query(f"SELECT 'labels' AS collection, count(*) AS chunks, count(DISTINCT source) AS n_sources, (SELECT count(*) FROM ({MEMBERS}) m) + (SELECT count(DISTINCT cluster_id) FROM ({MEMBERS}) m) AS total_nodes FROM ({MEMBERS}) m")
def run_summary(spark, sf_dir):
    m = _members(spark, sf_dir)
    up = A.cluster_inputs(m).select(F.lit(1).alias("level"), "source")
    out = A.run_summary(m.select(F.lit(0).alias("level"), "source").unionByName(up), "labels")
    return out.select("collection", "chunks", F.size("sources").cast("long").alias("n_sources"), "total_nodes")


@query(f"SELECT cluster_id AS parent_id, id FROM ({MEMBERS}) m WHERE cluster_id IN (0, 1)")
def tree_expand(spark, sf_dir):
    nodes = A.cluster_inputs(_members(spark, sf_dir)).select(F.col("cluster_id").alias("id"), "children_ids")
    return graph.expand(nodes, spark.createDataFrame([(0,), (1,)], "id int"))


#: Parents in a tree over the documents: an eighth of the number, so that levels differ in size.
TREE = "SELECT doc_id AS id, CASE WHEN doc_id > 0 THEN doc_id // 8 END AS parent_id FROM documents"


def _tree(spark, sf_dir):
    return _docs(spark, sf_dir).select(F.col("doc_id").alias("id"), F.expr("case when doc_id > 0 then doc_id div 8 end").alias("parent_id"))


@query(f"""WITH RECURSIVE t AS ({TREE}), r(seed, id, distance) AS (SELECT id, id, 0 FROM t WHERE id % 50 = 0 UNION ALL SELECT r.seed, t.id, r.distance + 1 FROM r JOIN t ON t.parent_id = r.id)
SELECT DISTINCT seed, id, distance::INT AS distance FROM r""")
def tree_descendants(spark, sf_dir):
    """All levels below the stated nodes, those whose id is divisible by 50."""
    links = _tree(spark, sf_dir)
    return graph.reach(links, links.where("id % 50 = 0"))


@query(f"""WITH RECURSIVE t AS ({TREE}), r(seed, id, distance) AS (SELECT id, id, 0 FROM t WHERE id % 50 = 0 UNION ALL SELECT r.seed, t.parent_id, r.distance + 1 FROM r JOIN t ON t.id = r.id WHERE t.parent_id IS NOT NULL)
SELECT DISTINCT seed, id, distance::INT AS distance FROM r""")
def tree_ancestors(spark, sf_dir):
    links = _tree(spark, sf_dir)
    return graph.reach(links, links.where("id % 50 = 0"), up=True)


@query()
def gmm_tree(spark, sf_dir):
    """One level of soft clusters over all vectors: sizes and mean posterior."""
    from .functions.checkpoints import cut

    e = cut(_t(spark, sf_dir, "embeddings").select(F.col("vec_id").alias("id"), "embedding"))
    return tree.soft_clusters(e, CONFIG.components(1), CONFIG.max_clusters, CONFIG.cluster_threshold).groupBy("cluster_id").agg(F.count("*").alias("n"), F.round(F.avg("p"), 3).alias("mean_p"))


@query()
def summary_tree(spark, sf_dir):
    """The whole way: every document cut, enriched and embedded, then two levels of soft clusters and summaries."""
    from .functions.checkpoints import stored
    from .operators.providers import HashedEmbedder, LeadingWords, embed
    from .plans.index import ordered, units

    d = _docs(spark, sf_dir).select(F.concat_ws("/", "source", "doc_id").alias("source"), "text", F.lit(T.NO_TITLE).alias("title"), F.col("doc_id").alias("seq"))
    embedder = HashedEmbedder(CONFIG.embedding_dimensions)
    leaves = stored(embed(units(d, CONFIG), embedder, batch=CONFIG.embedding_batch_size))
    nodes = tree.build(ordered(leaves), LeadingWords(), embedder, CONFIG, kept=True)
    return nodes.groupBy("level").agg(F.count("*").alias("n"), F.count("parent_id").alias("n_with_parent"), F.sum(F.size(F.coalesce("children_ids", F.array().cast("array<string>")))).cast("long").alias("n_children"))


@query("SELECT sha256(text) AS id, source, array_to_string(list_sort(list_distinct(list(doc_id::VARCHAR))), ',') AS children FROM documents GROUP BY 1, 2")
def index_rows(spark, sf_dir):
    """Rows for a plain document index: child ids joined with commas."""
    d = _docs(spark, sf_dir).select(T.unit_id("text", 256).alias("id"), "source", F.col("doc_id").cast("string").alias("child"))
    return A.document_index(d)


# --- pages ----------------------------------------------------------------------------------------------------------

NORMALIZED = r"regexp_replace(regexp_replace(regexp_replace(url, '[?#].*$', ''), ';[^/]*$', ''), '/+$', '')"


@query(f"SELECT page_id, {NORMALIZED} AS url FROM pages")
def normalize_url(spark, sf_dir):
    return _t(spark, sf_dir, "pages").select("page_id", U.normalize_url("url").alias("url"))


@query(f"SELECT page_id, md5({NORMALIZED}) AS url_key, regexp_extract(url, '^[A-Za-z][A-Za-z0-9+.-]*://([^/?#]*)', 1) AS netloc FROM pages")
def url_key(spark, sf_dir):
    return _t(spark, sf_dir, "pages").select("page_id", U.url_key(U.normalize_url("url")).alias("url_key"), U.netloc("url").alias("netloc"))


def _sql_doc_link(path: str) -> str:
    return " AND ".join([f"lower({path}) NOT LIKE '%{x}'" for x in U.SKIP_EXTENSIONS] + [f"lower({path}) NOT LIKE '%{x}%'" for x in U.BAD_SEGMENTS])


HREFS = r"""SELECT page_id, url AS page, unnest(regexp_extract_all(html, '(?i)<a\s(?:[^>]*?\s)?href\s*=\s*["'']([^"'']*)["'']', 1)) AS h FROM pages"""
LINKS = rf"""SELECT page_id, page, regexp_replace(regexp_replace(regexp_replace(u, '[?#].*$', ''), ';[^/]*$', ''), '/+$', '') AS link FROM (SELECT page_id, page, CASE WHEN regexp_matches(h, '^[A-Za-z][A-Za-z0-9+.-]*:') THEN h
 WHEN h LIKE '//%' THEN regexp_extract(page, '^([A-Za-z][A-Za-z0-9+.-]*:)', 1) || h WHEN h LIKE '/%' THEN regexp_extract(page, '^([A-Za-z][A-Za-z0-9+.-]*://[^/?#]*)', 1) || h END AS u
 FROM (SELECT page_id, page, replace(h, '&amp;', '&') AS h FROM ({HREFS}) x) y WHERE h NOT LIKE '#%') z WHERE u IS NOT NULL"""
SQL_PATH = r"regexp_replace(link, '^[A-Za-z][A-Za-z0-9+.-]*:(//[^/?#]*)?', '')"
SQL_HOST = r"regexp_extract({}, '^[A-Za-z][A-Za-z0-9+.-]*://([^/?#]*)', 1)"
OK_LINK = f"({SQL_HOST.format('link')} = {SQL_HOST.format('page')} OR {SQL_HOST.format('link')} = '') AND {_sql_doc_link(SQL_PATH)}"


@query(f"SELECT DISTINCT page_id, link FROM ({LINKS}) l WHERE {OK_LINK}")
def extract_links(spark, sf_dir):
    return _t(spark, sf_dir, "pages").select("page_id", F.explode(U.extract_links("html", "url")).alias("link"))


@query(f"SELECT page_id, link, ({OK_LINK}) AS ok FROM ({LINKS}) l")
def doc_link_filter(spark, sf_dir):
    p = _t(spark, sf_dir, "pages").select("page_id", F.col("url").alias("page"), F.explode(U.extract_hrefs("html")).alias("h"))
    links = p.select("page_id", "page", U.normalize_url(U.resolve_simple("page", "h")).alias("link")).where("link is not null")
    return links.select("page_id", "link", U.is_doc_link("link", U.netloc("page")).alias("ok"))


@query()
def discovered_links(spark, sf_dir):
    """Links in any form of reference, resolved in full."""
    return crawl.discovered(_t(spark, sf_dir, "pages")).select("page_url", F.explode("links").alias("link"))


@query()
def clean_text(spark, sf_dir):
    return _t(spark, sf_dir, "pages").select("page_id", H.clean_text("html").alias("text"))


PROJECT_PAGES = f"SELECT {SQL_HOST.format('url')} AS project, {NORMALIZED} AS u, page_id FROM pages"


def _project_pages(spark, sf_dir) -> DataFrame:
    return _t(spark, sf_dir, "pages").select("page_id", U.netloc("url").alias("project"), U.normalize_url("url").alias("url"))


@query(f"""SELECT project, arg_min(u, i) AS root_url, count(*) AS n_pages, md5(string_agg(u || '|pages/' || project || '/' || md5(u) || '.txt', ';' ORDER BY i)) AS saved_md5
 FROM (SELECT project, u, min(page_id) AS i FROM ({PROJECT_PAGES}) p GROUP BY project, u) q GROUP BY project""")
def manifest(spark, sf_dir):
    m = crawl.manifest(_project_pages(spark, sf_dir))
    saved = F.array_join(F.transform("saved_pages", lambda s: F.concat(s["url"], F.lit("|"), s["page_path"])), ";")
    return m.select("project", "root_url", F.size("visited").cast("long").alias("n_pages"), F.md5(saved).alias("saved_md5"))


@query(f"SELECT DISTINCT page_id, project, u AS url FROM ({PROJECT_PAGES}) p WHERE page_id % 2 = 1 AND (project, u) NOT IN (SELECT project, u FROM ({PROJECT_PAGES}) v WHERE page_id % 2 = 0)")
def unvisited_pages(spark, sf_dir):
    """The later half of a crawl, here the odd ids, against the visited set of the other."""
    p = _project_pages(spark, sf_dir)
    return crawl.unvisited(p.where("page_id % 2 = 1"), p.where("page_id % 2 = 0")).select("page_id", "project", "url")


@query(f"SELECT r.project, r.k AS url_key, coalesce(t.u, 'Page not found') AS text FROM (SELECT DISTINCT project, md5(u) AS k FROM ({PROJECT_PAGES}) p UNION SELECT 'none', md5('x')) r LEFT JOIN (SELECT DISTINCT project, u FROM ({PROJECT_PAGES}) p) t ON t.project = r.project AND md5(t.u) = r.k")
def page_lookup(spark, sf_dir):
    p = _project_pages(spark, sf_dir).select("project", U.url_key("url").alias("url_key"), F.col("url").alias("text")).distinct()
    return crawl.lookup(p, p.select("project", "url_key").union(spark.createDataFrame([("none",)], "p string").select("p", F.md5(F.lit("x")))))


@query("SELECT conv_id, turn, length(text)::INT AS char_count, length(text) > 50 AS success FROM conversations")
def transcript_check(spark, sf_dir):
    rows = _t(spark, sf_dir, "conversations").withColumnRenamed("text", "transcript").withColumn("title", F.lit(""))
    return crawl.transcripts(rows).select("conv_id", "turn", "char_count", "success")


@query("SELECT conv_id::VARCHAR AS url, string_agg(text, '' ORDER BY turn) AS tree FROM conversations GROUP BY conv_id")
def tree_text(spark, sf_dir):
    rows = _t(spark, sf_dir, "conversations").select(F.col("conv_id").cast("string").alias("url"), F.col("turn").alias("seq"), "text")
    return crawl.tree_text(rows)


@query("SELECT doc_id, string_agg(trim(array_to_string((string_split(trim(regexp_replace(piece, '\\s+', ' ', 'g')), ' '))[1:60], ' ')), chr(10) ORDER BY i) AS text FROM (SELECT doc_id, i, substr(text, i + 1, 12000) AS piece FROM (SELECT doc_id, text, unnest(range(0, length(text), 12000)) AS i FROM documents) q) p GROUP BY doc_id")
def translate_pieces(spark, sf_dir):
    """Translation piece by piece; the provider here keeps the first words of each."""
    from .operators.providers import LeadingWords, translate

    return translate(_docs(spark, sf_dir).select("doc_id", "text"), LeadingWords(60), "text", CONFIG.translation_chars)


#: A public vocabulary of the machine; a deployment names its own, on its file system.
VOCABULARY = "file:///opt/tokenizers/byte_bpe_50k.tiktoken"


@query()
def bpe_chunks(spark, sf_dir):
    """Windows of byte-pair tokens over every text."""
    docs = _docs(spark, sf_dir).select("doc_id", "text")
    return chunk(docs, CONFIG.chunk_size, CONFIG.chunk_overlap, RankedBPE.load(spark, VOCABULARY))


@query()
def recursive_pieces(spark, sf_dir):
    return _docs(spark, sf_dir).select("doc_id", F.posexplode(split_pieces("text", 500, 50)).alias("piece_index", "piece"))


#: Forms of a video's address, with and without an id of 11 characters.
VIDEO_URL = "concat(element_at(array('https://www.youtube.com/watch?v=', 'https://youtu.be/', 'https://x.org/embed/', '', 'https://x.org/watch/'), cast(page_id % 5 + 1 as int)), substring(md5(url), 1, cast(7 + page_id % 7 as int)), if(page_id % 3 = 0, '', '&t=1'))"


@query(r"""SELECT page_id, coalesce(nullif(regexp_extract(u, '(?:v=|/v/|youtu\.be/|/embed/)([a-zA-Z0-9_-]{11})', 1), ''), nullif(regexp_extract(u, '^([a-zA-Z0-9_-]{11})$', 1), '')) AS video_id FROM
 (SELECT page_id, (['https://www.youtube.com/watch?v=', 'https://youtu.be/', 'https://x.org/embed/', '', 'https://x.org/watch/'])[page_id % 5 + 1] || substr(md5(url), 1, (7 + page_id % 7)::INT) || CASE WHEN page_id % 3 = 0 THEN '' ELSE '&t=1' END AS u FROM pages) t""")
def video_id(spark, sf_dir):
    return _t(spark, sf_dir, "pages").withColumn("u", F.expr(VIDEO_URL)).select("page_id", T.video_id("u").alias("video_id"))


@query(r"SELECT doc_id, replace(regexp_replace(regexp_replace(substr(regexp_replace(text, '[^\p{L}\p{N}_\s-]', '', 'g'), 1, 80), '^\s+', ''), '\s+$', ''), ' ', '_') AS name FROM documents")
def safe_filename(spark, sf_dir):
    """Every text as the title that a file is named after."""
    return _docs(spark, sf_dir).select("doc_id", T.safe_name("text").alias("name"))


# --- entities and relations (design) --------------------------------------------------------------------------------

FOUND = "SELECT lang || '-' || source AS name, CASE WHEN doc_id % 2 = 0 THEN 'even' ELSE 'odd' END AS type, substr(text, 1, 20) AS description, source, doc_id AS seq FROM documents"
ENTITIES = f"SELECT name, arg_max(type, seq) AS type, string_agg(description, ' | ' ORDER BY seq) AS description, arg_max(source, seq) AS source FROM ({FOUND}) f GROUP BY name"
RELATIONS = "SELECT source, target, description, arg_max(strength, seq)::INT AS strength FROM (SELECT lang || '-' || source AS source, 'en-' || source AS target, 'in ' || lang AS description, coalesce(nullif(doc_id % 11, 0), 5) AS strength, doc_id AS seq FROM documents) r GROUP BY source, target, description"


def _entities(spark, sf_dir) -> DataFrame:
    d = _docs(spark, sf_dir)
    return graph.merge_entities(d.select(F.concat_ws("-", "lang", "source").alias("name"), F.when(F.col("doc_id") % 2 == 0, "even").otherwise("odd").alias("type"), F.substring("text", 1, 20).alias("description"), "source", F.col("doc_id").alias("seq"), F.col("doc_id").alias("chunk_id")))


def _relations(spark, sf_dir, entities=None) -> DataFrame:
    d = _docs(spark, sf_dir)
    strength = F.nullif((F.col("doc_id") % 11).cast("int"), F.lit(0))
    return graph.merge_relations(d.select(F.concat_ws("-", "lang", "source").alias("source"), F.concat(F.lit("en-"), "source").alias("target"), F.concat(F.lit("in "), "lang").alias("description"), strength.alias("strength"), F.col("doc_id").alias("seq")), entities)


@query(f"SELECT name, type, md5(description) AS description_md5, source FROM ({ENTITIES}) e")
def entity_merge(spark, sf_dir):
    return _entities(spark, sf_dir).select("name", "type", F.md5("description").alias("description_md5"), "source")


@query(f"SELECT * FROM ({RELATIONS}) r WHERE source IN (SELECT name FROM ({ENTITIES}) e) AND target IN (SELECT name FROM ({ENTITIES}) e)")
def relation_merge(spark, sf_dir):
    return _relations(spark, sf_dir, _entities(spark, sf_dir))


@query(f"SELECT name, type FROM ({ENTITIES}) e WHERE lower(name) LIKE '%src1%' OR lower(description) LIKE '%src1%' ORDER BY name LIMIT 5")
def entity_search(spark, sf_dir):
    return graph.search_entities(_entities(spark, sf_dir), "SRC1").select("name", "type")


HOP = f"""SELECT n.name, e.type, n.relation, n.neighbour, n.strength FROM (SELECT source AS name, description AS relation, target AS neighbour, strength FROM ({RELATIONS}) r UNION ALL SELECT target, description, source, strength FROM ({RELATIONS}) r) n
 JOIN (SELECT name, type FROM ({ENTITIES}) e WHERE lower(name) LIKE '%src1%' OR lower(description) LIKE '%src1%' ORDER BY name LIMIT 5) e USING (name) ORDER BY strength DESC, name, neighbour, relation LIMIT 30"""


def _hop(spark, sf_dir) -> DataFrame:
    return graph.neighbourhood(graph.search_entities(_entities(spark, sf_dir), "src1"), _relations(spark, sf_dir))


@query(HOP)
def one_hop(spark, sf_dir):
    return _hop(spark, sf_dir).select("name", "type", "relation", "neighbour", "strength")


@query()
def graph_context(spark, sf_dir):
    return graph.format_context(_hop(spark, sf_dir))


# --- entities and relations that a provider finds ---------------------------------------------------------------------

OPENINGS = r"SELECT doc_id, source, unnest(regexp_extract_all(text, '([A-Z][a-z]{3,})([^.\n]*)', 1)) AS name, unnest(regexp_extract_all(text, '([A-Z][a-z]{3,})([^.\n]*)', 2)) AS said, generate_subscripts(regexp_extract_all(text, '([A-Z][a-z]{3,})([^.\n]*)', 1), 1) - 1 AS pos FROM documents"
MENTIONS = f"SELECT name, count(*) AS n FROM ({OPENINGS}) o GROUP BY name"
GRAMS = f"SELECT name, n, list_distinct(list_transform(range(1, length(name) + 2), lambda i: substr(chr(2) || chr(2) || lower(name) || chr(3), i, 3))) AS g FROM ({MENTIONS}) m"
ALIKE = f"""SELECT a, b FROM (SELECT x.name AS a, y.name AS b, count(*) AS hits, any_value(len(x.g)) AS na, any_value(len(y.g)) AS nb FROM (SELECT name, g, unnest(g) AS gram FROM ({GRAMS}) t) x
 JOIN (SELECT name, g, unnest(g) AS gram FROM ({GRAMS}) t) y ON x.gram = y.gram AND x.name < y.name GROUP BY 1, 2) p WHERE 100 * hits >= 80 * (na + nb - hits)"""
CANONICAL = f"SELECT a AS name, arg_min(b, (-n, b)) AS canonical FROM (SELECT a, b FROM ({ALIKE}) p UNION ALL SELECT b, a FROM ({ALIKE}) p UNION ALL SELECT name, name FROM ({MENTIONS}) m) e JOIN ({MENTIONS}) c ON c.name = b GROUP BY a"


def _extracted(spark, sf_dir):
    """Every document as a leaf, and the provider by rule."""
    nodes = _docs(spark, sf_dir).select(F.col("doc_id").alias("id"), F.col("doc_id").alias("seq"), "source", F.col("text").alias("original_text"), F.lit(0).alias("level"))
    return extract.extract(nodes, extract.SentenceOpenings())


@query(f"SELECT doc_id AS chunk_id, pos::INT AS pos, name, 'word' AS type, md5(trim(said)) AS description_md5, source FROM ({OPENINGS}) o")
def extracted_entities(spark, sf_dir):
    e = _extracted(spark, sf_dir).entities
    return e.select("chunk_id", "seq.pos", "name", "type", F.md5("description").alias("description_md5"), "source")


@query(f"SELECT a.doc_id AS chunk_id, a.pos::INT AS pos, a.name AS source, b.name AS target, 'then' AS description FROM ({OPENINGS}) a JOIN ({OPENINGS}) b ON a.doc_id = b.doc_id AND b.pos = a.pos + 1")
def extracted_relations(spark, sf_dir):
    return _extracted(spark, sf_dir).relations.select("chunk_id", "seq.pos", "source", "target", "description")


@query(CANONICAL)
def canonical_names(spark, sf_dir):
    return extract.canonical(_extracted(spark, sf_dir).entities)


@query(f"SELECT canonical AS name, md5(string_agg(trim(said), ' | ' ORDER BY doc_id, pos)) AS description_md5, arg_max(source, (doc_id, pos)) AS source, max(doc_id) AS chunk_id FROM ({OPENINGS}) o JOIN ({CANONICAL}) c USING (name) GROUP BY 1")
def extracted_entity_merge(spark, sf_dir):
    """Entities of canonical names, with their whole descriptions."""
    e = extract.merged(_extracted(spark, sf_dir))
    return e.select("name", F.md5("description").alias("description_md5"), "source", "chunk_id")
