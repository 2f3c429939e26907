"""Named queries over the test tables and the SQL that each must agree with.

The tables stand for the engine's domain: documents are entities (lang their category, source their city), embeddings
their vectors, benchmark passages the queries, labels the grades, conversations chat messages, customers places with a
nation and a region. Floating-point results are rounded in both, as sums may run in another order.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..functions import documents as fd
from ..functions import projections as fp
from ..functions import text as ft
from ..functions import vectors as fv
from ..operators import embed, metrics, policy, rank, retrieve, sync
from ..sources import fixtures, records
from ..sources.table import verification
from ..sources.written import Scratch

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLES: dict[str, str] = {}


def query(sql: str | None = None):  # noqa: ANN201
    def add(f: Callable) -> Callable:
        QUERIES[f.__name__] = f
        if sql:
            ORACLES[f.__name__] = sql
        return f

    return add


def read(spark: SparkSession, d: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{d}/{name}.parquet")


# ---- SQL pieces ------------------------------------------------------------------------------------------------------
def s_clean(x: str) -> str:
    return rf"trim(regexp_replace(coalesce({x}, ''), '[\s\x1c-\x1f\x{{85}}\x{{a0}}]+', ' ', 'g'))"


def s_norm(x: str) -> str:
    return s_clean(f"strip_accents(replace(lower({s_clean(x)}), 'ß', 'ss'))")


_STOP = ", ".join(f"'{w}'" for w in ft.STOPWORDS)


def s_raw(x: str) -> str:
    return f"regexp_extract_all({s_norm(x)}, '[a-z0-9]+')"


def s_filtered(x: str) -> str:
    return f"list_filter({s_raw(x)}, lambda t: t NOT IN ({_STOP}) AND (length(t) > 1 OR regexp_matches(t, '^[0-9]+$')))"


def s_stems(x: str) -> str:
    fixed = "regexp_matches(t, '^[0-9]+$') OR length(t) <= 3"
    plural = f"CASE WHEN {fixed} THEN t WHEN length(t) > 5 AND t LIKE '%es' THEN t[:-3] WHEN length(t) > 4 AND t LIKE '%s' THEN t[:-2] ELSE t END"
    rest = " ".join(f"WHEN t LIKE '%{s}' AND length(t) > {len(s) + n} THEN left(t, length(t) - {len(s)})" for s, n in [*((s, 3) for s in ("ando", "iendo", "ados", "adas", "idos", "idas")), *((s, 2) for s in ("ar", "er", "ir"))])
    plural = plural.replace("t[:-3]", "left(t, length(t) - 2)").replace("t[:-2]", "left(t, length(t) - 1)")
    return f"list_transform(list_transform({s_filtered(x)}, lambda t: {plural}), lambda t: CASE WHEN {fixed} THEN t {rest} WHEN t LIKE '%a' OR t LIKE '%o' THEN left(t, length(t) - 1) ELSE t END)"


_D_TERMS = f"""d AS (SELECT doc_id, {s_stems("text")} AS t FROM documents),
    nd AS (SELECT count(*) AS n, avg(len(t)) AS al FROM d), dl AS (SELECT doc_id, len(t) AS l FROM d),
    dt AS (SELECT doc_id, term, count(*) AS tf FROM (SELECT doc_id, unnest(t) AS term FROM d) GROUP BY ALL),
    df AS (SELECT term, count(*) AS df FROM dt GROUP BY term)"""
_Q_TERMS = f"qt AS (SELECT qid, term, count(*) AS qtf FROM (SELECT item_id AS qid, unnest({s_stems('text')}) AS term FROM benchmark) GROUP BY ALL)"
_BM25 = f"""{_D_TERMS}, {_Q_TERMS},
    sc AS (SELECT qid, doc_id, round(sum(qtf * ln(1 + (n - df + 0.5) / (df + 0.5)) * tf * 2.5 / (tf + 1.5 * (0.25 + 0.75 * l / al))), 6) AS score
           FROM qt JOIN dt USING (term) JOIN df USING (term) JOIN dl USING (doc_id), nd GROUP BY qid, doc_id),
    rk AS (SELECT *, row_number() OVER (PARTITION BY qid ORDER BY score DESC, doc_id) AS rank FROM sc)"""
#: The query set of searches: every row whose id is divisible by 20, against all rows.
_QV = "SELECT vec_id AS qid, embedding AS qv FROM embeddings WHERE vec_id % 20 = 0"
_COS = "list_cosine_similarity(list_transform({0}, lambda x: CAST(x AS DOUBLE)), list_transform({1}, lambda x: CAST(x AS DOUBLE)))"


# ---- vectors ---------------------------------------------------------------------------------------------------------
def first_vector(e: DataFrame) -> DataFrame:
    return e.where("vec_id = 0").select(F.col("vec_id").alias("qid"), F.col("embedding").alias("qv"))


def one_query(e: DataFrame, items: DataFrame, k: int) -> DataFrame:
    """The search of one vector, as a single request asks: no window, each task keeps its k best. Many queries are
    vec_batch_topk."""
    found = first_vector(e).first()  # one row
    return retrieve.top_k(items, found["qv"] if found else [], k).select("vec_id", F.round("score", 6).alias("score"))


_ONE = "WITH q AS (SELECT embedding AS qv FROM embeddings WHERE vec_id = 0) SELECT vec_id, round(" + _COS.format("embedding", "qv") + ", 6) AS score FROM embeddings, q {} ORDER BY " + _COS.format("embedding", "qv") + " DESC, vec_id LIMIT 10"


@query(_ONE.format(""))
def vec_topk_cosine(spark: SparkSession, d: str) -> DataFrame:
    e = read(spark, d, "embeddings")
    return one_query(e, e, 10)


@query(_ONE.format("WHERE label = 3"))
def vec_topk_filtered(spark: SparkSession, d: str) -> DataFrame:
    e = read(spark, d, "embeddings")
    return one_query(e, e.where("label = 3"), 10)


@query(_ONE.format("WHERE vec_id IN (SELECT doc_id FROM labels WHERE quality = 1)"))
def vec_topk_idset(spark: SparkSession, d: str) -> DataFrame:
    e = read(spark, d, "embeddings")
    ids = read(spark, d, "labels").where("quality = 1").select("doc_id")
    return one_query(e, retrieve.apply(e.withColumn("is_active", F.lit(True)), retrieve.Filters(ids=ids), key="vec_id"), 10)


def query_vectors(e: DataFrame) -> DataFrame:
    """The query set of searches: every row whose id is divisible by 20."""
    return e.where("vec_id % 20 = 0").select(F.col("vec_id").alias("qid"), F.col("embedding").alias("qv"))


_BATCH = f"WITH q AS ({_QV}), s AS (SELECT qid, vec_id, {_COS.format('embedding', 'qv')} AS score FROM embeddings, q), r AS (SELECT *, row_number() OVER (PARTITION BY qid ORDER BY score DESC, vec_id) AS rank FROM s)"


@query(_BATCH + " SELECT qid, rank, vec_id, round(score, 6) AS score FROM r WHERE rank <= 10")
def vec_batch_topk(spark: SparkSession, d: str) -> DataFrame:
    e = read(spark, d, "embeddings")
    return retrieve.batch_top_k(e, query_vectors(e), 10).select("qid", "rank", "vec_id", F.round("score", 6).alias("score"))


@query(_BATCH + ", p AS (SELECT r.*, label FROM r JOIN embeddings USING (vec_id) WHERE rank <= 15), o AS (SELECT *, row_number() OVER (PARTITION BY qid ORDER BY (label = 3) DESC, score DESC, vec_id) AS place FROM p) SELECT qid, place, vec_id, round(score, 6) AS score FROM o WHERE place <= 5")
def vec_overfetch_rerank(spark: SparkSession, d: str) -> DataFrame:
    e = read(spark, d, "embeddings")
    pool = retrieve.batch_top_k(e, query_vectors(e), 15).join(e.select("vec_id", "label"), "vec_id")
    order = F.row_number().over(Window.partitionBy("qid").orderBy(F.desc(F.col("label") == 3), F.desc("score"), "vec_id"))
    return pool.withColumn("place", order).where("place <= 5").select("qid", "place", "vec_id", F.round("score", 6).alias("score"))


@query("WITH q AS (SELECT embedding AS qv FROM embeddings WHERE vec_id = 0) SELECT vec_id, round(greatest(0, least(1, " + _COS.format("embedding", "qv") + ")), 6) AS score FROM embeddings, q")
def vec_cosine_clamped(spark: SparkSession, d: str) -> DataFrame:
    e = read(spark, d, "embeddings")
    return e.crossJoin(F.broadcast(first_vector(e).limit(1))).select("vec_id", F.round(fv.cosine_clamped(F.col("embedding"), F.col("qv")), 6).alias("score"))


_NORM = "sqrt(list_sum(list_transform(embedding, lambda x: CAST(x AS DOUBLE) * CAST(x AS DOUBLE))))"


@query(f"SELECT count(*) AS n, min(len(embedding)) AS min_dims, max(len(embedding)) AS max_dims, round(min({_NORM}), 6) AS min_norm, round(max({_NORM}), 6) AS max_norm FROM embeddings")
def vec_dims_norms(spark: SparkSession, d: str) -> DataFrame:
    n = fv.norm(F.col("embedding"))
    return read(spark, d, "embeddings").agg(F.count("*").alias("n"), F.min(F.size("embedding")).alias("min_dims"), F.max(F.size("embedding")).alias("max_dims"), F.round(F.min(n), 6).alias("min_norm"), F.round(F.max(n), 6).alias("max_norm"))


@query(f"SELECT vec_id, unnest(range(len(embedding))) AS pos, round(unnest(list_transform(embedding, lambda x: CAST(x AS DOUBLE) / {_NORM})), 6) AS value FROM embeddings")
def vec_l2_normalize(spark: SparkSession, d: str) -> DataFrame:
    unit = read(spark, d, "embeddings").select("vec_id", F.posexplode(fv.l2_normalize(F.col("embedding"))).alias("pos", "v"))
    return unit.select("vec_id", F.col("pos").cast("bigint").alias("pos"), F.round("v", 6).alias("value"))


@query("SELECT label, pos, round(avg(v), 6) AS mean FROM (SELECT label, unnest(range(len(embedding))) AS pos, CAST(unnest(embedding) AS DOUBLE) AS v FROM embeddings) GROUP BY label, pos")
def vec_mean_pool_by_label(spark: SparkSession, d: str) -> DataFrame:
    e = read(spark, d, "embeddings").select("label", F.posexplode("embedding").alias("pos", "v"))
    return e.groupBy("label", F.col("pos").cast("bigint").alias("pos")).agg(F.round(F.avg(F.col("v").cast("double")), 6).alias("mean"))


@query("SELECT doc_id, row_number() OVER (ORDER BY score DESC, city DESC, cat DESC, doc_id) AS place FROM (SELECT doc_id, round(n_chars / 1000.0, 0) AS score, CAST(lower(source) = 'src3' AS INT) AS city, CAST(lower(lang) = 'en' AS INT) AS cat FROM documents) ORDER BY place LIMIT 50")
def vec_tie_boost(spark: SparkSession, d: str) -> DataFrame:
    rows = read(spark, d, "documents").select("doc_id", F.round(F.col("n_chars") / 1000.0, 0).alias("score"), F.col("source").alias("city"), F.col("lang").alias("category"))
    top = rows.orderBy(*retrieve.tie_boost(rows, "src3", "en"), "doc_id").limit(50)  # 50 rows are numbered in one task
    w = Window.orderBy(*retrieve.tie_boost(rows, "src3", "en"), "doc_id")
    return top.select("doc_id", F.row_number().over(w).cast("bigint").alias("place"))


_TOKENS = f"CASE WHEN len({s_filtered('text')}) > 0 THEN {s_filtered('text')} ELSE {s_raw('text')} END"


@query(f"""WITH t AS (SELECT item_id, unnest({_TOKENS}) AS token FROM benchmark),
    v AS (SELECT item_id, pos, sum(CAST('0x' || substr(sha256(token), CAST((pos % 32) * 2 + 1 AS INT), 2) AS INT) / 255.0 * 2 - 1) AS v FROM t, range(300) r(pos) GROUP BY ALL),
    n AS (SELECT item_id, sqrt(sum(v * v)) AS n FROM v GROUP BY item_id)
    SELECT b.item_id, r.pos, round(coalesce(v / n, 0), 6) + 0.0 AS value FROM benchmark b CROSS JOIN range(300) r(pos) LEFT JOIN v ON v.item_id = b.item_id AND v.pos = r.pos LEFT JOIN n ON n.item_id = b.item_id""")
def hash_embed(spark: SparkSession, d: str) -> DataFrame:
    vectors = embed.HashEmbedder(300).embed(read(spark, d, "benchmark"), "text").select("item_id", F.posexplode("embedding").alias("pos", "v"))
    return vectors.select("item_id", F.col("pos").cast("bigint").alias("pos"), F.round("v", 6).alias("value"))


# ---- text ------------------------------------------------------------------------------------------------------------
@query(f"SELECT doc_id, {s_clean('text')} AS cleaned FROM documents")
def txt_clean(spark: SparkSession, d: str) -> DataFrame:
    return read(spark, d, "documents").select("doc_id", ft.clean(F.col("text")).alias("cleaned"))


@query(f"SELECT doc_id, {s_norm('text')} AS normalized FROM documents")
def txt_normalize(spark: SparkSession, d: str) -> DataFrame:
    return read(spark, d, "documents").select("doc_id", ft.normalize(F.col("text")).alias("normalized"))


@query(f"SELECT doc_id, array_to_string({s_filtered('text')}, ' ') AS tokens FROM documents")
def txt_tokens(spark: SparkSession, d: str) -> DataFrame:
    return read(spark, d, "documents").select("doc_id", F.array_join(F.filter(ft.raw_tokens(F.col("text")), ft._wanted), " ").alias("tokens"))


@query(f"SELECT doc_id, array_to_string({s_stems('text')}, ' ') AS stems FROM documents")
def txt_stem(spark: SparkSession, d: str) -> DataFrame:
    return read(spark, d, "documents").select("doc_id", F.array_join(ft.ranking_tokens(F.col("text")), " ").alias("stems"))


@query(f"SELECT conv_id, turn, array_to_string(CASE WHEN len({s_filtered('text')}) > 0 THEN {s_filtered('text')} ELSE {s_raw('text')} END, ' ') AS tokens FROM conversations")
def txt_semantic_tokens_fallback(spark: SparkSession, d: str) -> DataFrame:
    return read(spark, d, "conversations").select("conv_id", "turn", F.array_join(ft.embedding_tokens(F.col("text")), " ").alias("tokens"))


# ---- term statistics and ranking -------------------------------------------------------------------------------------
def doc_terms(spark: SparkSession, d: str) -> DataFrame:
    return rank.terms(read(spark, d, "documents"), "doc_id", "text")


def corpus(spark: SparkSession, d: str) -> rank.Corpus:
    return rank.Corpus.of(read(spark, d, "documents"), "doc_id", "text")


def query_terms(spark: SparkSession, d: str) -> DataFrame:
    return rank.terms(read(spark, d, "benchmark"), "item_id", "text").select(F.col("item_id").alias("qid"), "term", F.col("tf").alias("qtf"))


@query(f"WITH {_D_TERMS} SELECT doc_id, term, tf FROM dt")
def tf(spark: SparkSession, d: str) -> DataFrame:
    return doc_terms(spark, d).select("doc_id", "term", "tf")


@query(f"WITH {_D_TERMS} SELECT term, df FROM df")
def df(spark: SparkSession, d: str) -> DataFrame:
    tokens = read(spark, d, "documents").select(F.array_distinct(ft.ranking_tokens(F.col("text"))).alias("t"))
    # An outer explode: for an inner one Spark would test the array's size first, and cut each text a second time for that.
    return rank.document_frequency(tokens.select(F.explode_outer("t").alias("term")).where("term is not null"))


@query(f"WITH {_D_TERMS} SELECT term, round(ln(1 + (n - df + 0.5) / (df + 0.5)), 6) AS idf FROM df, nd")
def idf_bm25(spark: SparkSession, d: str) -> DataFrame:
    c = corpus(spark, d)
    return rank.document_frequency(c.terms).crossJoin(F.broadcast(c.facts)).select("term", F.round(rank.bm25_idf(F.col("n"), F.col("df")), 6).alias("idf"))  # facts are one row


@query(f"WITH {_D_TERMS} SELECT term, round(ln(n / df), 6) AS idf FROM df, nd")
def idf_tfidf(spark: SparkSession, d: str) -> DataFrame:
    c = corpus(spark, d)
    return rank.document_frequency(c.terms).crossJoin(F.broadcast(c.facts)).select("term", F.round(F.log(F.col("n") / F.col("df")), 6).alias("idf"))  # facts are one row


@query(f"WITH {_D_TERMS} SELECT n, round(al, 6) AS avg_len FROM nd")
def avg_doc_len(spark: SparkSession, d: str) -> DataFrame:
    return rank.lengths(read(spark, d, "documents"), "doc_id", "text").agg(F.count("*").alias("n"), F.round(F.avg("len"), 6).alias("avg_len"))


def bm25_scores(spark: SparkSession, d: str, k: int, c: rank.Corpus | None = None) -> DataFrame:
    c = c or corpus(spark, d)
    return rank.best(rank.bm25(query_terms(spark, d), c.terms, c.facts), k, digits=6)


@query(f"WITH {_BM25} SELECT qid, rank, doc_id, score FROM rk WHERE rank <= 10")
def bm25_topk(spark: SparkSession, d: str) -> DataFrame:
    return bm25_scores(spark, d, 10).select("qid", "rank", "doc_id", "score")


_PASSAGE_VECTORS = "SELECT vec_id AS qid, embedding AS qv FROM embeddings WHERE vec_id IN (SELECT item_id FROM benchmark)"
_POOL = f"""pool AS (SELECT qid, vec_id AS doc_id, rank, score FROM ({_BATCH.replace(_QV, _PASSAGE_VECTORS)} SELECT qid, vec_id, rank, score FROM r WHERE rank <= 30) JOIN documents ON doc_id = vec_id),
    t0 AS (SELECT doc_id, {s_stems('text')} AS t FROM documents WHERE doc_id IN (SELECT doc_id FROM pool)),
    pd AS (SELECT qid, doc_id, t FROM pool JOIN t0 USING (doc_id)), st AS (SELECT qid, count(*) AS n, avg(len(t)) AS al FROM pd GROUP BY qid),
    pt AS (SELECT qid, doc_id, len(t) AS l, term, count(*) AS tf FROM (SELECT qid, doc_id, t, unnest(t) AS term FROM pd) GROUP BY ALL),
    pf AS (SELECT qid, term, count(*) AS df FROM pt GROUP BY ALL), {_Q_TERMS}"""


_RERANKED = """, o AS (SELECT p.qid, p.doc_id, p.rank AS was, p.score AS vector_score, round(coalesce(s, 0), 6) AS score FROM pool p LEFT JOIN sc USING (qid, doc_id)),
    rr AS (SELECT *, row_number() OVER (PARTITION BY qid ORDER BY score DESC, round(vector_score, 9) DESC, was) AS rank FROM o)"""
_POOL_BM25 = f"""{_POOL}, sc AS (SELECT qid, doc_id, sum(qtf * ln(1 + (n - df + 0.5) / (df + 0.5)) * tf * 2.5 / (tf + 1.5 * (0.25 + 0.75 * l / al))) AS s
    FROM qt JOIN pt USING (qid, term) JOIN pf USING (qid, term) JOIN st USING (qid) GROUP BY qid, doc_id){_RERANKED}"""


def passage_pool(spark: SparkSession, d: str) -> tuple[DataFrame, DataFrame, DataFrame]:
    """The 30 nearest documents of each passage (the vector with a passage's id is its own), and their terms and lengths."""
    e, scratch = read(spark, d, "embeddings"), Scratch(spark)
    passages = e.join(read(spark, d, "benchmark").select(F.col("item_id").alias("vec_id")), "vec_id", "left_semi")
    near = retrieve.batch_top_k(e, passages.select(F.col("vec_id").alias("qid"), F.col("embedding").alias("qv")), 30).select("qid", F.col("vec_id").alias("doc_id"), "rank", F.round("score", 9).alias("score"))
    docs = read(spark, d, "documents")
    near = scratch.keep(near.join(docs.select("doc_id"), "doc_id", "left_semi"))
    held = scratch.keep(rank.counted(docs.join(near.select("doc_id").distinct(), "doc_id", "left_semi"), "doc_id", "text"))
    return near, held.where("term is not null").select("doc_id", "term", "tf", "len"), held.where("first").select("doc_id", "len")


@query(f"WITH {_POOL_BM25} SELECT qid, doc_id, score FROM o WHERE score > 0")
def bm25_candidates_idf(spark: SparkSession, d: str) -> DataFrame:
    """BM25 whose idf and mean length are those of each query's own candidates."""
    near, doc_terms_, lens = passage_pool(spark, d)
    scored = rank.rerank_bm25(query_terms(spark, d), near, doc_terms_, lens, key="doc_id")
    return scored.select("qid", "doc_id", F.round("rank_score", 6).alias("score")).where("score > 0")


@query(f"WITH {_POOL_BM25} SELECT qid, rank, doc_id, score, vector_score FROM rr WHERE rank <= 10".replace(", vector_score FROM", ", round(vector_score, 6) AS vector_score FROM"))
def bm25_rerank(spark: SparkSession, d: str) -> DataFrame:
    """The ten best candidates: those that share no term score 0 and are ranked by their vector score."""
    near, doc_terms_, lens = passage_pool(spark, d)
    best = rank.ranked(rank.rerank_bm25(query_terms(spark, d), near, doc_terms_, lens, key="doc_id"), 10, digits=6)
    return best.select("qid", "rank", "doc_id", F.round("score", 6).alias("score"), F.round("vector_score", 6).alias("vector_score"))


@query(f"""WITH {_POOL}, idf AS (SELECT qid, term, ln(n / df) AS idf FROM pf JOIN st USING (qid)),
    ql AS (SELECT qid, sum(qtf) AS s FROM qt GROUP BY qid), qw AS (SELECT qid, term, qtf / s * idf AS qw FROM qt JOIN ql USING (qid) JOIN idf USING (qid, term)),
    dw AS (SELECT qid, doc_id, term, tf / l * idf AS w FROM pt JOIN idf USING (qid, term)), qn AS (SELECT qid, sqrt(sum(qw * qw)) AS qn FROM qw GROUP BY qid), dn AS (SELECT qid, doc_id, sqrt(sum(w * w)) AS dn FROM dw GROUP BY ALL),
    sc AS (SELECT qid, doc_id, sum(qw * w) / nullif(max(dn * qn), 0) AS s FROM qw JOIN dw USING (qid, term) JOIN dn USING (qid, doc_id) JOIN qn USING (qid) GROUP BY qid, doc_id){_RERANKED}
    SELECT qid, rank, doc_id, score FROM rr WHERE rank <= 10""")
def tfidf_rerank(spark: SparkSession, d: str) -> DataFrame:
    near, doc_terms_, lens = passage_pool(spark, d)
    best = rank.ranked(rank.rerank_tfidf(query_terms(spark, d), near, doc_terms_, lens, key="doc_id"), 10, digits=6)
    return best.select("qid", "rank", "doc_id", F.round("score", 6).alias("score"))


@query(f"""WITH {_D_TERMS}, {_Q_TERMS}, idf AS (SELECT term, ln(n / df) AS idf FROM df, nd),
    dw AS (SELECT doc_id, term, tf / l * idf AS w FROM dt JOIN dl USING (doc_id) JOIN idf USING (term)), ql AS (SELECT qid, sum(qtf) AS s FROM qt GROUP BY qid),
    qw AS (SELECT qid, term, qtf / s * idf AS qw FROM qt JOIN ql USING (qid) JOIN idf USING (term)), dn AS (SELECT doc_id, sqrt(sum(w * w)) AS dn FROM dw GROUP BY doc_id),
    qn AS (SELECT qid, sqrt(sum(qw * qw)) AS qn FROM qw GROUP BY qid),
    sc AS (SELECT qid, doc_id, round(sum(qw * w) / max(dn * qn), 6) AS score FROM qw JOIN dw USING (term) JOIN dn USING (doc_id) JOIN qn USING (qid) WHERE dn > 0 AND qn > 0 GROUP BY qid, doc_id),
    rk AS (SELECT *, row_number() OVER (PARTITION BY qid ORDER BY score DESC, doc_id) AS rank FROM sc) SELECT qid, rank, doc_id, score FROM rk WHERE rank <= 10""")
def tfidf_cosine_topk(spark: SparkSession, d: str) -> DataFrame:
    c = corpus(spark, d)
    return rank.best(rank.tfidf(query_terms(spark, d), c.terms, c.facts), 10, digits=6).select("qid", "rank", "doc_id", "score")


@query(f"WITH q AS (SELECT item_id AS qid, list_distinct({s_stems('text')}) AS t FROM benchmark), d AS (SELECT doc_id, list_distinct({s_stems('text')}) AS t FROM documents), dt AS (SELECT doc_id, unnest(t) AS term FROM d), qt AS (SELECT qid, unnest(t) AS term FROM q) SELECT qid, doc_id, count(*) AS shared FROM qt JOIN dt USING (term) GROUP BY qid, doc_id HAVING count(*) >= 10")
def term_intersection(spark: SparkSession, d: str) -> DataFrame:
    met = query_terms(spark, d).join(doc_terms(spark, d), "term")
    return met.groupBy("qid", "doc_id").agg(F.count("*").alias("shared")).where("shared >= 10")


# ---- evaluation ------------------------------------------------------------------------------------------------------
def contained(docs: DataFrame, passages: DataFrame) -> DataFrame:
    """qid, doc_id of every document (doc_id, text) that contains a passage (qid, p) as a part of its text.

    The inner words of a passage, all but its first and last, stand as whole words in such a document. Passages of five words or
    more meet documents on their second to fourth word together, those of three and four on their second word, so passages and
    documents are never all paired. Shorter passages have no inner word: they are counted, and a table of at most
    retrieve.BROADCAST_QUERIES of them is broadcast; a larger one meets the documents in blocks. An empty passage asks for nothing.
    """
    cut = passages.select("qid", "p", F.split("p", " ").alias("w")).withColumn("n", F.size("w"))
    words = docs.select("doc_id", F.split("text", " ").alias("w"))
    threes = words.select("doc_id", F.explode_outer(F.array_distinct(F.expr("transform(sequence(1, greatest(1, size(w) - 2)), i -> array_join(slice(w, i, 3), ' '))"))).alias("key"))
    long = cut.where("n >= 5").select("qid", "p", F.array_join(F.slice("w", 2, 3), " ").alias("key"))
    met = threes.join(long, "key").select("doc_id", "qid", "p")
    some = cut.where("n between 3 and 4").select("qid", "p", F.col("w")[1].alias("key"))
    if some.limit(1).count():
        met = met.unionByName(words.select("doc_id", F.explode_outer(F.array_distinct("w")).alias("key")).join(some, "key").select("doc_id", "qid", "p"))
    found = met.distinct().join(docs.select("doc_id", "text"), "doc_id").where(F.contains("text", "p")).select("qid", "doc_id")
    short = cut.where("n < 3 and p <> ''").select("qid", "p")
    if n := short.count():
        if n <= retrieve.BROADCAST_QUERIES:
            pairs = docs.crossJoin(F.broadcast(short))
        else:
            blocks, parts = -(-n // max(1, retrieve.BROADCAST_QUERIES)), docs.sparkSession.sparkContext.defaultParallelism
            upto = lambda n: F.explode(F.sequence(F.lit(0), F.lit(n - 1)))
            dealt = docs.withColumn("_s", F.pmod(F.xxhash64("doc_id"), F.lit(parts)).cast("int")).withColumn("_b", upto(blocks))
            pairs = dealt.join(short.withColumn("_b", F.pmod(F.xxhash64("qid"), F.lit(blocks)).cast("int")).withColumn("_s", upto(parts)), ["_b", "_s"])
        found = found.unionByName(pairs.where(F.contains("text", "p")).select("qid", "doc_id"))
    return found


def qrels(spark: SparkSession, d: str) -> DataFrame:
    """A document that contains a passage is relevant to it, with grade 3 if it is labelled good and 1 otherwise."""
    passages = read(spark, d, "benchmark").select(F.col("item_id").alias("qid"), F.col("text").alias("p"))
    quality = read(spark, d, "labels").groupBy("doc_id").agg(F.max("quality").alias("quality"))
    found = contained(read(spark, d, "documents").select("doc_id", "text"), passages)
    return found.join(quality, "doc_id", "left").select("qid", "doc_id", (1 + 2 * F.coalesce("quality", F.lit(0))).alias("grade"))


_EVAL = f"""{_BM25}, top AS (SELECT qid, doc_id, rank FROM rk WHERE rank <= 10),
    qrels AS (SELECT item_id AS qid, doc_id, 1 + 2 * coalesce(quality, 0) AS grade FROM benchmark b JOIN documents x ON contains(x.text, b.text) LEFT JOIN labels USING (doc_id)),
    j AS (SELECT t.qid, t.doc_id, rank, coalesce(grade, 0) AS grade FROM top t LEFT JOIN qrels USING (qid, doc_id)),
    h AS (SELECT *, sum(CAST(grade > 0 AS INT)) OVER (PARTITION BY qid ORDER BY rank) AS hits FROM j),
    f AS (SELECT qid, sum(CAST(grade > 0 AS INT)) AS n_hits, min(CASE WHEN grade > 0 THEN rank END) AS first, sum(CASE WHEN grade > 0 THEN hits / rank ELSE 0 END) AS ap, sum((pow(2, grade) - 1) / log2(rank + 1)) AS dcg FROM h GROUP BY qid),
    g AS (SELECT *, row_number() OVER (PARTITION BY qid ORDER BY grade DESC, doc_id) AS r FROM qrels),
    i AS (SELECT qid, count(*) FILTER (grade > 0) AS rel, sum(CASE WHEN r <= 10 THEN (pow(2, grade) - 1) / log2(r + 1) ELSE 0 END) AS idcg FROM g GROUP BY qid),
    m AS (SELECT b.item_id AS qid, coalesce(n_hits / 10, 0) AS precision, CASE WHEN rel > 0 THEN coalesce(n_hits, 0) / rel ELSE 0 END AS recall, coalesce(1 / first, 0) AS mrr,
          CASE WHEN rel > 0 THEN coalesce(ap, 0) / rel ELSE 0 END AS ap, CASE WHEN idcg > 0 THEN coalesce(dcg, 0) / idcg ELSE 0 END AS ndcg
          FROM benchmark b LEFT JOIN f ON f.qid = b.item_id LEFT JOIN i ON i.qid = b.item_id)"""


def per_query(spark: SparkSession, d: str) -> DataFrame:
    return metrics.evaluate(read(spark, d, "benchmark").select(F.col("item_id").alias("qid")), bm25_scores(spark, d, 10), qrels(spark, d), 10)


@query(f"WITH {_EVAL} SELECT qid, round(precision, 6) AS precision, round(recall, 6) AS recall FROM m")
def precision_recall(spark: SparkSession, d: str) -> DataFrame:
    return per_query(spark, d).select("qid", F.round("precision", 6).alias("precision"), F.round("recall", 6).alias("recall"))


@query(f"WITH {_EVAL} SELECT qid, round(mrr, 6) AS mrr FROM m")
def mrr(spark: SparkSession, d: str) -> DataFrame:
    return per_query(spark, d).select("qid", F.round("mrr", 6).alias("mrr"))


@query(f"WITH {_EVAL} SELECT qid, round(ap, 6) AS ap FROM m")
def mean_average_precision(spark: SparkSession, d: str) -> DataFrame:
    return per_query(spark, d).select("qid", F.round("ap", 6).alias("ap"))


@query(f"WITH {_EVAL} SELECT qid, round(ndcg, 6) AS ndcg FROM m")
def ndcg(spark: SparkSession, d: str) -> DataFrame:
    return per_query(spark, d).select("qid", F.round("ndcg", 6).alias("ndcg"))


@query(f"WITH {_EVAL} SELECT round(avg(precision), 6) AS precision, round(avg(recall), 6) AS recall, round(avg(mrr), 6) AS mrr, round(avg(ap), 6) AS ap, round(avg(ndcg), 6) AS ndcg FROM m")
def macro_avg(spark: SparkSession, d: str) -> DataFrame:
    return metrics.macro(per_query(spark, d)).select(*(F.round(c, 6).alias(c) for c in ("precision", "recall", "mrr", "ap", "ndcg")))


@query(_BATCH + ", m AS (SELECT * FROM r WHERE rank <= 15) SELECT qid, count(*) AS candidate_count, count(*) FILTER (rank <= 5) AS returned_count, count(*) FILTER (rank <= 5 AND score > 0) AS nonzero_count, round(min(score) FILTER (rank <= 5), 6) AS min_score, round(max(score) FILTER (rank <= 5), 6) AS max_score, round(avg(score) FILTER (rank <= 5), 6) AS mean_score FROM m GROUP BY qid")
def query_score_stats(spark: SparkSession, d: str) -> DataFrame:
    """All figures but the number of candidates are over the five returned rows."""
    e = read(spark, d, "embeddings")
    found = retrieve.batch_top_k(e, query_vectors(e), 15)
    s = metrics.score_stats(query_vectors(e), found, found.where("rank <= 5"))
    return s.select("qid", "candidate_count", "returned_count", "nonzero_count", *(F.round(c, 6).alias(c) for c in ("min_score", "max_score", "mean_score")))


@query(f"WITH {_BM25}, c AS (SELECT DISTINCT k.qid, dt.term FROM rk k JOIN dt USING (doc_id) WHERE k.rank <= 10) SELECT qt.qid, count(*) AS query_terms, count(c.term) AS matched_terms, round(count(c.term) / count(*), 6) AS coverage FROM qt LEFT JOIN c ON c.qid = qt.qid AND c.term = qt.term GROUP BY qt.qid")
def query_coverage(spark: SparkSession, d: str) -> DataFrame:
    c = corpus(spark, d)
    met = metrics.coverage(query_terms(spark, d), bm25_scores(spark, d, 10, c), c.terms, key="doc_id")
    return met.withColumn("coverage", F.round("coverage", 6))


@query(_BATCH + " SELECT qid, CASE WHEN max(score) <= 0.3 THEN 'no_match' WHEN max(score) < 0.5 THEN 'low_confidence' ELSE 'confident' END AS match_quality FROM r WHERE vec_id <> qid GROUP BY qid")
def match_quality(spark: SparkSession, d: str) -> DataFrame:
    e = read(spark, d, "embeddings")
    top = retrieve.batch_top_k(e, query_vectors(e), 2).where("vec_id <> qid").groupBy("qid").agg(F.max("score").alias("top"))
    return top.select("qid", metrics.match_quality(F.col("top")).alias("match_quality"))


# ---- documents and hashes --------------------------------------------------------------------------------------------
_W = "list_transform(range({1}), lambda i: {0})"


@query("SELECT p_partkey, concat_ws(' ', p_name, p_type, p_type, p_type, p_type, p_brand, p_brand, p_brand, p_brand, p_brand, p_brand) AS document FROM (SELECT p_partkey, " + ", ".join(f"nullif({s_clean(c)}, '') AS {c}" for c in ("p_name", "p_type", "p_brand")) + " FROM part)")
def weighted_doc(spark: SparkSession, d: str) -> DataFrame:
    w = dict(fd.PLACE_WEIGHTS)
    return read(spark, d, "part").select("p_partkey", fd.weighted_document([(F.col("p_name"), w["name"]), (F.col("p_type"), w["category"]), (F.lit(None).cast("string"), w["description"]), (F.col("p_brand"), w["tags"])]).alias("document"))


def tag_catalogue(spark: SparkSession) -> DataFrame:
    """A small made catalogue: ids 1 to 40, every third missing."""
    return spark.range(1, 41).where("id % 3 <> 0").select(F.col("id").cast("int").alias("id"), F.concat(F.lit("Tag_"), F.col("id")).alias("name"), F.concat(F.lit("kind"), F.col("id") % 4).alias("category"))


@query("""WITH c AS (SELECT i AS id, 'Tag ' || i AS name, 'kind' || (i % 4) AS category FROM range(1, 41) t(i) WHERE i % 3 <> 0)
    SELECT p_partkey, coalesce(c.name || ', ', '') || p_brand AS names, p_size || CASE WHEN p_size % 5 = 0 THEN ',9999' ELSE '' END AS ids, coalesce(c.category, '') AS categories,
        concat_ws(',', CASE WHEN c.id IS NULL THEN CAST(p_size AS VARCHAR) END, CASE WHEN p_size % 5 = 0 THEN '9999' END) AS unknown FROM part LEFT JOIN c ON c.id = p_size""")
def tag_resolve(spark: SparkSession, d: str) -> DataFrame:
    more = F.when(F.col("p_size") % 5 == 0, F.lit("9999"))
    rows = read(spark, d, "part").select("p_partkey", F.array_compact(F.array(F.col("p_size").cast("string"), "p_brand", more, F.upper("p_brand"))).alias("tags"))
    t = fd.resolve_tags(rows, tag_catalogue(spark), "p_partkey", "tags")
    return t.select("p_partkey", F.array_join("tag_names", ", ").alias("names"), F.array_join("tag_ids", ",").alias("ids"), F.array_join("tag_categories", ",").alias("categories"), F.array_join("unknown_tag_ids", ",").alias("unknown"))


@query("SELECT p_partkey, CASE p_size % 4 WHEN 0 THEN '" + fd.CATEGORY_PROFILES["cafe"] + "' WHEN 1 THEN '" + fd.CATEGORY_PROFILES["park"] + "' ELSE replace(lower(p_type), '_', ' ') END AS category FROM part")
def category_expand(spark: SparkSession, d: str) -> DataFrame:
    label = F.when(F.col("p_size") % 4 == 0, "Cafe").when(F.col("p_size") % 4 == 1, "PARK").otherwise(F.col("p_type"))
    return read(spark, d, "part").select("p_partkey", fd.expand_category(label).alias("category"))


@query("SELECT event_id, coalesce(json_extract_string(props, '$.name'), json_extract_string(props, '$.k'), 'none') AS value FROM events")
def first_present(spark: SparkSession, d: str) -> DataFrame:
    return read(spark, d, "events").select("event_id", fd.first_present(F.get_json_object("props", "$.name"), F.get_json_object("props", "$.k"), default="none").alias("value"))


@query("SELECT p_partkey, '{\"name\":\"' || p_name || '\"' || CASE WHEN p_size % 2 = 0 THEN ',\"brand\":\"' || p_brand || '\"' ELSE '' END || ',\"size\":' || p_size || '}' AS metadata FROM part")
def sparse_metadata_json(spark: SparkSession, d: str) -> DataFrame:
    brand = F.when(F.col("p_size") % 2 == 0, F.col("p_brand")).when(F.col("p_size") % 3 == 0, F.lit(""))
    return read(spark, d, "part").select("p_partkey", fd.sparse_json(name=F.col("p_name"), brand=brand, size=F.col("p_size")).alias("metadata"))


_HASH = "sha256('{{\"lang\":\"' || lang || '\",\"n_chars\":' || n_chars || ',\"source\":\"' || source || '\"}}')".replace("{{", "{").replace("}}", "}")


@query(f"SELECT doc_id, {_HASH} AS content_hash FROM documents")
def content_hash(spark: SparkSession, d: str) -> DataFrame:
    return read(spark, d, "documents").select("doc_id", fd.content_hash(source=F.col("source"), lang=F.col("lang"), n_chars=F.col("n_chars")).alias("content_hash"))


@query("SELECT doc_id, sha256('{\"embedding_dimension\":300,\"embedding_model\":\"hash\",\"embedding_version\":\"v1\",\"source_content_hash\":\"' || " + _HASH + " || '\"}') AS content_hash FROM documents")
def versioned_hash(spark: SparkSession, d: str) -> DataFrame:
    source = fd.content_hash(source=F.col("source"), lang=F.col("lang"), n_chars=F.col("n_chars"))
    return read(spark, d, "documents").select("doc_id", fd.versioned_hash(source, "hash", "v1", 300).alias("content_hash"))


_PLACE_RECORD = """
    WITH c AS (SELECT i AS id, 'Tag ' || i AS name, 'kind' || (i % 4) AS category FROM range(1, 41) t(i) WHERE i % 3 <> 0),
    f AS (SELECT p_partkey, p_name AS name, CASE WHEN p_size % 2 = 0 THEN 'cafe' ELSE p_type END AS category, p_type AS description, p_size, c.name AS tag, c.category AS kind, p_size % 5 <> 0 AS active,
                 CASE WHEN p_size % 3 = 1 THEN p_brand END AS city FROM part LEFT JOIN c ON c.id = p_size),
    g AS (SELECT *, CASE WHEN category = 'cafe' THEN '{cafe}' ELSE replace(lower(category), '_', ' ') END AS words, concat_ws(' ', tag, 'Rojo vivo') AS tags, concat_ws(',', tag, 'Rojo vivo') AS listed FROM f),
    h AS (SELECT *, concat_ws(' ', name, words, words, words, words, description, description, description, tags, tags, tags, tags, tags, tags) AS document,
            '{{"category":"' || category || '"' || coalesce(',"city":"' || city || '"', '') || ',"is_active":' || active || ',"name":"' || name || '","semantic_document_version":"weighted-tags-v2","short_description":"' || description || '","state":"Chiapas"'
            || coalesce(',"tag_categories":["' || kind || '"]', '') || ',"tag_ids":[' || p_size || '],"tags":"' || listed || '"' || CASE WHEN tag IS NULL THEN ',"unknown_tag_ids":[' || p_size || ']' ELSE '' END || '}}' AS metadata FROM g)
    SELECT CAST(p_partkey AS VARCHAR) AS external_id, document, metadata, active AS is_active,
        sha256('{{"document":' || to_json(document) || ',"is_active":' || active || ',"metadata":' || metadata || ',"semantic_document_version":"weighted-tags-v2"}}') AS content_hash FROM h""".format(cafe=fd.CATEGORY_PROFILES["cafe"])


@query(_PLACE_RECORD)
def place_record(spark: SparkSession, d: str) -> DataFrame:
    """Source records of places, mapped whole: document, metadata and hash."""
    category = F.when(F.col("p_size") % 2 == 0, "cafe").otherwise(F.col("p_type"))
    fields = {"uuid": F.col("p_partkey"), "title": F.concat(F.lit(" "), "p_name"), "type": category, "summary": F.col("p_type"), "tags": F.array(F.col("p_size").cast("string"), F.lit("Rojo_vivo"), F.lit("ROJO VIVO")), "isActive": F.col("p_size") % 5 != 0, "municipality": F.when(F.col("p_size") % 3 == 1, F.col("p_brand")), "source": F.lit(""), "occasions": F.lit(" , ")}
    rows = read(spark, d, "part").select(F.col("p_partkey").cast("string").alias("id"), F.to_json(F.struct(*(c.alias(n) for n, c in fields.items()))).alias("record"))
    return records.place_records(rows, tag_catalogue(spark)).select("external_id", "document", "metadata", "is_active", "content_hash")


@query(f"""
    WITH f AS (SELECT conv_id || '-' || turn AS external_id, role AS title, CASE WHEN conv_id % 2 = 0 THEN 'Tuxtla' END AS city, turn % 3 <> 0 AS active, {s_clean("concat_ws(' ', role, CASE WHEN conv_id % 2 = 0 THEN 'Tuxtla' END, 'Chiapas', 'uno dos', text)")} AS document FROM conversations),
    g AS (SELECT *, '{{' || coalesce('"city":"' || city || '",', '') || '"is_active":' || active || ',"state":"Chiapas","tags":"uno,dos","title":"' || title || '"}}' AS metadata FROM f)
    SELECT external_id, document, metadata, active AS is_active, sha256('{{"document":' || to_json(document) || ',"is_active":' || active || ',"metadata":' || metadata || '}}') AS content_hash FROM g""")
def post_record(spark: SparkSession, d: str) -> DataFrame:
    """Source records of posts, mapped whole."""
    fields = {"name": F.col("role"), "city": F.when(F.col("conv_id") % 2 == 0, "Tuxtla"), "keywords": F.lit("uno, dos,"), "body": F.col("text"), "is_active": F.when(F.col("turn") % 3 == 0, 0).otherwise(1)}
    rows = read(spark, d, "conversations").select(F.concat_ws("-", "conv_id", "turn").alias("id"), F.to_json(F.struct(*(c.alias(n) for n, c in fields.items()))).alias("record"))
    return records.post_records(rows).select("external_id", "document", "metadata", "is_active", "content_hash")


# ---- projections -----------------------------------------------------------------------------------------------------
def stored(spark: SparkSession, d: str) -> DataFrame:
    """Rows as a table holds them: customers with a name or none, and metadata."""
    c = read(spark, d, "customer")
    meta = F.to_json(F.struct(F.when(F.col("c_custkey") % 2 == 0, F.col("c_name")).alias("name"), F.col("c_mktsegment").alias("category"), F.lit("x,y").alias("tags"), F.when(F.col("c_custkey") % 3 == 0, F.lit("")).alias("occasion")))
    return c.select(F.col("c_custkey").alias("external_id"), (F.col("c_acctbal") / 7).alias("score"), meta.alias("metadata"))


@query("SELECT CAST(c_custkey AS VARCHAR) AS id, CASE WHEN c_custkey % 2 = 0 THEN c_name ELSE CAST(c_custkey AS VARCHAR) END AS name, c_mktsegment AS category, round(c_acctbal / 7, 4) AS score, c_custkey % 3 = 0 AS has_occasion, FALSE AS filled_occasion FROM customer")
def place_candidates(spark: SparkSession, d: str) -> DataFrame:
    rows = fp.answered(fp.place_candidates(stored(spark, d)), "score")
    return rows.select("id", "name", "category", "score", fp.has_key("occasion").alias("has_occasion"), fp.has_text("occasion").alias("filled_occasion"))


@query("""SELECT CAST(c_custkey AS VARCHAR) AS id, '{"id":"' || c_custkey || '","name":"' || CASE WHEN c_custkey % 2 = 0 THEN c_name ELSE CAST(c_custkey AS VARCHAR) END || '","category":"' || c_mktsegment || '","city":null,"state":null,"price_range":null,"score":0.0,"tags":"x,y"' || CASE WHEN c_custkey % 3 = 0 THEN ',"occasion":""' ELSE '' END || '}' AS context FROM customer""")
def llm_context(spark: SparkSession, d: str) -> DataFrame:
    rows = fp.place_candidates(stored(spark, d).drop("score"))
    return rows.select("id", fp.llm_context().alias("context"))


@query("SELECT conv_id || '-' || turn AS id, role AS title, array_to_string(CASE WHEN turn % 2 = 0 THEN ['a', 'b'] ELSE ['c'] END, '|') AS tags FROM conversations")
def post_candidates(spark: SparkSession, d: str) -> DataFrame:
    meta = F.to_json(F.struct(F.lit("").alias("title"), F.col("role").alias("name"), F.when(F.col("turn") % 2 == 0, F.lit(" a ,, b")).alias("tags")))
    listed = F.to_json(F.struct(F.col("role").alias("title"), F.array(F.lit("c")).alias("tags")))
    rows = read(spark, d, "conversations").select(F.concat_ws("-", "conv_id", "turn").alias("id"), F.when(F.col("turn") % 2 == 0, meta).otherwise(listed).alias("metadata"))
    return fp.post_candidates(rows).select("id", "title", F.array_join("tags", "|").alias("tags"))


@query("SELECT user_id, array_to_string(list_sort(list(DISTINCT event_type)), ',') AS kinds, bool_and(value > 1) AS every_value, bool_or(value > 99) AS any_value FROM events GROUP BY user_id")
def sorted_ids(spark: SparkSession, d: str) -> DataFrame:
    """Sets of ids in order, and whether all or any rows of a group hold."""
    kinds = F.array_join(fp.sorted_ids(F.collect_set("event_type")), ",").alias("kinds")
    return read(spark, d, "events").groupBy("user_id").agg(kinds, F.every(F.col("value") > 1).alias("every_value"), F.some(F.col("value") > 99).alias("any_value"))


# ---- filters ---------------------------------------------------------------------------------------------------------
def places(spark: SparkSession, d: str) -> DataFrame:
    c, n, r = (read(spark, d, t) for t in ("customer", "nation", "region"))
    return c.join(n, c.c_nationkey == n.n_nationkey).join(r, n.n_regionkey == r.r_regionkey).select(
        F.col("c_custkey").alias("external_id"), F.col("n_name").alias("city"), F.col("r_name").alias("state"), F.col("c_mktsegment").alias("category"), F.when(F.col("c_acctbal") > 5000, "$$").otherwise("$").alias("price_range"), F.col("c_name").alias("occasion"), (F.col("c_acctbal") > 0).alias("is_active")
    )


_PLACES = "SELECT c_custkey AS external_id, n_name AS city, r_name AS state, c_mktsegment AS category, c_name AS occasion, c_acctbal > 0 AS is_active FROM customer JOIN nation ON c_nationkey = n_nationkey JOIN region ON n_regionkey = r_regionkey"


@query(f"SELECT external_id, city FROM ({_PLACES}) WHERE is_active AND lower(state) = lower((SELECT min(r_name) FROM region)) AND lower(category) = 'building'")
def filter_sql_mode(spark: SparkSession, d: str) -> DataFrame:
    state = read(spark, d, "region").agg(F.min("r_name")).first()[0]
    return retrieve.apply(places(spark, d), retrieve.Filters(state=state.lower(), category="Building")).select("external_id", "city")


@query(f"SELECT external_id, city FROM ({_PLACES}) WHERE NOT is_active AND lower(state) = lower((SELECT min(r_name) FROM region)) AND lower(category) = 'building'")
def filter_normalized_mode(spark: SparkSession, d: str) -> DataFrame:
    state = read(spark, d, "region").agg(F.min("r_name")).first()[0]
    return retrieve.apply(places(spark, d), retrieve.Filters(state=f"  {state.lower()} ", category="Buildíng", is_active=False), mode="normalized").select("external_id", "city")


@query("SELECT c_custkey AS external_id FROM customer JOIN nation ON c_nationkey = n_nationkey WHERE c_acctbal > 5000 AND lower(n_name) = lower((SELECT max(n_name) FROM nation))")
def filter_city_price(spark: SparkSession, d: str) -> DataFrame:
    city = read(spark, d, "nation").agg(F.max("n_name")).first()[0]
    return retrieve.apply(places(spark, d), retrieve.Filters(city=city.lower(), price_range="$$")).select("external_id")


@query("SELECT doc_id FROM documents WHERE source ILIKE '%SRC_1%'")
def occasion_ilike(spark: SparkSession, d: str) -> DataFrame:
    rows = read(spark, d, "documents").select(F.col("doc_id"), F.col("source").alias("occasion"), F.lit(True).alias("is_active"))
    return retrieve.apply(rows, retrieve.Filters(occasion="SRC_1")).select("doc_id")


@query("SELECT doc_id, lang FROM documents WHERE doc_id IN (SELECT doc_id FROM labels WHERE toxic = 1)")
def nearby_semijoin(spark: SparkSession, d: str) -> DataFrame:
    ids = read(spark, d, "labels").where("toxic = 1").select("doc_id")
    return retrieve.apply(read(spark, d, "documents").withColumn("is_active", F.lit(True)), retrieve.Filters(ids=ids), key="doc_id").select("doc_id", "lang")


# ---- sync ------------------------------------------------------------------------------------------------------------
@query("SELECT text AS id, min(doc_id) AS doc_id FROM documents WHERE text IS NOT NULL GROUP BY text")
def dedupe_first(spark: SparkSession, d: str) -> DataFrame:
    return sync.dedupe_first(read(spark, d, "documents").select(F.col("text").alias("id"), "doc_id"), "id", "doc_id")


def staged(spark: SparkSession, d: str) -> tuple[DataFrame, DataFrame]:
    """Source records, and a store that lacks every seventh document and has another hash for every fifth."""
    rows = read(spark, d, "documents").select(F.col("doc_id").alias("external_id"), F.sha2("text", 256).alias("content_hash"))
    store = rows.where("external_id % 7 <> 0").withColumn("content_hash", F.when(F.col("external_id") % 5 == 0, F.lit("old")).otherwise(F.col("content_hash")))
    return rows, store


_CHANGED = "(doc_id % 7 = 0 OR doc_id % 5 = 0)"


@query(f"SELECT doc_id AS external_id, {_CHANGED} AS changed FROM documents")
def hash_diff(spark: SparkSession, d: str) -> DataFrame:
    return sync.hash_diff(*staged(spark, d)).select("external_id", "changed")


@query("SELECT doc_id AS external_id, sha256(text) AS content_hash FROM documents")
def upsert_result(spark: SparkSession, d: str) -> DataFrame:
    rows, store = staged(spark, d)
    return sync.upsert(store, sync.hash_diff(rows, store).where("changed").select("external_id", "content_hash"))


@query(f"SELECT count(*) AS processed, count(*) FILTER (NOT {_CHANGED}) AS skipped, count(*) FILTER ({_CHANGED}) AS upserted FROM documents")
def sync_counters(spark: SparkSession, d: str) -> DataFrame:
    return sync.counters(sync.hash_diff(*staged(spark, d)))


# ---- table checks ----------------------------------------------------------------------------------------------------
@query("SELECT count(*) AS total, count(*) FILTER (WHERE toxic = 1) AS toxic, count(*) FILTER (WHERE quality = 1) AS good, min(doc_id) AS least, max(doc_id) AS most FROM labels")
def filtered_counts(spark: SparkSession, d: str) -> DataFrame:
    return read(spark, d, "labels").agg(F.count("*").alias("total"), F.count_if(F.col("toxic") == 1).alias("toxic"), F.count_if(F.col("quality") == 1).alias("good"), F.min("doc_id").alias("least"), F.max("doc_id").alias("most"))


@query("SELECT lang AS category, count(*) AS total FROM documents GROUP BY lang ORDER BY total DESC, category")
def group_category(spark: SparkSession, d: str) -> DataFrame:
    return read(spark, d, "documents").groupBy(F.col("lang").alias("category")).agg(F.count("*").alias("total")).orderBy(F.desc("total"), "category")


@query("SELECT 'documents' AS name, count(*) AS total FROM documents UNION ALL SELECT 'embeddings', count(*) FROM embeddings")
def table_counts(spark: SparkSession, d: str) -> DataFrame:
    one = lambda t: read(spark, d, t).agg(F.count("*").alias("total")).select(F.lit(t).alias("name"), "total")
    return one("documents").unionByName(one("embeddings"))


_CHECKED = "SELECT '{0}' AS table_name, count(*) AS total, min(len(embedding)) AS min_dims, max(len(embedding)) AS max_dims, '{0}' AS model, min('v' || label) AS version, round(min(n), 6) AS min_norm, round(max(n), 6) AS max_norm FROM (SELECT *, " + _NORM + " AS n FROM embeddings) WHERE label % 2 = {1}"


@query(_CHECKED.format("even", 0) + " UNION ALL " + _CHECKED.format("odd", 1))
def table_verification(spark: SparkSession, d: str) -> DataFrame:
    e = read(spark, d, "embeddings").withColumn("embedding_version", F.concat(F.lit("v"), "label"))
    found = verification({name: e.where(F.col("label") % 2 == n).withColumn("embedding_model", F.lit(name)) for n, name in enumerate(("even", "odd"))})
    return found.withColumns({c: F.round(c, 6) for c in ("min_norm", "max_norm")})


@query("SELECT event_id, json_extract_string(props, '$.k') AS k, left(event_type, 3) AS kind FROM events ORDER BY ts DESC, event_id LIMIT 20")
def recent_topn(spark: SparkSession, d: str) -> DataFrame:
    return read(spark, d, "events").orderBy(F.desc("ts"), "event_id").limit(20).select("event_id", F.get_json_object("props", "$.k").alias("k"), F.left("event_type", F.lit(3)).alias("kind"))


# ---- policy and clusters ---------------------------------------------------------------------------------------------
_CLAIM = " OR ".join(f"regexp_matches(c, '{p}')" for p in (r"(?i)\babiert[oa]s?\b", r"(?i)\bpromoci[oó]n\b", r"(?i)\bdescuento\b", r"(?i)\bgratis\b", r"\$\s?\d+", r"\b\d{1,2}:\d{2}\b"))


@query(f"SELECT conv_id, turn, CASE WHEN length(c) < 10 THEN 'empty_or_too_short' WHEN {_CLAIM} THEN 'unsupported_claims' ELSE '' END AS reason, CASE WHEN length(c) > 700 THEN regexp_replace(left(c, 700), ' [^ ]*$', '') || '...' ELSE c END AS message FROM (SELECT conv_id, turn, {s_clean('text')} AS c FROM conversations)")
def guard_reasons(spark: SparkSession, d: str) -> DataFrame:
    t = F.col("text")
    reason = policy.guard_reason(t, F.lit("confident"), F.array().cast("array<string>"))
    return read(spark, d, "conversations").select("conv_id", "turn", F.coalesce(reason, F.lit("")).alias("reason"), ft.squeeze_and_cut(t).alias("message"))


@query("SELECT conv_id, CASE conv_id % 3 WHEN 0 THEN '" + policy.NO_MATCH + "' WHEN 1 THEN '" + policy.LOW[0] + "' || n || '" + policy.LOW[1] + "' ELSE '" + policy.GOOD[0] + "' || n || '" + policy.GOOD[1] + "' END AS message FROM (SELECT conv_id, array_to_string(list_sort(list(DISTINCT role))[1:3], ', ') AS n FROM conversations GROUP BY conv_id)")
def template_message(spark: SparkSession, d: str) -> DataFrame:
    names = read(spark, d, "conversations").groupBy("conv_id").agg(F.array_sort(F.collect_set("role")).alias("names"))
    mode = F.when(F.col("conv_id") % 3 == 0, "no_match").when(F.col("conv_id") % 3 == 1, "low_confidence").otherwise("confident")
    return names.select("conv_id", policy.template_message(mode, F.col("names")).alias("message"))


@query("SELECT label AS cluster_id, vec_id AS post_id, count(*) OVER (PARTITION BY label) AS size FROM embeddings")
def cluster_explode(spark: SparkSession, d: str) -> DataFrame:
    e = read(spark, d, "embeddings")
    return e.join(e.groupBy("label").agg(F.count("*").alias("size")), "label").select(F.col("label").alias("cluster_id"), F.col("vec_id").alias("post_id"), "size")


@query("SELECT conv_id AS cluster_id, 'c' || conv_id AS label, row_number() OVER (PARTITION BY conv_id ORDER BY turn) - 1 AS position, CAST(turn AS VARCHAR) AS post_id FROM conversations")
def cluster_posts(spark: SparkSession, d: str) -> DataFrame:
    """Stored clusters, exploded: a conversation is a cluster of its turns."""
    turns = F.transform(F.array_sort(F.collect_list("turn")), lambda t: t.cast("string"))
    made = read(spark, d, "conversations").groupBy(F.col("conv_id").alias("id")).agg(turns.alias("post_ids")).withColumn("label", F.concat(F.lit("c"), "id"))
    return fixtures.cluster_posts(made).withColumn("position", F.col("position").cast("bigint"))
