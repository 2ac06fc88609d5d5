"""Retrieval queries over documents and embeddings."""

from __future__ import annotations

import re

from pyspark.sql import functions as F

from scholion.functions import text as T
from scholion.operators import search as S
from scholion.runtime import materialize, table

QUERIES: dict = {}
SQL: dict[str, str] = {}
# The stated queries.
ASKED = ((1, "speech recognition with beam search"), (2, "finding agrees with earlier benchmarks"), (3, "low-resource parsing of court records"))


def query(sql: str | None = None):  # noqa: ANN201
    """Register a query under its function's name, with the SQL it must agree with."""

    def register(function):  # noqa: ANN001, ANN202
        QUERIES[function.__name__] = function
        if sql:
            SQL[function.__name__] = sql
        return function

    return register


_WORDS = "list_filter(regexp_split_to_array(lower({0}), '[^\\p{{L}}\\p{{N}}_]+'), lambda x: x <> '')"
_ASKED = "q AS (SELECT DISTINCT qid, term FROM (VALUES " + ", ".join(f"({i}, '{t}')" for i, s in ASKED for t in re.split(r"[^\w]+", s)) + ") t(qid, term))"
_BM25 = f"""WITH {_ASKED}, d AS (SELECT doc_id, w, len(w) AS dl FROM (SELECT doc_id, {_WORDS.format('text')} AS w FROM documents) WHERE len(w) > 0), c AS (SELECT count(*) AS n, avg(dl) AS avgdl FROM d),
t AS (SELECT doc_id, dl, term, count(*) AS tf FROM (SELECT doc_id, dl, unnest(w) AS term FROM d) WHERE term IN (SELECT term FROM q) GROUP BY ALL), f AS (SELECT term, count(*) AS df FROM t GROUP BY term),
s AS (SELECT qid, doc_id, round(sum(ln(1.0 + (n - df + 0.5) / (df + 0.5)) * tf * 2.2 / (tf + 1.2 * (0.25 + 0.75 * dl / avgdl))), 6) AS score FROM t JOIN f USING (term) JOIN q USING (term), c GROUP BY qid, doc_id),
b AS (SELECT qid, doc_id, score::DOUBLE AS score, row_number() OVER (PARTITION BY qid ORDER BY score DESC, doc_id)::INT AS rank FROM s)"""


def _scores(spark, sf):  # noqa: ANN001, ANN202
    # Literals, whose size the planner knows: it sends the terms to the texts, not all words to the terms.
    asked = spark.range(1).select(F.inline(F.array(*(F.struct(F.lit(i).alias("qid"), F.lit(q).alias("query")) for i, q in ASKED))))
    return S.bm25(table(spark, sf, "documents"), asked)


def _bm25(spark, sf, k):  # noqa: ANN001, ANN202
    return S.top(_scores(spark, sf), ["qid"], "score", "doc_id", k)


@query(_BM25 + " SELECT qid, doc_id, score, rank FROM b WHERE rank <= 20")
def bm25_topk(spark, sf):
    return _bm25(spark, sf, 20)


_COS = """q AS (SELECT vec_id AS qid, embedding AS e FROM embeddings WHERE vec_id % 20 = 0), s AS (SELECT q.qid, v.vec_id, round(list_cosine_similarity(v.embedding::DOUBLE[], q.e::DOUBLE[]), 4) AS score FROM embeddings v, q WHERE q.qid <> v.vec_id),
v AS (SELECT qid, vec_id, score, row_number() OVER (PARTITION BY qid ORDER BY score DESC, vec_id)::INT AS rank FROM s)"""


def _nearest(spark, sf, k):  # noqa: ANN001, ANN202
    vectors = table(spark, sf, "embeddings").select("vec_id", "embedding")
    # The stated query set: every twentieth vector against all.
    asked = vectors.where("vec_id % 20 = 0").select(F.col("vec_id").alias("qid"), "embedding")
    return S.cosine_blocks(vectors, asked, k, same=True)


@query(f"WITH {_COS} SELECT qid, vec_id, score, rank FROM v WHERE rank <= 10")
def cosine_topk(spark, sf):
    return _nearest(spark, sf, 10)


@query(f"WITH {_COS} SELECT l.label AS from_label, m.label AS to_label, count(*) AS links, round(sum(score), 4)::DOUBLE AS total_score FROM v JOIN embeddings l ON l.vec_id = v.qid JOIN embeddings m ON m.vec_id = v.vec_id WHERE rank <= 10 GROUP BY ALL")
def similarity_graph_labels(spark, sf):
    labels = table(spark, sf, "embeddings").select("vec_id", "label")
    links = _nearest(spark, sf, 10).join(labels.withColumnRenamed("label", "to_label"), "vec_id").join(labels.select(F.col("vec_id").alias("qid"), F.col("label").alias("from_label")), "qid")
    return links.groupBy("from_label", "to_label").agg(F.count(F.lit(1)).alias("links"), F.round(F.sum("score"), 4).alias("total_score"))


@query("""SELECT pos, round(avg(x), 6) AS x FROM (SELECT generate_subscripts(embedding, 1)::INT - 1 AS pos, unnest(embedding)::DOUBLE AS x FROM embeddings WHERE label = 3) GROUP BY pos""")
def prf_centroid(spark, sf):
    return S.centroid(table(spark, sf, "embeddings").where("label = 3"), "embedding").select("pos", F.round("x", 6).alias("x"))


#: Documents whose vectors make the query's vector, and how far each leg reaches.
FEEDBACK, REACH = 5, 50
_WEIGHTS = "lw AS (SELECT * FROM (VALUES " + ", ".join(f"({i}, {T.lexical_weights(q)[0]}, {T.lexical_weights(q)[1]})" for i, q in ASKED) + ") t(qid, wd, wl))"
_DENSE = f"""f AS (SELECT b.qid, generate_subscripts(e.embedding, 1) AS i, unnest(e.embedding)::DOUBLE AS x FROM (SELECT b.*, row_number() OVER (PARTITION BY qid ORDER BY rank) AS p FROM b WHERE doc_id IN (SELECT vec_id FROM embeddings WHERE embedding IS NOT NULL)) b JOIN embeddings e ON e.vec_id = b.doc_id WHERE p <= {FEEDBACK}),
g AS (SELECT qid, list(x ORDER BY i) AS c FROM (SELECT qid, i, avg(x) AS x FROM f GROUP BY qid, i) GROUP BY qid), s2 AS (SELECT g.qid, e.vec_id AS doc_id, round(list_cosine_similarity(e.embedding::DOUBLE[], g.c), 4) AS score FROM embeddings e, g WHERE e.embedding IS NOT NULL),
z AS (SELECT qid, doc_id, score, row_number() OVER (PARTITION BY qid ORDER BY score DESC, doc_id)::INT AS rank FROM s2), {_WEIGHTS}"""
_BM25_F = _BM25.replace("f AS (SELECT term", "df_ AS (SELECT term").replace("JOIN f USING (term)", "JOIN df_ USING (term)")


def _dense(spark, sf, scores, k):  # noqa: ANN001, ANN202
    """The nearest documents to the mean vector of a query's first results by words (feedback stands for an encoder).

    The first results that have a vector are sought among all scores: they may lie behind any number of others.
    """
    vectors = table(spark, sf, "embeddings").where("embedding is not null").select(F.col("vec_id").alias("doc_id"), "embedding")
    first = S.top(scores.join(vectors.select("doc_id"), "doc_id", "left_semi"), ["qid"], "score", "doc_id", FEEDBACK)
    means = first.join(vectors, "doc_id").select("qid", F.posexplode("embedding").alias("i", "x")).groupBy("qid", "i").agg(F.avg(F.col("x").cast("double")).alias("x"))
    asked = means.groupBy("qid").agg(F.array_sort(F.collect_list(F.struct("i", "x"))).alias("v")).select("qid", F.transform("v", lambda t: t["x"]).alias("embedding"))
    return S.cosine_blocks(vectors.withColumnRenamed("doc_id", "vec_id"), asked, k).withColumnRenamed("vec_id", "doc_id")


def _fused(spark, sf):  # noqa: ANN001, ANN202
    """Both legs, each as far as its weight reaches, fused by reciprocal rank with the weights that the query's form asks for."""
    scores = materialize(_scores(spark, sf), "scores")
    words = S.top(scores, ["qid"], "score", "doc_id", REACH)
    dense = _dense(spark, sf, scores, int(REACH * 1.4))
    weights = spark.createDataFrame([(i, *T.lexical_weights(q)) for i, q in ASKED], "qid int, wd double, wl double")
    leg = lambda frame, w: frame.join(F.broadcast(weights), "qid").where(F.col("rank") <= F.greatest(F.lit(1), F.floor(F.lit(REACH) * F.col(w)))).select("qid", "doc_id", (F.col(w) / (F.lit(S.RRF_K) + F.col("rank"))).alias("s"))
    return leg(words, "wl").unionByName(leg(dense, "wd")).groupBy("qid", "doc_id").agg(F.sum("s").alias("score"))


_FUSED = f"""{_BM25_F}, {_DENSE}, fu AS (SELECT qid, doc_id, sum(s) AS score FROM (SELECT b.qid, doc_id, wl / (60.0 + rank) AS s FROM b JOIN lw USING (qid) WHERE rank <= {REACH} AND rank <= greatest(1, floor({REACH} * wl)) UNION ALL SELECT z.qid, doc_id, wd / (60.0 + rank) FROM z JOIN lw USING (qid) WHERE rank <= greatest(1, floor({REACH} * wd))) GROUP BY qid, doc_id)"""


@query(_FUSED + " SELECT qid, doc_id, round(score, 8)::DOUBLE AS score FROM fu")
def rrf_fusion(spark, sf):
    """A leg by words and one by vectors, fused by reciprocal rank."""
    return _fused(spark, sf).withColumn("score", F.round("score", 8))


@query(_FUSED + """, h AS (SELECT qid, doc_id, round(score, 8)::DOUBLE AS score, count(*) OVER (PARTITION BY qid) AS total, row_number() OVER (PARTITION BY qid ORDER BY round(score, 8) DESC, doc_id)::INT AS rank FROM fu JOIN documents d USING (doc_id) WHERE coalesce(d.pub_year, 0) >= 2005 AND d.lang = 'en')
SELECT qid, doc_id, score, rank, total FROM h WHERE rank > 5 AND rank <= 15""")
def search_pipeline(spark, sf):
    """Filtered, fused and paged: results 6 to 15 of each query among English documents from 2005 on, with how many there are."""
    from pyspark.sql import Window as W

    kept = table(spark, sf, "documents").where("coalesce(pub_year, 0) >= 2005 and lang = 'en'").select("doc_id")
    found = materialize(_fused(spark, sf).join(kept, "doc_id", "left_semi").withColumn("score", F.round("score", 8)), "found")
    totals = found.groupBy("qid").agg(F.count(F.lit(1)).alias("total"))
    place = F.row_number().over(W.partitionBy("qid").orderBy(F.col("score").desc(), "doc_id"))
    return found.withColumn("rank", place).where("rank > 5 and rank <= 15").join(totals, "qid").select("qid", "doc_id", "score", "rank", "total")


@query(_BM25_F + f", {_DENSE} SELECT qid, doc_id, score, rank FROM z WHERE rank <= 20")
def prf_research(spark, sf):
    """The search done again with the mean vector of its first results."""
    return _dense(spark, sf, materialize(_scores(spark, sf), "scores"), 20).select("qid", "doc_id", "score", "rank")


@query(_BM25 + ", v AS (SELECT DISTINCT qid FROM b JOIN embeddings ON vec_id = doc_id AND label = 99) SELECT qid, doc_id, rank, qid NOT IN (SELECT qid FROM v) AS by_words_only FROM b WHERE rank <= 10")
def words_only_fallback(spark, sf):
    """Where a query has no vector (here none of the wanted kind) the leg by words stands alone."""
    words = _bm25(spark, sf, 10)
    able = _bm25(spark, sf, 1 << 30).join(table(spark, sf, "embeddings").where("label = 99").select(F.col("vec_id").alias("doc_id")), "doc_id", "left_semi").select("qid").distinct().withColumn("able", F.lit(True))
    return words.join(able, "qid", "left").select("qid", "doc_id", "rank", F.col("able").isNull().alias("by_words_only"))


@query("""SELECT id, fetched_at, title, year, coalesce(len(resolved_references), 0)::INT AS references_, coalesce(len(cited_by), 0)::INT AS citers, array_to_string(authors[1:3], '; ') AS first_authors FROM paper_responses WHERE deleted_at IS NULL""")
def paper_detail(spark, sf):
    """What is shown of a record, with how many it cites and is cited by."""
    size = lambda c: F.when(F.col(c).isNotNull(), F.size(c)).otherwise(0)
    return table(spark, sf, "paper_responses").where("deleted_at is null").select("id", "fetched_at", "title", "year", size("resolved_references").alias("references_"), size("cited_by").alias("citers"), F.array_join(F.slice("authors", 1, 3), "; ").alias("first_authors"))


@query(f"WITH {_COS} SELECT qid, vec_id, score, rank FROM v WHERE rank <= 10 AND qid % 100 = 0")
def stored_similar(spark, sf):
    """The stored nearest of some vectors, as lists looked up by key and unrolled."""
    near = _nearest(spark, sf, 10)
    lists = near.groupBy("qid").agg(F.array_sort(F.collect_list(F.struct("rank", "vec_id", "score"))).alias("x"))
    return lists.where("qid % 100 = 0").select("qid", F.explode("x").alias("x")).select("qid", "x.vec_id", "x.score", "x.rank")


@query("""WITH u AS (SELECT raw_id, source, coalesce(nullif(lower(trim(doi)), ''), nullif(lower(trim(arxiv_id)), ''), lower(trim(title))) AS k FROM raw_papers WHERE source IN ('arxiv', 'openalex', 'semantic_scholar'))
SELECT k, raw_id, source FROM (SELECT *, row_number() OVER (PARTITION BY k ORDER BY raw_id) AS n FROM u WHERE k <> '') WHERE n = 1""")
def external_union(spark, sf):
    """Results of several sources, each work once by DOI, preprint id or title, the first."""
    low = lambda c: F.nullif(F.lower(F.trim(c)), F.lit(""))
    rows = table(spark, sf, "raw_papers").where(F.col("source").isin("arxiv", "openalex", "semantic_scholar")).select("raw_id", "source", F.coalesce(low("doi"), low("arxiv_id"), low("title")).alias("k")).where("k is not null")
    return rows.groupBy("k").agg(F.min(F.struct("raw_id", "source")).alias("b")).select("k", "b.raw_id", "b.source")


@query(_BM25 + """, p AS (SELECT b.qid, b.doc_id, b.score, r.citation_count AS c, r.tier AS t FROM b JOIN raw_papers r ON r.raw_id = b.doc_id + 1 WHERE rank <= 50), m AS (SELECT coalesce(nullif(max(ln(1.0 + coalesce(c, 0))), 0.0), 1.0) AS mc, coalesce(nullif(max(coalesce(t, 0)::DOUBLE), 0.0), 1.0) AS mt FROM p)
SELECT qid, doc_id, round(0.6 * score + 0.2 * ln(1.0 + coalesce(c, 0)) / mc + 0.2 * coalesce(t, 0)::DOUBLE / mt, 6)::DOUBLE AS boosted FROM p, m""")
def citation_boost(spark, sf):
    """Results by words, raised by citations (and tiers) of the paper under the document's number; null counts are 0."""
    papers = table(spark, sf, "raw_papers").select((F.col("raw_id") - 1).alias("doc_id"), "citation_count", F.col("tier").cast("double").alias("tier"))
    return S.boosted(_bm25(spark, sf, 50).join(papers, "doc_id"), "score", "citation_count", "tier").select("qid", "doc_id", "boosted")


@query()
def mmr_select(spark, sf):
    ranked = _bm25(spark, sf, 60).join(table(spark, sf, "documents").select("doc_id", T.words(F.col("text")).alias("keywords")), "doc_id")
    return S.diversified(ranked, "qid", "doc_id", "score", "keywords", 20)


@query()
def rerank(spark, sf):
    asked = spark.createDataFrame(list(ASKED), "qid int, query string")
    pool = _bm25(spark, sf, 50).drop("score", "rank").join(asked, "qid").join(table(spark, sf, "documents").select("doc_id", "text"), "doc_id")
    overlap = lambda q, t: len(set(q.lower().split()) & set(t.lower().split())) / (1 + len(set(q.lower().split())))
    return S.reranked(pool, "text", "query", overlap, 10, "doc_id", "qid").select("qid", "doc_id", "score", "rank")


@query(_BM25 + """, m AS (SELECT qid, max(score) AS top FROM b GROUP BY qid) SELECT qid, doc_id, round(0.6 * score / top + 0.4 * coalesce(greatest(0.0, least(1.0, (pub_year - 2019) / 6.0)), 0.0), 4)::DOUBLE AS research_score FROM b JOIN m USING (qid) JOIN documents USING (doc_id) WHERE rank <= 50""")
def research_rank(spark, sf):
    from scholion.operators.trends import recency

    found = _bm25(spark, sf, 50)
    best = found.groupBy("qid").agg(F.max("score").alias("top"))
    years = table(spark, sf, "documents").select("doc_id", "pub_year")
    return found.join(best, "qid").join(years, "doc_id").select("qid", "doc_id", F.round(0.6 * F.col("score") / F.col("top") + 0.4 * recency(F.col("pub_year"), 2025), 4).alias("research_score"))


@query()
def topic_clusters(spark, sf):
    """Clusters of vectors by k-means on principal components; numbers of clusters are not comparable across engines."""
    from pyspark.ml.clustering import KMeans
    from pyspark.ml.feature import PCA
    from pyspark.ml.functions import array_to_vector

    vectors = table(spark, sf, "embeddings").where("embedding is not null").select("vec_id", array_to_vector("embedding").alias("features"))
    reduced = PCA(k=8, inputCol="features", outputCol="x").fit(vectors).transform(vectors)
    return KMeans(k=10, seed=42, featuresCol="x", predictionCol="cluster").fit(reduced).transform(reduced).select("vec_id", "cluster")
