"""Retrieval: BM25, vector search, rank fusion and reranking."""

from __future__ import annotations

from collections.abc import Callable
from functools import reduce

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window as W, functions as F

from scholion.functions.text import words

K1, B, RRF_K = 1.2, 0.75, 60


def postings(docs: DataFrame, ident: str, text: str) -> DataFrame:
    """(ident, term, tf, dl): term and document lengths of non-empty documents."""
    tokens = docs.select(ident, words(F.col(text)).alias("w")).where(F.size("w") > 0)
    return tokens.select(ident, F.size("w").alias("dl"), F.explode("w").alias("term")).groupBy(ident, "dl", "term").agg(F.count(F.lit(1)).alias("tf"))


def bm25(docs: DataFrame, queries: DataFrame, ident: str = "doc_id", text: str = "text", qid: str = "qid", query: str = "query") -> DataFrame:
    """(qid, ident, score) of all documents that share a term with a query; only the queries' terms are shuffled on."""
    asked = queries.select(qid, F.explode(F.array_distinct(words(F.col(query)))).alias("term"))
    terms = asked.select("term").distinct()
    tokens = docs.select(ident, words(F.col(text)).alias("w")).where(F.size("w") > 0)
    whole = tokens.agg(F.count(F.lit(1)).alias("n"), F.avg(F.size("w")).alias("avgdl"))
    hits = tokens.select(ident, F.size("w").alias("dl"), F.explode("w").alias("term")).join(terms, "term", "left_semi").groupBy(ident, "dl", "term").agg(F.count(F.lit(1)).alias("tf"))
    df = hits.groupBy("term").agg(F.count(F.lit(1)).alias("df"))
    scored = hits.join(df, "term").join(F.broadcast(whole))
    idf = F.ln(F.lit(1.0) + (F.col("n") - F.col("df") + 0.5) / (F.col("df") + 0.5))
    weight = idf * F.col("tf") * (K1 + 1) / (F.col("tf") + K1 * (1 - B + B * F.col("dl") / F.col("avgdl")))
    return asked.join(scored.select("term", ident, weight.alias("w")), "term").groupBy(qid, ident).agg(F.sum("w").alias("score"))


def top(frame: DataFrame, by: list[str], score: str, ident: str, k: int, digits: int = 6) -> DataFrame:
    """The k best of each group with their rank; scores are rounded before they are ranked, ties go to the least id."""
    rounded = frame.withColumn(score, F.round(score, digits))
    place = F.row_number().over(W.partitionBy(*by).orderBy(F.col(score).desc(), F.col(ident)))
    return rounded.withColumn("rank", place).where(F.col("rank") <= k)


def dot(a: Column, b: Column) -> Column:
    """Inner product of two arrays in double precision."""
    return F.aggregate(F.zip_with(a, b, lambda x, y: x.cast("double") * y.cast("double")), F.lit(0.0), lambda s, x: s + x)


def unit(vectors: DataFrame, ident: str, vector: str) -> DataFrame:
    """(ident, vector) scaled to length one; null and zero vectors are left out."""
    norm = F.sqrt(dot(F.col(vector), F.col(vector)))
    return vectors.select(ident, F.col(vector).alias("v"), norm.alias("norm")).where("norm > 0").select(ident, F.transform("v", lambda x: x.cast("double") / F.col("norm")).alias(vector))


def cosine_blocks(vectors: DataFrame, queries: DataFrame, k: int, ident: str = "vec_id", vector: str = "embedding", block: int = 1000, same: bool = False) -> DataFrame:
    """(qid, ident, score, rank): the k nearest vectors to each row (qid, vector) of a stated query set, by cosine.

    Queries are fetched in blocks of bounded size; each task multiplies its vectors with
    a block and keeps its k best, so a task's rows, not all pairs, reach the shuffle.
    Null and zero vectors are near nothing; ``same`` leaves a query's own id out.
    """
    spark = vectors.sparkSession
    asked = queries.select("qid", vector).where(F.col(vector).isNotNull())
    blocks = max(1, -(-asked.count() // block))
    parts = []
    for number in range(blocks):
        some = [(r["qid"], list(r[vector])) for r in asked.where(F.pmod(F.xxhash64("qid"), F.lit(blocks)) == number).collect()]
        keys = np.array([q for q, _ in some], dtype=np.int64)
        matrix = np.array([v for _, v in some], dtype=np.float64).reshape(len(some), -1 if some else 0)
        norms = np.linalg.norm(matrix, axis=1, keepdims=True) if len(some) else np.ones((0, 1))
        held = spark.sparkContext.broadcast((keys, matrix / np.where(norms == 0, 1, norms)))

        def nearest(batches, held=held):  # noqa: ANN001, ANN202
            keys, matrix = held.value
            for batch in batches:
                good = batch[batch[vector].notna()]
                if not len(good) or not len(keys):
                    continue
                mine = np.stack(good[vector].to_numpy()).astype(np.float64)
                length = np.linalg.norm(mine, axis=1)
                ids = good[ident].to_numpy()
                scores = matrix @ (mine / np.where(length == 0, 1, length)[:, None]).T
                scores[:, length == 0] = -np.inf
                if same:
                    scores[keys[:, None] == ids[None, :]] = -np.inf
                scores = np.round(scores, 4)
                for row, key in enumerate(keys):
                    order = np.lexsort((ids, -scores[row]))[:k]
                    order = order[np.isfinite(scores[row][order])]
                    yield pd.DataFrame({"qid": key, ident: ids[order], "score": scores[row][order]})

        parts.append(vectors.select(ident, vector).mapInPandas(nearest, f"qid bigint, {ident} bigint, score double"))
    return top(reduce(DataFrame.unionByName, parts), ["qid"], "score", ident, k, 4)


def centroid(vectors: DataFrame, vector: str) -> DataFrame:
    """(pos, x): the mean vector, element by element."""
    return vectors.select(F.posexplode(vector).alias("pos", "x")).groupBy("pos").agg(F.avg(F.col("x").cast("double")).alias("x"))


def fused(legs: list[tuple[DataFrame, float]], ident: str, by: str = "qid", k: int = RRF_K) -> DataFrame:
    """(by, ident, score): weighted reciprocal-rank fusion of ranked legs."""
    rows = reduce(DataFrame.unionByName, [leg.select(by, ident, (F.lit(w) / (F.lit(k) + F.col("rank"))).alias("s")) for leg, w in legs])
    return rows.groupBy(by, ident).agg(F.sum("s").alias("score"))


def boosted(frame: DataFrame, score: str, citations: str, rank: str, weights: tuple[float, float, float] = (0.6, 0.2, 0.2)) -> DataFrame:
    """Rows with ``boosted``: score, log citations and rank, the latter two by their greatest value (1 if that is 0)."""
    logged = F.ln(F.lit(1.0) + F.coalesce(citations, F.lit(0)))
    values = frame.withColumns({"_c": logged, "_r": F.coalesce(rank, F.lit(0.0)).cast("double")})
    most = values.agg(F.coalesce(F.nullif(F.max("_c"), F.lit(0.0)), F.lit(1.0)).alias("_mc"), F.coalesce(F.nullif(F.max("_r"), F.lit(0.0)), F.lit(1.0)).alias("_mr"))
    total = weights[0] * F.coalesce(score, F.lit(0.0)) + weights[1] * F.col("_c") / F.col("_mc") + weights[2] * F.col("_r") / F.col("_mr")
    return values.join(F.broadcast(most)).withColumn("boosted", F.round(total, 6)).drop("_c", "_r", "_mc", "_mr")


def diversified(frame: DataFrame, by: str, ident: str, score: str, keywords: str, limit: int = 20, weight: float = 0.7) -> DataFrame:
    """Maximal marginal relevance within each group of ranked results (bounded lists, as retrieved).

    Greedy: the best first, then whatever weighs most as relevance less its greatest
    keyword overlap (Jaccard) with what is chosen. Null scores count as 0.
    """

    def choose(rows: pd.DataFrame) -> pd.DataFrame:
        rows = rows.assign(**{score: rows[score].fillna(0.0)}).sort_values([score, ident], ascending=[False, True]).reset_index(drop=True)
        sets = [set(x) if x is not None else set() for x in rows[keywords]]
        left, chosen = list(range(len(rows))), []
        nearest = [0.0] * len(rows)
        while left and len(chosen) < limit:
            best = max(left, key=lambda i: (weight * rows[score][i] - (1 - weight) * nearest[i] if chosen else rows[score][i], -i))
            chosen.append(best)
            left.remove(best)
            for i in left:
                union = sets[i] | sets[best]
                nearest[i] = max(nearest[i], len(sets[i] & sets[best]) / len(union) if union else 0.0)
        return pd.DataFrame({by: rows[by][chosen].to_numpy(), ident: rows[ident][chosen].to_numpy(), "place": range(1, len(chosen) + 1)})

    kinds = dict(frame.dtypes)
    return frame.select(by, ident, score, keywords).groupBy(by).applyInPandas(choose, f"{by} {kinds[by]}, {ident} {kinds[ident]}, place int")


def reranked(frame: DataFrame, text: str, query: str, scorer: Callable[[str, str], float], k: int, ident: str, by: str) -> DataFrame:
    """The k best of each group by a pluggable scorer of (query, text), called on Arrow batches."""

    @F.pandas_udf("double")
    def score(q: pd.Series, t: pd.Series) -> pd.Series:
        return pd.Series([scorer(a or "", b or "") for a, b in zip(q, t)])

    return top(frame.withColumn("score", score(F.col(query), F.col(text))), [by], "score", ident, k)
