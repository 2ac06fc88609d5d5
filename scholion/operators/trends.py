"""Rankings and trends over papers."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window as W, functions as F

# The base year of recency, the score's weights, and the boosts of the venue tiers.
BASE_YEAR = 2019
WEIGHTS = (0.3, 0.3, 0.2, 0.2)
TIERS = {0: 1.0, 1: 0.7, 2: 0.4}
OTHER_TIER = 0.3


def recency(year: Column, now_year: int) -> Column:
    """0 at the base year or before (and for null), 1 now or later, straight between."""
    span = max(1, now_year - BASE_YEAR)
    return F.coalesce(F.greatest(F.lit(0.0), F.least(F.lit(1.0), (year - BASE_YEAR) / F.lit(float(span)))), F.lit(0.0))


def tier_boost(tier: Column) -> Column:
    out = F.when(F.lit(False), F.lit(0.0))
    for value, boost in TIERS.items():
        out = out.when(tier == value, F.lit(boost))
    return out.otherwise(F.lit(OTHER_TIER))


def notable(papers: DataFrame, now_year: int, limit: int, ident: str = "raw_id", citations: str = "citation_count", rank: str | None = None) -> DataFrame:
    """The ``limit`` most notable papers: citations and rank by their greatest value, recency and tier, weighed and summed.

    Null counts are 0; ties go to the least id. One pass for the two maxima, then a
    top-k that never sorts the whole table.
    """
    c = F.coalesce(F.col(citations), F.lit(0))
    r = F.coalesce(F.col(rank), F.lit(0.0)) if rank else F.lit(0.0)
    most = papers.agg(F.coalesce(F.nullif(F.max(c), F.lit(0)), F.lit(1)).alias("_mc"), F.coalesce(F.nullif(F.max(r), F.lit(0.0)), F.lit(1.0)).alias("_mr"))
    score = WEIGHTS[0] * c / F.col("_mc") + WEIGHTS[1] * r / F.col("_mr") + WEIGHTS[2] * recency(F.col("year"), now_year) + WEIGHTS[3] * tier_boost(F.col("tier"))
    scored = papers.join(F.broadcast(most)).withColumn("notable_score", F.round(score, 6)).drop("_mc", "_mr")
    return scored.orderBy(F.col("notable_score").desc(), ident).limit(limit)


def keyword_counts(papers: DataFrame, keywords: str, category: Column, year: str = "year") -> DataFrame:
    """(keyword, category, year, n): occurrences, repeats within a paper included; years null or 0 are left out."""
    used = papers.where(F.coalesce(F.col(year), F.lit(0)) != 0)
    exploded = used.select(F.explode(keywords).alias("k"), category.alias("category"), F.col(year).alias("year"))
    return exploded.select(F.lower(F.trim("k")).alias("keyword"), "category", "year").where("keyword <> ''").groupBy("keyword", "category", "year").agg(F.count(F.lit(1)).alias("n"))


def growth(counts: DataFrame, now_year: int, min_count: int, by: list[str]) -> DataFrame:
    """Occurrences of this and the last year against the two years before; infinite where there were none."""
    recent = F.sum(F.when(F.col("year").isin(now_year, now_year - 1), F.col("n")).otherwise(0))
    older = F.sum(F.when(F.col("year").isin(now_year - 2, now_year - 3), F.col("n")).otherwise(0))
    sums = counts.groupBy(*by).agg(F.sum("n").alias("total"), recent.alias("recent"), older.alias("older")).where(F.col("total") >= min_count)
    rate = F.when(F.col("older") > 0, F.round(F.col("recent") / F.col("older"), 6)).when(F.col("recent") > 0, F.lit(float("inf"))).otherwise(F.lit(0.0))
    return sums.withColumn("growth", rate)


def cluster_profiles(members: DataFrame, cluster: str, keywords: str, size: int = 10, named_by: int = 3) -> DataFrame:
    """(cluster, members, label, keywords): the most frequent keywords of a cluster and a label of the first of them."""
    sizes = members.groupBy(cluster).agg(F.count(F.lit(1)).alias("members"))
    counted = members.select(cluster, F.explode(keywords).alias("k")).select(cluster, F.lower(F.trim("k")).alias("k")).where("k <> ''").groupBy(cluster, "k").agg(F.count(F.lit(1)).alias("n"))
    place = F.row_number().over(W.partitionBy(cluster).orderBy(F.col("n").desc(), "k"))
    best = counted.withColumn("p", place).where(F.col("p") <= size).groupBy(cluster).agg(F.transform(F.array_sort(F.collect_list(F.struct("p", "k"))), lambda x: x["k"]).alias("top"))
    label = F.coalesce(F.array_join(F.slice("top", 1, named_by), ", "), F.concat(F.lit("Cluster "), F.col(cluster).cast("string")))
    return sizes.join(best, cluster, "left").select(cluster, "members", label.alias("label"), F.coalesce(F.array_join("top", "|"), F.lit("")).alias("keywords"))
