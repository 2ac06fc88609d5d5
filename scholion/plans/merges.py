"""Lists, gains and rankings of merged records."""

from __future__ import annotations

from pyspark.sql import functions as F

from scholion.functions import text as T
from scholion.operators import relational as R, trends
from scholion.plans.analytics import _COUNTS, NOW, _counts
from scholion.plans.graphs import _E, edges
from scholion.plans.registry import Registry, doi_sql
from scholion.runtime import table

REGISTRY = Registry()
query = REGISTRY.query
QUERIES, SQL = REGISTRY.queries, REGISTRY.sql


@query()
def dedup_arrival(spark, sf):
    """Papers in order of arrival, without those that share a DOI, work id, or title and year with one kept before."""
    papers = table(spark, sf, "raw_papers").select("raw_id", "title", "year", "doi", "openalex_id", "acl_id")
    dated = F.when(T.normalize_title(F.col("title")) != "", T.title_year_key(F.col("title"), F.col("year")))
    keys = [("d", T.plain_doi(F.col("doi"))), ("w", F.nullif(F.trim("openalex_id"), F.lit(""))), ("a", F.nullif(F.trim("acl_id"), F.lit(""))), ("t", dated)]
    return R.arrival_dedup(papers, keys, "raw_id").select("raw_id")


@query(f"""WITH s AS (SELECT point_id, {doi_sql('payload.doi')} AS d, payload.* FROM seed_stubs WHERE payload.is_stub), r AS (SELECT * FROM (SELECT {doi_sql('doi')} AS d, title, abstract, year, venue, raw_id, row_number() OVER (PARTITION BY {doi_sql('doi')} ORDER BY raw_id) AS n FROM raw_papers WHERE {doi_sql('doi')} IS NOT NULL) WHERE n = 1)
SELECT s.point_id, r.raw_id, concat_ws(',', CASE WHEN coalesce(trim(s.title), '') = '' AND trim(r.title) <> '' THEN 'title' END, CASE WHEN coalesce(trim(s.abstract), '') = '' AND trim(r.abstract) <> '' THEN 'abstract' END, CASE WHEN s.year IS NULL AND r.year IS NOT NULL THEN 'year' END, CASE WHEN coalesce(trim(s.venue), '') = '' AND trim(r.venue) <> '' THEN 'venue' END) AS gains FROM s JOIN r ON r.d = s.d""")
def stub_gains(spark, sf):
    """What a stub would gain from the paper of its DOI: the fields that it lacks and the paper has."""
    stubs = table(spark, sf, "seed_stubs").where("payload.is_stub").select("point_id", T.plain_doi(F.col("payload.doi")).alias("d"), "payload.title", "payload.abstract", "payload.year", "payload.venue")
    papers = R.first_wins(table(spark, sf, "raw_papers").select(T.plain_doi(F.col("doi")).alias("d"), "title", "abstract", "year", "venue", "raw_id").where("d is not null"), ["d"], [F.col("raw_id")])
    merged = R.fill_missing(stubs, papers.drop("raw_id"), "d", {"title": "string", "abstract": "string", "year": "other", "venue": "string"})
    return merged.join(papers.select("d", "raw_id"), "d").select("point_id", "raw_id", F.array_join("filled", ",").alias("gains"))


@query(f"WITH {_E} SELECT p.id, coalesce(string_agg(e.src, '|' ORDER BY e.src), '') AS cited_by, count(e.src) AS citations, true AS indexed FROM (SELECT DISTINCT id FROM paper_responses) p LEFT JOIN e ON e.dst = p.id GROUP BY p.id")
def cited_by_lists(spark, sf):
    """Every record with the list of its citers, empty where there are none, and the mark that it was indexed."""
    papers = table(spark, sf, "paper_responses").select("id").distinct()
    lists = edges(spark, sf).groupBy(F.col("dst").alias("id")).agg(F.array_sort(F.collect_list("src")).alias("l"))
    l = F.coalesce("l", F.array().cast("array<string>"))  # noqa: E741
    return papers.join(lists, "id", "left").select("id", F.array_join(l, "|").alias("cited_by"), F.size(l).cast("bigint").alias("citations"), F.lit(True).alias("indexed"))


@query(f"""WITH c AS ({_COUNTS}), g AS (SELECT keyword, sum(n)::BIGINT AS total, sum(CASE WHEN year IN (2025, 2024) THEN n ELSE 0 END)::BIGINT AS recent, sum(CASE WHEN year IN (2023, 2022) THEN n ELSE 0 END)::BIGINT AS older FROM c GROUP BY keyword)
SELECT keyword, total, least(CASE WHEN older > 0 THEN round(recent::DOUBLE / older, 6) WHEN recent > 0 THEN 99.0 ELSE 0.0 END, 99.0)::DOUBLE AS growth FROM g WHERE total >= 5 ORDER BY growth DESC, total DESC, keyword LIMIT 20""")
def rising_topk(spark, sf):
    """The twenty keywords that rise most; a rise from nothing counts as 99."""
    rising = trends.growth(_counts(spark, sf), NOW, 5, ["keyword"])
    return rising.select("keyword", "total", F.least("growth", F.lit(99.0)).alias("growth")).orderBy(F.col("growth").desc(), F.col("total").desc(), "keyword").limit(20)


@query("""WITH p AS (SELECT id, min(fetched_at) AS f, max(title) AS title, max(year) AS year, max(tier) AS tier, max(citation_count) AS citation_count, max(in_corpus_citation_count)::DOUBLE AS rank FROM paper_responses WHERE deleted_at IS NULL AND year >= 2010 AND tier IN (0, 1, 2) GROUP BY id),
m AS (SELECT coalesce(nullif(max(coalesce(citation_count, 0)), 0), 1) AS mc, coalesce(nullif(max(coalesce(rank, 0.0)), 0.0), 1.0) AS mr FROM p)
SELECT id, title, year, tier, citation_count, rank, round(0.3 * coalesce(citation_count, 0) / mc + 0.3 * coalesce(rank, 0.0) / mr + 0.2 * coalesce(greatest(0.0, least(1.0, (year - 2019) / 6.0)), 0.0) + 0.2 * CASE tier WHEN 0 THEN 1.0 WHEN 1 THEN 0.7 WHEN 2 THEN 0.4 ELSE 0.3 END, 6)::DOUBLE AS notable_score FROM p, m ORDER BY notable_score DESC, id LIMIT 30""")
def notable_records(spark, sf):
    """The most notable records of some tiers from a year on, by citations, rank in the graph, recency and tier."""
    kept = table(spark, sf, "paper_responses").where("deleted_at is null and year >= 2010 and tier in (0, 1, 2)")
    one = kept.groupBy("id").agg(*[F.max(c).alias(c) for c in ("title", "year", "tier", "citation_count")], F.max("in_corpus_citation_count").cast("double").alias("rank"))
    return trends.notable(one, NOW, 30, ident="id", rank="rank")
