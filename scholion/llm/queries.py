"""The queries of the training-data operators, by name, and their SQL where there is any."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession, functions as F

from scholion.llm import crosslink, history, identifiers, leaks, links, lookalike, people, sentences, survivors, tokens
from scholion.runtime import table


def p1_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    return history.duplicates_against_history(table(spark, sf_dir, "raw_papers"))


def p2_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    return links.consolidate(table(spark, sf_dir, "duplicate_results"))


def p3_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    titles = table(spark, sf_dir, "raw_papers").select(F.lit("title").alias("field"), F.col("raw_id").alias("key"), F.col("title").alias("text"))
    names = table(spark, sf_dir, "author_mentions").select(F.lit("name").alias("field"), F.col("mention_id").alias("key"), F.col("name").alias("text"))
    return lookalike.same_looking([titles, names])


def p4_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    mentions = table(spark, sf_dir, "author_mentions").select("name", "affiliation", "orcid", "openalex_id")
    seeds = table(spark, sf_dir, "seed_papers").select(F.explode("payload.authors.display_name").alias("name"))
    return people.same_person_pairs(people.people(mentions, seeds))


def p6_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    return survivors.survivors(*(table(spark, sf_dir, t) for t in ("dup_members", "seed_stubs", "raw_papers")))


def _p7(spark: SparkSession, sf_dir: str) -> DataFrame:
    return crosslink.matched(table(spark, sf_dir, "feed_openreview"), table(spark, sf_dir, "feed_dblp"))


def p7_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _p7(spark, sf_dir).select(F.col("left_id").alias("openreview_id"), F.col("right_id").alias("dblp_id"))


def p7_confidence(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _p7(spark, sf_dir).select(F.col("left_id").alias("openreview_id"), F.col("right_id").alias("dblp_id"), "confidence")


def p8_ids(spark: SparkSession, sf_dir: str) -> DataFrame:
    return tokens.encoded(table(spark, sf_dir, "documents"))


def p9_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    return leaks.leaked_items(table(spark, sf_dir, "documents"), table(spark, sf_dir, "eval_items"))


def p10_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    return sentences.sentences(table(spark, sf_dir, "documents"))


QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    "p1_found": p1_found,
    "p2_found": p2_found,
    "p3_found": p3_found,
    "p4_found": p4_found,
    "p6_found": p6_found,
    "p7_found": p7_found,
    "p7_confidence": p7_confidence,
    "p8_ids": p8_ids,
    "p9_found": p9_found,
    "p10_found": p10_found,
}

_ID = "'W' || regexp_extract(upper(trim({0})), '(?:^|[/:\\s])W([0-9]+)/?$', 1)"
_NO_ABSTRACT = survivors.NO_ABSTRACT.replace("'", "''")
_OWN_DOI = """(SELECT CASE WHEN d <> '' AND NOT regexp_matches(d, '{filler}') AND NOT regexp_matches(d, '{volume}') THEN d END FROM (SELECT regexp_extract(lower(url_decode(replace({0}, '+', '%2B'))), '(10\\.[0-9]{{4,9}}/[^\\s"<>]*[^\\s"<>.,;])', 1) AS d))"""
_P6_DOI = _OWN_DOI.format("payload.doi", filler=identifiers.FILLER, volume=identifiers.VOLUME)

SQL: dict[str, str] = {
    "p2_found": f"""WITH RECURSIVE e AS MATERIALIZED (
  SELECT DISTINCT a, b FROM (SELECT {_ID.format('checked_id')} AS a, {_ID.format('matched_id')} AS b FROM duplicate_results
    WHERE is_duplicate AND regexp_replace(lower(trim(match_type)), '[\\s-]+', '_', 'g') IN ('doi', 'openalex_id', 'acl_id', 'title_year')) WHERE length(a) > 1 AND length(b) > 1 AND a <> b),
u AS MATERIALIZED (SELECT a, b FROM e UNION SELECT b, a FROM e), r AS (SELECT a AS node, a AS seen FROM u UNION SELECT r.node, u.b FROM r JOIN u ON r.seen = u.a)
SELECT node AS record_id, min(seen) AS group_id FROM r GROUP BY node""",
    "p6_found": f"""WITH m AS (SELECT DISTINCT group_id, member_table, member_key FROM dup_members WHERE group_id IS NOT NULL AND member_key IS NOT NULL),
s AS (SELECT point_id, trim(payload.doi) AS written, {_P6_DOI} AS doi, trim(regexp_replace(regexp_replace(payload.abstract, '<[^<>]*>', ' ', 'g'), '[\\s\u00a0]+', ' ', 'g')) AS a, len(list_distinct(list_filter(list_transform(payload.cited_by, lambda c: lower(trim(c))), lambda c: c <> ''))) AS citers FROM seed_stubs),
j AS (SELECT m.group_id, m.member_key AS k, s.*, CASE WHEN regexp_matches(a, '{_NO_ABSTRACT}') THEN NULL ELSE a END AS text FROM m JOIN s ON m.member_table = 'seed_stubs' AND m.member_key = s.point_id),
shared AS (SELECT text FROM j WHERE text IS NOT NULL GROUP BY text HAVING count(DISTINCT group_id) >= {survivors.SHARED_BY}),
p AS (SELECT group_id, 'abstract' AS field, k, (NOT regexp_matches(text, '{survivors.CUT_OFF}'))::INT AS o1, length(regexp_replace(text, '{survivors.CUT_OFF}', '')) AS o2 FROM j WHERE text IS NOT NULL AND text NOT IN (SELECT text FROM shared) AND length(regexp_replace(text, '{survivors.CUT_OFF}', '')) > 0
 UNION ALL SELECT group_id, 'doi', k, (doi = written)::INT, 0 FROM j WHERE doi IS NOT NULL UNION ALL SELECT group_id, 'cited_by', k, citers, 0 FROM j WHERE citers > 0
 UNION ALL SELECT m.group_id, 'openalex_id', m.member_key, starts_with(trim(r.openalex_id), 'W')::INT, 0 FROM m JOIN raw_papers r ON m.member_table = 'raw_papers' AND TRY_CAST(m.member_key AS BIGINT) = r.raw_id WHERE regexp_matches(trim(r.openalex_id), '^([a-zA-Z]+://[^\\s]+/)?[Ww][1-9][0-9]{{3,}}$'))
SELECT group_id, field, CASE field WHEN 'openalex_id' THEN 'raw_papers' ELSE 'seed_stubs' END AS member_table, k AS member_key FROM (SELECT *, row_number() OVER (PARTITION BY group_id, field ORDER BY o1 DESC, o2 DESC, k) AS n FROM p) WHERE n = 1""",
}
