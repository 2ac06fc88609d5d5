"""Queries over references to records that do not exist."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from scholion.operators import orphans
from scholion.runtime import table


def _replayed(spark: SparkSession, sf_dir: str, snapshots: bool = False) -> tuple[orphans.OrphanState, DataFrame | None]:
    """What the tables hold, quarter by quarter in the order it came."""
    papers, seeds, stubs = (table(spark, sf_dir, t) for t in ("paper_responses", "seed_papers", "seed_stubs"))
    return orphans.replay(orphans.references(papers, seeds), orphans.parents(papers, seeds, stubs), snapshots=snapshots)


def _orphans(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _replayed(spark, sf_dir)[0].open


def p5_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    return orphans.found(_orphans(spark, sf_dir))


def p5_report(spark: SparkSession, sf_dir: str) -> DataFrame:
    return orphans.report(_orphans(spark, sf_dir))


def p5_snapshots(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Orphans after each quarter, as they were known then."""
    return _replayed(spark, sf_dir, snapshots=True)[1]


QUERIES = {"p5_found": p5_found, "p5_report": p5_report, "p5_snapshots": p5_snapshots}

_UUID = r"([0-9a-f]{8})-?([0-9a-f]{4})-?([0-9a-f]{4})-?([0-9a-f]{4})-?([0-9a-f]{12})"


def _record(x: str) -> str:
    return f"CASE WHEN regexp_matches(lower(trim({x})), '{_UUID}') THEN regexp_replace(lower(trim({x})), '^.*?{_UUID}.*$', '\\1-\\2-\\3-\\4-\\5') WHEN trim({x}) <> '' THEN lower(trim({x})) END"


def _work(x: str) -> str:
    return f"CASE WHEN regexp_matches(upper(trim({x})), 'W[0-9]+/?$') THEN regexp_extract(upper(trim({x})), '(W[0-9]+)/?$', 1) WHEN trim({x}) <> '' THEN trim({x}) END"


_ORPHANS = f"""
WITH refs AS (
  SELECT 'paper_responses' AS src_table, 'resolved_references' AS field, 'record' AS space, id AS owner_id, {_record('ref')} AS ref_id, updated_at, fetched_at
  FROM (SELECT id, updated_at, fetched_at, unnest(resolved_references) AS ref FROM paper_responses)
  UNION ALL SELECT 'paper_responses', 'cited_by', 'record', id, {_record('ref')}, updated_at, fetched_at
  FROM (SELECT id, updated_at, fetched_at, unnest(cited_by) AS ref FROM paper_responses)
  UNION ALL SELECT 'seed_papers', 'referenced_works', 'work', point_id, {_work('ref')}, updated_at, fetched_at
  FROM (SELECT point_id, updated_at, fetched_at, unnest(payload.referenced_works) AS ref FROM seed_papers)
), known AS (
  SELECT space, ref_id, min(first_seen) AS first_seen, max(deleted_at) AS deleted_at FROM (
    SELECT 'record' AS space, {_record('id')} AS ref_id, fetched_at AS first_seen, deleted_at FROM paper_responses
    UNION ALL SELECT 'record', {_record('point_id')}, NULL, NULL FROM seed_papers
    UNION ALL SELECT 'record', {_record('point_id')}, NULL, NULL FROM seed_stubs
    UNION ALL SELECT 'work', {_work('openalex_id')}, fetched_at, deleted_at FROM paper_responses
    UNION ALL SELECT 'work', {_work('payload.openalex_id')}, NULL, NULL FROM seed_papers
  ) WHERE ref_id IS NOT NULL GROUP BY space, ref_id
), judged AS (
  SELECT r.src_table, r.field, r.owner_id, r.ref_id, r.fetched_at,
    CASE WHEN k.ref_id IS NULL THEN 'missing' WHEN k.deleted_at IS NOT NULL THEN 'deleted' WHEN k.first_seen > r.updated_at THEN 'late' END AS kind
  FROM refs r LEFT JOIN known k ON r.space = k.space AND r.ref_id = k.ref_id
  WHERE r.ref_id IS NOT NULL AND r.owner_id IS NOT NULL
)"""

# The same as of the end of each quarter: what had come by then.
_QUARTERS = _ORPHANS[: _ORPHANS.index("), known AS (")] + f"""), arrivals AS (
    SELECT 'record' AS space, {_record('id')} AS ref_id, fetched_at AS first_seen, deleted_at FROM paper_responses
    UNION ALL SELECT 'record', {_record('point_id')}, NULL, NULL FROM seed_papers
    UNION ALL SELECT 'record', {_record('point_id')}, NULL, NULL FROM seed_stubs
    UNION ALL SELECT 'work', {_work('openalex_id')}, fetched_at, deleted_at FROM paper_responses
    UNION ALL SELECT 'work', {_work('payload.openalex_id')}, NULL, NULL FROM seed_papers
), q AS (SELECT DISTINCT date_trunc('quarter', t)::DATE AS period FROM (SELECT updated_at AS t FROM refs WHERE ref_id IS NOT NULL AND owner_id IS NOT NULL UNION ALL SELECT first_seen FROM arrivals WHERE ref_id IS NOT NULL UNION ALL SELECT deleted_at FROM arrivals WHERE ref_id IS NOT NULL) WHERE t IS NOT NULL),
known AS (SELECT period, space, ref_id, min(first_seen) AS first_seen, max(CASE WHEN deleted_at < period + INTERVAL 3 MONTH THEN deleted_at END) AS deleted_at FROM q, arrivals
  WHERE ref_id IS NOT NULL AND (first_seen IS NULL OR first_seen < period + INTERVAL 3 MONTH OR deleted_at < period + INTERVAL 3 MONTH) GROUP BY period, space, ref_id),
judged AS (SELECT q.period, r.src_table, r.field, r.owner_id, r.ref_id,
    CASE WHEN k.ref_id IS NULL THEN 'missing' WHEN k.deleted_at IS NOT NULL THEN 'deleted' WHEN k.first_seen > r.updated_at THEN 'late' END AS kind
  FROM q JOIN refs r ON r.updated_at IS NULL OR r.updated_at < q.period + INTERVAL 3 MONTH LEFT JOIN known k ON k.period = q.period AND r.space = k.space AND r.ref_id = k.ref_id
  WHERE r.ref_id IS NOT NULL AND r.owner_id IS NOT NULL)
SELECT period, src_table, field, kind, count(DISTINCT (owner_id, ref_id)) AS orphans FROM judged WHERE kind IS NOT NULL GROUP BY ALL"""

SQL = {
    "p5_snapshots": _QUARTERS,
    "p5_found": _ORPHANS + " SELECT DISTINCT src_table, field, owner_id, ref_id, kind FROM judged WHERE kind IS NOT NULL",
    "p5_report": _ORPHANS
    + """, once AS (SELECT DISTINCT src_table, field, owner_id, ref_id, kind, strftime(fetched_at, '%Y-%m') AS month FROM judged WHERE kind IS NOT NULL)
SELECT src_table, field, kind, month, count(*) AS orphans, count(DISTINCT owner_id) AS owners FROM once GROUP BY ALL""",
}
