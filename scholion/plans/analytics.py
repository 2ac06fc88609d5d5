"""Scans, predicates, aggregations, windows and top-k over the corpus tables."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window as W, functions as F

from scholion.functions import text as T
from scholion.operators import relational as R, trends
from scholion.runtime import table

NOW = 2025
QUERIES: dict = {}
SQL: dict[str, str] = {}


def query(sql: str | None = None):  # noqa: ANN201
    """Register a query under its function's name, with the SQL it must agree with."""

    def register(function):  # noqa: ANN001, ANN202
        QUERIES[function.__name__] = function
        if sql:
            SQL[function.__name__] = sql
        return function

    return register


def raw(spark: SparkSession, sf: str) -> DataFrame:
    return table(spark, sf, "raw_papers")


@query("""SELECT raw_id, title, year, venue FROM raw_papers WHERE year BETWEEN 2015 AND 2020 AND venue_type = 'conference' AND citation_count >= 2""")
def scan_filter_project(spark, sf):
    return raw(spark, sf).where("year between 2015 and 2020 and venue_type = 'conference' and citation_count >= 2").select("raw_id", "title", "year", "venue")


@query("""SELECT raw_id, year FROM raw_papers WHERE fetched_at >= TIMESTAMP '2024-01-01 00:00:00' AND NOT coalesce(is_core, false)""")
def recent_non_core(spark, sf):
    return raw(spark, sf).where(F.col("fetched_at") >= F.lit("2024-01-01").cast("timestamp_ntz")).where(~F.coalesce("is_core", F.lit(False))).select("raw_id", "year")


@query("""SELECT id, title, citation_count FROM paper_responses WHERE deleted_at IS NULL ORDER BY citation_count DESC NULLS LAST, id, fetched_at LIMIT 25""")
def ordered_index_scan(spark, sf):
    return table(spark, sf, "paper_responses").where("deleted_at is null").orderBy(F.col("citation_count").desc_nulls_last(), "id", "fetched_at").limit(25).select("id", "title", "citation_count")


@query("""SELECT doc_id, source FROM documents ORDER BY doc_id LIMIT 50 OFFSET 100""")
def page_of_documents(spark, sf):
    return table(spark, sf, "documents").select("doc_id", "source").orderBy("doc_id").offset(100).limit(50)


@query("""SELECT doc_id FROM documents ORDER BY md5('7|' || CAST(doc_id AS VARCHAR)), doc_id LIMIT 100""")
def seeded_sample(spark, sf):
    return table(spark, sf, "documents").select("doc_id").orderBy(F.md5(F.concat(F.lit("7|"), F.col("doc_id").cast("string"))), "doc_id").limit(100)


@query("""
SELECT count(*) AS total, count(*) FILTER (coalesce(trim(doi), '') = '') AS without_doi, count(*) FILTER (coalesce(trim(abstract), '') = '') AS without_abstract,
 count(*) FILTER (coalesce(len(referenced_works), 0) = 0) AS without_references, count(*) FILTER (coalesce(trim(pdf_url), '') = '') AS without_pdf,
 count(*) FILTER (coalesce(trim(doi), '') = '' AND coalesce(len(referenced_works), 0) = 0) AS title_only,
 count(*) FILTER (coalesce(len(keywords), 0) = 0) AS without_keywords, count(*) FILTER (coalesce(trim(openalex_id), '') = '') AS without_work_id
FROM raw_papers""")
def backlog_selectors(spark, sf):
    lacks = lambda c, kind="string": ~T.has_value(F.col(c), kind)
    tests = {
        "without_doi": lacks("doi"), "without_abstract": lacks("abstract"), "without_references": lacks("referenced_works", "array"), "without_pdf": lacks("pdf_url"),
        "title_only": lacks("doi") & lacks("referenced_works", "array"), "without_keywords": lacks("keywords", "array"), "without_work_id": lacks("openalex_id"),
    }
    return raw(spark, sf).agg(F.count(F.lit(1)).alias("total"), *[F.count_if(c).alias(n) for n, c in tests.items()])


# Short forms of venues.
ALIASES = {"CALM": "Conference on Adaptive Learning Machines", "AMLS": "Annual Meeting on Language Systems", "TOKG": "Transactions on Open Knowledge Graphs", "SNR": "Symposium on Neural Retrieval"}


@query("SELECT raw_id, venue FROM raw_papers WHERE " + " OR ".join(f"lower(venue) LIKE '%{p.lower()}%'" for pair in ALIASES.items() for p in pair))
def venue_alias_filter(spark, sf):
    patterns = [F.lower("venue").contains(p.lower()) for pair in ALIASES.items() for p in pair]
    hit = patterns[0]
    for p in patterns[1:]:
        hit = hit | p
    return raw(spark, sf).where(hit).select("raw_id", "venue")


@query(r"""SELECT doc_id FROM documents WHERE list_has_all(regexp_split_to_array(lower(text), '[^\p{L}\p{N}_]+'), ['the', 'speech', 'recognition'])""")
def fulltext_word_match(spark, sf):
    wanted = F.array(*map(F.lit, ("the", "speech", "recognition")))
    return table(spark, sf, "documents").where(F.size(F.array_except(wanted, T.words(F.col("text")))) == 0).select("doc_id")


@query("""SELECT point_id, coalesce(is_stub, false) AS is_stub FROM (SELECT point_id, payload.is_stub AS is_stub, payload.title AS title FROM seed_papers
 UNION ALL SELECT point_id, CASE WHEN payload.identifier_type = 'doi' THEN NULL ELSE payload.is_stub END, payload.title FROM seed_stubs)
 WHERE NOT coalesce(is_stub, false) OR coalesce(trim(title), '') <> ''""")
def stub_exclusion_three_valued(spark, sf):
    seeds = table(spark, sf, "seed_papers").select("point_id", "payload.is_stub", "payload.title")
    stubs = table(spark, sf, "seed_stubs").select("point_id", F.when(F.coalesce(F.col("payload.identifier_type") == "doi", F.lit(False)), F.lit(None)).otherwise(F.col("payload.is_stub")).alias("is_stub"), "payload.title")
    stub = F.coalesce("is_stub", F.lit(False))
    return seeds.unionByName(stubs).where(~stub | T.has_value(F.col("title"))).select("point_id", stub.alias("is_stub"))


@query("""WITH k AS (SELECT raw_id, batch_no, openalex_id, nullif(regexp_replace(lower(trim(doi)), '^(https?://[a-z.]*/)?(doi:\\s*)?', ''), '') AS d FROM raw_papers), c AS (SELECT * FROM k WHERE batch_no = 0)
SELECT raw_id, coalesce(openalex_id IN (SELECT openalex_id FROM c WHERE openalex_id IS NOT NULL), false) AS by_work, coalesce(d IN (SELECT d FROM c WHERE d IS NOT NULL), false) AS by_doi FROM k WHERE batch_no > 0""")
def exists_by_identifier(spark, sf):
    """For every work of the later batches whether the corpus (batch 0) has its work id, and its DOI."""
    papers = raw(spark, sf).select("raw_id", "batch_no", "openalex_id", T.plain_doi(F.col("doi")).alias("d"))
    corpus = papers.where("batch_no = 0")
    known = lambda c, name: corpus.where(F.col(c).isNotNull()).select(c).distinct().withColumn(name, F.lit(True))
    joined = papers.where("batch_no > 0").join(known("openalex_id", "by_work"), "openalex_id", "left").join(known("d", "by_doi"), "d", "left")
    return joined.select("raw_id", *[F.coalesce(c, F.lit(False)).alias(c) for c in ("by_work", "by_doi")])


@query("""SELECT d.doc_id FROM documents d WHERE coalesce(trim(d.text), '') <> '' AND NOT EXISTS (SELECT 1 FROM embeddings e WHERE e.vec_id = d.doc_id)""")
def embedding_backlog(spark, sf):
    done = table(spark, sf, "embeddings").select(F.col("vec_id").alias("doc_id"))
    return table(spark, sf, "documents").where(F.coalesce(F.trim("text"), F.lit("")) != "").select("doc_id").join(done, "doc_id", "left_anti")


@query("""SELECT venue, count(*) AS papers, count(DISTINCT source) AS sources, round(avg(citation_count), 6) AS mean_citations FROM raw_papers WHERE coalesce(trim(venue), '') <> '' GROUP BY venue""")
def venue_stats(spark, sf):
    return raw(spark, sf).where(T.has_value(F.col("venue"))).groupBy("venue").agg(F.count(F.lit(1)).alias("papers"), F.countDistinct("source").alias("sources"), F.round(F.avg("citation_count"), 6).alias("mean_citations"))


@query("""SELECT coalesce(venue, 'unknown') AS venue, source, GROUPING(source) AS over_sources, GROUPING(coalesce(venue, 'unknown')) AS over_venues, count(*) AS papers,
 count(*) FILTER (coalesce(trim(doi), '') <> '') AS with_doi, count(*) FILTER (coalesce(trim(abstract), '') <> '') AS with_abstract, count(*) FILTER (len(referenced_works) > 0) AS with_references
FROM raw_papers GROUP BY GROUPING SETS ((source), (coalesce(venue, 'unknown')), ())""")
def data_quality_grouping_sets(spark, sf):
    base = raw(spark, sf).select(
        "source", F.coalesce("venue", F.lit("unknown")).alias("venue"), T.has_value(F.col("doi")).alias("d"), T.has_value(F.col("abstract")).alias("a"), T.has_value(F.col("referenced_works"), "array").alias("r")
    )
    grouped = base.groupingSets([[F.col("source")], [F.col("venue")], []], F.col("source"), F.col("venue"))
    return grouped.agg(F.grouping("source").cast("bigint").alias("over_sources"), F.grouping("venue").cast("bigint").alias("over_venues"), F.count(F.lit(1)).alias("papers"), F.count_if("d").alias("with_doi"), F.count_if("a").alias("with_abstract"), F.count_if("r").alias("with_references"))


@query("""SELECT kind, count(*) AS n FROM (SELECT CASE WHEN regexp_matches(ref, '^W[0-9]+$') THEN 'work' WHEN regexp_matches(trim(ref), '(?i)w[0-9]+$') THEN 'work in another writing' WHEN coalesce(trim(ref), '') = '' THEN 'empty' ELSE 'other' END AS kind
 FROM (SELECT unnest(payload.referenced_works) AS ref FROM seed_papers)) GROUP BY kind""")
def ref_type_histogram(spark, sf):
    ref = F.col("ref")
    kind = F.when(ref.rlike("^W[0-9]+$"), "work").when(F.trim(ref).rlike("(?i)w[0-9]+$"), "work in another writing").when(F.coalesce(F.trim(ref), F.lit("")) == "", "empty").otherwise("other")
    return table(spark, sf, "seed_papers").select(F.explode("payload.referenced_works").alias("ref")).groupBy(kind.alias("kind")).agg(F.count(F.lit(1)).alias("n"))


@query("""SELECT payload.identifier_type AS identifier_type, count(*) AS stubs, count(*) FILTER (coalesce(trim(payload.title), '') <> '') AS titled, sum(coalesce(len(payload.cited_by), 0))::BIGINT AS citations,
 round(avg(coalesce(len(payload.cited_by), 0)), 6) AS mean_citations, max(coalesce(len(payload.cited_by), 0))::BIGINT AS most FROM seed_stubs GROUP BY 1""")
def stub_stats(spark, sf):
    n = F.greatest(F.coalesce(F.size("payload.cited_by"), F.lit(0)), F.lit(0)).cast("bigint")
    stubs = table(spark, sf, "seed_stubs").select("payload.identifier_type", "payload.title", n.alias("n"))
    return stubs.groupBy("identifier_type").agg(F.count(F.lit(1)).alias("stubs"), F.count_if(T.has_value(F.col("title"))).alias("titled"), F.sum("n").alias("citations"), F.round(F.avg("n"), 6).alias("mean_citations"), F.max("n").alias("most"))


@query("""SELECT point_id, title, n FROM (SELECT point_id, payload.title AS title, len(payload.cited_by)::BIGINT AS n FROM seed_stubs WHERE coalesce(trim(payload.title), '') <> '') WHERE n >= 3 ORDER BY n DESC, point_id LIMIT 20""")
def most_cited_stubs(spark, sf):
    stubs = table(spark, sf, "seed_stubs").select("point_id", "payload.title", F.size("payload.cited_by").cast("bigint").alias("n"))
    return stubs.where(T.has_value(F.col("title")) & (F.col("n") >= 3)).orderBy(F.col("n").desc(), "point_id").limit(20)


@query("""WITH top AS (SELECT point_id, payload.venue AS venue, len(payload.cited_by)::BIGINT AS n FROM seed_stubs WHERE coalesce(len(payload.cited_by), 0) > 0 ORDER BY n DESC, point_id LIMIT 100)
SELECT coalesce(nullif(trim(venue), ''), 'unknown') AS venue, count(*) AS stubs, sum(n)::BIGINT AS citations FROM top GROUP BY 1 ORDER BY stubs DESC, venue LIMIT 15""")
def corpus_gaps(spark, sf):
    stubs = table(spark, sf, "seed_stubs").select("point_id", "payload.venue", F.size("payload.cited_by").cast("bigint").alias("n")).where("n > 0")
    top = stubs.orderBy(F.col("n").desc(), "point_id").limit(100)
    shown = F.coalesce(F.nullif(F.trim("venue"), F.lit("")), F.lit("unknown")).alias("venue")
    return top.groupBy(shown).agg(F.count(F.lit(1)).alias("stubs"), F.sum("n").alias("citations")).orderBy(F.col("stubs").desc(), "venue").limit(15)


_NOTABLE = """WITH m AS (SELECT coalesce(nullif(max(coalesce(citation_count, 0)), 0), 1) AS mc FROM raw_papers)
SELECT raw_id, title, year, tier, citation_count, round(0.3 * coalesce(citation_count, 0) / mc + 0.2 * coalesce(greatest(0.0, least(1.0, (year - 2019) / 6.0)), 0.0)
 + 0.2 * CASE tier WHEN 0 THEN 1.0 WHEN 1 THEN 0.7 WHEN 2 THEN 0.4 ELSE 0.3 END, 6)::DOUBLE AS notable_score FROM raw_papers, m ORDER BY notable_score DESC, raw_id LIMIT 50"""


@query(_NOTABLE)
def notable_topk(spark, sf):
    papers = raw(spark, sf).select("raw_id", "title", "year", "tier", "citation_count")
    return trends.notable(papers, NOW, 50)


_COUNTS = """SELECT lower(trim(k)) AS keyword, coalesce(paper_type, 'other') AS category, year, count(*) AS n FROM (SELECT unnest(keywords) AS k, paper_type, year FROM raw_papers WHERE coalesce(year, 0) <> 0) WHERE trim(k) <> '' GROUP BY ALL"""


def _counts(spark, sf):
    return trends.keyword_counts(raw(spark, sf), "keywords", F.coalesce("paper_type", F.lit("other")))


@query(_COUNTS)
def keyword_trends(spark, sf):
    return _counts(spark, sf)


@query(f"""WITH c AS ({_COUNTS}), g AS (SELECT keyword, sum(n)::BIGINT AS total, sum(CASE WHEN year IN (2025, 2024) THEN n ELSE 0 END)::BIGINT AS recent, sum(CASE WHEN year IN (2023, 2022) THEN n ELSE 0 END)::BIGINT AS older FROM c GROUP BY keyword)
SELECT *, CASE WHEN older > 0 THEN round(recent::DOUBLE / older, 6) WHEN recent > 0 THEN 'Infinity'::DOUBLE ELSE 0.0 END AS growth FROM g WHERE total >= 5""")
def rising_keywords(spark, sf):
    return trends.growth(_counts(spark, sf), NOW, 5, ["keyword"])


@query("""SELECT kw, count(*) AS n FROM (SELECT lower(trim(unnest(keywords))) AS kw FROM raw_papers) WHERE kw LIKE 's%' GROUP BY kw ORDER BY n DESC, kw LIMIT 10""")
def prefix_suggest(spark, sf):
    return raw(spark, sf).select(F.explode("keywords").alias("k")).select(F.lower(F.trim("k")).alias("kw")).where(F.col("kw").startswith("s")).groupBy("kw").agg(F.count(F.lit(1)).alias("n")).orderBy(F.col("n").desc(), "kw").limit(10)


@query("""SELECT coalesce(keywords_source, 'none') AS keywords_source, count(*) AS papers, round(avg(n), 6) AS mean_keywords FROM (SELECT CASE WHEN coalesce(len(keywords), 0) > 0 THEN source END AS keywords_source, len(keywords) AS n FROM raw_papers) GROUP BY 1""")
def keyword_stats(spark, sf):
    some = T.has_value(F.col("keywords"), "array")
    return raw(spark, sf).groupBy(F.when(some, F.col("source")).otherwise("none").alias("keywords_source")).agg(F.count(F.lit(1)).alias("papers"), F.round(F.avg(F.when(F.col("keywords").isNotNull(), F.size("keywords"))), 6).alias("mean_keywords"))


@query("""WITH k AS (SELECT tier, lower(trim(unnest(keywords))) AS kw FROM raw_papers WHERE tier IS NOT NULL), c AS (SELECT tier, kw, count(*) AS n FROM k WHERE kw <> '' GROUP BY ALL),
r AS (SELECT *, row_number() OVER (PARTITION BY tier ORDER BY n DESC, kw) AS p FROM c), s AS (SELECT tier, count(*) AS members FROM raw_papers WHERE tier IS NOT NULL GROUP BY tier)
SELECT s.tier, members, coalesce((SELECT string_agg(kw, ', ' ORDER BY p) FROM r WHERE r.tier = s.tier AND p <= 3), 'Cluster ' || s.tier) AS label, coalesce((SELECT string_agg(kw, '|' ORDER BY p) FROM r WHERE r.tier = s.tier AND p <= 10), '') AS keywords FROM s""")
def cluster_metadata(spark, sf):
    return trends.cluster_profiles(raw(spark, sf).where("tier is not null"), "tier", "keywords")


@query("""SELECT source, raw_id, citation_count, place FROM (SELECT source, raw_id, citation_count, row_number() OVER (PARTITION BY source ORDER BY citation_count DESC NULLS LAST, raw_id)::INT AS place FROM raw_papers) WHERE place <= 5""")
def top_n_per_group(spark, sf):
    place = F.row_number().over(W.partitionBy("source").orderBy(F.col("citation_count").desc_nulls_last(), "raw_id"))
    return raw(spark, sf).select("source", "raw_id", "citation_count", place.alias("place")).where("place <= 5")


@query("""WITH v AS (SELECT venue, count(*) AS n FROM raw_papers WHERE coalesce(trim(venue), '') <> '' GROUP BY venue), r AS (SELECT *, row_number() OVER (ORDER BY n DESC, venue) AS p FROM v)
SELECT CASE WHEN p <= 10 THEN venue ELSE '(others)' END AS venue, sum(n)::BIGINT AS papers FROM r GROUP BY 1""")
def top_venues_with_tail(spark, sf):
    counts = raw(spark, sf).where(T.has_value(F.col("venue"))).groupBy("venue").agg(F.count(F.lit(1)).alias("n"))
    best = counts.orderBy(F.col("n").desc(), "venue").limit(10).select("venue", F.lit(True).alias("best"))
    shown = F.when(F.col("best"), F.col("venue")).otherwise("(others)")
    return counts.join(F.broadcast(best), "venue", "left").groupBy(shown.alias("venue")).agg(F.sum("n").alias("papers"))


_CHECKS = {
    "titles_present": ("coalesce(trim(title), '') <> ''", 1.0), "abstract_coverage": ("coalesce(trim(abstract), '') <> ''", 0.8), "doi_coverage": ("coalesce(trim(doi), '') <> ''", 0.6), "venue_coverage": ("coalesce(trim(venue), '') <> ''", 0.8),
    "year_coverage": ("coalesce(year, 0) <> 0", 0.8), "keywords_coverage": ("coalesce({size}(keywords), 0) > 0", 0.5),
}


@query(" UNION ALL ".join(f"SELECT '{n}' AS check_name, round(avg(CASE WHEN {p.format(size='len')} THEN 1.0 ELSE 0.0 END), 6)::DOUBLE AS share, avg(CASE WHEN {p.format(size='len')} THEN 1.0 ELSE 0.0 END) >= {t} AS passed FROM raw_papers" for n, (p, t) in _CHECKS.items()))
def dq_checks(spark, sf):
    shares = raw(spark, sf).agg(*[F.avg(F.when(F.expr(p.format(size="size")), 1.0).otherwise(0.0)).alias(n) for n, (p, _) in _CHECKS.items()])
    rows = F.explode(F.array(*[F.struct(F.lit(n).alias("check_name"), F.round(F.col(n), 6).alias("share"), (F.col(n) >= t).alias("passed")) for n, (_, t) in _CHECKS.items()])).alias("x")
    return shares.select(rows).select("x.*")


@query("""SELECT coalesce(year, -1) AS year, count(*) AS papers, round(100.0 * count(*) FILTER (coalesce(trim(abstract), '') <> '') / count(*), 1)::DOUBLE AS abstract_pct, round(100.0 * count(*) FILTER (len(authors) > 0) / count(*), 1)::DOUBLE AS authors_pct FROM paper_responses WHERE deleted_at IS NULL GROUP BY 1""")
def dashboard_coverage(spark, sf):
    pct = lambda c: F.round(F.lit(100.0) * F.count_if(c) / F.count(F.lit(1)), 1)
    live = table(spark, sf, "paper_responses").where("deleted_at is null")
    return live.groupBy(F.coalesce("year", F.lit(-1)).alias("year")).agg(F.count(F.lit(1)).alias("papers"), pct(T.has_value(F.col("abstract"))).alias("abstract_pct"), pct(T.has_value(F.col("authors"), "array")).alias("authors_pct"))


@query("""SELECT coalesce(venue_type, 'none') AS venue_type, coalesce(paper_type, 'none') AS paper_type, GROUPING(coalesce(venue_type, 'none'), coalesce(paper_type, 'none')) AS level, count(*) AS papers, count(DISTINCT venue) AS venues FROM raw_papers GROUP BY CUBE (coalesce(venue_type, 'none'), coalesce(paper_type, 'none'))""")
def type_cube(spark, sf):
    base = raw(spark, sf).select(F.coalesce("venue_type", F.lit("none")).alias("venue_type"), F.coalesce("paper_type", F.lit("none")).alias("paper_type"), "venue")
    return base.cube("venue_type", "paper_type").agg(F.grouping_id().alias("level"), F.count(F.lit(1)).alias("papers"), F.countDistinct("venue").alias("venues"))


@query("""SELECT source, round(avg(len(text)), 4) AS mean_chars, round(quantile_cont(len(text), 0.5), 4) AS median_chars, min(len(text))::BIGINT AS least, max(len(text))::BIGINT AS most FROM documents GROUP BY source""")
def size_estimates(spark, sf):
    n = F.length("text")
    return table(spark, sf, "documents").groupBy("source").agg(F.round(F.avg(n), 4).alias("mean_chars"), F.round(F.percentile(n, 0.5), 4).alias("median_chars"), F.min(n).cast("bigint").alias("least"), F.max(n).cast("bigint").alias("most"))


@query("""WITH a AS (SELECT raw_id, list_sort(list_distinct(keywords)) AS x, list_sort(list_distinct(categories)) AS y FROM raw_papers WHERE len(keywords) > 0 AND len(categories) > 0)
SELECT count(*) AS papers, round(avg(len(list_intersect(x, y)) * 1.0 / (len(x) + len(y) - len(list_intersect(x, y)))), 6)::DOUBLE AS mean_jaccard, sum(len(list_intersect(x, y)))::BIGINT AS tp, sum(len(x) - len(list_intersect(x, y)))::BIGINT AS fp, sum(len(y) - len(list_intersect(x, y)))::BIGINT AS fn FROM a""")
def label_agreement(spark, sf):
    both = raw(spark, sf).where((F.size("keywords") > 0) & (F.size("categories") > 0)).select(F.array_distinct("keywords").alias("x"), F.array_distinct("categories").alias("y"))
    common, nx, ny = F.size(F.array_intersect("x", "y")), F.size("x"), F.size("y")
    return both.agg(F.count(F.lit(1)).alias("papers"), F.round(F.avg(common / (nx + ny - common)), 6).alias("mean_jaccard"), F.sum(common).alias("tp"), F.sum(nx - common).alias("fp"), F.sum(ny - common).alias("fn"))


# Deduplication windows
@query("""SELECT source, source_id, raw_id FROM (SELECT source, source_id, raw_id, row_number() OVER (PARTITION BY source, source_id ORDER BY raw_id) AS p FROM raw_papers) WHERE p = 1""")
def dedup_first_wins(spark, sf):
    return R.first_wins(raw(spark, sf).select("source", "source_id", "raw_id"), ["source", "source_id"], [F.col("raw_id")])


@query("""WITH s AS (SELECT nullif(regexp_replace(lower(trim(doi)), '^(https?://[a-z.]*/)?(doi:\\s*)?', ''), '') AS doi, raw_id, (4 * (coalesce(trim(abstract), '') <> '')::INT + 2 * (coalesce(len(keywords), 0) > 0)::INT + least(coalesce(len(abstract), 0) // 200, 3))::BIGINT AS score FROM raw_papers)
SELECT doi, raw_id, score FROM (SELECT *, row_number() OVER (PARTITION BY doi ORDER BY score DESC, raw_id) AS p FROM s WHERE doi IS NOT NULL) WHERE p = 1""".replace("\\\\", "\\"))
def dedup_richest(spark, sf):
    score = 4 * T.has_value(F.col("abstract")).cast("bigint") + 2 * T.has_value(F.col("keywords"), "array").cast("bigint") + F.least(F.floor(F.coalesce(F.length("abstract"), F.lit(0)) / 200), F.lit(3))
    return R.richest_wins(raw(spark, sf).withColumn("doi", T.plain_doi(F.col("doi"))), "doi", "raw_id", score.cast("bigint"))


# Which source is believed first.
PRIORITY = ("acl", "openreview", "dblp", "openalex", "semantic_scholar", "arxiv")


@query(f"""SELECT work, raw_id, source FROM (SELECT openalex_id AS work, raw_id, source, row_number() OVER (PARTITION BY openalex_id ORDER BY coalesce(nullif(list_position({list(PRIORITY)}, source), 0), 99), raw_id) AS p FROM raw_papers WHERE regexp_matches(openalex_id, '^W[0-9]+$')) WHERE p = 1""")
def dedup_source_priority(spark, sf):
    rank = F.coalesce(F.nullif(F.array_position(F.array(*map(F.lit, PRIORITY)), F.col("source")), F.lit(0)), F.lit(99))
    works = raw(spark, sf).where(F.col("openalex_id").rlike("^W[0-9]+$")).select(F.col("openalex_id").alias("work"), "raw_id", "source")
    return R.first_wins(works, ["work"], [rank, F.col("raw_id")])


# General relational capabilities over the star schema
@query("""SELECT l_returnflag, l_linestatus, sum(l_quantity) AS quantity, round(sum(l_extendedprice * (1 - l_discount)), 2) AS revenue, round(avg(l_discount), 6) AS discount, count(*) AS n FROM lineitem WHERE l_shipdate <= TIMESTAMP '2000-12-01 00:00:00' GROUP BY ALL""")
def pricing_summary(spark, sf):
    lines = table(spark, sf, "lineitem").where(F.col("l_shipdate") <= F.lit("2000-12-01").cast("timestamp_ntz"))
    return lines.groupBy("l_returnflag", "l_linestatus").agg(F.sum("l_quantity").alias("quantity"), F.round(F.sum(F.col("l_extendedprice") * (1 - F.col("l_discount"))), 2).alias("revenue"), F.round(F.avg("l_discount"), 6).alias("discount"), F.count(F.lit(1)).alias("n"))


@query("""SELECT r_name, n_name, count(DISTINCT o_orderkey) AS orders, round(sum(l_extendedprice * (1 - l_discount)), 2) AS revenue FROM lineitem JOIN orders ON l_orderkey = o_orderkey JOIN customer ON o_custkey = c_custkey JOIN nation ON c_nationkey = n_nationkey JOIN region ON n_regionkey = r_regionkey GROUP BY ALL""")
def star_join_revenue(spark, sf):
    t = lambda n: table(spark, sf, n)
    joined = t("lineitem").join(t("orders"), F.col("l_orderkey") == F.col("o_orderkey")).join(t("customer"), F.col("o_custkey") == F.col("c_custkey"))
    named = joined.join(t("nation"), F.col("c_nationkey") == F.col("n_nationkey")).join(t("region"), F.col("n_regionkey") == F.col("r_regionkey"))
    return named.groupBy("r_name", "n_name").agg(F.countDistinct("o_orderkey").alias("orders"), F.round(F.sum(F.col("l_extendedprice") * (1 - F.col("l_discount"))), 2).alias("revenue"))


@query("""SELECT o_orderstatus, o_orderpriority, GROUPING(o_orderstatus, o_orderpriority) AS level, count(*) AS n FROM orders GROUP BY ROLLUP (o_orderstatus, o_orderpriority)""")
def rollup_orders(spark, sf):
    return table(spark, sf, "orders").rollup("o_orderstatus", "o_orderpriority").agg(F.grouping_id().alias("level"), F.count(F.lit(1)).alias("n"))


@query("""SELECT o_orderkey, o_custkey, round(sum(o_totalprice) OVER w, 2) AS running, round(avg(o_totalprice) OVER (PARTITION BY o_custkey ORDER BY o_orderdate, o_orderkey ROWS BETWEEN 2 PRECEDING AND CURRENT ROW), 4) AS moving, lag(o_totalprice) OVER w AS before FROM orders WINDOW w AS (PARTITION BY o_custkey ORDER BY o_orderdate, o_orderkey)""")
def window_frames(spark, sf):
    w = W.partitionBy("o_custkey").orderBy("o_orderdate", "o_orderkey")
    return table(spark, sf, "orders").select("o_orderkey", "o_custkey", F.round(F.sum("o_totalprice").over(w.rowsBetween(W.unboundedPreceding, 0)), 2).alias("running"), F.round(F.avg("o_totalprice").over(w.rowsBetween(-2, 0)), 4).alias("moving"), F.lag("o_totalprice").over(w).alias("before"))


@query("""SELECT c_custkey FROM customer WHERE c_custkey IN (SELECT o_custkey FROM orders) EXCEPT SELECT o_custkey FROM orders WHERE o_orderstatus = 'F' UNION ALL (SELECT c_custkey FROM customer INTERSECT SELECT o_custkey FROM orders WHERE o_orderpriority LIKE '1%')""")
def set_operations(spark, sf):
    customers, orders = table(spark, sf, "customer").select("c_custkey"), table(spark, sf, "orders")
    active = customers.join(orders.select(F.col("o_custkey").alias("c_custkey")), "c_custkey", "left_semi").subtract(orders.where("o_orderstatus = 'F'").select("o_custkey"))
    return active.unionByName(customers.intersect(orders.where("o_orderpriority like '1%'").select(F.col("o_custkey").alias("c_custkey"))))
