"""Data-quality checks and summaries: each table is read once, however many shares are asked of it."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F

from scholion.functions import text as T
from scholion.operators import graph as G
from scholion.plans.graphs import _E, edges
from scholion.plans.registry import Registry
from scholion.runtime import table

REGISTRY = Registry()
query = REGISTRY.query
QUERIES, SQL = REGISTRY.queries, REGISTRY.sql

# The least or greatest shares that the checks allow.
LIMITS = {"doi_papers_have_references": 0.80, "abstract_coverage": 0.80, "nontarget_share": 0.05, "no_topic_share": 0.01, "nonpaper_share": 0.005, "noise_share": 0.40, "labelling_backlog": 1000}


def _check(name: str, value: Column, passed: Column) -> Column:
    return F.struct(F.lit(name).alias("check_name"), F.round(value.cast("double"), 6).alias("value"), passed.alias("passed"))


def _ratio(part: Column, whole: Column, empty: float) -> Column:
    return F.when(whole == 0, F.lit(empty)).otherwise(part / whole)


@query("""WITH a AS (SELECT count(*) FILTER (coalesce(trim(doi), '') <> '') AS doi, count(*) FILTER (coalesce(trim(doi), '') <> '' AND len(referenced_works) > 0) AS doi_refs, count(*) AS n, count(*) FILTER (coalesce(trim(abstract), '') <> '') AS abs_,
 count(*) FILTER (title IS NULL) AS untitled, count(*) FILTER (coalesce(len(categories), 0) = 0) AS no_topic, count(*) FILTER (len(categories) > 0 AND len(list_filter(categories, lambda c: starts_with(c, 'cs.'))) = 0) AS off_topic, count(*) FILTER (paper_type IN ('dataset', 'other')) AS nonpaper,
 count(*) FILTER (coalesce(trim(abstract), '') <> '' AND coalesce(len(keywords), 0) = 0) AS unlabelled FROM raw_papers WHERE batch_no = 0),
c AS (SELECT 'doi_papers_have_references' AS check_name, CASE WHEN doi = 0 THEN 1.0 ELSE doi_refs / doi END AS value, CASE WHEN doi = 0 THEN 1.0 ELSE doi_refs / doi END >= 0.8 AS passed FROM a UNION ALL SELECT 'abstract_coverage', CASE WHEN n = 0 THEN 1.0 ELSE abs_ / n END, CASE WHEN n = 0 THEN 1.0 ELSE abs_ / n END >= 0.8 FROM a
 UNION ALL SELECT 'records_have_titles', untitled, untitled = 0 FROM a UNION ALL SELECT 'no_topic_share', CASE WHEN n = 0 THEN 0.0 ELSE no_topic / n END, CASE WHEN n = 0 THEN 0.0 ELSE no_topic / n END <= 0.01 FROM a
 UNION ALL SELECT 'nontarget_share', CASE WHEN n = 0 THEN 0.0 ELSE off_topic / n END, CASE WHEN n = 0 THEN 0.0 ELSE off_topic / n END <= 0.05 FROM a UNION ALL SELECT 'nonpaper_share', CASE WHEN n = 0 THEN 0.0 ELSE nonpaper / n END, CASE WHEN n = 0 THEN 0.0 ELSE nonpaper / n END <= 0.005 FROM a UNION ALL SELECT 'labelling_backlog', unlabelled, unlabelled <= 1000 FROM a)
SELECT check_name, round(value::DOUBLE, 6) AS value, passed FROM c""")
def dq_corpus(spark, sf):
    """The checks on records: references of those with a DOI, abstracts, titles, topics, types, and what is not labelled yet."""
    has = lambda c, kind="string": T.has_value(F.col(c), kind)
    on_topic = F.exists("categories", lambda c: F.startswith(c, F.lit("cs.")))
    counts = table(spark, sf, "raw_papers").where("batch_no = 0").agg(
        F.count(F.lit(1)).alias("n"), F.count_if(has("doi")).alias("doi"), F.count_if(has("doi") & has("referenced_works", "array")).alias("doi_refs"), F.count_if(has("abstract")).alias("abs"), F.count_if(F.col("title").isNull()).alias("untitled"),
        F.count_if(~has("categories", "array")).alias("no_topic"), F.count_if(has("categories", "array") & ~F.coalesce(on_topic, F.lit(False))).alias("off"), F.count_if(F.col("paper_type").isin("dataset", "other")).alias("nonpaper"), F.count_if(has("abstract") & ~has("keywords", "array")).alias("unlabelled"),
    )
    n = F.col("n")
    share = lambda name, c, least: _check(name, _ratio(F.col(c), n, 1.0 if least else 0.0), (_ratio(F.col(c), n, 1.0) >= LIMITS[name]) if least else (_ratio(F.col(c), n, 0.0) <= LIMITS[name]))
    refs = _ratio(F.col("doi_refs"), F.col("doi"), 1.0)
    rows = [
        _check("doi_papers_have_references", refs, refs >= LIMITS["doi_papers_have_references"]), share("abstract_coverage", "abs", True), _check("records_have_titles", F.col("untitled"), F.col("untitled") == 0),
        share("no_topic_share", "no_topic", False), share("nontarget_share", "off", False), share("nonpaper_share", "nonpaper", False), _check("labelling_backlog", F.col("unlabelled"), F.col("unlabelled") <= LIMITS["labelling_backlog"]),
    ]
    return counts.select(F.explode(F.array(*rows)).alias("x")).select("x.*")


@query(f"""WITH {_E}, m AS (SELECT count(*) AS n FROM documents d WHERE coalesce(trim(d.text), '') <> '' AND NOT EXISTS (SELECT 1 FROM embeddings e WHERE e.vec_id = d.doc_id)), g AS (SELECT count(*) AS n FROM (SELECT src FROM e UNION SELECT dst FROM e)),
c AS (SELECT count(*) AS n, count(*) FILTER (label = 0) AS noise FROM embeddings), s AS (SELECT count(*) FILTER (n = 0) AS silent FROM (SELECT k.source, count(r.source) FILTER (r.batch_no = 8) AS n FROM (SELECT DISTINCT source FROM raw_papers WHERE source IS NOT NULL) k LEFT JOIN raw_papers r ON r.source = k.source GROUP BY k.source))
SELECT 'embedding_coverage' AS check_name, m.n::DOUBLE AS value, m.n = 0 AS passed FROM m UNION ALL SELECT 'graph_metrics_stored', g.n, g.n > 0 FROM g UNION ALL SELECT 'cluster_coverage', round(noise / n, 6), noise / n <= 0.4 AND noise < n FROM c UNION ALL SELECT 'source_not_silently_zero', silent, silent = 0 FROM s""")
def dq_derived(spark, sf):
    """The checks on what is derived: vectors for all texts, a graph, clusters with little noise (label 0), and no source silent in the last batch."""
    missing = table(spark, sf, "documents").where(T.has_value(F.col("text"))).join(table(spark, sf, "embeddings").select(F.col("vec_id").alias("doc_id")), "doc_id", "left_anti").agg(F.count(F.lit(1)).alias("v"))
    nodes = G.nodes_of(edges(spark, sf)).agg(F.count(F.lit(1)).alias("v"))
    clusters = table(spark, sf, "embeddings").agg(F.count(F.lit(1)).alias("n"), F.count_if(F.col("label") == 0).alias("noise"))
    silent = table(spark, sf, "raw_papers").where("source is not null").groupBy("source").agg(F.count_if(F.col("batch_no") == 8).alias("n")).agg(F.count_if(F.col("n") == 0).alias("v"))
    row = lambda frame, *check: frame.select(_check(*check).alias("x")).select("x.*")
    v, noise = F.col("v"), F.col("noise") / F.col("n")
    out = row(missing, "embedding_coverage", v, v == 0).unionByName(row(nodes, "graph_metrics_stored", v, v > 0))
    return out.unionByName(row(clusters, "cluster_coverage", noise, (noise <= LIMITS["noise_share"]) & (F.col("noise") < F.col("n")))).unionByName(row(silent, "source_not_silently_zero", v, v == 0))


@query("""SELECT count(*) AS total, count(*) FILTER (is_stub) AS stubs, count(*) FILTER (NOT is_stub) AS records, count(*) FILTER (coalesce(trim(abstract), '') <> '') AS with_abstract FROM (SELECT coalesce(payload.is_stub, false) AS is_stub, payload.abstract AS abstract FROM seed_papers UNION ALL SELECT coalesce(payload.is_stub, false), payload.abstract FROM seed_stubs)""")
def corpus_stats(spark, sf):
    both = table(spark, sf, "seed_papers").select("payload.is_stub", "payload.abstract").unionByName(table(spark, sf, "seed_stubs").select("payload.is_stub", "payload.abstract"))
    stub = F.coalesce("is_stub", F.lit(False))
    return both.agg(F.count(F.lit(1)).alias("total"), F.count_if(stub).alias("stubs"), F.count_if(~stub).alias("records"), F.count_if(T.has_value(F.col("abstract"))).alias("with_abstract"))


_COVER = {"doi": "coalesce(trim(doi), '') <> ''", "abstract": "coalesce(trim(abstract), '') <> ''", "venue": "coalesce(trim(venue), '') <> ''", "year": "coalesce(year, 0) <> 0", "pdf": "coalesce(trim(pdf_url), '') <> ''", "work_id": "coalesce(trim(openalex_id), '') <> ''", "authors": "coalesce({size}(authors), 0) > 0", "keywords": "coalesce({size}(keywords), 0) > 0", "references": "coalesce({size}(referenced_works), 0) > 0", "core": "coalesce(is_core, false)"}


@query(" UNION ALL ".join(f"SELECT '{n}' AS field, count(*) FILTER ({p.format(size='len')}) AS covered, count(*) AS total, round(100.0 * count(*) FILTER ({p.format(size='len')}) / count(*), 1)::DOUBLE AS pct FROM raw_papers" for n, p in _COVER.items()))
def dashboard(spark, sf):
    """Ten coverage counts with their percentages, in one pass."""
    size = lambda p: p.format(size="size").replace("coalesce(size(", "coalesce(nullif(size(").replace("), 0) > 0", "), -1), 0) > 0")
    counts = table(spark, sf, "raw_papers").agg(F.count(F.lit(1)).alias("total"), *[F.count_if(F.expr(size(p))).alias(n) for n, p in _COVER.items()])
    rows = F.array(*[F.struct(F.lit(n).alias("field"), F.col(n).alias("covered"), F.col("total"), F.round(F.lit(100.0) * F.col(n) / F.col("total"), 1).alias("pct")) for n in _COVER])
    return counts.select(F.explode(rows).alias("x")).select("x.*")


_FOUND = "f AS (SELECT * FROM raw_papers WHERE contains(lower(coalesce(title, '')), 'parsing'))"


def _found(spark, sf) -> DataFrame:  # noqa: ANN001
    return table(spark, sf, "raw_papers").where(F.contains(F.lower(F.coalesce("title", F.lit(""))), F.lit("parsing")))


@query(f"""WITH {_FOUND}, a AS (SELECT raw_id, unnest(authors).name AS name FROM f)
SELECT * FROM (SELECT 'venue' AS kind, venue AS name, count(*) AS n FROM f WHERE coalesce(trim(venue), '') <> '' GROUP BY venue ORDER BY n DESC, name LIMIT 10) UNION ALL SELECT * FROM (SELECT 'author', name, count(*) AS n FROM a WHERE coalesce(trim(name), '') <> '' GROUP BY name ORDER BY n DESC, name LIMIT 10)
UNION ALL SELECT 'first year', min(year)::VARCHAR, count(*) FROM f WHERE coalesce(year, 0) <> 0 UNION ALL SELECT 'last year', max(year)::VARCHAR, count(*) FROM f WHERE coalesce(year, 0) <> 0""")
def research_summary(spark, sf):
    """Of the papers found on a subject the ten foremost venues and authors, and the years they span."""
    found = _found(spark, sf)
    first = lambda frame, kind, c: frame.where(T.has_value(F.col(c))).groupBy(F.col(c).alias("name")).agg(F.count(F.lit(1)).alias("n")).orderBy(F.col("n").desc(), "name").limit(10).select(F.lit(kind).alias("kind"), "name", "n")
    authors = found.select(F.explode("authors").alias("a")).select(F.col("a.name").alias("author"))
    dated = found.where(F.coalesce("year", F.lit(0)) != 0).agg(F.min("year").cast("string").alias("lo"), F.max("year").cast("string").alias("hi"), F.count(F.lit(1)).alias("n"))
    years = dated.select(F.explode(F.array(F.struct(F.lit("first year").alias("kind"), F.col("lo").alias("name"), "n"), F.struct(F.lit("last year").alias("kind"), F.col("hi").alias("name"), "n"))).alias("x")).select("x.*")
    return first(found, "venue", "venue").unionByName(first(authors, "author", "author")).unionByName(years)


@query("""WITH k AS (SELECT coalesce(tier, -1) AS topic, lower(trim(unnest(keywords[1:5]))) AS kw FROM raw_papers), c AS (SELECT topic, kw, count(*) AS n FROM k WHERE kw <> '' GROUP BY ALL), r AS (SELECT *, row_number() OVER (PARTITION BY topic ORDER BY n DESC, kw) AS p FROM c),
s AS (SELECT coalesce(tier, -1) AS topic, count(*) AS papers FROM raw_papers GROUP BY 1) SELECT s.topic, papers, s.topic = -1 AS noise, coalesce(string_agg(kw, '|' ORDER BY p) FILTER (p <= 5), '') AS keywords FROM s LEFT JOIN r USING (topic) GROUP BY ALL""")
def topic_list(spark, sf):
    """Topics (tiers) with their size and the five most frequent of their papers' first five keywords; papers of none are noise."""
    from scholion.operators import trends

    papers = table(spark, sf, "raw_papers").select(F.coalesce("tier", F.lit(-1)).alias("topic"), F.slice("keywords", 1, 5).alias("keywords"))
    return trends.cluster_profiles(papers, "topic", "keywords", size=5).select("topic", F.col("members").alias("papers"), (F.col("topic") == -1).alias("noise"), "keywords")


@query("""WITH s AS (SELECT doc_id, pub_year, section, len(text) AS n FROM documents WHERE text IS NOT NULL)
SELECT coalesce(section, 'none') AS section, count(*) AS documents, sum(n)::BIGINT AS chars, ceil(sum(n) / 4.0)::BIGINT AS tokens, round(sum(n) * 0.125, 3)::DOUBLE AS cost FROM s GROUP BY 1""")
def cost_projection(spark, sf):
    """What encoding each section would take: characters, tokens at four characters each, and cost at an eighth a character."""
    n = F.length("text")
    sums = table(spark, sf, "documents").where("text is not null").groupBy(F.coalesce("section", F.lit("none")).alias("section")).agg(F.count(F.lit(1)).alias("documents"), F.sum(n).cast("bigint").alias("chars"))
    return sums.select("*", F.ceil(F.col("chars") / 4.0).alias("tokens"), F.round(F.col("chars") * 0.125, 3).alias("cost"))


@query(f"""WITH {_E}, o AS (SELECT src AS node, count(*) AS o FROM e GROUP BY src), i AS (SELECT dst AS node, count(*) AS i FROM e GROUP BY dst)
SELECT (SELECT count(*) FROM (SELECT node FROM o UNION SELECT node FROM i)) AS papers, (SELECT count(*) FROM e) AS edges, (SELECT round(avg(o), 6) FROM o)::DOUBLE AS mean_references, (SELECT max(o) FROM o) AS most_references, (SELECT round(avg(i), 6) FROM i)::DOUBLE AS mean_citations, (SELECT max(i) FROM i) AS most_citations""")
def graph_index_stats(spark, sf):
    """Papers with an edge, edges, and the mean and greatest numbers of references and citations over papers that have some."""
    d = G.degrees(edges(spark, sf))
    some = lambda c: F.when(F.col(c) > 0, F.col(c))
    return d.agg(F.count(F.lit(1)).alias("papers"), F.sum("out_degree").alias("edges"), F.round(F.avg(some("out_degree")), 6).alias("mean_references"), F.max("out_degree").alias("most_references"), F.round(F.avg(some("in_degree")), 6).alias("mean_citations"), F.max("in_degree").alias("most_citations"))
