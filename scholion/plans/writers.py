"""Keyed writes as copy-on-write: the new state of the corpus (batch 0 of raw_papers) after updates from the later batches."""

from __future__ import annotations

from pyspark.sql import DataFrame, functions as F

from scholion.functions import text as T
from scholion.operators import graph as G, relational as R
from scholion.operators.orphans import work_key
from scholion.plans.graphs import _E, edges
from scholion.plans.orphans import _work
from scholion.plans.registry import Registry, doi_sql
from scholion.runtime import materialize, table

REGISTRY = Registry()
query = REGISTRY.query
QUERIES, SQL = REGISTRY.queries, REGISTRY.sql

_U = "u AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY openalex_id ORDER BY raw_id DESC) AS n FROM raw_papers WHERE batch_no > 0 AND openalex_id IS NOT NULL) WHERE n = 1)"


def _state(spark, sf, *columns: str) -> tuple[DataFrame, DataFrame]:  # noqa: ANN001
    """The corpus and the later works, both with work id and the given columns; of the latter also raw_id, by which the last wins."""
    papers = table(spark, sf, "raw_papers").select("raw_id", "batch_no", "openalex_id", *columns)
    return papers.where("batch_no = 0").drop("batch_no"), papers.where("batch_no > 0").drop("batch_no")


def _overwritten(spark, sf, *columns: str) -> DataFrame:  # noqa: ANN001
    corpus, later = _state(spark, sf, *columns)
    return R.set_fields(corpus, later, "openalex_id", {c: c for c in columns}, "raw_id")


def _sql(*columns: str) -> str:
    out = ", ".join((f"array_to_string(CASE WHEN u.raw_id IS NOT NULL THEN u.{c} ELSE p.{c} END, '|') AS {c}" if c in ("referenced_works", "keywords", "categories") else f"CASE WHEN u.raw_id IS NOT NULL THEN u.{c} ELSE p.{c} END AS {c}") for c in columns)
    return f"WITH {_U} SELECT p.raw_id, {out} FROM raw_papers p LEFT JOIN u ON u.openalex_id = p.openalex_id WHERE p.batch_no = 0"


def _shown(frame: DataFrame, *columns: str) -> DataFrame:
    kinds = dict(frame.dtypes)
    return frame.select("raw_id", *[F.array_join(c, "|").alias(c) if kinds[c].startswith("array") else F.col(c) for c in columns])


@query("""SELECT source || '|' || source_id AS k, sha256(source || '|' || source_id) AS id, min(raw_id) AS raw_id FROM raw_papers WHERE source IS NOT NULL AND source_id IS NOT NULL GROUP BY 1, 2""")
def insert_papers(spark, sf):
    """Papers under a deterministic id of source and source id, so that a repeated insert adds nothing."""
    k = F.concat("source", F.lit("|"), "source_id")
    return table(spark, sf, "raw_papers").where("source is not null and source_id is not null").groupBy(k.alias("k")).agg(F.min("raw_id").alias("raw_id")).select("k", F.sha2("k", 256).alias("id"), "raw_id")


@query("""SELECT raw_id, source_id, title, coalesce(abstract, '') AS abstract, array_to_string(list_filter(list_transform(authors, lambda a: a.name), lambda a: a IS NOT NULL), '|') AS authors, year, doi, openalex_id, venue, citation_count FROM raw_papers""")
def paper_payload(spark, sf):
    """What is stored of a crawled paper: authors by name, no abstract as empty text, crawl fields left out."""
    papers = table(spark, sf, "raw_papers")
    names = F.filter(F.transform("authors", lambda a: a["name"]), lambda n: n.isNotNull())
    return papers.select("raw_id", "source_id", "title", F.coalesce("abstract", F.lit("")).alias("abstract"), F.array_join(names, "|").alias("authors"), "year", "doi", "openalex_id", "venue", "citation_count")


@query(_sql("referenced_works"))
def update_references(spark, sf):
    return _shown(_overwritten(spark, sf, "referenced_works"), "referenced_works")


@query(_sql("abstract"))
def update_abstract(spark, sf):
    return _shown(_overwritten(spark, sf, "abstract"), "abstract")


@query(_sql("doi", "referenced_works"))
def update_doi_and_references(spark, sf):
    return _shown(_overwritten(spark, sf, "doi", "referenced_works"), "doi", "referenced_works")


@query(_sql("keywords", "source"))
def update_keywords_with_source(spark, sf):
    return _shown(_overwritten(spark, sf, "keywords", "source"), "keywords", "source")


@query(_sql("pdf_url", "is_core"))
def update_open_pdf(spark, sf):
    return _shown(_overwritten(spark, sf, "pdf_url", "is_core"), "pdf_url", "is_core")


@query("""SELECT raw_id, '' AS keywords FROM raw_papers WHERE batch_no = 0""")
def clear_keywords(spark, sf):
    corpus, _ = _state(spark, sf, "keywords")
    return _shown(corpus.withColumn("keywords", F.array().cast("array<string>")), "keywords")


@query(f"""SELECT point_id, string_agg({_work('ref')}, '|' ORDER BY pos) AS refs FROM (SELECT point_id, unnest(payload.referenced_works) AS ref, generate_subscripts(payload.referenced_works, 1) AS pos FROM seed_papers) WHERE {_work('ref')} IS NOT NULL GROUP BY point_id""")
def update_normalized_references(spark, sf):
    """Reference lists rewritten in place to the usual writing, order kept, what is no reference dropped."""
    lists = table(spark, sf, "seed_papers").select("point_id", F.filter(F.transform("payload.referenced_works", work_key), lambda k: k.isNotNull()).alias("refs"))
    return lists.where("size(refs) > 0").select("point_id", F.array_join("refs", "|").alias("refs"))


_KEYS = f"k AS (SELECT k, min(point_id) AS target FROM (SELECT {_work('payload.openalex_id')} AS k, point_id FROM seed_papers UNION ALL SELECT {_work('openalex_id')}, id FROM paper_responses) WHERE k IS NOT NULL GROUP BY k)"


@query(f"""WITH {_KEYS} SELECT s.point_id, string_agg(target, '|' ORDER BY pos) AS resolved, count(target) AS n FROM seed_papers s LEFT JOIN (SELECT point_id, unnest(payload.referenced_works) AS ref, generate_subscripts(payload.referenced_works, 1) AS pos FROM seed_papers) r ON r.point_id = s.point_id LEFT JOIN k ON k.k = {_work('ref')} GROUP BY s.point_id""")
def update_resolved_references(spark, sf):
    """Every record with the ids its references resolve to, in their order, written back as a list."""
    from scholion.plans.entities import resolve_references

    seeds = table(spark, sf, "seed_papers").select("point_id").distinct()
    found = resolve_references(spark, sf).where("target is not null").groupBy("point_id").agg(F.array_sort(F.collect_list(F.struct("pos", "target"))).alias("x"))
    listed = found.select("point_id", F.transform("x", lambda v: v["target"]).alias("x"))
    return seeds.join(listed, "point_id", "left").select("point_id", F.array_join("x", "|").alias("resolved"), F.coalesce(F.greatest(F.size("x"), F.lit(0)), F.lit(0)).cast("bigint").alias("n"))


@query(f"""WITH {_E}, d AS (SELECT id, (SELECT count(*) FROM e WHERE dst = id) AS i, (SELECT count(*) FROM e WHERE src = id) AS o FROM (SELECT DISTINCT id FROM paper_responses)) SELECT p.id, p.fetched_at, i AS in_degree, o AS out_degree FROM paper_responses p JOIN d USING (id)""")
def update_graph_metrics(spark, sf):
    """Metrics of nodes stored with the records; nodes that are no records drop out, records outside the graph have 0."""
    papers = table(spark, sf, "paper_responses").select("id", "fetched_at")
    merged = R.set_fields(papers, G.degrees(edges(spark, sf)).withColumnRenamed("node", "id"), "id", {"in_degree": "in_degree", "out_degree": "out_degree"})
    return merged.select("id", "fetched_at", *[F.coalesce(c, F.lit(0)).alias(c) for c in ("in_degree", "out_degree")])


@query("""SELECT doc_id, len(s)::INT AS sentences, list_count(list_filter(s, lambda x: ends_with(x, '?')))::INT AS questions FROM (SELECT doc_id, list_filter(regexp_split_to_array(regexp_replace(trim(regexp_replace(text, '\\s+', ' ', 'g')), '([.!?]) ', '\\1' || chr(1), 'g'), chr(1)), lambda x: x <> '') AS s FROM documents WHERE coalesce(trim(text), '') <> '')""")
def update_abstract_structure(spark, sf):
    """The structure of every text stored with it: how many sentences, how many of them questions."""
    s = T.sentences(F.col("text"))
    return table(spark, sf, "documents").where(T.has_value(F.col("text"))).select("doc_id", F.size(s).alias("sentences"), F.size(F.filter(s, lambda x: x.endswith("?"))).alias("questions"))


@query("""WITH q AS (SELECT vec_id AS qid, embedding AS e FROM embeddings WHERE vec_id % 20 = 0), s AS (SELECT q.qid, v.vec_id, round(list_cosine_similarity(v.embedding::DOUBLE[], q.e::DOUBLE[]), 4) AS score FROM embeddings v, q WHERE q.qid <> v.vec_id),
v AS (SELECT *, row_number() OVER (PARTITION BY qid ORDER BY score DESC, vec_id) AS p FROM s) SELECT e.vec_id, e.label, string_agg(v.vec_id, '|' ORDER BY p) AS similar FROM embeddings e LEFT JOIN v ON v.qid = e.vec_id AND p <= 5 GROUP BY 1, 2""")
def update_similar(spark, sf):
    """Vectors with the list of their nearest (of the stated queries) stored, best first."""
    from scholion.plans.retrieval import _nearest

    near = _nearest(spark, sf, 5).groupBy("qid").agg(F.array_sort(F.collect_list(F.struct("rank", "vec_id"))).alias("x")).select(F.col("qid").alias("vec_id"), F.transform("x", lambda v: v["vec_id"]).alias("near"))
    merged = R.set_fields(table(spark, sf, "embeddings").select("vec_id", "label"), near, "vec_id", {"similar": "near"})
    return merged.select("vec_id", "label", F.array_join("similar", "|").alias("similar"))


_STUBS = f"s AS (SELECT point_id, {doi_sql('payload.doi')} AS d, payload.* FROM seed_stubs), r AS (SELECT * FROM (SELECT {doi_sql('doi')} AS d, title, abstract, year, raw_id, row_number() OVER (PARTITION BY {doi_sql('doi')} ORDER BY raw_id) AS n FROM raw_papers WHERE {doi_sql('doi')} IS NOT NULL) WHERE n = 1)"


@query(f"""WITH {_STUBS} SELECT s.point_id, CASE WHEN trim(s.title) <> '' THEN s.title WHEN trim(r.title) <> '' THEN r.title END AS title, CASE WHEN trim(s.abstract) <> '' THEN s.abstract WHEN trim(r.abstract) <> '' THEN r.abstract END AS abstract, coalesce(s.year, r.year) AS year, r.raw_id IS NULL AS is_stub, len(s.cited_by)::INT AS citers FROM s LEFT JOIN r ON r.d = s.d WHERE s.is_stub""")
def promote_stubs(spark, sf):
    """Stubs whose DOI names a paper become records: what they lack is filled, the flag cleared, their citers kept."""
    stubs = table(spark, sf, "seed_stubs").where("payload.is_stub").select("point_id", T.plain_doi(F.col("payload.doi")).alias("d"), "payload.title", "payload.abstract", "payload.year", "payload.is_stub", F.size("payload.cited_by").alias("citers"))
    papers = R.first_wins(table(spark, sf, "raw_papers").select(T.plain_doi(F.col("doi")).alias("d"), "title", "abstract", "year", "raw_id").where("d is not null"), ["d"], [F.col("raw_id")])
    found = R.fill_missing(stubs, papers.drop("raw_id"), "d", {"title": "string", "abstract": "string", "year": "other"}).drop("filled")
    merged = R.set_fields(found, papers.withColumn("no", F.lit(False)), "d", {"is_stub": "no"})
    return merged.select("point_id", F.when(T.has_value(F.col("title")), F.col("title")).alias("title"), F.when(T.has_value(F.col("abstract")), F.col("abstract")).alias("abstract"), "year", "is_stub", "citers")


@query("""WITH w AS (SELECT openalex_id, min(raw_id) AS raw_id FROM raw_papers WHERE batch_no > 0 AND openalex_id IS NOT NULL GROUP BY openalex_id) SELECT raw_id, openalex_id, false AS injected FROM raw_papers WHERE batch_no = 0 UNION ALL SELECT raw_id, openalex_id, true FROM w WHERE openalex_id NOT IN (SELECT openalex_id FROM raw_papers WHERE batch_no = 0 AND openalex_id IS NOT NULL)""")
def inject_papers(spark, sf):
    """The corpus with the works that it does not have, once each."""
    corpus, later = _state(spark, sf)
    return R.insert_new(corpus.withColumn("injected", F.lit(False)), later.withColumn("injected", F.lit(True)), "openalex_id", "raw_id").select("raw_id", "openalex_id", "injected")


@query("""SELECT raw_id FROM raw_papers WHERE raw_id::VARCHAR NOT IN (SELECT member_key FROM dup_members WHERE member_table = 'raw_papers' AND member_key IS NOT NULL)""")
def delete_points(spark, sf):
    """Papers without those listed as members of duplicate groups."""
    gone = table(spark, sf, "dup_members").where("member_table = 'raw_papers'").select(F.col("member_key").try_cast("bigint").alias("raw_id"))
    return R.delete_keys(table(spark, sf, "raw_papers").select("raw_id"), gone, "raw_id")


@query("""SELECT p.raw_id, CASE WHEN m.k IS NULL THEN p.doi END AS doi, CASE WHEN m.k IS NULL THEN p.abstract END AS abstract, CASE WHEN m.k IS NULL THEN len(p.referenced_works) ELSE 0 END::INT AS refs FROM raw_papers p LEFT JOIN (SELECT DISTINCT member_key AS k FROM dup_members WHERE member_table = 'raw_papers') m ON m.k = p.raw_id::VARCHAR""")
def reset_enriched(spark, sf):
    """Listed papers lose what was taken for them by title: DOI, abstract and references."""
    listed = table(spark, sf, "dup_members").where("member_table = 'raw_papers'").select(F.col("member_key").try_cast("bigint").alias("raw_id")).distinct()
    wiped = listed.select("raw_id", F.lit(None).cast("string").alias("t"), F.array().cast("array<string>").alias("l"))
    reset = R.set_fields(table(spark, sf, "raw_papers").select("raw_id", "doi", "abstract", "referenced_works"), wiped, "raw_id", {"doi": "t", "abstract": "t", "referenced_works": "l"})
    return reset.select("raw_id", "doi", "abstract", F.when(F.col("referenced_works").isNotNull(), F.size("referenced_works")).alias("refs"))


# Fixed value: what the DOIs of one publisher begin with, under which a PDF's address can be made of the DOI.
PUBLISHER = "10.90048/"


@query(f"""SELECT raw_id, CASE WHEN coalesce(trim(pdf_url), '') = '' AND contains({doi_sql('doi')}, '{PUBLISHER}') THEN 'https://files.example.org/' || {doi_sql('doi')} ELSE pdf_url END AS pdf_url FROM raw_papers""")
def backfill_pdf_url(spark, sf):
    """The address of the PDF, made of the DOI where there is none and the publisher's scheme is known."""
    doi = T.plain_doi(F.col("doi"))
    lacks = ~T.has_value(F.col("pdf_url")) & F.coalesce(F.contains(doi, F.lit(PUBLISHER)), F.lit(False))
    return table(spark, sf, "raw_papers").select("raw_id", F.when(lacks, F.concat(F.lit("https://files.example.org/"), doi)).otherwise(F.col("pdf_url")).alias("pdf_url"))


@query("""SELECT count(*) AS copied, count(*) AS kept, true AS complete FROM embeddings""")
def migrate_vectors(spark, sf):
    """The vectors copied to a new table with another layout, and whether the copy holds as many."""
    old = table(spark, sf, "embeddings")
    new = materialize(old.select("vec_id", "label", F.transform("embedding", lambda x: x.cast("float")).alias("embedding")), "vectors")
    counts = new.agg(F.count(F.lit(1)).alias("copied")).join(F.broadcast(old.agg(F.count(F.lit(1)).alias("kept"))))
    return counts.withColumn("complete", F.col("copied") == F.col("kept"))


@query("""SELECT vec_id, 'old' AS kind FROM embeddings WHERE label <> 3 UNION ALL SELECT vec_id, 'new' FROM embeddings WHERE label = 3 AND embedding IS NOT NULL""")
def update_vectors(spark, sf):
    """Vectors of one kind replaced by new ones: those of the same key go, the new ones are appended, failed ones left out."""
    vectors = table(spark, sf, "embeddings").select("vec_id", "label", "embedding")
    made = vectors.where("label = 3 and embedding is not null")
    kept = R.delete_keys(vectors, vectors.where("label = 3"), "vec_id")
    return kept.select("vec_id", F.lit("old").alias("kind")).unionByName(made.select("vec_id", F.lit("new").alias("kind")))


@query(f"""WITH s AS (SELECT point_id, {doi_sql('payload.doi')} AS d, payload.title AS title, payload.year AS year, payload.cited_by AS cited_by FROM seed_stubs WHERE {doi_sql('payload.doi')} IS NOT NULL)
SELECT d, min(point_id) AS point_id, count(*) AS members, arg_min(title, point_id) FILTER (title IS NOT NULL) AS title, arg_min(year, point_id) FILTER (year IS NOT NULL) AS year, coalesce((SELECT string_agg(c, '|' ORDER BY c) FROM (SELECT DISTINCT unnest(t.cited_by) AS c FROM s t WHERE t.d = s.d) WHERE c IS NOT NULL), '') AS cited_by FROM s GROUP BY d""")
def merge_stubs(spark, sf):
    """Stubs of one DOI merged under the least id: the set of all citers, the first title and year there is, the alternates of the kept one first."""
    stubs = table(spark, sf, "seed_stubs").select("point_id", T.plain_doi(F.col("payload.doi")).alias("d"), "payload.title", "payload.year", "payload.cited_by", "payload.alternate_identifiers").where("d is not null")
    merged = R.merge_groups(stubs, "d", "point_id", ["cited_by"], ["title", "year"], ["alternate_identifiers"])
    return merged.select("d", "point_id", "members", "title", "year", F.array_join("cited_by", "|").alias("cited_by"))


@query(f"""WITH e AS (SELECT {_work('ref')} AS k, point_id AS c FROM (SELECT point_id, unnest(payload.referenced_works) AS ref FROM seed_papers) WHERE {_work('ref')} IS NOT NULL UNION ALL SELECT replace(payload.identifier, 'openalex:', ''), unnest(payload.cited_by) FROM seed_stubs WHERE payload.identifier_type = 'openalex')
SELECT k AS identifier, string_agg(DISTINCT c, '|' ORDER BY c) AS cited_by, count(DISTINCT c) AS citers, k IN (SELECT replace(payload.identifier, 'openalex:', '') FROM seed_stubs WHERE payload.identifier_type = 'openalex') AS existed FROM e WHERE c IS NOT NULL GROUP BY k""")
def upsert_stubs(spark, sf):
    """A stub for every referenced work: new ones with their citers, existing ones with the citers they had and the new."""
    seeds, stubs = table(spark, sf, "seed_papers"), table(spark, sf, "seed_stubs").where("payload.identifier_type = 'openalex'")
    new = seeds.select("point_id", F.explode("payload.referenced_works").alias("r")).select(work_key(F.col("r")).alias("identifier"), F.col("point_id").alias("c"), F.lit(False).alias("old"))
    old = stubs.select(F.replace("payload.identifier", F.lit("openalex:"), F.lit("")).alias("identifier"), F.explode("payload.cited_by").alias("c"), F.lit(True).alias("old"))
    known = stubs.select(F.replace("payload.identifier", F.lit("openalex:"), F.lit("")).alias("identifier")).distinct().withColumn("existed", F.lit(True))
    pairs = new.unionByName(old).where("identifier is not null and c is not null").select("identifier", "c").distinct()
    listed = pairs.groupBy("identifier").agg(F.array_join(F.array_sort(F.collect_list("c")), "|").alias("cited_by"), F.count(F.lit(1)).alias("citers"))
    return listed.join(known, "identifier", "left").select("identifier", "cited_by", "citers", F.coalesce("existed", F.lit(False)).alias("existed"))
