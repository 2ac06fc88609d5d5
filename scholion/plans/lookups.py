"""Lookups by identifier: the stated queries are rows whose id is divisible by 20, looked up among all of the corpus (batch 0)."""

from __future__ import annotations

from pyspark.sql import DataFrame, functions as F

from scholion.functions import text as T
from scholion.operators import relational as R
from scholion.operators.orphans import record_key
from scholion.plans.orphans import _record
from scholion.plans.registry import Registry, blank_sql, doi_sql, title_sql
from scholion.runtime import table

REGISTRY = Registry()
query = REGISTRY.query
QUERIES, SQL = REGISTRY.queries, REGISTRY.sql

_CORPUS = f"c AS (SELECT raw_id, {doi_sql('doi')} AS d, {blank_sql('openalex_id')} AS w, lower({blank_sql('arxiv_id')}) AS x, lower({blank_sql('source_id')}) AS s, {title_sql('title')} AS t FROM raw_papers WHERE batch_no = 0)"
_ASKED = f"q AS (SELECT raw_id AS asked_id, {doi_sql('doi')} AS d, {blank_sql('openalex_id')} AS w, lower({blank_sql('arxiv_id')}) AS x, {title_sql('title')} AS t FROM raw_papers WHERE raw_id % 20 = 0)"


def _sides(spark, sf) -> tuple[DataFrame, DataFrame]:  # noqa: ANN001
    papers = table(spark, sf, "raw_papers")
    blank = lambda c: F.nullif(F.trim(c), F.lit(""))
    keys = {"d": T.plain_doi(F.col("doi")), "w": blank("openalex_id"), "x": F.lower(blank("arxiv_id")), "s": F.lower(blank("source_id")), "t": F.nullif(T.normalize_title(F.col("title")), F.lit(""))}
    corpus = papers.where("batch_no = 0").select("raw_id", *[k.alias(f"c{n}") for n, k in keys.items()])
    return papers.where("raw_id % 20 = 0").select(F.col("raw_id").alias("asked_id"), *[k.alias(n) for n, k in keys.items()]), corpus


def _first(spark, sf, key: str) -> DataFrame:  # noqa: ANN001
    """(asked_id, raw_id): the least record of the corpus with the asked key."""
    asked, corpus = _sides(spark, sf)
    firsts = corpus.where(F.col(f"c{key}").isNotNull()).groupBy(F.col(f"c{key}").alias(key)).agg(F.min("raw_id").alias("raw_id"))
    return asked.join(firsts, key).select("asked_id", "raw_id")


def _first_sql(key: str) -> str:
    return f"WITH {_CORPUS}, {_ASKED} SELECT asked_id, min(c.raw_id) AS raw_id FROM q JOIN c ON c.{key} = q.{key} AND q.{key} <> '' GROUP BY asked_id"


@query(f"""WITH q AS (SELECT DISTINCT {_record('r')} AS id FROM (SELECT unnest(payload.cited_by) AS r FROM seed_stubs))
SELECT p.id, max(p.title) AS title, max(p.year) AS year FROM paper_responses p JOIN q ON q.id = {_record('p.id')} GROUP BY p.id""")
def point_lookup(spark, sf):
    """The records that stubs name as citers, fetched by id."""
    asked = table(spark, sf, "seed_stubs").select(F.explode("payload.cited_by").alias("r")).select(record_key(F.col("r")).alias("k")).where("k is not null").distinct()
    papers = table(spark, sf, "paper_responses").select("id", "title", "year", record_key(F.col("id")).alias("k"))
    return papers.join(asked, "k", "left_semi").groupBy("id").agg(F.max("title").alias("title"), F.max("year").alias("year"))


@query(_first_sql("d"))
def lookup_by_doi(spark, sf):
    return _first(spark, sf, "d")


@query(_first_sql("w"))
def lookup_by_work_id(spark, sf):
    return _first(spark, sf, "w")


@query(_first_sql("t"))
def lookup_by_title(spark, sf):
    return _first(spark, sf, "t")


@query(f"""WITH {_CORPUS}, {_ASKED}, a AS (SELECT asked_id, regexp_replace(x, '^(arxiv:)+|v[0-9]+$', '', 'g') AS x FROM q WHERE x IS NOT NULL),
m AS (SELECT asked_id, 0 AS p, c.raw_id FROM a JOIN c ON c.x = a.x UNION ALL SELECT asked_id, 1, c.raw_id FROM a JOIN c ON c.x = 'arxiv:' || a.x UNION ALL SELECT asked_id, 2, c.raw_id FROM a JOIN c ON c.s = a.x OR c.s = 'arxiv:' || a.x)
SELECT asked_id, raw_id, p AS way FROM (SELECT *, row_number() OVER (PARTITION BY asked_id ORDER BY p, raw_id) AS n FROM m) WHERE n = 1""")
def lookup_by_preprint_id(spark, sf):
    """By the preprint id as it is, with its prefix, and as the source's own id; the first that finds one."""
    asked, corpus = _sides(spark, sf)
    bare = F.regexp_replace("x", r"^(arxiv:)+|v[0-9]+$", "")
    probes = asked.where("x is not null").select("asked_id", F.explode(F.array(F.struct(F.lit(0).alias("way"), bare.alias("k")), F.struct(F.lit(1).alias("way"), F.concat(F.lit("arxiv:"), bare).alias("k")), F.struct(F.lit(2).alias("way"), bare.alias("k")), F.struct(F.lit(2).alias("way"), F.concat(F.lit("arxiv:"), bare).alias("k")))).alias("x")).select("asked_id", "x.*")
    by_id = corpus.where("cx is not null").select("raw_id", F.explode(F.array(F.lit(0), F.lit(1))).alias("way"), F.col("cx").alias("k"))
    by_source = corpus.where("cs is not null").select("raw_id", F.lit(2).alias("way"), F.col("cs").alias("k"))
    known = by_id.unionByName(by_source).groupBy("way", "k").agg(F.min("raw_id").alias("raw_id"))
    best = probes.join(known, ["way", "k"]).groupBy("asked_id").agg(F.min(F.struct("way", "raw_id")).alias("b"))
    return best.select("asked_id", F.col("b.raw_id").alias("raw_id"), F.col("b.way").alias("way"))


@query(f"""WITH {_CORPUS}, {_ASKED}, w AS (SELECT asked_id, unnest([asked_id::VARCHAR, d, w, x]) AS ident FROM q),
m AS (SELECT asked_id, ident, 0 AS p, c.raw_id FROM w JOIN c ON c.raw_id::VARCHAR = ident UNION ALL SELECT asked_id, ident, 1, c.raw_id FROM w JOIN c ON c.d = {doi_sql('ident')}
 UNION ALL SELECT asked_id, ident, 2, c.raw_id FROM w JOIN c ON c.d = '10.48550/arxiv.' || regexp_replace(lower(ident), '^(arxiv:)+|v[0-9]+$', '', 'g') UNION ALL SELECT asked_id, ident, 3, c.raw_id FROM w JOIN c ON c.x = regexp_replace(lower(ident), '^(arxiv:)+|v[0-9]+$', '', 'g'))
SELECT asked_id, ident, raw_id, p AS way FROM (SELECT *, row_number() OVER (PARTITION BY asked_id, ident ORDER BY p, raw_id) AS n FROM m) WHERE n = 1""")
def universal_lookup(spark, sf):
    """Identifiers of any kind: as a key, a DOI, the DOI a preprint has, and a preprint id, in this order."""
    asked, corpus = _sides(spark, sf)
    listed = asked.select("asked_id", F.explode(F.array(F.col("asked_id").cast("string"), "d", "w", "x")).alias("ident")).where("ident is not null").distinct()
    bare = F.regexp_replace(F.lower("ident"), r"^(arxiv:)+|v[0-9]+$", "")
    ways = [F.col("ident"), T.plain_doi(F.col("ident")), F.concat(F.lit("10.48550/arxiv."), bare), bare]
    probes = listed.select("asked_id", "ident", F.explode(F.array(*[F.struct(F.lit(i).alias("way"), k.alias("k")) for i, k in enumerate(ways)])).alias("x")).select("asked_id", "ident", "x.*")
    keys = [F.col("raw_id").cast("string"), F.col("cd"), F.col("cd"), F.col("cx")]
    known = corpus.select("raw_id", F.explode(F.array(*[F.struct(F.lit(i).alias("way"), k.alias("k")) for i, k in enumerate(keys)])).alias("x")).select("raw_id", "x.*").where("k is not null").groupBy("way", "k").agg(F.min("raw_id").alias("raw_id"))
    best = probes.join(known, ["way", "k"]).groupBy("asked_id", "ident").agg(F.min(F.struct("way", "raw_id")).alias("b"))
    return best.select("asked_id", "ident", F.col("b.raw_id").alias("raw_id"), F.col("b.way").alias("way"))


@query(f"""SELECT point_id, payload.doi AS doi, payload.openalex_id AS openalex_id, payload.title AS title, {title_sql('payload.title')} AS title_norm FROM seed_papers WHERE NOT coalesce(payload.is_stub, false)""")
def minimal_records(spark, sf):
    """Records that are no stubs, with what matching needs of them."""
    real = table(spark, sf, "seed_papers").where(~F.coalesce("payload.is_stub", F.lit(False)))
    return real.select("point_id", "payload.doi", "payload.openalex_id", "payload.title", T.normalize_title(F.col("payload.title")).alias("title_norm"))


@query(f"""SELECT point_id, payload.identifier AS identifier, payload.identifier_type AS identifier_type, {doi_sql('payload.doi')} AS doi, payload.alternate_identifiers['openalex'] AS openalex_id, payload.alternate_identifiers['arxiv'] AS arxiv_id,
 payload.title AS title, {title_sql('payload.title')} AS title_norm, payload.year AS year, payload.venue AS venue, lower(list_last(regexp_split_to_array({blank_sql('payload.authors[1].display_name')}, '\\s+'))) AS surname,
 coalesce(trim(payload.abstract), '') <> '' AS has_abstract, len(coalesce(payload.cited_by, []))::INT AS citers FROM seed_stubs WHERE payload.is_stub""")
def stubs_for_matching(spark, sf):
    """Stubs with all that decides which work they are: identifiers, alternates, title, year, first surname."""
    stubs = table(spark, sf, "seed_stubs").where("payload.is_stub")
    first = F.nullif(F.trim(F.try_element_at("payload.authors", F.lit(1))["display_name"]), F.lit(""))
    other = lambda k: F.try_element_at("payload.alternate_identifiers", F.lit(k)).alias(f"{k}_id")
    return stubs.select(
        "point_id", "payload.identifier", "payload.identifier_type", T.plain_doi(F.col("payload.doi")).alias("doi"), other("openalex"), other("arxiv"), "payload.title", T.normalize_title(F.col("payload.title")).alias("title_norm"),
        "payload.year", "payload.venue", T.surname(first).alias("surname"), T.has_value(F.col("payload.abstract")).alias("has_abstract"), F.coalesce(F.size("payload.cited_by"), F.lit(0)).alias("citers"),
    )


_ARCHIVE = f"SELECT raw_id, lower({blank_sql('arxiv_id')}) AS x, {title_sql('title')} AS t, pdf_url AS url, coalesce(is_core, false) AS official, coalesce(citation_count, 0) AS stars FROM raw_papers WHERE batch_no = 0 AND coalesce(trim(pdf_url), '') <> ''"


@query(f"""WITH a AS ({_ARCHIVE}), q AS (SELECT raw_id, lower({blank_sql('arxiv_id')}) AS x, {title_sql('title')} AS t FROM raw_papers WHERE batch_no > 0),
m AS (SELECT q.raw_id, 0 AS p, a.url, a.official, a.stars FROM q JOIN a ON a.x = q.x UNION ALL SELECT q.raw_id, 1, a.url, a.official, a.stars FROM q JOIN a ON a.t = q.t AND length(q.t) > 10)
SELECT raw_id, url, official, stars, p AS way FROM (SELECT *, row_number() OVER (PARTITION BY raw_id ORDER BY p, official DESC, stars DESC, url) AS n FROM m) WHERE n = 1""")
def archive_match(spark, sf):
    """The best entry of a side archive for each later work: by preprint id, else by a title of over 10 letters; official ones first, then by stars."""
    papers = table(spark, sf, "raw_papers").select("raw_id", "batch_no", F.nullif(F.lower(F.trim("arxiv_id")), F.lit("")).alias("x"), T.normalize_title(F.col("title")).alias("t"), "pdf_url", F.coalesce("is_core", F.lit(False)).alias("official"), F.coalesce("citation_count", F.lit(0)).alias("stars"))
    keys = F.array(F.struct(F.lit(0).alias("way"), F.col("x").alias("k")), F.struct(F.lit(1).alias("way"), F.when(F.length("t") > 10, F.col("t")).alias("k")))
    keyed = papers.select("*", F.explode(keys).alias("y")).where("y.k is not null")
    # Entries of one key are aggregated to the best before the join.
    rank = F.struct((-F.col("official").cast("int")).alias("o"), (-F.col("stars")).alias("s"), F.col("pdf_url").alias("u"))
    archive = keyed.where(T.has_value(F.col("pdf_url")) & (F.col("batch_no") == 0)).groupBy("y").agg(F.min(rank).alias("b"))
    best = keyed.where("batch_no > 0").select("raw_id", "y").join(archive, "y").groupBy("raw_id").agg(F.min(F.struct("y.way", "b")).alias("m"))
    return best.select("raw_id", F.col("m.b.u").alias("url"), (F.col("m.b.o") < 0).alias("official"), (-F.col("m.b.s")).alias("stars"), F.col("m.way").alias("way"))


@query("""SELECT d.doc_id FROM documents d WHERE coalesce(d.source, '') <> '' AND d.pub_year >= 2015 AND coalesce(trim(d.text), '') <> '' AND NOT EXISTS (SELECT 1 FROM embeddings e WHERE e.vec_id = d.doc_id AND e.label IN (1, 2, 3))""")
def reembed_selector(spark, sf):
    """Documents from a year on that have no vector of the wanted kinds."""
    done = table(spark, sf, "embeddings").where("label in (1, 2, 3)").select(F.col("vec_id").alias("doc_id"))
    return table(spark, sf, "documents").where((F.coalesce("source", F.lit("")) != "") & (F.col("pub_year") >= 2015) & T.has_value(F.col("text"))).select("doc_id").join(done, "doc_id", "left_anti")


@query(f"""WITH n AS (SELECT id, pos, {_record('r')} AS ref FROM (SELECT id, unnest(resolved_references) AS r, generate_subscripts(resolved_references, 1)::INT AS pos FROM (SELECT id, arg_min_null(resolved_references, fetched_at) AS resolved_references FROM paper_responses GROUP BY id)))
SELECT n.id, n.pos, n.ref, coalesce(max(p.title), 'not found') AS title FROM n LEFT JOIN paper_responses p ON p.id = n.ref WHERE n.ref IS NOT NULL AND n.pos <= 10 GROUP BY 1, 2, 3""")
def first_references(spark, sf):
    """The first ten references of every record in their order, with titles; those that are no records stay."""
    papers = table(spark, sf, "paper_responses")
    lists = papers.groupBy("id").agg(F.min_by("resolved_references", "fetched_at").alias("refs"))
    refs = lists.select("id", F.posexplode("refs").alias("p", "r")).select("id", (F.col("p") + 1).alias("pos"), record_key(F.col("r")).alias("ref")).where("ref is not null and pos <= 10")
    titles = papers.groupBy(F.col("id").alias("ref")).agg(F.max("title").alias("title"))
    return refs.join(titles, "ref", "left").select("id", "pos", "ref", F.coalesce("title", F.lit("not found")).alias("title"))


@query(f"""WITH {_CORPUS}, s AS (SELECT point_id, {doi_sql('payload.doi')} AS d, {blank_sql("payload.alternate_identifiers['openalex']")} AS w,
 {title_sql('payload.title')} AS t FROM seed_stubs WHERE payload.is_stub), m AS (SELECT point_id, 0 AS p, c.raw_id FROM s JOIN c ON c.d = s.d UNION ALL SELECT point_id, 1, c.raw_id FROM s JOIN c ON c.w = s.w UNION ALL SELECT point_id, 2, c.raw_id FROM s JOIN c ON c.t = s.t AND s.t <> '')
SELECT point_id, raw_id, (['doi', 'work', 'title'])[p + 1] AS matched_by FROM (SELECT *, row_number() OVER (PARTITION BY point_id ORDER BY p, raw_id) AS n FROM m) WHERE n = 1""")
def stub_reconciliation(spark, sf):
    """Stubs that the corpus (batch 0) holds as records, by DOI, work id among the alternates, or title."""
    _, corpus = _sides(spark, sf)
    stubs = table(spark, sf, "seed_stubs").where("payload.is_stub").select("point_id", "payload.*")
    keys = [
        ("doi", T.plain_doi(F.col("doi")), F.col("cd")),
        ("work", F.nullif(F.trim(F.try_element_at("alternate_identifiers", F.lit("openalex"))), F.lit("")), F.col("cw")),
        ("title", T.normalize_title(F.col("title")), F.col("ct")),
    ]
    return R.prioritized_match(stubs, corpus, keys, "point_id", "raw_id")


@query("""WITH k AS (SELECT point_id, lower(identifier) AS k, 0 AS p FROM (SELECT point_id, payload.identifier AS identifier FROM seed_stubs) UNION ALL SELECT point_id, lower(e.key || ':' || e.value), 1 FROM (SELECT point_id, unnest(map_entries(payload.alternate_identifiers)) AS e FROM seed_stubs) UNION ALL SELECT point_id, 'doi:' || lower(trim(payload.doi)), 2 FROM seed_stubs WHERE trim(payload.doi) <> '')
SELECT k, arg_min(point_id, (p, point_id)) AS point_id, min(p) AS way, count(DISTINCT point_id) AS holders FROM k WHERE k IS NOT NULL GROUP BY k""")
def stub_identifier_index(spark, sf):
    """Every identifier of a stub, its own first, then its alternates, then its DOI, lower case and with a prefix, and the stub it leads to."""
    stubs = table(spark, sf, "seed_stubs").select("point_id", "payload.*")
    own = stubs.select("point_id", F.lower("identifier").alias("k"), F.lit(0).alias("p"))
    other = stubs.select("point_id", F.explode("alternate_identifiers").alias("n", "v")).select("point_id", F.lower(F.concat("n", F.lit(":"), "v")).alias("k"), F.lit(1).alias("p"))
    doi = stubs.where("trim(doi) <> ''").select("point_id", F.concat(F.lit("doi:"), F.lower(F.trim("doi"))).alias("k"), F.lit(2).alias("p"))
    keyed = own.unionByName(other).unionByName(doi).where("k is not null")
    return keyed.groupBy("k").agg(F.min_by("point_id", F.struct("p", "point_id")).alias("point_id"), F.min("p").alias("way"), F.countDistinct("point_id").alias("holders"))


@query(f"""WITH x AS (SELECT raw_id, {doi_sql('doi')} AS d FROM raw_papers WHERE batch_no > 0), st AS (SELECT point_id, {doi_sql('payload.doi')} AS d, payload.cited_by[1:3] AS firsts FROM seed_stubs),
h AS (SELECT x.raw_id, st.point_id, {_record('r')} AS citer FROM x JOIN st ON st.d = x.d, unnest(st.firsts) AS t(r))
SELECT raw_id, point_id, string_agg(DISTINCT p.id, '|' ORDER BY p.id) AS citers FROM h JOIN paper_responses p ON p.id = h.citer GROUP BY raw_id, point_id""")
def connected_externals(spark, sf):
    """Works outside the corpus that a stub with their DOI connects to it: those of the stub's first three citers that are records."""
    works = table(spark, sf, "raw_papers").where("batch_no > 0").select("raw_id", T.plain_doi(F.col("doi")).alias("d"))
    stubs = table(spark, sf, "seed_stubs").select("point_id", T.plain_doi(F.col("payload.doi")).alias("d"), F.explode(F.slice("payload.cited_by", 1, 3)).alias("r"))
    citers = stubs.select("point_id", "d", record_key(F.col("r")).alias("id")).join(table(spark, sf, "paper_responses").select("id").distinct(), "id", "left_semi")
    return works.join(citers, "d").groupBy("raw_id", "point_id").agg(F.array_join(F.array_sort(F.collect_set("id")), "|").alias("citers"))
