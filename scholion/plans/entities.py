"""Identifier functions, joins between records of several sources, and merges."""

from __future__ import annotations

from pyspark.sql import functions as F

from scholion.functions import text as T
from scholion.operators import relational as R
from scholion.operators.orphans import record_key, work_key
from scholion.plans.orphans import _record, _work
from scholion.runtime import materialize, table

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


_TITLE = "trim(regexp_replace(regexp_replace(translate(lower(coalesce({0}, '')), '" + T.ACCENTED + "', '" + T.BASES + "'), '[^\\p{{L}}\\p{{N}}_\\s]', '', 'g'), '\\s+', ' ', 'g'))"
_DOI = "nullif(regexp_replace(lower(trim({0})), '^(https?://[a-z.]*/)?(doi:\\s*)?', ''), '')"


@query(f"SELECT point_id, {_TITLE.format('payload.title')} AS title_norm FROM seed_papers")
def title_normalize(spark, sf):
    return table(spark, sf, "seed_papers").select("point_id", T.normalize_title(F.col("payload.title")).alias("title_norm"))


@query()
def title_normalize_unicode(spark, sf):
    return table(spark, sf, "raw_papers").select("raw_id", T.normalize_title_nfkd("title").alias("title_norm"))


@query(f"SELECT point_id, {_TITLE.format('payload.title')} || '|' || CASE WHEN coalesce(payload.publication_year, 0) = 0 THEN 'unknown' ELSE payload.publication_year::VARCHAR END AS k FROM seed_papers")
def title_year_key(spark, sf):
    return table(spark, sf, "seed_papers").select("point_id", T.title_year_key(F.col("payload.title"), F.col("payload.publication_year")).alias("k"))


_KIND = """CASE WHEN regexp_matches(trim(ref), '(?i)^title:') THEN 'title' WHEN regexp_matches(trim(ref), '(?i)^(https?://[a-z.]*/)?(doi:\\s*)?10\\.[0-9]{4,9}/\\S+$') THEN 'doi'
 WHEN regexp_matches(trim(ref), '(?i)^(arxiv:)*[0-9]{4}\\.[0-9]{4,5}(v[0-9]+)?$') THEN 'arxiv' WHEN regexp_matches(trim(ref), '(?i)^(openalex:|https?://\\S+/)?w[0-9]+$') THEN 'openalex' ELSE 'unknown' END"""
_REFS = "(SELECT raw_id::VARCHAR AS id, unnest([doi, arxiv_id, openalex_id]) AS ref FROM raw_papers UNION ALL SELECT point_id, payload.identifier FROM seed_stubs)"


def _identifiers(spark, sf):
    papers = table(spark, sf, "raw_papers").select(F.col("raw_id").cast("string").alias("id"), F.explode(F.array("doi", "arxiv_id", "openalex_id")).alias("ref"))
    return papers.unionByName(table(spark, sf, "seed_stubs").select(F.col("point_id").alias("id"), F.col("payload.identifier").alias("ref")))


@query(f"""SELECT id, ref, {_KIND} AS kind, CASE {_KIND} WHEN 'doi' THEN 'doi:' || {_DOI.format('ref')} WHEN 'arxiv' THEN 'arxiv:' || regexp_replace(lower(trim(ref)), '^(arxiv:)+|v[0-9]+$', '', 'g')
 WHEN 'openalex' THEN 'openalex:' || upper(regexp_extract(trim(ref), '(?i)(w[0-9]+)$', 1)) WHEN 'title' THEN 'title:' || regexp_replace(lower(trim(ref)), '^title:\\s*', '') END AS normal FROM {_REFS} WHERE ref IS NOT NULL""")
def identifier_normalize(spark, sf):
    return _identifiers(spark, sf).where("ref is not null").select("id", "ref", T.classify_identifier(F.col("ref")).alias("kind"), T.normalize_identifier(F.col("ref")).alias("normal"))


@query(f"""SELECT k.kind, count(r.kind) AS n FROM (SELECT unnest(['title', 'doi', 'arxiv', 'openalex', 'unknown']) AS kind) k LEFT JOIN (SELECT {_KIND} AS kind FROM {_REFS} WHERE ref IS NOT NULL) r ON k.kind = r.kind GROUP BY k.kind""")
def identifier_type_counts(spark, sf):
    kinds = spark.createDataFrame([(k,) for k in ("title", "doi", "arxiv", "openalex", "unknown")], "kind string")
    counted = _identifiers(spark, sf).where("ref is not null").groupBy(T.classify_identifier(F.col("ref")).alias("kind")).agg(F.count(F.lit(1)).alias("n"))
    return kinds.join(counted, "kind", "left").select("kind", F.coalesce("n", F.lit(0)).alias("n"))


@query("""SELECT point_id, substr(h, 1, 8) || '-' || substr(h, 9, 4) || '-' || substr(h, 13, 4) || '-' || substr(h, 17, 4) || '-' || substr(h, 21, 12) AS stub_id FROM (SELECT point_id, sha256(lower(payload.identifier)) AS h FROM seed_stubs WHERE payload.identifier IS NOT NULL)""")
def deterministic_ids(spark, sf):
    return table(spark, sf, "seed_stubs").where("payload.identifier is not null").select("point_id", T.hashed_uuid(F.col("payload.identifier")).alias("stub_id"))


@query()
def injected_ids(spark, sf):
    works = table(spark, sf, "raw_papers").where("openalex_id is not null").select("raw_id", F.concat(F.lit("openalex:"), "openalex_id").alias("name"))
    return works.select("raw_id", T.uuid5_url(F.col("name")).alias("uuid"))


@query("""SELECT doc_id, string_agg(w, ' ' ORDER BY p) AS text_again FROM (SELECT doc_id, unnest(ws) AS w, generate_subscripts(ws, 1) AS p FROM (SELECT doc_id, string_split(text, ' ') AS ws FROM documents WHERE text IS NOT NULL)) GROUP BY doc_id""")
def inverted_index_reconstruct(spark, sf):
    words = table(spark, sf, "documents").where("text is not null").select("doc_id", F.split("text", " ").alias("ws"))
    placed = words.select("doc_id", F.posexplode("ws").alias("p", "w"))
    index = placed.groupBy("doc_id", "w").agg(F.collect_list("p").alias("ps")).groupBy("doc_id").agg(F.map_from_entries(F.collect_list(F.struct("w", "ps"))).alias("index"))
    return index.select("doc_id", T.text_of_inverted_index(F.col("index")).alias("text_again"))


@query()
def title_acronyms(spark, sf):
    return table(spark, sf, "raw_papers").select("raw_id", T.acronyms(F.col("title")).alias("acronyms")).where(F.size("acronyms") > 0)


@query("""SELECT raw_id, lower(list_last(regexp_split_to_array(trim(authors[1].name), '\\s+'))) AS surname FROM raw_papers WHERE len(authors) > 0 AND coalesce(trim(authors[1].name), '') <> ''""")
def first_author_surname(spark, sf):
    first = F.try_element_at("authors", F.lit(1))["name"]
    return table(spark, sf, "raw_papers").where(T.has_value(first)).select("raw_id", T.surname(first).alias("surname"))


@query("""SELECT event_id, event_type, CAST(json_extract(props, '$.k') AS BIGINT) AS k FROM events WHERE json_extract(props, '$.k') IS NOT NULL""")
def json_properties(spark, sf):
    return table(spark, sf, "events").select("event_id", "event_type", F.get_json_object("props", "$.k").cast("bigint").alias("k")).where("k is not null")


@query("""WITH s AS (SELECT doc_id, list_filter(regexp_split_to_array(regexp_replace(trim(regexp_replace(text, '\\s+', ' ', 'g')), '([.!?]) ', '\\1' || chr(1), 'g'), chr(1)), lambda x: x <> '') AS s FROM documents WHERE coalesce(trim(text), '') <> '')
SELECT doc_id, p, CASE WHEN ends_with(x, '?') THEN 'question' WHEN regexp_matches(x, '[0-9]') THEN 'result' ELSE 'background' END AS label FROM (SELECT doc_id, unnest(s) AS x, generate_subscripts(s, 1)::INT AS p FROM s)""")
def sentence_roles(spark, sf):
    docs = table(spark, sf, "documents").where(T.has_value(F.col("text"))).select("doc_id", F.posexplode(T.sentences(F.col("text"))).alias("p", "x"))
    label = F.when(F.col("x").endswith("?"), "question").when(F.col("x").rlike("[0-9]"), "result").otherwise("background")
    return docs.select("doc_id", (F.col("p") + 1).alias("p"), label.alias("label"))


@query("""SELECT raw_id, '[' || string_agg(r, ',' ORDER BY r) || '] ' || s AS structured FROM (SELECT DISTINCT raw_id, s, r FROM (SELECT raw_id, trim(unnest(keywords)) AS s, coalesce(paper_type, 'none') AS r FROM raw_papers)) WHERE s <> '' GROUP BY raw_id, s""")
def structured_text(spark, sf):
    rows = table(spark, sf, "raw_papers").select("raw_id", F.explode("keywords").alias("s"), F.coalesce("paper_type", F.lit("none")).alias("r")).select("raw_id", F.trim("s").alias("s"), "r").where("s <> ''")
    joined = rows.groupBy("raw_id", "s").agg(F.array_sort(F.collect_set("r")).alias("rs"))
    return joined.select("raw_id", F.concat(F.lit("["), F.array_join("rs", ","), F.lit("] "), "s").alias("structured"))


# Joins
_WORKS = "SELECT raw_id, nullif(trim(openalex_id), '') AS k FROM raw_papers"


@query(f"""WITH k AS (SELECT raw_id, batch_no, {_DOI.format('doi')} AS d, nullif(trim(openalex_id), '') AS w, {_TITLE.format('title')} AS t FROM raw_papers), c AS (SELECT * FROM k WHERE batch_no = 0), n AS (SELECT * FROM k WHERE batch_no > 0),
m AS (SELECT n.raw_id, 0 AS p, min(c.raw_id) AS corpus_id FROM n JOIN c ON n.d = c.d GROUP BY n.raw_id UNION ALL SELECT n.raw_id, 1, min(c.raw_id) FROM n JOIN c ON n.w = c.w GROUP BY n.raw_id UNION ALL SELECT n.raw_id, 2, min(c.raw_id) FROM n JOIN c ON n.t = c.t AND n.t <> '' GROUP BY n.raw_id)
SELECT raw_id, corpus_id, (['doi', 'work', 'title'])[p + 1] AS matched_by FROM (SELECT *, row_number() OVER (PARTITION BY raw_id ORDER BY p, corpus_id) AS n FROM m) WHERE n = 1""")
def prioritized_match(spark, sf):
    """Works of the later batches with the record of the corpus (batch 0) that their DOI, work id or title finds first."""
    papers = table(spark, sf, "raw_papers")
    works = papers.where("batch_no > 0").select("raw_id", "doi", "openalex_id", "title")
    corpus = papers.where("batch_no = 0").select(F.col("raw_id").alias("corpus_id"), F.col("doi").alias("rdoi"), F.col("openalex_id").alias("rwork"), F.col("title").alias("rtitle"))
    keys = [
        ("doi", T.plain_doi(F.col("doi")), T.plain_doi(F.col("rdoi"))),
        ("work", F.nullif(F.trim("openalex_id"), F.lit("")), F.nullif(F.trim("rwork"), F.lit(""))),
        ("title", T.normalize_title(F.col("title")), T.normalize_title(F.col("rtitle"))),
    ]
    return R.prioritized_match(works, corpus, keys, "raw_id", "corpus_id")


@query(f"""WITH s AS (SELECT point_id, {_TITLE.format('payload.title')} AS t, payload.year AS y, lower(list_last(regexp_split_to_array(trim(payload.authors[1].display_name), '\\s+'))) AS a FROM seed_stubs),
r AS (SELECT raw_id, {_TITLE.format('title')} AS t, year AS y, lower(list_last(regexp_split_to_array(trim(authors[1].name), '\\s+'))) AS a FROM raw_papers)
SELECT point_id, min(raw_id) AS raw_id FROM s JOIN r ON s.t = r.t AND s.t <> '' AND (abs(s.y - r.y) <= 1 OR s.a = r.a OR (s.y IS NULL AND s.a IS NULL)) GROUP BY point_id""")
def title_corroboration_match(spark, sf):
    stubs = table(spark, sf, "seed_stubs").select("point_id", T.normalize_title(F.col("payload.title")).alias("t"), F.col("payload.year").alias("y"), T.surname(F.try_element_at("payload.authors", F.lit(1))["display_name"]).alias("a")).where("t <> ''")
    raws = table(spark, sf, "raw_papers").select("raw_id", T.normalize_title(F.col("title")).alias("t"), F.col("year").alias("ry"), T.surname(F.try_element_at("authors", F.lit(1))["name"]).alias("ra"))
    sure = (F.abs(F.col("y") - F.col("ry")) <= 1) | (F.col("a") == F.col("ra")) | (F.col("y").isNull() & F.col("a").isNull())
    return stubs.join(raws, "t").where(F.coalesce(sure, F.lit(False))).groupBy("point_id").agg(F.min("raw_id").alias("raw_id"))


@query(f"""WITH c AS (SELECT openalex_id, {_DOI.format('doi')} AS d FROM raw_papers WHERE batch_no = 0) SELECT raw_id FROM raw_papers r WHERE batch_no > 0 AND NOT EXISTS (SELECT 1 FROM c WHERE c.openalex_id = r.openalex_id) AND NOT EXISTS (SELECT 1 FROM c WHERE c.d = {_DOI.format('r.doi')})""")
def anti_join_gaps(spark, sf):
    """Works of the later batches that the corpus (batch 0) has neither by work id nor by DOI."""
    papers = table(spark, sf, "raw_papers").select("raw_id", "batch_no", "openalex_id", T.plain_doi(F.col("doi")).alias("d"))
    corpus = papers.where("batch_no = 0")
    return papers.where("batch_no > 0").join(corpus.select("openalex_id"), "openalex_id", "left_anti").join(corpus.select("d"), "d", "left_anti").select("raw_id")


@query(f"""WITH n AS (SELECT 'W' || regexp_extract(upper(ref), 'W([0-9]+)', 1) AS work, count(DISTINCT id) AS citers FROM (SELECT point_id AS id, unnest(payload.referenced_works) AS ref FROM seed_papers) WHERE regexp_matches(upper(trim(ref)), 'W[0-9]+$') GROUP BY 1)
SELECT work, citers FROM n WHERE citers >= 2""")
def anchor_counts(spark, sf):
    refs = table(spark, sf, "seed_papers").select("point_id", F.explode("payload.referenced_works").alias("ref")).where(F.upper(F.trim("ref")).rlike("W[0-9]+$"))
    return refs.groupBy(work_key(F.col("ref")).alias("work")).agg(F.countDistinct("point_id").alias("citers")).where("citers >= 2")


_KEYS = f"SELECT k, min(point_id) AS target FROM (SELECT {_work('payload.openalex_id')} AS k, point_id FROM seed_papers UNION ALL SELECT {_work('openalex_id')}, id FROM paper_responses) WHERE k IS NOT NULL GROUP BY k"


@query(f"""WITH refs AS (SELECT point_id, unnest(payload.referenced_works) AS ref, generate_subscripts(payload.referenced_works, 1)::INT AS pos FROM seed_papers), known AS ({_KEYS})
SELECT r.point_id, r.pos, {_work('r.ref')} AS ref, k.target FROM refs r LEFT JOIN known k ON k.k = {_work('r.ref')} WHERE {_work('r.ref')} IS NOT NULL""")
def resolve_references(spark, sf):
    seeds, papers = table(spark, sf, "seed_papers"), table(spark, sf, "paper_responses")
    known = seeds.select(work_key(F.col("payload.openalex_id")).alias("ref"), "point_id").unionByName(papers.select(work_key(F.col("openalex_id")).alias("ref"), F.col("id").alias("point_id")))
    known = known.where("ref is not null").groupBy("ref").agg(F.min("point_id").alias("target"))
    refs = seeds.select("point_id", F.posexplode("payload.referenced_works").alias("pos", "r")).select("point_id", (F.col("pos") + 1).alias("pos"), work_key(F.col("r")).alias("ref")).where("ref is not null")
    return refs.join(known, "ref", "left").select("point_id", "pos", "ref", "target")


@query(f"""WITH refs AS (SELECT point_id, unnest(payload.referenced_works) AS ref FROM seed_papers), known AS ({_KEYS}), lost AS (SELECT DISTINCT {_work('ref')} AS k, point_id FROM refs WHERE {_work('ref')} IS NOT NULL)
SELECT k AS identifier, count(*) AS citers, min(point_id) AS first_citer FROM lost WHERE k NOT IN (SELECT k FROM known) GROUP BY k""")
def create_stubs(spark, sf):
    lost = resolve_references(spark, sf).where("target is null").select(F.col("ref").alias("identifier"), "point_id").distinct()
    return lost.groupBy("identifier").agg(F.count(F.lit(1)).alias("citers"), F.min("point_id").alias("first_citer"))


_TOKENS = "SELECT rec_id AS id, list_sort(list_distinct(string_split(t, ' '))) AS t FROM (SELECT rec_id, " + _TITLE.format("title") + " AS t FROM (SELECT rec_id, title FROM feed_openreview UNION ALL SELECT rec_id, title FROM feed_dblp)) WHERE t <> ''"


@query(f"""WITH s AS ({_TOKENS}), d AS (SELECT t, min(id) AS id FROM s GROUP BY t)
SELECT a.id AS a, b.id AS b, round(len(list_intersect(a.t, b.t)) * 1.0 / (len(a.t) + len(b.t) - len(list_intersect(a.t, b.t))), 6)::DOUBLE AS similarity FROM d a JOIN d b ON a.id < b.id WHERE len(list_intersect(a.t, b.t)) * 1.0 / (len(a.t) + len(b.t) - len(list_intersect(a.t, b.t))) >= 0.9""")
def fuzzy_title_jaccard(spark, sf):
    """Pairs of representatives; ``title_set_members`` has the rows that each stands for."""
    return R.similar_sets(_title_words(spark, sf), "rec_id", "t", 0.9).withColumn("similarity", F.round("similarity", 6))


@query(f"SELECT DISTINCT id AS rec_id, min(id) OVER (PARTITION BY t) AS representative FROM ({_TOKENS})")
def title_set_members(spark, sf):
    return R.set_members(_title_words(spark, sf), "rec_id", "t")


def _title_words(spark, sf):
    feeds = table(spark, sf, "feed_openreview").select("rec_id", "title").unionByName(table(spark, sf, "feed_dblp").select("rec_id", "title"))
    return feeds.select("rec_id", F.split(T.normalize_title(F.col("title")), " ").alias("t")).where(F.element_at("t", 1) != "")


@query(f"""WITH e AS (SELECT DISTINCT id AS src, {_record('ref')} AS dst FROM (SELECT id, unnest(resolved_references) AS ref FROM paper_responses))
SELECT e.src, e.dst, coalesce(max(p.title), 'not found') AS title FROM e LEFT JOIN paper_responses p ON p.id = e.dst WHERE e.dst IS NOT NULL GROUP BY 1, 2""")
def neighbour_lookup(spark, sf):
    papers = table(spark, sf, "paper_responses")
    edges = papers.select(F.col("id").alias("src"), F.explode("resolved_references").alias("r")).select("src", record_key(F.col("r")).alias("dst")).where("dst is not null").distinct()
    titles = papers.groupBy(F.col("id").alias("dst")).agg(F.max("title").alias("title"))
    return edges.join(titles, "dst", "left").select("src", "dst", F.coalesce("title", F.lit("not found")).alias("title"))


@query("""WITH v AS (SELECT venue, min(tier) AS vt FROM raw_papers WHERE tier IS NOT NULL AND coalesce(trim(venue), '') <> '' GROUP BY venue) SELECT id, fetched_at, coalesce(tier, vt) AS tier FROM paper_responses p LEFT JOIN v ON p.venue = v.venue""")
def tier_retrofit(spark, sf):
    venues = table(spark, sf, "raw_papers").where("tier is not null and trim(venue) <> ''").groupBy("venue").agg(F.min("tier").alias("vt"))
    return table(spark, sf, "paper_responses").select("id", "fetched_at", "tier", "venue").join(venues, "venue", "left").select("id", "fetched_at", F.coalesce("tier", "vt").alias("tier"))


# Merges
_LATEST = "SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY openalex_id ORDER BY raw_id) AS n FROM raw_papers WHERE openalex_id IS NOT NULL AND batch_no > 0) WHERE n = 1"


@query(f"""WITH u AS ({_LATEST}) SELECT p.raw_id, CASE WHEN coalesce(trim(p.abstract), '') = '' AND coalesce(trim(u.abstract), '') <> '' THEN u.abstract ELSE p.abstract END AS abstract, CASE WHEN coalesce(trim(p.doi), '') = '' AND coalesce(trim(u.doi), '') <> '' THEN u.doi ELSE p.doi END AS doi,
 concat_ws(',', CASE WHEN coalesce(trim(p.abstract), '') = '' AND coalesce(trim(u.abstract), '') <> '' THEN 'abstract' END, CASE WHEN coalesce(trim(p.doi), '') = '' AND coalesce(trim(u.doi), '') <> '' THEN 'doi' END) AS filled
FROM raw_papers p LEFT JOIN u ON p.openalex_id = u.openalex_id WHERE p.batch_no = 0""")
def fill_missing_merge(spark, sf):
    """The corpus (batch 0) with the abstract and DOI that it lacks from the first later work of the same work id."""
    papers = table(spark, sf, "raw_papers").select("raw_id", "batch_no", "openalex_id", "abstract", "doi")
    updates = R.first_wins(papers.where("openalex_id is not null and batch_no > 0"), ["openalex_id"], [F.col("raw_id")]).drop("raw_id", "batch_no")
    merged = R.fill_missing(papers.where("batch_no = 0"), updates, "openalex_id", {"abstract": "string", "doi": "string"})
    return merged.select("raw_id", "abstract", "doi", F.array_join("filled", ",").alias("filled"))


@query("""WITH o AS (SELECT c_custkey AS g, o_orderkey AS i, o_totalprice AS p, 0 AS fresh FROM orders JOIN customer ON c_custkey = o_custkey WHERE o_orderdate < TIMESTAMP '1999-01-01 00:00:00' UNION ALL SELECT o_custkey, o_orderkey, o_totalprice, 1 FROM orders),
d AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY g, i ORDER BY fresh) AS n FROM o) WHERE n = 1)
SELECT g, i, p, place FROM (SELECT g, i, p, row_number() OVER (PARTITION BY g ORDER BY p DESC, i)::INT AS place FROM d) WHERE place <= 5""")
def union_capped(spark, sf):
    orders = table(spark, sf, "orders").select(F.col("o_custkey").alias("g"), F.col("o_orderkey").alias("i"), F.col("o_totalprice").alias("p"), "o_orderdate")
    known = orders.join(table(spark, sf, "customer").select(F.col("c_custkey").alias("g")), "g", "left_semi").where(F.col("o_orderdate") < F.lit("1999-01-01").cast("timestamp_ntz")).drop("o_orderdate")
    return R.union_capped(known, orders.drop("o_orderdate"), "g", "i", [F.col("p").desc(), F.col("i")], 5)


@query("""SELECT k, string_agg(c, '|' ORDER BY c) AS cited_by FROM (SELECT DISTINCT k, c FROM (SELECT upper(payload.doi) AS k, unnest(payload.cited_by) AS c FROM seed_stubs UNION ALL SELECT upper(payload.doi), unnest(payload.cited_by) FROM seed_papers)) WHERE c IS NOT NULL AND k IS NOT NULL GROUP BY k""")
def stub_merge(spark, sf):
    listed = lambda t: table(spark, sf, t).select(F.upper("payload.doi").alias("k"), F.col("payload.cited_by").alias("cited_by")).where("k is not null")
    return R.set_union_lists([listed("seed_stubs"), listed("seed_papers")], "k", "cited_by").select("k", F.array_join("cited_by", "|").alias("cited_by"))


@query("""SELECT raw_id, CASE WHEN coalesce(venue_type = 'preprint', false) THEN NULL ELSE abstract END AS abstract, coalesce(venue_type = 'preprint', false) AS is_stub, CASE WHEN venue_type = 'preprint' THEN 'preprint' END AS demoted_for FROM raw_papers""")
def demote(spark, sf):
    papers = table(spark, sf, "raw_papers").select("raw_id", "abstract", "venue_type", F.lit(False).alias("is_stub"))
    return R.demote(papers, F.col("venue_type") == "preprint", ["abstract"], "preprint").drop("venue_type")


@query("""SELECT id, fetched_at, citation_count FROM (SELECT id, fetched_at, citation_count, row_number() OVER (PARTITION BY id ORDER BY fetched_at DESC) AS n FROM (SELECT DISTINCT id, fetched_at, citation_count FROM paper_responses)) WHERE n = 1""")
def latest_state(spark, sf):
    changes = table(spark, sf, "paper_responses").select("id", "fetched_at", "citation_count").distinct()
    return R.upsert(changes.limit(0), changes, "id", "fetched_at")


@query()
def sequence_title_match(spark, sf):
    """Titles of both feeds that are nearly the same sequence."""
    side = lambda t, c: materialize(table(spark, sf, t).select(F.col("rec_id").alias(c), T.normalize_title(F.col("title")).alias("t")).where("t <> ''"), "titles")
    a, b = side("feed_openreview", "a"), side("feed_dblp", "b")
    # Each title is compared once, under the least id that has it; ratios that round to 0.9 count.
    ua, ub = a.groupBy("t").agg(F.min("a").alias("id")), b.groupBy("t").agg(F.min("b").alias("id"))
    near = R.similar_sequences(ua, ub, 0.89995)
    bearers = lambda u, rows, k, c: u.join(rows, "t").select(F.col("id").alias(k), c)
    pairs = near.join(bearers(ua, a, "x", "a"), "x").join(bearers(ub, b, "y", "b"), "y")
    return pairs.select("a", "b", F.round("ratio", 4).alias("ratio")).where("ratio >= 0.9")


_KEYWORDS = "list_filter(flatten(list_transform(keywords, lambda k: CASE WHEN regexp_full_match(k, '[A-Z0-9-]{2,}s') THEN [k, regexp_replace(k, 's$', '')] ELSE [k] END)), lambda k: k IS NOT NULL)"


@query(f"SELECT raw_id, len(list_distinct(list_transform({_KEYWORDS}, lambda k: lower(k))))::INT AS n FROM raw_papers WHERE len(keywords) > 0")
def keyword_dedup(spark, sf):
    return keyword_lists(spark, sf).select("raw_id", F.size("keywords").alias("n"))


@query(f"""WITH k AS (SELECT raw_id, unnest({_KEYWORDS}) AS k, generate_subscripts({_KEYWORDS}, 1) AS p FROM raw_papers), f AS (SELECT raw_id, arg_min(k, p) AS k, min(p) AS p FROM k GROUP BY raw_id, lower(k))
SELECT r.raw_id, coalesce(list(f.k ORDER BY f.p) FILTER (f.k IS NOT NULL), []) AS keywords FROM raw_papers r LEFT JOIN f USING (raw_id) WHERE len(r.keywords) > 0 GROUP BY r.raw_id""")
def keyword_lists(spark, sf):
    """The keywords that ``keyword_dedup`` counts."""
    return table(spark, sf, "raw_papers").where("size(keywords) > 0").select("raw_id", T.with_singulars(F.col("keywords")).alias("keywords"))


@query(r"""SELECT doc_id, CASE WHEN regexp_matches(h, 'abstract') THEN 'abstract' WHEN regexp_matches(h, 'introduc') THEN 'introduction' WHEN regexp_matches(h, 'related|background|prior') THEN 'related' WHEN regexp_matches(h, 'method|approach|model') THEN 'method'
 WHEN regexp_matches(h, 'experiment|evaluation|setup') THEN 'experiment' WHEN regexp_matches(h, 'result') THEN 'result' WHEN regexp_matches(h, 'discuss|limitation|conclu|outlook') THEN 'conclusion' ELSE 'other' END AS kind FROM (SELECT doc_id, lower(coalesce(string_split(text, chr(10))[1], '')) AS h FROM documents)""")
def section_classification(spark, sf):
    return table(spark, sf, "documents").select("doc_id", T.section_class(F.substring_index("text", "\n", 1)).alias("kind"))


@query(r"""SELECT DISTINCT doc_id, regexp_replace(lower(unnest(regexp_extract_all(text, '(?i)https?://(?:www\.)?(?:github|gitlab)\.com/[\w.-]+/[\w.-]+'))), '(\.git)?[.,;]*$', '') AS url FROM documents""")
def repository_links(spark, sf):
    return table(spark, sf, "documents").select("doc_id", F.explode(T.repository_urls(F.col("text"))).alias("url"))


@query(f"""WITH s AS (SELECT point_id, lower(trim(unnest([payload.identifier, payload.doi, payload.openalex_id]))) AS k FROM (SELECT point_id, {{'identifier': payload.identifier, 'doi': payload.doi, 'openalex_id': NULL}} AS payload FROM seed_stubs UNION ALL SELECT point_id, {{'identifier': NULL, 'doi': payload.doi, 'openalex_id': payload.openalex_id}} FROM seed_papers))
SELECT k, min(point_id) AS point_id, count(DISTINCT point_id) AS holders FROM s WHERE coalesce(k, '') <> '' GROUP BY k""")
def identifier_index(spark, sf):
    stubs = table(spark, sf, "seed_stubs").select("point_id", F.explode(F.array("payload.identifier", "payload.doi")).alias("k"))
    seeds = table(spark, sf, "seed_papers").select("point_id", F.explode(F.array("payload.doi", "payload.openalex_id")).alias("k"))
    keyed = stubs.unionByName(seeds).select("point_id", F.lower(F.trim("k")).alias("k")).where("k <> ''")
    return keyed.groupBy("k").agg(F.min("point_id").alias("point_id"), F.countDistinct("point_id").alias("holders"))


@query(f"""WITH a AS (SELECT rec_id AS a, {_TITLE.format('title')} AS ta FROM feed_openreview), b AS (SELECT rec_id AS b, {_TITLE.format('title')} AS tb FROM feed_dblp)
SELECT a, b FROM a JOIN b ON ta = tb OR (length(tb) > 20 AND contains(ta, tb)) OR (length(tb) > 20 AND contains(tb, ta))""")
def containment_title_match(spark, sf):
    """Titles of both feeds that are equal, or of which one stands anywhere in the other and that of dblp has over 20 letters."""
    side = lambda t, c: table(spark, sf, t).select(F.col("rec_id").alias(c), T.normalize_title(F.col("title")).alias("t"))
    a, b = materialize(side("feed_openreview", "a"), "titles"), materialize(side("feed_dblp", "b"), "titles")
    # Each title is looked up once, under the least id that has it.
    ua, ub = a.groupBy("t").agg(F.min("a").alias("id")), b.where("length(t) > 20").groupBy("t").agg(F.min("b").alias("id"))
    inside = R.contained(ua, ub).select(F.col("s").alias("ha"), F.col("l").alias("hb"))
    around = R.contained(ub, ua).select(F.col("l").alias("ha"), F.col("s").alias("hb"))
    bearers = lambda u, rows, c: u.join(rows, "t").select(F.col("id").alias(f"h{c}"), c)
    held = inside.unionByName(around).join(bearers(ua, a, "a"), "ha").join(bearers(ub, b, "b"), "hb").select("a", "b")
    return a.join(b, "t").select("a", "b").unionByName(held)


@query(f"""WITH w AS (SELECT raw_id, batch_no, {_DOI.format('doi')} AS d, nullif(lower(trim(arxiv_id)), '') AS x FROM raw_papers), c AS (SELECT * FROM w WHERE batch_no = 0)
SELECT raw_id, CASE WHEN d IN (SELECT d FROM c WHERE d IS NOT NULL) OR x IN (SELECT x FROM c WHERE x IS NOT NULL) THEN 'core' ELSE 'external' END AS label, coalesce((SELECT min(c.raw_id) FROM c WHERE c.d = w.d), (SELECT min(c.raw_id) FROM c WHERE c.x = w.x)) AS corpus_id FROM w WHERE batch_no > 0""")
def core_or_external(spark, sf):
    """Works of the later batches, labelled core with their record where the corpus (batch 0) has their DOI, else their preprint id."""
    papers = table(spark, sf, "raw_papers").select("raw_id", "batch_no", T.plain_doi(F.col("doi")).alias("d"), F.nullif(F.lower(F.trim("arxiv_id")), F.lit("")).alias("x"))
    works, corpus = papers.where("batch_no > 0"), papers.where("batch_no = 0").select(F.col("raw_id").alias("corpus_id"), F.col("d").alias("cd"), F.col("x").alias("cx"))
    hits = R.prioritized_match(works, corpus, [("doi", F.col("d"), F.col("cd")), ("preprint", F.col("x"), F.col("cx"))], "raw_id", "corpus_id")
    return works.select("raw_id").join(hits, "raw_id", "left").select("raw_id", F.when(F.col("corpus_id").isNull(), "external").otherwise("core").alias("label"), "corpus_id")


@query("""SELECT count(*) AS papers, count(*) FILTER (len(resolved_references) > 0) AS with_references, sum(coalesce(len(resolved_references), 0))::BIGINT AS listed, sum(coalesce(reference_count, 0))::BIGINT AS counted, round(100.0 * sum(coalesce(len(resolved_references), 0)) / sum(coalesce(reference_count, 0)), 1)::DOUBLE AS coverage_pct FROM paper_responses""")
def citation_graph_stats(spark, sf):
    n = F.when(F.col("resolved_references").isNotNull(), F.size("resolved_references")).otherwise(0).cast("bigint")
    stats = table(spark, sf, "paper_responses").agg(F.count(F.lit(1)).alias("papers"), F.count_if(n > 0).alias("with_references"), F.sum(n).alias("listed"), F.sum(F.coalesce("reference_count", F.lit(0)).cast("bigint")).alias("counted"))
    return stats.withColumn("coverage_pct", F.round(F.lit(100.0) * F.col("listed") / F.col("counted"), 1))


@query("""SELECT 'doi' AS kind, count(DISTINCT lower(trim(doi))) AS n FROM raw_papers WHERE coalesce(trim(doi), '') <> '' UNION ALL SELECT 'openalex_id', count(DISTINCT openalex_id) FROM raw_papers WHERE openalex_id <> '' UNION ALL SELECT 'acl_id', count(DISTINCT acl_id) FROM raw_papers WHERE acl_id <> ''""")
def identifier_sets(spark, sf):
    papers = table(spark, sf, "raw_papers").select(F.explode(F.array(*[F.struct(F.lit(k).alias("kind"), (F.lower(F.trim(k)) if k == "doi" else F.col(k)).alias("v")) for k in ("doi", "openalex_id", "acl_id")])).alias("x")).select("x.*")
    return papers.where("v is not null and v <> ''").groupBy("kind").agg(F.countDistinct("v").alias("n"))


@query("""WITH r AS (SELECT group_id, member_table, member_key FROM dup_members), f AS (SELECT group_id, member_table, min(member_key) AS first_key, count(DISTINCT member_key) AS members FROM r GROUP BY ALL) SELECT group_id, member_table, first_key, members FROM f WHERE members > 1""")
def group_heads(spark, sf):
    return table(spark, sf, "dup_members").groupBy("group_id", "member_table").agg(F.min("member_key").alias("first_key"), F.countDistinct("member_key").alias("members")).where("members > 1")


@query(f"""WITH k AS (SELECT raw_id, unnest(['d|' || {_DOI.format('doi')}, 'w|' || nullif(trim(openalex_id), ''), 'a|' || nullif(trim(acl_id), '')]) AS k FROM raw_papers), f AS (SELECT k, min(raw_id) AS first FROM k WHERE k IS NOT NULL GROUP BY k)
SELECT raw_id, title FROM raw_papers WHERE raw_id NOT IN (SELECT k.raw_id FROM k JOIN f USING (k) WHERE k.raw_id > f.first)""")
def dedup_sequential(spark, sf):
    papers = table(spark, sf, "raw_papers").select("raw_id", "title", "doi", "openalex_id", "acl_id")
    keys = [("d", T.plain_doi(F.col("doi"))), ("w", F.nullif(F.trim("openalex_id"), F.lit(""))), ("a", F.nullif(F.trim("acl_id"), F.lit("")))]
    return R.sequential_dedup(papers, keys, "raw_id").select("raw_id", "title")
