"""Functions over titles, texts and identifiers: what is extracted, classified and keyed."""

from __future__ import annotations

from pyspark.sql import functions as F

from scholion.functions import text as T
from scholion.plans.registry import Registry, blank_sql, doi_sql
from scholion.runtime import table

REGISTRY = Registry()
query = REGISTRY.query
QUERIES, SQL = REGISTRY.queries, REGISTRY.sql


@query(r"""SELECT raw_id, trim(regexp_replace(regexp_replace(lower(title), '[^\p{L}\p{N}_\s]', '', 'g'), '\s+', ' ', 'g')) AS title_norm FROM raw_papers WHERE title IS NOT NULL""")
def title_normalized_plain(spark, sf):
    """The title in lower case with letters, digits and single spaces only; accents stay."""
    return table(spark, sf, "raw_papers").where("title is not null").select("raw_id", T.lettered(F.lower("title")).alias("title_norm"))


@query(f"""SELECT raw_id, coalesce({blank_sql('doi')}, {blank_sql('arxiv_id')}, {blank_sql('acl_id')}, {blank_sql('source_id')}) AS primary_id FROM raw_papers""")
def primary_id(spark, sf):
    return table(spark, sf, "raw_papers").select("raw_id", F.coalesce(*[F.nullif(F.trim(c), F.lit("")) for c in ("doi", "arxiv_id", "acl_id", "source_id")]).alias("primary_id"))


@query(f"""SELECT raw_id, nullif(regexp_extract({doi_sql('doi')}, '^10\\.[0-9]+/(?:preprint|arxiv)[.\\-_:](.+)$', 1), '') AS preprint FROM raw_papers WHERE regexp_matches({doi_sql('doi')}, '^10\\.[0-9]+/(?:preprint|arxiv)[.\\-_:](.+)$')""")
def preprint_from_doi(spark, sf):
    """The preprint's own id out of the DOI that its server gives it."""
    return table(spark, sf, "raw_papers").select("raw_id", T.preprint_of_doi(T.plain_doi(F.col("doi"))).alias("preprint")).where("preprint is not null")


# How the ids of sources begin.
PREFIXES = {"openalex": "oa:", "arxiv": "ar:", "dblp": "conf/", "dblp_journal": "journals/"}


@query("SELECT raw_id, CASE " + " ".join(f"WHEN starts_with(source_id, '{p}') THEN '{n}'" for n, p in PREFIXES.items()) + " ELSE 'unknown' END AS by_prefix FROM raw_papers WHERE source_id IS NOT NULL")
def source_from_prefix(spark, sf):
    return table(spark, sf, "raw_papers").where("source_id is not null").select("raw_id", T.by_prefix(F.col("source_id"), PREFIXES).alias("by_prefix"))


@query("""SELECT raw_id, md5(lower(trim(title)) || ':' || source || ':20') AS cache_key FROM raw_papers WHERE title IS NOT NULL AND source IS NOT NULL""")
def cache_keys(spark, sf):
    """The key under which an answer to a query is kept: its text, source and limit."""
    return table(spark, sf, "raw_papers").where("title is not null and source is not null").select("raw_id", F.md5(F.concat(F.lower(F.trim("title")), F.lit(":"), "source", F.lit(":20"))).alias("cache_key"))


# Words of titles that tell a paper's kind, tested in this order.
KINDS = (("survey", "survey|review of|overview"), ("dataset", "dataset|corpus|benchmark|collection of"), ("demo", "demo|toolkit|system for|library"), ("position", "position|perspective|rethinking|towards"), ("analysis", "analysis|study|revisited|empirical"))


@query("SELECT raw_id, CASE " + " ".join(f"WHEN regexp_matches(lower(title), '{p}') THEN '{k}'" for k, p in KINDS) + " ELSE 'method' END AS kind FROM raw_papers WHERE title IS NOT NULL")
def paper_kinds(spark, sf):
    """The kind of a paper by words of its title, the first rule that holds."""
    return table(spark, sf, "raw_papers").where("title is not null").select("raw_id", T.by_rules(F.lower("title"), KINDS, "method").alias("kind"))


@query("""SELECT raw_id, title FROM raw_papers WHERE NOT regexp_matches(lower(coalesce(title, '')), 'survey|review|benchmark|dataset')""")
def kinds_excluded(spark, sf):
    """Papers without those whose titles name a kind that was excluded."""
    return table(spark, sf, "raw_papers").where(~F.lower(F.coalesce("title", F.lit(""))).rlike("survey|review|benchmark|dataset")).select("raw_id", "title")


# What a query asks for, by its words; sections in the order in which ties go.
RECENT = "recent|latest|new|current|state of the art"
SECTIONS = {"method": ("method", "approach", "model", "algorithm", "learning"), "task": ("task", "problem", "recognition", "detection"), "result": ("result", "performance", "accuracy", "evaluation")}


def _hits_sql(words) -> str:  # noqa: ANN001
    return " + ".join(f"contains(q, '{w}')::INT" for w in words)


@query(f"""WITH h AS (SELECT raw_id, lower(trim(title)) AS q FROM raw_papers WHERE raw_id % 20 = 0 AND title IS NOT NULL), c AS (SELECT raw_id, q, {', '.join(f'{_hits_sql(w)} AS {n}' for n, w in SECTIONS.items())} FROM h)
SELECT raw_id, starts_with(q, '"') AND ends_with(q, '"') AND length(q) > 1 AS exact, regexp_matches(q, '{RECENT}') AS recent, CASE WHEN greatest({', '.join(SECTIONS)}) = 0 THEN NULL {' '.join(f"WHEN {n} = greatest({', '.join(SECTIONS)}) THEN '{n}'" for n in SECTIONS)} END AS section,
 CASE WHEN starts_with(q, '"') OR len(string_split_regex(q, '\\s+')) <= 3 THEN 0.7 WHEN len(string_split_regex(q, '\\s+')) >= 12 THEN 1.4 ELSE 1.0 END::DOUBLE AS dense_weight FROM c""")
def query_intent(spark, sf):
    """What every stated query (titles of each twentieth paper) asks for: an exact title, recent work, a section, and how much meaning weighs against words."""
    asked = table(spark, sf, "raw_papers").where("raw_id % 20 = 0 and title is not null").select("raw_id", F.lower(F.trim("title")).alias("q"))
    exact = F.startswith("q", F.lit('"')) & F.endswith("q", F.lit('"')) & (F.length("q") > 1)
    n = F.size(F.split("q", r"\s+"))
    weight = F.when(F.startswith("q", F.lit('"')) | (n <= 3), 0.7).when(n >= 12, 1.4).otherwise(1.0)
    return asked.select("raw_id", exact.alias("exact"), F.col("q").rlike(RECENT).alias("recent"), T.first_most(F.col("q"), SECTIONS).alias("section"), weight.alias("dense_weight"))


@query(r"""WITH t AS (SELECT raw_id, title FROM raw_papers WHERE title IS NOT NULL), a AS (SELECT raw_id, regexp_extract(title, '^([A-Za-z][A-Za-z0-9-]{1,14})\s*[:–—]', 1) AS w, 'lead' AS way FROM t
 UNION ALL SELECT raw_id, unnest(regexp_extract_all(title, '\(([A-Z][A-Za-z0-9-]{1,14})\)', 1)), 'brackets' FROM t UNION ALL SELECT raw_id, w, 'capitals' FROM (SELECT raw_id, unnest(regexp_split_to_array(title, '[^A-Za-z0-9-]+')) AS w FROM t) WHERE regexp_full_match(w, '[A-Z]{2}[A-Z0-9-]{0,13}') UNION ALL SELECT raw_id, w, 'mixed' FROM (SELECT raw_id, unnest(regexp_split_to_array(title, '[^A-Za-z0-9-]+')) AS w FROM t) WHERE regexp_full_match(w, '[A-Z][a-z]+[A-Z][A-Za-z0-9]{0,12}'))
SELECT raw_id, w AS acronym, string_agg(DISTINCT way, '|' ORDER BY way) AS ways FROM a WHERE regexp_matches(w, '^[A-Za-z0-9-]{2,15}$') AND regexp_matches(w, '[A-Za-z]') AND upper(w) NOT IN """ + str(T.NOT_KEYWORDS) + " GROUP BY raw_id, w")
def title_acronym_ways(spark, sf):
    """Acronyms of titles with how each was found: leading, in brackets, in capitals, or in mixed case."""
    title = F.col("title")
    told = lambda way: lambda w: F.struct(w.alias("w"), F.lit(way).alias("way"))
    found = F.concat(*[F.transform(words, told(way)) for way, words in T.acronym_ways(title).items()])
    listed = table(spark, sf, "raw_papers").where("title is not null").select("raw_id", F.explode(found).alias("x")).select("raw_id", F.col("x.w").alias("acronym"), "x.way")
    return listed.where(T.valid_keyword(F.col("acronym"))).groupBy("raw_id", "acronym").agg(F.array_join(F.array_sort(F.collect_set("way")), "|").alias("ways"))


@query(r"""WITH a AS (SELECT raw_id, unnest(regexp_extract_all(abstract, '\b([A-Z][A-Z0-9-]{1,14})\b', 1)) AS w FROM raw_papers WHERE coalesce(trim(abstract), '') <> '') SELECT raw_id, w AS acronym, count(*) AS n FROM a WHERE regexp_matches(w, '[A-Za-z]') AND regexp_matches(w, '^[A-Za-z0-9-]{2,15}$') AND upper(w) NOT IN """ + str(T.NOT_KEYWORDS) + " GROUP BY ALL")
def abstract_acronyms(spark, sf):
    """Words in capitals in abstracts, with how often each comes."""
    words = F.regexp_extract_all("abstract", F.lit(r"\b([A-Z][A-Z0-9-]{1,14})\b"), F.lit(1))
    return table(spark, sf, "raw_papers").where(T.has_value(F.col("abstract"))).select("raw_id", F.explode(words).alias("acronym")).where(T.valid_keyword(F.col("acronym"))).groupBy("raw_id", "acronym").agg(F.count(F.lit(1)).alias("n"))


@query(r"""WITH t AS (SELECT raw_id, len(keywords) > 0 AS given, len(list_filter(regexp_split_to_array(title, '[^A-Za-z0-9-]+'), lambda w: regexp_full_match(w, '[A-Z]{2,}'))) > 0 AS found FROM raw_papers WHERE title IS NOT NULL) SELECT raw_id, CASE WHEN coalesce(given, false) AND found THEN 'both' WHEN coalesce(given, false) THEN 'given' WHEN found THEN 'found' ELSE 'none' END AS keywords_source FROM t""")
def keyword_source_tags(spark, sf):
    """Where a paper's keywords come from: given with it, found in its title, both or neither."""
    given, found = T.has_value(F.col("keywords"), "array"), F.exists(T.latin_words(F.col("title")), lambda w: w.rlike("^[A-Z]{2,}$"))
    return table(spark, sf, "raw_papers").where("title is not null").select("raw_id", F.when(given & found, "both").when(given, "given").when(found, "found").otherwise("none").alias("keywords_source"))


@query("""SELECT raw_id, array_to_string(list_transform(authors[1:10], lambda a: coalesce(nullif(trim(a.name), ''), 'Unknown')), '; ') AS authors FROM raw_papers WHERE len(authors) > 0""")
def author_names(spark, sf):
    """The first ten authors by name; one without is unknown."""
    shown = F.transform(F.slice("authors", 1, 10), lambda a: F.coalesce(F.nullif(F.trim(a["name"]), F.lit("")), F.lit("Unknown")))
    return table(spark, sf, "raw_papers").where("size(authors) > 0").select("raw_id", F.array_join(shown, "; ").alias("authors"))


@query(r"""WITH l AS (SELECT doc_id, unnest(string_split(text, chr(10))) AS line, generate_subscripts(string_split(text, chr(10)), 1) AS pos FROM documents WHERE text IS NOT NULL), h AS (SELECT doc_id, pos, lower(trim(line)) AS h FROM l WHERE regexp_matches(line, '^\s*([0-9]+[.)]?\s+|#+\s+)?[A-Z][^.!?]{0,60}$') AND length(trim(line)) > 0)
SELECT doc_id, pos::INT AS line, CASE WHEN regexp_matches(h, 'abstract') THEN 'abstract' WHEN regexp_matches(h, 'introduc') THEN 'introduction' WHEN regexp_matches(h, 'related|background|prior') THEN 'related' WHEN regexp_matches(h, 'method|approach|model') THEN 'method'
 WHEN regexp_matches(h, 'experiment|evaluation|setup') THEN 'experiment' WHEN regexp_matches(h, 'result') THEN 'result' WHEN regexp_matches(h, 'discuss|limitation|conclu|outlook') THEN 'conclusion' ELSE 'other' END AS kind FROM h""")
def section_headings(spark, sf):
    """Every line that looks like a heading, with the kind of section it opens."""
    lines = table(spark, sf, "documents").where("text is not null").select("doc_id", F.posexplode(F.split("text", "\n")).alias("p", "l"))
    heads = lines.where(F.col("l").rlike(r"^\s*([0-9]+[.)]?\s+|#+\s+)?[A-Z][^.!?]{0,60}$") & (F.length(F.trim("l")) > 0))
    return heads.select("doc_id", (F.col("p") + 1).alias("line"), T.section_class(F.col("l")).alias("kind"))


@query(r"""SELECT doc_id, regexp_extract_all(text, '(?:https?://|www\.)[^\s<>"]+')[1] AS first_link, len(regexp_extract_all(text, '(?:https?://|www\.)[^\s<>"]+'))::INT AS links, (2 * regexp_matches(lower(text), 'our code|our implementation|we release')::INT + regexp_matches(lower(text), 'available at|released at')::INT - regexp_matches(lower(text), 'baseline|third-party')::INT)::INT AS own_score FROM documents WHERE text IS NOT NULL""")
def link_scores(spark, sf):
    """Links of a text, and how far its words say that what they lead to is the authors' own."""
    links = F.regexp_extract_all("text", F.lit(r'(?:https?://|www\.)[^\s<>"]+'), F.lit(0))
    low = F.lower("text")
    says = lambda p: low.rlike(p).cast("int")
    score = 2 * says("our code|our implementation|we release") + says("available at|released at") - says("baseline|third-party")
    return table(spark, sf, "documents").where("text is not null").select("doc_id", F.try_element_at(links, F.lit(1)).alias("first_link"), F.size(links).alias("links"), score.alias("own_score"))


@query("""WITH s AS (SELECT doc_id, unnest(s) AS x, generate_subscripts(s, 1)::INT AS p FROM (SELECT doc_id, list_filter(regexp_split_to_array(regexp_replace(trim(regexp_replace(text, '\\s+', ' ', 'g')), '([.!?]) ', '\\1' || chr(1), 'g'), chr(1)), lambda x: x <> '') AS s FROM documents WHERE coalesce(trim(text), '') <> '')),
r AS (SELECT doc_id, unnest(string_split(regexp_replace(section || ',x', '[^a-z,]', '', 'g'), ',')) AS role, (length(section) % 5) + 1 AS idx FROM documents WHERE section IS NOT NULL)
SELECT s.doc_id, s.p, string_agg(DISTINCT r.role, ',' ORDER BY r.role) AS roles FROM s JOIN r ON r.doc_id = s.doc_id AND r.idx = s.p WHERE r.role IN ('abstract', 'body', 'review', 'notes') GROUP BY 1, 2""")
def role_indices(spark, sf):
    """Roles given by sentence number put to the sentences; numbers out of range and unknown roles are ignored."""
    docs = table(spark, sf, "documents")
    sents = docs.where(T.has_value(F.col("text"))).select("doc_id", F.posexplode(T.sentences(F.col("text"))).alias("p0", "x")).select("doc_id", (F.col("p0") + 1).alias("p"))
    given = docs.where("section is not null").select("doc_id", F.explode(F.split(F.regexp_replace(F.concat("section", F.lit(",x")), "[^a-z,]", ""), ",")).alias("role"), (F.length("section") % 5 + 1).alias("p"))
    return sents.join(given.where(F.col("role").isin("abstract", "body", "review", "notes")), ["doc_id", "p"]).groupBy("doc_id", "p").agg(F.array_join(F.array_sort(F.collect_set("role")), ",").alias("roles"))
