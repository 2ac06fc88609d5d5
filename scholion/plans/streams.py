"""Event-time and incremental queries over the events table, and round trips through sources and sinks."""

from __future__ import annotations

import uuid

from pyspark.sql import functions as F

from scholion.runtime import shared_dir, table
from scholion.sources import records, sinks
from scholion.streaming import live, phases

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


@query("SELECT time_bucket(INTERVAL 1 HOUR, ts) AS start, event_type, count(*) AS n, round(sum(value), 4) AS total FROM events GROUP BY ALL")
def events_tumbling(spark, sf):
    return live.tumbling(table(spark, sf, "events"), "ts", "1 hour", ["event_type"]).withColumn("total", F.round("total", 4))


@query("SELECT start, event_type, count(*) AS n FROM (SELECT event_type, unnest([time_bucket(INTERVAL 6 HOUR, ts), time_bucket(INTERVAL 6 HOUR, ts - INTERVAL 3 HOUR) + INTERVAL 3 HOUR]) AS start FROM events) GROUP BY ALL")
def events_sliding(spark, sf):
    return live.sliding(table(spark, sf, "events"), "ts", "6 hours", "3 hours", ["event_type"])


@query("""WITH g AS (SELECT user_id, ts, value, CASE WHEN ts >= lag(ts) OVER (PARTITION BY user_id ORDER BY ts, event_id) + INTERVAL 2 HOUR THEN 1 ELSE 0 END AS fresh, event_id FROM events),
s AS (SELECT user_id, ts, value, sum(fresh) OVER (PARTITION BY user_id ORDER BY ts, event_id) AS k FROM g) SELECT min(ts) AS start, user_id, count(*) AS n, round(sum(value), 4) AS total FROM s GROUP BY user_id, k""")
def events_session(spark, sf):
    return live.sessions(table(spark, sf, "events"), "ts", "2 hours", ["user_id"]).withColumn("total", F.round("total", 4))


@query("""SELECT k, min(event_id) AS seq, arg_min(event_type, event_id) AS source FROM (SELECT user_id || ':' || (json_extract(props, '$.k')::BIGINT // 4) AS k, event_id, event_type FROM events) GROUP BY k HAVING NOT bool_or(event_type = 'error')""")
def queue_fold_ack(spark, sf):
    """Items (a user and a range of k) waiting in the log; an error cancels the item for good."""
    item = F.concat_ws(":", "user_id", F.floor(F.get_json_object("props", "$.k").cast("bigint") / 4).cast("string"))
    log = table(spark, sf, "events").select(item.alias("k"), "event_id", "event_type", (F.col("event_type") == "error").alias("gone"))
    return live.folded_queue(log, "k", "event_id", "gone", "event_type")


@query("""SELECT e.event_id, e.user_id, (SELECT p.value FROM events p WHERE p.user_id = e.user_id AND p.event_type = 'purchase' AND p.ts <= e.ts ORDER BY p.ts DESC, p.event_id DESC LIMIT 1) AS value_known FROM events e WHERE e.event_type = 'click'""")
def as_of_join(spark, sf):
    events = table(spark, sf, "events")
    clicks = events.where("event_type = 'click'").select("event_id", "user_id", "ts")
    # Of purchases at one instant the greatest id counts.
    bought = events.where("event_type = 'purchase'").groupBy("user_id", "ts").agg(F.max_by("value", "event_id").alias("value"))
    return live.as_of(clicks, bought, "user_id", "ts", "value").select("event_id", "user_id", "value_known")


@query("""SELECT user_id, event_id, event_type FROM (SELECT *, row_number() OVER (PARTITION BY user_id ORDER BY event_id DESC) AS n FROM events) WHERE n = 1""")
def stream_upsert(spark, sf):
    """The events file as a stream, merged per micro-batch into a versioned table; its final state."""
    at = f"{shared_dir(spark)}/upsert-{uuid.uuid4().hex[:12]}"
    schema = table(spark, sf, "events").schema
    stream = spark.readStream.schema(schema).option("maxFilesPerTrigger", 1).option("pathGlobFilter", "*.parquet").parquet(f"{sf}/events.parquet*")
    target = live.VersionedTable(spark, f"{at}/state", "user_id BIGINT, event_id BIGINT, event_type STRING")
    live.merge_stream(stream.select("user_id", "event_id", "event_type"), target, "user_id", "event_id", f"{at}/checkpoint").awaitTermination()
    return target.read()


@query("""SELECT raw_id, trim(regexp_replace(title, '[ \\t\\n\\x0B\\f\\r]+', ' ', 'g')) AS title FROM raw_papers""")
def xml_titles(spark, sf):
    papers = table(spark, sf, "raw_papers")
    xml = F.concat(F.lit("<paper><title>"), F.regexp_replace(records.escaped(F.col("title")), "^(\\S+)", "<i>$1</i>"), F.lit("</title></paper>"))
    return papers.select("raw_id", records.xml_title(xml).alias("title"))


@query(r"""SELECT raw_id, regexp_replace(title, '\.+$', '') AS title, year, len(list_filter(authors, lambda a: a.name IS NOT NULL))::INT AS authors, array_to_string(list_transform(list_filter(authors, lambda a: a.name IS NOT NULL), lambda a: regexp_replace(a.name, '\s*\d{4}$', '')), '|') AS names FROM raw_papers WHERE len(authors) > 0""")
def dblp_json(spark, sf):
    """All papers written as search hits, whose one author is an object and not a list, and read again."""
    papers = table(spark, sf, "raw_papers").where("size(authors) > 0")
    authors = F.transform("authors", lambda a: F.struct(a["name"].alias("text")))
    hit = lambda author: F.to_json(F.struct(F.struct(F.col("raw_id").cast("string").alias("key"), F.concat("title", F.lit(".")).alias("title"), F.col("year").cast("string").alias("year"), F.struct(author.alias("author")).alias("authors")).alias("info")))
    raw = papers.select(F.when(F.size("authors") == 1, hit(F.element_at(authors, 1))).otherwise(hit(authors)).alias("hit"))
    hits = records.dblp_hits(raw, "hit")
    return hits.select(F.col("key").cast("bigint").alias("raw_id"), "title", "year", F.size("authors").alias("authors"), F.array_join("authors", "|").alias("names"))


@query()
def graphml_export(spark, sf):
    papers = table(spark, sf, "seed_papers").select(F.col("point_id").alias("id"), F.col("payload.title").alias("title"), F.col("payload.cited_by").alias("cited_by"))
    edges = papers.select(F.col("id").alias("dst"), F.explode("cited_by").alias("src")).where("src is not null")
    return sinks.graphml_lines(edges, papers.select("id", "title"), "id")


_FIRST = "f AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY openalex_id ORDER BY raw_id) AS n FROM raw_papers WHERE batch_no > 0 AND openalex_id IS NOT NULL) WHERE n = 1)"
_CORPUS = f"""{_FIRST}, c AS (SELECT p.raw_id, p.openalex_id, CASE WHEN coalesce(trim(p.abstract), '') = '' AND coalesce(trim(f.abstract), '') <> '' THEN f.abstract ELSE p.abstract END AS abstract, CASE WHEN coalesce(trim(p.doi), '') = '' AND coalesce(trim(f.doi), '') <> '' THEN f.doi ELSE p.doi END AS doi,
 concat_ws(',', CASE WHEN coalesce(trim(p.abstract), '') = '' AND coalesce(trim(f.abstract), '') <> '' THEN 'abstract' END, CASE WHEN coalesce(trim(p.doi), '') = '' AND coalesce(trim(f.doi), '') <> '' THEN 'doi' END) AS filled, false AS injected FROM raw_papers p LEFT JOIN f ON f.openalex_id = p.openalex_id WHERE p.batch_no = 0
 UNION ALL SELECT raw_id, openalex_id, abstract, doi, '', true FROM f WHERE openalex_id NOT IN (SELECT openalex_id FROM raw_papers WHERE batch_no = 0 AND openalex_id IS NOT NULL))"""


def _phased(spark, sf, corpus=None):  # noqa: ANN001, ANN202
    """The later batches as a stream of works, brought into a corpus (batch 0 unless another is given)."""
    papers = table(spark, sf, "raw_papers")
    made = phases.Phases(spark, f"{shared_dir(spark)}/phases-{uuid.uuid4().hex[:12]}")
    made.start(papers.where("batch_no = 0") if corpus is None else corpus)
    stream = spark.readStream.schema(papers.schema).option("pathGlobFilter", "*.parquet").parquet(f"{sf}/raw_papers.parquet*")
    made.run(stream.where("batch_no > 0").select("raw_id", "openalex_id", "abstract", "doi", "year", "citation_count", "referenced_works"))
    return made


_SERVED = "SELECT DISTINCT openalex_id, CAST(substr(openalex_id, 2) AS BIGINT) AS raw_id FROM paper_responses WHERE regexp_full_match(openalex_id, 'W[0-9]+')"


@query(f"WITH {_CORPUS} SELECT * FROM c")
def snapshot_corpus(spark, sf):
    """The corpus after the phases that fill fields and inject gaps."""
    return _phased(spark, sf).corpus.read()


@query(f"""WITH {_FIRST}, c AS ({_SERVED} UNION ALL SELECT openalex_id, raw_id FROM f WHERE openalex_id NOT IN (SELECT openalex_id FROM ({_SERVED}))), r AS (SELECT openalex_id AS citer, year, citation_count, unnest(referenced_works) AS w FROM raw_papers WHERE batch_no > 0 AND openalex_id IS NOT NULL),
m AS (SELECT c.raw_id, r.citer, max(r.year) AS year, max(r.citation_count) AS citations FROM r JOIN c ON c.openalex_id = r.w GROUP BY 1, 2)
SELECT raw_id, citer, year, citations FROM (SELECT *, row_number() OVER (PARTITION BY raw_id ORDER BY coalesce(year, 0) DESC, coalesce(citations, 0) DESC, citer) AS p FROM m) WHERE p <= {phases.CITERS_KEPT}""")
def snapshot_citers(spark, sf):
    """Which of the later works cite the records served, after the same phases."""
    served = table(spark, sf, "paper_responses").where(F.col("openalex_id").rlike("^W[0-9]+$")).select("openalex_id", F.expr("cast(substr(openalex_id, 2) as bigint)").alias("raw_id")).distinct()
    none = F.lit(None).cast("string")
    return _phased(spark, sf, served.select("raw_id", "openalex_id", none.alias("abstract"), none.alias("doi"))).citers.read()


@query("""WITH q AS (SELECT k, min(event_id) AS seq FROM (SELECT user_id || ':' || (json_extract(props, '$.k')::BIGINT // 4) AS k, event_id, event_type FROM events) GROUP BY k HAVING NOT bool_or(event_type = 'error'))
SELECT q.k, q.seq FROM q WHERE seq % 5 = 0 OR seq NOT IN (SELECT vec_id FROM embeddings)""")
def queue_drain(spark, sf):
    """What stays queued after a drain: items of low priority, and those whose record was not found."""
    waiting = queue_fold_ack(spark, sf).select("k", "seq")
    done = table(spark, sf, "embeddings").select(F.col("vec_id").alias("seq"))
    return waiting.where("seq % 5 = 0").unionByName(waiting.where("seq % 5 <> 0").join(done, "seq", "left_anti").select("k", "seq"))


@query("""SELECT raw_id, fetched_at FROM raw_papers WHERE fetched_at >= (SELECT max(fetched_at) FROM raw_papers) - INTERVAL 30 DAY""")
def fetched_since(spark, sf):
    """Rows of the last thirty days before the newest."""
    papers = table(spark, sf, "raw_papers").select("raw_id", "fetched_at")
    newest = papers.agg(F.max("fetched_at").alias("newest"))
    return papers.join(F.broadcast(newest)).where("fetched_at >= newest - interval 30 days").select("raw_id", "fetched_at")


@query("""SELECT source, count(*) AS taken, max(fetched_at) AS mark, max(batch_no) AS last_batch FROM raw_papers WHERE source IS NOT NULL GROUP BY source""")
def high_water_marks(spark, sf):
    """How far each source has been taken."""
    return table(spark, sf, "raw_papers").where("source is not null").groupBy("source").agg(F.count(F.lit(1)).alias("taken"), F.max("fetched_at").alias("mark"), F.max("batch_no").alias("last_batch"))


@query("""SELECT result_id FROM duplicate_results WHERE upper(trim(checked_id)) NOT IN (SELECT upper(trim(openalex_id)) FROM raw_papers WHERE trim(openalex_id) <> '') AND checked_id IS NOT NULL""")
def resume_unprocessed(spark, sf):
    """Rows whose id no earlier run has processed."""
    done = table(spark, sf, "raw_papers").where("trim(openalex_id) <> ''").select(F.upper(F.trim("openalex_id")).alias("k"))
    return table(spark, sf, "duplicate_results").where("checked_id is not null").select("result_id", F.upper(F.trim("checked_id")).alias("k")).join(done, "k", "left_anti").select("result_id")
