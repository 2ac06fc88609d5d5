"""Citation-graph queries over the resolved references of paper_responses."""

from __future__ import annotations

from pyspark.sql import DataFrame, functions as F

from scholion.operators import graph as G
from scholion.operators.orphans import record_key
from scholion.plans.orphans import _record
from scholion.runtime import materialize, table

QUERIES: dict = {}
SQL: dict[str, str] = {}
ROUNDS = 6


def query(sql: str | None = None):  # noqa: ANN201
    """Register a query under its function's name, with the SQL it must agree with."""

    def register(function):  # noqa: ANN001, ANN202
        QUERIES[function.__name__] = function
        if sql:
            SQL[function.__name__] = sql
        return function

    return register


def edges(spark, sf) -> DataFrame:  # noqa: ANN001
    refs = table(spark, sf, "paper_responses").select(F.col("id").alias("src"), F.explode("resolved_references").alias("r"))
    return G.simple_edges(refs.select("src", record_key(F.col("r")).alias("dst")))


_E = f"e AS MATERIALIZED (SELECT DISTINCT src, dst FROM (SELECT id AS src, {_record('ref')} AS dst FROM (SELECT id, unnest(resolved_references) AS ref FROM paper_responses)) WHERE dst IS NOT NULL AND src <> dst)"
_N = "n AS (SELECT src AS node FROM e UNION SELECT dst FROM e)"


@query(f"WITH {_E} SELECT dst, count(*) AS citers, string_agg(src, '|' ORDER BY src) AS cited_by FROM e GROUP BY dst")
def reverse_index(spark, sf):
    return edges(spark, sf).groupBy("dst").agg(F.count(F.lit(1)).alias("citers"), F.array_join(F.array_sort(F.collect_list("src")), "|").alias("cited_by"))


@query(f"WITH {_E} SELECT p.id, coalesce(count(e.src), 0) AS citations FROM (SELECT DISTINCT id FROM paper_responses) p LEFT JOIN e ON e.dst = p.id GROUP BY p.id")
def cited_by_full(spark, sf):
    papers = table(spark, sf, "paper_responses").select("id").distinct()
    counts = edges(spark, sf).groupBy(F.col("dst").alias("id")).agg(F.count(F.lit(1)).alias("c"))
    return papers.join(counts, "id", "left").select("id", F.coalesce("c", F.lit(0)).alias("citations"))


@query(f"""WITH {_E}, cur AS (SELECT id, {_record('c')} AS c FROM (SELECT DISTINCT id, unnest(cited_by) AS c FROM paper_responses)), fresh AS (SELECT e.dst AS id, e.src AS c FROM e WHERE e.dst IN (SELECT id FROM paper_responses) EXCEPT SELECT id, c FROM cur)
SELECT id, count(*) AS new_citers FROM fresh GROUP BY id""")
def cited_by_incremental(spark, sf):
    papers = table(spark, sf, "paper_responses")
    known = papers.select("id", F.explode("cited_by").alias("c")).select("id", record_key(F.col("c")).alias("c")).distinct()
    fresh = edges(spark, sf).select(F.col("dst").alias("id"), F.col("src").alias("c")).join(papers.select("id").distinct(), "id", "left_semi").join(known, ["id", "c"], "left_anti")
    return fresh.groupBy("id").agg(F.count(F.lit(1)).alias("new_citers"))


@query(f"WITH {_E}, {_N} SELECT node, (SELECT count(*) FROM e WHERE dst = node) AS in_degree, (SELECT count(*) FROM e WHERE src = node) AS out_degree FROM n")
def degree_stats(spark, sf):
    return G.degrees(edges(spark, sf))


@query(f"WITH {_E} SELECT count(*) AS edges, count(*) FILTER (EXISTS (SELECT 1 FROM e b WHERE b.src = e.dst AND b.dst = e.src)) AS mutual, round(count(*) FILTER (EXISTS (SELECT 1 FROM e b WHERE b.src = e.dst AND b.dst = e.src)) * 1.0 / count(*), 6)::DOUBLE AS reciprocity FROM e")
def reciprocity(spark, sf):
    return G.reciprocity(edges(spark, sf))


@query(f"WITH {_E}, {_N}, c AS (SELECT (SELECT count(*) FROM e) AS edges, (SELECT count(*) FROM n) AS nodes) SELECT nodes, edges, round(edges * 1.0 / (nodes * (nodes - 1)), 9)::DOUBLE AS density FROM c")
def graph_density(spark, sf):
    e = edges(spark, sf)
    counts = G.nodes_of(e).agg(F.count(F.lit(1)).alias("nodes")).join(F.broadcast(e.agg(F.count(F.lit(1)).alias("edges"))))
    return counts.withColumn("density", F.round(F.col("edges") / (F.col("nodes") * (F.col("nodes") - 1)), 9))


@query(f"""WITH {_E}, u AS MATERIALIZED (SELECT DISTINCT least(src, dst) AS a, greatest(src, dst) AS b FROM e), t AS (SELECT x.a AS p, x.b AS q, y.b AS r FROM u x JOIN u y ON x.b = y.a JOIN u z ON z.a = x.a AND z.b = y.b)
SELECT node, count(*) AS triangles FROM (SELECT p AS node FROM t UNION ALL SELECT q FROM t UNION ALL SELECT r FROM t) GROUP BY node""")
def triangles(spark, sf):
    return G.triangles(edges(spark, sf))


_BFS = f"""WITH {_E}, b AS MATERIALIZED (SELECT src AS x, dst AS y FROM e UNION SELECT dst, src FROM e), c AS (SELECT dst AS center FROM e GROUP BY dst ORDER BY count(*) DESC, dst LIMIT 20),
h1 AS MATERIALIZED (SELECT DISTINCT center, y AS node FROM c JOIN b ON x = center), h2 AS (SELECT DISTINCT center, y AS node FROM h1 JOIN b ON x = node)
SELECT center, node, min(hop)::INT AS hop FROM (SELECT center, center AS node, 0 AS hop FROM c UNION ALL SELECT center, node, 1 FROM h1 UNION ALL SELECT center, node, 2 FROM h2) GROUP BY 1, 2"""


@query(_BFS)
def bfs_2hop(spark, sf):
    e = edges(spark, sf)
    centers = e.groupBy(F.col("dst").alias("node")).agg(F.count(F.lit(1)).alias("n")).orderBy(F.col("n").desc(), "node").limit(20).select("node")
    return G.neighbourhood(e, centers, 2)


@query(f"""WITH {_E}, k AS (SELECT DISTINCT id FROM paper_responses WHERE year >= 2015 AND deleted_at IS NULL) SELECT src, dst FROM e WHERE src IN (SELECT id FROM k) AND dst IN (SELECT id FROM k)""")
def graph_filter(spark, sf):
    kept = table(spark, sf, "paper_responses").where("year >= 2015 and deleted_at is null").select("id").distinct()
    half = edges(spark, sf).join(kept.select(F.col("id").alias("src")), "src", "left_semi")
    return half.join(kept.select(F.col("id").alias("dst")), "dst", "left_semi")


def _pagerank_sql(rounds: int) -> str:
    steps = [f"WITH {_E}, {_N}, o AS (SELECT src, count(*) AS d FROM e GROUP BY src), c AS (SELECT count(*)::DOUBLE AS k FROM n), r0 AS MATERIALIZED (SELECT node, 1.0 / k AS r FROM n, c)"]
    for i in range(1, rounds + 1):
        steps.append(
            f"g{i} AS (SELECT e.dst AS node, sum(r / d) AS got FROM e JOIN o ON e.src = o.src JOIN r{i - 1} p ON p.node = e.src GROUP BY e.dst), l{i} AS (SELECT coalesce(sum(r), 0) AS lost FROM r{i - 1} WHERE node NOT IN (SELECT src FROM o)), "
            f"r{i} AS MATERIALIZED (SELECT n.node, 0.15 / k + 0.85 * (coalesce(got, 0) + lost / k) AS r FROM n LEFT JOIN g{i} ON n.node = g{i}.node, l{i}, c)"
        )
    return ", ".join(steps) + f" SELECT node, round(r, 9)::DOUBLE AS pagerank FROM r{rounds}"


@query(_pagerank_sql(ROUNDS))
def pagerank_fixed_rounds(spark, sf):
    return G.pagerank(edges(spark, sf), rounds=ROUNDS).select("node", F.round("pagerank", 9).alias("pagerank"))


@query()
def pagerank_converged(spark, sf):
    return G.pagerank(edges(spark, sf), rounds=100, tolerance=1e-6)


def _hits_sql(rounds: int) -> str:
    steps = [f"WITH {_E}, {_N}, h0 AS (SELECT node, 1.0::DOUBLE AS h FROM n)"]
    for i in range(1, rounds + 1):
        steps.append(
            f"x{i} AS (SELECT dst AS node, sum(h) AS a FROM e JOIN h{i - 1} p ON p.node = e.src GROUP BY dst), a{i} AS MATERIALIZED (SELECT node, a / (SELECT sum(a) FROM x{i}) AS a FROM x{i}), "
            f"y{i} AS (SELECT src AS node, sum(a) AS h FROM e JOIN a{i} p ON p.node = e.dst GROUP BY src), h{i} AS MATERIALIZED (SELECT node, h / (SELECT sum(h) FROM y{i}) AS h FROM y{i})"
        )
    return ", ".join(steps) + f" SELECT n.node, round(coalesce(h, 0), 9)::DOUBLE AS hub, round(coalesce(a, 0), 9)::DOUBLE AS authority FROM n LEFT JOIN h{rounds} h ON h.node = n.node LEFT JOIN a{rounds} a ON a.node = n.node"


@query(_hits_sql(5))
def hits_fixed_rounds(spark, sf):
    found = G.hits(edges(spark, sf), rounds=5)
    return found.select("node", F.round("hub", 9).alias("hub"), F.round("authority", 9).alias("authority"))


@query(f"""WITH RECURSIVE {_E}, u AS MATERIALIZED (SELECT src AS a, dst AS b FROM e UNION SELECT dst, src FROM e), r AS (SELECT DISTINCT a AS node, a AS seen FROM u UNION SELECT r.node, u.b FROM r JOIN u ON r.seen = u.a) SELECT node, min(seen) AS component FROM r GROUP BY node""")
def weak_components(spark, sf):
    return G.weak_components(edges(spark, sf))


@query()
def communities(spark, sf):
    return G.communities(edges(spark, sf))


@query(f"WITH {_E}, d AS (SELECT dst AS node, count(*) AS citations FROM e GROUP BY dst) SELECT node, citations FROM d ORDER BY citations DESC, node LIMIT 20")
def top_papers(spark, sf):
    return G.degrees(edges(spark, sf)).select("node", F.col("in_degree").alias("citations")).orderBy(F.col("citations").desc(), "node").limit(20)


@query(f"""WITH {_E}, k AS (SELECT e.src, e.dst, row_number() OVER (PARTITION BY e.dst ORDER BY e.src)::INT AS place FROM e) SELECT dst, src, place FROM k WHERE place <= 3""")
def first_citers(spark, sf):
    from pyspark.sql import Window as W

    place = F.row_number().over(W.partitionBy("dst").orderBy("src"))
    return edges(spark, sf).select("dst", "src", place.alias("place")).where("place <= 3")


_U = "u AS MATERIALIZED (SELECT DISTINCT least(src, dst) AS a, greatest(src, dst) AS b FROM e)"
_CLUSTERING = f"""{_U}, d AS (SELECT node, count(*) AS degree FROM (SELECT a AS node FROM u UNION ALL SELECT b FROM u) GROUP BY node), t AS (SELECT x.a AS p, x.b AS q, y.b AS r FROM u x JOIN u y ON x.b = y.a JOIN u z ON z.a = x.a AND z.b = y.b),
k AS (SELECT node, count(*) AS n FROM (SELECT p AS node FROM t UNION ALL SELECT q FROM t UNION ALL SELECT r FROM t) GROUP BY node), l AS (SELECT d.node, degree, CASE WHEN degree > 1 THEN 2.0 * coalesce(n, 0) / (degree * (degree - 1)) ELSE 0.0 END AS clustering FROM d LEFT JOIN k ON k.node = d.node)"""


@query(f"WITH {_E}, {_CLUSTERING} SELECT node, degree, round(clustering, 9)::DOUBLE AS clustering FROM l")
def local_clustering(spark, sf):
    return G.local_clustering(edges(spark, sf)).withColumn("clustering", F.round("clustering", 9))


@query(f"""WITH {_E}, {_N}, {_CLUSTERING}, o AS (SELECT src AS node, count(*) AS o FROM e GROUP BY src), i AS (SELECT dst AS node, count(*) AS i FROM e GROUP BY dst)
SELECT (SELECT count(*) FROM n) AS nodes, (SELECT count(*) FROM e) AS edges, round((SELECT count(*) FROM e) * 1.0 / (SELECT count(*) FROM n), 6)::DOUBLE AS mean_degree, (SELECT max(i) FROM i) AS most_cited, (SELECT max(o) FROM o) AS most_citing, (SELECT round(avg(clustering), 6) FROM l)::DOUBLE AS mean_clustering""")
def global_metrics(spark, sf):
    """Size, degrees and mean clustering of the whole graph."""
    e = edges(spark, sf)
    d = G.degrees(e).agg(F.count(F.lit(1)).alias("nodes"), F.sum("out_degree").alias("edges"), F.max("in_degree").alias("most_cited"), F.max("out_degree").alias("most_citing"))
    c = G.local_clustering(e).agg(F.round(F.avg("clustering"), 6).alias("mean_clustering"))
    return d.join(F.broadcast(c)).select("nodes", "edges", F.round(F.col("edges") / F.col("nodes"), 6).alias("mean_degree"), "most_cited", "most_citing", "mean_clustering")


_CENTERS = "c AS (SELECT dst AS center FROM e GROUP BY dst ORDER BY count(*) DESC, dst LIMIT 5)"


def _directed_sql(a: str, b: str) -> str:
    return f"""WITH {_E}, {_CENTERS}, h1 AS MATERIALIZED (SELECT DISTINCT center, {b} AS node FROM c JOIN e ON {a} = center), h2 AS (SELECT DISTINCT center, {b} AS node FROM h1 JOIN e ON {a} = node),
v AS MATERIALIZED (SELECT center, node, min(hop) AS hop FROM (SELECT center, center AS node, 0 AS hop FROM c UNION ALL SELECT center, node, 1 FROM h1 UNION ALL SELECT center, node, 2 FROM h2) GROUP BY 1, 2)"""


def _centers(e: DataFrame) -> DataFrame:
    return e.groupBy(F.col("dst").alias("node")).agg(F.count(F.lit(1)).alias("n")).orderBy(F.col("n").desc(), "node").limit(5).select("node")


@query(_directed_sql("dst", "src") + " SELECT center, node, hop::INT AS hop, center = node AS is_center FROM v")
def citing_subgraph(spark, sf):
    """Who cites the five most cited within two steps."""
    e = edges(spark, sf)
    return G.subgraph(e, _centers(e), 2, "citing")[0]


@query(_directed_sql("src", "dst") + " SELECT v.center, e.src, e.dst FROM v JOIN e ON e.src = v.node JOIN v w ON w.center = v.center AND w.node = e.dst")
def cited_subgraph_edges(spark, sf):
    """All citations among what the five most cited cite within two steps."""
    e = edges(spark, sf)
    return G.subgraph(e, _centers(e), 2, "cited")[1]


@query(_directed_sql("dst", "src") + ", s AS (SELECT v.center, count(*) AS edges FROM v JOIN e ON e.src = v.node JOIN v w ON w.center = v.center AND w.node = e.dst GROUP BY 1) SELECT center, count(*) AS nodes, coalesce(any_value(s.edges), 0) AS edges, CASE WHEN count(*) > 1 THEN round(coalesce(any_value(s.edges), 0) * 1.0 / (count(*) * (count(*) - 1)), 6) ELSE 0.0 END::DOUBLE AS density FROM v LEFT JOIN s USING (center) GROUP BY center")
def subgraph_density(spark, sf):
    """Nodes, edges and density of the same subgraphs."""
    e = edges(spark, sf)
    nodes, inner = G.subgraph(e, _centers(e), 2, "citing")
    counts = nodes.groupBy("center").agg(F.count(F.lit(1)).alias("nodes")).join(inner.groupBy("center").agg(F.count(F.lit(1)).alias("edges")), "center", "left").fillna(0, ["edges"])
    return counts.withColumn("density", F.when(F.col("nodes") > 1, F.round(F.col("edges") / (F.col("nodes") * (F.col("nodes") - 1)), 6)).otherwise(0.0))


@query(f"WITH {_E}, {_N}, d AS (SELECT node, (SELECT count(*) FROM e WHERE dst = node) AS i, (SELECT count(*) FROM e WHERE src = node) AS o FROM n), m AS (SELECT 'in_degree' AS metric, node, i AS value FROM d UNION ALL SELECT 'out_degree', node, o FROM d) SELECT metric, node, value, place FROM (SELECT *, row_number() OVER (PARTITION BY metric ORDER BY value DESC, node)::INT AS place FROM m) WHERE place <= 10")
def top_by_metric(spark, sf):
    """The ten foremost nodes by each degree."""
    from pyspark.sql import Window as W

    listed = G.degrees(edges(spark, sf)).select("node", F.explode(F.array(*[F.struct(F.lit(m).alias("metric"), F.col(m).alias("value")) for m in ("in_degree", "out_degree")])).alias("x")).select("x.metric", "node", "x.value")
    place = F.row_number().over(W.partitionBy("metric").orderBy(F.col("value").desc(), "node"))
    return listed.withColumn("place", place).where("place <= 10")


@query()
def metrics_stored(spark, sf):
    """Records with their rank, hub, authority and community; nodes that are no records drop out, records outside the graph have none."""
    e = materialize(edges(spark, sf), "edges")
    papers = table(spark, sf, "paper_responses").select(F.col("id").alias("node")).distinct()
    return papers.join(G.pagerank(e, rounds=ROUNDS), "node", "left").join(G.hits(e, rounds=5), "node", "left").join(G.communities(e), "node", "left")


@query("SELECT count(*) AS papers, sum(coalesce(len(resolved_references), 0))::BIGINT AS edges, round((count(*) * 200.0 + sum(coalesce(len(resolved_references), 0)) * 16.0) / 1048576, 3)::DOUBLE AS mb FROM paper_responses")
def graph_memory_estimate(spark, sf):
    """What the graph would take in memory at 200 bytes a node and 16 an edge."""
    n = F.when(F.col("resolved_references").isNotNull(), F.size("resolved_references")).otherwise(0)
    sums = table(spark, sf, "paper_responses").agg(F.count(F.lit(1)).alias("papers"), F.sum(n).alias("edges"))
    return sums.withColumn("mb", F.round((F.col("papers") * 200.0 + F.col("edges") * 16.0) / 1048576, 3))
