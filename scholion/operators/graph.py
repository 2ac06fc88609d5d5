"""Citation-graph operators over an edge table (src, dst)."""

from __future__ import annotations

from pyspark.sql import DataFrame, functions as F

from scholion.runtime import drop, materialize

DAMPING = 0.85


def simple_edges(edges: DataFrame) -> DataFrame:
    """Distinct edges with both ends, self-loops left out."""
    return edges.select("src", "dst").where("src is not null and dst is not null and src <> dst").distinct()


def nodes_of(edges: DataFrame) -> DataFrame:
    """Every end of an edge, targets that are no records included."""
    return edges.select(F.col("src").alias("node")).unionByName(edges.select(F.col("dst").alias("node"))).distinct()


def neighbourhood(edges: DataFrame, centers: DataFrame, hops: int) -> DataFrame:
    """(center, node, hop): nodes within ``hops`` steps of each center, edges taken both ways; hop is the least."""
    both = edges.select(F.col("src").alias("node"), F.col("dst").alias("next")).unionByName(edges.select(F.col("dst").alias("node"), F.col("src").alias("next"))).distinct()
    frontier = centers.select(F.col("node").alias("center"), "node").withColumn("hop", F.lit(0))
    seen = frontier
    for hop in range(1, hops + 1):
        reached = frontier.select("center", "node").join(both, "node").select("center", F.col("next").alias("node")).distinct()
        frontier = reached.join(seen.select("center", "node"), ["center", "node"], "left_anti").withColumn("hop", F.lit(hop))
        seen = seen.unionByName(frontier)
    return seen


def degrees(edges: DataFrame) -> DataFrame:
    """(node, in_degree, out_degree) by one aggregation over the ends."""
    ends = edges.select(F.col("src").alias("node"), F.lit(1).alias("o"), F.lit(0).alias("i")).unionByName(edges.select(F.col("dst").alias("node"), F.lit(0).alias("o"), F.lit(1).alias("i")))
    return ends.groupBy("node").agg(F.sum("i").alias("in_degree"), F.sum("o").alias("out_degree"))


def reciprocity(edges: DataFrame) -> DataFrame:
    """(edges, mutual, reciprocity): the share of edges that are returned."""
    turned = edges.groupBy(F.least("src", "dst").alias("a"), F.greatest("src", "dst").alias("b")).agg(F.count(F.lit(1)).alias("n"))
    sums = turned.agg(F.sum("n").alias("edges"), F.sum(F.when(F.col("n") == 2, 2).otherwise(0)).alias("mutual"))
    return sums.withColumn("reciprocity", F.round(F.col("mutual") / F.col("edges"), 6))


def triangles(edges: DataFrame) -> DataFrame:
    """(node, triangles) of the undirected graph.

    Edges are turned from the end of lower degree to the higher, which bounds the wedges
    of a hub by the square root of the number of edges.
    """
    links = edges.select(F.least("src", "dst").alias("a"), F.greatest("src", "dst").alias("b")).distinct()
    deg = links.select(F.explode(F.array("a", "b")).alias("node")).groupBy("node").agg(F.count(F.lit(1)).alias("d"))
    ranked = links.join(deg.select(F.col("node").alias("a"), F.col("d").alias("da")), "a").join(deg.select(F.col("node").alias("b"), F.col("d").alias("db")), "b")
    forward = (F.col("da") < F.col("db")) | ((F.col("da") == F.col("db")) & (F.col("a") < F.col("b")))
    turned = ranked.select(F.when(forward, F.col("a")).otherwise(F.col("b")).alias("x"), F.when(forward, F.col("b")).otherwise(F.col("a")).alias("y"))
    y, z = turned.select("x", "y"), turned.select("x", F.col("y").alias("z"))
    wedges = y.join(z, "x").where("y < z")
    closed = wedges.join(links.select(F.col("a").alias("y"), F.col("b").alias("z")), ["y", "z"])
    return closed.select(F.explode(F.array("x", "y", "z")).alias("node")).groupBy("node").agg(F.count(F.lit(1)).alias("triangles"))


def pagerank(edges: DataFrame, rounds: int = 20, damping: float = DAMPING, tolerance: float | None = None, cut: int = 2) -> DataFrame:
    """(node, pagerank), summing to one; the mass of nodes without outgoing edges is spread evenly.

    Runs ``rounds`` steps, or fewer once the total change falls below ``tolerance``
    times the number of nodes. Lineage is cut every
    other step, as each refers to the one before twice.
    """
    out = edges.groupBy("src").agg(F.count(F.lit(1)).alias("out"))
    links = materialize(edges.join(out, "src").select("src", "dst", "out"), "links")
    nodes = materialize(nodes_of(edges).join(out.select(F.col("src").alias("node"), F.lit(True).alias("gives")), "node", "left"), "nodes")
    n = nodes.count()
    if n == 0:
        return nodes.select("node", F.lit(0.0).alias("pagerank"))
    ranks = nodes.select("node", "gives", F.lit(1.0 / n).alias("r"))
    held = None
    for k in range(1, rounds + 1):
        passed = links.join(ranks.select(F.col("node").alias("src"), "r"), "src").groupBy(F.col("dst").alias("node")).agg(F.sum(F.col("r") / F.col("out")).alias("got"))
        # The dangling mass is one row; a scalar joined to all.
        dangling = ranks.agg(F.coalesce(F.sum(F.when(F.col("gives").isNull(), F.col("r"))), F.lit(0.0)).alias("lost"))
        new = nodes.join(passed, "node", "left").join(F.broadcast(dangling)).select("node", "gives", (F.lit((1 - damping) / n) + damping * (F.coalesce("got", F.lit(0.0)) + F.col("lost") / n)).alias("r"))
        if tolerance is not None or k % cut == 0:
            new = materialize(new, "ranks")
            if tolerance is not None:
                change = new.join(ranks.select("node", F.col("r").alias("was")), "node").agg(F.sum(F.abs(F.col("r") - F.col("was")))).first()[0]
                if change < n * tolerance:
                    return new.select("node", F.col("r").alias("pagerank"))
            if held is not None:
                drop(held)
            held = new
        ranks = new
    return ranks.select("node", F.col("r").alias("pagerank"))


def hits(edges: DataFrame, rounds: int = 10, cut: int = 4) -> DataFrame:
    """(node, hub, authority), each summing to one.

    Only directions matter between rounds, so scores are scaled where lineage is cut
    and at the end.
    """
    nodes = nodes_of(edges)
    links = materialize(edges, "links")
    scaled = lambda frame, c: frame.join(F.broadcast(frame.agg(F.sum(c).alias("s")))).select("node", (F.col(c) / F.col("s")).alias(c))
    hubs, auths = nodes.select("node", F.lit(1.0).alias("h")), nodes.select("node", F.lit(0.0).alias("a")).limit(0)
    for k in range(1, rounds + 1):
        auths = links.join(hubs.select(F.col("node").alias("src"), "h"), "src").groupBy(F.col("dst").alias("node")).agg(F.sum("h").alias("a"))
        if k == rounds or k % cut == 0:
            auths = materialize(auths, "auths")
        hubs = links.join(auths.select(F.col("node").alias("dst"), "a"), "dst").groupBy(F.col("src").alias("node")).agg(F.sum("a").alias("h"))
        if k == rounds or k % cut == 0:
            hubs = scaled(materialize(hubs, "hubs"), "h")
    auths = scaled(auths, "a")
    return nodes.join(hubs, "node", "left").join(auths, "node", "left").select("node", F.coalesce("h", F.lit(0.0)).alias("hub"), F.coalesce("a", F.lit(0.0)).alias("authority"))


def weak_components(edges: DataFrame, max_rounds: int = 100) -> DataFrame:
    """(node, component): the least node reachable, by label propagation with pointer jumping."""
    both = materialize(edges.select("src", "dst").unionByName(edges.select(F.col("dst").alias("src"), F.col("src").alias("dst"))).distinct(), "both")
    labels = materialize(both.groupBy(F.col("src").alias("node")).agg(F.least(F.col("node"), F.min("dst")).alias("c")), "labels")
    for _ in range(max_rounds):
        heard = both.join(labels.select(F.col("node").alias("src"), "c"), "src").groupBy(F.col("dst").alias("node")).agg(F.min("c").alias("h"))
        least = labels.join(heard, "node").select("node", F.col("c").alias("was"), F.least("c", "h").alias("c"))
        jump = least.select(F.col("node").alias("c"), F.col("c").alias("j"))
        new = materialize(least.join(jump, "c").select("node", "was", F.least("c", "j").alias("c")), "labels")
        moved = new.where("c <> was").limit(1).count()
        drop(labels)
        labels = new.select("node", "c")
        if not moved:
            return labels.select("node", F.col("c").alias("component"))
    raise RuntimeError("components did not settle")


def local_clustering(edges: DataFrame) -> DataFrame:
    """(node, degree, clustering) of the undirected graph: closed pairs of neighbours over all pairs; 0 below two neighbours."""
    links = edges.select(F.least("src", "dst").alias("a"), F.greatest("src", "dst").alias("b")).distinct()
    deg = links.select(F.explode(F.array("a", "b")).alias("node")).groupBy("node").agg(F.count(F.lit(1)).alias("degree"))
    pairs = F.col("degree") * (F.col("degree") - 1)
    return deg.join(triangles(edges), "node", "left").select("node", "degree", F.when(pairs > 0, 2 * F.coalesce("triangles", F.lit(0)) / pairs).otherwise(0.0).alias("clustering"))


def subgraph(edges: DataFrame, centers: DataFrame, hops: int, direction: str = "both") -> tuple[DataFrame, DataFrame]:
    """Nodes (center, node, hop, is_center) within ``hops`` steps and the edges (center, src, dst) among them.

    ``direction`` is ``cited`` (along the edges), ``citing`` (against them) or ``both``.
    The visited nodes are written after every hop, so that no hop computes those before it again.
    """
    ways = {"cited": [("src", "dst")], "citing": [("dst", "src")], "both": [("src", "dst"), ("dst", "src")]}[direction]
    steps = edges.select(F.col(ways[0][0]).alias("node"), F.col(ways[0][1]).alias("next"))
    for a, b in ways[1:]:
        steps = steps.unionByName(edges.select(F.col(a).alias("node"), F.col(b).alias("next")))
    steps = steps.distinct()
    seen = centers.select(F.col("node").alias("center"), "node").withColumn("hop", F.lit(0))
    for hop in range(1, hops + 1):
        reached = seen.where(F.col("hop") == hop - 1).join(steps, "node").select("center", F.col("next").alias("node")).distinct()
        fresh = reached.join(seen.select("center", "node"), ["center", "node"], "left_anti").withColumn("hop", F.lit(hop))
        seen = materialize(seen.unionByName(fresh), "visited")
    ends = seen.select("center", "node")
    inner = edges.join(ends.withColumnRenamed("node", "src"), "src").join(ends.withColumnRenamed("node", "dst"), ["center", "dst"]).select("center", "src", "dst")
    return seen.withColumn("is_center", F.col("center") == F.col("node")), inner


def modularity(weights: DataFrame, labels: DataFrame) -> float:
    """Of a partition (node, c) of an undirected graph given as (u, v, w), once in either direction."""
    whole = weights.agg(F.sum("w")).first()[0] or 0.0
    if not whole:
        return 0.0
    of = lambda k, c: labels.select(F.col("node").alias(k), F.col("c").alias(c))
    inner = weights.join(of("u", "cu"), "u").join(of("v", "cv"), "v").where("cu = cv").agg(F.sum("w")).first()[0] or 0.0
    share = F.sum("w") / whole
    outer = weights.join(of("u", "c"), "u").groupBy("c").agg(share.alias("s")).agg(F.sum(F.col("s") * F.col("s"))).first()[0]
    return inner / whole - outer


def communities(edges: DataFrame, levels: int = 3, rounds: int = 5) -> DataFrame:
    """(node, community) by modularity: nodes move to the neighbouring community of greatest gain until none gains, then
    communities become the nodes of a smaller graph, and so on (Louvain's method, with half of the nodes moving at a time
    so that neighbours do not swap, other halves each round). The community is its least node. A level ends when two rounds
    do not raise the modularity, the whole when a level does not."""
    both = edges.select(F.col("src").alias("u"), F.col("dst").alias("v")).unionByName(edges.select(F.col("dst").alias("u"), F.col("src").alias("v"))).where("u <> v").distinct()
    weights = materialize(both.withColumn("w", F.lit(1.0)), "weights")
    homes = materialize(weights.select(F.col("u").alias("node")).distinct().withColumn("c", F.col("node")), "homes")
    whole = weights.agg(F.sum("w")).first()[0]
    for _ in range(levels if whole else 0):
        strength = weights.groupBy(F.col("u").alias("node")).agg(F.sum("w").alias("k"))
        labels = materialize(strength.select("node", "k", F.col("node").alias("c")), "labels")
        start = best = modularity(weights, labels)
        held, idle = labels, 0
        for turn in range(2 * rounds):
            ties = weights.where("u <> v").join(labels.select(F.col("node").alias("v"), "c"), "v").groupBy(F.col("u").alias("node"), "c").agg(F.sum("w").alias("t"))
            totals = labels.groupBy("c").agg(F.sum("k").alias("total"))
            own = labels.select("node", "k", F.col("c").alias("home"))
            options = own.join(ties, "node").unionByName(own.select("node", "k", "home", F.col("home").alias("c"), F.lit(0.0).alias("t")))
            options = options.groupBy("node", "k", "home", "c").agg(F.max("t").alias("t")).join(totals, "c")
            gain = F.col("t") - F.col("k") * (F.col("total") - F.when(F.col("c") == F.col("home"), F.col("k")).otherwise(0.0)) / whole
            # Of equal gains the home stays, else the least community.
            scored = options.select("node", "k", "home", "c", F.round(gain, 9).alias("g"))
            top = scored.groupBy("node", "k", "home").agg(F.max("g").alias("g"), F.max(F.when(F.col("c") == F.col("home"), F.col("g"))).alias("stay"))
            target = scored.join(top.select("node", "g"), ["node", "g"]).groupBy("node").agg(F.min("c").alias("to"))
            moves = (F.col("g") > F.col("stay")) & (F.pmod(F.xxhash64("node", F.lit(turn // 2)), F.lit(2)) == turn % 2)
            new = materialize(top.join(target, "node").select("node", "k", F.when(moves, F.col("to")).otherwise(F.col("home")).alias("c")), "labels")
            if labels is not held:
                drop(labels)
            labels = new
            if turn % 2:
                # Both halves have moved; what raised the modularity most is kept.
                now = modularity(weights, labels)
                if now > best + 1e-6:
                    drop(held)
                    held, best, idle = labels, now, 0
                else:
                    idle += 1
                    if idle == 2:
                        break
        labels = held
        least = labels.groupBy("c").agg(F.min("node").alias("name"))
        named = materialize(labels.join(least, "c").select("node", F.col("name").alias("c")), "named")
        homes = materialize(homes.join(named.select(F.col("node").alias("c"), F.col("c").alias("to")), "c").select("node", F.col("to").alias("c")), "homes")
        if best <= start + 1e-6:
            break
        of = lambda k: named.select(F.col("node").alias(k), F.col("c").alias(f"c{k}"))
        weights = materialize(weights.join(of("u"), "u").join(of("v"), "v").groupBy(F.col("cu").alias("u"), F.col("cv").alias("v")).agg(F.sum("w").alias("w")), "weights")
    return homes.select("node", F.col("c").alias("community"))
