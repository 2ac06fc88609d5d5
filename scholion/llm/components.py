"""Consolidating pairwise matches into groups: alternating large-star and small-star.

Every round rewrites the edge list by two distributed joins until it no longer
changes; each record then hangs directly on the least identifier of its component.
Before the first round every task replaces its own edges by stars, which connect the
same records with fewer edges; chains within a task need no rounds then.
A group of any size is only ever aggregated (partially, before the shuffle) or
joined; adaptive execution splits a key whose rows outgrow a partition.
"""

from __future__ import annotations

from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, functions as F

from scholion.runtime import drop, materialize


#: Edges that a task contracts at a time.
CONTRACTED = 200_000


def contracted(edges: DataFrame) -> DataFrame:
    """Stars (u, v), u > v, that connect what the edges of each task connect, in blocks of bounded size."""
    kind = dict(edges.dtypes)["u"]

    def stars(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        parent: dict = {}

        def find(x):  # noqa: ANN001, ANN202
            root = x
            while (up := parent.get(root, root)) != root:
                root = up
            while (up := parent.get(x, x)) != root:
                parent[x], x = root, up
            return root

        def settled(schema: pa.Schema) -> pa.RecordBatch:
            moved = [x for x in parent if find(x) != x]
            out = pa.RecordBatch.from_arrays([pa.array(moved, schema.types[0]), pa.array([find(x) for x in moved], schema.types[1])], names=["u", "v"])
            parent.clear()
            return out

        schema = None
        for batch in batches:
            schema = batch.schema
            for u, v in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()):
                a, b = find(u), find(v)
                if a != b:
                    parent[max(a, b)] = min(a, b)
            if len(parent) > CONTRACTED:
                yield settled(schema)
        if parent:
            yield settled(schema)

    return edges.mapInArrow(stars, f"u {kind}, v {kind}")


def _minima(edges: DataFrame) -> DataFrame:
    return edges.groupBy("u").agg(F.min("v").alias("m"))


def large_star(edges: DataFrame) -> DataFrame:
    """Link each neighbour greater than a node to the least of the node and its neighbours.

    ``edges`` has u > v, so every edge is looked at from both ends.
    """
    both = edges.unionByName(edges.select(F.col("v").alias("u"), F.col("u").alias("v")))
    least = _minima(both).withColumn("m", F.least("u", "m"))
    upward = both.where(F.col("v") > F.col("u"))
    return upward.join(least, "u").select(F.col("v").alias("u"), F.col("m").alias("v")).where("u <> v").distinct()


def small_star(edges: DataFrame) -> DataFrame:
    """Link a node and its lesser neighbours to the least of them (``edges`` has u > v)."""
    least = _minima(edges)
    moved = edges.join(least, "u").where("v <> m").select(F.col("v").alias("u"), F.col("m").alias("v"))
    return moved.unionByName(least.select("u", F.col("m").alias("v"))).distinct()


def _state(edges: DataFrame) -> tuple:
    row = edges.agg(F.count(F.lit(1)).alias("n"), F.bit_xor(F.xxhash64("u", "v")).alias("x")).first()
    return row["n"], row["x"]


def connected_components(edges: DataFrame, left: str = "src", right: str = "dst", max_rounds: int = 60) -> DataFrame:
    """(node, component) for every node of an edge with two different ends.

    The component is the least node of the group. Null ends and self-links are no
    edges; repeated and reversed edges count once; an empty table gives an empty one.
    Works for any orderable type. Raises if ``max_rounds`` do not suffice (rounds grow
    with the logarithm of the longest chain, so 60 cover any real input).
    """
    pairs = edges.select(F.col(left).alias("a"), F.col(right).alias("b")).where("a is not null and b is not null and a <> b")
    current = materialize(contracted(pairs.select(F.greatest("a", "b").alias("u"), F.least("a", "b").alias("v"))).distinct(), "edges")
    before = _state(current)
    for _ in range(max_rounds):
        if before[0] == 0:
            break
        starred = materialize(small_star(large_star(current)), "edges")
        after = _state(starred)
        drop(current)
        current = starred
        if after == before:
            break
        before = after
    else:
        raise RuntimeError("components did not settle")
    ends = current.select(F.col("u").alias("node"), F.col("v").alias("component"))
    return ends.unionByName(ends.select(F.col("component").alias("node"), "component").distinct())
