"""Connected components of an edge table, by rounds of star contraction."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tidemark.llm.storage import Scratch


def _local(edges: DataFrame) -> DataFrame:
    """Edges (u, v), v the least node, that connect what the edges of a task connect: one a node at most."""

    def contract(batches):
        import pyarrow as pa

        up: dict[int, int] = {}

        def root(x: int) -> int:
            top = x
            while (y := up.setdefault(top, top)) != top:
                top = y
            while up[x] != top:
                up[x], x = top, up[x]
            return top

        for b in batches:
            for u, v in zip(b.column("u").to_pylist(), b.column("v").to_pylist(), strict=True):
                p, q = root(u), root(v)
                up[max(p, q)] = min(p, q)
        rows = [(x, r) for x in up if (r := root(x)) != x]
        yield pa.RecordBatch.from_arrays([pa.array(c, pa.int64()) for c in (zip(*rows, strict=True) if rows else ([], []))], ["u", "v"])

    return edges.select("u", "v").mapInArrow(contract, "u long, v long")


def connected_components(edges: DataFrame, space: Scratch, max_rounds: int = 60) -> DataFrame:
    """``edges`` (u, v) of long ids to (node, component): the least id each node reaches.

    Each task first contracts its own edges. Then large-star and small-star
    operations alternate; every round is written to the shared folder, so a lost
    executor never replays more than one round. Each join is on a node with its
    pre-aggregated minimum, so a hub is split by adaptive skew handling and never
    gathered. Nodes without edges to others are absent.
    """
    total = lambda d: tuple(d.agg(F.count("*"), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)"))).first())
    edges = space.keep(_local(edges.where("u <> v")).distinct(), "edges")
    was = total(edges)
    for _ in range(max_rounds):
        # Large star: every larger neighbour of a node points at the node's minimum.
        both = edges.unionByName(edges.select(F.col("v").alias("u"), F.col("u").alias("v")))
        least = both.groupBy("u").agg(F.min("v").alias("m")).select("u", F.least("u", "m").alias("m"))
        large = both.join(least, "u").where("v > u").select(F.col("v").alias("u"), F.col("m").alias("v")).distinct()
        # Small star: a node and its smaller neighbours point at the least of them.
        least = large.groupBy("u").agg(F.min("v").alias("m"))
        small = large.join(least, "u").select(F.explode(F.array(F.struct("v", "m"), F.struct(F.col("u").alias("v"), "m"))).alias("e"))
        after = small.select(F.col("e.v").alias("u"), F.col("e.m").alias("v")).where("u <> v").distinct()
        after = space.keep(after, "edges")
        space.drop(edges)
        edges, before, was = after, was, total(after)
        if before == was:
            # A fixed point: every node points straight at its component.
            nodes = edges.select(F.col("u").alias("node"), F.col("v").alias("component"))
            return nodes.unionByName(edges.select(F.col("v").alias("node"), F.col("v").alias("component")).distinct())
    raise RuntimeError("components have not settled")


def merge_components(comp: DataFrame, edges: DataFrame, space: Scratch) -> DataFrame:
    """``comp`` (node, component) with further ``edges`` (u, v), of which only those between components are followed."""
    of = lambda x: comp.select(F.col("node").alias(x), F.col("component").alias(f"c{x}"))
    ends = edges.select("u", "v").join(of("u"), "u", "left").join(of("v"), "v", "left")
    ends = space.keep(ends.select("u", "v", F.coalesce("cu", "u").alias("p"), F.coalesce("cv", "v").alias("q")), "ends")
    joined = connected_components(ends.select(F.col("p").alias("u"), F.col("q").alias("v")), space)
    joined = joined.select(F.col("node").alias("component"), F.col("component").alias("top"))
    tops = ends.select(F.explode(F.array("p", "q")).alias("node"))
    new = tops.distinct().join(comp, "node", "left_anti").select("node", F.col("node").alias("component"))
    return comp.unionByName(new).join(joined, "component", "left").select("node", F.coalesce("top", "component").alias("component"))
