"""Connected components of an edge table by alternating large-star and small-star steps.

Each step replaces edges by edges to smaller nodes of the same component; it ends when nothing
changes, with every node linked to the smallest node of its component. A step is a minimum per node
(partial sums before the shuffle) and a join of two written tables, whose large partitions the
adaptive planner can split, so a node with very many neighbours is not bound to one task. All tables
are written to the shared folder; nothing but counts comes to the driver.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tidelog.llm.common import drop_written, written

MAX_ROUNDS = 100


def _star(edges: DataFrame, large: bool) -> DataFrame:
    """One step over a written table of edges (u, v) with u > v."""
    near = edges.select("u", "v")
    if large:
        near = near.unionByName(edges.select(F.col("v").alias("u"), F.col("u").alias("v")))
    least = written(near.groupBy("u").agg(F.min("v").alias("v")).select("u", F.least("u", "v").alias("least")), "least")
    joined = near.join(least, "u")
    if large:
        out = joined.where("v > u").select(F.col("v").alias("u"), F.col("least").alias("v"))
    else:
        out = joined.select(F.explode(F.array(F.struct("u", F.col("least").alias("v")), F.struct(F.col("v").alias("u"), F.col("least").alias("v")))).alias("e")).select("e.u", "e.v")
    made = written(out.where("u > v").distinct(), "edges")
    drop_written(least)
    return made


def _state(edges: DataFrame) -> tuple:
    return tuple(edges.agg(F.count("*"), F.bit_xor(F.xxhash64("u", "v"))).first())


def connected_components(edges: DataFrame, a: str, b: str) -> DataFrame:
    """(node, root) for every node of an edge, root being the smallest node of the component.

    Null ends, loops and repeated edges are ignored; no edges give an empty table.
    """
    clean = edges.select(F.greatest(a, b).alias("u"), F.least(a, b).alias("v")).where(F.col(a).isNotNull() & F.col(b).isNotNull() & (F.col(a) != F.col(b)))
    now = written(clean.distinct(), "edges")
    state = _state(now)
    for _ in range(MAX_ROUNDS if state[0] else 0):
        big = _star(now, large=True)
        small = _star(big, large=False)
        drop_written(now)
        drop_written(big)
        now, before, state = small, state, _state(small)
        if state == before:
            break
    else:
        if state[0]:
            raise RuntimeError(f"components did not settle in {MAX_ROUNDS} rounds")
    roots = now.select(F.col("u").alias("node"), F.col("v").alias("root"))
    return roots.unionByName(now.select(F.col("v").alias("node"), F.col("v").alias("root")).distinct())
